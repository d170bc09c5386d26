"""Token counts by heap-and-linked-list byte-pair merging.

Every pre-token starts as its bytes (the last one carries the end-of-word mark).
A heap holds the mergeable adjacent pairs by rank, a doubly linked list holds the
symbols that are left; the lowest-rank pair is merged until none remains. The count
is initial symbols minus merges; no identifiers are looked up or emitted.

The work is one pass over the rows without a shuffle. A worker keeps the counts of
pre-tokens it has met in a dictionary of bounded size.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that one worker remembers before it starts anew.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are counted each time.
CACHE_LENGTH = 48

#: White space as the tokenizer's pattern has it, and that pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def merged_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left once no adjacent pair has a rank."""
    last = len(symbols) - 1
    before, after = list(range(-1, last)), list(range(1, last + 2))
    heap = [(rank, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    left = last + 1
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != pair[0] or j > last or symbols[j] != pair[1]:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = pair[0] + pair[1], ""
        left -= 1
        after[i] = k = after[j]
        if k <= last:
            before[k] = i
            if (rank := ranks.get(new := (symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, new))
        if (h := before[i]) >= 0 and (rank := ranks.get(new := (symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, new))
    return left


class PieceCounts(dict):
    """Token count of each pre-token, worked out when first asked for."""

    def __init__(self, ranks: dict[tuple[str, str], int], suffix: str):
        super().__init__()
        self.ranks, self.suffix, self.byte = ranks, suffix, byte_symbols()

    def __missing__(self, piece: str) -> int:
        symbols = [self.byte[b] for b in piece.encode("utf-8")]
        symbols[-1] += self.suffix
        n = merged_symbols(symbols, self.ranks)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = n
        return n


class TokenCounter:
    """Counts tokens as the vocabulary's own library does, specials taken from raw text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
        self.counts = PieceCounts({m: i for i, m in enumerate(merges)}, spec["model"].get("end_of_word_suffix") or "")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.path, self.library = path, None

    def segment(self, text: str) -> int:
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                return self.unsettled(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        return sum(map(self.counts.__getitem__, self.pieces(text.lower())))

    def unsettled(self, text: str) -> int:
        """For texts with code points that this Python's Unicode tables don't assign: tables of other versions
        class and fold them differently, so the library's own normaliser and splitter make the pieces."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        total = 0
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            symbols = list(piece)
            symbols[-1] += self.counts.suffix
            total += merged_symbols(symbols, self.counts.ranks)
        return total

    def __call__(self, text: str) -> int:
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One counter for each worker and vocabulary."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows are kept
    row by row; other columns are ignored, whatever their names; an empty table gives an
    empty result. ``vocabulary`` is the path of the tokenizer file on every machine.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py()
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(tokens(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
