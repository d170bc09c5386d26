import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuemill.llm.token_counts import PieceCounts, TokenCounter, merged_symbols, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
COUNTER, LIBRARY = TokenCounter(PATH), Tokenizer.from_file(PATH)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_merging_order():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert merged_symbols(list("abc"), ranks) == 1
    assert merged_symbols(list("abab"), ranks) == 2
    assert merged_symbols(["a"], ranks) == 1
    assert merged_symbols(list("aaaa"), {("a", "a"): 0}) == 2


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x4FF, exclude_categories=["Cs", "Cn"]), max_size=60))
def test_like_the_library(text):
    assert COUNTER(text) == expected(text)


def test_long_words_and_small_cache():
    word = "abcdefghij" * 500
    assert COUNTER(word) == expected(word)
    counts = PieceCounts(COUNTER.counts.ranks, COUNTER.counts.suffix)
    counts["x"] = 99
    assert counts["hello"] == expected("hello")


def test_every_document(spark, documents, rows):
    got = token_counts(documents, PATH).toPandas().set_index("doc_id").sort_index()
    assert got.n_tokens.tolist() == [expected(t) for t in rows.text]
    assert got.n_bytes.tolist() == [len(t.encode()) for t in rows.text]
    assert got.over_limit.tolist() == [n > 2048 for n in got.n_tokens]


def test_awkward(awkward, empty):
    from .conftest import TEXTS

    got = token_counts(awkward, PATH).toPandas()
    assert len(got) == len(TEXTS) + 3 and got.doc_id.isna().sum() == 1
    for i, t in enumerate(TEXTS):
        part = got[got.doc_id == i]
        assert set(part.n_tokens) == {expected(t)} and set(part.n_bytes) == {len((t or "").encode())}
    assert token_counts(empty, PATH).count() == 0


def test_every_code_point():
    """In a Latin and a Greek word, each code point that text can hold gives the library's count."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 1 << 16):
        texts = [f"a{chr(c)}b Α{chr(c)}Σ" for c in points[k : k + (1 << 16)]]
        expected = [len(e.ids) for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]
        assert list(map(COUNTER, texts)) == expected
