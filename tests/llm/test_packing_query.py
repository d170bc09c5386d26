"""The registered packing cuts a long document so that its first piece is the shorter one."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from cuemill.llm import queries


def test_first_piece_may_be_shorter(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    words = "one two three four five six seven eight nine ten ".split()
    texts = [" ".join(words[k % 10] for k in range(n)) for n in (0, 5, 2046, 2047, 2048, 2049, 4095, 4096, 5000)]
    got = queries.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).toPandas()
    cut = 0
    for i, text in enumerate(texts):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        ends = sorted(range(len(ids), 0, -2048))
        expected = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends))]
        part = got[got.doc_id == i].sort_values("piece")
        assert list(zip(part.piece, part.start, part.length, part.ids_crc32)) == expected
        cut += len(ends) > 1 and ends[0] < 2048
    assert cut >= 3
