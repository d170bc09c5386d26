import hashlib
import random

import duckdb

from cuemill.llm import preference
from cuemill.llm.queries import QUERIES
from cuemill.llm.sql import ORACLES

SCHEMA = "pair_id bigint, turn bigint, role string, text string"


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    got = QUERIES["op8_preference"](spark, sf_dir)
    columns = got.columns
    got = got.collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(ORACLES["op8_preference"]).select(", ".join(columns)).fetchall()))


def assembled(spark, chosen, rejected):
    turns = preference.preference_turns(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA))
    return {r.pair_id: r for r in preference.assemble(turns).collect()}


def test_prefix_prompt_and_masks(spark):
    shared = [(1, 0, "system", "S"), (1, 1, "user", "Hi")]
    got = assembled(spark, [*shared, (1, 2, "assistant", "good"), (1, 3, "user", "thanks")], [*shared, (1, 2, "assistant", "bad")])[1]
    assert got.prompt == "<|system|>\nS<|end|>\n<|user|>\nHi<|end|>\n"
    assert got.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nthanks<|end|>\n" and got.rejected == "<|assistant|>\nbad<|end|>\n"
    assert [got.chosen[s.start : s.end] for s in got.chosen_spans] == ["good<|end|>\n"]
    assert [got.rejected[s.start : s.end] for s in got.rejected_spans] == ["bad<|end|>\n"]


def test_equal_empty_and_one_sided(spark):
    a = [(1, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, None, None), (4, 0, "user", "y"), (4, 0, "user", "y"), (None, 0, "user", "lost")]
    b = [(1, 0, "user", "x"), (2, 0, "user", "z"), (3, 0, None, None), (5, 0, "assistant", "only")]
    got = assembled(spark, a, b)
    assert got[1].prompt and not got[1].chosen and not got[1].rejected
    assert not got[2].prompt and got[2].chosen and got[2].rejected
    assert got[3].prompt == "<||>\n<|end|>\n"
    assert got[4].chosen.count("y") == 2 and not got[4].prompt and not got[4].rejected
    assert got[5].rejected and not got[5].chosen and None not in got
    assert assembled(spark, [], []) == {}


def test_long_conversation_spans_blocks(spark):
    turns = [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1000)]
    got = assembled(spark, turns, turns[:-1] + [(9, 999, "assistant", "else")])[9]
    assert got.prompt.count("<|end|>") == 999 and got.chosen == "<|assistant|>\nt999<|end|>\n"
    assert got.prompt.index("t998") > got.prompt.index("t997")


def test_roles_and_texts_that_run_together_differ(spark):
    """A role that ends in a line and a text that begins with one are other turns than these joined otherwise; markers in texts change nothing."""
    got = assembled(spark, [(1, 0, "user\nb", "c"), (2, 0, "user", "a<|end|>\n"), (2, 1, "assistant", "x")], [(1, 0, "user", "b\nc"), (2, 0, "user", "a<|end|>\n"), (2, 1, "assistant", "y")])
    assert not got[1].prompt and got[1].chosen == "<|user\nb|>\nc<|end|>\n" and got[1].rejected == "<|user|>\nb\nc<|end|>\n"
    assert got[2].prompt == "<|user|>\na<|end|>\n<|end|>\n" and got[2].chosen == "<|assistant|>\nx<|end|>\n"


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_pairs_are_those_of_the_turns(spark):
    """Digests of every pair from the rendered turns, worked out in plain loops; clashing columns, long texts, turns without number."""
    rng = random.Random(6)
    make = lambda seed: [(p, rng.choice([None, k, k]), rng.choice(["user", "assistant", None]), "w" * rng.randrange(20) if p else "long " * 60_000, "clash", p) for p in range(12) for k in range(rng.randrange(1, 40))]
    schema = SCHEMA + ", part string, start bigint"
    chosen = make(1)
    rejected = [r for r in chosen if r[0] % 3] + [(p, 90, "assistant", "other", None, None) for p in range(12)]
    a, b = spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)
    expected = {}
    for r in preference.preference_turns(a, b).collect():
        e = expected.setdefault(r.pair_id, {})
        for name, n in ((f"{r.part}_turns", 1), (f"{r.part}_chars", len(r.rendered))):
            e[name] = e.get(name, 0) + n
        e[f"{r.part}_digest"] = e.get(f"{r.part}_digest", 0) ^ number(f"{r.position}:{hashlib.md5(r.rendered.encode()).hexdigest()}")
        if r.loss_end > r.loss_start:
            e[f"{r.part}_spans"] = e.get(f"{r.part}_spans", 0) + 1
            e[f"{r.part}_loss_chars"] = e.get(f"{r.part}_loss_chars", 0) + r.loss_end - r.loss_start
            e[f"{r.part}_mask"] = e.get(f"{r.part}_mask", 0) ^ number(f"{r.loss_start}:{r.loss_end}")
    for r in preference.pair_digests(a, b).collect():
        row = r.asDict()
        assert expected[row.pop("pair_id")] == {k: v for k, v in row.items() if v}
