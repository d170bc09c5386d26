"""Preference formatting: one prompt, two masked completions.

Chosen and rejected conversations come as tables of turns. Their longest common prefix of
turns is rendered once as the prompt; what follows in each is a completion, with the spans
that a loss may see (the content of assistant turns). Places are worked out on one narrow
row per turn, so no conversation, however long, has to fit into one row or task:
``pair_digests`` emits one row per pair from these alone, ``preference_turns`` carries the
texts along, and ``assemble`` joins the turns of ordinary pairs.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns numbered alike but for this many lowest places make one block of a long conversation; turns without a number are dealt into as many.
BLOCK = 256
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"


def _running(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of the keys, block by block of turns."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)) + F.conv(F.substring(F.hex("same"), 1, 2), 16, 10).cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("same")]
    rows = rows.withColumn("_v", value).withColumn("_b", block)
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sums.select(*keys, "_b", before.alias("_s")), [*keys, "_b"]).withColumn(name, F.col("_s") + own).drop("_v", "_b", "_s")


def prepared(turns: DataFrame, side: str, carry: bool) -> DataFrame:
    """One row per turn: what tells it from others (``same``, of role and text), digest and length of it rendered, length of its head, whether a loss may see it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.replace(F.lit(HEAD), F.lit("{role}"), role)
    rendered = F.concat(head, text, F.lit(TAIL))
    md5 = lambda c: F.unhex(F.md5(c.cast("binary")))
    return turns.where(F.col("pair_id").isNotNull()).select(
        "pair_id", F.lit(side).alias("side"), F.col("turn").cast("long").alias("turn"),
        md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("same"), md5(rendered).alias("digest"),
        F.length(rendered).cast("long").alias("n"), F.length(head).cast("long").alias("head"), (role == "assistant").alias("learned"),
        *([role.alias("role"), rendered.alias("rendered")] if carry else []),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """``pair_id, prefix``: number of turns that both sides share from the start."""
    seen = turns.groupBy("pair_id", "position").agg(F.count("*").alias("n"), F.min("same").alias("a"), F.max("same").alias("b"))
    differs = (F.col("n") < 2) | (F.col("a") != F.col("b"))
    return seen.groupBy("pair_id").agg(F.coalesce(F.min(F.when(differs, F.col("position"))), F.max("position") + 1).alias("prefix"))


def placed(chosen: DataFrame, rejected: DataFrame, carry: bool = False) -> DataFrame:
    """Every turn with its part (prompt, chosen or rejected), place there and span to learn from."""
    both = prepared(chosen, "chosen", carry).unionByName(prepared(rejected, "rejected", carry))
    both = _running(both, ["pair_id", "side"], F.lit(1), "position")
    rows = both.join(prefixes(both), "pair_id").where((F.col("side") == "chosen") | (F.col("position") >= F.col("prefix")))
    rows = rows.withColumn("part", F.when(F.col("position") < F.col("prefix"), "prompt").otherwise(F.col("side")))
    rows = _running(rows, ["pair_id", "part"], F.col("n"), "start")
    learned, end = (F.col("part") != "prompt") & F.col("learned"), F.col("start") + F.col("n")
    return rows.withColumn("loss_start", F.when(learned, F.col("start") + F.col("head")).otherwise(end)).withColumn("loss_end", end)


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per rendered turn of every pair.

    Both inputs have ``pair_id, turn, role, text``; other columns are ignored. Returned are
    ``pair_id, part`` (prompt, chosen or rejected), ``position`` in the conversation,
    ``role``, ``start`` (code points before the turn in its part), ``rendered``,
    ``loss_start, loss_end`` (code points within the part; equal where everything is
    masked). Turns are in the order of their numbers, those without one first, ties by a
    digest of role and text. Null roles and texts count as empty ones and are rendered so;
    turns are the same if role and text both are. Texts are taken as they are, also where
    they hold markers. A pair with one side only has an empty prompt. Equal sides are all
    prompt. Rows without a pair_id belong to no pair and are left out; repeated rows are
    turns of their own; empty tables give no rows.
    """
    return placed(chosen, rejected, carry=True).select("pair_id", "part", "position", "role", "start", "rendered", "loss_start", "loss_end")


def _number(text: Column) -> Column:
    """The first 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def pair_digests(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair: the prompt and both masked completions by their turns, code points and digests.

    ``{part}_turns, {part}_chars``, ``{part}_digest`` (of every turn's place and MD5), and of
    completions ``{part}_spans, {part}_loss_chars, {part}_mask`` (of the spans to learn from).
    All are sums or XORs, combined before the shuffle. What ``preference_turns`` says of
    nulls, ties, repeats and empty tables holds here.
    """
    rows = placed(chosen, rejected)
    what = _number(F.concat_ws(":", F.col("position").cast("string"), F.lower(F.hex("digest"))))
    mask = _number(F.concat_ws(":", F.col("loss_start").cast("string"), F.col("loss_end").cast("string")))
    seen = F.col("loss_end") - F.col("loss_start")
    found = []
    for part in ("prompt", "chosen", "rejected"):
        of = lambda c, part=part: F.when(F.col("part") == part, c)
        spans = lambda c, part=part: F.when((F.col("part") == part) & (seen > 0), c)
        found += [F.count(of(F.lit(1))).alias(f"{part}_turns"), F.coalesce(F.sum(of(F.col("n"))), F.lit(0)).alias(f"{part}_chars"), F.coalesce(F.bit_xor(of(what)), F.lit(0)).alias(f"{part}_digest")]
        if part != "prompt":
            found += [F.count(spans(F.lit(1))).alias(f"{part}_spans"), F.coalesce(F.sum(of(seen)), F.lit(0)).alias(f"{part}_loss_chars"), F.coalesce(F.bit_xor(spans(mask)), F.lit(0)).alias(f"{part}_mask")]
    return rows.groupBy("pair_id").agg(*found)


def assemble(turns: DataFrame) -> DataFrame:
    """One row per pair: ``prompt, chosen, rejected`` and the spans to learn from; for pairs whose text fits a row."""
    at = F.struct("position", "rendered", "loss_start", "loss_end")
    parts = turns.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(at)).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["rendered"]), "")
    spans = F.transform(F.filter("t", lambda x: x["loss_start"] < x["loss_end"]), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end")))
    parts = parts.select("pair_id", "part", text.alias("text"), spans.alias("spans"))
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    return parts.groupBy("pair_id").agg(F.coalesce(pick("prompt", "text"), F.lit("")).alias("prompt"), F.coalesce(pick("chosen", "text"), F.lit("")).alias("chosen"), pick("chosen", "spans").alias("chosen_spans"), F.coalesce(pick("rejected", "text"), F.lit("")).alias("rejected"), pick("rejected", "spans").alias("rejected_spans"))


def last_reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations (with ids that are whole numbers): each is chosen as
    it is; rejected is the same conversation with its last assistant turn replaced by that of the neighbour (the id
    that differs in the lowest bit). Without such turns on both, the rejected side ends
    before the reply.
    """
    chosen = conversations.select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    reply = chosen.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("r"))
    last = reply.select("pair_id", F.col("r.turn").alias("last_turn"))
    rest = chosen.join(last, "pair_id", "left").where("last_turn is null or turn is null or turn < last_turn").drop("last_turn")
    other = reply.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("r.text").alias("text"))
    swapped = other.join(last, "pair_id").select("pair_id", F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), "text")
    return chosen, rest.unionByName(swapped)
