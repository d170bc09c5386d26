"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Counts of every text become a vector of transformed statistics. For each language and
source the vectors' centre and scatter are those of the half of the rows whose scatter has
the smallest determinant. It is sought from several starts (medians and spreads of each
statistic, all rows, two small parts of the rows); concentration steps refit each on the
half of the rows nearest to the last centre until no determinant falls any more, and the
smallest wins. A half's scatter is widened by the factor that makes it right for normal
data. A row is rejected when its squared Mahalanobis distance exceeds a cutoff.

Everything is DataFrame functions. A step is one pass over the rows that sums moments per
group, start and fixed range of distances, combined before the shuffle, so that a group of
any size costs each task a few numbers. The half is cut at the end of such a range. The
scatter that is compared and used is regularised: the squares of least spreads are added
to its diagonal, since counts that are nearly always zero would make it singular.
"""

from __future__ import annotations

from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

SPACE = "[ \\t-\\r]+"
#: Statistics of the vector, each with the least spread that counts as ordinary.
FLOORS = {"x_word": 0.10, "x_symbol": 0.20, "x_lines": 0.30, "x_repeat": 0.30}
NAMES = list(FLOORS)
#: Squared distance above which a row is rejected; the one-in-two-thousand point of chi-square with four degrees of freedom.
CUTOFF = 20.0
#: Concentration steps at least and at most, the fall of the logarithm of a determinant that asks for another, and the ranges per unit of the logarithm of a distance.
LEAST_STEPS, MOST_STEPS, FALL, PER_LOG = 6, 30, 1e-3, 256
#: Parts of the rows, of which the first and the middle one are starts.
PARTS = 8
#: Groups with fewer rows are estimated with all rows of their language.
LEAST_ROWS = 50


def _consistency() -> float:
    """Half over the part of chi-square with six degrees of freedom below the median of that with four: the scatter of normal data over that of its inner half."""
    low, high = 0.0, 20.0
    for _ in range(100):  # the median: 1 - exp(-x / 2) (1 + x / 2) is one half
        x = (low + high) / 2
        low, high = (x, high) if 1 - exp(-x / 2) * (1 + x / 2) < 0.5 else (low, x)
    return 0.5 / (1 - exp(-x / 2) * (1 + x / 2 + x * x / 8))


CONSISTENCY = _consistency()


def words_of(text: Column) -> Column:
    """The words of a text; the pieces beside leading and trailing white space are empty and fall away."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _repeated(n_words: Column, hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    width = F.greatest(n_words - 2, F.lit(0)).cast("int")
    windows = F.transform(F.slice(hashes, F.lit(1), width), lambda h, i: F.xxhash64(h, F.element_at(hashes, (i + 2).cast("int")), F.element_at(hashes, (i + 3).cast("int"))))
    return windows


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts of every whole text beside its id, language and source."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"),
        words_of(text).alias("words"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda s: s.rlike("[^ \\t-\\r]")).alias("lines"),
    )
    rows = rows.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    rows = rows.withColumn("windows", _repeated(F.col("n_words"), F.col("hashes"))).drop("hashes")
    # windows with their places, sorted, so that equal ones are neighbours
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    has_repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn("placed", F.when(has_repeats, placed)).drop("windows")
    last = F.size("placed")
    again = F.filter(
        "placed",
        lambda x, k: F.when(k > 0, F.get("placed", k - 1)["h"] == x["h"]).otherwise(False) | F.when(k < last - 1, F.get("placed", k + 1)["h"] == x["h"]).otherwise(False),
    )
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("placed").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: logarithms, so that heavy right tails become ordinary."""
    n = F.col("n_words").cast("double")
    return [
        F.log(F.col("word_chars") / n).alias("x_word"),
        F.log(F.lit(1.0) + F.lit(10.0) * F.col("n_symbols") / n).alias("x_symbol"),
        F.log(F.lit(1.0) + F.lit(100.0) * F.col("n_dup_lines") / n).alias("x_lines"),
        F.log(F.lit(1.0) + F.lit(10.0) * F.col("n_repeat_words") / n).alias("x_repeat"),
    ]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _sums() -> list[Column]:
    """What moments are made of: number of rows, sums and products."""
    return [F.count("*").cast("double").alias("n"), *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(NAMES)], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}{j}") for i, j in _pairs()]]


def _moments(rows: DataFrame, widen: float = CONSISTENCY) -> DataFrame:
    """Centre, factor of the regularised scatter and logarithm of its determinant per group and start."""
    return _fitted(rows.groupBy("grp", "start").agg(*_sums()), widen)


def _fitted(g: DataFrame, widen: float) -> DataFrame:
    """From ``_sums`` per group and start to centre and factor."""
    return _factored(g.select("grp", "start", *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(len(NAMES))], *[(F.lit(widen) * ((F.col(f"q_{i}{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")) / F.col("n"))).alias(f"c_{i}{j}") for i, j in _pairs()]))


def _factored(g: DataFrame) -> DataFrame:
    """From ``m_i, c_ij`` to ``m_i, l_ij``: the scatter plus its floors as a lower triangle; no pivot is less than its floor's square."""
    for i, j in _pairs():
        c = F.col(f"c_{i}{j}") + (F.lit(list(FLOORS.values())[i] ** 2) if i == j else F.lit(0.0))
        done = reduce(lambda a, k: a - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}"), range(j), c)
        g = g.withColumn(f"l_{i}{j}", F.sqrt(done) if i == j else done / F.col(f"l_{j}{j}"))
    volume = reduce(lambda a, b: a + b, [F.log(F.col(f"l_{i}{i}")) for i in range(len(NAMES))])
    return g.select("grp", "start", *[f"m_{i}" for i in range(len(NAMES))], *[f"l_{i}{j}" for i, j in _pairs()], (F.lit(2.0) * volume).alias("log_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``d``, the squared Mahalanobis distance, by forward substitution."""
    for i in range(len(NAMES)):
        left = reduce(lambda a, k: a - F.col(f"l_{i}{k}") * F.col(f"y_{k}"), range(i), F.col(NAMES[i]) - F.col(f"m_{i}"))
        rows = rows.withColumn(f"y_{i}", left / F.col(f"l_{i}{i}"))
    return rows.withColumn("d", reduce(lambda a, b: a + b, [F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(NAMES))]))


def _range(d: Column) -> Column:
    return F.floor(F.log(F.lit(1e-9) + d) * PER_LOG)


def _medians(rows: DataFrame) -> DataFrame:
    """Start 0: medians as centre, spreads between the quartiles as a diagonal scatter; values in steps of 1/1000."""
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.floor(F.col(x) * 1000 + 0.5).cast("long").alias("v")) for i, x in enumerate(NAMES)])).alias("z")).select(F.struct("grp", "z.k").alias("grp"), "z.v")
    per = long.groupBy("grp", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp")
    per = per.select("grp", "v", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("n").over(w).alias("all"))
    first = lambda part: F.min(F.when(F.col("run") >= F.lit(part) * F.col("all"), F.col("v"))) / 1000.0
    q = per.groupBy("grp").agg(first(0.25).alias("a"), first(0.5).alias("b"), first(0.75).alias("c")).select("grp.grp", "grp.k", "b", ((F.col("c") - F.col("a")) / 1.349).alias("sd"))
    pick = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    wide = q.groupBy("grp").agg(*[pick(i, "b").alias(f"m_{i}") for i in range(len(NAMES))], *[(pick(i, "sd") * pick(i, "sd") if i == j else F.lit(0.0)).alias(f"c_{i}{j}") for i, j in _pairs()])
    return _factored(wide.withColumn("start", F.lit(0)))


def _starts(rows: DataFrame) -> DataFrame:
    """Medians and spreads (0), the moments of all rows (1), and those of the first and the middle part of the rows (2, 3)."""
    own = F.when(F.col("part") == 0, F.array(F.lit(1), F.lit(2))).when(F.col("part") == PARTS // 2, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))
    return _medians(rows).unionByName(_moments(rows.withColumn("start", F.explode(own)), 1.0))


def concentrated(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """One step: each start's fit on the half of its group that is nearest to it.

    Rows are met once: sums are kept for every range of distances, and the half is the
    sums of the ranges up to the one in which half of the rows is reached.
    """
    near = _distance(rows.join(fit, "grp")).withColumn("r", _range(F.col("d")))
    per = near.groupBy("grp", "start", "r").agg(*_sums())
    w = Window.partitionBy("grp", "start")
    before = F.coalesce(F.sum("n").over(w.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    half = per.withColumn("before", before).withColumn("all", F.sum("n").over(w)).where(F.col("before") < F.lit(0.5) * F.col("all"))
    names = [c for c in per.columns if c not in ("grp", "start", "r")]
    return _fitted(half.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in names]), CONSISTENCY)


def estimates(rows: DataFrame, most_steps: int = MOST_STEPS) -> DataFrame:
    """Centre and scatter factor per ``grp`` of the half of ``rows(grp, part, vector)`` with the smallest determinant that was found."""
    fit = materialise(_starts(rows), "mcd")
    for step in range(most_steps):
        new = materialise(concentrated(rows, fit), "mcd")
        falls = new.join(fit.select("grp", "start", F.col("log_det").alias("before")), ["grp", "start"]).where(F.col("log_det") < F.col("before") - FALL)
        fit = new
        if step + 1 >= LEAST_STEPS and falls.isEmpty():
            break
    names = [c for c in fit.columns if c not in ("grp", "start")]
    return fit.groupBy("grp").agg(F.min_by(F.struct(*names), F.struct(F.round("log_det", 6), "start")).alias("f")).select("grp", *[f"f.{c}" for c in names])


def quality(docs: DataFrame, cutoff: float = CUTOFF, most_steps: int = MOST_STEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ``base_failed``, squared distance ``d`` and ``kept`` for every row.

    Estimates use the rows that pass the base rules. A language and source with fewer than
    ``LEAST_ROWS`` of them is judged by its language's estimates, a language with fewer by
    those of all rows. Null texts have no words and fail; a null language or source is a
    group of its own; repeated rows are judged alike; an empty table gives no rows; other
    columns are not looked at. Estimation ends after ``most_steps`` steps even where a
    determinant still falls.
    """
    rows = materialise(counts(docs, id_col, text_col).withColumn("base_failed", base_failed()), "quality")
    fine = rows.where("not base_failed").select("lang", "source", F.pmod(F.col("word_chars") * 31 + F.col("n_words"), F.lit(PARTS)).cast("int").alias("part"), *vector())
    sizes = fine.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = F.sum("n").over(Window.partitionBy("lang"))
    level = F.when(F.col("n") >= LEAST_ROWS, 2).when(by_lang >= LEAST_ROWS, 1).otherwise(0)
    sizes = sizes.select(F.struct("lang", "source").alias("key"), level.alias("level"))
    sizes = materialise(sizes.select("key", "level", F.to_json(F.struct(F.col("level").alias("level"), F.when(F.col("level") > 0, F.col("key.lang")).alias("lang"), F.when(F.col("level") > 1, F.col("key.source")).alias("source"))).alias("grp")), "quality-groups")
    levels = sizes.select("grp", F.col("key.lang").alias("lang"), F.col("key.source").alias("source"), "level").distinct()
    all_levels = materialise(_members(fine, levels), "quality-vectors")
    fit = materialise(estimates(all_levels, most_steps), "mcd")

    judged = rows.select("*", F.struct("lang", "source").alias("key")).join(sizes, "key", "left").select(*rows.columns, "grp", *vector_or_null())
    judged = _distance(judged.join(fit, "grp", "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d") <= F.lit(cutoff), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.col("d")).alias("d"))


def vector_or_null() -> list[Column]:
    return [F.when(F.col("n_words") > 0, c).alias(name) for c, name in zip(vector(), NAMES)]


def _members(fine: DataFrame, levels: DataFrame) -> DataFrame:
    """Each vector once for its own group, and once for its language's and the whole's where some small group is judged by them."""
    keys = [F.struct(F.lit(2).alias("level"), "lang", "source"), F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")), F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))]
    named = levels.select(F.struct("level", F.when(F.col("level") > 0, F.col("lang")).alias("lang"), F.when(F.col("level") > 1, F.col("source")).alias("source")).alias("key"), "grp").distinct()
    return fine.select(F.explode(F.array(*keys)).alias("key"), "part", *NAMES).join(named, "key").select("grp", "part", *NAMES)
