"""Exact integer time arithmetic as column expressions.

Timestamps are BIGINT ticks of a rational time base; products are DECIMAL(38,0), which
holds every product of two BIGINTs. Nothing here is a double, and what overflows or has
invalid terms is null.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO, INF, DOWN, UP, NEAR = "zero", "inf", "down", "up", "near"
MIN, MAX = -(1 << 63), (1 << 63) - 1
Rate = Column | tuple[int, int]


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def _lit(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")


def parts(rate: Rate) -> tuple[Column, Column]:
    """Numerator and denominator of a ``struct(num, den)`` column or a pair of integers."""
    if isinstance(rate, Column):
        return rate["num"].cast("bigint"), rate["den"].cast("bigint")
    return _lit(rate[0]), _lit(rate[1])


def _rounded(product: Column, divisor: Column, rounding: str) -> Column:
    rest = product % divisor
    whole = F.try_divide(product - rest, divisor).cast("decimal(38,0)")
    up = F.when(rest > 0, 1).otherwise(0)
    down = F.when(rest < 0, 1).otherwise(0)
    near = F.abs(rest) * 2 >= divisor
    step = {
        ZERO: F.lit(0),
        INF: up - down,
        DOWN: -down,
        UP: up,
        NEAR: F.when(near, up - down).otherwise(0),
    }[rounding]
    return (whole + step).try_cast("bigint")


def _rounded_small(product: Column, divisor: Column, rounding: str) -> Column:
    """As ``_rounded``, where the product is a BIGINT."""
    rest = product % divisor
    whole = F.call_function("div", product - rest, divisor)
    up, down = F.when(rest > 0, 1).otherwise(0), F.when(rest < 0, 1).otherwise(0)
    near = F.abs(rest) >= divisor - F.abs(rest)
    step = {ZERO: F.lit(0), INF: up - down, DOWN: -down, UP: up, NEAR: F.when(near, up - down).otherwise(0)}[rounding]
    return whole + step


def rescale(value: Column, multiplier: Column | int, divisor: Column | int, rounding: str = NEAR) -> Column:
    """value * multiplier / divisor; NEAR rounds halves away from zero, INF away from zero."""
    b, c = _lit(multiplier), _lit(divisor)
    ok = (b >= 0) & (c > 0)
    small = _rounded_small(F.try_multiply(value.try_cast("bigint"), F.when(b >= 0, b)), F.when(c > 0, c), rounding)
    return F.when(ok, F.coalesce(small, _rounded(_wide(value) * _wide(b), _wide(F.when(c > 0, c)), rounding)))  # wide only where the product needs it


def rescale_q(value: Column, src: Rate, dst: Rate, rounding: str = NEAR, pass_minmax: bool = False) -> Column:
    """Ticks of ``src`` as ticks of ``dst``; with ``pass_minmax`` the two extreme values stay."""
    (sn, sd), (dn, dd) = parts(src), parts(dst)
    ok = (sn >= 0) & (sd > 0) & (dn > 0) & (dd > 0)
    out = F.when(ok, rescale(value, F.when(ok, sn * dd), F.when(ok, sd * dn), rounding))
    return F.when(value.isin(MIN, MAX), value).otherwise(out) if pass_minmax else out


def compare_ts(a: Column, tb_a: Rate, b: Column, tb_b: Rate) -> Column:
    """-1, 0 or 1; null for a time base that is not positive."""
    (an, ad), (bn, bd) = parts(tb_a), parts(tb_b)
    ok = (an > 0) & (ad > 0) & (bn > 0) & (bd > 0)
    left, right = _wide(a) * _wide(an * bd), _wide(b) * _wide(bn * ad)
    return F.when(ok, F.when(left < right, -1).when(left > right, 1).otherwise(0))


def order_key(ts: Column, tb: Rate, common_den: int) -> Column:
    """A number that sorts timestamps of several bases exactly, when every denominator divides ``common_den``."""
    n, d = parts(tb)
    return _wide(ts) * _wide(n * (F.lit(common_den).cast("bigint") / d).cast("bigint"))


def compare_mod(a: Column, b: Column, modulus: Column | int) -> Column:
    """Signed distance of wrapped clocks; null unless the modulus is a power of two."""
    m = _lit(modulus)
    ok = (m > 0) & (F.bit_count(m) == 1)
    wide = _wide(F.when(ok, m))
    diff = F.pmod(_wide(a) - _wide(b), wide)
    return F.when(diff * 2 > wide, diff - wide).otherwise(diff).try_cast("bigint")


def gcd(a: Column, b: Column) -> Column:
    """Euclid in 92 steps, enough for any two BIGINTs; at least 1."""
    start = F.struct(F.abs(a.cast("bigint")).alias("a"), F.abs(b.cast("bigint")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: F.greatest(s["a"], F.lit(1).cast("bigint")))


def reduce_ratio(n: Column, d: Column, separator: str = "/") -> Column:
    """``n/d`` in lowest terms, as text."""
    g = gcd(n, d)
    return F.concat_ws(separator, _div(n, g), _div(d, g))


def _div(n: Column, d: Column) -> Column:
    """Exact whole quotient."""
    return ((_wide(n) - _wide(n) % _wide(d)) / _wide(d)).cast("decimal(38,0)").cast("bigint")


def rational(num: Column, den: Column) -> Column:
    """Canonical ``struct(num, den)``: lowest terms, positive denominator; null for denominator 0 or parts beyond 32 bits."""
    g = F.when(den < 0, -gcd(num, den)).otherwise(gcd(num, den))
    n, d = _div(num, g), _div(den, g)
    fits = (den != 0) & n.between(-(1 << 31), (1 << 31) - 1) & (d <= (1 << 31) - 1)
    return F.when(fits, F.struct(n.cast("int").alias("num"), d.cast("int").alias("den")))


def add(a: Rate, b: Rate) -> Column:
    (an, ad), (bn, bd) = parts(a), parts(b)
    return rational(an * bd + bn * ad, ad * bd)


def subtract(a: Rate, b: Rate) -> Column:
    (an, ad), (bn, bd) = parts(a), parts(b)
    return rational(an * bd - bn * ad, ad * bd)


def multiply(a: Rate, b: Rate) -> Column:
    (an, ad), (bn, bd) = parts(a), parts(b)
    return rational(an * bn, ad * bd)


def divide(a: Rate, b: Rate) -> Column:
    (an, ad), (bn, bd) = parts(a), parts(b)
    return rational(an * bd, ad * bn)


def negate(a: Rate) -> Column:
    n, d = parts(a)
    return rational(-n, d)


def reciprocal(a: Rate) -> Column:
    n, d = parts(a)
    return rational(d, n)


def compare(a: Rate, b: Rate) -> Column:
    """-1, 0 or 1; n/0 counts as infinite, and null where the order is undefined."""
    (an, ad), (bn, bd) = parts(a), parts(b)
    diff = an * bd - bn * ad
    flip = F.when((ad < 0) != (bd < 0), -1).otherwise(1)
    same = F.when((ad != 0) & (bd != 0), 0).when((an != 0) & (bn != 0), (F.signum(an) - F.signum(bn)).cast("int"))
    return F.when(diff != 0, F.signum(diff).cast("int") * flip).otherwise(F.signum(same).cast("int"))


def format_time(value: Column, time_base: Rate) -> Column:
    """``seconds.micros``, the absolute value rounded half up; null stays null."""
    n, d = parts(time_base)
    micros = rescale(F.abs(value), n * 1_000_000, d)
    sign = F.when(value < 0, F.when(n > 0, "-").otherwise("")).otherwise("")
    whole = (micros - micros % 1_000_000).cast("decimal(19,0)") / F.lit(1_000_000).cast("decimal(19,0)")
    return F.concat(sign, whole.cast("bigint").cast("string"), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"))


def rate_from_text(text: Column, separators: Sequence[str] = ("/",)) -> Column:
    """``25`` or ``30000/1001`` as ``struct(num, den)`` in lowest terms; null unless positive. Headers of raw video write ``25:1``."""
    pattern = rf"^\s*(\d{{1,9}})(?:[{''.join(separators)}](\d{{1,9}}))?\s*$"
    n = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("bigint")
    d = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.lit("1")).cast("bigint")
    return F.when((n > 0) & (d > 0), rational(n, F.when(d > 0, d).otherwise(1)))


# --- bounded approximations: loops over single values, in vectorised helpers


def bounded(num: int, den: int, most: int) -> tuple[int, int]:
    """num/den with both parts at most ``most``: the last convergent that fits, or the largest semiconvergent if it is strictly closer."""
    import math

    sign = -1 if (num < 0) != (den < 0) else 1
    num, den = abs(num), abs(den)
    g = math.gcd(num, den) or 1
    n, d = num // g, den // g
    if n <= most and d <= most:
        return sign * n, d
    target_n, target_d = n, d
    (p0, q0), (p1, q1) = (0, 1), (1, 0)
    while d:
        a = n // d
        p2, q2 = a * p1 + p0, a * q1 + q0
        if p2 > most or q2 > most:
            k = min((most - p0) // p1 if p1 else most, (most - q0) // q1 if q1 else most)
            ps, qs = k * p1 + p0, k * q1 + q0
            closer = q1 == 0 or abs(target_n * qs - target_d * ps) * q1 < abs(target_n * q1 - target_d * p1) * qs
            if qs and closer:
                p1, q1 = ps, qs
            break
        (p0, q0), (p1, q1) = (p1, q1), (p2, q2)
        n, d = d, n - a * d
    return sign * p1, q1


def from_double(value: float, most: int) -> tuple[int, int]:
    """The best fraction for a double; 0/0 for NaN, +-1/0 beyond 32 bits."""
    import math

    if value is None or math.isnan(value):
        return 0, 0
    if abs(value) > 2147483647 + 3.0:
        return (-1 if value < 0 else 1), 0
    exponent = 0 if value == 0 else math.frexp(value)[1]
    den = 1 << (62 - max(exponent - 1, 0))
    return bounded(math.floor(value * den + 0.5), den, most)


def rational_from_double(value: Column, most: int = 2147483647) -> Column:
    @F.pandas_udf(T.StructType([T.StructField("num", T.IntegerType()), T.StructField("den", T.IntegerType())]))
    def convert(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([from_double(v, most) for v in x], columns=["num", "den"], dtype="int32")

    return convert(value.cast("double"))


def reduce_bounded(num: Column, den: Column, most: int = 2147483647) -> Column:
    @F.pandas_udf(T.StructType([T.StructField("num", T.IntegerType()), T.StructField("den", T.IntegerType())]))
    def convert(n: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bounded(int(a), int(b), most) for a, b in zip(n, d)], columns=["num", "den"], dtype="int32")

    return convert(num.cast("bigint"), den.cast("bigint"))


def gcd_with_limit(a: Rate, b: Rate, most_den: int, default: tuple[int, int]) -> Column:
    """The largest rational that divides both, or ``default`` if its denominator reaches ``most_den``."""
    (an, ad), (bn, bd) = parts(a), parts(b)
    lcm = _div(ad, gcd(ad, bd)) * bd
    fallback = F.struct(F.lit(default[0]).alias("num"), F.lit(default[1]).alias("den"))
    return F.when((ad > 0) & (bd > 0), F.when(lcm >= most_den, fallback).otherwise(F.struct(gcd(an, bn).cast("int").alias("num"), lcm.cast("int").alias("den"))))


# --- folds over one stream, for vectorised helpers


def div_round(n: int, d: int, rounding: str = NEAR) -> int:
    """Whole-number division of Python integers in the same five ways."""
    q, r = divmod(abs(n), d)
    sign = -1 if n < 0 else 1
    more = {ZERO: False, INF: r > 0, DOWN: r > 0 and n < 0, UP: r > 0 and n > 0, NEAR: 2 * r >= d and r > 0}[rounding]
    return sign * (q + more)


def _to(v: int, src: tuple[int, int], dst: tuple[int, int], rounding: str = NEAR) -> int:
    return div_round(v * src[0] * dst[1], src[1] * dst[0], rounding)


def delta_range(ts: int, duration: int, in_tb: tuple[int, int], fs_tb: tuple[int, int], out_tb: tuple[int, int]) -> tuple[int, int, int, int] | None:
    """Which ``last`` a timestamp follows: from the first to the fourth, moved into the range from the second to the third; None if it never does."""
    if not duration or in_tb[0] * out_tb[1] <= out_tb[0] * in_tb[1]:
        return None
    low, high = _to(2 * ts - 1, in_tb, fs_tb, DOWN) >> 1, (_to(2 * ts + 1, in_tb, fs_tb, UP) + 1) >> 1
    return 2 * low - high, low, high, 2 * high - low


def delta_step(ts: int, duration: int, last: int | None, in_tb: tuple[int, int], fs_tb: tuple[int, int], out_tb: tuple[int, int]) -> tuple[int, int]:
    """One step of drift-free rescaling: (output, new last).

    ``last`` is where the next sample should begin, in ``fs_tb``. As long as it lies near
    the rounding range of the timestamp it is followed; otherwise the timestamp counts.
    """
    if last is not None and (edges := delta_range(ts, duration, in_tb, fs_tb, out_tb)) and edges[0] <= last <= edges[3]:
        at = min(max(last, edges[1]), edges[2])
        return _to(at, fs_tb, out_tb), at + duration
    return _to(ts, in_tb, out_tb), _to(ts, in_tb, fs_tb) + duration


def stable_step(ts: int, ts_tb: tuple[int, int], inc_tb: tuple[int, int], inc: int = 1) -> int:
    """ts plus ``inc`` ticks of ``inc_tb`` without drift: the phase within the increment is kept."""
    num, den = (inc_tb if inc == 1 else bounded(inc_tb[0] * inc, inc_tb[1], 2147483647))
    m, d = num * ts_tb[1], den * ts_tb[0]
    if m < d:
        return ts
    if m % d == 0:
        return ts + m // d
    old = div_round(ts * ts_tb[0] * den, ts_tb[1] * num)
    back = div_round(old * num * ts_tb[1], den * ts_tb[0])
    return div_round((old + 1) * num * ts_tb[1], den * ts_tb[0]) + ts - back
