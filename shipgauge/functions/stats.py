"""Order-independent mean and standard deviation.

A double sum depends on the order in which partitions arrive. Durations are
therefore summed as whole milliseconds: n, sum and sum of squares are exact in
any order, and every derived value is computed once from those three numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MS_PER_HOUR = 3_600_000.0
# For durations up to 200 years (2^43 ms) the products of halves stay below 2^46; they
# are summed by halves themselves, which stay in a BIGINT for 10^12 rows.
HALF_BITS = 20


def to_ms(hours: Column) -> Column:
    return F.floor(hours * F.lit(MS_PER_HOUR) + F.lit(0.5))


def sum_parts(ms: Column, name: str) -> list[Column]:
    """Aggregates for an exact sum of non-negative ``ms``, joined up by ``resolve``.

    A BIGINT sum could overflow for a huge group and a DECIMAL one is several
    times slower per row, so the halves of the number are summed as BIGINT.
    """
    return [F.sum(_high(ms)).alias(f"{name}_hi"), F.sum(_low(ms)).alias(f"{name}_lo")]


def square_parts(ms: Column, name: str) -> list[Column]:
    """Aggregates for an exact sum of squares: (a + b)^2 by halves a, b of ``ms``."""
    a, b = _high(ms), _low(ms)
    return [
        *sum_parts(a * a, f"{name}_aa"),
        *sum_parts(a * b, f"{name}_ab"),
        *sum_parts(b * b, f"{name}_bb"),
    ]


def resolve(df: DataFrame, sums: tuple[str, ...] = (), squares: tuple[str, ...] = ()) -> DataFrame:
    """Replace parts by their DECIMAL values; 0 for a group without values."""
    wide = F.lit(1 << HALF_BITS).cast("decimal(8,0)")

    def part(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("decimal(19,0)")

    def total(name: str) -> Column:
        return part(f"{name}_hi") * wide + part(f"{name}_lo")

    def square(name: str) -> Column:
        cross = total(f"{name}_ab") * F.lit(2 << HALF_BITS).cast("decimal(8,0)")
        return total(f"{name}_aa") * wide * wide + cross + total(f"{name}_bb")

    halves = [f"{n}_{h}" for n in sums for h in ("hi", "lo")]
    quarters = [f"{n}_{h}" for n in squares for h in ("aa_hi", "aa_lo", "ab_hi", "ab_lo", "bb_hi", "bb_lo")]
    return df.withColumns({
        **{n: total(n).cast("decimal(30,0)") for n in sums},
        **{n: square(n).cast("decimal(38,0)") for n in squares},
    }).drop(*halves, *quarters)


def _high(ms: Column) -> Column:
    return F.shiftright(ms, HALF_BITS)


def _low(ms: Column) -> Column:
    return ms.bitwiseAND(F.lit((1 << HALF_BITS) - 1))


def mean_hours(total_ms: Column, n: Column) -> Column:
    """NULL for n = 0."""
    return total_ms.cast("double") / F.nullif(n.cast("double") * F.lit(MS_PER_HOUR), F.lit(0.0))


def _squared_deviation(total_ms: Column, sq_ms: Column, n: Column) -> Column:
    """n * sum((x - mean)^2).

    With q the whole number nearest to the mean and r = total - n * q this is
    n * sum((x - q)^2) - r^2, whose terms are as small as the spread is. The sum is
    exact; the product is a double only where it has more than 38 digits, and since
    r^2 is at most half of it, nothing cancels there either.
    """
    wide_n = n.cast("decimal(18,0)")
    q = F.call_function("div", total_ms + total_ms + wide_n, F.nullif(wide_n + wide_n, F.lit(0).cast("decimal(18,0)"))).cast("decimal(18,0)")
    around = sq_ms - q * (total_ms + total_ms - wide_n * q)
    rest = total_ms - wide_n * q
    exact = F.try_subtract(F.try_multiply(wide_n, around), F.try_multiply(rest, rest))
    k, r = n.cast("double"), rest.cast("double")
    return F.coalesce(exact.cast("double"), k * around.cast("double") - r * r)


def sd_sample_hours(total_ms: Column, sq_ms: Column, n: Column) -> Column:
    """n - 1 divisor. One sample gives 0, none gives NULL."""
    k = n.cast("double")
    dev = _squared_deviation(total_ms, sq_ms, n)
    return (
        F.when(n > 1, F.sqrt(dev / (k * (k - 1))) / F.lit(MS_PER_HOUR))
        .when(n == 1, F.lit(0.0))
    )


def sd_population_hours(total_ms: Column, sq_ms: Column, n: Column) -> Column:
    k = n.cast("double")
    dev = _squared_deviation(total_ms, sq_ms, n)
    return F.when(n > 0, F.sqrt(dev / (k * k)) / F.lit(MS_PER_HOUR))
