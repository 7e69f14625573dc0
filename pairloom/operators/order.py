"""Totals, numbers and quantiles over a whole table in order, without a task that sees the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.lineage import cut

#: Values that the last pass of a quantile may sort in one task, and bins of each pass before.
FEW, BINS = 50_000, 1_024


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running_before(df: DataFrame, order: Sequence[str | Column], value: str | None = None, name: str = "before") -> DataFrame:
    """df with the sum of value (the number of rows if None) over all rows that come before, as a long column.

    The order must tell all rows apart, or rows that agree in it get any of their places. Two passes: rows are dealt by
    ranges of the order and kept, then every range sums up within itself and adds the totals of the ranges before; only
    these totals, one per range, are put in order together. Null values count as 0."""
    order = _columns(order)
    amount = F.lit(1).cast("long") if value is None else F.coalesce(F.col(value), F.lit(0)).cast("long")
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(F.sum(amount).alias("__sum"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__in", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return summed.join(F.broadcast(starts), "__range").withColumn(name, (F.col("__start") + F.col("__in")).cast("long")).select(*df.columns, name)


def numbered_from_zero(df: DataFrame, order: Sequence[str | Column], name: str = "at") -> DataFrame:
    """df with the place of each row in the order, from 0."""
    return running_before(df, order, None, name)


def first_by_hash(df: DataFrame, hashed: Column, tie: str, n: int) -> DataFrame:
    """The first n rows by a hex hash, then by tie, with their place in `at`.

    Hashes are uniform, so a prefix of them that holds a few more than n rows is cut off first and only that is put in
    order; should it hold fewer, all rows are."""
    total = df.count()
    share = min(1.0, (n + 8 * n**0.5 + 64) / max(total, 1))
    some = df.filter(hashed < f"{int(share * 16**8):08x}") if share < 1 else df
    if share < 1 and some.count() < n:
        some = df
    return numbered_from_zero(some, [hashed, tie]).filter(F.col("at") < n)


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at places (from 0) of a numeric column in order, nulls left out, not-a-number last.

    Each pass counts the rows of bins between the least and the largest value that a rank can still have; the bin that
    holds the rank is the next pass's span. A span of at most FEW rows, or of one value, is read out."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    inf, nan = float("inf"), float("nan")
    real = rows.filter(~F.isnan("x") & (F.abs("x") < inf))
    low, high = rows.agg(F.count_if(F.col("x") == -inf), F.count_if(F.col("x") == inf)).first()
    n, lo, hi = real.agg(F.count("*"), F.min("x"), F.max("x")).first()
    found: dict[int, float] = {r: -inf if r < low else inf if r < low + n + high else nan for r in ranks if not low <= r < low + n}
    spans = {r: (lo, hi, low, n) for r in ranks if r not in found}  # least and largest value, rows before, rows in it
    while open_ := {r: s for r, s in spans.items() if r not in found}:
        for r, (lo, hi, before, n) in open_.items():
            if lo == hi:
                found[r] = lo
            elif n <= FEW:
                got = real.filter(F.col("x").between(lo, hi)).orderBy("x").offset(r - before).limit(1).first()
                found[r] = got[0]
        wide = sorted({s for r, s in open_.items() if r not in found})
        if not wide:
            continue
        which = F.lit(None).cast("int")
        bin_ = F.lit(None).cast("int")
        for i, (lo, hi, _, _) in enumerate(wide):
            inside = F.col("x").between(lo, hi)
            part = (F.col("x") - lo) / (hi - lo) if hi - lo < inf else (F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2)
            at = F.least(F.floor(part * BINS), F.lit(BINS - 1)).cast("int")
            which, bin_ = F.when(inside, i).otherwise(which), F.when(inside, at).otherwise(bin_)
        counted = real.select("x", which.alias("span"), bin_.alias("bin")).filter(F.col("span").isNotNull())
        bins = counted.groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r, s in open_.items():
            if r in found:
                continue
            before = s[2]
            for b in sorted((b for b in bins if wide[b.span] == s), key=lambda b: b.bin):
                if r < before + b.n:
                    spans[r] = (b.lo, b.hi, before, b.n)
                    break
                before += b.n
    return found


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, interpolated between the two values around each; None for a table without values."""
    n = df.select(F.count(column)).first()[0]
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * p for p in shares]
    at = order_statistics(df, column, sorted({k for p in places for k in (int(p), min(int(p) + 1, n - 1))}))
    out = []
    for p in places:
        low, high = at[int(p)], at[min(int(p) + 1, n - 1)]
        out.append(low if low == high else (int(p) + 1 - p) * low + (p - int(p)) * high)
    return out
