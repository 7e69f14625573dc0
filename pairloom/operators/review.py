"""Pairs as a reader sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.core import hash_order, one_line

#: What a nested value is asked for first, by column.
FIRST = {"names": ("primary", "common"), "brand": ("names", "primary"), "addresses": ("freeform", "locality"), "categories": ("primary",)}
#: Columns of a pair itself that a card names in its first line, where there are any.
HEAD = ("label", "pair_type", "hard_neg_source", "distance_m")


def _lines(wide: DataFrame, columns: list[str]) -> list[Column]:
    """One line a column: its name, the left value, the right value."""
    shown = lambda c: one_line(F.col(c), wide.schema[c].dataType, FIRST.get(c.partition("_")[2], ())).cast("string")
    return [F.format_string("  %-14s %-70s | %s", F.lit(c), shown(f"left_{c}"), shown(f"right_{c}")) for c in columns]


def cards(wide: DataFrame, n: int = 10, columns: list[str] | None = None, seed: int | str | None = None) -> DataFrame:
    """n pairs of a wide pair table as (pair_id, card), one text each: a head, then both sides of every column in a line.

    The first pairs by number, or with a seed those that come first by hash. Columns that the table lacks are not shown, so
    tables with and without types and distances will do; all columns that both sides have unless some are named."""
    both = [c.removeprefix("left_") for c in wide.columns if c.startswith("left_") and f"right_{c.removeprefix('left_')}" in wide.columns]
    order = [F.col("pair_id")] if seed is None else [hash_order(seed, F.col("pair_id")), F.col("pair_id")]
    head = [F.concat(F.lit(f"{c} "), F.when(F.col(c).cast("string") == "", "-").otherwise(F.coalesce(
        F.format_string("%.1f m", F.col(c)) if c == "distance_m" else F.col(c).cast("string"), F.lit("-")))) for c in HEAD if c in wide.columns]
    first = F.concat_ws("  ", F.format_string("pair %d", F.col("pair_id").cast("long")), *head)
    return wide.orderBy(*order).limit(n).select("pair_id", F.concat_ws("\n", first, *_lines(wide, [c for c in columns or both if c in both])).alias("card"))


def shown(wide: DataFrame, n: int = 10, **how) -> str:
    """cards() and the number of pairs of each type, as one text for a terminal."""
    kind = next((c for c in ("pair_type", "label") if c in wide.columns), None)
    counts = [f"  {r[0]}: {r[1]}" for r in wide.groupBy(kind).agg(F.count("*").alias("n")).orderBy(kind).collect()] if kind else []
    return "\n\n".join([*(r.card for r in cards(wide, n, **how).collect()), "\n".join(["pairs", *counts])])
