"""Mixing sources to target weights by systematic sampling.

Within a source every document expects r = target / source size copies. Documents are put in an order (by size class,
then by a hash of the id); the prefix sum of expectations starts at one random offset, and a document is emitted once
per integer that its stretch crosses, so at most ceil(r) and at least floor(r) times. The prefix sum has two levels:
counts of cells (source, size class, hash cell), and the rank within a cell; no source is ever one group of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import WORD, materialize

WEIGHTS = (3, 1, 2)


def _size_class(size: Column) -> Column:
    """Sizes under 16 as they are; beyond, the binary exponent and three more bits: 1/8 octave."""
    e = F.length(F.bin(size)) - 1
    return F.when(size < 16, size.cast("int")).otherwise(e * 8 + F.expr("cast(shiftright(__size, length(bin(__size)) - 4) & 7 as int)"))


def _keyed(docs: DataFrame, size: Column) -> DataFrame:
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return (docs.withColumn("__size", size.cast("long"))
            .withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")))
            .withColumn("__class", _size_class(F.col("__size"))).withColumn("__hash", md5)
            .withColumn("__cell", F.substring("__hash", 1, 2)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(__key, total) -> (__key, total, target double).

    Sources in code-point order (null last) weigh as `weights`, repeating, and share `share` times all sizes; a target
    stops at cap * total and the excess is shared again. That is one water level: sources sorted by cap / weight, the
    first whose share of what is left stays under its cap sets the level for all after it."""
    every = Window.partitionBy(F.lit(0))
    by_ratio = every.orderBy("ratio", "__key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("i") - 1, F.lit(len(weights))).cast("int") + 1)
    out = (sizes.withColumn("i", F.row_number().over(every.orderBy("__key"))).withColumn("w", weight)
           .withColumn("most", F.lit(float(cap)) * F.col("total")).withColumn("ratio", F.col("most") / F.col("w"))
           .withColumn("n", F.row_number().over(by_ratio))
           .withColumn("before", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("level", (F.lit(float(share)) * F.sum("total").over(every) - F.col("before")) / F.col("left"))
           .withColumn("open", F.min(F.when(F.col("level") < F.col("ratio"), F.col("n"))).over(every))
           .withColumn("level", F.max(F.when(F.col("n") == F.col("open"), F.col("level"))).over(every)))
    target = F.when(F.col("n") >= F.col("open"), F.col("level") * F.col("w")).otherwise(F.col("most"))
    return out.select("__key", "total", target.alias("target"))


def with_copies(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs(doc_id, source, ...) with size, source_size, target and copies added (names the input has are replaced).

    size: words of text unless given; null counts 0. A null source is a source, last in order. Rows of equal doc_id
    are sampled each. Nothing depends on partitioning, so reruns agree. An empty table gives an empty one."""
    if size is None:
        size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    keyed = _keyed(docs, size)
    cells = materialize(keyed.groupBy("__key", "__class", "__cell").agg(F.count("*").alias("rows"), F.sum("__size").alias("words")))
    totals = targets(cells.groupBy("__key").agg(F.sum("words").alias("total")), weights, share, cap)
    up_to = Window.partitionBy("__key").orderBy("__class", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = (cells.withColumn("__before", F.coalesce(F.sum("rows").over(up_to), F.lit(0))).drop("rows", "words").join(totals, "__key")
              .withColumnsRenamed({"total": "__total", "target": "__target"}))
    in_cell = Window.partitionBy("__key", "__class", "__cell").orderBy("__hash", "doc_id", "__size")
    k = F.col("__before") + F.row_number().over(in_cell)
    # 16 bits: offset + 2 k is exact in double precision
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("offset|"), F.col("__key")).cast("binary")), 1, 4), 16, 10).cast("double") / 65536
    rate = F.when(F.col("__total") == 0, F.lit(0.0)).otherwise(F.col("__target") / F.col("__total"))
    out = keyed.join(placed, ["__key", "__class", "__cell"]).withColumn("__k", k).withColumn("__u", offset).withColumn("__r", rate)
    crossed = F.floor(F.col("__u") + F.col("__r") * F.col("__k")) - F.floor(F.col("__u") + F.col("__r") * (F.col("__k") - 1))
    new = {"size": F.col("__size"), "source_size": F.col("__total"), "target": F.col("__target"), "copies": crossed.cast("int")}
    return out.select(*[c for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with every row repeated as often as the mix takes it, columns as they were, whatever their names.

    Null texts count no words; rows of null or equal doc_id are rows each; a null source is a source; an empty table stays
    empty."""
    copies = with_copies(docs.select("*", *[F.col(c).alias(f"__in_{c}") for c in ("size", "source_size", "target", "copies") if c in docs.columns]), **how)
    named = [F.col(f"__in_{c}").alias(c) if f"__in_{c}" in copies.columns else F.col(c) for c in docs.columns]
    return copies.withColumn("__copy", F.explode(F.expr("array_repeat(0, copies)"))).select(*named)


def mix_report(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, size, source_size, target, taken, copies), over narrow rows only."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    narrow = materialize(docs.select("doc_id", "source", size.alias("words")))
    out = with_copies(narrow, F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce('s' || source, 't') AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY k),
w AS (SELECT k, total, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY k)) - 1) % 3 + 1] AS w, 2.0::DOUBLE * total AS most FROM s),
r AS (SELECT *, most / w AS ratio, row_number() OVER (ORDER BY most / w, k) AS n FROM w),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(total) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r),
o AS (SELECT *, min(CASE WHEN lv < ratio THEN n END) OVER () AS open FROM l),
t AS (SELECT k, total, CASE WHEN n >= open THEN max(CASE WHEN n = open THEN lv END) OVER () * w ELSE most END AS target FROM o),
c AS (SELECT *, CASE WHEN size < 16 THEN size ELSE (length(bin(size)) - 1) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END AS class FROM d),
x AS (SELECT c.*, t.total, t.target, row_number() OVER (PARTITION BY c.k ORDER BY class, h, doc_id, size) AS i,
         CAST(('0x' || substr(md5('offset|' || c.k), 1, 4)) AS BIGINT) / 65536.0::DOUBLE AS u,
         CASE WHEN t.total = 0 THEN 0.0::DOUBLE ELSE t.target / t.total END AS r FROM c JOIN t ON c.k = t.k),
y AS (SELECT *, CAST(floor(u + r * i) - floor(u + r * (i - 1)) AS INTEGER) AS copies FROM x)
SELECT doc_id, size, total AS source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM y
"""
