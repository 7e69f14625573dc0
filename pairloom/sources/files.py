"""Files of a table: their hash and the place of each row in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators.lineage import cut


#: Bytes up to which a task holds a file whole to hash it.
WHOLE = 256 << 20
#: Places of rows that may be broadcast; rows of the files are moved for more only.
FEW = 100_000


def _streamed_sha256(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file of any size, read through Spark's file systems in pieces of a few kilobytes by the driver's JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, length, sha256) of every file at path that is not empty. Files of up to `whole` bytes are hashed by tasks, one
    held at a time; larger ones one after another in pieces, since a SHA-256 has no parts that tasks could share."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole).select("path", "length").collect()
    if not large:
        return small
    return small.unionByName(spark.createDataFrame([(f.path, f.length, _streamed_sha256(spark, f.path)) for f in large], "path string, length long, sha256 string"))


def fetch(spark: SparkSession, path: str, wanted: DataFrame, key: str, spans: int = 64) -> DataFrame:
    """Rows of Parquet files whose key, a whole number, is in wanted(key), reading only the row groups that may hold one.

    The wanted keys are summed up as at most `spans` ranges, which go to the reader as a filter: by the files' statistics it
    skips files, row groups and pages between the ranges, as many as the key's order in the files allows. A join then takes
    the rows that are wanted."""
    keys = wanted.select(F.col(key).cast("long").alias("k")).filter("k is not null")
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    files = spark.read.parquet(path)
    if low is None:
        return files.limit(0)
    slot = F.floor((F.col("k") - F.lit(low)) * F.lit(float(spans)) / F.lit(float(high - low + 1)))
    ranges = sorted(tuple(r) for r in keys.groupBy(slot.alias("slot")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).select("lo", "hi").collect())
    may = F.lit(False)
    for lo, hi in ranges:
        may = may | (F.col(key) == lo if lo == hi else F.col(key).between(lo, hi))
    return files.filter(may).join(wanted.select(F.col(key)).distinct(), key, "left_semi")


def fetch_rows(spark: SparkSession, path: str, wanted: DataFrame, row_index: str = "row_index") -> DataFrame:
    """Rows of Parquet files at wanted(row_index) places, as with_row_index() numbers them, with that column. Only files that
    hold a wanted row are read; which ones, the files' own row counts say."""
    files = spark.read.parquet(path)
    counts = files.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__file", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    at = wanted.select(F.col(row_index).cast("long").alias(row_index)).distinct().join(
        F.broadcast(starts), (F.col(row_index) >= F.col("__start")) & (F.col(row_index) < F.col("__start") + F.col("__n")))
    at = cut(at.select(row_index, "__file", (F.col(row_index) - F.col("__start")).alias("__at")))
    some = [r[0] for r in at.select("__file").distinct().collect()]
    few = F.broadcast(at) if at.count() <= FEW else at
    if not some:
        return files.limit(0).withColumn(row_index, F.lit(None).cast("long"))
    placed = spark.read.schema(files.schema).parquet(*some).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    return placed.join(few, ["__file", "__at"]).select(*files.columns, row_index)


def dataset_hash(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file; of several files a hash of their number and of sums over their hashes, the same in any order."""
    parts = [F.sum(F.conv(F.substring("sha256", 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    summed = F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256)
    got = file_hashes(spark, path).agg(F.count("*").alias("n"), F.min("sha256").alias("one"), summed.alias("all")).first()
    if not got.n:
        raise ValueError(f"no files at {path}")
    return got.one if got.n == 1 else got["all"]


def with_row_index(spark: SparkSession, path: str, name: str = "row_index") -> DataFrame:
    """Rows of Parquet files with their place, from 0, in the files put one after another by path. Only numbers of rows,
    one per file, are ranked together; no row is moved."""
    files = spark.read.parquet(path)
    if name in files.columns:
        raise ValueError(f"the files have a column {name}")
    rows = files.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = files.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__file").select(*files.columns, (F.col("__start") + F.col("__at")).alias(name))


def alignment(table: DataFrame, path: str, columns: list[str], n: int = 50, seed: int | str = 1, row_index: str = "row_index") -> DataFrame:
    """n rows of an indexed table, by hash of their index, beside a new reading of the same places of the file:
    (row_index, <c>, <c>_again, same). The new reading sends on only rows at these places, and no row but them is moved."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_index).cast("string")).cast("binary"))
    sample = cut(table.select(row_index, *columns).orderBy(order, row_index).limit(n))
    again = fetch_rows(table.sparkSession, path, sample, row_index).select(row_index, *[F.col(c).alias(f"{c}_again") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_again"))
    return sample.join(again, row_index, "left").withColumn("same", same)


def check_alignment(table: DataFrame, path: str, columns: list[str], n: int = 50, seed: int | str = 1, row_index: str = "row_index") -> None:
    """Raises, naming the place, if a sampled row differs from the file."""
    wrong = alignment(table, path, columns, n, seed, row_index).filter("not same").first()
    if wrong is not None:
        raise ValueError(f"the table does not match its file at row {wrong[row_index]}: {wrong.asDict()}")
