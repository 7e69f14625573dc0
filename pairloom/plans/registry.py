"""Registered queries and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import core
from pairloom.operators import candidates as C
from pairloom.operators import examples as X
from pairloom.operators import matching as M
from pairloom.operators import metrics, pairs, review, scoring
from pairloom.operators.lineage import cut
from pairloom.operators.order import numbered_from_zero
from pairloom.plans import sql
from pairloom.sources import files
from pairloom.sources.places import normalise_places, read_tables, surrogate_places

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_places(surrogate_places(spark, sf_dir), payload=False)


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("rid_a", "rid_b", core.centimetres(F.col("distance_m")).alias("distance_cm"), *more)


@query(sql.PLACE_ROW_COUNTS)
def place_row_counts(spark, sf_dir):
    return surrogate_places(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))


@query(sql.PLACE_MIN_ROWS_GUARD)
def place_min_rows_guard(spark, sf_dir):
    counts = place_row_counts(spark, sf_dir)
    return counts.agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.count_if(F.col("n") < 2).alias("too_few"))


@query(sql.CLOSEST_PAIR_PER_PLACE)
def closest_pair_per_place(spark, sf_dir):
    return _shown(C.closest_pairs(places(spark, sf_dir)), "id")


@query(sql.GEO_HARD_CANDIDATES)
def geo_hard_candidates(spark, sf_dir):
    return _shown(C.near_pairs(places(spark, sf_dir)), "preferred")


@query(sql.GEO_HARD_CANDIDATES)
def geo_dense_cells(spark, sf_dir):
    """The distance join with every cell of more than 8 rows split."""
    return _shown(C.near_pairs(places(spark, sf_dir), leaf=8), "preferred")


@query(sql.GEO_CELL_CAPPED)
def geo_cell_capped(spark, sf_dir):
    return _shown(C.near_capped(places(spark, sf_dir), 5, pair_seed="cell"), "preferred", "band", "cx")


@query(sql.BRAND_HARD_CANDIDATES)
def brand_hard_candidates(spark, sf_dir):
    named = places(spark, sf_dir).drop("name_key").join(_names(spark, sf_dir), "id")
    return _shown(C.same_key_pairs(named, row_cap=None), "preferred")


def _names(spark, sf_dir):
    (part,) = read_tables(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), core.text_key(F.col("p_name")).alias("name_key"))


def _brand_pairs(spark, sf_dir):
    named = places(spark, sf_dir).drop("name_key").join(_names(spark, sf_dir), "id")
    return named, C.same_key_capped(named, 5, row_cap=500, seed="rows", pair_seed="group")


@query(sql.BRAND_GROUP_CAPPED)
def brand_group_capped(spark, sf_dir):
    return _shown(_brand_pairs(spark, sf_dir)[1], "preferred", "name_key")


@query(sql.NAME_BLOCKS_CAPPED)
def name_blocks_capped(spark, sf_dir):
    """Names of any number of rows, joined block by block, five pairs of each."""
    named = places(spark, sf_dir).drop("name_key").join(_names(spark, sf_dir), "id")
    return _shown(C.same_key_capped(named, 5, row_cap=None, pair_seed="group", block=32), "preferred", "name_key")


@query(sql.DENSEST_FIRST_CAP)
def densest_first_cap(spark, sf_dir):
    named, pool = _brand_pairs(spark, sf_dir)
    return _shown(C.densest_first(pool, named, ["name_key"], 40), "name_key")


@query(sql.BRAND_OR_NAME_KEY)
def brand_or_name_key(spark, sf_dir):
    (part,) = read_tables(spark, sf_dir, "part")
    brand = F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand"))
    return part.select("p_partkey", core.brand_or_name_key(brand, F.concat(F.lit(" "), "p_name", F.lit("\t"))).alias("name_key"))


@query(sql.LOCALITY_KEY)
def locality_key(spark, sf_dir):
    supplier, nation = read_tables(spark, sf_dir, "supplier", "nation")
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    address = F.struct(F.col("n_name").alias("locality"))
    listed = F.when(F.col("s_suppkey") % 4 == 0, F.expr("cast(array() as array<struct<locality:string>>)")).when(F.col("s_suppkey") % 4 == 1, F.lit(None)).otherwise(F.array(address))
    return joined.select("s_suppkey", core.text_key(core.first_item_field(listed, "locality")).alias("locality"))


@query(sql.WKB_POINT_DECODE)
def wkb_point_decode(spark, sf_dir):
    lon, lat = core.wkb_point(F.col("geometry"))
    points = surrogate_places(spark, sf_dir).select("rid", core.point_wkb(F.col("lon"), F.col("lat")).alias("geometry"))
    return points.select("rid", lon.alias("lon"), lat.alias("lat"))


@query(sql.NAIVE_PLACE_DRAW)
def naive_place_draw(spark, sf_dir):
    ids = place_row_counts(spark, sf_dir).select("id")
    return M.paired(ids, 100, "naive").select("pair", F.col("id_a").cast("long").alias("id_a"), F.col("id_b").cast("long").alias("id_b"))


@query(sql.NAIVE_PAIRS_WIDE)
def naive_pairs_wide(spark, sf_dir):
    raw = surrogate_places(spark, sf_dir)
    drawn = pairs.naive_pairs(raw, 100, "naive")
    return pairs.widen(drawn, raw.select("rid", "id", "name")).withColumn("label", F.col("label").cast("int"))


@query(sql.WIDEN_BY_PLACE)
def widen_by_place(spark, sf_dir):
    """Pairs of neighbouring places of a file, 40 by hash, widened by rows that are fetched by their place."""
    path = f"{sf_dir}/lineitem.parquet"
    rows = spark.read.parquet(path).count()
    drawn = spark.range(rows // 2).withColumnRenamed("id", "pair_id").orderBy(core.hash_order("fetch", F.col("pair_id")), "pair_id").limit(40)
    drawn = cut(drawn.select("pair_id", (F.col("pair_id") * 2).alias("left_rid"), (F.col("pair_id") * 2 + 1).alias("right_rid")))
    wanted = drawn.select(F.explode(F.array("left_rid", "right_rid")).alias("rid"))
    return pairs.widen(drawn, files.fetch_rows(spark, path, wanted, "rid").select("rid", "l_orderkey", "l_linenumber", "l_extendedprice"))


@query(sql.FETCH_BY_KEY)
def fetch_by_key(spark, sf_dir):
    """All lines of 50 orders by hash, by a filter on ranges of their keys that the reader prunes by, then a join."""
    (orders,) = read_tables(spark, sf_dir, "orders")
    wanted = cut(orders.orderBy(core.hash_order("fetch", F.col("o_orderkey")), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("l_orderkey")))
    return files.fetch(spark, f"{sf_dir}/lineitem.parquet", wanted, "l_orderkey").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(sql.PAIR_CARDS)
def pair_cards(spark, sf_dir):
    raw = surrogate_places(spark, sf_dir)
    wide = pairs.widen(pairs.naive_pairs(raw, 100, "naive"), raw.select("rid", "id", "name"))
    return review.cards(wide, 12, seed="cards")


@query(sql.PAIR_BUDGETS)
def pair_budgets(spark, sf_dir):
    """Budgets of tables with as many pairs as each brand has parts, and as all have."""
    (part,) = read_tables(spark, sf_dir, "part")
    sizes = part.rollup("p_brand").agg(F.count("*").alias("pairs"))
    return sizes.select(F.coalesce("p_brand", F.lit("all")).alias("brand_name"), "pairs", *[v.alias(k) for k, v in M.budget_columns(F.col("pairs")).items()])


@query(sql.MATCH_DRAW)
def match_draw(spark, sf_dir):
    return _shown(M.match_draw(C.closest_pairs(places(spark, sf_dir)), 100, "draw"), "id")


@query(sql.GREEDY_HARD_NEGATIVES)
def greedy_hard_negatives(spark, sf_dir):
    _, pool = _brand_pairs(spark, sf_dir)
    return _shown(M.greedy_matching(pool, 100, "greedy"), "id_a", "id_b", "preferred")


@query(sql.FAR_ROUND)
def easy_negative_round(spark, sf_dir):
    rows = places(spark, sf_dir)
    return _shown(M.far_round(rows, rows.select("id").distinct(), 200, 1_000.0, "far"), "id_a", "id_b", "preferred")


@query(sql.EASY_NEGATIVES)
def easy_negatives(spark, sf_dir):
    rows = places(spark, sf_dir)
    return _shown(M.easy_negatives(rows, rows.select("id").limit(0), 30, 1_000.0, "easy"), "id_a", "id_b", "preferred")


def place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with name keys, computed once."""
    return cut(places(spark, sf_dir).drop("name_key").join(_names(spark, sf_dir), "id"))


def tier(rows: DataFrame) -> int:
    """Pairs of the smallest tier, 60 where places are too few for it."""
    return M.SIZES["micro"] if rows.select("id").distinct().count() >= 2 * M.SIZES["micro"] else 60


def _table(spark, sf_dir):
    """A pair table of the smallest tier, from pools of the usual settings."""
    rows = place_rows(spark, sf_dir)
    n, s = tier(rows), pairs.Settings()
    return rows, pairs.geo_pairs(pairs.build_pools(rows, s), n), n, s


@query(sql.GEO_PAIRS)
def geo_pairs(spark, sf_dir):
    rows, table, _, _ = _table(spark, sf_dir)
    shown = table.withColumns({"distance_m": core.centimetres(F.col("distance_m")), "label": F.col("label").cast("int")}).withColumnRenamed("distance_m", "distance_cm")
    return pairs.widen(shown, rows.select("rid", "id", "category", "locality"))


@query(sql.GEO_PAIR_INVARIANTS)
def geo_pair_invariants(spark, sf_dir):
    rows, table, n, s = _table(spark, sf_dir)
    return pairs.invariants(table, rows, n, s)


@query(sql.GEO_PAIR_STATS)
def geo_pair_stats(spark, sf_dir):
    _, table, _, s = _table(spark, sf_dir)
    return pairs.stats(table, s)


@query(sql.PAIR_TYPE_BREAKDOWN)
def pair_type_breakdown(spark, sf_dir):
    return pairs.review(_table(spark, sf_dir)[1]).groupBy("pair_type").agg(F.count("*").alias("n"))


@query(sql.REVIEW_BRAND)
def review_brand(spark, sf_dir):
    """The hard negatives of a pair table that come from names."""
    return pairs.review(_table(spark, sf_dir)[1], source="brand").select("pair_id", "pair_type", "hard_neg_source", "left_rid", "right_rid")


@query(sql.ALIGNMENT_SPOTCHECK)
def alignment_spotcheck(spark, sf_dir):
    """Sampled rows of an indexed table against a second reading of the same places of its file."""
    path = f"{sf_dir}/lineitem.parquet"
    keys = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return files.alignment(files.with_row_index(spark, path).select("row_index", *keys), path, keys, 50, "spot")


LABELLED = X.ExampleSource("quality", {"names": "text", "lang": "lang"}, {"names": "source", "lang": "lang"}, {"doc_id": "doc_id"})


def _examples(spark, sf_dir):
    labels, docs = read_tables(spark, sf_dir, "labels", "documents")
    rows = labels.join(docs, "doc_id").select("doc_id", "quality", "text", "lang", "source")
    return X.examples(rows, LABELLED, "doc_id")


@query(sql.BALANCED_LIMIT)
def balanced_limit(spark, sf_dir):
    return X.balanced_limit(_examples(spark, sf_dir), 51, strict=False).select("row_index", "example_id", "label")


@query(sql.EXAMPLE_NORMALISE)
def example_normalise(spark, sf_dir):
    e = _examples(spark, sf_dir)
    return e.select("row_index", "example_id", "label", F.col("record_a.names").alias("a_names"), F.col("record_b.names").alias("b_names"), F.col("metadata.doc_id").alias("doc_id"))


@query(sql.DATASET_MANIFEST)
def dataset_manifest(spark, sf_dir):
    (labels,) = read_tables(spark, sf_dir, "labels")
    return X.manifest(labels.select(X.label_name(F.col("quality")).alias("label")))


#: Answers whose reading is given.
ANSWERS = ("MATCH", "match.", '"NO_MATCH"', "Answer: no match", "`NO-MATCH`", "Probably MATCH", "MATCH or NO_MATCH", '{"prediction":"MATCH"}', "YES", "", None, "NOMATCH", "NO  MATCH", "MATCH!.", " 'no_match' ", "answer :MATCH !")


@query(sql.LABEL_PARSE)
def label_parse(spark, sf_dir):
    (said,) = read_tables(spark, sf_dir, "conversations")
    given = spark.createDataFrame([(a,) for a in ANSWERS], "raw string")
    return given.union(said.select("text")).groupBy(core.parse_label(F.col("raw")).alias("prediction")).agg(F.count("*").alias("n"))


@query(sql.LABEL_PARSE_EACH)
def label_parse_each(spark, sf_dir):
    """One of the answers for every message, read in both ways; every fourth message answers in its own words."""
    (said,) = read_tables(spark, sf_dir, "conversations")
    at = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(ANSWERS)))
    given = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), at.cast("int") + 1)
    raw = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) == 3, F.col("text")).otherwise(given)
    return said.select("conv_id", "turn", core.parse_label(raw).alias("prediction"), core.parse_label(raw, True).alias("strict"))


@query(sql.CONFUSION_METRICS)
def confusion_metrics(spark, sf_dir):
    (labels,) = read_tables(spark, sf_dir, "labels")
    said = F.when(F.col("doc_id") % 11 == 0, "INVALID").otherwise(X.label_name(F.col("toxic")))
    return metrics.confusion(labels.select(X.label_name(F.col("quality")).alias("ground_truth"), said.alias("prediction")))


@query(sql.LATENCY_QUANTILES)
def latency_quantiles(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    timed = events.filter(F.col("value").isNotNull()).select(F.col("value").alias("latency_seconds"))
    return metrics.latencies(timed).select(*[F.round(c, 6).alias(c) for c in ("average_latency_seconds", "median_latency_seconds", "p95_latency_seconds")])


@query(sql.TOKEN_TOTALS)
def token_totals(spark, sf_dir):
    (said,) = read_tables(spark, sf_dir, "conversations")
    counted = said.select(F.length("text").cast("long").alias("input_tokens"), F.length("role").cast("long").alias("output_tokens"))
    return metrics.tokens(counted, 8.0)


@query(sql.prompt_render(scoring.BASELINE_TEMPLATE))
def prompt_render(spark, sf_dir):
    return scoring.render(_examples(spark, sf_dir), scoring.Prompt("p", "1", scoring.BASELINE_TEMPLATE, ("names", "lang", "phones"))).select("example_id", "prompt")


@query(sql.score_hash(scoring.BASELINE_TEMPLATE))
def score_hash(spark, sf_dir):
    prompt = scoring.Prompt("p", "1", scoring.BASELINE_TEMPLATE, ("names", "lang"))
    return scoring.score(scoring.render(_examples(spark, sf_dir), prompt), scoring.HashScorer, "hash", prompt)


@query(sql.RESUME_REMAINING)
def resume_remaining(spark, sf_dir):
    e = _examples(spark, sf_dir)
    done = e.orderBy("row_index").limit(20).select("row_index", "example_id", F.col("label").alias("ground_truth"))
    return X.remaining(e, done).select("row_index", "example_id", "label")


@query(sql.CONTENT_HASH)
def content_hash(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(sql.FLATTEN_PREVIEW)
def flatten_preview(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    first = docs.orderBy(core.hash_order("view", F.col("doc_id")), "doc_id").limit(20)
    return first.select("doc_id", core.shortened(F.col("text")).alias("line"))


@query(sql.NESTED_PREVIEW)
def nested_preview(spark, sf_dir):
    """Lists, structs and maps of order and part columns as one line each."""
    (part,) = read_tables(spark, sf_dir, "part")
    odd, third = F.col("p_partkey") % 2 == 1, F.col("p_partkey") % 3 == 0
    held = part.select(
        "p_partkey", F.struct(F.lit("").alias("common"), F.col("p_type").alias("other"), F.when(odd, F.col("p_name")).alias("primary")).alias("names"),
        F.when(third, F.array().cast("array<struct<region:string,freeform:string>>")).otherwise(F.array(F.struct(F.col("p_brand").alias("region"), F.col("p_type").alias("freeform")))).alias("addresses"),
        F.create_map(F.lit("size"), F.when(odd, F.lit("")).otherwise(F.col("p_brand")), F.lit("name"), F.col("p_name")).alias("tags"))
    line = lambda c, *keys: core.one_line(F.col(c), held.schema[c].dataType, keys, 12).alias(c)
    return held.select("p_partkey", line("names", "primary"), line("addresses", "freeform"), line("tags", "size"))


@query(sql.LARGEST_GROUPS)
def largest_places(spark, sf_dir):
    sizes = place_row_counts(spark, sf_dir).groupBy("n").agg(F.count("*").alias("places"))
    return numbered_from_zero(sizes, [F.desc("n")], "place_rank").withColumn("place_rank", (F.col("place_rank") + 1).cast("int"))
