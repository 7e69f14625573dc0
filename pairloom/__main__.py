"""Commands: python -m pairloom naive | geo | preview | view | run.

Every command is a call of the library's functions with the same defaults; tables are paths that Spark reads.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import matching, pairs, review
from pairloom.plans import config, runs
from pairloom.sources import files, places


def _source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The place table with its row numbers, and what pair building needs of it."""
    rows = files.with_row_index(spark, path, "rid")
    return rows, places.normalise_places(rows, payload=False)


def _settings(given: argparse.Namespace) -> pairs.Settings:
    return pairs.Settings(**{f.name: getattr(given, f.name) for f in fields(pairs.Settings) if getattr(given, f.name, None) is not None})


def _sizes(given: argparse.Namespace) -> dict[str, int]:
    return matching.SIZES if given.size == "all" else {given.size: matching.SIZES[given.size]}


def naive(spark: SparkSession, given: argparse.Namespace) -> None:
    rows, _ = _source(spark, given.source)
    for name, n in _sizes(given).items():
        drawn = pairs.naive_pairs(rows.select("rid", "id"), n, given.seed + matching.SEED_STEP[name])
        pairs.write_naive(drawn, rows, f"{given.out}/{name}", n)
        print(f"{name}: {n} pairs in {given.out}/{name}")


def geo(spark: SparkSession, given: argparse.Namespace) -> None:
    rows, normal = _source(spark, given.source)
    pools = pairs.build_pools(normal, _settings(given))
    for name, table in pairs.all_sizes(pools, _sizes(given)).items():
        print(name, pairs.write_pairs(table, normal, f"{given.out}/{name}", matching.SIZES[name], pools.settings, source=rows))


def preview(spark: SparkSession, given: argparse.Namespace) -> None:
    """Cards of candidate pairs that no table holds yet."""
    rows, normal = _source(spark, given.source)
    pools = pairs.build_pools(normal, _settings(given))
    pool = pools.geo if given.kind == "geo" else pools.brand
    some = pairs.numbered(pool.withColumns({"pair_type": F.lit("hard_negative"), "hard_neg_source": F.lit(given.kind)}), given.seed).filter(F.col("pair_id") < given.n)
    print(review.shown(pairs.widen(some, rows), given.n, columns=given.columns))


def view(spark: SparkSession, given: argparse.Namespace) -> None:
    """Cards of a finished pair table."""
    wide = spark.read.parquet(given.file)
    chosen = pairs.review(wide, given.pair_type, given.neg_source) if given.pair_type or given.neg_source else wide
    print(review.shown(chosen, given.n, columns=given.columns, seed=given.shuffle))


def run(spark: SparkSession, given: argparse.Namespace) -> None:
    report = lambda done, of: print(f"{done} of {of} examples", flush=True)
    got = runs.run_configured(spark, config.Config.read(spark, given.config), given.model, given.dataset, given.prompt, limit=given.limit,
                              run_id=given.run_id, step=given.step, report=report)
    print(got["metrics"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m pairloom")
    commands = top.add_subparsers(required=True)
    defaults = pairs.Settings()

    def command(f, *needed: str) -> argparse.ArgumentParser:
        c = commands.add_parser(f.__name__, help=(f.__doc__ or "").strip() or None)
        c.set_defaults(call=f)
        for x in needed:
            c.add_argument(f"--{x}", required=True)
        return c

    def sized(c: argparse.ArgumentParser) -> None:
        c.add_argument("--size", choices=[*matching.SIZES, "all"], default="micro")
        c.add_argument("--seed", type=int, default=defaults.draw_seed)

    def distances(c: argparse.ArgumentParser) -> None:
        for f in fields(pairs.Settings):
            if f.name not in ("draw_seed", "pool_seed"):
                c.add_argument(f"--{f.name.replace('_', '-')}", type=float if isinstance(getattr(defaults, f.name), float) else int)

    sized(command(naive, "source", "out"))
    c = command(geo, "source", "out")
    sized(c)
    distances(c)
    c = command(preview, "source")
    c.add_argument("--kind", choices=["geo", "brand"], default="geo")
    c.add_argument("--seed", type=int, default=0)
    distances(c)
    v = command(view, "file")
    v.add_argument("--pair-type", choices=["match", "hard_negative", "easy_negative"])
    v.add_argument("--neg-source", choices=["geo", "brand"])
    v.add_argument("--shuffle", metavar="SEED")
    for x in (c, v):
        x.add_argument("-n", type=int, default=10)
        x.add_argument("--columns", nargs="*")
    c = command(run, "config", "model", "dataset")
    c.add_argument("--prompt", default="baseline")
    c.add_argument("--run-id")
    c.add_argument("--limit", type=int)
    c.add_argument("--step", type=int, default=100)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parser().parse_args(arguments)
    if getattr(given, "seed", None) is not None and given.call is geo:
        given.draw_seed = given.seed
    given.call(spark or SparkSession.builder.appName("pairloom").getOrCreate(), given)


if __name__ == "__main__":
    main(sys.argv[1:])
