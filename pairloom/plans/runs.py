"""Runs: scoring a table of examples into a folder, resumable, with its metrics and circumstances."""

from __future__ import annotations

import os
import platform
import string
import subprocess
import sys
import time
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime, timezone

import pandas
import pyarrow
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import metrics
from pairloom.operators.examples import ExampleSource, balanced_limit, manifest, remaining
from pairloom.operators.examples import examples as examples_of
from pairloom.operators.lineage import cut
from pairloom.operators.scoring import Prompt, Scorer, render, score
from pairloom.plans.config import Config
from pairloom.plans.peaks import Peaks
from pairloom.sources.checkpoints import Run
from pairloom.sources.files import dataset_hash


#: What a run's name may hold besides letters and digits, and the time it begins with.
MARKS, STAMP = "._-", "%Y%m%dT%H%M%SZ"
_PLAIN = frozenset(string.ascii_letters + string.digits)


def check_run_id(value: str) -> str:
    """value, if a folder of results may be called so: letters, digits and MARKS, no mark first."""
    odd = "".join(sorted(set(value) - _PLAIN - set(MARKS)))
    if odd or value[:1] not in _PLAIN:
        raise ValueError(f"{value!r} cannot name a run: " + (f"it holds {odd!r}" if odd else "it begins with no letter or digit"))
    return value


def new_run_id(*of: str, now: datetime | None = None) -> str:
    """A name from the time and what the run is of."""
    moment = now or datetime.now(timezone.utc)
    return check_run_id("_".join((moment.strftime(STAMP), *of)))


def revision(folder: str = ".") -> dict | None:
    """Commit of the code in a folder and whether files have been changed since; None where git does not know."""
    def said(*what: str) -> str | None:
        try:
            got = subprocess.run(["git", "-C", folder, *what], capture_output=True, text=True, timeout=20)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return got.stdout.strip() if got.returncode == 0 else None

    commit = said("rev-parse", "HEAD")
    return None if not commit else {"commit": commit, "changed": bool(said("status", "--porcelain"))}


def machines(spark: SparkSession) -> dict:
    """Cores and memory of the driver's machine, and cores, memory for storage and execution, and number of executors."""
    known = spark._jsc.sc().statusStore().executorList(True)
    each = [known.apply(i) for i in range(known.size())]
    pages = os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") if hasattr(os, "sysconf") else None
    return {"driver_cores": os.cpu_count(), "driver_memory_bytes": pages, "executors": sum(e.id() != "driver" for e in each) or 1,
            "executor_cores": sum(e.totalCores() for e in each), "executor_memory_bytes": sum(e.maxMemory() for e in each)}


def circumstances(spark: SparkSession) -> dict:
    """Versions, parallelism, machines and code of a run."""
    return {"python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__,
            "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            "machines": machines(spark), "code": revision(os.path.dirname(os.path.abspath(__file__)))}


def dataset_facts(spark: SparkSession, name: str, path: str, examples: DataFrame) -> dict:
    """Name, path, hash, version and rows of a dataset; both labels must occur."""
    counts = manifest(examples).first()
    if not counts.matches or not counts.non_matches:
        raise ValueError(f"{name} needs rows of both labels, has {counts.matches} and {counts.non_matches}")
    digest = dataset_hash(spark, path)
    return {"name": name, "path": path, "sha256": digest, "version": f"sha256:{digest[:12]}", **counts.asDict()}


def _finish(run: Run, resumed: DataFrame, seconds: float, began: float, prompt: Prompt, model: str, limit: int | None, facts: dict | None, peaks: dict) -> dict:
    """Metrics of all that is kept, rates of what this session has added, written with the final results."""
    done = run.done()
    # fixed values: the keys of a result
    found = metrics.full_metrics(done, seconds, done.join(resumed.select("example_id"), "example_id", "left_anti"))
    result = {**(facts or {}), "model": model, "prompt": prompt.settings, "software": circumstances(run.spark), "completed_at": datetime.now(timezone.utc).isoformat(),
              "resumed_examples": resumed.count(), "partial_run": limit is not None, "leaderboard_eligible": limit is None, "inference_seconds": seconds,
              "total_seconds": time.time() - began, "peaks": peaks, "metrics": found}
    run.complete(found, result)
    return result


def _kept(run: Run, results: DataFrame, part: int) -> int:
    """Append a part and return its rows, which the write itself counts."""
    seen = Observation()
    run.append(results.observe(seen, F.count("*").alias("n")), part)
    return int(seen.get["n"])


def evaluate(examples: DataFrame, prompt: Prompt, make: Callable[[], Scorer], model: str, path: str, settings: dict, *, limit: int | None = None, batch: int = 16,
             step: int | None = None, facts: dict | None = None, report: Callable[[int, int], None] | None = None) -> dict:
    """Score examples into the run folder at path and return its result.

    What an interrupted run with the same settings has scored is kept. With `step` the rest is scored in ranges of so many row
    numbers, each kept as it ends; report(done, expected) follows each, from a count that the write itself makes. A run with a
    limit (balanced) is partial and not eligible for a leaderboard. A failure marks the run interrupted and is raised. Rates
    are those of the rows that this call has scored."""
    began = time.time()
    spark = examples.sparkSession
    if batch < 1:
        raise ValueError("batch must be 1 or more")
    run = Run(spark, path, settings)
    try:
        with Peaks(spark) as peaks:
            if limit is not None:
                examples = balanced_limit(examples, limit)
            examples = cut(examples)
            expected = examples.count()
            resumed = cut(run.done())
            have = resumed.count()
            left = cut(remaining(examples, resumed))
            first, last = left.agg(F.min("row_index"), F.max("row_index")).first()
            asked = time.time()
            if first is not None:
                width = step or last + 1 - first
                for low in range(first, last + 1, width):
                    some = left.filter(F.col("row_index").between(low, low + width - 1))
                    have += _kept(run, score(render(some, prompt), make, model, prompt, batch), low)
                    if report is not None:
                        report(have, expected)
            seconds = time.time() - asked
        return _finish(run, resumed, seconds, began, prompt, model, limit, facts, peaks.found())
    except BaseException as e:
        run.interrupt(f"{type(e).__name__}: {e}")
        raise


def evaluate_stream(spark: SparkSession, folder: str, schema, source: ExampleSource, row_index: str, prompt: Prompt, make: Callable[[], Scorer], model: str, path: str, settings: dict,
                    *, batch: int = 16, files: int = 1, facts: dict | None = None, report: Callable[[int], None] | None = None) -> dict:
    """evaluate() over a folder of pair files, `files` of them at a time, each batch kept as it ends.

    The stream's own checkpoint lies in the run folder and says which files are read; a batch is kept under its number, so
    one that is run again after a failure between its result and its checkpoint asks nothing twice. The same guards hold as
    for other runs; at the end all rows of the folder must have been scored. report(rows so far) follows each batch."""
    began = time.time()
    run = Run(spark, path, settings)
    try:
        with Peaks(spark) as peaks:
            resumed = cut(run.done())
            have = [resumed.count()]

            def keep(rows: DataFrame, number: int) -> None:
                if run.has(number):
                    return
                have[0] += _kept(run, score(render(examples_of(rows, source, row_index), prompt), make, model, prompt, batch), number)
                if report is not None:
                    report(have[0])

            asked = time.time()
            arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
            arrived.writeStream.foreachBatch(keep).option("checkpointLocation", f"{run.path}/stream").trigger(availableNow=True).start().awaitTermination()
            seconds = time.time() - asked
            every = examples_of(spark.read.schema(schema).parquet(folder), source, row_index)
            if not (left := remaining(every, run.done())).isEmpty():
                raise ValueError(f"row {left.first().row_index} of the folder was not scored")
        return _finish(run, resumed, seconds, began, prompt, model, None, facts, peaks.found())
    except BaseException as e:
        run.interrupt(f"{type(e).__name__}: {e}")
        raise


def run_configured(spark: SparkSession, config: Config, model: str, dataset: str, prompt: str = "baseline", *, limit: int | None = None, run_id: str | None = None,
                   root: str | None = None, batch: int | None = None, step: int | None = None, report: Callable[[int, int], None] | None = None) -> dict:
    """A run by the names of its model, dataset and prompt; give the id of an interrupted run to go on with it. A run goes on
    only with the same data, wherever they lie, columns, prompt and shown fields, model and generation settings."""
    run_id = check_run_id(run_id) if run_id is not None else new_run_id(model, dataset, prompt)
    make, asked, source, rows = config.scorer(model), config.prompt(prompt), config.source(dataset), config.examples(spark, dataset)
    data = dataset_facts(spark, dataset, config.path(config.named("datasets", dataset)["path"]), rows)
    batch = batch or int(config.values["benchmark"].get("evaluator_batch_size", 16))
    settings = {"model": config.named("models", model), "dataset": {k: v for k, v in data.items() if k != "path"}, "columns": asdict(source), "prompt": asked.settings,
                "generation": config.values["generation"], "limit": limit, "batch": batch, "seed": config.values["benchmark"].get("seed")}
    path = f"{root or config.path(config.values['benchmark']['result_root'])}/{run_id}"
    return evaluate(rows, asked, make, model, path, settings, limit=limit, batch=batch, step=step, facts={"run_id": run_id, "dataset": data}, report=report)
