"""Scoring pair files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.operators.examples import ExampleSource, examples
from pairloom.operators.scoring import BASELINE, Prompt, Scorer, render, score


def score_stream(spark: SparkSession, path: str, schema, source: ExampleSource, row_index: str, make: Callable[[], Scorer], model: str, out: str, checkpoint: str, prompt: Prompt = BASELINE, files: int = 1) -> None:
    """Score all files of a folder that no earlier call has scored, `files` at a time, and return when none is left: a resumed
    call goes on after the last file that was finished."""
    arrived: DataFrame = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    results = score(render(examples(arrived, source, row_index), prompt), make, model, prompt)
    query = results.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
