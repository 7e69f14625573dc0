"""Runs on disk: result lines, manifest, and the guards of a resumed run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a result line.
RESULTS = ("example_id string, ground_truth string, prediction string, raw_model_output string, valid_prediction boolean, latency_seconds double, "
           "input_tokens long, output_tokens long, request_error string, model string, prompt_name string, prompt_version string, row_index long")

COLUMNS = [c.split()[0] for c in RESULTS.split(", ")]


def fingerprint(value: dict) -> str:
    """A mark of settings that does not depend on their order."""

    def lines(at: str, v):
        if isinstance(v, dict):
            for k in sorted(v, key=str):
                yield from lines(f"{at}/{k}", v[k])
        else:
            yield f"{at}={v!r}"

    return hashlib.blake2b("\n".join(lines("", value)).encode(), digest_size=16).hexdigest()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(RESULTS).option("mode", "FAILFAST").json(path)


class Run:
    """A folder with checkpoint/, results/ and manifest/, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path, self.mark = spark, path.rstrip("/"), fingerprint(settings)
        self._fs = spark._jvm.org.apache.hadoop.fs
        old = self._read()
        if old is None and self._has("results"):
            raise ValueError("the folder has final results but no manifest")
        if old is not None and old["status"] == "running" and self._has("results"):
            raise ValueError("the folder has final results beside a running manifest")
        if old is not None and old["fingerprint"] != self.mark:
            raise ValueError("the run was begun with other settings")
        if old is not None and old["status"] == "complete":
            raise ValueError("the run is complete")
        self.settings = settings
        self._state("running")

    def _path(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _has(self, name: str) -> bool:
        p = self._path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self) -> dict | None:
        for name in ("manifest", "manifest.new"):  # the second only if a change was broken off
            if self._has(name):
                return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0])
        return None

    def _state(self, status: str, **more) -> None:
        """Put a new manifest in place: settings and status always, a reason or results where there are any."""
        value = json.dumps({"fingerprint": self.mark, "status": status, "settings": self.settings, **more}, default=str)
        self.spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest.new")
        new, old = self._path("manifest.new"), self._path("manifest")
        fs = new.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)

    def done(self) -> DataFrame:
        """Rows scored so far; of a repeated example the smallest."""
        if not self._has("checkpoint"):
            return self.spark.createDataFrame([], RESULTS)
        rows = read_results(self.spark, f"{self.path}/checkpoint").select(*COLUMNS)
        return rows.groupBy("example_id").agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")

    def has(self, part: int) -> bool:
        """Whether a part has been kept whole."""
        return self._has(f"checkpoint/part={part}/_SUCCESS")

    def append(self, results: DataFrame, part: int | None = None) -> None:
        """Keep a part of the results, in place of what a broken-off call has left of it; a new part unless its number is
        given."""
        if part is None:
            found = self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(self._path("checkpoint/part=*"))
            part = 1 + max((int(f.getPath().getName().partition("=")[2]) for f in found or []), default=-1)
        results.select(*COLUMNS).write.mode("overwrite").json(f"{self.path}/checkpoint/part={part}")

    def interrupt(self, reason: str) -> None:
        self._state("interrupted", reason=reason)

    def complete(self, metrics: dict, result: dict | None = None) -> None:
        self.done().orderBy("row_index").write.mode("overwrite").json(f"{self.path}/results")
        self._state("complete", metrics=metrics, result=result or {})
