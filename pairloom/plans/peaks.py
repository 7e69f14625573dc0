"""Peaks of memory while a run goes on, as Spark's executors report them."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession

#: What is kept of the executors' own figures.
GAUGES = ("JVMHeapMemory", "JVMOffHeapMemory", "OnHeapExecutionMemory", "OffHeapExecutionMemory", "ProcessTreePythonRSSMemory")


def gauges(spark: SparkSession) -> dict[str, int]:
    """The largest value of each gauge over all executors, in bytes, as reported up to now; and the driver's heap in use."""
    out = dict.fromkeys(GAUGES, 0)
    known = spark._jsc.sc().statusStore().executorList(True)
    for i in range(known.size()):
        peaks = known.apply(i).peakMemoryMetrics()
        if peaks.isDefined():
            for k in GAUGES:
                out[k] = max(out[k], int(peaks.get().getMetricValue(k)))
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    return out | {"DriverHeap": int(heap.totalMemory() - heap.freeMemory())}


class Peaks:
    """with Peaks(spark) as p: ...; p.found() gives peak and delta from the beginning of each gauge. The driver asks every
    `every` seconds for what executors have reported with their heartbeats, which costs no job."""

    def __init__(self, spark: SparkSession, every: float = 0.5):
        self.spark, self.every = spark, every
        self._over = threading.Event()
        self.base: dict[str, int] = {}
        self.peak: dict[str, int] = {}

    def _look(self) -> None:
        for k, v in gauges(self.spark).items():
            self.peak[k] = max(self.peak.get(k, 0), v)

    def _watch(self) -> None:
        while not self._over.wait(self.every):
            self._look()

    def __enter__(self) -> Peaks:
        self.base = gauges(self.spark)
        self.peak = dict(self.base)
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        self._look()

    def found(self) -> dict[str, dict[str, int]]:
        return {k: {"peak_bytes": v, "delta_bytes": v - self.base[k]} for k, v in self.peak.items()}
