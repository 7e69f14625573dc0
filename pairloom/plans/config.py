"""Datasets, prompts, models, adapters and generation settings as data, looked up by name."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.operators.examples import ExampleSource, examples
from pairloom.operators.scoring import SCORERS, ChatScorer, Prompt, Scorer
from pairloom.sources.files import with_row_index

#: The sections of a configuration, and what an adapter adds to a chat request.
SECTIONS = ("benchmark", "datasets", "prompts", "models", "adapters", "generation")
CHAT_ADAPTERS: dict[str, dict] = {"llama_cpp": {}, "qwen3_llama_cpp": {"chat_template_kwargs": {"enable_thinking": False}}}


def _parsed(text: str) -> object:
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


class Config:
    """Settings in six sections; relative paths are below `base`."""

    def __init__(self, values: object, base: str = "."):
        if not isinstance(values, dict):
            raise ValueError("a configuration is a mapping")
        for section in SECTIONS:
            if not isinstance(values.get(section), dict):
                raise ValueError(f"the configuration has no mapping {section}")
        self.values, self.base = values, base.rstrip("/")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        """From a YAML file (JSON where no YAML reader is installed) on any file system of Spark's; paths are relative to its folder."""
        text = spark.read.text(path, wholetext=True).first()
        return cls(_parsed(text[0]) if text else None, path.rpartition("/")[0] or ".")

    def named(self, section: str, name: str) -> dict:
        """An entry of a section; the error for an unknown one names those there are."""
        found = self.values[section]
        if name not in found:
            raise ValueError(f"{section} has no {name!r}, only: {', '.join(sorted(found)) or 'nothing'}")
        if not isinstance(found[name], dict):
            raise ValueError(f"{name!r} in {section} is not a mapping")
        return dict(found[name])

    def path(self, value: str) -> str:
        return value if re.match(r"/|[A-Za-z][A-Za-z0-9+.-]*:", value) else f"{self.base}/{value}"

    def prompt(self, name: str) -> Prompt:
        p = self.named("prompts", name)
        return Prompt(name, str(p["version"]), str(p["template"]), tuple(map(str, p["exposed_fields"])))

    def source(self, name: str) -> ExampleSource:
        d = self.named("datasets", name)
        if (kind := d.get("example_id", "generated_row_index")) != "generated_row_index":
            raise ValueError(f"examples cannot be named by {kind!r}")
        return ExampleSource(d["label_column"], d["record_a_columns"], d["record_b_columns"], d.get("metadata_columns") or {}, int(d.get("positive_label", 1)))

    def examples(self, spark: SparkSession, name: str) -> DataFrame:
        """The examples of a dataset, indexed by their place in its file."""
        source = self.source(name)
        index = "__row"
        rows = with_row_index(spark, self.path(self.named("datasets", name)["path"]), index)
        return examples(rows, source, index)

    def scorer(self, model: str) -> Callable[[], Scorer]:
        """What makes the scorer of a model: one of the registered ones, or a chat server at the adapter's address."""
        kind = self.named("models", model)["adapter"]
        if kind in SCORERS:
            return SCORERS[kind]
        if kind not in CHAT_ADAPTERS:
            raise ValueError(f"no adapter {kind!r}, only: {', '.join(sorted([*SCORERS, *CHAT_ADAPTERS]))}")
        a = self.named("adapters", kind)
        return functools.partial(ChatScorer, f"http://{a['host']}:{a['port']}", model, dict(self.values["generation"]), int(a.get("parallel_slots", 1)),
                                 float(a.get("request_timeout_sec", 180)), CHAT_ADAPTERS[kind])
