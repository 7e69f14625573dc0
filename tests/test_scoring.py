import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.operators import examples as X
from pairloom.operators import metrics, scoring
from pairloom.sources.checkpoints import Run, read_results
from pairloom.streaming.scoring import score_stream

PAIRS = "row_index long, label long, names string, phones string, base_names string, base_phones string, id string"
ROWS = [(0, 1, '{"primary": "A"}', None, '{"primary": "AA"}', None, "a"), (1, 0, '{"primary": "B"}', '["2"]', '{"primary": "BB"}', None, "b"),
        (2, 1, '{"primary": "C"}', None, '{"primary": "CC"}', None, "c"), (3, 0, '{"primary": "D"}', None, '{"primary": "DD"}', None, "d")]
SOURCE = X.ExampleSource("label", {"names": "names", "phones": "phones"}, {"names": "base_names", "phones": "base_phones"}, {"source_record_id": "id"})
PROMPT = scoring.Prompt("p", "1", "{{x}} A: {record_a} B: {record_b}", ("names", "phones"))


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(ROWS, PAIRS)


def test_examples_and_prompts(table):
    got = scoring.render(X.balanced_limit(X.examples(table, SOURCE, "row_index"), 4), PROMPT).orderBy("row_index").collect()
    assert [r.example_id for r in got] == [f"row_{i:06d}" for i in range(4)]
    assert got[0].prompt == '{x} A: {"names": {"primary": "A"}, "phones": null} B: {"names": {"primary": "AA"}, "phones": null}'
    assert "source_record_id" not in got[0].prompt and [r.label for r in got] == ["MATCH", "NO_MATCH"] * 2


def test_fragments_of_records():
    """Byte for byte what a record serialises to: the value of a JSON text, other text without blanks, null for nothing."""
    show = lambda x: scoring.fragment(x, json.JSONDecoder())
    values = [None, float("nan"), "  ", "4155551234", " a ", '["é"]', 1.0, " NaN ", "1.0", '{"b": 1, "a": [2, null]}', "01", "\u00a0x", '"q" x', True, "true", "Infinity"]
    assert [show(x) for x in values] == ["null", "null", "null", "4155551234", '"a"', '["é"]', "1.0", "NaN", "1.0", '{"b": 1, "a": [2, null]}', '"01"', '"x"', '"\\"q\\" x"', "true", "true", "Infinity"]
    records = pa.array([{"b": "é", "a": 1, "m": [("en", "x")], "s": {"k": [1.5, None]}}, {"b": None, "a": None, "m": None, "s": None}],
                       pa.struct([("b", pa.string()), ("a", pa.int64()), ("m", pa.map_(pa.string(), pa.string())), ("s", pa.struct([("k", pa.list_(pa.float64()))]))]))
    assert scoring.record_texts(records, ("a", "b", "c", "m", "s")) == ['{"a": 1, "b": "é", "c": null, "m": [["en", "x"]], "s": {"k": [1.5, null]}}', '{"a": null, "b": null, "c": null, "m": null, "s": null}']
    assert scoring.record_texts(records, ()) == ["{}", "{}"]


@pytest.mark.parametrize("bad", [None, 2])
def test_bad_labels_raise(spark, bad):
    with pytest.raises(Exception, match="label must be 0 or 1"):
        spark.createDataFrame([(bad,)], "l long").select(X.label_name(F.col("l"))).collect()


def test_missing_columns_are_named(table):
    with pytest.raises(ValueError, match=r"\['id', 'names'\]"):
        SOURCE.check(table.drop("names", "id"))


def test_balanced_limit(table):
    e = X.examples(table, SOURCE, "row_index")
    assert sorted(r.row_index for r in X.balanced_limit(e, 3).collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="balanced"):
        X.balanced_limit(e, 9)
    with pytest.raises(ValueError, match="2 or more"):
        X.balanced_limit(e, 1)


def test_metrics(spark):
    rows = [("MATCH", "MATCH", 10, 2), ("MATCH", "NO_MATCH", 10, 2), ("NO_MATCH", "MATCH", 10, 2), ("NO_MATCH", "NO_MATCH", 10, 2)]
    schema = "ground_truth string, prediction string, input_tokens long, output_tokens long"
    df = spark.createDataFrame(rows, schema)
    c = metrics.confusion(df).first()
    assert (c.true_positives, c.true_negatives, c.false_positives, c.false_negatives) == (1, 1, 1, 1) and c.accuracy == c.precision == c.recall == c.f1 == 0.5
    assert metrics.tokens(df, 2.0).first().tokens_per_second == 24.0 and metrics.tokens(df, 0).first().tokens_per_second is None
    df = spark.createDataFrame([("MATCH", "INVALID", None, 1), ("NO_MATCH", "INVALID", 1, 1)], schema)
    c = metrics.confusion(df).first()
    assert (c.invalid_count, c.false_negatives, c.false_positives, c.f1) == (2, 1, 1, 0.0)
    assert metrics.tokens(df, 1.0).first().total_tokens is None


def test_retrying_scorer_reports_errors():
    tries = []

    def ask(p):
        tries.append(p)
        raise OSError("down")

    got = scoring.Retrying(ask, wait=0.0).generate_batch(["x"])[0]
    assert got.raw_output is None and "down" in got.error and len(tries) == 3


def test_run_resumes_and_completes(spark, table, tmp_path):
    e = X.examples(table, SOURCE, "row_index")
    run = Run(spark, str(tmp_path / "run"), {"p": 1})
    run.append(scoring.score(scoring.render(e.filter("row_index = 0"), PROMPT), scoring.HashScorer, "hash", PROMPT))
    run.interrupt("stop")
    with pytest.raises(ValueError, match="other settings"):
        Run(spark, run.path, {"p": 2})
    run = Run(spark, run.path, {"p": 1})
    left = X.remaining(e, run.done())
    assert left.count() == 3
    run.append(scoring.score(scoring.render(left, PROMPT), scoring.HashScorer, "hash", PROMPT))
    found = metrics.full_metrics(run.done(), 1.0)
    run.complete(found)
    assert found["total_examples"] == 4 and read_results(spark, f"{run.path}/results").count() == 4
    with pytest.raises(ValueError, match="complete"):
        Run(spark, run.path, {"p": 1})


def test_checkpoint_that_does_not_fit_raises(spark, table):
    e = X.examples(table, SOURCE, "row_index")
    done = spark.createDataFrame([(0, "row_000000", "NO_MATCH")], "row_index long, example_id string, ground_truth string")
    with pytest.raises(ValueError, match="does not fit"):
        X.remaining(e, done)
    done = spark.createDataFrame([(9, "row_000009", "MATCH")], "row_index long, example_id string, ground_truth string")
    with pytest.raises(ValueError, match="does not fit"):
        X.remaining(e, done)


def test_malformed_result_lines_fail(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"example_id": "a"}\n\n{"example_id": \n')
    with pytest.raises(Exception):  # noqa: B017
        read_results(spark, str(tmp_path / "r.json")).collect()


def test_stream_scores_new_files_once(spark, table, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    go = lambda: score_stream(spark, source, table.schema, SOURCE, "row_index", scoring.HashScorer, "hash", out, checkpoint, PROMPT)
    table.filter("row_index < 2").coalesce(1).write.mode("append").parquet(source)
    go()
    assert spark.read.json(out).count() == 2
    table.filter("row_index >= 2").coalesce(1).write.mode("append").parquet(source)
    go()
    go()
    assert sorted(r.example_id for r in spark.read.json(out).collect()) == [f"row_{i:06d}" for i in range(4)]
