"""Runs that are broken off, moved, resumed with other settings, streamed and measured."""

import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators import examples as X
from pairloom.operators import metrics, scoring
from pairloom.plans.config import Config
from pairloom.plans.peaks import Peaks
from pairloom.plans.runs import evaluate, evaluate_stream, run_configured
from pairloom.sources.checkpoints import Run, read_results

from test_runs import settings

PROMPT = scoring.Prompt("p", "1", "{record_a} {record_b}", ("names",))
SOURCE = X.ExampleSource("label", {"names": "names"}, {"names": "names"}, {})
SCHEMA = "row_index long, label long, names string"


def maker(folder, word=None):
    """A scorer that notes what it is asked in a file of the folder; it fails at a word if one is given."""
    folder = str(folder)

    class Log(scoring.HashScorer):
        def generate_batch(self, prompts):
            for p in prompts:
                if word and word in p:
                    raise RuntimeError("the model went away")
                with open(f"{folder}/asked", "a") as f:
                    f.write(p + "\n")
            return scoring.HashScorer.generate_batch(self, prompts)

    return Log


def manifest(spark, path):
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def rows(n, start=0):
    return [(k, k % 2, f"w{k:03d}w") for k in range(start, start + n)]


@pytest.fixture()
def config(spark, tmp_path):
    table = [(1 - k % 2, "A" * k, "B" * k, str(k)) for k in range(10)]
    spark.createDataFrame(table, "label long, names string, base_names string, id string").repartition(3, "id").write.parquet(str(tmp_path / "pairs"))
    return Config(settings(), str(tmp_path))


def begun(spark, config, run_id, **more):
    """A run of which the first rows are kept, as a broken-off session leaves it."""
    stop = []

    def report(done, of):
        stop.append(done)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run_configured(spark, config, "dry", "pairs", run_id=run_id, step=4, report=report, **more)
    assert stop == [4]


def test_other_fields_or_columns_are_refused(spark, config, tmp_path):
    begun(spark, config, "r")
    kept = manifest(spark, f"{tmp_path}/runs/r")
    assert kept["status"] == "interrupted" and kept["reason"].startswith("KeyboardInterrupt") and kept["settings"]["prompt"]["fields"] == ["names"]
    other = settings()
    other["prompts"]["baseline"]["exposed_fields"] = ["names", "phones"]
    with pytest.raises(ValueError, match="other settings"):
        run_configured(spark, Config(other, str(tmp_path)), "dry", "pairs", run_id="r")
    other = settings()
    other["datasets"]["pairs"]["record_b_columns"] = {"names": "names"}
    with pytest.raises(ValueError, match="other settings"):
        run_configured(spark, Config(other, str(tmp_path)), "dry", "pairs", run_id="r")
    got = run_configured(spark, config, "dry", "pairs", run_id="r")
    assert got["resumed_examples"] == 4 and got["metrics"]["total_examples"] == 10


def test_a_moved_dataset_goes_on(spark, config, tmp_path):
    begun(spark, config, "r")
    (tmp_path / "pairs").rename(tmp_path / "elsewhere")
    moved = settings()
    moved["datasets"]["pairs"]["path"] = "elsewhere"
    assert run_configured(spark, Config(moved, str(tmp_path)), "dry", "pairs", run_id="r")["resumed_examples"] == 4


def test_rates_are_those_of_the_rows_scored_now(spark, config, tmp_path):
    begun(spark, config, "r")
    got = run_configured(spark, config, "dry", "pairs", run_id="r")
    assert got["metrics"]["examples_per_second"] == pytest.approx(6 / got["inference_seconds"])
    done = read_results(spark, f"{tmp_path}/runs/r/results")
    new = done.filter("row_index >= 4").agg(F.sum(F.col("input_tokens") + F.col("output_tokens"))).first()[0]
    assert got["metrics"]["tokens_per_second"] == pytest.approx(new / got["inference_seconds"]) and got["metrics"]["total_tokens"] > new
    assert got["peaks"]["DriverHeap"]["peak_bytes"] > 0 and manifest(spark, f"{tmp_path}/runs/r")["settings"]["limit"] is None
    with pytest.raises(ValueError, match="no examples"):
        metrics.full_metrics(done.limit(0), 1.0)


def test_reports_cost_no_job(spark, tmp_path):
    e = X.examples(spark.createDataFrame(rows(12), SCHEMA), SOURCE, "row_index")
    counts = []
    for name, report in (("silent", None), ("told", lambda done, of: counts.append((done, of)))):
        spark.sparkContext.setJobGroup(name, name)
        evaluate(e, PROMPT, scoring.HashScorer, "m", f"{tmp_path}/{name}", {}, step=3, report=report)
    track = spark.sparkContext.statusTracker()
    assert counts == [(3, 12), (6, 12), (9, 12), (12, 12)] and len(track.getJobIdsForGroup("told")) == len(track.getJobIdsForGroup("silent"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_kept_row_is_asked_twice(spark, tmp_path):
    e = X.examples(spark.createDataFrame(rows(20), SCHEMA).coalesce(1), SOURCE, "row_index")
    with pytest.raises(Exception, match="went away"):
        evaluate(e, PROMPT, maker(tmp_path, "w012w"), "m", f"{tmp_path}/run", {}, batch=1, step=4)
    assert evaluate(e, PROMPT, maker(tmp_path), "m", f"{tmp_path}/run", {}, step=7)["resumed_examples"] == 12
    asked = (tmp_path / "asked").read_text().splitlines()
    failed = [f"w{k:03d}w" for k in (12, 13, 14, 15)]  # of the part that was not kept, other tasks may have asked
    once = [p for p in asked if not any(w in p for w in failed)]
    assert sorted(once) == sorted(set(once)) and len(set(asked)) == 20
    assert read_results(spark, f"{tmp_path}/run/results").count() == 20


def test_a_part_is_kept_once(spark, tmp_path):
    e = X.examples(spark.createDataFrame(rows(4), SCHEMA), SOURCE, "row_index")
    run = Run(spark, f"{tmp_path}/run", {})
    scored = scoring.score(scoring.render(e, PROMPT), scoring.HashScorer, "m", PROMPT)
    for part in (7, 7):
        run.append(scored, part)
    assert spark.read.json(f"{tmp_path}/run/checkpoint").count() == 4 and run.has(7) and not run.has(8)
    run.append(scored.filter("row_index = 0"))
    assert run.has(8) and run.done().count() == 4


def test_streamed_run(spark, tmp_path):
    """Files arrive, a session breaks off, the next goes on with the file that failed, and the guards hold."""
    folder, path = f"{tmp_path}/in", f"{tmp_path}/run"
    for k in range(3):
        spark.createDataFrame(rows(5, 5 * k), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    seen = []
    go = lambda word=None, s=None: evaluate_stream(spark, folder, SCHEMA, SOURCE, "row_index", PROMPT, maker(tmp_path, word), "m", path, s or {"a": 1}, report=seen.append)
    with pytest.raises(Exception, match="went away"):
        go("w007w")
    assert manifest(spark, path)["status"] == "interrupted" and seen == [5]
    with pytest.raises(ValueError, match="other settings"):
        go(s={"a": 2})
    got = go()
    assert seen == [5, 10, 15] and got["resumed_examples"] == 5 and got["metrics"]["total_examples"] == 15
    asked = (tmp_path / "asked").read_text().splitlines()
    assert all(asked.count(p) == 1 for p in asked if "w005w" not in p and "w006w" not in p), asked
    assert [r.row_index for r in read_results(spark, f"{path}/results").orderBy("row_index").collect()] == list(range(15))
    with pytest.raises(ValueError, match="complete"):
        go()


def test_a_batch_that_was_kept_is_not_asked_again(spark, tmp_path):
    """A session dies after a batch's result and before the stream's own mark of it."""
    import shutil

    folder, path = f"{tmp_path}/in", f"{tmp_path}/run"
    spark.createDataFrame(rows(5), SCHEMA).coalesce(1).write.parquet(folder)
    with pytest.raises(Exception, match="stop here"):
        evaluate_stream(spark, folder, SCHEMA, SOURCE, "row_index", PROMPT, maker(tmp_path), "m", path, {}, report=lambda n: (_ for _ in ()).throw(RuntimeError("stop here")))
    shutil.rmtree(f"{path}/stream/commits", ignore_errors=True)
    got = evaluate_stream(spark, folder, SCHEMA, SOURCE, "row_index", PROMPT, maker(tmp_path), "m", path, {})
    assert got["metrics"]["total_examples"] == 5 and len((tmp_path / "asked").read_text().splitlines()) == 5


def test_peaks(spark):
    with Peaks(spark, 0.05) as p:
        spark.range(200_000).selectExpr("sum(id * id)").collect()
    assert set(p.found()) >= {"DriverHeap", "JVMHeapMemory"} and all(v["delta_bytes"] >= 0 for v in p.found().values())


def test_circumstances_of_a_run(spark, tmp_path):
    from pairloom.plans.runs import circumstances, revision

    found = circumstances(spark)
    assert found["machines"]["driver_cores"] > 0 and found["machines"]["executor_cores"] >= 4 and found["machines"]["executors"] == 1
    assert revision(str(tmp_path)) is None
    assert found["code"] is None or len(found["code"]["commit"]) == 40
    json.dumps(found)
