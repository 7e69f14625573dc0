"""Configured runs, scorers behind an address, files and nested previews."""

import hashlib
import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from pairloom.functions.core import one_line
from pairloom.operators import examples as X
from pairloom.operators import scoring
from pairloom.plans.config import Config
from pairloom.plans.runs import check_run_id, evaluate, new_run_id, run_configured
from pairloom.sources import files
from pairloom.sources.checkpoints import read_results

GENERATION = {"temperature": 0.0, "top_p": 1.0, "max_tokens": 8, "seed": 42, "stop": ["\n"]}


#: The sections and keys of a configuration.
def settings(**more):
    return {"benchmark": {"result_root": "runs", "evaluator_batch_size": 2, "seed": 42},
            "datasets": {"pairs": {"path": "pairs", "label_column": "label", "record_a_columns": {"names": "names"}, "record_b_columns": {"names": "base_names"}, "metadata_columns": {"source_id": "id"}}},
            "prompts": {"baseline": {"version": 1, "exposed_fields": ["names"], "template": "{record_a} {record_b}"}},
            "models": {"dry": {"adapter": "hash"}, "plain": {"adapter": "llama_cpp"}, "calm": {"adapter": "qwen3_llama_cpp"}, "odd": {"adapter": "none"}},
            "adapters": {k: {"host": "127.0.0.1", "port": 1, "parallel_slots": 3} for k in ("llama_cpp", "qwen3_llama_cpp")}, "generation": GENERATION} | more


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(1 - k % 2, "A" * k, "B" * k, str(k)) for k in range(10)]
    spark.createDataFrame(rows, "label long, names string, base_names string, id string").repartition(3, "id").write.parquet(str(tmp_path / "pairs"))
    (tmp_path / "config.yaml").write_text(json.dumps(settings()))
    return tmp_path


def test_configuration_names_what_there_is(spark, folder):
    config = Config.read(spark, str(folder / "config.yaml"))
    with pytest.raises(ValueError, match="no 'x', only: calm, dry, odd, plain"):
        config.named("models", "x")
    with pytest.raises(ValueError, match="no adapter 'none'"):
        config.scorer("odd")
    with pytest.raises(ValueError, match="no mapping models"):
        Config({k: v for k, v in settings().items() if k != "models"})
    with pytest.raises(ValueError, match="is a mapping"):
        Config(["x"])
    assert config.path("a/b") == f"{config.base}/a/b" and config.path("/a") == "/a" and config.path("hdfs://h/a") == "hdfs://h/a"
    prompt = config.prompt("baseline")
    assert (prompt.version, prompt.sha256) == ("1", hashlib.sha256(b"{record_a} {record_b}").hexdigest())


def test_run_ids():
    assert new_run_id("m", "d", "p", now=datetime(2020, 1, 2, 3, 4, 5)) == "20200102T030405Z_m_d_p"
    for bad in ("", "-a", "a/b", "a b", "..", "a\n"):
        with pytest.raises(ValueError, match="cannot name a run"):
            check_run_id(bad)


def test_configured_run_is_kept_whole(spark, folder):
    config = Config.read(spark, str(folder / "config.yaml"))
    seen = []
    got = run_configured(spark, config, "dry", "pairs", run_id="r1", step=4, report=lambda done, of: seen.append((done, of)))
    assert got["leaderboard_eligible"] and not got["partial_run"] and got["resumed_examples"] == 0 and got["metrics"]["total_examples"] == 10
    assert seen == [(4, 10), (8, 10), (10, 10)] and got["dataset"]["matches"] == 5 and got["dataset"]["version"].startswith("sha256:")
    assert [r.row_index for r in read_results(spark, f"{config.base}/runs/r1/results").orderBy("row_index").collect()] == list(range(10))
    part = run_configured(spark, config, "dry", "pairs", run_id="r2", limit=3)
    assert part["partial_run"] and not part["leaderboard_eligible"] and part["metrics"]["total_examples"] == 3
    with pytest.raises(ValueError, match="complete"):
        run_configured(spark, config, "dry", "pairs", run_id="r1")


def test_interrupted_run_goes_on(spark, tmp_path):
    class Failing(scoring.HashScorer):
        def generate_batch(self, prompts):
            if any("AAAAAA" in p for p in prompts):
                raise RuntimeError("the model went away")
            return scoring.HashScorer.generate_batch(self, prompts)

    table = spark.createDataFrame([(k, k % 2, "A" * k) for k in range(9)], "row_index long, label long, names string")
    e = X.examples(table, X.ExampleSource("label", {"names": "names"}, {"names": "names"}, {}), "row_index")
    prompt = scoring.Prompt("p", "1", "{record_a} {record_b}", ("names",))
    go = lambda make: evaluate(e, prompt, make, "m", str(tmp_path / "run"), {"a": 1}, batch=2, step=3)
    with pytest.raises(Exception, match="went away"):
        go(Failing)
    assert "interrupted" in spark.read.text(str(tmp_path / "run" / "manifest")).first()[0]
    assert go(scoring.HashScorer)["resumed_examples"] == 6
    assert read_results(spark, str(tmp_path / "run" / "results")).count() == 9
    with pytest.raises(ValueError, match="batch"):
        evaluate(e, prompt, scoring.HashScorer, "m", str(tmp_path / "other"), {}, batch=0)


def test_chat_scorer_asks_in_parallel_and_answers_in_order(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][0]["content"]
            first = said not in [b["messages"][0]["content"] for b in asked]
            asked.append(body)
            if said == "2" and first:
                self.send_error(500)
                return
            out = json.dumps({"choices": [{"message": {"content": f"MATCH {said}"}}], "usage": {"prompt_tokens": 7}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        scorer = scoring.ChatScorer(f"http://127.0.0.1:{server.server_port}/", "m", GENERATION, slots=3, wait=0.0, extra={"k": {"on": False}})
        got = scorer.generate_batch([str(k) for k in range(6)])
    finally:
        server.shutdown()
        server.server_close()
    assert [r.raw_output for r in got] == [f"MATCH {k}" for k in range(6)] and got[0].input_tokens == 7 and got[0].output_tokens is None and not any(r.error for r in got)
    assert len(asked) == 7 and asked[0] == {"model": "m", "messages": asked[0]["messages"], **GENERATION, "stream": False, "cache_prompt": True, "k": {"on": False}}
    lost = scoring.ChatScorer("http://127.0.0.1:9", "m", GENERATION, wait=0.0, timeout=2).generate_batch(["x"])[0]
    assert lost.raw_output is None and "URLError" in lost.error


def test_adapters_of_a_configuration():
    make = Config(settings()).scorer
    assert make("dry") is scoring.HashScorer and make("plain")().slots == 3
    assert "chat_template_kwargs" not in make("plain")().payload("x") and make("calm")().payload("x")["chat_template_kwargs"] == {"enable_thinking": False}


def test_rows_are_counted_through_files(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(100, numPartitions=7).write.parquet(at)
    rows = files.with_row_index(spark, at)
    assert sorted((r.id, r.row_index) for r in rows.collect()) == [(k, k) for k in range(100)]
    files.check_alignment(rows, at, ["id"], 20)
    with pytest.raises(ValueError, match="does not match"):
        files.check_alignment(rows.withColumn("id", F.col("id") + (F.col("row_index") % 2)), at, ["id"], 100)
    with pytest.raises(ValueError, match="have a column"):
        files.with_row_index(spark, at, "id")


def test_file_hashes(spark, tmp_path):
    for k, text in enumerate([b"", b"xyz", b"abc"]):
        (tmp_path / f"{k}.bin").write_bytes(text)
    assert {r.sha256 for r in files.file_hashes(spark, str(tmp_path)).collect()} == {hashlib.sha256(t).hexdigest() for t in (b"xyz", b"abc")}
    assert files.dataset_hash(spark, str(tmp_path / "2.bin")) == hashlib.sha256(b"abc").hexdigest()
    both = files.dataset_hash(spark, str(tmp_path))
    (tmp_path / "2.bin").write_bytes(b"abd")
    assert len(both) == 64 and files.dataset_hash(spark, str(tmp_path)) != both


def test_nested_values_on_one_line(spark):
    kind = "v struct<a:string,b:array<struct<x:string,y:string>>,c:map<string,string>,d:int,e:struct<z:string>>"
    rows = [(("", [("p", "q")], {"k": "", "l": "m"}, 0, None),), (("w" * 80, [], {}, 5, ("z",)),), ((None, None, None, None, None),), (None,)]
    df = spark.createDataFrame([r for r in rows], kind)
    at = df.schema["v"].dataType
    line = lambda f, *keys: one_line(F.col(f"v.{f}"), at[f].dataType, keys).alias(f)
    got = df.select(line("a"), line("b", "y"), line("c", "k"), line("d"), line("e"), one_line(F.col("v"), at, ("d", "a")).alias("v")).collect()
    assert tuple(got[0]) == ("-", "q", "m", "0", "-", "p")
    assert tuple(got[1]) == ("w" * 69 + "…", "-", "-", "5", "z", "5")
    assert tuple(got[2]) == tuple(got[3]) == ("-",) * 6
