import json

import pytest
from pyspark.sql import functions as F

from brightwell.operators import metrics, prompts, verify
from brightwell.plans import sweeps
from brightwell.sources import reports


def judged(spark, *payloads):
    rows = [(1, f"c{i}", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    tasks = [(1, f"c{i}", t) for i in range(len(payloads)) for t in ("t1", "t2")]
    out = verify.judgments(spark.createDataFrame(rows, "qid int, claim string, payload string"), spark.createDataFrame(tasks, "qid int, claim string, task_id string"))
    return {r.claim: r for r in out.collect()}


def test_judgment_schema(spark):
    good = {"task_id": "t1", "label": "entailed", "confidence": 0.5, "bindings": {"?a": "x"}}
    wrap = lambda *j: {"judgments": list(j)}
    got = judged(
        spark, wrap(good), wrap(good | {"confidence": True}), wrap(good | {"confidence": 1.5}), wrap(good | {"confidence": "0.5"}), wrap(good | {"label": "maybe"}), wrap(good | {"task_id": "t9"}),
        wrap(good, good), wrap(good | {"more": 1}), wrap(good | {"bindings": []}), wrap(good | {"label": "not_entailed"}), wrap({"task_id": "t2", "label": "not_entailed", "confidence": 1, "bindings": {}}),
        wrap(good) | {"x": 1}, "no json", {"judgments": 3}, wrap(), wrap(good | {"evidence_quote": "q"}),
    )
    assert [i for i in range(16) if f"c{i}" in got and got[f"c{i}"].error is None] == [0, 10, 15]
    assert "c14" not in got and len(got) == 15  # an empty list is valid and has no row
    assert got["c0"].bindings == {"?a": "x"} and got["c0"].confidence == 0.5 and got["c15"].quote == "q"


@pytest.mark.parametrize(
    ("bindings", "fixed", "links", "terminal", "surface", "quote", "reason"),
    [
        ({"?a": "Paris"}, {}, [], [], "born in  PARIS", "", None),
        ({"?b": "Paris"}, {}, [], [], "born in Paris", "", "variables"),
        ({"?a": " "}, {}, [], [], "born in Paris", "", "variables"),
        ({"?a": "Paris"}, {"?a": "paris "}, [], [], "none", "", None),
        ({"?a": "Paris"}, {"?a": "Rome"}, [], [], "born in Paris", "", "constraint"),
        ({"?a": "Paris"}, {}, ["?a"], [], "born in Paris", "", "link"),
        ({"?a": "Golden Harbour"}, {}, ["?a"], [], "none", "", None),
        ({"?a": "Unknown"}, {}, [], [], "unknown", "", "forbidden"),
        ({"?a": "Paris"}, {}, [], [], "born in Rome", "", "surface"),
        ({"?a": "Paris"}, {}, [], ["?a"], "born in Rome", "", None),
        ({"?a": "Paris"}, {}, [], [], "born in Paris", "Paris born", "quote"),
    ],
)
def test_grounding(spark, bindings, fixed, links, terminal, surface, quote, reason):
    df = spark.createDataFrame(
        [(bindings, ["?a"], fixed, links, ["Golden Harbour"], terminal, surface, surface, quote)],
        "b map<string,string>, v array<string>, f map<string,string>, l array<string>, t array<string>, e array<string>, s string, x string, q string",
    )
    assert df.select(verify.grounding_reject(*[F.col(c) for c in "bvfltesxq"])).first()[0] == reason


def test_dependency_options(spark):
    s = spark.createDataFrame([(1, "d", "a", "Golden Harbour"), (1, "e", "a", "Golden Harbour")], "qid int, dep string, key string, binding string")
    t = spark.createDataFrame([(1, "d", "b", "golden harbour"), (1, "e", "c", "The Golden Harbour")], "qid int, dep string, key string, binding string")
    p = spark.createDataFrame([(1, "a", "b", "p1", 1), (1, "a", "b", "p2", 0), (1, "a", "b", "p3", 0), (1, "a", "c", "p4", 0)], "qid int, from_key string, to_key string, path string, path_rank int")
    j = spark.createDataFrame([(1, "d", "p1", 0.9), (1, "d", "p2", 0.8), (1, "d", "p3", 0.1)], "qid int, dep string, path string, confidence double")
    got = verify.dependency_options(s, t, p, j).orderBy("dep", "rank").collect()
    assert [(r.dep, r.path, r.rank, r.error) for r in got] == [("d", "p2", 1, None), ("d", "p1", 2, None), ("e", "p4", 1, "dependency_verification_invalid")]


def test_prompts_and_answers(spark):
    rows = spark.createDataFrame([(1, 0, "p"), (1, 1, "p"), (2, 0, "p"), (2, 1, "bad")], "qid int, row int, prompt string")
    calls = prompts.called(rows, lambda t: 1 / 0 if t == "bad" else t.upper(), wait=0.0).orderBy("qid", "row").collect()
    assert [(r.generation_reused, r.answer, r.error) for r in calls] == [(False, "P", None), (True, "P", None), (False, "P", None), (False, None, "ZeroDivisionError")]
    known = spark.createDataFrame([("p", "yes", 10, 1)], "t string, answer string, prompt_tokens int, output_tokens int").withColumn("prompt_sha256", F.sha2("t", 256)).drop("t")
    got = prompts.recorded(rows, known).orderBy("qid", "row").collect()
    assert [(r.answer, r.prompt_tokens, r.error) for r in got] == [("yes", 10, None), ("yes", 0, None), ("yes", 10, None), (None, None, "answer_missing")]
    parsed = prompts.structured(spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "b": 2}',), ("x",), (None,)], "answer string"), "a int", ["a"]).collect()
    assert [r.error for r in parsed] == [None, *["structured_generation_invalid"] * 3]


def test_sweeps(spark):
    config = {"methods": [{"name": "a", "kind": "k", "alpha": [0, 0.5], "budget_tokens": [1, 2]}, {"name": "b", "kind": "k"}]}
    assert len(sweeps.points(config)) == 5 and sweeps.preflight(config) == []
    q = spark.createDataFrame([(1,), (2,)], "qid int")
    assert sweeps.expected(q, config).exceptAll(q.crossJoin(sweeps.table(spark, config))).isEmpty()
    assert {r.method: r.n_rows for r in sweeps.call_counts(sweeps.expected(q, config)).collect()} == {"a": 8, "b": 2}
    wrong = {"n_questions": 9, "methods": [{"name": "a", "kind": "k", "alpha": 2}, {"name": "a", "budget_tokens": True}]}
    assert len(sweeps.preflight(wrong, 5)) == 5 and sweeps.preflight({"methods": []}) == ["no methods"]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.4), ("c", 2.0, 0.9), ("d", 3.0, None)], "method string, cost double, gain double")
    assert reports.markdown(rows.limit(1)) == "| method | cost | gain |\n|---|---:|---:|\n| a | 1.0000 | 0.5000 |\n"
    assert [r.frontier for r in reports.trade_off(rows, "cost", "gain").orderBy("method").collect()] == [True, False, True, None]
    path = str(tmp_path / "rows")
    reports.append_rows(rows, path), reports.append_rows(rows, path)
    assert reports.read_rows(spark, path).count() == 8
    reports.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["method", "cost", "gain"]
    reports.write_metadata(spark, str(tmp_path / "meta"), shard_index=1)
    assert '"shard_index": 1' in "\n".join(r.value for r in spark.read.text(str(tmp_path / "meta")).collect())
    assert set(reports.union_of_keys([rows.drop("gain"), rows.drop("cost")]).columns) == {"method", "cost", "gain"}
    histogram = metrics.error_histogram(spark.createDataFrame([("x", None), ("x", "e"), ("y", "e")], "qtype string, error string"))
    assert {(r.qtype, r.error): r.n for r in histogram.collect() if r.overall} == {(None, None): 1, (None, "e"): 2}
