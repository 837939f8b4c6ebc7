import json
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from brightwell import catalog
from brightwell.functions import text as T
from brightwell.operators import certify, fusion, graph, selection
from brightwell.sources import multihop

C = "qid bigint, ord int, title string, cost bigint, semantic double, graph double"


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.1, 0.5, 0.5, 0.9, 0.5])], "qid bigint, ord int, semantic double")
    got = [r[0] for r in df.withColumn("p", fusion.percentile("semantic")).orderBy("ord").select("p").collect()]
    assert got == [0.0, 0.5, 0.5, 1.0, 0.5]


def test_prefix_stops_and_fold_skips(spark):
    c = spark.createDataFrame([(1, i, "t", x, 1.0 - i / 10, 0.0) for i, x in enumerate([60, 50, 40, 30, 10])], C)
    assert [r.ord for r in selection.topk(c, budget=100).collect()] == [0]
    assert selection.skip_fold(selection.singles(c), [F.col("ord")], 100).first()["selected"] == "0,2"
    with pytest.raises(ValueError):
        selection.threshold(c, None)
    with pytest.raises(ValueError):
        selection.select("none", c)


def test_interleave_shift():
    rows = [{"cost": 1, "semantic": s, "graph": g} for s, g in ((4, 4), (3, 1), (2, 2), (1, 3))]
    assert selection.interleave_pick(rows, 99) == [0, 3, 1, 2]


def test_fold_against_plain_loop(spark):
    rng = random.Random(1)
    rows = [(q, i, "t", rng.randint(1, 40), rng.random(), rng.random()) for q in range(30) for i in range(8)]
    got = {r.qid: r for r in selection.skip_fold(selection.singles(spark.createDataFrame(rows, C), "semantic"), [F.desc("semantic"), F.col("ord")], 60).collect()}
    for q in range(30):
        used, sel = 0, []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[4], r[1])):
            if used + r[3] <= 60:
                used, sel = used + r[3], [*sel, r[1]]
        assert (got[q].used, got[q].selected) == (used, ",".join(map(str, sel)))


def test_hops(spark):
    e = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 0, 4, 1.0)], "qid bigint, src bigint, dst bigint, weight double")
    s = spark.createDataFrame([(1, 0), (1, 3)], "qid bigint, node_ord bigint")
    assert {(r.node_ord, r.hop) for r in graph.hops(e, s).collect()} == {(0, 0), (3, 0), (1, 1), (2, 1), (4, 1)}
    p = graph.pagerank(e, s.withColumn("restart", F.lit(1.0))).collect()
    assert abs(sum(r.score for r in p) - 1) < 1e-4


def test_answer_scores_and_quotes(spark):
    df = spark.createDataFrame([("no", "yes"), ("", ""), ("The cat sat", "a cat"), ("x", None)], "p string, g string")
    m = [r.m for r in df.select(T.answer_scores(F.col("p"), F.col("g")).alias("m")).collect()]
    assert (m[0].em, m[0].f1) == (0.0, 0.0) and (m[1].em, m[1].f1) == (1.0, 0.0) and round(m[2].f1, 4) == 0.6667
    q = spark.createDataFrame([("Ann (b. 1900) wrote it", "Ann wrote"), ("a b", "b a")], "s string, q string")
    assert [r[0] for r in q.select(T.project_quote("s", "q")).collect()] == ["Ann (b. 1900) wrote", None]


def test_records(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('[{"_id":"q","question":"?","context":[["A",["x","y"]],["A",["x","y"]]],"supporting_facts":[["A",1],["B",0],["A",99]]}]')
    t = multihop.load(spark, str(path), deduplicate=True)
    assert t["sentences"].count() == 2
    assert multihop.invalid_gold(t["gold"], t["sentences"]).count() == 2
    assert multihop.load(spark, str(path), True, "exclude")["questions"].count() == 0
    with pytest.raises(ValueError):
        multihop.load(spark, str(path), invalid_gold_policy="x")
    a = multihop.audit(multihop.read_records(spark, str(path))).first()
    assert (a.records, a.duplicate_passage_records, a.invalid_gold_facts) == (1, 1, 2)


def test_null_keys_resume(spark):
    e = spark.createDataFrame([("a", None), ("b", None)], "qid string, alpha double")
    assert [r.qid for r in multihop.pending(e, e.filter("qid = 'a'"), ["qid", "alpha"]).collect()] == ["b"]


def brute_witness(order, deps, assignments, paths, texts, budget, sufficiency):
    """All combinations; none of the paths here has a sentence that only a later quote would shorten."""
    best = None
    for chosen in product(*[assignments[c] for c in order]):
        if any(a["confidence"] < sufficiency for a in chosen):
            continue
        at, options, ok = dict(zip(order, chosen, strict=True)), [], True
        for c in order:
            for s, t, v in deps:
                if t == c:
                    able = T.python_alias_same(at[s]["bindings"][v], at[t]["bindings"][v])
                    options.append([(c, p) for p in paths if able and (p["source"], p["target"], p["from_key"], p["to_key"]) == (s, t, at[s]["key"], at[t]["key"]) and p["confidence"] >= sufficiency and T.python_alias_same(at[s]["bindings"][v], p["value"])])
                    ok = ok and bool(options[-1])
        for picked in product(*options) if ok else []:
            keys = []
            for c in order:
                mine = [k for o, p in picked if o == c for k in p["path"]] or [at[c]["key"]]
                keys += [k for k in mine if k not in keys]
            cost = certify.certificate_cost(keys, list(chosen), texts)
            sure = min([a["confidence"] for a in chosen] + [p["confidence"] for _, p in picked])
            rank = (cost, -sure, tuple(keys))
            if cost <= budget and (best is None or rank < best):
                best = rank
    return best


def test_solver():
    rng, found = random.Random(8), 0
    for _ in range(60):
        keys = [str(i) for i in range(5)]
        texts = {k: (f"t{rng.randrange(3)}", "q") for k in keys}  # raw sentences as short as any quote
        order = ["a", "b", "c"]
        deps = rng.choice([[], [("a", "b", "?x")], [("a", "b", "?x"), ("b", "c", "?x")]])
        value = lambda: rng.choice(["Golden Harbour", "golden harbour (film)", "Other"])
        assignments = {c: [{"key": k, "confidence": rng.choice([0.7, 0.85, 0.9]), "bindings": {"?x": value()}, "quote": "word " * rng.randint(1, 6)} for k in rng.sample(keys, 2)] for c in order}
        paths = [{"source": s, "target": t, "from_key": i, "to_key": j, "path": [i, rng.choice(keys), j], "confidence": rng.choice([0.8, 0.95]), "value": value()} for s, t in (("a", "b"), ("b", "c")) for i in keys for j in keys if rng.random() < 0.6]
        got = certify.solve(order, deps, assignments, paths, texts, 60, 10_000, 0.8)
        want = brute_witness(order, deps, assignments, paths, texts, 60, 0.8)
        found += want is not None
        assert got["error"] == (None if want else "no_feasible_witness")
        assert want is None or (got["cost"], -got["bottleneck"], tuple(got["keys"])) == want
    assert 10 < found < 60
    many = {c: [{"key": str(i), "confidence": 1.0, "bindings": {}, "quote": "w"} for i in range(9)] for c in "abcd"}
    assert certify.solve(list("abcd"), [], many, [], {str(i): ("t", "w") for i in range(9)}, 99, 50)["error"] == "search_space_exhausted"
    assert certify.topological(["c", "b", "a", "d"], [("d", "a"), ("a", "b")]) == ["c", "d", "a", "b"]


def test_plan_rules(spark):
    claim = lambda i, s, o: {"id": i, "subject": s, "relation": "r", "object": o, "query": "q"}
    op = {"type": "lookup", "operator": "o", "inputs": ["b"], "output": "?y"}
    good = {"claims": [claim("a", "X", "?x"), claim("b", "?x", "?y")], "operation": op}
    plans = [
        (None, good), ("keys", good | {"more": 1}), ("keys", {"claims": []}), ("claims", good | {"claims": []}), ("operation", good | {"operation": {"type": "lookup"}}), ("type", good | {"operation": op | {"type": "sum"}}),
        ("operator", good | {"operation": op | {"operator": " "}}), ("inputs", good | {"operation": op | {"inputs": ["b", "b"]}}), ("inputs", good | {"operation": op | {"inputs": []}}), ("output", good | {"operation": op | {"output": "y"}}),
        ("claim", good | {"claims": [claim("a", "X", "?x") | {"note": 1}]}), ("claim", good | {"claims": [claim("a", "", "?x")]}), ("claim", good | {"claims": [claim("a", 5, "?x")]}), ("ids", good | {"claims": [claim("a", "X", "?x")] * 2}),
        ("dependency", good | {"claims": [claim("b", "?x", "?y"), claim("a", "X", "?x")]}), ("sinks", good | {"operation": op | {"inputs": ["a"]}}), ("retrieves", {"claims": [claim("b", "X", "Y")], "operation": op}),
        ("lookup", {"claims": [claim("a", "X", "?x"), claim("b", "Y", "?y")], "operation": op | {"inputs": ["a", "b"]}}), ("lookup_output", good | {"operation": op | {"output": "?z"}}), ("branches", good | {"operation": op | {"type": "compare"}}),
    ]
    rows = [(i, json.dumps(p)) for i, (_, p) in enumerate(plans)] + [(98, "no json"), (99, None)]
    out = {r.qid: r for r in certify.parsed(spark.createDataFrame(rows, "qid bigint, plan string")).collect()}
    assert [out[i].error for i in range(len(plans))] == [e for e, _ in plans] and out[98].error == out[99].error == "keys"
    assert [tuple(x) for x in out[0].deps] == [("a", "b", "?x")] and out[0].sinks == ["b"]
    config = {"use_reranker": True, "budget_tokens": [200]}
    assert certify.config_problem(config) is None
    wrong = [{"alpha": 1}, {"use_reranker": 1}, {"budget_tokens": True}, {"seed_n": 0}, {"claim_prefilter_k": 2}, {"max_hops": -1}, {"dependency_threshold": 2}, {"confidence_temperature": 0}, {"planner_backend": "x"}, {"verifier_model": " "}]
    assert all(certify.config_problem(config | w) for w in wrong)


def plain_fold(order, keys, cost, budget):
    used, sel = 0, []
    for u in order:
        new = [k for k in keys[u] if k not in sel]
        if used + sum(cost[k] for k in new) <= budget:
            used, sel = used + sum(cost[k] for k in new), sel + new
    return sel


def test_pairs_against_plain_loops(spark):
    rng = random.Random(6)
    rows = []
    for q in range(25):
        for i in range(rng.randint(1, 8)):
            a = rng.choice([None, *range(i)]) if i else None
            rows.append((q, i, f"t{rng.randrange(3)}", rng.randint(1, 40), rng.choice([0.1, 0.4, 0.4, 0.9, None]), rng.choice([0.2, 0.5, 1.0]), a, rng.choice([0.3, 0.6, 0.6]) if a is not None else None, rng.choice([True, False]) if a is not None else False, rng.randint(0, 2)))
    c = spark.createDataFrame(rows, "qid bigint, ord int, title string, cost bigint, semantic double, graph double, anchor int, cond double, validated boolean, hop int")
    got = {r.qid: r.selected for r in selection.pair_fold(c, 0.3, 70).collect()}
    cond = {r.qid: r.selected for r in selection.conditional_topk(c, 0.6, 0.2, 70).collect()}
    for q in range(25):
        mine = [r for r in rows if r[0] == q]
        cost = {r[1]: r[3] for r in mine}
        node = dict(zip(cost, selection.percentiles([r[4] or 0.0 for r in mine]), strict=True))
        graph_ = dict(zip(cost, selection.percentiles([r[5] for r in mine]), strict=True))
        link = dict(zip(cost, selection.percentiles([r[7] if r[8] else None for r in mine]), strict=True))
        pc = dict(zip(cost, selection.percentiles([r[7] for r in mine]), strict=True))
        units = {r[1]: [r[6], r[1]] if r[8] else [r[1]] for r in mine}
        utility = {r[1]: node[r[6]] + node[r[1]] + 0.3 * link[r[1]] if r[8] else node[r[1]] for r in mine}
        assert got[q] == ",".join(map(str, plain_fold(sorted(cost, key=lambda i: (-utility[i], -node[i], i)), units, cost, 70)))
        rel = {i: 0.6 * node[i] + 0.4 * graph_[i] for i in cost}
        both = {r[1]: [r[6], r[1]] if r[6] is not None else [r[1]] for r in mine}
        sem = {r[1]: r[4] or 0.0 for r in mine}
        order = sorted(cost, key=lambda i: (-(rel[i] + 0.2 * pc[i]), -rel[i], -sem[i], i))
        assert cond[q] == ",".join(map(str, plain_fold(order, both, cost, 70)))


def test_witness_picks():
    row = lambda i, t, s, c, **k: {"ord": i, "title": t, "cost": c, "semantic": s, "graph": 0.0, **k}
    rows = [row(0, "A", 0.9, 10), row(1, "B", 0.8, 10, anchor=0, validated=True, cond=0.5, gain=0.1), row(2, "C", 0.7, 10), row(3, "D", 0.1, 10, anchor=2, validated=True, cond=0.9, gain=0.5)]
    assert selection.chain_pick(rows, 100, 1, 2) == [0, 1]
    assert selection.chain_pick(rows, 100, 2, 4) == [0, 1, 2, 3]
    assert selection.chain_pick(rows, 100, 1, 2, preferred=["C"]) == [2, 3]
    assert selection.chain_pick(rows, 15, 1, 2) == [0]  # no pair fits: the fallback
    assert selection.entity_pick(rows, 100, 2, ["D", "B", "A"]) == [3, 1]
    assert selection.entity_pick(rows, 100, 2, []) == [0, 1] and selection.entity_pick(rows, 100, 1, [], 1) == [0, 1]
    assert selection.marginal_pick(rows, 100, 0.3, 0.0, 0.0, 0.0)[:2] == [0, 1]
    assert selection.coverage_pick([row(0, "A", 0.9, 1), row(1, "A", 0.8, 1), row(2, "B", 0.7, 1)], 2, 0.6) == [0, 2]
    assert selection.percentiles([0.1, None, 0.5, 0.5]) == [0.0, 0.0, 0.75, 0.75] and selection.percentiles([3.0]) == [1.0]


def test_aliases_and_mentions(spark):
    df = spark.createDataFrame([("Roy Mack (director)", "roy  MACK"), ("Dr. André De Toth", "Andre DeToth"), ("King Arthur", "arthur"), ("Film of the Sea", "The Sea"), ("Blackadder", "old blackadder goes"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(T.alias_match(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, True, False]
    t = spark.createDataFrame([("He met André in Rome.", "Andre"), ("In ROME  then", "rome then"), ("x", "Rome")], "x string, t string")
    assert [r[0] for r in t.select(T.mentions(T.mention(F.col("x")), T.mention(F.col("t")))).collect()] == [True, True, False]
    assert T.python_alias_same("Sir Ian", "ian") and not T.python_alias_same("Ann", "Bob")


def test_catalog_is_consistent():
    assert set(catalog.SQL) <= set(catalog.Q) and len(catalog.Q) >= 55
