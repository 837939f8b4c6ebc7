"""Certified selection: plan checks, judgments and the exact least-cost witness.  Errors are rows, not exceptions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import selection

# Fixed values.
OPERATIONS = ("lookup", "compare", "boolean", "intersection")
CLAIM_FIELDS = ["id", "object", "query", "relation", "subject"]
OPERATION_FIELDS = ["inputs", "operator", "output", "type"]
FORBIDDEN_VALUES = ["unknown", "n/a", "na", "not available", "not provided", "not specified", "not stated", "none"]
ALTERNATIVE_PARAMETERS = ["strategy", "alpha", "adaptive_alpha", "graph_rescue_weight", "witness_rescue_max_units", "witness_fallback_min_nodes", "bridge_witness_fallback_min_nodes"]
BACKENDS = ("openai", "openrouter")
DEFAULTS = {"seed_n": 5, "claim_top_k": 5, "claim_prefilter_k": 8, "dependency_path_top_k": 3, "max_search_states": 100_000, "max_hops": 2, "max_path_hops": 3, "claim_support_threshold": 0.7, "dependency_threshold": 0.7, "witness_sufficiency_threshold": 0.8, "confidence_temperature": 1.0}


def config_problem(config: dict) -> str | None:
    """The first thing wrong with the settings of a certified run, or None."""
    c = DEFAULTS | config
    whole = lambda v, least: isinstance(v, int) and not isinstance(v, bool) and v >= least
    real = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    if given := sorted(set(ALTERNATIVE_PARAMETERS) & set(config)):
        return f"parameters of other policies: {', '.join(given)}"
    if config.get("use_reranker") is not True:
        return "use_reranker must be true"
    budgets = config.get("budget_tokens")
    budgets = budgets if isinstance(budgets, list) else [budgets]
    if not budgets or not all(whole(b, 1) for b in budgets):
        return "budget_tokens must be positive integers"
    for name in ("seed_n", "claim_top_k", "claim_prefilter_k", "dependency_path_top_k", "max_search_states"):
        if not whole(c[name], 1):
            return f"{name} must be a positive integer"
    if c["claim_prefilter_k"] < c["claim_top_k"]:
        return "claim_prefilter_k must be at least claim_top_k"
    for name in ("max_hops", "max_path_hops"):
        if not whole(c[name], 0):
            return f"{name} must be an integer of 0 or more"
    for name in ("claim_support_threshold", "dependency_threshold", "witness_sufficiency_threshold"):
        if not real(c[name]) or not 0 <= c[name] <= 1:
            return f"{name} must be a number from 0 to 1"
    if not real(c["confidence_temperature"]) or c["confidence_temperature"] <= 0:
        return "confidence_temperature must be positive"
    for stage in ("planner", "verifier"):
        backend, model = (config.get(f"{stage}_{k}", config.get(f"planner_{k}", d)) for k, d in (("backend", BACKENDS[0]), ("model", "default")))
        if backend not in BACKENDS:
            return f"{stage}_backend must be one of {', '.join(BACKENDS)}"
        if not isinstance(model, str) or not model.strip():
            return f"{stage}_model must be a name"
    return None


def _json_keys(c: Column) -> Column:
    return F.array_sort(F.json_object_keys(c))


def _kind(c: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))


def _text(c: Column, path: str) -> Column:
    """A member that is a string with more than blanks, else null."""
    value = F.get_json_object(c, path)
    return F.when((_kind(c, path) == "STRING") & (F.trim(value) != ""), value)


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` behind a generator, so that what uses them does not compute them again."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("staged")).select("*", "staged.*").drop("staged")


def parsed(plans: DataFrame) -> DataFrame:
    """``qid, claims, deps, sinks, operation, error`` of ``qid, plan`` (JSON): one row for each plan, all inside the JVM.

    ``error`` names the first rule that the plan breaks: its keys, claims, the operation's keys, type,
    operator, inputs and output, a claim's fields, ids given twice, a variable subject that is not
    exactly one earlier object, inputs that are not all sinks, sinks that retrieve no variable, and
    what a lookup, comparison or intersection must have.
    """
    keys = lambda names: F.array(*map(F.lit, names))
    p = _staged(plans.select("qid", "plan"), raw=F.from_json(F.get_json_object("plan", "$.claims"), "array<string>"), op=F.get_json_object("plan", "$.operation"))
    operation = F.struct(F.get_json_object("op", "$.type").alias("type"), F.get_json_object("op", "$.operator").alias("operator"), F.from_json(F.get_json_object("op", "$.inputs"), "array<string>").alias("inputs"), F.get_json_object("op", "$.output").alias("output"))
    claim = lambda c: F.struct(*[F.trim(_text(c, f"$.{f}")).alias(f) for f in CLAIM_FIELDS])
    fits = lambda c: F.coalesce(_json_keys(c) == keys(CLAIM_FIELDS), F.lit(False)) & ~F.exists(F.array(*[_text(c, f"$.{f}") for f in CLAIM_FIELDS]), lambda x: x.isNull())
    p = _staged(p, operation=operation, claims=F.transform("raw", claim), fit=F.forall("raw", fits))
    earlier = lambda t, i: F.filter(F.slice("claims", F.lit(1), i), lambda c: c["object"] == t["subject"])
    later = F.filter(F.transform("claims", lambda t, i: F.struct(t["id"].alias("target"), t["subject"].alias("binding"), F.transform(earlier(t, i), lambda c: c["id"]).alias("sources"))), lambda x: x["binding"].startswith("?"))
    p = _staged(p, later=F.when(F.col("fit"), later), ids=F.transform("claims", lambda c: c["id"]))
    p = _staged(p, deps=F.transform(F.filter("later", lambda x: F.size(x["sources"]) == 1), lambda x: F.struct(F.get(x["sources"], F.lit(0)).alias("source"), x["target"].alias("target"), x["binding"].alias("binding"))))
    p = _staged(p, sinks=F.array_except("ids", F.transform("deps", lambda x: x["source"])))
    inputs = F.col("operation.inputs")
    ends = F.filter("claims", lambda c: F.array_contains(inputs, c["id"]))
    n = F.size(inputs)
    rules = [
        ("keys", _json_keys(F.col("plan")) == keys(["claims", "operation"])),
        ("claims", F.size("raw") > 0),
        ("operation", _json_keys(F.col("op")) == keys(OPERATION_FIELDS)),
        ("type", F.col("operation.type").isin(*OPERATIONS)),
        ("operator", _text(F.col("op"), "$.operator").isNotNull()),
        ("inputs", (n > 0) & (F.size(F.array_distinct(inputs)) == n) & (_kind(F.col("op"), "$.inputs") == "ARRAY<STRING>")),
        ("output", _text(F.col("op"), "$.output").startswith("?")),
        ("claim", F.col("fit")),
        ("ids", F.size(F.array_distinct("ids")) == F.size("ids")),
        ("dependency", F.forall("later", lambda x: F.size(x["sources"]) == 1)),
        ("sinks", F.array_sort(inputs) == F.array_sort("sinks")),
        ("retrieves", F.forall(ends, lambda c: c["object"].startswith("?"))),
        ("lookup", (F.col("operation.type") != "lookup") | (n == 1)),
        ("lookup_output", (F.col("operation.type") != "lookup") | (F.get(ends, F.lit(0))["object"] == F.col("operation.output"))),
        ("branches", ~F.col("operation.type").isin("compare", "intersection") | (n >= 2)),
    ]
    error = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        error = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(error)
    canonical = F.col("operation").withField("output", F.when(F.col("operation.type") == "lookup", F.col("operation.output")).otherwise("?answer"))
    p = _staged(p, error=error)
    good = F.col("error").isNull()
    return p.select("qid", *[F.when(good, c).alias(a) for c, a in ((F.col("claims"), "claims"), (F.col("deps"), "deps"), (F.col("sinks"), "sinks"), (canonical, "operation"))], "error")


def claims(plans: DataFrame) -> DataFrame:
    """``qid, pos, id, subject, relation, object, query`` of ``parsed`` plans."""
    return plans.select("qid", F.posexplode("claims").alias("pos", "c")).select("qid", "pos", "c.id", "c.subject", "c.relation", "c.object", "c.query")


def grounded(c: DataFrame, titles: DataFrame) -> DataFrame:
    """``claims`` with ``source_title``: of ``titles (qid, title)`` the only one with the subject's normal form; without such, the only alias."""
    named = c.filter(~F.col("subject").startswith("?")).select("qid", "id", T.normalize("subject").alias("sn"), T.alias(F.col("subject")).alias("sa"))
    t = titles.select("qid", "title").distinct().select("qid", "title", T.normalize("title").alias("tn"), T.alias(F.col("title")).alias("ta"))
    j = named.join(t, "qid").withColumns({"exact": F.col("sn") == F.col("tn"), "like": T.alias_same(F.col("sa"), F.col("ta"))}).filter("exact or like")
    g = j.groupBy("qid", "id").agg(F.count_if("exact").alias("ne"), F.min(F.when(F.col("exact"), F.col("title"))).alias("e"), F.count_if("like").alias("nl"), F.min(F.when(F.col("like"), F.col("title"))).alias("l"))
    g = g.select("qid", "id", F.when(F.col("ne") == 1, F.col("e")).when((F.col("ne") == 0) & (F.col("nl") == 1), F.col("l")).alias("source_title"))
    return c.join(g, ["qid", "id"], "left")


def topological(ids: list[str], deps: list[tuple[str, str]]) -> list[str]:
    """Claims so that sources come first; of those that can come next, the smallest id."""
    waits = {i: sum(t == i for _, t in deps) for i in ids}
    ready, out = [i for i in ids if not waits[i]], []
    heapq.heapify(ready)
    while ready:
        out.append(heapq.heappop(ready))
        for s, t in deps:
            if s == out[-1]:
                waits[t] -= 1
                if not waits[t]:
                    heapq.heappush(ready, t)
    return out


def retained(judged: DataFrame, threshold: float = 0.7, top_k: int = 5) -> DataFrame:
    """Supported judgments at the threshold, the best ``top_k`` of each claim; ``error`` rows for claims without any."""
    w = W.partitionBy("qid", "claim").orderBy(F.desc("confidence"), F.desc("raw"), F.desc("key"))
    able = judged.filter((F.col("label") == "supported") & (F.col("confidence") >= threshold) & ~F.lower("value").isin(FORBIDDEN_VALUES))
    kept = able.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    every = judged.select("qid", "claim").distinct()
    return every.join(kept.select("qid", "claim", "key", "confidence", "raw", "rank"), ["qid", "claim"], "left").withColumn("error", F.when(F.col("key").isNull(), "claim_uncovered"))


def ordered_union(a: Column, b: Column) -> Column:
    """Elements in the order of their first occurrence."""
    return F.array_distinct(F.concat(a, b))


def rendered(keys: DataFrame, quotes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sentences of a certificate: ``keys (qid, pos, key)`` with the distinct ``quotes (qid, key, place, quote)``, a line each; without any the raw text."""
    q = quotes.groupBy("qid", "key").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "quote"))), lambda x: x["quote"])), "\n").alias("quoted"))
    return keys.join(nodes.select("qid", "key", "title", "text"), ["qid", "key"]).join(q, ["qid", "key"], "left").select("qid", "pos", "key", "title", F.coalesce("quoted", "text").alias("text"))


def certificate_cost(keys: list, chosen: list[dict], texts: dict) -> int:
    """Tokens of the compact context of ``keys``, in which a sentence with quotes is its quotes."""
    quoted: dict = {}
    for a in chosen:
        mine = quoted.setdefault(a["key"], [])
        if a["quote"] not in mine:
            mine.append(a["quote"])
    return selection._compact_tokens([{"title": texts[k][0], "text": "\n".join(quoted[k]) if k in quoted else texts[k][1]} for k in keys])


def solve(order: list[str], deps: list[tuple[str, str, str]], assignments: dict[str, list[dict]], paths: list[dict], texts: dict, budget: int, states: int = 100_000, sufficiency: float = 0.8) -> dict:
    """Least-cost witness: one assignment for each claim and one verified path for each dependency.

    Claims are taken in ``order``; a partial witness beyond the budget or the best cost so far is
    dropped.  Of equal costs the larger least confidence wins, then the smaller keys.  Every partial
    witness that is looked at counts as a state.  An assignment is ``key, confidence, bindings, quote``,
    a path ``source, target, from_key, to_key, path, confidence, value``, ``texts`` is (title, text) by key.
    """
    into: dict[str, list[tuple[str, str]]] = {}
    for s, t, variable in deps:
        into.setdefault(t, []).append((s, variable))
    best: tuple | None = None
    seen = 0
    todo: list[tuple] = [(0, (), (), ())]  # a stack: depth, assignments, confidences of paths, keys
    while todo:
        depth, chosen, sure, keys = todo.pop()
        seen += 1
        if seen > states:
            return {"error": "search_space_exhausted", "states": seen}
        cost = certificate_cost(keys, list(chosen), texts) if keys else 0
        if cost > budget or (best is not None and cost > best[0]):
            continue
        if depth == len(order):
            rank = (cost, -min([a["confidence"] for a in chosen] + list(sure), default=0.0), keys)
            if best is None or rank < best[:3]:
                best = (*rank, chosen)
            continue
        claim, more = order[depth], []
        for a in assignments.get(claim, []):
            if a["confidence"] < sufficiency:
                continue
            options = []
            for source, variable in into.get(claim, []):
                other = chosen[order.index(source)]
                mine, theirs = (a["bindings"] or {}).get(variable), (other["bindings"] or {}).get(variable)
                able = mine is not None and theirs is not None and T.python_alias_same(theirs, mine)
                options.append([p for p in paths if able and (p["source"], p["target"], p["from_key"], p["to_key"]) == (source, claim, other["key"], a["key"]) and p["confidence"] >= sufficiency and T.python_alias_same(theirs, p["value"])])
            for picked in product(*options):
                new = [k for p in picked for k in p["path"]] if picked else [a["key"]]
                more.append((depth + 1, (*chosen, a), (*sure, *(p["confidence"] for p in picked)), tuple(dict.fromkeys([*keys, *new]))))
        todo += more[::-1]
    if best is None:
        return {"error": "no_feasible_witness", "states": seen}
    return {"error": None, "cost": best[0], "bottleneck": -best[1], "keys": list(best[2]), "assigned": [a["key"] for a in best[3]], "states": seen}


WITNESS = "qid bigint, budget bigint, error string, cost bigint, bottleneck double, keys array<string>, assigned array<string>, states bigint"
_KINDS = {"error": pa.string(), "cost": pa.int64(), "bottleneck": pa.float64(), "keys": pa.list_(pa.string()), "assigned": pa.list_(pa.string()), "states": pa.int64()}


def witnesses(plans: DataFrame, assignments: DataFrame, paths: DataFrame, nodes: DataFrame, budgets: list[int], states: int = 100_000, sufficiency: float = 0.8) -> DataFrame:
    """A row for each plan and budget, with an ``error`` where there is no witness.

    ``plans (qid, claims, deps)``, ``assignments (qid, claim, rank, key, confidence, bindings, quote)``,
    ``paths (qid, rank, source, target, from_key, to_key, path, confidence, value)``, ``nodes (qid, key,
    title, text)``.  Only sentences that an assignment or a path names come along.
    """
    if any(b <= 0 for b in budgets) or states <= 0 or not 0 <= sufficiency <= 1:
        raise ValueError("budgets and states must be positive, sufficiency from 0 to 1")
    used = assignments.select("qid", "key").union(paths.select("qid", F.explode("path"))).distinct()
    listed = lambda df, name, *columns: df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    rows = plans.select("qid", "claims", "deps").join(listed(assignments, "a", "claim", "rank", "key", "confidence", F.map_entries("bindings").alias("bindings"), "quote"), "qid", "left")
    rows = rows.join(listed(paths, "p", "rank", "source", "target", "from_key", "to_key", "path", "confidence", "value"), "qid", "left")
    rows = rows.join(listed(used.join(nodes, ["qid", "key"]), "n", "key", "title", "text"), "qid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"qid": [], "budget": [], **{k: [] for k in _KINDS}}
            for r in b.to_pylist():
                ids, deps = [c["id"] for c in r["claims"] or []], [(x["source"], x["target"], x["binding"]) for x in r["deps"] or []]
                found: dict[str, list[dict]] = {}
                for a in r["a"] or []:
                    found.setdefault(a["claim"], []).append(a | {"bindings": {e["key"]: e["value"] for e in a["bindings"] or []}})
                texts = {n["key"]: (n["title"], n["text"]) for n in r["n"] or []}
                order = topological(ids, [x[:2] for x in deps])
                for budget in budgets:
                    result = {"error": "claim_uncovered"} if any(i not in found for i in ids) else solve(order, deps, found, r["p"] or [], texts, budget, states, sufficiency)
                    out["qid"].append(r["qid"]), out["budget"].append(budget)
                    for k in _KINDS:
                        out[k].append(result.get(k))
            yield pa.RecordBatch.from_pydict({"qid": pa.array(out["qid"], pa.int64()), "budget": pa.array(out["budget"], pa.int64())} | {k: pa.array(out[k], t) for k, t in _KINDS.items()})

    return rows.select(F.col("qid").cast("bigint").alias("qid"), "claims", "deps", "a", "p", "n").mapInArrow(run, WITNESS)
