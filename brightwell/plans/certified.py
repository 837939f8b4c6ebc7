"""The certified pipeline: plan, claim-aware pool, claims verified level by level, dependencies, least-cost witness.

Models come in as functions from tasks to judgments, so that a recording, a rule or a client can be
used.  Whatever goes wrong for a question becomes an ``error`` of its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import certify, graph, verify
from . import methods

Judge = Callable[[DataFrame], DataFrame]


def claim_seeds(questions: DataFrame, claims: DataFrame, nodes: DataFrame, seed_n: int = 5) -> DataFrame:
    """``qid, node_ord, score``: the best sentences of the question and of each claim's query, and all of grounded titles (score null)."""
    queries = questions.select("qid", "question").unionByName(claims.select("qid", F.col("query").alias("question"))).distinct()
    q = queries.select("qid", "question", methods.words(F.col("question")).alias("qw"))
    s = nodes.select("qid", "node_ord", "title", "sent_id", methods.words(F.col("text")).alias("sw")).join(q, "qid").withColumn("score", methods.overlap(F.col("qw"), F.col("sw")))
    place = F.row_number().over(W.partitionBy("qid", "question").orderBy(F.desc("score"), F.desc("title"), F.desc("sent_id")))
    best = s.withColumn("place", place).filter(F.col("place") <= seed_n).groupBy("qid", "node_ord").agg(F.max("score").alias("score"))
    named = claims.filter("source_title is not null").select("qid", F.col("source_title").alias("title")).distinct()
    rest = nodes.join(named, ["qid", "title"]).select("qid", "node_ord").join(best, ["qid", "node_ord"], "left_anti")
    return best.unionByName(rest.withColumn("score", F.lit(None).cast("double")))


def claim_pool(questions: DataFrame, claims: DataFrame, nodes: DataFrame, typed: DataFrame, seed_n: int = 5, most: int = 2) -> DataFrame:
    """Nodes within ``most`` directed hops of the seeds, with ``hop``, ``graph`` and ``semantic`` (null for other than seeds by score)."""
    seeds = claim_seeds(questions, claims, nodes, seed_n)
    found = seeds.select("qid", "node_ord").withColumn("hop", F.lit(0))
    front, arcs = found, typed.select("qid", F.col("src").alias("node_ord"), "dst")
    for h in range(1, most + 1):
        step = front.select("qid", "node_ord").join(arcs, ["qid", "node_ord"]).select("qid", F.col("dst").alias("node_ord")).distinct()
        front = step.join(found, ["qid", "node_ord"], "left_anti").withColumn("hop", F.lit(h))
        found = found.unionByName(front)
    out = nodes.join(found, ["qid", "node_ord"]).join(seeds.withColumnRenamed("score", "semantic"), ["qid", "node_ord"], "left")
    return out.withColumn("graph", 1 / (1 + F.col("hop")))


def verified_claims(plans: DataFrame, claims: DataFrame, pool: DataFrame, judge: Judge, levels: int = 4, threshold: float = 0.7, top_k: int = 5, prefilter_k: int = 8, temperature: float = 1.0, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``qid, claim, rank, key, confidence, raw, bindings, quote`` of claims, sources before what depends on them.

    A claim on a variable looks only at passages whose title is an alias of a value found for it.
    ``judge`` turns ``qid, claim, key, query, subject, object, title, text, variables, constraints,
    linkable`` into ``qid, claim, key, label, confidence, bindings, quote``.  ``cut`` may write a level's
    result, so that the next does not repeat it; claims deeper than ``levels`` stay uncovered.
    """
    if not 0 <= threshold <= 1 or top_k <= 0 or prefilter_k < top_k or temperature <= 0:
        raise ValueError("thresholds, sizes or temperature out of range")
    deps = plans.select("qid", F.explode("deps").alias("d")).select("qid", "d.source", F.col("d.target").alias("id"), "d.binding")
    shared = plans.select("qid", F.array_distinct(F.transform("deps", lambda x: x["binding"])).alias("shared"))
    ends = claims.join(plans.select("qid", F.explode("sinks").alias("id")), ["qid", "id"]).groupBy("qid").agg(F.collect_set("object").alias("terminal"))
    c = claims.join(deps, ["qid", "id"], "left").join(shared, "qid").join(ends, "qid")
    n = pool.select("qid", F.col("node_ord").cast("string").alias("key"), "title", "text", methods.words(F.concat("title", F.lit(": "), "text")).alias("sw"), T.mention(F.concat("title", F.lit(": "), "text")).alias("m"))
    titles = pool.select("qid", "title").distinct().select("qid", "title", T.alias(F.col("title")).alias("ta"), T.mention(F.col("title")).alias("t"))
    done = None
    ready = c.filter("source is null").withColumn("allowed", F.lit(None).cast("string"))
    for level in range(levels):
        if level:
            values = done.select("qid", F.col("claim").alias("source"), F.explode("bindings").alias("binding", "value")).filter("value is not null").distinct()
            values = values.withColumn("va", T.alias(F.col("value")))
            ready = previous.select("qid", F.col("id").alias("source")).join(c, ["qid", "source"])
            able = ready.join(values, ["qid", "source", "binding"]).join(titles, "qid").filter(T.alias_same(F.col("va"), F.col("ta"))).select("qid", "id", F.col("title").alias("allowed")).distinct()
            ready = ready.join(able, ["qid", "id"])
        previous = ready.select("qid", "id").distinct()
        near = (F.col("source_title").isNull() | (F.col("source_title") == F.col("title"))) & (F.col("allowed").isNull() | (F.col("allowed") == F.col("title")))
        tasks = ready.join(n, "qid").filter(near).withColumn("score", methods.overlap(methods.words(F.col("query")), F.col("sw"))).withColumnRenamed("id", "claim")
        tasks = verify.prefiltered(tasks, prefilter_k)
        linkable = tasks.select("qid", "key", "m").dropDuplicates(["qid", "key"]).join(titles, "qid").filter(T.mentions(F.col("m"), F.col("t"))).groupBy("qid", "key").agg(F.array_sort(F.collect_set("title")).alias("linkable"))
        none = F.array().cast("array<string>")
        tasks = tasks.join(linkable, ["qid", "key"], "left").withColumns({
            "linkable": F.coalesce("linkable", none),
            "variables": T.claim_variables(F.col("subject"), F.col("object")),
            "constraints": F.when(F.col("subject").startswith("?"), F.create_map("subject", "title")).otherwise(F.create_map().cast("map<string,string>")),
        })
        j = judge(tasks).select("qid", "claim", "key", "label", "confidence", "bindings", "quote").join(tasks.drop("label", "confidence", "bindings", "quote"), ["qid", "claim", "key"])
        surface = F.concat("title", F.lit(": "), "text")
        links = F.filter("variables", lambda v: F.array_contains("shared", v))
        wrong = verify.grounding_reject(F.col("bindings"), F.col("variables"), F.col("constraints"), links, F.col("linkable"), F.col("terminal"), surface, F.col("text"), F.col("quote"))
        j = j.withColumn("confidence", T.calibrate(F.col("confidence"), temperature)).filter((F.col("label") == "entailed") & wrong.isNull() & (F.col("confidence") >= threshold))
        w = W.partitionBy("qid", "claim").orderBy(F.desc("confidence"), F.desc("score"), F.desc("key"))
        kept = j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
        kept = cut(kept.select("qid", "claim", "rank", "key", "confidence", F.col("score").alias("raw"), "bindings", T.project_quote(F.col("text"), F.col("quote"), F.map_values("bindings")).alias("projected"), "quote"))
        kept = kept.select("qid", "claim", "rank", "key", "confidence", "raw", "bindings", F.coalesce("projected", "quote").alias("quote"))
        done = kept if done is None else done.unionByName(kept)
    return done


def verified_paths(plans: DataFrame, assigned: DataFrame, pool: DataFrame, typed: DataFrame, judge: Judge, threshold: float = 0.7, most: int = 3, k: int = 3, temperature: float = 1.0) -> DataFrame:
    """``qid, rank, source, target, from_key, to_key, path, confidence, value``: paths of the pool that carry a dependency's binding.

    ``judge`` turns ``qid, source, target, binding, value, path`` into these with ``confidence``.
    """
    deps = plans.select("qid", F.explode("deps").alias("d")).select("qid", "d.source", "d.target", "d.binding")
    at = lambda name, key, value: assigned.select("qid", F.col("claim").alias(name), F.col("key").alias(key), F.explode("bindings").alias("binding", value)).filter(F.col(value).isNotNull()).withColumn(f"{value}_a", T.alias(F.col(value)))
    both = deps.join(at("source", "from_key", "value"), ["qid", "source", "binding"]).join(at("target", "to_key", "other"), ["qid", "target", "binding"])
    both = both.filter(T.alias_same(F.col("value_a"), F.col("other_a")))
    inside = pool.select("qid", "node_ord")
    arcs = typed.join(inside.withColumnRenamed("node_ord", "src"), ["qid", "src"]).join(inside.withColumnRenamed("node_ord", "dst"), ["qid", "dst"])
    ends = both.select("qid", F.col("from_key").cast("bigint").alias("src"), F.col("to_key").cast("bigint").alias("dst")).distinct()
    paths = graph.directed_paths(arcs, ends, most, k)
    carried = graph.grounded_values(paths, arcs, pool).select("qid", "path", F.explode("values").alias("carried")).withColumn("carried_a", T.alias(F.col("carried")))
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    tasks = both.join(paths.select("qid", F.col("src").cast("string").alias("from_key"), F.col("dst").cast("string").alias("to_key"), "path", "path_rank"), ["qid", "from_key", "to_key"])
    tasks = tasks.join(carried, ["qid", "path"]).filter(T.alias_same(F.col("value_a"), F.col("carried_a")))
    tasks = tasks.select("qid", "source", "target", "binding", "value", "from_key", "to_key", text("path").alias("path"), "path_rank").distinct()
    grounded_rank = F.row_number().over(W.partitionBy("qid", "source", "target", "from_key", "to_key").orderBy("path_rank"))
    tasks = tasks.withColumn("path_rank", grounded_rank)
    j = judge(tasks).withColumn("confidence", T.calibrate(F.col("confidence"), temperature)).filter(F.col("confidence") >= threshold)
    rank = F.row_number().over(W.partitionBy("qid", "source", "target").orderBy("path_rank", F.desc("confidence"), "path", "from_key", "to_key"))
    return j.withColumn("rank", rank).select("qid", "rank", "source", "target", "from_key", "to_key", "path", "confidence", "value")


def certified(questions: DataFrame, plans: DataFrame, nodes: DataFrame, judge: Judge, path_judge: Judge, budgets: list[int], levels: int = 4, seed_n: int = 5, most: int = 2, path_hops: int = 3, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``qid, budget, error, cost, bottleneck, keys, assigned, states``: one row for each question and budget, whatever fails.

    ``plans`` is ``qid, plan`` (JSON).  Errors: ``plan_invalid``, ``claim_uncovered``,
    ``dependency_unverified``, ``search_space_exhausted``, ``no_feasible_witness``.
    """
    p = cut(certify.parsed(plans))
    good = p.filter("error is null")
    c = certify.grounded(certify.claims(good), nodes.select("qid", "title"))
    typed = cut(graph.typed(nodes))
    pool = cut(claim_pool(questions, c, nodes, typed, seed_n, most))
    assigned = cut(verified_claims(good, c, pool, judge, levels, cut=cut))
    paths = cut(verified_paths(good, assigned, pool, typed, path_judge, most=path_hops))
    found = certify.witnesses(good, assigned, paths, pool.select("qid", F.col("node_ord").cast("string").alias("key"), "title", "text"), budgets)
    deps = good.select("qid", F.explode("deps").alias("d")).select("qid", "d.source", "d.target")
    open_ = deps.join(paths.select("qid", "source", "target").distinct(), ["qid", "source", "target"], "left_anti").select("qid").distinct().withColumn("open", F.lit(True))
    found = found.join(open_, "qid", "left").withColumn("error", F.when((F.col("error") == "no_feasible_witness") & F.col("open"), "dependency_unverified").otherwise(F.col("error"))).drop("open")
    bad = p.filter("error is not null").select(F.col("qid").cast("bigint").alias("qid"), F.explode(F.array(*map(F.lit, budgets))).cast("bigint").alias("budget"), F.lit("plan_invalid").alias("error"))
    return found.unionByName(bad, allowMissingColumns=True)
