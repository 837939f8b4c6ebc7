"""Composed plans: dense, fixed-hop and routed selection over nodes ``qid, node_ord, passage_ord, title, sent_id, text, n_tokens``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import text as T
from ..operators import graph, linked, selection


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Default pair scorer: cosine of two distinct word sets (arrays made once for each text)."""
    size = F.sqrt((F.size(a) * F.size(b)).cast("double"))
    return F.round(F.when(size > 0, F.size(F.array_intersect(a, b)) / size).otherwise(0.0), 6)


def scored(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every sentence of a question's passages with its ``semantic`` score."""
    q = questions.select("qid", words(F.col("question")).alias("qw"))
    n = nodes.withColumn("sw", words(F.col("text"))).join(q, "qid")
    return n.withColumn("semantic", overlap(F.col("qw"), F.col("sw"))).drop("qw", "sw")


def restarts(questions: DataFrame, nodes: DataFrame, n: int = 5) -> DataFrame:
    """All ``nodes``, also those of no question, the seeds with their ``restart`` (``graph.restart_weights``)."""
    q = questions.select("qid", F.struct(words(F.col("question")).alias("w")).alias("q"))
    s = nodes.join(q, "qid", "left")
    s = s.withColumn("semantic", F.when(F.col("q").isNotNull(), overlap(F.col("q.w"), words(F.col("text"))))).drop("q")
    s = ranked(s, n)
    return graph.restart_weights(s.withColumn("seed", F.when(F.col("rank") <= n, F.col("semantic"))), "seed").drop("seed")


def seeds(s: DataFrame, n: int = 5) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.desc("semantic"), "node_ord")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def ranked(s: DataFrame, n: int = 5) -> DataFrame:
    """All sentences, the seeds among them with their ``rank``, as the searches of ``linked`` start from them."""
    w = W.partitionBy("qid").orderBy(F.desc("semantic"), "node_ord")
    place = F.row_number().over(w)
    return s.withColumn("rank", F.when((place <= n) & F.col("semantic").isNotNull(), place))


def candidates(s: DataFrame) -> DataFrame:
    return s.withColumns({"ord": F.col("node_ord"), "cost": F.col("n_tokens")})


def dense(questions: DataFrame, nodes: DataFrame, budget: int = 200) -> DataFrame:
    return selection.topk(candidates(scored(questions, nodes).withColumn("graph", F.lit(0.0))), 1.0, budget=budget)


def fixed_hop(questions: DataFrame, nodes: DataFrame, edges: DataFrame | None, most: int, budget: int | None = 200, alpha: float = 1.0) -> DataFrame:
    """Best of the nodes within ``most`` hops of the seeds; the graph score is 1 / (1 + hop).

    Without ``edges`` along those of the nodes' own graph, which are not made for it.
    """
    s = scored(questions, nodes)
    near = linked.hops(ranked(s), most) if edges is None else graph.hops(edges, seeds(s), most)
    pool = s.join(near, ["qid", "node_ord"]).withColumn("graph", 1 / (1 + F.col("hop")))
    return selection.topk(candidates(pool), alpha, budget=budget)


def mentioned(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``qid, title, pos``: titles named in the question, in order (0 first)."""
    lists = nodes.groupBy("qid").agg(F.collect_set("title").alias("titles"))
    out = questions.join(lists, "qid").select("qid", T.mentioned_titles(F.col("question"), F.col("titles")).alias("t"))
    return out.select("qid", F.posexplode("t").alias("pos", "title"))


def anchors(s: DataFrame, most: int = 2, named: DataFrame | None = None) -> DataFrame:
    """Best sentence of each title, the best ``most`` titles.

    With ``named (qid, title, pos)`` the first ``most`` of these titles come first; the others fill up
    to ``most``, and one of them is taken even where the named ones suffice.
    """
    best = s.withColumn("place", F.row_number().over(W.partitionBy("qid", "title").orderBy(F.desc_nulls_last("semantic"), "node_ord"))).filter("place = 1").drop("place")
    order = [F.desc_nulls_last("semantic"), F.col("node_ord")]
    if named is None:
        return best.withColumn("anchor_rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).filter(F.col("anchor_rank") <= most)
    w = W.partitionBy("qid")
    best = best.join(named, ["qid", "title"], "left")
    best = best.withColumn("np", F.row_number().over(w.orderBy(F.asc_nulls_last("pos"), *order)))
    best = best.withColumn("first", F.col("pos").isNotNull() & (F.col("np") <= most)).withColumn("taken", F.count_if("first").over(w))
    best = best.withColumn("rest", F.row_number().over(W.partitionBy("qid", "first").orderBy(*order)))
    best = best.filter(F.col("first") | (F.col("rest") <= F.greatest(F.lit(1), most - F.col("taken"))))
    return best.withColumn("anchor_rank", F.row_number().over(w.orderBy(F.desc("first"), F.when(F.col("first"), F.col("np")).otherwise(F.col("rest"))))).drop("pos", "np", "first", "taken", "rest")


def links(questions: DataFrame, s: DataFrame, edges: DataFrame | None, anchor: DataFrame, top: int | None = 2, least_gain: float | None = None, least_score: float | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Cross-title neighbours of anchors, scored against the question with the anchor as known evidence.

    The best ``top`` of each anchor, then those with the least gain and score asked for; each endpoint
    keeps its best anchor.  Without ``edges`` the anchors are looked up in the graph of ``nodes``; anchors
    are few for each question and are broadcast.
    """
    known = F.concat(F.col("question"), F.lit("\nKnown evidence: "), F.col("title"), F.lit(": "), F.col("text"))
    a = anchor.join(questions.select("qid", "question"), "qid").select("qid", F.col("node_ord").alias("src"), F.col("title").alias("anchor_title"), "anchor_rank", words(known).alias("qw"))
    if edges is None:
        at = anchor.select("qid", "node_ord", F.col("anchor_rank").alias("rank"))
        e = linked.arcs(nodes.join(F.broadcast(at), ["qid", "node_ord"], "left")).withColumnRenamed("dst", "node_ord")
    else:
        e = graph.both_ways(edges).select("qid", "src", F.col("dst").alias("node_ord"))
    j = s.select("qid", "node_ord", "title", "semantic", "text").join(e, ["qid", "node_ord"]).join(F.broadcast(a), ["qid", "src"]).filter("title <> anchor_title").withColumn("sw", words(F.col("text")))
    j = j.withColumn("cond", overlap(F.col("qw"), F.col("sw"))).withColumn("gain", F.round(F.col("cond") - F.coalesce("semantic", F.lit(0.0)), 6))
    if top is not None:
        j = j.withColumn("place", F.row_number().over(W.partitionBy("qid", "src").orderBy(F.desc("cond"), "node_ord"))).filter(F.col("place") <= top)
    if least_score is not None:
        j = j.filter(F.col("cond") >= least_score)
    if least_gain is not None:
        j = j.filter(F.col("gain") >= least_gain)
    w = W.partitionBy("qid", "node_ord").orderBy(F.desc("cond"), "anchor_rank")
    return j.withColumn("best", F.row_number().over(w)).filter("best = 1").select("qid", F.col("src").alias("anchor"), "node_ord", "cond", "gain")


def pool(questions: DataFrame, nodes: DataFrame, edges: DataFrame | None, most: int = 2, seed_n: int = 5) -> DataFrame:
    """Candidates within ``most`` hops of the seeds, in the order of discovery: ``hop, path, graph = 1 / (1 + hop)``.

    Without ``edges`` along those of the nodes' own graph; the search is kept on disk, as callers read a pool several times.
    """
    s = scored(questions, nodes)
    if edges is None:
        found = linked.paths(ranked(s, seed_n), most).persist(StorageLevel.DISK_ONLY)
    else:
        found = graph.paths_from_seeds(edges, seeds(s, seed_n).select("qid", "node_ord", "rank"), most)
    order = F.row_number().over(W.partitionBy("qid").orderBy("hop", "disc"))
    return s.join(found, ["qid", "node_ord"]).withColumns({"graph": 1 / (1 + F.col("hop")), "ord": order, "cost": F.col("n_tokens")})


def _with_links(c: DataFrame, linked: DataFrame) -> DataFrame:
    """Candidates with ``anchor`` (as ``ord``), ``cond``, ``gain`` and ``validated``."""
    at = c.select("qid", F.col("node_ord").alias("anchor"), F.col("ord").alias("anchor_ord"))
    linked = linked.join(at, ["qid", "anchor"]).select("qid", "node_ord", F.col("anchor_ord").alias("anchor"), "cond", "gain")
    return c.join(linked, ["qid", "node_ord"], "left").withColumn("validated", F.col("anchor").isNotNull())


def routed_pairs(questions: DataFrame, nodes: DataFrame, edges: DataFrame | None, budget: int = 200, beta: float = 0.3) -> DataFrame:
    """Direct questions by coverage of their pool, others by anchor-endpoint pairs."""
    route = questions.select("qid", T.route(F.col("question")).alias("route"))
    c = pool(questions, nodes, edges).join(route, "qid")
    direct = selection.coverage(c.filter("route = 'direct_comparison'"), budget, 0.0)
    others = c.filter("route <> 'direct_comparison'")
    return direct.unionByName(selection.pair_fold(_with_links(others, links(questions, others, edges, anchors(others), nodes=nodes)), beta, budget))


def routed_witnesses(questions: DataFrame, nodes: DataFrame, edges: DataFrame | None, budget: int = 200, beta: float = 0.3, least: float = 0.015, titles_on_bridge: bool = False) -> DataFrame:
    """The least witness that the route asks for.

    Direct questions: one sentence for each named title, of all sentences.  Others: validated pairs with
    a gain of 0 or more, two on a bridge (its anchors are named titles first), one on a chain.
    ``titles_on_bridge`` also prefers named titles among a bridge's pairs.
    """
    route = questions.select("qid", T.route(F.col("question"), T.RELATION_PLURAL).alias("route"))
    named = mentioned(questions, nodes)
    preferred = named.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("preferred"))
    every = candidates(scored(questions, nodes)).join(route, "qid").join(preferred, "qid", "left")
    direct = every.filter("route = 'direct_comparison'").withColumn("graph", F.lit(0.0))
    out = selection.entity_witness(direct, budget, 2, 0, least=least, serialized=True)
    around = pool(questions, nodes, edges).join(route, "qid").join(preferred, "qid", "left")
    for kind, chains, fallback, first in (("bridge_comparison", 2, 4, named), ("chained_reasoning", 1, 2, None)):
        c = around.filter(F.col("route") == kind)
        if not (titles_on_bridge and kind == "bridge_comparison"):
            c = c.drop("preferred")
        c = _with_links(c, links(questions, c, edges, anchors(c, 2, first), least_gain=0.0, nodes=nodes))
        out = out.unionByName(selection.chain_witness(c, budget, chains, fallback, beta=beta, least=least, serialized=True))
    return out
