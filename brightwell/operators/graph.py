"""Per-question sentence graphs as edge tables ``qid, src, dst, kind, weight``; all joins are equi-joins on qid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

WEIGHTS = {"same_passage": 1.0, "entity_overlap": 1.0, "title_mention": 2.0}
DAMPING = 0.85


def adjacency(nodes: DataFrame) -> DataFrame:
    """Neighbouring sentences of a passage."""
    after = F.lead("node_ord").over(W.partitionBy("qid", "passage_ord").orderBy("sent_id"))
    return nodes.select("qid", F.col("node_ord").alias("src"), after.alias("dst"), F.lit("same_passage").alias("kind"), F.lit(1.0).alias("weight")).filter("dst is not null")


def entity_overlap(nodes: DataFrame, once: bool = True) -> DataFrame:
    """Sentences of different titles with a common entity: an equi-join on the entity, not on overlap.

    Each pair ``once``, or as often as it has common entities, which saves an exchange.
    """
    e = nodes.select("qid", "node_ord", "title", F.explode(T.entities(F.col("text"))).alias("entity"))
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.node_ord") < F.col("b.node_ord")) & (F.col("a.title") != F.col("b.title")))
    pairs = pairs.select(F.col("a.qid").alias("qid"), F.col("a.node_ord").alias("src"), F.col("b.node_ord").alias("dst"))
    return (pairs.distinct() if once else pairs).withColumns({"kind": F.lit("entity_overlap"), "weight": F.lit(1.0)})


def title_mention(nodes: DataFrame) -> DataFrame:
    """From a sentence that names another passage's title to all sentences of that passage.

    What is compared is made once for each sentence and title; the rest is a join within the question.
    """
    titles = nodes.select("qid", "title").distinct().withColumn("t", T.mention(F.col("title")))
    n = nodes.select("qid", "node_ord", F.col("title").alias("own"), T.mention(F.col("text")).alias("m"))
    named = n.join(titles, "qid").filter((F.col("own") != F.col("title")) & T.mentions(F.col("m"), F.col("t")))
    out = named.select("qid", F.col("node_ord").alias("src"), "title").join(nodes.select("qid", "title", F.col("node_ord").alias("dst")), ["qid", "title"])
    return out.select("qid", "src", "dst", F.lit("title_mention").alias("kind"), F.lit(2.0).alias("weight"))


def merged(*edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Undirected edges, each once: all kinds in order, and the kind and weight of the heaviest."""
    if unknown := set(kinds or []) - set(WEIGHTS):
        raise ValueError(f"unknown edge types {sorted(unknown)}")
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    if kinds is not None:
        every = every.filter(F.col("kind").isin(kinds))
    phase = F.when(F.col("kind") == "same_passage", 0).when(F.col("kind") == "entity_overlap", 1).otherwise(2)
    seq = F.struct(phase.alias("phase"), F.col("src").alias("i"), F.col("dst").alias("j"))
    every = every.select("qid", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "kind", "weight", seq.alias("seq"))
    return every.groupBy("qid", "src", "dst").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.max("weight").alias("weight"),
        F.max(F.struct("weight", "kind")).getField("kind").alias("kind"),
        F.min("seq").alias("seq"),
    )


def typed(nodes: DataFrame) -> DataFrame:
    """Directed edges ``qid, src, dst, kinds``: next and previous sentence, common entity (both ways), title mention (one way)."""
    arc = lambda e, a, b, kind: e.select("qid", F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("kind"))
    near, shared = adjacency(nodes), entity_overlap(nodes)
    every = arc(near, "src", "dst", "next").unionByName(arc(near, "dst", "src", "previous"))
    every = every.unionByName(arc(shared, "src", "dst", "entity_coreference")).unionByName(arc(shared, "dst", "src", "entity_coreference"))
    every = every.unionByName(arc(title_mention(nodes), "src", "dst", "title_mention"))
    return every.groupBy("qid", "src", "dst").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def neighbours(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """``qid, node_ord, neighbours``: adjacent nodes inside ``pool (qid, node_ord)``, in the order of the edges."""
    inside = pool.select("qid", "node_ord").distinct()
    arcs = both_ways(edges, "seq").join(inside.select("qid", F.col("node_ord").alias("src")), ["qid", "src"]).join(inside.select("qid", F.col("node_ord").alias("dst")), ["qid", "dst"])
    lists = arcs.groupBy("qid", F.col("src").alias("node_ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "dst"))), lambda x: x["dst"]).alias("neighbours"))
    return inside.join(lists, ["qid", "node_ord"], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    e = edges.select("qid", "src", "dst", "weight", *more)
    return e.unionByName(e.select("qid", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", *more))


def hops(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """Least hop of each node from ``seeds (qid, node_ord)``: unrolled frontiers, visited nodes by anti-join."""
    found = seeds.select("qid", "node_ord").distinct().withColumn("hop", F.lit(0))
    front, arcs = found, both_ways(edges).select("qid", F.col("src").alias("node_ord"), "dst")
    for h in range(1, most + 1):
        step = front.select("qid", "node_ord").join(arcs, ["qid", "node_ord"]).select("qid", F.col("dst").alias("node_ord")).distinct()
        front = step.join(found, ["qid", "node_ord"], "left_anti").withColumn("hop", F.lit(h))
        found = found.unionByName(front)
    return found


def paths_from_seeds(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """``qid, node_ord, hop, disc, path``: breadth-first from ``seeds (qid, node_ord, rank)``.

    A node's parent is the one that discovers it first: nodes in the order of their discovery, each
    one's edges in the order of ``seq``.  ``path`` goes from the seed to the node.
    """
    arcs = both_ways(edges, "seq").select("qid", F.col("src").alias("node_ord"), "dst", "seq")
    front = seeds.groupBy("qid", "node_ord").agg(F.min("rank").cast("bigint").alias("disc")).withColumns({"hop": F.lit(0), "path": F.array("node_ord")})
    found = front
    for h in range(1, most + 1):
        step = front.join(arcs, ["qid", "node_ord"]).select("qid", F.col("dst").alias("node_ord"), F.struct("disc", "seq").alias("by"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("qid", "node_ord").agg(F.min("by").alias("by"), F.min_by("path", "by").alias("path")).join(found.select("qid", "node_ord"), ["qid", "node_ord"], "left_anti")
        disc = F.row_number().over(W.partitionBy("qid").orderBy("by")).cast("bigint")
        front = step.select("qid", "node_ord", disc.alias("disc"), F.lit(h).alias("hop"), "path")
        found = found.unionByName(front)
    return found.select("qid", "node_ord", "hop", "disc", "path")


def simple_paths(edges: DataFrame, pairs: DataFrame, most: int = 3, k: int = 3) -> DataFrame:
    """Up to ``k`` shortest simple paths between ``pairs (qid, src, dst)``, ties in path order.

    The last step is a look-up of the end, and pairs that have ``k`` paths walk no further.
    """
    return directed_paths(both_ways(edges), pairs, most, k)


def directed_paths(edges: DataFrame, pairs: DataFrame, most: int = 3, k: int = 3) -> DataFrame:
    """``simple_paths`` along edges in their own direction; a pair of equal ends has the path of one node."""
    arcs = edges.select("qid", F.col("src").alias("at"), F.col("dst").alias("to"))
    walk = pairs.select("qid", "src", "dst", F.col("src").alias("at"), F.array("src").alias("path"))
    ended = walk.filter("src = dst").select("qid", "src", "dst", "path", F.lit(0).alias("hops"))
    walk = walk.filter("src <> dst")
    for h in range(1, most + 1):
        last = arcs.select("qid", "at", F.col("to").alias("dst"))
        done = walk.join(last, ["qid", "at", "dst"]).select("qid", "src", "dst", F.concat("path", F.array("dst")).alias("path"), F.lit(h).alias("hops"))
        ended = ended.unionByName(done)
        if h < most:
            full = ended.groupBy("qid", "src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
            walk = walk.join(full, ["qid", "src", "dst"], "left_anti").join(arcs, ["qid", "at"]).filter((F.col("to") != F.col("dst")) & ~F.array_contains("path", F.col("to")))
            walk = walk.select("qid", "src", "dst", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
    rank = F.row_number().over(W.partitionBy("qid", "src", "dst").orderBy("hops", "path"))
    return ended.withColumn("path_rank", rank).filter(F.col("path_rank") <= k)


def grounded_values(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``qid, path, values``: what a path of typed edges carries.

    A path of one node carries its entities, a title mention the title it leads to, a common entity the
    entities of both sentences.
    """
    n = nodes.select("qid", "node_ord", "title", T.entities(F.col("text")).alias("entities"))
    each = paths.select("qid", "path").distinct()
    single = each.filter(F.size("path") == 1).select("qid", "path", F.get("path", F.lit(0)).alias("node_ord")).join(n, ["qid", "node_ord"]).select("qid", "path", F.explode("entities").alias("value"))
    steps = each.select("qid", "path", F.explode(F.transform(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda x, i: F.struct(F.get("path", i).alias("src"), x.alias("dst")))).alias("s")).select("qid", "path", "s.*")
    steps = steps.join(edges.select("qid", "src", "dst", "kinds"), ["qid", "src", "dst"])
    a, b = n.select("qid", F.col("node_ord").alias("src"), F.col("entities").alias("ea")), n.select("qid", F.col("node_ord").alias("dst"), "title", F.col("entities").alias("eb"))
    steps = steps.join(a, ["qid", "src"]).join(b, ["qid", "dst"])
    none = F.array().cast("array<string>")
    carried = F.concat(F.when(F.array_contains("kinds", "title_mention"), F.array("title")).otherwise(none), F.when(F.array_contains("kinds", "entity_coreference"), F.array_intersect("ea", "eb")).otherwise(none))
    found = single.unionByName(steps.select("qid", "path", F.explode(carried).alias("value"))).filter("value <> ''")
    lists = found.groupBy("qid", "path").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return each.join(lists, ["qid", "path"], "left").withColumn("values", F.coalesce("values", none))


def _power(pdf: pd.DataFrame, restart: dict[int, float], rounds: int = 100) -> pd.DataFrame:
    ids = np.unique(np.concatenate([pdf.src, pdf.dst, list(restart)]).astype(np.int64))
    at = {int(i): k for k, i in enumerate(ids)}
    n, m = len(ids), np.zeros((len(ids), len(ids)))
    for s, d, w in zip(pdf.src, pdf.dst, pdf.weight, strict=True):
        m[at[int(s)], at[int(d)]] += w
        m[at[int(d)], at[int(s)]] += w
    out = m.sum(1)
    p = np.zeros(n)
    for k, v in restart.items():
        p[at[int(k)]] = max(0.0, v)
    p = p / p.sum() if p.sum() else np.full(n, 1 / n)
    x = p.copy()
    for _ in range(rounds):
        share = np.divide(x, out, out=np.zeros(n), where=out > 0)
        new = DAMPING * (share @ m + x[out == 0].sum() * p) + (1 - DAMPING) * p
        if np.abs(new - x).sum() < n * 1e-6:
            x = new
            break
        x = new
    return pd.DataFrame({"node_ord": ids, "score": x})


def pagerank(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank of each question's graph (a few hundred nodes), restarting at ``seeds (qid, node_ord, restart)``."""

    def run(key: tuple, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(e) and not len(s):
            return pd.DataFrame({"qid": [], "node_ord": [], "score": []})
        return _power(e, dict(zip(s.node_ord, s.restart, strict=True))).assign(qid=key[0])[["qid", "node_ord", "score"]]

    return edges.select("qid", "src", "dst", "weight").groupBy("qid").cogroup(seeds.select("qid", "node_ord", "restart").groupBy("qid")).applyInPandas(run, "qid bigint, node_ord bigint, score double")


def restart_weights(seeds: DataFrame, score: str = "semantic", temperature: float = 0.1) -> DataFrame:
    w = W.partitionBy("qid")
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return seeds.withColumn("e", e).withColumn("restart", F.col("e") / F.sum("e").over(w)).drop("e")


def pool_normalised(scores: DataFrame, column: str = "score") -> DataFrame:
    top = F.max(column).over(W.partitionBy("qid"))
    return scores.withColumn(column, F.when(top > 0, F.col(column) / top).otherwise(0.0))
