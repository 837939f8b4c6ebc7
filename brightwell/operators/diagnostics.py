"""What a run's selections did to the gold evidence: reachability, rescues, failures, and a probe of the graph order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fusion


def logged_candidates(c: DataFrame) -> DataFrame:
    """``qid, candidates``: a question's candidates as an array of structs, in their order."""
    x = F.struct("ord", "title", "semantic", "graph", "hop", F.col("cost").alias("text_tokens"))
    return c.groupBy("qid").agg(F.array_sort(F.collect_list(x)).alias("candidates"))


def score_only(logged: DataFrame, score: str, budget: int = 200) -> DataFrame:
    """``qid, ord``: the prefix of logged candidates by one score, up to the first that overflows; null counts as 0."""
    rows = logged.select("qid", F.explode("candidates").alias("x")).select("qid", "x.*")
    w = W.partitionBy("qid").orderBy(F.coalesce(score, F.lit(0.0)).desc(), "ord").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("text_tokens").over(w)).filter(F.col("used") <= budget).select("qid", "ord")


def reachability(gold: DataFrame, pool: DataFrame, budget: int = 200) -> DataFrame:
    """Recall of ``gold (qid, node_ord, n_tokens)`` within one and two hops of ``pool (qid, node_ord, hop)``, and whether it fits."""
    j = gold.join(pool.select("qid", "node_ord", "hop"), ["qid", "node_ord"], "left")
    n = F.count("*")
    g = j.groupBy("qid").agg((F.count_if(F.col("hop") <= 1) / n).alias("one_hop_recall"), (F.count("hop") / n).alias("two_hop_recall"), (F.count("hop") == n).cast("double").alias("reachable"), F.sum("n_tokens").alias("gold_tokens"))
    return g.withColumn("fits", (F.col("gold_tokens") <= budget).cast("double"))


def rescue(selected: Column, without: Column, gold: Column) -> list[Column]:
    """Of two selections (arrays): whether they differ, right and wrong additions, gold added and displaced."""
    added, displaced = F.array_except(selected, without), F.array_except(without, selected)
    some = lambda a: (F.size(a) > 0).cast("double")
    return [
        F.greatest(some(added), some(displaced)).alias("activated"),
        some(F.array_intersect(added, gold)).alias("correct_rescue"),
        some(F.array_except(added, gold)).alias("false_rescue"),
        F.size(F.array_intersect(added, gold)).alias("gold_added"),
        F.size(F.array_intersect(displaced, gold)).alias("gold_displaced"),
    ]


def failures(df: DataFrame) -> DataFrame:
    """One row for each stage at which a question failed, or ``No diagnosed failure``.

    ``df`` has booleans ``seed_hit, reachable, fits, false_rescue, selected_all, conditional_gold,
    route_wrong`` and ``em`` (null: not answered).
    """
    c = F.col
    stages = [
        ("Seed miss", ~c("seed_hit")),
        ("Graph reachability miss", ~c("reachable")),
        ("Budget infeasible", ~c("fits")),
        ("Graph false rescue", c("false_rescue")),
        ("Pair/pruning error", c("reachable") & c("fits") & ~c("selected_all")),
        ("Generation error", c("selected_all") & F.coalesce(c("em") == 0, F.lit(False))),
        ("Conditional scoring error", c("conditional_gold") & ~c("selected_all")),
        ("Router error", c("route_wrong")),
    ]
    found = F.filter(F.array(*[F.when(holds, F.lit(name)) for name, holds in stages]), lambda x: x.isNotNull())
    return df.withColumn("stage", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No diagnosed failure")))))


def rescue_observations(c: DataFrame, gold: DataFrame, budget: int) -> DataFrame:
    """What a graph order would save of the gold facts that the semantic selection misses, by question.

    ``c`` are candidates, ``gold (qid, ord)`` facts, also such that are no candidates.  The random
    baseline is the mean of a draw of as many candidates as the graph selects, in closed form.
    """
    w = W.partitionBy("qid")
    c = c.withColumns({"sem": F.coalesce("semantic", F.lit(0.0)), "gra": F.coalesce("graph", F.lit(0.0))})
    run = lambda col: F.sum("cost").over(w.orderBy(F.col(col).desc(), "ord").rowsBetween(W.unboundedPreceding, 0)) <= budget
    c = c.withColumns({"in_semantic": run("sem"), "in_graph": run("gra"), "rs": fusion.semantic_place(), "rg": fusion.graph_place(), "n": F.count("*").over(w)})
    c = c.withColumn("kth_place", F.least(F.greatest(F.lit(1), F.count_if("in_semantic").over(w)), F.col("n")))
    j = c.join(gold.select("qid", "ord", F.lit(True).alias("g")), ["qid", "ord"], "left").withColumn("g", F.coalesce("g", F.lit(False)))
    missed = F.col("g") & ~F.col("in_semantic")
    seeds = F.count_if(F.col("hop") == 0)
    either = F.count_if(F.col("in_semantic") | F.col("in_graph"))
    o = j.groupBy("qid").agg(
        F.count_if("g").alias("candidate_gold"),
        F.count_if(F.col("g") & F.col("in_semantic")).alias("semantic_gold"),
        F.count_if(F.col("g") & F.col("in_graph")).alias("graph_gold"),
        F.count_if(F.col("g") & (F.col("in_semantic") | F.col("in_graph"))).alias("union_gold"),
        F.count_if(missed).alias("misses"),
        F.count_if(missed & F.col("in_graph")).alias("rescued"),
        (F.count_if(missed) * F.count_if("in_graph") / F.count("*")).alias("random_rescued"),
        F.sum(F.when(missed, 1 - (F.col("rg") - 1) / F.greatest(F.lit(1), F.col("n") - 1))).alias("missed_percentiles"),
        F.when(either > 0, 1 - F.count_if(F.col("in_semantic") & F.col("in_graph")) / either).otherwise(0.0).alias("disagreement"),
        F.avg(F.when(F.col("rs") <= 2, F.col("sem"))).alias("top2"),
        F.max(F.when(F.col("rs") == F.col("kth_place"), F.col("sem"))).alias("kth"),
        (F.max("gra") - F.max(F.when(F.col("rg") == F.floor(F.col("n") / 2) + 1, F.col("gra")))).alias("peak"),
        F.when(seeds > 0, F.count_if((F.col("hop") == 0) & ~F.col("in_semantic")) / seeds).otherwise(0.0).alias("seed_miss"),
    )
    total = gold.groupBy("qid").agg(F.count("*").alias("gold_total"))
    return o.join(total, "qid").withColumns({"semantic_complete": F.col("semantic_gold") == F.col("gold_total"), "union_complete": F.col("union_gold") == F.col("gold_total")})


def rescue_summary(o: DataFrame) -> DataFrame:
    """One row: recalls as ratios of sums, rescue rates, and the mean place of what is missed."""
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    open_ = ~F.col("semantic_complete")
    return o.agg(
        F.count("*").alias("questions"),
        share("candidate_gold", "gold_total").alias("candidate_recall"),
        share("semantic_gold", "gold_total").alias("semantic_recall"),
        share("graph_gold", "gold_total").alias("graph_recall"),
        share("union_gold", "gold_total").alias("union_recall"),
        F.count_if(open_).alias("incomplete"),
        F.count_if(open_ & F.col("union_complete")).alias("recovered"),
        F.sum("misses").alias("misses"),
        share("rescued", "misses").alias("rescue_rate"),
        share("random_rescued", "misses").alias("random_rate"),
        share("missed_percentiles", "misses").alias("missed_percentile"),
    )


def rescue_features(o: DataFrame) -> DataFrame:
    """Means of the signals over questions that are complete, incomplete, and rescued; the groups overlap."""
    groups = F.filter(F.array(F.when(F.col("semantic_complete"), "semantic_complete").otherwise("semantic_incomplete"), F.when(~F.col("semantic_complete") & (F.col("rescued") > 0), "rescued")), lambda x: x.isNotNull())
    return o.select(F.explode(groups).alias("group"), "disagreement", "top2", "kth", "peak", "seed_miss").groupBy("group").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("disagreement", "top2", "kth", "peak", "seed_miss")])
