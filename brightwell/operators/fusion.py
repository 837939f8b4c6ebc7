"""Score normalisation, fusion and adaptive blending over ``qid, ord, semantic, graph`` tables, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF = 60


def blend(alpha: float, a: str = "semantic", b: str = "graph") -> Column:
    return alpha * F.coalesce(a, F.lit(0.0)) + (1 - alpha) * F.coalesce(b, F.lit(0.0))


def percentile(column: str, optional: bool = False) -> Column:
    """Average-rank percentile within qid (not ``percent_rank``, which takes the lowest rank of ties)."""
    w = W.partitionBy("qid", F.col(column).isNull())
    n, tied = F.count("*").over(w), F.count("*").over(W.partitionBy("qid", F.col(column).isNull(), column))
    low = F.rank().over(w.orderBy(column)) - 1
    value = F.when(n == 1, 1.0).otherwise((low + (tied - 1) / 2) / (n - 1))
    return F.when(F.col(column).isNull(), 0.0).otherwise(value) if optional else value


def with_percentiles(c: DataFrame) -> DataFrame:
    """A missing score counts as 0."""
    zero = c.withColumns({"sem_": F.coalesce("semantic", F.lit(0.0)), "gra_": F.coalesce("graph", F.lit(0.0))})
    return zero.withColumns({"p_semantic": percentile("sem_"), "p_graph": percentile("gra_")}).drop("sem_", "gra_")


def reciprocal(alpha: float) -> Column:
    place = lambda c: F.row_number().over(W.partitionBy("qid").orderBy(F.col(c).desc(), "ord"))
    return alpha / (RRF + place("semantic")) + (1 - alpha) / (RRF + place("graph"))


def softmax_share(column: str, temperature: float) -> Column:
    """A candidate's share of the softmax mass of its question."""
    w = W.partitionBy("qid")
    e = lambda: F.exp((F.col(column) - F.max(column).over(w)) / temperature)
    return e() / F.sum(e()).over(w)


def covered_mass(share: str, *order: Column) -> Column:
    """Mass of a candidate and all before it."""
    return F.sum(share).over(W.partitionBy("qid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def density(utility: Column, cost: Column, eta: float = 1.0) -> Column:
    return utility / F.pow(F.greatest(F.lit(1), cost), F.lit(eta))


def place(column: str) -> Column:
    return F.row_number().over(W.partitionBy("qid").orderBy(F.col(column).desc(), "ord"))


def graph_place() -> Column:
    """Place in the graph order; equal graph scores by the semantic one, then by ``ord``."""
    return F.row_number().over(W.partitionBy("qid").orderBy(F.coalesce("graph", F.lit(0.0)).desc(), F.coalesce("semantic", F.lit(0.0)).desc(), "ord"))


def semantic_place() -> Column:
    return F.row_number().over(W.partitionBy("qid").orderBy(F.coalesce("semantic", F.lit(0.0)).desc(), "ord"))


def top_sets(c: DataFrame, k: int) -> DataFrame:
    """``in_semantic, in_graph``: whether a candidate is among the first ``k`` of either order."""
    return c.withColumns({"rs": semantic_place(), "rg": graph_place()}).withColumns({"in_semantic": F.col("rs") <= k, "in_graph": F.col("rg") <= k})


def _disagreement() -> Column:
    both, either = F.count_if(F.col("in_semantic") & F.col("in_graph")), F.count_if(F.col("in_semantic") | F.col("in_graph"))
    return F.when(either > 0, 1 - both / either).otherwise(0.0)


def _missed() -> Column:
    """Share of the seeds (hop 0) that the semantic selection leaves out; 0 without seeds."""
    seeds = F.count_if(F.col("hop") == 0)
    return F.when(seeds > 0, F.count_if((F.col("hop") == 0) & ~F.col("in_semantic")) / seeds).otherwise(0.0)


def need_signals(c: DataFrame, budget: int | None = None, top_k: int | None = None) -> DataFrame:
    """Disagreement, best semantic score and missed seeds of the two pure selections at one operating point (the budget wins)."""
    c = c.withColumns({"sem": F.coalesce("semantic", F.lit(0.0)), "gra": F.coalesce("graph", F.lit(0.0))})
    by = {n: W.partitionBy("qid").orderBy(F.col(col).desc(), "ord") for n, col in (("in_semantic", "sem"), ("in_graph", "gra"))}
    if budget is not None:
        c = c.withColumns({n: F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0)) <= budget for n, w in by.items()})
    elif top_k is not None:
        c = c.withColumns({n: F.row_number().over(w) <= top_k for n, w in by.items()})
    else:
        c = c.withColumns({n: F.lit(True) for n in by})
    return c.groupBy("qid").agg(_disagreement().alias("disagreement"), F.max("sem").alias("best"), _missed().alias("seed_miss"))


def need_graph(s: DataFrame, base: float = 0.6) -> DataFrame:
    """Need for the graph from ``need_signals`` and the blends that follow: switched and continuous."""
    s = s.withColumn("need", F.round(0.5 * F.col("disagreement") + 0.3 * (1 - F.col("best")) + 0.2 * F.col("seed_miss"), 9))
    return s.withColumns({"alpha_switch": F.when(F.col("need") >= 0.36, 0.2).otherwise(base), "alpha_continuous": F.greatest(F.lit(0.1), F.least(F.lit(0.9), base - F.col("need")))})


def rescue_signals(c: DataFrame, k: int = 6) -> DataFrame:
    """Signals of the semantic-first blend, at the first ``k`` of both orders.

    The median is the element in the middle of the descending graph scores (the later one of two).
    """
    n = F.count("*").over(W.partitionBy("qid"))
    c = top_sets(c.withColumns({"sem": F.coalesce("semantic", F.lit(0.0)), "gra": F.coalesce("graph", F.lit(0.0))}), k).withColumn("n", n)
    return c.groupBy("qid").agg(
        _disagreement().alias("disagreement"),
        F.avg(F.when(F.col("rs") <= 2, F.col("sem"))).alias("top2"),
        F.max(F.when(F.col("rs") == F.least(F.lit(k), F.col("n")), F.col("sem"))).alias("kth"),
        (F.max("gra") - F.max(F.when(F.col("rg") == F.floor(F.col("n") / 2) + 1, F.col("gra")))).alias("peak"),
        _missed().alias("seed_miss"),
    )


def semantic_first(s: DataFrame) -> DataFrame:
    """``alpha`` of 1.0, 0.7 or 0.4: the graph comes in only where it looks like a rescue."""
    low = (F.col("disagreement") >= 0.60) & (F.col("seed_miss") >= 0.40) & (F.col("top2") < 0.90) & (F.col("peak") >= 0.65)
    mid = (F.col("disagreement") >= 0.50) & (F.col("kth") < 0.30) & ((F.col("seed_miss") >= 0.20) | (F.col("top2") < 0.85))
    return s.withColumn("alpha", F.when(low, 0.4).when(mid, 0.7).otherwise(1.0))
