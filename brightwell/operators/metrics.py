"""Answer and evidence metrics, run validation and paired statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARGIN = -0.02


def evidence_scores(selected: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """Precision, recall, F1 and exact match of selected against gold keys (sets) per qid."""
    s = selected.select("qid", *key).distinct().withColumn("s", F.lit(1))
    g = gold.select("qid", *key).distinct().withColumn("g", F.lit(1))
    n = s.join(g, ["qid", *key], "full_outer").groupBy("qid").agg(F.count(F.col("s") * F.col("g")).alias("tp"), F.count("s").alias("ns"), F.count("g").alias("ng"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumns({"prec": div(F.col("tp"), F.col("ns")), "recall": div(F.col("tp"), F.col("ng"))})
    return n.select("qid", ((F.col("tp") == F.col("ns")) & (F.col("tp") == F.col("ng"))).cast("int").alias("em"), div(2 * F.col("prec") * F.col("recall"), F.col("prec") + F.col("recall")).alias("f1"), "prec", "recall")


def group_means(df: DataFrame, keys: list[str], values: list[str], null_as_zero: bool = False) -> DataFrame:
    mean = lambda v: F.avg(F.coalesce(v, F.lit(0.0)) if null_as_zero else F.col(v))
    return df.groupBy(*keys).agg(*[mean(v).alias(v) for v in values], F.count("*").alias("n"))


def paired(df: DataFrame, reference: str, value: str) -> DataFrame:
    """Mean difference of each other method to ``reference`` over the qids that have both."""
    r = df.filter(F.col("method") == reference).select("qid", F.col(value).alias("r"))
    d = df.filter(F.col("method") != reference).join(r, "qid").filter(F.col(value).isNotNull() & F.col("r").isNotNull())
    return d.groupBy("method").agg(F.count("*").alias("n"), F.avg("r").alias("mean_reference"), F.avg(value).alias("mean_method"), F.avg(F.col("r") - F.col(value)).alias("delta"))


def bootstrap(df: DataFrame, group: str, value: str, order: str, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean, resampled with a seeded generator in ``order``; in chunks, so memory is bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values([order, value])[value].dropna().to_numpy(float)
        rng, means = np.random.default_rng(seed), []
        step = max(1, 2_000_000 // max(1, len(x)))
        for at in range(0, rounds, step):
            means.append(x[rng.integers(0, len(x), (min(step, rounds - at), len(x)))].mean(1))
        low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [len(x)], "mean": [x.mean()], "ci_low": [low], "ci_high": [high], "non_inferior": [bool(low >= MARGIN)]})

    return df.select(group, value, order).groupBy(group).applyInPandas(run, f"{group} string, n bigint, mean double, ci_low double, ci_high double, non_inferior boolean")


def validation(df: DataFrame, budget: Column, used: Column) -> DataFrame:
    """One row of invariants of a run."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("qid").alias("n_qids"),
        (F.count("*") - F.count_distinct("qid", "method", "budget_tokens")).alias("duplicate_keys"),
        F.sum((used > budget).cast("bigint")).alias("budget_violations"),
        F.count_distinct("method").alias("n_methods"),
    )


def need_bucket(gold: Column, semantic: Column, graph: Column) -> Column:
    return F.when(F.size(F.array_except(gold, semantic)) == 0, "sufficient").when(F.size(F.array_except(gold, F.array_union(semantic, graph))) == 0, "blind").otherwise("unrecoverable")


def first_use(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Marks all but the first row of equal prompts as reused."""
    return df.withColumn("reused", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) > 1)


def error_histogram(rows: DataFrame) -> DataFrame:
    """Rows by error code, overall (``overall`` 1, qtype null) and by question type; null codes are rows without an error."""
    sets = rows.groupingSets([[F.col("error")], [F.col("qtype"), F.col("error")]], "qtype", "error")
    return sets.agg(F.count("*").alias("n"), F.grouping("qtype").cast("bigint").alias("overall"))


def method_table(df: DataFrame, keys: list[str], values: list[str], cost: str) -> DataFrame:
    """Distinct questions, means and summed cost (null as 0) of each group."""
    return df.groupBy(*keys).agg(F.count_distinct("qid").alias("n_qids"), *[F.avg(v).alias(v) for v in values], F.sum(F.coalesce(cost, F.lit(0.0))).alias("cost"))


def ordered_means(df: DataFrame, order: list[str | None], key: str, values: list[str]) -> DataFrame:
    """Means of the groups named in ``order`` (null is a group), in that order; a group without rows stays, empty."""
    skeleton = df.sparkSession.createDataFrame(list(enumerate(order)), f"place int, {key} string")
    g = df.groupBy(F.col(key).alias("own")).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))
    return skeleton.join(g, F.col(key).eqNullSafe(F.col("own")), "left").select("place", key, *values, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def comparison(df: DataFrame, reference: str, values: list[str]) -> DataFrame:
    """``paired`` for each of several metrics; two rows of a question and method are an error."""
    if not df.groupBy("qid", "method").count().filter("count > 1").isEmpty():
        raise ValueError("a question has two rows of a method")
    long = df.select("qid", "method", F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select("qid", "method", "x.*")
    r = long.filter(F.col("method") == reference).select("qid", "metric", F.col("value").alias("r"))
    d = long.filter(F.col("method") != reference).join(r, ["qid", "metric"]).dropna(subset=["value", "r"])
    return d.groupBy("method", "metric").agg(F.count("*").alias("n"), F.avg("r").alias("mean_reference"), F.avg("value").alias("mean_method"), F.avg(F.col("r") - F.col("value")).alias("delta"))


#: Pairs of one comparison that a worker resamples; an evaluation has some thousands.
MAX_PAIRS = 2_000_000


def paired_bootstrap(df: DataFrame, reference: str, values: list[str], rounds: int = 10_000, seed: int = 0, shared: bool = False) -> DataFrame:
    """Percentile interval of the mean paired difference to ``reference``, for each method and metric.

    Differences are in the order of qid and are drawn with a seeded generator, new for each metric, or
    ``shared`` by a method's metrics in their order.  Memory is bounded by drawing in chunks.
    """
    r = df.filter(F.col("method") == reference).select("qid", *[F.col(v).cast("double").alias(f"r_{v}") for v in values])
    d = df.filter(F.col("method") != reference).select("qid", "method", *[F.col(v).cast("double").alias(v) for v in values]).join(r, "qid")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_PAIRS:
            raise ValueError(f"more than {MAX_PAIRS} pairs of one comparison")
        pdf, rng, out = pdf.sort_values("qid"), np.random.default_rng(seed), []
        for v in values:
            x = (pdf[f"r_{v}"] - pdf[v]).dropna().to_numpy()
            if not shared:
                rng = np.random.default_rng(seed)
            step, means = max(1, 2_000_000 // max(1, len(x))), []
            for at in range(0, rounds, step):
                means.append(x[rng.integers(0, len(x), (min(step, rounds - at), len(x)))].mean(1))
            low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
            out.append((pdf.method.iloc[0], v, len(x), x.mean(), low, high, bool(low >= MARGIN)))
        return pd.DataFrame(out, columns=["method", "metric", "n", "delta", "ci_low", "ci_high", "non_inferior"])

    return d.groupBy("method").applyInPandas(run, "method string, metric string, n bigint, delta double, ci_low double, ci_high double, non_inferior boolean")


def invariants(df: DataFrame, violation: Column, prediction: str, provenance: list[str]) -> DataFrame:
    """One row: rows by question, distinct (method, budget) sets, budget violations, blank predictions, distinct provenances."""
    plan = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "method", F.col("budget_tokens").cast("string")))), ",")
    q = df.groupBy("qid").agg(F.count("*").alias("n"), plan.alias("plan"))
    a = q.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_qids"), F.max("n").alias("most_rows"), F.min("n").alias("least_rows"), F.count_distinct("plan").alias("plans"))
    b = df.agg(F.count_if(violation).alias("budget_violations"), F.count_if(F.trim(F.coalesce(prediction, F.lit(""))) == "").alias("blank_predictions"), F.count_distinct(*provenance).alias("provenances"))
    return a.crossJoin(b)  # one row each


def usage_sums(df: DataFrame, keys: list[str], usage: str) -> DataFrame:
    """Sums of each field of a struct of counters, and the number of shards."""
    fields = [f.name for f in df.schema[usage].dataType.fields]
    return df.groupBy(*keys).agg(*[F.sum(F.col(usage)[f]).alias(f) for f in fields], F.count("*").alias("shards"))


def token_stats(df: DataFrame, keys: list[str], tokens: str, budget: int) -> DataFrame:
    """Mean, median, nearest-rank 95th percentile, largest, and rows over the budget."""
    p95 = F.expr(f"percentile_disc(0.95) within group (order by {tokens})").cast("bigint")
    return df.groupBy(*keys).agg(F.avg(tokens).alias("mean"), F.median(tokens).alias("median"), p95.alias("p95"), F.max(tokens).cast("bigint").alias("most"), F.count_if(F.col(tokens) > budget).alias("over_budget"))


def certificate_rate(rows: DataFrame) -> DataFrame:
    """Rows without an error and their share, overall and by question type."""
    sets = rows.groupingSets([[], [F.col("qtype")]], "qtype")
    ok = F.count_if(F.col("error").isNull())
    return sets.agg(F.count("*").alias("n"), ok.alias("certified"), (ok / F.count("*")).alias("rate"), F.grouping("qtype").cast("bigint").alias("overall"))
