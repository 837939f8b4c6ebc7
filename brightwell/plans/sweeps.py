"""Configured methods: their sweep points, preflight checks, and the rows that a run is expected to make."""

from __future__ import annotations

from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWEPT = ("alpha", "budget_tokens", "top_k", "graph_rescue_weight")
POINTS = "method string, alpha double, budget_tokens bigint, top_k bigint, graph_rescue_weight double"
#: Most methods times sweep points of one configuration; they are literals of a plan.
MAX_POINTS = 10_000


def points(config: dict[str, Any]) -> list[tuple]:
    """``(method, alpha, budget_tokens, top_k, graph_rescue_weight)`` of each point, in the order of the lists; absent: None."""
    out = []
    for m in config["methods"]:
        lists = [v if isinstance(v := m.get(k), list) else [v] for k in SWEPT]
        for a, b, k, w in product(*lists):
            out.append((m["name"], None if a is None else float(a), b, k, None if w is None else float(w)))
    return out


def preflight(config: dict[str, Any], available: int | None = None) -> list[str]:
    """What is wrong with a configuration; no model and no table is needed for it."""
    wrong = []
    names = [m.get("name") for m in config.get("methods", [])]
    if not names:
        wrong.append("no methods")
    wrong += [f"method without a name at {i}" for i, n in enumerate(names) if not n]
    wrong += [f"method {n} is given twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
    for m in config.get("methods", []):
        if not m.get("kind"):
            wrong.append(f"{m.get('name')}: no kind")
        for key, least, most in (("alpha", 0, 1), ("budget_tokens", 1, None), ("top_k", 1, None), ("graph_rescue_weight", 0, None)):
            for v in m[key] if isinstance(m.get(key), list) else [m.get(key)]:
                if v is not None and (isinstance(v, bool) or not isinstance(v, int | float) or v < least or (most is not None and v > most)):
                    wrong.append(f"{m.get('name')}: {key} of {v!r}")
    n = config.get("n_questions")
    if n is not None and (n < 1 or (available is not None and n > available)):
        wrong.append(f"{n} questions asked for, {available} available")
    return wrong


def table(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    found = points(config)
    if len(found) > MAX_POINTS:
        raise ValueError(f"{len(found)} sweep points; at most {MAX_POINTS}")
    return spark.createDataFrame(found, POINTS)


def expected(questions: DataFrame, config: dict[str, Any]) -> DataFrame:
    """One row for each question and sweep point: the points are one literal array, exploded within each row."""
    found = points(config)
    if len(found) > MAX_POINTS:
        raise ValueError(f"{len(found)} sweep points; at most {MAX_POINTS}")
    names = [f.split(" ") for f in POINTS.split(", ")]
    rows = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(n) for v, (n, kind) in zip(p, names, strict=True)]) for p in found])
    return questions.select("qid", F.explode(rows).alias("p")).select("qid", "p.*")


def call_counts(rows: DataFrame) -> DataFrame:
    """Rows, and model calls if equal prompts are shared, by method (``expected`` rows)."""
    return rows.groupBy("method").agg(F.count("*").alias("n_rows"), F.count_distinct("qid").alias("n_questions"), F.count_distinct("budget_tokens").alias("n_budgets"))
