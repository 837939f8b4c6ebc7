"""Mixing sources to target weights (operator 6) by iterative proportional fitting.

Token totals by cell (source, language, topic) are raked until they have the target marginals;
each document is then kept with a probability in proportion to its cell's raked weight, calibrated
so that the expected tokens meet the budget, and drawn by a hash of its id.  A probability ends at 1:
where the budget asks more of a cell than it has, the targets are missed, and ``marginals`` tells by how
much.  Where no topic is given, ``topic`` guesses a form of text from three substrings.

Only the cells' totals leave the executors.  Up to ``MAX_CELLS`` of them (a checked bound) are raked
on the driver and broadcast; more are raked as a table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MAX_CELLS = 100_000
ROUNDS = 30
#: Targets not given are the source's own shares to this power, so large parts shrink and small ones grow.
TEMPER = 0.5
KEEP = 0.7
SIDES = ("source", "lang", "topic")


def topic(text: Column) -> Column:
    """Form of a text, where the table has no topic of its own."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("icense"), "notice").when(t.contains("@"), "contact").otherwise("prose")


def with_cells(docs: DataFrame, own_topic: Column | None = None) -> DataFrame:
    """Each row as ``row``, with ``mix_source, mix_lang, mix_topic`` (null as '') and ``mix_tokens`` (words between ASCII blanks).

    ``own_topic`` is the table's topic, if it has one; else it is guessed from the text.  The row is
    one column, so the names of ``docs`` can't clash with those made here.
    """
    own = topic(F.col("text")) if own_topic is None else own_topic
    parts = {f"mix_{s}": F.coalesce(c.cast("string"), F.lit("")) for s, c in zip(SIDES, (F.col("source"), F.col("lang"), own), strict=True)}
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in parts.items()], tokens.alias("mix_tokens"))


def shares(totals: dict[str, float], targets: dict[str, float] | None) -> dict[str, float]:
    """Target shares over the values that occur, summing to 1."""
    raw = {k: (targets.get(k, 0.0) if targets is not None else v**TEMPER) for k, v in totals.items()}
    return {k: v / (sum(raw.values()) or 1.0) for k, v in raw.items()}


def rake(cells: list[tuple[str, str, str, float]], targets: dict[str, dict[str, float]], keep: float) -> list[float]:
    """Probability of each (source, lang, topic, tokens) cell."""
    tokens = np.array([c[3] for c in cells], float)
    total, v = tokens.sum(), tokens.copy()
    codes, goals = [], []
    for d, side in enumerate(SIDES):
        sums: dict[str, float] = {}
        for c in cells:
            sums[c[d]] = sums.get(c[d], 0.0) + c[3]
        goal = shares(sums, targets.get(side))
        place = {k: i for i, k in enumerate(sums)}
        codes.append(np.array([place[c[d]] for c in cells]))
        goals.append(np.array([goal[k] for k in sums]) * total)
    for _ in range(ROUNDS):
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, v, len(goal))
            v = v * np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)[code]
    return calibrated(tokens, v, keep * total)


def calibrated(tokens: np.ndarray, v: np.ndarray, budget: float) -> list[float]:
    """``min(1, c * v / tokens)`` with the ``c`` that makes the expected tokens ``budget``."""
    w = v / tokens
    order = np.argsort(-w, kind="stable")
    sure = np.concatenate(([0.0], np.cumsum(tokens[order])[:-1]))
    rest = v.sum() - np.concatenate(([0.0], np.cumsum(v[order])[:-1]))
    c = np.divide(budget - sure, rest, out=np.full(len(w), np.inf), where=rest > 0)
    fits = np.flatnonzero(c * w[order] <= 1)
    scale = c[fits[0]] if len(fits) else np.inf
    return [float(min(1.0, scale * x)) if x > 0 else 0.0 for x in w]


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]], keep: float) -> DataFrame:
    """The same for more cells than the driver takes: sums by value, joined back, written each round.

    A side may have as many values as cells, so its sums are a table too; they are made by partial
    sums, and a value's cells are never in one task.
    """
    names = [f"mix_{s}" for s in SIDES]
    total = cells.agg(F.sum("tokens")).first()[0]
    for n, side in zip(names, SIDES, strict=True):
        sums = cells.groupBy(n).agg(F.sum("tokens").cast("double").alias("own"))
        given = targets.get(side)
        raw = F.pow("own", F.lit(TEMPER)) if given is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col(n)), F.lit(0.0))
        sums = sums.withColumn("raw", raw)
        whole = sums.agg(F.sum("raw")).first()[0]
        cells = common.joined(cells, sums.select(n, (F.col("raw") / whole * total).alias(f"goal_{side}")), n)
    cells = common.written(cells.withColumn("v", F.col("tokens").cast("double")), "cells")
    values = {n: cells.select(n).distinct().count() for n in names}
    for _ in range(ROUNDS):
        before = cells
        for n, side in zip(names, SIDES, strict=True):
            now = cells.groupBy(n).agg(F.sum("v").alias("now"))
            cells = common.joined(cells, now, n, rows=values[n]).withColumn("v", F.coalesce(F.try_divide(F.col("v") * F.col(f"goal_{side}"), F.col("now")), F.lit(0.0))).drop("now")
        cells = common.written(cells, "cells")
        common.discard(before)
    low, high = 0.0, 1e12
    expected = lambda c: cells.agg(F.sum(F.least(F.col("tokens").cast("double"), F.col("v") * c))).first()[0]
    for _ in range(60):
        mid = (low * high) ** 0.5 if low > 0 else high / 1e6
        low, high = (mid, high) if expected(mid) < keep * total else (low, mid)
    return cells.select(*names, F.least(F.lit(1.0), F.col("v") / F.col("tokens") * high).alias("mix_p"))


def probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, own_topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` (see ``with_cells``) with ``mix_prob`` and ``mix_kept``.

    ``targets`` has a share by value for any of source, lang, topic.  A text without words costs
    nothing and is kept.  Rows with the same doc_id share its draw; a null doc_id counts as ''.  An
    empty table gives an empty result; columns of any name are carried in ``row``.
    """
    full = with_cells(docs, own_topic)
    names = [f"mix_{s}" for s in SIDES]
    cells = common.written(full.filter("mix_tokens > 0").groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    n = cells.count()
    if n <= MAX_CELLS:
        rows = [tuple(r) for r in cells.orderBy(*names).collect()]
        probs = rake(rows, targets or {}, keep) if rows else []
        table = docs.sparkSession.createDataFrame([(*r[:3], p) for r, p in zip(rows, probs, strict=True)], ", ".join(f"{x} string" for x in names) + ", mix_p double")
    else:
        table = rake_table(cells, targets or {}, keep)
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(":mix"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = common.joined(full, table, names, "left", n)
    prob = F.when(F.col("mix_tokens") > 0, F.col("mix_p")).otherwise(1.0)
    return out.withColumn("mix_prob", prob).withColumn("mix_kept", draw < F.col("mix_prob")).drop("mix_p")


def marginals(probs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``side, value, target, reached`` of the output of ``probabilities``: target and expected shares of the kept tokens.

    Where the budget asks more of a cell than it has, its documents are all kept and ``reached`` misses ``target``.
    """
    out = None
    for side in SIDES:
        given = (targets or {}).get(side)
        sums = probs.filter("mix_tokens > 0").groupBy(F.col(f"mix_{side}").alias("value")).agg(F.sum("mix_tokens").cast("double").alias("own"), F.sum(F.col("mix_tokens") * F.col("mix_prob")).alias("got"))
        raw = F.pow("own", F.lit(TEMPER)) if given is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col("value")), F.lit(0.0))
        sums = sums.withColumn("raw", raw)
        whole = sums.agg(F.sum("raw").alias("all_raw"), F.sum("got").alias("all_got"))
        part = sums.crossJoin(F.broadcast(whole)).select(F.lit(side).alias("side"), "value", F.try_divide("raw", "all_raw").alias("target"), F.try_divide("got", "all_got").alias("reached"))
        out = part if out is None else out.unionByName(part)
    return out


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, own_topic: Column | None = None) -> DataFrame:
    """The drawn rows, with the columns of ``docs``."""
    return probabilities(docs, targets, keep, own_topic).filter("mix_kept").select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = probabilities(common.documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    return out.select("row.doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_prob", 6).alias("prob"), F.col("mix_kept").alias("kept"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icense') THEN 'notice' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
s AS (SELECT source, sqrt(sum(tokens)) AS r FROM cells GROUP BY 1), l AS (SELECT lang, sqrt(sum(tokens)) AS r FROM cells GROUP BY 1), t AS (SELECT topic, sqrt(sum(tokens)) AS r FROM cells GROUP BY 1),
goals AS (SELECT c.*, (SELECT sum(tokens) FROM cells) AS total, s.r / (SELECT sum(r) FROM s) AS gs, l.r / (SELECT sum(r) FROM l) AS gl, t.r / (SELECT sum(r) FROM t) AS gt
  FROM cells c JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)),
raked AS (SELECT 0 AS k, *, tokens AS v FROM goals UNION ALL
  SELECT k + 1, source, lang, topic, tokens, total, gs, gl, gt, v * gt * total / sum(v) OVER (PARTITION BY topic) FROM (
    SELECT * REPLACE (v * gl * total / sum(v) OVER (PARTITION BY lang) AS v) FROM (
      SELECT * REPLACE (v * gs * total / sum(v) OVER (PARTITION BY source) AS v) FROM raked WHERE k < {ROUNDS}))),
ended AS (SELECT *, v / tokens AS w, sum(v) OVER () AS all_v FROM raked WHERE k = {ROUNDS}),
ranked AS (SELECT *, coalesce(sum(tokens) OVER before, 0) AS sure, all_v - coalesce(sum(v) OVER before, 0) AS rest FROM ended
  WINDOW before AS (ORDER BY w DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scale AS (SELECT arg_max(({KEEP} * total - sure) / rest, w) AS c FROM ranked WHERE ({KEEP} * total - sure) / rest * w <= 1),
probs AS (SELECT source, lang, topic, least(1.0, c * w) AS prob FROM ended, scale),
drawn AS (SELECT d.*, CASE WHEN n_tokens > 0 THEN prob ELSE 1.0 END AS p, ('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 8))::BIGINT / 4294967296.0 AS u FROM d LEFT JOIN probs USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS prob, u < p AS kept FROM drawn"""
