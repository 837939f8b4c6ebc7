"""Verification of claims and dependencies from judgments: schema checks, grounding, options in order.

Judgments come as a table of JSON payloads, so that any model or recording can give them.  A wrong
payload makes an error row and never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .certify import FORBIDDEN_VALUES

INVALID = "claim_verification_invalid"
FIELDS = ["bindings", "confidence", "label", "task_id"]
LABELS = ("entailed", "not_entailed")


def prefiltered(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of each claim by (score, key), both descending (``qid, claim, key, score``)."""
    place = F.row_number().over(W.partitionBy("qid", "claim").orderBy(F.desc("score"), F.desc("key")))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def judgments(payloads: DataFrame, tasks: DataFrame) -> DataFrame:
    """``qid, claim, task_id, label, confidence, bindings, quote, error`` of payloads ``qid, claim, payload``.

    A payload is invalid, and gives one row with ``error``, if it has other keys than ``judgments``,
    an unknown or repeated task, other fields, an unknown label, a confidence that is no number from
    0 to 1, bindings that are no object, or a negative judgment with bindings or a quote.
    """
    p = payloads.select("qid", "claim", F.json_object_keys("payload").alias("keys"), F.from_json(F.get_json_object("payload", "$.judgments"), "array<string>").alias("items"))
    j = p.select("qid", "claim", "keys", F.col("items").isNull().alias("no_list"), F.posexplode_outer("items").alias("pos", "j"))
    number = F.schema_of_variant(F.try_variant_get(F.try_parse_json("j"), "$.confidence", "variant"))
    fields = F.array_sort(F.json_object_keys("j"))
    j = j.select(
        "qid", "claim", "keys", "no_list", "pos", "j",
        F.get_json_object("j", "$.task_id").alias("task_id"),
        F.get_json_object("j", "$.label").alias("label"),
        F.when(number.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.get_json_object("j", "$.confidence").try_cast("double")).alias("confidence"),
        F.get_json_object("j", "$.bindings").alias("raw"),
        F.coalesce(F.get_json_object("j", "$.evidence_quote"), F.lit("")).alias("quote"),
        ((fields == F.array(*map(F.lit, FIELDS))) | (fields == F.array(*map(F.lit, sorted([*FIELDS, "evidence_quote"]))))).alias("fields_fit"),
    )
    known = tasks.select("qid", "claim", "task_id").distinct().withColumn("known", F.lit(True))
    j = j.join(known, ["qid", "claim", "task_id"], "left").withColumn("bindings", F.from_json("raw", "map<string,string>"))
    repeated = F.count("*").over(W.partitionBy("qid", "claim", "task_id")) > 1
    negative = (F.col("label") == "not_entailed") & ((F.size("bindings") > 0) | (F.col("quote") != ""))
    good = F.col("known") & F.col("fields_fit") & F.col("label").isin(*LABELS) & F.col("confidence").between(0.0, 1.0) & F.col("raw").startswith("{") & F.col("bindings").isNotNull()
    wrong = F.when(F.col("j").isNull(), False).otherwise(~F.coalesce(good, F.lit(False)) | repeated | negative)
    payload_wrong = F.col("no_list") | ~F.coalesce(F.col("keys") == F.array(F.lit("judgments")), F.lit(False))
    j = j.withColumn("wrong", wrong | payload_wrong)
    w = W.partitionBy("qid", "claim")
    j = j.withColumn("any_wrong", F.max("wrong").over(w)).withColumn("place", F.row_number().over(w.orderBy("pos")))
    j = j.filter((F.col("any_wrong") & (F.col("place") == 1)) | (~F.col("any_wrong") & F.col("j").isNotNull()))
    some = lambda c: F.when(~F.col("any_wrong"), F.col(c)).alias(c)
    return j.select("qid", "claim", *map(some, ("task_id", "label", "confidence", "bindings", "quote")), F.when(F.col("any_wrong"), INVALID).alias("error"))


def grounding_reject(bindings: Column, variables: Column, constraints: Column, links: Column, titles: Column, terminal: Column, surface: Column, text: Column, quote: Column) -> Column:
    """The first rule that an entailed judgment breaks, or null.

    ``variables, links, titles, terminal`` are arrays, ``bindings, constraints`` maps by variable.
    """
    norm = T.normalize
    value = lambda v: F.element_at(bindings, v)
    known = T.titled_variables(bindings, titles)
    untitled = lambda vs: F.size(F.array_except(vs, known)) > 0
    free = F.filter(variables, lambda v: ~F.array_contains(terminal, v) & ~F.array_contains(F.map_keys(constraints), v))
    same_keys = F.array_sort(F.map_keys(bindings)) == F.array_sort(variables)
    blank = F.exists(F.map_values(bindings), lambda v: v.isNull() | (F.trim(v) == ""))
    return (
        F.when(~same_keys | blank, "variables")
        .when(F.exists(F.map_keys(constraints), lambda v: norm(value(v)) != norm(F.element_at(constraints, v))), "constraint")
        .when(untitled(links), "link")
        .when(F.exists(F.map_values(bindings), lambda v: norm(v).isin(*FORBIDDEN_VALUES)), "forbidden")
        .when(untitled(F.filter(free, lambda v: ~norm(surface).contains(norm(value(v))))), "surface")
        .when((quote != "") & T.project_quote(text, quote, F.map_values(bindings)).isNull(), "quote")
    )


def dependency_options(sources: DataFrame, targets: DataFrame, paths: DataFrame, judged: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Ways to ground a dependency, best first.

    ``sources, targets (qid, dep, key, binding)`` meet where their bindings are aliases;
    ``paths (qid, from_key, to_key, path, path_rank)`` must join them and ``judged (qid, dep, path,
    confidence)`` must have a row for every task: one without is ``dependency_verification_invalid``.
    """
    s = sources.select("qid", "dep", F.col("key").alias("from_key"), F.col("binding").alias("from_binding"))
    t = targets.select("qid", "dep", F.col("key").alias("to_key"), F.col("binding").alias("to_binding"))
    s, t = s.withColumn("fa", T.alias(F.col("from_binding"))), t.withColumn("ta", T.alias(F.col("to_binding")))
    both = s.join(t, ["qid", "dep"]).filter(T.alias_same(F.col("fa"), F.col("ta"))).drop("fa", "ta")
    tasks = both.join(paths, ["qid", "from_key", "to_key"]).join(judged, ["qid", "dep", "path"], "left")
    missing = F.max(F.col("confidence").isNull()).over(W.partitionBy("qid", "dep"))
    rank = F.row_number().over(W.partitionBy("qid", "dep").orderBy("path_rank", F.desc("confidence"), "path", "from_key", "to_key"))
    tasks = tasks.withColumn("error", F.when(missing, "dependency_verification_invalid"))
    return tasks.filter((F.col("confidence") >= threshold) | F.col("error").isNotNull()).withColumn("rank", rank).select("qid", "dep", "from_key", "to_key", "path", "confidence", "rank", "error")
