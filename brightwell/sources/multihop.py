"""Nested question/passage records: reading, hygiene, audit, manifests, resume and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAW = "_id string, question string, answer string, type string, level string, context array<array<string>>, supporting_facts array<array<string>>"
RESULT_KEY = ["qid", "method", "budget_tokens", "top_k", "alpha", "graph_rescue_weight"]
POLICIES = ("keep", "exclude", "error")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records; missing answer, type or level is ''."""
    raw = spark.read.schema(RAW).json(path, multiLine=True)
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    return raw.select(F.col("_id").alias("qid"), "question", text("answer").alias("answer"), text("type").alias("qtype"), text("level").alias("level"), "context", "supporting_facts")


def passages(records: DataFrame) -> DataFrame:
    out = records.select("qid", F.posexplode("context").alias("passage_ord", "p"))
    return out.select("qid", "passage_ord", F.get("p", F.lit(0)).alias("title"), F.from_json(F.get("p", F.lit(1)), "array<string>").alias("sentences"))


def gold(records: DataFrame) -> DataFrame:
    out = records.select("qid", F.explode("supporting_facts").alias("f"))
    return out.select("qid", F.get("f", F.lit(0)).alias("title"), F.get("f", F.lit(1)).try_cast("int").alias("sent_id")).distinct()


def sentences(passages: DataFrame) -> DataFrame:
    """One node for each sentence, in passage and sentence order."""
    out = passages.select("qid", "passage_ord", "title", F.posexplode("sentences").alias("sent_id", "text"))
    return out.withColumn("node_ord", F.row_number().over(W.partitionBy("qid").orderBy("passage_ord", "sent_id")) - 1)


def deduplicated(passages: DataFrame) -> DataFrame:
    """Drop repeats of a title, keeping the first; ``conflict`` marks titles with different sentences."""
    w = W.partitionBy("qid", "title")
    out = passages.withColumn("body", F.to_json("sentences")).withColumn("place", F.row_number().over(w.orderBy("passage_ord")))
    out = out.withColumn("conflict", F.min("body").over(w) != F.max("body").over(w))
    return out.filter("place = 1").drop("body", "place")


def invalid_gold(gold: DataFrame, sentences: DataFrame) -> DataFrame:
    return gold.join(sentences.select("qid", "title", "sent_id").distinct(), ["qid", "title", "sent_id"], "left_anti")


def load(spark: SparkSession, path: str, deduplicate: bool = False, invalid_gold_policy: str = "keep") -> dict[str, DataFrame]:
    """Tables ``questions, passages, sentences, gold`` after the hygiene asked for."""
    if invalid_gold_policy not in POLICIES:
        raise ValueError(f"unknown policy {invalid_gold_policy!r}")
    records = read_records(spark, path)
    p, g = passages(records), gold(records)
    if deduplicate:
        p = deduplicated(p)
        if not p.filter("conflict").isEmpty():
            raise ValueError("a title occurs with different sentences")
        p = p.drop("conflict")
    s = sentences(p)
    if invalid_gold_policy != "keep":
        bad = invalid_gold(g, s)
        if invalid_gold_policy == "error" and not bad.isEmpty():
            raise ValueError("gold facts point outside the passages")
        qids = bad.select("qid").distinct()
        records, p, s, g = (t.join(qids, "qid", "left_anti") for t in (records, p, s, g))
    return {"questions": records.drop("context", "supporting_facts"), "passages": p, "sentences": s, "gold": g}


def audit(records: DataFrame) -> DataFrame:
    p, g = passages(records).withColumn("body", F.to_json("sentences")), gold(records)
    per_title = p.groupBy("qid", "title").agg(F.count("*").alias("n"), F.count_distinct("body").alias("bodies"))
    per_title = per_title.agg(F.sum((F.col("n") > 1).cast("bigint")).alias("duplicate_passage_records"), F.sum((F.col("bodies") > 1).cast("bigint")).alias("conflicting_passage_records"))
    bad = invalid_gold(g, sentences(passages(records))).agg(F.count_distinct("qid").alias("invalid_gold_records"), F.count("*").alias("invalid_gold_facts"))
    return records.agg(F.count("*").alias("records"), (F.count("qid") - F.count_distinct("qid")).alias("duplicate_qids")).crossJoin(per_title).crossJoin(bad)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def in_manifest(items: DataFrame, qids: DataFrame) -> DataFrame:
    """``items`` of the manifest ``qids (qid, position)``, with their position."""
    return items.join(qids, "qid")


def split(items: DataFrame, seen: DataFrame) -> DataFrame:
    """``role``: development for qids of earlier results, evaluation for the rest."""
    known = seen.select("qid").distinct().withColumn("known", F.lit(True))
    return items.join(known, "qid", "left").withColumn("role", F.when(F.col("known"), "development").otherwise("evaluation")).drop("known")


def pending(expected: DataFrame, done: DataFrame, key: list[str] = RESULT_KEY) -> DataFrame:
    """Rows still to run; null key parts are equal to each other."""
    d = done.select(*[F.col(k).alias(f"done_{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"done_{k}"))
    return expected.join(d, same, "left_anti")


def shard(items: DataFrame, position: str, count: int, index: int) -> DataFrame:
    if not 0 <= index < count:
        raise ValueError("shard index outside its count")
    return items.filter(F.pmod(F.col(position), F.lit(count)) == index)


def merged(shards: list[DataFrame], expected: DataFrame) -> DataFrame:
    """Union of shard results with a ``problem`` for duplicate, unexpected and missing qids."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s)
    n = rows.groupBy("qid").agg(F.count("*").alias("n"))
    want = expected.select("qid").distinct().withColumn("wanted", F.lit(True))
    state = n.join(want, "qid", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return state.select("qid", F.coalesce("n", F.lit(0)).alias("n"), problem.alias("problem"))


def stratified(items: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Largest-remainder sample: floor quotas, left seats to the largest fractions (ties: larger stratum name), hash order inside."""
    total = items.count()
    target = min(n, total)
    counts = items.groupBy(stratum).agg(F.count("*").alias("size")).withColumn("exact", F.lit(target) * F.col("size") / F.lit(max(1, total)))
    counts = counts.withColumn("floor", F.floor("exact"))
    left = F.lit(target) - F.sum("floor").over(W.partitionBy())
    seat = F.row_number().over(W.orderBy((F.col("exact") - F.col("floor")).desc(), F.col(stratum).desc()))
    quota = counts.select(stratum, (F.col("floor") + (seat <= left).cast("bigint")).alias("quota"))
    place = F.row_number().over(W.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return items.withColumn("place", place).join(F.broadcast(quota), stratum).filter("place <= quota").drop("quota")


def seeded(items: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` in a seeded hash order, with their ``place``: a reproducible shuffle and head.

    The head is a distributed top ``n``; only it is numbered in one task.
    """
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    head = items.withColumn("mixed", mixed).orderBy("mixed", key).limit(n)
    return head.withColumn("place", F.row_number().over(W.orderBy("mixed", key))).drop("mixed")
