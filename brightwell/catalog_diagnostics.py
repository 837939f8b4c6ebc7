"""Registered queries of diagnostics, run statistics and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import BUDGET, EDGES, HOPS, LINE_BUDGET, LINES, NODES, SCORED, SEEDS, line_view, node_view, query, questions, table
from .operators import diagnostics, linked, metrics
from .plans import methods
from .sources import caches, multihop

_SETS = """sets AS (SELECT l_orderkey AS qid, coalesce(list_distinct(list(l_suppkey) FILTER (l_tax > 0.06)), []) AS g, coalesce(list_distinct(list(l_suppkey) FILTER (l_quantity > 25)), []) AS s, coalesce(list_distinct(list(l_suppkey) FILTER (l_discount > 0.05)), []) AS r FROM lineitem GROUP BY 1),
ds AS (SELECT *, [x FOR x IN s IF NOT list_contains(r, x)] AS added, [x FOR x IN r IF NOT list_contains(s, x)] AS displaced FROM sets),
rs AS (SELECT *, greatest(len(added) > 0, len(displaced) > 0)::INT::DOUBLE AS activated, (len(list_intersect(added, g)) > 0)::INT::DOUBLE AS correct_rescue, (len([x FOR x IN added IF NOT list_contains(g, x)]) > 0)::INT::DOUBLE AS false_rescue, len(list_intersect(added, g))::INT AS gold_added, len(list_intersect(displaced, g))::INT AS gold_displaced FROM ds)"""


def line_sets(s: SparkSession, d: str) -> DataFrame:
    """Suppliers of an order as gold facts, as one selection, and as another."""
    side = lambda c: F.collect_set(F.when(F.expr(c), F.col("l_suppkey")))
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(side("l_tax > 0.06").alias("g"), side("l_quantity > 25").alias("s"), side("l_discount > 0.05").alias("r"))


@query(f"WITH {_SETS} SELECT qid, activated, correct_rescue, false_rescue, gold_added, gold_displaced FROM rs")
def rescue_diff(s: SparkSession, d: str) -> DataFrame:
    return line_sets(s, d).select("qid", *diagnostics.rescue(F.col("s"), F.col("r"), F.col("g")))


@query(f"""WITH {_SETS}, f AS (SELECT *, len([x FOR x IN g IF NOT list_contains(s, x)]) = 0 AS everything, len([x FOR x IN g IF NOT list_contains(s, x) AND NOT list_contains(r, x)]) = 0 AS reach FROM rs),
st AS (SELECT qid, [x FOR x IN [CASE WHEN qid % 3 = 0 THEN 'Seed miss' END, CASE WHEN NOT reach THEN 'Graph reachability miss' END, CASE WHEN qid % 11 = 0 THEN 'Budget infeasible' END, CASE WHEN false_rescue = 1 THEN 'Graph false rescue' END, CASE WHEN reach AND qid % 11 <> 0 AND NOT everything THEN 'Pair/pruning error' END,
  CASE WHEN everything AND qid % 4 = 0 THEN 'Generation error' END, CASE WHEN len(list_intersect(g, r)) > 0 AND NOT everything THEN 'Conditional scoring error' END, CASE WHEN qid % 13 = 0 THEN 'Router error' END] IF x IS NOT NULL] AS stages FROM f)
SELECT stage, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN len(stages) > 0 THEN stages ELSE ['No diagnosed failure'] END) AS stage FROM st) GROUP BY 1""")
def failure_taxonomy(s: SparkSession, d: str) -> DataFrame:
    q = F.col("qid")
    all_of = lambda a: F.size(F.array_except("g", a)) == 0
    x = line_sets(s, d).select("qid", "g", "s", "r", *diagnostics.rescue(F.col("s"), F.col("r"), F.col("g")))
    x = x.select((q % 3 != 0).alias("seed_hit"), all_of(F.array_union("s", "r")).alias("reachable"), (q % 11 != 0).alias("fits"), (F.col("false_rescue") == 1).alias("false_rescue"), all_of("s").alias("selected_all"), (F.size(F.array_intersect("g", "r")) > 0).alias("conditional_gold"), (q % 13 == 0).alias("route_wrong"), F.when(q % 4 == 0, 0).when(q % 4 == 1, 1).alias("em"))
    return diagnostics.failures(x).groupBy("stage").agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}{SCORED}, {EDGES}{SEEDS}{HOPS}, gold AS (SELECT * FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid, title ORDER BY semantic DESC, node_ord) = 1) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, node_ord) <= 6)
SELECT g.qid, round(count(*) FILTER (hop <= 1) / count(*)::DOUBLE, 6) AS one_hop_recall, round(count(hop) / count(*)::DOUBLE, 6) AS two_hop_recall, (count(hop) = count(*))::INT::DOUBLE AS reachable, sum(n_tokens)::BIGINT AS gold_tokens, (sum(n_tokens) <= {BUDGET})::INT::DOUBLE AS fits FROM gold g LEFT JOIN r2 ON r2.qid = g.qid AND r2.node_ord = g.node_ord GROUP BY 1""")
def reachability(s: SparkSession, d: str) -> DataFrame:
    """Gold are the best sentences of a question's six best titles."""
    sc = methods.scored(questions(s, d), node_view(s, d))
    gold = methods.anchors(sc, 6)
    out = diagnostics.reachability(gold, linked.hops(methods.ranked(sc), 2), BUDGET)
    return out.withColumns({c: F.round(c, 6) for c in ("one_hop_recall", "two_hop_recall")})


_OBSERVED = f"""k AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY semantic DESC, ord ROWS UNBOUNDED PRECEDING) <= {LINE_BUDGET} AS s, sum(cost) OVER (PARTITION BY qid ORDER BY graph DESC, ord ROWS UNBOUNDED PRECEDING) <= {LINE_BUDGET} AS g,
  row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, ord) AS rs, row_number() OVER (PARTITION BY qid ORDER BY graph DESC, semantic DESC, ord) AS rg, count(*) OVER (PARTITION BY qid) AS n, cost % 3 = 0 AS gold FROM c),
k2 AS (SELECT *, least(greatest(1, count(*) FILTER (s) OVER (PARTITION BY qid)), n) AS kp FROM k),
ob AS (SELECT qid, count(*) FILTER (gold) AS cg, count(*) FILTER (gold AND s) AS sg, count(*) FILTER (gold AND g) AS gg, count(*) FILTER (gold AND (s OR g)) AS ug, count(*) FILTER (gold AND NOT s) AS misses, count(*) FILTER (gold AND NOT s AND g) AS rescued, count(*) FILTER (gold AND NOT s) * count(*) FILTER (g) / count(*)::DOUBLE AS rnd,
  sum(1 - (rg - 1) / greatest(1, n - 1)::DOUBLE) FILTER (gold AND NOT s) AS mp, CASE WHEN count(*) FILTER (s OR g) > 0 THEN 1 - count(*) FILTER (s AND g) / count(*) FILTER (s OR g)::DOUBLE ELSE 0.0 END AS disagreement, avg(semantic) FILTER (rs <= 2) AS top2, max(semantic) FILTER (rs = kp) AS kth, max(graph) - max(graph) FILTER (rg = n // 2 + 1) AS peak,
  CASE WHEN count(*) FILTER (hop = 0) > 0 THEN count(*) FILTER (hop = 0 AND NOT s) / count(*) FILTER (hop = 0)::DOUBLE ELSE 0.0 END AS seed_miss, count(*) FILTER (gold) + 1 AS total FROM k2 GROUP BY qid HAVING count(*) FILTER (gold) > 0 OR true)"""


def observed(s: SparkSession, d: str) -> DataFrame:
    """Gold are the line items whose cost is a multiple of three, and one fact that is no candidate."""
    c = line_view(s, d)
    gold = c.filter("cost % 3 = 0").select("qid", "ord").unionByName(c.select("qid").distinct().withColumn("ord", F.lit(0)))
    return diagnostics.rescue_observations(c, gold, LINE_BUDGET)


@query(f"""WITH {LINES}, {_OBSERVED} SELECT count(*)::BIGINT AS questions, round(sum(cg) / sum(total)::DOUBLE, 6) AS candidate_recall, round(sum(sg) / sum(total)::DOUBLE, 6) AS semantic_recall, round(sum(gg) / sum(total)::DOUBLE, 6) AS graph_recall, round(sum(ug) / sum(total)::DOUBLE, 6) AS union_recall, count(*) FILTER (sg < total)::BIGINT AS incomplete, count(*) FILTER (sg < total AND ug = total)::BIGINT AS recovered,
sum(misses)::BIGINT AS misses, round(sum(rescued) / sum(misses)::DOUBLE, 6) AS rescue_rate, round(sum(rnd) / sum(misses), 6) AS random_rate, round(sum(mp) / sum(misses), 6) AS missed_percentile FROM ob""")
def rescue_probe(s: SparkSession, d: str) -> DataFrame:
    out = diagnostics.rescue_summary(observed(s, d))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"""WITH {LINES}, {_OBSERVED}, gr AS (SELECT unnest([x FOR x IN [CASE WHEN sg = total THEN 'semantic_complete' ELSE 'semantic_incomplete' END, CASE WHEN sg < total AND rescued > 0 THEN 'rescued' END] IF x IS NOT NULL]) AS grp, * FROM ob)
SELECT grp, count(*)::BIGINT AS n, round(avg(disagreement), 5) AS disagreement, round(avg(top2), 5) AS top2, round(avg(kth), 5) AS kth, round(avg(peak), 5) AS peak, round(avg(seed_miss), 5) AS seed_miss FROM gr GROUP BY 1""")
def rescue_probe_features(s: SparkSession, d: str) -> DataFrame:
    out = diagnostics.rescue_features(observed(s, d))
    return out.select(F.col("group").alias("grp"), "n", *[F.round(c, 5).alias(c) for c in ("disagreement", "top2", "kth", "peak", "seed_miss")])


@query(f"WITH {LINES} SELECT qid, ord::INT AS ord FROM c QUALIFY sum(cost) OVER (PARTITION BY qid ORDER BY graph DESC, ord ROWS UNBOUNDED PRECEDING) <= {LINE_BUDGET}")
def logged_score_only(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.score_only(diagnostics.logged_candidates(line_view(s, d)), "graph", LINE_BUDGET)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id)::INT AS place FROM documents QUALIFY place <= 100")
def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    return multihop.seeded(table(s, d, "documents").select("doc_id"), "doc_id", 100, 7).select("doc_id", "place")


# run statistics


def results(s: SparkSession, d: str) -> DataFrame:
    """Events as result rows: a user is a question, an event type a method; ``cost`` is null for some."""
    e = table(s, d, "events").groupBy(F.col("user_id").alias("qid"), F.col("event_type").alias("method")).agg(F.avg("value").alias("f1"), F.max("value").alias("em"), F.count("*").alias("k"))
    return e.withColumns({"budget_tokens": F.pmod("qid", F.lit(3)) * 100 + 100, "cost": F.when(F.col("k") % 2 == 0, F.col("f1"))})


_RESULTS = "res AS (SELECT *, qid % 3 * 100 + 100 AS budget_tokens, CASE WHEN k % 2 = 0 THEN f1 END AS cost FROM (SELECT user_id AS qid, event_type AS method, avg(value) AS f1, max(value) AS em, count(*) AS k FROM events GROUP BY 1, 2))"


@query(f"WITH {_RESULTS} SELECT method, budget_tokens, count(DISTINCT qid)::BIGINT AS n_qids, round(avg(f1), 6) AS f1, round(sum(coalesce(cost, 0)), 4) AS cost FROM res GROUP BY 1, 2")
def method_table(s: SparkSession, d: str) -> DataFrame:
    out = metrics.method_table(results(s, d), ["method", "budget_tokens"], ["f1"], "cost")
    return out.withColumns({"f1": F.round("f1", 6), "cost": F.round("cost", 4)})


@query(f"WITH {_RESULTS}, o AS (SELECT * FROM (VALUES (0, 'view'), (1, 'purchase'), (2, 'absent'), (3, NULL)) v(place, method)) SELECT place, o.method, round(avg(f1), 3) AS f1, count(f1)::BIGINT AS n FROM o LEFT JOIN (SELECT CASE WHEN method <> 'error' THEN method END AS method, f1 FROM res) r ON r.method IS NOT DISTINCT FROM o.method GROUP BY 1, 2")
def ordered_means(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d).withColumn("method", F.when(F.col("method") != "error", F.col("method")))
    return metrics.ordered_means(r, ["view", "purchase", "absent", None], "method", ["f1"]).select("place", "method", F.round("f1", 3).alias("f1"), "n")


@query(f"""WITH {_RESULTS}, p AS (SELECT a.qid, a.f1 AS rf, a.em AS re, b.method, b.f1, b.em FROM res a JOIN res b ON a.qid = b.qid AND a.method = 'view' AND b.method <> 'view')
SELECT method, 'f1' AS metric, count(*)::BIGINT AS n, round(avg(rf), 6) AS mean_reference, round(avg(f1), 6) AS mean_method, round(avg(rf - f1), 6) AS delta FROM p GROUP BY 1 UNION ALL SELECT method, 'em', count(*)::BIGINT, round(avg(re), 6), round(avg(em), 6), round(avg(re - em), 6) FROM p GROUP BY 1""")
def comparison_table(s: SparkSession, d: str) -> DataFrame:
    out = metrics.comparison(results(s, d), "view", ["f1", "em"])
    return out.select("method", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean_reference", "mean_method", "delta")])


@query()
def paired_bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    """10,000 resamples of the paired differences of each method and metric."""
    return metrics.paired_bootstrap(results(s, d), "view", ["f1", "em"])


@query(f"""WITH {_RESULTS}, q AS (SELECT qid, count(*) AS n, string_agg(DISTINCT method || ':' || budget_tokens, ',' ORDER BY method || ':' || budget_tokens) AS plan, count(DISTINCT budget_tokens) AS b FROM res GROUP BY 1)
SELECT (SELECT count(*) FROM res)::BIGINT AS n_rows, count(*)::BIGINT AS n_qids, max(n)::BIGINT AS most_rows, min(n)::BIGINT AS least_rows, count(DISTINCT plan)::BIGINT AS plans, (SELECT count(*) FROM res WHERE em > budget_tokens)::BIGINT AS budget_violations, (SELECT count(*) FROM res WHERE trim(coalesce(nullif(method, 'error'), '')) = '')::BIGINT AS blank_predictions, (SELECT count(DISTINCT k) FROM res)::BIGINT AS provenances FROM q""")
def run_invariants(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d).withColumn("prediction", F.when(F.col("method") != "error", F.col("method")))
    return metrics.invariants(r, F.col("em") > F.col("budget_tokens"), "prediction", ["k"])


@query("SELECT n_regionkey AS shard_group, sum(n_nationkey)::BIGINT AS calls, sum(length(n_name))::BIGINT AS total_tokens, count(*)::BIGINT AS shards FROM nation GROUP BY 1")
def usage_sums(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "nation").select(F.col("n_regionkey").alias("shard_group"), F.struct(F.col("n_nationkey").cast("bigint").alias("calls"), F.length("n_name").cast("bigint").alias("total_tokens")).alias("usage"))
    return metrics.usage_sums(u, ["shard_group"], "usage")


@query("SELECT lang, round(avg(n_chars), 6) AS mean, median(n_chars)::DOUBLE AS median, quantile_disc(n_chars, 0.95)::BIGINT AS p95, max(n_chars)::BIGINT AS most, count(*) FILTER (n_chars > 2000)::BIGINT AS over_budget FROM documents GROUP BY 1")
def serialized_stats(s: SparkSession, d: str) -> DataFrame:
    return metrics.token_stats(table(s, d, "documents"), ["lang"], "n_chars", 2000).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderpriority AS qtype, count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus <> 'F')::BIGINT AS certified, round(count(*) FILTER (o_orderstatus <> 'F') / count(*)::DOUBLE, 6) AS rate, grouping(o_orderpriority)::BIGINT AS overall FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority))")
def certificate_rate(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("qtype"), F.when(F.col("o_orderstatus") == "F", "no_feasible_witness").alias("error"))
    return metrics.certificate_rate(o).withColumn("rate", F.round("rate", 6))


@query("SELECT item_id, b, count(*)::BIGINT AS n FROM (SELECT item_id, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '\\p{L}+'))), 1, 4))::BIGINT % 64 AS b FROM benchmark) GROUP BY 1, 2")
def hashed_term_buckets(s: SparkSession, d: str) -> DataFrame:
    """The default embedder's counts before they are made a unit vector."""
    return caches.term_buckets(table(s, d, "benchmark"), "item_id", "text")


@query("WITH k AS (SELECT DISTINCT sha1('v2' || chr(0) || 'local' || chr(0) || 'm' || chr(0) || text) AS key, text FROM documents), done AS (SELECT DISTINCT sha1('v2' || chr(0) || 'local' || chr(0) || 'm' || chr(0) || text) AS key FROM documents WHERE doc_id % 3 = 0) SELECT key, md5(text) AS body FROM k WHERE key NOT IN (SELECT key FROM done)")
def cache_misses(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents")
    done = caches.keyed(t.filter("doc_id % 3 = 0"), "text", "local", "m")
    return caches.misses(caches.keyed(t, "text", "local", "m"), done).select("key", F.md5("text").alias("body"))
