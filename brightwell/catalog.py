"""Registered queries of the evidence engine over the driver's tables, each with its DuckDB equivalent where SQL can say it.

Views: every document is a passage of the question ``doc_id % number of questions`` and its lines are
the sentences; the line items of an order are candidates of one question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .operators import certify, context, fusion, graph, linked, metrics, nearest, prompts, selection, verify
from .plans import methods, sweeps
from .sources import multihop, reports

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BUDGET, LINE_BUDGET = 200, 60


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def passage_view(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "benchmark").count()
    p = table(s, d, "documents").select(F.pmod("doc_id", F.lit(n)).alias("qid"), F.col("doc_id").alias("passage_ord"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"), "text", "doc_id")
    return p.withColumn("sentences", F.split("text", "\n"))


def node_view(s: SparkSession, d: str) -> DataFrame:
    n = multihop.sentences(passage_view(s, d))
    return n.withColumn("n_tokens", T.count_tokens(F.col("text")))


def line_view(s: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_quantity")
    c = table(s, d, "lineitem").withColumn("ord", F.row_number().over(order))
    c = c.select(F.col("l_orderkey").alias("qid"), "ord", F.pmod("l_suppkey", F.lit(7)).alias("title"), F.col("l_quantity").cast("bigint").alias("cost"), F.round(F.col("l_extendedprice") / 105000, 6).alias("semantic"), F.round(1 - F.col("l_discount") * 5, 6).alias("graph"), F.pmod("l_linenumber", F.lit(3)).alias("hop"), F.when(F.col("l_tax") > 0.03, F.round(F.col("l_tax") * 10, 6)).alias("cond"))
    return c.withColumn("anchor", F.when(F.col("cond").isNotNull() & (F.col("ord") > 1), F.lit(1))).withColumn("validated", F.col("anchor").isNotNull())


NODES = r"""n AS (SELECT count(*) AS n FROM benchmark),
p AS (SELECT doc_id % n AS qid, doc_id AS passage_ord, source || '-' || doc_id AS title, string_split(text, chr(10)) AS ls FROM documents, n),
nodes AS (SELECT qid, passage_ord, title, i AS sent_id, ls[i + 1] AS text, len(regexp_extract_all(ls[i + 1], '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]'))::BIGINT AS n_tokens,
  row_number() OVER (PARTITION BY qid ORDER BY passage_ord, i) - 1 AS node_ord FROM (SELECT *, unnest(range(len(ls))) AS i FROM p))"""
SCORED = r""", q AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS qw FROM benchmark),
sw AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS sw FROM nodes JOIN q USING (qid)),
scored AS (SELECT * EXCLUDE (qw, sw), round(CASE WHEN len(qw) * len(sw) > 0 THEN len(list_intersect(qw, sw)) / sqrt((len(qw) * len(sw))::DOUBLE) ELSE 0.0 END, 6) AS semantic FROM sw)"""
LINES = """lines AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax, l_quantity) AS ord,
  l_suppkey % 7 AS title, l_quantity::BIGINT AS cost, round(l_extendedprice / 105000, 6) AS semantic, round(1 - l_discount * 5, 6) AS graph, l_linenumber % 3 AS hop,
  CASE WHEN l_tax > 0.03 THEN round(l_tax * 10, 6) END AS cond FROM lineitem),
c AS (SELECT *, CASE WHEN cond IS NOT NULL AND ord > 1 THEN 1 END AS anchor FROM lines)"""
PCT = """, pc AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY qid) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY qid ORDER BY semantic) - 1 + (count(*) OVER (PARTITION BY qid, semantic) - 1) / 2.0) / (count(*) OVER (PARTITION BY qid) - 1) END AS p_semantic,
  CASE WHEN count(*) OVER (PARTITION BY qid) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY qid ORDER BY graph) - 1 + (count(*) OVER (PARTITION BY qid, graph) - 1) / 2.0) / (count(*) OVER (PARTITION BY qid) - 1) END AS p_graph,
  CASE WHEN cond IS NULL THEN 0.0 WHEN count(*) OVER (PARTITION BY qid, cond IS NULL) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY qid, cond IS NULL ORDER BY cond) - 1 + (count(*) OVER (PARTITION BY qid, cond IS NULL, cond) - 1) / 2.0) / (count(*) OVER (PARTITION BY qid, cond IS NULL) - 1) END AS p_cond FROM c)"""


def fold_sql(units: str, limit: int = LINE_BUDGET) -> str:
    """Skip-fold of ``units (qid, rk, ks, cs)``."""
    return f"""{units}, lists AS (SELECT qid, list({{'ks': ks, 'cs': cs}} ORDER BY rk) AS us FROM units GROUP BY qid),
folded AS (SELECT qid, list_reduce(us, lambda s, x: CASE WHEN s.cs[1] + coalesce(list_sum([x.cs[i] FOR i IN range(1, len(x.ks) + 1) IF NOT list_contains(s.ks, x.ks[i])]), 0)::BIGINT <= {limit}
  THEN {{'ks': list_concat(s.ks, [k FOR k IN x.ks IF NOT list_contains(s.ks, k)]), 'cs': [s.cs[1] + coalesce(list_sum([x.cs[i] FOR i IN range(1, len(x.ks) + 1) IF NOT list_contains(s.ks, x.ks[i])]), 0)::BIGINT]}} ELSE s END, {{'ks': []::INT[], 'cs': [0]::BIGINT[]}}) AS s FROM lists)
SELECT qid, s.cs[1]::BIGINT AS used, array_to_string(s.ks, ',') AS selected FROM folded"""


PAIR = """CASE WHEN {when} AND a.cost IS NOT NULL THEN [x.anchor::INT, x.ord::INT] ELSE [x.ord::INT] END AS ks, CASE WHEN {when} AND a.cost IS NOT NULL THEN [a.cost, x.cost] ELSE [x.cost] END AS cs"""


# text


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm, len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]'))::BIGINT AS n_tokens, array_to_string(list_sort(list_distinct([trim(regexp_replace(lower(e), '\s+', ' ', 'g')) FOR e IN regexp_extract_all(text, '\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*')])), ',') AS entities FROM documents")
def text_functions(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", T.normalize(t).alias("norm"), T.count_tokens(t).alias("n_tokens"), F.array_join(F.array_sort(T.entities(t)), ",").alias("entities"))


_ROUTES = """SELECT item_id, CASE WHEN c AND r THEN 'bridge_comparison' WHEN c THEN 'direct_comparison' ELSE 'chained_reasoning' END AS route, CASE WHEN c AND r2 THEN 'bridge_comparison' WHEN c THEN 'direct_comparison' ELSE 'chained_reasoning' END AS route_plural
FROM (SELECT item_id, regexp_matches(text, '{c}') AS c, regexp_matches(text, '{r}') AS r, regexp_matches(text, '{p}') AS r2 FROM ({rows}))"""
_CUES = r"(?i)\b(same|both|earlier|later|older|younger|first|more recently|higher|lower|larger|smaller|more|less|share)\b"
_KIN = r"(?i)\b(director|author|writer|creator|producer|founder|owner|leader|father|mother|parent|grandfather|grandmother|son|daughter|child|wife|husband|spouse|brother|sister|coach|manager|president)\b"
_KINS = r"(?i)\b((director|author|writer|creator|producer|founder|owner|leader|father|mother|parent|grandfather|grandmother|son|daughter|husband|spouse|brother|sister|manager|president)s?|child|children|wife|wives|coach|coaches)\b"
#: The benchmark's questions have few cues, so each is also asked with every pair of a comparison and a relation word.
_ASKED = "SELECT item_id * 100 + i * 10 + j AS item_id, text || ' ' || a || ' ' || b AS text FROM benchmark, (SELECT unnest(range(6)) AS i, unnest(['', 'both', 'More  recently', 'shared', 'less', 'FIRST']) AS a), (SELECT unnest(range(8)) AS j, unnest(['', 'directors', 'Mother', 'grandsons', 'children', 'capital', 'coach of', 'wives']) AS b)"


@query(_ROUTES.format(c=_CUES, r=_KIN, p=_KINS, rows=_ASKED))
def route_questions(s: SparkSession, d: str) -> DataFrame:
    """Both routers over the questions as they are and with cue words added."""
    words = lambda *v: F.posexplode(F.array(*map(F.lit, v)))
    q = table(s, d, "benchmark").select("item_id", "text", words("", "both", "More  recently", "shared", "less", "FIRST").alias("i", "a"))
    q = q.select("item_id", "text", "i", "a", words("", "directors", "Mother", "grandsons", "children", "capital", "coach of", "wives").alias("j", "b"))
    text = F.concat("text", F.lit(" "), "a", F.lit(" "), "b")
    return q.select((F.col("item_id") * 100 + F.col("i") * 10 + F.col("j")).alias("item_id"), T.route(text).alias("route"), T.route(text, T.RELATION_PLURAL).alias("route_plural"))


_ARTICLE = r"'(^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:a|an|the)([^\p{{L}}\p{{M}}\p{{N}}_]|$)', '\1 \2', 'g'"
_NORM = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({{0}}), '[!-/:-@\[-`{{{{-~]', '', 'g'), {_ARTICLE}), {_ARTICLE}), '\s+', ' ', 'g'))"


@query(rf"""WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole FROM conversations),
p AS (SELECT conv_id, turn, {_NORM.format('nxt')} AS p, {_NORM.format('text')} AS g FROM t WHERE role = 'user' AND nrole = 'assistant'),
w AS (SELECT *, [x FOR x IN string_split(p, ' ') IF x <> ''] AS pw, [x FOR x IN string_split(g, ' ') IF x <> ''] AS gw FROM p),
pt AS (SELECT conv_id, turn, x, count(*) AS k FROM (SELECT conv_id, turn, unnest(pw) AS x FROM w) GROUP BY ALL), gt AS (SELECT conv_id, turn, x, count(*) AS k FROM (SELECT conv_id, turn, unnest(gw) AS x FROM w) GROUP BY ALL),
sh AS (SELECT conv_id, turn, sum(least(pt.k, gt.k)) AS sh FROM pt JOIN gt USING (conv_id, turn, x) GROUP BY 1, 2)
SELECT conv_id, turn, (p = g)::INT::DOUBLE AS em, round(CASE WHEN z THEN 0.0 ELSE 2.0 * sh / (len(pw) + len(gw)) END, 6) AS f1, round(CASE WHEN z THEN 0.0 ELSE sh / len(pw)::DOUBLE END, 6) AS prec, round(CASE WHEN z THEN 0.0 ELSE sh / len(gw)::DOUBLE END, 6) AS recall
FROM (SELECT w.*, sh, (sh IS NULL OR ((p IN ('yes','no','noanswer') OR g IN ('yes','no','noanswer')) AND p <> g)) AS z FROM w LEFT JOIN sh USING (conv_id, turn))""")
def answer_f1(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(s, d, "conversations").withColumns({"nxt": F.lead("text").over(w), "nrole": F.lead("role").over(w)}).filter("role = 'user' and nrole = 'assistant'")
    t = t.withColumn("m", T.answer_scores(F.col("nxt"), F.col("text")))
    return t.select("conv_id", "turn", F.col("m.em").alias("em"), *[F.round(f"m.{c}", 6).alias(c) for c in ("f1", "prec", "recall")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-ln(p / (1 - p)) / 1.5)), 6) AS confidence FROM (SELECT *, least(greatest(l_discount, 1e-6), 1 - 1e-6) AS p FROM lineitem)")
def calibrate_confidence(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(T.calibrate(F.col("l_discount"), 1.5), 6).alias("confidence"))


_FOLD = r"strip_accents(replace(lower({0}), 'ß', 'ss'))"
_BARE = r"regexp_replace({0}, '\s*\([^()]*\)\s*$', '')"
_KEY = "regexp_replace(" + _FOLD.format(r"regexp_replace(" + _BARE + r", '^\s*(?:king|queen|prince|princess|dr\.?|sir)\s+', '', 'i')") + r", '[^\p{{L}}\p{{N}}]', '', 'g')"
_TOKENS = "[x FOR x IN list_distinct(regexp_extract_all(" + _FOLD.format(_BARE) + ", '[a-z0-9]+')) IF x NOT IN ('a','an','and','director','film','of','saint','st','the','king','queen','prince','princess','sultan')]"
#: Part names in the forms that aliases come in.
_ALIASED = "SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN 'Dr. ' || p_name WHEN 1 THEN p_name || ' (film)' WHEN 2 THEN upper(p_name) WHEN 3 THEN replace(p_name, 'e', 'é') ELSE p_name END AS name FROM part"


@query(f"""WITH a AS ({_ALIASED}), k AS (SELECT p_partkey, p_brand, {_KEY.format('name')} AS key, {_TOKENS.format('name')} AS t FROM a)
SELECT a.p_brand, count(*)::BIGINT AS pairs FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE a.key = b.key OR len(list_intersect(a.t, b.t)) >= 2 OR len([x FOR x IN list_intersect(a.t, b.t) IF length(x) >= 6]) > 0 GROUP BY 1""")
def alias_match_pairs(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("Dr. "), n)).when(k == 1, F.concat(n, F.lit(" (film)"))).when(k == 2, F.upper(n)).when(k == 3, F.replace(n, F.lit("e"), F.lit("é"))).otherwise(n)
    p = table(s, d, "part").filter("p_partkey is not null").select("p_partkey", "p_brand", T.alias(name).alias("k"))
    p = p.select("p_partkey", "p_brand", F.struct(F.col("k.key").alias("key"), F.array_sort("k.tokens").alias("tokens")).alias("k"))

    def pairs(*by: str) -> DataFrame:
        """Parts of one form are compared once: n of them make n (n - 1) / 2 pairs, if the form matches itself."""
        n = p.groupBy(*by, "k").agg(F.count("*").alias("n"))
        a, b = n.alias("a"), n.alias("b")
        same = F.col("a.k") <= F.col("b.k")
        for c in by:
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        times = F.when(F.col("a.k") == F.col("b.k"), F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n"))
        return a.join(b, same).filter(T.alias_same(F.col("a.k"), F.col("b.k"))).select(F.col("a.p_brand").alias("p_brand"), times.alias("pairs"))

    # rows of one key are no pair
    out = pairs("p_brand").unionByName(pairs("p_brand", "p_partkey").withColumn("pairs", -F.col("pairs")))
    return out.groupBy("p_brand").agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")


@query(f"""WITH t AS (SELECT p_partkey, name, {_KEY.format('name')} AS key, {_TOKENS.format('name')} AS tokens FROM ({_ALIASED}))
SELECT p_partkey, key, array_to_string(list_sort(tokens), ',') AS tokens FROM t""")
def alias_keys(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("Dr. "), n)).when(k == 1, F.concat(n, F.lit(" (film)"))).when(k == 2, F.upper(n)).when(k == 3, F.replace(n, F.lit("e"), F.lit("é"))).otherwise(n)
    return table(s, d, "part").select("p_partkey", T.canonical_key(name).alias("key"), F.array_join(F.array_sort(T.alias_tokens(name)), ",").alias("tokens"))


@query(r"""WITH t AS (SELECT item_id % 10 AS g, text FROM benchmark), q AS (SELECT item_id, item_id % 10 AS g, trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g')) AS q FROM benchmark),
w AS (SELECT DISTINCT g, unnest(string_split(text, ' ')[1:6]) AS title FROM t), n AS (SELECT g, title, trim(regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g')) AS n FROM w)
SELECT item_id, string_agg(title, '|' ORDER BY strpos(q, n), title) AS titles FROM q JOIN n ON q.g = n.g AND n <> '' AND contains(q, n) GROUP BY 1""")
def mentioned_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles are the first words of ten questions at a time."""
    q = table(s, d, "benchmark").withColumn("g", F.col("item_id") % 10)
    w = q.groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list(F.slice(F.split("text", " "), 1, 6)))).alias("titles"))
    out = q.join(w, "g").select("item_id", T.mentioned_titles(F.col("text"), F.col("titles")).alias("t"))
    return out.filter(F.size("t") > 0).select("item_id", F.array_join("t", "|").alias("titles"))


# sources


@query(f"WITH {NODES} SELECT qid, passage_ord, title, sent_id, node_ord, n_tokens, md5(text) AS body FROM nodes")
def explode_nodes(s: SparkSession, d: str) -> DataFrame:
    return node_view(s, d).select("qid", "passage_ord", "title", "sent_id", "node_ord", "n_tokens", F.md5("text").alias("body"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def passage_dedup(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "documents").select(F.lit(0).alias("qid"), F.md5("text").alias("title"), F.col("doc_id").alias("passage_ord"), F.array("text").alias("sentences"))
    return multihop.deduplicated(p).select(F.col("passage_ord").alias("doc_id"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'evaluation' ELSE 'development' END AS role FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def manifest_split(s: SparkSession, d: str) -> DataFrame:
    out = multihop.split(table(s, d, "documents").select(F.col("doc_id").alias("qid")), table(s, d, "labels").select(F.col("doc_id").alias("qid")))
    return out.select(F.col("qid").alias("doc_id"), "role")


@query("SELECT e.event_id, e.user_id, e.event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, event_type FROM events WHERE value > 50) d WHERE d.user_id IS NOT DISTINCT FROM e.user_id AND d.event_type IS NOT DISTINCT FROM e.event_type)")
def resume_antijoin(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return multihop.pending(e.select("event_id", "user_id", "event_type"), e.filter("value > 50"), ["user_id", "event_type"])


@query("SELECT event_id % 4 AS shard, count(*)::BIGINT AS n, min(event_id) AS first FROM events GROUP BY 1")
def shard_mod(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    parts = [multihop.shard(e, "event_id", 4, i).agg(F.lit(i).cast("bigint").alias("shard"), F.count("*").alias("n"), F.min("event_id").alias("first")) for i in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""WITH k AS (SELECT lang, count(*) AS size, sum(count(*)) OVER () AS total FROM documents GROUP BY lang), f AS (SELECT *, 100.0 * size / total AS exact, floor(100.0 * size / total) AS fl FROM k),
qt AS (SELECT lang, fl + (row_number() OVER (ORDER BY exact - fl DESC, lang DESC) <= 100 - sum(fl) OVER ())::INT AS quota FROM f),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, r.lang, k::INT AS place FROM r JOIN qt USING (lang) WHERE k <= quota""")
def stratified_quota_sample(s: SparkSession, d: str) -> DataFrame:
    return multihop.stratified(table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 100).select("doc_id", "lang", "place")


# graph

_ENTITIES = r"list_distinct([trim(regexp_replace(lower(e), '\s+', ' ', 'g')) FOR e IN regexp_extract_all(text, '\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*')])"
OVERLAP = f"""ent AS (SELECT qid, node_ord, title, unnest({_ENTITIES}) AS e FROM nodes),
eo AS (SELECT DISTINCT a.qid, a.node_ord AS src, b.node_ord AS dst FROM ent a JOIN ent b ON a.qid = b.qid AND a.e = b.e AND a.node_ord < b.node_ord AND a.title <> b.title)"""
ADJ = "adj AS (SELECT qid, node_ord AS src, lead(node_ord) OVER (PARTITION BY qid, passage_ord ORDER BY sent_id) AS dst FROM nodes QUALIFY dst IS NOT NULL)"
_MENTION = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')) AS {1}n, " + _KEY.replace("{0}", "{0}") + " AS {1}k, " + _TOKENS + " AS {1}t"
MENTION = f"""mt AS (SELECT qid, title, {_MENTION.format('title', 't')} FROM (SELECT DISTINCT qid, title FROM nodes)), mx AS (SELECT qid, node_ord, title, {_MENTION.format('text', 'x')} FROM nodes),
tm AS (SELECT x.qid, x.node_ord AS src, n.node_ord AS dst FROM mx x JOIN mt t ON x.qid = t.qid AND x.title <> t.title AND (contains(xn, tn) OR (length(tk) >= 5 AND contains(xk, tk)) OR len(list_intersect(xt, tt)) >= 2 OR len([y FOR y IN list_intersect(xt, tt) IF length(y) >= 6]) > 0)
  JOIN nodes n ON n.qid = t.qid AND n.title = t.title)"""
EDGES = f"""{OVERLAP}, {ADJ}, {MENTION}, edges AS (SELECT qid, least(src, dst) AS src, greatest(src, dst) AS dst, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max(w) AS weight, min(phase * 1000000000000 + src * 1000000 + dst) AS seq
  FROM (SELECT *, 'entity_overlap' AS kind, 1.0 AS w, 1 AS phase FROM eo UNION ALL SELECT *, 'same_passage', 1.0, 0 FROM adj UNION ALL SELECT *, 'title_mention', 2.0, 2 FROM tm) GROUP BY 1, 2, 3)"""


def edge_view(s: SparkSession, d: str) -> DataFrame:
    n = node_view(s, d)
    return graph.merged(graph.adjacency(n), graph.entity_overlap(n), graph.title_mention(n))


@query(f"WITH {NODES}, {ADJ} SELECT qid, src, dst FROM adj")
def adjacency_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(node_view(s, d)).select("qid", "src", "dst")


@query(f"WITH {NODES}, {OVERLAP} SELECT * FROM eo")
def entity_overlap_edges(s: SparkSession, d: str) -> DataFrame:
    return linked.overlap_edges(node_view(s, d))


@query("WITH " + NODES.replace("source || '-' || doc_id AS title", "array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:3], ' ') AS title") + f", {MENTION} SELECT * FROM tm")
def title_mention_edges(s: SparkSession, d: str) -> DataFrame:
    """A passage is called by its first three words, so that others mention it."""
    return linked.mention_edges(three_word_titles(s, d))


@query(f"WITH {NODES}, {EDGES} SELECT qid, src, dst, kinds, weight::DOUBLE AS weight FROM edges")
def merged_edges(s: SparkSession, d: str) -> DataFrame:
    return linked.merged_edges(node_view(s, d))


TYPED = """typed AS (SELECT qid, src, dst, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT qid, src, dst, 'next' AS kind FROM adj UNION ALL SELECT qid, dst, src, 'previous' FROM adj
  UNION ALL SELECT qid, src, dst, 'entity_coreference' FROM eo UNION ALL SELECT qid, dst, src, 'entity_coreference' FROM eo UNION ALL SELECT qid, src, dst, 'title_mention' FROM tm) GROUP BY 1, 2, 3)"""


@query(f"WITH {NODES}, {OVERLAP}, {ADJ}, {MENTION}, {TYPED} SELECT * FROM typed")
def typed_edges(s: SparkSession, d: str) -> DataFrame:
    return linked.typed_edges(node_view(s, d))


SEEDS = ", seeds AS (SELECT qid, node_ord, semantic, row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, node_ord) AS rank FROM scored QUALIFY rank <= 5)"
HOPS = """, arcs AS (SELECT qid, src, dst, seq FROM edges UNION ALL SELECT qid, dst, src, seq FROM edges), h1 AS (SELECT DISTINCT arcs.qid, dst AS node_ord FROM arcs JOIN seeds ON arcs.qid = seeds.qid AND src = node_ord),
r1 AS (SELECT qid, node_ord, min(hop) AS hop FROM (SELECT qid, node_ord, 0 AS hop FROM seeds UNION ALL SELECT qid, node_ord, 1 FROM h1) GROUP BY ALL),
h2 AS (SELECT DISTINCT arcs.qid, dst AS node_ord FROM arcs JOIN r1 ON arcs.qid = r1.qid AND src = node_ord WHERE hop = 1),
r2 AS (SELECT qid, node_ord, min(hop) AS hop FROM (SELECT * FROM r1 UNION ALL SELECT qid, node_ord, 2 FROM h2) GROUP BY ALL)"""
#: Breadth-first with the parent that discovers a node first: (its place, the edge's place) as one number.
DISCOVERED = """, b0 AS (SELECT qid, node_ord, rank AS disc, 0 AS hop, [node_ord] AS path FROM seeds),
b1 AS (SELECT qid, node_ord, row_number() OVER (PARTITION BY qid ORDER BY way) AS disc, 1 AS hop, path FROM (SELECT a.qid, a.dst AS node_ord, min(disc::HUGEINT * 10000000000000 + seq) AS way, arg_min(list_append(path, a.dst), disc::HUGEINT * 10000000000000 + seq) AS path
  FROM b0 JOIN arcs a ON a.qid = b0.qid AND a.src = b0.node_ord WHERE NOT EXISTS (SELECT 1 FROM b0 o WHERE o.qid = a.qid AND o.node_ord = a.dst) GROUP BY 1, 2)),
b2 AS (SELECT qid, node_ord, row_number() OVER (PARTITION BY qid ORDER BY way) AS disc, 2 AS hop, path FROM (SELECT a.qid, a.dst AS node_ord, min(disc::HUGEINT * 10000000000000 + seq) AS way, arg_min(list_append(path, a.dst), disc::HUGEINT * 10000000000000 + seq) AS path
  FROM b1 JOIN arcs a ON a.qid = b1.qid AND a.src = b1.node_ord WHERE NOT EXISTS (SELECT 1 FROM (SELECT qid, node_ord FROM b0 UNION ALL SELECT qid, node_ord FROM b1) o WHERE o.qid = a.qid AND o.node_ord = a.dst) GROUP BY 1, 2)),
found AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2)"""


@query(f"WITH {NODES}{SCORED}, {EDGES}{SEEDS}{HOPS} SELECT qid, node_ord, hop FROM r2")
def bfs_min_hop(s: SparkSession, d: str) -> DataFrame:
    sc = methods.scored(questions(s, d), node_view(s, d))
    return linked.hops(methods.ranked(sc), 2)


@query(f"WITH {NODES}{SCORED}, {EDGES}{SEEDS}{HOPS}{DISCOVERED} SELECT qid, node_ord, hop, disc::BIGINT AS disc, array_to_string(path, '-') AS path FROM found")
def bfs_paths(s: SparkSession, d: str) -> DataFrame:
    sc = methods.scored(questions(s, d), node_view(s, d))
    return linked.paths(methods.ranked(sc), 2).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "-"))


@query(f"""WITH {NODES}{SCORED}, {EDGES}{SEEDS}{HOPS} SELECT r1.qid, r1.node_ord, count(p.node_ord)::BIGINT AS n, coalesce(md5(string_agg(CASE WHEN p.node_ord IS NOT NULL THEN a.dst END, ',' ORDER BY a.seq, a.dst)), md5('')) AS neighbours
FROM r1 LEFT JOIN arcs a ON a.qid = r1.qid AND a.src = r1.node_ord LEFT JOIN r1 p ON p.qid = a.qid AND p.node_ord = a.dst GROUP BY 1, 2""")
def pool_neighbours(s: SparkSession, d: str) -> DataFrame:
    return linked.pool_neighbours(methods.ranked(methods.scored(questions(s, d), node_view(s, d))), 1)


@query()
def ppr_scores(s: SparkSession, d: str) -> DataFrame:
    out = linked.pagerank(methods.restarts(questions(s, d), node_view(s, d)))
    return graph.pool_normalised(out).withColumn("score", F.round("score", 6))


@query()
def document_paths_k(s: SparkSession, d: str) -> DataFrame:
    """Up to 3 shortest paths of at most 3 hops between all pairs of each question's seeds, over the whole document view."""
    return linked.simple_paths(methods.ranked(methods.scored(questions(s, d), node_view(s, d))), 3).select("qid", "src", "dst", "path", "hops", "path_rank")


_PAIRS2 = """sp AS (SELECT a.qid, a.node_ord AS src, b.node_ord AS dst FROM seeds a JOIN seeds b ON a.qid = b.qid),
walks AS (SELECT qid, src, dst, [src] AS path, 0 AS hops FROM sp WHERE src = dst UNION ALL SELECT sp.qid, sp.src, sp.dst, [sp.src, sp.dst], 1 FROM sp JOIN typed t ON t.qid = sp.qid AND t.src = sp.src AND t.dst = sp.dst WHERE sp.src <> sp.dst
  UNION ALL SELECT sp.qid, sp.src, sp.dst, [sp.src, t.dst, sp.dst], 2 FROM sp JOIN typed t ON t.qid = sp.qid AND t.src = sp.src JOIN typed u ON u.qid = t.qid AND u.src = t.dst AND u.dst = sp.dst WHERE sp.src <> sp.dst AND t.dst <> sp.dst AND t.dst <> sp.src),
paths AS (SELECT *, row_number() OVER (PARTITION BY qid, src, dst ORDER BY hops, path) AS path_rank FROM walks QUALIFY path_rank <= 3)"""


@query(f"WITH {NODES}{SCORED}, {OVERLAP}, {ADJ}, {MENTION}, {TYPED}{SEEDS}, {_PAIRS2} SELECT qid, src, dst, hops, array_to_string(path, '-') AS path, path_rank::INT AS path_rank FROM paths")
def typed_paths_k(s: SparkSession, d: str) -> DataFrame:
    """Up to 3 directed paths of at most 2 hops between any two seeds of a question."""
    paths = linked.typed_paths(methods.ranked(methods.scored(questions(s, d), node_view(s, d))), 3)
    return paths.select("qid", "src", "dst", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), "hops", "path_rank")


@query(f"""WITH {NODES}{SCORED}, {OVERLAP}, {ADJ}, {MENTION}, {TYPED}{SEEDS}, {_PAIRS2}, each AS (SELECT DISTINCT qid, path FROM paths),
steps AS (SELECT qid, path, path[i] AS src, path[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(path))) AS i FROM each)), es AS (SELECT qid, node_ord, e FROM ent),
vals AS (SELECT e.qid, e.path, es.e AS v FROM each e JOIN es ON es.qid = e.qid AND es.node_ord = e.path[1] WHERE len(e.path) = 1
  UNION SELECT p.qid, p.path, n.title FROM steps p JOIN tm ON tm.qid = p.qid AND tm.src = p.src AND tm.dst = p.dst JOIN nodes n ON n.qid = p.qid AND n.node_ord = p.dst
  UNION SELECT p.qid, p.path, a.e FROM steps p JOIN es a ON a.qid = p.qid AND a.node_ord = p.src JOIN es b ON b.qid = p.qid AND b.node_ord = p.dst AND a.e = b.e JOIN typed t ON t.qid = p.qid AND t.src = p.src AND t.dst = p.dst AND contains(t.kinds, 'entity_coreference'))
SELECT e.qid, array_to_string(e.path, '-') AS path, md5(coalesce(string_agg(v, '|' ORDER BY encode(v)), '')) AS vals FROM each e LEFT JOIN vals USING (qid, path) GROUP BY 1, 2""")
def path_grounding(s: SparkSession, d: str) -> DataFrame:
    out = linked.grounded_paths(methods.ranked(methods.scored(questions(s, d), node_view(s, d))), 3)
    return out.select("qid", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), F.md5(F.array_join("values", "|")).alias("vals"))


# retrieval


@query("SELECT * FROM (SELECT a.vec_id, b.vec_id AS near_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id)::INT AS place FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE place <= 5")
def seed_topk_vectors(s: SparkSession, d: str) -> DataFrame:
    j = nearest.candidates(table(s, d, "embeddings"), 5, 6).withColumn("score", F.round("score", 6))
    return j.withColumn("place", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("score"), "near_id"))).filter("place <= 5")


PREFIX = ", used AS (SELECT *, sum(n_tokens) OVER (PARTITION BY qid ORDER BY semantic DESC, node_ord ROWS UNBOUNDED PRECEDING) AS used FROM {0}) SELECT qid, title, sent_id, semantic, used::BIGINT AS used FROM used WHERE used <= 200"


@query(f"WITH {NODES}{SCORED}" + PREFIX.format("scored"))
def dense_prefix_topk(s: SparkSession, d: str) -> DataFrame:
    return methods.dense(questions(s, d), node_view(s, d), BUDGET).select("qid", "title", "sent_id", "semantic", "used")


@query(f"WITH {NODES}{SCORED}, {EDGES}{SEEDS}{HOPS}, pool AS (SELECT scored.* FROM scored JOIN r1 USING (qid, node_ord))" + PREFIX.format("pool"))
def fixed_hop1_topk(s: SparkSession, d: str) -> DataFrame:
    return methods.fixed_hop(questions(s, d), node_view(s, d), None, 1, BUDGET).select("qid", "title", "sent_id", "semantic", "used")


@query(f"WITH {NODES}{SCORED}, {EDGES}{SEEDS}{HOPS}, pool AS (SELECT scored.* FROM scored JOIN r2 USING (qid, node_ord))" + PREFIX.format("pool"))
def fixed_hop2_topk(s: SparkSession, d: str) -> DataFrame:
    return methods.fixed_hop(questions(s, d), node_view(s, d), None, 2, BUDGET).select("qid", "title", "sent_id", "semantic", "used")


ANCH = ", anch AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, node_ord) AS anchor_rank FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid, title ORDER BY semantic DESC, node_ord) = 1) QUALIFY anchor_rank <= 2)"


@query(f"WITH {NODES}{SCORED}{ANCH} SELECT qid, node_ord, title, semantic, anchor_rank::INT AS anchor_rank FROM anch")
def anchors_distinct_title(s: SparkSession, d: str) -> DataFrame:
    return methods.anchors(methods.scored(questions(s, d), node_view(s, d))).select("qid", "node_ord", "title", "semantic", "anchor_rank")


LINKED = r"""j AS (SELECT a.qid, a.node_ord AS anchor, a.anchor_rank, s.node_ord, s.semantic, list_distinct(regexp_extract_all(lower(b.text || chr(10) || 'Known evidence: ' || a.title || ': ' || a.text), '\p{L}+')) AS qw, list_distinct(regexp_extract_all(lower(s.text), '\p{L}+')) AS sw
  FROM anch a JOIN benchmark b ON b.item_id = a.qid JOIN arcs e ON e.qid = a.qid AND e.src = a.node_ord JOIN scored s ON s.qid = e.qid AND s.node_ord = e.dst WHERE s.title <> a.title),
js AS (SELECT * EXCLUDE (qw, sw), round(CASE WHEN len(qw) * len(sw) > 0 THEN len(list_intersect(qw, sw)) / sqrt((len(qw) * len(sw))::DOUBLE) ELSE 0.0 END, 6) AS cond FROM j),
t AS (SELECT * FROM js QUALIFY row_number() OVER (PARTITION BY qid, anchor ORDER BY cond DESC, node_ord) <= 2),
linked AS (SELECT qid, anchor, node_ord, cond, round(cond - semantic, 6) AS gain FROM t QUALIFY row_number() OVER (PARTITION BY qid, node_ord ORDER BY cond DESC, anchor_rank) = 1)"""


@query(f"WITH {NODES}{SCORED}, {EDGES}{SEEDS}{HOPS}{ANCH}, {LINKED} SELECT * FROM linked")
def links_top_l(s: SparkSession, d: str) -> DataFrame:
    sc = methods.scored(questions(s, d), node_view(s, d))
    return methods.links(questions(s, d), sc, None, methods.anchors(sc), nodes=node_view(s, d))


@query(f"""WITH {NODES}{SCORED}, nm AS (SELECT DISTINCT qid, title, dense_rank() OVER (PARTITION BY qid ORDER BY title DESC) - 1 AS pos FROM nodes WHERE qid % 2 = 0 QUALIFY pos < qid % 4),
best AS (SELECT s.*, pos FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid, title ORDER BY semantic DESC, node_ord) = 1) s LEFT JOIN nm USING (qid, title)),
f AS (SELECT *, pos IS NOT NULL AND pos < 2 AS named, count(*) FILTER (pos IS NOT NULL AND pos < 2) OVER (PARTITION BY qid) AS taken FROM best), r AS (SELECT *, row_number() OVER (PARTITION BY qid, named ORDER BY semantic DESC, node_ord) AS rest FROM f)
SELECT qid, node_ord, title, row_number() OVER (PARTITION BY qid ORDER BY named DESC, CASE WHEN named THEN pos ELSE rest END)::INT AS anchor_rank FROM r WHERE named OR rest <= greatest(1, 2 - taken)""")
def anchors_named_first(s: SparkSession, d: str) -> DataFrame:
    """Questions of even number name up to 2 titles: those that are last in order."""
    sc = methods.scored(questions(s, d), node_view(s, d))
    place = F.dense_rank().over(W.partitionBy("qid").orderBy(F.desc("title"))) - 1
    named = sc.filter("qid % 2 = 0").select("qid", "title", place.alias("pos")).distinct().filter("pos < qid % 4")
    return methods.anchors(sc, 2, named).select("qid", "node_ord", "title", "anchor_rank")


# fusion and prefix selection


@query(f"WITH {LINES}{PCT} SELECT qid, ord::INT AS ord, round(p_semantic, 6) AS p_semantic, round(p_graph, 6) AS p_graph, round(p_cond, 6) AS p_cond FROM pc")
def percentile_avg_rank(s: SparkSession, d: str) -> DataFrame:
    c = fusion.with_percentiles(line_view(s, d)).withColumn("p_cond", fusion.percentile("cond", optional=True))
    return c.select("qid", "ord", *[F.round(x, 6).alias(x) for x in ("p_semantic", "p_graph", "p_cond")])


def _prefix_sql(score: str, source: str = "c") -> str:
    return f"""{", " if source == "c" else ""}sc AS (SELECT *, {score} AS score FROM {source}), us AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING) AS used FROM sc)
SELECT qid, ord::INT AS ord, round(score, 6) AS score, used::BIGINT AS used FROM us WHERE used <= {LINE_BUDGET}"""


def _out(df: DataFrame) -> DataFrame:
    return df.select("qid", "ord", F.round("score", 6).alias("score"), "used")


@query(f"WITH {LINES}" + _prefix_sql("round(0.6 * semantic + 0.4 * graph, 9)"))
def blend_topk(s: SparkSession, d: str) -> DataFrame:
    return _out(selection.prefix(line_view(s, d), F.round(fusion.blend(0.6), 9), LINE_BUDGET))


@query(f"WITH {LINES}{PCT}, " + _prefix_sql("round(0.6 * p_semantic + 0.4 * p_graph, 9)", "pc"))
def normalized_topk(s: SparkSession, d: str) -> DataFrame:
    return _out(selection.prefix(fusion.with_percentiles(line_view(s, d)), F.round(fusion.blend(0.6, "p_semantic", "p_graph"), 9), LINE_BUDGET))


@query(f"WITH {LINES}, rr AS (SELECT *, 0.5 / (60 + row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, ord)) + 0.5 / (60 + row_number() OVER (PARTITION BY qid ORDER BY graph DESC, ord)) AS f FROM c), " + _prefix_sql("round(f, 9)", "rr"))
def rrf_topk(s: SparkSession, d: str) -> DataFrame:
    return _out(selection.prefix(line_view(s, d).withColumn("f", fusion.reciprocal(0.5)), F.round("f", 9), LINE_BUDGET))


@query(f"WITH {LINES}" + _prefix_sql("('0x' || substr(md5('0:' || qid || ':' || ord), 1, 8))::BIGINT::DOUBLE"))
def random_topk(s: SparkSession, d: str) -> DataFrame:
    return _out(selection.random(line_view(s, d), 0, budget=LINE_BUDGET))


@query(f"WITH {LINES} SELECT qid, ord::INT AS ord, round(0.6 * semantic + 0.4 * graph, 6) AS score FROM c WHERE round(0.6 * semantic + 0.4 * graph, 9) >= 0.5")
def threshold_select(s: SparkSession, d: str) -> DataFrame:
    c = line_view(s, d).withColumn("score", F.round(fusion.blend(0.6), 9)).filter("score >= 0.5")
    return c.select("qid", "ord", F.round("score", 6).alias("score"))


_TOPS = """r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, ord) AS rs, row_number() OVER (PARTITION BY qid ORDER BY graph DESC, semantic DESC, ord) AS rg, count(*) OVER (PARTITION BY qid) AS n FROM {0})"""


@query(f"""WITH {LINES}, k AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY semantic DESC, ord ROWS UNBOUNDED PRECEDING) <= {LINE_BUDGET} AS s, sum(cost) OVER (PARTITION BY qid ORDER BY graph DESC, ord ROWS UNBOUNDED PRECEDING) <= {LINE_BUDGET} AS g FROM c),
m AS (SELECT qid, CASE WHEN count(*) FILTER (s OR g) > 0 THEN 1 - count(*) FILTER (s AND g) / count(*) FILTER (s OR g)::DOUBLE ELSE 0.0 END AS dis, max(semantic) AS best, CASE WHEN count(*) FILTER (hop = 0) > 0 THEN count(*) FILTER (hop = 0 AND NOT s) / count(*) FILTER (hop = 0)::DOUBLE ELSE 0.0 END AS missed FROM k GROUP BY qid),
w AS MATERIALIZED (SELECT qid, round(0.5 * dis + 0.3 * (1 - best) + 0.2 * missed, 9) AS need FROM m)
SELECT qid, round(need, 8) AS need, CASE WHEN need >= 0.36 THEN 0.2 ELSE 0.6 END::DOUBLE AS alpha_switch, round(greatest(0.1, least(0.9, 0.6 - need)), 8)::DOUBLE AS alpha_continuous FROM w""")
def need_graph_alpha(s: SparkSession, d: str) -> DataFrame:
    n = fusion.need_graph(fusion.need_signals(line_view(s, d), LINE_BUDGET))
    return n.select("qid", F.round("need", 8).alias("need"), "alpha_switch", F.round("alpha_continuous", 8).alias("alpha_continuous"))


@query(f"""WITH {LINES}, {_TOPS.format('c')}, m AS MATERIALIZED (SELECT qid, 1 - count(*) FILTER (rs <= 3 AND rg <= 3) / count(*) FILTER (rs <= 3 OR rg <= 3)::DOUBLE AS dis, avg(semantic) FILTER (rs <= 2) AS top2, max(semantic) FILTER (rs = least(3, n)) AS kth, max(graph) - max(graph) FILTER (rg = n // 2 + 1) AS peak,
  CASE WHEN count(*) FILTER (hop = 0) > 0 THEN count(*) FILTER (hop = 0 AND rs > 3) / count(*) FILTER (hop = 0)::DOUBLE ELSE 0.0 END AS missed FROM r GROUP BY qid)
SELECT qid, round(dis, 6) AS disagreement, round(top2, 7) AS top2, round(kth, 6) AS kth, round(peak, 6) AS peak, round(missed, 6) AS seed_miss, CASE WHEN dis >= 0.6 AND missed >= 0.4 AND top2 < 0.9 AND peak >= 0.65 THEN 0.4 WHEN dis >= 0.5 AND kth < 0.3 AND (missed >= 0.2 OR top2 < 0.85) THEN 0.7 ELSE 1.0 END::DOUBLE AS alpha FROM m""")
def semantic_first_alpha(s: SparkSession, d: str) -> DataFrame:
    n = fusion.semantic_first(fusion.rescue_signals(line_view(s, d), 3))
    return n.select("qid", *[F.round(c, 7 if c == "top2" else 6).alias(c) for c in ("disagreement", "top2", "kth", "peak", "seed_miss")], "alpha")


# folds

_ANCHORED = "units AS (SELECT x.qid, row_number() OVER (PARTITION BY x.qid ORDER BY {order}) AS rk, " + PAIR.format(when="x.anchor IS NOT NULL") + " FROM k x LEFT JOIN k a ON a.qid = x.qid AND a.ord = x.anchor)"
_BEST = "x.score DESC, x.rel DESC, x.semantic DESC, x.ord"
#: Percentile of the conditional score among validated links.
_LINK = "CASE WHEN anchor IS NULL THEN 0.0 WHEN count(*) OVER (PARTITION BY qid, anchor IS NULL) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY qid, anchor IS NULL ORDER BY cond) - 1 + (count(*) OVER (PARTITION BY qid, anchor IS NULL, cond) - 1) / 2.0) / (count(*) OVER (PARTITION BY qid, anchor IS NULL) - 1) END"


@query(f"WITH {LINES}{PCT}, k AS (SELECT *, 0.6 * p_semantic + 0.4 * p_graph AS rel, 0.6 * p_semantic + 0.4 * p_graph + 0.2 * p_cond AS score FROM pc), " + fold_sql(_ANCHORED.format(order=_BEST)))
def conditional_fold(s: SparkSession, d: str) -> DataFrame:
    return selection.conditional_topk(line_view(s, d), 0.6, 0.2, LINE_BUDGET)


@query(f"WITH {LINES}{PCT}, k AS (SELECT *, p_semantic AS score, {_LINK} AS link FROM pc), " + fold_sql("units AS (SELECT x.qid, row_number() OVER (PARTITION BY x.qid ORDER BY CASE WHEN x.anchor IS NOT NULL AND a.cost IS NOT NULL THEN a.score + x.score + 0.3 * x.link ELSE x.score END DESC, x.score DESC, x.ord) AS rk, " + PAIR.format(when="x.anchor IS NOT NULL") + " FROM k x LEFT JOIN k a ON a.qid = x.qid AND a.ord = x.anchor)"))
def pair_fold(s: SparkSession, d: str) -> DataFrame:
    return selection.pair_fold(line_view(s, d), 0.3, LINE_BUDGET)


@query(f"WITH {LINES}{PCT}, k AS (SELECT *, p_semantic AS score, {_LINK} AS link FROM pc), " + fold_sql("units AS (SELECT x.qid, row_number() OVER (PARTITION BY x.qid ORDER BY CASE WHEN x.anchor IS NOT NULL AND a.cost IS NOT NULL THEN a.score + x.score + 0.3 * x.link ELSE x.score END DESC, x.score DESC, x.ord) AS rk, [x.ord::INT] AS ks, [x.cost] AS cs FROM k x LEFT JOIN k a ON a.qid = x.qid AND a.ord = x.anchor)"))
def endpoint_fold(s: SparkSession, d: str) -> DataFrame:
    """Pairs keep their utility, but only the endpoint is taken."""
    return selection.pair_fold(line_view(s, d), 0.3, LINE_BUDGET, preserve_pairs=False)


@query(f"WITH {LINES}{PCT}, {_TOPS.format('pc')}, k AS (SELECT *, 0.6 * p_semantic + 0.4 * p_graph AS rel, round(0.6 * p_semantic + 0.4 * p_graph + 0.2 * p_cond + 0.5 * (1 - (count(*) FILTER (rs <= 3 AND rg <= 3) OVER (PARTITION BY qid)) / (count(*) FILTER (rs <= 3 OR rg <= 3) OVER (PARTITION BY qid))::DOUBLE) * CASE WHEN rg <= 3 AND rs > 3 AND anchor IS NOT NULL THEN p_graph * p_cond / greatest(1, hop) ELSE 0.0 END, 9) AS score FROM r), " + fold_sql(_ANCHORED.format(order=_BEST)))
def rescue_fold(s: SparkSession, d: str) -> DataFrame:
    return selection.rescue_fold(line_view(s, d), 0.6, 0.2, 0.5, 3, LINE_BUDGET)


@query(f"WITH {LINES}{PCT}, k AS (SELECT *, 0.6 * p_semantic + 0.4 * p_graph AS rel, 0.6 * p_semantic + 0.4 * p_graph + 0.2 * p_cond AS score FROM pc), u0 AS (SELECT x.*, a.cost AS acost, a.semantic AS asem, min(x.ord) OVER (PARTITION BY x.qid, x.anchor) AS first_ord, x.anchor IS NOT NULL AND a.cost IS NOT NULL AND row_number() OVER (PARTITION BY x.qid, x.anchor ORDER BY x.score DESC, x.rel DESC, x.ord) = 1 AS reserved FROM k x LEFT JOIN k a ON a.qid = x.qid AND a.ord = x.anchor), " + fold_sql("units AS (SELECT x.qid, row_number() OVER (PARTITION BY x.qid ORDER BY reserved DESC, CASE WHEN reserved THEN asem END DESC NULLS LAST, CASE WHEN reserved THEN first_ord END, score DESC, rel DESC, semantic DESC, ord) AS rk, CASE WHEN acost IS NOT NULL THEN [anchor::INT, ord::INT] ELSE [ord::INT] END AS ks, CASE WHEN acost IS NOT NULL THEN [acost, cost] ELSE [cost] END AS cs FROM u0 x)"))
def chain_reserve_fold(s: SparkSession, d: str) -> DataFrame:
    return selection.chain_reserve(line_view(s, d), 0.6, 0.2, LINE_BUDGET)


@query(f"WITH {LINES}{PCT}, k0 AS (SELECT *, title < 3 AND row_number() OVER (PARTITION BY qid, title ORDER BY p_semantic DESC, ord) = 1 AS reserved, p_semantic / greatest(1, cost) AS density FROM pc), k AS (SELECT * FROM k0 WHERE reserved OR density >= 0.01), " + fold_sql("units AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY reserved DESC, CASE WHEN reserved THEN title END, density DESC, p_semantic DESC, title DESC, ord DESC) AS rk, [ord::INT] AS ks, [cost] AS cs FROM k)"))
def entity_balanced_fold(s: SparkSession, d: str) -> DataFrame:
    return selection.entity_balanced(line_view(s, d), F.when(F.col("title") < 3, F.col("title")), LINE_BUDGET, least=0.01)


@query(f"WITH {LINES}{PCT}, k AS (SELECT *, 0.6 * p_semantic + 0.4 * p_graph AS rel FROM pc), " + fold_sql("units AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, semantic DESC, ord) AS rk, [ord::INT] AS ks, [cost] AS cs FROM k)"))
def coverage_select(s: SparkSession, d: str) -> DataFrame:
    return selection.coverage(line_view(s, d), LINE_BUDGET, alpha=0.6)


@query()
def coverage_bonus_select(s: SparkSession, d: str) -> DataFrame:
    return selection.coverage(line_view(s, d), LINE_BUDGET, 0.1, alpha=0.6)


@query(f"""WITH {LINES}{PCT}, k AS (SELECT *, round(0.6 * p_semantic + 0.4 * p_graph, 9) AS r, 0.6 * p_semantic + 0.4 * p_graph AS score FROM pc), e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY qid)) / 0.15) AS e FROM k),
m AS (SELECT *, round(e / sum(e) OVER (PARTITION BY qid), 9) AS share FROM e), lists AS (SELECT qid, list({{'ks': [ord::INT], 'cs': [cost], 'm': [share]}} ORDER BY r DESC, semantic DESC, ord) AS us FROM m GROUP BY qid),
f AS (SELECT qid, list_reduce(us, lambda s, x: CASE WHEN NOT (s.m[1] >= 0.65 AND len(s.ks) >= 2) AND s.cs[1] + x.cs[1] <= {LINE_BUDGET} THEN {{'ks': list_concat(s.ks, x.ks), 'cs': [s.cs[1] + x.cs[1]], 'm': [s.m[1] + x.m[1]]}} ELSE s END, {{'ks': []::INT[], 'cs': [0]::BIGINT[], 'm': [0.0]::DOUBLE[]}}) AS s FROM lists)
SELECT qid, s.cs[1]::BIGINT AS used, round(s.m[1], 6) AS mass, array_to_string(s.ks, ',') AS selected FROM f""")
def mass_fold(s: SparkSession, d: str) -> DataFrame:
    return selection.mass_fold(line_view(s, d), 0.6, LINE_BUDGET, 0.65, 0.15, 2)


@query()
def closed_mass_select(s: SparkSession, d: str) -> DataFrame:
    """Mass selection over the two-hop pool of the documents, nodes with their path from the seed."""
    return selection.closed_mass(methods.pool(questions(s, d), node_view(s, d), None), 0.6, BUDGET)


@query(f"""WITH {LINES}, l AS (SELECT qid, list(ord::INT ORDER BY semantic DESC, ord) AS sem, list(ord::INT ORDER BY graph DESC, semantic DESC, ord) AS gra, list(cost ORDER BY ord) AS cost FROM c GROUP BY qid),
f AS (SELECT qid, list_reduce([{{'seen': [i::INT], 'sel': []::INT[], 'used': []::BIGINT[]}} FOR i IN range(2 * len(sem))], lambda s, x:
  CASE WHEN len([k FOR k IN (CASE WHEN x.seen[1] % 2 = 0 THEN sem ELSE gra END) IF NOT list_contains(s.seen, k)]) = 0 THEN s
  WHEN s.used[1] + cost[[k FOR k IN (CASE WHEN x.seen[1] % 2 = 0 THEN sem ELSE gra END) IF NOT list_contains(s.seen, k)][1]] <= {LINE_BUDGET}
  THEN {{'seen': list_append(s.seen, [k FOR k IN (CASE WHEN x.seen[1] % 2 = 0 THEN sem ELSE gra END) IF NOT list_contains(s.seen, k)][1]), 'sel': list_append(s.sel, [k FOR k IN (CASE WHEN x.seen[1] % 2 = 0 THEN sem ELSE gra END) IF NOT list_contains(s.seen, k)][1]), 'used': [s.used[1] + cost[[k FOR k IN (CASE WHEN x.seen[1] % 2 = 0 THEN sem ELSE gra END) IF NOT list_contains(s.seen, k)][1]]]}}
  ELSE {{'seen': list_append(s.seen, [k FOR k IN (CASE WHEN x.seen[1] % 2 = 0 THEN sem ELSE gra END) IF NOT list_contains(s.seen, k)][1]), 'sel': s.sel, 'used': s.used}} END, {{'seen': []::INT[], 'sel': []::INT[], 'used': [0]::BIGINT[]}}) AS s FROM l)
SELECT qid, s.used[1]::BIGINT AS used, array_to_string(s.sel, ',') AS selected FROM f""")
def interleave_select(s: SparkSession, d: str) -> DataFrame:
    return selection.interleave(line_view(s, d), LINE_BUDGET)


@query("""WITH RECURSIVE c AS (SELECT label::BIGINT AS qid, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS ord, round(embedding[1]::DOUBLE, 6) AS rel, embedding::DOUBLE[] AS v FROM embeddings),
g(qid, sel, vs) AS (SELECT qid, [arg_min(ord, -rel * 1000000000 + ord / 1000000.0)], [arg_min(v, -rel * 1000000000 + ord / 1000000.0)] FROM c GROUP BY qid UNION ALL
SELECT t.qid, list_append(t.sel, t.ord), list_append(t.vs, t.v) FROM (SELECT g.qid, g.sel, g.vs, c.ord, c.v, row_number() OVER (PARTITION BY g.qid ORDER BY round(0.7 * c.rel - 0.3 * list_max([list_dot_product(c.v, x) FOR x IN g.vs]), 12) DESC, c.ord) AS k
  FROM g JOIN c ON c.qid = g.qid AND NOT list_contains(g.sel, c.ord) WHERE len(g.sel) < 10) t WHERE k = 1)
SELECT qid, 10 * len(sel)::BIGINT AS used, array_to_string(sel, ',') AS selected FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY len(sel) DESC) = 1""")
def mmr_greedy(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    first = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    c = e.select(F.col("label").cast("bigint").alias("qid"), first.alias("ord"), F.lit(10).alias("cost"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("semantic"), "embedding")
    return selection.mmr(c, 100)


def linked_lines(s: SparkSession, d: str) -> DataFrame:
    return line_view(s, d).withColumns({"gain": F.round(F.col("cond") - F.col("semantic"), 6), "preferred": F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>")})


@query()
def marginal_pair(s: SparkSession, d: str) -> DataFrame:
    return selection.marginal_pair(linked_lines(s, d), LINE_BUDGET, 0.3, 0.05, 1.0, 0.0)


@query()
def chain_witness(s: SparkSession, d: str) -> DataFrame:
    return selection.chain_witness(linked_lines(s, d), LINE_BUDGET, 2, 4, 1, least=0.01)


@query()
def entity_witness(s: SparkSession, d: str) -> DataFrame:
    return selection.entity_witness(linked_lines(s, d), LINE_BUDGET, 2, 1, least=0.01)


@query()
def routed_pairs(s: SparkSession, d: str) -> DataFrame:
    return methods.routed_pairs(questions(s, d), node_view(s, d), None, BUDGET)


@query()
def routed_witnesses(s: SparkSession, d: str) -> DataFrame:
    return methods.routed_witnesses(questions(s, d), node_view(s, d), None, BUDGET)


# context, metrics, statistics

_SEL = f"WITH {NODES}{SCORED}, us AS (SELECT *, sum(n_tokens) OVER (PARTITION BY qid ORDER BY semantic DESC, node_ord ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, node_ord) AS sel FROM scored), s AS (SELECT * FROM us WHERE used <= 200)"


def selected(s: SparkSession, d: str) -> DataFrame:
    return methods.dense(questions(s, d), node_view(s, d), BUDGET)


@query(_SEL + ", p2 AS (SELECT qid, passage_ord, title, string_agg(text, chr(10) ORDER BY sent_id) AS body FROM s GROUP BY ALL) SELECT qid, string_agg('[' || title || ']' || chr(10) || body, chr(10) ORDER BY passage_ord) AS context FROM p2 GROUP BY qid")
def context_grouped(s: SparkSession, d: str) -> DataFrame:
    return context.grouped(selected(s, d))


@query(_SEL + " SELECT qid, string_agg('[Evidence ' || sel || ' | ' || title || ']' || chr(10) || text, chr(10) ORDER BY sel) AS context FROM s GROUP BY qid")
def context_numbered(s: SparkSession, d: str) -> DataFrame:
    return context.numbered(selected(s, d))


@query(_SEL + ", l AS (SELECT qid, sel, CASE WHEN lag(title) OVER (PARTITION BY qid ORDER BY sel) IS DISTINCT FROM title THEN '[' || title || ']' || chr(10) || text ELSE text END AS line FROM s) SELECT qid, string_agg(line, chr(10) ORDER BY sel) AS context FROM l GROUP BY qid")
def context_compact(s: SparkSession, d: str) -> DataFrame:
    return context.compact(selected(s, d))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY role, md5(text) ORDER BY conv_id, turn) > 1 AS reused FROM conversations")
def prompt_dedup(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").withColumn("prompt", F.md5("text"))
    return metrics.first_use(c, ["role", "prompt"], ["conv_id", "turn"]).select("conv_id", "turn", "reused")


@query(_SEL + """, g AS (SELECT DISTINCT nodes.qid, node_ord FROM nodes JOIN benchmark ON item_id = qid WHERE length(nodes.text) > 20 AND contains(benchmark.text, nodes.text) UNION SELECT qid, node_ord FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, node_ord) <= 3),
j AS (SELECT coalesce(s.qid, g.qid) AS qid, count(s.node_ord) FILTER (g.node_ord IS NOT NULL) AS tp, count(s.node_ord) AS ns, count(g.node_ord) AS ng FROM s FULL JOIN g ON s.qid = g.qid AND s.node_ord = g.node_ord GROUP BY 1), m AS (SELECT *, CASE WHEN ns > 0 THEN tp / ns::DOUBLE ELSE 0.0 END AS p, CASE WHEN ng > 0 THEN tp / ng::DOUBLE ELSE 0.0 END AS r FROM j)
SELECT qid, (tp = ns AND tp = ng)::INT AS em, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, round(p, 6) AS prec, round(r, 6) AS recall FROM m""")
def evidence_metrics(s: SparkSession, d: str) -> DataFrame:
    q, n = questions(s, d), node_view(s, d)
    facts = n.join(q, "qid").filter((F.length("text") > 20) & F.col("question").contains(F.col("text"))).select("qid", "node_ord")
    gold = facts.unionByName(methods.seeds(methods.scored(q, n), 3).select("qid", "node_ord"))
    m = metrics.evidence_scores(selected(s, d), gold, ["node_ord"])
    return m.select("qid", "em", *[F.round(c, 6).alias(c) for c in ("f1", "prec", "recall")])


@query("SELECT event_type AS method, user_id % 3 AS budget, round(avg(value), 6) AS value, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def method_budget_means(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_type").alias("method"), F.pmod("user_id", F.lit(3)).alias("budget"), "value")
    return metrics.group_means(e, ["method", "budget"], ["value"]).withColumn("value", F.round("value", 6))


@query("SELECT event_type AS method, round(avg(value) FILTER (user_id % 3 = 0), 6) AS b0, round(avg(value) FILTER (user_id % 3 = 1), 6) AS b1, round(avg(value) FILTER (user_id % 3 = 2), 6) AS b2 FROM events GROUP BY 1")
def budget_pivot(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("b", F.concat(F.lit("b"), F.pmod("user_id", F.lit(3)).cast("string")))
    p = e.groupBy(F.col("event_type").alias("method")).pivot("b", ["b0", "b1", "b2"]).agg(F.avg("value"))
    return p.select("method", *[F.round(c, 6).alias(c) for c in ("b0", "b1", "b2")])


@query("""WITH m AS (SELECT user_id AS qid, event_type AS method, avg(value) AS v FROM events GROUP BY ALL), r AS (SELECT qid, v AS r FROM m WHERE method = 'view')
SELECT method, count(*)::BIGINT AS n, round(avg(r), 6) AS mean_reference, round(avg(v), 6) AS mean_method, round(avg(r - v), 6) AS delta FROM m JOIN r USING (qid) WHERE method <> 'view' GROUP BY 1""")
def paired_delta(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "events").groupBy(F.col("user_id").alias("qid"), F.col("event_type").alias("method")).agg(F.avg("value").alias("v"))
    return metrics.paired(m, "view", "v").select("method", "n", *[F.round(c, 6).alias(c) for c in ("mean_reference", "mean_method", "delta")])


@query()
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap(table(s, d, "events"), "event_type", "value", "event_id")


@query("SELECT count(*)::BIGINT AS n_rows, count(DISTINCT user_id)::BIGINT AS n_qids, (count(*) - count(DISTINCT (user_id, event_type, user_id % 3)))::BIGINT AS duplicate_keys, sum((value > 100)::INT)::BIGINT AS budget_violations, count(DISTINCT event_type)::BIGINT AS n_methods FROM events")
def run_validation(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("method"), F.pmod("user_id", F.lit(3)).alias("budget_tokens"), "value")
    return metrics.validation(e, F.lit(100), F.col("value"))


@query("SELECT count(*)::BIGINT AS n FROM (SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error')")
def qid_set_diff(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    side = lambda k: e.filter(F.col("event_type") == k).select("user_id").distinct()
    return side("view").exceptAll(side("error")).agg(F.count("*").alias("n"))


@query("SELECT lang, quantile_disc(n_chars, 0.95)::BIGINT AS p95, round(avg(n_chars), 6) AS mean, max(n_chars) AS most, count(*)::BIGINT AS n FROM documents GROUP BY GROUPING SETS ((), (lang))")
def token_p95(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").groupingSets([[], [F.col("lang")]], F.col("lang"))
    return t.agg(F.expr("percentile_disc(0.95) within group (order by n_chars)").cast("bigint").alias("p95"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("most"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey AS qid, list_distinct(list(l_suppkey) FILTER (l_tax > 0.06)) AS g, list_distinct(list(l_suppkey) FILTER (l_quantity > 25)) AS s, list_distinct(list(l_suppkey) FILTER (l_discount > 0.05)) AS r FROM lineitem GROUP BY 1),
k AS (SELECT qid, coalesce(g, []) AS g, coalesce(s, []) AS s, coalesce(r, []) AS r FROM g)
SELECT qid, CASE WHEN len([x FOR x IN g IF NOT list_contains(s, x)]) = 0 THEN 'sufficient' WHEN len([x FOR x IN g IF NOT list_contains(s, x) AND NOT list_contains(r, x)]) = 0 THEN 'blind' ELSE 'unrecoverable' END AS bucket,
len([x FOR x IN r IF NOT list_contains(s, x) AND list_contains(g, x)])::INT AS rescued FROM k""")
def need_bucket(s: SparkSession, d: str) -> DataFrame:
    side = lambda c: F.collect_set(F.when(F.expr(c), F.col("l_suppkey")))
    g = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(side("l_tax > 0.06").alias("g"), side("l_quantity > 25").alias("s"), side("l_discount > 0.05").alias("r"))
    return g.select("qid", metrics.need_bucket(F.col("g"), F.col("s"), F.col("r")).alias("bucket"), F.size(F.array_intersect(F.array_except("r", "s"), "g")).alias("rescued"))


# certified plans

_PLAN_LINES = """pl AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax, l_quantity) AS ord, l_partkey, l_tax, l_discount, l_linenumber FROM lineitem),
cl AS (SELECT qid, ord, 'c' || ord AS id, CASE WHEN ord = 1 OR l_tax < 0.02 THEN 'Part ' || l_partkey ELSE '?v' || (ord - 1) END AS subject, CASE WHEN l_discount > 0.09 THEN '?v1' ELSE '?v' || ord END AS object, l_partkey, l_linenumber FROM pl),
dp AS (SELECT t.qid, t.id AS target, t.ord, t.subject AS binding, count(s.id) AS n, min(s.id) AS source FROM cl t LEFT JOIN cl s ON s.qid = t.qid AND s.ord < t.ord AND s.object = t.subject WHERE t.subject LIKE '?%' GROUP BY ALL),
sk AS (SELECT c.* FROM cl c WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.qid = c.qid AND dp.source = c.id AND dp.n = 1)),
op AS (SELECT qid, ['lookup', 'compare', 'boolean', 'intersection'][qid % 4 + 1] AS type, CASE WHEN qid % 5 = 0 THEN ['c1'] ELSE list(c.id ORDER BY ord) FILTER (NOT EXISTS (SELECT 1 FROM cl x WHERE x.qid = c.qid AND x.ord > c.ord AND x.subject = c.object)) END AS inputs, CASE WHEN qid % 7 = 0 THEN '?answer' ELSE '?v' || max(ord) END AS output FROM cl c GROUP BY qid),
ck AS (SELECT o.*, (SELECT count(*) FROM dp WHERE dp.qid = o.qid AND n <> 1) AS bad, (SELECT list(id ORDER BY id) FROM sk WHERE sk.qid = o.qid) AS sinks, (SELECT string_agg(source || '>' || target, ',' ORDER BY ord) FROM dp WHERE dp.qid = o.qid) AS deps, (SELECT object FROM cl WHERE cl.qid = o.qid AND cl.id = o.inputs[1]) AS terminal FROM op o),
pv AS (SELECT *, CASE WHEN bad > 0 THEN 'dependency' WHEN list_sort(inputs) <> sinks THEN 'sinks' WHEN type = 'lookup' AND len(inputs) <> 1 THEN 'lookup' WHEN type = 'lookup' AND terminal <> output THEN 'lookup_output' WHEN type IN ('compare', 'intersection') AND len(inputs) < 2 THEN 'branches' END AS error FROM ck)"""


def line_claims(s: SparkSession, d: str) -> DataFrame:
    """Line items as claims: a part is looked up, or the variable of the line before; some reuse the first variable."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_quantity")
    t = table(s, d, "lineitem").withColumn("ord", F.row_number().over(order))
    part = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    subject = F.when((F.col("ord") == 1) | (F.col("l_tax") < 0.02), part).otherwise(F.concat(F.lit("?v"), F.col("ord") - 1))
    obj = F.when(F.col("l_discount") > 0.09, "?v1").otherwise(F.concat(F.lit("?v"), F.col("ord")))
    return t.select(F.col("l_orderkey").alias("qid"), "ord", F.concat(F.lit("c"), F.col("ord")).alias("id"), subject.alias("subject"), obj.alias("object"), "l_partkey", "l_linenumber")


def line_plans(s: SparkSession, d: str) -> DataFrame:
    """Each order as a plan in JSON; inputs and outputs are wrong for some."""
    claim = F.struct("id", "subject", F.lit("r").alias("relation"), "object", F.lit("q").alias("query"))
    c = line_claims(s, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", claim.alias("c")))).alias("cs")).withColumn("cs", F.transform("cs", lambda x: x["c"]))
    last = F.filter("cs", lambda x, i: ~F.exists(F.slice("cs", i + 2, F.size("cs")), lambda y: y["subject"] == x["object"]))
    inputs = F.when(F.col("qid") % 5 == 0, F.array(F.lit("c1"))).otherwise(F.transform(last, lambda x: x["id"]))
    kind = F.get(F.array(*map(F.lit, ("lookup", "compare", "boolean", "intersection"))), (F.col("qid") % 4).cast("int"))
    output = F.when(F.col("qid") % 7 == 0, "?answer").otherwise(F.concat(F.lit("?v"), F.size("cs")))
    op = F.struct(kind.alias("type"), F.lit("o").alias("operator"), inputs.alias("inputs"), output.alias("output"))
    return c.select("qid", F.to_json(F.struct(F.col("cs").alias("claims"), op.alias("operation"))).alias("plan"))


@query(f"WITH {_PLAN_LINES} SELECT qid, error, CASE WHEN error IS NULL THEN coalesce(deps, '') END AS deps, CASE WHEN error IS NULL THEN array_to_string(sinks, ',') END AS sinks, CASE WHEN error IS NULL THEN CASE type WHEN 'lookup' THEN output ELSE '?answer' END END AS output FROM pv")
def plan_validate(s: SparkSession, d: str) -> DataFrame:
    p = certify.parsed(line_plans(s, d))
    return p.select("qid", "error", F.array_join(F.transform("deps", lambda x: F.concat(x["source"], F.lit(">"), x["target"])), ",").alias("deps"), F.array_join(F.array_sort("sinks"), ",").alias("sinks"), F.col("operation.output").alias("output"))


@query(f"WITH {_PLAN_LINES} SELECT dp.qid, source, target, binding FROM dp JOIN pv USING (qid) WHERE error IS NULL")
def plan_dependencies(s: SparkSession, d: str) -> DataFrame:
    return certify.parsed(line_plans(s, d)).select("qid", F.explode("deps").alias("x")).select("qid", "x.source", "x.target", "x.binding")


@query(f"WITH {_PLAN_LINES} SELECT sk.qid, id FROM sk JOIN pv USING (qid) WHERE error IS NULL")
def plan_sinks(s: SparkSession, d: str) -> DataFrame:
    return certify.parsed(line_plans(s, d)).select("qid", F.explode("sinks").alias("id"))


@query(f"""WITH {_PLAN_LINES}, t AS (SELECT DISTINCT qid, CASE l_linenumber % 3 WHEN 0 THEN 'part  ' || l_partkey ELSE 'Part ' || l_partkey || ' (film)' END AS title FROM cl WHERE l_linenumber % 3 < 2),
tk AS (SELECT *, {_MENTION.format('title', 't')} FROM t), sb AS (SELECT qid, id, subject, {_MENTION.format('subject', 's')} FROM cl WHERE subject NOT LIKE '?%'),
g AS (SELECT s.qid, s.id, count(*) FILTER (sn = tn) AS ne, min(title) FILTER (sn = tn) AS e, count(*) AS nl, min(title) AS l FROM sb s JOIN tk t ON s.qid = t.qid AND (sn = tn OR sk = tk OR len(list_intersect(st, tt)) >= 2 OR len([x FOR x IN list_intersect(st, tt) IF length(x) >= 6]) > 0) GROUP BY 1, 2)
SELECT c.qid, c.id, CASE WHEN ne = 1 THEN e WHEN ne = 0 AND nl = 1 THEN l END AS source_title FROM cl c LEFT JOIN g USING (qid, id)""")
def title_grounding(s: SparkSession, d: str) -> DataFrame:
    c = line_claims(s, d)
    k = F.col("l_linenumber") % 3
    part = F.col("l_partkey").cast("string")
    titles = c.filter(k < 2).select("qid", F.when(k == 0, F.concat(F.lit("part  "), part)).otherwise(F.concat(F.lit("Part "), part, F.lit(" (film)"))).alias("title"))
    return certify.grounded(c, titles).select("qid", "id", "source_title")


@query(f"WITH {_PLAN_LINES}, k AS (SELECT qid, list(id ORDER BY ord) AS a, list(id ORDER BY l_partkey, ord) AS b FROM cl GROUP BY qid) SELECT qid, array_to_string(list_filter(list_concat(a, b), lambda x, i: list_position(list_concat(a, b), x) = i), ',') AS united FROM k")
def ordered_union(s: SparkSession, d: str) -> DataFrame:
    g = line_claims(s, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("a"), F.array_sort(F.collect_list(F.struct("l_partkey", "ord", "id"))).alias("b"))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    return g.select("qid", F.array_join(certify.ordered_union(ids("a"), ids("b")), ",").alias("united"))


def judged(s: SparkSession, d: str) -> DataFrame:
    c = line_view(s, d)
    return c.select("qid", "title", F.col("ord").cast("string").alias("key"), F.when(F.col("hop") > 0, "supported").otherwise("refuted").alias("label"), F.col("graph").alias("confidence"), F.col("semantic").alias("raw"), F.lit("x").alias("value"), "cost").withColumnRenamed("title", "claim")


@query(f"""WITH {LINES}, a AS (SELECT *, row_number() OVER (PARTITION BY qid, title ORDER BY graph DESC, semantic DESC, ord::VARCHAR DESC) AS rank FROM c WHERE hop > 0 AND graph >= 0.7 QUALIFY rank <= 2)
SELECT e.qid, e.title AS claim, a.ord::VARCHAR AS key, a.rank::INT AS rank, CASE WHEN a.ord IS NULL THEN 'claim_uncovered' END AS error FROM (SELECT DISTINCT qid, title FROM c) e LEFT JOIN a USING (qid, title)""")
def claim_retain(s: SparkSession, d: str) -> DataFrame:
    return certify.retained(judged(s, d), 0.7, 2).select("qid", "claim", "key", "rank", "error")


def witness_parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Plans of each order's first three lines, one after the other; a claim may be met by its line or the next."""
    c = line_view(s, d).filter("ord <= 4")
    first = c.filter("ord <= 3").groupBy("qid").agg(F.sort_array(F.collect_list(F.concat(F.lit("c"), F.col("ord").cast("string")))).alias("ids"))
    dep = F.transform(F.slice("ids", 2, 3), lambda x, i: F.struct(F.get("ids", i).alias("source"), x.alias("target"), F.lit("?b").alias("binding")))
    plans = first.select("qid", F.transform("ids", lambda x: F.struct(x.alias("id"))).alias("claims"), F.when(F.col("qid") % 2 == 0, dep).otherwise(F.slice(dep, 1, 0)).alias("deps"))
    value = lambda x: F.when(x % 5 == 0, "Golden Harbour").otherwise("The golden harbour")
    a = c.select("qid", F.explode(F.array(F.col("ord"), F.col("ord") - 1)).alias("of"), "ord", "graph").filter("of between 1 and 3")
    a = a.select("qid", F.concat(F.lit("c"), F.col("of").cast("string")).alias("claim"), F.col("ord").cast("int").alias("rank"), F.col("ord").cast("string").alias("key"), F.col("graph").alias("confidence"), F.create_map(F.lit("?b"), value(F.col("ord"))).alias("bindings"), F.concat(F.lit("quote "), F.col("ord").cast("string")).alias("quote"))
    x, y = c.select("qid", F.col("ord").alias("i"), "semantic"), c.select("qid", F.col("ord").alias("j"))
    p = x.join(y, "qid").filter("i < j and j - i <= 2").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    p = p.select("qid", (F.col("i") * 10 + F.col("j")).cast("int").alias("rank"), F.concat(F.lit("c"), "n").alias("source"), F.concat(F.lit("c"), F.col("n") + 1).alias("target"), F.col("i").cast("string").alias("from_key"), F.col("j").cast("string").alias("to_key"), F.when(F.col("j") - F.col("i") == 2, F.array("i", F.col("i") + 1, "j")).otherwise(F.array("i", "j")).cast("array<string>").alias("path"), F.round(1 - F.col("semantic") / 4, 6).alias("confidence"), F.lit("golden harbour").alias("value"))
    nodes = c.select("qid", F.col("ord").cast("string").alias("key"), F.concat(F.lit("t"), F.col("title").cast("string")).alias("title"), F.concat(F.lit("sentence "), F.repeat(F.lit("word "), (F.col("cost") / 5).cast("int"))).alias("text"))
    return plans, a, p, nodes


@query()
def witness_solve(s: SparkSession, d: str) -> DataFrame:
    out = certify.witnesses(*witness_parts(s, d), [20, 60], sufficiency=0.7)
    return out.withColumns({"keys": F.array_join("keys", ","), "assigned": F.array_join("assigned", ",")})


def three_word_titles(s: SparkSession, d: str) -> DataFrame:
    """The document view with passages called by their first three words, so that others mention them."""
    p = passage_view(s, d).withColumn("title", F.array_join(F.slice(F.split(F.get("sentences", F.lit(0)), " "), 1, 3), " "))
    return multihop.sentences(p)


@query()
def quote_projection(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").withColumn("ws", F.split("text", " "))
    return t.select("doc_id", F.md5(T.project_quote(F.col("text"), F.concat_ws(" ", F.element_at("ws", 1), F.element_at("ws", -1)), F.array(F.element_at("ws", 1)))).alias("span"), T.canonical_key(F.col("source")).alias("key"))


# judgments, prompts, sweeps and reports

TASKS = """t AS (SELECT l_orderkey AS qid, l_linenumber AS claim, l_partkey::VARCHAR AS task_id, l_quantity::BIGINT AS kind, l_suppkey FROM lineitem)"""


def payloads(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A judgment of each line item as JSON, some of them wrong in one way or another, and the tasks asked for."""
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("claim"), F.col("l_partkey").cast("string").alias("task_id"), F.col("l_quantity").cast("bigint").alias("kind"), "l_suppkey")
    label = F.when(F.col("kind") % 11 == 3, "maybe").when(F.col("kind") % 3 == 0, "not_entailed").otherwise("entailed")
    confidence = F.when(F.col("kind") % 13 == 5, "true").when(F.col("kind") % 17 == 6, "1.5").otherwise("0.75")
    bindings = F.when(F.col("kind") % 3 == 0, "{}").otherwise(F.concat(F.lit('{"?a":"v'), F.col("l_suppkey").cast("string"), F.lit('"}')))
    body = F.concat(F.lit('{"judgments":[{"task_id":"'), F.when(F.col("kind") == 7, "x").otherwise(F.col("task_id")), F.lit('","label":"'), label, F.lit('","confidence":'), confidence, F.lit(',"bindings":'), bindings, F.when(F.col("kind") == 9, ',"note":1').otherwise(""), F.lit("}]}"))
    return t.select("qid", "claim", body.alias("payload")), t.select("qid", "claim", "task_id")


@query(f"""WITH {TASKS}, k AS (SELECT *, kind % 11 = 3 OR kind % 13 = 5 OR kind % 17 = 6 OR kind IN (7, 9) OR count(*) OVER (PARTITION BY qid, claim, task_id) > 1 AS wrong FROM t),
g AS (SELECT *, bool_or(wrong) OVER (PARTITION BY qid, claim) AS bad, row_number() OVER (PARTITION BY qid, claim) AS place FROM k)
SELECT qid, claim, CASE WHEN NOT bad THEN task_id END AS task_id, CASE WHEN bad THEN NULL WHEN kind % 3 = 0 THEN 'not_entailed' ELSE 'entailed' END AS label, CASE WHEN NOT bad THEN 0.75::DOUBLE END AS confidence,
CASE WHEN NOT bad AND kind % 3 <> 0 THEN 'v' || l_suppkey END AS binding, CASE WHEN bad THEN 'claim_verification_invalid' END AS error FROM g WHERE NOT bad OR place = 1""")
def claim_judgments(s: SparkSession, d: str) -> DataFrame:
    j = verify.judgments(*payloads(s, d))
    return j.select("qid", "claim", "task_id", "label", "confidence", F.try_element_at("bindings", F.lit("?a")).alias("binding"), "error")


@query("""SELECT l_orderkey AS qid, l_linenumber AS claim, CASE WHEN q % 7 = 0 THEN 'variables' WHEN q % 7 = 1 THEN 'constraint' WHEN q % 7 = 2 THEN 'forbidden' WHEN q % 7 = 3 THEN 'surface' END AS reason
FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem)""")
def claim_rejects(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint") % 7)
    key, value = F.when(F.col("q") == 0, "?z").otherwise("?a"), F.when(F.col("q") == 2, "Not  Stated").when(F.col("q") == 3, "absentee").otherwise("truck")
    fixed = F.when(F.col("q") == 1, F.create_map(F.lit("?a"), F.lit("other"))).otherwise(F.create_map().cast("map<string,string>"))
    one = lambda v: F.array(F.lit(v))
    none = F.array().cast("array<string>")
    surface = F.concat(F.lit("sent by "), value)
    reason = verify.grounding_reject(F.create_map(key, value), one("?a"), fixed, none, one("Title"), none, F.when(F.col("q") == 3, "sent by train").otherwise(surface), surface, F.lit(""))
    return t.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("claim"), reason.alias("reason"))


@query(f"""WITH r AS (SELECT item_id AS qid, text AS question, CASE WHEN item_id % 3 = 0 THEN '{{"claims":' || item_id || '}}' END AS cert, CASE item_id % 2 WHEN 0 THEN 'chained_reasoning' ELSE 'direct_comparison' END AS route FROM benchmark)
SELECT qid, md5($p${prompts.OPENING}$p$ || CASE WHEN cert IS NULL THEN $p${prompts.SHORT}$p$ ELSE $p${prompts.CERTIFIED}$p$ END || CASE route WHEN 'chained_reasoning' THEN $p${prompts.HINTS["chained_reasoning"]}$p$ ELSE $p${prompts.HINTS["direct_comparison"]}$p$ END
|| coalesce($p${prompts.CONTRACT}$p$ || cert || chr(10) || chr(10), '') || 'Context:' || chr(10) || 'c' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:') AS prompt FROM r""")
def prompt_build(s: SparkSession, d: str) -> DataFrame:
    q = questions(s, d)
    cert = F.when(F.col("qid") % 3 == 0, F.concat(F.lit('{"claims":'), F.col("qid").cast("string"), F.lit("}")))
    route = F.when(F.col("qid") % 2 == 0, "chained_reasoning").otherwise("direct_comparison")
    return q.select("qid", F.md5(prompts.prompt(F.col("question"), F.lit("c"), route, cert)).alias("prompt"))


CONFIG = {"methods": [{"name": "dense", "kind": "dense", "budget_tokens": [100, 200], "top_k": 50}, {"name": "blend", "kind": "selective_graph", "alpha": [0.4, 0.6, 1.0], "budget_tokens": [200, 600]}]}


@query("""SELECT o_orderkey AS qid, method, alpha::DOUBLE AS alpha, budget_tokens::BIGINT AS budget_tokens, top_k::BIGINT AS top_k, NULL::DOUBLE AS graph_rescue_weight FROM orders, (VALUES ('dense', NULL, 100, 50), ('dense', NULL, 200, 50),
('blend', 0.4, 200, NULL), ('blend', 0.4, 600, NULL), ('blend', 0.6, 200, NULL), ('blend', 0.6, 600, NULL), ('blend', 1.0, 200, NULL), ('blend', 1.0, 600, NULL)) v(method, alpha, budget_tokens, top_k)""")
def expected_rows(s: SparkSession, d: str) -> DataFrame:
    return sweeps.expected(table(s, d, "orders").select(F.col("o_orderkey").alias("qid")), CONFIG)


@query("SELECT o_orderpriority AS qtype, o_orderstatus AS error, count(*)::BIGINT AS n, grouping(o_orderpriority)::BIGINT AS overall FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority, o_orderstatus))")
def error_histogram(s: SparkSession, d: str) -> DataFrame:
    return metrics.error_histogram(table(s, d, "orders").select(F.col("o_orderpriority").alias("qtype"), F.col("o_orderstatus").alias("error")))


@query("SELECT event_type AS method, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END) / count(*), 6) AS value, count(*)::BIGINT AS n FROM events GROUP BY 1")
def means_null_as_zero(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_type").alias("method"), F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return metrics.group_means(e, ["method"], ["value"], null_as_zero=True).withColumn("value", F.round("value", 6))


@query("""WITH p AS (SELECT l_suppkey AS method, round(avg(l_quantity), 3) AS cost, round(avg(l_extendedprice), 2) AS gain FROM lineitem GROUP BY 1)
SELECT method, cost, gain, gain >= max(gain) OVER (ORDER BY cost RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS frontier FROM p""")
def trade_off_points(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("method")).agg(F.round(F.avg("l_quantity"), 3).alias("cost"), F.round(F.avg("l_extendedprice"), 2).alias("gain"))
    return reports.trade_off(p, "cost", "gain")
