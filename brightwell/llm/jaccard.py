"""N-gram Jaccard join (operator 7): which texts link by the similarity of their word shingles.

Method: *token-group matrix*.  Similar documents are put into groups around a verified leader, each
group stores the union of its members' tokens, a query's overlap with a group is bounded by that
union, and only groups that the bound admits are opened and verified pair by pair.

Steps, all exact:

1. Equal word sequences form a class; one row per class goes on (``classes``).
2. Tokens are 64-bit hashes of the distinct five-word shingles, in hash order.  If two sets link,
   the first tokens that they have in common lie within a fixed share of both (``prefix``); a class
   of which too few prefix tokens occur in any other class can link with nothing (``sharing``).
3. The rest get groups: rounds of min-hash buckets, in each of which every class is verified
   against the bucket's smallest id.  Linked classes are one component from then on, so pairs
   inside a group are never listed.
4. Tokens found in several components make the matrix.  A class of which fewer tokens than a link
   needs lie in it is done; the others look up groups by their rarest tokens, the bound is counted
   on the matrix, and admitted groups are opened (``across``).
5. Components of all verified links; copies get their class's component.

No pair is lost: every step only drops what cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WIDTH = 5
PERCENT = 75
#: Rounds of min-hash grouping; more rounds make fewer, larger groups, the result is the same.
ROUNDS = 3
#: A ``1 / MORE`` of a set beyond what may miss goes into its prefix: more rows, but fewer classes that pass by chance.
MORE = 5
#: Pairs of one leader that are verified in one task.
LEADER_PAIRS = 500
#: Copies of each hot key where these are too many to broadcast.
SPREAD = 64
#: One of so many texts (by hash) is looked at to find tokens that most texts share; that decides where rows go, never which.
SAMPLE = 64
#: Tokens in so many sampled texts are dealt to ``SPREAD`` parts, the ``HOT_MOST`` most frequent at most: any other has less than 1 / HOT_MOST of the rows.
HOT_LEAST = 64
HOT_MOST = 20_000
#: Classes that a task of the prefix scan remembers, to emit copies only once.
SEEN = 200_000
_ODD = np.random.default_rng(7).integers(0, 2**63, WIDTH + ROUNDS, np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at the six ASCII blanks (both are what bytes do)."""
    return (text or "").encode().lower().split()


def class_key(ws: list[bytes]) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(b" ".join(ws))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def tokens(ws: list[bytes]) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle, no word none."""
    import xxhash

    if not ws:
        return np.empty(0, np.int64)
    if len(ws) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), len(ws))], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = len(ws) - WIDTH + 1
    x = np.zeros(n, np.uint64)
    for j in range(WIDTH):
        x += h[j : j + n] * _ODD[j]
    x ^= x >> np.uint64(32)
    x *= _ODD[0]
    x ^= x >> np.uint64(29)
    return np.unique(x.view(np.int64))


def need(n: int) -> int:
    """Common tokens that a set of ``n`` needs at least for any link."""
    return (PERCENT * n + 99) // 100


def prefix(n: int) -> int:
    """First tokens in which a link must show: those that may miss, and a fifth more, which ``sharing`` counts."""
    return min(n, n - need(n) + max(1, n // MORE))


def _need(n: Column) -> Column:
    return F.floor((F.lit(PERCENT) * n + 99) / 100)


def class_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, n`` of each row: 128-bit key of its word sequence, and its set's size."""

    def run(batches: Iterator[dict]) -> Iterator[list]:
        for b in batches:
            rows = [(*class_key(ws), len(tokens(ws))) for ws in map(words, b["text"])]
            yield [b["doc_id"], *([r[i] for r in rows] for i in range(3))]

    return common.map_rows(docs.select("doc_id", "text"), run, "doc_id bigint, k1 bigint, k2 bigint, n bigint")


def prefix_rows(docs: DataFrame) -> DataFrame:
    """``tok (48 bits), h``: prefix tokens with the class key's first half; a task emits a class once."""

    def run(batches: Iterator[dict]) -> Iterator[list]:
        seen: set[int] = set()
        for b in batches:
            toks, keys, sizes = [], [], []
            for ws in map(words, b["text"]):
                h = class_key(ws)[0]
                if not ws or h in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h)
                t = tokens(ws)
                t = t[: prefix(len(t))]
                toks.append(t), keys.append(h), sizes.append(len(t))
            if toks:
                t = np.concatenate(toks).view(np.uint64) >> np.uint64(16)
                yield [pa.array(t.view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), sizes))]

    return common.map_rows(docs.select("text"), run, "tok bigint, h bigint")


def hot_tokens(sampled: DataFrame, values: int) -> DataFrame:
    """``tok`` of those in the most sampled rows ``(tok, h)`` and in ``values`` (1 or 2) ``h`` at least; ``HOT_MOST`` rows at most, so it may be broadcast."""
    often = sampled.groupBy("tok").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    often = often.filter((F.col("n") >= HOT_LEAST) & (F.lit(values == 1) | (F.col("lo") < F.col("hi"))))
    return common.written(often.orderBy(F.desc("n"), "tok").limit(HOT_MOST).select("tok"), "often")


def sharing(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes that may link: enough of their prefix tokens are in another class's prefix.

    A token that the sample shows in two classes is shared for certain, so its rows need not meet and
    are dealt by class; those of any other token meet in one task.
    """
    hot = hot_tokens(prefix_rows(docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)), 2)
    rows = prefix_rows(docs).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "tok", "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash("h"), F.lit(SPREAD))).otherwise(0))
    w = W.partitionBy("tok", "salt").orderBy("h")
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select("h", "hot", F.lag("h").over(w).alias("before"), F.min("h").over(every).alias("lo"), F.max("h").over(every).alias("hi"))
    shared = rows.filter("(hot or lo <> hi) and (before is null or before <> h)").groupBy("h").agg(F.count("*").alias("shared"))
    enough = F.greatest(F.lit(1), F.floor(_need(F.col("n")) / MORE))
    return classes.join(shared, classes.k1 == shared.h).filter(F.col("shared") >= enough).select("id", "k1", "k2")


def sets_of(docs: DataFrame, some: DataFrame, distinct_ids: bool) -> DataFrame:
    """``id, n, toks, m0 ..``: whole sets and min-hashes of the classes in ``some``."""
    rows = common.joined(docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text"), some, "id")
    hashes = [f"m{r}" for r in range(ROUNDS)]

    def run(batches: Iterator[dict]) -> Iterator[list]:
        for b in batches:
            ids, toks, mins = [], [], []
            for i, text, k1, k2 in zip(b["id"], b["text"], b["k1"], b["k2"], strict=True):
                ws = words(text)
                if class_key(ws) != (k1, k2):
                    continue
                t = tokens(ws)
                ids.append(i), toks.append(t)
                mins.append([int(((t.view(np.uint64) * m) >> np.uint64(1)).min()) for m in _ODD[WIDTH:]])
            sizes = [len(t) for t in toks]
            flat = pa.array(np.concatenate(toks) if toks else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), flat)
            yield [ids, sizes, lists, *([m[r] for m in mins] for r in range(ROUNDS))]

    out = common.map_rows(rows.select("id", "text", "k1", "k2"), run, "id bigint, n bigint, toks array<bigint>, " + ", ".join(f"{h} bigint" for h in hashes))
    return common.written(out if distinct_ids else out.dropDuplicates(["id", "n", "toks"]), "sets")


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """``key, copies`` of the keys with ``LEADER_PAIRS`` rows or more: into how many parts their rows are dealt."""
    often = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= LEADER_PAIRS)
    return common.written(often.select(key, (F.floor(F.col("n") / LEADER_PAIRS) + 1).cast("int").alias("copies")), "hot")


def salted(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with ``salt``: 0, but for a hot key by a hash of ``by``.  No task gets all rows of a key.

    The hot keys are broadcast where they are few; else each is copied ``SPREAD`` times, and the rows are dealt to the copies.
    """
    if hot.count() <= common.BROADCAST_ROWS:
        out = rows.join(F.broadcast(hot), key, "left")
    else:
        spread = hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        out = rows.withColumn("part", F.pmod(F.hash(by), F.lit(SPREAD))).join(spread, [key, "part"], "left").drop("part")
    return out.withColumn("salt", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("copies"))).cast("int")).drop("copies")


def copied(table: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``table``, which has each key once, with one row for each ``salt`` of its key."""
    out = common.joined(table, hot, key, "left")
    return out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` that link.  A ``b`` with many pairs is copied, so that its pairs go to several tasks."""
    hot = hot_keys(pairs, "b")
    left = salted(pairs.select("a", "b"), hot, "b", "a")
    leaders = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb")).join(pairs.select("b").distinct(), "b")
    leaders = copied(leaders, hot, "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta")), "a").join(leaders, ["b", "salt"])
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("common"))
    return both.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * PERCENT).select("a", "b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id, component``: the smallest id that each node of ``edges (a, b)`` reaches.

    Labels go along edges and then jump to their label's label, so the rounds grow with the
    logarithm of a component's diameter.  A node with many edges is copied, so that they go to several
    tasks.  Each round is written to the shared folder and the one before is deleted.
    """
    edges = common.written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    hot = hot_keys(edges, "b")
    edges = common.written(salted(edges, hot, "b", "a"), "edges")
    labels = common.written(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), name)
    while True:
        near = edges.join(copied(labels.select(F.col("id").alias("b"), F.col("component").alias("other")), hot, "b"), ["b", "salt"])
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        step = labels.join(near, "id").select("id", F.least("component", "other").alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        new = common.written(step.join(jump, "next").select("id", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("was")).alias("moved")), name)
        common.discard(labels)
        labels = new
        if new.filter("moved").isEmpty():
            return new.select("id", "component")


def grouped(sets: DataFrame) -> DataFrame:
    """Verified links ``a, b`` of classes to group leaders, round by round for those without one."""
    links, free = None, sets
    for r in range(ROUNDS):
        bucket = free.groupBy(f"m{r}").agg(F.min("id").alias("b"), F.count("*").alias("size")).filter("size > 1")
        pairs = free.select(F.col("id").alias("a"), f"m{r}").join(bucket, f"m{r}").filter("a <> b").select("a", "b")
        found = common.written(verified(pairs, sets), "links")
        links = found if links is None else links.union(found)
        if r + 1 < ROUNDS:
            free = free.join(found.select(F.col("a").alias("id")), "id", "left_anti")
    return links


def across(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Verified links between different components, through the token-group matrix.

    Tokens with the same posting list (those of a passage that many texts share) are one column of
    the matrix, with their number as its weight: nothing is lost and a pair meets once a passage.
    Tokens in very many texts get their sums by partial aggregates, and no task gets all their rows.
    """
    member = sets.select("id", "toks").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("g"), "toks")
    member = common.written(member, "member", reclaim=True)
    cells = member.select("id", "g", F.explode("toks").alias("tok"))
    sums = {"lo": F.min("g"), "hi": F.max("g"), "df": F.count("*"), "posting": F.bit_xor(F.xxhash64("id"))}
    hot = hot_tokens(cells.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).withColumnRenamed("g", "h"), 1)
    # one pass at any size: the rows of all other tokens become a sum in each task, under no token
    marked = cells.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "tok", "left")
    known = marked.groupBy(F.when(F.col("hot"), F.col("tok")).alias("tok")).agg(*[c.alias(f"{n}_hot") for n, c in sums.items()])
    known = common.written(known, "known")
    toks = cells.join(F.broadcast(known), "tok", "left")
    toks = toks.withColumn("salt", F.when(F.col("df_hot") > 0, F.pmod(F.hash("id"), F.lit(SPREAD))).otherwise(0))
    w = W.partitionBy("tok", "salt")
    toks = toks.select("id", "g", *[F.coalesce(f"{n}_hot", c.over(w)).alias(n) for n, c in sums.items()])
    cross = toks.filter("lo <> hi").groupBy("id", "g", "df", F.xxhash64("df", "posting").alias("col")).agg(F.count("*").alias("weight"))
    cross = common.written(cross, "matrix", reclaim=True)
    common.discard(member)
    cross = cross.join(sets.select("id", "n"), "id")
    able = cross.groupBy("id").agg(F.sum("weight").alias("inside"), F.first("n").alias("n")).filter(F.col("inside") >= _need(F.col("n"))).select("id", "inside")
    # the tokens outside the matrix are the rarest, so they come first; "rest" are those from a column on
    earlier = F.coalesce(F.sum("weight").over(W.partitionBy("id").orderBy("df", "col").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = cross.join(able, "id").withColumn("rest", F.col("inside") - earlier).select("id", "n", "g", "col", "weight", "rest")
    rows = common.written(rows, "able")
    first = rows.filter(F.col("rest") >= _need(F.col("n"))).select("id", "n", "g", "col", "rest")
    union = rows.select("col", "g").distinct()
    entry = first.groupBy("col", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest_g"))
    q = first.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("g").alias("ga"), "col", F.col("rest").alias("rest_a"))
    # a link of sizes x and y has 75 / 175 of x + y in common at least, all of it from its first common column on
    enough = lambda tokens, other: F.col(tokens) * (100 + PERCENT) >= (F.col("na") + F.col(other)) * PERCENT
    fits = (F.col("most") * 100 >= F.col("na") * PERCENT) & (F.col("least") * PERCENT <= F.col("na") * 100) & enough("rest_a", "least") & enough("rest_g", "least")
    seen = q.join(entry, "col").filter((F.col("ga") < F.col("g")) & fits).groupBy("a", "na", "g").agg(F.min("least").alias("least"))
    seen = common.written(seen, "seen")
    overlap = seen.join(rows.select(F.col("id").alias("a"), "col", "weight"), "a").join(union, ["col", "g"]).groupBy("a", "na", "g", "least").agg(F.sum("weight").alias("bound"))
    open_ = overlap.filter((F.col("bound") >= _need(F.col("na"))) & enough("bound", "least")).select("a", "g")
    inside = first.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g", "col", F.col("rest").alias("rest_b"))
    pairs = q.join(open_, "a").join(inside, ["g", "col"])
    pairs = pairs.filter((F.col("nb") * 100 >= F.col("na") * PERCENT) & (F.col("nb") * PERCENT <= F.col("na") * 100) & enough("rest_a", "nb") & enough("rest_b", "nb"))
    return verified(common.written(pairs.select("a", "b").distinct(), "pairs"), sets)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` for each row of ``docs (doc_id, text)``.

    ``class_id`` is the smallest doc_id with the same word sequence.  Null and empty texts have no
    shingle and link with nothing, so they are their own component.  A null doc_id stays null and
    takes no part in links.  Repeated rows repeat with equal values; rows that share a doc_id are
    one node, which links by any of its texts, and each has its row in the result.  An empty table
    gives an empty result.  Further columns are ignored.
    """
    with common.scope("keys", "classes", "components"):
        return _jaccard_components(docs.select("doc_id", "text"))


def _jaccard_components(docs: DataFrame) -> DataFrame:
    keys = common.written(class_keys(docs), "keys")
    classes = keys.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"))
    classes = common.written(classes, "classes")
    distinct_ids = keys.groupBy("doc_id").count().filter("count > 1").isEmpty() and classes.groupBy("id").count().filter("count > 1").isEmpty()
    some = common.written(sharing(docs, classes), "sharing", reclaim=True)
    sets = sets_of(docs, some, distinct_ids)
    links = grouped(sets)
    near = components(links)
    more = common.written(across(sets, near), "across")
    final = near if more.isEmpty() else components(links.union(more))
    by_class = classes.select("k1", "k2", "id").join(final, "id", "left").select("k1", "k2", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component"))
    out = keys.join(by_class, ["k1", "k2"], "left").filter("true")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that of its smallest doc_id.

    Of several rows with that doc_id the one whose text has the smallest hash stays, so repeated rows
    stay once.  Rows without a doc_id link with nothing; of those with an equal text one stays.  An
    empty table gives an empty result; columns of any name are carried along.
    """
    found = common.written(jaccard_components(docs).select("doc_id", "component_id"), "found")
    gone = common.written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = common.joined(docs, gone, "doc_id", "left_anti", most=common.BROADCAST_IDS).select(docs.columns)
    # pre-aggregated in each task, so a doc_id or a text may be in any number of rows
    one = lambda rows, *by: rows.groupBy(*by).agg(F.min_by(F.struct("*"), F.xxhash64("text")).alias("kept_row")).select("kept_row.*")
    twice = common.written(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    n = twice.count()
    if n:
        kept = kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one(common.joined(kept, twice, "doc_id", "left_semi", n).select(docs.columns), "doc_id"))
    if not found.filter("doc_id is null").isEmpty():
        kept = kept.filter("doc_id is not null").unionByName(one(kept.filter("doc_id is null"), F.xxhash64("text"), F.sha2("text", 256)))
    return kept


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.documents(spark, sf_dir))


SHINGLES_SQL = r"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
sized AS (SELECT doc_id, s, len(s)::BIGINT AS n FROM sets),
toks AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM toks a JOIN toks b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
"""

ORACLE = (
    "WITH RECURSIVE "
    + SHINGLES_SQL
    + """reach AS (SELECT doc_id, doc_id AS r FROM sized UNION SELECT reach.doc_id, e.b FROM reach JOIN both_ways e ON e.a = reach.r),
same AS (SELECT doc_id, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS class_id FROM sized JOIN words USING (doc_id))
SELECT doc_id, n AS n_shingles, min(r) AS component_id, any_value(class_id) AS class_id FROM reach JOIN sized USING (doc_id) JOIN same USING (doc_id) GROUP BY doc_id, n"""
)
