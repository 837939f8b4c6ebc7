import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightwell import catalog
from brightwell.operators import graph, linked

SF = "/root/testdata/sf0.001"
ALL = linked.NEXT | linked.PREVIOUS | linked.SHARED | linked.NAMES | linked.NAMED


def views(spark):
    """Titles that no sentence names, and titles of three words, which many name and several passages have."""
    return [v(spark, SF) for v in (catalog.node_view, catalog.three_word_titles)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def shuffles(df):
    """Exchanges of rows by a key; AdaptiveSparkPlan shows its first plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


def question(seed=0, n=60):
    rng = random.Random(seed)
    words = ["Alpha", "Beta", "Gamma", "Delta One", "Epsilon", "x", "y"]
    made = []
    for i in range(n):
        some = rng.sample(words, rng.randrange(4))
        made.append({"node_ord": i, "passage_ord": i // 4, "sent_id": i % 4, "title": rng.choice([f"Thing {i // 4} of", "Epsilon", None]) if i % 4 == 0 else made[-1]["title"], "text": " ".join(some), "entities": sorted({w.lower() for w in some if w[0].isupper()}), "rank": {3: 1, 20: 2, 41: 3, 42: 4}.get(i), "restart": {3: 0.5, 20: 0.25, 41: 0.25}.get(i)})
    schema = pa.schema([("node_ord", pa.int32()), ("passage_ord", pa.int64()), ("sent_id", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("entities", pa.list_(pa.string())), ("rank", pa.int64()), ("restart", pa.float64())])
    return linked.Question(pa.Table.from_pylist(made, schema))


@pytest.mark.parametrize(("cells", "chunk"), [(1 << 22, 1 << 20), (130, 7)])
def test_the_table_has_the_links_of_each_row(monkeypatch, cells, chunk):
    monkeypatch.setattr(linked, "CELLS", cells), monkeypatch.setattr(linked, "CHUNK", chunk)
    q = question()
    want = {(a, int(b)) for a in range(q.n) for b in q.links(a)}
    got = [(a, b, h) for t in q.table(ALL) for a, b, h in zip(*(x.tolist() for x in t))]
    assert [g[:2] for g in got] == sorted(want) and len(want) > 300
    for a, b, h in got:
        shared = q.title[a] >= 0 and q.title[b] >= 0 and q.title[a] != q.title[b] and set(q.of[a]) & set(q.of[b])
        assert h == (q.next[a] == b) * 1 + (q.prev[a] == b) * 2 + bool(shared) * 4 + (q.title[b] in q.names[a]) * 8 + (q.title[a] >= 0 and b in q.named[q.title[a]]) * 16
    assert [(a, b, h) for t in q.table(ALL, after=True) for a, b, h in zip(*(x.tolist() for x in t))] == [g for g in got if g[0] < g[1]]
    some = np.array([3, 4, 50])
    assert [(a, b, h) for t in q.table(ALL, some) for a, b, h in zip(*(x.tolist() for x in t))] == [g for g in got if g[0] in some]


def test_merged_edges_without_joins(spark):
    for n in views(spark):
        want = graph.merged(graph.adjacency(n), graph.entity_overlap(n), graph.title_mention(n)).select("qid", "src", "dst", "kinds", "weight")
        got = rows(linked.merged_edges(n))
        assert got == rows(want) and got
    assert shuffles(catalog.merged_edges(spark, SF)) == (1, 0)


def test_sentences_of_no_question_are_linked_in_their_passages(spark):
    n = catalog.node_view(spark, SF).filter("qid < 3").withColumn("qid", F.when(F.col("qid") > 0, F.col("qid")))
    want = graph.merged(graph.adjacency(n), graph.entity_overlap(n), graph.title_mention(n)).select("qid", "src", "dst", "kinds", "weight")
    key = lambda r: str(r)
    assert sorted(map(tuple, linked.merged_edges(n).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_typed_edges_without_joins(spark):
    for n in views(spark):
        got = rows(linked.typed_edges(n))
        assert got == rows(graph.typed(n).withColumn("kinds", F.array_join("kinds", ","))) and got
    assert shuffles(catalog.typed_edges(spark, SF)) == (1, 0)


def test_overlap_edges_without_joins(spark):
    for n in views(spark):
        got = rows(linked.overlap_edges(n))
        assert got == rows(graph.entity_overlap(n).select("qid", "src", "dst")) and got
    assert shuffles(catalog.entity_overlap_edges(spark, SF)) == (1, 0)


def test_mention_edges_without_joins(spark):
    for n in views(spark):
        assert rows(linked.mention_edges(n)) == rows(graph.title_mention(n).select("qid", "src", "dst"))
    assert shuffles(catalog.title_mention_edges(spark, SF)) == (1, 0)


def test_titles_by_shared_tokens_in_small_pieces(monkeypatch):
    rng = random.Random(2)
    bag = lambda n: rng.sample(["a", "bb", "ccc", "dddd", "eeeee", "ffffff", "ggggggg", "x1", "y2", "z3"], rng.randrange(n))
    text, title = [bag(7) for _ in range(50)] + [None], [bag(4) for _ in range(30)] + [[]]
    whole = linked.sharing(pa.array(text), pa.array(title))
    monkeypatch.setattr(linked, "CHUNK", 40)
    assert [x.tolist() for x in linked.sharing(pa.array(text), pa.array(title))] == [x.tolist() for x in whole]
