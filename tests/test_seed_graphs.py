import pytest
from pyspark.sql import functions as F

from brightwell import catalog
from brightwell.operators import graph, linked
from brightwell.plans import methods

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


def without_edges(df):
    """Whether each question is searched by itself, with no table of edges to join."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FlatMapGroupsInArrow") == 1 and "SortMergeJoin" not in plan


def seeded(spark, three):
    """Titles that no sentence names, or titles of three words, which many name and several passages have."""
    n = (catalog.three_word_titles(spark, SF) if three else catalog.node_view(spark, SF)).cache()
    s = methods.scored(catalog.questions(spark, SF), n)
    return n, methods.ranked(s), methods.seeds(s)


@pytest.mark.parametrize("three", [False, True])
def test_grounded_paths_equal_those_over_the_edge_table(spark, three):
    n, ranked, seeds = seeded(spark, three)
    ends, e = seeds.select("qid", F.col("node_ord").alias("src")), graph.typed(n)
    paths = graph.directed_paths(e, ends.join(ends.withColumnRenamed("src", "dst"), "qid"), 2, 3)
    got = rows(linked.grounded_paths(ranked, 3))
    assert got == rows(graph.grounded_values(paths, e, n)) and any(len(r[1]) > 1 and r[2] for r in got)
    assert without_edges(catalog.path_grounding(spark, SF))


@pytest.mark.parametrize("three", [False, True])
def test_pool_neighbours_equal_those_over_the_edge_table(spark, three):
    n, ranked, seeds = seeded(spark, three)
    e = graph.merged(graph.adjacency(n), graph.entity_overlap(n), graph.title_mention(n)).cache()
    want = graph.neighbours(e, graph.hops(e, seeds, 1)).select("qid", "node_ord", F.size("neighbours").cast("bigint"), F.md5(F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",")))
    got = rows(linked.pool_neighbours(ranked, 1))
    assert got == rows(want) and max(r[2] for r in got) > 5
    assert without_edges(catalog.pool_neighbours(spark, SF))


@pytest.mark.parametrize("three", [False, True])
def test_pagerank_equals_that_over_the_edge_table(spark, three):
    n, _, _ = seeded(spark, three)
    q = catalog.questions(spark, SF).filter("qid > 2")
    view = (catalog.three_word_titles if three else catalog.node_view)(spark, SF)
    seeds = graph.restart_weights(methods.seeds(methods.scored(q, view))).toDF(*methods.seeds(methods.scored(q, view)).columns, "restart")
    want = rows(graph.pagerank(graph.merged(graph.adjacency(n), graph.entity_overlap(n), graph.title_mention(n)), seeds))
    got = rows(linked.pagerank(methods.restarts(q, n)))
    assert [r[:2] for r in got] == [r[:2] for r in want] and {r[0] for r in got} >= {0, 1, 2, 3}
    assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want))
    assert without_edges(catalog.ppr_scores(spark, SF))


def test_pagerank_without_links_in_memory(monkeypatch):
    import test_edge_tables

    q = test_edge_tables.question()
    at, score = q.pagerank(0.85)
    monkeypatch.setattr(linked, "HELD", 10), monkeypatch.setattr(linked, "CELLS", 130)
    again, other = q.pagerank(0.85)
    assert at.tolist() == again.tolist() and abs(score - other).max() < 1e-12


@pytest.mark.parametrize("three", [False, True])
def test_typed_paths_equal_those_over_the_edge_table(spark, three):
    n, ranked, seeds = seeded(spark, three)
    ends = seeds.select("qid", F.col("node_ord").alias("src"))
    want = graph.directed_paths(graph.typed(n), ends.join(ends.withColumnRenamed("src", "dst"), "qid"), 2, 3).select("qid", "src", "dst", "path", "hops", "path_rank")
    got = rows(linked.typed_paths(ranked, 3))
    assert got == rows(want) and {r[4] for r in got} == {0, 1, 2}
    assert without_edges(catalog.typed_paths_k(spark, SF))


@pytest.mark.parametrize("three", [False, True])
def test_simple_paths_equal_those_over_the_edge_table(spark, three):
    n, ranked, seeds = seeded(spark, three)
    ends = seeds.select("qid", F.col("node_ord").alias("src"))
    pairs = ends.join(ends.withColumnRenamed("src", "dst"), "qid").filter("src < dst")
    e = graph.merged(graph.adjacency(n), graph.entity_overlap(n), graph.title_mention(n))
    want = graph.simple_paths(e, pairs, 3, 3).select("qid", "src", "dst", "path", "hops", "path_rank")
    got = rows(linked.simple_paths(ranked, 3))
    assert got == rows(want) and len({r[4] for r in got}) > 1
    assert without_edges(catalog.document_paths_k(spark, SF))
