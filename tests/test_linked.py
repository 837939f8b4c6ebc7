import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightwell import catalog
from brightwell.functions import text as T
from brightwell.operators import graph, linked
from brightwell.plans import methods

SF = "/root/testdata/sf0.001"


def test_containing_and_sharing_against_brute_force():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(rng.randrange(n)))
    for block in (7, 1 << 20):
        linked.BLOCK = block
        hay, needles = [word(90) for _ in range(60)] + [None, ""], list({word(k) for k in (2, 3, 5, 9, 20) for _ in range(12)})
        row, k = linked.containing(pa.array(hay), [x.encode() for x in needles])
        assert set(zip(row.tolist(), k.tolist())) == {(i, j) for i, h in enumerate(hay) for j, x in enumerate(needles) if h is not None and x in h}
    linked.BLOCK = 1 << 20
    bag = lambda n: rng.sample(["a", "bb", "ccc", "dddd", "eeeee", "ffffff", "ggggggg", "x1", "y2", "z3"], rng.randrange(n))
    text, title = [bag(7) for _ in range(50)] + [None], [bag(4) for _ in range(30)] + [[]]
    row, k = linked.sharing(pa.array(text), pa.array(title))
    want = {(i, j) for i, a in enumerate(text) for j, b in enumerate(title) if len(both := set(a or ()) & set(b)) > 1 or any(len(x) > 5 for x in both)}
    assert set(zip(row.tolist(), k.tolist())) == want


def test_python_mention_equals_the_expression(spark):
    odd = ["", "  A\u00a0b\u2003C ", "Sir  Émile (film)", "queen (x) ", "x (a) (b)\n", "Dr. Ångström № Ⅷ ½ ²", "ΑΣ ΣΑΣ. ß ﬁ", "king", "King Lear-IV, the 2nd_", "日本 語\x1c\x1fé", "\u0301a\u0345 ((x) y)"]
    texts = odd + [r.text for r in catalog.node_view(spark, SF).select("text").limit(400).collect()]
    m = T.mention(F.col("t"))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", m.alias("m")).collect():
        norm, key, tokens = T.python_mention(r.t)
        assert (norm, key, set(tokens)) == (r.m.norm, r.m.key, set(r.m.tokens))


@pytest.mark.parametrize("three", [False, True])
def test_searches_equal_those_over_the_edge_table(spark, three):
    """Titles that no sentence names, and titles of three words, which many name and several passages have."""
    n = (catalog.three_word_titles(spark, SF) if three else catalog.node_view(spark, SF)).cache()
    e = graph.merged(graph.adjacency(n), graph.entity_overlap(n), graph.title_mention(n)).cache()
    seeds = methods.seeds(methods.scored(catalog.questions(spark, SF), n)).select("qid", "node_ord", "rank")
    ranked = n.join(seeds, ["qid", "node_ord"], "left")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(linked.paths(ranked, 3)) == rows(graph.paths_from_seeds(e, seeds, 3))
    assert rows(linked.hops(ranked, 2)) == rows(graph.hops(e, seeds, 2).select("qid", "node_ord", "hop"))
    arcs = graph.both_ways(e).join(seeds.select("qid", F.col("node_ord").alias("src")), ["qid", "src"]).select("qid", "src", "dst")
    assert rows(linked.arcs(ranked)) == rows(arcs)
