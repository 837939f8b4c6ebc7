import random

from brightwell.llm import common, jaccard

SCHEMA = "doc_id bigint, text string, kept_row int, salt string"


def test_one_row_of_each_component(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(500)}" for _ in range(200)]
    near = list(long)
    near[7] = "x"
    rows = [(1, " ".join(long)), (1, " ".join(long)), (2, " ".join(long).upper()), (3, " ".join(near)), (4, "a b"), (5, "A  b"), (6, None), (6, None), (7, ""), (8, "c"), (8, "d"), (None, "n"), (None, "n"), (None, "m"), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
    out = jaccard.one_of_each(docs)
    got = out.collect()
    assert out.columns == docs.columns and all((r.kept_row, r.salt) == (1, "s") for r in got)
    by = sorted(((r.doc_id, r.text) for r in got if r.doc_id is not None and r.doc_id != 8), key=str)
    assert by == sorted([(1, " ".join(long)), (4, "a b"), (6, None), (7, "")], key=str)
    assert sum(r.doc_id == 8 for r in got) == 1
    assert {r.text for r in got if r.doc_id is None} == {None, "m", "n"}
    assert sum(r.doc_id is None for r in got) == 3
    assert jaccard.one_of_each(docs.limit(0)).collect() == []


def test_hot_leaders_are_dealt_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEADER_PAIRS", 5)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        x = list(base)
        x[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        assert {r.component_id for r in jaccard.jaccard_components(docs).collect()} == {0}


def test_salts_cover_all_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEADER_PAIRS", 3)
    pairs = spark.createDataFrame([(a, 0) for a in range(20)] + [(a, a) for a in range(5)], "a bigint, b bigint")
    hot = jaccard.hot_keys(pairs, "b")
    assert {tuple(r) for r in hot.collect()} == {(0, 8)}
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        left = jaccard.salted(pairs, hot, "b", "a")
        right = jaccard.copied(spark.createDataFrame([(i,) for i in range(5)], "b bigint"), hot, "b")
        assert sorted(map(tuple, left.join(right, ["b", "salt"]).select("a", "b").collect())) == sorted(map(tuple, pairs.collect()))
        assert left.filter("b = 0").select("salt").distinct().count() > 3
