from pyspark.sql import functions as F

from brightwell.llm import mixing

CELLS = [("a", "en", "p", 900), ("a", "fr", "p", 100), ("b", "en", "p", 50), ("b", "fr", "p", 200), ("c", "en", "p", 300), ("c", "fr", "p", 80)]
TARGETS = {"source": {"a": 0.5, "b": 0.5, "c": 0.0}, "lang": {"en": 0.5, "fr": 0.5}}


def test_table_equals_driver_with_a_zero_target(spark):
    cells = spark.createDataFrame(CELLS, "mix_source string, mix_lang string, mix_topic string, tokens bigint")
    kept = mixing.ROUNDS
    mixing.ROUNDS = 4
    try:
        got = {tuple(r)[:3]: r.mix_p for r in mixing.rake_table(cells, TARGETS, 0.2).collect()}
        want = mixing.rake([(*c[:3], float(c[3])) for c in CELLS], TARGETS, 0.2)
    finally:
        mixing.ROUNDS = kept
    assert all(abs(got[c[:3]] - w) < 1e-6 for c, w in zip(CELLS, want, strict=True)) and got["c", "en", "p"] == 0


def test_marginals_tell_the_miss(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "s", "en" if i < 90 else "fr", "p") for i in range(100)], "doc_id bigint, text string, source string, lang string, topic string")
    goal = {"lang": {"en": 0.5, "fr": 0.5}}
    for keep, fr in ((0.2, 0.5), (0.7, 1 / 7)):  # at 0.7 all of fr is kept, which is a seventh of the budget
        got = {(r.side, r.value): (r.target, r.reached) for r in mixing.marginals(mixing.probabilities(docs, goal, keep, F.col("topic")), goal).collect()}
        assert got["lang", "fr"][0] == 0.5 and abs(got["lang", "fr"][1] - fr) < 1e-6 and got["source", "s"] == (1.0, 1.0)


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "s", "en", 0.5, "x", "y", 1, "z") for i in range(50)], "doc_id bigint, text string, source string, lang string, prob double, topic string, mix_source string, tokens int, row string")
    kept = mixing.mixed(docs, keep=0.5)
    assert kept.columns == docs.columns and 0 < kept.count() < 50
    assert {(r.prob, r.mix_source, r.row) for r in kept.collect()} == {(0.5, "y", "z")}
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_draw_against_brute_force(spark):
    import hashlib

    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2], ["en", "fr", None][i % 3]) for i in range(60)] + [(3, "w w", "a", "en"), (None, "w", "b", "fr"), (90, None, "a", "en"), (91, "", "a", None)]
    cells = {}
    for _, t, s, lang in rows:
        if t and t.split():
            k = (s, lang or "", "prose")
            cells[k] = cells.get(k, 0) + len(t.split())
    keys = sorted(cells)
    probs = dict(zip(keys, mixing.rake([(*k, float(cells[k])) for k in keys], {}, 0.5), strict=True))
    want = []
    for i, t, s, lang in rows:
        p = probs[s, lang or "", "prose"] if t and t.split() else 1.0
        if int(hashlib.md5(f"{'' if i is None else i}:mix".encode()).hexdigest()[:8], 16) / 2**32 < p:
            want.append((i, t, s, lang))
    got = [tuple(r) for r in mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string"), keep=0.5).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
