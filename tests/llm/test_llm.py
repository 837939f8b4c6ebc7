import hashlib
import random

import numpy as np
import pytest

from brightwell.llm import bpe, fingerprints, jaccard, language, licenses, mixing, quality, secrets, shards, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component bigint"
ROWS = [
    (1, None, None, None, None, 0), (2, "", "en", "s", 0, 0), (3, "x" * 50_000 + " y\n" * 300, "en", "s", 1, 0), (4, "Released under the MIT License.", "en", "s", 1, 0),
    (5, "Released under the MIT License.", "en", "s", 1, 0), (5, "Released under the MIT License.", "en", "s", 1, 0), (None, "été à la plage", "fr", None, 1, 0), (6, "12 34", "de", "t", 1, 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


RUNS = [licenses.scan, fingerprints.compare, lambda d: language.predict(d, language.fit(d)), token_counts.attribute, bpe.digests, mixing.probabilities, jaccard.jaccard_components, secrets.scan, quality.report]


@pytest.mark.parametrize("run", RUNS)
def test_odd_rows_and_empty_tables(odd, run):
    n = len(run(odd).collect())
    assert n >= len(ROWS) or run is secrets.scan
    assert run(odd.limit(0)).collect() == []


def test_bpe_matches_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, own, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.encoder(bpe.default_vocabulary()), random.Random(2)
    texts = ["", "ΑΣ Σ İ ſ", "it's <|endoftext|>x<|endo", "日本 é 🎉", "a" * 3000, "x\x1cy \x85"] + ["".join(rng.choice("abcdeiorstn' thing.-0éß!") for _ in range(30)) for _ in range(500)]
    for x in texts:
        e = t.encode(x, add_special_tokens=False).ids
        ids = own.encode_bytes(x)
        assert np.frombuffer(ids, "<u4").tolist() == e
        assert own.decode_bytes(ids).decode() == t.decode(e, skip_special_tokens=False)


@pytest.mark.parametrize("hot_from", [None, 3])
def test_jaccard_against_brute_force(spark, monkeypatch, hot_from):
    if hot_from:  # every text is sampled and most shared tokens are dealt
        monkeypatch.setattr(jaccard, "SAMPLE", 1)
        monkeypatch.setattr(jaccard, "HOT_LEAST", hot_from)
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    passages, base, docs = [prose(60) for _ in range(3)], prose(100), []
    docs += [prose(rng.randint(0, 14)) + rng.choice(passages) + prose(rng.randint(0, 6)) for _ in range(60)]
    for _ in range(30):
        x = list(base)
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(100)] = rng.choice(["A", "b"])
        docs.append(x)
    docs += [["a", "b"], ["A", "B"], [], ["a"] * 5, ["a"] * 7]
    rows = [(i, " ".join(x)) for i, x in enumerate(docs)] + [(900, None)]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_repeats_against_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        at = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        marked = {k for i, x in enumerate(at) if at.count(x) > 1 for k in range(i, i + 8)}
        assert quality.repeated(w) == len(marked)


def test_feistel_is_a_permutation():
    for n in (1, 2, 7, 1000):
        f = shards.feistel(np.arange(n), n)
        assert sorted(f) == list(range(n)) and (shards.feistel(f, n, inverse=True) == np.arange(n)).all()


def test_forest_on_held_out_findings():
    rows = secrets.labelled_findings(300, seed=77)
    score = secrets.fitted().predict(np.array([secrets.features(b[-48:], v, a[:48]) for b, v, a, _ in rows])) >= 0.5
    assert (score == np.array([r[3] == 1 for r in rows])).mean() > 0.97


def test_language_codes():
    words = {"en": "the of and to in that", "fr": "le des une que est dans", "de": "der und ein nicht sich", "es": "los una por con las"}
    rng, texts, langs = random.Random(4), [], []
    for lang, w in words.items():
        texts += [" ".join(rng.choices(w.split(), k=15)) for _ in range(80)]
        langs += [lang] * 80
    x = np.stack([language.features(t) for t in texts])
    model = language.Codes(x[::2], langs[::2])
    best, _ = model.decode(x[1::2])
    assert [model.names[i] for i in best] == langs[1::2]
    assert language.codewords(9).shape == (9, 40)


def test_attribution_rule():
    own, crossing = token_counts.attributed(np.array([0, 2, 5]), np.array([2, 5, 6]), [0, 3, 4, 6])
    assert own.tolist() == [2, 0, 1] and crossing.tolist() == [1, 1, 1]


def test_winnowing_guarantee(spark):
    rng = random.Random(1)
    run = " ".join(f"s{i}" for i in range(fingerprints.GRAM + fingerprints.WINDOW - 1))
    noise = lambda: " ".join(f"n{rng.randrange(10**9)}" for _ in range(40))
    df = spark.createDataFrame([(1, f"{noise()} {run} {noise()}"), (2, f"{noise()} {run} {noise()}")], "doc_id bigint, text string")
    r = {x.doc_id: x for x in fingerprints.compare(df).collect()}
    assert {v >> 28 for v in r[1].grams} & {v >> 28 for v in r[2].grams} and r[1].near_next > 0
    assert hashlib.sha256(b"").hexdigest() != r[1].edited_sha256


def test_mixing_marginals():
    cells = [("a", "en", "p", 900.0), ("a", "fr", "p", 100.0), ("b", "en", "p", 50.0), ("b", "fr", "p", 200.0)]
    p = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "fr": 0.5}}, 0.2)
    kept = [x * c[3] for x, c in zip(p, cells, strict=True)]
    assert abs(sum(kept) - 250) < 1e-6 and abs(kept[0] + kept[1] - 125) < 1 and abs(kept[0] + kept[2] - 125) < 1


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    vocabulary = """time year people way day man thing woman life child world school state family student group country problem hand part
        place case week company system program question work government number night point home water room mother area money story fact month lot right study book
        eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute
        idea body information back parent face others level office door health person art war history party result change morning reason research girl guy moment
        air teacher force education foot boy age policy music market sense nation plan college interest death experience effect use class control""".split()
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(150))
    rows = [(i, text(), "en", f"s{i % 2}", 1) for i in range(30)]
    rows += [(40, rows[3][1], "en", "s0", 1), (41, "short", "en", "s0", 1), (42, text() + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", "s1", 1)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(path))
    docs, seen = spark.read.parquet(str(path)), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = list(seen.values())
    assert 41 not in kept[0] and 40 not in kept[1] and 3 in kept[1] and "04dbeb" not in kept[2][42]
    assert set(kept[3]) <= set(kept[2])
