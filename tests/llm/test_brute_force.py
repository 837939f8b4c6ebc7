"""Counting operators against plain loops, on odd rows: nulls, empty and very long texts, repeats, clashing names."""

import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwell.llm import bpe, language, quality, token_counts

ROWS = [(1, None, None), (2, "", "en"), (3, "x" * 30_000 + " y\n" * 300, "en"), (4, "a b\nc\n\nc\n", "de"), (4, "a b\nc\n\nc\n", "de"), (None, "été à la plage 日本\r\n🎉", "fr"), (5, "\n\n  \n", "xx"), (6, "no line end", None)]
SCHEMA = "doc_id bigint, text string, lang string, section int, n_words string, held string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "n", "h") for r in ROWS], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts(spark, odd):
    encoding = token_counts.spans(token_counts.vocabulary()).encoding
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for docs in (odd, sf):
        want = []
        for i, t in [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]:
            lines = t.splitlines(keepends=True) if not re.search("[\r\x0b\x0c\x1c-\x1e\x85  ]", t) else re.findall(r"[^\n]*\n|[^\n]+", t)
            bounds = [0]
            for x in lines or [""]:
                bounds.append(bounds[-1] + len(x))
            own, crossing = [0] * (len(bounds) - 1), [0] * (len(bounds) - 1)
            raw, at = t.encode(), 0
            char = [k for k, c in enumerate(t) for _ in c.encode()]
            for token in encoding.encode_ordinary(t):
                size = len(encoding.decode_single_token_bytes(token))
                s, e = char[at], char[at + size - 1] + 1
                at += size
                inside = [max(0, min(e, b) - max(s, a)) for a, b in zip(bounds, bounds[1:], strict=False)] if len(bounds) < 400 else None
                if inside is None:  # many lines: only those around the token
                    k = int(np.searchsorted(bounds, s, "right")) - 1
                    m = int(np.searchsorted(bounds, e - 1, "right")) - 1
                    inside = {j: min(e, bounds[j + 1]) - max(s, bounds[j]) for j in range(k, m + 1)}
                else:
                    inside = {j: v for j, v in enumerate(inside) if v}
                own[max(inside, key=lambda j: (inside[j], -j))] += 1
                if len(inside) > 1:
                    for j in inside:
                        crossing[j] += 1
            assert at == len(raw)
            want += [(i, j, bounds[j], bounds[j + 1], own[j], crossing[j]) for j in range(len(own))]
        assert rows_of(token_counts.attribute(docs)) == sorted(want, key=str)
    assert token_counts.attribute(odd.limit(0)).collect() == []


def test_token_counts_of_fields(spark):
    docs = spark.createDataFrame([(1, "ab", "cd ef"), (2, None, "x"), (3, "", None)], "doc_id bigint, title string, body string")
    got = rows_of(token_counts.attribute(docs, fields=["title", "body"]))
    encoding = token_counts.spans(token_counts.vocabulary()).encoding
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, 0, 0, 2), (1, 1, 2, 7), (2, 0, 0, 0), (2, 1, 0, 1), (3, 0, 0, 0), (3, 1, 0, 0)]
    assert sum(r[4] for r in got if r[0] == 1) == len(encoding.encode_ordinary("abcd ef"))


def quality_of(i, text, lang, model):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    at = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    marked = {j for k, x in enumerate(at) if at.count(x) > 1 for j in range(k, k + 8)} if len(at) < 3000 else None
    ids = model.encode(" ".join(words)) if words else []
    n = len(ids)
    p = [ids.count(x) / n for x in set(ids)]
    entropy = -sum(x * math.log2(x) for x in p)
    return (
        i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if marked is None else len(marked),
        n, n and sum(map(len, words)) / n, n and n / len(words), n and sum(model.is_byte(x) for x in ids) / n, entropy,
    )


def test_quality(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=quality.vocabulary())
    rng = random.Random(1)
    more = [(100 + i, " ".join(rng.choice(["ab", "c#", "<d>", "été", "日本"]) for _ in range(rng.randint(1, 120))) + "\nx\nx", "en") for i in range(25)]
    docs = odd.unionByName(spark.createDataFrame([(*r, 7, "n", "h") for r in more], SCHEMA))
    got = {}
    for r in quality.report(docs).collect():
        got.setdefault((r.doc_id, r.n_words, r.word_chars), []).append(r)
    for row in [*ROWS, *more]:
        want = quality_of(*row, model)
        for r in got[want[:3]]:
            assert (r.n_symbols, r.n_dup_lines) == want[3:5] and (want[5] is None or r.n_repeat_words == want[5])
            assert r.n_tokens == want[6] and [r.chars_per_token, r.tokens_per_word, r.fallback_share, r.token_entropy] == pytest.approx(list(want[7:]))
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert sum(map(len, got.values())) == len(ROWS) + len(more)
    kept = {r.doc_id for v in got.values() for r in v if r.kept}
    out = quality.keep(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept and quality.keep(docs.limit(0)).collect() == []


def test_bands_by_script():
    assert [quality.script(x) for x in ("été and", "привет мир", "αβγ", "日本語 ab", "12 34", "مرحبا")] == ["latin", "cyrillic", "greek", "east asian", None, "arabic"]
    rules = quality.Rules()
    measured = (200, 0.9, 20.0, 0.5, 6.0)
    assert quality.in_band(measured, "ja", "日本語", rules) and not quality.in_band(measured, "en", "日本語", rules) and not quality.in_band(measured, "ja", "romaji", rules)
    assert quality.in_band((99, 99.0, 99.0, 1.0, 0.0), "en", "x", rules)


def test_language_features_and_decoding():
    text = "Ab cB"
    padded = f" {text.lower()} "
    want = np.zeros(language.BUCKETS)
    for n in range(1, 4):
        for i in range(len(padded) - n + 1):
            code = 0
            for k in range(n):
                code = (code + ord(padded[i + k])) * int(language._MIX[k]) % 2**64
            want[code >> 52] += 1
    want = np.sqrt(want)
    assert np.allclose(language.features(text), want / np.linalg.norm(want), atol=1e-6)
    rng = np.random.default_rng(0)
    x = np.abs(rng.random((40, language.BUCKETS))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.Codes(x, ["abcde"[i % 5] for i in range(40)], steps=20)
    best, share = model.decode(x)
    for row, b, s in zip(x, best, share, strict=True):
        f = row @ model.w + model.b
        loss = [sum(w * math.log1p(math.exp(-m * c)) for w, m, c in zip(model.weight, f, code, strict=True)) for code in model.code]
        assert b == int(np.argmin(loss)) and s == pytest.approx(1 / sum(math.exp(min(loss) - v) for v in loss), rel=1e-4)


def test_language_sample_is_bounded_and_whole(spark, monkeypatch):
    texts = {"en": "the of and to in", "fr": "le des une que est", "de": "der und ein nicht"}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    one = next(i for i in range(99) if not held(i))
    rows = [(one, f"{texts['en']} {i}", "en") for i in range(3000)] + [(one, texts["fr"], "fr")] * 2000 + [(i, f"{texts['de']} {i}", "de") for i in range(50)]
    rows += [(one, None, "es"), (one, "12 34", "it"), (one, "words without a language", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(language, "MAX_TRAIN", 90)
    hashes = docs.select("lang", "text", F.xxhash64("text").alias("h")).distinct()
    found = [(r.lang, r.text) for r in language.sample(docs).join(hashes, ["lang", "h"]).collect()]
    n = {k: sum(lang == k for lang, _ in found) for k in "en fr de es it".split()}
    assert n == {"en": 30, "fr": 1, "de": 30, "es": 0, "it": 0} and len(set(found)) == len(found)
    assert all(not held(int(t.split()[-1])) for lang, t in found if lang == "de")
    assert language.fit(docs.limit(0)) is None and language.fit(docs).names == ["de", "en", "fr"]


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    truth = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in truth)
    test = [(i, lang) for i, lang, t in truth if got[i].held_out and lang and language.has_letter(t)]
    assert len(test) > 200 and sum(got[i].lang_pred == lang for i, lang in test) >= 0.99 * len(test)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i, _, t in truth if not language.has_letter(t))


def test_vocabularies_of_another_kind_are_refused(tmp_path):
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check(spec)
    for change in (lambda s: s["model"].update(end_of_word_suffix=None), lambda s: s["normalizer"]["normalizers"].pop(), lambda s: s["model"]["merges"].reverse(), lambda s: s.update(decoder={"type": "BPEDecoder"})):
        other = json.loads(json.dumps(spec))
        change(other)
        with pytest.raises(ValueError):
            bpe.check(other)
