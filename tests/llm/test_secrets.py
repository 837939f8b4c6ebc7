import hashlib
import random
import re
import string

import numpy as np
import pytest

from brightwell.llm import secrets

SF = "/root/testdata/sf0.01"
ALNUM = string.ascii_letters + string.digits
SCHEMA = "doc_id bigint, text string"
#: Forms of the secrets planted in ``documents``; text in capitals has them in capitals.
PLANTED = re.compile(r'AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}|(?<=PASSWORD=)[0-9A-F]{18}|(?<=TOKEN = ")[0-9A-F]{40}')


def test_scan_against_brute_force(spark):
    rng = random.Random(9)
    pick = lambda n: "".join(rng.choice(ALNUM) for _ in range(n))
    texts = [None, "", "no secret here", f'api_key = "{pick(40)}"', f"x {pick(30)} y {pick(30)}", "a" * 200_000 + f" token: {pick(36)} end", f"é AKIA{'Q' * 16} ü", f"{pick(20)}\n{pick(20)}"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA + ", start int, secret boolean")
    forest = secrets.fitted()
    want = []
    for i, t in rows:
        for s, e, kind in secrets.candidates(t or ""):
            score = forest.predict(np.array([secrets.features(t[max(0, s - 48) : s], t[s:e], t[e : e + 48])]))[0]
            want.append((i, s, e - s, kind, round(float(score), 9), bool(score >= 0.5), hashlib.sha256(t[s:e].encode()).hexdigest()))
    got = [(r.doc_id, r.start, r.length, r.kind, round(r.score, 9), r.secret, r.value_sha256) for r in secrets.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[5] for w in want) >= 8
    assert secrets.scan(docs.limit(0)).collect() == [] and secrets.redact(docs.limit(0)).collect() == []


def test_planted_secrets_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = {}
    for r in secrets.scan(docs).filter("secret").collect():
        found.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    planted = caught = wrong = 0
    for r in docs.collect():
        places = [m.span() for m in PLANTED.finditer(r.text or "")]
        planted += len(places)
        caught += sum(any(s <= a and b <= e for s, e in found.get(r.doc_id, [])) for a, b in places)
        wrong += sum(not any(a < e and s < b for a, b in places) for s, e in found.get(r.doc_id, []))
    assert planted >= 3 and caught == planted and wrong == 0


def test_redaction_changes_nothing_outside_the_found_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spans = {}
    for r in secrets.scan(docs).filter("secret").collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    before = {r.doc_id: r for r in docs.collect()}
    for r in secrets.redact(docs).collect():
        old, gone = before[r.doc_id], spans.get(r.doc_id, set())
        assert (r.lang, r.source, r.n_chars) == (old.lang, old.source, old.n_chars)
        keep = "".join(c for i, c in enumerate(old.text or "") if i not in gone)
        assert (r.text or "").replace("[secret]", "") == keep


def test_values_without_a_digit():
    rng = random.Random(3)
    value = "".join(rng.choice(string.ascii_letters) for _ in range(36))
    text = f"and {value} there, Donaudampfschifffahrtsgesellschaft or antidisestablishmentarianism or https/some/path/to/file"
    assert [(text[s:e], x >= 0.5) for s, e, _, x in secrets.judged([text], secrets.fitted())[0] if text[s:e] == value or x >= 0.5] == [(value, True)]


def test_findings_of_a_table(spark, monkeypatch):
    rows = secrets.labelled_findings(200, seed=5)
    table = spark.createDataFrame([*rows, *rows[:9], ("a", None, "b", 1), (None, "v" * 20, None, 0), ("a", "b", "c", None)], "before string, value string, after string, label int")
    found = secrets.findings_from(table)
    assert sorted(found) == sorted({*rows, ("", "v" * 20, "", 0)})
    measured = secrets.held_out(found)
    assert measured["precision"] > 0.95 and measured["recall"] > 0.95
    monkeypatch.setattr(secrets, "MAX_FINDINGS", 50)
    assert len(secrets.findings_from(table)) == 50


@pytest.mark.parametrize("link", [" = ", ": ", "="])
def test_text_after_a_value_stays(spark, link):
    text = f"api_key{link}ghp_{ALNUM[:36]} end of text that matters a lot to readers everywhere"
    out = secrets.redact(spark.createDataFrame([(1, text)], SCHEMA)).first().text
    assert out == f"api_key{link}[secret] end of text that matters a lot to readers everywhere"
