import hashlib
import random

import pytest
import xxhash

from brightwell.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string"
LAST = (1 << 28) - 1


def brute(text):
    """Winnowing with hashes that roll from gram to gram; (hash, position) of the chosen ones."""
    w = [xxhash.xxh64(x.encode(), 42).intdigest() for x in text.lower().split()]
    w = [(x - 2**64 if x >= 2**63 else x) % fp.PRIME for x in w]
    if not w:
        return []
    first = 0
    for x in w[: fp.GRAM]:
        first = (first * fp.BASE + x) % fp.PRIME
    h = [first]
    for i in range(fp.GRAM, len(w)):
        h.append(((h[-1] - w[i - fp.GRAM] * fp.BASE ** (fp.GRAM - 1)) * fp.BASE + w[i]) % fp.PRIME)
    out = []
    for i in range(max(1, len(h) - fp.WINDOW + 1)):
        at = min(range(i, min(len(h), i + fp.WINDOW)), key=lambda k: (h[k], -k))
        if (h[at], at) not in out:
            out.append((h[at], at))
    return out


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = [(i, t or "") for i, t in sorted(rows)]
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b = brute(t), brute(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, brute(after))))
    return out


def decoded(grams):
    return [(v >> 28, LAST - (v & LAST)) for v in grams]


@pytest.mark.parametrize("rows_of_a_range", [1000, 2])
def test_against_brute_force(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows_of_a_range)
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "Word", "été", "x" * 9]) for _ in range(n))
    rows = [(10 * i, text(rng.choice([0, 1, 4, 5, 6, 8, 9, 30, 200]))) for i in range(60)]
    rows += [(5, None), (7, ""), (9, rows[3][1]), (11, "tab\tline\n end  "), (-4, "🎉 日本 " * 20), (2**60, text(20_000))]
    found = {r.doc_id: r for r in fp.compare(spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA + ", part int, own string")).collect()}
    assert len(found) == len(rows)
    for i, n, sha, a, b, near_edited, near_next in expected(rows):
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert decoded(r.grams) == a and decoded(r.edited_grams) == b
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)


def test_rows_with_one_id_and_without_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "g"), (None, "h"), (None, None)]
    out = fp.compare(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5 and {r.near_next for r in out if r.doc_id == 1} == {1.0, 0.0}
    assert fp.compare(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fp.compare(spark.createDataFrame([(3, "only one row of eight words is here now")], SCHEMA)).first()
    assert one.near_next == 1.0 and one.n_chars == 39


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(i, "the same text of some words " * 3 if i % 2 else f"other {i}") for i in range(20)], SCHEMA)
    out = fp.compare(df).select("doc_id", fp.digest("grams").alias("d")).collect()
    assert len({r.d for r in out if r.doc_id % 2}) == 1 and len({r.d for r in out}) == 11
