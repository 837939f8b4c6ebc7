"""Secret scans (operator 8): candidates by form, false positives removed by a random forest.

Candidates are long mixed strings, known key prefixes, private-key blocks and values assigned to
key-like names.  A forest over length, character transitions, dictionary coverage, path form and
neighbouring words decides which of them are secrets.  It is trained on labelled findings: a table
of (before, value, after, label), read by ``findings_from``, by default ``labelled_findings``, a
seeded set of the forms that scanners report.  ``held_out`` splits findings and measures precision
and recall on those not trained with.  Rows are independent; one Arrow batch is in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 16
#: Labelled findings used at most for training (a bounded fit).
MAX_FINDINGS = 4000
CONTEXT = 48
LONG = re.compile(r"[A-Za-z0-9+/_\-.=]{16,}")
LETTER = re.compile(r"[A-Za-z]")
NAMED = re.compile(r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\w{0,16}[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?([^\s\"']{8,})")
BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\s+[A-Za-z][A-Za-z-]*:(?:(?!-----)[^\r\n])*)*[A-Za-z0-9+/=\s\\]+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?")
NAMES = ("passw", "pwd", "secret", "token", "key", "auth")
KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_][A-Za-z0-9\-_]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|eyJ[A-Za-z0-9_\-]{10,}\.)")
#: Keys with a known prefix, wherever they stand; ``PREFIXES`` are what a text must hold to be searched.
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_][A-Za-z0-9\-_]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-.]*[A-Za-z0-9_\-])")
PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "sk_", "xox", "AIza", "eyJ")
ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*={1,2}(?=[^=])")
GOOD_WORDS = re.compile(r"(?i)passw|pwd|secret|token|api.?key|access.?key|auth|credential|bearer|private")
BAD_WORDS = re.compile(r"(?i)commit|sha\d*|md5|checksum|digest|uuid|guid|hash|etag|revision|version|example|sample|dummy|placeholder|your|path|file|url|http|build|serial|isbn")
#: Everyday words whose presence inside a value speaks against a random one.
DICTIONARY = re.compile(r"(?i)the|and|for|with|that|this|from|have|not|are|you|all|can|her|was|one|our|out|day|get|has|him|his|how|man|new|now|old|see|two|way|who|boy|did|its|let|put|say|she|too|use|example|test|sample|name|value|data|user|file|path|index|main|config|default|service|public|static|string|number|document|version|change|hello|world|key|here|your|insert|replace|dummy|none|null|true|false|ing|tion|ment|ent|er|ed|ly|es|st|re|on|an|en|un|de|le|la")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of each candidate, by start; keys and long runs may lie inside a named value."""
    found: dict[int, tuple[int, str]] = {}
    low = text.lower()
    if "-----begin" in low:
        for m in BLOCK.finditer(text):
            found[m.start()] = (m.end(), "block")
    blocks = [(s, e) for s, (e, _) in found.items()]
    if any(n in low for n in NAMES):
        for m in NAMED.finditer(text):
            found.setdefault(m.start(1), (m.end(1), "named"))
    known = []
    if any(p in text for p in PREFIXES):
        known = [m.span() for m in PREFIXED.finditer(text) if not any(a <= m.start() < b for a, b in blocks)]
        for s, e in known:
            found.setdefault(s, (e, "known"))
    at = 0
    for chunk in text.split():
        at = text.index(chunk, at)
        if len(chunk) >= MIN_CHARS:
            for m in LONG.finditer(chunk):
                for s, e in runs(text, at + m.start(), at + m.end(), known):
                    if LETTER.search(text, s, e) and not any(a <= s < b for a, b in blocks):
                        found.setdefault(s, (e, "long"))
        at += len(chunk)
    return [(s, e, k) for s, (e, k) in sorted(found.items())]


def runs(text: str, start: int, end: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of at least ``MIN_CHARS`` of a long run: between known keys, and apart from the names assigned to."""
    out = []
    for a, b in [*(k for k in known if start <= k[0] < end), (end, end)]:
        while (m := ASSIGNED.match(text, start, a)) and a - m.end() >= MIN_CHARS:
            out.append((start, m.end()))
            start = m.end()
        out.append((start, a))
        start = max(start, b)
    return [(s, e) for s, e in out if e - s >= MIN_CHARS]


def features(before: str, value: str, after: str) -> list[float]:
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    counts = {c: value.count(c) for c in set(value)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    covered = sum(len(m.group()) for m in DICTIONARY.finditer(value)) / n
    hexa = all(c in "0123456789abcdefABCDEF" for c in value)
    around = f"{before} {after}"
    return [
        float(n),
        entropy,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(c == d for c, d in zip(value, value[1:], strict=False)) / n,
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("s") / n,
        covered,
        float(hexa),
        float(len(counts)) / n,
        float(value.count("/") + value.count("\\") + 2 * ("://" in around[-60:]) + bool(re.search(r"\.\w{2,4}$", value))),
        float(bool(GOOD_WORDS.search(before[-24:]))),
        float(bool(BAD_WORDS.search(before[-24:])) or bool(BAD_WORDS.search(value))),
        float(bool(BAD_WORDS.search(around))),
        float(before.rstrip(" \"'").endswith(("=", ":"))),
        float(bool(KNOWN.match(value)) or "PRIVATE KEY" in value),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", value))),
    ]


def labelled_findings(n: int = 1600, seed: int = 8) -> list[tuple[str, str, str, int]]:
    """Findings as scanners report them, with their verdicts."""
    rng = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "the an er ing tion ver be con re de la mi so ta lu ko en st al or".split()
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa = lambda k: pick("0123456789abcdef", k) if rng.random() < 0.8 else pick("0123456789ABCDEF", k)
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    stray = lambda: rng.choice(["mail.example.com", "the file", "version 2", "http://a.example.org", "build 7", "my token", "a secret", "the key"])
    words = lambda: " ".join(word() for _ in range(5)) + (f" {stray()}" if rng.random() < 0.2 else "")
    quote = lambda: rng.choice(['"', "'", ""])
    out = []
    for _ in range(n):
        q = quote()
        name = rng.choice(["token", "TOKEN", "api_key", "secret", "password", "auth_token", "access_key", "client_secret"])
        link = rng.choice([" = ", "=", ": ", ":", " := "])
        value = rng.choice([lambda: hexa(rng.choice([32, 40, 40, 64])), lambda: pick(alnum, rng.randint(20, 44)), lambda: pick(alnum + "+/", 40), lambda: pick(alnum + "!%&*", rng.randint(10, 18))])()
        out.append((f"{words()} {name}{link}{q}", value, f"{q} {words()}", 1))
        value = rng.choice([lambda: "AKIA" + pick(alnum[:26] + "0123456789", 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 40), lambda: "xoxb-" + pick(alnum, 30)])()
        out.append((f"{words()} ", value, f" {words()}", 1))
        if rng.random() < 0.3:  # without a digit
            out.append((f"{words()} {name}{link}{q}" if rng.random() < 0.5 else f"{words()} ", pick(alnum[:52], rng.randint(20, 44)), f"{q} {words()}", 1))
            long = "".join(word() for _ in range(rng.randint(2, 5)))
            out.append((f"{words()} ", rng.choice([long, long.capitalize(), f"{long}-{word()}", f"{word()}_{long}", f"{word()}/{long}", f"www.{long}.org", f"{long}.{word().capitalize()}"]), f" {words()}", 0))
        before, value = rng.choice(
            [
                lambda: (rng.choice(["commit ", "sha1: ", "checksum = ", "md5 ", "etag: ", "digest=", "revision "]), hexa(rng.choice([32, 40, 64]))),
                lambda: (rng.choice(["id = ", "uuid: ", "", "request "]), str(uuid.UUID(int=rng.getrandbits(128)))),
                lambda: (rng.choice(["password = ", "token: ", "api_key = "]), rng.choice(["your_api_key_here_1", "xxxxxxxxxxxxxxxx1", "changeme-example1", "INSERT_TOKEN_HERE_0", "dummy_value_12345", "example-password1"])),
                lambda: ("", "/".join(word() for _ in range(4)) + f"/file{rng.randint(1, 99)}.txt"),
                lambda: ("http://", f"{word()}.example.com/{word()}/{rng.randint(1, 9999)}"),
                lambda: ("", f"{word()}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com"),
                lambda: (words() + " ", f"{word()}{word()}{word()}-{word()}{rng.randint(0, 9)}"),
                lambda: ("file ", base64.b64encode((word() * 6).encode()).decode()),
                lambda: ("token = ", word() + word() + "Name" + str(rng.randint(0, 9))),
                lambda: ("version ", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}-build{rng.randint(1000, 99999)}"),
            ]
        )()
        out.append((f"{words()} {before}", value, f" {words()}", 0))
        out.append((f"{words()} ", word() + word() + word() + str(rng.randint(0, 99)), f" {words()}", 0))
    rng.shuffle(out)
    return out[:MAX_FINDINGS]


def findings_from(table: DataFrame) -> list[tuple[str, str, str, int]]:
    """At most ``MAX_FINDINGS`` of ``table (before, value, after, label)``: those with the smallest hashes, each once.

    Rows without a value or a label are no findings; a null neighbourhood is empty.
    """
    t = table.filter("value is not null and label is not null").select(F.coalesce("before", F.lit("")).alias("before"), "value", F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("int").alias("label"))
    return [tuple(r)[:4] for r in t.distinct().withColumn("h", F.xxhash64("before", "value", "after")).orderBy("h", "before", "value", "after", "label").limit(MAX_FINDINGS).collect()]


def held_out(findings: list[tuple[str, str, str, int]], threshold: float = 0.5) -> dict[str, float]:
    """Precision and recall on every fourth finding of a forest trained on the others."""
    test, train = findings[::4], [f for i, f in enumerate(findings) if i % 4]
    found = fitted(train).predict(np.array([features(b[-CONTEXT:], v, a[:CONTEXT]) for b, v, a, _ in test])) >= threshold
    true = np.array([f[3] == 1 for f in test])
    return {"precision": float((found & true).sum() / max(1, found.sum())), "recall": float((found & true).sum() / max(1, true.sum()))}


class Forest:
    """Random forest of CART trees (Gini) kept as flat arrays; deterministic for a seed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 9, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            feature, cut, left, right, share = [], [], [], [], []

            def grow(at: np.ndarray, level: int) -> int:
                me = len(feature)
                feature.append(-1), cut.append(0.0), left.append(0), right.append(0), share.append(float(y[at].mean()))
                if level == depth or len(at) < 4 or share[me] in (0.0, 1.0):
                    return me
                best = (1e9, -1, 0.0)
                for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
                    v = x[at, f]
                    for c in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))):
                        side = v <= c
                        k = int(side.sum())
                        if 0 < k < len(at):
                            p, r = y[at][side].mean(), y[at][~side].mean()
                            gini = k * p * (1 - p) + (len(at) - k) * r * (1 - r)
                            if gini < best[0]:
                                best = (gini, int(f), float(c))
                if best[1] >= 0:
                    side = x[at, best[1]] <= best[2]
                    feature[me], cut[me] = best[1], best[2]
                    left[me], right[me] = grow(at[side], level + 1), grow(at[~side], level + 1)
                return me

            grow(rows, 0)
            self.trees.append(tuple(map(np.array, (feature, cut, left, right, share))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = x[rows, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


_FITTED: dict[str, Forest] = {}


def fitted(findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """The forest for these findings (the default's is kept)."""
    if findings is None and "default" in _FITTED:
        return _FITTED["default"]
    rows = (findings or labelled_findings())[:MAX_FINDINGS]
    forest = Forest(np.array([features(b[-CONTEXT:], v, a[:CONTEXT]) for b, v, a, _ in rows]), np.array([r[3] for r in rows], float))
    if findings is None:
        _FITTED["default"] = forest
    return forest


def judged(texts: list[str | None], forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """For each text its candidates with the forest's score."""
    places = [candidates(t) if t else [] for t in texts]
    rows = [features(t[max(0, s - CONTEXT) : s], t[s:e], t[e : e + CONTEXT]) for t, p in zip(texts, places, strict=True) for s, e, _ in p]
    scores = iter(forest.predict(np.array(rows)).tolist() if rows else [])
    return [[(s, e, k, next(scores)) for s, e, k in p] for p in places]


def scan(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: place, kind, score, whether it is a secret, and the value's SHA-256.

    Null and empty texts have none.  Repeated rows repeat theirs, a null doc_id is passed on, an
    empty table gives an empty result, further columns are ignored.
    """
    forest = fitted(findings)

    def run(batches: Iterator[dict]) -> Iterator[list]:
        for b in batches:
            rows = [
                (i, s, e - s, k, x, x >= threshold, hashlib.sha256(t[s:e].encode()).hexdigest())
                for i, t, found in zip(b["doc_id"], b["text"], judged(b["text"], forest), strict=True)
                for s, e, k, x in found
            ]
            yield [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7

    return common.map_rows(docs.select("doc_id", "text"), run, "doc_id bigint, start bigint, length bigint, kind string, score double, secret boolean, value_sha256 string")


def redact(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None, threshold: float = 0.5, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; other texts and all other columns stay as they are."""
    forest = fitted(findings)
    common.small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, found in enumerate(judged(texts, forest)):
                spans: list[tuple[int, int]] = []
                for s, e in ((s, e) for s, e, _, x in found if x >= threshold):
                    if spans and s < spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                    else:
                        spans.append((s, e))
                for s, e in reversed(spans):
                    texts[i] = texts[i][:s] + mark + texts[i][e:]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
