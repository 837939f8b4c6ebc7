"""Language identification (operator 3) by error-correcting output codes.

Each language has a codeword of +-1; a binary logistic classifier over hashed character n-grams
predicts each bit.  A text gets the language whose codeword has the least loss, each bit's loss
weighted by how well its classifier did; close calls are flagged.

Fitted on a bounded sample of the distinct texts that are not held out (``MAX_TRAIN`` texts, or one
of each language if there are more of those; the same number of each language, those with the
smallest hashes); predictions use the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 2000
#: Texts of a language drawn by hash for each text of its part of the sample, the least that are drawn, and the number of hashes.
DRAWN, LEAST, HASHES = 4, 64, 1 << 40
BUCKETS = 4096
#: Least softmax share of the best language below which a text counts as ambiguous.
CLEAR = 0.9
UNKNOWN = "und"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def held_out(doc_id: Column) -> Column:
    """A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed 1-, 2- and 3-gram counts of the lower-cased text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = np.zeros(BUCKETS)
    code = np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        code = (code[: len(c) - n + 1] + c[n - 1 :]) * _MIX[n - 1]
        out += np.bincount((code >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n x bits of +-1: all splits for up to five languages, else the best-separated of seeded random codes."""
    if n <= 5:
        splits = range(1, 2 ** max(0, n - 1))
        return np.array([[1 if i == n - 1 or not s >> i & 1 else -1 for s in splits] for i in range(n)], np.int8).reshape(n, -1)
    rng, best, apart = np.random.default_rng(3), None, -1
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.int8), (n, 10 * int(np.ceil(np.log2(n)))))
        d = int((m[:, None, :] != m[None, :, :]).sum(2)[np.triu_indices(n, 1)].min())
        if d > apart and (np.abs(m.sum(0)) < n).all():
            best, apart = m, d
    return best


class Codes:
    """The fitted classifiers, codewords and bit weights.

    A bit's weight is the inverse of its classifier's mean loss on rows that it has not seen (each
    half of the sample is judged by a fit on the other), so that a bit that generalises badly counts
    for less.  The weights sum to the number of bits.
    """

    def __init__(self, x: np.ndarray, langs: list[str], steps: int = 150, rate: float = 40.0, shrink: float = 1e-5):
        self.names = sorted(set(langs))
        self.code = codewords(len(self.names)).astype(np.float32)
        bits = self.code.shape[1]
        self.w, self.b, self.weight = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32)
        if not bits:
            return
        y = self.code[[self.names.index(v) for v in langs]]

        def fitted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w, b = np.zeros_like(self.w), np.zeros_like(self.b)
            speed, bias_speed = np.zeros_like(w), np.zeros_like(b)
            for _ in range(steps):
                pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
                speed = 0.9 * speed - rate * (0.1 * (x.T @ pull) + shrink * w)
                bias_speed = 0.9 * bias_speed - 0.1 * pull.sum(0)
                w += speed
                b += bias_speed
            return w, b

        self.w, self.b = fitted(x, y)
        side = np.arange(len(x)) % 2 == 0
        if side.sum() >= 2 and (~side).sum() >= 2:
            loss = np.zeros(bits)
            for part in (side, ~side):
                w, b = fitted(x[part], y[part])
                loss += np.logaddexp(0, -y[~part] * (x[~part] @ w + b)).sum(0)
            weight = 1 / (loss / len(x) + 1e-3)
            self.weight = (weight / weight.sum() * bits).astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its softmax share, for each row of ``x``."""
        f = x @ self.w + self.b
        loss = np.stack([(np.logaddexp(0, -f * c) * self.weight).sum(1) for c in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        return loss.argmin(1), share.max(1)


def sample(docs: DataFrame) -> DataFrame | None:
    """``lang, h``: hashes of the texts to fit on, at most ``MAX_TRAIN`` or one of each language; None without any.

    Equal texts of a language are one, however many rows have them, so neither a repeated row nor a
    repeated doc_id makes the sample larger or leaves a language out.
    """
    texts = able(docs).select("lang", "h").distinct()
    sizes = common.written(texts.groupBy("lang").agg(F.count("*").alias("size")), "sizes")
    n = sizes.count()
    if not n:
        return None
    most = max(1, MAX_TRAIN // n)
    # a share of the hashes, so that a language's window gets a bounded number of texts however many it has
    share = F.pmod("h", F.lit(HASHES)) < F.lit(float(max(LEAST, DRAWN * most)) * HASHES) / F.col("size")
    drawn = common.joined(able(docs).select("lang", "h"), sizes, "lang", rows=n).filter(share).select("lang", "h").distinct()
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(HASHES)), "h"))
    return common.written(drawn.withColumn("place", first).filter(F.col("place") <= most).select("lang", "h"), "sample")


def able(docs: DataFrame) -> DataFrame:
    """``lang, text, h`` of the rows that may be learned from; ``h`` is a hash of the text."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return rows.select("lang", "text", F.xxhash64("text").alias("h"))


def fit(docs: DataFrame) -> Codes | None:
    """Fit on rows of ``docs`` that are not held out and have a language and a text with a letter; None without any."""
    some = sample(docs)
    if some is None:
        return None

    def run(batches: Iterator[dict]) -> Iterator[list]:
        seen: set[tuple[str, int]] = set()  # of the sample's keys, so bounded
        for b in batches:
            out: list[list] = [[], [], []]
            for lang, h, text in zip(b["lang"], b["h"], b["text"], strict=True):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    for c, v in zip(out, (lang, h, features(text).tobytes()), strict=True):
                        c.append(v)
            yield out

    each = common.map_rows(common.joined(able(docs), some, ["lang", "h"]).select("lang", "h", "text"), run, "lang string, h bigint, x binary")
    rows = sorted(each.groupBy("lang", "h").agg(F.min("x").alias("x")).collect())
    return Codes(np.stack([np.frombuffer(bytes(r.x), np.float32) for r in rows]), [r.lang for r in rows])


def predict(docs: DataFrame, model: Codes | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for each row.

    Null texts and texts without a letter, or all texts without a model, are ``und`` with score 0.
    Repeated rows repeat, an empty table gives an empty result, further columns are ignored.
    """

    def run(batches: Iterator[dict]) -> Iterator[list]:
        for b in batches:
            able = [i for i, t in enumerate(b["text"]) if model is not None and has_letter(t)]
            names, scores = [UNKNOWN] * len(b["text"]), [0.0] * len(b["text"])
            if able:
                best, share = model.decode(np.stack([features(b["text"][i]) for i in able]))
                for i, k, s in zip(able, best, share, strict=True):
                    names[i], scores[i] = model.names[k], float(min(1.0, s))
            yield [b["doc_id"], b["held"], names, scores, [s < CLEAR for s in scores]]

    return common.map_rows(docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return predict(docs, fit(docs.select("doc_id", "text", "lang")))
