"""Quality rules by tokeniser fertility (operator 9).

A public sentencepiece vocabulary measures each text: characters per token, tokens per word
(fertility), the share of byte-fallback tokens and the entropy of the token counts in bits.  A
text outside its language's band is rejected; where the language is null or has no band, that of
the script of most of its letters holds.  Two base rules (too few words; too many words in repeated
eight-word windows) reject before that.

The vocabulary never merges over a blank, so the tokens of a text's words joined by single blanks
are those of the words one by one: each word is encoded by itself and kept in a bounded cache, and a
text costs a look-up per word.
Rows are independent: no shuffle, one document in memory at a time besides its Arrow batch.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Words in each of a worker's two cache generations; the older is dropped when the newer is full.
CACHE_WORDS = 100_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Random odd multipliers, one for each place in a window.
PLACES = np.random.default_rng(9).integers(0, 2**63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Band:
    """What a text of a language may measure."""

    chars_per_token: tuple[float, float]
    tokens_per_word: tuple[float, float]
    fallback: float = 0.15
    entropy: float = 5.25


@dataclass(frozen=True)
class Rules:
    """``bands`` by language, ``scripts`` by script for other languages, and ``default`` for the rest.

    Below ``min_tokens`` the measures are too noisy and only the base rules decide.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    min_tokens: int = 100
    bands: dict[str, Band] = field(
        default_factory=lambda: {
            "de": Band((1.95, 6.5), (1.0, 2.95)),
            "en": Band((1.80, 6.5), (1.0, 2.80)),
            "es": Band((1.75, 6.5), (1.0, 3.05)),
            "fr": Band((1.70, 6.5), (1.0, 3.15)),
        }
    )
    scripts: dict[str, Band] = field(
        default_factory=lambda: {
            "latin": Band((1.3, 6.5), (1.0, 4.5), 0.2, 4.75),
            "cyrillic": Band((1.1, 5.0), (1.0, 6.0), 0.2, 4.75),
            "greek": Band((0.7, 4.0), (1.0, 9.0), 0.5, 4.0),
            "arabic": Band((0.6, 4.0), (1.0, 9.0), 0.5, 4.0),
            "east asian": Band((0.3, 3.0), (1.0, 500.0), 0.9, 4.0),
        }
    )
    default: Band = Band((0.3, 6.0), (0.8, 100.0), 0.95, 4.0)


#: Runs of a script's letters; the first of those with most letters is a text's script.
SCRIPTS = {
    "latin": re.compile("[A-Za-z\u00c0-\u024f]+"),
    "cyrillic": re.compile("[\u0400-\u052f]+"),
    "greek": re.compile("[\u0370-\u03ff]+"),
    "arabic": re.compile("[\u0600-\u06ff]+"),
    "east asian": re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+"),
}


def script(text: str) -> str | None:
    """The script of most of the letters; None without a letter of these."""
    counts = {k: sum(map(len, p.findall(text))) for k, p in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Meter:
    """Counts and measures of one text at a time."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def tokens(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        out = list(map(cache.get, words))
        if None in out:
            missing = [i for i, ids in enumerate(out) if ids is None]
            found = {w: self.older.get(w) for w in {words[i] for i in missing}}
            new = [w for w, ids in found.items() if ids is None]
            for w, ids in zip(new, self.model.encode([w.decode(errors="replace") for w in new], num_threads=1), strict=True):
                found[w] = array("I", ids).tobytes()
            for i in missing:
                out[i] = found[words[i]]
            if len(cache) + len(found) > CACHE_WORDS:
                self.older, self.cache = cache, {}
            self.cache.update((w, ids) for w, ids in found.items() if len(w) <= 64)
        return np.frombuffer(b"".join(out), "<u4")

    def counts(self, text: str | None) -> tuple[list[bytes], int, int, int, int]:
        """Words, their characters, symbols, repeated lines and words in repeated windows."""
        raw = (text or "").encode()
        words = raw.split()
        blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
        lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
        return words, len(text or "") - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)

    def measure(self, words: list[bytes], word_chars: int) -> tuple[int, float, float, float, float]:
        """Tokens, characters per token, tokens per word, byte-fallback share, entropy in bits."""
        ids = self.tokens(words)
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0, 0.0
        counts = np.bincount(ids) if n > 20_000 else np.unique(ids, return_counts=True)[1]
        p = counts[counts > 0] / n
        return n, word_chars / n, n / len(words), float(self.is_byte[ids].sum()) / n, float(-(p * np.log2(p)).sum())


def repeated(words: list[bytes]) -> int:
    """Words that lie in an eight-word window found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    size = n - WINDOW + 1
    key = np.zeros(size, np.uint64)
    for j, m in enumerate(PLACES):
        key += ids[j : j + size] * m
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base_failed(n_words: int, n_repeat: int, rules: Rules) -> bool:
    return n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words


def in_band(measured: tuple[int, float, float, float, float], lang: str | None, text: str | None, rules: Rules) -> bool:
    n, per_token, per_word, fallback, entropy = measured
    if n < rules.min_tokens:
        return True
    band = rules.bands.get(lang or "") or rules.scripts.get(script(text or "") or "", rules.default)
    return (
        band.chars_per_token[0] <= per_token <= band.chars_per_token[1]
        and band.tokens_per_word[0] <= per_word <= band.tokens_per_word[1]
        and fallback <= band.fallback
        and entropy >= min(band.entropy, 0.85 * math.log2(n))
    )


def meter(path: str) -> Meter:
    """One meter per worker process."""
    return common.model(("meter", path), lambda: Meter(path))


RESULT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
    "n_tokens bigint, chars_per_token double, tokens_per_word double, fallback_share double, token_entropy double"
)


def report(docs: DataFrame, rules: Rules = Rules(), path: str | None = None) -> DataFrame:
    """Counts, measures and verdict of each row of ``docs(doc_id, text, lang)``.

    Null text: no words, so ``base_failed``.  A null or unknown language gets its script's band.
    Repeated rows repeat, an empty table gives an empty result, further columns are ignored, a
    null doc_id is passed on.
    """
    path = path or vocabulary()

    def run(batches: Iterator[dict]) -> Iterator[list]:
        m = meter(path)
        for b in batches:
            rows = []
            for i, text, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                words, chars, symbols, lines, repeat = m.counts(text)
                failed = base_failed(len(words), repeat, rules)
                measured = m.measure(words, chars)
                rows.append((i, len(words), chars, symbols, lines, repeat, failed, not failed and in_band(measured, lang, text, rules), *measured))
            yield [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 13

    return common.map_rows(docs.select("doc_id", "text", "lang"), run, RESULT)


def keep(docs: DataFrame, rules: Rules = Rules(), path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; measured and filtered in one pass.

    Null and empty texts go; repeated rows pass or go together; an empty table gives an empty result.
    """
    path = path or vocabulary()
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = meter(path)
        for b in batches:
            verdicts = []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                words, chars, _, _, repeat = m.counts(text)
                verdicts.append(not base_failed(len(words), repeat, rules) and in_band(m.measure(words, chars), lang, text, rules))
            yield b.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.documents(spark, sf_dir))
