"""Token counts by offset-mapped attribution (operator 4).

Each document is encoded once, as a whole.  Its tokens' character spans are interval-joined with its
sections (lines with their line end, or given fields): both are sorted, so the join is a search.

Rule for tokens over a boundary: such a token counts for the section that holds most of its
characters, of equal ones the first; so the sections' counts sum to the document's.  A token that is
part of a character counts as that whole character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Spans:
    """Character spans of the tokens of whole texts."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token, in characters."""
        ends = np.cumsum(self.size[self.encoding.encode_ordinary(text)])
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        if text.isascii():
            return starts, ends
        char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1


def line_bounds(text: str) -> list[int]:
    """Starts of the lines, each with its line end, and the end of the text."""
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    if out[-1] != len(text) or len(out) == 1:
        out.append(len(text))
    return out


def attributed(starts: np.ndarray, ends: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens counted for each section, and tokens that touch it and another one."""
    b, n = np.asarray(bounds), len(bounds) - 1
    crossing = np.zeros(n, np.int64)
    if not len(starts):
        return crossing, crossing.copy()
    first = np.searchsorted(b[1:], starts, "right")
    last = np.searchsorted(b[1:], ends - 1, "right")
    for t in np.flatnonzero(first != last):
        s = np.arange(first[t], last[t] + 1)
        inside = np.minimum(b[s + 1], ends[t]) - np.maximum(b[s], starts[t])
        crossing[s[inside > 0]] += 1
        first[t] = s[np.argmax(inside)]
    return np.bincount(first, minlength=n), crossing


def spans(path: str) -> Spans:
    """One encoder per worker process."""
    return common.model(("spans", path), lambda: Spans(path))


def attribute(docs: DataFrame, path: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing``: one row for each section.

    Sections are the lines of ``text``; with ``fields`` the document is those columns one after the
    other (null: empty) and each is a section.  A null or empty text has one empty section.  Repeated
    rows repeat, a null doc_id is passed on, an empty table gives an empty result.
    """
    path = path or vocabulary()
    names = fields or ["text"]

    def run(batches: Iterator[dict]) -> Iterator[list]:
        own_spans = spans(path).spans
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, *parts in zip(b["doc_id"], *(b[n] for n in names), strict=True):
                text = "".join(p or "" for p in parts)
                bounds = np.cumsum([0, *(len(p or "") for p in parts)]).tolist() if fields else line_bounds(text)
                own, crossing = attributed(*own_spans(text), bounds)
                n = len(bounds) - 1
                for column, values in zip(out, ([i] * n, range(n), bounds[:-1], bounds[1:], own.tolist(), crossing.tolist()), strict=True):
                    column.extend(values)
            yield out

    columns = [F.col("doc_id"), *(F.col(n).cast("string").alias(n) for n in names)]
    return common.map_rows(docs.select(*columns), run, "doc_id bigint, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(common.documents(spark, sf_dir))
