"""The sentence graph searched question by question, without its edge table.

Sentences with a common entity, or that name a passage, are linked in numbers that grow with the square of
a question's passages.  Here a question keeps, for each entity and title, the list of its sentences; a
search goes through each list once or twice.  The edges meant are those of ``graph.merged``, in its order.
Where all edges are asked for, they are told from a table of some rows against all, and leave it at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import DAMPING

#: Bytes that are hashed at once.
BLOCK = 1 << 20
#: Cells of a table of links, pairs taken from lists at once, rows of a batch, pairs that a PageRank holds in memory.
CELLS, CHUNK, BATCH, HELD = 1 << 22, 1 << 20, 1 << 17, 1 << 25
#: How a row is linked with another: it comes before or after it, shares an entity, names its title, is named.
NEXT, PREVIOUS, SHARED, NAMES, NAMED = 1, 2, 4, 8, 16
_M, _A = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the stretches, and the stretch that each belongs to."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts), of


def joined(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(stretch, value)`` of all stretches, some ``CHUNK`` at a time."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - counts[lo] + CHUNK, "right")))
        at, of = spread(starts[lo:hi], counts[lo:hi])
        yield of + lo, values[at]
        lo = hi


class Lists:
    """Values by key, ascending."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, n: int) -> None:
        order = np.lexsort((values, keys))
        self.values, self.off = values[order], np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))]).astype(np.int64)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.values[self.off[k] : self.off[k + 1]]

    def join(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place in keys, value)`` of every value of every key."""
        at, of = spread(self.off[keys], self.off[keys + 1] - self.off[keys])
        return of, self.values[at]

    def chunks(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``join``, some at a time."""
        return joined(self.values, self.off[keys], self.off[keys + 1] - self.off[keys])


def _level(h: np.ndarray, w: int) -> np.ndarray:
    """Hashes of windows twice as long."""
    h = h[:-w] * _M + h[w:]
    h ^= h >> _S
    return h * _A


def containing(hay: pa.Array, needles: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(row, needle)`` for every distinct needle that stands in a string, each once; an empty one stands in all.

    A needle is told by its first and last ``w`` bytes, ``w`` the largest power of two up to its length;
    windows are hashed for all needles at once and what agrees is compared byte by byte.
    """
    present = np.flatnonzero(np.asarray(hay.is_valid()))
    hay = hay.fill_null("").cast(pa.large_string())
    _, offs, data = hay.buffers()
    off = np.frombuffer(offs, np.int64)[hay.offset : hay.offset + len(hay) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    levels: dict[int, dict[int, list[int]]] = {}
    rows, found = [], []
    for k, x in enumerate(needles):
        if x:
            levels.setdefault(1 << (len(x).bit_length() - 1), {}).setdefault(len(x), []).append(k)
        else:
            rows.append(present), found.append(np.full(len(present), k))
    plan = {}
    for w, lengths in levels.items():
        plan[w] = {}
        for length, ks in lengths.items():
            m = np.array([np.frombuffer(needles[k], np.uint8) for k in ks])
            first, last, v = m[:, :w].T.astype(np.uint64), m[:, length - w :].T.astype(np.uint64), 1
            while v < w:
                first, last, v = _level(first, v), _level(last, v), 2 * v
            both = first[0] * _M ^ last[0]
            order = np.argsort(both)
            plan[w][length] = (both[order], np.array(ks)[order], m[order], first[0])
    begin = 0
    while begin < len(hay) and plan:
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + BLOCK, "right")) - 1)
        d, o = data[off[begin] : off[end]], off[begin : end + 1] - off[begin]
        h, w = d.astype(np.uint64), 1
        while len(h) and w <= max(plan):
            if w in plan:
                table = np.zeros(1 << 16, bool)
                for _, _, _, firsts in plan[w].values():
                    table[(firsts >> np.uint64(48)).astype(np.int64) if w > 1 else firsts.astype(np.int64)] = True
                cand = np.flatnonzero(table[(h >> np.uint64(48)).astype(np.int64) if w > 1 else h.astype(np.int64)])
                for length, (both, ks, m, firsts) in plan[w].items():
                    at = cand[cand + length <= len(d)]
                    at = at[np.isin(h[at], firsts)]
                    mixed = h[at] * _M ^ h[at + length - w]
                    i = np.minimum(np.searchsorted(both, mixed), len(both) - 1)
                    at, i = at[both[i] == mixed], i[both[i] == mixed]
                    row = np.searchsorted(o, at, "right") - 1
                    inside = at + length <= o[row + 1]
                    at, i, row = at[inside], i[inside], row[inside]
                    same = np.ones(len(at), bool)
                    for c in range(length):
                        same &= d[at + c] == m[i, c]
                    pair = np.unique((row[same] + begin) * len(needles) + ks[i[same]])
                    rows.append(pair // len(needles)), found.append(pair % len(needles))
            if 2 * w > len(d):
                break
            h, w = _level(h, w), 2 * w
        begin = end
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.concatenate(rows).astype(np.int64) * max(1, len(needles)) + np.concatenate(found))
    return pair // max(1, len(needles)), pair % max(1, len(needles))


def _flat(c: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows and elements of a column of lists."""
    return np.asarray(pc.list_parent_indices(c)).astype(np.int64), pc.list_flatten(c)


def sharing(text: pa.Array, title: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, title)`` with two shared tokens or one of six letters.

    For two a title is looked up by all its tokens but the most frequent one, as one of two is another.
    """
    owner, words = _flat(title)
    vocab = words.unique()
    tc = np.asarray(pc.index_in(words, vocab)).astype(np.int64)
    row, words = _flat(text)
    code = pc.index_in(words, vocab)
    known = np.asarray(code.is_valid())
    row, code = row[known], np.asarray(code.drop_null()).astype(np.int64)
    n, nt = len(vocab), len(title)
    if not n or not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    long = np.asarray(pc.utf8_length(vocab)) >= 6
    long = Lists(tc[long[tc]], owner[long[tc]], n)
    often = np.bincount(code, minlength=n)
    order = np.lexsort((tc, -often[tc], owner))
    rest = np.concatenate([[False], owner[order][1:] == owner[order][:-1]])
    rest, tokens = Lists(tc[order][rest], owner[order][rest], n), Lists(owner, tc, nt)
    work, pairs, lo = np.cumsum((long.off[1:] - long.off[:-1] + rest.off[1:] - rest.off[:-1])[code]), [], 0
    while lo < len(row):
        # whole rows, some CHUNK of what their tokens find
        hi = int(np.searchsorted(row, row[min(len(row) - 1, max(lo, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + CHUNK, "right")) - 1))], "right"))
        r, c = row[lo:hi], code[lo:hi]
        of, t = long.join(c)
        pair = [np.unique(r[of] * nt + t)]
        of, t = rest.join(c)
        cand = np.unique(r[of] * nt + t)
        of, x = tokens.join(cand % nt)
        has = np.isin(cand[of] // nt * n + x, r * n + c)
        pair.append(cand[np.bincount(of, has, len(cand)) >= 2])
        pairs.append(np.unique(np.concatenate(pair)))
        lo = hi
    pair = np.concatenate(pairs)
    return pair // nt, pair % nt


class Question:
    """One question's sentences by entity, by title and by title named; rows are in the order of ``node_ord``."""

    def __init__(self, t: pa.Table, alone: bool = False) -> None:
        """``alone``: without entities and titles named, as rows of no question are linked in their passages only."""
        t = t.sort_by("node_ord").combine_chunks()
        col = lambda c: t.column(c).chunk(0) if t.num_rows else pa.array([], t.schema.field(c).type)
        self.node = np.asarray(col("node_ord")).astype(np.int64)
        self.n = n = len(self.node)
        titles = col("title").dictionary_encode()
        self.titles = titles.dictionary
        self.title = np.asarray(titles.indices.fill_null(-1)).astype(np.int64)
        nt = len(self.titles)
        place, sent = np.asarray(col("passage_ord")).astype(np.int64), np.asarray(col("sent_id")).astype(np.int64)
        order = np.lexsort((sent, place))
        near = place[order][1:] == place[order][:-1]
        self.next, self.prev = np.full(n, -1), np.full(n, -1)
        self.next[order[:-1][near]], self.prev[order[1:][near]] = order[1:][near], order[:-1][near]
        self.own = pa.nulls(n, t.schema.field("entities").type) if alone else col("entities")
        row, e = _flat(self.own)
        e = e.dictionary_encode()
        self.entities, code = e.dictionary, np.asarray(e.indices).astype(np.int64)
        row, code = row[self.title[row] >= 0], code[self.title[row] >= 0]
        self.of, self.by = Lists(row, code, n), Lists(code, row, len(self.entities))
        titled = np.flatnonzero(self.title >= 0)
        self.rows = Lists(self.title[titled], titled, nt)
        src, dst = self._mentions(col, nt) if "text" in t.column_names and not alone else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        own = (self.title[src] >= 0) & (self.title[src] != dst)
        self.names, self.named = Lists(src[own], dst[own], n), Lists(dst[own], src[own], nt)
        rank = col("rank")
        self.starts = np.flatnonzero(np.asarray(rank.is_valid()))
        self.rank = np.asarray(rank.drop_null()).astype(np.int64)
        restart = col("restart")
        self.starting, self.restart = np.asarray(restart.is_valid()), np.asarray(restart.fill_null(0.0)).astype(float)

    def _mentions(self, col: Callable, nt: int) -> tuple[np.ndarray, np.ndarray]:
        """``(row, title)`` where ``T.mentions`` holds."""
        if not nt:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = [T.python_mention(x) if x is not None else (None, None, None) for x in col("text").to_pylist()]
        names = [T.python_mention(x) for x in self.titles.to_pylist()]
        pairs = []
        for k, least in ((0, 0), (1, 5)):
            wide = np.array([i for i, x in enumerate(names) if len(x[k]) >= least], np.int64)
            coded = pa.array([names[i][k] for i in wide], pa.string()).dictionary_encode()
            row, place = containing(pa.array([x[k] for x in texts], pa.large_string()), [x.encode() for x in coded.dictionary.to_pylist()])
            of, i = Lists(np.asarray(coded.indices).astype(np.int64), wide, len(coded.dictionary)).join(place)
            pairs.append(row[of] * nt + i)
        words = pa.list_(pa.string())
        row, i = sharing(pa.array([x[2] for x in texts], words), pa.array([x[2] for x in names], words))
        pair = np.unique(np.concatenate([*pairs, row * nt + i]))
        return pair // nt, pair % nt

    def around(self, a: int, entities: Iterator[np.ndarray], named: Iterator[np.ndarray], naming: np.ndarray, free: np.ndarray | None = None) -> np.ndarray:
        """Rows linked with ``a`` by these lists (those that are ``free``), in the order of the links: phase, source, end."""
        parts = [[b for b in (self.next[a], self.prev[a]) if b >= 0], entities, named, [naming]]
        parts = [np.asarray(p, np.int64) if k == 0 else np.concatenate([*p, np.zeros(0, np.int64)]) for k, p in enumerate(parts)]
        if free is not None:
            parts = [p[free[p]] for p in parts]
        b = np.concatenate(parts)
        if len(b) < 2:
            return b
        phase = np.repeat([0, 1, 2, 2], [len(p) for p in parts])
        i, j = np.minimum(a, b), np.maximum(a, b)
        i[phase == 2], j[phase == 2] = np.concatenate([np.full(len(parts[2]), a), parts[3]]), np.concatenate([parts[2], np.full(len(parts[3]), a)])
        order = np.lexsort((j, i, phase))
        return b[order][np.sort(np.unique(b[order], return_index=True)[1])]

    def links(self, a: int) -> np.ndarray:
        """All rows linked with ``a``, in the order of their edges."""
        t = self.title[a]
        shared = ((r := self.by[e])[self.title[r] != t] for e in self.of[a])
        return self.around(a, shared, (self.rows[x] for x in self.names[a]), self.named[t] if t >= 0 else np.zeros(0, np.int64))

    def near(self, most: int) -> np.ndarray:
        """Least hop of each row from the starts, or -1."""
        hop = np.full(self.n, -1, np.int64)
        front = self.starts
        hop[front] = 0
        for h in range(1, most + 1):
            front = self.step(front)
            front = front[hop[front] < 0]
            hop[front] = h
        return hop

    def step(self, front: np.ndarray) -> np.ndarray:
        """Rows linked with one of ``front``, ascending."""
        of, e = self.of.join(front)
        t = self.title[front][of]
        low, high = np.full(len(self.entities), len(self.titles)), np.full(len(self.entities), -1)
        np.minimum.at(low, e, t), np.maximum.at(high, e, t)
        e = np.unique(e)
        of, rows = self.by.join(e)
        other = (self.title[rows] != low[e][of]) | (self.title[rows] != high[e][of])
        t = self.title[front]
        found = [self.next[front], self.prev[front], rows[other], self.rows.join(np.unique(self.names.join(front)[1]))[1], self.named.join(np.unique(t[t >= 0]))[1]]
        found = np.unique(np.concatenate(found))
        return found[found >= 0]

    def ends(self, a: int, out: bool = True, back: bool = True) -> np.ndarray:
        """Rows linked with ``a``, ascending; title mentions that lead ``out`` of it, ``back`` to it, or both."""
        t, none = self.title[a], np.zeros(0, np.int64)
        shared = self.by.join(self.of[a])[1]
        b = [[self.next[a], self.prev[a]], shared[self.title[shared] != t], self.rows.join(self.names[a])[1] if out else none, self.named[t] if back and t >= 0 else none]
        b = np.unique(np.concatenate([np.asarray(x, np.int64) for x in b]))
        return b[b >= 0]

    def table(self, kinds: int, rows: np.ndarray | None = None, after: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All ``a, b`` linked in one of ``kinds``, each once and ascending, and how; ``a`` of ``rows``, ``b`` later in the order where ``after``."""
        n = self.n
        rows = np.arange(n) if rows is None else rows
        size = max(1, CELLS // max(1, n))
        place = self._places() if after and kinds & SHARED else np.zeros(0, np.int64)
        for begin in range(0, len(rows), size):
            some = rows[begin : begin + size]
            low = int(some[0]) if after else 0
            w, titled = n - low, np.flatnonzero(self.title[some] >= 0)
            how = np.zeros(len(some) * w, np.uint8)

            def mark(bit: int, k: np.ndarray, b: np.ndarray) -> None:
                k, b = k[b >= low], b[b >= low]
                how[k * w + (b - low)] |= bit  # noqa: B023

            if kinds & SHARED:
                at, of = spread(self.of.off[some], self.of.off[some + 1] - self.of.off[some])
                e = self.of.values[at]
                first = place[at] + 1 if after else self.by.off[e]
                for k, b in joined(self.by.values, first, self.by.off[e + 1] - first):
                    how[of[k] * w + (b - low)] = SHARED
                for k, b in self.rows.chunks(self.title[some[titled]]):
                    k, b = k[b >= low], b[b >= low]
                    how[titled[k] * w + (b - low)] = 0
            if kinds & NAMES:
                of, t = self.names.join(some)
                for k, b in self.rows.chunks(t):
                    mark(NAMES, of[k], b)
            if kinds & NAMED:
                for k, b in self.named.chunks(self.title[some[titled]]):
                    mark(NAMED, titled[k], b)
            if kinds & NEXT:
                mark(NEXT, np.arange(len(some)), self.next[some])
            if kinds & PREVIOUS:
                mark(PREVIOUS, np.arange(len(some)), self.prev[some])
            at = np.flatnonzero(how != 0)
            a = at // w
            b = at - a * w + low
            a, how = some[a], how[at]
            if after:
                a, b, how = a[b > a], b[b > a], how[b > a]
            yield a, b, how

    def _places(self) -> np.ndarray:
        """Where each entity of ``of`` has its row in ``by``."""
        row = np.repeat(np.arange(self.n), np.diff(self.of.off))
        place = np.empty(len(row), np.int64)
        place[np.lexsort((row, self.of.values))] = np.arange(len(row))
        return place

    def walks(self, a: int, b: int, k: int) -> list[list[int]]:
        """The first ``k`` paths of at most 2 links in their own direction from ``a`` to ``b``: the shortest, then by rows."""
        if a == b:
            return [[a]][:k]
        out = self.ends(a, back=False)
        straight = [[a, b]] if b in out else []
        return [*straight, *([a, int(m), b] for m in np.intersect1d(out, self.ends(b, out=False))[:k])][:k]

    def simple(self, a: int, b: int, k: int) -> list[list[int]]:
        """The first ``k`` simple paths of at most 3 links in any direction between two rows: the shortest, then by rows.

        Only second rows that are linked with one linked with ``b`` are gone on from, and each has a path.
        """
        out, back = self.ends(a), self.ends(b)
        found = ([a, b] for _ in range(int(b in out)))
        middle = ([a, int(m), b] for m in np.intersect1d(out, back))

        def long() -> Iterator[list[int]]:
            third = back[back != a]
            for m in np.intersect1d(out[out != b], self.step(third)).tolist():
                yield from ([a, m, int(x), b] for x in np.intersect1d(third, self.ends(m)))

        return list(islice((p for some in (found, middle, long()) for p in some), k))

    def carried(self, path: list[int]) -> list[str]:
        """What ``graph.grounded_values`` finds on a path of typed edges."""
        own = lambda r: set(self.own[r].as_py() or ())
        if len(path) == 1:
            found = own(path[0])
        else:
            found = set()
            for a, b in zip(path, path[1:]):
                if self.title[a] >= 0 and self.title[b] >= 0 and self.title[a] != self.title[b]:
                    found |= own(a) & own(b)
                if self.title[b] in self.names[a]:
                    found.add(self.titles[int(self.title[b])].as_py())
        return sorted(found - {"", None})

    def pagerank(self, damping: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a link or a restart, and their scores, as ``graph.pagerank`` has them.

        Links are held in memory up to ``HELD``; beyond that each round makes them again.
        """

        def links() -> Iterator[tuple[np.ndarray, ...]]:
            for a, b, how in self.table(NEXT | PREVIOUS | SHARED | NAMES | NAMED):
                twice = how >= NAMES
                first = np.flatnonzero(np.diff(a, prepend=-1))
                yield a[first], first, b.astype(np.int32), a[twice], b[twice]

        def over(x: np.ndarray, some: Iterator[tuple[np.ndarray, ...]]) -> np.ndarray:
            y = np.zeros(self.n)
            for row, first, b, a2, b2 in some:
                if len(row):
                    y[row] += np.add.reduceat(x[b], first)
                    np.add.at(y, a2, x[b2])
            return y

        held, size = [], 0
        for some in links():
            size += len(some[2])
            if size > HELD:
                break
            held.append(some)
        every = links if size > HELD else lambda: iter(held)
        if size > HELD:
            held = []
        out = over(np.ones(self.n), every())
        at = np.flatnonzero((out > 0) | self.starting)
        n, p = len(at), np.maximum(0.0, self.restart)
        p = p / p.sum() if p.sum() else np.where((out > 0) | self.starting, 1 / max(1, n), 0.0)
        x = p.copy()
        for _ in range(rounds):
            share = np.divide(x, out, out=np.zeros(self.n), where=out > 0)
            new = damping * (over(share, every()) + x[out == 0].sum() * p) + (1 - damping) * p
            done = np.abs(new - x).sum() < n * 1e-6
            x = new
            if done:
                break
        return at, x[at]

    def search(self, most: int) -> tuple[np.ndarray, ...]:
        """Rows found from the starts: ``row, hop, disc, parent``, as ``graph.paths_from_seeds`` finds them.

        A list that has been gone through has no rows left to find, but for an entity those of the title it
        was met in.
        """
        hop, disc, parent = (np.full(self.n, -1, np.int64) for _ in range(3))
        front = self.starts[np.argsort(self.rank, kind="stable")]
        hop[front], disc[front] = 0, np.sort(self.rank)
        left: dict[int, tuple[np.ndarray, int]] = {}
        named, naming = set(), set()

        def shared(a: int) -> Iterator[np.ndarray]:
            for e in self.of[a].tolist():
                rows, only = left.get(e) or (self.by[e], -1)
                if len(rows) and only != self.title[a]:
                    own = self.title[rows] == self.title[a]
                    left[e] = rows[own], int(self.title[a])
                    yield rows[~own]

        def to(a: int) -> Iterator[np.ndarray]:
            for x in self.names[a].tolist():
                if x not in named:
                    named.add(x)
                    yield self.rows[x]

        for h in range(1, most + 1):
            found, place = [], 1
            for a in front.tolist():
                t = int(self.title[a])
                back = self.named[t] if t >= 0 and t not in naming else np.zeros(0, np.int64)
                naming.add(t)
                b = self.around(a, shared(a), to(a), back, hop < 0)
                hop[b], parent[b], disc[b] = h, a, np.arange(place, place + len(b))
                place += len(b)
                found.append(b)
            front = np.concatenate([*found, np.zeros(0, np.int64)])
        got = np.flatnonzero(hop >= 0)
        return got, hop[got], disc[got], parent


def by_question(nodes: DataFrame, run: Callable[[Question], Iterator[dict]], schema: str, without: tuple[str, ...] = ()) -> DataFrame:
    """``run`` of each question, columns without ``qid``; ``nodes`` may have a ``rank``, null where a search doesn't start, and a ``restart``.

    ``without`` "entities" or "text" these are not read, and rows not linked by them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "qid bigint, " + schema
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    given = lambda c, kind: (F.col(c) if c in nodes.columns else F.lit(None)).cast(kind).alias(c)
    entities = F.lit(None).cast("array<string>") if "entities" in without else T.entities(F.col("text"))
    text = [] if "text" in without else ["text"]
    cols = nodes.select("qid", "node_ord", "passage_ord", "sent_id", "title", *text, entities.alias("entities"), given("rank", "bigint"), given("restart", "double"))

    def one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid = key[0].as_py()
        q = Question(pa.Table.from_batches(batches), qid is None)
        for out in run(q):
            n = len(next(iter(out.values())))
            for k in range(0, n, BATCH):
                ids = pa.array([qid], pa.int64()).take(pa.array(np.zeros(min(n - k, BATCH), np.int64)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(out[f.name][k : k + BATCH], f.type) for f in list(arrow)[1:]]], schema=arrow)

    one.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return cols.groupBy("qid").applyInArrow(one, schema)


def _table(nodes: DataFrame, kinds: int, after: bool, without: tuple[str, ...] = ()) -> DataFrame:
    """``qid, src, dst, how`` of ``Question.table``."""

    def run(q: Question) -> Iterator[dict]:
        for a, b, how in q.table(kinds, after=after):
            yield {"src": q.node[a], "dst": q.node[b], "how": how}

    return by_question(nodes, run, "src int, dst int, how tinyint", without)


def _named(names: dict[str, int], how: Column) -> Column:
    """The names of the bits set, in the order given and joined by commas."""
    return F.get(F.array(*[F.lit(",".join(k for k, bits in names.items() if i & bits)) for i in range(32)]), how)


def overlap_edges(nodes: DataFrame) -> DataFrame:
    """``graph.entity_overlap``: ``qid, src, dst``."""
    return _table(nodes, SHARED, True, ("text",)).drop("how")


def mention_edges(nodes: DataFrame) -> DataFrame:
    """``graph.title_mention``: ``qid, src, dst``."""

    def run(q: Question) -> Iterator[dict]:
        of, t = q.names.join(np.arange(q.n))
        for k, b in q.rows.chunks(t):
            yield {"src": q.node[of[k]], "dst": q.node[b]}

    return by_question(nodes, run, "src int, dst int", ("entities",))


def merged_edges(nodes: DataFrame) -> DataFrame:
    """``graph.merged`` of all edges: ``qid, src, dst, kinds, weight``."""
    e = _table(nodes, NEXT | PREVIOUS | SHARED | NAMES | NAMED, True)
    kinds = _named({"entity_overlap": SHARED, "same_passage": NEXT | PREVIOUS, "title_mention": NAMES | NAMED}, F.col("how"))
    return e.select("qid", "src", "dst", kinds.alias("kinds"), F.when(F.col("how") >= NAMES, 2.0).otherwise(1.0).alias("weight"))


def typed_edges(nodes: DataFrame) -> DataFrame:
    """``graph.typed``, its kinds joined by commas."""
    e = _table(nodes, NEXT | PREVIOUS | SHARED | NAMES, False)
    return e.select("qid", "src", "dst", _named({"entity_coreference": SHARED, "next": NEXT, "previous": PREVIOUS, "title_mention": NAMES}, F.col("how")).alias("kinds"))


def pool_neighbours(nodes: DataFrame, most: int = 1) -> DataFrame:
    """``qid, node_ord, n, neighbours`` for the nodes within ``most`` hops of those with a ``rank``: ``graph.neighbours`` in this pool, as a count and the md5 of them joined by commas.

    The order of a node's edges is that of their phases, then of the other ends; but among title mentions
    those from smaller ends to it come first, then those from it.
    """

    def run(q: Question) -> Iterator[dict]:
        pool = q.near(most) >= 0
        rows = np.flatnonzero(pool)
        ids = np.array([str(x) for x in q.node.tolist()], object)
        for begin in range(0, len(rows), 1 << 12):
            some = rows[begin : begin + (1 << 12)]
            n, md5 = np.zeros(len(some), np.int64), [hashlib.md5(b"").hexdigest()] * len(some)
            for a, b, how in q.table(NEXT | PREVIOUS | SHARED | NAMES | NAMED, some):
                a, b, how = a[pool[b]], b[pool[b]], how[pool[b]]
                first = np.flatnonzero(np.diff(a, prepend=-1))
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a)]):
                    x, h, k = b[i:j], how[i:j], int(np.searchsorted(some, a[i]))
                    near, shared = (h & (NEXT | PREVIOUS)) > 0, (h & SHARED) > 0
                    rest, r = ~near & ~shared, []
                    if rest.any():
                        y, h = x[rest], h[rest]
                        early = ((h & NAMED) > 0) & (y < a[i])
                        to = ~early & ((h & NAMES) > 0)
                        r = [y[early], y[to], y[~early & ~to]]
                    n[k], md5[k] = j - i, hashlib.md5(",".join(ids[np.concatenate([x[near], x[shared & ~near], *r])]).encode()).hexdigest()
            yield {"node_ord": q.node[some], "n": n, "neighbours": md5}

    return by_question(nodes, run, "node_ord int, n bigint, neighbours string")


def _between(nodes: DataFrame, schema: str, each: Callable[[Question, list[tuple]], dict], find: Callable[[Question, int, int], list[list[int]]], apart: bool) -> DataFrame:
    """Paths between the nodes with a ``rank``, pairs of nodes in both orders or each once if ``apart``."""

    def run(q: Question) -> Iterator[dict]:
        found = [(a, b, p, i + 1) for a in q.starts.tolist() for b in q.starts.tolist() if a < b or not apart for i, p in enumerate(find(q, a, b))]
        if found:
            yield each(q, found)

    return by_question(nodes, run, schema)


def _paths(q: Question, found: list[tuple]) -> dict:
    src, dst = (q.node[[f[i] for f in found]] for i in (0, 1))
    return {"src": src, "dst": dst, "path": [q.node[f[2]].tolist() for f in found], "hops": [len(f[2]) - 1 for f in found], "path_rank": [f[3] for f in found]}


PATHS = "src int, dst int, path array<int>, hops int, path_rank int"


def typed_paths(nodes: DataFrame, k: int = 3) -> DataFrame:
    """``graph.directed_paths`` of at most 2 hops along ``graph.typed`` between all nodes with a ``rank``."""
    return _between(nodes, PATHS, _paths, lambda q, a, b: q.walks(a, b, k), False)


def simple_paths(nodes: DataFrame, k: int = 3) -> DataFrame:
    """``graph.simple_paths`` of at most 3 hops between any two nodes with a ``rank``."""
    return _between(nodes, PATHS, _paths, lambda q, a, b: q.simple(a, b, k), True)


def grounded_paths(nodes: DataFrame, k: int = 3) -> DataFrame:
    """``graph.grounded_values`` of ``typed_paths``: ``qid, path, values``."""
    each = lambda q, found: {"path": [q.node[f[2]].tolist() for f in found], "values": [q.carried(f[2]) for f in found]}
    return _between(nodes, "path array<int>, values array<string>", each, lambda q, a, b: q.walks(a, b, k), False)


def pagerank(nodes: DataFrame) -> DataFrame:
    """``graph.pagerank`` with the restarts that ``nodes`` have."""

    def run(q: Question) -> Iterator[dict]:
        at, score = q.pagerank(DAMPING)
        yield {"node_ord": q.node[at], "score": score}

    return by_question(nodes, run, "node_ord bigint, score double")


def paths(nodes: DataFrame, most: int = 2) -> DataFrame:
    """``graph.paths_from_seeds`` from the nodes with a ``rank``."""

    def run(q: Question) -> Iterator[dict]:
        row, hop, disc, parent = q.search(most)
        yield {"node_ord": q.node[row], "hop": hop, "disc": disc, "path": [_way(q, parent, r) for r in row.tolist()]}

    return by_question(nodes, run, "node_ord bigint, hop int, disc bigint, path array<bigint>")


def _way(q: Question, parent: np.ndarray, r: int) -> list[int]:
    way = []
    while r >= 0:
        way.append(int(q.node[r]))
        r = parent[r]
    return way[::-1]


def hops(nodes: DataFrame, most: int = 2) -> DataFrame:
    """``graph.hops`` from the nodes with a ``rank``."""

    def run(q: Question) -> Iterator[dict]:
        hop = q.near(most)
        row = np.flatnonzero(hop >= 0)
        yield {"node_ord": q.node[row], "hop": hop[row]}

    return by_question(nodes, run, "node_ord bigint, hop int")


def arcs(nodes: DataFrame) -> DataFrame:
    """``qid, src, dst``: all edges at the nodes with a ``rank``, these first."""

    def run(q: Question) -> Iterator[dict]:
        for a in q.starts.tolist():
            b = q.links(a)
            yield {"src": np.full(len(b), q.node[a]), "dst": q.node[b]}

    return by_question(nodes, run, "src bigint, dst bigint")
