"""Evidence selection under a token budget.

Prefix strategies are running sums; skip strategies fold an ordered array inside the JVM; strategies
whose scores depend on what is selected run per question in pandas (a question's candidates are a few
hundred rows).  Candidates are ``qid, ord, title, cost, semantic, graph, ...``; ``ord`` ends every order.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fusion


def _check(budget: int | None, **least: float) -> None:
    if budget is not None and budget < 0:
        raise ValueError("negative budget")
    for name, value in least.items():
        if value < 0:
            raise ValueError(f"negative {name}")


def prefix(c: DataFrame, score: Column, budget: int | None = None, top_k: int | None = None) -> DataFrame:
    """Best first up to the first that overflows; the budget wins over ``top_k``; neither takes all."""
    _check(budget)
    w = W.partitionBy("qid").orderBy(F.desc("score"), "ord")
    out = c.withColumn("score", score).withColumn("sel", F.row_number().over(w))
    if budget is not None:
        return out.withColumn("used", F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("used") <= budget)
    return out.filter(F.col("sel") <= top_k) if top_k is not None else out


def topk(c: DataFrame, alpha: float = 1.0, **kw: int) -> DataFrame:
    return prefix(c, fusion.blend(alpha), **kw)


def normalized_topk(c: DataFrame, alpha: float = 1.0, **kw: int) -> DataFrame:
    c = fusion.with_percentiles(c)
    return prefix(c, fusion.blend(alpha, "p_semantic", "p_graph"), **kw)


def rrf(c: DataFrame, alpha: float = 0.5, **kw: int) -> DataFrame:
    c = c.withColumn("fused", fusion.reciprocal(alpha))
    return prefix(c, F.col("fused"), **kw)


def random(c: DataFrame, seed: int = 0, **kw: int) -> DataFrame:
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("qid").cast("string"), F.col("ord").cast("string"))), 1, 8), 16, 10).cast("double")
    return prefix(c, draw, **kw)


def threshold(c: DataFrame, tau: float | None, alpha: float = 1.0) -> DataFrame:
    if tau is None:
        raise ValueError("threshold needs tau")
    return c.withColumn("score", fusion.blend(alpha)).filter(F.col("score") >= tau)


def _fold(lists: DataFrame, budget: int | None, top_k: int | None, strict: bool) -> DataFrame:
    """Fold ``qid, us`` (arrays of ``keys, costs``, in order) inside the JVM; a unit that does not fit is passed over."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("sel"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.filter(F.arrays_zip(x["keys"].alias("k"), x["costs"].alias("c")), lambda z: ~F.array_contains(s["sel"], z["k"]))
        used = s["used"] + F.aggregate(fresh, F.lit(0).cast("bigint"), lambda t, z: t + z["c"])
        sel = F.array_distinct(F.concat(s["sel"], x["keys"]))
        fits = F.lit(True) if budget is None else used <= budget
        if top_k is not None:
            fits = fits & ((F.size(sel) <= top_k) if strict else (F.size(s["sel"]) < top_k))
        return F.when(fits, F.struct(used.alias("used"), sel.alias("sel"))).otherwise(s)

    out = lists.select("qid", F.aggregate("us", zero, step).alias("s"))
    return out.select("qid", F.col("s.used").alias("used"), F.array_join("s.sel", ",").alias("selected"))


def skip_fold(units: DataFrame, rank: list[Column], budget: int | None, top_k: int | None = None, strict: bool = True) -> DataFrame:
    """Units in order; one that does not fit is passed over.

    ``units`` has ``qid, keys array, costs array``; only keys not yet selected cost.  ``strict`` never
    goes beyond ``top_k``; otherwise a unit may, once the count is still below it.
    """
    _check(budget)
    order = W.partitionBy("qid").orderBy(*rank)
    u = units.withColumn("rk", F.row_number().over(order)).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "keys", "costs"))).alias("us"))
    return _fold(u, budget, top_k, strict)


def singles(c: DataFrame, *keep: str) -> DataFrame:
    return c.select("qid", F.array(F.col("ord").cast("int")).alias("keys"), F.array(F.col("cost").cast("bigint")).alias("costs"), "ord", *keep)


def _by_question(c: DataFrame, *columns: str) -> DataFrame:
    """``qid, xs, at``: a question's candidates ``k, c, a`` and ``columns`` as one array, and as a map by ``k``.

    Anchors are looked up in the map, so there is no join and one exchange by question.
    """
    x = F.struct(F.col("ord").cast("int").alias("k"), F.col("cost").cast("bigint").alias("c"), F.col("anchor").cast("int").alias("a"), *columns)
    lists = c.groupBy("qid").agg(F.collect_list(x).alias("xs"))
    return lists.withColumn("at", F.map_from_entries(F.transform("xs", lambda x: F.struct(x["k"], x))))


def _unit(rank: list[Column], x: Column, a: Column, pair: Column) -> Column:
    """A sortable unit: a candidate with its anchor ``a`` where ``pair`` holds, else alone."""
    both = lambda f: F.when(pair, F.array(a[f], x[f])).otherwise(F.array(x[f]))
    return F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], both("k").alias("keys"), both("c").alias("costs"))


def _anchor(x: Column) -> Column:
    return F.try_element_at(F.col("at"), x["a"])


def _anchored(c: DataFrame) -> DataFrame:
    """Each candidate with its anchor, best ``score`` first; ties by relevance, semantic score and ``ord``."""
    lists = _by_question(c, "score", "relevance", "sem")
    units = lambda x: _unit([-x["score"], -x["relevance"], -x["sem"], x["k"]], x, _anchor(x), _anchor(x).isNotNull())
    return lists.select("qid", F.array_sort(F.transform("xs", units)).alias("us"))


def _conditional(c: DataFrame, alpha: float, weight: float) -> DataFrame:
    c = fusion.with_percentiles(c).withColumns({"p_cond": fusion.percentile("cond", optional=True), "sem": F.coalesce("semantic", F.lit(0.0))})
    c = c.withColumn("relevance", fusion.blend(alpha, "p_semantic", "p_graph"))
    return c.withColumn("score", F.col("relevance") + weight * F.col("p_cond"))


def conditional_topk(c: DataFrame, alpha: float, weight: float, budget: int | None, top_k: int | None = None) -> DataFrame:
    """Blend plus the optional conditional score; a node comes with its anchor."""
    _check(budget, weight=weight)
    return _fold(_anchored(_conditional(c, alpha, weight)), budget, top_k, strict=False)


def pair_fold(c: DataFrame, beta: float, budget: int | None, top_k: int | None = None, preserve_pairs: bool = True) -> DataFrame:
    """Validated anchor-endpoint pairs as atomic units next to single nodes; a validated endpoint has no unit of its own.

    Nodes count by their semantic percentile, links by their percentile among the validated ones.
    Without ``preserve_pairs`` a pair keeps its utility, but only the endpoint is taken.
    """
    _check(budget, beta=beta)
    c = c.withColumns({"sem": F.coalesce("semantic", F.lit(0.0)), "link": F.when(F.col("validated"), F.col("cond"))})
    c = c.withColumns({"node": fusion.percentile("sem"), "link": fusion.percentile("link", optional=True)})
    lists = _by_question(c, "node", "link", "validated")

    def units(x: Column) -> Column:
        a = _anchor(x)
        pair = F.coalesce(x["validated"], F.lit(False)) & a.isNotNull()
        utility = F.when(pair, a["node"] + x["node"] + beta * x["link"]).otherwise(x["node"])
        return _unit([-utility, -x["node"], x["k"]], x, a, pair & preserve_pairs)

    return _fold(lists.select("qid", F.array_sort(F.transform("xs", units)).alias("us")), budget, top_k, strict=True)


def rescue_fold(c: DataFrame, alpha: float, weight: float, rescue: float, k: int, budget: int | None, top_k: int | None = None, gate: bool = True) -> DataFrame:
    """Conditional order plus a bonus for anchored nodes that only the graph ranks among its first ``k``.

    With ``gate`` the bonus is weighed by the disagreement of the two first-``k`` sets.
    """
    _check(budget, weight=weight, rescue=rescue)
    if k <= 0:
        raise ValueError("rescue needs k of 1 or more")
    c = fusion.top_sets(_conditional(c, alpha, weight), k)
    w = W.partitionBy("qid")
    both, either = F.count_if(F.col("in_semantic") & F.col("in_graph")).over(w), F.count_if(F.col("in_semantic") | F.col("in_graph")).over(w)
    only = F.col("in_graph") & ~F.col("in_semantic") & F.col("anchor").isNotNull() & F.col("cond").isNotNull()
    bonus = F.when(only, F.col("p_graph") * F.col("p_cond") / F.greatest(F.lit(1), F.coalesce("hop", F.lit(1)))).otherwise(0.0)
    factor = rescue * (1 - both / either) if gate else F.lit(rescue)
    return _fold(_anchored(c.withColumn("score", F.round(F.col("score") + factor * bonus, 9))), budget, top_k, strict=False)


def chain_reserve(c: DataFrame, alpha: float, weight: float, budget: int | None, top_k: int | None = None) -> DataFrame:
    """First each anchor's best pair (anchors by semantic score, then by their first endpoint), then conditional order."""
    _check(budget, weight=weight)
    c = _conditional(c, alpha, weight)
    w = W.partitionBy("qid", "anchor")
    best = F.row_number().over(w.orderBy(F.desc("score"), F.desc("relevance"), "ord"))
    c = c.withColumns({"best": F.col("anchor").isNotNull() & (best == 1), "first": F.min("ord").over(w)})
    lists = _by_question(c, "score", "relevance", "sem", "best", "first")

    def units(x: Column) -> Column:
        a = _anchor(x)
        reserved = x["best"] & a.isNotNull()
        early = F.when(reserved, 0).otherwise(1)
        return _unit([early, F.when(reserved, -a["sem"]).otherwise(0.0), F.when(reserved, x["first"]).otherwise(0), -x["score"], -x["relevance"], -x["sem"], x["k"]], x, a, a.isNotNull())

    return _fold(lists.select("qid", F.array_sort(F.transform("xs", units)).alias("us")), budget, top_k, strict=False)


def entity_balanced(c: DataFrame, preferred: Column, budget: int | None, top_k: int | None = None, eta: float = 1.0, least: float = 0.0) -> DataFrame:
    """Best sentence of each preferred title first (``preferred`` is its place, else null), then by density down to ``least``."""
    _check(budget, least=least, eta=eta)
    c = c.withColumns({"preferred": preferred, "sem": F.coalesce("semantic", F.lit(0.0))}).withColumn("relevance", fusion.percentile("sem"))
    c = c.withColumn("density", fusion.density(F.col("relevance"), F.col("cost"), eta))
    best = F.row_number().over(W.partitionBy("qid", "title").orderBy(F.desc("relevance"), "ord"))
    c = c.withColumn("reserved", F.col("preferred").isNotNull() & (best == 1)).filter(F.col("reserved") | (F.col("density") >= least))
    rank = [F.desc("reserved"), F.when(F.col("reserved"), F.col("preferred")).asc_nulls_last(), F.desc("density"), F.desc("relevance"), F.desc("title"), F.desc("ord")]
    return skip_fold(singles(c, "reserved", "preferred", "density", "relevance", "title"), rank, budget, top_k)


def mass_fold(c: DataFrame, alpha: float, budget: int | None, mass: float, temperature: float, min_nodes: int, top_k: int | None = None) -> DataFrame:
    """Best first until the covered softmax mass and the least number are reached; what does not fit is passed over."""
    _check(budget)
    if not 0 < mass <= 1 or temperature <= 0:
        raise ValueError("mass outside (0, 1] or temperature not positive")
    c = fusion.with_percentiles(c).withColumn("score", fusion.blend(alpha, "p_semantic", "p_graph"))
    c = c.withColumn("share", fusion.softmax_share("score", temperature))
    x = F.struct(F.round(-F.col("score"), 9).alias("r0"), (-F.coalesce("semantic", F.lit(0.0))).alias("r1"), F.col("ord").cast("int").alias("k"), F.col("cost").cast("bigint").alias("c"), F.round("share", 9).alias("m"))
    u = c.groupBy("qid").agg(F.array_sort(F.collect_list(x)).alias("us"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0.0).alias("mass"), F.array().cast("array<int>").alias("sel"))
    going = lambda s: ~((s["mass"] >= mass) & (F.size(s["sel"]) >= min_nodes)) & (F.lit(True) if top_k is None else F.size(s["sel"]) < top_k)
    fits = lambda s, x: F.lit(True) if budget is None else s["used"] + x["c"] <= budget
    step = lambda s, x: F.when(going(s) & fits(s, x), F.struct((s["used"] + x["c"]).alias("used"), (s["mass"] + x["m"]).alias("mass"), F.concat(s["sel"], F.array(x["k"])).alias("sel"))).otherwise(s)
    out = u.select("qid", F.aggregate("us", zero, step).alias("s"))
    return out.select("qid", F.col("s.used").alias("used"), F.round("s.mass", 6).alias("mass"), F.array_join("s.sel", ",").alias("selected"))


# strategies whose scores depend on the selection: plain functions of one question's rows


def _grouped(c: DataFrame, pick: Callable[[list[dict]], list[int]]) -> DataFrame:
    """One array of candidates in ``ord`` order for each question, then plain Python over Arrow batches of questions."""
    rest = [n for n in c.columns if n not in ("qid", "ord")]
    lists = c.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*rest).alias("x")))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qids, used, selected = b.column(0).to_pylist(), [], []
            for group in b.column(1).to_pylist():
                rows = [{"ord": r["ord"], **r["x"]} for r in group]
                sel = pick(rows)
                used.append(int(sum(rows[i]["cost"] for i in sel)))
                selected.append(",".join(str(rows[i]["ord"]) for i in sel))
            yield pa.RecordBatch.from_pydict({"qid": pa.array(qids, pa.int64()), "used": pa.array(used, pa.int64()), "selected": pa.array(selected, pa.string())})

    return lists.select(F.col("qid").cast("bigint").alias("qid"), "rows").mapInArrow(run, "qid bigint, used bigint, selected string")


def _sem(r: dict) -> float:
    return r["semantic"] or 0.0


def _blend(r: dict, alpha: float) -> float:
    return alpha * _sem(r) + (1 - alpha) * (r.get("graph") or 0.0)


def percentiles(values: list[float | None]) -> list[float]:
    """Average-rank percentile among the values that are there; 0 for those that are not."""
    there = sorted(v for v in values if v is not None)
    n = len(there)
    if n == 1:
        return [0.0 if v is None else 1.0 for v in values]
    return [0.0 if v is None else (bisect_left(there, v) + bisect_right(there, v) - 1) / 2 / (n - 1) for v in values]


def _relevance(rows: list[dict], alpha: float) -> list[float]:
    s, g = percentiles([_sem(r) for r in rows]), percentiles([r.get("graph") or 0.0 for r in rows])
    return [alpha * x + (1 - alpha) * y for x, y in zip(s, g, strict=True)]


def _key(r: dict) -> tuple:
    return r["title"], r["sent_id"] if "sent_id" in r else r["ord"]


def _compact_tokens(rows: list[dict]) -> int:
    """Tokens of the rows as one compact context, a header where the title changes."""
    import regex

    lines = [f"[{r['title']}]\n{r['text']}" if i == 0 or rows[i - 1]["title"] != r["title"] else r["text"] for i, r in enumerate(rows)]
    return len(regex.findall(r"\p{L}+|\p{N}+|[^ \t-\r\p{L}\p{N}]", "\n".join(lines)))


class Selection:
    """What one question's greedy selection has taken, and what a further step would cost."""

    def __init__(self, rows: list[dict], budget: int | None, top_k: int | None, serialized: bool = False):
        self.rows, self.budget, self.top_k, self.serialized = rows, budget, top_k, serialized
        self.sel: list[int] = []
        self.used = 0
        self.titles: set = set()
        self.before = 0

    def new(self, keys: Iterable[int]) -> list[int]:
        return [k for k in keys if k not in self.sel]

    def fits(self, new: list[int]) -> bool:
        return bool(new) and (self.top_k is None or len(self.sel) + len(new) <= self.top_k) and (self.budget is None or self.used + self.raw(new) <= self.budget)

    def raw(self, new: list[int]) -> int:
        return sum(self.rows[k]["cost"] for k in new)

    def cost(self, new: list[int]) -> int:
        """For ranking; the budget always counts the sentences' own tokens."""
        if not self.serialized:
            return self.raw(new)
        return max(1, _compact_tokens([self.rows[k] for k in [*self.sel, *new]]) - self.before)

    def add(self, new: list[int]) -> None:
        self.used += self.raw(new)
        self.sel += new
        self.titles |= {self.rows[k]["title"] for k in new}
        if self.serialized:
            self.before = _compact_tokens([self.rows[k] for k in self.sel])


def mmr_pick(rows: list[dict], budget: int | None, top_k: int | None = None, alpha: float = 1.0, trade: float = 0.7) -> list[int]:
    """Relevance against the largest cosine to what is selected; stops at the first that overflows."""
    import numpy as np

    v = [None if r.get("embedding") is None else np.asarray(r["embedding"], float) for r in rows]
    relevance = [_blend(r, alpha) for r in rows]
    left, sel, used, near = list(range(len(rows))), [], 0, [None] * len(rows)
    while left and (top_k is None or len(sel) < top_k):
        score = lambda i: relevance[i] if not sel or v[i] is None else trade * relevance[i] - (1 - trade) * (near[i] or 0.0)
        best = max(left, key=lambda i: (round(score(i), 12), -i))
        if budget is not None and used + rows[best]["cost"] > budget:
            break
        left.remove(best)
        sel.append(best)
        used += rows[best]["cost"]
        if v[best] is not None:
            for i in left:
                if v[i] is not None:
                    x = float(v[i] @ v[best])
                    near[i] = x if near[i] is None else max(near[i], x)
    return sel


def mmr(c: DataFrame, budget: int | None, top_k: int | None = None, alpha: float = 1.0) -> DataFrame:
    return _grouped(c, lambda rows: mmr_pick(rows, budget, top_k, alpha))


def interleave_pick(rows: list[dict], budget: int | None, top_k: int | None = None) -> list[int]:
    """Turns between the semantic and the graph order; one passed over for its cost is not tried again."""
    by = [sorted(range(len(rows)), key=lambda i: (-_sem(rows[i]), i)), sorted(range(len(rows)), key=lambda i: (-(rows[i].get("graph") or 0.0), -_sem(rows[i]), i))]
    at, turn, seen, sel, used = [0, 0], 0, set(), [], 0
    while len(seen) < len(rows) and (top_k is None or len(sel) < top_k):
        while at[turn] < len(rows) and by[turn][at[turn]] in seen:
            at[turn] += 1
        if at[turn] < len(rows):
            i = by[turn][at[turn]]
            seen.add(i)
            if budget is None or used + rows[i]["cost"] <= budget:
                sel.append(i)
                used += rows[i]["cost"]
        turn = 1 - turn
    return sel


def interleave(c: DataFrame, budget: int | None, top_k: int | None = None) -> DataFrame:
    return _grouped(c, lambda rows: interleave_pick(rows, budget, top_k))


def coverage_pick(rows: list[dict], budget: int | None, bonus: float, top_k: int | None = None, alpha: float = 1.0) -> list[int]:
    """Greedy with a bonus for titles not yet selected; of equal ones by relevance, semantic score and order."""
    relevance, at = _relevance(rows, alpha), Selection(rows, budget, top_k)
    while True:
        fitting = [i for i in range(len(rows)) if i not in at.sel and at.fits([i])]
        if not fitting:
            return at.sel
        at.add([max(fitting, key=lambda i: (relevance[i] + bonus * (rows[i]["title"] not in at.titles), relevance[i], _sem(rows[i]), -i))])


def coverage(c: DataFrame, budget: int | None, bonus: float = 0.0, top_k: int | None = None, alpha: float = 1.0) -> DataFrame:
    """Without a bonus the order is fixed, so the fold stays inside the JVM."""
    _check(budget, bonus=bonus)
    if bonus:
        return _grouped(c, lambda rows: coverage_pick(rows, budget, bonus, top_k, alpha))
    c = fusion.with_percentiles(c.withColumn("graph", F.coalesce("graph", F.lit(0.0)))).withColumn("relevance", fusion.blend(alpha, "p_semantic", "p_graph"))
    return skip_fold(singles(c, "relevance", "semantic"), [F.desc("relevance"), F.desc("semantic"), F.col("ord")], budget, top_k)


def _pairs(rows: list[dict]) -> dict[int, int]:
    """Anchor of each validated endpoint whose anchor is a candidate."""
    place = {r["ord"]: i for i, r in enumerate(rows)}
    return {i: place[r["anchor"]] for i, r in enumerate(rows) if r.get("validated") and r.get("anchor") in place}


def _links(rows: list[dict], *columns: str) -> list[float]:
    """Percentile of each validated endpoint's first value that is there."""
    value = lambda r: next((r[c] for c in columns if r.get(c) is not None), None)
    return percentiles([value(r) if r.get("validated") else None for r in rows])


def marginal_pick(rows: list[dict], budget: int | None, beta: float, bonus: float, eta: float, least: float, top_k: int | None = None) -> list[int]:
    """Rounds of the unit with the best new utility for its new cost; ends below ``least``."""
    node, link, anchors, at = percentiles([_sem(r) for r in rows]), _links(rows, "gain", "cond"), _pairs(rows), Selection(rows, budget, top_k)
    units = [((anchors[i], i), beta * link[i]) if i in anchors else ((i,), 0.0) for i in range(len(rows))]
    while True:
        best = None
        for keys, extra in units:
            new = at.new(keys)
            if not at.fits(new):
                continue
            utility = sum(node[k] for k in new) + extra + bonus * len({rows[k]["title"] for k in new} - at.titles)
            rank = (round(utility / max(1, at.raw(new)) ** eta, 12), round(utility, 12), node[keys[-1]], tuple(_key(rows[k]) for k in new))
            if best is None or rank > best[0]:
                best = rank, new
        if best is None or best[0][0] < least:
            return at.sel
        at.add(best[1])


def marginal_pair(c: DataFrame, budget: int | None, beta: float = 0.3, bonus: float = 0.0, eta: float = 1.0, least: float = 0.0, top_k: int | None = None) -> DataFrame:
    _check(budget, beta=beta, bonus=bonus, eta=eta, least=least)
    return _grouped(c, lambda rows: marginal_pick(rows, budget, beta, bonus, eta, least, top_k))


def chain_pick(rows: list[dict], budget: int | None, chains: int, fallback: int, extra: int = 0, beta: float = 0.3, eta: float = 1.0, least: float = 0.0, preferred: Sequence = (), top_k: int | None = None, serialized: bool = False) -> list[int]:
    """Validated pairs of distinct anchor titles, preferred ones first, until ``chains`` are complete.

    Where they can't be completed, single nodes up to ``fallback``, unseen titles first; then at most
    ``extra`` more pairs that reach ``least``.
    """
    node, link, anchors, at = percentiles([_sem(r) for r in rows]), _links(rows, "gain"), _pairs(rows), Selection(rows, budget, top_k, serialized)
    units = [(a, i) for i, a in anchors.items()]
    covered: set = set()

    def best_pair(title: object = None) -> tuple | None:
        ranked = []
        for u, (a, i) in enumerate(units):
            of = rows[a]["title"]
            new = at.new((a, i))
            if of in covered or (title is not None and of != title) or not at.fits(new):
                continue
            utility = sum(node[k] for k in new) + beta * link[i]
            ranked.append((round(utility / max(1, at.cost(new)) ** eta, 12), round(utility, 12), node[i], (_key(rows[a]), _key(rows[i])), u))
        return max(ranked, default=None)

    def take(found: tuple) -> None:
        a, i = units[found[4]]
        at.add(at.new((a, i)))
        covered.add(rows[a]["title"])

    for title in list(preferred or ())[:chains]:
        if found := best_pair(title):
            take(found)
    while len(covered) < chains and (found := best_pair()):
        take(found)
    if len(covered) < chains:
        while len(at.sel) < fallback:
            able = [i for i in range(len(rows)) if i not in at.sel and at.fits([i])]
            if not able:
                break
            at.add([max(able, key=lambda i: (rows[i]["title"] not in at.titles, round(node[i] / max(1, at.cost([i])) ** eta, 12), node[i], _key(rows[i])))])
    for _ in range(extra):
        found = best_pair()
        if found is None or found[0] < least:
            break
        take(found)
    return at.sel


def chain_witness(c: DataFrame, budget: int | None, chains: int = 1, fallback: int = 2, extra: int = 0, beta: float = 0.3, eta: float = 1.0, least: float = 0.0, top_k: int | None = None, serialized: bool = False) -> DataFrame:
    """A column ``preferred`` (array of titles) names those that come first; ``serialized`` ranks by the tokens of the compact context."""
    _check(budget, beta=beta, eta=eta, extra=extra)
    if chains <= 0 or fallback <= 0:
        raise ValueError("chains and fallback must be positive")
    return _grouped(c, lambda rows: chain_pick(rows, budget, chains, fallback, extra, beta, eta, least, rows[0].get("preferred") or (), top_k, serialized))


def entity_pick(rows: list[dict], budget: int | None, titles: int, preferred: Sequence, extra: int = 0, eta: float = 1.0, least: float = 0.0, top_k: int | None = None, serialized: bool = False) -> list[int]:
    """Best sentence of the first preferred titles, then of others until ``titles`` are covered, then at most ``extra`` by density."""
    rel, at = percentiles([_sem(r) for r in rows]), Selection(rows, budget, top_k, serialized)
    able = lambda: [i for i in range(len(rows)) if i not in at.sel and at.fits([i])]
    for title in list(preferred or ())[:titles]:
        if found := [i for i in able() if rows[i]["title"] == title]:
            at.add([max(found, key=lambda i: (rel[i], -i))])
    while len(at.titles) < titles and (found := [i for i in able() if rows[i]["title"] not in at.titles]):
        at.add([max(found, key=lambda i: (rel[i], _sem(rows[i]), _key(rows[i])))])
    for _ in range(extra):
        best = max(((round(rel[i] / max(1, at.cost([i])) ** eta, 12), rel[i], _key(rows[i]), i) for i in able()), default=None)
        if best is None or best[0] < least:
            break
        at.add([best[3]])
    return at.sel


def entity_witness(c: DataFrame, budget: int | None, titles: int = 2, extra: int = 0, eta: float = 1.0, least: float = 0.0, top_k: int | None = None, serialized: bool = False) -> DataFrame:
    """A column ``preferred`` (array of titles) names those that come first."""
    _check(budget, eta=eta, extra=extra)
    if titles <= 0:
        raise ValueError("titles must be positive")
    return _grouped(c, lambda rows: entity_pick(rows, budget, titles, rows[0].get("preferred") or (), extra, eta, least, top_k, serialized))


def closed_mass_pick(rows: list[dict], alpha: float, budget: int | None, mass: float, temperature: float, min_nodes: int, top_k: int | None = None) -> list[int]:
    """``mass_fold`` in which a node brings the pool's nodes of its path from the seed (``path`` and ``node_ord``)."""
    score, at = _relevance(rows, alpha), Selection(rows, budget, None)
    place = {r["node_ord"]: i for i, r in enumerate(rows)}
    weight = [math.exp((x - max(score)) / temperature) for x in score]
    covered, whole = 0.0, sum(weight)
    for i in sorted(range(len(rows)), key=lambda i: (-score[i], -_sem(rows[i]), i)):
        new = at.new([place[n] for n in (rows[i].get("path") or [rows[i]["node_ord"]]) if n in place])
        if budget is not None and at.used + at.raw(new) > budget:
            continue
        at.add(new)
        covered += weight[i]
        if (len(at.sel) >= min_nodes and covered / whole >= mass) or (top_k is not None and len(at.sel) >= top_k):
            break
    return at.sel


def closed_mass(c: DataFrame, alpha: float, budget: int | None, mass: float = 0.65, temperature: float = 0.15, min_nodes: int = 4, top_k: int | None = None) -> DataFrame:
    if not 0 < mass <= 1 or temperature <= 0:
        raise ValueError("mass outside (0, 1] or temperature not positive")
    return _grouped(c, lambda rows: closed_mass_pick(rows, alpha, budget, mass, temperature, min_nodes, top_k))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "topk": topk, "normalized_topk": normalized_topk, "rrf": rrf, "random": random, "threshold": threshold, "mmr": mmr, "interleave": interleave,
    "adaptive_mass": mass_fold, "closed_mass": closed_mass, "coverage_topk": coverage, "conditional_topk": conditional_topk, "pair_fold": pair_fold, "marginal_pair": marginal_pair,
    "entity_balanced_topk": entity_balanced, "entity_witness": entity_witness, "chain_witness": chain_witness, "residual_rescue": rescue_fold, "chain_reserve": chain_reserve,
}


def select(strategy: str, c: DataFrame, **params: object) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return STRATEGIES[strategy](c, **params)
