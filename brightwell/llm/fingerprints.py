"""Document fingerprints (operator 2) by winnowing, in DataFrame functions only.

Every ``GRAM`` neighbouring words of a text give a rolling hash: the polynomial of their word hashes
with base ``BASE`` modulo ``PRIME``.  Of every ``WINDOW`` neighbouring hashes the smallest is chosen,
of equal ones the rightmost, with its position.  Texts that share a run of ``GRAM + WINDOW - 1`` words
therefore share a chosen hash.  The likeness of two fingerprints is the Jaccard similarity of their
hash sets.

The hash that rolls on, ``(h - w[i] * BASE**4) * BASE + w[i + 5]``, needs its left neighbour, which
DataFrame functions have only by a fold that copies its result at every step.  So the same numbers
are made by doubling: hashes of two words from those of one, of four from two, of five from four and
one, each a pass over the array.  No product exceeds 63 bits, as ``BASE**2`` has 26 and ``PRIME`` 35.

A hash and its position are packed into one 64-bit number (hash above, mirrored position below), so
that the smallest number is the smallest hash and, of equal hashes, the rightmost; sliding minima
take log2(WINDOW) passes of element-wise ``least``.  28 bits hold any position: an array of 64-bit
numbers has at most 2**28 entries in Spark, as it has at most 2**31 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

GRAM = 5
#: A power of two.
WINDOW = 4
POSITION_BITS = 28
#: The largest prime of 35 bits, and the base of the polynomial.
PRIME, BASE = 2**35 - 31, 8009
#: Rows of one range of ids, and the most ranges; their bounds are the only thing the driver gets.
RANGE_ROWS, MAX_RANGES = 1000, 65_536
_LAST = (1 << POSITION_BITS) - 1


def word_hashes(text: Column) -> Column:
    """Hashes below ``PRIME`` of the lower-cased words."""
    return F.transform(F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))


def rolled(h: Column, step: int, base: int, other: Column) -> Column:
    """``h[i] * base + other[i + step]`` modulo ``PRIME`` for each place; null beyond the end."""
    return F.transform(h, lambda x, i: (x * F.lit(base) + F.get(other, i + step)) % F.lit(PRIME))


def packed(h: Column, words: Column) -> Column:
    """One number for each gram of the gram hashes ``h``; fewer words than a gram are one gram, none is none."""
    code = lambda g, i: F.shiftleft(g, POSITION_BITS).bitwiseOR(F.lit(_LAST).cast("bigint") - i)
    n = F.size(words) - GRAM + 1
    whole = F.array(code(F.aggregate(words, F.lit(0).cast("bigint"), lambda a, x: (a * F.lit(BASE) + x) % F.lit(PRIME)), F.lit(0)))
    each = F.transform(F.slice(h, F.lit(1), F.greatest(n, F.lit(0))), code)
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(n < 1, whole).otherwise(each)


def chosen(p: Column, step: int) -> Column:
    """Minima of twice as many neighbours, from minima of ``step``."""
    return F.transform(p, lambda x, i: F.least(x, F.get(p, i + step)))


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the chosen packed hashes in text order, each once.

    The stages are columns of their own, as a column used twice is not computed twice.
    """
    words = f"{out}_w"
    df = df.withColumn(words, word_hashes(F.col(text)))
    df = df.withColumn(out, rolled(F.col(words), 1, BASE, F.col(words)))
    df = df.withColumn(out, rolled(F.col(out), 2, BASE * BASE, F.col(out)))
    df = df.withColumn(out, rolled(F.col(out), 4, BASE, F.col(words)))
    df = df.withColumn(out, packed(F.col(out), F.col(words))).drop(words)
    df = df.withColumn(f"{out}_n", F.greatest(F.size(out) - WINDOW + 1, F.least(F.lit(1), F.size(out))))
    step = 1
    while step < WINDOW:
        df = df.withColumn(out, chosen(F.col(out), step))
        step *= 2
    return df.withColumn(out, F.array_distinct(F.slice(out, F.lit(1), F.col(f"{out}_n")))).drop(f"{out}_n")


def positions(fp: Column) -> Column:
    """(hash, position of the gram's first word) of each chosen gram."""
    return F.transform(fp, lambda v: F.struct(F.shiftright(v, POSITION_BITS).alias("hash"), (F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST).cast("bigint"))).alias("position")))


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda v: F.shiftright(v, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; 1 for two empty ones."""
    common_ = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common_
    return F.when(union == 0, 1.0).otherwise(common_ / union)


def digest(fp: Column) -> Column:
    """The fingerprint as a string: SHA-256 of its hashes and positions in order."""
    return F.sha2(F.array_join(F.transform(fp, lambda v: F.hex(v)), ","), 256)


def _constant(values: list, kind: str = "L") -> Column:
    """An array, or an array of arrays, as one constant of the plan."""
    say = lambda v: f"array({','.join(map(say, v))})" if isinstance(v, list) else f"{v}{kind}"
    return F.expr(say(values))


def ranges(docs: DataFrame) -> list[int]:
    """Bounds of ranges of doc_id with about as many rows, the smallest id first; all are ids that occur."""
    n = docs.count()
    if not n:
        return []
    k = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    parts = ",".join(f"{i / k!r}D" for i in range(k))
    found = docs.agg(F.expr(f"percentile_approx(doc_id, array({parts}), {10 * k})"), F.min("doc_id")).first()
    return [] if found[1] is None else sorted({found[1], *found[0]})


def _blocks(bounds: list[int]) -> list[list[int]]:
    side = max(1, int(len(bounds) ** 0.5))
    return [bounds[i : i + side] for i in range(0, len(bounds), side)]


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of the range, in two steps of a root each."""
    if not bounds:
        return F.lit(0)
    blocks = _blocks(bounds)
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= doc_id))
    block = F.greatest(below(_constant([b[0] for b in blocks])) - 1, F.lit(0))
    inside = below(F.get(_constant(blocks), block))
    return F.when(doc_id.isNull(), 0).otherwise(F.greatest(block * len(blocks[0]) + inside - 1, F.lit(0)))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text)`` with ``part`` and ``place``, such that the next row of an ascending order follows in its part.

    Texts are dealt by ranges of doc_id; the first row of a range is also put at the end of the
    range before (``tail``), and that of the first range at the end of the last.
    """
    bounds = ranges(docs)
    last = max(0, len(bounds) - 1)
    part = range_of(F.col("doc_id"), bounds)
    here = F.struct(part.cast("int").alias("part"), F.lit(False).alias("tail"))
    before = F.struct(F.when(part == 0, last).otherwise(part - 1).cast("int").alias("part"), F.lit(True).alias("tail"))
    blocks = _blocks(bounds)
    first = F.array_contains(F.get(_constant(blocks), F.floor(part / len(blocks[0])).cast("int")), F.col("doc_id")) if bounds else F.lit(False)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.when(F.coalesce(first, F.lit(False)), F.array(here, before)).otherwise(F.array(here))).alias("p"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), "p.part", "p.tail")


def compare(docs: DataFrame) -> DataFrame:
    """The contract's columns with the fingerprints themselves as ``grams`` and ``edited_grams``.

    A null text is empty.  Rows with the same doc_id follow each other by a hash of their texts;
    null ids come first and are followed like others (the last row by the first with an id).  A
    single row is followed by itself.  An empty table gives an empty result; further columns are
    ignored.
    """
    order = W.partitionBy("part").orderBy("tail", F.asc_nulls_first("doc_id"), "tie")
    rows = with_next(docs.select("doc_id", "text"))
    rows = rows.withColumn("after", F.coalesce(F.lead("text").over(order), "text"))
    n = F.char_length("text")
    rows = rows.withColumns({"n_chars": n.cast("bigint"), "cut": F.floor(n / 4).cast("int")})
    edited = F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.col("after").substr(F.lit(1), F.col("cut")))
    rows = rows.select("doc_id", "text", "tie", "part", "tail", "n_chars", edited.alias("edited"))
    rows = fingerprint(rows, "text", "grams").drop("text")
    rows = fingerprint(rows, "edited", "edited_grams")
    rows = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "own": hashes(F.col("grams")), "changed": hashes(F.col("edited_grams"))}).drop("edited")
    rows = rows.withColumn("next_own", F.coalesce(F.lead("own").over(order), "own"))
    rows = rows.filter("not tail")
    return rows.select("doc_id", "n_chars", "edited_sha256", "grams", "edited_grams", likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", "edited_sha256", digest(F.col("grams")).alias("fingerprint"), digest(F.col("edited_grams")).alias("edited_fingerprint"), "near_edited", "near_next", F.size("grams").alias("n_grams"))
