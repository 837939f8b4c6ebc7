"""Scalar text functions as column expressions; all stay inside the JVM but ``fold_accents`` and ``project_quote``."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values.
HONORIFICS = r"king|queen|prince|princess|dr\.?|sir"
ALIAS_STOPWORDS = ["a", "an", "and", "director", "film", "of", "saint", "st", "the", "king", "queen", "prince", "princess", "sultan"]
NO_OVERLAP_ANSWERS = ["yes", "no", "noanswer"]
PUNCTUATION = r"[!-/:-@\[-`{-~]"
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
ENTITY = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*"
COMPARISON = r"(?i)\b(same|both|earlier|later|older|younger|first|more recently|higher|lower|larger|smaller|more|less|share)\b"
RELATION = r"(?i)\b(director|author|writer|creator|producer|founder|owner|leader|father|mother|parent|grandfather|grandmother|son|daughter|child|wife|husband|spouse|brother|sister|coach|manager|president)\b"
RELATION_PLURAL = r"(?i)\b(directors?|authors?|writers?|creators?|producers?|founders?|owners?|leaders?|fathers?|mothers?|parents?|grandfathers?|grandmothers?|sons?|daughters?|children|child|wives|wife|husbands?|spouses?|brothers?|sisters?|coaches|coach|managers?|presidents?)\b"


def normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))


def count_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN)).cast("bigint")


@F.udf(StringType(), useArrow=True)
def fold(text: str | None) -> str | None:
    """Case folded and compatibility decomposed, without combining marks."""
    return None if text is None else _fold(text)


def without_suffix(c: Column) -> Column:
    """Without a bracketed suffix."""
    return F.regexp_replace(c, r"(?U)\s*\([^()]*\)\s*$", "")


def canonical_key(c: Column) -> Column:
    """Entity key: letters and digits only, without a bracketed suffix and a leading honorific."""
    return F.regexp_replace(fold(F.regexp_replace(without_suffix(c), rf"(?iU)^\s*(?:{HONORIFICS})\s+", "")), r"[^\p{L}\p{N}]", "")


def alias_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(fold(without_suffix(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, ALIAS_STOPWORDS)))


def alias(c: Column) -> Column:
    """What ``alias_same`` compares; made once for each row, before any join."""
    return F.struct(canonical_key(c).alias("key"), alias_tokens(c).alias("tokens"))


def _shared(a: Column, b: Column) -> Column:
    both = F.array_intersect(a, b)
    return (F.size(both) >= 2) | F.exists(both, lambda x: F.length(x) >= 6)


def alias_same(a: Column, b: Column) -> Column:
    """Equal keys, two shared alias tokens, or one of six letters (of ``alias`` structs)."""
    return (a["key"] == b["key"]) | _shared(a["tokens"], b["tokens"])


def alias_match(a: Column, b: Column) -> Column:
    return alias_same(alias(a), alias(b))


def mention(c: Column) -> Column:
    """What ``mentions`` compares, of a text or a title."""
    return F.struct(normalize(c).alias("norm"), canonical_key(c).alias("key"), alias_tokens(c).alias("tokens"))


def mentions(text: Column, title: Column) -> Column:
    """Whether a text names a title: as it stands, as a key of five letters or more, or by shared alias tokens (of ``mention`` structs)."""
    return text["norm"].contains(title["norm"]) | ((F.length(title["key"]) >= 5) & text["key"].contains(title["key"])) | _shared(text["tokens"], title["tokens"])


def mentioned_titles(question: Column, titles: Column) -> Column:
    """Titles whose normal form stands in the question, by place, then by title (``titles`` is an array)."""
    q = normalize_title(question)
    found = F.transform(F.array_distinct(titles), lambda t: F.struct(F.instr(q, normalize_title(t)).alias("at"), normalize_title(t).alias("norm"), t.alias("title")))
    kept = F.filter(found, lambda x: (x["at"] > 0) & (x["norm"] != ""))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["at"], x["title"]))), lambda x: x["title"])


def entities(c: Column) -> Column:
    """Default extractor: distinct normalised runs of capitalised words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)), normalize))


def route(c: Column, relation: str = RELATION) -> Column:
    comparing, related = c.rlike(COMPARISON), c.rlike(relation)
    return F.when(comparing & related, "bridge_comparison").when(comparing, "direct_comparison").otherwise("chained_reasoning")


def normalize_answer(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(c), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?<![\p{L}\p{M}\p{N}_])(?:a|an|the)(?![\p{L}\p{M}\p{N}_])", " "), r"\s+", " "))


def answer_scores(prediction: Column, gold: Column) -> Column:
    """Struct ``em, f1, prec, recall`` of normalised answers; tokens count as often as they occur in both."""
    p, g = normalize_answer(prediction), normalize_answer(gold)
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    pw, gw = words(p), words(g)
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(pw, gw), F.lit(0), lambda s, x: s + F.least(times(pw, x), times(gw, x)))
    special = (p.isin(NO_OVERLAP_ANSWERS) | g.isin(NO_OVERLAP_ANSWERS)) & (p != g)
    zero = special | (shared == 0)
    prec, recall = shared / F.size(pw), shared / F.size(gw)
    f1 = 2 * prec * recall / (prec + recall)
    return F.struct((p == g).cast("double").alias("em"), *[F.when(zero, 0.0).otherwise(v).alias(n) for n, v in (("f1", f1), ("prec", prec), ("recall", recall))])


def calibrate(c: Column, temperature: float = 1.0) -> Column:
    p = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-F.log(p / (1 - p)) / temperature))


def claim_variables(*terms: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*terms), lambda x: x.startswith("?")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("\0", F.lit("v2"), *parts))


def usd(prompt: Column, output: Column) -> Column:
    return (prompt * 0.15 + output * 0.60) / 1e6


def _fold(text: str) -> str:
    if text.isascii():
        return text.casefold()
    text = unicodedata.normalize("NFKD", text.casefold())
    for c in set(text):
        if c >= "\u0300" and unicodedata.combining(c):
            text = text.replace(c, "")
    return text


def _bare(text: str) -> str:
    return re.sub(r"\s*\([^()]*\)\s*$", "", text)


def python_alias(text: str) -> tuple[str, set[str]]:
    """``alias`` for code that already runs in Python."""
    key = _fold(re.sub(rf"^\s*(?:{HONORIFICS})\s+", "", _bare(text), flags=re.IGNORECASE))
    return "".join(c for c in key if c.isalnum()), set(re.findall("[a-z0-9]+", _fold(_bare(text)))) - set(ALIAS_STOPWORDS)


_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")  # Java's (?U)\s
_SUFFIX = re.compile(rf"(?:{_SPACES.pattern})?\([^()]*\)(?:{_SPACES.pattern})?$")
_TITLED = re.compile(rf"^(?:{_SPACES.pattern})?(?:{HONORIFICS}){_SPACES.pattern}", re.IGNORECASE)


_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
_SIGNS = bytes(c for c in range(128) if c not in _ALNUM + _ALNUM.upper())
_WORDS = bytes(c if c in _ALNUM else 32 for c in range(256))


def python_mention(text: str) -> tuple[str, str, list[str]]:
    """``mention`` for code that already runs in Python: normal form, key and alias tokens."""
    bare = _SUFFIX.sub("", text) if ")" in text else text
    folded = _fold(bare)
    named = _TITLED.sub("", bare)
    raw = folded.encode()
    key = (raw if named == bare else _fold(named).encode()).translate(None, _SIGNS).decode()
    if not key.isascii():
        for c in set(key):
            if c > "\x7f" and unicodedata.category(c)[0] not in "LN":
                key = key.replace(c, "")
    norm = text.lower()
    # str.split also parts at four control characters, which Java doesn't
    norm = _SPACES.sub(" ", norm).strip(" ") if any(c in norm for c in "\x1c\x1d\x1e\x1f") else " ".join(norm.split())
    return norm, key, list(set(raw.translate(_WORDS).decode().split()).difference(ALIAS_STOPWORDS))


def python_alias_same(a: str, b: str) -> bool:
    (key, tokens), (other, others) = python_alias(a), python_alias(b)
    both = tokens & others
    return key == other or len(both) >= 2 or any(len(t) >= 6 for t in both)


@F.udf(ArrayType(StringType()), useArrow=True)
def titled_variables(bindings: dict[str, str] | None, titles: list[str] | None) -> list[str]:
    """Variables whose value is an alias of one of the titles."""
    return sorted(k for k, v in (bindings or {}).items() if v is not None and any(t is not None and python_alias_same(v, t) for t in titles or ()))


def _key(word: str) -> str:
    return "".join(c for c in _fold(word) if c.isalnum())


@F.udf(StringType(), useArrow=True)
def project_quote(source: str | None, quote: str | None, values: list[str] | None = None) -> str | None:
    """The stretch of ``source`` that spans the quote's words and those of each value, each found in order from the left; null if one is absent."""
    places = [(_key(m.group()), m.start(), m.end()) for m in re.finditer(r"\w+", source or "")]
    if not places or not (quote or "").strip():
        return None
    spans = []
    for part in [quote, *(values or [])]:
        at, words = 0, [k for k in (_key(w) for w in re.findall(r"\w+", part or "")) if k]
        if not words:
            return None
        for w in words:
            while at < len(places) and places[at][0] != w:
                at += 1
            if at == len(places):
                return None
            spans.append(places[at])
            at += 1
    return source[min(p[1] for p in spans) : max(p[2] for p in spans)]
