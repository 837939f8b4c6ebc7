"""License scans (operator 1): positional rare-token index, in DataFrame functions only.

Each licence notice (template) enters the index with its words of highest inverse document
frequency among the templates, and their offsets.  A text's words are looked up in the index; each
hit votes for (template, text position - template offset), so hits of one notice agree on that
difference.  A place with enough agreeing words is opened and must contain the template's mandatory
key phrases.  Rows are independent: one pass, no shuffle, no broadcast beyond the fixed index.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Runs of digits, letters and characters beyond ASCII, before and after lowering A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: phrase and label of the base rule
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Label, words of the notice, mandatory key phrases (TRIGGER finds a word of one of them).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["licensed under cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["licensed under cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["licensed under cc by 4 0"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal license", ["cc0 1 0 universal license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "binary forms"]),
    ("unlicense", "this is free and unencumbered software released into the public domain unlicense", ["unencumbered software", "unlicense"]),
    ("proprietary", "all rights reserved no license is granted", ["all rights reserved", "no license is granted"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice", "substantial portions"]),
    ("apache-2.0", "you may not use this file except in compliance with the license", ["compliance with the license"]),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ["under the license", "as is basis"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software", "gnu general public license"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products", "prior written permission"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["permission is granted to anyone"]),
]
TRIGGER = r"(?i)licen[sc]e|permission|redistribution"
#: Words of a template in the index, the rarest first, and the share of them that must agree.
ANCHORS, AGREE = 6, 0.6
SLACK = 2


def index() -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Postings (word, template, offset), and for each template its anchors and those needed.

    Only texts in which TRIGGER finds a word are split, so a template without one would never match: it is refused.
    """
    for label, _, phrases in TEMPLATES:
        if not any(re.search(TRIGGER, k) for k in phrases):
            raise ValueError(f"no key phrase of {label} has a word that starts a scan")
    split = [t.split() for _, t, _ in TEMPLATES]
    df = Counter(w for ws in split for w in set(ws))
    postings, sizes = [], []
    for t, ws in enumerate(split):
        once = [w for w in dict.fromkeys(ws) if ws.count(w) == 1]
        best = sorted(once, key=lambda w: (-math.log((1 + len(split)) / df[w]), ws.index(w)))[:ANCHORS]
        postings += [(w, t, ws.index(w)) for w in best]
        sizes.append((len(best), max(2, math.ceil(AGREE * len(best)))))
    return postings, sizes


def _padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def scan(docs: DataFrame) -> DataFrame:
    """Contract columns and ``matches``: (label, first word, agreeing share) of each verified place.

    Null and empty texts have no word, no label and score 0.  Repeated rows repeat, a null doc_id is
    passed on, an empty table gives an empty result, further columns are ignored.
    """
    postings, sizes = index()
    of_word: dict[str, list] = {}
    for w, t, off in postings:
        of_word.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(off).alias("off")))
    table = F.create_map(*[x for w, ps in of_word.items() for x in (F.lit(w), F.array(*ps))])
    needed = F.array(*[F.lit(n) for _, n in sizes])
    anchors = F.array(*[F.lit(float(a)) for a, _ in sizes])
    length = F.array(*[F.lit(len(t.split())) for _, t, _ in TEMPLATES])
    labels = F.array(*[F.lit(x) for x, _, _ in TEMPLATES])
    keys = F.array(*[F.array(*[F.lit(f" {k} ") for k in ks]) for _, _, ks in TEMPLATES])

    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    base = base.select("doc_id", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("bigint").alias("n_words"), F.when(F.col("text").rlike(TRIGGER), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("w"))

    # base rule: starts of each phrase; get() is null beyond the end
    def starts(phrase: str) -> Column:
        parts = phrase.split()
        def at(i: Column) -> Column:
            ok = F.get("w", i) == parts[0]
            for k, p in enumerate(parts[1:], 1):
                ok = ok & F.coalesce(F.get("w", i + k) == p, F.lit(False))
            return ok
        every = F.transform("w", lambda x, i: i)
        return F.filter(every, at)

    places = base.withColumns({f"s_{label}": starts(p) for p, label in BASE})
    hits = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h.x.isin(list(of_word)))
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(table, h.x), lambda p: F.struct(p.t.alias("t"), (h.i - p.off).alias("d")))))
    places = places.withColumn("votes", F.array_sort(votes))
    run = "struct<t:int,d:int,n:int>"
    zero = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("d"), F.lit(0).alias("n"), F.array().cast(f"array<{run}>").alias("out"))
    ended = lambda a: F.when(a.n >= 2, F.concat(a.out, F.array(F.struct(a.t.alias("t"), a.d.alias("d"), a.n.alias("n"))))).otherwise(a.out)
    merge = lambda a, v: F.when((a.t == v.t) & (a.d == v.d), F.struct(a.t.alias("t"), a.d.alias("d"), (a.n + 1).alias("n"), a.out.alias("out"))).otherwise(F.struct(v.t.alias("t"), v.d.alias("d"), F.lit(1).alias("n"), ended(a).alias("out")))
    places = places.withColumn("runs", F.aggregate("votes", zero, merge, ended))
    window = lambda r: _padded(F.slice("w", F.greatest(F.lit(1), r.d + 1 - SLACK), F.get(length, r.t) + 2 * SLACK))
    good = F.filter("runs", lambda r: (r.n >= F.get(needed, r.t)) & F.forall(F.get(keys, r.t), lambda k: window(r).contains(k)))
    places = places.withColumn("matches", F.transform(good, lambda r: F.struct(F.get(labels, r.t).alias("label"), r.d.alias("word"), (r.n / F.get(anchors, r.t)).alias("share"))))
    spots = F.concat(*[f"s_{label}" for _, label in BASE])
    named = F.filter(F.array(*[F.when(F.size(f"s_{label}") > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull())
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    n_base = F.size(spots).cast("bigint")
    return places.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(spots).cast("bigint").alias("first_word"),
        F.array_max(spots).cast("bigint").alias("last_word"),
        join(named).alias("base_labels"),
        join(F.concat(named, F.transform("matches", lambda m: m.label))).alias("labels"),
        F.greatest(F.when(n_base > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda m: m.share)), F.lit(0.0))).alias("score"),
        "matches",
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir)).drop("matches")


def oracle() -> str:
    postings, sizes = index()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    posts = ", ".join(f"({quote(w)}, {t}, {off})" for w, t, off in postings)
    rows = ", ".join(f"({t}, {quote(label)}, {len(text.split())}, {a}, {n}, [{', '.join(quote(' ' + k + ' ') for k in ks)}])" for t, ((label, text, ks), (a, n)) in enumerate(zip(TEMPLATES, sizes, strict=True)))
    base = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i AS spot FROM w, unnest(range(len(ws))) u(i) WHERE " + " AND ".join(f"ws[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split())) for phrase, label in BASE
    )
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
post(word, t, off) AS (VALUES {posts}), tpl(t, label, len, anchors, needed, keys) AS (VALUES {rows}),
base AS ({base}),
hits AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
runs AS (SELECT doc_id, t, i - off AS d, count(*) AS n FROM hits JOIN post USING (word) GROUP BY ALL),
good AS (SELECT r.doc_id, label, n / anchors::DOUBLE AS share FROM runs r JOIN tpl USING (t) JOIN w USING (doc_id) WHERE n >= needed
  AND len(list_filter(keys, lambda k: NOT contains(' ' || array_to_string(ws[greatest(1, d + 1 - {SLACK}):greatest(1, d + 1 - {SLACK}) + len + {2 * SLACK} - 1], ' ') || ' ', k))) = 0),
b AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
m AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM good) GROUP BY 1),
s AS (SELECT doc_id, max(share) AS share FROM good GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN s USING (doc_id)"""
