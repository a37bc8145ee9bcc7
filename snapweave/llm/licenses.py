"""Licence scan by a positional rare-token index, in DataFrame functions only.

A template is a licence notice: its words, its label and its mandatory key phrase (consecutive words of it).
How rare each key-phrase word is, is counted over the whole corpus (documents that hold it); the two rarest
words of a key phrase are its anchors. Each document's anchor words are looked up with their positions in the
postings (anchor -> template, position in it), which gives the places where a template would begin; places
of the first anchor are intersected with those of the second, and at every place left the key phrase is
compared word by word. Anchors are key-phrase words, so no place of a key phrase is missed.

Per document: n_words, n_base (places of the base phrases), first_word and last_word (their smallest and
largest start), base_labels, labels (every verified template's), score (the largest share, weighted by
rarity, of a template's words that stand at their relative positions; 0 without a match).

Nothing is shuffled but one count per anchor word and task; every document is one row throughout. Null or
empty text: no words, no labels, first_word and last_word null, score 0. Repeated rows give equal rows. Empty
table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD_JAVA, UPPER

# Label, base phrase or not, words of the notice, mandatory key phrase.
TEMPLATES = (
    ("cc-by", True, "cc by", "cc by"),
    ("gpl", True, "general public license", "general public license"),
    ("reserved", True, "all rights reserved", "all rights reserved"),
    ("agpl", False, "gnu affero general public license", "affero general public license"),
    ("apache-2.0", False, "licensed under the apache license version 2 0", "apache license"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsl-1.0", False, "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-nc", False, "licensed under cc by nc", "cc by nc"),
    ("cc-by-nd", False, "licensed under cc by nd", "cc by nd"),
    ("cc-by-sa", False, "licensed under cc by sa", "cc by sa"),
    ("epl", False, "eclipse public license", "eclipse public license"),
    ("gpl-2.0", False, "general public license version 2", "public license version 2"),
    ("gpl-3.0", False, "general public license version 3", "public license version 3"),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("lgpl", False, "gnu lesser general public license", "lesser general public license"),
    ("mit", False, "released under the mit license", "mit license"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mpl", False, "mozilla public license version 2 0", "mozilla public license"),
    ("public-domain", False, "dedicated to the public domain", "public domain"),
    ("unlicense", False, "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", False, "this software is provided as is without any express or implied warranty", "express or implied warranty"),
)


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[str, ...]
    key: tuple[str, ...]
    at: int  # where the key phrase begins in the words


def templates() -> list[Template]:
    out = []
    for label, base, words, key in TEMPLATES:
        w, k = tuple(words.split()), tuple(key.split())
        out.append(Template(label, base, w, k, next(i for i in range(len(w)) if w[i : i + len(k)] == k)))
    return out


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null is empty."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD_JAVA), "")


def rarity(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequencies over all rows of (words)."""
    held = words.select(F.explode(F.array_intersect(F.lit(vocabulary), "words")).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per vocabulary word at most
    return {w: -math.log((1 + counts.get(w, 0)) / (2 + max(counts.values(), default=0))) for w in vocabulary}


def anchors_of(t: Template, idf: dict[str, float]) -> tuple[str, str]:
    """The two rarest words of the key phrase (the same twice if it has one)."""
    ranked = sorted(set(t.key), key=lambda w: (-idf[w], w))
    return ranked[0], ranked[min(1, len(ranked) - 1)]


def _postings(ts: list[Template], idf: dict[str, float], which: int) -> dict[str, list[tuple[int, int]]]:
    """anchor -> (template, place of the anchor in its key phrase)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(ts):
        anchor = anchors_of(t, idf)[which]
        out.setdefault(anchor, []).extend((n, i) for i, w in enumerate(t.key) if w == anchor)
    return out


def _table(postings: dict[str, list[tuple[int, int]]]) -> Column:
    pairs = []
    for word, posts in postings.items():
        pairs += [F.lit(word), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in posts))]
    return F.create_map(*pairs)


def _places(found: Column, table: Column) -> Column:
    """found: array of (w, p), an anchor word and its position -> where key phrases of templates would begin: array of (t, at)."""
    return F.array_distinct(F.flatten(F.transform(found, lambda a: F.transform(F.coalesce(table[a["w"]], F.array().cast("array<struct<t:int,i:int>>")), lambda x: F.struct(x["t"].alias("t"), (a["p"] - x["i"]).alias("at"))))))


def scan(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, word) for every row."""
    ts = templates()
    read = docs.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("words"))
    idf = rarity(read, sorted({w for t in ts for w in t.words}))
    first, second = (_postings(ts, idf, k) for k in (0, 1))
    anchors = sorted({*first, *second})
    keys = F.array(*(F.lit(list(t.key)) for t in ts))
    held = F.when(F.arrays_overlap("words", F.lit(anchors)), F.filter(F.transform("words", lambda w, p: F.struct(w.alias("w"), p.alias("p"))), lambda a: a["w"].isin(anchors)))
    looked_up = read.select("_id", "words", F.size("words").cast("long").alias("n_words"), F.coalesce(held, F.array().cast("array<struct<w:string,p:int>>")).alias("found"))
    common = F.array_intersect(_places(F.col("found"), _table(first)), _places(F.col("found"), _table(second)))
    crossed = looked_up.select("_id", "words", "n_words", F.when(F.size("found") > 0, common).otherwise(F.array().cast("array<struct<t:int,at:int>>")).alias("places"))

    def verified(x):
        key = F.element_at(keys, x["t"] + 1)
        return (x["at"] >= 0) & (F.slice("words", F.greatest(F.lit(1), x["at"] + 1), F.size(key)) == key)

    matched = crossed.select("_id", "words", "n_words", F.filter("places", verified).alias("m"))

    weights = F.array(*(F.array(*(F.lit(float(max(idf[w], 1e-3))) for w in t.words)) for t in ts))
    notices = F.array(*(F.lit(list(t.words)) for t in ts))
    begins = F.lit([t.at for t in ts])
    totals = F.lit([float(sum(max(idf[w], 1e-3) for w in t.words)) for t in ts])

    def share(x):
        n = x["t"] + 1
        start = x["at"] - F.element_at(begins, n)
        got = F.zip_with(F.element_at(notices, n), F.element_at(weights, n), lambda w, v: F.struct(w.alias("w"), v.alias("v")))
        hit = F.transform(got, lambda y, i: F.when(F.when(start + i >= 0, F.get("words", start + i)) == y["w"], y["v"]).otherwise(0.0))
        return F.least(F.lit(1.0), F.aggregate(hit, F.lit(0.0), lambda a, v: a + v) / F.element_at(totals, n))

    labels, is_base = F.lit([t.label for t in ts]), F.lit([t.base for t in ts])
    named = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: F.element_at(labels, x["t"] + 1)))), ",")
    base = matched.select("_id", "words", "n_words", "m", F.filter("m", lambda x: F.element_at(is_base, x["t"] + 1)).alias("b"))
    starts = F.transform("b", lambda x: x["at"].cast("long"))
    return base.select(
        F.col("_id").alias(id_col), "n_words", F.size("b").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named("b").alias("base_labels"), named("m").alias("labels"), F.coalesce(F.array_max(F.transform("m", share)), F.lit(0.0)).alias("score"),
        F.transform("m", lambda x: F.struct(F.element_at(labels, x["t"] + 1).alias("label"), x["at"].cast("long").alias("word"))).alias("matches"),
    )
