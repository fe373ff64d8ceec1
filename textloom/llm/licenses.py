"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What parts words: all of ASCII but letters and digits.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

#: Phrases whose words stand consecutively, with their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices with their labels (fixed values).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("reserved", "all rights reserved"),
]

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.85

#: Words of a block for each word of the template: a block is so many consecutive words, whatever lines they stand on.
STRETCH = 2


def words(text: str | Column = "text") -> Column:
    """The lower-cased words: one character replaces each separator, as splitting at it is much cheaper than a pattern."""
    return F.array_remove(F.split(F.translate(text_or_empty(text), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS)), " "), "")


def needed(text: str, least: float) -> int:
    return math.ceil(least * len(set(text.split(" "))) - 1e-9)


def telling(templates: list[tuple[str, str]], at: int, least: float) -> list[str]:
    """Words a block must hold, as without them the template of another label would reach this one's threshold."""
    label, text = templates[at]
    own, found = set(text.split(" ")), set()
    for other, more in templates:
        if other != label and len(own & set(more.split(" "))) >= needed(text, least):
            found |= own - set(more.split(" "))
    return sorted(found)


def phrase_starts(phrase: str) -> Column:
    """Places (from 0) at which the phrase's words stand consecutively, from the column ``hits``."""
    first, *others = phrase.split(" ")

    def here(hit: Column, at: Column) -> Column:
        found = hit["w"] == first
        for k, part in enumerate(others, 1):
            following = F.get("hits", at + k)
            found = found & (following["w"] == part) & (following["i"] == hit["i"] + k)
        return found

    return F.transform(F.filter("hits", here), lambda hit: hit["i"])


def find_words(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, n_words, hits``: every place ``i`` (from 0) of a word ``w`` of the vocabulary, in order."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), words(text_col).alias("words"))
    known = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("i"), w.alias("w"))))
    return own.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), F.array_compact(known).alias("hits"))


def token_frequency(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts of the whole corpus each word of the templates occurs: one number per word."""
    counted = rows.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counted.collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def containment_join(rows: DataFrame, templates: list[tuple[str, str]], frequency: dict[str, int], least: float, stretch: int) -> DataFrame:
    """``doc_id, h, label, score``: texts with a block that holds enough of a template's words, once for each stretch of blocks.

    A block of a template of ``k`` words is any ``stretch * k`` consecutive words.  Words
    are ordered from rarest to most frequent in the corpus.  A block that shares
    ``need`` of a template's ``m`` distinct words holds at least one of its
    ``m - need + 1`` rarest.  Those prefixes, a fixed number of words, are joined with
    the words of texts; a text goes on with a template if it is long enough, if from the
    place of the rarest shared word in both orders on enough words follow, and if
    it holds enough of them anywhere.  Then its blocks are verified.  Those that
    begin in one span are a group, so a group is bounded however long the text is.
    """
    spark = rows.sparkSession
    order = sorted(frequency, key=lambda w: (frequency[w], w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, facts = [], []
    for t, (label, text) in enumerate(templates):
        wanted = sorted(set(text.split(" ")), key=rank.__getitem__)
        need = needed(text, least)
        facts.append((t, label, len(wanted), need, telling(templates, t, least), stretch * len(text.split(" "))))
        prefixes += [(w, t, wanted, need, p, facts[-1][4], facts[-1][5]) for p, w in enumerate(wanted[: len(wanted) - need + 1])]
    table = spark.createDataFrame(prefixes, "token string, t int, wanted array<string>, need int, place int, must array<string>, span int")
    starts = sorted({p[0] for p in prefixes})
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    held = F.array_intersect(F.col("hits.w"), F.array(*[F.lit(w) for w in order]))
    ordered = F.transform(F.array_sort(F.transform("held", lambda w: F.struct(ranks[w].alias("r"), w.alias("w")))), lambda s: s["w"])
    # Only texts that are long enough and hold some prefix word go on.
    own = rows.filter(F.col("n_words") >= min(f[3] for f in facts)).withColumn("held", held)
    own = own.filter(F.arrays_overlap("held", F.array(*[F.lit(w) for w in starts]))).withColumn("tokens", ordered)
    probes = own.select("doc_id", "h", "n_words", "hits", "tokens", F.posexplode("tokens").alias("at", "token"))
    pairs = probes.filter(F.col("token").isin(starts)).join(F.broadcast(table), "token")  # a fixed table
    possible = pairs.filter(
        (F.col("n_words") >= F.col("need"))
        & (F.least(F.size("wanted") - F.col("place"), F.size("tokens") - F.col("at")) >= F.col("need"))
        # A pair is judged at its first shared word only.
        & (F.size(F.array_intersect(F.slice("tokens", F.lit(1), F.col("at")), F.slice("wanted", F.lit(1), F.col("place")))) == 0)
        & (F.size(F.array_intersect("tokens", "wanted")) >= F.col("need"))
        & (F.size(F.array_intersect("tokens", "must")) == F.size("must"))
    )
    near = possible.select("doc_id", "h", "t", "span", F.inline(F.filter("hits", lambda x: F.array_contains("wanted", x["w"]))))
    own_part = F.floor(F.col("i") / F.col("span")).cast("int")
    dealt = near.select("doc_id", "h", "t", "i", "w", F.explode(F.array(own_part, own_part - 1)).alias("part"))
    # At most two spans of places in a group; repeated rows add none.
    groups = dealt.groupBy("doc_id", "h", "t", "part").agg(F.collect_set(F.struct("i", "w")).alias("near"))
    groups = groups.join(F.broadcast(spark.createDataFrame(facts, "t int, label string, m int, need int, must array<string>, span int")), "t")

    def shared(first: Column) -> Column:
        block = F.filter("near", lambda x: (x["i"] >= first["i"]) & (x["i"] < first["i"] + F.col("span")))
        distinct = F.array_distinct(F.transform(block, lambda x: x["w"]))
        return F.when(F.size(F.array_intersect(distinct, F.col("must"))) == F.size("must"), F.size(distinct)).otherwise(0)

    begin = F.filter("near", lambda x: F.floor(x["i"] / F.col("span")) == F.col("part"))
    verified = groups.withColumn("shared", F.array_max(F.transform(begin, shared))).filter(F.col("shared") >= F.col("need"))
    return verified.select("doc_id", "h", "label", (F.col("shared") / F.col("m")).alias("score"))


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = CONTAINMENT, stretch: int = STRETCH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Base labels come from the phrases; ``labels`` adds those of all templates of which
    some block of the text, so many consecutive words as ``containment_join`` says, holds
    at least the share ``least`` and every word that tells the template from those of
    other labels.  ``score`` is the best containment among them, 1 where a phrase was
    found, and 0 without labels.

    Texts are read and split once; the places of the templates' words go to a table in the shared folder.

    Null and empty texts have no words, null places, empty label strings and
    score 0; a null id stays null; repeated rows give repeated results; an
    empty table gives none; other columns are not read; no templates raise ValueError.
    """
    if not templates:
        raise ValueError("no templates")
    vocabulary = sorted({w for _, t in templates for w in t.split(" ")})
    every_word = sorted({*vocabulary, *(w for p in PHRASES for w in p.split(" "))})
    own = Scratch(docs.sparkSession, "licenses").put(find_words(docs, every_word, id_col, text_col), "hits")
    matches = containment_join(own, templates, token_frequency(own, vocabulary), least, stretch)
    # Few labels for each text; rows alike in id and text share them.
    by_text = matches.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("g")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))

    starts = [phrase_starts(phrase).alias(f"s{i}") for i, phrase in enumerate(PHRASES)]
    based = own.select("doc_id", "h", "n_words", *starts)
    starts = [F.col(f"s{i}") for i in range(len(PHRASES))]
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(starts, PHRASES.values())]))
    rows = based.select("doc_id", "h", "n_words", F.concat(*starts).alias("places"), F.array_sort(F.array_distinct(labels)).alias("base"))
    joined = rows.join(by_text, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for ``scan_licenses`` with its defaults: the block from every place of a template's word on."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = ", ".join(
        f"({t}, '{label}', '{w}', {len(set(text.split(' ')))}, {needed(text, CONTAINMENT)}, {STRETCH * len(text.split(' '))}, {w in must}, {len(must)})"
        for t, (label, text) in enumerate(TEMPLATES)
        for must in [telling(TEMPLATES, t, CONTAINMENT)]
        for w in sorted(set(text.split(" ")))
    )
    places = " || ".join(
        f"list_filter(range(0, len(w) - {len(p.split(' ')) - 1}), lambda i: " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(" "), 1)) + ")" for p in PHRASES
    )
    bases = " || ".join(
        f"(case when len(list_filter(range(0, len(w) - {len(p.split(' ')) - 1}), lambda i: " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(" "), 1)) + f")) > 0 then ['{label}'] else [] end)"
        for p, label in PHRASES.items()
    )
    return f"""
    with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as low from documents),
    v(t, label, word, m, need, span, must, musts) as (values {rows}),
    w as (select doc_id, regexp_extract_all(low, '{word}') as w from d),
    p as (select doc_id, w, {places} as places, list_sort(list_distinct({bases})) as base from w),
    h as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w),
    x as materialized (select * from h join v using (word)),
    c as (select doc_id, t from x group by all having count(distinct word) >= max(need)),
    y as materialized (select x.* from x join c using (doc_id, t)),
    b as (
        select a.doc_id, a.label, a.t, a.i, count(distinct b.word) / a.m as score
        from y a join y b on a.doc_id = b.doc_id and a.t = b.t and b.i >= a.i and b.i < a.i + a.span
        group by a.doc_id, a.label, a.t, a.i, a.m, a.need, a.musts
        having count(distinct b.word) >= a.need and count(distinct case when b.must then b.word end) = a.musts
    ),
    g as (select doc_id, list(distinct label) as more, max(score) as best from b group by doc_id)
    select p.doc_id, len(w) as n_words, len(places) as n_base, list_min(places) as first_word, list_max(places) as last_word,
        array_to_string(base, ',') as base_labels, array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') as labels,
        greatest(coalesce(best, 0.0), case when len(base) > 0 then 1.0 else 0.0 end) as score
    from p left join g on p.doc_id = g.doc_id"""
