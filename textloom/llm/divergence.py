"""Source divergence audit by a two-pass vocabulary automaton.

Pass one counts exactly in how many documents of a language each term occurs, and keeps the terms of enough documents.
Pass two builds, for each block of texts, an Aho-Corasick automaton of the kept terms that the block holds, each padded with a delimiter
on both sides, and counts their occurrences again in one scan of the delimited texts.  The counts are sparse postings of
(language, source, term); all shares are whole numbers, and what a source lacks enters pairs by formula, not by rows:

    sum over all terms of e(p, q)  =  V * e(p0, q0)  +  sum over A's terms of e(p, q0) - e(p0, q0)
        +  sum over B's terms of e(p0, q) - e(p0, q0)  +  sum over common terms of e(p, q) - e(p, q0) - e(p0, q) + e(p0, q0)

where p0 and q0 are the shares of a term that the source does not have.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, bucketed, maybe_broadcast, text_or_empty

#: Bytes of text meant for one block, and buckets of the table of blocks at most.
BLOCK_BYTES = 8 << 20
BUCKETS = 20_000
#: Rows of one language and source with the same text from which they are one weighted row.
HOT_COPIES = 500
#: Sources that meet in one tile, postings meant for one task, and pairs of postings looked at at once.
TILE_SOURCES = 256
TASK_POSTINGS = 500_000
PAIRS = 1 << 19

#: UTF-8 bytes: A-Z to a-z, bytes of letters and of other code points stay, all else becomes the delimiter.
DELIMITED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def excess(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q) of whole numbers."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def share(count: Column, of: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (of + terms)), in decimals, as the product may exceed 64 bits; null without terms."""
    exact = lambda x: x.cast("decimal(19,0)")
    whole = F.call_function("div", exact(count + 1) * F.lit(scale).cast("decimal(10,0)"), exact(of + terms))
    return F.when(terms > 0, whole.cast("long") + 1)


def _blocks(own: DataFrame, scratch: Scratch) -> DataFrame:
    """``block, lang, source, text, weight`` written in buckets of blocks, each of some BLOCK_BYTES and few sources.

    Copies of a text that very many rows of a source hold are one row with a weight; sources larger than a block are dealt over several.
    """
    keyed, key = own.withColumn("h", F.xxhash64("text")), ["lang", "source", "h"]
    many = scratch.put(keyed.groupBy(*key).count().filter(F.col("count") > HOT_COPIES).drop("count"), "copies")
    if many.isEmpty():
        rows = keyed.withColumn("weight", F.lit(1).cast("long"))
    else:
        many = maybe_broadcast(many)
        folded = keyed.join(many, key, "left_semi").groupBy(*key, "text").agg(F.count(F.lit(1)).alias("weight"))
        rows = keyed.join(many, key, "left_anti").withColumn("weight", F.lit(1).cast("long")).unionByName(folded)
    length = F.octet_length("text").cast("long") + 16
    total = own.agg(F.sum(length)).first()[0] or 0
    large = own.groupBy("lang", "source").agg(F.ceil(F.sum(length) / BLOCK_BYTES).alias("parts")).filter("parts > 1")
    rows = rows.join(maybe_broadcast(scratch.put(large, "large")), ["lang", "source"], "left")
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    part = F.pmod("h", F.coalesce("parts", F.lit(1)))
    rows = rows.select(F.pmod(F.xxhash64("lang", "source", part), F.lit(blocks)).alias("block"), "lang", "source", F.col("text").cast("binary").alias("text"), "weight")
    buckets = min(blocks, BUCKETS)
    return bucketed(rows.repartition(buckets, "block"), scratch, "texts", buckets)


def _by_lang(texts: pa.Table) -> dict[str, list[tuple[str, bytes, int]]]:
    """(source, text, weight) by language."""
    found = defaultdict(list)
    for lang, source, text, weight in zip(*(texts.column(c).to_pylist() for c in ("lang", "source", "text", "weight"))):
        found[lang].append((source, text, weight))
    return found


def _document_terms(texts: pa.Table) -> pa.Table:
    """In how many documents of the block each term occurs."""
    block, out = texts.column("block")[0].as_py(), []
    for lang, rows in _by_lang(texts).items():
        seen: Counter = Counter()
        for _, text, weight in rows:
            terms = set(text.translate(DELIMITED).split())
            seen.update(terms if weight == 1 else dict.fromkeys(terms, weight))
        out.append(pa.table({
            "block": pa.array([block] * len(seen), pa.int64()), "lang": pa.array([lang] * len(seen), pa.string()),
            "term": pa.array(list(seen), pa.binary()), "docs": pa.array(list(seen.values()), pa.int64()),
        }))
    return pa.concat_tables(out)


def _occurrences(texts: pa.Table, kept: pa.Table) -> pa.Table:
    """How often each kept term of the block occurs in each of its sources."""
    import ahocorasick

    terms, out = defaultdict(list), []
    for lang, term in zip(kept.column("lang").to_pylist(), kept.column("term").to_pylist()):
        terms[lang].append(term)
    for lang, rows in _by_lang(texts).items():
        own = terms.get(lang)
        if not own:
            continue
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(own):
            automaton.add_word(f" {term.decode(errors='surrogateescape')} ", i)
        automaton.make_automaton()
        counts: dict[str, Counter] = defaultdict(Counter)
        for source, text, weight in rows:
            padded = b" %b " % text.translate(DELIMITED)
            found = map(itemgetter(1), automaton.iter(padded.decode(errors="surrogateescape")))
            counts[source].update(found if weight == 1 else {k: n * weight for k, n in Counter(found).items()})
        for source, count in counts.items():
            out.append(pa.table({
                "lang": pa.array([lang] * len(count), pa.string()), "source": pa.array([source] * len(count), pa.string()),
                "term": pa.array([own[k] for k in count], pa.binary()), "n": pa.array(list(count.values()), pa.int64()),
            }))
    return pa.concat_tables(out) if out else pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())]).empty_table()


def postings(docs: DataFrame, scratch: Scratch, min_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``lang, term`` of the kept terms, and ``lang, source, term, n`` of their occurrences; terms are binary (UTF-8)."""
    own = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    texts = _blocks(own, scratch)
    terms = scratch.put(texts.groupBy("block").applyInArrow(_document_terms, "block long, lang string, term binary, docs long"), "terms")
    kept = scratch.put(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term"), "kept")
    of_block = terms.join(kept, ["lang", "term"]).select("block", "lang", "term")
    counted = texts.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(_occurrences, "lang string, source string, term binary, n long")
    return kept, scratch.put(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")


def _common_terms(rows: pa.Table) -> pa.Table:
    """What common terms add to each ordered pair of a tile's sources."""
    names = rows.column("source").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    source, size = names.indices.to_numpy(), len(names.dictionary)
    terms = rows.column("term").combine_chunks().dictionary_encode()
    terms = (terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms).indices.to_numpy()
    p, p0, side = (rows.column(c).to_numpy() for c in ("p", "p0", "tile"))
    order = np.argsort(terms, kind="stable")
    source, terms, p, p0, side = (x[order] for x in (source, terms, p, p0, side))
    at = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1], [True]]))
    group = np.diff(at)  # postings of each term
    apart, sums = side.min() != side.max(), np.zeros(size * size, np.int64)
    ends = np.cumsum(group**2)
    e = lambda x, y: (x - y) ** 2 // y
    done = 0
    while done < len(group):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        many = group[done:upto] ** 2
        k = np.repeat(np.arange(done, upto), many)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
        a, b = at[k] + nth // group[k], at[k] + nth % group[k]
        keep = (side[a] != side[b]) if apart else (a != b)
        a, b = a[keep], b[keep]
        np.add.at(sums, source[a] * np.int64(size) + source[b], e(p[a], p[b]) - e(p[a], p0[b]) - e(p0[a], p[b]) + e(p0[a], p0[b]))
        done = upto
    cells = np.flatnonzero(sums)
    lang = rows.column("lang")[0].as_py()
    return pa.table({
        "lang": pa.array([lang] * len(cells), pa.string()), "a": names.dictionary.take(pa.array(cells // size)),
        "b": names.dictionary.take(pa.array(cells % size)), "v": pa.array(sums[cells], pa.int64()),
    })


def _pairs(shares: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``lang, source, item, value``: each ordered pair of a language's sources."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_SOURCES).cast("int").alias("tiles"))
    shards = max(1, math.ceil(shares.count() / TASK_POSTINGS))
    dealt = shares.join(maybe_broadcast(scratch.put(tiles, "tiles")), "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    dealt = dealt.select("lang", "source", "term", "p", "p0", "tile", "shard", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"))
    # Within a tile pair (i, j) only sources of different tiles meet; within (i, i) all do.
    common = dealt.groupBy("lang", "i", "j", "shard").applyInArrow(_common_terms, "lang string, a string, b string, v long")

    near = maybe_broadcast(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0")))
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    each = alike.join(near, "lang").filter(F.col("source") != F.col("other"))
    gained, lost = (F.sum(F.col("terms") * (x - y)) for x, y in ((excess("p", "q0"), excess("p0", "q0")), (excess("q0", "p"), excess("q0", "p0"))))
    alone = scratch.put(each.groupBy("lang", "source", "other").agg(gained.alias("gained"), lost.alias("lost")), "alone")

    grid = groups.join(near, "lang").filter(F.col("source") != F.col("other"))
    grid = grid.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.coalesce(F.col("terms") * excess("p0", "q0"), F.lit(0)).alias("v"))
    both = [grid, alone.selectExpr("lang", "source as a", "other as b", "gained as v"), alone.selectExpr("lang", "other as a", "source as b", "lost as v"), common]
    every = both[0]
    for more in both[1:]:
        every = every.unionByName(more)
    return every.groupBy("lang", "a", "b").agg(F.sum("v").alias("value")).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def audit(
    docs: DataFrame, min_docs: int = 3, top: int = 200, scale: int = 1_000_000_000, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Returns ``lang, source, part, item, value, rank``: how each source's words differ from other sources' and from its language's.

    A language keeps the terms of at least ``min_docs`` of its documents.  Part ``pair`` has the divergence of a source from each
    other source of the language, part ``term`` the ``top`` terms that a source has more often than its language.  All figures are
    exact whole numbers; a sum is below (scale + terms)^2, within 64 bits up to two billion terms.

    Null texts, languages and sources are empty ones, which are a language and a source like any other; each row is a document,
    repeated ones too; an empty table gives no rows; other columns are not read; texts are read whole.  A language without kept terms gives
    its pairs with value 0 and no terms.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    kept, found = postings(docs, scratch, min_docs, text_col, lang_col, source_col)
    sources = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source")).distinct()
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = scratch.put(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "sizes")
    groups = sources.join(totals, ["lang", "source"], "left").join(maybe_broadcast(terms), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = scratch.put(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), scale)), "groups")
    shares = found.join(maybe_broadcast(groups), ["lang", "source"])
    shares = scratch.put(shares.select("lang", "source", "term", "p0", share(F.col("n"), F.col("total"), F.col("terms"), scale).alias("p")), "shares")

    pair = _pairs(shares, groups, scratch).withColumn("part", F.lit("pair"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(by))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.max("terms").alias("terms"))
    base = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(maybe_broadcast(scratch.put(whole, "whole")), "lang")
    base = base.select("lang", "term", share(F.col("n"), F.col("all"), F.col("terms"), scale).alias("q"))
    term = shares.join(base, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), excess("p", "q").alias("value"))
    term = term.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(term.select(*columns))


#: The same by a full table of every source's share of every kept term.
ORACLE = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), o as (select lang, source, r, unnest(w) as term from d
), kept as (select lang, term from o group by lang, term having count(distinct r) >= 3
), size as (select lang, count(*)::hugeint as v from kept group by lang
), grp as (select distinct lang, source from d
), n as (select lang, source, term, count(*)::hugeint as n from o join kept using (lang, term) group by lang, source, term
), cell as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as n, v, sum(coalesce(n.n, 0)) over (partition by g.lang, g.source) as total
  from grp g join kept k on k.lang = g.lang join size s on s.lang = g.lang left join n on n.lang = g.lang and n.source = g.source and n.term = k.term
), p as (select lang, source, term, n, (1 + 1000000000::hugeint * (n + 1) // (total + v)::hugeint)::bigint as p from cell
), lang_n as (select lang, term, sum(n)::hugeint as n from n group by lang, term
), q as (
  select lang, term, (1 + 1000000000::hugeint * (n + 1) // (sum(n) over (partition by lang) + v)::hugeint)::bigint as q from lang_n join size using (lang)
), met as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), pair as (
  select a.lang, a.source, b.source as item, coalesce(value, 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source left join met on met.lang = a.lang and met.source = a.source and met.item = b.source
), terms as (select lang, source, term as item, (p - q) * (p - q) // q as value from p join q using (lang, term) where n > 0 and p > q
), ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair
  union all
  select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200
)
select lang, source, part, item, value::bigint as value, rank from ranked
"""
