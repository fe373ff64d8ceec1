"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, Scratch, maybe_broadcast, packed_rows, text_or_empty, unit_interval

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Target words as a share of all words, and the most copies of a source.
SHARE, MOST = 1.5, 2.0
#: Leaves meant for one node of the reduction tree.
FAN_IN = 48
#: Rows alike in id, text and source that are numbered in one task.
NUMBERED = 1_000
#: Below this, a probability counts as 0, and above 1 less this as 1.
EPSILON = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Targets are proportional to weight, but at most ``most`` times the source's
    size; what is cut off is reshared by weight until no source is above.  That
    fixpoint is ``min(most * size, level * weight)``: sources are cut in the order
    of size to weight, so running sums over that order give the level at once.
    Windows here span one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    own = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # The level if just the sources before this one were cut; the first that leaves this one whole holds.
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = own.withColumn("level", level).withColumn("holds", F.col("level") <= F.col("cap") / F.col("w"))
    final = F.coalesce(F.min(F.when(F.col("holds"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"], F.lit(float("inf")))
    return levels.withColumn("target", F.least("cap", final * F.col("w"))).select("source", "source_size", "target")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _node(children: Column, seed: int) -> Column:
    """One node of the tree: folds its children (id, x, w, u) and keeps what is left over.

    The carried and the next child exchange mass, keeping the sum of ``w * x``
    and every expectation, until one of them is integral and leaves the fold.
    Result: ``rest`` (the carried child; its x may be fractional) and ``done``.
    """

    def step(acc: Column, nxt: Column) -> Column:
        a = acc["rest"]

        def move(v: Column) -> Column:
            up, down = v["up"], v["down"]
            go_up = v["random"] * (up + down) < down
            xa = F.when(go_up, F.when(v["a_up"] <= v["b_down"], F.lit(1.0)).otherwise(a["x"] + up / a["w"])).otherwise(
                F.when(v["a_down"] <= v["b_up"], F.lit(0.0)).otherwise(a["x"] - down / a["w"])
            )
            xb = F.when(go_up, F.when(v["b_down"] <= v["a_up"], F.lit(0.0)).otherwise(nxt["x"] - up / nxt["w"])).otherwise(
                F.when(v["b_up"] <= v["a_down"], F.lit(1.0)).otherwise(nxt["x"] + down / nxt["w"])
            )
            return F.struct(_snap(xa).alias("xa"), _snap(xb).alias("xb"))

        def settle(x: Column) -> Column:
            new_a = F.struct(a["key"].alias("key"), x["xa"].alias("x"), a["w"].alias("w"), a["u"].alias("u"))
            new_b = F.struct(nxt["key"].alias("key"), x["xb"].alias("x"), nxt["w"].alias("w"), nxt["u"].alias("u"))
            whole_a = (x["xa"] == 0.0) | (x["xa"] == 1.0)
            return F.struct(
                F.when(whole_a, new_b).otherwise(new_a).alias("rest"),
                F.concat(acc["done"], F.array(F.when(whole_a, new_a).otherwise(new_b))).alias("done"),
            )

        a_whole = (a["x"] == 0.0) | (a["x"] == 1.0)
        passed = F.struct(nxt.alias("rest"), F.concat(acc["done"], F.array(a)).alias("done"))
        room = F.struct(
            ((1.0 - a["x"]) * a["w"]).alias("a_up"), (a["x"] * a["w"]).alias("a_down"),
            ((1.0 - nxt["x"]) * nxt["w"]).alias("b_up"), (nxt["x"] * nxt["w"]).alias("b_down"),
        )
        moved = _let(
            room,
            lambda r: _let(
                F.struct(
                    r["a_up"].alias("a_up"), r["a_down"].alias("a_down"), r["b_up"].alias("b_up"), r["b_down"].alias("b_down"),
                    F.least(r["a_up"], r["b_down"]).alias("up"), F.least(r["a_down"], r["b_up"]).alias("down"),
                    unit_interval(F.lit(seed), a["u"], nxt["u"]).alias("random"),
                ),
                move,
            ),
        )
        return F.when(a_whole, passed).otherwise(_let(moved, settle))

    first = F.element_at(children, 1)
    empty = F.filter(children, lambda c: F.lit(False))
    return F.aggregate(F.slice(children, 2, F.size(children)), F.struct(first.alias("rest"), empty.alias("done")), step)


def _snap(x: Column) -> Column:
    return F.when(x < EPSILON, F.lit(0.0)).when(x > 1.0 - EPSILON, F.lit(1.0)).otherwise(x)


def mix(
    docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document: ``doc_id, size, source, source_size, target, copies, taken``.

    A document's size is its number of words (null: 0).  Its expected copies are
    its source's target by the source's size: the whole part is certain, and the
    fractions are rounded dependently.  Leaves are dealt to nodes by a hash of
    their values, each node rounds all but one of its leaves, and the residuals
    form the next level, until each source has one left, which is rounded alone.
    So a source misses its target by at most one document's size.

    A null id, text or source is a value like any other (null sources sort last
    and form one source); repeated rows are leaves of their own, told apart by a
    running number; documents without words take no part and have 0 copies; an
    empty table gives none; other columns are not read.  The result depends on
    the rows' values and the seed alone.
    """  # noqa: D401
    return _mixed_leaves(docs, seed, weights, share, most, id_col, text_col, source_col).drop("h", "nth")


def _mixed_leaves(docs: DataFrame, seed: int, weights: tuple[float, ...], share: float, most: float, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``mix`` with ``h`` and ``nth``, which tell its leaves apart: the text's hash and a number from 1 among rows alike."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("h"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
    )
    sizes = scratch.put(sizes, "sizes")
    targets = scratch.put(source_targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "of")
    # Repeated rows are counted before they meet, then told apart by a running number.
    counted = sizes.groupBy("doc_id", "source", "h", "size").agg(F.count(F.lit(1)).alias("n"))
    leaves = counted.withColumn("nth", F.explode(F.expr("sequence(1L, n)"))).drop("n")
    leaves = leaves.join(maybe_broadcast(targets, 100_000), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    leaves = leaves.withColumn("expected", F.when(F.abs(expected - F.round(expected)) < EPSILON, F.round(expected)).otherwise(expected))
    leaves = leaves.withColumn("sure", F.floor("expected")).withColumn("x", F.col("expected") - F.col("sure"))
    leaves = leaves.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "h", "size", "nth"))
    leaves = scratch.put(leaves.drop("expected"), "leaves")

    kept = ["doc_id", "size", "source", "source_size", "target", "sure", "h", "nth"]
    result = leaves.filter("x = 0").select(*kept, F.lit(0.0).alias("x"))
    most_leaves = leaves.filter("x > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # Nodes of a level are found by the low bits of a hash, fewer bits on each level.
    depth = max(1, math.ceil(math.log(max(most_leaves / FAN_IN, 1)) / math.log(FAN_IN)) + 1)
    key = F.struct(*[F.col(c) for c in ("doc_id", "size", "sure", "h", "nth")])
    level = leaves.filter("x > 0").select("source", "source_size", "target", F.struct(key.alias("key"), F.col("x"), F.col("size").cast("double").alias("w"), F.col("u")).alias("c"))
    for k in range(depth):
        nodes = max(1, math.ceil(most_leaves / FAN_IN ** (k + 1))) if k < depth - 1 else 1
        node = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("c.u")), F.lit(nodes))
        grouped = level.withColumn("node", node).groupBy("source", "source_size", "target", "node").agg(F.sort_array(F.collect_list(F.struct(F.col("c.u").alias("u"), F.col("c").alias("c")))).alias("cs"))
        folded = grouped.select("source", "source_size", "target", _node(F.transform("cs", lambda c: c["c"]), seed + 2 + k).alias("f"))
        folded = scratch.put(folded, f"level{k}")
        done = folded.select("source", "source_size", "target", F.explode("f.done").alias("c"))
        result = result.unionByName(_settled(done))
        level = folded.select("source", "source_size", "target", F.col("f.rest").alias("c"))
    last = level.withColumn("c", F.col("c").withField("x", F.when(unit_interval(F.lit(seed + 99), F.col("c.u")) < F.col("c.x"), 1.0).otherwise(0.0)))
    result = result.unionByName(_settled(last))
    copies = (F.col("sure") + F.col("x").cast("long")).cast("long")
    return result.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h", "nth")


def _settled(rows: DataFrame) -> DataFrame:
    return rows.select("c.key.doc_id", "c.key.size", "source", "source_size", "target", "c.key.sure", "c.key.h", "c.key.nth", "c.x")


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (id, h, source, n, row) with ``nth``, a number from 1 to n among rows alike in id, h and source.

    Rows alike are dealt apart, NUMBERED or so together, and written before they are numbered, so no
    window spans a group and a task that is run again finds the rows dealt as they were.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("n") / NUMBERED)))
    dealt = scratch.put(dealt, "repeats")
    group = ["id", "h", "source"]
    before = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "salt").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.select(*[F.col(c).alias(f"{c}_") for c in (*group, "salt")], F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    same = F.lit(True)
    for c in (*group, "salt"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    own = F.row_number().over(Window.partitionBy(*group, "salt").orderBy("salt"))
    return dealt.withColumn("own", own).join(counts, same).select(*group, "row", (F.col("before") + F.col("own")).cast("long").alias("nth"))


def mix_documents(
    docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of docs, all columns, each as often as ``mix`` takes it.

    Every row gets the copies of its own leaf.  Rows alike in id, text and source are numbered like
    their leaves (which of them gets which number is free), so the result holds as many rows as
    ``mix`` has copies in all.  Columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    leaves = scratch.put(_mixed_leaves(docs, seed, weights, share, most, id_col, text_col, source_col).select("doc_id", "h", "source", "nth", "copies"), "leaves")
    repeated = scratch.put(leaves.groupBy("doc_id", "h", "source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(source_col).alias("source"), packed_rows(docs).alias("row"))

    def as_row(other: DataFrame) -> Column:
        return F.col("id").eqNullSafe(other["doc_id"]) & (F.col("rows.h") == other["h"]) & F.col("rows.source").eqNullSafe(other["source"])

    if not repeated.isEmpty():
        known, rows = maybe_broadcast(repeated), rows.alias("rows")
        single = rows.join(known, as_row(known), "left_anti").withColumn("nth", F.lit(1).cast("long"))
        several = rows.join(known, as_row(known)).select("id", "rows.h", "rows.source", "row", "n")
        rows = single.unionByName(_numbered(several, scratch))
    else:
        rows = rows.withColumn("nth", F.lit(1).cast("long"))
    chosen = maybe_broadcast(leaves.filter("copies > 0"))
    rows = rows.alias("rows")
    joined = rows.join(chosen, as_row(chosen) & (F.col("rows.nth") == chosen["nth"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
