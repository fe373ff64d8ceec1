"""Exact n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. Every text becomes a sorted array of shingles, each known by two independent 64-bit
   hashes; its digest names the set, so equal sets are one node from here on.
2. Shingles have a global order: rarer first by a frequency sketch of the whole
   corpus, then by hash.  Sets that are similar enough share a shingle among the
   first ``n - ceil(t*n) + 1``; those are the tiles a set belongs to.
3. Tiles are banded by size, one band a doubling; a set whose size could still match
   one of the band below is a guest there.  A parity bitmap of each set bounds the
   overlap from above, since every bit in which two bitmaps differ costs at least
   one shingle that is not shared; within a band bitmaps are alike in width.
4. Pairs that the bound lets through are verified on the sorted arrays, in both hashes.

To avoid all pairs of a group of near-copies, each set is first verified against
the representative it shares most tiles with, if the bitmaps allow.  Sets of one tile that are
then still in different components meet in blocks: in two rounds each picks the partners most
like it, and a last one verifies all pairs left between components, so none is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Scratch, maybe_broadcast, packed_rows, pieces, release_memory, short_batches, text_or_empty, worker_state
from textloom.llm.components import connected_components, joined_components

MEMO_WORDS = 1 << 16
#: Sets whose tiles a task has sent and remembers.
MEMO_SETS = 1 << 16
#: Counters of the frequency sketch; its size does not depend on the corpus.
SKETCH = 1 << 21
#: Members of a tile that meet in one task.
BLOCK = 512
#: Partners a set picks in the rounds before the last, which takes all pairs left.
PICKS = (1, 4)
#: Tiles before a set's own that its row names, so that pairs that have met there come once.
BEFORE = 4
#: Bitmap words compared at once.
COMPARE = 1 << 21
#: Shingles gathered before they are added to the sketch.
GATHER = 1 << 20

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _K2
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """Two 64-bit hashes of each word, 16 bytes of BLAKE2b."""

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return found


class Sets:
    """Sets one after the other: shingles by their first and second hash, set i from ``at[i]`` to ``at[i + 1]``.

    Within a set shingles are distinct and sorted by the first hash.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, at: np.ndarray):
        self.first, self.second, self.at = first, second, at
        self.sizes = np.diff(at)

    def digests(self) -> np.ndarray:
        """A signed 64-bit name of each set, of both hashes of all its shingles; 0 for the empty one."""
        with np.errstate(over="ignore"):
            each = mix64(mix64(self.first * _K2 + np.uint64(1)) + self.second)
            total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
            names = mix64(total[self.at[1:]] - total[self.at[:-1]] + self.sizes.astype(np.uint64) * _K1).astype(np.int64)
        names[names == 0] = 1
        return np.where(self.sizes > 0, names, 0)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[i], self.at[i + 1])
        return self.first[part], self.second[part]


class Shingler:
    """Sets of word n-grams."""

    def __init__(self, width: int):
        self.width = width
        self.memo = Memo()

    def _chained(self, words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words from each place on."""
        with np.errstate(over="ignore"):
            out = np.full(len(at), np.uint64(k), np.uint64)
            for i in range(k):
                out = mix64(out * _K1 + words[at + i])
        return out

    def __call__(self, texts: list[str]) -> Sets:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        hashes, counts = [], []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
            counts.append(len(words))
            hashes.append(b"".join(map(self.memo.__getitem__, words)))
        both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
        n = np.array(counts, np.int64)
        ends = np.cumsum(n)
        left = np.repeat(ends, n) - np.arange(len(both))  # words from each place to the text's end
        at = np.flatnonzero(left >= self.width)
        streams = []
        for k in range(2):
            words = mix64(both[:, k] + _K1)
            whole = np.zeros(len(both), np.uint64)
            whole[at] = self._chained(words, at, self.width)
            for short in range(1, self.width):  # texts of fewer words are one shingle
                one = (ends - n)[n == short]
                whole[one] = self._chained(words, one, short)
            streams.append(whole)
        firsts, seconds, sizes = [], [], []
        for end, count in zip(ends.tolist(), counts):
            begin = end - count
            end = begin + (max(count - self.width, 0) + 1 if count else 0)
            x, y = streams[0][begin:end], streams[1][begin:end]
            order = x.argsort(kind="stable")
            x, y = x[order], y[order]
            new = np.ones(len(x), bool)
            same = x[1:] == x[:-1]
            if same.any():
                new[1:] = ~same
                if (same & (y[1:] != y[:-1])).any():  # different shingles of one first hash
                    order = np.lexsort((y, x))
                    x, y = x[order], y[order]
                    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                x, y = x[new], y[new]
            firsts.append(x)
            seconds.append(y)
            sizes.append(len(x))
        none = [np.zeros(0, np.uint64)]
        return Sets(np.concatenate(firsts or none), np.concatenate(seconds or none), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64))


def common_shingles(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share, by both hashes."""
    small, big = (a, b) if len(a[0]) < len(b[0]) else (b, a)
    if not len(small[0]):
        return 0
    if (big[0][1:] == big[0][:-1]).any():
        return len(set(zip(*(x.tolist() for x in small))) & set(zip(*(x.tolist() for x in big))))
    where = np.minimum(np.searchsorted(big[0], small[0]), len(big[0]) - 1)
    return int(((big[0][where] == small[0]) & (big[1][where] == small[1])).sum())


def bitmap_bits(n: int, t: float) -> int:
    """Bits of a bitmap: a power of two in proportion to the shingles that linked sets may differ in."""
    return 1 << max(6, min(15, int(np.ceil(5 * (1 - t) * n)).bit_length()))


def bitmap(mixed: np.ndarray, t: float) -> bytes:
    """Parity of how many shingles (their mixed first hashes) fall on each bit."""
    bits = bitmap_bits(len(mixed), t)
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(packed: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded by XOR to fewer bits, as 64-bit words."""
    flags = np.unpackbits(packed, axis=1)
    while flags.shape[1] > bits:
        half = flags.shape[1] // 2
        flags = flags[:, :half] ^ flags[:, half:]
    return np.packbits(flags, axis=1).view(np.uint64)


def bands(n: int, t: float) -> list[int]:
    """The doubling that a size falls in, and those below with a size that can match it."""
    least = max(1, int(np.ceil(t * n - 1e-9)))
    return list(range(least.bit_length() - 1, n.bit_length()))


def most_shared(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """How many shingles sets of n and m can share at most if so many bits of their bitmaps differ."""
    return np.minimum((n + m - differ) // 2, np.minimum(n, m))


def prefix_length(n: int, t: float) -> int:
    return n - int(np.ceil(t * n - 1e-9)) + 1 if n else 0


def _shingler(width: int) -> Shingler:
    state = worker_state("shingles")
    if width not in state:
        state[width] = Shingler(width)
    return state[width]


def describe_sets(docs: DataFrame, width: int, t: float) -> DataFrame:
    """Per row: ``doc_id, h, n, digest, bits``; and rows with a null digest that hold a piece of the frequency sketch.

    Each task adds its sketch at its end, as compressed counters.
    """
    out = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("bits", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch, each, held = _shingler(width), np.zeros(SKETCH, np.uint32), [], 0

        def add() -> None:
            if each:
                np.add.at(sketch, (np.concatenate(each) % np.uint64(SKETCH)).astype(np.int64), np.uint32(1))
                each.clear()

        for batch in pieces(batches):
            sets = shingler(batch.column(2).to_pylist())
            mixed = mix64(sets.first)
            bits = [bitmap(mixed[a:b], t) for a, b in zip(sets.at[:-1].tolist(), sets.at[1:].tolist())]
            each.append(sets.first)
            held += len(sets.first)
            if held > GATHER:
                add()
                held = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets.sizes, pa.int64()), pa.array(sets.digests()), pa.array(bits, pa.binary())], names=out.names)
        add()
        if sketch.any():
            parts = np.array_split(sketch, 32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(32), pa.int64()), pa.nulls(32, pa.int64()), pa.nulls(32, pa.int64()), pa.nulls(32, pa.int64()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=out.names
            )
        release_memory()

    return docs.select("doc_id", "h", "text").mapInArrow(run, out)


def frequency_levels(parts: DataFrame) -> np.ndarray:
    """Per counter of the sketch, how frequent its shingles are (8 bits): 0 up to what chance
    puts on a counter, then in steps of a doubling of the excess.

    The tasks' counters are summed up as they arrive, in two rounds, so no task holds more than one sketch.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in pieces(batches, 1):
            (piece,), (packed,) = (batch.column(k).to_pylist() for k in range(2))
            raw = zlib.decompress(packed)
            values = np.frombuffer(raw, np.int64 if len(raw) == SKETCH // 32 * 8 else np.uint32)
            totals[piece] = totals[piece] + values if piece in totals else values.astype(np.int64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in totals.values()], pa.binary())], names=["piece", "total"])

    kind = "piece long, total binary"
    once = parts.select(F.col("doc_id").alias("piece"), "bits").repartition("piece", F.pmod(F.xxhash64("bits"), F.lit(16))).mapInArrow(add, kind)
    rows = once.repartition("piece").mapInArrow(add, kind).collect()  # of fixed size
    if not rows:
        return np.zeros(SKETCH, np.uint8)
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["total"]), np.int64) for r in sorted(rows, key=lambda r: r["piece"])])
    usual = float(np.median(counts))
    excess = (counts - usual) / (6 * np.sqrt(usual) + 4)
    return np.where(excess < 1, 0, 1 + np.floor(np.log2(np.maximum(excess, 1)))).astype(np.uint8)


def tiles(docs: DataFrame, width: int, t: float, levels) -> DataFrame:
    """``tile, n, digest``: the banded tiles of each set, once per set and task (as far as a bounded memory of them goes)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # SKETCH bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rank, seen = _shingler(width), shared.value, set()
        for batch in pieces(batches):
            sets = shingler(batch.column(0).to_pylist())
            levels_of = rank[(sets.first % np.uint64(SKETCH)).astype(np.int64)]
            keys, sizes, names = [], [], []
            for i, name in enumerate(sets.digests().tolist()):
                if not name or name in seen:
                    continue
                seen.add(name)
                values, level = sets[i][0], levels_of[sets.at[i] : sets.at[i + 1]]
                p = prefix_length(len(values), t)
                # Values are sorted by hash, so a stable sort by level gives the global order.
                chosen = values[level == 0][:p] if (level == 0).sum() >= p else values[np.argsort(level, kind="stable")[:p]]
                for band in bands(len(values), t):
                    keys.append(mix64(chosen + np.uint64(band)))
                    sizes.append(len(values))
                    names.append(name)
            if len(seen) > MEMO_SETS:
                seen.clear()
            if keys:
                k = np.array([len(x) for x in keys])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(sizes, k)), pa.array(np.repeat(np.array(names, np.int64), k))], names=["tile", "n", "digest"]
                )
        release_memory()

    return docs.select("text").mapInArrow(run, "tile long, n long, digest long")


def shared_tiles(rows: DataFrame, t: float) -> DataFrame:
    """``tile, n, digest, rep``: the rows of tiles that hold several sets.

    ``rep`` is the smallest set of the tile whose size still allows a link.  Rows
    arrive sorted by tile, size and digest and are held one tile's run at a time
    in batches, so no tile is collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: tile, n, digest; and its representative
        held = None  # a first row of a tile, sent once a second set follows
        for batch in batches:
            tile, n, name = (batch.column(i).to_numpy() for i in range(3))
            if not len(tile):
                continue
            # Rows equal to the one before are copies from other tasks.
            new = np.ones(len(tile), bool)
            new[1:] = (tile[1:] != tile[:-1]) | (name[1:] != name[:-1])
            if last is not None and tile[0] == last[0] and name[0] == last[2]:
                new[0] = False
            tile, n, name = tile[new], n[new], name[new]
            if not len(tile):
                continue
            same = np.zeros(len(tile), bool)  # as the row before
            same[1:] = tile[1:] == tile[:-1]
            same[0] = last is not None and tile[0] == last[0]
            more = np.zeros(len(tile), bool)  # as the row after
            more[:-1] = same[1:]
            more[-1] = True  # unknown yet
            out = []
            if held is not None and same[0]:
                out.append(held)
                held = None
            reps = name.copy()
            rep = last[3:] if last is not None else (0, 0)
            for i in np.flatnonzero(same):
                if i and not same[i - 1]:
                    rep = (n[i - 1], name[i - 1])
                if rep[0] < t * n[i] - 1e-9:
                    rep = (n[i], name[i])
                reps[i] = rep[1]
            end = (n[-1], name[-1]) if not same[-1] else rep
            last = (tile[-1], n[-1], name[-1], *end)
            keep = same | more
            if not same[-1]:
                keep[-1] = False
                held = (tile[-1], n[-1], name[-1], name[-1])
            else:
                held = None
            first = [pa.array(np.array([x[k] for x in out], np.int64)) for k in range(4)]
            rest = [pa.array(x[keep]) for x in (tile, n, name, reps)]
            if out:
                yield pa.RecordBatch.from_arrays(first, names=["tile", "n", "digest", "rep"])
            if keep.any():
                yield pa.RecordBatch.from_arrays(rest, names=["tile", "n", "digest", "rep"])

    ordered = rows.repartition("tile").sortWithinPartitions("tile", "n", "digest")
    return ordered.mapInArrow(run, "tile long, n long, digest long, rep long")


def verified(pairs: DataFrame, owners: DataFrame, docs: DataFrame, width: int, t: float, scratch: Scratch, name: str) -> DataFrame:
    """Those pairs (a, b) of digests whose sets are similar enough.

    Each a goes with its pairs' b into groups of bounded size; their texts are fetched once and
    shingled anew, and the sorted arrays are intersected.  ``owners`` names a row (doc_id, h) of
    docs for each digest, and how many rows equal it: of those one text is sent.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(64))
    salted = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")), "a").withColumn("salt", F.when(F.col("c") > 4 * BLOCK, salt).otherwise(0)).select("a", "b", "salt")
    members = salted.select("a", "salt", F.col("b").alias("digest"), F.lit(1).alias("role"))
    heads = salted.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("digest"), F.lit(0).alias("role"))
    needed = members.unionByName(heads).join(owners, "digest").select("a", "salt", "digest", "role", F.col("doc_id").alias("id"), F.col("h").alias("g"), "rows")
    needed = scratch.put(needed, f"{name}-needed")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))

    def fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
        return texts.join(maybe_broadcast(wanted), same).select("a", "salt", "role", "digest", "text")

    texts = fetched(docs, needed.filter("rows = 1"))
    repeated = needed.filter("rows > 1")
    if not repeated.isEmpty():
        once = docs.join(maybe_broadcast(repeated.select("id", "g").distinct()), same, "left_semi").groupBy("doc_id", "h").agg(F.first("text").alias("text"))
        texts = texts.unionByName(fetched(once, repeated))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, head, at = _shingler(width), None, None
        for batch in pieces(batches, 64):
            found = []
            sets = shingler(batch.column(4).to_pylist())
            own = sets.digests().tolist()
            for i, (a, salt_, role, name_) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if own[i] != name_:
                    continue  # another row of the same id and hash
                if not role:
                    at, head = (a, salt_), tuple(x.copy() for x in sets[i])
                elif at == (a, salt_):
                    shared = common_shingles(sets[i], head)
                    if shared >= t * (len(sets[i][0]) + len(head[0]) - shared) - 1e-9:
                        found.append((a, name_))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])
        release_memory()

    return texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, signatures: DataFrame, t: float) -> DataFrame:
    """Those pairs (a, b) of digests that sizes and bitmaps allow; ``signatures``: digest, n, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            keep = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                low = 8 * min(len(x), len(y))
                x, y = (folded(np.frombuffer(z, np.uint8)[None], low) for z in (x, y))
                most = int(most_shared(n, m, int(np.bitwise_count(x ^ y).sum())))
                keep.append(most >= t * (n + m - most) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(signatures.select(F.col("digest").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def allowed(n: np.ndarray, root: np.ndarray, own: np.ndarray | None, bits: list[bytes], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs that sizes and bitmaps allow, of different roots (and blocks), and the bits they differ in."""
    i, j = np.triu_indices(len(n), 1)
    ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9)
    if own is not None:
        ok &= own[i] != own[j]
    i, j = i[ok], j[ok]
    if not len(i):
        return i, j, i
    lengths = np.array([len(x) for x in bits])
    low = int(lengths.min()) * 8
    words = np.empty((len(n), low // 64), np.uint64)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        words[at] = folded(np.frombuffer(b"".join(bits[k] for k in at), np.uint8).reshape(len(at), -1), low)
    step = max(1, COMPARE // words.shape[1])
    differ = np.concatenate([np.bitwise_count(words[i[k : k + step]] ^ words[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)])
    most = most_shared(n[i], n[j], differ)
    ok = most >= t * (n[i] + n[j] - most) - 1e-9
    return i[ok], j[ok], differ[ok]


def first_met(i: np.ndarray, j: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) share none of the tiles in ``before``, a row of numbers for each set and -1 for none."""
    new = np.ones(len(i), bool)
    for x in range(before.shape[1]):
        mine = before[i, x]
        for y in range(before.shape[1]):
            new &= (mine != before[j, y]) | (mine < 0)
    return new


def picked(i: np.ndarray, j: np.ndarray, differ: np.ndarray, picks: int) -> np.ndarray:
    """Positions of the pairs that are among the ``picks`` most alike of one of their sets."""
    who, what, cost = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2), np.tile(differ, 2)
    order = np.lexsort((what, cost, who))
    starts = np.concatenate([[True], who[order][1:] != who[order][:-1]])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return np.unique(what[order[place < picks]])


def meeting_pairs(rows: DataFrame, signatures: DataFrame, t: float, picks: int | None) -> DataFrame:
    """``a, b, tile``: pairs of one tile, in different components, that sizes and bitmaps allow.

    ``rows``: tile, m (its rows), n, digest, root; ``signatures``: digest, bits.  A
    tile's members are dealt to blocks of bounded size by hash, and each task
    compares two blocks.  Near-copies share many tiles: each row names the BEFORE tiles
    of its set that come before in the order of tiles, and a pair that shares one of those is left
    to it, where it meets as well; a few still come more than once.  With ``picks`` only so many
    partners of each set come, those most like it; then a row with null a and b names a tile with pairs left.
    """
    order = Window.partitionBy("digest").orderBy("tile")
    names = [f"before{k}" for k in range(BEFORE)]
    placed = rows.select("*", *[F.lag("tile", k + 1).over(order).alias(name) for k, name in enumerate(names)])
    blocked = placed.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tile", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "n", "digest", "root", *names)
    dealt = dealt.join(signatures.select("digest", "bits"), "digest").select("tile", "x", "y", "own", "n", "digest", "root", "bits", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive one after the other; each is bounded."""
        rest: pa.Table | None = None

        def results(rows: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, y, own, n, name, root = (rows.column(k).to_numpy() for k in range(1, 7))
            tile, bits = rows.column(0).to_numpy(), rows.column(7)
            _, before = np.unique(np.stack([rows.column(8 + k).fill_null(0).to_numpy() for k in range(BEFORE)]), return_inverse=True)
            none = np.stack([rows.column(8 + k).is_null().to_numpy() for k in range(BEFORE)])
            before = np.where(none, -1, before.reshape(none.shape)).T
            found, left = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo < 2 or (root[lo:hi] == root[lo]).all():
                    continue
                names = name[lo:hi]
                i, j, differ = allowed(n[lo:hi], root[lo:hi], own[lo:hi] if x[lo] != y[lo] else None, bits.slice(lo, hi - lo).to_pylist(), t)
                if picks and len(i):
                    keep = picked(i, j, differ, picks)
                    if len(keep) < len(i):
                        left.append(tile[lo])
                    i, j = i[keep], j[keep]
                new = first_met(i, j, before[lo:hi])
                i, j = i[new], j[new]
                if len(i):
                    found.append((np.minimum(names[i], names[j]), np.maximum(names[i], names[j])))
            if found or left:
                a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(2))
                blank = pa.nulls(len(left), pa.int64())
                columns = [(pa.array(a), blank), (pa.array(b), blank), (pa.nulls(len(a), pa.int64()), pa.array(left, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["a", "b", "tile"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            key = np.stack([rows.column(k).to_numpy() for k in range(3)])
            edges = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            yield from results(rows, edges)  # the last group may go on
            rest = rows.slice(int(edges[-1]))
        if rest is not None and rest.num_rows:
            yield from results(rest, np.array([0, rest.num_rows]))

    ordered = dealt.repartition("tile", "x", "y").sortWithinPartitions("tile", "x", "y")
    return ordered.mapInArrow(run, "a long, b long, tile long")


def open_tiles(tiled: DataFrame, roots: DataFrame, distinct_members: bool) -> DataFrame:
    """``tile, m, n, digest, root``: the tiles with sets of different components.

    Near-copies share many tiles with the same members; with ``distinct_members`` one of those comes.
    """
    placed = tiled.select("tile", "n", "digest").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    placed = placed.withColumn("root", F.coalesce("root", "digest"))
    members = F.struct(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "digest")))
    split = placed.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), members.alias("members")).filter("lo <> hi")
    if distinct_members:
        split = split.groupBy("members").agg(F.min("tile").alias("tile"))
    return placed.join(split.select("tile", F.col("members.m").alias("m")), "tile").select("tile", "m", "n", "digest", "root")


def similar_components(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, h`` (h: hash of the text).

    Two documents link if the Jaccard similarity of their sets of distinct word
    n-grams is at least ``threshold``; a shorter text is one shingle, one without
    words has none and links with nothing.  ``component_id`` is the smallest id
    reachable, null ids aside; a row without links has its own id.  Null texts
    count as empty, repeated rows get repeated results, an empty table gives none;
    other columns are not read.  Ids are whole numbers, or texts of such (any other
    text ends the job).  Shingles are told apart by 128 bits, sets by 64-bit digests of those.
    """
    with short_batches(docs.sparkSession):
        return _components(docs, width, threshold, id_col, text_col)


def _components(docs: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    described = scratch.put(describe_sets(own, width, threshold), "sets")
    sets = described.filter(F.col("digest").isNotNull()).select("doc_id", "h", "n", "digest")
    levels = frequency_levels(described.filter(F.col("digest").isNull()).select("doc_id", "bits"))
    signatures = described.filter("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    rows = sets.filter("n > 0").groupBy("digest", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    owners = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "rows")).alias("o"))
    owners = scratch.put(owners.select("digest", "o.doc_id", "o.h", "o.rows"), "owners")

    tiled = scratch.put(shared_tiles(tiles(own, width, threshold, levels), threshold), "tiles")
    # Each set first meets the representative with which it shares most tiles.
    votes = tiled.filter("rep <> digest").groupBy("digest", "rep").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("digest").agg(F.max(F.struct("c", "rep")).alias("m")).select(F.col("m.rep").alias("a"), F.col("digest").alias("b"))
    best = scratch.put(plausible(best, signatures, threshold), "best")
    first = scratch.put(verified(best, owners, own, width, threshold, scratch, "best"), "first")
    roots = connected_components(first, scratch, "cc1")

    tried, left = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), tiled
    for k, picks in enumerate((*PICKS, None)):
        rows = scratch.put(open_tiles(left, roots, not k), f"open{k}")
        if rows.isEmpty():
            break
        met = scratch.put(meeting_pairs(rows, signatures, threshold, picks).distinct(), f"met{k}")
        pairs = scratch.put(met.filter(F.col("a").isNotNull()).select("a", "b").join(tried, ["a", "b"], "left_anti"), f"pairs{k}")
        links = scratch.put(verified(pairs, owners, own, width, threshold, scratch, f"pairs{k}"), f"links{k}")
        roots = joined_components(roots, links, scratch, f"cc{k + 2}")
        tried = tried.unionByName(pairs)
        left = rows.join(met.filter(F.col("a").isNull()).select("tile").distinct(), "tile", "left_semi")
    roots = roots.withColumnRenamed("node", "digest")

    classes = owners.select("digest", "doc_id").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    smallest = classes.groupBy("root").agg(F.min("doc_id").alias("component"))
    of_set = scratch.put(classes.join(smallest, "root").select("digest", "component"), "components")
    result = sets.join(maybe_broadcast(of_set), "digest", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "h")


def keep_one_per_component(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, with one document of each component: the one with the smallest id.

    Of several rows with that id and text (repeated rows) one stays as well; rows
    without words all stay, and so do rows with a null id unless linked to one
    that has an id.  Columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    found = similar_components(docs, width, threshold)
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("s"))
    # Where rows of one id differ in text, the smallest hash stands for the id if they are linked.
    chosen = scratch.put(chosen.select(F.col("doc_id").alias("id"), F.col("h").alias("g"), "n", "s"), "chosen")
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("h"), packed_rows(docs).alias("row"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))
    single = rows.join(maybe_broadcast(chosen.filter("n = 1 or s = 0")), same).select("row.*")
    repeated = chosen.filter("n > 1 and s > 0")
    if repeated.isEmpty():
        return single
    once = rows.join(maybe_broadcast(repeated), same).groupBy("id", "g").agg(F.first("row").alias("row"))
    return single.unionByName(once.select("row.*"))
