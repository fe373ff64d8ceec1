"""Media columns: AVI with motion JPEG.

``pack`` stores bytes losslessly as 8-bit samples: every sample is one flat
8x8 block of a baseline grayscale JPEG frame (DC quantiser 8, so the DC
coefficient is the sample itself), and the frames are the ``00dc`` chunks of a
RIFF AVI file with an ``idx1`` index.  The Huffman tables give every block 16
bits, which lets numpy code all blocks at once.  ``unpack`` parses any such
file by its RIFF structure, index and JPEG segments.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import text_or_empty

SIDE = 32  # blocks in a row and in a column of a frame
PER_FRAME = SIDE * SIDE
FPS = 25
UNIT = 64
DC_BITS, BLOCK_BITS = 10, 16


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    """Everything of a frame before its entropy-coded data."""
    quant = bytes([8] + [1] * 63)
    frame = struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0])
    # DC: category c has a code of 10 - c bits, so code and magnitude take 10 bits together.
    dc = bytes(sum(1 for c in range(9) if DC_BITS - c == n) for n in range(1, 17)) + bytes(range(8, -1, -1))
    # AC: end-of-block alone, with 6 bits.
    ac = bytes(int(n == BLOCK_BITS - DC_BITS) for n in range(1, 17)) + b"\0"
    return (
        b"\xff\xd8" + _segment(0xDB, b"\0" + quant) + _segment(0xC0, frame) + _segment(0xC4, b"\x00" + dc) + _segment(0xC4, b"\x10" + ac)
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def huffman_codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, by the canonical rule of JPEG."""
    codes, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return codes


HEAD = _jpeg_head()
TAIL = b"\xff\xd9"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The 16 bits of each difference -255..255 (at difference + 255)."""
    counts = bytes(sum(1 for c in range(9) if DC_BITS - c == n) for n in range(1, 17))
    code_of = {s: (n, c) for (n, c), s in huffman_codes(counts, bytes(range(8, -1, -1))).items()}
    words = np.zeros(511, np.uint16)
    for diff in range(-255, 256):
        cat = abs(diff).bit_length()
        bits = diff if diff >= 0 else diff + (1 << cat) - 1
        words[diff + 255] = (code_of[cat][1] << cat | bits) << (BLOCK_BITS - DC_BITS)
    return words


WORDS = _tables()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _avi_head(frames: int, size: int, payload: int) -> bytes:
    edge = SIDE * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, size * FPS, 0, 0x10, frames, 0, 1, size, edge, edge, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, size, 0xFFFFFFFF, 0, 0, 0, edge, edge)
    strf = struct.pack("<IiiHH4sIiiII", 40, edge, edge, 1, 8, b"MJPG", edge * edge, 0, 0, 0, 0)
    streams = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)
    info = b"INFO" + _chunk(b"ICMT", b"%d" % payload)
    return _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", streams)) + _chunk(b"LIST", info)


def pack(payload: bytes) -> bytes:
    """The AVI file that holds payload's bytes as samples."""
    n = len(payload)
    frames = max(1, -(-n // PER_FRAME))
    samples = np.zeros(frames * PER_FRAME, np.int16)
    samples[:n] = np.frombuffer(payload, np.uint8)
    dc = samples.reshape(frames, PER_FRAME) - 128
    diff = np.diff(dc, axis=1, prepend=np.int16(0))
    coded = WORDS[diff + 255].astype(">u2").view(np.uint8).reshape(frames, -1)
    size = len(HEAD) + 2 * PER_FRAME + len(TAIL)
    size += size % 2
    body = np.zeros((frames, 8 + size), np.uint8)
    body[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), np.uint8)
    body[:, 8 : 8 + len(HEAD)] = np.frombuffer(HEAD, np.uint8)
    body[:, 8 + len(HEAD) : 8 + len(HEAD) + 2 * PER_FRAME] = coded
    at = 8 + len(HEAD) + 2 * PER_FRAME
    body[:, at : at + len(TAIL)] = np.frombuffer(TAIL, np.uint8)
    index = np.empty((frames, 4), "<u4")
    index[:, 0] = np.frombuffer(b"00dc", "<u4")[0]
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.arange(frames, dtype=np.int64) * (8 + size)
    index[:, 3] = size
    riff = b"AVI " + _avi_head(frames, size, n) + _chunk(b"LIST", b"movi" + body.tobytes()) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", riff)


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start of body, size) of the chunks that follow each other in data[start:end]."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > end:
            raise ValueError("a RIFF chunk ends outside its parent")
        yield name, start + 8, size
        start += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """Frame rate, places of the frames by the index, and the comment."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"fps": 0.0, "comment": b"", "frames": []}
    movi = index = None
    todo = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while todo:
        for name, at, size in chunks(data, *todo.pop()):
            if name == b"LIST" and data[at : at + 4] == b"movi":
                movi = (at, size)
            elif name == b"LIST":
                todo.append((at + 4, at + size))
            elif name == b"strh" and data[at : at + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, at + 20)
                found["fps"] = rate / max(scale, 1)
            elif name == b"ICMT":
                found["comment"] = data[at : at + size]
            elif name == b"idx1":
                index = (at, size)
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        rows = np.frombuffer(data, "<u4", index[1] // 16 * 4, index[0]).reshape(-1, 4).astype(np.int64)
        rows = rows[(rows[:, 0] >> 16 == 0x6364) | (rows[:, 0] >> 16 == 0x6264)]  # ..dc and ..db
        # Offsets count from the word "movi" or, in some files, from the file's start.
        base = movi[0] if not len(rows) or rows[0, 2] < movi[0] else 0
        found["frames"] = [(base + int(o) + 8, int(s)) for o, s in rows[:, 2:]]
    else:
        found["frames"] = [(at, size) for name, at, size in chunks(data, movi[0] + 4, movi[0] + movi[1]) if name[2:] in (b"dc", b"db")]
    return found


def parse_jpeg(data: bytes, start: int, size: int) -> dict:
    """Tables and geometry of a baseline one-component frame, and where its coded data begins."""
    found: dict = {"quant": {}, "codes": {}}
    at = start + 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                found["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                found["codes"][body[0]] = huffman_codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            found["height"], found["width"], parts = struct.unpack_from(">HHB", body, 1)
            if parts != 1:
                raise ValueError("only one component is supported")
            found["table"] = body[8]
        elif marker == 0xDA:
            found["dc"], found["ac"] = body[2] >> 4, 0x10 | body[2] & 15
            found["start"], found["end"] = at + 2 + length, start + size
            return found
        at += 2 + length


#: Place in the block, row by row, of each coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
_K = np.arange(8)
COSINE = np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16) * np.where(_K == 0, np.sqrt(0.125), 0.5)


def decode_frame(data: bytes, start: int, size: int) -> np.ndarray:
    """Samples of any baseline one-component frame, block by block (blocks, 8, 8)."""
    head = parse_jpeg(data, start, size)
    raw = data[head["start"] : head["end"]]
    raw = raw[: raw.rfind(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    bits, total = int.from_bytes(raw, "big"), len(raw) * 8
    at = 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        return bits >> (total - at) & ((1 << n) - 1)

    def symbol(codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")

    def number(cat: int) -> int:
        v = take(cat) if cat else 0
        return v if not cat or v >> (cat - 1) else v - (1 << cat) + 1

    blocks = -(-head["height"] // 8) * -(-head["width"] // 8)
    coefficients = np.zeros((blocks, 64))
    dc = 0
    for b in range(blocks):
        dc += number(symbol(head["codes"][head["dc"]]))
        coefficients[b, 0] = dc
        k = 1
        while k < 64:
            s = symbol(head["codes"][head["ac"]])
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                coefficients[b, ZIGZAG[k]] = number(s & 15)
            k += 1
    quant = np.zeros(64)
    quant[ZIGZAG] = head["quant"][head["table"]]
    freq = (coefficients * quant).reshape(-1, 8, 8)
    return np.clip(np.rint(COSINE @ freq @ COSINE.T) + 128, 0, 255).astype(np.uint8)


_DIFF: dict[bytes, np.ndarray] = {}


def _block_words(head: dict) -> np.ndarray | None:
    """The difference that each 16 bits stand for, if the tables give every block 16 bits."""
    dc, ac = head["codes"].get(head["dc"]), head["codes"].get(head["ac"])
    if not ac or {n for n, _ in ac} != {BLOCK_BITS - DC_BITS} or set(ac.values()) != {0} or any(n + s != DC_BITS for (n, _), s in dc.items()):
        return None
    end = next(c for _, c in ac)
    table = np.full(1 << 16, 1 << 14, np.int16)
    for (n, code), cat in dc.items():
        for v in range(1 << cat):
            word = (code << cat | v) << (BLOCK_BITS - DC_BITS) | end
            table[word] = v if not cat or v >> (cat - 1) else v - (1 << cat) + 1
    return table


def decode_frames(data: bytes, frames: list[tuple[int, int]]) -> np.ndarray:
    """Each frame's samples, one for a block (its mean), as uint8 (frames, blocks)."""
    if not frames:
        return np.zeros((0, 0), np.uint8)
    start, size = frames[0]
    head = parse_jpeg(data, start, size)
    lead = head["start"] - start
    key = data[start : head["start"]]
    if key not in _DIFF:
        _DIFF.clear()
        _DIFF[key] = _block_words(head)
    table = _DIFF[key]
    blocks = -(-head["height"] // 8) * -(-head["width"] // 8)
    even = table is not None and all(s == size for _, s in frames) and lead + 2 * blocks + 2 <= size
    if even:
        offsets = np.array([a for a, _ in frames], np.int64)
        step = int(offsets[1] - offsets[0]) if len(offsets) > 1 else size
        whole = np.frombuffer(data, np.uint8)
        even = bool((np.diff(offsets) == step).all()) and step >= size
        if even:
            view = np.lib.stride_tricks.as_strided(whole[offsets[0] :], (len(frames), size), (step, 1), writeable=False)
            even = bool((view[:, :lead] == np.frombuffer(key, np.uint8)).all())
        if even:
            coded = view[:, lead : lead + 2 * blocks].copy()
            even = not (coded == 0xFF).any()  # else there are stuffed bytes or markers
        if even:
            diff = table[coded.view(">u2")]
            if (diff == 1 << 14).any():
                raise ValueError("no such Huffman code")
            q = head["quant"][head["table"]][0]
            return ((np.cumsum(diff, axis=1) * q) // 8 + 128).astype(np.uint8)
    return np.stack([decode_frame(data, a, s).reshape(blocks, 64).mean(axis=1).round().astype(np.uint8) for a, s in frames])


def unpack(data: bytes) -> tuple[bytes, np.ndarray, float]:
    """The payload, the decoded frames and the frame rate of a file that ``pack`` made."""
    avi = parse_avi(data)
    samples = decode_frames(data, avi["frames"])
    return samples.tobytes()[: int(avi["comment"])], samples, avi["fps"]


def shots(samples: np.ndarray, window: int = 12, sigmas: float = 3.0, floor: float = 0.2) -> list[int]:
    """First frames of the shots.

    A cut is where the histogram difference (0 to 1) to the frame before exceeds
    ``floor`` and the mean of the last ``window`` differences by ``sigmas`` deviations.
    """
    n = len(samples)
    if n < 2:
        return [0][:n]
    codes = (np.arange(n)[:, None] * 16 + (samples >> 4)).ravel()
    hist = np.bincount(codes, minlength=16 * n).reshape(n, 16)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * samples.shape[1])
    sums = np.concatenate([[0.0], np.cumsum(diff)])
    squares = np.concatenate([[0.0], np.cumsum(diff * diff)])
    at = np.arange(len(diff))
    low = np.maximum(at - window, 0)
    k = np.maximum(at - low, 1)
    mean = (sums[at] - sums[low]) / k
    deviation = np.sqrt(np.maximum((squares[at] - squares[low]) / k - mean * mean, 0))
    cut = (diff > floor) & (diff > mean + sigmas * deviation)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def clips(samples: np.ndarray, fps: float) -> list[tuple[int, float, float, int]]:
    """(clip, start second, end second, frames) of each shot."""
    starts = shots(samples)
    ends = [*starts[1:], len(samples)]
    return [(i, a / fps, b / fps, b - a) for i, (a, b) in enumerate(zip(starts, ends))]


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text as an AVI file (binary column).

    A null text counts as empty and is stored as 64 zero bytes; other columns are
    not read; repeated rows give repeated files.  A map over partitions.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # media are larger than texts
                part = batch.slice(at, 512)
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([pack(p) for p, _ in made], pa.binary())], names=out.names
                )

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).mapInArrow(run, out)


CLIP = T.ArrayType(T.StructType([T.StructField("clip", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("frames", T.IntegerType())]))


def read_media(media: DataFrame, digests: bool = True) -> DataFrame:
    """Reads AVI files back: per row ``clips`` (array of timed clips) and, with ``digests``, what the stored bytes hold.

    Rows with a null or unreadable file get null results.
    """
    out = T.StructType(
        [media.schema["doc_id"], T.StructField("n_bytes", T.LongType())]
        + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
        + [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("clips", CLIP)]
    )

    def one(data: bytes | None):
        try:
            payload, samples, fps = unpack(data)
        except (TypeError, ValueError, IndexError, KeyError, struct.error):
            return (None,) * 7
        found = clips(samples, fps)
        feature = f"frames={len(samples)};clips=" + ",".join(f"{a:.2f}-{b:.2f}" for _, a, b, _ in found)
        sha = lambda b: hashlib.sha256(b).hexdigest() if digests else None
        return (
            len(payload), sha(payload), zlib.crc32(payload[-UNIT:]), len(data), sha(data), feature,
            [{"clip": i, "start_s": a, "end_s": b, "frames": n} for i, a, b, n in found],
        )

    arrow = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(m) for m in batch.column(2).to_pylist()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=out.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, out)


def clip_rows(read: DataFrame) -> DataFrame:
    """One row per clip: ``doc_id, clip, start_s, end_s, frames``."""
    return read.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
