"""Pack token sequences into windows of 1024 with almost no padding, by non-negative least squares.

A document's ids (and the closing id 0) are cut at multiples of the window; full pieces fill a window each. What is
left of each document is a piece shorter than the window. The histogram of those lengths (at most 1023 numbers) goes to
the driver, where windows are planned:

1. enumerate the shallow combinations (two or three lengths) that fill a window exactly;
2. solve for repeat counts x >= 0 with  A x ~ histogram  (projected gradient with momentum on the sparse columns);
3. round down, never beyond what the histogram holds, and use further exact combinations greedily for the remainder;
4. lay the residual pieces end to end, longest first, and cut them at window ends. The last, partial window is split
   at powers of two, which need no padding.

A plan says for each length which ranks go to which windows and offsets: it is a few thousand rows at most, so it is
broadcast. The rank of a piece among those of its length comes from counts of (length, bucket) and a row number inside a
bucket, so no length, however frequent, meets in one task. Ids of short pieces travel as 16-bit values where the
vocabulary allows, since a residual piece may still be cut.

Cases: null and empty texts have the single id 0; repeated rows are packed as documents of their own; null doc_ids are
kept; extra columns are ignored; an empty table gives an empty result; texts of any length are tokenised whole.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import stage

WINDOW, END_ID = 1024, 0
#: Pieces of a bucket, about: pieces are ranked by (length, bucket), and one length may hold most of them.
BUCKET_ROWS = 20_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: The special token of the vocabulary; a text that spells it takes the slow path.
SPECIAL = "<|endoftext|>"


@functools.cache
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)




def encode(text: str, paths: tuple[str, str]) -> np.ndarray:
    """The tokenizer's ids. The rank file has the same vocabulary and merges, and gives the same ids three times as fast;
    texts with the special token's spelling, or on which it gives up, go to the tokenizer itself."""
    if SPECIAL not in text:
        try:
            return np.asarray(_fast(paths[1]).encode_ordinary(text), dtype=np.uint32)
        except Exception as e:  # the pattern's backtracking limit, on huge runs of blanks
            if isinstance(e, (ImportError, OSError, MemoryError)):
                raise
    return np.asarray(_exact(paths[0]).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _pieces(window: int, paths: tuple[str, str], keep_full: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, cols, size = b.column("doc_id").to_pylist(), [[] for _ in range(6)], 0
            for doc, text in zip(docs, b.column("text")):
                ids = np.append(encode(text.as_py() or "", paths), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    raw = part.tobytes() if keep_full or len(part) < window else None
                    for c, v in zip(cols, (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), raw and _small(part))):
                        c.append(v)
                    size += len(raw or b"")
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE)], schema=_PIECE)
                    cols, size = [[] for _ in range(6)], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE)], schema=_PIECE)

    return cut


def _small(ids: np.ndarray) -> bytes:
    """16-bit ids where they fit, after a byte that tells."""
    return b"\x02" + ids.astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype("<u4")


def patterns(window: int = WINDOW) -> np.ndarray:
    """All combinations of two or three lengths that fill the window, as rows of three (0 where there are two)."""
    a = np.arange(1, window // 2 + 1)
    two = np.stack([window - a, a, np.zeros_like(a)], axis=1)
    x, y = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    z = window - x - y
    ok = (x >= y) & (y >= z) & (z >= 1)
    return np.concatenate([two, np.stack([x[ok], y[ok], z[ok]], axis=1)]) if ok.any() else two


def solve(hist: np.ndarray, combos: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises the squared error of A x against the histogram; column p of A counts the lengths of combos[p]."""
    n = len(hist)
    flat = combos.ravel()
    weight = (combos > 0).astype(float).ravel()
    apply = lambda x: np.bincount(flat, np.repeat(x, 3) * weight, n)
    back = lambda r: (r[flat] * weight).reshape(-1, 3).sum(1)
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A, by power iteration
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(apply(y) - hist) / (1.02 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """hist[L]: pieces of length L < window. Rows (length, first rank, last rank + 1, first sequence, offset, position) and the
    number of sequences. position is -1, or the place in the residual line of the first rank, which then is laid out in
    steps of the length and cut at window ends."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    combos = patterns(window)
    present = (left[combos[:, 0]] > 0) & (left[combos[:, 1]] > 0) & ((combos[:, 2] == 0) | (left[combos[:, 2]] > 0))
    combos = combos[present]
    used, rows, sequence = np.zeros(window, dtype=np.int64), [], 0

    def take(combo: np.ndarray, most: int | None) -> None:
        nonlocal sequence
        lengths, times = np.unique(combo[combo > 0], return_counts=True)
        n = int((left[lengths] // times).min())
        n = n if most is None else min(n, most)
        if n <= 0:
            return
        at = 0
        for length in combo[combo > 0].tolist():
            rows.append((length, int(used[length]), int(used[length]) + n, sequence, at, -1))
            used[length] += n
            left[length] -= n
            at += length
        sequence += n

    if len(combos):
        x = solve(left.astype(float), combos)
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 1:
                break
            take(combos[p], int(x[p]))
        for p in np.argsort(-x, kind="stable"):  # what rounding has left over, by exact combinations
            take(combos[p], None)
    at = 0
    for length in range(window - 1, 0, -1):
        if left[length]:
            rows.append((length, int(used[length]), int(used[length] + left[length]), sequence, 0, at))
            at += int(left[length]) * length
    whole, rest = divmod(at, window)
    return rows, sequence + whole + bin(rest).count("1")


def _residual(at: int, total: int, first: int, window: int) -> tuple[int, int, int]:
    """Sequence, offset and room at a position of the residual line of ``total`` ids."""
    k, r = divmod(at, window)
    if k < total // window:
        return first + k, r, window - r
    rest, base, n = total % window, 0, 0
    for bit in range(window.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            if r < base + (1 << bit):
                return first + k + n, r - base, base + (1 << bit) - r
            base, n = base + (1 << bit), n + 1
    raise AssertionError("beyond the residual line")


_OUT = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])
_OUT_SQL = _PIECE_SQL + ", sequence_id long, offset long"


def _placer(window: int, line: int, first: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = np.flatnonzero(b.column("position").to_numpy(zero_copy_only=False) >= 0)
            stay = b.column("position").to_numpy(zero_copy_only=False) < 0
            if stay.any():
                yield pa.RecordBatch.from_arrays([b.column(n).filter(pa.array(stay)) for n in _OUT.names], schema=_OUT)
            cols = [[] for _ in _OUT.names]
            for i in cut.tolist():
                r = {n: b.column(n)[i].as_py() for n in (*_PIECE.names, "position")}
                ids, at = unpack_ids(r["ids"]), 0
                while at < len(ids):
                    seq, offset, room = _residual(r["position"] + at, line, first, window)
                    part = ids[at : at + room]
                    for c, v in zip(cols, (r["doc_id"], r["start"] + at, len(part), zlib.crc32(part.tobytes()), r["doc_tokens"], _small(part), seq, offset)):
                        c.append(v)
                    at += len(part)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    return place


def pack(docs: DataFrame, window: int = WINDOW, paths: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (null for full pieces unless ``keep_ids``),
    sequence_id, offset. ``window`` is a power of two."""
    spark = docs.sparkSession
    kept = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = stage(kept.mapInArrow(_pieces(window, paths or tokenizer_paths(), keep_ids), _PIECE_SQL), "pieces")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(pieces.count() // BUCKET_ROWS + 1)).cast("int"))
    counts = stage(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    hist = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        hist[r["length"]] = r["n"]
    rows, sequences = plan(hist[:window], window)
    line = sum((b - a) * length for length, a, b, _, _, at in rows if at >= 0)
    first = min((s for _, _, _, s, _, at in rows if at >= 0), default=0)
    if hist[window]:
        rows.append((window, 0, int(hist[window]), sequences, 0, -1))
    slots = spark.createDataFrame(rows or [(0, 0, 0, 0, 0, 0)], "length long, rank_from long, rank_to long, sequence long, slot_offset long, line_at long")
    below = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.select("length", "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("below"))
    # equal rows are interchangeable; the order is total otherwise, so a lost task is redone alike
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    ranked = pieces.withColumn("row", F.row_number().over(inside)).join(below, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("below") + F.col("row") - 1)
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= rank_from and rank < rank_to")  # each rank has one slot
    step = F.col("rank") - F.col("rank_from")
    placed = placed.select(
        *_PIECE.names,
        (F.col("sequence") + F.when(F.col("line_at") < 0, step).otherwise(0)).alias("sequence_id"),
        F.col("slot_offset").alias("offset"),
        F.when(F.col("line_at") >= 0, F.col("line_at") + step * F.col("length")).otherwise(F.lit(-1)).alias("position"),
    )
    return placed.mapInArrow(_placer(window, line, first), _OUT_SQL)
