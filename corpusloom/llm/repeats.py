"""Repeated passages: bytes covered by a string of ``LENGTH`` bytes that also starts earlier in the corpus.

Anchors bring equal strings together. The anchor of a 100-byte window is the smallest hash among its 20-byte grams
(leftmost on ties), which depends on the window's bytes alone: equal windows have equal anchors, at equal distances. A
segment is a run of windows with the same anchor position, about 120 bytes; a document is a chain of segments.

1. Segments (anchor, hash of the segment, place) are counted by anchor; anchors that occur once are dropped - most.
2. Of equal segments the earliest place stays; every window of the others starts earlier there, so they are marked whole.
3. What is left is anchors with several different segments (the borders of repeated passages): their bytes are fetched,
   one copy each, and dealt by anchor into buckets of bounded size. In a bucket the segments of an anchor, in corpus order,
   are halved again and again: the earlier half is put into a run-compressed Burrows-Wheeler index, the later half is
   streamed through it, and a window whose matching statistic reaches its length starts earlier. One index serves all
   anchors of a bucket: a tag inside the anchor's gram, so inside every window, keeps halves of other anchors apart.
   Large halves come first and what is found leaves; bytes that all windows of a piece have in common (81 at least) must
   be in both halves, else the piece is neither indexed nor streamed. So the work grows with what repeats, not with the
   number of halvings. Hashes only leave out what cannot repeat; the index decides.
   The index holds runs and the text positions at their two ends, no suffix array and no ranks: a statistic is carried
   by LF steps, and where the run's symbol differs, by the nearer run end of the right symbol.
   An anchor with more than ``BUCKET_ROWS / 2`` different segments does not fit a task; its windows are hashed (128 bits) and
   the first place of each is found by an aggregation. Both ways give the same marks.
4. Marks meet their documents, are merged, and the rest is hashed.

Equality of segments in step 2 is by two independent 64-bit hashes. Skew: counts and first places are combined before
they are shuffled, and the joins on anchors are split by adaptive execution.

Cases: null text counts as empty; texts under 100 bytes lose nothing; rows without an id take no part (nothing is removed,
nor found in them); rows that share a doc_id share its places, so they are not removed against each other; extra columns
are ignored; an empty table gives an empty result; repeated rows share one place each. Very long texts are anchored in
overlapping blocks, so memory is bounded. Ties for the first place cannot occur: places are distinct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as T
from corpusloom.llm.shared import stage

LENGTH, GRAM = 100, 20
BUCKET_ROWS = 20_000
_PLACE = 23  # bits for a position inside a block


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(T._BYTE[data] * T._powers(T._MUL, len(data)), out=total[1:])
    return total


def segments(data: np.ndarray, off: np.ndarray, only_anchors: bool = False) -> tuple[np.ndarray, ...]:
    """Row, start in the slice, length, anchor and hash of every segment of a slice of texts (below 8 MB); or, without
    the cost of the rest, just the anchors in their place."""
    windows = len(data) - LENGTH + 1
    z = np.zeros(0, dtype=np.int64)
    if windows <= 0:
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    total = _prefix(data)
    inverse = T._powers(T._INV, len(data) + 1)
    with np.errstate(over="ignore"):
        gram = T.mix((total[GRAM:] - total[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    n = len(gram)
    key = (gram >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(n, dtype=np.uint64)
    # smallest of each ``width`` neighbours: suffix and prefix minima of blocks
    width = LENGTH - GRAM + 1
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
    at = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    # the last 99 positions of a row start no window, so runs of valid windows never join two rows
    valid = np.arange(LENGTH, LENGTH + windows) <= np.repeat(off[1:], np.diff(off))[:windows]
    change = at[1:] != at[:-1]
    first, last = valid.copy(), valid.copy()
    first[1:] &= ~valid[:-1] | change
    last[:-1] &= ~valid[1:] | change
    s = np.flatnonzero(first)
    if only_anchors:
        return z, z, z, gram[at[s]], z
    e = np.flatnonzero(last) + LENGTH
    with np.errstate(over="ignore"):
        whole = T.mix(T.mix((total[e] - total[s]) * inverse[s]) + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.searchsorted(off, s, side="right") - 1, s, e - s, gram[at[s]], whole


_SEGMENT = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("len", pa.int32())])
_SEGMENT_SQL = "anchor long, seg long, doc_id long, start long, len int"


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a batch in slices, a longer row in overlapping blocks: lo, hi, block start, bytes, offsets of the
    bytes, offsets of the rows."""
    data, off = T.buffers(b.column("text"))
    step = 4 << 20
    for lo, hi, part, o in T.slices(data, off, 2 << 20):
        for block in range(0, max(1, len(part)), step):  # one block, but for a row longer than that
            piece = part[block : block + step + LENGTH - 1]
            yield lo, hi, block, piece, o if len(part) <= step else np.array([0, len(piece)]), o


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, _, piece, inside, _ in _pieces(b):
            anchor = segments(piece, inside, only_anchors=True)[3]
            if len(anchor):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], names=["anchor"])


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, hi, block, piece, inside, o in _pieces(b):
            row, s, n, anchor, whole = segments(piece, inside)
            if len(s):
                arrays = [anchor.view(np.int64), whole.view(np.int64), ids[lo:hi][row], s + block - o[row], n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=_SEGMENT)


def _usable(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")


def anchored(docs: DataFrame) -> DataFrame:
    """anchor, seg, doc_id, start, len of every segment of every text."""
    return _usable(docs).mapInArrow(_segment_batches, _SEGMENT_SQL)


def anchors(docs: DataFrame) -> DataFrame:
    """The anchor of every segment, alone."""
    return _usable(docs).mapInArrow(_anchor_batches, "anchor long")


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings of symbols, each closed by a separator (0) of its own.

    Kept are the text and, for every run: its first row, its symbol, the row its first row goes to by LF, and the text
    positions of its first and last suffix. The suffix order is needed to build the runs and dropped then.
    """

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        ends = np.flatnonzero(text == 0)
        left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)  # symbols before the next separator
        order = _suffix_order(text, left)
        bwt = text[order - 1]  # the text is read as a circle
        self.start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.symbol = bwt[self.start]
        stop = np.append(self.start[1:], n)
        self.first, self.last, self.stop = order[self.start], order[stop - 1], stop - 1
        by = np.argsort(self.symbol, kind="stable")
        width = (stop - self.start)[by]
        # rows are grouped by their first symbol, so a run's rows go behind those of the runs of its symbol before it
        self.goes = np.zeros(len(by), dtype=np.int64)
        self.goes[by] = np.cumsum(width) - width
        self.runs = self.symbol[by] * len(by) + by  # runs by symbol, then by row
        self.text = np.concatenate([text, np.zeros(64, dtype=np.int64)]).astype(np.int16)

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that the texts at ``a`` and ``b`` share, ``most`` at most."""
        out = np.zeros(len(a), dtype=np.int64)
        open_ = np.flatnonzero(most > 0)
        width = 8
        while len(open_):
            j = np.arange(width)
            at = out[open_, None] + j
            limit = len(self.text) - 1
            same = self.text[np.minimum(a[open_, None] + at, limit)] == self.text[np.minimum(b[open_, None] + at, limit)]
            run = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[open_] += run
            open_ = open_[(run == width) & (out[open_] < most[open_])]
            width = 32
        return np.minimum(out, most)

    def reaches(self, text: np.ndarray, length: int) -> np.ndarray:
        """Positions of ``text`` (strings closed by separators) at which the matching statistic is ``length`` or more."""
        ends = np.flatnonzero(text == 0)
        left = np.diff(np.concatenate([[-1], ends])) - 1  # symbols still to come
        at = ends
        # of every string: a row of the index, the text position of its suffix, and how far that agrees
        row, pos, size = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.first[0]), np.zeros(len(ends), dtype=np.int64)
        found, n = [], len(self.start)
        while True:
            # a statistic grows by one a step: a string that cannot reach the length any more is done
            going = (left > 0) & (size + left >= length)
            if not going.all():
                left, at, row, pos, size = left[going], at[going], row[going], pos[going], size[going]
            if not len(at):
                break
            left, at = left - 1, at - 1
            c = text[at]
            run = np.searchsorted(self.start, row, side="right") - 1
            off = np.flatnonzero(self.symbol[run] != c)
            if len(off):
                self._jump(off, c[off], run, row, pos, size)
            row, pos, size = self.goes[run] + row - self.start[run], pos - 1, np.minimum(size + 1, length)
            size[size < 1] = 0  # the index lacks the symbol: nothing agrees, whatever the row
            found.append(at[size >= length])
        return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def _jump(self, off: np.ndarray, c: np.ndarray, run: np.ndarray, row: np.ndarray, pos: np.ndarray, size: np.ndarray) -> None:
        """Move the states ``off`` to the end of a run of symbol ``c`` nearest to their row, above or below, that agrees longer."""
        n = len(self.start)
        q = np.searchsorted(self.runs, c * n + run[off])
        here, most, best = pos[off], size[off], np.full(len(off), -1)
        for at, rows, places in ((np.maximum(q - 1, 0), self.stop, self.last), (np.minimum(q, n - 1), self.start, self.first)):
            there = np.flatnonzero(self.runs[at] // n == c)
            other = self.runs[at[there]] % n
            fit = self._common(here[there], places[other], most[there])
            better = fit > best[there]
            w, other = there[better], other[better]
            best[w], run[off[w]], row[off[w]], pos[off[w]] = fit[better], other, rows[other], places[other]
        size[off] = np.where(best < 0, -1, best)


def _suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling from packs of seven symbols (below 512); only groups that are
    still tied are sorted again. Suffixes equal up to their separators are in the order of these."""
    n, depth = len(text), 7
    key = np.zeros(n, dtype=np.int64)
    for j in range(depth):
        shifted = np.zeros(n, dtype=np.int64)
        shifted[: max(n - j, 0)] = text[j:]
        key = key * 512 + np.where(left >= j, shifted, 0)
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.zeros(n, dtype=np.int64)
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[order] = group
    while True:
        tied = np.zeros(n, dtype=bool)
        tied[1:] |= group[1:] == group[:-1]
        tied[:-1] |= group[1:] == group[:-1]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        at = order[rows]
        # tied suffixes that hold their separator are in the order of their separators, others go by what follows
        key = group[rows] * np.int64(2 * n + 1) + np.where(left[at] < depth, at, n + rank[np.minimum(at + depth, n - 1)])
        again = np.argsort(key)
        order[rows] = at[again]
        k = key[again]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        group[rows] = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[order[rows]] = group[rows]
        depth *= 2


#: A tag has so many symbols, each one of 64 beyond the bytes.
TAG = 3


#: Windows with so many neighbouring places of the anchor share a core, the bytes that are in all of them.
CORE = 20


class _Bucket:
    """Segments in corpus order, with the place of the anchor in each. A window goes by the place of its first byte."""

    def __init__(self, bodies: list[bytes], anchor: np.ndarray) -> None:
        self.data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(b) for b in bodies], dtype=np.int64)])
        self.total, self.inverse = _prefix(self.data), T._powers(T._INV, len(self.data) + 1)
        n = len(self.data) - GRAM + 1
        with np.errstate(over="ignore"):
            gram = T.mix((self.total[GRAM:] - self.total[:-GRAM]) * self.inverse[:n])
        row = np.repeat(np.arange(len(bodies)), np.diff(self.off))[:n]
        hit = np.flatnonzero((gram == anchor.view(np.uint64)[row]) & (np.arange(n) + GRAM <= self.off[row + 1]))
        which, first = np.unique(row[hit], return_index=True)
        self.at = self.off[:-1].copy()
        self.at[which] = hit[first]

    def pieces(self) -> tuple[np.ndarray, ...]:
        """Segment, first window, last window and hash of the core of every piece, in order: a piece is the windows of a
        segment that share a core. Equal windows are in pieces of equal cores."""
        parts = []
        for j in range(0, LENGTH - GRAM + 1, CORE):
            most = min(j + CORE - 1, LENGTH - GRAM)  # the anchor is j to most bytes behind the first of the window
            first, last = np.maximum(self.off[:-1], self.at - most), np.minimum(self.off[1:] - LENGTH, self.at - j)
            row = np.flatnonzero(first <= last)
            s, e = self.at[row] - j, self.at[row] - most + LENGTH
            with np.errstate(over="ignore"):
                core = T.mix((self.total[e] - self.total[s]) * self.inverse[s] + np.uint64(j))
            parts.append((row, first[row], last[row], core))
        row, first, last, core = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(first)
        return row[by], first[by], last[by], core[by]

    def common(self, row: np.ndarray, first: np.ndarray, last: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """A hash of the pair and of the bytes that are in all windows of these pieces, where those of a pair are taken to
        have the windows of all of them. Pieces that were cut alike have more such bytes than their core."""
        least, most = np.full(pair.max() + 1, LENGTH), np.zeros(pair.max() + 1, dtype=np.int64)
        np.minimum.at(least, pair, self.at[row] - last)
        np.maximum.at(most, pair, self.at[row] - first)
        s, e = self.at[row] - least[pair], self.at[row] - most[pair] + LENGTH
        with np.errstate(over="ignore"):
            return T.mix((self.total[e] - self.total[s]) * self.inverse[s]) + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def _met(key: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every key, and the rows whose key is in both halves."""
        number = np.unique(key, return_inverse=True)[1]
        met = (np.bincount(number, late) > 0) & (np.bincount(number, 1 - late) > 0)
        return number, np.flatnonzero(met[number])

    def tagged(self, row: np.ndarray, first: np.ndarray, last: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of these runs of windows, each with its tag behind its anchor's first byte and closed; and where each starts."""
        size, at = last + LENGTH - first, self.at[row] - first
        base = np.cumsum(size + TAG + 1) - (size + TAG + 1)
        r = np.repeat(np.arange(len(row)), size)
        j = np.arange(len(r)) - (np.cumsum(size) - size)[r]
        out = np.zeros(int((size + TAG + 1).sum()), dtype=np.int64)
        out[base[r] + j + TAG * (j > at[r])] = self.data[first[r] + j].astype(np.int64) + 1
        for d in range(TAG):
            out[base + at + 1 + d] = 257 + ((tag >> (6 * d)) & 63)
        return out, base

    def earlier(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, offset) of every window that also starts in an earlier segment of its group.

        The largest halves come first. A window that is found leaves: what repeats it later repeats the earlier one as well. Of
        the rest, only pieces whose core is in both halves, and what all of their windows have in common, are indexed and
        streamed, so that the work follows what repeats.
        """
        row, first, last, core = self.pieces()
        with np.errstate(over="ignore"):
            core = core + group.astype(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15)
        _, same, n = np.unique(core, return_inverse=True, return_counts=True)
        row, first, last, same = (x[n[same] > 1] for x in (row, first, last, same))
        kept = np.unique(row)  # segments with a core that is in another one
        by = kept[np.argsort(group[kept], kind="stable")]
        head = np.concatenate([[True], group[by][1:] != group[by][:-1]])[: len(by)]
        rank = np.zeros(len(group), dtype=np.int64)
        rank[by] = np.arange(len(by)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        places = []
        for level in reversed(range(int(rank.max(initial=0)).bit_length())):
            # a core is in one group, so with the number of the halves it says which halves
            late = (rank[row] >> level) & 1
            pair, use = self._met(same * (len(group) + 1) + (rank[row] >> (level + 1)), late)
            if len(use):
                use = use[self._met(self.common(row[use], first[use], last[use], pair[use]), late[use])[1]]
            if not len(use):
                continue
            # neighbouring pieces of a segment make one run
            new = np.concatenate([[True], (row[use][1:] != row[use][:-1]) | (first[use][1:] != last[use][:-1] + 1)])
            r, lo, hi = row[use][new], first[use][new], last[use][np.append(np.flatnonzero(new)[1:], len(use)) - 1]
            tag = np.unique(group[r] * (len(group) + 1) + (rank[r] >> (level + 1)), return_inverse=True)[1]
            early = late[use][new] == 0
            index = RunIndex(self.tagged(r[early], lo[early], hi[early], tag[early])[0])
            text, base = self.tagged(r[~early], lo[~early], hi[~early], tag[~early])
            found = index.reaches(text, LENGTH + TAG)
            if not len(found):
                continue
            at = np.searchsorted(base, found, side="right") - 1
            found = found - base[at] + lo[~early][at]
            places.append(found)
            # cut what is found from the two ends of its piece
            piece = np.searchsorted(first, found, side="right") - 1
            new = np.concatenate([[True], (found[1:] != found[:-1] + 1) | (piece[1:] != piece[:-1])])
            piece, lo, hi = piece[new], found[new], found[np.append(np.flatnonzero(new)[1:], len(found)) - 1]
            front, back = lo == first[piece], hi == last[piece]
            first[piece[front]], last[piece[back]] = hi[front] + 1, lo[back] - 1
            row, first, last, same = (x[first <= last] for x in (row, first, last, same))
        place = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        which = np.searchsorted(self.off, place, side="right") - 1
        return which, place - self.off[which]


def _cutter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the wanted segments of each text."""
    for b in batches:
        rows = []
        for doc, text, want in zip(b["doc_id"], b["text"], b["want"]):
            raw = text.encode()
            rows += [(w["anchor"], doc, w["start"], raw[w["start"] : w["start"] + w["len"]]) for w in want]
        yield pd.DataFrame(rows, columns=["anchor", "doc_id", "start", "body"])


def _marks(doc: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Windows at these starts, as maximal runs (doc_id, start, len)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if len(doc) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return pd.DataFrame({"doc_id": doc[first], "start": start[first], "len": (start[last] + LENGTH - start[first])}).astype("int64")


def _indexed(rows: pd.DataFrame) -> pd.DataFrame:
    # a row that is there twice has one place, not an earlier one
    rows = rows.drop_duplicates(["anchor", "doc_id", "start"]).sort_values(["doc_id", "start"], kind="stable")
    doc, start, anchor = rows["doc_id"].to_numpy(), rows["start"].to_numpy(), rows["anchor"].to_numpy()
    which, offset = _Bucket(rows["body"].tolist(), anchor).earlier(np.unique(anchor, return_inverse=True)[1])
    return _marks(doc[which], start[which] + offset)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of a segment under a 128-bit hash."""
    for b in batches:
        rows = []
        for doc, start, body in zip(b["doc_id"], b["start"], b["body"]):
            rows += [(hashlib.blake2b(body[i : i + LENGTH], digest_size=16).digest(), doc, start + i) for i in range(len(body) - LENGTH + 1)]
        yield pd.DataFrame(rows, columns=["window", "doc_id", "start"])


_FINAL = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remover(keep_bytes: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in _FINAL]
            data, off = T.buffers(b.column("text"))
            lists = b.column("marks")
            bounds, flat = lists.offsets.to_numpy(), lists.values
            start, size = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "len"))
            row = np.repeat(np.arange(len(lists)), np.diff(bounds))
            start, size = start[bounds[0] : bounds[-1]], size[bounds[0] : bounds[-1]]
            order = np.lexsort((start, row))
            first = (bounds - bounds[0]).tolist()
            pairs = list(zip(start[order].tolist(), (start + size)[order].tolist()))
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                raw = data[off[i] : off[i + 1]].tobytes()
                spans: list[list[int]] = []
                for m in pairs[first[i] : first[i + 1]]:
                    if spans and m[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m[1])
                    else:
                        spans.append(list(m))
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                rest = b"".join([*kept, raw[at:]])
                for c, v in zip(cols, (doc, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FINAL)], schema=_FINAL)

    return remove


def without_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if asked for) the kept bytes of every document."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    segs = anchored(texts)
    # written first: with two plain exchanges below the join, adaptive execution can split an anchor with very many rows
    often = stage(anchors(texts).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    repeated = stage(segs.join(often, "anchor"), "repeated")
    place = F.struct("doc_id", "start")
    kinds = stage(repeated.groupBy("anchor", "seg").agg(F.min(place).alias("first"), F.max("len").alias("len"), F.count(F.lit(1)).alias("n")), "kinds")
    again = repeated.join(kinds.where("n > 1").select("anchor", "seg", "first"), ["anchor", "seg"]).where(place != F.col("first")).select("doc_id", "start", F.col("len").cast("long"))
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_kinds")).where("n_kinds > 1")
    several = kinds.select("anchor", "first.*", "len").join(several, "anchor")
    total = several.count()
    wanted = several.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "len")).alias("want"))
    bodies = texts.join(wanted, "doc_id").mapInPandas(_cutter, "anchor long, doc_id long, start long, body binary")
    bodies = stage(bodies, "bodies")
    hot = several.where(f"n_kinds > {BUCKET_ROWS // 2}").select("anchor").distinct()
    buckets = max(1, -(-2 * total // BUCKET_ROWS))
    cold = bodies.join(hot, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    found = cold.groupBy("bucket").applyInPandas(_indexed, "doc_id long, start long, len long")
    # both written first, so that a window which thousands of segments share can be split in the join
    windows = stage(bodies.join(hot, "anchor", "left_semi").mapInPandas(_windows, "window binary, doc_id long, start long"), "windows")
    least = stage(windows.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    late = windows.join(least, "window").where(place != F.col("first")).select("doc_id", "start", F.lit(LENGTH).cast("long").alias("len"))
    marks = again.union(found).union(late).groupBy("doc_id").agg(F.collect_list(F.struct("start", "len")).alias("marks"))
    out = texts.join(marks, "doc_id", "left").mapInArrow(_remover(keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")
