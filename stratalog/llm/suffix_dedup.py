"""Exact substring deduplication by suffix arrays.

A byte is removed if it is covered by a string of `window` bytes that also starts earlier (in a document
with a smaller doc_id, or earlier in the same one); strings are judged on the input.

1. Anchors. In each window of 100 bytes the smallest (leftmost on ties) hash of its GRAM-byte strings
   is its anchor; equal windows have equal anchors at equal places. The windows of one anchor stand
   side by side, and the bytes that they cover are the anchor's segment. Anchors are counted over all
   documents; a window whose anchor's hash occurs once occurs once itself.
2. Classes. Equal segments are one class, of which the earliest occurrence stays a candidate; in the
   others all windows start earlier elsewhere.
3. Trimming. The classes of one anchor hash, earliest occurrences only, stand one below another at their
   anchors. What a segment has before its anchor is cut to the longest end that any other class has
   there too, and so after it; what has less than a window left holds no repeat. Segments that are
   equal now are one class again.
4. Suffix arrays. What is left of one anchor's segments is put into one string and its suffixes sorted
   by Lyndon groups (suffix_groups). Neighbours in that order which share 100 bytes are equal windows;
   the earliest keeps its bytes, the others are removed.
   An anchor with more than CLASSES classes is made longer first, and so its group split: of the bytes
   that a window has besides its anchor, half or more stand before it, or half or more behind. So the
   windows of a segment are cut into two segments, one under the anchor with the half before it and one under the
   anchor with the half behind it, and equal windows still meet. Steps 2 to 4 then go on with these,
   again and again until no anchor has too many; at the latest an anchor is a whole window, and a
   class. No task holds more than a bounded number of segments of one anchor, and nothing is left out.

Defined cases: a null text counts as empty; texts shorter than the window lose nothing; repeated rows
of one doc_id are one document, given back as often as they are there; rows with a null doc_id are left
out; an empty table gives an empty table; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import Bloom, bloom_of, saved
from stratalog.llm.suffix_groups import suffix_array

WINDOW = 100
GRAM = 24
CLASSES = 1 << 15  # segments of an anchor that are held together, of at most 175 bytes each
TASKS = 20_000  # that the sorting is dealt to, at most; a task holds one anchor at a time
CHUNK = 1 << 19  # bytes hashed at a time

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the segments of texts; keeps the tables of powers that it needs."""

    def __init__(self, window: int, gram: int = GRAM):
        self.window, self.gram = window, min(gram, window)
        self.up, self.down = _powers(_BASE, CHUNK + 2 * window), _powers(_BACK, CHUNK + 2 * window)

    def segments(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Start, length in bytes, the anchor's place in it and the anchor's hash of each segment, a chunk at a time.

        A segment at a chunk's border may come in two parts; equal windows still meet by their anchor.
        """
        for at in range(0, max(len(text) - self.window + 1, 0), CHUNK):
            part = np.frombuffer(text, np.uint8)[at : at + CHUNK + self.window - 1]
            n, w = len(part) - self.window + 1, self.window - self.gram + 1
            c = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], out=c[1:])
            h = (c[self.gram :] - c[: -self.gram]) * self.down[: len(part) - self.gram + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
            low = (h & np.uint64(~0xFFFFF & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while 2 * span <= w:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < w:
                low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
            place = (low & np.uint64(0xFFFFF)).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
            last = np.concatenate([first[1:], [n]])
            yield first + at, last - first + self.window - 1, place[first] - first, h[place[first]].view(np.int64)


def _shared_start(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def _longest_shared(texts: list[bytes]) -> list[int]:
    """For each text the length of the longest start that any other has too: a neighbour in sorted order has it."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    out = [0] * len(texts)
    for i, j in zip(order, order[1:]):
        n = _shared_start(texts[i], texts[j])
        out[i] = max(out[i], n)
        out[j] = max(out[j], n)
    return out


def repeats(segments: list[tuple[int, int, int, bytes]], window: int, gram: int) -> list[tuple[int, int, int]]:
    """doc, start, end of the byte runs to remove in the segments (doc, start, place of the anchor, bytes) of one anchor, in order of their places."""
    before = _longest_shared([x[at - 1 :: -1] if at else b"" for _, _, at, x in segments])
    behind = _longest_shared([x[at + gram :] for _, _, at, x in segments])
    found, first = [], {}
    for (doc, start, at, x), left, right in zip(segments, before, behind, strict=True):
        low, high = at - left, at + gram + right
        if high - low >= window:
            trimmed = x[low:high]
            if trimmed in first:
                found.append((doc, start + low, start + high))
            else:
                first[trimmed] = (doc, start + low)
    if len(first) > 1:
        order = list(first.values())
        for (doc, start), runs in zip(order, equal_windows(list(first), order, window), strict=True):
            found.extend((doc, start + a, start + b) for a, b in runs)
    return found


def equal_windows(segments: list[bytes], order: list[tuple[int, int]], window: int) -> list[list[tuple[int, int]]]:
    """For each segment the [start, end) byte runs covered by windows of which an equal one comes earlier.

    order: the place (doc_id, start) of each segment's first byte.
    """
    symbols: list[int] = []
    owner, offset = [], []
    for k, x in enumerate(segments):
        symbols.extend([b + 2 for b in x])
        symbols.append(1)
        owner.append(np.full(len(x) + 1, k))
        offset.append(np.arange(len(x) + 1))
    symbols.append(0)
    owner, offset = np.concatenate([*owner, [0]]), np.concatenate([*offset, [1 << 40]])
    sizes = np.array([len(x) for x in segments])
    text = np.array(symbols, np.int16)
    sa = suffix_array(symbols)
    sa = sa[offset[sa] + window <= sizes[owner[sa]]]  # starts of whole windows
    view = np.lib.stride_tricks.sliding_window_view(text, window)
    equal = np.zeros(len(sa), bool)
    for a in range(1, len(sa), 4096):
        b = min(a + 4096, len(sa))
        equal[a:b] = (view[sa[a:b]] == view[sa[a - 1 : b - 1]]).all(1)
    runs: list[list[tuple[int, int]]] = [[] for _ in segments]
    if equal.any():
        cls = np.cumsum(~equal)
        doc = np.array([d for d, _ in order])[owner[sa]]
        start = np.array([s for _, s in order])[owner[sa]] + offset[sa]
        by = np.lexsort((start, doc, cls))
        later = np.concatenate([[False], cls[by][1:] == cls[by][:-1]])
        gone = sa[by][later]
        gone.sort()
        for i in gone.tolist():
            k, o = int(owner[i]), int(offset[i])
            if runs[k] and o <= runs[k][-1][1]:
                runs[k][-1] = (runs[k][-1][0], o + window)
            else:
                runs[k].append((o, o + window))
    return runs


def _bytes_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _marked(docs: DataFrame, marks: Bloom) -> DataFrame:
    return docs.select("doc_id", "text", marks.bit("doc_id").alias("bit"))


def _texts_of(docs: DataFrame, marks: Bloom) -> DataFrame:
    """doc, text of the documents that marks may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.flatnonzero(marks.holds(batch.column(2).to_numpy()))
            for k in range(0, len(own), 500):
                part = batch.take(pa.array(own[k : k + 500]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_bytes_of(part, 1), pa.binary())], ["doc", "text"])

    return _marked(docs, marks).mapInArrow(run, "doc long, text binary")


def removed_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, start, end: byte runs to remove; they may overlap."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, one = Anchors(window), xxhash.xxh3_64_intdigest
        for batch in batches:
            held, parts = 0, []
            for doc, text in zip(batch.column(0).to_pylist(), _bytes_of(batch, 1), strict=True):
                for at, size, place, anchor in find.segments(text):
                    content = np.array([one(text[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)], np.uint64).view(np.int64)
                    parts.append((anchor, content, np.full(len(at), doc), at << 24 | place << 12 | size))
                    held += len(at)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["anchor", "content", "doc", "place"])
                    held, parts = 0, []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["anchor", "content", "doc", "place"])

    posted = docs.mapInArrow(anchors, "anchor long, content long, doc long, place long")
    # written first: only a join of two plain exchanges can be split where an anchor is frequent
    several = saved(posted.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared-anchors")
    shared = saved(posted.join(several, "anchor"), "segments")
    size = F.col("place").bitwiseAND(0xFFF)
    start = F.shiftright("place", 24)
    classes = saved(shared.groupBy("anchor", "content", size.alias("size")).agg(F.min(F.struct("doc", start.alias("start"))).alias("first"), F.min(F.shiftright("place", 12).bitwiseAND(0xFFF)).alias("at"), F.count("*").alias("n")), "segment-classes")
    # written too, for the same reason
    of_several = saved(classes.where("n > 1").select(F.col("anchor").alias("a"), F.col("content").alias("c"), F.col("size").alias("z"), "first"), "repeated-segments")
    met = shared.join(of_several, (F.col("anchor") == F.col("a")) & (F.col("content") == F.col("c")) & (size == F.col("z")))
    found = met.select("doc", start.alias("start"), (start + size).alias("end"), "first").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start"))).drop("first")

    counted = saved(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "anchors-of-several")
    wanted = classes.join(counted, "anchor").select(F.col("first.doc").alias("doc"), F.struct(F.col("first.start").alias("start"), F.col("size").cast("long").alias("size"), "at", "anchor").alias("s"))
    wanted = saved(wanted.groupBy("doc").agg(F.collect_list("s").alias("segments")), "segments-by-document")
    texts = _texts_of(docs, bloom_of(wanted, "doc")).join(wanted, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text, segments in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for s in segments:
                    rows.append((s["anchor"], doc, s["start"], s["at"], text[s["start"] : s["start"] + s["size"]]))
                    held += s["size"]
                if len(rows) > 20_000 or held > 4 << 20:
                    yield _packed(rows)
                    rows, held = [], 0
            if rows:
                yield _packed(rows)

    pieces = saved(texts.mapInArrow(cut, _PIECES), "segment-bytes")
    gram = min(GRAM, window)
    while True:
        crowded = saved(counted.where(F.col("classes") > CLASSES).select("anchor"), "crowded-anchors")
        if crowded.isEmpty():
            return found.unionByName(_sorted_repeats(pieces, window, gram))
        found = found.unionByName(_sorted_repeats(pieces.join(crowded, "anchor", "left_anti"), window, gram))
        more = (window - gram + 1) // 2
        split = saved(pieces.join(crowded, "anchor", "left_semi").select("anchor", "doc", "start", "at", "bytes").mapInArrow(_splitter(window, gram, more), _PIECES), "split-segments")
        gram += more
        firsts = saved(split.groupBy("anchor", "bytes").agg(F.min(F.struct("doc", "start", "at")).alias("first"), F.count("*").alias("n")), "split-classes")
        first = firsts.where("n > 1").select(F.col("anchor").alias("a"), F.col("bytes").alias("b"), "first")
        again = split.join(saved(first, "repeated-segments"), (F.col("anchor") == F.col("a")) & (F.col("bytes") == F.col("b"))).where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
        found = found.unionByName(again.select("doc", "start", (F.col("start") + F.octet_length("bytes")).alias("end")))
        counted = saved(firsts.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "anchors-of-several")
        pieces = firsts.join(counted, "anchor", "left_semi").select("anchor", "first.doc", "first.start", "first.at", "bytes")


_PIECES = "anchor long, doc long, start long, at long, bytes binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.binary()), strict=True)], ["anchor", "doc", "start", "at", "bytes"])


def _splitter(window: int, gram: int, more: int):
    """From segments of an anchor of gram bytes to those of the anchors with more bytes before it, and behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, doc, start, at, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for side, low, high in (0, at - more, at + gram), (1, at, at + gram + more):
                    # the windows that hold all of the new anchor
                    a, b = max(0, high - window), min(len(x), low + window)
                    if low >= 0 and high <= len(x) and b - a >= window:
                        key = xxhash.xxh3_64_intdigest(x[low:high], seed=(anchor ^ side) & (1 << 64) - 1)
                        rows.append((key - (1 << 63), doc, start + a, low - a, x[a:b]))
            yield _packed(rows)

    return run


def _sorted_repeats(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """doc, start, end: what the suffix arrays of each anchor's segments find."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, segments, found = None, [], []

        def close() -> None:
            if len(segments) > 1:
                found.extend(repeats(segments, window, gram))

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["doc", "start", "end"])

        for batch in batches:
            for anchor, *segment in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if anchor != key:
                    close()
                    key, segments = anchor, []
                segments.append(segment)
            if len(found) > 5000:
                yield packed()
                found.clear()
        close()
        yield packed()

    # tasks by the work, a MB of segments each: AQE would merge them to tasks of many MB
    work = pieces.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    ordered = pieces.select("anchor", "doc", "start", "at", "bytes").repartition(min(TASKS, int(work // (1 << 20)) + 1), "anchor").sortWithinPartitions("anchor", "doc", "start")
    return ordered.mapInArrow(sort, "doc long, start long, end long")


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(ends) - 1]])
    return list(zip(starts[first].tolist(), ends[last].tolist(), strict=True))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, runs array<struct<start, end>> removed, kept (binary) for each document."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = removed_runs(docs, window).distinct().groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    runs = saved(runs, "removed-runs")
    marks = bloom_of(runs, "doc")
    out = "doc_id long, n_bytes long, runs array<struct<start:long,end:long>>, kept binary"
    names = ["doc_id", "n_bytes", "runs", "kept"]
    of_runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.flatnonzero(~marks.holds(batch.column(2).to_numpy()))
            for k in range(0, len(own), 500):
                part = batch.take(pa.array(own[k : k + 500]))
                texts = _bytes_of(part, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([[]] * len(texts), of_runs), pa.array(texts, pa.binary())], names)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = []
                part = batch.slice(k, 500)
                for doc, text, starts, ends in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    gone = _merged(np.array(starts), np.array(ends)) if starts else []
                    edges = [0, *[x for run in gone for x in run], len(text)]
                    kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    rows.append((doc, len(text), [{"start": a, "end": b} for a, b in gone], kept))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), of_runs, pa.binary()), strict=True)], names)

    touched = _texts_of(docs, marks).join(runs, "doc", "left").select("doc", "text", "starts", "ends")
    return _marked(docs, marks).mapInArrow(whole, out).unionByName(touched.mapInArrow(reduced, out))

