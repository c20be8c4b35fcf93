"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters and digits, lower-cased. An item is its sequence of shingles of five words
(of all its words, if it has fewer). A document's windows have as many words as an item; where the
document has fewer, all of it is its one window. Each window and item has a 64-bit SimHash of its shingles, weighted by how often they occur in it; a
multi-index over BLOCKS blocks of the fingerprint finds every item within RADIUS bits of a window: by the
pigeonhole principle one block differs by at most RADIUS // BLOCKS bits, and postings hold for each
value of a block the items so near. Candidates are verified by the weighted Jaccard similarity of
their shingles, sum of min over sum of max, which must reach the threshold.

Windows without any shingle of an item that they are compared with have similarity 0 and are not fingerprinted.

Items are broadcast in groups of at most GROUP_BYTES of text (an item is a group at least), each group with
a pass of its own, so that a benchmark of any size works and no broadcast grows with it.

Defined cases: null and empty texts and items without words match nothing; repeated items and
documents give rows of their own ids, equal rows once; empty tables give no rows; rows with a null id
are left out; other columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.llm.shingles import hashes, rolling

WORD = re.compile(r"[^\W_]+")
BLOCKS, RADIUS = 8, 24
GROUP_BYTES = 16 << 20
SIZE = 5

_BITS = np.arange(64, dtype=np.uint64)
_NEAR = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)]) <= RADIUS // BLOCKS


def signs(g: np.ndarray) -> np.ndarray:
    """+1 and -1 for the bits of shingle hashes."""
    return (((g[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int8)


def fingerprint(total: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from rows of 64 sums."""
    return np.packbits(total > 0, axis=-1, bitorder="little").view(np.uint64).ravel()


def similarity(window: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> float:
    """Sum of min over sum of max of how often the shingles occur in a window and in an item (sorted tokens, counts)."""
    token, count = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
    same = tokens[at] == token
    both = int(np.minimum(count[same], counts[at[same]]).sum())
    return both / (len(window) + int(counts.sum()) - both)


@dataclass
class ItemsOfSize:
    """Items with one number of words."""

    words: int
    ids: list[int] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)

    def index(self) -> None:
        self.size = min(SIZE, self.words)
        self.counts = [np.unique(s, return_counts=True) for s in self.shingles]
        self.known = np.unique(np.concatenate(self.shingles))
        self.prints = np.concatenate([fingerprint(signs(s).sum(0, dtype=np.int64)[None]) for s in self.shingles])
        blocks = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        #: for each block the postings of each of its values: the items with a near value there, and where each value's begin
        self.postings = []
        for b in range(BLOCKS):
            value, item = np.nonzero(_NEAR[:, blocks[:, b]])
            self.postings.append((item, np.searchsorted(value, np.arange(257))))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows and items within RADIUS bits of each other: all of them."""
        values = prints.view(np.uint8).reshape(-1, BLOCKS).astype(np.int64)
        found = []
        for b, (items, starts) in enumerate(self.postings):
            low, many = starts[values[:, b]], starts[values[:, b] + 1] - starts[values[:, b]]
            window = np.repeat(np.arange(len(prints)), many)
            place = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            found.append(window * len(self.ids) + items[place])
        w, i = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        apart = np.bitwise_count(prints[w] ^ self.prints[i])
        return w[apart <= RADIUS], i[apart <= RADIUS]


def items_of(rows: list[tuple[int, str | None]]) -> list[ItemsOfSize]:
    by_size: dict[int, ItemsOfSize] = {}
    for item, text in rows:
        found = WORD.findall((text or "").lower())
        if found:
            own = by_size.setdefault(len(found), ItemsOfSize(len(found)))
            own.ids.append(item)
            own.shingles.append(rolling(hashes(found), SIZE))
    for own in by_size.values():
        own.index()
    return list(by_size.values())


def windows_like(text: str, by_size: list[ItemsOfSize], every: dict[int, np.ndarray], threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """item, similarity, first word, words of the best window of each item found in text. every: shingle length -> all items' hashes."""
    found = WORD.findall(text.lower())
    if not found:
        return
    h = hashes(found)
    of_length, hit = {}, {}
    for size, known in every.items():
        if len(h) >= size:
            g = of_length[size] = rolling(h, size)
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit[size] = np.flatnonzero(known[at] == g)
    for own in by_size:
        size = own.size
        if size not in hit or not len(hit[size]):
            continue
        g = of_length[size]
        n = min(own.words - size + 1, len(g))  # shingles in a window
        places = hit[size][np.isin(g[hit[size]], own.known)]
        last = len(g) - n
        if not len(places):
            continue
        best: dict[int, tuple[float, int]] = {}
        # runs of windows that hold a known shingle
        low, high = np.maximum(places - n + 1, 0), np.minimum(places, last)
        split = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
        for a, b in zip(low[np.concatenate([[0], split])].tolist(), high[np.concatenate([split - 1, [len(high) - 1]])].tolist(), strict=True):
            for start in range(a, b + 1, 4096):
                end = min(b, start + 4095)
                total = np.zeros((end - start + n + 1, 64), np.int32)
                np.cumsum(signs(g[start : end + n]), axis=0, out=total[1:])
                w, items = own.candidates(fingerprint(total[n:] - total[:-n]))
                for k, i in zip((w + start).tolist(), items.tolist(), strict=True):
                    s = similarity(g[k : k + n], *own.counts[i])
                    if s >= threshold and s > best.get(i, (0.0, 0))[0]:
                        best[i] = s, k
        for i, (s, k) in best.items():
            yield own.ids[i], s, k, min(own.words, len(h))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.75) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of the best window for each item found in a document."""
    spark = docs.sparkSession
    out = "doc_id long, item_id long, similarity double, first_word int, n_words int"
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    found = None
    for shared in _item_groups(spark, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_size, every = _loaded(shared.value)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text and by_size:
                        rows += [(doc, *x) for x in windows_like(text, by_size, every, threshold)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = docs.mapInArrow(run, out)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _loaded(rows: list[tuple[int, str | None]]) -> tuple[list[ItemsOfSize], dict[int, np.ndarray]]:
    by_size = items_of(rows)
    return by_size, {k: np.unique(np.concatenate([x.known for x in by_size if x.size == k])) for k in {x.size for x in by_size}}


def _item_groups(spark: SparkSession, benchmark: DataFrame) -> list[Broadcast]:
    """Broadcasts of the items, each of at most GROUP_BYTES of text or of one item."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text").distinct().withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(64)).cast("int"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    running = F.sum(size).over(Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    items = items.withColumn("at", F.floor(running / (GROUP_BYTES // 64)))
    groups: list[list[str]] = [[]]
    held = 0
    for r in items.groupBy("part", "at").agg(F.sum(size).alias("bytes")).orderBy("part", "at").toLocalIterator():
        if groups[-1] and held + r.bytes > GROUP_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(f"{r.part}:{r.at}")
        held += r.bytes
    return [spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.where(F.concat_ws(":", "part", "at").isin(group)).collect()] if group else []) for group in groups]


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.75) -> DataFrame:
    """The rows of docs in which no item is found, unchanged and without a join."""
    at = docs.columns.index("text")
    kept = docs
    for shared in _item_groups(docs.sparkSession, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_size, every = _loaded(shared.value)
            for batch in batches:
                clean = [not (t and by_size) or next(windows_like(t, by_size, every, threshold), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
