"""Approximate nearest neighbours: inverted file with product-quantised residuals and exact reranking.

An index is fitted on a bounded sample of vectors: coarse centroids (k-means), whose number grows with the
square root of the number of vectors, and, for each subspace, a codebook of the residuals. Every usable
vector is then put into the list of its nearest centroid with the codes of its residual. How many lists
a query probes is measured: the fewest in which the sample's own nearest neighbours of some of
its vectors are found with a recall of TARGET. The sample is thinner than the table, so its
neighbours are farther away and the number is on the safe side.

Lists are packed into blocks of a bounded size, long ones split over several, and queries are dealt into
parts of a bounded size, so that a task holds a block and a part, whatever the table's size. A query
probes the lists whose centroids have the largest inner products with it. In each block the asymmetric
distance tables rank the members of its probed lists; the best of them (with all those that tie with
the last by code) are scored again with the original vectors in double precision, and the best k of
all blocks are kept.

Equal vectors are put into one class first: only a class's smallest k + 1 vec_ids can be among
anybody's k nearest (ties go to the smaller id, and a query's own id is left out), so one class
entry with those ids stands for all of them, exactly.

Defined cases: vectors that are null, zero, of another length than the most frequent one (the longer on ties), or hold null or
non-finite components take no part; repeated vec_ids count once (the smallest vector stays);
with fewer than k candidates all of the probed ones are returned; an empty table gives no rows;
other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import saved

SAMPLE = 65_536  # vectors that an index is fitted on, at most
A_LIST = 32  # vectors of the sample for each list
LISTS = 4_096  # at most; 4 sqrt(n) below
TARGET = 0.96  # recall that the probed lists must have on the sample
ASKED = 512  # vectors of the sample that the number of probes is measured with
SUBSPACES = 16
CODES = 256
RERANK = 256  # members of a block scored exactly for a query
BLOCK = 8_192  # classes in a block
PART = 8_192  # queries in a part


@dataclass(frozen=True)
class Index:
    coarse: np.ndarray  # lists x d
    books: np.ndarray  # subspaces x codes x d / subspaces

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = _nearest(x, self.coarse)
        rest = x - self.coarse[near]
        step = self.books.shape[2]
        codes = [_nearest(rest[:, m * step : (m + 1) * step], b) for m, b in enumerate(self.books)]
        return near, np.stack(codes, 1).astype(np.uint8)

    def distance_tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with each code: queries x subspaces x codes."""
        step = self.books.shape[2]
        return np.stack([q[:, m * step : (m + 1) * step] @ b.T for m, b in enumerate(self.books)], 1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(1)
    parts = [np.argmin(square - 2 * (x[a : a + 2048] @ centres.T), axis=1) for a in range(0, len(x), 2048)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, column, k) for column in x.T], 1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, *, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, rounds: int = 5, seed: int = 0) -> Index:
    x = np.asarray(sample, np.float64)
    while x.shape[1] % subspaces:
        subspaces -= 1
    coarse = _k_means(x, lists, rounds, seed)
    rest = (x - coarse[_nearest(x, coarse)])[: 32 * codes]
    step = x.shape[1] // subspaces
    books = [_k_means(np.ascontiguousarray(rest[:, m * step : (m + 1) * step]), codes, rounds, seed + m) for m in range(subspaces)]
    most = max(map(len, books))
    books = [np.vstack([b, np.full((most - len(b), step), 1e150)]) if len(b) < most else b for b in books]  # never the nearest
    return Index(coarse, np.stack(books))


def probes_for(index: Index, sample: np.ndarray, k: int, target: float = TARGET) -> int:
    """The fewest lists that hold the share target of the k nearest in the sample of some of its vectors."""
    x = np.asarray(sample, np.float32)
    of = _nearest(np.asarray(sample, np.float64), index.coarse)
    asked = np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int)
    places = []
    for i in asked.tolist():
        score = x @ x[i]
        score[i] = -np.inf
        top = np.argpartition(score, len(x) - min(k, len(x)))[len(x) - min(k, len(x)) :]
        order = np.argsort(-(index.coarse @ sample[i]), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        places.append(place[of[top[top != i]]])
    flat = np.sort(np.concatenate(places))
    return int(flat[min(len(flat) - 1, ceil(target * len(flat)))]) + 1 if len(flat) else 1


def blocks_of(sizes: list[int], block: int) -> list[tuple[int, int]]:
    """First block and number of blocks of each list: small lists share one, long ones have several of their own."""
    out, now, held = [], 0, 0
    for n in sizes:
        if n > block:
            now += held > 0
            out.append((now, -(-n // block)))
            now, held = now + out[-1][1], 0
            continue
        if held + n > block:
            now, held = now + 1, 0
        out.append((now, 1))
        held += n
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: one row for each vec_id that takes part."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search(
    vectors: DataFrame, *, query_step: int = 20, k: int = 20, lists: int | None = None, probes: int | None = None,
    rerank: int = RERANK, sample: int = SAMPLE, block: int = BLOCK, part: int = PART,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose vec_id is divisible by query_step."""
    spark = vectors.sparkSession
    rows = saved(usable(vectors), "vectors")
    usual = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == usual["size"])
    # vectors of which there are several are one class; a class lists its smallest k + 1 ids
    classes = saved(rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")), "vector-classes")
    number = classes.count()
    lists = lists or max(1, min(LISTS, round(4 * sqrt(number)), -(-number // 4)))
    chosen = classes.select("v", F.xxhash64("v", "first").alias("h")).orderBy("h").limit(min(sample, max(8_192, A_LIST * lists)))
    fitted_on = chosen.toArrow().column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, usual["size"])
    fitted = fit(fitted_on, lists=lists)
    probes = probes or probes_for(fitted, fitted_on, k)
    index = spark.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near, codes = index.value.assign(_matrix(b.v))
                yield pd.DataFrame({"first": b["first"], "v": b.v, "list": near, "codes": [c.tobytes() for c in codes]})

    type_of_v = vectors.schema["embedding"].dataType.simpleString()
    placed = saved(classes.select("first", "v").mapInPandas(place, f"first long, v {type_of_v}, list int, codes binary"), "vector-codes")
    sizes = {r.list: r["count"] for r in placed.groupBy("list").count().collect()}  # a row for each list
    of_list = np.array(blocks_of([sizes.get(c, 0) for c in range(len(fitted.coarse))], block))
    pick = lambda column: F.get(F.array(*[F.lit(int(x)) for x in of_list[:, column]]), F.col("list"))
    members = placed.withColumn("block", (pick(0) + F.pmod(F.xxhash64("first"), pick(1))).cast("int"))
    queries = rows.where(F.col("vec_id") % query_step == 0)
    parts = max(1, -(-queries.count() // part))
    members = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = spark.sparkContext.broadcast(of_list)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each block that holds a probed list, with these lists."""
        first, many = blocks.value.T
        for b in batches:
            ids, asked, at, wanted = [], [], [], []
            for query, v in zip(b.vec_id, b.v, strict=True):
                near = np.argsort(-(index.value.coarse @ np.asarray(v, np.float64)), kind="stable")[:probes]
                every = np.concatenate([np.arange(first[c], first[c] + many[c]) for c in near.tolist()])
                of = np.repeat(near, many[near])
                order = np.argsort(every, kind="stable")
                edges = np.flatnonzero(np.diff(every[order])) + 1
                for here in np.split(order, edges):
                    ids.append(query)
                    asked.append(v)
                    at.append(int(every[here[0]]))
                    wanted.append(of[here].tolist())
            yield pd.DataFrame({"query_id": ids, "v": asked, "block": at, "lists": wanted})

    probing = queries.mapInPandas(probe, f"query_id long, v {type_of_v}, block int, lists array<int>").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))

    def scan(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(members):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        members = members.sort_values(["list", "first"])
        ids, x, of = members["first"].to_numpy(), _matrix(members.v), members["list"].to_numpy()
        codes = np.frombuffer(b"".join(members.codes), np.uint8).reshape(len(ids), -1).astype(np.int64)
        flat = codes + np.arange(codes.shape[1]) * index.value.books.shape[1]
        here, low = np.unique(of, return_index=True)
        high = np.append(low[1:], len(of))
        found = []
        order = asked.sort_values("query_id")
        for at in range(0, len(order), 256):
            some = order.iloc[at : at + 256]
            q = _matrix(some.v)
            # a row for each code, so that a member's scores for all queries are sums of whole rows
            tables = np.ascontiguousarray(index.value.distance_tables(q).reshape(len(q), -1).T, np.float32)
            coarse = (index.value.coarse[here] @ q.T).astype(np.float32)
            asking: dict[int, list[int]] = {}
            for i, wanted in enumerate(some.lists):
                for c in wanted:
                    asking.setdefault(c, []).append(i)
            near = np.full((len(ids), len(q)), -np.inf, np.float32)
            for j, c in enumerate(here.tolist()):
                own = np.array(asking.get(c, []), np.int64)
                if not len(own):
                    continue
                places = flat[low[j] : high[j]]
                few = 8 * len(own) < len(q)
                total = np.repeat(coarse[j, own][None] if few else coarse[j][None], high[j] - low[j], 0)
                for m in range(flat.shape[1]):
                    total += tables[places[:, m, None], own[None]] if few else tables[places[:, m]]
                near[low[j] : high[j], own] = total if few else total[:, own]
            near = np.ascontiguousarray(near.T)
            last = np.partition(near, len(ids) - rerank, axis=1)[:, len(ids) - rerank] if len(ids) > rerank else np.full(len(q), -np.inf)
            for i, query in enumerate(some.query_id.to_numpy()):
                best = np.flatnonzero((near[i] >= last[i]) & (near[i] > -np.inf))
                score = (x[best] * q[i]).sum(1)  # each row summed alike, so that equal vectors get equal scores
                top = np.lexsort((ids[best], -score))[: k + 1]
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[best][top], "score": score[top]}))
        return pd.concat(found)

    held = members.select("block", "part", "list", "first", "v", "codes")
    scored = probing.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    # the further ids of classes of several; k + 1 of them at most by the ranks among the class's salted parts
    several = classes.where("n > 1").select("v", "first")
    salted_part = Window.partitionBy("v", "salt").orderBy("vec_id")
    salted = rows.join(several, "v").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    few = salted.withColumn("r", F.row_number().over(salted_part)).where(F.col("r") <= k + 1)
    ids_of = few.groupBy("first").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    spread = top.withColumnRenamed("vec_id", "first").join(ids_of, "first", "left").select("query_id", "score", F.explode(F.coalesce("ids", F.array("first"))).alias("vec_id"))
    ranked = spread.where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
