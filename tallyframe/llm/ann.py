"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample of the vectors (SAMPLE) and then takes in
every one of them. A query walks the tree through a priority queue of branches,
nearest centre first, and collects leaves; how many it visits is calibrated: it is
widened until the queries of a second bounded sample (PROBES), searched by brute
force in the first one, find the TARGET share of their neighbours.

Equal vectors are one entry of the index with its k + 1 smallest different ids (more of them
can't be among k nearest besides the query itself), so a vector that a third of all
rows share is compared once. Full leaves are dealt out in blocks of members, and
their queries in blocks of queries; each block pair gives the k + 1 best of each
of its queries.

Edge cases: vectors that are null, zero, empty, or hold a null or non-finite
component take no part, nor do rows with a null id, nor vectors of another than
the most frequent length (of equally frequent ones, the longest); rows that repeat
an id with another vector are candidates of their own, rows that repeat both count
as one; ties go to the smaller id; with fewer than k candidates all
are returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, table, tidy

#: Vectors the tree is fitted on and vectors the visits are calibrated on, at most.
SAMPLE, PROBES = 20_000, 300
#: Branches of a node, vectors of the sample in a leaf, rounds of k-means.
BRANCHES, LEAF, ROUNDS = 8, 64, 8
#: Share of their neighbours that the calibration's queries must find.
TARGET = 0.98
#: Members of a block, queries of a block.
MEMBERS, ASKERS = 1024, 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Tree:
    """centres[n]: a node's centre; kids[n]: its nodes, empty for a leaf; leaf[n]: its number as a leaf."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        self.centres: list[np.ndarray] = [sample.mean(axis=0) if len(sample) else np.zeros(0)]
        self.kids: list[list[int]] = [[]]
        rng, todo = np.random.default_rng(seed), [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= LEAF:
                continue
            own = self._means(sample[rows], rng)
            if own is None:
                continue
            for k in np.unique(own):
                some = rows[own == k]
                self.kids[node].append(len(self.centres))
                self.centres.append(self._centre(sample[some]))
                self.kids.append([])
                todo.append((self.kids[node][-1], some))
        self.leaf = np.cumsum([not k for k in self.kids]) - 1
        self.leaves = int(self.leaf[-1]) + 1

    @staticmethod
    def _centre(rows: np.ndarray) -> np.ndarray:
        mean = rows.mean(axis=0)
        size = np.linalg.norm(mean)
        return mean / size if size > 0 else mean

    def _means(self, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
        """The cluster of each row; None if they can't be told apart."""
        centres = rows[rng.choice(len(rows), BRANCHES, replace=False)]
        own = None
        for _ in range(ROUNDS):
            new = (rows @ centres.T).argmax(axis=1)
            if own is not None and (new == own).all():
                break
            own = new
            centres = np.array([self._centre(rows[own == k]) if (own == k).any() else centres[k] for k in range(BRANCHES)])
        return own if len(np.unique(own)) > 1 else None

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while todo:
            node, some = todo.pop()
            if not self.kids[node]:
                out[some] = self.leaf[node]
            elif len(some):
                best = (rows[some] @ np.array([self.centres[k] for k in self.kids[node]]).T).argmax(axis=1)
                todo += [(k, some[best == i]) for i, k in enumerate(self.kids[node])]
        return out

    def visits(self, row: np.ndarray, count: int) -> list[int]:
        """The first leaves on the way through the priority queue."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < count:
            _, node = heapq.heappop(queue)
            if not self.kids[node]:
                out.append(int(self.leaf[node]))
            for k in self.kids[node]:
                heapq.heappush(queue, (-float(row @ self.centres[k]), k))
        return out

    def calibrate(self, sample: np.ndarray, probes: np.ndarray, k: int, target: float = TARGET) -> int:
        """Leaves to visit so that the probes find the target share of their k nearest in the sample."""
        own, ranks = self.place(sample), []
        for row in probes:
            near = sample @ row
            near[near > 1 - 1e-9] = -2  # itself
            best = np.argsort(-near, kind="stable")[:k]
            order = {leaf: i for i, leaf in enumerate(self.visits(row, self.leaves))}
            ranks += [order[int(own[b])] for b in best if near[b] > -2]
        if not ranks:
            return self.leaves
        return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, of any length; vec is the vector as little-endian doubles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(v, "<f8") for v in batch.column(1).to_pylist()]
            good = pa.array([bool(len(v)) and bool(np.isfinite(v).all()) and bool((v != 0).any()) for v in packed], pa.bool_())
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in packed], pa.binary())], names=["id", "vec"])
            yield made.filter(good)

    v = F.col(vector_col).cast("array<double>")
    some = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    return some.select(F.col(id_col).cast("long").alias("id"), v).mapInArrow(run, "id long, vec binary")


def _classes(valid: DataFrame, most: int) -> DataFrame:
    """(vec, ids, entry, key): each different vector with its `most` smallest different ids, the
    smallest of them and a hash of the vector. Merged in map
    tasks first, so a frequent vector leaves each of them as one row."""

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for ids, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[vec] = sorted({*held.get(vec, ()), *ids})[:most]
            if len(held) > 50_000:
                yield _packed(held)
                held = {}
        yield _packed(held)

    @tidy
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for ids, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[vec] = sorted({*held.get(vec, ()), *ids})[:most]
        yield _packed(held)

    local = valid.select(F.array("id").alias("ids"), "vec").mapInArrow(merge, "ids array<long>, vec binary")
    return local.repartition("vec").mapInArrow(own, "ids array<long>, vec binary").select("vec", "ids", F.col("ids")[0].alias("entry"), F.xxhash64("vec").alias("key"))


def _packed(held: dict[bytes, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held.values()), pa.list_(pa.int64())), pa.array(list(held), pa.binary())], names=["ids", "vec"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def search(rows: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found of each row where asks
    holds, by cosine in double precision, itself left out."""
    spark = rows.sparkSession
    valid = _vectors(rows, id_col, vector_col)
    length = valid.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    index = cut(_classes(valid.where(F.length("vec") == (length["n"] if length else 0)), k + 1))
    asking = _vectors(rows.where(asks), id_col, vector_col).join(index.select("vec", "key"), "vec")

    fitted = index.orderBy(F.xxhash64("entry", F.lit(1)), "entry").limit(sample).select("vec").toArrow().column(0)
    points = unit(_matrix(fitted)) if len(fitted) else np.zeros((0, 1))
    tree = Tree(points)
    chosen = points[np.random.default_rng(3).permutation(len(points))[:PROBES]]
    visits = tree.calibrate(points, chosen, k)
    shared = spark.sparkContext.broadcast(tree)

    @tidy
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.place(unit(_matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec", "ids", "entry", "key", "leaf"])

    @tidy
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = [shared.value.visits(v, visits) for v in unit(_matrix(batch.column(0)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=["vec", "query", "leaves"])

    members = cut(index.mapInArrow(placed, "vec binary, ids array<long>, entry long, key long, leaf int"))
    queries = cut(asking.select("vec", F.col("key").alias("query")).distinct().mapInArrow(walked, "vec binary, query long, leaves array<int>"))
    visited = queries.select("vec", "query", F.explode("leaves").alias("leaf"))
    # At most a row a leaf each, and the leaves are as many as the sample allows.
    full = {r["leaf"]: -(-r["count"] // MEMBERS) for r in members.groupBy("leaf").count().collect()}
    busy = {r["leaf"]: -(-r["count"] // ASKERS) for r in visited.groupBy("leaf").count().collect()}
    parts = spark.createDataFrame([(leaf, full.get(leaf, 1), busy.get(leaf, 1)) for leaf in range(tree.leaves)], "leaf int, mine int, theirs int")

    def dealt(df: DataFrame, key: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        out = df.join(F.broadcast(parts), "leaf").withColumn(own, F.pmod(F.xxhash64(key), F.col(mine)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop("mine", "theirs")

    inside = dealt(members, "key", "m", "q", "mine", "theirs").select("leaf", "m", "q", "vec", "ids", "entry", "key")
    outside = dealt(visited, "query", "q", "m", "theirs", "mine").select("leaf", "m", "q", "vec", "query")

    def compare(theirs: pa.Table, ours: pa.Table) -> pa.Table:
        kinds = [("query", pa.int64()), ("entry", pa.int64()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())]
        if not theirs.num_rows or not ours.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds})
        a, b = _matrix(theirs.column("vec")), _matrix(ours.column("vec"))
        score = (a @ b.T) / np.sqrt((a * a).sum(axis=1))[:, None] / np.sqrt((b * b).sum(axis=1))[None, :]
        entry = ours.column("entry").to_numpy()
        best = np.lexsort((np.broadcast_to(entry, score.shape), -score), axis=1)[:, : k + 1]
        flat, who = best.ravel(), np.repeat(np.arange(len(a)), best.shape[1])
        ids = ours.column("ids").take(pa.array(flat)).combine_chunks()
        return pa.table({"query": pa.array(theirs.column("query").to_numpy()[who]), "entry": pa.array(entry[flat]), "key": pa.array(ours.column("key").to_numpy()[flat]), "ids": ids, "score": pa.array(score[who, flat])})

    blocks = ["leaf", "m", "q"]
    found = outside.groupBy(*blocks).cogroup(inside.groupBy(*blocks)).applyInArrow(compare, "query long, entry long, key long, ids array<long>, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry", "key")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    lists = top.groupBy("query").agg(F.collect_list(F.struct("score", "ids", "key")).alias("all"))
    # At most (k + 1)**2 ids of each vector that asks; each of its rows leaves itself out.
    pairs = F.flatten(F.transform("all", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("far"), i.alias("id"), x["key"].alias("key")))))
    sorted_pairs = lists.select("query", F.array_sort(pairs).alias("near"))
    answers = asking.select(F.col("id").alias("query_id"), F.col("key").alias("query")).join(sorted_pairs, "query")
    own = F.slice(F.filter("near", lambda x: (x["id"] != F.col("query_id")) | (x["key"] != F.col("query"))), 1, k)
    return answers.select("query_id", F.posexplode(own).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
