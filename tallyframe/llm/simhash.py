"""SimHash near-duplicates with the generalised pigeonhole principle.

Distinct fingerprints are probed once however many documents share them.
Correlated bits go into one partition, so that the other partitions stay
selective; a dynamic programme allots each partition its own threshold t_i >= -1
with sum(t_i + 1) = distance + 1, on candidate counts estimated from the key
counts of all fingerprints. A pair within the distance then differs in at most
t_i bits in some partition i, so it meets in a bucket of keys with t_i bits
masked. Buckets are verified by popcount and give a spanning forest of their
links: links that only close a cycle change no component and aren't written.
A bucket above BLOCK fingerprints is dealt out as pairs of blocks, so that no
task gets it whole and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import body, cut, table, tidy
from .graph import components

BITS = 64
#: Fingerprints in a bucket above which it is split into pairs of blocks.
BLOCK = 1024
#: Cost of a shuffled bucket entry in verified pairs.
ENTRY_COST = 2000.0
_SEED = 42


def simhash(text: bytes, shingle: int = 4) -> int:
    """64-bit fingerprint: A-Z lowered, words between ASCII white space, shingle
    words joined by spaces, repeats counted. No words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, _SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), 1 << 15):
        hashes = np.array([digest(line[s:e], _SEED) for s, e in zip(starts[i : i + (1 << 15)], ends[i : i + (1 << 15)], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("body")).mapInArrow(run, "doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlation(prints: DataFrame) -> np.ndarray:
    """|correlation| of each two bits over all rows of prints(fp)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            both, n = both + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], names=["i", "n"])

    got = {r["i"]: r["n"] for r in prints.select("fp").mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    n = got.pop(BITS * BITS, 0) or 1
    p = np.array([got.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS) / n
    one = np.diag(p)
    spread = np.sqrt(np.outer(one * (1 - one), one * (1 - one)))
    return np.abs(np.divide(p - np.outer(one, one), spread, out=np.zeros_like(p), where=spread > 0))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into parts: each grows from a seed by its most correlated free bit."""
    left, out = set(range(BITS)), []
    for i in range(parts):
        size = (BITS + i) // parts
        group = [max(left, key=lambda b: (sum(correlation[b][c] for c in left if c != b), -b))]
        left -= set(group)
        while len(group) < size:
            best = max(left, key=lambda b: (sum(correlation[b][c] for c in group), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def allot(widths: list[int], same: list[float], rows: float, distance: int) -> tuple[list[int], float]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 of least cost, by dynamic programming.

    same[i]: pairs of rows with equal keys in partition i. A mask of t bits makes
    comb(w, t) entries a row and about 2**t times the pairs in each.
    """

    def cost(i: int, t: int) -> float:
        return 0.0 if t < 0 else comb(widths[i], t) * (ENTRY_COST * rows + same[i] * 2**t)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(widths)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (paid, chosen) in best.items():
            for t in range(-1, min(widths[i], distance - used) + 1):
                found = (paid + cost(i, t), [*chosen, t])
                if used + t + 1 not in step or found < step[used + t + 1]:
                    step[used + t + 1] = found
        best = step
    paid, chosen = best[distance + 1]
    return chosen, paid


def _take(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def plan(prints: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """The bits of each partition and its threshold. The number of partitions is the
    cheapest for as many evenly spread fingerprints; thresholds use measured key counts."""
    rows = prints.count()
    even = {m: allot([(BITS + i) // m for i in range(m)], [rows**2 / 2 ** (1 + (BITS + i) // m) for i in range(m)], rows, distance)[1] for m in range(1, min(BITS, distance + 1) + 1)}
    groups = group_bits(bit_correlation(prints), min(even, key=even.get))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, bits in enumerate(groups):
                keys, counts = np.unique(_take(values, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys), pa.array(counts)], names=["part", "key", "n"])

    counts = prints.select("fp").mapInArrow(run, "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").cast("double").alias("n"))
    same = {r["part"]: r["s"] for r in counts.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("s")).collect()}
    return groups, allot([len(g) for g in groups], [same.get(i, 0.0) for i in range(len(groups))], rows, distance)[0]


def spanning_links(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the distance that connect all of values which such links connect."""
    if len(values) <= 256:
        close = np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= distance, 1)
        a, b = np.nonzero(close)
        if len(a) < len(values):
            return values[a], values[b]
    left, tails, heads = values, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= distance
            if hit.any():
                found, left = left[hit], left[~hit]
                tails.append(np.full(len(found), x))
                heads.append(found)
                queue.extend(found)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *tails]), np.concatenate([empty, *heads])


def hamming_links(prints: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct values of prints(fp) within the distance, enough
    of them that every two linked values are connected. prints must hold each value once."""
    groups, thresholds = plan(prints, distance)
    masks = [(i, hidden) for i, t in enumerate(thresholds) if t >= 0 for hidden in combinations(groups[i], t)]

    @tidy
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for m, (i, hidden) in enumerate(masks):
                keys = _take(values, [b for b in groups[i] if b not in hidden])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), m, np.int32)), pa.array(keys), batch.column(0)], names=["mask", "key", "fp"])

    entries = prints.select("fp").mapInArrow(probe, "mask int, key long, fp long")
    large = entries.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("mask", "key", F.ceil(F.col("n") / block).cast("int").alias("cuts"))
    dealt = entries.join(large, ["mask", "key"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("cuts")), F.lit(0)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("cuts"), F.lit(1)) - 1)))
    dealt = dealt.select("mask", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.rec.fromarrays([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)], names="mask,key,x,y,fp")
            rows = rows if held is None else np.concatenate([held, rows])
            new = np.flatnonzero(rows[["mask", "key", "x", "y"]][1:] != rows[["mask", "key", "x", "y"]][:-1]) + 1
            last = int(new[-1]) if len(new) else 0
            yield from _linked(rows[:last], new[:-1], distance)
            held = rows[last:]
        if held is not None:
            yield from _linked(held, np.empty(0, np.int64), distance)

    keys = ["mask", "key", "x", "y"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long")
    return found.distinct()


def _linked(rows: np.ndarray, new: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    values = np.ascontiguousarray(rows["fp"]).view(np.uint64)
    edges = [0, *new.tolist(), len(values)]
    links = [spanning_links(values[i:j], distance) for i, j in zip(edges, edges[1:], strict=False) if j - i > 1]
    links = [x for x in links if len(x[0])]
    if links:
        a, b = (np.concatenate([x[k] for x in links]).view(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id.

    component_id is the smallest doc_id whose fingerprint can be reached over links
    of at most distance differing bits. A null or wordless text has fingerprint
    zero and links like any other; a null id is no component's smallest unless the
    component has no other; repeated rows share their fingerprint; extra columns
    are ignored; an empty table gives an empty result.
    """
    marks = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = cut(components(hamming_links(classes.select("fp"), distance)))
    firsts = labels.join(classes, F.col("node") == F.col("fp")).select("label", "fp", "first")
    whole = firsts.groupBy("label").agg(F.min("first").alias("component"))
    joined = firsts.join(whole, "label").select("fp", "component")
    # Cut, so that both sides of the last join are plain exchanges and a fingerprint that many rows share is split.
    ids = cut(classes.join(joined, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")))
    return marks.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
