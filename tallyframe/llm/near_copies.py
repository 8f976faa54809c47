"""Near copies by SimHash and by exact Jaccard similarity of five-word shingles.

Two texts are near copies if the sets of their shingles have a similarity of 4/5
or more. SimHash comes first: fingerprints of the shingles that differ in few bits, found
by the generalised pigeonhole principle, link texts, and links that the texts bear
out give a first label to each. Near copies may differ in more bits than such a search
reaches, so prefix filtering finds those that are left between different labels. Shingles are put in one order for all texts; a set of n then shares one of
its first n - ceil(4n/5) + 1 with each near copy, whatever the order is, so no pair
is lost. Shingles that are common in a sample stand last, which keeps the buckets
of equal shingles small.

A large group of copies would make pairs by the square of its size, though a few
links tell it whole. So each text of a bucket of STAR texts or more is first held
against one of them only, in each of ROUNDS rounds; texts so linked share
a label, and then only pairs of different labels are made. All pairs pass on size, on place, and on parities of
the two sets, which bound their difference from below; so no near copy is lost by
them. A bucket where no text passes with the one, as of a passage that texts share, is in no further round.
What is left passes on more parities of large sets, and then is verified on the texts, of so many pairs at a time that the texts moved at once stay in
proportion to the input. A bucket above BLOCK texts is dealt out as pairs of blocks, so that no
task gets it whole and no pair is lost. Shingles are told apart by 64-bit hashes.

Edge cases: letters A-Z are lowered and white space is none of the text; a text
of five words or less is one shingle; one without words has no near copy; a null
id is no one's copy; repeated rows are no copies of each other; a very long text is
one row of its task; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from ._common import KeySet, Scratch, body, cut, only, slices, tidy
from .graph import components

SHINGLE = 5
#: Texts sampled for common shingles, texts of them that make one common, and common shingles at most.
SAMPLE, COMMON, MOST = 20_000, 3, 1 << 18
#: Pairs looked at a time.
PAIRS = 1 << 20
#: Earlier keys of a text that go with each of its entries.
EARLIER = 3
#: Bits that stand for a text's whole set when pairs are looked at.
BITS = 512
#: Texts of a bucket from which they are held against one of them first, how often, and above which a bucket is dealt out.
STAR, ROUNDS, BLOCK = 8, 3, 4096
#: Pairs that are verified at a time, at least; more where there are more than twice as many texts.
LEAST = 1 << 16


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(line)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - SHINGLE + 1].tolist()
    return np.unique(np.array([digest(line[s:e]) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def parity(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities of a set: those of two sets differ in no more places than the sets themselves."""
    return np.packbits(np.bincount((keys >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1 == 1).view(np.uint64)


def wide_parity(keys: np.ndarray) -> np.ndarray:
    """A parity for each element or more, as BITS of a large set tell nothing."""
    return parity(keys, max(BITS, 1 << (len(keys) - 1).bit_length()))


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities as if there were but so many words of them."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def may_be_near(one: np.ndarray, other: np.ndarray, sizes: int) -> bool:
    """Whether the parities of two sets, any number of them, let them have a similarity of 4/5 or more."""
    words = min(len(one), len(other))
    return 9 * int(np.bitwise_count(fold(one, words) ^ fold(other, words)).sum()) <= sizes


def near(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 4/5 or more."""
    if 5 * min(len(one), len(other)) < 4 * max(len(one), len(other)):
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both > 0 and 5 * both >= 4 * (len(one) + len(other) - both)


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes, sorted, of the most common shingles of a sample of texts(doc_id, body)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(text) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    parts = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0).select("body").mapInArrow(run, "key long")
    found = sample.groupBy("key").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST)
    return np.sort(found.select("key").toArrow().column(0).to_numpy().view(np.uint64))


def bucket_pairs(key: np.ndarray, size: np.ndarray, at: np.ndarray, ident: np.ndarray, label: np.ndarray, other: np.ndarray, before: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids that share a key, as far as size, place, label and bits let them be near copies worth a look.
    other: which side of a pair of blocks a row is on; 0 on both sides where its bucket is no pair.
    before: some of the text's earlier keys, 0 for none; a pair that shares one is made there, since
    all that is asked of it here holds there too."""
    order = np.lexsort((size, key))
    key, size, at, ident, label, other, before, bits = (c[order] for c in (key, size, at, ident, label, other, before, bits))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    bucket = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    # Within a bucket the sizes rise, so the partners of a row that are no smaller follow it.
    place = bucket * (1 << 32) + size
    stop = np.searchsorted(place, bucket * (1 << 32) + 5 * size // 4, side="right")
    many = stop - np.arange(len(key)) - 1
    ends, row = np.cumsum(many), 0
    while row < len(key):
        last = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, side="right")))
        n = many[row:last]
        x = np.repeat(np.arange(row, last), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        good = _may_be_near(size[x], at[x], size[y], at[y]) & (label[x] != label[y]) & ((other[x] != other[y]) | (other[x] == 0))
        x, y = x[good], y[good]
        good = ~((before[x][:, :, None] == before[y][:, None, :]) & (before[x][:, :, None] != 0)).any(axis=(1, 2))
        x, y = x[good], y[good]
        good = 9 * _differences(bits[x], bits[y]) <= size[x] + size[y]
        x, y = ident[x[good]], ident[y[good]]
        yield np.minimum(x, y), np.maximum(x, y)
        row = last


def prefixes(texts: DataFrame) -> DataFrame:
    """(key, size, at, id, bits, wide): the first shingles of each of texts(doc_id, body), with the number of its
    shingles; and a row with a null key, at -1 and its parities."""
    last = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, names = last.value, ["key", "size", "at", "id", "bits", "wide"]
        for batch in slices(batches):
            found, marks = [], []
            for ident, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = shingles(text)
                n = len(keys)
                if n:
                    late = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys if len(common) else np.zeros(n, bool)
                    first = np.concatenate([keys[~late], keys[late]])[: n - (4 * n + 4) // 5 + 1]
                    found.append((first.view(np.int64), np.full(len(first), n), np.arange(len(first)), np.full(len(first), ident)))
                    wide = wide_parity(keys)
                    marks.append((n, ident, fold(wide, BITS // 64).tobytes(), wide.tobytes()))
            if found:
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(columns[0]), pa.binary())] * 2], names=names)
                sizes, ids, bits, wides = zip(*marks, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.full(len(ids), -1)), pa.array(ids, pa.int64()), pa.array(bits, pa.binary()), pa.array(wides, pa.binary())], names=names)

    return texts.mapInArrow(run, "key long, size long, at long, id long, bits binary, wide binary")


def _may_be_near(size, at, other_size, other_at):
    """Whether size and place of a shared shingle let two texts be near copies; columns or arrays."""
    least = F.least if isinstance(size, Column) else np.minimum
    return 9 * least(size - at, other_size - other_at) >= 4 * (size + other_size)


def _differences(bits: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places in which parities differ, row by row: no more than the elements in which the sets do."""
    return np.bitwise_count(bits ^ other).sum(axis=1, dtype=np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, most: int, marks: DataFrame | None = None) -> DataFrame:
    """The rows of pairs(a, b, ...), a table, whose texts are near copies. A pair takes a text with it, so
    pairs go in turns of some `most` pairs, and what a turn has shuffled is deleted before the next.
    marks(id, size, wide): wide parities, which are held against each other before any text is moved."""
    if marks is not None:
        pairs = scratch.table(_close_pairs(pairs, marks))
    turns = -(-pairs.count() // most)
    if turns <= 1:
        return _near_pairs(pairs, texts)
    found = []
    for turn in range(turns):
        found.append(scratch.table(_near_pairs(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn), texts)))
        scratch.drop()
    return reduce(DataFrame.unionByName, found)


def _close_pairs(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    names = pairs.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, other = (c.to_pylist() for c in batch.columns[-3:])
            good = [may_be_near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n) for x, y, n in zip(one, other, sizes, strict=True)]
            yield batch.select(names).filter(pa.array(good, pa.bool_()))

    named = lambda end: marks.select(F.col("id").alias(end), F.col("size").alias(f"{end}_size"), F.col("wide").alias(f"{end}_wide"))
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return both.select(*names, (F.col("a_size") + F.col("b_size")).alias("sizes"), "a_wide", "b_wide").mapInArrow(run, pairs.schema)


def _near_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    names = pairs.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            one, other = (c.to_pylist() for c in batch.columns[-2:])
            seen: dict[bytes, np.ndarray] = {}
            for text in (*one, *other):
                if text not in seen:
                    seen[text] = shingles(text)
            good = [near(seen[x], seen[y]) for x, y in zip(one, other, strict=True)]
            yield batch.select(names).filter(pa.array(good, pa.bool_()))

    # Only the texts of pairs are shuffled.
    texts = only(texts.select("doc_id", "body"), KeySet.of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id"))
    named = lambda ident, text: texts.select(F.col("doc_id").alias(ident), F.col("body").alias(text))
    return pairs.join(named("a", "one"), "a").join(named("b", "other"), "b").select(*names, "one", "other").mapInArrow(run, pairs.schema).distinct()


def simhash_links(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, scratch: Scratch, most: int) -> DataFrame:
    """(a, b), a < b: links between near copies whose fingerprints differ in few bits. Of the texts
    of one fingerprint, each is linked with the first; those of different ones by their first texts."""
    prints = scratch.table(simhash.fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, SHINGLE))
    classes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    first = lambda end: classes.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first"))
    same = prints.join(classes, "fp").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    other = simhash.hamming_links(classes.select("fp")).join(first("a"), "a").join(first("b"), "b").select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    pairs = scratch.table(same.unionByName(other).where("a < b").distinct())
    found = scratch.table(_verified(pairs, texts, scratch, most))
    scratch.drop(prints, classes, pairs)
    return found


def _stars(own: DataFrame, marks: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """(key, a, b, mine, its): each text of a bucket of own(key, size, at, id, bits, label) with one of the bucket,
    where their labels differ and size, place and parities let them be near copies. That one has the bucket's key
    earliest in every other round, as a text has shingles that are its own before it; so it is near the middle
    of the group. In the rounds between it is drawn from all."""
    order = F.struct("at", F.xxhash64("id", F.lit(seed))) if seed % 2 == 0 else F.xxhash64("id", F.lit(seed))
    hubs = own.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min_by(F.struct("id", "size", "at", "label"), order).alias("hub")).where("least < most")
    hubs = scratch.table(hubs.join(marks.select(F.col("id").alias("b"), F.col("bits").alias("its_bits")), F.col("hub.id") == F.col("b")).select("key", "hub", "b", "its_bits"))
    pairs = own.join(hubs, "key").where((F.col("label") != F.col("hub.label")) & _may_be_near(F.col("size"), F.col("at"), F.col("hub.size"), F.col("hub.at")))
    pairs = pairs.select("key", F.col("id").alias("a"), "b", F.col("label").alias("mine"), F.col("hub.label").alias("its"), (F.col("size") + F.col("hub.size")).alias("sizes"), "bits", "its_bits")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (6, 7))
                good = 9 * _differences(one, other) <= batch.column(5).to_numpy(zero_copy_only=False)
                yield batch.select([0, 1, 2, 3, 4]).filter(pa.array(good))

    found = scratch.table(pairs.mapInArrow(run, "key long, a long, b long, mine long, its long"))
    scratch.drop(hubs)
    return found


def _merged(labels: DataFrame, found: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """labels(id, label) with new labels: a label gives way to the one with the most links of those it is linked to,
    if that has more links than itself, and to where that one goes. So all that is linked to one text
    shares its label. Texts of one label stay connected; texts that are connected need not share a label yet."""
    ends = found.select("mine", "its").unionByName(found.select(F.col("its").alias("mine"), F.col("mine").alias("its")))
    ranks = scratch.table(ends.groupBy("mine").agg(F.count("*").alias("n")).select(F.col("mine").alias("label"), F.struct("n", F.xxhash64("mine", F.lit(seed)), "mine").alias("rank")))
    of = lambda end: ranks.select(F.col("label").alias(end), F.col("rank").alias(f"{end}_rank"))
    best = ends.distinct().join(of("its"), "its").groupBy("mine").agg(F.max("its_rank").alias("top"), F.max_by("its", "its_rank").alias("new"))
    moved = scratch.table(best.join(of("mine"), "mine").where("top > mine_rank").select(F.col("mine").alias("old"), "new"))
    onward = moved.select(F.col("old").alias("new"), F.col("new").alias("further"))
    moved = scratch.table(moved.join(onward, "new", "left").select("old", F.coalesce("further", "new").alias("new")))
    return labels.join(moved, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))


def _across(entries: DataFrame, marks: DataFrame, labels: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: ids of entries that share a key and have different labels, as far as they may be near copies."""
    order = Window.partitionBy("id").orderBy("at")
    own = scratch.table(entries.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    open_keys = scratch.table(own.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key", F.when(F.col("n") > block, F.ceil(F.col("n") / block)).otherwise(1).cast("int").alias("cuts")))
    # Earlier keys are open ones too: two texts of different labels leave none closed that they share.
    own = own.join(open_keys, "key").select("*", *[F.coalesce(F.lag("key", k).over(order), F.lit(0)).alias(f"before{k}") for k in range(1, EARLIER + 1)]).join(marks.select("id", "bits"), "id")
    side = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    dealt = own.withColumn("own", side).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    # other: 0 within a block, else 1 or 2, so that a pair of blocks makes the pairs between them alone.
    other = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).cast("long")
    dealt = dealt.select(F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("bucket"), "size", "at", "id", "label", other.alias("other"), "bits", *[f"before{k}" for k in range(1, EARLIER + 1)])

    @tidy
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            rows.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(7, 7 + EARLIER)], axis=1))
            rows.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            edge = int(np.searchsorted(rows[0], rows[0][-1]))
            if held and (edge or held[0][0][0] != rows[0][0]):
                yield from paired([*held, tuple(c[:edge] for c in rows)])
                held, rows = [], [c[edge:] for c in rows]
            elif edge:
                yield from paired([tuple(c[:edge] for c in rows)])
                rows = [c[edge:] for c in rows]
            held.append(tuple(rows))
        if held:
            yield from paired(held)

    def paired(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for x, y in bucket_pairs(*(np.concatenate(c) for c in zip(*parts, strict=True))):
            if len(x):
                x, y = np.unique(np.stack([x, y]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pair, "a long, b long").distinct()


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", star: int = STAR, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: links between the ids of near copies, enough of them that all near copies are connected."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("body"))
    with Scratch(docs.sparkSession) as scratch:
        scratch.drop()
        most = max(LEAST, texts.count() // 2)
        alike = simhash_links(docs, texts, id_col, text_col, scratch, most)
        first = components(alike).select(F.col("node").alias("id"), "label")
        all_rows = scratch.table(prefixes(texts))
        entries, marks = all_rows.where("at >= 0").select("key", "size", "at", "id"), scratch.table(all_rows.where("at < 0").select("id", "size", "bits", "wide"))
        scratch.drop()
        # Most shingles stand in one text only; those are left out before anything else is shuffled.
        twice = scratch.table(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
        entries = scratch.table(only(entries, KeySet.of(twice, "key")))
        scratch.drop(all_rows, twice)
        large = scratch.table(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= star).select("key"))
        own = scratch.table(entries.join(large, "key").join(marks.select("id", "bits"), "id").join(first, "id", "left").select("key", "size", "at", "id", "bits", F.coalesce("label", "id").alias("label")))
        labels = scratch.table(own.select("id").distinct().join(first, "id", "full").select("id", F.coalesce("label", "id").alias("label")))
        sure = [alike]
        for seed in range(ROUNDS):
            stars = _stars(own, marks, seed, scratch)
            links = scratch.table(stars.select("a", "b", "mine", "its").distinct())
            found = scratch.table(_verified(links, texts, scratch, most, marks))
            if not found.count():
                scratch.drop(stars, links)
                break
            sure.append(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
            labels = scratch.table(_merged(labels, found, seed, scratch))
            before, own = own, scratch.table(own.drop("label").join(stars.select("key").distinct(), "key", "left_semi").join(labels, "id"))
            scratch.drop(before, stars, links)
        scratch.drop(own, large)
        labels = labels.where("id <> label")
        pairs = scratch.table(_across(entries, marks, labels, block, scratch))
        scratch.drop(entries)
        return cut(reduce(DataFrame.unionByName, sure, _verified(pairs, texts, scratch, most, marks)))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id): ids that near copies link to a smaller one."""
    return components(near_links(docs, id_col, text_col)).where("node <> label").select(F.col("node").alias("doc_id"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, label) of the ids that have near copies: label is the smallest id of the group."""
    return components(near_links(docs, id_col, text_col))
