"""Language-model scoring with a log-frequency Bloom filter.

Counts of unigrams and bigrams of the training texts are quantised on a log scale;
an n-gram of quantum q is put into the filter once for each level 1..q, so its
quantised count comes back by probing levels until one is missing. The two counts
are smoothed:

    P(w | h) = WEIGHT c(h w) / c'(h) + (1 - WEIGHT) P(w),   P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

and P(w) alone after an unknown h. c is the smallest count of a quantum and c' the
largest, so the probabilities of all words after h sum to at most one but for
false positives. A bigram's count is only taken
if both its words are known, which a stored bigram's words always are.

The filter's bits are dealt by hash into segments. Texts come in groups of GROUP
tokens; a group sends each segment its different n-grams with their counts, which
fill the segment and probe it, and gets their quanta back. So no task and no
broadcast ever holds the filter, a segment has the room its n-grams need, and none
is left out at any size. Segments grow in number with the tokens, from FEWEST to
MOST. Probes grow with the words, so that false positives add LEAK at most to the
probabilities of all words after a history. N-grams are told apart by 57 to 62 bits.

The base score uses exact counts: those of the most frequent words, at most TOP,
are broadcast, and all others are joined in by the word's hash. Words are told
apart by 64-bit hashes.

Edge cases: a null or empty text is its end token alone; with no training text
every count is 0; repeated rows are scored one by one; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, body, cut, held, table, tidy

#: Segments of a filter by itself, and probes for each level, at least.
SEGMENTS, PROBES = 1 << 12, 24
#: Segments a corpus gets, at least and at most, and training tokens for each between the two.
FEWEST, MOST, SHARE = 1 << 9, 1 << 14, 1 << 17
#: What false positives may add to the probabilities of all words after a history.
LEAK = 0.01
#: Ratio of a quantum's edges, and weight of the bigrams in smoothing.
BASE, WEIGHT = 1.2, 0.4
#: Words whose exact counts are broadcast, at most.
TOP = 1 << 20
#: Tokens of a group of texts, and tokens counted at a time.
GROUP, COUNTED = 1 << 21, 1 << 22

_END, _START = np.uint64(0x7C9E6C2F5B3A1D11), np.uint64(0x1B873593CC9E2D51)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Lower edge of each quantum: quantum q holds the counts in [EDGES[q - 1], EDGES[q]). They span all longs.
EDGES = np.unique(np.ceil(BASE ** np.arange(0, 240))).astype(np.float64)


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = (a ^ (a >> np.uint64(33))) * _M1 + b
    x ^= x >> np.uint64(29)
    x *= _M2
    return x ^ (x >> np.uint64(32))


def unigram(ids: np.ndarray) -> np.ndarray:
    return _mix(ids, np.uint64(1))


def bigram(ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    return _mix(ids, _mix(before, np.uint64(2)))


def _split(keys: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Segment and rest, the next 48 bits, of an n-gram's key; segments is a power of two, MOST at most."""
    bits = segments.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int32), (keys >> np.uint64(16 - bits)) & np.uint64((1 << 48) - 1)


def _segments(tokens: int) -> int:
    return min(MOST, max(FEWEST, 1 << (tokens // SHARE).bit_length()))


def _probes(kinds: int) -> int:
    """Probes that let one in 2**probes of the absent n-grams pass, for so many different words."""
    return max(PROBES, int(np.ceil(np.log2(WEIGHT * (kinds + 1) / LEAK))))


def _marks(rest: np.ndarray, level: np.ndarray | np.int64) -> np.ndarray:
    """What stands for a rest in the filter at a level."""
    return _mix(rest | np.asarray(level).astype(np.uint64) << np.uint64(48), np.uint64(3))


def quanta(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, counts, side="right")


def smooth(pair: np.ndarray, history: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """P(w | h) from c(h w), c'(h) and P(w)."""
    share = np.where(history > 0, WEIGHT, 0.0)
    return share * pair / np.maximum(history, 1.0) + (1.0 - share) * alone


class Filter:
    """The log-frequency Bloom filter: segments of words 64 bits wide."""

    def __init__(self, words: int, probes: int = PROBES, segments: int = SEGMENTS):
        self.words, self.probes, self.segments = words, probes, segments
        self.bits = np.zeros(segments * words, np.uint64)

    @classmethod
    def of(cls, rest: np.ndarray, counts: np.ndarray, probes: int) -> Filter:
        """One segment that holds rest with their counts, half of its bits set."""
        entries = int(quanta(counts).sum())
        out = cls(max(4, int(np.ceil(entries * probes / np.log(2) / 64))), probes, 1)
        out.bits = out.fill(rest, counts)
        return out

    def _spots(self, marks: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
        """Two of the bits of a segment that stand for an entry, one for a last turn that is odd."""
        # An odd factor of its own makes each turn a function of its own.
        x, wide = marks * (_mix(np.array([turn], np.uint64), _M2) | np.uint64(1)), np.uint64(64 * self.words)
        x = _mix(x, np.uint64(4))
        spots = ((x & np.uint64(0xFFFFFFFF)) * wide >> np.uint64(32), (x >> np.uint64(32)) * wide >> np.uint64(32))
        return spots[: self.probes - 2 * turn]

    def fill(self, rest: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The bits of a segment that holds rest with their counts."""
        out, q = np.zeros(64 * self.words, bool), quanta(counts)
        level = np.arange(1, q.sum() + 1, dtype=np.int64) - np.repeat(np.cumsum(q) - q, q)
        marks = _marks(np.repeat(rest, q), level)
        for turn in range((self.probes + 1) // 2):
            for spot in self._spots(marks, turn):
                out[spot.astype(np.int64)] = True
        return np.packbits(out, bitorder="little").view(np.uint64)

    def find(self, rest: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
        """The quantum of each rest in the segment that begins at word base, 0 if it isn't in."""
        out, base = np.zeros(len(rest), np.uint8), np.broadcast_to(np.asarray(base, np.int64), len(rest))
        todo, level = np.arange(len(rest)), 1
        while len(todo) and level < len(EDGES):
            marks = _marks(rest[todo], np.int64(level))
            for turn in range((self.probes + 1) // 2):
                hit = np.ones(len(todo), bool)
                for spot in self._spots(marks, turn):
                    hit &= (self.bits[base[todo] + (spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
                if not hit.all():
                    todo, marks = todo[hit], marks[hit]
            out[todo] = level
            level += 1
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The quantum of each key, 0 if it isn't in."""
        segment, rest = _split(keys, self.segments)
        return self.find(rest, segment.astype(np.int64) * self.words)


def _groups(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Rows with about `size` tokens: (rows without the text, token ids with an end each, tokens of each row)."""
    digest, rows, ids, lens = xxhash.xxh64_intdigest, [], [], []

    def take():
        return rows, np.concatenate(ids), np.array(lens, np.int64)

    held_tokens = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = row[at].lower().split()
            rows.append(row[:at] + row[at + 1 :])
            ids.append(np.array([*map(digest, words), int(_END)], np.uint64))
            lens.append(len(words) + 1)
            held_tokens += lens[-1]
            if held_tokens >= size:
                yield take()
                rows, ids, lens, held_tokens = [], [], [], 0
    if rows:
        yield take()


def _before(ids: np.ndarray, lens: np.ndarray, start: np.uint64 | int = _START) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lens) - lens] = start
    return before


def token_counts(texts: DataFrame) -> DataFrame:
    """(key, n): how often each token occurs in texts(body)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, _ in _groups(batches, 0, COUNTED):
            keys, n = np.unique(ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """Numbers of so many bytes, the first bytes of all before the second ones, as shuffles are large."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


class Group:
    """The tokens of some rows, as places in `names`, the different ids and the start of a text."""

    def __init__(self, rows: list[tuple], names: np.ndarray, at: np.ndarray, lens: np.ndarray):
        self.rows, self.names, self.at, self.lens = rows, names, at, lens
        self.start = np.cumsum(lens) - lens
        pairs, self.pair = np.unique(_before(at, lens, len(names) - 1) * len(names) + at, return_inverse=True)
        self.history, self.word = (c.astype(np.int32) for c in np.divmod(pairs, len(names)))
        self.keys = np.concatenate([unigram(names), bigram(names[self.word], names[self.history])])
        self.order = np.argsort(self.keys)

    @classmethod
    def of(cls, rows: list[tuple], ids: np.ndarray, lens: np.ndarray) -> Group:
        names, at, n = np.unique(ids, return_inverse=True, return_counts=True)
        # Frequent ids get small places, which compress well.
        order = np.argsort(-n, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return cls(rows, np.append(names[order], _START), place[at], lens)

    def dump(self) -> bytes:
        return pickle.dumps((self.rows, self.names, _packed(self.at, 4), self.lens))

    @classmethod
    def load(cls, state: bytes) -> Group:
        rows, names, at, lens = pickle.loads(state)
        return cls(rows, names, _unpacked(at, 4).astype(np.int64), lens)

    def counts(self, teaches: np.ndarray) -> np.ndarray:
        """How often each n-gram of keys occurs in the rows that teach."""
        weight = np.repeat(teaches, self.lens).astype(np.float64)
        names = np.bincount(self.at, weight, len(self.names))
        names[-1] = teaches.sum()
        return np.concatenate([names, np.bincount(self.pair, weight, len(self.word))]).astype(np.int64)

    def scores(self, found: np.ndarray, total: float) -> np.ndarray:
        """The log10 probability of each row, from the quanta of keys in their order."""
        levels, low = np.empty(len(self.keys), np.int64), np.append(0.0, EDGES)
        levels[self.order] = found
        alone, both = levels[: len(self.names)], levels[len(self.names) :]
        earlier, word = alone[self.history], low[alone[self.word]]
        history = np.where(earlier > 0, EDGES[np.minimum(earlier, len(EDGES) - 1)] - 1, 0.0)
        pair = np.where((word > 0) & (earlier > 0), np.minimum(low[both], np.minimum(word, history)), 0.0)
        return np.add.reduceat(np.log10(smooth(pair, history, (word + 0.1) / total))[self.pair], self.start)


def _dealt(rows: DataFrame, segments: int) -> DataFrame:
    """(grp, part, keys, n) of rows(place, doc_id, held_out, body): for each group and segment the n-grams
    and how often rows that aren't held out have them, and for each group a row with a part below 0 and itself."""
    names = ["grp", "part", "keys", "n"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, ids, lens in _groups(batches, 3, GROUP):
            group, ident = Group.of(found, ids, lens), found[0][0]
            n = group.counts(np.array([r[2] is False for r in found]))[group.order]
            segment, rest = _split(group.keys[group.order], segments)
            edges = np.flatnonzero(np.diff(segment, prepend=-1))
            ends = np.append(edges[1:], len(segment))
            cuts = list(zip(edges.tolist(), ends.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edges), ident)), pa.array(segment[edges]), pa.array([_packed(np.diff(rest[a:b], prepend=np.uint64(0)), 6) for a, b in cuts], pa.binary()), pa.array([_packed(n[a:b], 4) for a, b in cuts], pa.binary())], names=names)
            # Spread by the hash of its part, as the group goes with the segments for a while.
            yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([-1 - zlib.crc32(str(ident).encode()) % (1 << 30)], pa.int32()), pa.array([group.dump()], pa.binary()), pa.nulls(1, pa.binary())], names=names)

    return rows.mapInArrow(run, "grp long, part int, keys binary, n binary")


def _answered(dealt: DataFrame, probes: int) -> DataFrame:
    """(grp, part, found): the quanta of the n-grams of _dealt, and its groups as they are."""

    def answers(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        sent = [np.cumsum(_unpacked(r[1], 6)) for r in rows]
        keys, at = np.unique(np.concatenate(sent), return_inverse=True)
        n = np.bincount(at, np.concatenate([_unpacked(r[2], 4) for r in rows]), len(keys))
        known = n > 0
        found = Filter.of(keys[known], n[known], probes).find(keys)[at]
        parts = [_packed(x, 1) for x in np.split(found, np.cumsum([len(x) for x in sent])[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(parts, pa.binary())], names=["grp", "part", "found"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for grp, part, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.array([-1], pa.int32()), pa.array([keys], pa.binary())], names=["grp", "part", "found"])
                    continue
                if held and part != now:
                    yield answers(now, held)
                    held = []
                now = part
                held.append((grp, keys, n))
        if held:
            yield answers(now, held)

    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(run, "grp long, part int, found binary")


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Group, np.ndarray]]:
    """Each group of _answered, sorted by group and part, with the quanta of its n-grams."""
    state, found, now = b"", [], None
    for batch in batches:
        for grp, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part < 0:
                if now is not None:
                    yield Group.load(state), np.concatenate(found)
                state, found, now = data, [], grp
            else:
                found.append(_unpacked(data, 1).astype(np.uint8))
    if now is not None:
        yield Group.load(state), np.concatenate(found)


class Model:
    """The totals and the frequent tokens' exact counts: what workers get."""

    def __init__(self, tokens: int, kinds: int, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.total = tokens + 0.1 * (kinds + 1)

    def exact(self, ids: np.ndarray) -> np.ndarray:
        """Exact counts of frequent tokens, 0 for all others."""
        if not len(self.keys):
            return np.zeros(len(ids))
        at = np.minimum(np.searchsorted(self.keys, ids), len(self.keys) - 1)
        return np.where(self.keys[at] == ids, self.counts[at], 0)


def lm_scores(docs: DataFrame, out_of_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Rows where out_of_training holds teach nothing."""
    spark = docs.sparkSession
    texts = docs.where(~out_of_training).select(body(text_col).alias("body"))
    # The result reads the counts, so they are kept by a checkpoint.
    counts = cut(token_counts(texts))
    Scratch(spark).drop()
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, below = 1, 0
    for row in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        below += row["count"]
        if below > TOP:
            least = row["n"] + 1
            break
    frequent = counts.where(F.col("n") >= least).toArrow()
    keys, n = (frequent.column(k).to_numpy() for k in ("key", "n"))
    model = spark.sparkContext.broadcast(Model(tokens, kinds, keys.view(np.uint64), n))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for group, found in _returned(batches):
            rows, ids, lens, start, k = group.rows, group.names[group.at], group.lens, group.start, len(group.lens)
            scores, c = group.scores(found, m.total), m.exact(group.names)[group.at]
            base = np.add.reduceat(np.where(c > 0, np.log10(c + 0.1), 0.0), start) - lens * np.log10(m.total)
            known = np.add.reduceat((c > 0).astype(np.int64), start)
            # Each row's own figures, then its other tokens, still without their counts.
            rare = np.flatnonzero(c == 0)
            owner, place = np.concatenate([np.arange(k), np.repeat(np.arange(k), lens)[rare]]), np.array([r[0] for r in rows], np.int64)
            key = np.concatenate([_mix(place.view(np.uint64), np.uint64(4)), ids[rare]]).view(np.int64)
            own = lambda a: np.concatenate([a, np.zeros(len(rare), a.dtype)])
            doc, out = pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())
            blank = lambda a: pa.concat_arrays([a, pa.nulls(len(rare), a.type)])
            tf = np.concatenate([np.zeros(k, np.int64), np.ones(len(rare), np.int64)])
            columns = [place[owner], blank(doc), blank(out), key, tf, own(lens), own(known), own(base), own(scores)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["place", "doc_id", "held_out", "key", "tf", "n_tokens", "known", "base", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).cast("long").alias("doc_id"), out_of_training.alias("held_out"), body(text_col).alias("body"))
    found = _answered(_dealt(rows, _segments(tokens)), _probes(kinds)).repartition("grp").sortWithinPartitions("grp", "part")
    parts = found.mapInArrow(run, "place long, doc_id long, held_out boolean, key long, tf long, n_tokens long, known long, base double, score double")
    rare = counts.where(F.col("n") < least) if least > 1 else counts.where("false")
    joined = parts.join(rare, "key", "left")
    n_of = F.coalesce(F.col("n"), F.lit(0))
    found = joined.groupBy("place").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(n_of > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.col("tf") * F.log10(n_of + F.lit(0.1).cast("double")))).alias("base_score"), F.sum("score").alias("score"),
    )
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), held("doc_id", 10) == 0)
