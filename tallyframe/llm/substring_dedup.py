"""Substring deduplication by recompression.

Rounds name token runs and pairs: a symbol's name is a fingerprint of its parts'
names, so equal substrings get equal names everywhere without a dictionary, but
for the few symbols at their ends. The rounds are restricted (a symbol spans at
most SPAN words), which bounds the context a symbol boundary depends on: equal
windows have the same boundaries and symbols in their interior. Each window is
owned by the interior boundary whose symbol has the smallest name.

Spark then names globally, coarse to fine, and each level only looks at what the
level above could not settle:

1. the phrase around an owner (the text all its windows share): phrases that
   occur once end here;
2. the whole stretch of an owner's windows: a stretch that occurs again
   repeats, and so do all its windows;
3. single windows, only where a repeated phrase stands in a stretch that occurs
   once (the ends of repeats), against one occurrence of every other stretch.

A window is told by two 64-bit names of which one covers half its words and one
covers all of them, so a false match needs both to collide.

Counts are pre-aggregated before each shuffle and found again by equi-joins,
which adaptive execution splits for a passage that many documents share. A Bloom
filter of bounded size keeps from each shuffle most of what its join would drop,
so texts that lose nothing stay where they are.

Edge cases: a null text has no words; repeated rows count as other places, so
they remove each other's words; rows with one id and different texts are told
apart; texts shorter than a window lose nothing; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import KeySet, Scratch, body, cut, only, table, tidy

#: Most words of a symbol after each round: one round of runs, then rounds of pairs.
RUN, PAIRS = 2, (3, 4)
SPAN = PAIRS[-1]
#: Words on either side of a boundary that decide whether it is one.
REACH = RUN + sum((RUN, *PAIRS)[:-1])
#: Words of the shortest window with an owner in it whatever it holds.
LEAST = 2 * (REACH + SPAN)
#: Words named at a time, and rows taken out of a batch at a time.
CHUNK, SLICE = 1 << 17, 256

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MAX = np.uint64(2**64 - 1)


def _mix(a: np.ndarray, b: np.ndarray | np.uint64, salt: int = 0) -> np.ndarray:
    """A name for the pair (a, b)."""
    x = (a ^ np.uint64(salt * 0x51ED2701 + 0x2545F491)) * _A
    x ^= x >> np.uint64(29)
    x = (x + b) * _B
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def _spread(names: np.ndarray, length: int) -> np.ndarray:
    """Names of the length words from each position on; only positions with so many words left are meaningful."""
    out, k = _mix(names, np.uint64(0)), 1
    while k < length:
        step = min(k, length - k)
        ahead = np.zeros_like(out)
        ahead[: len(out) - step] = out[step:]
        out = _mix(out, ahead, k)
        k += step
    return out


class Parsed:
    """Names over the words of some texts laid end to end."""

    def __init__(self, texts: list[list[bytes]], window: int):
        digest = xxhash.xxh64_intdigest
        sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.ids = np.array([digest(w) for t in texts for w in t], np.uint64)
        n = len(self.ids)
        place = np.arange(n)
        self.valid = place + window <= (self.first + sizes)[self.doc]
        self.window = window

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, name) of each symbol after the rounds."""
        at, names, size = np.arange(len(self.ids)), _mix(self.ids, np.uint64(0), 1), np.ones(len(self.ids), np.int64)

        def join(pairs: np.ndarray, level: int) -> None:
            nonlocal at, names, size
            i = np.flatnonzero(pairs)
            names[i], size[i] = _mix(names[i], names[i + 1], level), size[i] + size[i + 1]
            stay = np.ones(len(at), bool)
            stay[i + 1] = False
            at, names, size = at[stay], names[stay], size[stay]

        if len(at) > 1:
            same = (names[1:] == names[:-1]) & (self.doc[1:] == self.doc[:-1])
            alone = same.copy()
            alone[1:] &= ~same[:-1]
            alone[:-1] &= ~same[1:]
            join(alone, 2)
        for level, most in enumerate(PAIRS, 3):
            side = (_mix(names, np.uint64(level), 17) >> np.uint64(40)) & np.uint64(1) == 0
            join(side[:-1] & ~side[1:] & (self.doc[at[1:]] == self.doc[at[:-1]]) & (size[:-1] + size[1:] <= most), level)
        return at, names

    def owners(self) -> np.ndarray:
        """For each position with a window, the position of its owner."""
        at, names = self.symbols()
        low = np.full(len(self.ids), _MAX)
        low[at] = np.minimum(_mix(names, np.uint64(99), 23), _MAX - np.uint64(1))
        where, k, span = np.arange(len(low)), 1, self.window - 2 * REACH - SPAN + 1
        while k < span:
            step = min(k, span - k)
            ahead, further = np.full(len(low), _MAX), where.copy()
            ahead[: len(low) - step], further[: len(low) - step] = low[step:], where[step:]
            better = ahead < low
            low, where, k = np.where(better, ahead, low), np.where(better, further, where), k + step
        out = np.zeros(len(low), np.int64)
        out[: len(low) - REACH] = where[REACH:]
        return out

    def stretches(self) -> dict[str, np.ndarray]:
        """Runs of windows with one owner: phrase, stretch (names), doc, low, high (first and last window, within the text)."""
        if not len(self.ids) or not self.valid.any():
            return {k: np.empty(0, np.int64) for k in ("phrase", "stretch", "doc", "low", "high")}
        starts, owner = np.flatnonzero(self.valid), self.owners()
        own, doc = owner[starts], self.doc[starts]
        new = np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]))
        low = starts[new]
        high = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1])
        own, whole = owner[low], _spread(self.ids, self.window)
        phrase = _spread(self.ids, 2 * REACH + SPAN)[own - REACH]
        stretch = _mix(_mix(whole[low], whole[high], 5), ((high - low) * 64 + (own - low)).astype(np.uint64), 6)
        base = self.first[self.doc[low]]
        return {"phrase": phrase.view(np.int64), "stretch": stretch.view(np.int64), "doc": self.doc[low], "low": low - base, "high": high - base}


def _grouped(rows: Iterator[tuple], words_at: int) -> Iterator[list[tuple]]:
    """Rows in groups of about CHUNK words, with the words in the text's place."""
    group, held = [], 0
    for row in rows:
        words = row[words_at].split()
        group.append((*row[:words_at], words, *row[words_at + 1 :]))
        held += len(words)
        if held >= CHUNK:
            yield group
            group, held = [], 0
    if group:
        yield group


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True)


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _keyed(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """(row, body, carried columns as a struct); row tells carried values and texts apart, so equal rows share it."""
    text = body(text_col)
    names = [F.col(c).cast("string") for c in carry]
    return docs.select(F.xxhash64(*names, text).alias("row"), text.alias("body"), F.struct(*carry).alias("carried"))


def repeated_spans(keyed: DataFrame, window: int = 35) -> DataFrame:
    """(row, low, end): sorted, disjoint word ranges [low, end) of each row that
    repeated windows cover, as two arrays. Rows without any are left out.

    keyed: (row, body). A window is repeated if its words also start at another
    place of any row.
    """
    if window < LEAST:
        raise ValueError(f"a window needs {LEAST} words at least")
    spark = keyed.sparkSession

    @tidy
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(_rows(batches), 0):
            yield _record(phrase=Parsed([g[0] for g in group], window).stretches()["phrase"])

    shared = cut(keyed.select("body").mapInArrow(phrases, "phrase long").groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase"))
    again = spark.sparkContext.broadcast(KeySet.of(shared, "phrase"))

    @tidy
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(_rows(batches), 1):
            found = Parsed([g[1] for g in group], window).stretches()
            some = again.value.has(found["phrase"])
            found = {k: v[some] for k, v in found.items()}
            rows = np.array([g[0] for g in group], np.int64)[found["doc"]]
            yield _record(phrase=found["phrase"], stretch=found["stretch"], row=rows, low=found["low"].astype(np.int32), high=found["high"].astype(np.int32))

    @tidy
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(_rows(batches), 1):
            parsed = Parsed([g[1] for g in group], window)
            names = _spread(parsed.ids, window).view(np.int64)
            out = []
            for doc, (row, _, asked) in enumerate(group):
                for x in asked:
                    places = np.arange(x["low"], x["high"] + 1)
                    out.append((np.full(len(places), x["phrase"]), names[places + parsed.first[doc]], np.full(len(places), row), places, np.full(len(places), x["weight"])))
            if out:
                phrase, name, row, low, weight = (np.concatenate(c) for c in zip(*out, strict=True))
                yield _record(phrase=phrase, window=name, row=row, low=low.astype(np.int32), weight=weight.astype(np.int32))

    with Scratch(spark) as scratch:
        places = keyed.select("row", "body").mapInArrow(stretches, "phrase long, stretch long, row long, low int, high int")
        places = scratch.table(places.join(shared, "phrase", "left_semi"))
        kinds = scratch.table(places.groupBy("phrase", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("row", "low", "high")).alias("one")))
        settled = places.join(kinds.where("n > 1").select("phrase", "stretch"), ["phrase", "stretch"], "left_semi").select("row", "low", (F.col("high") + window).alias("end"))
        # Where a phrase has a stretch that occurs once, its windows are compared with those of one occurrence of each other stretch.
        # What the joins look up is written first: a join with an aggregate under it is not split where one key is hot.
        open_phrases = scratch.table(kinds.groupBy("phrase").agg(F.min("n").alias("least")).where("least = 1").select("phrase"))
        open_kinds = kinds.join(open_phrases, "phrase", "left_semi").select("phrase", "one.*", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight"))
        todo = cut(open_kinds.groupBy("row").agg(F.collect_list(F.struct("phrase", "low", "high", "weight")).alias("todo")))
        # Equal rows, which share their key, are each other's repeats: all they weigh is 2 or more, once or twice.
        asked = only(keyed.select("row", "body"), KeySet.of(todo, "row")).join(todo, "row")
        single = scratch.table(asked.mapInArrow(windows, "phrase long, window long, row long, low int, weight int"))
        twice = scratch.table(single.groupBy("phrase", "window").agg(F.sum("weight").alias("n")).where("n > 1").select("phrase", "window"))
        late = single.where("weight = 1").join(twice, ["phrase", "window"], "left_semi").select("row", "low", (F.col("low") + window).alias("end"))
        covered = settled.unionByName(late).repartition("row").sortWithinPartitions("row", "low")
        return cut(covered.mapInArrow(_merged, "row long, low array<int>, end array<int>"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (row, low, end) with overlapping ranges made one, a row at a time."""
    out: list[tuple[int, list[int], list[int]]] = []
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "low", "end"])

    for row, low, end in _rows(batches):
        if not out or out[-1][0] != row:
            if len(out) > 5000:
                yield flush(out)
                out = []
            out.append((row, [low], [end]))
        elif low <= out[-1][2][-1]:
            out[-1][2][-1] = max(end, out[-1][2][-1])
        else:
            out[-1][1].append(low)
            out[-1][2].append(end)
    yield flush(out)


def drop_spans(words: list[bytes], low: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The words outside all ranges [low, end)."""
    if not len(low):
        return words
    edge = np.bincount(low, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
    return [w for w, deep in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not deep]


def substring_dedup(docs: DataFrame, finish: Callable[[bytes, list[bytes], list[bytes]], tuple], schema: str, carry: list[str], text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per input row: the carried columns, then what finish(text, words, kept words)
    makes of it, as schema says. Only texts that may lose words are shuffled."""
    keyed = _keyed(docs, carry, text_col)
    spans = repeated_spans(keyed.select("row", "body"), window)
    known = KeySet.of(spans, "row")

    shared = docs.sparkSession.sparkContext.broadcast(known)

    def finished(carried: pa.Array, made: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c) for c in zip(*made, strict=True)]
        return pa.RecordBatch.from_arrays([carried, *columns], names=["carried", *(str(i) for i in range(len(columns)))])

    @tidy
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                batch = batch.filter(pa.array(~shared.value.has(batch.column(0).to_numpy(zero_copy_only=False))))
                if batch.num_rows:
                    split = [(t, t.split()) for t in batch.column(1).to_pylist()]
                    yield finished(batch.column(2), [finish(t, words, words) for t, words in split])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lows, ends, at = whole.column(2).values.to_numpy(), whole.column(3).values.to_numpy(), whole.column(2).offsets.to_numpy()
            for first in range(0, whole.num_rows, SLICE):
                batch, made = whole.slice(first, SLICE), []
                for text, i, j in zip(batch.column(1).to_pylist(), at[first:], at[first + 1 :], strict=False):
                    words = text.split()
                    made.append(finish(text, words, drop_spans(words, lows[i:j], ends[i:j])))
                yield finished(batch.column(0), made)

    out = StructType([keyed.schema["carried"], *StructType.fromDDL(schema).fields])
    apart = keyed.mapInArrow(untouched, out)
    changed = only(keyed, known).join(spans, "row", "left").select("carried", "body", "low", "end").mapInArrow(run, out)
    both = apart.unionByName(changed)
    return both.select("carried.*", *[c for c in both.columns if c != "carried"])


def _digest(text: bytes, words: list[bytes], kept: list[bytes]) -> tuple[int, int, str]:
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), _digest, "n_words long, n_removed long, kept_sha256 string", ["doc_id"])


ORACLE_OP2 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), t AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d
), w AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER f AS said, count(*) OVER f AS n
  FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY said) AS places FROM w WHERE n = 35) WHERE places > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS said, count(*) AS n FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
