"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become token pieces of at most `capacity` tokens; only longer ones are
cut. Whole pieces are sequences of their own; the rest are dealt by hash into
shards of about SHARD items. Each shard evolves on several islands: crossover
injects well-filled bins of one parent into the other, drops the bins that hold
duplicates of their items, and best-fits the displaced items again; mutation
does so with the emptiest bins. Between epochs each island's elite migrates to
the next one. A shard whose best packing meets the lower bound stops evolving.

Each shard's badly filled bins are then dissolved, and their items go through
the same steps in fewer shards of at most about WIDE times as many items, until
one shard is left or no fewer items are: so shards lose no more
than single bins together where bins can be filled.

Edge cases: a null text is empty and still gives its end token; an empty table
gives an empty result; repeated rows are packed one by one; extra columns are
ignored.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import body, cut, release, table, tidy

CAPACITY, END = 4096, 1
#: Items of a shard, islands of a shard, epochs between which elites migrate, individuals, generations an epoch.
SHARD, ISLANDS, EPOCHS, PEOPLE, GENERATIONS = 2000, 2, 2, 4, 6
#: Shards that are packed again may hold as many times SHARD items.
WIDE = 16
#: A bin with more than this share free is dissolved and packed again at the next level.
LOOSE = 0.01
#: Most words a worker keeps the ids of, most parts of words, and bytes of text tokenized at a time. Words
#: and parts beyond are looked up anew: each executor's workers share what its JVM leaves them.
WORDS, PARTS, BYTES = 150_000, 100_000, 1 << 20
_SHIFT = 1 << 24
_MARKED = re.compile(rb"[A-Z][\x80-\xff]")
# How the tokenizer's own pattern splits words of Latin letters, digits and ASCII marks.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff0-9!-/:-@\\[-`{-~]+$"
_PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9\n]+")
_LIKE = ({"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False})


class Pool:
    """Runs of token ids, told by number."""

    def __init__(self):
        self.ids, self.lens = np.empty(0, "<u4"), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])

    def keep(self, count: int) -> None:
        self.ids, self.lens = self.ids[: self.lens[:count].sum()].copy(), self.lens[:count].copy()

    def laid(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs one after the other, and where each ends, after a zero."""
        size = self.lens[which]
        ends = np.append(0, np.cumsum(size))
        first = np.cumsum(self.lens) - self.lens
        return self.ids[np.repeat(first[which] - ends[:-1], size) + np.arange(ends[-1])], ends


class Words:
    """A tokenizer and the ids of the words it has seen.

    Words of plain letters, digits and marks are split here as the tokenizer's pattern
    would, and only go through its merges: the last token of each part is told by its
    word end. All others go through the whole tokenizer, one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = json.loads(self.tokenizer.to_str())
        end, split = own["model"].get("end_of_word_suffix"), own["pre_tokenizer"] or {}
        self.merges = None
        if end and split.get("pretokenizers") == list(_LIKE):
            own |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _LIKE[1]]}}
            self.merges = Tokenizer.from_str(json.dumps(own))
            self.ends = np.zeros(max(own["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in own["model"]["vocab"].items() if t.endswith(end)]] = True
        del own, split
        release()
        self.clear()

    def clear(self) -> None:
        self.seen, self.words, self.parts, self.cores = pa.array([], pa.string()), Pool(), {"\n": 0}, Pool()
        self.cores.add(np.empty(0, "<u4"), np.zeros(1, np.int64))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def look_up(self, words: pa.StringArray) -> np.ndarray:
        """The number in the pool of each of some different words; they hold no ASCII white space and no special token's string."""
        if len(self.seen) > WORDS:  # the first words seen are the frequent ones
            self.seen = pa.concat_arrays([self.seen[: WORDS // 2]])
            self.words.keep(WORDS // 2)
        found = pc.index_in(words, value_set=self.seen)
        new = words.filter(pc.is_null(found))
        plain = pc.match_substring_regex(new, _PLAIN) if self.merges is not None else pa.array(np.zeros(len(new), bool))
        simple, odd = new.filter(plain), new.filter(pc.invert(plain))
        base = len(self.seen)
        if len(simple):
            self.words.add(*self._merged(simple.to_pylist()))
        if len(odd):
            made = [self.whole(w) for w in odd.to_pylist()]
            self.words.add(np.concatenate(made), np.array([len(x) for x in made], np.int64))
        self.seen = pa.concat_arrays([self.seen, simple, odd])
        number = found.fill_null(-1).to_numpy().astype(np.int64)
        order = plain.to_numpy(zero_copy_only=False)
        number[number < 0] = base + np.where(order, np.cumsum(order) - 1, len(simple) + np.cumsum(~order) - 1)
        return number

    def _merged(self, words: list[str], at_once: int = 4_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words one after the other, and how many each has."""
        if len(self.parts) > PARTS:
            self.parts = dict(islice(self.parts.items(), PARTS // 2))
            self.cores.keep(len(self.parts))
        said, known = _PARTS.findall("\n".join(words).lower()), self.parts
        new = [p for p in dict.fromkeys(said) if p not in known]
        for i in range(0, len(new), at_once):
            some = new[i : i + at_once]
            ids = np.array(self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(some):
                raise ValueError("a part of a word has no word end")
            self.cores.add(ids, np.diff(last, prepend=0))
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        which = np.fromiter(map(known.__getitem__, said), np.int64, len(said))
        ids, ends = self.cores.laid(which)
        stops = ends[np.append(np.flatnonzero(which == 0), len(which))]
        return ids, np.diff(stops, prepend=0)


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def _lowered(text: bytes) -> bytes:
    """A-Z lowered, as the tokenizer would do later, so that there are fewer different words; as it is
    where a mark after a letter could compose with it, since those forms need not exist in either case."""
    return text if _MARKED.search(text) else text.lower()


def token_bytes(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins what it separates, so the ids
    of a text are those of its words. The different words of all texts are looked up
    once, and ids are laid out by arrays. A text with a special token's string is
    tokenized whole, since that is cut out before anything else.
    """
    words_of = _words(path)
    whole = {i: words_of.whole(t.decode("utf-8", "replace")) for i, t in enumerate(texts) if any(x in t for x in words_of.special)}
    lines = pa.array([b"" if i in whole else _lowered(t) for i, t in enumerate(texts)], pa.binary()).cast(pa.string())
    split = pc.ascii_split_whitespace(lines)
    coded = split.values.dictionary_encode()
    ids, ends = words_of.words.laid(words_of.look_up(coded.dictionary)[coded.indices.to_numpy()])
    edges = ends[split.offsets.to_numpy()].tolist()
    return [(whole[i] if i in whole else ids[a:b]).tobytes() for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _pieces(batch: pa.RecordBatch, tokenizer: str, capacity: int, tail: bytes) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch of ids and texts, about BYTES of text at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right")))
        ids, texts = (batch.column(k).slice(at, stop - at).to_pylist() for k in (0, 1))
        out = []
        for doc, tokens in zip(ids, token_bytes(texts, tokenizer), strict=True):
            tokens += tail
            for piece, start in enumerate(range(0, len(tokens), 4 * capacity)):
                part = tokens[start : start + 4 * capacity]
                out.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
        columns = zip(*out, strict=True)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        at = stop
        del ids, texts, out, columns
        release()


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep_words: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut at
    capacity. keep_words: a worker keeps the words it has seen for its next task."""
    tail = np.array([end], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pieces(batch, tokenizer, capacity, tail)
        if not keep_words:
            _words(tokenizer).clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("body")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers, with their fill."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity, self.bins = sizes, capacity, bins or []
        self.fill = [sum(sizes[i] for i in b) for b in self.bins]

    def best_fit(self, items: list[int]) -> Packing:
        """Put each item, largest first, where it leaves the least room."""
        room = sorted((self.capacity - f) * _SHIFT + k for k, f in enumerate(self.fill))
        for i in sorted(items, key=lambda i: (-self.sizes[i], i)):
            at = bisect_left(room, self.sizes[i] * _SHIFT)
            if at < len(room):
                left, k = divmod(room.pop(at), _SHIFT)
                self.bins[k].append(i)
                self.fill[k] += self.sizes[i]
            else:
                left, k = self.capacity, len(self.bins)
                self.bins.append([i])
                self.fill.append(self.sizes[i])
            insort(room, (left - self.sizes[i]) * _SHIFT + k)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the more unevenly filled."""
        return -len(self.bins), sum((f / self.capacity) ** 2 for f in self.fill)

    def without(self, drop: set[int]) -> tuple[Packing, list[int]]:
        """The packing without the bins numbered in drop, and their items."""
        kept = [list(b) for k, b in enumerate(self.bins) if k not in drop]
        return Packing(self.sizes, self.capacity, kept), [i for k in drop for i in self.bins[k]]


def crossover(one: Packing, other: Packing, chance: random.Random) -> Packing:
    """Inject a section of other's fullest bins into one; repair by best fit."""
    order = sorted(range(len(other.bins)), key=lambda k: -other.fill[k])
    size = max(1, len(order) // 3)
    section = chance.sample(order[: max(1, 2 * len(order) // 3)], min(size, max(1, 2 * len(order) // 3)))
    taken = [list(other.bins[k]) for k in section]
    inside = {i for b in taken for i in b}
    child, displaced = one.without({k for k, b in enumerate(one.bins) if not inside.isdisjoint(b)})
    child = Packing(child.sizes, child.capacity, child.bins + taken)
    return child.best_fit([i for i in displaced if i not in inside])


def mutate(one: Packing, chance: random.Random) -> Packing:
    """Dissolve the emptiest bins and some others; best-fit their items."""
    order = sorted(range(len(one.bins)), key=lambda k: one.fill[k])
    few = max(2, len(order) // 20)
    drop = {*order[:few], *chance.sample(order, min(few, len(order)))}
    child, items = one.without(drop)
    chance.shuffle(items)
    half = len(items) // 2
    return child.best_fit(items[:half]).best_fit(items[half:])


def evolve(sizes: list[int], elites: list[list[int]], seed: int, capacity: int = CAPACITY, people: int = PEOPLE, generations: int = GENERATIONS) -> list[int]:
    """The bin of each item in the best packing found. elites: such lists to start from."""
    chance, bound = random.Random(seed), -(-sum(sizes) // capacity)
    crowd = []
    for elite in elites:
        bins: list[list[int]] = [[] for _ in range(max(elite, default=-1) + 1)]
        for i, k in enumerate(elite):
            bins[k].append(i)
        crowd.append(Packing(sizes, capacity, bins))
    if not crowd:
        crowd.append(Packing(sizes, capacity).best_fit(list(range(len(sizes)))))
    best = max(crowd, key=Packing.fitness)
    if len(best.bins) > bound:
        while len(crowd) < people:
            crowd.append(mutate(crowd[0], chance))
        for _ in range(generations):
            one, other = chance.sample(crowd, 2)
            crowd += [crossover(one, other, chance), mutate(max(one, other, key=Packing.fitness), chance)]
            crowd = sorted(crowd, key=Packing.fitness, reverse=True)[:people]
            if len(crowd[0].bins) <= bound:
                break
        best = max(crowd, key=Packing.fitness)
    out = [0] * len(sizes)
    for k, b in enumerate(best.bins):
        for i in b:
            out[i] = k
    return out


def _islands(shards: DataFrame, epochs: int, islands: int, capacity: int) -> DataFrame:
    """(shard, items, bins): the best packing of each shard over all islands."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, island, epoch, sizes, elites = (c.to_pylist() for c in batch.columns[:5])
            bins = [evolve(z, e, (h * 31 + i) * 31 + p, capacity) for h, i, p, z, e in zip(shard, island, epoch, sizes, elites, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), batch.column(3), pa.array(bins, pa.list_(pa.int32()))], names=["shard", "island", "items", "sizes", "bins"])

    now = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.array().cast("array<array<int>>"))
    for epoch in range(epochs):
        rows = now.select("shard", "island", F.lit(epoch).alias("epoch"), "sizes", "elites", "items")
        grown = cut(rows.mapInArrow(run, "shard long, island int, items array<long>, sizes array<int>, bins array<int>"))
        moved = grown.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("guest"))
        now = grown.join(moved, ["shard", "island"]).select("shard", "island", "items", "sizes", F.array("bins", "guest").alias("elites"))
    return grown.groupBy("shard").agg(F.min_by(F.struct("items", "sizes", "bins"), F.struct(F.array_max("bins"), "island")).alias("best")).select("shard", "best.*")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, loose: float = LOOSE) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = cut(pieces.withColumn("item", F.monotonically_increasing_id()))
    own = pieces.where(F.col("length") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"))
    left, placed, level = pieces.where(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("size")), own, 0
    shards = 1 << 40
    while count := left.count():
        fewest = -(-count // (WIDE * shard))
        shards = max(fewest, min(-(-count // shard), shards // 4))
        dealt = left.groupBy(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("all"))
        packed = cut(_islands(dealt.select("shard", F.col("all.item").alias("items"), F.col("all.size").alias("sizes")), epochs, islands, capacity))
        rows = packed.select("shard", F.explode(F.arrays_zip("items", "sizes", "bins")).alias("x")).select("shard", F.col("x.items").alias("item"), F.col("x.sizes").alias("size"), F.col("x.bins").alias("bin"))
        fills = rows.groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
        rows = cut(rows.join(fills, ["shard", "bin"]))
        full = F.col("fill") >= capacity * (1 - loose)
        # Where bins can't be filled, packing what is left again would not make it fewer.
        done = shards == 1 or shards == fewest and 4 * rows.where(~full).count() > 3 * count
        stay = F.lit(True) if done else full
        number = F.lit(level).cast("long") * (1 << 56) + F.col("shard") * (1 << 20) + F.col("bin")
        placed = placed.unionByName(rows.where(stay).select("item", number.alias("sequence_id")))
        if done:
            break
        left, level = rows.where(~stay).select("item", "size"), level + 1
    # A sequence holds at most capacity pieces, so its window is bounded.
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pieces.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", (F.sum("length").over(before) - F.col("length")).alias("offset"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
