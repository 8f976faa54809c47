"""Exact deduplication with Patricia-trie owners.

Rows are dealt out by length and content hash; each task inserts the full byte
strings into a compressed radix trie whose terminal nodes hold the smallest
owner key and a row count. A trie over its byte budget writes its largest
subtree to a task-private temporary file and goes on; the file is worked
through later as a trie of its own. Map tasks first run the same trie as a
combiner, so a text that holds a third of all rows reaches its owner as one row
per map task, not one row per copy.

Edge cases: a null text counts as the empty text; a null id never owns a group
that has another id; repeated rows of one id count each in group_size and all
carry kept = true if that id stays; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import body, table, tidy

#: Bytes of text a task's trie may hold before it spills, and a combiner before it flushes.
TRIE_BYTES = 64 << 20
COMBINE_BYTES = 32 << 20
#: Stands for a null id: larger than any 64-bit key.
NO_ID = 1 << 63
_HEAD = struct.Struct("<I9sq")


def _common_prefix(edge: bytes, text: bytes, at: int) -> int:
    """How many leading bytes of edge stand in text from position at."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(edge[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("edge", "children", "owner", "rows")

    def __init__(self, edge: bytes, owner: int | None = None, rows: int = 0):
        self.edge, self.owner, self.rows = edge, owner, rows
        self.children: dict[int, _Node | _Spilled] = {}


class _Spilled:
    """A subtree on disk: its records and the prefix all of them share."""

    def __init__(self, prefix: bytes):
        self.prefix, self.file = prefix, tempfile.TemporaryFile()

    def add(self, text: bytes, at: int, owner: int, rows: int) -> None:
        self.prefix = self.prefix[: _common_prefix(self.prefix, text, at)]
        self.file.write(_HEAD.pack(len(text), owner.to_bytes(9, "little", signed=True), rows) + text)

    def records(self) -> Iterator[tuple[bytes, int, int]]:
        self.file.seek(0)
        while head := self.file.read(_HEAD.size):
            size, owner, rows = _HEAD.unpack(head)
            yield self.file.read(size), int.from_bytes(owner, "little", signed=True), rows
        self.file.close()


class PatriciaTrie:
    """Byte strings with their smallest owner key and row count.

    skip: leading bytes all strings share and the trie does not hold again.
    """

    def __init__(self, budget: int = TRIE_BYTES, skip: int = 0):
        self.root, self.budget, self.skip, self.size = _Node(b""), budget, skip, 0

    def insert(self, text: bytes, owner: int, rows: int = 1) -> None:
        node, at = self.root, self.skip
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = _Node(text[at:], owner, rows)
                self.size += len(text) - at + 200
                if self.size > self.budget:
                    self._spill()
                return
            if isinstance(child, _Spilled):
                child.add(text, at, owner, rows)
                return
            if text.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            shared = _common_prefix(child.edge, text, at)
            fork = _Node(child.edge[:shared])
            child.edge = child.edge[shared:]
            fork.children[child.edge[0]] = child
            node.children[text[at]] = fork
            node, at = fork, at + shared
        node.owner = owner if node.owner is None else min(node.owner, owner)
        node.rows += rows

    def _under(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, int, int]]:
        stack = [(node, prefix)]
        while stack:
            node, text = stack.pop()
            if node.owner is not None:
                yield text, node.owner, node.rows
            stack += [(x, text + x.edge) for x in node.children.values() if isinstance(x, _Node)]

    def _spill(self) -> None:
        """Write the root's largest subtree to disk; strings that come to it later follow."""
        sizes = {k: sum(len(t) + 200 for t, _, _ in self._under(x, x.edge)) for k, x in self.root.children.items() if isinstance(x, _Node)}
        if not sizes:
            return
        key = max(sizes, key=sizes.get)
        node = self.root.children[key]
        spilled, lead = _Spilled(node.edge), bytes(self.skip)  # the skipped bytes are put back by records()' caller
        for text, owner, rows in self._under(node, node.edge):
            spilled.add(lead + text, self.skip, owner, rows)
        self.root.children[key] = spilled
        self.size = max(0, self.size - sizes[key])

    def items(self, lead: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        """Each distinct string with its owner and rows. lead: the skipped bytes."""
        yield from self._under(self.root, lead)
        for child in self.root.children.values():
            if isinstance(child, _Spilled):
                deeper = PatriciaTrie(self.budget, self.skip + len(child.prefix))
                for text, owner, rows in child.records():
                    deeper.insert(text, owner, rows)
                yield from deeper.items(lead + child.prefix)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_COMBINED = pa.schema([("size", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()), ("rows", pa.int64())])
_OWNED = pa.schema([("digest", pa.string()), ("owner", pa.int64()), ("rows", pa.int64())])


def _chunks(rows: Iterator[tuple], size_of, schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += size_of(row)
        if held > limit:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def _combine(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    hashes: dict[bytes, int] = {}
    trie = PatriciaTrie(1 << 62)

    def flush():
        rows = ((len(t), hashes[t], t, None if o == NO_ID else o, n) for t, o, n in trie.items())
        return _chunks(rows, lambda r: r[0] + 100, _COMBINED)

    for batch in batches:
        for text, hashed, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            hashes[text] = hashed
            trie.insert(text, NO_ID if key is None else key)
            if trie.size > budget:
                yield from flush()
                hashes, trie = {}, PatriciaTrie(1 << 62)
    yield from flush()


def _own(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(budget)
    for batch in batches:
        for text, key, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            trie.insert(text, NO_ID if key is None else key, n)
    seen: set[bytes] = set()

    def owners():
        for text, owner, n in trie.items():
            digest = hashlib.sha256(text)
            if digest.digest() in seen:
                raise ValueError("two different texts of one length share their hashes")
            seen.add(digest.digest())
            yield digest.hexdigest(), None if owner == NO_ID else owner, n

    yield from _chunks(owners(), lambda r: 200, _OWNED)


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = TRIE_BYTES, combine: int = COMBINE_BYTES) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size.

    keep: "smallest" or "largest" id. Terminal nodes hold the smallest key, which
    for "largest" is the id's bitwise complement.
    """
    ident = F.col(id_col).cast("long")
    key = ident if keep == "smallest" else F.bitwise_not(ident)
    rows = docs.select(body(text_col).alias("body"), key.alias("owner")).select("body", F.xxhash64("body").alias("hash"), "owner")
    local = rows.mapInArrow(tidy(partial(_combine, budget=combine)), "size long, hash long, body binary, owner long, rows long")
    owned = local.repartition("size", "hash").select("body", "owner", "rows").mapInArrow(tidy(partial(_own, budget=budget)), "digest string, owner long, rows long")
    owner = F.col("owner") if keep == "smallest" else F.bitwise_not(F.col("owner"))
    return owned.select(F.col("digest").alias("text_sha256"), owner.alias("keep_id"), F.col("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", **limits: int) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows find their group by the digest the trie computed for its terminal node;
    a task that holds two strings with one digest fails, so equal digests mean
    equal bytes. The join's hot digests are split at run time.
    """
    owners = exact_owners(docs, id_col, text_col, keep, **limits)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(body(text_col), 256).alias("text_sha256"))
    return rows.join(owners, "text_sha256", "left").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_OP7 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
