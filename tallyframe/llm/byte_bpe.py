"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split first, at boundaries that no match of the pattern can cross
and that leave every match as it is: before a space that stands between two
letters. A match that holds the letter on the left ends there, since letters only
match as a run, and the space opens the next match with the letter on its right;
the pattern looks back nowhere. A stretch without such a boundary stays whole.

Edge cases: a null text is empty and has no ids; special tokens' strings are
ordinary text; bytes that are no UTF-8 come back as U+FFFD, as a string column
can't hold them; repeated rows and ties are independent; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import body, table, tidy

#: Characters above which a text is split, and of a piece.
LONG = 1 << 16
_BOUNDARY = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a local rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces of about `long` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > long:
        cut = _BOUNDARY.search(text, at + long)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, coder, long: int = LONG) -> np.ndarray:
    """The ids of the whole text."""
    if len(text) <= long:
        return np.array(coder.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(coder.encode_ordinary(p), "<u4") for p in pieces(text, long)])


def decode(ids: np.ndarray, coder) -> bytes:
    """The raw bytes of the ids: a token may hold a part of a character."""
    return coder.decode_bytes(ids.tolist())


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids (array<long>, if asked for), ids_sha256, decoded_sha256."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            found = [encode(t.decode("utf-8", "replace"), coder) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) for x in found], pa.int64())]
            if ids:
                columns.append(pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64())))
            columns += [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(decode(x, coder)).hexdigest() for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, body(text_col).alias("text_bytes")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {'ids array<long>, ' * ids}ids_sha256 string, decoded_sha256 string")


def decoded(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, bytes (binary). Null ids give null."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            found = [None if x is None else coder.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=[id_col, "bytes"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
