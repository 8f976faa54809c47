"""Language identification with error-correcting output codes.

Each language has a codeword; for each of its bits a binary classifier on hashed
byte n-grams predicts the bit, and decoding chooses the language whose codeword
has the smallest loss, each bit weighed by how well its classifier separates its
two sides. A text whose two best languages lie close together is flagged as
ambiguous.

The classifiers are log-odds of n-gram frequencies with languages weighed alike,
so all their statistics are one distributed sum of n-gram counts over all
labelled rows. The model (languages x BINS counts) is the only thing that comes
to the driver and doesn't grow with the rows.

Edge cases: a null text, or one without a letter, is `und` with score 0; rows
with a null label teach nothing; without any labelled row all texts are `und`;
one language takes all texts with letters; of languages with equal losses the first
in order of name is taken; repeated rows teach and are judged one by one; a very long
text is hashed in pieces and judged by all of them; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import body, held, table, tidy

#: Hash bins of the n-grams, and the n-gram lengths in bytes.
BINS, GRAMS = 1 << 14, (1, 2, 3, 4)
#: Texts classified at a time, bytes hashed at a time, and rows taken out of a batch at a time.
BLOCK, PIECE, SLICE = 64, 1 << 20, 512
#: n-grams count as this share of independent evidence.
EVIDENCE = 0.05
#: Score below which a text is flagged as ambiguous.
CLEAR = 0.6
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_EDGE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_MULT = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed n-grams of a text: A-Z lowered, all but letters and
    bytes above ASCII as one space, words edged by spaces. Whole texts, in pieces."""
    counts = np.zeros(BINS, np.int64)
    line = np.frombuffer(b" " + _EDGE.sub(b" ", text.lower()) + b" ", np.uint8)
    for start in range(0, len(line), PIECE):
        x = line[start : start + PIECE + GRAMS[-1] - 1].astype(np.uint32)
        hashed = np.zeros(len(x), np.uint32)
        for n, m in enumerate(_MULT[: GRAMS[-1]], 1):
            hashed = hashed[: len(x) - n + 1] * np.uint32(31) + (x[n - 1 :] + np.uint32(n)) * m
            inside = hashed[:PIECE]
            if n in GRAMS and len(inside):
                bins = ((inside ^ (inside >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BINS.bit_length() + 1)
                counts += np.bincount(bins, minlength=BINS)
    return counts


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text.decode("utf-8", "replace")) is not None


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """+1/-1 code, a row a class: exhaustive up to 7 classes, else the random dense
    code of 200 whose closest rows lie farthest apart."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 7:
        columns = [c for c in product((1, -1), repeat=classes) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    rng, best, apart = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, int(np.ceil(12 * np.log2(classes)))))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        distance = ((code.shape[1] - code @ code.T) / 2 + np.eye(classes) * 1e9).min()
        if distance > apart:
            best, apart = code, distance
    return best


class Model:
    """languages (sorted), code (languages x bits), weights (BINS x bits), trust (bits)."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
        weights, trust = [], []
        for column in self.code.T:
            yes, no = share[column > 0], share[column < 0]
            yes = yes.mean(axis=0)
            no = no.mean(axis=0) if len(no) else yes
            weights.append(np.log(yes / no))
            trust.append(((yes - no) * weights[-1]).sum() / 2)
        self.weights = np.array(weights).T.astype(np.float32)
        trust = np.array(trust)
        self.trust = trust / trust.mean() if trust.sum() > 0 else np.ones(len(trust))

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) for rows of n-gram counts."""
        margin = counts.astype(np.float32) @ self.weights * EVIDENCE
        loss = np.logaddexp(0.0, -self.code[None, :, :] * margin[:, None, :]) @ self.trust
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), (share / share.sum(axis=1, keepdims=True)).max(axis=1)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from all rows of docs whose label isn't null."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    counts = gram_counts(text)
                    total[lang] = total[lang] + counts if lang in total else counts
        for lang, counts in total.items():
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins.astype(np.int32)), pa.array(counts[bins])], names=["lang", "bin", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(body(text_col), F.col(lang_col).cast("string"))
    found = rows.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    langs, bins, n = (found.column(k).to_numpy() for k in ("lang", "bin", "n"))
    languages = sorted(set(langs))
    counts = np.zeros((len(languages), BINS))
    counts[np.searchsorted(languages, langs.astype(str)), bins] = n
    return Model(languages, counts)


def classified(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """One row per input row: the carried columns as a struct, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = carry.index(text_col) if text_col in carry else None

    def texts_of(batch: pa.RecordBatch) -> list[bytes]:
        column = batch.column(1) if at is None else batch.column(0).field(at)
        return [t or b"" for t in column.cast(pa.binary()).to_pylist()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                texts = texts_of(batch)
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                todo = [i for i, t in enumerate(texts) if model and has_letter(t)]
                for first in range(0, len(todo), BLOCK):
                    some = todo[first : first + BLOCK]
                    best, score = model.predict(np.array([gram_counts(texts[i]) for i in some]))
                    for i, k, s in zip(some, best, score, strict=True):
                        langs[i], scores[i] = model.languages[k], float(s)
                unsure = [s < CLEAR for s in scores]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(unsure)], names=["carried", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.struct(*carry).alias("carried"), *([body(text_col).alias("body")] if at is None else []))
    schema = StructType([rows.schema["carried"], *StructType.fromDDL("lang_pred string, score double, ambiguous boolean").fields])
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """One row per input row: the carried columns, lang_pred, score, ambiguous."""
    return classified(docs, model, carry, text_col).select("carried.*", "lang_pred", "score", "ambiguous")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held("doc_id", 4) == 2
    return classify(docs.select("doc_id", "text", out.alias("held_out")), train(docs.where(~out)), ["doc_id", "held_out"])
