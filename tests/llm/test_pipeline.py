"""The pipeline against a brute-force version of each stage."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_near_copies import first_of, links


def components(ids, prints, distance=4):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bits = np.array(prints, np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance), strict=True):
        x, y = find(ids[a]), find(ids[b])
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def kept_words(texts, window=35):
    words = {i: t.encode().split() for i, t in texts.items()}
    seen = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                keep[p : p + window] = [False] * window
        out[i] = [x for x, k in zip(w, keep, strict=True) if k]
    return words, out


def brute(docs):
    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    owner = {}
    for i, t in docs.items():
        owner[t] = max(i, owner.get(t, i))
    docs = {i: docs[i] for i in owner.values()}
    found = first_of(docs, links(docs))
    docs = {i: docs[i] for i in docs if found[i] == i}
    words, kept = kept_words(docs)
    return {i: docs[i] if len(words[i]) == len(kept[i]) else b" ".join(kept[i]).decode() for i in docs}


def test_run_against_brute_force(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, small).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, size = set(), 0
    for i, text in brute(docs).items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        size += len(ids)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.add((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(size / 4096) + 1


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns_of_documents(spark, small, k):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = [(10**6, None, None, None, None), (10**6 + 1, "", None, "x", 0), (10**6 + 2, "zz top", None, None, 6), (10**6 + 2, "zz top", None, None, 6), (None, "zz top", "en", None, 6)]
    docs = docs.limit(40).unionByName(spark.createDataFrame(extra, docs.schema))
    found = corpus_pipeline.STAGES[k][1](spark, docs, small)
    assert found.columns == docs.columns
    rows = found.collect()
    if k == 0:
        assert all(r["text"] and r["lang"] for r in rows)
    if k == 1:
        assert len({hashlib.sha256((r["text"] or "").encode()).digest() for r in rows}) == len(rows)
        assert [r["doc_id"] for r in rows if r["text"] == "zz top"] == [10**6 + 2]
    if k == 3:
        assert len(rows) == docs.count()


@pytest.mark.parametrize("k", range(5))
def test_stages_stand_clashing_columns_and_long_texts(spark, small, k):
    names = ["lang_pred", "score", "ambiguous", "carried", "row_", "none_", "key_", "pair_", "label", "node", "body", "row", "keep_id", "piece"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    long = spark.createDataFrame([(10**6 + 9, " ".join(f"long{i}" for i in range(60_000)), None, None, 0), (10**6 + 8, None, None, None, 0)], docs.schema)
    docs = docs.unionByName(long).selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    found = corpus_pipeline.STAGES[k][1](spark, docs, small)
    assert k == 4 or found.columns == docs.columns
    rows = found.collect()
    assert {r["doc_id"] for r in rows} >= {10**6 + 9} and (k == 0 or 10**6 + 8 in {r["doc_id"] for r in rows})
    if k < 4:
        assert all(r[n] == n for r in rows for n in names)
    if k == 3:
        assert {r["text"] for r in rows if r["doc_id"] == 10**6 + 8} == {None}
    if k == 4:
        assert len([r for r in rows if r["doc_id"] == 10**6 + 9]) > 1


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, small, k):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[k][1](spark, docs, small).count() == 0
