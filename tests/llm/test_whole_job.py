"""Cases in which an operator once did less than its whole job."""

import math
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import html_extract, ngram_lm, packing


def test_quanta_of_very_large_counts():
    counts = np.array([5, 10**7, 10**8, 10**9, 10**12, 10**15])
    grams = ngram_lm.Filter(64)
    keys = ngram_lm.unigram(np.arange(len(counts), dtype=np.uint64))
    for k, n in zip(keys, counts, strict=True):
        segment, rest = ngram_lm._split(np.array([k]))
        grams.bits[segment[0] * 64 : (segment[0] + 1) * 64] |= grams.fill(rest, np.array([n]))
    low = np.append(0.0, ngram_lm.EDGES)[grams.levels(keys)]
    assert (low <= counts).all() and (counts < low * ngram_lm.BASE + 1).all()


def test_no_ngram_is_left_out_of_scores(spark, documents, monkeypatch):
    """Scores are those of exact counts, rounded to their quanta: also where no n-gram repeats, so that
    there are twice as many as tokens, and with groups and segments of any number."""
    edges = [0.0, *ngram_lm.EDGES]
    low = lambda n: edges[int(ngram_lm.quanta(np.array([n]))[0])]
    high = lambda n: edges[int(ngram_lm.quanta(np.array([n]))[0]) + 1] - 1 if n else 0
    once = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(i % 40))) for i in range(300)], "doc_id long, text string")
    for docs, group, fewest in ((once, None, None), (documents, None, None), (documents, 3000, 1)):
        if group:
            monkeypatch.setattr(ngram_lm, "GROUP", group)
            monkeypatch.setattr(ngram_lm, "FEWEST", fewest)
        rows = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), 1] for r in docs.collect()}
        one, two = Counter(), Counter()
        for ident, tokens in rows.items():
            if zlib.crc32(str(ident).encode()) % 10:
                one.update([0, *tokens])
                two.update(zip([0, *tokens], tokens, strict=False))
        n = sum(one.values()) - one[0]
        total = n + 0.1 * len(one)
        for r in ngram_lm.lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect():
            tokens, want = rows[r["doc_id"]], 0.0
            for h, w in zip([0, *tokens], tokens, strict=False):
                alone = (low(one[w]) + 0.1) / total
                pair = min(low(two[h, w]), low(one[w]), high(one[h]))
                want += math.log10(0.4 * pair / high(one[h]) + 0.6 * alone if one[h] else alone)
            assert math.isclose(r["score"], want, rel_tol=1e-9)


def test_copies_of_a_page_keep_their_text(spark):
    shared = "<div>Menu</div>"
    text = lambda t: f"{shared}<div class=content>{t}</div>"
    rows = [(i, f"http://a.com/{i:02}", text("One")) for i in range(10)] + [(10, "http://a.com/10", text("Two")), (11, "http://b.com/1", "<p>twice"), (11, "http://b.com/1", "<p>twice")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = html_extract.extract_text(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert len(found) == len(rows)
        assert {(r["page_id"], r["text"]) for r in found} == {*((i, "One") for i in range(10)), (10, "Two"), (11, "twice")}


def test_shards_stay_bounded_where_bins_cannot_be_filled(spark, monkeypatch):
    sizes, islands = [], packing._islands
    monkeypatch.setattr(packing, "_islands", lambda shards, *rest: sizes.extend(r[0] for r in shards.selectExpr("size(items)").collect()) or islands(shards, *rest))
    pieces = spark.range(400).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "2500 AS length", "0L AS ids_crc32")
    found = packing.pack(pieces, shard=4).collect()
    assert len(found) == 400 and len({r["sequence_id"] for r in found}) == 400
    assert max(sizes) < 150


_WORKER = """
import random, re
from unittest.mock import MagicMock
import pandas, public_tokenizers, pyarrow as pa
from tallyframe.llm import packing

packing.F = packing.body = MagicMock()
peak = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
docs, chance, before = MagicMock(), random.Random(3), peak()
packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
run = docs.select().mapInArrow.call_args[0][0]
for _ in range(3):
    texts = [b" ".join("".join(chance.choices("abcdefghijklmnoprstuvz", k=8)).encode() for _ in range(400)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts, pa.binary())], names=["doc_id", "body"])
    assert sum(b.num_rows for b in run([batch])) == 1000
print(peak() - before)
"""


def test_a_packing_worker_stays_small():
    # Workers share an executor with a JVM that a long pipeline has filled. This one meets 1.2 million words; it took 347 MB.
    done = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 200
