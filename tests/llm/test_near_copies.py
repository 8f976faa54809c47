"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
from tallyframe.llm import near_copies


def sets(texts):
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    return {i: {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}


def links(texts):
    found, ids = sets(texts), sorted(texts)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if found[a] & found[b] and 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b])}


def drawn():
    """Texts with copies that differ in up to three words, and a passage in many."""
    chance, texts = random.Random(3), {}
    words = [f"w{i}" for i in range(400)]
    passage = chance.choices(words, k=30)
    for group in range(25):
        base = chance.choices(words, k=chance.choice([3, 5, 6, 40, 120, 300]))
        base = base + passage if group % 3 == 0 else base
        for _ in range(5):
            copy = list(base)
            for _ in range(chance.randrange(4)):
                copy[chance.randrange(len(copy))] = chance.choice(words)
            texts[len(texts)] = " ".join(copy)
    return texts


def first_of(texts, found):
    first = {i: i for i in texts}
    for _ in texts:
        for a, b in found:
            first[a] = first[b] = min(first[a], first[b])
    return first


def test_links_against_brute_force(spark, monkeypatch):
    texts = drawn()
    df = spark.createDataFrame([*texts.items(), (999, None), (1000, " "), (None, texts[0])], "doc_id long, text string")
    want = links(texts)
    assert len(want) > 30
    for pairs, star, block in ((near_copies.PAIRS, 10**9, 10**9), (3, 10**9, 2), (near_copies.PAIRS, 2, 10**9), (7, 2, 1)):
        monkeypatch.setattr(near_copies, "PAIRS", pairs)
        found = {tuple(r) for r in near_copies.near_links(df, star=star, block=block).collect()}
        assert found <= want and first_of(texts, found) == first_of(texts, want)


def test_a_large_group_makes_no_pairs_by_its_square(spark, monkeypatch):
    chance = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    base, texts = chance.choices(words, k=200), {}
    for i in range(400):
        copy = list(base)
        copy[chance.randrange(200)] = f"own{i}"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    made, across = [], near_copies._across
    monkeypatch.setattr(near_copies, "_across", lambda *a: made.append(across(*a).count()) or across(*a))
    found = near_copies.near_links(df)
    assert found.count() < 4000 and made[0] < 4000
    assert first_of(texts, {tuple(r) for r in found.collect()}) == dict.fromkeys(texts, 0)


def test_copies_that_are_near_to_few_make_no_pairs_by_their_square(spark, monkeypatch):
    """Texts with many changes are near to those with few alone, so a text drawn from all links too few of them."""
    chance = random.Random(12)
    base, texts = [f"w{i}" for i in range(150)], {}
    for i in range(480):
        copy = list(base)
        for k in range(min(3, i % 5)):
            copy[chance.randrange(48 * k, 48 * k + 40)] = f"own{i}x{k}"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    made, across = [], near_copies._across
    monkeypatch.setattr(near_copies, "_across", lambda *a: made.append(across(*a).count()) or across(*a))
    found = {tuple(r) for r in near_copies.near_links(df).collect()}
    assert made[0] < 2 * len(texts) and len(found) < 10 * len(texts)
    assert first_of(texts, found) == first_of(texts, links(texts))


def test_stage_against_brute_force(spark, small):
    texts = drawn()
    first = first_of(texts, links(texts))
    other = " ".join(f"q{k}" for k in range(60))
    # A second row of an id, with another text, is a row of its own; a row without an id loses to one with an id.
    df = spark.createDataFrame([*texts.items(), (None, texts[0] + " x"), (0, other), (5000, other + " x"), (5001, other + " y")], "doc_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, df, small).collect())
    alone = len(texts[0].split()) < 30
    assert kept == Counter([*((i, texts[i]) for i in texts if first[i] == i), (0, other), *([(None, texts[0] + " x")] if alone else [])])


def test_simhash_links_copies_before_prefixes_do(spark, monkeypatch):
    """With prefix filtering off, what is left is the links by fingerprints that the texts bear out."""
    chance = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    texts = {}
    for group in range(12):
        base = chance.choices(words, k=400)
        for at in (None, 0, 399):
            texts[len(texts)] = " ".join(w if k != at else f"own{group}" for k, w in enumerate(base))
    df = spark.createDataFrame([*texts.items(), (998, " "), (999, None)], "doc_id long, text string")
    whole = first_of(texts, {tuple(r) for r in near_copies.near_links(df).collect()})
    monkeypatch.setattr(near_copies, "_across", lambda *_: spark.createDataFrame([], "a long, b long"))
    found = {tuple(r) for r in near_copies.near_links(df, star=10**9).collect()}
    assert found and found <= links(texts)
    assert sum(first_of(texts, found)[i] != i for i in texts) >= 12
    assert whole == first_of(texts, links(texts))


def test_only_texts_of_pairs_are_shuffled(spark, monkeypatch):
    """And tables that nothing reads any more are gone before the last ones are made."""
    chance = random.Random(9)
    texts = {i: " ".join(f"{chance.randrange(10**9)}" for _ in range(60)) for i in range(300)}
    texts[300] = texts[7] + " more"
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    passed, only = [], near_copies.only

    def watched(rows, known):
        kept = only(rows, known)
        if rows.columns == ["doc_id", "body"]:
            passed.append(kept.count())
        return kept

    held, across = [], near_copies._across
    monkeypatch.setattr(near_copies, "only", watched)
    monkeypatch.setattr(near_copies, "_across", lambda *a: held.append(len(a[-1].places)) or across(*a))
    assert {tuple(r) for r in near_copies.near_links(df).collect()} == {(7, 300)}
    assert passed and max(passed) <= 10 and held[0] <= 8


def test_texts_that_share_a_passage_alone_are_not_moved(spark, monkeypatch):
    """However rare a passage is in the sample, and however long the texts are that it stands in."""
    chance, texts = random.Random(15), {}
    passage = [f"p{k}" for k in range(40)]
    for i in range(120):
        own = [f"{chance.randrange(10**9)}" for _ in range(3000 if i % 4 == 0 else 120)]
        at = chance.randrange(len(own))
        texts[i] = " ".join(own[:at] + (passage if i % 4 else 20 * passage) + own[at:])
    texts[120] = texts[8] + " more"
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    passed, only = [], near_copies.only

    def watched(rows, known):
        kept = only(rows, known)
        if rows.columns == ["doc_id", "body"]:
            passed.append(kept.count())
        return kept

    monkeypatch.setattr(near_copies, "COMMON", 10**9)
    monkeypatch.setattr(near_copies, "only", watched)
    assert {tuple(r) for r in near_copies.near_links(df).collect()} == {(8, 120)}
    assert passed and max(passed) <= 10


def test_pairs_are_verified_in_turns(spark, monkeypatch):
    texts = drawn()
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    turns, near_pairs = [], near_copies._near_pairs
    monkeypatch.setattr(near_copies, "LEAST", 1)
    monkeypatch.setattr(near_copies, "_near_pairs", lambda pairs, *a: turns.append(pairs.count()) or near_pairs(pairs, *a))
    found = {tuple(r) for r in near_copies.near_links(df, star=10**9).collect()}
    want = links(texts)
    assert found <= want and first_of(texts, found) == first_of(texts, want)
    assert len(turns) > 2 and max(turns) < len(texts)


def test_parities_let_all_near_sets_pass():
    chance = np.random.default_rng(2)
    for n in (1, 2, 9, 500, 513, 1000, 1025, 4100):
        for _ in range(20):
            one = np.unique(chance.integers(0, 1 << 63, n, np.uint64))
            gone = int(chance.integers(0, n // 5 + 1))
            new = chance.integers(0, 1 << 63, int(chance.integers(0, n // 4 + 1)), np.uint64)
            other = np.unique(np.concatenate([one[gone:], new]))
            a, b = near_copies.wide_parity(one), near_copies.wide_parity(other)
            assert not near_copies.near(one, other) or near_copies.may_be_near(a, b, len(one) + len(other))
            assert (near_copies.fold(a, 8) == near_copies.parity(one)).all()
    apart = [near_copies.wide_parity(chance.integers(0, 1 << 63, 4100, np.uint64)) for _ in range(2)]
    assert not near_copies.may_be_near(*apart, 8200)
