import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.history import repeats_of_accepted
from corvane.llm.neardup import near_duplicates
from corvane.llm.sketch import SetSketch, jaccard, shingle_hashes


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    texts = [text_of(rng, rng.randrange(6, 200)) for _ in range(n)]
    texts += [edited(rng, t, max(1, len(t.split()) // 40)) for t in texts[: n // 2]]
    texts += texts[:10] + [None, "", "one two three", "one two three", "one TWO  three", texts[0] + "\n"]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def brute_pairs(rows, threshold):
    sets = {i: shingle_hashes(t) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a]) and len(sets[b]) and jaccard(sets[a], sets[b]) >= threshold}


def test_shingles():
    assert len(shingle_hashes("a b c d")) == 0 and len(shingle_hashes(None)) == 0
    assert len(shingle_hashes("a b c d e")) == 1 and len(shingle_hashes("a b c d e " * 50)) == 5
    assert (shingle_hashes("A, b; c d\ne!") == shingle_hashes("a b c d e")).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(50, 400), st.floats(0.1, 0.95))
def test_registers_merge_and_estimate(n, j):
    rng = np.random.default_rng(n)
    both = int(n * 2 * j / (1 + j))
    pool = np.unique(rng.integers(0, 2**63, 3 * n).astype("uint64"))
    a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + n - both]]))
    s = SetSketch(bands=128, rows=4)
    ra, rb, rc = s.registers([a]), s.registers([b]), s.registers([np.union1d(a, b)])
    assert (np.maximum(ra, rb) == rc).all()
    got = s.similarity(ra, rb, np.array([len(a)], float), np.array([len(b)], float))[0]
    assert abs(got - jaccard(a, b)) < 0.16


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_pairs_against_brute_force(spark, threshold):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, id string, cls int")
    found = near_duplicates(df, threshold=threshold)
    assert {tuple(r) for r in found.pairs().collect()} == brute_pairs(rows, threshold)
    docs = {r["id"]: r for r in found.documents().collect()}
    assert set(docs) == {i for i, t in rows if len(shingle_hashes(t))}
    assert all(docs[a]["cls"] == docs[b]["cls"] for a, b in brute_pairs(rows, 1.0))


def test_pairs_of_hot_copies_repeats_and_nothing(spark):
    df = spark.createDataFrame([(i, "the same five words every time") for i in range(40)] + [(40, None)], "doc_id bigint, text string")
    found = near_duplicates(df.union(df), threshold=0.6)
    assert found.links.count() == 0 and found.pairs().count() == 40 * 39 // 2
    assert near_duplicates(df.limit(0)).pairs().count() == 0


def brute_repeats(rows, threshold):
    accepted, norm, out = [], set(), set()
    for i, batch, text in sorted(rows, key=lambda r: (r[1], r[0])):
        if text is None:
            continue
        s, flat = shingle_hashes(text), " ".join(text.lower().split())
        if batch > 0 and (flat in norm or any(jaccard(s, x) >= threshold for x in accepted)):
            out.add(i)
        else:
            accepted.append(s)
            norm.add(flat)
    return out


@pytest.mark.parametrize("accepted", [0, None])
def test_repeats_against_brute_force(spark, accepted):
    rows = [(i, min(3, i * 4 // 200), t) for i, t in corpus(seed=8)]
    if accepted is None:
        rows = [(i, b + 1, t) for i, b, t in rows]
    df = spark.createDataFrame([(*r, "h") for r in rows] + [(None, 1, "x y z", None), (9999, None, "x y z", None)], "ingest_id bigint, batch_no int, text string, hash string")
    got = {r["id"] for r in repeats_of_accepted(df, threshold=0.6, accepted_batch=accepted).collect()}
    assert got == brute_repeats(rows, 0.6)


def test_a_chain_of_edits_is_decided_in_order(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[k * 6 : k * 6 + 42]) for k in range(4)]  # each shares 32 of 44 runs with the next
    df = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "ingest_id bigint, batch_no int, text string")
    expected = brute_repeats([(k, 1, t) for k, t in enumerate(texts)], 0.6)
    assert {r["id"] for r in repeats_of_accepted(df, threshold=0.6).collect()} == expected == {1, 3}
    assert repeats_of_accepted(df.limit(0)).count() == 0


def test_every_holder_of_a_paragraph_is_tried(spark):
    common = " ".join(f"c{k}" for k in range(60))
    tail = lambda *x: "\n" + " ".join(x)
    rows = [(0, 0, common + tail(*[f"o{k}" for k in range(200)])), (1, 0, common + tail(*"abcdefgh")), (2, 0, common + tail(*[f"z{k}" for k in range(300)])), (3, 1, common + tail(*"abcdefgx"))]
    df = spark.createDataFrame(rows, "ingest_id bigint, batch_no int, text string")
    blind = SetSketch(bands=1, rows=256)  # its one band only finds equal sets
    assert {r["id"] for r in repeats_of_accepted(df, threshold=0.6, accepted_batch=0, sketch=blind).collect()} == brute_repeats(rows, 0.6) == {3}
