"""The pipeline's near-dedup against all pairs by five-word Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from namewright.llm import near_copies

DATA = "/root/testdata/sf0.001"


def grams(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{id: text} -> {id: smallest id reachable}"""
    ids, root, sets = sorted(rows), {i: i for i in rows}, {i: grams(t) for i, t in rows.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def test_stage_drops_edited_copies(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()}
    assert kept == {i for i, c in want.items() if c == i}
    # Seven and eleven bits of the fingerprint apart.
    assert {6, 1} <= kept and not {145, 177} & kept


@pytest.mark.parametrize("block_shingles", [near_copies.BLOCK_SHINGLES, 700])
def test_made_families(spark, block_shingles):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = {}
    for family in range(4):
        base = [word() for _ in range(200)]
        for k in range(15):
            w = list(base)
            for at in rng.sample(range(200), rng.choice((0, 1, 2, 4, 6, 9))):
                w[at] = word()
            rows[family * 15 + k] = " ".join(w)
    rows |= {100: None, 101: " ", 102: "one two", 103: "One  TWO", 104: "one"}
    got = near_copies.near_copies(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), block_shingles).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)


def test_parts_of_a_star_and_a_chain():
    star = [np.arange(0, 100)] + [np.concatenate([np.arange(0, 100), np.arange(1000 * k, 1000 * k + 20)]) for k in range(1, 30)]
    chain = [np.arange(50_000 + 5 * k, 50_100 + 5 * k) for k in range(20)]
    part = near_copies.linked_parts([s.astype(np.uint64) for s in [*star[1:], *chain, star[0]]])
    assert len(set(part[:29]) | {part[-1]}) == 1 and len(set(part[29:-1])) == 1 and part[0] != part[29]


def test_links_of_odd_sets():
    base = np.arange(100, dtype=np.uint64)
    sets = [base, base + 5, base + 500, base + 3, base + 505, base + 9000]
    got = near_copies.linked_labels(sets, np.array([7, 7, 8, 9, 10, 11]), np.array([False, False, False, True, True, True]))
    assert got == [(3, 7), (4, 8)]


@pytest.mark.parametrize("block_shingles", [300, 1500])
def test_large_clusters_are_dealt_to_blocks(spark, block_shingles):
    """Chains: each text is like its neighbours only, so that a cluster hangs together through many texts and shards."""
    rng = random.Random(11)
    rows = {}
    for chain in range(2):
        w = ["".join(rng.choices("klmnopqrst", k=6)) for _ in range(200)]
        for k in range(30):
            rows[chain * 100 + k] = " ".join(w[3 * k : 3 * k + 100])
    base = ["".join(rng.choices("abcde", k=7)) for _ in range(120)]
    for k in range(30):
        w = list(base)
        for at in rng.sample(range(120), 1 + k % 7):
            w[at] = f"other{k}x{at}"
        rows[1000 + k] = " ".join(w)
    got = near_copies.near_copies(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), block_shingles).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)
