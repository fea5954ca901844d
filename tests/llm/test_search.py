"""Ranked search against a plain scoring of every document."""

import collections
import math
import random

import brute
import numpy as np

from tidewave.llm import search


def plain_rank(docs, items, k=10):
    """{(item_id, text): [(doc_id, score)]} of [(doc_id, text)] and [(item_id, text)]."""
    found = [(d, brute.LETTERED.findall((t or "").translate(brute.LOWER))) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = collections.Counter(t for _, w in found for t in set(w))
    counts = [(d, len(w), collections.Counter(w)) for d, w in found]
    out = {}
    for item in set(items):
        terms = set(brute.LETTERED.findall((item[1] or "").translate(brute.LOWER)))
        scores = []
        for d, n, held in counts:
            m = 10 + (90 * n * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * held[t]) // (1000 * held[t] + 8 * m)) for t in terms if held[t])
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out[item] = [(None if x else d, -s) for s, x, d in sorted(scores)[:k]]
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "É", "Ab", "aB"]
    def text():
        return " ".join(rng.choice(words[:rng.choice([5, 20, 64])]) for _ in range(rng.randint(0, 40)))
    docs = [(i, text()) for i in range(n)] + [(None, "w1 w2 w3"), (n + 1, None), (n + 2, ""), (n + 3, " ,;"), (n + 5, "w4 " * 30_000), (7, "w1"), (7, "w1")]
    docs += [(10_000 + i, "w50 w51 w52 w53 w54 w55") for i in range(300)]
    items = [(i, text()) for i in range(25)] + [(3, "w9 w10"), (30, None), (31, "none of these"), (32, "w50 w51 w55"), (32, "w50 w51 w55"), (33, "w0")]
    return docs, items


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "clash", "clash") for r in docs], "doc_id long, text string, score string, item_id string").repartition(4)
    i = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    got = collections.defaultdict(list)
    for r in search.rank(d, i, **options).collect():
        got[r.item_id].append((r.rank, r.doc_id, r.score))
    want = collections.defaultdict(list)
    for (item, _), rows in plain_rank(docs, items).items():
        want[item] += [(k, *r) for k, r in enumerate(rows, 1)]
    key = lambda r: (r[0], r[1] is None, r[1] or 0, r[2])
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in want.items() if v}


def test_rank(spark):
    check(spark, *corpus(500, 4))


def test_small_shards_and_blocks_of_queries(spark):
    docs, items = corpus(200, 6)
    check(spark, docs, items, shard_postings=300, block_bytes=400)


def test_empty_tables(spark):
    docs, items = corpus(30, 8)
    check(spark, docs, [], )
    check(spark, [], items)
    check(spark, [(1, None)], items)


def test_bounds_stop_early_and_stay_exact():
    rng = np.random.default_rng(2)
    n_docs, n_terms = 20_000, 12
    term = np.repeat(np.arange(n_terms), 4000)
    doc = np.concatenate([rng.choice(n_docs, 4000, replace=False) for _ in range(n_terms)])
    impact = rng.pareto(1.0, len(doc)).astype(np.int64) + 1
    shard = search.Shard(term, doc, impact, n_docs, n_terms)
    reads, bincount = [], np.bincount
    for _ in range(20):
        terms = rng.choice(n_terms, 4, replace=False)
        whole = bincount(doc[np.isin(term, terms)], impact[np.isin(term, terms)], n_docs).astype(np.int64)
        bar = np.sort(whole)[-10]
        search.np.bincount = lambda x, *a: (reads.append(len(x)), bincount(x, *a))[1]
        try:
            found, scores = shard.best(terms, 10, 0)
        finally:
            search.np.bincount = bincount
        assert found.tolist() == np.flatnonzero(whole >= bar).tolist() and (scores == whole[found]).all()
    assert min(reads) < 4 * 4000
