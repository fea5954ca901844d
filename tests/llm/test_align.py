"""Aligned tokens against whole encodings and plain loops."""

import collections
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from tidewave.llm import align
from tidewave.llm.queries import model_bytes, op13_token_alignment, vocabulary

PARTS = ["foo", " ", " ", " ", "  ", "\n", "\n\n", "\t", "bar,", "'s", "the", "é", "ñ", "日本", "　", " ", "", "🎉", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>",
         "▁", "123", "\x00", "\x1c", "é", "ﬁ", "xyzzyx" * 4, "\x7f", "\r\n", "…", "Ωß", "▁▁"]


@pytest.fixture(scope="module")
def files():
    return vocabulary("byte_bpe_50k.json"), model_bytes("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers(files):
    return align.Aligner(*files)


def plain(tools, text):
    """(n_a, n_b, n_groups, n_links), groups and {pair: links} of a text, encoded whole."""
    nothing = (0, 0, 0, 0), "", {}
    if not text:
        return nothing
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    x, y = [tools.a_bytes[i] for i in a], [tools.b_bytes[i] for i in b]
    if not b"".join(x) == (" " + text).encode() == b"".join(y):
        return nothing
    ends = [set(np.cumsum([len(t) for t in z]).tolist()) for z in (x, y)]
    groups, at, sides = [], [0, 0], [0, 0]
    for end in sorted(ends[0] & ends[1]):
        group = []
        for k, (ids, spelt) in enumerate(((a, x), (b, y))):
            mine = []
            while sides[k] < end:
                mine.append(ids[at[k]])
                sides[k] += len(spelt[at[k]])
                at[k] += 1
            group.append(mine)
        groups.append(group)
    pairs = collections.Counter()
    for g in groups:
        na, nb = collections.Counter(g[0]), collections.Counter(g[1])
        for i in na:
            for j in nb:
                pairs[i << 32 | j] += na[i] * nb[j]
    name = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
    return (len(a), len(b), len(groups), sum(pairs.values())), name, dict(pairs)


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def by_operator(tools, texts):
    found = tools.rows(pa.array(texts, pa.string()))
    for k, (counts, groups) in enumerate(zip(found.counts.tolist(), found.groups.to_pylist())):
        x, y = found.cut[k], found.cut[k + 1]
        yield tuple(counts), groups, dict(zip(found.pairs[x:y].tolist(), found.links[x:y].tolist()))


def test_groups_of_any_text(tokenizers):
    texts = [None, "", " ", "  ", "foo ", " foo", "\nfoo", "a" * 3000, "🎉" * 900, "日本" * 2000, *random_texts(3000)]
    for t, got in zip(texts, by_operator(tokenizers, texts), strict=True):
        assert got == plain(tokenizers, t), repr(t)


def test_pointers_reach_the_end_of_their_component():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        a, b = (np.union1d(rng.integers(1, n + 1, n // 2 + 1), [n]) for _ in range(2))
        to = align.last_tokens(np.diff(a, prepend=0), np.diff(b, prepend=0))
        common = np.intersect1d(a, b)
        for ends, got in ((a, to[:len(a)]), (b, to[len(a):])):
            assert (a[got] == common[np.searchsorted(common, ends)]).all()


def test_both_ways_to_encode_are_one(tokenizers):
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x280)] + ["the", "ing", " ", " ", "'ll", "'S", "12"]
    texts = [" " + "".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    assert all(align.fast_rows(pa.array(texts)))
    assert tokenizers.encode_a(texts, [True] * len(texts)) == tokenizers.encode_a(texts, [False] * len(texts))
    single = [align.fast_rows(pa.array([t], pa.string()))[0] for t in ("x" * 999, "x" * 1001, "a " * 900, "日", None, "")]
    assert single == [True, False, True, False, True, True]


def test_large_groups_unfold_over_distinct_ids():
    a, b = np.array([5, 5, 6, 7] * 50), np.array([1, 2] * 60)
    group, pair, links = align.unfolded(a, b, np.array([200]), np.array([120]))
    assert links.sum() == 200 * 120 and len(pair) == 6 and dict(zip(pair.tolist(), links.tolist()))[5 << 32 | 1] == 100 * 60


def weights(tools, texts):
    found = [plain(tools, t) for t in texts]
    docs = collections.Counter(p for f in found for p in f[2])
    most = collections.defaultdict(int)
    for p, n in docs.items():
        most[p >> 32] = max(most[p >> 32], n)
    return [(*f[0], sum(n for p, n in f[2].items() if docs[p] == most[p >> 32]), sum(n * docs[p] for p, n in f[2].items()),
             brute.sha256(f[1].encode()) if f[1] else "") for f in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query(spark, tokenizers):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = op13_token_alignment(spark, SF).orderBy("doc_id").collect()
    want = weights(tokenizers, [r.text for r in rows])
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert [tuple(r[c] for c in COLUMNS) for r in got] == want


def test_edges_and_both_ways_of_lookup(spark, files, tokenizers):
    texts = [None, "", "same text", "same text", "same text", "▁", "word " * 60_000, "x" * 20_000, *random_texts(40, 8)]
    rows = [(i % 45 or None, t, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string, other string").repartition(3)
    done = align.written(align.align(df, *files))
    counts = align.pair_counts(done)
    want = sorted(w[:6] for w in weights(tokenizers, texts))
    for limit in (0, None):
        got = align.weigh(done, counts, limit).collect()
        assert sorted(tuple(r[c] for c in COLUMNS[:6]) for r in got) == want
        assert {r.other for r in got} == {"clash"}
    empty = align.written(align.align(df.limit(0), *files))
    assert align.weigh(empty, align.pair_counts(empty)).count() == 0
