"""Decontamination and near duplicates against plain Python."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewave.llm import components as components_module
from tidewave.llm import decontaminate, language, parity_join, words
from tidewave.llm.components import components
from tidewave.llm.queries import op1_parity_join, op3_decontamination


def test_suffix_order():
    rng = np.random.default_rng(4)
    for n in (1, 2, 17, 200):
        x = rng.integers(0, 3, n) + 1
        x[-1] = 0
        assert decontaminate.suffix_order(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_wavelet_ranks():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 11, 333)
    tree = decontaminate.WaveletMatrix(x, 11)
    c, i = rng.integers(0, 11, 200), rng.integers(0, 334, 200)
    assert tree.rank(c, i).tolist() == [int((x[:b] == a).sum()) for a, b in zip(c, i)]
    symbol, rank = tree.symbol_and_rank(i % 333)
    assert symbol.tolist() == x[i % 333].tolist() and rank.tolist() == [int((x[:b] == x[b]).sum()) for b in i % 333]


ITEMS = [(1, "one two three"), (2, "a b c d e f g h i j k l m n o p"), (3, None), (4, "!!"), (10, "One, TWO three"), (None, "zz top"), (1, "four five")]


def random_docs(seed=6):
    rng = random.Random(seed)
    docs = [None, "", "--", "one", "x one-two three y", "ONE two Three", "zz top. é zz top", "a b c d e f g h i j k l m n o p " * 3, "b c d e f g h i j k l m n", "q " * 3000 + "four five"]
    for _ in range(150):
        part = [rng.choice(["one", "two", "three", "a", "b", "zz", "top", "ñ", "four five"]) for _ in range(rng.randint(1, 40))]
        docs.append(rng.choice([" ", ", ", "\n"]).join(part))
    return docs


@pytest.mark.parametrize("options", [{}, {"shard_words": 50, "block_bytes": 20, "sample_every": 3}])
def test_passages(spark, options):
    docs = random_docs()
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(docs)], "doc_id long, text string, n_hit string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_passages(df, items, **options).collect()}
    named = [("\\N" if i is None else i, t) for i, t in ITEMS]
    for i, t in enumerate(docs):
        n, hit, found = brute.hits(t, named)
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (n, hit, found), (i, t)
        inside = sum(len(brute.LETTERED.findall(t[s.start:s.end].translate(brute.LOWER))) for s in got[i].spans)
        assert inside == hit
    assert sum(r.n_hit > 0 for r in got.values()) > 20


def test_passages_of_nothing(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.find_passages(df, none).collect()] == [0, 0]
    assert decontaminate.find_passages(df.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_spans_are_cut_out(spark):
    df = spark.createDataFrame([("é one two three b one two three",), ("clean",), (None,)], "text string")
    found = decontaminate.find_passages(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = [r[0] for r in found.select(decontaminate.without_spans(F.col("text"), F.col("spans"))).collect()]
    assert got == ["é  b ", "clean", None]


def test_decontamination_query(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op3_decontamination(spark, SF).collect():
        n, hit, found = brute.hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), brute.sha256(",".join(found).encode()))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_reserve_covers_every_partner():
    for a in range(1, 1500):
        assert parity_join.allowed(a, 2 * a) + 1 + parity_join.reserve(a) <= a or a == 1
        for b in range(-(-3 * a // 4), 4 * a // 3 + 1):
            if b:
                assert max(0, 3 * parity_join.reserve(a) // 4 - 1) <= parity_join.reserve(b)
                assert {x for x, _ in parity_join.bands(a)} & {x for x, _ in parity_join.bands(b)}


def test_linked_sets_share_the_promised_keys():
    rng = np.random.default_rng(7)
    for _ in range(600):
        n = int(rng.integers(1, 700))
        a = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        keep = a[rng.random(n) < 0.9]
        b = np.sort(np.concatenate([keep, rng.integers(0, 2**64, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
        if len(b) and parity_join.similar(a, b):
            shared = len(np.intersect1d(parity_join.keys_of(a), parity_join.keys_of(b)))
            assert shared >= 1 + min(parity_join.reserve(len(a)), parity_join.reserve(len(b)))


def near_copies(seed=11):
    """Groups of near copies, chains, copies, common passages and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = [None, "", "  ", "one", "ONE", "one two three four", "One two  three four", "one two three four five"]
    for size, changes, count in ((60, 1, 70), (200, 4, 50), (30, 1, 40), (400, 60, 12)):
        base = [word() for _ in range(size)]
        for _ in range(count):
            own = list(base)
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own))
    walk = [word() for _ in range(150)]
    for _ in range(60):  # neighbours are similar, the ends are not
        walk[rng.randrange(150)] = word()
        texts.append("\n".join(walk))
    passage = " ".join(word() for _ in range(20))
    for n in (3, 8, 40, 200):
        texts += [passage + " " + " ".join(word() for _ in range(n)) for _ in range(45)]
    return texts + texts[8:20]


def test_near_duplicates(spark):
    texts = near_copies()
    df = spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(texts)], "doc_id long, text string, class string, n string").repartition(5)
    want = brute.components(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.link(df).collect()}
    assert got == want
    kept = parity_join.keep_one(df).toPandas()
    assert sorted(kept.doc_id) == sorted({c for _, c in want.values()}) and list(kept.columns) == df.columns


@pytest.mark.parametrize("common", [2])
def test_near_duplicates_when_nearly_every_key_is_common(spark, monkeypatch, common):
    monkeypatch.setattr(parity_join, "COMMON", common)
    monkeypatch.setattr(parity_join, "BLOCK", 40)
    monkeypatch.setattr(parity_join, "KEYS_PER_RANGE", 500)
    monkeypatch.setattr(components_module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(parity_join, "BROADCAST_ROWS", 0)
    texts = near_copies(12)
    want = brute.components(dict(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.link(df).collect()} == want


def test_near_duplicates_of_null_ids_repeats_and_nothing(spark):
    long = "a b c d e f g h i j"
    rows = [(None, long), (None, long), (4, long), (4, long), (2, long + " k"), (None, None), (None, "only this one here now"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_rows) for r in parity_join.link(df).collect()), key=str)
    assert got == sorted([(None, 2, 5), (None, 2, 5), (4, 2, 5), (4, 2, 5), (2, 2, 5), (None, None, 1), (None, None, 1), (9, 9, 1)], key=str)
    kept = sorted((tuple(r) for r in parity_join.keep_one(df).collect()), key=str)
    assert kept == sorted([(2, long + " k"), (None, None), (None, "only this one here now"), (9, "")], key=str)
    assert parity_join.link(df.limit(0)).count() == 0


def test_parity_join_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_parity_join(spark, SF).collect()}
    assert got == brute.components(texts)


def thue_morse(n):
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_polynomials(spark):
    x, y = thue_morse(4096)
    got = words.words_of(pa.array([x, y, x + y, y + x, x]), words.NOT_SPACE).hashes
    assert len(set(got.tolist())) == 4 and got[0] == got[4]
    rows = [(1, f"one two three {x} five"), (2, f"one two three {y} five"), (3, x), (4, y), (5, f"one two three {x} five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in parity_join.link(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    found = decontaminate.find_passages(df, spark.createDataFrame([("b", y)], "item_id string, text string"))
    assert {r.doc_id for r in found.where("n_hit > 0").collect()} == {2, 4}
    model = language.train([("en", "hello there " * 30), ("xx", "zzz qqq " * 30)], steps=20)
    p = language.probabilities(model, pa.array([x, y, f"{x} {y}"]))
    assert np.allclose(p[2], (p[0] + p[1]) / 2)


def test_a_benchmark_beyond_the_bound_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a b c")], "item_id string, text string")
    with pytest.raises(ValueError, match="parts"):
        decontaminate.find_passages(docs, items, most_bytes=4)
