"""Pairs that meet in common keys, and what is verified on whole sets."""

import random

import brute
from pyspark.sql import functions as F

from tidewave.llm import components, parity_join


def crowd(seed=21):
    """Texts of a common passage and some words of their own, so that most share many keys and few are similar."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(36)]
    own = lambda n: [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    return [" ".join(passage + own(rng.randint(4, 9))) for _ in range(90)] + [" ".join(own(30)) for _ in range(20)]


def watch(monkeypatch, name, seen):
    plain = getattr(parity_join, name)

    def told(*args, **more):
        seen.append((args, out := plain(*args, **more)))
        return out

    monkeypatch.setattr(parity_join, name, told)


def test_pairs_of_common_keys_come_once_and_only_plausible_ones_are_verified(spark, monkeypatch):
    texts, met, judged = crowd(), [], []
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    watch(monkeypatch, "block_pairs", met)
    watch(monkeypatch, "verified", judged)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.link(df).collect()}
    assert got == brute.components(dict(enumerate(texts)))
    members = met[0][0][0]
    assert members.groupBy("class").count().agg(F.max("count")).first()[0] > 5
    pairs = [tuple(r) for r in met[-1][1].select("a", "b").collect()]
    # in one key, however many both have
    assert len(pairs) == len(set(pairs)) > 0
    for (pairs, sets), _ in judged:
        pairs = parity_join.cut_lineage(pairs)
        assert parity_join.plausible(pairs, sets).count() == pairs.count()


def test_bytes_of_a_key_do_not_grow_with_the_ranges(spark):
    df = spark.createDataFrame(list(enumerate(crowd())), "doc_id long, text string").coalesce(1)
    n_keys = parity_join.classes(df).agg(F.sum("n_keys")).first()[0]
    for n_ranges in (1, 40, 4000):
        packed = parity_join.packed_keys(df, "text", n_ranges).where("not common")
        size = packed.agg(F.sum(F.octet_length("keys") + F.octet_length("names"))).first()[0]
        assert 0 < size <= 9 * n_keys


def test_classes_of_one_short_name_are_compared(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "short_name", lambda name: (name & 0x40) | name & 63)
    monkeypatch.setattr(parity_join, "short_of", lambda name: F.col(name).bitwiseAND(127))
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(40)] for _ in range(12)]
    texts = crowd()[::4] + [" ".join(words + [f"x{k}"] * k) for words in base for k in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert parity_join.namesakes(parity_join.names_of(parity_join.classes(df))).count() > 100
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.link(df).collect()}
    want = brute.components(dict(enumerate(texts)))
    assert got == want and len({c for _, c in want.values()}) < len(texts)


def test_rounds_walk_new_links_and_look_at_unfinished_keys(spark, monkeypatch):
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage + [f"w{rng.randint(0, 10**6)}" for _ in range(10 + k % 8)]) for k in range(80)]
    texts += crowd()
    monkeypatch.setattr(parity_join, "FIRST_PAIRS", 1)
    walked, judged, met = [], [], []
    plain = components.components

    def counted(links):
        walked.append(links.count())
        return plain(links)

    monkeypatch.setattr(components, "components", counted)
    monkeypatch.setattr(parity_join, "components", counted)
    watch(monkeypatch, "verified", judged)
    watch(monkeypatch, "block_pairs", met)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.link(df).collect()}
    assert got == brute.components(dict(enumerate(texts)))
    assert len(walked) > 2 and sum(walked) <= sum(links.count() for _, links in judged)
    keys = [args[0].select("key").distinct().count() for args, _ in met]
    assert len(keys) > 2 and keys[2] < keys[1]
