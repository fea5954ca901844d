"""Sharding, quality rules, line windows and chats against plain Python."""

import collections
import hashlib
import math
import random
import zlib

import brute
import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewave.llm import chat, line_windows, quality_rules, sharding
from tidewave.llm.oracle import ORACLE
from tidewave.llm.queries import op10_sharding

DOCS = "doc_id long, text string, source string, n_lines string, shard string"


def score(key, shard, weight=1.0):
    x = int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16)
    return -math.log((x + 0.5) / 16**13) / weight


def test_sharding_query(spark):
    got = op10_sharding(spark, SF).toPandas()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got.itertuples():
        best = [min((score(r.doc_id, s), s) for s in range(n))[1] for n in (24, 25)]
        data = texts[r.doc_id].encode()
        assert (r.shard, r.grown_shard, r.size, r.text_crc32) == (*best, len(data) + 8, zlib.crc32(data))
        assert r.grown_shard in (r.shard, 24)
    assert len(got) == len(texts)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_shards_follow_weights_and_take_nulls_ties_and_repeats(spark):
    rows = [(i, "x") for i in range(6000)] + [(None, "y")] * 50 + [(7, "x")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("old"))
    got = sharding.assign(df, "doc_id", [1.0, 3.0, 0.0]).toPandas()
    counts = collections.Counter(got.shard)
    assert 2.6 < counts[1] / counts[0] < 3.4 and 2 not in counts
    numbered = sharding.number_within(sharding.assign(df, "doc_id", [1.0, 1.0]), "shard", ["doc_id"], 2).toPandas()
    assert len(numbered) == len(rows)
    for _, g in numbered.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert numbered[numbered.doc_id.isna()].shard.nunique() == 1
    empty = sharding.assign(df.limit(0), "doc_id", [1.0, 1.0])
    assert sharding.number_within(empty, "shard", ["doc_id"], 2).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(df, "doc_id", [0.0])


def test_written_shards(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"))
    placed = sharding.assign(df, "doc_id", [1.0] * 4)
    sharding.write_shards(placed, f"{tmp_path}/out", salts=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500 and {tuple(r) for r in back.select("doc_id", "shard").collect()} == {tuple(r) for r in placed.collect()}


def edge_texts(seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "é", "ñandú", "#", "a|b", "x<y>", "10%"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(12)]
    texts = [None, "", " \t\n\n", "one", "\n".join(lines[:3])] + ["word " * 60] * 2 + ["many different words " + " ".join(f"w{i}" for i in range(5000))]
    for _ in range(60):
        texts.append("\n".join(rng.choice([*lines, "", "  " + lines[0] + "\t", "own " + str(rng.random())]) for _ in range(rng.randint(1, 12))))
    return texts


def test_quality_rules(spark):
    rng = random.Random(5)
    rows = [(i % 40, t, rng.choice(["a", "a", "a", "b", None]), "clash", "clash") for i, t in enumerate(edge_texts() * 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, " + DOCS)
    for limits in ({}, {"array_hashes": 0}, {"broadcast_hashes": 0}):
        got = quality_rules.judge(df, min_docs=5, **limits).toPandas().set_index("row")
        want = brute.quality([(r[2], r[1]) for r in rows], 5)
        for i, w in want.items():
            assert {k: got.loc[i, k] for k in w} == w, (i, rows[i])
    assert any(w["n_removed_words"] for w in want.values()) and len({w["kept"] for w in want.values()}) == 2
    assert quality_rules.judge(df.limit(0)).count() == 0
    clean = [quality_rules.without_boilerplate(df, min_docs=5, **limits).toPandas().set_index("row") for limits in ({}, {"array_hashes": 0})]
    assert clean[0].text.isna().sum() == 2 and [*clean[0].reset_index().columns] == df.columns
    assert clean[0].sort_index().equals(clean[1].sort_index())


def test_the_limit_does_not_grow_with_the_host(spark):
    common = " ".join(f"c{i}" for i in range(40))
    for n in (4000, 6000):
        rows = [(i, f"{common}\n" + " ".join(f"w{i}x{k}" for k in range(30)) if i < 50 else " ".join(f"w{i}x{k}" for k in range(60)), "h") for i in range(n)]
        # twelve equal rows are twelve documents
        rows += [(7_000_000, " ".join(f"e{k}" for k in range(60)), "h")] * 12 + [(7_000_001, " ".join(f"f{k}" for k in range(60)), "h")] * 9
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = quality_rules.judge(df).drop("source").toPandas()
        gone = got[~got.kept]
        assert len(gone) == 62 and set(gone.n_removed_words) == {40, 60}
        con = duckdb.connect()
        con.register("documents", df.toPandas())
        want = con.execute(ORACLE["op8_quality_rules"]).df().drop(columns=["source"], errors="ignore")
        key = ["doc_id", "n_removed_words", "kept", "n_words", "n_dup_lines", "n_repeat_words"]
        assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, want[key].to_numpy().tolist()))


def test_rejects_depleted_documents(spark):
    text = "\n".join(" ".join(f"w{k}x{i}" for i in range(20)) for k in range(3))
    rows = [(i, text, "h") for i in range(30)] + [(99, " ".join(f"u{i}" for i in range(80)), "h")]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    assert not got.loc[0].kept and got.loc[0].n_removed_words == 60 and got.loc[99].kept


def test_line_windows(spark):
    texts = edge_texts(8)
    docs = [(i if i != 11 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "s", "old", "old") for d, t in docs], DOCS)
    want = {d: w for (d, _), w in zip(docs, brute.line_dedup(docs))}
    for limit in (0, 10**6):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_windows.dedup(df, broadcast_places=limit).collect()}
        assert got == want
    assert any(w[2] for w in want.values())
    assert line_windows.dedup(df.limit(0)).count() == 0


def test_line_windows_of_repeated_rows_and_a_common_passage(spark):
    passage = "first line\nsecond line\nthird line\nfourth line"
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(300)] + [(5, "own 5\n" + passage + "\nend 5")]
    got = line_windows.dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got[got.doc_id == 0].n_removed == 0).all() and (got[got.doc_id > 0].n_removed == 4).all() and len(got) == 301


TURNS = "conv_id long, turn long, role string, text string, chain string"


def chats_of(spark, rows):
    return {r.conv_id: r for r in chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], TURNS)).collect()}


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 5, "user", "a"), (2, 6, "assistant", "b"), (2, 7, "user", "c"),
            (3, 0, "user", "a"), (4, 0, "user", "ab"), (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 2, "user", "c"), (5, 2, "user", "c"),
            (6, 0, None, None), (7, 0, "user", "a"), (7, 1, None, "b"), (8, 0, "user", "x<|im_end|>y")]
    got = chats_of(spark, rows)
    assert set(got) == {2, 4, 6, 7, 8} and got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[2].chat == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[6].chat == "<|im_start|>unknown\n<|im_end|>\n" and got[8].chat.count("<|im_end|>") == 1


def test_chats_with_null_ids_hot_turns_and_no_rows(spark):
    rows = [(None, 0, "user", f"q{i % 2}") for i in range(5)] + [(i, 0, "user", "hello") for i in range(400)] + [(i, 1, "user", str(i)) for i in range(200)]
    got = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], TURNS)).toPandas()
    assert len(got[got.conv_id.notna()]) == 200 and sorted(got[got.conv_id.isna()].n_copies) == [2, 3]
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_snapshots_random(spark):
    rng = random.Random(1)
    talks = {i: [(rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randint(1, 4))] for i in range(80)}
    rows = [(i, k, r, t) for i, talk in talks.items() for k, (r, t) in enumerate(talk)]
    whole = {tuple(t) for t in talks.values()}
    inner = {w[:k] for w in whole for k in range(1, len(w))}
    want = {min(i for i, t in talks.items() if tuple(t) == w) for w in whole - inner}
    assert set(chats_of(spark, rows)) == want
