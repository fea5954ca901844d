"""Prefix BPE and plane files against the tokenizers library and as round trips."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from tokenizers import Tokenizer

from tidewave.llm import bpe, chunks, planes
from tidewave.llm.queries import op2_token_planes, op9_prefix_bpe, vocabulary
from tidewave.sources.io import new_folder

ALPHABET = ["a", "é", "Σ", "ς", "İ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|startoftext|>", "'s", "'re", "9", "½", "!", "?!", "...", "日本",
            "the", "ING", "J̌", "é", "́", "ﬁ", "🎉", "Ⅷ", "ǅ", "​", "　", "<|", "|>", "_", "Ω", "\x00", "ß", ",", "."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(vocabulary())


def random_texts(n, seed=2):
    rng = random.Random(seed)
    names = [t.replace("</w>", "") for t in bpe.PrefixEncoder(vocabulary()).vocab if t.isascii()]
    return ["".join(rng.choice(ALPHABET) if rng.random() < 0.6 else rng.choice(names) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_encoders_agree_with_the_library(library):
    texts = random_texts(4000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for memory in (bpe.prefix_memory(vocabulary()), chunks.library_memory(vocabulary())):
        assert [x.tolist() for x in memory.of(pa.array(texts))] == want


def test_small_memory_gives_the_same(library):
    texts = random_texts(300, 9)
    small = chunks.Remembered(chunks.library_encoder(vocabulary()), limit=7)
    for _ in range(2):
        for t in texts:
            assert next(small.of(pa.array([t]))).tolist() == library.encode(t, add_special_tokens=False).ids


EDGES = [(3, "Hello World"), (1, None), (2, ""), (2, "tie"), (None, "no id"), (9, "x " * 50_000), (4, "y" * 3000), (5, "hello world"), (5, "hello world")]


def test_queries_against_the_library(spark, library):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    a = {r.doc_id: r for r in op2_token_planes(spark, SF).collect()}
    b = {r.doc_id: r for r in op9_prefix_bpe(spark, SF).collect()}
    start = 0
    for d, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        with_end = np.asarray([*ids, 2], "<u4").tobytes()
        assert (a[d].start, a[d].n_tokens, a[d].ids_crc32) == (start, len(ids) + 1, zlib.crc32(with_end))
        assert (b[d].n_tokens, b[d].ids_sha256) == (len(ids), brute.sha256(np.asarray(ids, "<u4").tobytes()))
        assert b[d].decoded_sha256 == brute.sha256(library.decode(ids, skip_special_tokens=False).encode())
        start += len(ids) + 1


@pytest.mark.parametrize("bits", [False, True])
def test_plane_files_round_trip(spark, library, bits):
    df = spark.createDataFrame([(d, t, "x") for d, t in EDGES], "doc_id long, text string, start string")
    folder = new_folder(spark, "planes-test")
    planes.write(df, folder, vocabulary(), end_id=2, bits=bits, block_ids=1000, text_bytes_per_file=20_000)
    got = sorted(planes.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 5, 5, 9]
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) // 4 for r in got)])[:-1].tolist()
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in EDGES)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == want


def test_plane_file_gives_single_documents(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 5000, 64, 0, 129)]
    for bits in (False, True):
        writer = planes.PlaneWriter(f"{tmp_path}/f{bits}", bits, block_ids=64)
        for i, d in enumerate(docs):
            writer.add(i, d)
        writer.close()
        reader = planes.PlaneReader(f"{tmp_path}/f{bits}")
        for i in (5, 2, 0, 3):
            assert (reader.ids(*reader.docs[i][2:].tolist()) == docs[i]).all()
    (tmp_path / "bad").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        planes.PlaneReader(f"{tmp_path}/bad")


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = new_folder(spark, "planes-test")
    planes.write(df, folder, vocabulary())
    assert planes.read(spark, folder).count() == 0
    assert bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).count() == 0


def test_bpe_edges_and_clashing_columns(spark, library):
    df = spark.createDataFrame([(d, t, "old", "old") for d, t in EDGES], "doc_id long, text string, ids string, decoded string")
    got = bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).collect()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert len(got) == len(EDGES)


def test_decoding_in_the_same_pass(spark):
    df = spark.createDataFrame([(d, t, "clash") for d, t in EDGES], "doc_id long, text string, decoded string")
    one = bpe.encode(df, vocabulary(), decoded="decoded")
    two = bpe.decode(bpe.encode(df.drop("decoded"), vocabulary()), vocabulary())
    key = lambda r: (str(r.doc_id), r.text or "")
    assert one.columns == two.columns and sorted(one.collect(), key=key) == sorted(two.collect(), key=key)
