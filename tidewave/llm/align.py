"""Alignment of the tokens of two tokenizers by pointer jumping.

Both encode the same bytes, a space and the text. Every token points to the farthest-right token that
overlaps it, whichever tokenizer it is from. Doubling all pointers at once until none moves brings every token to the
last token of its component, which ends where both tokenizers end a token. Tokens with the same last token are a group.

A task aligns a few megabytes of text in one vector: every text ends with a token of both, so groups never span texts.

Defined results: null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens; each
row is a document of its own, also when another has its text or doc_id; strings of special tokens are plain text; an empty table gives an
empty one. A column named like an output is replaced, the text is dropped, further columns are kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm.chunks import byte_symbols, texts_of
from tidewave.llm.memory import give_back
from tidewave.llm.words import bytes_of, pieces
from tidewave.sources.io import new_folder

# Distinct id pairs that are looked up as a broadcast of 17 bytes each; beyond it they are joined.
BROADCAST_PAIRS = 2_000_000
ROWS_AT_ONCE = 500
TEXT_BYTES = 1 << 20
# Fixed value: pieces of text in the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts of letters below U+0280, which all versions of Unicode know, and without longer words go the fast way.
FAST_BELOW, FAST_WORD = 0xCA, 1000
# A group of more links is unfolded over its distinct ids.
PLAIN_LINKS = 4096
HALF = 32
LOW = (1 << HALF) - 1
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
OUTPUTS = (*COUNTS, "groups", "pairs", "pair_links")


def last_tokens(a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """For every token of A, then of B, the token of A at the end of its component.

    ``a_size``, ``b_size``: bytes of the tokens, none empty, of the same total.
    """
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    n = len(a_end)
    here = np.arange(n)
    # the token of the other side that holds a token's last byte is the farthest that overlaps it
    over_a = np.repeat(np.arange(len(b_end)), b_size)[a_end - 1]
    over_b = np.repeat(here, a_size)[b_end - 1]
    # a token of B that ends with one of A points to that one, which points to itself
    to = np.concatenate([np.where(b_end[over_a] > a_end, n + over_a, here), over_b])
    while True:
        jumped = to[to]
        if np.array_equal(jumped, to):
            return to
        to = jumped


def unfolded(a_ids: np.ndarray, b_ids: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair, links) of all links; ids are in group order, sizes are tokens per group."""
    a_start, b_start = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
    links = a_size * b_size
    plain = np.where(links <= PLAIN_LINKS, links, 0)
    group = np.repeat(np.arange(len(links)), plain)
    k = np.arange(len(group)) - np.repeat(np.cumsum(plain) - plain, plain)
    pair = a_ids[a_start[group] + k // b_size[group]] << HALF | b_ids[b_start[group] + k % b_size[group]]
    found = [(group, pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(links > PLAIN_LINKS):
        a, n = np.unique(a_ids[a_start[g]:a_start[g] + a_size[g]], return_counts=True)
        b, m = np.unique(b_ids[b_start[g]:b_start[g] + b_size[g]], return_counts=True)
        found.append((np.full(len(a) * len(b), g), (a[:, None] << HALF | b[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


@dataclass
class Aligned:
    """Aligned rows of a column: counts (``COUNTS``) and groups of each, and its sorted distinct pairs from ``cut`` on."""

    counts: np.ndarray
    groups: pa.Array
    pairs: np.ndarray
    links: np.ndarray
    cut: np.ndarray


class Aligner:
    """The two tokenizers."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte_of = {s: x for x, s in enumerate(byte_symbols())}
        vocab = {bytes(byte_of[c] for c in t): i for t, i in self.a.get_vocab(False).items()}
        # ids of the vocabulary follow the order of its merges, which is all the fast way needs to know
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.a_bytes = [b""] * self.a.get_vocab_size(True)
        for t, i in vocab.items():
            self.a_bytes[i] = t
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << HALF:
            raise ValueError("the vocabularies are too large together")
        self.digits = digit_table(max(len(self.a_bytes), len(self.b_bytes)))

    def encode_a(self, texts: list[str], fast: list[bool]) -> list[list[int]]:
        ids = [self.fast.encode_ordinary(t) if f else [] for t, f in zip(texts, fast)]
        slow = [k for k, f in enumerate(fast) if not f]
        for k, e in zip(slow, self.a.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False)):
            ids[k] = e.ids
        return ids

    def rows(self, column: pa.Array) -> Aligned:
        """Align the texts of a column of a few megabytes."""
        texts = texts_of(column)
        fast = fast_rows(column)
        given = [k for k, t in enumerate(texts) if t]
        a_ids = self.encode_a([" " + texts[k] for k in given], [fast[k] for k in given])
        b_ids = self.b.encode([texts[k] for k in given], num_threads=1) if given else []
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        good = [j for j, k in enumerate(given) if b"".join([a_bytes[i] for i in a_ids[j]]) == (" " + texts[k]).encode() == b"".join([b_bytes[i] for i in b_ids[j]])]
        row = np.array([given[j] for j in good], np.int64)
        a_ids, b_ids = [a_ids[j] for j in good], [b_ids[j] for j in good]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids))
        n = len(texts)
        counts = np.zeros((n, 4), np.int64)
        if not len(row):
            return Aligned(counts, pa.array([""] * n, pa.string()), a, a, np.zeros(n + 1, np.int64))
        to = last_tokens(self.a_size[a], self.b_size[b])
        labels = (np.cumsum(to[:len(a)] == np.arange(len(a))) - 1)[to]
        a_group, b_group = labels[:len(a)], labels[len(a):]
        n_groups = int(a_group[-1]) + 1
        a_size, b_size = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        counts[row, 0] = list(map(len, a_ids))
        counts[row, 1] = list(map(len, b_ids))
        first = a_group[np.cumsum(counts[row, 0]) - counts[row, 0]]
        counts[row, 2] = np.diff(first, append=n_groups)
        counts[row, 3] = np.add.reduceat(a_size * b_size, first)
        owner = np.repeat(row, counts[row, 2])
        pairs, links, cut = self.distinct(owner, *unfolded(a, b, a_size, b_size), n)
        return Aligned(counts, self.text(a, b, a_size, b_size, owner, n), pairs, links, cut)

    def distinct(self, owner: np.ndarray, group: np.ndarray, pair: np.ndarray, links: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each row with their links, and where rows start."""
        width = len(self.b_bytes)
        key = owner[group] << HALF | ((pair >> HALF) * width + (pair & LOW))
        if links.max(initial=1) > 1:
            order = np.argsort(key, kind="stable")
            key, links = key[order], links[order]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            sums = np.add.reduceat(links, new)
        else:
            key = np.sort(key)
            new = np.flatnonzero(np.diff(key, prepend=-1))
            sums = np.diff(new, append=len(key))
        key = key[new]
        code = key & LOW
        return code // width << HALF | code % width, sums, np.searchsorted(key >> HALF, np.arange(n + 1))

    def text(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
        """``a1,a2|b1;a3|b2`` of each row, from a table of digits: each token with the character behind it."""
        end = np.cumsum(a_size + b_size)
        ids, behind = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        a_at = np.arange(len(a)) + np.repeat(np.cumsum(b_size) - b_size, a_size)
        ids[a_at] = a
        ids[np.arange(len(b)) + np.repeat(np.cumsum(a_size), b_size)] = b
        behind[end - b_size - 1] = ord("|")
        behind[end - 1] = ord(";")
        last = end[np.flatnonzero(np.diff(owner, append=-1))] - 1
        behind[last] = 0
        digits, size = self.digits
        table = digits[ids]
        table[np.arange(len(ids)), size[ids]] = behind
        length = size[ids] + (behind != 0)
        flat = table[np.arange(table.shape[1]) < length[:, None]]
        ends = np.cumsum(length)[last]
        edges = np.zeros(n + 1, np.int32)
        edges[owner[np.flatnonzero(np.diff(owner, append=-1))] + 1] = np.diff(ends, prepend=0)
        return pa.StringArray.from_buffers(n, pa.py_buffer(np.cumsum(edges, dtype=np.int32).tobytes()), pa.py_buffer(flat.tobytes()))


def digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below n, with room for one more character, and how many there are."""
    names = [str(i).encode() for i in range(n)]
    width = len(names[-1]) + 1
    table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in names), np.uint8).reshape(n, width).copy()
    return table, np.array(list(map(len, names)))


def fast_rows(column: pa.Array) -> list[bool]:
    """Texts of plain letters whose words are short; see FAST_BELOW."""
    data, offsets = bytes_of(column)
    high = np.concatenate([[0], np.cumsum(data >= FAST_BELOW)])
    blank = np.concatenate([[-1], np.flatnonzero(data <= 32), [len(data)]])
    long = np.flatnonzero(np.diff(blank) > FAST_WORD)
    plain = np.diff(high[offsets]) == 0
    for a, b in zip(blank[long], blank[long + 1]):
        plain[max(0, np.searchsorted(offsets, a, "right") - 1):np.searchsorted(offsets, b, "left")] = False
    return plain.tolist()


def align(df: DataFrame, a_json: str, b_model: bytes, text: str = "text") -> DataFrame:
    """Add the counts of tokens, groups and links, ``groups`` (``a1,a2|b1;a3|b2``), and the distinct linked id
    pairs (``a << 32 | b``) with the links of each; the text is dropped."""
    files = df.sparkSession.sparkContext.broadcast((a_json, b_model))
    kept = [f for f in df.schema.fields if f.name not in (*OUTPUTS, text)]
    long, array = T.LongType(), T.ArrayType(T.LongType(), False)
    schema = T.StructType([*kept, *(T.StructField(c, long) for c in COUNTS), T.StructField("groups", T.StringType()),
                           T.StructField("pairs", array), T.StructField("pair_links", array)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, names = None, [f.name for f in kept]
        for batch in batches:
            aligner = aligner or Aligner(*files.value)
            where = batch.schema.get_field_index(text)
            for a, b in pieces(batch.column(where), TEXT_BYTES):
                part = batch.slice(a, b - a)
                found = aligner.rows(part.column(where))
                for x in range(0, part.num_rows, ROWS_AT_ONCE):
                    rows = part.slice(x, ROWS_AT_ONCE)
                    y = x + rows.num_rows
                    low, high = found.cut[x], found.cut[y]
                    edges = pa.array((found.cut[x:y + 1] - low).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(rows.schema.get_field_index(c)) for c in names), *(pa.array(found.counts[x:y, k]) for k in range(4)),
                         found.groups.slice(x, y - x), pa.ListArray.from_arrays(edges, pa.array(found.pairs[low:high])),
                         pa.ListArray.from_arrays(edges, pa.array(found.links[low:high]))],
                        names=[*names, *OUTPUTS])
        del aligner
        give_back()

    return df.mapInArrow(run, schema)


def written(aligned: DataFrame) -> DataFrame:
    """The aligned rows in the shared folder, each with a number of its own (``_row``)."""
    path = new_folder(aligned.sparkSession, "alignment")
    aligned.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    return aligned.sparkSession.read.parquet(path)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that hold each id pair linked, and whether no pair of its first id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    path = new_folder(aligned.sparkSession, "pair-counts")
    counts.write.parquet(path)
    counts = aligned.sparkSession.read.parquet(path).withColumn("_a", F.shiftright("pair", HALF))
    most = counts.groupBy("_a").agg(F.max("n_docs").alias("_most"))
    return counts.join(most, "_a").select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def weigh(aligned: DataFrame, counts: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to written aligned rows. Pairs within the limit are looked up in
    each task; more of them are joined, pair by pair."""
    limit = BROADCAST_PAIRS if limit is None else limit
    if counts.count() > limit:
        each = aligned.select("_row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("_x"))
        each = each.select("_row", F.col("_x.pairs").alias("pair"), F.col("_x.pair_links").alias("_n"))
        sums = each.join(counts, "pair").groupBy("_row").agg(
            F.sum(F.when(F.col("best"), F.col("_n")).otherwise(0)).alias("n_best"), F.sum(F.col("_n") * F.col("n_docs")).alias("count_sum"))
        out = aligned.drop("n_best", "count_sum").join(sums, "_row", "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    table = counts.select("pair", "n_docs", "best").toArrow()
    order = np.argsort(table["pair"].to_numpy())
    shared = aligned.sparkSession.sparkContext.broadcast(
        tuple(np.ascontiguousarray(table[c].to_numpy(zero_copy_only=False)[order]) for c in ("pair", "n_docs", "best")))
    kept = [f for f in aligned.schema.fields if f.name not in ("n_best", "count_sum")]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, n_docs, best = shared.value
            lists, links = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("pair_links"))
            n = np.asarray(links.flatten(), np.int64)
            at = np.searchsorted(known, np.asarray(lists.flatten(), np.int64))
            edge = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
            sums = (np.concatenate([[0], np.cumsum(x)])[edge] for x in (n * best[at], n * n_docs[at]))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.diff(s)) for s in sums)], names=[f.name for f in schema.fields])
        give_back()

    return aligned.mapInArrow(run, schema)
