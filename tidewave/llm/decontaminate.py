"""Benchmark passages in documents, found through an FM-index of every training shard.

A shard is a bounded run of documents of one partition. Its words become symbols, a suffix
order of the shard gives the Burrows-Wheeler transform, and a wavelet matrix over that answers
rank queries. Windows of the benchmark are searched backwards, all at once; occurrences are
located by stepping to the next sampled suffix; spans of one document are merged.

Documents are not shuffled. The benchmark is a stated query set: it is measured, cut into
blocks of at most ``block_bytes`` and broadcast; a shard's index is built once and serves all blocks. Every task holds
all blocks, about 13 times their text, so a benchmark of more than ``most_bytes`` is refused with a ValueError: search it in parts and merge
their spans.

Defined results: null and empty texts have no words and no hits; a null item or one without
words has no window; items with the same id count once and a null id is ``\\N``; an empty
benchmark hits nothing; further columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm.memory import give_back
from tidewave.llm.words import DIGIT_OR_LETTER, Words, pieces, words_of

WINDOW = 13
SHARD_WORDS = 400_000
SAMPLE_EVERY = 16
BLOCK_BYTES = 8 << 20
MOST_BYTES = 32 << 20
OUTPUTS = {
    "n_words": T.LongType(), "n_hit": T.LongType(), "item_ids": T.ArrayType(T.StringType()),
    "spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
}


def suffix_order(first: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence by prefix doubling; only tied ones are sorted again.

    Ends of documents have symbols of their own, so suffixes of equal documents part there.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    keys = first[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]])
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    step = 1
    while len(slots):
        tied = ~(head & np.concatenate([head[1:], [True]]))
        slots = slots[tied]
        if not len(slots):
            break
        at = order[slots]
        after = np.minimum(at + step, n - 1)
        key = rank[at] * (n + 1) + np.where(at + step < n, rank[after] + 1, 0)
        inner = np.argsort(key, kind="stable")
        at, key = at[inner], key[inner]
        order[slots] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        step *= 2
    return order


class Bits:
    """Bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank of a symbol in a prefix, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(bool)
            ones = symbols[bits]
            symbols = np.concatenate([symbols[~bits], ones])
            self.levels.append((Bits(bits), len(symbols) - len(ones)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place i."""
        a, b = np.zeros_like(i), i
        for k, (bits, zeros) in enumerate(self.levels):
            up = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            ra, rb = bits.rank(a), bits.rank(b)
            a, b = np.where(up, zeros + ra, a - ra), np.where(up, zeros + rb, b - rb)
        return b - a

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        symbol, a = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in self.levels:
            up = bits.get(i).astype(bool)
            ra, ri = bits.rank(a), bits.rank(i)
            a, i = np.where(up, zeros + ra, a - ra), np.where(up, zeros + ri, i - ri)
            symbol = symbol * 2 + up
        return symbol, i - a


class FMIndex:
    """Index of documents given as word hashes; ``first`` has the first word of each and the total."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, sample_every: int = SAMPLE_EVERY):
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        n_docs, n = len(first) - 1, len(hashes) + len(first) - 1
        self.starts = first[:-1] + np.arange(n_docs)
        text = np.zeros(n, np.int64)
        is_end = np.zeros(n, bool)
        is_end[first[1:] + np.arange(n_docs)] = True
        text[~is_end] = symbols.reshape(-1) + 1
        key = text + n_docs
        key[is_end] = np.arange(n_docs)
        width = len(self.vocabulary) + n_docs + 1
        pair = key * width
        pair[:-1] += key[1:]
        order = suffix_order(pair) if n else np.empty(0, np.int64)
        start = np.zeros(n, bool)
        start[self.starts] = True
        before = np.where(start[order], 0, text[order - 1]) if n else text
        self.matrix = WaveletMatrix(before, len(self.vocabulary) + 1)
        self.first_row = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))])
        sampled = start | (np.arange(n) % sample_every == 0)
        chosen = sampled[order]
        self.sampled, self.samples = Bits(chosen), order[chosen]

    def find(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range of rows of each window of word hashes (right-aligned); windows that don't occur are left out."""
        wide = windows.shape[1]
        place = np.minimum(np.searchsorted(self.vocabulary, windows), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[place] == windows if len(self.vocabulary) else np.zeros(windows.shape, bool)
        used = np.arange(wide) >= wide - lengths[:, None]
        live = np.flatnonzero((known | ~used).all(axis=1) & (lengths > 0))
        symbols = place + 1
        low = self.first_row[symbols[live, -1]]
        high = self.first_row[symbols[live, -1] + 1]
        for back in range(2, wide + 1):
            more = lengths[live] >= back
            c = symbols[live, wide - back]
            low = np.where(more, self.first_row[c] + self.matrix.rank(c, low), low)
            high = np.where(more, self.first_row[c] + self.matrix.rank(c, high), high)
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in these rows."""
        found, steps = np.empty(len(rows), np.int64), 0
        waiting = np.arange(len(rows))
        while len(waiting):
            here = self.sampled.get(rows).astype(bool)
            found[waiting[here]] = self.samples[self.sampled.rank(rows[here])] + steps
            waiting, rows, steps = waiting[~here], rows[~here], steps + 1
            symbol, rank = self.matrix.symbol_and_rank(rows)
            rows = self.first_row[symbol] + rank
        return found


@dataclass
class QueryBlock:
    """Distinct windows of some items: hashes (right-aligned), lengths, and the items of each."""

    windows: np.ndarray
    lengths: np.ndarray
    item_first: np.ndarray
    items: np.ndarray
    names: list[str]


def query_block(rows: list[tuple[str, str]], window: int) -> QueryBlock:
    """Windows of the items (id, text)."""
    names = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(names)}
    found = words_of(pa.array([r[1] for r in rows], pa.string()), DIGIT_OR_LETTER)
    owners: dict[bytes, set[int]] = {}
    for (name, _), a, b in zip(rows, found.first[:-1].tolist(), found.first[1:].tolist()):
        size = min(window, b - a)
        for k in range(a, b - size + 1) if size else ():
            owners.setdefault(found.hashes[k:k + size].tobytes(), set()).add(number[name])
    windows = np.zeros((len(owners), window), np.uint64)
    lengths = np.zeros(len(owners), np.int64)
    for i, key in enumerate(owners):
        lengths[i] = len(key) // 8
        windows[i, window - lengths[i]:] = np.frombuffer(key, np.uint64)
    sizes = [len(s) for s in owners.values()]
    return QueryBlock(windows, lengths, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                      np.asarray([i for s in owners.values() for i in sorted(s)], np.int64), names)


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each comes from."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which], which


def search(index: FMIndex, first: np.ndarray, blocks: list[QueryBlock]) -> tuple[np.ndarray, list[set[str]]]:
    """Which words of the shard are hit, and the items found in each document."""
    n_docs = len(first) - 1
    change = np.zeros(first[-1] + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n_docs)]
    for block in blocks:
        live, low, high = index.find(block.windows, block.lengths)
        rows, which = expanded(low, high)
        if not len(rows):
            continue
        place, window = index.locate(rows), live[which]
        doc = np.searchsorted(index.starts, place, "right") - 1
        word = place - doc
        np.add.at(change, word, 1)
        np.add.at(change, word + block.lengths[window], -1)
        pairs = np.unique(np.stack([doc, window], axis=1), axis=0)
        at, source = expanded(block.item_first[pairs[:, 1]], block.item_first[pairs[:, 1] + 1])
        for d, i in zip(pairs[source, 0].tolist(), block.items[at].tolist()):
            items[d].add(block.names[i])
    return np.cumsum(change[:-1]) > 0, items


def spans_of(hit: np.ndarray, words: Words, doc: int, first: int) -> list[dict[str, int]]:
    """Merged character spans of one document's hit words; ``first`` is its first word in ``hit``."""
    a, b = int(words.first[doc]), int(words.first[doc + 1])
    own = hit[first:first + b - a].astype(np.int8)
    edge = np.diff(np.concatenate([[0], own, [0]]))
    byte = words.data[words.offsets[doc]:words.offsets[doc + 1]]
    character = np.concatenate([[0], np.cumsum((byte & 0xC0) != 0x80)])
    starts = words.starts[a:b][np.flatnonzero(edge == 1)] - words.offsets[doc]
    ends = words.ends[a:b][np.flatnonzero(edge == -1) - 1] - words.offsets[doc]
    return [{"start": int(character[s]), "end": int(character[e])} for s, e in zip(starts, ends)]


def judged(parts: list[tuple[pa.RecordBatch, Words]], blocks: list[QueryBlock], sample_every: int) -> Iterator[pa.RecordBatch]:
    """Index the parts as one shard and add the outputs to each."""
    hashes = np.concatenate([w.hashes for _, w in parts])
    counts = np.concatenate([w.counts for _, w in parts])
    first = np.concatenate([[0], np.cumsum(counts)])
    hit, items = search(FMIndex(hashes, first, sample_every), first, blocks)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:]] - total[first[:-1]]
    row = 0
    for batch, words in parts:
        n = batch.num_rows
        spans = [spans_of(hit, words, i, int(first[row + i])) if n_hit[row + i] else [] for i in range(n)]
        values = {
            "n_words": pa.array(counts[row:row + n], pa.int64()),
            "n_hit": pa.array(n_hit[row:row + n], pa.int64()),
            "item_ids": pa.array([sorted(s) for s in items[row:row + n]], pa.list_(pa.string())),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
        keep = [c for c in batch.schema.names if c not in values]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *values.values()], names=[*keep, *values])
        row += n


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, sample_every: int = SAMPLE_EVERY, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``item_ids`` and ``spans`` (characters, end excluded) to each document."""
    spark = docs.sparkSession
    given = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("\\N")).alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of benchmark text, more than {most_bytes}: search it in parts")
    n_blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(n_blocks))
    blocks = [
        spark.sparkContext.broadcast(query_block([tuple(r) for r in given.where(block == k).collect()], window))
        for k in range(n_blocks)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, Words]] = []
        n = 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in pieces(column):
                part = batch.slice(a, b - a)
                words = words_of(part.column(batch.schema.get_field_index(text)), DIGIT_OR_LETTER)
                held.append((part, words))
                n += len(words.hashes)
                if n >= shard_words:
                    yield from judged(held, [b.value for b in blocks], sample_every)
                    held, n = [], 0
        if held:
            yield from judged(held, [b.value for b in blocks], sample_every)
            held = []
        give_back()

    schema = T.StructType([f for f in docs.schema.fields if f.name not in OUTPUTS] + [T.StructField(k, v) for k, v in OUTPUTS.items()])
    return docs.mapInArrow(run, schema)


def contaminated() -> Column:
    """A twentieth of the words or more lie in windows of the benchmark."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text with its spans cut out."""
    n = F.size(spans)
    edges = F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(
        text,
        F.when(k == 0, 1).otherwise(F.element_at(spans, F.greatest(k, F.lit(1)))["end"] + 1).cast("int"),
        (F.when(k == n, F.length(text)).otherwise(F.element_at(spans, F.least(k + 1, F.greatest(n, F.lit(1))))["start"])
         - F.when(k == 0, 0).otherwise(F.element_at(spans, F.greatest(k, F.lit(1)))["end"])).cast("int"),
    ))
    return F.when(n > 0, F.array_join(edges, "")).otherwise(text)
