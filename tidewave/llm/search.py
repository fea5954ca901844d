"""Ranked search by upper and lower bounds over impact-sorted lists (no random access).

Every task indexes its documents: for each term of the queries the list of its documents, highest impact first. A query reads the lists of its
terms from the top, a little further each round. What a document has shown so far is its lower bound; with the next
impact of each list that hasn't shown it yet, it is the upper bound. Reading goes on until no document that could still reach the
k best or tie with the last of them, seen or not, has bounds apart: then membership, ties and scores are final. The k best score of the shards before
is where a shard starts from. The k best of all tasks are merged in two steps.

The queries are the given set and go to the tasks in blocks of limited size, one after another; the statistics of terms cover
all documents. Integer arithmetic throughout, but for the weight of a term.

Defined results: documents and queries with null or empty texts have no terms and rank nowhere; each row is a document, also with the
doc_id or text of another; equal scores rank by ascending doc_id, a null doc_id last; equal rows of queries count once; a
query without a matching document has no rows; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm.memory import give_back
from tidewave.llm.words import DIGIT_OR_LETTER, pieces, plain_words
from tidewave.sources.io import new_folder

BEST = 10
BLOCK_BYTES = 8 << 20
# Postings that a task sorts and searches at once, about 40 bytes each.
SHARD_POSTINGS = 2_000_000
FIRST_DEPTH = 64
DEEPER = 4
SALTS = 64
# Fixed values of the score: B of 0.9 in hundredths, K of 0.8 in units of 1/1000 x 100, and the scale of a term's part.
B, WHOLE, K, SCALE, UNIT = 90, 100, 8, 1_000_000_000, 1000


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = WHOLE - B + (B * n * n_docs) // n_terms
    return weights * ((SCALE * tf) // (UNIT * tf + K * m))


def terms_of(texts: list[str | None]) -> list[list[str]]:
    """The distinct terms of each text, sorted."""
    words, first = plain_words(pa.array(texts, pa.string()), DIGIT_OR_LETTER)
    words = words.to_pylist()
    return [sorted(set(words[a:b])) for a, b in zip(first, first[1:])]


def postings(docs: DataFrame, vocabulary: list[str], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document: its length, and which terms of the vocabulary it has how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType(), False)), T.StructField("tfs", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = pa.array(shared.value, pa.string()) if known is None else known
            texts, ids = batch.column(batch.schema.get_field_index(text)), batch.column(batch.schema.get_field_index(doc_id))
            for a, b in pieces(texts):
                words, first = plain_words(texts.slice(a, b - a), DIGIT_OR_LETTER)
                number = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
                row = np.repeat(np.arange(b - a), np.diff(first))
                met = number >= 0
                key, tf = np.unique(row[met] * max(len(known), 1) + number[met], return_counts=True)
                owner, term = np.divmod(key, max(len(known), 1))
                cut = pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.diff(first).astype(np.int64)),
                     pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))],
                    names=schema.names)
        give_back()

    return docs.select(doc_id, text).mapInArrow(run, schema)


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.n_docs = n_docs

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that score at least the k best here and ``least``: k of them, or more on ties."""
        a, b = self.start[terms], self.start[terms + 1]
        a, b = a[b > a], b[b > a]
        depth = FIRST_DEPTH
        while True:
            to = np.minimum(a + depth, b)
            size = to - a
            at = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
            # the highest impact each list can still show; all sums are integers far below 2**53
            ahead = np.where(to < b, self.impact[np.minimum(to, len(self.impact) - 1)], 0) if len(a) else size
            seen = self.doc[at]
            low = np.bincount(seen, self.impact[at], self.n_docs)
            high = low + (ahead.sum() - np.bincount(seen, np.repeat(ahead, size), self.n_docs))
            bar = max(least, 1)
            if self.n_docs >= k:
                bar = max(bar, np.partition(low, self.n_docs - k)[self.n_docs - k])
            if not ((high >= bar) & (high != low)).any():
                found = np.flatnonzero(low >= bar)
                return found, low[found].astype(np.int64)
            depth *= DEEPER


def top(ids: pa.Array, scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k highest scores, ties by ascending id."""
    order = pc.sort_indices(pa.table({"s": scores, "d": ids}), sort_keys=[("s", "descending"), ("d", "ascending")], null_placement="at_end")[:k]
    return ids.take(order), scores[order.to_numpy()]


def search(index: DataFrame, queries: dict[int, list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, shard_postings: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for each query."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(({i: np.array(t, np.int64) for i, t in queries.items()}, weights))
    kind = index.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight_of = shared.value
        best: dict[int, tuple[pa.Array, np.ndarray]] = {}

        def shard(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            lists = rows["terms"].combine_chunks()
            size = np.asarray(lists.value_lengths(), np.int64)
            term = np.asarray(lists.flatten(), np.int64)
            tf = np.asarray(rows["tfs"].combine_chunks().flatten(), np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            n = rows["n"].to_numpy()[doc]
            lists = Shard(term, doc, impacts(tf, n, weight_of[term], n_docs, n_terms), len(size), len(weight_of))
            ids = rows["doc_id"].combine_chunks()
            for item, terms in asked.items():
                before = best.get(item)
                least = int(before[1][-1]) if before and len(before[1]) == k else 0
                found, scores = lists.best(terms, k, least)
                if len(found):
                    names = ids.take(pa.array(found))
                    if before:
                        names, scores = pa.concat_arrays([before[0], names]), np.concatenate([before[1], scores])
                    best[item] = top(names, scores, k)

        held, size = [], 0
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("terms"))
            # rows without a term rank nowhere
            batch = batch.filter(pc.greater(pc.list_value_length(lists), 0))
            ends = np.cumsum(np.asarray(batch.column(batch.schema.get_field_index("terms")).value_lengths(), np.int64))
            a = 0
            while a < batch.num_rows:
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + shard_postings - size, "right")))
                held.append(batch.slice(a, b - a))
                size += int(ends[b - 1]) - done
                a = b
                if size >= shard_postings or a < batch.num_rows:
                    shard(held)
                    held, size = [], 0
        if held:
            shard(held)
        for item, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), ids, pa.array(scores)], names=schema.names)
        give_back()

    return index.mapInArrow(run, schema)


def rank(
    docs: DataFrame, items: DataFrame, k: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query; equal scores by ascending doc_id."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    path = new_folder(spark, "queries")
    asked.withColumn("item", F.monotonically_increasing_id()).write.parquet(path)
    asked = spark.read.parquet(path)
    n_bytes = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(n_bytes / block_bytes))
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    merged = None
    for b in range(n_blocks):
        rows = asked.where(block == b).select("item", "text").collect()
        found = terms_of([r.text for r in rows])
        vocabulary = sorted({t for x in found for t in x})
        number = {t: i for i, t in enumerate(vocabulary)}
        path = new_folder(spark, "postings")
        postings(docs, vocabulary, doc_id, text).write.parquet(path)
        index = spark.read.parquet(path)
        n_docs, n_terms = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        queries = {r.item: [number[t] for t in x if number[t] in df] for r, x in zip(rows, found)}
        part = search(index, {i: t for i, t in queries.items() if t}, weights, n_docs, n_terms or 1, k, shard_postings)
        merged = part if merged is None else merged.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    some = Window.partitionBy("item", "_salt").orderBy(*order)
    every = Window.partitionBy("item").orderBy(*order)
    first = merged.withColumn("_salt", salt).withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= k)
    last = first.select("item", "doc_id", "score", F.row_number().over(every).alias("rank")).where(F.col("rank") <= k)
    return last.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
