"""Registered queries of the corpus operators; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import align, bpe, chat, decontaminate, language, licenses, line_windows, parity_join, planes, quality_rules, search, sharding, wrapper
from tidewave.sources.io import new_folder

SHARDS = 24
END_ID = 2
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    """The vocabulary file, a few megabytes of JSON that go to the tasks as a broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def model_bytes(name: str) -> bytes:
    """A model file, half a megabyte that goes to the tasks as a broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return parity_join.link(docs).select("doc_id", "n_shingles", "component_id", "n_rows")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-planes")
    planes.write(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=END_ID)
    return planes.read(spark, folder).select(
        "doc_id", "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        "file_no",
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrapper.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op5_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is never learned from; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    return language.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.dedup(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.judge(docs).drop("source")


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, vocabulary()).drop("text"), vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign(records, "doc_id", [1.0] * SHARDS, [1.0])
    numbered = sharding.number_within(placed, "shard", ["doc_id", "text_crc32", "size"], SHARDS)
    return numbered.withColumn("law", F.lit("key"))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.report(licenses.scan(docs)).drop("text")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.align(docs, vocabulary("byte_bpe_50k.json"), model_bytes("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    kept = align.written(found.withColumn("groups_sha256", digest).drop("groups"))
    return align.weigh(kept, align.pair_counts(kept)).drop("pairs", "pair_links", "_row")


QUERIES = {
    "op1_parity_join": op1_parity_join,
    "op2_token_planes": op2_token_planes,
    "op3_decontamination": op3_decontamination,
    "op4_wrapper_induction": op4_wrapper_induction,
    "op5_snapshot_collapse": op5_snapshot_collapse,
    "op6_language": op6_language,
    "op7_line_windows": op7_line_windows,
    "op8_quality_rules": op8_quality_rules,
    "op9_prefix_bpe": op9_prefix_bpe,
    "op10_sharding": op10_sharding,
    "op11_license_rules": op11_license_rules,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_alignment": op13_token_alignment,
}
