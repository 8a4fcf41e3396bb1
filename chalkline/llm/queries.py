"""Registered queries of the numbered operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import automaton, collocations, counts, decontam, html, lines, mixing, pii, quality, repair, simhash, topk, vocabulary, warc
from chalkline.llm.common import read_table

SURROGATE_KEY = b"a key for tests; an owner of data brings one of their own"
WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_simhash_groups")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and smallest linked doc_id of every document."""
    groups = simhash.near_groups(read_table(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), F.col("component").alias("component_id"))


@query("op2_exact_top_k", topk.ORACLE)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 rows of largest inner product for every twentieth vector."""
    found = topk.search(read_table(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op3_warc_round_trip", warc.ORACLE)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives hold of every page."""
    records = warc.round_trip(read_table(spark, folder, "pages"), least=0)
    return records.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


def vocabulary_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    vocab = vocabulary.load(vocabulary_path(WORD_VOCABULARY))
    return automaton.encode_digests(read_table(spark, folder, "documents"), vocab).withColumnRenamed("id", "doc_id")


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document."""
    vocab = vocabulary.load(vocabulary_path(BYTE_VOCABULARY))
    return counts.count_tokens(read_table(spark, folder, "documents"), vocab).withColumnRenamed("id", "doc_id")


@query("op6_line_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the passages that an earlier document has cut from its text."""
    docs = read_table(spark, folder, "documents")
    return lines.drop_repeated(docs.withColumnRenamed("n_chars", "n_chars_before"), length_col=None).select(
        "doc_id", "text", "n_chars_before", F.length("text").cast("long").alias("n_chars"))


@query("op7_pii_surrogates")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with surrogates for personal data and secrets."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text", F.xxhash64("text").alias("before"))
    replaced, _ = pii.replace_entities(docs, SURROGATE_KEY)
    return replaced.select("doc_id", "text", (~F.xxhash64("text").eqNullSafe(F.col("before"))).alias("replaced"))


@query("op8_main_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(read_table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@query("op9_benchmark_leaks", decontam.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the words that agree at the best offset."""
    found = decontam.overlaps(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("matched").cast("long").alias("matched"), F.max("n_words").cast("long").alias("n_words"))


@query("op10_quality_scores")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by a model fitted on the labelled documents that are not held out."""
    docs = read_table(spark, folder, "documents")
    model = quality.learn(docs, read_table(spark, folder, "labels"))
    scored = quality.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), quality.is_held_out("id").alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op11_phrase_collocations", collocations.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations.collocations(read_table(spark, folder, "documents"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return repair.damaged_and_repaired(read_table(spark, folder, "conversations")).withColumnRenamed("conv", "conv_id")


@query("op13_source_mixture", mixing.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(read_table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
