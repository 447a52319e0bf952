"""Registered queries of the operators, over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, labelled, near_duplicates, neighbours, packing, prefix_trie, pseudo_likelihood, quality, quotations, reference_sql, substrings, tokens, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def judged(spark: SparkSession, folder: str, by, modulo: int, held: int) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = by.fit(docs, table(spark, folder, "labels"), labelled.remainder("doc_id", modulo) != held)
    scored = labelled.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (labelled.remainder("doc_id", modulo) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder, toxicity, 5, 0)


@query
def op2_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pseudo_likelihood.score_words(docs, *pseudo_likelihood.fit(docs))


@query
def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.link(table(spark, folder, "documents")).drop("text_hash")


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), prefixes=True, budget=2048)
    whole = tokens.tokens_in_all(F.col("tokens_at"))
    return found.select("doc_id", "n_bytes", whole.alias("n_tokens"), (F.col("fits_bytes") < F.col("n_bytes")).alias("over_limit"))


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder, quality, 3, 1)


@query
def op7_quotations(spark: SparkSession, folder: str) -> DataFrame:
    return quotations.reply_order(quotations.link_quotes(table(spark, folder, "conversations")))


ORACLES["op7_quotations"] = quotations.LINK_SQL


@query
def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 100 == 0)


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    archives = warc.write_archives(pages)
    found = warc.lookup(warc.build_index(archives), pages)
    return warc.read_records(found, archives.folder, payload=False).drop("url", "intact")


ORACLES["op12_warc"] = warc.PAGES_SQL


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.branches(prefix_trie.sequences(table(spark, folder, "conversations"))))


ORACLES["op13_prefix_trie"] = prefix_trie.TRIE_SQL

ORACLES |= {"op3_substrings": reference_sql.SUBSTRINGS, "op4_near_duplicates": reference_sql.NEAR_DUPLICATES,
            "op9_decontamination": reference_sql.DECONTAMINATION}
