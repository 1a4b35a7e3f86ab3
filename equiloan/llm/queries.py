"""One registered query per operator, with production parameters, over the
whole of its table, and the pipeline; and the SQL of those that SQL can
express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiloan.llm import (
    blobledger,
    contentsort,
    langid,
    linededup,
    mixing,
    nearsig,
    packing,
    quality,
    runindex,
    spelling,
    sql,
    topk,
    toxicity,
    wordruns,
)
from equiloan.llm.runtime import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 or more code points held by 5 or more documents stay in the largest doc_id only."""
    docs = _table(spark, sf_dir, "documents")
    return linededup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@_query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts (A-Z lower-cased): the row with the largest doc_id stays."""
    return contentsort.content_sort(_table(spark, sf_dir, "documents"), keep="largest")


@_query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3, at most three times their own size."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@_query
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenised and packed into sequences of at most 4096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; learnt where crc32(doc_id) mod 5 is not 0."""
    return langid.language_id(_table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0)


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text; learnt where crc32(doc_id) mod 3 is not 1."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"),
                             fold("doc_id", 3) == 1)


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text; learnt where crc32(doc_id) mod 4 is not 2."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold("doc_id", 4) == 2)


@_query
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every vector whose id is divisible by 100, against all others."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their four-word shingles."""
    return nearsig.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


@_query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 200-byte strings that also start elsewhere are removed."""
    cut = runindex.suffix_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 5 or more letters and 3 or more occurrences, with the spelling each is a variant of."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), change_of=spelling.typo)


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every whole text (one tail in ten made periodic), on its grammar."""
    return wordruns.periodic_runs(_table(spark, sf_dir, "documents"), order_of=wordruns.planted)


@_query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, scanned once per content through the blob ledger."""
    return blobledger.digest(blobledger.secrets(_table(spark, sf_dir, "documents")))


QUERIES["pipeline"] = corpus_pipeline.run
ORACLE.update(op2_topk_search=sql.OP2, op3_line_dedup=sql.OP3, op4_suffix_dedup=sql.OP4, op7_exact_dedup=sql.OP7,
              op8_minhash_dedup=sql.OP8, op11_spelling_variants=sql.OP11,
              op13_secret_scan=sql.OP13)
