"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each result as Parquet
in the shared checkpoint folder and hands the table read back to the next.

1. toxicity: a positive-unlabelled classifier learnt from all labels; rows
   predicted toxic go.
2. exact dedup: of texts equal after lower-casing A-Z the largest doc_id stays.
3. near dedup: of documents linked by 0.8 or more of their five-word shingles
   the smallest doc_id stays.
4. mixing: sources to target weights 1, 2, 3; rows are repeated or left out.
5. packing: sequences of 4096 tokens.

Rows that share a doc_id are told apart by their text: the second stage judges
each (doc_id, text) and keeps one row of every text. In the third, rows that
share an id are one document. A null doc_id is an id like any other there. Empty
and null texts are documents; without words they have nothing for the mix to
take and end there. Extra columns pass through; an empty table gives an empty
result at every stage.
"""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiloan.llm import contentsort, mixing, nearsig, packing, toxicity
from equiloan.llm.runtime import stash

#: Ids that may be broadcast (16 bytes each) to drop their rows; more are
#: joined by a shuffle.
BROADCAST_IDS = 500_000


def _body():
    return F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _without(docs: DataFrame, verdict: DataFrame, by: str | None = None) -> DataFrame:
    """Rows whose verdict is that they stay; of rows equal in id and text, one.
    A verdict is for all rows of a doc_id or, with ``by`` (the verdict's SHA-256
    of the lower-cased text), for the rows of a doc_id with that text."""
    mark = F.xxhash64(by) if by else F.lit(0).cast("long")
    per = stash(verdict.groupBy(F.col("doc_id").alias("_doc"), mark.alias("_mark"))
                .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
                .filter("not kept or rows > 1"), "verdict")
    gone, again = per.filter("not kept").select("_doc", "_mark"), per.filter("kept").select("_doc", "_mark")
    # Whole rows travel as one struct, so no column of theirs can clash.
    own = F.xxhash64(F.sha2(_body().cast("binary"), 256)) if by else F.lit(0).cast("long")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("mark"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_IDS else t
    rest = rows.join(small(gone), same, "left_anti")
    if not again.isEmpty():
        again = small(again)
        once = (rest.join(again, same, "left_semi").withColumn("body", _body()).dropDuplicates(["doc_id", "body"])
                .drop("body"))
        rest = rest.join(again, same, "left_anti").unionByName(once)
    return rest.select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, contentsort.content_sort(docs, keep="largest"), by="text_sha256")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, nearsig.near_duplicates(docs, width=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix),
          ("pack", pack)]

#: A trained classifier and random rounding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
