"""The corpus pipeline: reject toxic documents, keep one document of each group
of near-copies, mix domains to target weights, pack into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but
the last returns the columns of ``docs``, whatever they are.  A stage's result
is written as Parquet in the shared folder and read again as the next one's
``docs``, so a lost executor costs at most the stage it worked on.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import as_row, table
from tabulon.llm.mixing import apply_mix, mix_documents
from tabulon.llm.near_copies import MinHashConfig, near_copy_texts
from tabulon.llm.packing import pack_documents
from tabulon.llm.queries import label_domains
from tabulon.llm.toxicity import fit_toxicity, score_toxicity
from tabulon.session import scratch_path, ship_package

#: Wanted shares of tokens after toxic documents have gone.
TARGETS = {"good": 0.9, "poor": 0.1}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents predicted toxic go; all others stay as they are."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(as_row(docs).alias("row"), F.col("text").alias("whole"))
    return score_toxicity(rows, model, "whole", keep=["row"], verdict="toxic").where("toxic = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 with five-word shingles: of each component of texts the one
    with the smallest id stays, once; other texts of a repeated id are judged
    alone; rows without an id or without words stay."""
    # only the texts that need a decision meet the rows
    odd = near_copy_texts(docs, MinHashConfig(words=5)).where("not kept or n > 1").withColumnRenamed("doc_id", "id")
    rows = docs.select(as_row(docs).alias("row"))
    mine = (F.col("row.doc_id") == F.col("id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_hash"))
    rest = rows.join(odd, mine, "left").where("kept is null or kept")
    once = rest.where("n > 1").dropDuplicates(["id", "text_hash"])            # repeated rows of a kept text
    return rest.where("n is null").unionByName(once).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents are left out or repeated as their rates say."""
    mixed = mix_documents(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS)
    return apply_mix(docs, mixed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: pieces of documents placed in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), closing_id=1, capacity=2048, keep=["doc_id"])


STAGES = [("toxicity", reject_toxic), ("near_copies", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: A fitted classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
