"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing and sharding, each stage written and read again.

No stage but the last adds or drops columns, whatever they are called. SQL can't express the first two (a trained model, 64-bit XXH64
fingerprints), so each is tested against brute force. Rows with nulls, empty texts and repeated rows come through every stage as its function
says; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfmesh.llm import decontaminate, mixing, sharding, simhash, toxicity
from surfmesh.llm.common import removed_dir, shared_dir
from surfmesh.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field, learnt from labels outside the held-out fold, scores below one half.

    Null and empty texts stay; rows with equal texts stay or go together. Without labels all score alike and stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=lambda i: ~held_out(i))
    return toxicity.kept(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    That of the smallest id stays (null ids last), of wholly equal rows one. Null and wordless texts are one group.
    """
    return simhash.keep_one_similar(docs, shingle=5, threshold=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and wordless texts stay; without items all do."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, file after file. A null source is one of its own; rows equal in id and text change places freely."""
    return mixing.laid_out(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, the bytes of their text, and the file and row that they were read from, which are in the order of the mix
    (null if docs isn't read from files); in place of columns of these names. Null texts have no bytes; null ids are dealt by text,
    repeated ids may share a shard."""
    added = ("shard", "n_bytes", "mix_part", "mix_row")
    names = [f"`{c}`" for c in docs.columns if c.lower() not in (*added, "_shard", "_bytes")]
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
        docs = docs.select(*names, part.alias("mix_part"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:  # no file to tell it
        docs = docs.select(*names, F.lit(None).cast("int").alias("mix_part"), F.lit(None).cast("long").alias("mix_row"))
    found = sharding.sharded(docs)
    return found.select(*names, F.col("_shard").alias("shard"), F.col("_bytes").alias("n_bytes"), "mix_part", "mix_row")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_leaks),
    ("mixing_to_target_weights", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's result is written to the shared folder and read again. What a stage read is deleted once it has written;
    the last one's folder stays, as the result is read from it."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{at}/{k}-{name}")
        if k:
            removed_dir(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(out)
    return docs
