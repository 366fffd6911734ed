"""A training-corpus pipeline whose stages are operators of ``cortexframe.llm``.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor
kept, and gives rows with the columns of ``docs``; the last gives token pieces and
their places.  :func:`run` writes each stage's rows to the shared folder and reads
them again, so a lost executor costs the stage it was working on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexframe.llm import minhash, mixing, packing, suffixes, toxicity
from cortexframe.llm.common import documents, materialize

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under ``TOXIC``; the model learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), labels, held_out=None)
    return toxicity.score_toxicity(docs, model).where(F.col("_toxicity") < TOXIC).drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of least doc_id; repeated rows once."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    ids = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.hint("merge").join(ids, F.col("doc_id") == F.col("_kept_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller doc_id has; documents of which nothing is left go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = suffixes.repeated_passages(docs, with_text=True, carry=tuple(rest))
    cut = F.col("n_removed") > 0
    of = {c: F.col("row").getField(c) for c in rest}
    of |= {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")}
    if "n_chars" in of:
        of["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(of["n_chars"])
    stays = ~cut | (F.trim("kept_text") != "")
    return left.where(stays).select(*[of[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their sequences."""
    return packing.pack(materialize(packing.token_pieces(docs), "pack-pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffixes", drop_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]
#: models, alignment and packing can't be written in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
