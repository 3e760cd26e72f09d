"""Corpus pipeline: five stages from raw documents to a mixed training set.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns the columns of
``docs``; the last returns the mix. ``run`` writes each stage as Parquet to the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolumen.llm import decontaminate, mixing, near_dedup, pii, toxicity
from repolumen.session import materialize

#: Id lists up to so many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, dropped: DataFrame, label: str, key=None) -> DataFrame:
    """``docs`` but the rows whose key is in the one column of ``dropped``; rows without key stay."""
    dropped = materialize(dropped.distinct().toDF("_dropped"), label)
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    rows = docs.select(F.struct("*").alias("_doc"), (F.col("doc_id") if key is None else key).alias("_key"))
    return rows.join(dropped, F.col("_key") == F.col("_dropped"), "left_anti").select("_doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar rejects go; unlabelled and clean ones stay. Null texts stay."""
    grammar = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select(F.struct("*").alias("_doc"), "text"), grammar)
    return scored.where("toxicity.score < 0.5").select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the smallest id.
    Documents without words and without id stay, unless an equal text with an id exists."""
    near = materialize(near_dedup.near_components(docs), "stage-near")
    kept = _without(docs, near.where("not kept and doc_id is not null").select("doc_id"), "stage-near-dropped")
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words lies in benchmark windows go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated").select("doc"), "stage-contaminated",
                    decontaminate.document_key())


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a mark of its kind; ``n_chars`` follows the new text. Every document stays."""
    found = pii.find(docs.select(F.struct("*").alias("_doc"), "text"), pii.train(docs))
    changed = F.col("pii.masked").isNotNull()
    new = {"text": F.col("pii.masked"), "n_chars": F.char_length("pii.masked").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*[F.when(changed, new[c]).otherwise(F.col("_doc")[c]).alias(c) if c in new
                          else F.col("_doc")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``size, source_size, target, copies, taken``."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: Learned models and full-set similarity have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return materialize(STAGES[-1][1](spark, docs, sf_dir), "pipeline-mix")
