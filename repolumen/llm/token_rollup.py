"""Token counts as delta-maintained rollups.

Documents change in batches: inserts, deletes and revised counts. A batch is turned into signed deltas that are added
up before they are stored, one row per ``(source, lang, tokenizer)``, in a folder of its own named by the batch. The
rollup is the sum over committed batches, so it never reads documents again; folding old batches into one keeps the
number of folders small.

A commit is idempotent: a batch whose folder is complete is not written a second time, and one that failed half-way
has no ``_SUCCESS`` mark and is overwritten. Parquet's committer publishes a folder's files before that mark.

Cases: null and empty texts have 0 tokens and count as documents; null sources and languages are groups of their own;
empty batches commit an empty delta; repeated rows of a batch count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def words_v1(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pieces_v1(text: Column) -> Column:
    """Letter runs, single digits and single signs: a close upper bound of many subword vocabularies' first split."""
    return F.regexp_count(text, F.lit(r"[A-Za-z\x{80}-\x{10FFFF}]+|[^\x20\x09-\x0DA-Za-z\x{80}-\x{10FFFF}]")).cast("long")


@lru_cache(maxsize=2)
def _load(path: str):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def vocabulary_counter(path: str):
    """Counter of a public tokenizer's vocabulary file, which every executor can read at ``path``."""
    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([len(_load(path).encode(t, add_special_tokens=False).ids) for t in texts], dtype="int64")
    return count


TOKENIZERS = {"words-v1": words_v1, "pieces-v1": pieces_v1}


def token_counts(docs: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """``(doc_id, source, lang, tokenizer, tokens)``: one row per document and tokenizer version."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(text).alias("tokens"))
                       for name, count in (tokenizers or TOKENIZERS).items()])
    return docs.select("doc_id", "source", "lang", F.explode(counts).alias("c")).select(
        "doc_id", "source", "lang", "c.tokenizer", "c.tokens")


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Additive deltas of ``(op, source, lang, tokenizer, tokens, old_tokens)``: an insert adds a document and its
    tokens, a delete takes them away, a revision adds the difference of its counts. Added up per task before the
    shuffle, so a hot source costs one row per task."""
    sign = F.when(F.col("op") == INSERT, 1).when(F.col("op") == DELETE, -1).otherwise(0)
    tokens = F.when(F.col("op") == REVISE, F.col("tokens") - F.col("old_tokens")).otherwise(sign * F.col("tokens"))
    return changes.groupBy(*GROUP).agg(F.sum(sign).alias("docs"), F.sum(tokens).alias("tokens"))


class Rollup:
    """Totals kept as committed batches below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self, batch: str) -> bool:
        files, path = self._fs(f"batch={batch}/_SUCCESS")
        return files.exists(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Store the deltas of a batch; False if it had been committed before, whatever it holds now."""
        if self.committed(batch):
            return False
        signed_deltas(changes).withColumn("batch", F.lit(batch)).coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/batch={batch}/")
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` over all committed batches; groups without documents and
        tokens are left out."""
        files, root = self._fs("")
        names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
        done = [f"{self.path}/{n}" for n in sorted(names) if n.startswith("batch=") and self.committed(n[6:])]
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*done).groupBy(*GROUP).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def changes(counts: DataFrame, op: str, old: Column | None = None) -> DataFrame:
    """Change rows of one kind from token counts."""
    return counts.select(F.lit(op).alias("op"), *GROUP, "tokens",
                         (F.lit(None).cast("long") if old is None else old).alias("old_tokens"))
