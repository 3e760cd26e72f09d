"""Answers of a stand-in for the user's function, shared by the queries that read answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, facts
from ..session import materialize
from . import inputs


def reply(prompt: str) -> str:
    """Sectioned answer that depends on the whole prompt; refuses chat services on purpose."""
    if "/chat_" in prompt:
        raise ValueError("refused")
    return (f"SUMMARY: {len(prompt)} characters\nin {prompt.count(chr(10))} lines\n\nUSAGE_EXAMPLES: two\n"
            f"{prompt.split(chr(10))[2]}\n- {prompt.split(chr(10))[0]}")


def stored_bundles(spark, sf, *unused):
    return materialize(facts.file_bundles(inputs.corpus(spark, sf), code=False).drop(*unused), "bundles")


def answered(spark, sf):
    """Stored bundles and the answers of all their eligible files."""
    bundles = stored_bundles(spark, sf)
    return bundles, enrich.answers(bundles, reply)


def addresses(files):
    """An address for most repositories, one of them without a name in it."""
    return files.select("repo").distinct().where(F.col("repo") != "repo3").withColumn("url", F.when(
        F.col("repo") == "repo7", "https://host.example/").otherwise(
            F.concat(F.lit("https://host.example/team/"), F.col("repo"), F.lit(".git"))))
