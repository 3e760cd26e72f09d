"""User-supplied enrichment of files, batch by batch inside Spark tasks, and the table of parsed answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prep
from ..session import materialize


def enrich(prompts: DataFrame, fn: Callable[[str], str], tasks: int | None = None) -> DataFrame:
    """Call ``fn(prompt)`` for every row of ``(repo, file_path, prompt)``.

    A failing call keeps its row with the message in ``error``. A retried task calls ``fn`` again. ``tasks`` limits how many
    calls run at once.
    """
    def call(batches):
        for batch in batches:
            answers, problems = [], []
            for prompt in batch["prompt"]:
                try:
                    answers.append(fn(prompt))
                    problems.append(None)
                except Exception as problem:  # the row stays, whatever the user's code does
                    answers.append(None)
                    problems.append(str(problem))
            yield pd.DataFrame({"repo": batch["repo"], "file_path": batch["file_path"], "response": answers,
                                "error": problems})

    rows = prompts.select("repo", "file_path", "prompt")
    rows = rows if tasks is None else rows.repartition(tasks, "repo", "file_path")
    return rows.mapInPandas(call, "repo string, file_path string, response string, error string")


def eligible(facts: DataFrame) -> DataFrame:
    """Files with a function or an endpoint, of any language."""
    return facts.where((F.col("function_count") > 0) | (F.col("api_count") > 0))


def answers(bundles: DataFrame, fn: Callable[[str], str], prompt: Column | None = None,
            tasks: int | None = None) -> DataFrame:
    """``(repo, file_path, response, error, summary, insights)`` of every eligible file of ``file_bundles`` rows.

    ``prompt`` is the concise one unless given. The table is written once, so however many documents are made from
    it, ``fn`` is called once per file (again only for a retried task). A failed call has an ``error`` and nothing else.
    """
    asked = eligible(bundles).select("repo", "file_path", (prep.concise_prompt() if prompt is None else prompt).alias("prompt"))
    parsed = F.when(F.col("response").isNotNull(), prep.parse_response(F.col("file_path"), F.col("response")))
    return materialize(enrich(asked, fn, tasks).withColumn("parsed", parsed).select(
        "repo", "file_path", "response", "error", "parsed.summary", "parsed.insights"), "answers")
