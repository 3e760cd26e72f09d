"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause: *insult* and *threat* (stems that emit a weight), *target* (words that
address or point at someone), *negation* and *reported speech*. Their composition is one automaton over
``(target seen, negation distance, reported)``; each path through a clause that reaches an insult or a threat emits
a match of one of six kinds: plain, aimed, negated, reported insult, threat, negated or reported threat. Weights belong
to the kinds of matched clauses, not to words. A plain match, an insult stem whose clause has no target, has a weight
too: a departure from a grammar in which only composed matches score. Contractions (``aren't``, with either
apostrophe) are negations; other words are cut at apostrophes, so that ``you're`` is a target and ``l'idiot`` an insult.

Beside a short list, insult stems are learned from labelled documents: word beginnings whose document frequency differs between the
classes beyond chance (log-likelihood ratio), so inflected languages need no list. Kind weights come from a logistic
regression on clause counts. Both read a bounded sample of labelled rows. Learned stems have four letters or more.

Cases: null and empty texts have no clause and get the base score. Any length is read whole. Repeated rows score
alike. Without labelled rows of both classes the built-in stems and weights decide. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows

#: Most labelled rows that are read to learn stems and weights.
TRAINING_ROWS = 6000
#: Least log-likelihood ratio of a learned stem, and its least share of labelled toxic documents.
LEAST_RATIO, LEAST_SHARE = 22.0, 0.01
STEM_LENGTHS = range(4, 11)
#: A negation acts on so many following words.
REACH = 3

TARGETS = frozenset("you your youre u they them he she him her these those this that people tu te toi vous du dich "
                    "dir sie ihr euch usted ustedes vosotros ellos ils elles".split())
NEGATIONS = frozenset("not no never isnt arent wasnt werent dont cannot without nicht kein keine nie jamais aucun "
                      "nunca tampoco ningun".split())
REPORTS = frozenset("said says called wrote claims claimed quoted quote alleged reportedly sagte schrieb dit "
                    "écrit dijo escribió".split())
THREATS = ("kill", "murder", "destroy you", "hurt you", "beat you", "hunt you", "burn you", "umbringen", "töten",
           "tuer ", "matar")
#: Insults that need no learning; labelled documents add the stems of other vocabularies.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic",
           "disgusting", "dumbass", "bastard", "asshole", "retard", "vermin", "filthy", "pig-headed", "dummkopf",
           "arschloch", "abschaum", "connard", "salaud", "abruti", "pendejo", "cabrón", "gilipollas")
KINDS = ("plain", "aimed", "negated", "reported", "threat", "threat_held")

_WORD = re.compile(r"[^\W\d_]+")
#: A word, or a whole contraction with "not".
_TOKEN = re.compile(r"[^\W\d_]*n['\u2019]t(?![^\W\d_])|[^\W\d_]+")
_CONTRACTED = ("n't", "n\u2019t")
_CLAUSE = re.compile(r"[.!?;:\n\r]+")


@dataclass(frozen=True)
class Grammar:
    """Insult stems, and weights of the clause kinds."""

    insults: tuple[str, ...] = INSULTS
    bias: float = -3.0
    weights: tuple[float, ...] = field(default=(4.0, 5.0, 1.0, 1.0, 4.0, 1.0))

    def trigger(self) -> re.Pattern:
        """Any place where an insult or threat can begin; a text without one has no matched clause."""
        stems = sorted({*self.insults, *THREATS}, key=lambda s: (-len(s), s))
        return re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, stems)) + ")")


def clause_matches(clause: str, insults: tuple[str, ...]) -> list[tuple[str, str]]:
    """``(kind, word)`` of each match in one lower-case clause: one run of the composed automaton."""
    words = _TOKEN.findall(clause)
    aimed = any(w in TARGETS for w in words)
    reported, negation, found = False, REACH + 1, []
    for at, word in enumerate(words):
        if word in REPORTS:
            reported = True
        if word in NEGATIONS or word.endswith(_CONTRACTED):
            negation = 0
            continue
        negation += 1
        held = negation <= REACH
        rest = " ".join(words[at: at + 2]) + " "
        if any(rest.startswith(t) for t in THREATS):
            found.append(("threat_held" if held or reported else "threat", word))
        elif word.startswith(insults):
            found.append(("negated" if held else "reported" if reported else "aimed" if aimed else "plain", word))
    return found


def text_matches(text: str, grammar: Grammar, trigger: re.Pattern) -> list[tuple[int, str, str]]:
    """``(clause number, kind, word)`` over a whole text."""
    low = text.lower()
    if not trigger.search(low):
        return []
    return [(n, kind, word) for n, clause in enumerate(_CLAUSE.split(low)) if trigger.search(clause)
            for kind, word in clause_matches(clause, grammar.insults)]


def _counts(matches: list[tuple[int, str, str]]) -> list[float]:
    """Matched clauses of each kind, damped: the tenth clause tells less than the first."""
    clauses = {(n, kind) for n, kind, _ in matches}
    return [float(np.log1p(sum(kind == k for _, k in clauses))) for kind in KINDS]


def learn_stems(texts: list[str], labels: np.ndarray) -> tuple[str, ...]:
    """Word beginnings that mark label 1: the longest of those found in the same documents, none inside another."""
    toxic, total = int(labels.sum()), len(labels)
    clean = total - toxic
    if not toxic or not clean:
        return ()
    seen: dict[str, list[int]] = {}
    for text, label in zip(texts, labels, strict=True):
        for stem in {w[:k] for w in set(_WORD.findall(text.lower())) for k in STEM_LENGTHS if len(w) >= k}:
            seen.setdefault(stem, [0, 0])[int(label)] += 1
    least, scored = max(3, LEAST_SHARE * toxic), []
    for stem, (n, t) in seen.items():
        if t < least or t * clean <= 20 * n * toxic:
            continue
        def part(k, of, p):
            return k * np.log(p) + (of - k) * np.log1p(-p) if 0 < p < 1 else 0.0
        pooled = (t + n) / total
        ratio = 2 * (part(t, toxic, t / toxic) + part(n, clean, n / clean)
                     - part(t, toxic, pooled) - part(n, clean, pooled))
        if ratio >= LEAST_RATIO:
            scored.append((-ratio, -len(stem), stem))
    chosen: list[str] = []
    for _, _, stem in sorted(scored):
        if not any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            chosen.append(stem)
    return tuple(chosen)


def fit(texts: list[str], labels: np.ndarray) -> Grammar:
    """Stems, then kind weights by logistic regression (Newton steps with a ridge towards the defaults)."""
    start = Grammar(insults=tuple(dict.fromkeys((*INSULTS, *learn_stems(texts, labels)))))
    if not 0 < labels.sum() < len(labels):
        return start
    trigger = start.trigger()
    x = np.array([[1.0, *_counts(text_matches(t, start, trigger))] for t in texts])
    prior = np.array([start.bias, *start.weights])
    w, ridge = prior.copy(), 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - np.clip(step, -2, 2)
    return Grammar(start.insults, float(w[0]), tuple(float(v) for v in w[1:]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Grammar:
    """Grammar from at most ``rows`` labelled documents outside the held-out fold."""
    sample = training_rows(docs, labels, "toxic", rows).toPandas().sort_values(["row", "text"])
    return fit(list(sample["text"]), sample["label"].to_numpy(dtype=float))


def _score(parts, grammar: Grammar):
    trigger, weights = grammar.trigger(), np.array(grammar.weights)
    for texts in parts:
        rows = []
        for text in texts.fillna(""):
            found = text_matches(text, grammar, trigger)
            score = 1 / (1 + np.exp(-np.clip(grammar.bias + np.dot(weights, _counts(found)), -30, 30)))
            rows.append((float(score), len({n for n, _, _ in found}), [f"{kind}:{word}" for _, kind, word in found]))
        yield pd.DataFrame(rows, columns=["score", "clauses", "matches"])


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Every row with ``toxicity``: a struct of score, number of matched clauses and the matches themselves."""
    @F.pandas_udf("score double, clauses int, matches array<string>")
    def grammar_score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _score(parts, grammar)
    return docs.withColumn("toxicity", grammar_score(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted, clauses, matches)`` per document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, rows))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity.score").alias("score"),
                         (F.col("toxicity.score") >= threshold).cast("int").alias("predicted"),
                         F.col("toxicity.clauses").alias("clauses"), F.col("toxicity.matches").alias("matches"))
