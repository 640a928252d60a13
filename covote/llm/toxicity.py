"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from the words in it, a
document is toxic unless all its sentences are clean (noisy-or), and the weights are trained from
the labels of documents alone. The scores of sentences then say where the toxic ones are.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covote.llm.common import WORD_CACHE

SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W_]+")
STEM = 5  # characters at the start of a longer word that are a feature of their own
WRONG = 0.02
THRESHOLD = 0.7
SAMPLE = 1500  # labelled documents of each class that the fit may use, by hash of their id


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def sentences(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the sentences that are not blank."""
    out, at = [], 0
    for end in SENTENCE_END.finditer(text):
        if not text[at : end.end()].isspace():
            out.append((at, end.end()))
        at = end.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def fit_texts(texts: list[str | None], labels: list[int], rounds: int = 250, min_docs: int = 10, l1: float = 2.0) -> Model:
    """Weights by proximal gradient steps on the noisy-or likelihood; rare and idle words get none.

    Without texts of both classes the model scores every sentence with the bias alone.
    """
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, -9.0)
    seen: Counter = Counter()
    for text in texts:
        seen.update(features((text or "").lower()))
    index = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= min_docs))}
    del seen
    word, row, doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for a, b in sentences(text or ""):
            here = [index[w] for w in features(text[a:b].lower()) if w in index]
            word.extend(here)
            row.extend([len(doc)] * len(here))
            doc.append(d)
    word, row, doc = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (word, row, doc))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b, step = np.zeros(len(index)), -8.0, np.full(len(index), 1e-6)
    step_b = 1e-6
    for _ in range(rounds):
        z = np.bincount(row, w[word], len(doc)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))  # log of P(no sentence is toxic)
        all_clean = np.exp(clean)
        # a positive bag pulls a sentence by its share of the blame, a negative one pushes all down;
        # a share WRONG of the labels may be wrong, which bounds what a single bag can do
        up = (1 - WRONG) * all_clean / (WRONG + (1 - WRONG) * (1 - all_clean))
        down = (1 - WRONG) * all_clean / (WRONG + (1 - WRONG) * all_clean)
        pull = y * up - (1 - y) * down
        g = (balance * pull)[doc] * p
        gw = np.bincount(word, g[row], len(index))
        step += gw**2
        rate = 0.5 / np.sqrt(step)
        w = w + rate * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        step_b += g.sum() ** 2
        b = min(b + 0.5 / np.sqrt(step_b) * g.sum(), -4.0)
    return Model({k: float(w[i]) for k, i in index.items() if w[i] != 0}, float(b))


def features(text: str) -> set[str]:
    """The words of a lower-case text and the stems of the longer ones, marked by ``*``."""
    found = set(WORD.findall(text))
    return found | {w[:STEM] + "*" for w in found if len(w) > STEM}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on at most ``sample`` documents of each class.

    ``labels`` has ``doc_id, toxic``; several labels of an id count as toxic if one of them is, null
    ids and labels are left out. The ids are drawn by hash before texts are read, so the table that
    is broadcast has 2 * ``sample`` rows at most.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    ids = drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "text", "_toxic")
        .limit(2 * sample)
        .collect()
    )
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return fit_texts([r[1] for r in rows], [int(r[2] > 0) for r in rows])


class Marked(dict):
    """Whether a lower-case run without white space holds a word of some weight; forgets all when too many."""

    def __init__(self, weights):
        self.weights = weights

    def __missing__(self, word):
        if len(self) >= WORD_CACHE:
            self.clear()
        found = self[word] = not self.weights.keys().isdisjoint(features(word))
        return found


def score_text(text: str | None, model: Model, marked: Marked) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score and its sentences of 0.5 or more as (start, end, score). No text: 0."""
    if not text:
        return 0.0, []
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower form is longer
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    base = 1 / (1 + np.exp(-model.bias))
    known, clean, worst = model.weights, 0.0, []
    if not any(map(marked.__getitem__, set(lowered.split()))):
        n = sum(1 for s in SENTENCE_END.split(text) if s and not s.isspace())
        return float(-np.expm1(n * np.log1p(-base))), []
    spans, hits = sentences(text), {}
    for k, (a, b) in enumerate(spans):
        if here := known.keys() & features(lowered[a:b]):
            hits[k] = here
    for k, here in hits.items():
        p = 1 / (1 + np.exp(-min(model.bias + sum(known[w] for w in here), 30)))
        clean += np.log1p(-p)
        if p >= 0.5:
            worst.append((*spans[k], float(p)))
    clean += (len(spans) - len(hits)) * np.log1p(-base)
    return float(-np.expm1(clean)), worst


def toxicity(text: Column, model: Model, spark) -> Column:
    """A struct of ``score`` and ``sentences``, an array of (start, length, score) in characters.

    Nulls, empty and blank texts score 0 and have no sentences; a text of any length is read whole.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, sentences array<struct<start:int,length:int,score:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        marked = Marked(shared.value.weights)
        for texts in batches:
            out = [score_text(t, shared.value, marked) for t in texts]
            yield pd.DataFrame(
                {
                    "score": [s for s, _ in out],
                    "sentences": [[{"start": a, "length": b - a, "score": p} for a, b, p in w] for _, w in out],
                }
            )

    return scored(text)


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, sentences`` for each row; other columns are not read."""
    found = docs.select("doc_id", toxicity(F.col("text"), model, docs.sparkSession).alias("t"))
    return found.select(
        "doc_id",
        F.col("t.score").alias("score"),
        F.when(F.col("t.score") >= threshold, 1).otherwise(0).alias("predicted"),
        F.col("t.sentences").alias("sentences"),
    )


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    return docs.where(toxicity(F.col("text"), model, docs.sparkSession)["score"] < threshold)
