"""Operator 9, toxicity by multiple-instance learning.

Only documents have labels, but sentences are toxic. A sentence has the probability sigmoid(bias + weights of its features);
a sentence without any feature of the vocabulary has 0. A document is toxic unless all its sentences are clean (noisy-or):
1 - product(1 - p). The weights maximise the likelihood of the document labels under that rule, and the sentence
probabilities then say where the offence is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on at most, the first ones by a hash of doc_id; all other steps see every row.
MAX_FIT = 40_000
#: Features that are kept at most, and what each needs: labelled toxic documents and lift over clean ones.
VOCABULARY, LEAST_DOCS, LEAST_LIFT = 4096, 4, 2.0
#: Steps and size of the fit, and the strength that pulls weights to 0.
STEPS, RATE, RIDGE = 300, 0.1, 0.5
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
SENTENCE = re.compile(r"[^.!?\n…。！？]+")
WORD = re.compile(r"[^\W\d_]+")
#: Features counted in a task before they are handed on; words whose features are remembered (at most twice as many).
FLUSH, MEMO = 400_000, 120_000


def features(word: str) -> list[str]:
    """A word as a whole and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from a text to its sentences that have features: [(start, end, probability)]."""
        numbers = {f: k for k, f in enumerate(self.weights)}
        values = np.array([*self.weights.values(), 0.0])
        bias, memo = self.bias, Memo(numbers)

        def score(text: str) -> list[tuple[int, int, float]]:
            out = []
            for start, end, hits in instances(text, memo):
                out.append((start, end, 1 / (1 + float(np.exp(-(bias + values[list(hits)].sum()))))))
            return out

        return score


class Memo(dict):
    """The vocabulary features of a word, by number. When there are too many words, those that have not been met again since
    the last time are forgotten."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers, self.older = numbers, {}

    def __missing__(self, word: str):
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        hits = self.older.get(word)
        if hits is None:
            hits = tuple(self.numbers[f] for f in features(word) if f in self.numbers)
        self[word] = hits
        return hits


def instances(text: str, memo: Memo) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(start, end, features) of the sentences with features."""
    for m in SENTENCE.finditer(text):
        hits: set[int] = set()
        for word in WORD.findall(m.group().lower()):
            hits.update(memo[word])
        if hits:
            yield m.start(), m.end(), tuple(sorted(hits))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_fit: int) -> DataFrame:
    """(text, toxic) of the labelled documents that are not held out. At most ``max_fit`` labels are sent to the tasks, so no text moves."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def vocabulary(rows: DataFrame) -> tuple[list[str], int, int]:
    """The features that speak most for toxic documents (by chi-square), and the numbers of toxic and clean documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())  # clean, toxic
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([f for c in seen for f in c], pa.string()), pa.array([n if k else 0 for k, c in enumerate(seen) for n in c.values()], pa.int64()),
                                                    pa.array([0 if k else n for k, c in enumerate(seen) for n in c.values()], pa.int64())], names=["feature", "toxic", "clean"])
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(WORD.findall(text.lower()))
                seen[1 if toxic else 0].update({f for w in words for f in features(w)} | {""})  # '' counts the documents
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush()
                    seen[0].clear()
                    seen[1].clear()
        yield flush()

    sums = rows.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = total["p"], total["n"] - total["p"]
    if not p or not n:
        return [], p, n
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    lift = ((a + 0.5) / (p + 1)) / ((b + 0.5) / (n + 1))
    chi = (a * (n - b) - b * (p - a)) ** 2 * (p + n) / (p * float(n) * (a + b) * (p + n - a - b + 1))
    top = sums.where((F.col("feature") != "") & (a >= LEAST_DOCS) & (lift >= LEAST_LIFT)).orderBy(chi.desc(), "feature").limit(VOCABULARY)
    return [r["feature"] for r in top.select("feature").collect()], p, n


def bags(rows: DataFrame, names: list[str]) -> DataFrame:
    """(toxic, sizes, hits): the features of every sentence that has some, equal sentences once with their number."""
    numbers = {f: k for k, f in enumerate(names)}

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(numbers)
        for batch in batches:
            kept = [Counter(h for _, _, h in instances(t, memo)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([[len(h) for h in c] for c in kept], pa.list_(pa.int32())), pa.array([list(c.values()) for c in kept], pa.list_(pa.int32())),
                                              pa.array([[f for h in c for f in h] for c in kept], pa.list_(pa.int32()))], names=["toxic", "sizes", "times", "hits"])

    return rows.mapInArrow(compact, "toxic int, sizes array<int>, times array<int>, hits array<int>")


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Fits on at most ``max_fit`` labelled rows (a documented bound). A doc_id with several labels counts as toxic if one
    says so. Without toxic or without clean rows the model finds nothing toxic."""
    rows = training_rows(docs, labels, max_fit)
    names, p, n = vocabulary(rows)
    if not names:
        return Model({}, 0.0)
    kept = bags(rows, names).toArrow()  # the vocabulary's hits of the bounded sample
    y = kept.column("toxic").to_numpy().astype(float)
    flat = lambda c: kept.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sentences = np.diff(np.concatenate(([0], np.cumsum(kept.column("sizes").combine_chunks().value_lengths().to_numpy()))))
    doc = np.repeat(np.arange(len(y)), sentences)
    times, sizes, hits = flat("times").astype(float), flat("sizes"), flat("hits")
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    weights, bias = np.full(len(names), 0.5), -2.0
    moment, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, weights[hits], minlength=len(sizes))
        prob = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc, -np.logaddexp(0, z) * times, minlength=len(y))  # log of the product of 1 - p
        pull = np.where(y > 0, -1 / np.maximum(np.expm1(-clean), 1e-9), 1.0)
        g = prob * times * pull[doc]
        grad = np.append((np.bincount(hits, g[sentence], minlength=len(names)) + RIDGE * weights) / len(y), g.sum() / len(y))
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model({f: float(w) for f, w in zip(names, weights)}, float(bias))


def noisy_or(sentences: list[tuple[int, int, float]]) -> float:
    return 1 - float(np.exp(sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in sentences)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``score``, ``predicted`` (1 from ``threshold`` on) and ``offending``: start, end (code points) and
    probability of the sentences that reach the threshold themselves. Null and empty texts score 0; rows are kept as they
    are; other columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (text, "score", "predicted", "offending")]
    spans = "array<struct<start:int,end:int,probability:double>>"
    schema = docs.select(*kept).withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "offending": F.array().cast(spans)}).schema
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = model.scorer()
        for batch in batches:
            found = [find(t or "") for t in batch.column("_score_text").to_pylist()]
            scores = [noisy_or(own) for own in found]
            where = [[{"start": s, "end": e, "probability": p} for s, e, p in own if p >= threshold] for own in found]
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(where, span)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=[*kept, "score", "predicted", "offending"])

    return docs.select(*kept, F.col(text).alias("_score_text")).mapInArrow(apply, schema)


def clean_only(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below ``threshold``, with their columns. Null and empty texts stay."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([noisy_or(find(t or "")) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
