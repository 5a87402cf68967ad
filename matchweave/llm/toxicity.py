"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or of them scores the text.

Only texts are labelled.  A sentence is toxic with probability p = sigmoid(b + sum of its words'
weights), a text if any of its sentences is: P = 1 - prod(1 - p).  With S = sum of log(1 + e^z) over
sentences, P = 1 - e^-S, and the likelihood of the texts' labels trains the words' weights.
"""

from __future__ import annotations

import dataclasses
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.llm.common import append, bounded, stored, texts_of

#: What ends a sentence: full stops, question and exclamation marks of several scripts, and line breaks.
_SENTENCE = re.compile("[^.!?\n\u2026\u3002\uff01\uff1f\uff61\u0964\u061f\u06d4\u1362]+")
_WORD = re.compile(r"\w+")
#: Lengths of the beginnings of longer words that are features next to the word.
BEGINNINGS = (5, 7)
#: Words whose weight a worker remembers, and the longest of them.
MEMO_WORDS, MEMO_LETTERS = 300_000, 40


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


class Words(dict):
    """The weight of each short word met so far: the sum of its features' weights; both bounds bound the bytes."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        value = sum([self.weights.get(f, 0.0) for f in features(word)])
        if len(word) <= MEMO_LETTERS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


@dataclasses.dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def sentences(self, text: str, words: Words) -> np.ndarray:
        """Log-odds of each sentence; a word counts once in a sentence."""
        split = _WORD.findall
        return np.array([sum([words[w] for w in {*split(s)}]) for s in _SENTENCE.findall(text.lower())]) + self.bias

    def score(self, z: np.ndarray) -> float:
        return float(-np.expm1(-np.logaddexp(0, z).sum()))


def text_features(text: str) -> set[str]:
    return {f for w in {*_WORD.findall(text.lower())} for f in features(w)}


def numbered(text: str, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the known features of each sentence that has some, one sentence after another, and where each ends."""
    words, ends = array("i"), array("q")
    for s in _SENTENCE.findall(text.lower()):
        ids = [index[f] for w in sorted({*_WORD.findall(s)}) for f in features(w) if f in index]
        if ids:
            words.extend(ids)
            ends.append(len(words))
    return np.frombuffer(words, np.int32), np.frombuffer(ends, np.int64)


@dataclasses.dataclass
class Bags:
    """Texts as bags of sentences: feature numbers, where sentences end, the text of each sentence, the texts' labels."""

    words: np.ndarray
    ends: np.ndarray
    of_text: np.ndarray
    labels: np.ndarray

    @classmethod
    def join(cls, texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Bags:
        before = np.cumsum([0, *(len(w) for w, _ in texts)])
        return cls(np.concatenate([np.zeros(0, np.int32), *(w for w, _ in texts)]),
                   np.concatenate([np.zeros(0, np.int64), *(e + b for (_, e), b in zip(texts, before))]),
                   np.repeat(np.arange(len(texts)), [len(e) for _, e in texts]), np.array(labels, np.int64))

    def gradient(self, w: np.ndarray, b: float, wrong: float) -> tuple[float, np.ndarray, float]:
        """The mean negative log-likelihood of the labels, and its gradient by the weights and by the bias.

        A text without a toxic sentence has S = sum of log(1 + e^z), and is toxic with wrong + (1 - wrong)(1 - e^-S).
        """
        starts, n = np.concatenate([[0], self.ends[:-1]]), len(self.labels)
        z = np.add.reduceat(w[self.words], starts) + b
        soft, p = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
        s = np.bincount(self.of_text, soft, n)
        clean = np.exp(-s)
        toxic = wrong + (1 - wrong) * (1 - clean)
        loss = np.where(self.labels == 1, -np.log(toxic), s).sum() / n
        pull = np.where(self.labels == 1, -(1 - wrong) * clean / toxic, 1.0)[self.of_text] * p
        sentence = np.repeat(np.arange(len(self.ends)), self.ends - starts)
        return float(loss), np.bincount(self.words, pull[sentence], len(w)) / n, float(pull.sum() / n)


def ascend(bags: Bags, n_features: int, rounds: int = 240, rate: float = 1.0, evidence: float = 2e-3, wrong: float = 0.01,
           bias: float = -7.0) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive gradient steps on the likelihood.

    After each step weights shrink towards zero by an amount that asks for a feature's ``evidence``, as a
    share of the texts, so those of a few texts get none; in the second half of the rounds those
    that have a weight keep it and shrink a tenth as much.  ``wrong`` is the share of texts that bear
    the toxic label for nothing that their words show.
    """
    w, squares = np.zeros(n_features), np.full(n_features, 1e-6)
    b, b_squares, kept = bias, 1e-6, None
    for turn in range(rounds):
        _, grad, g = bags.gradient(w, b, wrong)
        squares += grad * grad
        step = rate / np.sqrt(squares)
        w -= step * grad
        if turn == rounds // 2:
            kept = w != 0
        late = turn > rounds // 2
        w = np.sign(w) * np.maximum(np.abs(w) - step * evidence * (0.1 if late else 1), 0) * (kept if late else 1)
        b_squares += g * g
        b = min(b - 0.2 * rate * g / np.sqrt(b_squares), bias / 2)
    return w, float(b)


def _model(index: dict[str, int], bags: Bags, **options) -> Model:
    if not len(bags.ends) or len(set(bags.labels.tolist())) < 2:
        return Model({}, options.get("bias", -7.0))
    w, b = ascend(bags, len(index), **options)
    return Model({k: float(w[i]) for k, i in index.items() if abs(w[i]) > 1e-3}, b)


def train(texts: list[str], labels: np.ndarray, min_texts: int = 8, **options) -> Model:
    """A model from texts in memory, each of which should be given once: what ``fit`` finds in Spark.

    Features are those of at least ``min_texts`` texts.  Without a text of each label all sentences have the odds of the bias.
    """
    seen = Counter()
    for t in texts:
        seen.update(text_features(t))
    index = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= min_texts))}
    return _model(index, Bags.join([numbered(t, index) for t in texts], list(labels)), **options)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, folds: int = 5) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents outside the held-out fold.

    The fold is crc32 of the doc_id as text, modulo ``folds``, equal to 0.  Rows are drawn by the
    smallest hash of their doc_id, so the draw is the same each time; a doc_id counts once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != 0))
    drawn = known.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def training_texts(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """(text, label) of the distinct texts of ``training_rows``, in the order of their hash as far as ``max_bytes`` go; a text is toxic if one of its rows is."""
    rows = training_rows(docs, labels, "toxic", max_rows).groupBy("text").agg(F.max("label").alias("label"))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("text"), "text"))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).drop("so_far")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 64 << 20, min_texts: int = 8, **options) -> Model:
    """A model from a bounded sample of the labelled texts; only their words are its input.

    The sample has at most ``max_rows`` texts and ``max_bytes``.  Features are counted and sentences numbered in Spark;
    the driver gets the features of at least ``min_texts`` texts, and the numbers.
    """
    spark = docs.sparkSession
    texts = stored(training_texts(docs, labels, max_rows, max_bytes).repartition(8), "toxicity-sample")

    def seen(batches):
        for batch in batches:
            for part in bounded(iter([batch]), "text"):
                found = Counter(f for t in texts_of(part, "text") for f in text_features(t))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])

    counts = texts.select("text").mapInArrow(seen, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    index = {f: i for i, f in enumerate(sorted(r.feature for r in counts.where(F.col("n") >= min_texts).select("feature").collect()))}
    sent = spark.sparkContext.broadcast(index)

    def number(batches):
        for batch in batches:
            for part in bounded(iter([batch]), "text"):
                words, ends = zip(*(numbered(t, sent.value) for t in texts_of(part, "text"))) if part.num_rows else ((), ())
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("label"), pa.array([w.tobytes() for w in words], pa.binary()),
                                                  pa.array([e.tobytes() for e in ends], pa.binary())], names=["digest", "label", "words", "ends"])

    rows = texts.select("text", F.sha2("text", 256).alias("digest"), F.col("label").cast("int").alias("label"))
    rows = sorted(rows.mapInArrow(number, "digest string, label int, words binary, ends binary").collect(), key=lambda r: r.digest)
    bags = Bags.join([(np.frombuffer(r.words, np.int32), np.frombuffer(r.ends, np.int64)) for r in rows], [r.label for r in rows])
    return _model(index, bags, **options)


_SENTENCES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SENTENCES = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score", offending: str = "offending") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``offending``: the sentences that are more likely toxic than not.

    ``offending`` holds start and end in code points and the sentence's score.  Null and empty texts
    have the score 0.  A text is read whole.  A column that has one of the two names is replaced: give others
    to keep it.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    words = Words(model.weights)

    def compute(batch):
        model, scores, spotted = sent.value, [], []
        for t in texts_of(batch, text):
            z = model.sentences(t, words)
            scores.append(model.score(z))
            spans = [m.span() for m in _SENTENCE.finditer(t)] if (z > 0).any() else []
            spans = spans if len(spans) == len(z) else []
            spotted.append([{"start": a, "end": b, "score": float(1 / (1 + np.exp(-v)))} for (a, b), v in zip(spans, z) if v > 0])
        return [pa.array(scores, pa.float64()), pa.array(spotted, _SENTENCES)]

    return append(df, text, [T.StructField(score, T.DoubleType()), T.StructField(offending, SENTENCES)], compute)
