"""Quality by co-training: a classifier of the text's content and one of the page's metadata.

Each view is a logistic regression.  Over some rounds each hands the documents it is surest of, with
its labels, to the other one's training set; then both are calibrated on labelled documents that
neither has seen, and a regression on the two calibrated views scores all documents.

The content view is hashed words, pairs of words and shapes of words of the whole text and how they repeat; the metadata
view is language, source, recorded size and, where there is one, the URL, and nothing from the text.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.llm.common import append, bounded, stored, texts_of

WORDS, PAIRS, SHAPES = 384, 125, 128
LANGS, SOURCES, HOSTS = 16, 64, 32
#: Columns of the metadata view.
PAGE = ("lang", "source", "n_chars", "url")
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
#: Words whose hash a worker remembers, and the longest of them.
_MEMO_WORDS, _MEMO_LETTERS = 200_000, 40


def _shape(word: str) -> int:
    """The bucket of a word's shape: runs of capitals, letters and digits, and other characters as they are."""
    marks = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word]
    return zlib.crc32("".join(k for k, _ in itertools.groupby(marks)).encode()) % SHAPES


class Hashes(dict):
    """The crc32 of words, with the bucket of their shape above it, remembered for short ones; both bounds together bound the bytes."""

    def __missing__(self, word: str) -> int:
        value = _shape(word) << 32 | zlib.crc32(word.encode())
        if len(word) <= _MEMO_LETTERS:
            if len(self) >= _MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def text_view(texts: list[str], hashes: Hashes) -> np.ndarray:
    """Shares of hashed words, pairs of words and shapes, words equal to the one before, distinct words and mean length, for each text.

    Words are runs of letters and digits, and runs of other characters.
    """
    out = np.zeros((len(texts), WORDS + PAIRS + SHAPES + 3), np.float64)
    for row, t in zip(out, texts):
        words = _TOKENS(t)
        if not words:
            continue
        both = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
        codes = both.astype(np.uint32)
        row[:WORDS] = np.sqrt(np.bincount(codes % WORDS, minlength=WORDS) / len(words))
        row[WORDS + PAIRS:-3] = np.sqrt(np.bincount(both >> 32, minlength=SHAPES) / len(words))
        if len(words) > 1:
            pairs = codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(40503) >> np.uint32(7)
            row[WORDS:WORDS + PAIRS] = np.sqrt(np.bincount(pairs % PAIRS, minlength=PAIRS) / len(pairs))
        row[-3:] = ((codes[1:] == codes[:-1]).sum() / len(words), len(np.unique(codes)) / len(words), np.log1p(sum(map(len, words)) / len(words)))
    return out


def _bucket(value: str | None, size: int) -> int:
    return zlib.crc32((value or "").encode()) % size


def page_view(langs: list[str | None], sources: list[str | None], sizes: list[int | None], urls: list[str | None]) -> np.ndarray:
    """Language, source and recorded size of each page, its URL's host, and how deep and how long its path is."""
    out = np.zeros((len(langs), LANGS + SOURCES + HOSTS + 4), np.float64)
    for row, lang, source, size, url in zip(out, langs, sources, sizes, urls):
        row[_bucket(lang, LANGS)] = 1
        row[LANGS + _bucket(source, SOURCES)] = 1
        host, _, path = (url or "").rpartition("://")[2].partition("/")
        row[LANGS + SOURCES + _bucket(host, HOSTS)] = 1
        row[-4:] = np.log1p(size if size and size > 0 else 0), np.log1p(path.count("/")), np.log1p(len(path)), "?" in path
    return out


@dataclasses.dataclass
class Regression:
    """Logistic regression on standardised columns, fitted with a ridge by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Regression:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, np.inf)
        design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        penalty = np.full(design.shape[1], ridge)
        penalty[-1] = 1e-3
        w = np.zeros(design.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + np.diag(penalty), design.T @ (y - p) - penalty * w)
            w = w + np.clip(step, -2, 2)
        return cls(mean, scale, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.weights[:-1] + self.weights[-1]


@dataclasses.dataclass
class CoTrained:
    views: list[Regression]
    calibrations: list[Regression]
    blend: Regression

    def probability(self, views: list[np.ndarray]) -> np.ndarray:
        odds = [c.odds(np.clip(v.odds(x), -15, 15)[:, None]) for v, c, x in zip(self.views, self.calibrations, views)]
        return 1 / (1 + np.exp(-np.clip(self.blend.odds(np.column_stack(odds)), -30, 30)))


@dataclasses.dataclass
class HandOver:
    """What a view gives the other one in a round: documents of one sign, by the steps of their odds.

    Those above ``step`` and, by their lots, the share ``part`` of those in it; ``rate`` is the share of them that is fitted.
    """

    view: int
    model: Regression
    sign: int
    step: int
    part: float
    rate: float

    def chosen(self, x: list[np.ndarray], lots: np.ndarray, sure: float) -> np.ndarray:
        odds = self.sign * self.model.odds(x[self.view])
        steps = _steps(odds)
        return (odds > sure) & ((steps > self.step) | (steps == self.step) & (lots < self.part))


#: Odds are counted in steps of 1/64, up to 64.
_STEPS, _FINE = 4096, 64


def _steps(odds: np.ndarray) -> np.ndarray:
    return np.clip(odds * _FINE, 0, _STEPS - 1).astype(np.int64)


def _free(x: list[np.ndarray], lots: np.ndarray, past: list[HandOver], view: int, sure: float) -> np.ndarray:
    """The documents that ``view`` has not handed over yet."""
    free = np.ones(len(lots), bool)
    for h in past:
        if h.view == view:
            free &= ~h.chosen(x, lots, sure)
    return free


def _tally(x: list[np.ndarray], lots: np.ndarray, trained: list[Regression], past: list[HandOver], sure: float) -> np.ndarray:
    """For each view and sign: documents of that sign, and by step those that may still be handed over."""
    out = np.zeros((2, 2, 1 + _STEPS), np.int64)
    for i, model in enumerate(trained):
        free, odds = _free(x, lots, past, i, sure), model.odds(x[i])
        for j, sign in enumerate((1, -1)):
            out[i, j, 0] = (sign * odds > 0).sum()
            out[i, j, 1:] = np.bincount(_steps(sign * odds[free & (sign * odds > sure)]), minlength=_STEPS)
    return out


def _surest(counts: np.ndarray, trained: list[Regression], share: float, most: int) -> list[HandOver]:
    """The ``share`` of the documents of each sign that each view is surest of, ``most`` of them (or a little more) to be fitted."""
    out = []
    for i, j in itertools.product((0, 1), (0, 1)):
        good = counts[i, j, 1:]
        want = min(max(1, int(share * counts[i, j, 0])), int(good.sum()))
        if want:
            at_least = np.cumsum(good[::-1])[::-1]
            step = int(np.flatnonzero(at_least >= want)[-1])
            part = (want - int(at_least[step]) + int(good[step])) / int(good[step])
            out.append(HandOver(i, trained[i], (1, -1)[j], step, part, min(1.0, (most + 5 * most ** 0.5) / want)))
    return out


class Matrices:
    """A pool in memory: rows of both views."""

    def __init__(self, views: list[np.ndarray]):
        self.views = views
        self.lots, self.draws = np.random.default_rng(0).random((2, len(views[0])))

    def tally(self, trained, past, sure) -> np.ndarray:
        return _tally(self.views, self.lots, trained, past, sure)

    def take(self, new: list[HandOver], past: list[HandOver], sure: float, most: int) -> list[list[np.ndarray]]:
        """Both views of the documents that each of ``new`` hands over, of those the ``most`` of the smallest draws."""
        out = []
        for h in new:
            rows = np.flatnonzero(_free(self.views, self.lots, past, h.view, sure) & h.chosen(self.views, self.lots, sure))
            rows = rows[np.argsort(self.draws[rows], kind="stable")][:most]
            out.append([v[rows] for v in self.views])
        return out


class Documents:
    """A pool in Spark: ``lot`` and ``draw`` (0 to 1) next to the packed views."""

    def __init__(self, df: DataFrame):
        self.df = df

    def tally(self, trained, past, sure) -> np.ndarray:
        sent = self.df.sparkSession.sparkContext.broadcast((trained, past))

        def run(batches):
            total = np.zeros((2, 2, 1 + _STEPS), np.int64)
            for part in _slices(batches):
                total += _tally(_matrices(part), part.column("lot").to_numpy(), *sent.value, sure)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], names=["cell", "n"])

        counts = self.df.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        out = np.zeros((2, 2, 1 + _STEPS), np.int64)
        for r in counts:
            out.ravel()[r.cell] = r.n
        return out

    def take(self, new, past, sure, most) -> list[list[np.ndarray]]:
        sent = self.df.sparkSession.sparkContext.broadcast((new, past))

        def run(batches):
            new, past = sent.value
            for part in _slices(batches):
                x, lots, draws = _matrices(part), part.column("lot").to_numpy(), part.column("draw").to_numpy()
                free = [_free(x, lots, past, i, sure) for i in (0, 1)]
                for i, h in enumerate(new):
                    rows = np.flatnonzero(free[h.view] & (draws < h.rate) & h.chosen(x, lots, sure))
                    if len(rows):
                        found = part.take(pa.array(rows)).select(["draw", "views"])
                        yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), pa.int32()), *found.columns], names=["i", "draw", "views"])

        rows = self.df.mapInArrow(run, "i int, draw double, views binary").collect()
        found = [sorted((r for r in rows if r.i == i), key=lambda r: (r.draw, r.views))[:most] for i in range(len(new))]
        return [_unpacked([r.views for r in f]) for f in found]


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray] | Documents, held: np.ndarray,
             rounds: int = 4, share: float = 0.1, sure: float = 2.94, most: int = 250) -> CoTrained:
    """Both classifiers after the exchange, calibrated on the rows ``held`` of the labelled ones.

    In each round a view labels the ``share`` of each class of the whole pool that it is surest of, if
    the odds are over e**``sure`` (a probability of 0.95), for the other view; a document is handed over
    once.  Of what is handed over, a draw of ``most`` documents of a class, view and round is fitted.
    """
    own = [[v[~held]] for v in views]
    labels = [[y[~held]] for _ in views]
    pool = pool if isinstance(pool, Documents) else Matrices(pool)
    fit = lambda i: Regression.fit(np.concatenate(own[i]), np.concatenate(labels[i]))
    trained, past = [fit(0), fit(1)], []
    for _ in range(rounds):
        new = _surest(pool.tally(trained, past, sure), trained, share, most)
        if not new:
            break
        for h, x in zip(new, pool.take(new, past, sure, most)):
            own[1 - h.view].append(x[1 - h.view])
            labels[1 - h.view].append(np.full(len(x[0]), float(h.sign > 0)))
        past += new
        trained = [fit(0), fit(1)]
    at = held if len(set(y[held].tolist())) == 2 else np.ones(len(y), bool)
    odds = [np.clip(t.odds(v[at]), -15, 15)[:, None] for t, v in zip(trained, views)]
    calibrations = [Regression.fit(o, y[at]) for o in odds]
    blend = Regression.fit(np.column_stack([c.odds(o) for c, o in zip(calibrations, odds)]), y[at])
    return CoTrained(trained, calibrations, blend)


_WIDTHS = (WORDS + PAIRS + SHAPES + 3, LANGS + SOURCES + HOSTS + 4)
#: Documents whose views a worker holds as matrices at a time.
_ROWS = 2000


def _page(df: DataFrame) -> dict:
    """The columns of the metadata view; one that is not there is null."""
    kinds = {"n_chars": "long"}
    return {c: (F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")) for c in PAGE}


def _views(df: DataFrame, keep: list[str]) -> DataFrame:
    """``views``, both views of each document one after the other as half-precision numbers, next to ``keep``."""
    page = _page(df)
    rows = df.select("text", *[page[c].alias(f"page_{c}") for c in PAGE], *keep)

    def run(batches):
        hashes = Hashes()
        for part in _slices(bounded(batches, "text")):
            both = np.hstack([text_view(texts_of(part, "text"), hashes), page_view(*[part.column(f"page_{c}").to_pylist() for c in PAGE])])
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k) for k in keep], pa.array([r.tobytes() for r in both.astype("<f2")], pa.binary())], names=[*keep, "views"])

    return rows.mapInArrow(run, T.StructType([rows.schema[k] for k in keep] + [T.StructField("views", T.BinaryType())]))


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def _unpacked(views: list[bytes]) -> list[np.ndarray]:
    """The matrices of both views of packed rows."""
    out = np.frombuffer(b"".join(map(bytes, views)), "<f2").astype(np.float64).reshape(len(views), sum(_WIDTHS))
    return [out[:, :_WIDTHS[0]], out[:, _WIDTHS[0]:]]


def _matrices(batch: pa.RecordBatch) -> list[np.ndarray]:
    return _unpacked(batch.column("views").to_pylist())


def _digests(docs: DataFrame) -> DataFrame:
    """``docs`` with ``digest``, equal for equal texts; a null text is empty."""
    return docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))


def _who() -> Column:
    return F.col("doc_id").cast("string")


def _known(labels: DataFrame) -> DataFrame:
    """(who, label): the quality of each labelled doc_id."""
    return labels.where("doc_id is not null and quality is not null").groupBy(_who().alias("who")).agg(F.max("quality").alias("label"))


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int, folds: int = 5) -> DataFrame:
    """(who, digest, label) of at most ``max_rows`` distinct labelled texts outside the held-out fold of ``training_rows``.

    ``who`` is the doc_id as a string.  A text has the label of most of its doc_ids (good if they are as many) and the smallest of
    them; of a doc_id with several texts the one of the smallest digest counts.  Texts are drawn by the smallest digests.
    """
    known = _known(labels).where(F.crc32("who") % folds != 0)
    found = _digests(docs).select(_who().alias("who"), "digest").join(known, "who").groupBy("who").agg(
        F.min("digest").alias("digest"), F.max("label").alias("label"))
    texts = found.groupBy("digest").agg(F.min("who").alias("who"), (F.avg("label") >= 0.5).cast("int").alias("label"))
    return texts.select("who", "digest", "label").orderBy("digest").limit(max_rows)


def unlabelled(docs: DataFrame, labels: DataFrame, drawn: DataFrame) -> DataFrame:
    """The packed views of each distinct text of the documents without a label, but for the texts of ``drawn``, with a lot and a draw.

    A doc_id with several texts counts once, with the text of the smallest digest; rows without a doc_id count each.
    Only digests and packed views are shuffled, no texts; so the views of labelled documents are made too.
    """
    who = F.coalesce(_who(), F.concat(F.lit("text "), "digest"))
    views = _views(_digests(docs).withColumn("who", who), ["who", "digest"])
    free = views.join(_known(labels).select("who"), "who", "left_anti").join(F.broadcast(drawn.select("digest")), "digest", "left_anti")
    by_id = free.groupBy("who").agg(F.min(F.struct("digest", "views")).alias("row")).select("row.*")
    by_text = by_id.groupBy("digest").agg(F.min("views").alias("views"))
    lot = lambda seed: (F.xxhash64("digest", F.lit(seed)).bitwiseAND((1 << 52) - 1) / float(1 << 52))
    return by_text.select(lot(1).alias("lot"), lot(2).alias("draw"), "views")


def training_views(docs: DataFrame, drawn: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Both views of the rows ``drawn`` (who, digest, label), their labels, and which are kept for the calibration."""
    full = _digests(docs).withColumn("who", _who()).join(F.broadcast(drawn), ["who", "digest"])
    rows = _views(full, ["who", "label"]).groupBy("who", "label").agg(F.min("views").alias("views")).orderBy("who").collect()
    held = np.array([zlib.crc32(b"calibrate " + r.who.encode()) % 5 == 0 for r in rows], bool)
    return _unpacked([r.views for r in rows]), np.array([r.label for r in rows], np.float64), held


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, max_handed: int = 4000, rounds: int = 4) -> CoTrained | None:
    """A model from a bounded sample of the labelled texts and an exchange over all texts without a label.

    Equal texts count once; doc_ids may be of any type.  Every text without a label is scored in Spark in each round; the
    bounds are on the rows that the driver fits: ``max_labelled`` texts, and ``max_handed`` of those handed over.  A fifth of
    the labelled ones is kept for the calibration, another fifth (see ``labelled_rows``) is never read.  None without both labels.
    """
    spark = docs.sparkSession
    rows = labelled_rows(docs, labels, max_labelled).collect()
    if len({r.label for r in rows}) < 2:
        return None
    drawn = spark.createDataFrame([tuple(r) for r in rows], "who string, digest string, label int")
    views, y, held = training_views(docs, drawn)
    pool = Documents(stored(unlabelled(docs, labels, drawn), "cotraining-pool"))
    return co_train(views, y, pool, held, rounds=rounds, most=max(1, max_handed // max(1, 4 * rounds)))


def score(df: DataFrame, model: CoTrained | None, score: str = "score", keep: str = "keep") -> DataFrame:
    """``df`` with ``score``, the probability of good quality, and ``keep`` (score of a half or more).

    The content view reads the whole text, the metadata view lang, source, n_chars and url; nulls and missing columns count
    as unknown.  A column that has one of the two names is replaced: give others to keep it.  Without a model every document
    has a half and is kept; so has, with one, an empty or null text, about which the content says nothing.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    hashes = Hashes()
    page = {f"__page_{c}": v for c, v in _page(df).items()}
    names = list(page)

    def compute(batch):
        texts = texts_of(batch, "text")
        p = np.full(len(texts), 0.5)
        if sent.value is not None and len(texts):
            p = sent.value.probability([text_view(texts, hashes), page_view(*[batch.column(c).to_pylist() for c in names])])
            p[[not t.strip() for t in texts]] = 0.5
        return [pa.array(p), pa.array(p >= 0.5)]

    return append(df.withColumns(page), "text", [T.StructField(score, T.DoubleType()), T.StructField(keep, T.BooleanType())], compute).drop(*names)
