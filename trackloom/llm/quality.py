"""Quality classifier by co-training two views of a document.

The text view sees which words, beginnings of words and word shapes occur, and which
beginnings occur more than once; the page view sees metadata
and layout: language, source, length, lines, shares of upper case, digits and marks,
and how much of it repeats.  Each is a logistic regression.  Over `ROUNDS` rounds each
view judges all unlabelled documents and labels some that it is sure of, and of which
the other does not think the opposite, for the other view to learn from.  Labelled rows held out of training calibrate both views, and a small
regression over the calibrated views, and the lower of them, gives every document's
score: what one view alone finds bad need not be outvoted.

Models are fitted on at most `MAX_LABELLED` labelled documents, those with the smallest
hashes of their ids, and at most `HANDED_ON` pseudo-labelled ones of each label from
each view, those with the smallest hashes among all that the view is sure of.  The
words of the text view are at most `VOCABULARY` that tell good from bad in the training
rows.  Every judgement covers all documents whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, NORMAL, SOLID, Words, checkpoint, mix, span_hashes, text_slices

#: Bounds of the rows and words that models are fitted on, and the share of labelled rows that is held out for calibration.
MAX_LABELLED, HANDED_ON, VOCABULARY, HELD_OUT = 8000, 1000, 4096, 0.3
ROUNDS = 2
#: A view is sure of labels beyond these probabilities.
SURE_GOOD, SURE_BAD = 0.97, 0.03
#: Likelihood ratio (chi-squared, one degree of freedom) that a word of the text view has at least; among a million words chance gives none.
TELLING = 30.0
#: Bytes of a word's beginning, and the numbers of times from which on its repeats are signs of their own.
BEGINNING, REPEATS = 6, (2, 4)
META_BUCKETS, LAYOUT = 256, 8
#: Partitions of the bounded sample: each iteration of a fit sends one gradient a partition to the driver.
SAMPLE_PARTITIONS = 3
#: Documents with a smaller score are rejected.
LEAST_SCORE = 0.5
VIEWS = ("text_view", "page_view")
PENALTY = {"text_view": {"regParam": 2e-4, "elasticNetParam": 0.0}, "page_view": {"regParam": 1e-4, "elasticNetParam": 0.0}}

# Runs of upper case, of lower case and letters beyond ASCII, and of digits each make one sign of a word's shape; marks stay.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A], _SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:] = 0x30, 0x41, 0x61, 0x61
_RUNS = np.zeros(256, bool)
_NEAR_BITS = 16
_RUNS[[0x30, 0x41, 0x61]] = True


def _rows_of(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.offsets) - 1), words.counts())


def _beginnings(low: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of distinct beginnings of words, and of those that come often."""
    long = np.flatnonzero(low.ends - low.starts >= BEGINNING)
    begun, begin = _rows_of(low)[long], mix(span_hashes(low.data, low.starts[long], low.starts[long] + BEGINNING) + np.uint64(2))
    order = np.lexsort((begin, begun))
    begun, begin = begun[order], begin[order]
    first = np.flatnonzero(np.append(True, (begun[1:] != begun[:-1]) | (begin[1:] != begin[:-1]))) if len(begin) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(begin)))
    yield begun[first], begin[first]
    for k in REPEATS:
        yield begun[first[n >= k]], mix(begin[first[n >= k]] + np.uint64(k))


def _tokens(data: np.ndarray, offsets: np.ndarray, solid: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash), a kind at a time: of all lower-cased words, of their beginnings, and of all words' shapes."""
    low = Words(LOWER[data], offsets, NORMAL)
    yield _rows_of(low), low.hashes()
    yield from _beginnings(low)
    del low
    shape = _SHAPE[data]
    kept = np.ones(len(data), bool)
    kept[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
    kept[solid.starts] = True
    place = np.zeros(len(data) + 1, np.int64 if len(data) >> 31 else np.int32)
    np.cumsum(kept, out=place[1:])
    starts, ends = place[solid.starts].astype(np.int64), place[solid.ends].astype(np.int64)
    del place
    yield _rows_of(solid), mix(span_hashes(shape[kept], starts, ends) + np.uint64(1))


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    order = np.lexsort((hashes, rows))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (rows[order[1:]] != rows[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
    return np.bincount(rows[order[fresh]], minlength=n)


def _layout(data: np.ndarray, offsets: np.ndarray, solid: Words, hashes: np.ndarray) -> np.ndarray:
    """Length, lines, shares of upper case, digits and marks, of distinct words and lines, and the words' mean length."""
    n, size = len(offsets) - 1, np.diff(offsets)
    whole = np.maximum(size, 1)
    count = lambda flags: np.array([np.count_nonzero(flags[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    line_kind = np.ones(256, bool)
    line_kind[10] = False
    lines = Words(data, offsets, line_kind)
    words, breaks = np.maximum(solid.counts(), 1), count(data == 10) + 1
    marks = (data > 32) & (data < 127) & (_SHAPE[data] == data) & ~_RUNS[data]
    distinct_lines = _distinct(_rows_of(lines), lines.hashes(), n) + (breaks > lines.counts())
    return np.stack(
        [
            np.log1p(size) / 10,
            np.log1p(breaks) / 5,
            count(_SHAPE[data] == 0x41) / whole,
            count(_SHAPE[data] == 0x30) / whole,
            count(marks) / whole,
            _distinct(_rows_of(solid), hashes, n) / words,
            distinct_lines / breaks,
            size / words / 20,
        ],
        axis=1,
    )


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and distinct token."""
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column("text")):
            for rows, hashes in _tokens(data, offsets, Words(data, offsets, SOLID)):
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("good").slice(row, end - row).take(pa.array(rows[fresh])), pa.array(hashes[fresh].view(np.int64))], ["good", "token"])


@dataclass
class _Telling:
    """The words of the text view, in the order of their hashes."""

    hashes: np.ndarray

    def __post_init__(self):
        self.near = np.zeros(1 << _NEAR_BITS, bool)
        self.near[self.hashes >> np.uint64(64 - _NEAR_BITS)] = True

    def present(self, tokens: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in the vocabulary) of the words that occur, each once a row."""
        pairs, n = [np.empty(0, np.int64)], len(self.hashes)
        for rows, hashes in tokens if n else ():
            maybe = np.flatnonzero(self.near[hashes >> np.uint64(64 - _NEAR_BITS)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), n - 1)
            hit = self.hashes[at] == hashes[maybe]
            pairs.append(np.unique(rows[maybe[hit]] * n + at[hit]))
        pairs = np.unique(np.concatenate(pairs))
        return pairs // max(n, 1), pairs % max(n, 1)


def _sample_features(batches: Iterator[pa.RecordBatch], telling: _Telling) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column("text")):
            solid = Words(data, offsets, SOLID)
            at, word = telling.present(_tokens(data, offsets, solid))
            cut = np.searchsorted(at, np.arange(end - row + 1))
            columns = {c: batch.column(c).slice(row, end - row) for c in ("doc_id", "good", "meta")}
            columns["words"] = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(word.astype(str), pa.string()))
            columns["layout"] = pa.array(_layout(data, offsets, solid, solid.hashes()).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(columns)


@dataclass
class View:
    """A fitted regression: weights and offset."""

    weights: np.ndarray
    offset: float


def _log_odds(batches: Iterator[pa.RecordBatch], telling: _Telling, views: dict[str, View], carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns `carried`, and the log odds of both views, held within 30."""
    text, page = views["text_view"], views["page_view"]
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column("text")):
            n = end - row
            solid = Words(data, offsets, SOLID)
            at, word = telling.present(_tokens(data, offsets, solid))
            by_text = text.offset + np.bincount(at, text.weights[word], n)
            meta = np.array(batch.column("meta").slice(row, n).to_pylist(), np.int64).reshape(n, 2)
            by_page = page.offset + page.weights[meta].sum(axis=1) + _layout(data, offsets, solid, solid.hashes()) @ page.weights[META_BUCKETS:]
            columns = {c: batch.column(c).slice(row, n) for c in carried}
            columns |= {f"{v}_logit": pa.array(np.clip(x, -30, 30)) for v, x in zip(VIEWS, (by_text, by_page), strict=True)}
            yield pa.RecordBatch.from_pydict(columns)


def _meta():
    """Places of language and source among the page view's weights; null is a value of its own."""
    half = META_BUCKETS // 2
    return F.array(*[(F.pmod(F.xxhash64(F.coalesce(c, F.lit("\u0000"))), F.lit(half)) + k * half).cast("int") for k, c in enumerate(("lang", "source"))]).alias("meta")


def _judged(docs: DataFrame, telling: _Telling, views: dict[str, View], carried: list[str]) -> DataFrame:
    """The columns `carried` of docs as c0, c1, ..., and the log odds of both views."""
    packed = docs.select(F.col("text"), _meta(), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carried)])
    kept = [f"c{k}" for k in range(len(carried))]
    kinds = {f.name: f for f in packed.schema}
    schema = StructType([*(kinds[c] for c in kept), *(StructField(f"{v}_logit", DoubleType()) for v in VIEWS)])
    return packed.mapInArrow(lambda batches: _log_odds(batches, telling, views, kept), schema)


@dataclass
class QualityModel:
    """Both views, a calibration (slope, offset) of each, and the weights that combine them."""

    telling: _Telling
    views: dict[str, View]
    calibration: dict[str, tuple[float, float]]
    weights: tuple[float, ...]

    def _scored(self, docs: DataFrame, carried: list[str]) -> DataFrame:
        made = _judged(docs, self.telling, self.views, carried)
        for view in VIEWS:
            slope, offset = self.calibration[view]
            made = made.withColumn(f"{view}_logit", F.col(f"{view}_logit") * slope + offset)
        said = [*(F.col(f"{v}_logit") for v in VIEWS), F.least(*(f"{v}_logit" for v in VIEWS))]
        total = sum((x * w for x, w in zip(said, self.weights, strict=False)), F.lit(self.weights[-1]))
        odds = lambda x: 1 / (1 + F.exp(-x))
        return made.withColumns({"text_score": odds(F.col("text_view_logit")), "page_score": odds(F.col("page_view_logit")), "score": odds(total)})

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_score, page_score and score of each row of docs; null texts are scored as empty ones."""
        return self._scored(docs, ["doc_id"]).select(F.col("c0").alias("doc_id"), "text_score", "page_score", "score")

    def keep(self, docs: DataFrame, least: float) -> DataFrame:
        """The rows of docs whose score reaches `least`, or whose id is null; nothing is shuffled."""
        kept = self._scored(docs, docs.columns).where((F.col("score") >= least) | F.col(f"c{docs.columns.index('doc_id')}").isNull())
        return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


@dataclass
class ConstantModel:
    """Where labels of one class, or none, leave nothing to learn: the share of good labels, or 1."""

    share: float

    def score(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", *[F.lit(self.share).alias(c) for c in ("text_score", "page_score", "score")])

    def keep(self, docs: DataFrame, least: float) -> DataFrame:
        return docs.where((F.lit(self.share) >= least) | F.col("doc_id").isNull())


def _fit(rows: DataFrame, view: str) -> View:
    model = LogisticRegression(featuresCol=view, labelCol="good", maxIter=40, **PENALTY[view]).fit(rows)
    return View(model.coefficients.toArray(), float(model.intercept))


def _fit_views(rows: dict[str, DataFrame]) -> dict[str, View]:
    """Both views, fitted one after the other on bounded samples.

    Every iteration is a job with broadcasts of its own, so fits side by side fill the driver's heap twice as fast.
    No more than `SAMPLE_PARTITIONS` tasks an iteration, so that Spark adds up gradients without a shuffle.
    """
    return {view: _fit(rows[view].coalesce(SAMPLE_PARTITIONS), view) for view in VIEWS}


def _telling(train: DataFrame) -> _Telling:
    """The words of train(text, good) whose documents' labels differ most from all documents' labels."""
    n_good, n = train.agg(F.sum("good"), F.count("*")).first()
    by = train.select("text", "good").mapInArrow(_all_tokens, "good double, token long").groupBy("token").agg(F.sum("good").alias("k"), F.count("*").cast("double").alias("m"))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    k, m, p = F.col("k"), F.col("m"), n_good / n
    rest_k, rest = n_good - k, n - m
    ratio = 2 * (part(k, m * p) + part(m - k, m * (1 - p)) + part(rest_k, rest * p) + part(rest - rest_k, rest * (1 - p)))
    best = by.where("m >= 4").withColumn("ratio", ratio).where(F.col("ratio") >= TELLING).orderBy(F.desc("ratio"), "token").limit(VOCABULARY)
    return _Telling(np.sort(np.array([r.token for r in best.select("token").collect()], np.int64).view(np.uint64)))  # at most VOCABULARY numbers


def _features(rows: DataFrame, telling: _Telling) -> DataFrame:
    """rows(doc_id, text, good, meta) of a bounded sample, with both views as vectors instead of the text."""
    made = rows.mapInArrow(lambda batches: _sample_features(batches, telling), "doc_id long, good double, meta array<int>, words array<string>, layout array<double>")
    occur = lambda n, c, out: CountVectorizerModel.from_vocabulary([str(k) for k in range(max(n, 1))], inputCol=c, outputCol=out).setBinary(True)
    made = made.withColumn("places", F.col("meta").cast("array<string>")).select("*", *[F.get("layout", F.lit(k)).alias(f"layout_{k}") for k in range(LAYOUT)])
    made = occur(META_BUCKETS, "places", "meta_view").transform(occur(len(telling.hashes), "words", "text_view").transform(made))
    made = VectorAssembler(inputCols=["meta_view", *(f"layout_{k}" for k in range(LAYOUT))], outputCol="page_view").transform(made)
    return made.select("doc_id", "good", "text_view", "page_view", "meta")


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel | ConstantModel:
    """Co-train on docs(doc_id, text, lang, source) and labels(doc_id, quality, toxic).

    A document is good if its quality is 1 and it is not toxic.  Labels with a null
    id or quality are left out, a null toxic counts as 0; of several labels of one
    document the worst holds.
    """
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double")
    labelled = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    order = [F.xxhash64("doc_id", F.lit(5)), "doc_id"]
    docs = docs.select("doc_id", "text", "lang", "source")  # others may have the names of columns that are made here
    some = checkpoint(labelled.orderBy(*order).limit(MAX_LABELLED))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _meta())
    # At most MAX_LABELLED rows of two numbers.
    known = checkpoint(texts.join(F.broadcast(some), "doc_id").repartition(SAMPLE_PARTITIONS, "doc_id"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1000)) < int(1000 * HELD_OUT)
    counts = known.groupBy(held.alias("held")).agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()
    if len(counts) < 2 or any(r["good"] in (0, r["n"]) for r in counts):
        n = sum(r["n"] for r in counts)
        return ConstantModel(sum(r["good"] for r in counts) / n if n else 1.0)

    telling = _telling(known.where(~held))
    rows = checkpoint(_features(known, telling))
    train, calibrate = rows.where(~held), rows.where(held)
    views = _fit_views(dict.fromkeys(VIEWS, train))
    for k in range(ROUNDS):
        taught = _pseudo_labelled(docs, texts, labelled, telling, views, k)
        views = _fit_views({view: train.unionByName(_features(taught.where(F.col("view") == view).drop("view"), telling)) for view in VIEWS})

    odds = checkpoint(_judged(docs.join(F.broadcast(some.where(held)), "doc_id"), telling, views, ["good"]).withColumnRenamed("c0", "good"))
    calibration, small = {}, odds.coalesce(1)  # held-out rows, two numbers each
    for view in VIEWS:
        line = _small_fit(small, [f"{view}_logit"])
        calibration[view] = line[0], line[1]
        small = small.withColumn(f"{view}_logit", F.col(f"{view}_logit") * line[0] + line[1])
    both = [f"{v}_logit" for v in VIEWS]
    return QualityModel(telling, views, calibration, tuple(_small_fit(small.withColumn("lower", F.least(*both)), [*both, "lower"])))


def _pseudo_labelled(docs: DataFrame, texts: DataFrame, labelled: DataFrame, telling: _Telling, views: dict[str, View], seed: int) -> DataFrame:
    """doc_id, text, good, meta and the view that is to learn from it; from all unlabelled documents."""
    said = _judged(docs.where("doc_id is not null"), telling, views, ["doc_id"]).withColumnRenamed("c0", "doc_id")
    said = checkpoint(said.join(labelled.select("doc_id"), "doc_id", "left_anti"))
    chosen = None
    for view, other in (VIEWS, VIEWS[::-1]):
        p = 1 / (1 + F.exp(-F.col(f"{other}_logit")))
        for sure, label in ((p >= SURE_GOOD, 1.0), (p <= SURE_BAD, 0.0)):
            own = said.where(sure & ((F.col(f"{view}_logit") > 0) == bool(label))).orderBy(F.xxhash64("doc_id", F.lit(11 + seed)), "doc_id").limit(HANDED_ON).select("doc_id", F.lit(label).alias("good"), F.lit(view).alias("view"))
            chosen = own if chosen is None else chosen.unionByName(own)
    # At most 4 * HANDED_ON rows of two numbers and a name.
    return checkpoint(texts.join(F.broadcast(checkpoint(chosen)), "doc_id").repartition(SAMPLE_PARTITIONS, "doc_id"))


def _small_fit(rows: DataFrame, columns: list[str]) -> list[float]:
    """Coefficients and intercept of a logistic regression over a few columns."""
    made = VectorAssembler(inputCols=columns, outputCol="x").transform(rows)
    model = LogisticRegression(featuresCol="x", labelCol="good", maxIter=50, regParam=1e-3).fit(made)
    return [*map(float, model.coefficients), float(model.intercept)]


def classify(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, text_score, page_score, score and keep of each row of docs, by a model fitted on docs and labels.

    Null texts, languages and sources are values of their own; ids may repeat or be
    null, and each row is judged by itself, whole texts of any length.  Columns beside doc_id,
    text, lang and source are not read.  An empty table gives an empty result.
    """
    return fit(docs, labels).score(docs).withColumn("keep", F.col("score") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows that the classifier rejects; a row with a null id stays, as nothing can name it."""
    return fit(docs, labels).keep(docs, least)
