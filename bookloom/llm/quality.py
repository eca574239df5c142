"""Quality scores from pairwise preferences (Bradley-Terry), with a threshold by score quantile.

Documents marked good are preferred to documents marked bad. The scores are linear in features
of the text and are learnt by logistic loss on the differences of a pair's features. A quantile
of all scores is the threshold, put in a gap between scores; a logistic curve through it maps
scores to 0 … 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..sources.staging import stage
from .process import forget, slices

MAX_LABELLED = 20_000  # rows a model is fitted on, those of the smallest hashes of their ids
ROUNDS = 4  # preference pairs for each document that takes part
AT_THRESHOLD = 0.3  # the mapped score of the threshold
ERRORS = 2.0  # standard errors that the share of bad documents, an estimate, is uncertain by
BINS = 4096  # equal parts of a range of scores that are counted at once

_LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> list[float]:
    """What the look of a whole text says: signs, capitals, repeats, lengths. Finite for any text."""
    text = text or ""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    bare = _LETTERS.findall(text)
    spaces = text.count(" ") + text.count("\n")
    letters = sum(map(len, bare))
    marks = sum(map(text.count, ".,;:'\"?-"))
    digits = sum(map(text.count, "0123456789"))
    signs = max(chars - letters - spaces - marks - digits, 0)
    shouting = sum(1 for w in bare if len(w) > 1 and w.isupper())
    repeats = sum(map(str.__eq__, words, words[1:]))
    repeated_lines = len(lines) - len(set(lines))
    shares = [
        signs / chars,
        digits / chars,
        marks / chars,
        text.count("!") / n,
        text.count("|") / n,
        text.count("#") / n,
        text.count("http") / n,
        shouting / n,
        repeats / n,
        repeated_lines / max(len(lines), 1),
        1 - len(counts) / n,
        (max(counts.values(), default=0) - 1) / n,
        text.count(".") / n,
        len(lines) / n,
    ]
    scaled = [math.sqrt(max(x, 0.0)) for x in shares]
    present = [float(x > 0.02) for x in shares[:1] + shares[3:9]]
    word = letters / max(len(bare), 1)
    return [*shares, *scaled, *present, math.log1p(len(words)), math.log1p(chars / n), min(word, 40) / 10]


class Model(NamedTuple):
    weights: np.ndarray  # of the features
    cut: float  # the threshold on raw scores
    slope: float  # of the curve that maps raw scores to 0 … 1

    def raw(self, documents: DataFrame, text: str = "text") -> Column:
        weights = self.weights

        @F.arrow_udf("double")
        def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            forget()
            for part in texts:
                raw = [float(weights @ features(x)) for some in slices(part) for x in some]
                yield pa.array(raw, pa.float64())

        return score(documents[text])

    def mapped(self, raw: Column) -> Column:
        """0 … 1, ``AT_THRESHOLD`` at the threshold, never quite 0 or 1 for finite scores."""
        shift = math.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        at = F.greatest(F.least((raw - self.cut) * self.slope + shift, F.lit(35.0)), F.lit(-35.0))
        return 1 / (1 + F.exp(-at))


def known_labels(labels: DataFrame, label: Column) -> DataFrame:
    """``doc_id, label`` of the rows that have an id and a label."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), label.cast("int").alias("label"))
    return known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))


def sample_of_labels(labels: DataFrame, label: Column, most: int) -> DataFrame:
    """``doc_id, label`` of at most about ``most`` labelled ids, by a hash of the id.

    Null ids and null labels take no part; of an id's several labels the largest counts.
    """
    known = known_labels(labels, label)
    share = min(1.0, most / max(known.count(), 1))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    return known.where(hashed < int(share * (1 << 30)) + 1).groupBy("doc_id").agg(
        F.max("label").alias("label")
    )


def labelled_texts(
    documents: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str
) -> DataFrame:
    """``doc_id, text, label``; ``labels`` has at most about ``most`` rows, so it is broadcast."""
    texts = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(labels), "doc_id")


def _bins(scores: DataFrame, low: float, high: float) -> list[Row]:
    """``n, low, high`` (rows, smallest and largest score) of the parts of ``low … high`` in use."""
    part = F.floor((F.col("raw") - low) / (high - low) * BINS)
    within = scores.where(F.col("raw").between(low, high))
    found = within.groupBy(F.least(part, F.lit(BINS - 1)).alias("part")).agg(
        F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")
    )
    return sorted(found.collect(), key=lambda row: row["part"])


def _ranked(scores: DataFrame, rank: int, low: float, high: float) -> float:
    """The score of a rank from 0, exact: counted in ever narrower parts of all scores' range."""
    before = 0
    while low < high:
        for row in _bins(scores, low, high):
            if before + row["n"] > rank:
                break
            before += row["n"]
        low, high = row["low"], row["high"]
    return low


def threshold(scores: DataFrame, share: float, error: float = 0.0) -> float:
    """The quantile of ``raw`` at ``share`` give or take ``error``, midway between two scores.

    Within the error no rank is better than another, so the cut lies in the widest gap there;
    where no gap is wider than a part in ``BINS`` of those scores, at ``share`` itself.
    """
    rows, low, high = scores.agg(F.count("*"), F.min("raw"), F.max("raw")).first()
    rank = lambda x: _ranked(scores, min(max(x, 0), rows - 1), low, high)
    start = rank(math.ceil(rows * (share - error)) - 1)
    end = rank(math.floor(rows * (share + error)))
    if start < end:
        parts = _bins(scores, start, end)
        gaps = [(b["low"] - a["high"], a["high"], b["low"]) for a, b in zip(parts, parts[1:])]
        width, below, above = max(gaps, key=lambda gap: gap[0])
        if width >= (end - start) / BINS:
            return (below + above) / 2
    at = math.ceil(rows * share)
    return (rank(at - 1) + rank(at)) / 2


def fit(
    documents: DataFrame,
    labels: DataFrame,
    most: int = MAX_LABELLED,
    bad_share: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learn scores from ``labels`` (``doc_id, label``, 1 is good), of which ``most`` are used.

    ``bad_share`` is the quantile of the scores of all documents that becomes the threshold; by
    default it is the share of bad documents among all that are labelled, give or take the
    error of that share (see ``threshold``). Without both good and bad documents every text gets the same
    score, above the threshold. Labels that are null, or of an id that is null or no document's, are not
    used; a repeated row or label counts each time it is there; a null text counts as empty. Without
    documents the model is that of no labels. Other columns of ``documents`` are not read.
    """
    sampled = sample_of_labels(labels, F.col("label"), most)

    def measure(batches):
        forget()
        for batch in batches:
            rows = [features(text) for some in slices(batch.column(1)) for text in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))],
                ["doc_id", "label", "x"],
            )

    known = labelled_texts(documents, sampled, most, id_col, text_col)
    rows = stage(
        known.mapInArrow(measure, "doc_id bigint, label int, x array<double>"), "quality"
    )
    counts = dict(rows.groupBy("label").count().collect())
    good, bad = counts.get(1, 0), counts.get(0, 0)
    width = len(features(""))
    if not good or not bad:
        return Model(np.zeros(width), -1.0, 1.0)
    # Each document of the larger class meets about one of the other in each round.
    buckets = min(good, bad)

    def side(label: int) -> DataFrame:
        seeds = F.explode(F.sequence(F.lit(1), F.lit(ROUNDS)))
        own = rows.where(F.col("label") == label).withColumn("round", seeds)
        meet = F.pmod(F.xxhash64("doc_id", "label", "round"), F.lit(buckets))
        return own.select("round", meet.alias("meet"), F.col("x").alias(f"x{label}"), "doc_id")

    pairs = side(1).join(side(0).drop("doc_id"), ["round", "meet"])
    # A pair and its mirror image say the same; half of the pairs are mirrored.
    turn = F.pmod(F.xxhash64("doc_id", "round"), F.lit(2)) * 2.0 - 1.0
    examples = pairs.select(
        array_to_vector(
            F.transform(F.arrays_zip("x1", "x0"), lambda z: (z["x1"] - z["x0"]) * turn)
        ).alias("features"),
        ((turn + 1) / 2).alias("label"),
    )
    learner = LogisticRegression(
        fitIntercept=False, maxIter=40, regParam=1e-4, featuresCol="features", labelCol="label"
    )
    weights = learner.fit(stage(examples, "pairs")).coefficients.toArray()
    model = Model(weights, 0.0, 1.0)
    everything = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"), model.raw(documents, text_col).alias("raw")
    )
    scores = stage(everything, "scores")
    share, error = bad_share, 0.0
    if share is None:
        everyone = known_labels(labels, F.col("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
        judged = scores.select("doc_id").join(everyone, "doc_id")
        share, n = judged.agg(F.avg(1 - F.col("label")), F.count("*")).first()
        error = ERRORS * math.sqrt(share * (1 - share) / n)
    spread = scores.agg(F.stddev_pop("raw")).first()[0]
    return Model(weights, threshold(scores, share, error), 4.0 / max(float(spread), 1e-9))


def score_documents(
    documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, raw, score`` of every row.

    A null text counts as empty, and one of any length is scored whole. Rows without an id and repeated
    rows are scored each, an empty table gives no rows, and other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    raw = rows.select("doc_id", model.raw(rows).alias("raw"))
    return raw.select("doc_id", "raw", model.mapped(F.col("raw")).alias("score"))


def keep_good(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, with their columns as they are, whose score is not under the threshold.

    Null texts are judged as empty ones. Repeated rows stay or go together, rows without an id are
    judged by their text, and an empty table gives no rows.
    """
    return documents.where(model.raw(documents, text_col) >= model.cut)
