"""Toxicity by weak supervision: many voters, a generative model of them, a linear classifier.

Voters are lexicons and patterns. The lexicons are mined from labelled documents: whole words and
beginnings of words that stand in toxic documents only, or nearly; the patterns are of the text
itself, such as letters spaced out or masked. The label model explains the
votes by a hidden class; it estimates how often each voter fires in either class, and how voters
go together beyond the class, so that voters that say the same thing share one voice. Its
posteriors, not the labels, train a linear classifier on the lexicon's words, which scores texts.
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
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .process import forget, slices
from .quality import labelled_texts, sample_of_labels

MAX_LABELLED = 20_000  # rows a model is fitted on, those of the smallest hashes of their ids
LEXICON = 600  # entries
LEXICONS = 8  # voters that the entries of a kind are dealt to
BEGINNINGS = (4, 5)  # letters of the beginnings of longer words
MIN_DOCUMENTS = 3  # toxic ones that an entry stands in
CANDIDATES = 4000  # entries that are looked at, the best by ratio and number of documents
COVER = 3  # words that a toxic document is explained by; more of them say nothing new
MIN_RATIO = 20.0  # of the shares of toxic and of other documents with the entry
ROUNDS = 200  # of the label model, at most
AT_REST = 1e-4  # a posterior that moves no further has come to rest
NOISE = 0.1  # correlations below this count as none

_LETTERS = re.compile(r"[^\W\d_]+")
# Patterns of a text itself: letters spaced out, signs in place of letters, shouting, insistence.
PATTERNS = tuple(
    re.compile(pattern)
    for pattern in (
        r"(?<!\w)(?:[^\W\d_][ .*-]){3,}[^\W\d_](?!\w)",
        r"[^\W\d_][*#@$%]+[^\W\d_]",
        r"(?<!\w)[A-Z]{4,}\W+[A-Z]{4,}(?!\w)",
        r"[!?]{2,}",
    )
)


def entries_of(text: str | None) -> set[str]:
    """The words of a text (letters only, lower case) and, with a ``~``, how longer ones begin."""
    words = set(_LETTERS.findall((text or "").lower()))
    return words.union(*({w[:n] + "~" for w in words if len(w) > n} for n in BEGINNINGS))


class Lexicon(NamedTuple):
    places: dict  # entry: number
    voters: np.ndarray  # the voter of each entry

    @property
    def count(self) -> int:
        return int(self.voters.max(initial=-1)) + 1

    def found(self, text: str | None) -> list[int]:
        """Numbers of the entries that stand in a text."""
        places, words = self.places, set(_LETTERS.findall((text or "").lower()))
        hits = [places[w] for w in words if w in places]
        for n in BEGINNINGS:
            starts = {w[:n] + "~" for w in words if len(w) > n}
            hits += [places[s] for s in starts if s in places]
        return sorted(hits)

    def votes(self, hits: list[int], text: str | None) -> str:
        """One sign for each voter: the lexicons, several entries at once, then the patterns of the text."""
        lexicons = np.zeros(self.count, bool)
        lexicons[self.voters[hits]] = True
        patterns = [pattern.search(text or "") is not None for pattern in PATTERNS]
        return "".join("1" if fires else "0" for fires in [*lexicons, len(hits) >= 2, len(hits) >= 4, *patterns])


def mine(known: DataFrame, toxic: int, others: int) -> Lexicon:
    """The entries of ``known`` (distinct ``text, label``) that mark toxic documents best.

    An entry has to explain toxic documents that the better entries
    do not explain yet: the other words of a toxic text that has many near copies stand in toxic
    documents only as well, but always beside the words that make them toxic.
    """

    def count(batches):
        forget()
        tally: Counter = Counter()
        for batch in batches:
            for texts, labels in zip(slices(batch.column(0)), slices(batch.column(1))):
                for text, label in zip(texts, labels):
                    tally.update((entry, label) for entry in entries_of(text))
                if len(tally) > 100_000:
                    yield _tallied(tally)
                    tally = Counter()
        yield _tallied(tally)

    counts = (
        known.select("text", "label")
        .mapInArrow(count, "entry string, label int, n bigint")
        .groupBy("entry")
        .agg(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("fine"),
        )
    )
    ratio = ((F.col("bad") + 0.1) / (toxic + 1)) / ((F.col("fine") + 0.1) / (others + 1))
    chosen = (
        counts.where((F.col("bad") >= MIN_DOCUMENTS) & (ratio >= MIN_RATIO))
        .orderBy(F.desc(F.log(ratio) * F.log1p("bad")), "entry")
        .limit(CANDIDATES)
    )
    entries = [row["entry"] for row in chosen.collect()]
    candidates = Lexicon({e: i for i, e in enumerate(entries)}, np.zeros(len(entries), int))

    def look_up(batches):
        forget()
        for batch in batches:
            hits = [candidates.found(text) for texts in slices(batch.column(0)) for text in texts]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32()))], ["hits"])

    # At most as many rows as there are labelled documents in the sample.
    toxic_texts = known.where("label = 1").select("text").mapInArrow(look_up, "hits array<int>")
    entries = [entries[i] for i in explaining(toxic_texts.toArrow()["hits"].to_pylist(), entries)]
    # Dealt in turn by rank, so that every lexicon has strong entries; kinds stay apart.
    kinds, voters = Counter(), []
    for entry in entries:
        kind = BEGINNINGS.index(len(entry) - 1) + 1 if entry.endswith("~") else 0
        voters.append(kind * LEXICONS + kinds[kind] % LEXICONS)
        kinds[kind] += 1
    return Lexicon({e: i for i, e in enumerate(entries)}, np.array(voters, int))


def explaining(hits: list[list[int]], entries: list[str]) -> list[int]:
    """Of ``entries`` in order of merit, those that stand in documents not yet explained ``COVER`` times.

    A word, its beginnings and other words that begin alike explain a document once together.
    """
    documents: list[list[int]] = [[] for _ in entries]
    for number, own in enumerate(hits):
        for entry in own:
            documents[entry].append(number)
    explained: list[set[str]] = [set() for _ in hits]
    chosen = []
    for entry, own in enumerate(documents):
        kind = entries[entry][: min(BEGINNINGS)]
        if len(chosen) < LEXICON and sum(len(explained[d] - {kind}) < COVER for d in own) >= MIN_DOCUMENTS:
            for d in own:
                explained[d].add(kind)
            chosen.append(entry)
    return chosen


def _tallied(tally: Counter) -> pa.RecordBatch:
    entries, labels = zip(*tally) if tally else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(entries, pa.string()), pa.array(labels, pa.int32()),
         pa.array(list(tally.values()), pa.int64())],
        ["entry", "label", "n"],
    )


class LabelModel(NamedTuple):
    """What the generative model has estimated of the voters."""

    prior: float
    fires: np.ndarray  # chance to fire: row 0 in other documents, row 1 in toxic ones
    correlations: np.ndarray  # of voters, within the classes
    voices: np.ndarray  # weight of each voter

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = math.log(self.prior / (1 - self.prior))
        yes, no = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        at = odds + votes @ (self.voices * yes) + (1 - votes) @ (self.voices * no)
        return 1 / (1 + np.exp(-np.clip(at, -35, 35)))


def fit_votes(votes: np.ndarray, counts: np.ndarray, prior: float) -> LabelModel:
    """Estimate the voters by expectation and maximisation over patterns of votes and their counts.

    The class starts from the majority of voters, and rounds end when no posterior moves. A voter's
    voice is one over the sum of its correlations (within the classes, in absolute value, from
    ``NOISE`` on) with all voters, itself included. ``prior`` is what the labels say; the estimate
    stays between it and what the votes say.
    """
    total, number = counts.sum(), votes.shape[1]
    expected = prior = float(np.clip(prior, 1e-3, 0.5))
    fires = np.vstack([np.full(number, 0.002), np.full(number, 0.3)])
    correlations, voices = np.eye(number), np.ones(number)
    before = None
    for _ in range(ROUNDS):
        q = LabelModel(prior, fires, correlations, voices).posterior(votes)
        if before is not None and np.abs(q - before).max(initial=0.0) < AT_REST:
            break
        before = q
        residue = np.zeros((number, number))
        for kind, weight in enumerate(((1 - q) * counts, q * counts)):
            whole = weight.sum()
            # Two imaginary documents, which voters fire in one by one, keep chances inside 0 … 1. They
            # count in the variances too: else what is left of a class in the other one, however
            # little, correlates voters that hardly vary otherwise.
            imagined = 0.02 if kind == 0 else 0.5
            fires[kind] = (weight @ votes + imagined) / (whole + 2.0)
            centred = votes - fires[kind]
            residue += (centred * weight[:, None]).T @ centred + np.eye(number) * imagined * (1 - imagined / 2)
        fires[1] = np.maximum(fires[1], fires[0])  # a voter never speaks for the other class
        fires = np.clip(fires, 1e-5, 1 - 1e-5)
        # As many imaginary documents hold the prior where the labels have it.
        prior = float(np.clip(((q * counts).sum() / total + expected) / 2, 1e-3, 0.5))
        scale = np.sqrt(np.maximum(np.diag(residue), 1e-12))
        correlations = residue / np.outer(scale, scale)
        np.fill_diagonal(correlations, 1.0)
        strong = np.abs(correlations)
        voices = 1 / np.where(strong < NOISE, 0.0, strong).sum(1)
    return LabelModel(prior, fires, correlations, voices)


class Model(NamedTuple):
    lexicon: Lexicon
    labels: LabelModel | None
    weights: np.ndarray  # of the entries
    intercept: float

    def score(self, documents: DataFrame, text: str = "text") -> Column:
        """0 … 1 for every text, empty and null ones included."""
        lexicon, weights, intercept = self.lexicon, self.weights, self.intercept

        @F.arrow_udf("double")
        def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            forget()
            for part in texts:
                raw = [weights[lexicon.found(x)].sum() for some in slices(part) for x in some]
                raw = np.clip(np.array(raw, float) + intercept, -35, 35)
                yield pa.array(1 / (1 + np.exp(-raw)), pa.float64())

        return score(documents[text])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    most: int = MAX_LABELLED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learn a model from ``labels`` (``doc_id, label``, 1 is toxic), of which ``most`` are used.

    Without toxic documents, or without entries that mark them, every text scores near 0; so it does
    without documents. Labels that are null, or of an id that is null or no document's, are not used.
    Repeated rows and copies of a text count once, toxic if any of them is. Null texts count as empty.
    """
    sampled = sample_of_labels(labels, F.col("label"), most)
    texts = labelled_texts(documents, sampled, most, id_col, text_col)
    # Copies of a text count once, in the lexicon, the prior and the model of votes.
    once = texts.groupBy(F.xxhash64("text").alias("_same")).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    known = stage(once.select("text", "label"), "toxicity")
    counts = dict(known.groupBy("label").count().collect())
    toxic, others = counts.get(1, 0), counts.get(0, 0)
    lexicon = mine(known, toxic, others) if toxic else Lexicon({}, np.array([], int))
    if not lexicon.places:
        return Model(lexicon, None, np.zeros(0), -4.0)

    def vote(batches):
        forget()
        for batch in batches:
            for texts in slices(batch.column(0)):
                hits = [lexicon.found(text) for text in texts]
                votes = [lexicon.votes(own, text) for own, text in zip(hits, texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hits, pa.list_(pa.int32())), pa.array(votes, pa.string())], ["hits", "votes"]
                )

    voted = stage(known.select("text").mapInArrow(vote, "hits array<int>, votes string"), "votes")
    # At most one pattern for each of the ``most`` documents.
    patterns = voted.groupBy("votes").count().collect()
    votes = np.array([[int(sign) for sign in row["votes"]] for row in patterns], float)
    times = np.array([row["count"] for row in patterns], float)
    model = fit_votes(votes, times, toxic / (toxic + others))
    posterior = model.posterior(votes)
    by_votes = voted.sparkSession.createDataFrame(
        [(row["votes"], float(p)) for row, p in zip(patterns, posterior)], "votes string, p double"
    )
    size = len(lexicon.places)
    zeros = F.array_repeat(F.lit(0.0), size)
    dense = F.transform(zeros, lambda _, i: F.array_contains("hits", i.cast("int")).cast("double"))
    each = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
                             F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    # Documents that found the same entries are one example, weighed by their number.
    examples = (
        voted.join(F.broadcast(by_votes), "votes")
        .groupBy("hits")
        .agg(F.count("*").alias("n"), F.avg("p").alias("p"))
        .select("hits", "n", each.alias("e"))
        .select(array_to_vector(dense).alias("features"), "e.label",
                (F.col("n") * F.col("e.weight")).alias("weight"))
    )
    learner = LogisticRegression(
        maxIter=40, regParam=1e-5, standardization=False, weightCol="weight"
    )
    fitted = learner.fit(stage(examples, "posteriors").where("weight > 0"))
    return Model(lexicon, model, fitted.coefficients.toArray(), float(fitted.intercept))


def score_documents(
    documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, score`` of every row.

    A null text counts as empty, and one of any length is scored whole. Rows without an id and repeated
    rows are scored each, an empty table gives no rows, and other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", model.score(rows).alias("score"))


def keep_clean(
    documents: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows of ``documents``, with their columns as they are, that score under ``threshold``.

    Null texts are judged as empty ones. Repeated rows stay or go together, rows without an id are
    judged by their text, and an empty table gives no rows.
    """
    return documents.where(model.score(documents, text_col) < threshold)
