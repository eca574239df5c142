"""The same weights by MLlib's stages, which the operators are held against."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    Normalizer,
    StopWordsRemover,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.functions import fixed
from bookloom.functions.columns import body_tokens
from bookloom.operators.terms import MARKERS


def token_arrays(books: DataFrame, markers: tuple[str, str] = MARKERS) -> DataFrame:
    """``file_name, words``: the cleaned words of every book in order, stop words included."""
    return books.select("file_name", body_tokens(F.col("text"), markers).alias("words"))


def fit_vectors(
    words: DataFrame,
    vocabulary: list[str] | None = None,
    size: int = fixed.VOCABULARY_SIZE,
    min_books: int = fixed.MIN_BOOKS_PER_TERM,
) -> PipelineModel:
    """Fit the stages from words to ``units``.

    MLlib breaks ties at the end of the vocabulary arbitrarily; pass the terms of
    ``terms.vocabulary`` (at most ``size``) for a fixed choice and to save one pass.
    """
    remover = StopWordsRemover(
        inputCol="words", outputCol="kept", stopWords=list(fixed.STOP_WORDS)
    )
    filtered = remover.transform(words)
    if vocabulary is None:
        counter = CountVectorizer(
            inputCol="kept", outputCol="counts", vocabSize=size, minDF=min_books
        ).fit(filtered)
    else:
        counter = CountVectorizerModel.from_vocabulary(
            vocabulary, inputCol="kept", outputCol="counts"
        )
    idf = IDF(inputCol="counts", outputCol="weights").fit(counter.transform(filtered))
    unit = Normalizer(inputCol="weights", outputCol="units")
    return PipelineModel([remover, counter, idf, unit])
