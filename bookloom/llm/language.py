"""Language of web pages by Bayesian fusion of evidence.

The likelihood of a page's text in each language meets two other kinds of evidence: the language
that the markup declares, as reliable as declarations turn out to be over all pages, and where
the page comes from. Its address gives a prior that is smoothed from all pages to the suffix, to
the registered domain, to the host, by sums of the pages' own posteriors.
"""

from __future__ import annotations

import html as markup
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .process import once_per_process
from .url_reputation import LONG_SUFFIXES, domain_of, host_and_path, suffix_of

SAMPLE_ROWS = 6000  # documents of each language that the text model is fitted on, about
WIDTH = 8192  # of the hashed words and endings
TEMPER = 0.5  # words of a text are not independent; their evidence counts by this much
STRENGTH = 5.0  # pages that a prior counts for, at every level
_SALTS = 16
_KEPT = 150_000

_HIDDEN = re.compile(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)")
_LETTERS = re.compile(r"[^\W\d_]+")


def visible_text(html: str | None) -> str:
    return markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html or "")))


def declared_language(html: str | None) -> str | None:
    """The primary tag of ``<html lang=…>``, lower case."""
    found = _DECLARED.search(html or "")
    return found[1].lower() if found else None


class _Features(dict):
    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= _KEPT:
            self.clear()
        place = lambda s: xxhash.xxh32_intdigest(s.encode("utf-8", "replace")) % WIDTH
        value = self[word] = (place(word), place("~" + word[-3:]))
        return value


def feature_counts(text: str) -> np.ndarray:
    """Hashed counts of the words and of their last three letters."""
    known = once_per_process("language_features", _Features)
    words = _LETTERS.findall(text.lower())
    places = np.array([known[w] for w in words], np.int64).ravel()
    return np.bincount(places, minlength=WIDTH)


class TextModel(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # a row for each language

    def likelihoods(self, text: str) -> np.ndarray:
        """Tempered log likelihoods, the largest of them 0."""
        raw = TEMPER * (self.logs @ feature_counts(text))
        return raw - raw.max(initial=-np.inf) if len(raw) else raw


def fit_text(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> TextModel:
    """Learn word likelihoods of every language that a document with a text has.

    Of a language at most about ``SAMPLE_ROWS`` documents are read, by a hash of id and text.
    Documents without a language or a text are not used, an empty text says nothing, and repeated
    rows are read or left together. An empty table gives a model of no language.
    """
    known = documents.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(53)), F.lit(1 << 30)).alias("order"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A row for each language; languages of at most SAMPLE_ROWS documents are read whole.
    share = F.lit(float(SAMPLE_ROWS)) / F.count("*")
    shares = known.groupBy("lang").agg(F.ceil(share * (1 << 30)).alias("below"))
    rows = known.join(F.broadcast(shares), "lang").where("order < below").select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Shares, not counts: a long text is one example too.
                counts = feature_counts(text)
                counts = counts / max(counts.sum(), 1)
                sums[lang] = sums.get(lang, 0) + counts
        for lang, counts in sums.items():
            places = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(places)), pa.array(places), pa.array(counts[places])],
                ["lang", "place", "n"],
            )

    sums = stage(
        rows.mapInArrow(count, "lang string, place bigint, n double")
        .groupBy("lang", "place").agg(F.sum("n").alias("n")), "words",
    )
    languages = sorted(row["lang"] for row in sums.select("lang").distinct().collect())
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), WIDTH))
    for row in sums.toLocalIterator():
        counts[at[row["lang"]], row["place"]] = row["n"]
    shares = counts / np.maximum(counts.sum(1, keepdims=True), 1e-12)
    return TextModel(languages, np.log(0.98 * shares + 0.02 / WIDTH))


def _normalized(name: str, size: int) -> Column:
    """The exponentials of an array of logarithms, scaled to 1."""
    top = F.array_max(name)
    powers = F.transform(name, lambda x: F.exp(x - top))
    whole = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / whole)


def _sums(size: int, name: str = "p") -> Column:
    return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)])


def _smoothed(sums: str, prior: str) -> Column:
    """Posterior means of a Dirichlet prior of ``STRENGTH`` pages."""
    whole = F.aggregate(sums, F.lit(0.0), lambda s, x: s + x) + STRENGTH
    return F.transform(
        F.arrays_zip(F.col(sums).alias("n"), F.col(prior).alias("m")),
        lambda z: (z["n"] + STRENGTH * z["m"]) / whole,
    )


def identify(
    pages: DataFrame,
    model: TextModel,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, lang, confidence, text_lang, declared, host`` of every row of ``pages``.

    ``lang`` has the largest posterior, ``confidence`` is that posterior; ``text_lang`` is what
    the text alone says, null without words. Equal posteriors go to the language that comes
    first by name. A null page has no text and no declaration, a null URL the host "": both are
    judged by what is left. With a model of no language ``lang`` is null. Repeated rows are
    judged each, and an empty table gives no rows; other columns are ignored.
    """
    languages, size = model.languages, len(model.languages)
    host = host_and_path(F.col(url_col))[0]
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.col(html_col).alias("html"))
    if not size:
        none = F.lit(None).cast("string")
        return rows.select(
            "page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"),
            none.alias("text_lang"), none.alias("declared"), "host",
        )

    def read(batches):
        for batch in batches:
            found = [(declared_language(x), model.likelihoods(visible_text(x)))
                     for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"),
                 pa.array([d for d, _ in found], pa.string()),
                 pa.array([list(l) for _, l in found], pa.list_(pa.float64()))],
                ["page_id", "host", "declared", "logs"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    read_rows = rows.mapInArrow(
        read, f"page_id {kind}, host string, declared string, logs array<double>"
    )
    said = F.when(F.col("declared").isin(*languages), F.col("declared"))
    said = F.coalesce(said, F.when(F.col("declared").isNotNull(), "other"), F.lit("none"))
    texts = stage(
        read_rows.withColumn("said", said).withColumn("p", _normalized("logs", size)), "texts"
    )

    # How often each declaration stands on pages of each language: at most size + 2 rows.
    table = {row["said"]: row["n"] for row in texts.groupBy("said").agg(_sums(size).alias("n")).collect()}
    kinds = [*languages, "other", "none"]
    counts = np.array([table.get(kind) or [0.0] * size for kind in kinds]) + 0.5
    declared = np.log(counts / counts.sum(0))
    by_kind = pages.sparkSession.createDataFrame(
        [(kind, row.tolist()) for kind, row in zip(kinds, declared)], "said string, said_log array<double>"
    )

    hosts = texts.groupBy("host").agg(_sums(size).alias("n"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), LONG_SUFFIXES))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), LONG_SUFFIXES))
    domains = hosts.groupBy("domain", "suffix").agg(_sums(size, "n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(_sums(size, "n").alias("n"))
    everything = suffixes.agg(_sums(size, "n").alias("n")).first()["n"]
    whole = np.array([x or 0.0 for x in everything]) + 1.0
    first = F.array(*map(F.lit, (whole / whole.sum()).tolist()))
    by_suffix = suffixes.withColumn("m", first).select("suffix", _smoothed("n", "m").alias("m"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", _smoothed("n", "m").alias("m"))
    # A host may hold a third of all pages: the pages are dealt over copies of its one row.
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    by_host = hosts.join(by_domain, "domain").select("host", "n", "m", salts.alias("salt"))
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    # A page's own posterior is taken out of its host's sums: it is not evidence of itself.
    others = F.zip_with("n", "p", lambda n, p: F.greatest(n - p, F.lit(0.0)))
    fused = (
        salted.join(by_host, ["host", "salt"])
        .join(F.broadcast(by_kind), "said")
        .withColumn("others", others)
        .withColumn("prior", _smoothed("others", "m"))
        .withColumn("logs", F.transform(
            F.arrays_zip("logs", "prior", "said_log"),
            lambda z: z["logs"] + F.log(z["prior"]) + z["said_log"]))
        .withColumn("q", _normalized("logs", size))
    )
    names = F.array(*map(F.lit, languages))
    best = lambda name: F.array_position(name, F.array_max(name))
    spoke = F.array_max("p") > F.array_min("p") if size > 1 else F.lit(True)
    return fused.select(
        "page_id",
        F.element_at(names, best("q").cast("int")).alias("lang"),
        F.array_max("q").alias("confidence"),
        F.when(spoke, F.element_at(names, best("p").cast("int"))).alias("text_lang"),
        "declared",
        "host",
    )
