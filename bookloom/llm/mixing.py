"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of source, language and topic. Starting from the cells' own tokens, the
weights are scaled to the target share of every source, then language, then topic, again and
again until all three hold. Only factors are kept: a cell's weight is its tokens times the factors
of its source, language and topic. A cell's weight over its tokens gives the probability with
which each of its documents is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import numbered
from ..sources.staging import stage
from .process import once_per_process, slices

TOPICS = 8
TOPIC_ROUNDS = 20  # of k-means over all documents, at most
STILL = 1e-4  # centres that move no further have come to rest
WIDTH = 256  # of the hashed word counts that topics are made of
TEMPER = 0.7  # default targets: shares of tokens to this power
FRACTION = 0.5  # of all tokens that a sample should have
TOLERANCE = 1e-3  # of a margin's share, relative
STALLED = 20  # rounds in which the worst margin comes no nearer: no weights have these margins
INNER = 200  # rounds over the margins other than the first, for each round over all
TABLE = 4_000_000  # languages times topics, at most: their sums are added up on the driver
_KEPT = 150_000
_UNIT = 1 << 24  # profiles are summed in whole numbers: the sums do not depend on the order
MARGINS = ("source", "lang", "topic")


class _Places(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "replace")) % WIDTH
        return value


def word_counts(text: str | None) -> np.ndarray:
    """The hashed counts of the words."""
    places = once_per_process("topic_places", _Places)
    words = (text or "").split()
    at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    return np.bincount(at, minlength=WIDTH)


def profiles(counts: np.ndarray) -> np.ndarray:
    """Rows of counts, damped and scaled to length 1."""
    return np.sqrt(counts / np.maximum(counts.sum(-1, keepdims=True), 1))


def word_profile(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words, and the profile of the words."""
    counts = word_counts(text)
    return int(counts.sum()), profiles(counts)


class Topics(NamedTuple):
    centres: np.ndarray

    def of(self, counts: Column) -> Column:
        """``topic`` and ``tokens`` (words) of a text from its ``counted`` words, as a struct."""
        centres, half = self.centres, (self.centres**2).sum(1) / 2

        @F.arrow_udf("topic int, tokens bigint")
        def describe(counts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in counts:
                topics, tokens = [np.zeros(0, int)], [np.zeros(0, int)]
                for at in range(0, len(part), 1024):
                    held = _unpacked(part.slice(at, 1024).to_pylist())
                    topics.append((profiles(held.astype(float)) @ centres.T - half).argmax(1))
                    tokens.append(held.sum(1, dtype=np.int64))
                topics, tokens = np.concatenate(topics), np.concatenate(tokens)
                yield pa.StructArray.from_arrays(
                    [pa.array(topics, pa.int32()), pa.array(tokens, pa.int64())], ["topic", "tokens"]
                )

        return describe(counts)


def _unpacked(counts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(counts), "<u4").reshape(-1, WIDTH)


def counted(documents: DataFrame, id_col: str, text_col: str, kept: Column) -> DataFrame:
    """Staged ``row, place, counts, source, lang``: what is ``kept`` of each document and its hashed words.

    This is the one pass over the texts: topics, tokens and samples are made from it.
    """

    @F.arrow_udf("binary")
    def packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            rows = [word_counts(text).astype("<u4").tobytes() for some in slices(part) for text in some]
            yield pa.array(rows, pa.binary())

    rows = documents.select(
        kept.alias("row"), F.xxhash64(F.col(id_col), F.lit(41)).alias("place"), packed(F.col(text_col)).alias("counts"),
        _margin("source").alias("source"), _margin("lang").alias("lang"),
    )
    return stage(rows, "counted")


def fit_topics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", topics: int = TOPICS) -> Topics:
    """The topics of ``documents``, see ``fit_topics_of``."""
    return fit_topics_of(counted(documents, id_col, text_col, F.lit(None).cast("int")), topics)


def fit_topics_of(counts: DataFrame, topics: int = TOPICS) -> Topics:
    """Topics are clusters (k-means) of the word profiles of all documents (see ``counted``).

    A round is one pass over the staged counts: each task adds up the profiles nearest to each
    centre. The first centres are drawn as k-means++ does, with chances that depend on ids alone.
    Fewer distinct profiles give fewer topics, an empty table one at the origin.
    """
    counts = counts.select("place", F.col("counts").alias("x"))

    def parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column(1).to_pylist()
                yield part.column(0).to_numpy(), raw, profiles(_unpacked(raw).astype(float))

    def draw(centres: np.ndarray) -> np.ndarray | None:
        """The profile drawn with a chance in proportion to its squared distance from the centres."""

        def first(batches):
            best = None
            for places, raw, points in parts(batches):
                if len(centres):
                    far = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
                    far = far.min(1)
                else:
                    far = np.ones(len(points))
                mixed = (places.astype(np.uint64) * np.uint64(2 * len(centres) + 0x9E3779B97F4A7C15)) >> np.uint64(11)
                # The first of exponential waits whose rates are the distances.
                wait = -np.log((mixed + 0.5) * 2.0**-53) / np.maximum(far, 1e-300)
                wait[far < 1e-9] = np.inf
                found = [(wait[i], raw[i]) for i in np.flatnonzero(wait == wait.min()) if wait[i] < np.inf]
                best = min(found + [best] * (best is not None), default=None)
            if best is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(best[0])]), pa.array([best[1]], pa.binary())], ["wait", "x"]
                )

        drawn = counts.mapInArrow(first, "wait double, x binary").agg(F.min(F.struct("wait", "x")).alias("best"))
        best = drawn.first()["best"]
        return None if best is None else profiles(np.frombuffer(best["x"], "<u4").astype(float))

    centres = np.zeros((0, WIDTH))
    while len(centres) < topics and (point := draw(centres)) is not None:
        centres = np.vstack([centres, point])
    if not len(centres):
        return Topics(np.zeros((1, WIDTH)))

    def means(centres: np.ndarray) -> np.ndarray:
        def add(batches):
            sums = np.zeros((len(centres), WIDTH + 1), np.int64)
            half = (centres**2).sum(1) / 2
            for _, _, points in parts(batches):
                near = (points @ centres.T - half).argmax(1)
                whole = np.rint(points * _UNIT).astype(np.int64)
                for i in np.unique(near):
                    sums[i, :WIDTH] += whole[near == i].sum(0)
                    sums[i, WIDTH] += (near == i).sum()
            centre, place = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(centre), pa.array(place), pa.array(sums[centre, place])], ["centre", "place", "n"]
            )

        found = counts.mapInArrow(add, "centre bigint, place bigint, n bigint")
        sums = np.zeros((len(centres), WIDTH + 1))
        for row in found.groupBy("centre", "place").agg(F.sum("n").alias("n")).collect():
            sums[row["centre"], row["place"]] = row["n"]
        rows = sums[:, WIDTH:]
        return np.where(rows > 0, sums[:, :WIDTH] / _UNIT / np.maximum(rows, 1), centres)

    for _ in range(TOPIC_ROUNDS):
        before, centres = centres, means(centres)
        if ((centres - before) ** 2).sum(1).max() <= STILL**2:
            break
    return Topics(centres)


def tempered(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """``margin, share``: shares of tokens to the power ``temper``, scaled to 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > 0)
    power = F.pow(F.col("tokens").cast("double"), F.lit(temper))
    return sums.select(margin, (power / sums.agg(F.sum(power)).scalar()).alias("share"))


class Raked(NamedTuple):
    """What ``rake`` returns."""

    cells: DataFrame  # the margins' columns, tokens, weight
    deviation: float  # of a margin from its target, relative, at most
    rounds: int
    moved: bool  # no weights have the default targets: they were moved to margins that some have


def _numbers(cells: DataFrame, margin: str, target: DataFrame) -> DataFrame:
    """``margin, share, number``: the target's values that have cells, their shares scaled to 1."""
    present = cells.select(margin).distinct()
    known = target.where(F.col("share") > 0).select(margin, F.col("share").cast("double").alias("share"))
    known = numbered(known.join(present, margin), [margin])
    total = known.agg(F.sum("share")).first()[0] or 1.0
    return known.withColumn("share", F.col("share") / total)


class _Table(NamedTuple):
    """The cells by the values of the first margin, and the table of the other margins.

    ``rows`` has ``share, places, tokens`` for each value: its cells as places in the table.
    """

    rows: DataFrame
    shares: list[np.ndarray]  # of the other margins

    def steps(self, factors: list[np.ndarray]) -> list[np.ndarray]:
        """The table after the first margin's step with ``factors``, and after each other step in turn."""
        scaled = _outer(factors).ravel()

        def add(batches):
            table = np.zeros(scaled.size, np.int64)
            for weights, places in _weighed(batches, scaled):
                np.add.at(table, places, np.rint(weights * _WHOLE).astype(np.int64))
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["place", "n"])

        sums = self.rows.mapInArrow(add, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(scaled.size)
        table[sums["place"].to_numpy()] = sums["n"].to_numpy() / _WHOLE
        found = [table.reshape([len(share) for share in self.shares])]
        for axis, by in enumerate(self.scales(found[0])):
            found.append(found[-1] * _along(by, axis, len(self.shares)))
        return found

    def scales(self, table: np.ndarray) -> list[np.ndarray]:
        """By what each margin of the table is scaled, one after the other."""
        found = []
        for axis, share in enumerate(self.shares):
            sums = _sums(table, axis)
            found.append(np.divide(share, sums, out=np.zeros_like(sums), where=sums > 0))
            table = table * _along(found[-1], axis, len(self.shares))
        return found


    def settled(self, table: np.ndarray, tolerance: float) -> list[np.ndarray]:
        """By what the margins of the table are scaled until they hold together, or nearly.

        The table is small, so these rounds cost nothing; the values of the first margin see one. They
        end early where they bring the margins no nearer.
        """
        total, last = [np.ones(len(share)) for share in self.shares], np.inf
        for _ in range(INNER):
            found = self.scales(table)
            total = [by * more for by, more in zip(total, found)]
            for axis, by in enumerate(found):
                table = table * _along(by, axis, len(self.shares))
            off = [np.abs(_sums(table, axis) - share) / np.maximum(share, 1e-300) for axis, share in enumerate(self.shares)]
            worst = max((one.max() for one in off), default=0.0)
            if worst <= tolerance or worst > 0.999 * last:
                break
            last = worst
        return total


_WHOLE = float(1 << 60)  # weights are summed in whole numbers: the sums do not depend on the order


def _outer(factors: list[np.ndarray]) -> np.ndarray:
    whole = np.ones(())
    for factor in factors:
        whole = np.multiply.outer(whole, factor)
    return whole


def _along(values: np.ndarray, axis: int, axes: int) -> np.ndarray:
    return values.reshape([-1 if i == axis else 1 for i in range(axes)])


def _sums(table: np.ndarray, axis: int) -> np.ndarray:
    return table.sum(tuple(i for i in range(table.ndim) if i != axis))


def _weighed(batches, scaled: np.ndarray):
    """Weights and places of the cells of each batch, every row's scaled to its share."""
    for batch in batches:
        owner = np.repeat(np.arange(len(batch)), np.diff(batch["places"].offsets.to_numpy()))
        places = batch["places"].flatten().to_numpy()
        weights = batch["tokens"].flatten().to_numpy() * scaled[places]
        sums = np.bincount(owner, weights, len(batch))
        share = batch["share"].to_numpy()
        yield weights * np.divide(share, sums, out=np.zeros_like(sums), where=sums > 0)[owner], places


def _moved(table: _Table, factors: list[np.ndarray], fixed: list[int]) -> _Table:
    """The margins that the steps of a round have on average, or after the step of the ``fixed`` one."""
    steps, now = table.steps(factors), list(factors)
    scaled = [_outer(now).ravel()]  # the factors after each step
    for axis, by in enumerate(table.scales(steps[0])):
        now[axis] = now[axis] * by
        scaled.append(_outer(now).ravel())
    base = scaled[0]
    if fixed:
        steps, scaled = [steps[fixed[0]]], [scaled[fixed[0]]]
    inner = [np.mean([_sums(step, axis) for step in steps], axis=0) for axis in range(len(table.shares))]

    def shares(batches):
        for batch in batches:
            sums = np.diff(batch["places"].offsets.to_numpy())
            owner, places = np.repeat(np.arange(len(batch)), sums), batch["places"].flatten().to_numpy()
            tokens = batch["tokens"].flatten().to_numpy()
            first = np.bincount(owner, tokens * base[places], len(batch))
            ratios = [np.bincount(owner, tokens * after[places], len(batch)) / first for after in scaled]
            share = pa.array(batch["share"].to_numpy() * np.mean(ratios, axis=0))
            columns = [share if name == "share" else batch[name] for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return _Table(stage(table.rows.mapInArrow(shares, table.rows.schema), "moved"), inner)


def rake(
    cells: DataFrame, targets: Mapping[str, DataFrame], fixed: Sequence[str] = (), tolerance: float = TOLERANCE
) -> Raked:
    """``cells`` (the margins' columns, ``tokens``) with ``weight``, which sums to 1.

    ``targets`` gives for each margin a table of its values and their ``share``. Values without a
    target or with none above 0 get weight 0, and targets of values without cells are shared out
    among the others. A round is one job over the values of the first margin, which may be many,
    with their cells; only the table of the other margins (``TABLE`` places at most, else a
    ValueError) and its factors pass through the driver. Rounds go on until every margin is within
    ``tolerance`` of its target. Where no weights have all margins, those that are not ``fixed``
    are moved to what the rounds give on average, which some weights do have; with two or more fixed
    ones a ValueError says how far they are off.
    """
    cells = cells.where(F.col("tokens") > 0)
    first, *others = targets
    total = cells.agg(F.sum("tokens")).first()[0]
    names = [_numbers(cells, name, targets[name]) for name in targets]
    shares = [np.array([r["share"] for r in known.orderBy("number").collect()]) for known in names[1:]]
    size = int(np.prod([len(share) for share in shares]))
    if size > TABLE:
        raise ValueError(f"the margins {others} have {size} combinations of values, more than {TABLE}")
    place, rows = F.lit(0).cast("bigint"), cells
    for name, known, share in zip(others, names[1:], shares):
        rows = rows.join(known.select(name, F.col("number").alias(f"_at{name}")), name)
        place = place * len(share) + F.col(f"_at{name}")
    cell = F.struct(place.alias("place"), (F.col("tokens") / F.lit(float(total or 1))).alias("tokens"))
    rows = rows.groupBy(first).agg(F.sort_array(F.collect_list(cell)).alias("_cells")).join(names[0], first)
    # A value none of whose cells can have weight has no share either.
    rows = stage(rows.select(first, "share", F.col("_cells.place").alias("places"), F.col("_cells.tokens").alias("tokens")), "raked")
    able = rows.agg(F.sum("share")).first()[0] or 1.0
    table = _Table(rows.withColumn("share", F.col("share") / able), shares)
    factors, moved, history, best = [np.ones(len(share)) for share in shares], False, [], 0
    while size and total:
        now = table.steps(factors)[0]
        off = [np.abs(_sums(now, axis) - share) / np.maximum(share, 1e-300) for axis, share in enumerate(table.shares)]
        history.append(float(max((one.max() for one in off), default=0.0)))
        if history[-1] <= tolerance:
            break
        best = len(history) - 1 if history[-1] < 0.99 * history[best] else best
        if len(history) - 1 - best < STALLED:
            factors = [factor * by for factor, by in zip(factors, table.settled(now, tolerance / 10))]
            factors = [factor / (factor.max() or 1.0) for factor in factors]  # only their ratios count
            continue
        if len(fixed) > 1:
            raise ValueError(f"no weights of these cells have these margins: they are {history[-1]:.2g} off, relative")
        table = _moved(table, factors, [list(targets).index(name) for name in fixed])
        moved, best = True, len(history)
        history.append(np.inf)
    scaled = _outer(factors).ravel()

    def weigh(batches):
        for batch in batches:
            for weights, places in _weighed([batch], scaled):
                offsets = batch["places"].offsets
                columns = [batch[first], *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (places, weights))]
                yield pa.RecordBatch.from_arrays(columns, [first, "places", "weights"])

    kind = table.rows.schema[first].dataType.simpleString()
    weighed = table.rows.mapInArrow(weigh, f"`{first}` {kind}, places array<bigint>, weights array<double>")
    weighed = weighed.select(first, F.explode(F.arrays_zip("places", "weights")).alias("_cell"))
    weighed = weighed.select(first, F.col("_cell.places").alias("_place"), F.col("_cell.weights").alias("weight"))
    for name, known, share in reversed(list(zip(others, names[1:], shares))):
        own = known.select(name, F.col("number").alias("_at"))
        weighed = weighed.withColumn("_at", F.pmod("_place", F.lit(len(share)))).join(own, "_at").drop("_at")
        weighed = weighed.withColumn("_place", F.floor(F.col("_place") / len(share)))
    joined = cells.join(weighed.drop("_place"), list(targets), "left")
    found = stage(joined.withColumn("weight", F.coalesce("weight", F.lit(0.0))), "weights")
    return Raked(found, history[-1] if history else 0.0, len(history), moved)


def probabilities(raked: DataFrame, budget: float) -> DataFrame:
    """``raked`` with ``probability``: the share of a cell's tokens to sample, at most 1.

    What cells with too few tokens cannot give is spread over the others, in proportion to their
    weights, until the expected tokens are the ``budget`` or every cell with weight gives all.
    """
    want = F.col("weight") * F.lit(float(budget)) / F.col("tokens")
    scale, more = 1.0, True
    while more:
        full = want * scale >= 1
        given, open_ = raked.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        left = budget - (given or 0)
        next_ = left / (budget * open_) if open_ and left > 0 else scale
        more = next_ > scale * (1 + 1e-9)
        scale = max(scale, next_)
    return raked.withColumn("probability", F.least(want * scale, F.lit(1.0)))


def _margin(name: str) -> Column:
    """A margin's value as text; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def _chance(id_col: Column) -> Column:
    """A number in 0 … 1 that depends on the id alone; an id is always sampled alike."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(97)), 11) * F.lit(2.0**-53)


def plan(
    described: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    fraction: float = FRACTION,
) -> DataFrame:
    """``source, lang, topic, weight, probability`` for the cells of ``described`` (and ``tokens``)."""
    cells = stage(described.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    given = {name: target.withColumnRenamed(f"_{name}", name) for name, target in (targets or {}).items()}
    raked = rake(cells, {name: given.get(name) or tempered(cells, name) for name in MARGINS}, list(given))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    return probabilities(raked.cells, fraction * total).select(*MARGINS, "weight", "probability")


def _described(rows: DataFrame) -> DataFrame:
    """``row, source, lang, topic, tokens`` of ``counted`` documents."""
    found = rows.withColumn("about", fit_topics_of(rows).of(F.col("counts")))
    return found.select("row", "source", "lang", "about.topic", "about.tokens")


def mix(
    documents: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    fraction: float = FRACTION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, weight, probability, selected`` of every row.

    ``weight`` is the raked share of the document's cell. Default targets are tempered shares, see
    ``TEMPER``; given ones have a column ``_source``, ``_lang`` or ``_topic`` and ``share``, where
    a text value is preceded by ``=``. Documents without words have probability 0: they hold no
    tokens to sample. Null sources and languages are values of their own; an empty table gives no
    rows; other columns are ignored.
    """
    kept = F.struct(F.col(id_col).cast("bigint").alias("doc_id"), "source", "lang")
    described = stage(_described(counted(documents, id_col, text_col, kept)), "described")
    joined = described.join(stage(plan(described, targets, fraction), "chances"), list(MARGINS), "left")
    chance = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return joined.select(
        "row.doc_id", "row.source", "row.lang", "topic", "tokens",
        F.coalesce("weight", F.lit(0.0)).alias("weight"), chance.alias("probability"),
        (_chance(F.col("row.doc_id")) < chance).alias("selected"),
    )


def sample(
    documents: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    fraction: float = FRACTION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The sampled rows of ``documents``, with their columns as they are (see ``mix``).

    The texts are read once: the rows are staged with their hashed words, from which topics, cells
    and sample are made. Only a join with a table of cells too large to broadcast shuffles them.
    """
    rows = counted(documents, id_col, text_col, F.struct(*[F.col(f"`{name}`") for name in documents.columns]))
    described = _described(rows)
    chances = stage(plan(described, targets, fraction), "chances")
    chosen = described.join(chances, list(MARGINS))
    own = F.col("row").getField(id_col).cast("bigint")
    kept = chosen.where((F.col("tokens") > 0) & (_chance(own) < F.col("probability")))
    return kept.select(*[F.col("row").getField(name).alias(name) for name in documents.columns])
