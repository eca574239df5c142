"""Author network: two authors are linked when books of theirs appeared a few years apart.

An author's years fall into spans: runs whose neighbours are at most ``2 * years + 1`` apart.
Two authors are linked exactly if a span of one lies within ``years`` of a span of the other.
(A gap inside a span is too narrow to hold a year that is further than ``years`` from both of
its ends.) So authors with the same spans have the same neighbours, and what is said of links is
said of the distinct lists of spans, called profiles.

Degrees need no list of links. What a span reaches is an interval of years, and an author without
a year in it has exactly one gap between spans (or before the first, or after the last) around
it: those authors are a count of points that dominate another point. Only profiles of several
spans meet each other one by one.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import fence
from ..functions.spans import REACHED, Spans, reached
from ..sources.staging import stage
from .pairs import blocks, pair_members

# Bounds beyond any year of four digits and what it reaches.
_BEFORE, _AFTER = -100_000, 100_000
_BITS = 18  # of a bound that is counted from ``_BEFORE``
_PART_ROWS = 2048  # profiles of a part; a pair of parts has at most as many links as its square


class Network(NamedTuple):
    """Authors and profiles, as staged by ``author_network``."""

    authors: DataFrame  # author, profile
    profiles: DataFrame  # profile (its number), spans, authors (how many have it)
    years: int  # how far apart linked authors' books may be


def author_network(valid_books: DataFrame, years: int = fixed.INFLUENCE_YEARS) -> Network:
    """Stage the network of ``author, release_year``; the texts are not read again after this."""
    spans = stage(author_spans(valid_books, years), "spans")
    # Numbers hold for one evaluation only, so the table is staged; keys of pairs stay short.
    profiles = stage(
        spans.groupBy("spans")
        .agg(F.count("*").alias("authors"))
        .select(F.monotonically_increasing_id().alias("profile"), "spans", "authors"),
        "profiles",
    )
    authors = spans.join(profiles, "spans").select("author", "profile")
    return Network(stage(authors, "authors"), profiles, years)


def author_spans(valid_books: DataFrame, years: int) -> DataFrame:
    """``author, spans``: one row per author, the spans an array of ``first, last`` years."""
    per_author = (
        valid_books.select("author", "release_year")
        .distinct()
        .groupBy("author")
        .agg(F.sort_array(F.collect_set("release_year")).alias("seen"))
    )
    apart = 2 * years + 1
    ends = fence(
        per_author,
        ["author"],
        firsts=F.filter(
            "seen", lambda y, i: (i == 0) | (y - F.coalesce(F.get("seen", i - 1), y) > apart)
        ),
        lasts=F.filter(
            "seen", lambda y, i: F.coalesce(F.get("seen", i + 1) - y > apart, F.lit(True))
        ),
    )
    spans = F.zip_with(
        "firsts", "lasts", lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    )
    return ends.select("author", spans.alias("spans"))


def linked_profiles(some: DataFrame, profiles: DataFrame, years: int) -> DataFrame:
    """``group_a, group_b``: the profiles within reach of each of ``some``, itself included, each once.

    Both sides are dealt into parts of about ``_PART_ROWS`` profiles, and a pair of parts is a group of
    work, in which a profile takes two look-ups for each of its spans. Profiles of many spans
    meet in many years: a join by year would carry all spans of both to each of those meetings,
    to tell which is their first. Here a pair comes once, so the long list needs no ``distinct``.
    """
    parts_a, parts_b = (max(1, math.ceil(side.count() / _PART_ROWS)) for side in (some, profiles))

    def dealt(side: DataFrame, own: str, parts: int, its: str, others: int) -> DataFrame:
        part = F.pmod(F.xxhash64("profile"), F.lit(parts)).cast("int").alias(own)
        met = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(its)
        held = side.select(part, F.lit(own == "i").alias("left"), "profile", "spans.first", "spans.last")
        return held.select("*", met).select("i", "j", "left", "profile", "first", "last")

    def run(table: pa.Table) -> pa.Table:
        sides = (Spans.of(table.filter(mask)) for mask in (table["left"], pc.invert(table["left"])))
        return reached(*sides, years)

    both = dealt(some, "i", parts_a, "j", parts_b).unionByName(dealt(profiles, "j", parts_b, "i", parts_a))
    # Spread by number: joined small partitions would leave most cores idle.
    groups = min(4 * parts_a * parts_b, 20_000)
    return both.repartition(groups, "i", "j").groupBy("i", "j").applyInArrow(run, REACHED)


def _spans(profiles: DataFrame) -> DataFrame:
    return profiles.select("profile", F.inline("spans"))


def influence_edges(network: Network) -> DataFrame:
    """``author1, author2``: all links, in both directions, each once.

    An author has one profile, so pairs of linked profiles give distinct pairs of authors and
    the long list needs no ``distinct``. For numbers of links use the degrees.
    """
    members = stage(
        blocks(
            network.authors.select(F.col("profile").alias("group"), F.col("author").alias("member"))
        ),
        "members",
    )
    links = linked_profiles(network.profiles, network.profiles, network.years)
    return (
        pair_members(members, members, links)
        .where(F.col("a") != F.col("b"))
        .select(F.col("a").alias("author1"), F.col("b").alias("author2"))
    )


def _below(points: DataFrame, *columns: str) -> DataFrame:
    """``columns``, ``bit`` and ``block``: for each size that is a power of two, the block of ``x``."""
    bits = F.explode(F.sequence(F.lit(0), F.lit(_BITS - 1))).alias("bit")
    block = F.call_function("shiftright", F.col("x") - _BEFORE, F.col("bit")).alias("block")
    return points.select("x", *columns, bits).select("x", *columns, "bit", block)


def year_grid(points: DataFrame, asked: DataFrame) -> DataFrame:
    """``bit, block, y, n``: what points add up to, with a row for every ``y`` that is asked for.

    Its rows are years in blocks of years: a block has at most as many as there are years, however
    many points and queries there are.
    """
    held = _below(points, "y", "n").select("bit", "block", "y", "n")
    return (
        held.unionByName(asked.select("bit", "block", "y", F.lit(0).cast("bigint").alias("n")))
        .groupBy("bit", "block", "y")
        .agg(F.sum("n").alias("n"))
    )


def dominated(points: DataFrame, queries: DataFrame) -> DataFrame:
    """``key, total``: of every query, the sum of ``n`` over points ``x < x`` and ``y > y`` of its own.

    ``points`` are ``x, y, n``, ``queries`` are ``key, x, y``. A point belongs to one block of
    numbers of every size that is a power of two; the numbers below a query's are a few whole
    blocks, one for each of its bits. Within a block, sums run over the years of ``year_grid``, from
    the latest on; a query looks its own up there. Queries are answered once for all that ask the
    same, and those of one key are added up. A key without such points has no row.
    """
    odd = F.col("block").bitwiseAND(F.lit(1)) == 1
    asked = _below(queries.select("x", "y").distinct(), "y").where(odd)
    asked = stage(asked.withColumn("block", F.col("block") - 1), "asked")
    later = Window.partitionBy("bit", "block").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, -1)
    sums = year_grid(points, asked).select("bit", "block", "y", F.sum("n").over(later).alias("later"))
    answers = asked.join(sums, ["bit", "block", "y"]).groupBy("x", "y").agg(F.sum("later").alias("total"))
    found = queries.join(answers.where(F.col("total") > 0), ["x", "y"])
    return found.groupBy("key").agg(F.sum("total").alias("total"))


def _gaps(before: Column, after: Column) -> Column:
    """The gaps around and between spans: ``x`` ends what is before, ``y`` starts what is after."""
    firsts = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.lit(_AFTER)))
    lasts = F.concat(F.array(F.lit(_BEFORE)), F.transform("spans", lambda s: s["last"]))
    return F.zip_with(
        lasts, firsts, lambda x, y: F.struct((x + before).alias("x"), (y - after).alias("y"))
    )


def _profile_degrees(network: Network) -> DataFrame:
    """``profile, authors, degree``: number of links of each author with that profile."""
    profiles, years = network.profiles, network.years
    single = profiles.where(F.size("spans") == 1)
    several = profiles.where(F.size("spans") > 1)
    everyone = profiles.agg(F.coalesce(F.sum("authors"), F.lit(0))).scalar()
    one_span = single.agg(F.coalesce(F.sum("authors"), F.lit(0))).scalar()

    # An author with one span is linked to all that have no gap around what the span reaches.
    around = profiles.select(F.inline(_gaps(F.lit(0), F.lit(0))), F.col("authors").alias("n"))
    reached = _spans(single).select(
        F.col("profile").alias("key"),
        (F.col("first") - years).alias("x"),
        (F.col("last") + years).alias("y"),
    )
    unlinked = dominated(around, reached)
    of_single = single.join(unlinked, single["profile"] == unlinked["key"], "left").select(
        "profile", "authors", (everyone - F.coalesce("total", F.lit(0)) - 1).alias("degree")
    )

    # An author with several is linked to all of one span, but for those inside a gap of what the
    # spans reach, and to the profiles of several that are found to be within reach.
    inside = several.select(
        F.col("profile").alias("key"), F.inline(_gaps(F.lit(years), F.lit(years)))
    )
    # first > x and last < y, turned round: -first < -x and -last > -y.
    turned = _spans(single).join(single.select("profile", "authors"), "profile").select(
        (-F.col("first")).alias("x"), (-F.col("last")).alias("y"), F.col("authors").alias("n")
    )
    within = dominated(
        turned.groupBy("x", "y").agg(F.sum("n").alias("n")),
        inside.select("key", (-F.col("x")).alias("x"), (-F.col("y")).alias("y")),
    )
    met = linked_profiles(several, several, years)
    sizes = several.select(F.col("profile").alias("group_b"), F.col("authors").alias("others"))
    of_others = met.join(sizes, "group_b").groupBy("group_a").agg(F.sum("others").alias("others"))
    of_several = (
        several.join(of_others, several["profile"] == of_others["group_a"])
        .join(within, several["profile"] == within["key"], "left")
        .select(
            "profile",
            "authors",
            (one_span - F.coalesce("total", F.lit(0)) + F.col("others") - 1).alias("degree"),
        )
    )
    return of_single.unionByName(of_several).where(F.col("degree") > 0)


def out_degree(network: Network) -> DataFrame:
    """``author, degree``: number of authors each author links to; linked authors only."""
    degrees = _profile_degrees(network).select("profile", "degree")
    return network.authors.join(degrees, "profile").select("author", "degree")


def in_degree(network: Network) -> DataFrame:
    """``author, degree``: number of authors linking to each; links go both ways, so as above."""
    return out_degree(network)


def edge_count(network: Network) -> DataFrame:
    """Number of links, as the sum of degrees."""
    total = F.coalesce(F.sum(F.col("degree") * F.col("authors")), F.lit(0))
    return _profile_degrees(network).agg(total.alias("total_edges"))


def authors_by_year(network: Network) -> DataFrame:
    """``year, least, greatest``: the first and last name of the authors with a span over each year.

    At most one row for each year of four digits. That is enough to tell whether a year has an
    author other than a given one, which is all that it takes to know that someone is linked.
    """
    named = network.authors.groupBy("profile").agg(F.min("author").alias("least"), F.max("author").alias("greatest"))
    year = F.explode(F.sequence("first", "last")).alias("year")
    covered = named.join(network.profiles, "profile").select("least", "greatest", F.inline("spans"))
    return covered.select("least", "greatest", year).groupBy("year").agg(
        F.min("least").alias("least"), F.max("greatest").alias("greatest")
    )


def first_linked(network: Network, rows: int) -> DataFrame:
    """``author, profile, spans`` of the first ``rows`` authors by name that have a link, staged.

    Authors are probed in the order of names, ever more of them, until there are enough; a probe
    asks for the existence of a link and counts none.
    """
    years = stage(authors_by_year(network), "by_year")
    probed = 8 * rows
    while True:
        some = stage(network.authors.orderBy("author").limit(probed), "probe")
        reach = F.explode(F.sequence(F.col("first") - network.years, F.col("last") + network.years))
        spans = some.join(network.profiles, "profile")
        met = spans.select("author", F.inline("spans")).select("author", reach.alias("year")).join(years, "year")
        other = (F.col("least") != F.col("author")) | (F.col("greatest") != F.col("author"))
        linked = spans.join(met.where(other).select("author").distinct(), "author", "left_semi")
        found = stage(linked.orderBy("author").limit(rows), "first")
        if found.count() == rows or some.count() < probed:
            return found
        probed *= 16


def edge_sample(network: Network, rows: int = 10) -> DataFrame:
    """The first ``rows`` links by author names.

    They start at the first ``rows`` authors that have a link at all, so only those meet the others:
    in the years that they reach, at most ten thousand for each.
    """
    starts = first_linked(network, rows)
    reach = F.explode(F.sequence(F.col("first") - network.years, F.col("last") + network.years)).alias("year")
    starts = starts.select(F.col("author").alias("author1"), F.inline("spans")).select("author1", reach)
    held = network.profiles.select("profile", F.inline("spans"))
    held = held.select("profile", F.explode(F.sequence("first", "last")).alias("year"))
    met = held.join(starts, "year").select("author1", "profile").distinct()
    return (
        met.join(network.authors.select(F.col("author").alias("author2"), "profile"), "profile")
        .where(F.col("author1") != F.col("author2"))
        .select("author1", "author2")
        .orderBy("author1", "author2")
        .limit(rows)
    )


def top_degree(degrees: DataFrame, rows: int = 5) -> DataFrame:
    """The authors with the most links, equal degrees by name."""
    return degrees.orderBy(F.desc("degree"), "author").limit(rows)
