"""A manifest of a collection: a Merkle tree over each group's rows, and one over the groups.

A leaf's place is its rank by id within its group. Ids are not sorted for that: each group keeps
a bitmap of its ids as words of 64 bits, absent where no bit is set, which tasks build by
themselves and merge by OR. A directory of running counts says how many rows come before a word,
and a rank is that plus the bits below the id's own. Nodes are then reduced eight at a time: a
node's place names its parent and its slot there, so a level is one grouping by parent.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import numbered, sums_before
from ..sources.staging import stage

FAN = 8  # children of a node
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_ID = -(1 << 63)  # the word of rows without an id; those of ids are at least -2**57
_COPIES = 4096  # of one row, that are listed at a time
_PATH = "array<struct<before:string,after:string>>"


class Manifest(NamedTuple):
    """What ``build`` returns; without rows there is no root."""

    root: str | None
    proofs: DataFrame  # id, group, place, leaf, carried, subroot, path


def leaf_hash(*fields: Column) -> Column:
    """The leaf of a row: sha256, in hex, of each field's length in bytes, ``:``, and itself; ``-`` if null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A text that is never null and sorts like ``group``, null first, by its bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(leaves: DataFrame) -> DataFrame:
    """``id, key, leaf, carried, place, n``: the rank of each (staged) leaf in its group of ``n``.

    Leaves ascend by id, those without one first. Rows that repeat an id of their group are
    ordered by leaf, then ``carried``; equal ones are counted, not listed, until they have places.
    """
    worded = leaves.selectExpr("*", f"coalesce(shiftright(id, 6), {_NO_ID}) as word", "cast(id & 63 as int) as low")
    words = stage(
        worded.groupBy("key", "word").agg(
            F.expr("bit_or(coalesce(shiftleft(1L, low), 0L)) as bits"), F.count("*").alias("rows")
        ),
        "words",
    )
    sizes = words.groupBy("key").agg(F.sum("rows").alias("n"))
    directory = stage(sums_before(words, ["key"], "word", "rows").join(sizes, "key"), "directory")
    plain = worded.join(directory.where("rows = bit_count(bits)"), ["key", "word"]).selectExpr(
        "id", "key", "leaf", "carried", "before + bit_count(bits & ~shiftleft(-1L, low)) as place", "n"
    )
    # Words with repeated ids, or without an id: their leaves are ranked by id, then by leaf.
    repeats = directory.where("rows != bit_count(bits)")
    kinds = stage(
        worded.join(repeats.select("key", "word"), ["key", "word"], "left_semi")
        .groupBy("key", "word", "low", "id", "leaf", "carried").agg(F.count("*").alias("times")),
        "repeats",
    )
    # A hot id's leaves fall into 2**20 ranges.
    at = "shiftleft(cast(coalesce(low, 0) as bigint), 20) + cast(conv(substring(leaf, 1, 5), 16, 10) as bigint) as at"
    ranged = kinds.selectExpr("*", at).selectExpr("*", "row_number() over (partition by key, word, at order by leaf, carried) as turn")
    ranges = ranged.groupBy("key", "word", "at").agg(F.sum("times").alias("many"))
    ranges = sums_before(stage(ranges, "ranges"), ["key", "word"], "at", "many", (13,)).withColumnRenamed("before", "earlier")
    own = sums_before(ranged, ["key", "word", "at"], "turn", "times", ())
    based = repeats.selectExpr("key", "word", "before as base", "n")
    listed = (
        own.join(ranges.drop("many"), ["key", "word", "at"]).join(based, ["key", "word"])
        .selectExpr("id", "key", "leaf", "carried", "before + earlier + base as first", "times", "n",
                    f"explode(sequence(0L, times - 1, {_COPIES}L)) as some")
        .selectExpr("id", "key", "leaf", "carried", "n", "first",
                    f"explode(sequence(some, least(some + {_COPIES}, times) - 1)) as copy")
        .selectExpr("id", "key", "leaf", "carried", "first + copy as place", "n")
    )
    return plain.unionByName(listed)


def _parents(nodes: DataFrame, held: Sequence[str]) -> DataFrame:
    """``key, place, n, slots, hash``: one level up from ``key, place, n, hash`` and the columns ``held``.

    ``n`` counts the nodes of a group on their own level. A node alone is not hashed again.
    """
    grouped = (
        nodes.selectExpr("key", f"place div {FAN} as place", "n", f"cast(place % {FAN} as int) as slot", "hash", *held)
        .groupBy("key", "place", "n")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "hash", *held))).alias("slots"))
    )
    hashed = "if(n = 1, slots[0].hash, sha2(cast(array_join(slots.hash, '') as binary), 256)) as hash"
    return grouped.selectExpr("key", "place", "n", "slots", hashed)


def _levels(nodes: DataFrame, held: Sequence[str], most: int) -> list[DataFrame]:
    """The staged levels over ``nodes``, of groups of at most ``most``; a group ends where it is one node."""
    levels = []
    while not levels or most > 1:
        if levels:
            level = levels[-1].where(f"n > {FAN}")
            nodes, held = level.selectExpr("key", "place", f"(n + {FAN - 1}) div {FAN} as n", "hash"), ()
        most = -(-most // FAN)
        levels.append(stage(_parents(nodes, held), "level"))
    return levels


def _descended(levels: list[DataFrame], tops: DataFrame, held: Sequence[str]) -> DataFrame:
    """``key, place, path, hash`` and ``held`` of the nodes under the first level, and what ``tops`` carries.

    ``tops`` has a row for each group: ``key``, the path of its top and more columns. A level
    hands to each child the path of its parent, preceded by the hashes before and after it.
    """
    carried = [name for name in tops.columns if name not in ("key", "path")]
    others = "array_join(transform(filter(slots, s -> s.slot {} child.slot), s -> s.hash), '')"
    step = f"struct({others.format('<')} as before, {others.format('>')} as after)"
    arriving = None
    for level in reversed(levels):
        # Groups whose top is on this level start here.
        rows = level.where(f"n <= {FAN}").join(tops, "key")
        if arriving is not None:
            rows = rows.unionByName(level.where(f"n > {FAN}").join(arriving, ["key", "place"]))
        extra = [f"child.{name}" for name in ("hash", *held)] if level is levels[0] else []
        arriving = rows.withColumn("child", F.explode("slots")).selectExpr(
            "key", f"place * {FAN} + child.slot as place", f"if(n = 1, path, concat(array({step}), path)) as path", *carried, *extra
        )
    return arriving


def build(leaves: DataFrame) -> Manifest:
    """The tree over ``id bigint, group string, leaf, carried`` (hashes of ``leaf_hash``; ``carried`` any text).

    Per group, leaves ascend by id; while there is more than one node, every eight consecutive
    ones (the last run may be shorter, even one) become the sha256 of their hashes joined. What
    remains is the group's subroot, a single leaf itself; subroots, ordered by group (null first,
    by bytes), are reduced to the root alike. ``proofs`` has a row for each row of ``leaves``:
    ``place`` in the group, and in ``path`` what stands before and after the node in its run, level
    by level up to the root. Null ids come first in their group and a null group is one of its own;
    repeated ids are leaves of their own, ordered by leaf; equal rows get different places. An
    empty table gives no proofs and no root.
    """
    keyed = leaves.select(F.col("id").cast("bigint").alias("id"), group_key(F.col("group")).alias("key"), "leaf", "carried")
    keyed = stage(keyed, "leaves")
    nodes = placed(keyed).withColumnRenamed("leaf", "hash")
    held = ("id", "carried")
    most = keyed.groupBy("key").count().agg(F.max("count")).first()[0]
    if most is None:
        kind = f"id bigint, group string, place bigint, leaf string, carried string, subroot string, path {_PATH}"
        return Manifest(None, leaves.sparkSession.createDataFrame([], kind))
    levels = _levels(nodes, held, most)
    tops = None
    for level in levels:
        own = level.where(f"n <= {FAN}").select("key", "hash")
        tops = own if tops is None else tops.unionByName(own)
    groups = numbered(tops, ["key"], "place")
    count = groups.count()
    upper = groups.select(
        F.lit("").alias("key"), "place", F.lit(count).cast("bigint").alias("n"), "hash", F.col("key").alias("group_key")
    )
    above = _levels(upper, ("group_key",), count)
    root = above[-1].first()["hash"]
    end = above[-1].select("key", F.array().cast(_PATH).alias("path"))
    subroots = _descended(above, end, ("group_key",)).select(
        F.col("group_key").alias("key"), F.col("hash").alias("subroot"), "path"
    )
    found = _descended(levels, stage(subroots, "subroots"), held)
    group = F.when(F.col("key") != "", F.substring("key", 2, 2_147_483_647))
    return Manifest(
        root, found.select("id", group.alias("group"), "place", F.col("hash").alias("leaf"), "carried", "subroot", "path")
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    up = lambda own, step: F.sha2(F.concat(step["before"], own, step["after"]).cast("binary"), 256)
    return F.aggregate(path, leaf, up)


def proof_digest(path: Column) -> Column:
    """sha256 of the siblings of a path, from the leaf up, left to right."""
    siblings = F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")
    return F.sha2(siblings.cast("binary"), 256)


def document_leaves(documents: DataFrame, fields: Sequence[str] = FIELDS, carried: Column | None = None) -> DataFrame:
    """The leaves of ``documents`` over ``fields``, grouped by ``lang``, as ``build`` takes them.

    The texts are read here and stay here. ``carried`` may be any text of the row, such as the
    hash of another version of it. Columns beyond ``fields`` are not read, whatever their names.
    """
    leaf = leaf_hash(*[F.col(name) for name in fields])
    carried = F.lit(None).cast("string") if carried is None else carried
    return documents.select(
        F.col("doc_id").cast("bigint").alias("id"), F.col("lang").cast("string").alias("group"),
        leaf.alias("leaf"), carried.alias("carried"),
    )
