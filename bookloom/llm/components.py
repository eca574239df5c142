"""Connected components of links between ids, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


SHRINK = 0.5  # of a round's links, at most so many are left by one in the order of ids


def _ranked(name: str, turn: int, by_id: bool) -> Column:
    """An id with its place in the order of a round: that of the ids, or a random one."""
    order = F.col(name) if by_id else F.xxhash64(name, F.lit(turn))
    return F.struct(order.alias("order"), F.col(name).alias("id"))


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (``a, b``): the component's smallest id.

    Each round every id takes the neighbour that comes first in an order of the ids (or
    itself, if it comes first), follows that one's choice once more, and the links are drawn
    anew between the choices. Ids come in their own order first: stars around their smallest ids
    then fall together at once, while a random order leaves about half of a star. From the first
    round on that leaves more than ``SHRINK`` of its links (a long chain, say) orders are random.
    The links left shrink by a factor from round to round either way, so the
    number of rounds is logarithmic; each is a few joins on ids, and what it leaves is staged. A
    neighbourhood is reduced by partial aggregation, so a hub is no group of its own. Links of an
    id with itself are passed over; no links give no rows.
    """
    links = stage(links.select("a", "b").where(F.col("a") != F.col("b")), "links")
    left, by_id = links.count(), True
    found = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = found.withColumn("at", F.col("id"))
    turn = 0
    while left:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_ranked("b", turn, by_id)).alias("first"))
        choices = first.select("a", F.least("first", _ranked("a", turn, by_id))["id"].alias("to"))
        choices = stage(choices, "choices")  # so that a hub's rows can be split in the join
        then = choices.select(F.col("a").alias("to"), F.col("to").alias("then"))
        jumps = stage(choices.join(then, "to").select("a", F.col("then").alias("to")), "jumps")
        found = (
            found.join(jumps.withColumnRenamed("a", "at"), "at", "left")
            .select("id", F.coalesce("to", "at").alias("at"))
        )
        ends = links.join(jumps, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        ends = ends.join(jumps, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        links = stage(ends.where(F.col("a") != F.col("b")).distinct(), "links")
        before, left = left, links.count()
        by_id = by_id and left <= SHRINK * before
        turn += 1
    found = stage(found, "found")
    smallest = stage(found.groupBy("at").agg(F.min("id").alias("component")), "smallest")
    return found.join(smallest, "at").select("id", "component")
