"""Duplicate detection for catalogs: exact hashes, Hamming groups, similar names, greedy leaders."""

from __future__ import annotations

from functools import partial
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from ..sources.storage import materialize
from . import blocks as blocks_of


def exact_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(hash, keeper, copies): groups of equal canonical texts; partial aggregates, no lists."""
    return docs.groupBy(tx.canonical_hash(F.col(text)).alias("hash")).agg(F.min(key).alias("keeper"), F.count("*").alias("copies")).where("copies > 1")


def _masks(bits: int, most: int) -> list[int]:
    """All masks of at most so many of the bits."""
    return [sum(1 << p for p in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def hamming_pairs(rows: DataFrame, key: str, bits: str, radius: int = 5) -> DataFrame:
    """(a, b, distance), a < b, of 64-bit values within the radius.

    The bits are cut into four blocks of sixteen; of values within the radius one block
    has a quarter of the differences at most. One side of the join lists its blocks with
    all of half those flips, the other side with the other half, so that the two meet in
    the middle: under one in a thousand random pairs meet at radius 5. From radius 8 on
    blocks select little, and all pairs are compared as arrays instead. Equal values are
    folded before.
    """
    if not 0 <= radius < 20:
        raise ValueError("radius is 0 to 19: beyond that the blocks select nothing")
    flips = radius // 4
    one = rows.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("v")).agg(F.min(key).alias("k")).where("k is not null")
    if flips > 1:
        kind = one.schema["k"].dataType.simpleString()
        packs = blocks_of.packed(one.select("k", F.col("v").cast("long").alias("v")), "k", "v")
        return blocks_of.meet(packs, packs, partial(blocks_of.hamming, radius=radius), f"a {kind}, b {kind}, distance int", half=True)

    def blocks(prefix: str, most: int) -> DataFrame:
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(16, most)])

        def block(i: int) -> Column:
            own = F.shiftrightunsigned("v", 16 * i).bitwiseAND(F.lit(0xFFFF))
            return F.transform(masks, lambda m: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(m).alias("part")))

        parts = [block(i) for i in range(4)]
        return one.select(F.col("k").alias(prefix + "k"), F.col("v").alias(prefix + "v"), F.explode(F.concat(*parts)).alias("x")).select("x.block", "x.part", prefix + "k", prefix + "v")

    near = blocks("a", flips - flips // 2).join(blocks("b", flips // 2), ["block", "part"]).where("ak <> bk").withColumn("distance", vx.hamming(F.col("av"), F.col("bv"))).where(F.col("distance") <= radius)
    return near.select(F.least("ak", "bk").alias("a"), F.greatest("ak", "bk").alias("b"), "distance").distinct()


def hamming_members(rows: DataFrame, key: str, bits: str) -> DataFrame:
    """(key, representative) of every row: the smallest key of its value, under which hamming_pairs gives the value's links.

    Rows without a value are equal to nothing and stand for themselves.
    """
    slim = rows.select(F.col(key).alias("_key"), F.col(bits).alias("_bits"))
    first = slim.where("_bits is not null").groupBy(F.col("_bits").alias("_hash")).agg(F.min("_key").alias("_first"))
    return slim.join(first, F.col("_bits") == F.col("_hash"), "left").select(F.col("_key").alias(key), F.coalesce("_first", "_key").alias("representative"))


def hamming_leaders(rows: DataFrame, key: str, bits: str, radius: int = 5) -> DataFrame:
    """(k, leader) of every row: leaders() over the distinct values, carried to all their copies.

    A copy has the neighbours of its representative, which comes before it, so both
    have one leader.
    """
    members = materialize(hamming_members(rows, key, bits).select(F.col(key).alias("k"), "representative"))
    led = leaders(members.select(F.col("representative").alias("k")), hamming_pairs(rows, key, bits, radius))
    return members.join(led.select(F.col("k").alias("representative"), "leader"), "representative", "left").select("k", "leader")


#: Open links that leaders() still settles in rounds; fewer are folded on the driver.
FOLDED_LINKS = 200_000


def leaders(nodes: DataFrame, links: DataFrame, key: str = "k") -> DataFrame:
    """(key, leader): greedy leader clustering in key order over links (a < b).

    The first undecided key without an earlier undecided neighbour leads; its later
    neighbours follow their earliest leader. Rounds are materialised and settle the
    first open key at least. Once the links between open keys are few, counted first,
    the rest is decided in key order on the driver: a long chain would need as many
    rounds as it has links. Null keys have no leader.
    """
    kind = nodes.schema[key].dataType.simpleString()
    state = materialize(nodes.select(F.col(key).alias("k")).distinct().withColumn("leads", F.lit(None).cast("boolean")))
    links = materialize(links.select("a", "b").distinct().where("a < b").join(state.select(F.col("k").alias("a")), "a", "left_semi").join(state.select(F.col("k").alias("b")), "b", "left_semi").select("a", "b"))
    open_links = links
    while (left := open_links.count()) > FOLDED_LINKS:
        open_nodes = state.where("leads is null and k is not null").select("k")
        new = open_nodes.join(open_links.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
        follow = open_links.join(new.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct()
        mark = new.withColumn("now", F.lit(True)).unionByName(follow.withColumn("now", F.lit(False)))
        state = materialize(state.join(mark, "k", "left").select("k", F.coalesce("leads", "now").alias("leads")))
        done = state.where("leads is not null").select("k")
        open_links = materialize(open_links.join(done.withColumnRenamed("k", "a"), "a", "left_anti").join(done.withColumnRenamed("k", "b"), "b", "left_anti").select("a", "b"))
    following: set = set()
    if left:
        for a, b in sorted(map(tuple, open_links.collect())):  # a is decided before its links come up
            if a not in following:
                following.add(b)
    rest = nodes.sparkSession.createDataFrame([(k,) for k in following], f"k {kind}").withColumn("now", F.lit(False))
    leading = state.join(rest, "k", "left").where("k is not null and coalesce(leads, now, true)").select(F.col("k").alias("a"))
    earliest = links.join(leading, "a", "left_semi").groupBy(F.col("b").alias("k")).agg(F.min("a").alias("to"))
    return state.join(earliest, "k", "left").select("k", F.coalesce("to", "k").alias("leader"))


def similar_names(rows: DataFrame, key: str, name: str, least: float = 0.8) -> DataFrame:
    """(a, b, similarity) of names with a normalised Levenshtein similarity of at least least.

    Names of length n and m can reach it only with |n - m| <= (1 - least) max(n, m),
    and then share one of few equal pieces: a name is cut into one piece more than
    the edits allowed, and pieces are looked up at every shift that edits can cause.
    """
    most = F.floor(F.length("s") * (1 - least) / least).cast("int")  # edits allowed against the longest partner
    one = rows.select(F.col(key).alias("k"), tx.normalise_name(F.col(name)).alias("s")).where("s <> ''")
    cut = one.withColumn("e", most).withColumn("n", F.length("s"))
    # pieces of the left name, by the number of pieces; the right name offers the same lengths at nearby places
    left = cut.withColumn("w", F.floor(F.col("n") / (F.col("e") + 1)).cast("int")).where("w > 0").select("k", "s", "n", "e", "w", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("i"))
    left = left.select("k", "s", "n", "e", (F.col("i") * F.col("w")).alias("at"), F.substring("s", F.col("i") * F.col("w") + 1, F.when(F.col("i") == F.col("e"), F.col("n")).otherwise(F.col("w"))).alias("piece"))
    sizes = left.select(F.length("piece").alias("z")).distinct()
    right = one.crossJoin(F.broadcast(sizes)).where("z <= length(s)")  # piece lengths are bounded by the longest name
    right = right.select(F.col("k").alias("k2"), F.col("s").alias("s2"), F.posexplode(F.transform(F.sequence(F.lit(0), F.length("s") - F.col("z")), lambda i: F.substring(F.col("s"), i + 1, F.col("z")))).alias("at2", "piece"))
    near = left.join(right, "piece").where("k <> k2 and abs(at - at2) <= e and abs(n - length(s2)) <= e").select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), F.when(F.col("k") < F.col("k2"), F.col("s")).otherwise(F.col("s2")).alias("sa"), F.when(F.col("k") < F.col("k2"), F.col("s2")).otherwise(F.col("s")).alias("sb")).distinct()
    return near.withColumn("similarity", tx.levenshtein_similarity(F.col("sa"), F.col("sb"))).where(F.col("similarity") >= least).select("a", "b", "similarity")
