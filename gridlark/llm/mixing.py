"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Sizes are words. A source's target is its weighted share of the mix, at most `epochs` times its own
size, the excess going to the others by weight. The mix is cut into blocks of `block` words; sources
get blocks by the highest quotients target / (2k - 1), and so do the shards of a source, by their
sizes. Within a shard the documents stand in a seeded order, once for every epoch, and the shard's
blocks are the first ones of that sequence: what a document gives is where the two overlap.

The highest quotients are found without listing them all: rounding at two divisors brackets each
party's number of blocks, and only the quotients in between are ranked, about two a party. A shard
holds about `shard` words, so a source of any size is spread over tasks; the shards' table, not the
documents', is what is apportioned.

Defined cases: null texts have size 0 and take 0; sources rank by code point, null last; sources without
words have target 0; repeated rows and ids are documents of their own; an empty table gives no
rows; the order depends on seed, id, size and text hash alone, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.llm.common import WORD, materialize, table


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # by the source's rank, repeating
    share: float = 1.5  # of all words
    epochs: int = 2
    block: int = 16  # words
    shard: int = 1 << 19  # words
    seed: int = 17


def source_targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Targets are min(cap, level * weight); going up by cap / weight, the level is known as soon as the
    sources below it are full.
    """
    p = params
    everything = W.orderBy(F.col("full_at"), F.col("rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), (F.col("rank") % len(p.weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    caps = ranked.withColumn("cap", F.col("source_size") * float(p.epochs)).withColumn("full_at", F.col("cap") / F.col("weight"))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = caps.withColumns({
        "goal": F.least(F.sum("source_size").over(whole) * float(p.share), F.sum("cap").over(whole)),
        "full": F.coalesce(F.sum("cap").over(everything.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(everything.rowsBetween(0, W.unboundedFollowing)),
    })
    # a source is full if the level that would be needed from it on is not below what fills it
    level = F.when((F.col("goal") - F.col("full")) / F.col("open") < F.col("full_at"), (F.col("goal") - F.col("full")) / F.col("open"))
    leveled = sums.withColumn("level", F.min(level).over(whole)).withColumn("first", F.min(F.when(level.isNotNull(), F.struct("full_at", "rank", level.alias("level")))).over(whole))
    return leveled.select("source", "source_size", F.coalesce(F.least("cap", F.col("first.level") * F.col("weight")), F.col("cap")).alias("target"))


def apportion(parties: DataFrame, votes: str, seats: Column, by: list[str], tie: list[str]) -> DataFrame:
    """Adds column quota: the Sainte-Laguë numbers of seats in each group `by`, all of which sum to seats.

    seats: a whole number, the same in a group. tie: columns that order parties of equal quotients.
    """
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    v = F.col(votes).cast("double")
    p = parties.withColumns({"__seats": seats.cast("long"), "__votes": F.sum(v).over(group), "__n": F.count("*").over(group).cast("double")})
    # at the higher divisor rounding gives no more seats than there are, at the lower one no fewer
    fewer, more = F.col("__seats") - F.col("__n") / 2, F.col("__seats") + F.col("__n") / 2
    at = lambda per: F.floor(v * per / F.col("__votes") + 0.5)
    low = F.when((F.col("__votes") > 0) & (fewer > 0), F.greatest(at(fewer) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    high = F.when(F.col("__votes") > 0, at(more) + 1).otherwise(F.lit(0)).cast("long")
    p = p.withColumns({"__low": low, "__high": high})
    p = p.withColumn("__rest", F.col("__seats") - F.sum("__low").over(group))
    keys = [*by, *tie]
    bids = p.where("__high > __low and __rest > 0").select(*keys, "__rest", v.alias("__v"), F.explode(F.expr("sequence(__low + 1, __high)")).alias("__k"))
    order = [(F.col("__v") / (2 * F.col("__k") - 1)).desc(), *[F.col(t).asc_nulls_last() for t in tie], F.col("__k")]
    won = bids.withColumn("__place", F.row_number().over(group.orderBy(*order))).where("__place <= __rest").groupBy(*keys).agg(F.count("*").alias("__won"))
    renamed = won.select(*[F.col(k).alias(f"__w_{k}") for k in keys], "__won")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__w_{k}"))
    out = p.join(renamed, match, "left").withColumn("quota", F.col("__low") + F.coalesce("__won", F.lit(0)))
    return out.select(*parties.columns, "quota")


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """One row a document: id, size, source_size, target, taken, and taken of the first epoch.

    The row's digest (64-bit hash of the text) and size are in columns digest and size.
    """
    p = params
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), words.alias("size"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(p.seed)).alias("digest"))
    sized = materialize(sized, "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), p)
    blocks = F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / p.block)
    quotas = apportion(targets, "target", blocks, [], ["source"]).withColumnsRenamed({"quota": "source_quota"})
    quotas = materialize(quotas.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / p.shard)).cast("long")), "quotas")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # one row a source: small unless there are as many sources as documents, which Spark's own size check decides
    placed = sized.join(quotas, same(sized, quotas)).drop(quotas["source"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("id", "digest", F.lit(p.seed)), F.col("shards")))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    share = apportion(shards, "shard_size", F.col("source_quota"), ["source"], ["shard"]).select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size", "quota")
    own = placed.join(share, placed["source"].eqNullSafe(share["q_source"]) & (placed["shard"] == share["q_shard"]))
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64("digest", "id", F.lit(p.seed + 1)), F.col("id").asc_nulls_last(), "size", "digest")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    given = own.withColumn("before", before).withColumn("words", F.col("quota") * p.block)
    part = lambda epoch: F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - epoch * F.col("shard_size") - F.col("before")))
    epochs = F.array(*[part(F.lit(e)) for e in range(p.epochs)])
    return given.select(
        F.col("id").alias(id), "size", "source_size", "target", F.aggregate(epochs, F.lit(0).cast("long"), lambda a, x: a + x).cast("long").alias("taken"), epochs.alias("epochs"), "digest", "source", F.col("quota").alias("shard_quota"), F.col("shard")
    )


def take(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: a row of docs for each epoch that takes words of it, its text cut after the words taken.

    Rows with equal id, source and text are alike, so one of them stands for what all of them give.
    """
    digest = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(params.seed))
    key = lambda i, s, d: F.xxhash64(F.coalesce(F.col(i).cast("string"), F.lit("\x00")), F.coalesce(F.col(s).cast("string"), F.lit("\x00")), d)
    plan = mix(docs, id=id, text=text, source=source, params=params).where("taken > 0")
    plan = plan.groupBy(key(id, "source", F.col("digest")).alias("__key")).agg(F.first("size").alias("__size"), F.flatten(F.collect_list("epochs")).alias("__epochs"))
    # all of docs' own columns in one, so that no names clash
    packed = docs.select(key(id, source, digest).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = packed.join(plan, "__key").dropDuplicates(["__key"])
    rows = rows.withColumn("__words", F.explode("__epochs")).where("__words > 0")
    whole = F.col("__row")[text]
    first_words = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("__words").cast("int")), "")
    taken = F.when(F.col("__words") >= F.col("__size"), whole).otherwise(first_words)
    return rows.select(*[(taken if c == text else F.col("__row")[c]).alias(c) for c in docs.columns])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
