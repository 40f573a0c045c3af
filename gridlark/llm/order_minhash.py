"""Order MinHash fingerprints in DataFrame operations only.

A text's words (cut into pieces of at most 12 characters, so that text without spaces has them too)
make overlapping k-mers, and the n-th occurrence of a k-mer is an element of its own. The hash range
is split into 2 * m bins and each bin keeps its minimal element; two neighbouring bins form a tuple,
whose elements are put back into text order before they are hashed. The m tuple hashes are the
fingerprint: they agree where the same k-mers stand in the same order, which follows the edit
distance and not just the set of k-mers. For a bin without elements the least of the others by a hash of the
bin's own stands in, so that a tuple has two different elements unless the text has only one k-mer.

The likeness of two fingerprints is the square root of the share of equal tuples, since a tuple agrees
only if both of its elements do.

Scale: texts are shuffled once, into blocks of about 500 neighbouring ids. The next document's
text comes from a window inside the block, and from a small table of first rows at its end. All that
follows (exploding, numbering, minima) is grouped by the block as well, so it stays where it is.

Defined cases: a null text is empty; an empty text has the fingerprint of no k-mers (all zero), which is
like itself (1) and like no other (0); a text with fewer than k words is one k-mer; ids are ordered with
null first, equal ids by their text's hash; after the last document comes the first, after a single document
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.llm.common import materialize, table, text_or_empty

POSITION = 30  # bits of an element for its place in the text, as many as a text can have words; the rest are its hash


@dataclass(frozen=True)
class OrderMinHashParams:
    tuples: int = 64  # a power of two
    kmer: int = 2
    block: int = 512  # documents that are neighbours by id


def _blocks(docs: DataFrame, params: OrderMinHashParams) -> Column:
    """A block number that grows with column id: 256 ranges of equal rows, each split evenly by value."""
    facts = docs.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("none"), F.percentile_approx("id", [i / 256 for i in range(257)], 10_000).alias("cuts")).first()
    cuts = sorted(set(facts["cuts"] or [0]))
    fine = max(1, -(-facts["n"] // (256 * params.block)))
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    range_no = F.greatest(F.size(F.filter(edges, lambda c: c <= F.col("id"))), F.lit(1))
    low, high = F.element_at(edges, range_no), F.element_at(edges, F.least(range_no + 1, F.lit(len(cuts))))
    inside = F.least(F.floor((F.col("id").cast("double") - low) / F.greatest(high.cast("double") - low, F.lit(1.0)) * fine), F.lit(fine - 1))
    # rows without an id come first, by their text's hash
    bare = max(1, -(-facts["none"] // params.block))
    first = F.floor((F.col("digest") / F.lit(2.0**64) + 0.5) * bare) - bare
    return F.when(F.col("id").isNull(), F.least(first, F.lit(-1))).otherwise(range_no * fine + F.greatest(inside, F.lit(0))).cast("long")


def with_next(docs: DataFrame, params: OrderMinHashParams = OrderMinHashParams()) -> DataFrame:
    """(block, place, id, text, next_text, last_of, next_block) from (id, text); the last document is followed by the first."""
    rows = docs.withColumn("digest", F.xxhash64("text"))
    rows = rows.withColumn("block", _blocks(rows, params))
    order = W.partitionBy("block").orderBy(F.col("id").asc_nulls_first(), "digest")
    heads = rows.groupBy("block").agg(F.min_by("text", F.struct("id", "digest")).alias("head"))
    # the block after each one: among 4096 neighbours, then from a row for each such stretch
    blocks = rows.select("block").distinct().withColumn("stretch", F.shiftright("block", 12))
    inner = blocks.withColumn("n", F.lead("block").over(W.partitionBy("stretch").orderBy("block")))
    stretches = blocks.groupBy("stretch").agg(F.min("block").alias("least"))
    every = W.orderBy("stretch")
    later = stretches.select("stretch", F.coalesce(F.lead("least").over(every), F.first("least").over(every)).alias("later"))
    ends = inner.join(later, "stretch").select("block", F.coalesce("n", "later").alias("next_block")).join(heads.withColumnRenamed("block", "next_block"), "next_block").select(F.col("block").alias("e_block"), "next_block", "head")
    placed = rows.withColumns({"place": F.row_number().over(order), "follower": F.lead("text").over(order)}).drop("digest")
    ended = placed.join(ends, (F.col("block") == F.col("e_block")) & F.col("follower").isNull(), "left")
    return ended.select("block", "place", "id", "text", F.coalesce("follower", "head").alias("next_text"), "next_block")


def _kmers(words: str, params: OrderMinHashParams) -> Column:
    """Hashes of the k-mers of a column of words; a column, so that it is not made again for each k-mer."""
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " "))))
    starts = F.slice(words, 1, F.greatest(F.size(words) - (params.kmer - 1), F.lit(0)))
    return F.when(F.size(words) <= params.kmer, whole).otherwise(F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + d) for d in range(1, params.kmer)])))


def signatures(sides: DataFrame, keys: list[str], params: OrderMinHashParams = OrderMinHashParams()) -> DataFrame:
    """(keys, signature: array<int>) from (keys, text); texts without k-mers have no row."""
    bins = 2 * params.tuples
    words = sides.select(*keys, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]{1,12}"), F.lit(0)).alias("words"))
    words = words.select(*keys, F.posexplode(_kmers("words", params)).alias("pos", "k"))
    nth = F.row_number().over(W.partitionBy(*keys, "k").orderBy("pos"))
    kept = F.shiftleft(F.shiftrightunsigned(F.xxhash64("k", nth), POSITION + 1), POSITION)
    elements = words.select(*keys, kept.bitwiseOR(F.least("pos", F.lit((1 << POSITION) - 1)).cast("long")).alias("e"))
    shift = 63 - (bins.bit_length() - 1)
    minima = elements.groupBy(*keys, F.shiftright("e", shift).alias("bin")).agg(F.min("e").alias("e"), F.max("e").alias("last"))
    held = minima.groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("es"), F.max("last").alias("last"))
    bin_of = lambda e: F.shiftright(e, shift).cast("int")
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(bin_of(F.get("es", i - 1)))
    own = F.flatten(F.transform("es", lambda e, i: F.array_append(F.array_repeat(F.lit(None).cast("long"), bin_of(e) - before(i) - 1), e)))
    # k-mers that all fall into one bin still make a pair
    full = held.select(*keys, own.alias("own"), F.when(F.size("es") == 1, F.array_distinct(F.concat("es", F.array("last")))).otherwise(F.col("es")).alias("es"))
    mask = (1 << POSITION) - 1

    def drawn(seed: Column, other: Column) -> Column:
        """The element that stands in for an empty bin: the least by the bin's own hash of all but the tuple's other."""
        ranked = F.transform(F.filter("es", lambda e: ~e.eqNullSafe(other)), lambda e: F.struct(F.xxhash64(F.shiftright(e, POSITION), seed).alias("rank"), e.alias("e")))
        return F.array_min(ranked)["e"]

    def joined(t: Column) -> Column:
        a, b = t["a"], t["b"]
        x, y = F.shiftright(a, POSITION), F.shiftright(b, POSITION)
        return F.when(a.bitwiseAND(F.lit(mask)) <= b.bitwiseAND(F.lit(mask)), F.xxhash64(x, y)).otherwise(F.xxhash64(y, x)).bitwiseAND(F.lit(0xFFFF)).cast("int")

    pairs = F.transform(F.sequence(F.lit(0), F.lit(params.tuples - 1)), lambda i: F.struct(i.alias("i"), F.get("own", 2 * i).alias("a"), F.get("own", 2 * i + 1).alias("b")))
    pairs = F.transform(pairs, lambda t: F.struct(t["i"].alias("i"), F.coalesce(t["a"], drawn(2 * t["i"], t["b"]), t["b"]).alias("a"), t["b"].alias("b")))
    pairs = F.transform(pairs, lambda t: F.struct(t["a"].alias("a"), F.coalesce(t["b"], drawn(2 * t["i"] + 1, t["a"]), t["a"]).alias("b")))
    return full.select(*keys, F.transform(pairs, joined).alias("signature"))


def likeness(a: str, b: str, params: OrderMinHashParams = OrderMinHashParams()) -> Column:
    """Of two signature columns; null stands for a text without k-mers."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), (F.col(a).isNull() & F.col(b).isNull()).cast("double")).otherwise(F.sqrt(same / F.lit(float(params.tuples))))


def printed(signature: str, params: OrderMinHashParams = OrderMinHashParams()) -> Column:
    text = F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")
    return F.coalesce(text, F.lit("0" * 4 * params.tuples))


def fingerprint_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", params: OrderMinHashParams = OrderMinHashParams()) -> DataFrame:
    """(id, fingerprint) of every row."""
    rows = materialize(docs.select(F.col(id).alias("id"), text_or_empty(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "texts")
    return rows.drop("text").join(signatures(rows.select("row", "text"), ["row"], params), "row", "left").select(F.col("id").alias(id), printed("signature", params).alias("fingerprint"))


def edit_sensitivity(docs: DataFrame, *, id: str = "doc_id", text: str = "text", params: OrderMinHashParams = OrderMinHashParams()) -> DataFrame:
    """Fingerprints of every text and of an edited form, whose later half is the start of the next document."""
    rows = with_next(docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("text")), params)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = rows.select("block", "place", "id", "next_block", n.cast("long").alias("n_chars"), "text", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    facts = edited.select("block", "place", "id", "next_block", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    sides = edited.select("block", "place", F.posexplode(F.array("text", "edited")).alias("side", "text"))
    signed = signatures(sides, ["block", "place", "side"], params)
    both = signed.groupBy("block", "place").agg(F.first(F.when(F.col("side") == 0, F.col("signature")), ignorenulls=True).alias("own"), F.first(F.when(F.col("side") == 1, F.col("signature")), ignorenulls=True).alias("changed"))
    told = materialize(facts.join(both, ["block", "place"], "left"), "signatures")
    heads = told.where("place = 1").select(F.col("block").alias("h_block"), F.col("own").alias("head"))
    led = told.withColumns({"follower": F.lead("own").over(W.partitionBy("block").orderBy("place")), "more": F.lead("place").over(W.partitionBy("block").orderBy("place"))})
    # only the last rows of blocks, a few, look elsewhere; the others have no key to be joined by
    inner = led.where("more is not null").withColumn("next", F.col("follower"))
    last = led.where("more is null").join(heads, F.col("next_block") == F.col("h_block"), "left").withColumn("next", F.col("head")).select(*inner.columns)
    return inner.unionByName(last).select(
        F.col("id").alias(id), "n_chars", "edited_sha256", printed("own", params).alias("fingerprint"), printed("changed", params).alias("edited_fingerprint"),
        likeness("own", "changed", params).alias("near_edited"), likeness("own", "next", params).alias("near_next"),
    )


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_sensitivity(table(spark, sf_dir, "documents"))
