"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits, the majority of its word shingles' hashes. Two fingerprints within
`radius` bits are linked. Bit j of a fingerprint carries the vector (j mod (2^(r+1) - 1)) + 1 of r + 1
bits, and table v keeps the bits whose vector has an odd product with v. Any r differing bits set at
most r linear conditions on v, so some v of the 2^(r+1) - 1 keeps none of them: every pair within the
radius meets in some table, with certainty. Within a bucket links are found by comparison and
returned as a spanning forest, so their number is linear in the bucket; a large bucket is split
again by the same scheme under another order of the bits.

Equal fingerprints are merged before any of this, so copies cost nothing. Components are found by
distributed star contraction (components.py).

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; texts
shorter than a shingle are one shingle; repeated rows, ids and texts fall into one component; a null id never
becomes a component's id unless all ids in it are null; an empty table gives no rows; other columns are
kept by `with_fingerprint` and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import materialize, table, text_or_empty
from gridlark.llm.components import connected_components

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """The majority fingerprint of a text's word shingles, unsigned."""
    ws = text.lower().split()
    if not ws:
        return 0
    norm = b" ".join(ws)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(ws) - words + 1)
    last = ends[words - 1 :] if len(ws) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(norm[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())], ">u8")
    lanes = h.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def masks(radius: int, order: np.ndarray | None = None) -> np.ndarray:
    """The bits that each table keeps; order: of the 64 bits."""
    n = (2 << radius) - 1
    order = np.arange(64) if order is None else order
    return np.array([sum(1 << int(bit) for j, bit in enumerate(order) if ((j % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)], np.uint64)


SMALL, LARGE = 32, 8192


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in each node's component of the links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def _grow(x: np.ndarray, radius: int) -> np.ndarray:
    """As _settle, by growing one component after the other from the values themselves."""
    root, left = np.arange(len(x)), np.arange(len(x))
    while len(left):
        seed, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(x[left] ^ x[front.pop()]) <= radius
            root[left[near]] = seed
            front += left[near].tolist()
            left = left[~near]
    return root


def roots(x: np.ndarray, radius: int, depth: int = 0) -> np.ndarray:
    """The smallest index in each value's component, of distinct values linked within the radius."""
    if len(x) <= LARGE or depth > 2:
        return _grow(x, radius)
    a, b = [], []
    for mask in masks(radius, np.random.default_rng(depth + 1).permutation(64)):
        order = np.argsort(x & mask, kind="stable")
        cuts = np.flatnonzero(np.diff(x[order] & mask)) + 1
        for at in np.split(order, cuts):
            if len(at) > 1:
                r = roots(x[at], radius, depth + 1)
                moved = r != np.arange(len(at))
                a.append(at[moved])
                b.append(at[r[moved]])
    return _settle(len(x), np.concatenate(a or [[]]).astype(np.int64), np.concatenate(b or [[]]).astype(np.int64))


def _bucket_links(v: np.ndarray, key: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal (v, key)."""
    n = len(x)
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (key[1:] != key[:-1])])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    ours = size[run] <= SMALL
    a, b = [], []
    for d in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero(ours[:-d] & (run[d:] == run[:-d]))
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= radius]
        a.append(i + d)
        b.append(i)
    root = _settle(n, np.concatenate(a or [[]]).astype(np.int64), np.concatenate(b or [[]]).astype(np.int64))
    for f, s in zip(first[size > SMALL], size[size > SMALL]):
        root[f : f + s] = f + roots(x[f : f + s], radius)
    moved = np.flatnonzero(root != np.arange(n))
    return x[moved], x[root[moved]]


def _links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[np.ndarray] = []  # the last bucket may go on in the next batch

        def flush(v, key, x):
            a, b = _bucket_links(v, key, x.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not batch.num_rows:
                continue
            if held and held[-1][0][-1] == now[0][-1] and held[-1][1][-1] == now[1][-1]:
                held.append(now)
                continue
            v, key, x = (np.concatenate([h[k] for h in held] + [now[k]]) for k in range(3))
            whole = np.flatnonzero((v != v[-1]) | (key != key[-1]))
            cut = whole[-1] + 1 if len(whole) else 0
            held = [[v[cut:], key[cut:], x[cut:]]]
            if cut:
                yield flush(v[:cut], key[:cut], x[:cut])
        if held:
            yield flush(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    return run


def fingerprint_links(prints: DataFrame, radius: int = 4, large: int = LARGE) -> DataFrame:
    """Links (a, b) that connect all distinct values of column f (long) within the radius.

    A bucket of over `large` values is divided by second masks before it is dealt out: they too have every pair
    within the radius meet, so nothing is lost.
    """
    listed = lambda ms: F.array(*[F.lit(int(m)) for m in ms.view(np.int64)])
    rows = prints.select(F.posexplode(listed(masks(radius))).alias("v", "mask"), "f").select(F.col("v").cast("int").alias("v"), F.col("f").bitwiseAND(F.col("mask")).alias("key"), "f")
    hot = materialize(rows.groupBy("v", "key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("v", "key", F.lit(True).alias("hot")), "hot")
    if not hot.isEmpty():
        second = masks(radius, np.random.default_rng(1).permutation(64))
        marked = rows.join(hot, ["v", "key"], "left")
        divided = marked.where("hot").select("v", "key", F.posexplode(listed(second)).alias("w", "mask"), "f")
        # one number for both masks; equal hashes of two keys only put two buckets together
        divided = divided.select((F.col("v") + len(second) * (F.col("w") + 1)).cast("int").alias("v"), F.xxhash64("key", F.col("f").bitwiseAND(F.col("mask"))).alias("key"), "f")
        rows = marked.where("hot is null").select("v", "key", "f").unionByName(divided)
    dealt = rows.repartition("v", "key").sortWithinPartitions("v", "key", "f")
    return dealt.mapInArrow(_links(radius), "a long, b long")


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", words: int = 4) -> DataFrame:
    """docs and their fingerprint as a long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t.encode("utf-8", "surrogatepass"), words) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, simhash(text_or_empty(text)))


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(f, component_id) from rows (id, f): one row for each distinct fingerprint."""
    distinct = materialize(prints.groupBy("f").agg(F.min("id").alias("id")), "fingerprints")
    roots_of = connected_components(fingerprint_links(distinct, radius)).withColumnRenamed("node", "f")
    rooted = distinct.join(roots_of, "f", "left").select("f", "id", F.coalesce("root", "f").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("f", "component_id")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row a document: id, fingerprint (hex), component_id."""
    prints = materialize(with_fingerprint(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "f", words=words).select("id", "f"), "prints")
    return prints.join(classes(prints, radius), "f").select(F.col("id").alias(id), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
