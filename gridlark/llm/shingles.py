"""Near-duplicates by exact similarity of word shingles, found by covering SimHash and banded MinHash.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least
`similarity`. Candidates are texts whose SimHash fingerprints (covering.py) hang together within `radius` bits, all of which
the covering tables find; as most pairs at 0.8 differ in more bits, texts that share a band are candidates too. A text's
144 minima make 24 bands of six, of which a pair at similarity s shares none with chance (1 - s^6)^24: 0.0007 at 0.8, under 0.0001 at 0.84. The
candidates' components are gathered, each text once, and inside them all linked pairs are found without
loss by prefix filtering, so a candidate that is not similar enough links nothing.

Exact copies are merged before any of this. Candidates are not: texts that hang together by shared bands
are settled in one task, which keeps their shingles in memory.

Defined cases: null and wordless texts have no shingles and are copies of each other in this respect;
texts shorter than a shingle are one shingle; repeated rows, ids and texts are fine; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import covering
from gridlark.llm.common import chunks, materialize
from gridlark.llm.components import connected_components


@dataclass(frozen=True)
class ShingleParams:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 6  # minima of a band
    radius: int = 4  # bits between fingerprints


ODD = np.random.default_rng(11).integers(1, 1 << 62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, ws), np.uint64, len(ws))
    n = max(1, len(ws) - words + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(len(ws), words), np.uint64)
        for d in range(min(words, len(ws))):
            out = (out ^ h[d : d + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def bands(s: np.ndarray, params: ShingleParams) -> np.ndarray:
    """A hash for each band of the minima of a set of shingles."""
    k = params.bands * params.rows
    low, factors = s.astype(np.uint32), ODD[:k].astype(np.uint32)
    least = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(low), 2048):
            x = low[a : a + 2048, None] * factors
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            least = np.minimum(least, x.min(axis=0))
        h = np.arange(1, params.bands + 1, dtype=np.uint64)
        for column in least.reshape(params.bands, params.rows).T:
            h = (h ^ column) * ODD[k]
            h ^= h >> np.uint64(31)
    return h


def _sign(params: ShingleParams):
    schema = pa.schema([("k", pa.int64()), ("bands", pa.list_(pa.int64())), ("f", pa.int64())])

    def run(batches):
        for cols, texts in chunks(batches, "text", 1 << 22):
            signed = [bands(shingles(t, params.words), params).view(np.int64) for t in texts]
            prints = np.array([covering.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cols["k"], pa.int64()), pa.array(signed, pa.list_(pa.int64())), pa.array(prints)], schema=schema)

    return run


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The smallest index in each set's component of pairs whose similarity is large enough; no such pair is missed.

    Sets are read by size with their rarest elements first. Two similar sets meet in the first of these, of which each has
    all but as many as the overlap needs; with one component a set is compared until it belongs to it.
    """
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if not sets:
        return np.zeros(0, np.int64)
    sizes = [len(s) for s in sets]
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(times), np.int64)
    place[np.argsort(times, kind="stable")] = np.arange(len(times))
    ranked = [np.sort(x) for x in np.split(place[code], np.cumsum(sizes)[:-1])]
    found: dict[int, dict[int, list[int]]] = defaultdict(dict)  # of an element, by component
    bare = -1
    for i in sorted(range(len(sets)), key=lambda i: sizes[i]):
        n = sizes[i]
        if not n:
            root[i], bare = (i, i) if bare < 0 else (bare, bare)
            continue
        prefix = ranked[i][: n - int(np.ceil(similarity * n - 1e-9)) + 1].tolist()
        seen = set()
        for p in prefix:
            at = found[p]
            for old in [c for c in at if root[c] != c]:
                at.setdefault(top(old), []).extend(at.pop(old))
            for c, members in at.items():
                for j in members:
                    if top(c) == top(i):
                        break
                    m = sizes[j]
                    if j in seen or m < similarity * n - 1e-9:
                        continue
                    seen.add(j)
                    both = len(np.intersect1d(ranked[i], ranked[j], assume_unique=True))
                    if both >= similarity * (n + m - both) - 1e-9:
                        x, y = sorted((top(i), top(j)))
                        root[y] = x
        for p in prefix:
            found[p].setdefault(top(i), []).append(i)
    return np.array([top(i) for i in range(len(sets))], np.int64)


def _settle(params: ShingleParams):
    """(k, root) from rows (group, k, text), which come sorted by group and k."""
    schema = pa.schema([("k", pa.int64()), ("root", pa.int64())])

    def run(batches):
        group, keys, sets = None, [], []

        def settled():
            at = similar(sets, params.similarity)
            k = np.array(keys, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(k[at])], schema=schema)

        for cols, texts in chunks(batches, "text", 1 << 22):
            for g, k, t in zip(cols["group"], cols["k"], texts):
                if g != group and keys:
                    yield settled()
                    keys, sets = [], []
                group = g
                keys.append(k)
                sets.append(shingles(t, params.words))
        if keys:
            yield settled()

    return run


def _fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of keys that connect all of (k, f) whose fingerprints are within the radius: to the least key of a fingerprint, and between these."""
    least = materialize(prints.groupBy("f").agg(F.min("k").alias("b")), "fingerprints")
    same = prints.join(least, "f").where("k <> b").select(F.col("k").alias("a"), "b")
    near = covering.fingerprint_links(least, radius).withColumnsRenamed({"a": "f", "b": "g"})
    near = near.join(least.withColumnRenamed("b", "a"), "f").join(least.withColumnRenamed("f", "g"), "g").select("a", "b")
    return same.unionByName(near)


def classes(texts: DataFrame, params: ShingleParams = ShingleParams()) -> DataFrame:
    """(k, root) for every text of (k, text) that is a candidate; equal keys must have equal texts. All others are alone."""
    signed = texts.mapInArrow(_sign(params), "k long, bands array<long>, f long").groupBy("k").agg(F.first("bands").alias("bands"), F.first("f").alias("f"))
    signed = materialize(signed, "bands")
    rows = signed.select("k", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("k").alias("b"), F.max("k").alias("top")).where("b < top").select("band", "b")
    shared = rows.join(heads, "band").where("k <> b").select(F.col("k").alias("a"), "b").distinct()
    candidates = connected_components(shared.unionByName(_fingerprint_links(signed.select("k", "f"), params.radius)))
    groups = candidates.select(F.col("node").alias("k"), F.col("root").alias("group"))
    groups = groups.unionByName(groups.select(F.col("group").alias("k"), "group").distinct())
    # copies are merged map-side, before the texts move
    dealt = texts.dropDuplicates(["k"]).join(groups, "k").repartition("group").sortWithinPartitions("group", "k").select("group", "k", "text")
    return materialize(dealt.mapInArrow(_settle(params), "k long, root long"), "classes")
