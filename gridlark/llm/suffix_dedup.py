"""Exact removal of long repeats with run-length compressed suffix indexes.

A byte goes if some string of `length` bytes that covers it also starts at another place of the corpus.
Every window of that length is given the anchor that its content alone decides: its short gram of the
least hash. Equal windows have equal anchors, so the corpus falls into small groups of segments (runs
of windows with one anchor) that can be judged apart from each other, anywhere:

- segments that are alone under their anchor, occur once and cannot repeat in themselves are unique; no text moves for them;
- of the rest every different segment counts once, with the number of its places: one that has several matches its copies
  from end to end, and where it is the only one under its anchor no text moves for it. The others, the places where a repeat
  begins, ends or differs, are fetched and indexed group by group, together with those that have copies.
  The index is the run-compressed Burrows-Wheeler transform with suffix samples at the run ends, and
  the lengths of the matches there. Streaming along the text, the longest match of a position is that of the
  position before less one, unless a sample stands there; where it reaches `length`, a window repeats;
- an anchor with more than `group` different segments is divided by second anchors (the least gram by another
  hash) in the same way, so that no index grows with the corpus. What is still under one second anchor beyond `group`
  has its windows counted by hash, combined before the shuffle, which is exact whatever the group's size.

Texts are shuffled by their own hash, never by content, so neither copies nor common passages make a hot task
of texts.

Defined cases: null and empty texts have no bytes and keep none; texts shorter than `length` keep
everything; identical rows are two places each; repeated and null ids are fine; an empty table gives no
rows; other columns are kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, materialize, table


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400  # bytes
    gram: int = 128  # of an anchor
    group: int = 1000  # most different segments of an anchor that are indexed together
    piece: int = 512  # most windows of a segment
    index: int = 1 << 20  # bytes that are indexed at a time, by whole anchors


BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        run = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]))
        return run(BASE), run(inverse)


BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every window of raw."""
    n = len(raw)
    top = 1 << max(12, (n + 1).bit_length())
    power, inverse = (p[: n + 1] for p in _powers(top))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[raw] * power[:n], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * inverse[: n + 1 - size]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` values in a row."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(raw: np.ndarray, sizes: np.ndarray, params: RepeatParams, salt: int = 0) -> dict[str, np.ndarray]:
    """The segments of texts that stand one after the other in raw: start, windows, anchor, and whether it may repeat in itself.

    salt: another one makes other grams the least.
    """
    length, gram = params.length, params.gram
    none = {k: np.zeros(0, np.int64) for k in ("start", "windows", "anchor", "multi", "text")}
    if len(raw) < length:
        return none
    ends = np.cumsum(sizes)
    ok = np.zeros(len(raw) - length + 1, bool)  # windows that lie in one text
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        ok[a : max(a, b - length + 1)] = True
    if not ok.any():
        return none
    h = window_hashes(raw, gram)
    if salt:
        h = (h ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    at = np.arange(len(h), dtype=np.uint64) & PLACE
    width = length - gram + 1
    left = (_least(h & ~PLACE | at, width) & PLACE).astype(np.int64)
    right = (PLACE - (_least(h & ~PLACE | (PLACE - at), width) & PLACE)).astype(np.int64)
    anchor = h[left]
    new = ok.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1] | np.isin(np.arange(1, len(ok)), ends)
    start = np.flatnonzero(new)
    stop = np.flatnonzero(ok & ~np.append(ok[1:] & ~new[1:], False)) + 1
    many = -(-(stop - start) // params.piece)
    if many.max() > 1:
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, stop = np.repeat(start, many) + k * params.piece, np.minimum(np.repeat(stop, many), np.repeat(start, many) + (k + 1) * params.piece)
    edges = np.stack([start, stop], 1).ravel()
    edges = edges[:-1] if edges[-1] == len(left) else edges
    lo, hi = np.minimum.reduceat(left, edges)[::2], np.maximum.reduceat(right, edges)[::2]
    alone = np.repeat(many, many) == 1
    return {"start": start, "windows": stop - start, "anchor": anchor[start].view(np.int64), "multi": (lo != hi) | ~alone, "text": np.searchsorted(ends, start, "right")}


LIMIT = 1 << 20


def _blocks(texts: list[bytes], params: RepeatParams):
    """(index of the first text, offset in it, bytes, sizes): runs of texts; a long text in overlapping parts."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if len(t) > LIMIT:
            if held:
                yield first, 0, b"".join(held), [len(x) for x in held]
            for a in range(0, len(t) - params.length + 1, LIMIT):
                part = t[a : a + LIMIT + params.length - 1]
                yield i, a, part, [len(part)]
            first, held, size = i + 1, [], 0
            continue
        if size + len(t) > LIMIT and held:
            yield first, 0, b"".join(held), [len(x) for x in held]
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, 0, b"".join(held), [len(x) for x in held]


def _list_segments(params: RepeatParams):
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("multi", pa.bool_())])

    def run(batches):
        for cols, texts in chunks(batches, "text", 1 << 22):
            keys = np.array(cols["key"], np.int64)
            for first, offset, raw, sizes in _blocks(texts, params):
                ends = np.cumsum(sizes)
                s = segments(np.frombuffer(raw, np.uint8), np.array(sizes, np.int64), params)
                if not len(s["start"]):
                    continue
                size = s["windows"] + params.length - 1
                seg = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(s["start"].tolist(), size.tolist())), np.uint64, len(size))
                begin = s["start"] - (ends - sizes)[s["text"]] + offset
                yield pa.RecordBatch.from_arrays([pa.array(s["anchor"]), pa.array(seg.view(np.int64)), pa.array(keys[first + s["text"]]), pa.array(begin), pa.array(s["windows"].astype(np.int32)), pa.array(s["multi"].astype(bool))], schema=schema)

    return run


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of some strings, sampled at the ends of its runs.

    Only what stands at run ends is kept: the symbol, the suffix there and its match with the neighbour
    outside the run. `statistics` streams over the strings with these samples alone.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        raw = np.frombuffer(b"".join(strings), np.uint8)
        self.n = len(raw)
        ends = np.repeat(np.cumsum(sizes), sizes)
        self.rest = ends - np.arange(self.n)  # symbols up to the string's end
        padded = np.concatenate([raw.astype(np.int64) + 1, np.zeros(7, np.int64)])
        self.word = np.zeros(self.n, np.int64)  # seven symbols from here, 0 past the end
        for j in range(7):
            self.word = self.word << 9 | np.where(self.rest > j, padded[j : j + self.n], 0)
        order = self._sorted()
        before = np.where(order > 0, padded[order - 1], 0)
        start = np.zeros(self.n, bool)
        start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        before[start[order]] = -1 - order[start[order]]  # what stands before a string is unlike anything else
        change = before[1:] != before[:-1]
        heads, tails = np.append(True, change), np.append(change, True)
        self.symbols = before[heads]
        up, down = np.flatnonzero(heads), np.flatnonzero(tails)
        self.above = self._sampled(order[up], np.where(up > 0, order[up - 1], -1))
        self.below = self._sampled(order[down], np.where(down < self.n - 1, order[np.minimum(down + 1, self.n - 1)], -1))

    def _sorted(self) -> np.ndarray:
        """The suffix array, by prefix doubling over what is still undecided; equal suffixes stand in text order."""
        order = np.argsort(self.word, kind="stable")
        w = self.word[order]
        new = np.append(True, w[1:] != w[:-1])
        rank = np.empty(self.n, np.int64)
        group = np.maximum.accumulate(np.where(new, np.arange(self.n), 0))
        rank[order] = group + 1
        open_ = np.flatnonzero(~new | np.append(~new[1:], False))  # places whose suffix is not decided
        h, top = 7, int(self.rest.max(initial=0))
        while len(open_) and h < top:
            at = order[open_]
            then = np.where(self.rest[at] > h, rank[np.minimum(at + h, self.n - 1)], 0)
            by = np.argsort(rank[at] << 31 | then, kind="stable")
            at, then = at[by], then[by]
            was = rank[at]
            order[open_] = at
            fresh = np.append(True, (was[1:] != was[:-1]) | (then[1:] != then[:-1]))
            rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))] + 1
            open_ = open_[~fresh | np.append(~fresh[1:], False)]
            h *= 2
        return order

    def _sampled(self, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in text order, and the length of each one's match with the other."""
        match = np.zeros(len(at), np.int64)
        live = np.flatnonzero(other >= 0)
        while len(live):
            a, b = at[live] + match[live], other[live] + match[live]
            in_both = (self.rest[at[live]] > match[live]) & (self.rest[other[live]] > match[live])
            live, a, b = live[in_both], a[in_both], b[in_both]
            differ = self.word[a] ^ self.word[b]
            room = np.minimum(np.minimum(self.rest[a], self.rest[b]), 7)
            same = np.where(differ == 0, 7, (62 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64)) + 1e-12).astype(np.int64)) // 9)
            step = np.minimum(same, room)
            match[live] += step
            live = live[(step == 7)]
        by = np.argsort(at)
        return at[by], match[by]

    def statistics(self) -> np.ndarray:
        """For every position the length of the longest match with any other position."""
        here = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for at, match in (self.above, self.below):
            k = np.searchsorted(at, here, "right") - 1
            out = np.maximum(out, match[k] - (here - at[k]))
        return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _judge(params: RepeatParams):
    """Ranges (from, to, in bytes of the segment) of repeats in rows (anchor, seg, n, body), which come sorted by anchor."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def marks(rows: list[tuple]):
        long = RunIndex([body for *_, body in rows]).statistics() >= params.length
        at, out = 0, ([], [], [], [])
        for anchor, seg, n, body in rows:
            if n == 1:
                for a, b in zip(*_runs(long[at : at + len(body)])):
                    for column, x in zip(out, (anchor, seg, int(a), int(b) - 1 + params.length)):
                        column.append(x)
            at += len(body)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    def run(batches):
        held: list[tuple] = []
        size, anchor = 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if row[0] != anchor and size > params.index:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                anchor, size = row[0], size + len(row[3])
        if held:
            yield marks(held)

    return run


def _bodies(params: RepeatParams):
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("n", pa.int64()), ("n_segs", pa.int64()), ("body", pa.binary())])

    def run(batches):
        for cols, texts in chunks(batches, "text", 1 << 22):
            out: list[list] = [[] for _ in schema]
            for wanted, t in zip(cols["wanted"], texts):
                for s in wanted:
                    for column, x in zip(out, (s["anchor"], s["seg"], s["n"], s["n_segs"], t[s["start"] : s["start"] + s["windows"] + params.length - 1])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


SECOND = 0x51A5C0DE51A5C0DF


def _divided(params: RepeatParams):
    """Segments by their second anchors: (anchor, seg, parent, parent_seg, at, n, multi, body)."""
    names = ["anchor", "seg", "parent", "parent_seg", "at", "n", "multi", "body"]
    kinds = [*[pa.int64()] * 6, pa.bool_(), pa.binary()]

    def run(batches):
        for batch in batches:
            parents, segs, times, bodies = (batch.column(c).to_pylist() for c in ("anchor", "seg", "n", "body"))
            sizes = np.array([len(x) for x in bodies], np.int64)
            raw = b"".join(bodies)
            s = segments(np.frombuffer(raw, np.uint8), sizes, params, SECOND)
            begin = (np.cumsum(sizes) - sizes)[s["text"]]
            out: list[list] = [[] for _ in names]
            for start, windows, anchor, multi, text, b in zip(*(s[k].tolist() for k in ("start", "windows", "anchor", "multi", "text")), begin.tolist()):
                body = raw[start : start + windows + params.length - 1]
                both = xxhash.xxh3_64_intdigest(f"{parents[text]},{anchor}") - (1 << 63)
                for column, x in zip(out, (both, xxhash.xxh3_64_intdigest(body) - (1 << 63), parents[text], segs[text], start - b, times[text], bool(multi), body)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def _windows(params: RepeatParams):
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("seg", pa.int64()), ("a", pa.int64())])

    def run(batches):
        for batch in batches:
            for n, anchor, seg, body in zip(*(batch.column(c).to_pylist() for c in ("n", "anchor", "seg", "body"))):
                h = window_hashes(np.frombuffer(body, np.uint8), params.length)
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[pa.array(np.full(k, x)) for x in (n, anchor, seg)], pa.array(np.arange(k))], schema=schema)

    return run


def _with_sizes(kinds: DataFrame) -> DataFrame:
    """Segments (anchor, seg, n, multi, ...) that may hold repeats, with the number of different ones under their anchor."""
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("n_segs"))
    return kinds.join(sizes, "anchor").where("n > 1 or n_segs > 1 or multi")


def _copied(kinds: DataFrame, size: Column) -> DataFrame:
    """Ranges of segments that have copies: all of them."""
    return kinds.where("n > 1").select("anchor", "seg", F.lit(0).cast("long").alias("a"), size.cast("long").alias("b"))


RANGE = "anchor long, seg long, a long, b long"


def _indexed(bodies: DataFrame, params: RepeatParams) -> DataFrame:
    """Ranges of repeats in segments (anchor, seg, n, body) whose anchors have few."""
    return bodies.select("anchor", "seg", "n", "body").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_judge(params), RANGE)


def _in_large_groups(large: DataFrame, params: RepeatParams) -> DataFrame:
    """Ranges of repeats in segments whose anchors have many: by second anchors."""
    pieces = materialize(large.mapInArrow(_divided(params), "anchor long, seg long, parent long, parent_seg long, at long, n long, multi boolean, body binary"), "divided")
    kinds = pieces.groupBy("anchor", "seg").agg(F.sum("n").alias("n"), F.max("multi").alias("multi"), F.max("body").alias("body"))
    sized = materialize(_with_sizes(kinds), "second")
    some = _copied(sized, F.octet_length("body")).unionByName(_indexed(sized.where(F.col("n_segs") <= params.group), params))
    windows = sized.where(F.col("n_segs") > params.group).mapInArrow(_windows(params), "h long, n long, anchor long, seg long, a long")
    twice = windows.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h")
    counted = windows.join(twice, "h", "left_semi").select("anchor", "seg", "a", (F.col("a") + params.length).alias("b"))
    found = some.unionByName(counted)
    return found.join(pieces.select("anchor", "seg", "parent", "parent_seg", "at"), ["anchor", "seg"]).select(F.col("parent").alias("anchor"), F.col("parent_seg").alias("seg"), (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))


def repeats(rows: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """(key, a, b): byte ranges of repeats, which may overlap, from (key, text). Equal keys must have equal texts."""
    listed = materialize(rows.mapInArrow(_list_segments(params), "anchor long, seg long, key long, start long, windows int, multi boolean"), "segments")
    kinds = listed.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.max("multi").alias("multi"), F.min(F.struct("key", "start", "windows")).alias("at"))
    kinds = materialize(_with_sizes(kinds).select("anchor", "seg", "n", "n_segs", "at.*"), "kinds")
    wanted = kinds.where("n_segs > 1 or n = 1").groupBy("key").agg(F.collect_list(F.struct("anchor", "seg", "n", "n_segs", "start", "windows")).alias("wanted"))
    fetched = rows.dropDuplicates(["key"]).join(wanted, "key").select("wanted", "text")
    bodies = materialize(fetched.mapInArrow(_bodies(params), "anchor long, seg long, n long, n_segs long, body binary"), "bodies")
    found = _copied(kinds, F.col("windows") - 1 + params.length).unionByName(_indexed(bodies.where(F.col("n_segs") <= params.group), params))
    large = bodies.where(F.col("n_segs") > params.group)
    if not large.isEmpty():
        found = found.unionByName(_in_large_groups(large, params))
    return listed.join(found, ["anchor", "seg"]).select("key", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def _cut(text: bytes, marks: list[dict], whole_characters: bool) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the number of runs that they form."""
    if not marks:
        return text, 0, 0
    spans = sorted((m["a"], m["b"]) for m in marks)
    runs = [list(spans[0])]
    for a, b in spans[1:]:
        if a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    if whole_characters:  # shrink to what is between characters
        inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
        for r in runs:
            while inside(r[0]):
                r[0] += 1
            while inside(r[1]):
                r[1] -= 1
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), len(runs)


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Columns __row, which holds all of docs' own so that no names clash, __text and __key."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = rows.withColumn("__text", F.coalesce(F.col("__row")[text].cast("string"), F.lit("")))
    return rows.withColumn("__key", F.xxhash64(F.coalesce(F.col("__row")[id].cast("string"), F.lit("")), "__text"))


def _unpacked(rows: DataFrame, columns: list[str], text: str, new: Column) -> DataFrame:
    return rows.select(*[(new if c == text else F.col("__row")[c]).alias(c) for c in columns])


def marked(docs: DataFrame, id: str, text: str, params: RepeatParams) -> DataFrame:
    """Columns __row (that of docs), __key, __text and __marks."""
    keyed = _keyed(docs, id, text)
    marks = repeats(keyed.select(F.col("__key").alias("key"), F.col("__text").alias("text")), params)
    # copies under one key mark the same places
    per = marks.distinct().groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("a", "b")).alias("__marks"))
    return keyed.join(per, "__key", "left")


def repeat_report(docs: DataFrame, *, id: str = "doc_id", text: str = "text", params: RepeatParams = RepeatParams()) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for cols, texts in chunks(batches, "__text", 1 << 22):
            cuts = [_cut(t, m or [], False) for t, m in zip(texts, cols["__marks"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["id"], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()), pa.array([c[2] for c in cuts], pa.int64()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cuts])],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = marked(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), "id", "text", params).select(F.col("__row")["id"].alias("id"), "__marks", "__text")
    return rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id)


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", params: RepeatParams = RepeatParams()) -> DataFrame:
    """docs with the repeats cut from their texts, up to whole characters; all columns are kept."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([t if m is None else _cut(t.encode("utf-8"), [{"a": x["a"], "b": x["b"]} for x in m], True)[0].decode("utf-8") for t, m in zip(texts, marks)])

    rows = marked(docs, id, text, params)
    return _unpacked(rows, docs.columns, text, F.when(F.col("__marks").isNull(), F.col("__row")[text]).otherwise(cut("__text", "__marks")))


CODE = 4  # bytes that stand for a word


def _spell(batches):
    """Texts as one code of CODE bytes for each word."""
    schema = pa.schema([("key", pa.int64()), ("text", pa.binary())])
    digest = xxhash.xxh3_64_intdigest
    for cols, texts in chunks(batches, "text", 1 << 22):
        coded = [np.fromiter(map(digest, t.split()), np.uint64, -1).astype(np.uint32).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(cols["key"], pa.int64()), pa.array(coded, pa.binary())], schema=schema)


def word_repeats(rows: DataFrame, words: int) -> DataFrame:
    """(key, a, b): ranges of words that repeat, from (key, text); a range has `words` at least.

    A match that starts inside a code holds fewer whole words or starts one code later as well, so ranges
    shrink to whole codes and those that get too short are none.
    """
    length = words * CODE
    coded = materialize(rows.mapInArrow(_spell, "key long, text binary"), "words")
    found = repeats(coded, RepeatParams(length=length, gram=length * 5 // 16))
    whole = found.select("key", F.ceil(F.col("a") / CODE).alias("a"), F.floor(F.col("b") / CODE).alias("b"))
    return whole.where(F.col("b") - F.col("a") >= words)


def remove_passages(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = 51, params: RepeatParams = RepeatParams()) -> DataFrame:
    """As remove_repeats, but what goes is every repeat of `words` words, whatever its bytes and white space, and every one that remove_repeats cuts."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, marks: pd.Series, word_marks: pd.Series) -> pd.Series:
        out = []
        for t, m, w in zip(texts, marks, word_marks):
            raw = t.encode("utf-8")
            spans = [] if m is None else [{"a": x["a"], "b": x["b"]} for x in m]
            if w is not None and len(w):
                starts = [x.start() for x in re.finditer(rb"\S+", raw)] + [len(raw)]
                spans += [{"a": starts[x["a"]], "b": starts[x["b"]]} for x in w]
            out.append(_cut(raw, spans, True)[0].decode("utf-8") if spans else t)
        return pd.Series(out)

    rows = marked(docs, id, text, params)
    found = word_repeats(_keyed(docs, id, text).select(F.col("__key").alias("key"), F.col("__text").alias("text")), words)
    per = found.distinct().groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("a", "b")).alias("__words"))
    rows = rows.join(per, "__key", "left")
    none = F.col("__marks").isNull() & F.col("__words").isNull()
    return _unpacked(rows, docs.columns, text, F.when(none, F.col("__row")[text]).otherwise(cut("__text", "__marks", "__words")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))
