"""Language-model scoring by online logistic context mixing.

A text is read as lower-cased words, each followed by a space, and one end symbol. Every byte is
coded as the path to its leaf in a binary tree, and every bit of that path is predicted from
hashed contexts: the last 3 bytes under the text's topic, the last 5 bytes, the word so far under the
topic, and the word before with the word so far. They cross words. The topic is the class
of a mixture of unigrams over the commonest words that the words up to here (in steps of 32 bytes) make likeliest.

The predictors' log odds are mixed with weights that a gate chooses by how often the two last contexts have been
seen. Each text starts from the same weights and refines them as it goes, one factor a predictor, after
every `round` bytes. The score is the log10 probability of the whole text; bits per byte follow from it. A text
that was learned from is scored with its own occurrence of each context taken out of the counts.

Counts come from all training texts: integers, added up slot by slot, so they depend neither on the order of rows nor on
partitions. Tables have about two slots for each counted byte, up to 2^table_bits, where contexts begin to share slots; what meets
in a shuffle is slots, of which none can be hot. The tree, topics and starting weights come from all training texts too, by
sums of whole numbers: the tree from their bytes; the topics from the counts of the commonest words in each text, passed over until no text
changes its class (`topic_steps` times at most); the starting weights from every bit of every text, told apart by
the classes of the predictors' log odds. Word counts for the base
score are exact at any size: frequent words (at most `head_words` of them) travel as a broadcast
table of bounded size, and only words outside it are joined by hash.

Defined cases: a null text is an empty one (one end token); repeated rows and repeated or null ids are
scored each by itself; an empty table gives no rows; with no training rows N and V are 0 and nothing
is known; a text of any length goes through in windows that carry their state along; columns other than the id, the text
and the training flag are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, crc_mod, materialize, table, text_or_empty

END = b"\n"  # cannot be part of a word
ORDERS = 4
LEVELS = 8
GATES = LEVELS * LEVELS
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LEAD = 64  # bytes that contexts look back at most, a word's own at most half of them
STEP = 32  # bytes from one look at the topic to the next
LINE = 5  # bits: the slots of one context lie together, in one line of memory
PASS = 1 << 16  # bytes of text that go through the arrays at a time
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[0] = 0  # what stands before a text adds nothing


@dataclass(frozen=True)
class MixingParams:
    table_bits: int = 21  # most slots of a predictor's table, as a power of two
    head_words: int = 1_000_000  # most words in the broadcast table
    round: int = 1024  # bytes between two refinements of a text's weights
    window: int = 1 << 15  # bytes of a text that are in memory at a time; a multiple of the round
    text_rate: float = 3.0
    topics: int = 8
    topic_words: int = 512
    topic_steps: int = 20  # most passes over the profiles of texts
    starts: int = 8  # of topics that are fitted on a list of texts
    task_bytes: int = 1 << 26  # of text that a task counts at least


def byte_tree(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree over bytes by how often each has been seen, so that common letters have short paths.

    Returns path lengths, path starts, and the nodes and bits of all paths.
    """
    heap = [(float(n) + 0.5, b, b) for b, n in enumerate(seen)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    for node in range(256, 511):
        (wa, _, a), (wb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (node, 0), (node, 1)
        heapq.heappush(heap, (wa + wb, node, node))
    nodes, bits, length = [], [], []
    for b in range(256):
        path, at = [], b
        while at in parent:
            path.append(parent[at])
            at = parent[at][0]
        length.append(len(path))
        nodes += [n for n, _ in reversed(path)]
        bits += [x for _, x in reversed(path)]
    size = np.array(length, np.int64)
    # later nodes are commoner: the commonest lie in a context's line, the others at some distance from it
    place = 510 - np.array(nodes, np.int64)
    place = np.where(place < 1 << LINE, place, (place * 0x9E3779B1 & 0xFFFFFFFF) >> 20)
    return size, np.concatenate([[0], np.cumsum(size)[:-1]]), place, np.array(bits, bool)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    run = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
    with np.errstate(over="ignore"):
        return run(ODD), run(np.uint64(pow(int(ODD), -1, 1 << 64)))


class Hashes:
    """64-bit hashes of any span of some bytes, by running sums."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _powers(1 << max(16, len(raw).bit_length()))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE.take(raw) * power[: len(raw)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def back(self, n: int) -> np.ndarray:
        """Of the n bytes before each byte."""
        size = len(self.sums) - 1
        span = np.zeros(size, np.uint64)
        if size > n:
            with np.errstate(over="ignore"):
                np.subtract(self.sums[n:-1], self.sums[: size - n], out=span[n:])
                span[n:] *= self.inverse[: size - n]
        return span

    def since(self, begin: np.ndarray, first: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
        """Of what stands before each byte, from the begin of its run on, `most` bytes at most. Runs follow each other: where they are, and their lengths."""
        with np.errstate(over="ignore"):
            span = self.sums[:-1] - np.repeat(self.sums[begin], length)
            span *= np.repeat(self.inverse[begin], length)
        far = np.maximum(first, begin + most + 1)
        if (n := np.maximum(first + length - far, 0)).any():
            at = np.repeat(far - np.cumsum(n) + n, n) + np.arange(n.sum())
            span[at] = self.of(at - most, at)
        return span


@dataclass(frozen=True)
class Topics:
    """Classes of texts by their commonest words: the words' hashes in order, and integer log weights, a row a word."""

    words: np.ndarray
    weights: np.ndarray


def spelled(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" " + END if words else END


def byte_counts(texts: list[bytes]) -> np.ndarray:
    return np.bincount(np.frombuffer(b"".join(spelled(t.lower().split()) for t in texts), np.uint8), minlength=256)


def ended_words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a word begins at each byte (the first one of a lane too), and the start and end of all words that end."""
    before = np.zeros(len(raw), bool)
    gap = (raw == 32) | (raw == 10)
    before[1:] = gap[:-1]
    before[starts] = True
    first = np.flatnonzero(before)
    last = np.append(first[1:], len(raw)) - 1
    whole = gap[last]
    return before, first[whole], last[whole]


def word_hashes(h: Hashes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h.of(np.maximum(first, last - LEAD // 2), last) * MIX


def fit_topics(texts: list[bytes], params: MixingParams) -> Topics:
    """A mixture of unigrams over the commonest words of some texts, by expectation and maximisation from far-apart texts, the likeliest of some starts."""
    none = Topics(np.zeros(0, np.uint64), np.zeros((0, params.topics), np.int64))
    streams = [spelled(t.lower().split()) for t in texts]
    if not streams:
        return none
    raw = np.frombuffer(b"".join(streams), np.uint8)
    ends = np.cumsum([len(x) for x in streams])
    _, first, last = ended_words(raw, np.concatenate([[0], ends[:-1]]))
    h = word_hashes(Hashes(raw), first, last)
    kinds, times = np.unique(h, return_counts=True)
    top = np.sort(kinds[np.lexsort((kinds, -times))[: params.topic_words]])
    at = np.minimum(np.searchsorted(top, h), len(top) - 1)
    ok = top[at] == h
    text = np.searchsorted(ends, first, "right")
    seen = np.bincount(text[ok] * len(top) + at[ok], minlength=len(streams) * len(top)).reshape(len(streams), len(top)).astype(float)
    unit = np.sqrt(seen)
    size = np.linalg.norm(unit, axis=1)
    unit[size > 0] /= size[size > 0, None]
    logs, most = None, -np.inf
    for begin in np.argsort(-size, kind="stable")[: params.starts]:
        centres = [unit[begin]]
        for _ in range(params.topics - 1):
            like = np.max(unit @ np.array(centres).T, axis=1)
            like[size < np.median(size)] = np.inf
            centres.append(unit[np.argmin(like)])
        share = np.zeros((len(streams), params.topics))
        share[np.arange(len(streams)), np.argmax(unit @ np.array(centres).T, axis=1)] = 1
        for _ in range(30):
            words = share.T @ seen + 0.1
            now = np.log(words / words.sum(axis=1, keepdims=True))
            each = seen @ now.T + np.log((share.sum(axis=0) + 1) / (len(streams) + params.topics))
            share = np.exp(each - each.max(axis=1, keepdims=True))
            total = each.max(axis=1).sum() + np.log(share.sum(axis=1)).sum()
            share /= share.sum(axis=1, keepdims=True)
        if total > most:
            logs, most = now, total
    return Topics(top, np.rint(logs.T * 1024).astype(np.int64))


@dataclass
class Window:
    """Windows of several texts, one after the other, as bytes and their contexts."""

    contexts: list[np.ndarray]  # of each predictor, a byte: where the slots of its context lie
    code: np.ndarray  # the bytes themselves
    text: np.ndarray  # of each piece (a round of a text)
    edge: np.ndarray  # where the bits of each piece begin, and their end


class Coder:
    """Turns texts into coded bits and the table slots of their contexts."""

    def __init__(self, table_bits: int, topics: Topics, tree: tuple, params: MixingParams):
        self.bits, self.topics, self.tree, self.params = table_bits, topics, tree, params
        node, bit = tree[2].astype(np.uint64), tree[3]
        twice = node << np.uint64(1) | bit
        # of each byte its path: nodes, twice its nodes and the bits, both in either half of a number; and bits alone
        self.nodes, self.steps = (self._paths(x | x << np.uint64(32)) for x in (node, twice))
        self.ones = self._paths(bit.astype(np.uint16) << np.uint16(12))

    def _paths(self, values: np.ndarray) -> pa.Array:
        return pa.array([values[a : a + n].tobytes() for a, n in zip(self.tree[1].tolist(), self.tree[0].tolist())], pa.binary())

    def along(self, paths: pa.Array, code: np.ndarray, kind: type) -> np.ndarray:
        """What paths have of all bytes, one after the other."""
        out = paths.take(pa.array(code))
        ends = np.frombuffer(out.buffers()[1], np.int32, len(code) + 1)
        return np.frombuffer(out.buffers()[2], kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, ends[0])

    def spread(self, contexts: list[np.ndarray], code: np.ndarray, paths: pa.Array, shift: int = 0) -> list[np.ndarray]:
        """From bytes to bits: of each predictor its shifted context with what paths have for each bit."""
        size, step, slots = self.tree[0].take(code), self.along(paths, code, np.intp), []
        # two contexts are spread at a time, as halves of a number
        for c, other in zip(contexts[::2], [*contexts[1::2], 0]):
            both = np.repeat((other << 32 | c) << shift, size)
            both ^= step
            slots.append(both & 0xFFFFFFFF)
            if len(contexts) > 1:
                both >>= 32
                slots.append(both)
        return slots

    def windows(self, streams: list[bytes]) -> Iterator[Window]:
        """First windows of all texts, then second ones of longer texts, and so on."""
        params, size = self.params, np.array([len(x) for x in streams], np.int64)
        sums, seen = np.zeros((len(streams), params.topics), np.int64), np.zeros(len(streams), np.int64)
        for at in range(0, int(size.max(initial=0)), params.window):
            live = np.flatnonzero(size > at)
            # what contexts look back to: nothing at the start of a text
            parts = [bytes(LEAD) + streams[i][: params.window] if not at else streams[i][at - LEAD : at + params.window] for i in live]
            yield self._window(parts, live, sums, seen, at == 0)

    def _topics(self, h: Hashes, first: np.ndarray, last: np.ndarray, start: np.ndarray, size: np.ndarray, live: np.ndarray, sums: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The topic of each step of bytes of each text, from the words that ended before it; 0 where none has."""
        steps = -(-size // STEP)
        base = np.cumsum(steps) - steps
        if not len(self.topics.words):
            return np.zeros(steps.sum(), np.uint64)
        w = word_hashes(h, first, last)
        k = np.searchsorted(self.topics.words, w)
        known = np.flatnonzero(self.topics.words.take(k, mode="clip") == w)
        k, last = k[known], last[known]
        # words that ended within a text, what was looked back to left out
        low, high = np.searchsorted(last, start + LEAD), np.searchsorted(last, start + LEAD + size)
        n = high - low
        pick = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        step = np.repeat(base, n) + ((last[pick] - np.repeat(start + LEAD, n)) >> STEP.bit_length() - 1)
        run = np.zeros((len(step) + 1, self.params.topics), np.int64)
        np.cumsum(self.topics.weights[k[pick]], axis=0, out=run[1:])
        edge = np.append(0, np.cumsum(n))
        upto = np.append(0, np.cumsum(np.bincount(step, minlength=steps.sum()))[:-1])
        some = upto - np.repeat(edge[:-1] - seen[live], steps)
        top = np.where(some > 0, np.argmax(run[upto] - np.repeat(run[edge[:-1]] - sums[live], steps, axis=0), axis=1) + 1, 0)
        sums[live] += run[edge[1:]] - run[edge[:-1]]
        seen[live] += edge[1:] - edge[:-1]
        return top.astype(np.uint64)

    def _window(self, parts: list[bytes], live: np.ndarray, sums: np.ndarray, seen: np.ndarray, begins: bool) -> Window:
        raw = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(x) for x in parts], np.int64) - LEAD
        start = np.cumsum(size + LEAD) - size - LEAD
        h = Hashes(raw)
        before, first, last = ended_words(raw, start)
        if begins:
            before[start + LEAD] = True
            first = first + LEAD * np.isin(first, start)
        top = self._topics(h, first, last, start, size, live, sums, seen)
        stop = start + LEAD + size
        body = lambda x: np.concatenate([x[a:b] for a, b in zip((start + LEAD).tolist(), stop.tolist())])
        steps = -(-size // STEP)
        wide = np.full(int(steps.sum()), STEP)
        wide[np.cumsum(steps) - 1] = size - (steps - 1) * STEP
        topic = np.repeat(top * ODD, wide)
        starts = np.flatnonzero(before)
        length = np.diff(starts, append=len(raw))
        earlier = np.concatenate([starts[:1], starts[:-1]])
        contexts = [body(x) for x in (h.back(3), h.back(5), h.since(starts, starts, length, LEAD // 2), h.since(earlier, starts, length, LEAD))]
        contexts[0] ^= topic
        contexts[2] ^= topic
        with np.errstate(over="ignore"):
            for k, c in enumerate(contexts):
                c += np.uint64(k + 1)
                c *= MIX
                c >>= np.uint64(64 - self.bits)
        code = body(raw)
        total = np.zeros(len(code) + 1, np.int64)
        np.cumsum(self.tree[0].take(code), out=total[1:])
        # pieces of a round
        rounds = -(-size // self.params.round)
        text = np.repeat(np.arange(len(parts)), rounds)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(rounds) - rounds, rounds)
        begin = (np.cumsum(size) - size)[text] + turn * self.params.round
        return Window([c.view(np.intp) for c in contexts], code, live[text], total[np.append(begin, len(code))])


def quantized(counts: np.ndarray) -> np.ndarray:
    """Counts in six bits: exact up to 15, then 6 steps for each doubling."""
    return np.where(counts < 16, counts, np.minimum(16 + np.rint(6 * np.log2(np.maximum(counts, 1) / 16)), 63)).astype(np.uint16)


def packed(counts: np.ndarray) -> np.ndarray:
    """(slots, 2) counts of zeros and ones as one 12-bit state a slot. Large counts keep their ratio."""
    most = 16 * 2 ** (47 / 6)
    scale = np.maximum(counts.max(axis=1, keepdims=True) / most, 1)
    q = quantized(counts / scale)
    return q[:, 0] << 6 | q[:, 1]


@lru_cache(maxsize=1)
def lookups() -> tuple[np.ndarray, np.ndarray]:
    """By own occurrence (out or not), bit and state: the log odds towards the bit, and how often the context has been seen, in classes."""
    value = np.arange(64, dtype=np.float64)
    value[16:] = 16 * 2 ** ((value[16:] - 16) / 6)
    zeros, ones = np.repeat(value, 64), np.tile(value, 64)
    odds, level = [], []
    for own in (0, 1):
        for bit in (0, 1):
            n0, n1 = np.maximum(zeros - own * (1 - bit), 0), np.maximum(ones - own * bit, 0)
            odds.append((2 * bit - 1) * np.log((n1 + 0.3) / (n0 + 0.3)))
            level.append(np.minimum(np.ceil(np.log2(n0 + n1 + 1)), LEVELS - 1))
    return np.concatenate(odds).astype(np.float32), np.concatenate(level).astype(np.intp)


class Scorer:
    """Scores texts under a trained table; a text's score depends on nothing but it, the table and whether it was learned from."""

    def __init__(self, states: np.ndarray, weights: np.ndarray, coder: Coder):
        self.states, self.coder = states, coder
        self.weights = np.ascontiguousarray(weights.T, np.float32)

    def inputs(self, window: Window, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The predictors' log odds towards the bits that are there, and the gates. own: of each text, whether it was learned from."""
        odds, level = lookups()
        slots = self.coder.spread(window.contexts, window.code, self.coder.nodes)
        base = np.repeat(own[window.text].astype(np.uint16) << np.uint16(13), np.diff(window.edge))
        base |= self.coder.along(self.coder.ones, window.code, np.uint16)
        x = np.empty((ORDERS, len(base)), np.float32)
        gate = np.zeros(len(base), np.intp)
        for k in range(ORDERS):
            state = self.states[k].take(slots[k], mode="clip")
            state |= base
            state = state.astype(np.intp)
            odds.take(state, out=x[k], mode="clip")
            if k >= ORDERS - 2:
                gate *= LEVELS
                gate += level.take(state, mode="clip")
        return x, gate

    def score(self, texts: list[bytes], learned: np.ndarray) -> np.ndarray:
        """Natural log probabilities of spelled texts."""
        total = np.zeros(len(texts))
        factors = np.ones((len(texts), ORDERS), np.float32)
        rate, most, least, top = map(np.float32, (self.coder.params.text_rate, 20, 0.2, 3))
        for window in self.coder.windows(texts):
            x, gate = self.inputs(window, learned)
            for k in range(ORDERS):
                x[k] *= self.weights[k].take(gate, mode="clip")
            edge, odds = window.edge.tolist(), np.empty(x.shape[1], np.float32)
            for i, a, b in zip(window.text.tolist(), edge, edge[1:]):
                part, factor, one = x[:, a:b], factors[i], odds[a:b]
                e = -factor @ part
                np.minimum(e, most, out=e)
                np.maximum(e, -most, out=e)
                np.exp(e, out=e)
                np.add(e, 1, out=one)
                e /= one
                factors[i] = np.minimum(np.maximum(factor + part @ e * (rate / np.float32(b - a)), least), top)
            np.log(odds, out=odds)
            np.subtract.at(total, window.text, np.add.reduceat(odds, window.edge[:-1], dtype=np.float64))
        return total


BINS = np.array([-6, -4, -2.5, -1.5, -0.7, -0.2, 0.2, 0.7, 1.5, 2.2, 3, 4, 5, 6, 7])
PARTS = np.array([-0.5, -0.1, 0.1, 0.5, 0.85])
COARSE, FINE = len(BINS) + 1, LEVELS * (len(PARTS) + 1)
KINDS = (COARSE, COARSE, FINE, FINE)  # classes of log odds of each predictor, for the last two with their levels
GATE = (np.arange(FINE)[:, None] // (len(PARTS) + 1) * LEVELS + np.arange(FINE) // (len(PARTS) + 1)).ravel()
UNIT = 1 << 16  # what the bits of one gate in one piece of a text weigh together, about


@lru_cache(maxsize=1)
def odds_classes() -> tuple[np.ndarray, np.ndarray]:
    """By own occurrence, bit and state: the class of the log odds of the first two predictors, and of the last two."""
    odds, level = lookups()
    most = np.array([max(odds[level == k].max(), 1) for k in range(LEVELS)])
    return np.searchsorted(BINS, odds), level * (len(PARTS) + 1) + np.searchsorted(PARTS, odds / most[level])


def kinds_of(states: np.ndarray) -> np.ndarray:
    """Of each predictor the class of its log odds in each slot, for a zero and for a one, its own occurrence taken out; the first one's in steps of COARSE."""
    out = np.empty((ORDERS, 2 * states.shape[1]), np.uint8)
    for k in range(ORDERS):
        kinds = (odds_classes()[k >= ORDERS - 2] * (1 if k else COARSE)).astype(np.uint8)
        for bit in (0, 1):
            out[k, bit::2] = kinds[(2 + bit) << 12 :].take(states[k])
    return out


def _count_classes(kinds, coder: Coder):
    """How much the bits weigh whose log odds of all predictors fall into the same classes: (cell, n). Texts were learned from.

    The bits of a gate in a piece of a text weigh the same together, however many they are; weights are whole numbers.
    """
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches):
        table, gates = kinds.value, GATE.astype(np.uint8)
        total = np.zeros(math.prod(KINDS), np.int64)
        for _, texts in chunks(batches, "text", PASS):
            for window in coder.windows([spelled(t.lower().split()) for t in texts]):
                slots = coder.spread(window.contexts, window.code, coder.steps, 1)
                first, second, third, fourth = (table[k].take(slots[k], mode="clip") for k in range(ORDERS))
                last = third.astype(np.intp)
                last *= FINE
                last += fourth
                at = np.repeat(np.arange(len(window.text)) * GATES, np.diff(window.edge))
                at += gates.take(last, mode="clip")
                times = np.bincount(at, minlength=len(window.text) * GATES)
                first += second
                cell = first.astype(np.intp)
                cell *= FINE * FINE
                cell += last
                np.add.at(total, cell, (UNIT // (times + 20)).take(at, mode="clip"))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=schema)

    return run


def class_odds(states: np.ndarray) -> list[np.ndarray]:
    """The mean log odds of each class of each predictor, over all that was counted."""
    odds, _ = lookups()
    value = np.arange(64, dtype=np.float64)
    value[16:] = 16 * 2 ** ((value[16:] - 16) / 6)
    out = []
    for k in range(ORDERS):
        times = np.bincount(states[k], minlength=4096)
        mass = np.concatenate([times * np.repeat(value, 64), times * np.tile(value, 64)]) + 1e-9
        kind = odds_classes()[k >= ORDERS - 2][2 << 12 :]
        total = np.bincount(kind, mass, KINDS[k])
        out.append(np.bincount(kind, mass * odds[2 << 12 :], KINDS[k]) / np.maximum(total, 1e-12))
    return out


def fit_weights(cell: np.ndarray, n: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
    """Gated weights: of each gate those that make its bits likeliest, by Newton's method, with a pull towards 0.3 as of 50 pieces."""
    n = n / UNIT
    kinds = np.stack(np.unravel_index(cell, KINDS))
    x = np.stack([odds[k][kinds[k]] for k in range(ORDERS)], 1)
    gate = GATE[kinds[2] * FINE + kinds[3]]
    weights = np.full((GATES, ORDERS), 0.3)
    for g in np.unique(gate):
        part, times, w = x[gate == g], n[gate == g], weights[g]
        for _ in range(30):
            miss = 1 / (1 + np.exp(np.clip(part @ w, -30, 30)))
            slope = part.T @ (times * miss) - 50 * (w - 0.3)
            curve = (part * (times * miss * (1 - miss))[:, None]).T @ part + 50 * np.eye(ORDERS)
            w = np.clip(w + np.clip(np.linalg.solve(curve, slope), -0.25, 0.25), -1, 3)
        weights[g] = w
    return weights


def train_weights(docs: DataFrame, states: np.ndarray, coder: Coder, text: str = "text") -> np.ndarray:
    """Gated weights from all bits of all texts that were learned from, each with its own occurrence taken out."""
    shared = docs.sparkSession.sparkContext.broadcast(kinds_of(states))
    cells = docs.select(text_or_empty(text).alias("text")).mapInArrow(_count_classes(shared, coder), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    return fit_weights(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), class_odds(states))


def token_hashes(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of spelled texts, end tokens included: hash, bytes with what follows, and the number of each text's tokens; and the hash that topics know a word by, 0 for an end."""
    raw = np.frombuffer(b"".join(streams), np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    # an end token is its own byte, the others stop before a space
    begin, stop = np.concatenate([[0], ends[:-1] + 1]), ends + (raw[ends] == 10)
    sums = Hashes(raw)
    with np.errstate(over="ignore"):
        h = (sums.of(begin, stop) + (stop - begin).astype(np.uint64) * ODD) * MIX
        h ^= h >> np.uint64(32)
    text = np.flatnonzero(raw[ends] == 10) + 1
    return h * MIX, ends - begin + 1, np.diff(text, prepend=0), word_hashes(sums, begin, ends)


def summed(h: np.ndarray, n: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes with their sums of n, and what else they stand for."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n[order], first) if len(h) else n, *(x[order][first] for x in rest)


def _count_tokens(batches):
    """Rows (h, n, size, word) of tokens, and rows (byte, n, 0, 0) of bytes."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("word", pa.int64())])
    out = lambda h, n, size, word: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(size), pa.array(word.view(np.int64))], schema=schema)
    parts: list[tuple] = []
    held, seen = 0, np.zeros(256, np.int64)
    for _, texts in chunks(batches, "text", 1 << 20):
        streams = [spelled(t.lower().split()) for t in texts]
        seen += np.bincount(np.frombuffer(b"".join(streams), np.uint8), minlength=256)
        h, size, _, word = token_hashes(streams)
        parts.append(summed(h, np.ones(len(h), np.int64), size, word))
        held += len(parts[-1][0])
        if held > 1_500_000:
            parts = [summed(*map(np.concatenate, zip(*parts)))]
            held = len(parts[0][0])
            if held > 750_000:
                yield out(*parts[0])
                parts, held = [], 0
    if parts:
        yield out(*summed(*map(np.concatenate, zip(*parts))))
    some = np.flatnonzero(seen)
    yield out(some.astype(np.uint64), seen[some], np.zeros(len(some), np.int64), np.zeros(len(some), np.uint64))


def _profiles(top: np.ndarray):
    """How often each of the words in top stands in each text: rows of some texts (texts, text, word, n), zeros left out."""
    schema = pa.schema([("texts", pa.int64()), ("text", pa.binary()), ("word", pa.binary()), ("n", pa.binary())])

    def run(batches):
        for _, texts in chunks(batches, "text", 1 << 20):
            _, _, count, word = token_hashes([spelled(t.lower().split()) for t in texts])
            at = np.minimum(np.searchsorted(top, word), len(top) - 1)
            known = top[at] == word
            cell, n = np.unique(np.repeat(np.arange(len(texts)), count)[known] * len(top) + at[known], return_counts=True)
            parts = (cell // len(top)).astype(np.int32), (cell % len(top)).astype(np.uint16), n.astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"texts": [len(texts)], "text": [parts[0].tobytes()], "word": [parts[1].tobytes()], "n": [parts[2].tobytes()]}, schema)

    return run


def _seen(batches, words: int) -> Iterator[np.ndarray]:
    """Profiles as (texts, words) counts: whole numbers, whose sums no order of adding changes. Each holds until the next is asked for."""
    room = np.zeros(0)
    for batch in batches:
        for texts, *parts in zip(*(batch.column(c).to_pylist() for c in ("texts", "text", "word", "n"))):
            text, word, n = (np.frombuffer(x, t) for x, t in zip(parts, (np.int32, np.uint16, np.uint32)))
            if len(room) < texts * words:
                room = np.zeros(texts * words)
            at = text * np.intp(words) + word
            room[at] = n
            yield room[: texts * words].reshape(texts, words)
            room[at] = 0


def _alike(seen: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cosines of which words texts have with which words centres have."""
    there = (seen > 0).astype(np.float64)
    size = np.outer(there.sum(axis=1), centres.sum(axis=1))
    return (there @ centres.T) / np.sqrt(np.maximum(size, 1))


def _farthest(centres: np.ndarray, words: int, least: float):
    """The text least like all centres among those with enough words, or with no centre the one of most words: (likeness, its words as bits)."""
    schema = pa.schema([("like", pa.float64()), ("words", pa.binary())])

    def run(batches):
        best = None
        for seen in _seen(batches, words):
            size = (seen > 0).sum(axis=1)
            like = _alike(seen, centres).max(axis=1) if len(centres) else -size.astype(np.float64)
            like[size < max(least, 1)] = np.inf
            for i in np.flatnonzero(like == like.min()) if np.isfinite(like.min()) else []:
                now = float(like[i]), np.packbits(seen[i] > 0).tobytes()
                best = now if best is None else min(best, now)
        if best:
            yield pa.RecordBatch.from_pydict({"like": [best[0]], "words": [best[1]]}, schema)

    return run


def _shared_out(words: int, kinds: int, choose):
    """Sums of the counts of the texts of each class: (cell, n), after them the classes' numbers of texts."""
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros((kinds, words + 1), np.int64)
        for seen in _seen(batches, words):
            of = np.eye(kinds)[np.argmax(choose(seen), axis=1)]
            total[:, :words] += (of.T @ seen).astype(np.int64)
            total[:, words] += of.sum(axis=0).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], schema=schema)

    return run


def train_topics(docs: DataFrame, vocab: DataFrame, params: MixingParams, text: str = "text") -> Topics:
    """Topics of all texts: classes of a mixture of unigrams over the commonest words, each text in its likeliest, from far-apart texts.

    All sums are of whole numbers, so no partitioning changes the topics.
    """
    none = Topics(np.zeros(0, np.uint64), np.zeros((0, params.topics), np.int64))
    common = vocab.where("word <> 0").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(params.topic_words)
    top = np.sort(np.array([r["word"] for r in common.collect()], np.int64).view(np.uint64))
    if not len(top):
        return none
    words, kinds = len(top), params.topics
    profiles = materialize(docs.select(text_or_empty(text).alias("text")).mapInArrow(_profiles(top), "texts long, text binary, word binary, n binary"), "profiles")
    size = profiles.agg(F.sum(F.octet_length("word") / 2).alias("words"), F.sum("texts").alias("texts")).first()
    centres, texts = np.zeros((0, words)), size["texts"]
    for _ in range(kinds):
        far = profiles.mapInArrow(_farthest(centres, words, size["words"] / texts), "like double, words binary").orderBy("like", "words").limit(1).collect()
        if not far:
            return none
        centres = np.concatenate([centres, np.unpackbits(np.frombuffer(far[0]["words"], np.uint8), count=words)[None].astype(np.float64)])

    def shared_out(choose) -> np.ndarray:
        total = np.zeros(kinds * (words + 1), np.int64)
        for r in profiles.mapInArrow(_shared_out(words, kinds, choose), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            total[r["cell"]] = r["n"]
        return total.reshape(kinds, words + 1)

    total = shared_out(lambda seen: _alike(seen, centres))
    for _ in range(params.topic_steps):
        logs, prior = _class_logs(total, texts)
        was, total = total, shared_out(lambda seen, logs=logs, prior=prior: seen @ logs.T + prior)
        if (was == total).all():
            break
    return Topics(top, _class_logs(total, texts)[0].T)


def _class_logs(total: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer log weights of words, and of classes."""
    words = total[:, :-1] + 0.1
    logs = np.rint(np.log(words / words.sum(axis=1, keepdims=True)) * 1024).astype(np.int64)
    return logs, np.rint(np.log((total[:, -1] + 1) / (texts + len(total))) * 1024).astype(np.int64)


CHUNK = 1 << 14


def _narrow(counts: np.ndarray) -> bytes:
    """A piece of counts in as few bytes as they need: as it is, or only the slots that were met, where these are few."""
    some = np.flatnonzero(counts)
    size = 1 if (most := counts.max()) < 1 << 8 else 2 if most < 1 << 16 else 4
    kind = f"<u{size}"
    if len(some) * (2 + size) >= len(counts) * size:
        return bytes([size]) + counts.astype(kind).tobytes()
    return bytes([size | 8]) + some.astype("<u2").tobytes() + counts[some].astype(kind).tobytes()


def _widened(held: bytes) -> np.ndarray:
    size, out = held[0] & 7, np.zeros(CHUNK, np.int64)
    if held[0] & 8:
        n = (len(held) - 1) // (2 + size)
        out[np.frombuffer(held, "<u2", n, 1)] = np.frombuffer(held, f"<u{size}", n, 1 + 2 * n)
        return out
    out[:] = np.frombuffer(held, f"<u{size}", CHUNK, 1)
    return out


HELD = 1 << 21  # bytes whose contexts a task holds before it counts them


def add_bits(counts: np.ndarray, keys: np.ndarray, coder: Coder) -> None:
    """Adds the bits of bytes to the counts of a predictor, equal bytes in equal contexts together. keys: contexts and bytes, sorted in place."""
    keys.sort()
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    times = np.diff(first, append=len(keys)).astype(np.uint32)
    keys = keys[first]
    for a in range(0, len(keys), 1 << 15):
        part = keys[a : a + (1 << 15)]
        code = (part & 255).astype(np.uint8)
        (slots,) = coder.spread([(part >> 8).astype(np.intp)], code, coder.steps, 1)
        np.add.at(counts, slots, np.repeat(times[a : a + (1 << 15)], coder.tree[0].take(code)))


def _count_bits(coder: Coder):
    schema = pa.schema([("piece", pa.int64()), ("counts", pa.binary())])
    kind = np.uint32 if coder.bits <= 24 else np.uint64

    def run(batches):
        counts, keys, held = None, [[] for _ in range(ORDERS)], 0

        def add():
            for k in range(ORDERS):
                add_bits(counts[k], np.concatenate(keys[k]), coder)
                keys[k].clear()

        for _, texts in chunks(batches, "text", PASS):
            if counts is None:
                counts = np.zeros((ORDERS, 2 << coder.bits), np.uint32)
            for window in coder.windows([spelled(t.lower().split()) for t in texts]):
                for k in range(ORDERS):
                    keys[k].append(window.contexts[k].astype(kind) << kind(8) | window.code)
                held += len(window.code)
                if held >= HELD:
                    add()
                    held = 0
        if held:
            add()
        for k in range(ORDERS if counts is not None else 0):
            for c in range(0, counts.shape[1], CHUNK):
                piece = counts[k, c : c + CHUNK]
                if piece.any():
                    yield pa.RecordBatch.from_pydict({"piece": [k << 32 | c], "counts": [_narrow(piece)]}, schema)

    return run


def _add_counts(group: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for x in group.column("counts").to_pylist():
        total += _widened(x)
    return pa.table({"piece": group.column("piece").slice(0, 1), "states": pa.array([packed(total.reshape(-1, 2)).tobytes()], pa.binary())})


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, n, size, word) of the distinct tokens of all texts, the end token included: hash, count, bytes and the hash for topics; counted before the shuffle, which spreads hot words.

    Rows of size 0 are bytes with their counts.
    """
    parts = docs.select(text_or_empty(text).alias("text")).mapInArrow(_count_tokens, "h long, n long, size long, word long")
    return parts.groupBy("h", (F.col("size") == 0).alias("byte")).agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.max("word").alias("word")).drop("byte")


def head_cut(vocab: DataFrame, most: int) -> int:
    """The smallest count such that at most `most` words have it or more."""
    # counts below 4096 one by one, larger ones by powers of two: a bounded number of classes
    kind = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    sizes = sorted(((r["k"], r["c"]) for r in vocab.groupBy(kind.alias("k")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, cut = 0, 1 << 62
    for k, c in sizes:
        if total + c > most:
            break
        total, cut = total + c, k
    return cut


def train_states(docs: DataFrame, coder: Coder, text: str = "text") -> np.ndarray:
    """The packed tables of counts of all texts; ORDERS << bits numbers in all, whatever the corpus."""
    pieces = docs.select(text_or_empty(text).alias("text")).mapInArrow(_count_bits(coder), "piece long, counts binary").groupBy("piece").applyInArrow(_add_counts, "piece long, states binary")
    states = np.zeros((ORDERS, 1 << coder.bits), np.uint16)
    for r in pieces.toLocalIterator():
        k, c = r["piece"] >> 32, (r["piece"] & 0xFFFFFFFF) // 2
        part = np.frombuffer(r["states"], np.uint16)
        states[k, c : c + len(part)] = part
    return states


def score_documents(docs: DataFrame, train: str, *, id: str = "doc_id", text: str = "text", params: MixingParams = MixingParams()) -> DataFrame:
    """One row a document: id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    train names a boolean column: the rows to learn from.
    """
    spark = docs.sparkSession
    learn = docs.where(F.col(train))
    both = materialize(vocabulary(learn, text), "vocabulary")
    vocab = both.where("size > 0")
    sums = vocab.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.col("n") * F.col("size")).alias("size")).first()
    all_tokens, distinct, size = sums["n"] or 0, sums["v"], sums["size"] or 0
    seen = np.zeros(256, np.int64)
    for r in both.where("size = 0").collect():
        seen[r["h"]] = r["n"]
    # a task sends what it counted once, so small files are counted together
    learn = learn.coalesce(max(2 * spark.sparkContext.defaultParallelism, size // params.task_bytes))
    bits = max(CHUNK.bit_length() - 2, min(params.table_bits, (2 * size).bit_length()))
    coder = Coder(bits, train_topics(learn, vocab, params, text), byte_tree(seen), params)
    states = train_states(learn, coder, text)
    weights = train_weights(learn, states, coder, text)
    cut = head_cut(vocab, params.head_words)
    head = vocab.where(F.col("n") >= cut).select("h", "n").toArrow()
    h = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    model = spark.sparkContext.broadcast((states, weights, coder, h[order], head.column("n").to_numpy()[order]))
    scored = materialize(
        docs.select(F.col(id).alias("id"), F.coalesce(F.col(train), F.lit(False)).alias("learned"), text_or_empty(text).alias("text")).mapInArrow(_score_part(model), "id long, uid long, n_tokens long, n_bytes long, head_known long, head_log double, score double, rest array<long>"),
        "scored",
    )
    rest = scored.select("uid", F.explode("rest").alias("h"))
    tail = vocab.where(F.col("n") < cut)
    known = rest.join(tail, "h").groupBy("uid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_log"))
    log_all = math.log10(all_tokens + distinct + 1)
    return scored.drop("rest").join(known, "uid", "left").select(
        F.col("id").alias(id), "n_tokens", (F.col("head_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("more_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("score") / math.log(10)).alias("score"), "n_bytes",
        (-F.col("score") / math.log(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _score_part(model):
    def run(batches):
        from pyspark import TaskContext

        states, weights, coder, hashes, times = model.value
        scorer, uid = Scorer(states, weights, coder), TaskContext.get().partitionId() << 40
        for cols, texts in chunks(batches, "text", PASS):
            words = [t.lower().split() for t in texts]
            streams = [spelled(w) for w in words]
            scores = scorer.score(streams, np.array(cols["learned"], bool))
            h, _, count, _ = token_hashes(streams)
            kinds, of = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(hashes, kinds), max(len(hashes) - 1, 0))
            hit = hashes[at] == kinds if len(hashes) else np.zeros(len(kinds), bool)
            logs = np.zeros(len(kinds))
            logs[hit] = np.log10(times[at[hit]] + 1.0)
            there, begin = hit[of], np.cumsum(count) - count
            known = np.add.reduceat(there.astype(np.int64), begin)
            n = len(texts)
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count - known)]), pa.int32()), pa.array(h[~there].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols["id"], pa.int64()), pa.array(range(uid, uid + n), pa.int64()), pa.array(count), pa.array(list(map(len, streams)), pa.int64()),
                    pa.array(known), pa.array(np.add.reduceat(logs[of], begin)), pa.array(scores, pa.float64()), rest,
                ],
                ["id", "uid", "n_tokens", "n_bytes", "head_known", "head_log", "score", "rest"],
            )
            uid += n

    return run


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 7) != 2).alias("learn"))
    held = (crc_mod("doc_id", 7) == 2).alias("held_out")
    return score_documents(docs, "learn").select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
