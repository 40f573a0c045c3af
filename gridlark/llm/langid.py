"""Language identification of words in code-switched text with a linear-chain conditional random field.

A text's letter runs, lower-cased, are labelled in sequences of at most `span` words. A word's score for
a language sums learned weights of its hashed byte trigrams, its first and last two and three bytes,
and the word itself (the lexicon); learned transition scores tie neighbours together. Labels' probabilities come from
forward-backward. A text's language is the one with the most expected words, its score their share.

Training: at most `sample` texts are drawn by a hash of id and text; runs of 4 to 24 of their words are
strung together across languages, so that switches are learned too, and the likelihood is climbed by
AdaGrad with exact forward-backward gradients. Scoring covers every word of every text.

Defined cases: null texts and texts without a letter are `und` with score 0; languages that are null are not learned from;
with nothing to learn from everything is `und`; equal languages break ties by code point; repeated rows and ids are
scored each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, crc_mod, table, text_or_empty

WORDS = re.compile(r"[^\W\d_]+").findall
UNKNOWN = "und"


@dataclass(frozen=True)
class ChainParams:
    bits: int = 18  # of the hashed features
    span: int = 64  # words of a sequence
    sample: int = 2000  # most texts that are learned from
    sample_bytes: int = 1 << 16  # longer ones only where there are too few others
    words: int = 400_000  # most words in training sequences
    epochs: int = 3
    rate: float = 0.3


def words_of(text: str) -> list[bytes]:
    words = WORDS(text.lower())
    if not any(c.isalpha() for w in words for c in w):
        return []
    return [w.encode() for w in words]


def word_features(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, one word's after the other's, and where each word's begin."""
    spelled = [b"^" + w + b"$" for w in words]
    raw = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, spelled), np.int64, len(spelled))
    end = np.cumsum(size)
    start = end - size
    tri = raw.copy()
    tri[:-1] |= raw[1:] << np.uint32(8)
    tri[:-2] |= raw[2:] << np.uint32(16)
    kind = np.zeros(len(raw), np.uint32)
    # the last two places of a word hold no trigram of it: they carry the affixes, the first one the word
    with np.errstate(over="ignore"):
        place = np.arange(len(raw)) - np.repeat(start, size)
        letters = raw * (np.multiply.accumulate(np.full(64, 0x01000193, np.uint32))[place % 64] + place.astype(np.uint32))
        whole = np.add.reduceat(letters, start) * np.uint32(0x9E3779B1)
        last = np.maximum(end - 4, start)
        tri[end - 1] = whole
        kind[end - 1] = 3
        kind[start] = 1
        kind[last] = 2
        two = np.stack([raw[start + 1] | raw[np.minimum(start + 2, end - 1)] << np.uint32(8), raw[np.maximum(end - 3, start)] | raw[end - 2] << np.uint32(8)])
        tri[end - 2] = two[0]
        kind[end - 2] = 4
        mixed = (tri + kind * np.uint32(0x85EBCA6B)) * np.uint32(0xCC9E2D51)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x1B873593)
        tail = (two[1] + np.uint32(77)) * np.uint32(0xCC9E2D51)
        tail ^= tail >> np.uint32(13)
        tail *= np.uint32(0x1B873593)
    shift = np.uint32(32 - bits)
    out = np.insert(mixed, end, tail) >> shift
    return out.astype(np.int64), start + np.arange(len(words))


class Chain:
    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray, params: ChainParams):
        self.labels, self.weights, self.moves, self.params = labels, weights, moves, params

    def emissions(self, words: list[bytes]) -> np.ndarray:
        features, start = word_features(words, self.params.bits)
        return np.add.reduceat(self.weights[features], start, axis=0)

    def marginals(self, scores: np.ndarray, sizes: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Label probabilities of every word, by forward-backward; sequences stand one after the other in scores.

        pairs: also the expected number of each move.
        """
        n, k = scores.shape
        e = np.exp(scores - scores.max(1, keepdims=True))
        move = np.exp(self.moves - self.moves.max())
        order = np.argsort(-sizes, kind="stable")
        start, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size.max(initial=0)))]  # sequences with more than t words
        ahead, back = np.empty_like(e), np.ones_like(e)
        for t, m in enumerate(live):
            at = start[:m] + t
            a = e[at] if t == 0 else (ahead[at - 1] @ move) * e[at]
            ahead[at] = a / a.sum(1, keepdims=True)
        for t in range(len(live) - 2, -1, -1):
            at = start[: live[t + 1]] + t
            b = (e[at + 1] * back[at + 1]) @ move.T
            back[at] = b / b.sum(1, keepdims=True)
        p = ahead * back
        p /= p.sum(1, keepdims=True)
        if not pairs:
            return p, None
        inner = np.ones(n, bool)
        inner[np.cumsum(sizes)[sizes > 0] - 1] = False
        i = np.flatnonzero(inner)
        joint = ahead[i][:, :, None] * move * (e[i + 1] * back[i + 1])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        return p, joint.sum(0)

    def shares(self, texts: list[list[bytes]]) -> np.ndarray:
        """The expected share of each label in each text; zeros where there are no words."""
        kinds: dict[bytes, int] = {}
        flat = np.array([kinds.setdefault(w, len(kinds)) for t in texts for w in t], np.int64)
        out = np.zeros((len(texts), len(self.labels)))
        if not len(flat):
            return out
        size = np.array([len(t) for t in texts])
        span = self.params.span
        sizes = np.array([min(span, n - a) for n in size.tolist() for a in range(0, n, span)])
        p, _ = self.marginals(self.emissions(list(kinds))[flat], sizes)
        full = np.flatnonzero(size)
        out[full] = np.add.reduceat(p, (np.cumsum(size) - size)[full], axis=0) / size[full, None]
        return out


def train(texts: list[list[bytes]], labels: list[str], params: ChainParams = ChainParams()) -> Chain:
    """Fits the chain on texts of one language each, strung together in short runs."""
    names = sorted(set(labels))
    of = {x: i for i, x in enumerate(names)}
    rng = np.random.default_rng(11)
    runs: list[list[tuple[list[bytes], int]]] = [[] for _ in names]
    for t, x in zip(texts, labels):
        at = 0
        while at < len(t):
            n = int(rng.integers(4, 25))
            runs[of[x]].append((t[at : at + n], of[x]))
            at += n
    least = params.words // (14 * max(len(names), 1))
    mixed = [r[i] for r in runs if r for i in rng.permutation(len(r))[:least]]
    mixed = [mixed[i] for i in rng.permutation(len(mixed))]
    words, gold = [w for r, _ in mixed for w in r], np.array([y for r, y in mixed for _ in r], np.int64)
    k = max(len(names), 1)
    chain = Chain(names, np.zeros((1 << params.bits, k), np.float32), np.zeros((k, k)), params)
    if len(names) < 2:
        return chain
    seen, seen_moves, batch = np.full(chain.weights.shape, 1e-2, np.float32), np.full((k, k), 1.0), params.span * 128
    for _ in range(params.epochs):
        for a in range(0, len(words), batch):
            part, y = words[a : a + batch], gold[a : a + batch]
            sizes = np.full(-(-len(part) // params.span), params.span)
            sizes[-1] = len(part) - params.span * (len(sizes) - 1)
            features, start = word_features(part, params.bits)
            p, moved = chain.marginals(np.add.reduceat(chain.weights[features], start, axis=0).astype(float), sizes, pairs=True)
            wrong = -p
            wrong[np.arange(len(y)), y] += 1
            inner = np.ones(len(y), bool)
            inner[np.cumsum(sizes) - 1] = False
            i = np.flatnonzero(inner)
            held = np.bincount(y[i] * k + y[i + 1], minlength=k * k).reshape(k, k)
            count = np.diff(np.append(start, len(features)))
            used, slot = np.unique(features, return_inverse=True)
            rep = np.repeat(wrong, count, axis=0)
            g = np.stack([np.bincount(slot, rep[:, j], len(used)) for j in range(k)], 1).astype(np.float32) / params.span - 1e-4 * chain.weights[used]
            seen[used] += g * g
            chain.weights[used] += params.rate * g / np.sqrt(seen[used])
            gm = (held - moved) / len(y)
            seen_moves += gm * gm
            chain.moves += params.rate * gm / np.sqrt(seen_moves)
    return chain


def identify(docs: DataFrame, learn: str, *, id: str = "doc_id", text: str = "text", lang: str = "lang", params: ChainParams = ChainParams()) -> DataFrame:
    """One row a document: id, lang_pred, score. learn names a boolean column: the rows that may be learned from."""
    known = docs.where(F.col(learn) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    total = known.count()
    # a bounded sample of labelled rows, by hash
    part = min(1.0, 1.25 * params.sample / max(total, 1))
    draw = F.pmod(F.xxhash64(F.col(id).cast("string"), text), F.lit(1 << 30)) < int(part * (1 << 30))
    sample = sorted(map(tuple, known.where(draw).orderBy(F.octet_length(text) > params.sample_bytes, F.xxhash64(F.col(id).cast("string"), text), text).select(text, F.col(lang).cast("string")).limit(2 * params.sample).collect()))
    texts = [words_of(t) for t, _ in sample]
    model = docs.sparkSession.sparkContext.broadcast(train(texts, [x for _, x in sample], params))

    def run(batches):
        chain = model.value
        for cols, raw in chunks(batches, "text", 1 << 20):
            words = [words_of(t.decode("utf-8", "replace")) for t in raw]
            share = chain.shares(words) if chain.labels else np.zeros((len(raw), 1))
            best = share.argmax(1)
            some = np.array([bool(w) and bool(chain.labels) for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(cols["id"], pa.int64()), pa.array([chain.labels[b] if s else UNKNOWN for b, s in zip(best, some)], pa.string()), pa.array(np.where(some, share[np.arange(len(raw)), best], 0.0))], ["id", "lang_pred", "score"])

    return docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("text")).mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 4) != 2).alias("learn"))
    return identify(docs, "learn").select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
