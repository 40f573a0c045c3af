"""Token counts under a unigram piece model, with forward scores shared along a trie.

The number of tokens of a pre-token is that of its likeliest segmentation into vocabulary pieces. The
best score and token count of a prefix do not depend on what follows, so the distinct pre-tokens of a
run of texts are inserted in one trie, level by level, and the nodes of a level are computed together, each
once, from its ancestors; a pre-token's count is that of its terminal node and is kept for later texts. A
pre-token over `long` characters is a branch of its own, computed character by character. The
vocabulary file gives pieces in order of frequency and no probabilities, so a piece of rank r scores
-log(r + 1) less the log of the harmonic sum (Zipf's law); characters outside the vocabulary fall back to one
token a byte. Pieces are looked up by a 64-bit hash of their characters.

Counting needs no shuffle. Memory is bounded: a trie holds the new pre-tokens of one run of texts, in parts of
`part` pre-tokens, and terminal counts are forgotten, not capped, beyond `kept` pre-tokens.

Defined cases: null and empty texts have no tokens; white space is not counted; repeated rows and ids
are counted each by itself; an empty table gives no rows; other columns are ignored; a pre-token of any length
counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, table, text_or_empty

MARK = "▁"  # begins every pre-token, as in the vocabulary
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


@dataclass(frozen=True)
class UnigramParams:
    part: int = 100_000
    long: int = 64
    kept: int = 400_000
    byte_score: float = -16.0


def powers_of(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Vocabulary:
    """Pieces by the hash of their characters: the sum of character times BASE to its place."""

    def __init__(self, path: str, params: UnigramParams):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self._set(pieces, params)

    def _set(self, pieces: list[str], params: UnigramParams) -> None:
        log_sum = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
        score = {p: -math.log(r + 1) - log_sum for r, p in enumerate(pieces)}
        self.longest, self.params = max(map(len, score)), params
        power = powers_of(int(BASE), self.longest)
        with np.errstate(over="ignore"):
            hashes = np.array([(characters(p) * power[: len(p)]).sum() for p in score], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(list(score.values()))[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces of the vocabulary have one hash")
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    @classmethod
    def of(cls, pieces: list[str], params: UnigramParams) -> Vocabulary:
        out = cls.__new__(cls)
        out._set(pieces, params)
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces', and the scores of those."""
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        true = self.hashes[at] == hashes[some]
        return some[true], self.scores[at[true]]


def trie_counts(words: list[str], v: Vocabulary) -> np.ndarray:
    """Tokens of sorted words, which all begin with MARK: a trie level by level, each node once.

    The words below a node stand together, and a node goes by the first of them.
    """
    size = np.array([len(w) for w in words], np.int64)
    code = characters("".join(words))
    begin = np.cumsum(size) - size
    power, inverse = powers_of(int(BASE), len(code)), powers_of(pow(int(BASE), -1, 1 << 64), len(code))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:-1])])
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    counts = np.zeros(len(words), np.int64)
    # of the last `longest` levels: each word's node there, and the nodes' best scores and tokens
    nodes = [np.zeros(len(words), np.int64)]
    best, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
    live = np.arange(len(words))
    for level in range(1, int(size.max(initial=0)) + 1):
        live = live[size[live] >= level]
        own, above = code[begin[live] + level - 1], nodes[-1][live]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (above[1:] != above[:-1])])
        node = np.zeros(len(words), np.int64)
        node[live] = np.cumsum(new) - 1
        word = live[new]  # the first word of each node
        end = begin[word] + level
        byte = width[end - 1]
        score, count = best[-1][nodes[-1][word]] + v.params.byte_score * byte, tokens[-1][nodes[-1][word]] + byte
        for back in range(1, min(level, v.longest) + 1):
            with np.errstate(over="ignore"):
                piece, gain = v.find((sums[end] - sums[end - back]) * inverse[end - back])
            if len(piece):
                old = nodes[-back][word[piece]]
                s, c = best[-back][old] + gain, tokens[-back][old] + 1
                better = (s > score[piece]) | (s == score[piece]) & (c < count[piece])
                piece = piece[better]
                score[piece], count[piece] = s[better], c[better]
        nodes, best, tokens = [*nodes, node][-v.longest :], [*best, score][-v.longest :], [*tokens, count][-v.longest :]
        done = live[size[live] == level]
        counts[done] = count[node[done]]
    return counts


def branch_count(word: str, v: Vocabulary) -> int:
    """Tokens of one long word: pieces are looked up for all its places at once, scores follow place by place."""
    code = characters(word)
    inverse = powers_of(pow(int(BASE), -1, 1 << 64), len(code))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * powers_of(int(BASE), len(code))[:-1])])
    ends, backs, gains = [], [], []
    for back in range(1, min(len(word), v.longest) + 1):
        with np.errstate(over="ignore"):
            at, gain = v.find((sums[back:] - sums[:-back]) * inverse[: len(code) + 1 - back])
        ends, backs, gains = [*ends, at + back], [*backs, np.full(len(at), back)], [*gains, gain]
    end, back, gain = map(np.concatenate, (ends, backs, gains))
    order = np.argsort(end, kind="stable")
    end, back, gain = end[order], back[order].tolist(), gain[order].tolist()
    edge = np.searchsorted(end, np.arange(1, len(word) + 2)).tolist()
    best = [(0.0, 0)]
    for i, c in enumerate(word):
        width = len(c.encode("utf-8", "surrogatepass"))
        s, n = best[i]
        top = (s + v.params.byte_score * width, n - width)
        for k in range(edge[i], edge[i + 1]):
            s, n = best[i + 1 - back[k]]
            top = max(top, (s + gain[k], n - 1))
        best.append(top)
    return -best[-1][1]


class SharedCounts:
    """Token counts of pre-tokens; those not met before go through a trie together."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}

    def count(self, texts: list[list[bytes]]) -> list[list[int]]:
        """The token counts of every text's pre-tokens."""
        if len(self.known) > self.v.params.kept:
            self.known = {}
        fresh = sorted(set().union(*texts).difference(self.known))  # UTF-8 sorts as its characters do
        words = [MARK + w for w in b"\n".join(fresh).decode("utf-8", "replace").split("\n")] if fresh else []
        params = self.v.params
        for i in range(0, len(words), params.part):
            short = [j for j in range(i, min(i + params.part, len(words))) if len(words[j]) <= params.long]
            self.known.update(zip([fresh[j] for j in short], trie_counts([words[j] for j in short], self.v).tolist()))
        self.known.update((fresh[j], branch_count(w, self.v)) for j, w in enumerate(words) if len(w) > params.long)
        return [list(map(self.known.__getitem__, t)) for t in texts]


def count_tokens(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", params: UnigramParams = UnigramParams()) -> DataFrame:
    """One row a document: id, n_words, n_tokens, most_tokens (of one word). path: the vocabulary's file."""

    def run(batches):
        shared = SharedCounts(Vocabulary(path, params))
        for cols, raw in chunks(batches, "text", 1 << 22):
            counts = shared.count([t.split() for t in raw])
            yield pa.RecordBatch.from_arrays([pa.array(cols["id"], pa.int64()), *[pa.array([f(c) for c in counts], pa.int64()) for f in (len, sum, lambda c: max(c, default=0))]], ["id", "n_words", "n_tokens", "most_tokens"])

    return docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("text")).mapInArrow(run, "id long, n_words long, n_tokens long, most_tokens long").withColumnRenamed("id", id)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
