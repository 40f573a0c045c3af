"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, next to the data, and written as a narrow table.
Labelled rows are joined to them; a sample of at most `sample` of these (by a hash of the id) is
fitted with boosted trees on binned features. The trees are complete binary trees of a fixed depth,
so a model is three small arrays and scoring is `depth` numpy gathers for a whole batch of rows.

Inputs are made from the text alone. Defined cases: null and empty texts have the statistics of an
empty text and are scored like others; labels that contradict each other count by their mean; null
labels and labels of unknown documents are ignored; without labels of both classes every score is
the smoothed share of label 1; repeated rows and null ids are scored each by itself; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, crc_mod, materialize, table, text_or_empty

FEATURES = [
    "log_bytes", "log_words", "log_lines", "mean_word", "sd_word", "max_word", "mean_line", "upper", "digit", "space", "punctuation", "exclaim", "bracket", "quote", "slash", "at", "wide", "control",
    "entropy", "distinct_words", "top_word", "repeated_lines", "top_line", "repeated_pairs", "short_words", "long_words", "shouted_words", "numbers", "stops", "no_vowel", "mean_sentence", "commas",
]


@dataclass(frozen=True)
class BoostParams:
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    leaf_weight: float = 2.0
    sample: int = 40_000  # most labelled rows that a model is fitted on


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGIT, BLANK = _set(bytes(range(65, 91))), _set(bytes(range(48, 58))), _set(b" \t\n\r\x0b\x0c")
CLASSES = np.stack([UPPER, DIGIT, BLANK, _set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), _set(b"!"), _set(b"()[]{}<>"), _set(b"'\""), _set(b"/\\|"), _set(b"@"), _set(bytes(range(128, 256))), _set(bytes(b for b in range(32) if b not in b"\t\n\r"))]).astype(float)
VOWELS = b"aeiouyAEIOUY"


def statistics(text: bytes) -> list[float]:
    """The features of a text, in the order of FEATURES."""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    share = CLASSES @ hist / max(n, 1)
    p = hist[hist > 0] / max(n, 1)
    words = text.split()
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    own = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    each = Counter(lines)
    k = max(len(lines), 1)
    pairs = set(zip(words, words[1:]))
    letters = [x for x in own if x[:1].isalpha()]
    no_vowel = sum(own[x] for x in letters if not x.strip(VOWELS) == x or len(x) < 2)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sizes.mean(), sizes.std(), sizes.max(), n / k, *share[:5], share[5], share[6], share[7], share[8], share[9], share[10],
        float(-(p * np.log2(p)).sum()), len(own) / w, max(own.values(), default=0) / w, 1 - len(each) / k if lines else 0.0, max(each.values(), default=0) / k, 1 - len(pairs) / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        float((sizes <= 3).sum()) / w, float((sizes >= 12).sum()) / w, sum(c for x, c in own.items() if x.isupper()) / w, sum(c for x, c in own.items() if x.isdigit()) / w, hist[46] / w, no_vowel / w,
        w / (hist[33] + hist[46] + hist[63] + 1), hist[44] / w,
    ]


def _features(batches):
    for cols, texts in chunks(batches, "text", 1 << 22):
        x = np.array([statistics(t) for t in texts], np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(cols["id"], pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], ["id", "x"])


def document_statistics(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the feature vector of every row's whole text."""
    return docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("text")).mapInArrow(_features, "id long, x array<float>")


@dataclass
class Trees:
    """Complete trees as arrays: feature and threshold of inner nodes, value of leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        s, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while inner and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            s += v[at - inner]
        return 1 / (1 + np.exp(-s))


def fit(x: np.ndarray, y: np.ndarray, params: BoostParams = BoostParams()) -> Trees:
    """Boosted trees for labels 0 and 1 under the logistic loss, on quantile bins of the features."""
    rate = (y.sum() + 1) / (len(y) + 2)
    none = Trees(float(np.log(rate / (1 - rate))), np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    if len(set(y.tolist())) < 2:
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, params.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # x <= edge goes left
    d, bins, inner = x.shape[1], params.bins, (1 << params.depth) - 1
    s = np.full(len(y), none.base)
    trees: list[tuple] = []
    for _ in range(params.trees):
        p = 1 / (1 + np.exp(-s))
        g, h = y - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(params.depth):
            first, width = (1 << level) - 1, 1 << level
            slot = (at - first) * bins
            best = np.full(width, 1e-6)
            for j in range(d):
                key = slot + binned[j]
                left = [np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h)]
                total = [a[:, -1:] for a in left]
                ga, ha, gb, hb = left[0], left[1], total[0] - left[0], total[1] - left[1]
                gain = np.where((ha > 1) & (hb > 1), ga**2 / (ha + params.leaf_weight) + gb**2 / (hb + params.leaf_weight) - total[0] ** 2 / (total[1] + params.leaf_weight), 0)[:, : len(edges[j])]
                if gain.shape[1]:
                    cut = gain.argmax(1)
                    gains = gain[np.arange(width), cut]
                    win = gains > best
                    best[win] = gains[win]
                    feature[first : first + width][win] = j
                    threshold[first : first + width][win] = edges[j][cut[win]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = params.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + params.leaf_weight)
        s += value[leaf]
        trees.append((feature, threshold, value))
    return Trees(none.base, *(np.stack(a) for a in zip(*trees)))


def train(stats: DataFrame, labels: DataFrame, params: BoostParams = BoostParams()) -> Trees:
    """stats: (id, x); labels: (id, y). Fits on a sample of at most params.sample labelled rows."""
    clean = labels.where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    rows = stats.join(clean, "id").orderBy(F.xxhash64("id"), "id").limit(params.sample).select("x", "y").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(rows.num_rows, len(FEATURES))
    return fit(x, (rows.column("y").to_numpy() >= 0.5).astype(float), params)


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """(id, score, predicted) of every row."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            p = model.predict(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return stats.mapInArrow(run, "id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """Rows that the model rates 0.5 or more."""
    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.array([statistics(t.encode("utf-8", "surrogatepass")) for t in texts], np.float32).reshape(len(texts), len(FEATURES))) >= 0.5)

    return docs.where(good(text_or_empty(text)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1).select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    return score(stats, train(stats, labels)).select(F.col("id").alias("doc_id"), (crc_mod("id", 3) == 1).alias("held_out"), "score", "predicted")
