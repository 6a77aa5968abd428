"""Quality classification by histogram gradient-boosted trees over document statistics.

Statistics are counts and shares of the whole text.  They are binned at quantiles; trees grow by the best split of
the histograms of gradients.  Trees are flattened into arrays, through which all rows of a batch walk together.

Training takes a bounded sample, about `sample_rows` labelled rows drawn by hash; its statistics are computed on Spark
and only they go to the driver.

Defined results: a null text counts as empty and gets the score of its statistics; rows without a label, or with one
that is neither 0 nor 1, are not learned from; several labels of one id count each; with labels of one kind, or none,
the score is their mean (0.5 without any); rows that repeat score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.common import packed

OUTPUTS = ["score", "predicted"]
SAMPLE_ROWS = 12_000
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 64, 80, 4, 0.15, 20, 1.0
THRESHOLD = 0.3
STATISTICS = ["chars", "words", "lines", "word_length", "distinct_words", "top_word", "repeated_lines", "short_lines", "upper", "lower", "digit", "space", "other", "common_marks", "odd_marks", "top_mark", "mark_words", "line_length", "stop_share", "ends_with_mark"]


def statistics(text: str) -> list[float]:
    """The numbers in the order of STATISTICS."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    words, lines = text.split(), text.split("\n")
    counts, line_counts = Counter(words), Counter(lines)
    classes = Counter(text)
    upper = lower = digit = space = common = 0
    marks: Counter = Counter()
    for c, k in classes.items():
        if c.islower():
            lower += k
        elif c.isupper():
            upper += k
        elif c.isdigit():
            digit += k
        elif c.isspace():
            space += k
        elif not c.isalnum():
            marks[c] += k
            common += k * (c in ".,;:'\"-?")
    n_words, n_marks = max(1, len(words)), sum(marks.values())
    bare = sum(k for w, k in counts.items() if not any(c.isalnum() for c in w))
    short = sum(k for w, k in counts.items() if len(w) <= 3)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), (n - space) / n_words, len(counts) / n_words, max(counts.values(), default=0) / n_words,
        1 - len(line_counts) / len(lines), sum(k for x, k in line_counts.items() if len(x) < 20) / len(lines), upper / n, lower / n, digit / n, space / n, (n - upper - lower - digit - space - n_marks) / n,
        common / n, (n_marks - common) / n, max((k for c, k in marks.items() if c not in ".,"), default=0) / n, bare / n_words, np.log1p(n / len(lines)), short / n_words, sum(k for x, k in counts.items() if not x[-1].isalnum()) / n_words,
    ]


@dataclass
class Trees:
    """Flattened trees: node k of a tree splits by feature[k] at cut[k]; children are 2k+1 and 2k+2, leaves hold value."""

    edges: list[np.ndarray]
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        rows = np.arange(len(x))
        raw = np.full(len(x), self.base)
        b = self.binned(x) if len(self.feature) else None
        depth = int(np.log2(self.value.shape[1])) if len(self.feature) else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            raw += value[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosts on the logistic loss; nodes that no split improves send all rows left."""
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    nodes, leaves = 2**depth - 1, 2**depth
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    model = Trees(edges, np.zeros((0, nodes), np.int64), np.zeros((0, nodes), np.int64), np.zeros((0, leaves)), base)
    if not len(y) or y.min() == y.max():
        return model
    b = model.binned(x)
    raw, features = np.full(len(y), base), x.shape[1]
    flat = b.astype(np.int64) + np.arange(features) * BINS
    feature, cut, value = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        f, c, node = np.zeros(nodes, np.int64), np.full(nodes, BINS, np.int64), np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            place = ((node - first)[:, None] * (features * BINS) + flat).ravel()
            size = 2**level * features * BINS
            gs, hs, ns = (np.bincount(place, w, size).reshape(2**level, features, BINS).cumsum(axis=2) for w in (np.repeat(g, features), np.repeat(h, features), None))
            gt, ht, nt = gs[:, :1, -1:], hs[:, :1, -1:], ns[:, :1, -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain = np.where((ns >= LEAST) & (nt - ns >= LEAST), gain, 0.0).reshape(2**level, -1)
            best = gain.argmax(axis=1)
            good = gain[np.arange(len(best)), best] > 1e-9
            f[first : first + 2**level] = np.where(good, best // BINS, 0)
            c[first : first + 2**level] = np.where(good, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(len(y)), f[node]] > c[node])
        leaf = node - nodes
        v = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        raw = raw + v[leaf]
        feature.append(f)
        cut.append(c)
        value.append(v)
    return Trees(edges, np.array(feature), np.array(cut), np.array(value), base)


def train(df: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Learns label_col of `labels` from the texts of df.  may_learn: a condition on the column of labels named id_col."""
    known = labels.where(may_learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_label"))
    share = sample_rows / max(sample_rows, known.count())
    drawn = known.where(F.pmod(F.xxhash64(F.lit("quality"), "_key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = packed(df, text_col, id_col, [], [])
    joined = texts.join(F.broadcast(drawn), F.col("_id") == F.col("_key")).select("_label", "_text")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["_label"], "x": [statistics(t) for t in batch["_text"]]})

    rows = joined.mapInPandas(measure, "label int, x array<double>").toPandas().sort_values(["label", "x"], key=lambda s: s.map(tuple) if s.name == "x" else s)
    x = np.array([list(v) for v in rows["x"]], float).reshape(-1, len(STATISTICS))
    return fit(x, rows["label"].to_numpy(float))


def score(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """df with score and predicted (1 where score >= threshold)."""
    shared = df.sparkSession.sparkContext.broadcast(trees)
    rows = packed(df, text_col, id_col, OUTPUTS, carry).select("_row", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(text.as_py()) for text in batch.column(1)], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], ["_row", "score"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType())]))
    names = [F.col("_row").getField(c).alias(c) for c in rows.schema["_row"].dataType.names if c != "_none"]
    return out.select(*names, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
