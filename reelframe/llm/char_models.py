"""Language identification by character models with interpolated Kneser-Ney smoothing.

Each language has a model of order ORDER over letters (lower case; everything else is one blank between words).  The
highest order uses counts, lower orders use numbers of distinct left neighbours, and each order is interpolated with
the one below by an absolute discount.  A model is stored in arrays sorted by the hash of the n-gram: for n-grams their
probability, for contexts their weight of the order below.  A text's language is the one with the lowest cross-entropy
per character.

Rejection is calibrated on training documents that the models did not see: the cross-entropy of a text of n characters
under its best model may exceed the language's mean by `margin` times the EXCESS quantile of what calibration documents
exceed it by, times square root of n, and by REJECT_FLOOR nats at least.  A quantile, since one outlier would set the
largest.  Texts without letters are rejected always.

Training takes a bounded sample: about `per_language` documents of each language, drawn by hash from all that may be
learned from.  Counting runs on Spark; the driver gets the sample's distinct n-grams.

Defined results: a null text and one without letters have the language 'und', score 0 and are rejected; rows that
repeat are predicted alike; equal cross-entropies go to the language that sorts first; a text of any length is scored
whole; without anything to learn from, every text is 'und'; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.common import packed, release

OUTPUTS = ["lang_pred", "score", "cross_entropy", "accepted"]
PREDICTED = pa.schema(zip(OUTPUTS, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True))
ORDER = 4
PER_LANGUAGE = 600
CALIBRATION = 4  # one training document in so many calibrates
MARGIN = 2.0
EXCESS = 0.98
REJECT_FLOOR = 0.5
DISCOUNT = 0.75
BLANK = " "
YIELD_ROWS = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter, else the blank."""
    table = np.full(0x110000, ord(BLANK), np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(text: str) -> np.ndarray:
    """The text's letters with one blank before, between and after words; nothing if there is no letter."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = codes == ord(BLANK)
    if blank.all():
        return codes[:0]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    codes = codes[keep]  # begins with a letter
    end = np.array([ord(BLANK)], np.uint32)
    return np.concatenate([end, codes] if codes[-1] == ord(BLANK) else [end, codes, end])


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-gram of codes."""
    out = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out ^ codes[k : len(codes) - n + 1 + k].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Model:
    """keys[n], values[n]: hash and probability of n-grams; context_keys[n], weights[n]: of contexts of n characters."""

    keys: dict[int, np.ndarray]
    values: dict[int, np.ndarray]
    context_keys: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    unseen: float

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of the last character of each row of `grams` (codes, ORDER wide), given those before it."""
        order = grams.shape[1]
        p = np.full(len(grams), self.unseen)
        for n in range(1, order + 1):
            h = _row_hash(grams[:, order - n :])
            if n > 1:
                found, at = _find(self.context_keys[n - 1], _row_hash(grams[:, order - n : order - 1]))
                p = np.where(found, p * self.weights[n - 1][at], p)
            found, at = _find(self.keys[n], h)
            p = p + np.where(found, self.values[n][at], 0.0)
        return np.log(p)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), rows.shape[1], np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _sorted(table: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    if not table:
        return np.zeros(0, np.uint64), np.zeros(0)
    grams = np.array([[ord(c) for c in gram] for gram in table], np.uint32)
    h, order = np.unique(_row_hash(grams), return_index=True)
    return h, np.array(list(table.values()))[order]


def fit(counts: dict[str, int], order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """A model from the counts of its n-grams of the highest order."""
    keys, values, context_keys, weights = {}, {}, {}, {}
    level = dict(counts)
    for n in range(order, 0, -1):
        total, kinds = Counter(), Counter()
        for gram, c in level.items():
            total[gram[:-1]] += c
            kinds[gram[:-1]] += 1
        keys[n], values[n] = _sorted({gram: max(c - discount, 0) / total[gram[:-1]] for gram, c in level.items()})
        if n > 1:
            context_keys[n - 1], weights[n - 1] = _sorted({h: discount * kinds[h] / total[h] for h in total})
        else:
            left = discount * kinds[""] / max(total[""], 1) if total else 1.0
            unseen = left / (kinds[""] + 1000)  # over the characters seen and a thousand more
        level = Counter(gram[1:] for gram in level)  # distinct left neighbours
    return Model(keys, values, context_keys, weights, unseen)


@dataclass
class Identifier:
    """Models by language, with the mean cross-entropy and a high quantile of the scaled excess of calibration documents."""

    order: int
    models: dict[str, Model]
    mean: dict[str, float]
    excess: dict[str, float]
    margin: float = MARGIN

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages cross-entropy per character, characters scored)."""
        names = sorted(self.models)
        out, sizes = np.full((len(texts), len(names)), np.inf), np.zeros(len(texts), np.int64)
        coded = [letters(t) for t in texts]
        pad = np.full(self.order - 1, ord(BLANK), np.uint32)
        for first, last in _batches([len(c) for c in coded]):
            rows = [(k, coded[k]) for k in range(first, last) if len(coded[k]) > 1]
            if not rows:
                continue
            joined = np.concatenate([x for _, c in rows for x in (pad, c[1:])])  # the first blank is in the pad
            h = hashes(joined, self.order)
            codes, distinct = pd.factorize(h)
            place = np.full(len(distinct), -1, np.int64)
            place[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
            grams = joined[place[:, None] + np.arange(self.order)]
            n = np.array([len(c) - 1 for _, c in rows])
            starts = np.cumsum(n + len(pad)) - n - len(pad)
            # of a document of n characters the n grams from its start on end in a character of its own
            mask = np.zeros(len(joined) + 1, np.int32)
            mask[starts] += 1
            mask[starts + n] -= 1
            mine = np.flatnonzero(np.cumsum(mask[:-1])[: len(h)] > 0)
            bounds = np.cumsum(n) - n
            for j, name in enumerate(names):
                logs = self.models[name].log_probabilities(grams)
                out[[k for k, _ in rows], j] = -np.add.reduceat(logs[codes[mine]], bounds) / n
            sizes[[k for k, _ in rows]] = n
        return out, sizes

    def predict(self, texts: list[str]) -> pd.DataFrame:
        names = np.array([*sorted(self.models), "und"], object)
        if not self.models:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "cross_entropy": None, "accepted": False}).astype({"cross_entropy": "float64"})
        entropy, n = self.cross_entropies(texts)
        known = n > 0
        best = np.where(known, entropy.argmin(axis=1), len(names) - 1)
        low = np.where(known, entropy.min(axis=1), 0.0)
        weight = np.exp(np.minimum(0.0, -(np.where(known[:, None], entropy, 0.0) - low[:, None]) * np.minimum(np.maximum(n, 1), 50)[:, None]))
        score = np.where(known, 1 / weight.sum(axis=1), 0.0)
        mean = np.array([self.mean[x] for x in sorted(self.models)] + [0.0])[best]
        slack = np.array([self.excess[x] for x in sorted(self.models)] + [0.0])[best]
        allowed = mean + np.maximum(REJECT_FLOOR, self.margin * slack / np.sqrt(np.maximum(n, 1)))
        return pd.DataFrame({"lang_pred": names[best], "score": score, "cross_entropy": np.where(known, low, np.nan), "accepted": known & (low <= allowed)})


def _batches(sizes: list[int], most: int = 300_000) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield first, k
            first, total = k, 0
        total += n
    if sizes:
        yield first, len(sizes)


def _grams(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of the texts of (_lang, _text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pad = np.full(order - 1, ord(BLANK), np.uint32)
        for batch in batches:
            for lang, texts in batch.groupby("_lang")["_text"]:
                total: Counter = Counter()
                for text in texts:
                    codes = letters(text)
                    if len(codes) > 1:
                        said = np.concatenate([pad, codes[1:]]).astype("<u4").tobytes().decode("utf-32-le")
                        total.update(said[k : k + order] for k in range(len(said) - order + 1))
                yield pd.DataFrame({"lang": lang, "gram": list(total), "n": list(total.values())})

    return sample.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(df: DataFrame, may_learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE, order: int = ORDER, margin: float = MARGIN) -> Identifier:
    """Learns from the rows of df where may_learn holds and lang_col is not null."""
    rows = df.where(may_learn & df[f"`{lang_col}`"].isNotNull() & df[f"`{text_col}`"].isNotNull())
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{text_col}`").alias("_text"), F.pmod(F.xxhash64(F.lit("language"), f"`{id_col}`"), F.lit(1 << 30)).alias("_draw"))
    totals = rows.groupBy("_lang").count().collect()
    if not totals:
        return Identifier(order, {}, {}, {}, margin)
    # frames of Arrow tables, as those of lists start Python workers of another kind on the executors
    drawn = [min(1 << 30, int((1 << 30) * per_language / r["count"])) for r in totals]
    shares = df.sparkSession.createDataFrame(pa.table({"_lang": pa.array([r["_lang"] for r in totals], pa.string()), "_share": pa.array(drawn, pa.int64())}))
    sample = rows.join(F.broadcast(shares), "_lang").where("_draw < _share").drop("_share")
    calibrates = F.col("_draw") % CALIBRATION == 0
    counts: dict[str, dict[str, int]] = {}
    for r in _grams(sample.where(~calibrates), order).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    models = Identifier(order, {lang: fit(c, order) for lang, c in counts.items()}, {}, {}, margin)
    shared = df.sparkSession.sparkContext.broadcast(models)
    names = sorted(models.models)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entropy, n = shared.value.cross_entropies(list(batch["_text"]))
            own = np.array([names.index(x) if x in names else -1 for x in batch["_lang"]], np.int64)
            use = (own >= 0) & (n > 0)
            yield pd.DataFrame({"lang": batch["_lang"][use], "h": entropy[np.flatnonzero(use), own[use]], "n": n[use]})

    seen = sample.where(calibrates).mapInPandas(measure, "lang string, h double, n long")
    mean = {r["lang"]: r["m"] for r in seen.groupBy("lang").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    means = df.sparkSession.createDataFrame(pa.table({"lang": pa.array(list(mean), pa.string()), "m": pa.array(list(mean.values()), pa.float64())}))
    excess = {r["lang"]: r["x"] for r in seen.join(F.broadcast(means), "lang").groupBy("lang").agg(F.percentile((F.col("h") - F.col("m")) * F.sqrt("n"), EXCESS).alias("x")).collect()}
    models.mean = {lang: mean.get(lang, 20.0) for lang in names}
    models.excess = {lang: max(0.0, excess.get(lang, 0.0)) for lang in names}
    return models


def identify(df: DataFrame, models: Identifier, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """df with lang_pred, score, cross_entropy (nats per character) and accepted."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    rows = packed(df, text_col, id_col, OUTPUTS, carry).select("_row", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, YIELD_ROWS):
                part = batch.slice(at, YIELD_ROWS)
                said = pa.RecordBatch.from_pandas(shared.value.predict(part.column("_text").to_pylist()), PREDICTED, preserve_index=False)
                yield pa.RecordBatch.from_arrays([part.column("_row"), *said.columns], ["_row", *OUTPUTS])
        release()

    more = T.StructType.fromDDL("lang_pred string, score double, cross_entropy double, accepted boolean")
    out = rows.mapInArrow(run, T.StructType([rows.schema["_row"], *more.fields]))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in rows.schema["_row"].dataType.names if c != "_none"], *OUTPUTS)
