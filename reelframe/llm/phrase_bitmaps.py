"""Collocations by position bitmaps of words, in the manner of SPAM.

Texts are cut into pieces and words; the words of a language fill shards of about SHARD_WORDS positions, in the task
that reads them, with a position left empty behind each piece.  A shard keeps a bitmap for each word, compressed to the
bytes that are not zero: where each lies, and its eight bits.  Shards are written once to the shared folder.

A phrase's bitmap has the bits of its last word.  It is shifted by one position, across bytes, and ANDed with the
bitmaps of the words that have a byte where it has one; what is not zero is the bitmap of a longer phrase, and the
popcounts over all its bytes are how often that occurs.  A shard goes depth-first: some bytes of all words at a time are
extended to phrases of two words and these at once to three, so only that many bitmaps are in memory.  The empty
positions keep phrases within pieces.  Counts are sums of popcounts, over bytes and over shards.

A phrase is as rare as its rarest part, so only words, and then pairs, that occur `least` times in the language are
extended.  What is frequent is told to the shards by a broadcast if it has at most `told` rows and TOLD_BYTES of
words; beyond that each shard is joined with what it holds of it, so nothing grows with the corpus but the joins.

Defined results: a null text counts as empty, a null language is `und`; words are compared by their bytes after A-Z are
lowered; repeated rows count as often; a text of any length is read whole; ids and other columns are not looked at,
whatever their names; an empty table, or one without a frequent phrase, gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelframe.llm.block_max import Numbers
from reelframe.llm.common import batches_of, cut, new_path, release, remove

SHARD_WORDS, GATHER, TOLD, TOLD_BYTES, SALTS, YIELD_ROWS = 1 << 22, 1 << 18, 4_000_000, 64 << 20, 16, 1 << 17
LEAST, COVERED, FIRST, PAIRED = 10, 50, 2000, 1 << 31
_END = b"\xff"  # no byte of UTF-8, and so of no word
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
SHARDS = "shard long, lang string, n long, vocab array<binary>, held array<int>, sizes array<int>, places array<int>, bits binary"


def words_of(text: str) -> list[bytes]:
    """The words of a text, with _END between pieces."""
    return text.encode("utf-8", "replace").translate(_TABLE).replace(_END, b" \xff ").split()


class Builder:
    """The words of a language, in order, as they come."""

    def __init__(self) -> None:
        self.numbers, self.order = Numbers(), array("i")
        self.numbers[_END]  # is 0

    def add(self, text: str) -> int:
        before = len(self.order)
        self.order.extend(map(self.numbers.__getitem__, words_of(text)))
        self.order.append(0)
        return len(self.order) - before

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        """The shard as a row of SHARDS; words keep their numbers, less one."""
        order, n_words = np.frombuffer(self.order, np.int32), len(self.numbers) - 1
        by_word = np.argsort(order, kind="stable")[np.count_nonzero(order == 0) :]
        word, position = order[by_word] - 1, by_word.astype(np.int32)
        place, bit = position >> 3, np.left_shift(1, position & 7).astype(np.uint8)
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (place[1:] != place[:-1])]))
        bits = np.bitwise_or.reduceat(bit, first)
        lists = [pa.array(list(self.numbers)[1:], pa.binary())]
        lists += [pa.array(x.astype(np.int32)) for x in (np.bincount(word, minlength=n_words), np.bincount(word[first], minlength=n_words), place[first])]
        columns = [pa.array([number]), pa.array([lang]), pa.array([len(word)]), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]]
        return pa.RecordBatch.from_arrays([*columns, pa.array([bits.tobytes()], pa.binary())], [c.split()[0] for c in SHARDS.split(", ")])

    def empty(self) -> bool:
        return len(self.numbers) == 1


def build_shards(df: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The shards of df as SHARDS, written to path."""
    rows = df.select(F.coalesce(df[f"`{lang_col}`"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(df[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, builders = TaskContext.get().partitionId() << 33, 0, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                waiting += builders.setdefault(lang, Builder()).add(text.as_py())
                while waiting >= shard_words:  # the largest goes; all of them are as large as that together
                    lang = max(builders, key=lambda k: len(builders[k].order))
                    done = builders.pop(lang)
                    waiting -= len(done.order)
                    if not done.empty():
                        yield done.row(number, lang)
                        number += 1
        for lang, done in builders.items():
            if not done.empty():
                yield done.row(number, lang)
                number += 1
        release()

    rows.mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(SHARDS).parquet(path)


class Bitmaps:
    """The bitmaps of the frequent words of a shard, by word and by place; ids: the ids of these words."""

    def __init__(self, batch: pa.RecordBatch, k: int, ids: np.ndarray) -> None:
        """ids: for each word of the shard its id, or -1 where it is not frequent."""

        def column(name: str) -> np.ndarray:
            return batch.column(name)[k].values.to_numpy()

        sizes, bits = column("sizes"), np.frombuffer(batch.column("bits")[k].as_py(), np.uint8)
        word = np.repeat(np.where(ids >= 0, np.cumsum(ids >= 0) - 1, -1).astype(np.int32), sizes)
        kept = word >= 0
        self.ids, self.word, self.place, self.bits = ids[ids >= 0], word[kept], column("places")[kept], bits[kept]
        by_place = np.argsort(self.place, kind="stable")
        self.word_at, self.bits_at = self.word[by_place], self.bits[by_place]
        last = int(self.place.max(initial=-1))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.place, minlength=last + 1)), [len(self.place)] * 2]).astype(np.int64)

    def extended(self, phrase: np.ndarray, place: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, word, place, bits): the bitmaps of phrases followed by a word."""
        over = bits >> 7  # what is shifted into the next byte
        carried = np.flatnonzero(over)
        phrase, place = np.concatenate([phrase, phrase[carried]]), np.concatenate([place, place[carried] + 1])
        shifted = np.concatenate([bits << 1, over[carried]])
        some = np.flatnonzero(shifted)
        phrase, place, shifted = phrase[some], place[some], shifted[some]
        begin = self.first[place]
        n = self.first[place + 1] - begin
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = self.bits_at[at] & np.repeat(shifted, n)
        met = np.flatnonzero(both)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)[met]
        return phrase[row], self.word_at[at[met]], place[row], both[met]

    def codes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Sorted codes of the pairs of ids of which the shard has both words."""
        if not len(self.ids):
            return np.zeros(0, np.int64)
        order = np.argsort(self.ids)
        sides = []
        for wanted in (first, second):
            at = np.minimum(np.searchsorted(self.ids, wanted, sorter=order), len(order) - 1)
            sides.append(np.where(self.ids[order[at]] == wanted, order[at], -1))
        here = (sides[0] >= 0) & (sides[1] >= 0)
        return np.sort(sides[0][here] * len(self.ids) + sides[1][here])

    def counts(self, pairs: np.ndarray | None = None, gather: int = GATHER) -> list[np.ndarray]:
        """Ids of the words and number of each phrase: of two words, or of three of which each two are in pairs (codes)."""
        size, codes, times = len(self.ids), [], []
        for at in range(0, len(self.word), gather):
            part = slice(at, at + gather)
            first, word, place, bits = self.extended(self.word[part], self.place[part], self.bits[part])
            code = first.astype(np.int64) * size + word
            if pairs is not None:
                known = _position(pairs, code)
                kept = np.flatnonzero(known >= 0)
                pair, word, _, bits = self.extended(known[kept], place[kept], bits[kept])
                kept = np.flatnonzero(_position(pairs, pairs[pair] % size * size + word) >= 0) if len(pair) else pair
                code, bits = pair[kept] * size + word[kept], bits[kept]
            codes.append(code)
            times.append(np.bitwise_count(bits))
        code, inverse = np.unique(np.concatenate(codes), return_inverse=True) if codes else (np.zeros(0, np.int64),) * 2
        n = np.bincount(inverse, np.concatenate(times), len(code)).astype(np.int64) if codes else code
        last = self.ids[code % size] if size else code
        if pairs is None:
            return [self.ids[code // size] if size else code, last, n]
        pair = pairs[code // size] if size and len(pairs) else code
        return [self.ids[pair // size] if size else code, self.ids[pair % size] if size else code, last, n]


def _position(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted code is in the sorted known ones, or -1."""
    if not len(known):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def _told(rows: DataFrame, told: int, word: str | None = None) -> tuple[int, bool]:
    """The number of rows, and whether they are few and short enough to be broadcast."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length(word)) if word else F.lit(0)).first()
    return n, n <= told and (size or 0) <= TOLD_BYTES


class Phrases:
    """The frequent words, pairs and triples of shards."""

    def __init__(self, shards: DataFrame, least: int = LEAST, told: int = TOLD) -> None:
        self.shards, self.least, self.told, self.spark = shards, least, told, shards.sparkSession
        each = shards.select("lang", F.explode(F.arrays_zip("vocab", "held")).alias("w")).select("lang", "w.vocab", "w.held")
        counted = each.groupBy("lang", F.col("vocab").alias("word")).agg(F.sum("held").alias("f")).where(F.col("f") >= least)
        kept = cut(counted.withColumn("_m", F.monotonically_increasing_id()))  # 33 bits count within a partition
        part = F.shiftright("_m", 33).alias("_part")
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = kept.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row for each task
        base = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        dense = F.col("base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
        self.words = kept.withColumn("_part", part).join(F.broadcast(base), "_part").select("lang", "word", "f", dense.alias("id"))
        self.n_words, self.few_words = _told(self.words, told, "word")
        with batches_of(self.spark, 1):  # a shard is large
            self.pairs = self._frequent(["g1", "g2"])
            _, self.few_pairs = _told(self.pairs, told)
            self.triples = self._frequent(["g1", "g2", "g3"])

    def _frequent(self, names: list[str]) -> DataFrame:
        """(names, a) of the frequent phrases.  Numbers of words are dense, so two of them fit a long below PAIRED words, which makes rows short."""
        rows = self._counted(len(names) == 3, False)
        if self.n_words < PAIRED:
            code = F.shiftleft(F.col("g1"), 31).bitwiseOR(F.col("g2"))
            rows = rows.select(code.alias("code"), *names[2:], "n")
            counted = rows.groupBy("code", *names[2:]).agg(F.sum("n").alias("a")).where(F.col("a") >= self.least)
            return cut(counted.select(F.shiftright("code", 31).alias("g1"), F.col("code").bitwiseAND(F.lit((1 << 31) - 1)).alias("g2"), *names[2:], "a"))
        return cut(rows.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= self.least))

    def _collected(self, rows: DataFrame) -> pa.Table:
        """Rows of checked number and size, which go to the driver in large batches, and from there to all shards."""
        with batches_of(self.spark, YIELD_ROWS):
            return rows.toArrow()

    def _counted(self, triples: bool, named: bool) -> DataFrame:
        """The phrases of each shard: (shard if named, g1, g2, g3 if triples, n)."""
        spark, rows = self.spark, self.shards.select("shard", "lang", "vocab", "sizes", "places", "bits")
        languages = pairs = None
        if self.few_words:
            known = self._collected(self.words.select("lang", "word", "id"))
            languages = {lang: known.filter(pc.equal(known["lang"], lang)).drop(["lang"]).combine_chunks() for lang in known["lang"].unique().to_pylist()}
            languages = spark.sparkContext.broadcast({lang: (t["word"].combine_chunks().cast(pa.binary()), t["id"].to_numpy()) for lang, t in languages.items()})
        else:
            each = self.shards.select("shard", "lang", F.posexplode("vocab").alias("k", "word")).join(self.words.select("lang", "word", "id"), ["lang", "word"])
            rows = rows.join(each.groupBy("shard").agg(F.collect_list(F.struct("k", "id")).alias("own_words")), "shard")
        if triples and self.few_pairs:
            known = self._collected(self.pairs.select("g1", "g2"))
            pairs = spark.sparkContext.broadcast((known["g1"].to_numpy(), known["g2"].to_numpy()))
        elif triples:
            own = self._counted(False, True).join(self.pairs, ["g1", "g2"]).groupBy("shard").agg(F.collect_list(F.struct("g1", "g2")).alias("own_pairs"))
            rows = rows.join(own, "shard")
        names = (["shard"] if named else []) + ["g1", "g2", *(["g3"] if triples else []), "n"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    vocab = batch.column("vocab")[k].values
                    ids = np.full(len(vocab), -1, np.int64)
                    if languages is None:
                        own = batch.column("own_words")[k].values
                        ids[own.field("k").to_numpy()] = own.field("id").to_numpy()
                    elif (lang := batch.column("lang")[k].as_py()) in languages.value:
                        words, numbers = languages.value[lang]
                        place = pc.fill_null(pc.index_in(vocab, value_set=words), -1).to_numpy()
                        ids = np.where(place >= 0, numbers[place], -1)
                    maps, codes = Bitmaps(batch, k, ids), None
                    if triples:
                        own = None if pairs is not None else batch.column("own_pairs")[k].values
                        codes = maps.codes(*(pairs.value if own is None else (own.field("g1").to_numpy(), own.field("g2").to_numpy())))
                    found = maps.counts(codes)
                    if named:
                        found = [np.full(len(found[0]), batch.column("shard")[k].as_py(), np.int64), *found]
                    for at in range(0, len(found[0]), YIELD_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + YIELD_ROWS]) for c in found], names)
            release()

        return rows.mapInArrow(run, ", ".join(f"{name} long" for name in names))

    def candidates(self) -> DataFrame:
        """(lang, phrase, a, l, r, score, covered) of all phrases: covered is the largest number of a longer one that holds it."""
        words, pairs = self.words.select("id", "lang", "word", "f"), self.pairs

        def named(df: DataFrame, number: int) -> DataFrame:
            side = words.select(F.col("id").alias(f"g{number}"), F.col("word").cast("string").alias(f"w{number}"), F.col("f").alias(f"f{number}"), *([F.col("lang")] if number == 1 else []))
            return df.join(side, f"g{number}")

        halves = self.triples.select(F.explode(F.array(F.struct("g1", "g2", "a"), F.struct(F.col("g2").alias("g1"), F.col("g3").alias("g2"), "a"))).alias("h")).select("h.*")
        covered = halves.groupBy("g1", "g2").agg(F.max("a").alias("covered"))
        two = named(named(self.pairs.join(covered, ["g1", "g2"], "left"), 1), 2)
        two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("f1"), F.col("f2")).alias("score"), "covered")
        left, right = pairs.select("g1", "g2", F.col("a").alias("f12")), pairs.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("a").alias("f23"))
        three = named(named(named(self.triples.join(left, ["g1", "g2"]).join(right, ["g2", "g3"]), 1), 2), 3)
        cuts = [F.struct(score(F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate((("f1", "f23"), ("f12", "f3")))]  # noqa: E741
        three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(*cuts).alias("cut"))
        return two.unionByName(three.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.lit(None).cast("long").alias("covered")))


def score(left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) of the column a; products have up to 38 digits."""
    a, left, right = (c.cast("decimal(16,0)") for c in (F.col("a"), left, right))
    return F.call_function("div", (a * a).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, covered: int = COVERED, first: int = FIRST, shard_words: int = SHARD_WORDS, told: int = TOLD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` phrases of each language.

    A phrase that a longer one of at least `covered` percent of its occurrences holds is left out.
    """
    spark = df.sparkSession
    path = new_path(spark, "bitmaps")
    shards = build_shards(df, path, text_col, lang_col, shard_words)
    candidates = Phrases(shards, least, told).candidates()
    kept = candidates.where(F.col("covered").isNull() | (F.col("covered") * 100 < F.col("a") * covered))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    result = cut(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    remove(spark, path)
    return result
