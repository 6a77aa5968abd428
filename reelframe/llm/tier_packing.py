"""Hierarchical packing of token ids into sequences of several lengths.

A document's whole windows of the longest tier become sequences where it is encoded, without their ids going anywhere.
What remains, less than a window, is dealt into blocks of about BLOCK_DOCUMENTS by hash, and each block is packed by
itself.  Within a block a remainder is routed to the tier that is the next power of two.  Tier by tier from the longest,
each window opens with the longest remainder of its tier; its gap is filled with the longest remainders of shorter tiers
that fit; if none fits, the shortest remainder is cut, and what is left of it is routed again.  So every window is full
except the last one of a block.  Sequences are dealt into step groups of nearly equal numbers of tokens, the longest first
to the group that has least; whole windows take part in that by a row without ids.

A window's length is a power of two; only the last window of a block needs padding, to the longest tier.  A block holds
less than a window for each of its documents, however long they are.

Defined results: a null text counts as empty and has its end id alone; null ids are packed like others; rows that
repeat share a block, or several if they are more than a block takes; a document of any length is cut into as many
windows as it needs; an empty table gives no piece.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import packed, small
from reelframe.llm.piece_cache import library_cache

TIERS = (1024, 512, 256, 128, 64)
BLOCK_DOCUMENTS = 2048
STEP_TOKENS = 1 << 16
YIELD_ROWS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: What is known of a window or remainder where its document is encoded: name, type in Spark, type in Arrow.
ENCODED = (
    ("_id", "long", pa.int64()),
    ("_block", "int", pa.int32()),
    ("_start", "long", pa.int64()),
    ("_crc", "long", pa.int64()),
    ("_tokens", "long", pa.int64()),
    ("_wide", "boolean", pa.bool_()),
    ("_ids", "binary", pa.binary()),
)


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """(document, start, length, sequence, offset) of each piece, and (tier, tokens) of each sequence."""
    longest = tiers[0]
    pieces, sequences, rest = [], [], []
    for document, n in enumerate(lengths):
        for start in range(0, n - n % longest, longest):
            pieces.append((document, start, longest, len(sequences), 0))
            sequences.append((longest, longest))
        if n % longest:
            rest.append((n % longest, document, n - n % longest))
    rest.sort()
    for tier, shorter in zip(tiers, (*tiers[1:], 0), strict=True):
        while rest and rest[-1][0] > shorter:
            n, document, start = rest.pop()
            pieces.append((document, start, n, len(sequences), 0))
            used = n
            while used < tier and rest:
                gap = tier - used
                at = bisect_right(rest, (gap, len(lengths), 0)) - 1
                n, document, start = rest.pop(max(at, 0))
                if n > gap:
                    insort(rest, (n - gap, document, start + gap))
                    n = gap
                pieces.append((document, start, n, len(sequences), used))
                used += n
            sequences.append((tier, used))
    return pieces, sequences


def step_groups(sequences: list[tuple[int, int]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence; groups differ by the tokens of a sequence at most."""
    total = sum(tokens for _, tokens in sequences)
    groups = [(0, g) for g in range(max(1, round(total / step_tokens)))]
    out = [0] * len(sequences)
    for k in sorted(range(len(sequences)), key=lambda k: -sequences[k][1]):
        tokens, g = heapq.heappop(groups)
        out[k] = g
        heapq.heappush(groups, (tokens + sequences[k][1], g))
    return out


def _pack_block(block: pa.Table) -> pa.Table:
    """The pieces of the whole windows (without ids) and of the remainders of a block."""
    order = pc.sort_indices(block, [(name, "ascending") for name in ("_id", "_start", "_ids")], null_placement="at_start")
    block = block.take(order).combine_chunks()
    known, first_ids = {name: block[name].to_numpy() for name in ("_start", "_crc", "_tokens")}, block["_ids"]
    is_whole = first_ids.is_null().to_numpy()
    whole, rest = np.flatnonzero(is_whole), np.flatnonzero(~is_whole)
    wide = "<u4" if block["_wide"][0].as_py() else "<u2"
    texts = [np.frombuffer(first_ids[k].as_py(), wide).astype("<u4") for k in rest.tolist()]
    pieces, sequences = pack_lengths([len(ids) for ids in texts])
    sequences = [(TIERS[0], TIERS[0])] * len(whole) + sequences
    groups, base = np.array(step_groups(sequences), np.int64), block["_block"][0].as_py() << 32
    document, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True)) if pieces else [np.zeros(0, np.int64)] * 5
    crc = [zlib.crc32(texts[d][s : s + n]) for d, s, n, _, _ in pieces]
    row, sequence = np.concatenate([whole, rest[document]]), np.concatenate([np.arange(len(whole)), sequence + len(whole)])
    none = np.zeros(len(whole), np.int64)
    return pa.table(
        {
            "doc_id": block["_id"].take(pa.array(row)),
            "start": known["_start"][row] + np.concatenate([none, start]),
            "length": np.concatenate([none + TIERS[0], length]),
            "ids_crc32": np.concatenate([known["_crc"][whole], np.array(crc, np.int64)]),
            "doc_tokens": known["_tokens"][row],
            "sequence_id": base + sequence,
            "offset": np.concatenate([none, offset]),
            "tier": np.array([t for t, _ in sequences], np.int32)[sequence],
            "step_group": base + groups[sequence],
        }
    )


def _blocked(rows: DataFrame, blocks: int, block_documents: int) -> DataFrame:
    """rows with _block, by a hash of id and text; rows that repeat beyond a block's size take several blocks."""
    keyed = rows.withColumn("_key", F.xxhash64("_id", "_text"))
    many = small(keyed.groupBy("_key").count().where(F.col("count") > block_documents).select("_key", F.lit(True).alias("_many")))
    if not many.isEmpty():
        keyed = keyed.join(many, "_key", "left").withColumn("_key", F.when(F.col("_many"), F.xxhash64("_key", F.monotonically_increasing_id())).otherwise(F.col("_key")))
    return keyed.select("_id", "_text", F.pmod("_key", F.lit(blocks)).cast("int").alias("_block"))


def pack(df: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """The pieces of all documents, as PIECES; the ids of a sequence are its pieces in order of offset."""
    blocks = max(1, -(-df.count() // block_documents))
    rows = _blocked(packed(df, text_col, id_col, [], []).select(F.col("_id").cast("long").alias("_id"), "_text"), blocks, block_documents)
    window = TIERS[0]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        with library_cache(vocabulary).task() as cache:
            wide = max(end_id + 1, cache.tokenizer.get_vocab_size()) > 1 << 16  # else ids travel in two bytes
            for batch in batches:
                # text by text, as a batch of long texts is several times as large in Python's strings
                coded, out = cache.encode(text.as_py() for text in batch.column("_text")), []
                for name, block in zip(batch.column("_id").to_pylist(), batch.column("_block").to_pylist(), strict=True):
                    ids = next(coded) + end
                    n = len(ids) // 4
                    for k in range(n // window):
                        out.append((name, (block + k) % blocks, k * window, zlib.crc32(memoryview(ids)[4 * k * window : 4 * (k + 1) * window]), n, wide, None))
                    if n % window:
                        rest = np.frombuffer(ids, "<u4", offset=4 * (n - n % window))
                        out.append((name, block, n - n % window, 0, n, wide, (rest if wide else rest.astype("<u2")).tobytes()))
                    if len(out) >= YIELD_ROWS:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    schema = ", ".join(f"{name} {kind}" for name, kind, _ in ENCODED)
    return rows.mapInArrow(encoded, schema).groupBy("_block").applyInArrow(_pack_block, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, (_, _, kind) in zip(zip(*rows, strict=True), ENCODED, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _, _ in ENCODED])
