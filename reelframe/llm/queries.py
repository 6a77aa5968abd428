"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm import bit_planes, block_max, char_models, exact_dedup, hashed_bpe, phrase_bitmaps, pruned_graph, quality_trees, ring_shards, secret_scan, simhash_trees, tier_packing, transducer_bpe
from reelframe.llm.common import new_path, table

WORD_VOCABULARY, BYTE_VOCABULARY = (public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json"))
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id of each stays."""
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"])


ORACLE_SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by the base rules, each distinct text scanned once, through a ledger that this query writes to the shared folder."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), carry=["doc_id"], ledger=new_path(spark, "ledger"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _spans_sql(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, '{name}' AS name, stop - length(found) AS start, stop FROM (
    SELECT doc_id, found, part, sum(length(piece) + length(found)) OVER (PARTITION BY doc_id ORDER BY nth) AS stop FROM (
      SELECT doc_id, unnest(pieces[:len(hits)]) AS piece, unnest(hits) AS found, unnest(parts) AS part, unnest(range(len(hits))) AS nth FROM (
        SELECT doc_id, string_split_regex(text, '{quoted}') AS pieces, regexp_extract_all(text, '{quoted}') AS hits,
               regexp_extract_all(text, '{quoted}', {group}) AS parts
        FROM texts WHERE regexp_matches(text, '{quoted}'))))
  WHERE length(part) >= {least}"""


ORACLE_SQL["op6_secret_scan"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_spans_sql(k, *rule) for k, rule in enumerate(secret_scan.RULES))}),
said AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN said USING (doc_id)
"""


@query
def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of a consistent-hash ring with bounded loads."""
    return ring_shards.assign_shards(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query
def op2_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    decoded = transducer_bpe.encode(table(spark, sf_dir, "documents"), WORD_VOCABULARY, carry=["doc_id"], decoded=True)
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return tier_packing.pack(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, end_id=0)


@query
def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read back from a store of bit planes that this query writes to the shared folder."""
    path = new_path(spark, "bit-planes")
    bit_planes.write_tokens(table(spark, sf_dir, "documents"), path, WORD_VOCABULARY, end_id=2)
    read = bit_planes.read_tokens(spark, path)
    return read.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op3_char_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of the ids is held out."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    models = char_models.train(documents, ~held_out)
    found = char_models.identify(documents, models, carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; a fifth of the ids is held out."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    trees = quality_trees.train(documents, table(spark, sf_dir, "labels"), ~held_out)
    found = quality_trees.score(documents, trees, carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op5_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of near-duplicates."""
    return simhash_trees.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours of each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    index, cells = pruned_graph.build_index(vectors)
    return pruned_graph.search(index, cells, vectors.where(F.col("vec_id") % 100 == 0))


@query
def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each item of the benchmark."""
    index = block_max.build_index(table(spark, sf_dir, "documents"))
    found = block_max.search(index, table(spark, sf_dir, "benchmark"))
    index.remove()
    return found


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL["op11_block_max"] = f"""
WITH held AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{block_max.TERM}')) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{block_max.TERM}')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS d, sum(n)::BIGINT AS l FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * d + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term, d),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * d) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_phrase_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return phrase_bitmaps.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_phrase_bitmaps"] = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, p, count(*) AS f FROM (
    SELECT lang, unnest(w) AS p FROM words
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words) GROUP BY ALL),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, p, f AS a, string_split(p, ' ') AS w FROM phrases WHERE f >= 10 AND p LIKE '% %'),
cuts AS (
  SELECT lang, p, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
  UNION ALL SELECT lang, p, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE len(w) = 3),
scored AS (
  SELECT c.lang, c.p, a, k, h.f AS l, t.f AS r, CAST(1000000 * a::HUGEINT * a // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts c JOIN phrases h ON h.lang = c.lang AND h.p = head JOIN phrases t ON t.lang = c.lang AND t.p = tail
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p, max(a) AS m FROM (
    SELECT lang, w[1] || ' ' || w[2] AS p, a FROM candidates WHERE len(w) = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE len(w) = 3) GROUP BY ALL),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.p) AS rank
  FROM scored s LEFT JOIN longer USING (lang, p) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, rank, p AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op13_hashed_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids and decoded bytes of every document, as digests."""
    decoded = hashed_bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, carry=["doc_id"], decoded=True)
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
