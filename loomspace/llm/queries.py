"""The registered queries of the training-data operators: (spark, sf_dir) to a DataFrame, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_dir


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    # one store for all runs of this query: what an earlier one counted is not encoded again
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path(), f"{shared_dir(spark)}/token-cache")


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_matches

    return license_matches(read_table(spark, sf_dir, "documents"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import quality_scores

    found = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), train=_fold(5) != 0)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    found = toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), train=_fold(3) != 1)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("h")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    return bpe_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, counted, named, personal_data

    found = personal_data(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(counted("base", k).alias(f"n_{k}") for k in KINDS), F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    found = quality_rules(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("quality").alias("posterior"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_components

    return simhash_components(read_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
}

#: Words of `documents` and `benchmark`, windows of ten words joined by a character that no word holds, and the words that their occurrences cover;
#: and items of which three quarters of the pairs of neighbours stand within three words of where one start asks for them.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), m AS (
  SELECT DISTINCT doc_id, item_id, s, dw.k FROM dw JOIN bw USING (k, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id
), np AS (
  SELECT doc_id, pos, w[pos] AS w1, w[pos + 1] AS w2 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS pos FROM d WHERE len(w) > 1)
), ip AS (
  SELECT item_id, v, greatest(1, ceil((len(w) - 1) * 0.75)) AS need, off, w[off] AS w1, w[off + 1] AS w2
  FROM (SELECT item_id, w, row_number() OVER () AS v, unnest(range(1, len(w))) AS off FROM b WHERE len(w) > 1)
), near AS (
  SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, item_id, v, need, off, unnest(range(pos - off - 3, pos - off + 4)) AS start FROM np JOIN ip USING (w1, w2))
  GROUP BY doc_id, item_id, v, need, start HAVING count(*) >= need
), nr AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM near GROUP BY doc_id
), it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(nr.items, '')) AS near_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""

#: All 200-byte strings of all documents, those that start twice, and the maximal runs that they cover. Row by row, as repeated rows are documents too.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, s, b[s + 1 : s + 200] AS bytes FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS s FROM d WHERE octet_length(b) >= 200)),
twice AS (SELECT bytes FROM w GROUP BY bytes HAVING count(*) > 1),
hit AS (SELECT r, s FROM w SEMI JOIN twice USING (bytes)),
marked AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS run FROM (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM hit)),
runs AS (SELECT r, run, min(s) AS a, max(s) + 200 AS z FROM marked GROUP BY r, run),
gaps AS (
  SELECT r, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS f, a AS t FROM runs
  UNION ALL SELECT d.r, coalesce(max(z), 0), octet_length(any_value(b)) FROM d LEFT JOIN runs USING (r) GROUP BY d.r
),
kept AS (SELECT g.r, string_agg(hex(b[f + 1 : t]), '' ORDER BY f, t) AS h FROM gaps g JOIN d USING (r) GROUP BY g.r),
sums AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""

ORACLES: dict[str, str] = {"op6_decontamination": OP6_SQL, "op10_suffix_dedup": OP10_SQL}
