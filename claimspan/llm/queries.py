"""The registered queries of the operators, over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimspan.llm import (
    decontamination, extraction, line_dedup, mixing, neighbours, periodic_runs, quality,
    quality_rules, sanitisation, simhash, substring_dedup, suffix_tree, tokenizer_alignment,
)
from claimspan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        table(spark, sf_dir, "labels"), keep_text=False)


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"),
                            table(spark, sf_dir, "labels"))
    return judged.drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"),
                                  table(spark, sf_dir, "benchmark"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.report(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), exact_chars=1)


def op8_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitisation.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_neighbours": op6_neighbours,
    "op7_line_dedup": op7_line_dedup,
    "op8_sanitisation": op8_sanitisation,
    "op9_simhash": op9_simhash,
    "op10_extraction": op10_extraction,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k
            FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
first AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS p
         FROM windows JOIN first USING (k), unnest(range(50)) AS t(o) WHERE least < doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)
         ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}',
             '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
                   array_to_string(list_slice(w, i, i + 9), ' ') AS k
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
spans AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
          FROM d, (SELECT DISTINCT n FROM windows) AS sizes,
               unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT doc_id, i, n, item_id FROM spans JOIN windows USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit
         FROM found, unnest(range(n)) AS t(o) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items,
                 string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found)
          GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

_CRC32 = """list_reduce([4294967295] || list_transform(
  string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda acc, code: list_reduce([xor(acc, code)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda x, zero: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

_RUNS = rf"""
WITH cut AS (SELECT doc_id, xor({_CRC32}, 4294967295) AS h,
                    regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w
             FROM documents),
laid AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS loops,
                CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS g8
         FROM cut),
numbered AS (SELECT doc_id, n, i, CASE WHEN loops AND i >= a
                    THEN w[a + (i - a) % (1 + (n - a) // (3 + g8)) + 1] ELSE w[i + 1] END AS word
             FROM laid, unnest(range(n)) AS t(i)),
matches AS (SELECT x.doc_id, x.i, x.i - y.i AS lag
            FROM numbered AS x JOIN numbered AS y USING (doc_id, word)
            WHERE x.i > y.i AND 2 * (x.i - y.i) <= x.n),
stretches AS (SELECT doc_id, lag, min(i) - lag AS start, count(*) + lag AS length
              FROM (SELECT doc_id, lag, i, i - row_number() OVER (
                           PARTITION BY doc_id, lag ORDER BY i) AS island FROM matches)
              GROUP BY doc_id, lag, island),
runs AS (SELECT doc_id, start, length, min(lag) AS period FROM stretches
         WHERE length >= 12 AND length >= 2 * lag GROUP BY doc_id, start, length),
told AS (SELECT doc_id, count(*) AS n_runs,
                string_agg(start || ',' || length || ',' || period || chr(10), ''
                           ORDER BY start, period) AS runs,
                first(start ORDER BY length DESC, start, period) AS start,
                first(length ORDER BY length DESC, start, period) AS length,
                first(period ORDER BY length DESC, start, period) AS period
         FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i
         FROM runs, unnest(range(start + period, start + length)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
         FROM numbered ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
       1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
       sha256(coalesce(text, '')) AS collapsed_sha256
FROM cut LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: The others train models, search approximately, or hash by functions that SQL lacks; they are
#: tested against brute force, definitions and held-out labels in tests/llm.
ORACLE: dict[str, str] = {
    "op1_substring_dedup": _SUBSTRINGS,
    "op5_decontamination": _LEAKS,
    "op12_periodic_runs": _RUNS,
}
