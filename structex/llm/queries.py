"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structex.llm import (
    alignment,
    attention_lm,
    collocations,
    license_scan,
    line_dedup,
    media,
    mixing,
    packing,
    quality_model,
    quality_rules,
    role_repair,
    similarity_join,
    url_filter,
)
from structex.llm.common import table


def op8_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.format_chats(table(spark, sf_dir, "conversations"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = similarity_join.jaccard_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "n_links")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(table(spark, sf_dir, "documents")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("spans")
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.aligned(table(spark, sf_dir, "documents")))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_quality_classifier,
    op2_best_fit_packing,
    op3_attention_lm,
    op4_license_scan,
    op5_lossless_webp,
    op6_line_dedup,
    op7_source_mixing,
    op8_chat_role_repair,
    op9_ngram_jaccard_join,
    op10_quality_rules,
    op11_token_alignment,
    op12_url_filter,
    op13_phrase_collocations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: Words of a text, and their number; the thresholds are those of quality_rules and similarity_join.
_WORDS = r"""w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)"""

QUALITY_SQL = f"""
WITH {_WORDS},
t AS (SELECT doc_id, k, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS k FROM w)),
r AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT k + j) AS covered FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, len(x) - len(list_distinct(x)) AS dup FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\\x20\\x09-\\x0D]')) AS x FROM w)),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words,
  len(string_split(text, chr(10))) AS n_lines, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_exclaim,
  len(list_filter(generate_series(2, len(words)), lambda k: words[k] = words[k - 1])) AS n_adjacent
  FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 100 * n_dup_lines > 40 * n_lines
    OR 100 * n_upper > 40 * word_chars OR 100 * n_exclaim > 25 * n_words OR 100 * n_adjacent > 25 * n_words) AS kept FROM b"""

JACCARD_SQL = f"""
WITH RECURSIVE {_WORDS},
g AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[k:k + 4], ' ') END AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS k FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u)
SELECT u AS doc_id, min(v) AS class_id, (SELECT count(*) FROM e WHERE e.u = reach.u) AS n_links FROM reach GROUP BY u"""


#: Phrases of 2 to 3 words, found 10 times, and the lowest-scoring cut of each; by language.
COLLOCATION_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
k AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS k FROM w WHERE len(words) > 0),
g AS (SELECT lang, 1 AS m, words[k] AS phrase FROM k UNION ALL SELECT lang, 2, words[k] || ' ' || words[k + 1] FROM k WHERE k < len(words)
  UNION ALL SELECT lang, 3, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] FROM k WHERE k + 1 < len(words)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND f >= 10),
parts AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 10 AND m < 3),
cuts AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
cut AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts JOIN parts l ON l.lang = cuts.lang AND l.phrase = first JOIN parts r ON r.lang = cuts.lang AND r.phrase = rest),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(words[s:s + 1], ' ') AS phrase
  FROM (SELECT *, unnest([1, 2]) AS s FROM c WHERE m = 3)) GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON best.lang = longer.lang AND best.phrase = longer.phrase WHERE longer.a IS NULL OR 100 * longer.a < 50 * best.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON kept.lang = n.lang QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL form (trained models, codecs, packings, seeded choices): tests hold
    them against brute force, round trips and held-out labels."""
    return {"op9_ngram_jaccard_join": JACCARD_SQL, "op10_quality_rules": QUALITY_SQL, "op13_phrase_collocations": COLLOCATION_SQL}
