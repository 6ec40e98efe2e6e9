"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintbook.llm import (
    chat,
    exact_dedup,
    hard_negatives,
    jaccard_join,
    language_id,
    licenses,
    mixing,
    quality,
    repeated_passages,
    sentence_pieces,
    suffix_dedup,
    token_alignment,
    token_counts,
)

BYTE_PAIRS = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))


def _counts(docs: DataFrame) -> DataFrame:
    return token_counts.count_tokens(docs, public_tokenizers.path(BYTE_PAIRS))


def _pieces(docs: DataFrame) -> DataFrame:
    return sentence_pieces.round_trip(docs, public_tokenizers.path(PIECES))


def _languages(docs: DataFrame) -> DataFrame:
    return language_id.identify(docs, language_id.train(docs))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and number -1, whose texts hold control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    digests = chat.chat_digests(rows.unionByName(more), public_tokenizers.path(BYTE_PAIRS))
    # The counts of tokens are tested against the library; the rest has SQL.
    return digests.drop("n_tokens", "loss_tokens")


def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def _passages(docs: DataFrame) -> DataFrame:
    cut = repeated_passages.without_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _alignment(docs: DataFrame) -> DataFrame:
    paths = public_tokenizers.path(BYTE_PAIRS), public_tokenizers.path(PIECES)
    return token_alignment.link_counts(docs, *paths)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _on_documents(quality.quality),
        "op2_sentence_pieces": _on_documents(_pieces),
        "op3_suffix_dedup": _on_documents(suffix_dedup.repeated_bytes),
        "op4_chat_format": _chats,
        "op5_token_counts": _on_documents(_counts),
        "op6_license_scan": _on_documents(licenses.scan),
        "op7_language_id": _on_documents(_languages),
        "op8_jaccard_join": _on_documents(jaccard_join.components),
        "op9_source_mixing": _on_documents(mixing.schedule),
        "op10_exact_dedup": _on_documents(exact_dedup.duplicates),
        "op11_hard_negatives": _negatives,
        "op12_passage_dedup": _on_documents(_passages),
        "op13_token_alignment": _on_documents(_alignment),
        "pipeline": corpus_pipeline.run,
    }


_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

# All pairs of documents that share a shingle; for small tables only.
_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM w
), n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s), x AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS x FROM s
), common AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), linked AS MATERIALIZED (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id
FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


# Every window of 50 bytes by itself; for small tables only.
_REPEATED = """
WITH d AS MATERIALIZED (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n_bytes
  FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, i, b[i:i + 49] AS x
  FROM (SELECT doc_id, b, unnest(range(1, n_bytes - 48)) AS i FROM d)
), least AS (
  SELECT x, min(doc_id) AS m FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT w.doc_id, w.i FROM w JOIN least ON w.x = least.x WHERE w.doc_id > least.m
), marked AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER o > 50, true) AS new FROM hit
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT doc_id, i, count_if(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), runs AS (
  SELECT doc_id, min(i) AS first, max(i) + 49 AS last FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, first, last, 1 + coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0)
    AS from_ FROM runs
), cut AS (
  SELECT g.doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans, max(last) AS last,
         string_agg(hex(d.b[from_:first - 1]), '' ORDER BY first) AS kept
  FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id
)
SELECT d.doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       CASE WHEN last IS NULL THEN sha256(b)
            ELSE sha256(unhex(kept || hex(b[last + 1:n_bytes]))) END AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

# The marks of a turn have 12 and 10 characters; a line feed follows the role and the end.
_CHATS = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT *, role = 'assistant' AS loss,
    length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n_text,
    length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'),
                          '<(\\*)\|', '<\1\\|', 'g')) AS n_role
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (loss), ''))
    AS loss_sha256,
  sum(12 + n_role + 1 + n_text + 10 + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_LICENSES = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), p AS MATERIALIZED (
  SELECT string_split(phrase, ' ') AS phrase, label FROM (VALUES {phrases}) v(phrase, label)
), words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(t, '{word}') AS w FROM d
), places AS (
  SELECT doc_id, label, i - 1 AS i
  FROM (SELECT doc_id, w, label, phrase, unnest(range(1, len(w) + 1)) AS i FROM words, p
        WHERE list_has_all(w, phrase))
  WHERE w[i:i + len(phrase) - 1] = phrase
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         list(DISTINCT label) AS base FROM places GROUP BY doc_id
), template AS MATERIALIZED (
  SELECT name, own, len(own) AS n, ceil({threshold} * len(own) - 1e-9) AS need,
         2 * len(said) AS size, (len(said) + 1) // 2 AS step
  FROM (SELECT name, said, list_distinct(said) AS own
        FROM (SELECT name, regexp_extract_all(lower(said), '{word}') AS said
              FROM (VALUES {templates}) v(name, said)))
), lines AS (
  SELECT doc_id, k, regexp_extract_all(line, '{word}') AS w
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line,
               generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)
), matched AS (
  SELECT doc_id, k, name, len(list_intersect(own, w)) AS found, n, need FROM lines, template
  WHERE len(list_intersect(own, w)) >= need
), windows AS (
  SELECT doc_id, name, own, n, need, w[a + 1:a + size] AS w
  FROM (SELECT doc_id, w, name, own, n, need, size, unnest(range(0, len(w), step)) AS a
        FROM words, template WHERE len(list_intersect(own, w)) >= need)
), within AS (
  SELECT doc_id, name, len(list_intersect(own, w)) AS found, n FROM windows
  WHERE len(list_intersect(own, w)) >= need
), every AS (
  SELECT doc_id, name, found / n AS share, k, 0 AS at_window FROM matched
  UNION ALL SELECT doc_id, name, found / n, NULL, 1 FROM within
), more AS (
  SELECT doc_id, list(DISTINCT name) AS names, max(share) AS score,
         count(DISTINCT k) AS n_lines, sum(at_window)::BIGINT AS n_windows FROM every GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(names, [])))),
                  ',') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_windows, 0) AS n_windows
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


# All rows against each anchor.
_NEGATIVES = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r ON a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
         ::INTEGER AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""


# Every window of 50 words by itself; for small tables only.
_PASSAGES = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), least AS (
  SELECT x, min(doc_id) AS m FROM x GROUP BY x HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, list(i) AS hits FROM x JOIN least USING (x) WHERE doc_id > m GROUP BY doc_id
), marked AS (
  SELECT doc_id, list_distinct(flatten(list_transform(hits, lambda i: range(i, i + 50)))) AS gone
  FROM hit
), kept AS (
  SELECT doc_id, list(w[i] ORDER BY i) AS kept
  FROM (SELECT doc_id, w, gone, unnest(range(1, len(w) + 1)) AS i FROM d JOIN marked USING (doc_id))
  WHERE NOT list_contains(gone, i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE coalesce(kept, []) END, ' '))
         AS kept_sha256
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _license_sql() -> str:
    rows = lambda table: ", ".join(f"('{k}', '{v}')" for k, v in table.items())
    return _LICENSES.format(
        phrases=rows(licenses.PHRASES),
        templates=rows(licenses.TEMPLATES),
        threshold=licenses.THRESHOLD,
        word=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_dedup": _REPEATED,
        "op4_chat_format": _CHATS,
        "op6_license_scan": _license_sql(),
        "op8_jaccard_join": _JACCARD,
        "op10_exact_dedup": _DEDUP,
        "op11_hard_negatives": _NEGATIVES,
        "op12_passage_dedup": _PASSAGES,
    }
