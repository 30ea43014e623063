"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from quadrant.llm import exact_dedup, fill_in_middle, language_id, lexical_search, lm_scoring, quality_classifier, secret_scan, sentencepiece_codec, simhash_neardup, source_mix, token_counts, tool_calls, topk_search
from quadrant.llm.common import id_remainder, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    filters = language_id.learn(documents.filter(id_remainder("doc_id", 4) != 2))
    return (language_id.predict(documents, filters)
            .select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_classifier.learn(documents, table(spark, sf_dir, "labels"), id_remainder("id", 5) != 0)
    return (quality_classifier.scores(documents, model)
            .select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return tool_calls.link(tool_calls.calls_of(conversations), tool_calls.results_of(conversations), tool_calls.SCHEMAS)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *[number(k) for k in secret_scan.BASE],
                        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), id_remainder("id", 5) != 1)
    return scored.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score", "bits_per_byte")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(c):
        return F.sha2(c.cast("binary"), 256)

    return (fill_in_middle.transform(table(spark, sf_dir, "documents"), seed=7)
            .select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                    digest(fill_in_middle.restored()).alias("restored_sha256")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE_OP4 = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM conversations
), calls AS (
  SELECT conv_id, 'call_' || conv_id || '_' || turn AS call_id, turn,
         CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name, text, words,
         CASE WHEN role = 'user' AND turn >= 2 THEN 'call_' || conv_id || '_' || (turn - 2) END AS after
  FROM turns WHERE role IN ('user', 'system')
), results AS (
  SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, count(*) AS n, min(turn) AS turn,
         arg_min(text, (turn, text)) AS result
  FROM turns WHERE role = 'assistant' GROUP BY ALL
), edges AS (
  SELECT DISTINCT c.conv_id, c.call_id, c.after FROM calls c
  JOIN calls p ON p.conv_id = c.conv_id AND p.call_id = c.after
), ranked AS (
  SELECT DISTINCT conv_id, call_id, 0 AS level FROM calls ANTI JOIN edges USING (conv_id, call_id)
  UNION ALL
  SELECT e.conv_id, e.call_id, r.level + 1 FROM edges e JOIN ranked r ON r.conv_id = e.conv_id AND r.call_id = e.after
), linked AS (
  SELECT c.*, k.level, r.result, e.call_id IS NULL AND c.after IS NOT NULL AS dangling,
         CASE WHEN r.n IS NULL THEN 'no_result' WHEN r.n > 1 THEN 'many_results' ELSE 'linked' END AS status,
         CASE c.name WHEN 'ask' THEN 'query' ELSE 'instructions' END AS key
  FROM calls c JOIN ranked k USING (conv_id, call_id)
  LEFT JOIN results r USING (conv_id, call_id) LEFT JOIN edges e USING (conv_id, call_id)
), checked AS (
  SELECT *, list_filter([
      CASE WHEN text IS NULL THEN 'missing ' || key WHEN length(text) NOT BETWEEN 1 AND 2000 THEN 'range ' || key END,
      CASE WHEN words IS NULL THEN 'missing words' WHEN words NOT BETWEEN 1 AND 60 THEN 'range words' END,
      CASE WHEN dangling THEN 'unknown call ' || after END], lambda x: x IS NOT NULL) AS errors,
    '{' || array_to_string(list_filter([
      CASE WHEN after IS NOT NULL THEN '"after":' || to_json(after)::VARCHAR END,
      CASE WHEN text IS NOT NULL THEN '"' || key || '":' || to_json(text)::VARCHAR END,
      CASE WHEN words IS NOT NULL THEN '"words":' || words END], lambda x: x IS NOT NULL), ',') || '}' AS arguments
  FROM linked
)
SELECT conv_id, call_id, turn, name, status, level, array_to_string(errors, ',') AS errors,
       '{"arguments":' || arguments || ',"call_id":' || to_json(call_id)::VARCHAR
       || ',"depends_on":' || CASE WHEN after IS NULL THEN '[]' ELSE to_json([after])::VARCHAR END
       || ',"errors":' || to_json(errors)::VARCHAR || ',"level":' || level || ',"name":' || to_json(name)::VARCHAR
       || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result)::VARCHAR END
       || ',"status":' || to_json(status)::VARCHAR || '}' AS record
FROM checked
UNION ALL
SELECT conv_id, call_id, turn, NULL, 'orphan_result', NULL, '',
       '{"call_id":' || to_json(call_id)::VARCHAR || ',"errors":[]'
       || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result)::VARCHAR END || ',"status":"orphan_result"}'
FROM results ANTI JOIN calls USING (conv_id, call_id)
"""

ORACLE_OP6 = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), groups AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t
)
SELECT r.doc_id, g.keep_id, g.group_size, r.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(r.t) AS text_sha256
FROM rows r JOIN groups g ON r.t = g.t
"""

ORACLE_OP9 = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


ORACLE_OP12 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), parts AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS p,
         [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM texts
), lines AS (
  SELECT doc_id, t, h, list_filter(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || chr(10) ELSE x END),
                                   lambda x: x <> '') AS units FROM parts
), cuts AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
         greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
              WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lines
), pieces AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
"""

ORACLE_OP13 = r"""
WITH terms AS (
  SELECT d, doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), wanted AS (
  SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL
), lengths AS (
  SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY d
), corpus AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths
), postings AS (
  SELECT d, term, count(*) AS tf FROM terms SEMI JOIN wanted USING (term) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, corpus GROUP BY term, docs
), impacts AS (
  SELECT p.d, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))) AS impact
  FROM postings p JOIN weights USING (term) JOIN lengths USING (d), corpus
), scores AS (
  SELECT item_id, d, sum(times * impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM scores JOIN lengths USING (d) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_language_id": op2_language_id,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_tool_calls": op4_tool_calls,
        "op5_secret_scan": op5_secret_scan,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_source_mix": op7_source_mix,
        "op8_simhash": op8_simhash,
        "op9_topk_search": op9_topk_search,
        "op10_token_counts": op10_token_counts,
        "op11_lm_scoring": op11_lm_scoring,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_lexical_search": op13_lexical_search,
    }


def oracles() -> dict[str, str]:
    return {
        "op4_tool_calls": ORACLE_OP4,
        "op6_exact_dedup": ORACLE_OP6,
        "op9_topk_search": ORACLE_OP9,
        "op12_fill_in_middle": ORACLE_OP12,
        "op13_lexical_search": ORACLE_OP13,
    }
