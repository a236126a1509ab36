"""The numbered queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import alignment, chat, decontaminate, exact_dedup, fill_middle, language, lm_score, packing, simhash, span_dedup, token_counts, toxicity, url_filter
from crosspanel.llm.common import table
from crosspanel.llm.url_filter import Rule

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_OF_DOCUMENT = 50_256

RULES = [
    Rule(True, "org", "/"),
    Rule(False, "example.org", "/es/"),
    Rule(False, "example.org", "/en/1"),
    Rule(True, "com", "/fr/"),
    Rule(False, "com", "/de/"),
]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(more), BYTES), BYTES)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the document whose number is a segment of their url: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    number = F.expr("try_cast(regexp_extract(url_path, '/([0-9]{1,18})(?:[./]|$)', 1) as long)")
    numbered = pages.withColumn("url_path", url_filter.url_path("url")).select("page_id", number.alias("doc_id"))
    return url_filter.judge_urls(pages, numbered.join(labels, "doc_id").select("page_id", "bad"), RULES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), BYTES, END_OF_DOCUMENT)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality and not toxic."""
    target = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), target, BYTES)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out("doc_id", 4, 2)
    learned = language.learn_filter(docs.filter(~out))
    return language.identify(docs, learned).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.held_out("doc_id", 5, 0)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels").filter(~out))
    return toxicity.toxicity_scores(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTES, PIECES, digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fill_middle.restored(), 256)}).drop("output")


def op13_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = span_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_chat_format, op3_url_filter, op4_token_counts, op5_decontaminate, op6_pack, op7_lm_score, op8_simhash, op9_language_id, op10_toxicity, op11_align, op12_fill_in_middle, op13_span_dedup)
}

_ESCAPES = r"(\\|<turn>|</turn>|### System:|### User:|### Assistant:|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size,
               doc_id = keep_id AND row_number() OVER (PARTITION BY doc_id, text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op2_chat_format": rf"""
        WITH t AS (
          SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(15 + length(regexp_replace(role, '{_ESCAPES}|\n)', '\\\1', 'g')) + length(regexp_replace(text, '{_ESCAPES})', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op12_fill_in_middle": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        k AS (
          SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                 CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        c AS (
          SELECT doc_id, t, n,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                 array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
                 array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
                 array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM c""",
    "op13_span_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT r, w, unnest(range(1, CAST(len(w) AS BIGINT) - 33)) AS i FROM d),
        h AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS window_words FROM p),
        g AS (SELECT window_words FROM h GROUP BY window_words HAVING count(*) > 1),
        c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS place FROM h SEMI JOIN g USING (window_words)),
        v AS (SELECT r, unnest(w) AS word, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS place FROM d),
        k AS (SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept FROM v ANTI JOIN c USING (r, place) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (r)""",
}
