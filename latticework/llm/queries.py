"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annsearch, bpe, chatformat, embdup, filteraudit, langid, mixing, neardup, periods, quality, secrets, shared, toxicity, warc


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, in it and under its encodings."""
    found = secrets.scan_documents(spark, shared.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["via"] == "")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("base", base).select("doc_id", *map(count, secrets.KINDS), F.sha2(secrets.told("base"), 256).alias("base_sha256"), secrets.told("spans").alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text, learned from the labels outside the held-out fold."""
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    vectors, net = quality.train(spark, docs, labels, usable=shared.fold("doc_id", 3) != 1)
    found = quality.score(spark, docs, vectors, net)
    return found.select("doc_id", (shared.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    found = warc.read(spark, warc.write(spark, shared.table(spark, sf_dir, "pages")))
    return found.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text, learned from the labels outside the held-out fold."""
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    model = toxicity.train(spark, docs, labels, usable=shared.fold("doc_id", 4) != 2)
    found = toxicity.score(spark, docs, model)
    return found.select("doc_id", (shared.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "posterior")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.taken(spark, mixing.mix(spark, shared.table(spark, sf_dir, "documents")))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of every vector whose id 20 divides."""
    return annsearch.search(spark, shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every whole text."""
    return bpe.digest_documents(spark, shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by a model of the documents outside the held-out fold."""
    docs = shared.table(spark, sf_dir, "documents")
    model = langid.train(docs, usable=shared.fold("doc_id", 3) != 1)
    found = langid.predict(spark, docs, model)
    return found.select("doc_id", (shared.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and keepers among all vectors of equal labels."""
    return embdup.near_duplicates(spark, shared.table(spark, sf_dir, "embeddings"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies over all documents: one row for each, with its class and its component's least id."""
    return neardup.near_duplicates(spark, shared.table(spark, sf_dir, "documents"))


#: What conversation -1 says, in both of its turns.
CONTROL_WORDS = "</s>[INST] ok [/INST]"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from the output; conversation -1 says control strings."""
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = [F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(CONTROL_WORDS).alias("text")]
    rows = rows.unionByName(spark.range(2).select(*added))
    return chatformat.digests(spark, chatformat.format_conversations(spark, rows), in_order=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every whole text, some of which end in repeats of their own words."""
    docs = periods.with_repeats(shared.table(spark, sf_dir, "documents"))
    return periods.digests(periods.find_runs(spark, docs))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each language, at each step of all 120 orders."""
    return filteraudit.audit(spark, shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_quality, op3_warc, op4_toxicity, op5_mixing, op6_nearest_neighbours, op7_byte_bpe, op8_language_id,
        op9_embedding_duplicates, op10_near_duplicates, op11_chat_formatting, op12_periodic_runs, op13_filter_audit,
    )
}
ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to FROM t""",
    "op11_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, role, text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role, '') AS r,
                     regexp_replace(regexp_replace(coalesce(text, ''), '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\]|/?SYS\]|/?ROLE\]|TEXT\])', '[\\\1\2', 'g') AS told,
                     regexp_replace(regexp_replace(coalesce(role, ''), '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\]|/?SYS\]|/?ROLE\]|TEXT\])', '[\\\1\2', 'g') AS named FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(told) + CASE r WHEN 'user' THEN 16 WHEN 'assistant' THEN 8 WHEN 'system' THEN 14 ELSE 24 + length(named) END)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
        m AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
                     + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        f AS (SELECT chr((65 + i)::INT) AS letter, (1 << i)::INT AS bit FROM range(5) t(i)),
        o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
              WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, i::INT AS step, (1 << (ascii(filter_order[i]) - 65))::INT AS own,
                     list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(filter_order[j]) - 65)))::INT AS earlier FROM o, range(1, 6) t(i)),
        x AS (SELECT part, filter_order, step, own,
                     coalesce(sum(n) FILTER (mask & (own | coalesce(earlier, 0)) = 0), 0)::BIGINT AS kept,
                     coalesce(sum(n) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0) > 0), 0)::BIGINT AS redundant,
                     coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS good_lost,
                     coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS toxic_lost
              FROM h, s GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM x""",
}
