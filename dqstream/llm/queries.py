"""The registered queries of this folder; each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dqstream.llm import alignment, audit, decontam, licenses, packing, privacy, quality, secrets, sharding, simhash, token_files, toxicity, vectors
from dqstream.llm.common import read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# Every document tries all depths up to 32 bits, which part any two of these tables' rows.
_SHARDS_SQL = f"""
WITH hashed AS (
    SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, chr(0) || 'null')), 1, 15))::BIGINT AS h
    FROM documents
), tried AS (
    SELECT doc_id, n_bytes, h, d AS depth, h >> (60 - d) AS prefix FROM hashed, range(33) t(d)
), nodes AS (
    SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
    FROM tried GROUP BY ALL HAVING sum(n_bytes) <= {sharding.LIMIT} OR count(*) = 1
), settled AS (
    SELECT doc_id, n_bytes, h, min(depth) AS depth FROM tried JOIN nodes USING (depth, prefix) GROUP BY ALL
)
SELECT doc_id, n_bytes,
       CASE WHEN settled.depth = 0 THEN '' ELSE lpad(bin(h >> (60 - settled.depth)), settled.depth::INTEGER, '0') END AS shard,
       settled.depth::INTEGER AS depth, 0::BIGINT AS page, shard_bytes, shard_docs
FROM settled JOIN nodes ON nodes.depth = settled.depth AND nodes.prefix = h >> (60 - settled.depth)
"""

_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(audit.FILTERS))
_AUDIT_SQL = f"""
WITH cut AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), least AS (
    SELECT text, min(doc_id) AS low FROM cut GROUP BY text
), judged AS (
    SELECT cut.doc_id, part,
           CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
    FROM cut JOIN least USING (text)
), told AS (
    SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic
    FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM judged LEFT JOIN told USING (doc_id) GROUP BY part, fails
), steps AS (
    SELECT part, fails, n, good, toxic, o AS filter_order, s AS step, o[s] AS f,
           contains(fails, o[s]) AS own, length(translate(fails, o[1:s - 1], '')) < length(fails) AS earlier
    FROM masks, (VALUES {_ORDERS}) v(o), range(1, 6) r(s)
), counts AS (
    SELECT part, filter_order, step, f,
           sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
    FROM steps GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM counts
"""

_NOTICES = ", ".join(
    f"({i}, '{t.label}', {t.base}, {t.slack}, string_split('{t.notice}', ' '))" for i, t in enumerate(licenses.TEMPLATES)
)
_KEYS = ", ".join(f"({i}, string_split('{k}', ' '))" for i, t in enumerate(licenses.TEMPLATES) for k in t.keys)
_LICENSES_SQL = f"""
WITH cut AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents
), notices(t, label, base, slack, notice) AS (
    VALUES {_NOTICES}
), postings AS (
    SELECT t, slack, len(notice) AS length, unnest(notice) AS word, unnest(range(len(notice))) AS pos FROM notices
), phrases(t, key) AS (
    VALUES {_KEYS}
), keys AS (
    SELECT t, key, (SELECT min(i) FROM range(len(notice)) s(i) WHERE notice[i + 1:i + len(key)] = key) AS pos
    FROM phrases JOIN notices USING (t)
), known AS (
    SELECT r, word, pos FROM (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM cut)
    WHERE word IN (SELECT word FROM postings)
), weights AS (
    SELECT word, 1 + floor(1000 * ln((1 + (SELECT count(*) FROM cut)) / (1 + count(DISTINCT r))) + 0.5)::BIGINT AS weight
    FROM (SELECT DISTINCT word FROM postings) LEFT JOIN known USING (word) GROUP BY word
), listed AS (
    SELECT DISTINCT t, word, weight FROM postings JOIN weights USING (word)
), ranked AS (
    SELECT r, t, word, row_number() OVER (PARTITION BY r, t ORDER BY weight DESC, word) AS rank
    FROM (SELECT DISTINCT r, word FROM known) JOIN listed USING (word)
), looked AS (
    SELECT * FROM ranked WHERE rank <= {licenses.LOOKED}
), needs AS (
    SELECT DISTINCT t, unnest(key) AS word FROM phrases
), able AS (
    SELECT r, t FROM (SELECT DISTINCT r, word FROM known) JOIN needs USING (word)
    GROUP BY r, t HAVING count(*) = (SELECT count(*) FROM needs n WHERE n.t = needs.t)
), starts AS (
    SELECT DISTINCT r, t, known.pos - p.pos AS start, p.slack, p.length
    FROM looked JOIN known USING (r, word) JOIN postings p USING (t, word) SEMI JOIN able USING (r, t) WHERE rank = 1
), agreed AS (
    SELECT r, t, start, slack, length FROM starts s JOIN looked l USING (r, t)
    GROUP BY ALL HAVING count(*) = count(*) FILTER (EXISTS (
        SELECT 1 FROM known k JOIN postings p ON p.word = k.word AND p.t = s.t
        WHERE k.r = s.r AND k.word = l.word AND abs(k.pos - s.start - p.pos) <= s.slack))
), verified AS (
    SELECT r, t, start, slack, length, words FROM agreed a JOIN cut USING (r) JOIN keys USING (t)
    GROUP BY ALL HAVING count(*) = count(*) FILTER (EXISTS (
        SELECT 1 FROM range(-6, 7) d(d)
        WHERE abs(d) <= a.slack AND a.start + pos + d >= 0
          AND words[a.start + pos + d + 1:a.start + pos + d + len(key)] = key))
), places AS (
    SELECT r, v.t, start, label, base,
           round((SELECT sum(weight) FROM listed l WHERE l.t = v.t AND list_contains(
                      words[greatest(start - v.slack, 0) + 1:start + length + v.slack], word))::DOUBLE
                 / (SELECT sum(weight) FROM listed l WHERE l.t = v.t), 6) AS score
    FROM verified v JOIN notices USING (t)
)
SELECT doc_id, len(words)::BIGINT AS n_words, count(*) FILTER (base)::BIGINT AS n_base,
       min(start) FILTER (base)::BIGINT AS first_word, max(start) FILTER (base)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(score), 0)::DOUBLE AS score
FROM cut LEFT JOIN places USING (r) GROUP BY r, doc_id, words
"""


def op1_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.find(read(spark, sf_dir, "documents"))


def op2_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), VOCABULARY))


def op4_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"))


def op7_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    token_files.write_tokens(read(spark, sf_dir, "documents"), folder, VOCABULARY)
    return token_files.read_tokens(spark, folder, keep_ids=False)


def op11_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find(read(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), VOCABULARY, PIECES)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_private_data, op2_secret_entropy, op3_packing, op4_embedding_tiles, op5_toxicity_machine, op6_extendible_shards, op7_suffix_array_decontamination, op8_simhash_trie, op9_quality_machine, op10_token_files, op11_license_index, op12_token_alignment, op13_filter_audit]
    return {q.__name__: q for q in made}


def all_sql() -> dict[str, str]:
    return {"op6_extendible_shards": _SHARDS_SQL, "op11_license_index": _LICENSES_SQL, "op13_filter_audit": _AUDIT_SQL}
