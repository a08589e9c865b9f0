"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.alignment import tokenizer_alignment
from corpuscope.llm.bpe import count_tokens, encode_documents
from corpuscope.llm.decontamination import benchmark_leaks
from corpuscope.llm.embedding_dedup import embedding_groups
from corpuscope.llm.exact_dedup import exact_groups
from corpuscope.llm.licenses import license_labels
from corpuscope.llm.manifest import verified_manifest
from corpuscope.llm.mixing import mixing_scores
from corpuscope.llm.near_dedup import near_groups
from corpuscope.llm.sharding import shard_rows
from corpuscope.llm.substring_dedup import substring_dedup
from corpuscope.llm.tables import read
from corpuscope.llm.toxicity import fit, toxicity_scores


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), texts_out=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_scores(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), vocabulary(), outputs=False)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(read(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), k=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    known = read(spark, sf_dir, "labels").filter(fold(5) != 0)
    return toxicity_scores(docs, fit(docs, known)).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), vocabulary())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read(spark, sf_dir, "embeddings"), 0.93)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment(
        read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(read(spark, sf_dir, "documents"), fold(7) == 0)


QUERIES = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_substring_dedup, op3_sharding, op4_lm_scoring, op5_bpe, op6_licenses,
        op7_near_dedup, op8_toxicity, op9_token_counts, op10_decontamination, op11_embedding_dedup,
        op12_tokenizer_alignment, op13_merkle_manifest,
    )
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
                FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM rep, unnest(range(0, 13)) AS t(j)),
        word AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n
                 FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS MATERIALIZED (
            SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
            FROM d, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        link AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
               d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id""",
    "op11_embedding_dedup": r"""
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        u AS MATERIALIZED (
            SELECT k, vec_id, label, x FROM v
            WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
                  AND len(list_filter(x, lambda c: c <> 0)) > 0),
        link AS MATERIALIZED (
            SELECT a.k AS a, b.k AS b, b.vec_id AS id FROM u a JOIN u b ON a.label = b.label AND a.k <> b.k AND len(a.x) = len(b.x)
            WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        low AS (SELECT a, min(vec_id) AS id FROM reach JOIN v ON v.k = reach.b GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.id, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(low.id, vec_id)) AS kept
        FROM v LEFT JOIN n ON n.a = v.k LEFT JOIN low ON low.a = v.k""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE text AS (
            SELECT doc_id, lang, coalesce(strlen(source) || ':' || source, '-') AS s, coalesce(strlen(lang) || ':' || lang, '-') AS l,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS i, coalesce(strlen(text) || ':' || text, '-') AS t,
                   coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n,
                   coalesce(strlen(CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)) || ':' || (CAST(n_chars AS HUGEINT) + 1), '-') AS more,
                   xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                       lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
                       lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 7 = 0 AS tampered
            FROM documents),
        leaf AS (SELECT doc_id, lang, sha256(i || s || l || n || t) AS leaf,
                        CASE WHEN tampered THEN sha256(i || s || l || more || t) END AS tried FROM text),
        pos AS MATERIALIZED (
            SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
                   count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM leaf),
        low(r, level, i, n, h) AS (
            SELECT r, 0, p, n, leaf FROM pos
            UNION ALL SELECT r, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1
            GROUP BY r, level, i // 2, n),
        high(level, i, n, h) AS (
            SELECT 0, r, count(*) OVER (), h FROM low WHERE n = 1
            UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1
            GROUP BY level, i // 2, n),
        node AS (SELECT r, level, i, h FROM low UNION ALL SELECT -1, level, i, h FROM high),
        step(k, t, level, i, n, r) AS (
            SELECT k, 0, 0, p, n, r FROM pos
            UNION ALL SELECT k, t + 1, CASE WHEN n > 1 THEN level + 1 ELSE 0 END, CASE WHEN n > 1 THEN i // 2 ELSE r END,
                             CASE WHEN n > 1 THEN (n + 1) // 2 ELSE (SELECT count(*) FROM low WHERE n = 1) END, CASE WHEN n > 1 THEN r ELSE -1 END
            FROM step WHERE n > 1 OR r >= 0),
        sibling AS MATERIALIZED (
            SELECT k, t, s.i % 2 = 1 AS after, h FROM step s LEFT JOIN node o ON o.r = s.r AND o.level = s.level AND o.i = xor(s.i, 1)
            WHERE n > 1),
        proof AS (SELECT k, sha256(string_agg(coalesce(h, ''), '' ORDER BY t)) AS proof FROM sibling GROUP BY k),
        place AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS q FROM sibling),
        fold(k, q, h) AS (
            SELECT k, 0, coalesce(tried, leaf) FROM pos
            UNION ALL SELECT f.k, f.q + 1, sha256(CASE WHEN after THEN p.h || f.h ELSE f.h || coalesce(p.h, '') END)
            FROM fold f JOIN place p ON p.k = f.k AND p.q = f.q + 1)
        SELECT doc_id, leaf, s.h AS subroot, t.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root,
               f.h = t.h AS verified
        FROM pos JOIN (SELECT r, h FROM low WHERE n = 1) s USING (r), (SELECT h FROM high WHERE n = 1) t
        JOIN (SELECT k, max_by(h, q) AS h FROM fold GROUP BY k) f ON true LEFT JOIN proof o ON o.k = f.k WHERE pos.k = f.k""",
}
