"""One query for each operator of this subpackage, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_warc, best_fit, conversation_repair, divergence, line_dedup, pareto_mix, pivot_topk, quality, sharding, simhash, token_files, toxicity, winnowing
from .common import id_remainder, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.pages_round_trip(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_report(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_warc, op3_toxicity, op4_mix, op5_winnowing, op6_token_files, op7_line_dedup, op8_best_fit, op9_topk, op10_simhash, op11_sharding, op12_divergence, op13_conversation_repair)
}

ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
        FROM q""",
    "op7_line_dedup": """
        WITH l AS (
            SELECT doc_id, pos, ls[pos + 1] AS line
            FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
        d AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first, length(line) AS n FROM l WHERE length(line) >= 16 GROUP BY line),
        near AS (SELECT DISTINCT a.line FROM d a, d b
                 WHERE b.n IN (a.n - 1, a.n, a.n + 1) AND b.first < a.first
                   AND (left(a.line, 3) = left(b.line, 3) OR right(a.line, 3) = right(b.line, 3))
                   AND levenshtein(a.line, b.line) = 1),
        m AS (SELECT l.doc_id, l.pos, {'d': l.doc_id, 'p': l.pos} = d.first AS is_first, near.line IS NOT NULL AS is_near
              FROM l JOIN d ON l.line = d.line LEFT JOIN near ON near.line = l.line),
        c AS (SELECT doc_id, count(*) FILTER (WHERE NOT is_first) AS e, count(*) FILTER (WHERE is_first AND is_near) AS f FROM m GROUP BY doc_id),
        t AS (SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n FROM documents)
        SELECT t.doc_id, CAST(n AS INTEGER) AS n_lines, CAST(coalesce(e, 0) AS INTEGER) AS equal_lines, CAST(coalesce(f, 0) AS INTEGER) AS near_lines,
               CAST(n - coalesce(e, 0) - coalesce(f, 0) AS INTEGER) AS kept_lines
        FROM t LEFT JOIN c ON t.doc_id = c.doc_id""",
    "op9_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
              FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
        k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        s AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (s.n + 2 * l.v) AS p, 1 + 1000000000 * (k.n + 2) // (l.n + 2 * l.v) AS q
            FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        f AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source) LEFT JOIN pairs USING (lang, source, item)
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f QUALIFY part = 'pair' OR rank <= 10""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
        c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        lots AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda h, b: xor(h // 256, t[xor(h % 256, b) + 1]), 4294967295), 4294967295) % 20 AS lot FROM c, steps),
        d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT * FROM lots WHERE lot > 0 UNION ALL SELECT * FROM lots WHERE lot = 3)),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) AS i FROM d),
        f AS (SELECT *, left(role, 1) AS init, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM n),
        -- the cheapest edits (cost, audit, text) that end in each state: nothing, s, u, a
        v(conv_id, i, s0, s1, s2, s3) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {'c': 0, 'a': '', 't': ''}, {'c': 1000000000, 'a': '', 't': ''}, {'c': 5, 'a': 'I', 't': 'user:' || chr(10)}, {'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)} FROM f
            UNION ALL
            SELECT conv_id, i, s0, s1, s2, list_sort([s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || 'assistant:' || chr(10)}])[1]
            FROM (SELECT conv_id, i, s0, s1, list_sort([s2] || list_transform([s0, s1, s3], lambda s: {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || 'user:' || chr(10)}))[1] AS s2, s3
            FROM (SELECT v.conv_id, f.i, {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} AS s0,
                list_sort([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}] || CASE WHEN sound AND init = 's' THEN [{'c': s0.c + x, 'a': s0.a || 'K', 't': s0.t || line}] ELSE [] END)[1] AS s1,
                list_sort([{'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t}] || CASE WHEN sound THEN list_transform([s0, s1, s3], lambda s: {'c': s.c + x + 1, 'a': s.a || 'R', 't': s.t || 'user:' || text || chr(10)}) ELSE [] END
                    || CASE WHEN sound AND init = 'u' THEN list_transform([s0, s1, s3], lambda s: {'c': s.c + x, 'a': s.a || 'K', 't': s.t || line}) ELSE [] END)[1] AS s2,
                list_sort([{'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t}] || CASE WHEN sound THEN [{'c': s2.c + x + 1, 'a': s2.a || 'R', 't': s2.t || 'assistant:' || text || chr(10)}] ELSE [] END
                    || CASE WHEN sound AND init = 'a' THEN [{'c': s2.c + x, 'a': s2.a || 'K', 't': s2.t || line}] ELSE [] END)[1] AS s3
                FROM v JOIN (SELECT *, fault IN ('', 't') AS sound, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS x, role || ':' || text || chr(10) AS line FROM f) f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1))),
        best AS (SELECT conv_id, list_sort([s0, s3])[1] AS w FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        pairs AS (SELECT *, lead(init) OVER (PARTITION BY conv_id ORDER BY i) AS after, lead(i) OVER (PARTITION BY conv_id ORDER BY i) AS more FROM f),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
            count(*) FILTER (WHERE more IS NOT NULL AND init || after NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.a, '') AS audit, sha256(CASE WHEN coalesce(w.t, '') = '' THEN '' ELSE left(w.t, length(w.t) - 1) END) AS repaired_sha256
        FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id""",
}
