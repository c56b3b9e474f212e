"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.llm import ball_tree, decontamination, hilbert_sharding, language_id, near_dedup, pattern_packing, prefix_trie, secret_forest, site_quality, substring_dedup, token_counts, whitening, word_bpe
from tapegrid.llm.common import table
from tapegrid.llm.hilbert_sql import hilbert_sql


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = site_quality.fit_documents(docs, table(spark, sf_dir, "labels"))
    return site_quality.site_quality(docs, evidence, F.col("source"), F.col("lang"))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.secrets(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op7_coordinate_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), similarity_percent=85)


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_sharding.hilbert_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars", "doc_id"], shards=40)


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id"))
    learned = language_id.profiles(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return language_id.predict(docs, learned).withColumn("held_out", language_id.held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score")


def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), count=4, scale=256)


def op12_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_fingerprint_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_spaced_seed_decontamination,
        op3_ball_tree_top_k,
        op4_site_quality,
        op5_secret_forest,
        op6_token_counts,
        op7_coordinate_near_dedup,
        op8_hilbert_sharding,
        op9_pattern_packing,
        op10_rank_order_language,
        op11_polarised_whitening,
        op12_lexicon_bpe,
        op13_fingerprint_trie,
    )
}

#: DuckDB SQL for those that it can express.
SQL: dict[str, str] = {
    "op3_ball_tree_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20
    """,
    "op13_fingerprint_trie": """
        WITH bits AS (
          SELECT DISTINCT conv_id, encode(CAST(conv_id AS VARCHAR)) AS raw FROM conversations WHERE conv_id IS NOT NULL
        ), heads AS (
          SELECT conv_id, xor(4294967295, list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(raw) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
            lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))
          )) % 9 AS h FROM bits
        ), own AS (
          SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
          FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), rebuilt AS (
          SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) AS turns
          FROM own c JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
        ), prefixes AS (
          SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
        ), nodes AS (
          SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len(turns)), '')) AS ends_sha256
          FROM prefixes GROUP BY 1, 2
        ), sized AS (
          SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(path[depth].text)) ELSE 0 END AS own_saved, NOT EXISTS (SELECT 1 FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[1:n.depth] = n.path) AS leaf
          FROM nodes n
        ), above AS (
          SELECT path[1:d] AS path, d AS depth, sum(own_saved) AS saved_tokens, count_if(leaf) AS n_leaves, count_if(depth = d + 1) AS n_children
          FROM (SELECT *, unnest(range(depth + 1)) AS d FROM sized) GROUP BY 1, 2
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(a.n_children AS BIGINT) AS n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN above a ON a.depth = n.depth AND a.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
    """,
    "op1_suffix_array_dedup": """
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS raw FROM documents
        ), w AS (
          SELECT r, doc_id, unnest(range(octet_length(encode(raw)) // 2 - 49)) AS pos, raw FROM d WHERE length(raw) >= 100
        ), k AS (
          SELECT r, doc_id, pos, md5(substr(raw, 2 * pos + 1, 100)) AS h FROM w
        ), f AS (
          SELECT r, pos FROM (SELECT r, pos, doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM k) WHERE first < doc_id
        ), g AS (
          SELECT r, pos, coalesce(pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) > 50, true) AS begins FROM f
        ), spans AS (
          SELECT r, min(pos) AS a, max(pos) + 50 AS b FROM (SELECT r, pos, sum(begins::INTEGER) OVER (PARTITION BY r ORDER BY pos) AS span FROM g) GROUP BY r, span
        ), keeps AS (
          SELECT r, a AS cut, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS start, b FROM spans
        ), kept AS (
          SELECT r, sum(b - cut) AS n_removed, count(*) AS n_spans, string_agg(substr(raw, 2 * start + 1, 2 * (cut - start)), '' ORDER BY start) || substr(any_value(raw), 2 * max(b) + 1) AS raw
          FROM keeps JOIN d USING (r) GROUP BY r
        )
        SELECT d.doc_id, CAST(length(d.raw) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.raw, d.raw))) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op7_coordinate_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
          SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN [words[i:i + 4] FOR i IN range(1, len(words) - 3)] WHEN len(words) > 0 THEN [words] ELSE [] END) AS shingles FROM w
        ), x AS (
          SELECT doc_id, unnest(shingles) AS shingle FROM s
        ), small AS (
          SELECT shingle, list(doc_id) AS ids FROM x GROUP BY shingle HAVING count(*) > 1
        ), common AS (
          SELECT a, b, count(*) AS n FROM (SELECT a, unnest(ids) AS b FROM (SELECT ids, unnest(ids) AS a FROM small)) WHERE a < b GROUP BY a, b
        ), links AS (
          SELECT a, b FROM common JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.shingles) + len(q.shingles) - n)
        ), two_way AS (
          SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach(id, root) AS (
          SELECT doc_id, doc_id FROM s UNION SELECT two_way.b, reach.root FROM reach JOIN two_way ON two_way.a = reach.id WHERE reach.root < two_way.b
        ), least AS (
          SELECT id, min(root) AS component_id FROM reach GROUP BY id
        )
        SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least ON least.id = s.doc_id
    """,
    "op10_rank_order_language": r"""
        WITH d AS (
          SELECT doc_id, text, lang, CAST(doc_id AS VARCHAR) AS k, regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '[^\p{L}]+', ' ', 'g') AS t FROM documents
        ), h AS (
          SELECT doc_id, lang, t, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT) FOR j IN range(8)]), lambda x, j: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 5 = 0 AS held_out FROM d
        ), g AS (
          SELECT doc_id, n, substr(t, CAST(p AS BIGINT), CAST(n AS BIGINT)) AS gram FROM (SELECT doc_id, t, n, unnest(range(1, length(t) - n + 2)) AS p FROM h, (VALUES (1), (2), (3)) AS v(n) WHERE length(t) > 1)
        ), own AS (
          SELECT doc_id, gram, count(*) AS n FROM g WHERE gram <> ' ' GROUP BY doc_id, gram
        ), coded AS (
          SELECT *, CASE length(gram) WHEN 1 THEN CAST(unicode(gram) AS BIGINT) WHEN 2 THEN CAST(unicode(gram[1]) AS BIGINT) * 2097152 + unicode(gram[2]) ELSE (CAST(unicode(gram[1]) AS BIGINT) * 2097152 + unicode(gram[2])) * 2097152 + unicode(gram[3]) END AS code FROM own
        ), ranked AS (
          SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) - 1 AS r FROM coded QUALIFY r < 300
        ), learned AS (
          SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, code) - 1 AS r FROM coded JOIN h USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, code QUALIFY r < 300
        ), distance AS (
          SELECT x.doc_id, l.lang, sum(coalesce(abs(p.r - x.r), 300)) AS far, count(*) AS n
          FROM ranked x CROSS JOIN (SELECT DISTINCT lang FROM learned) l LEFT JOIN learned p ON p.lang = l.lang AND p.code = x.code GROUP BY x.doc_id, l.lang
        ), best AS (
          SELECT doc_id, lang, far, n FROM distance QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1
        )
        SELECT h.doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - CAST(far AS DOUBLE) / (300 * n), CAST(0 AS DOUBLE)) AS score FROM h LEFT JOIN best ON best.doc_id = h.doc_id
    """,
    "op2_spaced_seed_decontamination": r"""
        WITH t AS (
          SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents)
        ), items AS (
          SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM benchmark
        ), b AS (
          SELECT item_id, unnest(words) AS word, unnest(range(len(words))) AS pos, len(words) AS n FROM items
        ), laid AS (
          SELECT doc_id, item_id, t.pos - b.pos AS place, any_value(n) AS n, list(b.pos) AS same FROM t JOIN b ON t.word = b.word GROUP BY doc_id, item_id, t.pos - b.pos HAVING count(*) >= 5
        ), seeds AS (
          SELECT *, list_sum([len(list_filter(same, lambda p: list_has_all(same, [p, p + 1, p + 2, p + 4, p + 6]))), len(list_filter(same, lambda p: list_has_all(same, [p, p + 1, p + 4, p + 7, p + 8])))]) AS hits, least(n, 25) AS compared FROM laid
        ), counted AS (
          SELECT doc_id, item_id, place, hits, compared, w, len(list_filter(same, lambda p: p >= w AND p < w + compared)) AS matched FROM (SELECT *, unnest(range(n - compared + 1)) AS w FROM seeds WHERE hits > 0)
        ), windows AS (
          SELECT doc_id, item_id, place, hits, compared, max(matched) AS matched, min(w) FILTER (WHERE matched = most) AS w FROM (SELECT *, max(matched) OVER (PARTITION BY doc_id, item_id, place) AS most FROM counted) GROUP BY doc_id, item_id, place, hits, compared
        ), good AS (
          SELECT *, CAST(matched AS DOUBLE) / compared AS similarity, place + w AS begins FROM windows WHERE CAST(matched AS DOUBLE) / compared >= 0.8
        ), totals AS (
          SELECT doc_id, item_id, CAST(sum(hits) AS BIGINT) AS hits FROM good GROUP BY doc_id, item_id
        )
        SELECT doc_id, item_id, similarity, CAST(matched AS BIGINT) AS matched, CAST(compared AS BIGINT) AS compared, CAST(begins AS BIGINT) AS "at", totals.hits FROM good JOIN totals USING (doc_id, item_id)
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, matched DESC, begins) = 1
    """,
    "op8_hilbert_sharding": hilbert_sql({"lang": True, "source": True, "n_chars": False, "doc_id": False}, 40, hilbert_sharding.BITS),
}
