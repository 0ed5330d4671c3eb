"""Registered queries of the corpus operators and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrain.llm.byte_bpe import round_trip_digests
from shiftgrain.llm.centroid_clusters import cluster
from shiftgrain.llm.common import read
from shiftgrain.llm.decontaminate import find_benchmark
from shiftgrain.llm.exact_dedup import exact_dedup
from shiftgrain.llm.language_model import score_documents
from shiftgrain.llm.line_dedup import dedup_lines
from shiftgrain.llm.ngram_join import near_duplicates
from shiftgrain.llm.packing import pack
from shiftgrain.llm.quality import quality
from shiftgrain.llm.suffix_dedup import remove_repeats
from shiftgrain.llm.toxicity import toxicity
from shiftgrain.llm.vector_topk import integer_vectors, topk_inner
from shiftgrain.llm.whitening import whitened_components


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability by single tokens and by the backoff automaton."""
    return score_documents(read(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the document of the same text that stays."""
    return exact_dedup(read(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the size of its shingle set and the component of its near duplicates."""
    return near_duplicates(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 largest integer inner products of every vector whose id is divisible by 20."""
    vectors = integer_vectors(read(spark, folder, "embeddings"), "vec_id", "embedding")
    return topk_inner(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text by the multilingual ranks, and the bytes they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip_digests(read(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens in windows of 1024."""
    return pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learnt from labels outside the held-out fold."""
    return toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality, learnt from labels outside the held-out fold."""
    return quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's lines that repeat an earlier line, and what is left of its text."""
    return dedup_lines(read(spark, folder, "documents")).drop("kept_text")


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text without the strings of 50 bytes that an earlier document has."""
    return remove_repeats(read(spark, folder, "documents"))


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words inside windows of 10 words of a benchmark item, and those items."""
    found = find_benchmark(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    ids = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on up to 32 whitened principal components of all vectors; a deviation beyond a long is null."""
    found = whitened_components(read(spark, folder, "embeddings"), "vec_id", "embedding")
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's cluster after five rounds from 40 centroids; inertias beyond a long are null."""
    found, _ = cluster(read(spark, folder, "embeddings"), "vec_id", "embedding")
    return found.withColumns({c: F.col(c).try_cast("long") for c in ("cluster_inertia", "inertia")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_vector_topk": op2_vector_topk,
    "op3_language_model": op3_language_model,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_decontaminate": op11_decontaminate,
    "op12_whitening": op12_whitening,
    "op13_centroids": op13_centroids,
}

#: Shingle sets of `documents` and the component of each document, as relations `sets` and `component`.
_NEAR = """
    words AS (
        SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[\\x20\\x09-\\x0D]+') IF w <> ''] AS w
        FROM {docs}),
    sets AS (
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 4], ' ') END AS shingle
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS k FROM words)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    links AS (
        SELECT x.doc_id AS a, y.doc_id AS b
        FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
        JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
        GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
    least_of AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a),
    component AS (SELECT d.doc_id, least(d.doc_id, coalesce(l.least, d.doc_id)) AS component_id FROM {docs} d LEFT JOIN least_of l USING (doc_id))"""


def _lloyd(rounds: int, count: int, seed: int) -> str:
    """Relations c0..c<rounds> (cid, e) of centroids and a<k> (row, vec_id, cid, distance) of the vectors' nearest ones."""
    out = [f"""
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
            WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS cid, e
            FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v) ORDER BY 1 LIMIT {count})"""]
    for k in range(rounds + 1):
        out.append(f"""
        a{k} AS MATERIALIZED (
            SELECT row, any_value(vec_id) AS vec_id, arg_min(cid, (distance, cid)) AS cid, min(distance) AS distance
            FROM (SELECT row, vec_id, cid, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.e, c.e)])::BIGINT AS distance FROM v, c{k} c)
            GROUP BY row)""")
        if k < rounds:
            out.append(f"""
        c{k + 1} AS MATERIALIZED (
            SELECT c.cid, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN (
                SELECT cid, list(mean ORDER BY place) AS e FROM (
                    SELECT cid, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS mean
                    FROM (SELECT cid, unnest(e) AS x, unnest(range(64)) AS place FROM a{k} JOIN v USING (row)) GROUP BY cid, place)
                GROUP BY cid) m ON m.cid = c.cid)""")
    return ",".join(out)


ORACLE: dict[str, str] = {
    "op1_ngram_join": "WITH RECURSIVE" + _NEAR.format(docs="documents") + """
        SELECT c.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id FROM component c LEFT JOIN sizes s USING (doc_id)""",
    "op2_vector_topk": """
        WITH v AS (
            SELECT vec_id, min([floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
            GROUP BY vec_id),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op10_suffix_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS k FROM h)),
        least AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s),
        gone AS (SELECT w.doc_id, w.k FROM w JOIN least USING (s) WHERE first_doc < w.doc_id),
        steps AS (SELECT doc_id, k, CASE WHEN k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 1 ELSE 0 END AS step FROM gone),
        runs AS (SELECT doc_id, k, sum(step) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM steps),
        spans AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM runs GROUP BY doc_id, run),
        cuts AS (
            SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high FROM spans
            UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
        kept AS (
            SELECT c.doc_id, string_agg(substr(x, 2 * low + 1, coalesce(2 * (high - low), len(x))), '' ORDER BY low) AS y
            FROM cuts c JOIN h USING (doc_id) GROUP BY c.doc_id),
        sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT h.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(y, x))) AS kept_sha256
        FROM h LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_decontaminate": r"""
        WITH split AS (
            SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id, text FROM documents
            UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
        words AS MATERIALIZED (
            SELECT kind, row, id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> ''] AS w
            FROM split),
        items AS (SELECT DISTINCT id AS item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
                  FROM (SELECT id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, least(len(w), 1)))) AS k FROM words WHERE kind = 'b')),
        widths AS (SELECT DISTINCT n FROM items),
        wins AS (SELECT row, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
                 FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM words, widths WHERE kind = 'd' AND len(w) >= n)),
        hits AS MATERIALIZED (SELECT row, wins.n, k, item_id FROM wins JOIN items ON items.n = wins.n AND items.s = wins.s),
        marked AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(generate_series(k, k + n - 1)) AS place FROM (SELECT DISTINCT row, n, k FROM hits)) GROUP BY row),
        named AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN marked USING (row) LEFT JOIN named USING (row) WHERE kind = 'd'""",
    "op13_centroids": "WITH" + _lloyd(rounds=5, count=40, seed=2) + """
        SELECT vec_id, a5.cid::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a5.cid)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c5.e, ',')) AS centroid_sha256
        FROM a5 JOIN c5 USING (cid)""",
}
