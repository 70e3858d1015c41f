"""Registered queries: each operator with production parameters over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millwatch.llm import alignment, hamming_index, licenses, lines, merkle, mixing, packing, pivots, repeats, secrets, simhash, toxicity, warc
from millwatch.llm.common import table


def vocabulary() -> dict[str, str]:
    """The public tokenizer, and the same vocabulary as ranks."""
    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.frequent_words(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **vocabulary(), with_ids=False).drop("ids")


def op4_hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest(table(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.quotas(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op8_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op11_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.newline_audit(table(spark, sf_dir, "documents")).drop("tampered")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), pieces=public_tokenizers.path("piece_bpe_32k.model"), **vocabulary())


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_toxicity, op3_packing, op4_hamming_neighbours, op5_source_mixing, op6_repeats,
        op7_line_dedup, op8_pivot_top_k, op9_simhash, op10_warc_derivatives, op11_license_notices,
        op12_merkle_manifest, op13_token_alignment,
    )
}

_REPEATS = """
WITH bytes AS (
    SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS x FROM documents
), starts AS (
    SELECT doc_id, unnest(range(0, CAST(length(x) / 2 - 399 AS BIGINT))) AS p, x FROM bytes WHERE length(x) >= 800
), hashed AS (
    SELECT doc_id, p, md5(substring(x, 2 * p + 1, 800)) AS h FROM starts
), repeated AS (
    SELECT doc_id, p FROM hashed QUALIFY count(*) OVER (PARTITION BY h) > 1
), marked AS (
    SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 400 THEN 0 ELSE 1 END AS fresh
    FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), numbered AS (
    SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
), runs AS (
    SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY ALL
), gaps AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
), kept AS (
    SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS tail,
           string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS parts
    FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN tail IS NULL THEN x ELSE parts || substring(x, 2 * tail + 1) END)) AS kept_sha256
FROM bytes b LEFT JOIN kept USING (doc_id)
"""

_LINES = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), flagged AS (
    SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM keyed k LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

_PRODUCTS = """
WITH taken AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM taken q JOIN taken c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), best AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT * FROM best WHERE rank <= 5
"""

_MERKLE = """
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), given AS (
    SELECT doc_id, source, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c // 256)), 4294967295) % 2 = 0, FALSE) AS tampered,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
           text, replace(text, chr(10), '') AS joined
    FROM documents, crc_table
), leaves AS (
    SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || CASE WHEN tampered THEN coalesce(strlen(joined) || ':' || joined, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS claimed
    FROM given
), placed AS (
    SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS id, *,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves
), trees AS (
    SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS n_trees FROM (SELECT DISTINCT source FROM leaves)
), up AS (
    SELECT tree, 0 AS level, i, leaf AS d, n FROM placed JOIN trees ON placed.source IS NOT DISTINCT FROM trees.source
    UNION ALL
    SELECT tree, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, level, i // 3, n
), subroots AS (
    SELECT tree, d AS subroot FROM up WHERE n = 1
), top AS (
    SELECT 0 AS level, tree AS i, subroot AS d, (SELECT count(*) FROM subroots) AS n FROM subroots
    UNION ALL
    SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, i // 3, n
), runs AS (
    SELECT tree, level, i // 3 AS run, list(d ORDER BY i) AS ds FROM up WHERE n > 1 GROUP BY ALL
    UNION ALL
    SELECT -1, level, i // 3, list(d ORDER BY i) FROM top WHERE n > 1 GROUP BY ALL
), climb AS (
    SELECT id, tree, tree AS at_tree, 0 AS level, i, n, n_trees, claimed AS folded, '' AS siblings
    FROM placed JOIN trees ON placed.source IS NOT DISTINCT FROM trees.source
    UNION ALL
    SELECT id, c.tree, CASE WHEN n > 1 THEN at_tree ELSE -1 END, CASE WHEN n > 1 THEN c.level + 1 ELSE 0 END,
           CASE WHEN n > 1 THEN i // 3 ELSE c.tree END, CASE WHEN n > 1 THEN (n + 2) // 3 ELSE n_trees END, n_trees,
           CASE WHEN n > 1 THEN sha256(coalesce(array_to_string(ds[1 : i % 3], ''), '') || folded || coalesce(array_to_string(ds[i % 3 + 2 : 3], ''), '')) ELSE folded END,
           CASE WHEN n > 1 THEN siblings || coalesce(array_to_string(ds[1 : i % 3], ''), '') || coalesce(array_to_string(ds[i % 3 + 2 : 3], ''), '') ELSE siblings END
    FROM climb c LEFT JOIN runs r ON r.tree = at_tree AND r.level = c.level AND r.run = i // 3
    WHERE n > 1 OR at_tree >= 0
), folded AS (
    SELECT id, tree, folded, siblings FROM climb WHERE n = 1 AND at_tree = -1
)
SELECT doc_id, leaf, subroot, root.d AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root.d AS verified
FROM placed JOIN folded USING (id) JOIN subroots USING (tree) CROSS JOIN (SELECT d FROM top WHERE n = 1) root
"""

ORACLES = {"op6_repeats": _REPEATS, "op7_line_dedup": _LINES, "op8_pivot_top_k": _PRODUCTS, "op12_merkle_manifest": _MERKLE}
