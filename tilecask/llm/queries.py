"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, language, lines, maxscore, minhash, packing, pages, suffixes, toxicity

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_table(table(spark, sf_dir, "documents"), length=200)


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), capacity=2048, end_id=0)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_shared_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_removed")


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffixes": op2_suffixes,
    "op3_pages": op3_pages,
    "op4_language": op4_language,
    "op5_minhash": op5_minhash,
    "op8_bpe": op8_bpe,
    "op6_lines": op6_lines,
    "op7_maxscore": op7_maxscore,
    "op9_packing": op9_packing,
    "op10_embeddings": op10_embeddings,
}
#: Every window of 200 bytes by its digest, covered runs as islands, what is left as hex.
SUFFIXES_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, i, md5(array_slice(b, i + 1, i + 200)) AS h FROM d, LATERAL (SELECT unnest(range(0, n - 199)) AS i)),
c AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), x AS (SELECT r, i FROM w JOIN c USING (h)),
f AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM x),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM f), s AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY r, k),
a AS (SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed FROM s GROUP BY 1),
q AS (SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS lo, lo AS hi FROM s UNION ALL SELECT r, max(hi), NULL FROM s GROUP BY 1),
k AS (SELECT r, string_agg(hex(array_slice(b, lo + 1, coalesce(hi, n))), '' ORDER BY lo) AS h FROM q JOIN d USING (r) WHERE lo < coalesce(hi, n) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256 FROM d LEFT JOIN a USING (r) LEFT JOIN k USING (r)"""
#: Shingles as strings of words, links by counting shared ones, components by walking links.
MINHASH_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reached) AS component_id, d.doc_id = min(r.reached) AS kept FROM documents d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id, n.n"""
MAXSCORE_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
EMBEDDINGS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.a"""
#: The tables' pages all have one article, whose blocks are paragraphs and headings, and none of which is in all four neighbours.
PAGES_SQL = """WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(a, '<br>', ' '), '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS b FROM a),
d AS (SELECT page_id, url, list_transform(b, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) AS d FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(d, lambda x: x <> ''), chr(10)) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""
ORACLE: dict[str, str] = {
    "op2_suffixes": SUFFIXES_SQL,
    "op3_pages": PAGES_SQL,
    "op5_minhash": MINHASH_SQL,
    "op7_maxscore": MAXSCORE_SQL,
    "op10_embeddings": EMBEDDINGS_SQL,
}
