"""Retrieval queries: `benchmark` texts ask, `documents` and `embeddings` answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import retrieval as R
from docspark.session import table


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).join(table(spark, d, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vector"))


_TERMS = """
q AS (SELECT item_id AS query_id, term, count(*) AS weight FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM benchmark) GROUP BY ALL),
docs AS (SELECT * FROM documents {where}),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM docs d LEFT JOIN tf USING (doc_id) GROUP BY ALL),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS score, count(*) AS matched
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""
_VEC = """
qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON item_id = vec_id),
dist AS (SELECT query_id, vec_id AS doc_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 9) AS distance FROM embeddings, qv {where}),
vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM dist)"""
_RRF = """
legs AS (SELECT query_id, doc_id, rank FROM kw WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM vk WHERE rank <= 20),
fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM legs GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fused WHERE score >= {least})"""


def _plain(s: str, where: str = "") -> str:
    return s.replace("{where}", where)


def vec_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk(_query_vectors(spark, d), _vectors(spark, d))


def vec_similarity_transform(spark: SparkSession, d: str) -> DataFrame:
    best = R.vector_topk(_query_vectors(spark, d), _vectors(spark, d), 5)
    return best.select("query_id", "doc_id", F.round(R.similarity(F.col("distance")), 9).alias("score"))


def kw_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_topk(_queries(spark, d), _docs(spark, d)).select("query_id", "doc_id", "score", "rank")


def kw_terms_and_match(spark: SparkSession, d: str) -> DataFrame:
    return R.all_terms_match(_queries(spark, d), _docs(spark, d))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid(_queries(spark, d), _docs(spark, d), _vectors(spark, d), _query_vectors(spark, d))


def hybrid_rrf_min_score_page(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid(_queries(spark, d), _docs(spark, d), _vectors(spark, d), _query_vectors(spark, d), size=10, offset=5, min_score=0.014)


def hybrid_rrf_category(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid(_queries(spark, d), _docs(spark, d), _vectors(spark, d), _query_vectors(spark, d), category=F.col("lang").isin("en", "de"))


def lexical_path_weighted(spark: SparkSession, d: str) -> DataFrame:
    files = _docs(spark, d).select("doc_id", F.concat_ws("/", "source", "lang").alias("path"), "lang", "text").select("doc_id", "path", F.upper("lang").alias("language"), (F.col("doc_id") % 5).alias("line"), "text")
    asks = table(spark, d, "documents").select(F.concat_ws(" ", "source", "lang").alias("text")).distinct().select(F.col("text").alias("query_id"), "text")
    return R.lexical(asks, files).select("query_id", "doc_id", "score", "rank")


def search_unified(spark: SparkSession, d: str) -> DataFrame:
    """Three kinds of queries by item: hybrid, vector (blank text) and keyword."""
    kind = F.col("query_id") % 3
    asks = _queries(spark, d).select("query_id", F.when(kind == 1, " ").otherwise(F.col("text")).alias("text"), (kind == 0).alias("use_hybrid"))
    found = R.search(asks, _docs(spark, d), _vectors(spark, d), _query_vectors(spark, d))
    return found.select("query_id", "mode", "total", F.array_join(F.transform("hits", lambda h: h["doc_id"].cast("string")), ",").alias("hits"))


def rerank_topn(spark: SparkSession, d: str) -> DataFrame:
    q, docs = _queries(spark, d), _docs(spark, d)
    hits = R.hits(R.keyword_topk(q, docs, 15).join(q.withColumnRenamed("text", "query"), "query_id")).join(docs.select("doc_id", "text"), "doc_id")
    return R.rerank(hits, R.term_overlap(F.col("query"), F.col("text"))).select("query_id", "doc_id", "relevance", "place")


def parent_expand(spark: SparkSession, d: str) -> DataFrame:
    """Children: documents; parents: their sources. The best children's parents, in order."""
    docs = _docs(spark, d)
    hits = R.hits(R.keyword_topk(_queries(spark, d), docs).select("query_id", F.col("doc_id").alias("chunk_id"), "rank"))
    parents = docs.groupBy(F.col("source").alias("parent_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return R.parents_of(hits, docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("parent_id")), parents).select("query_id", "parent_id", "n_children", "best", "rank")


def merged_retrieval_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector lists as two sources; copies by (source, url, first 100 characters) go."""
    docs = _docs(spark, d).select("doc_id", "source", F.concat(F.lit("https://docs/"), F.col("source")).alias("url"), "text")
    kw = R.hits(R.keyword_topk(_queries(spark, d), _docs(spark, d)).select("query_id", "doc_id", "rank")).join(docs, "doc_id")
    vec = R.hits(R.vector_topk(_query_vectors(spark, d), _vectors(spark, d)).select("query_id", "doc_id", "rank")).join(docs, "doc_id")
    return R.merged(kw, vec).select("query_id", "doc_id", "leg", "rank")


def match_all(spark: SparkSession, d: str) -> DataFrame:
    """A blank query: the newest (largest id) ten of each category."""
    docs = _docs(spark, d).select(F.col("source").alias("query_id"), "doc_id", F.col("doc_id").alias("date"))
    return R.top_k(docs, "date", 10).select("query_id", "doc_id", "rank")


def context_join(spark: SparkSession, d: str) -> DataFrame:
    """Numbered contexts of the best five documents of each query, previews of 200 characters, as one prompt part."""
    hits = R.hits(R.keyword_topk(_queries(spark, d), _docs(spark, d), 5)).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    part = F.concat(F.lit("["), F.col("rank"), F.lit("] "), T.preview(F.col("text"), 200))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("context"))


def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    """Does an answer (the best document) name its source? Vacuously true without hits."""
    hits = R.hits(R.keyword_topk(_queries(spark, d), _docs(spark, d), 3)).join(_docs(spark, d).select("doc_id", "text", "source"), "doc_id")
    named = hits.groupBy("query_id").agg(F.bool_or(F.contains("text", "source")).alias("named"))
    return _queries(spark, d).select("query_id").join(named, "query_id", "left").select("query_id", F.coalesce("named", F.lit(True)).alias("grounded"))


SQL = {
    "vec_topk_cosine": "WITH" + _plain(_VEC) + " SELECT query_id, doc_id, distance, CAST(rank AS INTEGER) AS rank FROM vk WHERE rank <= 10",
    "vec_similarity_transform": "WITH" + _plain(_VEC) + " SELECT query_id, doc_id, round(1.0::DOUBLE / (1 + distance), 9) AS score FROM vk WHERE rank <= 5",
    "kw_bm25_topk": "WITH" + _plain(_TERMS) + " SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM kw WHERE rank <= 10",
    "kw_terms_and_match": "WITH" + _plain(_TERMS) + " SELECT query_id, doc_id FROM bm JOIN (SELECT query_id, count(*) AS need FROM q GROUP BY ALL) USING (query_id) WHERE matched = need",
    "hybrid_rrf": "WITH" + _plain(_TERMS) + "," + _plain(_VEC) + "," + _RRF.replace("{least}", "0") + " SELECT * FROM ranked WHERE rank <= 10",
    "hybrid_rrf_min_score_page": "WITH" + _plain(_TERMS) + "," + _plain(_VEC) + "," + _RRF.replace("{least}", "0.014") + " SELECT * FROM ranked WHERE rank > 5 AND rank <= 15",
    "hybrid_rrf_category": "WITH" + _plain(_TERMS, "WHERE lang IN ('en', 'de')") + "," + _plain(_VEC, "WHERE vec_id IN (SELECT doc_id FROM docs)") + "," + _RRF.replace("{least}", "0") + " SELECT * FROM ranked WHERE rank <= 10",
    "lexical_path_weighted": """
WITH q AS (SELECT DISTINCT source || ' ' || lang AS query_id FROM documents),
t AS (SELECT query_id, token, count(*) AS weight FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_id), '([a-z0-9_./-]{2,})', 1)) AS token FROM q) GROUP BY ALL),
h AS (SELECT doc_id, doc_id % 5 AS line, source || '/' || lang AS path, lower(source || '/' || lang) AS p, lower(source || '/' || lang || chr(10) || upper(lang) || chr(10) || text) AS h FROM documents),
s AS (SELECT query_id, doc_id, path, line, CAST(sum(weight * CASE WHEN contains(p, token) THEN 3 ELSE 1 END) AS BIGINT) AS score FROM h JOIN t ON contains(h, token) GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, line, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 6""",
    "search_unified": "WITH" + _plain(_TERMS) + "," + _plain(_VEC) + "," + _RRF.replace("{least}", "0") + """,
m AS (SELECT item_id AS query_id, CASE WHEN embedding IS NOT NULL AND item_id % 3 = 0 THEN 'hybrid' WHEN embedding IS NOT NULL AND item_id % 3 = 1 THEN 'vector' ELSE 'keyword' END AS mode FROM benchmark LEFT JOIN embeddings ON item_id = vec_id),
a AS (SELECT query_id, doc_id, rank, NULL AS total FROM ranked JOIN m USING (query_id) WHERE mode = 'hybrid' UNION ALL SELECT query_id, doc_id, rank, 10 FROM vk JOIN m USING (query_id) WHERE mode = 'vector' UNION ALL SELECT query_id, doc_id, rank, NULL FROM kw JOIN m USING (query_id) WHERE mode = 'keyword' AND query_id % 3 <> 1)
SELECT m.query_id, mode, coalesce(max(total), count(a.doc_id))::BIGINT AS total, coalesce(string_agg(CASE WHEN rank <= 10 THEN a.doc_id END, ',' ORDER BY rank), '') AS hits FROM m LEFT JOIN a USING (query_id) GROUP BY ALL""",
    "rerank_topn": "WITH" + _plain(_TERMS) + """,
h AS (SELECT k.query_id, k.doc_id, k.rank, list_distinct(regexp_extract_all(lower(b.text), '([a-z0-9]+)', 1)) AS q, regexp_extract_all(lower(d.text), '([a-z0-9]+)', 1) AS t
  FROM kw k JOIN benchmark b ON b.item_id = k.query_id JOIN documents d USING (doc_id) WHERE rank <= 15),
s AS (SELECT query_id, doc_id, rank, round(len(list_filter(q, lambda x: list_contains(t, x))) / greatest(len(q), 1)::DOUBLE, 6) AS relevance FROM h)
SELECT * FROM (SELECT query_id, doc_id, relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS INTEGER) AS place FROM s) WHERE place <= 5""",
    "parent_expand": "WITH" + _plain(_TERMS) + """,
b AS (SELECT query_id, source AS parent_id, CAST(min(rank) AS INTEGER) AS best FROM kw JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY ALL),
p AS (SELECT source AS parent_id, count(*) AS n_children FROM documents GROUP BY ALL)
SELECT query_id, parent_id, n_children, best, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best, parent_id) AS INTEGER) AS rank FROM b JOIN p USING (parent_id)""",
    "merged_retrieval_dedup": "WITH" + _plain(_TERMS) + "," + _plain(_VEC) + """,
u AS (SELECT query_id, doc_id, 0 AS leg, rank FROM kw WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 1 AS leg, rank FROM vk WHERE rank <= 10),
n AS (SELECT u.*, row_number() OVER (PARTITION BY query_id, source, substr(text, 1, 100) ORDER BY leg, rank) AS n FROM u JOIN documents USING (doc_id))
SELECT query_id, doc_id, leg, CAST(rank AS INTEGER) AS rank FROM n WHERE n = 1""",
    "match_all": "SELECT * FROM (SELECT source AS query_id, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS INTEGER) AS rank FROM documents) WHERE rank <= 10",
    "context_join": "WITH" + _plain(_TERMS) + """
SELECT query_id, string_agg('[' || rank || '] ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, chr(10) || chr(10) ORDER BY rank) AS context
FROM kw JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id""",
    "grounding_check": "WITH" + _plain(_TERMS) + """
SELECT item_id AS query_id, coalesce(named, true) AS grounded FROM benchmark
LEFT JOIN (SELECT query_id, bool_or(contains(text, source)) AS named FROM kw JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY ALL) n ON n.query_id = item_id""",
}
QUERIES = {name: globals()[name] for name in SQL}
