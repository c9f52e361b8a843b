"""Ranked retrieval over batches of queries: keyword (BM25), vector, hybrid reciprocal-rank fusion, lexical, expansion to parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators.bulk import all_terms, bm25_best
from docspark.operators.nearest import nearest
from docspark.session import kept

RRF_K = 60


def top_k(df: DataFrame, score: str, k: int, offset: int = 0, ascending: bool = False, ident: str = "doc_id") -> DataFrame:
    """Rank per query by score (ties by id) and keep a page of it; `rank` counts from 1."""
    order = F.asc(score) if ascending else F.desc(score)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, ident)))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def few(df: DataFrame, most: int) -> DataFrame:
    """A side is broadcast only once its size is known to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hits(df: DataFrame) -> DataFrame:
    """Ranked rows, made once, that texts are joined to: broadcast where few, so that no text is shuffled."""
    return few(kept(df), 1_000_000)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, weight (times it occurs)."""
    return queries.select("query_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def _with_terms(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.terms(F.col("text")).alias("terms"))


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int = 10, offset: int = 0) -> DataFrame:
    """query_id, doc_id, score, rank of the page of each query's best documents by BM25; those without any of its terms take no part."""
    return top_k(bm25_best(query_terms(queries), _with_terms(docs), k + offset).drop("met"), "score", k, offset)


def all_terms_match(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id of documents with every term of the query."""
    return all_terms(query_terms(queries), _with_terms(docs))


def vector_topk(queries: DataFrame, base: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, distance, rank of the k nearest by cosine; queries(query_id, vector), base(doc_id, vector)."""
    return top_k(nearest(queries, base, k), "distance", k, ascending=True)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (1 + distance)


def fuse(legs: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """query_id, doc_id, score: the sum of 1 / (k + rank) over the legs."""
    both = legs[0].select("query_id", "doc_id", "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("query_id", "doc_id", "rank"))
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"))


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, query_vectors: DataFrame, size: int = 10, offset: int = 0, min_score: float = 0.0, category: Column | None = None) -> DataFrame:
    """Hybrid search: both legs take 2 * size candidates, after the category filter and before min_score and the page."""
    if category is not None:
        docs = docs.where(category)
        vectors = vectors.join(docs.select("doc_id"), "doc_id", "left_semi")
    candidates = 2 * size
    fused = fuse([keyword_topk(queries, docs, candidates), vector_topk(query_vectors, vectors, candidates)])
    return top_k(fused.where(F.col("score") >= min_score), "score", size, offset)


def parents_of(hits: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct parents of child hits (query_id, chunk_id, rank) in the order of their best child; missing parents are dropped."""
    best = hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("best"))
    found = best.join(parents, "parent_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "parent_id")))


def lexical(queries: DataFrame, files: DataFrame, k: int = 6) -> DataFrame:
    """Path-weighted substring search: a query token counts 3 if the path holds it, else 1 if the text does; top k.

    files: doc_id, path, language, line, text; language and text are searched too, ties go by path and line. Tokens keep their multiplicity. Substring matching has no equi-key, so the (checked, small)
    token side is broadcast.
    """
    tokens = queries.select("query_id", F.explode(T.code_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("weight"))
    hay = files.select("doc_id", "path", "line", F.lower("path").alias("p"), F.lower(F.concat_ws("\n", "path", "language", "text")).alias("h"))
    distinct = tokens.select("token").distinct()
    hits = hay.join(few(distinct, 100_000), F.expr("instr(h, token) > 0")).select("doc_id", "path", "line", "token", F.when(F.expr("instr(p, token) > 0"), 3).otherwise(1).alias("value"))
    scored = hits.join(tokens, "token").groupBy("query_id", "doc_id", "path", "line").agg(F.sum(F.col("weight") * F.col("value")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "line", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SEARCH_BACKENDS = ("keyword", "vector", "hybrid")


def search(queries: DataFrame, docs: DataFrame, vectors: DataFrame, query_vectors: DataFrame, backend: str | None = None, size: int = 10, offset: int = 0, min_score: float = 0.0, category: Column | None = None) -> DataFrame:
    """One entry for all searches: query_id, mode, total, hits (array of rank, doc_id, score); queries: query_id, text, use_hybrid.

    A query with a vector is hybrid if it asks for that, a vector search if its text is blank, else a keyword search, as is
    one without a vector. `backend` sets one mode for all. Queries without hits have a total of 0 and no hits.
    """
    if backend is not None and backend not in SEARCH_BACKENDS:
        raise ValueError(f"unknown backend {backend!r}: one of {', '.join(SEARCH_BACKENDS)}")
    has = query_vectors.select("query_id", F.lit(True).alias("_v"))
    mode = F.when(F.col("_v") & F.col("use_hybrid"), "hybrid").when(F.col("_v") & (F.trim("text") == ""), "vector").otherwise("keyword") if backend is None else F.lit(backend)
    asked = queries.join(has, "query_id", "left").withColumn("mode", mode)
    if category is not None:
        docs = docs.where(category)
        vectors = vectors.join(docs.select("doc_id"), "doc_id", "left_semi")
    of = {m: asked.where(F.col("mode") == m).select("query_id", "text") for m in SEARCH_BACKENDS}
    own = {m: query_vectors.join(of[m].select("query_id"), "query_id", "left_semi") for m in ("vector", "hybrid")}
    # a task's best of each query, with the number of all that it met
    words = bm25_best(query_terms(of["keyword"]), _with_terms(docs), size + offset, least=min_score)
    near = vector_topk(own["vector"], vectors, size + offset).select("query_id", "doc_id", F.round(similarity(F.col("distance")), 9).alias("score"))
    both = fuse([keyword_topk(of["hybrid"], docs, 2 * size), vector_topk(own["hybrid"], vectors, 2 * size)])
    found = words.unionByName(near.unionByName(both).where(F.col("score") >= min_score).withColumn("met", F.lit(1).cast("long")))
    hit = F.when((F.col("rank") > offset) & (F.col("rank") <= offset + size), F.struct("rank", "doc_id", "score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    pages = ranked.where(F.col("rank") <= offset + size).groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    totals = found.groupBy("query_id").agg(F.sum("met").alias("total"))
    out = asked.select("query_id", "mode").join(totals, "query_id", "left").join(pages, "query_id", "left")
    return out.select("query_id", "mode", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("hits", F.array().cast("array<struct<rank:int,doc_id:bigint,score:double>>")).alias("hits"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two result lists (query_id, source, url, text, rank); of equal (source, url, first 100 characters) the first stays."""
    both = first.withColumn("leg", F.lit(0)).unionByName(second.withColumn("leg", F.lit(1)))
    key = Window.partitionBy("query_id", "source", "url", F.left("text", F.lit(100))).orderBy("leg", "rank")
    return both.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def rerank(candidates: DataFrame, scorer: Column, n: int = 5) -> DataFrame:
    """The n best candidates by a relevance score, ties in their first order."""
    return candidates.withColumn("relevance", scorer).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank"))).where(F.col("place") <= n)


def term_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that a text has: the offline relevance."""
    q = F.array_distinct(T.terms(query))
    return F.round(F.size(F.array_intersect(q, T.terms(text))) / F.greatest(F.size(q), F.lit(1)), 6)
