"""Answer caches: exact keys and nearest neighbours inside a scope, both with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.nearest import nearest

NEAR = 0.08


def key(**fields: Column) -> Column:
    """The first 16 hex digits of the digest of the fields' canonical form: a JSON object with its keys in order, nulls kept."""
    canonical = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.left(F.sha2(canonical.cast("binary"), 256), F.lit(16))


def exact_lookup(asks: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """asks(ask_id, key) with the live entry's answer, or none."""
    live = cache.where(F.col("expires_at") > now)
    return asks.join(live, "key", "left").withColumn("status", F.when(F.col("answer").isNotNull(), "hit").otherwise("miss"))


def put(cache: DataFrame, puts: DataFrame, hours: int = 6) -> DataFrame:
    """cache(key, answer, expires_at) after puts(key, answer, at): a key's last put (at one time the greatest answer) takes its
    place and lives `hours` from then. Puts without a key or an answer store nothing; other entries stay as they are."""
    last = puts.where("key is not null and answer is not null").groupBy("key").agg(F.max(F.struct("at", "answer")).alias("p"))
    fresh = last.select("key", F.col("p.answer").alias("answer"), (F.col("p.at") + F.make_dt_interval(hours=F.lit(hours))).alias("expires_at"))
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def semantic_put(cache: DataFrame, puts: DataFrame, hours: int = 6) -> DataFrame:
    """cache(entry_id, scope, answer, vector, expires_at) after puts(scope, query, answer, vector, chunks_used, sources, at).

    Only answers from chunks and with sources are stored. The entry's id is the digest of scope, query and answer, so one
    answer put again refreshes its expiry.
    """
    ident = F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c), F.lit("")) for c in ("scope", "query", "answer")]), 256)
    good = puts.where(cacheable(F.col("chunks_used"), F.col("sources")) & F.col("vector").isNotNull()).withColumn("entry_id", ident)
    last = good.groupBy("entry_id").agg(F.max_by(F.struct("scope", "answer", "vector"), "at").alias("e"), F.max("at").alias("at"))
    fresh = last.select("entry_id", "e.scope", "e.answer", "e.vector", (F.col("at") + F.make_dt_interval(hours=F.lit(hours))).alias("expires_at"))
    return cache.join(fresh.select("entry_id"), "entry_id", "left_anti").unionByName(fresh)


def semantic_lookup(asks: DataFrame, cache: DataFrame, now: Column, near: float = NEAR) -> DataFrame:
    """asks(ask_id, scope, vector): the nearest live entry of the same scope, a hit if within `near` (inclusive). Asks are met in
    blocks, each task keeps its nearest entry of an ask, so no scope is joined with itself."""
    live = cache.where(F.col("expires_at") > now).select(F.col("entry_id").alias("doc_id"), "vector", "scope")
    found = nearest(asks.select(F.col("ask_id").alias("query_id"), "vector", "scope"), live, 1, scoped=True)
    best = found.groupBy(F.col("query_id").alias("ask_id")).agg(F.min(F.struct("distance", "doc_id")).alias("m")).select("ask_id", F.col("m.doc_id").alias("entry_id"), "m.distance")
    status = F.when(F.col("distance") <= near, "hit").otherwise("miss")
    return asks.select("ask_id").join(best, "ask_id", "left").select("ask_id", F.when(F.col("distance") <= near, F.col("entry_id")).alias("entry_id"), F.coalesce(status, F.lit("miss")).alias("status"))


def cacheable(chunks_used: Column, sources: Column) -> Column:
    return (chunks_used > 0) & (F.size(sources) > 0)
