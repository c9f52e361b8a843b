"""Write paths over the given tables: puts into the exact cache, deletes of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import caches, store
from docspark.session import table


def exact_cache_put(spark: SparkSession, d: str) -> DataFrame:
    """A cache with each user's events other than errors, then errors put over them: the last one's type is the answer."""
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("answer"), F.col("ts").alias("at"))
    nothing = events.limit(0).select("key", "answer", F.col("at").alias("expires_at"))
    first = caches.put(nothing, events.where("answer <> 'error'"))
    return caches.put(first, events.where("answer = 'error'"), hours=1)


def parent_delete(spark: SparkSession, d: str) -> DataFrame:
    """Documents without those under the ids of the benchmark's items."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return store.delete(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


QUERIES = {"exact_cache_put": exact_cache_put, "parent_delete": parent_delete}

SQL = {
    "exact_cache_put": """WITH p AS (SELECT user_id, event_type, ts, event_type = 'error' AS late FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY late DESC, ts DESC, event_type DESC) AS k FROM p)
SELECT user_id AS key, event_type AS answer, ts + CASE WHEN late THEN INTERVAL 1 HOUR ELSE INTERVAL 6 HOUR END AS expires_at FROM n WHERE k = 1""",
    "parent_delete": "SELECT doc_id, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)",
}
