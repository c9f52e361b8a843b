"""Nested arguments of tool calls and offline vectors, over `conversations` and `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import nested
from docspark.operators import embed
from docspark.session import table


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """A tool call's arguments for every turn: objects and lists three deep; every fifth is no JSON, every seventh has a skill's path."""
    said = F.regexp_replace(F.left("text", F.lit(20)), r'["\\\p{Cntrl}]', "")
    path = F.when(F.col("turn") % 7 == 0, "/skills/ship/SKILL.md").otherwise("/notes/a.txt")
    args = F.format_string('{"z":{"role":"%s","n":%d,"deep":[["%s",null],{"path":"%s","on":true}]},"a":[%d,[]],"m":{}}', "role", "turn", said, path, "conv_id")
    ident = F.concat_ws(":", "conv_id", "turn")
    return table(spark, d, "conversations").select(ident.alias("call_id"), F.when(F.col("turn") % 5 == 4, F.concat(F.lit("{plain "), said)).otherwise(args).alias("args"))


def nested_leaves(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.leaves(_calls(spark, d), "call_id", "args")
    return rows.select("call_id", F.array_join("path", ".").alias("path"), "leaf")


def nested_skill(spark: SparkSession, d: str) -> DataFrame:
    """Each call's arguments in one form, all their values in one text, and whether that names the skill."""
    calls = _calls(spark, d)
    return calls.join(nested.flattened(calls, "call_id", "args"), "call_id").select("call_id", nested.safe_json(F.col("args")).alias("args"), "text", F.when(F.contains(F.lower("text"), F.lit("/ship/skill.md")), "ship").alias("skill"))


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents, joined back by key to shuffled documents; the first two dimensions and the length."""
    docs = table(spark, d, "documents")
    vectors = embed.embedded(docs.select("doc_id", "text").repartition(F.xxhash64("doc_id")), "doc_id")
    both = embed.with_vectors(docs.select("doc_id"), vectors, "doc_id")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return both.select("doc_id", F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.round(F.col("vector")[63].cast("double"), 5).alias("last"), F.round(length, 4).alias("length"))


_CALLS = r"""c AS (SELECT conv_id || ':' || turn AS call_id, turn, conv_id, role, regexp_replace(left(text, 20), '["\\\x00-\x1F\x7F]', '', 'g') AS said, CASE WHEN turn % 7 = 0 THEN '/skills/ship/SKILL.md' ELSE '/notes/a.txt' END AS path FROM conversations),
a AS (SELECT *, CASE WHEN turn % 5 <> 4 THEN json_object('a', [conv_id::JSON, '[]'::JSON], 'm', '{}'::JSON, 'z', json_object('deep', [json_array(said, NULL), json_object('on', true, 'path', path)], 'n', turn, 'role', role)) END AS j FROM c)"""
SQL = {
    "nested_leaves": f"""WITH {_CALLS},
t AS (SELECT call_id, fullkey, type, atom FROM a, LATERAL json_tree(j) WHERE j IS NOT NULL AND type NOT IN ('OBJECT', 'ARRAY'))
SELECT call_id, regexp_replace(regexp_replace(regexp_replace(fullkey, '^\\$\\.', ''), '\\[(\\d+)\\]', '.00000000\\1', 'g'), '"', '', 'g') AS path, CASE WHEN type = 'NULL' THEN 'None' WHEN type = 'BOOLEAN' THEN 'True' ELSE atom ->> '$' END AS leaf FROM t
UNION ALL SELECT call_id, '', '{{plain ' || said FROM a WHERE j IS NULL""",
    "nested_skill": f"""WITH {_CALLS}
SELECT call_id, coalesce(j::VARCHAR, '"{{plain ' || said || '"') AS args, CASE WHEN j IS NULL THEN '{{plain ' || said ELSE concat_ws(' ', conv_id, said, 'None', 'True', path, turn, role) END AS text, CASE WHEN j IS NOT NULL AND turn % 7 = 0 THEN 'ship' END AS skill FROM a""",
    "embed_documents": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM documents),
n AS (SELECT doc_id, md5(w) AS h, count(*) AS n FROM t GROUP BY ALL),
b AS (SELECT doc_id, k, sum(CASE WHEN (('0x' || h[k // 4 + 1])::INTEGER >> (3 - k % 4)) & 1 = 1 THEN n ELSE -n END)::DOUBLE AS v FROM n, range(64) r(k) GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(v * v)) AS len, max(CASE WHEN k = 0 THEN v END) AS first, max(CASE WHEN k = 63 THEN v END) AS last FROM b GROUP BY ALL)
SELECT d.doc_id, round(CASE WHEN len > 0 THEN (first / len)::FLOAT::DOUBLE ELSE 0 END, 5) AS first, round(CASE WHEN len > 0 THEN (last / len)::FLOAT::DOUBLE ELSE 0 END, 5) AS last, CASE WHEN len > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM documents d LEFT JOIN l USING (doc_id)""",
}
QUERIES = {name: globals()[name] for name in SQL}
