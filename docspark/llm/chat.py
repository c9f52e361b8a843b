"""Tool-call linking for chats, with DataFrame and SQL functions only.

Calls and results are hash-joined by conversation and identifier, ordered topologically along the references in the calls'
arguments, checked against the tools' schemas, and written as canonical JSON (sorted keys, no spaces).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docspark.llm.common import materialize, shared_path

#: Up to so many tools their schemas become literals of the plan; more are joined as a table.
LITERAL_TOOLS = 1000

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant>>>"
RESULT = "struct<tool_call_id:string,content:variant>"
REFERENCE = r'"\$ref":"((?:[^"\\]|\\.)*)"'


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, pos, call_id, name, arguments) and results (conv_id, turn, call_id, content) of messages.

    Messages: conv_id, turn, role, text. An assistant's text may be {"tool_calls": [{"id", "name", "arguments"}]}, with the
    arguments as an object or as a string that holds one; a tool's {"tool_call_id", "content"}, either of which may lack.
    """
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("text").cast("string"))
    said = rows.where("role = 'assistant'").select("conv_id", "turn", F.from_json("text", CALLS)["tool_calls"].alias("c"))
    calls = said.select("conv_id", "turn", F.posexplode("c").alias("pos", "call"))
    raw = F.col("call.arguments")
    as_object = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(raw.cast("string"))).otherwise(raw)
    calls = calls.select("conv_id", "turn", "pos", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), as_object.alias("arguments"))
    got = rows.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", RESULT).alias("r"))
    return calls, got.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")).where("call_id is not null or content is not null")


def _kind(value: Column) -> Column:
    of = F.schema_of_variant(value)
    return (
        F.when(of.startswith("ARRAY"), "array").when(of.startswith("OBJECT"), "object").when((of == "BIGINT") | of.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when(of.startswith("DECIMAL") | of.isin("DOUBLE", "FLOAT"), "number").when(of == "VOID", "null").otherwise(F.lower(of))
    )


SHAPE = "array<struct<param:string,type:string,required:boolean>>"


def with_specs(calls: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """Adds `spec`, the parameters of a call's tool. schemas: tool -> parameter -> (type, required).

    Types: string, integer, number (integers too), boolean, array, object, null.
    """
    rows = [(tool, [(p, t, r) for p, (t, r) in sorted(params.items())]) for tool, params in sorted(schemas.items())]
    if len(rows) > LITERAL_TOOLS:  # the driver was given all of them, so they may be broadcast
        return calls.join(F.broadcast(calls.sparkSession.createDataFrame(rows, f"name string, spec {SHAPE}")), "name", "left")
    pairs: list[Column] = []
    for tool, params in rows:
        pairs += [F.lit(tool), F.array(*[F.struct(F.lit(p).alias("param"), F.lit(t).alias("type"), F.lit(r).alias("required")) for p, t, r in params]).cast(SHAPE)]
    return calls.withColumn("spec", F.try_element_at(F.create_map(*pairs), "name") if pairs else F.lit(None).cast(SHAPE))


def errors(spec: Column, arguments: Column) -> Column:
    """What is wrong with a call's arguments by its tool's parameters, sorted."""
    given = arguments.try_cast("map<string,variant>")
    keys, entries = F.map_keys(given), F.map_entries(given)

    def wrong(e: Column) -> Column:
        kind = _kind(e["value"])
        return F.exists(spec, lambda s: (s["param"] == e["key"]) & ~((s["type"] == kind) | ((s["type"] == "number") & (kind == "integer"))))

    missing = F.transform(F.filter(spec, lambda s: s["required"] & ~F.array_contains(keys, s["param"])), lambda s: F.concat(F.lit("missing:"), s["param"]))
    kinds = F.transform(F.filter(entries, wrong), lambda e: F.concat(F.lit("type:"), e["key"]))
    extra = F.transform(F.filter(keys, lambda k: ~F.exists(spec, lambda s: s["param"] == k)), lambda k: F.concat(F.lit("unexpected:"), k))
    return F.when(spec.isNull(), F.array(F.lit("unknown tool"))).when(given.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(F.flatten(F.array(missing, kinds, extra))))


def levels(calls: DataFrame, refers: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 for calls that refer to no call, else one above the highest they refer to.

    Both: conv_id, call_id (refers also: dep). Rounds of joins over all conversations. An arc (call, dep, w) says that the
    call stands at least w above dep, `least` what is known of the call without its open arcs. A round settles the arcs to
    calls with a level, and moves an arc to a call that waits for one other call alone on to that one, so chains shrink by
    half. A round that gives no call a level leaves those in a cycle, or that refer to one: these get none.
    """
    keys, spark = ["conv_id", "call_id"], calls.sparkSession
    folder = shared_path(spark, "chat-levels")
    schema = StructType([calls.schema["conv_id"], calls.schema["call_id"], StructField("level", LongType())])
    calls.join(refers.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("level")).write.parquet(f"{folder}/round=0")
    open_arcs = refers.select(*keys, "dep", F.lit(1).cast("long").alias("w"), F.lit(0).cast("long").alias("least"))
    for number in itertools.count(1):
        done = spark.read.schema(schema).parquet(*[f"{folder}/round={k}" for k in range(number)])
        waits = open_arcs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"), F.min("dep").alias("on"), F.max("w").alias("w"))
        waits = waits.select("conv_id", F.col("call_id").alias("dep"), F.col("n"), F.col("least").alias("dep_least"), F.col("on"), F.col("w").alias("dep_w"))
        met = open_arcs.join(done.select("conv_id", F.col("call_id").alias("dep"), "level"), ["conv_id", "dep"], "left").join(waits, ["conv_id", "dep"], "left")
        move = F.col("level").isNull() & (F.col("n") == 1)
        moved = met.select(
            *keys,
            F.when(F.col("level").isNull(), F.when(move, F.col("on")).otherwise(F.col("dep"))).alias("dep"),
            F.when(move, F.col("w") + F.col("dep_w")).otherwise(F.col("w")).alias("w"),
            F.greatest("least", F.when(F.col("level").isNotNull(), F.col("level") + F.col("w")), F.when(move, F.col("dep_least") + F.col("w"))).alias("least"),
        )
        # arcs to one call are one, with the most that they say; a call without open arcs stands at `least`
        state = moved.groupBy(*keys, "dep").agg(F.max("w").alias("w"), F.max("least").alias("least"))
        state = materialize(state, "chat-arcs")
        waiting = state.where("dep is not null").select(*keys).distinct()
        known = state.groupBy(*keys).agg(F.max("least").alias("level"))
        known.join(waiting, keys, "left_anti").write.parquet(f"{folder}/round={number}")
        if spark.read.schema(schema).parquet(f"{folder}/round={number}").isEmpty():
            return done
        open_arcs = state.where("dep is not null").drop("least").join(known.withColumnRenamed("level", "least"), keys)


def link(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row a call, and one a result without a call.

    conv_id, turn, call_id, name, level, result_turn, status, errors, arguments_json, record.
    status: linked; no_result; duplicate (an identifier's later calls); no_id (calls and results with a null identifier or
    conversation); orphan_result. Calls equal in all, place included, count once, results too. An identifier's first call is
    that of the lowest (turn, pos, name), then of the lowest SHA-256 of its arguments; of several results the first by turn,
    then by content, counts. (level, turn, pos) is a topological order inside a conversation; level is null in cycles and
    for all but an identifier's first call. Null or malformed texts and roles other than assistant and tool give neither
    calls nor results; columns other than the four of a message are not read; an empty table gives an empty result.
    """
    calls, results = parse(messages)
    calls = with_specs(calls.withColumn("arguments_json", F.to_json("arguments")), schemas).withColumn("errors", errors(F.col("spec"), F.col("arguments")))
    calls = materialize(calls.select("conv_id", "turn", "pos", "call_id", "name", "arguments_json", "errors").distinct(), "chat-calls")
    named = calls.where("conv_id is not null and call_id is not null")
    rank = F.struct("turn", "pos", "name", F.sha2("arguments_json", 256).alias("digest"))
    firsts = named.groupBy("conv_id", "call_id").agg(F.min(rank).alias("first"))
    keys = ["conv_id", "call_id"]
    known = firsts.select(*keys)
    placed = named.join(firsts, keys).withColumn("is_first", rank == F.col("first"))
    arcs = placed.where("is_first").select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("arguments_json", F.lit(REFERENCE), 1))).alias("dep"))
    arcs = materialize(arcs.join(known.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi").select(*keys, "dep"), "chat-arcs")
    level = levels(known, arcs)
    whole = F.struct(F.col("turn"), F.to_json("content").alias("content"))
    loose = results.where("conv_id is null or call_id is null").select("conv_id", "call_id", whole.alias("r"), F.lit("no_id").alias("status")).distinct()
    answers = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(whole).alias("r"))
    linked = (
        placed.join(level, keys, "left")
        .hint("shuffle_hash")
        .join(answers.hint("shuffle_hash"), keys, "left")
        .withColumn("level", F.when(F.col("is_first"), F.col("level")))
        .withColumn("status", F.when(~F.col("is_first"), "duplicate").when(F.col("r").isNull(), "no_result").otherwise("linked"))
    )
    nameless = calls.where("conv_id is null or call_id is null").select("*", F.lit("no_id").alias("status"))
    orphans = answers.join(known, keys, "left_anti").withColumn("status", F.lit("orphan_result"))
    both = linked.unionByName(nameless, allowMissingColumns=True).unionByName(orphans, allowMissingColumns=True).unionByName(loose, allowMissingColumns=True)
    answer = F.when(F.col("status").isin("linked", "orphan_result", "no_id"), F.col("r"))
    # fields in order of their names; the argument and result texts are canonical already
    record = F.to_json(F.struct(
        F.try_parse_json("arguments_json").alias("arguments"), F.col("conv_id").alias("conversation"), F.col("errors").alias("errors"), F.col("call_id").alias("id"), F.col("level").alias("level"),
        F.col("name").alias("name"), F.try_parse_json(answer["content"]).alias("result"), F.col("status").alias("status"), F.col("turn").alias("turn"),
    ))
    return both.select("conv_id", "turn", "call_id", "name", "level", answer["turn"].alias("result_turn"), "status", F.array_join("errors", ",").alias("errors"), "arguments_json", record.alias("record"))


#: Tools of the query below.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", True), "after": ("object", False)},
    "lookup": {"query": ("string", True), "limit": ("string", True), "after": ("object", False)},
    "summarise": {"query": ("string", True), "limit": ("integer", True), "words": ("integer", True)},
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool messages: an assistant's turn becomes a call with its whole text as the query, which refers
    to the call at half its turn; a user's turn is the result of the call one turn before it. Other roles keep their texts.
    A null conversation or turn gives no identifier, a null text no query or content."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    half = F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), F.floor(F.col("turn") / 2))
    pick = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    name = F.when(pick == 0, "search").when(pick == 1, "lookup").when(pick == 2, "summarise").otherwise("browse")
    arguments = F.struct(F.col("text").alias("query"), (F.col("turn") + 1).alias("limit"), F.when((F.col("turn") > 0) & half.isNotNull(), F.struct(half.alias("$ref"))).alias("after"))
    call = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("id"), name.alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when(F.col("role") == "assistant", call).when(F.col("role") == "user", result).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


#: The same over `conversations`; JSON strings of both engines agree on what these texts hold.
ORACLE = """
WITH RECURSIVE calls AS (SELECT DISTINCT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, text IS NULL AS no_text,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'summarise' ELSE 'browse' END AS name,
  '{' || concat_ws(',', CASE WHEN turn > 0 THEN '"after":{"$ref":"call_' || conv_id || '_' || (turn // 2) || '"}' END, '"limit":' || (turn + 1),
    CASE WHEN text IS NOT NULL THEN '"query":' || to_json(text)::VARCHAR END) || '}' AS arguments_json
  FROM conversations WHERE role = 'assistant'),
c AS (SELECT *, CASE WHEN call_id IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, call_id ORDER BY sha256(arguments_json)) END AS place FROM calls),
l AS (SELECT conv_id, turn, 0 AS level FROM c WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn // 2 AND c.turn > 0)
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM c JOIN l ON c.place = 1 AND c.conv_id = l.conv_id AND c.turn // 2 = l.turn AND c.turn > 0 AND c.turn <> l.turn),
results AS (SELECT DISTINCT conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, CASE WHEN text IS NOT NULL THEN to_json(text)::VARCHAR END AS content
  FROM conversations WHERE role = 'user'),
r AS (SELECT * FROM results WHERE call_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, content NULLS FIRST) = 1),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, c.turn, coalesce(c.call_id, r.call_id) AS call_id, c.name, CASE WHEN place = 1 THEN l.level END AS level,
  CASE WHEN place > 1 THEN NULL ELSE r.turn END AS result_turn,
  CASE WHEN c.name IS NULL THEN 'orphan_result' WHEN c.call_id IS NULL THEN 'no_id' WHEN place > 1 THEN 'duplicate' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  CASE WHEN c.name = 'browse' THEN 'unknown tool' WHEN c.name IS NOT NULL THEN concat_ws(',', CASE WHEN no_text THEN 'missing:query' END,
    CASE c.name WHEN 'lookup' THEN 'type:limit' WHEN 'summarise' THEN 'missing:words' END, CASE WHEN c.name = 'summarise' AND c.turn > 0 THEN 'unexpected:after' END) END AS errors,
  c.arguments_json, CASE WHEN place > 1 THEN NULL ELSE r.content END AS content
  FROM c LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
  UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL, turn, 'no_id', NULL, NULL, content FROM results WHERE call_id IS NULL AND content IS NOT NULL)
SELECT conv_id, turn, call_id, name, level, result_turn, status, errors, arguments_json,
  '{' || concat_ws(',', '"arguments":' || arguments_json, '"conversation":' || conv_id,
  '"errors":[' || CASE WHEN errors = '' THEN '' ELSE '"' || replace(errors, ',', '","') || '"' END || ']',
  '"id":"' || call_id || '"', '"level":' || level, '"name":"' || name || '"', '"result":' || content, '"status":"' || status || '"', '"turn":' || turn) || '}' AS record
FROM j
"""
