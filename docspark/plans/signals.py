"""Conversations, guardrails, graph, caches, evaluation, metrics and log queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import caches as K
from docspark.operators import graph as GR
from docspark.operators import guards as G
from docspark.operators import signals as S
from docspark.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


# conversations


def msgs_filter(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role")


def latest_user_turn(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def thread_concat(spark: SparkSession, d: str) -> DataFrame:
    """User texts in order, blank ones left out, and whether the request is within 32,000 characters."""
    rows = _talk(spark, d).where("role = 'user' and trim(text) <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["t"]), "\n")
    return rows.select("conv_id", text.alias("request"), (F.length(text) <= 32_000).alias("accepted"))


def tail_messages(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 messages of each thread."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return _talk(spark, d).withColumn("n", F.row_number().over(order)).where("n <= 20").select("conv_id", "turn", "role")


def thread_state(spark: SparkSession, d: str) -> DataFrame:
    """Messages appended by thread: count, roles in order, characters so far at each."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return _talk(spark, d).select("conv_id", "turn", F.count(F.lit(1)).over(so_far).alias("n"), F.sum(F.length("text")).over(so_far).alias("chars"))


def answer_replay(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))


def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.preview(F.col("text"), 500).alias("short"), F.left("text", F.lit(4500)).alias("long"), (F.length("text") > 20_000).alias("truncated"))


def freshness_window(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    live = F.lit(False)
    for m in ("latest", "news", "today", "recent", "current"):  # fixed values: words that ask for current information
        live = live | low.contains(m)
    days = F.when(low.contains("24 hour") | low.contains("today"), 1).when(low.contains("30 day") | low.contains("month"), 30).otherwise(7)
    return _docs(spark, d).select("doc_id", live.alias("current"), days.alias("days"))


# guardrails


def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(G.redacted(F.col("text")).cast("binary")).alias("digest"))


def pii_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_rows(_docs(spark, d).select("doc_id", "text")).select("doc_id", F.array_join("entities", ",").alias("entities"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", G.decision(G.redacted(F.col("text")) != F.col("text"), F.lit(False), F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("toxic").isNull() & (F.col("doc_id") % 10 == 0)).alias("action"))


def policy_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("doc_id", "action", G.score(F.col("action")).alias("score"))


def route_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("doc_id", G.route(G.score(F.col("action"))).alias("route"))


def guard_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("toxic") == 1, F.concat(F.lit("unsafe\nS"), F.col("doc_id") % 14 + 1, F.lit(", S"), F.col("quality") + 1)).when(F.col("quality") == 1, " Safe ").otherwise("maybe")
    safe, codes = G.verdict(raw)
    return table(spark, d, "labels").select("doc_id", safe.alias("verdict"), F.array_join(codes, "|").alias("codes"))


# graph


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Nations in regions and brands of part types as triples, with some that don't validate."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = table(spark, d, "part")
    t1 = n.select(F.col("n_name").alias("subject_name"), F.lit("NukeNode").alias("subject_type"), F.lit("BELONGS_TO").alias("predicate"), F.col("r_name").alias("object_name"), F.lit("Category").alias("object_type"))
    t2 = p.select(F.col("p_type"), F.when(F.col("p_size") > 40, "Thing").otherwise("NukeNode"), F.lit("HAS_KNOB"), F.col("p_brand"), F.lit("Knob"))
    return t1.unionAll(t2)


_TRIPLES = """t AS (SELECT n_name AS subject_name, 'NukeNode' AS subject_type, 'BELONGS_TO' AS predicate, r_name AS object_name, 'Category' AS object_type FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT p_type, CASE WHEN p_size > 40 THEN 'Thing' ELSE 'NukeNode' END, 'HAS_KNOB', p_brand, 'Knob' FROM part),
g AS (SELECT DISTINCT * FROM t WHERE subject_type <> 'Thing'),
nb AS (SELECT DISTINCT * FROM (SELECT subject_name AS name, predicate, object_name AS neighbour FROM g UNION ALL SELECT object_name, predicate, subject_name FROM g)),
hop AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY predicate, neighbour) AS INTEGER) AS n FROM nb WHERE name IN (SELECT r_name FROM region UNION SELECT p_brand FROM part))"""


def kg_merge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return GR.merge(_triples(spark, d))


def table_facts(spark: SparkSession, d: str) -> DataFrame:
    """A page a part with two control rows: its brand's knob, and one named by its size."""
    text = F.concat(F.lit("Control | Knob | Default | Function\n"), "p_brand", F.lit(" | "), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit(" | 0 | Sets the 2 "), F.lower("p_type"), F.lit(" of it, and what else the page has to say.\n"), F.concat(F.lit("Size of "), "p_size"), F.lit(" | N/A | rgb | Picks channels."))
    return GR.control_triples(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("section"), text.alias("text")))


def input_facts(spark: SparkSession, d: str) -> DataFrame:
    """A page a part with a table of four inputs: labelled ones, an unnamed one, and one of a single word; its type is the last one's description."""
    head = F.lit("Text. Inputs and Controls  Connection Type Connection Name Function ")
    rows = [F.concat(F.lit("Input "), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" The source of it. It may be long. ")), F.concat(F.lit("Input unnamed The "), F.lower("p_type"), F.lit(" stream. ")),
            F.lit("Input Unnamed An image to use. Output out The result. "), F.lit("mask Optional matte. mask The same again. "), F.lit("Control (UI) nothing The end.")]
    pages = table(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(head, *rows).alias("text"))
    return GR.input_triples(pages.withColumn("text", F.when(F.length("name") % 5 == 0, F.lit("no table")).otherwise(F.col("text"))))


def _hop(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "region").select(F.col("r_name").alias("name")).unionByName(table(spark, d, "part").select(F.col("p_brand").alias("name")))
    return GR.neighbours(GR.merge(_triples(spark, d)), names)


def kg_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return _hop(spark, d)


def kg_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _hop(spark, d).select(GR.sentence(F.col("name"), F.col("predicate"), F.col("neighbour")).alias("sentence"))


def kg_node_count(spark: SparkSession, d: str) -> DataFrame:
    t = GR.merge(_triples(spark, d))
    ends = t.where("subject_type = 'NukeNode'").select(F.col("subject_name").alias("n")).unionByName(t.where("object_type = 'NukeNode'").select(F.col("object_name").alias("n")))
    return ends.agg(F.countDistinct("n").alias("nodes"))


def entity_longest_match(spark: SparkSession, d: str) -> DataFrame:
    names = _docs(spark, d).select("source").distinct().select(F.col("source").alias("name"))
    asks = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", F.lit("about"), "source", "lang").alias("text"))
    return GR.longest_entity(asks, names)


def relation_cues(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", GR.has_cue(F.col("text")).alias("cue"))


# caches


def exact_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Events of the first half of the ids are cached for 6 hours; all later ones ask by user and type."""
    e = _events(spark, d).withColumn("key", K.key(user=F.col("user_id"), type=F.col("event_type")))
    cut = _events(spark, d).agg(F.avg("event_id").alias("cut"))
    e = e.crossJoin(F.broadcast(cut))
    store = e.where("event_id <= cut").groupBy("key").agg(F.max(F.struct("ts", F.col("event_id").alias("answer"))).alias("m")).select("key", (F.col("m.ts") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"), "m.answer")
    asks = e.where("event_id > cut").select(F.col("event_id").alias("ask_id"), "key", "ts")
    live = asks.join(store, "key", "left").withColumn("answer", F.when(F.col("expires_at") > F.col("ts"), F.col("answer")))
    return live.select("ask_id", "answer", F.when(F.col("answer").isNotNull(), "hit").otherwise("miss").alias("status"))


def semantic_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The upper half of the vectors is cached, by label as scope; the benchmark items' vectors ask."""
    v = table(spark, d, "embeddings")
    half = v.agg((F.max("vec_id") / 2).alias("half"))
    cache = v.crossJoin(F.broadcast(half)).where("vec_id > half").select(F.col("label").alias("scope"), F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"), F.lit(10).alias("expires_at"))
    asks = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("ask_id"), F.col("label").alias("scope"), F.col("embedding").alias("vector"))
    return K.semantic_lookup(asks, cache, F.lit(5), 0.8)


def idempotent_first(spark: SparkSession, d: str) -> DataFrame:
    """Events with one (user, type, k) are retries of the first."""
    key = F.get_json_object("props", "$.k")
    return _events(spark, d).groupBy("user_id", "event_type", key.alias("k")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("tries"))


# evaluation


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Two runs from the labels (odd and even ids); cases without quality errored; toxicity is missing for every seventh."""
    l = table(spark, d, "labels")  # noqa: E741
    scores = F.map_filter(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("safety"), F.when(F.col("doc_id") % 7 != 0, 1.0 - F.col("toxic"))), lambda k, v: v.isNotNull())
    return l.select(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("run_id"), F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 11 == 0, "errored").otherwise("scored").alias("status"), scores.alias("scores"))


_CASES = """c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS run_id, doc_id AS case_id, CASE WHEN doc_id % 11 = 0 THEN 'errored' ELSE 'scored' END AS status, quality::DOUBLE AS quality, CASE WHEN doc_id % 7 <> 0 THEN 1.0::DOUBLE - toxic END AS safety FROM labels),
lg AS (SELECT run_id, status, 'quality' AS metric, quality AS score FROM c UNION ALL SELECT run_id, status, 'safety', safety FROM c),
mp AS (SELECT run_id, metric, round(avg(score), 9) AS mean FROM lg WHERE status = 'scored' AND score IS NOT NULL GROUP BY ALL),
cp AS (SELECT coalesce(x.metric, y.metric) AS metric, x.mean AS baseline, y.mean AS current, round(y.mean - x.mean, 9) AS delta FROM (SELECT * FROM mp WHERE run_id = 'a') x FULL JOIN (SELECT * FROM mp WHERE run_id = 'b') y ON x.metric = y.metric)"""


def eval_mean_present(spark: SparkSession, d: str) -> DataFrame:
    return S.mean_present(_cases(spark, d))


def eval_mean_all_scored(spark: SparkSession, d: str) -> DataFrame:
    return S.mean_all(_cases(spark, d))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    m = S.mean_present(_cases(spark, d))
    return S.compare(m.where("run_id = 'a'"), m.where("run_id = 'b'"))


def eval_regression_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).agg(F.bool_or("regressed").alias("fails"))


def eval_pivot(spark: SparkSession, d: str) -> DataFrame:
    return S.mean_present(_cases(spark, d)).groupBy("metric").pivot("run_id", ["a", "b"]).agg(F.first("mean"))


def eval_errors(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).groupBy("run_id").agg(F.count_if(F.col("status") == "errored").alias("errored"), F.count(F.lit(1)).alias("cases"))


# metrics, alerts, logs


def metric_counters(spark: SparkSession, d: str) -> DataFrame:
    return S.counters(_events(spark, d), ["event_type", "user_id"])


def metric_error_class(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, 503).otherwise(404)).otherwise(200)
    return _events(spark, d).groupBy("event_type", S.error_class(status).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def metric_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(_events(spark, d).withColumn("seconds", F.col("value") / 100), ["event_type"], "seconds")


def gauge_last(spark: SparkSession, d: str) -> DataFrame:
    return S.last_value(_events(spark, d), ["user_id"], "value", "event_id")


def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    last = S.last_value(_events(spark, d).withColumn("up", (F.col("event_type") != "error").cast("int")), ["user_id"], "up", "event_id")
    return last.agg(F.when(F.bool_and(F.col("value") == 1), "healthy").otherwise("degraded").alias("status"), F.count_if(F.col("value") == 0).alias("down"))


def metric_exposition(spark: SparkSession, d: str) -> DataFrame:
    return S.exposition(S.counters(_events(spark, d), ["event_type"]), "app_events_total", ["event_type"])


def alert_error_increase(spark: SparkSession, d: str) -> DataFrame:
    return S.increase_alerts(_events(spark, d), F.col("event_type") == "error")


def alert_changes(spark: SparkSession, d: str) -> DataFrame:
    return S.change_alerts(_events(spark, d), "user_id", "event_type", "ts")


def _statsd_name() -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, ("airflow.dagrun.duration.success.d", "airflow.dagrun.failed.d", "airflow.ti.duration.d.t.", "airflow.ti_successes", "other.d"))), (F.col("event_id") % 5 + 1).cast("int")), F.when(F.col("event_id") % 5 == 3, "").otherwise(F.col("user_id").cast("string")))


def statsd_map(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(S.statsd(_statsd_name()).alias("m")).groupBy("m.series", "m.dag_id", "m.task_id", "m.status").agg(F.count(F.lit(1)).alias("n"))


def log_json_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return _events(spark, d).groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def log_level_extract(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "note").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 - app.user"), F.col("user_id"), F.lit(" - "), level, F.lit(" - done"))
    return _events(spark, d).select("event_id", S.log_fields(line).alias("f")).select("event_id", "f.time", "f.logger", "f.level")


def recent_traces(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type", F.floor("value").cast("int").alias("duration_ms"))


def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def index_totals(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.length("text") < 100).alias("skipped"), F.sum(F.length("text")).alias("chars"))


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def token_usage(spark: SparkSession, d: str) -> DataFrame:
    n = T.word_count(F.col("text"))
    return _talk(spark, d).groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", 0).otherwise(n)).alias("prompt"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("completion"))


# the driver's star schema, beyond parity


def ext_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= "1998-09-02")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def ext_region_revenue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("orders"))


def ext_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user end after six quiet hours."""
    s = _events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


_TERM = "regexp_extract_all(lower(text), '([a-z0-9]+)', 1)"


def _redact_sql(text: str) -> str:
    for name, pattern in G.PATTERNS.items():
        text = f"regexp_replace({text}, '{pattern}', '[{name}]', 'g')"
    return text


def _entities_sql() -> str:
    text, out = "text", []
    for name, pattern in G.PATTERNS.items():
        out.append(f"CASE WHEN regexp_matches({text}, '{pattern}') THEN '{name}' END")
        text = f"regexp_replace({text}, '{pattern}', '[{name}]', 'g')"
    return f"array_to_string(list_sort(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)), ',')"


_ACTION = f"""a AS (SELECT doc_id, CASE WHEN toxic IS NULL AND doc_id % 10 = 0 THEN 'BLOCK' WHEN toxic = 1 THEN 'BLOCK' WHEN {_redact_sql('text')} <> text THEN 'REDACT' ELSE 'ALLOW' END AS action FROM documents LEFT JOIN labels USING (doc_id))"""
_STATSD = "SELECT event_id, ['airflow.dagrun.duration.success.d','airflow.dagrun.failed.d','airflow.ti.duration.d.t.','airflow.ti_successes','other.d'][event_id % 5 + 1] || CASE WHEN event_id % 5 = 3 THEN '' ELSE user_id::VARCHAR END AS name FROM events"
_HIST = ", ".join(f"({b!r}::DOUBLE, '{b}')" for b in S.LATENCY_BOUNDS)

SQL = {
    "msgs_filter": "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')",
    "latest_user_turn": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "thread_concat": "SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) AS request, length(string_agg(trim(text), chr(10) ORDER BY turn)) <= 32000 AS accepted FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id",
    "tail_messages": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 20",
    "thread_state": "SELECT conv_id, turn, count(*) OVER w AS n, CAST(sum(length(text)) OVER w AS BIGINT) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)",
    "answer_replay": "SELECT conv_id, turn, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT conv_id, turn, regexp_extract_all(text, '(\\S+)', 1) AS w FROM conversations WHERE role = 'assistant')",
    "text_preview": "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS short, substr(text, 1, 4500) AS long, length(text) > 20000 AS truncated FROM documents",
    "freshness_window": "SELECT doc_id, regexp_matches(lower(text), 'latest|news|today|recent|current') AS current, CASE WHEN regexp_matches(lower(text), '24 hour|today') THEN 1 WHEN regexp_matches(lower(text), '30 day|month') THEN 30 ELSE 7 END AS days FROM documents",
    "pii_redact": f"SELECT doc_id, md5({_redact_sql('text')}) AS digest FROM documents",
    "pii_entities": f"SELECT doc_id, {_entities_sql()} AS entities FROM documents",
    "policy_decision": f"WITH {_ACTION} SELECT doc_id, action, CASE WHEN action IN ('ALLOW', 'REDACT') THEN 100 ELSE 0 END AS score FROM a",
    "route_decision": f"WITH {_ACTION} SELECT doc_id, CASE WHEN action <> 'BLOCK' THEN 'continue' ELSE 'out_of_scope' END AS route FROM a",
    "guard_parse": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'unsafe' WHEN quality = 1 THEN 'safe' END AS verdict, CASE WHEN toxic = 1 THEN 'S' || (doc_id % 14 + 1) || '|S' || (quality + 1) ELSE '' END AS codes FROM labels",
    "kg_merge_dedup": f"WITH {_TRIPLES} SELECT * FROM g",
    "input_facts": """WITH p AS (SELECT DISTINCT p_name, regexp_replace(p_brand, '[# ]+', ' ', 'g') AS brand, 'The ' || lower(p_type) || ' stream' AS says FROM part WHERE length(p_name) % 5 <> 0 AND p_name <> ''),
o AS (SELECT p_name, brand || ' input' AS object_name FROM p UNION ALL SELECT p_name, array_to_string(list_filter(string_split(says, ' '), lambda w: w <> '')[1:4], ' ') || ' input' FROM p UNION ALL SELECT p_name, unnest(['image input', 'mask input']) FROM p)
SELECT p_name AS subject_name, 'NukeNode' AS subject_type, 'ACCEPTS_INPUT' AS predicate, min(object_name) AS object_name, 'InputType' AS object_type FROM o GROUP BY p_name, lower(object_name)""",
    "table_facts": """WITH p AS (SELECT p_name, p_brand, 'Size of ' || p_size AS label, 'Sets the 2 ' || lower(p_type) || ' of it, and what else the page has to say.' AS what FROM part),
r AS (SELECT p_name, p_brand, 1 AS pos, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS knob, what FROM p UNION ALL SELECT p_name, p_brand, 2, label, 'Picks channels.' FROM p),
t AS (SELECT pos, p_name AS subject_name, 'NukeNode' AS subject_type, 'BELONGS_TO' AS predicate, p_brand AS object_name, 'Category' AS object_type FROM r WHERE p_brand <> ''
  UNION ALL SELECT pos, p_name, 'NukeNode', 'HAS_KNOB', knob, 'Knob' FROM r
  UNION ALL SELECT pos, knob, 'Knob', 'KNOB_CONTROLS', array_to_string(regexp_extract_all(what, '[A-Za-z][A-Za-z0-9_-]*')[1:9], ' '), 'Operation' FROM r
  UNION ALL SELECT pos, knob, 'Knob', 'AFFECTS_CHANNEL', 'image channels', 'Channel' FROM r WHERE contains(lower(what), 'channel'))
SELECT subject_name, subject_type, predicate, object_name, object_type FROM
  (SELECT *, row_number() OVER (PARTITION BY lower(subject_name), subject_type, predicate, lower(object_name), object_type ORDER BY pos, subject_name, subject_type, object_name, object_type) AS n FROM t WHERE subject_name <> '') WHERE n = 1""",
    "kg_one_hop": f"WITH {_TRIPLES} SELECT * FROM hop WHERE n <= 10",
    "kg_sentences": f"WITH {_TRIPLES} SELECT name || ' ' || lower(replace(predicate, '_', ' ')) || ' ' || neighbour || '.' AS sentence FROM hop WHERE n <= 10",
    "kg_node_count": f"WITH {_TRIPLES} SELECT count(DISTINCT n) AS nodes FROM (SELECT subject_name AS n FROM g WHERE subject_type = 'NukeNode' UNION ALL SELECT object_name FROM g WHERE object_type = 'NukeNode')",
    "entity_longest_match": "WITH n AS (SELECT DISTINCT source AS name FROM documents), h AS (SELECT doc_id AS query_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS n FROM documents JOIN n ON contains(lower('about ' || source || ' ' || lang), lower(name))) SELECT query_id, name FROM h WHERE n = 1",
    "relation_cues": f"SELECT doc_id, regexp_matches(lower(substr(text, 1, 3000)), '{'|'.join(GR.CUES)}') AS cue FROM documents",
    "exact_cache_lookup": """WITH e AS (SELECT *, left(sha256('{"type":"' || event_type || '","user":' || user_id || '}'), 16) AS key, avg(event_id) OVER () AS cut FROM events),
s AS (SELECT key, max({'ts': ts, 'a': event_id}) AS m FROM e WHERE event_id <= cut GROUP BY key)
SELECT event_id AS ask_id, CASE WHEN s.m.ts + INTERVAL 6 HOURS > e.ts THEN s.m.a END AS answer, CASE WHEN s.m.ts + INTERVAL 6 HOURS > e.ts THEN 'hit' ELSE 'miss' END AS status FROM e LEFT JOIN s USING (key) WHERE event_id > cut""",
    "semantic_cache_lookup": """WITH h AS (SELECT max(vec_id) / 2 AS half FROM embeddings), c AS (SELECT * FROM embeddings, h WHERE vec_id > half),
q AS (SELECT e.* FROM embeddings e JOIN benchmark ON item_id = vec_id),
p AS (SELECT q.vec_id AS ask_id, c.vec_id AS entry_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS distance FROM q JOIN c ON q.label = c.label),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY distance, entry_id) AS n FROM p) WHERE n = 1)
SELECT q.vec_id AS ask_id, CASE WHEN distance <= 0.8 THEN entry_id END AS entry_id, CASE WHEN distance <= 0.8 THEN 'hit' ELSE 'miss' END AS status FROM q LEFT JOIN b ON b.ask_id = q.vec_id""",
    "idempotent_first": "SELECT user_id, event_type, props::JSON ->> '$.k' AS k, min(event_id) AS first_id, count(*) AS tries FROM events GROUP BY ALL",
    "eval_mean_present": f"WITH {_CASES} SELECT * FROM mp",
    "eval_mean_all_scored": f"WITH {_CASES}, n AS (SELECT run_id, count(*) AS n FROM c WHERE status = 'scored' GROUP BY ALL) SELECT run_id, metric, round(coalesce(sum(score), 0) / any_value(n), 9) AS mean FROM lg JOIN n USING (run_id) WHERE status = 'scored' GROUP BY ALL",
    "eval_regression_diff": f"WITH {_CASES} SELECT *, coalesce(delta < -0.05, false) AS regressed FROM cp",
    "eval_gate": f"WITH {_CASES} SELECT bool_or(coalesce(delta < -0.05, false)) AS fails FROM cp",
    "eval_pivot": f"WITH {_CASES} SELECT metric, baseline AS a, current AS b FROM cp",
    "eval_errors": f"WITH {_CASES} SELECT run_id, CAST(count_if(status = 'errored') AS BIGINT) AS errored, count(*) AS cases FROM c GROUP BY run_id",
    "metric_counters": "SELECT event_type, user_id, count(*) AS total FROM events GROUP BY ALL",
    "metric_error_class": "SELECT event_type, CASE WHEN event_type <> 'error' THEN 'ok' WHEN value > 50 THEN 'critical' ELSE 'warning' END AS class, count(*) AS n FROM events GROUP BY ALL",
    "metric_histogram": f"""WITH b(v, le) AS (VALUES {_HIST}, ('inf'::DOUBLE, '+Inf')), a AS (SELECT event_type, count(value) AS count, round(sum(value / 100), 6) AS sum FROM events GROUP BY ALL)
SELECT event_type, le, CAST(count_if(value / 100 <= v) AS BIGINT) AS n, any_value(count) AS count, any_value(sum) AS sum FROM events JOIN a USING (event_type), b GROUP BY event_type, le""",
    "gauge_last": "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "health_rollup": "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY ALL) SELECT CASE WHEN bool_and(t <> 'error') THEN 'healthy' ELSE 'degraded' END AS status, CAST(count_if(t = 'error') AS BIGINT) AS down FROM l",
    "metric_exposition": "SELECT 'app_events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type",
    "alert_error_increase": "WITH e AS (SELECT time_bucket(INTERVAL 15 SECONDS, ts) AS b FROM events WHERE event_type = 'error'), w AS (SELECT b - to_seconds(15 * i) AS start FROM e, range(4) r(i)) SELECT start, start + INTERVAL 1 MINUTE AS \"end\", count(*) AS errors FROM w GROUP BY start",
    "alert_changes": "WITH e AS (SELECT user_id, ts, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events) SELECT user_id, time_bucket(INTERVAL 5 MINUTES, ts) AS start, CAST(sum(c::INT) AS BIGINT) AS changes FROM e GROUP BY ALL HAVING sum(c::INT) > 0",
    "statsd_map": f"""WITH e AS ({_STATSD}), m AS (SELECT event_id % 5 AS i, string_split(name, '.') AS p FROM e)
SELECT CASE i WHEN 0 THEN 'airflow_dagrun_duration_seconds' WHEN 1 THEN 'airflow_dagrun_total' WHEN 2 THEN 'airflow_task_duration_seconds' WHEN 3 THEN 'airflow_task_instance_total' END AS series,
  CASE i WHEN 0 THEN p[5] WHEN 1 THEN p[4] WHEN 2 THEN p[4] END AS dag_id, CASE i WHEN 2 THEN p[5] END AS task_id, CASE i WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN p[6] WHEN 3 THEN 'success' END AS status, count(*) AS n FROM m GROUP BY ALL""",
    "log_json_extract": "SELECT event_type, (props::JSON ->> '$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "log_level_extract": "SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ',123' END AS time, CASE WHEN event_type = 'click' THEN '' ELSE 'app.user' || user_id END AS logger, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN '' ELSE 'INFO' END AS level FROM events",
    "recent_traces": "SELECT event_id, event_type, CAST(floor(value) AS INTEGER) AS duration_ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "distinct_sources": "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang",
    "index_totals": "SELECT count(*) AS files, CAST(count_if(length(text) < 100) AS BIGINT) AS skipped, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents",
    "term_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TERM}) AS term FROM documents) GROUP BY term",
    "token_usage": "SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END) AS BIGINT) AS prompt, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS completion FROM (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations) GROUP BY conv_id",
    "ext_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL",
    "ext_region_revenue": "SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "ext_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k",
    "ext_tumbling": "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in SQL}
