"""Reply parsing, repository references, sections, request metadata, run statistics and unit helpers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import replies as A
from docspark.session import table


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _form(number: Column, forms: list) -> Column:
    """One of the forms, by the number's remainder."""
    out = F.lit(forms[-1]) if isinstance(forms[-1], str) else forms[-1]
    for i, f in reversed(list(enumerate(forms[:-1]))):
        out = F.when(number % len(forms) == i, f).otherwise(out)
    return out


def _form_sql(number: str, forms: list[str]) -> str:
    return f"CASE {number} % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


# replies



def _ident() -> Column:
    return F.col("doc_id").cast("string")


def _replies() -> list:
    return [
        F.concat(F.lit('{"answer": "a'), _ident(), F.lit('", "confidence": "high"}')), F.concat(F.lit('Sure:\n{"answer": "b'), _ident(), F.lit('"}\nDone.')),
        F.concat(F.lit('{"answer": '), _ident(), F.lit("}")), F.concat(F.lit("plain "), _ident()), F.lit('{"sources": []}'), F.lit("{broken"),
    ]


_REPLIES_SQL = ["""'{"answer": "a' || doc_id || '", "confidence": "high"}'""", """'Sure:' || chr(10) || '{"answer": "b' || doc_id || '"}' || chr(10) || 'Done.'""", """'{"answer": ' || doc_id || '}'""", "'plain ' || doc_id", """'{"sources": []}'""", "'{broken'"]


def reply_structured(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("doc_id", A.structured_reply(_form(F.col("doc_id"), _replies())).alias("r")).select("doc_id", "r.answer", "r.confidence", "r.parsed")


def _verdicts() -> list:
    return [
        F.concat(F.lit('```json\n{"status": "pass", "feedback": "f'), _ident(), F.lit('"}\n```')), F.concat(F.lit(' {"status": "fail", "feedback": "g'), _ident(), F.lit('"} ')),
        F.lit('{"status": "maybe", "feedback": "x"}'), F.lit('{"status": "pass", "feedback": ""}'), F.lit("no json"), F.lit('{"status": "pass"}'),
    ]


_VERDICTS_SQL = ["""'```json' || chr(10) || '{"status": "pass", "feedback": "f' || doc_id || '"}' || chr(10) || '```'""", """' {"status": "fail", "feedback": "g' || doc_id || '"} '""", """'{"status": "maybe", "feedback": "x"}'""", """'{"status": "pass", "feedback": ""}'""", "'no json'", """'{"status": "pass"}'"""]


def reply_feedback(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("doc_id", A.feedback(_form(F.col("doc_id"), _verdicts())).alias("f")).select("doc_id", "f.status", "f.feedback")


def reply_verdict_pair(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("doc_id", A.verdict_pair(_form(F.col("doc_id"), _verdicts())).alias("f")).select("doc_id", "f.passed", "f.feedback")


def _inputs() -> list:
    return [F.concat(F.lit('{"original_request": "learn '), _ident(), F.lit('", "research_findings": "found"}')), F.lit('{"original_request": 3, "research_findings": "found"}'), F.concat(F.lit("findings "), _ident()), F.lit('["x"]')]


_INPUTS_SQL = ["""'{"original_request": "learn ' || doc_id || '", "research_findings": "found"}'""", """'{"original_request": 3, "research_findings": "found"}'""", "'findings ' || doc_id", """'["x"]'"""]


def review_input(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("doc_id", A.review_input(_form(F.col("doc_id"), _inputs())).alias("f")).select("doc_id", "f.request", "f.findings")


def _tasks() -> list:
    return [
        F.concat(F.lit('{"result": {"status": {"state": "completed"}, "artifacts": [{"parts": [{"kind": "data"}, {"kind": "text", "text": ""}]}, {"parts": [{"kind": "text", "text": "t'), _ident(), F.lit('"}]}]}}')),
        F.lit('{"result": {"status": {"state": "failed"}, "artifacts": [{"parts": [{"kind": "text", "text": "x"}]}]}}'), F.lit('{"result": {"status": {"state": "completed"}, "artifacts": []}}'), F.lit("{}"),
    ]




def task_artifact(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("doc_id", A.first_artifact(_form(F.col("doc_id"), _tasks())).alias("f")).select("doc_id", "f.state", "f.text")


# repositories



def _page() -> Column:
    return F.col("page_id").cast("string")


def _refs() -> list:
    return [F.concat(F.lit("https://github.com/Own"), _page(), F.lit("/Repo.git")), F.concat(F.lit("git@github.com:own/R"), _page()), F.concat(F.lit(" own/r"), _page(), F.lit(".git ")), F.concat(F.lit("WWW.GitHub.com/o/r"), _page(), F.lit("/?tab=x")), F.lit("a/b/c"), F.lit("bad one/x"), F.lit(" "), F.lit("http://github.com/o/r#frag")]


_REFS_SQL = ["'https://github.com/Own' || page_id || '/Repo.git'", "'git@github.com:own/R' || page_id", "' own/r' || page_id || '.git '", "'WWW.GitHub.com/o/r' || page_id || '/?tab=x'", "'a/b/c'", "'bad one/x'", "' '", "'http://github.com/o/r#frag'"]


def repo_reference(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select("page_id", A.repository(_form(F.col("page_id"), _refs())).alias("repo"), F.md5(F.col("url").cast("binary")).alias("head"), F.when(F.col("page_id") % 3 == 0, F.md5(F.lit("old").cast("binary"))).otherwise(F.md5(F.col("url").cast("binary"))).alias("indexed"))
    return rows.select("page_id", "repo", A.cache_slug(F.col("repo"), F.col("head")).alias("slug"), (F.col("head") != F.col("indexed")).alias("stale"))


def domain_list(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hosts of the pages by first letter of their title, given in mixed case and with blanks."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    rows = _pages(spark, d).select((F.col("page_id") % 7).alias("list_id"), F.explode(F.array(F.concat(F.lit(" "), F.upper(host)), host, F.lit(" "))).alias("x")).groupBy("list_id").agg(F.collect_set("x").alias("xs"))
    clean = F.array_sort(F.array_distinct(F.filter(F.transform("xs", lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    return rows.select("list_id", F.array_join(clean, ",").alias("domains"))


# texts


def text_fragment(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    connection = _form(F.col("doc_id"), [F.lit("unnamed"), F.lit(" mask "), F.lit("Unnamed")])
    return docs.select("doc_id", A.fragment(F.col("text"), 8).alias("fragment"), A.input_name(connection, F.when(F.col("doc_id") % 4 == 0, "An Image").otherwise(F.left("text", F.lit(300)))).alias("input"))


def text_between(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(A.between(F.col("text"), "the ", [" and ", r"\. ", r"\n"]).cast("binary")).alias("digest"))


def sources_section(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    found = F.when(F.col("page_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(url, F.lit(""), F.concat(url, F.lit("#x")), url, F.lit(None)))
    return _pages(spark, d).select("page_id", A.with_sources(F.concat(F.lit(" Report "), _page(), F.lit(" ")), found).alias("report"))


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections as source documents of the pages, blank ones left out; pages without headings are one document with the whole text. Every third page's paragraphs get headings."""
    headed = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<p>"), F.lit("<h2 class='c'>Part</h2><p>"))).otherwise(F.col("html"))
    body = F.regexp_extract(headed, "(?is)<body[^>]*>(.*)</body>", 1)
    rows = _pages(spark, d).select("page_id", "url", A.sections(body).alias("s"), body.alias("body"))
    flat = rows.select("page_id", "url", F.explode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.struct(F.lit("").alias("title"), F.col("body").alias("html"))))).alias("s"))
    out = flat.select("page_id", F.col("s.title").alias("section_title"), T.html_to_text(F.col("s.html")).alias("text")).where("text <> ''")
    return out.groupBy("page_id", "section_title").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("text")).alias("chars"))


def block_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation as blocks, the assistant's last one as final answer in every second conversation; texts come twice."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = table(spark, d, "conversations").withColumn("last", last)
    phase = F.when((F.col("turn") == F.col("last")) & (F.col("conv_id") % 2 == 0), "final_answer").otherwise("commentary")
    text = A.block_text(F.when(F.col("turn") % 2 == 0, F.left("text", F.lit(40))), F.left("text", F.lit(30)))
    blocks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", phase.alias("phase"), text.alias("text")))).alias("b"))
    return blocks.select("conv_id", F.md5(A.block_texts(F.concat("b", "b")).cast("binary")).alias("digest"))


# requests, scores, maps


def request_fields(spark: SparkSession, d: str) -> DataFrame:
    """Effective query, metadata as JSON, relevance by length, the rewrite's fallback, attempts left."""
    t = table(spark, d, "conversations").where("role = 'user'")
    clean = F.when(F.col("turn") % 3 == 0, " ").otherwise(F.left("text", F.lit(20)))
    query = F.coalesce(F.nullif(F.trim(clean), F.lit("")), F.left("text", F.lit(60)))
    order = Window.partitionBy("conv_id").orderBy("turn")
    meta = F.to_json(F.struct(F.col("conv_id").alias("user_id"), F.col("turn").alias("session_id"), F.lit("m").alias("model"), F.lit(3).alias("top_k"), F.lit(True).alias("use_hybrid")))
    return t.select("conv_id", "turn", query.alias("query"), meta.alias("metadata"), (F.length("text") > 50).alias("relevant"), F.concat_ws(" ", query, F.lit(A.EXPANSION)).alias("rewritten"), (F.row_number().over(order) <= 2).alias("may_retry"))


def rejection(spark: SparkSession, d: str) -> DataFrame:
    entry, leave = F.when(F.col("toxic") == 1, 40).otherwise(80), F.when(F.col("quality") == 0, 0).otherwise(100)
    at = A.rejected_at(entry, leave)
    said = F.when(leave == 0, F.concat(F.lit("Not shown: the answer does not refer to the sources. Your question: '"), _ident(), F.lit("'"))).otherwise(F.concat(F.lit("Out of scope. Your question: '"), _ident(), F.lit("'")))
    return _labels(spark, d).select("doc_id", at.alias("rejected_at"), F.when(at.isNotNull(), said).alias("message"))


def tool_skill(spark: SparkSession, d: str) -> DataFrame:
    path = _form(F.col("event_id"), [F.lit("C:\\Users\\x\\Ship\\SKILL.md"), F.lit("/s/office-hours/notes.txt"), F.lit("/s/autoplan/SKILL.md"), F.lit("/other/file.txt")])
    tool = F.when(F.col("event_id") % 3 == 0, "read_file").otherwise("search")
    fields = F.create_map(F.lit("thread_id"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("user_id").cast("string")), F.lit("conversation_id"), F.col("event_type"))
    both = A.merged_map(fields, F.create_map(F.lit("thread_id"), F.lit("new"), F.lit("tool"), tool))
    return _events(spark, d).select("event_id", A.skill(tool, F.create_map(F.lit("path"), path)).alias("skill"), A.first_present(fields, ("thread_id", "conversation_id")).alias("thread"), F.array_join(F.array_sort(F.map_keys(both)), ",").alias("keys"), both["thread_id"].alias("merged"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", A.unit(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)).alias("u"))
    return v.select("vec_id", F.round(F.col("u")[0], 9).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def unit_helpers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return _events(spark, d).select(
        "event_id", F.greatest(F.lit(1), F.least(n, F.lit(500))).alias("clamped"), F.floor((n + 31) / 32).alias("batches"), F.least(F.pow(F.lit(2.0), n % 9), F.lit(60.0)).cast("int").alias("backoff"),
        F.round(n * 70_000 / 1_000_000.0, 2).alias("ms"), (F.col("value") * 1000).cast("int").alias("whole_ms"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("compact"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("expires"),
    )


# run statistics


def run_report(spark: SparkSession, d: str) -> DataFrame:
    """One row from each stage's statistics."""
    scraped = _pages(spark, d).agg(F.count(F.lit(1)).alias("scraped"))
    stored = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("stored"), F.sum("n_chars").alias("chars"))
    scored = _labels(spark, d).agg(F.count_if(F.col("toxic") == 1).alias("rejected"))
    return scraped.crossJoin(stored).crossJoin(scored)  # one row each


def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Events in batches of a hundred: sums, ids of errors joined in order, and the distinct users with errors over all batches of a type."""
    e = _events(spark, d).withColumn("batch", F.floor(F.col("event_id") / 100))
    error = F.col("event_type") == "error"
    ids = F.array_join(F.array_sort(F.collect_list(F.when(error, F.col("event_id")))), ",")
    users = F.array_sort(F.collect_set(F.when(error, F.col("user_id"))))
    return e.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), ids.alias("error_ids"), F.array_join(users, ",").alias("error_users"))


def error_id_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids out of comma-separated lists."""
    lists = batch_totals(spark, d).select((F.col("batch") % 5).alias("run"), F.explode(F.split("error_users", ",")).alias("x")).where("x <> ''")
    return lists.groupBy("run").agg(F.array_join(F.array_sort(F.transform(F.collect_set("x"), lambda x: x.cast("long"))), ",").alias("ids"))


def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    """By page: triples considered, extracted and written; a page failed if less was written than extracted."""
    n = F.size(F.regexp_extract_all("html", F.lit("<a href"), 0))
    rows = _pages(spark, d).select("page_id", n.alias("considered"), F.least(n, F.lit(5)).alias("extracted"), F.least(n, F.lit(5), (F.col("page_id") % 7).cast("int")).alias("written"))
    return rows.withColumn("failed", F.col("written") < F.col("extracted")).agg(F.count(F.lit(1)).alias("pages"), F.sum("considered").alias("considered"), F.sum("extracted").alias("extracted"), F.sum("written").alias("triples"), F.count_if("failed").alias("failed"))


def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a toxic label or a bad one (anti-join)."""
    bad = _labels(spark, d).where("toxic = 1 or quality = 0").select("doc_id")
    return table(spark, d, "documents").join(bad, "doc_id", "left_anti").select("doc_id")


def metric_name_sets(spark: SparkSession, d: str) -> DataFrame:
    """Names of two runs: their union, and which are new."""
    e = _events(spark, d)
    old = e.where("event_id % 2 = 0 and value < 50").select(F.concat_ws("_", "event_type", F.col("user_id") % 40).alias("name")).distinct()
    new = e.where("event_id % 2 = 1 and value < 60").select(F.concat_ws("_", "event_type", F.col("user_id") % 40).alias("name")).distinct()
    added = new.exceptAll(old).withColumn("added", F.lit(True))
    return old.union(new).distinct().join(added, "name", "left").select("name", F.coalesce("added", F.lit(False)).alias("added"))


def ui_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of numeric scores of any status; others are left out."""
    raw = F.when(F.col("event_id") % 6 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return _events(spark, d).groupBy("event_type").agg(F.round(F.avg(raw.try_cast("double")), 6).alias("mean"), F.count(raw.try_cast("double")).alias("n"))


def chunk_fields(spark: SparkSession, d: str) -> DataFrame:
    """Chunk rows under several field names as one; those without a text are rejected."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, _ident()).alias("chunk_id"), F.when(F.col("doc_id") % 3 == 1, _ident()).alias("_id"), F.col("source").alias("section_title"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("section_name"), F.length("text").alias("n"))
    ident = F.coalesce("chunk_id", "_id", F.sha2(F.concat(F.lit("doc:"), _ident()).cast("binary"), 256))
    return docs.select("doc_id", ident.alias("chunk_id"), F.coalesce("section_name", "section_title", F.lit("")).alias("section_name"), (F.coalesce(F.col("n"), F.lit(0)) > 0).alias("accepted"))


_OBJ = "json_valid({x}) AND json_type({x}) = 'OBJECT'"


def _str(x: str, key: str) -> str:
    return f"(CASE WHEN json_valid({x}) THEN CASE WHEN json_type({x}, '$.{key}') = 'VARCHAR' THEN json_extract_string({x}, '$.{key}') END END)"


# the address in parts: what stands before the first slash, and the parts behind it
_REPO = """(SELECT CASE WHEN starts_with(lower(c), 'git@github.com:') THEN list_filter(string_split(c[16:], '/'), lambda x: x <> '')
  WHEN list_contains(hosts, 'github.com') THEN list_filter(string_split(string_split(string_split(array_to_string(parts[list_position(hosts, 'github.com') + 1:], '/'), '#')[1], '?')[1], '/'), lambda x: x <> '')
  WHEN len(parts) = 2 AND NOT contains(c, ' ') THEN parts END AS two FROM (SELECT string_split(c, '/') AS parts, list_transform(string_split(lower(c), '/'), lambda x: CASE WHEN starts_with(x, 'www.') THEN x[5:] ELSE x END) AS hosts))"""
_FENCE = "CASE WHEN starts_with(trim(x), '```') AND ends_with(trim(x), '```') THEN trim(regexp_replace(regexp_replace(trim(x), '^[^\\n]*\\n', ''), '\\n[^\\n]*$', '')) ELSE trim(x) END"
_H2 = "chr(1)"


def _text_sql(html: str) -> str:
    from docspark.plans.ingest import _text_sql as plain

    return plain(html)


SQL = {
    "reply_structured": f"""WITH r AS (SELECT doc_id, {_form_sql('doc_id', _REPLIES_SQL)} AS x FROM labels), p AS (SELECT *, nullif(regexp_extract(x, '\\{{.*\\}}', 0, 's'), '') AS y FROM r),
u AS (SELECT *, CASE WHEN {_str('x', 'answer')} IS NOT NULL THEN x WHEN {_str('y', 'answer')} IS NOT NULL THEN y END AS z FROM p)
SELECT doc_id, coalesce({_str('z', 'answer')}, x) AS answer, CASE WHEN z IS NULL THEN 'low' ELSE {_str('z', 'confidence')} END AS confidence, CASE WHEN z IS NULL THEN 'text' WHEN z = x THEN 'whole' ELSE 'part' END AS parsed FROM u""",
    "reply_feedback": f"""WITH r AS (SELECT doc_id, {_form_sql('doc_id', _VERDICTS_SQL)} AS x FROM labels), b AS (SELECT doc_id, {_FENCE} AS b FROM r), f AS (SELECT doc_id, {_str('b', 'status')} AS s, {_str('b', 'feedback')} AS t FROM b)
SELECT doc_id, CASE WHEN s IN ('pass', 'fail') AND t <> '' THEN s END AS status, CASE WHEN s IN ('pass', 'fail') AND t <> '' THEN t END AS feedback FROM f""",
    "reply_verdict_pair": f"""WITH r AS (SELECT doc_id, {_form_sql('doc_id', _VERDICTS_SQL)} AS x FROM labels)
SELECT doc_id, coalesce({_str('x', 'status')} = 'pass', false) AS passed, CASE WHEN json_valid(x) THEN coalesce({_str('x', 'feedback')}, '') ELSE '{A.NO_VERDICT}' END AS feedback FROM r""",
    "review_input": f"""WITH r AS (SELECT doc_id, {_form_sql('doc_id', _INPUTS_SQL)} AS x FROM labels), f AS (SELECT *, {_str('x', 'original_request')} AS a, {_str('x', 'research_findings')} AS b FROM r)
SELECT doc_id, CASE WHEN b IS NOT NULL THEN a END AS request, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE x END AS findings FROM f""",
    "task_artifact": "SELECT doc_id, ['completed', 'failed', 'completed', 'an invalid response'][doc_id % 4 + 1] AS state, CASE WHEN doc_id % 4 = 0 THEN 't' || doc_id END AS text FROM labels",
    "repo_reference": f"""WITH r AS (SELECT page_id, url, trim({_form_sql('page_id', _REFS_SQL)}) AS c FROM pages), m AS (SELECT page_id, url, {_REPO} AS two FROM r), n AS (SELECT page_id, url, CASE WHEN len(two) = 2 THEN two[1] || '/' || CASE WHEN ends_with(two[2], '.git') THEN two[2][:-5] ELSE two[2] END END AS repo FROM m)
SELECT page_id, repo, replace(lower(repo), '/', '__') || '__' || left(md5(url), 12) AS slug, CASE WHEN page_id % 3 = 0 THEN md5(url) <> md5('old') ELSE false END AS stale FROM n""",
    "domain_list": "SELECT page_id % 7 AS list_id, string_agg(DISTINCT lower(regexp_extract(url, '^https?://([^/]+)', 1)), ',' ORDER BY lower(regexp_extract(url, '^https?://([^/]+)', 1))) AS domains FROM pages GROUP BY ALL",
    "text_fragment": """WITH f AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9_-]*)', 1)[1:8], ' ') AS fragment, CASE WHEN doc_id % 4 = 0 THEN 'An Image' ELSE left(text, 300) END AS s FROM documents)
SELECT doc_id, fragment, CASE WHEN doc_id % 3 = 1 THEN 'mask input' WHEN contains(lower(s), 'image') THEN 'image input' WHEN regexp_matches(s, '[A-Za-z]') THEN array_to_string(regexp_extract_all(s, '([A-Za-z][A-Za-z0-9_-]*)', 1)[1:4], ' ') || ' input' ELSE 'unnamed input' END AS input FROM f""",
    "text_between": """WITH b AS (SELECT doc_id, CASE WHEN contains(lower(text), 'the ') THEN substr(text, instr(lower(text), 'the ') + 4) END AS body FROM documents),
c AS (SELECT doc_id, body, list_min(list_filter([instr(lower(body), ' and '), instr(body, '. '), instr(body, chr(10))], lambda x: x > 0)) AS stop_at FROM b)
SELECT doc_id, md5(coalesce(trim(CASE WHEN stop_at IS NULL THEN body ELSE left(body, stop_at - 1) END), '')) AS digest FROM c""",
    "sources_section": "SELECT page_id, 'Report ' || page_id || CASE WHEN page_id % 5 = 0 THEN '' ELSE chr(10) || chr(10) || '## Sources' || chr(10) || '- ' || url || chr(10) || '- ' || url || '#x' END AS report FROM pages",
    "page_sections": f"""WITH b AS (SELECT page_id, regexp_extract(CASE WHEN page_id % 3 = 0 THEN replace(html, '<p>', '<h2 class=''c''>Part</h2><p>') ELSE html END, '<body[^>]*>(.*)</body>', 1, 'si') AS body FROM pages),
p AS (SELECT page_id, string_split(regexp_replace(body, '<h2(\\s[^>]*)?>', {_H2}, 'gi'), {_H2}) AS p FROM b),
s AS (SELECT page_id, len(p) AS n, generate_subscripts(p, 1) AS i, unnest(p) AS h FROM p),
t AS (SELECT page_id, CASE WHEN n = 1 THEN '' WHEN i = 1 THEN 'Overview' ELSE regexp_extract(h, '^(.*?)</h2>', 1, 'si') END AS section_title, {_text_sql("CASE WHEN i = 1 THEN h ELSE regexp_replace(h, '^.*?</h2>', '', 'si') END")} AS text FROM s)
SELECT page_id, section_title, count(*) AS parts, sum(length(text))::BIGINT AS chars FROM t WHERE text <> '' GROUP BY ALL""",
    "block_dedup": """WITH b AS (SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 2 = 0 AS final, coalesce(CASE WHEN turn % 2 = 0 THEN left(text, 40) END, left(text, 30), '') AS t FROM conversations),
f AS (SELECT conv_id, t, arg_min(final, turn) AS final, min(turn) AS turn FROM b WHERE t <> '' GROUP BY conv_id, t),
g AS (SELECT *, bool_or(final) OVER (PARTITION BY conv_id) AS has FROM f)
SELECT conv_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS digest FROM g WHERE final OR NOT has GROUP BY conv_id""",
    "request_fields": f"""WITH u AS (SELECT *, CASE WHEN turn % 3 = 0 THEN ' ' ELSE left(text, 20) END AS c FROM conversations WHERE role = 'user'), q AS (SELECT *, coalesce(nullif(trim(c), ''), left(text, 60)) AS query FROM u)
SELECT conv_id, turn, query, '{{"user_id":' || conv_id || ',"session_id":' || turn || ',"model":"m","top_k":3,"use_hybrid":true}}' AS metadata, length(text) > 50 AS relevant, query || ' {A.EXPANSION}' AS rewritten, row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2 AS may_retry FROM q""",
    "rejection": """WITH r AS (SELECT *, CASE WHEN toxic = 1 THEN 'input' WHEN quality = 0 THEN 'output' END AS rejected_at FROM labels)
SELECT doc_id, rejected_at, CASE WHEN rejected_at IS NOT NULL THEN CASE WHEN quality = 0 THEN 'Not shown: the answer does not refer to the sources. Your question: ''' ELSE 'Out of scope. Your question: ''' END || doc_id || '''' END AS message FROM r""",
    "tool_skill": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ship' WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 'office-hours' END WHEN 2 THEN 'autoplan' END AS skill, CASE WHEN event_id % 2 = 0 THEN event_type ELSE user_id::VARCHAR END AS thread, 'conversation_id,thread_id,tool' AS keys, 'new' AS merged FROM events""",
    "unit_vectors": "WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v) SELECT vec_id, round(CASE WHEN n > 0 THEN e[1] / n ELSE e[1] END, 9) AS first, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM n",
    "unit_helpers": "SELECT event_id, greatest(1, least(event_id, 500)) AS clamped, (event_id + 31) // 32 AS batches, least(2 ** (event_id % 9), 60)::INTEGER AS backoff, round(event_id * 70000 / 1000000.0::DOUBLE, 2) AS ms, trunc(value * 1000)::INTEGER AS whole_ms, strftime(ts, '%Y%m%dT%H%M%SZ') AS compact, ts + INTERVAL 30 MINUTES AS expires FROM events",
    "run_report": "SELECT (SELECT count(*) FROM pages) AS scraped, (SELECT count(*) FROM documents) AS stored, (SELECT sum(n_chars)::BIGINT FROM documents) AS chars, (SELECT count_if(toxic = 1)::BIGINT FROM labels) AS rejected",
    "batch_totals": "SELECT event_id // 100 AS batch, count(*) AS n, round(sum(value), 6) AS total, coalesce(string_agg(CASE WHEN event_type = 'error' THEN event_id END, ',' ORDER BY event_id), '') AS error_ids, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN event_type = 'error' THEN user_id END))), ','), '') AS error_users FROM events GROUP BY ALL",
    "error_id_union": "SELECT (event_id // 100) % 5 AS run, array_to_string(list_sort(list_distinct(list(user_id))), ',') AS ids FROM events WHERE event_type = 'error' GROUP BY ALL",
    "extraction_stats": "WITH r AS (SELECT page_id, len(regexp_extract_all(html, '<a href')) AS n FROM pages), w AS (SELECT n, least(n, 5) AS e, least(n, 5, page_id % 7) AS w FROM r) SELECT count(*) AS pages, sum(n)::BIGINT AS considered, sum(e)::BIGINT AS extracted, sum(w)::BIGINT AS triples, count_if(w < e)::BIGINT AS failed FROM w",
    "clean_documents": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)",
    "metric_name_sets": """WITH o AS (SELECT DISTINCT event_type || '_' || user_id % 40 AS name FROM events WHERE event_id % 2 = 0 AND value < 50), n AS (SELECT DISTINCT event_type || '_' || user_id % 40 AS name FROM events WHERE event_id % 2 = 1 AND value < 60)
SELECT name, name NOT IN (SELECT name FROM o) AS added FROM (SELECT name FROM o UNION SELECT name FROM n)""",
    "ui_mean": "SELECT event_type, round(avg(CASE WHEN event_id % 6 <> 0 THEN value END), 6) AS mean, count(CASE WHEN event_id % 6 <> 0 THEN value END) AS n FROM events GROUP BY ALL",
    "chunk_fields": "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id::VARCHAR ELSE sha256('doc:' || doc_id) END AS chunk_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source, '') AS section_name, coalesce(length(text), 0) > 0 AS accepted FROM documents",
}
QUERIES = {name: globals()[name] for name in SQL}
