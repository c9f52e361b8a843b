"""Full-text queries: `benchmark` words ask `documents`, page titles with typing errors ask `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import stems
from docspark.functions import text as T
from docspark.operators import fulltext as X
from docspark.operators import index
from docspark.session import kept, shared_folder, table
from docspark.sources.readers import read_version

#: Field boosts of fuzzy search.
BOOSTS = {"chunk_text": 3.0, "title": 2.0, "abstract": 1.0}


def _asks(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text's words as a query: two words, or a phrase and a word, without a third."""
    w = T.terms(F.col("text"))
    word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("none"))
    text = F.concat_ws(" ", word(1), word(2), F.lit("OR"), F.concat(F.lit('"'), word(4), F.lit(" "), word(5), F.lit('"')), word(7), F.concat(F.lit("-"), word(9)))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def stem_counts(spark: SparkSession, d: str) -> DataFrame:
    """The analysis chain over all documents: every stem with its documents, occurrences, forms and the sum of its positions."""
    rows = X.analysed(_docs(spark, d)).groupBy("stem")
    return rows.agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("n_forms"), F.sum("pos").alias("positions"))


def kw_cover_density(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_asks(spark, d), _docs(spark, d)).select("query_id", "doc_id", "score", "covers", "rank")


def kw_highlights(spark: SparkSession, d: str) -> DataFrame:
    """The best three documents of each query with their highlights, one string a document."""
    asks, docs = _asks(spark, d), _docs(spark, d)
    found = X.highlighted(X.search(asks, docs, 3), docs, asks)
    return found.select("query_id", "doc_id", "rank", F.array_join("highlights", " ... ").alias("highlights"))


def _fields(html: DataFrame) -> DataFrame:
    """Pages as three fields: the text, the title, and the text's first 200 characters."""
    title = T.html_to_text(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))
    text = T.html_to_text(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1))
    return html.select(F.col("page_id").alias("doc_id"), text.alias("chunk_text"), title.alias("title"), F.left(text, F.lit(200)).alias("abstract"))


def _typos(fields: DataFrame) -> DataFrame:
    """Titles as queries, every third page: of each word of five letters or more the fourth and third change places, or the third is missing."""
    def wrong(w):
        swapped = F.concat(F.substring(w, F.lit(1), F.lit(2)), F.substring(w, 4, 1), F.substring(w, 3, 1), F.substring(w, F.lit(5), F.length(w)))
        return F.when(F.length(w) < 5, w).when(F.length(w) % 2 == 0, swapped).otherwise(F.concat(F.left(w, F.lit(2)), F.substring(w, F.lit(4), F.length(w))))

    words = F.slice(T.terms(F.col("title")), 1, 3)
    return fields.select(F.col("doc_id").alias("query_id"), F.array_join(F.transform(words, wrong), " ").alias("text"))


def kw_fuzzy_boosted(spark: SparkSession, d: str) -> DataFrame:
    # pages dealt to all tasks and read once, whatever their files
    fields = kept(_fields(table(spark, d, "pages").repartition("page_id")))
    scores = X.fuzzy_scores(_typos(fields), fields, BOOSTS, 10)
    return X.top_k(scores, "score", 10).select("query_id", "doc_id", "score", "field", "rank")


def _short_asks(spark: SparkSession, d: str) -> DataFrame:
    """The second to fourth word of each benchmark text."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(T.terms(F.col("text")), 2, 3), " ").alias("text"))


def index_topk(spark: SparkSession, d: str) -> DataFrame:
    """An index of all documents is built, and searched through the bounds of its blocks."""
    folder = shared_folder(spark, "index")
    index.build(_docs(spark, d), folder, 1)
    hits, _ = index.search(_short_asks(spark, d), read_version(spark, folder, 1, ["postings"])["postings"])
    return hits.select("query_id", "doc_id", "score", "rank")


def index_probe(spark: SparkSession, d: str) -> DataFrame:
    """What a probe says of a folder before and after the index is built, and after a second build of the same version."""
    folder, rows = shared_folder(spark, "index"), []
    for state in ("none", "built", "built again"):
        made = state != "none" and index.build(_docs(spark, d), folder, 1)
        found = index.probe(spark, folder)
        rows.append((state, made, found["exists"], found["documents"], found["terms"]))
    return spark.createDataFrame(rows, "state string, made boolean, found boolean, documents long, terms long")


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _rules(table_name: str, rules) -> str:
    return f"{table_name}(suffix, repl, before) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in rules)})"


def _step(name: str, source: str, rules: str, region: str) -> str:
    """One table step as a join of words with the rules and the longest suffix of each."""
    cut = "length(w) - length(r.suffix)"
    return f"""{name}_r AS (SELECT term, arg_max({{'suffix': suffix, 'repl': repl, 'before': before}}, length(suffix)) AS r FROM {source} JOIN {rules} ON ends_with(w, suffix) GROUP BY term),
{name} AS (SELECT term, r1, r2, stop, CASE WHEN r IS NOT NULL AND {cut} >= {region} AND (r.before = '' OR contains(r.before, substr(w, {cut}, 1))) THEN left(w, {cut}) || r.repl ELSE w END AS w
  FROM {source} LEFT JOIN {name}_r USING (term))"""


def stems_sql(source: str) -> str:
    """CTEs that end in stems(term, stem) for the distinct terms of a table."""
    region = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
    whole = f"^({'|'.join(stems.WHOLE_PREFIXES)})"
    shorts = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
    special = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stems.SPECIAL.items())
    return f"""
z0 AS (SELECT DISTINCT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {source}),
z1 AS (SELECT *, CASE WHEN regexp_matches(w, '{whole}') THEN length(regexp_extract(w, '{whole}')) WHEN regexp_matches(w, '{region}') THEN length(regexp_extract(w, '{region}')) ELSE length(w) END AS r1 FROM z0),
z2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{region}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{region}')) ELSE length(w) END AS r2 FROM z1),
z3 AS (SELECT term, r1, r2, CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
  WHEN w LIKE '%us' OR w LIKE '%ss' THEN w WHEN regexp_matches(w, '[aeiouy].*[^s]s$') AND regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN w[:-2] ELSE w END AS w FROM z2),
z4 AS (SELECT *, w IN ({_list(stems.KEPT_AFTER_PLURAL)}) AS stop, regexp_extract(w, '(eedly|eed|ingly|edly|ing|ed)$') AS tail FROM z3),
z5 AS (SELECT *, CASE WHEN tail IN ('ingly', 'edly', 'ing', 'ed') AND regexp_matches(left(w, length(w) - length(tail)), '[aeiouy]') THEN left(w, length(w) - length(tail)) END AS d FROM z4),
z6 AS (SELECT term, r1, r2, CASE WHEN stop THEN w END AS stop, CASE WHEN d IS NULL THEN CASE WHEN tail LIKE 'eed%' AND length(w) - length(tail) >= r1 THEN left(w, length(w) - length(tail)) || 'ee' ELSE w END
  WHEN regexp_matches(d, '(at|bl|iz)$') THEN d || 'e' WHEN regexp_matches(d, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN d[:-2] WHEN regexp_matches(d, '{shorts}') AND r1 >= length(d) THEN d || 'e' ELSE d END AS w FROM z5),
z7 AS (SELECT term, r1, r2, stop, regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w FROM z6),
{_rules("rules2", stems.STEP_2)}, {_rules("rules3", [r for r in stems.STEP_3 if r[0] != "ative"])}, {_rules("rules4", stems.STEP_4)},
{_step("y2", "z7", "rules2", "r1")},
y3a AS (SELECT term, r1, r2, stop, CASE WHEN w LIKE '%ative' AND length(w) - 5 >= r2 THEN w[:-6] ELSE w END AS w FROM y2),
{_step("y3", "y3a", "rules3", "r1")},
{_step("y4", "y3", "rules4", "r2")},
y5 AS (SELECT term, stop, CASE WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(w[:-2], '{shorts}'))) THEN w[:-2] WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN w[:-2] ELSE w END AS w FROM y4),
stems AS (SELECT term, CASE WHEN length(term) <= 2 OR term IN ({_list(stems.KEPT)}) THEN term ELSE coalesce(CASE term {special} END, lower(coalesce(stop, w))) END AS stem FROM y5)"""


_STOP = f"term NOT IN ({_list(stems.STOP_WORDS)})"
_TOKENS = f"""
tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)),
kept AS (SELECT * FROM tok WHERE {_STOP})"""
_COVERS = f"""
bw AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
q0 AS (SELECT query_id, unnest([{{'grp': 0, 'element': 0, 'negated': false, 'pos': 0, 'i': 2}}, {{'grp': 0, 'element': 1, 'negated': false, 'pos': 0, 'i': 3}}, {{'grp': 1, 'element': 3, 'negated': false, 'pos': 0, 'i': 5}},
  {{'grp': 1, 'element': 3, 'negated': false, 'pos': 1, 'i': 6}}, {{'grp': 1, 'element': 4, 'negated': false, 'pos': 0, 'i': 8}}, {{'grp': 1, 'element': 5, 'negated': true, 'pos': 0, 'i': 10}}]) AS e, w FROM bw),
q1 AS (SELECT query_id, e.grp AS grp, e.element AS element, e.negated AS negated, e.pos AS pos, coalesce(w[e.i], 'none') AS term FROM q0),
q2 AS (SELECT * FROM q1 WHERE {_STOP}),
every AS (SELECT term FROM kept UNION SELECT term FROM q2),
{stems_sql("every")},
q AS (SELECT query_id, grp, element, negated, pos - min(pos) OVER (PARTITION BY query_id, grp, element) AS off, count(*) OVER (PARTITION BY query_id, grp, element) AS size, stem FROM q2 JOIN stems USING (term)),
occ AS (SELECT doc_id, pos, stem, term FROM kept JOIN stems USING (term) WHERE stem IN (SELECT stem FROM q)),
el AS (SELECT query_id, doc_id, grp, element, negated, pos - off AS p, max(pos) AS q FROM occ JOIN q USING (stem) GROUP BY ALL HAVING count(*) = any_value(size)),
ok AS (SELECT * FROM el WHERE NOT negated AND (query_id, doc_id, grp) NOT IN (SELECT (query_id, doc_id, grp) FROM el WHERE negated)),
need AS (SELECT query_id, grp, count(DISTINCT element) AS need FROM q WHERE NOT negated GROUP BY ALL),
newest AS (SELECT a.query_id, a.doc_id, a.grp, a.q, b.element, max(b.p) AS p FROM (SELECT DISTINCT query_id, doc_id, grp, q FROM ok) a JOIN ok b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.grp = b.grp AND b.q <= a.q GROUP BY ALL),
span AS (SELECT DISTINCT query_id, doc_id, p, q FROM (SELECT query_id, doc_id, grp, q, min(p) AS p, count(*) AS n FROM newest GROUP BY ALL) JOIN need USING (query_id, grp) WHERE n = need),
cover AS (SELECT * FROM span s WHERE NOT EXISTS (SELECT 1 FROM span o WHERE o.query_id = s.query_id AND o.doc_id = s.doc_id AND o.p >= s.p AND o.q <= s.q AND (o.p > s.p OR o.q < s.q))),
term_at AS (SELECT DISTINCT query_id, doc_id, pos FROM occ JOIN (SELECT DISTINCT query_id, stem FROM q WHERE NOT negated) USING (stem)),
dense AS (SELECT query_id, doc_id, p, q, count(*) AS entries FROM cover JOIN term_at USING (query_id, doc_id) WHERE pos BETWEEN p AND q GROUP BY ALL),
cd AS (SELECT query_id, doc_id, round(sum(0.1::DOUBLE / (1 + q - p + 1 - entries)), 9) AS score, count(*) AS covers FROM dense GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM cd)"""
_SPLIT = "[A-Za-z0-9]+|[^A-Za-z0-9]+"
_MARK = f"array_to_string(list_transform(regexp_extract_all({{0}}, '{_SPLIT}'), lambda t: CASE WHEN list_contains(words, lower(t)) THEN '<mark>' || t || '</mark>' ELSE t END), '')"
_TEXT = r"trim(regexp_replace({0}, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"


def _plain(html: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace({html}, '(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return _TEXT.replace("{0}", out)


_FUZZY = f"""
f AS (SELECT page_id AS doc_id, {_plain("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS chunk_text, {_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title FROM pages),
rows AS (SELECT doc_id, 'chunk_text' AS field, 3 AS boost, chunk_text AS text FROM f UNION ALL SELECT doc_id, 'title', 2, title FROM f UNION ALL SELECT doc_id, 'abstract', 1, left(chunk_text, 200) FROM f),
t AS (SELECT doc_id, field, boost, regexp_extract_all(lower(text), '[a-z0-9]+') AS terms FROM rows),
st AS (SELECT field, count(*) AS n_docs, avg(len(terms)) AS avg_dl FROM t GROUP BY ALL),
tf AS (SELECT doc_id, field, boost, len(any_value(terms)) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM t) GROUP BY doc_id, field, boost, term),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
q0 AS (SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')[:3]) AS w FROM f),
q AS (SELECT query_id, asked, count(*) AS times FROM (SELECT query_id, CASE WHEN length(w) < 5 THEN w WHEN length(w) % 2 = 0 THEN w[1:2] || w[4] || w[3] || w[5:] ELSE w[1:2] || w[4:] END AS asked FROM q0) GROUP BY ALL),
near AS (SELECT asked, term, damerau_levenshtein(asked, term) AS far, length(asked) AS n, CASE WHEN length(asked) < 3 THEN 0 WHEN length(asked) < 6 THEN 1 ELSE 2 END AS edits
  FROM (SELECT DISTINCT asked FROM q) JOIN (SELECT DISTINCT term FROM df) ON left(asked, 2) = left(term, 2) AND abs(length(asked) - length(term)) <= 2),
ex AS (SELECT asked, term, round(1 - far / least(n, length(term)), 9) AS likeness FROM near WHERE far <= edits QUALIFY row_number() OVER (PARTITION BY asked ORDER BY likeness DESC, term) <= 50),
wide AS (SELECT query_id, term, times * likeness AS weight FROM q JOIN ex USING (asked)),
s AS (SELECT query_id, doc_id, field, round(boost * sum(weight * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS score
  FROM wide JOIN tf USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY query_id, doc_id, field, boost),
b AS (SELECT query_id, doc_id, score, field FROM s QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, field) = 1)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM b) WHERE rank <= 10"""

_INDEXED = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(DISTINCT term) FROM tok) AS terms)"
SQL = {
    "index_topk": """
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')[2:4]) AS term FROM benchmark),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents),
st AS (SELECT count(*) AS n_docs, avg(coalesce(len(ts), 0)) AS avg_dl FROM t),
h AS (SELECT query_id, term, doc_id, len(ts) AS dl, len(list_filter(ts, lambda x: x = term)) AS tf FROM q JOIN t ON list_contains(ts, term)),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS score
  FROM h JOIN (SELECT query_id, term, count(*) AS df FROM h GROUP BY ALL) USING (query_id, term), st GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
    "index_probe": "WITH " + _INDEXED + " SELECT 'none' AS state, false AS made, false AS found, 0::BIGINT AS documents, 0::BIGINT AS terms UNION ALL SELECT 'built', true, true, docs, terms FROM n UNION ALL SELECT 'built again', false, true, docs, terms FROM n",
    "stem_counts": "WITH" + _TOKENS + "," + stems_sql("kept") + " SELECT stem, count(DISTINCT doc_id) AS n_docs, count(*) AS n, count(DISTINCT term) AS n_forms, sum(pos)::BIGINT AS positions FROM kept JOIN stems USING (term) GROUP BY stem",
    "kw_cover_density": "WITH" + _TOKENS + "," + _COVERS + " SELECT query_id, doc_id, score, covers, rank FROM rk WHERE rank <= 10",
    "kw_highlights": "WITH" + _TOKENS + "," + _COVERS + f""",
words AS (SELECT query_id, list(DISTINCT term) AS words FROM occ JOIN (SELECT DISTINCT query_id, stem FROM q WHERE NOT negated) USING (stem) GROUP BY ALL),
h AS (SELECT query_id, doc_id, rank, text, words, regexp_extract_all(text, '{_SPLIT}') AS pieces FROM rk JOIN documents USING (doc_id) JOIN words USING (query_id) WHERE rank <= 3),
p AS (SELECT query_id, doc_id, unnest(list_filter(list_transform(pieces, lambda t, i: CASE WHEN list_contains(words, lower(t)) THEN length(array_to_string(pieces[:i - 1], '')) END), lambda x: x IS NOT NULL)) AS start FROM h),
w AS (SELECT a.query_id, a.doc_id, a.start, count(*) AS w FROM p a JOIN p b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.start BETWEEN a.start AND a.start + 149 GROUP BY ALL),
c AS (SELECT query_id, doc_id, w AS total, start AS s1, NULL AS s2 FROM w UNION ALL SELECT a.query_id, a.doc_id, a.w + b.w, a.start, b.start FROM w a JOIN w b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.start >= a.start + 150),
best AS (SELECT query_id, doc_id, s1, s2 FROM c QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY total DESC, s1, s2 NULLS FIRST) = 1),
fr AS (SELECT query_id, doc_id, rank, words, unnest([s1, s2]) AS s, text FROM best JOIN h USING (query_id, doc_id)),
cut AS (SELECT *, substr(text, s + 1, 150) AS whole, CASE WHEN s + 150 < length(text) THEN regexp_replace(substr(text, s + 1, 150), '[A-Za-z0-9]+$', '') ELSE substr(text, s + 1, 150) END AS part FROM fr WHERE s IS NOT NULL)
SELECT query_id, doc_id, rank, string_agg(rtrim({_MARK.replace("{0}", "CASE WHEN part = '' THEN whole ELSE part END")}, ' '), ' ... ' ORDER BY s) AS highlights FROM cut GROUP BY ALL""",
    "kw_fuzzy_boosted": "WITH" + _FUZZY,
}
QUERIES = {name: globals()[name] for name in SQL}
