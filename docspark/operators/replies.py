"""Replies, requests and references as column expressions: lenient parsing of model output, repository names, text parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import text as T

REPLY = "struct<answer:string,sources:array<string>,confidence:string,citations:array<string>>"

#: The terms that a failed query rewrite appends, and the message of an unreadable verdict.
EXPANSION = "nuke vfx compositing documentation"
NO_VERDICT = "The research review did not return a valid verdict."


def _text_at(raw: Column, path: str) -> Column:
    """A string field of a JSON object; null for other types and for text that is no JSON."""
    value = F.try_variant_get(F.try_parse_json(raw), path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def _is_object(raw: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))


def structured_reply(raw: Column) -> Column:
    """struct(answer, confidence, parsed): the reply as JSON; else the outermost braces in it; else the text itself, with low confidence."""
    inner = F.regexp_substr(raw, F.lit(r"(?s)\{.*\}"))
    used = F.when(_text_at(raw, "$.answer").isNotNull(), raw).when(_text_at(inner, "$.answer").isNotNull(), inner)
    return F.struct(
        F.coalesce(_text_at(used, "$.answer"), raw).alias("answer"),
        F.when(used.isNull(), "low").otherwise(_text_at(used, "$.confidence")).alias("confidence"),
        F.when(used.isNull(), "text").when(used == raw, "whole").otherwise("part").alias("parsed"),
    )


def without_fence(raw: Column) -> Column:
    """A text inside a code fence, without the fence's first and last line."""
    t = F.trim(raw)
    inside = F.regexp_replace(F.regexp_replace(t, r"^[^\n]*\n", ""), r"\n[^\n]*$", "")
    return F.when(t.startswith("```") & t.endswith("```"), F.trim(inside)).otherwise(t)


def feedback(raw: Column) -> Column:
    """struct(status, feedback), or null unless the reply is an object with status pass or fail and some feedback."""
    body = without_fence(raw)
    status, said = _text_at(body, "$.status"), _text_at(body, "$.feedback")
    return F.when(status.isin("pass", "fail") & (said != ""), F.struct(status.alias("status"), said.alias("feedback")))


def review_input(raw: Column) -> Column:
    """struct(request, findings): the two text fields of a JSON object, else no request and the whole text as findings."""
    request, findings = _text_at(raw, "$.original_request"), _text_at(raw, "$.research_findings")
    both = request.isNotNull() & findings.isNotNull()
    return F.struct(F.when(both, request).alias("request"), F.when(both, findings).otherwise(raw).alias("findings"))


def verdict_pair(raw: Column) -> Column:
    """struct(passed, feedback) of a JSON verdict; an unreadable one has not passed."""
    good = _is_object(raw)
    return F.struct((good & F.coalesce(_text_at(raw, "$.status") == "pass", F.lit(False))).alias("passed"), F.when(good, F.coalesce(_text_at(raw, "$.feedback"), F.lit(""))).otherwise(NO_VERDICT).alias("feedback"))


TASK = "struct<result:struct<status:struct<state:string>,artifacts:array<struct<parts:array<struct<kind:string,text:string>>>>>>"


def first_artifact(raw: Column) -> Column:
    """struct(state, text): the first text part that is not empty, of a completed task only."""
    task = F.from_json(raw, TASK)["result"]
    parts = F.flatten(F.transform(task["artifacts"], lambda a: F.coalesce(a["parts"], F.array())))
    texts = F.filter(parts, lambda p: (p["kind"] == "text") & (p["text"] != ""))
    state = F.coalesce(task["status"]["state"], F.lit("an invalid response"))
    return F.struct(state.alias("state"), F.when(state == "completed", F.try_element_at(texts, F.lit(1))["text"]).alias("text"))


def _owner_and_name(path: Column) -> Column:
    """owner/name of a path of just these two parts, without `.git` and one slash at the end; else null."""
    parts = T.bound(F.split(F.regexp_replace(path, "/$", ""), "/"), lambda p: F.when(F.size(p) == 2, F.struct(p[0].alias("owner"), F.regexp_replace(p[1], r"(?i)(?<=.)\.git$", "").alias("name"))))
    return T.bound(parts, lambda p: F.when((p["owner"] != "") & (p["name"] != "") & ~F.concat(p["owner"], p["name"]).rlike(r"\s"), F.concat(p["owner"], F.lit("/"), p["name"])))


def repository(raw: Column, host: str = "github.com") -> Column:
    """owner/name of a repository reference (web address, SSH address or the short form); null for others.

    A web address loses its scheme, `www.`, query and fragment, and has to name the host; an SSH address starts with the host's user.
    The short form is all else that has two parts.
    """
    user, schemes = f"git@{host}:", ("https://", "http://")

    def path(c: Column) -> Column:
        """What stands behind the user or the host; null for other texts."""
        bare = c
        for scheme in schemes:
            bare = F.when(F.lower(c).startswith(scheme), F.substring(c, F.lit(len(scheme) + 1), F.length(c))).otherwise(bare)
        rest = T.bound(bare, lambda b: F.when(F.lower(F.substring_index(b, "/", 1)).isin(host, f"www.{host}"), F.substring(b, F.length(F.substring_index(b, "/", 1)) + 2, F.length(b))))
        return F.when(F.lower(c).startswith(user), F.substring(c, F.lit(len(user) + 1), F.length(c))).otherwise(F.substring_index(F.substring_index(rest, "#", 1), "?", 1))

    def short(c: Column) -> Column:
        return F.when(~c.contains(" ") & (F.size(F.split(c, "/")) == 2) & ~F.lower(c).startswith(user), _owner_and_name(c))

    return T.bound(F.trim(raw), lambda c: F.coalesce(_owner_and_name(path(c)), short(c)))


def cache_slug(repo: Column, sha: Column) -> Column:
    return F.concat(F.replace(F.lower(repo), F.lit("/"), F.lit("__")), F.lit("__"), F.left(sha, F.lit(12)))


def fragment(text: Column, words: int = 8) -> Column:
    """The first words (a letter, then letters, digits, low lines and hyphens) of a text."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_-]*)"), 1), 1, words), " ")


#: What an input is called without a name of its own.
IMAGE_INPUT, UNNAMED_INPUT = "image input", "unnamed input"


def input_name(connection: Column, description: Column) -> Column:
    """What a node's input is called: its connection, else what the description says."""
    name, some = F.trim(connection), fragment(description, 4)
    return F.when(F.lower(name) != "unnamed", F.concat(name, F.lit(" input"))).when(F.lower(description).contains("image"), IMAGE_INPUT).when(some != "", F.concat(some, F.lit(" input"))).otherwise(UNNAMED_INPUT)


def between(text: Column, start: str, stops: list[str]) -> Column:
    """What follows the first match of `start`, up to the earliest match of any stop; empty without a start. Case is ignored."""
    has, body = text.rlike(f"(?i){start}"), F.regexp_replace(text, f"(?is)^.*?{start}", "")
    stop = "|".join(stops) or r"\z"
    cut = F.when(body.rlike(f"(?i){stop}"), F.regexp_extract(body, f"(?is)^(.*?)(?:{stop})", 1)).otherwise(body)
    return F.when(has, F.trim(cut)).otherwise("")


def with_sources(report: Column, sources: Column) -> Column:
    """A report with its distinct sources as a list under a heading, in their first order."""
    own = F.array_distinct(F.filter(sources, lambda s: s.isNotNull() & (s != "")))
    tail = F.concat(F.lit("\n\n## Sources\n"), F.array_join(F.transform(own, lambda s: F.concat(F.lit("- "), s)), "\n"))
    return F.concat(F.trim(report), F.when(F.size(own) > 0, tail).otherwise(""))


def block_text(text: Column, content: Column) -> Column:
    return F.coalesce(text, content, F.lit(""))


def block_texts(blocks: Column) -> Column:
    """blocks: array<struct(phase, text)>: distinct texts of the final-answer phase, or of the others if it has none."""
    said = F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != "")
    first = F.filter(said, lambda b, i: F.array_position(F.transform(said, lambda x: x["text"]), b["text"]) == i + 1)
    final = F.filter(first, lambda b: F.coalesce(b["phase"] == "final_answer", F.lit(False)))
    return F.array_join(F.transform(F.when(F.size(final) > 0, final).otherwise(first), lambda b: b["text"]), "\n\n")


def skill(tool: Column, arguments: Column, names: tuple[str, ...] = ("office-hours", "autoplan", "ship")) -> Column:
    """The skill whose folder a tool call's arguments (map of text) name; only for file tools or skill files."""
    said = F.array_join(F.map_values(arguments), " ")
    low = F.lower(F.replace(said, F.lit("\\"), F.lit("/")))
    found = F.lit(None).cast("string")
    for n in reversed(names):
        found = F.when(low.contains(f"/{n}/"), n).otherwise(found)
    return F.when(tool.isin("read_file", "open_file") | said.contains("SKILL.md"), found)


def first_present(fields: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first of the keys that a map has with some text."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in keys])


def merged_map(left: Column, right: Column) -> Column:
    """Both maps' entries; the right one's win."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def rejected_at(entry_score: Column, exit_score: Column, least: int = 60) -> Column:
    return F.when(entry_score < least, "input").when(exit_score == 0, "output")


def unit(vector: Column) -> Column:
    """A vector at length 1; one of zeros stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def sections(html: Column) -> Column:
    """array<struct(title, html)> of a page's parts by second-level headings; the part before the first one is the overview. Empty without headings."""
    parts = F.split(html, r"(?i)<h2(?=[\s>])[^>]*>")
    own = F.transform(parts, lambda p, i: F.when(i == 0, F.struct(F.lit("Overview").alias("title"), p.alias("html"))).otherwise(F.struct(F.regexp_extract(p, r"(?is)^(.*?)</h2>", 1).alias("title"), F.regexp_replace(p, r"(?is)^.*?</h2>", "").alias("html"))))
    return F.when(F.size(parts) > 1, own).otherwise(F.array().cast("array<struct<title:string,html:string>>"))
