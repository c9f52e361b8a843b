"""Privacy redaction, policy decisions and answer routes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entity types found by pattern, in the order of their redaction. Names of persons and places need a model and have an adapter only.
PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "CREDIT_CARD": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "IP_ADDRESS": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "PHONE_NUMBER": r"\+?[0-9]{1,3}[ .-][0-9]{2,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?\b",
}
PASS_SCORE = 60


#: What a text must hold for a pattern to be worth a search.
HINTS = {"EMAIL_ADDRESS": "@", "IP_ADDRESS": "."}


def _may(name: str, text: Column) -> Column:
    return text.contains(HINTS[name]) if name in HINTS else F.lit(True)


def redacted(text: Column) -> Column:
    for name, pattern in PATTERNS.items():
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def entity_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds `entities`, as entities() gives them. Every redaction is a column of its own and is made once, only where its type was found."""
    found, last = [], F.col(text)
    for i, (name, pattern) in enumerate(PATTERNS.items()):
        rows = rows.withColumn(f"_has{i}", _may(name, last) & last.rlike(pattern))
        rows = rows.withColumn(f"_text{i}", F.when(F.col(f"_has{i}"), F.regexp_replace(last, pattern, f"[{name}]")).otherwise(last))
        found.append(F.when(F.col(f"_has{i}"), name))
        last = F.col(f"_text{i}")
    n = len(PATTERNS)
    return rows.withColumn("entities", F.array_sort(F.array_compact(F.array(*found)))).drop(*[f"_has{i}" for i in range(n)], *[f"_text{i}" for i in range(n)])


def entities(text: Column) -> Column:
    """Sorted distinct entity types; each is looked for in what the ones before it left."""
    found = []
    for name, pattern in PATTERNS.items():
        found.append(F.when(text.rlike(pattern), name))
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return F.array_sort(F.array_compact(F.array(*found)))


def decision(changed: Column, redactor_failed: Column, unsafe: Column, classifier_failed: Column, closed_redactor: bool = False, closed_classifier: bool = True) -> Column:
    """Input decision: BLOCK, REDACT or ALLOW. A failed step blocks if it is closed, and is passed over if not."""
    return (
        F.when(redactor_failed & F.lit(closed_redactor), "BLOCK").when(classifier_failed & F.lit(closed_classifier), "BLOCK").when(~classifier_failed & unsafe, "BLOCK")
        .when(changed & ~redactor_failed, "REDACT").otherwise("ALLOW")
    )


def output_decision(unsafe: Column, failed: Column, closed: bool = False) -> Column:
    return F.when(failed, "BLOCK" if closed else "REVIEW").when(unsafe, "BLOCK").otherwise("ALLOW")


def score(action: Column) -> Column:
    return F.when(action.isin("ALLOW", "REDACT"), 100).when(action == "REVIEW", 50).otherwise(0)


def route(points: Column, at: int = PASS_SCORE) -> Column:
    return F.when(points >= at, "continue").otherwise("out_of_scope")


def verdict(raw: Column) -> tuple[Column, Column]:
    """(safe or unsafe or null, categories) of a classifier's reply: the verdict's line, then codes set apart by commas or spaces."""
    lines = F.split(F.trim(raw), "\n")
    first = F.lower(F.trim(lines[0]))
    rest = F.filter(F.split(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " "), "[, ]+"), lambda x: x != "")
    return F.when(first.isin("safe", "unsafe"), first), rest
