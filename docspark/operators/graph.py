"""Knowledge-graph edges: validation and merge, one-hop neighbours, entity names in queries, sentences, triples from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators.replies import between, fragment, input_name

#: Node labels, predicates and the words that hint at relations.
ENTITY_TYPES = ("NukeNode", "Knob", "InputType", "OutputType", "Category", "Operation", "Channel", "SupportedValue")
PREDICATES = ("HAS_KNOB", "KNOB_CONTROLS", "ACCEPTS_INPUT", "OUTPUTS", "BELONGS_TO", "AFFECTS_CHANNEL", "SUPPORTS_VALUE", "SIMILAR_TO")
CUES = ("accept", "input", "output", "knob", "controls", "selects", "channels", "supports", "similar", "operation", "category")
COLUMNS = ["subject_name", "subject_type", "predicate", "object_name", "object_type"]


def valid(triples: DataFrame) -> DataFrame:
    named = (F.trim("subject_name") != "") & (F.trim("object_name") != "")
    return triples.where(F.col("subject_type").isin(*ENTITY_TYPES) & F.col("object_type").isin(*ENTITY_TYPES) & F.col("predicate").isin(*PREDICATES) & named)


def merge(triples: DataFrame) -> DataFrame:
    """Valid triples, each once."""
    return valid(triples).select(*COLUMNS).distinct()


def spread(rows: DataFrame) -> DataFrame:
    """Each row once, dealt by its values to as many tasks as a shuffle has: a small file of many rows is read in one or two."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *rows.columns).distinct()


def first_places(triples: DataFrame) -> DataFrame:
    """Each spelling of a triple once, with its first `pos`: from hash tables, so that no repeats are left to sort."""
    return triples.groupBy(*COLUMNS).agg(F.min("pos").alias("pos"))


def dedup_case(triples: DataFrame, order: list[str]) -> DataFrame:
    """One of each triple, the first spelling: names are compared in lower case, types and predicate as they are."""
    key = Window.partitionBy(F.lower("subject_name"), "subject_type", "predicate", F.lower("object_name"), "object_type").orderBy(*order)
    return triples.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def neighbours(triples: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """name, predicate, neighbour in both directions, at most `limit` a name in total order."""
    ahead = triples.select(F.col("subject_name").alias("name"), "predicate", F.col("object_name").alias("neighbour"))
    back = triples.select(F.col("object_name").alias("name"), "predicate", F.col("subject_name").alias("neighbour"))
    found = ahead.unionByName(back).join(entities.select("name").distinct(), "name", "left_semi").distinct()
    order = Window.partitionBy("name").orderBy("predicate", "neighbour")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def longest_entity(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, name: the longest known name inside the query, case aside; ties by name. The dictionary side is checked small."""
    few = F.broadcast(names) if names.limit(100_001).count() <= 100_000 else names
    hits = queries.join(few, F.expr("instr(lower(text), lower(name)) > 0"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("name")), "name")
    return hits.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", "name")


def sentence(name: Column, predicate: Column, neighbour: Column) -> Column:
    return F.concat(name, F.lit(" "), F.lower(F.replace(predicate, F.lit("_"), F.lit(" "))), F.lit(" "), neighbour, F.lit("."))


def has_cue(text: Column) -> Column:
    """Any relation word in the first 3000 characters: the gate before a model is asked."""
    head = F.lower(F.left(text, F.lit(3000)))
    return F.exists(F.array(*map(F.lit, CUES)), lambda c: F.contains(head, c))


#: A row of a controls table: label, knob name, default and what it does, set apart by bars.
CONTROL = r"(?m)^\s*([^|\n]+?)\s*\|\s*([A-Za-z][A-Za-z0-9_]*|N/A)\s*\|\s*([^|\n]*?)\s*\|\s*([^|\n]+?)\s*$"


def control_triples(pages: DataFrame) -> DataFrame:
    """Triples of the control rows in a page's text: HAS_KNOB and KNOB_CONTROLS, AFFECTS_CHANNEL where channels are named, and
    BELONGS_TO the page's section where it has rows and a section.

    pages: name, section, text. A knob N/A goes by its label; the knob `tab` is none. An operation is named by the first nine
    words of what the knob does. Each triple stands once, names compared without case.
    """
    groups = [F.regexp_extract_all("text", F.lit(CONTROL), i) for i in (1, 2, 4)]
    # outer, as what a plain one infers would be searched for before the rows are dealt; the filter drops its null rows
    rows = spread(pages.select("name", "section", "text")).select("name", "section", F.posexplode_outer(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("label", "knob", "what"), strict=True)])).alias("pos", "r"))
    knob = F.when(F.upper("r.knob") == "N/A", F.col("r.label")).otherwise(F.col("r.knob"))
    rows = rows.where("name <> '' and lower(r.knob) not in ('tab', 'knob')").select("name", "section", "pos", knob.alias("knob"), F.col("r.what").alias("what"))
    operation = F.coalesce(F.nullif(fragment(F.col("what"), 9), F.lit("")), F.lit("documented behavior"))

    def triple(s: Column, st: str, p: str, o: Column, ot: str) -> Column:
        return F.struct(s.alias("subject_name"), F.lit(st).alias("subject_type"), F.lit(p).alias("predicate"), o.alias("object_name"), F.lit(ot).alias("object_type"))

    made = F.array_compact(F.array(
        F.when(F.col("section") != "", triple(F.col("name"), "NukeNode", "BELONGS_TO", F.col("section"), "Category")),
        triple(F.col("name"), "NukeNode", "HAS_KNOB", F.col("knob"), "Knob"), triple(F.col("knob"), "Knob", "KNOB_CONTROLS", operation, "Operation"),
        F.when(F.lower("what").contains("channel"), triple(F.col("knob"), "Knob", "AFFECTS_CHANNEL", F.lit("image channels"), "Channel"))))
    triples = rows.select("pos", F.explode_outer(made).alias("t")).select("pos", "t.*")
    return dedup_case(first_places(triples), ["pos", *COLUMNS]).select(*COLUMNS)


#: The heading of a page's table of inputs, what ends the table, the words that a description opens with, and names that are no input.
INPUT_HEADING = r"Inputs and Controls\s+Connection Type\s+Connection Name\s+Function"
INPUT_ENDS = [r"Control \(UI\)", r"Can't find what you're looking for\?", r"Nuke \d"]
OPENERS = ("The", "An", "A", "By default", "Optional", "Required", "This", "If", "When")
NO_INPUTS = ("function", "input", "output")
#: Most characters of a connection's name.
NAME = "[A-Za-z][A-Za-z0-9_ -]{0,40}?"


def input_triples(pages: DataFrame) -> DataFrame:
    """ACCEPTS_INPUT triples of the rows in a page's table of inputs; pages: name, text.

    A row begins where the table or a sentence does: with `Input`, a name and a description, or with a name of one word and a
    description. A labelled row's description goes up to the next `Input` or `Output`, another one's up to whatever could be a row.
    What an input is called is told by its name, or by its description where it is unnamed. Each triple stands once.
    """
    opener = f"(?:{'|'.join(OPENERS)})\\b"
    table = F.regexp_replace(between(F.col("text"), INPUT_HEADING, INPUT_ENDS), r"\s+", " ")
    rows = spread(pages.select("name", "text")).select("name", F.split(table, r"(?<=\.) ").alias("parts")).select("name", "parts", F.posexplode_outer("parts").alias("pos", "part"))
    # a row's text goes on over the sentences behind it
    rest = F.array_join(F.slice("parts", F.col("pos") + 1, F.size("parts")), " ")
    labelled = f"(?i)^Input ({NAME}) {opener}"
    single = f"(?i)^([A-Za-z_][A-Za-z0-9_]*) {opener}"
    first = T.bound(F.regexp_extract("part", labelled, 1), lambda n: F.struct(n.alias("name"), F.regexp_extract(rest, f"(?i)^Input {NAME} ({opener}.*?)(?= Input | Output |$)", 1).alias("says")))
    other = T.bound(F.regexp_extract("part", single, 1), lambda n: F.struct(n.alias("name"), F.regexp_extract(rest, f"(?i)^[A-Za-z_][A-Za-z0-9_]* ({opener}.*?)(?= {NAME} {opener}|$)", 1).alias("says")))
    found = rows.select("name", "pos", F.when(F.col("part").rlike(labelled), first).when(F.col("part").rlike(single), other).alias("row"))
    found = found.where((F.col("name") != "") & F.col("row").isNotNull() & ~F.lower("row.name").isin(*NO_INPUTS))
    triples = found.select("pos", F.col("name").alias("subject_name"), F.lit("NukeNode").alias("subject_type"), F.lit("ACCEPTS_INPUT").alias("predicate"), input_name(F.col("row.name"), F.col("row.says")).alias("object_name"), F.lit("InputType").alias("object_type"))
    return dedup_case(first_places(triples), ["pos", *COLUMNS]).select(*COLUMNS)
