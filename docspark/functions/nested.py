"""Nested values: all leaves of JSON arguments of any depth, and encoding that never fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.session import kept


def safe_json(text: Column) -> Column:
    """A JSON text in one form (keys in order, no spaces); any other text as a JSON string, a null as `null`."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2))


def leaf_text(value: Column) -> Column:
    """A scalar as words have it: True, False and None, numbers and texts as they are."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(value.cast("string"))).otherwise(value.cast("string"))


def leaves(rows: DataFrame, ident: str, column: str) -> DataFrame:
    """ident, path (keys and positions down to it), leaf: every scalar in a column of JSON texts.

    A round opens all objects and lists of one depth at once, until none is left; the rounds are as many as the deepest value has
    levels. Keys come in order, as variants hold them. Empty objects and lists have no leaves; texts that are no JSON, and a null, are
    leaves themselves.
    """
    spark = rows.sparkSession
    value = F.coalesce(F.try_parse_json(column), F.try_parse_json(F.substring(F.to_json(F.array(column)), F.lit(2), F.length(F.to_json(F.array(column))) - 2)), F.parse_json(F.lit("null")))
    level = kept(rows.select(F.col(ident).alias("ident"), F.array().cast("array<string>").alias("path"), value.alias("value")))
    done = []
    while True:
        inner = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<")
        done.append(level.where(~inner).select("ident", "path", leaf_text(F.col("value")).alias("leaf")))
        opened = level.where(inner)
        if opened.isEmpty():
            break
        # positions are padded, so that paths sort as values stand
        level = kept(spark.sql("SELECT ident, concat(path, array(coalesce(e.key, lpad(e.pos, 9, '0')))) AS path, e.value AS value FROM {opened}, LATERAL variant_explode(value) AS e", opened=opened))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("ident", ident)


def flattened(rows: DataFrame, ident: str, column: str) -> DataFrame:
    """ident, text: the leaves of each row in their order, joined by spaces; rows without leaves have an empty text."""
    own = leaves(rows, ident, column).groupBy(ident).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "leaf"))), lambda x: x["leaf"]), " ").alias("text"))
    return rows.select(ident).join(own, ident, "left").select(ident, F.coalesce("text", F.lit("")).alias("text"))
