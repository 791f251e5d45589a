"""JSON of any shape as tables: every value of a document with its path, by variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.plans.tables import Stash
from webloom.sources.api_pages import variant_path

#: Levels beyond which a document is not taken apart; its deeper parts stay JSON text.
DEPTH = 64


def at_path(value: Column, path: str, kind: str) -> Column:
    """What lies at a dotted path, as a type; null where a segment is missing or the value does not fit."""
    return F.try_variant_get(value, variant_path(path), kind)


def kind_of(value: Column) -> Column:
    """The type of a variant as one word: OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID and so on."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def flatten_json(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, path, type, value): a row for each scalar, empty container and null in each row's JSON.

    Paths are dotted keys and places in arrays, in the rows' own order; a scalar at the root has the path ''. Text that
    is no JSON gives no rows. Each level of nesting is one pass over the containers that the last one left; no document is
    held other than as the rows of its values.
    """
    stash = Stash(rows.sparkSession, "flatten")
    level = rows.select(*keys, F.lit("").alias("path"), F.try_parse_json(json).alias("node")).where("node is not null")
    found = None
    for depth in range(DEPTH + 1):
        level = stash.put(level.withColumn("type", kind_of(F.col("node"))), "level")
        text = F.to_json("node")
        inner = F.col("type").isin("OBJECT", "ARRAY") & ~text.isin("{}", "[]") & F.lit(depth < DEPTH)
        value = F.when(F.col("type") == "STRING", F.try_variant_get("node", "$", "string")).when(F.col("type") != "VOID", text)
        leaves = level.where(~inner).select(*keys, "path", "type", value.alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        opened = level.where(inner)
        if opened.isEmpty():
            return found
        name = f"flatten_{stash.root.rsplit('-', 1)[1]}"
        opened.createOrReplaceTempView(name)
        columns = ", ".join(f"t.`{k}`" for k in keys)
        step = "coalesce(e.key, cast(e.pos as string))"
        level = rows.sparkSession.sql(f"select {columns}, case when t.path = '' then {step} else concat(t.path, '.', {step}) end as path, e.value as node from {name} t, lateral variant_explode(t.node) e")
        rows.sparkSession.catalog.dropTempView(name)
    return found


def common_schema(rows: DataFrame, json: str, by: list[str] | None = None) -> DataFrame:
    """The merged schema of all documents, of each group if ``by`` names columns."""
    parsed = rows.select(*(by or []), F.try_parse_json(json).alias("node")).where("node is not null")
    return parsed.groupBy(*(by or [])).agg(F.schema_of_variant_agg("node").alias("schema"))
