"""Items of a paginated JSON API, from stored response pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def variant_path(path: str) -> str:
    """A dotted path as a variant path; segments of digits index arrays."""
    return "$" + "".join(f"[{s}]" if s.isdigit() else f'["{s}"]' for s in path.split("."))


def collect_items(pages: DataFrame, page_size: int = 20, results_path: str = "", total_path: str = "", max_items: int | None = None, max_pages: int = 10) -> tuple[DataFrame, DataFrame]:
    """(items, summary) of response pages (api, page_no, status, body), each API's pages from 0 on.

    Reading an API stops after the page that reaches the total, then the item bound (which cuts nothing off),
    then at a short or empty page; or at ``max_pages``. A failed, missing or unreadable page stops it with a
    warning and keeps what came before. Without a path, a root that is no array is one item and the end.
    """
    body = F.try_parse_json("body")
    found = F.try_variant_get(body, variant_path(results_path), "array<variant>") if results_path else F.try_variant_get(body, "$", "array<variant>")
    is_list = F.schema_of_variant(body).startswith("ARRAY") if not results_path else F.lit(True)
    single = F.lit(False) if results_path else body.isNotNull() & ~is_list
    total = F.try_variant_get(body, variant_path(total_path), "double") if total_path else F.lit(None).cast("double")
    read = pages.where(F.col("page_no") < max_pages).select(
        "api", "page_no",
        F.when(F.col("status") == 0, "network error").when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(body.isNull(), "no JSON").when(~single & found.isNull(), "no array at the path").alias("warning"),
        F.when(single, F.array(body)).otherwise(found).alias("items"), single.alias("single"), total.alias("total"),
    )
    inside = Window.partitionBy("api").orderBy("page_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.when(F.col("warning").isNull(), F.size("items")), F.lit(0))
    counted = read.withColumn("n", n).withColumn("so_far", F.sum("n").over(upto)).withColumn("at", F.row_number().over(inside) - 1)
    natural = F.col("single") | F.coalesce(F.col("so_far") >= F.col("total"), F.lit(False))
    bounded = F.lit(False) if max_items is None else F.col("so_far") >= max_items
    end = (
        F.when(F.col("warning").isNotNull(), "warning").when(F.col("at") != F.col("page_no"), "gap")
        .when(natural, "natural").when(bounded, "bound").when(F.col("n") < page_size, "natural")
    )
    ended = counted.withColumn("end", end)
    live = ended.withColumn("done", F.coalesce(F.max(F.col("end").isNotNull().cast("int")).over(before), F.lit(0))).where("done = 0")
    good = live.where("end is null or end not in ('warning', 'gap')")
    items = good.select("api", "page_no", F.posexplode("items").alias("pos", "item")).withColumn("item", F.to_json("item"))
    summary = live.groupBy("api").agg(
        F.count_if(F.coalesce(F.col("end"), F.lit("")).isin("", "natural", "bound")).alias("pages_fetched"),
        F.sum(F.when(F.coalesce(F.col("end"), F.lit("")).isin("", "natural", "bound"), F.col("n")).otherwise(0)).alias("items_collected"),
        F.coalesce(F.bool_or(F.col("end") == "natural"), F.lit(False)).alias("natural_end"), F.max("warning").alias("warning"),
    )
    return items, summary
