"""Tables that can be written, and why the others cannot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table_problems(cells: DataFrame) -> DataFrame:
    """cells (pkg_id, block, row, col, n_filled, grid_span, merged, nested, header) -> pkg_id, block, n_rows, n_cols, code.

    code names the first thing that keeps a table from being written: merged cells, nested tables, rows of
    different lengths, a header behind other rows, more than one filled paragraph in a cell; or null.
    """
    width = F.count(F.lit(1)).over(Window.partitionBy("pkg_id", "block", "row"))
    flagged = cells.withColumns({"_width": width, "_span": F.coalesce("grid_span", F.lit(1)) > 1})
    grouped = flagged.groupBy("pkg_id", "block").agg(
        (F.max("row") + 1).alias("n_rows"), F.max("_width").alias("n_cols"), F.min("_width").alias("_least"),
        F.bool_or(F.col("_span") | F.col("merged")).alias("_merged"), F.bool_or("nested").alias("_nested"),
        F.max(F.when(F.col("header"), F.col("row"))).alias("_head"), F.min(F.when(~F.col("header"), F.col("row"))).alias("_body"), F.max("n_filled").alias("_filled"),
    )
    code = F.when(F.col("_merged"), "merged_table_cells_not_serializable").when(F.col("_nested"), "nested_table_not_serializable").when(F.col("_least") < F.col("n_cols"), "irregular_table_not_serializable").when(F.col("_head") > F.col("_body"), "invalid_table_header_not_serializable").when(F.col("_filled") > 1, "multiple_paragraph_table_cell_not_serializable")
    return grouped.select("pkg_id", "block", F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"), code.alias("code"))
