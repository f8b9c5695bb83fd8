"""Grids of cells and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import filled, is_blank, strip

#: Spreadsheet functions and what their notes call them. Fixed values.
FORMULAS = {
    "SUM": "sum", "AVERAGE": "avg", "COUNT": "count", "MAX": "max", "MIN": "min", "VLOOKUP": "lookup", "HLOOKUP": "lookup",
    "IF": "conditional", "SUMIF": "conditional sum", "COUNTIF": "conditional count", "INDEX": "index", "MATCH": "match",
}


def row_text(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, filled), " | "), F.lit(" |"))


def padded(cells: Column, width: Column) -> Column:
    return F.concat(F.transform(cells, filled), F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)).cast("int")))


def table_text(rows: Column, title: Column | None = None, width: Column | None = None) -> Column:
    """Markdown of a grid (array of cell arrays); the first row is the header. Ragged rows are padded; no rows give ''.

    With ``width`` every row is padded and cut to it. Null cells are empty.
    """
    wide = F.array_max(F.transform(rows, lambda r: F.size(r))) if width is None else width
    even = F.transform(rows, lambda r: F.slice(padded(r, wide), F.lit(1), F.greatest(wide, F.lit(1)).cast("int")))
    rule = row_text(F.array_repeat(F.lit("---"), wide.cast("int")))
    lines = F.concat(F.array(row_text(even[0]), rule), F.transform(F.slice(even, F.lit(2), F.greatest(F.size(even) - 1, F.lit(0))), row_text))
    body = F.array_join(lines, "\n")
    if title is not None:
        body = F.concat(F.when(filled(title) != "", F.concat(F.lit("## "), title, F.lit("\n\n"))).otherwise(""), body)
    return F.when(F.size(rows) > 0, body).otherwise("")


def fixed_width_table(rows: Column) -> Column:
    """A grid whose header sets the width: line feeds in cells become blanks, cells are stripped, longer rows are cut."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.replace(filled(c), F.lit("\n"), F.lit(" ")))))
    return table_text(clean, width=F.size(rows[0]))


def ragged_table(rows: Column) -> Column:
    """A grid whose rows stay as long as they are."""
    lines = F.concat(F.array(row_text(rows[0]), row_text(F.array_repeat(F.lit("---"), F.size(rows[0])))), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), row_text))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise("")


def blank_row(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: ~is_blank(c))


def category_row(cells: Column, width: Column) -> Column:
    """A heading within a grid: its first cell is filled, at most one other is, and the grid has more than two columns."""
    rest = F.filter(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: ~is_blank(c))
    return (F.size(cells) > 0) & ~is_blank(cells[0]) & (F.size(rest) <= 1) & (width > 2)


def split_sheets(rows: DataFrame, sheet: str, order: str, cells: str, most: int = 50) -> DataFrame:
    """(sheet, chunk_no, markdown): sheets over ``most`` rows cut before each category row but the first data row.

    The first row of a sheet is its header and opens every chunk. A chunk after the first that opens with a category row is titled
    "sheet — category". One sheet is one window: its rows stay together.
    """
    w = Window.partitionBy(sheet).orderBy(order)
    every = Window.partitionBy(sheet)
    n = rows.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(every), "_w": F.max(F.size(cells)).over(every)})
    head = F.first(cells).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cut = (F.col("_n") > most) & (F.col("_i") > 2) & category_row(F.col(cells), F.col("_w"))
    n = n.withColumns({"_head": head, "_chunk": F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_cut": cut})
    data = n.filter("_i > 1").groupBy(sheet, F.col("_chunk").alias("chunk_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(cells).alias("c")))), lambda r: r["c"]).alias("_rows"),
        F.first("_head").alias("_head"),
        F.max(F.when(F.col("_cut"), F.col(cells)[0])).alias("_name"),
    )
    title = F.when(F.col("_name").isNull(), F.col(sheet)).otherwise(F.concat(F.col(sheet), F.lit(" — "), strip(F.col("_name"))))
    return data.select(sheet, "chunk_no", table_text(F.concat(F.array("_head"), F.col("_rows")), title).alias("markdown"))


def formula_note(formula: Column) -> Column:
    """A comment that names a formula's function; '' for anything that is no formula, null included."""
    name = F.regexp_extract(F.upper(strip(F.substring(formula, 2, 1 << 30))), r"\A([A-Z]+)\(", 1)
    labels = F.create_map(*[F.lit(x) for kv in FORMULAS.items() for x in kv])
    return F.when(F.startswith(filled(formula), F.lit("=")), F.concat(F.lit(" <!-- "), F.coalesce(F.try_element_at(labels, name), F.lit("formula")), F.lit(": "), formula, F.lit(" -->"))).otherwise("")


def merged_cells(cells: DataFrame, ranges: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Cells (sheet, row, col, value) with the value of the merged range (sheet, ord, r1, c1, r2, c2, value) that covers them.

    Of several ranges the last by ``ord`` counts. Ranges are opened into rows, so the join is an equality of sheet and row
    with a check of the columns; null values are ''.
    """
    rows = ranges.select(F.col(sheet).alias("_s"), "ord", F.explode(F.sequence("r1", "r2")).alias("_r"), "c1", "c2", F.col("value").alias("_v"))
    hit = cells.join(rows, (cells[sheet] == F.col("_s")) & (cells["row"] == F.col("_r")) & cells["col"].between(F.col("c1"), F.col("c2")), "left")
    best = F.max_by(F.struct(filled(F.col("_v")).alias("v")), "ord")
    return hit.groupBy(sheet, "row", "col", filled(cells["value"]).alias("own")).agg(best.alias("b")).select(sheet, "row", "col", F.coalesce("b.v", "own").alias("value"))
