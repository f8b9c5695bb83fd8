"""From boxes, spans and font sizes to lines and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import filled, strip

#: Font size over the median from which a line is a heading of level 1, 2, 3. Fixed values.
LEVELS = (1.8, 1.4, 1.15)


def heading_thresholds(spans: DataFrame, page: str, size: str) -> DataFrame:
    """(page, h1, h2, h3): least font sizes of headings from the true median; null where sizes differ by less than a point."""
    g = spans.filter(F.col(size).isNotNull()).groupBy(page).agg(F.median(size).alias("m"), F.max(size).alias("x"))
    return g.select(page, *[F.when(F.col("x") - F.col("m") >= 1.0, F.round(F.col("m") * k, 6)).alias(f"h{i}") for i, k in enumerate(LEVELS, 1)])


def span_text(text: Column, flags: Column, uri: Column) -> Column:
    """A span with its emphasis (bit 4 bold, bit 1 italic) and link."""
    mark = F.concat(F.when(flags.bitwiseAND(2) != 0, "*").otherwise(""), F.when(flags.bitwiseAND(16) != 0, "**").otherwise(""))
    body = F.when(mark == "", text).otherwise(F.concat(mark, strip(text), mark))
    return F.when(uri.isNull(), body).otherwise(F.concat(F.lit("["), body, F.lit("]("), uri, F.lit(")")))


def line_text(spans: Column, size: Column, h: tuple[Column, Column, Column]) -> Column:
    """A line of span texts; a heading by its greatest font size loses the marks of emphasis."""
    body = strip(F.array_join(spans, " "))
    level = F.when(size >= h[0], "# ").when(size >= h[1], "## ").when(size >= h[2], "### ")
    return F.when((body == "") | level.isNull(), body).otherwise(F.concat(level, F.regexp_replace(body, r"\*{1,3}(.+?)\*{1,3}", "$1")))


def first_link(box: Column, links: Column) -> Column:
    """The uri of the first link whose box meets ``box``; null if none does."""
    meets = F.filter(links, lambda k: (k["x0"] < box["x1"]) & (k["x1"] > box["x0"]) & (k["y0"] < box["y1"]) & (k["y1"] > box["y0"]))
    return F.get(meets, F.lit(0))["uri"]


def outside(blocks: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (x_min, y_min, x_max, y_max) of a page that meet none of its rectangles (x0, y0, x1, y1)."""
    r = rects.select(*[F.col(k).alias(f"_{k}") for k in keys], "x0", "y0", "x1", "y1")
    same = [blocks[k] == F.col(f"_{k}") for k in keys]
    meets = (F.col("x0") < blocks["x_max"]) & (F.col("x1") > blocks["x_min"]) & (F.col("y0") < blocks["y_max"]) & (F.col("y1") > blocks["y_min"])
    cond = meets
    for s in same:
        cond = cond & s
    return blocks.join(r, cond, "left_anti")


def placeholders(elements: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Elements with ``place``: the mark of their image by page and count of images before them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0))
    return elements.withColumn("place", F.format_string("<!-- FPE_IMG:p%d_%d -->", F.col(keys[-1]), before))


_BOX = "struct<y:double,seq:bigint,x:double,y2:double,h:double,text:string>"


def line_numbers(boxes: Column) -> Column:
    """Boxes in order with the number of their line: a fold in which a box joins the line whose last box has its centre within half
    the line's mean height."""
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("centre"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        centre = (b["y"] + b["y2"]) / 2
        same = (s["line"] >= 0) & (F.abs(centre - s["centre"]) < 0.5 * s["sum"] / s["n"])
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        return F.struct(line.alias("line"), centre.alias("centre"), F.when(same, s["sum"] + b["h"]).otherwise(b["h"]).alias("sum"), F.when(same, s["n"] + 1).otherwise(1).alias("n"), F.array_append(s["out"], line).alias("out"))

    numbers = F.aggregate(boxes, start, step, lambda s: s["out"])  # only the numbers are carried along
    return F.zip_with(boxes, numbers, lambda b, n: F.struct(n.alias("line"), *[b[k].alias(k) for k in ("x", "y", "y2", "h", "text", "seq")]))


def text_lines(blocks: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(keys, line, y_min, y_max, height, text): text lines of every page. Blank and null texts are left out; a page without boxes gives none.

    A page's boxes are gathered: their number is bounded by the page, not by its source.
    """
    ok = blocks.withColumn("_t", strip(F.col("text"))).filter("_t <> ''")
    box = F.struct(F.col("y_min").alias("y"), F.col(seq).cast("bigint").alias("seq"), F.col("x_min").alias("x"), F.col("y_max").alias("y2"), (F.col("y_max") - F.col("y_min")).alias("h"), F.col("_t").alias("text"))
    pages = ok.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    flat = pages.select(*keys, F.inline(line_numbers(F.col("boxes"))))
    g = flat.groupBy(*keys, "line").agg(
        F.min("y").alias("y_min"), F.max("y2").alias("y_max"), F.avg("h").alias("height"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "seq", "text"))), lambda b: b["text"]), " ").alias("text"),
    )
    return g


def lines_markdown(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, markdown): headings by the upper median of the lines' heights, a blank line before a gap of over 1.5 medians."""
    order = Window.partitionBy(*keys).orderBy("y_min", "line")
    heights = F.array_sort(F.collect_list("height"))
    middle = lines.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.get(heights, F.floor(F.size(heights) / 2).cast("int")).alias("_m"))
    n = lines.join(middle, [lines[k].eqNullSafe(middle[f"_{k}"]) for k in keys]).drop(*[f"_{k}" for k in keys]).filter(strip(F.col("text")) != "")
    n = n.withColumns({"_t": strip(F.col("text")), "_gap": F.col("y_min") - F.lag("y_max").over(order), "_before": F.lag("y_max").over(order)})
    short = F.length("_t") < 100
    level = F.when(short & (F.col("height") >= F.col("_m") * LEVELS[0]), "# ").when(short & (F.col("height") >= F.col("_m") * LEVELS[1]), "## ").when(short & (F.col("height") >= F.col("_m") * LEVELS[2]), "### ").otherwise("")
    body = F.concat(F.when((F.col("_before") > 0) & (F.col("_gap") > 1.5 * F.col("_m")), "\n").otherwise(""), level, F.col("_t"))
    return n.withColumn("_b", body).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y_min", "line", "_b"))), lambda x: x["_b"]), "\n").alias("markdown"))


def resized(width: Column, height: Column, most: int = 4096) -> tuple[Column, Column]:
    """Width and height that fit ``most``, cut to whole pixels; images within it stay as they are."""
    longest = F.greatest(width, height)
    fit = lambda v: F.when(longest > most, F.floor(v * most / longest)).otherwise(v).cast("int")
    return fit(width), fit(height)
