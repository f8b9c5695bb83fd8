"""Links, pictures and descriptions put into the Markdown of pages.

A page's links, pictures and elements are gathered per page, which bounds them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import filled

_ANY_LINK = re.compile(r"\[([^\]]+)\]\([^)]+\)")
_LEFT, _RIGHT = frozenset(" \n\t([*"), frozenset(" \n\t.,;:!?)]*")


def linked(text: str, links: list[tuple[str, str]]) -> str:
    """``text`` with the given links (anchor, uri) in place of any it had; anchors may lack their first letters."""
    text = _ANY_LINK.sub(r"\1", text)
    for anchor, uri in links:
        if len(anchor) < 2:
            continue
        tries = [anchor, *(anchor[k:] for k in range(1, min(4, len(anchor) // 2)) if len(anchor) - k >= 3)]
        hit = next(((at, len(t)) for t in tries if (at := text.find(t)) >= 0), None)
        if hit is None:
            continue
        begin, end = hit[0], sum(hit)
        begin = next((i for i in range(begin, 0, -1) if text[i - 1] in _LEFT), 0)
        end = next((i for i in range(end, len(text)) if text[i] in _RIGHT), len(text))
        text = f"{text[:begin]}[{text[begin:end]}]({uri}){text[end:]}"
    return text


def with_links(pages: DataFrame, links: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Pages with their links (keys, ord, anchor, uri); pages without any stay as they are, null texts too."""
    per = links.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "anchor", "uri"))), lambda k: F.struct(k["anchor"].alias("anchor"), k["uri"].alias("uri"))).alias("_links"))

    @F.pandas_udf("string")
    def put(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else linked(x, [(a["anchor"] or "", a["uri"]) for a in y]) for x, y in zip(t, k)])

    both = pages.join(per, keys, "left")
    have = both.filter(F.col("_links").isNotNull()).withColumn(text, put(F.col(text), F.col("_links")))
    return have.union(both.filter(F.col("_links").isNull())).drop("_links")


#: Marks of pictures' places with their picture line, and figures with or without a number. Fixed values.
FAST = r"<!-- FPE_IMG:p\d+_\d+ -->\s*\n*!\[.*?\]\(image\)"
FIGURE = r"!\[([^\]]*)\]\(figure(?:_(\d+))?\)"
PAGE_HEIGHT = 842.0


def _woven(text: Column, pattern: str, marks: Column, put: Callable[[Column], Column]) -> Column:
    """``text`` with ``put(i)`` in place of its i-th match, or the match itself where that is null."""
    piece = lambda x, i: F.concat(x, F.when(i < F.size(marks), F.coalesce(put(i), F.get(marks, i))).otherwise(""))
    return F.array_join(F.transform(F.split(text, pattern, -1), piece), "")


def with_pictures(pages: DataFrame, pictures: DataFrame, keys: list[str], text: str, path: str = "path") -> DataFrame:
    """Pages with the paths of their exported pictures (keys, ord, y, path): at the marks of their places, else at the numbered figures, else at the
    plain figures in order, else before the lines at their heights. All is said in column functions."""
    per = pictures.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("y").cast("double").alias("y"), F.col(path).alias("path")))).alias("_p"))
    both = pages.join(per, keys, "left")
    t, p = F.col(text), F.col("_p")
    shown = lambda label, i: F.concat(F.lit("!["), label, F.lit("]("), F.get(p, i)["path"], F.lit(")"))
    marks = F.regexp_extract_all(t, F.lit(FAST), F.lit(0))
    placed = _woven(t, FAST, marks, lambda i: shown(F.lit("Image"), i))
    figures, labels, numbers = (F.regexp_extract_all(t, F.lit(FIGURE), F.lit(k)) for k in (0, 1, 2))
    number = lambda x: x.try_cast("int")
    numbered = F.exists(numbers, lambda x: F.coalesce(number(x) < F.size(p), F.lit(False)))
    before = lambda i: F.size(F.filter(F.slice(numbers, F.lit(1), i + 1), lambda x: x == "")) - 1
    which = lambda i: F.when(numbered, number(F.get(numbers, i))).when(F.get(numbers, i) == "", before(i))
    figured = _woven(t, FIGURE, figures, lambda i: shown(F.get(labels, i), which(i)))
    lines = F.split(t, "\n", -1)
    line = lambda q: F.greatest(F.lit(0), F.least((q["y"] / (F.lit(PAGE_HEIGHT) / F.size(lines))).cast("int"), F.size(lines) - 1))
    put = lambda x, i: F.concat(F.transform(F.filter(p, lambda q: line(q) == i), lambda q: F.concat(F.lit("\n![Image]("), q["path"], F.lit(")\n"))), F.array(x))
    by_height = F.array_join(F.flatten(F.transform(lines, put)), "\n")
    return both.withColumn(text, F.when(p.isNull() | t.isNull(), t).when(F.size(marks) > 0, placed).when(figured != t, figured).otherwise(by_height)).drop("_p")


def described(pages: DataFrame, elements: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Pages with the marks of their pictures' places filled by the elements' descriptions (keys, ord, place, description), natively.

    A mark followed by its picture line goes with it; elements without description leave their mark.
    """
    ok = elements.filter((filled(F.col("description")) != "") & (filled(F.col("place")) != ""))
    per = ok.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "place", "description"))).alias("_e"))
    full = lambda t, e: F.replace(F.replace(t, F.concat(e["place"], F.lit("\n\n![Image](image)")), e["description"]), e["place"], e["description"])
    both = pages.join(per, keys, "left")
    return both.withColumn(text, F.when(F.col("_e").isNull(), F.col(text)).otherwise(F.aggregate("_e", F.col(text), full))).drop("_e")
