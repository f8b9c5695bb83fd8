"""Problem 2: lines that one source repeats on many of its pages.

A page is its stream of letters. A rolling hash over the last letters cuts the stream into content-defined chunks, which stay the same
wherever a passage stands, whatever its line breaks. Spark counts the distinct pages of each (source, chunk). A line survives as a
candidate if all chunks that lie in it are frequent in its source; candidates alone are counted exactly.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bloom, by_batch, source_of
from pagemill.llm.vectors import categories, codes_of, grams, mixed, parts_of, slices
from pagemill.session import written

WINDOW, ONE_IN = 4, 6
_TARGET = regex.compile(r"\]\([^()\s]*\)|\]\[[^\]\n]*\]|</?\p{L}[^<>\n]*>")


class Letters:
    """The letters of some texts in one array, with the page and line of each, and the chunks they fall into."""

    def __init__(self, texts: list[str]):
        clean = [_TARGET.sub("", t) if "](" in t or "<" in t else t for t in texts]
        codes = codes_of("\0".join(t.replace("\0", " ") for t in clean).lower() + "\0")
        at = np.flatnonzero(categories()[codes] <= 1)
        self.values = codes[at]
        page_end, breaks = codes == 0, (codes == 10) | (codes == 0)
        line = np.cumsum(breaks)
        self.page = np.searchsorted(np.flatnonzero(page_end), at)
        self.line = line[at]
        self.first_line = np.concatenate([[0], line[page_end]])  # of each page
        h = grams(self.values, WINDOW)
        cut = np.flatnonzero(h % np.uint64(ONE_IN) == 0) + WINDOW - 1  # a chunk ends with this letter
        a, b = cut[:-1], cut[1:]
        keep = self.page[a - WINDOW + 1] == self.page[b] if len(cut) > 1 else np.zeros(0, bool)
        self.begin, self.end = a[keep], b[keep]
        self.chunk = slices(self.values, self.begin + 1, self.end + 1)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the letters of every line that has any."""
        edge = np.flatnonzero(np.concatenate([[True], np.diff(self.line) != 0])) if len(self.line) else np.zeros(0, np.int64)
        return edge, np.append(edge[1:], len(self.line))


def _keys(source: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    return mixed(source.view(np.uint64) ^ chunk).view(np.int64)


def _count(c: dict) -> dict:
    source, texts = c["s"].to_numpy(), c["text"].to_pylist()
    keys, whose = [], []
    for a, b in parts_of(texts):
        x = Letters(texts[a:b])
        s = source[a:b][x.page[x.end]]
        k = _keys(s, x.chunk)
        _, one = np.unique(mixed(x.page[x.end]) ^ k.view(np.uint64), return_index=True)  # once per page
        keys.append(k[one])
        whose.append(s[one])
    k, s = np.concatenate(keys), np.concatenate(whose)
    k, first, n = np.unique(k, return_index=True, return_counts=True)
    return {"k": k, "s": s[first], "n": n.astype(np.int64)}


def _candidates(c: dict, frequent) -> dict:
    source, texts, key = c["s"].to_numpy(), c["text"].to_pylist(), c["key"]
    row, number, mark = [], [], []
    for a, b in parts_of(texts):
        x = Letters(texts[a:b])
        begin, end = x.lines()
        if not len(begin):
            continue
        known = frequent.value.holds(_keys(source[a:b][x.page[x.end]], x.chunk))
        left = x.begin - WINDOW + 1
        own = np.searchsorted(begin, left, "right") - 1
        inside = x.end < end[own]  # also the window that set the chunk's start lies in the line
        bad = np.zeros(len(begin), bool)
        bad[own[inside & ~known]] = True
        page = x.page[begin]
        good = np.flatnonzero(~bad)
        row.append(a + page[good])
        number.append(x.line[begin[good]] - x.first_line[page[good]] + 1)
        mark.append(slices(x.values, begin[good], end[good]).view(np.int64))
    join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    row, mark = join(row), join(mark)
    first = np.zeros(len(row), bool)  # a row counts a line once
    first[np.unique(mixed(row) ^ mark.view(np.uint64), return_index=True)[1]] = True
    return {"key": key.take(row), "s": source[row], "line_no": join(number).astype(np.int32), "h": mark, "first": first}


def repeated_lines(df: DataFrame, key: str, path: str, text: str, least_pages: int = 4, least_share: float = 0.1) -> DataFrame:
    """(key, line_no) of lines whose like stands on at least ``least_pages`` rows and ``least_share`` of all rows of their source.

    Lines are alike if their letters are, whatever their case, spacing, digits, punctuation, markup and link targets; lines without
    letters are never found. Rows with null or empty text count as rows of their source; a null path is no source.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.xxhash64(source_of(F.col(path))).alias("s"), F.col(text).alias("text")).filter(F.col(path).isNotNull())
    bar = rows.groupBy("s").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least_pages).select("s", F.greatest(F.lit(least_pages), F.ceil(F.col("rows") * least_share - 1e-9)).alias("bar"))
    bar = written(bar, "bars")
    full = rows.filter(F.length("text") > 0)
    counted = by_batch(full.select("s", "text"), "k bigint, s bigint, n bigint", _count)
    frequent = counted.groupBy("k", "s").agg(F.sum("n").alias("n")).join(bar, "s").filter("n >= bar").select(F.col("k").alias("h"))
    # a filter of bounded size: what it lets pass too much is counted in vain
    shared = spark.sparkContext.broadcast(bloom(written(frequent, "chunks")))
    found = written(by_batch(full, f"key {kind}, s bigint, line_no int, h bigint, first boolean", _candidates, shared), "candidates")
    exact = found.filter("first").groupBy("s", "h").agg(F.count("*").alias("n")).join(bar, "s").filter("n >= bar").select("s", "h")
    return found.join(exact, ["s", "h"], "left_semi").select(F.col("key").alias(key), "line_no")


def without_lines(df: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``df`` with the found lines cut out of ``text``; texts without a found line come out unchanged."""
    cut = found.groupBy(F.col(key).alias("_key")).agg(F.collect_set("line_no").alias("_cut"))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_cut", i + 1)), "\n")
    joined = df.join(cut, df[key] == F.col("_key"), "left")
    return joined.withColumn(text, F.when(F.col("_cut").isNull(), F.col(text)).otherwise(kept)).drop("_key", "_cut")
