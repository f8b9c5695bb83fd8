"""Pages to documents: ordering, page tags, tables that run over pages, reports and chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import clean_markdown, filled, strip

RULE = "\n\n---\n\n"


def _ordered(text: Column, *order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda p: p["_t"])


def joined_pages(pages: DataFrame, doc: str, order: list[str], text: str, separator: str = RULE) -> DataFrame:
    """(doc, markdown): cleaned non-blank pages in order. Documents whose pages are all blank or null give no row."""
    ok = pages.filter(strip(F.col(text)) != "")
    return ok.groupBy(doc).agg(F.array_join(_ordered(clean_markdown(F.col(text)), *order), separator).alias("markdown"))


def assembled(pages: DataFrame, doc: str, number: str, text: str, tie: str, page_tags: bool = False, merge: bool = True) -> DataFrame:
    """(doc, markdown): stripped non-blank pages in order, with page tags or rules between, tables over page breaks merged.

    Documents in which no table can run on (no marker, and no page that ends in a row before one that begins with one) never reach Python.
    """
    body = strip(F.col(text))
    ok = pages.withColumn("_b", body).filter("_b <> ''")
    part = F.concat(F.lit("<!-- page:"), F.col(number).cast("string"), F.lit(" -->\n"), F.col("_b")) if page_tags else F.col("_b")
    separator = "\n\n" if page_tags else RULE
    docs = ok.groupBy(doc).agg(_ordered(part, number, tie).alias("parts"))
    if not merge:
        return docs.select(doc, F.array_join("parts", separator).alias("markdown"))
    runs_on = F.exists(F.col("parts"), lambda p: p.contains("TABLE_CONTINUE")) | (F.exists(F.col("parts"), lambda p: p.endswith("|")) & F.exists(F.col("parts"), lambda p: p.startswith("|")))
    runs_on = runs_on & (F.size("parts") > 1)

    @F.pandas_udf("string")
    def fold(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: separator.join(x for x in merged_pages(list(p)) if x.strip()))

    plain = docs.filter(~runs_on).select(doc, F.array_join("parts", separator).alias("markdown"))
    return plain.union(docs.filter(runs_on).select(doc, fold("parts").alias("markdown")))


_MARK = {k: re.compile(rf"<!--\s*TABLE_{k}\s*:\s*columns\s*=\s*(\d+)\s*-->") for k in ("CONTINUES", "CONTINUED")}
_IS_ROW, _IS_RULE = re.compile(r"\|.+\|"), re.compile(r"\|[\s\-:|]+\|")


class _Seam:
    """The boundary of two pages: what of the second belongs to a table of the first."""

    def __init__(self, upper: str, lower: str):
        self.upper, self.lower = upper, lower
        self.sends, self.takes = _MARK["CONTINUES"].search(upper), _MARK["CONTINUED"].search(lower)

    @staticmethod
    def _row(line: str) -> bool:
        return _IS_ROW.fullmatch(line.strip()) is not None

    @classmethod
    def _run(cls, lines: list[str]) -> int:
        """How many lines at the start are a table, with blank lines before it; 0 if other text comes first."""
        at = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
        end = at
        while end < len(lines) and cls._row(lines[end]):
            end += 1
        return end if end > at else 0

    @staticmethod
    def _headless(rows: list[str]) -> list[str]:
        """Rows without a repeated header, told by its rule alone."""
        for skip in (2, 1):
            if len(rows) > 1 and _IS_RULE.fullmatch(rows[skip - 1].strip()):
                return rows[skip:]
        return rows

    def join(self) -> tuple[str, str] | None:
        if self.sends and self.takes and int(self.sends[1]) != int(self.takes[1]):
            return None
        return self._by_marks() if self.sends or self.takes else self._by_shape()

    def _by_marks(self) -> tuple[str, str]:
        top = (self.upper[: self.sends.start()] if self.sends else self.upper).rstrip()
        lines = (self.lower[self.takes.end() :] if self.takes else self.lower).lstrip("\n").split("\n")
        end = self._run(lines)
        first = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
        rows = [x for x in lines[:end] if x.strip()]
        rest = lines[max(end, first) :]
        chain = []
        if rest and _MARK["CONTINUES"].match(rest[0].strip()):
            chain, rest = [rest[0]], rest[1:]
        return "\n".join([top, "\n".join(self._headless(rows)), *chain]), "\n".join(rest).strip()

    def _by_shape(self) -> tuple[str, str] | None:
        above, below = self.upper.rstrip().split("\n"), self.lower.lstrip().split("\n")
        top = None
        for line in reversed(above):
            if self._row(line):
                top = line
            elif line.strip():
                break
        end = self._run(below)
        if top is None or not end:
            return None
        width = top.strip().count("|") - 1
        if width < 1 or width != below[0].strip().count("|") - 1:
            return None
        return "\n".join([*above, *self._headless(below[:end])] if self._headless(below[:end]) else [*above, ""]), "\n".join(below[end:]).strip()


def merged_pages(pages: list[str]) -> list[str]:
    """Pages of one document with tables that run over page breaks in one piece; emptied pages vanish, so a table may run on and on."""
    done: list[str] = pages[:1]
    waiting = pages[1:][::-1]
    while waiting:
        lower = waiting.pop()
        joined = _Seam(done[-1], lower).join()
        if joined is None:
            done.append(lower)
            continue
        done[-1], rest = joined
        if rest.strip():
            waiting.append(rest)
    return done


def report(pages: DataFrame, doc: str, provider: str) -> DataFrame:
    """(doc, pages, providers): blank pages count; providers are the distinct non-empty ones, sorted, '-' if none."""
    names = F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(provider), F.lit("")))), ", ")
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), F.when(names == "", "-").otherwise(names).alias("providers"))


def chunks(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """Extension: (key, chunk_no, type, title, content): each table of a page is a chunk, each run of other lines up to a heading is one.

    ``title`` is the heading the chunk stands under, '' before the first. Lines are numbered and grouped by islands; a page is one window.
    """
    lines = pages.select(*key, F.posexplode(F.split(filled(F.col(text)), "\n")).alias("i", "x")).filter(strip(F.col("x")) != "")
    w = Window.partitionBy(*key).orderBy("i")
    head, row = F.col("x").rlike(r"^#{1,6} "), F.startswith(F.col("x"), F.lit("|"))
    n = lines.withColumns({"head": head, "row": row}).withColumn("title", F.last(F.when(F.col("head"), F.regexp_replace("x", r"^#+ ", "")), ignorenulls=True).over(w))
    n = n.withColumn("chunk_no", F.sum((F.col("head") | (F.col("row") != F.lag("row", 1, False).over(w)) | (F.col("i") == F.min("i").over(Window.partitionBy(*key)))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = n.groupBy(*key, F.col("chunk_no")).agg(F.when(F.max("row"), "table").otherwise("text").alias("type"), F.coalesce(F.min("title"), F.lit("")).alias("title"), F.array_join(_ordered(F.col("x"), "i"), "\n").alias("content"))
    return g


def tokens(text: Column) -> Column:
    """About how many tokens a text has: one for each four characters begun."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def rag_chunks(pages: DataFrame, key: list[str], text: str, most: int = 512) -> DataFrame:
    """Extension: the chunks of ``chunks`` with text chunks cut at line ends into parts of about ``most`` tokens and each table a second time as
    ``table_summary``: (key, chunk_no, part, type, title, content, summary).

    A part begins with the line that passes a multiple of ``most``; a longer line stands alone. The summary of a table is its heading, its columns
    and the number of its rows.
    """
    base = chunks(pages, key, text)
    w = Window.partitionBy(*key, "chunk_no").orderBy("i")
    lines = base.filter("type = 'text'").select(*key, "chunk_no", "title", F.posexplode(F.split("content", "\n")).alias("i", "x"))
    lines = lines.withColumn("part", F.floor((F.sum(tokens(F.col("x"))).over(w.rowsBetween(Window.unboundedPreceding, 0)) - tokens(F.col("x"))) / most).cast("int"))
    texts = lines.groupBy(*key, "chunk_no", "title", "part").agg(F.array_join(_ordered(F.col("x"), "i"), "\n").alias("content"))
    tables = base.filter("type = 'table'")
    row = F.split("content", "\n")
    columns = F.array_join(F.filter(F.transform(F.split(row[0], r"\|"), strip), lambda c: c != ""), ", ")
    rows = F.size(F.filter(row, lambda r: ~r.rlike(r"^\|[\s\-:|]+\|$"))) - 1
    summary = F.concat(F.when(F.col("title") == "", "").otherwise(F.concat("title", F.lit(": "))), F.lit("columns "), columns, F.lit("; "), rows.cast("string"), F.lit(" rows"))
    none = F.lit(None).cast("string").alias("summary")
    out = texts.select(*key, "chunk_no", "part", F.lit("text").alias("type"), "title", "content", none)
    out = out.unionByName(tables.select(*key, "chunk_no", F.lit(0).alias("part"), "type", "title", "content", summary.alias("summary")))
    return out.unionByName(tables.select(*key, "chunk_no", F.lit(0).alias("part"), F.lit("table_summary").alias("type"), "title", summary.alias("content"), none))


def rag_json(chunked: DataFrame, source: str, page: str) -> DataFrame:
    """(source, json): the chunks of each document as {source, chunks: [{type, page, title, content, summary}]}, without the summary where there is none."""
    each = F.struct(page, "chunk_no", "part", "type", "title", "content", "summary")
    pick = lambda c: F.struct(c["type"].alias("type"), c[page].alias("page"), c["title"].alias("title"), c["content"].alias("content"), c["summary"].alias("summary"))
    per = chunked.groupBy(source).agg(F.transform(F.array_sort(F.collect_list(each)), pick).alias("chunks"))
    return per.select(source, F.to_json(F.struct(F.col(source).alias("source"), "chunks")).alias("json"))
