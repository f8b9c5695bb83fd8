"""Queries of the engine's operators over whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from pagemill.config import Settings
from pagemill.functions import text as tx
from pagemill.operators import assembly, enrich, layout, models_io, routing, tables, usage
from pagemill.plans import pipeline, stubs
from pagemill.session import shared_dir, table, written
from pagemill.sources import catalogue, files
from pagemill.sources import html as web
from pagemill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return enter


# SQL of the text functions; RE2 has neither look-around nor \z after it, but \A, \z and classes suffice
_IN = tx.INLINE
_WS = _IN + r"\n"
_NL = "chr(10)"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\A[{_WS}]+', ''), '[{_WS}]+\z', '')"


def _clean(x: str) -> str:
    bare = _strip(x)
    fence = rf"'(?s)\A```(?:markdown|md)?[{_WS}]*\n(.*)```\z'"
    t = rf"CASE WHEN regexp_matches({bare}, {fence}) THEN regexp_extract({bare}, {fence}, 1) ELSE {bare} END"
    t = rf"regexp_replace(regexp_replace({t}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    t = rf"regexp_replace({t}, '[{_IN}]+(\n|\z)', '\1', 'g')"
    return f"{_strip(t)} || {_NL}"


_RULE_SQL = f"({_NL} || {_NL} || '---' || {_NL} || {_NL})"


@query(f"SELECT page_id, {_clean('markdown')} AS markdown FROM parsed_pages")
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_pages").select("page_id", tx.clean_markdown(F.col("markdown")).alias("markdown"))


@query(f"SELECT source_path, string_agg({_clean('markdown')}, {_RULE_SQL} ORDER BY page_number, page_id) AS markdown FROM parsed_pages WHERE {_strip('markdown')} <> '' GROUP BY source_path")
def joined_pages(spark: SparkSession, d: str) -> DataFrame:
    return assembly.joined_pages(table(spark, d, "parsed_pages"), "source_path", ["page_number", "page_id"], "markdown")


@query(f"SELECT source_path, string_agg({_strip('markdown')}, {_RULE_SQL} ORDER BY page_number, page_id) AS markdown FROM parsed_pages WHERE {_strip('markdown')} <> '' GROUP BY source_path")
def ordered_documents(spark: SparkSession, d: str) -> DataFrame:
    return assembly.assembled(table(spark, d, "parsed_pages"), "source_path", "page_number", "markdown", "page_id", merge=False)


_BARS = lambda x: f"length({x}) - length(replace({x}, '|', ''))"
#: Tables over page breaks by their shape: page by page, what a page leaves after its rows is the next page. The test tables hold no marks.
_ASSEMBLED_SQL = rf"""
    WITH RECURSIVE p AS (SELECT source_path, list({_strip('markdown')} ORDER BY page_number, page_id) AS w FROM parsed_pages WHERE {_strip('markdown')} <> '' GROUP BY source_path),
    fold AS (
      SELECT source_path, CAST([] AS VARCHAR[]) AS done, w[1] AS u, w[2:] AS w FROM p
      UNION ALL
      SELECT source_path, CASE WHEN m THEN done ELSE list_append(done, u) END, CASE WHEN m THEN up || {_NL} || body ELSE l END, CASE WHEN m AND rest <> '' THEN list_prepend(rest, w[2:]) ELSE w[2:] END
      FROM (
        SELECT *, top <> '' AND head <> '' AND {_BARS('trim(top)')} - 1 >= 1 AND {_BARS('trim(top)')} = {_BARS("trim(string_split(l, chr(10))[1])")} AS m, array_to_string(rows[CASE WHEN len(rows) > 1 AND regexp_full_match(trim(rows[2]), '\|[\s\-:|]+\|') THEN 3 WHEN len(rows) > 1 AND regexp_full_match(trim(rows[1]), '\|[\s\-:|]+\|') THEN 2 ELSE 1 END:], {_NL}) AS body, {_strip('l[length(head) + 1:]')} AS rest
        FROM (
          SELECT *, string_split(rtrim(head, {_NL}), {_NL}) AS rows, regexp_extract(regexp_extract(up, '(?:\A|
)((?:[ 	]*(?:\|[^
]+\|)?[ 	]*(?:
|\z))+)\z', 1), '\|[^
]+\|') AS top
          FROM (SELECT *, w[1] AS l, regexp_replace(u, '[{_WS}]+\z', '') AS up, regexp_extract(w[1], '\A((?:[ 	]*\|[^
]+\|[ 	]*(?:
|\z))+)', 1) AS head FROM fold WHERE len(w) > 0)))
    )
    SELECT source_path, array_to_string(list_filter(list_append(done, u), lambda x: {_strip('x')} <> ''), {_RULE_SQL}) AS markdown FROM fold WHERE len(w) = 0"""


@query(_ASSEMBLED_SQL)
def assembled_documents(spark: SparkSession, d: str) -> DataFrame:
    return assembly.assembled(table(spark, d, "parsed_pages"), "source_path", "page_number", "markdown", "page_id")


@query(f"SELECT source_path, string_agg('<!-- page:' || page_number || ' -->' || {_NL} || {_strip('markdown')}, {_NL} || {_NL} ORDER BY page_number, page_id) AS markdown FROM parsed_pages WHERE {_strip('markdown')} <> '' GROUP BY source_path")
def page_tagged_documents(spark: SparkSession, d: str) -> DataFrame:
    return assembly.assembled(table(spark, d, "parsed_pages"), "source_path", "page_number", "markdown", "page_id", page_tags=True, merge=False)


@query("SELECT source_path, count(*) AS pages, coalesce(nullif(string_agg(DISTINCT nullif(provider, ''), ', ' ORDER BY nullif(provider, '')), ''), '-') AS providers FROM parsed_pages GROUP BY source_path")
def document_report(spark: SparkSession, d: str) -> DataFrame:
    return assembly.report(table(spark, d, "parsed_pages"), "source_path", "provider")


@query("""
    WITH known AS (SELECT source_path, count(*) AS pages FROM parsed_pages GROUP BY source_path),
    docs AS (SELECT source_path, max(page_count) AS page_count FROM parsed_documents GROUP BY source_path)
    SELECT count(*) AS documents, count(known.pages) AS with_pages, count(*) FILTER (WHERE page_count IS NULL) AS unknown_count, coalesce(sum(known.pages), 0)::BIGINT AS pages
    FROM docs LEFT JOIN known USING (source_path)""")
def corpus_tally(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "parsed_pages").groupBy("source_path").agg(F.count("*").alias("pages"))
    docs = table(spark, d, "parsed_documents").groupBy("source_path").agg(F.max("page_count").alias("page_count"))
    return docs.join(known, "source_path", "left").agg(F.count("*").alias("documents"), F.count("pages").alias("with_pages"), F.count_if(F.col("page_count").isNull()).alias("unknown_count"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


# grids: an order's lines are rows, every third of them a cell short
_CELLS = "CASE WHEN l_linenumber % 3 = 0 THEN [CAST(l_partkey AS VARCHAR), l_returnflag] ELSE [CAST(l_partkey AS VARCHAR), l_returnflag, CAST(l_suppkey AS VARCHAR)] END"


def _grids(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    cells = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.col("l_partkey").cast("string"), "l_returnflag")).otherwise(F.array(F.col("l_partkey").cast("string"), "l_returnflag", F.col("l_suppkey").cast("string")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("c")))), lambda r: r["c"])
    return l.groupBy("l_orderkey").agg(rows.alias("rows"))


_PAD = "list_resize(list_transform(c, lambda x: coalesce(x, '')), w, '')"


def _grid_sql(width: str, title: str) -> str:
    return f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, {_CELLS} AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_CELLS}) AS i FROM lineitem),
    w AS (SELECT *, {width} AS w FROM r)
    SELECT l_orderkey, {title} string_agg('| ' || array_to_string({_PAD}, ' | ') || ' |' || CASE WHEN i = 1 THEN {_NL} || '|' || repeat(' --- |', w::INT) ELSE '' END, {_NL} ORDER BY i) AS markdown
    FROM w GROUP BY l_orderkey"""


@query(_grid_sql("max(len(c)) OVER (PARTITION BY l_orderkey)", f"'## Order ' || l_orderkey || {_NL} || {_NL} ||"))
def grid_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))
    return _grids(spark, d).select("l_orderkey", tables.table_text(F.col("rows"), title).alias("markdown"))


@query(_grid_sql("first_value(len(c)) OVER (PARTITION BY l_orderkey ORDER BY i)", ""))
def fixed_width_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("l_orderkey", tables.fixed_width_table(F.col("rows")).alias("markdown"))


@query(f"""
    WITH r AS (SELECT l_orderkey, {_CELLS} AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_CELLS}) AS i FROM lineitem)
    SELECT l_orderkey, string_agg('| ' || array_to_string(c, ' | ') || ' |' || CASE WHEN i = 1 THEN {_NL} || '|' || repeat(' --- |', len(c)) ELSE '' END, {_NL} ORDER BY i) AS markdown FROM r GROUP BY l_orderkey""")
def ragged_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("l_orderkey", tables.ragged_table(F.col("rows")).alias("markdown"))


@query(f"""
    WITH r AS (SELECT 'user ' || user_id AS sheet, event_id, CASE WHEN event_id % 17 = 0 THEN ['Group ' || event_type, '', ''] ELSE [event_type, CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR)] END AS c FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY event_id) AS i, count(*) OVER (PARTITION BY sheet) AS n, first_value(c) OVER (PARTITION BY sheet ORDER BY event_id) AS head FROM r),
    k AS (SELECT *, n > 50 AND i > 2 AND c[1] <> '' AND c[2] = '' AND c[3] = '' AS cut FROM n),
    g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY sheet ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS chunk_no FROM k)
    SELECT sheet, chunk_no::BIGINT AS chunk_no, '## ' || sheet || CASE WHEN max(cut::INT) = 1 THEN ' — ' || max(CASE WHEN cut THEN c[1] END) ELSE '' END || {_NL} || {_NL}
      || '| ' || array_to_string(any_value(head), ' | ') || ' |' || {_NL} || '| --- | --- | --- |' || {_NL} || string_agg('| ' || array_to_string(c, ' | ') || ' |', {_NL} ORDER BY i) AS markdown
    FROM g WHERE i > 1 GROUP BY sheet, chunk_no""")
def smart_split(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cells = F.when(F.col("event_id") % 17 == 0, F.array(F.concat(F.lit("Group "), "event_type"), F.lit(""), F.lit(""))).otherwise(F.array("event_type", F.col("event_id").cast("string"), F.col("user_id").cast("string")))
    rows = e.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("sheet"), "event_id", cells.alias("cells"))
    return tables.split_sheets(rows, "sheet", "event_id", "cells")


_NAMES = ["sum", "Average", "COUNT", "max", "MIN", "vlookup", "HLOOKUP", "if", "SumIf", "countif", "INDEX", "match", "ROUND", "sumproduct"]
_LABEL_SQL = "CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.FORMULAS.items()) + " ELSE 'formula' END"


@query(f"""
    WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 16 = 15 THEN p_name WHEN p_partkey % 16 = 14 THEN '=A1+B' || p_size ELSE '= ' || {_NAMES}[p_partkey % 16 + 1] || '(A' || p_size || ':B9)' END AS formula FROM part),
    n AS (SELECT *, regexp_extract(upper(trim(formula[2:])), '^([A-Z]+)\\(', 1) AS f FROM p)
    SELECT p_partkey, CASE WHEN formula[1:1] = '=' THEN ' <!-- ' || {_LABEL_SQL} || ': ' || formula || ' -->' ELSE '' END AS note FROM n""")
def formula_annotation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 16
    name = F.get(F.array(*[F.lit(x) for x in _NAMES]), k.cast("int"))
    formula = F.when(k == 15, F.col("p_name")).when(k == 14, F.concat(F.lit("=A1+B"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("= "), name, F.lit("(A"), F.col("p_size").cast("string"), F.lit(":B9)")))
    return table(spark, d, "part").select("p_partkey", tables.formula_note(formula).alias("note"))


@query("""
    WITH cells AS (SELECT s_nationkey AS sheet, s_suppkey AS r, c, CASE c WHEN 1 THEN s_name WHEN 2 THEN CAST(s_nationkey AS VARCHAR) ELSE NULL END AS value FROM supplier, range(1, 4) t(c)),
    ranges AS (SELECT n_nationkey AS sheet, k AS ord, n_nationkey * 3 + k * 5 AS r1, n_nationkey * 3 + k * 5 + 6 AS r2, 1 + k % 2 AS c1, 2 + k % 2 AS c2, n_name || k AS v FROM nation, range(0, 12) t(k))
    SELECT cells.sheet, r AS row, c AS col, coalesce(arg_max(v, ord), any_value(value), '') AS value FROM cells LEFT JOIN ranges ON ranges.sheet = cells.sheet AND r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 GROUP BY cells.sheet, r, c""")
def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    cells = s.select(F.col("s_nationkey").alias("sheet"), F.col("s_suppkey").alias("row"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("col"), "s_name").select("sheet", "row", "col", F.when(F.col("col") == 1, F.col("s_name")).when(F.col("col") == 2, F.col("sheet").cast("string")).alias("value"))
    k = n.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("k"))
    top = F.col("n_nationkey") * 3 + F.col("k") * 5
    ranges = k.select(F.col("n_nationkey").alias("sheet"), F.col("k").alias("ord"), top.alias("r1"), (top + 6).alias("r2"), (1 + F.col("k") % 2).alias("c1"), (2 + F.col("k") % 2).alias("c2"), F.concat("n_name", F.col("k").cast("string")).alias("value"))
    return tables.merged_cells(cells, ranges)


_THRESHOLDS_SQL = "SELECT l_orderkey, " + ", ".join(f"CASE WHEN max(l_quantity) - median(l_quantity) >= 1.0 THEN round(median(l_quantity) * {k}, 6) END AS h{i}" for i, k in enumerate(layout.LEVELS, 1)) + " FROM lineitem GROUP BY l_orderkey"


@query(_THRESHOLDS_SQL)
def heading_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return layout.heading_thresholds(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")


@query(f"""
    WITH t AS ({_THRESHOLDS_SQL}),
    s AS (SELECT l_orderkey, l_linenumber, l_quantity, ' ' || l_returnflag || l_partkey AS x, (l_linenumber % 2) * 2 + (l_linenumber % 3 = 0)::INT * 16 AS f, CASE WHEN l_suppkey % 5 = 0 THEN 'http://x/' || l_suppkey END AS u FROM lineitem),
    m AS (SELECT *, CASE WHEN f & 2 <> 0 THEN '*' ELSE '' END || CASE WHEN f & 16 <> 0 THEN '**' ELSE '' END AS e FROM s),
    b AS (SELECT *, CASE WHEN e = '' THEN x ELSE e || trim(x) || e END AS y FROM m),
    l AS (SELECT l_orderkey, trim(string_agg(CASE WHEN u IS NULL THEN y ELSE '[' || y || '](' || u || ')' END, ' ' ORDER BY l_linenumber, CASE WHEN u IS NULL THEN y ELSE '[' || y || '](' || u || ')' END)) AS line, max(l_quantity) AS z FROM b GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN z >= h1 THEN '# ' WHEN z >= h2 THEN '## ' WHEN z >= h3 THEN '### ' ELSE '' END || CASE WHEN z >= h3 THEN regexp_replace(line, '\\*{{1,3}}(.+?)\\*{{1,3}}', '\\1', 'g') ELSE line END AS line FROM l JOIN t USING (l_orderkey)""")
def span_markdown(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    flags = ((F.col("l_linenumber") % 2) * 2 + (F.col("l_linenumber") % 3 == 0).cast("int") * 16).cast("int")
    uri = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("http://x/"), F.col("l_suppkey").cast("string")))
    span = layout.span_text(F.concat(F.lit(" "), "l_returnflag", F.col("l_partkey").cast("string")), flags, uri)
    lines = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", span.alias("s")))), lambda x: x["s"]).alias("spans"), F.max("l_quantity").alias("size"))
    h = layout.heading_thresholds(l, "l_orderkey", "l_quantity")
    return lines.join(h, "l_orderkey").select("l_orderkey", layout.line_text(F.col("spans"), F.col("size"), (F.col("h1"), F.col("h2"), F.col("h3"))).alias("line"))


@query("""
    WITH rects AS (SELECT DISTINCT source_path, page_number, 100.0 AS x0, 150.0 + 10 * page_number AS y0, 300.0 AS x1, 230.0 + 10 * page_number AS y1 FROM text_blocks)
    SELECT block_id, y_min FROM text_blocks b WHERE NOT EXISTS (SELECT 1 FROM rects r WHERE r.source_path = b.source_path AND r.page_number = b.page_number AND x0 < x_max AND x1 > x_min AND y0 < y_max AND y1 > y_min)""")
def text_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "text_blocks")
    top = 10 * F.col("page_number")
    rects = b.select("source_path", "page_number").distinct().select("source_path", "page_number", F.lit(100.0).alias("x0"), (150.0 + top).alias("y0"), F.lit(300.0).alias("x1"), (230.0 + top).alias("y1"))
    return layout.outside(b, rects, ["source_path", "page_number"]).select("block_id", "y_min")


@query("""
    WITH links AS (SELECT source_path, page_number, [{'y0': 140.0, 'y1': 200.0, 'u': 'http://a'}, {'y0': 180.0, 'y1': 400.0, 'u': 'http://b'}] AS k FROM (SELECT DISTINCT source_path, page_number FROM text_blocks))
    SELECT block_id, list_filter(k, lambda z: z.y0 < y_max AND z.y1 > y_min)[1].u AS uri FROM text_blocks JOIN links USING (source_path, page_number)""")
def linked_spans(spark: SparkSession, d: str) -> DataFrame:
    link = lambda y0, y1, u: F.struct(F.lit(0.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(1e6).alias("x1"), F.lit(y1).alias("y1"), F.lit(u).alias("uri"))
    box = F.struct(F.col("x_min").alias("x0"), F.col("y_min").alias("y0"), F.col("x_max").alias("x1"), F.col("y_max").alias("y1"))
    return table(spark, d, "text_blocks").select("block_id", layout.first_link(box, F.array(link(140.0, 200.0, "http://a"), link(180.0, 400.0, "http://b"))).alias("uri"))


@query("SELECT element_id, '<!-- FPE_IMG:p' || page_number || '_' || (row_number() OVER (PARTITION BY source_path, page_number ORDER BY element_id) - 1) || ' -->' AS place FROM visual_elements")
def placeholder_index(spark: SparkSession, d: str) -> DataFrame:
    return layout.placeholders(table(spark, d, "visual_elements"), ["source_path", "page_number"], "element_id").select("element_id", "place")


_LINES_SQL = f"""
    b AS (SELECT source_path, page_number, block_id, x_min, y_min, y_max, {_strip('text')} AS t, row_number() OVER (PARTITION BY source_path, page_number ORDER BY y_min, block_id, x_min) AS i FROM text_blocks WHERE {_strip('text')} <> ''),
    fold AS (
      SELECT source_path, page_number, i, 0 AS line, (y_min + y_max) / 2 AS centre, y_max - y_min AS total, 1 AS n FROM b WHERE i = 1
      UNION ALL
      SELECT b.source_path, b.page_number, b.i, CASE WHEN same THEN f.line ELSE f.line + 1 END, centre2, CASE WHEN same THEN f.total ELSE 0 END + (b.y_max - b.y_min), CASE WHEN same THEN f.n + 1 ELSE 1 END
      FROM fold f JOIN b ON b.source_path = f.source_path AND b.page_number = f.page_number AND b.i = f.i + 1, LATERAL (SELECT (b.y_min + b.y_max) / 2 AS centre2), LATERAL (SELECT abs(centre2 - f.centre) < 0.5 * f.total / f.n AS same)
    ),
    lines AS (SELECT source_path, page_number, line, min(y_min) AS y_min, max(y_max) AS y_max, avg(y_max - y_min) AS height, string_agg(t, ' ' ORDER BY x_min, y_min, block_id) AS text FROM fold JOIN b USING (source_path, page_number, i) GROUP BY source_path, page_number, line)"""


@query(f"WITH RECURSIVE {_LINES_SQL} SELECT source_path, page_number, line, round(y_min, 6) AS y_min, round(height, 6) AS height, text FROM lines")
def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = layout.text_lines(table(spark, d, "text_blocks"), ["source_path", "page_number"], "block_id")
    return lines.select("source_path", "page_number", "line", F.round("y_min", 6).alias("y_min"), F.round("height", 6).alias("height"), "text")


@query(f"""
    WITH RECURSIVE {_LINES_SQL},
    m AS (SELECT source_path, page_number, list_sort(list(height))[len(list(height)) // 2 + 1] AS m FROM lines GROUP BY source_path, page_number),
    g AS (SELECT *, lag(y_max) OVER (PARTITION BY source_path, page_number ORDER BY y_min, line) AS before FROM lines JOIN m USING (source_path, page_number))
    SELECT source_path, page_number, string_agg(CASE WHEN before > 0 AND y_min - before > 1.5 * m THEN {_NL} ELSE '' END || CASE WHEN length(text) >= 100 THEN '' WHEN height >= m * 1.8 THEN '# ' WHEN height >= m * 1.4 THEN '## ' WHEN height >= m * 1.15 THEN '### ' ELSE '' END || text, {_NL} ORDER BY y_min, line) AS markdown FROM g GROUP BY source_path, page_number""")
def ocr_markdown(spark: SparkSession, d: str) -> DataFrame:
    keys = ["source_path", "page_number"]
    return layout.lines_markdown(layout.text_lines(table(spark, d, "text_blocks"), keys, "block_id"), keys)


_MODEL_SQL = "replace(lower(trim(model_name)), '_', '-')"


@query(f"""
    SELECT {_MODEL_SQL} AS model, count(*) FILTER (WHERE output_tokens > 0) AS requests, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT AS total_tokens,
    round(sum(coalesce(input_tokens, 0)::DECIMAL(18, 0) * coalesce(input_price, 0)::DECIMAL(18, 6) + coalesce(output_tokens, 0)::DECIMAL(18, 0) * coalesce(output_price, 0)::DECIMAL(18, 6))::DOUBLE / 1e6, 9) AS cost FROM vlm_usage GROUP BY 1""")
def model_usage_cost(spark: SparkSession, d: str) -> DataFrame:
    return usage.cost(table(spark, d, "vlm_usage").withColumn("model", usage.model_name(F.col("model_name"))), ["model"])


@query(f"""
    WITH u AS (SELECT usage_id, coalesce(input_tokens, 0) * 977 AS n, ((coalesce(input_tokens, 0)::DECIMAL(12, 0) * input_price::DECIMAL(12, 6) + coalesce(output_tokens, 0)::DECIMAL(12, 0) * output_price::DECIMAL(12, 6)) * 0.000001)::DECIMAL(20, 12) AS c FROM vlm_usage)
    SELECT usage_id, CASE WHEN n >= 1000000 THEN (n::DECIMAL(18, 0) * 0.000001)::DECIMAL(18, 2) || 'M' ELSE format('{{:,}}', n) END AS tokens, '$' || CASE WHEN c < 0.001 THEN c::DECIMAL(18, 6)::VARCHAR WHEN c < 0.1 THEN c::DECIMAL(18, 4)::VARCHAR ELSE c::DECIMAL(18, 2)::VARCHAR END AS cost FROM u""")
def usage_display(spark: SparkSession, d: str) -> DataFrame:
    i, o = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    price = lambda c: F.col(c).cast("decimal(12,6)")
    c = ((i.cast("decimal(12,0)") * price("input_price") + o.cast("decimal(12,0)") * price("output_price")) * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(20,12)")
    return table(spark, d, "vlm_usage").select("usage_id", tx.tokens_text(i * 977).alias("tokens"), tx.cost_text(c).alias("cost"))


@query("""
    WITH p AS (SELECT name AS provider, base_url, name <> 'saltworks' AS configured FROM providers), tasks(task) AS (VALUES ('document'), ('table'), ('image'), ('scan'), ('slide'), ('other')),
    routes(task, model) AS (VALUES ('document', 'lumen-page-s'), ('table', 'mica-table'), ('scan', 'heron-ocr'), ('slide', 'mica-slide'), ('image', 'gone')),
    want AS (SELECT task, coalesce(model, 'optera-nano') AS model FROM tasks LEFT JOIN routes USING (task)),
    first AS (SELECT want.task, want.model, m.provider, base_url, coalesce(configured, false) AS ok FROM want LEFT JOIN models m ON m.name = want.model LEFT JOIN p ON p.provider = m.provider)
    SELECT task, CASE WHEN ok THEN model ELSE 'heron-vl-8b' END AS model, CASE WHEN ok THEN first.provider ELSE 'brasshub' END AS provider, CASE WHEN ok THEN first.base_url ELSE (SELECT base_url FROM p WHERE provider = 'brasshub') END AS base_url, true AS configured FROM first""")
def model_resolution(spark: SparkSession, d: str) -> DataFrame:
    tasks = spark.createDataFrame([(t,) for t in ("document", "table", "image", "scan", "slide", "other")], "task string")
    routes = spark.createDataFrame([("document", "lumen-page-s"), ("table", "mica-table"), ("scan", "heron-ocr"), ("slide", "mica-slide"), ("image", "gone")], "task string, model string")
    providers = table(spark, d, "providers").withColumn("configured", F.col("name") != "saltworks")
    return usage.resolved(tasks, routes, table(spark, d, "models"), providers, "optera-nano", "heron-vl-8b")


@query("SELECT name, '***' || right(api_key_env, 4) AS key, CASE WHEN length(base_url) < 30 THEN base_url ELSE base_url[1:27] || '...' END AS url FROM providers")
def provider_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "providers").select("name", tx.masked(F.col("api_key_env")).alias("key"), tx.shortened(F.col("base_url"), 30).alias("url"))


@query("""
    SELECT d.doc_id, CASE lower(d.file_type) WHEN 'pptx' THEN 'slide' WHEN 'xlsx' THEN 'table' WHEN 'image' THEN 'image' WHEN 'scan' THEN 'scan' ELSE 'document' END AS kind, CASE WHEN lower(d.file_type) = 'pptx' THEN 'slide' ELSE 'document' END AS refine FROM documents d""")
def prompt_selection(spark: SparkSession, d: str) -> DataFrame:
    kind = routing.prompt_kind(F.col("file_type"))
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), F.when(F.lower("file_type") == "pptx", "slide").otherwise("document").alias("refine"))


def _q(x: str) -> str:
    return x.replace("'", "''")


@query(f"""
    WITH pages AS (SELECT DISTINCT source_path, page_number FROM parsed_pages), n AS (SELECT source_path, page_number, count(*) AS n FROM visual_elements GROUP BY ALL)
    SELECT source_path, page_number, '{_q(routing.TEXTS["document"])}' || '{_q(routing.TABLES)}' || CASE WHEN n > 0 THEN replace('{_q(routing.NUMBERING)}', '{{n}}', CAST(n AS VARCHAR)) ELSE '' END AS prompt FROM pages LEFT JOIN n USING (source_path, page_number)""")
def page_prompts(spark: SparkSession, d: str) -> DataFrame:
    keys = ["source_path", "page_number"]
    n = table(spark, d, "visual_elements").groupBy(*keys).agg(F.count("*").alias("n"))
    pages = table(spark, d, "parsed_pages").select(*keys).distinct().join(n, keys, "left")
    return pages.select(*keys, routing.prompt(F.lit("document"), F.col("n"), routing.TEXTS, routing.NUMBERING, routing.TABLES).alias("prompt"))


_REGISTRY_SQL = "(VALUES " + ", ".join(f"('{e}', '{n}', '{t}', {str(v).lower()})" for n, t, v, x in routing.DECODERS for e in x.split()) + ") r(ext, decoder, file_type, needs_vlm)"


@query(f"SELECT * FROM {_REGISTRY_SQL}")
def formats(spark: SparkSession, d: str) -> DataFrame:
    return routing.registry(spark)


@query(f"""
    SELECT ext, strategy, office, model, CASE WHEN NOT needs_vlm OR strategy = 'fast' THEN 'direct'
      WHEN decoder IN ('docx', 'pptx') AND NOT office THEN CASE WHEN strategy <> 'ocr' AND model THEN 'refine' ELSE 'direct' END
      WHEN strategy = 'ocr' THEN 'ocr' WHEN strategy = 'hybrid' THEN CASE WHEN decoder = 'pdf' THEN 'hybrid' ELSE 'direct' END ELSE 'vlm' END AS route
    FROM {_REGISTRY_SQL}, (VALUES ('fast'), ('ocr'), ('hybrid'), ('vlm'), ('other')) s(strategy), (VALUES (true), (false)) o(office), (VALUES (true), (false)) m(model)""")
def strategy_routing(spark: SparkSession, d: str) -> DataFrame:
    every = F.array(*[F.lit(s) for s in (*routing.STRATEGIES, "other")])
    flags = F.array(F.lit(True), F.lit(False))
    r = routing.registry(spark).select("*", F.explode(every).alias("strategy")).select("*", F.explode(flags).alias("office")).select("*", F.explode(flags).alias("model"))
    return r.select("ext", "strategy", "office", "model", routing.route(*[F.col(c) for c in ("decoder", "needs_vlm", "strategy", "office", "model")]).alias("route"))


@query(f"""
    WITH f AS (SELECT source_path, lower(regexp_extract(regexp_replace(string_split(source_path, '/')[-1], '\\A\\.+', ''), '\\.([^.]+)\\z', 1)) AS ext FROM parsed_documents)
    SELECT source_path, f.ext, decoder, CASE WHEN f.ext = '' THEN 'Cannot determine file type for: ' || source_path WHEN decoder IS NULL THEN 'Unsupported file type: .' || f.ext END AS error FROM f LEFT JOIN {_REGISTRY_SQL} ON r.ext = f.ext""")
def file_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return routing.dispatched(table(spark, d, "parsed_documents"), "source_path").select("source_path", "ext", "decoder", "error")


@query("""
    WITH done AS (SELECT DISTINCT regexp_extract(string_split(source_path, '/')[-1], '\\A(.+?)(\\.[^.]*)?\\z', 1) AS stem FROM parsed_pages WHERE page_number > 1)
    SELECT DISTINCT source_path FROM parsed_documents WHERE regexp_extract(string_split(source_path, '/')[-1], '\\A(.+?)(\\.[^.]*)?\\z', 1) NOT IN (SELECT stem FROM done)""")
def checkpoint_skip(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "parsed_pages").filter("page_number > 1").select(F.concat(tx.stem(F.col("source_path")), F.lit(".md")).alias("file")).distinct()
    return routing.pending(table(spark, d, "parsed_documents"), done, "source_path", "file").select("source_path").distinct()


@query("SELECT usage_id, CASE WHEN coalesce(output_tokens, 0) = 0 THEN '<!-- Extraction failed: no answer from ' || model_name || ' -->' END AS markdown, CASE WHEN coalesce(output_tokens, 0) = 0 THEN 'error' ELSE model_name END AS provider FROM vlm_usage")
def failed_pages(spark: SparkSession, d: str) -> DataFrame:
    bad = F.coalesce("output_tokens", F.lit(0)) == 0
    return table(spark, d, "vlm_usage").select("usage_id", F.when(bad, routing.failed_text(F.concat(F.lit("no answer from "), "model_name"))).alias("markdown"), F.when(bad, "error").otherwise(F.col("model_name")).alias("provider"))


_HTML = "<html><head><title>{0}</title><meta name='description' content='c {1}'></head><body><nav><ul><li>Home</li></ul></nav><h1>{0}</h1><p>Key <b>{1}</b> of</p><p>{2}<table><tr><th>a</th><th>b</th></tr><tr><td>{1}</td></tr></table><ol><li>{2}<li>x</ol><a href='/c/{1}'>more</a><hr><script>no</script></body>"


def _customer_html(spark: SparkSession, d: str) -> DataFrame:
    parts = _HTML.replace("{0}", "\0{0}\0").replace("{1}", "\0{1}\0").replace("{2}", "\0{2}\0").split("\0")
    cols = {"{0}": F.col("c_name"), "{1}": F.col("c_custkey").cast("string"), "{2}": F.col("c_mktsegment")}
    return table(spark, d, "customer").select("c_custkey", F.concat(*[cols.get(p, F.lit(p)) for p in parts]).alias("html"))


_HTML_SQL = f"""
    SELECT c_custkey, c_name AS title, 'c ' || c_custkey AS description, replace(replace(replace('# @0^^Key' || '@1' || 'of^^@2^^| a | b |^| --- | --- |^| @1 |  |^^1. @2^2. x^^[more](/c/@1)^^---', '@0', c_name), '@1', CAST(c_custkey AS VARCHAR)), '@2', c_mktsegment) AS markdown FROM customer"""
SQL_HTML = "WITH h AS (" + _HTML_SQL + f") SELECT c_custkey, title, description, replace(markdown, '^', {_NL}) AS markdown FROM h"


@query(SQL_HTML)
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("title string, description string, markdown string")
    def parse(h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([web.metadata(x, t) | {"markdown": web.markdown(x, root=t)} for x in h for t in (web.tree(x),)], columns=["title", "description", "markdown"])

    return _customer_html(spark, d).select("c_custkey", parse("html").alias("p")).select("c_custkey", "p.*")


_LINKED_SQL = r"""
    WITH l AS (SELECT source_path, array_to_string(string_split(min(title), ' ')[1:2], ' ') AS a, 'https://docs.example/' || source_path AS u FROM parsed_documents WHERE title IS NOT NULL GROUP BY source_path),
    p AS (SELECT page_id, page_number, source_path, markdown, CASE WHEN page_number IS NOT NULL THEN a END AS a, u, regexp_replace(markdown, '\[([^\]]+)\]\([^)]+\)', '\1', 'g') AS x FROM parsed_pages LEFT JOIN l USING (source_path)),
    h AS (SELECT *, list_filter([CASE WHEN length(a) >= 2 AND (k = 0 OR (k < least(4, length(a) // 2) AND length(a) - k >= 3)) AND strpos(x, a[k + 1:]) > 0 THEN a[k + 1:] END FOR k IN [0, 1, 2, 3]], lambda t: t IS NOT NULL)[1] AS hit FROM p),
    c AS (SELECT *, strpos(x, hit) - 1 AS o FROM h),
    e AS (SELECT *, o - length(regexp_extract(x[:o], '[^ \n\t(\[*]*$')) AS b, o + length(hit) + length(regexp_extract(x[o + length(hit) + 1:], '^[^ \n\t.,;:!?)\]*]*')) AS z FROM c)
    SELECT source_path, page_number, page_id, CASE WHEN a IS NULL THEN markdown WHEN hit IS NULL THEN x ELSE x[:b] || '[' || x[b + 1:z] || '](' || u || ')' || x[z + 1:] END AS markdown FROM e"""


@query(_LINKED_SQL)
def link_enrichment(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_pages").select("source_path", "page_number", "page_id", "markdown")
    # the first words of every document's title lead to its address
    links = table(spark, d, "parsed_documents").filter("title is not null").groupBy("source_path").agg(F.min("title").alias("t"))
    links = pages.select("source_path", "page_number").distinct().join(links, "source_path").select("source_path", "page_number", F.lit(1).alias("ord"), F.substring_index("t", " ", 2).alias("anchor"), F.concat(F.lit("https://docs.example/"), "source_path").alias("uri"))
    return enrich.with_links(pages, links, ["source_path", "page_number"], "markdown")


_STEM_SQL = r"regexp_extract(string_split(source_path, '/')[-1], '\A(.+?)(\.[^.]*)?\z', 1)"
_PICTURED_SQL = rf"""
    WITH v AS (SELECT source_path, page_number, list({{'y': (element_id % 842)::DOUBLE, 'path': 'images/' || {_STEM_SQL} || '_' || element_id || '.png'}} ORDER BY element_id) AS p FROM visual_elements WHERE page_number IS NOT NULL GROUP BY ALL),
    t AS (SELECT page_id, source_path, page_number, markdown, p, '<!-- FPE_IMG:p\d+_\d+ -->\s*\n*!\[.*?\]\(image\)' AS fast, '!\[([^\]]*)\]\(figure(?:_(\d+))?\)' AS fig, string_split(markdown, {_NL}) AS lines FROM parsed_pages LEFT JOIN v USING (source_path, page_number)),
    m AS (SELECT *, regexp_extract_all(markdown, fast) AS fm, string_split_regex(markdown, fast) AS fp, regexp_extract_all(markdown, fig) AS gm, string_split_regex(markdown, fig) AS gp, regexp_extract_all(markdown, fig, 1) AS gd, regexp_extract_all(markdown, fig, 2) AS gn FROM t),
    n AS (SELECT *, len(list_filter(gn, lambda z: z <> '' AND z::INT < len(p))) > 0 AS numbered FROM m),
    g AS (SELECT *, list_transform(range(1, len(gm) + 1), lambda i: CASE WHEN numbered THEN CASE WHEN gn[i] <> '' AND TRY_CAST(gn[i] AS INT) < len(p) THEN p[TRY_CAST(gn[i] AS INT) + 1].path END WHEN gn[i] = '' THEN p[len(list_filter(gn[:i], lambda z: z = ''))].path END) AS gu FROM n),
    f AS (SELECT *, array_to_string(list_transform(range(1, len(gp) + 1), lambda i: gp[i] || CASE WHEN i <= len(gm) THEN CASE WHEN gu[i] IS NULL THEN gm[i] ELSE '![' || gd[i] || '](' || gu[i] || ')' END ELSE '' END), '') AS figured FROM g)
    SELECT page_id, source_path, page_number, CASE WHEN p IS NULL OR markdown IS NULL THEN markdown
      WHEN len(fm) > 0 THEN array_to_string(list_transform(range(1, len(fp) + 1), lambda i: fp[i] || CASE WHEN i <= len(fm) THEN CASE WHEN i <= len(p) THEN '![Image](' || p[i].path || ')' ELSE fm[i] END ELSE '' END), '')
      WHEN figured <> markdown THEN figured
      ELSE array_to_string(flatten(list_transform(range(len(lines)), lambda i: list_concat(list_transform(list_filter(p, lambda z: greatest(0, least(floor(z.y / (842.0::DOUBLE / len(lines)))::INT, len(lines) - 1)) = i), lambda z: {_NL} || '![Image](' || z.path || ')' || {_NL}), [lines[i + 1]]))), {_NL}) END AS markdown FROM f"""


@query(_PICTURED_SQL)
def image_enrichment(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_pages").select("source_path", "page_number", "page_id", "markdown")
    e = layout.placeholders(table(spark, d, "visual_elements"), ["source_path", "page_number"], "element_id")
    pictures = e.select("source_path", "page_number", F.col("element_id").alias("ord"), (F.col("element_id") % 842).alias("y"), F.concat(F.lit("images/"), tx.stem(F.col("source_path")), F.format_string("_%d.png", "element_id")).alias("path"))
    return enrich.with_pictures(pages, pictures, ["source_path", "page_number"], "markdown")


@query(f"""
    WITH e AS (SELECT source_path, page_number, element_id, description, '<!-- FPE_IMG:p' || page_number || '_' || (row_number() OVER (PARTITION BY source_path, page_number ORDER BY element_id) - 1) || ' -->' AS place FROM visual_elements),
    g AS (SELECT source_path, page_number, string_agg({_NL} || {_NL} || CASE WHEN coalesce(description, '') <> '' THEN description ELSE place || {_NL} || {_NL} || '![Image](image)' END, '' ORDER BY element_id) AS t FROM e GROUP BY ALL)
    SELECT page_id, coalesce(markdown, '') || coalesce(t, '') AS markdown FROM parsed_pages LEFT JOIN g USING (source_path, page_number)""")
def hybrid_fill(spark: SparkSession, d: str) -> DataFrame:
    keys = ["source_path", "page_number"]
    # marks of another kind, so that a description that holds a mark itself isn't filled again
    e = layout.placeholders(table(spark, d, "visual_elements"), keys, "element_id").withColumn("place", F.concat(F.lit("\u0001"), "element_id", F.lit("\u0002"), "place"))
    marks = e.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_id", "place"))), lambda x: F.concat(F.lit("\n\n"), x["place"], F.lit("\n\n![Image](image)"))), "").alias("marks"))
    pages = table(spark, d, "parsed_pages").select(*keys, "page_id", "markdown").join(marks, keys, "left").withColumn("markdown", F.concat(tx.filled(F.col("markdown")), tx.filled(F.col("marks"))))
    out = enrich.described(pages, e.withColumnRenamed("element_id", "ord"), keys, "markdown")
    return out.select("page_id", F.regexp_replace("markdown", "\u0001[^\u0002]*\u0002", "").alias("markdown"))


_PART_ROW = "'| ' || l_partkey || ' | ' || l_returnflag || CASE WHEN i % 5 = 0 THEN ' | ' || l_suppkey ELSE '' END || ' |'"
_PART_HEAD = f"CASE WHEN min(i) % 5 = 0 THEN '| part | flag | supplier |' || {_NL} || '| --- | --- | --- |' ELSE '| part | flag |' || {_NL} || '| --- | --- |' END || {_NL}"


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    g AS (SELECT l_orderkey, (i // 5) * 2 + (i % 5 > 0)::INT AS part, CASE WHEN min(i) % 2 = 1 THEN {_PART_HEAD} ELSE '' END || string_agg({_PART_ROW}, {_NL} ORDER BY i) || CASE WHEN max(n) = 1 THEN {_NL} || '<!-- TABLE_CONTINUES:columns=2 -->' ELSE '' END AS t FROM r GROUP BY l_orderkey, part)
    SELECT l_orderkey, string_agg(t, {_RULE_SQL} ORDER BY part) AS markdown FROM g GROUP BY l_orderkey""")
def table_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each order is a document, each line of it a page that ends and begins within a table: the first two by marks, others by their shape; every fifth
    has three columns, so that it stands alone; every other has no header."""
    l = table(spark, d, "lineitem")  # noqa: E741
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    l = l.withColumn("i", i)  # noqa: E741
    wide = F.col("i") % 5 == 0
    row = F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), "l_returnflag", F.when(wide, F.concat(F.lit(" | "), F.col("l_suppkey").cast("string"))).otherwise(""), F.lit(" |"))
    head = F.when(wide, "| part | flag | supplier |\n| --- | --- | --- |\n").otherwise("| part | flag |\n| --- | --- |\n")
    body = F.when(F.col("i") % 2 == 1, F.concat(head, row)).otherwise(row)
    body = F.when(F.col("i") == 1, F.concat(body, F.lit("\n<!-- TABLE_CONTINUES:columns=2 -->"))).when(F.col("i") == 2, F.concat(F.lit("<!-- TABLE_CONTINUED:columns=2 -->\n"), body)).otherwise(body)
    return assembly.assembled(l.select("l_orderkey", "i", body.alias("markdown")), "l_orderkey", "i", "markdown", "i")


@query("""
    WITH i AS (SELECT p_partkey, p_size * 331 AS w, CAST(p_retailprice AS INT) * 3 AS h FROM part)
    SELECT p_partkey, CASE WHEN greatest(w, h) > 4096 THEN w * 4096 // greatest(w, h) ELSE w END::INT AS width, CASE WHEN greatest(w, h) > 4096 THEN h * 4096 // greatest(w, h) ELSE h END::INT AS height FROM i""")
def image_resize(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 331).alias("w"), (F.rint("p_retailprice").cast("int") * 3).alias("h"))
    w, h = layout.resized(F.col("w"), F.col("h"))
    return p.select("p_partkey", w.alias("width"), h.alias("height"))


_CHUNKS_SQL = f"""
    WITH lines AS (SELECT page_id, unnest(string_split(coalesce(markdown, ''), {_NL})) AS x, unnest(range(len(string_split(coalesce(markdown, ''), {_NL})))) AS i FROM parsed_pages),
    k AS (SELECT *, regexp_matches(x, '^#{{1,6}} ') AS head, x[1:1] = '|' AS row FROM lines WHERE {_strip('x')} <> ''),
    t AS (SELECT *, last_value(CASE WHEN head THEN regexp_replace(x, '^#+ ', '') END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS title, (head OR row <> lag(row, 1, false) OVER (PARTITION BY page_id ORDER BY i) OR i = min(i) OVER (PARTITION BY page_id))::INT AS new FROM k),
    c AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS chunk_no FROM t)
    SELECT page_id, chunk_no::BIGINT AS chunk_no, CASE WHEN bool_or(row) THEN 'table' ELSE 'text' END AS type, coalesce(min(title), '') AS title, string_agg(x, {_NL} ORDER BY i) AS content FROM c GROUP BY page_id, chunk_no"""


@query(_CHUNKS_SQL)
def chunking(spark: SparkSession, d: str) -> DataFrame:
    return assembly.chunks(table(spark, d, "parsed_pages"), ["page_id"], "markdown")


@query(rf"""
    WITH b AS ({_CHUNKS_SQL}),
    l AS (SELECT page_id, chunk_no, title, unnest(string_split(content, {_NL})) AS x, unnest(range(len(string_split(content, {_NL})))) AS i FROM b WHERE type = 'text'),
    k AS (SELECT *, (sum(ceil(length(x) / 4)) OVER (PARTITION BY page_id, chunk_no ORDER BY i ROWS UNBOUNDED PRECEDING) - ceil(length(x) / 4))::BIGINT // 512 AS part FROM l),
    t AS (SELECT *, CASE WHEN title = '' THEN '' ELSE title || ': ' END || 'columns ' || array_to_string(list_filter(list_transform(string_split(string_split(content, {_NL})[1], '|'), lambda c: {_strip('c')}), lambda c: c <> ''), ', ') || '; ' || (len(list_filter(string_split(content, {_NL}), lambda r: NOT regexp_matches(r, '^\|[\s\-:|]+\|$'))) - 1) || ' rows' AS summary FROM b WHERE type = 'table')
    SELECT page_id, chunk_no, part::INT AS part, 'text' AS type, title, string_agg(x, {_NL} ORDER BY i) AS content, NULL AS summary FROM k GROUP BY page_id, chunk_no, title, part
    UNION ALL SELECT page_id, chunk_no, 0, type, title, content, summary FROM t
    UNION ALL SELECT page_id, chunk_no, 0, 'table_summary', title, summary, NULL FROM t""")
def rag_chunks(spark: SparkSession, d: str) -> DataFrame:
    return assembly.rag_chunks(table(spark, d, "parsed_pages"), ["page_id"], "markdown")


_PROMPT = routing.TEXTS["document"] + routing.TABLES


@query(f"SELECT source_path, page_number, coalesce(markdown, '') AS markdown, 'echo' AS provider, {len(_PROMPT) // 4} AS input_tokens, strlen(coalesce(markdown, '')) // 4 AS output_tokens, CAST(NULL AS VARCHAR) AS error FROM parsed_pages")
def model_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every page through the stub of a model, written before it is used."""
    prompt = routing.prompt(F.lit("document"), F.lit(0), routing.TEXTS, routing.NUMBERING, routing.TABLES)
    pages = table(spark, d, "parsed_pages").select("source_path", "page_number", prompt.alias("prompt"), F.encode(tx.filled(F.col("markdown")), "UTF-8").alias("content"))
    return written(models_io.extracted(pages, models_io.echo, "echo"), "answers").drop("prompt_hash")


def _shipped_sql() -> str:
    price = lambda m, k: float(m.get("pricing", {}).get(k, 0.0))
    models = ", ".join(f"('{n}', '{m['provider']}', '{m['model_id']}', {m.get('max_tokens', 8192)}, {price(m, 'input')}::DOUBLE, {price(m, 'output')}::DOUBLE)" for n, m in catalogue.SHIPPED["models"].items())
    providers = ", ".join(f"('{n}', '{p['base_url']}')" for n, p in catalogue.SHIPPED["providers"].items())
    return f"SELECT m.*, CASE WHEN length(u) < 50 THEN u ELSE u[1:47] || '...' END AS url FROM (VALUES {models}) m(name, provider, model_id, max_tokens, input_price, output_price) JOIN (VALUES {providers}) p(provider, u) USING (provider)"


@query(_shipped_sql())
def routes_catalogue(spark: SparkSession, d: str) -> DataFrame:
    t = catalogue.tables(spark, catalogue.SHIPPED)
    return t["models"].join(t["providers"].withColumnRenamed("name", "provider"), "provider").select("name", "provider", "model_id", "max_tokens", "input_price", "output_price", tx.shortened(F.col("base_url")).alias("url"))


#: A PDF for each supplier: a heading, two lines, a grid, a link and a picture.
_PDF = (
    "%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids[3 0 R]/MediaBox[0 0 600 800]>> endobj 3 0 obj <</Type/Page/Contents 4 0 R/Resources<</Font<</F 5 0 R>>/XObject<</I 6 0 R>>>>/Annots[7 0 R]>> endobj "
    "5 0 obj <</Type/Font/Subtype/Type1/BaseFont/Helvetica>> endobj 6 0 obj <</Subtype/Image/Filter/DCTDecode/Width 9/Height 9>> stream\nseen {0}\nendstream endobj 7 0 obj <</Subtype/Link/Rect[48 598 90 612]/A<</S/URI/URI(https://s.example/{1})>>>> endobj "
    "4 0 obj <<>> stream\nBT /F 24 Tf 50 700 Td ({0}) Tj /F 12 Tf 0 -60 Td (Nation {2}) Tj 0 -14 Td (Supplier {1}) Tj 0 -24 Td (Report) Tj ET "
    "50 540 m 250 540 l S 50 520 m 250 520 l S 50 500 m 250 500 l S 50 500 m 50 540 l S 150 500 m 150 540 l S 250 500 m 250 540 l S "
    "BT /F 12 Tf 60 526 Td (key) Tj 100 0 Td (nation) Tj -100 -20 Td ({1}) Tj 100 0 Td ({2}) Tj ET q 50 0 0 50 50 300 cm /I Do Q\nendstream endobj"
)


def _supplier_files(spark: SparkSession, d: str) -> DataFrame:
    bits = _PDF.replace("{0}", "\0{0}\0").replace("{1}", "\0{1}\0").replace("{2}", "\0{2}\0").split("\0")
    cols = {"{0}": F.col("s_name"), "{1}": F.col("s_suppkey").cast("string"), "{2}": F.col("s_nationkey").cast("string")}
    pdf = table(spark, d, "supplier").select(F.format_string("s_%d.pdf", "s_suppkey").alias("path"), F.encode(F.concat(*[cols.get(b, F.lit(b)) for b in bits]), "UTF-8").alias("content"))
    text = table(spark, d, "nation").select(F.format_string("n_%d.txt", "n_nationkey").alias("path"), F.encode("n_name", "UTF-8").alias("content"))
    return pdf.union(text)


_PDF_BODY = f"'Nation ' || s_nationkey || {_NL} || 'Supplier ' || s_suppkey"
_PDF_GRID = f"'| key | nation |' || {_NL} || '| --- | --- |' || {_NL} || '| ' || s_suppkey || ' | ' || s_nationkey || ' |'"
_TXT = f"SELECT 'n_' || n_nationkey || '.txt' AS path, 'text' AS file_type, 1 AS page_number, n_name || {_NL} AS markdown, '' AS provider FROM nation"


def _pdf_sql(markdown: str, provider: str) -> str:
    return f"SELECT 's_' || s_suppkey || '.pdf' AS path, 'pdf' AS file_type, 1 AS page_number, {markdown} || {_NL} AS markdown, '{provider}' AS provider FROM supplier UNION ALL {_TXT}"


def _fast_sql(picture: str) -> str:
    two = f"{_NL} || {_NL}"
    return _pdf_sql(f"'# ' || s_name || {two} || {_PDF_BODY} || {two} || '[Report](https://s.example/' || s_suppkey || ')' || {two} || {_PDF_GRID} || {two} || {picture}", "pymupdf")


def _strategy(spark: SparkSession, d: str, strategy: str, models: models_io.Models | None = models_io.Models(stubs.answered, "one")) -> DataFrame:
    run = pipeline.Run(_supplier_files(spark, d), Settings(strategy=strategy), pipeline.Tools(models, stubs.recognised, stubs.rendered))
    return run.pages().select("path", "file_type", "page_number", "markdown", "provider")


@query(_fast_sql(f"'<!-- FPE_IMG:p1_0 -->' || {_NL} || {_NL} || '![Image](image)'"))
def strategy_fast(spark: SparkSession, d: str) -> DataFrame:
    return _strategy(spark, d, "fast")


@query(_pdf_sql(f"s_name || {_NL} || 'Nation ' || s_nationkey || {_NL} || 'Supplier ' || s_suppkey || {_NL} || 'Report' || {_NL} || 'key' || {_NL} || 'nation' || {_NL} || s_suppkey || {_NL} || s_nationkey", "pp-ocrv5"))
def strategy_ocr(spark: SparkSession, d: str) -> DataFrame:
    return _strategy(spark, d, "ocr")


@query(_fast_sql("'one: SEEN ' || upper(s_name)"))
def strategy_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _strategy(spark, d, "hybrid")


@query(_pdf_sql("'two: ' || s_nationkey", "two"))
def strategy_vlm(spark: SparkSession, d: str) -> DataFrame:
    """The first model refuses every page, the second answers."""
    return _strategy(spark, d, "vlm", models_io.Models(stubs.answered, "full", "two"))


@query("SELECT 's_' || s_suppkey || '.pdf' AS path, 1 AS page_number, unnest(['link', 'picture']) AS kind, 0 AS ord, unnest(['Report', NULL]) AS anchor, unnest(['https://s.example/' || s_suppkey, NULL]) AS uri, unnest([NULL, 'seen ' || s_name]) AS content, unnest([NULL, 450.0::DOUBLE]) AS y FROM supplier")
def pdf_parts(spark: SparkSession, d: str) -> DataFrame:
    """Links and pictures of PDF files."""
    got = files.parts(_supplier_files(spark, d).filter("path LIKE '%.pdf'"))
    return got.select("path", "page_number", "kind", "ord", "anchor", "uri", F.decode("content", "UTF-8").alias("content"), "y")


@query("SELECT 's_' || s_suppkey || '.pdf' AS path, 1 AS page_number, 1 AS n FROM supplier")
def picture_counts(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.picture_counts(files.parts(_supplier_files(spark, d).filter("path LIKE '%.pdf'")))


@query("SELECT count(*) AS pictures, count(*) AS documents, sum(length('seen ' || s_name))::BIGINT AS bytes FROM supplier")
def exported_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of PDF files written to the shared folder by executors, and counted there."""
    import uuid

    base = f"{shared_dir(spark).rstrip('/')}/pagemill-pictures-{uuid.uuid4().hex}"
    saved = files.save_pictures(written(files.parts(_supplier_files(spark, d).filter("path LIKE '%.pdf'")).filter("kind = 'picture'"), "parts"), base)
    there = spark.read.format("binaryFile").load(f"{base}/images").select(F.concat(F.lit("images/"), F.element_at(F.split("path", "/"), -1)).alias("file"), "length")
    return saved.join(there, "file").agg(F.count("*").alias("pictures"), F.count_distinct("path").alias("documents"), F.sum("length").alias("bytes"))


@query("SELECT count(*) AS requests, sum(13)::BIGINT AS input_tokens, sum(length('seen ' || s_name))::BIGINT AS output_tokens, sum(13 + length('seen ' || s_name))::BIGINT AS total_tokens, round(sum(13 * 2 + length('seen ' || s_name) * 8)::DOUBLE / 1e6, 9) AS cost FROM supplier".replace("13", str(len(routing.TEXTS["image"].split()))))
def run_cost(spark: SparkSession, d: str) -> DataFrame:
    """What the calls of a hybrid run cost."""
    models = models_io.Models(stubs.answered, "one", prices=(("one", 2.0, 8.0),))
    run = pipeline.Run(_supplier_files(spark, d), Settings(strategy="hybrid"), pipeline.Tools(models, stubs.recognised, stubs.rendered))
    run.pages()
    return run.cost()


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def stream_usage_windows(spark: SparkSession, d: str) -> DataFrame:
    """Day windows that the watermark has closed, from the events as a stream."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.run_to_table(ingest.usage_windows(events, "ts", "event_type", "value"), "window_start timestamp_ntz, event_type string, n bigint, total double")


@query("SELECT 'n_' || n_nationkey || '.md' AS file, 1 AS page_number, n_name AS title FROM nation")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Files written by executors, then taken in by a stream that keeps its place; nothing is left the second time."""
    import uuid

    base = f"{shared_dir(spark).rstrip('/')}/pagemill-files-{uuid.uuid4().hex}"
    nation = table(spark, d, "nation").select(F.concat(F.lit("n_"), F.col("n_nationkey").cast("string"), F.lit(".html")).alias("path"), F.concat(F.lit("# "), "n_name").alias("text"))
    files.save_documents(nation, "path", "text", base)
    schema = "path string, file_type string, page_number int, markdown string, provider string, metadata map<string,string>, error string"
    ingest.ingest(spark, base, f"{base}-pages", f"{base}-state")
    ingest.ingest(spark, base, f"{base}-pages", f"{base}-state")
    return spark.read.schema(schema).parquet(f"{base}-pages").select(F.element_at(F.split("path", "/"), -1).alias("file"), "page_number", F.regexp_replace("markdown", "^# ", "").alias("title"))

