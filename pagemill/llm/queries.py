"""The queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bodies, encodings, leaks, repeats, residue, scans, sentences, splitting, tokens, truncation
from pagemill.llm.common import first_part
from pagemill.session import table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _pages(spark: SparkSession, d: str, *parts: str) -> DataFrame:
    pages = table(spark, d, "parsed_pages")
    return pages.filter(first_part(F.col("source_path")).isin(*parts)) if parts else pages


def _noise(spark: SparkSession, d: str) -> scans.Noise:
    blocks = table(spark, d, "text_blocks").filter(first_part(F.col("source_path")) == "scan")
    return scans.Noise(blocks, _pages(spark, d, "scan"), _pages(spark, d).select(F.col("markdown").alias("text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d).found()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d).repaired()


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d).blocks()


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d).documents()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_lines(_pages(spark, d, "web"), "page_id", "source_path", "markdown")


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, "web").select("page_id", "source_path", "markdown")
    return repeats.without_lines(pages, "page_id", "markdown", p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return bodies.noise_lines(_pages(spark, d, "crawl"), "page_id", "source_path", "page_number", "markdown")


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, "crawl").select("page_id", "source_path", "markdown")
    return repeats.without_lines(pages, "page_id", "markdown", p3_found(spark, d))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    wrapped = first_part(F.col("source_path")) == "scan"
    return truncation.cut_texts(pages, table(spark, d, "vlm_usage"), table(spark, d, "models"), "page_id", "source_path", "page_number", "markdown", wrapped)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).filter("cause is not null").select("page_id")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares(_cut(spark, d))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, "web", "vlm", "lib")
    return encodings.repaired(pages, "page_id", "markdown", encodings.trained(pages, "page_id", "markdown"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_repaired(spark, d).filter("garbled").select("page_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_pages").select(F.lit("parsed_pages").alias("tab"), F.col("page_id").alias("row"), F.lit(0).alias("part"), F.col("markdown").alias("text"))
    elements = table(spark, d, "visual_elements")
    # a well-formed mark of an image's place is what the column is for
    place = F.when(~F.col("placeholder_id").rlike(r"^<!-- FPE_IMG:p\d+_\d+ -->$"), F.col("placeholder_id"))
    of = lambda part, text: elements.select(F.lit("visual_elements").alias("tab"), F.col("element_id").alias("row"), F.lit(part).alias("part"), text.alias("text"))
    return pages.union(of(0, F.col("description"))).union(of(1, place))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_rows(_texts(spark, d)).select(F.col("tab").alias("table_name"), F.col("row").alias("row_id"))


def p6_kept_pages(spark: SparkSession, d: str) -> DataFrame:
    bad = p6_found(spark, d).filter("table_name = 'parsed_pages'").select(F.col("row_id").alias("page_id"))
    return _pages(spark, d).select("page_id", "source_path", "markdown").join(bad, "page_id", "left_anti")


def p6_kept_elements(spark: SparkSession, d: str) -> DataFrame:
    bad = p6_found(spark, d).filter("table_name = 'visual_elements'").select(F.col("row_id").alias("element_id"))
    return table(spark, d, "visual_elements").select("element_id", "source_path", "placeholder_id", "description").join(bad, "element_id", "left_anti")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_pages(spark, d), "page_id", "markdown")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).filter("piece_no = 2").select("page_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without(table(spark, d, "documents").select("doc_id", "text"), "doc_id", p9_found(spark, d))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", p9_found(spark, d))


def p9_cut(spark: SparkSession, d: str) -> DataFrame:
    return leaks.cut(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", p9_spans(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_repaired, p1_blocks, p1_documents, p2_found, p2_cleaned, p3_found, p3_cleaned, p4_found, p4_shares, p5_found, p5_repaired, p6_found, p6_kept_pages, p6_kept_elements, p7_found, p7_pieces, p8_ids, p9_found, p9_cleaned, p9_spans, p9_cut, p10_found]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return SQL


#: Lines alike, counted exactly: what the chunks must lead to.
_LIKE = r"regexp_replace(lower(regexp_replace(regexp_replace(x, '\]\([^()\s]*\)', '', 'g'), '</?[[:alpha:]][^<>]*>', '', 'g')), '[^\p{L}\p{M}]+', '', 'g')"
SQL = {
    "p2_found": f"""
        WITH pages AS (SELECT page_id, markdown, split_part(source_path, '/', 1) || '/' || split_part(source_path, '/', 2) AS source FROM parsed_pages WHERE source_path LIKE 'web/%'),
        lines AS (SELECT page_id, source, unnest(string_split(markdown, chr(10))) AS x, unnest(range(1, len(string_split(markdown, chr(10))) + 1)) AS line_no FROM pages),
        alike AS (SELECT page_id, source, CAST(line_no AS INTEGER) AS line_no, {_LIKE} AS k FROM lines),
        many AS (SELECT source, k FROM alike JOIN (SELECT source, count(*) AS n FROM pages GROUP BY source) USING (source) WHERE k <> '' GROUP BY source, k, n HAVING count(DISTINCT page_id) >= 4 AND count(DISTINCT page_id) >= 0.1 * n)
        SELECT page_id, line_no FROM alike SEMI JOIN many USING (source, k)""",
    "p7_found": "SELECT page_id FROM parsed_pages WHERE length(markdown) > 2000",
}
SQL["p2_cleaned"] = f"""
    WITH found AS ({SQL["p2_found"]}), cut AS (SELECT page_id, list(line_no) AS n FROM found GROUP BY page_id)
    SELECT page_id, source_path, CASE WHEN n IS NULL THEN markdown ELSE array_to_string(list_filter(string_split(markdown, chr(10)), lambda x, i: NOT list_contains(n, i)), chr(10)) END AS markdown
    FROM parsed_pages LEFT JOIN cut USING (page_id) WHERE source_path LIKE 'web/%'"""
