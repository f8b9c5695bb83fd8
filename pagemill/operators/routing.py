"""Which decoder, strategy, prompt and model a file gets: lookups as joins with small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import filled, stem, suffix

#: Decoders: name, file type, whether page images can be read by a model, suffixes. Fixed values.
DECODERS = [
    ("text", "text", False, "txt text md markdown rst"),
    ("csv", "csv", False, "csv tsv"),
    ("xlsx", "xlsx", False, "xlsx xls"),
    ("html", "html", False, "html htm xhtml"),
    ("xml", "html", False, "xml"),
    ("epub", "epub", False, "epub"),
    ("rtf", "rtf", False, "rtf"),
    ("docx", "docx", True, "docx"),
    ("pptx", "pptx", True, "pptx"),
    ("pdf", "pdf", True, "pdf"),
    ("image", "image", True, "png jpg jpeg tiff tif bmp webp"),
]
#: Prompt kinds by file type; others are documents. Fixed values.
PROMPTS = {"pptx": "slide", "xlsx": "table", "image": "image", "scan": "scan"}
STRATEGIES = ("fast", "ocr", "hybrid", "vlm")


#: What stands for a file whose format has no text of its own.
UNSUPPORTED = "*[File: {name} — direct extraction not supported for this format]*"


def registry(spark: SparkSession) -> DataFrame:
    """(ext, decoder, file_type, needs_vlm): 25 suffixes, and those of the caller's decoders, whose names are their suffixes."""
    from pagemill.sources.custom import CUSTOM

    rows = [(e, n, t, v) for n, t, v, exts in DECODERS for e in exts.split() if e not in CUSTOM]
    rows += [(e, e, c.file_type, c.needs_vlm) for e, c in CUSTOM.items()]
    return spark.createDataFrame(rows, "ext string, decoder string, file_type string, needs_vlm boolean")


def dispatched(files: DataFrame, path: str) -> DataFrame:
    """Files with ext, decoder, file_type, needs_vlm and an error where the suffix is missing or unknown. The registry has a fixed size."""
    known = F.broadcast(registry(files.sparkSession).withColumnRenamed("ext", "_ext"))
    out = files.withColumn("ext", suffix(F.col(path))).join(known, F.col("ext") == F.col("_ext"), "left").drop("_ext")
    error = F.when(F.col("ext") == "", F.concat(F.lit("Cannot determine file type for: "), filled(F.col(path)))).when(F.col("decoder").isNull(), F.concat(F.lit("Unsupported file type: ."), F.col("ext")))
    return out.withColumn("error", error)


def route(decoder: Column, needs_vlm: Column, strategy: Column, office: Column, model: Column) -> Column:
    """How a file is read: direct, ocr, hybrid, vlm or refine. Unknown strategies are vlm."""
    office_file = decoder.isin("docx", "pptx")
    return (
        F.when(~needs_vlm | (strategy == "fast"), "direct")
        .when(office_file & ~office, F.when(strategy == "ocr", "direct").otherwise(F.when(model, "refine").otherwise("direct")))
        .when(strategy == "ocr", "ocr")
        .when(strategy == "hybrid", F.when(decoder == "pdf", "hybrid").otherwise("direct"))
        .otherwise("vlm")
    )


def prompt_kind(file_type: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in PROMPTS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.lower(file_type)), F.lit("document"))


def prompt(kind: Column, images: Column, texts: dict[str, str], numbering: str, tables: str) -> Column:
    """The prompt of a page: its kind's text, the note on tables over pages, and the note on numbered images where it has any."""
    base = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    note = F.when(F.coalesce(images, F.lit(0)) > 0, F.replace(F.lit(numbering), F.lit("{n}"), images.cast("string"))).otherwise("")
    return F.concat(F.coalesce(F.try_element_at(base, kind), F.lit(texts["document"])), F.lit(tables), note)


#: Prompts in our words; the markers are formats that the merge of tables and the enrichment of images read.
TEXTS = {
    "document": "Write the page as Markdown: headings, lists, tables. Keep every word and number; add nothing.",
    "slide": "Write the slide as Markdown under its title with ##. Keep the grouping of its points; add nothing.",
    "table": "Write every table of the page as a Markdown table with all its rows and columns.",
    "image": "Describe the picture in a few plain sentences, with any text it shows.",
    "scan": "Read the scanned page into Markdown. Where a word can't be read, write [illegible].",
}
NUMBERING = " The page holds {n} pictures: mark them ![description](figure_0), ![description](figure_1) and so on."
TABLES = " If a table runs on over the page's end write <!-- TABLE_CONTINUES:columns=N --> after it; if it came from the page before, <!-- TABLE_CONTINUED:columns=N --> before it."
REFINE = {"pptx": "Put the raw text of the slides in order as Markdown, one section for each slide.", "document": "Put the raw text in order as Markdown; change and leave out nothing."}


def pending(files: DataFrame, outputs: DataFrame, path: str, output: str) -> DataFrame:
    """Files whose ``<stem>.md`` isn't there yet; files of one stem share their output."""
    done = outputs.select(stem(F.col(output)).alias("_stem")).distinct()
    return files.withColumn("_s", stem(F.col(path))).join(done, F.col("_s") == F.col("_stem"), "left_anti").drop("_s")


def failed_text(error: Column) -> Column:
    return F.concat(F.lit("<!-- Extraction failed: "), filled(error), F.lit(" -->"))
