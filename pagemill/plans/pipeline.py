"""From a folder of files to documents by one of four strategies: one plan, errors kept as rows."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.functions.text import clean_markdown, filled, is_blank, stem
from pagemill.operators import assembly, enrich, models_io, ocr, routing, usage
from pagemill.session import written
from pagemill.sources import files, render

log = logging.getLogger("pagemill")
#: (pages done, pages in all); the first call has none done.
OnPage = Callable[[int, int], None]


@dataclass(frozen=True)
class Tools:
    """What the strategies need from outside: models, a recogniser of text, a renderer of PDF pages, a converter of office files.

    None for a converter means that there is none; then office files are read directly or put in order by a model.
    """

    models: models_io.Models | None = None
    recogniser: ocr.Recogniser = ocr.installed
    renderer: render.Renderer = render.rendered
    office: render.Office | None = None

    @classmethod
    def found(cls, settings: Settings, catalogue: dict) -> Tools:
        """What this machine and the catalogue's keys offer. A model asked for by name that isn't there is an error, other lacks are not."""
        try:
            models = models_io.configured(catalogue, settings.vlm_model_override, settings.vlm_timeout, settings.image_max_size)
        except ValueError:
            if settings.vlm_model_override:
                raise
            models = None
        return cls(models, office=render.converted if render.can_convert() else None)


def logged(verbose: bool = False) -> None:
    """Log to stderr, with ``verbose`` in detail; nothing from other packages."""
    log.handlers[:] = [logging.StreamHandler()]
    log.handlers[0].setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    log.propagate = False


def _counted(df: DataFrame, name: str, total: int, on_page: OnPage | None, count) -> DataFrame:
    """``df`` as a written table; while that runs ``on_page`` hears of the pages that finished tasks have done."""
    if on_page is None:
        return written(df, name)
    on_page(0, total)
    over = threading.Event()

    def tell() -> None:
        said = 0
        while not over.wait(0.2):
            if (now := min(count.value, total)) > said:
                on_page(now, total)
                said = now

    teller = threading.Thread(target=tell, daemon=True)
    teller.start()
    try:
        return written(df, name)
    finally:
        over.set()
        teller.join()
        on_page(total, total)


def _pages(df: DataFrame) -> DataFrame:
    """The columns of pages, with nulls for what is missing."""
    have = {"metadata": "map<string,string>", "provider": "string", "error": "string", "markdown": "string", "page_number": "int", "route": "string"}
    return df.select("path", "file_type", *[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()])


class Run:
    """The plan of one run over found files."""

    def __init__(self, found: DataFrame, settings: Settings, tools: Tools = Tools(), on_page: OnPage | None = None):
        self.settings, self.tools, self.on_page = settings, tools, on_page
        self.spark = found.sparkSession
        lit = lambda x: F.lit(x)
        route = routing.route(F.col("decoder"), F.col("needs_vlm"), lit(settings.strategy), lit(tools.office is not None), lit(tools.models is not None))
        known = routing.dispatched(found, "path")
        self.files = known.withColumn("route", F.when(F.col("error").isNotNull(), "direct").otherwise(route))
        self.calls: list[DataFrame] = []

    def _of(self, *routes: str) -> DataFrame:
        return self.files.filter(F.col("route").isin(*routes))

    def _asked(self, pages: DataFrame, name: str, suffix: str = "") -> DataFrame:
        """Pages (path, page_number, prompt, content) answered by the models, written: no page is asked twice by a later stage."""
        m = self.tools.models
        count = self.spark.sparkContext.accumulator(0) if self.on_page else None
        asked = pages.withColumnRenamed("path", "source_path")
        done = models_io.extracted(asked, m.client, m.primary, m.fallback, self.settings.vlm_concurrency, count)
        done = _counted(done, name, pages.count() if self.on_page else 0, self.on_page, count)
        self.calls.append(done)
        provider = F.when(F.col("error").isNull(), F.concat(F.lit(m.primary), F.lit(suffix)) if suffix else F.col("provider")).otherwise(F.lit("error"))
        return done.select(F.col("source_path").alias("path"), "page_number", "markdown", provider.alias("provider"))

    def _direct(self) -> DataFrame:
        return files.decoded(self._of("direct", "hybrid", "refine")).join(self.files.select("path", "route"), "path")

    def _images(self, route: str) -> DataFrame:
        no_office = render.converted if self.tools.office is None else self.tools.office
        return written(render.page_images(self._of(route), self.settings.image_dpi, self.tools.renderer, no_office), "images")

    def _read(self) -> DataFrame:
        """Pages of images by the recogniser. The blocks of a page are gathered, whose number the page bounds."""
        images = self._images("ocr")
        good = images.filter("error is null")
        count = self.spark.sparkContext.accumulator(0) if self.on_page else None
        recogniser = self.tools.recogniser

        def told(image: bytes):
            got = recogniser(image)
            count.add(1)
            return got

        blocks = ocr.detected(good, recogniser if count is None else told)
        blocks = _counted(blocks, "blocks", good.count() if self.on_page else 0, self.on_page, count)
        pages = ocr.pages(blocks).join(images.select("path", "file_type").distinct(), "path")
        return _pages(pages).union(_pages(images.filter("error is not null")))

    def _seen(self) -> DataFrame:
        """Pages of images by a model, with the number of their pictures in the prompt where those are to be put in."""
        images = self._images("vlm")
        good = images.filter("error is null")
        if self.tools.models is None:
            return _pages(images.select("path", "file_type").distinct().withColumn("error", F.lit("ValueError: No model provider is configured")))
        n = F.lit(0).alias("n")
        if self.settings.extract_images:
            pictures = picture_counts(self.parts())
            good, n = good.join(pictures, ["path", "page_number"], "left"), F.col("n")
        prompt = routing.prompt(routing.prompt_kind(F.col("file_type")), n, routing.TEXTS, routing.NUMBERING, routing.TABLES)
        done = self._asked(good.select("path", "page_number", prompt.alias("prompt"), "content"), "answers")
        return _pages(done.join(images.select("path", "file_type").distinct(), "path")).union(_pages(images.filter("error is not null")))

    def _refined(self, pages: DataFrame) -> DataFrame:
        """Texts of office files put in order by a model; blank pages stay as they are, a failed page ends in an error of its file."""
        prompt = F.when(F.col("file_type") == "pptx", routing.REFINE["pptx"]).otherwise(routing.REFINE["document"])
        mine = pages.filter("route = 'refine'")
        full = mine.filter(F.col("error").isNull() & ~is_blank(F.col("markdown")))
        done = self._asked(full.select("path", "page_number", prompt.alias("prompt"), F.encode("markdown", "UTF-8").alias("content")), "refined", "/refine")
        done = done.select("path", "page_number", F.col("markdown").alias("_m"), F.col("provider").alias("_p"))
        both = mine.join(done, ["path", "page_number"], "left")
        failed = both.groupBy("path").agg(F.max(F.when(F.col("_p") == "error", F.col("_m"))).alias("_e"))
        both = both.join(failed, "path").withColumn("error", F.coalesce("error", F.regexp_extract("_e", r"^<!-- Extraction failed: (.*) -->$", 1)))
        return pages.filter("route <> 'refine'").unionByName(both.withColumns({"markdown": F.coalesce("_m", "markdown"), "provider": F.coalesce("_p", "provider")}).select(*pages.columns))

    def _described(self, pages: DataFrame) -> DataFrame:
        """Pages whose pictures' places are filled by a model's descriptions, joined by page and number of the picture."""
        pictures = self.parts().filter("kind = 'picture' AND content is not null").join(self._of("hybrid").select("path"), "path", "left_semi")
        if self.tools.models is None:
            return pages
        # a picture is asked about as a page of its own: its number within the page goes with it
        numbered = pictures.withColumn("page_number", F.col("page_number") * 10000 + F.col("ord"))
        done = self._asked(numbered.select("path", "page_number", F.lit(routing.TEXTS["image"]).alias("prompt"), "content"), "descriptions")
        number, ord_ = F.floor(F.col("page_number") / 10000).cast("int"), F.pmod("page_number", F.lit(10000))
        elements = done.select("path", number.alias("page_number"), ord_.alias("ord"), F.format_string("<!-- FPE_IMG:p%d_%d -->", number, ord_).alias("place"), F.col("markdown").alias("description"))
        return enrich.described(pages, elements, ["path", "page_number"], "markdown")

    def parts(self) -> DataFrame:
        """Links and pictures of the run's PDF files, read once."""
        if not hasattr(self, "_parts"):
            self._parts = written(files.parts(self.files.filter("decoder = 'pdf' AND error IS NULL")), "parts")
        return self._parts

    def pages(self) -> DataFrame:
        """(path, file_type, page_number, markdown, provider, metadata, error) of every page, cleaned and enriched; a file that can't be read gives one row
        with its error. What models and recognisers gave is written before it is used."""
        s = self.settings
        strategies = {r.route for r in self.files.select("route").distinct().collect()}
        direct = self._direct()
        if "refine" in strategies:
            direct = self._refined(direct)
        if "hybrid" in strategies:
            direct = self._described(direct)
        out = _pages(direct)
        if "ocr" in strategies:
            out = out.union(self._read())
        if "vlm" in strategies:
            out = out.union(self._seen())
        out = out.drop("route").withColumn("markdown", F.when(F.col("error").isNull(), clean_markdown(F.col("markdown"))))
        keys = ["path", "page_number"]
        if s.extract_images:
            saved = files.save_pictures(self.parts().filter("kind = 'picture'"), s.output_dir)
            log.info("%d pictures exported", saved.count())
            out = enrich.with_pictures(out, saved.select(*keys, "ord", "y", F.col("file").alias("path_")).withColumnRenamed("path_", "picture"), keys, "markdown", "picture")
        if s.enrich_links:
            out = enrich.with_links(out, self.parts().filter("kind = 'link'").select(*keys, "ord", "anchor", "uri"), keys, "markdown")
        return out

    def cost(self) -> DataFrame:
        """(requests, input_tokens, output_tokens, total_tokens, cost) of all calls of the run; a row of zeros where there was none."""
        schema = "provider string, input_tokens bigint, output_tokens bigint"
        every = self.spark.createDataFrame([], schema)
        for c in self.calls:
            every = every.union(c.filter("error is null").select("provider", "input_tokens", "output_tokens"))
        prices = self.spark.createDataFrame(list(self.tools.models.prices) if self.tools.models else [], "provider string, input_price double, output_price double")
        return usage.total(every.join(prices, "provider", "left"))


def picture_counts(parts: DataFrame) -> DataFrame:
    """(path, page_number, n) of the pages that hold pictures."""
    return parts.filter("kind = 'picture'").groupBy("path", "page_number").agg(F.count("*").alias("n"))


def documents_of(pages: DataFrame, settings: Settings) -> DataFrame:
    """(path, markdown) of the files that could be read. Page tags go only to formats that a model can read."""
    ok = pages.filter("error is null").withColumn("tie", F.lit(0))
    if not settings.page_tags:
        return assembly.assembled(ok, "path", "page_number", "markdown", "tie")
    tagged = F.col("file_type").isin("pdf", "docx", "pptx", "image")
    plain = assembly.assembled(ok.filter(~tagged), "path", "page_number", "markdown", "tie")
    return plain.union(assembly.assembled(ok.filter(tagged), "path", "page_number", "markdown", "tie", page_tags=True))


def report(pages: DataFrame, documents: DataFrame, strategy: str = "fast") -> DataFrame:
    """(path, pages, strategy, providers, output, status) of every file."""
    known = assembly.report(pages.filter("error is null"), "path", "provider")
    every = pages.groupBy("path").agg(F.max("error").alias("error")).join(known, "path", "left").join(documents.select("path", F.lit(True).alias("_d")), "path", "left")
    output = F.when(F.col("_d") & F.col("error").isNull(), F.concat(stem(F.col("path")), F.lit(".md")))
    return every.select("path", F.coalesce("pages", F.lit(0)).alias("pages"), F.lit(strategy).alias("strategy"), F.coalesce("providers", F.lit("-")).alias("providers"), output.alias("output"), F.when(F.col("error").isNull(), "OK").otherwise(F.concat(F.lit("FAIL: "), "error")).alias("status"))


def tally(reported: DataFrame) -> DataFrame:
    """(succeeded, failed) over the files of a report."""
    return reported.agg(F.count_if(F.col("status") == "OK").alias("succeeded"), F.count_if(F.col("status") != "OK").alias("failed"))


def pages_of(spark: SparkSession, folder: str, recursive: bool = True, settings: Settings = Settings(), tools: Tools = Tools(), on_page: OnPage | None = None) -> DataFrame:
    """Pages of one file, or of all known files below a folder."""
    return Run(files.scanned(spark, folder, recursive), settings, tools, on_page).pages()


def batch(spark: SparkSession, folder: str, settings: Settings = Settings(), tools: Tools = Tools()) -> DataFrame:
    """(path, markdown) of all files that could be read; the others are left out."""
    return documents_of(pages_of(spark, folder, True, settings, tools), settings)


def parse(spark: SparkSession, folder: str, settings: Settings, recursive: bool = False, force: bool = False, tools: Tools = Tools(), on_page: OnPage | None = None) -> tuple[DataFrame, DataFrame]:
    """Read, write and report one file or all below ``folder``; gives the report and the cost of calls. Files whose output is there are skipped
    unless ``force``."""
    found = files.scanned(spark, folder, recursive)
    if not force:
        found = routing.pending(found, files.listed(spark, settings.output_dir, "*.md"), "path", "file")
    run = Run(found, settings, tools, on_page)
    log.debug("strategy %s, output %s", settings.strategy, settings.output_dir)
    pages = written(run.pages(), "pages")
    failed = pages.filter("error is not null").select("path")
    documents = documents_of(pages.join(failed, "path", "left_anti"), settings)
    files.save_documents(documents, "path", "markdown", settings.output_dir)
    return report(pages, documents, settings.strategy), run.cost()
