"""Files as a source: scan, dispatch, decode; and the sinks that write documents and pictures, to any file system that pyarrow knows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import stem
from pagemill.operators.routing import DECODERS, UNSUPPORTED, dispatched
from pagemill.sources.custom import CUSTOM

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
PAGE = "path string, file_type string, page_number int, markdown string, provider string, metadata map<string,string>, error string"
PART = "path string, page_number int, kind string, ord int, y double, anchor string, uri string, content binary, ext string"


def _place(folder: str):
    """(file system, path in it) of a folder: an address of any scheme, or a path of this machine."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1) if folder.startswith("file:") else folder)
    import os

    return fs.LocalFileSystem(), os.path.abspath(folder)


def exists(place: str) -> str | None:
    """file, folder or None."""
    from pyarrow import fs

    system, path = _place(place)
    kind = system.get_file_info(path).type
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(kind)


def scanned(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files of the known suffixes below a folder, matched as they are written, so ``A.PDF`` is none of them; or one file of any suffix.

    A place that isn't there is an error, also before any file is read.
    """
    kind = exists(folder)
    if kind is None:
        raise FileNotFoundError(f"File not found: {folder}")
    reader = spark.read.format("binaryFile")
    if kind == "file":
        return reader.load(folder)
    exts = ",".join([*(e for _, _, _, x in DECODERS for e in x.split()), *CUSTOM])
    return reader.option("pathGlobFilter", f"*.{{{exts}}}").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream: each file once, remembered by the query's checkpoint."""
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(folder)


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file) of what a folder holds, listed by Spark; none where it isn't there. Contents are not read."""
    if exists(folder) != "folder":
        return spark.createDataFrame([], "file string")
    return spark.read.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))


def decoded(files: DataFrame) -> DataFrame:
    """One row per page; a file that can't be read gives one row with its error and no page. Only needed columns reach Python.

    A decoder that has no text of its own (NotImplementedError) gives one page that says so.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema, custom = to_arrow_schema(_parse_datatype_string(PAGE)), dict(CUSTOM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagemill.sources.decoders import DECODE, PROVIDERS

        for batch in batches:
            for path, kind, file_type, error, content in zip(*(batch.column(i).to_pylist() for i in range(5))):
                pages, meta, provider = [], {}, PROVIDERS.get(kind, "")
                if error is None:
                    try:
                        own = custom.get(kind)
                        decode, provider = (own.decode, own.provider) if own else (DECODE[kind], provider)
                        pages, meta = decode(content or b"", path)
                    except NotImplementedError:
                        pages, provider = [UNSUPPORTED.replace("{name}", path.rsplit("/", 1)[-1])], "local"
                    except Exception as e:  # one bad file must not end the job
                        error = f"{type(e).__name__}: {e}"
                rows = [(path, file_type, i, p, provider, list(meta.items()), None) for i, p in enumerate(pages, 1)] if error is None else [(path, file_type, None, None, None, None, error)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    known = files if "decoder" in files.columns else dispatched(files, "path")
    return known.select("path", "decoder", "file_type", "error", "content").mapInArrow(run, PAGE)


def parts(files: DataFrame) -> DataFrame:
    """Links and pictures of PDF files (path, content): kind is link (with anchor and uri) or picture (with y, content and ext), ``ord`` counts within
    its page and kind. Pictures whose coding can't be read have no content; files that can't be read give no row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagemill.sources import pdf

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    pages, _ = pdf.opened(content or b"")
                except Exception:  # its error is in the row of its pages
                    continue
                for n, page in enumerate(pages, 1):
                    rows = [(path, n, "link", i, None, a, u, None, None) for i, (a, u) in enumerate(pdf.anchors(page))]
                    rows += [(path, n, "picture", i, y, None, None, c, e) for i, (y, _, c, e) in enumerate(sorted(page.pictures, key=lambda p: p[:2]))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, PART)


def save_documents(documents: DataFrame, path: str, markdown: str, folder: str) -> None:
    """``<stem>.md`` for each document, written aside and renamed; of several documents of one stem the last by path stays.

    ``folder`` is an address that every executor reaches, or a path that all share.
    """
    last = documents.groupBy(stem(F.col(path)).alias("stem")).agg(F.max_by(markdown, path).alias("text"))
    _write(last.select(F.concat("stem", F.lit(".md")).alias("name"), F.encode("text", "UTF-8").alias("data")), folder)


def save_pictures(pictures: DataFrame, folder: str) -> DataFrame:
    """Pictures (path, page_number, ord, content, ext) as ``images/<stem>_p<page>_<ord>.<ext>``; gives them with their ``file``. Those without
    content are left out."""
    ext = F.when(F.lower("ext").isin("png", "jpg", "jpeg"), F.lower("ext")).otherwise("png")
    named = pictures.filter("content is not null").withColumn("file", F.concat(F.lit("images/"), stem(F.col("path")), F.format_string("_p%d_%d.", "page_number", "ord"), ext))
    _write(named.select(F.col("file").alias("name"), F.col("content").alias("data")), folder)
    return named


def _write(files: DataFrame, folder: str) -> None:
    def run(rows) -> None:
        import uuid

        system, base = _place(folder)
        made = set()
        for r in rows:
            target = f"{base.rstrip('/')}/{r.name}"
            parent = target.rpartition("/")[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            aside = f"{target}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(aside) as f:
                f.write(r.data)
            system.move(aside, target)

    files.foreachPartition(run)
