"""The decoders in SQL: ``SELECT p.* FROM files, LATERAL decode_pages(path, content) p``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Decode:
    """A row for each page of a file; a file that can't be read gives one with its error."""

    def eval(self, path: str, content: bytes):
        from pagemill.operators.routing import DECODERS
        from pagemill.sources.decoders import DECODE, PROVIDERS

        name = (path or "").rsplit("/", 1)[-1].lstrip(".")
        suffix = name.rsplit(".", 1)[1].lower() if "." in name else ""
        kind = next((n for n, _, _, exts in DECODERS if suffix in exts.split()), None)
        if kind is None:
            yield None, None, None, f"Unsupported file type: .{suffix}" if suffix else f"Cannot determine file type for: {path or ''}"
            return
        try:
            pages, _ = DECODE[kind](content or b"", path)
        except Exception as e:  # one bad file must not end the query
            yield None, None, None, f"{type(e).__name__}: {e}"
            return
        for number, text in enumerate(pages, 1):
            yield number, text, PROVIDERS.get(kind, ""), None


def registered(spark: SparkSession) -> None:
    """Enter ``decode_pages`` in a session. The column functions of ``operators`` serve DataFrames; this is for those who write SQL."""
    spark.udtf.register("decode_pages", udtf(Decode, returnType="page_number int, markdown string, provider string, error string"))
