"""Reading text from page images by a recogniser that the caller gives, or an installed one."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import layout

#: Four corners (x, y), the text and how sure it is.
Box = tuple[Sequence[tuple[float, float]], str, float]
#: image -> boxes. It runs on executors, so it must be picklable; what it loads it keeps for the worker.
Recogniser = Callable[[bytes], list[Box]]
PROVIDER = "pp-ocrv5"
BLOCK = "path string, page_number int, block_id bigint, x_min double, y_min double, x_max double, y_max double, text string, confidence double, error string"

_held: dict = {}


def available() -> bool:
    """Whether a recogniser is installed."""
    return importlib.util.find_spec("rapidocr") is not None


def installed(image: bytes) -> list[Box]:
    """The installed recogniser, loaded once for each worker."""
    if "engine" not in _held:
        if not available():
            raise RuntimeError("reading scanned pages needs a recogniser: install rapidocr and onnxruntime, or give one")
        from rapidocr import OCRVersion, RapidOCR

        _held["engine"] = RapidOCR(params={"Det.ocr_version": OCRVersion.PPOCRV5, "Rec.ocr_version": OCRVersion.PPOCRV5})
    got = _held["engine"](image)
    return [] if got.boxes is None else [(corners, text, float(sure)) for corners, text, sure in zip(got.boxes.tolist(), got.txts, got.scores)]


def reset() -> None:
    """Forget what this worker has loaded."""
    _held.clear()


def detected(images: DataFrame, recogniser: Recogniser = installed) -> DataFrame:
    """Text blocks of page images (path, page_number, content): the box around each's corners; blank texts are left out.

    A page that can't be read gives one row with its error; a page without text one with neither.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(BLOCK))

    def read(path: str, page: int, content: bytes | None) -> list[tuple]:
        try:
            boxes = recogniser(content or b"")
        except Exception as e:  # a page's failure stays with the page
            return [(path, page, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
        out = []
        for i, (corners, text, sure) in enumerate(boxes):
            if text and text.strip():
                x, y = [float(c[0]) for c in corners], [float(c[1]) for c in corners]
                out.append((path, page, i, min(x), min(y), max(x), max(y), text.strip(), float(sure), None))
        return out or [(path, page, *[None] * 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*read(*row)), schema)], schema=schema)

    return images.select("path", "page_number", "content").mapInArrow(run, BLOCK)


def pages(blocks: DataFrame) -> DataFrame:
    """(path, page_number, markdown, provider, error) of every page of ``detected``; pages without text are empty."""
    keys = ["path", "page_number"]
    each = blocks.groupBy(*keys).agg(F.max("error").alias("error"))
    text = layout.lines_markdown(layout.text_lines(blocks.filter("text is not null"), keys, "block_id"), keys)
    out = each.join(text, keys, "left")
    return out.select(*keys, F.when(F.col("error").isNull(), F.coalesce("markdown", F.lit(""))).alias("markdown"), F.lit(PROVIDER).alias("provider"), "error")
