"""Page images: pictures as they are, PDF pages through a renderer, office files by way of PDF."""

from __future__ import annotations

import importlib.util
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: PDF, dots per inch -> a PNG for each page. It runs on executors.
Renderer = Callable[[bytes, int], list[bytes]]
#: file, suffix -> PDF.
Office = Callable[[bytes, str], bytes]
IMAGE = "path string, file_type string, page_number int, content binary, error string"


def can_render() -> bool:
    return importlib.util.find_spec("fitz") is not None or shutil.which("pdftoppm") is not None


def can_convert() -> bool:
    return shutil.which("soffice") is not None or shutil.which("libreoffice") is not None


def rendered(data: bytes, dpi: int) -> list[bytes]:
    """Pages by whichever renderer the executor has."""
    if importlib.util.find_spec("fitz") is not None:
        import fitz

        with fitz.open(stream=data, filetype="pdf") as doc:
            return [p.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72)).tobytes("png") for p in doc]
    if shutil.which("pdftoppm") is None:
        raise RuntimeError("rendering PDF pages needs pymupdf or pdftoppm, or a renderer of the caller's")
    with tempfile.TemporaryDirectory() as scratch:  # of this one call
        Path(scratch, "in.pdf").write_bytes(data)
        subprocess.run(["pdftoppm", "-r", str(dpi), "-png", "in.pdf", "p"], cwd=scratch, check=True, capture_output=True, timeout=600)
        return [p.read_bytes() for p in sorted(Path(scratch).glob("p*.png"))]


def converted(data: bytes, suffix: str, timeout: int = 120) -> bytes:
    """A PDF of an office file by the installed office program."""
    program = shutil.which("soffice") or shutil.which("libreoffice")
    if program is None:
        raise RuntimeError("turning office files into PDF needs LibreOffice, or a converter of the caller's")
    with tempfile.TemporaryDirectory() as scratch:  # of this one call
        Path(scratch, f"in.{suffix}").write_bytes(data)
        done = subprocess.run([program, "--headless", f"-env:UserInstallation=file://{scratch}/profile", "--convert-to", "pdf", "--outdir", scratch, f"{scratch}/in.{suffix}"], capture_output=True, timeout=timeout)
        out = Path(scratch, "in.pdf")
        if done.returncode or not out.exists():
            raise RuntimeError(f"the office program gave no PDF: {done.stderr.decode('utf-8', 'replace')[:200]}")
        return out.read_bytes()


def page_images(files: DataFrame, dpi: int = 200, renderer: Renderer = rendered, office: Office = converted) -> DataFrame:
    """One row per page of files (path, decoder, file_type, content); a file that can't be rendered gives one row with its error and no page.

    A picture is one page, as PNG where its format can be decoded, else as it is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(IMAGE))

    def images(decoder: str, path: str, data: bytes) -> list[bytes]:
        from pagemill.sources.pictures import Unreadable, to_png

        if decoder == "image":
            try:
                return [to_png(data)[0]]
            except (Unreadable, ValueError):
                return [data]
        return renderer(data if decoder == "pdf" else office(data, path.rsplit(".", 1)[-1].lower()), dpi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, decoder, kind, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                try:
                    rows = [(path, kind, n, c, None) for n, c in enumerate(images(decoder, path, content or b""), 1)]
                except Exception as e:  # one bad file must not end the job
                    rows = [(path, kind, None, None, f"{type(e).__name__}: {e}")]
                for r in rows:  # a page at a time, so that a batch never holds a whole document
                    yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(r, schema)], schema=schema)

    return files.select("path", "decoder", "file_type", "content").mapInArrow(run, IMAGE)
