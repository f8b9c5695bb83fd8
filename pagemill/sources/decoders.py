"""File bytes to pages with the standard library: one function per format, ``bytes, name -> (pages, metadata)``.

A decoder may raise; ``pagemill.sources.files.decoded`` turns that into an error column, so no file ends a job.
"""

from __future__ import annotations

import csv
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

from pagemill.operators.tables import FORMULAS
from pagemill.sources import html, pdf

Decoded = tuple[list[str], dict[str, str]]


def lines_of(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def grid(rows: list[list[str]], title: str = "", pad: bool = True) -> str:
    if not rows:
        return ""
    wide = max(map(len, rows)) if pad else 0
    shown = [f"| {' | '.join([*r, *[''] * (wide - len(r))])} |" for r in rows]
    rule = f"| {' | '.join(['---'] * max(wide, len(rows[0])))} |"
    return (f"## {title}\n\n" if title else "") + "\n".join([shown[0], rule, *shown[1:]])


def filled_rows(rows: list[list[str]]) -> list[list[str]]:
    return [r for r in rows if any(c.strip() for c in r)]


def text(data: bytes, name: str) -> Decoded:
    return [lines_of(data)], {"size_bytes": str(len(data)), "encoding": "utf-8"}


def separated(data: bytes, name: str) -> Decoded:
    mark = "\t" if name.lower().endswith(".tsv") else ","
    rows = list(csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""), delimiter=mark))
    return [grid(filled_rows(rows), name.rsplit("/", 1)[-1].rsplit(".", 1)[0])], {"row_count": str(len(rows)), "delimiter": mark}


def web(data: bytes, name: str) -> Decoded:
    """The article of a page, or all of it where none stands out."""
    source = lines_of(data)
    root = html.tree(source)
    return [html.page(source, root=root, article=True)], html.metadata(source, root)


def rtf(data: bytes, name: str) -> Decoded:
    """Plain text of RTF: groups that hold no text are skipped, \\u and \\' escapes decoded."""
    out, stack, skip, uc, pending = [], [], False, 1, 0
    silent = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "datastore", "listtable"}
    signs = {"par": "\n", "line": "\n", "tab": "\t", "cell": "|", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "page": "\n"}
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
    for m in token.finditer(lines_of(data)):
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append((skip, uc))
        elif brace == "}":
            skip, uc = stack.pop() if stack else (False, 1)
        elif word:
            if word in silent:
                skip = True
            elif not skip and word == "u" and number:
                out.append(chr(int(number) % 65536))
                pending = uc
            elif word == "uc" and number:
                uc = int(number)
            elif not skip:
                out.append(signs.get(word, ""))
        elif sign == "*":
            skip = True
        elif not skip:
            piece = bytes([int(code, 16)]).decode("cp1252", "replace") if code else {"~": "\xa0", "_": "-", "-": ""}.get(sign, sign) if sign else plain or ""
            out.append(piece[pending:])
            pending = max(0, pending - len(piece))
    return ["".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()], {"size_bytes": str(len(data))}


def _parts(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [] if e is None else [x for x in e.iter() if _local(x) in names]


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    root = _xml(z, "docProps/core.xml")
    own = {} if root is None else {_local(e): e.text or "" for e in root}
    return {"title": own.get("title", ""), "author": own.get("creator", ""), "subject": own.get("subject", ""), "created": own.get("created", ""), "modified": own.get("modified", "")}


def _attr(e: ET.Element, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def _links(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, file = part.rpartition("/")
    rels = _xml(z, f"{folder}/_rels/{file}.rels")
    return {} if rels is None else {_attr(r, "Id"): (t[1:] if (t := _attr(r, "Target")).startswith("/") else f"{folder}/{t}") for r in rels}


def docx(data: bytes, name: str) -> Decoded:
    """Paragraphs by their styles, then all tables."""
    with _parts(data) as z:
        body = _all(_xml(z, "word/document.xml"), "body")[0]
        styles = {_attr(s, "styleId"): _attr(n[0], "val") for s in _all(_xml(z, "word/styles.xml"), "style") if (n := _all(s, "name"))}
        said = lambda p: "".join({"t": e.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_local(e), "") for e in p.iter())
        out = []
        for p in (e for e in body if _local(e) == "p"):
            words = said(p)
            if words.strip():
                used = _all(p, "pStyle")
                style = styles.get(_attr(used[0], "val"), _attr(used[0], "val")).lower() if used else ""
                level = next((k for k in (1, 2, 3) if f"heading {k}" in style), 4 if "heading" in style else 0)
                out.append("#" * level + " " + words.strip() if level else f"- {words.strip()}" if "list" in style else words.strip())
        for t in (e for e in body if _local(e) == "tbl"):
            rows = [["\n".join(said(p) for p in c if _local(p) == "p").strip().replace("\n", " ") for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"]
            out += ["", grid(rows, pad=False)]
        return ["\n".join(out)], _core(z)


def pptx(data: bytes, name: str) -> Decoded:
    """A page per slide in the presentation's order: the first text as its title, deeper paragraphs as points, tables in place."""
    with _parts(data) as z:
        show = _xml(z, "ppt/presentation.xml")
        rels = _links(z, "ppt/presentation.xml")
        slides = [rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))] for s in _all(show, "sldId")]
        pages = []
        for slide in slides:
            out, titled = [], False
            for shape in _all(_xml(z, slide), "sp", "graphicFrame"):
                for table in _all(shape, "tbl"):
                    rows = [["".join(t.text or "" for t in _all(c, "t")).strip() for c in _all(r, "tc")] for r in _all(table, "tr")]
                    out.append(grid(rows, pad=False))
                if _local(shape) == "sp":
                    for p in _all(shape, "p"):
                        words = "".join(t.text or "" for t in _all(p, "t")).strip()
                        if words:
                            deep = any(int(_attr(x, "lvl", "0")) > 0 for x in _all(p, "pPr"))
                            out.append(f"- {words}" if titled and deep else words if titled else f"## {words}")
                            titled = True
            pages.append("\n".join(out))
        meta = _core(z)
        return pages, {k: meta[k] for k in ("title", "author", "subject")} | {"slide_count": str(len(slides))}


def _note(formula: str) -> str:
    name = re.match(r"=\s*([A-Za-z]+)\(", formula)
    return f" <!-- {FORMULAS.get(name[1].upper(), 'formula') if name else 'formula'}: {formula} -->" if formula.startswith("=") else ""


def _place(ref: str) -> tuple[int, int]:
    letters, number = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for x in letters:
        col = col * 26 + ord(x) - 64
    return int(number), col


def split_grid(rows: list[list[str]], title: str, most: int = 50) -> list[str]:
    """Tables of a sheet: over ``most`` rows it is cut before each category row but the first data row."""
    wide = max(map(len, rows), default=0)
    category = lambda r: bool(r and r[0].strip()) and sum(bool(c.strip()) for c in r[1:]) <= 1 and wide > 2
    if len(rows) <= most:
        return [grid(rows, title)]
    starts = [1, *(i for i in range(2, len(rows)) if category(rows[i]))]
    if len(starts) < 2:
        return [grid(rows, title)]
    return [grid([rows[0], *rows[a:b]], title if a == 1 else f"{title} — {rows[a][0].strip()}") for a, b in zip(starts, [*starts[1:], len(rows)])]


#: Number formats that show dates or times without naming them. Fixed values.
DATES = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def _dated(z: zipfile.ZipFile) -> set[int]:
    """The cell styles of a workbook that show numbers as dates."""
    root = _xml(z, "xl/styles.xml")
    own = {_attr(f, "numFmtId"): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", _attr(f, "formatCode")).lower() for f in _all(root, "numFmt")}
    shows = lambda i: int(i or 0) in DATES or bool(re.search(r"[dyhs]", own.get(i, "")))
    return {k for xfs in _all(root, "cellXfs")[:1] for k, xf in enumerate(_all(xfs, "xf")) if shows(_attr(xf, "numFmtId", "0"))}


def _moment(serial: str, since_1904: bool) -> str:
    """A day number as a date and time, a part of a day as a time."""
    from datetime import datetime, timedelta

    try:
        days = float(serial)
        if days < 1 and not since_1904:
            return str((datetime(2000, 1, 1) + timedelta(seconds=round(days * 86400))).time())
        return str(datetime(1904, 1, 1) + timedelta(seconds=round(days * 86400)) if since_1904 else datetime(1899, 12, 30 if days >= 60 else 31) + timedelta(seconds=round(days * 86400)))
    except (ValueError, OverflowError):
        return serial


def xlsx(data: bytes, name: str) -> Decoded:
    """Sheets as tables: merged values over their ranges, notes on formulas, blank rows left out, large sheets split."""
    with _parts(data) as z:
        rels = _links(z, "xl/workbook.xml")
        shared = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(_xml(z, "xl/sharedStrings.xml"), "si")]
        pages, names, dated = [], [], _dated(z)
        since_1904 = any(_attr(p, "date1904") in ("1", "true") for p in _all(_xml(z, "xl/workbook.xml"), "workbookPr"))
        for sheet in _all(_xml(z, "xl/workbook.xml"), "sheet"):
            names.append(_attr(sheet, "name"))
            root = _xml(z, rels[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))])
            cells: dict[tuple[int, int], str] = {}
            notes: dict[tuple[int, int], str] = {}
            for c in _all(root, "c"):
                at, kind = _place(_attr(c, "r")), _attr(c, "t")
                value = next((v.text or "" for v in c if _local(v) == "v"), "")
                if kind == "s" and value:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in _all(c, "t"))
                elif kind == "b":
                    value = {"1": "True", "0": "False"}.get(value, value)
                elif kind in ("", "n") and value and int(_attr(c, "s", "0") or 0) in dated:
                    value = _moment(value, since_1904)
                elif kind == "d":
                    value = value.replace("T", " ")
                cells[at] = value
                formula = next((f.text for f in c if _local(f) == "f" and f.text), None)
                if formula:
                    notes[at] = _note(f"={formula}")
            for m in _all(root, "mergeCell"):
                (r1, c1), (r2, c2) = map(_place, (_attr(m, "ref").split(":") * 2)[:2])
                cells |= {(r, c): cells.get((r1, c1), "") for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
            last, wide = max((r for r, _ in cells), default=0), max((c for _, c in cells), default=0)
            rows = filled_rows([[cells.get((r, c), "") + notes.get((r, c), "") for c in range(1, wide + 1)] for r in range(1, last + 1)])
            if rows:
                pages += split_grid(rows, names[-1])
        return pages, {"sheet_names": ", ".join(names), "sheet_count": str(len(names))}


def epub(data: bytes, name: str) -> Decoded:
    """Chapters in the order of the manifest; blank ones get no number."""
    with _parts(data) as z:
        place = _attr(_all(_xml(z, "META-INF/container.xml"), "rootfile")[0], "full-path")
        package, folder = _xml(z, place), place.rpartition("/")[0]
        pages = []
        for item in _all(package, "item"):
            if _attr(item, "media-type") == "application/xhtml+xml" and "nav" not in _attr(item, "properties").split():
                chapter = html.markdown(lines_of(z.read(f"{folder}/{_attr(item, 'href')}".lstrip("/"))))
                if chapter.strip():
                    pages.append(chapter)
        first = lambda k: next((e.text or "" for e in _all(package, k)), "")
        return pages, {"title": first("title"), "author": first("creator"), "language": first("language")}


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG", *struct.unpack(">II", data[16:24])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return "BMP", w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        w, h = struct.unpack("<HH", data[26:30])
        return "WEBP", w & 0x3FFF, h & 0x3FFF
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(order + "I", data[4:8])[0]
        tags = {}
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            tag, kind = struct.unpack(order + "HH", data[at + 2 + 12 * k : at + 6 + 12 * k])
            tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), data[at + 10 + 12 * k : at + (12 if kind == 3 else 14) + 12 * k])[0]
        return "TIFF", tags[256], tags[257]
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + size
    return None


def image(data: bytes, name: str) -> Decoded:
    file = name.rsplit("/", 1)[-1]
    got = image_size(data)
    kind, w, h = got or (file.rsplit(".", 1)[-1].upper(), "?", "?")
    return [f"![{file} ({w}x{h}, {kind})]({file})"], {"format": str(kind), "width": str(w), "height": str(h)}


DECODE: dict[str, Callable[[bytes, str], Decoded]] = {
    "text": text, "csv": separated, "html": web, "xml": web, "epub": epub, "rtf": rtf, "docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf.decode, "image": image,
}
PROVIDERS = {"pdf": "pymupdf", "image": "local"}
