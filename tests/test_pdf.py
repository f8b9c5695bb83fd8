"""PDF files built here: object streams, fonts, tables, links, pictures, broken parts."""

import zlib

import pytest

from pagemill.sources import decoders, html, pdf, pictures
from pagemill.sources.pdf import Span


def stream(about, data):
    return b"<<" + about + b"/Length %d>>\nstream\n" % len(data) + data + b"\nendstream"


CMAP = b"1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0004> <00e9> endbfchar 1 beginbfrange <0005> <0006> [<0066006C> <0069>] endbfrange"
GRID = b"0.5 w 50 600 m 250 600 l S 50 580 m 250 580 l S 50 560 m 250 560 l S 50 560 m 50 600 l S 150 560 m 150 600 l S 250 560 m 250 600 l S "
CONTENT = (
    b"BT /F1 24 Tf 50 720 Td <0001000200030004> Tj ET BT /F2 10 Tf 50 690 Td (Read the ) Tj (report now) Tj 0 -12 Td (second line.) Tj ET " + GRID
    + b"BT /F2 10 Tf 60 586 Td (Name) Tj 100 0 Td (Qty) Tj -100 -20 Td (bolt) Tj 100 0 Td (12) Tj ET q 100 0 0 50 60 400 cm /I Do Q q 10 0 0 10 5 5 cm /J Do Q /X Do"
)
PACKED = {
    1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 3 0 R]/Count 1/MediaBox[0 0 600 800]>>",
    3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 7 0 R/F2 8 0 R>>/XObject<</I 6 0 R/J 11 0 R/X 12 0 R>>>>/Annots[9 0 R]>>",
    7: b"<</Type/Font/Subtype/Type0/BaseFont/X/ToUnicode 5 0 R/DescendantFonts[<</W[1[600 600 600 600]]>>]>>",
    8: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold/FirstChar 32/Widths[" + b"500 " * 95 + b"]>>",
    9: b"<</Subtype/Link/Rect[94 688 130 700]/A<</S/URI/URI(https://a.example/r)>>>>", 10: b"<</Title(T\\351)/Author<FEFF00C9>>>",
}


def built(packed=PACKED, content=CONTENT, more=b""):
    plain = {
        4: stream(b"/Filter/FlateDecode", zlib.compress(content)), 5: stream(b"", CMAP), 6: stream(b"/Type/XObject/Subtype/Image/Width 2/Height 1/BitsPerComponent 8/ColorSpace/DeviceRGB", b"\xff\0\0\0\xff\0"),
        11: stream(b"/Subtype/Image/Filter/DCTDecode/Width 3/Height 3", b"\xff\xd8jpeg"), 12: stream(b"/Subtype/Form/Matrix[1 0 0 1 0 0]/Resources<</Font<</F2 8 0 R>>>>", b"BT /F2 10 Tf 50 100 Td (from a form) Tj ET"),
    }
    heads, body = [], b""
    for n, v in packed.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += v + b" "
    head = b" ".join(heads) + b" "
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % n + v + b"\nendobj\n" for n, v in plain.items())
    out += b"20 0 obj " + stream(b"/Type/ObjStm/N %d/First %d/Filter/FlateDecode" % (len(packed), len(head)), zlib.compress(head + body)) + b" endobj\n"
    return out + b"21 0 obj " + stream(b"/Type/XRef/Root 1 0 R/Info 10 0 R", b"") + b" endobj\n" + more


def test_page():
    pages, about = pdf.opened(built())
    assert len(pages) == 1 and about["title"] == "Té" and about["author"] == "É"
    want = ["# ABCé", "[**Read the report now**](https://a.example/r)\n**second line.**", "| Name | Qty |\n| --- | --- |\n| bolt | 12 |", "<!-- FPE_IMG:p1_0 -->\n\n![Image](image)", "**from a form**", "<!-- FPE_IMG:p1_1 -->\n\n![Image](image)"]
    assert pdf.markdown(pages[0], 1) == "\n\n".join(want)
    assert pdf.anchors(pages[0]) == [("report", "https://a.example/r")]
    (y, x, shown, ext), (_, _, other, kind) = pages[0].pictures
    assert (y, x, ext, kind, other) == (350.0, 60.0, "png", "jpg", b"\xff\xd8jpeg") and pictures.pixels(shown).tolist() == [[[255, 0, 0], [0, 255, 0]]]


def test_later_objects_and_broken_parts():
    changed = built(more=b"4 0 obj <<>> stream\nBT /F2 12 Tf 50 700 Td (new) Tj ( ) Tj [(te) -20 (xt)] TJ T* /None Tf 9 9 9 bad (x\nendstream endobj")
    assert pdf.markdown(pdf.opened(changed)[0][0], 1).split("\n\n")[0] == "[**new text**](https://a.example/r)"
    for data in (b"", b"no pdf", b"%PDF-1.4 nothing", built() + b"trailer <</Encrypt 1 0 R>>"):
        with pytest.raises(ValueError):
            pdf.opened(data)
    looped = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids[2 0 R 3 0 R]>> endobj 3 0 obj <</Type/Page/Contents 9 0 R>> endobj"
    assert [pdf.markdown(p, 1) for p in pdf.opened(looped)[0]] == [""]


def test_filters():
    doc = pdf.Document(b"%PDF-1.4\n1 0 obj 5 endobj")
    raw = bytes(range(12)) * 3
    up = b"".join(b"\x02" + bytes((raw[12 * r + i] - (raw[12 * (r - 1) + i] if r else 0)) % 256 for i in range(12)) for r in range(3))
    cases = {
        b"FlateDecode": (zlib.compress(raw), {}), b"ASCIIHexDecode": (raw.hex().encode() + b">", {}), b"ASCII85Decode": (__import__("base64").a85encode(raw) + b"~>", {}),
        b"Flate": (zlib.compress(up), {"DecodeParms": {"Predictor": 12, "Columns": 12}}),
    }
    for name, (data, more) in cases.items():
        about = {"Filter": pdf.Name({b"Flate": "FlateDecode"}.get(name, name.decode()))} | more
        assert doc.decoded(pdf.Stream(about, data)) == raw, name
    assert doc.decoded(pdf.Stream({"Filter": pdf.Name("LZWDecode")}, bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]))) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_simple_fonts():
    doc = pdf.Document(b"%PDF-1.4\n1 0 obj 5 endobj")
    font = pdf.Font(doc, {"Subtype": "Type1", "BaseFont": "Times-BoldItalic", "Encoding": {"Differences": [65, pdf.Name("eacute"), pdf.Name("uni4E2D"), pdf.Name("endash")]}})
    assert "".join(t for t, _, _ in font.read(b"ABCD\x80")) == "é中–D€" and font.flags == 18
    assert "".join(t for t, _, _ in pdf.Font(doc, {"Encoding": pdf.Name("MacRomanEncoding")}).read(b"\x8e")) == "é"


def test_lines_and_tables_of_nothing():
    page = pdf.Page(800.0)
    assert pdf.markdown(page, 1) == "" and pdf.tables(page) == [] and pdf.anchors(page) == []
    page.spans = [Span(0, 0, 10, 10, 10, 0, "a", (0,)), Span(40, 0, 50, 10, 10, 0, "b", (40,)), Span(12, 0, 20, 10, 10, 0, "c", (12,))]
    assert [[s.text for s in line] for line in pdf.lines(page.spans)] == [["a c", "b"]]
    page.rules = [(0.0, 0.0, 50.0, 0.0)] * 5
    assert pdf.tables(page) == []


def test_article():
    said = "The harbour board met on Monday, heard the report, and closed the old pier, which had stood since the flood. " * 3
    page = f"<title>T</title><body><div class='nav'>{'<a href=x>Menu item</a>' * 20}</div><div id=content><p>{said}</p><p>{said}</p></div><div class=sidebar><p>Related, related, related stories of the last week or so.</p></div>"
    text = html.page(page, article=True)
    assert text.startswith("# T\n\nThe harbour") and "Menu" not in text and "Related" not in text and "Menu" in html.page(page)
    assert html.article(html.tree("<p>short</p>")) is None and html.page("<p>short</p>", article=True) == "short"


def test_dates_in_sheets():
    from test_sources import R, packed

    sheet = '<worksheet><sheetData><row><c r="A1" s="1"><v>45000</v></c><c r="B1" s="2"><v>45000.5</v></c><c r="C1" s="1"><v>0.25</v></c><c r="D1" s="0"><v>45000</v></c><c r="E1" t="d"><v>2024-01-02T03:04:05</v></c></row></sheetData></worksheet>'
    book = packed({
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S" sheetId="1" r:id="x1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x1" Target="worksheets/s.xml"/></Relationships>',
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>', "xl/worksheets/s.xml": sheet,
    })
    assert decoders.xlsx(book, "x")[0][0].split("\n")[2] == "| 2023-03-15 00:00:00 | 2023-03-15 12:00:00 | 06:00:00 | 45000 | 2024-01-02 03:04:05 |"
