"""Decoders on files built here, the scan and the sinks."""

import io
import struct
import zipfile
import zlib

from pagemill.sources import decoders, files, html


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


R = 'xmlns:r="http://r"'
W = 'xmlns:w="http://w"'


def docx():
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title", "H1") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl>" + p("text") + p("point", "L")
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="L"><w:name w:val="List Bullet"/></w:style></w:styles>'
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "docProps/core.xml": '<c xmlns:d="d"><d:title>T</d:title><d:creator>A</d:creator></c>'})


def xlsx():
    sheet = f'<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row/><row><c r="A3"><v>5</v></c><c r="B3"><f>SUM(A3:A3)</f><v>5</v></c></row></sheetData><mergeCells><mergeCell ref="A3:A4"/></mergeCells></worksheet>'
    return packed({
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S" sheetId="1" r:id="x1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/s.xml": sheet,
    })


def pptx():
    shape = lambda *ps: "<p:sp xmlns:p='p' xmlns:a='a'><p:txBody>" + "".join(f"<a:p><a:pPr lvl='{v}'/><a:r><a:t>{t}</a:t></a:r></a:p>" for t, v in ps) + "</p:txBody></p:sp>"
    return packed({
        "ppt/presentation.xml": f"<p:p xmlns:p='p' {R}><p:sldIdLst><p:sldId id='9' r:id='b'/><p:sldId id='8' r:id='a'/></p:sldIdLst></p:p>",
        "ppt/_rels/presentation.xml.rels": "<R><R Id='a' Target='slides/s1.xml'/><R Id='b' Target='slides/s2.xml'/></R>",
        "ppt/slides/s1.xml": f"<s>{shape(('One', 0))}</s>", "ppt/slides/s2.xml": f"<s>{shape(('Two', 0), ('deep', 1), ('flat', 0))}</s>",
    })


def epub():
    return packed({
        "META-INF/container.xml": "<c><rootfiles><rootfile full-path='o/p.opf'/></rootfiles></c>",
        "o/p.opf": "<p xmlns:d='d'><metadata><d:title>B</d:title><d:creator>C</d:creator><d:language>en</d:language></metadata><manifest><item href='1.x' media-type='application/xhtml+xml'/><item href='2.x' media-type='application/xhtml+xml'/></manifest></p>",
        "o/1.x": "<body><p> </p></body>", "o/2.x": "<body><h1>Two</h1></body>",
    })


def pdf():
    stream = zlib.compress(b"BT /F 24 Tf 50 700 Td (Head) Tj /F 12 Tf 0 -30 Td [(bo) -3 (dy \\(x\\))] TJ 0 -20 Td (more) Tj ET")
    body = b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Type /Pages /Kids [3 0 R]>> endobj 3 0 obj <</Type /Page /Contents 4 0 R>> endobj "
    return b"%PDF-1.4\n" + body + b"4 0 obj <</Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj 5 0 obj <</Title (My doc)>> endobj"


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 2)


def test_decoders():
    assert decoders.text(b"a\r\nb\xff", "x.txt")[0] == ["a\nb�"]
    assert decoders.separated(b"n,v\n\n1,\"a\nb\"\n , \n", "d/t.csv") == (["## t\n\n| n | v |\n| --- | --- |\n| 1 | a\nb |"], {"row_count": "4", "delimiter": ","})
    assert decoders.rtf(rb"{\rtf1{\fonttbl x}Caf\'e9 \u8364?\par{\b bold} {\*\gen no}end}", "x.rtf")[0] == ["Café €\nbold end"]
    assert decoders.docx(docx(), "x.docx")[0] == ["# Title\ntext\n- point\n\n| a | b |\n| --- | --- |\n| 1 |"]
    assert decoders.docx(docx(), "x.docx")[1]["author"] == "A"
    assert decoders.pptx(pptx(), "x.pptx") == (["## Two\n- deep\nflat", "## One"], {"title": "", "author": "", "subject": "", "slide_count": "2"})
    assert decoders.xlsx(xlsx(), "x.xlsx")[0] == ["## S\n\n| name | n |\n| --- | --- |\n| 5 | 5 <!-- sum: =SUM(A3:A3) --> |\n| 5 |  |"]
    assert decoders.epub(epub(), "x.epub") == (["# Two"], {"title": "B", "author": "C", "language": "en"})
    pages, about = decoders.DECODE["pdf"](pdf(), "x.pdf")  # blocks of a page are parted by blank lines
    assert pages == ["# Head\n\nbody (x)\n\nmore"] and about["title"] == "My doc" and about["page_count"] == "1"
    assert decoders.image(PNG, "d/p.png")[0] == ["![p.png (3x2, PNG)](p.png)"] and decoders.image(b"?", "p.tif")[0] == ["![p.tif (?x?, TIF)](p.tif)"]


def test_html():
    assert html.markdown("<body>t<!--c--><h2>A <b>b</b></h2><p>x<p>y<ul><li>1<li> <li>2</ul><ol><li><li>z</ol><pre> k\n</pre><img src=s><blockquote>q</blockquote><em>e</em><br><script>no</script>") == "t\nc\n\n## Ab\n\nx\n\ny\n\n- 1\n- 2\n\n2. z\n\n\n```\n k\n\n```\n\n![image](s)\n> q\n*e*".replace("\n\n\n", "\n\n")
    assert html.page("<title>T</title><body><p>x</p>") == "# T\n\nx" and html.page("<title>T</title><body><h1>T</h1>") == "# T"
    assert html.metadata("<meta name=description content='d &amp; e'>") == {"title": "", "description": "d & e"}
    assert html.markdown("") == ""


def test_scan_decode_save(spark, tmp_path):
    given = tmp_path / "in" / "sub"
    given.mkdir(parents=True)
    for name, data in {"a.txt": b"hi", "b.docx": b"broken", "sub/c.docx": docx(), "D.PDF": pdf(), "e.zip": b""}.items():
        (tmp_path / "in" / name).write_bytes(data)
    found = files.scanned(spark, str(tmp_path / "in"))
    assert found.count() == 3 and files.scanned(spark, str(tmp_path / "in"), recursive=False).count() == 2
    pages = files.decoded(found).collect()
    assert {r.path.rsplit("/", 1)[-1]: (r.page_number, r.error is None) for r in pages} == {"a.txt": (1, True), "b.docx": (None, False), "c.docx": (1, True)}
    docs = spark.createDataFrame([("x/a.pdf", "one"), ("x/a.txt", "two"), ("b.md", None)], "path string, markdown string")
    files.save_documents(docs.filter("markdown is not null"), "path", "markdown", str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.md": "two"}
    pictures = spark.createDataFrame([("x/a.pdf", 1, 0, b"p", "GIF")], "path string, page_number int, ord int, content binary, ext string")
    assert files.save_pictures(pictures, str(tmp_path / "out")).first().file == "images/a_p1_0.png" and (tmp_path / "out/images/a_p1_0.png").read_bytes() == b"p"


def test_decoders_in_sql(spark):
    from pagemill.sources import sql

    sql.registered(spark)
    given = [("a.txt", b"hi"), ("b.docx", b"broken"), ("c.docx", docx()), ("d.zzz", b""), ("e", b""), (None, None)]
    spark.createDataFrame(given, "path string, content binary").createOrReplaceTempView("some_files")
    rows = {r.path: (r.page_number, r.markdown, r.error) for r in spark.sql("SELECT f.path, p.* FROM some_files f, LATERAL decode_pages(f.path, f.content) p").collect()}
    assert rows["a.txt"] == (1, "hi", None) and rows["b.docx"][0] is None and rows["b.docx"][2] and rows["c.docx"][1].startswith("# Title")
    assert rows["d.zzz"][2] == "Unsupported file type: .zzz" and rows["e"][2].startswith("Cannot determine") and rows[None][2].startswith("Cannot determine")
