"""Operators on hand-made cases, with nulls, empties, ties and repeats."""

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import assembly, enrich, layout, models_io, routing, tables
from pagemill.operators.assembly import merged_pages
from pagemill.operators.enrich import linked


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_clean_markdown(spark):
    cases = {
        None: "\n", "": "\n", " \n\t ": "\n", "a  \r\nb\r\r\r\rc": "a\nb\n\nc\n", "```markdown\n# T\n```": "# T\n", "```python\nx\n```": "```python\nx\n```\n",
        "a\n \n \nb": "a\n\n\nb\n", " x \n": "x\n", "```\na\n```\n\n```\nb\n```": "a\n```\n\n```\nb\n",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.clean_markdown(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


def test_suffix_and_stem(spark):
    rows = spark.createDataFrame([("a/b.PDF",), ("a.b/c",), (".env",), ("x.tar.gz",), (None,)], "p string").select(tx.suffix(F.col("p")), tx.stem(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("pdf", "b"), ("", "c"), ("", ".env"), ("gz", "x.tar"), ("", "")]


def test_tables(spark):
    grid = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1")), F.array(F.lit("2"), F.lit(None), F.lit("3")))
    assert one(spark, tables.table_text(grid, F.lit("T"))) == "## T\n\n| a | b |  |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 |  | 3 |"
    assert one(spark, tables.fixed_width_table(grid)) == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 |  |"
    assert one(spark, tables.table_text(F.array().cast("array<array<string>>"))) == ""
    notes = {"=SUM(A1)": " <!-- sum: =SUM(A1) -->", "=sumif(A)": " <!-- conditional sum: =sumif(A) -->", "=A1+B2": " <!-- formula: =A1+B2 -->", "SUM(A)": "", "": "", None: ""}
    rows = spark.createDataFrame([(k,) for k in notes], "f string").select("f", tables.formula_note(F.col("f")).alias("n")).collect()
    assert {r.f: r.n for r in rows} == notes
    cases = [(["Cat", "", ""], True), (["Cat", "x", ""], True), (["Cat", "x", "y"], False), ([" ", "", ""], False), ([None, None, None], False)]
    rows = spark.createDataFrame(cases, "c array<string>, want boolean").select("want", tables.category_row(F.col("c"), F.lit(3)).alias("is")).collect()
    assert all(r.want == r["is"] for r in rows)


def test_split_sheets(spark):
    rows = [("s", i, ["h1", "h2", "h3"] if i == 0 else ["Part", "", ""] if i in (1, 30) else [str(i), "x", "y"]) for i in range(60)]
    got = tables.split_sheets(spark.createDataFrame(rows, "s string, i int, c array<string>"), "s", "i", "c").orderBy("chunk_no").collect()
    assert [r.markdown.split("\n")[0] for r in got] == ["## s", "## s — Part"] and all("| h1 | h2 | h3 |" in r.markdown for r in got)
    short = tables.split_sheets(spark.createDataFrame(rows[:20], "s string, i int, c array<string>"), "s", "i", "c").collect()
    assert len(short) == 1


def test_heading_thresholds(spark):
    rows = [(1, 12.0), (1, 12.0), (1, 24.0), (2, 12.0), (2, 12.5), (3, None)]
    got = {r.p: r for r in layout.heading_thresholds(spark.createDataFrame(rows, "p int, s double"), "p", "s").collect()}
    assert abs(got[1].h1 - 21.6) < 1e-9 and got[1].h1 > got[1].h2 > got[1].h3 and got[2].h1 is None and 3 not in got


def test_lines(spark):
    box = "p int, id int, x_min double, y_min double, x_max double, y_max double, text string"
    rows = [(1, 1, 50.0, 10.0, 90.0, 30.0, "world"), (1, 2, 0.0, 11.0, 40.0, 31.0, "hello"), (1, 3, 0.0, 112.0, 40.0, 130.0, "next"), (1, 4, 0.0, 113.0, 40.0, 131.0, " "), (2, 5, 0.0, 0.0, 9.0, 40.0, "Big"), (2, 6, 0.0, 50.0, 9.0, 68.0, "a"), (2, 7, 0.0, 70.0, 9.0, 88.0, "b"), (3, 8, 0.0, 0.0, 1.0, 1.0, None)]
    lines = layout.text_lines(spark.createDataFrame(rows, box), ["p"], "id")
    assert {(r.p, r.text) for r in lines.collect()} == {(1, "hello world"), (1, "next"), (2, "Big"), (2, "a"), (2, "b")}
    assert {r.p: r.markdown for r in layout.lines_markdown(lines, ["p"]).collect()} == {1: "hello world\n\nnext", 2: "# Big\na\nb"}


HEAD = "| a | b |\n| --- | --- |\n"


def test_merge_by_marks():
    top, low = "<!-- TABLE_CONTINUES:columns=2 -->", "<!-- TABLE_CONTINUED:columns=2 -->"
    assert merged_pages([f"x\n{HEAD}| 1 | 2 |\n{top}", f"{low}\n{HEAD}| 3 | 4 |\n\nend"]) == [f"x\n{HEAD}| 1 | 2 |\n| 3 | 4 |", "end"]
    other = low.replace("2", "3")
    assert merged_pages([f"{HEAD}| 1 | 2 |\n{top}", f"{other}\n| 3 | 4 | 5 |"]) == [f"{HEAD}| 1 | 2 |\n{top}", f"{other}\n| 3 | 4 | 5 |"]
    assert merged_pages([f"{HEAD}| 1 | 2 |\n{top}", "| 3 | 4 |"]) == [f"{HEAD}| 1 | 2 |\n| 3 | 4 |"]
    chain = [f"{HEAD}| 1 | 2 |\n{top}", f"{low}\n| 3 | 4 |\n{top}", f"{low}\n| 5 | 6 |\n\ntail"]
    assert merged_pages(chain) == [f"{HEAD}| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |", "tail"]


def test_merge_by_shape():
    assert merged_pages([f"x\n\n{HEAD}| 1 | 2 |", f"{HEAD}| 3 | 4 |\n\ny"]) == [f"x\n\n{HEAD}| 1 | 2 |\n| 3 | 4 |", "y"]
    assert merged_pages([f"{HEAD}| 1 | 2 |", "| 3 | 4 | 5 |"]) == [f"{HEAD}| 1 | 2 |", "| 3 | 4 | 5 |"]
    assert merged_pages(["a", "b"]) == ["a", "b"] and merged_pages(["a"]) == ["a"] and merged_pages([]) == []


def test_assembled(spark):
    rows = [("d", 2, 1, f"{HEAD}| 3 | 4 |"), ("d", 1, 2, f"{HEAD}| 1 | 2 |"), ("e", 1, 3, " "), ("f", 1, 4, None), ("g", 1, 5, "b"), ("g", 1, 6, "c")]
    pages = spark.createDataFrame(rows, "doc string, n int, id int, t string")
    assert {r.doc: r.markdown for r in assembly.assembled(pages, "doc", "n", "t", "id").collect()} == {"d": f"{HEAD}| 1 | 2 |\n| 3 | 4 |", "g": "b\n\n---\n\nc"}
    tagged = assembly.assembled(pages, "doc", "n", "t", "id", page_tags=True)
    assert {r.doc: r.markdown for r in tagged.collect()}["g"] == "<!-- page:1 -->\nb\n\n<!-- page:1 -->\nc"


def test_links_and_pictures(spark):
    assert linked("see [old](u) the annual report.", [("annual report", "http://a")]) == "see old the [annual report](http://a)."
    assert linked("the press@x page", [("ress@", "m")]) == "the [press@x](m) page"
    assert linked("nothing", [("a", "u"), ("zzz", "u")]) == "nothing"
    cases = [
        ("<!-- FPE_IMG:p1_0 -->\n\n![Image](image)\nx", [(0.0, "a.png")], "![Image](a.png)\nx"), ("![d](figure_1) ![e](figure_0)", [(0.0, "a"), (0.0, "b")], "![d](b) ![e](a)"),
        ("![d](figure) ![e](figure)", [(0.0, "a")], "![d](a) ![e](figure)"), ("l1\nl2", [(800.0, "a")], "l1\n\n![Image](a)\n\nl2"), ("![d](figure_0) ![e](figure) ![f](figure_7)", [(0.0, "a")], "![d](a) ![e](figure) ![f](figure_7)"),
        ("<!-- FPE_IMG:p1_0 -->\n\n![Image](image)<!-- FPE_IMG:p1_1 -->\n![x](image)", [(0.0, "a")], "![Image](a)<!-- FPE_IMG:p1_1 -->\n![x](image)"), ("![$1](figure)", [(0.0, "a$2")], "![$1](a$2)"),
        ("", [(-5.0, "a"), (9999.0, "b")], "\n![Image](a)\n\n\n![Image](b)\n\n"), ("untouched", [], "untouched"), (None, [(0.0, "a")], None), ("![d](figure_99999999999)", [(0.0, "a")], "\n![Image](a)\n\n![d](figure_99999999999)"),
    ]
    given = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "k int, t string")
    shown = spark.createDataFrame([(k, i, y, a) for k, (_, p, _) in enumerate(cases) for i, (y, a) in enumerate(p)], "k int, ord int, y double, path string")
    assert {r.k: r.t for r in enrich.with_pictures(given, shown, ["k"], "t").collect()} == {k: w for k, (_, _, w) in enumerate(cases)}
    pages = spark.createDataFrame([("p", 1, None), ("p", 2, "t <!-- m --> e")], "path string, n int, t string")
    e = spark.createDataFrame([("p", 2, 1, "<!-- m -->", "a cat"), ("p", 2, 2, None, "dog"), ("p", 1, 3, "x", None)], "path string, n int, ord int, place string, description string")
    assert {r.n: r.t for r in enrich.described(pages, e, ["path", "n"], "t").collect()} == {1: None, 2: "t a cat e"}


def test_dispatch(spark):
    rows = routing.dispatched(spark.createDataFrame([("a.PDF",), ("b.jpeg",), ("c.zzz",), ("d",), (None,)], "p string"), "p").collect()
    got = {r.p: (r.decoder, r.error) for r in rows}
    assert got["a.PDF"] == ("pdf", None) and got["b.jpeg"] == ("image", None)
    assert got["c.zzz"][1] == "Unsupported file type: .zzz" and got["d"][1].startswith("Cannot determine")


def test_model_calls(spark):
    def client(model, prompt, content):
        if content == b"refuse" and model == "a":
            raise models_io.ModelError("busy")
        if content == b"break":
            raise TimeoutError("slow")
        return models_io.Answer(model, 3, 4)

    pages = spark.createDataFrame([("d", i, "p", c) for i, c in enumerate((b"ok", b"refuse", b"break", None))], "source_path string, page_number int, prompt string, content binary")
    done = models_io.extracted(pages, client, "a", "b")
    assert {r.page_number: (r.markdown, r.provider) for r in done.collect()} == {0: ("a", "a"), 1: ("b", "b"), 2: ("<!-- Extraction failed: slow -->", "error"), 3: ("a", "a")}
    assert [r.page_number for r in models_io.unanswered(pages, done).collect()] == [2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc string, n int, id int, t string")
    assert assembly.assembled(none, "doc", "n", "t", "id").count() == 0
    assert assembly.chunks(none, ["doc"], "t").count() == 0
    boxes = spark.createDataFrame([], "p int, id int, x_min double, y_min double, x_max double, y_max double, text string")
    assert layout.lines_markdown(layout.text_lines(boxes, ["p"], "id"), ["p"]).count() == 0


def test_chunks_for_retrieval(spark):
    import json

    text = "# Head\n" + "\n".join("x" * 40 for _ in range(30)) + "\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, None), ("d", 3, "")], "doc string, page int, t string")
    got = assembly.rag_chunks(pages, ["doc", "page"], "t", 100)
    rows = sorted((r.chunk_no, r.part, r.type, r.content, r.summary) for r in got.collect())
    texts = [r for r in rows if r[2] == "text"]
    assert "\n".join(r[3] for r in texts) == text.split("\n\n")[0] and len(texts) == 3 and all(len(r[3]) <= 4 * 110 for r in texts)
    assert [r[2:] for r in rows if r[2] != "text"] == [("table", text.split("\n\n")[1], "Head: columns a, b; 2 rows"), ("table_summary", "Head: columns a, b; 2 rows", None)]
    said = json.loads(assembly.rag_json(got, "doc", "page").first().json)
    assert said["source"] == "d" and [c["type"] for c in said["chunks"]] == ["text"] * 3 + ["table", "table_summary"] and said["chunks"][3]["summary"] and "summary" not in said["chunks"][0] and said["chunks"][0]["page"] == 1


def test_many_boxes_of_one_page(spark):
    boxes = spark.range(3000).selectExpr("1 as p", "id", "cast(id % 3 * 50 as double) as x_min", "cast(floor(id / 3) * 20 as double) as y_min", "cast(id % 3 * 50 + 40 as double) as x_max", "cast(floor(id / 3) * 20 + 18 as double) as y_max", "cast(id as string) as text")
    lines = layout.text_lines(boxes, ["p"], "id")
    assert lines.count() == 1000 and layout.lines_markdown(lines, ["p"]).first().markdown.startswith("0 1 2\n3 4 5\n")
