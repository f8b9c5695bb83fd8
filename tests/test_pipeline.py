"""The whole way from a folder to files by every strategy, its settings, its models and its command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from test_sources import PNG, docx, pdf, pptx

from pagemill.__main__ import main
from pagemill.config import Settings
from pagemill.operators import models_io, ocr
from pagemill.plans import pipeline, stubs
from pagemill.sources import catalogue, files, pictures, render
from pagemill.sources.custom import CUSTOM, register

BLANK_RGB = pictures.png(np.zeros((3, 5, 3), np.uint8))


def names(rows):
    return {r.path.rsplit("/", 1)[-1]: r for r in rows}


def test_settings():
    assert Settings.from_env({}) == Settings()
    got = Settings.from_env({"FPE_STRATEGY": "ocr", "FPE_PAGE_TAGS": "true", "PAGEMILL_VLM_CONCURRENCY": "3", "FPE_VLM_CONCURRENCY": "4", "FPE_OTHER": "x"})
    assert (got.strategy, got.page_tags, got.vlm_concurrency) == ("ocr", True, 3)
    with pytest.raises(ValueError):
        Settings.from_env({"PAGEMILL_IMAGE_DPI": "x"})


def test_catalogue(spark, tmp_path, monkeypatch):
    t = catalogue.tables(spark, catalogue.loaded())
    models = {r.name for r in t["models"].collect()}
    assert {r.model for r in t["routes"].collect()} <= models and {r.provider for r in t["models"].collect()} <= {r.name for r in t["providers"].collect()}
    own = tmp_path / "r.yaml"
    own.write_text("providers: {p: {base_url: u, api_key_env: FPE_KEY}}\nmodels: {m: {provider: p, model_id: x}}\n")
    monkeypatch.setenv("KEY", "k")
    t = catalogue.tables(spark, catalogue.loaded(str(own)))
    assert tuple(t["models"].first())[3:] == (8192, 0.1, 0.0, 0.0) and t["providers"].first().configured and t["routes"].count() == 0
    with pytest.raises(FileNotFoundError):
        catalogue.loaded(str(tmp_path / "none.yaml"))


def test_configured_models(monkeypatch):
    shipped = catalogue.SHIPPED
    for k in ("FPE_OPENROUTER_API_KEY", "OPENROUTER_API_KEY", "FPE_SILICONFLOW_API_KEY", "SILICONFLOW_API_KEY"):
        monkeypatch.delenv(k, raising=False)
    with pytest.raises(ValueError, match="No model provider"):
        models_io.configured(shipped)
    with pytest.raises(ValueError, match="not found or not configured"):
        models_io.configured(shipped, "gemini-flash")
    assert pipeline.Tools.found(Settings(), shipped).models is None
    with pytest.raises(ValueError):
        pipeline.Tools.found(Settings(vlm_model_override="none"), shipped)
    monkeypatch.setenv("OPENROUTER_API_KEY", "k")
    both = models_io.configured(shipped)
    assert (both.primary, both.fallback) == (shipped["defaults"]["primary"], shipped["defaults"]["fallback"])
    assert (m := models_io.configured(shipped, "gpt-5.4-nano")).primary == "gpt-5.4-nano" and m.fallback is None
    spare = {**shipped, "defaults": {"primary": "paddleocr", "fallback": "gemini-flash"}}
    assert (m := models_io.configured(spare)).primary == "gemini-flash" and m.fallback is None


def test_http_client(monkeypatch):
    asked = []

    class Answering(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers["Authorization"], body))
            busy = body["model"] == "busy"
            self.send_response(429 if busy else 200)
            self.end_headers()
            self.wfile.write(b"slow down" if busy else b"not json" if body["model"] == "odd" else json.dumps({"choices": [{"message": {"content": "# Read"}}], "usage": {"prompt_tokens": 7} if body["model"] == "m" else None}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answering)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        monkeypatch.setenv("A_KEY", "secret")
        base = f"http://127.0.0.1:{server.server_port}/v1/"
        client = models_io.HttpClient({n: models_io.Endpoint(f"p/{n}", n, base, "A_KEY", 99, 0.5) for n in ("m", "busy", "odd", "n")}, timeout=5, most=4)
        assert client("m", "Write it", BLANK_RGB) == models_io.Answer("# Read", 7, 0)
        assert client("n", "Order it", "raw text".encode()) == models_io.Answer("# Read", 0, 0)
        with pytest.raises(models_io.ModelError, match="429 - slow down"):
            client("busy", "x", b"y")
        with pytest.raises(ValueError):
            client("odd", "x", b"y")
        (path, key, first), (_, _, second) = asked[:2]
        assert path == "/v1/chat/completions" and key == "Bearer secret" and first["max_tokens"] == 99 and first["temperature"] == 0.5
        shown, said = first["messages"][1]["content"]
        assert shown["image_url"]["url"].startswith("data:image/png;base64,") and said["text"] == "Write it" and first["messages"][0]["role"] == "system"
        import base64

        assert pictures.pixels(base64.b64decode(shown["image_url"]["url"].split(",")[1])).shape == (2, 4, 3)  # 5 x 3 within 4
        assert second["messages"] == [{"role": "system", "content": "Order it"}, {"role": "user", "content": "raw text"}]
    finally:
        server.shutdown()


def test_parse(spark, tmp_path):
    given, out = tmp_path / "in", tmp_path / "out"
    given.mkdir()
    (given / "a.txt").write_text("one  \n\n\n\ntwo")
    (given / "b.csv").write_text("x,y\n1,2\n")
    (given / "c.docx").write_text("broken")
    settings = Settings(output_dir=str(out), page_tags=True)
    done, cost = pipeline.parse(spark, str(given), settings)
    rows = names(done.collect())
    assert rows["a.txt"].status == "OK" and rows["c.docx"].status.startswith("FAIL: ") and rows["c.docx"].pages == 0 and rows["a.txt"].strategy == "fast"
    assert tuple(pipeline.tally(done).first()) == (2, 1) and tuple(cost.first()) == (0, 0, 0, 0, 0.0)
    assert (out / "a.md").read_text() == "one\n\ntwo" and (out / "b.md").read_text().startswith("## b\n\n| x | y |")
    (given / "d.md").write_text("later")
    assert set(names(pipeline.parse(spark, str(given), settings)[0].collect())) == {"c.docx", "d.md"}
    assert set(names(pipeline.parse(spark, str(given / "a.txt"), settings, force=True)[0].collect())) == {"a.txt"}
    with pytest.raises(FileNotFoundError):
        pipeline.pages_of(spark, str(given / "none.txt"))
    assert set(names(pipeline.batch(spark, str(given)).collect())) == {"a.txt", "b.csv", "d.md"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("given")
    for name, data in {"a.pdf": pdf(), "b.png": BLANK_RGB, "c.docx": docx(), "d.pptx": pptx(), "e.txt": b"plain", "f.pdf": b"%PDF broken /Encrypt"}.items():
        (base / name).write_bytes(data)
    return str(base)


def seen(spark, folder, strategy, models=models_io.Models(stubs.answered, "one"), office=None, **more):
    tools = pipeline.Tools(models, stubs.recognised, stubs.rendered, office)
    return names(r for r in pipeline.pages_of(spark, folder, settings=Settings(strategy=strategy, **more), tools=tools).collect() if r.page_number in (1, None))


def test_strategies(spark, folder):
    for strategy in ("fast", "ocr", "hybrid", "vlm", "odd"):
        rows = seen(spark, folder, strategy)
        assert set(rows) == {"a.pdf", "b.png", "c.docx", "d.pptx", "e.txt", "f.pdf"} and rows["e.txt"].markdown == "plain\n", strategy
    fast = seen(spark, folder, "fast")
    assert fast["a.pdf"].provider == "pymupdf" and fast["b.png"].markdown == "![b.png (5x3, PNG)](b.png)\n" and fast["c.docx"].markdown.startswith("# Title")
    read = seen(spark, folder, "ocr")
    assert read["a.pdf"].provider == ocr.PROVIDER and "Head" in read["a.pdf"].markdown and read["c.docx"].markdown.startswith("# Title") and read["f.pdf"].error
    vlm = seen(spark, folder, "vlm")
    assert vlm["a.pdf"].markdown == "one: MORE\n" and vlm["a.pdf"].provider == "one" and vlm["c.docx"].provider == "one/refine" and vlm["d.pptx"].provider == "one/refine"
    assert seen(spark, folder, "odd")["a.pdf"].markdown == vlm["a.pdf"].markdown  # unknown strategies are vlm
    refused = seen(spark, folder, "vlm", models_io.Models(stubs.answered, "full"))
    assert refused["a.pdf"].markdown == "<!-- Extraction failed: too busy -->\n" and refused["a.pdf"].provider == "error" and refused["a.pdf"].error is None
    assert refused["c.docx"].error == "too busy"  # a text that can't be put in order fails its file
    none = seen(spark, folder, "vlm", None)
    assert "No model provider" in none["a.pdf"].error and none["c.docx"].markdown.startswith("# Title")
    mixed = seen(spark, folder, "hybrid")
    assert mixed["b.png"].markdown.startswith("![b.png") and mixed["c.docx"].provider == "one/refine"
    made = pdf()
    office = seen(spark, folder, "vlm", office=lambda data, ext: made)
    assert office["c.docx"].markdown == "one: MORE\n"


def test_enrichment_and_progress(spark, tmp_path):
    from pagemill.plans.queries import _PDF

    (tmp_path / "s.pdf").write_text(_PDF.format("Acme", 7, 3))
    (tmp_path / "t.txt").write_text("see Report")
    told = []
    settings = Settings(strategy="vlm", extract_images=True, enrich_links=True, page_tags=True, output_dir=str(tmp_path / "out"))
    tools = pipeline.Tools(models_io.Models(lambda model, prompt, content: models_io.Answer(f"{'2 pictures' if ' 2 ' in prompt else 'numbered' if 'figure_0' in prompt else 'none'}\n\nRead the Report.\n\n![a](figure_0)"), "m"), renderer=stubs.rendered)
    done, _ = pipeline.parse(spark, str(tmp_path), settings, tools=tools, on_page=lambda *a: told.append(a))
    assert names(done.collect())["s.pdf"].status == "OK" and told[0] == (0, 1) and told[-1] == (1, 1)
    assert (tmp_path / "out/s.md").read_text() == "<!-- page:1 -->\nnumbered\n\nRead the [Report](https://s.example/7).\n\n!a"  # links come last and take others' marks
    assert (tmp_path / "out/images/s_p1_0.jpg").read_bytes() == b"seen Acme" and (tmp_path / "out/t.md").read_text() == "see Report"
    settings = Settings(extract_images=True, output_dir=str(tmp_path / "more"))
    pipeline.parse(spark, str(tmp_path / "s.pdf"), settings)
    assert "![Image](images/s_p1_0.jpg)" in (tmp_path / "more/s.md").read_text()


def test_own_decoders(spark, tmp_path):
    (tmp_path / "a.xyz").write_bytes(b"abc")
    (tmp_path / "b.raw").write_bytes(b"abc")

    @register("xyz", file_type="mine", provider="me")
    def decode(data, path):
        return [data.decode().upper()], {"n": str(len(data))}

    @register("raw", needs_vlm=True)
    def nothing(data, path):
        raise NotImplementedError

    try:
        rows = names(files.decoded(files.scanned(spark, str(tmp_path))).collect())
        assert (rows["a.xyz"].markdown, rows["a.xyz"].file_type, rows["a.xyz"].provider, rows["a.xyz"].metadata) == ("ABC", "mine", "me", {"n": "3"})
        assert rows["b.raw"].markdown == "*[File: b.raw — direct extraction not supported for this format]*" and rows["b.raw"].provider == "local"
    finally:
        CUSTOM.clear()


def test_lacking_programs(spark, monkeypatch):
    monkeypatch.setenv("PATH", "")
    assert not render.can_convert() and not ocr.available()
    with pytest.raises(RuntimeError, match="LibreOffice"):
        render.converted(b"", "docx")
    with pytest.raises(RuntimeError, match="recogniser"):
        ocr.installed(b"")
    ocr.reset()


def test_pictures():
    rng = np.random.default_rng(1)
    for channels in (1, 2, 3, 4):
        image = rng.integers(0, 255, (7, 9, channels)).astype(np.uint8)
        assert (pictures.pixels(pictures.png(image)) == image).all()
        data, w, h = pictures.to_png(pictures.png(image))
        assert (w, h) == (9, 7) and pictures.pixels(data).shape[2] in (3, 4)
    bmp = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + bytes([1, 2, 3, 4, 5, 6, 0, 0])
    assert pictures.pixels(bmp).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    small = pictures.fitted(pictures.png(np.full((40, 100, 3), 200, np.uint8)), 10)
    assert pictures.pixels(small).shape == (4, 10, 3) and (pictures.pixels(small) == 200).all() and pictures.fitted(small, 10) is small
    with pytest.raises(pictures.Unreadable):
        pictures.pixels(PNG[:8])


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("pagemill.__main__.local_session", lambda *a: spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello")
    args = ["parse", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-v"]
    assert main(args) == 0 and (tmp_path / "out/a.md").read_text() == "hello"
    assert main(args) == 0 and "All files are there" in capsys.readouterr().out
    assert main(["parse", str(tmp_path / "none")]) == 1 and main(["parse", str(tmp_path / "out"), "-o", str(tmp_path / "z"), "-f", "-s", "ocr", "-c", "2", "-r", "-p", "-l", "-i"]) == 0
    for name in ("formats", "config", "routes"):
        assert main([name]) == 0
