"""The text operators against brute force, round trips and hand-made cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bodies, common, encodings, leaks, repeats, residue, scans, sentences, splitting, tokens, truncation, vectors

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PAGES = "page_id bigint, source_path string, page_number int, markdown string"


# 7
@pytest.mark.parametrize("text", ["x" * 9000, "ab " * 4000, "\n" * 5000, "你好。" * 1500, "é" * 3000, ("Some words. " * 30 + "\n\n") * 20])
def test_cuts(text):
    last = begin = 0
    joined = ""
    for end in splitting.cuts(text, 2000, 200):
        begin = max(begin, last - 200) if last else 0
        assert end > last and end - begin <= 2000
        joined += text[last:end]
        last = end
    assert joined == text


def test_cuts_match_a_plain_walk():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "x" * rng.randint(1, 60)]) for _ in range(rng.randint(50, 900)))
        levels = splitting.boundaries(text)
        places = set(np.concatenate(levels).tolist()) | {len(text)}
        want, at = [], 0
        while at < len(text):
            most = max(at - 20, 0) + 100
            if most >= len(text):
                at = len(text)
            else:
                far = [x for x in (max((p for p in lv.tolist() if at + 40 < p <= most), default=0) for lv in levels) if x]
                near = max((p for p in places if at < p <= most), default=0)
                at = far[0] if far else near or most
            want.append(at)
        assert splitting.cuts(text, 100, 20) == want


def test_pieces(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b " * 600), (3, "a b " * 600), (None, "z" * 2001)], "k bigint, t string").withColumn("key", F.lit(1)).withColumn("piece", F.lit(1))
    got = splitting.pieces(df, "k", "t")
    assert Counter(r.k for r in got.collect()) == {3: 4, None: 2} and got.columns[0] == "k"
    assert splitting.pieces(df.limit(0), "k", "t").count() == 0


# 8
def test_ids_equal_the_public_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["".join(rng.choice("'  \n\tsStTreveldmax19.!é 漢　'<|> ") for _ in range(rng.randint(0, 70))) for _ in range(3000)]
    texts += ["a" * 5000, "'" * 99, None, "", "<|endoftext|> hi'll we'Re", "\x1c\x1d x", "😀 👩‍👩‍👧"]
    ids, places = tokens.encode_batch(texts, RANKS, offsets=True)
    assert ids == [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert all(tokens.decode(i, RANKS) == (x or "") for i, x in zip(ids, texts))
    assert all(len(i) == len(p) and p == sorted(p) for i, p in zip(ids, places))


def test_encode(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "")], "k bigint, t string")
    rows = tokens.encode(df, "k", "t", RANKS).collect()
    assert len(rows) == 4 and all(r.ids == [] for r in rows if r.k != 1)


def test_scan_equals_steps():
    rng = np.random.default_rng(5)
    kinds, table = rng.integers(0, 12, 1000).astype(np.uint8), tokens.transitions()
    state, want = tokens.AT_BLANK, []
    for k in kinds:
        state = table[k, state]
        want.append(state)
    assert tokens.scan(kinds, table).tolist() == want


# 9
def test_leaks(spark):
    rng = random.Random(2)
    item = [f"w{rng.randint(0, 999)}" for _ in range(36)]
    full = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(90))
    changed = list(item)
    for i in (3, 9, 15, 21, 27, 33):
        changed[i] = "zz"
    over = list(changed)
    over[6] = "yy"
    fill = " ".join(f"f{i}" for i in range(50))
    docs = {
        1: " ".join(item), 2: f"{fill} {' '.join(item[4:16])} {fill}".upper(), 3: f"{fill} {' '.join(item[4:15])} {fill}", 4: "**" + ",\n".join(changed) + "**", 5: " ".join(over), 6: f"x{full[10:50]}y", 7: f"x{full[10:49]}y", 8: None, 9: "", 10: " ".join(item[:20] + ["extra"] + item[20:]),
    }
    df = spark.createDataFrame(list(docs.items()) + [(1, docs[1])], "k bigint, t string").withColumn("item", F.lit(0))
    items = spark.createDataFrame([(7, " ".join(item)), (8, full), (9, None)], "i bigint, t string")
    assert {(r.k, r.i) for r in leaks.leaks(df, "k", "t", items, "i", "t").collect()} == {(1, 7), (2, 7), (4, 7), (6, 8), (10, 7)}
    assert {(r.k, r.i) for r in leaks.leaks(df, "k", "t", items, "i", "t", most_bytes=40).collect()} == {(1, 7), (2, 7), (4, 7), (6, 8), (10, 7)}  # in several passes
    assert leaks.leaks(df, "k", "t", items.limit(0), "i", "t").count() == 0


def test_passages_of_leaks(spark):
    rng = random.Random(3)
    item = [f"w{rng.randint(100, 999)}" for _ in range(36)]
    full = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(90))
    changed = list(item)
    for i in (3, 9, 15, 21, 27, 33):
        changed[i] = "zz"
    docs = {1: f"Straße [a](http://u) {' '.join(item).upper()}. End", 2: f"x **{' '.join(item[4:20])}** y {' '.join(item[10:30])}!", 3: f"before, {', '.join(changed)} after", 4: f"说{full[10:60]}了", 5: "nothing", 6: None}
    df = spark.createDataFrame(list(docs.items()), "k bigint, t string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, full)], "i bigint, t string")
    found = leaks.leaks(df, "k", "t", items, "i", "t")
    got = leaks.spans(df, "k", "t", items, "i", "t", found)
    said = {(r.k, docs[r.k][r.start_pos : r.end_pos]) for r in got.collect()}
    assert said == {(1, " ".join(item).upper()), (2, " ".join(item[4:20])), (2, " ".join(item[10:30])), (3, ", ".join(changed)), (4, full[10:60])}
    left = {r.k: r.t for r in leaks.cut(df, "k", "t", got).collect()}
    assert left == {1: "Straße [a](http://u) . End", 2: "x **** y !", 3: "before,  after", 4: "说了", 5: "nothing", 6: None}
    over = spark.createDataFrame([(5, 1, 4), (5, 2, 6), (5, 0, 1)], "k bigint, start_pos bigint, end_pos bigint")
    assert {r.k: r.t for r in leaks.cut(df, "k", "t", over).collect()}[5] == "g"


def test_leaks_of_items_with_common_phrases_equal_brute_force():
    rng = random.Random(12)
    phrase = "as was said in the notes of the board and of the mill".split()
    items = [(k, [*phrase, *(f"w{rng.randint(0, 60)}" for _ in range(20)), *phrase[:6]]) for k in range(40)]
    docs = []
    for k, item in items:
        own = list(item)
        for i in rng.sample(range(len(own)), rng.randint(0, 9)):
            own[i] = rng.choice(["zz", *phrase])
        docs.append([*(f"f{rng.randint(0, 9)}" for _ in range(8)), *own, *phrase[:9]])
    index = leaks.Index([(k, " ".join(x)) for k, x in items], leaks.words, 3, 12, 6)
    got = set(index.found([" ".join(x) for x in docs]))
    number = {w: i for i, w in enumerate(sorted({w for x in [*docs, *(y for _, y in items)] for w in x}))}
    code = lambda x: np.array([number[w] for w in x])
    runs = lambda x: {tuple(x[i : i + 12]) for i in range(len(x) - 11)}
    want = {(d, k) for d, x in enumerate(docs) for k, y in items if runs(x) & runs(y) or leaks.Index.near(code(y), code(x), len(y) // 6)}
    assert got == want and len({d for d, _ in want}) > 30


# 10
SENTENCES = [
    ("Mr. Noras sold it at 4 p.m. and left. Who knows?", 2), ("“Is it open?” asked Pico, holding it. They reviewed lists, etc. The pier closed.", 3), ("See Fig. 3 and No. 10 of it. J. K. Bell wrote 3.7 % there.", 2),
    ("Am 7. März prüften sie d. h. rund 4,1 Prozent. Dr. Bell schrieb z. B. die Verträge.", 2), ("D’après M. Bell, soit 3,2 % (réf. K0-1). « Où sont-ils ? » a demandé Pico.", 2), ("«¿Son básicos?», preguntó la Sra. Bell. ¡No!", 2),
    ("Инженер А. Б. Терсков сказал на стр. 17. Все акты проверены!", 2), ("值班员说：“请先延期，然后归还。”“仓库更换了吗？”负责的职员问。编号A1已核对……其余待查。", 3), ("「台帳はありますか。」と係が尋ねた。図面を承認しないでください！", 2),
    ("กรุณาวัดแบบแปลน ทีมงานได้ส่งคืน 1841 แบบแปลน", 2), ("डॉ. तारन ने सूची को दर्ज किया। क्या बदला गया?", 2), ("أين الجسر المشترك؟ لا تنقل العقد!", 2), ("the pier closed in 2012. the valve opened.", 2),
]


def test_long_quotations_and_paragraphs():
    import time

    for open_, close in ("“”", "«»", "„“"):
        text = open_ + "He sold the old pier to them. " * 40 + close + " said Pico. Then he left."
        assert len(text) > 1200 and len(sentences.units(text)) == 2
    assert len(sentences.units("“He sold it. She left. Who knows?")) == 3  # never closed
    begin = time.process_time()
    assert len(sentences.units("図面を承認しないでください！" * 6000)) == 6000
    assert len(sentences.units("「" + "図面を承認しない。" * 9000 + "」と言った。")) == 1
    assert time.process_time() - begin < 5


@pytest.mark.parametrize("text,n", SENTENCES)
def test_sentences(text, n):
    assert len(sentences.units(text)) == n, [text[a:b] for a, b in sentences.units(text)]


def test_units():
    text = "# Head\n\n- one\n- two\n\n| a | b |\n| --- | --- |\n| 1. x | 2 |\n\n---\n<!-- page:1 -->\nA b\ncat. Dog\n\n \n"
    assert [text[a:b] for a, b in sentences.units(text)] == ["# Head", "- one", "- two", "| a | b |", "| 1. x | 2 |", "A b\ncat.", "Dog"]
    assert sentences.units(None) == sentences.units("") == sentences.units(" \n\t") == []
    long = "Word. " * 20000
    assert len(sentences.units(long)) == 20000


# 2
def pages_of(rows):
    return [(i, s, 1, t) for i, (s, t) in enumerate(rows)]


def test_repeated_lines_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    lines = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = []
    for k in range(120):
        own = [rng.choice(lines[:12] if rng.random() < 0.5 else lines) for _ in range(8)]
        own = [rng.choice([x, x.upper(), f"**{x}**", f"[{x}](http://u/{k})", f"{x} {k}", f" {x} !"]) for x in own] + ["", "1 2"]
        rows.append((f"web/h{k % 3 if k % 5 else 9}/p{k}", "\n".join(own)))
    rows += [("web/h9/n", None), ("web/h9/e", ""), (None, lines[0])]
    given = pages_of(rows)
    like = defaultdict(set)
    size = Counter()
    norm = lambda x: re.sub(r"[^a-z]", "", re.sub(r"\]\([^)]*\)", "", x).lower())
    for i, s, _, t in given:
        if s:
            source = "/".join(s.split("/")[:2])
            size[source] += 1
            for x in (t or "").split("\n"):
                like[source, norm(x)].add(i)
    want = set()
    for i, s, _, t in given:
        if s and t:
            source = "/".join(s.split("/")[:2])
            want |= {(i, n) for n, x in enumerate(t.split("\n"), 1) if norm(x) and len(like[source, norm(x)]) >= max(4, 0.1 * size[source])}
    df = spark.createDataFrame(given, PAGES).withColumn("s", F.lit(1)).withColumn("h", F.lit(2))
    args = (df, "page_id", "source_path", "markdown")
    found = repeats.repeated_lines(*args)
    assert {(r.page_id, r.line_no) for r in found.collect()} == want and want
    monkeypatch.setattr(common, "LEAST_BITS", 6)  # a filter that lets nearly all pass gives the same
    monkeypatch.setattr(common, "MOST_BITS", 6)
    assert {(r.page_id, r.line_no) for r in repeats.repeated_lines(*args).collect()} == want
    cut = {r.page_id: r.markdown for r in repeats.without_lines(df, "page_id", "markdown", found).collect()}
    assert all(cut[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in want)) for i, _, _, t in given)
    assert repeats.repeated_lines(df.limit(0), *args[1:]).count() == 0


def test_sources_that_repeat_only_short_lines(spark, monkeypatch):
    long = lambda k: " ".join("".join(random.Random(f"{k} {i}").choices("abcdefghij", k=7)) for i in range(40))
    rows = [(f"web/short/p{k}", f"Share\n{long(k)}\nPrint") for k in range(8)] + [(f"web/long/p{k}", f"{long('same')}\n{long(k + 50)}") for k in range(8)]
    df = spark.createDataFrame(pages_of(rows), PAGES)
    want = {(i, n) for i, s, _, _ in pages_of(rows) for n in ((1, 3) if "short" in s else (1,))}
    for most in (common.MOST_BITS, 6):
        monkeypatch.setattr(common, "LEAST_BITS", min(most, common.LEAST_BITS))
        monkeypatch.setattr(common, "MOST_BITS", most)
        assert {(r.page_id, r.line_no) for r in repeats.repeated_lines(df, "page_id", "source_path", "markdown").collect()} == want


# 3
def test_bodies(spark):
    menu = "* [Home](/home)\n* [Contact](/contact)"
    rows = []
    for k in range(12):
        body = f"# Title {'abcdefghijkl'[k]} of the page\n\nPico {'ABCDEFGHIJKL'[k]}ell, Borby\n\nThe {'abcdefghijkl'[k] * 4} pier was closed by the board. A tin of cookies stood there.\n\n- big {'abcdefghijkl'[k] * 3} {k}\n- [Paper {'abcdefghijkl'[k] * 5} {k}](https://x.example/{k})\n\n| a | b |\n| --- | --- |\n| x | {k} |"
        rows.append((f"crawl/h{k % 6}.example/d{k}", f"{menu}\n\n{body}\n\nRelated stories\n- How one {'abcdefghijkl'[k]} fell\n- The other {'mnopqrstuvwx'[k]}\n\n© 2020 H. All rights reserved.\nPowered by Pages {k}"))
    rows += [("crawl/z.example/n", None), ("crawl/z.example/e", ""), (None, "x")]
    df = spark.createDataFrame(pages_of(rows), PAGES).withColumn("local", F.lit(1))
    got = defaultdict(set)
    for r in bodies.noise_lines(df, "page_id", "source_path", "page_number", "markdown").collect():
        got[r.page_id].add(r.line_no)
    for i in range(12):
        lines = rows[i][1].split("\n")
        assert got[i] == {n for n, x in enumerate(lines, 1) if x.startswith(("* [", "Related", "- How", "- The", "©", "Powered"))}, [lines[n - 1] for n in got[i]]
    assert not {12, 13, 14} & set(got)


# 4
def test_truncation(spark):
    rng = random.Random(6)
    nouns = "pier valve ledger memo gauge kiln moat quota".split()
    said = lambda: f"The {rng.choice(nouns)} near the old {rng.choice(nouns)} was closed by the {rng.choice(nouns)} board in spring."
    rows, want = [], set()
    for k in range(80):
        t = " ".join(said() for _ in range(rng.randint(2, 9)))
        path = f"feed/cut/{k}.txt" if k < 40 else f"lib/docs/{k}.pdf"
        if k < 40:
            want |= {k} if len(t) > 200 else set()
            t = t[:200]
        elif k % 10 == 0:
            t = t[:-9]
            want.add(k)
        rows.append((k, path, 1, t))
    rows += [(100, "lib/docs/a.pdf", 1, said().rsplit(" ", 3)[0]), (101, "lib/docs/a.pdf", 2, "and " + said()), (102, "lib/n", 1, None), (103, "lib/n", 2, " "), (104, "lib/m", 1, said() + "\n\n## The last heading"), (105, "vlm/x", 1, said()), (106, "vlm/x", 2, said())]
    want.add(105)
    usage = spark.createDataFrame([("vlm/x", 1, 1, "M_one", 5), ("vlm/x", 1, 2, " m-ONE", 64), ("vlm/x", 2, 1, "m-one", 64), ("vlm/x", 2, 2, "m-one", None), (None, 1, 1, "m-one", 64)], "source_path string, page_number int, attempt int, model_name string, output_tokens bigint")
    models = spark.createDataFrame([("m-one", 64)], "name string, max_tokens int")
    df = spark.createDataFrame(rows, PAGES)
    got = truncation.cut_texts(df, usage, models, "page_id", "source_path", "page_number", "markdown", F.lit(False))
    assert got.count() == len(rows) and {r.page_id for r in got.filter("cause is not null").collect()} == want
    shares = {r.source: (r.rows, r.cut) for r in truncation.shares(got).collect()}
    assert shares["vlm/x"] == (2, 1) and shares["lib/n"] == (2, 0)


# 5
CLEAN = {
    "de": "Die größeren Verträge aus Gulby kürzten die Schlüssel, für die Pico Bell „viele“ Einträge führte.", "fr": "« Les règlements épais ont numéroté les contrôles », a déclaré Queacer à Solcombe après l’arrêté.",
    "ru": "Инженер Терсков сообщил, что старые акты подтвердили прежние насосы на странице.", "ja": "係員は「図面を承認してください！」と言い、四半期一覧表を閉じた。", "zh": "检查组在三月移交了预算，并把目录与内部图纸一起登记。", "en": "“Stop the pier!” called Pico — it closed at 4 °C.",
}


def _cut_causes(spark, rows):
    pages = spark.createDataFrame(rows, PAGES)
    usage = spark.createDataFrame([], "source_path string, page_number int, model_name string, attempt int, output_tokens bigint")
    models = spark.createDataFrame([], "name string, max_tokens int")
    got = truncation.cut_texts(pages, usage, models, "page_id", "source_path", "page_number", "markdown", F.lit(False)).collect()
    return {r.page_id: r.cause for r in got}


def test_limits_anywhere(spark):
    rng = random.Random(9)
    nouns = "pier valve ledger memo gauge kiln moat quota".split()
    said = lambda n: " ".join(f"The {rng.choice(nouns)} near the old {rng.choice(nouns)} was closed by the {rng.choice(nouns)} board in spring." for _ in range(n))
    rows, want = [], set()
    for k in range(600):  # a tenth is cut at 300 characters, some at 700, and longer ones are whole
        t = said(rng.randint(2, 24))
        cut = 300 if k % 10 == 0 else 700 if k % 25 == 3 else 0
        if cut and len(t) > cut:
            t, want = t[:cut], want | {k}
        rows.append((k, f"feed/cut/{k}.txt", 1, t))
    got = _cut_causes(spark, rows)
    found = {k for k, v in got.items() if v == "limit"}
    assert found >= want and len(want) > 60
    assert {len(rows[k][3]) for k in found} == {300, 700}


def test_rows_without_path_or_number_are_judged_alike(spark, monkeypatch):
    rng = random.Random(10)
    nouns = "pier valve ledger memo gauge kiln moat quota".split()
    said = lambda: f"The {rng.choice(nouns)} near the old {rng.choice(nouns)} was closed by the {rng.choice(nouns)} board in spring."
    rows = [(k, f"lib/docs/{k}.pdf", 1, " ".join(said() for _ in range(6))) for k in range(60)]
    cut = said()[:-12]
    rows += [(100, None, 1, cut), (101, "lib/x.pdf", None, cut), (102, None, None, said()), (103, "lib/y.pdf", 1, cut), (103, "lib/y.pdf", 1, cut)]
    want = {k: "transfer" if k in (100, 101, 103) else None for k, *_ in rows}
    assert _cut_causes(spark, rows) == want
    monkeypatch.setattr(common, "LEAST_BITS", 6)  # a filter that lets nearly all pass changes nothing
    monkeypatch.setattr(common, "MOST_BITS", 6)
    assert _cut_causes(spark, rows) == want


def test_thresholds_by_language(spark):
    odds = [("en", x) for x in [3.0] * 400 + [-5.0] * 40 + [-2.0] * 20] + [("fr", x) for x in [2.0] * 400 + [-4.0] * 30 + [-3.0] * 20] + [("xx", 1.0)] * 5 + [("en", None)] * 9
    got = {r.language: r.threshold for r in truncation.thresholds(spark.createDataFrame(odds, "language string, odds double")).collect()}
    assert set(got) == {"en", "fr"} and got["en"] < got["fr"]


def test_long_last_lines(spark):
    rows = [("web/a/1", 1, "Intro.\n\n| " + "cell text | " * 80 + "half a ce"), ("web/a/2", 1, "See [the report](http://u/" + "x" * 700), ("web/a/3", 1, "Words that stop. " * 60), ("web/a/4", 1, "The " + "quiet harbour lies beyond " * 40 + "the old mill and")]
    pages = spark.createDataFrame([(k, p, n, t) for k, (p, n, t) in enumerate(rows)], PAGES)
    usage = spark.createDataFrame([], "source_path string, page_number int, model_name string, attempt int, output_tokens bigint")
    models = spark.createDataFrame([], "name string, max_tokens int")
    got = truncation.cut_texts(pages, usage, models, "page_id", "source_path", "page_number", "markdown", F.lit(False)).collect()
    assert {r.page_id: r.cause for r in got} == {0: "transfer", 1: "transfer", 2: None, 3: "transfer"}


@pytest.fixture(scope="module")
def judge():
    import zstandard

    rng = random.Random(1)
    parts = {k: [" ".join(rng.sample(v.split(), len(v.split()))).encode() if " " in v else v.encode() for _ in range(300)] for k, v in CLEAN.items()}
    return encodings.Judge({k: zstandard.train_dictionary(4096, v).as_bytes() for k, v in parts.items()})


@pytest.mark.parametrize("language,written,read", [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("fr", "utf-8", "mac-roman"), ("ru", "utf-8", "cp850"), ("ru", "cp1251", "latin-1"), ("ja", "cp932", "latin-1"), ("ja", "euc-jp", "latin-1"), ("zh", "gb18030", "latin-1"), ("de", "cp1252", "mac-roman"), ("en", "utf-8", "cp850")])
def test_repair(judge, language, written, read):
    text = CLEAN[language]
    bad = text.encode(written).decode(read)
    assert bad != text and encodings.repair(f"plain\n{bad}", judge)[:2] == (f"plain\n{text}", True)


def test_repair_leaves_clean_texts(judge):
    for text in [*CLEAN.values(), "", "ascii? yes", "The viewer printed `Ã¼` where the form had ü."]:
        assert encodings.repair(text, judge) == (text, False, False)
    twice = CLEAN["de"].replace("„", "").replace("“", "").encode().decode("latin-1").encode().decode("latin-1")
    assert encodings.repair(twice, judge)[0] == CLEAN["de"].replace("„", "").replace("“", "")
    assert encodings.repair("lost � here", judge)[1:] == (True, True)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (2, "x")], "k bigint, t string")
    assert [(r.k, r.t, r.garbled) for r in encodings.repaired(df, "k", "t", encodings.trained(df, "k", "t")).collect()] == [(1, None, False), (1, "", False), (2, "x", False)]
    assert encodings.trained(df, "k", "t").dictionaries == {}


def test_repair_of_double_faults_and_rare_languages(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample((v := CLEAN[k]).split(), len(v.split())) if " " in CLEAN[k] else [CLEAN[k]])) for i, k in enumerate(["en"] * 900 + ["ru"] * 40 + ["de"] * 30)]
    rows += [(2000 + i, f"Malgré le délai, Nora a noté l’écart n° {i} à la porte, où les dépôts sont.") for i in range(4)]
    df = spark.createDataFrame(rows, "k bigint, t string")
    learnt = encodings.trained(df, "k", "t")
    assert {"en", "ru", "de", "fr"} <= set(learnt.dictionaries)  # also the language of few rows
    judge = encodings.Judge(learnt.dictionaries, learnt.usual)
    twice = CLEAN["ru"].encode("cp1251").decode("latin-1").encode().decode("cp1252", "replace")
    assert "\ufffd" in twice or encodings.repair(twice, judge)[0] == CLEAN["ru"]
    other = "проверены все старые акты".encode("cp1251").decode("latin-1").encode().decode("latin-1")
    assert encodings.repair(other, judge)[0] == "проверены все старые акты"
    without = encodings.Judge({k: v for k, v in learnt.dictionaries.items() if k != "fr"}, learnt.usual)
    assert encodings.repair(rows[-1][1], without) == (rows[-1][1], False, False)


def test_models_of_encodings_come_from_all_rows(spark):
    far = "far off. " * 600  # what follows stands where no sample of beginnings reaches
    rows = [(i, f"{far}\n\nŽofie našla {i} žlutých listů – u mlýna.") for i in range(6)] + [(100 + i, f"Le dépôt {i} où l’été les a fermé pour la porte.") for i in range(2000)]
    df = spark.createDataFrame(rows, "k bigint, t string")
    learnt = encodings.trained(df, "k", "t")
    parts = {p for _, t in rows for p in t.split("\n\n")}
    total = Counter(sentences.kind_of(p)[0] for p in parts)
    seen = Counter()
    for p in parts:
        for x in encodings.Usual.contexts(p):
            seen[x] += min(1, 1500 / total[sentences.kind_of(p)[0]])
    want = encodings.Usual(seen)
    assert total["fr"] == 2000 and set("Žžůý–") <= learnt.usual.signs and (learnt.usual.signs, learnt.usual.places) == (want.signs, want.places)
    assert "žlutých listů – u mlýna.".encode() in learnt.dictionaries[sentences.kind_of(rows[0][1].split("\n\n")[1])[0]]
    again = encodings.trained(df.union(df).repartition(7), "k", "t")  # copies and partitions change nothing
    assert again.dictionaries == learnt.dictionaries and again.usual.places == want.places


def test_windows_hold_every_sign():
    rng = random.Random(6)
    for _ in range(200):
        words = [rng.choice(["pier", "dépôt", "—", "", "x" * 40, "é" * 50]) for _ in range(rng.randint(1, 30))]
        got = encodings.windows(" ".join(words), "fr")
        short = ["" if len(x) > encodings.LONG_WORD else x for x in words]
        assert all(any(x in w.split(" ") for w in got) for x in short if not x.isascii()) and all(not w.isascii() for w in got)
        assert all(len(w.split(" ")) <= encodings.WORDS + 1 for w in got)
    assert encodings.windows("目录与图纸", "cjk") == {"目录与图", "录与图纸"} and encodings.windows("Où ?", "fr") == {"Où ? "}


# 6
def test_residue(spark):
    odd = "The viewer of the harbour pages could not be started on this machine because the service is away now and must be reloaded by hand"
    rows = [
        (1, "Error 502: gateway timed out"), (2, "Dear {{name}}, the pier is ready."), (3, "Diagram of a template in which {{name}} stands"), (4, "```\n{{ x }}\n```\ntext"), (5, "`[Insert name here]` marks the place"), (6, "Lorem ipsum dolor sit"),
        (7, "A 404 error is explained here to everybody."), (8, None), (9, ""), (10, "You need to enable JavaScript to run the viewer."), (11, "He argued that the site should work where JavaScript is off."), (12, f"TODO: {odd} today"), (13, f"TODO: {odd} today"), (14, f"TBD {odd}"),
    ]
    df = spark.createDataFrame([("t", k, 0, x) for k, x in rows], "tab string, row bigint, part int, text string")
    assert {r.row for r in residue.residue_rows(df).collect()} >= {1, 2, 6, 10, 12, 13, 14}  # 14 by its likeness alone
    assert not {r.row for r in residue.residue_rows(df).collect()} & {3, 4, 5, 7, 8, 9, 11}
    assert residue.residue_rows(df.limit(0)).count() == 0


def test_fillings_of_a_template_are_one_unit(spark):
    rng = random.Random(8)
    things = [f"{a}{b}" for a in ("har", "pum", "can", "lod", "bri", "sil") for b in ("bour", "ping", "dle", "ging", "dge", "ver")]
    prose = lambda: " ".join(rng.choice(["the", "and", "of", "was", "on", "read", *things]) for _ in range(24))
    told = [f"Verbindung verloren, melden Sie sich neu an, um {x} zu lesen" for x in things]
    rows = [f"TODO: {told[0]}", *told[1:], *[prose() for _ in range(1500)], "Hello [First Name], thank you for {0} of {1}.", "Aenean porta vel magna sodales tempus nulla quis risus.", "The motto pro bono et loco was read.", "The set {a, b} costs $8, see note [12] and form [B]."]
    df = spark.createDataFrame([("t", k, 0, x) for k, x in enumerate(rows)], "tab string, row bigint, part int, text string")
    got = {r.row for r in residue.residue_rows(df, share=0.05).collect()}
    assert got == {*range(len(told)), len(rows) - 4, len(rows) - 3}
    assert {r.row for r in residue.residue_rows(df, share=0.05, trust=0.0).collect()} == set()


def test_labels_spread(spark):
    base = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    step = lambda n: " ".join(["changed"] * 0 + base.split()[n:] + [f"t{chr(97 + i)}" for i in range(n)])
    rows = [(1, f"TODO: {base}"), (2, base), (3, step(1)), (4, step(2)), (5, " ".join(reversed(base.split())))]
    df = spark.createDataFrame([("t", k, 0, x) for k, x in rows], "tab string, row bigint, part int, text string")
    got = {r.row for r in residue.residue_rows(df).collect()}
    assert 1 in got and 5 not in got
    words, unit = residue.words_of([x for _, x in rows])
    near, _ = residue.simhashes(words, unit, 5)
    reach, front = {0}, {0}
    while front:
        front = {j for i in front for j in range(5) if j not in reach and bin(int(near[i] ^ near[j])).count("1") <= residue.NEAR and residue.similarity(words[unit == i], words[unit == j]) >= residue.ALIKE}
        reach |= front
    assert got == {i + 1 for i in reach}


def test_labels_reach_all_alike_units(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    units = []
    for size in (15, 20, 30, 40, 60):
        for _ in range(12):
            base = [word() for _ in range(size)]
            units.append(f"TODO: {' '.join(base)}")
            for _ in range(3):
                base = [*base[: -rng.randint(1, 2)], word()]  # a chain of variants
                units.append(" ".join(base))
    han = "".join(chr(0x4E00 + 37 * i) for i in range(40))
    units += [f"TODO: {han}", f"{han[:-1]}们", han[::-1], "Forbidden", "**Forbidden.**", "Forbidden area", "# 404", "404"]
    words, unit = residue.words_of(units)
    own = [words[unit == i] for i in range(len(units))]
    reach = front = {i for i, x in enumerate(units) if residue.trusted(x)}
    while front:
        front = {j for i in front for j in range(len(units)) if j not in reach and min(len(own[i]), len(own[j])) >= 5 and residue.similarity(own[i], own[j]) >= residue.ALIKE}
        reach = reach | front
    reach |= {units.index("**Forbidden.**")}
    assert len(reach) > 150 and units.index(f"{han[:-1]}们") in reach and units.index("404") not in reach
    df = spark.createDataFrame([("t", k, 0, x) for k, x in enumerate(units)], "tab string, row bigint, part int, text string")
    assert {r.row for r in residue.residue_rows(df).collect()} == reach


# 1
def test_scans(spark):
    rng = random.Random(8)
    names = "harbour ledger receipt southern viaduct municipal circuit reservoir statute bulletin".split()
    clean = [" ".join(rng.choice(names) for _ in range(9)) for _ in range(120)]
    lines = {1: ["A title", "the harbour led-", "ger and the lower cross-", "border pier", "12"], 2: ["County Rolls", "clear southern viaduct", "the muniripal circnit ^ statute", "b0ard mee$ting of the receipf"]}
    texts = [(x + " the of and meeting board cross-border pier clear lower title rolls county",) for x in clean]
    blocks, pages, i = [], [], 0
    for n, own in lines.items():
        for k, x in enumerate(own):
            small = x in ("12", "County Rolls")
            for _ in range(2 if x == "border pier" else 1):
                i += 1
                y = 780.0 if x == "12" else 60.0 + 30 * k
                blocks.append((i, "scan/a/b.pdf", n, 70.0, y, 300.0, y + (13 if small else 18), x))
        pages.append((n, "scan/a/b.pdf", n, "\n".join(own)))
    blocks.append((99, None, 1, 0.0, 0.0, 1.0, 1.0, "x"))
    pages.append((9, "scan/a/c.pdf", 1, None))
    b = spark.createDataFrame(blocks, "block_id bigint, source_path string, page_number int, x_min double, y_min double, x_max double, y_max double, text string")
    p = spark.createDataFrame(pages, PAGES)
    every = spark.createDataFrame(texts, "text string").union(p.select(F.col("markdown")))
    noise = scans.Noise(b, p, every)
    got = {(r.table_name, r.row_id, r.noise) for r in noise.found().collect()}
    text_of = {r[0]: r[7] for r in blocks}
    by = {(text_of[r], n) for t, r, n in got if t == "text_blocks"}
    assert by == {("the harbour led-", "hyphen"), ("12", "furniture"), ("County Rolls", "furniture"), ("the muniripal circnit ^ statute", "chars"), ("b0ard mee$ting of the receipf", "chars")}
    assert {x for x in got if x[0] == "parsed_pages"} == {("parsed_pages", 1, "hyphen"), ("parsed_pages", 1, "furniture"), ("parsed_pages", 2, "furniture"), ("parsed_pages", 2, "chars")}
    fixed = {r.page_id: r.text for r in noise.repaired().collect()}
    assert fixed[1] == "A title the harbour ledger and the lower cross-border pier" and fixed[9] is None
    assert "receipt" in fixed[2] and "^" not in fixed[2] and "County" not in fixed[2]
    lines = {text_of[r.block_id]: r.text for r in noise.blocks().collect()}
    assert lines["12"] == lines["County Rolls"] == "" and lines["border pier"] == "pier" and lines["the muniripal circnit ^ statute"] == "the muniripal circnit statute" and lines["the harbour led-"] == "the harbour ledger" and lines["ger and the lower cross-"] == "and the lower cross-border"


def test_misread_words_are_read_in_their_context(spark):
    linked = spark.createDataFrame([("hariow", "harlow", 10, 250), ("hariow", "harrow", 10, 240), ("pler", "pier", 1, 4000)], "w string, c string, n bigint, m bigint")
    vector = spark.createDataFrame([("harlow", [1.0, 0.0]), ("harrow", [0.0, 1.0]), ("town", [1.0, 0.0]), ("plough", [0.0, 1.0]), ("noise", [-0.7, -0.7])], "word string, v array<float>")
    words = spark.createDataFrame([("t", 1, "hariow", ["town"]), ("t", 2, "hariow", ["plough"]), ("t", 3, "hariow", ["noise"]), ("t", 4, "hariow", []), ("t", 5, "pler", ["unknown"]), ("t", 6, "other", ["town"])], "tab string, row bigint, w string, ctx array<string>")
    assert {(r.row, r.c) for r in scans.read(words, linked, vector).collect()} == {(1, "harlow"), (2, "harrow"), (4, "harlow"), (5, "pier")}
    assert {(r.row, r.c) for r in scans.read(words, linked, None).collect()} == {(1, "harlow"), (2, "harlow"), (3, "harlow"), (4, "harlow"), (5, "pier")}


def test_long_words_are_linked(spark):
    long = "verwaltungsgerichtsverfahrensbeschleunigungsgesetze"
    v = spark.createDataFrame([(long, 400), (long.replace("rf", "ri").replace("m", "rn"), 3), ("x" * 30000, 1), ("pier", 900), ("pler", 2)], "w string, n bigint")
    wrong = long.replace("t", "f")
    v = v.union(spark.createDataFrame([(wrong, 2)], "w string, n bigint"))
    assert {(r.w, r.c) for r in scans.links(v).collect()} == {(wrong, long), ("pler", "pier")}


def test_words_broken_over_pages(spark):
    texts = {1: "the harbour opens for exam-", 2: "ple, and the viaduct has a cross-", 3: "border pier without a led-\nger.", 4: "ending-", 5: "Title of a page", 7: "and-"}
    p = spark.createDataFrame([(n, "scan/a/b.pdf", n, x) for n, x in texts.items()] + [(12, "scan/a/b.pdf", 2, texts[2]), (20, "scan/a/c.pdf", None, "lower")], PAGES)
    b = spark.createDataFrame([], "block_id bigint, source_path string, page_number int, x_min double, y_min double, x_max double, y_max double, text string")
    every = spark.createDataFrame([("cross-border",)] * 30, "text string").union(p.select("markdown"))
    noise = scans.Noise(b, p, every)
    fixed = {r.page_id: r.text for r in noise.repaired().collect()}
    assert fixed == {1: "the harbour opens for example,", 2: "and the viaduct has a cross-border", 12: "and the viaduct has a cross-border", 3: "pier without a ledger.", 4: "ending-", 5: "Title of a page", 7: "and-", 20: "lower"}
    documents = {r.source_path: r.text for r in noise.documents().collect()}
    assert documents["scan/a/b.pdf"].startswith("the harbour opens for example, and the viaduct has a cross-border pier without a ledger.\n\nending-")


def test_edits():
    assert {"the", "tie"} <= scans.edits("tlie") | scans.edits("tle") and "board" in scans.edits("b0ard") and "reservoir" in scans.edits("rcservoir") and "was" in scans.edits("vva$")


def test_slices_are_equal_wherever_they_stand():
    a = np.array([1, 2, 3, 9, 1, 2, 3], np.uint32)
    h = vectors.slices(a, np.array([0, 4, 1]), np.array([3, 7, 4]))
    assert h[0] == h[1] != h[2]
