"""Problem 1: noise in text from scanned pages.

Words are counted over all pages. Every word is linked to the much more frequent words that plausible glyph confusions lead to. Each
occurrence is read in its context: skip-gram vectors tell how well each of the frequent words goes with the words around it, and together
with the frequencies that decides whether it is misread and what was meant. Layout tells furniture (small lines at a page's edge); broken words are joined
over lines and pages. Repair drops furniture and stray signs, writes linked words as they were meant and reflows the lines.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import by_batch
from pagemill.session import written

#: What a scanner reads, and what may stand there, in lower case. Fixed values.
GLYPHS = {
    "c": ("e",), "@": ("a",), "l": ("i",), "f": ("t",), "$": ("s",), "0": ("o",), "ri": ("n",), "1": ("l", "i"), "cl": ("d",), "ii": ("u", "ü"), "li": ("h",), "rn": ("m",),
    "vv": ("w",), "q": ("g",), "6": ("é", "b"), "8": ("b",), "7": ("t",), "5": ("s",), "|": ("i", "l"), "ﬁ": ("fi",), "ﬂ": ("fl",), "d": ("cl",), "!": ("l", "i"), "3": ("e",), "9": ("g",), "b": ("ß",), "m": ("rn",),
}
#: Signs that stand alone in ordinary texts. Fixed values.
ORDINARY = frozenset("- – — « » % ? ! … & § № # + = / * “ ” „ \" ' ( ) : ; . , · › » ». », «. º ° → --- ... !? ?! ».”".split())
BREAKS = "-‐¬­"
RATIO, LEAST = 20, 5
#: Frequent words that are kept in memory, to pass over them quickly, and have vectors, at most. Rarer ones are looked up by joins and go by their frequency.
FREQUENT = 200_000
#: An occurrence is misread if the logarithm of the ratio of frequencies and ``CONTEXT`` times the mean cosine to the words around reach ``BAR``.
CONTEXT, BAR = 4.0, 4.0
#: Words on either side of an occurrence that tell its context, and tokens for each partition that trains vectors.
AROUND, TRAIN = 3, 1_000_000

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}$@|!ﬁﬂ]*[\p{L}ﬁﬂ$@|][\p{L}\p{M}\p{N}$@|!ﬁﬂ]*")
_JOIN = regex.compile(rf"(?<=\p{{L}})[{BREAKS}] ?\n(?=\p{{Ll}})")
_WRAPPED = regex.compile(rf"[{BREAKS}] ?\n")
_CODE = regex.compile(r"\p{Lu}\d-\d*\p{Lu}?|\d+[.,:]\d+|https?://\S+|\S+_\S+\.\w+")
_BROKEN = regex.compile(rf"([\p{{L}}\p{{M}}\p{{N}}$@|ﬁﬂ]*[\p{{L}}$@|ﬁﬂ\d])([{BREAKS}])\s*$")
_HEAD = regex.compile(r"^[\p{L}\p{M}\p{N}$@|ﬁﬂ]+")
_ODD = regex.compile(r"[\p{L}][$@|][\p{L}]|[$@]\p{L}{2}|\p{L}{2}[$@](?!\d)|(?<![\w-])(?=[\dlOIo]*\d)(?=[\dlOIo]*[lOIo])[\dlOIo]{2,5}(?![\w-])|(?<=\s)\d+[BSOIlo]\d+(?![\w-])|[ﬁﬂ]|\p{Ll}\d\p{Ll}|(?<![\p{L}\d.,:/-])\d(?!(?:st|nd|rd|th|er|re|e|ème|a|o)(?!\p{L}))\p{Ll}{2,}|\p{Ll}{3,}[016](?![\d\p{L}-])")
_NUMBER = regex.compile(r"^\W*(?:p\.|page|seite|página|s\.|f\.)?\s*[\divxlc]{1,7}(?:\s*(?:of|von|de|sur|/)\s*\d+)?\W*$", regex.I)


def words(text: str) -> list[str]:
    """Words in lower case, with the signs that scanners put for letters; codes, links and file names left out."""
    return [w.rstrip("!").lower() for w in _WORD.findall(_CODE.sub(" ", text))]


def edits(word: str, most: int = 2) -> set[str]:
    """Every word that up to ``most`` glyph confusions lead to."""
    out, front = set(), {(word, 0)}
    for _ in range(most):
        after = set()
        for w, start in front:
            for i in range(start, len(w)):
                for width in (1, 2):
                    for true in GLYPHS.get(w[i : i + width], ()) if i + width <= len(w) else ():
                        after.add((w[:i] + true + w[i + width :], i + len(true)))
        out |= {w for w, _ in after}
        front = after
    out.discard(word)
    return out


_COMPOUND = regex.compile(r"\p{L}+-\p{L}+")
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def counts(df: DataFrame, text: str, most: int = 300_000) -> DataFrame:
    """(w, n) over all texts: words, and words written with a hyphen. Tokens are counted as they stand and taken apart once each;
    partial counts leave a task whenever ``most`` tokens are held."""

    def apart(held: Counter) -> pa.RecordBatch:
        out: Counter = Counter()
        for token, n in held.items():
            if (plain := token.strip(_MARKS)).isalpha():  # most tokens
                out[plain.lower()] += n
                continue
            for w in words(token):
                out[w] += n
            if "-" in token and (bare := _EDGE.sub("", token)) and _COMPOUND.fullmatch(bare):
                out[bare.lower()] += n
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update((_JOIN.sub("", t) if _WRAPPED.search(t) else t).split())
            if len(held) > most:
                yield apart(held)
                held = Counter()
        yield apart(held)

    return df.select(F.col(text).alias("t")).filter(F.length("t") > 0).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


_PARTS = {x: k for k, v in GLYPHS.items() if len(k) > 1 for x in v if len(x) == 1}
_ALIKE = str.maketrans({a: b[0] for a, b in {"1": "l", "i": "l", "!": "l", "|": "l"}.items()} | {k: v[0] for k, v in GLYPHS.items() if len(k) == 1 and len(v[0]) == 1 and k not in "1!|"})


def outline(word: str) -> str:
    """What all words that glyph confusions lead to from one another have in common."""
    return "".join(_PARTS.get(x, x) for x in word).translate(_ALIKE)


def links(vocabulary: DataFrame, longest: int = 40) -> DataFrame:
    """(w, c, n, m): rare words ``w``, seen ``n`` times, and each frequent word ``c``, seen ``m`` >= ``RATIO`` * ``n`` times, that glyph confusions lead to.

    Up to ``longest`` letters every word that two confusions lead to is looked up; longer ones, which have too many, meet by their outlines.
    """

    def propose(c: dict) -> dict:
        w, n, to = [], [], []
        for x, k in zip(c["w"].to_pylist(), c["n"].to_pylist()):
            if 2 <= len(x) <= longest:
                got = edits(x, 2 if len(x) > 3 else 1)
                w += [x] * len(got)
                n += [k] * len(got)
                to += got
        return {"w": w, "n": n, "c": to}

    strong = vocabulary.filter(F.col("n") >= LEAST).filter(~F.col("w").rlike(r"[\d$@|!]")).select(F.col("w").alias("c"), F.col("n").alias("m"))
    long = by_batch(vocabulary.filter(F.length("w") > longest), "w string, n bigint, o string", lambda c: {k: c[k] for k in ("w", "n")} | {"o": [outline(x) for x in c["w"].to_pylist()]})
    meant = by_batch(strong.filter(F.length("c") > longest - 2), "c string, m bigint, o string", lambda c: {k: c[k] for k in ("c", "m")} | {"o": [outline(x) for x in c["c"].to_pylist()]})
    found = by_batch(vocabulary, "w string, n bigint, c string", propose).join(strong, "c").select("w", "c", "n", "m").union(long.join(meant, "o").filter("w <> c").select("w", "c", "n", "m"))
    return found.filter(F.col("m") >= RATIO * F.col("n"))


def vectors(vocabulary: DataFrame, sentences: DataFrame, size: int = 16) -> DataFrame | None:
    """(word, v): unit skip-gram vectors of the frequent words of ``sentences`` (an array of words, ``ws``); None where there are none.

    At most ``FREQUENT`` words have one. The corpus is trained on in parts of about ``TRAIN`` tokens.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    bar = vocabulary.filter(F.col("n") >= LEAST).groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(1_000_000)
    bar = bar.withColumn("sum", F.sum("k").over(Window.orderBy(F.desc("n")))).filter(F.col("sum") <= FREQUENT).agg(F.min("n")).first()[0]
    tokens = sentences.agg(F.sum(F.size("ws"))).first()[0] or 0
    if bar is None or tokens < 100:
        return None
    try:
        model = Word2Vec(vectorSize=size, windowSize=3, minCount=int(min(bar, 2**31 - 1)), maxIter=1, numPartitions=int(max(4, min(512, tokens // TRAIN))), seed=7, inputCol="ws", outputCol="v").fit(sentences)
    except Exception as e:
        if "vocabulary size" not in str(e):  # no word of these pages is frequent enough
            raise
        return None
    v = F.col("v")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("v")).withColumn("l", length).filter("l > 0").select("word", F.transform("v", lambda x: (x / F.col("l")).cast("float")).alias("v"))


def read(words: DataFrame, linked: DataFrame, vector: DataFrame | None) -> DataFrame:
    """(tab, row, w, c): the misread words of each row and what was meant there. ``words`` has tab, row, w and the words around, ``ctx``.

    Each frequent word that a word may be is scored by the ratio of frequencies and its mean cosine to the words around; a word without
    vector, or without known words around it, goes by the frequencies alone (a cosine of ``BAR`` less the least ratio counts as neutral).
    """
    given = words.join(linked, "w")
    plain = F.log(F.col("m") / F.col("n"))
    if vector is None:
        scored = given.select("tab", "row", "w", "c", (plain + BAR - F.log(F.lit(float(RATIO)))).alias("score"))
    else:
        near = given.select("tab", "row", "w", "c", plain.alias("plain"), F.explode_outer("ctx").alias("word"))
        near = near.join(vector, "word", "left").join(vector.select(F.col("word").alias("c"), F.col("v").alias("u")), "c", "left")
        cosine = F.aggregate(F.zip_with("v", "u", lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda a, x: a + x)
        neutral = (BAR - F.log(F.lit(float(RATIO)))) / CONTEXT
        scored = near.groupBy("tab", "row", "w", "c").agg((F.max("plain") + CONTEXT * F.coalesce(F.avg(cosine), neutral)).alias("score"))
    best = scored.groupBy("tab", "row", "w").agg(F.max_by("c", F.struct("score", "c")).alias("c"), F.max("score").alias("score"))
    return best.filter(F.col("score") >= BAR - 1e-9).select("tab", "row", "w", "c")


_SIGNED = regex.compile(r"[\p{L}\p{N}]")
_RULED = regex.compile(r"[-–—=*_#]{3,}")
_LETTER, _COUNTED, _PARTED, _BLANK_LINE = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}\d-\s*$"), regex.compile("[’'-]"), regex.compile(r"\n\s*\n")


def is_stray(token: str) -> bool:
    if token[0].isalpha() or token[-1].isalpha() or token.isdecimal():
        return False
    bare = token.strip(BREAKS) or token
    return not _SIGNED.search(bare) and bare not in ORDINARY and not _RULED.fullmatch(bare)


#: Marks that stand at the edges of words and numbers.
_MARKS = ".,;:!?…()[]{}«»“”„‘’'\"–—·›#*_`"
_PLAIN = regex.compile(r"[\d.,:/%–-]+")


def suspects(line: str, known: frozenset) -> list[str]:
    """The tokens of a line that hold more than known words and numbers."""
    out = []
    for token in line.split():
        bare = token.strip(_MARKS).lower()
        if bare in known or (bare.isdigit() and bare.isascii()):
            continue
        if not bare:
            if token not in ORDINARY:
                out.append(token)
        elif not (_PLAIN.fullmatch(bare) or (("’" in bare or "-" in bare or "'" in bare) and all(not x or x in known or len(x) == 1 and x.isalpha() for x in _PARTED.split(bare)))):
            out.append(token)
    return out


def around(line: list[str], at: int) -> tuple[str, ...]:
    """The words beside the one at ``at`` of a line's bare tokens."""
    return tuple(x for x in (*line[max(0, at - AROUND) : at], *line[at + 1 : at + 1 + AROUND]) if x.isalpha())


def line_noise(line: str, after: str | None, before: str | None, furniture: bool, known: frozenset) -> set[tuple]:
    """What one line holds, with the body lines around it: (hyphen,) for a word broken at its end, (half, first-second) if it may be a compound's
    hyphen, (chars,) for stray or odd signs, (word, w, words around) for each word to look up."""
    bad = suspects(line, known)
    stripped = line.rstrip()
    ends_open = not furniture and stripped[-1:] in BREAKS and stripped[-1:] != ""
    begins_open = before is not None and before.rstrip()[-1:] in BREAKS and before.strip() != ""
    if not bad and not ends_open:
        return set()
    row = line.lstrip().startswith("|")
    out: set[tuple] = set()
    if any(is_stray(t) and not (t == "|" and (furniture or row)) for t in bad) or any(_ODD.search(_CODE.sub(" ", f" {t}" if not line.startswith(t) else t)) for t in bad):
        out.add(("chars", None, None))
    bare = [t.strip(_MARKS).lower() for t in line.split()]
    lookup = [(w, around(bare, k)) for t in bad for k in (bare.index(t.strip(_MARKS).lower()),) for w in words(t)]
    if ends_open and (m := _BROKEN.search(line)) and _LETTER.search(m[1]):
        half = _HEAD.match((after or "").lstrip())
        first, second = m[1].lower(), half[0].lower() if half else ""
        if lookup and lookup[-1][0] == first:
            lookup.pop()
        if not (m[2] == "-" and _COUNTED.search(line)):
            out.add(("half", f"{first}-{second}", None) if m[2] == "-" and second else ("hyphen", None, None))
            if second:
                lookup.append((first + second, around(bare, len(bare) - 1)))
    if begins_open and lookup and (m := _BROKEN.search(before)) and _LETTER.search(m[1]) and (head := _HEAD.match(line.lstrip())) and lookup[0][0] == head[0].lower():
        lookup[0] = (m[1].lower() + lookup[0][0], lookup[0][1])
    return out | {("word", w, ctx) for w, ctx in lookup if w not in known and len(w) > 1}


class Noise:
    """The evidence over all tables: frequent words, hyphened words, links, and the noise of every block and page."""

    def __init__(self, blocks: DataFrame, pages: DataFrame, all_texts: DataFrame):
        spark = pages.sparkSession
        self.pages = pages
        vocabulary = written(counts(all_texts, "text"), "words")
        self.compounds = vocabulary.filter(F.col("w").contains("-") & (F.col("n") >= 3)).select("w")
        self.vocabulary = vocabulary.filter(~F.col("w").contains("-"))
        self.links = written(links(self.vocabulary), "links")
        top = self.vocabulary.filter("n >= 20").join(self.links.select("w"), "w", "left_anti").orderBy(F.desc("n"), "w").limit(FREQUENT).select("w")
        self.known = spark.sparkContext.broadcast(frozenset(top.toArrow()["w"].to_pylist()))
        self.rows = written(self._rows(blocks), "noise")
        texts = pages.filter(F.length("markdown") > 0).select(F.col("markdown").alias("text"))
        vector = None if self.links.isEmpty() else vectors(self.vocabulary, written(by_batch(texts, "ws array<string>", _sentences), "sentences"))
        vector = vector if vector is None else written(vector, "vectors")
        once = self.rows.filter("kind = 'word'").groupBy("tab", "row", "w").agg(F.flatten(F.collect_set("ctx")).alias("ctx"))  # of one page or block
        self.read = written(read(once, self.links, vector), "read")
        # halves that are written with their hyphen elsewhere are compounds
        self.halves = self.rows.filter("kind = 'half'").select("tab", "row", "w")

    def _rows(self, blocks: DataFrame) -> DataFrame:
        """(tab, row, source_path, page_number, kind, w, ctx): kind is furniture (with its text), hyphen, half (with both halves; pair where
        only the page's text joins them), chars, or word for one to look up, with the words around it.

        A page is one group of its blocks and deliveries, whose number the page bounds. Its lines are those of its blocks; lines of its text that no
        block holds are looked at by themselves. The first and last lines of the pages around serve words broken over pages.
        """
        known, keys = self.known, ["source_path", "page_number"]
        number = F.coalesce("page_number", F.lit(-1)).alias("page_number")
        b = blocks.filter(F.col("source_path").isNotNull() & F.col("text").isNotNull()).select("block_id", "source_path", number, *[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("x_min", "y_min", "y_max")], "text")
        high = F.col("y_max") - F.col("y_min")
        body = b.groupBy("source_path").agg(F.percentile_approx(high, 0.6).alias("body"))
        b = b.join(body, "source_path").withColumn("small", high < 0.85 * F.col("body"))
        at = F.struct("y_min", "x_min")
        g = b.groupBy(*keys).agg(F.collect_list(F.struct("block_id", "x_min", "y_min", "y_max", "small", "text")).alias("blocks"), F.min_by("text", F.when(~F.col("small"), at)).alias("first"), F.max_by("text", F.when(~F.col("small"), at)).alias("last"))
        p = self.pages.filter(F.col("source_path").isNotNull() & (F.length("markdown") > 0)).select("page_id", "source_path", number, F.col("markdown").alias("text"))
        p = p.groupBy(*keys).agg(F.collect_list(F.struct("page_id", "text")).alias("pages"))
        # the pages before and after by equal joins: a document of any length is spread over its pages
        by = lambda step, col, name: g.select("source_path", (F.col("page_number") + step).alias("page_number"), F.col(col).alias(name))
        g = written(g, "boxes")
        ends = by(-1, "first", "after").join(by(1, "last", "before"), keys, "full")
        self.boxes = g.drop("first", "last").join(ends, keys, "left")
        given = g.drop("first", "last").join(p, keys, "full").join(ends, keys, "left").select(*keys, "blocks", "pages", "after", "before")

        def make(c: dict) -> dict:
            have = known.value
            names = ("tab", "row", "source_path", "page_number", "kind", "w", "ctx")
            out: dict[str, list] = {k: [] for k in names}

            def add(tab: str, ids, path: str, page: int, got: set) -> None:
                for i in ids:
                    for kind, w, ctx in got:
                        for k, v in zip(names, (tab, i, path, page, kind, w, ctx)):
                            out[k].append(v)

            for path, page, boxes, texts, after, before in zip(*(c[k].to_pylist() for k in ("source_path", "page_number", "blocks", "pages", "after", "before"))):
                lines = lines_of(boxes or [])
                every: set = set()
                for ids, t, small, prev, nxt in in_order(lines, before, after):
                    got = line_noise(t, nxt, prev, small, have) | ({("furniture", t, None)} if small else set())
                    add("text_blocks", ids, path, page, got)
                    every |= got
                seen = {" ".join(" ".join(t for _, t in pieces).split()) for pieces, _ in lines}
                small = [t for pieces, s in lines if s for _, t in pieces]
                for page_id, text in ((x["page_id"], x["text"]) for x in texts or ()):
                    core, edge = body_lines(text, small if lines else None)
                    mine = {x for x in every if x[0] != "furniture"} | ({("furniture", None, None)} if edge else set())
                    whole = "\n".join(core)
                    mine |= {("pair", f"{m[1]}-{m[3]}".lower(), None) for m in (_SPLIT.finditer(whole) if _WRAPPED.search(whole) else ()) if m[2] == "-"}
                    for n, line in enumerate(core):
                        bare = " ".join(line.lstrip("# ").split())
                        if bare not in seen and " ".join(line.split()) not in seen:
                            mine |= line_noise(line, core[n + 1] if n + 1 < len(core) else after, core[n - 1] if n else before, False, have)
                    add("parsed_pages", [page_id], path, page, mine)
            return out

        return by_batch(given, "tab string, row bigint, source_path string, page_number int, kind string, w string, ctx array<string>", make)

    def found(self) -> DataFrame:
        """(table_name, row_id, noise), one row per kind that occurs."""
        sure = self.rows.filter(F.col("kind").isin("furniture", "hyphen", "chars")).select("tab", "row", "kind")
        broken = self.halves.join(self.compounds, "w", "left_anti").select("tab", "row", F.lit("hyphen").alias("kind"))
        misread = self.read.select("tab", "row", F.lit("chars").alias("kind"))
        return sure.union(broken).union(misread).distinct().select(F.col("tab").alias("table_name"), F.col("row").alias("row_id"), F.col("kind").alias("noise"))

    def _meant(self, tab: str) -> DataFrame:
        """(row, meant, compounds): of each row of a table the words that were meant and the compounds that keep their hyphen."""
        meant = self.read.filter(F.col("tab") == tab).groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("w", "c"))).alias("meant"))
        kept = self.rows.filter(F.col("kind").isin("half", "pair") & (F.col("tab") == tab)).select("row", "w").join(self.compounds, "w", "left_semi").groupBy("row").agg(F.collect_set("w").alias("compounds"))
        return meant.join(kept, "row", "full")

    def blocks(self) -> DataFrame:
        """(block_id, source_path, page_number, text): every block as it was meant: furniture is empty, stray signs are gone, misread words as meant, a
        broken word whole at the end of the line it begins on, also over pages. Blocks without path or text have no row."""
        keys = ["source_path", "page_number"]
        words = self._meant("text_blocks").select(F.col("row").alias("block_id"), "meant", "compounds")
        of = self.rows.filter("tab = 'text_blocks'").select(*keys, F.col("row").alias("block_id")).distinct().join(words, "block_id")
        page = of.groupBy(*keys).agg(F.flatten(F.collect_list(F.map_entries(F.coalesce("meant", F.create_map().cast("map<string,string>"))))).alias("meant"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("compounds", F.array().cast("array<string>"))))).alias("compounds"))

        def make(c: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("block_id", *keys, "text")}
            for path, number, boxes, after, before, meant, compounds in zip(*(c[k].to_pylist() for k in (*keys, "blocks", "after", "before", "meant", "compounds"))):
                means, kept = {x["key"]: x["value"] for x in meant or ()}, frozenset(compounds or ())
                for ids, t, small, prev, nxt in in_order(lines_of(boxes or []), before, after):
                    text = "" if small else whole_line(t, prev, nxt, means, kept)
                    for i in ids:
                        for k, v in zip(out, (i, path, number, text)):
                            out[k].append(v)
            return out

        number = F.nullif("page_number", F.lit(-1)).alias("page_number")
        return by_batch(self.boxes.join(page, keys, "left"), "block_id bigint, source_path string, page_number int, text string", make).select("block_id", "source_path", number, "text")

    def repaired(self) -> DataFrame:
        """(page_id, source_path, page_number, text): every page as continuous paragraphs; null and empty pages stay so.

        A word broken over two pages stands whole at the end of the first. Of a page's deliveries the one with the least key tells its halves.
        """
        keys = ["source_path", "page_number"]
        meant = self._meant("parsed_pages")
        small = self.rows.filter("tab = 'text_blocks' AND kind = 'furniture'").groupBy("source_path", "page_number").agg(F.collect_set("w").alias("furniture"))
        p = self.pages.select("page_id", "source_path", "page_number", F.col("markdown").alias("text")).join(meant, F.col("page_id") == F.col("row"), "left").drop("row")
        p = p.join(small, keys, "left").select("page_id", *keys, "text", "furniture", "meant", "compounds")
        kept = ("page_id", *keys, "meant", "compounds")

        def flat(c: dict) -> dict:
            blocks = [paragraphs(t, f, frozenset(k or ())) if t else None for t, f, k in zip(*(c[x].to_pylist() for x in ("text", "furniture", "compounds")))]
            ends = [ends_of(x or []) for x in blocks]
            return {k: c[k] for k in kept} | {"empty": [t if not t else None for t in c["text"].to_pylist()], "blocks": blocks, "head": [x[0] for x in ends], "tail": [x[1] for x in ends]}

        schema = "page_id bigint, source_path string, page_number int, meant map<string,string>, compounds array<string>, empty string, blocks array<string>, head string, tail string"
        p = written(by_batch(p, schema, flat), "paragraphs")
        ends = p.filter("blocks is not null and source_path is not null and page_number is not null").groupBy(*keys).agg(F.min_by(F.struct("head", "tail"), "page_id").alias("e")).select(*keys, "e.*")
        # the few pages that end in half a word meet the next by an equal join: a document of any length is spread over its pages
        heads = ends.filter("head is not null").select("source_path", (F.col("page_number") - 1).alias("page_number"), F.col("head").alias("after"))
        over = ends.filter("tail is not null").join(heads, keys)
        pair = F.when(F.col("tail").endswith("-"), F.lower(F.concat("tail", F.regexp_extract("after", r"^[\p{L}\p{M}\p{N}]+", 0)))).otherwise("")
        # a compound broken over two pages keeps its hyphen
        over = written(over.withColumn("w", pair).join(self.compounds.withColumn("whole", F.col("w")), "w", "left").select(*keys, "after", "whole"), "over")
        p = p.join(over, keys, "left").join(over.select("source_path", (F.col("page_number") + 1).alias("page_number"), F.col("after").alias("gone")), keys, "left")

        def make(c: dict) -> dict:
            given = zip(*(c[k].to_pylist() for k in ("empty", "blocks", "meant", "compounds", "after", "whole", "gone")))
            return {k: c[k] for k in ("page_id", *keys)} | {"text": [e if b is None else reflow(b, dict(m or ()), {*(k or ()), w}, after, gone) for e, b, m, k, after, w, gone in given]}

        return by_batch(p, "page_id bigint, source_path string, page_number int, text string", make)

    def documents(self) -> DataFrame:
        """(source_path, text): every document in the order of its pages, paragraphs that go on over pages as one. A page delivered several times
        counts once; pages without a number come last."""
        p = self.repaired().filter(F.col("source_path").isNotNull() & (F.length("text") > 0))
        # by the number of the page; pages without one each by themselves, last
        number = F.coalesce("page_number", F.lit(2**31 - 1))
        once = p.groupBy("source_path", number.alias("page_number"), F.when(F.col("page_number").isNull(), F.col("page_id")).alias("alone")).agg(F.min_by(F.struct("page_id", "text"), "page_id").alias("p"))
        gathered = once.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("page_number", "p.page_id", "p.text"))).alias("pages"))
        return by_batch(gathered, "source_path string, text string", lambda c: {"source_path": c["source_path"], "text": [continuous([x["text"] for x in pages]) for pages in c["pages"].to_pylist()]})


def lines_of(boxes: list[dict]) -> list[tuple[list[tuple[list[int], str]], bool]]:
    """Lines of a page from its blocks in reading order: pieces (ids of equal deliveries, text), and whether the line is furniture: small, and
    among the first or last three."""
    same: dict[tuple, list[int]] = {}
    for x in boxes:
        same.setdefault((x["y_min"], x["x_min"], x["text"], x["y_max"], x["small"]), []).append(x["block_id"])
    lines: list[list] = []
    last = None
    for (y, x, text, y2, small), ids in sorted(same.items(), key=lambda i: i[0][:3]):
        mid = (y + y2) / 2
        if last is None or mid - last > 0.4 * max(y2 - y, 1):
            lines.append([])
            last = mid
        lines[-1].append((x, ids, text, small))
    out = []
    for k, line in enumerate(lines):
        line.sort(key=lambda p: p[0])
        out.append(([(ids, t) for _, ids, t, _ in line], (k < 3 or k >= len(lines) - 3) and all(s for *_, s in line)))
    return out


def in_order(lines: list, before: str | None, after: str | None):
    """(ids, text, small, text before, text after) of the pieces of a page's lines; body pieces have the body around them, over the page's edges
    that of the pages beside it."""
    flat = [(ids, t, small) for pieces, small in lines for ids, t in pieces]
    inner = [k for k, x in enumerate(flat) if not x[2]]
    place = {k: j for j, k in enumerate(inner)}
    for k, (ids, t, small) in enumerate(flat):
        if (j := place.get(k)) is None:
            yield ids, t, small, None, None
        else:
            yield ids, t, small, flat[inner[j - 1]][1] if j else before, flat[inner[j + 1]][1] if j + 1 < len(inner) else after


def _sentences(c: dict) -> dict:
    return {"ws": [[x for w in _JOIN.sub("", t).split() if (x := w.strip(_MARKS).lower())] for t in c["text"].to_pylist()]}


def body_lines(text: str, furniture: list[str] | None) -> tuple[list[str], list[str]]:
    """(body lines without blank ones, furniture lines) of a page's text; without blocks only bare page numbers at the edges are furniture."""
    lines = [x for x in text.split("\n") if x.strip()]
    small = {x.strip() for x in furniture or ()}
    body, edge = [], []
    for k, x in enumerate(lines):
        at_edge = k < 3 or k >= len(lines) - 3
        if at_edge and (x.strip() in small or (not furniture and k in (0, len(lines) - 1) and _NUMBER.match(x))):
            edge.append(x)
        else:
            body.append(x)
    return body, edge


_SPLIT = regex.compile(rf"([\p{{L}}\p{{M}}$@|\d]+)([{BREAKS}]) ?\n\s*(?=(\p{{L}}?[\p{{Ll}}\p{{M}}$@|\d]+))")


#: The half of a word that ends a page, and what may go on with it on the next.
_TAIL = regex.compile(rf"([\p{{L}}\p{{M}}$@|\d]*[\p{{L}}\p{{M}}$@|])([{BREAKS}])$")
_GOES_ON = regex.compile(r"(?:\p{Ll}|[$@|\d]\p{Ll})\S*")
_SHAPED = regex.compile(r"^(?:\||#|[-*+]\s|\d+[.)]\s)", regex.M)


def paragraphs(text: str, furniture: list[str] | None, compounds: frozenset) -> list[str]:
    """Paragraphs of a page without furniture and stray signs, words broken over lines joined. ``compounds`` keep their hyphen."""
    _, edge = body_lines(text, furniture)
    drop = Counter(edge)
    kept = []
    for line in text.split("\n"):
        if drop.get(line):
            drop[line] -= 1
            continue
        kept.append(" ".join(t for t in line.split() if not is_stray(t)) if not line.lstrip().startswith("|") else line)
    blocks = [_SPLIT.sub(lambda m: m[1] + hyphen(m[1], m[2], m[3], compounds), x) if _WRAPPED.search(x) else x for x in _BLANK_LINE.split("\n".join(kept))]
    return [x for x in (b.strip() if _SHAPED.search(b) else " ".join(b.split()) for b in blocks) if x]


def hyphen(first: str, sign: str, second: str, compounds: frozenset) -> str:
    """The hyphen that stays between two halves, if any."""
    return "-" if sign == "-" and (f"{first}-{second}".lower() in compounds or first[-1].isdigit()) else ""


def ends_of(blocks: list[str]) -> tuple[str | None, str | None]:
    """(what may go on with a word of the page before, half of a word that ends this page); None where there is none."""
    head, tail = (_GOES_ON.match(blocks[0]), _TAIL.search(blocks[-1])) if blocks else (None, None)
    # a page that is nothing but a part of a word would be both
    return (None, None) if head and head.end() == len(blocks[0]) and tail and len(blocks) == 1 else (head and head[0], tail and tail[0])


_BREAKS = frozenset(BREAKS)
_SMALL, _STOP = regex.compile(r"\p{Ll}"), regex.compile(r"[.!?…:;]\W*$")


def continuous(pages: list[str]) -> str:
    """Pages as one text; a paragraph without its stop goes on with the next page if that begins in lower case."""
    out: list[str] = []
    for text in pages:
        goes_on = out and _SMALL.match(text) and not _STOP.search(out[-1]) and not _SHAPED.search(out[-1])
        first, *rest = text.split("\n\n")
        if goes_on:
            out[-1] += f" {first}"
        else:
            out.append(first)
        out += rest
    return "\n\n".join(out)


def fixer(meant: dict[str, str]):
    """Puts the word that was meant in place of a match, in the same case."""

    def fix(m: regex.Match) -> str:
        w = m[0].rstrip("!")
        to = meant.get(w.lower())
        if to is None:
            return m[0]
        return (to.upper() if w.isupper() and len(w) > 1 else to.capitalize() if w[:1].isupper() or w[:1] in "870510" and m.start() and m.string[m.start() - 1] in " \n“«„(" and to != w.lower() and w[:1] in "87" else to) + m[0][len(w) :]

    return fix


def whole_line(line: str, before: str | None, after: str | None, meant: dict[str, str], compounds: frozenset) -> str:
    """A line without stray signs, its misread words as meant; a word broken at its end gets its second half, one broken before it loses that."""
    text = " ".join(t for t in line.split() if not is_stray(t)) if not line.lstrip().startswith("|") else line
    if before is not None and before.rstrip()[-1:] in _BREAKS and _TAIL.search(before.rstrip()) and (head := _GOES_ON.match(text)):
        text = text[head.end() :].lstrip()
    if after is not None and text[-1:] in _BREAKS and (m := _TAIL.search(text)) and (head := _GOES_ON.match(after.lstrip())):
        second = _HEAD.match(head[0])
        text = text[: m.end(1)] + hyphen(m[1], m[2], second[0] if second else "", compounds) + head[0]
    return (_WORD.sub(fixer(meant), text) if meant else text).strip()


def reflow(blocks: list[str], meant: dict[str, str], compounds: set, after: str | None = None, gone: str | None = None) -> str:
    """Paragraphs of a page as one text, misread words as meant. ``compounds`` keep their hyphen.

    ``after`` goes on with a word broken at the end of the page; the half ``gone`` at its beginning belongs to the page before.
    """
    blocks = list(blocks)
    head, tail = ends_of(blocks)
    if after and tail:
        m = _TAIL.search(blocks[-1])
        second = _HEAD.match(after)
        blocks[-1] = blocks[-1][: m.end(1)] + hyphen(m[1], m[2], second[0] if second else "", compounds) + after
    if gone and head == gone:
        blocks[0] = blocks[0][len(gone) :].lstrip()
    if meant:
        fix = fixer(meant)
        blocks = [_WORD.sub(fix, b) for b in blocks]
    return "\n\n".join(x for b in blocks if (x := b.strip()))
