"""Problem 3: the main body of web pages.

A page is a tree of blocks, lines and inline leaves (links, crumbs, buttons). Every subtree is hashed without case, digits, link
targets and the host's own name. Spark counts the documents per (host, subtree) and the hosts per subtree: what recurs on most documents of a
host, or on many hosts, is template. Template subtrees are deleted with the block they head or fill; teasers, whose titles never recur,
go with the recurring heading above them.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import by_batch, source_of
from pagemill.session import written

_LINK = regex.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]*)\)")
_REST = regex.compile(r"[^\p{L}\p{M}]+")
_LEAF = regex.compile(r"\s*[›»|·•☰✕↑/>]+\s*|\s{2,}|\]\s*\[|\)\s*\[")
_MARK = regex.compile(r"^(?:[-*+•–]\s+|\d{1,3}[.)]\s+|#{1,6}\s+|>\s*)+|^[*_]{1,3}(?=\S)|[*_]{1,3}$")
_STOP = regex.compile(r"[.!?…:;。！？؟।][”’»“」』)\"*_]*$")
_CODE = regex.compile(r"(?:\d|\d[\p{Lu}])\s*[*_]*$")
_BLANKS = regex.compile(r"[^\p{L}\p{M}\p{N}©]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_BYLINE = regex.compile(r"\p{Lu}[^,]{2,60},\s+\p{Lu}[^,]{2,60}$")
_CRUMB = regex.compile(r"^[^›»>/|.!?]{1,40}(?:\s+[›»>/|]\s+[^›»>/|.!?]{1,60}){2,}$")
#: Phrases of notices, prompts and footers that articles don't use; a blank stands for any mark. Fixed values.
CUES = (
    " use cookies ", " uses cookies ", " cookies to ", " cookie policy ", " cookies propias ", " usamos cookies ", " des cookies ", " verwenden cookies ", " usamos cookies ", " copyright ", " all rights reserved ", " powered by ", " privacy ", " subscribe ", " newsletter ", " sign up ", " log in ", " our app ", " follow us ",
    " this site ", " this website ", " on your device ", " advertisement ", " sponsored ", " your e mail ",
    " datenschutz", " privatsphäre ", " diese website ", " impressum ", " alle rechte vorbehalten ", " abonnieren ", " anzeige ", " unsere app ", " folgen sie uns ",
    " vie privée ", " ce site ", " confidentialité ", " tous droits réservés ", " abonnez vous ", " s abonner ", " infolettre ", " publicité ", " suivez nous ", " notre appli", " notre lettre ",
    " privacidad ", " este sitio ", " derechos reservados ", " suscríbase ", " boletín ", " publicidad ", " síganos ", " nuestra app", " nif ",
    " este site ", " direitos reservados ", " assine ", " política de privacidade ",
)
_PHONE = regex.compile(r"\bT[eé]l[.:]?\s*\+?\d[\d\s]{5,}")


def cued(text: str) -> bool:
    low = f" {_BLANKS.sub(' ', text.lower())} "
    return "©" in text or any(map(low.__contains__, CUES)) or bool(_PHONE.search(text))


def host_words(path: str) -> list[str]:
    """The words of a page's host that name it: its first label without numbers."""
    host = path.split("/")[1] if path.count("/") else path
    return [w for w in regex.split(r"[^\p{L}\p{M}]+", host.split(".")[0].lower()) if len(w) > 2]


def plain(text: str, own: list[str]) -> str:
    """What is hashed of a subtree: its letters, without case, link targets and the host's name."""
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    text = text.lower()
    for w in own:
        if w in text:
            text = text.replace(w, "")
    return _REST.sub(" ", text).strip()


class Page:
    """A page's tree; ``blocks`` holds (line index, text) lists."""

    def __init__(self, path: str, text: str):
        self.own = host_words(path)
        self.lines = text.split("\n")
        self.blocks: list[list[tuple[int, str]]] = [[]]
        for i, line in enumerate(self.lines):
            if bare := line.strip():
                self.blocks[-1].append((i, bare))
            elif self.blocks[-1]:
                self.blocks.append([])
        self.blocks = [b for b in self.blocks if b]

    def leaves(self, line: str) -> list[str]:
        links = [m[0] for m in _LINK.findall(line)]
        if len(links) > 1:
            return [plain(x, self.own) for x in links]
        return [k for x in _LEAF.split(line) if (k := plain(x, self.own))]

    def subtrees(self) -> set[str]:
        """Lines, leaves of short lines, and blocks of several lines."""
        out: set[str] = set()
        for block in self.blocks:
            keys = [plain(x, self.own) for _, x in block]
            out.update(k for k in keys if k)
            if len(block) > 1:
                out.add("\n".join(keys))
            for (_, x), k in zip(block, keys):
                if len(x) < 400 and x[0] != "|" and not _STOP.search(x):
                    leaves = self.leaves(x)
                    if len(leaves) > 1:
                        out.update(leaves)
        return out

    def noise(self, template) -> list[int]:
        """Indexes of the lines that aren't main content; ``template(key)`` tells recurring subtrees."""
        out: list[int] = []
        heading = title = None
        for n, block in enumerate(self.blocks):
            kinds = [self.kind(x, template) for _, x in block]
            whole = len(block) > 1 and "table" not in kinds and template("\n".join(plain(x, self.own) for _, x in block))
            body = [k in ("table", "heading", "text", "item", "reference") for k in kinds]
            first = kinds[0]
            if whole or (first in ("template", "menu") and not any(k in ("text", "table") for k in kinds)):
                bad = [True] * len(block)  # a template block, or one headed by template: menus, teasers, footers
            elif any(k in ("template", "menu", "cue", "crumb") for k in kinds) and not any(b for b in body if b):
                bad = [True] * len(block)
            elif kinds.count("text") == len(kinds) or "table" in kinds:
                bad = [k in ("template", "menu", "cue", "crumb") for k in kinds]
            else:
                strong = sum(k in ("template", "menu", "cue", "crumb") for k in kinds)
                bad = [k in ("template", "menu", "cue", "crumb") or (strong and k in ("short", "item")) for k in kinds]
            if heading == n - 1 and not any(k in ("text", "table", "heading") for k in kinds):
                bad = [True] * len(block)  # titles under a teaser heading that stands alone
            elif len(block) == 1 and first == "short" and title != n - 1 and not _BYLINE.match(block[0][1]):
                bad = [True]  # neither sentence nor byline: a prompt
            if first == "heading":
                title = n
            if len(block) == 1 and first == "template" and block[0][1].lstrip()[0] in "#*":
                heading = n
            out += [i for (i, _), b in zip(block, bad) if b]
        return out

    def kind(self, x: str, template) -> str:
        if x[0] == "|":
            return "table"
        bare = _MARK.sub("", _MARK.sub("", x)).strip()
        key = plain(x, self.own)
        links = _LINK.findall(x)
        if not key:
            return "template" if template(plain(bare, [])) else "short"
        if template(key):
            return "text" if _CODE.search(bare) and not links and x != bare and x[0] != "#" else "template"
        if links:
            outside = _REST.sub("", _LINK.sub("", bare))
            if not outside:
                if all(t.startswith(("/", "#", "?")) for _, t in links):
                    return "menu"
                return "reference"
        if _CRUMB.match(bare):
            return "crumb"
        leaves = self.leaves(bare)
        if len(leaves) > 1 and len(bare) < 200 and not _STOP.search(bare) and sum(map(template, leaves)) * 2 >= len(leaves):
            return "menu"
        if len(bare) < 400 and cued(bare):
            return "cue"
        if x[0] == "#":
            return "heading"
        if _STOP.search(bare) and len(_WORD.findall(bare)) > 3:
            return "text"
        if x != bare and _CODE.search(bare):
            return "item"
        return "text" if len(bare) > 200 else "short"


def _hash(keys) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64).view(np.int64)


def _subtrees(c: dict) -> dict:
    row, marks = [], []
    for r, (p, t) in enumerate(zip(c["path"].to_pylist(), c["text"].to_pylist())):
        got = _hash(Page(p, t).subtrees())
        row += [r] * len(got)
        marks.append(got)
    return {k: c[k].take(row) for k in ("same", "host", "doc")} | {"mark": np.concatenate(marks) if marks else np.zeros(0, np.int64)}


def _decide(c: dict) -> dict:
    import xxhash

    keys, numbers = [], []
    for k, p, t, marks in zip(c["key"].to_pylist(), c["path"].to_pylist(), c["text"].to_pylist(), c["marks"].to_pylist()):
        known = frozenset(marks or ())

        def template(x: str) -> bool:
            h = xxhash.xxh3_64_intdigest(x)
            return h - ((h >> 63) << 64) in known  # noqa: B023

        got = Page(p, t).noise(template)
        keys += [k] * len(got)
        numbers += [i + 1 for i in got]
    return {"key": keys, "line_no": numbers}


def noise_lines(df: DataFrame, key: str, path: str, page: str, text: str, host_share: float = 0.1, least_documents: int = 3, all_share: float = 0.004, least_hosts: int = 3) -> DataFrame:
    """(key, line_no) of the non-blank lines that aren't main content.

    A subtree is template if at least ``least_documents`` documents and ``host_share`` of those of its host hold it, or at least ``least_hosts`` hosts and
    ``all_share`` of all hosts. Rows delivered twice count once. Null and empty texts and null paths give no row.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.xxhash64(source_of(F.col(path))).alias("host"), F.xxhash64(path, page).alias("doc"), F.xxhash64(path, text).alias("same"), F.col(path).alias("path"), F.col(text).alias("text")).filter((F.length("text") > 0) & F.col("path").isNotNull())
    each = written(by_batch(rows.select("same", "host", "doc", "path", "text"), "same bigint, host bigint, doc bigint, mark bigint", _subtrees), "subtrees")
    # a subtree of one host and document reaches the count once; partial counts go by (subtree, host), so no key holds more than a host's documents
    per_host = written(each.select("mark", "host", "doc").distinct().groupBy("mark", "host").agg(F.count("*").alias("n")), "counts")
    size = rows.groupBy("host").agg(F.count_distinct("doc").alias("docs"))
    bar = max(least_hosts, all_share * size.count())
    wide = per_host.groupBy("mark").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= bar).select("mark")
    local = per_host.filter(F.col("n") >= least_documents).join(size, "host").filter(F.col("n") >= host_share * F.col("docs")).select("mark", "host")
    template = per_host.join(wide, "mark", "left_semi").select("mark", "host").union(local).distinct()
    # of each page its own template subtrees, whatever its host or the corpus holds
    own = each.select("same", "mark", "host").distinct().join(template, ["mark", "host"], "left_semi").groupBy("same").agg(F.collect_list("mark").alias("marks"))
    given = rows.select("key", "same", "path", "text").join(own, "same", "left").select("key", "path", "text", "marks")
    return by_batch(given, f"key {kind}, line_no int", _decide).withColumnRenamed("key", key)
