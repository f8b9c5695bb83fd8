"""Problem 10: sentence units by cascading rule tables.

A rule is (break or not, pattern before the place, pattern after it). The rules of a paragraph's language come first, then those of
its script, then the general ones; the first rule that matches decides a place. Places are asked about only where a candidate
pattern of the script ends, so text without stops costs one search.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import by_batch

#: Abbreviations after which a sentence goes on, by language; `_` holds those of every language in Latin script. Fixed values.
ABBREVIATIONS = {
    "_": "dr prof mr mrs ms st jr fig figs vol vols pp approx cf vs e.g i.e a.k.a ca nos eq eds ltd inc corp dept sgt capt rev",
    "en": "co messrs tel",
    "de": "bzw nr abs vgl z.b d.h u.a hr fr art bd s ggf evtl inkl zzgl usf bspw sog kap dipl tel",
    "fr": "m mm mme mlle art réf p env av bd chap éd fasc tél apr",
    "es": "pág págs sr sra srta núm ej art ud uds cap tel aprox d dña",
    "pt": "sr sra srta n.º n pág págs art ex av cap tel aprox dra",
    "ru": "стр рис им ул т.е т.к напр см ср тыс млн млрд руб гг г-н г-жа проф акад тел",
    "hi": "डॉ श्री प्रो पृ सं कु",
    "ar": "د أ م ص ج",
}
#: Abbreviations that end a sentence unless a small letter follows. Fixed values.
ENDING = "etc|usw|др|пр|т\\.\\s?д|т\\.\\s?п|u\\.\\s?s\\.\\s?w"
MONTHS = "jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec"
#: Frequent small words that tell languages in Latin script apart. Fixed values.
SMALL = {
    "en": "the of and was by in is that for to from with before which her its has",
    "de": "die der und das für den aus mit sind wurden genau auch zum von wie nicht laut",
    "fr": "les des et le la de ont où du à par est sur dans un malgré selon déjà",
    "es": "los el en y que según de las del también son están más día se",
    "pt": "os em que o não e da dos também são para segundo após uma ao as",
}

CLOSE = r"[”’»“\"')\]）」』*_]"
OPEN = "“«„\"「『‹"
#: A place to ask about, by script: the end of each match.
CANDIDATES = {
    "latin": rf"[.!?…]+(?:\s?»|{CLOSE})*(?=\s)",
    "cjk": r"[。！？!?…]+[”’」』）)\"]*|\.(?=\s)",
    "thai": r"(?<=\S)(?=[^\S\n]*\n?[^\S\n]*\S)(?=\s)",
    "hindi": rf"[।.!?…]+{CLOSE}*(?=\s|\p{{L}})",
    "arabic": rf"[.!?؟…]+{CLOSE}*(?=\s)",
}
CANDIDATES["cyrillic"] = CANDIDATES["latin"]

#: Quotation marks that open, with those that close them, by family: a mark of a family ends the quotation before it.
FAMILIES = {"latin": ({"“": "”", "„": "“”"}, {"«": "»"}), "cjk": ({"“": "”」』", "「": "”」』", "『": "”」』"},)}
#: The rule that no sentence ends at a stop within a quotation, however long; where quotations lie is found by one pass over the paragraph.
QUOTED = (False, "quoted", "")
#: Rules of one language; they come before those of the script.
LANGUAGE = {
    "de": [(False, r"(?<![\p{L}\d.,-])\d{1,2}\.[*_]*", r"\s+[*_]*\p{L}")],
    "ru": [(False, r"(?<![\p{L}\d])г\.", r"\s+\p{Ll}")],
}
#: Rules of one script.
SCRIPT = {
    "cjk": [
        (False, r"…", r"[^”」』\s]"),
        (False, r"[。！？!?][」』”]", r"\s*(?:と|って|[、，。,])"),
        (True, r"[：:]\s*[“「『][^“”「」『』]*[。！？!?…][”」』]", ""),
        (False, r"(?:^|[。！？”」』])\s*[“「『][^“”「」『』]*[。！？!?…][”」』]", r"\s*[^\s“「『]"),
        QUOTED,
        (False, r"(?<![\p{Latin}\d])\p{Lu}\.", r"\s+\p{Lu}"),
    ],
    "thai": [
        (False, r"\d|\p{Latin}", r"\s+\p{Thai}"),
        (False, "", r"\s+(?:[\d\p{Latin}]|ๆ|ฯ|[)\]”’%])"),
        (False, r"ดร\.|นาย|นาง|นางสาว|พ\.ศ\.|ค\.ศ\.|[(\[“‘]", r"\s"),
        (False, r"[,:;]", r"\s"),
    ],
    "hindi": [(True, r"।", "")],
}
#: Rules for every script that parts words by blanks.
GENERAL = [
    (False, r"(?:\s|^)…", r"\s"),
    (True, rf"[:：]\s*[{OPEN}][^“”«»„\"]*[.!?…؟।]\s?[”»“\"]", r"\s"),
    (False, r"[.!?…؟।]\s?[”»“\"’]", r"\s+(?:[—–-]\s*)?\p{Ll}"),
    (False, r"[.!?…؟।]\s?[”»“\"’]", r"\s+[—–-]\s"),
    QUOTED,
    (True, rf"(?i:(?<![\p{{L}}\d])(?:{ENDING})\.)", r"\s+(?!\p{Ll})"),
    (False, r"(?i:(?<![\p{L}\d])[ap]\.\s?m\.)", r"\s+\p{Ll}"),
    (False, r"(?i:(?<![\p{L}\d])no\.)", r"\s+\d"),
    (False, rf"(?i:(?<![\p{{L}}\d])(?:{MONTHS})\.)", r"\s+\d"),
    (False, r"(?<![\p{L}\p{M}\d\-])\p{L}\.", r"\s+\p{L}"),
]
#: In a paragraph with capitals, a small letter goes on with the sentence.
CASED = [(False, r"[.!?…]", r"\s+\p{Ll}")]

_HEADING = regex.compile(r"#{1,6}\s|#{1,6}$")
_ITEM = regex.compile(r"(?:[-*+•]|\d{1,9}[.)])\s+\S")
_RULE = regex.compile(r"\|?[\s:|\-]*-[\s:|\-]*\|?$|[*_]\s*[*_]\s*[*_][\s*_]*$|<!--\s*page:\d+\s*-->$")
_SCRIPTS = {k: regex.compile(v) for k, v in {"cjk": r"[\p{Han}\p{Hiragana}\p{Katakana}]", "thai": r"\p{Thai}", "hindi": r"\p{Devanagari}", "arabic": r"\p{Arabic}", "cyrillic": r"\p{Cyrillic}"}.items()}
_ANY = regex.compile("|".join(p.pattern for p in _SCRIPTS.values()))
_BIG = regex.compile(r"\p{Lu}")
_SMALL = {k: frozenset(v.split()) for k, v in SMALL.items()}
_ANY_SMALL = frozenset().union(*_SMALL.values())


@lru_cache(None)
def rules(language: str, script: str, cased: bool) -> tuple[regex.Pattern | None, ...]:
    """The cascade of one kind of paragraph as patterns that match at a place: their alternatives are tried in order, and the first that
    holds is named ``y`` (break) or ``n``. None stands for ``QUOTED``."""
    also = ("_", "en", "de", "fr", "es", "pt") if script == "latin" else ("_", language)  # short texts hardly tell Latin languages apart
    words = sorted({w for k in also for w in ABBREVIATIONS.get(k, "").split()}, key=lambda w: (-len(w), w))
    short = [(False, rf"(?i:(?<![\p{{L}}\p{{M}}\d])(?:{'|'.join(regex.escape(w).replace('\\.', '\\.\\s?') for w in words)})\.)", r"\s")]
    table = LANGUAGE.get(language, []) + SCRIPT.get(script, [])
    if script not in ("cjk", "thai"):
        table = table + GENERAL[:6] + short + GENERAL[6:] + CASED * cased
    out: list[list] = [[]]
    for rule in table:
        out += [None, []] if rule is QUOTED else []
        if rule is not QUOTED:
            yes, before, after = rule
            out[-1].append((f"(?<={before})" if before else "") + f"(?={after})(?P<{'ny'[yes]}{len(out[-1])}>)")
    return tuple(p and regex.compile("|".join(p)) for p in out if p or p is None)


class Quotations:
    """Where the quotations of a paragraph lie, from one pass over its marks."""

    def __init__(self, text: str, script: str):
        self.text, self.stops = text, "。！？!?…" if script == "cjk" else ".!?…"
        self.families = []
        for closing in FAMILIES["cjk" if script == "cjk" else "latin"]:
            marks = "".join(closing) + "".join(closing.values())
            at = [m.start() for m in regex.finditer(f"[{marks}]", text)]
            if at:
                self.families.append((closing, at))

    def __contains__(self, at: int) -> bool:
        """Whether a stop before ``at`` stands within a quotation."""
        if self.text[at - 1] not in self.stops:
            return False
        for closing, marks in self.families:
            k = bisect_left(marks, at)
            if 0 < k < len(marks) and self.text[marks[k]] in closing.get(self.text[marks[k - 1]], ""):
                return True
        return False


def breaks(text: str, at: int, cascade: tuple, quoted: Quotations) -> bool:
    """Whether a sentence ends at a candidate place: what the first rule says that holds, else yes."""
    for pattern in cascade:
        if pattern is None:
            if at in quoted:
                return False
        elif first := pattern.match(text, at):
            return first.lastgroup[0] == "y"
    return True


def kind_of(text: str) -> tuple[str, str]:
    """(language, script) of a paragraph, from its letters and small words; declared languages are too often wrong."""
    if not text.isascii() and _ANY.search(text):
        latin = sum(map(str.isascii, filter(str.isalpha, text)))
        count, script = max((len(p.findall(text)), k) for k, p in _SCRIPTS.items())
        if count * (3 if script == "cjk" else 1.5) > latin:
            return {"cyrillic": "ru", "hindi": "hi", "arabic": "ar", "thai": "th", "cjk": "cjk"}[script], script
    words = [x for x in text.lower().split() if x in _ANY_SMALL]
    score, language = max((sum(map(s.__contains__, words)), k) for k, s in _SMALL.items())
    return (language if score else "en"), "latin"


_FIND = {k: regex.compile(v) for k, v in CANDIDATES.items()}


def sentences(text: str) -> list[tuple[int, int]]:
    """The sentences of one paragraph."""
    language, script = kind_of(text)
    cascade, quoted = rules(language, script, bool(_BIG.search(text))), Quotations(text, script)
    out, begin = [], 0
    for m in _FIND[script].finditer(text):
        at = m.end()
        if at > begin and breaks(text, at, cascade, quoted):
            out.append((begin, at))
            begin = at
    out.append((begin, len(text)))
    return out


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit in code points, in order, without blanks at either end."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    first = last = -1
    listed = False

    def trimmed(a: int, b: int) -> None:
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip()), a + len(part.rstrip())
        if a < b:
            out.append((a, b))

    def close() -> None:
        nonlocal first
        if first >= 0:
            for a, b in sentences(text[first:last]):
                trimmed(first + a, first + b)
        first = -1

    at = 0
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            close()
            listed = False
        elif bare[0] in "|-*_<:" and _RULE.match(bare):
            close()
        elif bare[0] == "|" or (bare[0] == "#" and _HEADING.match(bare)):
            close()
            trimmed(at, at + len(line))
        elif _ITEM.match(bare) and (first < 0 or listed or bare[0] in "-*+•"):  # a number that opens a later line of a paragraph is no list
            close()
            listed = True
            trimmed(at, at + len(line))
        else:
            if first < 0:
                first = at
            last = at + len(line)
        at += len(line) + 1
    close()
    return out


def split(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per unit of each text: key, start_pos, end_pos (code points, exclusive).

    Null, empty and blank texts give no row; every other row gives its own units, also with a repeated or null key.
    """

    def make(c: dict) -> dict:
        keys, begins, ends = [], [], []
        for k, t in zip(c["key"].to_pylist(), c["text"].to_pylist()):
            got = units(t)
            keys += [k] * len(got)
            begins += [a for a, _ in got]
            ends += [b for _, b in got]
        return {"key": keys, "start_pos": begins, "end_pos": ends}

    kind = df.schema[key].dataType.simpleString()
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return by_batch(given, f"key {kind}, start_pos bigint, end_pos bigint", make).withColumnRenamed("key", key)
