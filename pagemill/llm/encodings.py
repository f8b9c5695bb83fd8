"""Problem 5: text decoded with the wrong character encoding.

Every line that could be the product of a wrong decoding is decoded again along each chain of codecs that its characters allow. A
reading costs what zstandard, primed with a dictionary of one language, needs to write it down, an escape for each character that clean
text of the corpus doesn't hold, and the cost of its chain; the cheapest reading wins, and the text as it stands wins ties. It is read
again while that makes it cheaper. Characters that only a lost decoding leaves behind mark a line beyond repair.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import by_batch
from pagemill.llm.sentences import kind_of

#: Encodings by which a text may have been read wrongly, and those in which it may have been written. Fixed values.
READ_AS = ("windows-1252*", "latin-1", "mac-roman", "cp850", "cp437", "gb18030", "cp1251", "koi8-r", "cp932", "big5", "cp1250", "cp1254", "cp866", "cp1253", "iso8859-15")
WRITTEN_IN = ("cp932", "euc-jp", "gb18030", "big5", "euc-kr", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "cp1252", "mac-roman", "cp850", "cp437")
#: What a step of a chain costs, in bytes: rare pairs cost more.
COMMON_STEP, RARE_STEP = 2, 6
#: What a character that clean text doesn't hold costs, in bytes, and how often a text is read again at most.
ESCAPE, LONGEST = 3, 4
#: Windows of so many words, or in scripts without blanks and in longer words than these of so many letters, are counted for the dictionaries.
WORDS, LETTERS, LONG_WORD = 5, 4, 32

_CODE_SPAN = regex.compile(r"(`+)[^`\n]*\1")
_LOST = regex.compile(r"[�\x80-\x84\x86-\x9f-]|(?<=\p{Ll})\?(?=\p{Ll})(?<!https?://\S*)")
_LOST_SIGN = re.compile(r"[�\x80-\x84\x86-\x9f-]")
#: Shapes that no orthography of the languages has: runs of accented letters, marks or capitals within words, words of two scripts.
_ODD = regex.compile(
    r"[\u0080-ÿ]{3}|\p{Ll}[^\x00-\x7f\p{L}\p{M}\p{Pd}\p{Pf}\p{Pi}°ºª·’'­\s，。、：；！？（）「」《》…]+\p{Ll}|\p{Ll}[À-ÖØ-ÞŒŠŽŸ]\p{Ll}|\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin}"
    r"|\p{Ll}[„‚“]\p{Ll}|(?<=\p{Cyrillic})\p{Lu}(?<=\p{Ll}\p{Lu})|[─-▟]|[А-Яа-я]{2}[Ђ-Џђ-џ°±]|\p{Ll}[‰ŽŠ™›]"
)
#: windows-1252 as lenient readers use it: its five unassigned bytes stand for the controls of the same number.
_LENIENT = {ord(bytes([i]).decode("cp1252", "ignore") or chr(i)): i for i in range(256)}
_RUN = re.compile(r"[^\x00-\x7f]+")
_HAN = regex.compile(r"[\p{Han}\p{Hangul}\p{Katakana}]")
_CYRILLIC = regex.compile(r"[А-Яа-яЁё]+")
#: Signs and small letters that ordinary texts hold, alone between ASCII; they need no second look. Fixed values.
_ORDINARY = frozenset("“”‘’—–…«»·§°ºª№¿¡€•©®→✅📎\u00a0àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ")
_WIDE = frozenset(("gb18030", "cp932", "big5"))


def encoded(text: str, codec: str) -> bytes | None:
    """``text`` as bytes of ``codec``; the starred codec also takes the five controls that readers of windows-1252 let pass."""
    try:
        return codecs.charmap_encode(text, "strict", _LENIENT)[0] if codec[-1] == "*" else text.encode(codec)
    except (UnicodeEncodeError, ValueError):
        return None


def _read(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def _decoded(text: str, read: str, written: str) -> str | None:
    raw = encoded(text, read)
    return None if raw is None else _read(raw, written)


@lru_cache(1 << 16)
def _run_as_utf8(run: str, read: str) -> str:
    return _decoded(run, read, "utf-8") or run


def _lost(text: str) -> bool:
    return bool(_LOST_SIGN.search(text) or "?" in text and _LOST.search(text))


def _places(text: str) -> set[str]:
    """Each character beyond ASCII between its neighbours."""
    text = f" {text} "
    return {text[i - 1 : i + 2] for i, x in enumerate(text) if x > "\x7f"}


def applied(text: str, read: str, written: str) -> str | None:
    """``text`` with every run of characters beyond ASCII read again; into UTF-8 a run that can't be stays, else all must be."""
    if written != "utf-8":
        return _decoded(text, read, written)
    return _RUN.sub(lambda m: _run_as_utf8(m[0], read), text)


@lru_cache(1 << 16)
def _as_utf8(run: str) -> tuple[str, ...]:
    """The codecs whose bytes of a run are UTF-8; runs come back so often that most are looked up."""
    if len(run) < 2 or "\ufffd" in run or _CYRILLIC.fullmatch(run):
        return ()
    wide, narrow = bool(_HAN.search(run)), max(run) < "\u3000"
    return tuple(x for x in READ_AS if (wide if x in _WIDE else narrow) and _decoded(run, x, "utf-8") is not None)


class Usual:
    """What clean text of the corpus holds beyond ASCII: its characters, and the kinds of neighbours each of them has."""

    def __init__(self, seen: Mapping[str, float] | None = None, least: int = 3, share: float = 0.001):
        """``seen``: in how many parts each context stands, of all parts of the corpus; languages may be weighted."""
        seen = seen or {}
        total: defaultdict = defaultdict(float)
        for (_, x, _), n in sorted(seen.items()):
            total[x] += n
        total = {x: round(n, 6) for x, n in total.items()}
        self.signs = frozenset(x for x, n in total.items() if n >= least) | frozenset(map(chr, range(128)))
        self.places = frozenset(k for k, n in seen.items() if n >= max(2, share * total[k[1]]))

    @staticmethod
    @lru_cache(1 << 16)
    def context(place: str) -> str:
        kind = lambda x: "a" if x.islower() else "A" if x.isupper() else "l" if x.isalpha() else "0" if x.isdigit() else " " if x.isspace() else "." if x.isascii() else x
        return kind(place[0]) + place[1] + kind(place[2])

    @classmethod
    def contexts(cls, text: str) -> set[str]:
        return set(map(cls.context, _places(text)))

    def odd(self, text: str) -> bool:
        return not self.places.issuperset(map(self.context, _places(text)))

    def strangers(self, text: str) -> int:
        return len(set(text) - self.signs)


def readings(text: str, depth: int = 2, usual: Usual | None = None) -> dict[str, tuple[tuple[str, str], ...]]:
    """Every other reading of ``text``, with the shortest chain (read as, written in) that leads there.

    Any codec's bytes may be UTF-8. All other pairs are tried where the text has a shape that no orthography has, or, with ``usual``, a
    character where clean text doesn't have it.
    """
    found: dict[str, tuple] = {}
    front = {text: ()}
    for level in range(depth):
        after: dict[str, tuple] = {}
        for t, chain in front.items():
            own = set(_RUN.findall(t))
            able = set().union(*map(_as_utf8, own))
            tried = [((x, "utf-8"), applied(t, x, "utf-8")) for x in READ_AS if x in able] if able else []
            if level == 0 and "\ufffd" not in t and (usual is not None and usual.odd(t) or not _ORDINARY.issuperset("".join(own)) and _ODD.search(t)):
                met: set[bytes] = set()  # codecs that give the same bytes give the same readings
                for x in READ_AS:
                    if (raw := encoded(t, x)) is not None and raw not in met:
                        met.add(raw)
                        tried += [((x, w), new) for w in WRITTEN_IN if (new := _read(raw, w)) is not None and not _lost(new)]
            for pair, new in tried:
                if new != t and new != text and new not in found and new not in after:
                    after[new] = (*chain, pair)
        found |= after
        front = {t: c for t, c in after.items() if not t.isascii() and c[-1][1] == "utf-8"}
    return found


def doubtful(text: str) -> bool:
    """Whether a text had better not be learnt from: one codec's bytes are UTF-8 in most of its runs, or its shape is no orthography's."""
    if text.isascii() and "?" not in text:
        return False
    own = _RUN.findall(text)
    most = Counter(x for r in own for x in _as_utf8(r)).most_common(1)
    return bool(_lost(text) or most and most[0][1] * 2 > len(own) or own and not _ORDINARY.issuperset("".join(own)) and _ODD.search(text))


class Judge:
    """The price of a text: the least of its sizes under the languages' dictionaries, and an escape for each character that clean text doesn't hold."""

    def __init__(self, dictionaries: dict[str, bytes], usual: Usual | None = None):
        import zstandard

        kind = lambda d: zstandard.DICT_TYPE_AUTO if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        given = [zstandard.ZstdCompressionDict(d, dict_type=kind(d)) for d in dictionaries.values()]
        self.tools = [zstandard.ZstdCompressor(level=3, dict_data=d, write_dict_id=False, write_content_size=False) for d in given] or [zstandard.ZstdCompressor(level=3, write_content_size=False)]
        self.usual = usual

    def strangers(self, text: str) -> int:
        return self.usual.strangers(text) if self.usual else 0

    def size(self, text: str) -> int:
        raw = text.encode("utf-8")
        return min([len(t.compress(raw)) for t in self.tools])

    def price(self, text: str) -> int:
        return self.size(text) + ESCAPE * self.strangers(text)

    def best(self, text: str) -> tuple[str, tuple]:
        """The cheapest reading and its chain; the text itself and () where nothing is cheaper. Chains grow while the price falls."""
        whole: tuple = ()
        for _ in range(LONGEST):
            most = self.strangers(text)
            # what was written well holds no more unknown characters than what became of it
            if most or not self.usual:
                options = [(new, own, n) for new, own in readings(text, usual=self.usual).items() if (n := self.strangers(new)) <= most]
            else:
                options = [(new, own, 0) for new, own in readings(text, usual=self.usual).items() if self.usual.signs.issuperset(new)]
            if not options:
                break
            least, best, chain = self.size(text) + ESCAPE * most, text, ()
            for new, own, n in options:
                steps = sum(COMMON_STEP if w == "utf-8" else RARE_STEP for _, w in own)
                if (cost := self.size(new) + ESCAPE * n + steps) < least:
                    least, best, chain = cost, new, own
            if not chain:
                break
            text, whole = best, whole + chain
        return text, whole


def repair(text: str, judge: Judge) -> tuple[str, bool, bool]:
    """(restored text, whether any of it was garbled, whether some is lost). Code spans are quotations: they alone make no case."""
    if text.isascii() and "?" not in text:
        return text, False, False
    out, garbled, lost = [], False, False
    for line in text.split("\n"):
        bare = _CODE_SPAN.sub("", line) if "`" in line else line
        if not bare.isascii():
            new, chain = judge.best(bare)
            if chain:
                garbled = True
                for pair in chain:
                    whole = applied(line, *pair)
                    line = line if whole is None else whole
                bare = new
        if _lost(bare):
            garbled = lost = True
        out.append(line)
    return "\n".join(out), garbled, lost


@dataclass(frozen=True)
class Trained:
    """What is learnt of clean text: a zstandard dictionary for each language, and what is usual beyond ASCII."""

    dictionaries: dict[str, bytes]
    usual: Usual


def _letters(text: str) -> set[str]:
    return {x for i in range(max(1, len(text) - LETTERS + 1)) if not (x := text[i : i + LETTERS]).isascii()}


def windows(part: str, language: str) -> set[str]:
    """What stands about the characters beyond ASCII of a part, as all else is alike in every reading: each run of ``WORDS`` words that holds one."""
    if language in ("cjk", "th"):
        return _letters(part)
    out: set[str] = set()
    words: list[str] = []
    for x in (*part.split(" "), None):
        if x is not None and len(x) <= LONG_WORD:
            words.append(x)
            continue
        if x and not x.isascii():
            out |= _letters(x)
        last = len(words) - WORDS
        held = (i for i, word in enumerate(words) if not word.isascii())
        starts = {a for i in held for a in range(max(0, min(i - WORDS + 1, last)), max(0, min(i, last)) + 1)}
        out.update([" ".join(words[a : a + WORDS]) + " " for a in starts])
        words = []
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of clean parts: how many of each language, and how many hold each context and each window; summed up as far as memory is to be used for it."""
    total: Counter = Counter()
    contexts: defaultdict = defaultdict(Counter)
    held: defaultdict = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(k, "part", "", n) for k, n in total.items()] + [(k, x, "", n) for k, c in contexts.items() for x, n in c.items()] + [(k, "", x, n) for k, c in held.items() for x, n in c.items()]
        for found in (total, contexts, held):
            found.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["language", "context", "window", "n"])

    size = 0
    for batch in batches:
        for part in batch.column(0).to_pylist():
            if doubtful(part):
                continue
            language = kind_of(part)[0]
            total[language] += 1
            if not part.isascii():
                contexts[language].update(Usual.contexts(part))
                held[language].update(own := windows(part, language))
                size += len(own)
            if size > 1 << 17:
                yield out()
                size = 0
    if total:
        yield out()


def dictionary(held: Mapping[str, int], parts: int, most: int = 1500, size: int = 16384) -> bytes:
    """A dictionary trained on ``most`` texts in which each window stands as often, by its share, as in the ``parts`` parts it was counted in.

    Where these are too few to train on, the windows themselves, those that save most last, as zstandard reaches them best.
    """
    import zstandard

    order = sorted(held, key=lambda x: (-held[x] * len(x.encode("utf-8")), x))
    texts: list[list[str]] = [[] for _ in range(most)]
    for k, x in enumerate(order):
        times = max(1, round(held[x] * min(1, most / parts)))
        for i in range(times):
            texts[(7 * k + i * most // times) % most].append(x)
    given = ["".join(x).encode("utf-8") for x in texts if x]
    if sum(map(len, given)) > 2 * size and len(given) > 16:
        try:
            return zstandard.train_dictionary(size, given).as_bytes()
        except zstandard.ZstdError:  # texts too much alike to train on
            pass
    return "".join(reversed(order)).encode("utf-8")[-size:]


def trained(df: DataFrame, key: str, text: str, most: int = 1500, size: int = 16384, best: int = 4096) -> Trained:
    """Dictionaries and contexts from the clean parts of all rows, whole; equal parts count once, whatever their ``key``.

    Contexts and windows are counted exactly. A context's count is the sum over languages, each weighted as ``most`` parts if it has more, so that a
    frequent language doesn't hide the others. A dictionary of ``size`` bytes is made from the ``best`` windows of its language by bytes
    times count, several times what it can hold.
    """
    parts = df.select(F.explode(F.split(F.col(text), "\n\n")).alias("part")).filter(F.length("part") > 20).distinct()
    # contexts are alone in their groups and all stay; windows are ranked in slices first, so that no task sorts all of a language
    slices = ["language", "context", "slice"]
    counts = parts.mapInArrow(_counts, "language string, context string, window string, n bigint").withColumn("slice", F.expr("pmod(xxhash64(window), 64)"))
    # the same exchange serves the sums and the ranks
    ranked = counts.repartition(*slices).groupBy(*slices, "window").agg(F.sum("n").alias("n"))
    by = [F.expr("n * octet_length(window)").desc(), F.col("window")]
    for group in (slices, slices[:2]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col("rank") <= best)
    total: dict[str, int] = {}
    contexts: list[tuple[str, str, int]] = []
    held: dict[str, dict[str, int]] = defaultdict(dict)
    for r in ranked.select("language", "context", "window", "n").collect():
        if r.context == "part":
            total[r.language] = r.n
        elif r.context:
            contexts.append((r.language, r.context, r.n))
        else:
            held[r.language][r.window] = r.n
    seen: defaultdict = defaultdict(float)
    for language, x, n in sorted(contexts):
        seen[x] += n * min(1, most / total[language])
    return Trained({k: dictionary(v, total[k], most, size) for k, v in sorted(held.items())}, Usual(seen))


def repaired(df: DataFrame, key: str, text: str, learnt: Trained) -> DataFrame:
    """key, text (as originally written where nothing was lost), garbled, lost; one row per row.

    Null and empty texts stay as they are and are not garbled.
    """
    kept: dict = {}

    def make(c: dict) -> dict:
        if not kept:
            kept["judge"] = Judge(learnt.dictionaries, learnt.usual)
        done = [(t, False, False) if not t else repair(t, kept["judge"]) for t in c["text"].to_pylist()]
        return {"key": c["key"], "text": [x[0] for x in done], "garbled": [x[1] for x in done], "lost": [x[2] for x in done]}

    kind = df.schema[key].dataType.simpleString()
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return by_batch(given, f"key {kind}, text string, garbled boolean, lost boolean", make).withColumnsRenamed({"key": key, "text": text})
