"""Problem 6: template residue, filler, error messages and script notices in place of content.

A unit is a block of a text (code left out). Fixed rules label the units that certainly are residue. Messages and templates come with other
words in their slots ("log in again to read the ..."), so words that a set share of all units hold are one sign, a slot, wherever rarer words
carry a unit: all fillings of a template are one unit then. A 64-bit SimHash of every distinct unit goes into four tables by a quarter of its bits; labelled units look up their near-duplicates there. What differs in more bits is found by a prefix
filter: two units as similar as asked share one of the first shingles of both, in the order of their hashes. Pairs of either way are verified
by the similarity of their five-word shingles, and labels spread until no unit of a component is left: only components that hold a
trusted label are ever walked, and exact copies count as one unit. Units without a shingle share labels when their signs are equal.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import by_batch
from pagemill.llm.vectors import categories, codes_of, grams, mixed, parts_of, slices
from pagemill.session import written

#: Unfilled placeholders, wherever they stand outside code. Fixed values.
PLACEHOLDERS = r"\{\{[^{}\n]*\}\}|\{%[^%\n]+%\}|\$\{[^{}\n]+\}|%\(\w+\)[sd]|<%[^%\n]+%>|<<\p{Lu}[\p{Lu}\d_]+>>|\[\[[\w .-]+\|[\w .-]+\]\]|__\p{Lu}[\p{Lu}\d]*(?:_[\p{Lu}\d]+)+__|<!--\s*FPE_IMG:[^\n]*?-->|FPE_IMG:p\{|<!--\s*placeholder\s*-->|@@\w+@@|\{\w*(?:name|title|number|idx|page)\w*\}|(?<![\w$\\{])\{\d\}|\[(?i:(?:first|last|full|your|customer|client|user|company)\s?name|date|title|address)\]|#(?:REF!|NAME\?|VALUE!|DIV/0!|NULL!)|\bdd[/.]mm[/.]yyyy\b|\b[xX]{6,}\b"
#: What a whole unit that is residue looks like from its start. Fixed values.
WHOLE = (
    r"lorem\s+ipsum\b|(?:TODO|TBD|FIXME|XXX)\b\s*[:—–-]|\[(?:insert|describe|add|enter|your|type|placeholder)\b[^\]\n]*\]$|undefined$|null$|nan$|n/a$|<alt text>$|\[object object\]$"
    r"|(?:figure|image|alt|caption)\s+(?:description|text)$|description\s+of\s+the\s+(?:image|figure)\s+goes\s+here|(?:your\s+)?text\s+(?:goes\s+)?here\b|click\s+(?:here\s+)?to\s+(?:add|edit|insert)\b|klicken\s+sie,?\s+um\b[^.\n]{0,40}\bhinzuzufügen|cliquez\s+pour\s+(?:ajouter|modifier)\b|haga\s+clic\s+para\s+(?:agregar|añadir|modificar)\b|clique\s+para\s+(?:adicionar|editar)\b"
    r"|error\s*:?\s*(?:http\s*)?[45]\d\d\b|http\s+(?:error\s+)?[45]\d\d\b|erreur\s*:?\s*[45]\d\d\b|fehler\s*:?\s*[45]\d\d\b|erro\s*:?\s*[45]\d\d\b|#+\s*[45]\d\d$|[45]\d\d\s+(?:not found|forbidden|bad gateway|internal server error|service unavailable|gone|too many requests)\b"
    r"|(?:seite|página|page)\s+(?:nicht gefunden|no encontrada|não encontrada|introuvable|not found)\b|the\s[^.\n]{1,60}\s?page\s+you\s+(?:asked|were looking)\b[^\n]*\bnot\s+be\s+found"
    r"|access\s+denied\b|forbidden$|service\s+unavailable\b|session\s+expired\b|request\s+timed\s+out\b|sorry,\s+something\s+went\s+wrong|something\s+went\s+wrong|too\s+many\s+requests\b|index\s+of\s+/|no\s+files\s+to\s+display\b"
    r"|#*\s*checking\s+your\s+browser\b|you\s+do\s+not\s+have\s+(?:leave|permission)\s+to\b|i\s+(?:cannot|can't|can’t|am unable to)\s+see\s+any\b|<!--\s*page\b[^\n]*\b(?:failed|error)\b[^\n]*-->"
    r"|(?:you\s+need\s+to|please|bitte|veuillez|por\s+favor)?[^.\n]{0,30}\b(?:enable|turn\s+on|aktivieren|activez|activer|active|habilite|ative|включите|启用|有効に)\b[^.\n]{0,40}\b(?:java\s?script|scripts)\b|java\s?script\s+(?:must|muss|doit|debe|deve|is\s+(?:required|disabled))|noscript\b|включите\s+javascript|请启用\s?javascript|javascript\s?を有効"
)
#: Words of the customary Latin filler. Fixed values.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in"
    " reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum aenean porta vel sodales tempus eget metus risus nunc orci quam"
    " pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum tortor feugiat vitae ultricies mauris placerat eleifend leo maecenas viverra justo phasellus donec curabitur integer suspendisse vivamus praesent".split()
)
_PLACEHOLDER = regex.compile(PLACEHOLDERS)
_WHOLE = regex.compile(rf"(?i)\s*(?:[*_>]+\s*)?(?:{WHOLE})")
_LATER = regex.compile(r"(?i)javascript|scripts")
#: Words by which a text speaks about such things. Fixed values.
_ABOUT = regex.compile(r"(?i)\b(?:diagram|screenshot|template|sample|photo|drawing)\b|\bexplains?\b|\bargued\b|\bmarks\s+the\s+place\b")
_FENCE = regex.compile(r"(?ms)^(`{3,}|~{3,})[^\n]*\n.*?(?:^\1[^\n]*$|\Z)")
_SPAN = regex.compile(r"(`+)[^`\n]*\1")
_BLANK = regex.compile(r"\n[^\S\n]*\n")
NEAR, SHINGLE, ALIKE = 3, 5, 0.8
#: Words that stand so many times for each unit of the corpus are ordinary: at most (mean words of a unit) / share of them. Where at least ``RARE`` other words and this
#: part of a unit are not, ordinary words are slots.
ORDINARY, RARE, PART = 0.002, 3, 0.25
SLOT = np.uint64(1)
#: Scripts that put no blanks between words: Thai to Lao, Burmese, Khmer, kana and Han. Fixed values.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


def units_of(text: str) -> list[str]:
    """Blocks of a text, without fenced and inline code."""
    if "`" in text or "~~~" in text:
        text = _SPAN.sub(" ", _FENCE.sub("\n\n", text))
    return [b for b in map(str.strip, _BLANK.split(text)) if b]


def trusted(unit: str) -> bool:
    """Whether a unit surely is residue."""
    if any(x in unit for x in "{<$%[_@#") or "FPE_IMG" in unit or "xxxxxx" in unit.lower() or "yyyy" in unit:
        if _PLACEHOLDER.search(unit) and not (_ABOUT.search(_PLACEHOLDER.sub(" ", unit))):
            return True
    if len(unit) > 30 and len(FILLER.intersection(low := unit.lower().split())) > 3 and sum(map(FILLER.__contains__, low)) * 2 >= len(low) and len(words := regex.findall(r"\p{L}+", unit.lower())) > 5 and sum(map(FILLER.__contains__, words)) >= ALIKE * len(words):
        return True
    return bool(_WHOLE.match(unit)) and not (_LATER.search(unit) and _ABOUT.search(unit))


def words_of(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its unit) of every word made of letters; digits are slots. In scripts without blanks every letter is a word."""
    codes = codes_of("\0".join(u.replace("\0", " ") for u in units).lower() + "\0")
    letter = categories()[codes] <= 1
    alone = np.zeros(len(codes), bool)
    high = np.flatnonzero(letter & (codes >= UNSPACED[0][0]))
    for a, b in UNSPACED:
        alone[high] |= (codes[high] >= a) & (codes[high] <= b)
    edge = np.ones(len(codes), bool)
    edge[1:] = ~letter[:-1] | alone[:-1] | alone[1:]  # a word that holds this sign begins here
    begin = np.flatnonzero(letter & edge)
    end = np.flatnonzero(letter & np.append(edge[1:] | ~letter[1:], True)) + 1
    return slices(codes, begin, end), np.searchsorted(np.flatnonzero(codes == 0), begin)


def slotted(words: np.ndarray, unit: np.ndarray, n: int, ordinary: np.ndarray) -> np.ndarray:
    """Words with a slot for the ordinary ones of every unit that rarer words carry."""
    if not len(words) or not len(ordinary):
        return words
    at = np.minimum(np.searchsorted(ordinary, words), len(ordinary) - 1)
    usual = ordinary[at] == words
    rare, size = np.bincount(unit[~usual], minlength=n), np.bincount(unit, minlength=n)
    carried = (rare >= RARE) & (rare >= PART * size)
    return np.where(usual & carried[unit], SLOT, words)


def prefixes(words: np.ndarray, unit: np.ndarray, n: int) -> tuple[list, np.ndarray]:
    """(the first shingles of every unit in the order of their hashes, number of its distinct shingles).

    Of sets of which at least ``ALIKE`` is common, one of the first size - ceil(ALIKE * size) + 1 of either is among the first of the other.
    """
    whose, shingle = unit[: max(len(unit) - SHINGLE + 1, 0)], grams(words, SHINGLE)
    inside = whose == unit[SHINGLE - 1 :]
    whose, shingle = whose[inside], shingle[inside]
    order = np.lexsort((shingle, whose))
    whose, shingle = whose[order], shingle[order]
    new = np.ones(len(whose), bool)
    new[1:] = (np.diff(whose) != 0) | (shingle[1:] != shingle[:-1])
    whose, shingle = whose[new], shingle[new].view(np.int64)
    size = np.bincount(whose, minlength=n)
    begin = np.cumsum(size) - size
    most = size - np.ceil(ALIKE * size - 1e-9).astype(np.int64) + 1
    return [shingle[a : a + k].tolist() if m else None for a, k, m in zip(begin.tolist(), most.tolist(), size.tolist())], size


def short_key(unit: str) -> str:
    """By what units without a shingle are equal: their signs, without case, outer emphasis, closing stops and the number of blanks."""
    return " ".join(unit.lower().strip("*").rstrip(".!…*").split())


def simhashes(words: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(SimHash of its words and word pairs, hash of its words in order) of every unit; 0 where it has no words."""
    pair = grams(words, 2)
    pair = mixed(pair[unit[:-1] == unit[1:]] if len(unit) > 1 else pair)
    features = np.concatenate([words, pair])
    whose = np.concatenate([unit, unit[:-1][unit[:-1] == unit[1:]]]) if len(unit) > 1 else unit
    order = np.argsort(whose, kind="stable")
    features, whose = features[order], whose[order]
    near, exact = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(words):
        first = np.flatnonzero(np.append(True, np.diff(whose) != 0))
        bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        size = np.diff(np.append(first, len(whose)))
        near[whose[first]] = np.packbits(ones * 2 > size[:, None], axis=1).view(np.uint64).ravel()
        start = np.flatnonzero(np.append(True, np.diff(unit) != 0))
        exact[unit[start]] = slices(words, start, np.append(start[1:], len(unit)))
    return near, exact


def _count(c: dict) -> dict:
    """How often each word stands in a batch, and how many units there are (as word 0)."""
    texts = [x or "" for x in c["text"].to_pylist()]
    keys, sums, total = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for a, b in parts_of(texts):
        units = [u for t in texts[a:b] for u in units_of(t)]
        total += len(units)
        h, n = np.unique(words_of(units)[0], return_counts=True)
        keys.append(h)
        sums.append(n)
    h, at = np.unique(np.concatenate(keys), return_inverse=True)
    return {"h": np.append(h, np.uint64(0)).view(np.int64), "n": np.append(np.bincount(at, np.concatenate(sums), len(h)).astype(np.int64), total)}


def ordinary_words(texts: DataFrame, share: float = ORDINARY) -> np.ndarray:
    """Hashes of the words that stand at least ``share`` times as often as there are units, sorted; a small corpus has none."""
    counted = by_batch(texts.select("text"), "h bigint, n bigint", _count).groupBy("h").agg(F.sum("n").alias("n"))
    counted = written(counted, "ordinary")
    total = counted.filter("h = 0").select("n").first()
    if total is None or total.n * share < 20:
        return np.zeros(0, np.uint64)
    return np.sort(np.array(counted.filter((F.col("n") >= total.n * share) & (F.col("h") != 0)).select("h").toArrow()["h"], dtype=np.int64).view(np.uint64))


def _units(c: dict, usual) -> dict:
    import xxhash

    rows, numbers, labels, nears, exacts, counts, own_words, firsts, sizes, keys = [], [], [], [], [], [], [], [], [], []
    texts = [x or "" for x in c["text"].to_pylist()]
    for a, b in parts_of(texts):
        own, units, number = [], [], []
        for i in range(a, b):
            got = units_of(texts[i])
            own += [i] * len(got)
            units += got
            number += range(len(got))
        if not units:
            continue
        words, unit = words_of(units)
        words = slotted(words, unit, len(units), usual.value)
        near, exact = simhashes(words, unit, len(units))
        rows += own
        numbers += number
        sure = list(map(trusted, units))
        labels += sure
        at = np.searchsorted(unit, np.arange(len(units) + 1))
        own_words += [words[at[k] : at[k + 1]].view(np.int64).tolist() if x else None for k, x in enumerate(sure)]
        nears.append(near)
        exacts.append(exact)
        count = np.bincount(unit, minlength=len(units))
        counts.append(count)
        first, size = prefixes(words, unit, len(units))
        firsts += first
        sizes.append(size)
        short = [short_key(x) if n < SHINGLE else "" for x, n in zip(units, count.tolist())]
        keys += [xxhash.xxh3_64_intdigest(x) - (1 << 63) if x else None for x in short]
    join = lambda v, t: np.concatenate(v).view(t) if v else np.zeros(0, t)
    return {"tab": c["tab"].take(rows), "row": c["row"].take(rows), "part": c["part"].take(rows), "no": numbers, "label": labels, "near": join(nears, np.int64), "exact": join(exacts, np.int64), "words": join(counts, np.int64).astype(np.int32), "other": own_words, "first": firsts, "size": join(sizes, np.int64).astype(np.int32), "short": keys}


def similarity(a: np.ndarray, b: np.ndarray, size: int = SHINGLE) -> float:
    """Jaccard similarity of the word shingles of two units; shorter units are compared as a whole."""
    size = max(1, min(size, len(a), len(b)))
    x, y = set(grams(a, size).tolist()), set(grams(b, size).tolist())
    return len(x & y) / max(len(x | y), 1)


def _verify(c: dict, usual) -> dict:
    good, own, seen = [], [], {}
    for text, no, exact, other in zip(c["text"].to_pylist(), c["no"].to_pylist(), c["exact"].to_pylist(), c["other"].to_pylist()):
        if exact not in seen:
            words, unit = words_of([units_of(text)[no]])
            seen[exact] = slotted(words, unit, 1, usual.value)
        a = seen[exact]
        good.append(similarity(a, np.array(other, np.int64).view(np.uint64)) >= ALIKE)
        own.append(exact)
    keep = np.flatnonzero(good)
    return {k: c[k].take(keep) for k in ("near", "exact", "first", "size")} | {"other": [seen[own[k]].view(np.int64).tolist() for k in keep.tolist()]}


_FRONT = "near bigint, exact bigint, first array<bigint>, size int, other array<bigint>"


def residue_rows(texts: DataFrame, least_words: int = SHINGLE, share: float = ORDINARY, trust: float = 1.0) -> DataFrame:
    """(tab, row) of the rows that hold residue, of ``texts`` (tab string, row bigint, part int, text string).

    One row may have several parts (columns). Null and empty texts give no row; repeated rows give one. Labels spread over all pairs of
    units of at least ``least_words`` words that are similar enough; shorter units share them when they are equal. With ``trust`` below 1 the
    fixed rules label only that share of the rows, to measure what spreading finds by itself. Words of at least ``share`` of all units may be slots.
    """
    schema = "tab string, row bigint, part int, no int, label boolean, near bigint, exact bigint, words int, other array<bigint>, first array<bigint>, size int, short bigint"
    full = texts.filter(F.length("text") > 0)
    usual = texts.sparkSession.sparkContext.broadcast(ordinary_words(full, share))
    units = by_batch(full, schema, _units, usual)
    if trust < 1:
        units = units.withColumn("label", F.col("label") & (F.pmod(F.xxhash64("tab", "row"), F.lit(1000)) < trust * 1000))
        units = units.withColumn("other", F.when(F.col("label"), F.col("other")))
    units = written(units, "units")
    long = units.filter(F.col("words") >= least_words)
    front = written(long.filter("label").select("near", "exact", "first", "size", "other").dropDuplicates(["exact"]), "front")
    # one row per distinct text that has no label yet, with one place where it stands
    open_ = long.filter("NOT label").groupBy("exact").agg(F.min(F.struct("tab", "row", "part", "no", "near", "size")).alias("u"), F.any_value("first").alias("first")).select("exact", "u.*", "first")
    open_ = written(open_.join(front.select("exact"), "exact", "left_anti"), "open")
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("near", 16 * i).bitwiseAND(0xFFFF).alias("bits")) for i in range(4)])).alias("t")
    marked = front.select("exact")
    place = ("exact", "tab", "row", "part", "no", "near", "size", "exact2")
    # ``both`` shingles are common at least; one at places i and i2 leaves room for so many before and behind it
    both = F.ceil((F.col("size") + F.col("size2")) * (ALIKE / (1 + ALIKE)) - 1e-9)
    room = F.least("i", "i2") + 1 + F.least(F.col("size") - F.col("i"), F.col("size2") - F.col("i2")) - 1
    while True:
        probe = front.select(F.col("near").alias("near2"), F.col("exact").alias("exact2"), bands, "near").select("near2", "exact2", "t.*")
        pairs = open_.drop("first").select("*", bands).select("*", "t.band", "t.bits").drop("t").join(probe, ["band", "bits"]).filter(F.bit_count(F.col("near").bitwiseXOR(F.col("near2"))) <= NEAR).select(*place)
        probe = front.select(F.col("exact").alias("exact2"), F.col("size").alias("size2"), F.posexplode("first").alias("i2", "shingle"))
        more = open_.select(*place[:-1], F.posexplode("first").alias("i", "shingle")).join(probe, "shingle").filter(room >= both).select(*place)
        # written first: few pairs meet the texts by a broadcast, many by a shuffle
        pairs = written(pairs.union(more).dropDuplicates(["exact", "exact2"]).join(marked, "exact", "left_anti"), "pairs")
        pairs = pairs.join(front.select(F.col("exact").alias("exact2"), "other"), "exact2").join(texts, ["tab", "row", "part"]).join(open_.select("exact", "first"), "exact")
        front = written(by_batch(pairs.select("near", "exact", "first", "size", "no", "text", "other"), _FRONT, _verify, usual).dropDuplicates(["exact"]), "front")
        if front.isEmpty():
            break
        marked = marked.union(front.select("exact"))
    spread = long.join(marked.distinct(), "exact", "left_semi").select("tab", "row")
    short = units.filter(F.col("words") < least_words)
    equal = short.filter("NOT label").join(short.filter("label").select("short").distinct(), "short", "left_semi").select("tab", "row")
    return units.filter("label").select("tab", "row").union(spread).union(equal).distinct()
