"""Problem 9: passages of held-out items inside documents.

The items' n-grams are looked up at every window of every document, in as many passes as keep what is broadcast within a bound. A hit of the
n-grams as long as a passage is a verbatim one. Short n-grams tell changed ones: enough hits of an item's, by the q-gram bound, are a
candidate for the whole item with changes, which an alignment then verifies. An item's n-grams that most other items hold too are left out
of that count as far as the bound allows, so that phrases common to many items don't meet all of them.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import by_batch
from pagemill.llm.vectors import categories, codes_of, flags, grams, mixed, parts_of, runs, slices
from pagemill.session import written

_LINK = regex.compile(r"\]\([^()\s]*\)|<!--.*?-->|</?\p{L}[^<>\n]*>", regex.S)
#: Left out before words are cut: marks of emphasis, soft hyphens and signs without width.
_LEFT_OUT = "*_`~\u00ad\u200b\u200c\u200d\ufeff"
#: Left out between two letters, so that "cross-border" is one word.
_JOINERS = "-\u2010\u2011'’"
_FULL = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_SIGN = regex.compile(r"[\p{L}\p{N}]")


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of all texts, without case and markup, a NUL after each."""
    clean = [_LINK.sub(" ", t) if "](" in t or "<" in t else t for t in texts]
    codes = codes_of("\0".join(t.replace("\0", " ") for t in clean).casefold() + "\0")
    codes = codes[~flags(_LEFT_OUT)[codes]]
    letter = categories()[codes] == 0
    inner = flags(_JOINERS)[codes]
    inner[1:-1] &= letter[:-2] & letter[2:]
    inner[:1] = False
    return codes[~inner]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every word; case, punctuation and markup don't count."""
    codes = _codes(texts)
    begin, end = runs(categories()[codes] <= 2)
    return slices(codes, begin, end), np.searchsorted(np.flatnonzero(codes == 0), begin)


def signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every letter and digit, for scripts without blanks."""
    codes = _codes(texts)
    at = np.flatnonzero((categories()[codes] & 1) == 0)
    at = at[categories()[codes[at]] <= 2]
    return mixed(codes[at]), np.searchsorted(np.flatnonzero(codes == 0), at)


def placed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of one text as ``_codes`` has them, and the place of each in the text."""
    place = np.arange(len(text))
    if "](" in text or "<" in text:
        out, kept, at = [], [], 0
        for m in _LINK.finditer(text):
            out += [text[at : m.start()], " "]
            kept += [place[at : m.start()], place[m.start() : m.start() + 1]]
            at = m.end()
        text, place = "".join([*out, text[at:]]), np.concatenate([*kept, place[at:]])
    folded = text.replace("\0", " ").casefold()
    if len(folded) != len(text):  # some signs become several
        parts = [x.casefold() for x in text.replace("\0", " ")]
        folded, place = "".join(parts), np.repeat(place, [len(x) for x in parts])
    codes, place = codes_of(folded + "\0"), np.append(place, place[-1] + 1 if len(place) else 0)
    keep = ~flags(_LEFT_OUT)[codes]
    codes, place = codes[keep], place[keep]
    letter = categories()[codes] == 0
    inner = flags(_JOINERS)[codes]
    inner[1:-1] &= letter[:-2] & letter[2:]
    inner[:1] = False
    return codes[~inner], place[~inner]


def units_of(text: str, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of the words of one text, or of its letters and digits with ``whole``."""
    codes, place = placed(text)
    kind = categories()[codes]
    if whole:
        at = np.flatnonzero((kind == 0) | (kind == 2))
        return mixed(codes[at]), place[at], place[at] + 1
    begin, end = runs(kind <= 2)
    return slices(codes, begin, end), place[begin], place[end - 1] + 1


def stretches(u: np.ndarray, v: np.ndarray, run: int, may: int) -> list[tuple[int, int]]:
    """Where units ``v`` of an item stand in ``u``: every run of ``run`` and more in the same order, else the stretch nearest to all of it."""
    h, own = grams(u, run), np.unique(grams(v, run))
    hit = own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h if len(own) and len(h) else np.zeros(len(h), bool)
    if hit.any():
        covered = np.zeros(len(u) + 1, np.int64)
        at = np.flatnonzero(hit)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + run, -1)
        return [(int(a), int(b)) for a, b in zip(*runs(np.cumsum(covered[:-1]) > 0))]
    ends = _costs(v, u)
    stop = int(np.argmin(ends))
    if not len(u) or ends[stop] > may:
        return []
    back = _costs(v[::-1], u[: stop + 1][::-1])
    return [(stop - int(np.flatnonzero(back == back.min())[-1]), stop + 1)]


def _costs(item: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each place of ``part`` the least number of units changed, left out or put in to make a stretch that ends there the item."""
    steps = np.arange(len(item) + 1)
    cost, out = steps, np.zeros(len(part), np.int64)
    for i, x in enumerate(part):
        new = np.empty_like(cost)
        new[0] = 0
        np.minimum(cost[:-1] + (item != x), cost[1:] + 1, out=new[1:])
        cost = np.minimum.accumulate(new - steps) + steps  # units of the item left out
        out[i] = cost[-1]
    return out


def has_no_blanks(text: str) -> bool:
    full = len(_FULL.findall(text))
    return full * 2 > len(_SIGN.findall(text))


def quick(hashes: np.ndarray) -> np.ndarray:
    """A table by the upper bits of some hashes, at least four places for each up to 16 million."""
    bits = min(max(20, (len(hashes) * 4).bit_length()), 24)
    out = np.zeros(1 << bits, bool)
    out[(hashes >> np.uint64(64 - bits)).astype(np.intp)] = True
    return out


def among(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return table[(h >> np.uint64(65 - len(table).bit_length())).astype(np.intp)]


class Table:
    """Sorted hashes with the items that hold them."""

    def __init__(self, hashes: np.ndarray, whose: np.ndarray):
        order = np.lexsort((whose, hashes))
        hashes, whose = hashes[order], whose[order]
        new = np.append(True, (np.diff(whose) != 0) | (hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
        self.whose = whose[new].astype(np.int32)
        self.distinct, self.first, self.count = np.unique(hashes[new], return_index=True, return_counts=True)
        self.quick = quick(self.distinct)  # most windows of the corpus end here

    def hits(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) for every item that holds one of the hashes ``h`` at the places ``at``."""
        place = np.minimum(np.searchsorted(self.distinct, h), max(len(self.distinct) - 1, 0))
        if not len(self.distinct):
            return at[:0], at[:0]
        hit = self.distinct[place] == h
        at, place = at[hit], place[hit]
        many = self.count[place]
        entry = np.repeat(self.first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(at, many), self.whose[entry].astype(np.int64)


class Index:
    """The n-grams of the items of one kind (words or signs)."""

    def __init__(self, items: list[tuple], cut, gram: int, run: int, one_in: int, common: int = 3):
        self.cut, self.gram, self.run = cut, gram, run
        self.ids, self.units = [], []
        for i, t in items:
            u, _ = cut([t])
            if len(u) >= gram:
                self.ids.append(i)
                self.units.append(u)
        size = np.array([len(u) for u in self.units], np.int64)
        self.size, self.may = size, size // one_in
        self.least = np.maximum(size - gram + 1 - gram * self.may, 1)
        none = np.zeros(0, np.uint64)
        own = [np.unique(grams(u, gram)) for u in self.units]
        every, held = np.unique(np.concatenate(own or [none]), return_counts=True)
        self.own, self.few, kept = own, self.least.copy(), []
        for k, g in enumerate(own):  # as many of the most common as half the bound leaves are not counted
            n = held[np.searchsorted(every, g)]
            drop = np.argsort(-n, kind="stable")[: (self.least[k] - 1) // 2]
            drop = drop[n[drop] > common]
            kept.append(np.delete(g, drop))
            repeats = max(len(self.units[k]) - gram + 1 - len(g), 0)  # a gram that an item repeats is one row here
            self.few[k] = max(self.least[k] - len(drop) - repeats, 1)
        whose = lambda parts: np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        self.some = Table(np.concatenate(kept or [none]), whose(kept))
        self.any = quick(every)
        full = [self.long(grams(u, gram)) for u in self.units]
        self.whole = Table(np.concatenate(full or [none]), whose(full))

    def long(self, h: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of ``run`` units from those of ``gram`` units that cover them, of all places or those in ``at``."""
        at = np.arange(max(len(h) - self.run + self.gram, 0)) if at is None else at
        return grams(np.stack([h[at + o] for o in self.offsets], axis=1).ravel(), len(self.offsets))[:: len(self.offsets)] if len(at) else np.zeros(0, np.uint64)

    @property
    def offsets(self) -> list[int]:
        return sorted({*range(0, self.run - self.gram, self.gram), self.run - self.gram})

    def found(self, texts: list[str]) -> list[tuple[int, object]]:
        """(index of the text, id of the item) of every leak."""
        if not self.units:
            return []
        u, doc = self.cut(texts)
        if len(u) < self.gram:
            return []
        h = grams(u, self.gram)
        may = among(self.any, h)
        last = len(u) - self.run + 1
        at = np.flatnonzero(np.logical_and.reduce([may[o : o + last] for o in self.offsets])) if last > 0 else np.zeros(0, np.int64)
        at = at[doc[at] == doc[at + self.run - 1]]
        at, item = self.whole.hits(at, self.long(h, at))
        out = set(zip(doc[at].tolist(), item.tolist()))
        at = np.flatnonzero(among(self.some.quick, h))
        at = at[doc[at] == doc[at + self.gram - 1]]
        at, item = self.some.hits(at, h[at])
        text = doc[at]
        order = np.lexsort((at, item, text))
        at, item, text = at[order], item[order], text[order]
        pair = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(item) != 0))) if len(at) else np.zeros(0, np.int64)
        hits = np.diff(np.append(pair, len(at)))
        enough = hits >= self.few[item[pair]]
        for p in pair[enough].tolist():
            k, d = int(item[p]), int(text[p])
            if (d, k) not in out:
                low, high = np.searchsorted(doc, [d, d + 1])
                here = h[low : high - self.gram + 1]  # now with all of the item's
                own = self.own[k]
                every = low + np.flatnonzero(own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here)
                for a, b in self.windows(every, k) if len(every) >= self.least[k] else ():
                    if self.near(self.units[k], u[max(a, low) : min(b, high)], int(self.may[k])):
                        out.add((d, k))
                        break
        return [(d, self.ids[k]) for d, k in out]

    def windows(self, at: np.ndarray, k: int):
        """Stretches that hold enough hits for the whole item."""
        span, need = int(self.size[k] + self.may[k]), int(self.least[k])
        stop = np.searchsorted(at, at + span)
        done = -1
        for g in np.flatnonzero(stop - np.arange(len(at)) >= need).tolist():
            if at[g] > done:
                done = int(at[g]) + span // 2
                yield int(at[g]) - span, int(at[g]) + 2 * span

    @staticmethod
    def near(item: np.ndarray, part: np.ndarray, may: int) -> bool:
        """Whether some stretch of ``part`` is the item with at most ``may`` units changed, left out or put in."""
        return len(item) <= may or bool(len(part)) and int(_costs(item, part).min()) <= may


def leaks(
    df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 12, full_run: int = 40, one_in: int = 6, gram: int = 3, full_gram: int = 4, most_bytes: int = 8 << 20
) -> DataFrame:
    """One row (key, item_key) for each item that leaks into a text.

    An item leaks if ``run`` consecutive words of it stand in the text (``full_run`` letters and digits where it is mainly written in a
    script without blanks), or all of it with at most one unit in ``one_in`` changed. Null and empty texts and items give no row; repeated
    rows of one key give one. Of the items about ``most_bytes`` of text at a time are gathered on the driver and broadcast as an index of some
    ten times their size; larger sets of items are looked for in several passes over the texts.
    """
    given_items = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).filter(F.length("t") > 0).distinct()
    size = given_items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-size // most_bytes))
    kind, item_kind = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    out = None
    for n in range(passes):
        held = [(r.i, r.t) for r in (given_items.filter(F.pmod(F.xxhash64("t"), F.lit(passes)) == n) if passes > 1 else given_items).collect()]
        parts = [
            Index([x for x in held if not has_no_blanks(x[1])], words, gram, run, one_in),
            Index([x for x in held if has_no_blanks(x[1])], signs, full_gram, full_run, one_in),
        ]
        one = by_batch(given, f"key {kind}, item {item_kind}", _scan, df.sparkSession.sparkContext.broadcast(parts))
        out = one if out is None else out.union(one)
    return out.distinct().withColumnsRenamed({"key": key, "item": item_key})


def _scan(c: dict, parts) -> dict:
    own, texts, keys, found = c["key"].to_pylist(), c["text"].to_pylist(), [], []
    for a, b in parts_of(texts):
        for p in parts.value:
            rows = range(a, b) if p.cut is words else [i for i in range(a, b) if _FULL.search(texts[i])]
            got = p.found([texts[i] for i in rows]) if rows else []
            keys += [own[rows[d]] for d, _ in got]
            found += [i for _, i in got]
    return {"key": keys, "item": found}


def without(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The rows of ``df`` into which nothing leaked."""
    return df.join(found.select(key).distinct(), key, "left_anti")


def spans(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, found: DataFrame, run: int = 12, full_run: int = 40, one_in: int = 6) -> DataFrame:
    """(key, item_key, start_pos, end_pos) of the passages of the leaks in ``found``: code points, exclusive. Only leaking texts are read again.

    Each run of ``run`` words (``full_run`` letters and digits) of the item is a passage, or, without one, the stretch that is nearest to all of it.
    """
    kind, item_kind = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    found = written(found.select(key, item_key), "leaks")
    leaking = found.select(F.col(key).alias("key")).distinct()
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0).join(leaking, "key", "left_semi").distinct()
    held = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("own")).filter(F.length("own") > 0).distinct()
    given = found.select(F.col(key).alias("key"), F.col(item_key).alias("item")).join(texts, "key").join(held, "item").select("key", "item", "text", "own")

    def make(c: dict) -> dict:
        out: dict[str, list] = {"key": [], "item": [], "start_pos": [], "end_pos": []}
        for k, i, t, own in zip(*(c[x].to_pylist() for x in ("key", "item", "text", "own"))):
            whole = has_no_blanks(own)
            (u, begin, end), (v, _, _) = units_of(t, whole), units_of(own, whole)
            for a, b in stretches(u, v, full_run if whole else run, len(v) // one_in):
                for name, x in zip(out, (k, i, int(begin[a]), int(end[b - 1]))):
                    out[name].append(x)
        return out

    return by_batch(given, f"key {kind}, item {item_kind}, start_pos bigint, end_pos bigint", make).distinct().withColumnsRenamed({"key": key, "item": item_key})


def cut(df: DataFrame, key: str, text: str, passages: DataFrame) -> DataFrame:
    """``df`` with the passages (key, start_pos, end_pos) taken out of ``text``; overlapping ones are one."""
    own = passages.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("_cut"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substr(F.col(text), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda s, x: F.struct(F.greatest(s["at"], x["end_pos"]).alias("at"), F.concat(s["out"], piece(s["at"], x["start_pos"])).alias("out"))
    rest = lambda s: F.concat(s["out"], piece(s["at"], F.length(F.col(text)).cast("bigint")))
    joined = df.join(own, df[key] == F.col("_key"), "left")
    return joined.withColumn(text, F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.aggregate("_cut", start, step, rest))).drop("_key", "_cut")
