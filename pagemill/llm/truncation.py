"""Problem 4: text cut off by a length limit, a model's token limit or a broken transfer.

The model of endings is a table of backward character n-grams: for the last characters of every value, how often the same characters stand in
the corpus before the end of a line, and how often before more text. Only n-grams that some value ends in are counted, in one pass
over all texts. The log-odds of ending against going on, with the shape of the last line, decide a value; sources whose lengths pile up
at their greatest length, in characters or bytes, have a limit, and so has a model's answer of its greatest size.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.bodies import cued
from pagemill.llm.common import bloom, by_batch, source_of
from pagemill.llm.sentences import kind_of
from pagemill.llm.vectors import categories, codes_of, flags, parts_of, slices
from pagemill.session import written

ORDERS = (24, 10, 6)
#: Log-odds of ending against going on below which a value is cut where its language and column have too few values to tell, and the least and
#: greatest threshold that their values may set.
DEFAULT, LOWEST, HIGHEST, ENOUGH = -2.5, -3.0, -1.5, 400

_NOTE = regex.compile(r"(?:\.{3}|…|\[…\]|\[\.\.\.\])\s*(?:[(\[](?:more|mehr|suite|más|mais|continued|read more)[)\]])?\s*$|[(\[](?:more|continued|truncated|cut)[)\]]\s*$")
_STOPPED = regex.compile(r"[.!?…。！？؟।][\"'”’»“)\]」』*_`]*$|[:;]$|<!--.*-->$")
_SHORTENED = regex.compile(r"(?<![\p{L}\p{M}\d-])(?:\p{L}|approx|Mr|Mrs|Dr|No|Nr|Fig|vol|pp?|Co|e\.g|i\.e|[ap]\.m|Abs|bzw|vgl|réf|art|Mme|Sra?|pág|n\.º|стр|др|т|z\. ?B|d\. ?h|डॉ)\.$|\d\.$")
_CLOSED = regex.compile(r"^#{1,6}\s|^\|.*\|$|^```|^(?:[-*+•]|\d{1,3}[.)])\s|^!?\[[^\]]*\]\([^()\s]*\)[.»…]?$|^https?://\S+$|^(?:Fig|Abb|Tab|Table|Figure|Photo|Map|Chart|Diagram|Screenshot)\b|^[©*_>]|^—|\]\([^()\s]*\)$|(?:^|\s)[›»|·/]\s|^.{0,40}\b\p{Lu}\d-\d+\p{Lu}?$|^(?:~~~|<!--)|\|default\]\]|^__\p{Lu}+")
_SIGNATURE = regex.compile(r"^\p{Lu}[\p{L}’'-]+(?:\s\p{Lu}[\p{L}’'.-]+){0,3}(?:,\s[\p{L} .’-]{2,40})?$")
_FURNITURE = regex.compile(r"^(?:[-–—\[(]?\s*(?:p\.|page|Page|S\.|Seite|f\.)?\s*[\divxlcIVXLC]+\s*(?:of|von|/|de|sur)?\s*\d*\s*[-–—\])]?)$")
_MENU = regex.compile(r"^\S+(?: \S+){0,2}(?:\s{2,}\S+(?: \S+){0,2}){2,}$|^(?:TODO|TBD)\b|^\p{Lu}\p{L}*(?:\s\p{L}+){0,2}[.:]?\s\d[\d.-]*$")  # the last: a label and its number
#: Wrongly decoded lines show no stop that could be told.
_GARBLED = regex.compile(r"[\x80-\x9f\ufffd]|[\u0080-\u00ff]{3}|[\u2500-\u259f\ue000-\uf8ff]")
_OPEN_LINK = regex.compile(r"\[[^\]\n]*$|\]\([^()\s]*$")


def _is_end(codes: np.ndarray) -> np.ndarray:
    """Whether a sign ends a line: its break, or a mark that is put behind whole lines."""
    return (codes == 0) | flags("\n*…»!]_")[codes]


def _reduced(text: str) -> str:
    """What n-grams are made of: digits are one sign."""
    return regex.sub(r"\d", "0", text)


def _tails(c: dict) -> dict:
    """The hash of the last characters of each text at every order (0 where the last line is shorter)."""
    out = {f"h{k}": np.zeros(len(c["key"]), np.int64) for k in ORDERS}
    for i, t in enumerate(c["tail"].to_pylist()):
        line = _reduced((t or "").rstrip()[-max(ORDERS) - 1 :].split("\n")[-1])
        u = codes_of(line)
        for k in ORDERS:
            if len(u) >= k:
                out[f"h{k}"][i] = slices(u[-k:], np.zeros(1, np.int64), np.array([k])).view(np.int64)[0]
    return {"key": c["key"], "copies": c["copies"]} | out


def _follow(c: dict, wanted) -> dict:
    """How often each wanted n-gram stands before the end of a line, a letter or digit, or another sign; a text's end is the end of a line."""
    keys, sums = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    texts = c["text"].to_pylist()
    for a, b in parts_of(texts, 500_000):
        codes = codes_of(regex.sub(r"[^\S\n]+(?=\n)", "", "\0".join(x.replace("\0", " ").rstrip() for x in texts[a:b])) + "\0")
        kind = categories()[codes]
        codes = np.where(kind == 2, np.uint32(48), codes)
        broken = np.cumsum((codes == 10) | (codes == 0), dtype=np.int32)
        got, follow = [keys], [sums]
        for k in ORDERS:
            first = np.arange(max(len(codes) - k, 0))
            h = slices(codes, first, first + k).view(np.int64)  # each is followed by codes[i + k]
            nxt = codes[k : k + len(h)]
            at = np.flatnonzero(wanted.value.holds(h))
            at = at[broken[at] == broken[at + k - 1]]
            end = _is_end(nxt[at])
            if k == max(ORDERS):  # long ones tell lines that recur, also where the line's full stop is missing
                end |= (nxt[at] == 46) & _is_end(codes[np.minimum(at + k + 1, len(codes) - 1)])
            cls = np.where(end, 0, np.where(kind[at + k] <= 2, 1, 2))
            own, inverse = np.unique(h[at], return_inverse=True)
            got.append(own)
            follow.append(np.bincount(inverse * 3 + cls, minlength=3 * len(own)).reshape(-1, 3) if len(own) else np.zeros((0, 3), np.int64))
        every, inverse = np.unique(np.concatenate(got), return_inverse=True)
        added = np.zeros((len(every), 3), np.int64)
        np.add.at(added, inverse, np.concatenate(follow))
        keys, sums = every, added
    return {"h": keys, "ends": sums[:, 0], "letters": sums[:, 1], "others": sums[:, 2]}


def log_odds(values: DataFrame, training: DataFrame, key: str, text: str, copies: str) -> DataFrame:
    """(key, odds, into): log-odds of ending against going on after the last characters, and of going on within a word.

    The longest n-gram with at least two sightings decides, without the value's own ``copies``; null where none has.
    """
    spark = values.sparkSession
    kind = values.schema[key].dataType.simpleString()
    schema = f"key {kind}, copies bigint, " + ", ".join(f"h{k} bigint" for k in ORDERS)
    tails = written(by_batch(values.select(F.col(key).alias("key"), F.col(copies).alias("copies"), F.substring(F.rtrim(F.col(text)), -64, 64).alias("tail")), schema, _tails), "tails")
    wanted = tails.select(F.explode(F.array(*[f"h{k}" for k in ORDERS])).alias("h")).filter("h <> 0").distinct()
    test = spark.sparkContext.broadcast(bloom(written(wanted, "wanted")))
    seen = by_batch(training.select(F.col(text).alias("text")).filter(F.length("text") > 0), "h bigint, ends bigint, letters bigint, others bigint", _follow, test)
    seen = seen.groupBy("h").agg(*[F.sum(x).alias(x) for x in ("ends", "letters", "others")])
    long = tails.select("key", "copies", F.posexplode(F.array(*[f"h{k}" for k in ORDERS])).alias("rank", "h")).filter("h <> 0").join(seen, "h")
    long = long.withColumn("ends", F.greatest(F.col("ends") - F.col("copies"), F.lit(0))).filter("ends + letters + others >= 2")
    best = long.groupBy("key").agg(F.min_by(F.struct("ends", "letters", "others"), "rank").alias("b"))
    ends, goes = F.col("b.ends") + 0.5, F.col("b.letters") + F.col("b.others") + 0.5
    return best.select(F.col("key").alias(key), F.log(ends / goes).alias("odds"), F.log((F.col("b.letters") + 0.5) / (F.col("b.ends") + F.col("b.others") + 0.5)).alias("into"))


def limits(rows: DataFrame, zone: int = 24, edge: int = 4, least: int = 5, dense: int = 3, sure: float = 5.0, open_share: float = 0.5, lowest: int = 100) -> DataFrame:
    """(source, chars_limits, bytes_limits): the lengths at which the texts of a source pile up, in order; a source without any has no row.

    ``rows`` has source, chars, bytes, breaks (whether the text by itself seems to break off), note (whether it ends in one that says so) and
    copies (rows with the same text in the same place, which count once). A limit is a length from ``lowest`` up with at least ``least`` texts
    in the ``edge`` up to it, ``sure`` standard deviations more than the rest of its zone and the ten zones below and above let expect, and of
    which ``open_share`` break off; of such lengths within a zone the least with most of them counts. Cuts at words before a limit
    spread over the zone: there notes must be half its texts, and the zone ``dense`` times as dense; the last such length counts. A limit may stand anywhere and hold any share
    of the source's texts.
    """
    out = None
    for unit in ("chars", "bytes"):
        one = 1 / F.col("copies")
        part = lambda c: F.sum(F.when(c, one).otherwise(0.0))  # noqa: B023, E731
        sizes = rows.groupBy("source", F.col(unit).alias("n")).agg(F.sum(one).alias("rows"), part(F.col("breaks")).alias("open"), part(F.col("note")).alias("notes"))
        by = Window.partitionBy("source").orderBy("n")  # over lengths, not rows: their number is bounded by the greatest length
        over = lambda c, a, b: F.coalesce(F.sum(c).over(by.rangeBetween(a, b)), F.lit(0.0))  # noqa: B023, E731
        near = sizes.withColumns({
            "tight": over("rows", 1 - edge, 0), "high": over("rows", 1 - zone, 0), "broken": over("open", 1 - edge, 0), "noted": over("notes", 1 - zone, 0),
            "after": over("rows", 1, zone), "around": F.greatest(over("rows", -11 * zone, -zone), over("rows", 1 + edge, 10 * zone)),
        })
        usual, eps = F.greatest(F.col("around") * (edge / (10 * zone)), (F.col("high") - F.col("tight")) * (edge / (zone - edge))), 1e-6
        strong = (F.col("tight") + eps >= least) & (F.col("tight") >= usual + sure * F.sqrt(usual)) & (F.col("broken") + eps >= open_share * F.col("tight"))
        soft = (F.col("noted") + eps >= least) & (F.col("noted") * 2 + eps >= F.col("high")) & (F.col("high") * 10 >= dense * F.col("around")) & (F.col("after") <= 0.2 * F.col("high"))
        by_n = Window.partitionBy("source").orderBy("n").rangeBetween(1 - zone, zone - 1)
        place = lambda when, by: F.when(when, F.struct(*by, F.col("n").alias("n")))
        good = near.filter((F.col("n") >= lowest) & (strong | soft)).withColumns({"tightest": place(strong, (F.round("broken", 6), -F.col("n"))), "last": place(soft, ())})
        good = good.withColumns({"a": F.max("tightest").over(by_n), "b": F.max("last").over(by_n)}).filter((F.col("tightest") == F.col("a")) | (F.col("last") == F.col("b")))
        best = good.groupBy("source").agg(F.array_sort(F.collect_list("n")).alias(f"{unit}_limits"))  # at most two for each zone of lengths
        out = best if out is None else out.join(best, "source", "full")
    return _own(rows, out, edge)


def _own(rows: DataFrame, found: DataFrame, edge: int) -> DataFrame:
    """``found`` without the lengths in one unit that a limit in the other brings about: half of their texts lie at one that has more texts."""
    found = written(found, "limits")
    both = found.filter("chars_limits is not null and bytes_limits is not null")
    at = lambda unit: F.filter(f"{unit}_limits", lambda x: (x >= F.col(unit)) & (x - F.col(unit) < edge))
    hits = rows.join(both, "source").select("source", (1 / F.col("copies")).alias("w"), F.explode_outer(at("chars")).alias("chars"), at("bytes").alias("b")).select("source", "w", "chars", F.explode_outer("b").alias("bytes"))
    n = hits.filter("chars is not null or bytes is not null").groupBy("source", "chars", "bytes").agg(F.sum("w").alias("n"))  # few rows
    total = lambda unit: n.filter(f"{unit} is not null").groupBy("source", unit).agg(F.sum("n").alias(f"all_{unit}"))
    shared = n.filter("chars is not null and bytes is not null").join(total("chars"), ["source", "chars"]).join(total("bytes"), ["source", "bytes"])
    gone = lambda unit, other: F.collect_set(F.when((F.col("n") * 2 >= F.col(f"all_{unit}")) & (F.col(f"all_{other}") > F.col(f"all_{unit}")), F.col(unit)))
    drop = shared.groupBy("source").agg(gone("chars", "bytes").alias("c"), gone("bytes", "chars").alias("b"))
    kept = lambda unit, drop: F.array_except(f"{unit}_limits", F.coalesce(drop, F.array().cast("array<int>"))).alias(f"{unit}_limits")
    return found.join(drop, "source", "left").select("source", kept("chars", "c"), kept("bytes", "b"))


def thresholds(odds: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(language, threshold) from the log-odds of all values of a column, ``odds`` (language, odds): the emptiest place between those of texts that
    end and those of texts that break off. Languages with fewer than ``enough`` values are not told apart and have no row."""
    bins = odds.filter("odds is not null").groupBy("language", F.floor(F.col("odds") * 2).cast("int").alias("b")).agg(F.count("*").alias("n"))
    total = bins.groupBy("language").agg(F.sum("n").alias("all")).filter(F.col("all") >= enough)
    # a few rows for each language: bins of half a unit, smoothed by their neighbours
    places = total.select("language", F.explode(F.sequence(F.lit(int(LOWEST * 2)), F.lit(int(HIGHEST * 2)))).alias("at"))
    around = places.join(bins, "language").filter(F.abs(F.col("b") - F.col("at")) <= 1).groupBy("language", "at").agg(F.sum("n").alias("n"))
    least = places.join(around, ["language", "at"], "left").groupBy("language").agg(F.min_by("at", F.struct(F.coalesce("n", F.lit(0)), F.abs(F.col("at") / 2 - DEFAULT), "at")).alias("at"))
    return least.select("language", (F.col("at") / 2).alias("threshold"))


def shape(text: str, fenced: bool = False) -> str:
    """How a text's last line ends: note, stopped, short (a stop that may be an abbreviation's), open (within a link, row or fence),
    closed, furniture or plain. ``fenced`` tells that a code fence is open at the end."""
    lines = [x.strip() for x in text.rstrip().split("\n") if x.strip()]
    last = lines[-1] if lines else ""
    if fenced:
        return "open"
    if _GARBLED.search(last):
        return "stopped"
    if _NOTE.search(last):
        return "note"
    if _OPEN_LINK.search(last) or (last.startswith("|") and not last.endswith("|")):
        return "open"
    if _STOPPED.search(last):
        return "short" if _SHORTENED.search(last) else "stopped"
    if _FURNITURE.match(last):
        return "furniture"
    if _CLOSED.search(last) or _SIGNATURE.match(last) or _MENU.search(last) or cued(last):
        return "closed"
    return "plain"


_START = regex.compile(r"^(?:#|\||[-*+•]\s|\d{1,3}[.)]\s|```|!?\[|<!--)")


def _sentence(line: str) -> bool:
    """Whether a last line without a stop reads like the beginning of a sentence rather than a footer or button."""
    return len(line) > 40 and len(line.split()) > 6 and not cued(line) and line[:1].isupper() and not line.isupper() or bool(_WIDE.search(line))


_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Thai}]")
_CAPITAL = regex.compile(r"^[\"'“„«‘(]?\p{Lu}")


#: What Python takes for blank.
_BLANKS = "".join(x for x in map(chr, range(0x3001)) if x.isspace())


def _shaped(c: dict) -> dict:
    """The shape of each text by its whole last line, whether that reads like a sentence, and its language; only these go on."""
    lines = c["line"].to_pylist()
    hows = [shape(x, n % 2 == 1) for x, n in zip(lines, c["fences"].to_pylist())]
    return {k: v for k, v in c.items() if k not in ("line", "fences")} | {"how": hows, "sentence": [how == "plain" and _sentence(x) for how, x in zip(hows, lines)], "language": [kind_of(x[-400:])[0] for x in c["text"].to_pylist()]}


def _judge(c: dict) -> dict:
    """Whether each text breaks off by itself: cause is tokens, transfer or null; ``low`` tells that it was to go on by far."""
    causes, lows = [], []
    for how, sentence, odds, into, bar, following, wraps, tokens in zip(*(c[k].to_pylist() for k in ("how", "sentence", "odds", "into", "threshold", "next", "wraps", "full"))):
        low = odds is not None and odds < bar
        why = None
        if tokens:
            why = "tokens"
        elif how == "open":
            why = "transfer"
        elif not wraps and how == "plain" and (low or odds is not None and odds < -1 and into > 0 or (odds is None or odds < -1) and sentence):
            why = "transfer"
        elif not wraps and low and (how == "short" or how == "closed" and into is not None and into > 2.5):
            why = "transfer"
        if why == "transfer" and following is not None and how != "open" and not (into is not None and into > 2.5):
            first = following.lstrip()
            if first and not _START.match(first) and not (low and _CAPITAL.match(first) and _CAPITAL.sub("", first)[:1].isspace()):
                why = None  # the text goes on there
        causes.append(why)
        lows.append(low)
    return {k: c[k] for k in ("key", "source", "how", "chars", "bytes", "copies")} | {"low": lows, "cause": causes}


def cut_texts(pages: DataFrame, usage: DataFrame, models: DataFrame, key: str, path: str, number: str, text: str, wrapped: Column, default_tokens: int = 8192) -> DataFrame:
    """(key, source, cause) of every row; cause is limit, tokens, transfer, or null where the text isn't cut.

    Null, empty and blank texts are not cut. ``wrapped`` marks texts whose lines break anywhere: they don't train the model of endings and
    only a limit cuts them. Of a page's calls the one with the highest attempt counts; a model without max_tokens has ``default_tokens``; model
    names differ in case, blanks and underscores. Rows delivered twice are judged alike; rows without path or number are judged by themselves.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(number).alias("page"), F.col(text).alias("text"), wrapped.alias("wraps")).withColumn("source", source_of(F.col("path")))
    full = rows.filter(F.trim(F.col("text"), F.lit(" \t\n")) != "")
    # only the ends of texts go through the joins, with the shape of the whole last line
    line = F.substring_index(F.rtrim(F.col("text"), F.lit(_BLANKS)), "\n", -1).alias("line")
    same = F.xxhash64(F.coalesce("path", F.lit("\0")), F.coalesce(F.col("page"), F.lit(-1)), "text").alias("same")
    sized = full.select("key", "path", "page", "source", "wraps", line, same, F.substring("text", -600, 600).alias("text"), F.substring(F.ltrim("text"), 1, 64).alias("start"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.regexp_count("text", F.lit(r"(?m)^```")).alias("fences"))
    schema = f"key {kind}, path string, page {pages.schema[number].dataType.simpleString()}, source string, wraps boolean, same bigint, text string, start string, chars int, bytes int, how string, sentence boolean, language string"
    ends = written(by_batch(sized, schema, _shaped), "ends")
    sized = ends.join(ends.groupBy("same").agg(F.count("*").alias("copies")), "same")
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[_ ]+", "-")
    most = models.select(plain(F.col("name")).alias("model"), F.coalesce("max_tokens", F.lit(default_tokens)).alias("max_tokens")).groupBy("model").agg(F.max("max_tokens").alias("max_tokens"))
    calls = usage.filter("source_path is not null").groupBy("source_path", "page_number").agg(F.max_by(F.struct(plain(F.col("model_name")).alias("model"), "output_tokens"), F.struct("attempt", "output_tokens")).alias("c"))
    spent = calls.select(F.col("source_path").alias("path"), F.col("page_number").alias("page"), "c.*").join(most, "model").filter("output_tokens >= max_tokens").select("path", "page", F.lit(True).alias("full"), F.lit(None).cast("string").alias("next"))
    # the start of the next page by an equal join: a document of any length is spread over its pages
    after = ends.filter("path is not null and page is not null").groupBy("path", (F.col("page") - 1).cast(ends.schema["page"].dataType).alias("page")).agg(F.max("start").alias("next"))
    about = spent.unionByName(after.withColumn("full", F.lit(None).cast("boolean"))).groupBy("path", "page").agg(F.max("full").alias("full"), F.max("next").alias("next"))
    odds = written(log_odds(sized, full.filter(~F.col("wraps")), "key", "text", "copies"), "odds")
    given = sized.drop("text", "start", "same").join(odds, "key", "left")
    bars = F.broadcast(thresholds(given.filter("not wraps").select("language", "odds")))  # a row for each language
    given = given.join(bars, "language", "left").join(about, ["path", "page"], "left")
    given = given.select("key", "source", "how", "sentence", "odds", "into", F.coalesce("threshold", F.lit(DEFAULT)).alias("threshold"), "chars", "bytes", "copies", "next", "wraps", "full")
    judged = written(by_batch(given, f"key {kind}, source string, how string, chars int, bytes int, copies bigint, low boolean, cause string", _judge), "judged")
    note = F.col("how") == "note"
    cap = limits(judged.filter(F.coalesce("cause", F.lit("")) != "tokens").select("source", "chars", "bytes", "copies", note.alias("note"), (F.col("cause").isNotNull() | note).alias("breaks")))
    within = lambda unit, slack: F.exists(F.coalesce(f"{unit}_limits", F.array().cast("array<int>")), lambda x: (x >= F.col(unit)) & (x - F.col(unit) < slack))
    near = within("chars", 24) | within("bytes", 4)
    limit = within("chars", 1) | within("bytes", 1) | ((F.col("how") == "note") & (within("chars", 48) | within("bytes", 48))) | (near & (F.col("how").isin("note", "plain", "open") | ((F.col("how") == "short") & F.col("low"))))
    cause = F.when(F.col("cause") == "tokens", "tokens").when(limit, "limit").otherwise(F.col("cause"))
    judged = judged.join(cap, "source", "left").select("key", "source", cause.alias("cause"))
    blank = rows.filter(F.col("text").isNull() | (F.trim(F.col("text"), F.lit(" \t\n")) == "")).select("key", "source", F.lit(None).cast("string").alias("cause"))
    return judged.union(blank).withColumnRenamed("key", key)


def shares(judged: DataFrame) -> DataFrame:
    """source, rows, cut and share: how often each source cuts."""
    n, bad = F.count("*"), F.count("cause")
    return judged.groupBy("source").agg(n.alias("rows"), bad.alias("cut"), F.round(bad / n, 6).alias("share"))
