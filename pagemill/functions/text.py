"""Column functions with the text semantics of Python, on the JVM side.

Every function treats null as the empty string unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.strip`` knows it, spelled so that Java and RE2 read it alike; without the line feed, and with it.
INLINE = r"\t\x0b\x0c\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = INLINE + r"\n"
#: Wrapping fence with no, `markdown` or `md` as info string.
FENCE = rf"(?s)\A```(?:markdown|md)?[{SPACE}]*\n(.*)```\z"


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(filled(c), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def rstrip_lines(c: Column) -> Column:
    return F.regexp_replace(filled(c), rf"[{INLINE}]+(\n|\z)", "$1")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def unfenced(c: Column) -> Column:
    """The text within a wrapping code fence, else the stripped text. The fence's body ends at the first closing fence that ends the text."""
    bare = strip(c)
    return F.when(bare.rlike(FENCE), F.regexp_extract(bare, FENCE, 1)).otherwise(bare)


def clean_markdown(c: Column) -> Column:
    """Five steps in order: wrapping fence, line ends, blank runs, trailing blanks, edges. Blank and null texts give one line feed."""
    t = F.regexp_replace(unfenced(c), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.concat(strip(rstrip_lines(t)), F.lit("\n"))


def suffix(path: Column) -> Column:
    """Lower-case last suffix of the last path part, '' if none; a leading dot starts no suffix."""
    name = F.regexp_replace(F.element_at(F.split(filled(path), "/"), -1), r"\A\.+", "")
    return F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(filled(path), "/"), -1), r"(?<=.)\.[^.]*\z", "")


def _fixed(c: Column, places: int) -> Column:
    return c.cast(f"decimal(20,{places})").cast("string")


def tokens_text(n: Column) -> Column:
    """Counts from a million on in millions with two places, others with thousands separators."""
    return F.when(n >= 1_000_000, F.concat(_fixed(n.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)"), 2), F.lit("M"))).otherwise(F.format_number(n, 0))


def cost_text(c: Column) -> Column:
    """Six places under a tenth of a cent, four under ten cents, else two; ``c`` is a decimal, halves round up."""
    return F.concat(F.lit("$"), F.when(c < 0.001, _fixed(c, 6)).when(c < 0.1, _fixed(c, 4)).otherwise(_fixed(c, 2)))


def masked(key: Column) -> Column:
    return F.when(filled(key) == "", "").otherwise(F.concat(F.lit("***"), F.right(key, F.lit(4))))


def shortened(url: Column, most: int = 50) -> Column:
    return F.when(F.length(url) < most, url).otherwise(F.concat(F.substring(url, 1, most - 3), F.lit("...")))
