"""Problem 7: cut oversized texts at natural boundaries, with overlap.

Each node of a text's cut graph is a place where a piece may end. Every node is joined to its farthest legal successor:
the next piece begins ``overlap`` characters before the node and may hold ``limit`` characters. Squaring the successor table
(pointer doubling) then lists all cuts of the greedy walk in as many rounds as the number of pieces has bits.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import by_batch

#: Stops, stops of scripts without blanks, their commas, and marks that close after a stop.
STOPS, FULL_STOPS, FULL_COMMAS, CLOSERS = ".!?…।؟", "。！？", "，、；", "\"'”’»)]」』）*"
BLANKS = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
_lazy: dict = {}


def _is(codes: np.ndarray, marks: str) -> np.ndarray:
    if marks not in _lazy:
        _lazy[marks] = np.zeros(sys.maxunicode + 1, bool)
        _lazy[marks][[ord(x) for x in marks]] = True
    return _lazy[marks][codes]


def boundaries(text: str) -> list[np.ndarray]:
    """Places where a piece may end, from the strongest kind to the weakest: blank line, line, sentence, word or clause."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(codes)
    blank = _is(codes, BLANKS)
    ends = np.flatnonzero(blank & ~np.append(blank[1:], False)) + 1
    begins = np.flatnonzero(blank & ~np.append(False, blank[:-1]))
    breaks = np.append(0, np.cumsum(codes == 10))
    lines = breaks[ends] - breaks[begins]

    closes = _is(codes, CLOSERS)
    before = np.maximum(begins - 1, 0)
    for _ in range(3):
        before = np.where(closes[before], np.maximum(before - 1, 0), before)
    stopped = _is(codes, STOPS)[before] if n else before

    full = np.flatnonzero(_is(codes, FULL_STOPS)) + 1
    for _ in range(3):
        full = np.where((full < n) & closes[np.minimum(full, n - 1)], full + 1, full)
    words = np.concatenate([ends[lines == 0], np.flatnonzero(_is(codes, FULL_COMMAS)) + 1])
    return [ends[lines > 1], ends[lines == 1], np.unique(np.concatenate([ends[(lines == 0) & stopped], full])), np.unique(words)]


def _whole(text: str, at: int, low: int) -> int:
    """A forced cut moved back so that it parts no base character from its marks."""
    place = at
    while place > low + 1 and (unicodedata.category(text[place])[0] == "M" or "‍" in text[place - 1 : place + 1]):
        place -= 1
    return place if place > low + 1 else at


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """The ends of the greedy pieces of ``text``, in order; the last is its length."""
    n = len(text)
    if n <= limit:
        return [n]
    step = limit - overlap
    levels = boundaries(text)
    nodes = np.unique(np.concatenate([[0, n], *levels]))
    # Places where no natural boundary lies within reach get forced ones, a step apart.
    forced = []
    for i in np.flatnonzero(np.diff(nodes) > step):
        at, end = int(nodes[i]), int(nodes[i + 1])
        while end > (most := max(at - overlap, 0) + limit):
            at = _whole(text, most, at)
            forced.append(at)
    natural, nodes = nodes, np.unique(np.concatenate([nodes, np.array(forced, np.int64)]))
    most = np.maximum(nodes - overlap, 0) + limit
    half = nodes + step // 2
    best = np.full(len(nodes), -1, np.int64)
    # a strong boundary in the far half, else a weaker one, else the farthest natural one, else a forced one
    for places, least in [*((x, half) for x in levels), (natural, nodes), (nodes, nodes)]:
        if len(places):
            far = places[np.maximum(np.searchsorted(places, most, "right") - 1, 0)]
            best = np.where((best < 0) & (far > least) & (far <= most), far, best)
    best = np.where(most >= n, n, best)
    jump = np.searchsorted(nodes, best)
    jump[-1] = len(nodes) - 1
    path = np.zeros(1, np.int64)
    while path[-1] != len(nodes) - 1:
        path = np.concatenate([path, jump[path]])  # the first half of the walk, moved on by its own length
        jump = jump[jump]
    return np.unique(nodes[path])[1:].tolist()


def pieces(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """One row per piece of each text over ``limit`` code points: key, piece_no from 1, start_pos, end_pos, piece.

    Pieces are exact slices: piece k+1 begins with the last ``overlap`` characters of piece k, and the parts after the overlaps
    join to the text. Null, empty and short texts give no row; repeated keys give the pieces of each row.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    def make(c: dict) -> dict:
        out: dict[str, list] = {"key": [], "piece_no": [], "start_pos": [], "end_pos": [], "piece": []}
        for k, t in zip(c["key"].to_pylist(), c["text"].to_pylist()):
            last = begin = 0
            for i, end in enumerate(cuts(t, limit, overlap), 1):
                begin = max(begin, last - overlap)
                for name, v in zip(out, (k, i, begin, end, t[begin:end])):
                    out[name].append(v)
                last = end
        return out

    big = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > limit)
    kind = df.schema[key].dataType.simpleString()
    return by_batch(big, f"key {kind}, piece_no int, start_pos bigint, end_pos bigint, piece string", make).withColumnRenamed("key", key)
