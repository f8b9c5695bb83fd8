"""Problem 8: token ids of a byte-level BPE vocabulary, pre-tokenised without regular expressions.

A batch of texts becomes one array of code points. Each code point has a class, and each class is a function from scanner state to
scanner state. Composing functions is associative, so the states of all places follow from a blocked prefix scan: functions are
composed inside blocks in lockstep, block totals by doubling, and the block starts are then spread over the blocks. Token
starts are a comparison of neighbouring states. The slices go through a cache in front of the pair merging.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import by_batch

#: White space of Unicode. Fixed values.
BLANKS = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, ONE, R, V, L, E, END = range(12)
IN_LETTER, IN_NUMBER, IN_OTHER, AT_SPACE, AT_BLANK, AT_QUOTE, AT_R, AT_V, AT_L, DONE = range(10)
BLOCK = 64


def code_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[BLANKS] = BLANK
    out[32] = SPACE
    out[39] = QUOTE
    for letters, kind in (("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(x) for x in letters]] = kind
    return out


def transitions() -> np.ndarray:
    """next state by [class, state]."""
    t = np.zeros((12, 10), np.uint8)
    t[[LETTER, ONE, R, V, L, E]] = IN_LETTER
    t[NUMBER], t[OTHER], t[SPACE], t[BLANK], t[END] = IN_NUMBER, IN_OTHER, AT_SPACE, AT_BLANK, AT_BLANK
    t[QUOTE] = AT_QUOTE
    t[QUOTE, [IN_OTHER, AT_SPACE, AT_QUOTE]] = IN_OTHER
    t[ONE, AT_QUOTE] = t[E, AT_R] = t[E, AT_V] = t[L, AT_L] = DONE
    t[R, AT_QUOTE], t[V, AT_QUOTE], t[L, AT_QUOTE] = AT_R, AT_V, AT_L
    return t


_lazy: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if "classes" not in _lazy:
        _lazy["classes"], _lazy["next"] = code_classes(), transitions()
    return _lazy["classes"], _lazy["next"]


def scan(kinds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The state after each place, by an associative scan over the places' transition functions; the first begins AT_BLANK."""
    states, n = table.shape[1], len(kinds)
    flat = table.ravel()
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, END, np.intp)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(rows, BLOCK).T) * states
    total = np.tile(np.arange(states, dtype=np.uint8), (rows, 1))
    for j in range(BLOCK):
        total = flat[steps[j][:, None] + total]
    prefix, width = total, 1
    while width < rows:  # Hillis-Steele: each block's function after the one `width` blocks before
        prefix = np.concatenate([prefix[:width], np.take_along_axis(prefix[width:], prefix[:-width].astype(np.intp), 1)])
        width *= 2
    state = np.full(rows, AT_BLANK, np.uint8)
    state[1:] = prefix[:-1, AT_BLANK]
    out = np.empty((BLOCK, rows), np.uint8)
    for j in range(BLOCK):
        state = flat[steps[j] + state]
        out[j] = state
    return out.T.reshape(-1)[:n]


def starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a pre-token begins. ``ends`` marks the separators between texts, which are tokens of their own."""
    classes, table = _tables()
    kinds = classes[codes]
    kinds[ends] = END
    state = scan(kinds, table)
    before = np.concatenate([[AT_BLANK], state[:-1]]).astype(np.uint8)
    blank = (kinds == SPACE) | (kinds == BLANK)
    was_blank = np.concatenate([[False], blank[:-1]])
    after = np.concatenate([kinds[1:], [END]])
    next_dark = ~np.concatenate([blank[1:], [False]]) & (after != END)
    group = np.array([0, 1, 2, 3, 3, 2, 0, 0, 0, 4], np.uint8)  # states that continue the same run
    run = np.array([0, 1, 2, 3, 3, 2, 0, 0, 0, 0, 0, 5], np.uint8)  # what a class continues
    out = (group[before] != run[kinds]) & (before != AT_SPACE)
    out = np.where(blank, ~was_blank | next_dark, out)
    done = state == DONE
    short = done & (before == AT_QUOTE)
    out[short] = False
    long = np.flatnonzero(done & ~short) - 1
    out[long] = False
    out[ends] = True
    out[np.concatenate([[True], ends[:-1]])] = True
    return out


class Merger:
    """Byte pairs merged by rank, behind a cache of whole slices. The cache is emptied when full; that never changes a result."""

    def __init__(self, path: str, keep: int = 400_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.keep, self.cache = keep, {}

    def ids(self, part: bytes) -> list[int]:
        got = self.cache.get(part)
        if got is None:
            whole = self.ranks.get(part)
            got = [whole] if whole is not None else self._merge(part)
            if len(part) <= 64:
                if len(self.cache) >= self.keep:
                    self.cache.clear()
                self.cache[part] = got
        return got

    def _merge(self, part: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals, over a linked list; O(n log n) for slices of any length."""
        n, ranks = len(part), self.ranks
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        end = list(range(1, n + 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], right[i], alive[j] = end[j], right[j], 0
            if right[j] < n:
                left[right[j]] = i
                if (r := ranks.get(part[i : end[right[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[j]]))
            if left[i] >= 0 and (r := ranks.get(part[left[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, left[i], end[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i : end[i]]])
            i = right[i]
        return out


def _merger(path: str) -> Merger:
    if path not in _lazy:
        _lazy[path] = Merger(path)
    return _lazy[path]


def encode_batch(texts: list[str | None], path: str, offsets: bool = False) -> tuple[list[list[int]], list[list[int]] | None]:
    """Ids of each text, and the character offsets of the pre-tokens' ids if asked for; empty lists for null and empty."""
    merger = _merger(path)
    joined = "\n".join(t or "" for t in texts) + "\n"
    raw = joined.encode("utf-8")
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    seps = np.cumsum(lengths + 1) - 1
    ends = np.zeros(len(codes), bool)
    ends[seps] = True
    begin = np.flatnonzero(starts(codes, ends))
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    cut = np.append(byte_at[begin], len(raw)).tolist()
    first = np.searchsorted(begin, np.concatenate([[0], seps[:-1] + 1])).tolist()
    last = np.searchsorted(begin, seps).tolist()
    ids, places = [], [] if offsets else None
    get, slow = merger.cache.get, merger.ids
    chars = begin.tolist() if offsets else None
    for k, (a, b) in enumerate(zip(first, last)):
        own: list[int] = []
        at: list[int] = []
        for i in range(a, b):
            part = raw[cut[i] : cut[i + 1]]
            got = get(part) or slow(part)
            own += got
            if offsets:
                at += [chars[i] - (int(seps[k - 1]) + 1 if k else 0)] * len(got)
        ids.append(own)
        if offsets:
            places.append(at)
    return ids, places


def encode(df: DataFrame, key: str, text: str, vocabulary: str, offsets: bool = False) -> DataFrame:
    """key, ids and, if asked for, starts: for each id the character at which its pre-token begins.

    Null and empty texts give empty lists; strings of special tokens are ordinary text; every row gives one row, also with a
    repeated or null key. ``vocabulary`` is a ranks file that every executor can read under the same path.
    """
    kind = df.schema[key].dataType.simpleString()

    def make(c: dict) -> dict:
        texts = c["text"].to_pylist()
        ids, places, begin = [], [], 0
        while begin < len(texts):  # bounded work arrays, whatever the batch holds
            size, end = 0, begin
            while end < len(texts) and (end == begin or size + len(texts[end] or "") <= 2_000_000):
                size += len(texts[end] or "")
                end += 1
            a, b = encode_batch(texts[begin:end], vocabulary, offsets)
            ids += a
            places += b or []
            begin = end
        return {"key": c["key"], "ids": ids} | ({"starts": places} if offsets else {})

    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return by_batch(given, f"key {kind}, ids array<int>" + ", starts array<int>" * offsets, make).withColumnRenamed("key", key)


def decode(ids: list[int], vocabulary: str) -> str:
    merger = _merger(vocabulary)
    if not hasattr(merger, "bytes"):
        merger.bytes = {v: k for k, v in merger.ranks.items()}
    return b"".join(merger.bytes[i] for i in ids).decode("utf-8")
