"""Decoders that the caller adds."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pagemill.sources.decoders import Decoded


class Custom(NamedTuple):
    decode: Callable[[bytes, str], Decoded]
    file_type: str
    needs_vlm: bool
    provider: str


#: By suffix. What is entered here takes the place of a shipped decoder.
CUSTOM: dict[str, Custom] = {}


def register(*suffixes: str, file_type: str = "", needs_vlm: bool = False, provider: str = "") -> Callable:
    """Enter a decoder, ``bytes, path -> (pages, metadata)``, for some suffixes. It must be picklable. One that raises NotImplementedError has no
    text of its own; ``needs_vlm`` tells that its pages can be rendered for a model."""

    def enter(decode: Callable[[bytes, str], Decoded]) -> Callable[[bytes, str], Decoded]:
        for s in suffixes:
            CUSTOM[s.lower().lstrip(".")] = Custom(decode, file_type or s.lower().lstrip("."), needs_vlm, provider)
        return decode

    return enter
