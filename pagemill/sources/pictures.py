"""Pictures as pixels: PNG and BMP with the standard library and numpy, other formats where an imaging library is installed."""

from __future__ import annotations

import base64
import io
import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"


class Unreadable(ValueError):
    """A picture whose format nothing here can decode."""


def _unfiltered(raw: bytes, width: int, height: int, size: int) -> np.ndarray:
    """Rows of bytes from PNG's filtered rows; ``size`` is the bytes of a pixel."""
    step = width * size
    out = np.zeros((height + 1, step + size), np.uint8)  # a blank row above, a blank pixel to the left
    for y in range(height):
        kind, line = raw[y * (step + 1)], np.frombuffer(raw, np.uint8, step, y * (step + 1) + 1)
        row, up = out[y + 1], out[y]
        if kind == 0:
            row[size:] = line
        elif kind == 2:
            row[size:] = line + up[size:]
        elif kind == 1:
            row[size:] = np.cumsum(line.reshape(-1, size), axis=0, dtype=np.uint8).ravel()
        else:
            for i in range(step):
                a, b, c = int(row[i]), int(up[i + size]), int(up[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                    guess = (a, b, c)[near.index(min(near))]
                row[i + size] = (int(line[i]) + guess) & 255
    return out[1:, size:]


def _from_png(data: bytes) -> np.ndarray:
    at, parts, head, palette, alpha = 8, [], None, None, None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif name == b"IDAT":
            parts.append(body)
        at += 12 + size
    if head is None:
        raise Unreadable("no header")
    width, height, depth, kind, _, _, laced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth != 8 or laced or channels is None:
        raise Unreadable("a PNG of this depth or order")
    pixels = _unfiltered(zlib.decompress(b"".join(parts)), width, height, channels).reshape(height, width, channels)
    if kind == 3:
        index = pixels[..., 0]
        pixels = palette[index]
        if alpha is not None:
            full = np.full(256, 255, np.uint8)
            full[: len(alpha)] = alpha
            pixels = np.dstack([pixels, full[index]])
    return pixels


def _from_bmp(data: bytes) -> np.ndarray:
    start, width, height, depth, packed = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26]), *struct.unpack("<HI", data[28:34])
    if depth not in (24, 32) or packed not in (0, 3):
        raise Unreadable("a BMP of this depth")
    size, rows = depth // 8, abs(height)
    step = (width * size + 3) // 4 * 4
    pixels = np.frombuffer(data, np.uint8, step * rows, start).reshape(rows, step)[:, : width * size].reshape(rows, width, size)[..., 2::-1]
    return pixels[::-1] if height > 0 else pixels


def pixels(data: bytes) -> np.ndarray:
    """(height, width, channels) of a picture: grey, grey with alpha, RGB or RGBA."""
    if data[:8] == _PNG:
        return _from_png(data)
    if data[:2] == b"BM":
        return _from_bmp(data)
    try:
        from PIL import Image
    except ImportError:
        raise Unreadable("no imaging library is installed for this format") from None
    with Image.open(io.BytesIO(data)) as im:
        return np.asarray(im.convert("RGBA" if im.mode in ("RGBA", "LA", "P") else "RGB"))


def png(image: np.ndarray) -> bytes:
    """A PNG of (height, width[, channels]) bytes."""
    image = image[..., None] if image.ndim == 2 else image
    height, width, channels = image.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image, np.uint8))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def to_png(data: bytes) -> tuple[bytes, int, int]:
    """(PNG, width, height) in RGB, or RGBA where there is transparency."""
    p = pixels(data)
    if p.shape[2] == 1:
        p = np.repeat(p, 3, axis=2)
    elif p.shape[2] == 2:
        p = np.dstack([p[..., 0]] * 3 + [p[..., 1]])
    return png(p), p.shape[1], p.shape[0]


def fitted(data: bytes, most: int = 4096) -> bytes:
    """``data`` if no side is over ``most``, else a PNG scaled down to it, sides cut to whole pixels."""
    from pagemill.sources.decoders import image_size

    size = image_size(data)
    if size is None or max(size[1:]) <= most:
        return data
    width, height = (int(v * most / max(size[1:])) for v in size[1:])
    p = pixels(data)
    # the mean of the pixels that fall into each new one
    y, x = (np.minimum(np.arange(n + 1) * m // n, m) for n, m in ((max(height, 1), p.shape[0]), (max(width, 1), p.shape[1])))
    total = np.add.reduceat(np.add.reduceat(p.astype(np.uint32), y[:-1], axis=0), x[:-1], axis=1)
    count = np.maximum(np.diff(y), 1)[:, None, None] * np.maximum(np.diff(x), 1)[None, :, None]
    return png((total // count).astype(np.uint8))


def data_url(data: bytes) -> str:
    """A picture as an address that holds it."""
    from pagemill.sources.decoders import image_size

    size = image_size(data)
    kind = {"JPEG": "jpeg", "WEBP": "webp", "BMP": "bmp", "TIFF": "tiff"}.get(size[0], "png") if size else "png"
    return f"data:image/{kind};base64,{base64.b64encode(data).decode('ascii')}"
