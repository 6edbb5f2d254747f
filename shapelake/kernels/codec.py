"""Encoding and decoding of 8-bit PNG with nothing but NumPy and zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_KINDS = {1: 0, 2: 4, 3: 2, 4: 6}  # channels -> color type


def _chunk(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


def encode_png(a: np.ndarray, level: int = 6) -> bytes:
    """PNG bytes of an (h, w) or (h, w, 1..4) uint8 array; deterministic for a given zlib."""
    a = np.ascontiguousarray(a, np.uint8)
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, n = a.shape
    if n not in _KINDS or not h or not w:
        raise ValueError("a PNG needs one to four channels and at least one pixel")
    rows = np.zeros((h, w * n + 1), np.uint8)
    rows[:, 1:] = a.reshape(h, w * n)
    head = struct.pack(">IIBBBBB", w, h, 8, _KINDS[n], 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, channels) uint8 array of an 8-bit, not interlaced PNG (palettes are expanded). ValueError else."""
    if not data.startswith(_MAGIC):
        raise ValueError("no PNG")
    at, parts, head, palette, alpha = 8, [], None, None, None
    while at + 8 <= len(data):
        size, tag = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if tag == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif tag == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif tag == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif tag == b"IDAT":
            parts.append(body)
        elif tag == b"IEND":
            break
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNG without interlace is read")
    w, h, kind = head[0], head[1], head[3]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, w * n + 1)
    except (zlib.error, ValueError) as e:
        raise ValueError("broken PNG data") from e
    out = np.zeros((h, w * n), np.uint8)
    prev = np.zeros(w * n, np.int32)
    for y in range(h):
        how, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if how == 0:
            cur = line
        elif how == 1:  # each byte adds to the one a pixel before: running sums per channel
            cur = np.cumsum(line.reshape(w, n), 0).reshape(-1) & 255
        elif how == 2:
            cur = (line + prev) & 255
        else:
            cur = np.zeros(w * n, np.int32)
            for i in range(w * n):
                left = cur[i - n] if i >= n else 0
                if how == 3:
                    guess = (left + prev[i]) // 2
                else:
                    corner = prev[i - n] if i >= n else 0
                    p = left + prev[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - prev[i]), 1, prev[i]), (abs(p - corner), 2, corner))[2]
                cur[i] = (line[i] + guess) & 255
        out[y], prev = cur, cur
    out = out.reshape(h, w, n)
    if kind == 3:
        if palette is None:
            raise ValueError("no palette")
        rgb = palette[out[:, :, 0]]
        if alpha is None:
            return rgb
        a = np.full(len(palette), 255, np.uint8)
        a[: len(alpha)] = alpha
        return np.dstack([rgb, a[out[:, :, 0]]])
    return out
