"""Kinds and sizes of images from their first bytes."""

from __future__ import annotations

import struct

# Leading bytes of image formats.
SIGNATURES = ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG", "image/png"), (b"GIF8", "image/gif"))
EXTENSIONS = {"image/gif": "gif", "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}


def sniff(data: bytes, otherwise: str = "image/png") -> str:
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return next((kind for start, kind in SIGNATURES if data.startswith(start)), otherwise)


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + max(size, 2)
    return None


def dimensions(data: bytes, kind: str | None = None) -> tuple[int, int] | None:
    """(width, height); None where they can't be read or one is 0."""
    kind, out = kind or sniff(data, ""), None
    if kind == "image/png" and len(data) >= 24:
        out = struct.unpack_from(">II", data, 16)
    elif kind == "image/gif" and len(data) >= 10:
        out = struct.unpack_from("<HH", data, 6)
    elif kind == "image/jpeg":
        out = _jpeg(data)
    elif kind == "image/webp" and len(data) >= 30 and data[12:16] == b"VP8X":
        out = tuple(int.from_bytes(data[i : i + 3], "little") + 1 for i in (24, 27))
    return out if out and min(out) > 0 else None
