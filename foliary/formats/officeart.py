"""Pictures inside binary drawing streams."""

from __future__ import annotations

import struct

from .common import image

#: Record type to image format, and where the picture begins in the record.
BLIPS = {0xF01D: "jpg", 0xF01E: "png", 0xF01F: "dib", 0xF029: "tiff"}
HEADER, PAYLOAD = 8, 25


def images(data: bytes) -> list[dict]:
    """All embedded pictures; of those with the same type and length the first."""
    out, seen, at = [], set(), 0
    while at + HEADER <= len(data):
        kind, n = struct.unpack_from("<HI", data, at + 2)
        if kind in BLIPS and PAYLOAD - HEADER < n and at + HEADER + n <= len(data):
            if (kind, n) not in seen:
                seen.add((kind, n))
                out.append(image(f"image-{len(out) + 1}.{BLIPS[kind]}", data[at + PAYLOAD : at + HEADER + n], fmt=BLIPS[kind]))
            at += HEADER + n
        else:
            at += 1
    return out
