"""Compound files: sector chains of a small file system inside one file."""

from __future__ import annotations

import struct

from .common import FormatError

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # this and above are marks, not sectors


def read(data: bytes) -> dict[str, bytes]:
    """Stream name to content. Broken chains end where they break."""
    if data[:8] != MAGIC or len(data) < 512:
        raise FormatError("not a compound file")
    shift, small = struct.unpack_from("<HH", data, 30)
    if not 9 <= shift <= 12 or not 6 <= small <= shift:
        raise FormatError("bad sector size")
    size, tiny = 1 << shift, 1 << small
    _, first_dir, _, cutoff, first_mini, _, first_difat, _ = struct.unpack_from("<8I", data, 44)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    words = lambda b: struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4])
    difat, at, seen = [*struct.unpack_from("<109I", data, 76)], first_difat, set()
    while at < _END and at not in seen:
        seen.add(at)
        block = words(sector(at))
        if not block:
            break
        difat += block[:-1]
        at = block[-1]
    fat = [x for i in difat if i < _END for x in words(sector(i))]

    def chain(at: int, table: list[int] | tuple, block) -> bytes:
        out, seen = [], set()
        while at < _END and at < len(table) and at not in seen:
            seen.add(at)
            out.append(block(at))
            at = table[at]
        return b"".join(out)

    entries = chain(first_dir, fat, sector)
    mini = words(chain(first_mini, fat, sector)) if first_mini < _END else ()
    root, streams = b"", {}
    for i in range(0, len(entries) - 127, 128):
        e = entries[i : i + 128]
        n, kind = struct.unpack_from("<H", e, 64)[0], e[66]
        name = e[: max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
        start, length = struct.unpack_from("<II", e, 116)
        if kind == 5:
            root = chain(start, fat, sector)
        elif kind == 2:
            if length < cutoff:
                content = chain(start, mini, lambda j: root[j * tiny : (j + 1) * tiny])
            else:
                content = chain(start, fat, sector)
            streams.setdefault(name, content[:length])
    return streams


def write(streams: dict[str, bytes]) -> bytes:
    """A compound file with the streams, all in full sectors (for fixtures)."""
    size = 512
    bodies, fat = [], []

    def put(content: bytes) -> int:
        first = len(bodies)
        n = max(1, -(-len(content) // size))
        for k in range(n):
            bodies.append(content[k * size : (k + 1) * size].ljust(size, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return first

    def entry(name: str, kind: int, start: int, length: int, child: int = 0xFFFFFFFF, right: int = 0xFFFFFFFF) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<III", 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<III", start, length, 0)

    items = [(n, put(c.ljust(4096, b"\0")), max(len(c), 4096)) for n, c in streams.items()]
    table = [entry("Root Entry", 5, 0xFFFFFFFE, 0, 1 if items else 0xFFFFFFFF)]
    table += [entry(n, 2, s, length, right=i + 2 if i + 1 < len(items) else 0xFFFFFFFF) for i, (n, s, length) in enumerate(items)]
    directory = put(b"".join(table).ljust(-(-len(table) * 128 // size) * size, b"\0"))
    n_fat = 1
    while (len(bodies) + n_fat) * 4 > n_fat * size:
        n_fat += 1
    places = list(range(len(bodies), len(bodies) + n_fat))
    fat += [0xFFFFFFFD] * n_fat
    raw = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * size, b"\xff")
    head = MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *(places + [0xFFFFFFFF] * 109)[:109]) + b"".join(bodies) + raw
