"""Page descriptions: objects found by scanning, text and rules read from content streams, tables from ruled lines."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from ..operators.grid import MOST_CELLS, Style, build, classify, connected, detect, lines_by_gap, merge_rules, page_text
from .common import FormatError, document, image, page, rect, run

STREAM_LIMIT, MOST_INNER, DEEPEST, MOST_PIXELS = 256 << 20, 100_000, 1000, 32768
STYLE = Style(text_of=lines_by_gap)
_object = re.compile(rb"(?s)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj")
_token = re.compile(r"\[|\]|<<|>>|<[^>]*>|/[^\s\[\]<>(){}/%]*|[^\s\[\]<>(){}/%]+|[(){}>]|%[^\r\n]*")
_string = re.compile(rb"\((?:\\.|[^\\()])*\)|(?<!<)<[0-9A-Fa-f\s]+>(?!>)", re.DOTALL)
_escapes = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


@dataclass
class Obj:
    head: bytes
    data: bytes = b""
    gen: int = 0


@dataclass
class Font:
    name: str = ""
    encoding: str = ""
    collection: str = ""
    chars: dict[bytes, str] = field(default_factory=dict)

    def decode(self, raw: bytes) -> str:
        if self.chars:
            widths, out, i = sorted({len(k) for k in self.chars}, reverse=True), [], 0
            while i < len(raw):
                n = next((w for w in widths if raw[i : i + w] in self.chars), 0)
                out.append(self.chars[raw[i : i + n]] if n else self._base(raw[i : i + 1]))
                i += n or 1
            return "".join(out)
        if raw[:2] == b"\xfe\xff":
            return raw[2:].decode("utf-16-be", "replace")
        if self.encoding == "GBK-EUC-H":
            return raw.decode("gbk", "replace")
        if self.encoding.startswith("UniGB-UCS2"):
            return raw.decode("utf-16-be", "replace")
        return "".join(self._base(bytes([b])) for b in raw)

    def _base(self, b: bytes) -> str:
        codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(self.encoding, "latin-1")
        return b.decode(codec, "ignore") or b.decode("latin-1")


def _rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _name(head: bytes, key: str) -> str:
    m = re.search(rb"/" + key.encode() + rb"\s*/([^\s/<>\[\]()]+)", head)
    return m[1].decode("latin-1") if m else ""


def _ref(head: bytes, key: str) -> int | None:
    m = re.search(rb"/" + key.encode() + rb"\s+(\d+)\s+\d+\s+R", head)
    return int(m[1]) if m else None


def _int(head: bytes, key: str, default: int = 0) -> int:
    m = re.search(rb"/" + key.encode() + rb"\s+(-?\d{1,18})", head)
    return int(m[1]) if m else default


def inflate(o: Obj) -> bytes:
    if b"FlateDecode" not in o.head and not re.search(rb"/Filter\s*\[?\s*/Fl\b", o.head):
        return o.data
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(o.data, STREAM_LIMIT)
    except zlib.error:
        return b""
    if stream.unconsumed_tail:
        raise FormatError("stream of more than 256 MiB")
    return out


def literal(token: str) -> bytes:
    """Bytes of a string token, (literal) or <hex>."""
    if token.startswith("<"):
        digits = re.sub(r"[^0-9A-Fa-f]", "", token)
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    out, i, s = [], 0, token[1:-1] if token.endswith(")") else token[1:]
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s):
            i += 1
            m = re.match("[0-7]{1,3}", s[i:])
            if m:
                out.append(chr(int(m[0], 8) & 255))
                i += len(m[0])
                continue
            if s[i] in "\r\n":
                i += 2 if s[i : i + 2] == "\r\n" else 1
                continue
            c = _escapes.get(s[i], s[i])
        elif c == "\\":
            break
        out.append(c)
        i += 1
    return "".join(out).encode("latin-1", "replace")


def tokens(text: str) -> list:
    """Names, numbers, operators and strings; an array is a list of its tokens. Unfinished strings end with the text."""
    out: list = []
    open_: list | None = None
    i = 0
    while i < len(text):
        if text[i] == "(":
            depth, j = 0, i
            while j < len(text):
                if text[j] == "\\":
                    j += 2
                    continue
                depth += {"(": 1, ")": -1}.get(text[j], 0)
                j += 1
                if not depth:
                    break
            t, i = text[i : min(j, len(text))], j
        else:
            m = _token.match(text, i)
            if not m:
                i += 1
                continue
            t, i = m[0], m.end()
            if t[0] == "%":
                continue
        if t == "[":
            open_ = []
        elif t == "]":
            out.append(open_ or [])
            open_ = None
        else:
            (out if open_ is None else open_).append(t)
    return out


def _num(t: object) -> float:
    try:
        return float(t)
    except (TypeError, ValueError):
        return 0.0


def cmap(text: str) -> dict[bytes, str]:
    """Codes to characters from bfchar and bfrange sections; a range holds at most 65536 codes."""
    out: dict[bytes, str] = {}
    wide = lambda h: bytes.fromhex(h + "0" * (len(h) % 2)).decode("utf-16-be", "replace")
    for body in re.findall(r"beginbfchar(.*?)endbfchar", text, re.DOTALL):
        out |= {bytes.fromhex(a): wide(b) for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", body) if len(a) % 2 == 0}
    for body in re.findall(r"beginbfrange(.*?)endbfrange", text, re.DOTALL):
        for a, b, to, many in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", body, re.DOTALL):
            lo, hi, n = int(a, 16), int(b, 16), len(a) // 2
            if hi < lo or hi - lo > 0xFFFF or len(a) % 2:
                continue
            if many:
                for k, h in enumerate(re.findall(r"<([0-9A-Fa-f]+)>", many)[: hi - lo + 1]):
                    out[(lo + k).to_bytes(n, "big")] = wide(h)
            else:
                base = wide(to)
                for k in range(hi - lo + 1):
                    c = ord(base[-1]) + k if base else 0
                    if base and c < 0x110000:
                        out[(lo + k).to_bytes(n, "big")] = base[:-1] + chr(c)
    return out


class Reader:
    def __init__(self, data: bytes):
        if not data.strip().startswith(b"%PDF-"):
            raise FormatError("not a PDF")
        self.objects: dict[int, Obj] = {}
        for m in _object.finditer(data):
            body = m[3]
            head, _, rest = body.partition(b"stream")
            content = re.match(rb"\r?\n?(.*?)endstream", rest, re.DOTALL)
            self.objects[int(m[1])] = Obj(head.strip() if _ else body, content[1] if content else b"", int(m[2]))
        self._decrypt(data)
        self._inner()

    def _decrypt(self, data: bytes) -> None:
        """Standard handler, RC4, empty user password; anything else is an error."""
        m = re.search(rb"/Encrypt\s+(\d+)\s+\d+\s+R", data)
        if not m or int(m[1]) not in self.objects:
            return
        head = self.objects[int(m[1])].head
        v, r = _int(head, "V"), _int(head, "R")
        if _name(head, "Filter") != "Standard" or v not in (1, 2) or r not in (2, 3):
            raise FormatError("unsupported encryption")
        part = lambda k: (t := re.search(rb"/" + k + rb"\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)", head, re.DOTALL)) and literal(t[1].decode("latin-1")) or b""
        first = re.search(rb"/ID\s*\[\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)", data, re.DOTALL)
        pad = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
        key = hashlib.md5(pad + part(b"O")[:32] + (_int(head, "P") & 0xFFFFFFFF).to_bytes(4, "little") + (literal(first[1].decode("latin-1")) if first else b"")).digest()
        n = _int(head, "Length", 40) // 8 if r == 3 else 5
        for _ in range(50 if r == 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        for num, o in self.objects.items():
            if num != int(m[1]):
                own = hashlib.md5(key[:n] + num.to_bytes(3, "little") + o.gen.to_bytes(2, "little")).digest()[: min(16, n + 5)]
                o.data = _rc4(own, o.data) if o.data else b""
                # strings of dictionaries are encrypted one by one
                o.head = _string.sub(lambda m, own=own: b"<" + _rc4(own, literal(m[0].decode("latin-1"))).hex().encode() + b">", o.head)

    def _inner(self) -> None:
        for o in [o for _, o in sorted(self.objects.items()) if re.search(rb"/Type\s*/ObjStm\b", o.head)]:
            n, first, raw = _int(o.head, "N"), _int(o.head, "First"), inflate(o)
            head = raw[:first].split()
            if not 0 < n <= MOST_INNER or not 0 < first <= len(raw) or len(head) < 2 * n or not all(x.isdigit() for x in head[: 2 * n]):
                continue
            marks = [(int(head[2 * i]), int(head[2 * i + 1])) for i in range(n)] + [(0, len(raw) - first)]
            for (num, a), (_, b) in zip(marks, marks[1:]):
                if a <= len(raw) - first and num not in self.objects:
                    body = raw[first + a : first + max(a, min(b, len(raw) - first))].strip()
                    self.objects[num] = Obj(body, body)

    def pages(self) -> list[Obj]:
        leaf = lambda o: re.search(rb"/Type\s*/Page\b", o.head) and not re.search(rb"/Type\s*/Pages\b", o.head)
        out: list[Obj] = []
        roots = [r for _, o in sorted(self.objects.items()) if re.search(rb"/Type\s*/Catalog\b", o.head) and (r := _ref(o.head, "Pages")) is not None]
        seen: set[int] = set()
        queue = [(r, 0) for r in roots[:1]]
        while queue:
            num, depth = queue.pop(0)
            o = self.objects.get(num)
            if o is None or num in seen or depth > DEEPEST:
                continue
            seen.add(num)
            kids = re.search(rb"/Kids\s*\[(.*?)\]", o.head, re.DOTALL)
            if kids:
                queue = [(int(x), depth + 1) for x in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])] + queue
            elif leaf(o):
                out.append(o)
        return out or [o for _, o in sorted(self.objects.items()) if leaf(o)]

    def resources(self, o: Obj) -> bytes:
        """The dictionaries of a page and its parents, with their resources."""
        out, seen, at = [], set(), o
        while at is not None and id(at) not in seen:
            seen.add(id(at))
            out.append(at.head)
            r = self.objects.get(_ref(at.head, "Resources") or -1)
            if r:
                out.append(r.head)
            at = self.objects.get(_ref(at.head, "Parent") or -1)
        return b"\n".join(out)

    def _entries(self, res: bytes, key: str) -> list[tuple[str, int]]:
        found = re.search(rb"/" + key.encode() + rb"\s*<<(.*?)>>", res, re.DOTALL)
        body = found[1] if found else b""
        o = self.objects.get(_ref(res, key) or -1)
        return [(n.decode("latin-1"), int(r)) for n, r in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", body + b" " + (o.head if o else b""))]

    def fonts(self, res: bytes) -> dict[str, Font]:
        out = {}
        for alias, num in self._entries(res, "Font"):
            o = self.objects.get(num)
            if o is None:
                continue
            f = Font(_name(o.head, "BaseFont"), _name(o.head, "Encoding"))
            m = re.search(rb"/DescendantFonts\s*\[?\s*(\d+)\s+\d+\s+R", o.head)
            inner = self.objects.get(int(m[1])) if m else None
            both = o.head + (inner.head if inner else b"")
            names = [literal(m[1].decode("latin-1")).decode("latin-1") for k in (b"Registry", b"Ordering") if (m := re.search(rb"/" + k + rb"\s*(\([^)]*\)|<[0-9A-Fa-f\s]*>)", both))]
            f.collection = "-".join(names) if len(names) == 2 else ""
            u = self.objects.get(_ref(o.head, "ToUnicode") or -1)
            if u:
                f.chars = cmap(inflate(u).decode("latin-1"))
            out[alias] = f
        return out

    def content(self, o: Obj) -> str:
        m = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", o.head, re.DOTALL)
        refs = ([int(m[2])] if m[2] else [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]) if m else []
        return "".join(inflate(self.objects[r]).decode("latin-1") + "\n" for r in refs if r in self.objects)

    def images(self, res: bytes) -> list[dict]:
        """Pictures that a page's resources name, also those inside nested forms, each object once."""
        out, seen, queue = [], set(), [(res, 0)]
        while queue:
            own, depth = queue.pop(0)
            inner = []
            for name, num in self._entries(own, "XObject"):
                o = self.objects.get(num)
                if o is None or num in seen:
                    continue
                seen.add(num)
                kind = _name(o.head, "Subtype")
                if kind == "Image":
                    out.append(self.picture(name, o))
                elif kind == "Form" and depth < DEEPEST:
                    r = self.objects.get(_ref(o.head, "Resources") or -1)
                    inner.append((o.head + b"\n" + (r.head if r else b""), depth + 1))
            queue = inner + queue
        return out

    def picture(self, name: str, o: Obj) -> dict:
        """JPEG data as it stands, 8-bit samples as a PNG with the soft mask for transparency, other data unpacked."""
        w, h = _int(o.head, "Width"), _int(o.head, "Height")
        w, h = (w, h) if 0 < w <= MOST_PIXELS and 0 < h <= MOST_PIXELS else (0, 0)
        jpeg = b"DCTDecode" in o.head
        raw = o.data if jpeg else inflate(o)
        n = 0 if jpeg or not w or _int(o.head, "BitsPerComponent") != 8 else self._channels(o.head)
        fmt = "jpg" if jpeg else "raw"
        samples = unfiltered(raw, o.head, w * n, n) if n else b""
        if n and len(samples) >= w * h * n:
            mask = self.objects.get(_ref(o.head, "SMask") or -1)
            raw, fmt = png(samples, w, h, n, inflate(mask) if mask else b""), "png"
        im = image(name, raw, fmt=fmt)
        im["width"], im["height"] = w, h
        return im

    def _channels(self, head: bytes) -> int:
        """Colour channels of a picture, 0 where its colours are not plain."""
        m = re.search(rb"/ColorSpace\s*(?:/Device(Gray|RGB|CMYK)\b|\[\s*/ICCBased\s+(\d+)\s+\d+\s+R)", head)
        if not m:
            return 0
        profile = self.objects.get(int(m[2])) if m[2] else None
        n = {b"Gray": 1, b"RGB": 3, b"CMYK": 4}[m[1]] if m[1] else _int(profile.head, "N") if profile else 0
        return n if n in (1, 3, 4) else 0


def unfiltered(raw: bytes, head: bytes, row: int, step: int) -> bytes:
    """Rows of samples without the predictor that the picture declares."""
    if _int(head, "Predictor", 1) < 10:
        return raw
    out, before = bytearray(), bytes(row)
    for at in range(0, len(raw) - row, row + 1):
        kind, line = raw[at], bytearray(raw[at + 1 : at + 1 + row])
        for i in range(row):
            a, b, c = line[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            if kind == 4:
                pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                add = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
            else:
                add = (0, a, b, (a + b) // 2)[kind] if kind < 4 else 0
            line[i] = (line[i] + add) & 255
        out += line
        before = bytes(line)
    return bytes(out)


def png(samples: bytes, w: int, h: int, channels: int, alpha: bytes) -> bytes:
    """A PNG of 8-bit grey, RGB or CMYK samples; alpha counts where it has a value for every pixel."""
    px = np.frombuffer(samples, np.uint8)[: w * h * channels].reshape(h, w, channels)
    if channels == 4:
        white = 255 - px.astype(np.uint32)
        px = (white[..., :3] * white[..., 3:] // 255).astype(np.uint8)
    px = np.repeat(px, 3, 2) if channels == 1 else px
    over = np.frombuffer(alpha, np.uint8)[: w * h].reshape(h, w, 1) if len(alpha) >= w * h else np.full((h, w, 1), 255, np.uint8)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.concatenate([px, over], 2).reshape(h, w * 4)], 1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def clip_tables(runs: list[dict], clips: list[tuple | None], segments: list[tuple]) -> tuple[list[dict], list[set[int]]]:
    """Tables without ruled cells, from the clip rectangles around their texts: those that hold their run's centre and
    no smaller one, connected, at least four in two rows and 2 to 20 columns, with two rules across and one inside."""
    t = STYLE.tolerance
    cells: list[tuple] = []
    for r, c in zip(runs, clips, strict=True):
        if c and c[2] >= 8 and c[3] >= 6:
            b, box = r["bounds"], (c[0], c[1], c[0] + c[2], c[1] + c[3])
            x, y = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
            inside = box[0] - t <= x <= box[2] + t and box[1] - t <= y <= box[3] + t
            if inside and not any(all(abs(p - q) <= t for p, q in zip(box, o)) for o in cells):
                cells.append(box)
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    holds = lambda a, b: a[0] <= b[0] + t and a[1] <= b[1] + t and a[2] >= b[2] - t and a[3] >= b[3] - t
    cells = [c for c in cells if not any(o is not c and area(c) > 1.5 * area(o) and holds(c, o) for o in cells)]
    rules = [r for s in segments if (r := classify(s, t))]
    across, down = (merge_rules([r[1:] for r in rules if r[0] == k], STYLE) for k in "hv")
    tables, inside_ = [], []
    for group in connected(cells, t) if len(cells) <= MOST_CELLS else []:
        if len(group) < 4:
            continue
        table, own = build(group, runs, STYLE)
        b = table["bounds"]
        left, low, right, high = b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"]
        wide = max((c["column"] + c["col_span"] for r in table["rows"] for c in r["cells"]), default=0)
        ruled = sum(low - t <= h[0] <= high + t and h[1] <= left + t and h[2] >= right - t for h in across) >= 2
        parted = any(left + t < v[0] < right - t and min(v[2], high) - max(v[1], low) >= min(b["height"] / 4, 12) for v in down)
        if len(table["rows"]) >= 2 and 2 <= wide <= 20 and sum(len(r["cells"]) >= 2 for r in table["rows"]) >= 2 and ruled and parted:
            tables.append(table)
            inside_.append(own)
    return tables, inside_


def read_text(toks: list, fonts: dict[str, Font]) -> tuple[list[dict], list[tuple | None]]:
    """Runs in stream order and the clip of each. Advance is half the size per character; only clips that are empty hide text."""
    runs: list[dict] = []
    around: list[tuple | None] = []
    size, scale, font, color, x, y = 12.0, 1.0, Font(), "#000000", 0.0, 0.0
    clip: tuple | None = None
    pending: tuple | None = None
    clips: list = []
    inside = False

    def show(token: object) -> None:
        nonlocal x
        if not isinstance(token, str) or token[:1] not in "(<" or token == "<<":
            return
        text = font.decode(literal(token))
        if not text:
            return
        eff = size * scale
        w = len(text) * eff * 0.5
        b = rect(x, y - eff, w, eff)
        hidden = clip and (clip[2] < 1 or clip[3] < 1) and (x + w < clip[0] or x > clip[0] + clip[2] or y < clip[1] or y - eff > clip[1] + clip[3])
        if not hidden:
            runs.append(run(text, b, font.name, eff, color))
            around.append(clip)
        x += w

    for i, t in enumerate(toks):
        if not isinstance(t, str):
            continue
        arg = lambda k, i=i: _num(toks[i - k]) if i >= k else 0.0
        if t == "q":
            clips.append(clip)
        elif t == "Q":
            clip = clips.pop() if clips else clip
        elif t == "re":
            pending = (arg(4), arg(3), arg(2), arg(1))
        elif t in ("W", "W*") and pending:
            a, b, pending = clip, pending, None
            if a is None:
                clip = b
            else:
                left, low = max(a[0], b[0]), max(a[1], b[1])
                clip = (left, low, max(0.0, min(a[0] + a[2], b[0] + b[2]) - left), max(0.0, min(a[1] + a[3], b[1] + b[3]) - low))
        elif t == "BT":
            inside, x, y, scale = True, 0.0, 0.0, 1.0
        elif t == "ET":
            inside = False
        elif t in ("rg", "RG") and i >= 3:
            color = "#" + "".join(f"{int(arg(k) * 255) & 0xFF:02X}" for k in (3, 2, 1))
        elif t == "Tf" and i >= 2:
            size = arg(1)
            font = fonts.get(str(toks[i - 2]).lstrip("/"), Font())
        elif inside and t == "Tm" and i >= 6:
            scale = max(abs(arg(6)), abs(arg(3))) or 1.0
            x, y = arg(2), arg(1)
        elif inside and t in ("Td", "TD"):
            x, y = x + arg(2) * scale, y + arg(1) * scale
        elif inside and t == "Tj" and i:
            show(toks[i - 1])
        elif inside and t == "TJ" and i and isinstance(toks[i - 1], list):
            for part in toks[i - 1]:
                if part[:1] in "(<":
                    show(part)
                else:
                    x -= _num(part) / 1000 * size * scale
    return runs, around


def read_segments(toks: list) -> list[tuple[float, float, float, float]]:
    """Stroked straight lines, and the sides of filled rectangles up to 3 thick."""
    path: list[tuple] = []
    box: list[tuple] = []
    out: list[tuple] = []
    at = start = None
    for i, t in enumerate(toks):
        arg = lambda k, i=i: _num(toks[i - k]) if i >= k else 0.0
        if t == "m":
            at = start = (arg(2), arg(1))
        elif t == "l" and at:
            path.append((*at, arg(2), arg(1)))
            at = (arg(2), arg(1))
        elif t == "h" and at:
            path.append((*at, *start))
            at = start
        elif t == "re" and i >= 4:
            x, y, w, h = arg(4), arg(3), arg(2), arg(1)
            box = [(x, y, x + w, y), (x + w, y, x + w, y + h), (x + w, y + h, x, y + h), (x, y + h, x, y)]
            path += box
        elif t in ("S", "s", "B", "B*", "b", "b*", "f", "f*", "F", "n"):
            if t[0] in "SsBb":
                out += path
            elif t != "n" and box and min(abs(box[0][2] - box[0][0]), abs(box[1][3] - box[1][1])) <= 3:
                out += box
            path, box, at = [], [], None
    return out


def parse(data: bytes) -> dict:
    reader = Reader(data)
    pages: list[dict] = []
    for o in reader.pages():
        m = re.search(rb"/MediaBox\s*\[([^\]]+)\]", o.head)
        box = [_num(x.decode("latin-1")) for x in m[1].split()] if m else []
        pg = page(len(pages) + 1, box[2] - box[0] if len(box) >= 4 else 595, box[3] - box[1] if len(box) >= 4 else 842)
        res = reader.resources(o)
        toks = tokens(reader.content(o))
        pg["runs"], clips = read_text(toks, reader.fonts(res))
        segments = read_segments(toks)
        pg["tables"], inside = detect(pg["runs"], segments, STYLE)
        if not pg["tables"]:
            pg["tables"], inside = clip_tables(pg["runs"], clips, segments)
        pg["text"] = page_text(pg["runs"], pg["tables"], inside, lines_by_gap)
        pg["images"] = reader.images(res)
        pages.append(pg)
    if not pages:
        raise FormatError("no page objects")
    return document("pdf", "native", pages)
