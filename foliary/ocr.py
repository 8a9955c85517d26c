"""Character recognition of images: the steps around two models, which come from outside through a session.

A session has run(array) -> array; model files are run by onnxruntime where it is installed, pictures are decoded by
Pillow where it is. Without models the document path works as before and pages keep their text.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields, replace
from threading import Lock
from typing import Protocol

import numpy as np

from .formats.common import FormatError, rect, run
from .operators.normalize import page_text


class Session(Protocol):
    def run(self, tensor: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class Config:
    threshold: float = 0.3
    box_threshold: float = 0.6
    confidence: float = 0.5
    turn_threshold: float = 0.9
    longest_side: int = 960
    batch: int = 1
    dilate: bool = False
    native_characters: int = 16
    workers: int = 1
    detector: str = ""
    recognizer: str = ""
    characters: str = ""
    classifier: str = ""  # without one no crop is turned

    def filled(self) -> Config:
        """Numbers that are not above 0 take their default."""
        plain = {f.name: f.default for f in fields(self) if not isinstance(f.default, (str, bool))}
        return replace(self, **{k: v for k, v in plain.items() if getattr(self, k) <= 0})

    def check(self) -> None:
        """Every model that is needed must be a file; anything else is an error that names it."""
        for name in ("detector", "recognizer", "characters", *(("classifier",) if self.classifier else ())):
            path = getattr(self, name)
            if not os.path.isfile(path):
                raise FileNotFoundError(f"recognition needs a {name} file: {path or 'none given'}")


class ModelFile:
    """A session of onnxruntime."""

    def __init__(self, path: str):
        import onnxruntime

        self.session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        self.input = self.session.get_inputs()[0].name

    def run(self, tensor: np.ndarray) -> np.ndarray:
        return self.session.run(None, {self.input: tensor})[0]


_engines: dict[Config, Engine] = {}
_lock = Lock()


def engine(config: Config) -> Engine:
    """The engine of a configuration, loaded once per process."""
    config = config.filled()
    config.check()
    with _lock:
        if config not in _engines:
            with open(config.characters, encoding="utf-8") as f:
                characters = f.read().splitlines()
            classifier = ModelFile(config.classifier) if config.classifier else None
            _engines[config] = Engine(ModelFile(config.detector), ModelFile(config.recognizer), characters, classifier, config)
        return _engines[config]


#: Pixels of the largest picture that is decoded.
MOST_PIXELS = 200_000_000


def decode_image(data: bytes) -> np.ndarray:
    """RGB pixels of an encoded picture; transparent parts are white."""
    from PIL import Image

    im = Image.open(io.BytesIO(data))
    if im.width * im.height > MOST_PIXELS or not im.width * im.height:
        raise FormatError(f"picture of {im.width} x {im.height} pixels")
    im = im.convert("RGBA")
    return np.asarray(Image.alpha_composite(Image.new("RGBA", im.size, "white"), im).convert("RGB"))


@dataclass
class Result:
    text: str
    lines: list[Line]


def recognize_image(data: bytes, engine: Engine, decode: Callable[[bytes], np.ndarray] = decode_image) -> Result:
    """Lines of an encoded picture in reading order, and their text."""
    lines = engine.lines(decode(data))
    return Result("\n".join(x.text for x in lines), lines)


def image_bytes_to_text(data: bytes, engine: Engine, decode: Callable[[bytes], np.ndarray] = decode_image) -> str:
    """Text of an encoded picture, normalized as page text is."""
    return page_text(recognize_image(data, engine, decode).text)


def image_to_text(path: str, engine: Engine, decode: Callable[[bytes], np.ndarray] = decode_image) -> str:
    with open(path, "rb") as f:
        return image_bytes_to_text(f.read(), engine, decode)


@dataclass
class Box:
    x0: int
    y0: int
    x1: int
    y1: int
    score: float = 0.0


@dataclass
class Line:
    text: str
    confidence: float
    bounds: dict = field(default_factory=rect)
    color: str = "#000000"


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned; float32."""
    h, w = image.shape[:2]
    ys, xs = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    im = image.astype(np.float32)
    top, low = im[y0][:, x0] * (1 - fx) + im[y0][:, x1] * fx, im[y1][:, x0] * (1 - fx) + im[y1][:, x1] * fx
    return (top * (1 - fy) + low * fy).astype(np.float32)


def upright(crop: np.ndarray) -> np.ndarray:
    """Crops much taller than wide are turned by a quarter."""
    return np.rot90(crop) if crop.shape[0] * 2 > crop.shape[1] * 3 else crop


def detector_input(image: np.ndarray, longest: int) -> np.ndarray:
    """(1, 3, h, w) in BGR, sides multiples of 32, normalized by the usual means and deviations."""
    h, w = image.shape[:2]
    scale = min(1.0, longest / max(h, w))
    side = lambda n: max(32, int(round(n * scale / 32)) * 32)
    x = resize(image, side(h), side(w))[..., ::-1] / 255
    x = (x - np.array([0.485, 0.456, 0.406], np.float32)) / np.array([0.229, 0.224, 0.225], np.float32)
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None], np.float32)


def dilated(mask: np.ndarray) -> np.ndarray:
    out = mask.copy()
    out[1:] |= mask[:-1]
    out[:, 1:] |= mask[:, :-1]
    out[1:, 1:] |= mask[:-1, :-1]
    return out


def boxes(scores: np.ndarray, config: Config, height: int, width: int) -> list[Box]:
    """Text boxes of a probability map: 8-connected regions of at least 3 x 3 and 9 pixels with a mean above the box
    threshold, widened in proportion to area over perimeter, scaled to the image."""
    mask = scores > config.threshold
    mask = dilated(mask) if config.dilate else mask
    seen, out = np.zeros_like(mask), []
    h, w = mask.shape
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, region = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            region.append((a, b))
            for i in range(max(0, a - 1), min(h, a + 2)):
                for j in range(max(0, b - 1), min(w, b + 2)):
                    if mask[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        stack.append((i, j))
        r = np.array(region)
        (y0, x0), (y1, x1) = r.min(0), r.max(0) + 1
        if y1 - y0 < 3 or x1 - x0 < 3 or len(r) < 9:
            continue
        score = float(scores[r[:, 0], r[:, 1]].mean())
        if score < config.box_threshold:
            continue
        grow = int(np.ceil((y1 - y0) * (x1 - x0) * 1.5 / (2 * (y1 - y0 + x1 - x0))))
        sx, sy = width / w, height / h
        out.append(Box(int(max(0, x0 - grow) * sx), int(max(0, y0 - grow) * sy), int(min(w, x1 + grow) * sx), int(min(h, y1 + grow) * sy), score))
    return reading_order(out)


def reading_order(found: Sequence[Box], band: int = 10) -> list[Box]:
    """By bands whose tops lie within `band` of the first, each from left to right."""
    out: list[list[Box]] = []
    for b in sorted(found, key=lambda b: (b.y0, b.x0)):
        if out and abs(b.y0 - out[-1][0].y0) < band:
            out[-1].append(b)
        else:
            out.append([b])
    return [b for row in out for b in sorted(row, key=lambda b: b.x0)]


def recognizer_input(crops: Sequence[np.ndarray], height: int = 48, least: int = 320, most: int = 2048) -> np.ndarray:
    """(n, 3, height, w), w from the widest crop, values in -1..1, short crops padded with zeros."""
    ratio = max(c.shape[1] / c.shape[0] for c in crops)
    width = min(most, max(least, int(np.ceil(height * ratio))))
    out = np.zeros((len(crops), 3, height, width), np.float32)
    for k, c in enumerate(crops):
        w = max(1, min(width, int(np.ceil(height * c.shape[1] / c.shape[0]))))
        out[k, :, :, :w] = (resize(c, height, w)[..., ::-1] / 127.5 - 1).transpose(2, 0, 1)
    return out


def decode(steps: np.ndarray, characters: Sequence[str]) -> tuple[str, float]:
    """Text and mean confidence of (t, classes) scores: class 0 is the blank, the last one the space."""
    if steps.shape[1] != len(characters) + 2:
        raise ValueError(f"{steps.shape[1]} classes for {len(characters)} characters")
    best = steps.argmax(1)
    keep = (best != 0) & np.concatenate([[True], best[1:] != best[:-1]])
    table = ["", *characters, " "]
    return "".join(table[i] for i in best[keep]), float(steps.max(1)[keep].mean()) if keep.any() else 0.0


def turned(outputs: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each crop stands on its head; raw outputs are turned into probabilities first."""
    p = np.asarray(outputs, float)
    if (p < 0).any() or not np.allclose(p.sum(1), 1, atol=1e-3):
        e = np.exp(p - p.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
    return (p.argmax(1) == 1) & (p[:, 1] >= threshold)


def text_color(crop: np.ndarray) -> str:
    """Mean colour of the darker half of the pixels."""
    px = crop.reshape(-1, 3).astype(float)
    if not len(px):
        return "#000000"
    grey = np.clip(px @ np.array([0.299, 0.587, 0.114]), 0, 255).astype(int)
    counts = np.bincount(grey, minlength=256)
    cut = int(np.searchsorted(np.cumsum(counts), len(px) / 2))
    r, g, b = px[grey <= cut].mean(0)
    return f"#{int(r):02X}{int(g):02X}{int(b):02X}"


class Engine:
    """Detection, optional turning, recognition in batches of like aspect."""

    def __init__(self, detector: Session, recognizer: Session, characters: Sequence[str], classifier: Session | None = None, config: Config = Config()):
        self.detector, self.recognizer, self.classifier, self.characters, self.config = detector, recognizer, classifier, list(characters), config

    def lines(self, image: np.ndarray) -> list[Line]:
        h, w = image.shape[:2]
        scores = np.asarray(self.detector.run(detector_input(image, self.config.longest_side))).reshape(-1)
        x = detector_input(image, self.config.longest_side).shape
        found = boxes(scores.reshape(x[2], x[3]), self.config, h, w)
        crops = [upright(image[b.y0 : b.y1, b.x0 : b.x1]) for b in found]
        pairs = [(b, c) for b, c in zip(found, crops, strict=True) if c.size]
        if self.classifier and pairs:
            flips = turned(self.classifier.run(recognizer_input([c for _, c in pairs], 48, 192, 192)), self.config.turn_threshold)
            pairs = [(b, np.rot90(c, 2) if f else c) for (b, c), f in zip(pairs, flips, strict=True)]
        order = np.argsort([c.shape[1] / c.shape[0] for _, c in pairs], kind="stable")
        got: dict[int, tuple[str, float]] = {}
        for k in range(0, len(order), max(1, self.config.batch)):
            part = order[k : k + max(1, self.config.batch)]
            for i, steps in zip(part, self.recognizer.run(recognizer_input([pairs[i][1] for i in part])), strict=True):
                got[int(i)] = decode(np.asarray(steps), self.characters)
        out = [Line(t, c, rect(b.x0, b.y0, b.x1 - b.x0, b.y1 - b.y0), text_color(crop)) for i, (b, crop) in enumerate(pairs) for t, c in [got[i]]]
        return [x for x in out if x.text.strip() and x.confidence >= self.config.confidence]


def candidates(images: Sequence[dict]) -> list[dict]:
    """Images worth recognition: at least 64 x 32 with data; only the largest where it is at least 512 x 512."""
    ok = [im for im in images if im["width"] >= 64 and im["height"] >= 32 and im["data"]]
    top = max(ok, key=lambda im: im["width"] * im["height"], default=None)
    return [top] if top and top["width"] >= 512 and top["height"] >= 512 else ok


def recognizer(engine: Engine, decode_image: Callable[[bytes], np.ndarray] = decode_image) -> Callable[[dict], None]:
    """For extract(recognize=...): adds lines to pages with too little native text, placed on the page by its size; as
    many pages at once as the configuration has workers."""

    def apply(doc: dict) -> None:
        if engine.config.workers > 1:
            with ThreadPoolExecutor(engine.config.workers) as pool:
                list(pool.map(one, doc["pages"]))
        else:
            for p in doc["pages"]:
                one(p)

    def one(p: dict) -> None:
        if sum(c.isalpha() or c.isnumeric() for c in p["text"]) >= engine.config.native_characters:
            return
        for im in candidates(p["images"]):
            pixels = decode_image(im["data"])
            sx, sy = (p["width"] / pixels.shape[1] if p["width"] else 1.0), (p["height"] / pixels.shape[0] if p["height"] else 1.0)
            for x in engine.lines(pixels):
                b = x.bounds
                p["text"] += ("\n" if p["text"] else "") + x.text
                p["runs"].append(run(x.text, rect(b["x"] * sx, b["y"] * sy, b["width"] * sx, b["height"] * sy), "OCR", b["height"] * sy * 0.75, x.color))

    return apply
