"""Byte-level BPE as a lazily determinised finite-state transducer.

A merge table fixes which pairs of neighbouring tokens can stand next to each other in an encoding, and of every
prefix of a text exactly one last token is possible. The subset machine below reads one byte at a time; its state is
the set of start positions that a longer token could still cover, each with its last token and the output that has not
been agreed on yet. Output shared by all live positions is emitted at once, so the lookahead is bounded by the longest
token. States and transitions are built when first needed and are shared by all texts of a Python worker.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

import regex

#: Fixed by the vocabulary files: how a text is cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabulary files: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """encode(text) -> ids; decode(ids) -> text. Memory is bounded: both caches are dropped when they are full."""

    MAX_STATES = 300_000
    MAX_PIECES = 300_000

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocab, self.bytes_of = vocab, {i: b for b, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.order = {i: -1 for b, i in vocab.items() if len(b) == 1}
        for k, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = k
            if z not in self.halves and len(self.bytes_of[z]) > 1:
                self.halves[z], self.order[z] = (x, y), k
        # trie of the usable tokens: child[node << 8 | byte], the token at each node (-1: none), whether it goes on
        self.child: dict[int, int] = {}
        self.token, self.goes_on = [-1], [True]
        for b, i in vocab.items():
            if i in self.order:
                node = 0
                for byte in b:
                    self.goes_on[node] = True
                    to = self.child.setdefault(node << 8 | byte, len(self.token))
                    if to == len(self.token):
                        self.token.append(-1)
                        self.goes_on.append(False)
                    node = to
                self.token[node] = i
        # bit f of joins[t]: some merge of t or of a right part of t with a token that begins with byte f
        self.joins: dict[int, int] = dict.fromkeys(self.order, 0)
        for x, y in self.rank:
            self.joins[x] = self.joins.get(x, 0) | 1 << self.bytes_of[y][0]
        for t in sorted(self.halves, key=lambda t: len(self.bytes_of[t])):
            self.joins[t] |= self.joins[self.halves[t][1]]
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    @classmethod
    def from_json(cls, path: str) -> Transducer:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        vocab = {raw(s): i for s, i in model["vocab"].items() if all(c in back for c in s)}
        merges = [tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        return cls(vocab, merges)

    def _reset(self) -> None:
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        start = ((0, -1, ()),)
        self.states, self.number, self.final, self.moves = [start], {start: 0}, [()], {}

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay as they are side by side: undo merges from the latest to the earliest and see
        that no earlier merge would have joined across the border."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        order, halves, rank = self.order, self.halves, self.rank
        x, y, limit = a, b, len(rank)  # limit: merges before it had their turn while x and y stood here
        while True:
            k = rank.get((x, y))
            if k is not None and k < limit:
                return False
            # take back the later one of the two merges; of equal ones the left was done first
            left_at, right_at = order[x], order[y]
            if left_at < 0 and right_at < 0:
                return True
            if left_at > right_at:
                limit, x = left_at, halves[x][1]
            else:
                limit, y = right_at + 1, halves[y][0]

    def _step(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        kept, new, agree = [], None, True
        for node, last, rest in self.states[s]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            if not node and last >= 0 and not self.joins[last] >> byte & 1:
                last = -1  # it can meet no merge with what follows, so it makes no difference: fewer states
            if new is None and (t := self.token[to]) >= 0 and (last < 0 or self.fits(last, t)):
                new = (0, t, (*rest, t))
            if self.goes_on[to]:
                kept.append((to, last, rest))
                agree = agree and bool(rest)
        if new is None:
            raise ValueError("the vocabulary lacks a byte")
        kept.append(new)
        out: tuple[int, ...] = ()
        if agree:
            n, first = 0, kept[0][2]
            while all(len(e[2]) > n and e[2][n] == first[n] for e in kept):
                n += 1
            if n:
                out = first[:n]
                kept = [(node, last, rest[n:]) for node, last, rest in kept]
        live = tuple(kept)
        to = self.number.get(live)
        if to is None:
            to = self.number[live] = len(self.states)
            self.states.append(live)
            self.final.append(live[-1][2])
        self.moves[s << 8 | byte] = (to, out)
        return to, out

    def piece(self, text: str) -> tuple[int, ...]:
        s, out, moves = 0, [], self.moves
        for byte in text.encode("utf-8", "surrogatepass"):
            move = moves.get(s << 8 | byte)
            if move is None:
                move = self._step(s, byte)
            s = move[0]
            if move[1]:
                out += move[1]
        out += self.final[s]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; [] of null and of the empty text. Marker-like strings are plain text."""
        if not text:
            return []
        out: list[int] = []
        if "  " in text:
            for w in self.split(text):
                out += self.pieces.get(w) or self._piece(w)
            return out
        # No match of the pattern crosses into a single space, so a text without double spaces is cut there first.
        # The keys of chunks lack the space that they begin with; the first chunk has none.
        head, _, rest = text.partition(" ")
        for w in self.split(head):
            out += self.pieces.get(w) or self._piece(w)
        if _:
            chunks = self.chunks
            for c in rest.split(" "):
                out += chunks.get(c) or self._chunk(c)
        return out

    def _piece(self, w: str) -> tuple[int, ...]:
        if len(self.pieces) >= self.MAX_PIECES or len(self.states) >= self.MAX_STATES:
            self._reset()
        ids = self.piece(w)
        if len(w) <= 64:
            self.pieces[w] = ids
        return ids

    def _chunk(self, c: str) -> tuple[int, ...]:
        ids = tuple(i for w in self.split(" " + c) for i in (self.pieces.get(w) or self._piece(w)))
        if len(c) <= 32:
            if len(self.chunks) >= self.MAX_PIECES:
                self.chunks.clear()
            self.chunks[c] = ids
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))

    def stream(self, ids: Iterable[int], at_a_time: int = 512) -> Iterator[str]:
        """Text as it becomes known: an incremental UTF-8 machine holds back the bytes of an unfinished character."""
        machine, waiting = codecs.getincrementaldecoder("utf-8")("replace"), []
        for i in ids:
            waiting.append(self.bytes_of[i])
            if len(waiting) == at_a_time:
                yield machine.decode(b"".join(waiting))
                waiting.clear()
        yield machine.decode(b"".join(waiting), True)


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One machine for each vocabulary and Python worker."""
    if path not in _loaded:
        _loaded[path] = Transducer.from_json(path)
    return _loaded[path]
