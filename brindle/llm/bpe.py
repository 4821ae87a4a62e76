"""Byte-pair encoding as a lazily determinised finite-state transducer, and its streaming inverse.

Merging pairs by rank gives each string one encoding, and an encoding is right exactly when each token
encodes itself and each two neighbours do: no merge across their border would have come first. So the
encoding of a prefix is that of a shorter prefix plus one token, and a machine reading bytes need only
remember, for every start at which some vocabulary token is still under way, how the text before that
start is encoded. What all of these have in common is final and is emitted; the rest is shorter than the
longest token, which bounds the lookahead. Such sets of open starts, without what has been emitted, are
the transducer's states. They are found when an input first reaches them and kept.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

#: The split of text before merging that belongs to these rank files: fixed value of the public vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds of what one encoder remembers: states of the machine, and encoded pieces with their longest length.
STATES, PIECES, PIECE_BYTES = 1 << 17, 1 << 17, 64
_NEVER = 1 << 60
#: What an id without a token decodes to.
_UNKNOWN = "\ufffd".encode()


def tokenizer_dir() -> str:
    return os.environ.get("BRINDLE_TOKENIZERS", "/opt/tokenizers")


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 stands for itself, other bytes for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary with its merges: which tokens and neighbours can stand in an encoding."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """``tokens``: id to bytes. ``merges``: (left id, right id, merged id) by rank."""
        self.tokens = tokens
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b, m) in enumerate(merges):
            self.parts.setdefault(m, (a, b, r))
        self._sound: dict[int, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._rims: tuple[dict, dict] = ({}, {})
        #: A trie of the tokens that encode themselves: per node the following nodes by byte, and the token that ends there.
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for t, text in tokens.items():
            at = 0
            for byte in text:
                to = self.next[at].get(byte)
                if to is None:
                    to = self.next[at][byte] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                at = to
            self.ends[at] = t

    @classmethod
    def load(cls, path: str) -> Merges:
        """From a tokenizer JSON file of byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_chars()
        ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        used = {c for c in ids if len(c) == 1} | {a + b for a, b in merges}
        tokens = {ids[s]: bytes(byte[c] for c in s) for s in used}
        return cls(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in merges])

    def _rim(self, t: int, side: int) -> list[tuple[int, int]]:
        """Along one side of a token's merge tree, each part with the rank at which it is merged into a larger one."""
        known = self._rims[side].get(t)
        if known is None:
            known, at, until = [], t, _NEVER
            while True:
                known.append((at, until))
                if at not in self.parts:
                    break
                until = self.parts[at][2]
                at = self.parts[at][side]
            self._rims[side][t] = known
        return known

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether no merge crosses the border of two neighbours before rank ``until``."""
        for a, a_gone in self._rim(left, 1):
            for b, b_gone in self._rim(right, 0):
                r = self.rank.get((a, b))
                # of equal ranks the leftmost merges first: the border comes after the left part's own merge, before the right's
                if r is not None and r < until and r < min(a_gone, until) and r <= min(b_gone, until):
                    return False
        return True

    def sound(self, t: int) -> bool:
        """Whether a token's bytes are encoded as this token."""
        known = self._sound.get(t)
        if known is None:
            if t not in self.parts:
                known = True
            else:
                a, b, r = self.parts[t]
                known = self.sound(a) and self.sound(b) and self._apart(a, b, r)
            self._sound[t] = known
        return known

    def adjoin(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 1 << 20:
                self._pairs.clear()
            known = self._pairs[left, right] = self._apart(left, right, _NEVER)
        return known


class Encoder:
    """Text to token ids. One per Python process is enough: ``encoder(path)``."""

    def __init__(self, merges: Merges, split: str = SPLIT):
        import regex

        self.merges = merges
        self.pieces = regex.compile(split).findall
        self._known: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: the last emitted token (None at the start) and the open starts as (trie node, tokens before it that aren't emitted)
        start = (None, ((0, ()),))
        self._ids = {start: 0}
        self._states = [start]
        self._steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        m = self.merges
        last, starts = self._states[state]
        going: list[tuple[int, tuple[int, ...]]] = []
        whole: tuple[int, ...] | None = None
        for node, before in starts:
            to = m.next[node].get(byte)
            if to is None:
                continue
            t = m.ends[to]
            if t is not None and whole is None and m.sound(t):
                left = before[-1] if before else last
                if left is None or m.adjoin(left, t):
                    whole = (*before, t)
            if m.next[to]:
                going.append((to, before))
        if whole is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        going.append((0, whole))
        sure = 0
        first = going[0][1]
        while all(len(b) > sure and b[sure] == first[sure] for _, b in going) if len(first) > sure else False:
            sure += 1
        out = whole[:sure]
        key = (out[-1] if out else last, tuple((n, b[sure:]) for n, b in going))
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
            self._steps.append({})
        self._steps[state][byte] = (to, out)
        return to, out

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one piece's bytes, each as soon as it is sure."""
        if len(self._states) > STATES:
            self._reset()
        state = 0
        for byte in data:
            found = self._steps[state].get(byte)
            if found is None:
                if len(self._states) > STATES:  # in one very long piece, too
                    state = self._again(state)
                found = self._step(state, byte)
            state = found[0]
            yield from found[1]
        yield from self._states[state][1][-1][1]

    def _again(self, state: int) -> int:
        """Forgets all states but one, which gets a new number."""
        key = self._states[state]
        self._reset()
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
            self._steps.append({})
        return to

    def piece(self, text: str) -> tuple[int, ...]:
        ids = tuple(self.stream(text.encode("utf-8", "surrogatepass")))
        if len(text) <= PIECE_BYTES:
            if len(self._known) >= PIECES:
                self._known.clear()
            self._known[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, whole; of None and '' none. What looks like a special token is plain text."""
        ids: list[int] = []
        if text:
            known, piece = self._known.get, self.piece
            for p in self.pieces(text):
                ids.extend(known(p) or piece(p))
        return ids


class Utf8Machine:
    """Where characters end in a byte stream: the state is the number of bytes still to come and the range the next one must be in."""

    def __init__(self) -> None:
        self.left, self.low, self.high = 0, 0x80, 0xBF

    def step(self, byte: int) -> bool | None:
        """True: a character ended here; None: it goes on; False: this byte can't stand here (the machine is then back at the start)."""
        if self.left:
            ok = self.low <= byte <= self.high
            self.low, self.high = 0x80, 0xBF
            self.left = self.left - 1 if ok else 0
            return (True if not self.left else None) if ok else False
        if byte < 0x80:
            return True
        if not 0xC2 <= byte <= 0xF4:
            return False
        self.left = 1 + (byte >= 0xE0) + (byte >= 0xF0)
        # no overlong forms, no surrogates, nothing above U+10FFFF
        self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
        self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        return None


class StreamDecoder:
    """Token ids back to text, part by part; a character whose bytes are spread over tokens comes out when its last byte has come."""

    def __init__(self, tokens: dict[int, bytes]):
        """An id that has no token gives U+FFFD."""
        self.tokens = tokens
        self.machine = Utf8Machine()
        self.open = b""

    def feed(self, ids: Iterable[int]) -> str:
        """The text that is complete with these ids; bytes that form no character become U+FFFD."""
        ids = list(ids)
        try:
            data = self.open + b"".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            data = self.open + b"".join([self.tokens.get(i, _UNKNOWN) for i in ids])
        if data.isascii():
            self.open = b""
            return data.decode("ascii")
        # only the last three bytes can be of an open character: find its first byte and let the machine judge it
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:
                self.machine = Utf8Machine()
                seen = [self.machine.step(b) for b in data[-back:]]
                if seen[-1] is None and False not in seen:
                    cut = len(data) - back
                break
            if data[-back] < 0x80:
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file, made on first use. A bare name is that of a file sent along with the job."""
    if path not in _ENCODERS:
        from pyspark import SparkFiles

        _ENCODERS[path] = Encoder(Merges.load(path if "/" in path else SparkFiles.get(path)))
    return _ENCODERS[path]
