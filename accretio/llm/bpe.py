"""Byte-level BPE as a finite-state transducer, and streaming decode.

Encoding. The greedy merge of a pretoken has a local description: a token
sequence is what the merges give if and only if every neighbouring pair of it is
what the merges give for that pair's own bytes. The encoding of each prefix
therefore ends in exactly one token, and the tokens that can still change are
those after the earliest position from which some vocabulary entry could reach
beyond the bytes read so far. ``BpeTransducer`` keeps only these open positions
as its state, builds a state when it is first met (lazy determinisation), and
emits the tokens that all open positions agree on. Lookahead is bounded by the
longest vocabulary entry.

Decoding. ``Utf8Machine`` takes tokens or bytes in pieces of any size and holds
back at most three bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import public_tokenizers
import regex

#: Memoised words, states and pairs are dropped when a table reaches this size,
#: so that a worker's memory is bounded whatever the text.
CACHE = 200_000

#: A transition is built when a word meets it after so many others did.
OFTEN = 12

#: For texts of these characters the standard ``re`` engine splits as PATTERN
#: does: ASCII but for the separators 1C-1F, and the Latin letters.
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ſ]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_FULL = regex.compile(public_tokenizers.PATTERN)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a ``.tiktoken`` rank file or a ``.json`` vocabulary.

    A json vocabulary writes each byte as one printable character: printable
    Latin-1 bytes as themselves, the others in order from U+0100.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"] for t in whole["added_tokens"]}
        return {bytes(byte_of[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """The merges as defined: join the neighbouring pair of lowest rank until none is left."""
    none = len(ranks)
    parts = [data[i : i + 1] for i in range(len(data))]
    joined = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while joined and (best := min(joined)) < none:
        i = joined.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joined[i]
        if i < len(joined):
            joined[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            joined[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


class BpeTransducer:
    """Bytes in, token ids out; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for entry, rank in ranks.items():
            node = 0
            for byte in entry:
                step = self.children[node].get(byte)
                if step is None:
                    step = len(self.children)
                    self.children[node][byte] = step
                    self.children.append({})
                    self.token.append(-1)
                node = step
            self.token[node] = rank
        #: for each token the longest token that is a proper prefix of it, else -1
        self.shorter = [-1] * (max(ranks.values()) + 1)
        self.lengths = [0] * len(self.shorter)
        for entry, rank in ranks.items():
            self.lengths[rank] = len(entry)
            cut = next((ranks[entry[:n]] for n in range(len(entry) - 1, 0, -1) if entry[:n] in ranks), -1)
            self.shorter[rank] = cut
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        #: a state: (last emitted token, ((trie node, tokens since), ...)) by open position
        self.states: list[tuple] = [(-1, ((0, ()),))]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        #: by state and byte: (next state, tokens emitted), or how often it was met
        self.steps: list[dict[int, tuple[int, tuple[int, ...]] | int]] = [{}]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * CACHE:
                self.pairs.clear()
            known = self.pairs[key] = merged(self.ranks, self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Build the transition: follow every open position, keep those that stay open."""
        last, opened = self.states[number]
        still, ended = [], None
        for node, since in opened:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if ended is None and token >= 0:
                before = since[-1] if since else last
                if before < 0 or self._fits(before, token):
                    ended = (*since, token)
            if self.children[child]:
                still.append((child, since))
        assert ended is not None, "every byte has a token of its own"
        still.append((0, ended))
        shared = 0
        least = min(len(since) for _, since in still)
        while shared < least and all(since[shared] == ended[shared] for _, since in still):
            shared += 1
        if shared:
            last = ended[shared - 1]
        state = (last, tuple((node, since[shared:]) for node, since in still))
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        made = self.steps[number][byte] = (to, ended[:shared])
        return made

    def _follow(self, last: int, data: bytes) -> list[int]:
        """The same machine before determinisation: from the emitted token ``last``
        on, take the longest token that fits its left neighbour, and step back
        from positions that no token leads on from."""
        children, token, lengths, shorter, pairs = self.children, self.token, self.lengths, self.shorter, self.pairs
        out: list[int] = []
        dead: set[int] = set()
        at, end, before = 0, len(data), last
        while at < end:
            node, tried = 0, -1
            for byte in data[at:]:
                node = children[node].get(byte)
                if node is None:
                    break
                if token[node] >= 0:
                    tried = token[node]
            while True:
                while tried >= 0:
                    to = at + lengths[tried]
                    if before < 0 or pairs.get(before << 20 | tried) or self._fits(before, tried):
                        if to not in dead:
                            break
                    tried = shorter[tried]
                if tried >= 0:
                    break
                dead.add(at)  # step back: the token before must be a shorter one
                gone = out.pop()
                at -= lengths[gone]
                before = out[-1] if out else last
                tried = shorter[gone]
            out.append(tried)
            at, before = to, tried
        return out

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pretoken.

        A transition that is rarely met is only counted, and the rest of a short
        pretoken followed undetermined; met OFTEN, it is built.
        """
        if len(self.states) >= CACHE:
            self._forget()
        out: list[int] = []
        state, steps, short = 0, self.steps, len(data) <= 64
        for byte in data:
            made = steps[state].get(byte, 0)
            if made.__class__ is int:
                if short and made < OFTEN:
                    steps[state][byte] = made + 1
                    done = sum([self.lengths[t] for t in out])
                    return out + self._follow(self.states[state][0], data[done:])
                made = self._step(state, byte)
                if len(self.states) >= 4 * CACHE:  # one very long, odd pretoken: keep only where it stands
                    here = self.states[made[0]]
                    out.extend(made[1])
                    self._forget()
                    steps = self.steps
                    state = self.numbers.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                        steps.append({})
                    continue
            state, ready = made
            if ready:
                out.extend(ready)
        out.extend(self.states[state][1][-1][1])
        return out


class Encoder:
    """Whole texts to ids: split, then the transducer, with a bounded table of words met.

    special: a string that stands for one id of its own instead of ordinary text.
    """

    def __init__(self, path: str, special: tuple[str, int] | None = None):
        self.transducer = BpeTransducer(read_ranks(path))
        self.special = special
        #: words met, and those of them that were met again while ``young`` filled
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _words(self, words: Iterable[str]) -> bytes:
        old, young, parts = self.old, self.young, []
        for w in words:
            p = old.get(w)
            if p is None:
                p = young.get(w)
                if p is None:
                    ids = self.transducer.encode(w.encode())
                    p = struct.pack(f"<{len(ids)}I", *ids)
                    if len(w) <= 64:
                        if len(young) >= CACHE:
                            young.clear()
                        young[w] = p
                else:
                    if len(old) >= CACHE:
                        old.clear()
                    old[w] = p
            parts.append(p)
        return b"".join(parts)

    def packed_ids(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if self.special and self.special[0] in text:
            mark = struct.pack("<I", self.special[1])
            return mark.join(self._words(pretokens(part)) for part in text.split(self.special[0]))
        return self._words(pretokens(text))

    def decode_stream(self, ids: Iterable[int], piece: int = 8192) -> Iterable[str]:
        """Text of ``ids`` in order, a piece at a time."""
        machine, bytes_of, ids = Utf8Machine(), self.transducer.bytes_of.__getitem__, iter(ids)
        while part := b"".join(map(bytes_of, islice(ids, piece))):
            yield machine.feed(part)
        yield machine.end()


def pretokens(text: str) -> list[str]:
    """The matches of PATTERN, in order; together they are the whole text."""
    if _UNUSUAL.search(text) is None:
        return _PLAIN.findall(text)
    return _FULL.findall(text)


class Utf8Machine:
    """UTF-8 decoding of bytes that come in pieces.

    The state is how many continuation bytes are still missing; the bytes of an
    unfinished character wait for the next piece. Bytes that can't be UTF-8 give
    U+FFFD.
    """

    def __init__(self) -> None:
        self.waiting = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF5 else 1
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        hold = self.unfinished(data)
        self.waiting = data[len(data) - hold :] if hold else b""
        return (data[: len(data) - hold] if hold else data).decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str, special: tuple[str, int] | None = None) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path, special)
