"""Token ids of whole texts from public byte-level vocabularies, a block of texts at a time."""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
import tiktoken

from tradewind.llm.words import IS_SPACE, mixed, span_hashes

# How public byte-level vocabularies of this kind part a text before they merge bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces of text that each of a worker's two tables of known ids holds.
REMEMBERED = 300_000

# UTF-8 of white space beyond ASCII.
_OTHER_SPACE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)


# Bytes of a piece that are compared as they are, and masks for the first 0 to 8 of eight bytes.
WIDE = 16
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def vocabulary_path(name: str) -> str:
    """The file of a public vocabulary that is installed on every executor, or ``name`` itself if
    it is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str) -> tiktoken.Encoding:
    with open(vocabulary_path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _contents(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each piece: its bytes themselves up to WIDE of them, else two hashes."""
    padded = np.zeros(len(buf) + WIDE, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 8,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    low = eight[starts] & _FIRST[np.minimum(lengths, 8)]
    high = eight[starts + 8 * (lengths > 8)] & _FIRST[np.clip(lengths - 8, 0, 8)]
    long = np.flatnonzero(lengths > WIDE)
    if len(long):
        after = np.cumsum(lengths[long])
        of_long = buf[_bytes_of(starts[long], lengths[long])]
        low[long] = span_hashes(of_long, after - lengths[long], after)
        high[long] = span_hashes(of_long, after - lengths[long], after, seed=1)
    return low, high


def _bytes_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of the bytes of spans."""
    places = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return places + np.arange(len(places))


class Encoder:
    """Encodes blocks. A text is cut before each run of white space that follows something else:
    no token goes over such a place, so each piece has the same ids wherever it stands. Pieces
    not seen before are encoded together, the others are looked up by a hash, and compared with the
    bytes that their ids stand for. Texts with white space beyond ASCII are one piece."""

    def __init__(self, name: str) -> None:
        self.encoding = load(name)
        self.end = self.encoding.n_vocab
        self.kind = np.uint16 if self.end < 1 << 16 else np.uint32
        tokens = [b""] * self.end
        for token, rank in self.encoding._mergeable_ranks.items():
            tokens[rank] = token
        self.bytes_of = np.array([len(token) for token in tokens], np.int64)
        self.token_at = np.cumsum(self.bytes_of) - self.bytes_of
        self.all_tokens = np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.young, self.old = Known(self.kind), Known(self.kind)

    def pieces(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        space = IS_SPACE[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        for found in _OTHER_SPACE.finditer(buf):
            row = np.searchsorted(bounds, found.start(), "right") - 1
            cut[bounds[row] : bounds[row + 1]] = False
        cut[bounds] = True
        return np.flatnonzero(cut[:-1])

    def _fresh(self, data: bytes, starts: np.ndarray, ends: np.ndarray):
        """Ids of pieces, where they begin and how many: those that begin with white space are
        encoded as one text, whose ids are dealt out by their bytes, the first pieces of texts
        one by one."""
        encode = self.encoding.encode_ordinary
        first, count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        led = IS_SPACE[np.frombuffer(data, np.uint8)[starts]]
        text = b"".join([data[a:b] for a, b in zip(starts[led].tolist(), ends[led].tolist(), strict=True)])
        ids = np.array(encode(text.decode()), np.int64)
        sizes = np.cumsum(ends[led] - starts[led])
        after = np.searchsorted(np.cumsum(self.bytes_of[ids]), sizes, "left") + 1
        if len(after):
            count[led] = np.diff(np.concatenate([[0], after]))
            first[led] = after - count[led]
        found, total = [ids], len(ids)
        for at in np.flatnonzero(~led).tolist():
            ids = np.array(encode(data[starts[at] : ends[at]].decode()), np.int64)
            first[at], count[at] = total, len(ids)
            found.append(ids)
            total += len(ids)
        return np.concatenate(found).astype(self.kind), first, count

    def encode(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the bounds of the rows in them."""
        if not len(buf):
            return np.empty(0, self.kind), np.zeros(len(bounds), np.int64)
        starts = self.pieces(buf, bounds)
        ends = np.append(starts[1:], len(buf))
        lengths = ends - starts
        low, high = _contents(buf, starts, ends)
        back, keys = pd.factorize(mixed(low ^ mixed(high ^ mixed(lengths.astype(np.uint64)))), sort=True)
        at = np.empty(len(keys), np.int64)
        at[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        if len(self.young.keys) + len(keys) > REMEMBERED:
            self.old, self.young = self.young, Known(self.kind)
        missing = np.flatnonzero(self.young.place(keys) < 0)
        place = self.old.place(keys[missing])
        again = place >= 0
        if again.any():
            self.young.add(keys[missing[again]], *self.old.taken(place[again]))
        new = missing[~again]
        if len(new):
            self.young.add(keys[new], *self._fresh(buf.tobytes(), starts[at[new]], ends[at[new]]))
        place = self.young.place(keys)
        # One piece of each key, and all long ones, are compared with what their ids spell.
        told = lengths > WIDE
        told[at] = True
        some = np.flatnonzero(told)
        alike = all((c == c[at][back]).all() for c in (low, high, lengths))
        spelt = buf[_bytes_of(starts[some], lengths[some])]
        if alike and self._spells(self.young.taken(place[back[some]])[0], spelt):
            out, _, count = self.young.taken(place[back])
        else:
            # Pieces with the same hash: this block is encoded without the tables.
            known = Known(self.kind)
            known.add(np.arange(len(starts), dtype=np.uint64), *self._fresh(buf.tobytes(), starts, ends))
            out, _, count = known.taken(np.arange(len(starts)))
        total = np.concatenate([[0], np.cumsum(count)])
        return out, total[np.searchsorted(starts, bounds)]

    def _spells(self, ids: np.ndarray, buf: np.ndarray) -> bool:
        """Whether the ids stand for these bytes."""
        length = self.bytes_of[ids]
        if int(length.sum()) != len(buf):
            return False
        kind = np.int32 if len(self.all_tokens) + len(buf) < 1 << 31 else np.int64
        end = np.cumsum(length, dtype=kind)
        at = np.repeat(self.token_at.astype(kind)[ids] - (end - length.astype(kind)), length)
        at += np.arange(len(buf), dtype=kind)
        return bool(np.array_equal(self.all_tokens[at], buf))


class Known:
    """Ids of pieces by the hash of the piece. The pieces of late blocks are in a young table; when
    that is full it becomes the old one, and what is asked for there moves on to the next."""

    def __init__(self, kind) -> None:
        self.keys = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(1 << 16, kind)
        self.used = 0

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place, -1)

    def taken(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids at these places one after the other, where each begins, how many it has."""
        count = self.count[place]
        begin = np.cumsum(count) - count
        total = int(count.sum())
        return self.ids[np.repeat(self.first[place] - begin, count) + np.arange(total)], begin, count

    def add(self, keys: np.ndarray, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            more = np.empty(max(2 * len(self.ids), self.used + len(ids)), self.ids.dtype)
            more[: self.used] = self.ids[: self.used]
            self.ids = more
        self.ids[self.used : self.used + len(ids)] = ids
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.first = np.concatenate([self.first, first + self.used])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.used += len(ids)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
