"""Token ids of whole texts by a public tokenizer, fast enough for large tables.

Texts in which single blanks or line ends separate words are encoded word by
word, recent pieces from a table of the worker: the two tokenizers used here cut
texts before a single blank, so ids of the pieces in order are the ids of the
text. Pieces are cut, looked up and put in line as arrays, known by a 64-bit hash. Any other text (runs of white space, other white space, a zero character, a special token's
string) goes to the tokenizer whole.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from agoralens.llm.common import mix, run_hashes

#: Pieces that a worker keeps, ids of pieces after which it begins anew, and characters that are cut at once.
SLOT_BITS = 21
SLOTS, IDS, AT_ONCE = 1 << SLOT_BITS, 1 << 23, 2 << 20

#: Tells a piece with a blank before from one without.
_LED = np.uint64(0xD1B54A32D192ED03)

_encoders: dict[str, Callable] = {}


def encoder(model: str, keep_blank: bool) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit integers.

    `model` is the content of the tokenizer's file; `keep_blank` says that the
    blank before a word is part of its first token.
    """
    if model not in _encoders:
        _encoders[model] = _make(model, keep_blank)
    return _encoders[model]


def _make(model: str, keep_blank: bool) -> Callable[[list[str]], list[bytes]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    mark, mark_id = special[0], tokenizer.token_to_id(special[0])
    # In line, a blank parts pieces: it begins one, or it is dropped and a token that ends a word ends a piece.
    separator = "" if keep_blank else " "
    spells = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for token, i in tokenizer.get_vocab().items():
        spells[i] = len(token) if keep_blank else token.endswith("</w>")
    table = Table()

    def whole(texts: list[str]) -> list[bytes]:
        out = []
        for group in _groups(texts):
            found = tokenizer.encode_batch_fast(group, add_special_tokens=False)
            out += [_little(array("I", e.ids)) for e in found]
        return out

    def in_line(chunk: list[str]) -> list[bytes] | None:
        """Ids of pieces that the tokenizer parts by itself if they stand in line; None if it didn't."""
        ids = np.array(tokenizer.encode_batch_fast([separator.join(chunk)], add_special_tokens=False)[0].ids, dtype="<u4")
        if keep_blank:
            reached = np.cumsum(spells[ids])
            wanted = np.cumsum([len(p.encode()) for p in chunk])
            at = np.searchsorted(reached, wanted)
            if at[-1] >= len(ids) or (reached[at] != wanted).any():
                return None
        else:
            at = np.flatnonzero(spells[ids])
            if len(at) != len(chunk):
                return None
        data, ends = ids.tobytes(), (4 * at + 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def marked(chunk: list[str]) -> list[bytes]:
        """Ids of any pieces: a special token between two keeps them apart."""
        ids = np.array(tokenizer.encode_batch_fast([mark.join(chunk)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = 4 * np.flatnonzero(ids == mark_id)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(data)], strict=True)]

    def apart(new: list[str]) -> dict[str, bytes]:
        """Ids of each of many short pieces, many in one call."""
        out: dict[str, bytes] = {}
        plain = [p for p in new if (p.startswith(" ") if keep_blank else p.isalpha())]
        odd = list(set(new).difference(plain))
        for k in range(0, len(plain), 2000):
            chunk = plain[k : k + 2000]
            found = in_line(chunk)
            out.update(zip(chunk, marked(chunk) if found is None else found, strict=True))
        for k in range(0, len(odd), 2000):
            chunk = odd[k : k + 2000]
            out.update(zip(chunk, marked(chunk), strict=True))
        return out

    def in_pieces(text: str) -> bool:
        return " ".join(text.split()) == text.replace("\n", " ") and "\0" not in text and not any(s in text for s in special)

    def short(texts: list[str]) -> list[bytes]:
        """Ids of texts piece by piece."""
        raw = [t.encode() for t in texts]
        cut = _cut(raw, keep_blank)
        offset, length = table.find(cut, lambda new: list(map(apart(new).__getitem__, new)))
        text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in raw]), cut.starts, side="right")
        ends = np.cumsum(np.bincount(text_of, length, len(texts)).astype(np.int64)) * 4
        before = np.cumsum(length) - length
        data = table.ids[np.repeat(offset - before, length) + np.arange(length.sum())].tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode(texts: list[str]) -> list[bytes]:
        fine = [in_pieces(t) for t in texts]
        by_piece, rest = [t for t, f in zip(texts, fine) if f], [t for t, f in zip(texts, fine) if not f]
        found = [x for group in _groups(by_piece) for x in short(group)]
        done, other = iter(found), iter(whole(rest))
        return [next(done) if f else next(other) for f in fine]

    return encode


def _groups(texts: list[str]) -> list[list[str]]:
    """Runs of texts of about AT_ONCE characters together; a longer text stands alone."""
    groups, held = [], 0
    for t in texts:
        if not groups or held + len(t) > AT_ONCE:
            groups.append([])
            held = 0
        groups[-1].append(t)
        held += len(t)
    return groups


@dataclass
class Pieces:
    """Pieces of some bytes, in order: where they start, their lengths, their hashes, and whether a blank comes before."""

    data: bytes
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    blank: np.ndarray

    def text(self, k: int) -> str:
        a = int(self.starts[k])
        return " " * bool(self.blank[k]) + self.data[a : a + int(self.lengths[k])].decode()


def _cut(texts: list[bytes], keep_blank: bool) -> Pieces:
    """Cut texts where both tokenizers do: at blanks, at line ends, which are pieces, and before a last comma or full stop after a letter."""
    data = b"\n".join(texts)
    a = np.frombuffer(data, dtype=np.uint8)
    between = np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64) - 1
    blank, line = a == 32, a == 10
    edge = np.flatnonzero(np.diff(~(line | blank), prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    last, before = a[ends - 1], a[np.maximum(ends - 2, 0)] | 32
    point = (ends - starts > 1) & ((last == 44) | (last == 46)) & (before >= 97) & (before <= 122)
    mark, left_out = line, blank.copy()
    mark[between], left_out[between] = False, True
    mark[starts] = mark[ends[point] - 1] = True
    at = np.flatnonzero(mark)
    dropped = np.concatenate([[0], np.cumsum(left_out)])
    stop = np.append(at[1:], len(a))[: len(at)]
    lengths = stop - at - (dropped[stop] - dropped[at])
    led = (at > 0) & blank[np.maximum(at - 1, 0)] if keep_blank and len(at) else np.zeros(len(at), dtype=bool)
    hashes = mix(run_hashes(a[~left_out], lengths) + led.astype(np.uint64) * _LED)
    return Pieces(data, at, lengths, hashes, led)


class Table:
    """Ids of recent pieces: SLOTS places by hash, and room for IDS ids, so its memory is bounded whatever is encoded."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.keys, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype="<u4"), 0

    def find(self, cut: Pieces, encode: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in `ids`, and how many there are. What isn't held is encoded, each piece once."""
        if self.used > IDS:
            self.reset()
        slot = (cut.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        offset, length = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != cut.hashes)
        if len(missing):
            keys, first, which = np.unique(cut.hashes[missing], return_index=True, return_inverse=True)
            encoded = encode([cut.text(k) for k in missing[first]])
            sizes = np.array([len(e) // 4 for e in encoded], dtype=np.int64)
            new = np.frombuffer(b"".join(encoded), dtype="<u4")
            begins = self.used + np.cumsum(sizes) - sizes
            if self.used + len(new) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(new)), dtype="<u4")])
            self.ids[self.used : self.used + len(new)] = new
            self.used += len(new)
            offset[missing], length[missing] = begins[which], sizes[which]
            into = slot[missing[first]]
            self.keys[into], self.at[into], self.size[into] = keys, begins, sizes
        return offset, length


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()
