"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces already encoded.

The vocabulary's pre-tokenizer never joins text across white space, nor across a border between an
ASCII letter and plain ASCII punctuation.  So a text's ids are the ids of its pieces between such
borders, one after another.  Each piece goes to the library once while it is remembered; every later
sight of it costs one probe of a hash table.  Apostrophes (contractions), "<", "|" and ">" (written
special tokens), digits and bytes of longer code points are never next to a cut.
"""

from __future__ import annotations

import numpy as np

from . import textbytes as tb
from .textbytes import U64, mix

#: 0 white space, 1 ASCII letter, 2 plain punctuation, 3 everything else; a border only between 1 and 2.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[i for i in range(128) if chr(i).isalpha()]] = 1
KIND[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{}~']] = 2
BORDER = np.zeros(16, bool)
BORDER[[1, 2, 3, 4, 8, 12, 1 * 4 + 2, 2 * 4 + 1]] = True
#: Pieces remembered; then the memory starts anew.
REMEMBER = 1 << 19
#: New pieces that are encoded as one text.
GROUP = 512


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        (self.zero,) = self.lib.encode("0", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.mask = REMEMBER * 2 - 1
        self.key = np.zeros(self.mask + 1, np.uint64)
        self.slot = np.full(self.mask + 1, -1, np.int32)
        self.n = 0
        self.at = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of remembered pieces, or -1."""
        out = np.full(len(h), -1, np.int32)
        todo, place = np.arange(len(h)), (h & U64(self.mask)).astype(np.int64)
        while len(todo):
            got, key = self.slot[place], self.key[place]
            hit = (got >= 0) & (key == h[todo])
            out[todo[hit]] = got[hit]
            more = (got >= 0) & ~hit
            todo, place = todo[more], (place[more] + 1) & self.mask
        return out

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has).  Groups of pieces are encoded as one text with the
        word "0" between them; pieces with that digit are encoded alone."""
        flat, count = [], []
        groups = [pieces[i : i + GROUP] for i in range(0, len(pieces), GROUP)]
        texts = [b" 0 ".join(p for p in g if b"0" not in p).decode("utf-8", "replace") for g in groups]
        for g, got in zip(groups, self.lib.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, np.uint32)
            cut = np.flatnonzero(ids == self.zero)
            odd = [i for i, p in enumerate(g) if b"0" in p]
            if not odd and len(cut) == len(g) - 1:
                flat.append(ids[ids != self.zero])
                count.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
                continue
            each: list = [None] * len(g)
            plain = [i for i, p in enumerate(g) if b"0" not in p]
            if plain and len(cut) == len(plain) - 1:
                for i, x in zip(plain, np.split(ids, cut)):
                    each[i] = x[1:] if len(x) and x[0] == self.zero else x
            else:
                odd = range(len(g))
            for i in odd:
                each[i] = np.array(self.lib.encode(g[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            flat += each
            count.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(flat), np.concatenate(count)

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        flat, count = self._encode_pieces(pieces)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(h) > len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[self.n : self.n + len(h)] = self.used + np.cumsum(count) - count
        self.count[self.n : self.n + len(h)] = count
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.used, self.n = self.used + len(flat), self.n + len(h)
        place = (h & U64(self.mask)).astype(np.int64)
        while len(h):
            free = self.slot[place] < 0
            at, first = np.unique(place[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.slot[at], self.key[at] = number[took], h[took]
            left = np.ones(len(h), bool)
            left[took] = False
            h, number, place = h[left], number[left], (place[left] + 1) & self.mask

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all rows, first id of each row and the total).  end_id closes every row."""
        rows = len(offs) - 1
        kind = KIND[data]
        if len(data):
            border = BORDER[kind[:-1] * 4 + kind[1:]]
            inside = kind > 0
            first, last = inside.copy(), inside.copy()
            first[1:] &= border
            last[:-1] &= border
            top = offs[:-1][offs[:-1] < offs[1:]]
            first[top] = inside[top]
            last[top[1:] - 1] = inside[top[1:] - 1]
            start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            start = end = np.empty(0, np.int64)
        h = tb.content_hash(data, start, end)
        piece = self._find(h)
        if len(new := np.flatnonzero(piece < 0)):
            order = np.argsort(h[new], kind="stable")
            fresh = h[new][order]
            head = np.concatenate([[True], fresh[1:] != fresh[:-1]])
            own, where = fresh[head], order[head]
            back = np.empty(len(new), np.int32)
            back[order] = np.cumsum(head) - 1
            if self.n + len(own) > REMEMBER and self.n:
                self.forget()
                return self.encode(data, offs, end_id)
            at, raw = new[where], data.tobytes()
            base = self.n
            if len(own) > self.mask // 2:  # one slice with more new pieces than the table holds
                self.mask = (1 << int(len(own) * 4).bit_length()) - 1
                self.key, self.slot = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
            self._learn(own, [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
            piece[new] = base + back
        count, at = self.count[piece].astype(np.int64), self.at[piece]
        row_piece = np.searchsorted(start, offs)  # the first piece of each row
        ends = np.concatenate([[0], np.cumsum(count)])
        close = np.arange(rows + 1) if end_id is not None else 0
        bounds = ends[row_piece] + close
        total = int(ends[-1])
        source = np.repeat(at - ends[:-1], count) + np.arange(total)
        if end_id is None:
            return self.ids[source], bounds
        out = np.full(total + rows, end_id, np.uint32)
        keep = np.ones(total + rows, bool)
        keep[bounds[1:] - 1] = False
        out[keep] = self.ids[source]
        return out, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(column, path: str, end_id: int | None = 1, limit: int = tb.CHUNK):
    """Yields (first row, last row, ids, bounds) for slices of a text column."""
    data, offs = tb.buffers(column)
    enc = encoder(path)
    for i, j in tb.row_slices(offs, limit):
        ids, bounds = enc.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end_id)
        yield i, j, ids, bounds


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
