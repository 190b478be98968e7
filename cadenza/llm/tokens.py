"""Exact and quick encoding with the public tokenizers, inside tasks.

`WordEncoder` is for the tokenizer that drops white space: a text is cut at blanks, where
that tokenizer always cuts too, and between a word of Latin letters and the marks after it, so
the ids of the pieces, one after the other, are the ids of the text.  Each piece is encoded
once by the tokenizers library; pieces seen before are found by comparing their bytes, many at
a time, in tables of bounded size.

`ByteEncoder` is for byte-level BPE: the vocabulary of the same file runs in tiktoken, which
gives the same ids in a third of the time; texts with a special token's string, which
tiktoken would read as plain text, go through the tokenizers library itself.

Both are held against the tokenizers library where they run: of all texts of up to
`CHECKED_CHARS` characters, one in `CHECKED`, chosen by a checksum of its bytes, is encoded by the
library as it is, whole, and a difference ends the task with an error.  (The library takes some
hundred bytes for each token at a time, so longer texts would need much memory.)
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np

from cadenza.llm.common import mixed

#: id that ends each document.
END_ID = 1
END_BYTES = np.array([END_ID], "<u4").tobytes()
#: One text in so many is encoded by the library as a whole, too, and compared.
CHECKED, CHECKED_CHARS = 128, 50_000
#: Pieces that are kept; beyond that those met last go, as frequent ones are met first.  Bounds
#: the memory of a Python worker.
KEPT_PIECES = 1_000_000
#: Places of the table that says which kept piece has a hash.
PLACES = 1 << 21
#: Bytes of a piece that is kept in the table; longer ones are kept, or not, by themselves.
PIECE_BYTES, LONG_BYTES, LONG_PIECES = 24, 128, 50_000
#: Words encoded in one call of the model.
JOINED_WORDS = 500
#: Characters of the texts that are cut at a time, about.
BATCH_CHARS = 2_000_000

#: All but ASCII and Latin letters that have one form only under NFC and one small letter each;
#: texts without these may be lowered at once, and their bytes beyond ASCII are letters.
_OTHER = re.compile("[^\\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
#: Marks that may follow a word; the tokenizer cuts between letters and marks.
_MARKS = ".,!?;:*#$%&)"
_BLANK, _LETTER, _MARK, _ELSE = range(4)
_KIND = np.full(256, _ELSE, np.uint8)
_KIND[[10, 32]], _KIND[97:123], _KIND[128:], _KIND[[ord(c) for c in _MARKS]] = _BLANK, _LETTER, _LETTER, _MARK
#: What of eight bytes, read as a little-endian number, belongs to a piece with so many left.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Pieces:
    """Kept pieces with their ids: a table of places leads from a hash to a piece, whose bytes
    are compared, so a clash of hashes only means that a piece is looked up again."""

    def __init__(self):
        self.place = np.full(PLACES, -1, np.int32)
        self.keys, self.first, self.n = np.zeros((0, 4), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def keys_of(codes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes of pieces as three numbers, and their size.  codes: padded by PIECE_BYTES."""
        eights = np.lib.stride_tricks.as_strided(codes.view(np.uint8), (len(codes) - 7, 8), (1, 1))
        out = np.empty((len(starts), 4), np.uint64)
        for k in range(3):
            out[:, k] = eights[starts + 8 * k].view("<u8").ravel() & _FIRST[np.clip(size - 8 * k, 0, 8)]
        out[:, 3] = size
        return out

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[:, 2] * np.uint64(0xD6E8FEB86659FD93) + keys[:, 3])

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (self.hashes(keys) & np.uint64(PLACES - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        at = self.place[self._places(keys)]
        if not len(self.keys):
            return at
        same = (self.keys[at] == keys).all(1)
        return np.where(same, at, -1)

    def make_room(self, more: int) -> bool:
        """Drops the pieces met last if with more there were too many."""
        half = KEPT_PIECES // 2
        if len(self.keys) + more <= KEPT_PIECES or len(self.keys) <= half:
            return False
        self.keys, self.n = self.keys[:half], self.n[:half]
        self.first, self.ids = self.first[:half], self.ids[: int(self.n.sum())]
        self.place[:] = -1
        self.place[self._places(self.keys)] = np.arange(half, dtype=np.int32)
        return True

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
        """Keeps new pieces; gives their numbers."""
        n = np.array([len(x) for x in ids], np.int64)
        numbers = np.arange(len(self.keys), len(self.keys) + len(keys))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(n) - n))
        self.ids = np.concatenate((self.ids, *ids))
        self.keys, self.n = np.concatenate((self.keys, keys)), np.concatenate((self.n, n))
        self.place[self._places(keys)] = numbers.astype(np.int32)
        return numbers


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers as pre

        self.tokenizer = _load(path)
        self.words = _load(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.pieces = _Pieces()
        self.long: dict[str, np.ndarray] = {}

    def _whole(self, chunks: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of small letters, many in one text; the vocabulary tells where each ends."""
        groups = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        out: list[np.ndarray] = []
        for e in self.words.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            out += map(ids.__getitem__, map(slice, [0, *cuts[:-1]], cuts))
        return out

    def _learn(self, pieces: list[str], plain: list[bool]) -> list[np.ndarray]:
        """Ids of pieces, of which the plain ones are words of small Latin letters."""
        words = iter(self._words([x for x, p in zip(pieces, plain, strict=True) if p]))
        other = iter(self._whole([x for x, p in zip(pieces, plain, strict=True) if not p]))
        return [next(words if p else other) for p in plain]

    def _kept(self, pieces: list[str]) -> list[np.ndarray]:
        """As _learn, for long or odd pieces."""
        new = list(set(pieces).difference(self.long))
        plain = [x.isalpha() and x.islower() and not _OTHER.search(x) for x in new]
        found = dict(zip(new, self._learn(new, plain), strict=True))
        out = [found[x] if x in found else self.long[x] for x in pieces]
        if len(self.long) + len(new) > LONG_PIECES:
            self.long.clear()
        self.long.update((x, ids) for x, ids in islice(found.items(), LONG_PIECES) if len(x) <= LONG_BYTES)
        return out

    @staticmethod
    def _cut(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, and whether they are words: what is between blanks, and
        of a word with marks after it each by itself.  A blank comes first and last."""
        kind = _KIND[codes]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        if not len(edge):
            return edge, edge, edge.astype(bool)
        run = kind[edge]  # of the run from each edge to the next; the last is blank
        opens = np.append(True, run[:-1] == _BLANK) & (run != _BLANK)  # the runs that chunks begin with
        first = np.flatnonzero(opens)
        after = run[first + 1]
        marked = (run[first] == _LETTER) & (after == _MARK)
        marked[marked] = run[first[marked] + 2] == _BLANK
        lone = after == _BLANK
        stop = np.empty(len(first), np.int64)  # the run that the first piece of each chunk ends before
        stop[lone | marked] = first[lone | marked] + 1
        rest = np.flatnonzero(~(lone | marked))
        blanks = np.flatnonzero(run == _BLANK)
        stop[rest] = blanks[np.searchsorted(blanks, first[rest])]
        tails = first[marked] + 1
        begin, end = np.concatenate((first, tails)), np.concatenate((stop, tails + 1))
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        return edge[begin], edge[end], (run[begin] == _LETTER) & (end == begin + 1)

    def _fast(self, texts: list[str]) -> list[bytes]:
        """Of lowered texts of ASCII and Latin letters."""
        raw = f" {' '.join(texts)} ".encode()
        codes = np.frombuffer(raw + bytes(PIECE_BYTES + 8), np.uint8)
        starts, ends, words = self._cut(codes[: len(raw)])
        size = ends - starts
        number = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= PIECE_BYTES)
        keys = _Pieces.keys_of(codes, starts[short], size[short])
        number[short] = self.pieces.find(keys)
        new = np.flatnonzero(number[short] < 0)
        if self.pieces.make_room(len(new)):
            number[short] = self.pieces.find(keys)
            new = np.flatnonzero(number[short] < 0)
        if len(new):
            _, one, which = np.unique(_Pieces.hashes(keys[new]), return_index=True, return_inverse=True)
            if (keys[new[one]][which] != keys[new]).any():  # two pieces with one hash
                _, one, which = np.unique(keys[new], axis=0, return_index=True, return_inverse=True)
            at = short[new[one]]
            pieces = [raw[x:y].decode() for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            number[short[new]] = self.pieces.add(keys[new[one]], self._learn(pieces, words[at].tolist()))[which.ravel()]
        table, first, n = self.pieces.ids, self.pieces.first, self.pieces.n
        long = np.flatnonzero(size > PIECE_BYTES)
        if len(long):
            ids = self._kept([raw[x:y].decode() for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
            number[long] = np.arange(len(n), len(n) + len(long))
            more = np.array([len(x) for x in ids], np.int64)
            first, n = np.concatenate((first, len(table) + np.cumsum(more) - more)), np.concatenate((n, more))
            table = np.concatenate((table, *ids))
        each = n[number]
        to = np.cumsum(each)
        ids = table[np.repeat(first[number] - (to - each), each) + np.arange(int(to[-1]) if len(to) else 0)].astype("<u4").tobytes()
        begins = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])  # of the blank before each
        bounds = (4 * np.append(0, to)[np.searchsorted(starts, begins)]).tolist()
        return [ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        """Of texts in any script: chunks between blanks, each kept by itself."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        ids = iter(self._kept([x if _OTHER.search(x) else x.lower() for c in cut for x in c]))
        return [b"".join(next(ids).tobytes() for _ in c) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # nothing here makes cycles
        try:
            odd = [not t.isascii() and _OTHER.search(t) is not None for t in texts]
            slow = iter(self._by_chunks([t for t, o in zip(texts, odd, strict=True) if o]))
            fast = iter(self._fast([t.lower() for t, o in zip(texts, odd, strict=True) if not o]))
            return [next(slow if o else fast) for o in odd]
        finally:
            gc.enable()


#: How byte-level BPE cuts a text before merging (fixed by the public vocabulary).
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = _load(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        of = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(of[c] for c in piece): i for piece, i in vocab.items() if piece not in self.specials}
        self.quick = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if any(s in t for s in self.specials):
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
            else:
                ids = self.quick.encode_ordinary(t)
            out.append(np.array(ids, "<u4").tobytes())
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder | ByteEncoder:
    """One encoder for each Python worker and tokenizer file."""
    drops_blanks = _load(path).encode(" b", add_special_tokens=False).ids == _load(path).encode("b").ids
    return WordEncoder(path) if drops_blanks else ByteEncoder(path)


def _compare(enc: WordEncoder | ByteEncoder, texts: list[str], ids: list[bytes]) -> None:
    """Raises where the library's ids of the checked share of the texts differ."""
    for t, x in zip(texts, ids, strict=True):
        if len(t) <= CHECKED_CHARS and zlib.crc32(t.encode("utf-8", "replace")) % CHECKED == 0:
            (found,) = enc.tokenizer.encode_batch_fast([t], add_special_tokens=False)
            if np.array(found.ids, "<u4").tobytes() != x:
                raise ValueError(f"ids differ from the tokenizers library's for a text that begins {t[:80]!r}")


def document_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each document with the end id; null counts as the empty text."""
    enc, out, at = encoder(path), [], 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < BATCH_CHARS):
            size += len(texts[stop] or "")
            stop += 1
        some = [t or "" for t in texts[at:stop]]
        ids = enc.encode(some)
        _compare(enc, some, ids)
        out += [x + END_BYTES for x in ids]
        at = stop
    return out


def public_path(name: str) -> str:
    """Place of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)
