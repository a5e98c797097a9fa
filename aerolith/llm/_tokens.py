"""Token ids of whole texts by a public tokenizer, with each piece between white space encoded once.

A byte-level or word-level BPE never merges across the cuts made here, so a text's ids are those of
its pieces in order. Texts with white space other than ASCII's are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BYTE_LEVEL, WORD_LEVEL = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Pieces that a worker keeps; when there are more it starts anew.
CACHED = 450_000
#: Bytes of text that are cut and looked up together.
BATCH = 4 << 20
MARK = b"\x01"
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
#: Bytes with which such white space starts.
_MAY_BE_OTHER = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
#: Latin letters, all of them one character in lower case and composed, and marks that are neither letters nor digits.
_SIMPLE = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,!?#*%$&|;:]*)")
#: The character that stands for each byte in a byte-level vocabulary: itself if it is printable in Latin-1, else the next from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_encoders: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.words_only = bool(json.load(f)["model"].get("end_of_word_suffix"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: A control character is no part of a longer token, and white space keeps it from its neighbours.
        self.between = b" " + MARK + b" " if self.words_only else b"\n"
        self.mark = self.tokenizer.encode((MARK if self.words_only else b"\n").decode(), add_special_tokens=False).ids[-1]
        self.marks: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _encoded(self, new: list[bytes]) -> tuple[list[int] | np.ndarray, np.ndarray]:
        """Ids of all pieces and the length of each; all in one call, told apart by a mark, if no piece has the mark."""
        if not any(MARK in x for x in new):
            ids = np.array(self.tokenizer.encode(self.between.join(new).decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(new) - 1:
                return np.delete(ids, at), np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1
        every = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in new], add_special_tokens=False)]
        return [i for x in every for i in x], np.array([len(x) for x in every], np.int64)

    def _stem(self, lead: str, letters: str) -> list[int]:
        """Ids of letters, which are one word of the model, after a space or not."""
        if self.words_only:
            letters = letters.lower()
        mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_SHOWN)
        return [t.id for t in self.tokenizer.model.tokenize(f"\u0120{mapped}" if lead else mapped)]

    def _learn_simple(self, new: list[bytes]) -> list[bytes]:
        """Learns words of Latin letters with marks behind them; returns the other pieces."""
        other, done, parts, lengths, stems = [], [], [], [], {}
        for piece in new:
            m = _SIMPLE.fullmatch(piece.decode("utf-8", "replace"))
            if m is None:
                other.append(piece)
                continue
            lead, letters, marks = m.groups()
            ids = stems.get((lead, letters))
            if ids is None:
                ids = stems[lead, letters] = self._stem(lead, letters)
            if marks:
                if marks not in self.marks:
                    self.marks[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
                ids = ids + self.marks[marks]
            done.append(piece)
            parts += ids
            lengths.append(len(ids))
        self._keep(done, parts, lengths)
        return other

    def _keep(self, pieces: list[bytes], ids, lengths) -> None:
        used = int(self.ends[-1])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[used : used + len(ids)] = ids
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.ends = np.concatenate((self.ends, used + np.cumsum(np.array(lengths, np.int64))))

    def _learn(self, new: list[bytes]) -> None:
        collects = gc.isenabled()
        gc.disable()  # many small lists, none of them in a cycle
        try:
            new = self._learn_simple(new)
        finally:
            if collects:
                gc.enable()
        plain, blank = [x for x in new if not x.isspace()], [x for x in new if x.isspace()]
        for group in (plain, *([x] for x in blank)):
            if group:
                self._keep(group, *self._encoded(group))

    def _starts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and which of them count."""
        space = _SPACES[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        if self.words_only:
            start = space != before
            start[heads] = True
            at = np.flatnonzero(start)
            return at, ~space[at]
        after[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = True
        start = space & (~after | ~before)
        start[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
        start[heads] = True
        at = np.flatnonzero(start)
        return at, np.ones(len(at), bool)

    def _batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        odd = {}
        held = b"".join(texts)
        if _MAY_BE_OTHER[np.frombuffer(held, np.uint8)].any():
            odd = {i: np.array(self.tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for i, x in enumerate(texts) if _OTHER_SPACE.search(x)}
            if odd:
                texts = [b"" if i in odd else x for i, x in enumerate(texts)]
                held = b"".join(texts)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        data = np.frombuffer(held, np.uint8)
        at, counts = self._starts(data, bounds)
        cut = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(held)).astype(np.int32).tobytes()), pa.py_buffer(held)])
        if not counts.all():
            cut, at = cut.filter(pa.array(counts)), at[counts]
        coded = cut.dictionary_encode()
        own = coded.dictionary
        spots = np.frombuffer(own.buffers()[1], np.int32)[: len(own) + 1].tolist() if len(own) else [0]
        whole = own.buffers()[2].to_pybytes() if len(own) else b""
        pieces = [whole[a:b] for a, b in zip(spots, spots[1:])]
        index = list(map(self.known.get, pieces))
        if None in index:
            new = [p for p, i in zip(pieces, index) if i is None]
            if len(self.known) + len(new) > CACHED:
                self.clear()
                new = pieces
            self._learn(new)
            index = list(map(self.known.__getitem__, pieces))
        where = np.array(index, np.int64)[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
        begins = self.ends[where]
        lengths = self.ends[where + 1] - begins
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.repeat(begins - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[np.searchsorted(at, bounds)]
        if not odd:
            return ids, np.diff(cuts)
        parts = [odd.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts: (from, to, ids of all of them, how many each has)."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH):
                size += len(texts[j])
                j += 1
            yield i, j, *self._batch(texts[i:j])
            i = j

    def one(self, text: bytes) -> np.ndarray:
        return self._batch([text])[0]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def resolved(name: str) -> str:
    """A tokenizer file by its public name or, if it has a slash, by its path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
