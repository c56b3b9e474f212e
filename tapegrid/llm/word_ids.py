"""Exact token ids of a public word tokenizer for many texts at once, in Arrow and numpy.

The tokenizer drops white space and never merges over the border between letters
and ASCII digits or punctuation. Texts are cut at such borders, each different
unit of a part of the texts is encoded once by the library, and the ids of the
texts are gathered from those of their units.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are cut and looked up together, about.
PART = 1 << 21
#: Bytes of units, ids and counts that an encoder keeps from part to part; beyond, it starts anew.
MEMO_BYTES = 16 << 20

# Kinds of bytes. Letters that can follow an apostrophe as a unit ('s 't 're 've 'm 'll 'd) are their own kind.
_SPACE, _SHORT, _LETTER, _DIGIT, _PUNCT, _APOSTROPHE, _OTHER = range(7)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _PUNCT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[ord(c) for c in "strvmldSTRVMLD"]] = _SHORT
_KIND[48:58] = _DIGIT
_KIND[39] = _APOSTROPHE
_KIND[[9, 10, 13, 32]] = _SPACE
#: Whether a text may be cut between a kind (row) and the next: never beside other characters, which may combine or be white space.
_CUT = np.zeros((8, 8), bool)
for _a, _b in (
    ("short letter", "digit punct apostrophe"),
    ("digit", "short letter digit punct apostrophe"),
    ("punct", "short letter digit"),
    ("apostrophe", "letter digit"),
    ("space", "short letter digit punct apostrophe other"),
    ("short letter digit punct apostrophe other", "space"),
):
    _names = "space short letter digit punct apostrophe other".split()
    _CUT[np.ix_([_names.index(x) for x in _a.split()], [_names.index(x) for x in _b.split()])] = True
_CUT = _CUT.ravel()
#: A word of letters up to U+00FF, which have one small form each and never combine.
_LATIN = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"
#: Units that the library gets in one text.
_TOGETHER = 1000
#: Bytes as the characters by which the vocabulary writes them.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTED)} | {32: 32}


def cut_places(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units begin in data, the UTF-8 bytes of texts that end at `ends`, and where the last one ends."""
    kind = _KIND[data]
    # Letters from U+00C0 to U+00FF never combine with what stands before them; two of that row aren't letters.
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kind[at] = kind[at + 1] = _LETTER
    cut = np.empty(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    cut[1:-1] = _CUT[(kind[:-1] << 3) | kind[1:]]
    cut[ends] = True
    return np.flatnonzero(cut)


def units_between(data: np.ndarray, places: np.ndarray) -> pa.Array:
    """The units that begin at the places of data, the last of which is the end."""
    return pa.Array.from_buffers(pa.large_string(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)])


def text_parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of about PART bytes of a column of texts: first row, first row behind, bytes, where each text ends in them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        a = b


def _joined(units: pa.Array, between: str) -> list[str]:
    """Texts of _TOGETHER units each."""
    cuts = pa.array([*range(0, len(units), _TOGETHER), len(units)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(cuts, units.cast(pa.string())), between).to_pylist() if len(units) else []


class WordIds:
    """Ids of whole texts. Keeps the units it has met up to MEMO_BYTES; made by each task for itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.by_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)).encode())
        self.mark = self.tok.token_to_id(self.special[0])
        # The same vocabulary without the steps that leave words of small letters as they are.
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.units = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.sizes = np.zeros(0, np.int64)

    def _learn(self, units: pa.Array) -> None:
        """Adds units that aren't in the memo: words of Latin letters many in a text, others with a mark between them."""
        latin = pc.match_substring_regex(units, _LATIN)
        words, others = units.filter(latin), units.filter(pc.invert(latin))
        ids, sizes = [self.ids], [self.sizes]
        for text in _joined(words, " "):
            written = text.lower().encode().decode("latin-1").translate(_WRITTEN)
            found = np.array(self.plain.encode_batch_fast([written], add_special_tokens=False)[0].ids, np.uint32)
            ids.append(found)
            sizes.append(np.diff(np.r_[-1, np.flatnonzero(self.ends_word[found])]))
        for text in _joined(others, self.special[0]):
            found = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(found == self.mark)
            ids.append(np.delete(found, marks))
            sizes.append(np.diff(np.r_[-1, marks, len(found)]) - 1)
        self.units = pa.concat_arrays([self.units, words, others])
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)

    def found(self, different: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of the different units begin and how many they are."""
        if self.units.nbytes + self.ids.nbytes + self.sizes.nbytes > MEMO_BYTES:
            self._forget()
        own = pc.index_in(different, value_set=self.units)
        if own.null_count:
            self._learn(different.filter(own.is_null()))
            own = pc.index_in(different, value_set=self.units)
        own = own.to_numpy()
        return self.ids, (np.cumsum(self.sizes) - self.sizes)[own], self.sizes[own]

    def _plain(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's end, of texts without special tokens."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        places = cut_places(data, ends)
        coded = units_between(data, places).dictionary_encode()
        pool, begins, sizes = self.found(coded.dictionary)
        at = coded.indices.to_numpy()
        size = sizes[at]
        last = np.r_[0, np.cumsum(size)][np.searchsorted(places, ends)]
        full = np.flatnonzero(size)
        at, size = at[full], size[full]
        ids = pool[np.repeat(begins[at] - (np.cumsum(size) - size), size) + np.arange(int(last[-1]))]
        return ids, last

    def _in_segments(self, raw: bytes, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """As _plain, for texts of any length and with special tokens: cut there, and after white space."""
        pieces: list[np.ndarray] = []
        sizes: list[int] = []  # ids of each row so far
        held: list[tuple[int, bytes]] = []  # row and bytes of segments that aren't encoded yet, in order
        marks: list[tuple[int, int]] = []  # number of a segment without bytes, and the special id that it stands for

        def settle() -> None:
            if held:
                data = b"".join(x for _, x in held)
                ids, last = self._plain(np.frombuffer(data, np.uint8), np.cumsum([len(x) for _, x in held]))
                pieces.append(np.insert(ids, [last[k] for k, _ in marks], [x for _, x in marks]) if marks else ids)
                n = np.diff(np.r_[0, last])
                n[[k for k, _ in marks]] += 1
                for (row, _), more in zip(held, n.tolist(), strict=True):
                    sizes[row] += more
                held.clear()
                marks.clear()

        at = waiting = 0
        for row, stop in enumerate(ends):
            sizes.append(0)
            for found in [*self.by_special.finditer(raw, at, stop), None]:
                end = found.start() if found else stop
                while at < end:
                    cut = end
                    if end - at > PART:
                        cut = max(raw.rfind(c, at, at + PART) for c in (b" ", b"\n")) + 1 or end
                    held.append((row, raw[at:cut]))
                    waiting += cut - at
                    at = cut
                    if waiting > PART:
                        settle()
                        waiting = 0
                if found:
                    marks.append((len(held), self.tok.token_to_id(found.group().decode())))
                    held.append((row, b""))
                    at = found.end()
        settle()
        return np.concatenate([np.zeros(0, np.uint32), *pieces]), np.cumsum(sizes)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Parts of a column of texts: (first row, ids of the rows one after the other, where each row's end); null is empty."""
        for a, _, part, ends in text_parts(column):
            raw = part.tobytes()
            if len(part) > PART or self.by_special.search(raw):
                yield a, *self._in_segments(raw, ends.tolist())
            else:
                yield a, *self._plain(part, ends)
