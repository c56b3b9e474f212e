"""Exact token counts of a public byte-level tokenizer, by memorised units.

The tokenizer cuts a text at white space before it merges, so a text is a row of
units whose tokens don't depend on their neighbours. Each task keeps the counts
of the units that it has met, up to a number of bytes, and asks the library only
for new ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Bytes of units that a counter keeps, about; beyond, it starts anew.
MEMO_BYTES = 48 << 20
#: About what a unit takes in the memo besides its own characters.
_UNIT_BYTES = 150
#: Marks that, alone after a word of Latin letters, are a unit of their own.
_MARKS = ",.;:!?"
_LATIN_END = "\u0250"
#: Of GPT-2's rule: a run of other characters with one space before it, or white space up to such a run.
_UNIT = re.compile("(?: ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+)")
#: White space besides the four above; a text with one of these goes to the library whole.
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _word_and_mark(unit: str) -> tuple[str, str]:
    """A unit of Latin letters, with or without a space before it, and one mark after it, in two; else the unit and ''.

    Letters and other characters are never merged, so the tokens of both parts are those of the whole.
    """
    if unit[-1] in _MARKS and (unit[1:-1] if unit[0] == " " else unit[:-1]).isalpha() and max(unit) < _LATIN_END:
        return unit[:-1], unit[-1]
    return unit, ""


def _encoded(tok, special: list[str], units: list[str]) -> Iterator[tuple[list[str], bytes, list[int]]]:
    """Some units at a time: the units, their ids one after the other, and where each unit's bytes end there.

    Many units go in one text with a special token between, which parts a text
    before anything else is done to it; the special token's own id stands before
    each unit but the first.
    """
    mark = special[0]
    number = tok.token_to_id(mark)
    alone = {u for u in units if any(x in u for x in special)}
    joined = [u for u in units if u not in alone]
    for at in range(0, len(joined), 1000):
        part = joined[at : at + 1000]
        ids = np.array(tok.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
        yield part, ids.tobytes(), [*(4 * np.flatnonzero(ids == number)).tolist(), 4 * len(ids)]
    for u in alone:
        ids = np.array(tok.encode(u, add_special_tokens=False).ids, "<u4").tobytes()
        yield [u], ids, [len(ids)]


class UnitCounter:
    """Token counts under a byte-level vocabulary whose pre-tokenizer is GPT-2's."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.memo: dict[str, int] = {}
        self.held = 0

    def plain(self, text: str) -> bool:
        """True if units of this text can be taken alone."""
        return not _RARE.search(text) and not any(s in text for s in self.special)

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False))

    def learn(self, units: list[str]) -> None:
        memo = self.memo
        new = set(units).difference(memo)
        if not new:
            return
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
            new = set(units)
        parts = {u: _word_and_mark(u) for u in new}
        ask = [x for x in dict.fromkeys(x for pair in parts.values() for x in pair) if x and x not in memo]
        for part, _, ends in _encoded(self.tok, self.special, ask):
            start = 0
            for u, end in zip(part, ends, strict=True):
                memo[u] = (end - start) // 4
                start = end + 4
        for u, (word, mark) in parts.items():
            if mark:
                memo[u] = memo[word] + memo[mark]
        self.held += sum(map(len, new)) + sum(map(len, ask)) + _UNIT_BYTES * (len(new) + len(ask))

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(text)

    def count(self, units: list[str]) -> int:
        return sum(map(self.memo.__getitem__, units))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the boundaries in a chunk, and the tokens before each: (offsets, running counts)."""
        if not self.plain(text):
            e = self.tok.encode(text, add_special_tokens=False)
            word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            offsets = e.offsets  # made anew on each access
            at = np.array([offsets[i][0] for i in first], np.int64)
            keep = np.r_[True, at[1:] > at[:-1]] if len(at) else np.zeros(0, bool)
            return np.r_[at[keep], len(text)], np.r_[first[keep], len(word)]
        units = self.units(text)
        self.learn(units)
        n = np.fromiter(map(self.memo.__getitem__, units), np.int64, len(units))
        size = np.fromiter(map(len, units), np.int64, len(units))
        return np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(n)]
