"""Encoding whole texts with a tokenizer file, one distinct word at a time.

Where a tokenizer drops white space and never lets a token cross it, the ids of
a text are those of its words in order. A word is then given to the library once
and looked up afterwards, which matters because most words of a text recur: many
texts at a time are split into the numbers of their distinct words, each of these is
looked up once, and the ids of all texts are gathered by number. The property is
probed when the file is loaded; without it texts are encoded whole. So is whether
case is dropped: then texts are lowered before they are split.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORDS = re.compile(r"[^ \t-\r]+").findall
#: Letters that no normaliser changes but for their case; marks that end a word.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_MARKS = ".,!?;:*$%&#"
#: Normalisers that change none of those letters in lower case, nor a single space between words.
_NEUTRAL = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
_BEYOND = re.compile("[^\x00-\xff]").search
#: Every letter of Latin-1 alone, then all of them in words: case is dropped if none tells it.
_CASED = [chr(c) for c in range(0x100) if chr(c).isalpha()]
_CASED += ["".join(_CASED[k : k + 7]) for k in range(0, len(_CASED), 7)]
_PROBES = ("it's a test, isn't it?", "Été  über\tgroße 123 45!!", "a.b c,d <x> ́e ź", "''' -- ...\n\n(a) b's",
           "a\x85b\xa0c\u1680d\u2003e\u2028f\u202fg\u205fh\u3000i")
#: Words held per worker; beyond it the memory starts anew.
HELD_WORDS, HELD_STEMS, HELD_CHARS = 300_000, 600_000, 80


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, normaliser = said["model"], said["normalizer"] or {"type": "Sequence", "normalizers": []}
        steps = normaliser.get("normalizers", [normaliser])
        self._stem_t = self._t
        if {"type": "Lowercase"} in steps and all(x in _NEUTRAL for x in steps):
            self._stem_t = Tokenizer.from_file(path)
            self._stem_t.normalizer = None
        suffix = model.get("end_of_word_suffix")
        self._ends = np.zeros(self._t.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
        if suffix:
            self._ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self._words: dict[str, bytes] = {}
        self._stems: dict[str, bytes] = {}
        self.by_words = all(self._whole([p])[0] == b"".join(self._whole(_WORDS(p))) for p in _PROBES)
        #: Marks that part from the letters before them.
        self._marks = "".join(m for m in _MARKS if self._whole(["ab" + m])[0] == b"".join(self._whole(["ab", m])))
        self.lowers = all(self._whole([w]) == self._whole([w.lower()]) for w in _CASED)

    def _whole(self, texts: list[str], by=None) -> list[bytes]:
        found = (by or self._t).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn_stems(self, stems: list[str]) -> None:
        """Plain words are one pre-token each, so each ends at one word-end token."""
        for at in range(0, len(stems), 4096):
            part = stems[at : at + 4096]
            ids = np.frombuffer(self._whole([" ".join(part)], self._stem_t)[0], dtype="<u4")
            cut = 4 * (np.flatnonzero(self._ends[ids]) + 1)
            if len(cut) == len(part):
                raw, ends = ids.tobytes(), cut.tolist()
                found = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                found = self._whole(part)
            self._stems.update(zip(part, found, strict=True))

    def _learn(self, words: list[str]) -> None:
        if len(self._stems) > HELD_STEMS:
            self._stems.clear()
        held, stems, marks = self._words, self._stems, self._marks
        plain, fresh, rest = [], set(), set()
        for w in words:
            s = w.rstrip(marks)
            if s not in stems and s not in fresh:
                # A word in ASCII letters needs no pattern to be known as one.
                if len(w) > HELD_CHARS or not (s.isascii() and s.isalpha() or _LETTERS(s)):
                    rest.add(w)
                    continue
                s = s.lower() if self.lowers else s
                fresh.add(s)
            plain.append((w, s))
        ends = {w[len(s):] for w, s in plain}
        self._learn_stems(list(fresh.difference(stems)))
        more = list((rest | ends).difference(held))
        held.update(zip(more, self._whole(more), strict=True))
        for w, s in plain:
            held[w] = stems[s] + held[w[len(s):]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text; none for null or a text of white space."""
        if not self.by_words:
            return self._whole([t or "" for t in texts])
        collecting = gc.isenabled()
        gc.disable()  # millions of words, no cycle among them
        try:
            return self._by_words(texts)
        finally:
            if collecting:
                gc.enable()

    def _by_words(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for part in _pieces(texts):
            if len(self._words) > HELD_WORDS:
                self._words.clear()
            lists = pc.ascii_split_whitespace(pa.array([self._lowered(t) if t else "" for t in part], pa.large_string()))
            coded = lists.values.dictionary_encode()
            names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = list(map(self._words.get, names))
            self._learn([w for w, f in zip(names, found, strict=True) if f is None])
            if None in found:
                found = list(map(self._words.__getitem__, names))
            which = coded.indices.to_numpy()
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            start = np.cumsum(size) - size
            n = size[which]
            end = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(start[which] - end[:-1], n) + np.arange(end[-1])
            raw = np.frombuffer(b"".join(found), dtype="<u4")[at].tobytes()
            edge = (4 * end[lists.offsets.to_numpy()]).tolist()
            out += [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        return out

    def _lowered(self, text: str) -> str:
        """In smaller letters, where no character is beyond Latin-1: normalisers only change the case of those."""
        return text.lower() if self.lowers and (text.isascii() or not _BEYOND(text)) else text


def _pieces(texts: list[str | None], chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of bounded length together, or one longer one."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t) if t else 0
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
