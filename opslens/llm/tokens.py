"""Token ids of whole texts by a public tokenizer file, encoding every distinct word once per task.

The tokenizers library encodes a text pre-token by pre-token, so the ids of a text are the ids of its
pre-tokens in a row.  For texts of characters below U+0250 the pre-tokens are found with the vocabulary's own
pattern, the distinct ones of many texts looked up among those met before, and new ones encoded by the library.
All other texts, and texts that hold a special token's string, go to the library as a whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pre-tokens that a worker remembers, about.
KEPT = 800_000
#: Characters of the texts whose words are looked up together, words whose ids are put together, and words whose
#: bytes become characters together, about.
LOT = 1 << 22
BLOCK = 1 << 15
SPELLED = 2_000

# The pre-token patterns of the two vocabularies, {L} for letters and {N} for numbers.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
FAMILIAR = 0x250


def _pattern(text: str) -> re.Pattern:
    members = {k: "".join(re.escape(chr(c)) for c in range(FAMILIAR) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(text.replace("{L}", members["L"]).replace("{N}", members["N"]))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges (start, length), one range behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Known(dict):
    """A number for each key, whose ids lie in ``pool``; numbers of new keys get their ids by :meth:`settle`."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], split: Callable[[str], list[str]], kept: int):
        super().__init__()
        self.encode, self.split, self.kept = encode, split, kept
        self.new: list[str] = []
        self.new_at: list[int] = []
        self.joint: list[int] = []
        self.joint_sizes: list[int] = []
        self.joint_at: list[int] = []
        self.pool = np.empty(0, np.uint32)
        self.start, self.length, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def __missing__(self, key: str) -> int:
        parts = self.split(key)
        joint = [] if len(parts) == 1 else [self[p] for p in parts]
        number = self[key] = len(self)
        if len(parts) == 1:
            self.new.append(key)
            self.new_at.append(number)
        else:
            self.joint += joint
            self.joint_sizes.append(len(joint))
            self.joint_at.append(number)
        return number

    def _add(self, at: list[int], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.start[at] = len(self.pool) + np.cumsum(lengths) - lengths
        self.length[at] = lengths
        self.pool = np.concatenate([self.pool, ids])

    def settle(self) -> None:
        more = np.zeros(len(self) - len(self.start), np.int64)
        self.start, self.length, self.uses = (np.concatenate([x, more]) for x in (self.start, self.length, self.uses))
        if self.new:
            self._add(self.new_at, *self.encode(self.new))
        if self.joint_at:
            joint = np.array(self.joint, np.int64)
            lengths = self.length[joint]
            ends = np.append(0, np.cumsum(lengths))[np.cumsum([0, *self.joint_sizes])]
            self._add(self.joint_at, self.pool[ranges(self.start[joint], lengths)], np.diff(ends))
        for held in (self.new, self.new_at, self.joint, self.joint_sizes, self.joint_at):
            held.clear()

    def placed(self, keys: list[str], uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, pool) of the ids of these keys; may forget what is used least afterwards."""
        numbers = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        self.settle()
        self.uses[numbers] += uses
        found = self.start[numbers], self.length[numbers], self.pool
        if len(self) > self.kept:
            self._forget()
        return found

    def _forget(self) -> None:
        """Only keys used more than once since the last time stay, half of ``kept`` at most."""
        stay = np.flatnonzero(self.uses > 1)
        if len(stay) > self.kept // 2:
            stay = np.sort(stay[np.argsort(-self.uses[stay], kind="stable")[: self.kept // 2]])
        keys = list(self)
        self.pool = self.pool[ranges(self.start[stay], self.length[stay])]
        self.length = self.length[stay]
        self.start, self.uses = np.cumsum(self.length) - self.length, np.zeros(len(stay), np.int64)
        self.clear()
        self.update((keys[k], i) for i, k in enumerate(stay.tolist()))


class Encoder:
    """``ids`` equals the library's ids without added special tokens."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self.tokenizer.normalizer is not None
        # What is left to do for a pre-token: its bytes' characters and the merges. No text has the byte FF; it stands between words.
        self.merges = self.tokenizer.model.tokenize
        self.letters = np.array([_byte_letters().get(b, b) for b in range(255)] + [0x20], "<u4")
        self.find = _pattern(WORD_PATTERN if self.lower else BYTE_PATTERN).findall
        self.marks = {t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()}
        # Dotted capital I has two characters in lower case; 1C to 1F are white space to one library only.
        self.odd = re.compile("[^\\x00-\\x1b\\x20-\\u024f]|İ").search
        self.known = _Known(self._encoded, self._parts, kept)

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.ids_of([text]))

    def ids_of(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; some texts are read ahead."""
        held: list[str | np.ndarray] = []  # texts to be looked up, ids of the others
        size = 0
        for text in texts:
            low = (text or "").lower() if self.lower else text or ""
            if self._is_odd(text or "") or any(m in low for m in self.marks):
                held.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                held.append(low)
            size += len(low)
            if size >= LOT:
                yield from self._looked_up(held)
                held, size = [], 0
        yield from self._looked_up(held)

    def _looked_up(self, held: list[str | np.ndarray]) -> Iterator[np.ndarray]:
        texts = [x for x in held if isinstance(x, str)]
        if self.lower:
            # No pre-token of this vocabulary reaches over white space: what stands between is looked up whole.
            made = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
            words, bounds = made.flatten(), made.offsets.to_numpy()
        else:
            found = [self.find(x) for x in texts]
            words, bounds = pa.array([w for x in found for w in x], pa.large_string()), np.cumsum([0, *map(len, found)])
        words = words.dictionary_encode()
        which = words.indices.to_numpy()
        start, length, pool = self.known.placed(words.dictionary.to_pylist(), np.bincount(which, minlength=len(words.dictionary)))
        done = end = 0
        for x in held:
            if not isinstance(x, str):
                yield x
                continue
            if done == end:
                begin, end = done, max(done + 1, int(np.searchsorted(bounds, bounds[done] + BLOCK, "right")) - 1)
                block = which[bounds[begin] : bounds[end]]
                lengths = length[block]
                ids = pool[ranges(start[block], lengths)]
                cuts = np.append(0, np.cumsum(lengths))[bounds[begin : end + 1] - bounds[begin]].tolist()
            yield ids[cuts[done - begin] : cuts[done - begin + 1]]
            done += 1

    def _is_odd(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.odd(text) is not None
        return any(c in text for c in "\x1c\x1d\x1e\x1f")

    def _parts(self, text: str) -> list[str]:
        """The pre-tokens of what stands between white space."""
        return self.find(text) if self.lower and not text.isalpha() else [text]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pre-tokens in a row, and how many each has."""
        ids, counts = array("I"), []
        for i in range(0, len(words), SPELLED):
            joined = b"\xff".join([w.encode() for w in words[i : i + SPELLED]])
            for word in self.letters[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le").split(" "):
                found = [t.id for t in self.merges(word)]
                ids.extend(found)
                counts.append(len(found))
        return np.frombuffer(ids, np.uint32), np.array(counts, np.int64)


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte: itself if it can be seen, else the next one from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in seen)}


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker, so that its words are known to the next task."""
    return Encoder(path)
