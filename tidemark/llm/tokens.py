"""Token ids of whole texts from the tokenizers library, each distinct pre-token encoded once.

A text of Latin letters is split into pre-tokens by the vocabulary's own rule,
applied to columns by Arrow's regular expressions. No rule takes a space and a
character before it together if a word follows, so the rule is applied to
each distinct stretch between spaces once per chunk of texts. Pre-tokens met before are looked up; new
ones go to the vocabulary's model together, as words that are already split,
with a mark between them. Other texts (with characters whose
classes differ between versions of Unicode, the mark, or a special token's own
string) are encoded whole by the library. Either way the ids are
those of ``Tokenizer.encode(text, add_special_tokens=False)``.

The cache lives in the worker process. At CACHED pre-tokens it keeps the more
frequent half at most, so memory does not depend on the number of texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED = 600_000
#: Bytes of text handled at once.
CHUNK_BYTES = 4_000_000
_TOGETHER = 400
#: Stands between pre-tokens.
_MARK = "\x01"
# Up to Latin Extended-B, but for the capital I with a dot, which becomes two characters in lower case.
_OTHER = r"[^\x00-\x{24f}]|\x{130}|\x01"
_SPACE = r"\t-\r \x{85}\x{a0}"
#: The splitting rules of the byte-level and the word vocabulary. Of white space before a word, the last character is apart.
BYTE_RULE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\x01\p{{L}}\p{{N}}]+|[{_SPACE}]+"
BYTE_LAST_SPACE = rf"([{_SPACE}])([{_SPACE}][^{_SPACE}])"
WORD_RULE = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
# A space before white space, or at the end, is no boundary.
_SPACED = rf" ([{_SPACE}]|$)"
_STRIPPED = "\t\n\x0b\x0c\r \x85\xa0"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


_LETTERS = _byte_letters()


class _Numbered(dict):
    """Number of each string; new ones are listed in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, string: str) -> int:
        n = self[string] = len(self)
        self.pending.append(string)
        return n


def _gather(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the numbered strings ``at`` in a row, where each begins and the last ends)."""
    begins, lengths = starts[at], starts[at + 1] - starts[at]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    return ids[np.repeat(begins - ends[:-1], lengths) + np.arange(ends[-1])], ends


class Encoder:
    """Encodes texts. ``spaces``: whether the vocabulary keeps white space (byte level) or drops it (words, lower case)."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaces = spaces
        self.model = Tokenizer(self.tokenizer.model)
        self.mark = _LETTERS[ord(_MARK)]
        (self.mark_id,) = self.model.encode([self.mark], is_pretokenized=True, add_special_tokens=False).ids
        self.known = _Numbered()
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def _trim(self) -> None:
        """Keeps the pre-tokens used twice or more, at most half of CACHED, most used first."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > CACHED // 2:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: CACHED // 2]])
        names = list(self.known)
        self.known = _Numbered()
        self.known.update((names[old], new) for new, old in enumerate(keep))
        self.ids, self.starts = _gather(self.ids, self.starts, keep)
        self.used = np.ones(len(keep), np.int64)

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pre-tokens with the mark's after each, where those are)."""
        words = []
        for i in range(0, len(pieces), _TOGETHER):
            row = []
            for p in pieces[i : i + _TOGETHER]:
                if p:
                    row.append(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS))
                row.append(self.mark)
            words.append(row)
        encoded = self.model.encode_batch_fast(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, np.uint32) for e in encoded)])
        ends = np.flatnonzero(ids == self.mark_id)
        assert len(ends) == len(pieces)
        return ids, ends

    def counts(self, pieces: list[str]) -> list[int]:
        """Number of tokens of each pre-token."""
        marked = [i for i, p in enumerate(pieces) if _MARK in p]
        _, ends = self._together([p if _MARK not in p else "" for p in pieces])
        out = (np.diff(ends, prepend=-1) - 1).tolist()
        for i in marked:
            out[i] = len(self.tokenizer.encode(pieces[i], add_special_tokens=False).ids)
        return out

    def _learn(self) -> None:
        new, self.known.pending = self.known.pending, []
        if not new:
            return
        ids, ends = self._together(new)
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends - np.arange(len(ends))])
        self.ids = np.concatenate([self.ids, ids[ids != self.mark_id]])

    def _pieces(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings in a row, where each begins and the last ends), by way of their pre-tokens."""
        if self.spaces:
            strings = pc.replace_substring_regex(strings, BYTE_LAST_SPACE, r"\1" + _MARK + r"\2")
            strings = pc.replace_substring_regex(strings, BYTE_RULE, _MARK + r"\0")
        else:
            # White space stays behind the pre-token before it and is taken off the distinct ones.
            strings = pc.replace_substring_regex(strings, WORD_RULE, _MARK + r"\0")
        lists = pc.split_pattern(strings, _MARK)
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.__getitem__, names if self.spaces else (p.strip(_STRIPPED) for p in names)), np.int64, len(names))
        at = numbers[coded.indices.to_numpy()]
        self._learn()
        used = np.bincount(at, minlength=len(self.known))
        used[: len(self.used)] += self.used
        self.used = used
        ids, ends = _gather(self.ids, self.starts, at)
        return ids, ends[lists.offsets.to_numpy()]

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_pieces``, where every space is a boundary."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        distinct, at, offsets = coded.dictionary, coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        if self.spaces:
            # Only the first stretch of a text has no space before it.
            first = offsets[:-1]
            heads = distinct.take(pa.array(at[first]))
            at[first] = len(distinct) + np.arange(len(first))
            distinct = pa.concat_arrays([pc.binary_join_element_wise(" ", distinct, ""), heads])
        ids, cuts = self._pieces(distinct)
        ids, ends = _gather(ids, cuts, at)
        return ids, ends[offsets]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        if len(self.known) >= CACHED:
            self._trim()
        given = texts = pc.fill_null(texts.cast(pa.string()), "")
        flags = [pc.match_substring_regex(texts, _OTHER), *(pc.match_substring(texts, s) for s in self.specials)]
        whole = np.logical_or.reduce([f.to_numpy(zero_copy_only=False) for f in flags])
        spaced = pc.match_substring_regex(texts, _SPACED).to_numpy(zero_copy_only=False) & ~whole if self.spaces else np.zeros(len(whole), bool)
        out: list = [None] * len(texts)
        texts = texts if self.spaces else pc.utf8_lower(texts)
        for rows, split in ((~whole & ~spaced, self._stretches), (spaced, self._pieces)):
            if rows.any():
                ids, cuts = split(texts.filter(pa.array(rows)))
                for i, row in enumerate(np.flatnonzero(rows).tolist()):
                    out[row] = ids[cuts[i] : cuts[i + 1]]
        if whole.any():
            encoded = self.tokenizer.encode_batch_fast(given.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
            for row, e in zip(np.flatnonzero(whole).tolist(), encoded):
                out[row] = np.array(e.ids, np.uint32)
        return out

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order, holding CHUNK_BYTES of text at a time or one text."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        begin, ends = 0, np.cumsum(sizes)
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
            yield from self.batch(texts.slice(begin, end - begin))
            begin = end


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One encoder per worker process and file."""
    key = (path, spaces)
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaces)
    return _encoders[key]
