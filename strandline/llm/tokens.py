"""Ids of whole texts by a tokenizer file, through a cache of pre-tokens.

The library encodes each pre-token by itself, so a text's ids are its pre-tokens' ids
in order.  For texts of common Latin characters the pre-tokens are found here, by the
file's own rule, and each distinct one goes through the library once.  Texts with any
other character, or that may hold a special token's string, go through it whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandline.llm import common

#: Pre-tokens that a worker keeps; of chunks, half as many.
CACHE_ENTRIES = 1_500_000

# Letters and numbers among the characters of _PLAIN, as Unicode has them.
_L = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įĲ-ſ"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Any character outside of this leaves a text to the library.  No white space but these four, no U+0130.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ſ]|<\|")
#: Of these bytes a text of ASCII may hold all.
_EVEN = bytes([9, 10, 13, *range(0x20, 0x7F)])
_BYTE_RULE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_RULE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """``encode(texts)`` gives an array of ids for each; special tokens' strings are ordinary text.

    A text is cut at its spaces; a space belongs to the pre-token after it, so the
    chunks' ids are independent unless two spaces follow each other (such texts go
    through the library).  The distinct chunks of all texts at hand are looked up, new ones
    are cut into pre-tokens, and only new pre-tokens reach the library.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rule, self.words = self._rule(spec.get("normalizer"), spec.get("pre_tokenizer") or {})
        self.marks = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.marks[[k for t, k in self.tokenizer.get_vocab().items() if (t.endswith("</w>") if self.words else t[:1] == "Ġ")]] = True
        self.chunks, self.pieces, self.entries = {}, {}, entries

    @staticmethod
    def _rule(normalizer, pre) -> tuple[re.Pattern | None, bool]:
        if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            return _BYTE_RULE, False
        steps = [x.get("type") for x in (normalizer or {}).get("normalizers", [])]
        first = (pre.get("pretokenizers") or [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == _WORD_PATTERN and first.get("invert") and first.get("behavior") == "Removed":
            return _WORD_RULE, True
        return None, False

    def _ready(self, text: str) -> str | None:
        """The text as its chunks are parted by single spaces (white space in lower case for words), or None if the library takes it whole."""
        if self.rule is None:
            return None
        if text.isascii():
            if text.encode().translate(None, _EVEN) or "<|" in text:
                return None
        elif _ODD.search(text):
            return None
        if self.words:
            return text.lower()
        return None if "  " in text else "\0" + text  # no space before the first chunk

    def _word(self, piece: str) -> bool:
        """Letters after one space (or letters alone, where white space is dropped): such pieces part cleanly in a row."""
        return piece.isalpha() if self.words else piece[:1] == " " and piece[1:].isalpha()

    def _ask(self, pieces: list[str], together: int, into: dict[str, bytes]) -> None:
        """Adds the library's ids of pieces, so many words in one text; ids that only a word's start or end can give part them again."""
        for i in range(0, len(pieces), 4096 * together):
            some = pieces[i : i + 4096 * together]
            rows = [some[j : j + together] for j in range(0, len(some), together)]
            joint = [(" " if self.words else "").join(r) for r in rows]
            for row, e in zip(rows, self.tokenizer.encode_batch_fast(joint, add_special_tokens=False)):
                ids = np.array(e.ids, dtype=self.dtype)
                if len(row) == 1:
                    into[row[0]] = ids.tobytes()
                    continue
                mark = np.flatnonzero(self.marks[ids])
                # A word ends with its mark, a word with a space begins with it.
                ends = mark + 1 if self.words else np.append(mark[1:], len(ids))
                first, last = np.append(0, ends[:-1]), ends
                if len(mark) != len(row) or ends[-1] != len(ids):
                    self._ask(row, 1, into)
                    continue
                data, width = ids.tobytes(), self.dtype.itemsize
                into.update(zip(row, map(data.__getitem__, map(slice, (first * width).tolist(), (last * width).tolist()))))

    def _learned(self, new: list[str]) -> list[bytes]:
        """The ids of chunks that aren't kept yet; they are kept if there is room."""
        cut, lead = self.rule.findall, "" if self.words else " "
        # Most chunks are one word; only others are cut by the rule.
        pieces = [[lead + c] if c.isalpha() else cut(c[1:] if c[:1] == "\0" else lead + c) for c in new]
        unknown = {p for ps in pieces for p in ps if p not in self.pieces}
        one, words, more = [], [], {}
        for p in unknown:
            (words if self._word(p) else one).append(p)
        self._ask(one, 1, more)
        self._ask(words, 1000, more)
        # Frequent pieces come early; those for which there is no room are asked for anew.
        if len(self.pieces) + len(more) <= self.entries:
            self.pieces.update(more)
        kept = self.pieces
        get = lambda p: more[p] if p in more else kept[p]
        ids = [get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps)) for ps in pieces]
        if len(self.chunks) + len(new) <= self.entries // 2:
            self.chunks.update(zip(new, ids))
        return ids

    def _looked_up(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of ready texts: each distinct chunk is looked up once, then ids are gathered by the chunks' numbers."""
        parted = (pc.ascii_split_whitespace if self.words else partial(pc.split_pattern, pattern=" "))(pa.array(texts, pa.large_string()))
        coded = parted.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.chunks.get, distinct))
        lacks = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(lacks, self._learned([distinct[k] for k in lacks])):
            found[k] = x
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        pool, starts = np.frombuffer(b"".join(found), self.dtype), np.cumsum(lengths) - lengths
        number = coded.indices.to_numpy()
        size = lengths[number]
        ends = np.cumsum(size)
        every = pool[np.repeat(starts[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[parted.offsets.to_numpy()].tolist()
        return [every[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list = [self._ready(t) for t in texts]
        split = [k for k, x in enumerate(found) if x is not None]
        whole = [k for k, x in enumerate(found) if x is None]
        if split:
            for k, x in zip(split, self._looked_up([found[k] for k in split])):
                found[k] = x
        if whole:
            for k, e in zip(whole, self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)):
                found[k] = np.array(e.ids, dtype=self.dtype)
        return found


_encoders: dict[tuple[str, int], Encoder] = {}
common.kept.append(_encoders)


def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """The worker's encoder for ``path``: loaded once, its cache outlives a task, until one of another operator begins."""
    if (path, entries) not in _encoders:
        _encoders[path, entries] = Encoder(path, entries)
    return _encoders[path, entries]


def chunks(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``most`` characters, with the place of the first; nulls are empty."""
    at, size, some = 0, 0, []
    for k, t in enumerate(texts):
        some.append(t or "")
        size += len(some[-1])
        if size >= most:
            yield at, some
            at, size, some = k + 1, 0, []
    if some:
        yield at, some


def released() -> None:
    """As in ``common``, but encoders stay."""
    common.released(_encoders)
