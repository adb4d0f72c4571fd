"""Whole-text encoding with the tokenizers library, each distinct word encoded once per worker.

The two public BPE layouts split a text into words before any merge is applied, so the ids of a text are the
ids of its words in order. ``WordEncoder`` cuts texts where such a split is certain, reduces the words of a slice to
distinct ones (Arrow does both), parts each from the marks behind its last letter, looks known parts up by a 128-bit
hash and sends unknown ones through the library in one call. Texts with unusual white space go through the library in
parts, cut at single blanks between ASCII letters.

Memory is bounded in bytes: the ids of known parts, the parts' table and the characters given to the library in one
call all have limits. Only a text without any certain cut, or a single word, goes to the library at its full length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21  # characters encoded at a time; a longer text is a slice of its own
_CALL = 1 << 18  # characters given to the library at a time
_RARE_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_SURE_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_CONTROL = "\0\x02\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_MARK = "\x01"
_FIRST = "\x02"
_MOST_TAIL = 7  # marks behind a word that are parted from it
_LONG = 512  # bytes of a word from which it is hashed on its own
_BYTES = [chr(i) for i in range(128)]
_IS_TAIL = np.array([c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in _BYTES] + [False] * 128)
_IS_LETTER = np.array([c.isalnum() for c in _BYTES] + [False] * 128)
# second bytes of the Latin-1 letters that begin with 0xC3 in UTF-8; the two signs among them aren't letters
_IS_SECOND = np.array([0x80 <= i < 0xC0 and i not in (0x97, 0xB7) for i in range(256)])


def _mixed(h: np.ndarray, x: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ x) * np.uint64(factor)
    return h ^ (h >> np.uint64(29))


def _lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as a number; ``data`` ends with eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def _low_bytes(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first ``n`` bytes (at most 8) of each number."""
    return x & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(n, 8).astype(np.uint64)))


def hashes_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word ``data[start:start + length]``, eight bytes a step; ``length`` is 1 at least."""
    lanes = _lanes(data)
    a, b = (_mixed(length.astype(np.uint64), np.uint64(seed), f) for seed, f in ((0x243F6A8885A308D3, 0x9E3779B97F4A7C15), (0x13198A2E03707344, 0xC2B2AE3D27D4EB4F)))
    left = np.where(length > _LONG, 0, length)
    own, at = np.flatnonzero(left > 0), 0
    while len(own):
        x = _low_bytes(lanes[start[own] + at], left[own] - at)
        a[own], b[own] = _mixed(a[own], x, 0xBF58476D1CE4E5B9), _mixed(b[own], x, 0x94D049BB133111EB)
        at += 8
        own = own[left[own] > at]
    for i in np.flatnonzero(length > _LONG).tolist():
        d = hashlib.blake2b(data[start[i] : start[i] + length[i]].tobytes(), digest_size=16).digest()
        a[i], b[i] = np.frombuffer(d, np.uint64)
    return a, b


class _Table:
    """Ids of parts by their hashes. ``rows`` finds parts, ``add`` appends some; row 0 is the empty part."""

    def __init__(self) -> None:
        self.key, self.check, self.row = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.start, self.count, self.hits = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.flat = np.empty(1 << 16, np.uint32)
        self.size, self.used = 1, 0

    def rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of each part, -1 for unknown ones."""
        if not len(self.key):
            return np.full(len(a), -1, np.int64)
        order = np.argsort(a)
        at = np.empty(len(a), np.int64)
        at[order] = np.searchsorted(self.key, a[order])
        at[at == len(self.key)] = 0
        return np.where((self.key[at] == a) & (self.check[at] == b), self.row[at], -1).astype(np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Appends distinct unknown parts with their ids, one after the other; gives their rows."""
        n, m = self.size, len(counts)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + m > len(self.start):
            self.start, self.count, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.hits))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(counts) - counts
        self.count[n : n + m] = counts
        self.used += len(ids)
        self.size += m
        rows = np.arange(n, n + m)
        order = np.argsort(a)
        at = np.searchsorted(self.key, a[order])
        self.key, self.check, self.row = (np.insert(x, at, y[order]) for x, y in ((self.key, a), (self.check, b), (self.row, rows.astype(np.int32))))
        return rows

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after the other, and the place behind each part's ids."""
        count = self.count[rows]
        ends = np.cumsum(count, dtype=np.int64)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        at += np.repeat(self.start[rows] - ends + count, count)
        return self.flat[at], ends

    def thinned(self, most: int, most_ids: int) -> _Table:
        """A table of the parts met most often, half of the limits at the most; their counts are halved."""
        order = np.argsort(-self.hits[self.row], kind="stable")[: most // 2]
        order = order[np.cumsum(self.count[self.row[order]]) <= most_ids // 2]
        rows, new = self.row[order].astype(np.int64), _Table()
        kept = new.add(self.key[order], self.check[order], self.gathered(rows)[0], self.count[rows])
        new.hits[kept] = self.hits[rows] // 2
        return new


class WordEncoder:
    """``encode(texts)`` gives all ids as one uint32 array and the count of ids of each text.

    :param tokenizer_json: contents of a tokenizer file
    :param max_words: parts remembered, thinned when there are more (about 50 bytes each)
    :param max_ids: ids remembered, thinned when there are more (4 bytes each)
    """

    def __init__(self, tokenizer_json: str, max_words: int = 1_000_000, max_ids: int = 6_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.max_words, self.max_ids = max_words, max_ids
        self.mode = self._layout(json.loads(tokenizer_json))
        self.table = _Table()

    def _layout(self, spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        mode = "plain"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            mode = "space"
        elif norm and norm.get("type") == "Sequence" and {x["type"] for x in norm["normalizers"]} == {"NFC", "Replace", "Lowercase"}:
            first = (pre.get("pretokenizers") or [{}])[0]
            if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
                mode = "word"
        if mode != "plain":
            ids = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
            letter = "ā" if mode == "space" else None
            names = spec["model"]["vocab"]
            if letter is None:
                letter = next(t for t, i in names.items() if i == ids[0]).removesuffix("</w>")
            if len(ids) != 1 or sum(letter in t for t in names) > 2:
                return "plain"
            self.mark = ids[0]
            # ids that begin a word with a space before it, or end a word
            self.edge = np.zeros(max(names.values()) + 1, bool)
            self.edge[[i for t, i in names.items() if (t[0] == "\u0120" if mode == "space" else t.endswith("</w>"))]] = True
        return mode

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text from the library, a bounded number of characters at a time."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= _CALL:
                size += len(texts[end])
                end += 1
            out += [np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def _cuts(self, text: str) -> Iterator[str]:
        """Parts of a text that give its ids one after the other: cut before single blanks between ASCII letters."""
        at = 0
        while len(text) - at > _CALL and (m := _SURE_CUT.search(text, at + _CALL // 2)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        if self.mode == "plain":
            return self._plain(texts)
        return [np.concatenate(self._plain(list(self._cuts(t)))) for t in texts]

    def _prepared(self, text: str) -> str | None:
        """A text as it is cut at spaces, or None where the places of word boundaries aren't certain."""
        if not text.isascii() and _RARE_SPACE.search(text):
            return None
        if self.mode == "word":
            if any(c in text for c in "\x1c\x1d\x1e\x1f\0"):
                return None
            try:
                text.encode("latin-1")
                return text.lower()
            except UnicodeEncodeError:
                return text
        if not text:
            return ""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return None
        if any(c in text for c in _CONTROL):
            return None
        return _FIRST + text.replace("\n", " \n")

    def _spelled(self, word: str) -> str:
        """A part as the text that stands for it."""
        if self.mode == "word" or word[0] == "\n":
            return word
        return word[1:] if word[0] == _FIRST else " " + word

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct parts in the order they were encoded, their ids one after the other, and how many each has."""
        if self.mode == "space":
            plain = str.isalpha
        else:
            plain = lambda w: w.isalpha() and (w.islower() if w.isascii() else w == w.lower() and max(w) < "\u0100")
        letters, joinable, alone = [], [], []
        for i, w in enumerate(words):
            if plain(w):
                letters.append(i)
            else:
                shown = self._spelled(w)
                (alone if w[0] == _FIRST or _MARK in shown or shown[0] == "'" or len(w) > _CALL else joinable).append(i)
        order, found, counts = [], [], []
        # letters alone are one word to the library, so the ids themselves tell where words begin or end
        for own in self._runs(letters, words):
            text = " ".join(words[i] for i in own)
            ids = self._plain([" " + text if self.mode == "space" else text])[0]
            edge = np.flatnonzero(self.edge[ids])
            if len(edge) == len(own):
                order += own
                found.append(ids)
                counts.append(np.diff(np.append(edge, len(ids))) if self.mode == "space" else np.diff(np.concatenate([[-1], edge])))
            else:
                joinable += own
        glue = f" {_MARK} " if self.mode == "word" else _MARK
        for own in self._runs(joinable, words):
            ids = self._plain([glue.join(self._spelled(words[i]) for i in own)])[0]
            is_mark = ids == self.mark
            cuts = np.flatnonzero(is_mark)
            if len(cuts) == len(own) - 1:
                order += own
                found.append(ids[~is_mark])
                counts.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:
                alone += own
        if alone:
            order += alone
            rows = self._plain([self._spelled(words[i]) for i in alone])
            found += rows
            counts.append(np.fromiter(map(len, rows), np.int64, len(rows)))
        return np.array(order, np.int64), np.concatenate(found), np.concatenate(counts)

    @staticmethod
    def _runs(places: list[int], words: list[str]) -> Iterator[list[int]]:
        """Cuts a list of words into runs of about ``_CALL`` characters."""
        start = size = 0
        for k, i in enumerate(places):
            size += len(words[i]) + 4
            if size > _CALL:
                yield places[start : k + 1]
                start, size = k + 1, 0
        if start < len(places):
            yield places[start:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.mode == "plain":
            pieces = self._plain(texts)
            return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        if self.table.size > self.max_words or self.table.used > self.max_ids:
            self.table = self.table.thinned(self.max_words, self.max_ids)
        ready = [self._prepared(t) for t in texts]
        odd = [i for i, u in enumerate(ready) if u is None]
        column = pa.array([u or "" for u in ready], pa.large_string())
        del ready
        split = pc.ascii_split_whitespace(column) if self.mode == "word" else pc.split_pattern(column, " ")
        coded = split.values.dictionary_encode()
        place = coded.indices.to_numpy()
        core, tail = self._halves(coded.dictionary)
        rows = np.empty(2 * len(place), np.int32)
        rows[0::2], rows[1::2] = core[place], tail[place]
        self.table.hits[: self.table.size] += np.bincount(rows, minlength=self.table.size).astype(np.int32)
        flat, ends = self.table.gathered(rows)
        at = np.concatenate([[0], ends])[2 * split.offsets.to_numpy().astype(np.int64)]
        if odd:
            whole = dict(zip(odd, self._whole([texts[i] for i in odd]), strict=True))
            pieces = [whole[i] if i in whole else flat[at[i] : at[i + 1]] for i in range(len(texts))]
            return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        return flat, np.diff(at)

    def _found(self, names: pa.Array) -> np.ndarray:
        """Rows of distinct parts; unknown ones are encoded."""
        n, wide, buffers = len(names), pa.types.is_large_string(names.type), names.buffers()
        offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, n + 1, names.offset * (8 if wide else 4)).astype(np.int64)
        data = np.concatenate([np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)])
        start, length = offsets[:-1] - offsets[0], np.diff(offsets)
        row = np.zeros(n, np.int64)
        some = np.flatnonzero(length)
        a, b = hashes_of(data, start[some], length[some])
        row[some] = self.table.rows(a, b)
        missed = np.flatnonzero(row < 0)
        if len(missed):
            fresh = names.take(pa.array(missed)).cast(pa.large_string())
            # no part has a blank in it
            words = pc.binary_join(pa.ListArray.from_arrays([0, len(fresh)], fresh), pa.scalar(" ", fresh.type))[0].as_py().split(" ")
            order, ids, counts = self._encoded(words)
            at = np.searchsorted(some, missed)[order]
            row[missed[order]] = self.table.add(a[at], b[at], ids, counts)
        return row

    def _halves(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each distinct word without the marks behind its last letter, and of those marks (0: none)."""
        n, buffers = len(words), words.buffers()
        offsets = np.frombuffer(buffers[1], np.int64, n + 1, words.offset * 8)
        data = np.concatenate([np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)])
        offsets = offsets - offsets[0]
        start, end = offsets[:-1], offsets[1:].copy()
        more = np.flatnonzero(end > start)
        for _ in range(_MOST_TAIL):
            more = more[_IS_TAIL[data[end[more] - 1]]]
            end[more] -= 1
            more = more[end[more] > start[more]]
            if not len(more):
                break
        # a cut is certain behind a letter or digit
        last, two = data[np.maximum(end - 1, 0)], data[np.maximum(end - 2, 0)]
        sure = (end > start) & (_IS_LETTER[last] | (end - start > 1) & (two == 0xC3) & _IS_SECOND[last])
        end = np.where(sure, end, offsets[1:])
        length = offsets[1:] - end
        cut = np.flatnonzero(length)
        kept = np.ones(len(data) - 8, bool)
        for k in range(_MOST_TAIL):
            own = cut[length[cut] > k]
            kept[end[own] + k] = False
        shorter = np.concatenate([[0], np.cumsum(end - start)])
        cores = pa.LargeStringArray.from_buffers(n, pa.py_buffer(shorter.tobytes()), pa.py_buffer(data[:-8][kept].tobytes())).dictionary_encode()
        core = self._found(cores.dictionary)[cores.indices.to_numpy()]
        tail = np.zeros(n, np.int64)
        if len(cut):
            marks, own = np.unique(_low_bytes(_lanes(data)[end[cut]], length[cut]), return_inverse=True)
            first = _FIRST if self.mode == "space" else ""
            names = [first + x.tobytes().rstrip(b"\0").decode() for x in marks]
            tail[cut] = self._found(pa.array(names, pa.large_string()))[own]
        return core, tail


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """The worker's encoder for a tokenizer; it lives as long as the worker."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def tokenizer_file(name: str) -> str:
    """Contents of an installed public tokenizer file, read on the driver and sent along with the job."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()
