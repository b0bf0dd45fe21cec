"""Token ids of many texts with a public tokenizer, encoding each distinct pre-token once per worker.

A tokenizer cuts a text into pre-tokens and encodes each of them alone. Here
texts of Latin-1 characters are cut by array work on their bytes, the distinct
pre-tokens are found natively, and only those that a worker does not know yet go
to the library. Texts with other characters, or with what could be a special
string, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Pre-tokens of a generation; those found in the last two generations need no encoding.
CACHE = 300_000
#: Pre-tokens longer than this are encoded and not kept.
KEPT = 48
#: Characters that are cut, counted and gathered at once, about.
PORTION = 6 << 20
#: Latin-1 classes of the tokenizers' patterns: other white space, the space, letters, numbers, signs, and the mark between texts.
_BLANK, _SPACE, _LETTER, _NUMBER, _SIGN, _MARK = range(6)
_MARK_BYTE = 0xA0
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _BLANK
_CLASS[0x20] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_CLASS[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_CLASS[_MARK_BYTE] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32
#: What follows an apostrophe that starts a pre-token, as the patterns name it.
_AFTER_APOSTROPHE = ((b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll"))
#: What sends a text to the library: a special string's beginning, the stop, and white space that is not ASCII.
_UNUSUAL = ("<|", "\x01", "\x85", "\xa0")
#: A text may be cut before such a space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def latin(text: str) -> bytes | None:
    """Latin-1 bytes of a text that array work can cut, else nothing."""
    if any(sign in text for sign in _UNUSUAL):
        return None
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def starts_of(data: np.ndarray, keeps_space: bool) -> np.ndarray:
    """Marks the first byte of each pre-token; with ``keeps_space`` a space belongs to what follows it."""
    kind = _CLASS[data]
    before = np.empty_like(kind)
    before[0], before[1:] = _MARK, kind[:-1]
    start = kind != before
    if keeps_space:
        after = np.empty_like(kind)
        after[-1], after[:-1] = _MARK, kind[1:]
        blank, blank_before = kind <= _SPACE, before <= _SPACE
        # The last of several blanks is by itself or goes with what follows; at the end of a text it stays with the others.
        last = blank & blank_before & (after > _SPACE) & (after != _MARK)
        joined = ~blank & (before == _SPACE) & (kind != _MARK)
        start = (start & ~(blank & blank_before) & ~joined) | last
    else:
        start |= kind == _NUMBER
    at = np.flatnonzero((data == 0x27) & start)
    if len(at):
        padded = np.concatenate([data, np.full(3, _MARK_BYTE, dtype=np.uint8)])
        for endings in _AFTER_APOSTROPHE:
            for ending in endings:
                hit = at
                for k, letter in enumerate(ending, 1):
                    hit = hit[padded[hit + k] == letter]
                start[hit + 1] = False
                over = hit + 1 + len(ending)
                start[over[over < len(start)]] = True
    return start


class WordEncoder:
    """Encodes texts to ids.

    ``keeps_space`` says that a word's ids depend on the space before it, as in
    byte-level vocabularies; else white space and case say nothing. Special
    strings in a text are found as the library finds them by default.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.keeps_space = keeps_space
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # A control character is no letter, digit or white space, so between spaces it is a pre-token of its own.
        stop = np.frombuffer(self.whole([" \x01" if keeps_space else "\x01"])[0], dtype="<u4")
        self.stop, self.stop_size = int(stop[-1]), len(stop)
        feed = np.frombuffer(self.whole(["\n"])[0], dtype="<u4")
        self.feed = int(feed[0]) if len(feed) == 1 else -1

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def between(self, words: list[str], joint: str, lead: str, stop: int, size: int) -> Iterable[bytes]:
        """Ids of each word after ``lead``, from one call on all of them; a stop of ``size`` known ids lies between."""
        ids = np.array(self.tokenizer.encode_batch_fast([lead + joint.join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(ids == stop)
        if len(stops) != len(words) - 1:
            return self.whole([lead + w for w in words])
        raw = ids.tobytes()
        return (raw[i:j] for i, j in zip([0, *(4 * (stops + 1)).tolist()], [*(4 * (stops + 1 - size)).tolist(), len(raw)], strict=True))

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of ``words``, pre-tokens as Latin-1."""
        spaced: list[int] = []
        lines: list[int] = []
        alone: list[int] = []
        for i, w in enumerate(words):
            if not self.keeps_space or (w[0] == 0x20 and w[-1] != 0x20):
                spaced.append(i)
            elif _CLASS[w[0]] > _SPACE and self.feed >= 0:
                lines.append(i)
            else:
                alone.append(i)
        out: list[bytes] = [b""] * len(words)
        lead = " " if self.keeps_space else ""
        for held, joint, before, stop, size in ((spaced, " \x01 ", lead, self.stop, self.stop_size), (lines, "\n", "", self.feed, 1)):
            for at in range(0, len(held), 400):
                part = held[at : at + 400]
                texts = [words[i].decode("latin-1")[len(before) :] for i in part]
                for i, ids in zip(part, self.between(texts, joint, before, stop, size), strict=True):
                    out[i] = ids
        for i, ids in zip(alone, self.whole([words[i].decode("latin-1") for i in alone]), strict=True):
            out[i] = ids
        return out

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens, from the last two generations where they are known."""
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        found = list(map(cache.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        unknown = []
        for i in missing:
            ids = older.get(words[i])
            if ids is None:
                unknown.append(i)
            else:
                found[i] = cache[words[i]] = ids
        for i, ids in zip(unknown, self.learn([words[i] for i in unknown]), strict=True):
            found[i] = ids
            if len(words[i]) <= KEPT:
                cache[words[i]] = ids
        return found

    def encode_latin(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text of Latin-1 bytes without ``_MARK_BYTE``."""
        data = np.frombuffer(bytes([_MARK_BYTE]).join([*texts, b""]), dtype=np.uint8)
        if not self.keeps_space:
            data = _LOWER[data]
        first = np.flatnonzero(starts_of(data, self.keeps_space))
        kind = _CLASS[data[first]]
        marks = np.flatnonzero(kind == _MARK)
        if len(marks) != len(texts):  # marks without text between them are one run
            marks = np.flatnonzero(data == _MARK_BYTE)
            first = np.union1d(first, marks)
            kind = _CLASS[data[first]]
            marks = np.flatnonzero(kind == _MARK)
        wanted = kind != _MARK if self.keeps_space else (kind != _MARK) & (kind > _SPACE)
        sizes = np.diff(np.append(first, len(data)))
        if not self.keeps_space or not wanted.all():
            data = data[np.repeat(wanted, sizes)]
        ends = np.cumsum(np.where(wanted, sizes, 0))[wanted]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        code = words.indices.to_numpy()
        found = self.ids_of(words.dictionary.to_pylist())
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        each = size[code]
        place = np.cumsum(each)
        if len(code):
            ids = flat[np.repeat((np.cumsum(size) - size)[code] - (place - each), each) + np.arange(int(place[-1]))]
        else:
            ids = flat[:0]
        # Ids up to each mark.
        kept = np.cumsum(wanted)[marks]
        cuts = np.concatenate([[0], place])[kept]
        return np.split(ids, cuts)[: len(texts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; pass a few MB at once."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[tuple[int, bytes]] = []
        for i, t in enumerate(texts):
            raw = latin(t)
            if raw is None:
                out[i] = np.frombuffer(self.whole([t])[0], dtype="<u4")
            else:
                plain.append((i, raw))
        if plain:
            for (i, _), ids in zip(plain, self.encode_latin([raw for _, raw in plain]), strict=True):
                out[i] = ids
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each of any number of texts of any length; null is the empty text.

        A long text is cut before single spaces, where no pre-token, special
        string or composed character goes on.
        """
        held: list[str] = []
        of: list[int] = []
        size = 0
        ready: dict[int, list[np.ndarray]] = {}
        done = 0

        def flush() -> None:
            for i, ids in zip(of, self.encode(held), strict=True):
                ready.setdefault(i, []).append(ids)
            held.clear()
            of.clear()

        for i, t in enumerate(texts):
            for part in parts_of(t or ""):
                held.append(part)
                of.append(i)
                size += len(part) + 1
                if size >= PORTION:
                    flush()
                    size = 0
            while done < i and done not in of:
                yield _joined(ready.pop(done))
                done += 1
        flush()
        for i in range(done, len(texts)):
            yield _joined(ready.pop(i))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def parts_of(text: str) -> Iterator[str]:
    """``text`` in parts of about ``PORTION`` characters."""
    at = 0
    while len(text) - at > PORTION and (m := _CUT.search(text, at + PORTION)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def release(path: str, keeps_space: bool) -> None:
    """Lets go of a worker's words, which it else keeps for its next task."""
    encoder = word_encoder(path, keeps_space)
    encoder.cache, encoder.older = {}, {}


@lru_cache(maxsize=4)
def word_encoder(path: str, keeps_space: bool) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    return WordEncoder(path, keeps_space)


def portions(texts: list[str | None], limit: int = 4 << 20):
    """Runs of about ``limit`` characters, null as the empty text."""
    part: list[str] = []
    held = 0
    for t in texts:
        part.append(t or "")
        held += len(part[-1]) + 1
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part
