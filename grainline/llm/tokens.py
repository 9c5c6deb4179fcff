"""Token ids of whole texts by a public tokenizer, one library call for many distinct pieces of text.

A text is cut where neither of the supported pre-tokenizers lets a token cross, so the ids of the pieces,
joined, are the ids of the text; a piece repeats far more often than a text does, and a bounded cache keeps
its ids. Characters have a class: letter, mark (punctuation and symbols, not the apostrophe of contractions),
ASCII digit, space, line end, or other. Cuts lie between a letter, a mark and a digit; before a single space
and around a single line end that stand between two of these. There is none next to any other character
(runs of white space, combining marks, characters that normalising or lower-casing takes apart), and none in
a text that may hold a special token. Capitals before a combining mark keep their case until the library composes them.

Memory is bounded by bytes: texts are encoded ``SLICE_BYTES`` at a time (one text at least) and the cache
starts again beyond ``CACHE_BYTES``, by its entries' estimated size.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import tidy

#: Bytes of texts encoded together, and of the cache before it starts again.
SLICE_BYTES, CACHE_BYTES = 3_000_000, 60_000_000
#: What a cache entry costs besides its text and ids: a dictionary slot, a string's head, two numbers.
ENTRY = 150
#: Pieces joined in one library call.
JOINED = 200
#: The vocabularies' own end mark; every special token begins with ``SPECIAL``.
MARK, SPECIAL = "<|endoftext|>", "<|"
OTHER, LETTER, SIGN, DIGIT, SPACE, LINE = range(6)


def _classes() -> np.ndarray:
    """The class of every code point below 0x10000. Unicode 3.2 decides, which libraries of any age agree on."""
    old, out = unicodedata.ucd_3_2_0.category, np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        kind = old(c)[0]
        if kind not in "LPS" or kind != unicodedata.category(c)[0] or c == "'" or 0x1100 <= i < 0x1200:
            continue
        if unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1:
            out[i] = LETTER if kind == "L" else SIGN
    out[0x30:0x3A], out[0x20], out[0x0A] = DIGIT, SPACE, LINE
    return out


class Encoder:
    """Encodes batches of texts; ``spaced`` says that the space before a word counts (byte-level vocabularies)."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.spaced = Tokenizer.from_file(path), spaced
        self.mark = self.model.token_to_id(MARK)
        #: The type of ids: as wide as the vocabulary needs.
        self.kind = np.uint16 if max(self.model.get_vocab().values()) < 1 << 16 else np.uint32
        self.core = self.model.model.tokenize
        # byte-level alphabets: a printable character stands for its byte, others follow from 256 on
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [x for x in range(0x100) if x not in plain]
        letters = [chr(0x100 + rest.index(x) if x in rest and x != 0x0A else x).encode() for x in range(0x100)]
        self.gap = letters[0x20].decode()
        # their UTF-8, one or two bytes each
        self.pairs = np.array([[x[0], x[-1]] for x in letters], np.uint8)
        self.used = np.array([[True, len(x) > 1] for x in letters])
        self.classes = _classes()
        #: Whether texts are cut at all: not by a vocabulary that works in another way.
        self.special = all(x.content.startswith(SPECIAL) for x in self.model.get_added_tokens_decoder().values()) and self._fits()
        self.ascii = bytes(self.classes[:128]) + bytes(128)
        self._reset()

    def _reset(self):
        self.known: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids, self.n, self.held = np.zeros(1 << 16, self.kind), 0, 0

    def _fits(self) -> bool:
        probe = ["word", "Été", "...", "»", "7"] + ([" word", " Été", " &", " 123"] if self.spaced else [])
        try:
            return all([t.id for t in self.core(self._mapped(x if self.spaced else x.lower()))] == self.model.encode(x, add_special_tokens=False).ids for x in probe)
        except Exception:  # noqa: BLE001 - models of other kinds raise what they like
            return False

    # cutting ----------------------------------------------------------------------------------------------

    def _class(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character, with one more byte of no class at either end."""
        c = np.zeros(len(data) + 2, np.uint8)
        own = c[1:-1]
        own[:] = np.frombuffer(data.tobytes().translate(self.ascii), np.uint8)
        high = np.flatnonzero(data >= 0xC0)
        if len(high):
            lead = data[high]
            for at, more in ((high[lead < 0xE0], 1), (high[(lead >= 0xE0) & (lead < 0xF0)], 2)):
                code = (data[at] & (0x1F if more == 1 else 0x0F)).astype(np.int32)
                for j in range(1, more + 1):
                    code = code << 6 | (data[at + j] & 0x3F)
                k = self.classes[code]
                for j in range(more + 1):
                    own[at + j] = k
        return c

    def _cut(self, texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All pieces one after the other, and where each text's begin (and the end)."""
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first, size = int(off[0]), int(off[-1] - off[0])
        if not size:
            return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
        body = texts.buffers()[2].slice(first, size)
        off = off - first
        c = self._class(np.frombuffer(body, np.uint8))
        fine = (c - np.uint8(1)) < 3
        before, own, after = fine[:-2], c[1:-1], fine[2:]
        cut = before & fine[1:-1] & (own != c[:-2])
        between = before & after
        cut |= (own == SPACE) & between
        line = (own == LINE) & between
        cut |= line
        cut[1:] |= line[:-1]
        for i in np.flatnonzero(whole).tolist():
            cut[off[i] : off[i + 1]] = False
        full = off[1:] > off[:-1]
        cut[off[:-1][full]] = True
        at = np.append(np.flatnonzero(cut), size).astype(np.int32)
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), body), np.searchsorted(at, off)

    # learning ---------------------------------------------------------------------------------------------

    def _single(self, words: pa.Array) -> np.ndarray:
        """Which pieces are one pre-token: a space at most, then letters, marks or digits only."""
        off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        first = int(off[0])
        c = self._class(np.frombuffer(words.buffers()[2].slice(first, int(off[-1]) - first), np.uint8))[1:]
        a, b = off[:-1] - first, off[1:] - first
        full = b > a
        a = a + (self.spaced & (c[a] == SPACE))
        body = a < b
        low, high = np.zeros(len(a), np.uint8), np.zeros(len(a), np.uint8)
        # reduceat over [start, end) pairs; every other result is of what lies between
        at = np.stack([a, b], 1)[body].ravel()
        if len(at):
            low[body], high[body] = np.minimum.reduceat(c, at)[::2], np.maximum.reduceat(c, at)[::2]
        # the other vocabulary takes digits one by one
        return full & (low == high) & ((low == LETTER) | (low == SIGN) | (low == DIGIT) & (self.spaced | (b - a == 1)))

    def _learn(self, pieces: list[str], single: bool) -> None:
        """Adds pieces to the cache in their order: single pre-tokens by the library's model, others by all of it."""
        core, mapped = self.core, self._mapped("\n".join(pieces)).split("\n") if single else []
        for a in range(0, len(pieces), JOINED):
            group = pieces[a : a + JOINED]
            if single:
                flat, sizes = [], []
                for x in mapped[a : a + JOINED]:
                    got = core(x)
                    sizes.append(len(got))
                    flat += [t.id for t in got]
                sizes = np.array(sizes, np.int64)
                self._add(group, np.array(flat, self.kind), np.cumsum(sizes) - sizes, sizes)
            elif self.mark is None or any(SPECIAL in p for p in group) or not self.special:
                for p in group:
                    ids = np.array(self.model.encode(p, add_special_tokens=False).ids, self.kind)
                    self._add([p], ids, np.zeros(1, np.int64), np.array([len(ids)]))
            else:
                ids = np.array(self.model.encode_batch_fast([MARK.join(group)], add_special_tokens=False)[0].ids, self.kind)
                cuts = np.append(np.flatnonzero(ids == self.mark), len(ids))
                begins = np.concatenate([[0], cuts[:-1] + 1])
                self._add(group, ids, begins, cuts - begins)

    def _mapped(self, text: str) -> str:
        """Pieces as the model's alphabet has them, a character for each byte; line ends part them."""
        if text.isascii():
            return text.replace(" ", self.gap)
        own = np.frombuffer((text if self.spaced else _lower(text)).encode(), np.uint8)
        return self.pairs[own].ravel()[self.used[own].ravel()].tobytes().decode()

    def _add(self, pieces: list[str], ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.known), len(pieces)
        while k + n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.n + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n : self.n + len(ids)] = ids
        self.starts[k : k + n], self.sizes[k : k + n] = self.n + begins, sizes
        self.known.update(zip(pieces, range(k, k + n)))
        self.n += len(ids)
        self.held += ENTRY * n + sum(map(len, pieces)) + 4 * len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False) if self.special else np.ones(len(texts), bool)
        if not self.spaced:
            # case folding that the vocabulary does anyway, done early where no special token could arise from it
            texts = _folded(texts, whole)
        pieces, begin = self._cut(texts, whole)
        d = pieces.dictionary_encode()
        words, idx = d.dictionary, d.indices.to_numpy()
        if not self.spaced:
            # here a space in front makes no difference
            d = pc.utf8_ltrim(words, " ").dictionary_encode()
            words, idx = d.dictionary, d.indices.to_numpy()[idx]
        keys = words.to_numpy(zero_copy_only=False).tolist()
        if self.held > CACHE_BYTES:
            self._reset()
        place = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            wanted = words.take(pa.array(new))
            single, plain = self._single(wanted), pc.string_is_ascii(wanted).to_numpy(zero_copy_only=False)
            for some, one in ((new[single & plain], True), (new[single & ~plain], True), (new[~single], False)):
                place[some] = len(self.known) + np.arange(len(some))
                self._learn([keys[i] for i in some.tolist()], one)
        sizes = self.sizes[place][idx] if len(idx) else np.zeros(0, np.int32)
        ends = np.zeros(len(idx) + 1, np.int32)
        np.cumsum(sizes, out=ends[1:])
        src = np.repeat(self.starts[place][idx] - ends[:-1], sizes) if len(idx) else np.zeros(0, np.int32)
        src += np.arange(len(src), dtype=np.int32)
        at = ends[begin]
        return self.ids[src], np.diff(at).astype(np.int64)


def slices(texts: pa.Array, size: int | None = None, most: int = 1 << 30):
    """(first, number) of runs of texts of so many bytes and rows at most, one text at least."""
    size = size or SLICE_BYTES
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, side="right"))
        b = min(max(b, a + 1), a + most)
        yield a, b - a
        a = b


def _lower(text: str) -> str:
    """Character by character, as the vocabulary does; str.lower looks around a capital sigma."""
    return text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)


#: A capital before a combining mark: the vocabulary composes first, and some marks compose with the small letter only.
MARKED, UNMARKED = "[A-Z]\\p{M}", regex.compile(r"[A-Z](?!\p{M})")


def _folded(texts: pa.Array, whole: np.ndarray) -> pa.Array:
    """Texts with A to Z lower-cased, but for capitals before a mark and for whole texts."""
    low = pc.ascii_lower(texts)
    marked = pc.match_substring_regex(texts, MARKED).to_numpy(zero_copy_only=False) & ~whole
    if whole.any():
        low = pc.if_else(pa.array(whole), texts, low)
    if marked.any():
        own = [UNMARKED.sub(lambda m: m[0].lower(), t) for t in texts.filter(pa.array(marked)).to_pylist()]
        low = pc.replace_with_mask(low, pa.array(marked), pa.array(own, low.type))
    return low


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each vocabulary and worker, so that what it has learnt serves later tasks."""
    if (path, spaced) not in _ENCODERS:
        release()
        tidy(0.0)
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def release() -> None:
    """Drops what earlier tasks of this worker have learnt, for operators that need the memory themselves."""
    full = bool(_ENCODERS)
    _ENCODERS.clear()
    tidy(0.0 if full else 20.0)
