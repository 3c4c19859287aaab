"""Token ids of whole texts by the tokenizers library, encoded once per distinct chunk and worker.

Both public vocabularies used here split a text before they merge, and never
merge across the chunks made below; so the ids of a text are those of its
chunks in a row. A slice of texts is cut as a whole, in its Arrow buffer, and
its distinct chunks are looked up among those that the worker has met, which it
keeps up to a bound; then the half that was used most stays. Texts that may
hold an added token go to the library whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seqspark.llm.shared import claim

CACHE_CHUNKS = 600_000
CACHE_BYTES = 32 << 20
SLICE_BYTES = 4 << 20
# The letters by which byte-level vocabularies write bytes; those that print stand for themselves.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _PRINTED} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BLANK = _BYTE[0x20]
_LOADED: dict = {}


def _among(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_GAP = _among(b" \n")
#: Marks that begin a piece of their own after a letter, for either pre-tokenizer.
_MARK = _among(b"!#$%&*.,|;:?")
_LETTER = _among(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
#: First bytes of characters that are no white space: ASCII ones that print, and those of two bytes from U+00C0 on.
_SOLID = _among(bytes([*range(0x21, 0x7F), *range(0xC3, 0xE0)]))
# White space beyond ASCII, as the tokenizers' patterns have it, by its bytes as one number.
_WIDE_WS = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a Latin letter (up to U+00FF) ends before each place; a place has two bytes before it at least."""
    last, before = data[at - 1], data[at - 2]
    return _LETTER[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))


def _after_solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character that is no white space ends before each place; a place has two bytes before it at least."""
    last = data[at - 1]
    out = last > 0x20
    wide = np.flatnonzero(last >= 0x80)
    two = data[at[wide] - 2].astype(np.int64) << 8 | last[wide]
    three = data[np.maximum(at[wide] - 3, 0)].astype(np.int64) << 16 | two
    out[wide] = ~(np.isin(two, _WIDE_WS) | np.isin(three, _WIDE_WS))
    return out


def words_apart(data: np.ndarray) -> list[np.ndarray]:
    """Where to cut for a vocabulary that drops white space: before blanks and line ends, and before marks after a letter."""
    marks = np.flatnonzero(_MARK[data])
    marks = marks[marks > 1]
    return [np.flatnonzero(_GAP[data]), marks[_after_letter(data, marks)]]


def words_with_space(data: np.ndarray) -> list[np.ndarray]:
    """Where to cut for a byte-level vocabulary: before white space that follows another character, after a line end between two of these, and before marks after a letter."""
    gaps, marks = np.flatnonzero(_GAP[data]), np.flatnonzero(_MARK[data])
    gaps, marks = gaps[gaps > 1], marks[marks > 1]
    gaps = gaps[_after_solid(data, gaps)]
    after = gaps[data[gaps] == 0x0A] + 1
    after = after[after < len(data)]
    return [gaps, after[_SOLID[data[after]]], marks[_after_letter(data, marks)]]


CHUNKS = {"apart": words_apart, "spaced": words_with_space}
#: A text with this may hold one of the vocabularies' added tokens, which stand for one id wherever they are.
_ADDED = "<|"


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES):
    """The batch in runs of rows whose texts have ``size`` bytes together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype``; ``chunks`` names how the vocabulary's pre-tokenizer splits."""

    def __init__(self, path: str, chunks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.cuts, self.apart = CHUNKS[chunks], chunks == "apart"
        # words of Latin letters need no normalising or pattern: the same merges, with white space between words
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, WhitespaceSplit()
        self.plain.model._resize_cache(0)
        (self.bar,) = self.plain.encode("|", add_special_tokens=False).ids  # stands between words
        # chunk number -> ids[start[number] :][: length[number]]; how often it was used
        self.known = pa.array([], pa.large_string())
        self.start, self.length, self.uses, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def encode_all(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        added = pc.match_substring(texts, _ADDED)
        chunks, sizes = self._split(pc.if_else(added, "", texts))
        numbers = self._numbers(chunks)
        data, n = self._gather(numbers)
        ends = np.append(0, np.cumsum(n, dtype=np.int64))[np.append(0, np.cumsum(sizes))] * self.dtype.itemsize
        raw = data.tobytes()
        out = [raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in np.flatnonzero(added.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype).tobytes()
        return out

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, one after the other, and how many each has."""
        _, offsets, values = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(values, np.uint8)[: bounds[-1]] if values and bounds[-1] else np.zeros(0, np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        for places in self.cuts(data[bounds[0] :]):
            cut[places + bounds[0]] = True
        cut[bounds] = True
        edges = np.flatnonzero(cut[bounds[0] :]) + bounds[0]
        chunks = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        return chunks, np.diff(np.searchsorted(edges, bounds))

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The number of each chunk; those that were not met yet are encoded."""
        if len(self.known) > CACHE_CHUNKS or self.known.nbytes > CACHE_BYTES:
            self._forget()
        distinct = chunks.dictionary_encode()
        which, words = distinct.indices.to_numpy(), distinct.dictionary
        found = pc.index_in(words, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        numbers = found.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            numbers[new] = len(self.known) + np.arange(int(new.sum()))
            self._learn(words.filter(pa.array(new)))
        self.uses[numbers] += np.bincount(which, minlength=len(words))
        return numbers[which]

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has."""
        n = self.length[numbers]
        ends = np.cumsum(n, dtype=np.int64)
        at = np.arange(int(ends[-1]) if len(n) else 0)
        at += np.repeat(self.start[numbers] - (ends - n), n)
        return self.ids[at], n

    def _forget(self) -> None:
        """Keep the half of the chunks that was used most, or fewer if they are long; what is used from now on counts for more."""
        keep = np.argsort(-self.uses, kind="stable")[: CACHE_CHUNKS // 2]
        sizes = pc.binary_length(self.known).to_numpy()
        keep = np.sort(keep[np.cumsum(sizes[keep]) <= CACHE_BYTES // 4])
        self.ids, self.length = self._gather(keep)
        self.start, self.uses = np.cumsum(self.length, dtype=np.int64) - self.length, self.uses[keep] // 2
        self.known = self.known.take(pa.array(keep))

    def _learn(self, new: pa.Array) -> None:
        """Encode chunks: words of ASCII letters, those with other Latin letters, and all others by the library's own patterns."""
        kinds: dict = {True: [], False: [], None: []}
        words = new.to_pylist()
        for k, w in enumerate(words):
            word = w[1:] if w[:1] == " " or (self.apart and w[:1] == "\n") else w
            kinds[word.isascii() if word.isalpha() and max(word) <= "ÿ" else None].append(k)
        order, ids, sizes = [], [], []
        for kind, some in kinds.items():
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                data, n = self._other_ids([words[k] for k in part]) if kind is None else self._plain_ids([words[k] for k in part], kind)
                order.append(part)
                ids.append(data)
                sizes.append(n)
        n = np.concatenate(sizes).astype(np.int32)
        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        order = np.concatenate(order)
        start[order], length[order] = len(self.ids) + np.cumsum(n, dtype=np.int64) - n, n
        self.ids = np.concatenate([self.ids, *ids])
        self.start, self.length = np.append(self.start, start), np.append(self.length, length)
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))
        self.known = pa.concat_arrays([self.known, new])

    def _other_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), self.dtype), np.array([len(x) for x in found], np.int64)

    def _plain_ids(self, chunks: list[str], ascii_: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, all of ASCII letters or all with others, and how many each has."""
        if self.apart:
            chunks = [w.strip(" \n").lower() for w in chunks]
        if not ascii_:
            chunks = ["".join([_BYTE[b] for b in w.encode()]) for w in chunks]
        text = " | ".join([w.replace(" ", _BLANK) for w in chunks])
        (found,) = self.plain.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, self.dtype)
        ends = np.append(np.flatnonzero(ids == self.bar), len(ids))
        if len(ends) != len(chunks):
            raise ValueError("the vocabulary marks words in another way")
        return ids[ids != self.bar], np.diff(ends, prepend=-1) - 1


def encoder(path: str, chunks: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    claim("tokens", _LOADED.clear)
    if (path, chunks) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, chunks] = Encoder(path, chunks)
    return _LOADED[path, chunks]
