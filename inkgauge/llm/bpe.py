"""Exact and fast use of a public BPE vocabulary inside Python workers.

The library's encoder costs microseconds a token. Both vocabularies cut a text before white space, and between ASCII letters or digits
and punctuation, before they merge, so a text's ids are the concatenation of the ids of the chunks between such cuts. The cuts are found
over a batch's bytes by numpy; each distinct chunk is looked up once a batch, and encoded once by the library and remembered. There
is no cut beside an apostrophe (it may begin a suffix) or a bar (special tokens hold some).

The memory is bounded in bytes: it has two generations of half of HELD bytes. A chunk that is met moves into the younger one; when that is
full, it becomes the older one, whose chunks that weren't met since are forgotten. So frequent chunks stay, and the many that occur once
go. Chunks of more than _LONGEST bytes (texts without white space, for instance) are encoded for their call alone. Remembered chunks lie in
one Arrow array a generation, a third of what Python's objects would take; a call's chunks are looked up in it together.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkgauge.llm import common

_LONGEST = 48
#: Bytes of one encoder's memory: ENTRY for a remembered chunk besides its bytes (its places, and the table that a look-up makes for its time), four for an id.
HELD, ENTRY = 84 << 20, 105
#: Bytes of text that the library encodes in one call, and that a worker turns into ids at once.
_A_CALL, PORTION = 100_000, 2_000_000
_KINDS = np.zeros(256, np.uint8)
_SPACE, _ALNUM, _PUNCTUATION = 1, 2, 3
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = _ALNUM
_KINDS[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"]] = _PUNCTUATION
_encoders: dict[tuple[str, bool], "ChunkEncoder"] = {}


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _after_wide_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space beyond ASCII; a run of white space is merged as one."""
    one, two, three = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    general = (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | np.isin(one, (0xA8, 0xA9, 0xAF))) | (two == 0x81) & (one == 0x9F))
    others = (three == 0xE1) & (two == 0x9A) & (one == 0x80) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    return (one >= 0x80) & (general | others | (two == 0xC2) & ((one == 0x85) | (one == 0xA0)))


def chunks(texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """The chunks of all texts one after the other, over the texts' own bytes, and the number of chunks of each text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    low, edges = edges[0], edges - edges[0]
    raw = np.frombuffer(texts.buffers()[2], np.uint8, edges[-1], low) if edges[-1] else np.zeros(0, np.uint8)
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        kind = _KINDS[raw]
        space = kind == _SPACE
        spaces = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        cut[spaces[~_after_wide_space(raw, spaces)]] = True
        cut[1:-1] |= kind[1:] * kind[:-1] == _ALNUM * _PUNCTUATION
    cut[edges] = True
    places = np.flatnonzero(cut).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)])
    return found, np.diff(np.searchsorted(places, edges))


class _Generation:
    """Remembered chunks, each with its number."""

    def __init__(self, chunks: pa.BinaryArray, numbers: np.ndarray) -> None:
        self.chunks, self.numbers = chunks, numbers

    def __len__(self) -> int:
        return len(self.chunks)

    def __contains__(self, chunk: bytes) -> bool:
        return self.find(pa.array([chunk], pa.binary()))[0] >= 0

    def find(self, chunks: pa.BinaryArray) -> np.ndarray:
        """Their numbers, -1 where a chunk isn't here."""
        if not len(self.chunks):
            return np.full(len(chunks), -1, np.int64)
        at = pc.fill_null(pc.index_in(chunks, value_set=self.chunks), -1).to_numpy()
        return np.where(at >= 0, self.numbers[at], -1)

    def add(self, chunks: pa.BinaryArray, numbers: np.ndarray) -> None:
        self.chunks, self.numbers = pa.concat_arrays([self.chunks, chunks]), np.concatenate([self.numbers, numbers])


def _no_chunks() -> _Generation:
    return _Generation(pa.array([], pa.binary()), np.zeros(0, np.int64))


class ChunkEncoder:
    """ids of texts under a tokenizers file.

    plain: the vocabulary's special tokens, where a text holds them literally, are encoded as ordinary text; else they give their own id, as the library does.
    """

    def __init__(self, name: str, plain: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(name))
        self.library.encode_special_tokens = plain
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.clear()

    def clear(self) -> None:
        self.index, self.older = _no_chunks(), _no_chunks()  # index: the younger generation
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.used = self.known = self.held = 0

    def _learn(self, new: list[bytes]) -> range:
        """Encode new chunks and return their numbers."""
        before = self.known
        for lo, hi in common.spans_of([len(c) for c in new], _A_CALL):
            found = [e.ids for e in self.library.encode_batch_fast([c.decode("utf-8", "replace") for c in new[lo:hi]], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            first, last, need = self.known, self.known + len(found), self.used + int(sizes.sum())
            self._room(last, need)
            self.ids[self.used : need] = np.fromiter(chain.from_iterable(found), np.int32, need - self.used)
            self.sizes[first:last] = sizes
            self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
            self.used, self.known = need, last
        return range(before, self.known)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of chunks, by their numbers, one after the other."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _room(self, chunks: int, ids: int) -> None:
        while ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while chunks > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if self.held > HELD // 2:
            self._turn()
        found, counts = chunks(texts)
        coded = found.dictionary_encode()
        distinct = coded.dictionary
        numbers = self.index.find(distinct)
        missing = np.flatnonzero(numbers < 0)
        if len(missing) and len(self.older):
            numbers[missing] = self.older.find(distinct.take(pa.array(missing)))
            again = missing[numbers[missing] >= 0]
            self._remember(distinct.take(pa.array(again)), numbers[again])
            missing = missing[numbers[missing] < 0]
        kept = self.known, self.used
        if len(missing):
            long = pc.binary_length(distinct.take(pa.array(missing))).to_numpy() > _LONGEST
            short = missing[~long]
            new = distinct.take(pa.array(short))
            numbers[short] = self._learn(new.to_pylist())
            self._remember(new, numbers[short])
            kept = self.known, self.used
            numbers[missing[long]] = self._learn(distinct.take(pa.array(missing[long])).to_pylist())
        at = numbers[coded.indices.to_numpy()]
        flat = self._gather(at)
        edges = np.concatenate([[0], np.cumsum(self.sizes[at])])
        upto = np.concatenate([[0], np.cumsum(counts)])
        self._forget(*kept)
        return flat, np.diff(edges[upto])

    def _remember(self, chunks: pa.BinaryArray, numbers: np.ndarray) -> None:
        """Put chunks into the younger generation."""
        self.index.add(chunks, numbers)
        self.held += ENTRY * len(chunks) + (pc.sum(pc.binary_length(chunks)).as_py() or 0) + 4 * int(self.sizes[numbers].sum())

    def _turn(self) -> None:
        """The younger generation becomes the older one, alone in the room of ids."""
        young, at = self.index.chunks, self.index.numbers
        ids, sizes = self._gather(at), self.sizes[at]
        self.clear()
        self._room(len(young), len(ids))
        self.ids[: len(ids)], self.sizes[: len(young)], self.starts[: len(young)] = ids, sizes, np.cumsum(sizes) - sizes
        self.used, self.known = len(ids), len(young)
        self.older = _Generation(young, np.arange(len(young)))

    def _forget(self, known: int, used: int) -> None:
        """Drop what was encoded for one call; room beyond twice the need goes too."""
        if self.known > known:
            self.known, self.used = known, used
            if len(self.ids) > max(1 << 20, 2 * used):
                self.ids = self.ids[: max(1 << 16, used)].copy()


def encoder(name: str, plain: bool = False) -> ChunkEncoder:
    """The worker's encoder for a vocabulary; it outlives tasks, until another operator uses the worker."""
    common.only_cache("bpe", _encoders.clear)
    if (name, plain) not in _encoders:
        _encoders[name, plain] = ChunkEncoder(name, plain)
    return _encoders[name, plain]


def encode_with_end(coder: ChunkEncoder, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """As encode(), with the id end after each text."""
    flat, sizes = coder.encode(texts)
    pa.default_memory_pool().release_unused()  # what the last portion needed, which the pool would keep
    return np.insert(flat, np.cumsum(sizes), end), sizes + 1
