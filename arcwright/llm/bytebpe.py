"""Byte-level BPE ids of whole Arrow columns of texts.

The library encodes each distinct *unit* once per worker; a text's ids are its units' ids in a row.  A unit
ends before a space or a line feed and after a word's last letter, which is where the vocabulary's pre-tokeniser always ends a token unless
the cut lies inside a longer run of white space; texts with such runs are encoded by the library directly.
Ids are therefore those of encoding each whole text, at the price of its distinct words.
"""

from __future__ import annotations

import ctypes
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: White space at the start, or a space or line feed with white space on both sides (or at the end after white space).
_WS = r"\s\x0b\x{1c}-\x{1f}\x{85}\pZ"
UNSAFE = rf"\x01|\A[{_WS}]|[{_WS}][ \n]([{_WS}]|\z)"
#: Put before a unit that continues a word after its last letter, where a token ends too; texts that hold it count as unsafe.
MARK = "\x01"
#: Units without white space but a line feed in front.
SIMPLE = rf"\A\n?[^{_WS}]+\z"
#: Units kept in a worker; beyond this the memo starts anew. It bounds memory only, ids don't depend on it.
MAX_UNITS = 250_000
_CHUNK, _LINE = 20_000, 50


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ragged:
    """Rows of uint32 ids that grow; row i is flat[start[i]:start[i] + length[i]]."""

    def __init__(self) -> None:
        self.flat, self.start, self.length, self.rows, self.used = np.empty(1 << 16, "<u4"), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0, 0

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.empty(max(n, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(lengths), len(flat)
        self.start, self.length, self.flat = self._grown(self.start, self.rows + n), self._grown(self.length, self.rows + n), self._grown(self.flat, self.used + m)
        self.flat[self.used : self.used + m] = flat
        self.length[self.rows : self.rows + n] = lengths
        self.start[self.rows : self.rows + n] = self.used + np.cumsum(lengths) - lengths
        self.rows, self.used = self.rows + n, self.used + m

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the given rows in a row, and each row's length."""
        return gather(self.flat, self.start[rows], self.length[rows])


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    return flat[at], lengths


class UnitMemo:
    """Ids of units, each encoded once. ``encode`` takes an array of distinct units, returns (flat ids, lengths)."""

    def __init__(self, encode, limit: int = MAX_UNITS) -> None:
        self.encode, self.limit, self.known, self.kept = encode, limit, pa.array([], pa.string()), Ragged()

    def rows(self, units: pa.StringArray) -> np.ndarray:
        """The row in ``kept`` of each unit."""
        if len(self.known) > self.limit:
            self.known, self.kept = pa.array([], pa.string()), Ragged()
        at = pc.index_in(units, value_set=self.known)
        if at.null_count:
            new = units.filter(at.is_null()).unique()
            for i in range(0, len(new), _CHUNK):
                self.kept.extend(*self.encode(new.slice(i, _CHUNK)))
            self.known = pa.concat_arrays([self.known, new])
            at = pc.index_in(units, value_set=self.known)
        return at.to_numpy()


def by_units(units: pa.ListArray, memo: UnitMemo) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of every row's units, and the number of ids of each row."""
    rows = memo.rows(units.flatten())  # first: where the memo starts anew, ``kept`` is another one then
    flat, lengths = memo.kept.gather(rows)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    offsets = units.offsets.to_numpy() - units.offsets[0].as_py()
    return flat, np.diff(ends[offsets])


class ByteBpe:
    """Encoder of Arrow string arrays; one per Python worker."""

    _held: dict[str, ByteBpe] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.feed = self.library.encode("\n", add_special_tokens=False).ids
        assert len(self.feed) == 1, "a line feed must be one id"
        self.feed = self.feed[0]
        self.memo = UnitMemo(self._encode_units)

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _encode_units(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Many units as one text, a line feed before each: where its id stands, a unit begins.

        A unit that starts with a line feed holds one such id itself; no other unit does.  Units with other
        white space, which could join with what stands before or after, are encoded one by one.
        """
        plain = pc.match_substring_regex(units, SIMPLE)
        feed = pc.starts_with(units, "\n")
        spelt = pc.if_else(feed, units, pc.binary_join_element_wise("", units, " "))
        spelt = pc.if_else(pc.starts_with(units, MARK), pc.utf8_slice_codeunits(units, 1), spelt)
        if not pc.all(plain, min_count=0).as_py():
            mask = plain.to_numpy(zero_copy_only=False)
            flat, lengths = self._encode_units(units.filter(plain)) if mask.any() else (np.empty(0, "<u4"), np.empty(0, np.int64))
            rows = iter(np.split(flat, np.cumsum(lengths)[:-1]))
            rows = [next(rows) if p else np.array(self.library.encode(u, add_special_tokens=False).ids, "<u4") for u, p in zip(spelt.to_pylist(), mask.tolist(), strict=True)]
            return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        ends = pa.array([*range(0, len(units), _LINE), len(units)], pa.int32())
        lines = pc.binary_join_element_wise("", pc.binary_join(pa.ListArray.from_arrays(ends, spelt), "\n"), "\n")  # short lines: the library is slow on long ones
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.library.encode_batch_fast(lines.to_pylist(), add_special_tokens=False)), "<u4")
        feeds = np.flatnonzero(ids == self.feed)
        inner = feed.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(inner + 1) - (inner + 1)
        if len(feeds) != len(units) + inner.sum():
            raise ValueError("the vocabulary joins line feeds; units can't be told apart")
        starts = feeds[at] + 1
        return gather(ids, starts, np.append(feeds[at[1:]], len(ids)) - starts)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        if odd.any():
            plain = self._encode_plain(texts.filter(pa.array(~odd)))
            whole = [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") for t in texts.filter(pa.array(odd)).to_pylist()]
            pieces = np.split(plain[0], np.cumsum(plain[1])[:-1]) if len(plain[1]) else []
            took = [iter(pieces), iter(whole)]
            rows = [next(took[o]) for o in odd.tolist()]
            return (np.concatenate(rows) if rows else np.empty(0, "<u4")), np.array([len(r) for r in rows], np.int64)
        return self._encode_plain(texts)

    def _encode_plain(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        # A line feed in front makes the first unit one that doesn't take a space; its id is dropped below.
        led = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        led = pc.replace_substring_regex(led, rf"(\pL)([^\pL{_WS}])", rf"\1 {MARK}\2")
        flat, lengths = by_units(pc.split_pattern(led, " "), self.memo)
        keep = np.ones(len(flat), bool)
        keep[np.cumsum(lengths) - lengths] = False
        return flat[keep], lengths - 1


def release() -> None:
    """Gives memory that is free back to the system: a worker that waits for its next task holds little beside that task's stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, rows: int = 4096, limit: int = 4 << 20):
    """Arrow batches cut to bounded pieces: at most ``rows`` rows and, but for a single row, ``limit`` bytes.

    A worker's memory is a multiple of a piece, as texts are split and matched as whole columns.
    """
    for b in batches:
        a = 0
        while a < b.num_rows:
            n = min(rows, b.num_rows - a)
            while n > 1 and b.slice(a, n).nbytes > limit:
                n = (n + 1) // 2
            yield b.slice(a, n)
            a += n
    release()
