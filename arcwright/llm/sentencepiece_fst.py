"""SentencePiece encoding and decoding as weighted finite-state transduction.

The model file is compiled to three transducers: the normaliser (a trie of the model's character map whose longest
match is rewritten, then white space to the marker U+2581 and the dummy prefix), the pieces (a trie whose final states
emit a piece) and the byte fallback (an arc for a character that no piece spells, which emits its UTF-8 bytes).  An
input is composed with them position by position, which gives a lattice of (position, last piece) states whose arcs
carry a weight and the ids they emit; the encoding is its shortest path in the tropical semiring.

* Unigram models: an arc weighs minus the piece's score, so the path is the most likely segmentation.
* BPE models: merge order is no sum of scores, so the lattice is composed with one more acceptor over pairs
  of neighbouring pieces: weight 0 where merging the pair's own characters by rank gives that pair back,
  infinity elsewhere.  Exactly one path then has finite weight, and it is the merge result.

No piece crosses from other text into a white-space marker, nor (where the vocabulary has none such) from a
letter into a punctuation mark, so that a lattice falls apart there; a worker keeps the paths of the parts it has met.  The memo bounds memory, results don't depend on it.

Refused (NotImplementedError): models with user-defined symbols, or with pieces that cross from one word into the next.

Defined results: null or empty text: no ids, decoded to the empty text; repeated rows and null ids are treated
like any other; extra columns are ignored; the length of a text isn't bounded.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import UnitMemo, by_units, slices, vocabulary_path
from .common import arrow_batches

MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types of the model format.
UNIGRAM, BPE = 1, 2
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Put where a lattice falls apart.
_CUT = "\x00"


def _fields(data: bytes):
    """(field number, value) of a serialised protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Normaliser:
    """The character map as a transducer: states are the nodes of a trie of sources, final ones emit what replaces them."""

    def __init__(self, blob: bytes) -> None:
        self.trie: dict = {}
        for source, target in self._entries(blob) if blob else ():
            node = self.trie
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target
        deeper: set[str] = set()
        front = [(n, 1) for n in self.trie.values()]
        while front:
            node, _ = front.pop()
            below = [(c, n) for c, n in node.items() if c]
            deeper.update(c for c, _ in below)
            front += [(n, 1) for _, n in below]
        single = {c for c, n in self.trie.items() if "" in n}
        # A text without these characters is its own image: nothing in it is rewritten alone or as part of more.
        touched = "".join(re.escape(c) for c in sorted(single | deeper))
        self.touched = re.compile(f"[{touched}]") if touched else None

    @staticmethod
    def _entries(blob: bytes):
        """(source, target) of the map: a double-array trie over UTF-8 bytes, then the targets, each ended by a zero byte."""
        size = int.from_bytes(blob[:4], "little")
        units, targets = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        labels = np.arange(1, 256, dtype=np.int64)
        front, spelt = np.array([offset(units[0])], np.int64), [b""]
        while len(front):
            at = front[:, None] ^ labels[None, :]
            inside = at < len(units)
            unit = units[np.where(inside, at, 0)]
            rows, columns = np.nonzero(inside & ((unit & ((1 << 31) | 0xFF)) == labels))
            hit = unit[rows, columns]
            spelt = [spelt[r] + bytes([c + 1]) for r, c in zip(rows.tolist(), columns.tolist(), strict=True)]
            front = at[rows, columns] ^ offset(hit)
            for k in np.flatnonzero((hit >> 8) & 1):
                value = int(units[front[k]] & 0x7FFFFFFF)
                yield spelt[k].decode(), targets[value : targets.index(b"\0", value)].decode()

    def apply(self, text: str) -> str:
        if self.touched is None or not self.touched.search(text):
            return text
        out, at, n, trie = [], 0, len(text), self.trie
        while at < n:
            node, k, best = trie.get(text[at]), at + 1, None
            while node is not None:
                if "" in node:
                    best = (k, node[""])
                if k >= n:
                    break
                node, k = node.get(text[k]), k + 1
            if best is None:
                out.append(text[at])
                at += 1
            else:
                at = best[0]
                out.append(best[1])
        return "".join(out)


class Model:
    """A compiled model; one per Python worker and path."""

    _held: dict[str, Model] = {}

    def __init__(self, path: str) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    got = dict(_fields(value))
                    self.pieces.append(got[1].decode())
                    self.scores.append(float(np.frombuffer(got.get(2, bytes(4)), "<f4")[0]))
                    self.kinds.append(got.get(3, NORMAL))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    normal = dict(_fields(value))
        self.normaliser = Normaliser(bytes(normal.get(2, b"")))
        if USER in self.kinds:
            raise NotImplementedError("user-defined symbols aren't supported")
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [i for i, k in enumerate(self.kinds) if k == BYTE]
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.longest = max(map(len, self.id))
        self.lowest = min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise NotImplementedError("pieces that cross into a following word aren't supported")
        self.tails = {p[n:] for p in self.id for n in range(len(p))}  # states of the reversed trie
        self.pair: dict[tuple[str, str], bool] = {}
        after_letter = {b for p in self.id for a, b in itertools.pairwise(p) if a.isalpha()}
        ends = "".join(re.escape(c) for c in sorted({c for p in self.id for c in p if c.isascii() and not c.isalnum()} - after_letter))
        self.letter_end = f"(\\pL)([{ends}])" if ends else None
        self.memo = UnitMemo(self._encode_units)
        self.spelt = np.array([self._bytes_of(i) for i in range(len(self.pieces))], object)

    @classmethod
    def of(cls, path: str) -> Model:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _bytes_of(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].replace(MARK, " ").encode()

    def merged(self, text: str) -> list[str]:
        """The text's characters, merged pair by pair: the best-scored piece first, then the leftmost."""
        parts, get, scores = list(text), self.id.get, self.scores
        joint = [get(a + b) for a, b in itertools.pairwise(parts)]
        while True:
            k, top = -1, None
            for j, i in enumerate(joint):
                if i is not None and (top is None or scores[i] > top):
                    k, top = j, scores[i]
            if k < 0:
                return parts
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joint[k]
            if k:
                joint[k - 1] = get(parts[k - 1] + parts[k])
            if k < len(joint):
                joint[k] = get(parts[k] + parts[k + 1])

    def _fits(self, left: str, right: str) -> bool:
        """Whether the pair acceptor has an arc of finite weight."""
        key = (left, right)
        if (held := self.pair.get(key)) is None:
            if len(self.pair) > 1_000_000:
                self.pair.clear()
            held = self.pair[key] = self.merged(left + right) == ([left, right] if left else [right])
        return held

    def emitted(self, piece: str) -> tuple[int, ...]:
        """The ids on the arc: of a piece its own, of a character that is none its bytes, or the unknown one."""
        i = self.id.get(piece)
        return (i,) if i is not None else tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,)

    def arcs(self, text: str, end: int):
        """Pieces that end here, by walking the trie of reversed pieces; a character that is no piece has the fallback's arc."""
        tails, known, found = self.tails, self.id, []
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            part = text[start:end]
            if part not in tails:
                break
            if part in known:
                found.append((start, part))
        if not found or found[0][0] != end - 1:
            found.insert(0, (end - 1, text[end - 1 : end]))
        return reversed(found)

    def step(self, text: str, end: int, best: list) -> tuple[float, int, str, tuple[int, ...]] | None:
        """The lightest state at this position: weight, where its last piece starts, that piece and its ids; None if none has finite weight."""
        if self.bpe:
            for start, piece in self.arcs(text, end):
                if (before := best[start]) is not None and self._fits(before[2], piece):
                    return 0.0, start, piece, self.emitted(piece)
            return None
        found = None
        for start, piece in self.arcs(text, end):
            i = self.id.get(piece)
            weight = best[start][0] + np.float32(-self.scores[i] if i is not None else 10.0 - self.lowest)
            if found is None or weight < found[0]:  # of equal ones the longest piece, which comes first
                found = (weight, start, piece)
        return (*found, self.emitted(found[2]))

    def paths(self, texts: list[str]):
        """Each text with what the arcs of its shortest path emit, in sorted order.

        The lattices of texts that begin alike are one up to where they part (the sorted texts are walked as
        the trie that accepts them), so that each common beginning is composed once.
        """
        best: list = [(np.float32(0), 0, "", ())]
        last = ""
        for text in sorted(texts):
            same = 0
            for a, b in zip(last, text, strict=False):
                if a != b:
                    break
                same += 1
            del best[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                best.append(self.step(text, end, best))
            last, out, at = text, [], len(text)
            while at:
                _, at, _, ids = best[at]
                out.append(ids)
            yield text, out[::-1]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalised texts; unknown characters in a row are one."""
        done = {}
        for text, emitted in self.paths(texts):
            flat = list(itertools.chain.from_iterable(emitted))
            done[text] = [i for k, i in enumerate(flat) if i != self.unknown or k == 0 or flat[k - 1] != i]
        return [done[t] for t in texts]

    def _encode_units(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.ids(units.to_pylist())
        return np.fromiter(itertools.chain.from_iterable(rows), "<u4"), np.array([len(r) for r in rows], np.int64)

    def normalise(self, texts: pa.StringArray) -> pa.StringArray:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.normaliser.touched is not None:
            texts = pa.array([self.normaliser.apply(t) for t in texts.to_pylist()], pa.string())
        if self.squeeze:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
        texts = pc.replace_substring(texts, " ", MARK)
        return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(MARK, texts, "")) if self.prefix else texts

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = whole = self.normalise(texts)
        odd = pc.match_substring(texts, _CUT).to_numpy(zero_copy_only=False)
        if self.letter_end:
            texts = pc.replace_substring_regex(texts, self.letter_end, rf"\1{_CUT}\2")
        cut = pc.split_pattern(pc.replace_substring_regex(texts, f"([^{MARK}])({MARK})", rf"\1{_CUT}\2"), _CUT)
        if odd.any():  # the rare text that holds the cut's character is walked as one lattice
            rows = [self.ids([t])[0] if o else None for t, o in zip(whole.to_pylist(), odd, strict=True)]
            flat, lengths = by_units(cut, self.memo)
            parts = np.split(flat, np.cumsum(lengths)[:-1])
            rows = [np.array(r, "<u4") if r is not None else p for r, p in zip(rows, parts, strict=True)]
            return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        return by_units(cut, self.memo)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids spell: pieces, bytes of fallback runs, without the dummy prefix."""
        text = b"".join(self.spelt[ids].tolist())
        if self.prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


def encode(docs: DataFrame, *, model: str = DEFAULT_MODEL, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit), decoded_crc32 (UTF-8 of the decoded ids), round_trip; ``with_ids`` adds ids and the decoded text."""
    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + ", ids array<int>, decoded string" * with_ids
    arrow_batches(docs.sparkSession)

    def run(batches):
        coder = Model.of(vocabulary_path(model))
        for b in slices(batches):
            flat, lengths = coder.encode(b.column("text"))
            stop = np.cumsum(lengths)
            bounds = list(zip((stop - lengths).tolist(), stop.tolist(), strict=True))
            view = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in bounds]
            texts = [coder.decode(flat[a:z]) for a, z in bounds]
            same = [t == (s or "") for t, s in zip(texts, b.column("text").to_pylist(), strict=True)]
            out = [b.column("doc_id"), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()), pa.array(same)]
            names = ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"]
            if with_ids:
                out += [pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(flat.astype(np.int32))), pa.array(texts)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
