"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets a leading blank, blanks become ``▁``, and it is cut where no piece can cross: before a
``▁`` that follows another character, and around line ends. The distinct words of a batch lie in one
flat numpy array of symbols. Each round looks up the rank of every neighbouring pair, takes the
smallest rank of each word, merges all its leftmost non-overlapping occurrences and compacts the
array, until no word has a pair left. If merging could make a pair of a better or equal rank at
once, only the leftmost occurrence is merged in that round, which is what merging one by one does.
Characters without a piece become byte pieces.

Null text counts as empty: no piece but the end id. Repeated rows are encoded alike, each on its own
row. Long texts are cut into words a stretch at a time. An empty table gives an empty result. Only
doc_id and text (or ids) are read; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Characters looked at in one go, and words kept between batches.
STRETCH, MEMORY = 500_000, 60_000
_NONE = np.iinfo(np.int32).max


def _one_byte_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one-byte-each", _one_byte_each)


class Pieces:
    """The tables of one model."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(k) for k in range(size)]
        special = {k for k in range(size)
                   if sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)}
        if any(sp.is_unused(k) for k in range(size)):
            raise ValueError("models with unused pieces are not supported")
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.bytes = {int(names[k][3:5], 16): k for k in special if sp.is_byte(k)}
        ids = {names[k]: k for k in range(size) if k not in special}
        score = {p: sp.get_score(k) for p, k in ids.items()}
        order = {s: r for r, s in enumerate(sorted({score[p] for p in ids}, reverse=True))}

        # Symbols: the pieces, then characters that only occur inside pieces, then one for the rest.
        symbols = dict(ids)
        for char in {c for p in ids for c in p} - set(ids):
            symbols[char] = size + len(symbols) - len(ids)
        self.other = size + len(symbols) - len(ids)
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for char, k in symbols.items():
            if len(char) == 1:
                self.symbol_of[ord(char)] = k
        self.n = self.other + 1
        pairs, unsafe = {}, set()
        count = Counter(score.values())
        for p, k in ids.items():
            if len(p) > 1 and count[score[p]] > 1:
                unsafe.add(order[score[p]])
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                if left in symbols and right in symbols:
                    pairs[symbols[left] * self.n + symbols[right]] = (order[score[p]], k)
                    for part in (left, right):
                        if len(part) > 1 and score[part] <= score[p]:
                            unsafe.add(order[score[part]])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.safe = np.ones(len(order) + 1, bool)
        self.safe[sorted(unsafe)] = False

        self.words = re.compile(self._word_pattern(ids, score))
        self.surface = [b"" if k in special else names[k].replace(MARK, " ").encode()
                        for k in range(size)]
        for byte, k in self.bytes.items():
            self.surface[k] = bytes([byte])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.control = {k for k in special if sp.is_control(k)}
        self._forget()

    def _word_pattern(self, ids: dict[str, int], score: dict[str, float]) -> str:
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces with blanks inside or at the end are not supported")
        if any("\n" in p for p in ids):
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        # Where runs of blanks are the worst pieces and score alike they grow from the left, so the
        # longest run can be taken off a longer one beforehand.
        runs = [p for p in ids if len(p) > 1 and not p.strip(MARK)]
        whole = max(map(len, runs), default=0)
        worst = (len({score[p] for p in runs}) == 1
                 and all(score[p] > score[runs[0]] for p in ids if len(p) > 1 and p.strip(MARK))
                 and not any(p.startswith(MARK * 2) and p.strip(MARK) for p in ids))
        steady = worst and all(self.merge([MARK * n])[0][0] == ids[MARK * whole]
                               for n in range(whole, 3 * whole))
        first = f"{MARK}{{{whole}}}(?={MARK})|" if steady else ""
        return f"{first}{MARK}*[^{MARK}\n]+|{MARK}+|\n"

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._at, self._length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.int32)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, and the piece that it makes."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after the last merge, and the word of each."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.symbol_of[points]
        seg = np.repeat(np.arange(len(words), dtype=np.int32), list(map(len, words)))
        done_sym, done_seg = [], []
        rank = np.full(len(sym), _NONE, np.int32)  # of the pair that begins at each symbol
        into = np.zeros(len(sym), np.int32)
        fresh = np.flatnonzero(seg[:-1] == seg[1:])
        while len(sym):
            rank[fresh], into[fresh] = self._pair(sym[fresh], sym[fresh + 1])
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            over = best == _NONE
            if over.any():  # words without a pair leave the array
                keep = np.repeat(~over, length)
                done_sym.append(sym[~keep])
                done_seg.append(seg[~keep])
                sym, seg, rank, into = sym[keep], seg[keep], rank[keep], into[keep]
                best, length = best[~over], length[~over]
                if not len(sym):
                    break
            here = np.flatnonzero(rank == np.repeat(best, length))
            # of a stretch of overlapping occurrences every second one; of an unsafe rank the first
            new = np.append(True, np.diff(here) != 1)
            offset = np.arange(len(here)) - np.maximum.accumulate(
                np.where(new, np.arange(len(here)), 0))
            leader = np.append(True, np.diff(seg[here]) != 0)
            here = here[np.where(self.safe[rank[here]], offset % 2 == 0, leader)]
            sym[here] = into[here]
            keep = np.ones(len(sym), bool)
            keep[here + 1] = False
            at = here - np.arange(len(here))  # places after the compaction
            sym, seg, rank, into = sym[keep], seg[keep], rank[keep], into[keep]
            rank[at] = _NONE
            near = np.concatenate([at, at - 1])
            near = near[(near >= 0) & (near < len(sym) - 1)]
            fresh = near[seg[near] == seg[near + 1]]
        sym, seg = np.concatenate([*done_sym, sym]), np.concatenate([*done_seg, seg])
        by_word = np.argsort(seg, kind="stable")
        return sym[by_word], seg[by_word]

    def _learn(self, words: list[str]) -> None:
        """Encode new words and keep their ids."""
        sym, seg = self.merge(words)
        length = np.bincount(seg, minlength=len(words)).astype(np.int64)
        lone = np.flatnonzero(sym >= len(self.surface))  # characters without a piece
        if len(lone):
            sym, length = self._fall_back(words, sym, seg, lone, length)
        base, count = len(self._flat), len(self._number)
        self._number.update(zip(words, range(count, count + len(words)), strict=True))
        self._at = np.append(self._at, base + np.cumsum(length) - length)
        self._length = np.append(self._length, length)
        self._flat = np.append(self._flat, sym)

    def _fall_back(self, words, sym, seg, lone, length):
        """Replace symbols without a piece by byte pieces."""
        parts, last = [], 0
        length = length.copy()
        seen: dict[int, list[str]] = {}  # of a word, its characters without a piece not yet used
        for k in lone.tolist():
            word = int(seg[k])
            if word not in seen:
                chars = words[word]
                seen[word] = [c for c in chars if self.symbol_of[ord(c)] >= len(self.surface)][::-1]
            raw = seen[word].pop().encode()
            ids = [self.bytes[b] for b in raw] if self.bytes else [self.unknown]
            parts += [sym[last:k], np.array(ids, np.int32)]
            length[word] += len(ids) - 1
            last = k + 1
        return np.concatenate([*parts, sym[last:]]), length

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of every word, after learning those not seen before."""
        if len(self._number) > MEMORY:
            self._forget()
        which = list(map(self._number.get, words))
        if None in which:
            self._learn(list(dict.fromkeys(w for w, k in zip(words, which, strict=True)
                                           if k is None)))
            number = self._number
            which = [number[w] if k is None else k for w, k in zip(words, which, strict=True)]
        return np.array(which, np.int64)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many ids end before each word and the end."""
        which = self._numbers(words)
        length = self._length[which]
        edge = np.append(0, np.cumsum(length))
        return self._flat[np.repeat(self._at[which] - edge[:-1], length)
                          + np.arange(edge[-1])], edge

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts in a row, and how many each text has."""
        parts = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        ids, edge = self._ids([w for part in parts for w in part])
        return ids, np.diff(edge[np.cumsum([0, *map(len, parts)])])

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one long text, a stretch of words at a time."""
        marked = MARK + text.replace(" ", MARK)
        out, words, size = [], [], 0
        for m in self.words.finditer(marked):
            words.append(m[0])
            size += len(m[0])
            if size > STRETCH:
                out.append(self._ids(words)[0])
                words, size = [], 0
        return np.concatenate([*out, self._ids(words)[0]])

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((k for k in ids if k not in self.control), None)
        if first is not None and first not in self.bytes.values() and first != self.unknown:
            raw = raw[raw[:1] == b" ":]
        return raw.decode("utf-8", "one-byte-each")


_ready: dict[int, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The tables of a model, built once in a process."""
    key = hash(model)
    if key not in _ready:
        _ready[key] = Pieces(model)
    return _ready[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoded(batch: pa.RecordBatch, table: Pieces, tail: list[int]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with ids in the place of texts, a stretch of texts at a time."""
    texts, names = batch.column(batch.num_columns - 1), batch.schema.names[:-1]
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at + len(some) < len(texts) and size < STRETCH:
            some.append(texts[at + len(some)].as_py() or "")
            size += len(some[-1])
        if len(some) == 1 and size > STRETCH:
            ids = table.encode_long(some[0])
            counts = np.array([len(ids)])
        else:
            ids, counts = table.encode(some)
        ends = np.cumsum(counts)
        flat = np.insert(ids, np.repeat(ends, len(tail)), tail * len(some))
        offsets = np.append(0, ends + len(tail) * np.arange(1, len(some) + 1))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*(c.slice(at, len(some)) for c in batch.columns[:-1]), lists], [*names, "ids"])
        at += len(some)


def _decoded(batch: pa.RecordBatch, table: Pieces) -> pa.RecordBatch:
    """A batch that ends with ids, and what they stand for."""
    texts = [table.decode(x.as_py() or []) for x in batch.column(batch.num_columns - 1)]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                      [*batch.schema.names, "text"])


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_TEXT = T.StructField("text", T.StringType())


def _texts(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return docs.select(*carry, F.col("text").cast("string").alias("text to encode"))


def encode(docs: DataFrame, model_path: str, end_id: bool = True,
           carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and ``ids`` of every row. The driver reads the model, whose size is fixed."""
    model = _model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            yield from _encoded(batch, table, [table.end] if end_id else [])

    rows = _texts(docs, carry)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], _IDS]))


def round_trip(docs: DataFrame, model_path: str,
               carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``decode`` of ``encode`` in one pass of one worker: ``carry``, ``ids`` and their ``text``."""
    model = _model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            for part in _encoded(batch, table, [table.end]):
                yield _decoded(part, table)

    rows = _texts(docs, carry)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], _IDS, _TEXT]))


def decode(encoded: DataFrame, model_path: str,
           carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, ``ids`` and the ``text`` that they stand for; null ids give an empty text."""
    model = _model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            yield _decoded(batch, table)

    rows = encoded.select(*carry, "ids")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, _TEXT]))
