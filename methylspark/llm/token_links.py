"""Alignment of two tokenizers' tokens by partitioned merging of their ends.

Both tokenizers cut the same bytes, so the tokens of A and of B are two ascending lists of end
offsets. Their merge is divided by the merge path: on every diagonal of a fixed number of ends a
binary search finds how many ends of A and of B lie before it, which gives pieces of equal work,
whatever the lengths of the documents. Each piece by itself emits the overlaps of its ends: every
different end closes the overlap of one token of A with one of B. Ends of both kinds close groups; a
group that runs over pieces is stitched by the counts of such ends in the pieces before.

Texts beyond :data:`STRETCH` characters are tokenized a stretch at a time, cut before lone blanks
between printable ASCII characters. No token of either kind crosses these, so a cut ends a group
too, and Spark joins the stretches of a document again. A long text without such blanks is one stretch.

For the counts, a task sums the pairs of its documents before they are shuffled. The totals come back
to the pairs of each document by a broadcast while they are few; beyond, the most frequent ones are
broadcast and the rest, none of them frequent, are joined.

Null, empty and deviating texts (those whose tokens do not give back blank + text) have no tokens:
zeros and ''. Repeated rows are documents of their own, also for the counts. An empty table gives an
empty result. Only doc_id and text are read. Special tokens' strings count as plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylspark.llm.tables import SMALL, Written

#: Characters of a stretch, and ends of a piece.
STRETCH, PIECE = 300_000, 1 << 14
#: Cuts that are safe for both tokenizers.
CUT = re.compile("(?<=[!-~]) (?=[!-~])")

STRETCHES = ("row LONG, doc_id {doc_id}, stretch INT, whole BOOLEAN, same BOOLEAN, n_a LONG, "
             "n_b LONG, n_groups LONG, n_links LONG, groups STRING, pairs ARRAY<INT>, "
             "times ARRAY<INT>")


def byte_of_char() -> dict[str, int]:
    """The bytes behind the characters of byte-level vocabularies: printable ones stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


# Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Tokenizers:
    """Both tokenizers and the bytes of their entries.

    A's file is read here and its merges are run by a library that remembers no words; the tests
    hold its ids against the library that the file is made for. Files with another way to cut texts,
    or whose merges are not in the order of their ids, are refused.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tiktoken
        with open(path_a, encoding="utf-8") as file:
            told = json.load(file)
        cut, model, real = told["pre_tokenizer"], told["model"], byte_of_char()
        ids = {bytes(map(real.__getitem__, token)): k for token, k in model["vocab"].items()}
        order = [ids[bytes(map(real.__getitem__, "".join(m).replace(" ", "")))]
                 for m in model["merges"]]
        if (model["type"] != "BPE" or told["normalizer"] or cut["type"] != "ByteLevel"
                or cut["add_prefix_space"] or not cut["use_regex"] or order != sorted(order)):
            raise ValueError(f"{path_a} is not a plain byte-level BPE")
        self._a = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ids.values()) + 1)
        for token, k in ids.items():
            self.bytes_a[k] = token
        self.bytes_b = []
        for k in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self._b.is_byte(k)
                                else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64)
                                    for x in (self.bytes_a, self.bytes_b))
        if len(self.bytes_a) * len(self.bytes_b) >= 1 << 31:
            raise ValueError("pairs of ids must fit 31 bits")
        # text of an id with what follows it: in its list, and at the list's end
        self.told = [f"{k}{end}" for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";"))
                     for k in range(n) for end in (",", last)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return ([self._a.encode_ordinary(" " + t) for t in texts],
                self._b.encode(texts, num_threads=1))

    def same(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether both lists of tokens give back blank + text."""
        raw = b" " + text.encode()
        return (b"".join(map(self.bytes_a.__getitem__, a)) == raw
                and b"".join(map(self.bytes_b.__getitem__, b)) == raw)


def merge_path(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the ascending ``a`` and ``b`` lie before every ``step``-th diagonal of their
    merge, from none to all. Equal values are not parted."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = open_.copy()
        before[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        low = np.where(before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)
    i, j = low, d - low
    split = (i > 0) & (j < len(b))
    split[split] = a[i[split] - 1] == b[j[split]]
    return i, j + split


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of A and B under each different end of one piece, counted from the piece's first
    ones, and the ends that both have."""
    ends = np.concatenate([a, b])
    ends.sort(kind="stable")
    again = np.append(False, ends[1:] == ends[:-1])[:len(ends)]
    common, ends = ends[again], ends[~again]
    return np.searchsorted(a, ends), np.searchsorted(b, ends), common


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """Links as token numbers of A and of B, and the group of every token of A and of B.

    ``a`` and ``b`` are strictly ascending ends over the same bytes.
    """
    i, j = merge_path(a, b, piece)
    of_a, of_b, commons, stitched = [], [], [], 0
    group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    for i0, i1, j0, j1 in zip(i, i[1:], j, j[1:], strict=False):
        x, y = a[i0:i1], b[j0:j1]
        links_a, links_b, common = overlaps(x, y)
        of_a.append(i0 + links_a)
        of_b.append(j0 + links_b)
        group_a[i0:i1] = stitched + np.searchsorted(common, x)
        group_b[j0:j1] = stitched + np.searchsorted(common, y)
        stitched += len(common)
        commons.append(common)
    none = np.zeros(0, np.int64)
    return (np.concatenate([none, *of_a]), np.concatenate([none, *of_b]), group_a, group_b,
            np.concatenate([none, *commons]))


def _stretches(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > STRETCH and (m := CUT.search(text, at + STRETCH)):
        out.append(text[at:m.start()])
        at = m.end()
    return [*out, text[at:]]


def _told(tools: Tokenizers, a, b, group_a, group_b) -> list[str]:
    """Of every token, A's and B's group by group, the number and what follows it."""
    key_a = 2 * a + np.append(np.diff(group_a) > 0, True)
    key_b = 2 * (len(tools.bytes_a) + b) + np.append(np.diff(group_b) > 0, True)
    keys = np.empty(len(a) + len(b), np.int64)
    keys[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = key_a
    keys[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = key_b
    return list(map(tools.told.__getitem__, keys.tolist()))


def _rows(tools: Tokenizers, given: list[tuple], type_of: pa.DataType) -> pa.RecordBatch:
    """Result rows of ``(row, doc_id, stretch, whole, text)``: one merge for all of them, since the
    end of a text is an end of both kinds."""
    all_a, all_b = tools.encode([g[4] for g in given])
    same = [bool(g[4]) and tools.same(g[4], x, y)
            for g, x, y in zip(given, all_a, all_b, strict=True)]
    all_a = [x if ok else [] for x, ok in zip(all_a, same, strict=True)]
    all_b = [x if ok else [] for x, ok in zip(all_b, same, strict=True)]
    n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (all_a, all_b))
    a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (all_a, all_b))
    link_a, link_b, group_a, group_b, common = align(
        np.cumsum(tools.size_a[a]), np.cumsum(tools.size_b[b]))
    edge_a, edge_b = (np.append(0, np.cumsum(n)) for n in (n_a, n_b))
    # a text's links and groups are those of its tokens of A
    edge_link = np.searchsorted(link_a, edge_a)
    edge_group = np.append(group_a, len(common))[edge_a]
    told = _told(tools, a, b, group_a, group_b)
    edge_told = edge_a + edge_b

    text = np.repeat(np.arange(len(given)), np.diff(edge_link))
    keys = text << 31 | a[link_a] * len(tools.bytes_b) + b[link_b]
    keys, times = np.unique(keys, return_counts=True)
    offsets = np.searchsorted(keys >> 31, np.arange(len(given) + 1))
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32()))
             for x in (keys & ((1 << 31) - 1), times)]
    joined = []
    for k, g in enumerate(given):
        groups = "".join(told[edge_told[k]:edge_told[k + 1]])[:-1]
        joined.append(hashlib.sha256(groups.encode()).hexdigest() if g[3] and groups else groups)
    row, doc_id, stretch, whole, _ = zip(*given, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(row, pa.int64()), pa.array(doc_id, type_of), pa.array(stretch, pa.int32()),
         pa.array(whole), pa.array(same), pa.array(n_a), pa.array(n_b),
         pa.array(np.diff(edge_group)), pa.array(np.diff(edge_link)), pa.array(joined), *lists],
        ["row", "doc_id", "stretch", "whole", "same", "n_a", "n_b", "n_groups", "n_links", "groups",
         "pairs", "times"])


_ready: dict[tuple[str, str], Tokenizers] = {}


def stretches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per stretch of text: counts of tokens, groups and links, its different linked pairs
    (id of A times the size of B's vocabulary plus id of B) with how often each occurs, and
    ``groups``, the text of the groups, hashed where the stretch is the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = path_a, path_b
        tools = _ready[key] = _ready.get(key) or Tokenizers(*key)
        # place of a row in its input, the same when a task is run again
        row = TaskContext.get().partitionId() << 40
        some, size = [], 0
        for batch in batches:
            type_of = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = _stretches(text.as_py() or "")
                for k, part in enumerate(parts):
                    some.append((row, doc_id, k, len(parts) == 1, part))
                    size += len(part)
                    if size >= STRETCH:
                        yield _rows(tools, some, type_of)
                        some, size = [], 0
                row += 1
        if some:
            yield _rows(tools, some, type_of)

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, STRETCHES.format(doc_id=given.schema["doc_id"].dataType
                                                  .simpleString()))


def count_pairs(parts: DataFrame) -> DataFrame:
    """``pair, n``: how many documents hold a pair; summed in the tasks before the shuffle."""
    whole = parts.filter("whole").select(F.explode("pairs").alias("pair"))
    # the stretches of a long text may repeat a pair
    long = parts.filter("not whole and pairs is not null").select(
        "row", F.explode("pairs").alias("pair")).distinct().select("pair")
    return whole.union(long).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _stitched(parts: DataFrame) -> DataFrame:
    """Stretches with those of texts cut in several joined again, as if there had been no cut."""
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    cut = parts.filter("not whole").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.min("same").alias("same"),
        *(F.sum(c).alias(c) for c in counts),
        F.sort_array(F.collect_list(F.struct("stretch", "groups"))).alias("g"))
    joined = F.sha2(F.array_join(F.transform("g", lambda g: g["groups"]), ";"), 256)
    kept = F.col("same")
    cut = cut.select("row", "doc_id", "same", *(
        F.when(kept, F.col(c)).otherwise(0).alias(c) for c in counts),
        F.when(kept, joined).otherwise("").alias("groups_sha256"))
    pairs = parts.filter("not whole").join(
        cut.filter("same").select("row"), "row").select("row", "pairs", "times")
    whole = parts.filter("whole").select(
        "row", "doc_id", "same", *counts, F.col("groups").alias("groups_sha256"), "pairs", "times")
    nothing = F.lit(None).cast("array<int>")
    # the counts of a cut text on one row, its pairs on one row for each stretch
    return whole.unionByName(cut.withColumn("pairs", nothing).withColumn("times", nothing)).unionByName(
        pairs, allowMissingColumns=True)


def link(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    keep = Written(docs.sparkSession)
    n_b = _pieces(path_b)
    parts = keep(stretches(docs, path_a, path_b))
    alive = parts
    broken = keep(parts.filter("not whole and not same").select("row").distinct())
    alive = parts.join(F.broadcast(broken), "row", "left_anti") if broken.count() <= SMALL else (
        parts.join(broken, "row", "left_anti"))
    counts = keep(count_pairs(alive))
    best = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("most"))
    counts = keep(counts.join(best, F.expr(f"pair div {n_b}") == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")))
    docs_pairs = _stitched(parts)
    told = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    each = docs_pairs.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", "p.pairs", "p.times").withColumnRenamed("pairs", "pair")

    def score(given: DataFrame, known: DataFrame) -> DataFrame:
        return given.join(known, "pair").select(
            "row", (F.col("times") * F.col("best")).alias("n_best"),
            (F.col("times") * F.col("n")).alias("count_sum"))

    if (n := counts.count()) <= SMALL:
        scored = score(each, F.broadcast(counts))
    else:
        # at most SMALL pairs can be in so many documents
        limit = counts.agg(F.sum("n")).first()[0] // SMALL + 1
        often = F.broadcast(counts.filter(F.col("n") >= limit))
        scored = score(each, often).unionByName(score(
            each.join(often.select("pair"), "pair", "left_anti"),
            counts.filter(F.col("n") < limit)))
    sums = scored.groupBy("row").agg(F.sum("n_best").alias("n_best"),
                                     F.sum("count_sum").alias("count_sum"))
    rows = docs_pairs.filter("n_a is not null").select("row", *told)
    return rows.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _pieces(path_b: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
