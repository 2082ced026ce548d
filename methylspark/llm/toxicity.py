"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

For toxic and for ordinary training texts the byte n-grams (2 to ``ORDER``) of all words are counted
over the whole corpus. A class gives a byte after its history the discounted count of its own model
plus the mass that discounting leaves, spread by a backoff model which both classes share and which
is itself an interpolated Kneser-Ney model of all counts: below ``ORDER`` it counts the different
bytes before an n-gram. A word's evidence is the difference of its
two log-likelihoods. A text has two length-normalised features: mean evidence per byte, and mean
evidence above ``FLOOR`` per word, so that a few strong words in a long text still show. A logistic
regression turns them into the score.

Counts come from labelled rows with crc32(doc_id) mod 5 in 1..3; the regression is fitted on at most
``MAX_FIT`` rows with remainder 4; remainder 0 is held out. Counts are kept by exact n-gram in tables
that grow with the corpus. A byte's evidence depends only on the n-gram that ends there, so it is
computed once for every distinct n-gram of the corpus, by joins. N-grams are sent to every task with
their evidence, in slices of about ``SMALL`` of which a task holds one at a time: texts are neither
moved nor taken apart into rows. Beyond ``SLICES`` such slices words meet it in joins too, with the
same result: evidence is kept in whole ``UNIT`` parts, whose sums do not depend on their order.

Null, empty and blank texts have no evidence and get the score of zero features. Rows repeat their
score. Labels that are null, or other than 0 and 1, are ignored; a doc_id with several labels counts
as toxic if one says so. Without rows of both classes every score is the share of toxic labels (0
where there are none). Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from methylspark.llm.shingles import _LOWER, _SPACE, word_hashes
from methylspark.llm.tables import SMALL, Written, maybe_small

ORDER, DISCOUNT, FLOOR, MAX_FIT, UNIT = 5, 0.75, 2.0, 20_000, 1 << 24
#: Bytes of texts looked at in one go, and how many such stretches meet a slice each time it is loaded.
STRETCH, HOLD = 1_000_000, 4
#: Slices of a table that are sent to every task: about 1 GB on an executor's disk, 16 MB in a task.
SLICES = 64


def distinct_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts in one buffer: which distinct word stands at each place, where each word
    begins, and start and end of the distinct words."""
    hashes = word_hashes(raw)
    space = np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return which, edge[::2], edge[::2][first], edge[1::2][first]


def grams(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of each predicted byte of the framed words, and the ``ORDER`` bytes that end there
    as a number, the last byte lowest."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    pad = ORDER - 1
    length = end - start + pad + 1
    ends = np.cumsum(length)
    word = np.repeat(np.arange(len(start)), length)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    source = np.repeat(start, length) + inside - pad
    real = (inside >= pad) & (inside < np.repeat(length, length) - 1)
    flat = np.full(len(inside), 32, np.int64)
    flat[real] = data[source[real]]
    at = np.flatnonzero(inside >= pad)
    code = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        code |= flat[at - k] << (8 * k)
    return word[at], code


def _stretches(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts with about ``STRETCH`` bytes, and the place of the first."""
    at, some, size = 0, [], 0
    for k, text in enumerate(texts):
        buffer = text.as_buffer()
        some.append(b"" if buffer is None else buffer.to_pybytes())
        size += len(some[-1])
        if size >= STRETCH or k == len(texts) - 1:
            yield at, some
            at, some, size = k + 1, [], 0


def count_grams(rows: DataFrame) -> DataFrame:
    """``(gram, ordinary, toxic)`` of every n-gram of ``rows(text, toxic)``; rows without a class
    count for neither."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array([-1 if x is None else x for x in batch.column(1).to_pylist()], np.int64)
            for at, some in _stretches(batch.column(0)):
                raw = b"\n".join(some)
                bounds = np.cumsum([len(s) + 1 for s in some])
                which, places, start, end = distinct_words(raw)
                if not len(which):
                    continue
                text = np.searchsorted(bounds, places, "right")
                weight = [np.bincount(which, toxic[at + text] == c, minlength=len(start))
                          for c in (0, 1)]
                word, codes = grams(raw, start, end)
                gram, inverse = np.unique(codes, return_inverse=True)
                counts = [np.bincount(inverse, w[word]).astype(np.int64) for w in weight]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(counts[0]), pa.array(counts[1])],
                    ["gram", "ordinary", "toxic"])

    parts = rows.select(F.col("text").cast("string"), F.col("toxic").cast("int")).mapInArrow(
        run, "gram long, ordinary long, toxic long")
    return parts.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"),
                                     F.sum("toxic").alias("toxic"))


def _end(n: int) -> Column:
    """The last ``n`` bytes of ``gram``."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))


def _smooth(seen, total, followers, backoff: Column) -> Column:
    """The discounted count, and what discounting leaves for the backoff; null counts are 0."""
    seen, total, followers = (F.coalesce(x, F.lit(0)) for x in (seen, total, followers))
    left = F.least(DISCOUNT * followers, total)
    value = (F.greatest(seen - DISCOUNT, F.lit(0.0)) + left * backoff) / F.greatest(
        total, F.lit(1))
    return F.greatest(F.when(total > 0, value).otherwise(backoff), F.lit(1e-12))


def evidence(counted: DataFrame, keep: Written) -> DataFrame:
    """``(gram, evidence)``: toxic minus ordinary log-probability of the last byte of every n-gram
    of ``counted``, in ``UNIT`` parts.

    Below ``ORDER`` an n-gram counts once for each byte it was seen after (blanks of the frame are
    bytes), and every byte value has a share of what discounting leaves at order 1.
    """
    both = F.col("ordinary") + F.col("toxic")
    seen = {ORDER: counted.filter(both > 0).select("gram", both.alias("seen"), "ordinary", "toxic")}
    for n in range(ORDER - 1, 0, -1):
        seen[n] = keep(seen[n + 1].groupBy(_end(n).alias("gram")).agg(F.count("*").alias("seen")))
    total, kinds = seen[1].agg(F.coalesce(F.sum("seen"), F.lit(0)), F.count("*")).first()
    out = counted
    for n in range(1, ORDER + 1):
        if n < ORDER:
            grams_n = seen[n].withColumnsRenamed({"gram": "end", "seen": "seen_n"})
            out = out.withColumn("end", _end(n)).join(maybe_small(grams_n), "end", "left").drop("end")
        else:
            out = out.withColumn("seen_n", both)
        if n == 1:
            p = _smooth(F.col("seen_n"), F.lit(total), F.lit(kinds), F.lit(1 / 256))
        else:
            sums = [F.sum("seen").alias("total"), F.count("*").alias("followers")]
            if n == ORDER:
                sums += [f(x).alias(f"{k}_{x}") for x in ("ordinary", "toxic")
                         for k, f in (("total", F.sum), ("followers", lambda x: F.count_if(F.col(x) > 0)))]
            before = keep(seen[n].groupBy(F.shiftright("gram", 8).alias("before")).agg(*sums))
            out = out.withColumn("before", F.shiftright(_end(n), 8)).join(
                maybe_small(before), "before", "left").drop("before")
            p = _smooth(F.col("seen_n"), F.col("total"), F.col("followers"), F.col("p"))
        out = out.withColumn("p", p).drop("seen_n", "total", "followers")
    log = {x: F.log(_smooth(F.col(x), F.col(f"total_{x}"), F.col(f"followers_{x}"), F.col("p")))
           for x in ("ordinary", "toxic")}
    return out.select("gram", F.round((log["toxic"] - log["ordinary"]) * UNIT).cast("long").alias(
        "evidence"))


class Sliced:
    """A table of distinct numbers and a value of each, on every executor's disk in slices of about
    ``SMALL`` rows; the driver and a task hold one slice at a time."""

    def __init__(self, table: DataFrame, rows: int) -> None:
        key, value = table.columns
        cuts = max(1, -(-rows // SMALL))
        inner = table.agg(F.percentile_approx(
            key, [k / cuts for k in range(1, cuts)], 100 * cuts)).first()[0] if cuts > 1 else []
        self.slices = []
        for low, high in zip([None, *inner], [*inner, None], strict=True):
            part = table
            part = part if low is None else part.filter(F.col(key) > low)
            told = (part if high is None else part.filter(F.col(key) <= high)).toArrow()
            keys, values = (told.column(k).to_numpy() for k in (key, value))
            order = np.argsort(keys)
            self.slices.append(table.sparkSession.sparkContext.broadcast((keys[order], values[order])))

    def look_up(self, wanted: np.ndarray, default: int) -> np.ndarray:
        """The values of sorted numbers, ``default`` for those that are not in the table."""
        out = np.full(len(wanted), default, np.int64)
        for shared in self.slices:
            # A worker would keep what it reads by ``value``, so with several slices this reads the file.
            one = len(self.slices) == 1 or not shared._path
            keys, values = shared.value if one else shared.load_from_path(shared._path)
            if len(keys):
                part = slice(*np.searchsorted(wanted, [keys[0], keys[-1] + 1]))
                at = np.minimum(np.searchsorted(keys, wanted[part]), len(keys) - 1)
                out[part] = np.where(keys[at] == wanted[part], values[at], default)
        return out


class Stretch:
    """Some texts as words and n-grams, and their features once the n-grams have evidence."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = b"\n".join(texts)
        self.n = len(texts)
        which, places, start, end = distinct_words(raw)
        text = np.searchsorted(np.cumsum([len(s) + 1 for s in texts]), places, "right")
        self.size = end - start + 1
        word, codes = grams(raw, start, end)
        self.codes, inverse = np.unique(codes, return_inverse=True)
        # Several stretches are held at once, so places are kept in half the bytes.
        self.which, self.text, self.word, self.inverse = (
            x.astype(np.int32) for x in (which, text, word, inverse))

    def features(self, value: np.ndarray) -> np.ndarray:
        """Mean evidence per byte, and mean evidence above the floor per word, of each text; ``value``
        is the evidence of ``codes``."""
        out = np.zeros((self.n, 2))
        if not len(self.which):
            return out
        of_word = np.bincount(self.word, value[self.inverse], minlength=len(self.size))
        chars = np.bincount(self.text, self.size[self.which], minlength=self.n) * UNIT
        out[:, 0] = np.bincount(self.text, of_word[self.which], minlength=self.n) / np.maximum(chars, 1)
        words = np.bincount(self.text, minlength=self.n) * UNIT
        above = np.maximum(of_word - FLOOR * UNIT, 0)[self.which]
        out[:, 1] = np.bincount(self.text, above, minlength=self.n) / np.maximum(words, 1)
        return out


def _features(stretches: Iterator[tuple[int, list[bytes]]], model: Sliced) -> Iterator[np.ndarray]:
    """Features of all texts, ``HOLD`` stretches at a time."""
    while held := [Stretch(some) for _, some in islice(stretches, HOLD)]:
        codes = np.unique(np.concatenate([s.codes for s in held]))
        value = model.look_up(codes, 0)
        for s in held:
            yield s.features(value[np.searchsorted(codes, s.codes)])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a slightly ridged logistic regression by Newton's method; the last is constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _spread(x: np.ndarray) -> np.ndarray:
    """Features on a scale where strong evidence does not drown weak evidence."""
    return np.column_stack([np.clip(x[:, 0], -1, 1) * 10, np.log1p(200 * x[:, 1]),
                            np.log1p(200 * x[:, 1]) ** 2 / 10])


def _scored(rows: DataFrame, model: Sliced, keep: list[str]) -> DataFrame:
    """``keep`` columns and the two features of every row by a model in slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_features(_stretches(batch.column(len(keep))), model))
            x = np.concatenate(found) if found else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(x[:, 0]), pa.array(x[:, 1])], [*keep, "f0", "f1"])

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, F.col("text").cast("string")).mapInArrow(
        run, f"{fields}, f0 double, f1 double")


def _words_of(rows: DataFrame) -> DataFrame:
    """``(mark, word, n)`` for the distinct words of texts, each text by its ``mark``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _stretches(batch.column(1)):
                raw = b"\n".join(some)
                which, places, start, end = distinct_words(raw)
                if not len(which):
                    continue
                text = np.searchsorted(np.cumsum([len(s) + 1 for s in some]), places, "right")
                pair, n = np.unique(text * len(start) + which, return_counts=True)
                lower = _LOWER[np.frombuffer(raw, np.uint8)].tobytes()
                words = pa.array([lower[a:b] for a, b in zip(start, end, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + pair // len(start))),
                     words.take(pa.array(pair % len(start))), pa.array(n)], ["mark", "word", "n"])

    return rows.select("mark", F.col("text").cast("string")).mapInArrow(
        run, "mark string, word binary, n long")


def _joined(rows: DataFrame, known: DataFrame, keep: list[str], written: Written) -> DataFrame:
    """As :func:`_scored`, with the evidence of n-grams in a table of any size.

    Equal texts share their sums; both features are means, which copies do not change.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            ends = np.cumsum([len(w) + 1 for w in words])
            if len(words):
                at, codes = grams(b"\n".join(words), np.concatenate([[0], ends[:-1]]), ends - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)),
                                                  pa.array(codes)], ["word", "gram"])

    marked = rows.select(*keep, "text", F.sha2(F.col("text").cast("binary"), 256).alias("mark"))
    words = written(_words_of(marked))
    of_word = words.select("word").distinct().mapInArrow(run, "word binary, gram long").join(
        known, "gram").groupBy("word").agg(F.sum("evidence").alias("evidence"))
    above = F.greatest(F.col("evidence") - F.lit(int(FLOOR * UNIT)), F.lit(0))
    sums = words.join(of_word, "word").groupBy("mark").agg(
        (F.sum(F.col("n") * F.col("evidence")) / (F.sum(F.col("n") * (F.length("word") + 1)) * UNIT))
        .alias("f0"), (F.sum(F.col("n") * above) / (F.sum("n") * UNIT)).alias("f1"))
    zero = [F.coalesce(x, F.lit(0.0)).alias(x) for x in ("f0", "f1")]
    return marked.drop("text").join(sums, "mark", "left").select(*keep, *zero)


def remainder(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` with ``toxic`` of ``known(label_id, toxic)``; null for the others. Texts are not moved while
    the labels fit into slices."""
    n = known.count()
    numbers = {docs.schema["doc_id"].dataType, known.schema["label_id"].dataType} == {LongType()}
    if not numbers or not SMALL < n <= SLICES * SMALL:
        return docs.join(maybe_small(known), F.col("doc_id") == F.col("label_id"), "left")
    labels = Sliced(known.filter("label_id is not null"), n)

    @F.arrow_udf("int")
    def label(ids: pa.Array) -> pa.Array:
        asked, back = np.unique(ids.fill_null(0).to_numpy(), return_inverse=True)
        found = labels.look_up(asked, -1)[back]
        return pa.array(found.astype(np.int32), mask=(found < 0) | ids.is_null().to_numpy(zero_copy_only=False))

    return docs.withColumn("toxic", label("doc_id"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``."""
    spark = docs.sparkSession
    keep = Written(spark)
    known = keep(labels.filter(F.col("toxic").isin(0, 1) & (remainder("doc_id") != 0)).groupBy(
        F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    labelled = _labelled(docs.select("doc_id", "text"), known)
    counted = keep(count_grams(labelled.select("text", F.when(
        remainder("doc_id") < 4, F.col("toxic")).alias("toxic"))))
    table = keep(evidence(counted, keep))
    n_grams = table.count()
    model = Sliced(table, n_grams) if n_grams <= SLICES * SMALL else None

    def scored(rows: DataFrame, columns: list[str]) -> DataFrame:
        return _scored(rows, model, columns) if model else _joined(rows, table, columns, keep)

    fit = labelled.filter((remainder("doc_id") == 4) & F.col("toxic").isNotNull()).select(
        "doc_id", "toxic", "text")
    chosen = fit.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT)
    fit = fit.join(F.broadcast(chosen), "doc_id", "left_semi")
    sample = scored(fit, ["toxic"]).toArrow()
    y = sample.column("toxic").to_numpy().astype(float)
    x = _spread(np.column_stack([sample.column("f0").to_numpy(), sample.column("f1").to_numpy()]))
    both = 0 < y.sum() < len(y)
    weights = _logistic(x, y) if both else None
    share = float(known.agg(F.avg("toxic")).first()[0] or 0) if not both else 0.0

    @F.pandas_udf("double")
    def score(f0: pd.Series, f1: pd.Series) -> pd.Series:
        z = np.column_stack([_spread(np.column_stack([f0, f1])), np.ones(len(f0))]) @ weights
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    features = scored(docs.select("doc_id", "text"), ["doc_id"])
    value = score("f0", "f1") if both else F.lit(share)
    return features.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False))
                           .alias("held_out"), value.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
