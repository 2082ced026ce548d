"""Quality rules: counts of a text, and its distance from its language's usual histograms.

Besides the base rules (word count, repeated three-word windows) a text is compared with the
reference of its language by Jensen-Shannon distance (base 2, 0 to 1), once over character classes
and once over its words: each listed common word, and one bin for all others. Case and punctuation at
a word's edges do not matter there. References are the mean histograms of all texts of that
language which pass the base rules and have enough common words, so they follow the corpus. Languages
without a list of common words have no reference and are judged by the base rules alone, as are texts
shorter than the guards. A text is rejected if either distance exceeds its limit; one without any
common word is as far as a text can be.

Null text counts as empty; empty and blank texts have zero counts and fail by their word count.
Repeated rows are judged alike, each on its own row. An empty table gives an empty result. Input
columns other than doc_id, text and lang are ignored. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methylspark.llm.tables import BLANK, Written, let, maybe_small, words

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Guards: shorter texts have no such distance.
MIN_CLASS_CHARS, MIN_JUDGED_WORDS = 200, 100
#: Common words that a text needs to be part of a reference.
MIN_COMMON_WORDS = 20
#: Histograms of short texts scatter more, so their limit is wider.
LONG_CHARS, MAX_CLASS_DISTANCE, MAX_CLASS_DISTANCE_LONG = 1600, 0.3, 0.2
LONG_WORDS, MAX_WORD_DISTANCE, MAX_WORD_DISTANCE_LONG = 200, 0.275, 0.23

#: Common words by language: fixed values.
COMMON = {
    "en": "the of and to a in is it that for on are as with his they at be this from".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur pas au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
N_COMMON = 20
#: Punctuation at the edges of words.
OPENING, CLOSING = '("', '.,;:!?")'
SYMBOLS = "#*$%&|<>"
#: Character classes counted by runs; beside them stand blanks, symbols and what is left over.
CLASSES = ["a-z", "A-Z", "0-9", r".,;:!?'\"()-", r"\u0080-￿"]
N_CLASSES = len(CLASSES) + 3


def _chars_of(text: Column, members: str) -> Column:
    """How many characters of a text belong to a class."""
    return F.char_length(F.regexp_replace(text, f"[^{members}]+", ""))


def _covered(windows: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``windows`` in text order."""
    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    repeated = let(ordered, lambda s: F.array_sort(F.transform(F.filter(
        F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (
            F.coalesce(x["w"] == F.get(s, k - 1)["w"], F.lit(False))
            | F.coalesce(x["w"] == F.get(s, k + 1)["w"], F.lit(False))).alias("twice"))),
        lambda x: x["twice"]), lambda x: x["i"])))
    # a window covers three words, or as many as lie before the next repeated window
    steps = let(repeated, lambda p: F.transform(
        p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def _common_counts() -> Column:
    """How often each common word of the row's language stands in ``text``; null without a list."""
    counts = F.lit(None).cast("array<double>")
    for lang, members in COMMON.items():
        # a word begins after a blank or opening mark, and only closing marks stand before its end
        words_of = (rf"(?<![^ \t\n\x0B\f\r{OPENING}])(?:{'|'.join(members)})"
                    rf"(?=[{CLOSING}]*(?:[ \t\n\x0B\f\r]|\z))")
        # each stands between blanks of its own, so that replacement counts them
        found = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(
            F.lower("text"), F.lit(words_of), F.lit(0)), "  "), F.lit(" "))
        keys = [F.lit(f" {w} ") for w in members]
        counted = let(found, lambda s: F.array(*(
            (F.length(s) - F.length(F.replace(s, k, F.lit("")))) / F.length(k)
            for k in keys)))
        counts = F.when(F.col("lang") == lang, counted).otherwise(counts)
    return counts


def row_key() -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64("doc_id", "text")


def measures(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every row, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", row_key().alias("row_key"), "lang", text.alias("text"))
    split = base.select("*", words(F.col("text")).alias("w"))
    windows = F.when(F.size("w") > 2, F.transform(
        F.sequence(F.lit(0), F.size("w") - 3),
        lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    ).otherwise(F.array().cast("array<string>"))
    n_repeat = let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0))
                   .otherwise(_covered(t)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    n_dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = [_chars_of(F.col("text"), c) for c in CLASSES]
    first = split.select(
        "doc_id", "row_key", "lang", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        _chars_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"), n_repeat.cast("long").alias("n_repeat_words"),
        F.char_length("text").alias("n_chars"), F.array(*counts).alias("classes"),
        _common_counts().alias("common"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return (first
            .withColumn("classes", F.transform(F.concat("classes", F.array(
                F.col("n_chars") - F.col("word_chars"), F.col("n_symbols"))),
                lambda x: x.cast("double")))
            .withColumn("classes", F.concat("classes", F.array(
                F.col("n_chars") - total(F.col("classes")))))
            .withColumn("n_common", F.coalesce(total(F.col("common")), F.lit(0.0)))
            .withColumn("common", F.concat("common", F.array(F.col("n_words") - F.col("n_common"))))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))))


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return let(total, lambda n: F.transform(counts, lambda x: x / n))


def references(measured: DataFrame) -> DataFrame:
    """At most one row per listed language: mean shares of character classes and words."""
    usable = measured.filter(
        ~F.col("base_failed") & F.col("lang").isin(*COMMON)
        & (F.col("n_chars") >= MIN_CLASS_CHARS) & (F.col("n_common") >= MIN_COMMON_WORDS))
    shares = usable.select("lang", _share(F.col("classes")).alias("c"),
                           _share(F.col("common")).alias("w"))
    means = [F.avg(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
    means += [F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(N_COMMON + 1)]
    return shares.groupBy("lang").agg(*means).select(
        F.col("lang").alias("ref_lang"),
        F.array(*(f"c{i}" for i in range(N_CLASSES))).alias("ref_classes"),
        F.array(*(f"w{i}" for i in range(N_COMMON + 1))).alias("ref_common"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two share arrays, base 2."""
    def term(x: Column, m: Column) -> Column:
        return F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(F.lit(0.0))

    each = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, b: a + b)))


def judge(measured: DataFrame, refs: DataFrame) -> DataFrame:
    """Distances and the verdict of every measured row."""
    joined = measured.join(F.broadcast(refs), F.col("lang") == F.col("ref_lang"), "left")
    by_class = F.when(F.col("n_chars") >= MIN_CLASS_CHARS,
                      js_distance(_share(F.col("classes")), F.col("ref_classes")))
    by_word = F.when(F.col("n_words") >= MIN_JUDGED_WORDS,
                     js_distance(_share(F.col("common")), F.col("ref_common")))
    return (joined.withColumn("class_distance", by_class).withColumn("word_distance", by_word)
            .withColumn("kept", ~F.col("base_failed")
                        & (F.coalesce("class_distance", F.lit(0.0)) <= F.when(
                            F.col("n_chars") < LONG_CHARS, F.lit(MAX_CLASS_DISTANCE))
                            .otherwise(F.lit(MAX_CLASS_DISTANCE_LONG)))
                        & (F.coalesce("word_distance", F.lit(0.0)) <= F.when(
                            F.col("n_words") < LONG_WORDS, F.lit(MAX_WORD_DISTANCE))
                            .otherwise(F.lit(MAX_WORD_DISTANCE_LONG))))
            .select("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"))


def keep_good(docs: DataFrame, keep: Written | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    keep = keep or Written(docs.sparkSession)
    measured = keep(measures(docs))
    bad = keep(judge(measured, references(measured)).filter("not kept").select("row_key")
               .distinct())
    # rows are told apart by a key of their own; the given columns lie in a struct
    rows = docs.select(row_key().alias("row_key"), F.struct(*docs.columns).alias("doc"))
    return rows.join(maybe_small(bad), "row_key", "left_anti").select("doc.*")
