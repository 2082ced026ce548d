"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.llm import (chat, embedding_dedup, html_text, merkle, minhash, mixing, quality,
                             secrets, sentencepiece_bpe, token_links, token_rollup, toxicity,
                             url_rules)
from methylspark.llm.tables import Written, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def tokenizer_path(name: str) -> str:
    """Where a file of the public tokenizers lies."""
    import public_tokenizers
    return os.environ.get("LLM_TOKENIZER_DIR", "") and os.path.join(
        os.environ["LLM_TOKENIZER_DIR"], name) or public_tokenizers.path(name)


@query
def op1_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    kinds = [r.kind for r in secrets.RULES[:secrets.BASE]]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in kinds),
                        digest(told(base)).alias("base_sha256"),
                        told(F.col("spans")).alias("spans"))


@query
def op2_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.char_length("text").cast("long"))


@query
def op3_mix(spark, sf_dir):
    mixed, told = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.withColumn("source", F.get("pattern", F.lit(0))).join(
        F.broadcast(told), "source").select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_embeddings(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: What counts as a token, by tokenizer version.
TOKENIZERS = {"words": mixing.WORD, "letters": r"[\p{L}\p{N}]+"}


@query
def op6_rollup(spark, sf_dir):
    """Load all documents with a first count, of what lies between spaces; revise the counts that
    differ from the tokenizer's; take down documents of low quality; recount toxic ones by a new
    tokenizer; and commit a batch twice."""
    docs = table(spark, sf_dir, "documents")
    counts = {f"n_{k}": F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long")
              for k, p in (TOKENIZERS | {"first": "[^ ]+"}).items()}
    counted = Written(spark)(docs.select("doc_id", "source", "lang", *(
        c.alias(k) for k, c in counts.items())))
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = counted.join(marks, "doc_id").select("source", "lang", *counts, "quality", "toxic")

    def changes(rows: DataFrame, op: str, version: str, n: str | None = None,
                old: str | None = None) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang",
                           F.lit(version).alias("tokenizer"),
                           F.col(n or f"n_{version}").alias("n_tokens"),
                           (F.col(old) if old else F.lit(0)).alias("old_tokens"))

    low = marked.filter("quality = 0")
    toxic = marked.filter("toxic = 1 and coalesce(quality, 1) <> 0")
    rollup = token_rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", changes(counted, "insert", "words", "n_first"))
    rollup.commit("revision", changes(counted.filter("n_first <> n_words"), "revise", "words",
                                      old="n_first"))
    for _ in range(2):  # the second commit finds the first
        rollup.commit("takedown", changes(low, "delete", "words"))
    rollup.commit("recount", changes(toxic, "delete", "words").union(
        changes(toxic, "insert", "letters")))
    return rollup.totals()


@query
def op7_chat(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    # the fixed conversation takes the types of the table
    fixed = spark.range(2).select(
        F.lit(-1).cast(given.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(given.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(both).alias("text"))
    formatted = chat.format_chats(given.unionByName(fixed))
    told = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (formatted
            .withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
            .select("conv_id", F.size(chat.read_turns(F.col("formatted"))).cast("long")
                    .alias("n_turns"), digest(told).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"),
                    digest(F.col("loss")).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars")))


@query
def op8_quality(spark, sf_dir):
    measured = Written(spark)(quality.measures(table(spark, sf_dir, "documents")))
    return quality.judge(measured, quality.references(measured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query
def op9_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query
def op10_sentencepiece(spark, sf_dir):
    decoded = sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"),
                                           tokenizer_path("piece_bpe_32k.model"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          digest(F.array_join("ids", " ")).alias("ids_sha256"),
                          digest(F.col("text")).alias("decoded_sha256"))


@query
def op11_url_rules(spark, sf_dir):
    """The rule is shown where it is one for sites; other patterns are in ``pattern``."""
    judged = url_rules.judge(table(spark, sf_dir, "pages"),
                             url_rules.rule_table(spark, url_rules.RULES))
    return judged.select("page_id", "host", "path",
                         F.when(F.col("won.tier") == 1, F.col("won.pattern")).alias("rule"),
                         "verdict", F.col("won.pattern").alias("pattern"))


@query
def op12_token_links(spark, sf_dir):
    return token_links.link(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                            tokenizer_path("piece_bpe_32k.model"))


#: What lower-casing A-Z replaces.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op13_merkle(spark, sf_dir):
    """The manifest's proofs; texts of every fifth document, by checksum, have been lower-cased."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    tampered = F.when(hit, F.translate("text", UPPER, LOWER))
    leaves = merkle.leaves(table(spark, sf_dir, "documents"), tampered)
    return merkle.prove(merkle.build(leaves, Written(spark))).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


WORDS_SQL = r"[^\x20\x09-\x0D]+"


def _components_sql(nodes: str, links: str) -> str:
    """``reach(id, other)`` over both directions of ``links(a, b)``, each node with itself."""
    return f"""
        ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
        reach AS (SELECT id, id AS other FROM {nodes}
                  UNION SELECT r.id, w.b FROM reach r JOIN ways w ON w.a = r.other)"""


def _op4_sql() -> str:
    return f"""
        WITH RECURSIVE v AS (
            SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
        fit AS (SELECT * FROM v WHERE label IS NOT NULL AND len(vec) > 0
                AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(vec, lambda x: x <> 0)) > 0),
        links AS (SELECT x.id AS a, y.id AS b FROM fit x JOIN fit y
                  ON x.label = y.label AND len(x.vec) = len(y.vec) AND x.id <> y.id
                  WHERE list_cosine_similarity(x.vec, y.vec) >= 0.93),
        {_components_sql("v", "links")}
        SELECT v.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = v.id) AS n_links,
               min(other) AS component_id, v.id = min(other) AS kept
        FROM v JOIN reach r ON r.id = v.id GROUP BY v.id"""


def _op7_sql() -> str:
    def escaped(column: str) -> str:
        out = f"replace({column}, '{chat.ESC}', '{chat.ESC}0')"
        for k, mark in enumerate(chat.CONTROL, 1):
            out = f"replace({out}, '{mark}', '{chat.ESC}{k}')"
        return out

    around = len(chat.START) + len(chat.TEXT) + len(chat.END)
    return f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length({escaped('text')}) AS n, length({escaped('role')}) AS r,
                     lag(role) OVER w IS NOT DISTINCT FROM role AS merged, row_number() OVER w AS k
              FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k))
                   AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT)
                   AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(n + CASE WHEN merged THEN {len(chat.TURN)} ELSE r + {around} END) AS BIGINT)
                   AS formatted_chars
        FROM e GROUP BY conv_id"""


def _op8_sql() -> str:
    classes = ", ".join(
        f"length(regexp_replace(text, '[^{c}]+', '', 'g'))" for c in (
            "a-z", "A-Z", "0-9", r".,;:!?''\"()-", r"\x{0080}-\x{FFFF}",
            r" \t\n\x0B\f\r", quality.SYMBOLS))
    edges = f"'[{quality.CLOSING}]+$', ''), '^.*[{quality.OPENING}]', ''"
    listed = " ".join(
        f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in members)}]"
        for lang, members in quality.COMMON.items())
    return rf"""
        WITH d AS (
            SELECT doc_id, lang, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}') AS w FROM documents),
        windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM (
                SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows)
            CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
        lines AS (
            SELECT doc_id, count(*) - count(DISTINCT x) AS n
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d)
            WHERE regexp_matches(x, '{WORDS_SQL}') GROUP BY doc_id),
        base AS (
            SELECT d.doc_id, lang, text, w, length(text) AS n_chars, len(w) AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                   coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
            FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
        judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR
                   100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed
                   FROM base),
        counts AS (
            SELECT doc_id, lang, n_chars, n_words, base_failed, list_sum(v) AS n_common,
                   list_append(c, n_chars - list_sum(c)) AS c,
                   list_append(v, n_words - list_sum(v)) AS v
            FROM (SELECT *, [{classes}] AS c, list_transform(known, lambda k:
                      coalesce(map_extract_value(h, k), 0)) AS v
                  FROM (SELECT *, list_histogram(list_filter(list_transform(w, lambda x:
                            regexp_replace(regexp_replace(lower(x), {edges})),
                            lambda x: list_contains(known, x))) AS h
                        FROM (SELECT *, CASE lang {listed} END AS known FROM judged)))),
        bins AS (
            SELECT doc_id, lang, n_chars, n_words, base_failed, kind, i, x / sum(x) OVER (
                       PARTITION BY doc_id, kind) AS p, coalesce(n_common, 0) AS n_common
            FROM (SELECT *, 'c' AS kind, unnest(range(len(c))) AS i, unnest(c)::DOUBLE AS x
                  FROM counts
                  UNION ALL SELECT *, 'w', unnest(range(len(v))), unnest(v)::DOUBLE FROM counts)),
        means AS (SELECT lang, kind, i, avg(p) AS q FROM bins
                  WHERE NOT base_failed AND lang IN ('{"', '".join(quality.COMMON)}')
                    AND n_chars >= {quality.MIN_CLASS_CHARS}
                    AND n_common >= {quality.MIN_COMMON_WORDS} GROUP BY ALL),
        far AS (
            SELECT doc_id, kind, sqrt(greatest(0.0, sum(
                       CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                       + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js
            FROM bins JOIN means USING (lang, kind, i)
            WHERE CASE kind WHEN 'c' THEN n_chars >= {quality.MIN_CLASS_CHARS}
                  ELSE n_words >= {quality.MIN_JUDGED_WORDS} END
            GROUP BY doc_id, kind)
        SELECT j.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
               CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT base_failed
               AND coalesce(c.js, 0) <= CASE WHEN n_chars < {quality.LONG_CHARS}
                   THEN {quality.MAX_CLASS_DISTANCE} ELSE {quality.MAX_CLASS_DISTANCE_LONG} END
               AND coalesce(w.js, 0) <= CASE WHEN n_words < {quality.LONG_WORDS}
                   THEN {quality.MAX_WORD_DISTANCE} ELSE {quality.MAX_WORD_DISTANCE_LONG} END AS kept
        FROM judged j LEFT JOIN far c ON c.doc_id = j.doc_id AND c.kind = 'c'
        LEFT JOIN far w ON w.doc_id = j.doc_id AND w.kind = 'w'"""


def _op9_sql() -> str:
    return rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_SQL}') AS w
            FROM documents),
        s AS (SELECT DISTINCT id, x FROM (
            SELECT id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(
                range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM w)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        links AS (
            SELECT a, b FROM (SELECT p.id AS a, q.id AS b, count(*) AS common
                              FROM s p JOIN s q ON p.x = q.x AND p.id < q.id GROUP BY ALL)
            JOIN n p ON p.id = a JOIN n q ON q.id = b
            WHERE 100 * common >= 80 * (p.n + q.n - common)),
        {_components_sql("w", "links")}
        SELECT w.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id,
               w.id = min(other) AS kept
        FROM w LEFT JOIN n USING (id) JOIN reach r ON r.id = w.id GROUP BY w.id"""


def _op11_sql() -> str:
    """Every rule's expression on every URL, the longest of the rules for sites first."""
    def fits(rule: url_rules.Rule) -> str:
        def glob(text: str) -> str:
            return "".join({"*": "(.*)", "^": ""}.get(c) or re.escape(c) for c in text)

        word = rule.host.removeprefix("*^").removesuffix("^*")
        host = (rf"(?s)(^|[^0-9a-z]){word}([^0-9a-z]|$)" if "^" in rule.host
                else rf"(?s)^(.*\.)?{glob(rule.host)}$")
        path = rf"(?s)^{glob(rule.path.removesuffix('|'))}{'$' * rule.path.endswith('|')}"
        return f"regexp_matches(host, '{host}') AND regexp_matches(path, '{path}')"

    def first(rules: list[url_rules.Rule], value: str) -> str:
        rules = sorted(rules, key=lambda r: (-len(r.text), r.action != "block", r.text))
        return "CASE " + " ".join(
            f"WHEN {fits(r)} THEN '{getattr(r, value)}'" for r in rules) + " END"

    sites, kinds = url_rules.SITES, url_rules.KINDS
    return rf"""
        WITH u AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}',
                             '{LOWER}') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
        SELECT page_id, host, path, {first(sites, "text")} AS rule,
               coalesce({first(sites, "action")}, {first(kinds, "action")}, 'allow') AS verdict,
               coalesce({first(sites, "text")}, {first(kinds, "text")}) AS pattern FROM u"""


def _op13_sql(heights: tuple[int, int] = (5, 3)) -> str:
    """Level by level: 16 leaves to a run, up to 16^5 rows a source and 16^3 sources."""
    def told(column: str) -> str:
        return f"coalesce(strlen({column}) || ':' || {column}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(told, (
            "CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))) + ")"

    # crc32 bit by bit over a byte, as a table
    table_of = """(SELECT list(c ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z:
            CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)))"""
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])))"""
    steps = [f"""
        docs AS (
            SELECT doc_id, source, {leaf("text")} AS leaf,
                   CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")}
                   ELSE {leaf("text")} END AS other FROM documents, {table_of}),
        low0 AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)
                   - 1 AS id, source AS g, leaf AS h FROM docs)"""]

    def climb(name: str, height: int) -> None:
        """``name{k}``: nodes of level k, with the siblings of each, once that level is needed."""
        for k in range(height):
            steps.append(f"""
        {name}_run{k} AS (
            SELECT g, id // 16 AS run, string_agg(h, '' ORDER BY id) AS s FROM {name}{k}
            GROUP BY ALL),
        {name}_many{k} AS (SELECT g, count(*) AS n FROM {name}{k} GROUP BY g),
        {name}_way{k} AS (
            SELECT x.g, x.id, CASE WHEN n > 1 THEN substr(s, 1, (x.id % 16) * 64) ELSE '' END AS l,
                   CASE WHEN n > 1 THEN substr(s, (x.id % 16) * 64 + 65) ELSE '' END AS r, n > 1 AS up
            FROM {name}{k} x JOIN {name}_run{k} y ON x.g IS NOT DISTINCT FROM y.g
                 AND x.id // 16 = y.run JOIN {name}_many{k} m ON x.g IS NOT DISTINCT FROM m.g),
        {name}{k + 1} AS (
            SELECT y.g, run AS id, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS h
            FROM {name}_run{k} y JOIN {name}_many{k} m ON y.g IS NOT DISTINCT FROM m.g)""")

    low, high = heights
    climb("low", low)
    steps.append(f"""
        high0 AS (SELECT 0 AS g, g AS source, h,
                         row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS id FROM low{low})""")
    climb("high", high)
    proof: list[str] = []
    for name, height, place in (("low", low, "d"), ("high", high, "s")):
        for k in range(height):
            t = f"{name[0]}{k}"
            steps.append(f"""
        {t}_fold AS (SELECT d.*, CASE WHEN {t}.up THEN sha256({t}.l || d.f || {t}.r) ELSE d.f END AS f2,
                            d.p || {t}.l || {t}.r AS p2
                     FROM {'start' if not proof else proof[-1]} d JOIN {name}_way{k} {t}
                     ON {t}.g IS NOT DISTINCT FROM d.{place}_g AND {t}.id = d.{place}_id // {16 ** k}),
        {t}_done AS (SELECT * EXCLUDE (f2, p2) REPLACE (f2 AS f, p2 AS p) FROM {t}_fold)""")
            proof.append(f"{t}_done")
    first = steps.index(next(s for s in steps if "l0_fold" in s))
    steps.insert(first, """
        start AS (SELECT d.doc_id, d.leaf, d.g AS d_g, d.id AS d_id, s.g AS s_g, s.id AS s_id,
                         s.h AS subroot, d.other AS f, '' AS p
                  FROM low0 d JOIN high0 s ON s.source IS NOT DISTINCT FROM d.g)""")
    return f"""WITH {",".join(steps)}
        SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root,
               f = h AS verified FROM {proof[-1]}, high{high}"""


ORACLE: dict[str, str] = {
    "op11_url_rules": _op11_sql(), "op13_merkle": _op13_sql(),
    "op4_embeddings": _op4_sql(), "op7_chat": _op7_sql(), "op8_quality": _op8_sql(),
    "op9_minhash": _op9_sql(),
    "op6_rollup": rf"""
        WITH c AS (
            SELECT d.source, d.lang,
                   len(regexp_extract_all(coalesce(d.text, ''), '{WORDS_SQL}')) AS n_words,
                   len(regexp_extract_all(coalesce(d.text, ''), '[\p{{L}}\p{{N}}]+')) AS n_letters,
                   coalesce(l.quality, 1) = 0 AS low, coalesce(l.toxic, 0) = 1 AS toxic
            FROM documents d LEFT JOIN (
                SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic
                FROM labels GROUP BY doc_id) l USING (doc_id))
        SELECT source, lang, CASE WHEN toxic THEN 'letters' ELSE 'words' END AS tokenizer,
               count(*) AS n_docs,
               CAST(sum(CASE WHEN toxic THEN n_letters ELSE n_words END) AS BIGINT) AS n_tokens
        FROM c WHERE NOT low GROUP BY ALL""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
