import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from methylspark.llm import merkle, queries, token_links, url_rules
from methylspark.llm.tables import Written

SMALL = "/root/testdata/sf0.001"
RULE = url_rules.Rule


# URL rules

URLS = ["https://m.example.org/en/1203#top", "http://EXAMPLE.org/es/1", "http://example.org",
        "http://example.org?x=/es/", "https://notexample.org/es/1", "x://a.com/de/1", "x://com/de/",
        "x://a.com/DE/1", "x://casino-win.example.net/en/1", "x://casinos.example.net/en/1",
        "x://a.net/en/casino/", "x://a.net/file.zip", "x://a.net/file.zip/more", "x://a.net/a/b.zip?q",
        None, "", "no scheme", "a://b://c.org/x", "://org/", "x:///org/", "x://user@a.org:80/x",
        "x://a.org/\nx", "x://a\n.org/x", "x://ä.org/ß", "x://a.com/de/1"]


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id LONG, url STRING").withColumn(
        "host", F.lit(1)).withColumn("rule", F.lit("mine"))


def judged(spark, urls, rules):
    out = url_rules.judge(pages(spark, urls), url_rules.rule_table(spark, rules)).orderBy("page_id")
    return [(r.host, r.path, r.won and r.won.pattern, r.verdict) for r in out.collect()]


@pytest.fixture(params=["local", "join"])
def way(request, monkeypatch):
    if request.param == "join":
        monkeypatch.setattr(url_rules, "LOCAL_RULES", 0)
        monkeypatch.setattr(url_rules, "HOT", 3)


def test_url_rules_for_sites(spark, way):
    rules = url_rules.SITES
    want = []
    for url in URLS:
        won = brute.url_rule(url, rules)
        want.append((*brute.url_parts(url), won and won.text, won.action if won else "allow"))
    assert judged(spark, URLS, rules) == want


def test_url_patterns_and_edges_of_tokens(spark, way):
    got = dict(zip(URLS, judged(spark, URLS, url_rules.KINDS), strict=True))
    blocked = {u for u, r in got.items() if r[3] == "block"}
    assert blocked == {"x://casino-win.example.net/en/1", "x://a.net/file.zip",
                       "x://a.net/a/b.zip?q"}
    assert judged(spark, [], url_rules.KINDS) == []


def test_url_rules_against_all_rules_on_all_urls(spark, way):
    draw = random.Random(5)
    hosts = [".".join(draw.choices(["a", "b", "ab", "c1", "x-a"], k=draw.randint(1, 3)))
             for _ in range(40)]
    rules = [RULE(draw.choice(["allow", "block"]), draw.choice(hosts),
                  draw.choice(["", "/", "/a", "/a/", "/b-a", "/A"])) for _ in range(60)]
    rules = list({r.text: r for r in rules}.values())
    urls = [f"z://{draw.choice(hosts)}{draw.choice(['', '/', '/a', '/ab', '/a/b', '/b-ab', '/A/'])}"
            for _ in range(300)]
    for url, got in zip(urls, judged(spark, urls, rules), strict=True):
        host, path = brute.url_parts(url)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host))
               and path.startswith(r.path)]
        fit.sort(key=lambda r: (-len(r.text), r.action != "block", r.text))
        assert got[2:] == ((fit[0].text, fit[0].action) if fit else (None, "allow")), url


def test_rules_are_filed_under_whole_tokens_only():
    assert url_rules.literal_tokens(RULE("block", "example.org", "/en/1")) == ["en", "example", "org"]
    assert url_rules.literal_tokens(RULE("block", "*^win^*", "/a*b/c|")) == ["c", "win"]
    assert url_rules.literal_tokens(RULE("block", "*ad*")) == []


def test_the_rarest_token_is_taken(spark):
    urls = pages(spark, ["x://a.org/en/"] * 5 + ["x://b.org/fr/"]).select(
        *(c.alias(n) for c, n in zip(url_rules.parts(F.col("url")), ("host", "path"), strict=True)))
    rows = url_rules.index(url_rules.rule_table(spark, [
        RULE("block", "org", "/en/"), RULE("block", "org", "/fr/"), RULE("block", "b.org"),
        RULE("block", "*x*")]), urls).collect()
    assert {(r.rule, r.token, r.n_urls) for r in rows} == {
        (0, "en", 5), (1, "fr", 1), (2, "b", 1), (3, "", 6)}


# Token alignment

PATHS = [queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = ["Hello world, naïve café!  Two blanks\n\nand lines\r\n\tend ", "", None, " ", "  ", "a",
         "</s><s>[INST] <|endoftext|> <0x41> <unk>", "▁ marks deviate", "日本語のテキスト 🙂🙃 e\u0301",
         "x\x00y", "Hello world, naïve café!  Two blanks\n\nand lines\r\n\tend ", "ﬁ ﬀ ½",
         "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "it's we'll 'tis 1234567890 --- *** ", "\n", "Ωμέγα ж"]


@pytest.fixture(scope="module")
def tools():
    return token_links.Tokenizers(*PATHS)


def expected(tools, texts):
    """By the library that A's file is made for."""
    from tokenizers import Tokenizer
    reader = Tokenizer.from_file(PATHS[0])
    reader.encode_special_tokens = True
    ids_a = [e.ids for e in reader.encode_batch([" " + (t or "") for t in texts],
                                                add_special_tokens=False)]
    _, ids_b = tools.encode([t or "" for t in texts])
    return brute.token_links(texts, tools.bytes_a, ids_a, tools.bytes_b, ids_b)


def linked(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").withColumn(
        "row", F.lit("x")).withColumn("pairs", F.lit(0))
    out = token_links.link(docs, *PATHS).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == list(range(len(texts)))
    return [tuple(r)[1:] for r in out]


def test_links_equal_all_pairs_of_ranges(spark, tools):
    assert linked(spark, TEXTS) == expected(tools, TEXTS)
    assert linked(spark, []) == []


def test_both_readers_of_a_vocabulary_agree_on_every_character(tools):
    from tokenizers import Tokenizer
    reader = Tokenizer.from_file(PATHS[0])
    texts = [" ".join(f"a{c}b {c}{c} 1{c}2 !{c}?  {c}s'{c}" for c in map(chr, range(k, k + 64)))
             for k in range(0, 0x30000, 64) if not 0xD800 <= k < 0xE000]
    ids, _ = tools.encode(texts)
    assert ids == [e.ids for e in reader.encode_batch([" " + t for t in texts],
                                                      add_special_tokens=False)]


def test_links_of_the_given_documents(spark, tools):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")
    docs = docs[docs.text.str.len() < 4000]
    frame = spark.createDataFrame(docs[["doc_id", "text"]])
    got = token_links.link(frame, *PATHS).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == expected(tools, docs.text.tolist())


def test_stretches_pieces_and_frequent_pairs_change_nothing(spark, tools, monkeypatch):
    draw = random.Random(3)
    words = "the quick brown-fox  jumps\nover the lazy dog's naïve 12,345 cafés ▁".split(" ")
    texts = TEXTS + [" ".join(draw.choices(words, k=n)) for n in (5, 50, 200, 300, 7)] + [
        "the good start " * 20 + "▁ then deviates " + "the end " * 20]
    want = expected(tools, texts)
    monkeypatch.setattr(token_links, "STRETCH", 40)
    monkeypatch.setattr(token_links, "SMALL", 50)
    monkeypatch.setattr(token_links.align, "__defaults__", (7,))
    assert linked(spark, texts) == want


def test_merge_path_gives_equal_pieces_and_keeps_equal_ends_together():
    rng = np.random.default_rng(1)
    for _ in range(300):
        size = rng.integers(1, 60)
        a, b = (np.append(np.flatnonzero(rng.random(size) < p) + 1, size + 1)
                for p in rng.random(2))
        step = int(rng.integers(1, 9))
        i, j = token_links.merge_path(a, b, step)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b))
        sizes = np.diff(i + j)
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and sizes.max() <= step + 1
        for x, y in zip(i[1:-1], j[1:-1], strict=True):  # all before a cut are smaller than all after
            assert max([*a[:x], *b[:y]]) < min([*a[x:], *b[y:], size + 2])
        whole, pieces = token_links.align(a, b, 10**6), token_links.align(a, b, step)
        assert all((p == q).all() for p, q in zip(whole, pieces, strict=True))


# Merkle manifest

def tampered():
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return F.when(hit, F.translate("text", queries.UPPER, queries.LOWER))


def proofs(spark, rows):
    docs = spark.createDataFrame(
        rows, "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING").withColumn(
        "leaf", F.lit("x")).withColumn("key", F.lit(1))
    return merkle.prove(merkle.build(merkle.leaves(docs, tampered()), Written(spark))).collect()


def rows_of(n, sources, seed=1):
    draw = random.Random(seed)
    return [(k * 7 - 50, draw.choice(sources), draw.choice(["en", None, ""]),
             draw.choice([None, 0, 12, -3]), draw.choice([None, "", "Ab ä", f"Text {k}", "lower"]))
            for k in range(n)]


@pytest.mark.parametrize("n, sources", [
    (1, ["a"]), (2, [None]), (16, ["a"]), (17, ["a"]), (300, [None, "", "a", "B", "ä", "ab"]),
    (600, [None, *map(str, range(40))])])
@pytest.mark.parametrize("depth", [3, 1])
def test_proofs_equal_plain_python(spark, monkeypatch, n, sources, depth):
    """With blocks of one level, every further level is a recursion."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** depth)
    monkeypatch.setattr(merkle, "_LEVELS", ["depth", *(f"level{k}" for k in range(depth))])
    monkeypatch.setattr(merkle, "PARTITION_ROWS", 100)
    rows = rows_of(n, sources)
    want = brute.merkle(rows)
    got = proofs(spark, rows)
    assert len(got) == n
    for r in got:
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == want[r.doc_id]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    assert proofs(spark, []) == []
    rows = [(5, "a", "en", 1, "Some Text")] * 40 + [(None, "a", "en", 1, "x")] * 3 + rows_of(30, ["a"])
    one, two = (sorted(map(tuple, proofs(spark, rows)), key=str) for _ in range(2))
    assert one == two and len(one) == 73 and len({r[4] for r in one}) == 1
    assert {r[7] for r in one if r[0] is None} == {True}


def test_any_change_is_found(spark):
    rows = rows_of(100, ["a", "b"], 4)
    root = proofs(spark, rows)[0].root
    for k, value in ((1, "c"), (2, "fr"), (3, 99), (4, "other")):
        changed = [*rows]
        changed[50] = tuple(value if i == k else v for i, v in enumerate(rows[50]))
        assert proofs(spark, changed)[0].root != root
    assert proofs(spark, rows[:-1])[0].root != root
