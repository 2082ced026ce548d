"""Near-duplicates, mixing, toxicity and rollups against plain Python; the pipeline."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from methylspark.llm import (components, embedding_dedup, minhash, mixing, quality, queries,
                             token_rollup, toxicity)
from methylspark.llm.tables import Written, shared_folder

SMALL = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)]
    links += [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(links, "a long, b long"), Written(spark)).collect()}
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert got == brute.components({i for x in real for i in x}, real)
    none = spark.createDataFrame([], "a long, b long")
    assert components.components(none, Written(spark)).count() == 0


def near_copies(rng, n):
    texts = {}
    for k in range(n):
        if k and rng.random() < 0.7:
            words = texts[rng.randrange(k)].split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 999)}"
            texts[k] = " ".join(words)
        else:
            texts[k] = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(20, 80)))
    return texts


@pytest.mark.parametrize("refine", [20_000, 10])
def test_minhash(spark, monkeypatch, refine):
    monkeypatch.setattr(minhash, "REFINE", refine)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    texts = near_copies(random.Random(7), 250)
    texts |= {300: None, 301: "", 302: " \n", 303: "Lone", 304: "lone\t", 305: "one two"}
    rows = [(k, t, 1) for k, t in texts.items()] + [(0, texts[0], 2), (None, texts[0], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bands int").repartition(3)
    out = minhash.near_duplicates(docs, width=2).collect()
    want = brute.near_duplicates(texts)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.n_shingles == len(brute.shingles(texts[r.doc_id]))
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = minhash.keep_one(docs, width=2).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = brute.near_duplicates(texts)
    got = {r.doc_id: r.component_id for r in queries.QUERIES["op9_minhash"](spark, SMALL).collect()}
    assert got == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 1400).astype(np.uint64)
    a, b = minhash.signature(pool[:1200]), minhash.signature(pool[200:])
    assert abs((a == b).mean() - 1000 / 1400) < 0.12


def vectors(rng, n):
    out = []
    for k in range(n):
        if k and rng.random() < 0.7:
            base = np.array(out[rng.integers(0, k)][1])
            v = base + rng.normal(size=16) * rng.choice([0, 0.05, 0.1])
        else:
            v = rng.normal(size=16)
        out.append((k, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 3))))
    return out


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = vectors(np.random.default_rng(3), 400)
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1),
           (904, rows[0][1], None), (905, [float("inf")] + [1.0] * 15, 1), (906, rows[0][1][:8], 1),
           (907, [None] + rows[0][1][1:], 1), (908, [1e-30] * 16, 77), (909, [1e30] * 16, 77)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd],
                               "vec_id long, embedding array<float>, label int, rep int")
    links, count = [], dict.fromkeys([r[0] for r in rows + odd], 0)
    for a in rows + odd[-2:]:
        for b in rows + odd[-2:]:
            if a[0] < b[0] and a[2] == b[2]:
                u, v = np.array(a[1]), np.array(b[1])
                if u @ v >= 0.93 * np.sqrt(u @ u) * np.sqrt(v @ v):
                    links.append((a[0], b[0]))
                    count[a[0]] += 1
                    count[b[0]] += 1
    want = brute.components(count, links)
    out = embedding_dedup.near_duplicates(df).collect()
    assert len(out) == len(count)
    found = sum(r.n_links for r in out)
    assert found >= 0.97 * 2 * len(links) and all(r.n_links <= count[r.vec_id] for r in out)
    assert sum(r.component_id != want[r.vec_id] for r in out) <= 4
    assert all(r.kept == (r.component_id == r.vec_id) for r in out)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_embeddings_of_a_large_tight_group(spark, share):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    copies = centre / np.linalg.norm(centre) + rng.normal(size=(int(6000 * share), 64)) * 0.0255
    rows = np.concatenate([copies, rng.normal(size=(6000 - len(copies), 64))]).astype(np.float32)
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(rows.tolist())],
                               "vec_id long, embedding array<float>, label int")
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    count = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    out = embedding_dedup.near_duplicates(df.repartition(4)).collect()
    assert all(r.n_links <= count[r.vec_id] for r in out)
    assert count.sum() > 0.9 * len(copies) ** 2
    assert sum(r.n_links for r in out) >= 0.999 * count.sum()
    assert sum(r.kept for r in out) == 1 + len(rows) - len(copies)


def test_targets():
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 0}
    got = mixing.targets(sizes, {"a": 1, "b": 2, "c": 3, "d": 1})
    assert got["a"] == 30 and got["d"] == 0 and sum(got.values()) == pytest.approx(2010)
    assert got["c"] / got["b"] == pytest.approx(1.5)


def test_flow_of_overlapping_sources():
    patterns = {("sa",): 100, ("sa", "sb"): 100, ("sb",): 10}
    used = mixing.flow(patterns, {"sa": 150, "sb": 200})
    by_source = {s: sum(n for (_, t), n in used.items() if t == s) for s in ("sa", "sb")}
    assert by_source == {"sa": 150, "sb": 200}
    for p, n in patterns.items():
        assert sum(k for (q, _), k in used.items() if q == p) <= 3 * n
    # nothing is used twice before all is used once
    assert min(sum(k for (q, _), k in used.items() if q == p) / n for p, n in patterns.items()) >= 1


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice(["a", "b", "c", None]), 1)
            for k in range(400)] + [(500, None, "a", 1), (501, "x y", "é", 2), (501, "x y", "é", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, take int")
    sources = F.array("source")
    mixed, told = mixing.mix(docs, sources)
    out = mixed.withColumn("source", F.get("pattern", F.lit(0))).join(told, "source").collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)
    order = ["sa", "sb", "sc", "sé", "~"]
    sizes = {s: sum(r.size for r in out if r.source == s) for s in order}
    want = mixing.targets(sizes, dict(zip(order, [1, 2, 3, 1, 2], strict=True)))
    for s in order:
        assert {r.target for r in out if r.source == s} == {want[s]}
        # off by no more than half of the largest document, for want of smaller ones
        assert abs(want[s] - sum(r.taken for r in out if r.source == s)) <= 0.5 + 40 / 2
    assert all(r.taken % r.size == 0 for r in out if r.size)  # documents are taken whole
    again, _ = mixing.mix(docs.repartition(5), sources)
    assert sorted(again.select("doc_id", "taken").collect()) == sorted(
        mixed.select("doc_id", "taken").collect())
    taken = mixing.take(docs, sources, mixed)
    assert taken.columns == docs.columns
    words = taken.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == sum(r.taken for r in out)
    assert {r.text for r in taken.collect()} <= {t for _, t, *_ in rows}
    assert mixing.take(docs.limit(0), sources, mixed.limit(0)).count() == 0
    empty, _ = mixing.mix(docs.limit(0), sources)
    assert empty.count() == 0


def test_rollup(spark):
    rollup = token_rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-test-{random.random()}")
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"

    def batch(*rows):
        return spark.createDataFrame(rows, schema)

    assert rollup.totals().count() == 0
    load = batch(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None),
                 ("insert", None, None, "v1", None, None), ("insert", "b", "en", "v1", 7, None),
                 ("unknown", "b", "en", "v1", 7, None))
    assert rollup.commit("load", load) and not rollup.commit("load", load)
    rollup.commit("edit", batch(("revise", "a", "en", "v1", 9, 10), ("delete", "b", "en", "v1", 7,
                                                                     None)))
    rollup.commit("none", batch())
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted(
        [("a", "en", "v1", 2, 14), (None, None, "v1", 1, 0)], key=str)


def test_rollup_query_revises(spark, monkeypatch):
    seen, commit = [], token_rollup.Rollup.commit

    def watched(self, name, changes):
        seen.append(changes.filter("op = 'revise' and n_tokens <> old_tokens").count())
        return commit(self, name, changes)

    monkeypatch.setattr(token_rollup.Rollup, "commit", watched)
    out = queries.QUERIES["op6_rollup"](spark, SMALL)
    assert sum(seen) > 50
    marks = {}
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        marks.setdefault(r.doc_id, []).append(r)
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        mine = marks.get(r.doc_id, [])
        if not any(m.quality == 0 for m in mine) and not any(m.toxic == 1 for m in mine):
            total = want.setdefault((r.source, r.lang), [0, 0])
            total[0] += 1
            total[1] += len(brute.WORD.findall(r.text or ""))
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in out.collect()
            if r.tokenizer == "words"} == want


def test_toxicity(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for k in range(1500):
        words = [rng.choice("alpha beta gamma delta stone river cloud".split()) for _ in range(60)]
        bad = k % 4 == 0
        for _ in range(4 if bad else 0):
            words[rng.randrange(60)] = rng.choice(["vorkle", "vorkling", "zeddish"])
        rows.append((k, " ".join(words), 1.0))
        if k % 3:
            marks.append((k, int(bad)))
    rows += [(9000, None, 1.0), (9001, "", 1.0), (9001, "", 1.0), (None, "vorkle", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame(marks + [(5, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by_id = {r.doc_id: r for r in out}
    right = [by_id[k].predicted == (k % 4 == 0) for k in range(1500) if by_id[k].held_out]
    assert np.mean(right) > 0.98 and 200 < len(right) < 400
    assert by_id[9001].predicted == 0 == by_id[9000].predicted
    bare = toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()
    assert [r.score for r in bare] == [0.0] * 3


def test_toxicity_counts_every_gram(spark):
    rng = random.Random(9)
    letters = [chr(c) for c in range(33, 127) if not chr(c).isupper()]
    texts = [" ".join("".join(rng.choices(letters, k=5)) for _ in range(2000)) for _ in range(4)]
    want = {}
    for k, text in enumerate(texts):
        for word in text.split():
            framed = f"    {word} ".encode()
            for i in range(len(framed) - 4):
                code = int.from_bytes(framed[i:i + 5], "big")
                want.setdefault(code, [0, 0])[k % 2] += 1
    rows = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts)], "text string, toxic int")
    got = {r[0]: list(r[1:]) for r in toxicity.count_grams(rows).collect()}
    assert got == want


def brute_kneser_ney(counts):
    """gram -> difference of log-probabilities, for gram -> (ordinary, toxic)."""
    def smooth(table, gram, backoff):
        total = sum(v for g, v in table.items() if g[:-1] == gram[:-1])
        kinds = sum(g[:-1] == gram[:-1] and v > 0 for g, v in table.items())
        if not total:
            return backoff
        return (max(table.get(gram, 0) - 0.75, 0) + min(0.75 * kinds, total) * backoff) / total

    tables = {5: {g: sum(v) for g, v in counts.items() if sum(v)}}
    for n in (4, 3, 2, 1):
        tables[n] = {}
        for g in tables[n + 1]:  # one for each different byte before
            tables[n][g[1:]] = tables[n].get(g[1:], 0) + 1
    out = {}
    for gram in counts:
        p = 1 / 256
        for n in (1, 2, 3, 4, 5):
            p = smooth(tables[n], gram[-n:], p)
        own = [smooth({g: v[c] for g, v in counts.items()}, gram, p) for c in (0, 1)]
        out[gram] = np.log(own[1]) - np.log(own[0])
    return out


def test_toxicity_is_kneser_ney(spark):
    # "san francisco": its last word is frequent after one history only
    texts = [("san francisco " * 9 + "sea cosy", 0), ("vex vexed hex seas franc", 1),
             ("unseen word vexes Sand", None)]
    counts = {}
    for text, toxic in texts:
        for word in text.lower().split():
            framed = f"    {word} ".encode()
            for i in range(len(framed) - 4):
                count = counts.setdefault(framed[i:i + 5], [0, 0])
                if toxic is not None:
                    count[toxic] += 1
    want = brute_kneser_ney(counts)
    counted = toxicity.count_grams(spark.createDataFrame(texts, "text string, toxic int"))
    got = {r.gram.to_bytes(5, "big"): r.evidence / toxicity.UNIT
           for r in toxicity.evidence(counted, Written(spark)).collect()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], abs=1e-6) for g in want)


def test_toxicity_beyond_a_broadcast(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(k, " ".join(rng.choice(["alpha", "Beta", "é", "vorkle" if k % 4 == 0 else "river"])
                         for _ in range(k % 30))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, rows[7][1]), (902, "x"), (None, "vorkle")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(250)],
                                   "doc_id long, toxic int")
    small = sorted(toxicity.toxicity(docs, labels).collect(), key=str)
    monkeypatch.setattr(toxicity, "SMALL", 0)
    large = sorted(toxicity.toxicity(docs, labels).collect(), key=str)
    assert len(small) == len(rows) and len({r.score for r in small}) > 50
    assert [r[:2] + r[3:] for r in small] == [r[:2] + r[3:] for r in large]
    assert [r.score for r in small] == pytest.approx([r.score for r in large], abs=1e-12)


def test_toxicity_in_slices_moves_no_text(spark, monkeypatch):
    """With more n-grams and labels than one slice holds, scores are the same and no words are rows."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(300)]
    rows = [(2**60 + 999 * k, " ".join(rng.choice(words + ["vorkle"] * 90 * (k % 4 == 0)) for _ in range(k % 40)))
            for k in range(400)]
    rows += [(2**60 + 1, None), (2**60 + 2, ""), (2**60 + 3, "x"), (None, "vorkle")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(2**60 + 999 * k, int(k % 4 == 0)) for k in range(350)] + [(None, 1)],
                                   "doc_id long, toxic int")
    want = sorted(toxicity.toxicity(docs, labels).collect(), key=str)
    monkeypatch.setattr(toxicity, "SMALL", 70)
    monkeypatch.setattr(toxicity, "STRETCH", 500)
    made, whole = [], toxicity.Sliced
    monkeypatch.setattr(toxicity, "Sliced", lambda *a: made.append(whole(*a)) or made[-1])
    monkeypatch.setattr(toxicity, "_joined", None)
    monkeypatch.setattr(toxicity, "maybe_small", lambda df: df)
    got = toxicity.toxicity(docs, labels)
    assert sorted(got.collect(), key=str) == want and len({r.score for r in want}) > 50
    sizes = [[len(s.value[0]) for s in m.slices] for m in made]
    assert len(sizes) == 2 and all(len(x) >= 4 and max(x) <= 80 for x in sizes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "minhash_near_dedup", "secret_scan", "mixture", "sentencepiece"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, SMALL)
    keep = Written(spark)
    measured = keep(quality.measures(docs))
    kept = keep(quality.judge(measured, quality.references(measured))).filter("kept")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in kept.collect()}
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    assert out.columns[:4] == ["doc_id", "source", "lang", "n_tokens"] and len(rows) > 50
    assert all(r.text_sha256 == r.decoded_sha256 for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in kept.collect()}
    empty = corpus_pipeline.tokenize(spark, docs.limit(0), SMALL)
    assert empty.count() == 0
