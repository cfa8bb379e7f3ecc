import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.llm import embeddings, html, language, near_duplicates, quality, queries, shingles, toxicity
from tessella.llm.boosting import Boosted

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, rep int"


def docs(spark, texts, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "s", len(t or ""), 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# Near-duplicates


def brute_components(texts, width, percent=80):
    sets = []
    for t in texts:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    part = list(range(len(texts)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                part[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)] + ["É", "ñandú", "日本"]
    texts = []
    for _ in range(18):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, max(1, len(base) // 25), len(base) // 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([str, str.upper])(" ".join(copy)).replace(" ", rng.choice([" ", "  ", "\n", " \t"])))
    return texts + ["", None, "  \n", "one", "ONE", "one two", "x " * 6000, "x " * 7000, "é" * 40, texts[0], texts[0]]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    texts = corpus(width)
    got = near_duplicates.near_duplicates(docs(spark, texts), width=width).orderBy("doc_id").collect()
    sizes, parts = brute_components(texts, width)
    assert [r["n_shingles"] for r in got] == sizes
    assert [r["component_id"] for r in got] == parts
    assert [r["kept"] for r in got] == [i == p for i, p in enumerate(parts)]


def test_large_group_of_near_copies_and_broadcast_limits(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if rng.random() > 0.015 else f"y{rng.random()}" for w in base) for _ in range(120)] + [" ".join(rng.sample(base, 150)) for _ in range(20)]
    got = near_duplicates.near_duplicates(docs(spark, texts), id_limit=0).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == brute_components(texts, 5)[1]


def test_near_duplicates_of_nothing_nulls_and_repeats(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", "q", "a b c d e f"], ids=[4, 4, None, 9])
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_duplicates.near_duplicates(df).collect())
    assert got == [("4", 2, "4", True), ("4", 2, "4", True), ("9", 2, "4", False), ("None", 1, "None", False)]
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_shingles_do_not_depend_on_neighbours():
    texts = ["a b c d e", "b c d e", " b c d e\t", "A B C D E", "ab c d e", None, "e"]
    together = list(shingles.shingle_sets(pa.array(texts), 4))
    apart = [next(shingles.shingle_sets(pa.array([t], pa.string()), 4)) for t in texts]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(together, apart, strict=True))
    assert (together[1] == together[2]).all() and (together[0] == together[3]).all() and set(together[1]) < set(together[0])
    assert len({len(s) for s in together[4:6]}) == 2 and not set(together[4]) & set(together[0])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    circulant, errors = near_duplicates.Circulant(), []
    for _ in range(60):
        shared, own = rng.integers(1, 1 << 63, 160, dtype=np.uint64), rng.integers(1, 1 << 63, 40, dtype=np.uint64)
        a, b = np.concatenate([shared, own[:20]]), np.concatenate([shared, own[20:]])
        errors.append((circulant(a) == circulant(b)).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and min(errors) > -0.175


# Embeddings


def vectors(rng, n=260, dims=16):
    rows = []
    for i in range(n):
        v = rng.normal(size=dims)
        rows.append((len(rows), (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(i % 3)))
        for _ in range(int(rng.integers(0, 3)) if i % 5 == 0 else 0):
            w = v / np.linalg.norm(v) + rng.normal(size=dims) * rng.choice([0.0, 0.02, 0.06, 0.1])
            rows.append((len(rows), (w * rng.uniform(0.5, 2)).astype(np.float32).tolist(), int(i % 3)))
    hub = rng.normal(size=dims)
    for _ in range(90):
        rows.append((len(rows), (hub + rng.normal(size=dims) * 0.08).astype(np.float32).tolist(), 1))
    return rows


def brute_links(rows):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and k is not None for _, v, k in rows]
    links = {i: set() for i in range(len(rows))}
    for i, (_, v, k) in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and rows[j][2] == k and len(rows[j][1]) == len(v):
                a, b = np.array(v, float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    part = {}
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        part[i] = min(rows[j][0] for j in seen)
    return [len(links[i]) for i in range(len(rows))], [part[i] for i in range(len(rows))]


def test_embeddings_equal_brute_force(spark):
    rows = vectors(np.random.default_rng(2))
    same = rows[3][1]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, same, same, same[:8], same]
    rows += [(len(rows) + i, v, None if i == 9 else rows[3][2]) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, nid string, part int")
    got = embeddings.near_duplicates(df).orderBy("vec_id").collect()
    n, parts = brute_links(rows)
    assert [r["n_links"] for r in got] == n and [r["component_id"] for r in got] == parts
    assert [r["kept"] for r in got] == [i == p for i, p in enumerate(parts)]


def test_toxicity_keeps_all_associated_terms(spark):
    bad = [f"z{i:03d}q" for i in range(600)]
    texts = [f"{w} plain text" for w in bad for _ in range(30)] + [f"plain text {i % 50}" for i in range(18000)]
    labels = spark.createDataFrame([(i, int(i < 18000)) for i in range(36000)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts).repartition(4), labels, per_class=18000)
    assert set(bad) <= set(model.vocabulary.kept)
    assert all(model.score(f"{w} plain text")[0] > 0.5 for w in bad)


def near(rng, x, cosine):
    """A unit vector at this cosine from the unit vector x."""
    y = rng.standard_normal(len(x))
    y -= (y @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def unit(rng, width):
    x = rng.standard_normal(width)
    return x / np.linalg.norm(x)


def packed(spark, xs):
    return spark.createDataFrame([(i, 1, bytearray(np.asarray(x, np.float32).tobytes())) for i, x in enumerate(xs)], "nid long, part long, vec binary")


def test_audit_draws_anew_and_counts_nodes(spark):
    rng = np.random.default_rng(3)
    middle = unit(rng, 64)
    group, firsts = [near(rng, middle, 0.999) for _ in range(300)], [unit(rng, 64) for _ in range(40)]
    xs = group + [x for f in firsts for x in (f, near(rng, f, 0.95))]
    nodes = packed(spark, xs)
    parts = spark.createDataFrame([(i, 0) for i in range(300)], "id long, component long")
    recall, missed = embeddings._audit(nodes, parts, len(xs), 0, 6, 0.93)
    assert recall == 0 and {frozenset(r) for r in missed.collect()} == {frozenset((300 + 2 * i, 301 + 2 * i)) for i in range(40)}
    placed = nodes.selectExpr("nid", "part", "nid as component", "vec")
    drawn = [{r["src"] for r in embeddings._audited(placed, 50, salt, 0.93).collect()} for salt in (3, 4)]
    assert all(len(d) == 50 for d in drawn) and len(drawn[0] & drawn[1]) < 25


def test_pairs_beside_a_large_group_are_found(spark):
    rng = np.random.default_rng(4)
    middle = unit(rng, 64)
    xs = [near(rng, middle, 0.999) for _ in range(600)]
    for _ in range(300):
        xs.append(unit(rng, 64))
        xs.append(near(rng, xs[-1], 0.935))
    df = spark.createDataFrame([(i, [float(v) for v in x], 1) for i, x in enumerate(xs)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(df, trees=1, rounds=1).collect()}
    assert got == {i: 0 if i < 600 else i - i % 2 for i in range(len(xs))}


def test_forest_keeps_pairs_as_it_deepens(spark):
    rng = np.random.default_rng(5)
    middle, xs = unit(rng, 64), []
    for _ in range(1500):  # at two depths, and in a crowded direction that random chunks would part
        xs.append(near(rng, middle, 0.6) if len(xs) < 1500 else unit(rng, 64))
        xs.append(near(rng, xs[-1], 0.935))
    codes = embeddings._codes(packed(spark, xs), 0, 8, 4, 0.93)
    salted = embeddings._salted(codes, embeddings.CHUNK).select("k1", "k2", "nid").distinct()
    pair = F.floor(F.col("nid") / 2).alias("pair")
    met = salted.groupBy("k1", "k2", pair).agg(F.countDistinct("nid").alias("n")).where("n = 2").select("pair").distinct().count()
    assert met >= 0.99 * 1500


def test_lists_full_of_links_are_longer(spark):
    found = spark.createDataFrame([(0, d, 0.99 - d / 1000, False) for d in range(1, 21)] + [(100, 100 + d, 0.5, False) for d in range(1, 21)], embeddings.FOUND)
    sizes = {r["src"]: len(r["list"]) for r in embeddings._lists(found, 6, 12, 0.93).collect()}
    assert sizes[0] == 12 and sizes[100] == 6


def test_doubles_are_compared_as_doubles(spark):
    rng = np.random.default_rng(6)
    x = unit(rng, 8)
    rows = [(0, (x * 1e39).tolist(), 1), (1, (x * 1e-200).tolist(), 1), (2, (near(rng, x, 0.95) * 1e300).tolist(), 1), (3, (-x).tolist(), 1)]
    # cosines that single precision can't tell from the threshold
    a, b = np.zeros(8), np.zeros(8)
    a[0] = 1
    for i, c in ((4, 0.93 + 1e-12), (5, 0.93 - 1e-12)):
        b[0], b[1] = c, np.sqrt(1 - c * c)
        rows += [(i * 10, a.tolist(), i), (i * 10 + 1, b.tolist(), i)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 40: (1, 40), 41: (1, 40), 50: (0, 50), 51: (0, 51)}


def test_low_recall_ends_in_an_exact_comparison(spark, monkeypatch):
    rows = vectors(np.random.default_rng(8), n=200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "TRIES", 1)
    # no attempt finds a thing: no tree's chunks, no audit's links
    monkeypatch.setattr(embeddings, "_compared", lambda rows, keep, threshold: spark.createDataFrame([], embeddings.FOUND))
    monkeypatch.setattr(embeddings, "_audit", lambda *_: (0.0, spark.createDataFrame([], "src long, dst long")))
    monkeypatch.setattr(embeddings._exact, "__defaults__", (16,))
    with pytest.warns(UserWarning, match="recall"):
        got = embeddings.near_duplicates(df).orderBy("vec_id").collect()
    n, parts = brute_links(rows)
    assert [r["n_links"] for r in got] == n and [r["component_id"] for r in got] == parts


def test_no_embeddings(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).count() == 0


# Language


def test_language_on_held_out_documents(spark):
    out = queries.op10_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == 200 and (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.9 and out.score.between(0, 1).all()


def test_every_language_with_letters_has_a_dictionary(spark):
    small = [(f"mot{k} numero {i}", f"l{k}") for k in range(8) for i in range(3)]
    copies = [(f"mot{k} encore", f"l{k}") for k in range(8) for _ in range(20_000)] + [(f"{i}", "l0") for i in range(9000)]
    known = spark.createDataFrame(small + copies, "text string, lang string").repartition(3)
    assert sorted(name for name, _ in language.train_dictionaries(known)) == [f"l{k}" for k in range(8)]


def test_language_of_odd_texts(spark):
    known = docs(spark, ["the and of with thing water house " * 20, "der die und mit wasser haus nicht " * 20, None, "ignored"], ["en", "de", "en", None])
    dictionaries = language.train_dictionaries(known)
    assert {n for n, _ in dictionaries} == {"en", "de"}
    texts = [None, "", "123 !?", "THE WATER AND THE HOUSE WITH THING", "das wasser und nicht die haus mit " * 500, "the water of the house and thing " * 3]
    got = language.identify(docs(spark, texts).select("doc_id", "text"), dictionaries).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "de", "en"]
    assert [r["rejected"] for r in got] == [True] * 3 + [False] * 3 and [r["score"] for r in got][:3] == [0, 0, 0]
    kept = language.keep_identified(docs(spark, texts), dictionaries)
    assert kept.columns == docs(spark, texts).columns and sorted(r["text"] for r in kept.collect()) == sorted(texts[3:])
    assert language.identify(docs(spark, ["words"]).select("text"), []).first()["lang_pred"] == "und"
    assert language.identify(docs(spark, texts).limit(0).select("text"), dictionaries).count() == 0


def test_language_equals_brute_force_by_the_compressor(spark):
    """Sizes anew with the zstandard library, text by text, from the same dictionaries."""
    import re

    import zstandard

    sf = SMALL.replace("0.001", "0.01")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    dictionaries = language.train_dictionaries(df.where(queries.fold(3) != 1))
    options = {"min_match": 3, "strategy": zstandard.STRATEGY_GREEDY, "window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 4, "target_length": 32, "write_content_size": 0, "write_dict_id": 0}
    how = zstandard.ZstdCompressionParameters(**options)
    coders = [(n, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)) for n, d in dictionaries]
    runs = re.compile(r"[^\W\d_]+")
    want = {}
    for r in df.select("doc_id", "text").collect():
        data = " ".join(runs.findall((r["text"] or "").lower())).encode()
        sizes = [(sum(len(c.compress(data[i : i + language.BLOCK])) for i in range(0, len(data), language.BLOCK)), k, n) for k, (n, c) in enumerate(coders)]
        want[r["doc_id"]] = min(sizes)[2] if data else "und"
    got = {r["doc_id"]: r["lang_pred"] for r in queries.op10_language_id(spark, sf).collect()}
    assert got.keys() == want.keys() and sum(got[i] != want[i] for i in want) == 0


def test_language_of_clashing_columns_repeats_and_ties(spark):
    texts = ["the water and the house", "the water and the house", "la maison et le jardin", None]
    rows = [(i % 2, t, 5, "x", True, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rejected int, lang_pred string, score boolean, __text string")
    dictionaries = [("en", b"the and of water house " * 9), ("fr", b"la le et maison jardin " * 9)]
    kept = language.keep_identified(df, dictionaries)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[:3], key=str)
    out = language.identify(df.select("doc_id", "text", "score"), dictionaries)
    assert out.columns == ["doc_id", "lang_pred", "score", "rejected"] and sorted(r["lang_pred"] for r in out.collect()) == ["en", "en", "fr", "und"]
    same = [("b", dictionaries[0][1]), ("a", dictionaries[0][1])]
    tie = language.identify(df.select("text").limit(1), same).first()
    assert tie["lang_pred"] == "b" and tie["rejected"]  # of equal sizes the first listed, that of more documents, and a narrow margin


# Toxicity


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(4)
    vectors_ = []
    for _ in range(500):
        terms = rng.choice(40, rng.integers(1, 6), replace=False)
        w = rng.uniform(0.2, 1, len(terms))
        vectors_.append(dict(zip(terms.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True)))
    index = toxicity.Index(vectors_, [(1.0, 0.0)] * 500, list(range(500)), 40)
    dense = np.zeros((500, 40))
    for i, v in enumerate(vectors_):
        for t, w in v.items():
            dense[i, t] = w
    for v in vectors_[::25]:
        q = np.zeros(40)
        q[list(v)] = list(v.values())
        want = np.sort(dense @ q)[::-1][: toxicity.NEAREST]
        places, cosines = index.nearest(v, toxicity.NEAREST)
        assert np.allclose(np.sort(cosines)[::-1], want[want > 0], atol=1e-5)
        assert np.allclose([dense[index.names[p]] @ q for p in places], cosines, atol=1e-5)


def test_toxicity_index_takes_room_by_its_postings():
    """Neither building it nor sending it takes a dense matrix or what follows from the postings."""
    import pickle
    import tracemalloc

    rng, n, m = np.random.default_rng(6), 3000, 12
    pairs = [(np.sort(rng.choice(4096, m, replace=False)), rng.uniform(0.1, 1, m)) for _ in range(n)]
    pairs = [(t, w / np.linalg.norm(w)) for t, w in pairs]
    tracemalloc.start()
    index = toxicity.Index(pairs, [(1.0, 0.0)] * n, list(range(n)), 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * n * m
    data = pickle.dumps(index)
    assert len(data) < 20 * n * m
    sent = pickle.loads(data)
    for t, w in pairs[::100]:
        here, there = index.search(t, w, toxicity.NEAREST), sent.search(t, w, toxicity.NEAREST)
        assert here[0].tolist() == there[0].tolist() and here[1].tolist() == there[1].tolist() and here[1][0] == pytest.approx(1)


def test_toxicity_trains_in_little_room_of_the_driver(spark):
    import tracemalloc

    texts = [" ".join(f"w{i * 400 + j}" for j in range(400)) + (" nasty" if i % 2 else " nice") for i in range(400)]
    df, labels = docs(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    tracemalloc.start()
    model = toxicity.train(df, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak
    assert len(model.vocabulary.kept) == 400 * 400 + 2 and model.vocabulary.kept[:2] == ["nasty", "nice"]
    assert model.score("nasty")[0] > 0.5 > model.score("nice")[0]


def labelled(spark, bad, column, n=240):
    rng = random.Random(9)
    vocabulary = ["river", "stone", "cloud", "bread", "window", "garden", "letter", "music"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        y = int(rng.random() < 0.3)
        texts.append(bad(words, rng) if y else " ".join(words).capitalize() + ".")
        labels.append((i, 1 - y if column == "quality" else y, "extra"))
    return docs(spark, texts), spark.createDataFrame(labels, f"doc_id long, {column} int, text string")


def test_toxicity_learns_words_and_explains(spark):
    def bad(words, rng):
        words[rng.randrange(len(words))] = rng.choice(["nastyfool", "vileworm"])
        return " ".join(words)

    df, labels = labelled(spark, bad, "toxic")
    model = toxicity.train(df, labels.where("doc_id < 200"))
    probe = docs(spark, ["river stone", None, "", "a vileworm of bread", "NASTYFOOL " * 3000, "quiet garden music letter"])
    got = toxicity.score(probe.select("doc_id", "text"), model).orderBy("doc_id").collect()
    assert [r["score"] >= 0.5 for r in got] == [False, False, False, True, True, False] and all(0 <= r["score"] <= 1 for r in got)
    assert len(got[3]["evidence"]) > 0 and got[1]["evidence"] == []
    held = toxicity.score(df.where("doc_id >= 200").select("doc_id", "text"), model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in held)
    nobody = toxicity.train(df, labels.limit(0))
    assert {r["score"] for r in toxicity.score(probe.select("text"), nobody).collect()} == {0.0}
    assert toxicity.score(probe.limit(0).select("text"), model).count() == 0


def test_toxicity_equals_brute_force_over_texts(spark):
    """Weights, cosines, neighbours and shares anew from the texts, by plain loops and a dense product."""
    import re
    from collections import Counter

    sf = SMALL.replace("0.001", "0.01")
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where(queries.fold(5) != 0)
    model = toxicity.train(df, labels)
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    label = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and texts.get(r["doc_id"]) is not None}
    words = lambda t: Counter(w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w)
    counts = {i: words(t) for i, t in texts.items()}
    vocabulary = sorted({w for i in label for w in counts[i]})
    at, n = {w: k for k, w in enumerate(vocabulary)}, len(label)
    df_, a, b = (np.zeros(len(vocabulary)) for _ in range(3))
    for i, c in counts.items():
        known = [at[w] for w in c if w in at]
        df_[known] += 1
        if i in label:
            (a if label[i] else b)[known] += 1
    n1 = sum(label.values())
    n0 = n - n1
    phi = np.abs(a * n0 - b * n1) / np.sqrt((a + b) * np.maximum(n - a - b, 1) * n0 * n1)
    weight = (np.log((1 + len(texts)) / (1 + df_)) + 1) * (toxicity.FLOOR + phi)

    def vector(c):
        x = np.zeros(len(vocabulary))
        for w, k in c.items():
            if w in at:
                x[at[w]] = (1 + np.log(k)) * weight[at[w]]
        return x / max(np.linalg.norm(x), 1e-300)

    examples = sorted(i for i in label if counts[i])
    matrix, ys = np.stack([vector(counts[i]) for i in examples]), np.array([label[i] for i in examples])
    got = {r["doc_id"]: r for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    assert len(got) == len(texts)
    scores = {1: 1.0, 0: 1.0}  # all labels are in the sample
    for i, c in counts.items():
        cosines = matrix @ vector(c)
        if not (cosines > 0).any():
            assert got[i]["evidence"] == [] and got[i]["score"] == pytest.approx(n1 / n)
            continue
        assert got[i]["evidence"]
        # equal example texts are one entry with all their votes
        entries = {}
        for j, e in enumerate(examples):
            key = tuple(sorted(counts[e].items()))
            entry = entries.setdefault(key, [cosines[j], 0.0, 0.0])
            entry[2 - ys[j]] += scores[int(ys[j])]
        ranked = sorted(entries.values(), key=lambda e: -e[0])
        ranked = [e for e in ranked if e[0] > 0]
        top, rest = ranked[: toxicity.NEAREST], ranked[toxicity.NEAREST :]
        if rest and top[-1][0] - rest[0][0] < 1e-9:
            continue  # a tie at the end
        for_, against = (sum(min(e[0], 1) ** toxicity.POWER * e[k] for e in top) for k in (1, 2))
        shrink = toxicity.PRIOR * min(e[1] + e[2] for e in entries.values()) * top[0][0] ** toxicity.POWER
        share = (for_ + shrink * n1 / n) / (for_ + against + shrink)
        want = 1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * np.log(share / (1 - share)), -30, 30)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6)


def test_toxicity_of_clashing_columns_repeats_ties_and_long_texts(spark):
    texts = ["bad word here", "bad word here", "good word here", "good word there", None, "", "one two"]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 0), (6, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts), labels)
    rows = [(i, t, 5, "e", 1) for i, t in enumerate([*texts, "good word here " * 200_000, "zz", "bad word here"])]
    probe = spark.createDataFrame(rows, "doc_id long, text string, score int, evidence string, label int")
    out = toxicity.score(probe, model)
    assert out.columns == ["doc_id", "label", "score", "evidence"]
    got = out.orderBy("doc_id").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["label"] == 1 for r in got)
    assert got[0]["score"] == got[1]["score"] == got[9]["score"] and got[4]["score"] == got[5]["score"] == got[8]["score"]
    assert [bool(r["evidence"]) for r in got] == [True] * 4 + [False] * 2 + [True] * 2 + [False, True]


# Quality


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    field = quality.Field([np.array([0.5])] * len(quality.NAMES))
    field.moves = rng.normal(size=(2, 2))
    documents = [rng.normal(size=n) for n in (1, 4, 6)]
    for scores, got in zip(documents, field.marginals(documents), strict=True):
        weights = {s: np.exp(sum(x for x, y in zip(scores, s, strict=True) if y) + sum(field.moves[a, b] for a, b in zip(s, s[1:], strict=False))) for s in product((0, 1), repeat=len(scores))}
        want = [sum(w for s, w in weights.items() if s[t]) / sum(weights.values()) for t in range(len(scores))]
        assert np.allclose(got, want)


def test_quality_learns_lines(spark):
    df, labels = labelled(spark, lambda words, rng: "\n".join(f"{w.upper()}!! {w}$$$ {w}$$$" for w in words), "quality")
    field = quality.train(df, labels.where("doc_id < 200"))
    held = quality.score(df.where("doc_id >= 200").select("doc_id", "text"), field).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all((r["score"] >= 0.3) == bool(r["quality"]) for r in held)
    probe = docs(spark, [None, "", " \n\n", "Bread and stone by the river.", "GARDEN!! x$$$ x$$$\n" * 3000]).select("doc_id", "text")
    got = [r["score"] for r in quality.score(probe, field).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[2] and got[3] > 0.9 and got[4] < 0.1
    assert quality.train(df, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(probe, None).collect()} == {1.0}
    assert quality.score(probe.limit(0), field).count() == 0


@pytest.mark.parametrize(("name", "column", "least"), [("op5_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.9)])
def test_classifiers_on_labelled_documents(spark, name, column, least):
    out = queries.QUERIES[name](spark, SMALL.replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet").select("doc_id", F.col(column).alias("y"))
    rows = out.join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.y).mean() >= least and rows.score.between(0, 1).all()


# HTML


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    found = Boosted(trees=40).fit(x[:1500], y[:1500]).margin(x[1500:]) > 0
    assert (found == y[1500:]).mean() > 0.95


def test_generated_pages():
    trees, wrong, blocks = html.train(), 0, 0
    for page in html.sample_pages(80, seed=77):
        texts = [t for t in html.Page(page).text if t]
        got = html.main_texts([page], trees)[0].split("\n")
        wrong += sum(("mainword" in t) != (t in got) for t in texts)
        blocks += len(texts)
    assert wrong <= 0.01 * blocks


def test_extraction_of_real_pages(spark):
    import re
    from html import unescape

    rows = pq.read_table(f"{SMALL}/pages.parquet").to_pylist()
    got = {r["page_id"]: r["text"] for r in queries.op3_html_extract(spark, SMALL).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)[^>]*>", inner)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_markup_details():
    text = lambda page: [t for t in html.Page(page).text if t]
    assert text("<p>a &amp; b&nbsp;&#233;<br>c<p>d <b>e</b>f") == ["a & b é c", "d ef"]
    assert text("x<script>var t='</p>';</script><style>p{}</style>y<!-- z -->") == ["xy"]
    assert text("<ul><li>one<li>two</ul><table><tr><td>1<td>2</table>") == ["one", "two", "1", "2"]
    assert text("<div>a<div>b</div>c</div></p></section>d <1 e") == ["a", "b", "c", "d <1 e"]
    assert text("<p title='a>b'>q</p><TEXTAREA>no</TEXTAREA>") == ["q"]
    assert html.main_texts([None, ""], html.train()) == ["", ""]
    deep = "<div>" * 5000 + "<p>deep" + "</div>" * 5000
    assert text(deep) == ["deep"]


@pytest.mark.parametrize("unit", ["<a '", "<a ", "<svg>", "<div>", "<a<", "<!", "</div ", "<p><section>", "<div><li></li>", "<b '\"", "<td><p>x", "<p class=' "])
def test_long_odd_pages_take_linear_time(unit):
    import time

    trees, took = html.train(), []
    for size in (250_000, 1_000_000):
        began = time.process_time()
        html.main_texts([unit * (size // len(unit))], trees)
        took.append(time.process_time() - began)
    assert took[1] < 8 and took[1] < 8 * max(took[0], 0.2)


def test_tags_equal_a_pattern():
    """The forward pass against one backtracking pattern, on soups of pieces."""
    import re

    pattern = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z](?>[^\s/>]*))((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    rng = random.Random(4)
    pieces = ["<p>", "</p>", "<div class='a b'>", "<a href=\"u>v\">", "<!-- c -->", "<!--", "<!x>", "<![CDATA[", "]]>", "<?", "text", " ", "<", "< 1", "<b", "'", '"', ">", "/", "=", "</", "<é>", "\n"]
    for _ in range(3000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        tags, at, got = html.Tags(page), 0, []
        while True:
            start, end, closes, name, _ = tags.next(at)
            if start == len(page):
                break
            got.append((start, end, closes, name))
            at = end
        assert got == [(m.start(), m.end(), bool(m[1]), (m[2] or "").lower()) for m in pattern.finditer(page)]


def test_pages_with_clashing_columns_repeats_and_long_ones(spark):
    page = "<html><body><nav><a href='/'>menu</a></nav><article>" + "<p>Main words of the text go on, and on.</p>" * 30_000 + "</article></body></html>"
    rows = [(1, page, "t", "u"), (1, page, "t", "u"), (None, "<p>x" + "&#" + "1" * 5000 + ";</p>", None, None), (3, None, "t", "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, url string")
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "text"]
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[1] == "\n".join(["Main words of the text go on, and on."] * 30_000) and got[3] == "" and out.count() == 4


def test_no_pages(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_keeps_parents():
    page = html.Page("<div><nav><p>a</p></nav><article><p>b</p><p>c</p></article></div>")
    tags = dict(zip(page.tag, range(len(page.tag)), strict=True))
    margin = np.full(len(page.tag), 1.0)
    margin[tags["nav"]] = -9.0
    assert page.main_text(margin) == "b\nc"
