"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and clashing extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import bpe_codec, common, embedding_dedup, exact_dedup, jaccard_join, language_model, license_scan, packing, quality, quotation, substring_dedup
from eventloom.llm.queries import TOKENIZERS

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "doc_id long, text string, id long, row long, key string, n int, sid int, label int, score double"


def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = say(120), say(60)
    near = base.split()
    near[40] = "CHANGED"
    far = base.split()
    for k in range(0, 120, 6):
        far[k] = f"x{k}"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "one  two"), (10, "ONE two"),
        (11, say(30) + " " + passage + " " + say(30)), (12, passage + "\n" + say(50)), (13, say(3000)), (14, "Released under the MIT License. " + say(9)),
        (15, "Apache License, Version 2.0 x CC-BY-NC"), (16, "under the mit license under the mit license"), (17, say(40) * 3), (18, "a b c"), (None, base), (19, "<|endoftext|> x"),
        (20, "İstanbul Σας 'LL don't 12"), (21, base), (21, base), (22, "x" * 5000), (23, say(34)), (24, say(36)), (25, base.replace(" ", "\n", 3)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, 7, "k", 7, 7, 7, 7.0) for i, t in texts()]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def words(t, fold=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW) if fold else t or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


# ------------------------------------------------------------------- kernels


def test_words_and_windows_match_regular_expressions():
    column = pa.array([t for _, t in texts()])
    w = common.Words(column, common.SAME)
    for k, (_, t) in enumerate(texts()):
        a, b = w.rows[k], w.rows[k + 1]
        assert [w.raw[x:y].tobytes().decode() for x, y in zip(w.start[a:b], w.stop[a:b])] == words(t, False)
    by_hash = defaultdict(set)
    flat = [x for _, t in texts() for x in words(t, False)]
    for h, x in zip(w.hash.tolist(), flat):
        by_hash[h].add(x)
    assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len(set(flat))
    assert sum(len(p) for p in common.slices(pa.record_batch({"text": column}), "text", 100)) == len(texts())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 300), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert all(got[k] == 1 for k in range(1, 61)) and got[300] == 100


def test_forest_connects_what_edges_do():
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 50, 30), rng.integers(0, 50, 30)
    node, root = common.forest(i, j, 50)
    assert union(50, zip(node.tolist(), root.tolist())) == union(50, zip(i.tolist(), j.tolist()))


# ------------------------------------------------------------------- 1


def jaccard_brute(pairs):
    sets = []
    for _, t in pairs:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ok = [k for k, (i, _) in enumerate(pairs) if i is not None and sets[k]]
    links = [(a, b) for a in ok for b in ok if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is None, pairs[k][0] or 0))
    place = {k: n for n, k in enumerate(order)}
    comp = union(len(pairs), [(place[a], place[b]) for a, b in links])
    return sorted((str(i), len(sets[k]), str(None if i is None else pairs[order[comp[place[k]]]][0])) for k, (i, _) in enumerate(pairs))


def jaccard_rows(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows(jaccard_join.per_document(jaccard_join.ngram_jaccard_join(df))))


def test_jaccard_join(docs, empty):
    assert jaccard_rows(docs) == jaccard_brute(texts())
    assert jaccard_rows(empty) == []


def test_jaccard_join_of_a_loose_family(spark, monkeypatch):
    """Many near copies, some only linked through others, in blocks of a long run."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(90)]
    pairs = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(90)] = f"z{rng.randrange(40)}"
        pairs.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert jaccard_rows(df) == jaccard_brute(pairs)


def test_a_wide_family_is_not_verified_pair_by_pair(spark, monkeypatch):
    """Near copies around the bound: a component, others that link with few of it or with none."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(140)]
    pairs = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(140)] = f"z{rng.randrange(100_000)}"
        pairs.append((i, " ".join(w)))
    seen, verify = [], jaccard_join.verify

    def counted(found, *rest):
        found = common.written(found, "found")
        seen.append(found.count())
        return verify(found, *rest)

    monkeypatch.setattr(jaccard_join, "verify", counted)
    assert jaccard_rows(spark.createDataFrame(pairs, "doc_id long, text string")) == jaccard_brute(pairs)
    assert sum(seen) < 12 * len(pairs), seen


def test_the_bound_over_fine_groups_loses_no_pair():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    for size in (40, 300, 20_000, 50_000):  # the largest fill their groups to MOST over GROUPS
        sets = [np.sort(rng.choice(pool[: size * 6 // 5], size, replace=False)) for _ in range(24)]
        fine = np.array([np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % jaccard_join.FINE, minlength=jaccard_join.FINE), jaccard_join.MOST) for s in sets]).astype(np.uint8)
        rough = np.array([np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % jaccard_join.GROUPS, minlength=jaccard_join.GROUPS), jaccard_join.MOST) for s in sets]).astype(np.uint8)
        assert (jaccard_join.folded(fine) == rough).all()
        sketch = np.array([s[: jaccard_join.SKETCH].view(np.int64) for s in sets])
        sizes = np.full(len(sets), size)
        i, j = np.triu_indices(len(sets), 1)
        both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
        shared = np.array([len(np.intersect1d(sketch[a], sketch[b])) for a, b in zip(i, j)])
        for pct in (60, 66, 75):
            links = 100 * both >= pct * (2 * size - both)
            got = np.zeros(len(i), dtype=np.int64)
            for key in np.unique(sketch):
                got += jaccard_join.proposed(np.full(len(sets), key), i, j, sketch, sizes, fine, pct)
            assert (got[links & (shared >= jaccard_join.SHARED)] == shared[links & (shared >= jaccard_join.SHARED)]).all()
            assert (got[shared < jaccard_join.SHARED] == 0).all()


def test_a_text_without_an_id_links_others(spark):
    words_ = [f"w{k}" for k in range(60)]
    first, middle = words_[:], words_[8:]
    texts_ = [" ".join(first), " ".join(middle), " ".join(words_[14:] + ["x1"])]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts_]
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    df = spark.createDataFrame([(1, texts_[0]), (None, texts_[1]), (9, texts_[2]), (4, "far away from all of these words"), (None, "a b c d e f g")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in rows(jaccard_join.per_document(jaccard_join.ngram_jaccard_join(df))))
    assert got == Counter([(1, 1), (None, None), (9, 1), (4, 4), (None, None)])
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in rows(jaccard_join.kept_rows(df.withColumn("_key", F.lit(3)))))
    assert kept == [(0, "a b c d e f g"), (1, texts_[0]), (4, "far away from all of these words")]


def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(4)
    sizes = rng.integers(20, 60, 300)
    points = np.array([np.bincount(rng.integers(0, jaccard_join.GROUPS, n), minlength=jaccard_join.GROUPS) for n in sizes]).astype(np.uint8)
    points[150:] = points[:150]
    sizes[150:] = sizes[:150]
    comp = np.arange(300)
    tree = jaccard_join.CountTree(points, sizes)
    got = {tuple(sorted(p)) for i, j in jaccard_join.tree_join(tree, tree, comp, comp, 75, True) for p in zip(i.tolist(), j.tolist())}
    i, j = np.triu_indices(300, 1)
    keep = jaccard_join.may_link(points[i], sizes[i], sizes[i], points[j], sizes[j], sizes[j], 75)
    assert got == {tuple(sorted(p)) for p in zip(i[keep].tolist(), j[keep].tolist())}
    half = jaccard_join.CountTree(points[:100], sizes[:100]), jaccard_join.CountTree(points[100:], sizes[100:])
    across = {(a, b + 100) for x, y in jaccard_join.tree_join(*half, comp[:100], comp[100:], 75, False) for a, b in zip(x.tolist(), y.tolist())}
    assert across == {p for p in got if p[0] < 100 <= p[1]}


# ------------------------------------------------------------------- 2 and 3


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json"), Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")


def noise(alphabet, n, size):
    rng = random.Random(9)
    return ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(n)]


def test_codec_equals_the_library(libraries):
    bpe, lib = bpe_codec.codec(f"{TOKENIZERS}/word_bpe_49k.json"), libraries[0]
    for t in [t or "" for _, t in texts()] + noise("abeinthrst ", 600, 40) + noise("ab1é'. \x1c Σ", 300, 25) + ["a\x1cb", "<|startoftext|>a<|endoftext|>", "\U0001f600 ﬁ ǅ"]:
        want = lib.encode(t, add_special_tokens=False).ids
        assert bpe_codec.code_text(bpe, t) == (" ".join(map(str, want)), lib.decode(want, skip_special_tokens=False))


def test_codec_rows(docs, empty, libraries):
    lib, path = libraries[0], f"{TOKENIZERS}/word_bpe_49k.json"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe_codec.per_document(docs, path))) == sorted(want)
    assert rows(bpe_codec.per_document(empty, path)) == []
    full = {r["id"]: r for r in rows(bpe_codec.bpe_round_trip(docs, path))}
    assert full[8]["ids"] == lib.encode("one two", add_special_tokens=False).ids and full[5]["ids"] == []


def test_byte_tokens_equal_the_library(libraries):
    enc, lib = packing.tokens(f"{TOKENIZERS}/byte_bpe_50k.json"), libraries[1]
    for t in [t or "" for _, t in texts()] + noise("abe ,.\n'1é", 1500, 30) + [" a", "a ", "a  b", "x, y. z.", " ,", ".", ", ,"]:
        assert enc.ids(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_code_point_is_encoded_as_by_the_library(libraries):
    """A sweep over Unicode: all code points to U+20000, every 37th beyond."""
    points = [c for c in [*range(0x20000), *range(0x20000, 0x110000, 37)] if not 0xD800 <= c < 0xE000]
    words_, bytes_ = bpe_codec.WordBpe(f"{TOKENIZERS}/word_bpe_49k.json"), packing.tokens(f"{TOKENIZERS}/byte_bpe_50k.json")
    for k in range(0, len(points), 20_000):
        own = [f"x{chr(c)}y {chr(c)}Z{chr(c)}. \n{chr(c)}1" for c in points[k : k + 20_000]]
        for t, e in zip(own, libraries[0].encode_batch_fast(own, add_special_tokens=False)):
            assert bpe_codec.code_text(words_, t)[0] == " ".join(map(str, e.ids)), hex(ord(t[1]))
        for t, e in zip(own, libraries[1].encode_batch_fast(own, add_special_tokens=False)):
            assert bytes_.ids(t) == np.array(e.ids, "<u4").tobytes(), hex(ord(t[1]))


def test_long_pre_tokens_are_encoded_as_by_the_library(libraries):
    enc = packing.tokens(f"{TOKENIZERS}/byte_bpe_50k.json")
    for t in (" " * 300_000, "x" + "\n " * 100_000 + "y", "ab" * 100_000, "." * 50_000, "a <|endoftext|> b  <|endoftext|>\n <|endoftext"):
        assert enc.ids(t) == np.array(libraries[1].encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(docs, empty, libraries):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    got = rows(packing.pack_documents(docs, path))
    want = Counter()
    for i, t in texts():
        ids = np.array([*libraries[1].encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first if len(ids) > 1024 else len(ids), len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert rows(packing.pack_documents(empty, path)) == []


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_everything_and_are_tight(seed):
    rng = random.Random(seed)
    hist = Counter(min(1024, int(rng.expovariate(1 / 200)) + 1) for _ in range(3000))
    used, bins = Counter(), 0
    for times, parts in packing.plan(dict(hist)):
        assert sum(n * k for n, k in parts) <= 1024
        bins += times
        used.update({n: times * k for n, k in parts})
    assert used == hist
    assert bins <= math.ceil(sum(n * k for n, k in hist.items()) / 1024) + 2


def test_fullest_is_the_best_sum():
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randint(3, 40): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(20, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        found = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(n * k for n, k in found) == max(sums) and all(k <= counts[n] for n, k in found)


# ------------------------------------------------------------------- 4


def test_licences(docs, empty):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    want = []
    for i, t in texts():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        found = [(name, k) for name, p in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for _, k in found]
        want.append((str(i), len(w), len(found), str(min(at, default=None)), str(max(at, default=None)), ",".join(sorted({n for n, _ in found}))))
    got = rows(license_scan.per_document(docs))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in got) == sorted(want)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert rows(license_scan.per_document(empty)) == []


def test_licence_places_equal_plain_search(spark):
    """Random texts of template words: every place, label and share, by plain loops."""
    rng, ts = random.Random(8), license_scan.TEMPLATES
    vocab = sorted({w for t in ts for w in t.phrase})
    data = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 12)):
            t = rng.choice(ts)
            a, b = sorted((rng.randint(0, t.key), rng.randint(t.key, len(t.words))))
            parts += [*t.words[a:b], *rng.choices(vocab, k=rng.randint(0, 3))] if rng.random() < 0.5 else list(t.phrase)
        data.append((k, " ".join(parts).upper()))
    data.append((99, "the cc0 " * 20_000))
    got = {r["id"]: r for r in rows(license_scan.license_scan(spark.createDataFrame(data, "doc_id long, text string")))}
    for k, text in data:
        w, want = text.lower().split(), []
        for t in ts:
            for s in range(len(w)):
                if w[s : s + t.length] == list(t.phrase):
                    hits = sum(0 <= s - t.key + j < len(w) and w[s - t.key + j] == word for j, word in enumerate(t.words))
                    want.append((s, t.label, t.base, round(hits / len(t.words), 9)))
        assert got[k]["n_words"] == len(w) and [(f["start"], f["label"], f["base"], round(f["share"], 9)) for f in got[k]["found"]] == sorted(want)


# ------------------------------------------------------------------- 5


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    monkeypatch.setattr(embedding_dedup, "FAN", 2)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 8))
    x[30:60] = x[:30] + rng.normal(size=(30, 8)) * 0.25
    x[60:70] = x[0]
    odd = [None, [0.0] * 8, [float("nan")] * 8, [None] * 8, [1.0, 2.0], [float("inf")] + [1.0] * 7]
    data = [(k, [float(v) for v in np.float32(row)], 7) for k, row in enumerate(x)] + [(100 + k, v, 7) for k, v in enumerate(odd)] + [(None, [1.0] * 8, 7)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id int").repartition(3)
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    comp = union(90, zip(*(v.tolist() for v in np.nonzero(hit))))
    got = {r["vec_id"]: r for r in rows(embedding_dedup.per_vector(df))}
    for k in range(90):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (hit[k].sum(), comp[k], comp[k] == k)
    assert all(got[100 + k]["n_links"] == 0 and got[100 + k]["kept"] for k in range(len(odd))) and got[None]["component_id"] is None
    assert rows(embedding_dedup.per_vector(df.limit(0))) == []


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(9)
    base = {n: rng.standard_normal(n) for n in (2, 5, 8)}
    vectors = [(k, (base[8] + 0.01 * rng.standard_normal(8)).tolist()) for k in range(4)]
    vectors += [(10 + k, (base[5] + 0.01 * rng.standard_normal(5)).tolist()) for k in range(3)] + [(13, (-base[5]).tolist())]
    vectors += [(20, base[2].tolist()), (21, base[2].tolist()), (30, [1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(embedding_dedup.per_vector(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")))}
    want = {k: (3, 0, k == 0) for k in range(4)} | {10 + k: (2, 10, k == 0) for k in range(3)}
    assert got == want | {13: (0, 13, True), 20: (1, 20, True), 21: (1, 20, False), 30: (0, 30, True)}


def test_a_vector_without_an_id_links_others(spark):
    turn = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg)), -0.0]
    data = [(1, turn(0)), (None, turn(15)), (9, turn(30)), (4, turn(90)), (5, [*turn(90)[:2], 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(embedding_dedup.per_vector(spark.createDataFrame(data, "vec_id long, embedding array<double>")))}
    assert got == {1: (1, 1, True), 9: (1, 1, False), None: (2, None, False), 4: (1, 4, True), 5: (1, 4, False)}


def test_hot_keys_are_broadcast(spark):
    rows_ = spark.range(6000).selectExpr("id", "CASE WHEN id < 3000 THEN 0L WHEN id < 5000 THEN id WHEN id < 5500 THEN -1L END AS k", "1L AS j")
    table = rows_.where("k >= 0").groupBy("k", "j").agg(F.count(F.lit(1)).alias("n"))
    got = common.looked_up(rows_, table, ["k", "j"], "n")
    assert sorted(got.columns) == ["id", "j", "k", "n"]
    assert Counter(r["n"] for r in got.collect()) == {3000: 3000, 1: 2000, None: 1000}


# ------------------------------------------------------------------- 6


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_unigram_scores(docs, empty, frequent, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t in texts():
        if not out(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), out(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), 5)) for i, t in texts())
    got = rows(language_model.per_document(docs))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert rows(language_model.per_document(empty)) == []


def small_model():
    start = np.log(np.full(language_model.VOCABULARY, 1 / language_model.VOCABULARY))
    return language_model.initial(start)


def test_model_is_a_distribution():
    p = small_model()
    h = np.random.default_rng(0).standard_normal((1, language_model.HIDDEN)).astype(np.float32)
    every = np.arange(language_model.VOCABULARY)
    assert np.exp(language_model.output(p, np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_over_the_whole_text():
    p, rng = small_model(), np.random.default_rng(1)
    streams = [rng.integers(0, language_model.VOCABULARY, n) for n in (70, 3, 41)]
    got = language_model.score_texts(p, np.concatenate(streams), np.cumsum([0, 70, 3, 41]))
    table = p["emb"] @ p["wx"] + p["b"]
    for s, g in zip(streams, got):
        h, last, total = np.zeros((1, language_model.HIDDEN), np.float32), language_model.END, 0.0
        for token in s:
            h, _ = language_model.step(table, p["wh"], np.array([last]), h)
            total += float(language_model.output(p, h, np.array([token]))[0])
            last = token
        assert g == pytest.approx(total, rel=1e-4)


def test_training_lowers_the_loss():
    p, rng = small_model(), np.random.default_rng(2)
    g2 = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    stream = np.tile([2, 3, 4, 5, 6, 7, 8, 1], 400)
    before = language_model.score_texts(p, stream[:64], np.array([0, 64]))[0]
    h = np.zeros((4, language_model.HIDDEN), np.float32)
    for t in range(0, 640, 16):
        at = np.arange(4) * 700 + t + np.arange(17)[:, None]
        h = language_model.train_window(p, g2, stream[at[:-1]], stream[at[1:]], h)
    after = language_model.score_texts(p, stream[:64], np.array([0, 64]))[0]
    assert after > 0.3 * before and rng is not None


def test_backpropagation_equals_differences():
    """The gradient of a window (from what it adds to the squares) against central differences."""
    p, rng = small_model(), np.random.default_rng(4)
    for k in p:
        p[k] = p[k] + rng.normal(0, 0.2, p[k].shape).astype(np.float32) * (0.1 if k in ("bc", "bw") else 1)
    tokens = rng.integers(2, 60, (7, 3))
    tokens[3, 1] = language_model.END  # a text ends: the state starts anew
    start = rng.normal(0, 0.5, (3, language_model.HIDDEN)).astype(np.float32)

    def loss(q):
        h, total = start.astype(np.float64), 0.0
        for t in range(6):
            h = h * (tokens[t] != language_model.END)[:, None]
            h, _ = language_model.step(q["emb"] @ q["wx"] + q["b"], q["wh"], tokens[t], h)
            total -= language_model.output(q, h, tokens[t + 1]).sum()
        return total / 3

    exact = {k: v.astype(np.float64) for k, v in p.items()}
    squares, moved = {k: np.zeros_like(v) for k, v in p.items()}, {k: v.copy() for k, v in p.items()}
    language_model.train_window(moved, squares, tokens[:-1], tokens[1:], start)
    numeric = {}
    for k, v in exact.items():
        for at in map(tuple, np.argwhere(squares[k] >= np.partition(squares[k].ravel(), -3)[-3])[:3]):
            both = []
            for e in (1e-4, -1e-4):
                q = dict(exact)
                q[k] = v.copy()
                q[k][at] += e
                both.append(loss(q))
            numeric[k, at] = (both[0] - both[1]) / 2e-4
    clip = min(1.0, 5.0 / np.sqrt(sum(s.sum() for s in squares.values()))) if sum(s.sum() for s in squares.values()) < 24.9 else None
    for (k, at), g in numeric.items():
        sign = -np.sign(moved[k][at] - p[k][at])
        assert sign == np.sign(g)
        if clip is not None:
            assert sign * np.sqrt(squares[k][at]) == pytest.approx(g, rel=2e-2)


def test_scores_equal_plain_loops(spark):
    """The whole way on a small corpus of one task: one batch trained once, every text scored
    token by token."""
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(40)]
    texts_ = [(k, " ".join(rng.choices(vocab, weights=range(1, 41), k=rng.randint(0, 60)))) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(texts_, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in rows(language_model.per_document(df))}
    training = [(k, t or "") for k, t in texts_ if zlib.crc32(str(k).encode()) % 5 != 1]
    counts = Counter(w for _, t in training for w in [*t.split(), "END"])
    total, kinds = sum(counts.values()), len(counts)
    hashes = dict(zip(vocab, common.Words(pa.array([" ".join(vocab)])).hash.tolist()))
    best = sorted((w for w in counts if w != "END"), key=lambda w: (-counts[w], hashes[w]))
    symbol = {w: k + 2 for k, w in enumerate(best)} | {"END": language_model.END}
    chance = {w: (counts[w] + 0.5) / (total + 0.5 * (kinds + 1)) for w in counts}
    mass = np.full(language_model.VOCABULARY, 1e-12)
    for w, s in symbol.items():
        mass[s] = chance[w]
    mass[language_model.RARE] = max(1 - mass[1:].sum(), 1e-12)
    p = language_model.unflat(language_model.flat(language_model.initial(np.log(mass))))
    squares = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    stream = np.array([language_model.END, *(symbol[w] for _, t in training for w in [*t.split(), "END"])])
    lanes = max(1, min(language_model.LANES, len(stream) // (32 * language_model.WINDOW)))
    length, longer = divmod(len(stream) - 1, lanes)
    begin = [k * length + min(k, longer) for k in range(lanes)]
    h = np.zeros((lanes, language_model.HIDDEN), np.float32)
    for t in range(0, length, language_model.WINDOW):
        own = np.array([[stream[b + t + i] for b in begin] for i in range(min(language_model.WINDOW, length - t) + 1)])
        h = language_model.train_window(p, squares, own[:-1], own[1:], h)
    if longer:
        own = np.array([[stream[b + length + i] for b in begin[:longer]] for i in range(2)])
        language_model.train_window(p, squares, own[:-1], own[1:], h[:longer])
    table = p["emb"] @ p["wx"] + p["b"]
    for k, t in texts_:
        h, last, score, base = np.zeros((1, language_model.HIDDEN), np.float32), language_model.END, 0.0, 0.0
        for w in [*(t or "").split(), "END"]:
            h, _ = language_model.step(table, p["wh"], np.array([last]), h)
            last = symbol.get(w, language_model.RARE)
            own = math.log10(chance.get(w, 0.5 / (total + 0.5 * (kinds + 1))))
            score += float(language_model.output(p, h, np.array([last]))[0]) / math.log(10) + (own - math.log10(mass[language_model.RARE]) if last == language_model.RARE else 0)
            base += own
        assert got[k]["score"] == pytest.approx(score, rel=1e-3) and got[k]["base_score"] == pytest.approx(base) and got[k]["train_tokens"] == total


def test_training_covers_each_token_once(monkeypatch):
    class Held:
        def __init__(self, value):
            self.value = value

    names = [f"w{k}" for k in range(900)]
    hashes = np.sort(common.Words(pa.array([" ".join(names)])).hash)
    start = np.log(np.full(language_model.VOCABULARY, 1 / language_model.VOCABULARY))
    lex = language_model.Lexicon(hashes, np.zeros(900), np.arange(2, 902).astype(np.int16), 900, 900, 0.0, 0.0, start, True)
    rng, seen = random.Random(3), Counter()
    texts = [" ".join(rng.choice(names) for _ in range(n)) for n in (70_000, 0, 5, 61_003, 400_000, 400_001)]
    own = dict(zip(hashes.tolist(), range(2, 902)))
    want = Counter(own[x] for x in common.Words(pa.array(texts)).hash.tolist()) + Counter({language_model.END: len(texts)})

    def note(p, g2, inputs, targets, h):
        assert inputs.shape == targets.shape and inputs.shape[1] == len(h)
        seen.update(targets.ravel().tolist())
        return h

    monkeypatch.setattr(language_model, "train_window", note)
    weights, trained = Held(language_model.flat(language_model.initial(start))), 0
    for nth in range(language_model.ROUNDS):
        for out in language_model._train(Held(lex), weights, nth)([pa.RecordBatch.from_pydict({"text": texts})]):
            trained += np.frombuffer(out.column(0)[0].as_py())[-1]
    assert seen == want and trained == sum(want.values())


# ------------------------------------------------------------------- 7


def test_quotes_become_replies(spark):
    data = [(1, 0, "user", "Hello there\nhow are you", 7), (1, 1, "assistant", "> how are  YOU\nFine", 7), (1, 2, "user", "Other topic", 7), (1, 3, "user", ">> Hello there\n> Fine\nGood", 7), (1, 4, None, None, 7), (None, 3, "user", "> x\ny", 7), (2, 0, "user", "> nothing\nhey", 7), (2, 0, "user", "> nothing\nhey", 7)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, place int")
    got = sorted(((r["conv_id"] or 0, r["place"], r["turn"], r["parent_turn"], r["quoted"], r["chat"]) for r in rows(quotation.format_chat(df))), key=str)
    assert [g[:5] for g in got] == [(0, 0, 3, None, False), (1, 0, 0, None, False), (1, 1, 1, 0, True), (1, 2, 2, 1, False), (1, 3, 3, 1, True), (1, 4, 4, 3, False), (2, 0, 0, None, False), (2, 1, 0, None, False)]
    assert got[2][5] == "<|assistant|>\nFine\n" and got[4][5] == "<|user|>\nGood\n"
    assert quotation.parse("> > a\n>b\nc") == ("c", [(2, "a"), (1, "b")])
    assert rows(quotation.format_chat(df.limit(0))) == []


def parsed_brute(text):
    """Levels and bodies by walking over characters, without the operator's pattern."""
    lines = []
    for line in (text or "").split("\n"):
        at, level, stop = 0, 0, 0
        while at < len(line) and line[at].isspace():
            at += 1
        while at < len(line) and line[at] == ">":
            level, at = level + 1, at + 1
            if at < len(line) and line[at].isspace():
                at += 1
            stop = at
        lines.append((level, line[stop:] if level else line))
    runs = []
    for level, body in lines:
        if runs and level and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    return "\n".join(b for n, b in lines if not n).strip(), [(n, "\n".join(b)) for n, b in runs if n]


def test_parsing_of_levels():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice([">", ">", " ", "\n", "\n", "a", "b", "\t", "> ", "\n>", "\u00a0"]) for _ in range(rng.randint(0, 40)))
        assert quotation.parse(text) == parsed_brute(text), text
    assert quotation.parse(None) == ("", [])


def test_many_quoted_lines_take_linear_time(spark):
    import time

    text = "\n".join(f"> line {k}" for k in range(200_000))
    began = time.time()
    own, passages = quotation.parse("yes\n" + text)
    assert time.time() - began < 5 and own == "yes" and len(passages) == 1 and passages[0][1].count("\n") == 199_999
    df = spark.createDataFrame([(1, 1, "user", "line 150000"), (1, 2, "user", "other"), (1, 3, "user", "yes\n" + text)], "conv_id long, turn long, role string, text string")
    assert {(r["turn"], r["parent_turn"], r["quoted"]) for r in rows(quotation.format_chat(df))} == {(1, None, False), (2, 1, False), (3, 1, True)}


def chat_brute(data):
    """(conv, turn, parent, quoted, place, chat) of every message by plain loops."""
    said = {}
    for conv, turn, _, text in data:
        if conv is not None and turn is not None:
            for u in quotation.units(quotation.parse(text)[0]):
                said.setdefault((conv, u), set()).add(turn)
    out = []
    for row, (conv, turn, role, text) in enumerate(data):
        own, passages = quotation.parse(text)
        parent = quoted = None
        if conv is not None and turn is not None:
            found = []
            for level, passage in passages:
                for u in quotation.units(passage):
                    found += [(level, -len(u), -t) for t in said.get((conv, u), ()) if t < turn]
            earlier = [t for c, t, _, _ in data if c == conv and t is not None and t < turn]
            quoted = bool(found)
            # of one passage's matches the latest, then the order of passages
            parent = -min((lv, n, t) for lv, n, t in found)[2] if found else max(earlier, default=None)
        out.append([conv, turn, parent, bool(quoted), 0, f"<|{role or 'unknown'}|>\n{own}\n", row])
    for conv in {r[0] for r in out if r[0] is not None}:
        own = sorted((r for r in out if r[0] == conv and r[1] is not None), key=lambda r: (r[2] is not None, r[2] or 0, r[1], r[6]))
        for place, r in enumerate(own):
            r[4] = place
    return out


def test_quoted_conversations_equal_plain_loops(spark):
    rng, data = random.Random(4), []
    lines = [f"line {k} {'abc' * (k % 3)}" for k in range(12)]
    for conv in (1, 2, -1, None):
        for turn in range(60 if conv == 1 else 12):
            body = []
            for _ in range(rng.randint(0, 3)):
                mark = rng.choice(["", "> ", ">> ", ">"])
                body.append(mark + rng.choice(lines).upper())
            data.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", None]), "\n".join(body)))
    data += [(1, 5, "user", "line 1"), (2, 3, "user", "> line 2\n" + "x" * 200_000), (-1, None, "user", "> line 3"), (2, 4, "user", None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    chat = quotation.format_chat(df)
    got = Counter((r["conv_id"], r["turn"], r["parent_turn"], r["quoted"], r["chat"]) for r in rows(chat))
    want = chat_brute(data)
    assert got == Counter((c, t, p, q, text) for c, t, p, q, _, text, _ in want)
    places = Counter((r["conv_id"], r["turn"], r["parent_turn"], r["place"]) for r in rows(chat))
    assert places == Counter((c, t, p, at) for c, t, p, _, at, _, _ in want)
    whole = Counter()
    for r in rows(quotation.conversations(chat, 7)):
        assert r["messages"] <= 7
        whole[r["conv_id"]] += r["messages"]
    assert whole == Counter(c for c, t, *_ in data if c is not None and t is not None)


def test_unquoted_conversations_stay_in_turn_order(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    for r in rows(quotation.format_chat(c)):
        assert r["place"] == r["turn"] and r["parent_turn"] == (r["turn"] - 1 if r["turn"] else None) and not r["quoted"]


# ------------------------------------------------------------------- 8


def test_quality_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = rows(quality.per_document(d, labels))
    assert len(got) == d.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == q for p, q in judged) / len(judged) > 0.95


def test_quality_equals_plain_ridge_and_isotonic(spark):
    """Refits from explicit features, fold by fold, and the min-max form of isotonic regression."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    measured = quality.measured(d)
    data = [(np.frombuffer(r["stats"]), r["label"], r["fold"]) for r in quality.training(measured, labels).collect()]
    x, y, fold = np.array([a for a, _, _ in data]), np.array([b for _, b, _ in data]), np.array([c for _, _, c in data])
    rng = np.random.default_rng(quality.SEED)
    wave, phase = rng.standard_normal((x.shape[1], quality.FEATURES)) / np.sqrt(x.shape[1] / 8), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)

    def features(v, width):
        z = np.clip((v - mean) / scale, -4, 4) @ (wave / width) + phase
        return np.column_stack([np.sqrt(2 / quality.FEATURES) * np.cos(z), np.ones(len(v))])

    def ridge(f, t, weight):
        extra = np.sqrt(weight * len(f)) * np.eye(quality.FEATURES, quality.FEATURES + 1)
        return np.linalg.lstsq(np.vstack([f, extra]), np.append(t, np.zeros(len(extra))), rcond=None)[0]

    best = None
    for width in quality.WIDTHS:
        f = features(x, width)
        for weight in quality.RIDGES:
            out = np.zeros(len(y))
            for k in range(quality.FOLDS):
                out[fold == k] = f[fold == k] @ ridge(f[fold != k], y[fold != k], weight)
            error = ((out - y) ** 2).sum()
            if best is None or error < best[0]:
                best = error, width, ridge(f, y, weight), out
    _, width, w, out = best
    at = np.clip((out + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    positive, total = np.bincount(at, weights=y, minlength=quality.BINS), np.bincount(at, minlength=quality.BINS)
    used = np.flatnonzero(total)
    p, n = positive[used], total[used]
    rate = lambda a, b: p[a : b + 1].sum() / n[a : b + 1].sum()
    plain = [max(min(rate(a, b) for b in range(k, len(used))) for a in range(k + 1)) for k in range(len(used))]
    model = quality.fit(quality.training(measured, labels))
    assert np.allclose(model.weights, w, atol=1e-4)
    pools = np.flatnonzero(np.append(True, np.diff(plain) > 1e-12))
    smooth = np.concatenate([np.full(b - a, (p[a:b].sum() + 0.5) / (n[a:b].sum() + 1)) for a, b in zip(pools, [*pools[1:], len(used)])])
    steps = np.interp(np.arange(quality.BINS), used, np.maximum.accumulate(smooth))
    assert np.allclose(model.steps, steps, atol=1e-9)
    rows_ = rows(d.select("doc_id", "text"))
    stats = np.array([quality.statistics(pa.array([r["text"]], pa.string()))[0] for r in rows_])
    raw = features(stats, width) @ w
    score = np.clip(np.interp((raw + 0.5) / 2 * quality.BINS - 0.5, np.arange(quality.BINS), steps), 0, 1)
    got = {r["doc_id"]: r["score"] for r in rows(quality.per_document(d, labels))}
    assert max(abs(got[r["doc_id"]] - v) for r, v in zip(rows_, score)) < 1e-3


def test_quality_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    assert len(rows(quality.per_document(docs, labels))) == len(texts())
    assert all(r["score"] == 0.5 for r in rows(quality.per_document(docs, labels.limit(0))))
    assert rows(quality.per_document(empty, labels)) == []


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    total = rng.integers(0, 20, 200).astype(float)
    positive = rng.binomial(total.astype(int), np.linspace(0.1, 0.9, 200)).astype(float)
    s = quality.isotonic(positive, total)
    assert (np.diff(s) >= 0).all() and abs((s * total).sum() / total.sum() - positive.sum() / total.sum()) < 0.02


# ------------------------------------------------------------------- 9


def removed_brute(pairs):
    split = [words(t, False) for _, t in pairs]
    seen = Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    out = []
    for (i, _), w in zip(pairs, split):
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeated_windows_go(docs, empty):
    get = lambda df: sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.per_document(df)))
    assert get(docs) == removed_brute(texts())
    assert get(empty) == []


def test_repeats_at_every_offset(spark):
    rng = random.Random(1)
    w = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    passage, pairs = w(80), []
    for k in range(46):
        pairs.append((k, " ".join(w(k % 7) + passage[k : k + 30 + k % 9] + w(5))))
    pairs.append((99, " ".join(["same"] * 100)))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(8)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.per_document(df))) == removed_brute(pairs)


def test_windows_that_share_forty_bits_are_apart(monkeypatch):
    def one(words, window):
        return np.array([0]), np.array([len(words.hash) << 50 | 5], np.uint64), np.array([0]), np.array([7], np.uint64)

    monkeypatch.setattr(substring_dedup, "suffixes", one)
    told = []
    for texts in (("a b", "a b c"), ("a b", "a b")):
        batches = [pa.RecordBatch.from_pydict({"key": [k], "key2": [7 * k], "text": [t]}) for k, t in enumerate(texts)]
        out = substring_dedup._subtrees(2)(substring_dedup._send(2, 1)(batches))
        told.append(sorted(r["doc"] for b in out for r in b.to_pylist()))
    assert told == [[], [0, 1]]


def test_heavy_groups_are_split(docs, monkeypatch):
    want = sorted(map(str, rows(substring_dedup.per_document(docs))))
    sent, send = [], substring_dedup._send
    monkeypatch.setattr(substring_dedup, "_send", lambda *given: sent.append(given) or send(*given))
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 200)
    assert sorted(map(str, rows(substring_dedup.per_document(docs)))) == want
    (_, groups, heavy, split), *_ = sent
    assert len(heavy) and (np.diff(heavy) > 0).all() and 0 <= heavy.min() and heavy.max() < groups and split.min() > 1
    for some in (np.arange(8), np.array([1, 4, 7])):  # whichever groups are split, nothing changes
        monkeypatch.setattr(substring_dedup, "MOST_GROUPS", 8)
        monkeypatch.setattr(substring_dedup, "pieces", lambda d, w, groups, size, some=some: (some, np.full(len(some), 3)))
        assert sorted(map(str, rows(substring_dedup.per_document(docs)))) == want


def test_heavy_groups_are_those_by_weight(docs, monkeypatch):
    split = [words(r["text"] or "", False) for r in docs.select("text").collect()]
    size = sum(len((r["text"] or "").encode()) for r in docs.select("text").collect())
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 200)
    weight = Counter()
    for batch in docs.select("text").coalesce(1).toArrow().to_batches():
        for part in substring_dedup.slices(batch):
            found = substring_dedup.suffixes(substring_dedup.Words(part.column("text"), substring_dedup.SAME), 35)
            if found is not None:
                weight.update(substring_dedup._group(found[3][substring_dedup.marked(found[1], found[3])[1]], 8).tolist())
    heavy, parts = substring_dedup.pieces(docs.select("text").coalesce(1), 35, 8, size)
    assert sum(max(0, len(w) - 34) for w in split) >= sum(weight.values()) > 100
    assert {g for g, n in weight.items() if n > 200} <= set(heavy.tolist()) <= {g for g, n in weight.items() if n > 100}
    assert len(substring_dedup.pieces(docs, 35, 8, 200)[0]) == 0  # too little text for a heavy group


# ------------------------------------------------------------------- 10


def test_exact_groups(docs, empty):
    groups = defaultdict(list)
    for i, t in texts():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for norm, members in groups.items():
        keep = min(members)[3]
        want += [(str(i), str(keep), len(members), hashlib.sha256(norm.encode()).hexdigest()) for *_, i in members]
    got = rows(exact_dedup.per_document(docs))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == sorted(want)
    assert sum(r["kept"] for r in got) == len(groups)
    assert rows(exact_dedup.per_document(empty)) == []


def test_lazy_digests_give_the_same_groups(docs):
    view = lambda **k: sorted((str(r["id"]), str(r["keep_id"]), r["group_size"]) for r in rows(exact_dedup.exact_dedup(docs, **k)))
    assert view(digest_all=False) == view(digest_all=True)


def test_one_row_of_each_group_stays(docs):
    kept = rows(exact_dedup.kept_rows(docs))
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in texts()}) and set(kept[0]) == set(docs.columns)


# ------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    docs, before = spark.read.parquet(f"{at}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            out = common.written(out, name)
            n = out.count()
            assert 0 < n <= (before or n)
            if name == "exact_dedup":
                assert out.select(F.countDistinct(exact_dedup.normalised(F.col("text")))).first()[0] == n
            if name == "near_dedup":
                assert all(r["component_id"] == r["doc_id"] for r in rows(jaccard_join.per_document(jaccard_join.ngram_jaccard_join(out))))
            docs, before = out, n
        else:
            assert {r["doc_id"] for r in rows(out.select("doc_id"))} == {r["doc_id"] for r in rows(docs.select("doc_id"))}


def test_substring_stage_keeps_untouched_texts(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts()], "doc_id long, text string, lang string, source string, n_chars long")
    out = rows(substring_dedup.cleaned_rows(df))
    lost = {i: n for i, _, n, _ in removed_brute(texts())}
    before = defaultdict(list)
    for i, t in texts():
        before[str(i)].append(t)
    for r in out:
        if lost[str(r["doc_id"])] == 0:
            assert r["text"] in before[str(r["doc_id"])]
        else:
            assert r["text"] and r["n_chars"] == len(r["text"])
