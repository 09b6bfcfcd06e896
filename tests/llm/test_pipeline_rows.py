"""The pipeline on odd tables, and as a whole against plain loops behind its classifier."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from eventloom.llm import quality
from eventloom.llm.queries import TOKENIZERS

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, _key long, spans int, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_rows(spark):
    """Rows of the table, and copies, near copies, shared passages, blanks, nulls and repeated ids."""
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(4)
    long = [t for _, t in given if t and len(t.split()) > 150]
    near = long[0].split()
    near[50] = "other"
    passage = " ".join(long[1].split()[40:100])
    extra = [(9000, long[0]), (9001, long[0].replace(" ", "  ", 4)), (9002, " ".join(near)), (None, long[2]), (None, None), (9003, ""), (9003, " \t"), (9003, long[3]), (9004, passage + " " + long[4]), (9005, "x" * 300_000), (9006, " ".join(rng.choice(long[5].split()) for _ in range(30_000))), (9000, long[0]), (9007, passage)]
    return given + extra


def folder(spark, tmp_path, rows, labels):
    at = str(tmp_path)
    full = [(i, t, "en", "s", len(t or ""), "x", 7, 7, True) for i, t in rows]
    spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return at


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i, t))
    return [min(g, key=lambda r: r[:3])[3:] for g in groups.values()]


def near_brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for k, r in enumerate(rows) if find(k) == k]


def repeats_brute(rows):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    out = []
    for (i, t), w in zip(rows, split):
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        if not gone:
            out.append((i, t))
        elif len(gone) < len(w):
            out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_the_whole_pipeline_equals_plain_loops(spark, tmp_path):
    at = folder(spark, tmp_path, odd_rows(spark), spark.read.parquet(f"{DATA}/labels.parquet"))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    good = [(r["doc_id"], r["text"]) for r in quality.accepted(docs, spark.read.parquet(f"{at}/labels.parquet")).collect()]
    left = repeats_brute(near_brute(exact_brute(good)))
    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in left)
    got, room = defaultdict(int), defaultdict(int)
    pieces = corpus_pipeline.run(spark, at).collect()
    for r in pieces:
        room[r["sequence_id"]] += r["length"]
    for r in pieces:  # a repeated id's texts are told apart by where their pieces start
        got[r["doc_id"]] += r["length"]
    total = Counter()
    for (i, n), k in want.items():
        total[i] += n * k
    assert dict(got) == dict(total) and max(room.values()) <= 1024
    assert len(left) > 100 and len(left) < len(good)


@pytest.mark.parametrize("case", ["empty", "nulls", "no labels"])
def test_the_pipeline_on_odd_tables(spark, tmp_path, case):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    none = labels.limit(0)
    if case == "empty":
        assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], none)).count() == 0
    elif case == "nulls":
        at = folder(spark, tmp_path, [(None, None), (None, ""), (1, None), (1, " "), (1, None)], labels)
        assert corpus_pipeline.run(spark, at).count() <= 1  # all texts are equal, so at most one row stays
    else:
        rows = odd_rows(spark)
        at = folder(spark, tmp_path, rows, none)
        docs = spark.read.parquet(f"{at}/documents.parquet")
        assert quality.accepted(docs, none).count() == len(rows)  # nothing is dropped in silence
        assert corpus_pipeline.run(spark, at).select("doc_id").distinct().count() > 100
    stage = dict(corpus_pipeline.STAGES)
    blank = spark.createDataFrame([], DOCS)
    for name in ("quality", "exact_dedup", "near_dedup", "substring_dedup"):
        if case == "empty":
            assert stage[name](spark, blank, str(tmp_path)).count() == 0


def test_columns_of_clashing_names_do_not_matter(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7, 7, True) for i, t in odd_rows(spark)], DOCS)
    stage = dict(corpus_pipeline.STAGES)
    for name in ("exact_dedup", "near_dedup", "substring_dedup"):
        out = stage[name](spark, docs, DATA)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        plain = stage[name](spark, docs.select(*corpus_pipeline.COLUMNS), DATA)
        count = lambda df: sorted(r["h"] for r in df.select(F.xxhash64("doc_id", "text").alias("h")).collect())
        assert count(out) == count(plain)
    assert np.isfinite(out.count())
