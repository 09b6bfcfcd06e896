"""Filter audit, prefix trie and token counts against brute force and the tokenizer's library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from eventloom.llm import filter_audit, prefix_trie, token_counts

EXTRA = "doc_id long, text string, lang string, id long, part int, first int, n int, label int"
LABELS = "doc_id long, quality int, toxic int, part string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ------------------------------------------------------------------- 11


def audit_texts():
    rng = random.Random(3)
    say = lambda n, vocab: " ".join(rng.choice(vocab) for _ in range(n))
    many, few = [f"w{k}" for k in range(5000)], ["a", "b", "c"]
    long = say(250, many)
    return [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (0, say(300, few), "en"), (3, say(300, few) + " $", "fr"), (4, None, None), (5, "", None), (6, " \t\x0b ", "fr"),
        (7, "A B C", "de"), (8, "É" * 300, "de"), (None, long, "en"), (None, None, "en"), (9, "x" * 200_000, ""), (10, say(100_000, many), ""), (11, say(199, many), "de"), (12, say(200, many), "de"),
        (13, say(100, many) + " " + say(100, ["Ab", "ab"]), "es"), (14, "A a", "es"), (15, "<% ok %>", "es"), (16, long + " ", "fr"), (-1, "A a", "es"),
    ]


def audit_brute(docs, labels):
    flagged = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t)]
        fails.append(i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))
        own = [x for x in labels if x[0] is not None and x[0] == i]
        flagged.append((lang or "", dict(zip("ABCDE", fails)), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, Counter()
    for part in {f[0] for f in flagged}:
        for order in permutations("ABCDE"):
            left = [f for f in flagged if f[0] == part]
            gone = []
            for step, k in enumerate(order, 1):
                lost = [f for f in left if f[1][k]]
                left = [f for f in left if not f[1][k]]
                alone = sum(f[0] == part and f[1][k] and sum(f[1].values()) == 1 for f in flagged)
                out[part, "".join(order), step] = [len(left), len(lost), sum(f[1][k] for f in gone), alone, sum(f[2] for f in lost), sum(f[3] for f in lost)]
                shapley[part, k] += len(lost)
                gone += lost
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_filter_audit_replays_every_order(spark):
    docs = audit_texts()
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (7, 1, 1), (8, 1, 0), (16, 1, 0), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, 7, 7, 7, 7, 7) for d in docs], EXTRA).repartition(3)
    said = spark.createDataFrame([(*x, "z") for x in labels], LABELS)
    got = rows(filter_audit.filter_audit(frame, said))
    want = audit_brute(docs, labels)
    assert {(r["part"], r["filter_order"], r["step"]): (*(r[c] for c in filter_audit.COUNTS), r["shapley"]) for r in got} == want
    assert len(got) == len(want) and len(got) == 600 * len({d[2] or "" for d in docs})


def test_filter_audit_of_a_hot_text_and_of_nothing(spark):
    none = spark.createDataFrame([], LABELS)
    assert rows(filter_audit.filter_audit(spark.createDataFrame([], EXTRA), none)) == []
    docs = [(k, "same text", "en") for k in range(3000)] + [(k, f"other {k}", "fr") for k in range(3000, 4000)]
    got = {(r["part"], r["filter_order"], r["step"]): r for r in rows(filter_audit.filter_audit(spark.createDataFrame([(*d, 7, 7, 7, 7, 7) for d in docs], EXTRA), none))}
    assert got["en", "EABCD", 1]["removed"] == 2999 and got["en", "EABCD", 2]["removed"] == 1 and got["en", "ABCDE", 5]["redundant"] == 2999
    assert got["fr", "EABCD", 1]["kept"] == 1000 and got["fr", "EABCD", 2]["unique_fails"] == 1000
    assert sum(got["en", "ABCDE", s]["shapley"] for s in range(1, 6)) == 120 * 3000


# ------------------------------------------------------------------- 12

TALK = "conv_id long, turn long, role string, text string, key string, path int, n int, piece int"


def trie_brute(talk):
    """Every rebuilt conversation and node by itself."""
    own = defaultdict(list)
    for c, turn, role, text in talk:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        whole = tuple(own.get(donor, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    told = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], told(ends.get(p, []))) for p, m in members.items())


def trie(spark, talk, **options):
    frame = spark.createDataFrame([(*t, "k", 7, 7, 7) for t in talk], TALK).repartition(3)
    got = rows(prefix_trie.prefix_trie(frame, **options))
    return Counter((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["ended"]) for r in got)


def talks(n, turns, seed):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        out += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hé", "", None, "long " * 50])) for t in range(rng.randint(0, turns))]
    return out


def test_the_trie_equals_all_prefixes_of_all_conversations(spark):
    talk = talks(120, 14, 1) + [(None, 1, "user", "x"), (-3, 1, "user", "x"), (-3, 2, "user", "x"), (-1, None, None, None), (500, 3, "user", "one"), (503, 1, "user", "two")]
    want = trie_brute(talk)
    assert trie(spark, talk) == want
    assert trie(spark, talk, piece=2, run_bytes=1000, range_bytes=2000) == want  # pieces that hang from others, many runs and ranges


def test_the_trie_of_hot_and_very_long_conversations(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 5) for t in range(6)]  # equal ones, over all ranges
    long = [(c, t, "user", f"line {t if c < 10_000 or t < 300 else -t}") for c in (5005, 10_005) for t in range(700)]
    talk = same + long + talks(40, 5, 2) + [(20_000, 1, "user", "again")] * 2000  # one conversation with a third of the rows
    want = trie_brute(talk)
    assert trie(spark, talk, piece=64, run_bytes=20_000, range_bytes=10_000) == want
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert trie(spark, [(None, 1, "user", "x")]) == Counter()
    assert trie(spark, [(7, 1, "user", "x")]) == trie_brute([(7, 1, "user", "x")])


def test_loser_trees_tell_order_and_shared_turns():
    rng = random.Random(4)
    for width in (1, 2, 3, 5, 8, 13):
        keys = [(b"".join(bytes([rng.randrange(3)]) * prefix_trie.NAME for _ in range(rng.randint(1, 6))), i) for i in range(200)]
        runs = [sorted(keys[k::width]) for k in range(width)]
        given = [[(0 if j == 0 else prefix_trie.shared(r[j - 1][0], key), key, i) for j, (key, i) in enumerate(r)] for r in runs]
        got = list(prefix_trie.merged(given))
        assert [row[1:] for _, row in got] == sorted(keys)
        assert [lcp for lcp, _ in got] == [0] + [prefix_trie.shared(a[0], b[0]) for a, b in zip(sorted(keys), sorted(keys)[1:])]


# ------------------------------------------------------------------- 13


def test_the_shortcut_is_proved_and_counts_are_the_librarys(spark):
    library = SentencePieceProcessor(model_file=MODEL)
    counter = token_counts.Counter(*token_counts.pieces_of(MODEL)).ready()
    assert len(counter.whole) > 30_000
    for piece in random.Random(2).sample(sorted(counter.whole), 3000):
        alone = piece.lstrip(token_counts.SPACE)
        if piece == token_counts.SPACE + alone and alone:
            assert library.encode(alone, out_type=str) == [piece]
    rng = random.Random(1)
    pieces = [p.replace(token_counts.SPACE, " ") for p in counter.scores]
    parts = [" ", "  ", token_counts.SPACE, "\n", "\t", "a", "é", "é", "\U0001f600", "　", "<s>", "</s>", "<unk>", "<0x41>", "\0", "1", "2024", "İ", "ﬁ"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) if rng.random() < 0.4 else rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert counter.count(text) == len(library.encode(text)), text


def test_a_vocabulary_string_out_of_reach_is_no_shortcut():
    scores = dict.fromkeys("abcd", 0.0) | {"ab": -2.0, "cd": -3.0, "bc": -1.0, "abcd": -4.0}
    counter = token_counts.Counter(scores, False).ready()
    assert "abcd" not in counter.whole and counter.count("abcd") == 3  # b and c come first, and a-bc is no piece
    counter = token_counts.Counter(scores | {"bc": -9.0}, False).ready()
    assert "abcd" in counter.whole and counter.count("abcd") == 1
    assert counter.count("abcdé\nab") == 1 + 2 + 1 + 1


def test_token_counts_of_every_kind_of_row(spark):
    library = SentencePieceProcessor(model_file=MODEL)
    texts = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "long " * 200_000), (6, "=-" * 50_000), (7, "x" * 100_000), (8, "<s> hi </s>"), (8, "<s> hi </s>"), (None, "naïve\r\nΣας"), (9, "\n" * 5000), (10, "word " * 4096), (11, ("word " * 4096).strip())]
    docs = spark.createDataFrame([(i, t, "z", 7, 7, 7, 7, 7) for i, t in texts], EXTRA).repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(token_counts.per_document(docs, MODEL)))
    size = lambda t: len(library.encode(t or ""))
    assert got == sorted((i or -1, len((t or "").encode()), size(t), size(t) > 4096) for i, t in texts)
    assert rows(token_counts.per_document(spark.createDataFrame([], EXTRA), MODEL)) == []
