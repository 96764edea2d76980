"""Toxicity, hard negatives and the prefix trie against plain versions."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.llm import hard_negatives, prefix_trie, toxicity

# Toxicity ------------------------------------------------------------------


def subsequences(word: str, alphabet: toxicity.Alphabet) -> dict:
    known = {chr(c): i + 2 for i, c in enumerate(alphabet.known.tolist())}
    s = [1, *(known.get(c, 0) for c in word), 1]
    out: dict = {}
    for i, j, k in itertools.combinations(range(len(s)), 3):
        if k - i < toxicity.SPAN:
            key = (s[i], s[j], s[k])
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def kernel(a: str, b: str, alphabet: toxicity.Alphabet) -> float:
    x, y = subsequences(a, alphabet), subsequences(b, alphabet)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_matches_enumerated_subsequences():
    words = ["idiot", "idxiot", "i.d.i.o.t", "banana", "aaaaaaa", "été", "ab", "z", "日本語です", "mississippi"]
    alphabet = toxicity.Alphabet.of(words[:6])
    marks = toxicity.Landmarks(words[:4], alphabet)
    got = marks.kernels(*toxicity._window(words))
    want = [[kernel(a, b, alphabet) for b in words[:4]] for a in words]
    assert np.allclose(got, want, atol=1e-5)
    assert got[1, 0] > 0.3 > got[3, 0]  # an inserted letter keeps most, another word little


def test_machine_of_single_weights_equals_its_landmarks():
    rng = random.Random(3)
    toxic = ["idiot", "stupid", "scum"]
    clean = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    alphabet = toxicity.Alphabet.of(toxic + clean)
    made = toxicity._fit(alphabet, toxic, np.array([20.0, 10.0, 5.0]), clean, np.ones(300))
    d = dict(zip(toxic + clean, made.decisions(toxic + clean)))
    assert min(d[w] for w in toxic) > 0.5 > max(d[w] for w in clean)
    tolerant = made.decisions(["i-d-i-o-t", "idiiot", "stupidd", "table", ""])
    assert min(tolerant[:3]) > 0 > tolerant[3] >= tolerant[4] == toxicity.WORST
    long = "x" * 5000 + "idiot" + "y" * 5000
    assert made.decisions([long])[0] > made.decisions(["x" * 10_005])[0]


def test_words_and_sentences():
    words = toxicity.Words(pa.array(["You, i d i o t! Go", None, "", "a b. c"]))
    seen = [(t, words.strings[w]) for t, w in zip(words.text, words.word)]
    assert (0, "idiot") in seen and [t for t, _ in seen] == sorted(t for t, _ in seen)
    assert len({s for s, t in zip(words.sentences(), words.text) if t == 3}) == 2
    many = toxicity.Words(pa.array(["w " * 1000]))
    assert np.bincount(many.sentences()).max() <= toxicity.SENTENCE_WORDS


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(11)
    plain = ["".join(rng.choice(["on", "the", "re", "an", "st", "ti", "ou"]) for _ in range(rng.randint(1, 4)))
             for _ in range(400)]
    bad = ["zagwomp", "krelkud", "vixbok"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            b = rng.choice(bad)
            w[rng.randrange(len(w))] = b if rng.random() < 0.8 else b[:3] + rng.choice("xq.-") + b[3:]
        rows.append((i, " ".join(x + "." if rng.random() < 0.1 else x for x in w)))
        if i % 3 != 2:
            labels.append((i, int(toxic)))
    rows += [(None, "you zagwomp krelkud"), (5000, ""), (5001, None), (5002, "the on " * 20_000 + "zagwomp vixbok."),
             (3, rows[3][1]), (3, rows[3][1])]
    labels += [(None, 1), (7, 1), (7, 0), (8, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), \
        spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_and_odd_rows(spark, insults):
    docs, labels = insults
    scorer = toxicity.learn(docs, labels)
    odd = docs.withColumns({"score": F.lit("s"), "Held_Out": F.lit(1)})
    out = toxicity.score_texts(odd, scorer).toPandas()
    assert list(out.columns) == ["doc_id", "text", "score", "Held_Out", "held_out_", "score_", "predicted"]
    assert len(out) == docs.count() and out["score_"].between(0, 1).all()
    assert ((out["score_"] >= 0.7) == (out["predicted"] == 1)).all()
    for i, h in zip(out["doc_id"], out["held_out_"]):
        assert h == (i == i and zlib.crc32(str(int(i)).encode()) % 3 == 1)
    some = out[(out["doc_id"] < 900) & out["held_out_"]]
    right = (some["predicted"] == (some["doc_id"] % 6 == 0)).mean()
    assert right > 0.97
    by = out.groupby("doc_id")["score_"]
    assert by.nunique().max() == 1
    low = out["score_"].min()
    assert by.first()[5000.0] == by.first()[5001.0] == low
    assert toxicity.score_texts(docs.limit(0), scorer).isEmpty()


def test_without_labels_of_both_kinds_the_share(spark, insults):
    docs, labels = insults
    none = toxicity.learn(docs, labels.limit(0))
    assert none.scores(pa.array(["a", None])).tolist() == [0.5, 0.5]
    clean = toxicity.learn(docs, labels.where("toxic = 0"))
    assert clean.machine is None and clean.share < 0.01


# Hard negatives ------------------------------------------------------------


def brute_negatives(rows, k=5, low=80):
    sound: dict = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.setdefault(i, []).append((label, [math.floor(256 * x) for x in v]))
    out = []
    for a, versions in sound.items():
        if a % 10:
            continue
        label, q = min(versions)
        same: dict = {}
        other: dict = {}
        for i, those in sound.items():
            for l2, v in those:
                if i != a and len(v) == len(q):
                    s = sum(x * y for x, y in zip(q, v))
                    part = same if l2 == label else other
                    part[i] = max(part.get(i, s), s)
        for p, ps in sorted(same.items(), key=lambda x: (-x[1], x[0]))[:k]:
            near = [(i, s) for i, s in other.items() if low * ps <= 100 * s <= 100 * ps]
            for r, (i, s) in enumerate(sorted(near, key=lambda x: (-x[1], x[0]))[:k], 1):
                out.append((a, p, r, i, ps, s))
    return sorted(out)


@pytest.mark.parametrize("block, cells", [(4096, 1 << 20), (3, 64)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CELLS", cells)
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [round(rng.gauss(0.2, 0.4), 1) for _ in range(4)]) for i in range(240)]
    rows += [(300, 0, [1.0, 1.0]), (301, 0, [1.0, 1.0]), (302, 1, [1.0, 0.9]), (303, 1, [0.5, 0.5]),
             (310, None, [1.0] * 4), (320, 1, None), (330, 1, [1.0, None, 1.0, 1.0]), (340, 1, [1.0, float("nan"), 1.0, 1.0]),
             (350, 1, [float("inf")] * 4), (None, 1, [1.0] * 4), (360, 0, []), (361, 0, []), (362, 1, []),
             (20, rows[20][1], rows[20][2]), (33, (rows[33][1] + 1) % 3, rows[33][2])]
    rows += [(400 + i, 1, [0.5] * 4) for i in range(60)]  # one vector, many times
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    got = hard_negatives.mine(table.withColumn("rank", F.lit(0)), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).isEmpty()


def test_large_components_stay_exact(spark):
    rows = [(0, 0, [500_000.0, 3.0]), (1, 0, [400_000.0, 7.0]), (2, 1, [400_000.0, 6.99]), (3, 1, [1e6, 1.0])]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"),
                              F.col("vec_id") == 0).collect()
    want = sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(rows[0][2], rows[2][2]))
    assert [(r["negative_id"], r["negative_score"]) for r in got] == [(2, want)]


# Prefix trie ---------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(rows, branch=True):
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if branch else 0
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    nodes: dict = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        d = len(path)
        below = [p for p in nodes if p[:d] == path]
        kids = [p for p in below if len(p) == d + 1]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in below)]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == d)
        out.append((min(members), d, min(nodes[path[:-1]]) if d else None, len(members), len(kids), len(leaves),
                    saved, sha(ends)))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "tool"]), rng.choice(["hi", "yes", "no", "ünï 🙂", ""])))
    for c in range(100, 160):  # copies of one conversation
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    rows += [(200, None, None, None), (200, 1, "user", "x"), (201, 1, "user", "x"), (201, 1, "user", "x"),
             (201, 1, "user", "y"), (None, 0, "user", "lost"), (207, 0, "user", "short"), (-3, 0, "user", "hi")]
    rows += [(300, t, "user", "long") for t in range(400)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [1 << 16, 16])
def test_trie_matches_brute_force(spark, monkeypatch, block):
    """A sketch of one counter a row proves nothing single: everything is grouped exactly."""
    monkeypatch.setattr(prefix_trie, "CELLS_A_BLOCK", block)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", block)
    rows = conversations()
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).repartition(4)
    marks = prefix_trie.turn_marks(turns)
    got = prefix_trie.trie(*prefix_trie.branched(marks)).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)
    plain = prefix_trie.trie(*prefix_trie.whole(marks.where("conv < 300"))).collect()
    assert sorted(map(tuple, plain), key=str) == brute_trie([r for r in rows if r[0] is None or r[0] < 300], False)


def test_trie_of_nothing_and_of_one(spark):
    def made(rows):
        return [tuple(r) for r in prefix_trie.trie(*prefix_trie.whole(prefix_trie.turn_marks(
            spark.createDataFrame(rows, SCHEMA)))).collect()]

    assert made([]) == []
    assert sorted(made([(5, 0, "user", "abc")]), key=str) == sorted(
        [(5, 0, None, 1, 1, 1, 0, sha("")), (5, 1, 5, 1, 0, 1, 0, sha("5"))], key=str)


def test_sketch_never_counts_too_few(spark):
    marks = prefix_trie.turn_marks(spark.createDataFrame(conversations(), SCHEMA))
    rows = prefix_trie.screened(prefix_trie.whole(marks)[0]).toPandas()
    members = rows.groupby("digest")["conv"].nunique()
    assert (members[rows.loc[rows["single"], "digest"]] == 1).all() and rows["single"].sum() > 100
    assert (rows[rows["first"]].groupby("conv").size() == 1).all()
