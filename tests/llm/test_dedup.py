import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from vigil.llm import exact_dedup, near_dedup, repeats
from vigil.llm.graph import components


def test_fuse_filter_holds_every_key_and_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(-2 ** 63, 2 ** 63, n, dtype=np.int64)
        made = exact_dedup.FuseFilter.build(keys)
        assert made.holds(keys).all()
        other = rng.integers(-2 ** 63, 2 ** 63, 50_000, dtype=np.int64)
        if n:
            assert made.holds(other).mean() < 0.02
        if n >= 1000:
            assert len(made.slots) < 1.6 * n


def test_exact_copies_match_brute_force(clean, clean_rows):
    got = {r["doc_id"]: r for r in exact_dedup.mark_copies(clean, carry=["doc_id"]).collect()}
    groups: dict = {}
    for r in clean_rows:
        groups.setdefault(brute.stripped(r[1]), []).append((-len(r[1] or ""), r[0]))
    assert len(got) == len(clean_rows)
    for body, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert got[i]["keep_id"] == keep and got[i]["group_size"] == len(members)
            assert got[i]["kept"] == (i == keep)
            assert got[i]["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()


def test_exact_any_snapshot_gives_the_same_groups(clean):
    want = None
    for split in (F.lit(True), F.lit(False), F.col("doc_id") < 30):
        rows = sorted(map(tuple, exact_dedup.mark_copies(clean, carry=["doc_id"], in_snapshot=split).collect()))
        assert want is None or rows == want
        want = rows


def test_exact_edges(documents, none):
    out = exact_dedup.mark_copies(documents.withColumns({"kept": F.lit(1), "x_row": F.lit(2), "KEEP_ID": F.lit(3)}))
    assert out.columns[-4:] == ["keep_id_", "group_size", "kept_", "text_sha256"]
    by = out.groupBy("text_sha256").agg(F.sum(F.col("kept_").cast("int")).alias("n"), F.count("*").alias("c"),
                                        F.max("group_size").alias("g")).collect()
    assert all(r["n"] == 1 and r["c"] == r["g"] for r in by)
    left = exact_dedup.drop_copies(documents)
    assert left.columns == documents.columns and left.where("doc_id IS NULL").isEmpty()
    assert exact_dedup.mark_copies(none).isEmpty()


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 150)] + [(300, 300), (250, 249)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150))
    assert got[250] == got[249] == 249
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_near_matches_brute_force_for_two_widths(clean, clean_rows):
    texts = {r[0]: r[1] for r in clean_rows}
    for width in (2, 5):
        want = brute.components(texts, width, 80)
        got = {r["doc_id"]: r for r in near_dedup.mark_near(clean, carry=["doc_id"], width=width).collect()}
        assert {k: r["component_id"] for k, r in got.items()} == want
        assert {k: r["n_shingles"] for k, r in got.items()} == {
            k: len(brute.shingles(t, width)) for k, t in texts.items()}
        assert all(r["kept"] == (k == r["component_id"]) == r["first_row"] for k, r in got.items())
        if width == 2:
            assert len(set(want.values())) < len(want) - 8


def test_near_links_of_small_sets_are_never_missed(spark):
    rng = random.Random(3)
    texts = {}
    for i in range(120):  # few different words: every list is long
        texts[i] = " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.mark_near(docs).collect()}
    assert got == brute.components(texts, 2, 80)


def test_near_nodes_meet_big_components_in_blocks(spark, monkeypatch):
    """Many variants of one text, some linked to the typical one, some only to
    others, some to none."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 5, 8, 11, 13])):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", "z", f"q{rng.randrange(30)}"])
        texts[i] = " ".join(w)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.mark_near(docs).collect()}
    assert got == brute.components(texts, 2, 80)


def test_near_long_lists_give_the_same_links(spark, monkeypatch):
    """Texts around one passage: everyone shares its lists, few are similar
    enough; short and long lists, whole and in small blocks, agree with pairs."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(90)]
    texts = {}
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(rng.choice([10, 30, 60]))]
        texts[i] = " ".join(own[:5] + passage + own[5:])
    for i in range(60, 90):  # pairs of near copies of these
        w = texts[i - 60].split()
        w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.components(texts, 2, 80)
    monkeypatch.setattr(near_dedup, "BIG", 1000)  # no component is big: lists decide
    for short, block in ((1000, 256), (2, 16)):
        monkeypatch.setattr(near_dedup, "SHORT", short)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.mark_near(docs).collect()} == want


def test_bounds_come_from_the_threshold():
    """What linked sets share, against drawn sets at the threshold."""
    assert near_dedup.safe_overlap(64, 0.8) == 28 and near_dedup.safe_neighbours(64, 0.8) == 8
    assert near_dedup.safe_neighbours(64, 0.5) == 0 < near_dedup.safe_overlap(64, 0.5)
    rng = np.random.default_rng(1)
    draws = rng.random((20_000, 64)) < 0.8
    assert (draws[:, 1:] & draws[:, :-1]).sum(axis=1).min() >= 8 and draws.sum(axis=1).min() >= 28


def test_near_edges(documents, none):
    out = near_dedup.mark_near(documents.withColumn("kept", F.lit(1)).withColumn("x_set", F.lit(2))).cache()
    assert out.count() == documents.count() and "kept_" in out.columns
    assert out.where("text IS NULL").select("n_shingles").first()[0] == 0
    left = near_dedup.drop_near(documents, width=2)
    ids = [r["doc_id"] for r in left.collect()]
    assert None not in ids and len(ids) == len(set(ids)) and left.columns == documents.columns
    assert near_dedup.mark_near(none).isEmpty()


def test_sorted_columns_give_transform_and_prefixes():
    rng = random.Random(1)
    for _ in range(80):
        strings = [bytes(rng.choice(b"ab\x00\xf4") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 7))]
        bwt, lcp = repeats.sort_columns(strings)
        suffixes = sorted(((s[p:], s[p - 1] + 1 if p else 0) for s in strings for p in range(len(s) + 1)),
                          key=lambda x: x[0])
        common = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                        for (a, _), (b, _) in zip(suffixes, suffixes[1:])]
        assert lcp.tolist() == common
        assert sorted(bwt.tolist()) == sorted(c for _, c in suffixes)


def test_repeats_match_brute_force(spark, clean, clean_rows):
    for window in (60, 200):
        got = {r["doc_id"]: r for r in repeats.remove_repeats(clean, carry=["doc_id"], window=window).collect()}
        want = brute.removed([(r[1] or "").encode() for r in clean_rows], window)
        for r, w in zip(clean_rows, want):
            g = got[r[0]]
            assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == w, r[0]


def test_repeats_of_very_many_strings_are_counted_alike(clean, monkeypatch):
    want = sorted(map(tuple, repeats.remove_repeats(clean, carry=["doc_id"]).collect()))
    monkeypatch.setattr(repeats, "HOT", 1)  # every mixed anchor takes the counting way
    assert sorted(map(tuple, repeats.remove_repeats(clean, carry=["doc_id"]).collect())) == want


def test_repeats_edges(documents, none):
    out = repeats.remove_repeats(documents.withColumn("n_bytes", F.lit(1)), keep_text=True).cache()
    assert out.count() == documents.count() and "n_bytes_" in out.columns
    for r in out.collect():
        assert hashlib.sha256(bytes(r["kept_bytes"])).hexdigest() == r["kept_sha256"]
        assert r["n_bytes_"] == r["n_removed"] + len(r["kept_bytes"])
    assert repeats.remove_repeats(none).isEmpty()


def test_estimate_keeps_what_the_lists_promise(spark):
    """Equal texts whose made-up sketches agree in 28, 35 or 27 of the 64 least
    values of their union: only fewer than NEED are dropped before the sets."""
    text = " ".join(f"w{i}" for i in range(100)).encode()
    nodes, pairs = [], []
    for n, common in enumerate((28, 35, 27)):
        for side in (0, 1):
            own = [100 + 2 * i + side for i in range(64 - common)]
            nodes.append((2 * n + side, 99, list(range(common)) + own))
        pairs.append((2 * n, 2 * n + 1))
    got = near_dedup.confirm(
        spark.createDataFrame(pairs, "a long, b long"),
        spark.createDataFrame(nodes, "node long, x_size long, x_sketch array<long>"),
        spark.createDataFrame([(r[0], bytearray(text)) for r in nodes], "node long, x_text binary"),
        2, near_dedup.K, 80)
    assert sorted(map(tuple, got.collect())) == pairs[:2]
