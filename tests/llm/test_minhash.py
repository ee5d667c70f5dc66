"""Near-duplicates against a brute-force comparison of all sets."""

import random

import numpy as np

from gleaner.llm import minhash


def test_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(12)]
    texts = []
    for b in base:
        for k in range(14):
            t = list(b)
            for _ in range(k // 3):
                t[r.randrange(60)] = r.choice(words)
            texts.append(" ".join(t))
    texts += [None, "", " \t\n", "One two", "one TWO", "a b c d e", "A  B\nc d e", "x " * 5000, "É a b c d", "é a b c d"]
    rows = [(i, t, "extra", i) for i, t in enumerate(texts)] + [(None, texts[0], "extra", 0), (0, texts[0], "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, component_id long")
    got = {x.doc_id: x for x in minhash.near_duplicates(df).collect()}
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    for i in range(len(texts)):
        assert (got[i].component_id, got[i].n_shingles, got[i].kept) == (label[i], len(sets[i]), label[i] == i), texts[i]
    assert got[None].component_id is None and got[None].kept


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_doc_id_are_one_document(spark):
    a, b = ("one two three four five six seven", "ay bee see dee eee eff gee")
    rows = [(3, a), (5, a), (5, b), (4, b), (5, None), (6, ""), (7, "other words that stand here alone now"), (7, None), (5, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (5, 3, False), (4, 3, False), (6, 6, True), (7, 7, True), (7, 7, True)])


def test_blocks_find_what_pairs_find(spark):
    sets = {i: minhash.shingles(" ".join(str(k) for k in range(i, i + 40))) for i in range(10)}
    rows = spark.createDataFrame([(1, i, bytearray(s.tobytes()), i, 4, None) for i, s in sets.items()], "key long, doc long, held binary, c long, blocks int, first array<long>")
    found = {(r.a, r.b) for r in minhash.compare_groups(rows.drop("held"), rows.select("doc", "held"), 75).collect()}
    label = list(range(10))
    for _ in range(10):
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert label == [0] * 10


def test_one_rule_for_clusters_of_any_size(spark):
    """What is compared as a whole links the pairs that share a half, as halves do."""
    r = random.Random(9)
    sets = [minhash.shingles(" ".join(str(r.choice([k, k, k, k, k, -k])) for k in range(60))) for _ in range(60)]
    sets = [s for s in sets if len(s)] + [np.unique(np.concatenate([sets[0][:30], sets[1][:9]])), sets[0][:45]]
    firsts = [minhash._signed(minhash.half_keys(s)[0]).tolist() for s in sets]
    sets += [sets[0]]  # the same set, but no half in common
    firsts += [[-1 - k for k in range(minhash.HALVES)]]
    rows = [(1, i, bytearray(s.tobytes()), i, 1, f) for i, (s, f) in enumerate(zip(sets, firsts, strict=True))]
    halves = [(h + 7, i, bytearray(s.tobytes()), i, 1, None) for i, (s, f) in enumerate(zip(sets, firsts, strict=True)) for h in f]
    schema = "key long, doc long, held binary, c long, blocks int, first array<long>"

    def reached(rows):
        label = list(range(len(sets)))
        for _ in range(len(sets)):
            for x in found:
                label[x.a] = label[x.b] = min(label[x.a], label[x.b])
        return label

    out = []
    for some in (rows, halves):
        df = spark.createDataFrame(some, schema)
        found = minhash.compare_groups(df.drop("held"), df.select("doc", "held").dropDuplicates(["doc"]), 75).collect()
        out.append(reached(found))
    assert out[0] == out[1] and out[0][-1] == len(sets) - 1 and len(set(out[0])) < len(sets)


def test_large_clusters_by_halves(spark, monkeypatch):
    """Every cluster counts as large: only documents of one half are compared."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 2)
    test_against_brute_force(spark)


def test_hubs_and_long_texts(spark, monkeypatch):
    """A bucket's members that link with each other but not with its smallest,
    beside long texts; and components whose links meet in hubs."""
    from gleaner.llm import common

    monkeypatch.setattr(common, "HUB_SHARE", 3)
    words = [f"v{i}" for i in range(30000)]
    rows = [(i, " ".join(words)) for i in (1, 2)] + [(3, " ".join(words[: 29000]))]
    rows += [(100 + i, " ".join(words[i : i + 60])) for i in range(0, 300, 4)] + [(1000 + i, "the very same words in every row") for i in range(300)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[3] == 1
    assert {got[100 + i] for i in range(0, 300, 4)} == {100} and {got[1000 + i] for i in range(300)} == {1000}
    edges = spark.createDataFrame([(i, 0) for i in range(1, 200)] + [(i, 1000) for i in range(900, 1000)] + [(199, 900)], "a long, b long")
    assert {r.component for r in common.connected_components(edges).collect()} == {0}


def test_join_by_key_keeps_all_rows(spark):
    from pyspark.sql import functions as F

    from gleaner.llm import common

    rows = spark.range(9000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 97).alias("k"), "id")
    out = common.join_by_key(rows, rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", 9000)
    assert out.columns == ["k", "id", "n"] and out.count() == 9000 and out.where("k = 0").select("n").distinct().count() == 1
