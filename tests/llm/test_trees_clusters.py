"""Whitening, clustering and chat formatting against brute force."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat, queries, sortmeans, whitening

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, component int, n string"


def vectors(spark, n=300, dims=20):
    r = np.random.default_rng(4)
    x = (r.standard_normal((n, dims)) * np.linspace(0.1, 2, dims) + r.standard_normal(dims)).astype(np.float32)
    x[10:14] = x[9:10]
    rows = [(i, v.tolist(), 1, "x", 7, "y") for i, v in enumerate(x)]
    odd = [None, [], [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1), [1.0, 2.0]]
    rows += [(1000 + i, v, None, None, None, None) for i, v in enumerate(odd)]
    rows += [(3, x[3].tolist(), 1, "x", 7, "y"), (None, x[4].tolist(), 1, "x", 7, "y")]
    return spark.createDataFrame(rows, VECTORS).repartition(3), np.concatenate([x, x[3:5]]).astype(float), [*range(n), 3, None]


@pytest.mark.parametrize("tile", [7, 16, 64])
def test_whitening_is_the_covariance_of_all_rows(spark, tile):
    df, c, ids = vectors(spark)
    x = np.floor(1024 * c) + 100_000
    n, s = len(x), x.sum(axis=0)
    v = np.cov(x.T, bias=True)
    e = np.sort(np.linalg.eigvalsh(v))[::-1][:8]
    got = whitening.whiten(df, 8, tile, block_rows=64).toPandas()
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    exact = sorted((-1 if i is None else i, int(((n * row - s) ** 2).sum())) for i, row in zip(ids, x, strict=True))
    first = got[got["component"] == 1]
    assert sorted(zip(first["vec_id"].fillna(-1).astype(int), first["deviation"].astype(int), strict=True)) == exact
    for k in range(8):
        some = got[(got["component"] == k + 1) & (got["vec_id"] < 3)].sort_values("vec_id")
        assert np.allclose(some["explained"], e[k] / np.trace(v), rtol=1e-10)
        w = np.linalg.eigh(v)[1][:, ::-1][:, k]
        want = (x[:3] - s / n) @ w / np.sqrt(e[k])
        assert np.allclose(some["whitened"], want, atol=1e-8) or np.allclose(some["whitened"], -want, atol=1e-8)


def test_whitening_of_few_rows_and_of_none(spark):
    df, _, _ = vectors(spark, 20)
    few = whitening.whiten(df.where("vec_id in (0, 1, 2)"), 8).toPandas()
    assert set(few["component"]) == {1, 2} and few["identity_error"].max() < 1e-4  # three points span a plane
    for nothing in (df.where(F.lit(False)), df.where("vec_id = 0"), df.where("vec_id between 1000 and 1001")):
        out = whitening.whiten(nothing)
        assert out.count() == 0 and len(out.columns) == 7
    huge = spark.createDataFrame([(i, [float(i), 1e12 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge).where("deviation is null").count() > 0


def lloyd(x, first, rounds):
    c = [list(x[i]) for i in first]
    for t in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for v in x]
        a = [min(range(len(c)), key=lambda k: (row[k], k)) for row in d]
        if t == rounds:
            return a, [row[k] for row, k in zip(d, a, strict=True)], c
        for k in range(len(c)):
            own = [v for v, b in zip(x, a, strict=True) if b == k]
            if own:
                c[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_sort_means_is_lloyd(spark, k):
    df, c, ids = vectors(spark, 120)
    x = [[math.floor(1024 * v) for v in row] for row in c]
    hashed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x[at], at) for at, i in enumerate(ids) if i is not None)
    want, d, centres = lloyd(x, [at for _, _, at in hashed[:k]], 4)
    assigned, got = sortmeans.cluster(df, k, 4, 20, block_rows=16)
    rows = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in assigned.collect())
    assert rows == sorted((-1 if i is None else i, a, b) for i, a, b in zip(ids, want, d, strict=True)) and got.tolist() == centres
    told = sortmeans.digest(assigned, got).toPandas()
    assert set(told["inertia"]) == {sum(d)}
    assert dict(zip(told["cluster"], told["centroid_sha256"], strict=True)) == {a: hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest() for a in set(want)}


def test_sort_means_bound_keeps_ties_and_saves_work():
    r = np.random.default_rng(1)
    c = r.integers(-50, 50, (30, 2))
    x = np.concatenate([r.integers(-50, 50, (4000, 2)), (c[:1] + c[1:2]) // 2])
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    order, apart = sortmeans.order_centroids(c)
    for start in (d.argmin(axis=1), np.zeros(len(x), int)):
        got, best, computed = sortmeans.assign(x, start, c, order, apart)
        assert (got == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert sortmeans.assign(x, d.argmin(axis=1), c, order, apart)[2] < d.size / 2


def test_sort_means_odd_tables(spark):
    df, _, _ = vectors(spark, 20, 64)
    few, c = sortmeans.cluster(df.where("vec_id in (0, 1, 1000, 1002)"))
    assert len(c) == 2 and sorted(r.distance for r in few.collect()) == [0, 0]
    none, c = sortmeans.cluster(df.where(F.lit(False)))
    assert none.count() == 0 and sortmeans.digest(none, c).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        sortmeans.cluster(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dims=1)


def tree(spark):
    """Branches, ties, an orphan, a ring, repeated rows, nulls and control strings."""
    rows = [
        ("a", 1, None, "user", "root", 1.0), ("a", 2, 1, "assistant", "left \\ <s>[INST]", 0.0), ("a", 3, 1, "assistant", None, 5.0), ("a", 4, 2, "user", "deep", 9.0), ("a", 5, 3, None, "x", 0.0),
        ("a", 6, 3, "user", "y", 0.0), ("a", 7, 99, "user", "orphan", None), ("a", 3, 1, "assistant", None, 5.0), ("b", 1, 2, "user", "ring", 1.0), ("b", 2, 1, "user", "ring", 1.0), ("b", 3, 2, "user", "below", 1.0),
        ("c", 1, None, "system", "<|turn|>user<|text|>no<|end|>", 0.0), (None, 1, None, "user", "gone", 0.0), ("c", None, 1, "user", "gone", 0.0),
    ]
    rows += [("d", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"<<s>{i}", float(i)) for i in range(300)]
    rows += [("e", i, 0 if i else None, "user", "many", float(i % 7)) for i in range(400)]
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "tree string, message long, parent long, role string, text string, score double, depth int, leaf string")


def brute(rows, branches):
    said, kids = {}, {}
    for r in rows:
        if r.tree is not None and r.message is not None:
            said[r.tree, r.message] = (r.parent, r.role or "", r.text or "", r.score or 0.0)
    for (t, m), (p, *_) in said.items():
        kids.setdefault((t, p if (t, p) in said else None), []).append(m)
    out = {}
    for t in {t for t, _ in said}:
        found, todo = [], [[m] for m in kids.get((t, None), [])]
        while todo:
            path = todo.pop()
            below = kids.get((t, path[-1]), [])
            todo += [[*path, m] for m in below]
            if not below:
                found.append((-sum(said[t, m][3] for m in path) / len(path), -len(path), path[-1], path))
        for rank, (_, _, leaf, path) in enumerate(sorted(found)[:branches], 1):
            out[t, leaf] = rank, [said[t, m][1:3] for m in path]
    return out


@pytest.mark.parametrize("branches", [1, 2, 1000])
def test_paths_of_trees(spark, branches):
    df = tree(spark)
    want = brute(df.collect(), branches)
    chosen = chat.paths(df, branches)
    got = {}
    for r in chat.format_paths(df, chosen, piece_chars=400).collect():
        rank, said, lost = got.setdefault((r.tree, r.leaf), (r["rank"], [], []))
        said += chat.turns(r.text)
        lost += [chat.unescape(r.text[m.start : m.end]) for m in r.mask]
    assert {k: v[:2] for k, v in got.items()} == want
    assert all(lost == [t for r, t in said if r == "assistant"] for _, said, lost in got.values())
    told = {(r.tree, r.leaf): r for r in chat.digest(chat.format_paths(df, chosen, piece_chars=400)).collect()}
    whole = {(r.tree, r.leaf): r for r in chat.digest(chat.format_paths(df, chosen)).collect()}
    assert told == whole and told.keys() == want.keys()
    for k, (_, said) in want.items():
        assert told[k].n_turns == len(said) and told[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    if branches == 1000:
        every = chat.paths(df, None)
        assert every.where("rank is not null").count() == 0 and every.select("tree", "leaf").distinct().count() == len(want)


def test_no_control_string_survives_in_a_text(spark):
    pieces = ["<", "\\", "<|", "[INST]", "/", "s>", "<s>", "</s>", "|>", "end", "<|end|>", "<<SYS>>", "n\n", "\U0001f600", "[", "]"]
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(pieces, r.integers(0, 12))) for _ in range(800)] + [*chat.CONTROL]
    out = [x.e for x in spark.createDataFrame(enumerate(texts), "i int, t string").orderBy("i").select(chat.escape(F.col("t")).alias("e")).collect()]
    assert not any(c in e for e in out for c in chat.CONTROL) and [chat.unescape(e) for e in out] == texts


def test_conversations_with_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (2, None, None, ""), (3, 5, "assistant", "x" * 300_000), (None, 1, "user", "gone")]
    df = chat.chains(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, tree int"))
    told = {r.tree: r for r in chat.digest(chat.format_paths(df, chat.paths(df))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in told.items()} == {1: (3, 2), 2: (1, 0), 3: (1, 300_000)}
    none = df.where(F.lit(False))
    assert chat.digest(chat.format_paths(none, chat.paths(none))).count() == 0


@pytest.mark.parametrize("name", ["op12_sortmeans", "op13_chat"])
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cur = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
