import duckdb
import numpy as np
import pytest

from fieldgrid.llm import queries, search


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")


def brute_top(rows, every, k, value):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            scored = sorted(((-value(v, w), i) for i, w in rows.items() if i != q and len(w) == len(v)))[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def vectors(seed=1, n=300, d=12):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)).astype(np.float32)
    v[50:90] = v[50]  # a common vector
    v[120:130, 0] = 0
    return v


@pytest.mark.parametrize("shard,tile", [(8192, 1024), (10, 3)])
def test_exact_top_k_is_brute_force(spark, shard, tile):
    v = vectors()
    rows = {i: [int(np.floor(256 * float(x))) for x in v[i]] for i in range(len(v))}
    want = brute_top(rows, 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b)))
    bad = [(1000, None, "x"), (1050, [1.0] * 11 + [None], "x"), (1100, [float("nan")] * 12, "x"), (1150, [float("inf")] + [0.0] * 11, "x"), (None, [1.0] * 12, "x"), (1200, [], "x")]
    df = frame(spark, [(i, x.tolist(), "r") for i, x in enumerate(v)] + bad).repartition(4)
    got = {}
    for r in search.exact_top_k(df, 50, 5, shard=shard, tile=tile).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == want


def test_exact_scores_beyond_doubles(spark):
    big = [(0, [5e6, 1.0]), (50, [5e6, 2.0]), (51, [-5e6, 5.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in big}
    want = brute_top(ints, 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b)))
    got = {}
    for r in search.exact_top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == want


def test_repeated_ids_other_lengths_and_empty_tables(spark):
    df = frame(spark, [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (1, [1.0, 0.0, 0.0], "b"), (2, [0.5, 0.0], "c")])
    assert [tuple(r) for r in search.exact_top_k(df).collect()] == [(0, 1, 2, 256 * 128)]
    assert [tuple(r)[:3] for r in search.nearest(df).collect()] == [(0, 1, 2)]
    assert search.exact_top_k(df.limit(0)).collect() == [] and search.nearest(df.limit(0)).collect() == []


def test_sql_agrees(spark, tmp_path):
    v = vectors(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    con = duckdb.connect()
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(queries.SQL["op8_exact_top_k"]).fetchall()
    got = queries.op8_exact_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_nearest_scores_ties_and_recall(spark, chunk):
    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 32))
    v = (centres[r.integers(0, 20, 900)] + r.normal(size=(900, 32))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:140] = v[100]
    v[500] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for x in search.nearest(df, chunk=chunk).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    d, hit, total = v.astype(float), 0, 0
    assert set(got) == {i for i in range(0, 900, 20) if i != 500}
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[1] not in (q, 500) for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(f[2] - d[q] @ d[f[1]]) < 1e-12 for f in found)
        score = d @ d[q]
        score[[q, 500]] = -9
        best = np.lexsort((np.arange(900), -score))[:20]
        hit, total = hit + len({f[1] for f in found} & set(best.tolist())), total + 20
    assert hit / total >= 0.95
    assert [f[1] for f in got[100]] == list(range(101, 121))  # equal vectors: the smallest ids


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(search._hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    both = search.rotated(x, 0, 0)
    assert np.allclose(np.linalg.norm(both[:, :16], axis=1), np.linalg.norm(x, axis=1))
    for turns in (1, 2, 3):
        own, asked = search.code(x, 1, turns), search.probed(x, 1, turns, 40)
        assert all(c in a for c, a in zip(own, asked.tolist())) and all(len(set(a)) == min(40, 32**turns) for a in asked.tolist())
    assert [search.turns_for(n, 64) for n in (1, 500, 16_383, 16_384, 2_097_151, 2_097_152)] == [1, 1, 1, 2, 2, 3]


def recall_of(spark, v, **more):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for x in search.nearest(df, **more).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    d = v.astype(float)
    asked = range(0, len(v), 20)
    assert set(got) == set(asked) and all(len(x) == 20 for x in got.values())
    hit = 0
    for q in asked:
        score = d @ d[q]
        score[q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(len(v)), -score))[:20].tolist()))
    return hit / (20 * len(asked))


def test_recall_of_vectors_of_unequal_length(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(2000, 64))
    v *= r.lognormal(size=(2000, 1)) / np.linalg.norm(v, axis=1, keepdims=True)
    assert recall_of(spark, v.astype(np.float32)) >= 0.95


def test_recall_with_more_than_one_turn(spark, monkeypatch):
    monkeypatch.setattr(search, "turns_for", lambda rows, dim: 2)
    monkeypatch.setattr(search, "ASK", 0)  # only rows compared count, so two turns (256 buckets) win
    r = np.random.default_rng(7)
    v = r.normal(size=(1500, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    plans = []
    monkeypatch.setattr(search, "plan_for", lambda *a, plan=search.plan_for: plans.append(plan(*a)) or plans[-1])
    assert recall_of(spark, v, chunk=50) >= 0.9
    assert [turns for turns, _ in plans] == [2]


@pytest.mark.parametrize("turns", [1, 2, 3])
def test_probes_needed_are_the_places_of_buckets(monkeypatch, turns):
    monkeypatch.setattr(search, "HEADS", 64)  # of three turns of 16 axes, one is a head
    r = np.random.default_rng(turns)
    q, c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in r.normal(size=(2, 12, 8)))
    c = (q + c) / np.linalg.norm(q + c, axis=1, keepdims=True)
    codes = np.stack([search.code(c, t, turns) for t in range(3)], axis=1)
    needed = search.probes_needed(q, np.arange(12), codes, turns)

    def met(i, probes):
        return any(codes[i, t] in search.probed(q[i : i + 1], t, turns, probes)[0] for t in range(3)) if probes else False

    assert all(met(i, p) and not met(i, p - 1) for i, p in enumerate(needed.tolist()))


def neighbours(rows, seed, asked=64, k=20, d=64):
    """Queries and rows at the cosines that the k nearest of so many even vectors have."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    q, w = unit(r.normal(size=(asked, d))), r.normal(size=(asked, k, d))
    w = unit(w - (w * q[:, None]).sum(-1, keepdims=True) * q[:, None])
    t = np.sqrt(1 - (np.arange(1, k + 1) * d / rows) ** (2 / (d - 1)))  # tail of the cosine, roughly
    return q, np.repeat(np.arange(asked), k), (t[None, :, None] * q[:, None] + np.sqrt(1 - t**2)[None, :, None] * w).reshape(-1, d)


def test_recall_and_work_where_another_turn_comes_in():
    work = {}
    for rows in (16_383, 16_384, 100_000, 2_097_151, 2_097_152):
        most = search.turns_for(rows, 64)
        q, who, c = neighbours(rows, 1)
        codes = np.stack([search.code(c, t, most) for t in range(10)], axis=1)
        turns, probes = search.plan_for(q, who, codes, rows, most)
        q, who, c = neighbours(rows, 2)
        codes = np.stack([search.code(c, t, turns) for t in range(10)], axis=1)
        recall = (search.probes_needed(q, who, codes, turns) <= probes).mean()
        assert recall >= 0.9, (rows, turns, probes, recall)
        work[rows] = probes * (rows / 128**turns + search.ASK)
    assert work[16_384] <= 1.1 * work[16_383] and work[2_097_152] <= 1.1 * work[2_097_151]
    assert work[2_097_152] / 2_097_152 < 0.8 * work[100_000] / 100_000  # a smaller share of more rows


def test_few_rows_give_all(spark):
    v = np.eye(12, dtype=np.float32)
    df = spark.createDataFrame([(i, (x * (-1) ** i).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in search.nearest(df).orderBy("rank").collect()] == [(k, k, 0.0) for k in range(1, 12)]


def test_all_ids_are_queries(spark, monkeypatch):
    v = vectors(5, 120, 6)
    rows = {50 * i: [int(np.floor(256 * float(x))) for x in v[i]] for i in range(len(v))}
    monkeypatch.setattr(search, "STRIPE", 7)
    df = frame(spark, [(50 * i, x.tolist(), "r") for i, x in enumerate(v)])
    got = {}
    for r in search.exact_top_k(df, 50, 5, shard=30, tile=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute_top(rows, 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b)))


def test_components_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e20, 1.0]), (50, [1e20, 2.0]), (51, [-1e20, 5.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.exact_top_k(df).collect()}
    assert got == {(0, 1): (50, 2**63 - 1), (0, 2): (51, -(2**63)), (50, 1): (0, 2**63 - 1), (50, 2): (51, -(2**63))}


def clamped(q, c):
    return [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b)))) for b in c] for a in q]


@pytest.mark.parametrize("bits", [27, 32, 40, 63])
def test_tile_scores_are_exact_integers(monkeypatch, bits):
    assert search._tile_scores(np.array([[2.0**31 + 1, 3]]), np.array([[2.0**31 + 3, 1]])).tolist() == [[4611686027017322502]]
    monkeypatch.setattr(search, "COLUMNS", 5)
    r = np.random.default_rng(bits)
    for d in (1, 3, 64, 700):
        q, c = (np.floor(r.uniform(-1, 1, (n, d)) * 2.0**bits) // 2 * 2 + (bits < 53) for n in (7, 12))
        c[3], q[2] = -(2.0**63), -(2.0**63)
        assert search._tile_scores(q, c).tolist() == clamped(q, c)
        mixed = search._integers(np.vstack([q, np.full((1, d), 1e306), np.full((1, d), -1e19)]), 256.0)
        assert mixed.dtype == object
        assert search._tile_scores(mixed, c).tolist() == clamped(mixed, c) and search._tile_scores(c, mixed).tolist() == clamped(c, mixed)


def test_limbs_at_the_edge_of_64_bits():
    q = np.array([[2.0**62, 1.0], [-(2.0**62), 1.0], [2.0**61, 2.0**53]])
    c = np.array([[2.0, -1.0], [2.0, 0.0], [-2.0, -1.0], [4.0, -1.0], [1.0, 1.0], [3.0, 2.0**9]])
    got = search._limb_scores(q, c)
    assert got.tolist() == clamped(q, c)
    assert search._best(np.array([[-(2**63), 2**63 - 1, 0, 2**63 - 1]]), 3).tolist() == [[1, 3, 2]]


def test_large_odd_components_in_query_and_sql(spark, tmp_path):
    r = np.random.default_rng(9)
    v = (r.integers(2**30, 2**31, size=(120, 6)) * 2 + 1) / 256 * r.choice([-1, 1], size=(120, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {}
    for x in queries.op8_exact_top_k(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    ints = {i: [int(256 * float(x)) for x in row] for i, row in enumerate(v)}
    assert got == brute_top(ints, 50, 5, lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))))
    assert sorted((q, *x) for q, rows in got.items() for x in rows) == sorted(con.sql(queries.SQL["op8_exact_top_k"]).fetchall())


def test_a_component_beyond_doubles_once_scaled(spark):
    df = spark.createDataFrame([(0, [1e306, 1.0]), (50, [1.0, 2.0]), (51, [-1e306, 5.0]), (52, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.exact_top_k(df).collect()}
    assert got == {(0, 1): (50, 2**63 - 1), (0, 2): (52, 2**63 - 1), (0, 3): (51, -(2**63)), (50, 1): (0, 2**63 - 1), (50, 2): (52, 2 * 65536), (50, 3): (51, -(2**63))}
