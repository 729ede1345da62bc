"""Vector codes and whitening against plain computations."""

import math

import duckdb
import numpy as np
import pytest

from goodsledger.llm import vector_codes, whitening

FIELDS = "vec_id long, embedding array<float>, label int, x string, near string, _id string, place string, n string"


def vector_rows(n=300, dims=32, seed=3):
    random = np.random.default_rng(seed)
    values = random.normal(scale=0.3, size=(n, dims)).astype(np.float32)
    values[n // 2 : n // 2 + 40] = values[0]
    rows = [(i, [float(c) for c in v], None if i % 7 == 0 else i % 3) for i, v in enumerate(values)]
    bad = [(900, None, 1), (901, [float("nan")] * dims, 1), (902, [None] * dims, None), (903, [math.inf] * dims, 0), (904, [], 0)]
    odd = [(None, rows[1][1], 2), (5, rows[5][1], 2), (905, [0.5] * (dims // 2), 2)]
    return rows, [(*r, *"ccccc") for r in rows + bad + odd]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows()[1], FIELDS).repartition(5)


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and books by measuring everything; rows are (id, vector, label) in order of id."""
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows], dtype=object).reshape(len(rows), parts, -1)
    books = [[list(x[e, p]) for e in range(min(entries, len(rows)))] for p in range(parts)]
    for step in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in x]
        if step < rounds:
            for p in range(parts):
                for i in range(len(books[p])):
                    own = [x[r, p] for r in range(len(rows)) if near[r][p][1] == i]
                    if own:
                        books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [("".join(f"{i:02x}" for _, i in n), sum(d for d, _ in n)) for n in near], np.array(books, dtype=np.int64)


def test_vector_codes_match_a_full_search(vectors):
    rows, _ = vector_rows()
    rows = sorted([*rows, (5, rows[5][1], 2)], key=lambda r: r[0]) + [(None, rows[1][1], 2)]
    want, books = slow_codes(rows)
    sums = {}
    for (_, _, label), (_, error) in zip(rows, want, strict=True):
        sums[label] = sums.get(label, 0) + error
    digest = vector_codes.codebook_digest(books)
    wanted = sorted(((i, c, e, sums[label], digest) for (i, _, label), (c, e) in zip(rows, want, strict=True)), key=repr)
    for near in (1, 3, 8, 64):
        got = vector_codes.vector_codes(vectors, near=near).collect()
        assert sorted(map(tuple, got), key=repr) == wanted, near


def test_few_rounds_and_more_rounds(vectors):
    rows, _ = vector_rows()
    rows = sorted([*rows, (5, rows[5][1], 2)], key=lambda r: r[0]) + [(None, rows[1][1], 2)]
    for rounds in (0, 5):
        want, books = slow_codes(rows, rounds=rounds)
        got = vector_codes.vector_codes(vectors, rounds=rounds).collect()
        assert sorted((r["code"], r["error"]) for r in got) == sorted(want)
        assert {r["codebooks_sha256"] for r in got} == {vector_codes.codebook_digest(books)}


def test_vector_codes_on_small_tables(spark, vectors):
    assert vector_codes.vector_codes(vectors.where("1 = 0")).count() == 0
    assert vector_codes.vector_codes(vectors.where("vec_id >= 900")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    few = vector_codes.vector_codes(vectors.where("vec_id < 3")).collect()
    assert [r["error"] for r in few] == [0, 0, 0] and {r["label_error"] for r in few} == {0}
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 16, 1) for i in range(70)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(huge).where("error = 0").count() == 70


def test_bounds_are_never_too_high():
    values = np.concatenate([np.random.default_rng(0).exponential(1e3, 5000), [0, 1e-9, 65504, 1e9, -3.3]])
    assert (vector_codes.down16(values) <= values).all()
    near = np.tile(np.arange(8, dtype=np.uint8), (100, 1))
    low = np.sort(np.random.default_rng(1).normal(size=(100, 8)), 1).astype(np.float16)
    kept, bounds = vector_codes.shortened(near, low, np.zeros(100, int))
    assert kept.shape == bounds.shape == (100, 2) and (bounds[:, -1] == low[:, 1:].min(1)).all()


def test_codes_sql_on_the_table(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(vector_codes.codes_sql()).fetchall())


def residual(v, values, x):
    wide = v.astype(np.longdouble)
    scale = max(np.abs(v).max(), 1e-300)
    x = x.astype(np.longdouble)
    return float(np.abs(wide @ x - x * values).max() / scale), float(np.abs(x.T @ x - np.eye(len(v))).max())


def test_eigenvectors_are_exact_to_double_precision():
    random = np.random.default_rng(5)
    q = np.linalg.qr(random.normal(size=(30, 30)))[0]
    spread = random.normal(size=(200, 40))
    spread[:, 5] = spread[:, 6]
    near = np.array([1.0] * 5 + [1 + 1e-9] * 5 + [1 + 1e-12] * 5 + list(np.linspace(2, 3, 15)))
    for v in (spread.T @ spread, np.eye(30), (q * near) @ q.T, np.diag(np.arange(10.0) * 1e30), np.zeros((3, 3)), np.zeros((0, 0))):
        values, x = whitening.eigen((v + v.T) / 2)
        if len(v):
            assert max(residual((v + v.T) / 2, values, x)) < 2e-15
        assert (np.diff(values) <= 0).all()


def test_whitening_matches_brute_force(vectors):
    rows, _ = vector_rows()
    rows = [*rows, (5, rows[5][1], 2), (None, rows[1][1], 2)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    n, sums = len(rows), x.sum(0)
    z = n * x - sums
    y = (z / n).astype(float)
    values, directions = np.linalg.eigh(y.T @ y / n)
    values, directions = values[::-1], directions[:, ::-1]
    got = whitening.whitened_vectors(vectors, components=10).collect()
    assert len(got) == 10 * n and {r["n"] for r in got} == {n}
    table = np.zeros((n, 10))
    where = {}
    for i, (key, _, _) in enumerate(rows):
        where.setdefault(key, []).append(i)
    for r in got:
        for i in where[r["vec_id"]]:
            table[i, r["component"] - 1] = r["whitened"]
            assert r["deviation"] == sum(v * v for v in z[i])
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12
    want = (y @ directions[:, :10]) / np.sqrt(values[:10])
    signs = np.sign((table * want).sum(0))
    assert np.abs(table * signs - want).max() < 1e-9
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-12


def test_whitening_on_small_and_flat_tables(spark, vectors):
    assert whitening.whitened_vectors(vectors.where("1 = 0")).count() == 0
    assert whitening.whitened_vectors(vectors.where("vec_id in (900, 901)")).count() == 0
    one = whitening.whitened_vectors(vectors.where("vec_id = 3")).collect()
    assert len(one) == 32 and all(r["whitened"] == 0 and r["explained"] == 0 and r["deviation"] == 0 for r in one)
    flat = spark.createDataFrame([(i, [1.0, float(i), -float(i)]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whitened_vectors(flat).collect()
    assert len(got) == 27 and all((r["whitened"] != 0) <= (r["component"] == 1) for r in got)
    assert got[0]["identity_error"] < 1e-12
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whitened_vectors(huge).where("deviation is null").count() == 18
