from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgauge.llm.neighbours import Forest, nearest
from rowgauge.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.1"
ASKS = "vec_id % 50 = 0"


def brute_force(ids, vectors, k=5):
    ids, x = np.array(ids), np.array(vectors, dtype=float)
    size = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 50 == 0}):
        best = {}
        for at in np.flatnonzero(ids == q):
            score = (x * x[at]).sum(axis=1) / (size * size[at])
            for i, s in zip(ids.tolist(), score.tolist()):
                if i != q:
                    best[i] = max(s, best.get(i, -2))
        out[q] = sorted(best.items(), key=lambda r: (-round(r[1], 12), r[0]))[:k]
    return out


def rows(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_scores_of_the_registered_query(spark):
    table = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()
    want = brute_force([r.vec_id for r in table], [r.embedding for r in table])
    got = rows(QUERIES["op6_nearest_vectors"](spark, MEDIUM))
    assert set(got) == set(want)
    found = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    for q, own in got.items():
        known = dict(want[q])
        assert len(own) == 5 and all(abs(known[i] - s) < 1e-12 for i, s in own if i in known)


def test_one_vector_shared_by_many_rows_ties_to_smaller_ids(spark):
    rng = np.random.default_rng(1)
    data = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1, 9000, 2)] + [(i, rng.standard_normal(4).tolist()) for i in range(0, 2000, 2)]
    data.append((50_000, [1.0, 2.0, 3.0, 4.0]))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = rows(nearest(df, F.expr(ASKS)))
    assert [i for i, _ in got[50_000]] == [1, 3, 5, 7, 9]
    assert len({s for _, s in got[50_000]}) == 1


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.standard_normal(3).tolist()) for i in range(0, 40)] + [(50, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = brute_force(*zip(*data))
    got = rows(nearest(df, F.expr(ASKS)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    two = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, -2.0]), (9, [1.0, 1e-3])], df.schema)
    assert [i for i, _ in rows(nearest(two, F.expr(ASKS)))[0]] == [9, 7]
    assert nearest(two.where("vec_id = 0"), F.expr(ASKS)).collect() == []


def test_invalid_repeated_and_clashing(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (50, None), (100, [-0.0, 0.0]), (9, [-1.0, -1.0]),
        (150, [1.0, 2.0, 3.0]),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 AS leaf", "2 AS rank", "3 AS vector", "4 AS asks")
    got = rows(nearest(df, F.expr(ASKS)))
    assert set(got) == {0} and [i for i, _ in got[0]] == [1, 9]
    assert got[0][0][1] == pytest.approx(1 / np.sqrt(1.01), abs=1e-12)


def test_empty_table_and_no_queries(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(none, F.expr(ASKS)).collect() == []
    assert nearest(spark.createDataFrame([(1, [1.0])], none.schema), F.expr(ASKS)).collect() == []


def test_search_gives_out_leaves_nearest_side_first():
    rng = np.random.default_rng(3)
    sample = rng.standard_normal((600, 8))
    forest = Forest.fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), 600, trees=3)
    x = rng.standard_normal((20, 8)).astype(np.float32)
    leaves = forest.route(x)
    for row in range(20):
        every = forest.search(x[row], 10**9)
        assert len(set(every)) == 3 << forest.depth
        first = forest.search(x[row], 3)
        assert every[:3] == first and (0, leaves[row, 0]) in every
        assert {(t, int(leaves[row, t])) for t in range(3)} <= set(every[: 3 * 4])
