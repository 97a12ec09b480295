import numpy as np
import pytest

from contextmill.operators import sequences as sq


def sentence_frame(spark, sizes, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    data = {d: rng.normal(size=(n, dim)).astype(np.float32) for d, n in enumerate(sizes)}
    rows = [(d, i, v.tolist()) for d, m in data.items() for i, v in enumerate(m)]
    return data, spark.createDataFrame(rows, "doc_id long, position long, vector array<float>").repartition(5)


def brute(matrix, i):
    mean = matrix[max(0, i - 3) : i].astype(np.float64).mean(axis=0)
    x = matrix[i].astype(np.float64)
    return x @ mean / np.linalg.norm(x) / np.linalg.norm(mean)


@pytest.mark.parametrize("width", [4, 8, 64, 16384])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_similarity(spark, setting, width, batch):
    """One document holds most of the rows and is spread over many blocks."""
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    data, rows = sentence_frame(spark, [150, 1, 3, 9, 40])
    got = {(r.doc_id, r.position): r.sim for r in sq.sentence_similarity(rows, 6, width=width).collect()}
    assert set(got) == {(d, i) for d, m in data.items() for i in range(len(m))}
    for (d, i), sim in got.items():
        assert sim is None if i == 0 else sim == pytest.approx(brute(data[d], i), abs=2e-9)


@pytest.mark.parametrize("width", [4, 16384])
def test_segments(spark, width):
    data, rows = sentence_frame(spark, [120, 1, 20])
    similarity = sq.sentence_similarity(rows, 6)
    got = {(r.doc_id, r.position): r.segment for r in sq.semantic_segments(similarity, 0.0, width).collect()}
    for d, m in data.items():
        segment = -1
        for i in range(len(m)):
            segment += i == 0 or brute(m, i) < 0.0
            assert got[d, i] == segment
    bounds = sq.segment_bounds(sq.semantic_segments(similarity, 0.0, width)).collect()
    assert sum(b.sentences for b in bounds) == 141
    assert all(b.last_position - b.first_position + 1 == b.sentences for b in bounds)


def test_numbering_a_hot_group(spark):
    rows = [("hot", i * 7 - 100) for i in range(300)] + [("cold", 5), ("cold", 2), (None, 1)]
    df = spark.createDataFrame(rows, "key string, id long").repartition(6)
    got = {(r.key, r.id): r.n for r in sq.numbered(df, ["key"], "id", "n").collect()}
    assert got == {**{("hot", i * 7 - 100): i for i in range(300)}, ("cold", 2): 0, ("cold", 5): 1, (None, 1): 0}
    assert sq.numbered(df.filter("false"), ["key"], "id", "n").count() == 0


@pytest.mark.parametrize("id_of", [lambda i: f"q-{i}", lambda i: (i * 0x9E3779B97F4A7C15 + 7) % (1 << 63)])
def test_numbering_by_text_and_hashed_ids(spark, id_of):
    ids = [id_of(i) for i in range(500)]
    df = spark.createDataFrame([("run", x) for x in ids], f"key string, id {'string' if isinstance(ids[0], str) else 'long'}")
    numbered = sq.numbered(df.repartition(7), ["key"], "id", "n")
    assert "Window" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.n for r in numbered.collect()} == {x: i for i, x in enumerate(sorted(ids))}
