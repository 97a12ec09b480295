import numpy as np
import pytest
from pyspark.sql import functions as F

from contextmill.operators import retrieval as ret

Q, C = "query_id long, embedding array<float>", "chunk_id long, embedding array<float>"


def frames(spark, questions, corpus, ids=None, schema=C):
    ids = range(len(corpus)) if ids is None else ids
    return (
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(questions)], Q),
        spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, corpus)], schema),
    )


def brute(questions, corpus, ids, k):
    out = []
    for q, x in enumerate(questions.astype(np.float64)):
        scale = np.linalg.norm(corpus.astype(np.float64), axis=1) * np.linalg.norm(x)
        dots = corpus.astype(np.float64) @ x
        sims = np.round(np.divide(dots, scale, out=np.zeros(len(corpus)), where=scale > 0), 9)
        best = sorted(zip(-sims, ids))[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return out


def rows(hits):
    columns = ("query_id", "chunk_id", "sim", "rank")
    return sorted(((r.query_id, r.chunk_id, r.sim, r["rank"]) for r in hits.select(*columns).collect()),
                  key=lambda r: (r[0], r[3]))


def vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


@pytest.mark.parametrize("k", [1, 7, 400])
def test_knn_against_brute_force(spark, k):
    questions, corpus = vectors(9, 16, 1), vectors(300, 16, 2)
    q, c = frames(spark, questions, corpus)
    assert rows(ret.knn(q, c.repartition(5), k, 16)) == brute(questions, corpus, range(300), k)


def test_a_third_of_the_corpus_is_one_vector(spark, setting):
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    corpus = vectors(600, 8, 3)
    corpus[::3] = corpus[0]
    questions = np.concatenate([corpus[:1], vectors(3, 8, 4)])
    q, c = frames(spark, questions, corpus)
    assert rows(ret.knn(q, c.repartition(4), 10, 8)) == brute(questions, corpus, range(600), 10)


def test_near_ties_are_not_lost(spark):
    """Differences under single precision still decide the order."""
    base = vectors(1, 32, 5)[0]
    noise = vectors(200, 32, 6) * 1e-4
    corpus = (base + noise).astype(np.float32)
    q, c = frames(spark, base[None, :], corpus)
    assert rows(ret.knn(q, c.repartition(3), 5, 32)) == brute(base[None, :], corpus, range(200), 5)


def test_zero_vectors_and_text_ids(spark):
    corpus = vectors(40, 4, 7)
    corpus[5] = 0
    questions = np.concatenate([vectors(2, 4, 8), np.zeros((1, 4), dtype=np.float32)])
    ids = [f"c{i:02d}é" for i in range(40)]
    q, c = frames(spark, questions, corpus, ids, "chunk_id string, embedding array<float>")
    assert rows(ret.knn(q, c, 40, 4)) == brute(questions, corpus, ids, 40)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_question_blocks(spark, setting, broadcast):
    """Many blocks and tiles, and questions with the same id, by either join."""
    setting("spark.sql.autoBroadcastJoinThreshold", broadcast)
    questions, corpus = vectors(60, 8, 9), vectors(200, 8, 10)
    q, c = frames(spark, questions, corpus)
    got = ret.knn(q, c.repartition(3), 4, 8, question_bytes=8 * 8 * 7, tile_bytes=8 * 8 * 11)
    assert rows(got) == brute(questions, corpus, range(200), 4)
    same = ret.knn(q.union(q.filter("query_id = 3")).repartition(4), c, 4, 8, question_bytes=8 * 8 * 5)
    assert same.filter("query_id = 3").count() == 4


def counted(spark, df):
    """The rows, and how often any of them is made."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(look, df.schema), seen


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_corpus_is_read_once(spark, setting, broadcast):
    setting("spark.sql.autoBroadcastJoinThreshold", broadcast)
    q, c = frames(spark, vectors(60, 8, 9), vectors(200, 8, 10))
    score = lambda hits: hits.withColumn("final_score", F.pmod(F.col("chunk_id") * 37, F.lit(101)) / 100.0)
    for search in (
        lambda c: ret.knn(q, c, 4, 8, question_bytes=8 * 8 * 7),
        lambda c: ret.retrieve(q, c, 8, 4),
        lambda c: ret.retrieve(q, c, 8, 4, True, score),
        lambda c: ret.retrieve_both(q, c, 8, score, 4),
    ):
        corpus, seen = counted(spark, c.repartition(3))
        search(corpus).collect()
        assert seen.value == 200


def test_same_result_for_any_partitioning(spark, setting):
    questions, corpus = vectors(5, 16, 11), vectors(200, 16, 12)
    q, c = frames(spark, questions, corpus)
    results = []
    for n in (1, 4, 16):
        setting("spark.sql.shuffle.partitions", str(n))
        results.append(rows(ret.knn(q, c.repartition(n), 6, 16)))
    assert results[0] == results[1] == results[2]


def test_no_questions_and_no_corpus(spark):
    q, c = frames(spark, vectors(2, 4, 1), vectors(3, 4, 2))
    assert ret.knn(q.limit(0), c, 3, 4).count() == 0
    assert ret.knn(q, c.limit(0), 3, 4).count() == 0


def test_wrong_dimension_fails(spark):
    q, c = frames(spark, vectors(2, 4, 1), vectors(3, 5, 2))
    with pytest.raises(Exception, match="declared 4"):
        ret.knn(q, c, 3, 4).collect()


def test_only_ids_and_vectors_are_read(spark, tmp_path):
    _, c = frames(spark, vectors(1, 4, 1), vectors(10, 4, 2))
    c.withColumn("text", F.lit("long text")).write.parquet(str(tmp_path / "c"))
    tiles = ret._packed(spark.read.parquet(str(tmp_path / "c")).select("chunk_id", "embedding"), "chunk", 4, 1000)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet [chunk_id" in plan and "text" not in plan.split("ReadSchema")[1]


def by_position(df):
    return [(r.query_id, r.chunk_id) for r in df.orderBy("query_id", "position").collect()]


def test_retrieve_both_equals_two_retrievals(spark):
    questions, corpus = vectors(12, 8, 13), vectors(150, 8, 14)
    q, c = frames(spark, questions, corpus)
    score = lambda hits: hits.withColumn("final_score", F.pmod(F.col("chunk_id") * 37, F.lit(101)) / 100.0)
    both = ret.retrieve_both(q, c, 8, score, 5)
    baseline = ret.retrieve(q, c, 8, 5)
    filtered = ret.retrieve(q, c, 8, 5, use_filtering=True, score=score)
    assert by_position(both.filter("mode = 'baseline'")) == by_position(baseline)
    assert by_position(both.filter("mode = 'filtered'")) == by_position(filtered)
    assert filtered.groupBy("query_id").count().filter("count != 5").count() == 0


def test_filtering_needs_scores(spark):
    q, c = frames(spark, vectors(1, 4, 1), vectors(3, 4, 2))
    with pytest.raises(ValueError):
        ret.retrieve(q, c, 4, 2, use_filtering=True)


def test_attach_keeps_hits_without_payload(spark):
    hits = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "query_id long, chunk_id long")
    texts = spark.createDataFrame([(10, "ten"), (12, "twelve")], "chunk_id long, text string")
    got = sorted((r.query_id, r.chunk_id, r.text) for r in ret.attach(hits, texts).collect())
    assert got == [(1, 10, "ten"), (1, 11, None), (2, 10, "ten")]


def clustered(n, dim, seed, centres=40, spread=0.08):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return (middle[rng.integers(0, centres, n)] + spread / np.sqrt(dim) * rng.normal(size=(n, dim))).astype(np.float32)


def searched(spark, tmp_path, questions, corpus, k, dim, pivots=64, **more):
    q, c = frames(spark, questions, corpus)
    path = str(tmp_path / f"ordered-{len(list(tmp_path.iterdir()))}")
    ret.order_by_pivots(c.repartition(5), dim, path, pivots)
    points, chosen = ret.read_ordered(spark, path)
    seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    found = rows(ret.knn(q, points, k, dim, pivots=chosen, seen=seen, **more))
    return found, seen[1].value / max(1, seen[0].value)


def test_skipped_tiles_change_nothing(spark, tmp_path):
    """Bit for bit the hits of the full search; most of the work is skipped where vectors form clusters."""
    corpus = clustered(4000, 24, 1)
    questions = np.concatenate([clustered(30, 24, 1), vectors(4, 24, 9)])
    want = brute(questions, corpus, range(4000), 10)
    found, skipped = searched(spark, tmp_path, questions, corpus, 10, 24)
    q, c = frames(spark, questions, corpus)
    assert found == want == rows(ret.knn(q, c.repartition(3), 10, 24))
    assert skipped > 0.6


@pytest.mark.parametrize("k, tile_bytes", [(1, 2000), (7, 300), (70, 1 << 20)])
def test_bounds_with_odd_vectors(spark, tmp_path, k, tile_bytes):
    """Zero vectors, opposite ones, copies, ties at the k-th place, and fewer pivots than k."""
    corpus = np.concatenate([clustered(150, 8, 3, 5), np.zeros((20, 8), np.float32), -clustered(60, 8, 3, 5), np.repeat(clustered(1, 8, 4), 40, 0)])
    questions = np.concatenate([clustered(6, 8, 3, 5), np.zeros((1, 8), np.float32), -corpus[:2], corpus[-1:], vectors(3, 8, 8)])
    found, _ = searched(spark, tmp_path, questions, corpus, k, 8, 16, tile_bytes=tile_bytes, question_bytes=200)
    assert found == brute(questions, corpus, range(len(corpus)), k)


def test_random_directions_skip_little_and_lose_nothing(spark, tmp_path):
    corpus, questions = vectors(800, 64, 1), vectors(20, 64, 2)
    found, skipped = searched(spark, tmp_path, questions, corpus, 5, 64)
    assert found == brute(questions, corpus, range(800), 5) and skipped < 0.5


def test_a_pivot_with_most_vectors_is_spread(spark, tmp_path, setting):
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    corpus = np.concatenate([np.repeat(vectors(1, 8, 1), 3000, 0), vectors(500, 8, 2)])
    _, c = frames(spark, corpus[:1], corpus)
    ret.order_by_pivots(c.repartition(6), 8, str(tmp_path / "o"), 8)
    points, _ = ret.read_ordered(spark, str(tmp_path / "o"))
    sizes = [r["count"] for r in points.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 3500 and max(sizes) < 2500


def test_an_empty_corpus_in_order(spark, tmp_path):
    q, c = frames(spark, vectors(2, 4, 1), vectors(1, 4, 1))
    ret.order_by_pivots(c.filter("false"), 4, str(tmp_path / "o"))
    points, pivots = ret.read_ordered(spark, str(tmp_path / "o"))
    assert ret.knn(q, points, 3, 4, pivots=pivots).count() == 0


def test_kept_hits_after_appends(spark, tmp_path):
    """Equal to a full search, with ties over uploads, an empty upload, and an update that failed."""
    corpus = vectors(300, 8, 3)
    corpus[100:110] = corpus[0]
    corpus[200:205] = corpus[0]
    questions = np.concatenate([corpus[:1], vectors(6, 8, 4)])
    q, c = frames(spark, questions, corpus)
    kept = ret.StoredHits(str(tmp_path / "kept"), 12, 8)
    assert kept.read(spark) is None
    for a, b in ((0, 100), (100, 100), (100, 103), (103, 260)):
        kept.add(q, c.filter(f"chunk_id >= {a} and chunk_id < {b}"))
    (tmp_path / "kept" / "00000009").mkdir()  # begun, but never whole
    hits = kept.add(q, c.filter("chunk_id >= 260"))
    assert rows(hits) == rows(kept.read(spark)) == brute(questions, corpus, range(300), 12) == rows(ret.knn(q, c, 12, 8))


@pytest.mark.parametrize("parts", [2, 30])
def test_tasks_send_k_hits_of_a_question(spark, parts):
    """However many parts the corpus has, a question of several blocks has k rows before they are ranked."""
    q, c = frames(spark, vectors(60, 8, 9), vectors(900, 8, 10))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("pivot", "int"), ("floor", "double"), ("group", "string"))]
    found = ret._hits(q.select("*", *none), c.repartition(parts).select("*", *none), 4, 8, 8 * 8 * 7, 8 * 8 * 11, False, None)
    assert found.count() == 60 * 4


def test_texts_of_winners_alone_are_joined(spark):
    texts = spark.range(5000).selectExpr("id as chunk_id", "repeat('x', 100) as text")
    hits = spark.createDataFrame([(1, 10), (1, 4999), (2, 9000)], "query_id long, chunk_id long")
    assert ret.among(texts, hits, ["chunk_id"]).count() < 50
    got = sorted((r.chunk_id, len(r.text or "")) for r in ret.attach_texts(hits, texts).collect())
    assert got == [(10, 100), (4999, 100), (9000, 0)]


@pytest.mark.parametrize("signs", [1, -1])
def test_chunks_with_few_elements_are_skipped(spark, signs):
    """Without a layout: what has fewer elements than a question's floor needs is not multiplied, and no hit is lost."""
    rng = np.random.default_rng(5)
    short = np.zeros((4000, 32), np.float32)
    short[np.arange(4000), rng.integers(0, 32, 4000)] = rng.integers(1, 4, 4000) * np.where(rng.random(4000) < 0.5, 1, signs)
    corpus = np.concatenate([rng.integers(1, 9, (600, 32)).astype(np.float32), short, np.zeros((5, 32), np.float32)])
    questions = np.concatenate([rng.integers(1, 9, (40, 32)).astype(np.float32), short[:3], np.zeros((1, 32), np.float32)])
    q, c = frames(spark, questions, corpus)
    seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    found = rows(ret.knn(q, c.coalesce(1), 6, 32, seen=seen))
    assert found == brute(questions, corpus, range(len(corpus)), 6)
    assert seen[1].value / seen[0].value > 0.6


@pytest.mark.parametrize("k", [1, 30, 600])
def test_many_candidates_of_one_tile(spark, k):
    """Floors that rise all the way through a tile, so that every chunk is a candidate, and blocks of all sizes."""
    base = vectors(1, 16, 1)[0]
    corpus = (base + vectors(5000, 16, 2) * np.linspace(3, 0.01, 5000)[:, None]).astype(np.float32)
    questions = np.concatenate([base[None, :], vectors(700, 16, 3)])
    q, c = frames(spark, questions[:9], corpus)
    want = brute(questions[:9], corpus, range(5000), k)
    assert rows(ret.knn(q, c.coalesce(1), k, 16)) == want
    q, _ = frames(spark, questions, corpus[:1])
    got = rows(ret.knn(q.repartition(3), c.repartition(2), k, 16, question_bytes=8 * 16 * 100, tile_bytes=8 * 16 * 900))
    assert [r for r in got if r[0] < 9] == want and len(got) == 701 * k


def test_questions_are_dealt_evenly(spark):
    """Every task of the search has as many blocks, of as many questions, however the questions are partitioned."""
    assert [ret._blocks(n, 8192, 15, 16) for n in (0, 1, 2048, 2049, 13315, 69201, 120_000, 800_000)] == [0, 1, 1, 2, 7, 16, 32, 112]
    assert ret._blocks(69201, 8192, 1000, 16) == 48
    q, c = frames(spark, vectors(700, 8, 1), vectors(40, 8, 2))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("pivot", "int"), ("floor", "double"), ("group", "string"))]
    sizes = []
    plain = ret._packed

    def packed(rows, name, *more):
        if name == "query":
            sizes.extend(r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect())
        return plain(rows, name, *more)

    ret._packed = packed
    try:
        ret._hits(q.coalesce(3).select("*", *none), c.select("*", *none), 4, 8, 8 * 8 * 100, 8 * 8 * 11, False, None)
    finally:
        ret._packed = plain
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert len(sizes) == ret._blocks(700, 100, 4, tasks) and max(sizes) - min(sizes) <= 6
