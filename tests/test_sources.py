import os

import pytest
from pyspark.sql import functions as F

from contextmill.operators import chunking, ingest
from contextmill.operators.models import embedding_model, hashed_embedder
from contextmill.sources import collections as col
from contextmill.sources import corpus

PAGES = "doc_id long, page_no int, text string"


def test_page_assembly(spark):
    rows = [(1, 2, "two"), (1, 1, " one"), (1, 3, None), (1, 4, ""), (1, 5, " "), (1, 10, "ten "),
            (2, 1, None), (2, 2, ""), (3, 1, " \n"), (4, 1, " x\n")]
    got = {r.doc_id: (r.text, r.pages) for r in corpus.assemble_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: ("one\ntwo\n \nten", 4), 4: ("x", 1)}


def test_page_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("page one\fpage two\f", encoding="utf-8")
    (tmp_path / "b.txt").write_text("\f \f", encoding="utf-8")
    (tmp_path / "c.md").write_text("other", encoding="utf-8")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.txt").write_text("nested", encoding="utf-8")
    got = corpus.assemble_pages(corpus.read_page_files(spark, str(tmp_path))).collect()
    assert [(r.source, r.text) for r in got] == [("a.txt", "page one\npage two")]


def test_scan_drops_empty_documents(spark):
    rows = [(1, "s", " a "), (2, "s", ""), (3, "s", None), (4, "s", "\n\t")]
    got = corpus.scan_documents(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "s", "a")]


def documents(spark):
    rows = [(i, f"f{i}", f"Alpha beta {i}. Gamma delta. Alpha beta.") for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_ingest_recreates_only_its_collections(spark, tmp_path):
    path, embed = str(tmp_path / "points"), hashed_embedder(8)
    points = ingest.ingest(documents(spark), path, embed, 8)
    assert {r.chunker for r in points.select("chunker").distinct().collect()} == {"recursive", "semantic"}
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("chunker=")}
    one = chunking.chunk_documents(documents(spark).filter("doc_id < 2"), {"semantic": chunking.semantic_chunks})
    col.recreate(ingest.embed_chunks(one, embed), path, 8, ["semantic"])
    assert sorted(os.listdir(f"{path}/chunker=recursive")) == before["chunker=recursive"]
    assert col.read_collection(spark, path, "semantic").select("doc_id").distinct().count() == 2
    col.upload(ingest.embed_chunks(one, embed), path, 8)
    assert col.read_collection(spark, path, "semantic").count() == 2 * one.count()
    col.recreate(ingest.embed_chunks(one.filter("false"), embed), path, 8, ["semantic"])
    assert {r.chunker for r in spark.read.parquet(path).select("chunker").distinct().collect()} == {"recursive"}


def test_one_collection_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "points")
    ingest.ingest(documents(spark), path, hashed_embedder(8), 8)
    plan = col.read_collection(spark, path, "semantic")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunker" in plan


@pytest.mark.parametrize("bad", [[1.0], None, [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0, float("-inf")], [1.0, 2.0, 3.0]])
def test_bad_vectors_fail_the_write(spark, tmp_path, bad):
    rows = [("a", "x", [1.0, 2.0]), ("b", "x", bad)]
    points = spark.createDataFrame(rows, "chunk_id string, chunker string, embedding array<float>")
    with pytest.raises(Exception, match="not a vector of 2 numbers: chunk b"):
        col.recreate(points, str(tmp_path / "points"), 2, ["x"])
    report = col.vector_report(points, 2, ["chunker"]).first()
    assert (report.vectors, report.valid) == (2, 1)


def test_embedding_model_sees_batches(spark):
    model = embedding_model(lambda: lambda texts: [[float(len(t)), float(len(texts) > 1)] for t in texts])
    got = documents(spark).coalesce(1).withColumn("v", model(F.col("source"))).select("v").collect()
    assert all(r.v == [2.0, 1.0] for r in got)


def test_hashed_embedder(spark):
    rows = spark.createDataFrame([("a b A",), ("",), (None,)], "t string")
    got = [r.v for r in rows.select(hashed_embedder(16)(F.col("t")).alias("v")).collect()]
    assert sorted(got[0], reverse=True)[:2] == [2.0, 1.0] and sum(got[0]) == 3.0
    assert got[1] == got[2] == [0.0] * 16


def test_long_documents_in_parts(spark):
    rows = [(1, i, None if i % 5 == 0 else f" p{i}") for i in range(1, 40)] + [(2, 3, "x")]
    pages = spark.createDataFrame(rows, PAGES)
    parts = {}
    for r in corpus.assemble_parts(pages, 7).orderBy("part").collect():
        assert r.pages <= 7
        parts.setdefault(r.doc_id, []).append(r.text)
    whole = {r.doc_id: r.text for r in corpus.assemble_pages(pages).collect()}
    assert {d: "\n".join(t).strip() for d, t in parts.items()} == whole


def failing(points, at):
    broken = F.when(F.col("chunk_id") == at, F.raise_error(F.lit("no vector")).cast("array<float>")).otherwise(F.col("embedding"))
    return points.withColumn("embedding", broken)


def stored(spark, path):
    return sorted((r.chunker, r.chunk_id, r.text) for r in col.read_collection(spark, path).collect())


def test_a_failed_recreate_leaves_the_old_collections(spark, tmp_path):
    path, embed = str(tmp_path / "points"), hashed_embedder(8)
    ingest.ingest(documents(spark), path, embed, 8)
    before = stored(spark, path)
    fresh = ingest.embed_chunks(chunking.chunk_documents(documents(spark).filter("doc_id < 3"), ingest.DEFAULT_CHUNKERS), embed)
    last = fresh.orderBy(F.desc("chunk_id")).first().chunk_id
    with pytest.raises(Exception, match="no vector"):
        col.recreate(failing(fresh, last), path, 8, ["recursive", "semantic"])
    assert stored(spark, path) == before and not [d for d in os.listdir(path) if d.startswith("_") and d != "_SUCCESS"]
    col.recreate(fresh, path, 8, ["recursive", "semantic"])
    assert 0 < len(stored(spark, path)) < len(before)


def test_a_recreate_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [(f"{i}", c, f"t{i}", [1.0, float(i)]) for i in range(5) for c in ("a b", "x=y", "ä")]
    kind = "chunk_id string, chunker string, text string, embedding array<float>"
    col.recreate(spark.createDataFrame(rows, kind), path, 2, ["a b", "x=y", "ä"])
    col.recreate(col.read_collection(spark, path).filter("chunk_id < '2'"), path, 2, ["x=y", "a b"])
    kept = stored(spark, path)
    assert {c: sum(k[0] == c for k in kept) for c in ("a b", "x=y", "ä")} == {"a b": 2, "x=y": 2, "ä": 5}


def test_a_failed_swap_is_undone(spark, tmp_path, monkeypatch):
    path, embed = str(tmp_path / "points"), hashed_embedder(8)
    ingest.ingest(documents(spark), path, embed, 8)
    before = stored(spark, path)
    fresh = ingest.embed_chunks(chunking.chunk_documents(documents(spark).filter("doc_id < 3"), ingest.DEFAULT_CHUNKERS), embed)
    # The last folder cannot be put in place, since its name is taken meanwhile.
    import contextmill.sources.collections as module

    plain, seen = module.unquote, []

    def names(text):
        seen.append(text)
        if len(seen) == 4:
            raise OSError("lost the file system")
        return plain(text)

    monkeypatch.setattr(module, "unquote", names)
    with pytest.raises(OSError):
        col.recreate(fresh, path, 8, ["recursive", "semantic"])
    monkeypatch.undo()
    assert stored(spark, path) == before


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_keyed_upload_leaves_each_id_once(spark, tmp_path, bits):
    path = str(tmp_path / "points")
    kind = "chunk_id string, chunker string, text string, embedding array<float>"

    def points(n, text="t"):
        return spark.createDataFrame([(f"{i}", c, f"{text}{i}", [1.0, float(i)]) for i in range(n) for c in "ab"], kind)

    def add(rows):
        col.upload(col.missing(rows, path, bits), path, 2)

    add(points(0))
    add(points(20))
    add(points(20))
    add(points(50).unionByName(points(50)))
    add(points(10).filter("chunker = 'a'"))
    got = stored(spark, path)
    assert got == sorted((c, f"{i}", f"t{i}") for i in range(50) for c in "ab")


def test_resumed_ingest_embeds_what_is_missing(spark, tmp_path):
    path, log = str(tmp_path / "points"), tmp_path / "calls"
    log.mkdir()

    def connect():
        def embed(texts):
            import uuid

            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return [[float(len(t))] * 4 for t in texts]

        return embed

    chunkers = {"recursive": chunking.recursive_chunks}
    embed = embedding_model(connect)
    half = chunking.chunk_documents(documents(spark).filter("doc_id < 3"), chunkers)
    col.upload(ingest.embed_chunks(half, embed), path, 4)
    asked = len(list(log.iterdir()))
    for _ in range(2):
        points = ingest.ingest_missing(documents(spark), path, embed, 4, chunkers)
        assert points.count() == points.select("chunk_id").distinct().count() == 6
    texts = [t for f in log.iterdir() for t in f.read_text().split("\n")]
    assert len(texts) == 6 and asked > 0


def test_ids_are_filtered_where_they_are_read(spark, tmp_path):
    ids = spark.range(2000).select(F.lit("a").alias("chunker"), F.col("id").cast("string").alias("chunk_id"))
    some = ids.filter("cast(chunk_id as int) < 100")
    passed = ids.filter(col._in_filter(some, ["chunker", "chunk_id"], 1 << 14))
    assert some.exceptAll(passed).count() == 0 and passed.count() < 130
    assert ids.filter(col._in_filter(some.filter("false"), ["chunker", "chunk_id"], 64)).count() == 0


def page_rows(df):
    return sorted((r.doc_id, r.source, r.page_no, r.text) for r in df.collect())


@pytest.mark.parametrize("size", [16, 1000])
def test_large_page_files_at_every_cut(spark, tmp_path, setting, size):
    """Byte ranges of any size give the pages of the whole files."""
    import random

    r = random.Random(size)
    odd = ["\f", "a", "é", "漢字", "\n", "\r\n", "\f\f", " ", "page text "]
    for i in range(4):
        (tmp_path / f"f{i}.txt").write_text("".join(r.choices(odd, k=r.randrange(10, 20))), encoding="utf-8", newline="")
    for name, text in (("empty", ""), ("ends", "a\fb\f"), ("only", "\f"), ("two", "\f\f"), ("plain", "no feed"), ("other", "x\fy")):
        (tmp_path / f"{name}{'.md' if name == 'other' else '.txt'}").write_text(text, encoding="utf-8", newline="")
    want = page_rows(corpus.read_page_files(spark, str(tmp_path)))
    setting("spark.sql.files.maxPartitionBytes", str(size))
    setting("spark.sql.files.openCostInBytes", "0")
    setting("spark.sql.files.minPartitionNum", "1")
    pages = corpus.read_large_page_files(spark, str(tmp_path))
    assert page_rows(pages) == want and len(want) > 15
    assert spark.read.option("lineSep", "\f").text(str(tmp_path)).rdd.getNumPartitions() >= (6 if size < 100 else 1)


def test_filters_are_as_large_as_their_ids(spark, monkeypatch):
    sizes, plain = [], col._places
    monkeypatch.setattr(col, "_places", lambda keys, bits: sizes.append(bits) or plain(keys, bits))
    rows = spark.range(20000).withColumnRenamed("id", "chunk_id")
    assert 1000 <= col.among(rows, rows.limit(1000), ["chunk_id"]).count() < 1500
    assert set(sizes) == {1 << 14}
