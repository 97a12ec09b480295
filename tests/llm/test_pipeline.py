"""The pipeline against the brute-force versions of its stages, one after the other."""

import re

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from test_byte_bpe import LIBRARY
from test_ngram_join import brute
from test_windows import leaks

from contextmill.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def table(name, *columns):
    return duckdb.sql(f"select {', '.join(columns)} from '{MEDIUM}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def rows(spark):
    return corpus_pipeline.run(spark, MEDIUM).collect()


def test_whole_pipeline(spark, rows):
    toxic = {r.doc_id for r in QUERIES["op1_toxicity_ordinal"](spark, MEDIUM).collect() if r.toxic}
    docs = sorted((i, t) for i, t in table("documents", "doc_id", "text") if i not in toxic)
    seen, unequal = set(), []
    for i, t in docs:
        norm = re.sub("[ \t-\r]+", " ", t or "")
        if norm not in seen:
            seen.add(norm)
            unequal.append((i, t))
    first = {r[0] for r in brute(unequal) if r[4]}
    apart = [(i, t) for i, t in unequal if i in first]
    clean = {r[0] for r in leaks(apart, table("benchmark", "item_id", "text")) if not r[5]}
    want = {i: LIBRARY.encode_ordinary(t or "") for i, t in apart if i in clean}
    assert toxic and len(docs) > len(unequal) > len(apart) > len(want) > 0.5 * len(docs)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == want and len(rows) == len(want)
    assert all(r.lossless and r.n_tokens == len(want[r.doc_id]) for r in rows)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    """NULLs, repeated rows, an extra column, and no rows at all, through every stage."""
    odd = [(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0), (-2, "x" * 100_000, None, "s", 1), (-3, " \n", "de", None, 2)]
    whole = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    docs = whole.union(spark.createDataFrame(odd, whole.schema)).selectExpr("*", "1 as row", "'k' as kept", "2 as ids", "3 as hits")
    for frame, rows_left in ((docs, True), (docs.filter("false"), False)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{rows_left}{i}")
            frame.write.parquet(path)
            read = spark.read.parquet(path)
            frame = stage(spark, read, MEDIUM)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert frame.columns == docs.columns, name
        out = frame.collect()
        assert bool(out) == rows_left
        if rows_left:
            # Of the wordless texts the least id stays.
            assert {-3, -2} <= {r.doc_id for r in out} and -1 not in {r.doc_id for r in out} and all(r.lossless for r in out)
