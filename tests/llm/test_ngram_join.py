"""The Jaccard join against all pairs, compared by brute force."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from conftest import SMALL
from test_windows import alnum
from whole import table

from contextmill.llm import ngram_join
from contextmill.llm.queries import QUERIES


def brute(docs, size=5, similarity=0.8):
    sets = []
    for _, text in docs:
        w = alnum(text)
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    order = [(k is None, k or 0, i) for i, (k, _) in enumerate(docs)]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, texts = Counter(), [set() for _ in docs]
    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                if x != y:
                    texts[a].add(y)
                    texts[b].add(x)
                root[max(find(a), find(b), key=lambda i: order[i])] = min(find(a), find(b), key=lambda i: order[i])
    return Counter(
        (docs[i][0], docs[find(i)][0], links[i], len(texts[i]), find(i) == i) for i in range(len(docs)))


def documents(seed, base=120, copies=70):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(2000)]
    docs = [(1, None), (2, ""), (3, "!!"), (4, "two words"), (5, "Two, words."), (6, "two wordz"), (None, "two words"), (7, "v1 " * 3000)]
    some = [[r.choice(vocabulary) for _ in range(r.randrange(3, base))] for _ in range(25)]
    for i in range(copies):
        w = list(r.choice(some[:6]))
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append((r.randrange(10, 200), " ".join(w)))
    docs += [(300 + i, " ".join(w)) for i, w in enumerate(some)]
    return docs + docs[-4:]


@pytest.mark.parametrize("seed,rows", [(1, 128), (2, 4)])
def test_all_pairs(spark, seed, rows, tmp_path):
    docs = documents(seed)
    spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, rep int").repartition(5).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    found = ngram_join.ngram_join(df, recall=1 - 1e-9, block_rows=rows).collect()
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_linked_texts, r.first_of_class) for r in found)
    assert got == brute(docs)
    kept = ngram_join.drop_near_duplicates(df, recall=1 - 1e-9)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in brute(docs).elements() if r[4])
    assert ngram_join.ngram_join(df.filter("false")).count() == 0


def test_query(spark):
    docs = table("documents", "doc_id", "text")
    rows = QUERIES["op5_ngram_jaccard_join"](spark, SMALL).collect()
    want = {(r[0], r[1], r[2]) for r in brute(docs)}
    got = {(r.doc_id, r.class_id, r.n_links) for r in rows}
    assert len(rows) == len(docs) and len(got - want) <= 0.01 * len(want)
    assert any(r.n_links for r in rows)


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.998)
    assert bands * rows <= ngram_join.HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.998
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.01, 0.999999, 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(999, i) for i in range(1, 30)] + [(500, 500), (40, 50), (50, 40), (70, 60)]
    got = dict(ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in [*range(1, 30), 999]} | {40: 40, 50: 40, 60: 60, 70: 60}
    assert got == want


def test_different_texts_without_words_are_kept(spark, tmp_path):
    docs = [(1, "---"), (2, "!!!"), (3, " --- "), (4, "- -\n-"), (5, "- - -"), (6, None), (7, ""), (8, " \n"), (9, "two words"), (10, "Two, words.")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op5_ngram_jaccard_join"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.class_id for r in rows} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 9, 10: 9}
    assert {r.doc_id: r.n_links for r in rows} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: 1, 10: 1}
    kept = corpus_pipeline.keep_one_of_similar(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6, 9]
