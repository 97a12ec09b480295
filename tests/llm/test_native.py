"""Exact dedup, chat formatting and sharding, by SQL and by hand."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SMALL
from oracle_check import compare, connect
from pyspark.sql import functions as F

from whole import table

from contextmill.llm import chat, exact_dedup, sharding
from contextmill.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) == ""


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def by_brute_force(rows):
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    groups = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(norm(text), []).append((key is None, key or 0, i))
    out = []
    for text, members in groups.items():
        first = min(members)
        for null, key, i in members:
            keep = None if first[0] else first[1]
            digest = hashlib.sha256(text.encode()).hexdigest()
            out.append((None if null else key, keep, len(members), digest))
    return Counter(out), len(groups)


DOCS = [
    (5, "a  b"), (3, "a\t\nb"), (9, " a b"), (1, None), (2, ""), (4, " "), (7, "x" * 30_000 + " y"), (6, "x" * 30_000 + "\ny"),
    (8, "the cat sat on " * 4_000), (8, "the cat sat on " * 4_000), (8, "other"), (None, "lost"), (None, "lost"), (11, "other"),
    (12, "\u00a0a b"), (13, "\U0001f600 " * 3000), (14, "\U0001f600  " * 3000),
]


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(*r, True, "z") for r in DOCS], "doc_id long, text string, kept boolean, recipe string")
    found = exact_dedup.exact_duplicates(df)
    assert no_python(found)
    rows = found.collect()
    want, groups = by_brute_force(DOCS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == groups
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_chunks_are_the_text_and_have_bounds(spark):
    texts = [t for _, t in DOCS if t]
    for least, most in ((16, 64), exact_dedup.CHUNK_CHARS):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(
            "t", exact_dedup.chunks(F.col("t"), (least, most)).alias("c"))
        for t, c in df.collect():
            assert "".join(c) == t and all(len(x) <= most for x in c)


def test_an_edit_changes_few_chunks(spark):
    letters = random.Random(3)
    text = " ".join("".join(letters.choices("abcdehlnoprst", k=letters.randrange(2, 9))) for _ in range(9000))
    df = spark.createDataFrame([(text,), ("inserted " + text,)], "t string")
    first, second = (set(r[0]) for r in df.select(exact_dedup.chunks(F.col("t"), (64, 512))).collect())
    assert len(first & second) > 0.8 * len(first)


def test_identifiers_that_collide_are_found(spark):
    df = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "aaa")], "doc_id long, text string")
    weak = lambda c: F.length(c).cast("string")
    assert exact_dedup.verified_identifier(df, identifier=weak) is exact_dedup.long_identifier
    assert exact_dedup.verified_identifier(df) is exact_dedup.short_identifier
    assert {(r.doc_id, r.kept) for r in exact_dedup.exact_duplicates(df, identifier=weak).collect()} == {(1, True), (2, True), (3, False)}


def test_drop_exact_duplicates_keeps_columns(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("row", F.lit(1)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns and out.count() == by_brute_force(DOCS)[1]
    empty = docs.filter("false")
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_formatting_round_trip(spark):
    texts = ["", "\\", "\\\\", "</turn>", "\\</turn>\n</turn>\n<turn>### x:\n", "### Assistant:", "a\n</turn>\nb", "\U0001f600 é", "x" * 200_000, None]
    rows = [(i, [("user", t), ("assistant", t), ("odd\nrole:", t), (None, t)]) for i, t in enumerate(texts)] + [(99, [])]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>").withColumn("turns", F.lit(1))
    formatted = chat.format_chat(chat.canonical_turns(df))
    assert no_python(formatted)
    for r in chat.parse_chat(formatted).collect():
        want = [] if r.id == 99 else [(a or "", texts[r.id] or "") for a in ("user", "assistant", "odd\nrole:", "")]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss_texts == [t for a, t in want if a == "assistant"]


def test_fingerprints_choose_layouts(spark):
    df = spark.createDataFrame(
        [
            (1, "p", "c", None, None, None, None, [("human", "h"), ("gpt", "g"), ("tool", None)][:0] or None),
            (2, None, None, "i", "o", None, None, None),
            (3, None, None, "i", "o", "in", None, None),
            (4, "p", "c", None, None, None, "s", None),
            (5, None, None, None, None, None, None, [("human", "h"), ("gpt", "g"), ("tool", None)]),
            (6, "p", None, None, None, None, None, None),
        ],
        "id int, prompt string, completion string, instruction string, output string, input string, system string, "
        "conversations array<struct<from:string,value:string>>",
    )
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).collect()}
    assert got == {
        1: ("prompt", [("user", "p"), ("assistant", "c")]),
        2: ("instruction", [("user", "i"), ("assistant", "o")]),
        3: ("instruction with input", [("user", "i\n\nin"), ("assistant", "o")]),
        4: ("system prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        5: ("speakers", [("user", "h"), ("assistant", "g"), ("tool", "")]),
        6: (None, []),
    }


def test_chat_with_repeated_and_null_turns(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, None, None, None), (None, 1, "assistant", "a"), (2, 1, "system", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = connect(SMALL)
    con.sql(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(QUERIES["op9_chat_format"](spark, str(tmp_path)), con, ORACLE["op9_chat_format"]) == ""


def test_sharding_law(spark):
    rows = QUERIES["op10_sharding"](spark, SMALL).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in table("documents", "doc_id", "text"))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_sharding_with_a_hot_key_nulls_and_growth(spark):
    hot = spark.range(4000).selectExpr("7L as doc_id", "'same' as text", "1 as slot")
    rest = spark.range(8000).selectExpr("case when id % 50 = 0 then null else id end as doc_id", "cast(id as string) as text", "1 as slot")
    df = hot.union(rest)
    placed = sharding.assign_shards(df, "doc_id", 24, order=["text"])
    assert no_python(placed)
    rows = placed.collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes.values()) == {500} and sorted(placed.columns) == ["doc_id", "home_shard", "shard", "slot", "text"]
    again = df.repartition(13)
    key = lambda rs: Counter((r.doc_id, r.text, r.shard, r.slot) for r in rs)
    assert key(sharding.assign_shards(again, "doc_id", 24, order=["text"]).collect()) == key(rows)
    plain = spark.range(24_000).selectExpr("id as doc_id")
    old = {r.doc_id: r.shard for r in sharding.assign_shards(plain, "doc_id", 24).collect()}
    new = {r.doc_id: r.shard for r in sharding.assign_shards(plain, "doc_id", 25).collect()}
    assert sum(old[k] != new[k] for k in old) < 0.2 * len(old)  # a plain modulus moves 96 %
    assert sharding.assign_shards(plain.filter("false"), "doc_id", 24).count() == 0


def test_overflow_goes_clockwise():
    assert sharding.bounded_segments([0, 1, 0, 2], [5, 1, 1, 0], 3) == [
        [(0, 3, 0, 0), (3, 4, 1, 1), (4, 5, 2, 0)], [(0, 1, 1, 0)], [(0, 1, 2, 1)], []]
