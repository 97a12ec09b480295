"""One query for each operator, with production parameters, over whole tables, and their SQL."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.llm import (
    byte_bpe,
    chat,
    collocations,
    decontamination,
    exact_dedup,
    filter_audit,
    language_id,
    ngram_join,
    sharding,
    substring_dedup,
    token_files,
    toxicity,
    warc,
)
from contextmill.session import materialise, work_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


END_ID = 2


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = token_files.new_folder(docs)
    manifest = token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, folder)
    back = token_files.read_tokens(folder, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_contamination(docs, read(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        decontamination.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"), wordless_apart=True).drop("row")


def op6_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    captures = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    index = warc.merge_index(captures).select("file", "offset", "url_key", "timestamp", "position")
    records = warc.read_archives(captures, folder)
    return records.drop("payload").join(index, ["file", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "position")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # Twice the words of the pipeline's memo, since here they have the executors to themselves.
    return byte_bpe.encode(docs, ranks, memo_words=2 * byte_bpe.MEMO_WORDS, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: A conversation whose texts hold the template's control strings.
PROBE = r"\### Assistant: </turn> ok"


def conversation_records(turns: DataFrame) -> DataFrame:
    """One record per conversation, in the layout that its roles allow.

    A question with an answer becomes a prompt record, with a system turn before it one with a
    system field; longer dialogues of the three usual roles are lists of speakers, and
    everything else is a list of messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.col("t.role"), ",")
    usual = F.forall("t", lambda t: t["role"].isin("user", "assistant", "system"))
    layout = (
        F.when(roles == "user,assistant", "prompt").when(roles == "system,user,assistant", "system prompt")
        .when(usual & (F.size("t") > 3), "speakers").otherwise("messages")
    )
    speaker = lambda t: F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])
    text = lambda back: F.element_at(F.col("t.text"), -back)
    pair = F.col("layout").isin("prompt", "system prompt")
    return grouped.withColumn("layout", layout).select(
        "conv_id",
        F.when(F.col("layout") == "system prompt", F.col("t")[0]["text"]).alias("system"),
        F.when(pair, text(2)).alias("prompt"),
        F.when(pair, text(1)).alias("completion"),
        F.when(F.col("layout") == "speakers", F.transform("t", lambda t: F.struct(
            speaker(t).alias("from"), t["text"].alias("value")))).alias("conversations"),
        F.when(F.col("layout") == "messages", F.transform("t", lambda t: F.struct(
            t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    canonical = chat.canonical_turns(conversation_records(turns.unionByName(probe)))
    formatted = chat.format_chat(canonical).select("conv_id", "layout", "formatted", "loss_spans")
    back = chat.parse_chat(materialise(formatted, "chat"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


SHARDS = 24


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    placed = sharding.assign_shards(rows, "doc_id", SHARDS, order=["text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language_id.fit(docs)
    found = language_id.identify(docs.select("doc_id", "text", language_id.held_out(F.col("doc_id")).alias("held_out")), network)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.filter_interactions(docs, read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity_ordinal": op1_toxicity_ordinal,
    "op2_token_files": op2_token_files,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_warc_index_merge": op6_warc_index_merge,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_chat_format": op9_chat_format,
    "op10_sharding": op10_sharding,
    "op11_language_id": op11_language_id,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
}

ORACLE = {
    "op7_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
        select doc_id, min(doc_id) over w keep_id, count(*) over w group_size,
               doc_id = min(doc_id) over w kept, sha256(t) text_sha256
        from n window w as (partition by t)
    """,
    "op9_chat_format": r"""
        with rows as (
            select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
            union all
            select -7, i, case i when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) x(i)
        ),
        e as (select *, length(regexp_replace(t, '(\\|</?turn|###)', '\\\1', 'g')) chars from rows),
        g as (
            select conv_id, count(*) n_turns,
                   string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t) said,
                   coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (where r = 'assistant'), '') loss,
                   string_agg(r, ',' order by turn nulls first, r, t) roles,
                   bool_and(r in ('user', 'assistant', 'system')) usual,
                   sum(length('<turn>### ') + length(r) + length(':') + 1 + chars + length('</turn>') + 2) f
            from e group by conv_id
        )
        select conv_id, n_turns, sha256(said) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256,
               cast(f as bigint) formatted_chars,
               case when roles = 'user,assistant' then 'prompt' when roles = 'system,user,assistant' then 'system prompt'
                    when usual and n_turns > 3 then 'speakers' else 'messages' end layout
        from g
    """,
    "op12_phrase_collocations": r"""
        with d as (select coalesce(lang, 'und') lang,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
        p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece from d),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
        s as (select lang, ws, unnest(range(1, len(ws) + 1)) i from w),
        g as (select lang, ws[i] w1, case when i < len(ws) then ws[i + 1] end w2,
                     case when i + 1 < len(ws) then ws[i + 2] end w3 from s),
        f1 as (select lang, w1, count(*) f from g group by all),
        f2 as (select lang, w1, w2, count(*) f from g where w2 is not null group by all),
        f3 as (select lang, w1, w2, w3, count(*) f from g where w3 is not null group by all having count(*) >= 10),
        cover as (select lang, x, y, max(f) f from (
                      select lang, w1 x, w2 y, f from f3 union all select lang, w2, w3, f from f3) group by all),
        cuts as (
            select lang, w1 || ' ' || w2 phrase, 1 k, p.f a, q.f l, r.f r
            from f2 p join f1 q using (lang, w1) join (select lang, w1 w2, f from f1) r using (lang, w2)
            left join cover c on c.lang = p.lang and c.x = p.w1 and c.y = p.w2
            where p.f >= 10 and not coalesce(100 * c.f >= 50 * p.f, false)
            union all
            select lang, w1 || ' ' || w2 || ' ' || w3, 1, p.f, q.f, r.f
            from f3 p join f1 q using (lang, w1) join (select lang, w1 w2, w2 w3, f from f2) r using (lang, w2, w3)
            union all
            select lang, w1 || ' ' || w2 || ' ' || w3, 2, p.f, q.f, r.f
            from f3 p join f2 q using (lang, w1, w2) join (select lang, w1 w3, f from f1) r using (lang, w3)
        ),
        scored as (select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) score from cuts),
        least_cut as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from least_cut)
        select lang, rank, phrase, a, l, r, n, score
        from ranked join (select lang, count(*) n from g group by lang) using (lang) where rank <= 2000
    """,
    "op13_filter_interaction_audit": r"""
        with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') part from documents),
        l as (select doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic
              from labels group by doc_id),
        x as (select d.*, coalesce(good, false) good, coalesce(toxic, false) toxic,
                     regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, min(d.doc_id) over (partition by t) least
              from d left join l using (doc_id)),
        s as (select part, len(w) < 200 a, 100 * len(list_distinct(w)) < 50 * len(w) b,
                     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) c,
                     regexp_matches(t, '[#$%&*|]') d, coalesce(doc_id > least, false) e, good, toxic from x),
        cells as (select part, a, b, c, d, e, count(*) n, count(*) filter (where good) g,
                         count(*) filter (where toxic) x from s group by all),
        letter as (select unnest(['A', 'B', 'C', 'D', 'E']) f),
        orders as (select p.f || q.f || r.f || s.f || t.f o from letter p, letter q, letter r, letter s, letter t
                   where len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
        steps as (select o, i step, substr(o, 1, i - 1) before, substr(o, i, 1) own from orders, range(1, 6) g(i)),
        marked as (select part, o filter_order, step, own, n, g, x,
                          case own when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end fail,
                          (a and contains(before, 'A')) or (b and contains(before, 'B')) or (c and contains(before, 'C'))
                          or (d and contains(before, 'D')) or (e and contains(before, 'E')) gone,
                          a::int + b::int + c::int + d::int + e::int = 1 single
                   from cells, steps),
        out as (select part, filter_order, cast(step as integer) step, own,
                       sum(n) filter (where not gone and not fail) kept, sum(n) filter (where not gone and fail) removed,
                       sum(n) filter (where gone and fail) redundant, sum(n) filter (where fail and single) unique_fails,
                       sum(g) filter (where not gone and fail) good_lost, sum(x) filter (where not gone and fail) toxic_lost
                from marked group by all)
        select part, filter_order, step, cast(coalesce(kept, 0) as bigint) kept, cast(coalesce(removed, 0) as bigint) removed,
               cast(coalesce(redundant, 0) as bigint) redundant, cast(coalesce(unique_fails, 0) as bigint) unique_fails,
               cast(coalesce(good_lost, 0) as bigint) good_lost, cast(coalesce(toxic_lost, 0) as bigint) toxic_lost,
               cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) shapley
        from out
    """,
}
