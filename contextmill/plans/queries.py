"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.functions.numbers import parse_reply
from contextmill.functions.text import preview, word_overlap
from contextmill.operators import chunking, evaluation, parts, reporting, runs, sequences
from contextmill.operators import relevance as rel
from contextmill.operators import retrieval as ret
from contextmill.operators.ingest import embed_chunks, ingest, ingest_missing
from contextmill.operators.models import answer_prompt, base_prompt, critic_prompt, hashed_embedder, reflect_prompt
from contextmill.operators.replies import ReplyStore
from contextmill.plans import inputs
from contextmill.plans.inputs import DIM, TOP
from contextmill.session import materialise, temporary, work_folder
from contextmill.sources import collections
from contextmill.sources.collections import among
from contextmill.sources.corpus import assemble_pages, read_table, scan_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SWEEP = {"recursive": chunking.recursive_chunks, "semantic": inputs.offline_semantic}
RUN = reporting.RUN


def query(function):
    QUERIES[function.__name__] = function
    return function


def _round(*names: str, places: int = 9):
    return {n: F.round(n, places) for n in names}


# ---- sources -------------------------------------------------------------------


@query
def corpus_scan(spark, folder):
    docs = scan_documents(read_table(spark, folder, "documents"))
    return docs.select("doc_id", "source", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def page_assembly(spark, folder):
    return assemble_pages(inputs.conversation_pages(spark, folder))


# ---- chunking ------------------------------------------------------------------


@query
def sentences(spark, folder):
    return chunking.sentence_rows(inputs.documents(spark, folder)).select("doc_id", "position", "sentence")


@query
def chunk_recursive(spark, folder):
    chunks = chunking.recursive_chunks(inputs.documents(spark, folder))
    return chunks.select("doc_id", "source", "chunk_index", "text")


@query
def chunk_semantic(spark, folder):
    chunks = inputs.offline_semantic(inputs.documents(spark, folder))
    return chunks.select("doc_id", "source", "chunk_index", "text")


@query
def chunk_overlap(spark, folder):
    chunks = chunking.overlapping_chunks(inputs.documents(spark, folder))
    return chunks.select("doc_id", "source", "chunk_index", "text")


@query
def chunk_overlap_sentences(spark, folder):
    chunks = chunking.overlapping_sentence_chunks(inputs.documents(spark, folder))
    return chunks.select("doc_id", "source", "chunk_index", "text")


def _in_parts(spark, folder):
    """The documents as written parts of four lines."""
    return materialise(parts.into_parts(inputs.documents(spark, folder), 4), "parts")


@query
def chunk_recursive_parts(spark, folder):
    return parts.recursive_chunks(_in_parts(spark, folder)).select("doc_id", "source", "chunk_index", "text")


@query
def chunk_overlap_parts(spark, folder):
    return parts.overlapping_chunks(_in_parts(spark, folder)).select("doc_id", "source", "chunk_index", "text")


@query
def chunk_semantic_parts(spark, folder):
    chunks = parts.semantic_chunks(_in_parts(spark, folder), hashed_embedder(DIM), DIM, threshold=inputs.OFFLINE_THRESHOLD)
    return chunks.select("doc_id", "source", "chunk_index", "text")


@query
def chunk_stats(spark, folder):
    docs = inputs.documents(spark, folder)
    chunks = chunking.chunk_documents(docs, SWEEP)
    groups = docs.select("source", F.explode(F.array(*[F.lit(c) for c in SWEEP])).alias("chunker"))
    return chunking.chunk_stats(groups, chunks, ["source", "chunker"]).withColumns(_round("avg_chars", "avg_tokens"))


@query
def chunk_all(spark, folder):
    chunks = chunking.chunk_documents(inputs.documents(spark, folder), SWEEP)
    return chunks.withColumn("text_md5", F.md5("text")).drop("text")


@query
def chunk_ids(spark, folder):
    chunks = chunking.chunk_documents(inputs.documents(spark, folder), {"overlap": chunking.overlapping_chunks})
    return chunks.select("chunk_id", "doc_id", "chunk_index")


def _label_sentences(spark, folder):
    """Labels as documents and vector ids as sentence order."""
    vectors = read_table(spark, folder, "embeddings")
    return sequences.numbered(vectors, ["label"], "vec_id", "position").select(
        F.col("label").alias("doc_id"), "position", F.col("embedding").alias("vector")
    )


@query
def sentence_similarity(spark, folder):
    return sequences.sentence_similarity(_label_sentences(spark, folder), DIM)


@query
def semantic_segments(spark, folder):
    similarity = sequences.sentence_similarity(_label_sentences(spark, folder), DIM)
    return sequences.segment_bounds(sequences.semantic_segments(similarity, threshold=0.0))


# ---- vectors and collections ---------------------------------------------------


@query
def embed_join(spark, folder):
    docs = scan_documents(read_table(spark, folder, "documents"))
    vectors = read_table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return docs.join(vectors, "doc_id", "left").select(
        "doc_id", "source", F.length("text").alias("n_chars"), F.size("embedding").alias("dim"), "label",
        F.col("embedding").isNotNull().alias("has_vector"),
    )


@query
def embed_chunks_offline(spark, folder):
    """The offline embedder over the overlapping chunks, as used elements and their sum."""
    chunks = chunking.chunk_documents(inputs.documents(spark, folder), {"overlap": chunking.overlapping_chunks})
    points = embed_chunks(chunks, hashed_embedder(DIM))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    used = F.size(F.filter("embedding", lambda x: x > 0))
    return points.select("chunk_id", total.cast("long").alias("words"), used.cast("long").alias("buckets"))


@query
def vector_validation(spark, folder):
    points = read_table(spark, folder, "embeddings")
    return collections.vector_report(points, DIM, ["label"])


def _stored(points: DataFrame) -> DataFrame:
    """What a point holds: sizes, the text's digest and a sum that depends on the vector's order."""
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return points.select(
        "chunk_id", "chunker", "source", "n_chars", F.size("embedding").alias("dim"),
        F.md5("text").alias("text_md5"), F.round(weighted, 3).alias("vector_sum"),
    )


@query
def collection_write(spark, folder):
    """Both collections written, one recreated alone, and everything read back."""
    docs = inputs.documents(spark, folder)
    path = work_folder(spark, "collection")
    embed = hashed_embedder(DIM)
    ingest(docs, path, embed, DIM, SWEEP)
    again = chunking.chunk_documents(docs, {"recursive": chunking.recursive_chunks})
    collections.recreate(embed_chunks(again, embed), path, DIM, ["recursive"])
    return _stored(collections.read_collection(spark, path))


@query
def collection_append(spark, folder):
    """Points added to a collection in two parts beside another, and the one read back alone."""
    docs = inputs.documents(spark, folder)
    path = work_folder(spark, "collection")
    embed = hashed_embedder(DIM)
    ingest(docs, path, embed, DIM, {"recursive": chunking.recursive_chunks})
    points = embed_chunks(chunking.chunk_documents(docs, {"overlap": chunking.overlapping_chunks}), embed)
    odd = F.col("chunk_index") % 2 == 1
    collections.upload(points.filter(~odd), path, DIM)
    collections.upload(points.filter(odd), path, DIM)
    return _stored(collections.read_collection(spark, path, "overlap"))


@query
def collection_keyed_upload(spark, folder):
    """Half of a collection's points uploaded, then all documents twice over: every chunk is there once."""
    docs = inputs.documents(spark, folder)
    path = work_folder(spark, "collection")
    embed = hashed_embedder(DIM)
    chunkers = {"overlap": chunking.overlapping_chunks}
    chunks = chunking.chunk_documents(docs, chunkers)
    collections.upload(embed_chunks(chunks.filter("chunk_index % 2 = 0"), embed), path, DIM)
    ingest_missing(docs, path, embed, DIM, chunkers)
    again = ingest_missing(docs.unionByName(docs), path, embed, DIM, chunkers)
    return _stored(again.filter("chunker = 'overlap'"))


# ---- retrieval -----------------------------------------------------------------


def _hits(spark, folder, k):
    return ret.knn(inputs.vector_questions(spark, folder), inputs.vector_corpus(spark, folder), k, DIM)


@query
def knn_topk(spark, folder):
    return _hits(spark, folder, 10)


@query
def knn_pivots(spark, folder):
    """The same search over a corpus that is written in the order of pivots, with tiles skipped."""
    path = work_folder(spark, "ordered")
    ret.order_by_pivots(inputs.vector_corpus(spark, folder), DIM, path, 64)
    points, pivots = ret.read_ordered(spark, path)
    return ret.knn(inputs.vector_questions(spark, folder), points, 10, DIM, pivots=pivots)


@query
def knn_append(spark, folder):
    """Hits that are kept, after the corpus came in three uploads."""
    questions, corpus = inputs.vector_questions(spark, folder), inputs.vector_corpus(spark, folder)
    kept = ret.StoredHits(work_folder(spark, "kept-hits"), 10, DIM)
    for i in range(3):
        hits = kept.add(questions, corpus.filter(F.pmod("chunk_id", F.lit(3)) == i))
    return hits


@query
def retrieve_baseline(spark, folder):
    questions, corpus = inputs.vector_questions(spark, folder), inputs.vector_corpus(spark, folder)
    hits = ret.retrieve(questions, corpus, DIM, TOP)
    return ret.attach(hits, inputs.document_texts(spark, folder)).select(
        "query_id", "position", "chunk_id", "sim", "text"
    )


def _filtered(spark, folder):
    return ret.retrieve(
        inputs.vector_questions(spark, folder), inputs.vector_corpus(spark, folder), DIM, TOP,
        use_filtering=True, score=inputs.vector_scores(spark, folder),
    )


@query
def retrieve_filtered(spark, folder):
    return _filtered(spark, folder).select("query_id", "position", "chunk_id", "sim", "final_score", "threshold")


@query
def hit_preview(spark, folder):
    return ret.hit_preview(ret.attach(_hits(spark, folder, 15), inputs.document_texts(spark, folder)))


@query
def retrieval_diff(spark, folder):
    questions = inputs.vector_questions(spark, folder)
    both = ret.retrieve_both(
        questions, inputs.vector_corpus(spark, folder), DIM,
        inputs.vector_scores(spark, folder), TOP,
    ).select("query_id", "chunk_id", "mode", "position")
    diff = ret.compare_retrieval(both.filter("mode = 'baseline'"), both.filter("mode = 'filtered'"))
    return ret.attach(materialise(diff, "difference"), inputs.document_texts(spark, folder)).select(
        "query_id", "chunk_id", "baseline_position", "filtered_position", "kept_by",
        F.length("text").alias("n_chars"), preview(F.col("text"), 200).alias("preview"),
    )


# ---- relevance -----------------------------------------------------------------


def _scored(spark, folder):
    return inputs.vector_scores(spark, folder)(_hits(spark, folder, ret.OVERFETCH * TOP))


@query
def reply_parse(spark, folder):
    replies = inputs.event_replies(spark, folder)
    return replies.select("event_id", parse_reply(F.col("reply"), F.lit(0.25)).alias("score"))


@query
def score_base(spark, folder):
    replies = inputs.vector_replies(spark, folder)(_hits(spark, folder, ret.OVERFETCH * TOP))
    base = parse_reply(F.col("base_reply"), F.lit(rel.BASE_FALLBACK))
    return replies.select("query_id", "chunk_id", "rank", base.alias("base"))


@query
def score_chain(spark, folder):
    return _scored(spark, folder).select("query_id", "chunk_id", "rank", "scores.*")


@query
def score_stats(spark, folder):
    return rel.score_stats(inputs.event_scores(spark, folder)).withColumns(_round("mean", "std", "var"))


@query
def dynamic_threshold(spark, folder):
    stats = rel.score_stats(_scored(spark, folder))
    limit = rel.threshold(F.col("mean"), F.col("std"), F.col("var"))
    return stats.select("query_id", F.round(limit, 9).alias("threshold"))


@query
def filter_fallback(spark, folder):
    kept = rel.filter_by_relevance(_scored(spark, folder), min_chunks=rel.MIN_CHUNKS)
    return kept.select("query_id", "position", "chunk_id", "final_score", "fallback")


@query
def filter_relevance(spark, folder):
    kept = rel.filter_long_lists(inputs.event_scores(spark, folder))
    return kept.select("query_id", "chunk_id", "order_key", "final_score", "fallback")


@query
def filter_audit(spark, folder):
    return rel.audit(inputs.event_scores(spark, folder)).withColumns(_round("mean", "std", "var", "threshold"))


# ---- text retrieval and evaluation ---------------------------------------------


def _overlap_points(spark, folder):
    """Chunks with their vectors. Nothing is kept of them here: a search reads the vectors once, and texts of winners
    are cut again where the documents are read."""
    chunks = chunking.chunk_documents(inputs.documents(spark, folder), {"overlap": chunking.overlapping_chunks})
    return embed_chunks(chunks, hashed_embedder(DIM))


def _written_questions(spark, folder):
    return materialise(inputs.embedded(inputs.text_questions(spark, folder)), "questions")


def _text_hits(spark, folder, k):
    questions = _written_questions(spark, folder)
    points = _overlap_points(spark, folder)
    hits = ret.knn(questions, points, k, DIM).withColumn("position", F.col("rank"))
    return questions.drop("embedding"), hits, points.select("chunk_id", "text")


def _text_pairs(spark, folder, k):
    """Hits with question and text; questions are the shorter texts and are joined first."""
    questions, hits, texts = _text_hits(spark, folder, k)
    pairs = hits.join(questions.select("query_id", "user_input"), "query_id")
    return ret.attach(pairs, among(texts, hits, ["chunk_id"]))


@query
def retrieve_text(spark, folder):
    questions = _written_questions(spark, folder)
    points = _overlap_points(spark, folder)
    scorer = runs.candidate_scorer(questions, points, inputs.offline_scores)
    hits = ret.retrieve(questions, points, DIM, TOP, use_filtering=True, score=scorer)
    return hits.select("query_id", "position", "chunk_id", "sim", "final_score")


@query
def lexical_overlap(spark, folder):
    pairs = _text_pairs(spark, folder, ret.OVERFETCH * TOP)
    overlap = word_overlap(F.col("user_input"), F.col("text"))
    return pairs.select("query_id", "chunk_id", F.round(overlap, 9).alias("overlap"))


@query
def answer_prompts(spark, folder):
    questions, hits, texts = _text_hits(spark, folder, TOP)
    rows = questions.join(evaluation.contexts_of(ret.attach_texts(hits, texts)), "query_id", "left")
    contexts = F.coalesce("retrieved_contexts", F.array().cast("array<string>"))
    prompt = answer_prompt(contexts, F.col("user_input"))
    return rows.select("query_id", F.length(prompt).alias("n_chars"), F.md5(prompt).alias("prompt_md5"))


def _digest_model(prompt):
    """A model for prompts as columns: a reply that any change of the prompt changes."""
    number = F.conv(F.substring(F.md5(prompt), 1, 4), 16, 10).cast("int")
    reply = ((number % 100 + 1) / F.lit(128.0)).cast("string")
    return F.when(number % 11 == 0, "no idea").when(number % 13 != 0, reply)


@query
def stage_prompts(spark, folder):
    """The three prompts of every pair, each with the score that the stage before gave."""
    chunk, question = F.col("text"), F.col("user_input")
    base = parse_reply(F.col("base_reply"), F.lit(rel.BASE_FALLBACK))
    pairs = _text_pairs(spark, folder, TOP).withColumn("base", base_prompt(chunk, question))
    pairs = pairs.withColumn("base_reply", _digest_model(F.col("base")))
    pairs = pairs.withColumn("reflect", reflect_prompt(chunk, question, base))
    pairs = pairs.withColumn("reflect_reply", _digest_model(F.col("reflect")))
    reflect = parse_reply(F.col("reflect_reply"), base)
    pairs = pairs.withColumn("critic", critic_prompt(chunk, question, reflect))
    return pairs.select("query_id", "chunk_id", *[F.md5(p).alias(f"{p}_md5") for p in ("base", "reflect", "critic")])


@query
def score_model_chain(spark, folder):
    scored = rel.score_with_model(_text_pairs(spark, folder, TOP), _digest_model, texts=False)
    return scored.select("query_id", "chunk_id", "rank", "scores.*")


def _digest_client():
    """The same replies as ``_digest_model`` from a function that is called per prompt."""
    from hashlib import md5

    def call(prompt):
        number = int(md5(prompt.encode()).hexdigest()[:4], 16)
        if number % 11 == 0:
            return "no idea"
        if number % 13 == 0:
            raise RuntimeError("no reply")
        return str((number % 100 + 1) / 128)

    return call


@query
def score_stored_chain(spark, folder):
    """The three stages by a reply store that has the replies to a part of the pairs from a run before."""
    pairs = materialise(_text_pairs(spark, folder, TOP), "pairs")
    store = ReplyStore(work_folder(spark, "replies"), "digest", _digest_client, window=4)
    rel.score_with_model(pairs.filter("rank <= 2"), store)
    return rel.score_with_model(pairs, store).select("query_id", "chunk_id", "rank", "scores.*")


@query
def ground_truth_join(spark, folder):
    questions = inputs.text_questions(spark, folder).select("query_id", "user_input")
    return evaluation.lookup_reference(questions, inputs.references(spark, folder)).select(
        "query_id", "user_input", "reference"
    )


def _dataset(spark, folder):
    questions, hits, texts = _text_hits(spark, folder, TOP)
    return evaluation.build_dataset(questions, ret.attach_texts(hits, texts), inputs.references(spark, folder))


@query
def eval_dataset(spark, folder):
    return _dataset(spark, folder).withColumn("retrieved_contexts", F.array_join("retrieved_contexts", "\n\n"))


@query
def claim_verdicts(spark, folder):
    return evaluation.claim_verdicts(_dataset(spark, folder))


def _metrics(spark, folder):
    with temporary(spark):
        dataset = materialise(_dataset(spark, folder), "dataset", outlive=True)
    return evaluation.metrics_for(dataset, evaluation.claim_verdicts(dataset), ["query_id"])


@query
def metric_table(spark, folder):
    """All three metrics of every question."""
    return _metrics(spark, folder).select("query_id", *evaluation.METRICS)


@query
def metric_context_recall(spark, folder):
    return _metrics(spark, folder).select("query_id", "context_recall")


@query
def metric_faithfulness(spark, folder):
    return _metrics(spark, folder).select("query_id", "faithfulness")


@query
def metric_factual_f1(spark, folder):
    return _metrics(spark, folder).select("query_id", "factual_correctness")


# ---- sweep and reports ---------------------------------------------------------


def sweep_dataset(spark, folder):
    """Evaluation rows for every chunker and mode: documents in, datasets out."""
    embed = hashed_embedder(DIM)
    points = ingest(inputs.documents(spark, folder), work_folder(spark, "collection"), embed, DIM, SWEEP)
    known = materialise(inputs.references(spark, folder), "references")
    asked = inputs.text_questions(spark, folder).select("query_id", "user_input")
    return runs.evaluation_dataset(asked, points, known, SWEEP, embed, DIM, inputs.offline_scores, k=TOP)


def _summary(spark, folder):
    return reporting.metric_summary(runs.run_metrics(sweep_dataset(spark, folder)), runs.KEYS)


@query
def sweep_metrics(spark, folder):
    return _summary(spark, folder).withColumns(_round("mean"))


@query
def metric_summary(spark, folder):
    rows = _metrics(spark, folder).withColumnRenamed("factual_correctness", reporting.FACTUAL_NAMES[0])
    rows = rows.withColumns({"chunker": F.lit("overlap"), "mode": F.lit("baseline")})
    summary = reporting.resolve_factual(reporting.metric_summary(rows, runs.KEYS))
    return summary.withColumns(_round("mean"))


@query
def question_summary(spark, folder):
    return reporting.question_summary(sweep_dataset(spark, folder))


@query
def config_comparison(spark, folder):
    return reporting.compare_configurations(_summary(spark, folder)).withColumns(
        _round("baseline", "filtered", "change_pct", places=6)
    )


@query
def chunker_comparison(spark, folder):
    return reporting.compare_chunkers(_summary(spark, folder), *SWEEP).withColumns(
        _round(*SWEEP, "change_pct", places=6)
    )


@query
def best_configuration(spark, folder):
    return reporting.best_configuration(_summary(spark, folder)).withColumns(_round("mean"))


def _written_run(spark, folder):
    dataset = sweep_dataset(spark, folder)
    path = work_folder(spark, "report")
    for _ in range(2):  # the second time replaces the first
        runs.write_run(
            dataset, runs.run_metrics(dataset), path, datetime(2024, 1, 1),
            models={"embedding_model": "hashed words", "llm_model": "shared words"},
            chunking={
                "recursive": {"chunk_size": chunking.RECURSIVE_CHARS, "chunk_overlap": 0},
                "semantic": {"chunk_size": chunking.SEMANTIC_CHARS, "chunk_overlap": 0},
            },
            k=TOP,
        )
    return path


@query
def run_report(spark, folder):
    """Every field of the reports as written to and read back from JSON."""
    read = spark.read.json(f"{_written_run(spark, folder)}/reports")
    parts = ("value", "description", "interpretation")
    return read.select(
        *RUN, "run", "metadata.timestamp", F.col("metadata.mode").alias("title"), "metadata.filtering_enabled",
        "metadata.num_questions", "metadata.embedding_model", "metadata.llm_model",
        *[
            (F.round(F.col(f"metrics_summary.{m}.value"), 9) if p == "value" else F.col(f"metrics_summary.{m}.{p}"))
            .alias(m if p == "value" else f"{m}_{p}")
            for m in evaluation.METRICS for p in parts
        ],
        *[F.round(F.col(f"raw_results.{m}"), 9).alias(f"raw_{m}") for m in evaluation.METRICS],
        "configuration.chunk_size", "configuration.chunk_overlap", "configuration.retrieval_k",
        "configuration.retrieval_initial_k", "configuration.dynamic_threshold_enabled",
        F.array_join("configuration.filtering_stages", ",").alias("filtering_stages"),
    )


@query
def report_questions(spark, folder):
    """The evaluated questions beside the reports, read back from JSON."""
    read = spark.read.json(f"{_written_run(spark, folder)}/questions")
    return read.select(*RUN, "run", "query_id", "index", "question", "answer_length_chars", "num_contexts_retrieved")
