"""Evaluation rows, claim verdicts and the three quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextmill.functions.numbers import parse_reply
from contextmill.functions.text import sentences, strip, word_set
from contextmill.operators.models import Model, answer_prompt, with_reply
from contextmill.operators.replies import ReplyStore
from contextmill.session import materialise

DATASET_COLUMNS = ("user_input", "retrieved_contexts", "response", "reference")
METRICS = ("context_recall", "faithfulness", "factual_correctness")

# Which texts each side's claims are checked against.
EVIDENCE = {"response": ("contexts", "reference"), "reference": ("contexts", "response")}
SUPPORT_SHARE = 0.5


def offline_replies(candidates: DataFrame) -> DataFrame:
    """Stand-in replies of the three scoring stages, from shared words.

    Works on the candidate pairs only: ``candidates(user_input, text, ...)``.
    """
    shared = F.col("shared").cast("double")
    shares = {
        "base_reply": F.size("question_words"),
        "reflect_reply": F.size("chunk_words"),
        "critic_reply": F.size("question_words") + F.size("chunk_words") - F.col("shared"),
    }
    return (
        candidates.withColumns({"question_words": word_set(F.col("user_input")), "chunk_words": word_set(F.col("text"))})
        .withColumn("shared", F.size(F.array_intersect("question_words", "chunk_words")))
        .withColumns({n: F.round(F.try_divide(shared, size), 9).cast("string") for n, size in shares.items()})
        .drop("question_words", "chunk_words", "shared")
    )


def contexts_of(hits: DataFrame) -> DataFrame:
    """The context texts of each question in result order; at most k per question."""
    pairs = F.array_sort(F.collect_list(F.struct("position", "text")))
    return hits.groupBy("query_id").agg(F.transform(pairs, lambda p: p["text"]).alias("retrieved_contexts"))


def lookup_reference(questions: DataFrame, references: DataFrame) -> DataFrame:
    """The reference text of the exact question, an empty string where there is none."""
    unique = references.groupBy("user_input").agg(F.max("reference").alias("reference"))
    return questions.join(unique, "user_input", "left").withColumn(
        "reference", F.coalesce("reference", F.lit(""))
    )


def first_context(contexts: Column, question: Column) -> Column:
    """Offline answer: the best context itself."""
    return F.coalesce(F.get(contexts, F.lit(0)), F.lit(""))


class ask_for_answer:  # noqa: N801
    """Answers by a model or a reply store from the packed contexts, with or without the question."""

    def __init__(self, ask: Model | ReplyStore, with_question: bool = True):
        self.ask, self.with_question = ask, with_question

    def prompt(self, contexts: Column, question: Column) -> Column:
        return answer_prompt(contexts, question if self.with_question else None)

    def __call__(self, contexts: Column, question: Column) -> Column:
        return self.ask(self.prompt(contexts, question))


def build_dataset(questions: DataFrame, hits: DataFrame, references: DataFrame, answer=first_context) -> DataFrame:
    """One evaluation row per question; a question without hits has no contexts.

    ``questions(query_id, user_input)``, ``hits(query_id, position, text)``. Questions
    that carry a ``response`` column already have their answers.
    """
    # References go to the questions first: contexts are the longest texts and are moved once.
    rows = lookup_reference(questions, references).join(contexts_of(hits), "query_id", "left")
    return answered(rows, answer).select("query_id", *DATASET_COLUMNS)


def build_datasets(questions: DataFrame, hits: DataFrame, references: DataFrame, runs: list[tuple[str, str]], answer=first_context) -> DataFrame:
    """The rows of ``build_dataset`` for every one of ``runs``, pairs of chunker and mode, with those as columns.

    ``hits(query_id, chunker, places, text)`` have one row for a text that a question's runs over a collection found;
    ``places`` are its (mode, position). So a text that both modes keep moves once, and a reference once
    for all runs, whose rows are made where the question is.
    """
    found = F.collect_list(F.struct("chunker", "places", "text")).alias("found")
    rows = lookup_reference(questions, references).join(hits.groupBy("query_id").agg(found), "query_id", "left")
    each = F.array(*[F.struct(F.lit(c).alias("chunker"), F.lit(m).alias("mode")) for c, m in runs])
    rows = rows.withColumn("run", F.explode(each)).select("*", "run.*").drop("run")

    def placed(hit: Column) -> Column:
        own = F.filter(hit["places"], lambda p: p["mode"] == F.col("mode"))
        return F.transform(own, lambda p: F.struct(p["position"].alias("position"), hit["text"].alias("text")))

    own = F.filter("found", lambda h: h["chunker"] == F.col("chunker"))
    in_order = F.array_sort(F.flatten(F.transform(own, placed)))
    rows = rows.withColumn("retrieved_contexts", F.transform(in_order, lambda p: p["text"])).drop("found")
    return answered(rows, answer).select("query_id", *DATASET_COLUMNS, "chunker", "mode")


def answered(rows: DataFrame, answer) -> DataFrame:
    """``rows(user_input, retrieved_contexts, ...)`` with the ``response``, unless they have it; no contexts are an empty list."""
    rows = rows.withColumn("retrieved_contexts", F.coalesce("retrieved_contexts", F.array().cast("array<string>")))
    if "response" not in rows.columns:
        contexts, question = F.col("retrieved_contexts"), F.col("user_input")
        if isinstance(answer, ask_for_answer):
            stored = isinstance(answer.ask, ReplyStore)
            rows = with_reply(materialise(rows, "contexts") if stored else rows, answer.ask, answer.prompt(contexts, question), "response")
        else:
            rows = rows.withColumn("response", answer(contexts, question))
    return rows


def _evidence_text(kind: str) -> Column:
    return F.array_join("retrieved_contexts", "\n") if kind == "contexts" else F.col(kind)


def claim_rows(dataset: DataFrame) -> DataFrame:
    """Every claim of a response or reference beside each text it is checked against.

    A claim is a sentence with at least one word.
    """
    cases = [
        F.struct(F.lit(side).alias("side"), F.lit(kind).alias("evidence"), F.col(side).alias("claims_of"),
                 _evidence_text(kind).alias("found_in"))
        for side, kinds in EVIDENCE.items()
        for kind in kinds
    ]
    keys = [c for c in dataset.columns if c not in DATASET_COLUMNS]
    return (
        dataset.select(*keys, F.explode(F.array(*cases)).alias("case"))
        .select(*keys, "case.side", "case.evidence",
                F.transform(sentences(F.col("case.claims_of")), strip).alias("claims"),
                F.col("case.found_in").alias("found_in"))
        .withColumn("claims", F.filter("claims", lambda c: F.size(word_set(c)) > 0))
    )


def claim_verdicts(dataset: DataFrame, share: float = SUPPORT_SHARE) -> DataFrame:
    """Offline verdicts: supported if at least ``share`` of a claim's words occur.

    All texts a verdict needs are in one dataset row, so nothing is shuffled. The claims are those of
    ``claim_rows``; the words of each text are found once, whatever it is compared with, and the
    evidence is first cut down to the words the claims use.
    """
    keys = [c for c in dataset.columns if c not in DATASET_COLUMNS]
    claims = {side: F.filter(F.transform(sentences(F.col(side)), word_set), lambda w: F.size(w) > 0) for side in EVIDENCE}
    texts = {kind: word_set(_evidence_text(kind)) for kinds in EVIDENCE.values() for kind in kinds}
    words = dataset.select(*keys, *[c.alias(f"{side} claims") for side, c in claims.items()], *[c.alias(f"{kind} words") for kind, c in texts.items()])
    cases = [
        F.struct(F.lit(side).alias("side"), F.lit(kind).alias("evidence"), F.col(f"{side} claims").alias("claims"),
                 F.array_intersect(F.flatten(f"{side} claims"), F.col(f"{kind} words")).alias("known"))
        for side, kinds in EVIDENCE.items()
        for kind in kinds
    ]
    each = words.select(*keys, F.explode(F.array(*cases)).alias("case")).select(*keys, "case.*")
    # Of two sets of distinct words the second is the one that a table is made of, for each claim.
    supported = F.transform("claims", lambda w: F.size(F.array_intersect(F.col("known"), w)) >= F.lit(share) * F.size(w))
    return each.select(*keys, "side", "evidence", F.posexplode(supported).alias("claim_id", "supported"))


def judge_claims(dataset: DataFrame, ask: Model | ReplyStore) -> DataFrame:
    """Verdicts by a model or a reply store that replies 1 for a supported claim and 0 otherwise.

    A failed call or an unreadable reply is no verdict (NULL), which no metric counts.
    """
    claims = claim_rows(dataset)
    keys = [c for c in claims.columns if c not in ("claims", "found_in")]
    each = claims.select(*keys, "found_in", F.posexplode("claims").alias("claim_id", "claim"))
    prompt = F.concat(
        F.lit("Does the text support the claim? Reply 1 or 0.\n\nText: "), F.col("found_in"),
        F.lit("\n\nClaim: "), F.col("claim"),
    )
    return with_reply(each, ask, prompt, "reply").select(
        *keys, "claim_id", (parse_reply(F.col("reply"), F.lit(None).cast("double")) >= 0.5).alias("supported")
    )


def _is(side: str, evidence: str) -> Column:
    return (F.col("side") == side) & (F.col("evidence") == evidence)


def metric_table(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The three metrics per question, NULL where a question has no such claims.

    Claims without a verdict count on neither side.
    """
    verdicts = verdicts.withColumn("judged", F.col("supported").isNotNull())
    yes = F.col("supported")

    def count(condition: Column) -> Column:
        return F.count_if(condition).cast("double")

    counts = verdicts.groupBy(*keys).agg(
        count(_is("reference", "contexts") & yes).alias("recalled"),
        count(_is("reference", "contexts") & F.col("judged")).alias("reference_claims"),
        count(_is("response", "contexts") & yes).alias("grounded"),
        count(_is("response", "contexts") & F.col("judged")).alias("response_claims"),
        count(_is("response", "reference") & yes).alias("tp"),
        count(_is("response", "reference") & ~yes).alias("fp"),
        count(_is("reference", "response") & ~yes).alias("fn"),
    )
    return counts.select(
        *keys,
        F.try_divide("recalled", "reference_claims").alias("context_recall"),
        F.try_divide("grounded", "response_claims").alias("faithfulness"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("factual_correctness"),
    )


def metrics_for(dataset: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics for every dataset row, also those without a single claim."""
    return dataset.select(*keys).join(metric_table(verdicts, keys), keys, "left")
