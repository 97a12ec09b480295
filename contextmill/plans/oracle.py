"""The queries in plain SQL, for a comparison on another engine.

Shared steps are kept as named table expressions; ``_sql`` prepends the ones a query
needs, in order.
"""

from __future__ import annotations

import re

# Stated here anew, not taken from the engine, so that a changed value there shows.
DIM, TOP, OFFLINE_THRESHOLD = 64, 5, 0.4
_CAP_RECURSIVE, _CAP_SEMANTIC, _CANDIDATES = 2048, 500, 15
_WINDOW_TOKENS, _WINDOW_OVERLAP, _SHARE = 512, 50, 0.5
_PARAGRAPH, _LINE = r"(?s).+?(?:\n\n+|\z)", r"(?s).+?(?:\n+|\z)"
_SENTENCE = r"(?s).+?(?:[.!?]+[ \n\t\r]+|\n+|\z)"
_SPLIT_WORD = r"(?s).+?(?:[ \n\t\r]+|\z)"
_TOKEN, _SPACED_TOKEN = r"[^ \n\t\r]+", r"[^ \n\t\r]+[ \n\t\r]*"

# The code points that count as white space around a text.
_BLANK = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_STRIP = "||".join(f"chr({c})" for c in _BLANK)
_WORD = r"[\p{L}\p{N}]+"
_NUMBER = r"(?i)[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)"


def _strip(text: str) -> str:
    return f"trim({text}, {_STRIP})"


def _pieces(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{_WORD}')"


def _word_set(text: str) -> str:
    return f"list_distinct({_words(text)})"


def _tokens(text: str) -> str:
    return f"len({_pieces(text, _TOKEN)})"


def _parse(reply: str, fallback: str) -> str:
    number = f"case when regexp_full_match({_strip(reply)}, '{_NUMBER}') then try_cast({_strip(reply)} as double) end"
    return f"case when ({number}) is null then {fallback} else greatest(0.0::double, least(1.0::double, {number})) end"


def _split_steps(cap: int) -> dict[str, str]:
    """One table per separator level; ``path`` orders the pieces of a document."""
    steps = {"level0": "select doc_id, source, text as piece, []::bigint[] as path from docs"}
    patterns = (_PARAGRAPH, _LINE, _SENTENCE, _SPLIT_WORD)
    cut = f"list_transform(range(0, (length(piece) + {cap - 1}) // {cap}), lambda i: substr(piece, i * {cap} + 1, {cap}))"
    for level, split in enumerate([*(_pieces("piece", p) for p in patterns), cut], 1):
        steps[f"level{level}"] = f"""
    select doc_id, source, piece, path || [0::bigint] as path from level{level - 1} where length(piece) <= {cap}
    union all
    select doc_id, source, unnest(parts) as piece, path || [generate_subscripts(parts, 1)] as path
    from (select *, {split} as parts from level{level - 1} where length(piece) > {cap})"""
    return steps


def _pack(items: str, cap: int) -> str:
    """Chunk number of each {size, cut} item by a fold."""
    fresh = f"(a.cur > 0 and (x.cut or a.cur + x.size > {cap}))"
    return (
        f"list_reduce({items}, lambda a, x: {{"
        f"'cur': case when {fresh} then x.size else a.cur + x.size end, "
        f"'cid': a.cid + case when {fresh} then 1 else 0 end, "
        f"'ids': list_append(a.ids, a.cid + case when {fresh} then 1 else 0 end)}}, "
        f"{{'cur': 0::bigint, 'cid': 0::bigint, 'ids': []::bigint[]}}).ids"
    )


def _chunk_rows(label: str, body: str) -> str:
    return f"""
    select sha256(concat_ws(chr(1), source, doc_id::varchar, '{label}', chunk_index::varchar)) as chunk_id,
           doc_id, source, '{label}' as chunker, chunk_index, text,
           length(text) as n_chars, {_tokens('text')} as n_tokens
    from ({body})"""


def _vectors(source: str, key: str, text: str) -> str:
    """Hashed word counts, as the offline embedder makes them."""
    return f"""
    select t.key as {key}, list(coalesce(c.n, 0)::double order by d.b) as embedding
    from (select {key} as key from {source}) t cross join (select unnest(range({DIM})) as b) d
    left join (
        select key, ('0x' || substr(md5(w), 1, 8))::bigint % {DIM} as b, count(*) as n
        from (select {key} as key, unnest({_words(text)}) as w from {source}) group by all
    ) c on c.key = t.key and c.b = d.b
    group by t.key"""


def _cosine(a: str, b: str) -> str:
    return (
        f"coalesce(round(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * "
        f"sqrt(list_dot_product({b}, {b})), 0), 9), 0.0)"
    )


def _judged(scored: str, keys: str, minimum: int) -> str:
    """Threshold, verdict and position for short candidate lists."""
    return f"""
    select *, case when kept then row_number() over (partition by {keys} order by kept desc, place, rank) end as position
    from (
      select *, case when fallback then score_rank <= {minimum} else passed end as kept,
             case when fallback then score_rank else rank end as place
      from (
        select *, count(*) filter (passed) over (partition by {keys}) < {minimum} as fallback,
               row_number() over (partition by {keys} order by final_score desc, rank) as score_rank
        from (
          select *, final_score >= threshold as passed
          from (
            select *, round(greatest(0.0::double, least(1.0::double,
                     case when v < 0.01 then m + s else m end)), 12) as threshold
            from (
              select *, avg(final_score) over w as m, stddev_pop(final_score) over w as s,
                     var_pop(final_score) over w as v
              from {scored} window w as (partition by {keys})
            )))))"""


def _final(base: str, reflect: str, critic: str) -> str:
    return f"round(0.3::double * {base} + 0.3::double * {reflect} + 0.4::double * {critic}, 12)"


_STEPS: dict[str, str] = {
    "docs": f"select doc_id, source, {_strip('text')} as text from documents where length({_strip('text')}) > 0",
    "sents": f"""
    select doc_id, source, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as position
    from (select doc_id, source, {_pieces('text', _SENTENCE)} as ss from docs)""",
    **_split_steps(_CAP_RECURSIVE),
    "recursive_parts": f"""
    select doc_id, source, unnest(pieces) as piece, unnest(ids) as chunk_index, generate_subscripts(pieces, 1) as pos
    from (
      select *, {_pack("items", _CAP_RECURSIVE)} as ids
      from (select doc_id, source, list(piece order by path) as pieces,
                   list({{'size': length(piece)::bigint, 'cut': false}} order by path) as items
            from level5 where length(piece) > 0 group by doc_id, source))""",
    "recursive": _chunk_rows("recursive", """
    select doc_id, source, chunk_index, string_agg(piece, '' order by pos) as text
    from recursive_parts group by doc_id, source, chunk_index"""),
    "sent_keys": "select *, doc_id * 1000000 + position as sent_key from sents",
    "sent_vectors": _vectors("sent_keys", "sent_key", "sentence"),
    "sent_sums": """
    select doc_id, source, position, sentence, embedding,
           lag(embedding, 1) over w as p1, lag(embedding, 2) over w as p2, lag(embedding, 3) over w as p3
    from sent_keys join sent_vectors using (sent_key) window w as (partition by doc_id order by position)""",
    "sent_sims": f"""
    select doc_id, source, position, sentence,
           case when p1 is null then null else {_cosine("embedding", "before")} end as sim
    from (select *, list_transform(range(1, {DIM} + 1),
              lambda i: coalesce(p1[i], 0) + coalesce(p2[i], 0) + coalesce(p3[i], 0)) as before from sent_sums)""",
    "semantic_parts": f"""
    select doc_id, source, unnest(ss) as piece, unnest(ids) as chunk_index, generate_subscripts(ss, 1) as pos
    from (
      select *, {_pack("items", _CAP_SEMANTIC)} as ids
      from (
        select doc_id, source, list(sentence order by position) as ss,
               list({{'size': length(sentence)::bigint,
                      'cut': sim is null or sim < {OFFLINE_THRESHOLD}}} order by position) as items
        from sent_sims group by doc_id, source))""",
    "semantic": _chunk_rows("semantic", """
    select doc_id, source, chunk_index, string_agg(piece, '' order by pos) as text
    from semantic_parts group by doc_id, source, chunk_index"""),
    "overlap": _chunk_rows("overlap", f"""
    select doc_id, source, i as chunk_index,
           {_strip(f"array_to_string(tokens[i * 462 + 1 : i * 462 + {_WINDOW_TOKENS}], '')")} as text
    from (select *, unnest(range(0, 1 + greatest(len(tokens) - 51, 0) // 462)) as i
          from (select doc_id, source, {_pieces('text', _SPACED_TOKEN)} as tokens from docs)
          where len(tokens) > 0)"""),
    "sized": f"""
    select *, sum(size) over w as upto, sum(size) over w - size as before
    from (select *, {_tokens('sentence')}::bigint as size from sents) window w as (partition by doc_id order by position)""",
    "span_ends": f"""
    select f.doc_id, f.position as first, f.before,
           greatest(f.position, max(e.position) filter (e.upto <= f.before + {_WINDOW_TOKENS})) as last
    from sized f join sized e on e.doc_id = f.doc_id and e.position >= f.position
    group by f.doc_id, f.position, f.before""",
    "span_next": f"""
    select s.doc_id, s.first, s.last, case when max(n.position) is not null then
           coalesce(min(b.position) filter (l.upto - b.before <=
               least({_WINDOW_OVERLAP}, {_WINDOW_TOKENS} - n.size)), s.last + 1) end as next_first
    from span_ends s join sized l on l.doc_id = s.doc_id and l.position = s.last
    left join sized n on n.doc_id = s.doc_id and n.position = s.last + 1
    left join sized b on b.doc_id = s.doc_id and b.position > s.first and b.position <= s.last
    group by s.doc_id, s.first, s.last""",
    "spans": """
    select doc_id, first, last, next_first, 0 as chunk_index from span_next where first = 0
    union all
    select n.doc_id, n.first, n.last, n.next_first, s.chunk_index + 1
    from spans s join span_next n on n.doc_id = s.doc_id and n.first = s.next_first""",
    "chunks": "select * from recursive union all select * from semantic",
    # vector retrieval
    "vq": """
    select item_id as query_id, text as user_input, embedding, label as question_label
    from benchmark join embeddings on item_id = vec_id""",
    "vsims": f"""
    select query_id, vec_id as chunk_id, question_label, c.label,
           {_cosine("q.embedding::double[]", "c.embedding::double[]")} as sim
    from vq q cross join embeddings c""",
    "vhits": """
    select *, row_number() over (partition by query_id order by sim desc, chunk_id) as rank from vsims""",
    "vreplies": f"""
    select query_id, chunk_id, sim, rank, ((1 + sim) / 2)::varchar as base_reply,
           case when label <> question_label then (((1 + sim) / 2) * ((1 + sim) / 2))::varchar end as reflect_reply,
           case when label = 0 then 'n/a'
                else ' ' || ((chunk_id * 37 % 101) / 100.0::double)::varchar || chr(10) end as critic_reply
    from vhits where rank <= {_CANDIDATES}""",
    "vscored": f"""
    select *, {_final("base", "reflect", "critic")} as final_score from (
      select *, {_parse("critic_reply", "reflect")} as critic from (
        select *, {_parse("reflect_reply", "base")} as reflect from (
          select *, {_parse("base_reply", "0.5::double")} as base from vreplies)))""",
    "vjudged": _judged("vscored", "query_id", TOP),
    "vjudged3": _judged("vscored", "query_id", 3),
    # long candidate lists
    "replies": """
    select event_id, user_id, value,
           case event_type when 'click' then ' ' || chr(9) || (value / 100)::varchar || chr(10)
                when 'view' then props when 'purchase' then '-' || value::varchar
                when 'signup' then value::varchar || 'd' end as reply
    from events""",
    "escored": f"""
    select *, {_final("base", "base", "critic")} as final_score from (
      select *, {_parse("(value / (value + 50))::varchar", "base")} as critic from (
        select user_id as query_id, event_id as chunk_id, event_id as rank, value,
               {_parse("reply", "0.5::double")} as base from replies))""",
    "estats": """
    select query_id, count(*) as candidates, avg(final_score) as mean, stddev_pop(final_score) as std,
           var_pop(final_score) as var from escored group by query_id""",
    "eaudit": """
    select s.*, p.passed, p.passed < 3 as fallback from (
      select *, round(greatest(0.0::double, least(1.0::double,
               case when var < 0.01 then mean + std else mean end)), 12) as threshold from estats) s
    join (select e.query_id, count(*) filter (final_score >= threshold) as passed
          from escored e join (
            select query_id, round(greatest(0.0::double, least(1.0::double,
               case when var < 0.01 then mean + std else mean end)), 12) as threshold from estats) t using (query_id)
          group by e.query_id) p using (query_id)""",
    # text retrieval and evaluation
    "turns": """
    select *, sum(case role when 'user' then 1 else 0 end) over (partition by conv_id order by turn) as g
    from conversations""",
    "asked": """
    select conv_id::varchar || '-' || turn::varchar as query_id, conv_id, g, text as user_input
    from turns where role = 'user'""",
    "answered": f"""
    select a.query_id, {_strip("string_agg(t.text, chr(10) order by t.turn)")} as response
    from turns t join asked a using (conv_id, g)
    where t.role = 'assistant' and length(t.text) > 0 group by a.query_id""",
    "tq": """
    select query_id, conv_id, user_input, coalesce(response, '') as response
    from asked left join answered using (query_id)""",
    "known": """
    select user_input, max(text) as reference from tq join documents on conv_id = doc_id
    where doc_id in (select doc_id from labels) group by user_input""",
    "qvec": _vectors("asked", "query_id", "user_input"),
}


def _text_steps(points: str, response: str) -> dict[str, str]:
    """Search, scores and evaluation over one table of chunks."""
    p = points
    return {
        f"{p}_vec": _vectors(p, "chunk_id", "text"),
        f"{p}_hits": f"""
    select *, row_number() over (partition by query_id order by sim desc, chunk_id) as rank from (
      select q.query_id, c.chunk_id, {_cosine("q.embedding", "c.embedding")} as sim
      from qvec q cross join {p}_vec c)
    qualify rank <= {_CANDIDATES}""",
        f"{p}_cand": f"""
    select h.*, c.text, a.user_input from {p}_hits h join {p} c using (chunk_id) join asked a using (query_id)""",
        f"{p}_scored": f"""
    select *, {_final("base", "reflect", "critic")} as final_score from (
      select *, coalesce(greatest(0.0::double, least(1.0::double, round(shared / nullif(nboth, 0), 9))), reflect) as critic from (
        select *, coalesce(greatest(0.0::double, least(1.0::double, round(shared / nullif(nchunk, 0), 9))), base) as reflect from (
          select *, coalesce(round(shared / nullif(nquestion, 0), 9), 0.5::double) as base from (
            select query_id, chunk_id, sim, rank, text, len(qs) as nquestion, len(cs) as nchunk,
                   len(list_intersect(qs, cs))::double as shared,
                   len(list_distinct(list_concat(qs, cs))) as nboth
            from (select *, {_word_set("user_input")} as qs, {_word_set("text")} as cs from {p}_cand)))))""",
        f"{p}_judged": _judged(f"{p}_scored", "query_id", TOP),
        f"{p}_both": f"""
    select query_id, chunk_id, text, 'baseline' as mode, rank as position from {p}_judged where rank <= {TOP}
    union all
    select query_id, chunk_id, text, 'filtered' as mode, position from {p}_judged where position <= {TOP}""",
        f"{p}_data": f"""
    select '{p}' as chunker, m.mode, t.query_id, t.user_input, {response} as response, coalesce(k.reference, '') as reference,
           coalesce(c.contexts, []) as contexts
    from tq t cross join (values ('baseline'), ('filtered')) m(mode)
    left join (select query_id, mode, list(text order by position) as contexts from {p}_both group by all) c
      on c.query_id = t.query_id and c.mode = m.mode
    left join known k on k.user_input = t.user_input""",
    }


_STEPS.update(_text_steps("overlap", "t.response"))
for _points in ("recursive", "semantic"):
    _STEPS.update(_text_steps(_points, "coalesce(c.contexts[1], '')"))


def _verdict_steps(data: str) -> dict[str, str]:
    d = data
    return {
        f"{d}_cases": f"""
    select chunker, mode, query_id, 'response' as side, 'contexts' as evidence, response as claims_of,
           array_to_string(contexts, chr(10)) as found_in from {d}
    union all select chunker, mode, query_id, 'response', 'reference', response, reference from {d}
    union all select chunker, mode, query_id, 'reference', 'contexts', reference,
           array_to_string(contexts, chr(10)) from {d}
    union all select chunker, mode, query_id, 'reference', 'response', reference, response from {d}""",
        f"{d}_verdicts": f"""
    select chunker, mode, query_id, side, evidence, unnest(flags) as supported,
           generate_subscripts(flags, 1) - 1 as claim_id
    from (
      select *, list_transform(claims, lambda c: len(list_intersect({_word_set("c")}, known)) >= {_SHARE} * len({_word_set("c")})) as flags
      from (
        select *, {_word_set("found_in")} as known,
               list_filter({_pieces("claims_of", _SENTENCE)}, lambda c: len({_words("c")}) > 0) as claims
        from {d}_cases))""",
        f"{d}_counts": f"""
    select chunker, mode, query_id,
      count(*) filter (side = 'reference' and evidence = 'contexts' and supported) as recalled,
      count(*) filter (side = 'reference' and evidence = 'contexts') as reference_claims,
      count(*) filter (side = 'response' and evidence = 'contexts' and supported) as grounded,
      count(*) filter (side = 'response' and evidence = 'contexts') as response_claims,
      count(*) filter (side = 'response' and evidence = 'reference' and supported) as tp,
      count(*) filter (side = 'response' and evidence = 'reference' and not supported) as fp,
      count(*) filter (side = 'reference' and evidence = 'response' and not supported) as fn
    from {d}_verdicts group by chunker, mode, query_id""",
        f"{d}_metrics": f"""
    select chunker, mode, query_id,
      recalled::double / nullif(reference_claims, 0) as context_recall,
      grounded::double / nullif(response_claims, 0) as faithfulness,
      2.0::double * tp / nullif(2 * tp + fp + fn, 0) as factual_correctness
    from (select chunker, mode, query_id from {d}) left join {d}_counts using (chunker, mode, query_id)""",
        f"{d}_long": f"""
    select chunker, mode, metric, avg(value) as mean, count(value) as scored, count(*) as questions from (
      select chunker, mode, 'context_recall' as metric, context_recall as value from {d}_metrics
      union all select chunker, mode, 'faithfulness', faithfulness from {d}_metrics
      union all select chunker, mode, 'factual_correctness', factual_correctness from {d}_metrics)
    group by chunker, mode, metric""",
    }


_STEPS["overlap_base"] = "select * from overlap_data where mode = 'baseline'"
_STEPS["sweep"] = "select * from recursive_data union all select * from semantic_data"
_STEPS.update(_verdict_steps("overlap_base"))
_STEPS.update(_verdict_steps("sweep"))


def _sql(select: str) -> str:
    """A query with the steps it needs, each after the steps it reads itself."""
    ordered: list[str] = []
    open_steps: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+(\w+)", sql):
            if name in _STEPS and name not in ordered and name not in open_steps:
                open_steps.append(name)
                visit(_STEPS[name])
                ordered.append(name)

    visit(select)
    def step(name: str) -> str:
        kind = "" if name in _STEPS[name].split() else "materialized "
        return f"{name} as {kind}({_STEPS[name].strip()})"

    return ("with recursive " + ",\n".join(map(step, ordered)) + "\n" if ordered else "") + select.strip()


# Columns that Spark's length, size and row_number give as 32-bit integers.
_INTEGERS = {
    "corpus_scan": "n_chars",
    "sentences": "position",
    "chunk_recursive": "chunk_index",
    "chunk_recursive_parts": "chunk_index",
    "chunk_semantic_parts": "chunk_index",
    "chunk_overlap_parts": "chunk_index",
    "chunk_semantic": "chunk_index",
    "chunk_overlap": "chunk_index",
    "chunk_overlap_sentences": "chunk_index",
    "chunk_stats": "min_chars max_chars",
    "chunk_all": "chunk_index n_chars n_tokens",
    "chunk_ids": "chunk_index",
    "embed_join": "n_chars dim",
    "vector_validation": "min_dim max_dim",
    "knn_topk": "rank",
    "knn_pivots": "rank",
    "knn_append": "rank",
    "retrieve_baseline": "position",
    "retrieve_filtered": "position",
    "hit_preview": "rank",
    "retrieval_diff": "baseline_position filtered_position n_chars",
    "score_base": "rank",
    "score_chain": "rank",
    "score_model_chain": "rank",
    "score_stored_chain": "rank",
    "filter_fallback": "position",
    "retrieve_text": "position",
    "answer_prompts": "n_chars",
    "claim_verdicts": "claim_id",
    "question_summary": "answer_length_chars num_contexts_retrieved",
}


def _typed(name: str, select: str) -> str:
    columns = _INTEGERS.get(name, "").split()
    if not columns:
        return select
    casts = ", ".join(f"{c}::integer as {c}" for c in columns)
    return f"select * replace ({casts}) from ({select.strip()})"


_CHUNK_COLUMNS = "select doc_id, source, chunk_index, text from {}"



def _stored(chunks: str) -> str:
    weighted = f"list_sum(list_transform(range(1, {DIM} + 1), lambda i: v.embedding[i] * i))"
    return f"""
    select c.chunk_id, chunker, source, n_chars::integer as n_chars, {DIM} as dim, md5(c.text) as text_md5,
           round({weighted}, 3) as vector_sum
    from {chunks} c join {chunks}_vec v on v.chunk_id = c.chunk_id"""


def _reply(prompt: str) -> str:
    number = f"('0x' || substr(md5({prompt}), 1, 4))::int"
    return (f"case when {number} % 11 = 0 then 'no idea' when {number} % 13 <> 0 "
            f"then (({number} % 100 + 1) / 128.0::double)::varchar end")


def _report_metric(name: str, description: str, interpretation: str) -> str:
    mean = f"round(max(mean) filter (metric = '{name}'), 9)"
    return (f"{mean} as {name}, {mean} as raw_{name}, '{description}' as {name}_description, "
            f"'{interpretation}' as {name}_interpretation")


_END = "chr(10) || chr(10)"
_STEPS["prompted1"] = f"""
    select *, 'How relevant is this passage to the question?' || {_END} || 'Passage: ' || text || {_END} || 'Question: '
           || user_input || {_END} || 'Reply with one number from 0 (irrelevant) to 1 (fully relevant) and nothing else.' as p1
    from overlap_cand where rank <= {TOP}"""
_STEPS["prompted2"] = f"""
    select *, 'You rated this passage ' || base::varchar || ' for relevance to the question. Reconsider and correct '
           || 'the rating if needed.' || {_END} || 'Passage: ' || text || {_END} || 'Question: ' || user_input || {_END}
           || 'Reply with the final number from 0 to 1 and nothing else.' as p2
    from (select *, {_parse("r1", "0.5::double")} as base from (select *, {_reply("p1")} as r1 from prompted1))"""
_STEPS["prompted3"] = f"""
    select *, 'A reviewer rated this passage ' || reflect::varchar || '. Judge strictly whether it really helps to '
           || 'answer the question.' || {_END} || 'Passage: ' || text || {_END} || 'Question: ' || user_input || {_END}
           || 'Reply with your own number from 0 to 1 and nothing else.' as p3
    from (select *, {_parse("r2", "base")} as reflect from (select *, {_reply("p2")} as r2 from prompted2))"""
_STEPS["prompted"] = f"""
    select *, {_parse("r3", "reflect")} as critic from (select *, {_reply("p3")} as r3 from prompted3)"""

ORACLE: dict[str, str] = {
    name: _sql(_typed(name, select))
    for name, select in {
        "corpus_scan": "select doc_id, source, length(text) as n_chars, md5(text) as text_md5 from docs",
        "page_assembly": f"""
            select conv_id as doc_id, {_strip("string_agg(text, chr(10) order by turn)")} as text, count(*) as pages
            from conversations where length(text) > 0 group by conv_id
            having length({_strip("string_agg(text, chr(10) order by turn)")}) > 0""",
        "sentences": "select doc_id, position, sentence from sents",
        "chunk_recursive": _CHUNK_COLUMNS.format("recursive"),
        "chunk_recursive_parts": _CHUNK_COLUMNS.format("recursive"),
        "chunk_semantic": _CHUNK_COLUMNS.format("semantic"),
        "chunk_semantic_parts": _CHUNK_COLUMNS.format("semantic"),
        "chunk_overlap": _CHUNK_COLUMNS.format("overlap"),
        "chunk_overlap_parts": _CHUNK_COLUMNS.format("overlap"),
        "chunk_overlap_sentences": """
            select s.doc_id, s.source, p.chunk_index, string_agg(s.sentence, '' order by s.position) as text
            from spans p join sents s on s.doc_id = p.doc_id and s.position between p.first and p.last
            group by s.doc_id, s.source, p.chunk_index""",
        "chunk_stats": """
            select source, chunker, coalesce(chunks, 0) as chunks, coalesce(avg_chars, 0) as avg_chars,
                   coalesce(avg_tokens, 0) as avg_tokens, coalesce(min_chars, 0) as min_chars,
                   coalesce(max_chars, 0) as max_chars
            from (select distinct source, chunker from docs cross join (values ('recursive'), ('semantic')) c(chunker))
            left join (select source, chunker, count(*) as chunks, round(avg(n_chars), 9) as avg_chars,
                   round(avg(n_tokens), 9) as avg_tokens, min(n_chars) as min_chars, max(n_chars) as max_chars
                   from chunks group by all) using (source, chunker)""",
        "chunk_all": "select * exclude (text), md5(text) as text_md5 from chunks",
        "chunk_ids": "select chunk_id, doc_id, chunk_index from overlap",
        "sentence_similarity": f"""
            select label as doc_id, position, case when p1 is null then null
                   else {_cosine("embedding::double[]", "before")} end as sim
            from (select *, list_transform(range(1, {DIM} + 1), lambda i: coalesce(p1[i], 0)::double
                     + coalesce(p2[i], 0) + coalesce(p3[i], 0)) as before
              from (select *, row_number() over w - 1 as position, lag(embedding, 1) over w as p1,
                           lag(embedding, 2) over w as p2, lag(embedding, 3) over w as p3
                    from embeddings window w as (partition by label order by vec_id)))""",
        "semantic_segments": f"""
            select doc_id, segment::bigint as segment, min(position) as first_position, max(position) as last_position,
                   count(*) as sentences
            from (select *, sum(case when sim is null or sim < 0 then 1 else 0 end)
                         over (partition by doc_id order by position) - 1 as segment
              from (select label as doc_id, position, case when p1 is null then null
                   else {_cosine("embedding::double[]", "before")} end as sim
              from (select *, list_transform(range(1, {DIM} + 1), lambda i: coalesce(p1[i], 0)::double
                     + coalesce(p2[i], 0) + coalesce(p3[i], 0)) as before
              from (select *, row_number() over w - 1 as position, lag(embedding, 1) over w as p1,
                           lag(embedding, 2) over w as p2, lag(embedding, 3) over w as p3
                    from embeddings window w as (partition by label order by vec_id)))))
            group by doc_id, segment""",
        "embed_join": """
            select doc_id, source, length(text) as n_chars, len(embedding) as dim, label,
                   embedding is not null as has_vector
            from docs left join embeddings on doc_id = vec_id""",
        "embed_chunks_offline": """
            select chunk_id, list_sum(embedding)::bigint as words,
                   len(list_filter(embedding, lambda x: x > 0)) as buckets from overlap_vec""",
        "vector_validation": f"""
            select label, count(*) as vectors, count(*) filter (len(embedding) = {DIM}
                   and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0) as valid,
                   min(len(embedding)) as min_dim, max(len(embedding)) as max_dim from embeddings group by label""",
        "collection_write": " union all ".join(_stored(c) for c in ("recursive", "semantic")),
        "collection_append": _stored("overlap"),
        "collection_keyed_upload": _stored("overlap"),
        "knn_topk": "select query_id, chunk_id, sim, rank from vhits where rank <= 10",
        "knn_append": "select query_id, chunk_id, sim, rank from vhits where rank <= 10",
        "knn_pivots": "select query_id, chunk_id, sim, rank from vhits where rank <= 10",
        "retrieve_baseline": f"""
            select query_id, rank as position, chunk_id, sim, d.text
            from vhits left join documents d on d.doc_id = chunk_id where rank <= {TOP}""",
        "retrieve_filtered": f"""
            select query_id, position, chunk_id, sim, final_score, threshold from vjudged where position <= {TOP}""",
        "hit_preview": """
            select query_id, rank, chunk_id, round(sim, 4) as score,
                   replace(substr(d.text, 1, 150), chr(10), ' ') as preview
            from vhits left join documents d on d.doc_id = chunk_id where rank <= 15""",
        "retrieval_diff": f"""
            select query_id, chunk_id, baseline_position, filtered_position,
                   case when baseline_position is null then 'filtered' when filtered_position is null then 'baseline'
                        else 'both' end as kept_by,
                   length(d.text) as n_chars, replace(substr(d.text, 1, 200), chr(10), ' ') as preview
            from (select query_id, chunk_id, rank as baseline_position from vjudged where rank <= {TOP})
            full join (select query_id, chunk_id, position as filtered_position from vjudged where position <= {TOP})
              using (query_id, chunk_id)
            left join documents d on d.doc_id = chunk_id""",
        "reply_parse": f"select event_id, {_parse('reply', '0.25::double')} as score from replies",
        "score_base": "select query_id, chunk_id, rank, base from vscored",
        "score_chain": "select query_id, chunk_id, rank, base, reflect, critic, final_score as final from vscored",
        "score_stats": """
            select query_id, candidates, round(mean, 9) as mean, round(std, 9) as std, round(var, 9) as var
            from estats""",
        "dynamic_threshold": "select distinct query_id, round(threshold, 9) as threshold from vjudged",
        "filter_fallback": """
            select query_id, position, chunk_id, final_score, fallback from vjudged3 where position is not null""",
        "filter_relevance": """
            select query_id, chunk_id, case when fallback then score_rank else rank end as order_key,
                   final_score, fallback
            from (select e.*, threshold, fallback,
                     row_number() over (partition by query_id order by final_score desc, rank) as score_rank
                  from escored e join eaudit using (query_id))
            where case when fallback then score_rank <= 3 else final_score >= threshold end""",
        "filter_audit": """
            select query_id, candidates, round(mean, 9) as mean, round(std, 9) as std, round(var, 9) as var,
                   round(threshold, 9) as threshold, passed, fallback from eaudit""",
        "retrieve_text": f"""
            select query_id, position, chunk_id, sim, final_score from overlap_judged where position <= {TOP}""",
        "lexical_overlap": f"""
            select query_id, chunk_id, round(len(list_intersect({_word_set("user_input")}, {_word_set("text")}))::double
                   / nullif(len({_word_set("user_input")}), 0), 9) as overlap from overlap_cand""",
        "answer_prompts": """
            select query_id, length(prompt) as n_chars, md5(prompt) as prompt_md5 from (
              select query_id, 'Answer from this context only.' || chr(10) || chr(10) || 'Context:' || chr(10)
                     || array_to_string(contexts, chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: '
                     || user_input as prompt from overlap_base)""",
        "stage_prompts": """
            select query_id, chunk_id, md5(p1) as base_md5, md5(p2) as reflect_md5, md5(p3) as critic_md5 from prompted""",
        "score_model_chain": f"""
            select query_id, chunk_id, rank, base, reflect, critic, {_final("base", "reflect", "critic")} as final
            from prompted""",
        "score_stored_chain": f"""
            select query_id, chunk_id, rank, base, reflect, critic, {_final("base", "reflect", "critic")} as final
            from prompted""",
        "ground_truth_join": """
            select query_id, user_input, coalesce(reference, '') as reference
            from tq left join known using (user_input)""",
        "eval_dataset": """
            select query_id, user_input, array_to_string(contexts, chr(10) || chr(10)) as retrieved_contexts,
                   response, reference from overlap_base""",
        "claim_verdicts": "select query_id, side, evidence, claim_id, supported from overlap_base_verdicts",
        "metric_table": "select query_id, context_recall, faithfulness, factual_correctness from overlap_base_metrics",
        "metric_context_recall": "select query_id, context_recall from overlap_base_metrics",
        "metric_faithfulness": "select query_id, faithfulness from overlap_base_metrics",
        "metric_factual_f1": "select query_id, factual_correctness from overlap_base_metrics",
        "metric_summary": """
            select chunker, mode, metric, round(mean, 9) as mean, scored, questions from overlap_base_long""",
        "sweep_metrics": "select chunker, mode, metric, round(mean, 9) as mean, scored, questions from sweep_long",
        "question_summary": """
            select chunker, mode, query_id, user_input as question, length(response) as answer_length_chars,
                   len(contexts) as num_contexts_retrieved,
                   row_number() over (partition by chunker, mode order by query_id) as index from sweep""",
        "config_comparison": """
            select metric, chunker, round(b, 6) as baseline, round(f, 6) as filtered,
                   round(100 * (f - b) / nullif(b, 0), 6) as change_pct
            from (select metric, chunker, max(mean) filter (mode = 'baseline') as b,
                         max(mean) filter (mode = 'filtered') as f from sweep_long group by metric, chunker)""",
        "chunker_comparison": """
            select metric, mode, round(r, 6) as recursive, round(s, 6) as semantic,
                   round(100 * (s - r) / nullif(r, 0), 6) as change_pct
            from (select metric, mode, max(mean) filter (chunker = 'recursive') as r,
                         max(mean) filter (chunker = 'semantic') as s from sweep_long group by metric, mode)""",
        "best_configuration": """
            select metric, chunker, mode, round(mean, 9) as mean from sweep_long where mean is not null
            qualify row_number() over (partition by metric order by round(mean, 12) desc, chunker, mode) = 1""",
        "run_report": f"""
            select chunker, mode, '20240101_000000' as run, '20240101_000000' as timestamp,
                   case mode when 'filtered' then 'Relevance filtering' else 'Baseline (no filtering)' end as title,
                   mode = 'filtered' as filtering_enabled, mode = 'filtered' as dynamic_threshold_enabled,
                   max(questions) as num_questions, 'hashed words' as embedding_model, 'shared words' as llm_model,
                   {_report_metric("context_recall", "share of the reference''s claims found in the contexts",
                                   "whether the search missed something the answer needs")},
                   {_report_metric("faithfulness", "share of the response''s claims the contexts support",
                                   "whether the answer says more than its contexts")},
                   {_report_metric("factual_correctness", "F1 of the response''s claims against the reference''s",
                                   "whether the answer agrees with the known one")},
                   case chunker when 'recursive' then 2048 else 500 end::bigint as chunk_size, 0::bigint as chunk_overlap,
                   {TOP}::bigint as retrieval_k,
                   case mode when 'filtered' then {_CANDIDATES} else {TOP} end::bigint as retrieval_initial_k,
                   case mode when 'filtered' then 'base_score,self_reflection,critic_eval' end as filtering_stages
            from sweep_long group by chunker, mode""",
        "report_questions": """
            select chunker, mode, '20240101_000000' as run, query_id, user_input as question,
                   length(response) as answer_length_chars, len(contexts) as num_contexts_retrieved,
                   row_number() over (partition by chunker, mode order by query_id) as index from sweep""",
    }.items()
}
