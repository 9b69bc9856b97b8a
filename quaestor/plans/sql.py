"""Pieces of the SQL that states the queries anew for DuckDB."""

from __future__ import annotations

from quaestor.operators.evaluation import BASE_MS, COST_PER_TOKEN, EXPERIMENTS, METRICS, MODELS, MS_PER_TOKEN

NO_TOKEN = r"[^\p{L}\p{N}\p{M}]+"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{NO_TOKEN}'), lambda t: t <> '')"


def uid(kind: str, key: str) -> str:
    h = f"md5('{kind}:' || CAST({key} AS VARCHAR))"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def clean(raw: str) -> str:
    tags = f"regexp_replace(regexp_replace({raw}, '<[^>]*>', ' ', 'g'), '&[A-Za-z]+;|&#[0-9]+;', ' ', 'g')"
    return rf"trim(regexp_replace({tags}, '[ \t\r\n]+', ' ', 'g'))"


def chunks(size: int = 1200, overlap: int = 150, name: str = "chunks") -> str:
    step = size - overlap
    return f"""{name} AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, i * {step} + 1, {size}) AS content
      FROM documents, LATERAL (SELECT unnest(range(1 + greatest(0, CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT)))) AS i) WHERE length(text) > 0)"""


def hits(k: int = 5, name: str = "hits", source: str = "chunks") -> str:
    return f"""{name}_asked AS (SELECT item_id, unnest(q) AS t, len(q) AS n FROM (SELECT item_id, list_distinct({tokens("text")}) AS q FROM benchmark)),
    {name}_held AS (SELECT doc_id, chunk_index, unnest(list_distinct({tokens("content")})) AS t FROM {source}),
    {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS INTEGER) AS result_rank FROM (
      SELECT item_id, doc_id, chunk_index, count(*) / CAST(any_value(n) AS DOUBLE) AS score FROM {name}_asked JOIN {name}_held USING (t) GROUP BY item_id, doc_id, chunk_index HAVING count(*) / CAST(any_value(n) AS DOUBLE) >= 0.05)) WHERE result_rank <= {k})"""


def bm25(k: int = 5, source: str = "chunks") -> str:
    """The k best chunks of each benchmark item by BM25 with k1 = 1.2 and b = 0.75; frequencies and lengths are the chunks'."""
    return f"""b_asked AS (SELECT item_id, unnest(list_distinct({tokens("text")})) AS t FROM benchmark),
    b_held AS (SELECT doc_id, chunk_index, unnest(w) AS t, len(w) AS n FROM (SELECT doc_id, chunk_index, {tokens("content")} AS w FROM {source})),
    b_tf AS (SELECT doc_id, chunk_index, t, any_value(n) AS n, count(*) AS tf FROM b_held GROUP BY ALL),
    b_df AS (SELECT t, count(*) AS df FROM b_tf GROUP BY t),
    b_all AS (SELECT count(*) AS n_chunks, avg(len({tokens("content")})) AS mean FROM {source}),
    bm25 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS INTEGER) AS result_rank FROM (
      SELECT item_id, doc_id, chunk_index, round(sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 12) AS score
      FROM b_asked JOIN b_tf USING (t) JOIN b_df USING (t), b_all GROUP BY item_id, doc_id, chunk_index)) WHERE result_rank <= {k})"""


QUESTIONS = """questions AS (SELECT item_id, text AS question_text, (SELECT min(doc_id) FROM documents d WHERE contains(d.text, b.text)) AS expected_doc_id FROM benchmark b)"""


def cosine(a: str, b: str) -> str:
    """Cosine of hashed bags of two token lists, from counts by bucket."""
    bag = lambda x: f"list_transform(range(128), lambda i: CAST(len(list_filter({x}, lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 128 = i)) AS DOUBLE))"
    dot = lambda x, y: f"list_dot_product({x}, {y})"
    x, y = bag(a), bag(b)
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {dot(x, y)} / sqrt({dot(x, x)} * {dot(y, y)}) ELSE 0.0 END"


def results(strategy: str, size: int, overlap: int) -> str:
    """Metrics of each question and k for one strategy, as a chain of CTEs that ends in r_<strategy>."""
    s, ks = strategy, sorted({k for _, x, k, _ in EXPERIMENTS if x == strategy})
    return f"""{chunks(size, overlap, f"c_{s}")}, {hits(max(ks), f"h_{s}", f"c_{s}")},
    f_{s} AS (SELECT h.*, c.content FROM h_{s} h JOIN c_{s} c USING (doc_id, chunk_index)),
    k_{s} AS (SELECT q.*, k AS top_k,
        (SELECT content FROM f_{s} f WHERE f.item_id = q.item_id AND result_rank = 1) AS answer,
        (SELECT string_agg(content, chr(10) ORDER BY result_rank) FROM f_{s} f WHERE f.item_id = q.item_id AND result_rank <= k) AS context,
        coalesce((SELECT list(doc_id ORDER BY result_rank) FROM f_{s} f WHERE f.item_id = q.item_id AND result_rank <= k), []) AS found
      FROM questions q, (VALUES {", ".join(f"({k})" for k in ks)}) AS ks(k)),
    t_{s} AS (SELECT *, {tokens("question_text")} AS q, {tokens("coalesce(answer, '')")} AS a, list_distinct({tokens("coalesce(context, '')")}) AS c FROM k_{s}),
    d_{s} AS (SELECT *, list_distinct(q) AS qs, list_distinct(a) AS as_, list_filter(range(1, len(found) + 1), lambda i: found[i] = expected_doc_id) AS places FROM t_{s}),
    r_{s} AS (SELECT item_id, top_k,
        round(CASE WHEN len(as_) > 0 THEN len(list_intersect(as_, c)) / CAST(len(as_) AS DOUBLE) END, 6) AS faithfulness,
        round(CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, as_)) / CAST(len(qs) AS DOUBLE) END, 6) AS answer_relevance,
        CASE WHEN expected_doc_id IS NOT NULL THEN round(coalesce(list_avg(list_transform(places, lambda p, i: i / CAST(p AS DOUBLE))), 0.0), 6) END AS context_precision,
        CASE WHEN expected_doc_id IS NOT NULL THEN CAST(len(places) > 0 AS DOUBLE) END AS context_recall,
        round(CASE WHEN len(as_) + len(qs) > 0 THEN 2 * len(list_intersect(as_, qs)) / CAST(len(as_) + len(qs) AS DOUBLE) END, 6) AS answer_correctness,
        round({cosine("a", "q")}, 6) AS semantic_similarity,
        CAST(len(q) AS INTEGER) AS input_tokens, CAST(len(a) AS INTEGER) AS output_tokens, CAST(len(q) + len(a) AS INTEGER) AS total_tokens FROM d_{s})"""


def dashboard() -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    rows = ", ".join(f"({q(n)}, {q(s)}, {k}, {q(m)})" for n, s, k, m in EXPERIMENTS)
    strategies = sorted({s for _, s, _, _ in EXPERIMENTS if s})
    each = " UNION ALL ".join(f"SELECT '{s}' AS strategy, * FROM r_{s}" for s in strategies)
    return f"""WITH {QUESTIONS}, {", ".join(results(s, int(s.split("_")[1]), int(s.split("_")[2])) for s in strategies)},
    results AS ({each}),
    exps(experiment_name, chunking_strategy, top_k, model) AS (VALUES {rows})
    SELECT {uid("experiment", "experiment_name")} AS experiment_id, experiment_name, 'RAG' AS experiment_type,
      CASE WHEN chunking_strategy IS NULL THEN 'PENDING' ELSE 'COMPLETED' END AS status, 'simple-local-answerer' AS llm_model,
      CASE WHEN model IN ({", ".join(q(m[0]) for m in MODELS)}) THEN model END AS embedding_model, chunking_strategy, e.top_k,
      count(r.item_id) AS total_questions, {", ".join(f"round(avg({m}), 5) AS avg_{m}" for m in METRICS)},
      avg({BASE_MS} + {MS_PER_TOKEN} * r.output_tokens) AS avg_latency_ms, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(total_tokens) * {COST_PER_TOKEN} AS DECIMAL(28,6)) AS total_cost
    FROM exps e LEFT JOIN results r ON r.strategy = e.chunking_strategy AND r.top_k = e.top_k
    GROUP BY experiment_name, chunking_strategy, e.top_k, model"""
