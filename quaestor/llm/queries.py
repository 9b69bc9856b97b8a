"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.tables import new_path, sql_lower, sql_values, table

TOKEN_LIMIT = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.sharding import shard_documents

    rows, _ = shard_documents(table(spark, sf_dir, "documents"), shards=16, map_path=new_path(spark, "slot-map"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


#: Conversation -1, whose texts hold the template's own control strings.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"
CONTROL_TURNS = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.chat import conversations, events_of_turns, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return read_back(conversations(events_of_turns(turns.unionByName(control))))


def op2_sql() -> str:
    from quaestor.llm.chat import END, START, sql_escape

    fixed = len(START) + 1 + len(END) + 1
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES {sql_values(CONTROL_TURNS)}))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum({fixed} + length(replace({sql_escape("role")}, chr(10), '\\n')) + length({sql_escape("text")})) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id"""


def op3_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.ctw import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.fmindex import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_sql() -> str:
    words = lambda c: f"regexp_extract_all({sql_lower(f'coalesce({c}, {chr(39) * 2})')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH docs AS (SELECT doc_id, {words("text")} AS w FROM documents),
    items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item, array_to_string(w[i + 1 : i + 10], ' ') AS phrase, least(len(w), 10) AS n
      FROM items, LATERAL (SELECT unnest(range(greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM windows),
    grams AS (
      SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase
      FROM docs, sizes, LATERAL (SELECT unnest(range(len(w) - n + 1)) AS i) WHERE len(w) >= n),
    hits AS (SELECT doc_id, i, g.n, item FROM grams g JOIN windows v ON g.phrase = v.phrase AND g.n = v.n),
    hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + n)) AS k) GROUP BY doc_id),
    hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.toxicity import is_held_out, score_documents, train

    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=TOKEN_LIMIT)


#: Action, host and path of each rule.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.simhash import hexed, near_groups

    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.exact import exact_groups

    rows = exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
      sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.urls import Rule, filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), [Rule(*r) for r in URL_RULES])


def op10_sql() -> str:
    return rf"""
    WITH rules(action, rule_host, rule_path) AS (VALUES {sql_values(URL_RULES)}),
    parts AS (
      SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    judged AS (
      SELECT page_id, {sql_lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
    FROM judged LEFT JOIN LATERAL (
      SELECT rule_host || rule_path AS rule, action FROM rules
      WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC LIMIT 1) AS best ON true"""


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.runs import find_runs, listed_runs, longest_run, with_planted_runs

    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest_run(F.col("runs")).alias("best"), listed_runs(F.col("runs")).alias("listed"), "collapsed_text")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op12_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.ego import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
    WITH RECURSIVE e AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (
      SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN links ON a = r),
    low AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
    n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaestor.llm.kmeans import cluster, with_clusters

    found = with_clusters(spark, cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round spelt out: vectors to their nearest centroid, centroids to the floor of the mean."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x, CAST(best % 64 AS INTEGER) AS j, best // 64 AS d FROM (
          SELECT vec_id, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + j) AS best FROM v, c{r} GROUP BY vec_id))""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT j, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY j, i) GROUP BY j),
            c{r + 1} AS MATERIALIZED (SELECT j, CAST(coalesce(m.c, o.c) AS BIGINT[]) AS c FROM c{r} o LEFT JOIN m{r} m USING (j))""")
    return f"""
    WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, x AS c FROM v QUALIFY j < {k}),
    {", ".join(steps)}
    SELECT vec_id, j AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_chat": op2_chat,
    "op3_ctw_scores": op3_ctw_scores,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_period_runs": op11_period_runs,
    "op12_embedding_links": op12_embedding_links,
    "op13_centroids": op13_centroids,
}


def oracles() -> dict[str, str]:
    return {"op2_chat": op2_sql(), "op4_decontamination": op4_sql(), "op9_exact_dedup": OP9_SQL, "op10_url_filter": op10_sql(), "op12_embedding_links": OP12_SQL, "op13_centroids": op13_sql()}
