"""Queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, lm_scoring, matroska, secret_scan, sharding, sort_means

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


#: The conversation that op4 formats beside the table's.
PROBE = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    probe = spark.range(1).select(both.alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(PROBE).alias("text"))
    return chat_format.digest(chat_format.format_conversations(chat_format.conversation_events(rows.unionByName(probe))))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_texts(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return got.drop("token_ids")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(documents.drop("lang"), language_id.fit(documents))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents"))


FUNCTIONS = (op1_html_extract, op2_decontaminate, op3_lm_scoring, op4_chat_format, op5_matroska, op6_bpe, op7_jaccard_join, op8_secret_scan, op9_language_id, op10_jump_hash, op11_sort_means, op12_collocations, op13_exact_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in FUNCTIONS}


#: Words as the operators take them: A-Z in lower case, parted by ASCII white space.
WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""


def _lm_sql(order: int, alpha: float) -> str:
    """Stupid backoff with the document's own n-grams left out, for each order."""
    run = lambda first, last: " || ' ' || ".join(f"w{i}" for i in range(first, last - 1, -1))
    lags = ", ".join(f"lag(word, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{i}" for i in range(1, order))
    grams = f""", words AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
        lagged AS MATERIALIZED (SELECT doc_id, pos, word AS w0{", " if lags else ""}{lags} FROM words)""" + "".join(
        f""", g{k} AS MATERIALIZED (SELECT doc_id, pos, {run(k - 1, 0)} AS g, {run(k - 1, 1) if k > 1 else "''"} AS ctx FROM lagged WHERE w{k - 1} IS NOT NULL),
        o{k} AS MATERIALIZED (SELECT doc_id, g, count(*) AS c FROM g{k} GROUP BY 1, 2),
        c{k} AS MATERIALIZED (SELECT o.doc_id, o.g, t.c - o.c AS c FROM o{k} o JOIN (SELECT g, sum(c) AS c FROM o{k} GROUP BY 1) t USING (g))"""
        for k in range(1, order + 1)
    )
    joined = "\n".join(f"LEFT JOIN (SELECT g{k}.doc_id, g{k}.pos, c{k}.c, {f'x.c' if k > 1 else 'NULL'} AS ctx FROM g{k} JOIN c{k} USING (doc_id, g) {f'JOIN c{k - 1} x ON x.doc_id = g{k}.doc_id AND x.g = g{k}.ctx' if k > 1 else ''}) p{k} ON p{k}.doc_id = g1.doc_id AND p{k}.pos = g1.pos" for k in range(1, order + 1))
    cases = " ".join(
        f"WHEN p{k}.c > 0 THEN power({alpha}, least({order}, g1.pos) - {k}) * p{k}.c / {'p%d.ctx' % k if k > 1 else 'n.rest'}" for k in range(order, 0, -1)
    )
    return f"""
        WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
        n AS MATERIALIZED (SELECT doc_id, len(ws) AS n, greatest((SELECT sum(len(ws)) FROM w) - len(ws), 1)::DOUBLE AS rest FROM w)
        {grams},
        s AS (SELECT g1.doc_id, log10(CASE {cases} ELSE power({alpha}, least({order}, g1.pos)) / n.rest END) AS s FROM g1 JOIN n ON n.doc_id = g1.doc_id {joined})
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_tokens, round(coalesce(s.s, 0), 6) AS logprob, round(s.s / n.n, 6) AS mean_logprob
        FROM n LEFT JOIN (SELECT doc_id, sum(s) AS s FROM s GROUP BY 1) s ON s.doc_id = n.doc_id"""


def _components_sql(table: str, width: int, percent: int) -> str:
    """(doc_id, n_shingles, component_id) of a table's documents, by all pairs that share a shingle."""
    run = " || ' ' || ".join(f"ws[i + {k}]" for k in range(width))
    return f"""
        w AS (SELECT doc_id, {WORDS} AS ws FROM {table}),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: {run}) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        components AS (SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = w.doc_id), w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id))"""


def _means_sql(k: int, rounds: int, seed: int, scale: int, dimensions: int) -> str:
    """k-means by all distances, a table for each round's centroids and assignments."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = f"""
        c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL) WHERE c < {k})"""
    for i in range(rounds + 1):
        steps += f""",
        a{i} AS MATERIALIZED (SELECT n, vec_id, v.x, c, {apart} AS d FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)"""
        if i < rounds:
            steps += f""",
        s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY 1, 2),
        m{i} AS (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY j) AS x FROM s{i} GROUP BY 1),
        c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)"""
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),{steps}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


ORACLE = {
    "op11_sort_means": _means_sql(sort_means.CLUSTERS, sort_means.ROUNDS, sort_means.SEED, sort_means.SCALE, sort_means.DIMENSIONS),
    "op12_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
        f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY 1, 2),
        f2 AS MATERIALIZED (SELECT lang, x.a AS a, x.b AS b, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: {'a': ws[i], 'b': ws[i + 1]})) AS x FROM w) GROUP BY 1, 2, 3 HAVING count(*) >= 10),
        f3 AS MATERIALIZED (SELECT lang, x.a AS a, x.b AS b, x.c AS c, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]})) AS x FROM w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
        inner2 AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY 1, 2, 3),
        cuts AS (
            SELECT t.lang, t.a || ' ' || t.b AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k
            FROM f2 t JOIN f1 x ON x.lang = t.lang AND x.x = t.a JOIN f1 y ON y.lang = t.lang AND y.x = t.b
                LEFT JOIN inner2 i ON i.lang = t.lang AND i.a = t.a AND i.b = t.b
            WHERE i.f IS NULL OR 100 * i.f < 50 * t.f
            UNION ALL SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, x.f, y.f, 1
            FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.x = t.a JOIN f2 y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
            UNION ALL SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, x.f, y.f, 2
            FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b JOIN f1 y ON y.lang = t.lang AND y.x = t.c),
        scored AS (SELECT lang, phrase, a, l, r, k, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
    "op3_lm_scoring": _lm_sql(lm_scoring.ORDER, lm_scoring.ALPHA),
    "op7_jaccard_join": f"WITH RECURSIVE {_components_sql('documents', 4, 85)} SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id FROM components",
    "op4_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        coded AS (
            SELECT *, length('<turn ' || role || '>' || chr(10)) + length(chr(10) || '</turn>' || chr(10)) + length(text)
                + (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', ''))) AS chars
            FROM rows)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM coded GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
