"""The queries of this folder, each over its whole table, and the SQL that some must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import bpe_rounds, chat_format, hnsw, html_text, language_id, mixing, quality_model, quality_rules, simhash, token_counts, url_filter, vp_clusters, whitening
from aerolith.llm.common import held_out

#: The site rules that op1 is asked to apply.
SITE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

#: Place of the piece vocabulary; every executor has the file.
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.Rule(text, action, site=True) for text, action in SITE_RULES] + url_filter.pattern_rules()
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def _op1_sql() -> str:
    place = "regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)"
    rules = sorted(SITE_RULES, key=lambda r: (-len(r[0]), r[0]))

    def fits(rule: str) -> str:
        return f"(starts_with(host || path, '{rule}') OR (contains(host || path, '.{rule}') AND position('/' IN path) = 1 AND (host = '{rule[: rule.index('/')]}' OR ends_with(host, '.{rule[: rule.index('/')]}')) AND starts_with(path, '{rule[rule.index('/') :]}')))"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    action = " ".join(f"WHEN '{r}' THEN '{a}'" for r, a in rules)
    patterns = sorted(url_filter.pattern_rules(), key=lambda r: r.text)
    pattern = " ".join(f"WHEN regexp_matches(url, '(?s){r.regex()}') THEN '{r.text}'" for r in patterns)
    return f"""
        WITH parts AS (
            SELECT page_id, url,
                coalesce(translate({place}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        ruled AS (SELECT *, CASE {rule} END AS rule FROM parts),
        matched AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {pattern} END END AS pattern FROM ruled)
        SELECT page_id, host, path, rule, pattern,
            CASE WHEN rule IS NOT NULL THEN CASE rule {action} END WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
        FROM matched"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), whole=True)


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), query_divisor=20, k=20)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_OP4_SQL = r"""
    WITH docs AS (
        SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    keyed AS (
        SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || '/' || size::VARCHAR || '/' || coalesce(md5(text), '-')), 1, 12))::BIGINT AS key FROM docs),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
    placed AS (
        SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place, 2.0::DOUBLE * source_size AS most FROM sources),
    weighted AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(place % 3 + 1)::INT] AS weight FROM placed),
    levels AS (
        SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
        FROM weighted WINDOW w AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    final AS (SELECT arg_min(level, (most / weight, place)) FILTER (level * weight <= most) AS level FROM levels),
    targets AS (SELECT l.source, l.source_size, least(l.most, f.level * l.weight) AS target FROM levels l, final f),
    budgets AS (
        SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS rounds FROM targets),
    running AS (
        SELECT source, doc_id, size, coalesce(sum(size) OVER (
            PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
        FROM keyed)
    SELECT r.doc_id, r.size, b.source_size, b.target,
        (b.rounds * r.size + greatest(0, least(r.size, b.budget - b.rounds * b.source_size - r.begin)))::BIGINT AS taken
    FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source"""


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out()))
    return language_id.identify(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, trusted_ids(spark, sf_dir)))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_model.fit(docs.filter(~held_out()), labels.filter(~held_out()))
    return quality_model.score(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_rounds.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_clusters.cluster(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, dims=64, scale=256, salt="2")


def _op11_sql(clusters: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds written out; every vector meets every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS x FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x AS y FROM v QUALIFY c < {clusters})",
    ]
    for k in range(rounds + 1):
        away = "CAST(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        parts.append(f"d{k} AS (SELECT r, c, {away} AS d FROM v, c{k})")
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{k} GROUP BY r)")
        if k < rounds:
            parts.append(f"p{k} AS (SELECT c, unnest(x) AS e, unnest(range(1, {dims + 1})) AS i FROM v JOIN a{k} USING (r))")
            parts.append(f"s{k} AS (SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM p{k} GROUP BY c, i)")
            parts.append(f"m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{k} GROUP BY c)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN m{k} USING (c))")
    return "WITH " + ", ".join(parts) + f"""
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(y, ',')) AS centroid_sha256
        FROM v JOIN a{rounds} USING (r) JOIN c{rounds} USING (c)"""


#: Turns of a conversation that op12 formats beside the table's.
MARKED_CHAT = -7
MARKED_TEXT = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(F.lit(MARKED_CHAT).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED_TEXT).alias("text"))
    chats = chat_format.canonical_turns(rows.unionByName(marked), F.struct("role", "text"), keep=("conv_id", "turn"))
    return chat_format.digests(chat_format.format_pieces(chats))


def _op12_sql() -> str:
    controls = "|".join(first + "\\\\*(?:" + "|".join(re.escape(c[1:]) for c in chat_format.CONTROLS if c[0] == first[-1]) + ")" for first in ("<", "\\["))
    marks = len(chat_format.CHATML.begin) + 1 + len(chat_format.CHATML.end)
    written = lambda c: f"(length({c}) + len(regexp_extract_all({c}, '{controls}')))"
    return rf"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT {MARKED_CHAT}, 0, 'user', '{MARKED_TEXT}' UNION ALL SELECT {MARKED_CHAT}, 1, 'assistant', '{MARKED_TEXT}'),
        marked AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS role_written FROM rows)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum({marks} + {written('text')} + {written('role_written')})::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_token_counts,
        op3_nearest_vectors,
        op4_source_mix,
        op5_html_text,
        op6_language_id,
        op7_quality_rules,
        op8_simhash_dedup,
        op9_quality_model,
        op10_sentencepiece,
        op11_centroid_clusters,
        op12_chat_format,
        op13_whitening,
    )
}

SQL: dict[str, str] = {"op1_url_filter": _op1_sql(), "op4_source_mix": _OP4_SQL, "op11_centroid_clusters": _op11_sql(), "op12_chat_format": _op12_sql()}
