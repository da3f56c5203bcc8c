"""Registered queries of the numbered operators, over whole tables, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesieve.llm import toxicity, whitening
from pagesieve.llm.cminhash import similar_classes
from pagesieve.llm.decontaminate import contaminated
from pagesieve.llm.langid import identify
from pagesieve.llm.licenses import scan_licenses
from pagesieve.llm.lines import drop_shared_lines
from pagesieve.llm.mixing import plan_mixture
from pagesieve.llm.preferences import format_preferences, preference_pairs, rendered
from pagesieve.llm.quality import judge
from pagesieve.llm.simhash import near_duplicates
from pagesieve.llm.suffixes import remove_repeats
from pagesieve.llm.trie import conversation_trie
from pagesieve.llm.util import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_preference_format", r"""
WITH conv AS MATERIALIZED (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), led AS (
  SELECT *, first_value(conv_id) OVER (PARTITION BY turns[1] ORDER BY len(turns) DESC, conv_id) AS chosen_id FROM conv
), answered AS (
  SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS a FROM led WHERE conv_id = chosen_id
), pairs AS (
  SELECT led.conv_id, chosen_id, 'sibling' AS kind, conv.turns AS c, led.turns AS r
  FROM led JOIN conv ON conv.conv_id = chosen_id WHERE led.conv_id <> chosen_id
  UNION ALL
  SELECT conv_id, chosen_id, 'stale', turns[1:a[-1]],
    list_append(turns[1:a[-1] - 1], {'role': 'assistant', 'text': coalesce(CASE WHEN len(a) > 1 THEN turns[a[-2]].text END, '')})
  FROM answered WHERE len(a) > 0
), clean AS (
  SELECT conv_id, chosen_id, kind,
    list_transform(c, lambda t: {'role': coalesce(t.role, 'user'), 'text': coalesce(t.text, '')}) AS c,
    list_transform(r, lambda t: {'role': coalesce(t.role, 'user'), 'text': coalesce(t.text, '')}) AS r FROM pairs
), cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])), len(c) + 1) - 1 AS n FROM clean
)
SELECT conv_id, chosen_id, kind, n::INT AS n_shared,
  sha256(array_to_string(list_transform(c[1:n], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '')) AS prompt_sha256,
  sha256(array_to_string(list_transform(c[n + 1:], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '')) AS chosen_sha256,
  sha256(array_to_string(list_transform(r[n + 1:], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '')) AS rejected_sha256,
  array_to_string(list_transform(c[n + 1:], lambda t: (13 + length(t.role)) || '- ' || (11 + length(t.text)) || CASE WHEN t.role = 'assistant' THEN '+' ELSE '-' END), ' ') AS chosen_mask,
  array_to_string(list_transform(r[n + 1:], lambda t: (13 + length(t.role)) || '- ' || (11 + length(t.text)) || CASE WHEN t.role = 'assistant' THEN '+' ELSE '-' END), ' ') AS rejected_mask
FROM cut
""")
def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask names each segment's length and whether it is trained (+) or not (-)."""
    out = format_preferences(preference_pairs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))

    def mask(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat(F.length(s["text"]).cast("string"), F.when(s["train"], "+").otherwise("-"))), " ")

    return out.select(
        "conv_id", "chosen_id", "kind", "n_shared", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"),
        *[F.sha2(rendered(F.col(f"{c}_segments")).cast("binary"), 256).alias(f"{c}_sha256") for c in ("chosen", "rejected")],
        *[mask(f"{c}_segments").alias(f"{c}_mask") for c in ("chosen", "rejected")])


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op6_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, len(ls) AS n_lines, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, min(n_lines) AS n_lines, count(keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL), '')) AS kept_sha256
FROM (SELECT keyed.*, CASE WHEN keeper <> doc_id THEN keeper END AS keeper FROM keyed LEFT JOIN shared USING (k))
GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


@query("op7_quality_divergence")
def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op8_decontamination", r"""
WITH items AS (
  SELECT item_id, ws, least(len(ws), 5) AS k
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark) WHERE len(ws) > 0
), item_grams AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM items)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL
), doc_grams AS (
  SELECT DISTINCT doc_id, 5 AS k, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM doc_words)
  UNION ALL  -- items of fewer than five words as whole lines
  SELECT DISTINCT doc_id, len(ws) AS k, array_to_string(ws, ' ') AS g
  FROM (SELECT doc_id, regexp_extract_all(unnest(string_split(lower(text), chr(10))), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL)
  WHERE len(ws) < 5
), shared AS (
  SELECT doc_id, item_id, count(*) AS n FROM doc_grams JOIN item_grams USING (k, g) GROUP BY ALL
)
SELECT doc_id, item_id, shared.n / sizes.n AS containment
FROM shared JOIN (SELECT item_id, count(*) AS n FROM item_grams GROUP BY item_id) sizes USING (item_id)
WHERE shared.n / sizes.n >= 0.8
""")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).drop("version")


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_temperature_mixing", r"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents
), src AS MATERIALIZED (
  SELECT source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY source HAVING sum(n_tokens) > 0
), totals AS MATERIALIZED (
  SELECT sum(tokens)::BIGINT AS total, max(tokens)::DOUBLE AS largest, count(*) AS n FROM src
), grid AS (  -- both limits by plain bisection
  SELECT 0 AS step, 0.0::DOUBLE AS lo_e, 1.0::DOUBLE AS hi_e, 0.0::DOUBLE AS lo_r, 1.0::DOUBLE AS hi_r
  UNION ALL
  SELECT step + 1, CASE WHEN ent >= 0.97 * ln(n) THEN (lo_e + hi_e) / 2 ELSE lo_e END,
    CASE WHEN ent >= 0.97 * ln(n) THEN hi_e ELSE (lo_e + hi_e) / 2 END,
    CASE WHEN rep > 4 THEN (lo_r + hi_r) / 2 ELSE lo_r END, CASE WHEN rep > 4 THEN hi_r ELSE (lo_r + hi_r) / 2 END
  FROM (
    SELECT step, lo_e, hi_e, lo_r, hi_r, any_value(n) AS n,
      ln(sum(pow(tokens / largest, (lo_e + hi_e) / 2)))
        - sum(pow(tokens / largest, (lo_e + hi_e) / 2) * ln(pow(tokens / largest, (lo_e + hi_e) / 2))) / sum(pow(tokens / largest, (lo_e + hi_e) / 2)) AS ent,
      any_value(total) * max(pow(tokens / largest, (lo_r + hi_r) / 2) / tokens) / sum(pow(tokens / largest, (lo_r + hi_r) / 2)) AS rep
    FROM grid, src, totals WHERE step < 30 GROUP BY step, lo_e, hi_e, lo_r, hi_r
  )
), plain AS (
  SELECT ln(sum(tokens / largest)) - sum(tokens / largest * ln(tokens / largest)) / sum(tokens / largest) AS ent, any_value(n) AS n FROM src, totals
), by_entropy AS (
  SELECT CASE WHEN plain.n < 2 OR plain.ent >= 0.97 * ln(plain.n) THEN 1.0 ELSE lo_e END AS a, hi_r, plain.n AS n
  FROM grid, plain WHERE step = 30
), chosen AS (
  SELECT CASE WHEN any_value(by_entropy.n) < 2 THEN 1.0
    WHEN any_value(total) * max(pow(tokens / largest, a) / tokens) / sum(pow(tokens / largest, a)) <= 4 THEN any_value(a)
    ELSE any_value(hi_r) END AS a
  FROM by_entropy, src, totals
), budgets AS MATERIALIZED (
  SELECT *, floor(weight * total)::BIGINT AS budget, ceil(tokens / 200000)::BIGINT AS blocks
  FROM (SELECT source, tokens, total, round(pow(tokens / total::DOUBLE, a) / sum(pow(tokens / total::DOUBLE, a)) OVER (), 9) AS weight FROM src, totals, chosen)
), in_block AS MATERIALIZED (
  SELECT docs.*, hash % blocks AS block FROM docs JOIN budgets USING (source)
), placed AS MATERIALIZED (
  SELECT *, epoch * tokens + coalesce(sum(block_tokens) OVER (
      PARTITION BY source, epoch ORDER BY ord, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (
    SELECT *, ('0x' || substr(md5('17:' || source || ':' || epoch || ':' || block), 1, 15))::BIGINT AS ord
    FROM (SELECT source, block, sum(n_tokens)::BIGINT AS block_tokens FROM in_block GROUP BY ALL) JOIN (
      SELECT *, unnest(range(ceil(budget / tokens)::BIGINT)) AS epoch FROM budgets) USING (source)
  )
)
SELECT doc_id, source, n_tokens, weight, epoch::INT AS epoch, block, round(before / budget, 9) AS slot
FROM (
  SELECT *, before + block_tokens > budget AS partial, sum(n_tokens) OVER (
    PARTITION BY source, block, epoch ORDER BY hash, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS used
  FROM in_block JOIN placed USING (source, block) WHERE before < budget
) WHERE NOT partial OR used <= budget - before
""")
def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op11_minhash_near_dedup")
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_conversation_trie", r"""
WITH turns AS MATERIALIZED (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''),
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (  -- crc32 bit by bit: each byte is followed by seven zeros
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 4 AS h FROM turns
), rebuilt AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.ts, [])[:c.h], c.ts[c.h + 1:]) AS ts
  FROM heads c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 20
), nodes AS MATERIALIZED (
  SELECT ts[:d] AS path, d AS depth, count(*) AS n, min(conv_id) AS conv_id,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(ts) = d) AS ends, bool_and(len(ts) = d) AS leaf
  FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM rebuilt) GROUP BY 1, 2
), spread AS (
  SELECT path[:a] AS path, a AS depth, count(*) FILTER (WHERE depth = a + 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves,
    sum(CASE WHEN depth = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM nodes) GROUP BY 1, 2
)
SELECT nodes.conv_id, nodes.depth, parent.conv_id AS parent_conv_id, nodes.n AS n_convs, n_children, n_leaves, saved_tokens,
  sha256(coalesce(nodes.ends, '')) AS ends_sha256
FROM nodes JOIN spread ON spread.depth = nodes.depth AND spread.path = nodes.path
LEFT JOIN nodes parent ON parent.depth = nodes.depth - 1 AND parent.path = nodes.path[:nodes.depth - 1]
""")
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact deviation as a long; null where it is none."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whitening.whiten(rows, whitening.fit(rows))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
