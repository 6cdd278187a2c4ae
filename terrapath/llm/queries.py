"""Registered queries of the corpus operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapath.llm import chaining, chat_tree, decontaminate, divergence, infill, language, mixing, sharding, simhash, sketch, suffix, toxicity, url_filter
from terrapath.llm.common import table

#: Rules of the URL query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
#: The mixing query and the pipeline show no source more than twice.
REPETITION = 2.0
SHARDS = 24


def url_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, action)")


def part_of(column: str, parts: int) -> Column:
    """Remainder of the CRC-32 of an id's text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.where(part_of("doc_id", 3) != 1)
    found = language.identify(docs.select("doc_id", "text"), language.train(language.sample_labelled(learned)))
    return found.select("doc_id", F.coalesce(part_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.shared_passages(table(spark, sf_dir, "documents"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict:
    """Trained without the rows that are held out."""
    return toxicity.learn(docs, labels.where(part_of("doc_id", 5) != 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(part_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.Target(repetition=REPETITION))
    return mixed.select(
        "doc_id", "source", F.round("share", 6).alias("share"), F.round("exponent", 6).alias("exponent"),
        F.round("weight", 6).alias("weight"), F.round("repetition", 6).alias("repetition"), "block", "place", "copies",
    )


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.assign_shards(docs, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


def op11_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = ", ".join(f"(-7L, {i}L, '{role}', '</s>[INST] ok [/INST]')" for i, role in enumerate(("user", "assistant")))
    own = spark.sql(f"SELECT * FROM VALUES {rows} AS chat(conv_id, turn, role, text)")
    return chat_tree.read_back(chat_tree.build(chats.unionByName(own)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    restored = infill.restore(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


MIX_SQL = f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens,
         ('0x' || substr(md5('7' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS place
  FROM documents),
totals AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY source),
shares AS (SELECT source, tokens, tokens::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM totals) AS share FROM totals),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END
  FROM (SELECT step, low, high, (low + high) / 2 AS mid,
               (SELECT max(pow(share, (low + high) / 2) / tokens) / min(pow(share, (low + high) / 2) / tokens)
                FROM shares WHERE share > 0) <= {REPETITION} AS fits
        FROM bisect WHERE step < 36)),
found AS (SELECT high AS exponent FROM bisect WHERE step = 36),
powers AS (SELECT source, tokens, share, exponent, CASE WHEN share > 0 THEN pow(share, exponent) ELSE 0 END AS power
           FROM shares, found),
sums AS (SELECT sum(power) AS z, min(CASE WHEN share > 0 THEN power / tokens END) AS least FROM powers),
plan AS (SELECT source, tokens, share, exponent, power / z AS weight,
                CASE WHEN tokens > 0 THEN power / z * (z / least) / tokens ELSE 1.0 END AS repetition
         FROM powers, sums),
shown AS (SELECT d.doc_id, d.source, d.place, p.share, p.exponent, p.weight, p.repetition, floor(p.repetition + 1e-9) AS whole,
                 sum(d.tokens) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                 p.tokens
          FROM counted d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, round(share, 6) AS share, round(exponent, 6) AS exponent, round(weight, 6) AS weight,
       round(repetition, 6) AS repetition, place >> {60 - mixing.BLOCK_BITS} AS block, place,
       (whole + CASE WHEN upto <= (repetition - whole) * tokens THEN 1 ELSE 0 END)::BIGINT AS copies
FROM shown
"""

URL_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS authority,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
named AS (SELECT page_id, translate(authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parsed),
rules(r_host, r_path, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT n.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS place
  FROM named n LEFT JOIN rules r
    ON (n.host = r_host OR ends_with(n.host, '.' || r_host)) AND starts_with(n.path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(action, 'allow') AS verdict FROM fits WHERE place = 1
"""

DIVERGENCE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
words AS (SELECT rid, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
sized AS (
  SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
  FROM groups g LEFT JOIN vocab v USING (lang)),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         (1 + ({divergence.SCALE} * (coalesce(c.n, 0) + 2)::HUGEINT) // (s.total + 2 * s.v))::HUGEINT AS p
  FROM sized s JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
whole AS (
  SELECT lang, term, (1 + ({divergence.SCALE} * (sum(n) + 2)::HUGEINT) // (any_value(t.total) + 2 * any_value(t.v)))::HUGEINT AS q
  FROM counts JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM sized GROUP BY lang) t USING (lang) GROUP BY lang, term),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {
    "op1_language": op1_language,
    "op2_benchmark_leaks": op2_benchmark_leaks,
    "op3_shared_passages": op3_shared_passages,
    "op4_toxicity": op4_toxicity,
    "op5_temperature_mix": op5_temperature_mix,
    "op6_simhash": op6_simhash,
    "op7_fingerprints": op7_fingerprints,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jump_shards": op9_jump_shards,
    "op10_url_rules": op10_url_rules,
    "op11_chat_tree": op11_chat_tree,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {"op5_temperature_mix": MIX_SQL, "op10_url_rules": URL_SQL, "op13_source_divergence": DIVERGENCE_SQL}
