"""Registered queries of the training-data operators and their SQL oracles.

``QUERIES[name] = (run(spark, sf_dir), sql or None)``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, html_text, near_dup, packing, periodic_runs, personal_data, quality_model, quality_rules, quotes, ranked_search, secrets, substring_dedup, url_filters

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Run, str | None]] = {}

URL_RULES = [  # host, path, verdict
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = (run, sql)
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_filters", f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, row_number() OVER () AS n,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
m AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC) AS k
      FROM p, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)""")
def _(spark, d):
    return url_filters.judge_urls(table(spark, d, "pages"), url_filters.rule_table(spark, URL_RULES))


@query("op2_minhash_near_dedup")
def _(spark, d):
    return near_dup.near_duplicates(table(spark, d, "documents"), size=3, percent=85)


@query("op8_secret_scans")
def _(spark, d):
    found = secrets.find_secrets(table(spark, d, "documents"))
    spans, base = F.col("secret_spans"), F.filter("secret_spans", lambda s: s.kind < secrets.BASE)
    return found.select(
        "doc_id",
        *[secrets.count_kind(spans, n).alias(f"n_{r.kind}") for n, r in enumerate(secrets.RULES[:secrets.BASE])],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(spans).alias("spans"))


@query("op10_packing")
def _(spark, d):
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


@query("op4_benchmark_decontamination")
def _(spark, d):
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("text_hash")


@query("op3_quality_rules")
def _(spark, d):
    return quality_rules.quality_rules(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op5_substring_dedup")
def _(spark, d):
    return substring_dedup.remove_repeats(table(spark, d, "documents"), window=35, with_text=False).drop("kept_text")


@query("op7_quality_classifier")
def _(spark, d):
    return quality_model.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op6_html_extraction")
def _(spark, d):
    return html_text.extract_text(table(spark, d, "pages"))


@query("op9_chat_formatting")
def _(spark, d):
    return quotes.reply_order(table(spark, d, "conversations"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query("op13_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}'), '{TERM}') AS ts FROM documents),
t AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY r, term),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM (SELECT r, any_value(n) AS n FROM tf GROUP BY r)),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
i AS (SELECT row_number() OVER () AS item, item_id,
             regexp_extract_all(translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}'), '{TERM}') AS ts FROM benchmark),
it AS (SELECT DISTINCT item, item_id, unnest(ts) AS term FROM i),
s AS (SELECT item, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
      FROM it JOIN tf USING (term) JOIN w USING (term), total GROUP BY item, r)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50""")
def _(spark, d):
    return ranked_search.ranked_search(table(spark, d, "documents"), table(spark, d, "benchmark"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """``documents`` whose ids have a checksum that ends in 0 get a periodic tail, as the query asks for."""
    def rewritten(v):
        a = v.g % v.n
        p = 1 + F.floor((v.n - a) / (3 + v.g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), v.n - 1), lambda i: F.element_at(
            v.words, F.when(i < a, i + 1).otherwise(a + (i - a) % p + 1).cast("int"))), " ")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    value = F.transform(F.array(words), lambda w: F.struct(
        w.alias("words"), F.size(w).cast("bigint").alias("n"), F.floor(h / 10).alias("g")))
    tail = F.element_at(F.transform(value, lambda v: F.when(v.n > 0, rewritten(v))), 1)
    return documents.withColumn("text", F.when(h % 10 == 0, F.coalesce(tail, F.col("text"))).otherwise(F.col("text")))


@query("op12_periodic_runs")
def _(spark, d):
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, d, "documents")))

    def ahead(a, b):  # length / period falls, then start and period rise
        return a.length * b.period - b.length * a.period
    order = F.element_at(F.array_sort("runs", lambda a, b: F.when(ahead(a, b) > 0, -1).when(ahead(a, b) < 0, 1).when(
        a.start < b.start, -1).when(a.start > b.start, 1).when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0)), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", F.when(F.size("runs") > 0, order)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op11_personal_data")
def _(spark, d):
    found = personal_data.find_personal_data(table(spark, d, "documents"))
    return found.select(
        "doc_id", *[secrets.count_kind(F.col("base"), n).alias(f"n_{k}") for n, k in enumerate(personal_data.KINDS)],
        F.sha2(personal_data.spans_text(F.col("base")), 256).alias("base_sha256"),
        personal_data.spans_text(F.col("spans")).alias("spans"))
