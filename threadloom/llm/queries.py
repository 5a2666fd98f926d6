"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import (
    decontamination, exact_dedup, html_extraction, language_id, license_scan, line_dedup, ngram_join, packing, resampling, source_divergence,
    token_counts, toxicity, url_filters,
)
from threadloom.llm.common import table
from threadloom.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(apply_settings(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packing.digest(pieces)


@query("op3_exact_dedup", """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


URL_RULES = (
    url_filters.Rule("allow", "org/"), url_filters.Rule("block", "example.org/es/"),
    url_filters.Rule("block", "example.org/en/1"), url_filters.Rule("allow", "com/fr/"),
    url_filters.Rule("block", "com/de/"),
)


@query("op4_url_filters")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page counts as one to block if the document of its id is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out()
    prototypes = language_id.learn(docs.where(~out))
    return language_id.predict(docs.select("doc_id", "text"), prototypes).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, sf_dir, "documents"), license_scan.templates_table(spark))


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query("op11_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language_id.held_out()
    model = toxicity.learn(docs.where(~out), labels)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


@query("op13_source_divergence", r"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS doc
               FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    w AS (SELECT lang, source, doc, unnest(words) AS term FROM d),
    t AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
    k AS (SELECT lang, source, term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY lang, source, term),
    l AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM t GROUP BY lang),
    s AS (SELECT g.lang, g.source, coalesce(max(l.v), 0) AS v, coalesce(max(l.total), 0) AS lang_total, coalesce(sum(k.n), 0) AS total
          FROM g LEFT JOIN l USING (lang) LEFT JOIN k USING (lang, source) GROUP BY g.lang, g.source),
    p AS (SELECT s.lang, s.source, t.term, coalesce(k.n, 0) AS n,
                 1 + (1000000000 * (coalesce(k.n, 0) + 5)::HUGEINT) // (s.total + 5 * s.v) AS p,
                 1 + (1000000000 * (t.lang_n + 5)::HUGEINT) // (s.lang_total + 5 * s.v) AS q
          FROM s JOIN t USING (lang) LEFT JOIN k USING (lang, source, term)),
    pair AS (SELECT a.lang, a.source, b.source AS item,
                    coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                              WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
             FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source),
    r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value,
           (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
    FROM r QUALIFY part = 'pair' OR rank <= 50
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))
