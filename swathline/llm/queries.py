"""The operators of this folder as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, html_extract, langid, license_scan, packing, quality_lm, quality_rules, simhash, token_counts, topk, url_filter, whitening
from .common import table

#: A document is held out of training if crc32 of its id, as text, leaves 2 by 4.
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


#: Rules of op5: host and path prefix, with the verdict.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = f"coalesce({HELD_OUT}, true)"
    return langid.predict(docs, langid.train(docs.where(f"not {held_out}")), held_out)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_extraction": op4_html_extraction,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_token_counts": op12_token_counts,
    "op13_alignment": op13_alignment,
}


def _url_sql() -> str:
    """The rules as a chain of cases, longest first."""
    split = {r: url_filter.split_rule(r) for r in sorted(URL_RULES, key=len, reverse=True)}
    fits = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}'" for r, (h, p) in split.items())
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES.items())
    return f"""
        WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        judged AS (SELECT *, CASE {fits} END AS rule FROM split)
        SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE 'allow' END AS verdict FROM judged"""


ORACLE: dict[str, str] = {
    "op1_exact_top_k": """
        WITH valid AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        parts AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS x FROM valid),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT * FROM ranked WHERE rank <= 20""",
    "op5_url_filter": _url_sql(),
}
