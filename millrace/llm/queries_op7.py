"""op7_url_filter over the whole of pages."""

from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .url_filter import DOMAIN_RULES, PATTERN_RULES, judge_urls


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_BY_LENGTH = sorted(DOMAIN_RULES, key=lambda r: -len(r.host + r.path))
_LOWER = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op7_url_filter": f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
placed AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(r.host, r.path)} THEN '{r.host + r.path}'" for r in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(r.host, r.path)} THEN '{r.verdict}'" for r in _BY_LENGTH)}
       {" ".join(f"WHEN regexp_matches({_LOWER}, '{r.pattern}') THEN '{r.verdict}'" for r in PATTERN_RULES)}
       ELSE 'allow' END AS verdict
FROM placed"""
}
