"""op12_conversation_repair over the whole of conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import repair
from .shared import table


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here: the rows after damage; dropped ones stay with here = false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(space("role"))
    times = F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("what", what).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") != 0).alias("here"), F.explode(times)).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair(rows, present=F.col("here"))


SQL = {
    "op12_conversation_repair": r"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
-- CRC-32, bit by bit: each byte is mixed in, then eight shifts (-1).
hashed AS (
  SELECT *, xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(unicode(substr(k, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS h FROM spaced),
damaged AS (
  SELECT row_number() OVER () AS n, conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) WHERE h <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) AS seen,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS before FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM ordered),
next_state(s, role, t) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
full_role(initial, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
inserts AS (
  SELECT s, s AS t, 0 AS paid, '' AS label, '' AS line FROM (VALUES (''), ('s'), ('u'), ('a')) v(s)
  UNION ALL SELECT s, t, 5, 'I', name || ':' || chr(10) FROM next_state JOIN full_role ON initial = role),
edits AS (
  SELECT s, s AS t, 2 AS paid, 'D' AS label, NULL AS initial FROM (VALUES (''), ('s'), ('u'), ('a')) v(s)
  UNION ALL SELECT s, t, 0, 'K', role FROM next_state
  UNION ALL SELECT s, t, 1, 'R', role FROM next_state WHERE role <> 's'),
path AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM conversations
  UNION ALL
  SELECT conv_id, pos, state, best.cost, best.audit, best.lines FROM (
    SELECT p.conv_id, r.pos, e.t AS state, min({'cost': p.cost + i.paid + e.paid + CASE WHEN r.fault = 'truncated' AND e.label <> 'D' THEN 5 ELSE 0 END,
      'audit': p.audit || i.label || e.label,
      'lines': p.lines || i.line || CASE e.label WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE f.name || ':' || r.text || chr(10) END}) AS best
    FROM path p JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos + 1
      JOIN inserts i ON i.s = p.state
      JOIN edits e ON e.s = i.t AND (e.label = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (e.label = 'R' OR e.initial = left(r.role, 1)))
      LEFT JOIN full_role f ON f.initial = e.initial
    GROUP BY ALL)),
sizes AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1),
ended AS (
  SELECT p.conv_id, min({'cost': cost + CASE WHEN state = 'u' THEN 5 ELSE 0 END, 'audit': audit || CASE WHEN state = 'u' THEN 'I' ELSE '' END,
    'lines': lines || CASE WHEN state = 'u' THEN 'assistant:' || chr(10) ELSE '' END}) AS best
  FROM path p LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM p.conv_id WHERE pos = coalesce(n, 0) AND state <> 's' GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(CASE WHEN best.lines = '' THEN '' ELSE left(best.lines, length(best.lines) - 1) END) AS repaired_sha256
FROM ended e LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM e.conv_id"""
}
