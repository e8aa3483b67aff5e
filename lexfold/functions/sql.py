"""SQL functions for users who query in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexfold.functions import vocabulary as v
from lexfold.functions.text import BLANK


def register(spark: SparkSession) -> None:
    """Temporary functions: looks_like_policy(url, title), toolbar_hint(url), severity_rank(severity), clip_text(s, most)."""
    q = lambda s: "r'" + s.replace("'", "\\'") + "'"
    title = f"trim(regexp_replace(coalesce(title, ''), {q(BLANK + '+')}, ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION looks_like_policy(url STRING, title STRING) RETURNS BOOLEAN RETURN coalesce(url, '') RLIKE {q('(?i)' + v.POLICY_URL)} OR {title} RLIKE {q('(?i)' + v.POLICY_TITLE)}")
    signals = " OR ".join(f"contains(coalesce(url, ''), '{s}')" for s in v.TOOLBAR_SIGNALS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION toolbar_hint(url STRING) RETURNS BOOLEAN RETURN {signals}")
    ranks = ", ".join(f"'{s}'" for s in v.SEVERITIES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION severity_rank(severity STRING) RETURNS INT RETURN cast(array_position(array({ranks}), severity) AS INT) - 1")
    n = "octet_length(encode(s, 'UTF-16LE')) / 2"
    cut = "substring(encode(s, 'UTF-16LE'), 1, 2 * most - 2)"
    halved = "substring(hex(substring(encode(s, 'UTF-16LE'), 2 * most - 2, 1)), 1, 2) BETWEEN 'D8' AND 'DB'"
    exact = f"CASE WHEN {halved} THEN concat(decode(substring({cut}, 1, 2 * most - 4), 'UTF-16LE'), '\ufffd') ELSE decode({cut}, 'UTF-16LE') END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clip_text(s STRING, most INT) RETURNS STRING RETURN CASE WHEN {n} > most THEN concat({exact}, '…') ELSE s END")
