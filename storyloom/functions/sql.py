"""The column helpers as SQL functions, for queries that users write.

They are plain SQL expressions, which the optimiser inlines: no Python runs, and filters on them are pushed as any.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "norm_strip": ("x STRING", "STRING", "regexp_replace(lower(x), '[^a-z0-9 ]', '')"),
    "norm_collapse": ("x STRING", "STRING", "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' '))"),
    "quote_norm": ("x STRING", "STRING", r"lower(trim(regexp_replace(translate(x, '‘’“”–—', '\'\'\"\"--'), '\\s+', ' ')))"),
    "slugify": ("x STRING", "STRING", "regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-'), '^-+|-+$', '')"),
    "range_is_empty": ("lo INT, hi INT", "BOOLEAN", "coalesce(lo >= hi, false)"),
    "range_contains": ("lo INT, hi INT, at INT", "BOOLEAN", "coalesce(lo <= at, true) AND coalesce(at < hi, true)"),
    "range_overlaps": ("a_lo INT, a_hi INT, b_lo INT, b_hi INT", "BOOLEAN", "coalesce(a_lo < b_hi, true) AND coalesce(b_lo < a_hi, true) AND NOT coalesce(a_lo >= a_hi, false) AND NOT coalesce(b_lo >= b_hi, false)"),
    "range_gloss": (
        "lo INT, hi INT", "STRING",
        "CASE WHEN lo IS NULL AND hi IS NULL THEN 'all positions' WHEN lo >= hi THEN 'no position' WHEN hi IS NULL THEN 'pos ' || lo || ' onward' "
        "WHEN lo IS NULL THEN 'through pos ' || (hi - 1) WHEN lo = hi - 1 THEN 'pos ' || lo ELSE 'pos ' || lo || '–' || (hi - 1) END",
    ),
    "severity_rank": ("severity STRING", "INT", "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; their names."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
