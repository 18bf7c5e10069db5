"""The jobs as registered queries: each runs twice into one new folder of the shared scratch space and gives what stands there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.plans import queries as engine
from lineweave.session import attach, scratch_path

from . import harvest_lines, refresh_networks


def job1_refresh_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(attach(spark), "job1-refresh-networks")
    levels = {name: f"{sf_dir}/{name}.parquet" for name in ("part", "supplier")}
    for _ in range(2):
        refresh_networks.run(spark, f"{sf_dir}/lineitem.parquet", out, levels)
    return refresh_networks.result(spark, out).select("net", "level", F.round("energy", 4).alias("energy"), F.round("unc", 8).alias("unc"))


def job2_harvest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(attach(spark), "job2-harvest-lines")
    for _ in range(2):
        harvest_lines.run(spark, {name: f"{sf_dir}/{name}.parquet" for name in ("documents", "pages")}, out)
    return harvest_lines.profile(spark, out)


#: Closed form of the energies, and least paths by recursion.
JOB1_SQL = engine.solved_networks("en.net, en.level, round(energy, 4) AS energy, round(sqrt(d), 8) AS unc")

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i)(nan|inf|infinity)$"
JOB2_SQL = rf"""
WITH t AS (SELECT 'documents' AS origin, coalesce(source, 'unknown') AS source, text, row_number() OVER () AS rid FROM documents
           UNION ALL SELECT 'pages', 'pages', html, row_number() OVER () FROM pages),
l AS (SELECT origin, source, rid, unnest(string_split_regex(text, '\r\n|\n|\r')) AS value FROM t WHERE text IS NOT NULL),
k AS (SELECT *, regexp_extract_all(value, '[^ \t\n\x0B\f\r]+') AS tok FROM l),
c AS (SELECT origin, source, rid, length(value) AS chars,
             CASE WHEN starts_with(value, repeat('-', 40)) THEN 'divider' WHEN len(tok) = 0 THEN 'blank' WHEN contains(value, '&') THEN 'comment' WHEN starts_with(tok[1], '#') THEN 'marked'
                  WHEN len(tok) < 5 THEN 'short' WHEN len(tok) >= 6 AND regexp_matches(tok[1], '{_NUMBER}') AND regexp_matches(tok[2], '{_NUMBER}') AND regexp_matches(tok[3], '{_NUMBER}') THEN 'data'
                  ELSE 'words' END AS kind FROM k)
SELECT origin, kind, count(*) AS lines, count(DISTINCT rid) AS texts, sum(chars)::BIGINT AS chars, source FROM c GROUP BY origin, source, kind
"""

QUERIES = {"job1_refresh_networks": job1_refresh_networks, "job2_harvest_lines": job2_harvest_lines}
SQL = {"job1_refresh_networks": JOB1_SQL, "job2_harvest_lines": JOB2_SQL}
