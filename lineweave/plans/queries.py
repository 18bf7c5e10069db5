"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can.

Doubles are rounded before they leave, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import floored, hashed, qn_vector, shifted, tag
from ..operators import candidates, dissection, features, metrics, network, simulate, solve, units
from ..session import attach, scratch_path, written
from ..sources import adapters, lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the SQL sides.
T = """t AS (SELECT net, row_number() OVER (PARTITION BY net ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, l_extendedprice AS freq,
 l_discount AS raw_unc, l_tax AS raw_orig, l_discount + 0.01 AS unc, l_tax + 0.01 AS orig_unc, '1 ' || l_partkey AS up, '0 ' || l_suppkey AS low,
 l_returnflag || l_linestatus || '.' || l_linenumber AS ref, l_partkey AS pk, l_suppkey AS sk FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS net FROM lineitem))"""
ENDS = "ends AS (SELECT net, seq, 0 AS side, up AS level, freq, unc FROM t UNION ALL SELECT net, seq, 1, low, freq, unc FROM t)"
POT = "pot AS (SELECT '1 ' || p_partkey AS level, p_retailprice + 20000.0 AS potential FROM part UNION ALL SELECT '0 ' || s_suppkey, s_acctbal FROM supplier)"
TC = f"""{T}, {POT}, c AS (SELECT t.net, t.seq, u.potential - l.potential AS freq, t.unc, t.raw_unc, t.orig_unc, t.up, t.low, t.ref FROM t JOIN pot u ON u.level = t.up JOIN pot l ON l.level = t.low)"""
#: Smallest level of each level's component, then rank of the component.
CC = f"""{T}, {ENDS}, idx AS (SELECT net, level, row_number() OVER (PARTITION BY net ORDER BY min(seq * 2 + side)) - 1 AS idx FROM ends GROUP BY net, level),
 e2 AS (SELECT DISTINCT net, up AS a, low AS b FROM t UNION SELECT DISTINCT net, low, up FROM t),
 cc(net, level, lab) USING KEY (net, level) AS (SELECT net, level, idx FROM idx UNION
   SELECT r.net, r.level, min(cc.lab) FROM cc JOIN e2 ON e2.net = cc.net AND e2.a = cc.level JOIN recurring.cc r ON r.net = e2.net AND r.level = e2.b WHERE cc.lab < r.lab GROUP BY r.net, r.level),
 size AS (SELECT net, lab, count(*) AS n_levels FROM cc GROUP BY net, lab),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY net ORDER BY n_levels DESC, lab) AS comp FROM size),
 comps AS (SELECT cc.net, ranked.comp, ranked.n_levels, idx.idx, cc.level FROM cc JOIN ranked USING (net, lab) JOIN idx ON idx.net = cc.net AND idx.level = cc.level)"""
#: Closed form of the energies of consistent networks.
EN = f"""{CC}, {POT}, c AS (SELECT t.net, t.seq, u.potential - l.potential AS freq, t.unc, t.orig_unc, t.up, t.low, t.ref FROM t JOIN pot u ON u.level = t.up JOIN pot l ON l.level = t.low),
 en AS (SELECT net, comp, idx, level, potential - min(potential) OVER (PARTITION BY net, comp) AS energy FROM comps JOIN pot USING (level))"""


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(attach(spark), sf_dir)
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- sources and filters ---------------------------------------------------------------------------------------------

LINES = f"""{T}, raw AS (SELECT net, seq, concat_ws(' ', freq::DECIMAL(18,2)::VARCHAR, raw_orig::DECIMAL(18,2)::VARCHAR, raw_unc::DECIMAL(18,2)::VARCHAR, up, low, ref) AS line FROM t),
 ln AS (SELECT net, seq AS line_no, CASE seq % 20 WHEN 3 THEN line || ' & note' WHEN 5 THEN '# ' || line WHEN 7 THEN '1.0 2.0 3.0 x' WHEN 9 THEN '  ' WHEN 11 THEN chr(9) || '-' || line ELSE line END AS value FROM raw),
 tk AS (SELECT net, line_no, regexp_extract_all(value, '\\S+') AS k FROM ln WHERE NOT contains(value, '&')),
 ok AS (SELECT net, line_no, k, (k[1])::DOUBLE AS freq FROM tk WHERE len(k) >= 5 AND NOT starts_with(k[1], '#')),
 p AS (SELECT net, line_no AS seq, freq, CASE WHEN k[3]::DOUBLE = 0 THEN 1e-6 ELSE k[3]::DOUBLE END AS unc, k[2]::DOUBLE AS orig_unc, k[4] || ' ' || k[5] AS upper, k[6] || ' ' || k[7] AS lower, k[8] AS ref, freq < 0 AS excluded FROM ok)"""


@query(f"WITH {LINES} SELECT * FROM p")
def q_scan_filter_lines(spark, sf_dir):
    return lines.parse_native(adapters.native_lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT net, seq, freq, unc, orig_unc, upper, lower, ref FROM p WHERE NOT excluded")
def q_text_round_trip(spark, sf_dir):
    """Through files: one text file set per net, read back with line numbers by split."""
    path = scratch_path(spark, "lines")
    lines.write_lines(adapters.native_lines(spark, sf_dir), path)
    net = F.regexp_extract(F.col("file"), r"net=([^/]*)/", 1)
    parsed = lines.kept(lines.parse_native(lines.read_lines(spark, path, net), nqn=2))
    return parsed


@query(f"WITH {T} SELECT net, seq, CASE WHEN raw_unc = 0 THEN 1e-6 ELSE raw_unc END AS unc FROM t")
def q_unc_floor(spark, sf_dir):
    return adapters.transitions(spark, sf_dir, raw=True).select("net", "seq", floored(F.col("unc")).alias("unc"))


SEGMENTS = {"AF": "MHz", "AO": "cm-1", "NF": "GHz", "NO": "other", "RF": "THz", "RO": "Hz"}


@query(f"""WITH {T}, s(tag, unit) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SEGMENTS.items())}),
 f AS (SELECT tag, CASE unit WHEN 'Hz' THEN 1.0 WHEN 'kHz' THEN 1e3 WHEN 'MHz' THEN 1e6 WHEN 'GHz' THEN 1e9 WHEN 'THz' THEN 1e12 ELSE 2.99792458e10 END::DOUBLE / 2.99792458e10::DOUBLE AS k FROM s)
SELECT net, seq, round(freq * k, 6) AS freq, round(unc * k, 9) AS unc, round(orig_unc * k, 9) AS orig_unc FROM t JOIN f ON f.tag = split_part(ref, '.', 1)""")
def q_unit_convert(spark, sf_dir):
    seg = spark.createDataFrame(list(SEGMENTS.items()), "tag string, unit string")
    return lines.convert_units(adapters.transitions(spark, sf_dir), seg).select("net", "seq", F.round("freq", 6).alias("freq"), F.round("unc", 9).alias("unc"), F.round("orig_unc", 9).alias("orig_unc"))


@query(f"""WITH {T}, m AS (SELECT *, CASE WHEN seq % 50 = 0 THEN up ELSE low END AS lower, CASE WHEN seq % 9 = 4 THEN -freq ELSE freq END AS f FROM t),
 k AS (SELECT CASE WHEN f >= 0 AND up = lower THEN 'self-loop' WHEN split_part(ref, '.', 1) NOT IN ({', '.join(f"'{k}'" for k in list(SEGMENTS)[:4])}) THEN 'missing segment' ELSE 'none' END AS fault FROM m)
SELECT fault, count(*) AS n FROM k GROUP BY fault""")
def q_checked_write(spark, sf_dir):
    """Lines of several faults, written in one pass with what is wrong with each."""
    seg = spark.createDataFrame(list(SEGMENTS.items())[:4], "tag string, unit string")
    t = adapters.transitions(spark, sf_dir).withColumn("lower", F.when(F.col("seq") % 50 == 0, F.col("upper")).otherwise(F.col("lower"))).withColumn("freq", F.when(F.col("seq") % 9 == 4, -F.col("freq")).otherwise(F.col("freq")))
    return lines.write_checked(t, scratch_path(spark, "checked"), seg, fail=False)


@query(f"WITH {T} SELECT split_part(ref, '.', 1) AS tag, count(*) AS n FROM t GROUP BY 1")
def q_tag_counts(spark, sf_dir):
    return adapters.transitions(spark, sf_dir).groupBy(tag(F.col("ref")).alias("tag")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT net, excluded, count(*) AS n, sum(freq::DECIMAL(18,2))::DOUBLE AS total FROM p GROUP BY ALL")
def q_split_excluded(spark, sf_dir):
    parsed = lines.parse_native(adapters.native_lines(spark, sf_dir))
    return parsed.groupBy("net", "excluded").agg(F.count("*").alias("n"), F.sum(F.col("freq").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"WITH {LINES} SELECT net, (min_by(len(k), line_no) - 4) // 2 AS nqn FROM ok GROUP BY net")
def q_nqn_infer(spark, sf_dir):
    first = lines._data_lines(adapters.native_lines(spark, sf_dir)).groupBy("net").agg(F.min_by(F.size("tok"), "line_no").alias("n"))
    return first.select("net", F.floor((F.col("n") - 4) / 2).cast("long").alias("nqn"))


@query(f"WITH {T} SELECT net, up AS level, max_by(freq::DECIMAL(18,2), seq)::DOUBLE AS energy, max_by(unc::DECIMAL(18,2), seq)::DOUBLE AS unc, max_by(seq, seq)::INTEGER AS n_trans FROM t GROUP BY net, up")
def q_levels_last_wins(spark, sf_dir):
    t = adapters.transitions(spark, sf_dir)
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    return lines.parse_native_levels(t.select("net", F.col("seq").alias("line_no"), F.concat_ws(" ", "upper", money("freq"), money("unc"), "seq").alias("value")))


def _mrt(spark, sf_dir):
    t = adapters.transitions(spark, sf_dir)
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    row = F.concat_ws(" ", "net", F.lit("name"), money("freq"), money("unc"), "upper", "lower", "ref")
    value = F.when(F.col("seq").isin(4, 9), F.lit("-" * 60)).when(F.col("seq") == 12, F.lit(" ")).otherwise(row)
    return t.select("net", F.col("seq").alias("line_no"), value.alias("value"))


@query(f"WITH {T} SELECT net, seq, freq::DECIMAL(18,2)::DOUBLE AS freq, unc::DECIMAL(18,2)::DOUBLE AS unc, unc::DECIMAL(18,2)::DOUBLE AS orig_unc, up AS upper, low AS lower, ref, false AS excluded FROM (SELECT *, max(seq) FILTER (seq IN (4, 9)) OVER (PARTITION BY net) AS bar FROM t) WHERE seq > bar AND seq <> 12")
def q_mrt_after_divider(spark, sf_dir):
    return lines.parse_mrt_transitions(_mrt(spark, sf_dir))


# --- units -----------------------------------------------------------------------------------------------------------

#: Units planted in the lines of some tags: factor from 1/cm to the unit in which they are listed.
PLANTED = {"AF": 2.99792458e10 / 1e6, "NO": 2.99792458e10 / 1e9}


def _listed(spark, sf_dir):
    factor = F.lit(1.0)
    for k, v in PLANTED.items():
        factor = F.when(tag(F.col("ref")) == k, F.lit(v)).otherwise(factor)
    c = adapters.consistent(spark, sf_dir)
    return c.select("net", "seq", (F.col("freq") * factor).alias("freq"), (F.col("unc") * factor).alias("unc"), "orig_unc", "upper", "lower", "ref")


_FACTORS = {"cm-1": 1.0, "Hz": 1 / 2.99792458e10, "kHz": 1e3 / 2.99792458e10, "MHz": 1e6 / 2.99792458e10, "GHz": 1e9 / 2.99792458e10, "THz": 1e12 / 2.99792458e10}
UNITS = f"""{TC}, g AS (SELECT net, seq, freq AS diff, split_part(ref, '.', 1) AS tag, freq * {{f}} AS freq, unc * {{f}} AS unc FROM c),
 rep AS (SELECT net, tag, count(*) AS lines, {', '.join(f'count(*) FILTER (abs(freq * {v!r}::DOUBLE - diff) <= 3 * greatest(unc * {v!r}::DOUBLE, 1e-6)) AS "n_{u}"' for u, v in _FACTORS.items())} FROM g GROUP BY net, tag)""".replace(
    "{f}", f"CASE split_part(ref, '.', 1) {' '.join(f'WHEN {k!r} THEN {v!r}::DOUBLE' for k, v in PLANTED.items())} ELSE 1.0 END"
)


@query(f"WITH {UNITS} SELECT * FROM rep")
def q_infer_report(spark, sf_dir):
    return units.unit_report(_listed(spark, sf_dir), adapters.published(spark, sf_dir))


@query(f"""WITH {UNITS}, cand AS ({' UNION ALL '.join(f"SELECT net, tag, '{u}' AS unit, {i} AS o, \"n_{u}\" AS n FROM rep" for i, u in enumerate(_FACTORS))})
SELECT net, tag, unit FROM (SELECT *, row_number() OVER (PARTITION BY net, tag ORDER BY n DESC, o) AS r FROM cand) WHERE r = 1""")
def q_infer_units(spark, sf_dir):
    return units.infer_units(units.unit_report(_listed(spark, sf_dir), adapters.published(spark, sf_dir)))


@query(f"WITH {TC} SELECT c.net, count(*) AS lines, count(*) AS checked, count(*) FILTER (abs(t.freq - c.freq) > 3 * greatest(t.unc, 1e-6)) AS misses FROM c JOIN t USING (net, seq) GROUP BY c.net")
def q_closure(spark, sf_dir):
    return units.closure(adapters.transitions(spark, sf_dir), adapters.published(spark, sf_dir))


# --- components ------------------------------------------------------------------------------------------------------


@query(f"WITH {T}, {ENDS} SELECT net, level, row_number() OVER (PARTITION BY net ORDER BY min(seq * 2 + side)) - 1 AS idx FROM ends GROUP BY net, level")
def q_level_index(spark, sf_dir):
    return network.level_index(adapters.transitions(spark, sf_dir))


@query(f"WITH RECURSIVE {CC} SELECT net, comp, n_levels, idx, level FROM comps")
def q_components(spark, sf_dir):
    return network.components(adapters.transitions(spark, sf_dir))


@query(f"WITH RECURSIVE {CC} SELECT net, comp, n_levels, idx, level FROM comps")
def q_components_distributed(spark, sf_dir):
    return network.components(adapters.transitions(spark, sf_dir), method="distributed")


@query(f"WITH RECURSIVE {CC} SELECT net, comp, n_levels FROM ranked")
def q_component_sizes(spark, sf_dir):
    return network.component_sizes(network.components(adapters.transitions(spark, sf_dir)))


@query(f"WITH RECURSIVE {CC} SELECT t.net, comps.comp, comps.n_levels >= 3 AS solvable, count(*) AS n FROM t JOIN comps ON comps.net = t.net AND comps.level = t.up GROUP BY ALL")
def q_solvable_dropped(spark, sf_dir):
    solvable, dropped = network.split_components(adapters.transitions(spark, sf_dir), minsize=3)
    both = solvable.withColumn("solvable", F.lit(True)).unionByName(dropped.withColumn("solvable", F.lit(False)))
    return both.groupBy("net", "comp", "solvable").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {CC} SELECT t.net, t.seq, t.up AS upper, t.low AS lower FROM t JOIN comps ON comps.net = t.net AND comps.level = t.up WHERE comp = 1")
def q_largest_component(spark, sf_dir):
    return network.largest_component(adapters.transitions(spark, sf_dir)).select("net", "seq", "upper", "lower")


@query(f"WITH {T} SELECT DISTINCT net, least(up, low) AS a, greatest(up, low) AS b FROM t WHERE up <> low")
def q_simple_edges(spark, sf_dir):
    return network.simple_edges(adapters.transitions(spark, sf_dir))


@query(f"WITH {T} SELECT net, seq, 0 AS dir, up AS src, low AS dst FROM t UNION ALL SELECT net, seq, 1, low, up FROM t")
def q_bidirected_edges(spark, sf_dir):
    return network.bidirected(adapters.transitions(spark, sf_dir))


@query(f"""WITH {T}, {POT}, b AS (SELECT net, up AS src, low AS dst FROM t UNION ALL SELECT net, low, up FROM t)
SELECT net, dst AS level, round(avg(potential) + 0.0000123, 4) AS mean FROM b JOIN pot ON pot.level = b.src GROUP BY net, dst""")
def q_neighbor_mean(spark, sf_dir):
    values = adapters.published(spark, sf_dir).withColumnRenamed("energy", "value")
    return network.neighbour_mean(adapters.transitions(spark, sf_dir), values).select("net", "level", F.round(F.col("mean") + 0.0000123, 4).alias("mean"))


# --- solve -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {T}, e AS (SELECT net, up AS i, up AS j, 1 / (unc * unc) AS v FROM t UNION ALL SELECT net, low, low, 1 / (unc * unc) FROM t
 UNION ALL SELECT net, up, low, -1 / (unc * unc) FROM t UNION ALL SELECT net, low, up, -1 / (unc * unc) FROM t) SELECT net, i, j, round(sum(v), 4) AS val FROM e GROUP BY ALL""")
def q_laplacian(spark, sf_dir):
    return solve.laplacian(adapters.transitions(spark, sf_dir)).select("net", "i", "j", F.round("val", 4).alias("val"))


@query(f"WITH {T}, {ENDS} SELECT net, level, round(sum(CASE side WHEN 0 THEN 1 ELSE -1 END * freq / (unc * unc)) + 0.0123, 1) AS rhs FROM ends GROUP BY net, level")
def q_rhs(spark, sf_dir):
    return solve.right_hand_side(adapters.transitions(spark, sf_dir)).select("net", "level", F.round(F.col("rhs") + 0.0123, 1).alias("rhs"))


@query(f"WITH RECURSIVE {EN} SELECT net, comp, level, round(energy, 4) AS energy FROM en")
def q_energies(spark, sf_dir):
    return solve.solve_energies(adapters.consistent(spark, sf_dir)).select("net", "comp", "level", F.round("energy", 4).alias("energy"))


@query(f"WITH RECURSIVE {EN} SELECT net, comp, idx, level, round(energy, 4) AS energy FROM en")
def q_energies_distributed(spark, sf_dir):
    """Elimination in rounds; tasks of 40 levels, so that the networks of these tables are cut into clusters."""
    return solve.solve_energies(adapters.consistent(spark, sf_dir), method="distributed", most=40).withColumn("energy", F.round("energy", 4))


@query(f"WITH RECURSIVE {EN} SELECT net, comp, level, round(energy, 4) AS energy FROM en")
def q_energies_floored(spark, sf_dir):
    """Weights over ten powers of ten: uncertainties as they are, zeros floored."""
    c = adapters.consistent(spark, sf_dir, raw=True).withColumn("unc", floored(F.col("unc")))
    return solve.solve_energies(c).select("net", "comp", "level", F.round("energy", 4).alias("energy"))


@query(f"WITH RECURSIVE {EN} SELECT net, comp, min_by(level, energy * 1e6 + idx * 1e-6) AS level FROM en GROUP BY net, comp")
def q_ground(spark, sf_dir):
    e = solve.solve_energies(adapters.consistent(spark, sf_dir)).withColumn("energy", F.round("energy", 6))
    return solve.ground_levels(e)


@query(f"""WITH {T} SELECT net, up AS upper, low AS lower, count(*) AS n, round(sum(freq / (unc * unc)) / sum(1 / (unc * unc)), 6) AS diff FROM t GROUP BY net, up, low""")
def q_weighted_mean_link(spark, sf_dir):
    """Each pair of levels of every net as a component of its own: the solve is the weighted mean of its lines."""
    pair = F.concat_ws("|", "upper", "lower")
    t = adapters.transitions(spark, sf_dir).withColumn("pair", F.struct("upper", "lower")).withColumns({"upper": F.concat_ws("|", F.lit("u"), pair), "lower": F.concat_ws("|", F.lit("l"), pair)})
    r = solve.residuals(t, solve.solve_energies(t))
    return r.groupBy("net", "pair.upper", "pair.lower").agg(F.count("*").alias("n"), F.round(F.first(F.col("e_upper") - F.col("e_lower")), 6).alias("diff"))


@query(f"WITH {T} SELECT DISTINCT net, 0::BIGINT AS violations FROM t")
def q_normal_eq_residual(spark, sf_dir):
    t = adapters.transitions(spark, sf_dir)
    off = solve.normal_residual(t, solve.solve_energies(t))
    return off.groupBy("net").agg(F.count_if(F.abs("off") > 1e-6).alias("violations"))


_PATHS = """w(net, level, d) USING KEY (net, level) AS (SELECT net, level, d0 FROM (SELECT en.net, en.level, CASE WHEN g.level IS NULL THEN 1e300 ELSE 0.0 END::DOUBLE AS d0 FROM en LEFT JOIN g ON g.net = en.net AND g.level = en.level) UNION
 SELECT r.net, r.level, min(w.d + step.cost) FROM w JOIN step ON step.net = w.net AND step.src = w.level JOIN recurring.w r ON r.net = step.net AND r.level = step.dst WHERE w.d + step.cost < r.d GROUP BY r.net, r.level)"""
_GROUND = "g AS (SELECT net, comp, min_by(level, energy * 1e6 + idx * 1e-6) AS level FROM en GROUP BY net, comp)"


PATH_SQL = f"""WITH RECURSIVE {EN}, {_GROUND}, step AS (SELECT net, up AS src, low AS dst, min(unc * unc) AS cost FROM t GROUP BY ALL UNION ALL SELECT net, low, up, min(unc * unc) FROM t GROUP BY ALL), {_PATHS}
SELECT w.net, w.level, round(sqrt(d), 8) AS sp_unc FROM w"""


def _path_unc(spark, sf_dir, method):
    c = network.parted(adapters.consistent(spark, sf_dir))
    e = written(solve.solve_energies(c).withColumn("energy", F.round("energy", 6)), "energies")
    return solve.path_uncertainty(c, e, method=method).select("net", "level", F.round("sp_unc", 8).alias("sp_unc"))


@query(PATH_SQL)
def q_path_unc(spark, sf_dir):
    return _path_unc(spark, sf_dir, "by_net")


@query(PATH_SQL)
def q_path_unc_distributed(spark, sf_dir):
    return _path_unc(spark, sf_dir, "distributed")


_COST = f"pow(greatest(({_hash('7', chr(39) + 'sp' + chr(39), 'level')} % 1000 + 1) / 1000.0, ({_hash('7', chr(39) + 'boot' + chr(39), 'level')} % 1000 + 1) / 1000.0), 2)"


COMBINED_SQL = f"""WITH RECURSIVE {EN}, {_GROUND}, cost AS (SELECT net, level, {_COST} AS cost FROM en),
 step AS (SELECT DISTINCT t.net, t.up AS src, t.low AS dst, cost.cost FROM t JOIN cost ON cost.net = t.net AND cost.level = t.low UNION SELECT DISTINCT t.net, t.low, t.up, cost.cost FROM t JOIN cost ON cost.net = t.net AND cost.level = t.up), {_PATHS}
SELECT w.net, w.level, round(sqrt(d), 8) AS unc FROM w"""


def _combined_unc(spark, sf_dir, method):
    c = network.parted(adapters.consistent(spark, sf_dir))
    e = written(solve.solve_energies(c).withColumn("energy", F.round("energy", 6)), "energies")
    given = lambda what: (hashed(7, what, F.col("level")) % 1000 + 1) / 1000.0
    costs = e.select("net", "level", given("sp").alias("sp_unc"), given("boot").alias("boot_unc"))
    return solve.combined_uncertainty(c, e, costs, method=method).select("net", "level", F.round("unc", 8).alias("unc"))


@query(COMBINED_SQL)
def q_combined_unc(spark, sf_dir):
    return _combined_unc(spark, sf_dir, "by_net")


@query(COMBINED_SQL)
def q_combined_unc_distributed(spark, sf_dir):
    return _combined_unc(spark, sf_dir, "distributed")


@query(f"""WITH RECURSIVE {EN}, s AS (SELECT net, level, k, energy + ({_hash('3', 'net', 'level', 'k')} % 2001 - 1000) / 1000.0 AS x FROM en, range(9) AS r(k)),
 a AS (SELECT net, level, median(x) AS mid, stddev_samp(x) AS sd FROM s GROUP BY net, level) SELECT net, level, round(sqrt(2.0) * greatest(abs(energy - mid), sd), 4) AS boot_unc FROM a JOIN en USING (net, level)""")
def q_bootstrap_stats(spark, sf_dir):
    """Statistics over given samples: closed-form energies moved by hash."""
    e = written(solve.solve_energies(adapters.consistent(spark, sf_dir)), "energies")  # read twice
    s = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("energy", F.col("energy") + (hashed(3, F.col("net"), F.col("level"), F.col("k")) % 2001 - 1000) / 1000.0)
    return solve.bootstrap_statistics(s, e).select("net", "level", F.round("boot_unc", 4).alias("boot_unc"))


@query(f"WITH {T} SELECT DISTINCT net, 0::BIGINT AS violations FROM t")
def q_bootstrap_tree_zero(spark, sf_dir):
    """Consistent lines give the same energies whatever the uncertainties drawn."""
    c = network.parted(adapters.consistent(spark, sf_dir))
    e = solve.solve_energies(c)
    boot = solve.bootstrap_statistics(solve.bootstrap_samples(c, iterations=4), e)
    return boot.groupBy("net").agg(F.count_if(F.col("boot_unc") > 1e-6).alias("violations"))


def solved_networks(columns: str) -> str:
    """SQL of energies and path uncertainties of consistent networks: ``columns`` of ``en`` and ``w``."""
    step = "step AS (SELECT net, up AS src, low AS dst, min(unc * unc) AS cost FROM t GROUP BY ALL UNION ALL SELECT net, low, up, min(unc * unc) FROM t GROUP BY ALL)"
    return f"WITH RECURSIVE {EN}, {_GROUND}, {step}, {_PATHS} SELECT {columns} FROM en JOIN w ON w.net = en.net AND w.level = en.level"


@query(solved_networks("en.net, en.comp, en.level, round(energy, 4) AS energy, round(sqrt(d), 8) AS unc"))
def q_solve_network(spark, sf_dir):
    s = solve.solve_network(adapters.consistent(spark, sf_dir).withColumn("freq", F.round("freq", 6)))
    return s.select("net", "comp", "level", F.round("energy", 4).alias("energy"), F.round("unc", 8).alias("unc"))


_AGAIN = _PATHS.replace("w(net", "w2(net").replace("min(w.d + step.cost)", "min(w2.d + step2.cost)").replace("FROM w JOIN step ON step.net = w.net AND step.src = w.level JOIN recurring.w r ON r.net = step.net AND r.level = step.dst WHERE w.d + step.cost", "FROM w2 JOIN step2 ON step2.net = w2.net AND step2.src = w2.level JOIN recurring.w2 r ON r.net = step2.net AND r.level = step2.dst WHERE w2.d + step2.cost")
_STEP2 = "step2 AS (SELECT t.net, t.up AS src, t.low AS dst, any_value(w.d) AS cost FROM t JOIN w ON w.net = t.net AND w.level = t.low GROUP BY ALL UNION ALL SELECT t.net, t.low, t.up, any_value(w.d) FROM t JOIN w ON w.net = t.net AND w.level = t.up GROUP BY ALL)"


@query(solved_networks("en.net, en.comp, en.level, round(energy, 4) AS energy, round(sqrt(w2.d), 7) AS unc").replace(" SELECT en.net", f", {_STEP2}, {_AGAIN} SELECT en.net") + " JOIN w2 ON w2.net = en.net AND w2.level = en.level")
def q_solve_network_bootstrap(spark, sf_dir):
    """With bootstrap: consistent lines have no spread, so a level costs the square of its path uncertainty."""
    s = solve.solve_network(adapters.consistent(spark, sf_dir).withColumn("freq", F.round("freq", 6)), bootstrap_iterations=3, seed=2)
    return s.select("net", "comp", "level", F.round("energy", 4).alias("energy"), F.round("unc", 7).alias("unc"))


@query(f"WITH {T}, {ENDS} SELECT DISTINCT net, level, 'published' AS side FROM ends WHERE level LIKE '0 1%'")
def q_levels_diff(spark, sf_dir):
    p = written(adapters.published(spark, sf_dir), "published")  # read twice
    return solve.levels_difference(p.where("level NOT LIKE '0 1%'"), p)


@query(f"""WITH RECURSIVE {EN}, d AS (SELECT net, level, abs(energy - potential) AS diff FROM en JOIN pot USING (level))
SELECT net, round(max(diff), 4) AS max_diff FROM d GROUP BY net""")
def q_worst_level(spark, sf_dir):
    e = solve.solve_energies(adapters.consistent(spark, sf_dir))
    return solve.worst_levels(e, adapters.published(spark, sf_dir)).select("net", F.round("max_diff", 4).alias("max_diff"))


# --- features --------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {EN}, s AS (SELECT net, level, count(*) AS d, min(unc) AS lo, median(unc) AS mid, sum(1 / (unc * unc)) AS load FROM ends GROUP BY net, level)
SELECT net, comp, level, round(split_part(level, ' ', 1)::DOUBLE / 50, 8) AS x0, round(split_part(level, ' ', 2)::DOUBLE / 50, 8) AS x1, round(2 / 7.0, 8) AS x7, round(ln(1 + d), 8) AS x8, round(log10(lo) / 10, 8) AS x9,
 round(log10(mid) / 10, 8) AS x10, round(log10(load) / 10, 8) AS x11, round(ln(1 + round(energy, 4)) / 10, 6) AS x12, 13 AS n FROM en JOIN s USING (net, level)""")
def q_node_features(spark, sf_dir):
    c = adapters.consistent(spark, sf_dir)
    e = solve.solve_energies(c).withColumn("energy", F.abs(F.round("energy", 4)))
    x = features.node_features(c, e)
    cols = [F.round(F.col("x")[i], 6 if i == 12 else 8).alias(f"x{i}") for i in (0, 1, 7, 8, 9, 10, 11, 12)]
    return x.select("net", "comp", "level", *cols, F.size("x").alias("n"))


@query(f"""WITH RECURSIVE {EN}, r AS (SELECT t.net, t.seq, t.unc, t.freq, abs(t.freq - (u.energy - l.energy)) AS resid, ({_hash('5', 't.net', 't.seq')} % 1000) / 1000.0::DOUBLE AS h FROM t JOIN en u ON u.net = t.net AND u.level = t.up JOIN en l ON l.net = t.net AND l.level = t.low)
SELECT net, seq, round(log10(unc) / 10, 6) AS a0, round(ln(1 + freq) / 10, 6) AS a1, round(log10(1 + resid / unc) / 4, 6) AS a2, round(h, 6) AS a3, round(log10(1 + resid / (unc * sqrt(greatest(1 - h, 1e-12)))) / 4, 6) AS a4 FROM r""")
def q_edge_features(spark, sf_dir):
    t = written(adapters.transitions(spark, sf_dir), "lines")  # read three times
    e = written(solve.solve_energies(adapters.consistent(spark, sf_dir, of=t)), "energies")
    given = t.select("net", "seq", ((hashed(5, F.col("net"), F.col("seq")) % 1000) / 1000.0).alias("leverage"))
    a = features.line_features(t, e, given)
    return a.select("net", "seq", *[F.round(F.col("attr")[i], 6).alias(f"a{i}") for i in range(5)])


@query("""SELECT p_partkey || ' ' || p_size || ' 0 0 0 1 ' || CASE p_partkey % 2 WHEN 0 THEN 'e' ELSE 'f' END AS level, p_partkey::DOUBLE AS q0, p_size::DOUBLE AS q1, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS q3, 0.0::DOUBLE AS q4, 1.0::DOUBLE AS q5, (p_partkey % 2)::DOUBLE AS q6 FROM part""")
def q_qn_vector(spark, sf_dir):
    v = adapters.long_keys(spark, sf_dir).withColumn("v", qn_vector(F.col("level")))
    return v.select("level", *[F.col("v")[i].alias(f"q{i}") for i in range(7)])


LEVERAGE_SQL = f"WITH RECURSIVE {CC} SELECT net, (count(*) - count(DISTINCT comp))::BIGINT AS total, 0::BIGINT AS outside FROM comps GROUP BY net"


def _leverage_sum(h):
    return h.groupBy("net").agg(F.round(F.sum("leverage"), 6).cast("long").alias("total"), F.count_if((F.col("leverage") < 0) | (F.col("leverage") > 1)).alias("outside"))


@query(LEVERAGE_SQL)
def q_leverage_sum(spark, sf_dir):
    return _leverage_sum(features.leverages(adapters.transitions(spark, sf_dir)))


@query(LEVERAGE_SQL)
def q_leverage_sum_distributed(spark, sf_dir):
    """By the rounds of the spread elimination, read backwards for resistances."""
    return _leverage_sum(dissection.leverages_spread(adapters.transitions(spark, sf_dir), most=40))


@query(f"WITH {T} SELECT DISTINCT net, 0::BIGINT AS violations FROM t")
def q_bridge_leverage(spark, sf_dir):
    """A lone bridge has leverage 1; parallel lines on a bridge add up to 1; no other line reaches 1."""
    t = network.parted(adapters.transitions(spark, sf_dir))
    pair = features.leverages(t).join(t.select("net", "seq", "upper", "lower"), ["net", "seq"]).groupBy("net", "upper", "lower", "bridge").agg(F.sum("leverage").alias("h"))
    bad = (F.col("bridge") & (F.abs(F.col("h") - 1) > 1e-9)) | (~F.col("bridge") & (F.col("h") > 1 - 1e-9))
    return pair.groupBy("net").agg(F.count_if(bad).alias("violations"))


# --- simulation ------------------------------------------------------------------------------------------------------

_PICK = f"pick AS (SELECT *, row_number() OVER (PARTITION BY net ORDER BY {_hash('11', 'net', '0', 'seq')}, seq) <= greatest(1, round_even(0.05 * count(*) OVER (PARTITION BY net), 0)) AS picked FROM t)"


def _uni(what: str, seed: str = "11") -> str:
    return f"({_hash(seed, repr(what), 'net', '0', 'seq')} / 4294967296.0::DOUBLE)"


_CORRUPT = f"""{T}, {_PICK}, sg AS (SELECT *, CASE WHEN {_uni('sign')} < 0.5 THEN -1 ELSE 1 END AS sign, {_uni('mode')} < 0.5 AS mode FROM pick),
 bump AS (SELECT *, CASE WHEN picked AND mode THEN CASE WHEN pk + sign >= 0 AND '1 ' || (pk + sign) <> low THEN '1 ' || (pk + sign) WHEN pk - sign >= 0 AND '1 ' || (pk - sign) <> low THEN '1 ' || (pk - sign) END END AS nu FROM sg),
 kd AS (SELECT *, CASE WHEN NOT picked THEN 0 WHEN nu IS NOT NULL THEN 2 ELSE 1 END AS kind FROM bump),
 cor AS (SELECT net, 0 AS copy, seq, kind, CASE kind WHEN 1 THEN pow(10.0, log10(5.0) + {_uni('mag')} * (log10(500.0) - log10(5.0))) ELSE 0.0 END AS mag,
   freq, unc, coalesce(nu, up) AS upper, low AS lower, up AS orig_upper, CASE WHEN {_uni('way')} < 0.5 THEN -1.0 ELSE 1.0 END AS way, ref FROM kd)"""


@query(f"WITH {T} SELECT net, seq FROM (SELECT *, row_number() OVER (PARTITION BY net ORDER BY {_hash('5', 'net', 'seq')}, seq) <= greatest(1, round_even(0.15 * count(*) OVER (PARTITION BY net), 0)) AS p FROM t) WHERE p")
def q_mask_sample(spark, sf_dir):
    return simulate.chosen(adapters.transitions(spark, sf_dir), 0.15, 5, "net").where("picked").select("net", "seq")


@query(f"WITH {T}, {_PICK} SELECT net, seq FROM pick WHERE picked")
def q_corrupt_choice(spark, sf_dir):
    return simulate.corrupt(adapters.transitions(spark, sf_dir), seed=11).where("kind > 0").select("net", "seq")


@query(f"WITH {_CORRUPT} SELECT net, copy, seq, kind, round(mag, 6) AS mag, round(freq + CASE kind WHEN 1 THEN way * unc * mag ELSE 0 END, 6) AS freq, upper, lower, orig_upper, ref FROM cor")
def q_corrupt_apply(spark, sf_dir):
    c = simulate.corrupt(adapters.transitions(spark, sf_dir), seed=11)
    return c.select("net", "copy", "seq", F.col("kind").cast("int").alias("kind"), F.round("mag", 6).alias("mag"), F.round("freq", 6).alias("freq"), "upper", "lower", "orig_upper", "ref")


def _main(spark, sf_dir, consistent=True):
    """Main components of all nets, written, as samples fan out from them."""
    source = adapters.consistent if consistent else adapters.transitions
    return written(network.largest_component(source(spark, sf_dir)), "main")


@query(f"""WITH RECURSIVE {EN}, m AS (SELECT c.* FROM c JOIN en ON en.net = c.net AND en.level = c.up WHERE en.comp = 1),
 gr AS (SELECT net, min_by(level, energy * 1e6 + idx * 1e-6) AS ground FROM en WHERE comp = 1 GROUP BY net),
 f AS (SELECT m.*, s.k AS sample FROM m, range(2) AS s(k)),
 kp AS (SELECT net, sample, up, low FROM (SELECT *, row_number() OVER (PARTITION BY net, sample ORDER BY {_hash('9', 'net', 'sample', 'seq')}, seq) <= greatest(1, round_even(0.15 * count(*) OVER (PARTITION BY net, sample), 0)) AS p FROM f) WHERE NOT p),
 k2 AS (SELECT DISTINCT net, sample, up AS a, low AS b FROM kp UNION SELECT DISTINCT net, sample, low, up FROM kp),
 alive(net, sample, level) AS (SELECT DISTINCT k2.net, k2.sample, gr.ground FROM k2 JOIN gr ON gr.net = k2.net AND gr.ground = k2.a UNION SELECT k2.net, k2.sample, k2.b FROM alive JOIN k2 ON k2.net = alive.net AND k2.sample = alive.sample AND k2.a = alive.level)
SELECT net, sample, count(*) AS survivors FROM alive GROUP BY net, sample""")
def q_refit_survival(spark, sf_dir):
    m = _main(spark, sf_dir)
    e = written(solve.solve_energies(m).withColumn("energy", F.round("energy", 6)), "energies")
    return simulate.refit_errors(m, e, n_samples=2, seed=9).groupBy("net", "sample").agg(F.count("*").alias("survivors"))


@query(f"WITH {T} SELECT DISTINCT net, 0::BIGINT AS violations FROM t")
def q_refit_zero_error(spark, sf_dir):
    """Masking lines of a consistent network moves no level that stays with the ground."""
    m = _main(spark, sf_dir)
    e = written(solve.solve_energies(m), "energies")
    err = simulate.refit_errors(m, e, n_samples=2, seed=9, lost=True)
    return err.groupBy("net").agg(F.count_if(F.abs("err") > 1.0).alias("violations"))


@query(f"WITH {T} SELECT DISTINCT net, 0::BIGINT AS violations FROM t")
def q_bridges(spark, sf_dir):
    """Cutting all bridges leaves one component more for each."""
    t = adapters.transitions(spark, sf_dir)
    h = features.leverages(t).select("net", "seq", "bridge")
    cut = t.join(h, ["net", "seq"])
    links = network.simple_edges(cut.where("bridge")).groupBy("net").agg(F.count("*").alias("n_bridges"))
    before = network.components(t).groupBy("net").agg(F.max("comp").alias("a"))
    # levels that lose all lines are components of their own
    kept = network.components(cut.where("not bridge")).groupBy("net").agg(F.max("comp").alias("b"), F.count("*").alias("in_lines"))
    total = network.components(t).groupBy("net").agg(F.count("*").alias("n"))
    j = before.join(total, "net").join(links, "net", "left").join(kept, "net", "left").na.fill(0)
    return j.select("net", F.abs(F.col("b") + F.col("n") - F.col("in_lines") - F.col("a") - F.col("n_bridges")).cast("long").alias("violations"))


@query(f"WITH {T} SELECT DISTINCT net, 0::BIGINT AS violations FROM t")
def q_detach_partition(spark, sf_dir):
    """Parts are complete; the main part is connected and has the ground; orphans have 2 to 25 levels."""
    m = _main(spark, sf_dir)
    e = written(solve.solve_energies(m), "energies")
    d = written(simulate.detached_levels(m, e, seed=4), "detached")
    parts = written(simulate.detached_parts(m, d), "parts")
    lost = m.join(parts, ["net", "seq"], "left_anti").groupBy("net").agg(F.count("*").alias("lost"))
    main = network.is_connected(parts.where("part = 'main'").select(*m.columns)).select("net", (~F.col("connected")).cast("long").alias("split"))
    sizes = d.groupBy("net", "orphan_id").agg(F.count("*").alias("n")).groupBy("net").agg(F.count_if((F.col("n") < 2) | (F.col("n") > 25)).alias("odd"))
    ground = solve.ground_levels(e).join(d.select("net", "level"), ["net", "level"]).groupBy("net").agg(F.count("*").alias("grounded"))
    j = m.select("net").distinct()
    for x in (lost, main, sizes, ground):
        j = j.join(x, "net", "left")
    return j.na.fill(0).select("net", (F.col("lost") + F.col("split") + F.col("odd") + F.col("grounded")).alias("violations"))


# --- candidates and reports ------------------------------------------------------------------------------------------

_CAND = f"""{EN}, off(pos, d) AS (VALUES (0, -2), (1, -1), (2, 1), (3, 2)), asked AS (SELECT t.*, pos, '1 ' || (pk + d) AS cand, abs(d) / 50.0::DOUBLE AS dju, abs(pk + d - sk) / 50.0::DOUBLE AS djl FROM t, off),
 cand AS (SELECT asked.net, seq, pos, cand AS cand_level, dju, djl, log10(1 + abs(x.energy - l.energy - freq) / unc) / 4 AS mismatch, ref, up, low FROM asked JOIN en x ON x.net = asked.net AND x.level = asked.cand JOIN en l ON l.net = asked.net AND l.level = asked.low WHERE cand <> low)"""


def _candidates(spark, sf_dir):
    t = written(adapters.transitions(spark, sf_dir), "lines")  # read twice or more
    e = written(solve.solve_energies(adapters.consistent(spark, sf_dir, of=t)), "energies")
    return t, candidates.correction_candidates(t, e)


@query(f"WITH RECURSIVE {_CAND} SELECT net, seq, pos, cand_level FROM cand")
def q_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)[1].select("net", "seq", "pos", "cand_level")


@query(f"WITH RECURSIVE {_CAND} SELECT net, seq, pos, round(dju, 6) AS dj_upper, round(djl, 6) AS dj_lower, round(mismatch, 5) AS mismatch FROM cand")
def q_candidate_features(spark, sf_dir):
    c = _candidates(spark, sf_dir)[1]
    return c.select("net", "seq", "pos", F.round("dj_upper", 6).alias("dj_upper"), F.round("dj_lower", 6).alias("dj_lower"), F.round("mismatch", 5).alias("mismatch"))


_LOGIT = f"({_hash('21', 'net', 'seq')} % 2001 - 1000) / 500.0"
_CLOGIT = f"({_hash('22', 'net', 'seq', 'pos')} % 2001 - 1000) / 500.0"


@query(f"""WITH RECURSIVE {_CAND}, s AS (SELECT *, {_CLOGIT} AS logit, {_LOGIT} AS ol FROM cand), f AS (SELECT * FROM s WHERE ol > 0)
SELECT net, seq, any_value(ref) AS ref, any_value(up) AS upper, any_value(low) AS lower, max_by(cand_level, logit * 1000 - pos * 0.001) AS proposed_upper, round(1 / (1 + exp(-any_value(ol))), 6) AS outlier_p, round(exp(max(logit)) / sum(exp(logit)), 6) AS confidence FROM f GROUP BY net, seq""")
def q_correction_report(spark, sf_dir):
    t, c = _candidates(spark, sf_dir)
    logit = (hashed(21, F.col("net"), F.col("seq")) % 2001 - 1000) / 500.0
    c = c.withColumn("logit", (hashed(22, F.col("net"), F.col("seq"), F.col("pos")) % 2001 - 1000) / 500.0)
    r = candidates.correction_report(t.withColumn("ol", logit), "ol", c)
    return r.select("net", "seq", "ref", "upper", "lower", "proposed_upper", F.round("outlier_p", 6).alias("outlier_p"), F.round("confidence", 6).alias("confidence"))


_PAIRS = f"""{CC}, o AS (SELECT net, comp AS orphan, level FROM comps WHERE comp > 1 AND n_levels >= 2), m AS (SELECT net, level FROM comps WHERE comp = 1),
 pr AS (SELECT o.net, orphan, o.level AS orphan_level, m.level AS main_level, abs(split_part(o.level, ' ', 1)::DOUBLE - split_part(m.level, ' ', 1)::DOUBLE) AS d0, abs(split_part(o.level, ' ', 2)::DOUBLE - split_part(m.level, ' ', 2)::DOUBLE) AS d1 FROM o JOIN m USING (net)),
 sc AS (SELECT *, -(d1 + 3 * d0) AS logit FROM pr)"""


def _closeness(o, m):
    """Minus the second quantum number's distance and three times the first's."""
    d = abs(m - o)
    return -(d[:, 1] + 3 * d[:, 0])


def _best_pairs(spark, sf_dir, orphans="comp > 1 and n_levels >= 2"):
    c = written(network.components(adapters.transitions(spark, sf_dir)), "comps").withColumn("v", qn_vector(F.col("level")))
    return candidates.best_pairs(c.where(orphans).withColumnRenamed("comp", "orphan"), c.where("comp = 1"), _closeness)


@query(f"WITH RECURSIVE {_PAIRS} SELECT net, orphan, orphan_level, main_level, d0, d1, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY net, orphan ORDER BY logit DESC, orphan_level, main_level) AS r FROM sc) WHERE r <= 5")
def q_pair_features_top5(spark, sf_dir):
    dqn = F.zip_with(qn_vector(F.col("orphan_level")), qn_vector(F.col("main_level")), lambda a, b: F.abs(a - b))
    p = _best_pairs(spark, sf_dir).withColumn("dqn", dqn)
    return p.select("net", "orphan", "orphan_level", "main_level", F.col("dqn")[0].alias("d0"), F.col("dqn")[1].alias("d1"), "rank")


@query(f"WITH RECURSIVE {_PAIRS} SELECT net, orphan, orphan_level, main_level, round(1 / (1 + exp(-logit / 100)), 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY net, orphan ORDER BY 1 / (1 + exp(-logit / 100)) DESC, orphan_level, main_level) AS r FROM sc) WHERE r <= 5")
def q_orphan_report(spark, sf_dir):
    p = _best_pairs(spark, sf_dir).withColumn("logit", F.col("score") / 100).drop("score", "rank")
    return candidates.orphan_report(p, "logit").withColumn("score", F.round("score", 6))


# --- metrics ---------------------------------------------------------------------------------------------------------

_SCORED = f"{_CORRUPT}, sc AS (SELECT *, ({_hash('31', 'net', 'seq')} % 2001 - 1000 + kind * 400) / 1000.0::DOUBLE AS score FROM cor)"


def _scored(spark, sf_dir):
    c = simulate.corrupt(adapters.transitions(spark, sf_dir), seed=11)
    return c.withColumn("score", (hashed(31, F.col("net"), F.col("seq")) % 2001 - 1000 + F.col("kind") * 400) / 1000.0)


def _ap(where: str, name: str) -> str:
    return f"SELECT sum(y * p) / sum(y) AS {name} FROM (SELECT y, sum(y) OVER w / row_number() OVER w AS p FROM (SELECT (kind > 0)::INTEGER AS y, score, net, seq FROM sc WHERE {where}) WINDOW w AS (ORDER BY score DESC, net, seq ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {_SCORED} SELECT round(ap, 6) AS ap FROM ({_ap('true', 'ap')})")
def q_average_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir), F.col("kind") > 0).select(F.round("ap", 6).alias("ap"))


@query(f"""WITH {_SCORED} SELECT round(avg((kind > 0)::INTEGER) FILTER (score > 0), 6) AS precision, round(avg((score > 0)::INTEGER) FILTER (kind > 0), 6) AS recall, round(avg((kind > 0)::INTEGER), 6) AS base FROM sc""")
def q_precision_recall(spark, sf_dir):
    d = metrics.detection(_scored(spark, sf_dir))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query(f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY net ORDER BY score DESC, seq) AS r, count(*) FILTER (kind > 0) OVER (PARTITION BY net) AS k FROM sc)
SELECT round(avg(p), 6) AS p_at_k FROM (SELECT net, avg((kind > 0)::INTEGER) AS p FROM r WHERE r <= k GROUP BY net)""")
def q_p_at_k(spark, sf_dir):
    return metrics.precision_at_k(_scored(spark, sf_dir), "net", "copy").select(F.round("p_at_k", 6).alias("p_at_k"))


@query(f"""WITH {_SCORED}, one AS ({_ap('kind IN (0, 1)', 'ap')}), two AS ({_ap('kind IN (0, 2)', 'ap')}), rc AS (SELECT kind, avg((score > 0)::INTEGER) AS recall FROM sc WHERE kind > 0 GROUP BY kind)
SELECT kind, round(CASE kind WHEN 1 THEN one.ap ELSE two.ap END, 6) AS ap, round(recall, 6) AS recall FROM rc, one, two""")
def q_by_kind(spark, sf_dir):
    k = metrics.by_kind(_scored(spark, sf_dir))
    return k.select("kind", F.round("ap", 6).alias("ap"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {_SCORED}, b(lo, hi) AS (VALUES (5.0, 15.0), (15.0, 50.0), (50.0, 150.0), (150.0, 500.0))
SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, count(score) AS n, round(avg((score > 0)::INTEGER), 6) AS recall FROM b LEFT JOIN sc ON kind = 1 AND mag >= lo AND mag < hi GROUP BY lo, hi""")
def q_by_magnitude(spark, sf_dir):
    return metrics.by_magnitude(_scored(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


_RANKED = f"""{_CAND}, s AS (SELECT *, {_CLOGIT} AS score, pos = {_hash('41', 'net', 'seq')} % 4 AS y FROM cand), tr AS (SELECT net, seq, max(score) FILTER (y) AS ts, count(*) AS n FROM s GROUP BY net, seq HAVING max(score) FILTER (y) IS NOT NULL),
 rk AS (SELECT s.net, s.seq, 1 + count(*) FILTER (score > ts) AS rank, any_value(n) AS n FROM s JOIN tr USING (net, seq) GROUP BY s.net, s.seq)"""


def _ranks(spark, sf_dir):
    c = _candidates(spark, sf_dir)[1]
    c = c.withColumn("score", (hashed(22, F.col("net"), F.col("seq"), F.col("pos")) % 2001 - 1000) / 500.0).withColumn("is_target", F.col("pos") == hashed(41, F.col("net"), F.col("seq")) % 4)
    return metrics.rank_of_truth(c, "net", "seq")


@query(f"WITH RECURSIVE {_RANKED} SELECT round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INTEGER), 6) AS hits1, round(avg((rank <= 5)::INTEGER), 6) AS hits5, median(rank) AS median_rank, round(avg(n), 6) AS n_pairs FROM rk")
def q_rank_metrics(spark, sf_dir):
    m = metrics.link_metrics(_ranks(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"WITH RECURSIVE {_RANKED} SELECT round(avg((rank = 1)::INTEGER), 6) AS acc, round(avg(1 / rank), 6) AS mrr, count(*) AS n, round(avg(n), 6) AS n_cand FROM rk")
def q_fix_metrics(spark, sf_dir):
    m = metrics.fix_metrics(_ranks(spark, sf_dir))
    return m.select(F.round("acc", 6).alias("acc"), F.round("mrr", 6).alias("mrr"), "n", F.round("n_cand", 6).alias("n_cand"))


_ERR = f"{T}, {ENDS}, lv AS (SELECT DISTINCT net, level FROM ends), er AS (SELECT net, level, k AS sample, CASE WHEN {_hash('51', 'net', 'level', 'k')} % 7 = 0 THEN NULL ELSE ({_hash('52', 'net', 'level', 'k')} % 2001 - 1000) / 10.0 END AS err, ({_hash('53', 'net', 'level')} % 100 + 1)::DOUBLE AS sigma FROM lv, range(4) AS r(k))"


@query(f"WITH {_ERR} SELECT round(avg(ln(sigma) + err * err / (2 * sigma * sigma)), 5) AS nll, round(avg((abs(err) <= sigma)::INTEGER), 6) AS coverage FROM er WHERE err IS NOT NULL")
def q_nll_coverage(spark, sf_dir):
    levels = adapters.published(spark, sf_dir).select("net", "level")
    sigma = levels.withColumn("sigma", (hashed(53, F.col("net"), F.col("level")) % 100 + 1).cast("double"))
    err = levels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    err = err.withColumn("err", F.when(hashed(51, F.col("net"), F.col("level"), F.col("k")) % 7 != 0, (hashed(52, F.col("net"), F.col("level"), F.col("k")) % 2001 - 1000) / 10.0))
    n = metrics.gaussian_nll(err, sigma)
    return n.select(F.round("nll", 5).alias("nll"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_CORRUPT} SELECT round(count(*) FILTER (kind = 0) / count(*) FILTER (kind > 0), 6) AS pos_weight FROM cor")
def q_positive_weight(spark, sf_dir):
    w = metrics.positive_weight(simulate.corrupt(adapters.transitions(spark, sf_dir), seed=11))
    return w.select(F.round("pos_weight", 6).alias("pos_weight"))


@query(f"WITH {_SCORED} SELECT round(avg(CASE WHEN kind > 0 THEN 19 * ln(1 + exp(-score)) ELSE ln(1 + exp(score)) END), 6) AS loss FROM sc")
def q_outlier_loss(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("score").alias("logit"), (F.col("kind") > 0).cast("int").alias("label"))
    return metrics.weighted_log_loss(rows, 19.0).select(F.round("loss", 6).alias("loss"))


@query(f"WITH RECURSIVE {_RANKED} SELECT round(avg(l), 6) AS loss FROM (SELECT s.net, s.seq, ln(sum(exp(score))) - any_value(ts) AS l FROM s JOIN tr USING (net, seq) GROUP BY s.net, s.seq)")
def q_window_cross_entropy(spark, sf_dir):
    c = _candidates(spark, sf_dir)[1]
    c = c.withColumn("logit", (hashed(22, F.col("net"), F.col("seq"), F.col("pos")) % 2001 - 1000) / 500.0).withColumn("is_target", F.col("pos") == hashed(41, F.col("net"), F.col("seq")) % 4)
    return metrics.window_cross_entropy(candidates.recoverable(c), "net", "seq").select(F.round("loss", 6).alias("loss"))


# --- further sources, sinks, filters and statistics -----------------------------------------------------------------------


@query("""SELECT n_name AS net, 'n ' || n_nationkey AS level, 0.0::DOUBLE AS energy FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT n_name, 's ' || s_suppkey, round(s_acctbal + 20000, 4) FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def q_in_memory_rows(spark, sf_dir):
    """Networks given as rows of a table, without files: a line from each supplier to its nation."""
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    unc = F.lit(1e-3)
    t = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("n_name").alias("net"), F.col("s_suppkey").alias("seq"), (F.col("s_acctbal") + 20000).alias("freq"), unc.alias("unc"), unc.alias("orig_unc"),
        F.concat(F.lit("s "), "s_suppkey").alias("upper"), F.concat(F.lit("n "), "s_nationkey").alias("lower"), F.lit("rows.1").alias("ref"),
    )
    return solve.solve_energies(t).select("net", "level", F.round("energy", 4).alias("energy"))


@query(f"""WITH {T}, m AS (SELECT net, up AS level, seq, freq, unc, max(seq) FILTER (seq IN (4, 9)) OVER (PARTITION BY net) AS bar FROM t)
SELECT net, level, max_by(freq::DECIMAL(18,2), seq)::DOUBLE AS energy, max_by(unc::DECIMAL(18,2), seq)::DOUBLE AS unc, max(seq)::INTEGER AS n_trans FROM m WHERE seq > bar AND seq <> 12 GROUP BY net, level""")
def q_mrt_levels(spark, sf_dir):
    t = adapters.transitions(spark, sf_dir)
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    row = F.concat_ws(" ", "net", F.lit("name"), "upper", money("freq"), money("unc"), "seq")
    value = F.when(F.col("seq").isin(4, 9), F.lit("-" * 60)).when(F.col("seq") == 12, F.lit(" ")).otherwise(row)
    return lines.parse_mrt_levels(t.select("net", F.col("seq").alias("line_no"), value.alias("value")))


@query(f"""WITH {LINES}, s(tag, unit) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SEGMENTS.items())}),
 f AS (SELECT tag, CASE unit WHEN 'Hz' THEN 1.0 WHEN 'kHz' THEN 1e3 WHEN 'MHz' THEN 1e6 WHEN 'GHz' THEN 1e9 WHEN 'THz' THEN 1e12 ELSE 2.99792458e10 END::DOUBLE / 2.99792458e10::DOUBLE AS k FROM s)
SELECT net, seq, CASE WHEN abs(freq * f.k) < 5e-7 THEN 0.0::DOUBLE ELSE round(freq * f.k, 6) END AS freq, round(unc * f.k, 9) AS unc, round(orig_unc * f.k, 9) AS orig_unc, upper, lower, excluded FROM p JOIN f ON f.tag = split_part(ref, '.', 1)""")
def q_parse_with_segments(spark, sf_dir):
    seg = spark.createDataFrame(list(SEGMENTS.items()), "tag string, unit string")
    p = lines.parse_native(written(adapters.native_lines(spark, sf_dir), "native"), segments=seg)  # read twice
    freq = F.when(F.abs("freq") < 5e-7, F.lit(0.0)).otherwise(F.round("freq", 6))  # no zero with a sign
    return p.select("net", "seq", freq.alias("freq"), F.round("unc", 9).alias("unc"), F.round("orig_unc", 9).alias("orig_unc"), "upper", "lower", "excluded")


@query(f"""WITH {LINES}, loops AS (SELECT net, seq % 20 = 11 AS negative FROM p WHERE seq % 20 IN (11, 12))
SELECT 'missing segment' AS rule, count(*) > 0 AS raised FROM p WHERE split_part(ref, '.', 1) = 'AF' UNION ALL SELECT 'all segments', count(*) > 0 FROM p WHERE split_part(ref, '.', 1) NOT IN ({', '.join(repr(k) for k in SEGMENTS)})
UNION ALL SELECT 'self-loop, excluded', count(*) > 0 FROM loops WHERE negative AND NOT negative UNION ALL SELECT 'self-loop, kept', count(*) > 0 FROM loops WHERE NOT negative""")
def q_checks_raise(spark, sf_dir):
    """Which inputs the parser refuses: a tag without a segment, a kept line between a level and itself; not an excluded one."""
    given = written(adapters.native_lines(spark, sf_dir), "native")  # read twice a case
    loop = F.regexp_replace("value", r"1 ([0-9]+) 0 [0-9]+ ", "1 $1 1 $1 ")
    seg = lambda skip: spark.createDataFrame([(k, v) for k, v in SEGMENTS.items() if k != skip], "tag string, unit string")
    cases = {
        "missing segment": lines.parse_native(given, segments=seg("AF")), "all segments": lines.parse_native(given, segments=seg(None)),
        "self-loop, excluded": lines.parse_native(given.withColumn("value", F.when(F.col("line_no") % 20 == 11, loop).otherwise(F.col("value")))),
        "self-loop, kept": lines.parse_native(given.withColumn("value", F.when(F.col("line_no") % 20 == 12, loop).otherwise(F.col("value")))),
    }

    def raised(df: DataFrame) -> bool:
        try:
            df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            if "missing segment" not in str(e) and "upper == lower" not in str(e):
                raise
            return True
        return False

    return spark.createDataFrame([(k, raised(df)) for k, df in cases.items()], "rule string, raised boolean")


@query(f"WITH {T} SELECT net, up AS upper, low AS lower, round(sum(freq / (orig_unc * orig_unc)) / sum(1 / (orig_unc * orig_unc)), 6) AS diff FROM t GROUP BY net, up, low")
def q_weight_override(spark, sf_dir):
    """Another column of uncertainties stands in for the weights."""
    t = _pairwise(spark, sf_dir)
    r = solve.residuals(t, solve.solve_energies(t, unc="orig_unc"))
    return r.groupBy("net", "pair.upper", "pair.lower").agg(F.round(F.first(F.col("e_upper") - F.col("e_lower")), 6).alias("diff"))


def _pairwise(spark, sf_dir):
    """Each pair of levels of every net as a component of its own."""
    pair = F.concat_ws("|", "upper", "lower")
    return adapters.transitions(spark, sf_dir).withColumn("pair", F.struct("upper", "lower")).withColumns({"upper": F.concat_ws("|", F.lit("u"), pair), "lower": F.concat_ws("|", F.lit("l"), pair)})


@query(f"""WITH {T}, g AS (SELECT net, up, low, sum(freq / (unc * unc)) / sum(1 / (unc * unc)) AS m FROM t GROUP BY ALL),
 d AS (SELECT net, k, up, low, sum(freq / (u * u)) / sum(1 / (u * u)) AS x FROM (SELECT *, ({_hash('13', 'net', 'k', 'seq')} % 10 + 1) * orig_unc AS u FROM t, range(5) AS r(k)) GROUP BY ALL),
 a AS (SELECT net, up, low, median(x) AS mid, stddev_samp(x) AS sd FROM d GROUP BY ALL)
SELECT net, up AS upper, low AS lower, round(sqrt(2.0) * greatest(abs(m - mid), sd) + 0.0000123, 3) AS boot_unc FROM a JOIN g USING (net, up, low)""")
def q_bootstrap_conflicting(spark, sf_dir):
    """Bootstrap of conflicting parallel lines: the upper level of each pair, the lower one at 0."""
    t = _pairwise(spark, sf_dir).drop("pair")
    e = written(solve.solve_energies(t), "energies")
    boot = solve.bootstrap_statistics(solve.bootstrap_samples(t, iterations=5, seed=13), e).where("level like 'u|%'")
    key = F.split("level", r"\|")
    return boot.select("net", key[1].alias("upper"), key[2].alias("lower"), F.round(F.col("boot_unc") + 0.0000123, 3).alias("boot_unc"))


@query(f"""WITH RECURSIVE {_CAND}, s AS (SELECT *, {_hash('61', 'net', 'seq')} % 5 AS o FROM cand), tr AS (SELECT net, seq, bool_or(pos = o) AS known FROM s GROUP BY net, seq)
SELECT s.net, s.seq, s.pos, s.cand_level, s.pos = s.o AS is_target FROM s JOIN tr USING (net, seq) WHERE known""")
def q_recoverable(spark, sf_dir):
    """Candidates of suspects whose true upper level is among them; of every fifth suspect by hash it is none that is asked for."""
    t = adapters.transitions(spark, sf_dir)
    o = hashed(61, F.col("net"), F.col("seq")) % 5
    moved = F.element_at(F.array(*[F.lit(d) for d in (*candidates.OFFSETS, 1_000_000)]), (o + 1).cast("int"))
    e = written(solve.solve_energies(adapters.consistent(spark, sf_dir)), "energies")
    c = candidates.correction_candidates(t.withColumn("orig_upper", shifted(F.col("upper"), 1, moved)), e)
    return candidates.recoverable(c).select("net", "seq", "pos", "cand_level", "is_target")


@query(f"""WITH {T}, {ENDS}, lv AS (SELECT DISTINCT net, level FROM ends), v AS (SELECT net, ({_hash('71', 'net', 'level')} % 2001 - 1000) / 100.0 AS d, ({_hash('72', 'net', 'level')} % 1000) / 100.0 AS unc FROM lv)
SELECT net, round(avg((abs(d) <= unc)::INTEGER), 6) AS share FROM v GROUP BY net""")
def q_within_sigma(spark, sf_dir):
    p = adapters.published(spark, sf_dir).withColumn("energy", F.lit(100.0))
    moved = F.lit(100.0) + (hashed(71, F.col("net"), F.col("level")) % 2001 - 1000) / 100.0
    c = p.withColumn("unc", (hashed(72, F.col("net"), F.col("level")) % 1000) / 100.0).withColumn("energy", moved)
    # a distance of exactly one uncertainty may fall on either side once 100 is added
    odd = F.abs(F.abs((hashed(71, F.col("net"), F.col("level")) % 2001 - 1000) / 100.0) - F.col("unc")) < 1e-9
    c = c.withColumn("unc", F.when(odd, F.col("unc") + 1e-6).otherwise(F.col("unc")))
    return metrics.within_sigma(c, p).select("net", F.round("share", 6).alias("share"))


@query(f"WITH {_ERR} SELECT net, level, count(err) AS n, round(stddev_pop(err), 4) AS spread FROM er GROUP BY net, level")
def q_spread_of_errors(spark, sf_dir):
    levels = adapters.published(spark, sf_dir).select("net", "level")
    k = levels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    lost = hashed(51, F.col("net"), F.col("level"), F.col("k")) % 7 == 0
    err = k.withColumn("err", F.when(lost, F.when(F.col("k") % 2 == 0, F.lit(float("nan")))).otherwise((hashed(52, F.col("net"), F.col("level"), F.col("k")) % 2001 - 1000) / 10.0))
    return metrics.spread_of_errors(err).withColumn("spread", F.round("spread", 4))


@query(f"""WITH {_SCORED}, ap AS (SELECT net, sum(y * p) / sum(y) AS ap FROM (SELECT net, y, sum(y) OVER w / row_number() OVER w AS p FROM (SELECT (kind > 0)::INTEGER AS y, score, net, seq FROM sc) WINDOW w AS (PARTITION BY net ORDER BY score DESC, seq ROWS UNBOUNDED PRECEDING)) GROUP BY net)
SELECT count(*) AS nets, round(avg(ap), 6) AS ap FROM ap""")
def q_mean_over_nets(spark, sf_dir):
    per = metrics.average_precision(_scored(spark, sf_dir), F.col("kind") > 0, "net")
    return per.agg(F.count("*").alias("nets")).join(F.broadcast(metrics.mean_over(per, "ap"))).select("nets", F.round("ap", 6).alias("ap"))


@query(SQL["q_refit_survival"].replace("SELECT net, sample, count(*) AS survivors FROM alive GROUP BY net, sample", "SELECT net, sample, count(*) - 1 AS levels FROM alive GROUP BY net, sample HAVING count(*) > 1"))
def q_ground_excluded(spark, sf_dir):
    """Errors of all levels but the ground."""
    m = _main(spark, sf_dir)
    e = written(solve.solve_energies(m).withColumn("energy", F.round("energy", 6)), "energies")
    err = simulate.without_ground(simulate.refit_errors(m, e, n_samples=2, seed=9), e)
    return err.groupBy("net", "sample").agg(F.count("*").alias("levels"))


@query(f"WITH RECURSIVE {CC} SELECT t.net, comps.comp, t.seq FROM t JOIN comps ON comps.net = t.net AND comps.level = t.up WHERE comp > 1")
def q_rest_of_components(spark, sf_dir):
    """Lines of all components but the largest."""
    labelled, _ = network.split_components(adapters.transitions(spark, sf_dir))
    return labelled.where("comp > 1").select("net", "comp", "seq")


@query(f"""WITH RECURSIVE {_CORRUPT}, t2 AS (SELECT net, seq, upper AS up, lower AS low, freq, unc, kind, mag, orig_upper FROM cor), {CC.removeprefix(T + ", ").replace("FROM t ", "FROM t2 ").replace("FROM t)", "FROM t2)")}
SELECT t2.net, t2.seq, kind, round(mag, 6) AS mag, orig_upper FROM t2 JOIN comps ON comps.net = t2.net AND comps.level = t2.up WHERE comp = 1""")
def q_labels_follow(spark, sf_dir):
    """Labels stay with the lines of the main component of a corrupted net."""
    c = network.largest_component(simulate.corrupt(adapters.transitions(spark, sf_dir), seed=11))
    return c.select("net", "seq", F.col("kind").cast("int").alias("kind"), F.round("mag", 6).alias("mag"), "orig_upper")


@query(f"WITH {T} SELECT net, k::INTEGER AS copy, count(*) AS n, greatest(1, round_even(0.05 * count(*), 0))::BIGINT AS bad FROM t, range(3) AS r(k) GROUP BY net, k")
def q_corrupted_copies(spark, sf_dir):
    """Several corrupted copies of each net in one table, each with as many bad lines as were asked for."""
    c = simulate.corrupt(simulate.copies(adapters.transitions(spark, sf_dir), 3), seed=5)
    return c.groupBy("net", "copy").agg(F.count("*").alias("n"), F.count_if(F.col("kind") > 0).alias("bad"))


@query("SELECT 'w' || l_linenumber AS name, 2::INTEGER AS rows, 2::INTEGER AS cols, count(*) FILTER (l_linestatus = 'F')::DOUBLE AS first, sum(l_quantity)::DOUBLE AS last FROM lineitem GROUP BY l_linenumber")
def q_checkpoint_round_trip(spark, sf_dir):
    """Weights through their table: names, shapes and values, here statistics of the lines by line number."""
    import numpy as np

    from ..operators import model

    lines_ = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_linenumber")
    found = lines_.agg(F.count_if(F.col("l_linestatus") == "F").cast("double").alias("a"), F.min("l_tax").alias("b"), F.max("l_tax").alias("c"), F.sum("l_quantity").alias("d")).collect()  # one row a line number
    path = scratch_path(spark, "weights")
    model.save(spark, {f"w{r['l_linenumber']}": np.array([[r["a"], r["b"]], [r["c"], r["d"]]]) for r in found}, path)
    rows = [(k, *v.shape, float(v[0, 0]), float(v[-1, -1])) for k, v in model.load(spark, path).items()]
    return spark.createDataFrame(rows, "name string, rows int, cols int, first double, last double")


#: Chains of levels from one ground, 1 to 5 levels long, one for each supplier of a nation; cuts of a chain in order of hash: what is
#: left of it (r), which cut was taken (pick) and how many levels went with it.
_CHAINS = f"""s AS (SELECT n_name AS net, s_suppkey AS k, (1 + s_suppkey % 5)::INTEGER AS len, copy::INTEGER AS copy FROM supplier JOIN nation ON s_nationkey = n_nationkey, range(3) AS r(copy)),
c AS (SELECT *, k || ' ' || i AS lev, CASE WHEN i = 1 THEN '0 0' ELSE k || ' ' || (i - 1) END AS anchor FROM (SELECT *, unnest(range(1, len))::INTEGER AS i FROM s)),
h AS (SELECT *, row_number() OVER (PARTITION BY net, copy, k ORDER BY {_hash("'8'", 'net', 'copy', 'least(lev, anchor)', 'greatest(lev, anchor)')}, least(lev, anchor)) AS o FROM c),
w AS (SELECT net, copy, k, 0::BIGINT AS o, len AS r, NULL::INTEGER AS pick, 0 AS size, NULL::VARCHAR AS lev, NULL::VARCHAR AS anchor FROM s UNION ALL
 SELECT w.net, w.copy, w.k, h.o, CASE WHEN h.i < w.r THEN h.i - 1 ELSE w.r END, CASE WHEN h.i < w.r THEN h.i END, w.r - h.i + 1, h.lev, h.anchor FROM w JOIN h ON h.net = w.net AND h.copy = w.copy AND h.k = w.k AND h.o = w.o + 1),
picks AS (SELECT net, copy, k, o, lev, anchor, size, pick, count(pick) OVER (PARTITION BY net, copy, k ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > 0 AS void FROM w)"""


def _chains(spark, sf_dir):
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("net"), F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(1), (1 + F.col("s_suppkey") % 5).cast("int"))).alias("i"))
    level = lambda i: F.concat_ws(" ", "k", i)
    return rows.select(
        "net", (F.col("k") * 10 + F.col("i")).alias("seq"), F.lit(10.0).alias("freq"), F.lit(1e-3).alias("unc"), F.lit(1e-3).alias("orig_unc"),
        level(F.col("i")).alias("upper"), F.when(F.col("i") == 1, "0 0").otherwise(level(F.col("i") - 1)).alias("lower"), F.lit("chain.1").alias("ref"),
    )


@query("""WITH s AS (SELECT n_name AS net, s_suppkey AS k, 1 + s_suppkey % 5 AS len FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT net, k, len, k || ' ' || i AS lev, CASE WHEN i = 1 THEN '0 0' ELSE k || ' ' || (i - 1) END AS anchor FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM s))
SELECT net, least(lev, anchor) AS a, greatest(lev, anchor) AS b FROM c WHERE k % 3 > 0 OR len = 1""")
def q_bridges_distributed(spark, sf_dir):
    """Links that no cycle passes, where every third chain is closed to a ring."""
    t = _chains(spark, sf_dir)
    k = F.split("upper", " ")[0].cast("long")
    ring = t.where((k % 3 == 0) & (F.split("upper", " ")[1].cast("long") == 1 + k % 5)).withColumn("lower", F.lit("0 0")).withColumn("seq", F.col("seq") + 1_000_000)
    return network.bridges(t.unionByName(ring), method="distributed")


@query(f"WITH {T} SELECT DISTINCT net, 0::BIGINT AS violations FROM t")
def q_bridges_methods(spark, sf_dir):
    """Links that only one of the two methods takes for bridges."""
    t = written(adapters.transitions(spark, sf_dir), "lines")
    one, two = network.bridges(t), written(network.bridges(t, method="distributed"), "bridges")
    odd = one.withColumn("n", F.lit(1)).unionByName(two.withColumn("n", F.lit(-1))).groupBy("net", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
    wrong = odd.groupBy("net").agg(F.count("*").alias("violations"))
    return t.select("net").distinct().join(wrong, "net", "left").na.fill(0)


@query(f"WITH RECURSIVE {_CHAINS} SELECT net, copy, lev AS orphan_level, anchor AS main_level, size::BIGINT AS n_levels, void FROM picks WHERE pick IS NOT NULL")
def q_void_anchors(spark, sf_dir):
    """Every pick of a detachment with its size; void ones lost their anchor to a later pick."""
    t = written(_chains(spark, sf_dir), "chains")
    d = simulate.detached_levels(t, solve.solve_energies(t), n_copies=3, n_detach=1_000_000, seed=8)
    return d.groupBy("net", "copy", "orphan_level", "main_level", "void").agg(F.count("*").alias("n_levels"))


@query(f"""WITH RECURSIVE {_CHAINS}, o AS (SELECT net, copy, count(*) AS orphans, sum(size)::BIGINT AS orphan_levels FROM picks WHERE pick IS NOT NULL AND NOT void GROUP BY net, copy),
m AS (SELECT net, copy, 1 + sum(r)::BIGINT AS main_levels FROM (SELECT net, copy, k, min(r) AS r FROM w GROUP BY net, copy, k) GROUP BY net, copy)
SELECT net, copy, main_levels, orphans, orphan_levels, 4 * orphans AS pairs, orphans AS true_pairs FROM o JOIN m USING (net, copy) WHERE main_levels > 1""")
def q_linked_copies(spark, sf_dir):
    """Training samples with subtrees cut off: levels that stay, orphans, their levels and the pairs asked; copies without orphans go."""
    from . import training

    samples = training.linked_samples(written(_chains(spark, sf_dir), "chains"), n_graphs=3, n_detach=1_000_000, n_neg=3, seed=8)
    sums = samples.mapInPandas(training.linked_sizes, "net string, main_levels long, orphans long, orphan_levels long, pairs long, true_pairs long")
    return sums.withColumn("copy", F.element_at(F.split("net", "#"), -1).cast("int")).withColumn("net", F.expr("substring(net, 1, length(net) - length(element_at(split(net, '#'), -1)) - 1)"))


@query(f"""WITH RECURSIVE {_CAND}, s AS (SELECT *, {_LOGIT} AS ol FROM cand), f AS (SELECT net, seq, any_value(ol) AS ol FROM s WHERE ol > 0 GROUP BY net, seq)
SELECT net, seq, round(1 / (1 + exp(-ol)), 6) AS outlier_p, (SELECT greatest(count(*) - 10, 0) FROM f) AS more FROM f ORDER BY ol DESC, net, seq LIMIT 10""")
def q_report_preview(spark, sf_dir):
    """The correction report through its sink: the first ten rows, and how many more there are."""
    t, c = _candidates(spark, sf_dir)
    t = t.withColumn("ol", (hashed(21, F.col("net"), F.col("seq")) % 2001 - 1000) / 500.0)
    c = c.withColumn("logit", (hashed(22, F.col("net"), F.col("seq"), F.col("pos")) % 2001 - 1000) / 500.0)
    report = written(candidates.correction_report(t, "ol", c), "report")
    return metrics.preview(report, F.desc("outlier_p"), "net", "seq").select("net", "seq", F.round("outlier_p", 6).alias("outlier_p"), "more")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies of the largest component of every net."""
    energies = solve.solve_energies(adapters.consistent(attach(spark), sf_dir))
    return energies.where("comp = 1").select("net", "level", F.round("energy", 4).alias("energy"))


@query()
def q_model_forward(spark, sf_dir):
    """Widths of all levels by the model with its initial weights."""
    from ..operators import model

    c = network.parted(adapters.consistent(spark, sf_dir))
    nodes, edges = features.build_graph(c, written(solve.solve_energies(c), "energies"))
    return model.score_levels(nodes, edges, model.initial(7, hidden=16, layers=2)).select("net", "level", "log_sigma")


_NEGATIVE = f"""WITH RECURSIVE {CC}, l AS (SELECT net, comp AS orphan_id, min(level) AS o FROM comps WHERE comp > 1 GROUP BY ALL), o AS (SELECT net, comp AS orphan_id, level, row_number() OVER (PARTITION BY net, comp ORDER BY level) - 1 AS i FROM comps WHERE comp > 1),
 m AS (SELECT net, level, row_number() OVER (PARTITION BY net ORDER BY level) - 1 AS j FROM comps WHERE comp = 1), n AS (SELECT net, orphan_id, count(*) AS n_o FROM o GROUP BY ALL), q AS (SELECT net, count(*) AS n_m FROM m GROUP BY net),
 d AS (SELECT n.net, n.orphan_id, k, {_hash('6', "'o'", 'n.net', '0', 'n.orphan_id', 'k')} % n_o AS i, {_hash('6', "'m'", 'n.net', '0', 'n.orphan_id', 'k')} % n_m AS j FROM n JOIN q USING (net), range(3) AS r(k))
SELECT d.net, 0 AS copy, d.orphan_id, d.k, o.level AS orphan_level, m.level AS main_level, 0 AS label FROM d JOIN o ON o.net = d.net AND o.orphan_id = d.orphan_id AND o.i = d.i JOIN m ON m.net = d.net AND m.j = d.j
UNION ALL SELECT l.net, 0, l.orphan_id, -1, o, (SELECT min(level) FROM m WHERE m.net = l.net), 1 FROM l"""


@query(_NEGATIVE)
def q_negative_pairs(spark, sf_dir):
    return _drawn_pairs(spark, sf_dir)


def _drawn_pairs(spark, sf_dir):
    c = written(network.components(adapters.transitions(spark, sf_dir)).withColumn("copy", F.lit(0)), "comps")
    off, main = c.where("comp > 1").withColumnRenamed("comp", "orphan_id").select("net", "copy", "orphan_id", "level"), c.where("comp = 1").select("net", "copy", "level")
    links = off.groupBy("net", "copy", "orphan_id").agg(F.min("level").alias("orphan_level")).join(main.groupBy("net", "copy").agg(F.min("level").alias("main_level")), ["net", "copy"])
    return simulate.negative_pairs(links, off, main, n_neg=3, seed=6)


@query(f"""WITH n AS ({_NEGATIVE}), x AS (SELECT label, ({_hash('81', 'net', 'orphan_id', 'k')} % 2001 - 1000) / 500.0 AS z FROM n)
SELECT round(avg(CASE WHEN label = 1 THEN 3 * ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END), 6) AS loss FROM x""")
def q_link_loss(spark, sf_dir):
    """Log-loss of the true links against drawn pairs, a true one weighing as much as its negatives."""
    z = (hashed(81, F.col("net"), F.col("orphan_id"), F.col("k")) % 2001 - 1000) / 500.0
    return metrics.weighted_log_loss(_drawn_pairs(spark, sf_dir).withColumn("logit", z), 3.0).select(F.round("loss", 6).alias("loss"))
