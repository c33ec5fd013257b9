"""Exploration, statistics and feature ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import ENTRIES, SPEC, clean, events, feat, h_type, obs, query, settle
from aerolith.catalog.ingest import scratch
from aerolith.catalog.sql import CLEAN, FEAT, H_TYPE, OBS, SCORE, cols, with_
from aerolith.operators import ranks as R
from aerolith.operators import select as Sel
from aerolith.operators import stats as St
from aerolith.operators.chunks import latest_rows
from aerolith.schema import ENGINEERED, MEASURES, POLLUTANTS, ROLLINGS, SELECTED_FEATURES, TARGET
from aerolith.sources.tables import write_feature_list

BASE = with_(OBS, CLEAN, FEAT)
# Rolling values differ between engines in the last bit, which makes or breaks ties of ranks: nine decimals count.
ROLLED = [f"pm25_roll_{s}_{n}" for n in ROLLINGS for s in ("mean", "std")]
RFEAT = f"rfeat AS (SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in ROLLED)}) FROM feat)"
CANDIDATES = [*MEASURES, *[c for c in ENGINEERED if c != TARGET]]


def r6(expr: str, name: str) -> str:
    return f"round({expr} + 3.3e-8, 6) AS {name}"


def each(columns, row: str, source: str) -> str:
    """UNION ALL of one select per column; ``{c}`` in ``row`` is the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {row.replace('{c}', c)} FROM {source}" for c in columns)


def corr(a: str, b: str = "target_pm25") -> str:
    """Null in place of NaN for a constant column."""
    return f"nullif(corr({a}, {b}), CAST('nan' AS DOUBLE))"


def ranked_feat(spark, sf_dir):
    return feat(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ROLLED})


def scored(spark, sf_dir):
    """Feature rows with the fixed linear prediction."""
    return feat(spark, sf_dir).withColumn(
        "prediction", F.lit(1.0) + 0.6 * F.col("pm2_5") + 0.2 * F.col("pm25_lag_24") + 0.1 * F.col("pm25_roll_mean_24")
    )


@query(with_(H_TYPE) + f"SELECT event_type, CAST(hour(datetime) AS INTEGER) AS hour, {r6('avg(v)', 'mean_value')} FROM h_type GROUP BY 1, 2")
def diurnal_mean(spark, sf_dir):
    return St.diurnal_mean(h_type(spark, sf_dir), "v", keys=["event_type"])


@query(
    f"""SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS month, strftime(o_orderdate, '%b') AS month_name, {r6('avg(o_totalprice)', 'mean_value')}
  FROM orders GROUP BY 1, 2, 3"""
)
def seasonal_mean(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return St.seasonal_mean(orders, "o_totalprice", "o_orderdate", ["o_orderpriority"])


_DESCRIBE = (
    f"count({{c}}) AS n, {r6('avg({c})', 'mean')}, {r6('stddev_samp({c})', 'std')}, {r6('min({c})', 'min')}, {r6('max({c})', 'max')}, "
    f"{r6('quantile_cont({c}, 0.25)', 'q25')}, {r6('quantile_cont({c}, 0.5)', 'q50')}, {r6('quantile_cont({c}, 0.75)', 'q75')}"
)


@query(with_(OBS) + each(MEASURES, _DESCRIBE, "obs"))
def describe(spark, sf_dir):
    return St.describe(obs(spark, sf_dir), MEASURES)


ORDER_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(each(ORDER_COLUMNS, _DESCRIBE, "lineitem"))
def describe_lineitem(spark, sf_dir):
    return St.describe(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ORDER_COLUMNS)


_PEARSON = f"{r6(corr('{c}'), 'pearson_r')}, {r6('abs(' + corr('{c}') + ')', 'abs_pearson_r')}"


@query(BASE + each(SELECTED_FEATURES, _PEARSON, "feat"))
def pearson_with_target(spark, sf_dir):
    return St.pearson_with_target(feat(spark, sf_dir), SELECTED_FEATURES, TARGET)


@query(
    with_(OBS, CLEAN)
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r6(f'corr({a}, {b})', 'correlation')} FROM clean" for a in POLLUTANTS for b in POLLUTANTS
    )
)
def pearson_matrix(spark, sf_dir):
    return St.correlation_pairs(clean(spark, sf_dir), POLLUTANTS)


def average_rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


def ranked(columns, source, name="ranked"):
    return f"{name} AS (SELECT {', '.join(f'{average_rank(c)} AS {c}' for c in columns)} FROM {source})"


_SPEARMAN = f"{r6(corr('{c}'), 'spearman_rho')}, {r6('abs(' + corr('{c}') + ')', 'abs_spearman_rho')}"


@query(with_(OBS, CLEAN, FEAT, RFEAT, ranked([*SELECTED_FEATURES, TARGET], "rfeat")) + each(SELECTED_FEATURES, _SPEARMAN, "ranked"))
def spearman_with_target(spark, sf_dir):
    return St.spearman_with_target(ranked_feat(spark, sf_dir), SELECTED_FEATURES, TARGET)


@query(
    with_(ranked(ORDER_COLUMNS, "lineitem"))
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r6(f'corr({a}, {b})' if a != b else 'max(1.0)', 'correlation')} FROM ranked"
        for a in ORDER_COLUMNS
        for b in ORDER_COLUMNS
    )
)
def spearman_matrix(spark, sf_dir):
    return St.correlation_pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ORDER_COLUMNS, "spearman")


@query("SELECT l_orderkey, l_linenumber, " + r6(average_rank("l_extendedprice"), "avg_rank") + " FROM lineitem")
def average_ranks(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ranked = R.with_ranks(lines.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"])
    return ranked.select("l_orderkey", "l_linenumber", F.col("l_extendedprice_rank").alias("avg_rank"))


def _mi_sql(columns, bins=16):
    binned = ", ".join(f"CAST(floor((rank() OVER (ORDER BY {c}) - 1) * {bins} / count(*) OVER ()) AS INTEGER) AS {c}" for c in [*columns, TARGET])
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS bx, target_pm25 AS b_y, count(*) AS n FROM binned GROUP BY 1, 2, 3" for c in columns)
    return (
        with_(
            OBS,
            CLEAN,
            FEAT,
            RFEAT,
            f"binned AS (SELECT {binned} FROM rfeat)",
            f"cells AS ({cells})",
            """parts AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p,
      sum(n) OVER (PARTITION BY feature, bx) / sum(n) OVER (PARTITION BY feature) AS px,
      sum(n) OVER (PARTITION BY feature, b_y) / sum(n) OVER (PARTITION BY feature) AS py FROM cells)""",
        )
        + f"SELECT feature, {r6('sum(p * ln(p / (px * py)))', 'mi_score')} FROM parts GROUP BY feature"
    )


@query(_mi_sql(SELECTED_FEATURES))
def mutual_information(spark, sf_dir):
    return St.mutual_information(ranked_feat(spark, sf_dir), SELECTED_FEATURES, TARGET)


VIF_COLUMNS = ["pm2_5", "pm10", "so2"]


def _vif_sql():
    parts = []
    for i, a in enumerate(VIF_COLUMNS):
        b, c = (x for j, x in enumerate(VIF_COLUMNS) if j != i)
        r2 = f"(pow(corr({a},{b}),2) + pow(corr({a},{c}),2) - 2*corr({a},{b})*corr({a},{c})*corr({b},{c})) / (1 - pow(corr({b},{c}),2))"
        parts.append(f"SELECT '{a}' AS feature, {r2} AS r2 FROM clean")
    table = f"v AS ({' UNION ALL '.join(parts)})"
    return with_(OBS, CLEAN, table) + "SELECT feature, round(r2, 4) AS r_squared, CASE WHEN r2 < 0.99999 THEN round(1 / (1 - r2), 2) ELSE 10000.0 END AS vif FROM v"


@query(_vif_sql())
def variance_inflation(spark, sf_dir):
    return St.variance_inflation(clean(spark, sf_dir), VIF_COLUMNS)


def _vif_all_sql(columns):
    """Each column's entry on the diagonal of the inverse correlation matrix, by sweeping its columns one after another."""
    n = len(columns)
    pairs = ", ".join(f"coalesce({corr(columns[i], columns[j])}, 0) AS c_{i}_{j}" for i in range(n) for j in range(i))
    cell = lambda i, j: "1.0::DOUBLE" if i == j else f"c_{max(i, j)}_{min(i, j)}"
    matrix = "[" + ", ".join("[" + ", ".join(cell(i, j) for j in range(n)) + "]" for i in range(n)) + "]"
    swept = f"""list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j:
        CASE WHEN i = k AND j = k THEN -1 / m[k][k] WHEN i = k OR j = k THEN m[i][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))"""
    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    return (
        "WITH RECURSIVE " + ", ".join([OBS, CLEAN, FEAT])
        + f""", pairs AS (SELECT {pairs} FROM feat), g AS (SELECT 1 AS k, {matrix} AS m FROM pairs UNION ALL SELECT k + 1, {swept} FROM g WHERE k <= {n}),
  v AS (SELECT {names}[i] AS feature, -m[i][i] AS vif FROM g, range(1, {n + 1}) r(i) WHERE k = {n + 1})
  SELECT feature, round(1 - 1 / vif + 3.3e-8, 4) AS r_squared, CASE WHEN 1 - 1 / vif < 0.99999 THEN round(vif, 2) ELSE 10000.0 END AS vif FROM v"""
    )


@query(_vif_all_sql(SELECTED_FEATURES))
def variance_inflation_all(spark, sf_dir):
    return St.variance_inflation(feat(spark, sf_dir), SELECTED_FEATURES)


def _hist_sql(source, value, bins):
    return f"""e AS (SELECT min({value}) AS lo, max({value}) AS hi, (max({value}) - min({value})) / {bins} AS bw FROM {source}),
  b AS (SELECT CAST(least(floor(({value} - lo) / bw), {bins - 1}) AS INTEGER) AS bin, lo, bw FROM {source}, e)"""


HIST_PICK = f"SELECT bin, {r6('any_value(lo + bin * bw)', 'bin_start')}, {r6('any_value(lo + (bin + 1) * bw)', 'bin_end')}, count(*) AS n FROM b GROUP BY bin"


@query(with_(OBS, CLEAN, FEAT, _hist_sql("feat", TARGET, 50)) + HIST_PICK)
def target_histogram(spark, sf_dir):
    return St.histogram(feat(spark, sf_dir), TARGET, 50)


@query(with_(OBS, CLEAN, FEAT, f"s AS (SELECT target_pm25 - {SCORE} AS residual FROM feat)", _hist_sql("s", "residual", 40)) + HIST_PICK)
def residual_histogram(spark, sf_dir):
    return St.histogram(St.residuals(scored(spark, sf_dir), TARGET, "prediction"), "residual", 40)


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, abs(corr({a}, {b})) AS correlation FROM feat"
    for i, a in enumerate(SELECTED_FEATURES)
    for b in SELECTED_FEATURES[i + 1 :]
)


@query(with_(OBS, CLEAN, FEAT, f"p AS ({_PAIRS})") + f"SELECT feature_1, feature_2, {r6('correlation', 'correlation')} FROM p WHERE correlation > 0.8 AND NOT isnan(correlation)")
def collinear_pairs(spark, sf_dir):
    return St.collinear_pairs(feat(spark, sf_dir), SELECTED_FEATURES)


LAG_COLUMNS = {0: "pm2_5", 24: "pm25_lag_24", 48: "pm25_lag_48", 72: "pm25_lag_72", 168: "pm25_lag_168"}


@query(BASE + " UNION ALL ".join(f"SELECT CAST({h} AS INTEGER) AS lag_hours, {r6(f'corr({c}, target_pm25)', 'pearson_r')} FROM feat" for h, c in LAG_COLUMNS.items()))
def lag_correlations(spark, sf_dir):
    return St.lag_correlations(feat(spark, sf_dir), LAG_COLUMNS, TARGET)


_LINES = f"{r6('regr_slope(target_pm25, {c})', 'slope')}, {r6('regr_intercept(target_pm25, {c})', 'intercept')}, {r6(corr('{c}'), 'pearson_r')}"


@query(
    BASE
    + f"""SELECT l.* FROM ({each(SELECTED_FEATURES, _LINES, 'feat')}) l
  JOIN (SELECT * FROM ({each(SELECTED_FEATURES, "abs(" + corr("{c}") + ") AS a", "feat")}) ORDER BY a DESC NULLS LAST, feature LIMIT 6) USING (feature)"""
)
def trend_lines(spark, sf_dir):
    """Of the six features most correlated with the target."""
    table = feat(spark, sf_dir)
    best = St.top_correlated(St.pearson_with_target(table, SELECTED_FEATURES, TARGET), 6)
    return St.trend_lines(table, [r["feature"] for r in best.collect()], TARGET)


@query(
    with_(OBS, CLEAN, FEAT, f"s AS (SELECT city, target_pm25 AS y, target_pm25 - {SCORE} AS e FROM feat)")
    + f"""SELECT city, count(*) AS n, {r6('avg(abs(e))', 'mae')}, {r6('sqrt(avg(e * e))', 'rmse')},
  {r6('1 - sum(e * e) / (var_pop(y) * count(*))', 'r2')} FROM s GROUP BY city"""
)
def regression_metrics(spark, sf_dir):
    return St.series_metrics(scored(spark, sf_dir), SPEC, TARGET, "prediction")


@query(with_(OBS, CLEAN, FEAT, f"s AS (SELECT city, datetime, target_pm25 - {SCORE} AS residual FROM feat)") + f"SELECT {cols('city datetime', 'residual')} FROM s")
def residuals(spark, sf_dir):
    return St.residuals(scored(spark, sf_dir), TARGET, "prediction").select("city", "datetime", "residual")


@query(
    with_(OBS, CLEAN, FEAT, f"s AS (SELECT city, target_pm25 AS y, {SCORE} AS p FROM feat)")
    + f"SELECT city, {r6('least(min(y), min(p))', 'low')}, {r6('greatest(max(y), max(p))', 'high')} FROM s GROUP BY city"
)
def parity_bounds(spark, sf_dir):
    return St.parity_bounds(scored(spark, sf_dir), TARGET, "prediction", ["city"])


@query(
    with_(OBS, CLEAN, FEAT, f"s AS (SELECT city, datetime, target_pm25, {SCORE} AS prediction, row_number() OVER (PARTITION BY city ORDER BY datetime DESC) AS r FROM feat)")
    + f"SELECT {cols('city datetime', 'target_pm25 prediction')} FROM s WHERE r <= 300"
)
def last_300_hours(spark, sf_dir):
    rows = scored(spark, sf_dir).select("city", "datetime", TARGET, "prediction")
    return latest_rows(rows, SPEC, 300)


def both_correlations(spark, sf_dir):
    table = ranked_feat(spark, sf_dir)
    return (
        St.pearson_with_target(table, CANDIDATES, TARGET),
        St.spearman_with_target(table, CANDIDATES, TARGET),
    )


_RANKED = ranked([*CANDIDATES, TARGET], "rfeat")
BOTH = f"""pe AS ({each(CANDIDATES, corr('{c}') + ' AS pearson_r', 'rfeat')}),
  sp AS ({each(CANDIDATES, corr('{c}') + ' AS spearman_rho', 'ranked')}),
  j AS (SELECT feature, pearson_r, abs(pearson_r) AS abs_pearson_r, spearman_rho, abs(spearman_rho) AS abs_spearman_rho FROM pe JOIN sp USING (feature))"""
CORR_NAMES = "pearson_r abs_pearson_r spearman_rho abs_spearman_rho"


@query(
    with_(OBS, CLEAN, FEAT, RFEAT, _RANKED, BOTH, "k AS (SELECT *, CAST(abs(rank() OVER (ORDER BY abs_pearson_r DESC NULLS LAST) + (count(*) OVER (PARTITION BY abs_pearson_r) - 1) / 2 - rank() OVER (ORDER BY abs_spearman_rho DESC NULLS LAST) - (count(*) OVER (PARTITION BY abs_spearman_rho) - 1) / 2) AS DOUBLE) AS rank_diff FROM j)")
    + f"SELECT {cols('feature', CORR_NAMES + ' rank_diff')} FROM k"
)
def rank_compare(spark, sf_dir):
    return St.rank_compare(*both_correlations(spark, sf_dir))


@query(BASE + f"SELECT * FROM ({each(SELECTED_FEATURES, _PEARSON, 'feat')}) ORDER BY abs_pearson_r DESC NULLS LAST, feature LIMIT 10")
def top_correlated(spark, sf_dir):
    return St.top_correlated(St.pearson_with_target(feat(spark, sf_dir), SELECTED_FEATURES, TARGET))


def stand_in_scores(spark, sf_dir):
    """The five score tables with SQL-expressible stand-ins for trees and inflation."""
    pearson, spearman = both_correlations(spark, sf_dir)
    fit = St.trend_lines(ranked_feat(spark, sf_dir), CANDIDATES, TARGET)
    mutual = fit.select("feature", F.abs("slope").alias("mi_score"))
    trees = fit.select("feature", (F.col("pearson_r") * F.col("pearson_r")).alias("avg_tree_importance"))
    vif = fit.select("feature", (1 / (1 - F.col("pearson_r") * F.col("pearson_r"))).alias("vif"))
    return Sel.consolidate_scores(pearson, spearman, mutual, trees, vif)


SLOPE = "CASE WHEN var_pop({c}) > 0 THEN regr_slope(target_pm25, {c}) END"
CONSOLIDATED = f"""fit AS ({each(CANDIDATES, 'abs(' + SLOPE + ') AS mi_score, pow(' + corr('{c}') + ', 2) AS avg_tree_importance, 1 / (1 - pow(' + corr('{c}') + ', 2)) AS vif', 'rfeat')}),
  m AS (SELECT *, coalesce(abs_pearson_r / max(abs_pearson_r) OVER (), 0) AS norm_pearson, coalesce(abs_spearman_rho / max(abs_spearman_rho) OVER (), 0) AS norm_spearman,
    coalesce(mi_score / max(mi_score) OVER (), 0) AS norm_mi, coalesce(avg_tree_importance / max(avg_tree_importance) OVER (), 0) AS norm_tree FROM j JOIN fit USING (feature)),
  c AS (SELECT *, 0.30 * norm_pearson + 0.20 * norm_spearman + 0.25 * norm_mi + 0.25 * norm_tree AS composite_score FROM m),
  o AS (SELECT *, CAST(row_number() OVER (ORDER BY composite_score DESC, feature) AS INTEGER) AS overall_rank FROM c)"""
SCORE_NAMES = f"{CORR_NAMES} mi_score avg_tree_importance vif norm_pearson norm_spearman norm_mi norm_tree composite_score"


@query(with_(OBS, CLEAN, FEAT, RFEAT, _RANKED, BOTH, CONSOLIDATED) + f"SELECT {cols('feature overall_rank', SCORE_NAMES)} FROM o")
def composite_ranking(spark, sf_dir):
    return stand_in_scores(spark, sf_dir)


@query(with_(OBS, CLEAN, FEAT, RFEAT, _RANKED, BOTH, CONSOLIDATED) + "SELECT feature, overall_rank FROM o WHERE overall_rank <= 18")
def top_features(spark, sf_dir):
    return stand_in_scores(spark, sf_dir).filter(F.col("overall_rank") <= 18).select("feature", "overall_rank")


def measured_scores(spark, sf_dir):
    """The five tables as the selection job makes them, rounded as they are stored; only the share of variance that one line explains stands for the trees."""
    pearson = settle(St.pearson_with_target(feat(spark, sf_dir), SELECTED_FEATURES, TARGET))
    rows = ranked_feat(spark, sf_dir)
    lines = pearson.select("feature", (F.col("abs_pearson_r") * F.col("abs_pearson_r")).alias("avg_tree_importance"))
    tables = [St.spearman_with_target(rows, SELECTED_FEATURES, TARGET), St.mutual_information(rows, SELECTED_FEATURES, TARGET), lines, St.variance_inflation(feat(spark, sf_dir), SELECTED_FEATURES)]
    return Sel.consolidate_scores(pearson, *[settle(t) if t is not lines else t for t in tables])


def _measured_sql() -> str:
    parts = {"p": "pearson_with_target", "s": "spearman_with_target", "m": "mutual_information", "v": "variance_inflation_all"}
    share = lambda c, name: f"coalesce({c} / nullif(max({c}) OVER (), 0), 0) AS {name}"
    return (
        "WITH " + ", ".join(f"{name} AS ({ENTRIES[of].sql})" for name, of in parts.items())
        + f""", j AS (SELECT feature, pearson_r, abs_pearson_r, spearman_rho, abs_spearman_rho, mi_score, abs_pearson_r * abs_pearson_r AS avg_tree_importance, r_squared, vif
    FROM p JOIN s USING (feature) JOIN m USING (feature) JOIN v USING (feature)),
  n AS (SELECT *, {share('abs_pearson_r', 'norm_pearson')}, {share('abs_spearman_rho', 'norm_spearman')}, {share('mi_score', 'norm_mi')}, {share('avg_tree_importance', 'norm_tree')} FROM j),
  c AS (SELECT *, 0.30 * norm_pearson + 0.20 * norm_spearman + 0.25 * norm_mi + 0.25 * norm_tree AS composite_score FROM n),
  o AS (SELECT *, CAST(row_number() OVER (ORDER BY composite_score DESC, feature) AS INTEGER) AS overall_rank FROM c)"""
    )


@query(_measured_sql() + f"SELECT {cols('feature overall_rank', SCORE_NAMES + ' r_squared')} FROM o")
def measured_ranking(spark, sf_dir):
    return measured_scores(spark, sf_dir)


@query(_measured_sql() + "SELECT overall_rank AS line, feature FROM o WHERE overall_rank <= 10")
def written_feature_list(spark, sf_dir):
    """The list as it is written: its lines in order, read back."""
    path = scratch(spark, "feature_list")
    write_feature_list(measured_scores(spark, sf_dir), path, 10)
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: x != "")).alias("line", "feature"))
    return lines.select((F.col("line") + 1).alias("line"), "feature")


@query(f"SELECT event_id, {r6('value', 'value')} FROM (SELECT * FROM events ORDER BY md5(concat_ws('|', event_id::VARCHAR, '42')), event_id LIMIT 2500)")
def hashed_sample(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "value")
    return St.fixed_sample(rows, 2500, ["event_id"])


@query()
def tree_importance(spark, sf_dir):
    return Sel.tree_importance(feat(spark, sf_dir), SELECTED_FEATURES, TARGET)


@query()
def feature_scores(spark, sf_dir):
    return Sel.score_features(feat(spark, sf_dir), SELECTED_FEATURES, TARGET)


