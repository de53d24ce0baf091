"""Queries over episodes, findings and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe import proxy
from epiframe.operators import intervals as I
from epiframe.operators import quality as Q
from epiframe.operators import tables
from epiframe.plans.registry import query
from epiframe.proxy import with_views

_EF = """ef AS (SELECT f.*, e.duration FROM findings f JOIN episodes e USING (episode_index))"""
_CLIP = """c AS (SELECT episode_index, severity, confidence, duration, greatest(0.0, start_s) AS a, least(duration, end_s) AS b FROM ef WHERE end_s > start_s)"""
_UNION = """u0 AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY episode_index ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM c WHERE {where}),
u1 AS (SELECT *, sum(o) OVER (PARTITION BY episode_index ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM u0),
u2 AS (SELECT episode_index, g, min(a) AS a, max(b) AS b FROM u1 GROUP BY 1, 2),
un AS (SELECT episode_index, sum(b - a) AS covered_s FROM u2 GROUP BY 1)"""
_SWEEP = """p AS (SELECT DISTINCT episode_index, unnest([0.0::DOUBLE, duration, a, b]) AS l FROM c), sl AS (SELECT * FROM (SELECT *, lead(l) OVER (PARTITION BY episode_index ORDER BY l) AS r FROM p) WHERE r > l),
wc AS (SELECT *, confidence * CASE severity WHEN 'error' THEN 1.0 WHEN 'fatal' THEN 1.0 WHEN 'warning' THEN 0.25 ELSE 0.0 END AS weight FROM c),
sw AS (SELECT sl.episode_index, l, r, coalesce(max(weight), 0.0) AS weight FROM sl LEFT JOIN wc ON wc.episode_index = sl.episode_index AND wc.a < r AND wc.b > l GROUP BY 1, 2, 3)"""
_OPEN = "op AS (SELECT f.* FROM findings f LEFT JOIN reviews r USING (finding_id) WHERE coalesce(review_status, 'unreviewed') <> 'rejected')"


def timed(spark: SparkSession, d: str) -> DataFrame:
    return I.dealt(proxy.findings(spark, d)).join(proxy.episodes(spark, d).select("episode_index", "duration"), "episode_index")


@query(with_views(f"{_EF},\n{_CLIP},\n{_UNION.format(where='true')}\nSELECT episode_index, round(covered_s, 6) AS covered_s FROM un", "findings", "episodes"))
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return I.union_duration(timed(spark, d)).select("episode_index", F.round("covered_s", 6).alias("covered_s"))


@query(with_views(f"{_EF},\n{_CLIP},\n{_SWEEP}\nSELECT episode_index, round(sum((r - l) * weight), 6) AS weighted_s FROM sw GROUP BY 1", "findings", "episodes"))
def overlap_sweep_penalty(spark: SparkSession, d: str) -> DataFrame:
    weight = F.col("confidence") * F.when(F.col("severity") == "error", 1.0).when(F.col("severity") == "warning", 0.25).otherwise(0.0)
    s = I.weighted_duration(I.sweep(timed(spark, d).withColumn("weight", weight)))
    return s.select("episode_index", F.round("weighted_s", 6).alias("weighted_s"))


@query(with_views(f"""{_EF}, pp AS (SELECT DISTINCT episode_index, round_even(unnest([0.0::DOUBLE, duration, greatest(0.0, least(duration, start_s)), greatest(0.0, least(duration, end_s))]) / 0.01, 0) * 0.01 AS s FROM ef),
n AS (SELECT *, lead(s) OVER (PARTITION BY episode_index ORDER BY s) AS e FROM pp)
SELECT episode_index, round(s, 2) AS start_s, round(e, 2) AS end_s FROM n WHERE e - s > 0.005""", "findings", "episodes"))
def interval_partition(spark: SparkSession, d: str) -> DataFrame:
    return I.partition(timed(spark, d)).select("episode_index", F.round("start_s", 2).alias("start_s"), F.round("end_s", 2).alias("end_s"))


_SCORES = f"""{_EF},\n{_CLIP},\n{_UNION.format(where="severity IN ('error', 'fatal')")},\n{_SWEEP},
pen AS (SELECT episode_index, sum((r - l) * weight) AS weighted_s FROM sw GROUP BY 1),
er AS (SELECT episode_index, bool_or(severity = 'error') AS error FROM findings GROUP BY 1),
sc AS (SELECT e.episode_index, 100.0 * (duration - coalesce(covered_s, 0.0)) / duration AS usable_ratio, greatest(0.0, least(100.0, 100.0 - coalesce(weighted_s, 0.0) / duration * 100.0)) AS quality_score, coverage, coalesce(error, false) AS error
FROM episodes e LEFT JOIN un USING (episode_index) LEFT JOIN pen USING (episode_index) LEFT JOIN er USING (episode_index))"""


def rounded(c: str) -> Column:
    """Six decimals as the SQL's ``round`` takes them, from the product; ``F.round`` takes the shortest decimal form instead,
    and scores are often ties of the sixth decimal, short of their last bits."""
    return F.round(F.col(c) * 1e6) / 1e6


@query(with_views(_SCORES + "\nSELECT episode_index, round(usable_ratio, 6) AS usable_ratio, round(quality_score, 6) AS quality_score FROM sc", "findings", "episodes"))
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.findings(spark, d).withColumn("hard_invalid", F.lit(False))
    s = Q.score_episodes(proxy.episodes(spark, d).select("episode_index", "duration", "coverage"), f)
    return s.select("episode_index", *[rounded(c).alias(c) for c in ("usable_ratio", "quality_score")])


@query(with_views(_SCORES + "\nSELECT episode_index, CASE WHEN quality_score >= 80 AND usable_ratio >= 90 AND coverage >= 80 AND NOT error THEN 'pass' ELSE 'review' END AS auto_decision FROM sc", "findings", "episodes"))
def auto_decision(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.findings(spark, d).withColumn("hard_invalid", F.lit(False))
    return Q.score_episodes(proxy.episodes(spark, d).select("episode_index", "duration", "coverage"), f).select("episode_index", "auto_decision")


def detector_runs(spark: SparkSession, d: str) -> DataFrame:
    li = proxy.table(spark, d, "lineitem")
    status = F.when(F.col("l_linestatus") == "O", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped")
    return li.select(F.col("l_orderkey").alias("episode_index"), F.concat(F.lit("d"), F.col("l_linenumber")).alias("detector_id"), status.alias("status"), (F.col("l_tax") < 0.07).alias("applicable"), (F.col("l_linenumber") / 2).cast("double").alias("coverage_weight"))


_RUNS = """WITH runs AS (SELECT l_orderkey AS episode_index, 'd' || l_linenumber AS detector_id, CASE WHEN l_linestatus = 'O' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'skipped' END AS status, l_tax < 0.07 AS applicable, l_linenumber / 2.0 AS w FROM lineitem)\n"""


@query(_RUNS + "SELECT episode_index, round(CASE WHEN sum(CASE WHEN applicable THEN w ELSE 0 END) <= 0 THEN 100.0 ELSE 100.0 * sum(CASE WHEN applicable AND status = 'completed' THEN w ELSE 0 END) / sum(CASE WHEN applicable THEN w ELSE 0 END) END, 6) AS coverage FROM runs GROUP BY 1")
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    return Q.coverage(detector_runs(spark, d)).select("episode_index", F.round("coverage", 6).alias("coverage"))


@query(_RUNS + """SELECT detector_id, count(*) AS total, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'failed') AS n_failed,
round(100.0 * count(*) FILTER (status = 'completed') / count(*), 3) AS coverage, CASE WHEN count(*) FILTER (status = 'skipped') = count(*) THEN 'skipped' ELSE 'completed' END AS status FROM runs GROUP BY 1""")
def detector_coverage(spark: SparkSession, d: str) -> DataFrame:
    return Q.detector_coverage(detector_runs(spark, d))


@query(with_views("""SELECT count(*) AS episodes, count(*) FILTER (integrity_status = 'invalid') AS invalid, count(*) FILTER (auto_decision = 'pass') AS n_pass, count(*) FILTER (auto_decision = 'review') AS n_review, count(*) FILTER (auto_decision = 'quarantine') AS n_quarantine,
round(coalesce(avg(quality_score), 0), 3) AS average_quality, round(coalesce(avg(usable_ratio), 0), 3) AS average_usable, round(coalesce(avg(coverage), 0), 3) AS average_coverage FROM episodes""", "episodes"))
def qc_summary_totals(spark: SparkSession, d: str) -> DataFrame:
    return Q.summary_totals(proxy.episodes(spark, d))


@query(with_views(_OPEN + "\nSELECT issue_code, severity, count(*) AS count, count(DISTINCT episode_index) AS episodes FROM op GROUP BY 1, 2", "findings", "reviews"))
def issue_histogram(spark: SparkSession, d: str) -> DataFrame:
    return Q.issue_histogram(proxy.findings(spark, d), proxy.reviews(spark, d))


@query(with_views(_OPEN + ", g AS (SELECT episode_index, issue_code, severity, count(*) AS n FROM op GROUP BY 1, 2, 3)\nSELECT episode_index, CAST(sum(n) AS BIGINT) AS finding_count, string_agg(issue_code || ':' || severity || ':' || n, ',' ORDER BY issue_code, severity) AS issues FROM g GROUP BY 1", "findings", "reviews"))
def episode_issue_list(spark: SparkSession, d: str) -> DataFrame:
    g = Q.open_findings(proxy.findings(spark, d), proxy.reviews(spark, d)).groupBy("episode_index", "issue_code", "severity").agg(F.count(F.lit(1)).alias("n"))
    items = F.sort_array(F.collect_list(F.struct("issue_code", "severity", "n")))
    return g.groupBy("episode_index").agg(F.sum("n").alias("finding_count"), F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["issue_code"], x["severity"], x["n"].cast("string"))), ",").alias("issues"))


_COUNTED = _OPEN + ", n AS (SELECT episode_index, count(*) AS finding_count FROM op GROUP BY 1), q AS (SELECT e.*, coalesce(manual_decision, auto_decision) AS decision, coalesce(finding_count, 0) AS finding_count FROM episodes e LEFT JOIN n USING (episode_index))"
_PAGE = ("episode_index", "decision", "finding_count", "quality_score")


@query(with_views(_COUNTED + "\nSELECT episode_index, decision, finding_count, round(quality_score, 6) AS quality_score FROM q WHERE integrity_status = 'valid' AND decision = 'review' AND quality_score >= 20 ORDER BY finding_count DESC, episode_index LIMIT 50 OFFSET 10", "findings", "reviews", "episodes"))
def query_episodes_page(spark: SparkSession, d: str) -> DataFrame:
    """A page is the feature here: 50 rows from the tenth on."""
    q = Q.query_episodes(proxy.episodes(spark, d), proxy.findings(spark, d), proxy.reviews(spark, d), integrity="valid", decision="review", minimum={"quality_score": 20.0}, sort="finding_count", descending=True, limit=50, offset=10)
    return q.select("episode_index", "decision", "finding_count", F.round("quality_score", 6).alias("quality_score"))


@query(with_views(_OPEN + "\nSELECT episode_index, task_text FROM episodes e WHERE EXISTS (SELECT 1 FROM op WHERE op.episode_index = e.episode_index AND issue_code IN ('R/F', 'A/F'))", "findings", "reviews", "episodes"))
def issue_semi_join(spark: SparkSession, d: str) -> DataFrame:
    hit = Q.open_findings(proxy.findings(spark, d), proxy.reviews(spark, d)).where(F.col("issue_code").isin("R/F", "A/F"))
    return proxy.episodes(spark, d).join(hit, "episode_index", "left_semi").select("episode_index", "task_text")


@query(with_views("SELECT episode_index, coalesce(manual_decision, auto_decision) AS decision FROM episodes", "episodes"))
def effective_decision(spark: SparkSession, d: str) -> DataFrame:
    return Q.effective_decision(proxy.episodes(spark, d)).select("episode_index", "decision")


@query(with_views("SELECT episode_index, task_text FROM episodes WHERE CAST(episode_index AS VARCHAR) ILIKE '%12%' OR task_text ILIKE '%HIGH%'", "episodes"))
def text_search(spark: SparkSession, d: str) -> DataFrame:
    e = proxy.episodes(spark, d)
    return e.where(F.col("episode_index").cast("string").ilike("%12%") | F.col("task_text").ilike("%HIGH%")).select("episode_index", "task_text")


@query(with_views("SELECT episode_index, CASE WHEN integrity_status = 'invalid' THEN 'invalid' ELSE 'selected' END AS part FROM episodes WHERE coalesce(manual_decision, auto_decision) = 'pass'", "episodes"))
def selection_split(spark: SparkSession, d: str) -> DataFrame:
    return Q.selection(proxy.episodes(spark, d), "pass")


@query(with_views("SELECT finding_id, row_number() OVER (PARTITION BY episode_index ORDER BY coalesce(start_s, -1), severity DESC, finding_id, review_status NULLS FIRST) AS place, review_status FROM findings LEFT JOIN reviews USING (finding_id)", "findings", "reviews"))
def finding_detail_order(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.findings(spark, d).join(proxy.reviews(spark, d), "finding_id", "left")
    return tables.finding_order(f).select("finding_id", "place", "review_status")


@query(with_views("SELECT finding_id || ',' || episode_index || ',' || issue_code || ',' || severity || ',' || coalesce(review_status, '') AS line FROM findings LEFT JOIN reviews USING (finding_id)", "findings", "reviews"))
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.findings(spark, d).join(proxy.reviews(spark, d), "finding_id", "left")
    return f.select(F.concat_ws(",", "finding_id", F.col("episode_index").cast("string"), "issue_code", "severity", F.coalesce("review_status", F.lit(""))).alias("line"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5""")
def retention_top_n(spark: SparkSession, d: str) -> DataFrame:
    """The five newest reports of each dataset stay."""
    return Q.latest(proxy.table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", 5).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_orderkey, CASE WHEN lower(trim(x)) IN ('pass', 'keep') THEN 'pass' WHEN lower(trim(x)) IN ('quarantine', 'exclude') THEN 'quarantine' ELSE 'review' END AS decision
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' Keep' WHEN 'O' THEN 'EXCLUDE' ELSE 'pending' END AS x FROM orders)""")
def decision_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("o_orderstatus") == "F", " Keep").when(F.col("o_orderstatus") == "O", "EXCLUDE").otherwise("pending")
    return proxy.table(spark, d, "orders").select("o_orderkey", Q.normalize_decision(x).alias("decision"))


@query(with_views("SELECT episode_index, substr(sha256(concat_ws('|', issue_code, severity, CAST(CAST(start_s AS INTEGER) AS VARCHAR))), 1, 24) AS signature FROM findings", "findings"))
def config_signature(spark: SparkSession, d: str) -> DataFrame:
    from epiframe.functions.control import signature

    return proxy.findings(spark, d).select("episode_index", signature(F.col("issue_code"), F.col("severity"), F.col("start_s").cast("int").cast("string")).alias("signature"))
