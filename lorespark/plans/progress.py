"""Queries on levels, sessions and answers, each with its SQL.

The driver's tables stand for the entities: region, nation, customer and supplier for subject, unit, point and word;
orders and lineitem for session and question (return flag A right, R wrong, N not answered); events for answers over time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.text import half_up
from lorespark.operators import progress as p
from lorespark.sources.tables import latest, read_table, remove

POINTS_SQL = """points AS (
  SELECT c_custkey AS point_id, c_nationkey AS unit_id, CAST(floor(abs(c_acctbal)) % 100 AS DOUBLE) AS level, nullif(c_custkey % 6, 0) AS importance,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_custkey * 1000 END AS last_studied_at
  FROM customer
), graded AS (SELECT *, coalesce(importance, 3) AS imp FROM points)"""
QUESTIONS_SQL = """questions AS (
  SELECT l_orderkey AS session_id, l_linenumber AS ord, l_partkey, l_suppkey, 1 + CAST(floor(l_quantity) AS BIGINT) % 5 AS importance,
         CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS correct
  FROM lineitem
)"""
ANSWERS_SQL = """answers AS (
  SELECT user_id AS target_id, ts, event_id, event_type IN ('purchase', 'signup') AS correct FROM events WHERE event_type <> 'view'
)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "customer")
    return t.select(
        F.col("c_custkey").alias("point_id"), F.col("c_nationkey").alias("unit_id"), (F.floor(F.abs("c_acctbal")) % 100).cast("double").alias("level"),
        F.nullif(F.col("c_custkey") % 6, F.lit(0)).alias("importance"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), None).otherwise(F.col("c_custkey") * 1000).alias("last_studied_at"),
    )


def units(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "nation").select(F.col("n_nationkey").alias("unit_id"), F.col("n_regionkey").alias("subject_id"))


def words(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "supplier").join(units(spark, d), F.col("s_nationkey") == F.col("unit_id"))
    return t.select("subject_id", "unit_id", F.col("s_suppkey").alias("word_id"), (F.floor(F.abs("s_acctbal")) % 100).cast("double").alias("level"))


def materials(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("material_id"), (F.col("doc_id") % 24).alias("unit_id"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "lineitem")
    right = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return t.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey", (1 + F.floor("l_quantity") % 5).alias("importance"), right.alias("correct"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "events").where("event_type <> 'view'")
    return t.select(F.col("user_id").alias("target_id"), "ts", "event_id", F.col("event_type").isin("purchase", "signup").alias("correct"))


def learn_fold(spark, d):
    return p.fold_results(answers(spark, d), ["target_id"], ["ts", "event_id"])


def learn_fold_half_weight(spark, d):
    return p.fold_results(answers(spark, d), ["target_id"], ["ts", "event_id"], weight=F.lit(0.5)).select("target_id", "level", "streak")


def _fold_sql(weight: str, columns: str) -> str:
    return f"""
WITH RECURSIVE {ANSWERS_SQL}, numbered AS (
  SELECT target_id, correct, row_number() OVER (PARTITION BY target_id ORDER BY ts, event_id) AS n FROM answers
), fold AS (
  SELECT target_id, 0 AS n, 0.0::DOUBLE AS level, 0 AS correct, 0 AS wrong, 0 AS streak, NULL::BOOLEAN AS last FROM (SELECT DISTINCT target_id FROM numbered)
  UNION ALL
  SELECT f.target_id, f.n + 1,
         floor(least(greatest(CASE WHEN a.correct THEN f.level + (100.0::DOUBLE - f.level) * (0.25::DOUBLE + 0.05::DOUBLE * least(f.streak + 1, 4)) * {weight}::DOUBLE
                                   ELSE f.level * (1.0::DOUBLE - 0.4::DOUBLE * {weight}::DOUBLE) END, 0.0::DOUBLE), 100.0::DOUBLE) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE,
         f.correct + a.correct::INT, f.wrong + (NOT a.correct)::INT, CASE WHEN a.correct THEN f.streak + 1 ELSE 0 END, a.correct
  FROM fold f JOIN numbered a ON a.target_id = f.target_id AND a.n = f.n + 1
)
SELECT {columns} FROM fold QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY n DESC) = 1"""


def unit_progress(spark, d):
    return p.unit_progress(points(spark, d))


def importance_histogram(spark, d):
    return points(spark, d).groupBy("unit_id", p.importance().alias("importance")).count().withColumnRenamed("count", "points")


def word_progress(spark, d):
    return words(spark, d).groupBy("subject_id").agg(half_up(F.avg("level")).alias("pct"), F.count("*").alias("item_count"))


def subject_progress_weighted(spark, d):
    return p.subject_progress(units(spark, d), points(spark, d), words(spark, d), materials(spark, d))


def subject_progress_mean_of_units(spark, d):
    return p.content_progress(units(spark, d), points(spark, d), materials(spark, d))


def session_score(spark, d):
    return p.session_scores(questions(spark, d))


def wrong_targets_latest(spark, d):
    """Records whose last attempt was wrong."""
    return p.wrong_records(answers(spark, d), ["target_id"], F.struct("ts", "event_id")).where("not last_correct").drop("last_correct")


def wrong_target_ids(spark, d):
    """Targets of wrong or unanswered questions, once each per session."""
    return questions(spark, d).where("not coalesce(correct, false)").select("session_id", F.col("l_partkey").alias("target_id")).distinct()


def result_left_join(spark, d):
    """Sessions with all their questions, also those without any."""
    s = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"))
    q = questions(spark, d).groupBy("session_id").agg(F.count("*").alias("questions"), F.count_if(F.col("correct").isNull()).alias("unanswered"))
    return s.join(q, "session_id", "left").select("session_id", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("unanswered", F.lit(0)).alias("unanswered"))


def unanswered_anti(spark, d):
    """Sessions in which no question was answered."""
    answered = questions(spark, d).where("correct is not null").select("session_id")
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id")).join(answered, "session_id", "left_anti")


def target_union_join(spark, d):
    """Questions joined to their target, a part or a supplier by the kind of the question."""
    q = questions(spark, d).select("session_id", F.when(F.col("importance") >= 4, "word").otherwise("point").alias("kind"), F.when(F.col("importance") >= 4, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("target_id"))
    t = read_table(spark, d, "part").where("p_size <= 25").select(F.lit("point").alias("kind"), F.col("p_partkey").alias("target_id"), F.col("p_name").alias("name"))
    t = t.unionByName(read_table(spark, d, "supplier").where("s_acctbal > 0").select(F.lit("word").alias("kind"), F.col("s_suppkey").alias("target_id"), F.col("s_name").alias("name")))
    return q.join(t, ["kind", "target_id"]).groupBy("kind", "target_id", "name").agg(F.count("*").alias("questions"))


def orphan_points_anti(spark, d):
    """Labels of documents that are not good, and documents without a label, counted by language."""
    labels = read_table(spark, d, "labels").select("doc_id")
    return read_table(spark, d, "documents").join(labels, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("orphans"))


def cascade_delete(spark, d):
    """Deleting a subject: what goes and what stays of its units, points and words."""
    gone = read_table(spark, d, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("subject_id"))
    kept_units, gone_units = remove(units(spark, d), gone, "subject_id")
    kept_points, gone_points = remove(points(spark, d), gone_units.select("unit_id"), "unit_id")
    kept_words, gone_words = remove(words(spark, d), gone, "subject_id")
    count = lambda t, name, kept: t.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), F.lit(kept).alias("kept"), "n")
    parts = [count(kept_units, "units", True), count(gone_units, "units", False), count(kept_points, "points", True), count(gone_points, "points", False), count(kept_words, "words", True), count(gone_words, "words", False)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest_sessions_topn(spark, d):
    """The three latest finished sessions of each customer."""
    t = read_table(spark, d, "orders").where("o_orderstatus = 'F'")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return t.withColumn("n", n).where("n <= 3").select("o_custkey", "n", "o_orderkey")


def session_delta_lag(spark, d):
    """Change of the price from a customer's order to the next, in cents."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    before = F.lag("cents").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read_table(spark, d, "orders").withColumn("cents", cents).withColumn("delta", F.col("cents") - before).select("o_orderkey", "o_custkey", "delta")


def generator_summary(spark, d):
    """Whether a session's questions are all of one kind of shipment, or mixed."""
    t = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count("*").alias("n"))
    return t.select("session_id", F.when(F.col("f") == 0, "local").when(F.col("f") == F.col("n"), "ai").otherwise("mixed").alias("summary"))


def material_point_counts(spark, d):
    return units(spark, d).join(points(spark, d).groupBy("unit_id").agg(F.count("*").alias("n")), "unit_id", "left").select("unit_id", F.coalesce("n", F.lit(0)).alias("points"))


def upsert_latest(spark, d):
    """Event-at-a-time writes by key: each user's last event is what the store holds."""
    kept = latest(read_table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return kept.select("user_id", "event_id", "event_type")


def json_props(spark, d):
    t = read_table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return t.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("highest"))


def answer_streaks(spark, d):
    """Lengths of each target's runs of right answers: islands between wrong ones."""
    ordered = Window.partitionBy("target_id").orderBy("ts", "event_id")
    island = F.sum((~F.col("correct")).cast("int")).over(ordered)
    runs = answers(spark, d).withColumn("island", island).where("correct").groupBy("target_id", "island").agg(F.count("*").alias("run"))
    return runs.groupBy("target_id").agg(F.max("run").alias("longest"), F.count("*").alias("runs"))


def previous_turns(spark, d):
    """Each turn with the one before it in its conversation, and how many turns of its role came before."""
    talk = Window.partitionBy("conv_id").orderBy("turn", "text")
    same = Window.partitionBy("conv_id", "role").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1)
    return read_table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(talk).alias("before"), F.count("*").over(same).alias("earlier"))


QUERIES = {
    "learn_fold": (learn_fold, _fold_sql("1.0", "target_id, level, correct, wrong, streak, last")),
    "learn_fold_half_weight": (learn_fold_half_weight, _fold_sql("0.5", "target_id, level, streak")),
    "unit_progress": (unit_progress, f"""WITH {POINTS_SQL} SELECT unit_id, CAST(floor(avg(level) + 0.5) AS BIGINT) AS pct, CAST(floor(avg(CASE WHEN imp >= 4 THEN level END) + 0.5) AS BIGINT) AS core_pct,
  count(*) FILTER (imp = 5) AS importance_5, count(*) FILTER (imp = 4) AS importance_4, count(*) FILTER (imp = 3) AS importance_3, count(*) FILTER (imp = 2) AS importance_2, count(*) FILTER (imp = 1) AS importance_1,
  count(*) AS point_count, count(nullif(last_studied_at, 0)) AS studied_count, nullif(max(coalesce(last_studied_at, 0)), 0) AS last_studied_at FROM graded GROUP BY unit_id"""),
    "importance_histogram": (importance_histogram, f"WITH {POINTS_SQL} SELECT unit_id, imp AS importance, count(*) AS points FROM graded GROUP BY ALL"),
    "word_progress": (word_progress, "SELECT n_regionkey AS subject_id, CAST(floor(avg(floor(abs(s_acctbal)) % 100) + 0.5) AS BIGINT) AS pct, count(*) AS item_count FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "subject_progress_weighted": (subject_progress_weighted, f"""WITH {POINTS_SQL}, items AS (
  SELECT n_regionkey AS subject_id, level, 1 AS point FROM points JOIN nation ON unit_id = n_nationkey
  UNION ALL SELECT n_regionkey, 0, 1 FROM nation WHERE n_nationkey IN (SELECT doc_id % 24 FROM documents) AND n_nationkey NOT IN (SELECT unit_id FROM points)
  UNION ALL SELECT n_regionkey, floor(abs(s_acctbal)) % 100, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT subject_id, CAST(floor(avg(level) + 0.5) AS BIGINT) AS pct, count(*) FILTER (point = 1) AS point_count, count(*) FILTER (point = 0) AS word_count FROM items GROUP BY 1"""),
    "subject_progress_mean_of_units": (subject_progress_mean_of_units, f"""WITH {POINTS_SQL}, u AS (
  SELECT n_regionkey AS subject_id, n_nationkey, (SELECT floor(avg(level) + 0.5) FROM points WHERE unit_id = n_nationkey) AS pct FROM nation)
SELECT subject_id, CAST(floor(avg(coalesce(pct, 0)) + 0.5) AS BIGINT) AS pct, count(*) AS units FROM u WHERE pct IS NOT NULL OR n_nationkey IN (SELECT doc_id % 24 FROM documents) GROUP BY 1"""),
    "session_score": (session_score, f"""WITH {QUESTIONS_SQL} SELECT session_id, count(*) AS total, count(correct) AS answered, count(*) FILTER (correct) AS correct_count,
  count(correct) - count(*) FILTER (correct) AS wrong_count, CAST(floor((count(*) FILTER (correct)) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS score_percent,
  count(*) FILTER (importance >= 4) AS core_total, count(*) FILTER (importance >= 4 AND correct) AS core_correct FROM questions GROUP BY 1"""),
    "wrong_targets_latest": (wrong_targets_latest, f"""WITH {ANSWERS_SQL} SELECT target_id, count(*) FILTER (NOT correct) AS wrong_count, count(*) FILTER (correct) AS correct_count
FROM answers GROUP BY 1 HAVING NOT arg_max(correct, (ts, event_id))"""),
    "wrong_target_ids": (wrong_target_ids, f"WITH {QUESTIONS_SQL} SELECT DISTINCT session_id, l_partkey AS target_id FROM questions WHERE correct IS NOT TRUE"),
    "result_left_join": (result_left_join, f"""WITH {QUESTIONS_SQL} SELECT o_orderkey AS session_id, count(q.session_id) AS questions, count(*) FILTER (q.session_id IS NOT NULL AND correct IS NULL) AS unanswered
FROM orders LEFT JOIN questions q ON o_orderkey = q.session_id GROUP BY 1"""),
    "unanswered_anti": (unanswered_anti, f"WITH {QUESTIONS_SQL} SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey NOT IN (SELECT session_id FROM questions WHERE correct IS NOT NULL)"),
    "target_union_join": (target_union_join, f"""WITH {QUESTIONS_SQL}, t AS (
  SELECT 'point' AS kind, p_partkey AS target_id, p_name AS name FROM part WHERE p_size <= 25 UNION ALL SELECT 'word', s_suppkey, s_name FROM supplier WHERE s_acctbal > 0)
SELECT t.kind, t.target_id, t.name, count(*) AS questions FROM questions JOIN t ON t.kind = CASE WHEN importance >= 4 THEN 'word' ELSE 'point' END AND t.target_id = CASE WHEN importance >= 4 THEN l_suppkey ELSE l_partkey END GROUP BY ALL"""),
    "orphan_points_anti": (orphan_points_anti, "SELECT lang, count(*) AS orphans FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"),
    "cascade_delete": (cascade_delete, f"""WITH {POINTS_SQL}, g AS (SELECT n_nationkey, r_name = 'ASIA' AS gone FROM nation JOIN region ON n_regionkey = r_regionkey),
  rows AS (SELECT 'units' AS store, gone FROM g UNION ALL SELECT 'points', gone FROM points JOIN g ON unit_id = n_nationkey UNION ALL SELECT 'words', gone FROM supplier JOIN g ON s_nationkey = n_nationkey)
SELECT s AS store, k AS kept, count(rows.store) AS n FROM (SELECT unnest(['units', 'points', 'words']) AS s) CROSS JOIN (SELECT unnest([TRUE, FALSE]) AS k) LEFT JOIN rows ON store = s AND gone = NOT k GROUP BY ALL"""),
    "latest_sessions_topn": (latest_sessions_topn, "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS n, o_orderkey FROM orders WHERE o_orderstatus = 'F' QUALIFY n <= 3"),
    "session_delta_lag": (session_delta_lag, "WITH c AS (SELECT *, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders) SELECT o_orderkey, o_custkey, cents - lag(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS delta FROM c"),
    "generator_summary": (generator_summary, "SELECT l_orderkey AS session_id, CASE WHEN count(*) FILTER (l_linestatus = 'F') = 0 THEN 'local' WHEN count(*) FILTER (l_linestatus = 'F') = count(*) THEN 'ai' ELSE 'mixed' END AS summary FROM lineitem GROUP BY 1"),
    "material_point_counts": (material_point_counts, f"WITH {POINTS_SQL} SELECT n_nationkey AS unit_id, count(point_id) AS points FROM nation LEFT JOIN points ON unit_id = n_nationkey GROUP BY 1"),
    "upsert_latest": (upsert_latest, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "json_props": (json_props, "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS highest FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"),
    "answer_streaks": (answer_streaks, f"""WITH {ANSWERS_SQL}, i AS (SELECT *, sum((NOT correct)::INT) OVER (PARTITION BY target_id ORDER BY ts, event_id) AS island FROM answers),
  r AS (SELECT target_id, island, count(*) AS run FROM i WHERE correct GROUP BY ALL) SELECT target_id, max(run) AS longest, count(*) AS runs FROM r GROUP BY 1"""),
    "previous_turns": (previous_turns, """SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before,
  count(*) OVER (PARTITION BY conv_id, role ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM conversations"""),
}
