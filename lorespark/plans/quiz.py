"""Queries on question sets, each with its SQL: parts and customers stand for points, orders for sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorespark.functions.text import make_blank, normalize_text
from lorespark.operators import quiz as q
from lorespark.plans.progress import POINTS_SQL, QUESTIONS_SQL, points, questions
from lorespark.plans.texts import key_sql
from lorespark.sources.tables import backfilled, next_order, read_table

COUNT_SQL = "CAST(CASE WHEN n <= 0 THEN 0 WHEN n <= 5 THEN least(greatest(n * 2, 5), 10) WHEN n <= 12 THEN least(greatest(floor(n * 1.3::DOUBLE + 0.5), 10), 15) WHEN n <= 30 THEN least(greatest(floor(n * 1.15::DOUBLE + 0.5), 15), 30) ELSE greatest(30, n) END AS INT)"
QUOTA_SQL = f"""{POINTS_SQL}, g AS (SELECT unit_id, greatest(least(imp, 5), 2) AS grp, count(*) AS targets FROM graded GROUP BY ALL),
  w AS (SELECT *, CASE grp WHEN 5 THEN 0.45::DOUBLE WHEN 4 THEN 0.275::DOUBLE WHEN 3 THEN 0.175::DOUBLE ELSE 0.1::DOUBLE END AS share, sum(targets) OVER (PARTITION BY unit_id) AS n FROM g),
  d AS (SELECT unit_id, CAST(grp AS INT) AS grp, targets, share / sum(share) OVER (PARTITION BY unit_id) * {COUNT_SQL} AS desired FROM w)"""
#: Kinds of questions by a number.
KINDS = ("OX", "MULTIPLE_CHOICE", "FILL_BLANK", "SHORT_ANSWER", "SUBJECTIVE", "DESCRIPTIVE")


def decide_count(spark, d):
    """Questions for as many points as each part's size, and for up to 130."""
    n = F.col("p_size") + F.when(F.col("p_partkey") % 9 == 0, 80).otherwise(0) - 2
    return read_table(spark, d, "part").select(n.cast("long").alias("n")).distinct().select("n", q.decide_count(F.col("n")).alias("questions"))


def quota_desired(spark, d):
    return q.quotas(points(spark, d)).withColumn("desired", F.round("desired", 6))


def quota_allocation(spark, d):
    return q.largest_remainder(q.quotas(points(spark, d)))


def question_plan(spark, d):
    """Per unit and importance group, how often its points are asked; the draw is seeded."""
    p = points(spark, d).select("unit_id", F.col("point_id").alias("target_id"), F.col("importance").cast("int"), "level", F.lit(0).alias("wrong_count"), F.col("last_studied_at").isNotNull().alias("studied"))
    return q.plan_questions(p)


def coverage_missing(spark, d):
    """Points of importance 2 and up whose number is no part of any order: not asked yet."""
    asked = read_table(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity > 45").select(F.col("l_partkey").alias("point_id"))
    return points(spark, d).where("coalesce(importance, 3) >= 2").join(asked, "point_id", "left_anti").select("point_id", "unit_id")


def detail_rotation_topk(spark, d):
    """The three detail points of a unit whose turn it is: not studied first, then weak ones."""
    turn = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.col("last_studied_at").isNotNull(), "level", "point_id"))
    return points(spark, d).where("importance = 1").withColumn("n", turn).where("n <= 3").select("unit_id", "n", "point_id")


def study_deck_topk(spark, d):
    """The twenty cards to study next: weak and important ones first."""
    key = F.col("level") - 8 * F.coalesce("importance", F.lit(3))
    return points(spark, d).withColumn("sort_key", key).orderBy("sort_key", "point_id").limit(20).select("point_id", "sort_key")


def blank_cards_order(spark, d):
    """Cards of parts with their brand blanked, in order of importance within a type."""
    text = F.concat_ws(" ", "p_brand", F.lit("is the brand of"), "p_name")
    order = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc(F.col("p_size") % 5), "p_partkey"))
    return read_table(spark, d, "part").select("p_partkey", order.alias("n"), make_blank(text, F.col("p_brand")).alias("card"))


def distractor_topn(spark, d):
    """Three wrong options for each part's type among those of its brand: those with its first word first."""
    category, is_answer = F.substring_index("p_type", " ", 1).alias("category"), (F.col("p_size") % 2 == 0).alias("is_answer")
    t = read_table(spark, d, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_brand").alias("unit_id"), F.col("p_type").alias("answer"), category, is_answer)
    return q.distractors(t, 3)


def grade_answers(spark, d):
    """Answers graded by kind: here a part's type against a type that is often its own; essays stay open."""
    t = read_table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % 6 + 1).cast("int"))
    given = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), "p_name", F.lit("."))).otherwise(F.lit(""))
    mark = q.grade(kind, F.col("p_type"), F.array("p_name"), given)
    return t.select("p_partkey", kind.alias("kind"), q.grade_mode(kind).alias("mode"), q.difficulty(kind).alias("difficulty"), mark.alias("correct"))


def question_reasons(spark, d):
    """Why questions made from benchmark items would be rejected: counts by reason."""
    t = read_table(spark, d, "benchmark")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("item_id") % 6 + 1).cast("int"))
    text, answer = F.col("text"), F.regexp_extract("text", r"^(\S+\s+\S+)", 1)
    question = F.when(kind == "FILL_BLANK", make_blank(text, answer)).when(F.col("item_id") % 4 == 0, text).otherwise(F.substring_index("text", " ", 6))
    reasons = q.quality_reasons(kind, question, F.array(answer, F.lit("none of these")), answer, text, text, text, F.lit(3))
    return t.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def reason_histogram(spark, d):
    """The rejection reasons that counting can show: short, repeated or self-answering questions on orders."""
    t = read_table(spark, d, "orders")
    reasons = F.array(F.when(F.col("o_totalprice") < 50_000, "small"), F.when(F.col("o_orderstatus") == "O", "open"), F.when(F.col("o_orderpriority").startswith("5"), "low"))
    return t.select(F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def accepted_questions(spark, d):
    """Lines of an order accepted in turn: none with the supplier and kind, or nearly the words, of one before it."""
    t = questions(spark, d).join(read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("ord", "l_partkey", "l_suppkey", "importance"))
    t = t.withColumn("ord", n).select("session_id", "ord", F.col("l_suppkey").alias("target_id"), F.col("importance").cast("string").alias("type"), F.col("p_name").alias("question"))
    return q.accept_in_order(t)


def weighted_sample(spark, d):
    """Ten parts of each brand, drawn by weight."""
    t = read_table(spark, d, "part")
    return q.weighted_sample(t, F.col("p_size").cast("double"), 10, by=["p_brand"], id_column="p_partkey").select("p_brand", "p_partkey")


def shuffle_spread(spark, d):
    """Lines of each order, on one of three targets each, in an order in which a target's lines are parted."""
    t = questions(spark, d).select("session_id", (F.col("l_suppkey") % 3).alias("target_id"), F.concat_ws(":", "ord", "l_partkey", "l_suppkey").alias("question_id")).distinct()
    return q.spread(t)


SECTIONS = ("ECONOMY", "STANDARD", "PROMO")


def summary_sections(spark, d):
    """Each brand's parts as a summary: sizes stand for importance, types for categories."""
    t = read_table(spark, d, "part").select(F.col("p_brand").alias("unit_id"), (1 + F.col("p_size") % 5).alias("importance"), F.element_at(F.split("p_type", " "), 1).alias("category"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"))
    s = q.summary_sections(t, SECTIONS)
    return s.select("unit_id", "place", "section", F.size("items").alias("n"), F.md5(F.array_join("items", ",")).alias("items_md5"))


def migrate_backfill(spark, d):
    """Orders as materials without texts, their lines as images: texts are put together in order."""
    none = F.lit(None).cast("string")
    m = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), none.alias("raw_text"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).alias("final_text"), F.lit(None).cast("array<string>").alias("image_ids"), none.alias("material_type"), none.alias("study_mode"))
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("material_id"), F.col("l_linenumber").alias("order_index")).agg(F.min("l_partkey").cast("string").alias("id"), F.min("l_shipdate").cast("date").cast("string").alias("raw_text"))
    b = backfilled(m, lines)
    return b.select("id", F.md5("raw_text").alias("raw_md5"), F.length("final_text").alias("final_length"), F.coalesce(F.size("image_ids"), F.lit(-1)).alias("images"), "material_type", "study_mode")


def order_continued(spark, d):
    """New units continue their subject's order: suppliers behind the nations of a region."""
    have = read_table(spark, d, "nation").select(F.col("n_regionkey").alias("subject_id"), F.col("n_nationkey").alias("order_index"))
    new = read_table(spark, d, "supplier").select((F.col("s_nationkey") % 7).alias("subject_id"), F.col("s_suppkey"))
    return next_order(have, "subject_id", new, [F.col("s_suppkey")]).select("subject_id", "s_suppkey", F.col("order_index").cast("long").alias("order_index"))


def points_kept_by_text(spark, d):
    """Old and new points matched one to one by normalised text: the later old one of equal keys wins."""
    old = read_table(spark, d, "part").where("p_partkey % 2 = 0").withColumn("key", normalize_text(F.col("p_type")))
    new = read_table(spark, d, "part").where("p_partkey % 2 = 1").withColumn("key", normalize_text(F.col("p_type")))
    n = F.row_number().over(Window.partitionBy("p_brand", "key").orderBy("p_partkey"))
    last = F.row_number().over(Window.partitionBy("p_brand", "key").orderBy(F.desc("p_partkey")))
    old = old.withColumn("n", last).where("n = 1").select("p_brand", "key", F.col("p_partkey").alias("old_id"), "n")
    return new.withColumn("n", n).join(old, ["p_brand", "key", "n"], "left").select("p_partkey", "old_id")


_DRAWN = "(CAST('0x' || md5('{0}:' || unit_id || ':' || target_id)[1:12] AS BIGINT) + 1) / 281474976710656.0::DOUBLE"
#: CTEs from ``t`` (unit_id, target_id, grp, imp, level, studied) to ``planned`` (unit_id, target_id, times; 0 for skipped details).
PLAN_STEPS = f"""u AS (
  SELECT unit_id, count(*) AS n, count(*) FILTER (imp = 1) AS details, count(*) FILTER (imp >= 2) AS required, count(*) FILTER (imp = 2) AS low_required,
    max(CASE grp WHEN 5 THEN 0.45::DOUBLE ELSE 0 END) + max(CASE grp WHEN 4 THEN 0.275::DOUBLE ELSE 0 END) + max(CASE grp WHEN 3 THEN 0.175::DOUBLE ELSE 0 END) + max(CASE grp WHEN 2 THEN 0.1::DOUBLE ELSE 0 END) AS shares,
    max(CASE grp WHEN 2 THEN 0.1::DOUBLE ELSE 0 END) AS low_share FROM t GROUP BY unit_id
), b AS (
  SELECT *, {COUNT_SQL} AS asks, CASE WHEN required = 0 THEN details ELSE greatest(least(1, details), floor(low_share / shares * {COUNT_SQL} - low_required + 0.5)) END AS budget FROM u
), c AS (
  SELECT t.*, asks, shares, required, imp >= 2 OR row_number() OVER (PARTITION BY unit_id, imp = 1 ORDER BY CASE WHEN studied THEN 1000 ELSE 0 END + level + {_DRAWN.format(1)} * 20, target_id) <= budget AS covered FROM t JOIN b USING (unit_id)
), g AS (
  SELECT *, CASE grp WHEN 5 THEN 0.45::DOUBLE WHEN 4 THEN 0.275::DOUBLE WHEN 3 THEN 0.175::DOUBLE ELSE 0.1::DOUBLE END / shares * asks - sum(covered::INT) OVER (PARTITION BY unit_id, grp) AS lacks,
    sum(covered::INT) OVER (PARTITION BY unit_id) AS base, sum((covered AND grp = 2)::INT) OVER (PARTITION BY unit_id) AS low, 110 - level AS weak FROM c
), waits AS (
  SELECT *, -ln({_DRAWN.format(2)}) / (weak * (1 + imp / 5.0::DOUBLE)) AS w1, w1 - ln({_DRAWN.format(3)}) / (weak * (1 + imp / 5.0::DOUBLE) * 0.35::DOUBLE) AS w2 FROM g WHERE covered
), again AS (
  SELECT *, w1 AS w, 0 AS k FROM waits WHERE imp >= 3 UNION ALL SELECT *, w2, 1 FROM waits WHERE imp = 5
), ranked AS (
  SELECT *, round(lacks - row_number() OVER (PARTITION BY unit_id, grp ORDER BY w, target_id, k) + 1, 9) AS need FROM again
), taken AS (
  SELECT unit_id, target_id FROM ranked QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY need DESC, grp DESC) <= greatest(asks, base, CASE WHEN low > 0 AND required > low THEN ceil(low / 0.15::DOUBLE) ELSE 0 END) - base
), planned AS (
  SELECT unit_id, target_id, CAST(sum(n) AS INT) AS times FROM (SELECT unit_id, target_id, 1 AS n FROM taken UNION ALL SELECT unit_id, target_id, covered::INT FROM c) x GROUP BY ALL
)"""
PLAN_SQL = f"""WITH {POINTS_SQL}, t AS (
  SELECT unit_id, point_id AS target_id, greatest(least(imp, 5), 2) AS grp, greatest(least(imp, 5), 1) AS imp, coalesce(level, 0)::DOUBLE AS level, last_studied_at IS NOT NULL AS studied FROM graded
), {PLAN_STEPS} SELECT * FROM planned WHERE times > 0"""


QUERIES = {
    "decide_count": (decide_count, f"WITH n AS (SELECT DISTINCT CAST(p_size + CASE WHEN p_partkey % 9 = 0 THEN 80 ELSE 0 END - 2 AS BIGINT) AS n FROM part) SELECT n, {COUNT_SQL} AS questions FROM n"),
    "quota_desired": (quota_desired, f"WITH {QUOTA_SQL} SELECT unit_id, grp, targets, round(desired, 6) AS desired FROM d"),
    "quota_allocation": (quota_allocation, f"""WITH {QUOTA_SQL}, b AS (SELECT *, floor(desired) AS base, floor(sum(desired) OVER (PARTITION BY unit_id) - sum(floor(desired)) OVER (PARTITION BY unit_id) + 0.5) AS missing FROM d)
SELECT unit_id, grp, targets, CAST(base + (row_number() OVER (PARTITION BY unit_id ORDER BY round(desired - base, 9) DESC, grp DESC) <= missing)::INT AS INT) AS questions FROM b"""),
    "question_plan": (question_plan, PLAN_SQL),
    "coverage_missing": (coverage_missing, f"WITH {POINTS_SQL} SELECT point_id, unit_id FROM graded WHERE imp >= 2 AND point_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)"),
    "detail_rotation_topk": (detail_rotation_topk, f"WITH {POINTS_SQL} SELECT unit_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY last_studied_at IS NOT NULL, level, point_id) AS INT) AS n, point_id FROM points WHERE importance = 1 QUALIFY n <= 3"),
    "study_deck_topk": (study_deck_topk, f"WITH {POINTS_SQL} SELECT point_id, level - 8 * imp AS sort_key FROM graded ORDER BY sort_key, point_id LIMIT 20"),
    "blank_cards_order": (blank_cards_order, "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size % 5 DESC, p_partkey) AS INT) AS n, '[      ] is the brand of ' || p_name AS card FROM part"),
    "distractor_topn": (distractor_topn, f"""WITH o AS (SELECT p_partkey AS id, p_brand AS pool, p_type AS answer, {key_sql('p_type')} AS k, split_part(p_type, ' ', 1) AS category, p_size % 2 = 0 AS is_answer FROM part),
  a AS (SELECT pool, k AS ok, category AS other, min(answer) AS option, max(is_answer) AS answers FROM o WHERE k <> '' GROUP BY ALL),
  f AS (SELECT id, ok, option, category = other AS same, answers, md5('1:' || id || ':' || ok) AS draw FROM o JOIN a USING (pool) WHERE k <> '' AND NOT contains(k, ok) AND NOT contains(ok, k) AND regexp_matches(k, '[0-9]') = regexp_matches(ok, '[0-9]')),
  u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id, ok ORDER BY same DESC, answers DESC, draw, option) = 1)
SELECT id AS point_id, CAST(row_number() OVER (PARTITION BY id ORDER BY same DESC, answers DESC, draw, option) AS INT) AS n, option FROM u QUALIFY n <= 3"""),
    "grade_answers": (grade_answers, f"""WITH g AS (SELECT p_partkey, ['OX', 'MULTIPLE_CHOICE', 'FILL_BLANK', 'SHORT_ANSWER', 'SUBJECTIVE', 'DESCRIPTIVE'][p_size % 6 + 1] AS kind, {key_sql('p_type')} AS k1, {key_sql('p_name')} AS k2,
  CASE p_partkey % 3 WHEN 0 THEN {key_sql('p_type')} WHEN 1 THEN {key_sql('p_name')} ELSE '' END AS u FROM part)
SELECT p_partkey, kind, CASE WHEN kind IN ('OX', 'MULTIPLE_CHOICE') THEN 'choice' WHEN kind IN ('FILL_BLANK', 'SHORT_ANSWER') THEN 'text' ELSE 'self' END AS mode,
  CASE WHEN kind IN ('OX', 'MULTIPLE_CHOICE') THEN 'EASY' WHEN kind IN ('FILL_BLANK', 'SHORT_ANSWER') THEN 'MEDIUM' ELSE 'HARD' END AS difficulty,
  CASE WHEN u <> '' AND (u = k1 OR u = k2) THEN TRUE WHEN kind IN ('SUBJECTIVE', 'DESCRIPTIVE') THEN NULL ELSE FALSE END AS correct FROM g"""),
    "question_reasons": (question_reasons, None),
    "reason_histogram": (reason_histogram, "SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN o_totalprice < 50000 THEN 'small' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'low' END]) AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY 1"),
    "accepted_questions": (accepted_questions, None),
    "weighted_sample": (weighted_sample, """WITH k AS (SELECT p_brand, p_partkey, -ln((('0x' || substr(md5('1:' || p_partkey), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / greatest(p_size::DOUBLE, 1e-12) AS key FROM part)
SELECT p_brand, p_partkey FROM k QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY key, p_partkey) <= 10"""),
    "shuffle_spread": (shuffle_spread, f"""WITH {QUESTIONS_SQL}, t AS (SELECT DISTINCT session_id, ord || ':' || l_partkey || ':' || l_suppkey AS question_id, l_suppkey % 3 AS target_id FROM questions),
  o AS (SELECT session_id, list({{'q': question_id, 't': target_id}} ORDER BY md5('1:' || session_id || ':' || question_id), question_id) AS a FROM t GROUP BY 1),
  s AS (SELECT session_id, list_reduce(list_prepend(a, list_transform(range(2, len(a) + 1), lambda i: [{{'q': CAST(i AS VARCHAR), 't': CAST(i AS BIGINT)}}])), lambda a, x:
    CASE WHEN a[x[1].t].t = a[x[1].t - 1].t THEN list_transform([coalesce(list_filter(range(x[1].t + 1, len(a) + 1), lambda k: a[k].t <> a[x[1].t].t AND (k = len(a) OR a[k + 1].t <> a[x[1].t].t))[1], x[1].t)],
      lambda k: list_transform(range(1, len(a) + 1), lambda m: CASE WHEN m = x[1].t THEN a[k] WHEN m = k THEN a[x[1].t] ELSE a[m] END))[1] ELSE a END) AS a FROM o)
SELECT session_id, unnest(a).q AS question_id, CAST(unnest(range(len(a))) AS INT) AS ord FROM s"""),
    "summary_sections": (summary_sections, """WITH p AS (SELECT p_brand AS unit_id, 1 + p_size % 5 AS imp, split_part(p_type, ' ', 1) AS category, p_partkey, p_name FROM part),
  s AS (SELECT *, CASE WHEN category IN ('ECONOMY', 'STANDARD', 'PROMO') THEN category ELSE '특징' END AS cat FROM p)
SELECT unit_id, CASE WHEN imp >= 5 THEN 0 WHEN imp <= 2 THEN 99 ELSE coalesce(nullif(list_position(['ECONOMY', 'STANDARD', 'PROMO'], cat), 0), 98) END AS place,
  CASE WHEN imp >= 5 THEN '반드시 암기할 내용' WHEN imp <= 2 THEN '참고·세부' ELSE cat END AS section, CAST(count(*) AS INT) AS n, md5(string_agg(p_name, ',' ORDER BY imp DESC, p_partkey)) AS items_md5 FROM s GROUP BY 1, 2, 3"""),
    "migrate_backfill": (migrate_backfill, """WITH i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS id, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS t FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, string_agg(t, chr(10) || chr(10) ORDER BY l_linenumber) AS t, count(*) AS n FROM i GROUP BY 1)
SELECT o_orderkey AS id, md5(coalesce(t, '')) AS raw_md5, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE length(coalesce(t, '')) END AS INT) AS final_length, CAST(coalesce(n, -1) AS INT) AS images, CASE WHEN n IS NULL THEN 'TEXT' ELSE 'PHOTO' END AS material_type, 'content' AS study_mode FROM orders LEFT JOIN a ON o_orderkey = l_orderkey"""),
    "order_continued": (order_continued, """SELECT s_nationkey % 7 AS subject_id, s_suppkey, coalesce((SELECT max(n_nationkey) FROM nation WHERE n_regionkey = s_nationkey % 7), -1) + row_number() OVER (PARTITION BY s_nationkey % 7 ORDER BY s_suppkey) AS order_index FROM supplier"""),
    "points_kept_by_text": (points_kept_by_text, f"""WITH k AS (SELECT *, {key_sql('p_type')} AS key FROM part), o AS (SELECT p_brand, key, max(p_partkey) AS old_id FROM k WHERE p_partkey % 2 = 0 GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, key ORDER BY p_partkey) AS n FROM k WHERE p_partkey % 2 = 1) SELECT n.p_partkey, CASE WHEN n = 1 THEN old_id END AS old_id FROM n LEFT JOIN o USING (p_brand, key)"""),
}
