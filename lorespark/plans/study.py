"""Queries on points, sessions, words and tests as wholes, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions.text import SEPARATORS, hash_string
from lorespark.operators import assembly, study, words
from lorespark.plans.progress import POINTS_SQL, QUESTIONS_SQL, points, questions
from lorespark.plans.quiz import PLAN_STEPS
from lorespark.plans.texts import LINES_SQL, documents, key_sql
from lorespark.sources.tables import read_table, settled

KINDS = ("OX", "MULTIPLE_CHOICE", "FILL_BLANK", "SHORT_ANSWER", "SUBJECTIVE", "DESCRIPTIVE")
NOW = 1_700_000_000_000


def analyzed_points(spark, d):
    """Every turn of a conversation as a material, and its key points: sentence, importance, category and blank."""
    turns = read_table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn", "role").alias("material_id"), "text")
    rows = study.analyzed_points(turns)
    return rows.select("material_id", "order_index", F.md5("text").alias("text_md5"), "importance", "category", "answer")


def refreshed_points(spark, d):
    """Benchmark items as materials whose points were made from their first half: what a refresh takes over, adds and drops.

    Every fifth material has an up-to-date hash and stays; materials divisible by seven are gone.
    """
    docs = read_table(spark, d, "benchmark").select(F.col("item_id").alias("material_id"), (F.col("item_id") % 24).alias("unit_id"), "text")
    before = docs.withColumn("text", F.when(F.col("material_id") % 5 == 0, F.col("text")).otherwise(F.substring("text", F.lit(1), F.ceil(F.length("text") / 2).cast("int"))))
    old = settled(study.analyzed_points(before.select("material_id", "text"))).join(docs.select("material_id", "unit_id"), "material_id")
    fixed = {"study_level": 40.0, "correct_count": 2, "wrong_count": 1, "streak": 1, "last_result": True, "last_studied_at": 5, "last_question_type": "OX", "created_at": 1}
    old = old.withColumn("id", F.concat_ws("-", "material_id", "order_index")).withColumns({c: F.lit(v).cast(study.LEARNING.get(c, "bigint")) for c, v in fixed.items()})
    old = old.withColumn("origin", F.lit("local")).withColumn("updated_at", F.lit(1).cast("bigint"))
    kept = docs.where("material_id % 7 <> 0")
    fresh_hash = F.when(F.col("material_id") % 5 == 0, hash_string(F.col("text"))).otherwise(F.lit("0:0"))
    kept = kept.withColumns({"points_hash": fresh_hash, "points_origin": F.lit("local"), "points_version": F.lit(study.ANALYSIS_VERSION)})
    after, _ = study.refreshed_points(kept, old, now=F.lit(NOW))
    return after.groupBy("material_id").agg(F.count("*").alias("points"), F.count_if(F.col("created_at") == 1).alias("taken_over"), F.count_if(F.col("updated_at") == 1).alias("untouched"))


def _finished(spark, d):
    s = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") % 25).alias("unit_id"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(7).cast("bigint")).alias("finished_at"))
    q_ = questions(spark, d).withColumn("question_id", F.concat_ws(":", "session_id", "ord", "l_partkey", "l_suppkey"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("importance") % 6 + 1).cast("int"))
    q_ = q_.select("session_id", "ord", "question_id", F.col("l_partkey").alias("target_id"), kind.alias("type"), "importance", "correct")
    p = points(spark, d).withColumns({"correct": F.lit(0), "wrong": F.lit(0), "streak": F.lit(0), "last": F.lit(None).cast("boolean"), "last_question_type": F.lit(None).cast("string")})
    return study.finished_sessions(s, q_, p, F.lit(NOW))


def finished_sessions(spark, d):
    """Orders as sessions, a quarter of them finished before: their counts and percentages."""
    sessions, _, _ = _finished(spark, d)
    return sessions.select("session_id", "total", "answered", "correct_count", "score_percent", "core_total", "core_correct", "pct_before", "pct_after", "finished_at")


def finished_points(spark, d):
    """The points after all open sessions: levels folded from where they stood, last kinds and times."""
    _, after, _ = _finished(spark, d)
    return after.select("point_id", "level", "correct", "wrong", "streak", "last", "last_question_type", "last_studied_at")


def finished_records(spark, d):
    """The wrong-answer records that finishing the open sessions makes."""
    return _finished(spark, d)[2]


def term_items(spark, d):
    """Terms and definitions of documents' lines, and the lines left unparsed."""
    rows = words.parsed_items(documents(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", "line_no", F.md5("term").alias("term_md5"), F.md5("definition").alias("definition_md5"))


def _items(spark, d):
    t = read_table(spark, d, "part")
    return t.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("pool"), F.col("p_name").alias("term"), F.col("p_type").alias("definition"))


def word_questions(spark, d):
    """Parts as words with their types as definitions: for each kind, how many can ask for it and how their answers lie."""
    rows = words.word_questions(_items(spark, d)).join(_items(spark, d).select("item_id", "term", "definition"), "item_id")
    fits = (
        F.when(F.col("type") == "MULTIPLE_CHOICE", F.array_contains("options", F.col("answer")) & (F.size("options") == F.size(F.array_distinct("options"))))
        .when(F.col("type") == "OX", F.col("answer").isin("O", "X"))
        .when(F.col("type") == "SHORT_ANSWER", F.col("answer") == F.col("term"))
        .when(F.col("type") == "FILL_BLANK", F.contains("definition", F.col("answer")) & F.contains("question", F.lit(words.WORD_BLANK)))
        .otherwise(F.col("answer") == F.col("definition"))
    )
    return rows.groupBy("pool", "type").agg(F.count("*").alias("questions"), F.bool_and(fits).alias("fit"))


def _unit_points(spark, d):
    """Parts of one brand, kind and size class as a unit's points."""
    t = read_table(spark, d, "part")
    unit = F.concat_ws("/", "p_brand", F.substring_index("p_type", " ", 1), (F.col("p_size") % 10).cast("string"))
    text = F.concat("p_name", F.lit(": "), "p_type", F.lit(" of "), "p_brand")
    return t.select(
        unit.alias("unit_id"), F.col("p_partkey").alias("point_id"), text.alias("text"), text.alias("source_excerpt"), (1 + F.col("p_size") % 5).cast("int").alias("importance"),
        (F.col("p_partkey") % 100).cast("double").alias("level"), F.lit(0).alias("wrong_count"), (F.col("p_partkey") % 3 == 0).alias("studied"), F.lit(None).cast("string").alias("last_kind"),
    )


def test_assembly(spark, d):
    """Tests of units, planned, made and tried: places in the plan, points that the test asks for, and details left out."""
    _, tried, plan = assembly.unit_tests(_unit_points(spark, d))
    asked = tried.groupBy("unit_id").agg(F.count_distinct(F.when(F.col("result") != "rejected", F.col("target_id"))).alias("asked"))
    planned = plan.groupBy("unit_id").agg(F.sum("times").alias("places"), F.count_if(F.col("times") == 0).alias("skipped"))
    return planned.join(asked, "unit_id", "left")


def valid_questions(spark, d):
    """Questions made from parts, many of them malformed: those whose form is right, in the form of the stores."""
    t = read_table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    truth = F.element_at(F.array(*map(F.lit, ("true", " o ", "거짓", "maybe", "X", ""))), (F.col("p_size") % 6 + 1).cast("int"))
    answer = F.when(kind == "OX", truth).when(F.col("p_size") % 5 == 0, F.upper("p_brand")).otherwise(F.col("p_type"))
    options = F.array(F.col("p_brand"), F.upper("p_type"), F.concat(F.lit(" "), "p_brand", F.lit(".")), F.when(F.col("p_size") % 3 == 0, F.col("p_name")), F.lit(""))
    excerpt = F.when(F.col("p_size") % 7 == 0, F.lit("ab")).when(F.col("p_size") % 11 == 0, F.lit("not there")).otherwise(F.col("p_name"))
    rows = t.select("p_partkey", kind.alias("type"), F.concat(F.lit(" "), "p_name", F.lit(" [ ] and ___ ")).alias("question"), answer.alias("answer"), options.alias("options"), F.lit(" why ").alias("explanation"), excerpt.alias("source_excerpt"), F.concat("p_type", F.lit(" "), "p_name").alias("context"))
    return assembly.valid_questions(rows).select("p_partkey", "type", "question", "answer", F.array_join("options", "|").alias("options"), "explanation")


def structured_summary(spark, d):
    """Parts as points of structured pages: sections by page question, belief items last."""
    t = read_table(spark, d, "part")
    area = F.element_at(F.array(*map(F.lit, ("question", "core", "belief", "core"))), (F.col("p_size") % 4 + 1).cast("int"))
    p = t.select(F.col("p_brand").alias("unit_id"), F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 50).alias("ord"), F.when(F.col("p_size") % 9 > 0, area).alias("area"), F.when(F.col("p_size") % 5 > 0, F.substring_index("p_type", " ", 1)).alias("page_question"), F.col("p_name").alias("text"))
    s = study.structured_summary(p)
    return s.select("unit_id", "place", "kind", "title", F.size("items").alias("n"), F.md5(F.array_join(F.transform("items", lambda i: i["point_id"].cast("string")), ",")).alias("items_md5"))


def orphan_units(spark, d):
    """Points of importance 2 and up, by unit, that no returned line of more than 45 pieces asks for: what a test has to cover."""
    asked = read_table(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity > 45").select(F.col("l_partkey").alias("target_id"), F.lit("planned").alias("result"))
    targets = points(spark, d).select(F.col("point_id").alias("target_id"), "unit_id", "importance")
    missing = assembly.not_covered(targets, asked)
    return missing.groupBy("unit_id").agg(F.count("*").alias("not_covered"))


_PAIRS = ", ".join("regexp_split_to_array(line, '" + s.replace("\\s", "[\\s\\x0B]") + "')" for s in SEPARATORS)
_FINISHED_SQL = f"""{POINTS_SQL}, {QUESTIONS_SQL}, asked AS (SELECT *, session_id || ':' || ord || ':' || l_partkey || ':' || l_suppkey AS question_id FROM questions WHERE session_id % 4 <> 0)"""
_FOLD = """list_reduce(list_prepend({'level': p.level, 'c': 0, 'w': 0, 's': 0, 'ok': NULL::BOOLEAN}, list_transform(a.answers, lambda x: {'level': 0.0::DOUBLE, 'c': 0, 'w': 0, 's': 0, 'ok': x})), lambda s, x:
  {'level': floor(least(greatest(CASE WHEN x.ok THEN s.level + (100.0::DOUBLE - s.level) * (0.25::DOUBLE + 0.05::DOUBLE * least(s.s + 1, 4)) * 1.0::DOUBLE ELSE s.level * (1.0::DOUBLE - 0.4::DOUBLE * 1.0::DOUBLE) END, 0.0::DOUBLE), 100.0::DOUBLE) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE,
   'c': s.c + x.ok::INT, 'w': s.w + (NOT x.ok)::INT, 's': CASE WHEN x.ok THEN s.s + 1 ELSE 0 END, 'ok': x.ok})"""

#: A target that no good question was found for is asked by its last resort, so a test asks for all that its plan covers.
ASSEMBLY_SQL = f"""WITH t AS (
  SELECT p_brand || '/' || string_split(p_type, ' ')[1] || '/' || p_size % 10 AS unit_id, p_partkey AS target_id, greatest(1 + p_size % 5, 2) AS grp, 1 + p_size % 5 AS imp, (p_partkey % 100)::DOUBLE AS level, p_partkey % 3 = 0 AS studied FROM part
), {PLAN_STEPS} SELECT unit_id, CAST(sum(times) AS BIGINT) AS places, count(*) FILTER (times > 0) AS asked, count(*) FILTER (times = 0) AS skipped FROM planned GROUP BY unit_id"""

QUERIES = {
    "analyzed_points": (analyzed_points, None),
    "refreshed_points": (refreshed_points, None),
    "finished_sessions": (finished_sessions, f"""WITH {_FINISHED_SQL}, n AS (SELECT session_id, count(*) AS total, count(correct) AS answered, count(*) FILTER (correct) AS correct_count, count(*) FILTER (importance >= 4) AS core_total, count(*) FILTER (importance >= 4 AND correct) AS core_correct FROM asked GROUP BY 1),
  u AS (SELECT unit_id, CAST(floor(avg(level) + 0.5) AS BIGINT) AS pct FROM points GROUP BY 1),
  a AS (SELECT l_partkey AS point_id, list(correct ORDER BY session_id, ord, question_id) AS answers FROM asked WHERE correct IS NOT NULL GROUP BY 1),
  f AS (SELECT p.*, a.answers, CASE WHEN a.answers IS NOT NULL THEN {_FOLD} END AS s FROM points p LEFT JOIN a USING (point_id)),
  v AS (SELECT unit_id, CAST(floor(avg(CASE WHEN answers IS NULL THEN level ELSE s.level END) + 0.5) AS BIGINT) AS later FROM f GROUP BY 1)
SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 4 <> 0 THEN coalesce(total, 0) END AS total, CASE WHEN o_orderkey % 4 <> 0 THEN coalesce(answered, 0) END AS answered, CASE WHEN o_orderkey % 4 <> 0 THEN coalesce(correct_count, 0) END AS correct_count,
  CASE WHEN o_orderkey % 4 <> 0 THEN coalesce(CAST(floor(correct_count * 100.0::DOUBLE / total + 0.5) AS BIGINT), 0) END AS score_percent, CASE WHEN o_orderkey % 4 <> 0 THEN coalesce(core_total, 0) END AS core_total, CASE WHEN o_orderkey % 4 <> 0 THEN coalesce(core_correct, 0) END AS core_correct,
  CASE WHEN o_orderkey % 4 <> 0 THEN pct END AS pct_before, CASE WHEN o_orderkey % 4 <> 0 THEN later END AS pct_after, CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE {NOW} END AS finished_at
FROM orders LEFT JOIN n ON n.session_id = o_orderkey LEFT JOIN u ON u.unit_id = o_custkey % 25 LEFT JOIN v ON v.unit_id = o_custkey % 25"""),
    "finished_points": (finished_points, f"""WITH {_FINISHED_SQL}, a AS (SELECT l_partkey AS point_id, list(correct ORDER BY session_id, ord, question_id) AS answers, arg_max(importance, (session_id, ord, question_id)) AS last_importance FROM asked WHERE correct IS NOT NULL GROUP BY 1),
  f AS (SELECT p.*, a.answers, last_importance, CASE WHEN a.answers IS NOT NULL THEN {_FOLD} END AS s FROM points p LEFT JOIN a USING (point_id))
SELECT point_id, CASE WHEN answers IS NULL THEN level ELSE s.level END AS level, CAST(coalesce(s.c, 0) AS INT) AS correct, CAST(coalesce(s.w, 0) AS INT) AS wrong, CAST(coalesce(s.s, 0) AS INT) AS streak, s.ok AS last,
  CASE WHEN answers IS NOT NULL THEN {list(KINDS)}[last_importance % 6 + 1] END AS last_question_type, CASE WHEN answers IS NULL THEN last_studied_at ELSE {NOW} END AS last_studied_at FROM f"""),
    "finished_records": (finished_records, f"""WITH {_FINISHED_SQL} SELECT l_partkey AS target_id, count(*) FILTER (NOT correct) AS wrong_count, count(*) FILTER (correct) AS correct_count, arg_max(correct, (session_id, ord, question_id)) AS last_correct, arg_max(question_id, (session_id, ord, question_id)) AS last_question_id
FROM asked WHERE correct IS NOT NULL GROUP BY 1"""),
    "term_items": (term_items, rf"""WITH {LINES_SQL}, l AS (SELECT doc_id, line_no, trim(regexp_replace(line, '^[\s\x0B]*([-*•·]+|\d+[.)]|[①-⑳])[\s\x0B]*', ''), ' ') AS line FROM lines),
  c AS (SELECT *, list_filter(list_transform([{_PAIRS}], lambda p: {{'term': trim(p[1], ' '), 'definition': trim(array_to_string(p[2:], ' '), ' ')}}), lambda x: x.term <> '' AND x.definition <> '')[1] AS pair FROM l WHERE line <> ''),
  e AS (SELECT doc_id, line_no, coalesce(pair, CASE WHEN regexp_matches(line, '^([A-Za-z][A-Za-z''\- ]*?)[\s\x0B]+([가-힣(].*)$') THEN {{'term': trim(regexp_extract(line, '^([A-Za-z][A-Za-z''\- ]*?)[\s\x0B]+([가-힣(].*)$', 1), ' '), 'definition': trim(regexp_extract(line, '^([A-Za-z][A-Za-z''\- ]*?)[\s\x0B]+([가-힣(].*)$', 2), ' ')}} END) AS pair FROM c),
  k AS (SELECT doc_id, line_no, CASE WHEN length(pair.term) <= 40 THEN pair END AS pair FROM e)
SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(pair.term) AS term_md5, md5(pair.definition) AS definition_md5 FROM k WHERE pair IS NULL
UNION ALL SELECT doc_id, CAST(line_no AS INT), md5(pair.term), md5(pair.definition) FROM k WHERE pair IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, {key_sql('pair.term')} ORDER BY line_no) = 1"""),
    "word_questions": (word_questions, f"""WITH i AS (SELECT p_partkey AS item_id, p_brand AS pool, p_name, p_type, {key_sql('p_name')} AS tk, {key_sql('p_type')} AS dk, ('0x' || substr(md5('1:mc:' || p_partkey), 1, 1))::INT < 8 AS by_meaning FROM part),
  n AS (SELECT pool, count(DISTINCT tk) AS terms, count(DISTINCT dk) AS definitions FROM i GROUP BY 1),
  q AS (SELECT pool, 'MULTIPLE_CHOICE' AS type FROM i JOIN n USING (pool) WHERE CASE WHEN by_meaning THEN definitions ELSE terms END > 1 UNION ALL SELECT pool, unnest(['OX', 'SHORT_ANSWER', 'SUBJECTIVE']) FROM i UNION ALL SELECT pool, 'DESCRIPTIVE' FROM i WHERE length(p_type) >= 12 UNION ALL SELECT pool, 'FILL_BLANK' FROM i WHERE len(string_split(p_type, ' ')) >= 2)
SELECT pool, type, count(*) AS questions, TRUE AS fit FROM q GROUP BY ALL"""),
    "test_assembly": (test_assembly, ASSEMBLY_SQL),
    "valid_questions": (valid_questions, f"""WITH t AS (SELECT *, {list(KINDS)}[p_partkey % 6 + 1] AS type, ['true', ' o ', '거짓', 'maybe', 'X', ''][p_size % 6 + 1] AS truth, CASE WHEN p_size % 7 = 0 THEN 'ab' WHEN p_size % 11 = 0 THEN 'not there' ELSE p_name END AS excerpt FROM part),
  a AS (SELECT *, CASE WHEN type = 'OX' THEN truth WHEN p_size % 5 = 0 THEN upper(p_brand) ELSE p_type END AS answer0, list_filter([p_brand, upper(p_type), CASE WHEN p_size % 3 = 0 THEN p_name END], lambda o: o IS NOT NULL) AS opts FROM t),
  b AS (SELECT *, CASE type WHEN 'OX' THEN CASE WHEN upper(trim(truth, ' ')) IN ('O', 'TRUE') THEN 'O' WHEN upper(trim(truth, ' ')) IN ('X', '거짓') THEN 'X' END WHEN 'MULTIPLE_CHOICE' THEN list_filter(opts, lambda o: {key_sql('o')} = {key_sql('answer0')})[1] ELSE answer0 END AS answer FROM a
    WHERE trim(answer0, ' ') <> '' AND length({key_sql('excerpt')}) >= 3 AND contains({key_sql("p_type || ' ' || p_name")}, {key_sql('excerpt')}))
SELECT p_partkey, type, p_name || CASE WHEN type = 'FILL_BLANK' THEN ' [      ] and ___' ELSE ' [ ] and ___' END AS question, answer, CASE type WHEN 'OX' THEN 'O|X' WHEN 'MULTIPLE_CHOICE' THEN array_to_string(opts, '|') END AS options, 'why' AS explanation FROM b WHERE answer IS NOT NULL"""),
    "structured_summary": (structured_summary, """WITH p AS (SELECT p_brand AS unit_id, p_partkey AS point_id, p_partkey % 50 AS ord, ['question', 'core', 'belief', 'core'][p_size % 4 + 1] AS area, CASE WHEN p_size % 5 > 0 THEN split_part(p_type, ' ', 1) END AS pq FROM part WHERE p_size % 9 > 0),
  s AS (SELECT *, CASE WHEN area = 'belief' THEN 'belief' ELSE 'question' END AS kind, CASE WHEN area = 'belief' THEN '신념화 (마음가짐)' ELSE coalesce(pq, '핵심 내용') END AS title FROM p),
  g AS (SELECT unit_id, kind, title, count(*) AS n, md5(string_agg(point_id::VARCHAR, ',' ORDER BY (area <> 'question')::INT, ord, point_id)) AS items_md5, min((ord, point_id)) AS f FROM s GROUP BY 1, 2, 3)
SELECT unit_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY kind = 'belief', f, title) AS INT) AS place, kind, title, CAST(n AS INT) AS n, items_md5 FROM g"""),
    "orphan_units": (orphan_units, f"WITH {POINTS_SQL} SELECT unit_id, count(*) AS not_covered FROM graded WHERE imp >= 2 AND point_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45) GROUP BY 1"),
}
