"""Key points made from materials and kept up to date, sessions brought to an end, summaries by page question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.korean import choose_blank, keyword_candidates, split_topic
from lorespark.functions.similarity import pieces_of_key
from lorespark.functions.text import category_of, hash_string, importance_of, is_meaningful, let, normalize_text, strip_emphasis, text_of
from lorespark.operators.sentences import sentences_with_headings
from lorespark.operators.points import matched_points
from lorespark.operators.progress import apply_result, session_scores, unit_progress
from lorespark.sources.tables import latest, settled

# ---- Fixed values -------------------------------------------------------------------------------------------------
CORE_CONTENT, BELIEF = "핵심 내용", "신념화 (마음가짐)"
SOURCE, KEYWORD, KEYWORD_END = "자료: “{}”", " → 핵심어는 ‘{}’", "입니다."
ANALYSIS_VERSION = 4
#: Materials of so many sentences are compared sentence by sentence.
FEW_SENTENCES = 64
# -------------------------------------------------------------------------------------------------------------------
#: What a point has learnt, with the value of a new one.
LEARNING = {"study_level": "double", "correct_count": "int", "wrong_count": "int", "streak": "int", "last_result": "boolean", "last_studied_at": "bigint", "last_question_type": "string"}
FRESH = {"study_level": 0.0, "correct_count": 0, "wrong_count": 0, "streak": 0}
ANALYSIS = ("text", "source_excerpt", "heading", "importance", "category", "question_target", "blank_text", "answer", "explanation")


def _repeats(sentences: DataFrame, keys: list[str], few: int = FEW_SENTENCES) -> DataFrame:
    """keys, n, repeats: in how many other sentences of its material a sentence's keyword occurs, where it does in any.

    Sentences of a material that has up to ``few`` are compared in one row. In larger ones, sentences and distinct
    keywords meet on the digest of the keyword's first one, two, four or eight characters; texts follow for pairs
    that have met.
    """
    rows = sentences.select(*keys, "n", "sentence", "keyword").withColumn("_size", F.count("*").over(Window.partitionBy(*keys))).where("_size > 1")
    small = rows.where(F.col("_size") <= few).groupBy(*keys).agg(F.collect_list(F.struct("n", "sentence", "keyword")).alias("_all"))
    others = lambda s: F.size(F.filter("_all", lambda o: (o["n"] != s["n"]) & F.contains(o["sentence"], s["keyword"])))
    counted = F.transform(F.filter("_all", lambda s: s["keyword"] != ""), lambda s: F.struct(s["n"].alias("n"), others(s).alias("repeats")))
    small = small.select(*keys, F.explode(counted).alias("_c")).select(*keys, "_c.n", "_c.repeats")

    large = rows.where(F.col("_size") > few)
    digests = F.transform(F.flatten(F.array(*(pieces_of_key(F.col("sentence"), n) for n in (1, 2, 4, 8)))), lambda p: F.xxhash64(p))
    pieces = large.select(*keys, F.col("n").alias("_m"), F.explode(F.array_distinct(digests)).alias("_piece"))
    size = F.length("keyword")
    prefix = F.when(size >= 8, 8).when(size >= 4, 4).when(size >= 2, 2).otherwise(1)
    asked = large.where("keyword <> ''").select(*keys, "keyword").distinct().withColumn("_piece", F.xxhash64(F.substring(F.col("keyword"), F.lit(1), prefix)))
    met = asked.join(pieces, [*keys, "_piece"]).select(*keys, "keyword", "_m")
    met = met.join(large.select(*keys, F.col("n").alias("_m"), F.col("sentence").alias("_other")), [*keys, "_m"]).where(F.contains("_other", F.col("keyword")))
    totals = met.groupBy(*keys, "keyword").agg(F.count("*").cast("int").alias("_total"))
    # A keyword is a part of its own sentence.
    large = large.select(*keys, "n", "keyword").join(totals, [*keys, "keyword"]).select(*keys, "n", (F.col("_total") - 1).alias("repeats"))
    return small.unionByName(large).where("repeats > 0")


def enriched(text: Column, excerpt: Column) -> Column:
    """``struct<category, question_target, blank_text, answer, explanation>`` of a point's text."""

    def parts(blank: Column) -> Column:
        source = F.concat(*(F.lit(p) if p else excerpt for p in _around(SOURCE)))
        keyword = F.concat(F.lit(_around(KEYWORD)[0]), blank["answer"], F.lit(_around(KEYWORD)[2] + KEYWORD_END))
        return F.struct(
            category_of(text).alias("category"),
            F.coalesce(blank["answer"], split_topic(text)["subject"]).alias("question_target"),
            blank["blank_text"].alias("blank_text"),
            blank["answer"].alias("answer"),
            F.concat(source, F.coalesce(keyword, F.lit(""))).alias("explanation"),
        )

    return let(choose_blank(text), parts)


def _around(template: str) -> tuple[str, None, str]:
    before, after = template.split("{}")
    return before, None, after


def analyzed_points(materials: DataFrame, id_column: str = "material_id", text: str = "text") -> DataFrame:
    """``material_id, order_index`` and a point's analysis: what a material's sentences say, each sentence once.

    Importance is judged by the sentence with its emphasis marks, its heading, its place under it, and how many other
    sentences have its keyword; the point's text leaves the marks out.
    """
    keys = [id_column]
    rows = sentences_with_headings(materials, id_column, text).where(is_meaningful(F.col("sentence")))
    # By sentences, as materials differ in length.
    rows = latest(rows.repartition(id_column, "n").withColumn("_key", normalize_text(F.col("sentence"))), [id_column, "_key"], [F.col("n")]).drop("_key")
    first = F.get(F.filter(keyword_candidates(F.col("sentence")), lambda k: ~k["generic"]), F.lit(0))["stem"]
    # Kept, as the sentences are read again for their repeats: in one plan, all that makes them would stand in it four times.
    rows = settled(rows.withColumn("keyword", F.coalesce(first, F.lit(""))))
    rows = rows.join(_repeats(rows, keys), [*keys, "n"], "left")
    order = Window.partitionBy(*keys).orderBy("n")
    headed = F.col("heading") != ""
    newly = headed & ~F.col("heading").eqNullSafe(F.lag("heading").over(order))
    named = headed & F.exists(F.transform(keyword_candidates(F.col("heading")), lambda k: k["stem"]), lambda k: F.contains("sentence", k))
    rows = rows.withColumn("importance", importance_of(F.col("sentence"), named, newly, F.coalesce("repeats", F.lit(0)))).withColumn("order_index", F.row_number().over(order) - 1)
    rows = rows.select(*keys, "order_index", strip_emphasis(F.col("sentence")).alias("text"), F.col("sentence").alias("source_excerpt"), F.nullif("heading", F.lit("")).alias("heading"), "importance")
    return rows.withColumn("_e", enriched(F.col("text"), F.col("source_excerpt"))).select(*keys, "order_index", "text", "source_excerpt", "heading", "importance", "_e.*")


def refreshed_points(materials: DataFrame, points: DataFrame, structured: DataFrame | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables of points and materials after a refresh.

    Points of materials that are gone go. A material whose text has another hash than its points were made from, or
    whose points are of an older analysis, is analysed anew (``structured``: points of structured pages, with the columns
    of :func:`analyzed_points`, come before sentences). New points take over id and learning of old ones with the same
    text, else with nearly the same; what is left of the old ones goes. Points of other materials stay as they are.

    materials: material_id, unit_id, text, points_hash, points_origin, points_version; points: id, material_id, unit_id,
    order_index, the analysis and what was learnt.
    """
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    hashed = materials.withColumn("_hash", hash_string(F.col("text")))
    special = hashed.select("material_id").limit(0) if structured is None else structured.select("material_id").distinct()
    hashed = hashed.join(special.withColumn("_special", F.lit(True)), "material_id", "left")
    local = ~F.coalesce("points_origin", F.lit("")).isin("ai", "structure") & ~F.coalesce("points_version", F.lit(0)).eqNullSafe(F.lit(ANALYSIS_VERSION))
    stale = ~F.col("points_hash").eqNullSafe(F.col("_hash")) | local | (F.coalesce("_special", F.lit(False)) & ~F.col("points_origin").eqNullSafe(F.lit("structure")))
    hashed = hashed.withColumn("_stale", stale)
    todo = hashed.where("_stale").select("material_id", "unit_id", "text", "_special")

    made = analyzed_points(todo.where("_special is null").select("material_id", "text")).withColumn("origin", F.lit("local"))
    if structured is not None:
        made = made.unionByName(structured.join(todo.select("material_id"), "material_id", "left_semi").select(*made.drop("origin").columns).withColumn("origin", F.lit("structure")))
    made = settled(made.join(todo.select("material_id", "unit_id"), "material_id").withColumn("_new", F.md5(F.concat_ws(":", "material_id", "order_index", "text"))))

    living = points.join(hashed.select("material_id", "_stale"), "material_id")
    old = living.where("_stale")
    pairs = matched_points(old.select("material_id", "id", F.col("order_index").alias("ord"), "text"), made.select("material_id", F.col("_new").alias("id"), F.col("order_index").alias("ord"), "text"))
    pairs = settled(pairs)
    kept = old.select(F.col("id").alias("old_id"), *LEARNING, "created_at")
    joined = made.join(pairs.select(F.col("new_id").alias("_new"), "old_id"), "_new", "left").join(kept, "old_id", "left")
    is_new = F.col("old_id").isNull()
    learnt = [F.when(is_new, F.lit(FRESH.get(c))).otherwise(F.col(c)).cast(kind).alias(c) for c, kind in LEARNING.items()]
    fresh = joined.select(F.coalesce("old_id", "_new").alias("id"), "unit_id", "material_id", "order_index", *ANALYSIS, "origin", *learnt, F.when(is_new, now).otherwise(F.col("created_at")).alias("created_at"), now.alias("updated_at"))
    untouched = living.where("not _stale").select(*fresh.columns)
    origin = F.when(F.coalesce("_special", F.lit(False)), "structure").otherwise("local")
    marks = {"points_hash": F.col("_hash"), "points_origin": origin, "points_version": F.lit(ANALYSIS_VERSION)}
    after = hashed.withColumns({c: F.when(F.col("_stale"), v).otherwise(F.col(c)) for c, v in marks.items()}).select(*materials.columns)
    return untouched.unionByName(fresh), after


def finished_sessions(sessions: DataFrame, questions: DataFrame, points: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, points and wrong-answer records after every open session has been finished; finished ones change nothing.

    sessions: session_id, unit_id, finished_at; questions: session_id, ord, question_id, target_id, type, importance,
    correct (null: not answered); points: point_id, unit_id, importance, level, correct, wrong, streak, last,
    last_studied_at, last_question_type. A target's answers are folded in the order of session and question, from the
    level that it has. Records: target_id, wrong_count, correct_count, last_correct, last_question_id of these sessions.
    """
    open_ = sessions.where("finished_at is null")
    asked = questions.join(open_.select("session_id"), "session_id", "left_semi")
    given = asked.where("correct is not null and target_id is not null")
    order = F.struct("session_id", "ord", "question_id")
    lists = given.groupBy(F.col("target_id").alias("point_id")).agg(
        F.sort_array(F.collect_list(F.struct(order.alias("at"), F.col("correct").alias("ok")))).alias("answers"), F.max_by("type", order).alias("_type"),
    )
    start = F.struct(F.coalesce("level", F.lit(0.0)).alias("level"), F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("wrong", F.lit(0)).alias("wrong"), F.coalesce("streak", F.lit(0)).alias("streak"), F.col("last").alias("last"))
    state = F.aggregate("answers", start, lambda s, a: apply_result(s, a["ok"], F.lit(1.0)))
    joined = points.join(lists, "point_id", "left").withColumn("_s", F.when(F.col("answers").isNotNull(), state))
    changed = {c: F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)) for c in ("level", "correct", "wrong", "streak", "last")}
    changed |= {"last_studied_at": F.when(F.col("_s").isNotNull(), now).otherwise(F.col("last_studied_at")), "last_question_type": F.when(F.col("_s").isNotNull(), F.col("_type")).otherwise(F.col("last_question_type"))}
    after = joined.withColumns(changed).select(*points.columns)

    scores = session_scores(asked)
    before_pct = unit_progress(points).select("unit_id", F.col("pct").alias("pct_before"))
    after_pct = unit_progress(after).select("unit_id", F.col("pct").alias("pct_after"))
    done = open_.select("session_id", "unit_id").join(scores, "session_id", "left").join(before_pct, "unit_id", "left").join(after_pct, "unit_id", "left")
    counts = [c for c in scores.columns if c != "session_id"]
    done = done.select("session_id", "unit_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), "pct_before", "pct_after", now.alias("finished_at"))
    closed = sessions.where("finished_at is not null")
    closed = closed.select(*(F.col(c) if c in sessions.columns else F.lit(None).cast(dict(done.dtypes)[c]).alias(c) for c in done.columns))
    records = given.groupBy("target_id").agg(F.count_if(~F.col("correct")).alias("wrong_count"), F.count_if("correct").alias("correct_count"), F.max_by("correct", order).alias("last_correct"), F.max_by("question_id", order).alias("last_question_id"))
    return closed.unionByName(done), after, records


def structured_summary(points: DataFrame, unit: str = "unit_id") -> DataFrame:
    """``unit, place, kind, title, items``: sections of points that have an area, in the order of their page questions.

    The points of a page question stand together, the question's own first; belief items come last. Points without an
    area are left to the summary by categories. points: unit, point_id, ord, area, page_question, text.
    """
    rows = points.where("area is not null")
    belief = F.col("area") == "belief"
    title = F.when(belief, BELIEF).otherwise(F.coalesce(F.nullif("page_question", F.lit("")), F.lit(CORE_CONTENT)))
    own = F.when((F.col("area") == "question") & ~belief, 0).otherwise(1)
    item = F.struct(own.alias("own"), F.coalesce("ord", F.lit(0)).alias("ord"), "point_id", text_of(F.col("text")).alias("text"))
    grouped = rows.groupBy(unit, F.when(belief, "belief").otherwise("question").alias("kind"), title.alias("title")).agg(F.sort_array(F.collect_list(item)).alias("items"), F.min(F.struct("ord", "point_id")).alias("_first"))
    place = F.row_number().over(Window.partitionBy(unit).orderBy(F.col("kind") == "belief", "_first", "title"))
    return grouped.select(unit, place.alias("place"), "kind", "title", F.transform("items", lambda i: F.struct(i["point_id"].alias("point_id"), i["text"].alias("text"))).alias("items"))
