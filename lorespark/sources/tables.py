"""Tables: reading, the stores' schemas, and keyed changes to them as new table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEARNT = "study_level double, correct_count int, wrong_count int, streak int, last_result boolean, last_studied_at bigint, last_question_type string"
PROPOSALS = "array<struct<page: int, from: string, to: string, reason: string>>"
#: The keyed stores. Times are epoch milliseconds.
STORES = {
    "subjects": "id string, name string, created_at bigint, updated_at bigint",
    "units": "id string, subject_id string, name string, order_index int, created_at bigint, updated_at bigint",
    "materials": f"id string, subject_id string, unit_id string, study_mode string, type string, material_type string, title string, raw_text string, final_text string, image_ids array<string>, is_verified boolean, ai_correction struct<status: string, message: string, applied: {PROPOSALS}, uncertain: {PROPOSALS}, rejected_count: int, at: bigint>, points_hash string, points_origin string, points_version int, created_at bigint, updated_at bigint",
    "material_images": "id string, material_id string, blob binary, processed_blob binary, raw_text string, text string, order_index int, created_at bigint",
    "summaries": "id string, unit_id string, sections array<struct<title: string, kind: string, items: array<struct<text: string, source_excerpt: string, importance: int, point_id: string, heading: string, area: string>>>>, origin string, content_hash string, created_at bigint, updated_at bigint",
    "questions": "id string, session_id string, ord int, subject_id string, unit_id string, material_id string, target_type string, target_id string, type string, difficulty string, importance int, question string, options array<string>, answer string, acceptable_answers array<string>, explanation string, source_excerpt string, grade_mode string, generator string, created_at bigint",
    "test_sessions": "id string, scope string, subject_id string, unit_id string, title string, mode string, parent_session_id string, total_questions int, answered_count int, correct_count int, wrong_count int, score_percent int, pct_before int, pct_after int, core_total int, core_correct int, generator_summary string, notes array<string>, started_at bigint, finished_at bigint",
    "test_answers": "id string, session_id string, question_id string, user_answer string, is_correct boolean, graded_by string, answered_at bigint",
    "wrong_answers": "id string, target_type string, target_id string, subject_id string, unit_id string, wrong_count int, correct_count int, last_attempt_correct boolean, last_question_id string, last_attempt_at bigint",
    "word_items": f"id string, subject_id string, material_id string, term string, definition string, source_excerpt string, importance int, {LEARNT}, created_at bigint, updated_at bigint",
    "points": f"id string, subject_id string, unit_id string, material_id string, text string, source_excerpt string, heading string, importance int, category string, question_target string, blank_text string, answer string, explanation string, area string, page_question string, question_linked boolean, order_index int, origin string, {LEARNT}, created_at bigint, updated_at bigint",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    for name in names:
        read_table(spark, folder, name).createOrReplaceTempView(name)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once: a checkpoint in the session's checkpoint folder; where none is set, kept in memory and
    on disk while there is room, and computed again where a part is lost."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table after the changes: a changed row replaces the one with its key. One change per key."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def remove(table: DataFrame, gone: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """What is left and what is removed, where ``gone`` lists the values of ``on``."""
    return table.join(gone, on, "left_anti"), table.join(gone, on, "left_semi")


def next_order(rows: DataFrame, parent: str, added: DataFrame, order: list[Column]) -> DataFrame:
    """New rows with an order_index that continues their parent's."""
    highest = rows.groupBy(parent).agg(F.max("order_index").alias("_highest"))
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return added.join(highest, parent, "left").withColumn("order_index", F.coalesce("_highest", F.lit(-1)) + place).drop("_highest")


def backfilled(materials: DataFrame, images: DataFrame) -> DataFrame:
    """Materials of the first version brought up to date from their images: texts, image ids, type and study mode."""
    parts = images.groupBy("material_id").agg(F.sort_array(F.collect_list(F.struct("order_index", "id", "raw_text"))).alias("parts"))
    texts = F.filter(F.transform("parts", lambda p: p["raw_text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    joined = materials.join(parts, materials.id == parts.material_id, "left").drop("material_id")
    whole = F.coalesce(F.array_join(texts, "\n\n"), F.lit(""))
    return joined.withColumns({
        "raw_text": F.coalesce("raw_text", whole),
        "final_text": F.coalesce("final_text", "raw_text", whole),
        "image_ids": F.coalesce("image_ids", F.transform("parts", lambda p: p["id"])),
        "material_type": F.coalesce("material_type", F.when(F.col("parts").isNotNull(), "PHOTO").otherwise("TEXT")),
        "study_mode": F.coalesce("study_mode", F.lit("content")),
    }).drop("parts")
