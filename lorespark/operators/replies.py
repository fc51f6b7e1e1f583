"""Points and word items as an outside service proposes them: what is grounded in the material, in the form of the stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.korean import choose_blank, is_good_blank_answer
from lorespark.functions.similarity import containment, is_grounded, similarity, term_supported
from lorespark.functions.text import BLANK, category_of, half_up, normalize_text, text_of
from lorespark.operators.assembly import ANY_BLANK

# ---- Fixed values -------------------------------------------------------------------------------------------------
TEXT_FROM, EXPLANATION_FROM, DEFINITION_FROM, BLANK_FROM = 0.5, 0.4, 0.6, 0.6
LEAST_EXCERPT = 3
SOURCE = ("자료: “", "”")
# -------------------------------------------------------------------------------------------------------------------


def is_excerpt(excerpt: Column, material: Column) -> Column:
    """Whether an excerpt of three letters or more is in the material, by keys."""
    key = normalize_text(excerpt)
    return (F.length(key) >= LEAST_EXCERPT) & F.contains(normalize_text(material), key)


def _importance() -> Column:
    """The column ``importance`` as a whole number of 1 to 5; 3 for none, 0 or no number."""
    given = F.nullif(F.nanvl(F.col("importance").cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(half_up(F.coalesce(given, F.lit(3.0))), F.lit(1)), F.lit(5)).cast("int")


def _first_of_key(rows: DataFrame, key: Column) -> DataFrame:
    rows = rows.withColumn("_key", key)
    first = F.row_number().over(Window.partitionBy("material_id", "_key").orderBy("ord"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "_key")


def valid_points(replies: DataFrame) -> DataFrame:
    """``material_id, ord, text, source_excerpt, importance, category, question_target, blank_text, answer, explanation``.

    replies: material_id, ord, text, source_excerpt, importance, category, answer, blank_text, explanation,
    question_target, material (the text that was sent). A point stays if its excerpt is in the material and its text grounded in
    either. A blank stays if its answer is a good one, is in excerpt or text, and fills it to nearly the text; else the
    best keyword's takes its place. An explanation that is not grounded gives way to the source. Of points with one key
    the first stays.
    """
    clean = lambda name: F.trim(text_of(F.col(name)))
    rows = replies.select("material_id", "ord", clean("text").alias("text"), clean("source_excerpt").alias("source_excerpt"), F.col("importance").cast("double").alias("importance"), clean("category").alias("category"), clean("answer").alias("answer"), F.trim(F.regexp_replace(text_of(F.col("blank_text")), f"(?s)^(.*?)(?:{ANY_BLANK})(.*)$", rf"$1{BLANK}$2".replace("[", r"\[").replace("]", r"\]"))).alias("blank_text"), clean("explanation").alias("explanation"), clean("question_target").alias("question_target"), text_of(F.col("material")).alias("material"))
    text, excerpt, material, answer = F.col("text"), F.col("source_excerpt"), F.col("material"), F.col("answer")
    rows = rows.where((text != "") & is_excerpt(excerpt, material) & is_grounded(text, excerpt, material, TEXT_FROM))
    rows = _first_of_key(rows, normalize_text(text))
    holds = (answer != "") & F.contains("blank_text", F.lit(BLANK)) & is_good_blank_answer(answer, text) & F.contains(normalize_text(F.concat(excerpt, text)), normalize_text(answer))
    holds = holds & (similarity(F.replace(F.col("blank_text"), F.lit(BLANK), answer), text) >= BLANK_FROM)
    rows = rows.withColumn("blank", F.when(holds, F.struct(answer.alias("answer"), F.col("blank_text"))).otherwise(choose_blank(text)))
    said = F.col("explanation")
    known = F.when((said != "") & is_grounded(said, excerpt, material, EXPLANATION_FROM), said).otherwise(F.concat(F.lit(SOURCE[0]), excerpt, F.lit(SOURCE[1])))
    target = F.nullif(F.coalesce(F.nullif("question_target", F.lit("")), F.trim("blank.answer")), F.lit(""))
    return rows.select(
        "material_id", "ord", "text", "source_excerpt", _importance().alias("importance"), F.coalesce(F.nullif("category", F.lit("")), category_of(text)).alias("category"), target.alias("question_target"),
        F.col("blank.blank_text").alias("blank_text"), F.col("blank.answer").alias("answer"), known.alias("explanation"),
    )


def valid_word_items(replies: DataFrame) -> DataFrame:
    """``material_id, ord, term, definition, source_excerpt, importance`` of the items whose term and meaning the material supports.

    replies: material_id, ord, term, definition, source_excerpt, importance, material. The excerpt is in the material, has the term but
    for misread letters, and most of the definition. Of items with one term the first stays.
    """
    clean = lambda name: F.trim(text_of(F.col(name))).alias(name)
    rows = replies.select("material_id", "ord", clean("term"), clean("definition"), clean("source_excerpt"), "material", _importance().alias("importance"))
    term, definition, excerpt = F.col("term"), F.col("definition"), F.col("source_excerpt")
    supported = is_excerpt(excerpt, F.col("material")) & term_supported(term, excerpt) & (containment(definition, excerpt) >= DEFINITION_FROM)
    return _first_of_key(rows.where((term != "") & (definition != "") & supported), normalize_text(term)).drop("material")
