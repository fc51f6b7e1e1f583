"""Structured pages compared with a true transcript: field by field, and by character error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import half_up, normalize_text, text_of
from lorespark.operators.structure import parse_header, sectioned

# ---- Fixed values -------------------------------------------------------------------------------------------------
#: Beyond so many cells an edit distance is not computed; the difference in length stands for it.
MOST_CELLS = 40e6
PAGE_FIELDS = ("chapter(제목)", "lesson(소단원)", "question.number", "question.text", "question.starred", "question.tags", "pageLabel(쪽 번호)", "sections 수", "신념화 항목 수")
# -------------------------------------------------------------------------------------------------------------------

KEYS = ["doc_id", "page"]


def error_rate(truth: Column, read: Column) -> Column:
    """The edits from the true text to the one read, white space aside, for each of its characters."""
    a, b = (F.regexp_replace(text_of(c), r"\s+", "") for c in (truth, read))
    n, m = F.length(a), F.length(b)
    near = F.when(n.cast("double") * m < MOST_CELLS, F.levenshtein(a, b)).otherwise(F.abs(n - m)) / n
    return F.when(n == 0, F.when(m > 0, 1.0).otherwise(0.0)).otherwise(near)


def page_texts(nodes: DataFrame) -> DataFrame:
    """``doc_id, page, text``: each page as plain text: title, question, sections and their lines, belief items."""
    part = F.when(F.col("kind") == "title", 0).when(F.col("kind") == "question", 1).when(F.col("kind") == "belief", 3).otherwise(2)
    rows = nodes.where("kind not in ('label', 'table') and text <> ''").withColumn("part", part)
    lines = F.sort_array(F.collect_list(F.struct("part", "node_no", "text")))
    return rows.groupBy(*KEYS).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def page_facts(nodes: DataFrame) -> DataFrame:
    """``doc_id, page, field, value``: what there is to be right about a page, one row each.

    Chapter, lesson, question (number, text, star, tags), page label, the numbers of sections and belief items; of each
    section its title, its lines and their number, its subsections and their number; each belief item. Places count from 1.
    """
    rows = sectioned(nodes)
    kind, text = F.col("kind"), F.col("text")
    page, section = Window.partitionBy(*KEYS), Window.partitionBy(*KEYS, "section_no")
    of = lambda name, value: F.max_by(F.when(kind == name, value), F.when(kind == name, -F.col("node_no"))).over(page)
    counted = lambda condition, window: F.count_if(condition).over(window).cast("string")
    heads = (
        of("title", parse_header(text)["chapter"]), of("title", parse_header(text)["lesson"]), of("question", F.col("number")), of("question", text),
        F.coalesce(F.max(F.when(kind == "question", F.col("starred"))).over(page), F.lit(False)).cast("string"), of("question", F.array_join("tags", ",")),
        F.max_by(F.when(kind == "label", text), F.when(kind == "label", F.col("node_no"))).over(page), F.coalesce(F.max("section_no").over(page), F.lit(0)).cast("string"), counted(kind == "belief", page),
    )
    named = {f"f{k}": value for k, value in enumerate(heads)}
    named |= {"title": F.max(F.when(kind == "section", text)).over(section), "lines": counted((kind == "content") & (F.col("sub_no") == 0), section), "subs": counted(kind == "subsection", section)}
    place = lambda *keys: F.row_number().over(Window.partitionBy(*KEYS, *keys).orderBy("node_no"))
    named |= {"at_page": place(), "at_section": place("section_no"), "at_kind": place("section_no", "sub_no", "kind").cast("string")}
    rows = rows.withColumns(named)
    # What a page or a section has as a whole stands with its first node.
    fact = lambda field, value: F.struct(field.alias("field"), value.alias("value"))
    none = F.array().cast("array<struct<field:string,value:string>>")
    k = F.col("section_no").cast("string")
    under = F.when(F.col("sub_no") == 0, F.concat(k, F.lit("."))).otherwise(F.concat(k, F.lit("-"), F.col("sub_no").cast("string")))
    whole = F.when(F.col("at_page") == 1, F.array(*(fact(F.lit(name), F.col(f"f{n}")) for n, name in enumerate(PAGE_FIELDS)))).otherwise(none)
    sections = F.when((F.col("at_section") == 1) & k.isNotNull(), F.array(fact(F.concat(k, F.lit(". 대제목")), F.col("title")), fact(F.concat(k, F.lit(". 본문 줄 수")), F.col("lines")), fact(F.concat(k, F.lit(". 소제목 수")), F.col("subs")))).otherwise(none)
    own = (
        F.when(kind == "content", F.array(fact(F.concat(under, F.lit(" 본문 "), "at_kind"), text)))
        .when(kind == "subsection", F.array(fact(F.concat(under, F.lit(" 소제목")), text)))
        .when(kind == "belief", F.array(fact(F.concat(F.lit("신념화 "), "at_kind"), text)))
        .otherwise(none)
    )
    return rows.select(*KEYS, F.explode(F.concat(whole, sections, own)).alias("x")).select(*KEYS, "x.*")


def compared_structure(nodes: DataFrame, truth: DataFrame) -> DataFrame:
    """``doc_id, page, field, got, want, ok``: every field of the true pages, against the page at the same place.

    Texts are compared by their keys. What a page lacks is nothing; a number it lacks is 0, a star false.
    """
    got, want = page_facts(nodes).withColumnRenamed("value", "got"), page_facts(truth).withColumnRenamed("value", "want")
    rows = want.join(got, [*KEYS, "field"], "left")
    lacking = F.when(F.col("field").endswith(" 수"), "0").when(F.col("field") == "question.starred", "false")
    rows = rows.withColumn("got", F.coalesce("got", lacking))
    return rows.select(*KEYS, "field", "got", "want", (normalize_text(F.col("got")) == normalize_text(F.col("want"))).alias("ok"))


def marks_left(text: Column, watermark: Column) -> Column:
    """The pieces (of two characters or more) of a watermark that a text still has."""
    return F.filter(F.split(text_of(watermark), r"[/\s]+"), lambda p: (F.length(p) >= 2) & F.contains(text_of(text), p))


def page_reports(nodes: DataFrame, truth: DataFrame, raw: DataFrame, watermarks: DataFrame) -> DataFrame:
    """``doc_id, page, exact, total, pct, cer_raw, cer_final, watermark_left, watermark_in_raw`` of each true page.

    raw: doc_id, page, text as recognised; watermarks: doc_id, watermark. A page that was not recognised has no figures
    of its own text; a page of the truth without a counterpart in ``nodes`` counts as an empty one.
    """
    fields = compared_structure(nodes, truth).groupBy(*KEYS).agg(F.count_if("ok").alias("exact"), F.count("*").alias("total"))
    rows = fields.join(page_texts(truth).withColumnRenamed("text", "want"), KEYS, "left").join(page_texts(nodes).withColumnRenamed("text", "got"), KEYS, "left")
    rows = rows.join(raw.select(*KEYS, F.col("text").alias("raw")), KEYS, "left").join(watermarks, "doc_id", "left")
    return rows.select(
        *KEYS, "exact", "total", (half_up(F.col("exact") / F.col("total") * 1000) / 10).alias("pct"), error_rate(F.col("want"), F.col("raw")).alias("cer_raw"), error_rate(F.col("want"), F.col("got")).alias("cer_final"),
        marks_left(F.col("got"), F.col("watermark")).alias("watermark_left"), marks_left(F.col("raw"), F.col("watermark")).alias("watermark_in_raw"),
    )


def report_summary(reports: DataFrame) -> DataFrame:
    """``doc_id, pages, structure_pct, cer_raw, cer_final, marked_pages`` of page reports; rates in per cent."""
    tenth = lambda c: half_up(c * 1000) / 10
    return reports.groupBy("doc_id").agg(
        F.count("*").alias("pages"), tenth(F.sum("exact") / F.sum("total")).alias("structure_pct"), tenth(F.avg("cer_raw")).alias("cer_raw"), tenth(F.avg("cer_final")).alias("cer_final"),
        F.count_if(F.size("watermark_left") > 0).alias("marked_pages"),
    )
