"""A second reading's page merged into the first, its lines without a counterpart put in later, and pages as nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.similarity import containment
from lorespark.functions.text import normalize_text
from lorespark.operators.alignment import COVERED_FROM, aligned, judge_change
from lorespark.operators.structure import sectioned
from lorespark.sources.tables import settled

# ---- Fixed values -------------------------------------------------------------------------------------------------
PART_OF_LINE, ONLY_SECOND = "OCR 줄의 일부", "OCR에서 읽히지 않은 줄 (AI만 읽음)"
# -------------------------------------------------------------------------------------------------------------------

KEYS = ["doc_id", "page"]
NODE = ("kind", "text", "number", "tags", "starred")


def merged_pages(local: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merged nodes, a log of the second reading's changes, and the lines that only it has.

    local, other: node tables of two readings of the same pages. Of a pair of like lines the second's kind holds (a
    title's only for a title) and its text where it is a correction, judged as such; lines that only the first has stay.
    Titles that only the second has are taken where some line of the first has their words; its other lines are
    unverified: they wait behind the text that they followed. Table rows and page labels of the first stay, behind the rest.

    Log: ``doc_id, page, pos, verdict, from, to``, verdict one of same, apply, confirm, reject, restored, covered, unverified.
    Unverified: ``doc_id, page, pos, kind, text, after, reason``.
    """
    lines = lambda t: t.where("kind not in ('table', 'label')")
    named = lambda t, side: lines(t).select(*KEYS, F.col("node_no").cast("long").alias(f"{side}_no"), F.struct(*NODE).alias(side))
    numbered = lambda t: lines(t).select(*KEYS, F.col("node_no").alias("line_no"), F.col("text").alias("line"))
    pairs = settled(aligned(numbered(local), numbered(other), KEYS))
    rows = pairs.join(named(local, "left"), [*KEYS, "left_no"], "left").join(named(other, "right"), [*KEYS, "right_no"], "left")
    alone = rows.where("left_no is null").select(*KEYS, "right_no", "right.text")
    inside = alone.join(named(local, "left").select(*KEYS, F.col("left.text").alias("own")), KEYS).where(containment(F.col("text"), F.col("own")) >= COVERED_FROM)
    rows = rows.join(inside.select(*KEYS, "right_no").distinct().withColumn("inside", F.lit(True)), [*KEYS, "right_no"], "left")
    left, right = F.col("left"), F.col("right")
    same = normalize_text(left["text"]) == normalize_text(right["text"])
    title = F.col("right.kind").isin("section", "subsection")
    verdict = (
        F.when(right.isNull(), "restored")
        .when(left.isNull(), F.when(F.col("inside") & title, "covered").otherwise("unverified"))
        .when(same, "same")
        .otherwise(judge_change(left["text"], right["text"], F.lit("high")))
    )
    rows = rows.withColumn("verdict", verdict)
    text = (
        F.when(F.col("verdict").isin("apply", "covered"), right["text"])
        .when(F.col("verdict") == "same", F.when(F.length(right["text"]) >= F.length(left["text"]) - 2, right["text"]).otherwise(left["text"]))
        .otherwise(left["text"])
    )
    kind = F.when(left.isNull(), right["kind"]).when(right.isNull() | ((right["kind"] == "title") & (left["kind"] != "title")), left["kind"]).otherwise(right["kind"])
    meta = lambda name: F.when(right["kind"].isin("section", "question"), right[name]).otherwise(left[name])
    rows = settled(rows.select(*KEYS, "pos", "verdict", F.col("left.text").alias("from"), F.col("right.text").alias("to"), kind.alias("kind"), text.alias("text"), meta("number").alias("number"), meta("tags").alias("tags"), meta("starred").alias("starred"), "inside"))
    before = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(~F.col("verdict").isin("covered", "unverified"), F.col("text")), ignorenulls=True).over(before)
    waiting = rows.withColumn("after", after).where("verdict = 'unverified'")
    waiting = waiting.select(*KEYS, "pos", "kind", F.col("to").alias("text"), "after", F.when(F.col("inside"), PART_OF_LINE).otherwise(ONLY_SECOND).alias("reason"))
    kept = rows.where("verdict <> 'unverified'").select(*KEYS, F.lit(0).alias("place"), "pos", *NODE)
    rest = local.where("kind in ('table', 'label')").select(*KEYS, F.lit(1).alias("place"), F.col("node_no").alias("pos"), *NODE)
    return _renumbered(kept.unionByName(rest), ["place", "pos"]), rows.select(*KEYS, "pos", "verdict", "from", "to"), waiting


def _renumbered(rows: DataFrame, order: list) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))
    return rows.select(*KEYS, number.alias("node_no"), *NODE, F.lit(1).cast("long").alias("run"))


def with_unverified(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """The nodes with confirmed lines put in: each behind the first node with the text that it followed.

    items: doc_id, page, seq, kind, text, after. Without ``after`` a line goes to the page's front, with one that is not
    there to its end; of lines put in at one place the later ones stand first, as each is put right behind its text. A
    title is put in as a line. Pages without items stay; items of pages that are not there are left out.
    """
    first = nodes.groupBy(*KEYS, F.col("text").alias("after")).agg(F.min("node_no").alias("anchor"))
    there = nodes.select(*KEYS).distinct()
    put = items.join(there, KEYS, "left_semi").join(first, [*KEYS, "after"], "left")
    anchor = F.when(F.col("after").isNull() | (F.col("after") == "") , 0).otherwise(F.coalesce("anchor", F.lit((1 << 31) - 1)))
    behind = F.when(anchor == (1 << 31) - 1, F.col("seq")).otherwise(-F.col("seq"))
    null = lambda name: F.lit(None).cast(dict(nodes.dtypes)[name]).alias(name)
    put = put.select(*KEYS, anchor.cast("long").alias("anchor"), F.lit(1).alias("later"), behind.cast("long").alias("turn"), F.when(F.col("kind") == "title", "content").otherwise(F.col("kind")).alias("kind"), "text", null("number"), null("tags"), null("starred"))
    own = nodes.select(*KEYS, F.col("node_no").cast("long").alias("anchor"), F.lit(0).alias("later"), F.lit(0).cast("long").alias("turn"), *NODE)
    return _renumbered(own.unionByName(put), ["anchor", "later", "turn"])


def nested_pages(nodes: DataFrame) -> DataFrame:
    """``doc_id, page, title, question, sections, beliefs, tables, page_label``: each page as one row.

    question: struct<number, text, tags, starred>; sections: array<struct<number, title, content, subsections:
    array<struct<title, content>>>>, the title of lines without a section is ``""``. A page is what one row holds.
    """
    rows = settled(sectioned(nodes))
    kind = F.col("kind")
    listed = lambda condition, value: F.transform(F.sort_array(F.collect_list(F.when(condition, F.struct("node_no", value.alias("v"))))), lambda x: x["v"])
    core = rows.where("section_no is not null")
    subs = core.groupBy(*KEYS, "section_no", "sub_no").agg(
        F.max(F.when(kind == "subsection", F.col("text"))).alias("title"), listed(kind == "content", F.col("text")).alias("content"), F.max(F.when(kind == "section", F.struct("number", "text"))).alias("head")
    )
    below = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("sub_no", "title", "content"))), lambda x: F.when(x["sub_no"] > 0, F.struct(x["title"].alias("title"), x["content"].alias("content")))), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    own = F.coalesce(F.max(F.when(F.col("sub_no") == 0, F.col("content"))), empty)
    sections = subs.groupBy(*KEYS, "section_no").agg(F.max("head.number").alias("number"), F.coalesce(F.max("head.text"), F.lit("")).alias("title"), own.alias("content"), below.alias("subsections"))
    sections = sections.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("section_no", "number", "title", "content", "subsections"))), lambda x: F.struct(x["number"].alias("number"), x["title"].alias("title"), x["content"].alias("content"), x["subsections"].alias("subsections"))).alias("sections"))
    heads = rows.groupBy(*KEYS).agg(
        F.min_by(F.when(kind == "title", F.col("text")), F.when(kind == "title", F.col("node_no"))).alias("title"),
        F.min_by(F.when(kind == "question", F.struct("number", "text", "tags", "starred")), F.when(kind == "question", F.col("node_no"))).alias("question"),
        listed(kind == "belief", F.col("text")).alias("beliefs"), listed(kind == "table", F.col("text")).alias("tables"),
        F.max_by(F.when(kind == "label", F.col("text")), F.when(kind == "label", F.col("node_no"))).alias("page_label"),
    )
    return heads.join(sections, KEYS, "left").select(*KEYS, "title", "question", "sections", "beliefs", "tables", "page_label")


def flat_nodes(pages: DataFrame) -> DataFrame:
    """The node table of nested pages: title, question, sections with their lines and subsections, tables, belief items, label."""
    node = lambda kind, text, number=None, tags=None, starred=None: F.struct(
        F.lit(kind).alias("kind"), text.alias("text"), (F.lit(None).cast("string") if number is None else number).alias("number"),
        (F.lit(None).cast("array<string>") if tags is None else tags).alias("tags"), (F.lit(None).cast("boolean") if starred is None else starred).alias("starred"),
    )
    one = lambda c, made: F.when(c.isNotNull(), F.array(made)).otherwise(none)
    none = F.array().cast("array<struct<kind:string,text:string,number:string,tags:array<string>,starred:boolean>>")
    each = lambda kind, c: F.coalesce(F.transform(c, lambda x: node(kind, x)), none)
    sub = lambda x: F.concat(F.array(node("subsection", x["title"])), each("content", x["content"]))
    section = lambda s: F.concat(F.when(s["title"] != "", F.array(node("section", s["title"], s["number"]))).otherwise(none), each("content", s["content"]), F.flatten(F.transform(s["subsections"], sub)))
    q = F.col("question")
    every = F.concat(
        one(F.col("title"), node("title", F.col("title"))), one(q, node("question", q["text"], q["number"], q["tags"], q["starred"])), F.coalesce(F.flatten(F.transform("sections", section)), none),
        each("table", F.col("tables")), each("belief", F.col("beliefs")), one(F.col("page_label"), node("label", F.col("page_label"))),
    )
    rows = pages.select(*KEYS, F.posexplode(every).alias("i", "x"))
    return rows.select(*KEYS, (F.col("i") + 1).alias("node_no"), "x.*", F.lit(1).cast("long").alias("run"))
