"""Edited materials: the latest edit of each applied, structures derived anew, points refreshed; and the log of corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import text_of
from lorespark.operators.corrections import suggestion_applied
from lorespark.operators.structure import has_tags, structure_from_texts
from lorespark.operators.study import refreshed_points
from lorespark.sources.tables import settled


def edited_materials(materials: DataFrame, edits: DataFrame) -> DataFrame:
    """The materials after the latest edit of each.

    materials: material_id, title, raw_text, final_text, updated_at and others; edits: material_id, title, text, at, seq
    (null title or text: as it is). The raw text never changes; edits of materials that are not there are no new materials; an
    edit older than the material's last change is left out. Ties in time go to the greater seq.
    """
    last = F.row_number().over(Window.partitionBy("material_id").orderBy(F.desc("at"), F.desc("seq")))
    newest = edits.withColumn("_n", last).where("_n = 1").select("material_id", F.trim("title").alias("_title"), F.col("text").alias("_text"), F.col("at").alias("_at"))
    rows = materials.join(newest, "material_id", "left")
    taken = F.col("_at").isNotNull() & (F.col("_at") >= F.coalesce("updated_at", F.lit(0)))
    put = lambda new, old: F.when(taken, F.coalesce(new, old)).otherwise(F.col(old))
    changes = {"title": put("_title", "title"), "final_text": put("_text", "final_text"), "updated_at": put("_at", "updated_at")}
    return rows.withColumns(changes).select(*materials.columns)


def synced_structures(materials: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and pages of the materials whose final text has tags or that had a structure before, read anew from that text.

    pages: doc_id (a material's id), page, question, page_label, unverified, as known; labels and unverified lines are
    taken over by question, else by place.
    """
    known = pages.select(F.col("doc_id").alias("material_id")).distinct().withColumn("_known", F.lit(True))
    rows = materials.join(known, "material_id", "left").where(F.col("_known") | has_tags(F.col("final_text")))
    return structure_from_texts(rows.select(F.col("material_id").alias("doc_id"), F.lit(0).alias("n"), F.col("final_text").alias("text")), pages)


def refreshed_after_edits(materials: DataFrame, points: DataFrame, edits: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Materials and points after the edits: only points of materials whose text has changed are made anew.

    materials: as in :func:`edited_materials`, with unit_id, points_hash, points_origin, points_version; points: as
    :func:`lorespark.operators.study.refreshed_points` takes them.
    """
    after = settled(edited_materials(materials, edits))
    marks = ["material_id", "unit_id", "points_hash", "points_origin", "points_version"]
    made, marked = refreshed_points(after.select(*marks, F.col("final_text").alias("text")), points, now=now)
    rest = [c for c in materials.columns if c not in marks[2:]]
    return after.select(*rest).join(marked.select("material_id", *marks[2:]), "material_id").select(*materials.columns), made


def correction_events(corrected: DataFrame, decisions: DataFrame) -> DataFrame:
    """``group_id, page, seq, tag, ord, from, to, at``: all that was done and decided about a page's corrections, in order.

    corrected: of :func:`lorespark.operators.corrections.corrected_pages`; decisions: group_id, page, ord, accept, seq, on
    uncertain changes. tag: ``applied``, ``uncertain``, ``rejected`` or ``missing`` when the changes were tried; later
    ``confirmed`` or ``dismissed``. A change is decided on once: later decisions on it are left out. at: the place in the raw
    text (of tried changes).
    """
    tried = corrected.select("group_id", "page", F.explode("outcomes").alias("o")).select("group_id", "page", F.lit(0).alias("turn"), F.col("o.ord").cast("long").alias("order"), F.col("o.outcome").alias("tag"), "o.ord", "o.from", "o.to", "o.at")
    first = F.row_number().over(Window.partitionBy("group_id", "page", "ord").orderBy("seq"))
    decided = decisions.withColumn("_n", first).where("_n = 1").join(tried.where("tag = 'uncertain'").drop("turn", "order", "tag"), ["group_id", "page", "ord"])
    decided = decided.select("group_id", "page", F.lit(1).alias("turn"), F.col("seq").cast("long").alias("order"), F.when(F.col("accept"), "confirmed").otherwise("dismissed").alias("tag"), "ord", "from", "to", F.lit(None).cast("int").alias("at"))
    place = F.row_number().over(Window.partitionBy("group_id", "page").orderBy("turn", "order", "ord"))
    rows = tried.unionByName(decided).withColumn("seq", place)
    return rows.select("group_id", "page", "seq", "tag", "ord", "from", "to", "at")


def replayed_pages(pages: DataFrame, events: DataFrame, until: Column | None = None) -> DataFrame:
    """``group_id, page, text``: the pages' texts as the events up to ``until`` (a condition on them) leave them.

    pages: group_id, page, text (raw). Applied changes are put at their places in the raw text, from the last to the
    first, so that places stay right; confirmed ones then at the first place that reads so. A page's events are few: one list.
    """
    kept = events.where("tag in ('applied', 'confirmed')")
    kept = kept if until is None else kept.where(until)
    one = F.struct("at", "seq", "from", "to")
    lists = kept.groupBy("group_id", "page").agg(
        F.sort_array(F.collect_list(F.when(F.col("tag") == "applied", one)), asc=False).alias("applied"), F.sort_array(F.collect_list(F.when(F.col("tag") == "confirmed", F.struct("seq", "from", "to")))).alias("confirmed")
    )
    rows = pages.select("group_id", "page", text_of(F.col("text")).alias("text")).join(lists, ["group_id", "page"], "left")
    spliced = lambda t, e: F.concat(F.substring(t, F.lit(1), e["at"]), e["to"], F.substring(t, e["at"] + F.length(e["from"]) + 1, F.length(t)))
    done = F.coalesce(F.aggregate("applied", F.col("text"), spliced), F.col("text"))
    rows = rows.withColumn("text", done)
    done = F.coalesce(F.aggregate("confirmed", F.col("text"), lambda t, e: suggestion_applied(t, e["from"], e["to"])), F.col("text"))
    return rows.select("group_id", "page", done.alias("text"))
