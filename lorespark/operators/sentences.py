"""Sentences of texts whose lines are broken in mid-sentence, with the headings above them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import LINE_GOES_ON, clean_line, ends_sentence, is_bullet, is_heading, split_sentences, text_of

#: A line that is joined with others to so many characters goes on, whatever its end.
LONG_LINE = 28
FEW_WORDS = 3


def sentences_with_headings(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n, sentence, heading`` (``""`` above the first): lines joined, then cut into sentences; ids are unique.

    Lines are joined until one ends a sentence, or stands last or before a bullet or heading: these end a segment. In a
    segment, a line of few words that does not end in a connective ends its sentence too, unless what it closes has 28
    characters or more; then the rest of the segment is one. So only the first such stretch of a segment matters, and
    everything is windows over a text's lines: linear but for sorting, no array grows over lines but a joined sentence's own.
    """
    key = [id_column]
    whole = documents.select(id_column, F.split(text_of(F.col(text)), r"\r?\n").alias("_lines"))
    rows = whole.select(id_column, F.posexplode("_lines").alias("_i", "_line")).where(F.col("_line").rlike(r"\S"))
    order = Window.partitionBy(*key).orderBy("_i")
    upto = lambda *more: Window.partitionBy(*key, *more).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_head", is_heading(F.col("_line"))).withColumn("_clean", clean_line(F.col("_line"))).withColumn("_bullet", is_bullet(F.col("_line")))
    breaks = F.coalesce(F.lead(F.col("_bullet") | F.col("_head")).over(order), F.lit(True))
    rows = rows.withColumn("_hard", ends_sentence(F.col("_clean")) | breaks)
    rows = rows.withColumn("heading", F.coalesce(F.last(F.when(F.col("_head"), F.col("_clean")), ignorenulls=True).over(upto()), F.lit("")))
    rows = rows.where(~F.col("_head") & (F.col("_clean") != ""))
    goes_on = F.col("_clean").rlike(LINE_GOES_ON)
    rows = rows.withColumn("_soft", ~F.col("_hard") & ~goes_on & (F.size(F.split("_clean", r"\s+")) < FEW_WORDS))
    rows = rows.withColumn("_new", F.coalesce(F.lag("_hard").over(order), F.lit(False)).cast("int")).withColumn("_segment", F.sum("_new").over(upto()))
    rows = rows.withColumn("_new", F.coalesce(F.lag("_soft").over(Window.partitionBy(*key, "_segment").orderBy("_i")), F.lit(False)).cast("int")).withColumn("_stretch", F.sum("_new").over(upto("_segment")))
    length = F.sum(F.length("_clean") + 1).over(upto("_segment", "_stretch")) - 1
    rows = rows.withColumn("_stays", F.when(F.col("_soft") & (length >= LONG_LINE), F.col("_stretch")))
    first = F.min("_stays").over(Window.partitionBy(*key, "_segment"))
    rows = rows.withColumn("_run", F.least("_stretch", F.coalesce(first, F.col("_stretch"))))
    joined = rows.groupBy(*key, "_segment", "_run").agg(F.min("_i").alias("_i"), F.min("heading").alias("heading"), F.sort_array(F.collect_list(F.struct("_i", "_clean"))).alias("_all"))
    text_ = F.array_join(F.transform("_all", lambda x: x["_clean"]), " ")
    found = joined.select(*key, "_i", "heading", F.posexplode(split_sentences(text_)).alias("_k", "sentence"))
    return found.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("_i", "_k")) - 1).alias("n"), "sentence", "heading")
