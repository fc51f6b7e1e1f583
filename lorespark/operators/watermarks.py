"""Watermarks learnt from a document's own pages, and its lines cleaned of them, with a log of what went and why.

Two passes: the first gathers the pieces of printed marks (names, numbers, dates) of each document; the second strips
every line by its document's dictionary, joined on the document, and judges what is left. A dictionary holds what one
document's marks are made of; it travels with its lines by a shuffle join, so nothing is broadcast by guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.korean import strip_particle
from lorespark.functions.text import let, text_of
from lorespark.operators import cleanup as c

# ---- Fixed values -------------------------------------------------------------------------------------------------
SAMPLES = 12
CLOCK = r"\d{1,2}\s*:\s*\d{2}"
LOOSE_CLOCK = r"(?<![0-9A-Za-z_])\d{1,2}\s*:\s*\d{2}(?![0-9A-Za-z_])"
NAME = "^[가-힣]{2,5}$"
# -------------------------------------------------------------------------------------------------------------------

CHAIN = f"({c.SLASH_CHAIN})"
DATE_TIME = f"({c.DATE_TIME})"
DICTIONARY = ("words", "digits", "dates", "protected", "frequent")


def _chains(line: Column) -> Column:
    """The slash chains of a line; looked for only where there is a slash, as they are sought from every character."""
    return F.when(F.contains(line, F.lit("/")), F.regexp_extract_all(line, F.lit(CHAIN), F.lit(1))).otherwise(F.array().cast("array<string>"))


def _marks(line: Column) -> Column:
    """``array<struct<mark, chain>>``: the printed marks of a line, chains first."""
    chains = F.transform(F.filter(_chains(line), lambda x: c.watermark_chain(x)), lambda x: F.struct(F.trim(x).alias("mark"), F.lit(True).alias("chain")))
    return F.concat(chains, F.transform(F.regexp_extract_all(line, F.lit(DATE_TIME), F.lit(1)), lambda x: F.struct(x.alias("mark"), F.lit(False).alias("chain"))))


def _entries(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _pieces(mark: Column, chain: Column) -> Column:
    """``array<struct<kind, value>>``: what a mark is made of, and the mark itself."""
    names = F.filter(F.split(mark, r"[/\s]+"), lambda p: chain & p.rlike(NAME))
    clock = F.regexp_replace(F.regexp_extract(mark, CLOCK, 0), r"\s+", "")
    digits = F.concat(F.regexp_extract_all(mark, F.lit(r"(\d{2,})"), F.lit(1)), F.when(clock != "", F.array(clock)).otherwise(F.array().cast("array<string>")))
    dates = F.transform(F.regexp_extract_all(mark, F.lit(f"({c.DATE})"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", ""))
    return F.concat(_entries("word", names), _entries("digits", digits), _entries("date", dates), _entries("sample", F.array(mark)))


def learned_pieces(lines: DataFrame) -> DataFrame:
    """``doc_id, kind, value, pages, first``: the pieces of each document's printed marks.

    kind: ``word`` (a name in a chain), ``digits`` (numbers of two figures or more, and a mark's first clock time), ``date``, or
    ``sample`` (the marks themselves, the first twelve). pages: on how many pages it was seen; first: (page, line, place) of the
    first. lines: doc_id, page, line_no, line.
    """
    marks = lines.withColumn("line", text_of(F.col("line"))).where(F.contains("line", F.lit("/")) | F.col("line").rlike(DATE_TIME))
    marks = marks.select("doc_id", "page", "line_no", F.posexplode(_marks(F.col("line"))).alias("place", "m")).select("doc_id", "page", "line_no", "place", "m.*")
    rows = marks.select("doc_id", "page", "line_no", "place", F.explode(_pieces(F.col("mark"), F.col("chain"))).alias("p")).select("doc_id", "page", "line_no", "place", "p.*")
    counted = rows.groupBy("doc_id", "kind", "value").agg(F.count_distinct("page").alias("pages"), F.min(F.struct("page", "line_no", "place")).alias("first"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("first", "value"))
    return counted.withColumn("n", turn).where(f"kind <> 'sample' or n <= {SAMPLES}").drop("n")


def _words(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", F.explode(F.filter(F.split(text_of(F.col("line")), r"\s+"), lambda w: w != "")).alias("word"))


def dictionaries(lines: DataFrame) -> DataFrame:
    """``doc_id, marks``: a document's words, digits and dates, its protected words (names that the text has with a particle,
    so that they may be content), and the frequent ones among the words that chains begin with (stems seen twice).

    Only lines with marks are looked at for pieces, and only words that hold a name or a chain's first word for stems.
    """
    line = text_of(F.col("line"))
    head = lambda chain: strip_particle(F.trim(F.get(F.split(chain, "/"), F.lit(0))))
    found = F.concat(F.flatten(F.transform(_marks(line), lambda m: _pieces(m["mark"], m["chain"]))), _entries("head", F.transform(_chains(line), head)))
    pieces = lines.where(F.contains(line, F.lit("/")) | line.rlike(DATE_TIME)).select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.*").where("kind <> 'sample' and value <> ''")
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("value"))))
    known = pieces.groupBy("doc_id").agg(of("word").alias("words"), of("digits").alias("digits"), of("date").alias("dates"), of("head").alias("heads"))

    sought = F.array_union("words", "heads")
    rows = lines.select("doc_id", line.alias("line")).join(known.select("doc_id", "words", "heads"), "doc_id")
    rows = rows.withColumn("here", F.filter(sought, lambda x: F.contains("line", x))).where(F.size("here") > 0)
    words = rows.select("doc_id", "words", "heads", F.explode(F.filter(F.split("line", r"\s+"), lambda w: F.exists("here", lambda x: F.contains(w, x)))).alias("word"))
    words = words.withColumn("stem", strip_particle(F.col("word")))
    inflected = F.array_contains("words", F.col("stem")) & (F.col("word") != F.col("stem")) & ~F.contains("word", F.lit("/"))
    stems = words.groupBy("doc_id", "stem").agg(F.max(inflected).alias("inflected"), F.count_if(F.array_contains("heads", F.col("stem"))).alias("n"))
    seen = lambda condition: F.sort_array(F.collect_set(F.when(condition, F.col("stem"))))
    stems = stems.groupBy("doc_id").agg(seen(F.col("inflected")).alias("protected"), seen(F.col("n") >= 2).alias("frequent"))
    none = F.array().cast("array<string>")
    marks = F.struct("words", "digits", "dates", F.coalesce("protected", none).alias("protected"), F.coalesce("frequent", none).alias("frequent"))
    return known.join(stems, "doc_id", "left").select("doc_id", marks.alias("marks"))


def strip_marks(line: Column, marks: Column) -> Column:
    """``struct<text, removed: array<struct<from, why>>>``: the line without its watermarks; marks: a document's dictionary.

    Chains go first (but for a word of the sentence that one begins with), then date-times, the marks' own dates, clock
    times where anything went, and at last learned words and numbers that stand alone.
    """
    reason = lambda from_, why: F.struct(from_.alias("from"), F.lit(why).alias("why"))
    none = F.array().cast("array<struct<from:string,why:string>>")
    state = lambda text, removed: F.struct(text.alias("text"), removed.alias("removed"))

    def chain(x: Column) -> Column:
        pieces = F.split(x, "/")
        first = F.trim(F.get(pieces, F.lit(0)))
        content = first.rlike("[가-힣]") & ~F.array_contains(marks["words"], first) & (first.rlike(c.PARTICLE_TAIL) | F.array_contains(marks["frequent"], strip_particle(first)))
        rest = F.when(content, F.array_join(F.slice(pieces, F.lit(2), F.size(pieces)), "/")).otherwise(x)
        goes = c.watermark_chain(x, marks["words"]) & (F.trim(rest) != "")
        put = F.when(~goes, x).when(content, F.concat(F.get(pieces, F.lit(0)), F.lit(" "))).otherwise(" ")
        return F.struct(put.alias("put"), F.when(goes, F.trim(rest)).alias("gone"))

    def chains(text: Column) -> Column:
        between = F.split(text, CHAIN, -1)
        judged = lambda found: state(
            F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b["put"], F.lit("")))), ""),
            F.transform(F.filter(found, lambda f: f["gone"].isNotNull()), lambda f: reason(f["gone"], c.WHY_CHAIN)),
        )
        return F.when(F.contains(text, F.lit("/")), let(F.transform(_chains(text), chain), judged)).otherwise(state(text, none))

    def cut(pattern: str, why: str):
        return lambda s: state(F.regexp_replace(s["text"], pattern, " "), F.concat(s["removed"], F.transform(F.regexp_extract_all(s["text"], F.lit(f"({pattern})"), F.lit(1)), lambda x: reason(F.trim(x), why))))

    def dates(s: Column) -> Column:
        between, found = F.split(s["text"], c.DATE, -1), F.regexp_extract_all(s["text"], F.lit(f"({c.DATE})"), F.lit(1))
        known = lambda x: F.array_contains(marks["dates"], F.regexp_replace(x, r"\s+", ""))
        text = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(F.when(known(b), " ").otherwise(b), F.lit("")))), "")
        return state(text, F.concat(s["removed"], F.transform(F.filter(found, known), lambda x: reason(F.trim(x), c.WHY_DATE))))

    clock = lambda s: F.when(F.size(s["removed"]) > 0, cut(LOOSE_CLOCK, c.WHY_CLOCK)(s)).otherwise(s)
    learned = lambda s: let(c.strip_learned(s["text"], marks["words"], marks["digits"], marks["protected"]), lambda x: state(x["text"], F.concat(s["removed"], x["removed"])))
    return let(let(let(let(chains(text_of(line)), cut(c.DATE_TIME, c.WHY_TIME)), dates), clock), learned)


def marked_lines(lines: DataFrame) -> DataFrame:
    """The lines with ``text`` and ``removed``: stripped of the watermarks of their document (see :func:`strip_marks`)."""
    empty = F.struct(*(F.array().cast("array<string>").alias(name) for name in DICTIONARY))
    rows = lines.join(dictionaries(lines), "doc_id", "left").withColumn("marks", F.coalesce("marks", empty))
    return rows.withColumn("_s", strip_marks(F.col("line"), F.col("marks"))).select(*lines.columns, "_s.text", "_s.removed")


def cleaned_document(regions: DataFrame) -> DataFrame:
    """Recognised lines cleaned: those of ``regions`` with ``clean`` (null where the line goes), ``dropped`` and ``log``.

    regions: doc_id, page, kind, index, line_no, line. After watermarks, lines of page numbers go (in headers and
    footers, and the last two of a page without regions), noise goes (labels aside), bullets take one form. dropped:
    watermark, pageNumber or noise; log: array<struct<type, from, to, why>>. Blank lines are no lines. The lexicon by which
    shreds are known is the document's. Terms are unified afterwards, see cleanup.term_map.
    """
    rows = marked_lines(regions.where(F.col("line").rlike(r"\S")))
    # Shreds are of four letters at most, and only regions are judged for them.
    judged = regions.where("kind not in ('label', 'page')").select("doc_id").distinct()
    lexicon = _words(regions.join(judged, "doc_id", "left_semi")).withColumn("stem", strip_particle(F.col("word"))).where(F.length("stem") <= 4)
    lexicon = lexicon.groupBy("doc_id", "stem").agg(F.count("*").alias("n"))
    rows = rows.withColumn("stem", strip_particle(F.trim("text"))).join(lexicon, ["doc_id", "stem"], "left")
    end = F.max("line_no").over(Window.partitionBy("doc_id", "page", "kind", "index"))
    rows = rows.withColumn("last", end)
    edge = F.col("kind").isin("footer", "page_footer", "header") | ((F.col("kind") == "page") & (F.col("line_no") >= F.col("last") - 1))
    text, whole_page = F.col("text"), F.col("kind") == "page"
    noise = F.when(F.col("kind") != "label", F.when(whole_page, c.noise_reason(text)).otherwise(c.noise_reason(text, False, F.col("n"))))
    dropped = F.when(text == "", "watermark").when(edge & c.is_page_number(text), "pageNumber").when(F.col("noise").isNotNull(), "noise")
    rows = rows.withColumn("noise", noise).withColumn("dropped", dropped).withColumn("bullets", c.normalize_bullets(text))
    clean = F.when(F.col("dropped").isNull(), F.when(F.col("kind") == "label", text).otherwise(F.col("bullets")))
    entry = lambda type_, from_, to, why: F.struct(F.lit(type_).alias("type"), from_.alias("from"), to.alias("to"), why.alias("why"))
    removed = F.transform("removed", lambda x: entry("watermark", x["from"], F.lit(""), x["why"]))
    bare = lambda x, marks: F.regexp_replace(x, marks, "")
    changed = (F.col("kind") != "label") & (F.col("bullets") != F.trim(text)) & (bare(F.col("bullets"), r"[●\-\s·]") != bare(text, r"[•●∙◦○▪■·ㆍ*―ㅡ–—−\-\s]"))
    more = (
        F.when(F.col("dropped") == "pageNumber", F.array(entry("pageNumber", F.trim(text), F.lit(""), F.lit("쪽 번호"))))
        .when(F.col("dropped") == "noise", F.array(entry("noise", text, F.lit(""), F.col("noise"))))
        .when(F.col("dropped").isNull() & changed, F.array(entry("bullet", text, F.col("bullets"), F.lit("글머리 기호 정리"))))
        .otherwise(F.array().cast("array<struct<type:string,from:string,to:string,why:string>>"))
    )
    return rows.select(*regions.columns, clean.alias("clean"), "dropped", F.concat(removed, more).alias("log"))


def cleaning_log(cleaned: DataFrame) -> DataFrame:
    """``doc_id, page, region, line, n, type, from, to, why``: a row for everything that was removed or changed."""
    region = F.concat("kind", F.coalesce(F.col("index").cast("string"), F.lit("")))
    return cleaned.select("doc_id", "page", region.alias("region"), (F.col("line_no") + 1).alias("line"), F.posexplode("log").alias("n", "e")).select("doc_id", "page", "region", "line", "n", "e.*")


def page_labels(cleaned: DataFrame) -> DataFrame:
    """``doc_id, page, page_label``: the first page number that a page shows."""
    shown = cleaned.where("dropped = 'pageNumber'").select("doc_id", "page", F.struct(F.col("kind"), F.col("index"), "line_no").alias("place"), F.element_at("log", -1)["from"].alias("text"))
    return shown.groupBy("doc_id", "page").agg(F.min_by("text", "place").alias("page_label"))
