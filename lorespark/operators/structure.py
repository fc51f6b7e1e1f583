"""Structured pages: texts (tagged or not) and recognised regions to nodes, and nodes to tagged text.

A node is a row (doc_id, page, node_no, kind, text, number, tags, starred, run); nodes of one run were read together, so a
section or subsection holds no further than its run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import let, text_of
from lorespark.operators.cleanup import label_kind

# ---- Fixed values -------------------------------------------------------------------------------------------------
TAG = r"^\[(제목|질문|핵심\s*내용|신념화|쪽)\]\s*(.*)$"
SECTION = r"^(\d{1,2})\s*[.)]\s*(?=\S)(.+)$"
SUBSECTION = r"^-\s*(.+)$"
ITEM = r"^●\s*(.+)$"
GOES_ON = r"(은|는|이|가|을|를|에|의|와|과|고|며|서|로|,)$"
QUESTION_NUMBER = r"^[QqOo0]?\s*(\d{1,3})\s*[.,]\s*"
QUESTION_TAGS = r"^[(\[]\s*([★☆*※x]?)\s*([^)\]]{1,40})[)\]]\s*"
QUESTION_LINE = r"^\s*[QqO0]\s*\d{1,3}\s*[.,]\s*\S|^\s*\d{1,3}\s*\.\s*[(\[]\s*[★☆*]"
PART_LABELS = (r"^(핵\s*심\s*내\s*용|핵\s*심|신\s*념\s*화)\s*$", r"^(신\s*념\s*화)\s*([●•*].*)$", r"^(핵\s*심\s*내\s*용)\s*(\d{1,2}\s*[.)].*)$")
#: The second half of a label that was read as two lines.
SECOND_HALF = r"^내\s*용$"
QUOTED = r"[‘'“\"]([^’'”\"]{2,30})[’'”\"]"
WHITE = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
HEADER = r"^(.*?)\s*[(\[]\s*(\d+\s*-\s*\d+\s*\.?\s*[^)\]]*?)\s*[)\]]?\s*$"
# -------------------------------------------------------------------------------------------------------------------


def _head(c: Column) -> Column:
    """A head line without what stands before its title; it has a title where something is left."""
    one = F.trim(F.regexp_replace(text_of(c), r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(one, r"^[^가-힣0-9(\[]*[:：]\s*", ""), r"^[^가-힣0-9(\[]+", ""))


def parse_header(c: Column) -> Column:
    """``struct<title, chapter, lesson>`` of a page's head line."""
    line = _head(c)
    chapter = F.trim(F.regexp_extract(line, HEADER, 1))
    lesson = F.regexp_replace(F.regexp_extract(line, HEADER, 2), r"\s*-\s*", "-")
    lesson = F.trim(F.regexp_replace(lesson, r"^([^.]*?\d)\s*\.\s*", "$1. "))
    none = F.lit(None).cast("string")
    found = F.struct(F.concat(chapter, F.lit(" ("), lesson, F.lit(")")).alias("title"), chapter.alias("chapter"), lesson.alias("lesson"))
    return F.when(chapter != "", found).otherwise(F.struct(F.nullif(line, F.lit("")).alias("title"), none.alias("chapter"), none.alias("lesson")))


def parse_question(c: Column) -> Column:
    """``struct<number, text, tags, starred>`` of a question's line."""
    line = F.regexp_replace(F.trim(F.regexp_replace(text_of(c), r"\s+", " ")), r"^\[질문\]\s*", "")
    number = F.regexp_extract(line, QUESTION_NUMBER, 1)
    rest = F.regexp_replace(line, QUESTION_NUMBER, "")
    tags = F.filter(F.transform(F.split(F.regexp_extract(rest, QUESTION_TAGS, 2), "[,/·]"), lambda x: F.trim(x)), lambda t: t != "")
    return F.struct(
        F.when(number != "", number.cast("int").cast("string")).alias("number"),
        F.trim(F.regexp_replace(rest, QUESTION_TAGS, "")).alias("text"),
        tags.alias("tags"),
        (F.regexp_extract(rest, QUESTION_TAGS, 1) != "").alias("starred"),
    )


def has_tags(c: Column) -> Column:
    return text_of(c).rlike(r"(?m)^\[(질문|핵심\s*내용|신념화)\]")


def _white_off(c: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text_of(c), F.lit(WHITE))


def _events(documents: DataFrame, by: list[str], text: str) -> DataFrame:
    """The lines of texts that are not blank, with what each of them does to page and part.

    ``n, line, tagged``; event: title, question, label (of a part), number (of the page), skip, null for plain lines;
    area: the part that a label opens; rest: what stands behind a tag or label.
    """
    # Lines are judged before they become rows: what is a column of rows already is not worked out again by each condition on it.
    def judged(line: Column) -> Column:
        tag = F.regexp_replace(F.regexp_extract(line, TAG, 1), r"\s+", "")
        found = F.array(*(F.struct(F.regexp_extract(line, p, 1).alias("label"), (F.trim(F.regexp_extract(line, p, 2)) if k else F.lit("")).alias("rest")) for k, p in enumerate(PART_LABELS)))
        label = F.get(F.filter(found, lambda f: f["label"] != ""), F.lit(0))

        def by_tag(tag: Column) -> Column:
            event = F.when(tag == "제목", "title").when(tag == "질문", "question").when(tag == "쪽", "number").when(tag != "", "label")
            return F.struct(line.alias("line"), event.alias("event"), area(tag).alias("area"), F.trim(F.regexp_extract(line, TAG, 2)).alias("rest"))

        def by_form(label: Column) -> Column:
            event = F.when(line.rlike(QUESTION_LINE), "question").when(label.isNotNull(), "label").when(line.rlike(SECOND_HALF), "skip")
            return F.struct(line.alias("line"), event.alias("event"), area(label["label"]).alias("area"), F.coalesce(label["rest"], F.lit("")).alias("rest"))

        return F.when(F.col("tagged"), let(tag, by_tag)).otherwise(let(label, by_form))

    area = lambda name: F.when(F.contains(name, F.lit("신")), "belief").otherwise("core")
    # The whole text is looked at once, before it falls into lines.
    whole = documents.select(*by, has_tags(F.col(text)).alias("tagged"), F.split(text_of(F.col(text)), r"\r?\n").alias("lines"))
    lines = whole.select(*by, "tagged", F.posexplode(F.transform("lines", lambda x: let(_white_off(x), judged))).alias("n", "e"))
    return lines.where("e.line <> ''").select(*by, "n", "e.line", "tagged", "e.event", "e.area", "e.rest")


def text_parts(documents: DataFrame, by: list[str] | None = None, text: str = "text") -> DataFrame:
    """``*by, page, run, part, n, line, labelled``: the lines of texts, tagged or not, with the page and part they belong to.

    A text with tags is read by them. Otherwise lines tell by their form: a numbered question, the label of a part (alone
    or before its first line), a first line as the title. A title tag opens a page; so does a question where the page has
    one or has finished a part, that is, where a label came after lines that fill it. A question goes on over lines until
    one ends with a question mark or a numbered or dashed line begins. Lines without any of these belong to the core part.

    As only titles and questions open pages, only the lines before the first question after a title can make up a page
    without one: the page's number is a running count of questions, plus one where those lines have finished a part. So
    pages, parts and runs (lines read together, ended by a title, question or label) are islands of cumulative flags over
    a text's lines; no state grows. ``by`` names a text; a question tag without text counts as a question.
    """
    by = by or ["doc_id"]
    rows = _events(documents, by, text).where("event is distinct from 'skip'")
    event, line, n = F.col("event"), F.col("line"), F.col("n")
    is_event = lambda *names: F.coalesce(event.isin(*names), F.lit(False))
    so_far = lambda *keys: Window.partitionBy(*by, *keys).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda condition, *keys: F.sum(condition.cast("int")).over(so_far(*keys))
    rows = rows.withColumn("title_no", count(is_event("title"))).withColumn("asked", count(is_event("question"), "title_no"))
    before = F.col("asked") == 0
    # The first line as a title: unless a label or a numbered line comes first; lines that give no title are passed over.
    heads = before & ~F.col("tagged") & event.isNull()
    stop = F.min(F.when(before & ~F.col("tagged") & (is_event("label") | (heads & line.rlike(SECTION))), n)).over(Window.partitionBy(*by, "title_no"))
    titled = F.min(F.when(heads & ~line.rlike(SECTION) & (_head(line) != ""), n)).over(Window.partitionBy(*by, "title_no"))
    rows = rows.withColumn("stop", stop).withColumn("titled", titled)
    is_head = heads & (n < F.coalesce("stop", n + 1)) & (n <= F.coalesce("titled", n))
    rows = rows.withColumn("head", is_head).where(~F.col("head") | (n == F.col("titled")))
    opened = F.coalesce(F.last(F.when(is_event("label"), F.col("area")), ignorenulls=True).over(so_far("title_no")), F.lit("core"))
    fills = before & ~F.col("head") & F.when(event.isNull(), True).otherwise(is_event("label") & (F.col("rest") != ""))
    fills = fills & F.when(opened == "belief", F.col("tagged")).otherwise(~is_table_row(F.when(event.isNull(), line).otherwise(F.col("rest"))))
    rows = rows.withColumn("fills", fills)
    whole = Window.partitionBy(*by, "title_no")
    finished = F.min(F.when(F.col("fills"), n)).over(whole) < F.max(F.when(before & is_event("label", "number"), n)).over(whole)
    rows = rows.withColumn("offset", F.when(before, 1).otherwise(F.col("asked") + F.when(F.coalesce(finished, F.lit(False)), 1).otherwise(0)))
    rows = rows.withColumn("page", F.dense_rank().over(Window.partitionBy(*by).orderBy("title_no", "offset")))
    # In a page: where a question that goes on over lines is left.
    rows = rows.withColumn("segment", count(is_event("question", "label", "title"), "page"))
    ended = F.when(is_event("question"), parse_question(line)["text"]).otherwise(line).rlike("[?？]$")
    rows = rows.withColumn("ended", ended)
    previous = Window.partitionBy(*by, "page", "segment").orderBy("n")
    leaves = ~F.col("tagged") & event.isNull() & (line.rlike(SECTION) | line.rlike(SUBSECTION) | F.coalesce(F.lag("ended").over(previous), F.lit(False)))
    rows = rows.withColumn("leaves", leaves).withColumn("left", count(F.col("leaves"), "page", "segment"))
    mode = F.last(F.when(is_event("question"), F.lit("question")).when(is_event("label"), F.col("area")), ignorenulls=True).over(so_far("page"))
    mode = F.when((mode == "question") & (F.col("left") > 0), "core").otherwise(F.coalesce(mode, F.lit("core")))
    part = F.when(is_event("title") | F.col("head"), "title").when(is_event("number"), "label").otherwise(mode)
    first_left = F.col("leaves") & (F.col("left") == 1) & (mode == "core")
    rows = rows.withColumn("part", part).withColumn("starts", is_event("title", "question", "label", "number") | first_left)
    rows = rows.withColumn("run", count(F.col("starts"), "page"))
    labelled = F.max(is_event("label") & (F.col("area") == "core")).over(Window.partitionBy(*by, "page"))
    content = F.when(F.col("tagged") & event.isNotNull(), F.col("rest")).when(is_event("label"), F.col("rest")).otherwise(line)
    rows = rows.select(*by, "page", "run", "part", "n", content.alias("line"), labelled.alias("labelled"), (is_event("label") & (F.col("rest") == "")).alias("bare"))
    return rows.where("not bare").drop("bare")


def region_parts(regions: DataFrame) -> DataFrame:
    """``doc_id, page, run, part, n, line, labelled``: the lines of recognised regions with the part they belong to.

    regions: doc_id, page, kind (header, question, label, block, ...), index, line_no, line. The first header is the title, the first
    question the question. A block belongs to the part that the label with its index names (a join on page and index);
    without one, the last of several blocks is the belief part, any other the core. A page that is one region of kind
    ``page`` is read as untagged text, of which the first page counts. Each block is a run of its own.
    """
    key = ["doc_id", "page"]
    page = Window.partitionBy(*key)
    regions = regions.withColumn("kinds", F.collect_set(F.struct("kind", "index")).over(page))
    alone = (F.size("kinds") == 1) & (F.col("kinds")[0]["kind"] == "page")
    lines = lambda by: F.transform(F.sort_array(F.collect_list(F.struct("line_no", text_of(F.col("line")).alias("line")))), lambda x: x["line"])
    texts = regions.where(alone).groupBy(*key).agg(F.array_join(lines(key), "\n").alias("text"))
    inferred = text_parts(texts.withColumnRenamed("page", "sheet"), ["doc_id", "sheet"]).where("page = 1").drop("page").withColumnRenamed("sheet", "page")
    rest = regions.where(~alone)
    joined = rest.where("kind in ('header', 'question', 'label')").groupBy(*key, "kind", "index").agg(lines(key).alias("lines"))
    heads = joined.where("kind <> 'label'").withColumn("first", F.row_number().over(Window.partitionBy(*key, "kind").orderBy("index"))).where("first = 1")
    heads = heads.select(*key, F.when(F.col("kind") == "header", 0).otherwise(1).alias("run"), F.when(F.col("kind") == "header", "title").otherwise("question").alias("part"), F.lit(0).alias("at"), F.array_join("lines", " ").alias("line"), F.lit(False).alias("labelled"))
    labels = joined.where("kind = 'label'").select(*key, "index", label_kind(F.array_join("lines", "")).alias("named"), F.lit(True).alias("has_label"))
    blocks = rest.where("kind = 'block'").withColumn("i", F.dense_rank().over(page.orderBy("index")))
    blocks = blocks.withColumn("blocks", F.max("i").over(page)).join(labels, [*key, "index"], "left")
    part = F.coalesce("named", F.when((F.col("blocks") >= 2) & (F.col("i") == F.col("blocks")), "belief").otherwise("core"))
    sure = (part == "core") & (F.col("has_label").isNotNull() | (F.col("blocks") >= 2))
    blocks = blocks.select(*key, (F.col("i") + 1).alias("run"), part.alias("part"), F.col("line_no").alias("at"), _white_off(F.col("line")).alias("line"), sure.alias("labelled")).where("line <> ''")
    found = heads.unionByName(blocks)
    number = F.row_number().over(page.orderBy("run", "at"))
    found = found.select(*key, "run", "part", number.alias("n"), "line", F.max("labelled").over(page).alias("labelled"))
    return found.unionByName(inferred.select(*found.columns))


def is_structured(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``*by, structured``: whether a page of the text has a question, a belief part, or a core part that is labelled."""
    sure = F.col("part").isin("question", "belief") | F.col("labelled")
    return parts.groupBy(*(by or ["doc_id"])).agg(F.max(sure).alias("structured"))


def is_table_row(line: Column) -> Column:
    return F.contains(text_of(line), F.lit("|")) & (F.size(_cells(text_of(line))) >= 2)


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def part_nodes(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The node table of lines with page and part: ``*by, page, node_no, kind, text, number, tags, starred, run``.

    Belief items begin with a bullet; where a run has none, a line goes on with the one before if that ends in a particle.
    Numbered lines are sections, dashed ones subsections, lines of cells table rows.
    """
    by = by or ["doc_id"]
    line = F.col("line")
    kind = (
        F.when(F.col("part").isin("title", "question", "label", "belief"), F.col("part"))
        .when(is_table_row(line), "table")
        .when(line.rlike(SECTION) & ~line.rlike(r"^\d{1,2}\.\d"), "section")
        .when(line.rlike(SUBSECTION), "subsection")
        .otherwise("content")
    )
    rows = parts.withColumn("kind", kind)
    # A belief item or question goes on over lines: islands that begin where a new one does.
    order = Window.partitionBy(*by, "page", "part").orderBy("n")
    bullets = F.max(line.rlike(ITEM)).over(Window.partitionBy(*by, "page", "part", "run"))
    first = F.lag("n").over(order).isNull()
    begins = F.when(F.col("kind") == "belief", line.rlike(ITEM) | first | (~bullets & ~F.lag("line").over(order).rlike(GOES_ON)))
    begins = begins.when(F.col("kind") == "question", first).otherwise(F.lit(True))
    rows = rows.withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("int")).over(order))
    joined = rows.groupBy(*by, "page", "part", "kind", "island").agg(F.min("n").alias("n"), F.min("run").alias("run"), F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"))
    first_line, more = F.get("lines", F.lit(0))["line"], F.array_join(F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: x["line"]), " ")
    joined = joined.withColumn("line", F.when(F.col("kind") == "question", first_line).otherwise(F.array_join(F.transform("lines", lambda x: x["line"]), " "))).withColumn("more", more)
    question = parse_question(line)
    clean = (
        F.when(F.col("kind") == "question", F.trim(F.concat_ws(" ", question["text"], F.col("more"))))
        .when(F.col("kind") == "section", F.trim(F.regexp_extract(line, SECTION, 2)))
        .when(F.col("kind") == "subsection", F.trim(F.regexp_extract(line, SUBSECTION, 1)))
        .when(F.col("kind") == "table", F.array_join(_cells(line), " | "))
        .when(F.col("kind") == "title", F.coalesce(parse_header(line)["title"], line))
        .otherwise(F.trim(F.regexp_replace(line, r"^●\s*", "")))
    )
    number = F.when(F.col("kind") == "question", question["number"]).when(F.col("kind") == "section", F.regexp_extract(line, SECTION, 1))
    place = F.row_number().over(Window.partitionBy(*by, "page").orderBy("n"))
    return joined.select(
        *by, "page", place.alias("node_no"), "kind", clean.alias("text"), number.alias("number"),
        F.when(F.col("kind") == "question", question["tags"]).alias("tags"), F.when(F.col("kind") == "question", question["starred"]).alias("starred"), "run",
    )


def nodes(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The node table of texts, tagged or not; ids are unique."""
    return part_nodes(text_parts(documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))))


def region_nodes(regions: DataFrame) -> DataFrame:
    """The node table of recognised regions (see :func:`region_parts`)."""
    return part_nodes(region_parts(regions))


def sectioned(node_table: DataFrame, page: list[str] | None = None) -> DataFrame:
    """Nodes of the core part with ``section_no`` and ``sub_no`` (0 above a section's first subsection), null for others.

    A section holds to the end of its run; lines of a run before any section make up one without a title.
    """
    page = page or ["doc_id", "page"]
    kind = F.col("kind")
    core = kind.isin("section", "subsection", "content")
    upto = lambda *more: Window.partitionBy(*page, *more).orderBy("node_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.count_if(core).over(Window.partitionBy(*page, "run").orderBy("node_no").rowsBetween(Window.unboundedPreceding, -1))
    opens = (kind == "section") | (core & (F.coalesce(before, F.lit(0)) == 0))
    rows = node_table.withColumn("section_no", F.when(core, F.sum(opens.cast("int")).over(upto())))
    return rows.withColumn("sub_no", F.when(core, F.count_if(kind == "subsection").over(upto("section_no"))))


def emphasis(node_table: DataFrame) -> DataFrame:
    """``doc_id, page, term``: the quoted terms of 2 to 30 characters in a page's question, lines and belief items."""
    quoted = F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1))
    rows = node_table.where("kind in ('question', 'content', 'belief')").select("doc_id", "page", F.explode(quoted).alias("term"))
    return rows.select("doc_id", "page", F.trim("term").alias("term")).distinct()


def continued_pages(pages: DataFrame, analyzed: DataFrame) -> DataFrame:
    """``doc_id, page, from_page, page_label, unverified``: what each page takes over from an earlier analysis.

    pages: doc_id, page, question, page_label; analyzed: also unverified (an array). A page goes on from the first
    analysed page with its question's text; where it has no question, or none is like it, from the page at its place.
    Its own label stands before an earlier one.
    """
    earlier = analyzed.select("doc_id", F.col("page").alias("from_page"), "question", F.col("page_label").alias("old_label"), "unverified")
    first = F.row_number().over(Window.partitionBy("doc_id", "question").orderBy("from_page"))
    asked = earlier.where("question is not null").withColumn("n", first).where("n = 1").drop("n")
    asked = asked.select("doc_id", "question", F.struct("from_page", "old_label", "unverified").alias("by_question"))
    placed = earlier.select("doc_id", F.col("from_page").alias("page"), F.struct("from_page", "old_label", "unverified").alias("by_place"))
    rows = pages.join(asked, ["doc_id", "question"], "left").join(placed, ["doc_id", "page"], "left").withColumn("source", F.coalesce("by_question", "by_place"))
    return rows.select("doc_id", "page", "source.from_page", F.coalesce(F.nullif("page_label", F.lit("")), "source.old_label").alias("page_label"), F.coalesce("source.unverified", F.array().cast(dict(analyzed.dtypes)["unverified"])).alias("unverified"))


def structure_from_texts(texts: DataFrame, analyzed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and pages of a document that was edited as several texts, with what an earlier analysis knew of its pages.

    texts: doc_id, n, text; analyzed: as :func:`continued_pages` takes it. Pages are counted through the texts in order.
    """
    by = ["doc_id", "text_no"]
    found = part_nodes(text_parts(texts.withColumnRenamed("n", "text_no"), by), by)
    found = found.withColumn("page", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text_no", "page")))
    of = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("text")), F.when(F.col("kind") == kind, F.col("node_no")))
    pages = found.groupBy("doc_id", "page").agg(of("question").alias("question"), of("label").alias("page_label"))
    return found.drop("text_no"), continued_pages(pages, analyzed)


def render_question(number: Column, tags: Column, starred: Column, text: Column) -> Column:
    star = F.when(F.coalesce(starred, F.lit(False)), "★").otherwise("")
    names = F.coalesce(F.array_join(tags, ", "), F.lit(""))
    inside = F.when((names != "") | (star != ""), F.concat(F.lit("("), star, names, F.lit(") "))).otherwise("")
    return F.trim(F.concat(F.when(number.isNotNull(), F.concat(F.lit("Q"), number, F.lit(". "))).otherwise(""), inside, text_of(text)))


def render(node_table: DataFrame) -> DataFrame:
    """``doc_id, text``: the tagged text of a node table; pages are parted by a blank line."""
    kind, text = F.col("kind"), F.col("text")
    line = (
        F.when(kind == "title", F.concat(F.lit("[제목] "), text))
        .when(kind == "question", F.concat(F.lit("[질문] "), render_question(F.col("number"), F.col("tags"), F.col("starred"), text)))
        .when(kind == "section", F.when(F.col("number").isNotNull(), F.concat("number", F.lit(". "), text)).otherwise(text))
        .when(kind == "subsection", F.concat(F.lit("- "), text))
        .when(kind == "belief", F.concat(F.lit("● "), text))
        .otherwise(text)
    )
    area = F.when(kind == "title", 0).when(kind == "question", 1).when(kind == "table", 3).when(kind == "belief", 4).otherwise(2)
    rows = node_table.where("kind <> 'label'").select("doc_id", "page", area.alias("area"), "node_no", line.alias("line"))
    order = Window.partitionBy("doc_id", "page").orderBy("area", "node_no")
    core, before = F.col("area").isin(2, 3), F.lag("area").over(order)
    head = F.when(core & ~F.coalesce(before.isin(2, 3), F.lit(False)), "[핵심 내용]\n").when((F.col("area") == 4) & ~F.coalesce(before == 4, F.lit(False)), "[신념화]\n").otherwise("")
    rows = rows.withColumn("line", F.concat(head, "line"))
    pages = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("area", "node_no", "line"))).alias("l"))
    pages = pages.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    whole = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return whole.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def join_lines(lines: DataFrame, group: list[str], order: str = "n", line: str = "line") -> DataFrame:
    """Lines that end in a connective are joined with the next one."""
    w = Window.partitionBy(*group).orderBy(order)
    begins = F.coalesce(~F.trim(F.lag(line).over(w)).rlike("(며|고|하여|되어|으며|,|및|와|과)$"), F.lit(True))
    rows = lines.withColumn("_begins", begins.cast("int")).withColumn("_island", F.sum("_begins").over(w))
    joined = rows.groupBy(*group, "_island").agg(F.sort_array(F.collect_list(F.struct(order, line))).alias("_l"))
    return joined.select(*group, F.col("_island").alias(order), F.array_join(F.transform("_l", lambda x: x[line]), " ").alias(line))
