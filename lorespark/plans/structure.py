"""Queries on lines in order: pages inferred from text, readings compared and merged, versions matched, points made."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.operators import alignment, comparison, points, structure
from lorespark.operators.cleanup import lexicon, line_score, lines_of
from lorespark.operators.sentences import FEW_WORDS, LONG_LINE, sentences_with_headings
from lorespark.plans.texts import LINES_SQL, documents, key_sql
from lorespark.sources.tables import read_table, settled


def _turns(spark, d):
    """Conversations as pages, their turns as lines."""
    t = read_table(spark, d, "conversations")
    return t.select(F.col("conv_id").alias("page"), F.col("turn").alias("line_no"), F.col("text").alias("line"))


def align_versions(spark, d):
    """The turns of a conversation against those of the one after it, aligned."""
    right = _turns(spark, d).withColumn("page", F.col("page") - 1)
    return alignment.align_pages(_turns(spark, d), right)


def consensus_lines(spark, d):
    """Three readings of each conversation, two of them with misread letters, merged by vote."""
    t = _turns(spark, d)
    readings = t.withColumn("variant", F.lit("A")).withColumn("confidence", F.lit(90.0))
    readings = readings.unionByName(t.withColumn("line", F.translate("line", "mn", "rn")).withColumn("variant", F.lit("B")).withColumn("confidence", F.lit(80.0)))
    readings = readings.unionByName(t.withColumn("line", F.translate("line", "oe", "oc")).withColumn("variant", F.lit("C")).withColumn("confidence", F.lit(70.0)))
    scored = readings.withColumn("score", line_score(F.col("line"), F.col("confidence")))
    grouped = alignment.grouped_readings(scored.select("page", "variant", "line_no", "line", "score"))
    merged = alignment.consensus(grouped, lexicon(t))
    return merged.select("page", "grp", "agree", F.md5("line").alias("line_md5"))


def matched_points(spark, d):
    """Lines of each document as old points, its sentences as new ones: which of them take over an old one."""
    old = lines_of(documents(spark, d)).where("trim(line) <> ''")
    old = old.select(F.col("doc_id").alias("material_id"), F.concat_ws(":", "doc_id", "line_no").alias("id"), F.col("line_no").alias("ord"), F.col("line").alias("text"))
    new = sentences_with_headings(documents(spark, d))
    new = new.select(F.col("doc_id").alias("material_id"), F.concat_ws(":", "doc_id", "n").alias("id"), F.col("n").alias("ord"), F.col("sentence").alias("text"))
    return points.matched_points(old, new)


def joined_sentences(spark, d):
    """Sentences of documents with lines joined across breaks, and the headings above them."""
    return sentences_with_headings(documents(spark, d)).select("doc_id", "n", F.md5("sentence").alias("sentence_md5"), "heading")


_W = "OVER (PARTITION BY doc_id ORDER BY i)"
SENTENCES_SQL = rf"""WITH {LINES_SQL}, c AS (
  SELECT doc_id, line_no AS i, trim(line) AS line, trim(regexp_replace(regexp_replace(line, '{text.BULLETS}', ''), '\s+', ' ', 'g')) AS clean, regexp_matches(line, '{text.BULLET}') AS bullet FROM lines WHERE regexp_matches(line, '\S')
), h AS (
  SELECT *, line <> '' AND length(line) <= 24 AND NOT regexp_matches(line, '{text.LIST_LINE}') AND NOT regexp_matches(line, '{text.SENTENCE_END}') AND NOT regexp_matches(line, '{text.LINE_GOES_ON}') AND (regexp_matches(line, '{text.HEADING_START}') OR NOT regexp_matches(line, '\s.*\s.*\s')) AS head FROM c
), b AS (
  SELECT *, regexp_matches(clean, '{text.SENTENCE_END}') OR coalesce(lead(bullet OR head) {_W}, true) AS hard, coalesce(last_value(CASE WHEN head THEN clean END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS heading FROM h
), s AS (
  SELECT *, NOT hard AND NOT regexp_matches(clean, '{text.LINE_GOES_ON}') AND len(string_split(clean, ' ')) < {FEW_WORDS} AS soft FROM b WHERE NOT head AND clean <> ''
), g AS (SELECT *, coalesce(lag(hard) {_W}, false)::INT AS fresh FROM s),
p AS (SELECT *, sum(fresh) {_W} AS segment FROM g),
q AS (SELECT *, coalesce(lag(soft) OVER (PARTITION BY doc_id, segment ORDER BY i), false)::INT AS again FROM p),
r AS (SELECT *, sum(again) OVER (PARTITION BY doc_id, segment ORDER BY i) AS stretch FROM q),
l AS (SELECT *, CASE WHEN soft AND sum(length(clean) + 1) OVER (PARTITION BY doc_id, segment, stretch ORDER BY i) - 1 >= {LONG_LINE} THEN stretch END AS stays FROM r),
m AS (SELECT *, least(stretch, coalesce(min(stays) OVER (PARTITION BY doc_id, segment), stretch)) AS run FROM l),
j AS (SELECT doc_id, segment, run, min(i) AS i, min(heading) AS heading, string_agg(clean, ' ' ORDER BY i) AS t FROM m GROUP BY ALL),
e AS (SELECT doc_id, i, heading, unnest(a) AS sentence, unnest(range(len(a))) AS k FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS a FROM j))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INT) AS n, md5(sentence) AS sentence_md5, heading FROM e"""


#: What lines of documents get in turn, so that they read as pages of a textbook: a beginning, and whether the line follows it.
FORMS = (
    ("", 1), ("국가와 군대 ", 1), ("Q3. (★헌법, 수호) ", 1), ("", 1), ("핵심 내용 1. ", 1), ("1가지 ", 1), ("● ", 1), ("- ", 1), ("신념화", 0), ("", 1), ("● 나는 ", 1), ("핵 심", 0), ("내용", 0), ("2) ", 1),
    ("‘용어’ ", 1), ("가 | 나 | ", 1), ("", 1), ("신념화 ● ", 1), ("1.5 ", 1), ("0 7, ", 1), ("정말 그런가?", 0), ("", 1), ("12. ☆ ", 1), ("핵심 내용", 0),
)
TAGS = (("", 1), ("[질문] Q2. ", 1), ("", 1), ("[핵심 내용]", 0), ("1. ", 1), ("두 가지 ", 1), ("- ", 1), ("- ", 1), ("", 1), ("[신념화]", 0), ("● ", 1), ("", 1), ("[쪽] ", 1), ("[질문] (x) ", 1), ("[핵심내용] 3. ", 1), ("[제목] 국가 ", 1), ("[신념화] ● ", 1), ("나는, ", 1))


def textbook(spark, d):
    """``doc_id, text``: documents with their lines given forms; every third has tags."""

    def formed(forms: tuple, i) -> F.Column:
        at = (F.pmod(F.col("doc_id") * 5 + i, F.lit(len(forms))) + 1).cast("int")
        line = lambda x: F.concat(F.element_at(F.array(*(F.lit(a) for a, _ in forms)), at), F.when(F.element_at(F.array(*(F.lit(b) for _, b in forms)), at) == 1, x).otherwise(""))
        return line

    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    text = F.transform(lines, lambda x, i: F.when(F.col("doc_id") % 3 == 0, formed(TAGS, i)(x)).otherwise(formed(FORMS, i)(x)))
    return documents(spark, d).select("doc_id", F.array_join(text, "\n").alias("text"))


def page_nodes(spark, d):
    """Pages of textbook-like texts, tagged or not, as nodes."""
    found = structure.nodes(textbook(spark, d))
    return found.select("doc_id", "page", "node_no", "kind", F.md5("text").alias("text_md5"), "number", F.array_join("tags", ",").alias("tags"), "starred", "run")


def _nodes_sql(digest: str = "md5") -> str:
    """digest: the function of a node's text, in the column text_md5."""
    section = structure.SECTION.replace(r"(?=\S)(.+)", r"(\S.*)")
    form = lambda forms: f"({[a for a, _ in forms]})[(doc_id * 5 + line_no) % {len(forms)} + 1] || CASE WHEN ({[b for _, b in forms]})[(doc_id * 5 + line_no) % {len(forms)} + 1] = 1 THEN line ELSE '' END"
    head = lambda c: f"trim(regexp_replace(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^[^가-힣0-9(\\[]*[:：]\\s*', ''), '^[^가-힣0-9(\\[]+', ''))"
    rest = lambda c: f"regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '{structure.QUESTION_NUMBER}', '')"
    asked = lambda c: f"trim(regexp_replace({rest(c)}, '{structure.QUESTION_TAGS}', ''))"
    cells = "list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> '')"
    table = lambda c: f"(contains({c}, '|') AND len({cells.replace('line', c)}) >= 2)"
    labels = structure.PART_LABELS
    so_far = "OVER (PARTITION BY doc_id, {0} ORDER BY n ROWS UNBOUNDED PRECEDING)"
    return rf"""
WITH {LINES_SQL}, formed AS (
  SELECT doc_id, line_no AS n, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN {form(TAGS)} ELSE {form(FORMS)} END, '^[\s\x{{A0}}\x{{3000}}]+|[\s\x{{A0}}\x{{3000}}]+$', '', 'g') AS line FROM lines
), marked AS (
  SELECT *, bool_or(regexp_matches(line, '^\[(질문|핵심\s*내용|신념화)\]')) OVER (PARTITION BY doc_id) AS tagged FROM formed WHERE line <> ''
), named AS (
  SELECT *, regexp_replace(regexp_extract(line, '{structure.TAG}', 1), '\s+', '', 'g') AS tag, regexp_extract(line, '{labels[0]}', 1) AS l0, regexp_extract(line, '{labels[1]}', 1) AS l1, regexp_extract(line, '{labels[2]}', 1) AS l2 FROM marked
), events AS (
  SELECT doc_id, n, line, tagged, contains(CASE WHEN tagged THEN tag ELSE l0 || l1 || l2 END, '신') AS belief,
    CASE WHEN tagged THEN CASE tag WHEN '제목' THEN 'title' WHEN '질문' THEN 'question' WHEN '쪽' THEN 'number' WHEN '' THEN '' ELSE 'label' END
      WHEN regexp_matches(line, '{structure.QUESTION_LINE}') THEN 'question' WHEN l0 || l1 || l2 <> '' THEN 'label' WHEN regexp_matches(line, '{structure.SECOND_HALF}') THEN 'skip' ELSE '' END AS event,
    trim(CASE WHEN tagged THEN regexp_extract(line, '{structure.TAG}', 2) WHEN l1 <> '' THEN regexp_extract(line, '{labels[1]}', 2) WHEN l2 <> '' THEN regexp_extract(line, '{labels[2]}', 2) ELSE '' END) AS rest FROM named
), counted AS (
  SELECT *, sum((event = 'title')::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS t FROM events WHERE event <> 'skip'
), asked AS (
  SELECT *, sum((event = 'question')::INT) {so_far.format("t")} AS q FROM counted
), heads AS (
  SELECT *, q = 0 AND NOT tagged AND event = '' AS may, regexp_matches(line, '{section}') AS numbered,
    {head("line")} <> '' AS titles FROM asked
), stops AS (
  SELECT *, min(CASE WHEN q = 0 AND NOT tagged AND (event = 'label' OR may AND numbered) THEN n END) OVER (PARTITION BY doc_id, t) AS stop,
    min(CASE WHEN may AND NOT numbered AND titles THEN n END) OVER (PARTITION BY doc_id, t) AS titled FROM heads
), without AS (
  SELECT *, may AND n < coalesce(stop, n + 1) AND n <= coalesce(titled, n) AS head FROM stops
), opened AS (
  SELECT *, coalesce(last_value(CASE WHEN event = 'label' THEN belief END IGNORE NULLS) {so_far.format("t")}, false) AS in_belief, CASE WHEN event = '' THEN line ELSE rest END AS body FROM without WHERE NOT head OR n = titled
), filled AS (
  SELECT *, q = 0 AND NOT head AND (event = '' OR event = 'label' AND rest <> '') AND CASE WHEN in_belief THEN tagged ELSE NOT {table("body")} END AS fills FROM opened
), finished AS (
  SELECT *, coalesce(min(CASE WHEN fills THEN n END) OVER (PARTITION BY doc_id, t) < max(CASE WHEN q = 0 AND event IN ('label', 'number') THEN n END) OVER (PARTITION BY doc_id, t), false) AS done FROM filled
), paged AS (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY t, CASE WHEN q = 0 THEN 1 ELSE q + done::INT END) AS page FROM finished
), segments AS (
  SELECT *, sum((event IN ('question', 'label', 'title'))::INT) {so_far.format("page")} AS segment, regexp_matches(CASE WHEN event = 'question' THEN {asked("line")} ELSE line END, '[?？]$') AS ended FROM paged
), leaving AS (
  SELECT *, NOT tagged AND event = '' AND (numbered OR regexp_matches(line, '{structure.SUBSECTION}') OR coalesce(lag(ended) OVER (PARTITION BY doc_id, page, segment ORDER BY n), false)) AS leaves FROM segments
), moded AS (
  SELECT *, sum(leaves::INT) OVER (PARTITION BY doc_id, page, segment ORDER BY n ROWS UNBOUNDED PRECEDING) AS gone,
    last_value(CASE WHEN event = 'question' THEN 'question' WHEN event = 'label' THEN CASE WHEN belief THEN 'belief' ELSE 'core' END END IGNORE NULLS) {so_far.format("page")} AS m FROM leaving
), parted AS (
  SELECT *, CASE WHEN event = 'title' OR head THEN 'title' WHEN event = 'number' THEN 'label' WHEN m = 'question' AND gone > 0 THEN 'core' ELSE coalesce(m, 'core') END AS part,
    event IN ('title', 'question', 'label', 'number') OR leaves AND gone = 1 AND m IS NOT NULL AND (m = 'core' OR m = 'question') OR leaves AND gone = 1 AND m IS NULL AS starts FROM moded
), runs AS (
  SELECT doc_id, page, n, part, CASE WHEN tagged AND event <> '' OR event = 'label' THEN rest ELSE line END AS line, sum(starts::INT) {so_far.format("page")} AS run, event = 'label' AND rest = '' AS bare FROM parted
), kinds AS (
  SELECT *, CASE WHEN part IN ('title', 'question', 'label', 'belief') THEN part WHEN {table("line")} THEN 'table' WHEN regexp_matches(line, '{section}') AND NOT regexp_matches(line, '^\d{{1,2}}\.\d') THEN 'section'
    WHEN regexp_matches(line, '{structure.SUBSECTION}') THEN 'subsection' ELSE 'content' END AS kind FROM runs WHERE NOT bare
), begun AS (
  SELECT *, CASE kind WHEN 'belief' THEN regexp_matches(line, '{structure.ITEM}') OR lag(n) OVER w IS NULL OR (NOT bool_or(regexp_matches(line, '{structure.ITEM}')) OVER (PARTITION BY doc_id, page, part, run) AND NOT regexp_matches(lag(line) OVER w, '{structure.GOES_ON}'))
    WHEN 'question' THEN lag(n) OVER w IS NULL ELSE true END AS begins FROM kinds WINDOW w AS (PARTITION BY doc_id, page, part ORDER BY n)
), islands AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, page, part ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM begun
), joined AS (
  SELECT doc_id, page, part, kind, island, min(n) AS n, min(run) AS run, arg_min(line, n) AS first, string_agg(line, ' ' ORDER BY n) AS line FROM islands GROUP BY ALL
), texts AS (
  SELECT *, {asked("first")} AS asked, substr(line, length(first) + 2) AS more, {rest("first")} AS behind, {head("line")} AS header FROM joined
)
SELECT doc_id, CAST(page AS INT) AS page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY n) AS INT) AS node_no, kind,
  {digest}(CASE kind WHEN 'question' THEN CASE WHEN length(line) > length(first) THEN trim(asked || ' ' || more) ELSE asked END WHEN 'section' THEN trim(regexp_extract(line, '{section}', 2)) WHEN 'subsection' THEN trim(regexp_extract(line, '{structure.SUBSECTION}', 1))
    WHEN 'table' THEN array_to_string({cells}, ' | ') WHEN 'title' THEN CASE WHEN trim(regexp_extract(header, '{structure.HEADER}', 1)) <> '' THEN trim(regexp_extract(header, '{structure.HEADER}', 1)) || ' (' || trim(regexp_replace(regexp_replace(regexp_extract(header, '{structure.HEADER}', 2), '\s*-\s*', '-', 'g'), '^([^.]*?\d)\s*\.\s*', '\1. ')) || ')'
      ELSE coalesce(nullif(header, ''), line) END ELSE trim(regexp_replace(line, '^●\s*', '')) END) AS text_md5,
  CASE kind WHEN 'question' THEN CAST(CAST(nullif(regexp_extract(trim(regexp_replace(first, '\s+', ' ', 'g')), '{structure.QUESTION_NUMBER}', 1), '') AS INT) AS VARCHAR) WHEN 'section' THEN regexp_extract(line, '{section}', 1) END AS number,
  CASE WHEN kind = 'question' THEN array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(behind, '{structure.QUESTION_TAGS}', 2), '[,/·]'), lambda x: trim(x)), lambda x: x <> ''), ',') END AS tags,
  CASE WHEN kind = 'question' THEN regexp_extract(behind, '{structure.QUESTION_TAGS}', 1) <> '' END AS starred, CAST(run AS BIGINT) AS run
FROM texts"""


def page_points(spark, d):
    """How many points of each kind the pages of textbook-like texts have."""
    rows = points.page_points(structure.nodes(textbook(spark, d)))
    count = lambda condition: F.count_if(condition)
    core = F.col("area") == "core"
    return rows.groupBy("doc_id", "page").agg(
        count(F.col("area") == "question").alias("questions"), count(F.col("category") == "목록").alias("lists"), count(core & ~F.col("category").isin("목록", "표")).alias("lines"),
        count(F.col("category") == "표").alias("table_rows"), count(F.col("area") == "belief").alias("beliefs"), F.sum(F.when(F.col("area") != "question", F.length("text"))).alias("characters"),
    )


def _read_and_true(spark, d):
    """Nodes of textbook-like texts, and the same with some of them lost or misread."""
    true = settled(structure.nodes(textbook(spark, d)))  # both sides, and a report's texts, are made of them
    lost = F.pmod(F.col("node_no") + F.col("doc_id"), F.lit(9)) == 4
    misread = F.when(F.pmod(F.col("node_no") * 3 + F.col("doc_id"), F.lit(5)) == 0, F.concat("text", F.lit(" x"))).otherwise(F.concat("text", F.lit(" !")))
    return true.where(~lost).withColumn("text", misread), true


def structure_comparison(spark, d):
    """Fields of true pages, and whether the pages read are right in them."""
    read, true = _read_and_true(spark, d)
    return comparison.compared_structure(read, true).select("doc_id", "page", "field", F.md5(F.coalesce("want", F.lit(""))).alias("want_md5"), "ok")


def structure_report(spark, d):
    """How much of each page is right; the text read stands for the raw one."""
    read, true = _read_and_true(spark, d)
    raw, marks = comparison.page_texts(read), true.select("doc_id").distinct().withColumn("watermark", F.lit("CLASS/the /zz"))
    rows = comparison.page_reports(read, true, raw, marks)
    return rows.select("doc_id", "page", "exact", "total", "pct", F.array_join("watermark_left", ",").alias("watermark_left"))


def _compared_sql() -> str:
    head = rf"trim(regexp_replace(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '^[^가-힣0-9(\[]*[:：]\s*', ''), '^[^가-힣0-9(\[]+', ''))"
    lesson = rf"trim(regexp_replace(regexp_replace(regexp_extract(h, '{structure.HEADER}', 2), '\s*-\s*', '-', 'g'), '^([^.]*?\d)\s*\.\s*', '\1. '))"
    both = []
    for side, rows in (("want", "true_nodes"), ("got", "read_nodes")):
        both.append(rf"""{side}_cut AS (
  SELECT *, kind IN ('section', 'subsection', 'content') AS core, coalesce(sum((kind IN ('section', 'subsection', 'content'))::INT) OVER (PARTITION BY doc_id, page, run ORDER BY node_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, {head} AS h FROM {rows}
), {side}_sections AS (
  SELECT *, CASE WHEN core THEN sum((kind = 'section' OR core AND before = 0)::INT) OVER (PARTITION BY doc_id, page ORDER BY node_no ROWS UNBOUNDED PRECEDING) END AS k FROM {side}_cut
), {side}_subs AS (
  SELECT *, CASE WHEN core THEN sum((kind = 'subsection')::INT) OVER (PARTITION BY doc_id, page, k ORDER BY node_no ROWS UNBOUNDED PRECEDING) END AS u FROM {side}_sections
), {side}_heads AS (
  SELECT doc_id, page, arg_min(CASE WHEN regexp_extract(h, '{structure.HEADER}', 1) <> '' AND trim(regexp_extract(h, '{structure.HEADER}', 1)) <> '' THEN trim(regexp_extract(h, '{structure.HEADER}', 1)) END, node_no) FILTER (kind = 'title') AS f0,
    arg_min(CASE WHEN trim(regexp_extract(h, '{structure.HEADER}', 1)) <> '' THEN {lesson} END, node_no) FILTER (kind = 'title') AS f1, arg_min(number, node_no) FILTER (kind = 'question') AS f2, arg_min(t, node_no) FILTER (kind = 'question') AS f3,
    coalesce(bool_or(starred) FILTER (kind = 'question'), false)::VARCHAR AS f4, arg_min(tags, node_no) FILTER (kind = 'question') AS f5, arg_max(t, node_no) FILTER (kind = 'label') AS f6, coalesce(max(k), 0)::VARCHAR AS f7, count(*) FILTER (kind = 'belief') AS f8 FROM {side}_subs GROUP BY ALL
), {side} AS (
  SELECT doc_id, page, unnest({list(comparison.PAGE_FIELDS)}) AS field, unnest([f0, f1, f2, f3, f4, f5, f6, f7, f8::VARCHAR]) AS value FROM {side}_heads
  UNION ALL SELECT doc_id, page, unnest([k || '. 대제목', k || '. 본문 줄 수', k || '. 소제목 수']), unnest([max(t) FILTER (kind = 'section'), (count(*) FILTER (kind = 'content' AND u = 0))::VARCHAR, (count(*) FILTER (kind = 'subsection'))::VARCHAR]) FROM {side}_subs WHERE core GROUP BY doc_id, page, k
  UNION ALL SELECT doc_id, page, CASE WHEN u = 0 THEN k || '.' ELSE k || '-' || u END || ' 본문 ' || row_number() OVER (PARTITION BY doc_id, page, k, u ORDER BY node_no), t FROM {side}_subs WHERE kind = 'content'
  UNION ALL SELECT doc_id, page, k || '-' || u || ' 소제목', t FROM {side}_subs WHERE kind = 'subsection'
  UNION ALL SELECT doc_id, page, '신념화 ' || row_number() OVER (PARTITION BY doc_id, page ORDER BY node_no), t FROM {side}_subs WHERE kind = 'belief'
)""")
    return f"""WITH true_nodes AS (SELECT *, text_md5 AS t FROM ({_nodes_sql("trim")}) n), read_nodes AS (
  SELECT * REPLACE (CASE WHEN (node_no * 3 + doc_id) % 5 = 0 THEN t || ' x' ELSE t || ' !' END AS t) FROM true_nodes WHERE (node_no + doc_id) % 9 <> 4
), {", ".join(both)}, compared AS (
  SELECT w.doc_id, w.page, w.field, w.value, {key_sql("coalesce(g.value, CASE WHEN right(w.field, 2) = ' 수' THEN '0' WHEN w.field = 'question.starred' THEN 'false' END)")} = {key_sql("w.value")} AS ok
  FROM want w LEFT JOIN got g ON g.doc_id = w.doc_id AND g.page = w.page AND g.field = w.field
)"""


_NUMBER = "CASE " + " ".join(f"WHEN e = '{word}' THEN {n}" for word, n in points.NUMBER_WORDS.items()) + " WHEN e = '' THEN 0 ELSE CAST(e AS BIGINT) END"
#: Which titles a question is about is judged by Korean keywords, so its point is counted, and the length of the others compared.
POINTS_SQL = rf"""{_compared_sql()}, lines AS (
  SELECT *, coalesce(regexp_matches(trim(lag(t) OVER (PARTITION BY doc_id, page, k, u ORDER BY node_no)), '{points.CONNECTIVE}'), false) AS goes_on FROM want_subs WHERE kind = 'content'
), islands AS (
  SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id, page, k, u ORDER BY node_no) AS island FROM lines
), joined AS (
  SELECT doc_id, page, k, u, island, string_agg(t, ' ' ORDER BY node_no) AS t, regexp_extract(string_agg(t, ' ' ORDER BY node_no), '{points.ENUMERATION}', 1) AS e FROM islands GROUP BY ALL
), subs AS (
  SELECT doc_id, page, k, list(t ORDER BY node_no) AS titles FROM want_subs WHERE kind = 'subsection' GROUP BY ALL
), core AS (
  SELECT j.*, coalesce(u = 0 AND {_NUMBER} > 0 AND len(titles) >= {_NUMBER}, false) AS is_list, titles, {_NUMBER} AS n FROM joined j LEFT JOIN subs s ON s.doc_id = j.doc_id AND s.page = j.page AND s.k = j.k
), heads AS (
  SELECT doc_id, page, arg_min(t, node_no) FILTER (kind = 'question') AS q, list(t ORDER BY node_no) FILTER (kind = 'section' AND t <> '') AS titles FROM want_subs GROUP BY ALL
), every AS (
  SELECT doc_id, page, 'questions' AS what, q || ' — ' || array_to_string(titles[:{points.OUTLINE}], ' / ') AS t FROM heads WHERE q <> '' AND len(titles) > 0
  UNION ALL SELECT doc_id, page, CASE WHEN is_list THEN 'lists' ELSE 'lines' END, CASE WHEN is_list THEN t || ': ' || array_to_string(titles[:n], ', ') ELSE t END FROM core
  UNION ALL SELECT doc_id, page, CASE kind WHEN 'table' THEN 'table_rows' ELSE 'beliefs' END, t FROM want_subs WHERE kind IN ('table', 'belief')
)
SELECT doc_id, page, count(*) FILTER (what = 'questions') AS questions, count(*) FILTER (what = 'lists') AS lists, count(*) FILTER (what = 'lines') AS lines, count(*) FILTER (what = 'table_rows') AS table_rows, count(*) FILTER (what = 'beliefs') AS beliefs,
  CAST(sum(length(t)) FILTER (what <> 'questions') AS BIGINT) AS characters FROM every GROUP BY doc_id, page"""
COMPARED_SQL = f"{_compared_sql()} SELECT doc_id, page, field, md5(coalesce(value, '')) AS want_md5, ok FROM compared"
REPORT_SQL = f"""{_compared_sql()}, texts AS (SELECT doc_id, page, string_agg(t, chr(10)) AS t FROM read_nodes WHERE kind NOT IN ('label', 'table') GROUP BY ALL)
SELECT doc_id, page, count(*) FILTER (ok) AS exact, count(*) AS total, floor(count(*) FILTER (ok) / count(*)::DOUBLE * 1000 + 0.5) / 10 AS pct,
  array_to_string(list_filter(['CLASS', 'the', 'zz'], lambda p: contains(coalesce(any_value(t), ''), p)), ',') AS watermark_left FROM compared LEFT JOIN texts USING (doc_id, page) GROUP BY doc_id, page"""


QUERIES = {
    "page_points": (page_points, POINTS_SQL),
    "structure_comparison": (structure_comparison, COMPARED_SQL),
    "structure_report": (structure_report, REPORT_SQL),
    "page_nodes": (page_nodes, _nodes_sql()),
    "align_versions": (align_versions, None),
    "consensus_lines": (consensus_lines, None),
    "matched_points": (matched_points, None),
    "joined_sentences": (joined_sentences, SENTENCES_SQL),
}
