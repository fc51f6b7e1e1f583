"""Queries on watermarks: lines of documents with printed marks put among them, what is learnt of the marks, and the cleaning's log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import cleanup as c
from lorespark.operators import watermarks as w
from lorespark.plans.texts import LINES_SQL, lines

#: What stands before and behind a document's lines in turn.
MARKS = (
    ("", ""), ("홍길동/2025-01-01 09:00 ", ""), ("", " 홍길동"), ("", ""), ("국군의 / 김철수 /", ""), ("나라 10:30 ", " 상사 나라"), ("", " 2025-01-01"), ("", ""),
    ("홍길동은 ", ""), ("국가 09:00 국민 2025 년 ", ""), ("", " 2025-12-31 23:59"), ("홍길동 김철수 ", " /상사/"), ("", ""),
)


def printed(spark, d):
    """``doc_id, page, kind, index, line_no, line``: every 20 lines of a document are a page."""
    at = (F.pmod(F.col("doc_id") * 3 + F.col("line_no"), F.lit(len(MARKS))) + 1).cast("int")
    mark = lambda k: F.element_at(F.array(*(F.lit(m[k]) for m in MARKS)), at)
    return lines(spark, d).select(
        "doc_id", F.floor(F.col("line_no") / 20).cast("int").alias("page"), F.lit("page").alias("kind"), F.lit(0).alias("index"), F.pmod("line_no", F.lit(20)).alias("line_no"), F.concat(mark(0), "line", mark(1)).alias("line")
    )


def learned_watermarks(spark, d):
    """The pieces of the marks of each document, and on how many pages each was seen."""
    return w.learned_pieces(printed(spark, d)).select("doc_id", "kind", "value", "pages")


def watermark_log(spark, d):
    """What is removed from each line as a watermark, and what is left of the line."""
    rows = w.marked_lines(printed(spark, d))
    told = F.array_join(F.transform("removed", lambda x: F.concat(x["from"], F.lit("|"), x["why"])), ";")
    return rows.select("doc_id", "page", "line_no", F.md5("text").alias("text_md5"), told.alias("removed"))


def cleaning_reasons(spark, d):
    """How many lines of each page go, by reason, and how many entries the log has by type."""
    rows = w.cleaned_document(printed(spark, d))
    told = F.concat(F.array(F.coalesce("dropped", F.lit("kept"))), F.transform("log", lambda e: F.concat(F.lit("log:"), e["type"])))
    return rows.select("doc_id", F.explode(told).alias("what")).groupBy("doc_id", "what").agg(F.count("*").alias("n"))


_PRINTED = f"""{LINES_SQL}, printed AS (
  SELECT doc_id, line_no // 20 AS page, line_no % 20 AS line_no, ({[a for a, _ in MARKS]})[(doc_id * 3 + line_no) % {len(MARKS)} + 1] || line || ({[b for _, b in MARKS]})[(doc_id * 3 + line_no) % {len(MARKS)} + 1] AS line FROM lines
)"""
_IS_CHAIN = rf"(contains({{0}}, '/') AND (regexp_matches({{0}}, '{c.DATE}') OR regexp_matches({{0}}, '\d{{{{1,2}}}}\s*:\s*\d{{{{2}}}}') OR regexp_matches({{0}}, '^/|/$')))".replace(c.DATE, c.DATE.replace("{", "{{").replace("}", "}}"))
_MARKS = rf"""marks AS (
  SELECT doc_id, page, line_no, unnest(range(len(m))) AS place, unnest(m) AS m, unnest(chain) AS chain FROM (
    SELECT *, list_concat(a, b) AS m, list_concat(list_transform(a, lambda x: true), list_transform(b, lambda x: false)) AS chain FROM (
      SELECT doc_id, page, line_no, list_filter(list_transform(regexp_extract_all(line, '{c.SLASH_CHAIN}'), lambda x: trim(x)), lambda x: {_IS_CHAIN.format("x")}) AS a, regexp_extract_all(line, '{c.DATE_TIME}') AS b FROM printed
    ) e
  ) f
), pieces AS (
  SELECT doc_id, page, line_no, place, unnest(v).kind AS kind, unnest(v).value AS value FROM (
    SELECT *, list_concat(list_transform(list_filter(regexp_split_to_array(m, '[/\s]+'), lambda x: chain AND regexp_matches(x, '{w.NAME}')), lambda x: {{'kind': 'word', 'value': x}}),
      list_transform(list_filter(list_append(regexp_extract_all(m, '\d{{2,}}'), regexp_replace(regexp_extract(m, '{w.CLOCK}'), '\s+', '', 'g')), lambda x: x <> ''), lambda x: {{'kind': 'digits', 'value': x}}),
      list_transform(regexp_extract_all(m, '{c.DATE}'), lambda x: {{'kind': 'date', 'value': regexp_replace(x, '\s+', '', 'g')}}), [{{'kind': 'sample', 'value': m}}]) AS v FROM marks
  ) g
), seen AS (
  SELECT doc_id, kind, value, count(DISTINCT page) AS pages, min({{'page': page, 'line_no': line_no, 'place': place}}) AS first FROM pieces GROUP BY ALL
), learnt AS (
  SELECT * FROM seen
  QUALIFY kind <> 'sample' OR row_number() OVER (PARTITION BY doc_id, kind ORDER BY first, value) <= {w.SAMPLES}
)"""
LEARNED_SQL = f"WITH {_PRINTED}, {_MARKS} SELECT doc_id, kind, value, pages FROM learnt"

_BARE = "regexp_replace({0}, '^[/|]+|[/|]+$', '', 'g')"
_GOES = f"({_IS_CHAIN} OR len(list_intersect(regexp_split_to_array(trim({{0}}), '[/\\s]+'), words)) > 0) AND trim({{0}}) <> ''"
_MARK = "coalesce(contains({0}, '/') OR list_contains(words, replace({0}, '/', '')) OR list_contains(digits, {0}), false)"
_NAMED = f"list_contains(words, {_BARE})"
_told = lambda found, why: f"list_transform({found}, lambda x: trim(x) || '|{why}')"
#: The marks put among the lines begin with no word of a sentence that is not learnt, so no chain keeps its first word.
LOG_SQL = rf"""WITH {_PRINTED}, {_MARKS}, names AS (
  SELECT p.doc_id, list(DISTINCT token) AS tokens FROM printed p, unnest(regexp_split_to_array(line, '\s+')) t(token) WHERE contains(token, '홍길동') GROUP BY p.doc_id
), dictionary AS (
  SELECT doc_id, list(value) FILTER (kind = 'word') AS words, list(value) FILTER (kind = 'digits') AS digits, list(value) FILTER (kind = 'date') AS dates FROM learnt GROUP BY doc_id
), a AS (
  SELECT p.*, coalesce(words, []) AS words, coalesce(digits, []) AS digits, coalesce(dates, []) AS dates, CASE WHEN list_contains(tokens, '홍길동은') THEN ['홍길동'] ELSE [] END AS protected,
    regexp_split_to_array(line, '{c.SLASH_CHAIN}') AS between, regexp_extract_all(line, '{c.SLASH_CHAIN}') AS found FROM printed p LEFT JOIN dictionary USING (doc_id) LEFT JOIN names USING (doc_id)
), b AS (
  SELECT *, array_to_string(list_transform(list_zip(between, found), lambda p: p[1] || CASE WHEN p[2] IS NULL THEN '' WHEN {_GOES.format("p[2]")} THEN ' ' ELSE p[2] END), '') AS t1, {_told(f"list_filter(found, lambda x: {_GOES.format('x')})", c.WHY_CHAIN)} AS r1 FROM a
), d AS (
  SELECT *, regexp_replace(t1, '{c.DATE_TIME}', ' ', 'g') AS t2, list_concat(r1, {_told(f"regexp_extract_all(t1, '{c.DATE_TIME}')", c.WHY_TIME)}) AS r2 FROM b
), e AS (
  SELECT *, array_to_string(list_transform(list_zip(regexp_split_to_array(t2, '{c.DATE}'), regexp_extract_all(t2, '{c.DATE}')), lambda p: p[1] || CASE WHEN p[2] IS NULL THEN '' WHEN list_contains(dates, regexp_replace(p[2], '\s+', '', 'g')) THEN ' ' ELSE p[2] END), '') AS t3,
    list_concat(r2, {_told(rf"list_filter(regexp_extract_all(t2, '{c.DATE}'), lambda x: list_contains(dates, regexp_replace(x, '\s+', '', 'g')))", c.WHY_DATE)}) AS r3 FROM d
), f AS (
  SELECT *, CASE WHEN len(r3) > 0 THEN regexp_replace(t3, '\b\d{{1,2}}\s*:\s*\d{{2}}\b', ' ', 'g') ELSE t3 END AS t4, CASE WHEN len(r3) > 0 THEN list_concat(r3, {_told(r"regexp_extract_all(t3, '\b\d{1,2}\s*:\s*\d{2}\b')", c.WHY_CLOCK)}) ELSE r3 END AS r4 FROM e
), g AS (
  SELECT *, list_filter(regexp_split_to_array(t4, '\s+'), lambda x: x <> '') AS k FROM f
), h AS (
  SELECT *, list_transform(range(1, len(k) + 1), lambda i: {_NAMED.format("k[i]")} AND ({_BARE.format("k[i]")} <> k[i] OR len(k) = 1 OR (i > 1 AND {_MARK.format("k[i - 1]")} AND NOT {_NAMED.format("k[i - 1]")}) OR (i < len(k) AND {_MARK.format("k[i + 1]")})
    OR (NOT list_contains(protected, {_BARE.format("k[i]")}) AND NOT regexp_matches({_BARE.format("k[i]")}, '{c.PARTICLE_TAIL}')))) AS gone FROM g
), i AS (
  SELECT *, list_transform(list_filter(list_zip(k, gone), lambda p: NOT p[2]), lambda p: p[1]) AS k2, list_concat(r4, {_told("list_transform(list_filter(list_zip(k, gone), lambda p: p[2]), lambda p: p[1])", c.WHY_WORD)}) AS r5 FROM h
), j AS (
  SELECT *, list_transform(range(1, len(k2) + 1), lambda i: regexp_matches(k2[i], '^[0-9:]{{2,5}}$') AND list_contains(digits, k2[i]) AND (contains(k2[i], ':')
    OR ((i > 1 AND regexp_matches(k2[i - 1], '[가-힣]$')) OR (i < len(k2) AND regexp_matches(k2[i + 1], '^[가-힣]'))) AND NOT (i < len(k2) AND regexp_matches(coalesce(k2[i + 1], ''), '{c.UNIT_WORD}')))) AS lost FROM i
)
SELECT doc_id, CAST(page AS INT) AS page, CAST(line_no AS INT) AS line_no, md5(array_to_string(list_transform(list_filter(list_zip(k2, lost), lambda p: NOT p[2]), lambda p: p[1]), ' ')) AS text_md5,
  array_to_string(list_concat(r5, {_told("list_transform(list_filter(list_zip(k2, lost), lambda p: p[2]), lambda p: p[1])", c.WHY_NUMBER)}), ';') AS removed FROM j"""


QUERIES = {
    "learned_watermarks": (learned_watermarks, LEARNED_SQL),
    "watermark_log": (watermark_log, LOG_SQL),
    "cleaning_reasons": (cleaning_reasons, None),
}
