"""Queries on batches of requests, their replies, corrections of pages, and pages continued from an earlier analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import corrections, structure
from lorespark.plans import structure as pages_
from lorespark.plans.texts import documents, key_sql
from lorespark.sources.tables import read_table, settled


def request_batches(spark, d):
    """Documents of each source as requests, in batches of 15 and 12,000 characters at most."""
    return corrections.request_batches(documents(spark, d).select("source", "doc_id", "text"), "source", ["doc_id"]).select("source", "doc_id", "batch")


BATCHES_SQL = """WITH RECURSIVE r AS (
  SELECT source, doc_id, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents
), w AS (
  SELECT source, doc_id, k, size AS chars, 1 AS n, 0 AS batch FROM r WHERE k = 1
  UNION ALL
  SELECT r.source, r.doc_id, r.k, CASE WHEN w.n >= 15 OR w.chars + r.size > 12000 THEN r.size ELSE w.chars + r.size END, CASE WHEN w.n >= 15 OR w.chars + r.size > 12000 THEN 1 ELSE w.n + 1 END,
    w.batch + (w.n >= 15 OR w.chars + r.size > 12000)::INT FROM w JOIN r ON r.source IS NOT DISTINCT FROM w.source AND r.k = w.k + 1
)
SELECT source, doc_id, CAST(batch AS INT) AS batch FROM w"""


def first_responses(spark, d):
    """Turns as requests, four to a batch; each is answered by its own text late, and by the next turn's where that is of its batch."""
    t = read_table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), "turn", "text")
    requests = corrections.request_batches(t, "group_id", ["turn"], most_rows=4, most_chars=1 << 30).select("group_id", "batch", F.col("turn").alias("request_id"), "text")
    own = requests.select("group_id", "batch", (F.col("request_id") * 2 + 1).alias("ord"), "request_id", F.col("text").alias("answer"))
    other = requests.select("group_id", "batch", (F.col("request_id") * 2).alias("ord"), (F.col("request_id") - 1).alias("request_id"), F.when(F.col("request_id") % 3 == 0, "").otherwise(F.col("text")).alias("answer"))
    found = corrections.first_responses(requests.drop("text"), own.unionByName(other), F.col("answer") != "")
    return found.select("group_id", "batch", "request_id", F.md5("answer").alias("answer_md5"))


RESPONSES_SQL = """WITH r AS (
  SELECT conv_id AS group_id, turn AS request_id, text, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS INT) AS batch FROM conversations
), a AS (
  SELECT group_id, batch, request_id * 2 + 1 AS ord, request_id, text AS answer FROM r
  UNION ALL SELECT group_id, batch, request_id * 2, request_id - 1, CASE WHEN request_id % 3 = 0 THEN '' ELSE text END FROM r
), f AS (SELECT group_id, batch, request_id, arg_min(answer, ord) AS answer FROM a WHERE answer <> '' GROUP BY ALL)
SELECT group_id, batch, request_id, md5(answer) AS answer_md5 FROM r LEFT JOIN f USING (group_id, batch, request_id)"""


def _proposed(spark, d):
    """Turns as pages of their conversation, with changes of up to four of their words proposed; replies by conversation."""
    t = read_table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    words = F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w.rlike("^[!-~]+$"))
    word = lambda k: F.get("words", F.lit(k))
    put = (F.replace(word(0), F.lit("e"), F.lit("c")), F.concat(word(1), F.lit("xyz..")), F.translate(word(2), "aO", "40"), F.translate(word(2), "os", "05"), F.lit(" "), word(4))
    raw = (word(0), word(1), word(2), word(2), word(3), F.upper(word(4)))
    rows = t.withColumn("words", words).select("group_id", "page", F.posexplode(F.array(*(F.struct(a.alias("raw"), b.alias("corrected")) for a, b in zip(raw, put, strict=True)))).alias("ord", "c"))
    changes = rows.select("group_id", "ord", "page", "c.raw", "c.corrected", F.when((F.col("page") + F.col("ord")) % 6 == 0, "low").alias("confidence"), F.lit("").alias("reason"))
    replies = t.select("group_id").distinct().select("group_id", (F.col("group_id") % 7 != 0).alias("configured"), F.when(F.col("group_id") % 5 == 0, "timeout").alias("error"))
    return t, replies, changes


def corrected_pages(spark, d):
    """Turns with the proposed changes applied where they are judged so."""
    made = corrections.corrected_pages(*_proposed(spark, d))
    told = F.array_join(F.transform("outcomes", lambda o: F.concat_ws(":", o["ord"].cast("string"), o["outcome"], o["at"].cast("string"))), ",")
    return made.select("group_id", "page", "status", F.md5("final").alias("final_md5"), told.alias("outcomes"))


def correction_status(spark, d):
    return corrections.correction_status(corrections.corrected_pages(*_proposed(spark, d)))


_KEYS = key_sql("raw"), key_sql("corrected")
_LEVEL = f"levenshtein({_KEYS[0]}, {_KEYS[1]}) / greatest(length({_KEYS[0]}), length({_KEYS[1]}), 1)::DOUBLE"
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_TRIED = f"""WITH RECURSIVE t AS (
  SELECT conv_id AS group_id, CAST(turn + 1 AS INT) AS page, coalesce(text, '') AS text, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: regexp_full_match(w, '[!-~]+')) AS w FROM conversations
), p AS (
  SELECT group_id, page, unnest([w[1], w[2], w[3], w[3], w[4], upper(w[5])]) AS raw, unnest([replace(w[1], 'e', 'c'), w[2] || 'xyz..', translate(w[3], 'aO', '40'), translate(w[3], 'os', '05'), ' ', w[5]]) AS corrected, unnest(range(6)) AS ord FROM t
), j AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, page ORDER BY ord) AS k, array_to_string(list_transform(string_split(raw, ''), lambda c: regexp_escape(c)), '\\s*') AS pattern,
    CASE WHEN {_KEYS[0]} = '' OR trim(corrected) = '' THEN 'rejected' WHEN {_KEYS[0]} = {_KEYS[1]} THEN 'applied'
      WHEN length({_KEYS[1]}) - length({_KEYS[0]}) > greatest(3.0, length({_KEYS[0]}) * 0.25::DOUBLE) THEN 'rejected' WHEN {_LEVEL} > 0.45::DOUBLE THEN 'rejected'
      WHEN {_DIGITS.format("raw")} <> {_DIGITS.format("corrected")} AND {_DIGITS.format("CASE WHEN regexp_matches(raw, '[0-9]') THEN translate(raw, 'lI|OoSBZg', '111005829') ELSE raw END")} <> {_DIGITS.format("corrected")} THEN 'uncertain'
      WHEN (page + ord) % 6 = 0 THEN 'uncertain' WHEN {_LEVEL} > 0.3::DOUBLE THEN 'uncertain' ELSE 'applied' END AS verdict
  FROM p WHERE raw IS NOT NULL AND corrected IS NOT NULL AND group_id % 7 <> 0 AND group_id % 5 <> 0
), s AS (
  SELECT group_id, page, 0 AS k, 0 AS cursor, []::STRUCT(a INT, b INT, put VARCHAR)[] AS spans, []::VARCHAR[] AS told FROM t
  UNION ALL
  SELECT group_id, page, k, CASE WHEN hit AND verdict = 'applied' THEN b ELSE cursor END, CASE WHEN hit AND verdict = 'applied' THEN list_append(spans, {{'a': a, 'b': b, 'put': corrected}}) ELSE spans END,
    list_append(told, ord || ':' || CASE WHEN hit THEN verdict || ':' || a ELSE 'missing' END)
  FROM (
    SELECT *, a >= 0 AND len(list_filter(spans, lambda x: a < x.b AND x.a < b)) = 0 AS hit FROM (
      SELECT s.*, j.k AS nk, j.ord, j.verdict, j.corrected, CAST(CASE WHEN behind <> '' THEN s.cursor + strpos(substr(text, s.cursor + 1), behind) - 1 WHEN front <> '' THEN strpos(text, front) - 1 ELSE -1 END AS INT) AS a,
        CAST(a + length(CASE WHEN behind <> '' THEN behind ELSE front END) AS INT) AS b
      FROM s JOIN (SELECT * FROM j) j ON j.group_id = s.group_id AND j.page = s.page AND j.k = s.k + 1 JOIN t ON t.group_id = s.group_id AND t.page = s.page,
        LATERAL (SELECT regexp_extract(substr(t.text, s.cursor + 1), j.pattern) AS behind, regexp_extract(t.text, j.pattern) AS front) f
    ) q
  ) h
), e AS (
  SELECT group_id, page, arg_max(spans, k) AS spans, arg_max(told, k) AS told FROM s GROUP BY ALL
), done AS (
  SELECT t.group_id, t.page, CASE WHEN NOT bool_or(regexp_matches(text, '\\S')) OVER (PARTITION BY t.group_id) THEN 'empty' WHEN t.group_id % 7 = 0 THEN 'unavailable' WHEN t.group_id % 5 = 0 THEN 'failed' ELSE 'ai' END AS status, told,
    list_reduce(list_prepend({{'a': 0, 'b': 0, 'put': text}}, list_reverse_sort(spans)), lambda x, y: {{'a': 0, 'b': 0, 'put': substr(x.put, 1, y.a) || y.put || substr(x.put, y.b + 1)}}).put AS final
  FROM t JOIN e ON e.group_id = t.group_id AND e.page = t.page
)"""
_TRIED = _TRIED.replace("SELECT group_id, page, k, CASE WHEN hit", "SELECT group_id, page, nk, CASE WHEN hit")
CORRECTED_SQL = f"{_TRIED} SELECT group_id, page, status, md5(final) AS final_md5, array_to_string(told, ',') AS outcomes FROM done"
_COUNTED = "CAST(sum(len(list_filter(told, lambda x: contains(x, '{0}') OR contains(x, '{1}')))) AS BIGINT)"
STATUS_SQL = f"""{_TRIED}, c AS (
  SELECT group_id, max(status) AS status, count(*) AS pages, {_COUNTED.format("applied", "applied")} AS applied, {_COUNTED.format("uncertain", "uncertain")} AS uncertain, {_COUNTED.format("rejected", "missing")} AS rejected FROM done GROUP BY group_id
)
SELECT *, CASE WHEN status = 'empty' THEN '' WHEN status <> 'ai' THEN 'AI 분석을 사용할 수 없어 기본 분석으로 생성했습니다. (OCR 원문을 그대로 사용합니다)' WHEN applied + uncertain > 0 THEN 'AI 문맥 보정 ' || applied || '곳 적용' || CASE WHEN uncertain > 0 THEN ' · 확인 필요 ' || uncertain || '곳' ELSE '' END
  ELSE 'AI가 확인한 결과 고칠 OCR 오류가 없습니다.' END AS message FROM c"""


def continued_pages(spark, d):
    """Pages of textbook-like texts matched with an analysis in which some pages are missing, moved or without a question."""
    n = structure.nodes(pages_.textbook(spark, d))
    p = n.groupBy("doc_id", "page").agg(F.max(F.when(F.col("kind") == "question", F.md5("text"))).alias("question"), F.max(F.when(F.col("kind") == "label", F.col("text"))).alias("page_label"))
    p = settled(p)  # the analysis and its two readings are made of it
    old = p.where("page % 3 <> 0").select("doc_id", (F.col("page") + F.col("doc_id") % 2).cast("int").alias("page"), F.when(F.col("page") % 4 != 1, F.col("question")).alias("question"), F.concat(F.lit("p"), "page").alias("page_label"))
    old = old.withColumn("unverified", F.array("page_label"))
    return structure.continued_pages(p, old).select("doc_id", "page", "from_page", F.md5("page_label").alias("label_md5"), F.array_join("unverified", ",").alias("unverified"))


CONTINUED_SQL = f"""WITH nodes AS ({pages_.QUERIES["page_nodes"][1]}), p AS (
  SELECT doc_id, page, max(CASE WHEN kind = 'question' THEN text_md5 END) AS question, max(CASE WHEN kind = 'label' THEN text_md5 END) AS label FROM nodes GROUP BY ALL
), old AS (
  SELECT doc_id, CAST(page + doc_id % 2 AS INT) AS page, CASE WHEN page % 4 <> 1 THEN question END AS question, 'p' || page AS label FROM p WHERE page % 3 <> 0
), asked AS (SELECT doc_id, question, min(page) AS page, arg_min(label, page) AS label FROM old WHERE question IS NOT NULL GROUP BY ALL)
SELECT p.doc_id, p.page, coalesce(a.page, o.page) AS from_page, coalesce(nullif(p.label, md5('')), md5(coalesce(a.label, o.label))) AS label_md5, coalesce(a.label, o.label, '') AS unverified
FROM p LEFT JOIN asked a ON a.doc_id = p.doc_id AND a.question = p.question LEFT JOIN old o ON o.doc_id = p.doc_id AND o.page = p.page"""


QUERIES = {
    "request_batches": (request_batches, BATCHES_SQL),
    "first_responses": (first_responses, RESPONSES_SQL),
    "corrected_pages": (corrected_pages, CORRECTED_SQL),
    "correction_status": (correction_status, STATUS_SQL),
    "continued_pages": (continued_pages, CONTINUED_SQL),
}
