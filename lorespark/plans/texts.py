"""Queries on texts, each with its SQL: ``documents`` stand for study materials, their lines for recognised lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import similarity as s
from lorespark.functions import text as t
from lorespark.operators import cleanup as c
from lorespark.sources.tables import read_table

#: White space and punctuation that a key leaves out, for RE2.
_CLASS = r"""[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}.,!?;:''"“”‘’`~·•…()\[\]{}<>《》「」『』\-_=+*/\\|]+"""


def key_sql(column: str) -> str:
    return f"regexp_replace(lower(coalesce({column}, '')), '{_CLASS}', '', 'g')"


def grams_sql(table: str, id_column: str, key: str, as_: str) -> str:
    """CTE rows (id, gram, occ) of the bigrams of a key, numbered among equals."""
    return f"""{as_} AS (SELECT id, gram, row_number() OVER (PARTITION BY id, gram ORDER BY i) AS occ FROM (
  SELECT {id_column} AS id, i, substr(k, i, 2) AS gram FROM (SELECT {id_column}, {key} AS k FROM {table}), unnest(range(1, length(k))) u(i)))"""


LINES_SQL = "lines AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS a FROM documents))"


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The texts; dealt anew where the files give fewer partitions than there are cores, as one row group does."""
    t, cores = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source"), spark.sparkContext.defaultParallelism
    return t if t.rdd.getNumPartitions() >= cores else t.repartition(cores)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return c.lines_of(documents(spark, d))


#: Beginnings that lines get in turn, so that Korean rules, marks and bullets meet the tables' lines.
BEGINNINGS = (
    "", "• ", "― ", "가ㆍ나 ", "세포막이란 ", "그 때문에 ", "보호하는 역할 ", "★ 반드시 ", "예를 들어 ", "그것보다 ", "먼저 ", "사이에 위치한 ", "‘핵심 용어’ ", "ㄱㄴㄷㅏㅏ", "한글은aB ", "1) ", "",
)
MARKED_SQL = f"{LINES_SQL}, marked AS (SELECT doc_id, line_no, {list(BEGINNINGS)}[(doc_id + line_no) % {len(BEGINNINGS)} + 1] || line AS line FROM lines)"


def marked_lines(spark: SparkSession, d: str) -> DataFrame:
    beginning = F.element_at(F.array(*map(F.lit, BEGINNINGS)), (F.pmod(F.col("doc_id") + F.col("line_no"), F.lit(len(BEGINNINGS))) + 1).cast("int"))
    return lines(spark, d).withColumn("line", F.concat(beginning, "line"))


def normalize_text(spark, d):
    keyed = documents(spark, d).select("doc_id", t.normalize_text(F.col("text")).alias("key"))
    return keyed.select("doc_id", F.md5("key").alias("key_md5"), F.length("key").alias("key_length"))


def djb2_hash(spark, d):
    return documents(spark, d).select("doc_id", t.hash_string(F.col("text")).alias("hash"))


def content_hash_changed(spark, d):
    """Documents whose stored hash (here: of the text without its last character) is out of date, by source."""
    old = t.hash_string(F.when(F.col("doc_id") % 3 == 0, F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text")))
    return documents(spark, d).where(t.hash_string(F.col("text")) != old).groupBy("source").agg(F.count("*").alias("changed"))


_HASH_SQL = "lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda x: CASE WHEN x = '' THEN NULL ELSE ord(x)::BIGINT END)), lambda h, x: CASE WHEN x IS NULL THEN h ELSE (h * 33 + x) & 4294967295 END), 36)) || ':' || length({0})"


def dedup_norm_first(spark, d):
    """Lines that appear for the first time, by their key, in (document, line) order; counted by document.

    Only keys and places are shuffled, pre-aggregated, so that a line of very many documents is no hot key.
    """
    rows = lines(spark, d).select("doc_id", "line_no", t.normalize_text(F.col("line")).alias("key")).where("key <> ''")
    firsts = rows.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    return firsts.groupBy("first.doc_id").agg(F.count("*").alias("new_lines"))


def sentence_split(spark, d):
    return documents(spark, d).select("doc_id", t.split_sentences(F.col("text")).alias("a")).select("doc_id", F.size("a").alias("sentences"), F.length(F.get("a", F.lit(0))).alias("first_length"))


def meaningful_filter(spark, d):
    return lines(spark, d).where(t.is_meaningful(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("kept"))


def category_rules(spark, d):
    return marked_lines(spark, d).where("line <> ''").groupBy(t.category_of(F.col("line")).alias("category")).agg(F.count("*").alias("n"))


def importance_scores(spark, d):
    return marked_lines(spark, d).where("line <> ''").groupBy(t.importance_of(F.col("line")).alias("importance")).agg(F.count("*").alias("n"))


def line_roles(spark, d):
    role = F.when(t.is_bullet(F.col("line")), "bullet").when(t.is_heading(F.col("line")), "heading").when(t.ends_sentence(F.col("line")), "sentence").otherwise("open")
    return lines(spark, d).where("trim(line) <> ''").groupBy("doc_id", role.alias("role")).agg(F.count("*").alias("n"))


_END = r"[.!?。]$|[다요음함임됨][.)]?$|\)$"
_ON = "(은|는|이|가|을|를|에|의|와|과|고|며|서|로|으로|에서|하여|되어|,|·|및)$"
_BULLET = r"^\s*([-*•·▪︎◦○●■□▶▷→]|\d+[.)]|[①-⑳]|[가-하][.)])"
_HEADING_SQL = rf"""(trim(line) <> '' AND length(trim(line)) <= 24 AND NOT regexp_matches(trim(line), '^[-*•·▪︎◦○●→]') AND NOT regexp_matches(trim(line), '{_END}')
  AND NOT (regexp_matches(trim(line), '{_ON}')) AND (regexp_matches(trim(line), '{t.HEADING_START}') OR NOT regexp_matches(trim(line), '\s.*\s.*\s')))"""


def heading_carry_forward(spark, d):
    """Every line with the last heading above it; counted per heading."""
    above = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(spark, d).where("trim(line) <> ''").withColumn("is_heading", t.is_heading(F.col("line")))
    rows = rows.withColumn("heading", F.last(F.when(F.col("is_heading"), F.trim("line")), ignorenulls=True).over(above))
    return rows.where("not is_heading").groupBy("doc_id", "heading").agg(F.count("*").alias("lines"))


def join_lines_islands(spark, d):
    """Lines that do not end a sentence are joined with the next ones: number and length of the joined lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(spark, d).where("trim(line) <> ''").withColumn("begins", F.coalesce(t.ends_sentence(F.lag("line").over(order)), F.lit(True)))
    rows = rows.withColumn("island", F.sum(F.col("begins").cast("int")).over(order))
    joined = rows.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    joined = joined.select("doc_id", F.array_join(F.transform("parts", lambda p: p["line"]), " ").alias("text"))
    return joined.groupBy("doc_id").agg(F.count("*").alias("joined"), F.max(F.length("text")).alias("longest"))


def bullet_normalize(spark, d):
    """Lines that the normal form of bullets changes, and their digest."""
    rows = marked_lines(spark, d).withColumn("clean", c.normalize_bullets(F.col("line"))).where("clean <> line")
    return rows.select("doc_id", "line_no", F.md5("clean").alias("clean_md5"))


def page_number_filter(spark, d):
    """Short numeric names: which of nations' and suppliers' last words and which of the lines are page numbers."""
    names = read_table(spark, d, "supplier").select(F.concat(F.lit("p "), (F.col("s_suppkey") % 2000).cast("string")).alias("line"))
    return names.union(lines(spark, d).select("line")).where(c.is_page_number(F.col("line"))).groupBy("line").agg(F.count("*").alias("n"))


def datetime_watermark(spark, d):
    """Printed date-times and slash chains are taken off lines; here the order's stamp is printed in the middle of its
    priority, and for some orders names and slashes stand before it (the word before a slash is part of the chain)."""
    stamp = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "/홍길동/국어/").otherwise(""), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    rows = read_table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", F.substring("o_orderpriority", 1, 3), stamp, F.substring("o_orderpriority", 4, 20)).alias("line"))
    return rows.select("o_orderkey", c.strip_printed_marks(F.col("line")).alias("clean"))


def noise_reason(spark, d):
    return marked_lines(spark, d).groupBy(F.coalesce(c.noise_reason(F.col("line")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def text_quality(spark, d):
    return documents(spark, d).select("doc_id", F.round(c.text_quality(F.col("text")), 6).alias("quality"))


def lexicon_counts(spark, d):
    return c.lexicon(lines(spark, d))


def cleanup_log_counts(spark, d):
    """What cleaning does to each source's lines: dropped as noise or page number, bullets changed, kept."""
    line = F.col("line")
    kind = F.when(c.noise_reason(line).isNotNull(), "noise").when(c.is_page_number(line), "pageNumber").when(c.normalize_bullets(line) != line, "bullet").otherwise("kept")
    joined = c.lines_of(documents(spark, d)).join(documents(spark, d).select("doc_id", "source"), "doc_id")
    return joined.groupBy("source", kind.alias("type")).agg(F.count("*").alias("n"))


def repeated_line_df(spark, d):
    """Lines by the number of documents that have them, three or more."""
    rows = lines(spark, d).where("line <> ''").groupBy("line").agg(F.count_distinct("doc_id").alias("documents")).where("documents >= 3")
    return rows.select(F.md5("line").alias("line_md5"), "documents")


def keyword_repeat_count(spark, d):
    """In how many lines of its document each line's first long word occurs again."""
    rows = lines(spark, d).where("line <> ''").withColumn("word", F.regexp_extract("line", "([A-Za-z]{6,})", 1))
    other = rows.select(F.col("doc_id").alias("_d"), F.col("line_no").alias("_n"), F.col("line").alias("_line"))
    again = rows.where("word <> ''").join(other, (F.col("doc_id") == F.col("_d")) & (F.col("line_no") != F.col("_n")) & F.contains("_line", F.col("word")))
    return again.groupBy("doc_id", "line_no").agg(F.count("*").alias("repeats"))


def bigram_dice_pairs(spark, d):
    """Pairs of benchmark items whose texts have a Dice similarity of 0.5 or more."""
    pairs = s.similar_pairs(read_table(spark, d, "benchmark"), 0.5, "item_id")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def containment_grounding(spark, d):
    """How much of each benchmark item's bigrams the assistant turns of each conversation contain; every item has a row."""
    items = read_table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("item"))
    said = read_table(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("context_id"), F.col("text").alias("context"))
    shares = s.contained_share(items, said)
    return shares.select(F.col("id").alias("item_id"), F.col("context_id").alias("conv_id"), F.round("contained", 6).alias("contained"))


def excerpt_in_context(spark, d):
    """Benchmark items of three characters or more that occur in documents, by normalised text.

    Candidates meet on the item's beginning, 24 characters or, if it is shorter, all of it; so items are not compared
    with every document. The lengths of the beginnings are 22 at most.
    """
    items = read_table(spark, d, "benchmark").select("item_id", t.normalize_text(F.col("text")).alias("item")).where(F.length("item") >= 3)
    items = items.withColumn("piece", F.substring("item", 1, 24))
    lengths = sorted(r.n for r in items.select(F.length("piece").alias("n")).distinct().collect())
    keyed = documents(spark, d).select("doc_id", t.normalize_text(F.col("text")).alias("key"))
    parts = F.array(*(s.pieces_of_key(F.col("key"), n) for n in lengths)) if lengths else F.array().cast("array<array<string>>")
    pieces = keyed.select("doc_id", F.explode(F.array_distinct(F.flatten(parts))).alias("piece"))
    candidates = pieces.join(items, "piece").drop("piece")
    # Only documents that are candidates are brought to their key again.
    found = documents(spark, d).select("doc_id", "text").join(candidates, "doc_id").where(F.contains(t.normalize_text(F.col("text")), F.col("item")))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


def levenshtein_ascii(spark, d):
    """Edit distances between parts' names and the name of the part before."""
    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = read_table(spark, d, "part").withColumn("before", before).where("before is not null")
    return rows.select("p_partkey", F.levenshtein("p_name", "before").alias("distance"))


def cer_report(spark, d):
    """Character error rates of part types against their first word upper-cased, by brand."""
    truth, read = F.col("p_type"), F.concat(F.col("p_type"), F.substring("p_name", 1, 3))
    rate = F.levenshtein(read, truth) / F.greatest(F.length(truth), F.lit(1))
    return read_table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.round(F.avg(rate), 6).alias("cer"), F.count_if(read == truth).alias("exact"))


def term_parse_lines(spark, d):
    """Lines that read as a term and its definition, the first of each term in a document."""
    rows = lines(spark, d).withColumn("pair", t.parse_term(F.col("line"))).where("pair is not null").withColumn("key", t.normalize_text(F.col("pair.term")))
    firsts = s.first_by_key(rows.where(F.length("pair.term") <= 40), F.col("key"), ["line_no"], ["doc_id"])
    return firsts.select("doc_id", "line_no", F.length("pair.term").alias("term_length"), F.length("pair.definition").alias("definition_length"))


def table_rows(spark, d):
    """Lines with two cells or more between bars, in runs of neighbours: one table each."""
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines(spark, d).withColumn("cells", F.size(cells)).where((F.instr("line", "|") > 0) & (F.col("cells") >= 2))
    rows = rows.withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    return rows.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("rows"), F.sum("cells").alias("cells")).drop("island")


def emphasis_terms(spark, d):
    """Quoted terms of 2 to 30 characters in each line, once per document, with the number of lines that have them."""
    terms = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[‘'“\"]([^’'”\"]{2,30})[’'”\"]"), 1))).alias("term")
    return marked_lines(spark, d).select("doc_id", terms).groupBy("doc_id", "term").agg(F.count("*").alias("lines"))


def truncate_escape(spark, d):
    return read_table(spark, d, "pages").select("page_id", t.truncate(F.col("url"), 24).alias("short"), F.md5(t.escape_html(F.col("html"))).alias("escaped_md5"))


def secret_guard(spark, d):
    """Documents with something that looks like a key or token: none of it may be stored as a setting."""
    return documents(spark, d).where(F.col("text").rlike(r"(?i)(api[_-]?key|token|secret)\s*[=:]\s*\"?[A-Za-z0-9_-]{16,}")).select("doc_id")


def time_ago(spark, d):
    """Age of each order an hour after the last one, in words' units; a date where it is over 30 days."""
    orders = read_table(spark, d, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    last = orders.agg(F.max("ms")).first()[0] or 0
    return orders.groupBy(t.time_ago(F.col("ms"), F.lit(last + 3_600_000)).alias("age")).agg(F.count("*").alias("orders"))


def _pair_sql(line: str, separator: str) -> str:
    """What stands before and after the first separator; empty where there is none."""
    return f"CASE WHEN regexp_matches({line}, '{separator}') THEN {{'term': trim(regexp_extract({line}, '^(.*?)(?:{separator})', 1), ' '), 'definition': trim(regexp_replace({line}, '^.*?(?:{separator})', ''), ' ')}} ELSE {{'term': '', 'definition': ''}} END"


QUERIES = {
    "normalize_text": (normalize_text, f"SELECT doc_id, md5({key_sql('text')}) AS key_md5, CAST(length({key_sql('text')}) AS INT) AS key_length FROM documents"),
    "djb2_hash": (djb2_hash, f"SELECT doc_id, {_HASH_SQL.format('text')} AS hash FROM documents"),
    "content_hash_changed": (content_hash_changed, "SELECT source, count(*) AS changed FROM documents WHERE doc_id % 3 = 0 AND text <> '' GROUP BY 1"),
    "dedup_norm_first": (dedup_norm_first, f"WITH {LINES_SQL}, k AS (SELECT *, {key_sql('line')} AS key FROM lines) SELECT doc_id, count(*) AS new_lines FROM (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, line_no) = 1) GROUP BY 1"),
    "sentence_split": (sentence_split, r"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, CAST(len(a) AS INT) AS sentences, CAST(length(a[1]) AS INT) AS first_length FROM a"""),
    "meaningful_filter": (meaningful_filter, f"WITH {LINES_SQL}, k AS (SELECT doc_id, {key_sql('line')} AS k FROM lines) SELECT doc_id, count(*) AS kept FROM k WHERE length(k) >= 5 AND NOT regexp_matches(k, '^[0-9]+$') AND regexp_matches(k, '[가-힣a-zA-Z]') GROUP BY 1"),
    "category_rules": (category_rules, f"WITH {MARKED_SQL} SELECT CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in t.CATEGORIES) + f" ELSE '{t.OTHER_CATEGORY}' END AS category, count(*) AS n FROM marked WHERE line <> '' GROUP BY 1"),
    "importance_scores": (importance_scores, f"""WITH {MARKED_SQL}, p AS (SELECT 3.0 + regexp_matches(line, '{t.CATEGORIES[0][1]}')::INT + regexp_matches(line, '[0-9]')::INT + regexp_matches(line, '{t.CATEGORIES[1][1]}')::INT
  + 0.5 * regexp_matches(line, '{t.CATEGORIES[2][1]}')::INT + 1.5 * regexp_matches(line, '{t.EMPHASIS}')::INT - 2 * regexp_matches(line, '{t.EXAMPLE}')::INT - (length({key_sql('line')}) < 10)::INT AS p FROM marked WHERE line <> '')
SELECT CAST(least(greatest(floor(p + 0.5), 1), 5) AS INT) AS importance, count(*) AS n FROM p GROUP BY 1"""),
    "line_roles": (line_roles, f"WITH {LINES_SQL} SELECT doc_id, CASE WHEN regexp_matches(line, '{_BULLET}') THEN 'bullet' WHEN {_HEADING_SQL} THEN 'heading' WHEN regexp_matches(line, '{_END}') THEN 'sentence' ELSE 'open' END AS role, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY ALL"),
    "heading_carry_forward": (heading_carry_forward, f"""WITH {LINES_SQL}, h AS (SELECT *, {_HEADING_SQL} AS is_heading FROM lines WHERE trim(line) <> ''),
  c AS (SELECT *, last_value(CASE WHEN is_heading THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM h)
SELECT doc_id, heading, count(*) AS lines FROM c WHERE NOT is_heading GROUP BY ALL"""),
    "join_lines_islands": (join_lines_islands, f"""WITH {LINES_SQL}, b AS (SELECT *, coalesce(regexp_matches(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '{_END}'), TRUE) AS begins FROM lines WHERE trim(line) <> ''),
  i AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM b), j AS (SELECT doc_id, island, string_agg(line, ' ' ORDER BY line_no) AS text FROM i GROUP BY ALL)
SELECT doc_id, count(*) AS joined, CAST(max(length(text)) AS INT) AS longest FROM j GROUP BY 1"""),
    "bullet_normalize": (bullet_normalize, rf"""WITH {MARKED_SQL}, k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\s*[•●∙◦○▪■·ㆍ*]\s*', '● '), '^\s*[―ㅡ–—−]\s*', '- '), '^\s*-\s*', '- '), '\s*[ㆍ∙]\s*', ' · ', 'g'), '\s{{2,}}', ' ', 'g'), ' ') AS clean FROM marked)
SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(clean) AS clean_md5 FROM k WHERE clean <> line"""),
    "page_number_filter": (page_number_filter, rf"""WITH {LINES_SQL}, a AS (SELECT 'p ' || (s_suppkey % 2000) AS line FROM supplier UNION ALL SELECT line FROM lines)
SELECT line, count(*) AS n FROM a WHERE trim(line) <> '' AND length(trim(line)) <= 20 AND regexp_matches(trim(line), '\d') AND regexp_matches(trim(line), '{c.PAGE_NUMBER}') GROUP BY 1"""),
    "datetime_watermark": (datetime_watermark, "SELECT o_orderkey, trim(regexp_replace(substr(o_orderpriority, 1, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END) || ' ' || substr(o_orderpriority, 4, 20), '\\s{2,}', ' ', 'g'), ' ') AS clean FROM orders"),
    "noise_reason": (noise_reason, rf"""WITH {MARKED_SQL}, b AS (SELECT regexp_replace(line, '\s+', '', 'g') AS b FROM marked), q AS (SELECT b, length(b) AS n, length(regexp_replace(b, '[^가-힣]', '', 'g')) AS h, length(regexp_replace(b, '[^A-Za-z]', '', 'g')) AS l,
  length(regexp_replace(b, '[^0-9]', '', 'g')) AS dg, length(regexp_replace(b, '[^ㄱ-ㅎㅏ-ㅣ]', '', 'g')) AS j, length(regexp_replace(b, '[^.,·ㆍ:;()\[\]‘’“”''"\-~?!/%○●•▪■□★☆※<>「」『』…]', '', 'g')) AS m FROM b)
SELECT CASE WHEN n = 0 THEN 'blank' WHEN h + l + dg = 0 THEN 'symbols' WHEN j >= 2 AND j >= h * 0.5 THEN 'loose_letters'
  WHEN (h + l + dg + 0.6 * m) / n - CASE WHEN h >= 3 AND l > 0 AND l < h THEN least(0.5, l / n * 2.5) ELSE 0 END < 0.25 THEN 'low_quality' ELSE 'kept' END AS reason, count(*) AS n FROM q GROUP BY 1"""),
    "text_quality": (text_quality, r"""WITH b AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS b FROM documents), q AS (SELECT doc_id, length(b) AS n, length(regexp_replace(b, '[^가-힣]', '', 'g')) AS h, length(regexp_replace(b, '[^A-Za-z]', '', 'g')) AS l,
  length(regexp_replace(b, '[^0-9]', '', 'g')) AS dg, length(regexp_replace(b, '[^.,·ㆍ:;()\[\]‘’“”''"\-~?!/%○●•▪■□★☆※<>「」『』…]', '', 'g')) AS m FROM b)
SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (h + l + dg + 0.6::DOUBLE * m) / n - CASE WHEN h >= 3 AND l > 0 AND l < h THEN least(0.5::DOUBLE, l / n * 2.5::DOUBLE) ELSE 0 END)) END, 6) AS quality FROM q"""),
    "lexicon_counts": (lexicon_counts, rf"""WITH {LINES_SQL}, w AS (SELECT regexp_replace(unnest(regexp_split_to_array(line, '\s+')), '^[“"''‘(\[<《「『]+|[”"''’)\]>》」』.,!?;:·…]+$', '', 'g') AS stem FROM lines) SELECT stem, count(*) AS n FROM w WHERE stem <> '' GROUP BY 1"""),
    "cleanup_log_counts": (cleanup_log_counts, rf"""WITH l AS (SELECT source, unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')) AS line FROM documents), b AS (SELECT source, line, regexp_replace(line, '\s+', '', 'g') AS b FROM l),
  q AS (SELECT *, length(b) AS n, length(regexp_replace(b, '[^가-힣]', '', 'g')) AS h, length(regexp_replace(b, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(b, '[^0-9]', '', 'g')) AS dg, length(regexp_replace(b, '[^ㄱ-ㅎㅏ-ㅣ]', '', 'g')) AS j,
    length(regexp_replace(b, '[^.,·ㆍ:;()\[\]‘’“”''"\-~?!/%○●•▪■□★☆※<>「」『』…]', '', 'g')) AS m,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\s*[•●∙◦○▪■·ㆍ*]\s*', '● '), '^\s*[―ㅡ–—−]\s*', '- '), '^\s*-\s*', '- '), '\s*[ㆍ∙]\s*', ' · ', 'g'), '\s{{2,}}', ' ', 'g'), ' ') AS clean FROM b)
SELECT source, CASE WHEN n = 0 OR h + l + dg = 0 OR (j >= 2 AND j >= h * 0.5) OR (h + l + dg + 0.6 * m) / n - CASE WHEN h >= 3 AND l > 0 AND l < h THEN least(0.5, l / n * 2.5) ELSE 0 END < 0.25 THEN 'noise'
  WHEN trim(line) <> '' AND length(trim(line)) <= 20 AND regexp_matches(trim(line), '\d') AND regexp_matches(trim(line), '{c.PAGE_NUMBER}') THEN 'pageNumber' WHEN clean <> line THEN 'bullet' ELSE 'kept' END AS type, count(*) AS n FROM q GROUP BY ALL"""),
    "repeated_line_df": (repeated_line_df, f"WITH {LINES_SQL} SELECT md5(line) AS line_md5, count(DISTINCT doc_id) AS documents FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3"),
    "keyword_repeat_count": (keyword_repeat_count, f"WITH {LINES_SQL}, w AS (SELECT *, regexp_extract(line, '([A-Za-z]{{6,}})', 1) AS word FROM lines WHERE line <> '') SELECT a.doc_id, CAST(a.line_no AS INT) AS line_no, count(*) AS repeats FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.line_no <> b.line_no AND a.word <> '' AND contains(b.line, a.word) GROUP BY ALL"),
    "bigram_dice_pairs": (bigram_dice_pairs, f"""WITH {grams_sql('benchmark', 'item_id', key_sql('text'), 'g')}, n AS (SELECT id, count(*) AS n FROM g GROUP BY 1)
SELECT a.id AS a, b.id AS b, round(2.0::DOUBLE * count(*) / (any_value(na.n) + any_value(nb.n)), 6) AS similarity FROM g a JOIN g b ON a.gram = b.gram AND a.occ = b.occ AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id
GROUP BY a.id, b.id HAVING 2.0::DOUBLE * count(*) / (any_value(na.n) + any_value(nb.n)) >= 0.5"""),
    "containment_grounding": (containment_grounding, f"""WITH turns AS (SELECT row_number() OVER () AS turn_id, conv_id, {key_sql('text')} AS k FROM conversations WHERE role = 'assistant'),
  items AS (SELECT item_id, {key_sql('text')} AS k FROM benchmark), ig AS (SELECT item_id, substr(k, i, 2) AS gram, count(*) AS n FROM items, unnest(range(1, length(k))) u(i) GROUP BY ALL),
  cg AS (SELECT conv_id, substr(k, i, 2) AS gram, count(*) AS n FROM turns, unnest(range(1, length(k))) u(i) GROUP BY ALL),
  c AS (SELECT item_id, conv_id, sum(least(ig.n, cg.n)) AS common FROM ig JOIN cg USING (gram) GROUP BY ALL), sizes AS (SELECT item_id, sum(n) AS n FROM ig GROUP BY 1)
SELECT b.item_id, c.conv_id, round(coalesce(c.common, 0) / CAST(z.n AS DOUBLE), 6) AS contained FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN sizes z USING (item_id) LEFT JOIN c USING (item_id)"""),
    "excerpt_in_context": (excerpt_in_context, f"WITH i AS (SELECT item_id, {key_sql('text')} AS item FROM benchmark), c AS (SELECT doc_id, {key_sql('text')} AS context FROM documents) SELECT item_id, count(*) AS documents FROM i JOIN c ON contains(context, item) WHERE length(item) >= 3 GROUP BY 1"),
    "levenshtein_ascii": (levenshtein_ascii, "SELECT p_partkey, CAST(levenshtein(p_name, before) AS INT) AS distance FROM (SELECT *, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM part) WHERE before IS NOT NULL"),
    "cer_report": (cer_report, "SELECT p_brand, count(*) AS parts, round(avg(levenshtein(p_type || substr(p_name, 1, 3), p_type) / greatest(length(p_type), 1)::DOUBLE), 6) AS cer, count(*) FILTER (p_type || substr(p_name, 1, 3) = p_type) AS exact FROM part GROUP BY 1"),
    "term_parse_lines": (term_parse_lines, rf"""WITH {LINES_SQL}, l AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '{t.BULLETS}', ''), '\s+', ' ', 'g'), ' ') AS x, trim(line, ' ') AS whole FROM lines),
  c AS (SELECT *, list_filter([{", ".join(_pair_sql("whole" if p == t.SEPARATORS[3] else "x", p) for p in t.SEPARATORS)}], lambda p: p.term <> '' AND p.definition <> '')[1] AS pair FROM l),
  e AS (SELECT doc_id, line_no, coalesce(pair, CASE WHEN regexp_matches(x, '^([A-Za-z][A-Za-z .''-]*?)\s+([가-힣].*)$') THEN {{'term': regexp_extract(x, '^([A-Za-z][A-Za-z .''-]*?)\s+([가-힣].*)$', 1), 'definition': regexp_extract(x, '^([A-Za-z][A-Za-z .''-]*?)\s+([가-힣].*)$', 2)}} END) AS pair FROM c)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(length(pair.term) AS INT) AS term_length, CAST(length(pair.definition) AS INT) AS definition_length FROM e WHERE pair IS NOT NULL AND length(pair.term) <= 40 QUALIFY row_number() OVER (PARTITION BY doc_id, {key_sql('pair.term')} ORDER BY line_no) = 1"""),
    "table_rows": (table_rows, f"""WITH {LINES_SQL}, k AS (SELECT *, len(list_filter(string_split(line, '|'), lambda x: trim(x, ' ') <> '')) AS cells FROM lines WHERE contains(line, '|')),
  i AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM k WHERE cells >= 2) SELECT doc_id, CAST(min(line_no) AS INT) AS first_line, count(*) AS rows, CAST(sum(cells) AS BIGINT) AS cells FROM i GROUP BY doc_id, island"""),
    "emphasis_terms": (emphasis_terms, f"""WITH {MARKED_SQL}, t AS (SELECT doc_id, line_no, unnest(list_distinct(regexp_extract_all(line, '[‘''“"]([^’''”"]{{2,30}})[’''”"]', 1))) AS term FROM marked) SELECT doc_id, term, count(*) AS lines FROM t GROUP BY ALL"""),
    "truncate_escape": (truncate_escape, "SELECT page_id, CASE WHEN length(url) > 24 THEN substr(url, 1, 24) || '…' ELSE url END AS short, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages"),
    "secret_guard": (secret_guard, r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(api[_-]?key|token|secret)\s*[=:]\s*"?[A-Za-z0-9_-]{16,}')"""),
    "time_ago": (time_ago, """WITH n AS (SELECT max(epoch_ms(o_orderdate)) + 3600000 AS now FROM orders), m AS (SELECT o_orderdate, (now - epoch_ms(o_orderdate)) // 60000 AS m FROM orders, n)
SELECT CASE WHEN m < 1 THEN '방금 전' WHEN m < 60 THEN m || '분 전' WHEN m < 1440 THEN (m // 60) || '시간 전' WHEN m < 43200 THEN (m // 1440) || '일 전' ELSE strftime(o_orderdate, '%Y. %m. %d') END AS age, count(*) AS orders FROM m GROUP BY 1"""),
}
