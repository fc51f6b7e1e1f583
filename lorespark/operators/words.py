"""Word study: terms and definitions from lines, and what can be asked about each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.korean import keyword_candidates
from lorespark.functions.text import SEPARATORS, normalize_text, text_of
from lorespark.operators.cleanup import lines_of
from lorespark.operators.quiz import difficulty, drawn, grade_mode
from lorespark.sources.tables import latest

# ---- Fixed values -------------------------------------------------------------------------------------------------
LONGEST_TERM = 40
LINE_HEAD = r"^\s*([-*•·]+|\d+[.)]|[①-⑳])\s*"
ENGLISH_TERM = r"^([A-Za-z][A-Za-z'\- ]*?)\s+([가-힣(].*)$"
ASK_MEANING, ASK_TERM = "‘{t}’의 뜻으로 알맞은 것은?", "다음 설명에 해당하는 용어는?\n“{d}”"
ASK_TRUTH = ("다음이 맞으면 O, 틀리면 X를 고르시오.\n‘{t}’ — {d}", "다음이 맞으면 O, 틀리면 X를 고르시오.\n“{d}”에 해당하는 용어는 ‘{t}’이다.")
ASK_SHORT = ("“{d}”에 해당하는 용어를 쓰시오.", "다음 설명에 해당하는 말은?\n{d}")
ASK_ESSAY = ("‘{t}’의 뜻을 쓰시오.", "‘{t}’은(는) 무엇인가?")
ASK_BLANK, WORD_BLANK = "빈칸에 들어갈 말을 쓰시오.\n‘{t}’: {d}", "(      )"
ASK_ABOUT = "‘{t}’의 특징을 자료 내용에 맞게 설명하시오."
LEAST_DEFINITION = 12
# -------------------------------------------------------------------------------------------------------------------


def term_pair(line: Column) -> Column:
    """``struct<term, definition>`` of a line, by the first separator in order of precedence that has both sides; what
    further separators of that kind part is joined by spaces."""
    found = []
    for separator in SEPARATORS:
        parts = F.split(line, separator)
        rest = F.trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " "))
        found.append(F.when((F.trim(F.get(parts, F.lit(0))) != "") & (rest != ""), F.struct(F.trim(F.get(parts, F.lit(0))).alias("term"), rest.alias("definition"))))
    english = F.regexp_extract(line, ENGLISH_TERM, 1)
    found.append(F.when(english != "", F.struct(F.trim(english).alias("term"), F.trim(F.regexp_extract(line, ENGLISH_TERM, 2)).alias("definition"))))
    return F.coalesce(*found)


def parsed_items(texts: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, line, term, definition``: each text's lines that are not blank, with the pair that a line is.

    A line that is no pair, or whose term is too long, has nulls (it is left unparsed); of equal terms of a text only the
    first line is there.
    """
    lines = lines_of(texts, id_column, text).withColumn("line", F.trim(F.regexp_replace(text_of(F.col("line")), LINE_HEAD, ""))).where("line <> ''")
    pair = term_pair(F.col("line"))
    rows = lines.withColumn("pair", F.when(F.length(pair["term"]) <= LONGEST_TERM, pair))
    items = latest(rows.where("pair is not null").withColumn("_key", normalize_text(F.col("pair.term"))), ["doc_id", "_key"], [F.col("line_no")]).drop("_key")
    return items.unionByName(rows.where("pair is null")).select("doc_id", "line_no", "line", "pair.term", "pair.definition")


def _said(template: str, term: Column, definition: Column) -> Column:
    """The template with {t} and {d} put in; null where one of these is null."""
    out, rest = [], template
    while rest:
        cut = min((k for k in (rest.find("{t}"), rest.find("{d}")) if k >= 0), default=len(rest))
        if cut:
            out.append(F.lit(rest[:cut]))
        if cut < len(rest):
            out.append(term if rest[cut + 1] == "t" else definition)
        rest = rest[cut + 3 :]
    return F.concat(*out)


def others(items: DataFrame, field: str, n: int, seed: int) -> DataFrame:
    """``item_id, others``: up to n values of other items of the pool in a drawn order, no two and none of its own alike.

    Each pool is a ring of its distinct values in a drawn order; an item takes those that follow its own, so no item is
    compared with its whole pool.
    """
    rows = items.select("item_id", "pool", F.col(field).alias("value"), normalize_text(F.col(field)).alias("k")).where("k <> ''")
    distinct = rows.groupBy("pool", "k").agg(F.min("value").alias("value")).withColumn("draw", drawn(seed, "pool", "k"))
    ring = Window.partitionBy("pool").orderBy("draw", "k")
    whole = Window.partitionBy("pool")
    after = distinct.withColumn("next", F.collect_list("value").over(ring.rowsBetween(1, n))).withColumn("place", F.row_number().over(ring)).withColumn("size", F.count("*").over(whole))
    head = distinct.withColumn("place", F.row_number().over(ring)).where(F.col("place") <= n).groupBy("pool").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("head"))
    missing = F.greatest(F.least(F.lit(n), F.col("size") - 1) - F.size("next"), F.lit(0))
    taken = after.join(head, "pool").select("pool", "k", F.concat("next", F.slice("head", F.lit(1), missing)).alias("others"))
    return rows.join(taken, ["pool", "k"]).select("item_id", "others")


def word_questions(items: DataFrame, seed: int = 1) -> DataFrame:
    """``item_id, pool, type, difficulty, grade_mode, question, options, answer``: what can be asked about each item.

    items: item_id, pool, term, definition. Directions, wording, truth and order of options are drawn by seed and item.
    """
    rows = items.join(others(items, "definition", 3, seed).withColumnRenamed("others", "definitions"), "item_id", "left").join(others(items, "term", 3, seed).withColumnRenamed("others", "terms"), "item_id", "left")
    term, definition = F.col("term"), F.col("definition")
    coin = lambda name: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col("item_id").cast("string"))), 1, 1), 16, 10).cast("int") < 8
    either = lambda name, pair: F.when(coin(name), _said(pair[0], term, definition)).otherwise(_said(pair[1], term, definition))
    mixed = lambda own, rest: F.transform(F.array_sort(F.transform(F.concat(F.array(own), rest), lambda o: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string"), F.lit(":"), o)).alias("h"), o.alias("o")))), lambda x: x["o"])
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    by_meaning = coin("mc")
    false = coin("ox") & some(F.col("definitions"))
    shown = F.when(false, F.get("definitions", F.lit(0))).otherwise(definition)
    truth = F.when(coin("ox-form"), _said(ASK_TRUTH[0], term, shown)).otherwise(_said(ASK_TRUTH[1], term, shown))
    keys = F.transform(F.slice(keyword_candidates(definition), 1, 3), lambda k: k["stem"])
    turn = F.pmod(F.xxhash64(F.lit(seed), "item_id"), F.greatest(F.size(keys), F.lit(1))).cast("int")
    key = F.get(keys, turn)
    at = F.instr(definition, key)
    blanked = F.concat(F.substring(definition, F.lit(1), at - 1), F.lit(WORD_BLANK), F.substring(definition, at + F.length(key), F.length(definition)))
    none = F.lit(None).cast("array<string>")

    def made(kind: str, when: Column, question: Column, options: Column, answer: Column) -> Column:
        return F.when(when & question.isNotNull() & answer.isNotNull(), F.struct(F.lit(kind).alias("type"), question.alias("question"), options.alias("options"), answer.alias("answer")))

    kinds = F.array(
        made("MULTIPLE_CHOICE", F.when(by_meaning, some(F.col("definitions"))).otherwise(some(F.col("terms"))), F.when(by_meaning, _said(ASK_MEANING, term, definition)).otherwise(_said(ASK_TERM, term, definition)),
             F.when(by_meaning, mixed(definition, F.col("definitions"))).otherwise(mixed(term, F.col("terms"))), F.when(by_meaning, definition).otherwise(term)),
        made("OX", term.isNotNull(), truth, F.array(F.lit("O"), F.lit("X")), F.when(false, "X").otherwise("O")),
        made("SHORT_ANSWER", term.isNotNull(), either("short", ASK_SHORT), none, term),
        made("SUBJECTIVE", term.isNotNull(), either("essay", ASK_ESSAY), none, definition),
        made("FILL_BLANK", (F.size(F.filter(F.split(definition, r"\s+"), lambda w: w != "")) >= 2) & (at > 0), _said(ASK_BLANK, term, blanked), none, key),
        made("DESCRIPTIVE", F.length(definition) >= LEAST_DEFINITION, _said(ASK_ABOUT, term, definition), none, definition),
    )
    out = rows.select("item_id", "pool", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("q")).select("item_id", "pool", "q.*")
    return out.select("item_id", "pool", "type", difficulty(F.col("type")).alias("difficulty"), grade_mode(F.col("type")).alias("grade_mode"), "question", "options", "answer")
