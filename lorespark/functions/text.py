"""Text functions as Column expressions. Lengths count code points; null texts count as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------------------------------------
#: Characters that a normalised text leaves out, besides white space.
PUNCTUATION = ".,!?;:'\"“”‘’`~·•…()[]{}<>《》「」『』-_=+*/\\|"
#: The mark of a blank.
BLANK = "[      ]"
#: Bullet or number at the head of a line.
BULLET = r"^\s*([-*•·▪︎◦○●■□▶▷→]|\d+[.)]|[①-⑳]|[가-하][.)])"
BULLETS = r"^\s*([-*•·▪︎◦○●■□▶▷→]+|\d+[.)]|[①-⑳]|[가-하][.)])\s*"
SENTENCE_END = r"[.!?。]$|[다요음함임됨][.)]?$|\)$"
LINE_GOES_ON = r"(은|는|이|가|을|를|에|의|와|과|고|며|서|로|으로|에서|하여|되어|,|·|및)$"
LIST_LINE = r"^[-*•·▪︎◦○●→]"
HEADING_START = r"^(\d+[.)]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]|[①-⑳]|■|□|▶|제\s*\d+\s*[장절과단원])"
#: Categories in order of precedence.
CATEGORIES = (
    ("정의", r"(이?란\s|이라고 한다|라고 한다|[을를] 말한다|의미한다|뜻한다|일컫는다|정의)"),
    ("원인·결과", r"(때문|원인|결과|따라서|그 결과|으로 인해|로 인해|초래|야기|영향)"),
    ("기능·역할", r"(기능|역할|담당|작용|보호|조절|분비|생성|운반|순환|지지|저장)"),
    ("숫자·날짜", r"[0-9]"),
    ("비교", r"(비해|보다|반면|차이|와 달리|과 달리|공통점|차이점)"),
    ("순서", r"(먼저|다음으로|마지막|순서|단계|이후|뒤이어)"),
    ("구조·위치", r"(위치|사이|구성|이루어|포함|속한|안쪽|바깥|위쪽|아래)"),
)
OTHER_CATEGORY = "특징"
EMPHASIS = r"(중요|반드시|핵심|주의|★|※|꼭 |필수)"
EXAMPLE = r"(예를 들어|예컨대|예:|예\)|참고|가령|기타|등이 있다|따위)"
#: Separators of a term and its definition, in order of precedence.
SEPARATORS = (r"\s*(?:→|⇒|=>|->)\s*", r"\s*[:：]\s*", r"\s*=\s*", r"\t+", r"\s+[-–—]\s+")
# -------------------------------------------------------------------------------------------------------------------

_CLASS = "".join("\\" + c if c in "[]\\-^&" else c for c in PUNCTUATION)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, even where it is used for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_text(c: Column) -> Column:
    """The comparison key: lower case, no white space, no punctuation."""
    return F.regexp_replace(F.lower(text_of(c)), rf"[\s\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}{_CLASS}]+", "")


def hash_string(c: Column) -> Column:
    """A 32-bit multiplicative hash in base 36, and the length."""
    letters = F.filter(F.split(text_of(c), ""), lambda x: x != "")
    state = F.aggregate(letters, F.lit(5381).cast("long"), lambda h, x: (h * 33 + F.ascii(x)).bitwiseAND(F.lit(4294967295)))
    return F.concat(F.lower(F.conv(state.cast("string"), 10, 36)), F.lit(":"), F.length(text_of(c)).cast("string"))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(text_of(c)) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(text_of(c))


def escape_html(c: Column) -> Column:
    out = text_of(c)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def time_ago(then_ms: Column, now_ms: Column) -> Column:
    """``n`` and unit of the age of a time: now, minute, hour, day; a date beyond 30 days; null for no time."""
    minutes = F.floor(F.greatest(now_ms - then_ms, F.lit(0)) / 60000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    label = (
        F.when(minutes < 1, F.lit("방금 전"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("분 전")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("시간 전")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("일 전")))
        .otherwise(F.date_format(F.timestamp_millis(then_ms), "yyyy. MM. dd"))
    )
    return F.when(F.coalesce(then_ms, F.lit(0)) != 0, label)


def half_up(c: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c + 0.5)


def clean_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text_of(c), BULLETS, ""), r"\s+", " "))


def ends_sentence(c: Column) -> Column:
    return c.rlike(SENTENCE_END)


def continues_next_line(c: Column) -> Column:
    return c.rlike(LINE_GOES_ON) | ((F.length(c) >= 28) & ~ends_sentence(c))


def is_bullet(c: Column) -> Column:
    return c.rlike(BULLET)


def is_heading(c: Column) -> Column:
    """A short line that neither lists nor ends or continues a sentence, and is numbered or has three words at most."""
    line = F.trim(text_of(c))
    short = (line != "") & (F.length(line) <= 24) & ~line.rlike(LIST_LINE)
    return short & ~ends_sentence(line) & ~continues_next_line(line) & (line.rlike(HEADING_START) | ~line.rlike(r"\s.*\s.*\s"))


def is_meaningful(c: Column) -> Column:
    key = normalize_text(c)
    return (F.length(key) >= 5) & ~key.rlike("^[0-9]+$") & key.rlike("[가-힣a-zA-Z]")


def category_of(c: Column) -> Column:
    out = F.lit(OTHER_CATEGORY)
    for name, pattern in reversed(CATEGORIES):
        out = F.when(text_of(c).rlike(pattern), name).otherwise(out)
    return out


def importance_of(c: Column, heading_keyword: Column | None = None, first_under_heading: Column | None = None, repeats: Column | None = None) -> Column:
    """An importance of 1..5 from signals in the sentence and its surroundings."""
    points = lambda condition, n: F.when(condition, F.lit(n)).otherwise(F.lit(0.0))
    pattern = dict(CATEGORIES)
    score = F.lit(3.0) + points(c.rlike(pattern["정의"]), 1.0) + points(c.rlike("[0-9]"), 1.0) + points(c.rlike(pattern["원인·결과"]), 1.0)
    score = score + points(c.rlike(pattern["기능·역할"]), 0.5) + points(c.rlike(EMPHASIS), 1.5)
    for condition in (heading_keyword, first_under_heading, None if repeats is None else repeats >= 2):
        if condition is not None:
            score = score + points(condition, 0.5)
    score = score - points(c.rlike(EXAMPLE), 2.0) - points(F.length(normalize_text(c)) < 10, 1.0)
    return F.least(F.greatest(half_up(score), F.lit(1)), F.lit(5)).cast("int")


def split_sentences(c: Column) -> Column:
    """The sentences of a text on one line: cut after final marks that white space follows."""
    return F.filter(F.transform(F.split(text_of(c), r"(?<=[.!?。])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def make_blank(sentence: Column, answer: Column) -> Column:
    """The sentence with the first occurrence of the answer blanked; null where it doesn't occur."""
    at = F.instr(sentence, answer)
    return F.when(at > 0, F.concat(F.substring(sentence, F.lit(1), at - 1), F.lit(BLANK), F.substring(sentence, at + F.length(answer), F.length(sentence))))


def strip_emphasis(c: Column) -> Column:
    bare = F.regexp_replace(text_of(c), r"^\s*[★☆※*!]+\s*", "")
    bare = F.trim(F.regexp_replace(bare, r"^((반드시|꼭)\s*(기억|암기|알\s*것)|중요|핵심|주의)\s*[:：!]\s*", ""))
    return F.when(F.length(bare) >= 5, bare).otherwise(c)


def parse_term(c: Column) -> Column:
    """``struct<term, definition>`` of a line, by the first separator in order of precedence that has both sides."""
    line = clean_line(c)
    found = []
    for separator in SEPARATORS:
        parts = F.split(line if separator != r"\t+" else F.trim(text_of(c)), separator, 2)
        found.append(F.when((F.size(parts) == 2) & (F.trim(parts[0]) != "") & (F.trim(F.get(parts, F.lit(1))) != ""), F.struct(F.trim(parts[0]).alias("term"), F.trim(F.get(parts, F.lit(1))).alias("definition"))))
    mixed = F.regexp_extract(line, r"^([A-Za-z][A-Za-z .'-]*?)\s+([가-힣].*)$", 1)
    found.append(F.when(mixed != "", F.struct(mixed.alias("term"), F.regexp_extract(line, r"^([A-Za-z][A-Za-z .'-]*?)\s+([가-힣].*)$", 2).alias("definition"))))
    return F.coalesce(*found)


def parse_json_loose(c: Column) -> Column:
    """The JSON text in an answer: code fences off, else the outermost braces or brackets."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text_of(c), r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))
    return F.when(bare.rlike(r"^[\[{]"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)[\[{].*[\]}]", 0), F.lit("")))


def chunk_text(c: Column, most: int = 12_000) -> Column:
    """The text in chunks of whole lines, none longer than ``most`` unless a single line is."""
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, line: Column) -> Column:
        joined = F.concat(s["open"], F.lit("\n"), line)
        full = F.length(joined) > most
        opened = F.when(s["open"].isNull() | full, line).otherwise(joined)
        return F.struct(opened.alias("open"), F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"))

    return F.aggregate(F.split(text_of(c), "\n"), start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
