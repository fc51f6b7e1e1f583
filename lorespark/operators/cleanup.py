"""Cleaning of noisy lines: page numbers, noise, bullets, printed watermarks, lexicons and term unification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.korean import strip_particle, to_jamo
from lorespark.functions.similarity import jamo_edit_ratio
from lorespark.functions.text import let, text_of

# ---- Fixed values -------------------------------------------------------------------------------------------------
DATE = r"(?:19|20)\d{2}\s*[-./]\s*\d{1,2}\s*[-./]\s*\d{1,2}"
DATE_TIME = DATE + r"\s*\d{1,2}\s*:\s*\d{2}"
SLASH_CHAIN = r"\/?\s*(?:[가-힣A-Za-z0-9]{1,8}\s*\/\s*)+(?:" + DATE + r"(?:\s*\d{1,2}\s*:\s*\d{2})?|[가-힣A-Za-z0-9]{1,8})?"
PAGE_NUMBER = r"^\s*(?:[가-힣A-Za-z][가-힣A-Za-z ]{0,14})?\s*[-–—~·]?\s*\(?\d{1,3}\)?\s*[-–—~]?\s*$"
GOOD_MARKS = r"[.,·ㆍ:;()\[\]‘’“”'\"\-~?!/%○●•▪■□★☆※<>「」『』…]"
#: Letters that recognition confuses; either may stand for the other.
CONFUSABLE = (
    "ㄴㄹ", "ㄴㄷ", "ㄷㄹ", "ㅁㅇ", "ㅁㅂ", "ㅂㅍ", "ㅇㅎ", "ㅎㅌ", "ㄱㅋ", "ㅈㅊ", "ㅅㅈ", "ㄷㅌ", "ㄹㅌ", "ㄱㄲ", "ㄴㅇ",
    "ㄱㄷ", "ㅓㅕ", "ㅡㅜ", "ㅡㅗ", "ㅐㅔ", "ㅔㅖ", "ㅚㅟ", "ㅢㅡ",
)
SOFT_FINALS = ("", "ㄴ", "ㄹ", "ㅁ", "ㅆ", "ㅂ")
# -------------------------------------------------------------------------------------------------------------------


def lines_of(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, line``: the lines of each text, from 0."""
    return documents.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(text_of(F.col(text)), r"\r?\n")).alias("line_no", "line"))


def count_of(c: Column, pattern: str) -> Column:
    """How many characters of the class (written for use inside brackets) the text has."""
    return F.regexp_count(c, F.lit(f"[{pattern}]"))


def is_page_number(c: Column) -> Column:
    line = F.trim(text_of(c))
    return (line != "") & (F.length(line) <= 20) & line.rlike(r"\d") & line.rlike(PAGE_NUMBER)


def text_quality(c: Column) -> Column:
    """0..1: the share of letters, digits and (at 0.6) usual marks; Latin strewn into Hangul costs up to 0.5."""
    return let(F.regexp_replace(text_of(c), r"\s+", ""), _quality)


def _quality(bare: Column) -> Column:
    """text_quality of a text without white space; every count is made once."""
    counts = {"hangul": count_of(bare, "가-힣"), "latin": count_of(bare, "A-Za-z"), "digits": count_of(bare, "0-9"), "marks": count_of(bare, GOOD_MARKS[1:-1])}

    def quality(x: Column) -> Column:
        n, hangul, latin = x["n"], x["hangul"], x["latin"]
        share = (hangul + latin + x["digits"] + 0.6 * x["marks"]) / n
        mixed = F.when((hangul >= 3) & (latin > 0) & (latin < hangul), F.least(F.lit(0.5), latin / n * 2.5)).otherwise(F.lit(0.0))
        return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share - mixed)))

    return let(F.struct(F.length(bare).alias("n"), *(v.alias(k) for k, v in counts.items())), quality)


def line_score(text: Column, confidence: Column) -> Column:
    return 0.5 * F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(100.0)) / 100 + 0.5 * text_quality(text)


def noise_reason(c: Column, page_level: bool = True, stem_count: Column | None = None) -> Column:
    """The first reason to drop a line, or null: blank, symbols, loose letters, low quality, or (in a region) a shred."""
    stems = F.coalesce(F.lit(0) if stem_count is None else stem_count, F.lit(0))

    def judged(bare: Column) -> Column:
        counts = F.struct(count_of(bare, "가-힣").alias("hangul"), count_of(bare, "ㄱ-ㅎㅏ-ㅣ").alias("loose"))

        def reason(x: Column) -> Column:
            first = (
                F.when(bare == "", "blank")
                .when(count_of(bare, "가-힣0-9A-Za-z") == 0, "symbols")
                .when((x["loose"] >= 2) & (x["loose"] >= x["hangul"] * 0.5), "loose_letters")
                .when(_quality(bare) < (0.25 if page_level else 0.45), "low_quality")
            )
            shred = (x["hangul"] >= 1) & (x["hangul"] <= 2) & (F.length(bare) <= 4) & ~bare.rlike("^[0-9]") & (stems < 2)
            return first if page_level else first.when(shred, "shred")

        return let(counts, reason)

    return let(F.regexp_replace(text_of(c), r"\s+", ""), judged)


def normalize_bullets(c: Column) -> Column:
    out = text_of(c)
    for pattern, put in ((r"^\s*[•●∙◦○▪■·ㆍ*]\s*", "● "), (r"^\s*[―ㅡ–—−]\s*", "- "), (r"^\s*-\s*", "- "), (r"\s*[ㆍ∙]\s*", " · "), (r"\s{2,}", " ")):
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def lexicon(lines: DataFrame, line: str = "line") -> DataFrame:
    """``stem, n``: how often each word stem occurs."""
    words = lines.select(F.explode(F.filter(F.split(text_of(F.col(line)), r"\s+"), lambda w: w != "")).alias("word"))
    return words.groupBy(strip_particle(F.col("word")).alias("stem")).agg(F.count("*").alias("n")).where("stem <> ''")


def watermark_chain(c: Column, words: Column | None = None) -> Column:
    """Whether a slash chain is a printed mark: it holds a date or time or a learned word, or begins or ends with the slash."""
    chain = F.trim(c)
    known = F.lit(False) if words is None else F.arrays_overlap(F.split(chain, r"[/\s]+"), words)
    return F.contains(chain, F.lit("/")) & (chain.rlike(DATE) | chain.rlike(r"\d{1,2}\s*:\s*\d{2}") | chain.rlike(r"^/|/$") | F.coalesce(known, F.lit(False)))


def watermark_words(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """``word, pages``: names in watermark chains, and on how many pages each was seen."""
    chains = pages.select(F.col(page).alias("page"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({SLASH_CHAIN})"), 1)).alias("chain")).where(watermark_chain(F.col("chain")))
    pieces = chains.select("page", F.explode(F.split(F.trim("chain"), r"[/\s]+")).alias("word")).where(F.col("word").rlike("^[가-힣]{2,5}$"))
    return pieces.groupBy("word").agg(F.count_distinct("page").alias("pages"))


def strip_printed_marks(c: Column) -> Column:
    """The line without date-times and without slash chains that are watermarks."""
    out = F.regexp_replace(text_of(c), r"\/?\s*(?:[가-힣A-Za-z0-9]{1,8}\s*\/\s*)+" + DATE + r"(?:\s*\d{1,2}\s*:\s*\d{2})?", " ")
    out = F.regexp_replace(out, DATE_TIME, " ")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def confusable_diff(a: Column, b: Column) -> Column:
    """How many letters differ between two words of one length, if all of them are confusable pairs; else -1."""
    pairs = [p for c in CONFUSABLE for p in (c, c[::-1])]

    def letters(x: Column, y: Column) -> Column:
        ja, jb = to_jamo(x), to_jamo(y)
        ok = x.rlike("[가-힣]") & y.rlike("[가-힣]") & (F.length(ja) == F.length(jb))
        differing = F.filter(F.zip_with(F.split(ja, ""), F.split(jb, ""), lambda p, q: F.when(p != q, F.concat(p, q))), lambda p: p.isNotNull())
        bad = ~ok | F.exists(differing, lambda p: ~p.isin(*pairs))
        return F.when(x == y, F.lit(0)).when(bad, F.lit(-1)).otherwise(F.size(differing))

    each = F.zip_with(F.split(a, ""), F.split(b, ""), letters)
    total = F.aggregate(each, F.lit(0), lambda t, d: F.when((t < 0) | (d < 0), F.lit(-1)).otherwise(t + d))
    return F.when(F.length(a) != F.length(b), F.lit(-1)).otherwise(total)


def is_conjugation_pair(a: Column, b: Column) -> Column:
    """Whether two words differ in a soft final of their last syllable only."""
    ja, jb = to_jamo(F.right(a, F.lit(1))), to_jamo(F.right(b, F.lit(1)))
    head = lambda w: F.substring(w, F.lit(1), F.length(w) - 1)
    final = lambda j: F.substring(j, F.lit(3), F.length(j))
    return (head(a) == head(b)) & (F.substring(ja, 1, 2) == F.substring(jb, 1, 2)) & final(ja).isin(*SOFT_FINALS) & final(jb).isin(*SOFT_FINALS)


def _classes() -> tuple[str, str]:
    """Every confusable letter and the one that stands for all letters it is connected with."""
    stands = {letter: letter for pair in CONFUSABLE for letter in pair}
    while changes := [(a, b) for a, b in CONFUSABLE if stands[a] != stands[b]]:
        for a, b in changes:
            least = min(stands[a], stands[b])
            stands[a] = stands[b] = least
    return "".join(stands), "".join(stands.values())


def confusable_key(c: Column) -> Column:
    """What words with only confusable letters between them have in common: length, and letters by class."""
    return F.concat_ws(":", F.length(c).cast("string"), F.translate(to_jamo(c), *_classes()))


def term_map(counts: DataFrame) -> DataFrame:
    """``word, term, n, majority``: rare misread words and the common term that each stands for.

    counts: word, n. Candidates meet on :func:`confusable_key`, which words have in common however many of their letters
    differ, if these are confusable; so no two unrelated words are compared.
    """
    words = counts.where(F.length("word") >= 2)
    rare = words.select("word", "n", confusable_key(F.col("word")).alias("key"))
    common = words.where("n >= 3").select(F.col("word").alias("term"), F.col("n").alias("majority"), confusable_key(F.col("word")).alias("key"))
    pairs = rare.join(common, "key").where("word <> term and majority > n").drop("key")
    pairs = pairs.withColumn("diff", confusable_diff(F.col("word"), F.col("term"))).where("diff >= 1")
    size = F.length("word")
    # Suspects, which have a commoner likely double, are no evidence for a syllable of two-syllable words.
    suspects = pairs.select("word").distinct()
    syllables = words.where("n >= 2").join(suspects, "word", "left_anti").select(F.col("word").alias("other"), F.explode(F.array_distinct(F.split("word", ""))).alias("syllable"))
    need = F.when(size >= 4, F.greatest(F.lit(2), 2 * F.col("n"))).when(size == 3, F.greatest(F.lit(3), 2 * F.col("n"))).otherwise(F.greatest(F.lit(3), 4 * F.col("n")))
    allowed = F.when(size <= 2, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.length(to_jamo(F.col("word"))) / 5)))
    fit = pairs.where((F.col("majority") >= need) & (F.col("diff") <= allowed) & ~is_conjugation_pair(F.col("word"), F.col("term")))
    changed = F.filter(F.zip_with(F.split("word", ""), F.split("term", ""), lambda x, y: F.when(x != y, x)), lambda x: x.isNotNull())
    short = fit.where(size <= 2).select("word", "term", F.explode(changed).alias("syllable"))
    known = short.join(syllables, "syllable").where("other <> word").select("word", "term").distinct()
    kept = fit.join(known, ["word", "term"], "left_anti")
    best = Window.partitionBy("word").orderBy(F.desc("majority"), "diff", "term")
    return kept.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("word", "term", "n", "majority")


def label_kind(c: Column) -> Column:
    """``core`` or ``belief`` for a region's label, also where a letter or two was misread; else null."""
    bare = F.regexp_replace(text_of(c), "[^가-힣]", "")
    near = lambda word, ratio: jamo_edit_ratio(bare, F.lit(word)) <= ratio
    return F.when(bare == "", None).when(bare.rlike("핵심|내용") | near("핵심내용", 0.35), "core").when(bare.rlike("신념|념화") | near("신념화", 0.4), "belief")


# ---- Fixed values -------------------------------------------------------------------------------------------------
WHY_CHAIN, WHY_TIME = "워터마크(사선으로 이어진 이름·날짜)", "워터마크(날짜·시각)"
WHY_DATE, WHY_CLOCK = "워터마크(다른 곳의 워터마크와 같은 날짜)", "워터마크(시각)"
WHY_WORD, WHY_NUMBER = "워터마크 낱말(다른 곳의 워터마크에서 확인됨)", "워터마크 숫자 조각(문장 사이에 홀로 끼어듦)"
PARTICLE_TAIL = r"(은|는|이|가|을|를|에|의|와|과|도|로|으로|에서|에게|께서|이다|이며|이고|이나|만)$"
UNIT_WORD = r"^(년|월|일|조|항|호|개|명|차|시|분|가지|번째|세기|개국|만)(의|에|은|는|이|가|을|를|로|과|와)?[,.]?$"
# -------------------------------------------------------------------------------------------------------------------


def strip_learned(c: Column, words: Column, digits: Column, protected: Column) -> Column:
    """``struct<text, removed: array<struct<from, why>>>``: the line without words and numbers known from watermarks, where
    they stand apart from the sentence.

    words, digits, protected: arrays; protected words occur in the text with particles, so they go only next to other
    pieces of a watermark.
    """
    tokens = lambda text: F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")

    def judged(all_: Column) -> Column:
        mark = lambda x: F.coalesce(F.contains(x, F.lit("/")) | F.array_contains(words, F.regexp_replace(x, "/", "")) | F.array_contains(digits, x), F.lit(False))
        at = lambda i: F.when((i >= 0) & (i < F.size(all_)), F.get(all_, i))

        def goes(x: Column, i: Column) -> Column:
            bare = F.regexp_replace(x, r"^[/|]+|[/|]+$", "")
            # Of words in a row all but the last have a piece behind them and go, so none of them is left before the next.
            before = mark(at(i - 1)) & ~F.coalesce(F.array_contains(words, F.regexp_replace(at(i - 1), r"^[/|]+|[/|]+$", "")), F.lit(False))
            apart = (bare != x) | (F.size(all_) == 1) | before | mark(at(i + 1)) | (~F.array_contains(protected, bare) & ~bare.rlike(PARTICLE_TAIL))
            return F.struct(x.alias("x"), (F.array_contains(words, bare) & apart).alias("gone"))

        return F.transform(all_, goes)

    def numbers(all_: Column) -> Column:
        def goes(x: Column, i: Column) -> Column:
            before, after = F.when(i > 0, F.get(all_, i - 1)), F.get(all_, i + 1)
            between = F.coalesce(before.rlike("[가-힣]$"), F.lit(False)) | F.coalesce(after.rlike("^[가-힣]"), F.lit(False))
            gone = x.rlike("^[0-9:]{2,5}$") & F.array_contains(digits, x) & (F.contains(x, F.lit(":")) | (between & ~F.coalesce(after.rlike(UNIT_WORD), F.lit(False))))
            return F.struct(x.alias("x"), F.coalesce(gone, F.lit(False)).alias("gone"))

        return F.transform(all_, goes)

    left = lambda tokens: F.transform(F.filter(tokens, lambda t: ~t["gone"]), lambda t: t["x"])
    gone = lambda tokens, why: F.transform(F.filter(tokens, lambda t: t["gone"]), lambda t: F.struct(F.trim(t["x"]).alias("from"), F.lit(why).alias("why")))
    both = lambda first: let(numbers(left(first)), lambda second: F.struct(F.array_join(left(second), " ").alias("text"), F.concat(gone(first, WHY_WORD), gone(second, WHY_NUMBER)).alias("removed")))
    # A line that holds none of them stays as it is, but for white space.
    met = lambda known, text: F.exists(known, lambda x: F.contains(text, x))
    same = lambda text: F.struct(F.array_join(tokens(text), " ").alias("text"), F.array().cast("array<struct<from:string,why:string>>").alias("removed"))
    return let(text_of(c), lambda text: F.when(met(words, text) | met(digits, text), let(let(tokens(text), judged), both)).otherwise(same(text)))


def clean_lines(lines: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``doc_id, line_no, line, clean, dropped``: watermarks first, then page numbers, noise and bullets, terms last.

    ``dropped`` is the reason for which a line goes (``clean`` is null then). terms: word, term; a small table, see
    :func:`term_map`; it is applied to whole words.
    """
    stripped = lines.withColumn("_s", strip_printed_marks(F.col("line")))
    reason = F.when((F.trim(text_of(F.col("line"))) != "") & (F.col("_s") == ""), "watermark").when(is_page_number(F.col("_s")), "pageNumber").otherwise(noise_reason(F.col("_s")))
    rows = stripped.withColumn("dropped", reason).withColumn("clean", F.when(F.col("dropped").isNull(), normalize_bullets(F.col("_s")))).drop("_s")
    if terms is None:
        return rows
    words = rows.select("doc_id", "line_no", F.posexplode(F.split("clean", " ")).alias("n", "word"))
    words = words.withColumn("stem", strip_particle(F.regexp_replace("word", r"^[^가-힣0-9A-Za-z]+|[^가-힣0-9A-Za-z]+$", "")))
    fixed = words.join(terms.select(F.col("word").alias("stem"), "term"), "stem", "left")
    fixed = fixed.withColumn("word", F.when(F.col("term").isNotNull(), F.replace("word", F.col("stem"), F.col("term"))).otherwise(F.col("word")))
    whole = fixed.groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w")).select("doc_id", "line_no", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("_fixed"))
    return rows.join(whole, ["doc_id", "line_no"], "left").withColumn("clean", F.coalesce("_fixed", "clean")).drop("_fixed")
