"""Korean word functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import let, make_blank, normalize_text, text_of

# ---- Fixed values -------------------------------------------------------------------------------------------------
#: Particles in the order in which they are tried.
PARTICLES = (
    "으로부터", "에서부터", "으로써", "으로서", "로서", "로써", "에게서", "이라고", "에서는", "에서도", "에서의",
    "으로는", "이라는", "라는", "에서", "에게", "으로", "부터", "까지", "처럼", "보다", "라고",
    "와는", "과는", "이나", "이란", "이며", "이고", "에는", "에도", "은", "는", "이", "가", "을",
    "를", "에", "의", "와", "과", "도", "만", "로", "란", "나",
)
#: Those that may follow a noun of one syllable.
AFTER_ONE_SYLLABLE = ("를", "는", "에", "와", "에서", "에게", "으로", "에는", "에도", "에서는")
STOPWORDS = (
    "그리고", "그러나", "하지만", "또한", "및", "등", "것", "수", "때", "그", "이", "저", "더", "또",
    "통해", "위해", "대한", "대해", "따라", "의해", "가장", "매우", "모든", "각", "여러", "다른",
    "이후", "이전", "때문", "경우", "중", "후", "전", "현재", "당시", "주로", "특히", "처음", "약",
    "예", "참고", "가령", "예컨대", "반드시", "기억", "중요", "핵심", "주의",
)
GENERIC = (
    "역할", "기능", "부분", "종류", "특징", "구조", "내용", "사람", "관계", "방법", "과정", "상태",
    "정도", "사용", "형태", "모양", "경우", "이유", "결과", "원인", "의미", "개념", "자료", "문장",
)
VERB_ENDINGS = "(다|요|함|됨|져|하고|하며|하여|되어|해서|되고|하는|되는|있는|없는|된|했던|였던|이던|면서|지만|는데|으며|어서|아서)$"
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
WORD_EDGES = r"^[“\"'‘(\[<《「『]+|[”\"'’)\]>》」』.,!?;:·…]+$"
TOPIC_MARKERS = r"^(.+?)(이란|란|은|는)$"
# -------------------------------------------------------------------------------------------------------------------

_FIRST, _LAST = 0xAC00, 0xD7A3


def strip_particle(word: Column) -> Column:
    """The word without brackets, final punctuation, and the first particle on the list that may be taken off."""
    particles = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(p in AFTER_ONE_SYLLABLE).alias("one")) for p in PARTICLES))

    def stem(clean: Column) -> Column:
        rest = lambda x: F.length(clean) - F.length(x["p"])
        fits = F.filter(particles, lambda x: clean.endswith(x["p"]) & ((rest(x) >= 2) | ((rest(x) == 1) & x["one"] & clean.rlike("^[가-힣]"))))
        return F.when(clean.rlike("[가-힣]$"), F.coalesce(F.substring(clean, F.lit(1), rest(F.get(fits, F.lit(0)))), clean)).otherwise(clean)

    return let(F.regexp_replace(text_of(word), WORD_EDGES, ""), stem)


def keyword_candidates(sentence: Column) -> Column:
    """``array<struct<stem, score, generic>>``, best score first, earlier first among equals; in time that is linear but
    for sorting, however long the sentence is."""
    return let(F.filter(F.split(text_of(sentence), r"\s+"), lambda t: t != ""), _ranked)


def _ranked(tokens: Column) -> Column:
    parsed = F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("at"), strip_particle(t).alias("stem"), F.regexp_replace(t, "[.,!?;:]+$", "").alias("bare")))

    def wanted(w: Column) -> Column:
        stem = w["stem"]
        one = (F.length(stem) == 1) & (stem != w["bare"]) & stem.rlike("[가-힣]")
        noun = ((F.length(stem) >= 2) | one) & ~stem.isin(*STOPWORDS) & stem.rlike("[가-힣a-zA-Z0-9]")
        final = (w["at"] == F.size(tokens) - 1) & stem.rlike("[가-힣]$") & w["token"].rlike("[.다]$")
        return noun & (stem.rlike("[0-9]") | ~(stem.rlike(VERB_ENDINGS) | final))

    def scored(w: Column) -> Column:
        stem, generic = w["stem"], w["stem"].isin(*GENERIC)
        half = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0.0))
        score = F.when(F.length(stem) <= 6, F.lit(2.0)).otherwise(F.lit(1.0)) + half(w["at"] == 0, 0.5) + half(stem != w["bare"], 0.5) - half(generic, 1.5)
        numeric = stem.rlike("[0-9]")
        return F.struct((-F.when(numeric, F.lit(4.0)).otherwise(score)).alias("rank"), w["at"].alias("at"), stem.alias("stem"), (generic & ~numeric).alias("generic"))

    rows = F.transform(F.filter(parsed, wanted), scored)
    by_stem = F.array_sort(F.transform(rows, lambda r: F.struct(r["stem"].alias("stem"), r["at"].alias("at"), r.alias("row"))))
    firsts = let(by_stem, lambda all_: F.filter(all_, lambda r, i: (i == 0) | (r["stem"] != F.get(all_, i - 1)["stem"])))
    best = F.array_sort(F.transform(firsts, lambda r: r["row"]))
    return F.transform(best, lambda r: F.struct(r["stem"].alias("stem"), (-r["rank"]).alias("score"), r["generic"].alias("generic")))


def has_batchim(word: Column) -> Column:
    """Whether the word's last sound closes: a final consonant, or a digit that is read with one."""
    last = F.right(F.trim(text_of(word)), F.lit(1))
    code = F.ascii(last)
    return F.when((code >= _FIRST) & (code <= _LAST), (code - _FIRST) % 28 != 0).otherwise(last.rlike("^[013678]$"))


def josa(word: Column, closed: str, open_: str) -> Column:
    return F.concat(word, F.when(has_batchim(word), closed).otherwise(open_))


def to_jamo(c: Column) -> Column:
    """The normalised text with every syllable taken apart into its letters."""

    def apart(x: Column) -> Column:
        code = F.ascii(x) - _FIRST
        first = F.substring(F.lit(INITIALS), F.floor(code / 588).cast("int") + 1, F.lit(1))
        vowel = F.substring(F.lit(VOWELS), F.floor(code % 588 / 28).cast("int") + 1, F.lit(1))
        final = F.when(code % 28 > 0, F.substring(F.lit(FINALS), (code % 28).cast("int"), F.lit(1))).otherwise("")
        return F.when((code >= 0) & (code <= _LAST - _FIRST), F.concat(first, vowel, final)).otherwise(x)

    return F.array_join(F.transform(F.split(normalize_text(c), ""), apart), "")


def is_trivial_answer(answer: Column) -> Column:
    bare = F.trim(text_of(answer))
    return (normalize_text(answer) == "") | bare.isin(*STOPWORDS, *GENERIC, *PARTICLES)


def is_good_blank_answer(answer: Column, sentence: Column, sentence_key_length: Column | None = None) -> Column:
    """sentence_key_length: the length of the normalised sentence, where it is known already."""
    a, n = normalize_text(answer), F.length(normalize_text(sentence)) if sentence_key_length is None else sentence_key_length
    short = (F.length(a) <= 24) & (F.size(F.split(F.trim(answer), r"\s+")) <= 6) & ((n == 0) | (F.length(a) <= n * 0.6))
    return ~is_trivial_answer(answer) & short


def choose_blank(sentence: Column) -> Column:
    """``struct<answer, blank_text>`` of the best keyword that makes a good blank; null where there is none."""
    known = F.struct(keyword_candidates(sentence).alias("all"), F.length(normalize_text(sentence)).alias("n"))

    def good(x: Column) -> Column:
        return F.filter(x["all"], lambda k: ~k["generic"] & is_good_blank_answer(k["stem"], sentence, x["n"]) & F.contains(sentence, k["stem"]))

    return let(F.get(let(known, good), F.lit(0))["stem"], lambda best: F.when(best.isNotNull(), F.struct(best.alias("answer"), make_blank(sentence, best).alias("blank_text"))))


def split_topic(sentence: Column) -> Column:
    """``struct<subject, predicate, marker>`` by a topic marker on one of the first three words."""
    tokens = F.split(text_of(sentence), r"\s+")

    def at(i: int) -> Column:
        word = F.get(tokens, F.lit(i))
        stem, marker = F.regexp_extract(word, TOPIC_MARKERS, 1), F.regexp_extract(word, TOPIC_MARKERS, 2)
        predicate = F.array_join(F.slice(tokens, i + 2, F.greatest(F.size(tokens), F.lit(1))), " ")
        subject = F.array_join(F.concat(F.slice(tokens, 1, i), F.array(stem)), " ")
        fits = (F.size(tokens) > i + 1) & (stem != "") & ~stem.isin(*STOPWORDS) & (F.length(normalize_text(predicate)) >= 4)
        return F.when(fits, F.struct(subject.alias("subject"), predicate.alias("predicate"), marker.alias("marker")))

    return F.coalesce(at(0), at(1), at(2))
