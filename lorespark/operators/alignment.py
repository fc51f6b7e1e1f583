"""Sequence alignment and consensus of several readings of the same lines; judging and applying corrections.

Alignment is dynamic programming over the lines of one page or region, so a page's lines meet in one task.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.korean import strip_particle, to_jamo
from lorespark.functions.similarity import containment, jamo_edit_ratio, similarity
from lorespark.functions.text import let, normalize_text, text_of

# ---- Fixed values -------------------------------------------------------------------------------------------------
ALIGN_FROM = 0.45
COVERED_FROM = 0.9
JOIN_FROM = 0.35
#: Share of the likeness to the other readings in a line's worth; the rest is its score.
LIKENESS = 0.6
LONELY_CONFIDENCE, LONELY_QUALITY, LEAST_QUALITY = 75, 0.7, 0.35
#: Letters that stand for digits in tokens with digits, and the digits.
LOOKALIKES, LOOKALIKE_DIGITS = "lI|ㅣOoㅇSBZg", "11110005829"
# -------------------------------------------------------------------------------------------------------------------


def dice(a: str, b: str) -> float:
    """Dice coefficient of the bigrams of two normalised texts."""
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else float(a == b)


def best_path(a: list[str], b: list[str], least: float, prefer: str) -> list[tuple[int | None, int | None]]:
    """Pairs of positions of an alignment with the highest total similarity; gaps cost nothing.

    ``prefer`` orders the moves among equals: d(iagonal), u(p: a alone), l(eft: b alone).
    """
    import numpy as np

    similar = np.array([[dice(x, y) for y in b] for x in a]).reshape(len(a), len(b))
    score = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            match = score[i - 1, j - 1] + similar[i - 1, j - 1] if similar[i - 1, j - 1] >= least else -1.0
            score[i, j] = max(score[i - 1, j], score[i, j - 1], match)
    out, i, j = [], len(a), len(b)
    while i or j:
        moves = {
            "d": i and j and similar[i - 1, j - 1] >= least and score[i, j] == score[i - 1, j - 1] + similar[i - 1, j - 1],
            "u": i and score[i, j] == score[i - 1, j],
            "l": j and score[i, j] == score[i, j - 1],
        }
        move = next(m for m in prefer if moves[m])
        i, j = i - (move in "du"), j - (move in "dl")
        out.append((i if move in "du" else None, j if move in "dl" else None))
    return out[::-1]


def aligned(left: DataFrame, right: DataFrame, keys: list[str], least: float = ALIGN_FROM) -> DataFrame:
    """``*keys, pos, left_no, right_no``: the lines of two readings of each page, aligned, in order; null where a line stands alone.

    left, right: keys, line_no, line. A match must be strictly better than leaving both lines alone.
    """

    def align(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("line_no"), b.sort_values("line_no")
        path = best_path(a["key"].tolist(), b["key"].tolist(), least, "uld")
        an, bn = a["line_no"].tolist(), b["line_no"].tolist()
        rows = [(*key, n, None if i is None else an[i], None if j is None else bn[j]) for n, (i, j) in enumerate(path)]
        return pd.DataFrame(rows, columns=[*keys, "pos", "left_no", "right_no"]).astype({"left_no": "Int64", "right_no": "Int64"})

    keyed = lambda t: t.select(*keys, "line_no", normalize_text(F.col("line")).alias("key"))
    kinds = dict(left.dtypes)
    fields = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return keyed(left).groupBy(*keys).cogroup(keyed(right).groupBy(*keys)).applyInPandas(align, f"{fields}, pos int, left_no bigint, right_no bigint")


def align_pages(left: DataFrame, right: DataFrame, page: str = "page", least: float = ALIGN_FROM) -> DataFrame:
    """``page, left_no, right_no``: as :func:`aligned`, for pages named by one column."""
    return aligned(left, right, [page], least).drop("pos")


def grouped_readings(readings: DataFrame, page: str = "page", least: float = JOIN_FROM) -> DataFrame:
    """Lines of several readings of each page with the number ``grp`` of the line that they read.

    readings: page, variant, line_no, line, score. The best reading comes first, the others are aligned into its groups.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.groupby("variant")["score"].mean().sort_values(ascending=False, kind="stable").index
        groups: list[list[int]] = []
        for variant in order:
            own = pdf[pdf["variant"] == variant].sort_values("line_no")
            heads = [pdf.at[g[0], "key"] for g in groups]
            merged = []
            for i, j in best_path(heads, own["key"].tolist(), least, "dul"):
                merged.append((groups[i] if i is not None else []) + ([own.index[j]] if j is not None else []))
            groups = merged
        number = {row: k for k, g in enumerate(groups) for row in g}
        return pdf.assign(grp=pdf.index.map(number)).drop(columns="key")

    fields = ", ".join(f"{n} {k}" for n, k in readings.dtypes)
    return readings.withColumn("key", normalize_text(F.col("line"))).groupBy(page).applyInPandas(group, fields + ", grp int")


def consensus(grouped: DataFrame, lexicon: DataFrame, page: str = "page") -> DataFrame:
    """``page, grp, line, agree``: one line per group, voted word by word where the readings have as many words.

    grouped: page, grp, variant, line, score. Ties go to words whose stems are frequent in the lexicon (stem, n), then to
    the better line. Of readings with different numbers of words, the one is taken that is most like the others and best
    scored; a group has one reading of each variant at most.
    """
    tokens = F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != "")
    whole = Window.partitionBy(page, "grp")
    rows = grouped.withColumn("tokens", tokens).withColumn("n_tokens", F.size("tokens"))
    rows = rows.withColumn("even", F.min("n_tokens").over(whole) == F.max("n_tokens").over(whole)).withColumn("agree", F.count("*").over(whole))
    words = rows.where("even").select(page, "grp", "agree", "score", F.posexplode("tokens").alias("pos", "word"))
    votes = words.groupBy(page, "grp", "agree", "pos", "word").agg(F.count("*").alias("votes"), F.max("score").alias("best"))
    votes = votes.withColumn("stem", strip_particle(F.col("word"))).join(lexicon.select("stem", "n"), "stem", "left")
    first = F.row_number().over(Window.partitionBy(page, "grp", "pos").orderBy(F.desc("votes"), F.desc(F.coalesce("n", F.lit(0))), F.desc("best"), "word"))
    voted = votes.withColumn("_n", first).where("_n = 1").groupBy(page, "grp", "agree").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    voted = voted.select(page, "grp", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("line"), "agree")
    readings = rows.where("not even").groupBy(page, "grp", "agree").agg(F.sort_array(F.collect_list(F.struct("variant", "line", "score"))).alias("all"))

    def weighed(own: Column, i: Column) -> Column:
        likeness = F.aggregate(F.transform("all", lambda o, k: F.when(k != i, similarity(own["line"], o["line"])).otherwise(0.0)), F.lit(0.0), lambda total, x: total + x)
        worth = LIKENESS * likeness / (F.size("all") - 1) + (1 - LIKENESS) * own["score"]
        return F.struct(worth.alias("worth"), (-i).alias("place"), own["line"].alias("line"))

    single = readings.select(page, "grp", F.array_max(F.transform("all", weighed))["line"].alias("line"), "agree")
    return voted.unionByName(single)


def kept_lines(merged: DataFrame, variants: Column, confidence: Column, quality: Column, agree: Column) -> DataFrame:
    """Merged lines without those that only one of several readings has, unsure or ill-formed, and without the worst."""
    lonely = (variants >= 2) & (agree == 1) & ((confidence < LONELY_CONFIDENCE) | (quality < LONELY_QUALITY))
    return merged.where(~lonely & (quality >= LEAST_QUALITY))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"\D", "")


def lookalike_digits(c: Column) -> Column:
    """The digits of a text, letters that look like digits counted in tokens that have a digit."""
    tokens = F.transform(F.split(text_of(c), r"\s+"), lambda w: F.when(w.rlike("[0-9]"), F.translate(w, LOOKALIKES, LOOKALIKE_DIGITS)).otherwise(w))
    return digits_of(F.array_join(tokens, " "))


def judge_change(raw: Column, corrected: Column, confidence: Column) -> Column:
    """``apply``, ``confirm`` or ``reject`` for a proposed correction; the first rule that fits decides."""

    def rules(x: Column) -> Column:
        growth = F.length(x["new"]) - F.length(x["old"])
        return (
            F.when((x["from"] == "") | (F.trim(text_of(corrected)) == ""), "reject")
            .when(x["from"] == x["to"], "apply")
            .when(growth > F.greatest(F.lit(3.0), F.length(x["old"]) * 0.25), "reject")
            .when(x["ratio"] > 0.45, "reject")
            .when((digits_of(raw) != digits_of(corrected)) & (lookalike_digits(raw) != digits_of(corrected)), "confirm")
            .when(confidence == "low", "confirm")
            .when(x["ratio"] > 0.3, "confirm")
            .otherwise("apply")
        )

    parts = F.struct(normalize_text(raw).alias("from"), normalize_text(corrected).alias("to"), to_jamo(raw).alias("old"), to_jamo(corrected).alias("new"), jamo_edit_ratio(raw, corrected).alias("ratio"))
    return let(parts, rules)


def apply_changes(pages: DataFrame, changes: DataFrame, page: str = "page") -> DataFrame:
    """``page, text, applied``: the changes made in each page's text, left to right, none inside another.

    pages: page, text; changes: page, ord, from, to. A change is looked for behind the last one first, then from the
    start; what is not found or would overlap is left out. White space may differ.
    """
    import re

    def apply(text: str | None, todo: list | None) -> tuple[str, int]:
        text, spans, cursor = text or "", [], 0
        for change in todo or []:
            pattern = r"\s*".join(map(re.escape, "".join((change["from"] or "").split())))
            if not pattern:
                continue
            found = re.compile(pattern)
            m = found.search(text, cursor) or found.search(text)
            if m and all(m.end() <= a or m.start() >= b for a, b, _ in spans):
                spans.append((m.start(), m.end(), change["to"] or ""))
                cursor = m.end()
        for a, b, put in sorted(spans, reverse=True):
            text = text[:a] + put + text[b:]
        return text, len(spans)

    def run(frames):
        for frame in frames:
            made = [apply(t, list(c) if c is not None else None) for t, c in zip(frame["text"], frame["todo"], strict=True)]
            yield pd.DataFrame({page: frame[page], "text": [m[0] for m in made], "applied": [m[1] for m in made]})

    todo = changes.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("ord", "from", "to"))).alias("todo"))
    kind = dict(pages.dtypes)[page]
    return pages.select(page, "text").join(todo, page, "left").mapInPandas(run, f"{page} {kind}, text string, applied int")


def merged_structure(local: DataFrame, other: DataFrame, page: str = "page") -> DataFrame:
    """``page, left_no, right_no, verdict, line``: a second reading's lines merged into the first, none lost unseen.

    local, other: page, line_no, kind, line; other also confidence (high or low). Aligned lines are judged as corrections
    (apply, confirm, reject); lines that only the first reading has are ``restored``; lines that only the second has are
    ``covered`` where they are titles whose words some first line has, else ``unverified``.
    """
    pairs = align_pages(local, other, page)
    left = local.select(page, F.col("line_no").alias("left_no"), F.col("line").alias("own"))
    right = other.select(page, F.col("line_no").alias("right_no"), F.col("line").alias("theirs"), "kind", "confidence")
    rows = pairs.join(left, [page, "left_no"], "left").join(right, [page, "right_no"], "left")
    alone = rows.where("left_no is null").select(page, "right_no", "theirs")
    inside = alone.join(left, page).where(containment(F.col("theirs"), F.col("own")) >= COVERED_FROM).select(page, "right_no").distinct().withColumn("inside", F.lit(True))
    rows = rows.join(inside, [page, "right_no"], "left")
    verdict = (
        F.when(F.col("right_no").isNull(), "restored")
        .when(F.col("left_no").isNull(), F.when(F.col("inside") & F.col("kind").isin("section", "subsection"), "covered").otherwise("unverified"))
        .otherwise(judge_change(F.col("own"), F.col("theirs"), F.col("confidence")))
    )
    rows = rows.withColumn("verdict", verdict)
    kept = F.when(F.col("verdict").isin("apply", "covered"), F.col("theirs")).when(F.col("verdict") == "unverified", F.lit(None)).otherwise(F.col("own"))
    return rows.select(page, "left_no", "right_no", "verdict", kept.alias("line"))
