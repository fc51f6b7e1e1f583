"""Similarity of short texts: multisets of bigrams as arrays of ``gram#occurrence``, and jamo edit ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.korean import to_jamo
from lorespark.functions.text import let, normalize_text


def pieces_of_key(key: Column, size: int) -> Column:
    """All substrings of a length, in order: what a look ahead from every character finds, in one pass of a pattern."""
    return F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def pieces(text: Column, size: int) -> Column:
    """All substrings of a length of the normalised text."""
    return let(normalize_text(text), lambda k: pieces_of_key(k, size))


def bigrams(text: Column) -> Column:
    """Bigrams of the normalised text, each with its number among equal ones, so that sets act as multisets.

    For sentences: the numbers take time in the square of the length. Whole tables of texts go by :func:`gram_rows`.
    """
    number = lambda all_, g, i: F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda x: x == g)).cast("string")
    return let(pieces(text, 2), lambda all_: F.transform(all_, lambda g, i: F.concat(g, F.lit("#"), number(all_, g, i))))


def similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigram multisets; equality of the keys where neither has a bigram."""

    def dice(x: Column) -> Column:
        total = F.size(x["a"]) + F.size(x["b"])
        return F.when(total == 0, (normalize_text(a) == normalize_text(b)).cast("double")).otherwise(2.0 * F.size(F.array_intersect(x["a"], x["b"])) / total)

    return let(F.struct(bigrams(a).alias("a"), bigrams(b).alias("b")), dice)


def containment(a: Column, b: Column) -> Column:
    """The share of a's bigrams that b has; substring where a has none."""

    def share(x: Column) -> Column:
        return F.when(F.size(x["a"]) == 0, F.contains(normalize_text(b), normalize_text(a)).cast("double")).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(x["a"]))

    return let(F.struct(bigrams(a).alias("a"), bigrams(b).alias("b")), share)


def gram_rows(texts: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """``id, gram, occ``: a row for each bigram of each text, numbered among equal ones."""
    rows = texts.select(F.col(id_column).alias("id"), F.posexplode(pieces(F.col(text), 2)).alias("i", "gram"))
    return rows.select("id", "gram", F.row_number().over(Window.partitionBy("id", "gram").orderBy("i")).alias("occ"))


def jamo_edit_ratio(a: Column, b: Column) -> Column:
    ja, jb = to_jamo(a), to_jamo(b)
    longer = F.greatest(F.length(ja), F.length(jb))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.levenshtein(ja, jb) / longer)


def fuzzy_includes(needle: Column, haystack: Column, ratio: float = 0.34, longest: int | None = 40) -> Column:
    """Whether a window of the haystack, as long as the needle or one more or less, is close to it. longest: of needles that are
    compared so (None: any)."""
    k, h = normalize_text(needle), normalize_text(haystack)
    n, m = F.length(k), F.length(h)

    def window_near(size: Column) -> Column:
        places = F.when(m >= size, F.sequence(F.lit(1), F.greatest(m - size + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda i: jamo_edit_ratio(k, F.substring(h, i, size)) <= ratio)

    near = (F.lit(True) if longest is None else n <= longest) & F.exists(F.array(F.greatest(n - 1, F.lit(1)), n, n + 1), window_near)
    return F.when(n == 0, F.lit(False)).when(F.contains(h, k), F.lit(True)).otherwise(near)


def term_supported(term: Column, excerpt: Column) -> Column:
    """Whether an excerpt has a term, but for a letter or two misread, however long the term is."""
    return fuzzy_includes(term, excerpt, longest=None)


def is_grounded(text: Column, excerpt: Column, context: Column, least: float = 0.6) -> Column:
    return (containment(text, excerpt) >= least) | (containment(text, context) >= min(0.85, least + 0.2))


def similar_pairs(texts: DataFrame, threshold: float, id_column: str = "id", text: str = "text") -> DataFrame:
    """``a, b, similarity`` of all pairs at or above the threshold: an equi-join on bigrams, pruned by length.

    A pair at the threshold t has lengths in a ratio of t/(2-t) at least.
    """
    grams = gram_rows(texts, id_column, text).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    left, right = (grams.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), "gram", "occ") for s in ("a", "b"))
    ratio = threshold / (2 - threshold)
    near = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * ratio)
    common = left.join(right, ["gram", "occ"]).where(near).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common"))
    return common.select("a", "b", (2.0 * F.col("common") / (F.col("n_a") + F.col("n_b"))).alias("similarity")).where(F.col("similarity") >= threshold)


def contained_share(items: DataFrame, contexts: DataFrame, item: str = "item", context: str = "context") -> DataFrame:
    """``id, context_id, contained``: the share of each item's bigrams that each context has, where they have any in common.

    items: id, text; contexts: context_id, text. Rows with one context_id are one context; no bigram spans two of its
    rows. An item that has nothing in common with any context has one row, with a null context_id and 0.0 (null if it
    has no bigrams).
    """
    counts = lambda rows, key, text, n: rows.select(key, F.explode(pieces(F.col(text), 2)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias(n))
    own = counts(items, "id", item, "n_item")
    common = counts(contexts, "context_id", context, "n_context").join(own, "gram").groupBy("id", "context_id").agg(F.sum(F.least("n_item", "n_context")).alias("common"))
    sizes = items.select("id").distinct().join(own.groupBy("id").agg(F.sum("n_item").alias("n")), "id", "left")
    return sizes.join(common, "id", "left").select("id", "context_id", (F.coalesce("common", F.lit(0)) / F.col("n")).alias("contained"))


def first_by_key(rows: DataFrame, key: Column, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Rows whose key appears for the first time, in the given order."""
    window = Window.partitionBy(*(within or []), key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
