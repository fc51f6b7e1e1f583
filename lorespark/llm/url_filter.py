"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule is an action, a host and a path prefix. It fits its host and all subdomains where the URL's path starts with its
path; the longest fitting rule (host and path together) decides. URLs that a rule decides are also the labelled ones on
which the trees are trained, on everything but the rule itself: lengths, depth, digit ratio, entropy, parameter counts
and statistics of the host's suffix. The other URLs get the trees' verdict. The suffix statistics are those of all pages
(share) and of all pages that a rule decides (rate of blocked ones); only the trees learn from a bounded sample of
distinct URLs.

A null URL or one without ``://`` has an empty host and path, and features of an empty string. Repeated rows get equal
verdicts. Without labelled URLs of both kinds the verdict is that of the only kind, or allow. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.scratch import Workspace

#: (action, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The trees learn from so many distinct labelled URLs at most, those with the least hash.
MAX_LABELLED = 20_000
#: Up to so many suffixes (counted), their statistics are broadcast; more are joined by shuffle.
BROADCAST_SUFFIXES = 20_000
TREES = 10
DEPTH = 4
BLOCK_FROM = 0.5

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "host_labels", "path_depth", "digit_ratio", "host_hyphens",
    "entropy", "parameters", "has_fragment", "has_extension", "suffix_length", "suffix_share", "suffix_block_rate",
)


def after_scheme(url: str = "url") -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))


def host_of(url: str = "url") -> Column:
    host = F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of() -> Column:
    return F.substring_index("host", ".", -1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """A struct of the longest fitting rule's text and action; null if none fits."""
    chosen = F.lit(None).cast("struct<rule:string,action:string>")
    for action, name, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(action).alias("action"))).otherwise(chosen)
    return chosen


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)).cast("double"))
    n = F.greatest(F.size(letters), F.lit(1)).cast("double")
    return F.aggregate(counts, F.lit(0.0), lambda total, k: total - k / n * F.log2(k / n))


def lexical(pages: DataFrame) -> DataFrame:
    """pages: url, host, path. Adds the features that need no training."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = lambda c: F.length(c).cast("double")
    return pages.withColumns({
        "url_length": size(url),
        "host_length": size(F.col("host")),
        "path_length": size(F.col("path")),
        "query_length": size(query),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "path_depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
        "digit_ratio": size(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(size(url), F.lit(1.0)),
        "host_hyphens": size(F.regexp_replace("host", "[^-]", "")),
        "entropy": _entropy(F.concat("host", "path")),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
        "has_fragment": url.contains("#").cast("double"),
        "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "suffix": suffix_of(),
        "suffix_length": size(suffix_of()),
    })


def suffix_counts(named: DataFrame) -> DataFrame:
    """named: host, _rule. Per suffix, its pages, those that a rule decides and those that one blocks."""
    blocked = F.count_if(F.col("_rule.action") == "block")
    return named.groupBy(suffix_of().alias("suffix")).agg(F.count("*").alias("pages"), F.count("_rule").alias("ruled"), blocked.alias("blocked"))


def judged(pages: DataFrame, rules: tuple = RULES, max_labelled: int = MAX_LABELLED, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every page."""
    named = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url")).withColumn("host", host_of()).withColumn("path", path_of())
    named = named.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    result = [F.col("page_id"), F.col("host"), F.col("path"), F.col("_rule.rule").alias("rule")]

    work = Workspace(pages.sparkSession, "urls")
    suffixes = work.write(suffix_counts(named), "suffixes")
    total = suffixes.agg(F.count("*").alias("suffixes"), F.sum("pages").alias("pages"), F.sum("ruled").alias("ruled"), F.sum("blocked").alias("blocked")).first()
    if not total.ruled or total.blocked in (0, total.ruled):
        only = "block" if total.blocked else "allow"
        return named.select(*result, F.coalesce("_rule.action", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("block_score"))

    mean = total.blocked / total.ruled
    statistics = suffixes.select("suffix", (F.col("pages") / total.pages).alias("suffix_share"), ((F.col("blocked") + 10 * mean) / (F.col("ruled") + 10)).alias("suffix_block_rate"))
    statistics = F.broadcast(statistics) if total.suffixes <= BROADCAST_SUFFIXES else statistics
    with_suffix = lambda rows: rows.join(statistics, "suffix")
    labelled = named.where("_rule is not null").select("url").distinct().orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    labelled = labelled.withColumn("host", host_of()).withColumn("path", path_of())
    labelled = labelled.withColumn("label", (rule_of(F.col("host"), F.col("path"), rules)["action"] == "block").cast("double"))
    labelled = work.write(lexical(labelled), "labelled")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trainer = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1, maxBins=32)
    model = trainer.fit(assembler.transform(with_suffix(labelled)).select("features", "label"))
    scored = model.transform(assembler.transform(with_suffix(lexical(named))))
    block = vector_to_array("probability")[1]
    verdict = F.coalesce("_rule.action", F.when(block >= BLOCK_FROM, "block").otherwise("allow"))
    return scored.select(*result, verdict.alias("verdict"), block.alias("block_score"))


def op7(pages: DataFrame) -> DataFrame:
    """The contract's columns, through :func:`judged`."""
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
