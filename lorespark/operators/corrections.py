"""Batches of requests to an outside service, its replies joined back, and proposed corrections applied page by page.

The service itself is outside: requests leave as rows with a batch number, replies come back as a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import text_of
from lorespark.operators.alignment import judge_change

# ---- Fixed values -------------------------------------------------------------------------------------------------
BATCH_ROWS, BATCH_CHARS = 15, 12_000
REASON_CHARS = 80
NOT_FOUND = "원문에서 해당 부분을 찾지 못함"
# -------------------------------------------------------------------------------------------------------------------


def request_batches(requests: DataFrame, group: str, order: list[str], text: str = "text", most_rows: int = BATCH_ROWS, most_chars: int = BATCH_CHARS) -> DataFrame:
    """The requests with ``batch``, from 0 in each group: in order, a batch takes what still fits both limits.

    A request longer than ``most_chars`` is a batch of its own. One pass along sorted partitions carries the open batch's
    number, rows and characters, however many requests a group has. The order is whole: ties make the result depend on
    the other columns of ``order`` only. A null group is a group.
    """
    size = "_size"
    rows = requests.withColumn(size, F.length(text_of(F.col(text))).cast("long"))
    names = requests.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, n, chars = object(), 0, 0, 0
        for frame in frames:
            numbers = []
            for key, length in zip(frame[group].where(frame[group].notna(), None), frame[size], strict=True):
                if key != at:
                    at, batch, n, chars = key, 0, 0, 0
                elif n and (n >= most_rows or chars + length > most_chars):
                    batch, n, chars = batch + 1, 0, 0
                n, chars = n + 1, chars + length
                numbers.append(batch)
            yield frame[names].assign(batch=pd.Series(numbers, index=frame.index, dtype="int32"))

    fields = ", ".join(f"`{n}` {k}" for n, k in requests.dtypes)
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, fields + ", batch int")


def first_responses(requests: DataFrame, responses: DataFrame, valid: Column | None = None, group: str = "group_id") -> DataFrame:
    """The requests with ``answer``: the first valid response to each, null where there is none.

    requests: group, batch, request_id; responses: group, batch, ord, request_id, answer. A response counts for a request
    of its own batch only; ``valid`` looks at the columns of ``responses`` (all are valid if it is left out).
    """
    keys = [group, "batch", "request_id"]
    kept = responses if valid is None else responses.where(valid)
    first = kept.groupBy(*keys).agg(F.min_by(F.struct("answer"), F.struct("ord", "answer"))["answer"].alias("answer"))
    return requests.join(first, keys, "left")


def proposals(changes: DataFrame) -> DataFrame:
    """Proposed changes in a regular form: without those that lack a side; page 1 where none is named; confidence ``high``
    unless ``low``; short reasons. changes: group_id, ord, page, raw, corrected, confidence, reason."""
    page = F.coalesce(F.nullif(F.col("page").cast("int"), F.lit(0)), F.lit(1))
    sure = F.when(F.col("confidence") == "low", "low").otherwise("high")
    kept = changes.where(F.col("raw").isNotNull() & F.col("corrected").isNotNull())
    return kept.select("group_id", "ord", page.alias("page"), "raw", "corrected", sure.alias("confidence"), F.substring(text_of(F.col("reason")), 1, REASON_CHARS).alias("reason"))


def _tried(text: str, changes: list) -> tuple[str, list[tuple]]:
    """The text with what is applied, and per change (ord, outcome, from, to, at)."""
    spans, outcomes, cursor = [], [], 0
    for change in changes:
        letters = "".join(change["raw"].split())
        pattern = re.compile(r"\s*".join(map(re.escape, letters)))
        found = (pattern.search(text, cursor) or pattern.search(text)) if letters else None
        if not found or any(found.start() < b and a < found.end() for a, b, _ in spans):
            outcomes.append((change["ord"], "missing", change["raw"], change["corrected"], None))
            continue
        if change["verdict"] == "apply":
            spans.append((*found.span(), change["corrected"]))
            cursor = found.end()
        outcome = {"apply": "applied", "confirm": "uncertain"}.get(change["verdict"], "rejected")
        outcomes.append((change["ord"], outcome, found[0], change["corrected"], found.start()))
    out, at = [], 0
    for a, b, put in sorted(spans):
        out += [text[at:a], put]
        at = b
    return "".join([*out, text[at:]]), outcomes


OUTCOMES = "array<struct<ord:int,outcome:string,from:string,to:string,at:int>>"


def corrected_pages(pages: DataFrame, replies: DataFrame, changes: DataFrame) -> DataFrame:
    """``group_id, page, raw, final, outcomes, status``: pages with the corrections proposed for their group.

    pages: group_id, page (from 1), text; replies: group_id, configured, error; changes: as :func:`proposals` takes them.
    A group's status is ``empty`` without any text, ``unavailable`` where the service is not configured or did not reply,
    ``failed`` where it reported an error, else ``ai``; only then are changes tried, in their order. A change is looked
    for behind the last applied one, then from the start, white space aside; what is not there or overlaps an applied one
    is ``missing``. The rest is judged (on the text as proposed): ``applied``, ``uncertain`` or ``rejected``.
    """
    group = Window.partitionBy("group_id")
    rows = pages.select("group_id", "page", text_of(F.col("text")).alias("raw"))
    rows = rows.withColumn("some", F.max(F.col("raw").rlike(r"\S")).over(group)).join(replies.select("group_id", "configured", "error"), "group_id", "left")
    status = F.when(~F.col("some"), "empty").when(~F.coalesce("configured", F.lit(False)), "unavailable").when(F.col("error").isNotNull(), "failed").otherwise("ai")
    rows = rows.select("group_id", "page", "raw", status.alias("status"))
    judged = proposals(changes).withColumn("verdict", judge_change(F.col("raw"), F.col("corrected"), F.col("confidence")))
    todo = judged.groupBy("group_id", "page").agg(F.sort_array(F.collect_list(F.struct("ord", "raw", "corrected", "verdict"))).alias("todo"))
    todo = rows.where("status = 'ai'").select("group_id", "page").join(todo, ["group_id", "page"])
    rows = rows.join(todo, ["group_id", "page"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [_tried(t, [] if c is None else list(c)) for t, c in zip(frame["raw"], frame["todo"], strict=True)]
            yield frame[["group_id", "page", "raw", "status"]].assign(final=[m[0] for m in made], outcomes=[[dict(zip(("ord", "outcome", "from", "to", "at"), o, strict=True)) for o in m[1]] for m in made])

    kind = dict(pages.dtypes)
    return rows.mapInPandas(run, f"group_id {kind['group_id']}, page {kind['page']}, raw string, status string, final string, outcomes {OUTCOMES}").select("group_id", "page", "raw", "final", "outcomes", "status")


def correction_log(corrected: DataFrame, changes: DataFrame) -> DataFrame:
    """``group_id, page, ord, outcome, from, to, why``: a row for each change that was tried."""
    rows = corrected.select("group_id", "page", F.explode("outcomes").alias("o")).select("group_id", "page", "o.ord", "o.outcome", "o.from", "o.to")
    rows = rows.join(proposals(changes).select("group_id", "page", "ord", "reason"), ["group_id", "page", "ord"])
    return rows.select("group_id", "page", "ord", "outcome", "from", "to", F.when(F.col("outcome") == "missing", NOT_FOUND).otherwise(F.nullif("reason", F.lit(""))).alias("why"))


def correction_status(corrected: DataFrame) -> DataFrame:
    """``group_id, status, pages, applied, uncertain, rejected, message`` of each group."""
    count = lambda *names: F.sum(F.size(F.filter("outcomes", lambda o: o["outcome"].isin(*names))))
    found = corrected.groupBy("group_id").agg(
        F.max("status").alias("status"), F.count("*").alias("pages"), count("applied").alias("applied"), count("uncertain").alias("uncertain"), count("rejected", "missing").alias("rejected")
    )
    some = F.concat(F.format_string("AI 문맥 보정 %d곳 적용", "applied"), F.when(F.col("uncertain") > 0, F.format_string(" · 확인 필요 %d곳", "uncertain")).otherwise(""))
    message = (
        F.when(F.col("status") == "empty", "")
        .when(F.col("status") != "ai", "AI 분석을 사용할 수 없어 기본 분석으로 생성했습니다. (OCR 원문을 그대로 사용합니다)")
        .when((F.col("applied") > 0) | (F.col("uncertain") > 0), some)
        .otherwise("AI가 확인한 결과 고칠 OCR 오류가 없습니다.")
    )
    return found.withColumn("message", message)


def suggestion_applied(text: Column, from_: Column, to: Column) -> Column:
    """The text with the first place that reads as ``from_`` (white space aside) put to ``to``."""
    letters = F.filter(F.split(F.regexp_replace(text_of(from_), r"\s+", ""), ""), lambda x: x != "")
    pattern = F.array_join(F.transform(letters, lambda x: F.regexp_replace(x, r"([\\.*+?^$|(){}\[\]])", r"\\$1")), r"\s*")
    found = F.coalesce(F.regexp_substr(text, pattern), F.lit(""))
    at = F.instr(text, found)
    done = F.concat(F.substring(text, F.lit(1), at - 1), to, F.substring(text, at + F.length(found), F.length(text)))
    return F.when((F.size(letters) > 0) & (found != ""), done).otherwise(text)
