"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, URL schemes, digit openings and identifier cues in one pass over a text;
from each anchor a small deterministic parser walks to the boundaries of the item and validates it. Texts are scanned
whole, in time and memory that grow with their length; a null text counts as empty. Positions are code points, ends
exclusive. Rows are independent of each other, so
there is no shuffle, and repeated rows give repeated results. Extra columns of the input are passed by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorespark.llm.scratch import prepare
from lorespark.llm.words import slices

BASE_KINDS = ("email", "ip", "card", "phone")
#: In the order in which spans with the same start are listed.
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret", "address")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGIT_RUN = re.compile(r"[0-9]++")
CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE_RUN = re.compile(r"[ ().0-9-]++")
URL_REST = re.compile(r"[^\s<>\"'`|]++")
IBAN_RUN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
CUE_GAP = re.compile(r"(?:[ \t]*(?:number|no\.?|num|id|nr\.?|#))?[ \t]*[:=#]?[ \t]*[\"']?", re.IGNORECASE)
ACCOUNT_RUN = re.compile(r"[A-Z0-9](?:[ -]?[A-Z0-9])++")
SECRET_RUN = re.compile(r"[A-Za-z0-9+/_=-]++")
STREET_BEFORE = re.compile(r"([0-9]{1,6}[A-Za-z]?(?: [A-Z][\w'-]*){1,4} )\Z")
WORD_CHAR = re.compile(r"\w")

SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "ws://", "wss://")
ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "social security", "tax id", "customer id", "member id", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "api_key", "api-key", "apikey", "secret", "password", "passwd", "access_key")
STREETS = ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Square", "Court")

RESULT = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    keys = {"@": "at"} | {"+" + d: "plus" for d in "0123456789"} | {d: "digit" for d in "0123456789"}
    for kind, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("iban", ("iban",))):
        keys |= {form: kind for cue in cues for form in (cue, cue.title(), cue.upper(), cue.capitalize())}
    keys |= {street: "street" for street in STREETS}
    for key, kind in keys.items():
        found.add_word(key, (kind, len(key)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, ordered by start, then kind.

    The four base kinds are leftmost and do not overlap within their kind; a candidate that fails validation still
    uses up its characters. The other kinds never change the base ones.
    """
    spans: list[tuple[int, int, int]] = []
    add = lambda kind, a, b: spans.append((a, KINDS.index(kind), b))
    email_end = ip_end = card_end = phone_end = url_end = other_end = 0
    # Ends of runs that were no account or secret. What begins inside such a run ends with it and has no more digits.
    no_account = no_secret = 0
    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= ip_end:
                if m := QUAD.match(text, at):
                    ip_end = m.end()
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
                        add("ip", at, ip_end)
                else:
                    ip_end = DIGIT_RUN.match(text, at).end()
            if at >= card_end:
                m = CARD_RUN.match(text, at)
                card_end = m.end() if m else at + 1
                if m and card_end - at >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, card_end)
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                add("email", start, email_end)
        elif kind == "plus":
            if at >= phone_end and (m := PHONE_RUN.match(text, at + 2)):
                end = m.end()
                while end > at + 3 and text[end - 1] not in "0123456789":
                    end -= 1
                if end > at + 3:
                    phone_end = end
                    if 10 <= sum(c in "0123456789" for c in text[at:end]) <= 15:
                        add("phone", at, end)
        elif kind == "scheme":
            whole = at == 0 or not WORD_CHAR.match(text[at - 1])
            if whole and at >= url_end and (m := URL_REST.match(text, last + 1)):
                end = m.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)]}":
                    end -= 1
                if end > last + 1:
                    url_end = end
                    add("url", at, end)
        elif at >= other_end and (at == 0 or not WORD_CHAR.match(text[at - 1])):
            after = CUE_GAP.match(text, last + 1).end() if kind != "street" else last + 1
            if kind == "iban":
                if (m := IBAN_RUN.match(text, after)) and _iban_ok(m[0]):
                    other_end = m.end()
                    add("iban", after, other_end)
            elif kind == "account":
                if after >= no_account and (m := ACCOUNT_RUN.match(text, after)):
                    if sum(c in "0123456789" for c in m[0]) >= 6:
                        other_end = m.end()
                        add("account", after, other_end)
                    else:
                        no_account = m.end()
            elif kind == "secret":
                if after >= no_secret and (m := SECRET_RUN.match(text, after)):
                    if len(m[0]) >= 16 and any(c in "0123456789" for c in m[0]):
                        other_end = m.end()
                        add("secret", after, other_end)
                    else:
                        no_secret = m.end()
            elif kind == "street" and not WORD_CHAR.match(text[last + 1 : last + 2] or " "):
                floor = max(other_end, at - 80)
                if m := STREET_BEFORE.search(text[floor:at]):
                    other_end = last + 1
                    add("address", floor + m.start(1), other_end)
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by ``[KIND]``; overlapping spans become one mark, that of the first."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_pii(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``documents`` with the counts of base kinds, their digest, and all spans (see module docstring).

    Result columns that exist in the input already are replaced; an empty table gives an empty result.
    """
    prepare(documents.sparkSession)
    names = list(RESULT)
    kept = documents.select([documents[f"`{c}`"] for c in documents.columns if c not in names])
    schema = kept.schema
    result = [T.StructField(n, T.LongType() if n.startswith("n_") else T.StringType()) for n in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = []
            for value in batch.column(text).to_pylist():
                spans = find_spans(value) if value else []
                base = [s for s in spans if s[0] in BASE_KINDS]
                kinds = [s[0] for s in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns, types)], names=[*batch.schema.names, *names])

    return kept.mapInArrow(scan, T.StructType([*schema.fields, *result]))


def redact_pii(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span of ``text`` replaced by ``[KIND]``; null texts stay null, other columns as they are."""
    prepare(documents.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            texts = [t and redact(t, find_spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text, pa.array(texts, batch.schema.field(at).type))

    return documents.mapInArrow(scan, documents.schema)


def op1(documents: DataFrame) -> DataFrame:
    """The contract's digest columns, through :func:`find_pii`."""
    return find_pii(documents.select("doc_id", "text")).select("doc_id", *RESULT)
