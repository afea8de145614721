"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and stops at anchors: at-signs,
plus signs, digits, ``://`` and identifier cues.  From each anchor a local
parser expands to both sides and validates what it finds.

Base kinds (email, ip, card, phone) equal a leftmost, non-overlapping regular
expression search, because each of their matches begins at an anchor or is the
left expansion of one; a match that fails validation is consumed.  The method
adds two kinds: ``account`` (a cue such as ``iban``, ``token`` or ``password``
followed by a validated value) and ``url`` (a URL with user and password).

Scale: a single pass of Arrow batches without any shuffle.

Defined cases: null text is empty text and has no spans; equal rows give equal
spans; an empty table gives an empty result; positions are code points, ends
exclusive; long texts are read whole, in time linear in their length; spans come
with the id alone, so names of other columns cannot clash, and ``redact`` returns
all columns of its input under their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from setforge.llm.shared import as_texts, map_batches

KINDS = ("email", "ip", "card", "phone", "account", "url")
BASE = KINDS[:4]
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Words before a value that name it as an identifier or secret.
CUES = ("account", "acct", "iban", "ssn", "passport", "token", "password", "passwd", "secret", "api_key", "apikey", "api key", "access_key", "license number", "social security", "tax id")

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_BETWEEN = re.compile(r"(?:[ _-](?:number|no|id|key))?\.?[ \t]*(?:[:=#]|\bis\b)[ \t]*[\"']?", re.I)
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_./+~-]{4,}[A-Za-z0-9=]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{2,4}){3,8}")
_USERINFO = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in _DIGITS:
        found.add_word(digit, ("digit", 1))
    for text, tag in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(text, (tag, len(text)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def iban_valid(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The value a cue that ends at ``at`` announces."""
    gap = _BETWEEN.match(text, at)
    if gap is None:
        return None
    iban = _IBAN.match(text, gap.end())
    while iban:
        value = iban[0]
        if iban_valid(value):
            return iban.span()
        cut = value.rfind(" ")
        iban = _IBAN.fullmatch(text, gap.end(), gap.end() + cut) if cut > 0 else None
    value = _VALUE.match(text, gap.end())
    if value and any(c in _DIGITS for c in value[0]):
        return value.span()
    return None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    spans: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = account_end = 0
    for last, (tag, size) in automaton().iter(text):
        if tag == "digit":
            run_starts = last == 0 or text[last - 1] not in _DIGITS
            if not run_starts:
                continue
            if last >= ip_end and (m := _IP.match(text, last)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    spans.append(("ip", last, ip_end))
            if last >= card_end and (m := _CARD.match(text, last)):
                card_end = m.end()
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", last, card_end))
        elif tag == "at":
            if last < email_end:
                continue
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                spans.append(("email", start, email_end))
        elif tag == "plus":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    spans.append(("phone", last, phone_end))
        elif tag == "scheme":
            start = last - 2
            while start > 0 and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            if start < last - 2 and (m := _USERINFO.match(text, last + 1)):
                spans.append(("url", start, m.end()))
        else:
            start = last + 1 - size
            if start >= account_end and (start == 0 or not text[start - 1].isalnum()) and (span := _account(text, last + 1)):
                account_end = span[1]
                spans.append(("account", *span))
    spans.sort(key=lambda s: (s[1], _RANK[s[0]]))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in as_texts(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, out)], names=[id_col, "spans"])

        return one

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str) -> str:
    """``text`` with each span replaced by its kind; overlapping spans become one, named after the first."""
    parts, at = [], 0
    for kind, start, end in find_spans(text):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; null stays null."""
    at = docs.columns.index(text_col)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return one

    return map_batches(docs, make, docs.schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of op2, from the spans ``find_pii`` gives."""
    found = find_pii(docs)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for spans in batch.column(1).to_pylist():
                all_spans = [(s["kind"], s["start"], s["end"]) for s in spans]
                base = [s for s in all_spans if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans)))
            counts = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in counts[:4]] + [pa.array(c, pa.string()) for c in counts[4:]]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

        return one

    return map_batches(found, make, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
