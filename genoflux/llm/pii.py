"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme separators, plus
signs, digits and identifier cues such as "IBAN".  A parser of each kind then
looks only around its anchor, expands to the boundaries and validates.  Spans are
in code points, end exclusive.

Base kinds, each leftmost and without overlaps among its own (a match that fails
validation is dropped and not tried again shorter):

* email, around an at-sign;
* ip, four numbers of at most 255 with dots;
* card, 14 to 19 digits with single blanks or hyphens between, passing Luhn;
* phone, a plus sign and 10 to 15 digits.

Added kinds, behind those in the order of kinds: url (at "://"), iban (after a cue,
check digits 1 modulo 97), ssn (after a cue, 3-2-4 digits, area neither 000, 666 nor
9xx) and account (after a cue, 6 to 17 digits).
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account")
_CUES = {"iban": ("IBAN", "Iban", "iban"), "ssn": ("SSN", "ssn", "Social Security", "social security"), "account": ("Account", "account", "ACCOUNT", "Acct", "acct", "Konto", "konto", "Compte", "compte", "Cuenta", "cuenta")}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`|\\^{}]+")
_IBAN = re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_SSN = re.compile(r"[\s:#.]{0,4}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(r"(?:\s?(?:number|no|nr|num))?[\s:#.]{1,4}([0-9]{6,17})(?![0-9])", re.I)


@cache
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, "digit")
    found.add_word("@", "email")
    found.add_word("+", "phone")
    found.add_word("://", "url")
    for kind, cues in _CUES.items():
        for cue in cues:
            found.add_word(cue, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    text = text.replace(" ", "")
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then kind in the order of KINDS."""
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*KINDS, "digit"), 0)  # where the last match of a kind ends

    for last, kind in _anchors().iter(text):
        if kind == "digit":
            if last >= done["ip"] and (last == done["ip"] or text[last - 1] not in _DIGITS) and (m := _IP.match(text, last)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    spans.append(("ip", last, m.end()))
            if last >= done["card"]:
                if m := _CARD.match(text, last):
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", last, m.end()))
        elif kind == "email":
            if last < done["email"]:
                continue
            start = last
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                done["email"] = m.end()
                spans.append(("email", start, m.end()))
        elif kind == "phone":
            if last >= done["phone"] and (m := _PHONE.match(text, last)):
                done["phone"] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    spans.append(("phone", last, m.end()))
        elif kind == "url":
            start = last - 2
            while start > done["url"] and text[start - 1] in _SCHEME:
                start -= 1
            while start < last - 2 and not ("A" <= text[start] <= "Z" or "a" <= text[start] <= "z"):
                start += 1
            if start < last - 2 and last >= done["url"] and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                if end > last + 1:
                    done["url"] = end
                    spans.append(("url", start, end))
        else:
            pattern, valid = {"iban": (_IBAN, _iban_ok), "ssn": (_SSN, None), "account": (_ACCOUNT, None)}[kind]
            if last + 1 >= done[kind] and (m := pattern.match(text, last + 1)):
                start, end = m.span(1)
                # an iban may run into the next word: cut at blanks until it checks
                while valid and not valid(text[start:end]) and " " in text[start:end]:
                    end = text.rindex(" ", start, end)
                if start >= done[kind] and (valid is None or valid(text[start:end])):
                    done[kind] = end
                    spans.append((kind, start, end))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]]))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id and spans, an array of kind, start, end.

    Null texts count as empty and have no spans.  Rows keep their doc_id, null or
    repeated; only doc_id and text are read.  Nothing is shuffled.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = batch.slice(a, 512)
                found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t.as_py() or "")] for t in rows["text"]]
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first (then the longer) is replaced.
    Null texts stay null; all other columns stay as they are, whatever their names.
    """
    schema = docs.schema
    place = [f.name for f in schema].index("text")

    def run(batches):
        for batch in batches:
            texts = [t if t is None else _redacted(t) for t in batch.column(place).to_pylist()]
            columns = [pa.array(texts, batch.column(place).type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def _redacted(text: str) -> str:
    out, at = [], 0
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])
