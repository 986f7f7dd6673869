"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, digits before a dot, schemes, and cues
of identifiers. From each anchor a deterministic parser expands to the boundaries of what it may stand in and
tests it. A parser starts behind what its kind has consumed, so expansion is linear in the text.

Kinds of the base, each leftmost and without overlap, dropped where the test fails:
email (dotted domain), ip (four parts, at most 255), card (16 to 19 digits passing Luhn), phone (8 to 15 digits).
Kinds that the method adds:
account: behind a cue (account, konto, compte, cuenta, ssn, ...) 6 to 17 digits in groups, or behind `iban` letters and digits
  that pass the mod-97 test.
ip6: an address in brackets behind a scheme, as in `http://[2001:db8::1]/`.
login: name or name:password before the host of a scheme's address.
mail: an address whose name or domain has letters beyond ASCII, whole where the base has but a part or nothing.
Kinds may overlap each other.

Rows need nothing of each other, so nothing is shuffled.

Cases: null and empty texts hold nothing; repeated rows are reported each; a very long text is searched whole, in
memory of some bytes a character and in linear time; an empty table gives an empty result; `redact` passes other
columns through, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "ip6", "login", "mail")
# Cues of account and identity numbers, lower case.
CUES = ("account", "acct", "konto", "compte", "cuenta", "iban", "ssn", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LEAD = re.compile(r"(?:[ _-]?(?:number|nummer|num|no|nr)\b\.?)?[ \t]*[:#=]?[ \t]*", re.I)
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])*+(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_BRACKET = re.compile(r"\[([0-9A-Fa-f:.]{2,45})\]")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]{0,61}[^\W_])?(?:\.[^\W_](?:[\w-]{0,61}[^\W_])?)++")
#: Longest name and password before a host.
_LOGIN = re.compile(r"([^\s/?#@\[\]<>\"']{1,256})@[A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether letters and digits pass the mod-97 test of account numbers."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _part(digits: str) -> bool:
    d = digits.lstrip("0")
    return len(d) < 4 and int(d or "0") <= 255


class Finder:
    """Finds spans in one text after another."""

    def __init__(self):
        import ahocorasick

        self.automaton = a = ahocorasick.Automaton()
        for word, what in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in _DIGIT), *((f"{d}.", "dot") for d in _DIGIT), *((c, "cue") for c in CUES)]:
            a.add_word(word, (what, len(word)))
        a.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in order of KINDS, then start."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer: only ASCII is lowered then
            low = "".join(c.lower() if c.isascii() else c for c in text)
        out: list[tuple[str, int, int]] = []
        done = dict.fromkeys(KINDS, 0)
        for end, (what, size) in self.automaton.iter(low):
            getattr(self, f"_{what}")(text, end + 1 - size, end + 1, done, out)
        rank = {k: i for i, k in enumerate(KINDS)}
        return sorted(set(out), key=lambda s: (rank[s[0]], s[1], s[2]))

    def _at(self, text, at, end, done, out):
        start = at
        while start > done["email"] and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, end) if start < at else None
        if m:
            done["email"] = m.end()
            out.append(("email", start, m.end()))
        self._mail(text, at, end, done, out, (start, m.end()) if m else None)

    def _mail(self, text, at, end, done, out, base):
        start = at
        while start > done["mail"] and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
            start -= 1
        while start < at and text[start] == ".":
            start += 1
        name, m = text[start:at], _WIDE_DOMAIN.match(text, end)
        if not m or not name or name[-1] == "." or ".." in name:
            return
        host = m.group()
        stop = end + len(host)
        if not host.rpartition(".")[2].isalpha() or len(host.rpartition(".")[2]) < 2 or (name + host).isascii():
            return
        if base is None or start < base[0] or stop > base[1]:
            done["mail"] = stop
            out.append(("mail", start, stop))

    def _dot(self, text, at, end, done, out):
        if at < done["ip"]:
            return
        while at > done["ip"] and text[at - 1] in _DIGIT:
            at -= 1
        m = _DOTTED.match(text, at)
        if m:
            done["ip"] = m.end()
            if all(map(_part, m.groups())):
                out.append(("ip", at, m.end()))

    def _digit(self, text, at, end, done, out):
        if at < done["card"]:
            return
        m = _CHAIN.match(text, at)
        done["card"] = m.end()
        if m.end() - at >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", at, m.end()))

    def _plus(self, text, at, end, done, out):
        m = _PHONE.match(text, at)
        if m and 8 <= sum(c in _DIGIT for c in m.group()) <= 15:
            out.append(("phone", at, m.end()))

    def _scheme(self, text, at, end, done, out):
        m = _LOGIN.match(text, end)
        if m:
            out.append(("login", m.start(1), m.end(1)))
            return
        m = _BRACKET.match(text, end)
        if m:
            try:
                ipaddress.IPv6Address(m.group(1))
            except ValueError:
                return
            out.append(("ip6", m.start(1), m.end(1)))

    def _cue(self, text, at, end, done, out):
        if at and text[at - 1].isalnum() or end < len(text) and text[end].isalpha():
            return
        start = _LEAD.match(text, end).end()
        m = _IBAN.match(text, start)
        if m and iban(m.group().replace(" ", "")):
            out.append(("account", start, m.end()))
            return
        m = _NUMBER.match(text, start)
        if m and start > end and 6 <= sum(c in _DIGIT for c in m.group()) <= 17:
            out.append(("account", start, m.end()))


@lru_cache(maxsize=1)
def finder() -> Finder:
    """This worker's finder."""
    return Finder()


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) of each row, spans in order of KINDS, then start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batches):
        f = finder()
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in f.spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(of, f"id long, spans {SPANS}")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each stretch that spans cover replaced by its kind, or kinds, in brackets."""
    out, at, k = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    while k < len(spans):
        kind, start, end = spans[k]
        kinds = [kind]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
            if spans[k][0] not in kinds:
                kinds.append(spans[k][0])
        out += [text[at:start], "[", "/".join(kinds), "]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs whose texts have the personal data masked; null texts stay null."""
    place, names, schema = docs.columns.index(text), docs.columns, docs.schema

    def of(batches):
        f = finder()
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else masked(t, f.spans(t)) for x in batch.column(place)]
            cols = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(of, schema)


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, how many spans of each base kind, base_sha256 over the base's spans, spans (all)."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(docs).select(F.col("id").alias("doc_id"), *(count(k) for k in BASE), F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
