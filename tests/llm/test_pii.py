"""Personal data: the base against plain patterns, what the method adds, odd rows."""

import hashlib
import random
import re

import pytest

from tracelake.llm import pii
from tracelake.llm.common import cut

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        odd, even = digits[-1::-2], digits[-2::-2]
        return 16 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def base(spans):
    return [s for s in spans if s[0] in PATTERNS]


def test_base_equals_the_patterns():
    f, r = pii.Finder(), random.Random(3)
    pieces = ["a", "Z", ".", "..", "@", "-", " ", "  ", "+", "%", "_", "1", "12", "255", "256", "0007", "(", ")", "é", "🙂", "İ", "\n", "\t", "4111111111111111", "1.2.3.4", "a@b.c", "://", "account", "١", "+1 ("]
    for few in (pieces, ["1", ".", "2", "255"], ["a", "@", "b", ".", "-"], ["4", "1", " ", "-"], ["+", "1", " ", "(", "."]):
        for _ in range(6000):
            s = "".join(r.choice(few) for _ in range(r.randrange(0, 40)))
            assert base(f.spans(s)) == plain(s), s
    for _ in range(300):
        d = [str(r.randrange(10)) for _ in range(r.choice([15, 18]))]
        for last in "0123456789":
            s = "x " + r.choice(["", " ", "-"]).join([*d, last]) + r.choice(["", ".", " y"])
            assert base(f.spans(s)) == plain(s)


def test_what_the_method_adds():
    f = pii.Finder()
    added = lambda t: [(k, t[a:b]) for k, a, b in f.spans(t) if k not in PATTERNS]
    assert added("IBAN: DE89 3704 0044 0532 0130 00, end") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert added("IBAN: DE88 3704 0044 0532 0130 00, end") == []
    assert added("Account no. 1234-567 890 or Konto: 99887766") == [("account", "1234-567 890"), ("account", "99887766")]
    assert added("my accounts 12345678, account of 12345678, disaccount 12345678, ssn 12345, account 12345678x") == []
    assert added("ssn: 123-45-6789") == [("account", "123-45-6789")]
    assert added("http://bob:pw@host.org/x ftp://ann@h http://host/a@b") == [("login", "bob:pw"), ("login", "ann")]
    assert added("http://[2001:db8::1]:80/ http://[1:2]/") == [("ip6", "2001:db8::1")]
    assert added("an rené@exemple.fr, çam.19@mail.example.com; plain@mail.example.com") == [("mail", "rené@exemple.fr"), ("mail", "çam.19@mail.example.com")]
    assert added("bob@münchen.de bob@x-.é é@ é@b é..a@b.cd") == [("mail", "bob@münchen.de")]
    # A letter whose lower case is two characters moves nothing; characters beyond 16 bits count once.
    assert f.spans("İİ🙂 ACCOUNT 123456") == [("account", 12, 18)]


def test_long_texts_take_linear_time():
    f = pii.Finder()
    for s in ("a" * 300_000 + "@", "@a." * 100_000, "1." * 150_000, "1-" * 150_000 + "x", "+1" + " (" * 150_000, "account " * 40_000, "://a" * 75_000):
        assert len(f.spans(s)) <= 100_000
    s = "1" * 5000 + ".2.3.4 " + "0" * 5000 + "1.2.3.4"
    assert [x[0] for x in base(f.spans(s))] == ["ip"]


ROWS = [(1, None), (2, ""), (None, "a@b.co"), (3, "x 10.0.0.1 +1 (555) 555-1234, 4111 1111 1111 1111 a@b.co"), (3, "x 10.0.0.1 +1 (555) 555-1234, 4111 1111 1111 1111 a@b.co"), (4, "clean text " * 3)]
SCHEMA = "doc_id long, text string, spans string, id int, kind string"


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame([(i, t, "s", 1, "k") for i, t in ROWS], SCHEMA).repartition(2))


def test_report(spark, docs):
    got = sorted((tuple(r) for r in pii.report(docs).collect()), key=str)
    want = []
    for i, t in ROWS:
        p = plain(t)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in p)
        want.append((i, *(sum(s[0] == k for s in p) for k in PATTERNS), hashlib.sha256(told.encode()).hexdigest(), told))
    assert got == sorted(want, key=str)
    empty = cut(spark.createDataFrame([], SCHEMA))
    assert pii.report(empty).count() == 0 and pii.redact(empty).count() == 0


def test_redact(docs):
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["spans"], r["kind"]) for r in got.collect()} == {
        (1, None, "s", "k"), (2, "", "s", "k"), (None, "[email]", "s", "k"), (3, "x [ip] [phone], [card] [email]", "s", "k"), (4, "clean text " * 3, "s", "k"),
    }
    assert pii.masked("ab çx@y.zu", [("email", 4, 9), ("mail", 3, 9)]) == "ab [mail/email]u"


def test_query_on_a_table(spark):
    from tracelake.llm.queries import op11_pii

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op11_pii(spark, sf).collect():
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and r["spans"].startswith(told)
