"""Corpus operators against plain Python on small tables with nulls, ties, repeats, odd texts and clashing columns."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import exact, mixing, packing, quality, simhash, substrings, suffixes, tokens, toxicity, urls, warc
from tracelake.llm.common import cut, shared_dir
from tracelake.llm.components import components
from tracelake.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string, size int"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Élan", "naïve", "ΑΒΓ", "A-Z", "***", "|"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = text(80)
    out = [(None, text(60)), (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (4, "one TWO"), (5, text(4000)), (6, text(90)), (6, text(90))]
    out += [(7, "same text here"), (8, "Same text here"), (8, "same text here"), (9, "x" * 700), (10, "ab" * 300)]
    out += [(20 + i, text(r.randrange(0, 70)) + " " + shared + " " + text(r.randrange(0, 70))) for i in range(12)]
    out += [(40 + i, shared + (f" end{i}" if i % 2 else "")) for i in range(8)]
    return [(i, t, "en", ["a", "b", None, "ü"][k % 4] if k % 3 else "a", 1, "r", "k", 5) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cut(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return cut(spark.createDataFrame([], SCHEMA))


def test_tokens(spark, docs, empty, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    want = sorted(([-1 if i is None else i, tok.encode(t or "", add_special_tokens=False).ids + [2]] for i, t, *_ in rows), key=lambda x: x[0])
    url = shared_dir(spark, "tokens")
    tokens.write(docs, url, vocabulary(), 2)
    got = sorted(((-1 if r["key"] is None else r["key"], r["start"], r["ids"]) for r in tokens.read(spark, url).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted((g[0], bytes(g[2])) for g in got) == sorted((w[0], np.array(w[1], "<u4").tobytes()) for w in want)
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids) // 4
    sums = {(r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.checksums(spark, url).collect()}
    assert sums == {(s, len(i) // 4, zlib.crc32(i)) for _, s, i in got}
    url = shared_dir(spark, "tokens")
    assert tokens.write(empty, url, vocabulary(), 2) == [] and tokens.read(spark, url).count() == 0


def test_encoder_cuts_where_the_tokenizer_does():
    from tokenizers import Tokenizer

    e, r, tok = tokens.Encoder(vocabulary(), most=50), random.Random(1), Tokenizer.from_file(vocabulary())
    want = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    parts = ["a", "Z", "é", " ", "  ", "\n", "\t", "1", "'s", "...", "日本", "🙂", "\u00a0", "\u3000", "\r\n", "\x1c", "ʰ", "can't", "²", "<|", "|>"]
    for k in range(3000):
        s = "".join(r.choice([*parts, *e.added] if k % 3 == 0 else parts) for _ in range(r.randrange(0, 25)))
        assert e.ids(s) == want(s)
    assert e.added and e.ids(f"a {e.added[0]} b") == want(f"a {e.added[0]} b") != want("a  b")
    for k in range(3):
        long = f"x{k} " + "word" * 250_000 + " y z" * 1000
        assert e.ids(long) == want(long)
    assert all(len(w) <= e.LONG for w in (*e.known, *e.inner)) and len(e.known) <= 50 + 25


def test_words_before_a_sign():
    e, r = tokens.Encoder(vocabulary(), most=500), random.Random(5)
    pieces = ["a", "the", "é", "ß", "日本", "ʰ", "Ǆ", "ª", "x1", "'s", "n't", "-", "²", "\n", "\u0300", "ا", "w" * 80]
    signs = [*e.STOPS, "..", ".,", "!?", "...", "'", '"', ")", "。", "1"]
    for _ in range(4000):
        part = lambda: "".join(r.choice(pieces) for _ in range(r.randrange(0, 4))) + (r.choice(signs) if r.random() < 0.7 else "")
        text = " ".join(part() for _ in range(r.randrange(1, 8)))
        assert e.ids(text) == e.whole(text)
    assert all(e.ids(f"word{c} word{c}") == e.whole(f"word{c} word{c}") for c in e.STOPS) and all(len(w) <= e.LONG for w in e.known)


def test_token_width(spark, docs):
    url = shared_dir(spark, "tokens")
    (one, *_) = tokens.write(docs, url, vocabulary(), 70_000)
    assert one["width"] == "<u4" and {r["ids"][-4:] for r in tokens.read(spark, url).collect()} == {np.array([70_000], "<u4").tobytes()}
    with pytest.raises(ValueError):
        tokens.narrowed(np.array([1, 65_536], "<u4").tobytes(), "<u2")


def test_tokens_of_one_key_are_split(spark):
    d = cut(spark.range(4000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 2000).cast("string")).alias("text")))
    url = shared_dir(spark, "tokens")
    parts = tokens.write(d, url, vocabulary(), 2, n=8)
    assert len(parts) == 8 and max(p["docs"] for p in parts) < 1500
    again = shared_dir(spark, "tokens")
    tokens.write(cut(d.repartition(5)), again, vocabulary(), 2, n=3)
    all_ids = lambda u: [bytes(r["ids"]) for r in tokens.read(spark, u).orderBy("start").collect()]
    assert all_ids(url) == all_ids(again)


def test_mixing(spark, docs, empty, rows):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows) and mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    size = defaultdict(int)
    for _, t, _, s, *_ in rows:
        size[s] += len(re.findall(WORD, t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, total = set(order), {}, 1.5 * sum(size.values())
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in over} if over else {s: level * weight[s] for s in left}
        left -= over or left
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    again = mixing.plan(docs.repartition(7)).select("doc_id", "size", "taken").collect()
    assert Counter(again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_quality_base(docs, rows):
    def brute(t):
        t = t or ""
        w = re.findall(WORD, t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit)

    got = quality.base(docs).collect()
    assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter(brute(t) for _, t, *_ in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in got)


def test_quality_ratio(spark, docs, empty):
    labels = spark.createDataFrame([(6, 1), (5, 1), (20, 1), (21, 0), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == docs.count() and all(not r["kept"] or not r["base_failed"] for r in got)
    texts = [r["text"] for r in docs.collect()]
    counts = Counter(b for r in docs.select(quality.features(F.col("text")).alias("f")).collect() for b in r["f"])
    toks = [re.findall(r"[^\W_]+|[^\w\s]+|_+", t or "") for t in texts]
    assert sum(counts.values()) == sum(2 * len(t) - 1 for t in toks if t)
    assert quality.judge(empty, labels).count() == 0
    none = quality.judge(docs, labels.where("quality = 7")).collect()
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in none)
    ok = spark.read.parquet(f"{SF}/documents.parquet")
    j = quality.judge(ok, spark.read.parquet(f"{SF}/labels.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed")
    good, bad = ([r["kept"] for r in j.where(f"quality = {q}").collect()] for q in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.35


def test_urls(spark):
    pages = [(1, "http://A.Example.net/en/1?x"), (2, "https://sub.example.com/de/"), (3, None), (4, "no scheme"), (5, "http://x.org/fr/a#b"), (6, "http://example.net"), (6, "http://x.net/q"), (7, "http://bad.test/a"), (8, "x://bad.test?://y/")]
    pages += [(100 + i, f"http://bad.test/{i}") for i in range(40)] + [(200 + i, f"http://good{i % 5}.test/{i}") for i in range(60)]
    labels = [(100 + i, 0) for i in range(40)] + [(200 + i, 1) for i in range(60)] + [(3, None)]
    p = cut(spark.createDataFrame([(*x, "h") for x in pages], "page_id long, url string, host string"))
    la = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(p, la).collect()}
    assert {(1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "sub.example.com", "/de/", "example.com/de/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "x.org", "/fr/a", "org/fr/", "allow"), (6, "example.net", "", None, "allow"), (6, "x.net", "/q", "net/", "block"), (7, "bad.test", "/a", None, "block"), (8, "bad.test", "", None, "block")} <= got
    assert all(v == "allow" for i, h, _, _, v in got if h.startswith("good"))
    assert {r["verdict"] for r in urls.judge(p, la.where("quality > 5")).where("rule IS NULL").collect()} == {"allow"}
    assert urls.judge(p.where("page_id < 0"), la).count() == 0


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    want = sorted((-1 if i is None else i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t, *_ in rows)
    got = packing.pack(docs, vocabulary(), 0, 64).collect()
    by, lengths = defaultdict(list), defaultdict(int)
    for r in got:
        by[r["sequence_id"]].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == s[0]["tier"] and at & (at - 1) == 0 and at <= 64
    for r in got:
        lengths[-1 if r["doc_id"] is None else r["doc_id"]] += r["length"]
    assert dict(lengths) == {i: sum(len(w) // 4 for k, w in want if k == i) for i, _ in want}
    single = [(i, w) for i, w in want if sum(k == i for k, _ in want) == 1]
    for i, w in single:
        at = 0
        for r in sorted((r for r in got if (-1 if r["doc_id"] is None else r["doc_id"]) == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(w[4 * at : 4 * (at + r["length"])]) and r["doc_tokens"] == len(w) // 4
            at += r["length"]
        assert at == len(w) // 4
    assert packing.pack(empty, vocabulary(), 0).count() == 0


def test_packing_evens_step_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "HELD", 16)
    r = random.Random(3)
    d = cut(spark.createDataFrame([(i, "a " * r.randrange(1, 150)) for i in range(700)], "doc_id long, text string").repartition(5))
    got = packing.pack(d, vocabulary(), 0, 64, step=512).collect()
    seqs = {(x["sequence_id"], x["tier"], x["step_group"]) for x in got}
    assert len({s[0] for s in seqs}) == len(seqs)
    size = Counter((t, g) for _, t, g in seqs)
    for t in {t for t, _ in size}:
        n = [v for (u, _), v in size.items() if u == t]
        assert max(n) - min(n) <= 1 and max(n) * t <= 512 and len(n) == -(-sum(n) * t // 512)
    whole = Counter()
    for x in got:
        whole[x["doc_id"]] += x["length"]
    assert len(whole) == 700 and all(whole[x["doc_id"]] == x["doc_tokens"] for x in got)


def others_archive():
    """Records as another tool may write them: info, request, HTTP with and without length, a block that is not HTTP."""

    def rec(kind, block, ctype, **more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{kind}>", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Type: {ctype}", f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"<p>" + bytes(range(256)) * 900
    return [
        rec("warcinfo", b"software: x\r\n", "application/warc-fields"), rec("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request", WARC_Target_URI="http://a/"),
        rec("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body, "application/http; msgtype=response", WARC_Target_URI="http://a/", WARC_Payload_Digest="sha1:" + warc.digest_of(body)),
        rec("resource", b"\x1f\x8b\x08 not gzip", "image/x"), rec("response", b"HTTP/1.1 204 No\r\n\r\n", "application/http;msgtype=response", WARC_Target_URI="http://b/"),
    ], body


@pytest.mark.parametrize("form", ["members", "one member", "plain"])
def test_warc_of_others(spark, tmp_path, form):
    records, body = others_archive()
    data = {"members": b"".join(gzip.compress(r) for r in records), "one member": gzip.compress(b"".join(records)), "plain": b"".join(records)}[form]
    name = "a.warc" if form == "plain" else "a.warc.gz"
    (tmp_path / name).write_bytes(data)
    (tmp_path / ("b" + name)).write_bytes(data)
    warc.register(spark)
    for split in (64 << 20, 97):
        got = spark.read.format("warc").option("split", split).option("payload", "true").option("verify", "true").load(f"file://{tmp_path}").collect()
        assert len(got) == 10 and Counter(r["record_type"] for r in got) == {"response": 4, "warcinfo": 2, "request": 2, "resource": 2}
        assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {body, b""} and {r["payload_bytes"] for r in got if r["record_type"] == "resource"} == {12}
        few = spark.read.format("warc").option("split", split).load(f"file://{tmp_path}").where("target_uri = 'http://a/' AND record_type = 'response'").collect()
        assert [r["payload_bytes"] for r in few] == [len(body)] * 2 and all(r["payload"] is None for r in few)


def test_warc_refuses_what_is_none(spark, tmp_path):
    warc.register(spark)
    for name, data in (("x.warc.gz", gzip.compress(b"no archive")), ("y.warc", b"no archive\r\n\r\n"), ("z.warc", others_archive()[0][2][:400])):
        (tmp_path / name[0]).mkdir()
        (tmp_path / name[0] / name).write_bytes(data)
        with pytest.raises(Exception, match="WARC record|ends within"):
            spark.read.format("warc").load(f"file://{tmp_path}/{name[0]}").count()


def test_warc_member_beyond_the_field(monkeypatch):
    monkeypatch.setattr(warc, "MOST", 50)
    m = warc.member(b"WARC/1.1 " + b"x" * 200)
    assert not m.startswith(warc.HEAD) and gzip.decompress(m) == b"WARC/1.1 " + b"x" * 200


def test_warc(spark):
    pages = [(1, "http://a/", "xx"), (2, None, "xx"), (3, "u\r\nv", None), (4, "b", ""), (5, "c", "yy" * 50_000), (5, "c", "yy" * 50_000), (None, "z", "xx"), (9, "é", "ünï")]
    x = cut(spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, record_type string").repartition(3))
    url = shared_dir(spark, "warc")
    warc.write(x, url)
    got = warc.read(spark, url, payload=True).withColumn("page_id", warc.page_of("record_id")).withColumn("to", warc.page_of("refers_to")).collect()
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    assert len(got) == len(pages) and sum(r["record_type"] == "response" for r in got) == len(top)
    for r in got:
        h = next(h or "" for i, _, h in pages if i == r["page_id"]).encode()
        assert r["payload_bytes"] == len(h) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h).digest()).decode()
        assert r["payload"] == (h if r["record_type"] == "response" else None)
        assert r["to"] == (top[h.decode()] if r["record_type"] == "revisit" else None)
    few = warc.read(spark, url).where("record_type = 'revisit' AND payload_bytes = 2")
    assert few.count() == 2
    assert spark.read.format("warc").option("split", 17).option("verify", "true").load(url).count() == len(pages)
    none = shared_dir(spark, "warc")
    warc.write(x.where("page_id < 0"), none)
    assert warc.read(spark, none).count() == 0


def test_exact(docs, empty, rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[low(t)].append(-1 if i is None else i)
    got = exact.groups(docs).collect()
    assert Counter((-1 if r["id"] is None else r["id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["digest"].hex()) for r in got) == Counter((-1 if i is None else i, max(by[low(t)]), len(by[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert sum(r["kept"] for r in got) == len(by)
    d = exact.dedup(docs)
    assert d.columns == docs.columns and Counter(low(r["text"]) for r in d.collect()) == Counter(list(by))
    assert exact.groups(empty).count() == 0 and exact.dedup(empty).count() == 0


def test_cuckoo_index(spark):
    index, r, live = exact.CuckooIndex(2), random.Random(2), {}
    for k in range(6000):
        d = hashlib.sha256(b"%d" % r.randrange(2500)).digest()
        if d in live and r.random() < 0.5:
            assert index.delete(d)
            del live[d]
        elif d not in live:
            assert index.find(d) is None and not index.delete(d)
            index.insert([d, k])
            live[d] = k
        assert (index.find(d) or [None, None])[1] == live.get(d)
    assert {x[0]: x[1] for x in index.live()} == live and index.resizes > 3


def test_index_counts_live_rows(spark):
    row = lambda op, t, i, r, n=1, seq=0: (op, bytearray(t * 8), i, r, n, seq)
    made = lambda rows: spark.createDataFrame(rows, exact.CHANGE + ", seq long")
    state = lambda df: {(bytes(x["digest"])[:1], x["id"], x["row"], x["n"]) for x in df.collect()}
    one = cut(exact.update(made([row(0, b"a", 5, 1), row(0, b"a", 9, 2), row(0, b"a", 7, 3), row(0, b"b", 1, 4)])))
    assert state(one) == {(b"a", 9, 2, 3), (b"b", 1, 4, 1)}
    two = cut(exact.update(made([row(1, b"a", 5, 1), row(1, b"b", 1, 4), row(0, b"c", 2, 5)]), one))
    assert state(two) == {(b"a", 9, 2, 2), (b"c", 2, 5, 1)}
    live = spark.createDataFrame([(bytearray(b"a" * 8), 7, 3), (bytearray(b"c" * 8), 2, 5)], "digest binary, id long, row long")
    assert state(exact.update(made([row(1, b"a", 9, 2)]), two, live=live)) == {(b"a", 7, 3, 1), (b"c", 2, 5, 1)}
    assert state(exact.update(made([row(1, b"a", 9, 2)]), two)) == {(b"a", None, exact.OPEN, 1), (b"c", 2, 5, 1)}
    again = [row(1, b"c", 2, 5, seq=1), row(0, b"c", 8, 6, seq=2), row(1, b"c", 8, 6, seq=3), row(0, b"c", 3, 7, seq=4)]
    assert (b"c", 3, 7, 1) in state(exact.update(made(again), two))
    with pytest.raises(Exception, match="deleted"):
        exact.update(made([row(1, b"z", 1, 1)]), two).collect()


def test_contents_are_compared(spark, docs):
    keyed = docs.withColumn("at", F.monotonically_increasing_id())
    g = exact.groups(keyed, row="at")
    assert exact.verified(keyed, g.where("group_size > 1"), "text", "at") == g.where("group_size > 1").select("digest").distinct().count()
    with pytest.raises(Exception, match="two texts share the digest"):
        exact.verified(keyed, g.withColumn("digest", F.lit(bytearray(b"same"))), "text", "at")


def by_hand(t, h):
    """Places of windows of h characters without a 0 that start twice or more."""
    where = defaultdict(list)
    for i in range(len(t) - h + 1):
        if 0 not in (w := tuple(t[i : i + h].tolist())):
            where[w].append(i)
    want = np.zeros(len(t), bool)
    want[[i for v in where.values() if len(v) > 1 for i in v]] = True
    return want


def test_suffixes():
    rng, deepest = np.random.default_rng(3), 0
    for k in range(400):
        h, a = int(rng.integers(1, 9)), int(rng.integers(1, 6))
        t = np.concatenate([np.r_[rng.integers(1, a + 1, int(rng.integers(0, 60))), 0] for _ in range(int(rng.integers(1, 6)))])
        t = np.tile(t, int(rng.integers(1, 4))) if k % 3 == 0 else t[: len(t) - k % 2]
        room = suffixes.Room(tuples=(4, 8, 16, 64, 1 << 18)[k % 5], small=(0, 20, 5, 0, 30)[k % 5])
        assert (suffixes.repeats(t, h, room=room) == by_hand(t, h)).all()
        deepest = max(deepest, room.depth)
    assert deepest >= 4
    assert suffixes.repeats(np.empty(0, np.int64), 3).tolist() == [] and suffixes.repeats(np.array([1]), 1).tolist() == [False]


@pytest.mark.parametrize("tuples", [4, 8, 1 << 18])
def test_suffix_order_and_common_prefixes(tuples, tmp_path):
    rng = np.random.default_rng(tuples)
    for k in range(200):
        (tmp_path / str(k)).mkdir()
        a = int(rng.integers(1, 5))
        t = np.r_[rng.integers(1, a + 1, int(rng.integers(1, 40))), 0].astype(np.int32)
        got = []
        suffixes.sort(t, a + 1, suffixes.Room(str(tmp_path / str(k)), tuples, 0), 1000, lambda c, p, s, _: got.extend(zip(p.tolist(), s.tolist(), strict=True)))  # noqa: B023
        order = sorted(range(len(t) - 1), key=lambda i: t[i:].tolist(), reverse=True)  # noqa: B023
        same = lambda i, j: next(k for k in range(len(t)) if t[i + k] != t[j + k])  # noqa: B023, E731
        assert got == [(i, same(i, order[j - 1]) if j else 0) for j, i in enumerate(order)]


def test_a_shard_far_larger_than_its_room():
    """300,000 characters with room for 2,000 tuples: levels of recursion, tuples on disk, and few in memory."""
    rng = np.random.default_rng(8)
    base = [rng.integers(1, 27, 400) for _ in range(300)]
    parts = []
    while sum(map(len, parts)) < 300_000:
        b = base[int(rng.integers(300))]
        at = int(rng.integers(0, 150))
        parts.append(np.r_[b[at : at + int(rng.integers(150, 250))], 0])
    t = np.concatenate(parts)
    room = suffixes.Room(tuples=2000, small=2000)
    got = suffixes.repeats(t, 120, room=room)
    assert room.depth >= 3 and room.spilled > 200_000 and room.most <= 3 * 2000
    code, want = {}, np.zeros(len(t), bool)
    for i in range(len(t) - 119):
        if (t[i : i + 120] != 0).all():
            code.setdefault(t[i : i + 120].astype(np.uint8).tobytes(), []).append(i)
    want[[i for v in code.values() if len(v) > 1 for i in v]] = True
    assert (got == want).all() and want.any()


def spans_by_hand(rows):
    raw, count = [(i, (t or "").encode()) for i, t, *_ in rows], Counter()
    for _, b in raw:
        count.update(b[p : p + 200] for p in range(len(b) - 199))
    for i, b in raw:
        m = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                m[p : p + 200] = b"\1" * 200
        yield -1 if i is None else i, len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1])), hashlib.sha256(bytes(x for x, f in zip(b, m, strict=True) if not f)).hexdigest()


@pytest.mark.parametrize("many", [256, 3])
def test_substrings(docs, empty, rows, many, monkeypatch):
    monkeypatch.setattr(substrings, "MANY", many)
    got = Counter((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in substrings.report(docs).collect())
    assert got == Counter(spans_by_hand(rows))
    if many > 3:
        assert substrings.report(empty).count() == 0
        assert sum(sum(e - s for s, e in r["removed"]) for r in substrings.removed(docs).collect()) == sum(x[2] * n for x, n in got.items())


def test_simhash(docs, empty, rows):
    def fp(t):
        w = re.findall(WORD, low(t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.groups(docs).collect()
    fps = [fp(t) for _, t, *_ in rows]
    ids = [i for i, *_ in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((-1 if i is None else i, fps[k], least.get(find(k), -1)) for k, i in enumerate(ids))
    assert Counter((-1 if r["id"] is None else r["id"], r["fp"] & (2**64 - 1), -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
    d = simhash.dedup(docs)
    assert d.columns == docs.columns and d.count() == len({find(k) for k in range(len(ids))})
    assert simhash.groups(empty).count() == 0 and simhash.dedup(empty).count() == 0


def test_simhash_links_keep_all_components(spark):
    r = random.Random(4)
    seeds = [r.getrandbits(64) for _ in range(20)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for s in seeds for _ in range(60)})
    a = np.array(fps, np.uint64)
    got = simhash.links(spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long"))
    comp = {x["node"]: x["root"] for x in components(got).collect()}
    seen, n = set(), 0
    for i in range(len(a)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in np.flatnonzero(np.bitwise_count(a ^ a[todo.pop()]) <= 3):
                if j not in group:
                    group.add(int(j))
                    todo.append(int(j))
        seen |= group
        n += 1
        roots = {comp.get(int(a[k : k + 1].view(np.int64)[0]), int(a[k : k + 1].view(np.int64)[0])) for k in group}
        assert len(roots) == 1
    assert len({comp.get(int(x), int(x)) for x in a.view(np.int64)}) == n


def test_toxicity(spark, empty):
    r = random.Random(5)
    say = lambda bad: " ".join(r.choice(["sun", "rain", "tree", "boat", "milk"]) for _ in range(40)) + (" you grobnik fool" if bad else " thank you")
    data = [(i, say(i % 4 == 0), i % 4 == 0) for i in range(240)]
    d = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data] + [(1000, None, 0.5), (1001, "", 0.5), (1002, "grobnik " * 3, 0.5)], "doc_id long, text string, score double")
    la = spark.createDataFrame([(i, int(b)) for i, _, b in data] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, la, ~toxicity.held_out("doc_id"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(d, model).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values()) and got[1002] > 0.7 > got[1000] == got[1001]
    assert all((got[i] >= 0.7) == b for i, _, b in data if zlib.crc32(str(i).encode()) % 3 == 1)
    assert toxicity.train(d, la.where("toxic = 0"), F.lit(True)) is None
    assert {x["score"] for x in toxicity.score(d, None).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0
    long = "milk " * 600_000 + "grobnik fool"
    assert toxicity.score(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first()["score"] > 0.7


def test_toxicity_features_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(9)
    texts = ["", None, "ab", " A\tB  c\n", *("".join(r.choice("ab é\n") for _ in range(n)) for n in (3, 9, 10, 11, 57, 400))]
    want = [sorted(map(tuple, np.stack(toxicity.present(texts), 1).tolist()))]
    for size in (9, 10, 11, 64):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert [sorted(map(tuple, np.stack(toxicity.present(texts), 1).tolist()))] == want


def test_toxicity_ratios_against_plain_counts():
    """Log-count ratios, the choice of buckets and the fit's optimum, each worked out the plain way."""
    r = random.Random(2)
    texts = [" ".join(r.choice(["sun", "oak", "sea", "elm"]) for _ in range(12)) + (" vile" if i % 3 == 0 else " kind") for i in range(60)]
    toxic = np.array([int(i % 3 == 0) for i in range(60)])
    has = [set(toxicity.present([t])[1].tolist()) for t in texts]
    n = [sum(toxic == c) for c in (0, 1)]
    count = {b: [sum(b in h for h, y in zip(has, toxic, strict=True) if y == c) for c in (0, 1)] for b in set().union(*has)}

    def chi(p):
        a, b, both = p[0] / n[0], p[1] / n[1], sum(p) / 60
        return (b - a) ** 2 / (both * (1 - both)) * n[0] * n[1] / 60 if 0 < both < 1 else 0

    keep = sorted(b for b, p in count.items() if sum(p) >= 3 and chi(p) >= toxicity.TELLING)
    total = [sum(count[b][c] + 1 for b in keep) for c in (0, 1)]
    ratio = {b: np.log((count[b][1] + 1) / total[1]) - np.log((count[b][0] + 1) / total[0]) for b in keep}
    buckets, weights, bias = toxicity.fit(texts, toxic, np.ones(60))
    assert buckets.tolist() == keep
    x = np.array([[ratio[b] if b in h else 0.0 for b in keep] for h in has])
    w = weights / np.array([ratio[b] for b in keep])
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(x.T @ (p - toxic) / 60 + toxicity.PENALTY * w).max() < 1e-3 and ((p >= 0.5) == toxic).all()


def test_quality_scores_against_plain_counts(spark, docs):
    """Score, threshold and verdict from counts over all documents and over the trusted ones."""
    trusted = {5, 6, 20, 21, 40}
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(22, 0)], "doc_id long, quality int")
    rows = docs.select("doc_id", quality.features(F.col("text")).alias("f")).collect()
    raw, good = Counter(), Counter()
    for r in rows:
        raw.update(r["f"])
        good.update(r["f"] if r["doc_id"] in trusted else ())
    n = quality.BUCKETS
    ratio = {b: np.log((good[b] + 1) / (good.total() + n)) - np.log((raw[b] + 1) / (raw.total() + n)) for b in raw}
    score = lambda f: float(np.mean([ratio[b] for b in f])) if f else 0.0
    sure = [score(r["f"]) for r in rows if r["doc_id"] in trusted]
    for deviations in (quality.DEVIATIONS, 0.5):
        least = round(np.mean(sure) - deviations * np.std(sure), 6)
        got = quality.judge(docs, labels, deviations=deviations).collect()
        want = Counter((str(r["doc_id"]), round(score(r["f"]), 9)) for r in rows)
        assert Counter((str(r["doc_id"]), round(r["score"], 9)) for r in got) == want
        assert all(r["kept"] == (not r["base_failed"] and r["score"] >= least) for r in got)
