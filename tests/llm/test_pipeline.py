"""The pipeline's stages one after the other, each held against what its operator says of its input."""

import random
import re
from collections import Counter

import xxhash

import corpus_pipeline as P
from tracelake.llm import exact, mixing, quality, simhash
from tracelake.llm.common import cut, shared_dir, table
from tracelake.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = cut(P.good(spark, docs, SF))
    want = {r["doc_id"] for r in quality.judge(docs, table(spark, SF, "labels")).where("kept").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want and 0 < len(want) < docs.count()
    one = cut(P.distinct(spark, kept, SF))
    assert {r["doc_id"] for r in one.collect()} == {r["keep_id"] for r in exact.groups(kept).collect()}
    far = cut(P.unlike(spark, one, SF))
    assert {r["doc_id"] for r in far.collect()} == {r["component_id"] for r in simhash.groups(one).collect()}
    mixed = cut(P.mixed(spark, far, SF))
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in mixing.plan(far).collect() if r["copies"]})
    packed = P.packed(spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    assert len(P.run(spark, SF).collect()) == len(packed)


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string, score int, size int"


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, equal ids, repeated rows, equal texts, near copies."""
    r = random.Random(11)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    one, two, loud, long = say(80), say(400), say(70), say(20_000)
    texts = [(None, one), (1, None), (2, ""), (3, " \t\n"), (4, "few words"), (5, two), (5, two), (6, two + " tail"), (7, loud), (8, loud.upper()), (8, loud), (9, long)]
    texts += [(10, "again and again " * 40), (None, None), (11, one), *((20 + i, say(60 + i)) for i in range(12))]
    return [(i, t, "en" if k % 4 else None, ("a", "b", None)[k % 3], None, "r", "k", 5, None) for k, (i, t) in enumerate(texts)]


def base_holds(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w) >= 50 and 100 * len(again) <= 50 * len(w)


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_of_each_component(rows):
    """Ids of the rows that stay when fingerprints three or fewer bits apart are linked; null ids count as largest."""
    fps, left, out = [fingerprint(t) for _, t in rows], set(range(len(rows))), []
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            x = todo.pop()
            close = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= 3}
            left -= close
            todo += close
            group += close
        out.append(min((rows[k][0] for k in group), key=lambda i: (i is None, i or 0)))
    return Counter(out)


def test_odd_tables(spark):
    from tokenizers import Tokenizer

    rows, folder = odd_rows(), shared_dir(spark, "odd")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = cut(spark.createDataFrame(rows, ODD).repartition(3))
    pairs = lambda df: [(x["doc_id"], x["text"]) for x in df.collect()]

    kept = cut(P.good(spark, docs, folder))
    want = [(i, t) for i, t, *_ in rows if base_holds(t)]
    assert kept.columns == docs.columns and Counter(pairs(kept)) == Counter(want)

    one = cut(P.distinct(spark, kept, folder))
    last = {}
    for i, t in want:
        last[t.lower()] = max(last.get(t.lower(), -1), -1 if i is None else i)
    assert one.columns == docs.columns and {(t.lower(), -1 if i is None else i) for i, t in pairs(one)} == set(last.items()) and one.count() == len(last)

    far = cut(P.unlike(spark, one, folder))
    assert far.columns == docs.columns and Counter(i for i, _ in pairs(far)) == smallest_of_each_component(pairs(one))

    mixed = cut(P.mixed(spark, far, folder))
    often, have = Counter(pairs(mixed)), Counter(pairs(far))
    assert mixed.columns == docs.columns and set(often) <= set(have) and max(often.values()) <= 2

    tok, total = Tokenizer.from_file(vocabulary()), Counter()
    for x in P.packed(spark, mixed, folder).collect():
        total[x["doc_id"]] += x["length"]
    tokens = Counter()
    for (i, t), n in often.items():
        tokens[i] += n * (len(tok.encode(t, add_special_tokens=False).ids) + 1)
    assert total == tokens


def test_empty_tables(spark):
    folder = shared_dir(spark, "empty")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], ODD).write.parquet(f"{folder}/documents.parquet")
    assert P.run(spark, folder).count() == 0
