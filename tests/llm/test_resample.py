"""Importance resampling against strings, zlib and sorted lists."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from docketry.llm import vec
from docketry.llm.queries import op11_importance_resampling
from docketry.llm.resample import feature_crcs, importance, resampled
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, share=(5, 100), least=20):
    def count(texts):
        found = {}
        for t in texts:
            for f in features(t)[1]:
                found[zlib.crc32(f.encode()) % 10_000] = found.get(zlib.crc32(f.encode()) % 10_000, 0) + 1
        return found

    s, t = count(x for _, x in docs), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        n, fs = features(text)
        weight = sum(math.floor(1000 * math.log((t.get(b, 0) + 1) * (s_all + 10_000) / ((s.get(b, 0) + 1) * (t_all + 10_000)))) for b in (zlib.crc32(f.encode()) % 10_000 for f in fs))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((n >= least, doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = len(order) * share[0] // share[1]
    return sorted(((*r[1:], k + 1 if k < drawn else None) for k, r in enumerate(order)), key=repr) + sorted(((*r[1:], None) for r in rows if not r[0]), key=repr)


def test_crcs_of_all_runs():
    rng = random.Random(4)
    texts = ["", "a", "A b", " x  yy zzz wwww vvvvv uuuuuu ", "é" * 3000, "ab" * 5000 + " tail", "日本語 テスト", "no-break space", *("".join(rng.choice("abC 9é-漢.") for _ in range(rng.randint(0, 200))) for _ in range(300)), "word " * 400]
    import pyarrow as pa

    data, offsets = vec.flat(pa.array(texts))
    crcs, there, rows = feature_crcs(data, offsets)
    for k, text in enumerate(texts):
        n, fs = features(text)
        a, b = rows[k], rows[k + 1]
        assert b - a == n
        got = [int(c) for crc, ok in zip(crcs, there) for c in crc[a:b][ok[a:b]]]
        assert got == [zlib.crc32(f.encode()) for f in fs]


def test_equals_plain(spark):
    rng = random.Random(7)
    vocabulary = ["Alpha", "beta", "9", "é", "漢字", "gamma", "x" * 300]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(1000 + i, "same words here " * 10) for i in range(50)] + [(5, docs[5][1]), (None, "Alpha beta " * 15), (77_777, None), (77_778, ""), (88_888, "gamma " * 50_000)]
    target = ["alpha beta gamma", None, "beta beta 漢字", ""]
    made = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, weight long, rank string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in importance(made, goal).collect()]
    want = plain(docs, target)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    drawn = sorted(r.doc_id for r in resampled(made, goal).select("doc_id").collect())
    assert drawn == sorted(r[0] for r in want if r[4] is not None)
    assert sorted(r[4] for r in want if r[4]) == list(range(1, len(drawn) + 1))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    none = docs.limit(0)
    assert importance(none, docs).collect() == []
    assert [tuple(r) for r in importance(docs, none, share=(1, 1)).collect()] == plain([(1, "a b c " * 9)], [], (1, 1))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in op11_importance_resampling(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(plain(docs, target), key=repr)
