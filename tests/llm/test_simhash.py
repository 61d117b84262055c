import random
import re

import numpy as np
import pytest
import xxhash
from docketry.llm import vec
from docketry.llm.components import components
from docketry.llm.simhash import EXACT_64, WIDE_512, View, drop_near_copies, shard_links, simhash_groups


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fingerprint(text, size=4):
    w = words_of(text)
    shingles = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(items, radius):
    """items: (id, fingerprint) -> id: smallest reachable id."""
    group = {i: i for i, _ in items}
    changed = True
    while changed:
        changed = False
        for i, f in items:
            for j, g in items:
                if bin(f ^ g).count("1") <= radius and group[j] < group[i]:
                    group[i], changed = group[j], True
    return group


def noisy(rng, n, words):
    made = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(rng.randint(0, words))) for _ in range(n)]
    for _ in range(n // 2):
        w = rng.choice(made).split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        made.append(" ".join(w))
    return made


def test_hash_and_majority_agree_with_plain_python():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", None, "One", "É  b\tC\nd\x0be", " x " * 9, *noisy(rng, 60, 80), "wörd" * 40 + " b c d e"]
    data, offsets = vec.flat(pa.array(texts))
    for size in (1, 4):
        w = vec.Words(data, offsets)
        start, length, rows = w.windows(size)
        assert [int(x) for x in vec.majority(vec.xxh64(w.buf, start, length), rows)] == [fingerprint(t, size) for t in texts]


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["", None, "   ", "a b c", "A  b\nc", *noisy(rng, 150, 120)]
    rows = [(i * 3, t, "x", 1) for i, t in enumerate(texts)] + [(6000, texts[7], "y", 2), (6000, texts[7], "y", 2), (None, texts[8], "z", 3), (None, "lonely text here", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int")
    got = simhash_groups(docs).collect()
    want = brute_groups([(i, fingerprint(t)) for i, t, *_ in rows if i is not None], 4)
    assert len(got) == len(rows)
    for r in got:
        assert int.from_bytes(r.fp, "little") in {fingerprint(t) for _, t, *_ in rows}
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted([str(want[24]), "None"])


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_finds_every_pair_within_the_radius(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    near = base[:1500] ^ sum((np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64) for _ in range(1)), np.uint64(0))
    dense = base[7] ^ (np.uint64(1) << rng.integers(0, 12, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 1500, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, dense])).reshape(-1, 1)
    by_view = [shard_links(points, EXACT_64, v) for v in EXACT_64.views]
    a = np.tile(np.arange(len(points)), 2)
    from docketry.llm.simhash import roots

    got = roots(len(points), a, np.concatenate(by_view))
    x, y = [], []
    for i in range(len(points)):
        j = np.flatnonzero(np.bitwise_count(points[i + 1 :, 0] ^ points[i, 0]) <= 4) + i + 1
        x += [i] * len(j)
        y += j.tolist()
    assert (got == roots(len(points), np.array(x), np.array(y))).all()


def test_unsplittable_leaf_is_walked():
    rng = np.random.default_rng(4)
    ball = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64))
    points = np.unique(ball).reshape(-1, 1)
    assert (shard_links(points, EXACT_64, View(0, 1, 2)) == 0).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table_and_stage(spark):
    schema = "doc_id long, text string, lang string"
    assert simhash_groups(spark.createDataFrame([], schema)).count() == 0
    rng = random.Random(9)
    long = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(300)) for _ in range(6)]
    rows = [(i, t, "en") for i, t in enumerate(long)]
    near = long[2].split()
    near[50] = near[180] = "other"
    rows += [(10, long[0], "en"), (11, " ".join(near), None), (None, "no id", "en"), (3, long[3], "en")]
    kept = drop_near_copies(spark.createDataFrame(rows, schema), WIDE_512)
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 1, 2, 3, 4, 5, None]


def test_stage_decides_by_shingle_similarity(spark):
    """Chains of texts around 0.8: kept is what exact groups keep, neither fewer nor more."""
    rng = random.Random(21)
    rows, sets = [], {}
    for i in range(0, 1200, 3):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([12, 40, 150, 300]))]
        n = len(w) - 4
        texts = [w]
        for cut in rng.sample([0.05, 0.1, 0.105, 0.115, 0.13], 2)[: rng.randint(1, 2)]:
            t = list(w)
            for at in range(0, max(1, round(cut * n / 5)) * 9, 9):
                t[(at + 4) % len(t)] = f"x{rng.randint(0, 10**6)}"
            texts.append(t)
        for k, t in enumerate(texts):
            t = t if len(t) < 300 or k != 2 else t + ["again"] * 200  # one more shingle or a few, however often it is said
            rows.append((i + k, " ".join(t)))
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    lead = {i: i for i in sets}
    for i in sets:
        for j in range(i - i % 3, i):
            if j in sets and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low = min(lead[i], lead[j])
                lead = {k: low if v in (lead[i], lead[j]) else v for k, v in lead.items()}
    want = {i for i in sets if lead[i] == i}
    assert 100 < len(sets) - len(want) < len(sets) - 410
    got = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_stage_keeps_different_texts_of_one_doc_id(spark):
    rng = random.Random(10)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (3, d), (4, d)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (1, b), (3, c), (3, d)])
