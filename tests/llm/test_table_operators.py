"""Archives, sharding, embeddings, classifiers and mixing."""

import base64
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from docketry.llm.embdedup import near_vectors
from docketry.llm.mixing import CORPUS, TARGETS, mix, mixed, solve
from docketry.llm import quality
from docketry.llm.features import Descent, softmax, token_buckets
from docketry.llm.quality import classify, keep_good
from docketry.llm.queries import op8_flow_reshard
from docketry.llm.reshard import even, minimum_cost_flow, reshard, rewrite_shards
from docketry.llm.warc import deduplicated_records, read_archives, resolve, rewrite, write_archives
from pyspark.sql import functions as F


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/é", "<p>x</p>"), (5, None, "<p>x</p>"), (3, "http://c/\r\nX: y", ""), (4, "u", None), (None, "n", "<p>x</p>"), (6, "v", "é" * 100_000), (7, "w", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (7, "w", "a\r\n\r\nWARC/1.1\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = deduplicated_records(pages).collect()
    assert len(got) == len(rows)
    leads = {"<p>x</p>": 5, "": 4, "é" * 100_000: 6, "a\r\n\r\nWARC/1.1\r\n\r\nb": 7}
    seen = []
    for r in got:
        text = next(h or "" for p, _, h in rows if p == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), digest(text))
        assert r.refers_to == (leads[text] if r.record_type == "revisit" else None)
        seen.append((r.page_id, r.record_type))
    assert sorted(p for p, t in seen if t == "response") == [4, 5, 6, 7]
    assert seen.count((7, "revisit")) == 1
    first, last = str(tmp_path / "a"), str(tmp_path / "b")
    whole = read_archives(rewrite(resolve(write_archives(pages, first)), first, last), last, payloads=True).where("record_type = 'response'").collect()
    assert {r.page_id: r.html for r in whole} == {5: "<p>x</p>", 4: "", 6: "é" * 100_000, 7: "a\r\n\r\nWARC/1.1\r\n\r\nb"}
    assert deduplicated_records(pages.limit(0)).count() == 0


def test_flow_is_least(spark):
    rng = random.Random(1)
    for _ in range(5):
        supply = [rng.randint(0, 50) for _ in range(4)]
        room = even(sum(supply), 6)
        flow = minimum_cost_flow(supply, room, lambda i, j: int(i != j))
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(4)] == supply
        assert all(sum(f for (_, j), f in flow.items() if j == k) <= room[k] for k in range(6))
        assert sum(f for (i, j), f in flow.items() if i != j) == sum(max(0, s - room[k]) for k, s in enumerate(supply))
    costs = [[3, 1, 2], [1, 4, 2]]
    assert minimum_cost_flow([2, 1], [1, 1, 1], lambda i, j: costs[i][j]) == {(0, 1): 1, (0, 2): 1, (1, 0): 1}


def test_shards(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400), "k") for i in range(3000)] + [(5000, None, "k"), (5001, "", None), (None, "no id", "k"), (7, "dup", "k"), (7, "dup", "k"), (6000, "é" * 3000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    placed = reshard(docs, 10, given_shards=8)
    got = placed.collect()
    assert len(got) == len(rows)
    assert sorted(((r.row.doc_id, r.row.text, r.row.shard) for r in got), key=str) == sorted(rows, key=str)
    sizes = [0] * 10
    for r in got:
        assert r["size"] == len((r.row.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.row.text or "").encode())
        sizes[r.shard] += r["size"]
    assert max(sizes) - min(sizes) < 800
    for k in range(10):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    old = [sum(r["size"] for r in got if r.old_shard == k) for k in range(8)]
    least = sum(max(0, o - c) for o, c in zip(old, even(sum(sizes), 10), strict=False))
    assert sum(r["size"] for r in got if r.old_shard != r.shard) <= least + 8 * 1000
    touched = rewrite_shards(reshard(docs.drop("shard"), 10, given_shards=8), str(tmp_path / "out"))
    assert touched.count() == 10 and spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert reshard(docs.limit(0), 10).count() == 0


def test_rewriting_leaves_untouched_shards_alone(spark, tmp_path):
    row = "struct<doc_id: long, text: string>"
    folder = str(tmp_path / "shards")
    before = [(i, "t" * i, i % 4, i % 4, i // 4) for i in range(40)]
    old = spark.createDataFrame([(len(t) + 16, o, s, k, (i, t)) for i, t, o, s, k in before], f"size long, old_shard int, shard int, slot long, row {row}")
    rewrite_shards(old, folder, every=True)
    spark.createDataFrame([(99, "from elsewhere", 0)], "doc_id long, text string, slot long").write.parquet(f"{folder}/shard=9")
    # all of shard 3 goes to shard 1
    new = old.withColumn("slot", F.when(F.col("old_shard") == 3, F.col("slot") + 10).otherwise(F.col("slot"))).withColumn("shard", F.when(F.col("old_shard") == 3, 1).otherwise(F.col("shard")))
    assert sorted(r.shard for r in rewrite_shards(new, folder).collect()) == [1, 3]
    got = spark.read.parquet(folder).collect()
    assert {(r.doc_id, r.shard) for r in got} == {(i, 1 if i % 4 == 3 else i % 4) for i in range(40)} | {(99, 9)} and len(got) == 41


def test_placement_equals_a_plain_version(spark):
    """Old shards are laid out by block and row; a row's middle byte says which piece of the flow it falls into."""
    rng = random.Random(6)
    rows = [(i, "x" * rng.choice([0, 3, 50, 400, 20_000 if i % 90 == 0 else 7])) for i in range(900)]
    got = {r.doc_id: r for r in reshard(spark.createDataFrame(rows, "doc_id long, text string"), 6, given_shards=4).collect()}
    size = {i: len(t) + 16 for i, t in rows}
    supply = [sum(size[i] for i in size if got[i].old_shard == k) for k in range(4)]
    room = even(sum(supply), 6)
    for k in range(4):
        stays = sum(size[i] for i in size if got[i].old_shard == got[i].shard == k)
        assert stays >= min(supply[k], room[k]) - 20_016  # what fits stays, but for the row across the border
    for j in range(6):
        assert abs(sum(size[i] for i in size if got[i].shard == j) - room[j]) <= 4 * 20_016
        of = sorted((got[i].slot, got[i].old_shard, i) for i in size if got[i].shard == j)
        assert [s for s, *_ in of] == list(range(len(of))) and [o for _, o, _ in of] == sorted(o for _, o, _ in of)


def test_query_digests_come_from_shard_files(spark, tmp_path):
    rows = [(i, "ab" * (i % 50), "en") for i in range(500)] + [(900, None, None), (901, "é", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_flow_reshard(spark, str(tmp_path))
    files = [f for f in got.inputFiles() if "/shard=" in f]
    assert files
    stored = spark.read.parquet(files[0].split("/shard=")[0]).select("doc_id", "text", "lang", "shard", "slot").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in stored) == sorted(rows)
    at = {r.doc_id: r for r in stored}
    for r in got.collect():
        assert (r.shard, r.slot) == (at[r.doc_id].shard, at[r.doc_id].slot)
        text = (at[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32) == (len(text) + 16, zlib.crc32(text))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert any("/shard=" in f for f in corpus_pipeline.sharding(spark, docs, str(tmp_path)).inputFiles())
    assert corpus_pipeline.sharding(spark, docs.limit(0), str(tmp_path)).count() == 0
    clash = corpus_pipeline.sharding(spark, docs.withColumn("Shard", F.lit("own")).withColumn("slot", F.lit(-1)), str(tmp_path))
    assert clash.columns == [*docs.columns, "Shard", "slot", "shard_", "slot_"] and clash.where("Shard = 'own' and slot = -1").count() == len(rows)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((260, 16)).astype(np.float32)
    near = base[:80] + 0.12 * rng.standard_normal((80, 16)).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(np.concatenate([base, near]))]
    rows = [(i, v, rows[(i - 260) % 260][2] if i >= 260 else k) for i, v, k in rows]
    rows += [(400 + k, base[0].tolist(), 0) for k in range(30)] + [(500, (2 * base[0]).tolist(), 0), (501, base[0].tolist(), 1), (502, base[0].tolist(), None)]
    rows += [(503, None, 0), (504, [0.0] * 16, 0), (505, [float("nan")] * 16, 0), (506, [None, *base[0].tolist()[1:]], 0), (507, [], 0), (508, [1.0, 2.0], 0), (600, base[5].tolist(), 2), (600, base[5].tolist(), 2)]
    live = [(i, np.array(v, np.float64), k) for i, v, k in rows if v and None not in v and k is not None and np.isfinite(v).all() and any(v)]
    links, group = {}, {i: i for i, *_ in rows}
    pairs = []
    for x, (i, v, k) in enumerate(live):
        for y, (j, w, m) in enumerate(live):
            if x != y and k == m and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.93:
                links[x] = links.get(x, 0) + 1
                pairs.append((i, j))
    for _ in range(20):
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    want = sorted([(i, links.get(x, 0), group[i]) for x, (i, *_) in enumerate(live)] + [(i, 0, i) for i in (502, 503, 504, 505, 506, 507)])
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = near_vectors(vectors, recall=0.99999, part_rows=16).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors(vectors.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(600):
        good, toxic = i % 4 > 0, i % 5 == 0
        w = [word() for _ in range(rng.randint(30, 80))]
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[3] = w[9] = "idiot"
        lang = ("en", "fr", "de", "es")[i % 4 if i % 3 else 0]
        docs.append((i, " ".join([*w, *[lang * 3] * 20]), lang, f"src{i % 7}", 10 * len(w), "x"))
        if i % 7 < 4:
            labels.append((i, int(good), int(toxic)))
    docs += [(900, None, None, None, None, "x"), (901, "", "en", "s", 0, "x"), (None, "no id here", "en", "s", 10, "x"), (11, docs[11][1], "de", "src4", 5, "x")]
    labels += [(5, None, None), (None, 1, 0), (3, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    unseen = [i for i in range(600) if i % 7 >= 4]
    assert sum((got[i].quality >= 0.5) == (i % 4 > 0) for i in unseen) >= 0.95 * len(unseen)
    assert sum((got[i].toxicity >= 0.5) == (i % 5 == 0) for i in unseen) >= 0.9 * len(unseen)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    alone = classify(docs, labels.limit(0)).collect()
    assert len(alone) == 604 and all(r.kept and r.quality == 1 and r.toxicity == 0 for r in alone)
    assert classify(docs.limit(0), labels).count() == 0


def plain_cotraining(rows, truth, share, rounds):
    """Co-training with dense matrices and plain descent on one machine; returns doc number -> (quality, toxicity)."""
    import pyarrow as pa

    cols = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.string()), (4, pa.float64()))]
    from docketry.llm import vec

    ids, at, stats = token_buckets(*vec.flat(cols[0]))
    used, at_used = np.unique(ids, return_inverse=True)
    words = np.zeros((len(rows), len(used)))
    for k in range(len(rows)):
        np.add.at(words[k], at_used[at[k] : at[k + 1]], 1 / np.sqrt(max(at[k + 1] - at[k], 1)))
    dense = {"text": stats, "meta": quality.metadata(*cols[1:])}

    def trained(view, target, y):
        on = np.flatnonzero(y >= 0)
        x, truth = dense[view][on], np.eye(2)[y[on]]
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        scaled = lambda d: np.concatenate([np.clip((d - mean) / scale, -4, 4), np.ones((len(d), 1))], axis=1)
        a, every = scaled(x), scaled(dense[view])
        if view == "text":
            held = (words[on] > 0).T.astype(float) @ truth
            often, held = held.sum(axis=1) >= 3, held + 1
            size = truth.sum(axis=0) + 2
            ratio = np.clip(np.log(held / size) - np.log(held[:, ::-1] / size[::-1]), -6, 6) * often[:, None]
            # a column's weights are multiples of its own ratio; a class sees ratio * weight
            a, every = np.concatenate([words[on], a], axis=1), np.concatenate([words, every], axis=1)
            factor = np.concatenate([ratio, np.ones((dense[view].shape[1] + 1, 2))])
        else:
            factor = np.ones((dense[view].shape[1] + 1, 2))
        w, decay = np.zeros_like(factor), quality.DECAY[view, target]
        from_scratch = Descent(w.ravel())
        for _ in range(600):
            w = from_scratch.point.reshape(factor.shape)
            chance = softmax(a @ (w * factor))
            slope = factor * (a.T @ (chance - truth)) / len(on) + decay * w
            from_scratch.told(-np.log((chance * truth).sum(axis=1)).mean() + decay / 2 * (w * w).sum(), slope.ravel())
        z = every @ (from_scratch.best.reshape(factor.shape) * factor)
        return np.clip(z[:, 1] - z[:, 0], -30, 30)

    out = []
    for target, (learn, check) in truth.items():
        shares = [np.mean([v == c for v in (*learn.values(), *check.values())]) for c in (0, 1)]
        known, said = {*learn, *check}, {"text": {}, "meta": {}}
        pool = [k for k in range(len(rows)) if k not in known]
        for k in range(1, rounds + 1):
            margins = {}
            for view in ("text", "meta"):
                y = np.full(len(rows), -1)
                for i, v in {**learn, **said[view]}.items():
                    y[i] = v
                margins[view] = trained(view, target, y)
            if k < rounds:
                for view, other in (("text", "meta"), ("meta", "text")):
                    said[other] = {}
                    for c in (0, 1):
                        sure = [i for i in pool if (margins[view][i] > 0) == c and abs(margins[view][i]) >= np.log(0.97 / 0.03)]
                        sure.sort(key=lambda i: -abs(margins[view][i]))
                        said[other] |= dict.fromkeys(sure[: int(np.ceil(k * share * len(pool) * shares[c]))], c)
        rows_, y = list(check), np.array(list(check.values()))
        platt = [quality.logistic(margins[v][rows_][:, None], y) for v in ("text", "meta")]
        views = [w[0] * margins[v] + w[1] for w, v in zip(platt, ("text", "meta"), strict=True)]
        w = quality.logistic(np.stack([x[rows_] for x in views], axis=1), y)
        out.append(1 / (1 + np.exp(-(views[0] * w[0] + views[1] * w[1] + w[2]))))
    return out


def test_cotraining_equals_a_plain_version(spark, labelled):
    docs, labels = labelled
    docs = docs.where("doc_id < 300")
    rows = sorted([tuple(r)[:5] for r in docs.collect()], key=lambda r: (r[0], str(r[2])))
    rows = [r for k, r in enumerate(rows) if r[0] != 11 or r[2] != "de"]  # one row of each document is learned from
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    number = {r[0]: k for k, r in enumerate(rows)}
    known = quality.labelled_rows(docs, labels, 10_000).collect()
    truth = {t: ({number[r.doc_id]: r[t] for r in known if r[t] is not None and not r[f"{t}_apart"]}, {number[r.doc_id]: r[t] for r in known if r[t] is not None and r[f"{t}_apart"]}) for t in ("quality", "toxic")}
    want = plain_cotraining(rows, truth, 0.2, 2)
    models = quality.fit(docs, labels, rounds=2, passes=(60, 40), share=0.2)
    got = {r.row.doc_id: (r.quality, r.toxicity) for r in quality.score(docs, models).collect()}
    apart = np.array([[got[i][0] - want[0][k], got[i][1] - want[1][k]] for i, k in number.items()])
    assert np.quantile(np.abs(apart), 0.95) < 0.03 and np.abs(apart).mean() < 0.01
    assert np.mean([(got[i][0] >= 0.5) == (want[0][k] >= 0.5) and (got[i][1] >= 0.5) == (want[1][k] >= 0.5) for i, k in number.items()]) > 0.98


def test_classifier_on_odd_rows(spark):
    """An ``n_chars`` that is no number, very long texts, one labelled row of a class, and one class only."""
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad!! ##") * (40_000 if i < 2 else 3), "en", "s", "many") for i in range(12)], "doc_id long, text string, lang string, source string, n_chars string")
    for labels in ([(i, i % 2, 0) for i in range(8)], [(1, 1, 0), (2, 0, 0)], [(1, 1, 1)]):
        models = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), passes=(4, 2))
        got = quality.score(docs, models).collect()
        assert len(got) == 12 and all(0 <= r.quality <= 1 and 0 <= r.toxicity <= 1 for r in got)


def test_mixing_reaches_its_targets(spark, labelled):
    docs, labels = labelled
    got = mix(docs, labels).collect()
    assert len(got) == 604 and all(r.rate >= 0 for r in got)
    total = sum(r.n_tokens * r.rate for r in got)
    for d, (name, w) in enumerate(TARGETS.items()):
        assert sum(r.n_tokens * r.rate * r.posterior[d] for r in got) == pytest.approx(w * total, rel=2e-3), name
    assert min(r.copies for r in got) >= 1
    assert {r.doc_id for r in mixed(docs, labels).collect()} == {r.doc_id for r in got}
    assert mix(docs.limit(0), labels).count() == 0 and mix(docs, labels.limit(0)).count() == 604


def test_rates_meet_given_targets_and_the_optimality_conditions(spark):
    """Held against the conditions of the constrained least-squares problem, not against another run of the steps:
    no document with a positive rate has a slope, and none at zero would gain by a negative one."""
    rng = np.random.default_rng(5)
    n, p = rng.integers(1, 90, 60), rng.dirichlet([0.3, 0.3, 0.3], 60)
    members = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")
    base = (n[:, None] * p).sum(axis=0)
    for factors, met in (([0.5, 1.5, 1.0], True), ([0.3, 0.2, 0.9], True), ([0.0, 0.2, 3.0], False)):
        targets = base * factors
        got = {r.doc_id: r for r in solve(members, targets.tolist(), steps=100, close=1e-9).collect()}
        r = np.array([got[i].rate for i in range(60)])
        have = (n * r) @ p
        slope = p @ ((have - targets) / base)
        assert (r >= 0).all() and (np.abs(slope[r > 1e-6]) < 2e-2).all() and (slope[r <= 1e-6] > -2e-2).all()
        whole = [abs(h - t) / t if t else h / targets.sum() for h, t in zip(have, targets, strict=True)]
        assert got[0].residual == pytest.approx(max(whole), abs=1e-6) and (got[0].residual < 1e-2) == met
        assert met or (r == 0).any()


def test_mixing_to_a_given_total(spark, labelled):
    docs, labels = labelled
    weights = {"en": 0.1, "fr": 0.3, "de": 0.3, "es": 0.3}
    got = mix(docs, labels, weights, CORPUS).collect()
    total = sum(r.n_tokens for r in got)
    for d, w in enumerate(weights.values()):
        assert sum(r.n_tokens * r.rate * r.posterior[d] for r in got) == pytest.approx(w * total, rel=2e-3)
    assert min(r.rate for r in got) < 0.5 and all(r.residual <= 1e-4 for r in got) and min(r.copies for r in got) == 0
