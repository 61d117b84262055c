"""Decontamination, language model, HTML and chat against plain-Python versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from docketry.llm.chat import escape, format_chats, formatted_digests, unescape
from docketry.llm.decontam import contaminated, decontaminate
from docketry.llm.htmlmain import OPEN, blocks, extract, first_pass, main_text, second_pass
from docketry.llm.lm import ADD, MU, score

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- language model


def brute_scores(rows, mu=MU):
    """Plain recursion: P(w|h) from counts of h and hw and P(w|h without its first word)."""
    tokens = {i: ["<s>", *WORD.findall(lower(t)), None] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    grams, after = Counter(), Counter()
    for i in train:
        for k in range(1, len(tokens[i])):
            for size in (0, 1, 2):
                if k >= size:
                    h = tuple(tokens[i][k - size : k])
                    grams[h, tokens[i][k]] += 1
                    after[h] += 1
    n, v = after[()], sum(not h for h, _ in grams)

    def p(h, w):
        if not h:
            return (grams[h, w] + ADD) / (n + ADD * (v + 1))
        return (grams[h, w] + mu[len(h) - 1] * p(h[1:], w)) / (after[h] + mu[len(h) - 1])

    out = {}
    for i, ws in tokens.items():
        s = sum(math.log10(p(tuple(ws[max(0, k - 2) : k]), ws[k])) for k in range(1, len(ws)))
        out[i] = (len(ws) - 1, sum(grams[(), w] > 0 for w in ws[1:]), n, sum(math.log10(p((), w)) for w in ws[1:]), s)
    return out


def same_scores(got, want, rows):
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)


HELD = "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0"


def test_lm_equals_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, " \n", "A a a A", "É é the", *(" ".join(rng.choice(["the", "Cat", "sat", "on", "x" + str(rng.randint(0, 30))]) for _ in range(rng.randint(0, 60))) for _ in range(80)), "long " * 3000]
    texts += [" ".join(rng.choice(["the", "cat", "y" + str(rng.randint(0, 9))]) for _ in range(9000)), texts[20], texts[20]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 0.5, "b", 1) for i, t in rows], "doc_id long, text string, score double, held_out string, chunk int").repartition(5)
    want = brute_scores(rows)
    same_scores(score(docs, HELD, stable=False, chunk_bytes=4000, bucket_keys=20).collect(), want, rows)
    same_scores(score(docs, HELD, stable=False).collect(), want, rows)


def test_lm_says_when_its_rows_come_in_another_order(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j * k % 17}" for j in range(20))) for k in range(60)], "doc_id long, text string").coalesce(1)
    dealt = docs.mapInPandas(lambda frames: (f.sample(frac=1) for f in frames), docs.schema)  # another order each time it runs
    assert score(dealt, HELD, stable=False).count() == 60
    with pytest.raises(Exception, match="stable=False"):
        score(dealt, HELD).collect()


def test_lm_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert score(spark.createDataFrame([], schema), "doc_id = 1").count() == 0
    for rows in ([(1, None), (2, None), (3, None)], [(10, "all held out"), (10, "all held out")]):
        got = score(spark.createDataFrame(rows, schema), HELD, stable=False).collect()
        want = brute_scores(rows) if rows[0][0] == 1 else None
        assert all(r.base_score < 0 and r.score < 0 for r in got) and len(got) == len(rows)
        if want:
            same_scores(got, want, rows)


def test_runs_carry_the_state_across_their_borders():
    import numpy as np
    import pyarrow as pa
    from docketry.llm import vec
    from docketry.llm.lm import Automaton, Chunk

    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 90))) for _ in range(30)]
    chunk = Chunk(*vec.flat(pa.array(texts)), np.arange(30) % 4 == 0)
    machine = Automaton(chunk, chunk.counts, chunk.starts, int(chunk.counts[0].sum()), int((chunk.counts[0] > 0).sum()))
    assert np.allclose(machine.traverse(chunk), machine.traverse(chunk, 7), rtol=1e-12)


# --- decontamination


def brute_matches(docs, items):
    split = lambda t: re.split(r"[ \t\n\x0b\f\r]+", t.lower().strip(" \t\n\x0b\f\r")) if t else []
    found = set()
    for d, text in docs:
        w = split(text)
        shingles = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, item in items:
            x = split(item)
            own = Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
            m = sum(own.values())
            for s in range(max(1, len(shingles) - m + 1)) if m and shingles else ():
                part = Counter(shingles[s : s + m])
                both = sum((part & own).values())
                if both / (m + sum(part.values()) - both) >= 0.8:
                    found.add((d, i))
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randint(0, 400))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([12, 12, 20, 33, 33, 47, 60])] + [(90, None), (91, ""), (92, "too short item"), (93, "a b a b a b a b a b a b")]
    docs = []
    for k in range(60):
        body = [word() for _ in range(rng.randint(0, 120))]
        if k % 2:
            w = items[rng.randrange(7)][1].upper().split()
            if k % 3 == 0:
                w[len(w) // 2] = "other"
            if k % 5 == 0:
                w = w[: len(w) // 2]
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append((k, " ".join(body) if k % 7 else " \n".join(body)))
    docs += [(80, " ".join([*(word() for _ in range(20_000)), items[3][1], *(word() for _ in range(20_000))]))]  # a very long text
    docs += [(70, None), (71, ""), (72, docs[1][1]), (72, docs[1][1]), (73, items[6][1][: len(items[6][1]) * 19 // 20]), (74, "x a b a b a b a b a b a b y")]
    table = spark.createDataFrame([(i, t, "h") for i, t in docs], "doc_id long, text string, h string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_matches(docs, items)
    got = contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 15
    assert len([r for r in got if r.doc_id == 72]) == 2 * len({i for d, i in want if d == 72})
    kept = decontaminate(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {x for x, _ in want})
    assert decontaminate(table, bench.limit(0)).count() == len(docs)
    assert contaminated(table.limit(0), bench).count() == 0


# --- HTML


def test_article_page():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>'
        "<article><header><h1>Head &amp; line</h1><span>by</span></header><p><b>First\n  part.<br>Second &eacute; &#233; &unknown;<p>Be.</p><script>var a='</p>';</script><p>A < b</p>"
        '<aside>side</aside><div id="comments"><p>I think so</p></div><form><p>Name</p></form></article><footer>&copy; x</footer></body></html>'
    )
    assert main_text(page) == "Head & line\n\nFirst part. Second é é &unknown;\n\nBe.\n\nA < b"


def test_page_without_article_is_decided_by_density_and_neighbours():
    body = "This is the first paragraph of the story and it is long enough to be sure of it."
    page = f'<div><a href="a">One</a> <a href="b">Two</a></div><div><h2>Title</h2><p>{body}</p><p>Short.</p><p>{body}</p></div><p><a href="c">Three</a></p><p class="cookie-notice">{body}</p>'
    assert main_text(page) == f"Title\n\n{body}\n\nShort.\n\n{body}"
    assert OPEN in first_pass(blocks(page))
    assert second_pass([OPEN, 0, OPEN, 1, OPEN], [False] * 5) == [0, 0, 0, 1, 1] and second_pass([0, OPEN, 1], [False, True, False]) == [0, 1, 1]


def test_an_article_is_a_prior_within_the_density_rules():
    body = "This is the first paragraph of the story and it is long enough to be sure of it, as it goes on for a while and says what it has to say."
    teaser = "<article><h2>Related story</h2></article>"
    assert main_text(f"<div><p>{body}</p><p>{body}</p></div>{teaser}") == f"{body}\n\n{body}"
    links = "".join(f'<li><a href="{k}">Other story {k}</a></li>' for k in range(3))
    comment = f'<ul>{links}</ul><p>Nice one</p><p><a href="r">Reply</a></p>'
    assert main_text(f"<article><h1><a href='/'>Title</a></h1><p>{body}</p><p>Short.</p>{comment}</article><p>Stray words</p>") == f"Title\n\n{body}\n\nShort."
    assert OPEN in first_pass(blocks(f"<article><h1>Title</h1><p>{body}</p></article>"))
    labels = [1, OPEN, OPEN, 0, 0, OPEN, 1]
    assert second_pass(labels, [False] * 7) == [1, 1, 0, 0, 0, 0, 1]


def test_only_an_elements_own_names_hush_it():
    body = "This is the first paragraph of the story and it is long enough to be sure of it, as it goes on for a while."
    for frame in ('<div class="layout with-sidebar">', '<div id="page" class="has-navbar">', '<div data-role="menu" title="a hidden ad">'):
        assert main_text(f"{frame}<p>{body}</p></div>") == body
    assert main_text(f'<article><p title="a hidden gem">{body}</p><p data-id="ad">{body}</p></article>') == f"{body}\n\n{body}"
    for frame in ('<div class="page sidebar">', "<div hidden>", '<div role="navigation">', '<div style="color:red; display : none">', "<div id=siteFooter>"):
        assert main_text(f"<div><p>{body}</p></div>{frame}<p>{body} {body}</p></div>") == body
    assert main_text(f'<div class="sidebar"><article><p>{body}</p><div class="ad"><p>{body}</p></div></article></div>') == body


def test_second_pass_equals_a_plain_search():
    rng = random.Random(14)
    for _ in range(300):
        labels, headings = [rng.choice([0, 1, OPEN, OPEN]) for _ in range(rng.randint(0, 15))], [rng.random() < 0.3 for _ in range(15)]
        decided = [i for i, v in enumerate(labels) if v != OPEN]
        want = [v if v != OPEN else labels[min(decided, key=lambda d, i=i: (abs(d - i), (d < i) == headings[i]))] if decided else 0 for i, v in enumerate(labels)]
        assert second_pass(labels, headings[: len(labels)]) == want


def test_many_blocks_take_time_in_proportion():
    import time

    for page in ("<article>" + "<p>word is the one of it</p>" * 100_000 + "</article>", "<div>" * 50_000 + "<p>x" * 50_000, "<div class=ad>" * 50_000 + "</p>" * 50_000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 8


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<", "<!-- open", "<script>never closed", '<a href="x>broken', "</div></div>", "<div class=ad>" * 400])
def test_odd_pages(page):
    assert isinstance(main_text(page), str)


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a  b</p></article>", "x"), (1, "u", "<article><p>a  b</p></article>", "x"), (None, None, None, None), (3, "v", "<article>" + "<p>word</p>" * 20000 + "</article>", "y")], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text) for r in extract(pages).collect()}
    assert got == {(1, "a b"), (None, ""), (3, "\n\n".join(["word"] * 20000))}
    assert extract(pages.limit(0)).count() == 0


# --- chat


def test_escape_round_trip():
    for t in ["", "</s>", "␛", "␛1", "␛</s>␛␛9[INST]", "</s</s>>", "<<SYS>><<ROLE>>é", "[ANS][/INST]<s>"]:
        e = escape(t)
        assert unescape(e) == t and not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|\[ANS\]|<<ROLE>>|<<TEXT>>", e)


def test_digests_equal_the_turns(spark):
    control = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello é 漢字 🙂"), (1, 3, "assistant", None), (1, 4, "assistant", "again"), (2, 1, "assistant", control), (2, 0, "user", control), (3, 0, "tool", "␛0 <<TEXT>>")]
    rows += [(3, 1, None, "n"), (3, None, "user", "first"), (None, 0, "user", "no conversation"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "<<TEXT>>", ""), *((6, k, ("user", "assistant")[k % 2], "word " * 300) for k in range(40))]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, input_ids string")
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        by.setdefault(c, []).append((r or "", x or ""))
    from docketry.llm.chat import read_back

    for parts in (None, 500):
        got = {r.conv_id: r for r in (formatted_digests(turns) if parts is None else read_back(format_chats(turns, part_tokens=parts))).collect()}
        assert set(got) == set(by)
        for c, said in by.items():
            loss = "".join(x for r, x in said if r == "assistant")
            assert got[c].n_turns == len(said)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert formatted_digests(turns.limit(0)).count() == 0


def test_bags_are_made_in_pieces():
    """features of a batch of long texts take memory for a piece of it, and are those of each text alone."""
    import tracemalloc

    import pyarrow as pa
    from docketry.llm import features

    texts = [" ".join(f"w{(k * 37 + j * 11) % 900}" for j in range(n)) for k, n in enumerate([3, 0, 20_000, 1, 7] * 60)]
    column = pa.array(texts)
    tracemalloc.start()
    keys, counts, stats = features.bag(column)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = [features.bag(pa.array([t])) for t in texts[:10]]
    assert keys[:10] == [a[0][0] for a in alone] and counts[:10] == [a[1][0] for a in alone]
    assert (stats[:10] == [a[2][0] for a in alone]).all() and len(keys) == len(counts) == len(stats) == 300
    assert features.bag(pa.array([], pa.string()))[2].shape == (0, features.STATS)
    assert most < 80 << 20  # whole batches took 137
