"""String similarity by longest common subsequence: column expressions for words, Arrow UDFs over distinct pairs of texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: bit-parallel, a machine word of ``a`` at a time."""
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * common(a, b) / total if total else 100.0


def token_set(a: str, b: str) -> float:
    """Best of the ratios between the shared words and either side's rest; 100 if one side holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (both == x or both == y):
        return 100.0
    s, left, right = len(" ".join(sorted(both))), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    la, lb = s + (s > 0) + len(left), s + (s > 0) + len(right)
    scores = [100.0 - 100.0 * (len(left) + len(right) - 2 * common(left, right)) / (la + lb)]
    if s:
        scores += [100.0 - 100.0 * (1 + len(left)) / (s + la), 100.0 - 100.0 * (1 + len(right)) / (s + lb)]
    return max(0.0, *scores)


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of its length, or shorter at the edges, of the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, m = len(short), len(long)
    spans = [(k, k + n) for k in range(m - n + 1)] + [(0, k) for k in range(1, n)] + [(m - k, m) for k in range(1, n)]
    return max(ratio(short, long[i:j]) for i, j in spans)


def _pairwise(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        cached = lru_cache(100_000)(f)
        return pd.Series([None if x is None or y is None else cached(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


def udfs() -> dict:
    """ratio, token_set and partial as column functions."""
    return {name: _pairwise(f) for name, f in (("ratio", ratio), ("token_set", token_set), ("partial", partial))}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _masks(x: Column) -> Column:
    """For each letter of ``x`` (an array of at most 61) a long whose bits say where it stands."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    places = lambda c: F.aggregate(F.transform(x, lambda v, k: F.when(v == c, bit(k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda m, v: m.bitwiseOR(v))
    return F.map_from_entries(F.transform(F.array_distinct(x), lambda c: F.struct(c, places(c))))


def _narrow(n: Column, masks: Column, y: Column) -> Column:
    """Letters in common of a text of ``n`` letters, by its ``masks``, and ``y``: bit by bit in a long."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    of = lambda ch: F.coalesce(F.try_element_at(masks, ch), F.lit(0).cast("long"))
    step = lambda row, ch: let(row.bitwiseAND(of(ch)), lambda hit: (row + hit).bitwiseOR(row - hit).bitwiseAND(full))
    return n - F.bit_count(F.aggregate(y, full, step))


def _wide(x: Column, y: Column) -> Column:
    """The same for longer texts, row by row."""
    cell = lambda last, row, ch, k: F.when(F.get(x, k - 1) == ch, F.get(last, k - 1) + 1).otherwise(F.greatest(F.get(last, k), F.get(row, k - 1)))
    line = lambda last, ch: F.aggregate(F.sequence(F.lit(1), F.size(x)), F.array(F.lit(0)), lambda row, k: F.array_append(row, cell(last, row, ch, k)))
    return F.element_at(F.aggregate(y, F.array_repeat(F.lit(0), F.size(x) + 1), line), -1)


def letters_in_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: bit by bit in a long, for more than 61 letters row by row."""
    found = let(F.struct(_chars(a).alias("x"), _chars(b).alias("y")), lambda s: F.when(F.size(s["x"]) <= 61, _narrow(F.size(s["x"]), _masks(s["x"]), s["y"])).otherwise(_wide(s["x"], s["y"])))
    return F.when((a == "") | (b == ""), 0).otherwise(found)


def token_set_ratio(a: Column, b: Column) -> Column:
    """``token_set`` as a column expression."""
    words = lambda t: F.filter(F.array_distinct(F.split(t, r"(?U)\s+")), lambda w: w != "")
    text = lambda ws: F.concat_ws(" ", F.array_sort(ws))

    def score(p: Column) -> Column:
        s, nl, nr = F.char_length(p["both"]), F.char_length(p["left"]), F.char_length(p["right"])
        la, lb = s + F.when(s > 0, 1).otherwise(0) + nl, s + F.when(s > 0, 1).otherwise(0) + nr
        hundred = F.lit(100.0)
        whole = hundred - hundred * (nl + nr - 2 * letters_in_common(p["left"], p["right"])) / (la + lb)
        side = lambda n, length: F.when(s > 0, hundred - hundred * (1 + n) / (s + length))
        return F.when((s > 0) & ((nl == 0) | (nr == 0)), hundred).otherwise(F.greatest(F.lit(0.0), whole, side(nl, la), side(nr, lb)))

    parted = lambda w: F.struct(text(F.array_intersect(w["x"], w["y"])).alias("both"), text(F.array_except(w["x"], w["y"])).alias("left"), text(F.array_except(w["y"], w["x"])).alias("right"))
    found = let(F.struct(words(a).alias("x"), words(b).alias("y")), lambda w: F.when((F.size(w["x"]) == 0) | (F.size(w["y"]) == 0), 0.0).otherwise(let(parted(w), score)))
    return F.when(a.isNotNull() & b.isNotNull(), found)


BLOCK = 256  # letters of a block of a long text


def partial_reaches(a: Column, b: Column, least: int) -> Column:
    """Whether ``partial`` is at least ``least`` (60 and more), as a column expression.

    A window that reaches it misses or adds at most ``d`` letters, so of ``d`` + 1 pieces of the shorter text one stands in it
    unbroken. Only windows around such places are compared, and the few shorter ones at the edges.
    """
    if least < 60:
        raise ValueError("partial_reaches needs a ratio of 60 or more")

    def search(p: Column) -> Column:
        short, long, n, m = (p[c] for c in ("short", "long", "n", "m"))
        d, e = F.floor(2 * n * (100 - least) / 100).cast("int"), F.floor(n * (100 - least) / 100).cast("int")

        def common(window: Column) -> Column:
            return F.when(n <= 61, _narrow(n, p["masks"], _chars(window))).otherwise(letters_in_common(short, window))

        edge = lambda k: (200 * common(F.substring(long, 1, k)) >= least * (n + k)) | (200 * common(F.substring(long, m - k + 1, k)) >= least * (n + k))
        shortest = F.ceil(n * least / (200.0 - least)).cast("int")
        edges = F.when(shortest < n, F.exists(F.sequence(shortest, F.greatest(shortest, n - 1)), edge)).otherwise(False)

        def starts(k: Column) -> Column:
            """Where windows may begin that hold piece ``k``."""
            first, end = F.floor(k * n / (d + 1)).cast("int"), F.floor((k + 1) * n / (d + 1)).cast("int")
            piece = F.substring(short, first + 1, end - first)
            quoted = F.concat(F.lit(r"(?=\Q"), F.replace(piece, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
            parts = F.split(long, quoted, -1)  # each part but the first begins with the piece
            ends = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.lit(0)), lambda acc, t: F.array_append(acc, F.element_at(acc, -1) + F.char_length(t)))
            found = F.when(F.startswith(long, piece), ends).otherwise(F.slice(ends, F.lit(2), F.size(ends) - 1))
            return F.flatten(F.transform(found, lambda z: F.sequence(z - first - e, z - first + e)))

        near = F.array_distinct(F.filter(F.flatten(F.transform(F.sequence(F.lit(0), d), starts)), lambda i: (i >= 0) & (i <= m - n)))
        strange = lambda w: F.char_length(F.call_function("translate", w, short, F.lit("")))  # noqa: E731  letters that the short text lacks
        cut = lambda i: F.substring(F.get(p["blocks"], F.floor(i / BLOCK).cast("int")), i % BLOCK + 1, n)
        full = F.exists(near, lambda i: let(cut(i), lambda w: F.when(strange(w) <= e, 100 * common(w) >= least * n).otherwise(False)))
        return F.when(n == 0, m == 0).when(F.contains(long, short), True).otherwise(edges | full)

    def ordered(x: Column, y: Column) -> Column:
        first = F.char_length(x) <= F.char_length(y)
        return F.struct(F.when(first, x).otherwise(y).alias("short"), F.when(first, y).otherwise(x).alias("long"))

    def with_masks(p: Column) -> Column:
        n, m = F.char_length(p["short"]), F.char_length(p["long"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor(m / BLOCK).cast("int")), lambda k: F.substring(p["long"], k * BLOCK + 1, n + BLOCK))  # a letter is found by counting from the start
        return F.struct(p["short"], p["long"], n.alias("n"), m.alias("m"), F.when(n <= 61, _masks(_chars(p["short"]))).alias("masks"), blocks.alias("blocks"))

    return F.when(a.isNotNull() & b.isNotNull(), let(ordered(a, b), lambda p: let(with_masks(p), search)))


def resembles(a: Column, b: Column, least: int) -> Column:
    """Whether the ratio of two texts is at least ``least``; most pairs are told by their lengths, or by how many letters of one the other has."""
    n, m = F.char_length(a), F.char_length(b)
    shared = n - F.char_length(F.call_function("translate", a, b, F.lit("")))
    near = (200 * F.least(n, m) >= least * (n + m)) & (200 * shared >= least * (n + m))
    return F.when(a == b, True).when(near, 200 * letters_in_common(a, b) >= least * (n + m)).otherwise(False)


def without_repeated_tail(words: Column) -> Column:
    """While the last words repeat the words before them, they are dropped; the longest run first."""

    def once(left: Column) -> Column:
        n = F.size(left)
        runs = F.filter(F.sequence(F.greatest(F.floor(n / 2).cast("int"), F.lit(1)), F.lit(1), F.lit(-1)), lambda w: (2 * w <= n) & (F.slice(left, n - w + 1, w) == F.slice(left, n - 2 * w + 1, w)))
        return F.slice(left, F.lit(1), n - F.coalesce(F.get(runs, F.lit(0)), F.lit(0)))

    repeats = F.size(F.array_distinct(words)) < F.size(words)
    return F.when(repeats, F.aggregate(words, words, lambda left, _: once(left))).otherwise(words)


def without_echoes(words: Column, least: int = 80) -> Column:
    """Without repeated tails, and without last words that resemble an earlier one, until neither is left."""
    plain = lambda w: F.btrim(F.lower(w), F.lit(".,:;-"))

    def echoed(left: Column) -> Column:
        last = plain(F.element_at(left, -1))
        earlier = F.exists(F.slice(left, F.lit(1), F.size(left) - 1), lambda w: (plain(w) != "") & resembles(last, plain(w), least))
        return F.when(F.size(left) > 1, (last != "") & earlier).otherwise(False)

    step = lambda left: let(without_repeated_tail(left), lambda t: F.when(echoed(t), F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t))
    unsettled = (F.size(F.array_distinct(words)) < F.size(words)) | echoed(words)
    return F.when(unsettled, F.aggregate(words, words, lambda left, _: step(left))).otherwise(words)
