"""Hard negatives, phrase collocations and source mixing against plain versions on small messy tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ethogrid.llm import hard_negatives as N
from ethogrid.llm import mixing as M
from ethogrid.llm import phrases as P
from tests.llm import helpers as H

CLASH = [*H.CLASH, "row", "label_", "limits", "block", "dim", "copies", "size", "draw", "target", "source_size", "ratio", "level", "ids", "grp", "salts", "word", "f"]


def with_clash(df, own):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in own])


# --- hard negatives ---


def vector_rows(n=400, seed=3):
    rng = random.Random(seed)
    bases = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(n):
        b = rng.choice(bases)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.2))) for x in b], rng.choice([0, 0, 0, 1, 2, 9])))
    rows += [rows[5], rows[100], rows[100], (100, rows[7][1], 0), (-100, rows[8][1], 0), (200, rows[9][1], None), (300, None, 1), (301, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1)]
    rows += [(302, [0.1, float("nan"), 0.2, 0.1, 0.1, 0.1], 1), (303, [float("inf")] * 6, 1), (None, rows[1][1], 1)]
    rows += [(1000, [], 1), (1001, [], 1), (1002, [], 2), (1100, [0.5, 0.25], 3), (1101, [0.5, 0.25], 3), (1102, [0.25, 0.25], 4), (1103, [-0.5, 0.1], 4), (1104, [0.25, 0.25], 4)]
    return rows + [(2000 + i, rows[200][1], 5) for i in range(150)]  # copies


def brute_negatives(rows):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for r, (i, label, v) in enumerate(kept):
        if i % 100:
            continue
        all_ = [(-dot(v, w), j, s, lab) for s, (j, lab, w) in enumerate(kept) if s != r and len(w) == len(v)]
        for score, j, _, _ in sorted(x for x in all_ if x[3] == label)[:5]:
            ps = -score
            good = sorted((s, k) for s, k, _, lab in all_ if lab != label and 30 * ps <= -100 * s <= 90 * ps)[:10]
            for rank, (s, k) in enumerate(good, 1):
                out[(i, j, rank, k, ps, -s)] += 1
    return out


@pytest.mark.parametrize("shard_rows,block", [(100_000, 4_000), (60, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(N, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(N, "ANCHOR_BLOCK", block)
    rows = vector_rows()
    df = with_clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), ["vec_id", "embedding", "label"])
    got = Counter(tuple(r) for r in N.hard_negatives(N.labelled(df)).collect())
    want = brute_negatives(rows)
    assert sum(want.values()) > 100
    assert got == want


def test_hard_negatives_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert N.hard_negatives(N.labelled(df)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 60, (20, 16))
    v = np.floor(centers[rng.integers(0, 20, 3000)] + rng.normal(0, 15, (3000, 16)))
    v[:50] = v[0]
    approx = N.Approximation(v)
    for q in v[::500]:
        low, high = approx.bounds(q, 0, len(v))
        exact = v @ q
        assert (low <= exact).all() and (exact <= high).all()
        near = N.near_places(approx, q, 0, len(v), 6)
        assert set(np.argsort(-exact, kind="stable")[:6].tolist()) <= set(near.tolist()) or exact[near].min() <= np.sort(exact)[-6]
        assert len(near) < 600
        ps = np.sort(exact)[-2]
        at = N.window_places(low, high, 0.3 * ps, 0.9 * ps, 10)
        inside = np.flatnonzero((exact >= 0.3 * ps) & (exact <= 0.9 * ps))
        best = np.sort(exact[inside])[::-1][:10]
        assert (np.sort(exact[np.intersect1d(at, inside)])[::-1][:10] == best).all()
        assert len(at) < 1500


# --- phrases ---


def phrase_rows(seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "a", "cat", "New", "York", "é", "Ünder", "x|y", "\x00", "rare"]
    weights = [30, 20, 10, 8, 6, 6, 4, 3, 2, 1, 1]
    rows = []
    for i in range(160):
        t = ""
        for _ in range(rng.randint(0, 60)):
            t += rng.choices(words, weights)[0] + rng.choices([" ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", " the the the "], [60, 4, 4, 6, 4, 2, 1, 1, 3])[0]
        rows.append((i, t, rng.choice(["en", "en", "en", "de", None])))
    line = "One line that all of the texts may share, and this too. "
    rows += [(1000 + i, line * 3, "en") for i in range(60)] + [(5, None, "en"), (6, "", None), (7, " \t", "fr"), (8, "a b " * 3000, "und"), (9, "!.?", ""), rows[3], rows[3]]
    return rows


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= 100 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in cand.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (s, a, g, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least,top,group", [(3, 2000, 4_000_000), (8, 20, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top, group):
    monkeypatch.setattr(P, "GROUP_WORDS", group)  # small: many groups, and frequent pivots are salted
    rows = phrase_rows()
    df = with_clash(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), ["doc_id", "text", "lang"])
    got = sorted(tuple(r) for r in P.collocations(df, least, top).collect())
    assert len(got) > 40
    assert got == brute_phrases(rows, least, top)


def test_phrases_of_an_empty_table_and_of_texts_without_words(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, ". , \n", "en")]):
        assert P.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() == []


def test_each_phrase_belongs_to_the_leftmost_of_its_rarest_word():
    rng = random.Random(2)
    ranks = np.array([rng.choice([0, 0, 0, 1, 1, 2, 3, 7, P.END]) for _ in range(3000)], np.int32)
    want = Counter()
    for i in range(len(ranks)):
        for m in range(2, 6):
            g = ranks[i : i + m].tolist()
            if len(g) == m and P.END not in g:
                want[tuple(g)] += 1
    _, rows = P.fragments(ranks)
    assert (rows.max(axis=1) == rows[:, P.REACH]).all()  # no word rarer than the pivot travels with it
    assert not (rows[:, : P.REACH] == rows[:, P.REACH, None]).any()
    for least in (1, 40):
        got = Counter()
        for pivot in np.unique(rows[:, P.REACH]):  # pivots are mined apart from each other
            mine = rows[rows[:, P.REACH] == pivot]
            for words, count in P.mined(mine, np.ones(len(mine), np.int32), np.ones(len(mine), bool), least):
                for g, a in zip(words.tolist(), count.tolist(), strict=True):
                    assert max(g) == pivot
                    got[tuple(g)] += a
        assert got == Counter({g: a for g, a in want.items() if a >= least})


def test_long_texts_are_split_alike(monkeypatch):
    text = "Ab cd\tef.gh " * 50 + "x" * 300 + "\nlast  one"
    names, small = P._Names(), P._Names()
    whole = P._numbered(text, names)
    for part in (1, 7, 64):
        monkeypatch.setattr(P, "PART", part)
        assert (P._numbered(text, small) == whole).all()
    assert P._numbered(None, names).tolist() == [1]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**12 + 7
    words = spark.createDataFrame([(0, "en", "a", 3 * big, 10**14 + 1), (1, "en", "b", 2 * big, 10**14 + 1)], "id int, lang string, word string, f long, n long")
    phrases = spark.createDataFrame([([0, 1], big), ([0, 1, 1], big - 1)], "ids array<int>, a long")
    counts = {(0,): 3 * big, (1,): 2 * big, (0, 1): big, (1, 1): big - 1}
    phrases = phrases.union(spark.createDataFrame([([1, 1], big - 1)], phrases.schema))
    got = {tuple(r.ids): (r.score, r.k, r.l, r.r) for r in P.scored(phrases, words).collect()}
    for g, a in (((0, 1), big), ((1, 1), big - 1), ((0, 1, 1), big - 1)):
        want = min((1000 * a * (10**14 + 1) // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
        assert got[g] == want


def test_fragments_survive_packing():
    rows = np.arange(27, dtype=np.int32).reshape(3, 9)
    back = P._unpacked(P._packed(rows, np.array([1, 2, 3]), np.array([True, False, True])))
    assert (back[0] == rows).all() and back[1].tolist() == [1, 2, 3] and back[2].tolist() == [True, False, True]


# --- mixing ---


def mix_rows(seed=9):
    rng = random.Random(seed)
    rows = [(i, H.sentence(rng, rng.choice([0, 1, 5, 40])), rng.choice(["a", "a", "a", "a", "b", "ü", "Z", None])) for i in range(900)]
    return rows + [(1, None, "a"), (2, "", None), (None, "x y", "b"), (None, "x y", "b"), rows[4], rows[4], (3, " \t\n", "no words"), (4, "one huge " * 20_000, "z")]


def brute_mix(rows, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Targets by sharing again and again, copies by the drawn number."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * sizes[s]}
        if not over:
            target |= part
            break
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ -= over
    out = Counter()
    for i, t, s in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        inner = hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"mix-1:{'' if i is None else i}:{inner}".encode()).hexdigest()[:13], 16) / (1 << 52)
        rate = float(target[s]) / sizes[s] if sizes[s] else 0.0
        copies = int(rate) + (u < rate - int(rate))
        out[(i, s, size, sizes[s], round(float(target[s]), 6), copies, copies * size)] += 1
    return out


@pytest.mark.parametrize("sources", [M.SOURCES, 0])  # 0: sources are not broadcast, documents meet them salted
def test_mix_equals_brute_force(spark, sources):
    rows = mix_rows()
    df = with_clash(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), ["doc_id", "text", "source"])
    got = M.mix(df, sources=sources).collect()
    want = brute_mix(rows)
    assert Counter((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.copies, r.taken) for r in got) == want
    assert max(r.taken - 2 * r.size for r in got) <= 0
    again = M.mix(df.repartition(5), sources=sources).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = M.mixture(df, sources=sources)
    assert mixed.columns == [*df.columns, "copy"]
    times = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    assert times == Counter({k: c for k, c in sum((Counter({(i, t, s): copies}) for (i, t, s), copies in paired(rows, want)), Counter()).items() if c})


def paired(rows, want):
    copies = {(i, s, size): c for (i, s, size, _, _, c, _) in want}
    for i, t, s in rows:
        yield (i, t, s), copies[(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))]


def test_mix_of_an_empty_table_and_of_sources_without_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(none).collect() == [] and M.mixture(none).collect() == []
    got = M.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], none.schema)).collect()
    assert [(r.size, r.target, r.copies, r.taken) for r in got] == [(0, 0.0, 0, 0)] * 2


def test_taken_words_come_near_the_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 30), f"s{min(i % 7, 4)}") for i in range(20_000)]
    by = defaultdict(lambda: [0, 0.0])
    for r in M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(t for _, t in by.values()) - 1.5 * total) < 1e-6 * total
    for taken, target in by.values():
        assert abs(taken - target) < 0.04 * target


def test_mix_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    for out in (M.mix(df), M.mixture(df)):
        assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", ""))
