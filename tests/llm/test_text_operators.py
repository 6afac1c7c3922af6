import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ethogrid.llm import decontaminate as D
from ethogrid.llm import jaccard as J
from ethogrid.llm import simhash as S
from ethogrid.llm import sstable as T
from ethogrid.llm import suffix_dedup as X
from tests.llm import helpers as H

ROWS = H.messy_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return H.documents(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return H.documents(spark, []).cache()


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_simhash_equals_brute_force(docs, none):
    fps, comp = H.components(ROWS)
    want = Counter((i, f if f < 1 << 63 else f - (1 << 64), c) for (i, _), f, c in zip(ROWS, fps, comp, strict=True))
    assert bag(S.simhash_components(docs).collect()) == want
    assert S.simhash_components(none).collect() == []


def test_simhash_keeps_one_row_of_each_component(docs, none):
    got = S.simhash_keep_one(docs)
    assert got.columns == docs.columns
    _, comp = H.components(ROWS)
    want = {c for (i, _), c in zip(ROWS, comp, strict=True) if i is not None}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in rows) == 2
    assert S.simhash_keep_one(none).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_each_component_keeps_its_own_row_where_ids_repeat(spark, parts):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(2, b), (5, a), (5, b), (5, a + " "), (5, a), (None, a), (9, None), (9, "")]
    docs = H.documents(spark, rows).repartition(parts)
    for keep in (S.simhash_keep_one, J.similar_keep_one):
        got = keep(docs)
        assert got.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(2, b), (5, a), (None, a), (9, None)]), keep


def test_spanning_forest_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(2, 30))
        a, b, cost = rng.integers(0, n, 60), rng.integers(0, n, 60), rng.integers(0, 5, 60)
        a, b, cost = a[a != b], b[a != b], cost[a != b]
        got, sets, want = J.spanning_forest(n, a, b, cost), S._Forest(n), []
        for k in np.argsort(cost, kind="stable"):
            want += [cost[k]] * len(sets.union(a[k : k + 1], b[k : k + 1]))
        assert sorted(cost[got].tolist()) == want


def test_trie_join_proposes_all_close_pairs_of_repeated_values():
    rng = np.random.default_rng(3)
    v = np.sort(np.concatenate([rng.integers(0, 1 << 12, 300), np.full(200, 77)]).astype(np.uint64) << np.uint64(52))
    got = set()
    S.trie_join(v, 2, 3, S._Forest(len(v)), lambda a, b: got.update(zip(a.tolist(), b.tolist(), strict=True)), 12)
    i, j = np.triu_indices(len(v), 1)
    near = (np.bitwise_count(v[i] ^ v[j]) <= 3) & (v[i] >> np.uint64(62) == v[j] >> np.uint64(62))
    assert got == set(zip(i[near].tolist(), j[near].tolist(), strict=True))


def test_near_dedup_stage_links_from_jaccard_0_8(spark, none):
    rng = random.Random(5)
    rows, i = [], 0
    for k in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((i := i + 1, " ".join(w)))
        for n in range(1, 8):  # n words changed far apart: (196 - 5n) / (196 + 5n) of the shingles are common
            x = list(w)
            for c in range(n):
                x[10 + c * 25] = f"x{n}{c}{k}"
            rows.append((i := i + 1, " ".join(x)))
    rows += [(i + 1, None), (i + 2, " "), (i + 3, "a b"), (i + 4, "A  b"), (i + 4, "A  b"), (None, "a b")]
    want = H.jaccard_kept(rows)
    docs = H.documents(spark, rows)
    got = corpus_pipeline.near_dedup(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == sorted([0, *want])
    assert corpus_pipeline.near_dedup(spark, none, None).count() == 0


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_trie_join_connects_what_all_pairs_connect(blocks):
    rng = np.random.default_rng(blocks)
    v = set()
    for b in rng.integers(0, 1 << 63, 8, dtype=np.uint64).tolist():
        for _ in range(30):
            x = b
            for k in rng.integers(0, 64, rng.integers(1, 10)):
                x ^= 1 << int(k)
            v.add(x)
    v = np.array(sorted(v), np.uint64)
    found, want = S._Forest(len(v)), S._Forest(len(v))
    for first, order in S.block_masks(blocks, 4):
        w = S.permuted(v, order)
        assert (S.permuted(w, np.argsort(order).tolist()) == v).all()
        o = np.argsort(w)
        at = S.trie_links(w[o], first, 4)
        assert all((int(w[o][a]) ^ int(w[o][b])).bit_count() <= 4 for a, b in at)
        if len(at):
            found.union(o[at[:, 0]], o[at[:, 1]])
    i, j = np.triu_indices(len(v), 1)
    near = np.bitwise_count(v[i] ^ v[j]) <= 4
    want.union(i[near], j[near])
    assert [found.find(k) for k in range(len(v))] == [want.find(k) for k in range(len(v))]


def test_trie_join_of_a_dense_ball_stays_linear():
    v = np.unique(np.array([12345 ^ 1 << a ^ 1 << b ^ 1 << c for a in range(40) for b in range(40) for c in range(0, 40, 2)], np.uint64))
    assert len(S.trie_links(v, 0, 4)) == len(v) - 1


def test_suffix_dedup_equals_brute_force(docs, none):
    want = Counter()
    for (i, _), (d, m) in zip(ROWS, H.repeats(ROWS), strict=True):
        runs = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        want[i, len(d), sum(m), runs, hashlib.sha256(H.kept(d, m)).hexdigest()] += 1
    assert bag(X.suffix_dedup(docs).collect()) == want
    assert X.suffix_dedup(none).collect() == []


def test_suffix_dedup_cuts_texts_and_keeps_columns(docs, none):
    got = X.remove_repeats(docs)
    assert got.columns == docs.columns
    want = Counter()
    for (i, t), (d, m) in zip(ROWS, H.repeats(ROWS), strict=True):
        want[i, None if t is None else t if not any(m) else H.kept(d, m).decode("utf-8", "ignore")] += 1
    assert bag(got.select("doc_id", "text").collect()) == want
    assert X.remove_repeats(none).count() == 0


def test_suffix_dedup_of_long_and_periodic_texts(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcd ", k=1_300_000))
    at = X.SEGMENT - 150
    rows = [(1, long), (2, long[at : at + 260]), (3, "xyz" * 200), (4, "q" * 199), (5, "q" * 200), (6, "r" * 201), (7, long[600_000:600_250] + "!" + long[900_000:900_300])]
    got = {r.doc_id: r for r in X.suffix_dedup(H.documents(spark, rows)).collect()}
    for (i, _), (d, m) in zip(rows, H.repeats(rows), strict=True):
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(m), hashlib.sha256(H.kept(d, m)).hexdigest()), i


def test_every_window_has_one_anchor():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab", k=n)).encode() for n in (0, 10, 199, 200, 201, 900, 5000)] + [b"z" * 700]
    ends = np.cumsum([len(t) for t in texts])
    pos, lo, hi, g, r = X.anchors(np.frombuffer(b"".join(texts), np.uint8), ends)
    begin = np.append(0, ends[:-1])
    want = sorted(b + k for b, t in zip(begin.tolist(), texts, strict=True) for k in range(max(0, len(t) - 199)))
    got = sorted(x for a, b in zip(lo.tolist(), hi.tolist(), strict=True) for x in range(a, b + 1))
    assert got == want
    assert ((lo <= pos) & (pos + X.GRAM <= hi + X.LENGTH)).all()


ITEMS = [(1, H.messy_rows()[14][1]), (2, "One"), (3, None), (4, ""), (5, "a B, c"), (None, "negative id"), (5, "a B, c"), (6, "é" * 500)]


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, docs, none, part_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = Counter((i, *x) for (i, _), x in zip(ROWS, H.contamination(ROWS, ITEMS), strict=True))
    assert bag(D.decontaminate(docs, bench, part_bytes).collect()) == want
    assert D.decontaminate(none, bench, part_bytes).collect() == []


def test_decontamination_drops_hit_documents(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.drop_contaminated(docs, bench)
    assert got.columns == docs.columns
    want = Counter((i, t) for (i, t), x in zip(ROWS, H.contamination(ROWS, ITEMS), strict=True) if not x[1])
    assert bag(got.select("doc_id", "text").collect()) == want
    assert D.drop_contaminated(docs, bench.limit(0)).count() == len(ROWS)
    assert bag(D.drop_contaminated(docs, bench, 300).select("doc_id", "text").collect()) == want


def test_wu_manber_skips_and_finds():
    words = [w.encode() for w in "a b c d e x c d e".split()]
    m = D.Search([(1, "q q q"), (2, "B c, d"), (3, "c d e"), (4, "x c d"), (5, "c d e")]).by_size[0]
    got = sorted((k, sorted(m.items_of(w))) for k, w in m.search(words))
    assert (m.size, got) == (3, [(1, [1]), (2, [2, 4]), (5, [3]), (6, [2, 4])])
    assert [m.shift[D.zlib.crc32(x) & m.mask] for x in (b"b c", b"c d", b"q w")] == [1, 0, 2]


def test_search_tables_stay_small():
    import pickle

    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(1000))) for i in range(150)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(D.Search(items))) < 12 * size


def test_sstable_round_trip(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(T.default_tokenizer())
    folder = f"file://{tmp_path}/ids"
    got = T.read_shards(T.write_shards(docs, folder, T.default_tokenizer(), shards=4), folder).collect()
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    folder = f"file://{tmp_path}/none"
    assert T.read_shards(T.write_shards(none, folder, T.default_tokenizer()), folder).collect() == []


def test_encoder_equals_the_tokenizer_on_odd_texts():
    e = T.Encoder(T.default_tokenizer())
    texts = ["", None, "a\x1cb", "<|endoftext|> hi<|startoftext|>x", "İstanbul ΣΑΣ ſ é ́x a　d", "한국어 日本語", "🙂🙂 ok", "it's DON'T '' 'll", "x" * 3000, "ﬁ Å", "1234 12,3.4!!", "Word,*** END."]
    for t, ids in zip(texts, e.ids(texts), strict=True):
        assert ids.tolist() == e.tok.encode(t or "", add_special_tokens=False).ids, t


def test_sstable_lookup_and_damage(tmp_path):
    path = tmp_path / "x.sst"
    keys = sorted([None, None, *range(-50, 90_000, 7)], key=T.key_of)
    with open(path, "wb") as f:
        w = T.Writer(f)
        for k in keys:
            w.add(T.key_of(k), T.pack_ids(np.array([abs(k or 3), 70_000 if k and k % 2 else 1], np.uint32)), 2)
        w.finish()
    with open(path, "rb") as f:
        r = T.Reader(f)
        assert len(r.index) > 1 and [T.id_of(k) for k, _ in r.scan()] == keys
        assert [T.unpack_ids(v).tolist() for v in r.get(T.key_of(20))] == [[20, 1]] and len(r.get(T.key_of(None))) == 2
        assert r.get(T.key_of(21)) == [] and sum(r.may_hold(T.key_of(k)) for k in range(100_000, 102_000)) < 100
    data = bytearray(path.read_bytes())
    data[100] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(T.Reader(f).scan())


def some_regions(seed=8):
    rng = random.Random(seed)
    passage = "".join(rng.choices("abcdef", k=260)).encode()
    texts = ["".join(rng.choices("abcdef", k=rng.randint(0, 300))).encode() + passage[rng.randint(0, 30) :] + "".join(rng.choices("ab", k=rng.randint(0, 200))).encode() for _ in range(60)]
    texts = [t for t in texts if len(t) >= 200] + [b"xy" * 150, b"xy" * 130 + b"z"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    _, lo, hi, g, _ = X.anchors(data, np.cumsum([len(t) for t in texts]))
    at = np.argsort(g, kind="stable")
    return [data[a : b + X.LENGTH].tobytes() for a, b in zip(lo[at], hi[at], strict=True)], (hi - lo)[at]


@pytest.mark.parametrize("block", [1, 500, 1 << 17])
def test_refined_suffixes_equal_counted_windows(monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    pieces, widths = some_regions()
    twice = np.flatnonzero(np.arange(len(pieces)) % 7 == 0)  # regions that come from two places
    pieces, widths = pieces + [pieces[k] for k in twice], np.append(widths, widths[twice])
    seen = Counter()
    for p, w in zip(pieces, widths, strict=True):
        for k in range(w + 1):
            seen[p[k : k + X.LENGTH]] += 1
    want = []
    for p, w in zip(pieces, widths, strict=True):
        hit = [k for k in range(w + 1) if seen[p[k : k + X.LENGTH]] > 1]
        want.append((min(hit), max(hit)) if hit else (1 << 40, -1))
    first, last = X.refine(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(widths + X.LENGTH) - widths - X.LENGTH, widths)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == want and (last < 0).any() and (last >= 0).any()


def test_regions_of_one_hash_are_compared_byte_by_byte():
    """Two places of a region whose hashes agree are repeated only if their bytes do."""
    rng = random.Random(3)
    a = bytes(rng.choices(b"abcdef", k=X.LENGTH + 9))
    b = a[:50] + b"#" + a[51:]

    def found(*rows):
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i == 4 else pa.int64()) for i in range(5)], list("gruwb"))
        return [tuple(c[0] for c in b.to_pydict().values()) for b in X._repeated([batch]) if b.num_rows]

    assert found((1, 5, 0, 9, a), (1, 5, 1, 9, a)) == [(1, 5, 0, 9)]
    assert found((1, 5, 0, 9, a), (1, 5, 1, 9, a[:-3] + b"###")) == [(1, 5, 0, 6)]
    assert found((1, 5, 0, 9, a), (1, 5, 1, 9, b)) == []
    assert found((1, 5, 0, 9, a)) == []


def test_what_recurs_only_as_equal_regions_needs_both_places(spark, monkeypatch):
    """Exact copies go because two places are sorted and compared: with one place of each region nothing of them goes."""
    rng = random.Random(9)
    text = H.sentence(rng, 200)
    docs = H.documents(spark, [(1, text), (2, text), (3, H.sentence(rng, 100))])
    size = len(text.encode())
    assert sorted((r.doc_id, r.n_removed) for r in X.suffix_dedup(docs).collect()) == [(1, size), (2, size), (3, 0)]
    whole = X.region_pieces
    monkeypatch.setattr(X, "region_pieces", lambda d, r: whole(d, r.where("nth = 0")))
    assert all(r.n_removed == 0 for r in X.suffix_dedup(docs).collect())


def test_hot_anchors_give_what_others_give(spark, monkeypatch):
    rng = random.Random(8)
    passage = H.sentence(rng, 70)
    rows = [(i, f"{H.sentence(rng, rng.randint(0, 40))} {passage} {H.sentence(rng, rng.randint(0, 40))}") for i in range(60)] + ROWS
    monkeypatch.setattr(X, "HOT", 5)
    got = Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in X.suffix_dedup(H.documents(spark, rows)).collect())
    assert got == Counter((i, sum(m), hashlib.sha256(H.kept(d, m)).hexdigest()) for (i, _), (d, m) in zip(rows, H.repeats(rows), strict=True))
