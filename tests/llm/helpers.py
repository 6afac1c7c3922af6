"""Small messy tables and brute-force versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

# columns whose names the operators might use themselves
CLASH = ["fp", "score", "u", "v", "root", "gram", "s", "e", "n", "loc", "crc", "y", "l_id", "value", "key", "shard", "piece", "length", "host", "first_id", "digest", "rank", "node", "kept_id",
         "__suffix_spans", "__suffix_id", "__suffix_crc", "__kept_id", "__kept_mark", "__kept_place", "__near_dedup_mark", "__op5_id", "__op5_hash", "__op5_spans", "__quality_score"]


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(n))


def messy_rows(seed=1):
    rng = random.Random(seed)
    passage = sentence(rng, 80)
    base = sentence(rng, 300)
    words = base.split()
    near = []
    for k in range(6):
        w = list(words)
        w[50 + k * 20] = "changed"
        near.append(" ".join(w))
    texts = [None, "", " ", "One", "one", "a b c", base, base, *near, passage, f"x {passage} y", f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}", "ab" * 400, "é" * 500]
    texts += [sentence(rng, rng.randint(1, 120)) for _ in range(30)]
    texts += [sentence(rng, 20_000)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base), (None, sentence(rng, 40)), (-5, "negative id here please and so on")]
    return rows


def documents(spark, rows, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("src0")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]) if clash else df


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(rows):
    """component of each row's fingerprint: smallest id over linked fingerprints."""
    fps = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[find(f)].append(i)
    return fps, [min(least[find(f)], default=None) for f in fps]


def jaccard_kept(rows, similar=0.8, shingle=5):
    """Least doc_id of each component of texts whose word shingles have a Jaccard similarity of ``similar``; null ids aside."""
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for _, t in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in low]
    sets = [set(zip(*(w[k:] for k in range(shingle)), strict=False)) or {tuple(w)} for w in words]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return [min(x) for x in least.values()]


def repeats(rows, length=200):
    """(bytes, mask of removed bytes) of each row."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        out.append((d, bytes(mask)))
    return out


def kept(d, mask):
    return bytes(b for b, m in zip(d, mask, strict=True) if not m)


def contamination(rows, items):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for _, t in rows:
        w = split(t)
        hit, found = set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= owners
        ids = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out
