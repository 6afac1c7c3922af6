"""Phrase collocations by pivot partitioning (operator 12)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.llm.common import filesystem, sliced, table, written

LONGEST = 5  # words of a phrase at most
LEAST = 100  # occurrences at least
TOP = 2_000  # phrases that a language returns
SLICE = 16 << 20  # bytes of text whose words and fragments are put together in a worker, about
PART = 1 << 20  # bytes of a text that are split at once
GROUP_WORDS = 4_000_000  # word occurrences whose fragments are mined together, about
REACH = LONGEST - 1
END = np.iinfo(np.int32).max  # rank of what no phrase holds: ends of pieces and words too rare

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


class _Names(dict):
    """Numbers of words in the order in which they are met; 0 is nothing, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _numbered(text: str | None, names: _Names) -> np.ndarray:
    """Word numbers of a text with 1 at the end of each piece. Long texts are split a part at a time, at a blank or an end."""
    data = (text or "").encode().translate(_FOLD)
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > PART:
            end = min(x for x in (data.find(b" ", at + PART), data.find(b"\n", at + PART), end) if x >= 0)
        words = data[at:end].replace(b"\n", b" \n ").split(b" ")
        out.append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
        at = end
    ids = np.concatenate([*out, np.ones(1, np.int32)])
    return ids[ids > 0]


def _slices(batches):
    """{lang: (names, word numbers)} of some SLICE bytes of text each, from batches of (text, lang)."""
    held, size = {}, 0
    for b in sliced(batches):
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            names, ids = held.setdefault(lang, (_Names(), []))
            ids.append(_numbered(text, names))
            size += len(text or "")
            if size >= SLICE:
                yield {k: (n, np.concatenate(x)) for k, (n, x) in held.items()}
                held, size = {}, 0
    if held:
        yield {k: (n, np.concatenate(x)) for k, (n, x) in held.items()}


def _spelled(names: _Names) -> pa.Array:
    return pa.array(list(names), pa.binary()).cast(pa.string())


def _count(batches):
    """(lang, word, n) of each slice; the row with a null word counts all."""
    for held in _slices(batches):
        for lang, (names, ids) in held.items():
            n = np.bincount(ids, minlength=len(names))[2:]
            words = pa.concat_arrays([pa.array([None], pa.string()), _spelled(names)[2:]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(np.concatenate([[n.sum()], n]), pa.int64())], ["lang", "word", "n"])


def frequent_words(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (id, lang, word, f, n): words of ``least`` occurrences with ids from 0 in order of f, largest first.

    Numbers run on over the partitions of the sorted table; the driver sees one count a partition.
    """
    spark = docs.sparkSession
    counted = docs.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    kept = written(counted.where(F.col("word").isNull() | (F.col("f") >= least)), "counts")
    totals = kept.where("word IS NULL").select("lang", F.col("f").alias("n"))
    ordered = kept.where("word IS NOT NULL").join(totals, "lang").orderBy(F.desc("f"), "lang", "word").withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered, "order")
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in ordered.groupBy(part.alias("part")).count().collect())
    starts, n = [], 0
    for p, rows in sizes:
        starts.append((p, n - (p << 33)))
        n += rows
    first = F.broadcast(spark.createDataFrame(starts, "part long, shift long"))  # a row a partition
    words = ordered.withColumn("part", part).join(first, "part").select((F.col("at") + F.col("shift")).cast("int").alias("id"), "lang", "word", "f", "n")
    return totals, words


def fragments(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows): for each word its place and the words around it that phrases can hold of which it is the rarest, the leftmost one if it recurs.

    A row has ``REACH`` columns to the left (nearest last), the word, and as many to the right; -1 where a rarer word, the end of a piece or, to the left, the word itself cuts off.
    Words with nothing around them have no row. A larger rank is a rarer word.
    """
    n = len(ranks)
    wide = np.concatenate([np.full(REACH, END, np.int32), ranks, np.full(REACH, END, np.int32)])
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    on, go = ranks < END, ranks < END
    for k in range(1, LONGEST):
        on = on & (wide[REACH - k : REACH - k + n] < ranks)
        go = go & (wide[REACH + k : REACH + k + n] <= ranks)
        left += on
        right += go
    at = np.flatnonzero(left + right)
    rows = np.full((len(at), 2 * REACH + 1), -1, np.int32)
    rows[:, REACH] = ranks[at]
    for k in range(1, LONGEST):
        x, y = left[at] >= k, right[at] >= k
        rows[x, REACH - k] = wide[at[x] + REACH - k]
        rows[y, REACH + k] = wide[at[y] + REACH + k]
    return at, rows


def _hashed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = (h ^ rows[:, c].astype(np.uint32)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _route(words_path: str, groups: int):
    """(group, block) rows: the fragments of each slice, equal ones put together, in blocks by the group of their pivot.

    Ranks come from the table of frequent words, which is streamed past the words of the slice, so a worker holds words of its own text only.
    """

    def run(batches):
        import pyarrow.dataset as ds

        fs, path = filesystem(words_path)
        schema = pa.schema([("id", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("salts", pa.int32())])
        ranked = ds.dataset(path, schema=schema, filesystem=fs, format="parquet")
        for held in _slices(batches):
            for lang, (names, ids) in held.items():
                words, rank, salts = _spelled(names), np.full(len(names), END, np.int32), np.ones(len(names), np.int32)
                for b in ranked.to_batches(filter=ds.field("lang") == lang):
                    own = pc.index_in(b.column(2), words)
                    there = own.is_valid()
                    own = own.filter(there).to_numpy()
                    rank[own] = b.column(0).filter(there).to_numpy()
                    salts[own] = b.column(3).filter(there).to_numpy()
                at, rows = fragments(rank[ids])
                if not len(at):
                    continue
                salt = salts[ids[at]]
                h = _hashed(rows)
                order = np.argsort(h, kind="stable")
                rows, salt, h = rows[order], salt[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
                times = np.diff(np.append(new, len(rows)))
                rows, salt, h = rows[new], salt[new], h[new]
                pivot = np.stack([rows[:, REACH], (h % salt.astype(np.uint64)).astype(np.int32)], axis=1)
                group = (_hashed(pivot) % np.uint64(groups)).astype(np.int32)
                order = np.argsort(group, kind="stable")
                group, rows, salt, times = group[order], rows[order], salt[order], times[order]
                cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
                for i in range(0, len(cuts) - 1, 256):
                    some = list(zip(cuts[i:], cuts[i + 1 :], strict=False))[:256]
                    blocks = [_packed(rows[a:z], times[a:z], salt[a:z] == 1) for a, z in some]
                    yield pa.RecordBatch.from_arrays([pa.array(group[[a for a, _ in some]], pa.int32()), pa.array(blocks, pa.binary())], ["grp", "block"])

    return run


def _packed(rows: np.ndarray, times: np.ndarray, whole: np.ndarray) -> bytes:
    """Fragments as bytes: their number, then columns."""
    data = np.int32(len(rows)).tobytes() + np.ascontiguousarray(rows.T).tobytes() + times.astype(np.int32).tobytes() + whole.astype(np.uint8).tobytes()
    return np.int32(len(data)).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = pa.decompress(block[4:], decompressed_size=int(np.frombuffer(block, np.int32, 1)[0]), codec="zstd", asbytes=True)
    n, width = int(np.frombuffer(data, np.int32, 1)[0]), 2 * REACH + 1
    body = np.frombuffer(data, np.int32, n * (width + 1), 4)
    return body[: n * width].reshape(width, n).T, body[n * width :], np.frombuffer(data, np.uint8, n, 4 + 4 * n * (width + 1)).astype(bool)


def mined(rows: np.ndarray, times: np.ndarray, whole: np.ndarray, least: int = LEAST):
    """(words, counts): phrases of each length and place of their pivot with what these fragments count of them.

    Each phrase is its part without the outermost word, by a number, and that word; it grows to the right, then to the left. Where the fragments of a pivot are
    ``whole`` (not salted), a phrase below ``least`` is neither returned nor grown, since none that holds it can have more.
    """
    size = int(rows.max(initial=0)) + 1

    def grow(at, name, column, i, j):
        there = rows[at, column] >= 0
        at, name = at[there], name[there]
        key, first, name = np.unique(name * size + rows[at, column], return_index=True, return_inverse=True)
        count = np.bincount(name, weights=times[at], minlength=len(key)).astype(np.int64)
        lead = at[first]
        good = (count >= least) | ~whole[lead]
        found.append((rows[lead[good], REACH - i : REACH + j + 1], count[good]))
        on = good[name]
        return at[on], name[on]

    found: list = []
    state = np.arange(len(rows)), rows[:, REACH].astype(np.int64)
    for j in range(LONGEST):
        if j:
            state = grow(*state, REACH + j, 0, j)
        outer = state
        for i in range(1, LONGEST - j):
            outer = grow(*outer, REACH - i, i, j)
    return found


def _mine(least: int):
    def solve(blocks):
        parts = [_unpacked(b) for b in blocks]
        rows, times, whole = (np.concatenate([p[k] for p in parts]) for k in range(3))
        for words, count in mined(rows, times, whole, least):
            for a in range(0, len(count), 65_536):
                some = np.ascontiguousarray(words[a : a + 65_536])
                lists = pa.ListArray.from_arrays(np.arange(0, some.size + 1, some.shape[1], dtype=np.int32), pa.array(some.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(count[a : a + 65_536], pa.int64())], ["ids", "n"])

    def run(batches):
        key, held = None, []
        for b in batches:
            for group, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if group != key and held:
                    yield from solve(held)
                    held = []
                key = group
                held.append(block)
        if held:
            yield from solve(held)

    return run


def frequent_phrases(docs: DataFrame, words_path: str, occurrences: int, least: int = LEAST) -> DataFrame:
    """(ids, a): phrases of 2 to ``LONGEST`` frequent words with ``least`` occurrences, as word ids.

    Each fragment goes to the group of its rarest word (pivot), which mines it and counts only phrases that this word is the rarest of. Pivots with more than a task's share of all
    words are salted (column ``salts`` of the words); their partial counts are added up afterwards.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(4 * tasks, -(-occurrences // GROUP_WORDS))
    routed = docs.mapInArrow(_route(words_path, groups), "grp int, block binary")
    met = routed.repartition(min(groups, max(tasks, groups // 16)), "grp").sortWithinPartitions("grp")
    found = met.mapInArrow(_mine(least), "ids array<int>, n long")
    return found.groupBy("ids").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, ids, a, k, l, r, n, score): phrases with their lowest-scoring cut after k words, in exact arithmetic.

    score = floor(1000 a n / (l r)), l and r the occurrences of the two parts; ties go to the smallest k.
    """
    spelled = phrases.select("ids", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "lang", "word", "n"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"), F.first("lang").alias("lang"), F.first("n").alias("n"))
    own = phrases.join(spelled, "ids").select("ids", "a", "n", "lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    counts = words.select(F.array("id").alias("part"), F.col("f").alias("has")).unionByName(phrases.select(F.col("ids").alias("part"), F.col("a").alias("has")))
    cut = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.slice("ids", 1, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("part")))
    cut = cut.select("ids", "a", "n", "lang", "phrase", "k", F.inline(sides)).join(counts, "part")
    part = lambda s: F.max(F.when(F.col("side") == s, F.col("has")))
    cut = cut.groupBy("ids", "a", "n", "lang", "phrase", "k").agg(part(0).alias("l"), part(1).alias("r"))
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    return cut.groupBy("ids", "a", "n", "lang", "phrase").agg(least).select("lang", "phrase", "ids", "a", "c.k", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language of ``docs`` (text, lang, ...).

    A-Z are lowered, texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs; a null lang is ``und``, a null text empty. Phrases of 2 to 5 words with
    ``least`` occurrences, overlaps included, are scored (:func:`scored`); one that stands in a longer phrase of the same count is dropped (it is enough to look at phrases
    one word longer, as those between have that count too). Repeated rows count as often as they come; an empty table gives no rows.
    """
    docs = docs.select(F.col("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    totals, words = frequent_words(docs, least)
    occurrences = totals.agg(F.sum("n")).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, min(GROUP_WORDS, occurrences // tasks))
    words = written(words.withColumn("salts", F.ceil(F.col("f") / F.lit(share)).cast("int")), "words")
    phrases = written(frequent_phrases(docs, words.written_path, occurrences, least), "phrases")
    inner = F.array(F.slice("ids", 1, F.size("ids") - 1), F.slice("ids", 2, F.size("ids") - 1))
    longer = phrases.where(F.size("ids") > 2).select(F.explode(inner).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = scored(phrases, words).join(longer, "ids", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all ``documents``, 2,000 a language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, w[i:i + m - 1] AS g FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
k AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
s AS (SELECT k.lang, k.g, k.a, k.k, x.f AS l, y.f AS r, n.n, CAST((1000 * CAST(k.a AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k.k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k.k + 1:] JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
h AS (SELECT lang, g[1:len(g) - 1] AS g, a FROM c WHERE len(g) > 2 UNION ALL SELECT lang, g[2:] AS g, a FROM c WHERE len(g) > 2),
x AS (SELECT lang, g, max(a) AS longer FROM h GROUP BY lang, g),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score FROM b LEFT JOIN x ON x.lang = b.lang AND x.g = b.g WHERE x.longer IS NULL OR x.longer < b.a)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""
