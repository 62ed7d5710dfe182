"""Phrases by collocation score, per language, counted by suffixes (suffix-sigma).

Every word starts a suffix of max_n words at most, which ends with its piece. Suffixes are dealt by language and first word, sorted in reverse lexicographic
order, and one stack counts all their prefixes: a phrase is done when a suffix comes that doesn't begin with it. What is counted meets its parts by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, SpanHash, give_back, lowered, mixed, slices, text_buffer, written

SLICE_BYTES = 4_000_000
#: [.,;:!?\x0A-\x0D] end a piece, space and tab a word; all of WHITE are among them.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _ENDS | WHITE
UNKNOWN = "und"


def _fold(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """One code for each combination of codes (values, how many there are), in 63 bits."""
    code, size = np.zeros(len(columns[0][0]), np.int64), 1
    for values, n in columns:
        if size * n >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            size = int(code.max(initial=0)) + 1
        code, size = code * n + values, size * n
    return code


class Pieces:
    """The words of a slice of rows: codes into a dictionary, language codes, and how many words of their piece follow each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        buf = lowered(buf)
        apart = _APART[buf]
        edge = offsets[:-1][np.diff(offsets) > 0]
        before = np.empty(len(buf), dtype=bool)
        before[:1], before[1:] = True, apart[:-1]
        before[edge] = True
        after = np.empty(len(buf), dtype=bool)
        after[-1:], after[:-1] = True, apart[1:]
        after[edge[edge > 0] - 1] = True
        starts = np.flatnonzero(~apart & before)
        ends = np.flatnonzero(~apart & after) + 1
        marks = _ENDS[buf].astype(np.int64)
        marks[edge] += 1
        self.piece = np.cumsum(marks)[starts]
        # nothing but words is left, one behind the other
        bytes_ = np.ascontiguousarray(buf[~apart])
        cuts = np.concatenate(([0], np.cumsum(ends - starts)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(bytes_)]).dictionary_encode()
        self.code, self.words = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        row = np.searchsorted(offsets, starts, "right") - 1
        found = langs.dictionary_encode()
        self.lang, self.langs = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row], found.dictionary

    def __len__(self) -> int:
        return len(self.code)

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits of each dictionary word, and of each language."""
        out = []
        for values in (self.words, self.langs.cast(pa.large_binary())):
            data, at = text_buffer(values)
            out.append(SpanHash(data)(at[:-1], at[1:]) if len(data) else np.zeros(len(values), np.uint64))
        return out[0], out[1]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        for lo, hi in slices(offsets, SLICE_BYTES):
            yield Pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], batch.column(1).slice(lo, hi - lo))
            give_back()


def _hash(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return mixed(words + langs * np.uint64(0x9E3779B97F4A7C15))


def frequent_firsts(share: int):
    """Of every slice the number of words of each language, and the hashes of (word, language) with over 1/(2 share) of the slice."""

    def run(batches):
        for p in _sliced(batches):
            n = np.bincount(p.lang, minlength=len(p.langs))
            code, count = np.unique(_fold((p.lang, len(p.langs)), (p.code, len(p.words))), return_counts=True)
            top = count * 2 * share > len(p)
            code, count = code[top], count[top]
            w, g = p.firsts()
            h = _hash(w[code % max(len(p.words), 1)], g[code // max(len(p.words), 1)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([p.langs, pa.nulls(len(h), p.langs.type)]), pa.array(np.concatenate((np.zeros(len(n), np.int64), h))), pa.array(np.concatenate((n, count)))], ["lang", "h", "n"])

    return run


def suffixes(max_n: int, hot: np.ndarray, salts: int):
    """Of every slice its suffixes with their numbers: (b, key, n, cut).

    key is first word, language in hexadecimal, further words, each with a space behind it; b is where it goes: by language and first word, and for the
    `hot` ones (then cut) by the further words as well.
    """

    def run(batches):
        for p in _sliced(batches):
            n, k = len(p), len(p.words) + 1
            columns, place = [(p.lang, len(p.langs)), (p.code, k)], [np.arange(n)]
            for d in range(1, max_n):
                there = np.zeros(n, dtype=bool)
                there[: n - d] = p.piece[d:] == p.piece[: n - d]
                at = np.where(there, np.minimum(np.arange(n) + d, n - 1), -1)
                place.append(at)
                columns.append((np.where(there, p.code[at], k - 1), k))
            if not n:
                continue
            _, first, count = np.unique(_fold(*columns), return_index=True, return_counts=True)
            w, g = p.firsts()
            h = _hash(w[p.code[first]], g[p.lang[first]])
            cut = np.isin(h, hot)
            rest = np.zeros(len(first), np.uint64)
            for at in place[1:]:
                rest = mixed(rest + np.where(at[first] >= 0, w[p.code[at[first]]], np.uint64(1)))
            b = np.where(cut, mixed(h + np.uint64(1) + rest % np.uint64(salts)), h).view(np.int64)
            hexed = pa.array([x.as_py().encode().hex().encode() for x in p.langs], pa.large_binary())
            parts = [p.words.take(pa.array(p.code[first])), hexed.take(pa.array(p.lang[first]))]
            for at in place[1:]:
                parts.append(p.words.take(pa.array(p.code[at[first]], mask=at[first] < 0)))
            blank = pa.scalar(b" ", pa.large_binary())
            # nulls, words beyond the piece's end, are left out: what is joined ends with a space
            key = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()), blank, null_handling="skip")
            yield pa.RecordBatch.from_arrays([pa.array(b), key, pa.array(count.astype(np.int64)), pa.array(cut)], ["b", "key", "n", "cut"])

    return run


def _depths(buf: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """[d, i]: how many bytes the first d parts of row i take (part 0 is word and language), -1 where it has fewer parts."""
    spaces = np.flatnonzero(buf == 0x20)
    first = np.searchsorted(spaces, at)
    out = np.full((most, len(at) - 1), -1, np.int64)
    for d in range(most):
        s = first[:-1] + d + 1
        there = s < first[1:]
        out[d, there] = spaces[s[there]] + 1 - at[:-1][there]
    return out


def _agreement(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the row before it; the first with none."""
    n = np.diff(at)
    least = np.minimum(n[1:], n[:-1])
    begin = np.concatenate(([0], np.cumsum(least)))
    step = np.arange(begin[-1]) - np.repeat(begin[:-1], least)
    other = buf[np.repeat(at[1:-1], least) + step] != buf[np.repeat(at[:-2], least) + step]
    most = np.iinfo(np.int64).max
    # one more, for empty rows at the end
    where = np.concatenate((np.where(other, step, most), [most]))
    out = np.minimum.reduceat(where, begin[:-1]) if len(least) else np.zeros(0, np.int64)
    return np.concatenate(([0], np.minimum(out, least)))


def stack(max_n: int, least: int):
    """Counts all prefixes of sorted suffixes: (key, words, n) of phrases with `least` occurrences, or of any number if their suffixes are cut.

    A prefix stays open over batches until a row doesn't begin with it; what is open is one prefix for each depth. A suffix of all its words isn't cut, whatever its
    first word is: it goes to one place.
    """

    def run(batches):
        open_: list[list] = []  # of each depth: [prefix, count, cut]
        for batch in batches:
            if not batch.num_rows:
                continue
            last = open_[-1][0] if open_ else b""
            keys = pa.concat_arrays([pa.array([last], pa.large_binary()), batch.column(0).cast(pa.large_binary())])
            buf, at = text_buffer(keys)
            n, cut = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            shared, ends = _agreement(buf, at)[1:], _depths(buf, at, max_n)[:, 1:]
            begin, done = at[1:-1], []
            for d in range(max_n):
                there = ends[d] >= 0
                # a row begins a new prefix if it shares less with the row before it, or if that one ended before
                new = np.flatnonzero(there & (shared < ends[d]))
                carried = open_[d] if d < len(open_) else None
                total = np.concatenate(([0], np.cumsum(np.where(there, n, 0))))
                until = int(new[0]) if len(new) else len(n)
                if carried is not None:
                    carried[1] += int(total[until] - total[0])
                if len(new):
                    if carried is not None:
                        done.append((d, *carried))
                    sums = np.diff(np.concatenate((total[new], total[-1:])))
                    full = (sums >= least) | (cut[new] & (d < max_n - 1))
                    full[-1] = False
                    done += [(d, buf[begin[i] : begin[i] + ends[d, i]].tobytes(), int(s), bool(cut[i])) for i, s in zip(new[full].tolist(), sums[full].tolist())]
                    i = int(new[-1])
                    fresh = [buf[begin[i] : begin[i] + ends[d, i]].tobytes(), int(sums[-1]), bool(cut[i])]
                    if d < len(open_):
                        open_[d] = fresh
                    else:
                        open_.append(fresh)
            yield _closed(done)
            # what the last row doesn't begin with is done as well
            tail = buf[at[-2] : at[-1]].tobytes()
            keep = [x for x in open_ if tail.startswith(x[0])]
            yield _closed([(d, *x) for d, x in enumerate(open_) if not tail.startswith(x[0])])
            open_ = keep
        yield _closed([(d, *x) for d, x in enumerate(open_)])

    def _closed(done):
        done = [x for x in done if x[2] >= least or (x[3] and x[0] < max_n - 1)]
        return pa.RecordBatch.from_arrays([pa.array([x[1] for x in done], pa.binary()), pa.array([x[0] + 1 for x in done], pa.int32()), pa.array([x[2] for x in done], pa.int64())], ["key", "words", "n"])

    return run


def counted_phrases(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 500, salts: int = 64, words_a_task: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(phrases (lang, phrase, words, f), totals (lang, n)): phrases of 1 to max_n words with f >= least occurrences, and all word occurrences, by language.

    A word with over 1/share of all words is cut: its suffixes go to `salts` places by what follows, and its numbers are added up afterwards. Equal suffixes of a
    slice travel as one, so neither a frequent phrase nor a group of copies makes a place large. Places grow with the corpus.
    """
    own = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    firsts = written(own.mapInArrow(frequent_firsts(share), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")), "firsts")
    totals = firsts.where("lang is not null").select("lang", "n")
    total = totals.agg(F.sum("n")).first()[0] or 0
    # of words with over 1/share of all, those slices hold more than half in which they have over 1/(2 share): 2 share words at most come back
    hot = np.sort(np.array([r["h"] for r in firsts.where((F.col("lang").isNull()) & (F.col("n") * 2 * share > total)).select("h").collect()], np.int64).view(np.uint64))
    places = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // words_a_task + 1)
    rows = own.mapInArrow(suffixes(max_n, hot, salts), "b long, key binary, n long, cut boolean").repartition(places, "b")
    counted = rows.select("key", "n", "cut").sortWithinPartitions(F.desc("key")).mapInArrow(stack(max_n, least), "key binary, words int, n long")
    sums = counted.groupBy("key", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    parts = F.split(F.col("key").cast("string"), " ")
    named = sums.select("words", "f", F.explode(F.array(parts)).alias("p"))
    phrase = F.array_join(F.concat(F.slice("p", 1, 1), F.slice("p", F.lit(3), F.col("words") - 1)), " ")
    return written(named.select(F.decode(F.unhex(F.col("p")[1]), "UTF-8").alias("lang"), phrase.alias("phrase"), "words", "f"), "phrases"), totals


def _with_counts(left: DataFrame, right: DataFrame, on: list[str], heavy: int = 1000) -> DataFrame:
    """left joined with right, which has a row for each key at most: keys with over 1/heavy of left's rows, fewer than `heavy`, by broadcast, all others by a shuffle."""
    n = left.count()
    top = written(left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") * heavy > n).select(*on), "top")
    often = left.join(F.broadcast(right.join(F.broadcast(top), on)), on)
    return often.unionByName(left.join(F.broadcast(top), on, "left_anti").join(right, on))


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, within: int = 50, top: int = 2000, buckets: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to max_n words by their weakest cut.

    Words are texts' [^ \\t]+ within pieces that [.,;:!?\\n-\\r] end, A-Z lower-cased; a null text is empty, a null language `und`. a, l and r are the occurrences of the phrase
    and of both parts of its cut, n the language's words; score is floor(1000000 a a / (l r)) of the cut with the least, the first of several. A phrase goes if a
    longer one with at least `within` per cent of its occurrences holds it. Ranks go by score and a, falling, then by phrase. Rows that repeat an id count
    each; an empty table gives none. Numbers up to 10^16 are exact.
    """
    phrases, totals = counted_phrases(docs, max_n, least)
    found = phrases.where("words > 1").withColumnRenamed("f", "a")
    cuts = found.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")), F.struct(F.lit("r").alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("part"))))
    cuts = written(cuts.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part"), "cuts")
    met = _with_counts(cuts, phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    both = both.withColumns({"over": wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), "under": wide("l") * wide("r")})
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("m"))
    inner = found.where("words > 2").select("lang", "a", F.col("words"), F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(2, words - 1)")).alias("m")).select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, words - m + 1)")).alias("i"))
    inner = inner.select("lang", "a", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    # the first of every bucket, then of those: no task gets all phrases of a language
    first = "row_number() over (partition by lang{} order by score desc, a desc, phrase)"
    kept = kept.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).withColumn("rank", F.expr(first.format(", bucket"))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.expr(first.format("")).cast("long")).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
s AS (SELECT lang, unnest([array_to_string(w[i:i], ' '), CASE WHEN i + 1 <= len(w) THEN array_to_string(w[i:i + 1], ' ') END, CASE WHEN i + 2 <= len(w) THEN array_to_string(w[i:i + 2], ' ') END]) AS phrase, unnest([1, 2, 3]) AS words FROM g),
f AS (SELECT lang, phrase, words, count(*) AS f FROM s WHERE phrase IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
m AS (SELECT k.lang, k.phrase, k.words, k.a, k.k, l.f AS l, r.f AS r, (1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:k.words], ' ')),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN t ON t.lang = q.lang
QUALIFY row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
