"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are letters, digits and all beyond ASCII. Each run of `gram` words is hashed, and of each `window - gram + 1`
consecutive runs the least hash is kept, the leftmost on ties; every shared span of `window` words or more then holds a
fingerprint that both sides kept. Fingerprints meet in a join and each meeting is extended, word by word, as far as a
window around it can reach. An item shorter than a window is one fingerprint, its whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash and place share a long: 35 bits of hash above 28 bits of place. Meetings are verified on the words.
PLACE_BITS = 28
_PLACE = (1 << PLACE_BITS) - 1
_HASH = (1 << 63) - 1 - _PLACE
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z. lower() is the quick way, right where no other letter has a case to lose."""
    return F.when(c.rlike(r"[[^\x00-\x7F]&&[\p{javaUpperCase}\p{javaTitleCase}]]"), F.translate(c, _UPPER, _SMALL)).otherwise(F.lower(c))


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), SEPARATORS), "")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that stand as they are: later lambdas read them, where a plain column would be worked out anew for each element."""
    for name, c in columns.items():
        df = df.select("*", F.explode_outer(F.array(c)).alias(name))
    return df


def _grams(size: Column, length: int) -> Column:
    """Hash and place (from 1) of every run of `length` words, from the words' own hashes; needs as many words."""

    def one(i: Column) -> Column:
        parts = [F.element_at("hashes", (i + k).cast("int")) for k in range(length)]
        return F.xxhash64(*parts).bitwiseAND(F.lit(_HASH)).bitwiseOR(i.cast("long"))

    return F.transform(F.sequence(F.lit(1), size - (length - 1)), one)


def _by_length(size: str, below: int) -> Column:
    """The one run of rows that are a run in whole, of 1 to below - 1 words."""
    runs = F.array().cast("array<long>")
    for n in range(1, below):
        runs = F.when(F.col(size) == n, _grams(F.lit(n), n)).otherwise(runs)
    return runs


def _least(grams: str, size: Column, width: int) -> list[tuple[str, Column]]:
    """Steps (name, column) that end in the least of every `width` consecutive grams, of `size`: each step takes minima of three of the last."""

    def step(last: str, jumps: list[int], size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), size), lambda i: F.least(*(F.element_at(last, (i + j).cast("int")) for j in jumps)))

    steps, name, reach = [], grams, 1
    while reach < width:
        jumps = sorted({min(k * reach, width - reach) for k in range(3)})
        reach += jumps[-1]
        steps.append((f"least_{reach}", step(name, jumps, size - (reach - 1))))
        name = steps[-1][0]
    return steps


def _winnowed(df: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds `hashes` of the words, and `kept`: fingerprints of rows with (words, n_words); none for fewer than `window` words.

    A word is hashed once, a run's hash is of its words' hashes, and a window's least comes from minima of minima.
    """
    none, enough = F.array().cast("array<long>"), F.col("n_words") >= window
    df = held(df, hashes=F.transform("words", lambda w: F.xxhash64(w)))
    df = held(df, grams=F.when(enough, _grams(F.col("n_words"), gram)).otherwise(none))
    last, names = "grams", ["grams"]
    for last, c in _least("grams", F.col("n_words") - (gram - 1), window - gram + 1):
        df = held(df, **{last: F.when(enough, c).otherwise(none)})
        names.append(last)
    return held(df, kept=F.array_distinct(last)).drop(*names)


def _context(words: str, place: str, slack: Column | int, length: Column | int) -> tuple[Column, Column, Column]:
    """(words before a run nearest first, the run, words after it)."""
    slack, length = (F.lit(x) if isinstance(x, int) else x for x in (slack, length))
    before = F.least(F.col(place) - 1, slack)
    return F.reverse(F.slice(words, F.col(place) - before, before)), F.slice(words, F.col(place), length), F.slice(words, F.col(place) + length, slack)


def _agreeing(a: str, b: str) -> Column:
    """How many words of two lists agree from their beginning on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.size(same)).cast("int")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 5, broadcast_rows: int = 100_000, broadcast_bytes: int = 32_000_000, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs.

    docs: (doc_id, text); items: (item_id, text). A word is hit if an occurrence of any item's window covers it. Null, empty
    and wordless texts have no words and no windows. Rows that repeat an id are judged each for themselves; items that
    repeat an id count as one in n_items; an item without an id hits but isn't counted. Without items nothing is
    hit. Columns of docs named in `also` are returned last, others are ignored. A text may have 2^28 words. The items' fingerprints are broadcast
    up to `broadcast_rows` and as many bytes of words as `broadcast_bytes`, else both sides are shuffled by fingerprint, with the words around each.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be 1 to window")
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    own = held(own, words=words_of(F.col("text"))).select("item_id", "words", F.size("words").alias("n_words")).where("n_words > 0")
    long_ = _winnowed(own.where(F.col("n_words") >= window), window, gram).select("item_id", "words", F.lit(gram).alias("length"), F.lit(window - gram).alias("slack"), F.lit(window).alias("need"), F.explode("kept").alias("v"))
    own_short = held(own.where(F.col("n_words") < window), hashes=F.transform("words", lambda w: F.xxhash64(w)))
    short = own_short.select("item_id", "words", F.col("n_words").alias("length"), F.lit(0).alias("slack"), F.col("n_words").alias("need"), F.explode(_by_length("n_words", window)).alias("v"))
    lengths = sorted(r[0] for r in own_short.select("n_words").distinct().collect())  # below `window`
    marks = long_.unionByName(short).withColumn("key", F.shiftright("v", PLACE_BITS)).withColumn("q", F.col("v").bitwiseAND(F.lit(_PLACE)).cast("int"))
    before, run, after = _context("words", "q", F.col("slack"), F.col("length"))
    marks = marks.select("key", "item_id", "length", "need", before.alias("i_before"), run.alias("i_run"), after.alias("i_after"))
    n_bytes = sum((F.aggregate(c, F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 16) for c in ("i_before", "i_run", "i_after")), F.lit(64).cast("long"))
    n_marks, mark_bytes = marks.select(n_bytes.alias("n")).limit(broadcast_rows + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    small = n_marks <= broadcast_rows and mark_bytes <= broadcast_bytes

    of_row = ["row", "doc_id", *(f"also_{i}" for i in range(len(also)))]
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(also, of_row[2:])))
    df = held(df, words=words_of(F.col("text"))).select(*of_row, "words", F.size("words").alias("n_words"))
    df = _winnowed(df, window, gram)
    more = [F.when(F.col("n_words") >= n, _grams(F.col("n_words"), n)).otherwise(F.array().cast("array<long>")) for n in lengths]
    # one row without a fingerprint keeps each document
    df = df.select(*of_row, "n_words", "words", F.explode_outer(F.concat(F.array(F.lit(-1).cast("long")), "kept", *more)).alias("v"))
    df = df.withColumn("d_key", F.when(F.col("v") >= 0, F.shiftright("v", PLACE_BITS)))
    if small:
        df = df.join(F.broadcast(marks), F.col("d_key") == F.col("key"), "left").where("v < 0 or key is not null")
    else:
        df = df.withColumn("p", F.col("v").bitwiseAND(F.lit(_PLACE)).cast("int"))
        from_ = F.greatest(F.lit(1), F.col("p") - (window - gram))
        df = df.select(*of_row, "n_words", "v", "d_key", F.when(F.col("v") >= 0, F.slice("words", from_, 2 * window)).alias("words"), F.when(F.col("v") >= 0, F.col("p") - from_ + 1).alias("p"))
        keyed, rest = df.where("v >= 0"), df.where("v < 0")
        met = keyed.join(marks, F.col("d_key") == F.col("key"))
        df = met.unionByName(rest, allowMissingColumns=True)
    if small:
        df = df.withColumn("p", F.col("v").bitwiseAND(F.lit(_PLACE)).cast("int"))
    place = F.col("v").bitwiseAND(F.lit(_PLACE)).cast("int")
    d_before, d_run, d_after = _context("words", "p", F.lit(window - gram), F.col("length"))
    met = F.col("v") >= 0
    df = df.select(*of_row, "n_words", "item_id", "need", "length", "i_before", "i_run", "i_after", "v", F.when(met, d_before).alias("d_before"), F.when(met, d_run).alias("d_run"), F.when(met, d_after).alias("d_after"), place.alias("at"))
    df = df.withColumn("left", F.when(met & (F.col("d_run") == F.col("i_run")), _agreeing("d_before", "i_before"))).withColumn("right", F.when(F.col("left").isNotNull(), _agreeing("d_after", "i_after")))
    hit = F.col("left") + F.col("length") + F.col("right") >= F.col("need")
    df = df.select(*of_row, "n_words", F.when(hit, F.struct((F.col("at") - F.col("left")).alias("lo"), (F.col("at") + F.col("length") + F.col("right") - 1).alias("hi"))).alias("span"), F.when(hit, F.col("item_id")).alias("item_id"))
    df = df.groupBy(*of_row).agg(F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("found"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"])))))
    df = df.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size("found").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("found")), 256).alias("items_sha256"), *of_row[2:])
    bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", bad.alias("contaminated"), *(F.col(n).alias(c) for c, n in zip(also, of_row[2:])))


def op9_decontamination_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row_number() OVER () AS r, * FROM t),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN ns ON len(w) >= n)),
h AS (SELECT r, dw.n, s, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
