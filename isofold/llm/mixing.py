"""Mixing sources to target weights, with DataFrame and SQL functions only.

Each source's words, its documents one after another, are packed into blocks of `block_words` words. A source is due
as many slots of the mix as its target has blocks. The mix is made of output shards of `shard_slots` slots. For each shard the counts by source are
drawn from a multinomial with the sources' shares: a pseudorandom number for each place of the shard falls to a source. Totals of free draws miss the
targets by several percent, so they are adjusted: of a source drawn too often, each shard gives up its part of the excess, evenly
along the shards, and a pseudorandom permutation deals the places so freed to the sources drawn too seldom. Every shard stays full and every
target is met to within a block.

A shard's counts give it the next slots of each source. The k-th slot of a source takes block perm(k mod blocks), where perm is a
pseudorandom permutation of the source's block indices that changes with each pass over the source; slots and documents meet in
a join by block index.

The permutations are swap-or-not shuffles with a multiplication: each round exchanges x and its mirror (K - x) mod n, or not,
by a bit that both share, then multiplies by a prime that doesn't divide n, so any n is permuted exactly with no walk or sort. All arithmetic is
on whole numbers below 2^63 and the same in any SQL engine, for up to 2^43 slots: at 64 words a block that is 560 million million words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BLOCK_WORDS = 64
SHARD_SLOTS = 16_384
MOST_SLOTS = 1 << 43
ROUNDS = 10
WORD = r"[^\x20\x09-\x0D]+"
_P = 2147483647
#: Primes between 2^19 and 2^20, far apart. A number below 2^43 is a multiple of two of them at most, so one of any three doesn't divide it.
_PRIMES = (848143, 648007, 971851, 771691, 571541, 895387, 695239, 1019093)


def _key(seed: str, r: int) -> str:
    return f"(({seed}) + {r * 1299709 + 12345}) % {_P} * 48271 % {_P}"


def _small(x: str) -> str:
    """A number below 2^31 - 1 of any below 2^43."""
    return f"(({x}) % {_P} + (({x}) >> 31) * 69621) % {_P}"


def _square(x: str) -> str:
    return f"(({x}) % {_P}) * (({x}) % {_P}) % {_P}"


def shuffle_rounds(x: str, n: str, seed: str, rounds: int = ROUNDS) -> list[list[tuple[str, str]]]:
    """Steps of (name, expression), each over the columns before it, that permute column x of 0 to n - 1; the result is in x."""
    steps = []
    for r in range(rounds):
        a, b, c = (_PRIMES[(r + k) % len(_PRIMES)] for k in range(3))
        steps.append([("sk", _key(seed, r))])
        steps.append([("sm", f"(sk % {n} + {n} - {x}) % {n}")])
        steps.append([("sh", f"({_small(f'greatest({x}, sm)')} + sk) % {_P}")])
        steps.append([("sh", f"({_square('sh')} + sk) % {_P}")])
        steps.append([("sh", f"({_square('sh')} * 48271 + sk) % {_P}")])
        steps.append([("sh", _square("sh"))])
        steps.append([(x, f"((CASE WHEN sh % 4096 < 2048 THEN {x} ELSE sm END) * (CASE WHEN {n} % {a} <> 0 THEN {a} WHEN {n} % {b} <> 0 THEN {b} ELSE {c} END) + sk) % {n}")])
    return steps


def draw_steps(x: str, n: str) -> list[list[tuple[str, str]]]:
    """Steps that put a pseudorandom number of 0 to n - 1, one for each x, into `drawn`."""
    return [
        [("sh", f"({_small(x)} + 918273) % {_P}")],
        [("sh", f"({_square('sh')} * 48271 + 12345) % {_P}")],
        [("sh", f"({_square('sh')} * 69621 + ({x}) % {_P}) % {_P}")],
        [("sk", f"({_square('sh')} * 48271 + 777) % {_P}")],
        [("sm", f"({_square('sk')} * 69621 + sh) % {_P}")],
        [("drawn", f"(sk * 2147483648 + sm) % {n}")],
    ]


def _stepped(df: DataFrame, x: str, steps: list[list[tuple[str, str]]]) -> DataFrame:
    """df with column x worked out by steps; it stands as it is."""
    for step in steps:
        for name, e in step:
            # x is exploded from a list of one: the optimizer then pushes no later predicate back into the steps, which would repeat them within each other
            df = df.withColumn(name, F.expr(e)) if name != x else df.select(*(c for c in df.columns if c not in (x, "sk", "sm", "sh")), F.explode_outer(F.array(F.expr(e))).alias(x))
    return df


def running(df: DataFrame, keys: list[str], at: str, value: str, name: str, chunk: int = 4096) -> DataFrame:
    """Adds the sum of value over rows of the same keys with a smaller `at`, a number, in two steps: within chunks, and over the chunks' sums."""
    df = df.withColumn("chunk_", F.expr(f"{at} div {chunk}"))
    within = F.expr(f"sum({value}) OVER (PARTITION BY {', '.join([*keys, 'chunk_'])} ORDER BY {at}) - {value}")
    sums = df.groupBy(*keys, "chunk_").agg(F.sum(value).alias("sum_"))
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    sums = sums.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("chunk_").alias("of_"), F.expr(f"sum(sum_) OVER ({by}ORDER BY chunk_) - sum_").alias("before_"))
    on = F.col("chunk_") == F.col("of_")
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}_"))
    out = df.withColumn(name, within).join(sums, on).withColumn(name, F.col(name) + F.col("before_"))
    return out.drop("chunk_", "of_", "before_", *(f"{k}_" for k in keys))


#: Of sources (source, source_size): rank, weight, and the target that stops at twice the size.
_TARGETS = """
SELECT source, source_size, s, w, target, blocks, slots, sum(slots) OVER (ORDER BY s) - slots AS slot_from, sum(slots) OVER () AS all_slots
FROM (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target * blocks / source_size + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS slots
 FROM (SELECT *, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
   ELSE CAST((3 * total - 4 * coalesce(full_size, 0)) * w AS DOUBLE) / CAST(2 * free_w AS DOUBLE) END AS target, CAST((source_size + {L} - 1) {DIV} {L} AS BIGINT) AS blocks
  FROM (SELECT *, sum(CASE WHEN capped THEN source_size END) OVER () AS full_size, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS free_w
   FROM (SELECT *, 4 * source_size * w_from <= (3 * total - 4 * size_before) * w AS capped
    FROM (SELECT *, sum(source_size) OVER () AS total, sum(source_size) OVER (ORDER BY source_size * 10 {DIV} w, s) - source_size AS size_before,
      sum(w) OVER () - sum(w) OVER (ORDER BY source_size * 10 {DIV} w, s) + w AS w_from
     FROM (SELECT *, CASE (s - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM (SELECT *, CAST(row_number() OVER (ORDER BY source NULLS LAST) AS BIGINT) AS s FROM {SOURCES}))))))) x
"""


def source_targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, source_size, s rank, w, target, blocks, slots, slot_from, all_slots) of (source, source_size), a row for each source.

    Targets share 150 % of all sizes by weight; one that would pass twice its source's size stops there and the excess goes to
    the others by weight, until none is above. One window over the sources in order of size by weight does it: those
    before the first that stays below its cap are full.
    """
    return sizes.sparkSession.sql(_TARGETS.format(L=block_words, DIV="div", SOURCES="{sizes}"), sizes=sizes)


def measured(docs: DataFrame, told_by: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, tie): one scan of the texts. tie is a number of 60 bits of the text, or of the string told_by, by which rows of one id and size are in order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told_by = text if told_by is None else F.coalesce(told_by, F.lit(""))
    tie = F.conv(F.substring(F.md5(told_by.cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), tie.alias("tie"))


def _with_targets(base: DataFrame, targets: DataFrame, broadcast_sources: int) -> DataFrame:
    few = targets.limit(broadcast_sources + 1).count() <= broadcast_sources
    right = targets.withColumnRenamed("source", "of_source")
    return base.join(F.broadcast(right) if few else right, base["source"].eqNullSafe(right["of_source"])).drop("of_source")


def _chunk(chunks: str) -> str:
    """The chunk of a document by a hash of its id and text."""
    return f"{_square(f'((coalesce(doc_id, 0) % {_P}) + {_P} + tie % {_P}) % {_P}')} * 48271 % {_P} % {chunks}"


def placed(base: DataFrame) -> DataFrame:
    """Adds `begins`: the words of its source before each document of (row, doc_id, s, size, tie).

    Offsets run within about sqrt(n) chunks of a source, to which a hash deals the documents, then over the chunks' totals: no task orders a whole source.
    """
    n = base.count()
    chunks = max(1, n // max(256, int(n**0.5)))
    df = base.where("size > 0").withColumn("chunk", F.expr(_chunk(str(chunks))))
    totals = df.groupBy("s", "chunk").agg(F.sum("size").alias("words"))
    totals = totals.selectExpr("s AS of_s", "chunk AS of_chunk", "sum(words) OVER (PARTITION BY s ORDER BY chunk) - words AS chunk_begins")
    df = df.withColumn("begins", F.expr("sum(size) OVER (PARTITION BY s, chunk ORDER BY doc_id NULLS FIRST, size, tie, row ROWS UNBOUNDED PRECEDING) - size"))
    return df.join(totals, (df["s"] == totals["of_s"]) & (df["chunk"] == totals["of_chunk"])).withColumn("begins", F.col("begins") + F.col("chunk_begins")).drop("of_s", "of_chunk", "chunk", "chunk_begins")


#: Of an excess `e` of a source drawn `all_drawn` times, what is given up by the time it was drawn `c` times.
_GIVEN = "CASE WHEN {c} = all_drawn THEN e ELSE CAST(floor(CAST({c} AS DOUBLE) * CAST(e AS DOUBLE) / CAST(all_drawn AS DOUBLE)) AS BIGINT) END"
CELLS = 65_536


def _by_source(df: DataFrame, x: str, ranges: DataFrame, n: int, few: bool) -> DataFrame:
    """Adds s, the source whose range (s, lo, hi) of 0 to n - 1 holds x: ranges are listed by cell, and joined by that. Cells and sources bound a broadcast."""
    width = n // CELLS + 1
    cells = ranges.select(F.col("s"), "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell"))
    df = df.withColumn("at_cell", F.expr(f"{x} div {width}"))
    on = (F.col("at_cell") == F.col("cell")) & (F.col(x) >= F.col("lo")) & (F.col(x) < F.col("hi"))
    return df.join(F.broadcast(cells) if few else cells, on).drop("at_cell", "cell", "lo", "hi")


def drawn_counts(targets: DataFrame, shard_slots: int = SHARD_SLOTS, broadcast_sources: int = 10_000) -> DataFrame:
    """(shard, s, n, k_from): the slots that each output shard takes of each source, the first of them being k_from.

    Multinomial draws by shard, adjusted to the sources' slots. One row for each shard and source with slots; no task holds more than a shard's places.
    """
    spark = targets.sparkSession
    due = targets.where("slots > 0").select("s", "slots", F.col("slot_from").alias("lo"), F.expr("slot_from + slots").alias("hi"))
    n, sources = targets.agg(F.coalesce(F.max("all_slots"), F.lit(0)).cast("long"), F.count("*")).first()
    few = sources <= broadcast_sources
    if n > MOST_SLOTS:
        raise ValueError(f"{n} slots are more than {MOST_SLOTS}: take larger blocks")
    shards = -(-n // shard_slots)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 500_000)
    places = spark.range(0, shards, 1, max(1, min(shards, parts))).select(F.col("id").alias("shard"), F.explode(F.expr(f"sequence(id * {shard_slots}, least({n}, (id + 1) * {shard_slots}) - 1)")).alias("place"))
    draws = _stepped(places, "drawn", draw_steps("place", f"{n}"))
    # from here on there is a row for each shard and source
    counts = written(_by_source(draws, "drawn", due, n, few).groupBy("shard", "s").agg(F.count("*").alias("n")), "draws")
    drawn = counts.groupBy(F.col("s").alias("of_s")).agg(F.sum("n").alias("all_drawn"))
    totals = due.join(drawn, F.col("s") == F.col("of_s"), "left").select("s", "slots", F.coalesce("all_drawn", F.lit(0)).alias("all_drawn"))
    totals = written(totals.withColumn("e", F.expr("greatest(all_drawn - slots, 0)")).withColumn("lacks", F.expr("greatest(slots - all_drawn, 0)")), "totals")
    free = int(totals.agg(F.sum("lacks")).first()[0] or 0)
    over = totals.select(F.col("s").alias("of_s"), "all_drawn", "e")
    given = running(counts, ["s"], "shard", "n", "before").join(F.broadcast(over) if few else over, F.col("s") == F.col("of_s"))
    given = given.select("shard", "s", "n", F.expr(f"({_GIVEN.format(c='(before + n)')}) - ({_GIVEN.format(c='before')})").alias("gives"))
    # the places given up, in the order of shards, are dealt to the sources that lack some
    freed = running(given.where("gives > 0").groupBy("shard").agg(F.sum("gives").alias("gives")), [], "shard", "gives", "from_free")
    freed = freed.select("shard", F.explode(F.expr("sequence(from_free, from_free + gives - 1)")).alias("free"))
    lacking = totals.where("lacks > 0").selectExpr("s", "sum(lacks) OVER (ORDER BY s) - lacks AS lo", "sum(lacks) OVER (ORDER BY s) AS hi")
    if free:
        taken = _by_source(_stepped(freed, "free", shuffle_rounds("free", f"{free}", "CAST(31 AS BIGINT)")), "free", lacking, free, few)
        given = given.selectExpr("shard", "s", "n - gives AS n").unionByName(taken.groupBy("shard", "s").agg(F.count("*").alias("n")))
    else:
        given = given.select("shard", "s", "n")
    counts = given.groupBy("shard", "s").agg(F.sum("n").alias("n")).where("n > 0")
    return running(written(counts, "counts"), ["s"], "shard", "n", "k_from")


def mix_slots(targets: DataFrame, shard_slots: int = SHARD_SLOTS, chunk: int = 4096) -> DataFrame:
    """(s, k, pass, block, place, shard): the mix, a row for each slot. Slots are made from the shards' counts, in chunks of even size."""
    counts = drawn_counts(targets, shard_slots)
    counts = counts.withColumn("place_from", F.expr(f"shard * {shard_slots} + sum(n) OVER (PARTITION BY shard ORDER BY s) - n"))
    sizes = targets.select(F.col("s").alias("of_s"), "blocks")
    counts = counts.join(sizes, F.col("s") == F.col("of_s"))
    df = counts.select("shard", "s", "blocks", "n", "k_from", "place_from", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")).alias("c"))
    # a number of its own keeps the chunks apart: they are small until each makes its slots
    made = int(targets.agg(F.max("all_slots")).first()[0] or 0)
    parts = max(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), made // 500_000)
    df = df.repartition(parts, F.col("shard"), F.col("s"), F.col("c"))
    df = df.select("shard", "s", "blocks", "k_from", "place_from", F.explode(F.expr(f"sequence(c * {chunk}, least(n, (c + 1) * {chunk}) - 1)")).alias("j"))
    df = df.withColumns({"k": F.expr("k_from + j"), "place": F.expr("place_from + j")})
    df = df.withColumns({"pass": F.expr("k div blocks"), "block": F.expr("k % blocks")})
    df = _stepped(df, "block", shuffle_rounds("block", "blocks", "s * 7919 + pass * 104729"))
    return df.select("s", "k", "pass", "block", "place", "shard")


def shard_blocks(targets: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, s, block, times): the mix itself, how often each output shard takes a block of a source."""
    return mix_slots(targets, shard_slots).groupBy("shard", "s", "block").agg(F.count("*").alias("times"))


def mix_by_shard(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, source, block, times) of documents, whose words fill a source's blocks in the order of `placed`."""
    sizes = measured(docs).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, block_words), "targets")
    names = targets.select("source", F.col("s").alias("of_s"))
    counts = shard_blocks(targets, shard_slots).hint("merge")
    return counts.join(names, counts["s"] == names["of_s"]).select("shard", "source", "block", "times")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, broadcast_sources: int = 10_000, told_by: Column | None = None) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    Each block is taken at most twice, so no document gives more than twice its words. Null, empty and blank texts have size 0 and give
    nothing; a null source is a source of its own, the last; null doc_ids come first in their source; rows that repeat a doc_id
    are documents of their own. Without words all targets are 0. Other columns are ignored. A document's place in its source comes from its id, its size and its
    text, or the string `told_by` in the text's stead.
    """
    base = written(measured(docs, told_by), "mixing")
    targets = written(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), block_words), "targets")
    docs_ = _with_targets(base, targets, broadcast_sources)
    # what the shards take, summed
    counts = shard_blocks(targets).groupBy("s", "block").agg(F.sum("times").alias("times"))
    blocks = placed(docs_.select("row", "doc_id", "s", "size", "tie"))
    blocks = blocks.select("row", "s", "size", "begins", F.explode(F.expr(f"sequence(begins div {block_words}, (begins + size - 1) div {block_words})")).alias("block"))
    words = F.expr(f"least(begins + size, (block + 1) * {block_words}) - greatest(begins, block * {block_words})")
    # the planner takes the slots for as small as the targets that they are made from, and would broadcast them
    taken = blocks.select("row", "s", "block", words.alias("words")).join(counts.hint("merge"), ["s", "block"]).groupBy(F.col("row").alias("of_row")).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = docs_.join(taken, docs_["row"] == taken["of_row"], "left")
    return out.select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op7_mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def _in_sql(inner: str, steps: list[list[tuple[str, str]]], *, new: tuple[str, ...] = ()) -> str:
    own = "".join(f", CAST(0 AS BIGINT) AS {c}" for c in ("sk", "sm", "sh", *new))
    inner = f"SELECT *{own} FROM ({inner})"
    for step in steps:
        inner = f"SELECT * REPLACE ({', '.join(f'{e} AS {name}' for name, e in step)}) FROM ({inner})"
    return inner


def oracle(block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> str:
    """DuckDB SQL for the same rows, with the draws, their adjustment and the slots of each shard."""
    L, H = block_words, shard_slots
    draws = _in_sql(f"SELECT p AS place, p // {H} AS shard, m FROM (SELECT unnest(range(0, (SELECT m FROM a))) AS p, (SELECT m FROM a) AS m)", draw_steps("place", "m"), new=("drawn",))
    dealt = _in_sql("SELECT shard, f, m FROM f1, (SELECT CAST(sum(lacks) AS BIGINT) AS m FROM tot)", shuffle_rounds("f", "m", "CAST(31 AS BIGINT)"))
    slots = _in_sql("SELECT s, blocks, k // blocks AS pass, k % blocks AS block FROM sl", shuffle_rounds("block", "blocks", "s * 7919 + pass * 104729"))
    return f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS tie FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
t0 AS ({_TARGETS.format(L=L, DIV="//", SOURCES="z")}),
t AS (SELECT source, source_size, s, target, blocks, CAST(slots AS BIGINT) AS slots, CAST(slot_from AS BIGINT) AS slot_from FROM t0),
a AS (SELECT CAST(coalesce(sum(slots), 0) AS BIGINT) AS m FROM t),
dr AS ({draws}),
c0 AS (SELECT shard, s, count(*) AS n FROM dr JOIN t ON drawn >= slot_from AND drawn < slot_from + slots GROUP BY shard, s),
c1 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY s ORDER BY shard) - n AS BIGINT) AS before FROM c0),
tot AS (SELECT t.s, slots, coalesce(d, 0) AS all_drawn, greatest(coalesce(d, 0) - slots, 0) AS e, greatest(slots - coalesce(d, 0), 0) AS lacks
  FROM t LEFT JOIN (SELECT s, CAST(sum(n) AS BIGINT) AS d FROM c0 GROUP BY s) x ON t.s = x.s WHERE slots > 0),
g AS (SELECT shard, c1.s, n, ({_GIVEN.format(c="(before + n)")}) - ({_GIVEN.format(c="before")}) AS gives FROM c1 JOIN tot ON c1.s = tot.s),
f0 AS (SELECT shard, gives, sum(gives) OVER (ORDER BY shard) - gives AS lo FROM (SELECT shard, CAST(sum(gives) AS BIGINT) AS gives FROM g WHERE gives > 0 GROUP BY shard)),
f1 AS (SELECT shard, unnest(range(CAST(lo AS BIGINT), CAST(lo + gives AS BIGINT))) AS f FROM f0),
lk AS (SELECT s, sum(lacks) OVER (ORDER BY s) - lacks AS lo, sum(lacks) OVER (ORDER BY s) AS hi FROM tot WHERE lacks > 0),
dl AS (SELECT shard, s, count(*) AS n FROM ({dealt}) y JOIN lk ON f >= lo AND f < hi GROUP BY shard, s),
c2 AS (SELECT shard, s, CAST(sum(n) AS BIGINT) AS n FROM (SELECT shard, s, n - gives AS n FROM g UNION ALL SELECT shard, s, n FROM dl) GROUP BY shard, s HAVING sum(n) > 0),
c3 AS (SELECT shard, s, n, CAST(sum(n) OVER (PARTITION BY s ORDER BY shard) - n AS BIGINT) AS k_from FROM c2),
sl AS (SELECT shard, c3.s, blocks, unnest(range(k_from, k_from + n)) AS k FROM c3 JOIN t ON c3.s = t.s),
n AS (SELECT greatest(1, count(*) // greatest(256, CAST(floor(sqrt(count(*))) AS BIGINT))) AS chunks FROM b),
d AS (SELECT r, doc_id, tie, b.source, size, s, source_size, target, {_chunk("chunks")} AS chunk FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source, n),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY s ORDER BY chunk, doc_id NULLS FIRST, size, tie, r ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS begins FROM d),
db AS (SELECT r, s, block, least(begins + size, (block + 1) * {L}) - greatest(begins, block * {L}) AS words
       FROM (SELECT r, s, size, begins, unnest(range(begins // {L}, (begins + size - 1) // {L} + 1)) AS block FROM p WHERE size > 0)),
c AS (SELECT s, block, count(*) AS times FROM ({slots}) GROUP BY s, block),
k AS (SELECT r, CAST(sum(words * times) AS BIGINT) AS taken FROM db JOIN c USING (s, block) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM p LEFT JOIN k USING (r)
"""
