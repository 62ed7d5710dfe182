"""Line dedup: lines that many documents have are dropped everywhere, with DataFrame functions only.

Lines are exploded and hashed, documents are counted for each hash, and hits come back as positions: only hashes and positions are shuffled until the
texts, once, meet the list of what goes. A text is put together again from the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, unused, written
from .decontamination import ascii_lower

WHITE = " \t\n\x0b\f\r"


def _hashes(c: Column) -> list[Column]:
    """128 bits of a string."""
    return [F.xxhash64(F.lit(k), c).alias(f"h{k}") for k in (1, 2)]


def _keys(text: Column) -> Column:
    """The key of every line of a text: white space stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(WHITE)))


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): hashes of the keys of at least min_chars code points that at least min_docs rows of docs have, and how many do.

    A row counts once for a key, however often it has it; a row is a document, whatever its id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(F.explode(F.array_distinct(_keys(text))).alias("key")).where(F.char_length("key") >= max(min_chars, 0))
    return keys.select(*_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_rows: int = 100_000) -> DataFrame:
    """docs with `text` less its common lines, and n_lines (before) and n_dropped, so named unless docs has such columns (then with underscores after them).

    Lines end at \\n alone. A null text stays null, and like an empty one it is one empty line, which has no key of a code point or more; where all lines go, the text is
    empty. Keys are the same as their 128-bit hashes are. Rows are documents each for itself, also those with null or repeated ids; rows that are alike get alike
    results. An empty table has an empty result. Columns of any other name stay.

    The `broadcast_rows` most common lines at most are joined by broadcast: as counts add up to their total, no more than so many have over 1/broadcast_rows of it. All
    others are joined by a shuffle in which none has more than that share.
    """
    common = written(common_lines(docs, min_docs, min_chars), "lines")
    n_common, total = common.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # rows of equal id and text lose the same lines: these name a row, whatever task reads it
    names = ["r1", "r2", "r_id"]
    name = [F.xxhash64(F.lit(k), text).alias(f"r{k}") for k in (1, 2)] + ([F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("r_id")] if "doc_id" in docs.columns else [F.lit("").alias("r_id")])
    # names are made before the lines: beside them, they would be made for each
    places = docs.select(*name, text.alias("text")).select(*names, F.posexplode(_keys(F.col("text"))).alias("pos", "key")).where(F.char_length("key") >= max(min_chars, 0)).select(*names, "pos", *_hashes(F.col("key")))
    if n_common <= broadcast_rows:
        hits = places.join(F.broadcast(common.select("h1", "h2")), ["h1", "h2"])
    else:
        top = F.col("n") * broadcast_rows > total
        most, rest = common.where(top).select("h1", "h2"), common.where(~top).select("h1", "h2")
        often = places.join(F.broadcast(most), ["h1", "h2"])
        hits = often.unionByName(places.join(F.broadcast(most), ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    hits = hits.groupBy(*names).agg(F.collect_set("pos").alias("hit"))
    own = {c: unused(docs, f"own_{c}") for c in names}
    gone, lines, kept = unused(docs, "gone"), unused(docs, "lines"), unused(docs, "kept")
    theirs = hits.select(*(F.col(c).alias(f"{own[c]}_hit") for c in names), F.col("hit").alias(gone))
    rows = docs.select("*", *(c.alias(own[k]) for c, k in zip(name, names)))
    met = rows.join(theirs.hint("shuffle_hash"), [rows[own[c]] == theirs[f"{own[c]}_hit"] for c in names], "left")
    met = met.select(*columns_of(docs), F.coalesce(gone, F.array().cast("array<int>")).alias(gone), F.explode(F.array(F.split(text, "\n"))).alias(lines))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    met = met.select("*", F.explode(F.array(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))).alias(kept))
    # a row whose lines all stay keeps its text as it is
    new = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.col(kept)).alias("text")
    numbers = [F.size(lines).cast("long").alias(unused(docs, "n_lines")), F.size(gone).cast("long").alias(unused(docs, "n_dropped"))]
    return met.select(*(new if c == "text" else F.col(f"`{c}`") for c in docs.columns), *numbers)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id
"""
