"""Product catalogues: a folder `<name>.cdb` with data.csv, one row a product, whose FILE column names the product's data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import dense_index
from ..functions.storage import settled
from ..operators.columns import NUMERIC


#: What the folder of a product's data is called, before its key.
PRODUCT = "product="


def _folder(path: str) -> str:
    path = path.rstrip("/")
    if not path.endswith(".cdb"):
        raise ValueError("a catalogue's path ends in .cdb")
    return path


def read_catalogue(spark: SparkSession, path: str, file_columns: Sequence[str] = ("FILE",)) -> DataFrame:
    """The rows of a catalogue; file columns get its path in front, and must be there and hold text."""
    path = _folder(path)
    df = spark.read.csv(f"{path}/data.csv", header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    for c in file_columns:
        if c not in df.columns:
            raise ValueError(f"the catalogue has no column {c}")
        if not isinstance(df.schema[c].dataType, T.StringType):
            raise ValueError(f"the column {c} isn't text")
        df = df.withColumn(c, F.concat(F.lit(path + "/"), F.col(c)))
    return df


def read_products(catalogue: DataFrame, file_column: str = "FILE", reader: Callable[[SparkSession, list[str]], DataFrame] | None = None) -> DataFrame:
    """The products of a catalogue's rows, block by block, with the row's columns on every record.

    Only the files of rows that are left are read, so a WHERE before this prunes files. Parquet and CSV products are read by
    format, each with its path; a reader may take others (spark, paths) -> rows with a `_path` column. ds numbers the rows by path.
    """
    spark = catalogue.sparkSession
    numbered = dense_index(catalogue.select(file_column).distinct(), [file_column], "ds")
    own = catalogue.join(numbered, file_column).withColumn("_at", _plain(spark, F.col(file_column)))
    paths = [r[0] for r in catalogue.select(file_column).distinct().collect()]
    parts: list[DataFrame] = []
    kinds = {p: "parquet" if p.rsplit("/", 1)[-1].startswith(PRODUCT) else p.rsplit(".", 1)[-1].lower() for p in paths}
    for kind in sorted(set(kinds.values())):
        these = [p for p in paths if kinds[p] == kind]
        if reader is not None:
            part = reader(spark, these)
        elif kind == "parquet":
            part = spark.read.parquet(*these).select("*", F.col("_metadata.file_path").alias("_path"))
        elif kind == "csv":
            part = spark.read.csv(these, header=True, inferSchema=True).select("*", F.col("_metadata.file_path").alias("_path"))
        else:
            part = spark.read.format("binaryFile").load(these).select("content", F.col("path").alias("_path"))
        parts.append(part)
    if not parts:
        return own.limit(0)
    data = parts[0]
    for p in parts[1:]:
        data = data.unionByName(p, allowMissingColumns=True)
    # a product is a file, or a folder of part files: records meet it by the whole path of either
    at = _plain(spark, F.col("_path"))
    data = data.withColumn("_at", F.explode(F.array_distinct(F.array(at, F.regexp_replace(at, "/[^/]*$", "")))))
    carried = [c for c in own.columns if c not in data.columns]
    return data.drop("_path").join(own.select("_at", *carried), "_at").drop("_at")


def _plain(spark: SparkSession, path: Column) -> Column:
    """A path without its store's name, with single slashes, in full, and as it reads without escapes."""
    fs, here = _file(spark, ".")
    root = fs.makeQualified(here).toUri().getPath().rstrip("/")
    full = F.when(path.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|/)"), path).otherwise(F.concat(F.lit(root + "/"), path))
    bare = F.regexp_replace(F.regexp_replace(full, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/+", "/")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def product_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds _key, and FILE, the folder of that key under data/.

    A key is the values joined by _ (those of an array by a bar), in signs that any store takes, and a digest of the values themselves, which keeps apart what reads alike.
    """
    parts = [F.concat_ws("|", F.col(k).cast("array<string>")) if isinstance(df.schema[k].dataType, T.ArrayType) else F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    told = F.to_json(F.struct(*(F.col(k) for k in keys)), {"ignoreNullFields": "false"}) if keys else F.lit("")
    key = F.concat_ws("-", F.regexp_replace(F.concat_ws("_", *parts), "[^A-Za-z0-9_.|-]", "-"), F.substring(F.sha2(told, 256), 1, 16))
    return df.withColumn("_key", key).withColumn("FILE", F.concat(F.lit(f"data/{PRODUCT}"), "_key"))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the rows whose keys are in new, and new: the last of its rows with a key, by _order if it has that."""
    if set(old.columns) != set(new.columns) - {"_order"}:
        raise ValueError(f"the catalogue has the columns {sorted(old.columns)}, the product {sorted(set(new.columns) - {'_order'})}")
    order = F.desc("_order") if "_order" in new.columns else F.desc(F.struct(*sorted(old.columns)))
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").select(*old.columns)
    same = [old[k].eqNullSafe(last[k]) for k in keys]
    kept = old.join(last.select(*keys), same, "left_anti") if keys else old
    return kept.unionByName(last)


def write_products(products: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends products, told apart by their keys, to a catalogue: rows with equal keys are replaced, with their data.

    FILE and internal columns, whose names begin with an underscore, are dropped. The data of a product is Parquet under data/, in a folder for its key.
    """
    path = _folder(path)
    spark = products.sparkSession
    own = products.drop("FILE", *(c for c in products.columns if c.startswith("_")))
    named = product_key(own, keys)
    rows = named.select(*keys, "FILE").distinct()
    fs, at = _file(spark, f"{path}/data.csv")
    if fs.exists(at):
        # by name: the file's columns may stand in another order
        old = spark.read.csv(f"{path}/data.csv", header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        if set(old.columns) != set(rows.columns):
            raise ValueError(f"the catalogue has the columns {old.columns}, the product {rows.columns}")
        old = old.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in rows.schema.fields))
        rows = settled(upserted(old, rows, keys), "catalogue")
    # one job for all products; those written replace their own folders and no other
    named.drop("FILE").withColumnRenamed("_key", PRODUCT[:-1]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PRODUCT[:-1]).parquet(f"{path}/data")
    _write_csv(rows, f"{path}/data.csv")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write_csv(rows: DataFrame, path: str) -> None:
    """The catalogue as one file, written aside and put in place by a rename."""
    spark = rows.sparkSession
    rows.orderBy(*rows.columns).coalesce(1).write.mode("overwrite").csv(path + ".new", header=True)
    fs, at = _file(spark, path)
    part = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path + ".new/part-*"))[0].getPath()
    # in one step: a reader, or a crash, finds the old file or the new one
    how = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(at), over)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path + ".new"), True)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
