"""SQL over catalogues: input tables are InputTable0, InputTable1 and so on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.templating import substitute


def query(tables: Sequence[DataFrame], text: str = "SELECT * FROM InputTable0", fields: Mapping[str, object] | None = None, args: Mapping[str, object] | None = None) -> DataFrame:
    """The result of one statement. {name} and {name[i]} take values from fields; :name parameters come from args, safe of quotes.

    Catalyst plans the statement as a whole: types and nulls stay as they are and an empty result has no rows.
    """
    if not tables:
        raise ValueError("a query needs a table")
    text = substitute(text, fields or {})
    spark = tables[0].sparkSession
    for i, t in enumerate(tables):
        t.createOrReplaceTempView(f"InputTable{i}")
    return spark.sql(text, args=dict(args)) if args else spark.sql(text)
