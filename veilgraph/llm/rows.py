"""Row keys for tables whose ids may be null or repeat. Rows alike in id and text are told apart by their place, so that many of them don't fall in one range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.ordered import numbered
from veilgraph.plans.workspace import materialize


def unique_ids(docs: DataFrame, id_col: str, text_col: str, carry: list[str] = ()) -> DataFrame:
    """(id, bytes, own, ...): the text's bytes under a unique long id in the order of the documents, and the id that the row came with.

    ``id`` is ``own`` itself where no id is null or repeated; else rows are numbered by id, nulls last, then by their text's hash.
    Columns in ``carry`` follow as ``_carried_0`` and so on.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).cast("binary").alias("bytes"), *(docs[c].alias(f"_carried_{i}") for i, c in enumerate(carry)))
    more = plain.columns[2:]
    if plain.groupBy("own").count().where("count > 1 or own is null").limit(1).count() == 0:
        return plain.select(F.col("own").alias("id"), "bytes", "own", *more)
    order = [F.col("own").asc_nulls_last(), F.xxhash64("bytes"), F.col("_tie")]
    return materialize(numbered(plain.withColumn("_tie", F.monotonically_increasing_id()), order, name="id").select("id", "bytes", "own", *more))


def with_keys(docs: DataFrame, id_col: str, by: list[str], name: str) -> DataFrame:
    """``docs`` with a unique long key ``name`` in the order of the ids: the id itself where none is null or repeated, else the row's number by id, nulls last, then by the hash of the columns ``by``."""
    own = docs[id_col].cast("long")
    if docs.select(own.alias("own")).groupBy("own").count().where("count > 1 or own is null").limit(1).count() == 0:
        return docs.withColumn(name, own)
    order = [own.asc_nulls_last(), F.xxhash64(*(docs[c] for c in by)), F.col("_tie")]
    return materialize(numbered(docs.withColumn("_tie", F.monotonically_increasing_id()), order, name=name).drop("_tie"))


def plainly(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns called c0, c1 and so on, so that no name clashes with an operator's own, and the new name of each."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))
