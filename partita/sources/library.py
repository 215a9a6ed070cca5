"""A library of saved pieces for each owner, newest first and limited in number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 24
PIECE = "id string, title string, created_at bigint, notes bigint"


def read(text: Column) -> Column:
    """An array of pieces from JSON text: missing, broken or not an array gives an empty one."""
    parsed = F.from_json(text, f"array<struct<{PIECE.replace(' string', ':string').replace(' bigint', ':bigint')}>>")
    empty = F.array().cast(f"array<struct<{PIECE.replace(' string', ':string').replace(' bigint', ':bigint')}>>")
    return F.when(F.trim(text).startswith("["), F.coalesce(parsed, empty)).otherwise(empty)


def limited(pieces: DataFrame, most: int = LIMIT) -> DataFrame:
    """The ``most`` newest pieces of each owner, with ``place`` from 0; ties go by id."""
    order = Window.partitionBy("owner").orderBy(F.desc("created_at"), "id")
    return pieces.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < most)


def upsert(pieces: DataFrame, saved: DataFrame, most: int = LIMIT) -> DataFrame:
    """Pieces with ``saved`` in place of those with the same owner and id, limited."""
    return limited(pieces.join(saved, ["owner", "id"], "left_anti").unionByName(saved), most)


def within_quota(pieces: DataFrame, full: Column, most: int = LIMIT) -> DataFrame:
    """The newest pieces of each owner: of one whose store is ``full`` only the newer half of them, one at least."""
    owners = Window.partitionBy("owner")
    kept = limited(pieces, most).withColumn("__n", F.count("*").over(owners))
    half = F.greatest(F.lit(1), F.floor(F.col("__n") / 2))
    return kept.where(~full | (F.col("place") < half)).drop("__n")


def delete(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """Pieces without the given (owner, id)."""
    return pieces.join(ids, ["owner", "id"], "left_anti")


def over_quota(most: int) -> int:
    """How many of ``most`` pieces are kept when the store is full: the newer half, one at least."""
    return max(1, most // 2)


def written_json(pieces: DataFrame) -> DataFrame:
    """owner, json: each library as text, nulls written out."""
    item = F.struct("place", F.struct("id", "title", "created_at", "notes").alias("piece"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["piece"])
    return pieces.groupBy("owner").agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("json"))
