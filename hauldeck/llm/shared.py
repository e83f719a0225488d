"""What the corpus operators share: reading, staged tables, document rows, groups in sorted streams."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/corpus-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage, and lost executors cost a re-read only."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, most: int = 500):
    """The batches' rows, a few at a time, so that only their texts become Python objects together."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty texts."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def free_name(name: str, columns: list[str]) -> str:
    """A name like this that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def content_key(text: Column) -> Column:
    """128 bits that stand for a text; null and empty texts are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns where nulls are equal, too."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """Each row with its group's columns; `groups` has one row per key and the number of its rows.

    Groups of more than one row in `share` are fewer than `share`, whatever
    the data: they are broadcast and their rows stay where they are. Only the
    rows of the others move. Both inputs are read twice, so they should be stored.
    """
    most = (groups.agg(F.sum(size)).first()[0] or 0) // share + 1
    heavy = groups.filter(F.col(size) > most)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.filter(F.col(size) <= most), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def sorted_groups(batches, keys: int):
    """Numpy columns of one group after the other, from Arrow batches sorted by the first `keys` columns.

    Only the group that is still open at a batch's end is carried on, so memory is one batch and one group.
    """
    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(p) for p in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        changed = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:keys]:
            changed |= c[1:] != c[:-1]
        ends = np.flatnonzero(changed) + 1
        starts = np.concatenate([[0], ends])
        for a, b in zip(starts[:-1].tolist(), ends.tolist(), strict=True):
            if b - a > 1:
                yield [c[a:b] for c in columns]
        rest = [c[starts[-1]:] for c in columns]
    if rest is not None and len(rest[0]) > 1:
        yield rest
