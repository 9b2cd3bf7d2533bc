"""Helpers shared by the text operators."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as a string, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts without other letters take the fast function."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the frame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn labels from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def lowest_hashes(key: Column, total: int, wanted: int) -> Column:
    """Picks about ``wanted`` of ``total`` rows, or all if there are fewer: those whose key has the lowest hashes."""
    span = 1 << 40
    return F.pmod(F.xxhash64(key), F.lit(span)) < F.lit(span if total <= wanted else span * wanted // total)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows cut anew so that rows with equal keys come in one frame. Keys are whole numbers."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch[keys].to_numpy()
        if rest and (rest[-1][keys].to_numpy()[-1] != key[0]).any():
            yield pd.concat(rest, ignore_index=True)
            rest = []
        other = np.flatnonzero((key != key[-1]).any(axis=1))
        if len(other):
            yield pd.concat([*rest, batch.iloc[: other[-1] + 1]], ignore_index=True)
            rest = []
        rest.append(batch.iloc[other[-1] + 1 :] if len(other) else batch)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def find(rows: DataFrame, keys: list[str], groups: DataFrame, over: int, into: str) -> DataFrame:
    """The rows with their group as the struct ``into``, null if they have none.

    ``groups`` has the keys, ``n``, the number of rows of each, and what else is wanted. Groups of more than ``over`` rows must be few;
    they are broadcast, and their rows go anywhere in the exchange, so a group with a third of all rows meets in no task.
    """
    hit, rest, salt = fresh(rows, into, "rest_of_group", "group_salt")

    def named(part: DataFrame, name: str) -> DataFrame:
        return part.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*part.columns).alias(name))

    large = F.broadcast(named(groups.where(F.col("n") > over), hit))
    rows = rows.join(large, [F.col(k) == F.col(f"{hit}_{k}") for k in keys], "left").drop(*[f"{hit}_{k}" for k in keys])
    rows = rows.withColumn(salt, F.when(F.col(hit).isNull(), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    other = named(groups.where(F.col("n") <= over), rest).withColumn(f"{rest}_salt", F.lit(-1).cast("long"))
    same = [F.col(salt) == F.col(f"{rest}_salt"), *[F.col(k) == F.col(f"{rest}_{k}") for k in keys]]
    rows = rows.join(other, same, "left").drop(salt, f"{rest}_salt", *[f"{rest}_{k}" for k in keys])
    return rows.withColumn(hit, F.coalesce(hit, rest)).drop(rest)
