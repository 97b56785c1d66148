"""What similarity joins share: verified links between sets, without all pairs of a group.

An index has rows (id, n, entry columns): the sets that share an entry are
candidates of each other.  ``link`` first verifies an entry's members against its
least member only.  Entries whose members then lie in one component need no more
links; the members of the others are verified across components.

What an entry's members are joined with is an aggregate.  It is stored first: then it
is broadcast if it is small, and else both sides of the join are plain shuffles, so
that an entry with very many members is split over tasks.

Spark takes the size of a table before ``explode`` for its size after it, so joins
of such tables are told to shuffle: a wrong guess would broadcast them.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import Durable, small


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union; sets has id and tokens (distinct)."""
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def in_length(n: str, m: str, percent: int) -> Column:
    """Whether sets of n and m tokens can be linked at all."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def star(index: DataFrame, by: list[str], percent: int, store: Durable) -> DataFrame:
    """Each entry's least member with every other one that it can be linked to."""
    least = index.groupBy(*by).agg(F.min(F.struct("id", "n")).alias("least"), F.count(F.lit(1)).alias("df")).filter("df > 1").select(*by, F.col("least.id").alias("a"), F.col("least.n").alias("na"))
    both = index.join(store.small(least, "least"), by).filter(F.col("a") < F.col("id")).filter(in_length("n", "na", percent))
    return both.select("a", F.col("id").alias("b")).distinct()


#: Words of a bitmap.
WORDS = 16
#: Earlier entries of a set that travel with an index row.
EARLIER = 4


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Of each of 64 * WORDS bits whether an odd number of the tokens falls on it.

    A token in one of two sets and not the other changes at most one bit, so the
    bitmaps of two sets differ in no more bits than the sets in tokens.
    """
    odd = (np.bincount((tokens >> np.uint64(17)) % np.uint64(64 * WORDS), minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _meetings(index: DataFrame, by: list[str], extra: DataFrame, columns: list[Column], percent: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of a join of an index with itself, and the condition that a pair of rows is worth a look.

    The two sets lie in different components, and their lengths allow a link.  Two
    sets may meet in many entries: in the order of the entries' hashes a meeting is
    passed over if the sets also share one of the ``EARLIER`` entries before it, so
    that their first meeting always counts and few others do.  ``columns`` of
    ``extra`` (by id) travel with the rows.
    """
    before = [f"p{i}" for i in range(EARLIER)]
    order = Window.partitionBy("id").orderBy("h")
    index = index.select(F.xxhash64(*by).alias("h"), "id", "component", "n")
    index = index.select("*", *(F.coalesce(F.lag("h", i + 1).over(order), F.xxhash64("id", F.lit(i))).alias(p) for i, p in enumerate(before)))
    index = index.join(extra.select("id", *columns).hint("merge"), "id")
    x, y = (index.withColumnsRenamed({c: f"{c}_{side}" for c in index.columns}) for side in "xy")
    near = (F.col("h_x") == F.col("h_y")) & (F.col("id_x") < F.col("id_y")) & (F.col("component_x") != F.col("component_y")) & in_length("n_x", "n_y", percent)
    return x, y, near & reduce(and_, (F.col(f"{p}_x") != F.col(f"{q}_y") for p in before for q in before))


def across(index: DataFrame, by: list[str], percent: int, bitmaps: DataFrame) -> DataFrame:
    """Pairs of members of one entry that lie in different components and can be linked.

    Pairs whose bitmaps (id, bits) differ in too many bits for a link never leave the join.
    """
    words = [f"w{i}" for i in range(WORDS)]
    x, y, near = _meetings(index, by, bitmaps, [F.col("bits")[i].alias(w) for i, w in enumerate(words)], percent)
    differ = reduce(add, (F.bit_count(F.col(f"{w}_x").bitwiseXOR(F.col(f"{w}_y"))) for w in words))
    near = near & (differ * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent))
    return x.join(y.hint("merge"), near).select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()


def split(index: DataFrame, by: list[str], store: Durable) -> DataFrame:
    """Index rows of entries with members in two components or more, with the entry's number of members (df)."""
    held = index.groupBy(*by).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("df")).filter("low <> high").select(*by, "df")
    return index.join(store.small(held, "split"), by)


def labelled(index: DataFrame, labels: DataFrame) -> DataFrame:
    """The index with each set's component, itself where it has no link."""
    index = index.drop("component", "df")
    return index.join(small(labels), index["id"] == labels["node"], "left").withColumn("component", F.coalesce("component", "id")).drop("node")
