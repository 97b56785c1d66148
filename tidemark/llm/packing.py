"""Packing into length buckets whose boundaries cost the least padding.

The length of a document is its number of words (runs of bytes other than ASCII
white space; null: 0), or any count that the caller gives as a column.  One
aggregation gives the global histogram of exact lengths.  Its m rows take more than
m * m / 2 words of text, so the driver holds a few million even for a corpus of
10 ** 13 words.  Dynamic programming over the lengths up to the token budget picks
the bucket boundaries with the least total padding.  Inside a bucket documents are
ordered by a hash and cut into batches of as many rows as fit the token budget at
the bucket's length.  A document longer than the budget is ``over_budget``: it is a
batch of its own at its own length, in a last bucket behind the others.

Every document is in exactly one batch, whole.  Empty and null texts have
length 0 and go to the first bucket.  Repeated rows take places of their own; an
empty table gives an empty one; columns other than doc_id, text and the one that
holds lengths play no part.  Places come from counts per bucket and hash slot; the
hash is of the row's number too, so equal rows don't share a slot, and no bucket is
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import Durable

BUCKETS, BUDGET, SLOTS = 8, 32_768, 4096


def words(text: Column) -> Column:
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    edge = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(F.size(parts) - edge).cast("long")


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The upper edges of at most so many buckets with the least total padding.

    With documents up to the j-th length in some buckets, the last of which starts
    after the i-th, the padded total is best[i] + edge[j] * (count[j] - count[i]): of
    the lines best[i] - count[i] * x the lowest at x = edge[j].  Slopes fall and x
    grows, so a hull of lines answers each layer in linear time, in whole numbers.
    """
    edges = sorted(histogram)
    m, count = len(edges), [0]
    for e in edges:
        count.append(count[-1] + histogram[e])
    best, back = [0] + [None] * m, []
    for _ in range(min(buckets, m)):
        new, chosen = [0] + [None] * m, [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, value, i), each the lowest for a range of x
        at = 0
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                line = (-count[i], best[i], i)
                # the last line goes if the new one passes below the line before it no later
                while len(hull) - at >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            x = edges[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if hull:
                slope, value, chosen[j] = hull[at]
                new[j] = slope * x + value + x * count[j]
        best = new
        back.append(chosen)
    out, j = [], m
    for chosen in reversed(back):
        if j == 0:
            break
        out.append(edges[j - 1])
        j = chosen[j]
    return sorted(set(out))


def lengths(documents: DataFrame, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, a hash of the row and its number, and the hash slot of each document."""
    n = words(F.col("text")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    out = documents.select("doc_id", n.alias("n_tokens"), F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("key"))
    return out.withColumn("vslot", F.pmod(F.col("key"), F.lit(SLOTS)).cast("int"))


def pack(documents: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, place in the batch, padding and over_budget of each document."""
    spark = documents.sparkSession
    rows = Durable(spark, "packing").write(lengths(documents, length), "lengths")
    histogram = rows.filter(F.col("n_tokens") <= budget).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    edges = boundaries({r.n_tokens: r.n for r in histogram.collect()}, buckets)
    bucket = F.lit(len(edges))  # what is over the budget
    for k in range(len(edges) - 1, -1, -1):
        bucket = F.when(F.col("n_tokens") <= edges[k], k).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket)
    of_slot = rows.groupBy("bucket", "vslot").agg(F.count(F.lit(1)).alias("n")).orderBy("bucket", "vslot").collect()  # buckets times slots at most
    per_batch = [budget // max(1, e) for e in edges] + [1]
    starts, in_bucket = [], [0] * (len(edges) + 1)
    for r in of_slot:
        starts.append((r.bucket, r.vslot, in_bucket[r.bucket]))
        in_bucket[r.bucket] += r.n
    first, at = [], 0
    for n, per in zip(in_bucket, per_batch, strict=True):
        first.append(at)
        at += -(-n // per)
    pick = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("bucket") + 1)
    placed = spark.createDataFrame(starts, "bucket int, vslot int, start long")
    rank = F.row_number().over(Window.partitionBy("bucket", "vslot").orderBy("key", "doc_id", "n_tokens"))
    out = rows.withColumn("_rank", rank).join(F.broadcast(placed), ["bucket", "vslot"])
    over = F.col("n_tokens") > budget
    out = out.withColumn("_at", F.col("start") + F.col("_rank") - 1).withColumn("_per", pick(per_batch, "long")).withColumn("bucket_tokens", F.when(over, F.col("n_tokens")).otherwise(pick([*edges, 0], "long")))
    return out.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", (pick(first, "long") + F.floor(F.col("_at") / F.col("_per"))).alias("batch"), (F.col("_at") % F.col("_per")).alias("place"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"), over.alias("over_budget"),
    )
