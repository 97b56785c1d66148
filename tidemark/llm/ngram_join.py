"""Similarity join of documents on 5-word shingles, by token-combination prefixes.

Tokens are the distinct shingles of a text (see ``text.shingles``); documents
link when 100 * intersection >= percent * union.  Documents with equal token
sets form one class, and only class representatives are compared.

Candidates.  A set of n tokens that is linked to another one lacks at most
e = n - ceil(percent * n / 100) of its tokens there.  In any order of all tokens
that holds for the whole corpus (here: of their hashes) two linked sets share at
least k tokens among the first e + k of each.  So

1. a class stays live only while at least k(n) of its first e + k(n) tokens occur
   in other live classes; this drops most of a corpus by one narrow shuffle, and
   a longer extended prefix of the full sets drops most of the rest;
2. the first e + m + 1 tokens of the live classes are indexed, m being about an
   eighth of n: a rare token (at most ``RARE`` classes) by itself.  The frequent
   tokens fall by hash into m groups and are indexed in combinations of two from
   one group.  Two linked sets share m + 1 tokens there: a rare one among them, or
   two frequent ones of one group.  m depends on the power of two below n; as
   linked sets may have neighbouring powers, each set is indexed under its own m
   and the next.  So a set has about as many combinations as tokens;
3. first each index entry's members are verified against its least member only;
   what these links connect needs no further links for its component.  Tokens and
   combinations whose members all lie in one component go.  Then the members of
   what remains are verified across components, in two steps: pairs with rare
   tokens, then pairs with combinations of frequent tokens.

Pairs that the sets' parity bitmaps rule out (Sandes et al. 2017) never leave the
join that finds them.  Each verification compares the whole sets.  The components come from all
verified links; a link within a component that step 3 leaves out joins nothing.

Null, empty and white-space texts have no tokens and are components of their own; very
long texts are taken whole, as all their distinct shingles.
A null doc_id never names a component unless all its ids are null.  Repeated rows
get equal rows; an empty table gives an empty one; columns other than doc_id and text
play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.runtime import Durable, fresh, seen, ship, small
from tidemark.llm.similarity import WORDS, across, bitmap, in_length, labelled, split, verified

PERCENT, RARE = 80, 24
#: Bits by which the rows of live classes are told from others before their texts are read; 16 for each class, up to 4 MB.
MARKS = 1 << 25


def _missing(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n may lack in a set that it is linked to."""
    return n - (n * percent + 99) // 100


def _marked(live: DataFrame) -> np.ndarray:
    """Of each of at most ``MARKS`` bits whether the hash of some doc_id falls on it."""
    size = min(MARKS, max(1 << 16, 1 << (16 * seen(live)["n"]).bit_length()))
    marks = live.select(_mark(size).alias("mark")).groupBy(F.shiftright("mark", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(mark % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    return out.view(np.uint64)


def _mark(size: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(size).cast("long"))


def _scan(documents: DataFrame, percent: int, part: float, marked: np.ndarray | None = None) -> DataFrame:
    """Of each row: doc_id, class (digest of the token set), n and its first tokens; or of rows whose doc_id is ``marked`` all tokens and their bitmap."""
    from tidemark.llm import text

    ship(documents.sparkSession)
    full = marked is not None
    names = ["doc_id", "class", "n", "tokens"] + ["bits"] * full

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in parts:
            if full:  # before the texts are read
                mark = piece.column("mark").to_numpy().astype(np.uint64)
                piece = piece.filter(pa.array((marked[mark >> np.uint64(6)] >> (mark & np.uint64(63))) & np.uint64(1) == 1))
            for at in range(0, max(1, piece.num_rows), 1000):
                rows = piece.slice(at, 1000)
                sets = text.shingles(rows.column("text"))
                n = np.array([len(s) for s in sets], np.int64)
                digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
                ends = n if full else np.minimum(n, _missing(n, percent) + np.maximum(2, (n * part).astype(np.int64)))
                flat = np.concatenate([s[:e] for s, e in zip(sets, ends.tolist(), strict=True)]).view(np.int64) if sets else np.zeros(0, np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)), pa.array(flat))
                columns = [rows.column("doc_id"), digest, pa.array(n), tokens]
                if full:
                    maps = np.concatenate([bitmap(s) for s in sets]) if sets else np.zeros(0, np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * WORDS), pa.array(maps)))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    documents = documents.select("doc_id", "text", *([_mark(64 * len(marked)).alias("mark")] if full else []))
    return documents.mapInArrow(batches, f"doc_id {kind}, class binary, n long, tokens array<long>" + ", bits array<long>" * full)


def _k(n: Column, part: float) -> Column:
    """Tokens that two linked sets share at least in prefixes that are longer by as many."""
    return F.least(n, F.greatest(F.lit(2), F.floor(n * part).cast("long")))


def _errors(percent: int) -> Column:
    return F.expr(f"n - (n * {percent} + 99) div 100")


def _level() -> Column:
    """The power of two below n; at least half of n is in a set that n tokens are linked to."""
    return F.length(F.bin("n")) - 1


def _groups(level: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), level - 4))).cast("int")


def _combinations(index: DataFrame) -> DataFrame:
    """Index rows of pairs (t, u) of a set's tokens in one of its groups."""
    rows = index.withColumn("m", F.explode(F.array_distinct(F.array(_groups(_level()), _groups(_level() + 1)))))
    grouped = rows.groupBy("id", "n", "component", "m", F.pmod(F.xxhash64("token"), F.col("m")).alias("g")).agg(F.array_sort(F.collect_list("token")).alias("tokens")).filter(F.size("tokens") > 1)
    pair = F.flatten(F.transform("tokens", lambda x, i: F.transform(F.slice(F.col("tokens"), i + 2, F.size("tokens")), lambda y: F.struct(x.alias("t"), y.alias("u")))))
    # outer, as Spark else puts a filter before the generator that makes all pairs twice more; each group has one
    return grouped.select("id", "n", "component", F.explode_outer(pair).alias("pair")).select("id", "n", "component", "pair.t", "pair.u").distinct()


def _alive(rows: DataFrame, part: float, store: Durable) -> DataFrame:
    """The id of rows (id, n, tokens) of which enough of the tokens also occur in other rows.

    A token's rows are counted map-side first; the stored list of shared tokens makes
    both sides of the join plain shuffles, so a token of very many rows is split.
    """
    tokens = rows.select("id", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token")  # a row has a token once
    shared = store.write(shared, "shared")
    held = tokens.join(shared.hint("shuffle_hash"), "token", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("held"))
    return rows.select("id", "n").join(held.hint("merge"), "id").filter(F.col("held") >= _k(F.col("n"), part)).select("id")


def similar(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable by links, of each document."""
    if not 50 <= percent <= 100:
        raise ValueError(f"percent must be from 50 to 100: {percent}")
    spark = documents.sparkSession
    store = Durable(spark, "ngram-join")
    scanned = store.write(_scan(documents, percent, 0.05), "prefixes")
    classes = scanned.filter("n > 0").groupBy("class", "n").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
    classes = store.write(classes.select(F.monotonically_increasing_id().alias("id"), "class", "n", "doc_id", "tokens"), "classes")
    members = store.write(scanned.select("doc_id", "class", "n"), "members")
    store.drop(scanned)  # with the tokens of all rows
    live = store.write(classes.select("id", "class", "doc_id").join(_alive(classes, 0.05, store).hint("merge"), "id").select("class", "doc_id"), "live", n=F.count(F.lit(1)))
    store.drop(classes)
    # texts are never shuffled: nearly all rows of other classes go where they are read, the rest by their class
    full = _scan(documents, percent, 0.0, _marked(live)).join(small(live.select("class")), "class", "left_semi").groupBy("class", "n").agg(F.first("tokens").alias("tokens"), F.first("bits").alias("bits"))
    full = store.write(full.select(F.monotonically_increasing_id().alias("id"), "class", "n", "tokens", "bits"), "sets")
    some = F.slice("tokens", 1, (_errors(percent) + _k(F.col("n"), 0.3)).cast("int"))
    sets = store.write(full.join(_alive(full.select("id", "n", some.alias("tokens")), 0.3, store).hint("merge"), "id", "left_semi"), "live-sets")
    store.drop(full)
    prefix = F.slice("tokens", 1, (_errors(percent) + _groups(_level() + 1) + 1).cast("int"))
    index = sets.select("id", "n", F.explode(prefix).alias("token"))
    first = index.groupBy("token").agg(F.min(F.struct("id", "n")).alias("least"), F.count(F.lit(1)).alias("df")).filter("df > 1").select("token", "least", "df")
    index = store.write(index.join(store.small(first, "tokens"), "token").select("id", "n", "token", F.col("least.id").alias("least"), F.col("least.n").alias("least_n")), "index")
    star = index.filter("least <> id").filter(in_length("n", "least_n", percent)).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = store.write(verified(star, sets, percent), "links")
    labels = components(links, store)
    rest = store.write(split(labelled(index.select("id", "n", "token"), labels), ["token"], store), "rest")
    store.drop(index)
    single = rest.filter(F.col("df") <= RARE)
    links = store.write(links.union(verified(across(single, ["token"], percent, sets), sets, percent)), "links")
    labels = components(links, store)
    rest = store.write(split(labelled(rest.filter(F.col("df") > RARE), labels), ["token"], store), "rest")
    combos = store.write(_combinations(rest), "combinations")
    links = store.write(links.union(verified(across(split(combos, ["t", "u"], store), ["t", "u"], percent, sets), sets, percent)), "links")
    labels = components(links, store)
    joined = sets.select("id", "class").join(small(labels), F.col("id") == F.col("node")).select("class", "component")
    member = members.join(small(joined), "class", "left")
    group = F.when(F.col("component").isNotNull(), F.struct("component", F.lit(None).cast("binary").alias("class"))).otherwise(F.struct(F.lit(None).cast("long").alias("component"), "class"))
    member = member.select("doc_id", "n", F.when(F.col("n") > 0, group).alias("group"))
    least = member.filter("n > 0").groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    out = member.join(store.write(least, "groups"), "group", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that reach one with a lesser doc_id.

    Of rows that share a doc_id and a component all stay or go with that id; rows
    without tokens, and those of a null doc_id that no other row reaches, stay.
    """
    found = similar(documents, percent).filter((F.col("component_id") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("component_id").isNotNull()))
    name = fresh("_gone_id", documents)
    gone = Durable(documents.sparkSession, "ngram-join").small(found.select(F.col("doc_id").alias(name)).distinct(), "gone")
    return documents.join(gone, documents["doc_id"].eqNullSafe(gone[name]), "left_anti")
