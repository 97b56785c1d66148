"""Substring dedup: paragraphs joined by MinHash bands, verified, clustered and removed.

Words are lower-cased runs of bytes other than ASCII white space.  Paragraphs are
of two kinds, as a copied passage may fill whole lines or stand inside of one:

* lines, runs of neighbouring lines of fewer than ``min_line`` words each (a wrapped
  paragraph) and, in texts with blank lines, the blocks between them, all of at least
  ``MIN_INDEX`` words, which is one shingle.  What a document shares with one first
  document goes if neighbouring ones reach ``min_line`` words;
* runs between content-defined anchors, which lie where a 5-word shingle's hash is the
  least of a window of ``WINDOW`` shingles.  A run goes from an anchor to the first
  one at least ``RUN`` words on.  Anchors inside a passage are at most ``WINDOW`` words
  apart and depend only on the words around them, so any passage of
  2 * WINDOW + RUN + 3 = 51 words holds a whole run, wherever it stands.

MinHash values of the shingles give bands: lines have ``BANDS`` bands of ``ROWS``
values, which meet at a similarity of 0.8 with probability 0.998; runs, which overlap,
so that a passage has several of them, have one band of ``RUN_ROWS``.  Paragraphs that
meet in a band are candidates, and each is verified.  Those of the same words are one
paragraph: a 64-bit hash of all words in order and the independent 64-bit key of a
MinHash band must both be equal (unlike paragraphs of one hash are left alone).  Of
lines of other words each pair that could join two components is verified by the exact
Jaccard similarity of the shingle sets, which must reach ``percent``.  Runs must be
of the same words: an edited passage is found by its runs between the edits.

Clusters are the components of verified links, and the paragraphs of the same words
without one.  A cluster in two documents or more repeats; it is kept in its first
document (least doc_id, null last, then least hash of the row) and removed from
the others.  Overlapping repeating runs make a passage, which is grown word by word
to both sides as far as the first document has the same words there; passages of
fewer than ``min_passage`` words are left alone, so a short common line alone is no finding.

A document is a row; rows equal in doc_id and text count as one.  Null, empty and
short texts have no paragraphs; very long ones are read whole.  An empty table gives
an empty result; columns other than doc_id and text play no part and come back as
they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.runtime import Durable, fresh, map_batches, ship, small
from tidemark.llm.similarity import WORDS, across, bitmap, labelled, split, star, verified

PERCENT = 80
#: The chance that a pair of similarity s collides is 1 - (1 - s ** ROWS) ** BANDS for lines, s ** RUN_ROWS for each of a passage's runs.
ROWS, BANDS, RUN_ROWS = 2, 6, 4
MIN_INDEX, MIN_LINE, MIN_PASSAGE, WINDOW, RUN = 5, 25, 28, 12, 24
_RUN, _LINE = 0, 1
#: Words between the end of a copied passage and the runs inside, at most.
BEFORE, AFTER = WINDOW - 1, 2 * WINDOW + 4
_seeds = np.random.Generator(np.random.PCG64(10)).integers(1, 1 << 62, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _who(identified: bool) -> Column:
    """What tells documents apart: doc_id where it can, else a hash of the row."""
    return (F.col("doc_id").cast("long") if identified else F.xxhash64("doc_id", "text")).alias("who")


def anchors(total: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sorted word offsets of the least shingle of each window inside a text."""
    if len(total) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(total, window)
    at = np.arange(len(view))
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + window + 4 <= offsets[np.minimum(text + 1, len(offsets) - 1)]
    found = np.zeros(len(total), bool)
    for begin in range(0, len(view), 1 << 18):  # a bounded number of rows at a time
        rows = slice(begin, begin + (1 << 18))
        found[(at[rows] + view[rows].argmin(axis=1))[inside[rows]]] = True
    return np.flatnonzero(found)


_BASE = 0xD6E8FEB86659FD93
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _hash_spans(word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words of each span; spans may overlap."""
    from tidemark.llm import text

    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(len(word), _BASE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power)])
    shift = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(word), _INVERSE, np.uint64))])
    return text.mix((total[ends] - total[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


def _least(value: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least value of each span (none empty)."""
    return np.minimum.reduceat(np.append(value, np.uint64(0)), np.stack([starts, ends], 1).reshape(-1))[::2]


def _runs(cuts: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the runs from each anchor to the first one at least RUN words on, or to the text's end after as many."""
    edges = np.unique(np.concatenate([cuts, offsets]))
    starts = cuts[cuts < n]
    to = np.searchsorted(edges, starts + RUN)
    end_of_text = offsets[np.minimum(np.searchsorted(offsets, starts, "right"), len(offsets) - 1)]
    fits = to < len(edges)
    ends = np.where(fits, edges[np.minimum(to, len(edges) - 1)], n + 1)
    fits &= ends <= end_of_text
    return starts[fits], ends[fits]


def _paragraphs(word: np.ndarray, offsets: np.ndarray, lines: np.ndarray, blocks: np.ndarray, min_line: int = MIN_LINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, ends and digests of the lines, of runs of short lines and of blocks between blank lines."""
    begins = lines[lines < len(word)]
    if not len(begins):
        return begins, begins, np.zeros(0, np.uint64)
    fresh = np.isin(begins, blocks)
    long = np.append(begins[1:], len(word)) - begins >= min_line
    head = fresh | long
    head[1:] |= long[:-1]
    found = []
    for first in (np.ones(len(begins), bool), head, fresh):
        starts = begins[first]
        ends = np.append(starts[1:], len(word))
        found.append((starts, ends, _hash_spans(word, starts, ends)))
    starts, ends, _ = found[2]
    parted = ~(np.isin(starts, offsets) & np.isin(ends, offsets))  # a text without blank lines is no block
    found[2] = tuple(x[parted] for x in found[2])
    starts, ends, digest = (np.concatenate(x) for x in zip(*found, strict=True))
    _, at = np.unique(np.stack([starts, ends], 1), axis=0, return_index=True)
    at = at[(ends - starts)[at] >= MIN_INDEX]
    return starts[at], ends[at], digest[at]


def _bands(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The keys of each paragraph's bands (all of at least 5 words)."""
    from tidemark.llm import text

    out = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands if len(starts) else 0):
        for row in range(rows):
            out[:, band] = text.mix(out[:, band] + _least(total * _seeds[band * rows + row], starts, ends - text.WIDTH + 1))
        out[:, band] += np.uint64(band)
    return out


def _units(documents: DataFrame, min_line: int) -> DataFrame:
    """The paragraphs: who, kind, first word, number of words, digest, band (a run's, or a line's first one) and the bands of lines."""
    from tidemark.llm import text

    ship(documents.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                rows = part.slice(at, 500)
                word, offsets, lines, blocks = text.words_and_blocks(rows.column("text"))
                if not len(word):
                    continue
                total = text.windows(word)
                start, stop, digest = _paragraphs(word, offsets, lines, blocks, min_line)
                keys = _bands(total, start, stop, BANDS, ROWS)
                run, end = _runs(np.unique(np.concatenate([anchors(total, offsets), offsets[:-1]])), offsets, len(word))
                band = np.concatenate([keys[:, 0], _bands(total, run, end, 1, RUN_ROWS)[:, 0]])
                digest = np.concatenate([digest, _hash_spans(word, run, end)])
                kind = np.repeat(np.array([_LINE, _RUN], np.int8), [len(start), len(run)])
                places = np.concatenate([np.arange(len(start) + 1, dtype=np.int32) * BANDS, np.full(len(run), len(start) * BANDS, np.int32)])
                start, stop = np.concatenate([start, run]), np.concatenate([stop, end])
                own = np.searchsorted(offsets, start, "right") - 1
                columns = [rows.column("who").take(pa.array(own)), pa.array(kind), pa.array((start - offsets[own]).astype(np.int32)), pa.array((stop - start).astype(np.int32)), pa.array(digest.view(np.int64)), pa.array(band.view(np.int64))]
                columns.append(pa.ListArray.from_arrays(pa.array(places), pa.array(keys.view(np.int64).reshape(-1))))
                yield pa.RecordBatch.from_arrays(columns, ["who", "kind", "start", "n", "digest", "band", "bands"])

    return documents.select("who", "text").mapInArrow(batches, "who long, kind byte, start int, n int, digest long, band long, bands array<long>")


def _sets(documents: DataFrame, held: DataFrame, min_line: int) -> DataFrame:
    """id (digest), n, distinct shingles and their bitmap of each held paragraph (digest, who), read from its holder."""
    from tidemark.llm import text

    ship(documents.sparkSession)
    lists = held.groupBy("who").agg(F.collect_list("digest").alias("digests"))
    rows = documents.select("who", "text").join(small(lists, lists="digests"), "who").select("text", "digests")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1000):
                rows = part.slice(at, 1000)
                word, offsets, lines, blocks = text.words_and_blocks(rows.column("text"))
                start, stop, digest = _paragraphs(word, offsets, lines, blocks, min_line)
                wanted = rows.column("digests").flatten().to_numpy(zero_copy_only=False)
                digest = digest.view(np.int64)
                at_first = np.unique(digest, return_index=True)[1]
                some = at_first[np.isin(digest[at_first], wanted)]
                found = text.sets(word, text.windows(word), start[some], ends=stop[some])
                sizes = np.array([len(s) for s in found], np.int64)
                flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                maps = np.concatenate([bitmap(s) for s in found]) if found else np.zeros(0, np.int64)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * WORDS), pa.array(maps))
                yield pa.RecordBatch.from_arrays([pa.array(digest[some]), pa.array(sizes.astype(np.int32)), tokens, bits], ["id", "n", "tokens", "bits"])

    found = rows.mapInArrow(batches, "id long, n int, tokens array<long>, bits array<long>")
    # a holder's batch may show a paragraph that another holder was asked for
    return found.groupBy("id", "n").agg(F.first("tokens").alias("tokens"), F.first("bits").alias("bits"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "who")).alias("first")


def _one_each(units: DataFrame, *more: Column) -> DataFrame:
    """digest and least and last holder of the paragraphs of the same words."""
    one = units.groupBy("digest").agg(F.min("band").alias("band"), F.max("band").alias("other"), F.min("who").alias("who"), F.max("who").alias("last"), *more)
    return one.filter("band = other").drop("other", "band")  # else unlike paragraphs of one hash


def _clusters(documents: DataFrame, lines: DataFrame, store: Durable, percent: int, min_line: int) -> DataFrame:
    """digest and cluster of the lines that are linked to one of other words or stand in two documents."""
    one = store.write(_one_each(lines, F.first("bands").alias("bands")), "distinct")
    index = one.select("digest", F.explode("bands").alias("band"))
    met = index.groupBy("band").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("band")
    index = store.write(index.join(store.small(met, "met"), "band", "left_semi").select("digest", "band"), "collisions")
    held = one.join(store.small(index.select("digest").distinct(), "colliding"), "digest", "left_semi").select("digest", "who")
    sets = store.write(_sets(documents, store.write(held, "held"), min_line), "sets")
    index = store.write(index.select(F.col("digest").alias("id"), "band").join(sets.select("id", "n").hint("merge"), "id"), "index")
    links = store.write(verified(star(index, ["band"], percent, store), sets, percent), "links")
    rest = store.write(split(labelled(index, components(links, store)), ["band"], store), "rest")
    store.drop(index)
    links = store.write(links.union(verified(across(rest, ["band"], percent, sets), sets, percent)), "links")
    store.drop(sets)
    store.drop(rest)
    linked = small(components(links, store)).select(F.col("node").alias("digest"), F.col("component").alias("cluster"))
    alone = one.filter("who <> last").join(linked.select("digest"), "digest", "left_anti")
    out = store.small(linked.union(alone.select("digest", F.col("digest").alias("cluster"))), "clusters")
    store.drop(one)
    return out


def _surroundings(documents: DataFrame, places: DataFrame) -> DataFrame:
    """who, at, after and the hashes of the words next to each place, the nearest first."""
    from tidemark.llm import text

    ship(documents.sparkSession)
    lists = places.groupBy("who").agg(F.collect_set(F.struct("at", "after")).alias("places"))
    # Rows that are equal in doc_id and text have one who: their places are told once too often.
    rows = documents.select("who", "text").join(small(lists, lists="places"), "who")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first in range(0, part.num_rows, 1000):
                rows = part.slice(first, 1000)
                word, offsets = text.words(rows.column("text"), lower=True)
                own = rows.column("places").value_lengths().to_numpy(zero_copy_only=False)
                own = np.repeat(np.arange(len(own)), own)
                flat = rows.column("places").flatten()
                at, after = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("after").to_numpy(zero_copy_only=False)
                n = np.where(after, np.minimum(offsets[own + 1] - offsets[own] - at, AFTER), np.minimum(at, BEFORE))
                ends = np.concatenate([[0], np.cumsum(n)])
                step = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
                begin = np.repeat(offsets[own] + at, n)
                words = word[np.where(np.repeat(after, n), begin + step, begin - 1 - step)].view(np.int64)
                columns = [rows.column("who").take(pa.array(own)), flat.field("at"), flat.field("after"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words))]
                yield pa.RecordBatch.from_arrays(columns, ["who", "at", "after", "words"])

    return rows.mapInArrow(batches, "who long, at int, after boolean, words array<long>")


def _grown(documents: DataFrame, again: DataFrame, parts: DataFrame, store: Durable) -> DataFrame:
    """The parts with the words that stand next to them both in their document and in the one that keeps them.

    What is compared at an end is what surrounds the run there in the first document
    and in each other one; the first document's own part grows as far as any copy's.
    Contexts that are equal are compared once.
    """
    edges = F.explode(F.array(F.struct(F.col("left.digest").alias("digest"), F.lit(False).alias("after"), F.col("start").alias("at")), F.struct(F.col("right.digest").alias("digest"), F.lit(True).alias("after"), F.col("stop").alias("at"))))
    copies = store.write(parts.filter("removed").select("who", edges.alias("e")).select("e.digest", "e.after", "who", F.lit(True).alias("removed"), "e.at"), "edges")
    at = F.when(F.col("after"), F.col("start") + F.col("n")).otherwise(F.col("start")).alias("at")
    wanted = store.small(copies.select("digest", "after").distinct(), "wanted")
    kept = again.filter("not removed").join(wanted, "digest").select("digest", "after", "who", "removed", at)
    places = store.write(copies.unionByName(kept), "places")
    beside = _surroundings(documents, places.select("who", "at", "after")).dropDuplicates(["who", "at", "after"])
    beside = store.write(places.join(beside.hint("merge"), ["who", "at", "after"]).withColumn("context", F.xxhash64("words")), "beside")
    contexts = beside.groupBy("digest", "after", "removed", "context").agg(F.first("words").alias("words"))
    kept, copies = (contexts.filter(F.col("removed") == r).select("digest", "after", F.col("context").alias(f"context_{r}"), F.col("words").alias(f"words_{r}")) for r in (False, True))
    differ = F.array_position(F.zip_with("words_False", "words_True", lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(differ == 0, F.size("words_True")).otherwise(differ - 1).cast("int").alias("more")
    met = store.write(kept.join(copies.hint("merge"), ["digest", "after"]).select("digest", "after", "context_False", "context_True", common), "contexts")
    grow = [met.groupBy("digest", "after", F.col(f"context_{r}").alias("context")).agg(F.max("more").alias("more")).withColumn("removed", F.lit(r)) for r in (False, True)]
    more = beside.drop("words").join(grow[0].union(grow[1]).hint("merge"), ["digest", "after", "context", "removed"]).select("who", "digest", "at", "after", "more")
    more = store.write(more, "more")
    end = lambda side, after: more.filter(F.col("after") == after).select("who", F.col("digest").alias(f"{side}_digest"), F.col("at").alias(side), F.col("more").alias(f"more_{side}"))
    parts = parts.select("*", F.col("left.digest").alias("start_digest"), F.col("right.digest").alias("stop_digest"))
    parts = parts.join(end("start", False).hint("merge"), ["who", "start_digest", "start"], "left").join(end("stop", True).hint("merge"), ["who", "stop_digest", "stop"], "left")
    return parts.withColumn("start", F.col("start") - F.coalesce("more_start", F.lit(0))).withColumn("stop", F.col("stop") + F.coalesce("more_stop", F.lit(0)))


def _identified(documents: DataFrame) -> bool:
    """Whether doc_id tells all rows apart and is a number."""
    if documents.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return False
    n = documents.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    return n["rows"] == n["ids"]


def repeats(documents: DataFrame, percent: int = PERCENT, min_line: int = MIN_LINE, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """One row for each repeated passage or paragraph of a document: doc_id, who (doc_id or a hash of the row), kind, start and n (words), kept_in (the first document) and removed."""
    store = Durable(documents.sparkSession, "substring-dedup")
    identified = _identified(documents)
    documents = documents.select("doc_id", "text", _who(identified))
    known = documents.select("who", "doc_id").distinct()
    kind = documents.schema["doc_id"].dataType

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumn("doc_id", F.col("who").cast(kind)) if identified else rows.join(known.hint("merge"), "who")

    units = store.write(_units(documents, min_line), "units")
    # Of all runs only those go on that meet one of another document in their band.  Hot bands
    # are aggregated before their shuffle; what is aggregated is written first, so that the
    # joins are between plain shuffles, which AQE can split.
    runs = units.filter(F.col("kind") == _RUN).select("digest", "band", "who", (F.col("start").cast("long") * 64 + F.col("n")).alias("place"))
    met = store.write(runs.groupBy("band").agg(F.min("who").alias("low"), F.max("who").alias("high")).filter("low <> high").select("band"), "bands")
    again = store.write(runs.join(met.hint("merge"), "band", "left_semi"), "repeated")
    lines = store.write(units.filter(F.col("kind") == _LINE).drop("kind"), "lines")
    store.drop(units)
    clusters = _clusters(documents, lines, store, percent, min_line)
    near = store.write(named(lines.select("who", "start", "n", "digest").join(clusters, "digest")), "near-lines")
    store.drop(lines)
    first = near.groupBy("cluster").agg(_first(), F.min("who").alias("low"), F.max("who").alias("high")).filter("low <> high").select("cluster", "first")
    first = store.small(first, "first-lines")
    paragraphs = near.join(first, "cluster").withColumn("removed", F.col("who") != F.col("first.who"))
    # What a document shares with one first document must reach min_line words without a gap.
    beside = Window.partitionBy("who", "first").orderBy("start")
    reached = F.max(F.col("start") + F.col("n")).over(beside.rowsBetween(Window.unboundedPreceding, -1))
    paragraphs = paragraphs.withColumn("_b", F.coalesce(reached < F.col("start"), F.lit(True)).cast("int")).withColumn("run", F.sum("_b").over(beside))
    whole = Window.partitionBy("who", "first", "run")
    paragraphs = store.write(paragraphs.withColumn("words", F.max(F.col("start") + F.col("n")).over(whole) - F.min("start").over(whole)).drop("_b", "run"), "paragraphs")
    long = paragraphs.filter(F.col("removed") & (F.col("words") >= min_line))
    found = store.small(long.select("cluster").distinct(), "found")
    kept = paragraphs.filter(~F.col("removed")).join(found, "cluster", "left_semi")
    paragraphs = long.unionByName(kept).select("doc_id", "who", F.lit("paragraph").alias("kind"), "start", "n", F.col("first.doc_id").alias("kept_in"), "removed")

    same = store.small(_one_each(again).filter("who <> last").select("digest"), "same")
    again = named(again.join(same, "digest", "left_semi").select("digest", "who", F.shiftright("place", 6).cast("int").alias("start"), (F.col("place") % 64).cast("int").alias("n")))
    again = store.write(again, "equal")
    first = store.small(again.groupBy("digest").agg(_first()), "firsts")
    again = store.write(again.join(first, "digest").select("doc_id", "who", "start", "n", "digest", F.col("first.doc_id").alias("kept_in"), (F.col("who") != F.col("first.who")).alias("removed")).distinct(), "again")
    # What goes and what stays are parted: runs at a passage's edges may belong to clusters of their own.
    in_text = Window.partitionBy("who", "removed").orderBy("start")
    reached = F.max(F.col("start") + F.col("n")).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    rows = again.withColumn("_b", F.coalesce(reached <= F.col("start"), F.lit(True)).cast("int")).withColumn("part", F.sum("_b").over(in_text))
    stop = F.col("start") + F.col("n")
    parts = rows.groupBy("who", "removed", "part").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max(stop).alias("stop"), F.min("kept_in").alias("kept_in"), F.min(F.struct("start", "digest")).alias("left"), F.max(F.struct(stop.alias("stop"), "digest")).alias("right"))
    parts = _grown(documents, again, store.write(parts, "parts"), store)
    passages = parts.withColumn("n", (F.col("stop") - F.col("start")).cast("int")).filter(F.col("n") >= min_passage)
    return passages.select("doc_id", "who", F.lit("passage").alias("kind"), "start", "n", "kept_in", "removed").unionByName(paragraphs)


def without_repeats(documents: DataFrame, percent: int = PERCENT, min_line: int = MIN_LINE, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """The documents with their texts less what is removed; those that lose every word go.

    The white space after a removed word goes with it.
    """
    identified = _identified(documents)
    spans = fresh("_gone", documents)
    gone = repeats(documents, percent, min_line, min_passage).filter("removed").groupBy("who").agg(F.collect_set(F.struct("start", "n")).alias("spans")).alias("g")
    rows = documents.alias("r")
    who = F.col("r.doc_id").cast("long") if identified else F.xxhash64("r.doc_id", "r.text")
    both = rows.join(gone, who == F.col("g.who"), "left").select("r.*", F.col("g.spans").alias(spans))
    schema = documents.schema
    ship(documents.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, keep = part.column("text").to_pylist(), []
            for i, own in enumerate(part.column(spans).to_pylist()):
                if own:
                    texts[i] = cut(texts[i], [(s["start"], s["n"]) for s in own])
                keep.append(not own or bool(texts[i].strip(" \t\n\v\f\r")))
            names = [f.name for f in schema.fields]
            columns = [pa.array(texts, part.column("text").type) if c == "text" else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, batches, schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some runs of words (first word, number) and the white space after them."""
    import re

    at = np.array([m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)])
    out, begin = [], 0
    for start, n in sorted(spans):
        out.append(text[begin : max(begin, at[start])])
        begin = max(begin, at[min(start + n, len(at) - 1)])
    return "".join([*out, text[begin:]])
