"""Line dedup by a tree of line templates of fixed depth.

Lines are the ``\\n``-split parts of a text; their tokens are runs of bytes other
than ASCII white space.  The tree has three kinds of levels: the token count,
then the first ``DEPTH`` tokens, where a token with a digit becomes the wildcard
``<*>``.  In a leaf a token stays constant at its position if lines of at least
``min_docs`` documents have it there (each distinct line counts its documents);
every other token is a variable field and becomes the wildcard.  A line's
template is its leaf with what stayed constant.  A template recurs if it stands
in at least ``min_docs`` documents and at least ``constant`` of its tokens are
constant.  Lines of recurring templates are dropped, but for those of the
template's first document (least doc_id, null last, then least hash of the row).

A document is a row; rows equal in doc_id and text count as one and fare alike.
Null and empty texts have no lines with tokens and lose nothing.  Lines without
tokens are never dropped.  Very long texts and lines are taken whole.  Columns other
than doc_id and text play no part and come back as they are, whatever their names; an
empty table gives an empty one.

All of it is aggregations and joins on hashes: lines go through shuffles as
numbers, and only lines of leaves that reach ``min_docs`` documents are ever
split into tokens.  Hot lines are pre-aggregated before each shuffle, and what lines
are joined with is stored first, so that a leaf of very many lines is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import Durable, fresh

DEPTH, MIN_DOCS, CONSTANT = 3, 6, 0.75
WILD = "<*>"
_WHITE = r"[\x20\x09\x0B-\x0D]+"


def _key(of: str = "") -> Column:
    return F.xxhash64(f"{of}doc_id", f"{of}text")


def _lines(documents: DataFrame) -> DataFrame:
    """Each line with a token: its document, place, token count, leaf, hash and normalised text."""
    # the key first: beside a generator it would be made again, from the whole text, for each line
    rows = documents.select("doc_id", _key().alias("key"), F.split(F.regexp_replace("text", _WHITE, " "), "\n").alias("lines"))
    # outer, as Spark else puts a filter before the generator that splits each text twice more
    rows = rows.select("doc_id", "key", F.posexplode_outer("lines").alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    rows = rows.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1)
    lead = F.substring_index("line", " ", DEPTH)
    # begins at tokens only and never goes back, so that a very long token costs its length once
    lead = F.when(lead.rlike("[0-9]"), F.regexp_replace(lead, r"(^| )[^ 0-9]*+[0-9][^ ]*+", f"$1{WILD}")).otherwise(lead)
    return rows.withColumn("leaf", F.xxhash64("n", lead)).withColumn("hash", F.xxhash64("line"))


def dropped(documents: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """doc_id, key (hash of the row's doc_id and text) and the places of its dropped lines, of each document that loses some."""
    store = Durable(documents.sparkSession, "line-dedup")
    documents = documents.select("doc_id", "text")
    lines = store.write(_lines(documents).drop("line"), "lines")
    held = lines.groupBy("leaf", "hash", "n", "key").agg(F.min("doc_id").alias("doc_id"))  # a document once for each distinct line
    of_line = store.write(held.groupBy("leaf", "hash", "n").agg(F.count(F.lit(1)).alias("docs")), "distinct-lines")
    in_leaf = of_line.groupBy("leaf").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    leaves = store.small(in_leaf.select("leaf"), "leaves")
    of_line = of_line.join(leaves, "leaf", "left_semi")
    texts = _lines(documents).select("leaf", "hash", "n", "line").join(leaves, "leaf", "left_semi")
    texts = texts.groupBy("hash").agg(F.first("line").alias("line"), F.first("leaf").alias("leaf"), F.first("n").alias("n"))
    tokens = texts.join(of_line.select("hash", "docs"), "hash").select("leaf", "hash", "n", "docs", F.posexplode_outer(F.split("line", " ")).alias("at", "token"))
    tokens = store.write(tokens.select("leaf", "hash", "n", "docs", "at", F.xxhash64("at", "token").alias("word")), "tokens")
    support = tokens.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("leaf", "word")
    kept = tokens.join(store.small(support, "support"), ["leaf", "word"], "left_semi")
    shapes = kept.groupBy("leaf", "hash", "n").agg(F.bit_xor("word").alias("template"), F.bit_xor(F.xxhash64("word", "at")).alias("shape"), F.count(F.lit(1)).alias("fixed"))
    shapes = store.small(shapes.filter(F.col("fixed") >= constant * F.col("n")).select("leaf", "hash", "template", "shape"), "shapes")
    of_template = held.join(shapes, ["leaf", "hash"]).groupBy("leaf", "template", "shape", "key").agg(F.min("doc_id").alias("doc_id"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    recurring = of_template.groupBy("leaf", "template", "shape").agg(F.count(F.lit(1)).alias("docs"), least).filter(F.col("docs") >= min_docs)
    recurring = store.small(recurring.select("leaf", "template", "shape", "first"), "recurring")
    verdict = shapes.join(recurring, ["leaf", "template", "shape"]).select("hash", "leaf", F.col("first.key").alias("first_key"))
    verdict = store.small(verdict, "templates")
    gone = lines.join(verdict, ["leaf", "hash"]).filter(F.col("key") != F.col("first_key"))
    return gone.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def line_dedup(documents: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """doc_id, n_lines, n_dropped and the places of the dropped lines (a string, comma-separated) of each document."""
    gone = dropped(documents, min_docs, constant)
    rows = documents.select("doc_id", _key().alias("key"), F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n_lines"))
    rows, gone = rows.alias("r"), gone.alias("g")
    out = rows.join(gone, (F.col("r.key") == F.col("g.key")) & F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    n = F.coalesce(F.size("dropped"), F.lit(0))
    return out.select("r.doc_id", "n_lines", F.when(F.col("dropped").isNull(), 0).otherwise(n).alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped_lines"))


def without_lines(documents: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """The documents with their texts less the dropped lines; those that lose every line with a token go."""
    gone = Durable(documents.sparkSession, "line-dedup").small(dropped(documents, min_docs, constant), "dropped", lists="dropped").alias("g")
    both = documents.alias("r").join(gone, (_key("r.") == F.col("g.key")) & F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    parts = F.split("r.text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("g.dropped"))
    text = F.when(F.col("g.dropped").isNull(), F.col("r.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(parts, i + 1)), "\n"))
    cut = fresh("_cut", documents)
    both = both.select(*(text.alias("text") if c == "text" else F.col(f"r.`{c}`") for c in documents.columns), F.col("g.dropped").isNotNull().alias(cut))
    return both.filter(~F.col(cut) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(cut)
