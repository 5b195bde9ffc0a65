"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

1. Every text becomes the set of its word shingles; texts with equal sets are one *node* (exact copies need no
   comparison).  A node's one-permutation sketch, densified optimally, is cut into bands; nodes with an equal
   band share a bucket.
2. Star rounds.  In a bucket, every node is paired with one hub (drawn by hash, so that each of a node's buckets
   may have another), never with all others.  Pairs are confirmed on the full sets; links give components.
   The second round draws stars only in buckets whose nodes still lie in different components.
3. Sweep.  Nodes in buckets that still hold several components are compared across components wherever they
   could link.  Their shingles get one common order, rare cells first; two sets of the wanted similarity must
   share one of their first shingles, at positions that leave room for the overlap, and their bitmaps can't differ
   in more bits than the sets may in shingles.  Both rules are exact.  A passage that very many texts share comes
   last in the order, so that it pairs nobody; a crowd of texts just below the similarity fails by its bitmaps.

Two texts at similarity 0.8 share none of the default 32 bands of 4 rows with a probability of 5 in 10^8.

Defined results: null, empty or wordless texts have an empty set, link with nothing and are their own
component; fewer words than a shingle: the whole sequence is the one shingle; repeated rows and rows that share
an id are one document; null ids are kept and belong to the null component unless an equal text has an id;
an empty table gives an empty result; extra columns are ignored by ``classes`` and kept by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytebpe import slices
from .common import arrow_batches, spool, unspool, words_of
from .components import components
from .shingles import Hasher, Sketcher


def sketches(docs: DataFrame, *, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the whole set; null if empty), bands."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        hasher, sketcher = Hasher(width), Sketcher(bands, rows)
        for b in slices(batches):
            sizes, keys, found = [], [], []
            for text in b.column("text").to_pylist():
                s = hasher.set_of(text)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    found.append(sketcher.band_keys(s))
            offsets = np.concatenate([[0], np.cumsum([bands * (n > 0) for n in sizes])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def sets(docs: DataFrame, width: int) -> DataFrame:
    """node, hashes: the full set of each given document."""

    def run(batches):
        hasher = Hasher(width)
        for b in slices(batches):
            found = [hasher.set_of(t) for t in b.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["node", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "node long, hashes array<long>")


def cell_counts(docs: DataFrame, width: int, cells: int) -> np.ndarray:
    """How many shingles of the given documents' sets fall in each of ``cells`` cells (a power of two; the table's size is fixed)."""
    shift = np.uint64(64 - (cells - 1).bit_length())

    def run(batches):
        hasher, seen = Hasher(width), np.zeros(cells, np.int64)
        for b in slices(batches):
            for_batch = [hasher.set_of(t) for t in b.column("text").to_pylist()]
            seen += np.bincount((np.concatenate(for_batch) >> shift).astype(np.int64), minlength=cells)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    table = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out


def parity_bits(s: np.ndarray) -> np.ndarray:
    """A set's bitmap of 64 to 4096 bits, two a shingle: whether an odd number of shingles falls on each bit.

    Where two bitmaps differ, the sets hold different shingles: the differing bits never outnumber those.
    """
    size = 1 << min(max((2 * len(s) - 1).bit_length(), 6), 12)
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefixes(docs: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """node, size, bits, prefix: the first shingles of each document's set in the common order, as many as a similar set can't all lack."""
    shift = np.uint64(64 - (len(counts) - 1).bit_length())

    def ragged(parts: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)))

    def run(batches):
        hasher = Hasher(width)
        for b in slices(batches):
            sizes, bits, found = [], [], []
            for text in b.column("text").to_pylist():
                s = hasher.set_of(text)
                sizes.append(len(s))
                bits.append(parity_bits(s))
                order = np.lexsort((s, counts[(s >> shift).astype(np.int64)]))
                found.append(s[order[: len(s) - (percent * len(s) + 99) // 100 + 1]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), ragged(bits), ragged(found)], names=["node", "size", "bits", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "node long, size long, bits array<long>, prefix array<long>")


def _differing(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ; the longer one is folded to the other's length."""
    xor = lambda x, y: x.bitwiseXOR(y)
    words = F.least(F.size(a), F.size(b))
    folded = lambda c: F.when(F.size(c) == words, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), xor))
    return F.aggregate(F.zip_with(folded(a), folded(b), xor), F.lit(0), lambda n, x: n + F.bit_count(x))


def _across(docs: DataFrame, swept: DataFrame, width: int, percent: int, cells: int) -> DataFrame:
    """Pairs (a, b) of nodes in ``swept`` (node, component) that lie in different components and may be similar; none that is similar is left out.

    The conditions are the join's own, so that a crowd of texts below the similarity is compared but not written out.
    """
    texts = docs.join(swept.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    held = spool(prefixes(texts, width, percent, cell_counts(texts, width, cells)).join(swept, "node"), "prefixes")
    rows = held.select("node", "size", "component", "bits", F.posexplode("prefix").alias("at", "key"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rows = spool(rows.join(mixed, "key", "left_semi").select("node", "size", "component", "bits", "at", "key"), "inside")
    unspool(held)
    other = rows.toDF("other", "other_size", "other_component", "other_bits", "other_at", "key")
    # At the first shared shingle, what follows in either set must hold the overlap that the similarity takes.
    room = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at")) * (100 + percent) >= percent * (F.col("size") + F.col("other_size"))
    # What differs between two sets of the similarity is bounded; sizes that fit are at most a fold apart.
    fits = 100 * F.least("size", "other_size") >= percent * F.greatest("size", "other_size")
    alike = _differing("bits", "other_bits") * (100 + percent) <= (100 - percent) * (F.col("size") + F.col("other_size"))
    different = (F.col("node") < F.col("other")) & (F.col("component") != F.col("other_component"))
    pairs = spool(rows.join(other, "key").where(different & room & fits & alike).select(*_ordered("node", "other")).distinct(), "pairs")
    unspool(rows)
    return pairs


def _confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, written to the shared folder."""
    wanted = spool(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    full = spool(sets(docs.join(wanted, "doc_id", "left_semi"), width), "sets")
    both = pairs.join(full.toDF("b", "right"), "b").join(full.toDF("a", "left"), "a")
    shared = F.size(F.array_intersect("left", "right"))
    out = spool(both.where(100 * shared >= percent * (F.size("left") + F.size("right") - shared)).select("a", "b"), "confirmed")
    unspool(wanted, full)
    return out


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _ties(named: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of rows that share an id (doc_id, node in ``named``)."""
    mixed = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("doc_id is not null and a < high").select("doc_id", "a")
    return spool(named.join(mixed, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct(), "ties")


def links_of_nodes(docs: DataFrame, nodes: DataFrame, ties: DataFrame, *, width: int, percent: int, first_bands: int, cells: int) -> DataFrame | None:
    """node, component of all nodes that have a link (node, size, bands in ``nodes``), ``ties`` among them; null if there is none."""
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  sets of other sizes can't be so similar
    found = ties if ties.limit(1).count() else None
    known = components(found) if found is not None else spool(nodes.select("node", F.col("node").alias("component")).limit(0), "components")
    # Buckets of one node, which are most, are left out once for all stages.
    banded = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    shared = spool(banded.join(shared, "key", "left_semi").select("node", "size", "band", "key"), "shared")
    for stage in ("first", "stars", "sweep"):
        inside = shared.where(F.col("band") < first_bands) if stage == "first" else shared
        inside = spool(inside.join(known, "node", "left").select("node", "size", F.coalesce("component", "node").alias("component"), "key"), "placed")
        draw = F.xxhash64("node", "key")
        buckets = inside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("node", draw).alias("hub"), F.min_by("size", draw).alias("hub_size"), F.min_by("component", draw).alias("hub_component"))
        buckets = spool(buckets.where("low < high").drop("low", "high"), "buckets")
        if stage == "sweep":
            swept = spool(inside.join(buckets.select("key"), "key", "left_semi").select("node", "component").distinct(), "swept")
            pairs = _across(docs, swept, width, percent, cells)
            unspool(swept)
        else:
            pairs = inside.join(buckets, "key").where((F.col("component") != F.col("hub_component")) & fits("size", "hub_size")).select(*_ordered("node", "hub"))
            pairs = spool(pairs.distinct(), "pairs")
        unspool(inside, buckets)
        if pairs.limit(1).count():
            new = _confirmed(docs, pairs, width, percent)
            if new.limit(1).count():
                found, last = new if found is None else found.unionAll(new), known
                known = components(found)
                unspool(last)
        unspool(pairs)
    unspool(shared)
    return known if found is not None else None


def classes(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, first_bands: int = 8, cells: int = 1 << 18) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Links join documents whose sets have 100 * intersection >= ``percent`` * union; ``component_id`` is the
    smallest id that a document reaches, ``kept`` marks the document with that id.
    """
    every = spool(sketches(docs, width=width, bands=bands, rows=rows), "sketches")
    equal = spool(every.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("node")), "equal-sets")
    named = every.join(equal, "set_key", "left")
    nodes = spool(named.where(F.col("doc_id") == F.col("node")).select("node", F.col("n_shingles").alias("size"), "bands").dropDuplicates(["node", "bands"]), "nodes")
    out = spool(named.select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")), "named")
    unspool(every, equal)
    # Rows that share an id are one document: their nodes are tied together whatever their texts.
    known = links_of_nodes(docs, nodes, _ties(out.select("doc_id", "node")), width=width, percent=percent, first_bands=first_bands, cells=cells)
    unspool(nodes)
    if known is not None:
        out = out.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        out = out.withColumn("component", F.col("node"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """One row of each document that has the smallest id of its component, and every row without an id.

    Of the rows that share an id, one that has words is kept, the first as JSON.
    """
    names = [F.col(f"`{n}`") for n in docs.columns]
    gone = spool(classes(docs, **how).where("not kept").select("doc_id").distinct(), "duplicates")
    left = docs.join(gone, "doc_id", "left_anti").select(*names)
    repeated = spool(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return left
    row = F.struct(*names)
    wordless = F.size(words_of(F.col("text"))) == 0
    one = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(wordless, F.to_json(row))).alias("row"))
    return left.join(repeated, "doc_id", "left_anti").select(*names).unionAll(one.select("row.*"))
