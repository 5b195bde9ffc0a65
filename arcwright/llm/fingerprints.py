"""Document fingerprints: one-permutation MinHash with packed low-order bits, in built-in expressions only.

The 64-bit hashes of a text's word shingles are dealt to ``BINS`` bins by their top bits, each bin keeps its
least hash, an empty bin copies the filled bin that comes first in a random order of its own (optimal
densification), and the low ``BITS`` bits of each bin are stored.  The likeness of two fingerprints is the share
of equal bins, corrected for those that agree by chance (one in 2^BITS).

Defined results: null texts are empty; texts without words have the empty fingerprint (likeness 1 to each
other, 0 to all else); fewer words than a shingle: all of them are one shingle; rows that share an id follow
each other by hash and text; null ids come last in descending order; a single document is its own successor;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of

BINS, BITS, WIDTH = 128, 8, 5
_SHIFT = 64 - (BINS - 1).bit_length()
_LEAST = -(1 << 63)
#: Bytes of text in a range of ids, about.
_RANGE_BYTES = 64 << 20


def with_bins(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: array<tinyint> of all bins' low bits; empty for a text without words."""
    word = lambda i, k: F.get(F.col("_w"), i + k)
    df = df.withColumn("_w", words_of(F.lower(F.col(text_col))))
    n = F.size("_w")
    starts = F.sequence(F.lit(0), n - WIDTH)
    hashes = F.when(n >= WIDTH, F.transform(starts, lambda i: F.xxhash64(*[word(i, k) for k in range(WIDTH)]))).when(n > 0, F.array(F.xxhash64(F.array_join("_w", " "))))
    df = df.withColumn("_h", F.sort_array(hashes)).drop("_w")
    bin_of = lambda x: F.shiftrightunsigned(x, _SHIFT)
    # Sorted, the hashes of a bin lie together and the least comes first.
    first = F.transform("_h", lambda x, i: F.when((i == 0) | (bin_of(x) != bin_of(F.get(F.col("_h"), i - 1))), x))
    df = df.withColumn("_m", F.filter(first, lambda x: x.isNotNull())).drop("_h")
    df = df.withColumn("_b", F.map_from_arrays(F.transform("_m", lambda x: bin_of(x).cast("int")), F.transform("_m", lambda x: (x.bitwiseAND((1 << BITS) - 1) - 128).cast("tinyint"))))
    df = df.withColumn("_f", F.map_keys("_b"))
    # The order of filled bins for an empty bin j is by a hash of (j, bin), the same for all texts.
    donor = lambda j: F.array_min(F.transform("_f", lambda p: F.struct(F.xxhash64(j, p).alias("o"), p.alias("p"))))["p"]
    value = lambda j: F.coalesce(F.try_element_at(F.col("_b"), j), F.try_element_at(F.col("_b"), donor(j)))
    bins = F.when(F.col("_m").isNotNull() & (F.size("_m") > 0), F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value))
    return df.withColumn(out, F.coalesce(bins, F.array().cast("array<tinyint>"))).drop("_m", "_b", "_f")


def spelt(bins: Column) -> Column:
    """The packed bits in hexadecimal."""
    return F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x.cast("int") + 128), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    chance = 1.0 / (1 << BITS)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / float(BINS)
    share = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def with_successor(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: of the row that follows in descending doc_id, the first for the last.

    Rows are dealt out by ranges of the id.  The first row of each range also goes to the range before it as a
    guest, so that every range can be ordered by itself; there are as many guests as ranges.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _RANGE_BYTES))
    rank = F.coalesce(F.col("doc_id"), F.lit(_LEAST))
    df = df.withColumn("_o", rank)
    ids = df.select("_o")
    at = sorted({int(x) for x in ids.approxQuantile("_o", [k / ranges for k in range(1, ranges)], 1 / (20 * ranges))}) if ranges > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in at]), lambda x: x <= F.col("_o"))) if at else F.lit(0)
    tops = sorted((r["_p"], r["top"]) for r in ids.groupBy(place.alias("_p")).agg(F.max("_o").alias("top")).collect())  # one row a range
    # The range that follows upwards needs this range's first row; the lowest needs the highest's.
    guests = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    receiver = F.lit(None).cast("int")
    if guests:
        receiver = F.try_element_at(F.create_map(*[F.lit(x).cast("long" if k % 2 == 0 else "int") for pair in guests for k, x in enumerate(pair)]), F.col("_o"))
    df = df.withColumn("_p", place).withColumn("_to", receiver)
    sent = F.array_compact(F.array(F.struct(F.col("_p").alias("p"), F.lit(0).alias("g")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("p"), F.lit(1).alias("g")))))
    dealt = df.withColumn("_s", F.explode(sent)).withColumn("_p", F.col("_s.p")).withColumn("_g", F.col("_s.g")).drop("_s", "_to")
    # A range is one partition: hashed, several could meet in one task while others had none.
    dealt = dealt.repartitionById(ranges, F.col("_p"))
    order = Window.partitionBy("_p").orderBy("_g", F.desc("_o"), F.xxhash64("text"), "text")
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where("_g = 0").drop("_p", "_g", "_o")


def _with_edited(df: DataFrame) -> DataFrame:
    """Adds n_chars and edited: the text whose last half of characters is the start of ``next_text``."""
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and the edited text of every document."""
    return _with_edited(with_successor(_texts(docs), ["text"])).select("doc_id", "n_chars", "edited")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    df = _with_edited(with_successor(with_bins(_texts(docs), "text", "bins"), ["text", "bins"]))
    df = with_bins(df.drop("text", "next_text").withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_bins")
    return df.select("doc_id", "n_chars", "edited_sha256", spelt(F.col("bins")).alias("fingerprint"), spelt(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
