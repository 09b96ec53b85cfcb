"""Exact deduplication by skew-safe combining (DataFrame functions only).

Equal means: the same text after lower-casing A-Z; a null text counts as empty. Digests are counted first. A bitmap of
those that recur goes to every task: a row whose bit is not set has a text of its own, which need not travel. The others
(all copies, and a few rows that share a bit by chance) go through three combining steps, each of which groups by the
digest AND the whole normalised text, so a digest collision can never merge different texts:

1. each task combines its own rows (the partial aggregate of step 2), one row per text and task;
2. the task winners meet by (digest, salt), the salt being the task's number, so a text that fills a third of the table
   is spread over ``salts`` reducers;
3. the salt winners, at most ``salts`` per text, meet by digest.

Groups of one need nothing more. The decisions of larger groups return to the rows by a salted join on the digest. What
travels for that has no texts: digests and ids. drop_exact() sends whole rows only where the bit of their digest is set,
once, to meet the ids that go.

Rows: an empty table gives an empty result. Ids may be null (smaller than all others) or repeated. Columns other than
the two named may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import ascii_lower, clean_text, stored

SALTS = 16
#: Bits of the bitmap for each digest that recurs, and bits at most (16 MB); a full one lets more rows travel, no fewer.
BITS, MOST_BITS = 32, 2**27
#: Bits in a row of the bitmap (fixed by Spark's bitmap functions).
ROW_BITS = 32_768


def _recurring(rows: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap in which the bit of every text that occurs more than once is set."""
    again = rows.groupBy("digest", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("check")
    again = stored(again, "recurring")
    size = min(max(ROW_BITS, 1 << (BITS * again.count()).bit_length()), MOST_BITS)
    at = F.pmod("check", F.lit(size))
    at = again.select(F.floor(at / ROW_BITS).cast("int").alias("bucket"), (at % ROW_BITS).alias("at"))
    bits = at.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    return stored(bits.withColumn("size", F.lit(size).cast("long")), "bitmap")


def _sorted_out(rows: DataFrame, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose text may occur elsewhere, and those whose text does not."""
    first = bitmap.first()
    if first is None:
        return rows.where(F.lit(False)), rows
    at = F.pmod("check", F.lit(first["size"]))
    own = F.broadcast(bitmap.drop("size"))  # bounded by MOST_BITS
    met = rows.withColumn("bucket", F.floor(at / ROW_BITS).cast("int")).join(own, "bucket", "left")
    at = (at % ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.floor(byte / F.pow(F.lit(2.0), at % 8)).cast("int") % 2 == 1, F.lit(False))
    return tuple(met.where(x).select(*rows.columns) for x in (may, ~may))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, check, keep_id, group_size) of texts that occur more than once.

    Rows find their group by digest and check (a second, independent hash), so texts need not travel again. Should two
    texts ever share both, the query fails instead of merging them.
    """
    local = rows.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("digest", "check", "salt", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    merged = (
        salted.repartition("digest")
        .groupBy("digest", "check", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    clash = F.raise_error(F.lit("two texts share a SHA-256 digest and a 64-bit hash")).cast("long")
    return (
        merged.groupBy("digest", "check")
        .agg(
            F.max("keep_id").alias("keep_id"),
            F.when(F.count(F.lit(1)) > 1, clash).otherwise(F.max("group_size")).alias("group_size"),
        )
        .filter("group_size > 1")
    )


def _digests(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, norm, digest and check of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), ascii_lower(clean_text(F.col(f"`{text_col}`"))).alias("norm"), *more)
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    return rows.withColumn("check", F.xxhash64("norm"))


def _salt(salts: int) -> Column:
    """Deals rows out by id and task, so that rows of one null or repeated id part too; the same when a task runs again."""
    return F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts)).cast("int")


def _at_every_salt(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, bitmap: DataFrame | None = None) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the largest doc_id of the group (null ids are smaller than all others; a group of null ids has keep_id
    null). kept is true where doc_id equals keep_id, null-safely, so repeated rows of the kept id are all marked; see
    drop_exact. bitmap: that of _recurring, if it is there already.
    """
    rows = _digests(docs, id_col, text_col)
    several, _ = _sorted_out(rows, _recurring(rows) if bitmap is None else bitmap)
    l = rows.withColumn("salt", _salt(salts)).drop("norm").alias("l")
    r = _at_every_salt(_winners(several, salts), salts).alias("r")
    joined = l.join(r, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("digest", "check", "salt")], "left")
    return joined.select(
        F.col("l.doc_id").alias("doc_id"),
        F.when(F.col("r.digest").isNull(), F.col("l.doc_id")).otherwise(F.col("r.keep_id")).alias("keep_id"),
        F.coalesce(F.col("r.group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("r.digest").isNull(), F.lit(True)).otherwise(F.col("l.doc_id").eqNullSafe(F.col("r.keep_id"))).alias("kept"),
        F.lower(F.hex("l.digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """docs with one row of each group of equal texts: that of the largest id, and one of its repeated rows.

    The groups are found without whole rows; what goes, and what is there several times, is few (id, digest) pairs. Rows
    whose text may recur are sent once, to meet those pairs. Repeated rows of a kept id, if any, meet among themselves.
    """
    bitmap = _recurring(_digests(docs, id_col, text_col))
    groups = exact_groups(docs, id_col, text_col, salts, bitmap).where("group_size > 1")
    pairs = groups.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias("again"))
    pairs = stored(pairs.where("again or not kept"), "exact")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows, alone = _sorted_out(_digests(docs, id_col, text_col, whole).drop("norm"), bitmap)
    rows = rows.select("row", "doc_id", F.lower(F.hex("digest")).alias("text_sha256"))
    l = rows.withColumn("salt", _salt(salts)).alias("l")

    def meeting(some: DataFrame, how: str) -> DataFrame:
        r = _at_every_salt(some.select("doc_id", "text_sha256"), salts).alias("r")
        same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
        return l.join(r, same & (F.col("l.text_sha256") == F.col("r.text_sha256")) & (F.col("l.salt") == F.col("r.salt")), how)

    out = alone.select("row.*").unionByName(meeting(pairs, "left_anti").select("row.*"))
    several = pairs.where("kept")
    if several.isEmpty():
        return out
    one = meeting(several, "left_semi").groupBy("doc_id", "text_sha256").agg(F.max_by("row", F.xxhash64("row")).alias("row"))
    return out.unionByName(one.select("row.*"))
