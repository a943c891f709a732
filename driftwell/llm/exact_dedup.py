"""Exact deduplication in two Bloom passes: rows that the filter clears pass straight through.

Pass 1 puts each text's hash into a filter of ``bits_per_row`` bits a row: ``hashes`` positions for each row, eight
bytes each, summed before and after a shuffle.  Positions that two rows set are packed into words; they are the
filter of pass 2.  A row one of whose positions was set once only is the only one with its hash and passes
straight through; only the others meet by their SHA-256.  The filter never decides that rows are equal, so its false
positives cost a little shuffle and change nothing.

The filter has as many bits as the table needs, in slices of at most ``slice_bits`` by hash.  A slice is a broadcast
of bounded size (32 MB as given) whatever the table's size, and meets the narrow rows of its slice alone, which are
stored by slice when there are several.  Members of a group come to their group's row by ``with_group``, so a group
that holds a third of all rows is not gathered either.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.  Of equal texts the row with the
largest id stays (a null id is smaller than any).  Rows that repeat both id and text all carry the same keep_id and
count in group_size; one of them has kept = true, the others false.  Very long texts are hashed whole; an empty
table gives no rows; ``exact_dedup`` keeps other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm._util import Scratch, ascii_lower, delete, shared_dir, stored, table, texts, with_group

SLICE_BITS = 1 << 27  # in words of 64 bits, each beside its 64-bit number


def text_hash(text: str = "text") -> Column:
    return F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)


class Filter:
    """Positions set at least twice by ``hashed``'s column ``sha``, as words of 64 bits in slices."""

    def __init__(self, hashed: DataFrame, bits_per_row: int = 16, hashes: int = 2, slice_bits: int = SLICE_BITS):
        if not 1 <= hashes <= 3:
            raise ValueError("a hash of 64 digits gives up to 3 positions and a slice")
        self.rows = hashed.count()
        size = max(64, self.rows * bits_per_row)
        self.slices = -(-size // slice_bits)
        self.size, self.hashes = -(-size // self.slices), hashes
        if self.slices > 1 << 16:
            raise ValueError("16 bits number the slices; use larger ones")
        self.words = stored(
            hashed.select(F.explode(F.array_distinct(F.array(*self._at()))).alias("bit"), self.slice().alias("slice"))
            .groupBy("slice", "bit")
            .agg(F.count("*").alias("n"))
            .filter("n > 1")
            .groupBy("slice", F.expr("bit div 64").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask")),
            "bloom",
        )

    def slice(self) -> Column:
        return (F.conv(F.substring("sha", 61, 4), 16, 10).cast("long") % self.slices).cast("int")

    def _at(self) -> list[Column]:
        """Positions within the slice: 15 hex digits of the hash for each."""
        return [F.conv(F.substring("sha", 1 + 15 * i, 15), 16, 10).cast("long") % self.size for i in range(self.hashes)]

    def marked(self, rows: DataFrame, one: int = 0) -> DataFrame:
        """``rows`` of slice ``one`` with a boolean ``maybe``: false only where no other row has this hash."""
        if self.slices > 1:
            rows = rows.filter(self.slice() == one)
        words = self.words.filter(F.col("slice") == one)
        out = rows.withColumn("maybe", F.lit(True))
        for i, bit in enumerate(self._at()):
            part = words.select(F.col("word").alias(f"_w{i}"), F.col("mask").alias(f"_m{i}"))
            out = out.withColumn(f"_b{i}", bit)
            # At most slice_bits / 64 words of 16 bytes.
            out = out.join(F.broadcast(part), F.expr(f"_b{i} div 64") == F.col(f"_w{i}"), "left")
            is_set = F.expr(f"coalesce(shiftrightunsigned(_m{i}, cast(_b{i} % 64 as int)) & 1L, 0L) = 1L")
            out = out.withColumn("maybe", F.col("maybe") & is_set).drop(f"_w{i}", f"_m{i}", f"_b{i}")
        return out


def by_slice(rows: DataFrame, bloom: Filter, part: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``part`` of the marked rows, slice by slice: several slices are dealt by a written table and come one at a time."""
    if bloom.slices == 1:
        return part(bloom.marked(rows))
    spark, schema = rows.sparkSession, part(bloom.marked(rows)).schema
    dealt, out = shared_dir(spark, "slices"), shared_dir(spark, "marked")
    rows.withColumn("_slice", bloom.slice()).write.partitionBy("_slice").option("compression", "zstd").parquet(dealt)
    for one in range(bloom.slices):
        held = spark.read.parquet(dealt).filter(F.col("_slice") == one).drop("_slice")
        part(bloom.marked(held, one)).write.mode("append").option("compression", "zstd").parquet(out)
    delete(spark, dealt)
    return spark.read.schema(schema).parquet(out)


def possibly_repeated(hashed: DataFrame, **options: int) -> tuple[DataFrame, Filter]:
    """The table ``hashed`` with ``maybe``, and the filter."""
    bloom = Filter(hashed, **options)
    return by_slice(hashed, bloom, lambda rows: rows), bloom


def _groups(marked: DataFrame, *more: Column) -> DataFrame:
    """Groups of two or more: sha, keeper (the largest id), group_size; partial sums before the shuffle."""
    found = marked.filter("maybe").groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), *more)
    return found.filter("group_size > 1")


def exact_groups(docs: DataFrame, **options: int) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    tmp = Scratch()
    # The number of a row tells apart rows that repeat both id and text; it is fixed by being written.
    hashed = tmp.keep(texts(docs).select("doc_id", text_hash().alias("sha"), F.monotonically_increasing_id().alias("row")), "hashes")
    marked, bloom = possibly_repeated(hashed, **options)
    keeper = F.max(F.struct("doc_id", "row")).alias("keeper")
    groups = tmp.keep(_groups(marked, keeper).select("sha", "keep_id", "group_size", F.col("keeper.row").alias("keep_row")), "groups")
    alone = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    rest = with_group(marked.filter("maybe").drop("maybe"), groups, "sha", "group_size", bloom.rows)
    single = F.col("group_size").isNull()
    rest = rest.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return alone.unionByName(rest)


def exact_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` without exact copies, all its columns kept; rows that cannot repeat are not shuffled.

    Groups are found on narrow rows of id and hash.  Then the table is read once more: rows that the filter clears
    and keepers of hot groups pass, the other possible repeats meet their group by hash.  Among rows that
    repeat both id and text one stays, chosen by a hash of the whole row.
    """
    tmp = Scratch()
    hashed = tmp.keep(texts(docs).select("doc_id", text_hash().alias("sha")), "hashes")
    marked, bloom = possibly_repeated(hashed, **options)
    counted = marked.filter("maybe").groupBy("sha", "doc_id").agg(F.count("*").alias("n"))
    groups = counted.groupBy("sha").agg(F.max(F.struct("doc_id", "n")).alias("keeper"), F.sum("n").alias("group_size")).filter("group_size > 1")
    groups = tmp.keep(groups.select("sha", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.n").alias("ties"), "group_size"), "groups")
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("sha"))
    repeated = not groups.filter("ties > 1").isEmpty()

    def part(rows: DataFrame) -> DataFrame:
        alone = rows.filter(~F.col("maybe")).select("row")
        kept = with_group(rows.filter("maybe"), groups, "sha", "group_size", bloom.rows)
        kept = kept.filter(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
        out = alone.unionByName(kept.filter("coalesce(ties, 1) = 1").select("row"))
        if repeated:
            several = kept.filter("ties > 1").groupBy("sha").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
            out = out.unionByName(several.select("row"))
        return out

    return by_slice(keyed, bloom, part).select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_OP3 = """
WITH h AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
"""
