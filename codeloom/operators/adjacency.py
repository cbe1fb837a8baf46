"""Link tables prepared once, for walks that only read them.

A table holds the links of each source packed into rows, in buckets of the
source and sorted by it, so a step of a walk meets it without moving a link.
A source of very many links has several keys, its salts.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize

# Links packed into one row, and links of one source that may share a task.
LINKS_PER_ROW = 10_000
LINKS_PER_SALT = 250_000

# Salts are told apart above this bit of a key.
SALT_SHIFT = 40


def _table_name(at: str) -> str:
    return f"links_{hashlib.sha256(at.encode()).hexdigest()[:24]}"


def write_bucketed(df: DataFrame, at: str, keys: list[str], buckets: int | None = None, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` at a location in sorted buckets of ``keys``, one file a bucket, and read it back.

    With ``buckets`` the rows of a bucket are in one partition already.  To
    ``append`` is for buckets that have no rows yet.
    """
    if buckets:
        placed = df
    else:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    placed.write.format("parquet").mode(mode).option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).option("path", at).saveAsTable(_table_name(at))
    return df.sparkSession.table(_table_name(at))


def read_bucketed(spark: SparkSession, at: str, keys: list[str], buckets: int) -> DataFrame:
    """A bucketed table of this or of an earlier session; the catalog of a session has to be told of the latter."""
    name = _table_name(at)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{c}` {t}" for c, t in spark.read.parquet(at).dtypes)
        by = ", ".join(keys)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{at}'")
    return spark.table(name)


@dataclass
class Adjacency:
    """Links packed per source, in buckets.

    A frontier joins one row per source and unpacks the links afterwards.  A
    source with very many links is cut into rows of bounded size and spread
    over several salts; only frontier rows of such sources are repeated.  Where
    there is no such source the key is the source itself, and a frontier that
    is grouped by it meets the links where it is.
    """

    packed: DataFrame         # src (with the salt, if there are any), links array<struct<dst, payload>>
    fields: list[str]         # dst and payload
    salts: DataFrame          # src, salts of every source
    hot: DataFrame | None     # those of more than one salt

    def expand(self, frontier: DataFrame, everywhere: bool = False) -> DataFrame:
        """Join ``frontier`` (id, …) with the links of each id.

        ``everywhere`` says that the frontier may hold a good part of all
        sources, a bounded part of them in each bucket: it is hashed there.
        """
        carried = [c for c in frontier.columns if c != "id"]
        f = frontier.withColumnRenamed("id", "src")
        if self.hot is not None:
            f = f.join(self.hot, "src", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
            f = f.withColumn("src", _key(F.col("src"), F.col("salt"))).drop("salt")
        met = (f.hint("shuffle_hash") if everywhere else f).join(self.packed, "src")
        flat = met.select(*carried, F.explode("links").alias("l"))
        return flat.select(*carried, *[F.col(f"l.{c}").alias(c) for c in self.fields])


def _key(src: Column, salt: Column) -> Column:
    return F.when(salt == 0, src).otherwise(src + F.shiftleft(salt.cast("long"), SALT_SHIFT))


def pack(links: DataFrame, links_per_salt: int = LINKS_PER_SALT, links_per_row: int = LINKS_PER_ROW) -> tuple[DataFrame, DataFrame]:
    """Rows (src, links) and salts (src, salts) of ``links`` (src, dst, …) with unique (src, dst)."""
    entry = F.collect_list(F.struct(*[c for c in links.columns if c != "src"])).alias("links")  # ``links_per_row`` or so
    fan = materialize(links.groupBy("src").agg(F.count("*").alias("fan")).select(
        "src", F.ceil(F.col("fan") / links_per_row).cast("int").alias("rows"), F.ceil(F.col("fan") / links_per_salt).cast("int").alias("salts")))
    salts, wide = fan.select("src", "salts"), fan.where("rows > 1")
    if wide.isEmpty():
        return links.groupBy("src").agg(entry), salts
    cut = links.join(wide, "src", "left").withColumn("row", F.pmod(F.hash("dst"), F.coalesce("rows", F.lit(1))))
    cut = cut.withColumn("src", _key(F.col("src"), F.pmod("row", F.coalesce("salts", F.lit(1)))))
    return cut.groupBy("src", "row").agg(entry).drop("row"), salts


def adjacency(
    links: DataFrame, links_per_salt: int = LINKS_PER_SALT, links_per_row: int = LINKS_PER_ROW, at: str | None = None
) -> Adjacency:
    """Prepare ``links`` (src, dst, …) of numbers with unique (src, dst), kept at a location or in the shared folder."""
    at = at or f"{checkpoint_dir(links.sparkSession)}/links/{uuid.uuid4().hex}"
    packed, salts = pack(links, links_per_salt, links_per_row)
    return stored_adjacency(write_bucketed(packed, at, ["src"]), [c for c in links.columns if c != "src"], salts)


def stored_adjacency(packed: DataFrame, fields: list[str], salts: DataFrame) -> Adjacency:
    hot = salts.where("salts > 1")
    return Adjacency(packed, fields, salts, None if hot.isEmpty() else hot)
