"""Volumes that no partition table names: geometries that boot sectors propose, and what else speaks for them.

A boot sector may be a volume's first sector or the copy in its last one, so it proposes two volumes. A proposal is known
by all of its geometry; its votes are the boot sectors at both ends and the first records of the file table and of
its mirror, where the geometry puts them. All proposals of all sources are one grouped plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import file_records
from ..sources import extents
from . import intervals
from .store import materialize

#: What makes two proposals one.
GEOMETRY = ["volume_start", "sector_size", "cluster_size", "sectors", "mft_cluster", "mirror_cluster", "record_size", "index_size", "serial"]
CURRENT, DETACHED, UNCONFIRMED = "current", "detached", "boot_only_unconfirmed"
LARGEST_INDEX = 16 << 20
#: So that a volume's bytes are counted in 63 bits, whatever its sectors' size.
MOST_SECTORS = 1 << 50


def proposals(boots: DataFrame) -> DataFrame:
    """source_id, GEOMETRY, offset and role of what ``boots(source_id, offset, boot)`` propose; ``boot`` as ``structures.boot_sector`` gives it.

    Refused are boot sectors that are not structural, lie off their own sectors' grid or have no index geometry, and copies whose
    volume would begin before the source. A place that is told twice counts once.
    """
    b = boots.dropDuplicates(["source_id", "offset"]).select("source_id", "offset", "boot.*").where(f"state = 'structural' AND offset % sector_size = 0 AND sectors < {MOST_SECTORS}")
    b = b.withColumns({c: F.col(c).cast("long") for c in GEOMETRY[1:-1]})
    b = b.where((F.col("index_size") >= F.col("sector_size")) & (F.col("index_size") <= LARGEST_INDEX) & (F.col("index_size") % F.col("sector_size") == 0))
    back = F.col("offset") - (F.col("sectors") - 1) * F.col("sector_size")
    role = F.explode(F.array(F.struct(F.lit("primary").alias("role"), F.col("offset").alias("volume_start")), F.struct(F.lit("backup").alias("role"), back.alias("volume_start"))))
    return b.withColumn("r", role).select("source_id", "offset", "r.*", *GEOMETRY[1:]).where("volume_start >= 0")


def discovered(boots: DataFrame, records: DataFrame, sources: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """source_id, GEOMETRY, volume_end, votes, classification and strength of every proposed volume.

    ``records(source_id, offset, record, failure)`` are file records as ``records.file_records`` reads them, ``sources(source_id, size)``
    the sizes of the sources, ``current(source_id, GEOMETRY)`` the volumes that are known. A volume is detached if it lies whole within its source
    and either a record number 0 stands where the file table or its mirror begins, or both of its ends have the boot sector.
    """
    keys = ["source_id", *GEOMETRY]
    g = proposals(boots).groupBy(*keys).agg(
        F.count_if(F.col("role") == "primary").alias("primary_boots"), F.count_if(F.col("role") == "backup").alias("backup_boots"), F.countDistinct("offset").alias("boot_copies")
    )
    g = g.withColumn("volume_end", F.col("volume_start") + F.col("sectors") * F.col("sector_size"))
    first = records.where("record = 0 AND failure IS NULL").select("source_id", F.col("offset").alias("at")).distinct()
    for vote, cluster in (("mft_valid", "mft_cluster"), ("mirror_valid", "mirror_cluster")):
        at = F.col("volume_start") + F.col(cluster) * F.col("cluster_size")
        inside = F.col("at") + F.col("record_size") <= F.col("volume_end")
        g = g.withColumn("at", at).join(first.withColumn("there", F.lit(True)), ["source_id", "at"], "left").withColumn(vote, F.coalesce(F.col("there") & inside, F.lit(False))).drop("at", "there")
    pair = (F.col("primary_boots") > 0) & (F.col("backup_boots") > 0)
    g = g.join(sources.select("source_id", F.col("size").alias("_size")), "source_id", "left").withColumn("boot_pair", pair)
    if current is None:
        g = g.withColumn("_current", F.lit(False))
    else:
        g = g.join(current.select(*keys).distinct().withColumn("_current", F.lit(True)), keys, "left").withColumn("_current", F.coalesce("_current", F.lit(False)))
    told = F.col("mft_valid") | F.col("mirror_valid") | F.col("boot_pair")
    classification = F.when(F.col("_current"), CURRENT).when(told & F.coalesce(F.col("volume_end") <= F.col("_size"), F.lit(False)), DETACHED).otherwise(UNCONFIRMED)
    g = g.withColumn("classification", classification)
    strength = F.when(F.col("classification") == DETACHED, "detached_volume_structural").when(told, "geometry_correlated").otherwise("boot_structural")
    return g.select(*keys, "volume_end", "boot_copies", "boot_pair", "mft_valid", "mirror_valid", "classification", strength.alias("strength"))


def metadata(volumes: DataFrame, records: DataFrame, width: int = 1 << 30) -> DataFrame:
    """Every record of ``records(source_id, offset, record, sequence, allocated, extents, failure)`` that lies in a detached volume, with its layer.

    The extents of a volume's record 0 say where its file table lies. A record that stands there in the place of its number is
    ``detached_logical_mft``, one there in another's place ``detached_misplaced``, one elsewhere ``detached_stale_file``; one that can't be
    read keeps its failure. A volume without a readable record 0 has no table, and so stale records only. Records in several
    volumes have a row for each.
    """
    v = volumes.where(F.col("classification") == DETACHED).select("source_id", F.col("volume_start").alias("start"), F.col("volume_end").alias("end"), "cluster_size", "mft_cluster", "record_size")
    r = records.select("source_id", F.col("offset").alias("start"), (F.col("offset") + 1).alias("end"), "record", "sequence", "allocated", "extents", "failure")
    within = intervals.contained(r, v, ["source_id"], width, "inner").select(
        "p.source_id", F.col("e.start").alias("volume_start"), F.col("p.start").alias("offset"), "p.record", "p.sequence", "p.allocated", "p.extents", "p.failure", "e.cluster_size", "e.mft_cluster", "e.record_size"
    )
    at = F.col("volume_start") + F.col("mft_cluster") * F.col("cluster_size")
    table = within.where((F.col("offset") == at) & (F.col("record") == 0) & F.col("failure").isNull())
    table = table.select("source_id", "volume_start", "cluster_size", "record_size", F.explode("extents").alias("x"))
    size = F.col("x.length") * F.col("cluster_size")
    begin = F.col("volume_start") + F.col("x.cluster") * F.col("cluster_size")
    table = table.select("source_id", "volume_start", begin.alias("start"), (begin + size).alias("end"), (F.col("x.logical") * F.col("cluster_size")).alias("logical"))
    placed = within.select("source_id", "volume_start", F.col("offset").alias("start"), (F.col("offset") + F.col("record_size")).alias("end"))
    held = intervals.contained(placed, table, ["source_id", "volume_start"], width, "inner").select(
        "p.source_id", "p.volume_start", F.col("p.start").alias("offset"), (F.col("e.logical") + F.col("p.start") - F.col("e.start")).alias("logical")
    )
    # extents of one table don't overlap; where they do, the first counts
    held = held.groupBy("source_id", "volume_start", "offset").agg(F.min("logical").alias("logical"))
    out = within.join(held, ["source_id", "volume_start", "offset"], "left")
    own = F.col("logical") == F.col("record") * F.col("record_size")
    layer = F.when(F.col("logical").isNull(), "detached_stale_file").when(F.coalesce(own, F.lit(False)), "detached_logical_mft").otherwise("detached_misplaced")
    return out.select("source_id", "volume_start", "offset", "record", "sequence", "allocated", F.when(F.col("failure").isNull(), layer).alias("layer"), "failure")


TABLE = ["source_id", "volume_start"]


def file_table(volumes: DataFrame, first: DataFrame, blocks: DataFrame, size: int, width: int = 1 << 24) -> DataFrame:
    """source_id, volume_start, number and FILE_RECORDS of every record of the file tables of ``volumes``, read through the extents of their record 0.

    ``volumes(source_id, volume_start, cluster_size, mft_cluster, record_size)``, ``first(source_id, offset, record, extents, failure)`` holds the
    records 0 among others, ``blocks(source_id, block, data)`` the sources in blocks of ``size`` bytes. A record may lie in several extents. One that can't be
    read has the reader's reason, one that is no record its own, one that says another number ``record_number_mismatch``. A volume whose record 0 is not there has no rows.
    """
    at = F.col("volume_start") + F.col("mft_cluster") * F.col("cluster_size")
    zero = first.where("record = 0 AND failure IS NULL").select("source_id", F.col("offset").alias("_at"), "extents").dropDuplicates(["source_id", "_at"])
    v = volumes.select(*TABLE, "cluster_size", "record_size", at.alias("_at")).distinct().join(zero, ["source_id", "_at"])
    e = v.select(*TABLE, "cluster_size", "record_size", F.explode("extents").alias("x"))
    scaled = lambda c: F.col(f"x.{c}") * F.col("cluster_size")
    e = e.select(*TABLE, "record_size", scaled("logical").alias("logical"), (F.col("volume_start") + scaled("cluster")).alias("physical"), scaled("length").alias("length"))
    e = materialize(e, "table-extents")
    whole = e.groupBy(*TABLE).agg(F.max(F.col("logical") + F.col("length")).alias("_bytes"), F.first("record_size").alias("record_size"))
    numbers = whole.where(F.col("_bytes") >= F.col("record_size")).select(*TABLE, "record_size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_bytes") / F.col("record_size")) - 1)).alias("id"))
    ranges = numbers.select(*TABLE, "id", (F.col("id") * F.col("record_size")).alias("start"), ((F.col("id") + 1) * F.col("record_size")).alias("end"))
    wanted = extents.pieces(ranges, e, TABLE, width)
    # the reader's source is source_id; a range is told apart by volume, number and place
    got = extents.read_blocks(wanted, blocks, ["source_id"], ["volume_start", "id", "logical_start"], size)
    parts = got.groupBy(*TABLE, "id").agg(F.max("failure").alias("_unread"), F.array_sort(F.collect_list(F.struct("logical_start", F.hex("data").alias("h")))).alias("parts"))
    data = F.when(F.col("_unread").isNull(), F.unhex(F.array_join(F.transform("parts", lambda x: x["h"]), "")))
    blobs = materialize(parts.select(*TABLE, "id", "_unread", data.alias("data")), "table-records")
    name = F.concat_ws("\0", "source_id", F.col("volume_start").cast("string"))
    read = file_records(blobs.select(name.alias("source_id"), F.col("id").alias("offset"), "data"))
    read = read.withColumnsRenamed({"source_id": "_name", "offset": "id", "failure": "_refused"})
    out = blobs.select(*TABLE, "id", "_unread").withColumn("_name", name).join(read, ["_name", "id"])
    failure = F.coalesce("_unread", "_refused", F.when(F.col("record") != F.col("id"), "record_number_mismatch"))
    return out.withColumn("failure", failure).withColumnRenamed("id", "number").drop("_unread", "_refused", "_name")


def safe_prefix(table: DataFrame) -> DataFrame:
    """source_id, volume_start, records, valid and prefix of each file table: how many records there are, hold, and hold before the first that does not."""
    bad = F.col("failure").isNotNull()
    g = table.groupBy(*TABLE).agg(F.count("*").alias("records"), F.count_if(~bad).alias("valid"), F.min(F.when(bad, F.col("number"))).alias("_first"))
    return g.select(*TABLE, "records", "valid", F.coalesce("_first", "records").alias("prefix"))
