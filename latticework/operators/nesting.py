"""Types unfolded into the paths of their fields, with marks where a type comes again or a bound is met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.sources.folders import checkpointed

#: How deep fields are unfolded.
DEPTH = 4


def unfolded(fields: DataFrame, by: list[str] = (), most: int = DEPTH, owner: str = "owner", name: str = "name", kind: str = "type") -> DataFrame:
    """(by, root, path, type, depth, state): the fields of every type, and those of the types of its fields, to a bounded depth.

    fields: (by, owner, name, type). `path` is the names of the fields from the root, with dots between. A field whose type has
    fields is `nested` and its fields follow, unless its type is the root's or one on the way (`recursive`), or it lies at the
    bound (`deep`); all others are `leaf`. Fields that repeat count once. The result grows with the number of fields to the power
    of the depth, as the paths themselves do.
    """
    by = list(by)
    f = fields.select(*by, F.col(owner).alias("owner"), F.col(name).alias("name"), F.col(kind).alias("type")).filter("owner IS NOT NULL AND name IS NOT NULL").distinct()
    f = checkpointed(f)
    known = f.select(*by, F.col("owner").alias("type")).distinct().withColumn("_known", F.lit(True))
    found = None
    step = f.withColumn("root", F.col("owner")).withColumn("path", F.col("name")).withColumn("way", F.array("owner"))
    for depth in range(1, most + 1):
        again = F.array_contains("way", F.col("type"))
        state = F.when(F.col("_known").isNull(), "leaf").when(again, "recursive").when(F.lit(depth == most), "deep").otherwise("nested")
        level = checkpointed(step.join(known, [*by, "type"], "left").select(*by, "root", "path", "type", "way", F.lit(depth).alias("depth"), F.coalesce(state, F.lit("leaf")).alias("state")))
        found = level if found is None else found.unionByName(level)
        inner = level.filter("state = 'nested'").select(*by, "root", F.col("path").alias("_path"), F.col("type").alias("owner"), F.concat("way", F.array("type")).alias("way"))
        step = inner.join(f, [*by, "owner"]).withColumn("path", F.concat_ws(".", "_path", "name"))
    return found.select(*by, "root", "path", "type", "depth", "state")
