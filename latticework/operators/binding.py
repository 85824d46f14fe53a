"""Names bound to families, followed through aliases and factories to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.sources.folders import checkpointed


def bound_names(bases: DataFrame, aliases: DataFrame, factories: DataFrame, by: list[str], name: str = "name", family: str = "family", source: str = "source", method: str = "method") -> DataFrame:
    """(by, name, family): every name that stands for one family, by itself or through others.

    bases: (by, name, family). aliases: (by, name, source, method): the name is given the value of `source`, or what a method of
    it returns. factories: (family, method, made): what a family's methods make; a table of rules, with one row a method. A null in `by` meets nothing. An
    alias without a method has the family of its source; one with a method that is no factory of the source's family has none.
    A name that comes to stand for several families is not told; what others have of it stays theirs.

    Each round is a join of the names found last with the aliases of the same `by`; there are as many rounds as the longest chain
    of names is long, and names that go in circles end them, as nothing new is found.
    """
    by = list(by)
    known = checkpointed(bases.select(*by, F.col(name).alias("name"), F.col(family).alias("family")).filter("name IS NOT NULL AND family IS NOT NULL").distinct())
    ways = aliases.select(*by, F.col(name).alias("_to"), F.col(source).alias("name"), F.col(method).alias("_method")).filter("_to IS NOT NULL").distinct()
    ways = checkpointed(ways)
    made = factories.select(F.col(family).alias("family"), F.col(method).alias("_method"), F.col("made").alias("_made"))
    new = known
    while True:
        step = new.join(ways, [*by, "name"]).join(made, ["family", "_method"], "left")
        family_of = F.when(F.col("_method").isNull(), F.col("family")).otherwise(F.col("_made"))
        step = step.select(*by, F.col("_to").alias("name"), family_of.alias("family")).filter("family IS NOT NULL").distinct()
        new = checkpointed(step.join(known, [*by, "name", "family"], "left_anti"))
        if new.isEmpty():
            break
        known = checkpointed(known.unionByName(new))
    one = known.groupBy(*by, "name").agg(F.min("family").alias("family"), F.max("family").alias("_other"))
    return one.filter("family = _other").select(*by, F.col("name").alias(name), F.col("family").alias(family))
