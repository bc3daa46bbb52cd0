"""Outcomes and scopes as small dimension tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P


def dimension(spark: SparkSession) -> DataFrame:
    """outcome, priority, code; a constant of this module, so it is broadcast."""
    return F.broadcast(spark.createDataFrame([(o, i, c) for i, (o, c) in enumerate(P.PRIORITY)], "outcome string, priority int, code string"))


def scope_regexes(hosts: DataFrame, scopes: list[str]) -> DataFrame:
    """Hosts that expressions among the scopes match in full; those that do not compile match nothing."""
    found = None
    for s in scopes:
        try:
            re.compile(s)
        except re.error:
            continue
        part = hosts.where(F.col("host").rlike(f"^(?:{s})$")).select("host", F.lit(s).alias("scope"))
        found = part if found is None else found.unionByName(part)
    return hosts.select("host", F.lit("").alias("scope")).limit(0) if found is None else found
