"""Holds of a host after refusals: each at least as long as asked, doubled when the probe after a hold is refused too, and a
pace that only ever slows. The next hold depends on the last one, so this is an ordered fold per host."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P

#: Kind of refusal -> least hold and least pace in seconds, and those of any other kind.
FLOOR = {"blocked": float(P.HOLD_S), "silent_refusal": float(P.HOLD_S), "archive": float(P.ARCHIVE_HOLD)}
PACE = {"blocked": 5.0, "silent_refusal": 5.0, "archive": 5.0}
OTHER_FLOOR, OTHER_PACE = 120.0, 2.0
SCHEMA = "host string, n long, since long, until long, pace double"


def throttles(attempts: DataFrame) -> DataFrame:
    """host, secs, req_id, kind, retry_after of the refused reads."""
    kind = F.when(F.col("k") % 3 == 0, "blocked").when(F.col("k") % 3 == 1, "rate_limited").otherwise("archive")
    return attempts.where("outcome = 'refused'").select("host", "secs", "req_id", kind.alias("kind"), F.floor("value").cast("double").alias("retry_after"))


def fold(state: tuple | None, events) -> tuple:
    """(n, since, until, pace) after (at, kind, retry_after) events in order."""
    n, since, until, pace = state or (0, None, None, 1.0)
    for at, kind, asked in events:
        seconds = max(asked or 0.0, FLOOR.get(kind, OTHER_FLOOR))
        if until is not None:
            seconds = max(seconds, 2.0 * (until - since))
        seconds = min(seconds, float(P.HOLD_MOST))
        n, since, until, pace = n + 1, int(at), int(at + seconds), min(max(pace, PACE.get(kind, OTHER_PACE), 2 * pace), float(P.HOLD_MOST))
    return n, since, until, pace


def backoff(events: DataFrame) -> DataFrame:
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["secs", "req_id"])
        return pd.DataFrame([(key[0], *fold(None, zip(rows["secs"], rows["kind"], rows["retry_after"])))], columns=["host", "n", "since", "until", "pace"])

    return events.groupBy("host").applyInPandas(run, SCHEMA)
