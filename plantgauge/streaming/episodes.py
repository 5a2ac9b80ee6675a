"""Episodes of a keyed signal on a stream: when it starts, how long it holds, when it is over.

An episode is a run of active rows of a key in event-time order, not interrupted by an
inactive row nor by a pause longer than ``pause``. Rows may arrive out of order: those beyond the
watermark wait in the state of the key's group and are taken in order once it has passed them. A timer on
event time closes an episode after which nothing more comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plantgauge.session import fresh_folder
from plantgauge.streaming.running_totals import run_to_table

EPISODE = "key string, started long, ended long, rows long"
# per key: how many rows wait and the open episode; the waiting rows of all keys in turn
STATE = (
    "keys array<string>, held array<long>, started array<long>, ended array<long>, rows array<long>,"
    " times array<long>, flags array<boolean>"
)
# keys are stepped in this many groups, as each call and state row has a price of its own
GROUPS = 4096


def _stepper(pause_us: int):
    def step(key, frames, state: GroupState):
        """All figures are microseconds; the watermark counts milliseconds."""
        import pandas as pd

        waiting, open_ = {}, {}
        if state.exists:
            keys, held, started, ended, rows, times, flags = state.get
            rest = iter(zip(times, flags))
            for k, n, *episode in zip(keys, held, started, ended, rows):
                waiting[k] = [next(rest) for _ in range(n)]
                open_[k] = episode
        for frame in frames:
            for k, t, f in zip(frame["key"].tolist(), frame["at"].tolist(), frame["active"].tolist()):
                waiting.setdefault(k, []).append((t, f))
        passed = state.getCurrentWatermarkMs() * 1000
        out, kept, wake = [], [], []
        for k, arrived in waiting.items():
            # at one moment inactive rows come last: they end what the active ones hold
            due = sorted((w for w in arrived if w[0] <= passed), key=lambda w: (w[0], not w[1]))
            later = [w for w in arrived if w[0] > passed]
            started, ended, rows = open_.get(k, (-1, -1, 0))
            for t, active in due:
                if rows and (not active or t - ended > pause_us):
                    out.append((k, started, ended, rows))
                    rows = 0
                if active:
                    started, ended, rows = (t if not rows else started), t, rows + 1
            if rows and ended + pause_us < passed:
                out.append((k, started, ended, rows))
                rows = 0
            if later or rows:
                kept.append((k, started, ended, rows, later))
                wake += [min(t for t, _ in later)] if later else []
                wake += [ended + pause_us] if rows else []
        if kept:
            keys, started, ended, rows, later = (list(c) for c in zip(*kept))
            times, flags = [t for w in later for t, _ in w], [f for w in later for _, f in w]
            state.update((keys, [len(w) for w in later], started, ended, rows, times, flags))
            # a timer fires once the watermark is beyond it
            state.setTimeoutTimestamp(max(min(wake) // 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "started", "ended", "rows"])

    return step


def episodes(signals: DataFrame, pause_seconds: int, late: str) -> DataFrame:
    """key, started, ended (timestamps), rows of every episode that is over.

    ``signals`` is a stream of key, timestamp, active. Rows with a null key or time are left out,
    a null flag is inactive. Rows later than ``late`` behind the newest are dropped by the
    watermark. State holds the rows within ``late`` and one open episode per key; keys are dealt to
    ``GROUPS`` states by their hash, so a state grows with the keys it has.
    """
    rows = signals.where(F.col("key").isNotNull() & F.col("timestamp").isNotNull()).select(
        F.col("key").cast("string").alias("key"), F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), F.coalesce("active", F.lit(False)).alias("active"),
    ).withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    found = rows.withWatermark("timestamp", late).groupBy("_group").applyInPandasWithState(
        _stepper(pause_seconds * 1_000_000), EPISODE, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(
        "key", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "rows"
    )


def finished_episodes(spark: SparkSession, signals: DataFrame, pause_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """The episodes that are over once everything that has arrived is processed."""
    path, mark = fresh_folder(spark, "episodes"), fresh_folder(spark, "episodes-progress")
    run_to_table(episodes(signals, pause_seconds, late), path, mark)
    return spark.read.parquet(path)
