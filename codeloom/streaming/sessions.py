"""Per-session gates: what was shown, how often, and what it saved."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.ranking import top_per_group
from ..operators.fuse import strong_enough
from ..session import broadcast_if_small, materialize

# Fixed values of the gates.
REMEMBERED = 40
NUDGES = 2


def strong_prompts(prompts: DataFrame) -> DataFrame:
    """Prompts whose best hit is a real match; structural answers carry no scores and pass."""
    unscored = F.col("coverage").isNull() & F.col("coverage_strong").isNull()
    strength = strong_enough(F.coalesce("coverage_strong", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0)))
    return prompts.where(unscored | strength)


def nudges(weak: DataFrame, order: list[Column], cap: int = NUDGES) -> DataFrame:
    """The first ``cap`` weak prompts of each session."""
    return top_per_group(weak, ["session"], order, cap, "nudge")


# --------------------------------------------------------------------------
# novelty


def fresh_pointers(shown: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """Rows (session, step, pointer) whose pointer the session does not remember.

    A session remembers the last ``remembered`` pointers it was shown.  Where
    it meets no more distinct pointers than that, a pointer is fresh exactly
    once, which is a plain aggregate at any size.  Only the other sessions are
    replayed in order; they stream through with the short list as their state.
    """
    firsts = materialize(shown.groupBy("session", "pointer").agg(F.min("step").alias("step")))
    busy = broadcast_if_small(
        firsts.groupBy("session").agg(F.count("*").alias("n")).where(F.col("n") > remembered).select("session"))
    calm = firsts.join(busy, "session", "left_anti").select("session", "step", "pointer")
    replayed = (
        shown.join(busy, "session", "left_semi").select("session", "step", "pointer")
        .repartition("session").sortWithinPartitions("session", "step", "pointer")
        .mapInPandas(lambda it: _replay(it, remembered), schema=_schema_of(shown))
    )
    return calm.unionByName(replayed)


def _schema_of(shown: DataFrame) -> T.StructType:
    kinds = {f.name: f.dataType for f in shown.schema.fields}
    return T.StructType([T.StructField(c, kinds[c]) for c in ("session", "step", "pointer")])


def _replay(batches: Iterator[pd.DataFrame], remembered: int) -> Iterator[pd.DataFrame]:
    session, seen = None, []
    for batch in batches:
        keep = []
        for s, p in zip(batch["session"], batch["pointer"]):
            if s != session:
                session, seen = s, []
            new = p not in seen
            keep.append(new)
            if new:
                seen = (seen + [p])[-remembered:]
        yield batch[keep]


class NoveltyGate(StatefulProcessor):
    """Streaming form: the state of a session is its short list of pointers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("pointers", T.ArrayType(T.StringType()))])
        self.shown = handle.getValueState("shown", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = list(self.shown.get()[0]) if self.shown.exists() else []
        # one micro-batch of one session, in event order
        batch = pd.concat(list(rows)).sort_values(["step", "pointer"])
        keep = []
        for p in batch["pointer"]:
            new = p not in seen
            keep.append(new)
            if new:
                seen = (seen + [p])[-REMEMBERED:]
        self.shown.update((seen,))
        yield batch[keep][["session", "step", "pointer"]]

    def close(self) -> None:
        pass


def novelty_stream(shown: DataFrame) -> DataFrame:
    """Streaming novelty gate over (session, step, pointer)."""
    return shown.groupBy("session").transformWithStateInPandas(
        statefulProcessor=NoveltyGate(), outputStructType=_schema_of(shown),
        outputMode="Append", timeMode="None")


# --------------------------------------------------------------------------
# counters


def saved_total(outputs: DataFrame, pattern: str) -> DataFrame:
    """Sum per session of the numbers that ``pattern`` captures in each output."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(pattern), 1),
                          lambda s: F.regexp_replace(s, ",", "").cast("long"))
    total = F.aggregate(numbers, F.lit(0).cast("long"), lambda a, v: a + v)
    return outputs.groupBy("session").agg(F.sum(total).alias("saved"))


def event_counts_stream(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and type, closed once the watermark passes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def scope_hint(paths: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Scope of each mentioned file name, if the name lives in one scope only.

    ``paths``: name, scope.  ``mentioned``: session, name.
    """
    unique = paths.groupBy("name").agg(F.min("scope").alias("scope"), F.max("scope").alias("_other")).where(
        F.col("scope") == F.col("_other")).drop("_other")
    return mentioned.join(unique, "name")


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for a status line: nodes, edges, ready and stale summaries."""
    counted = nodes.agg(
        F.count("*").alias("nodes"),
        F.coalesce(F.sum((F.col("summary_state") == "ready").cast("long")), F.lit(0)).alias("ready"),
        F.coalesce(F.sum((F.col("summary_state") == "stale").cast("long")), F.lit(0)).alias("stale"),
    )
    return counted.withColumn("edges", F.lit(edges.count()))
