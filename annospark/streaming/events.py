"""Annotator events as a stream: checks, session activity, dwell time and outcomes.

The transformations are plain DataFrame functions. Applied to a table they give the full result;
applied to a stream, ``watermarked`` bounds their state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

from annospark.schemas import CORRUPT, EVENT_LINE, EVENT_TYPES

ACCEPTS, REJECTS = ("box_accept",), ("box_reject", "box_delete")

# What an annotator can do to a box, as separate kinds of feedback.
BOX_ACTIONS = ("box_accept", "box_reject", "box_adjust", "class_change", "box_delete", "box_add")


def stream_events(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Events from JSON lines, one file per session, as they arrive."""
    reader = spark.readStream.schema(EVENT_LINE).option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.withColumn("ts", F.timestamp_millis("ts_ms"))


def valid(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*EVENT_TYPES)).drop(CORRUPT)


def quarantined(events: DataFrame) -> DataFrame:
    """Events outside the vocabulary, and the text of lines that are no events."""
    return events.where(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES))


def watermarked(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay)


def _activity() -> list:
    kind = F.col("event_type")
    return [
        F.count("*").alias("events"),
        F.count(F.when(kind.isin(*ACCEPTS), 1)).alias("accepts"),
        F.count(F.when(kind.isin(*REJECTS), 1)).alias("rejects"),
    ]


def session_activity(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Events, accepts and rejects per session of a table; a pause longer than the gap starts a new one.

    Events in one time slot as long as the gap always belong together. So slots are counted first, with
    map-side combine, and only slots are put in order: a session with very many events stays small.
    """
    gap = gap_minutes * 60_000
    slots = events.groupBy("session_id", F.floor(F.col("ts_ms") / gap).alias("slot")).agg(
        F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), *_activity()
    )
    order = Window.partitionBy("session_id").orderBy("slot")
    fresh = F.coalesce((F.col("first") - F.lag("last").over(order) > gap).cast("int"), F.lit(1))
    marked = slots.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(order))
    return marked.groupBy("session_id", "part").agg(
        F.min("first").alias("start_ms"),
        (F.max("last") + gap).alias("end_ms"),
        *[F.sum(c).alias(c) for c in ("events", "accepts", "rejects")],
    ).drop("part")


def stream_session_activity(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``session_activity`` of a stream; with a watermark a session's state is dropped after its end."""
    return (
        events.groupBy("session_id", F.session_window("ts", gap).alias("span"))
        .agg(*_activity())
        .select(
            "session_id",
            F.unix_millis("span.start").alias("start_ms"),
            F.unix_millis("span.end").alias("end_ms"),
            "events",
            "accepts",
            "rejects",
        )
    )


def dwell_by_image(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Milliseconds spent per image and time window, from events that report a dwell time."""
    dwell = F.element_at("payload", F.lit("dwell_ms")).try_cast("bigint")
    timed = events.where(F.col("event_type").isin("hover", "image_finalized")).withColumn("dwell_ms", dwell)
    return (
        timed.where(F.col("dwell_ms").isNotNull())
        .groupBy("image_id", F.window("ts", width).alias("span"))
        .agg(F.sum("dwell_ms").alias("dwell_ms"), F.count("*").alias("events"))
        .select("image_id", F.unix_millis("span.start").alias("start_ms"), "dwell_ms", "events")
    )


def _last_action(events: DataFrame, *extra) -> DataFrame:
    acted = events.where(F.col("event_type").isin(*BOX_ACTIONS) & F.col("box_id").isNotNull())
    return acted.groupBy("session_id", "image_id", "box_id", *extra).agg(
        F.max_by("event_type", F.struct("ts_ms", "event_type")).alias("outcome"),
        F.max("ts_ms").alias("last_ms"),
        F.count("*").alias("actions"),
    )


def box_outcome(events: DataFrame) -> DataFrame:
    """The last thing a person did to each box of a session and image."""
    return _last_action(events)


def stream_box_outcome(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Last action per box and time window, so that state ends with the watermark."""
    daily = _last_action(events, F.window("ts", width).alias("span"))
    return daily.withColumn("start_ms", F.unix_millis("span.start")).drop("span")


def combine_outcomes(daily: DataFrame) -> DataFrame:
    """``box_outcome`` from its parts per time window."""
    return daily.groupBy("session_id", "image_id", "box_id").agg(
        F.max_by("outcome", F.struct("last_ms", "outcome")).alias("outcome"),
        F.max("last_ms").alias("last_ms"),
        F.sum("actions").alias("actions"),
    )


IDLE_MS = 30 * 60_000


OUTCOME_GROUPS = 4096  # fixed, since a checkpoint holds its state by group
OPEN_BOXES = "session_id array<string>, image_id array<string>, box_id array<string>, outcome array<string>, last_ms array<bigint>, actions array<bigint>"


class LastOutcome(StatefulProcessor):
    """Holds the last action on each box of a group until ``idle_ms`` have passed without one, then gives it out and forgets it.

    Boxes are dealt into groups by a hash, so that state is fetched and stored once for many boxes. A group's timer is that of the box
    that ends first.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN_BOXES)

    def _boxes(self) -> dict:
        if not self.open.exists():
            return {}
        session, image, box, outcome, last_ms, actions = self.open.get()
        return dict(zip(zip(session, image, box), zip(last_ms, outcome, actions)))

    def _keep(self, boxes: dict) -> None:
        if not boxes:
            self.open.clear()
            return
        last_ms, outcome, actions = (list(c) for c in zip(*boxes.values()))
        self.open.update((*(list(c) for c in zip(*boxes)), outcome, last_ms, actions))
        self.handle.registerTimer(min(last_ms) + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        boxes = self._boxes()
        for session, image, box, event, ts_ms, *_ in rows:
            box = (session, image, box)
            last_ms, outcome, actions = boxes.get(box, (-(1 << 63), "", 0))
            boxes[box] = (*max((last_ms, outcome), (ts_ms, event)), actions + 1)
        self._keep(boxes)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        boxes = self._boxes()
        done = {box: said for box, said in boxes.items() if said[0] + self.idle_ms <= now}
        if not done:
            return  # touched again after this timer was set; a later one follows
        self._keep({box: said for box, said in boxes.items() if box not in done})
        for (session, image, box), (last_ms, outcome, actions) in done.items():
            yield Row(session_id=session, image_id=image, box_id=box, outcome=outcome, last_ms=last_ms, actions=actions)

    def close(self) -> None:
        pass


def stream_last_outcome(events: DataFrame, idle_ms: int = IDLE_MS, delay: str = "10 minutes") -> DataFrame:
    """``box_outcome`` of a stream, each box given out once, when nobody has touched it for ``idle_ms``.

    Time is that of the actions on boxes, ``delay`` behind the latest. State holds the boxes that are being worked on. A box that is touched again after that gives a further row;
    ``combine_outcomes`` takes the last. Needs the state store that ``keyed_state`` names.
    """
    acted = events.where(F.col("event_type").isin(*BOX_ACTIONS) & F.col("box_id").isNotNull() & F.col("ts_ms").isNotNull())
    group = F.pmod(F.xxhash64("session_id", "image_id", "box_id"), F.lit(OUTCOME_GROUPS)).alias("group")
    kept = acted.select("session_id", "image_id", "box_id", "event_type", "ts_ms", group, "ts")
    out = "session_id string, image_id string, box_id string, outcome string, last_ms long, actions long"
    return watermarked(kept, delay).groupBy("group").transformWithState(LastOutcome(idle_ms), out, "Append", "EventTime")


def keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keyed state with timers needs, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _mix() -> list:
    return [F.count(F.when(F.col("event_type") == a, 1)).alias(a) for a in BOX_ACTIONS]


def action_mix(events: DataFrame) -> DataFrame:
    """Counts per session and kind of feedback."""
    return events.groupBy("session_id").agg(*_mix())


def stream_action_mix(events: DataFrame, width: str = "1 day") -> DataFrame:
    """``action_mix`` per time window, so that state ends with the watermark."""
    daily = events.groupBy("session_id", F.window("ts", width).alias("span")).agg(*_mix())
    return daily.withColumn("start_ms", F.unix_millis("span.start")).drop("span")


def combine_mix(daily: DataFrame) -> DataFrame:
    return daily.groupBy("session_id").agg(*[F.sum(a).alias(a) for a in BOX_ACTIONS])


def outcome_vs_gold(outcomes: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Tool proposal, human decision and ground truth side by side, per decision.

    ``candidates`` has ``box_id`` and ``score``; ``matches`` are class-blind matches with ``pi``.
    """
    return outcomes.join(boxes_vs_gold(candidates, matches), "box_id")


def stream_outcome_vs_gold(events: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every decision of a stream next to the score and the ground truth of its box, a static table.

    ``boxes`` has ``box_id, score, correct, iou``. The join keeps no state; the last decision on a box is
    taken when the result is read (see ``latest``).
    """
    decisions = valid(events).where(F.col("event_type").isin(*ACCEPTS, *REJECTS))
    return decisions.select("session_id", "image_id", "box_id", "event_type", "ts_ms").join(boxes, "box_id")


def boxes_vs_gold(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """``box_id, score, correct, iou`` of candidates, from class-blind matches with ``pi``."""
    truth = matches.select(
        "image_id", F.col("pi").alias("box_ord"), (F.col("pred_label") == F.col("gold_label")).alias("right_class"), "iou"
    )
    return candidates.join(truth, ["image_id", "box_ord"], "left").select(
        "box_id", "score", F.coalesce("right_class", F.lit(False)).alias("correct"), "iou"
    )


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run everything that is available into Parquet and stop. Restarts continue from the checkpoint."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_latest(df: DataFrame, path: str, checkpoint: str):
    """Update-mode results: each batch appends its changed rows with its number.

    A reader keeps the row of the highest ``batch`` per key (see ``latest``). The batch number is a
    folder, so a repeated batch replaces its own output.
    """

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        df.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(put)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def log_events(events: DataFrame, path: str, checkpoint: str):
    """Append valid events as JSON lines and the others next to them. The source is read once.

    Each batch goes to a folder of its own, so a batch that is run again after a failure replaces its files.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.drop("ts").persist()
        for name, part in (("valid", valid(batch)), ("quarantine", quarantined(batch))):
            # a reader would take the name of the corrupt text for its own
            part.withColumnRenamed(CORRUPT, "line").write.mode("overwrite").json(f"{path}/{name}/batch={number}")
        batch.unpersist()

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
