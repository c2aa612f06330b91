"""Corrections per session in a state store: each micro-batch touches the state of its own sessions only."""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnwise.lineage import new_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = 16 << 20  # how far behind its session's highest seq a row may come; of a log, bytes
WEEK_MS = 7 * 24 * 3600 * 1000
CHANGES = "session string, skill string, n bigint, first boolean, late bigint"


def attributed(rows: pd.DataFrame, skill: str | None) -> tuple[dict[str, int], str | None]:
    """Corrections by the skill started last before each, for rows (seq, skill, hits) in order of seq, and the skill at the end.

    ``skill`` is the one active before them; '' is an unknown skill, whose corrections count for none.
    """
    started = rows["skill"].where(rows["skill"].notna(), None)
    active = started.ffill() if skill is None else started.ffill().fillna(skill)
    counted = rows["hits"].groupby(active).sum()
    last = active.iloc[-1] if len(rows) else skill
    return {s: int(n) for s, n in counted.items() if s and n}, last if isinstance(last, str) else None


class Corrections(StatefulProcessor):
    """Counts of one session.

    Rows that start a skill or hold corrections are kept, keyed by seq, while they are within ``late`` of the highest seq, so one that comes
    out of order or twice finds its place; older ones are folded into the counts and forgotten, with the skill that was active after
    them. The bound moves between micro-batches; a row that comes from behind it is reported as late. A session without rows for
    ``ttl_ms`` loses its state.
    """

    def __init__(self, late: int, ttl_ms: int):
        self.late, self.ttl_ms = late, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getMapState("recent", "seq bigint", "skill string, hits bigint")
        self.counts = handle.getMapState("counts", "skill string", "settled bigint, shown bigint")
        self.place = handle.getValueState("place", "skill string, top bigint, late bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        skill, top, late = self.place.get() if self.place.exists() else (None, None, 0)
        held = {k[0]: tuple(v) for k, v in self.recent.iterator()}
        counts = {k[0]: list(v) for k, v in self.counts.iterator()}
        stored, too_late, floor = set(held), 0, None if top is None else top - self.late
        for part in rows:
            for seq, started, hits in zip(part["seq"].tolist(), part["skill"], part["hits"].fillna(0).tolist(), strict=True):
                started = started if isinstance(started, str) else None
                if floor is not None and seq <= floor:
                    too_late += bool(started is not None or hits)
                    continue
                top = seq if top is None else max(top, seq)
                if started is not None or hits:  # other rows only say how far the session has come
                    held[seq] = (started, int(hits))
        old = sorted(s for s in held if s <= top - self.late)
        settled, skill = attributed(self._frame(held, old), skill)
        for name, n in settled.items():
            counts.setdefault(name, [0, 0])[0] += n
        for seq in old:
            del held[seq]
        open_, _ = attributed(self._frame(held, sorted(held)), skill)
        self._write(held, stored, (skill, None if top is None else int(top), int(late + too_late)))
        yield self._changes(key[0], counts, open_, int(too_late))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)

    @staticmethod
    def _frame(held: dict, order: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"skill": pd.Series([held[s][0] for s in order], dtype=object), "hits": pd.Series([held[s][1] for s in order], dtype="int64")})

    def _write(self, held: dict, stored: set[int], place: tuple) -> None:
        for seq in stored - held.keys():
            self.recent.removeKey((seq,))
        for seq in held:
            if seq not in stored or self.recent.getValue((seq,)) != held[seq]:
                self.recent.updateValue((seq,), held[seq])
        self.place.update(place)

    def _changes(self, session: str, counts: dict, open_: dict, too_late: int) -> pd.DataFrame:
        """What a reader has not been shown yet; ``first`` with a skill's first correction."""
        out = []
        for skill in counts.keys() | open_.keys():
            settled, shown = counts.get(skill, (0, 0))
            now = settled + open_.get(skill, 0)
            self.counts.updateValue((skill,), (settled, now))
            if now != shown:
                out.append((session, skill, now, shown == 0, 0))
        if too_late:
            out.append((session, None, None, False, too_late))
        return pd.DataFrame(out, columns=["session", "skill", "n", "first", "late"]).astype({"n": "Int64", "first": bool, "late": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.counts.clear()
        self.place.clear()
        yield pd.DataFrame({"session": [], "skill": [], "n": [], "first": [], "late": []}).astype(
            {"session": str, "skill": str, "n": "int64", "first": bool, "late": "int64"})

    def close(self) -> None:
        pass


def correction_changes(marks: DataFrame, late: int = LATE, ttl_ms: int = WEEK_MS) -> DataFrame:
    """Changes of the counts per (session, skill) of the stream ``marks`` (session, seq, skill, hits), each with its new count.

    ``first`` marks the change with which a skill has its first correction: the one to announce. A row (session, null, null, false, late) says
    how many rows came later than ``late`` behind. A null session is one, too.
    """
    named = marks.select(F.coalesce(F.concat(F.lit("="), "session"), F.lit("")).alias("session"), "seq", "skill", "hits").where("seq is not null")
    changes = named.groupBy("session").transformWithStateInPandas(Corrections(late, ttl_ms), CHANGES, "Update", "ProcessingTime")
    return changes.withColumn("session", F.when(F.col("session") != "", F.expr("substring(session, 2)")))


def follow_corrections(marks: DataFrame, folder: str | None = None, late: int = LATE, ttl_ms: int = WEEK_MS) -> DataFrame:
    """(session, skill, n) after all marks that are there now, read from the changes of all micro-batches.

    A micro-batch writes its changes to a folder of its own, which a repeated one overwrites. ``folder`` holds changes and state, and the next
    call goes on from there. Expired sessions start anew at zero; what they had stays in the changes.
    """
    spark = marks.sparkSession
    out = folder or new_folder(spark, "corrections")
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    writer = correction_changes(marks, late, ttl_ms).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(
        availableNow=True).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        running = writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    running.awaitTermination()
    return counts_of(spark.read.schema(f"{CHANGES}, batch bigint").parquet(f"{out}/changes"))


def counts_of(changes: DataFrame) -> DataFrame:
    """(session, skill, n): the last change of each."""
    last = changes.where("skill is not null").groupBy("session", "skill").agg(F.max_by("n", "batch").alias("n"))
    return last.where("n > 0")
