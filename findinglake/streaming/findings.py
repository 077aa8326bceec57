"""The state of findings over a stream of scans, kept by Spark's state store.

A key of the state is a repository, or one of `salts` parts of it, and holds a map of the findings there are; a
micro-batch reads and writes the parts of the repositories that it has rows of and no others.  Versions are Spark's own: a
batch that is repeated begins at the version before it, and old versions are cleaned up by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from findinglake.domain import ACTIVE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "repository string, identity string, fingerprint string, status string, first_seen timestamp, last_seen timestamp, change string, at timestamp"


class FindingState(StatefulProcessor):
    """Rows of one part of a repository, scan by scan in the order of time; what changes is told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("findings", "identity string", "fingerprint string, status string, first_seen timestamp, last_seen timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scans: dict = {}
        for pdf in rows:
            for identity, fingerprint, at, status in zip(pdf["identity"], pdf["fingerprint"], pdf["at"], pdf["set_status"]):
                by_hand, seen = scans.setdefault(at, ({}, {}))
                if status is not None and identity is not None:
                    by_hand[identity] = max(status, by_hand.get(identity, ""))
                elif identity is not None:
                    seen[identity] = min(fingerprint or identity, seen.get(identity, fingerprint or identity))
                else:
                    seen.setdefault(None, None)  # the scan's own row
        state = {k[0]: tuple(v) for k, v in self.known.iterator()}
        before, told = dict(state), []
        for at in sorted(scans):
            by_hand, seen = scans[at]
            for identity in sorted(x for x in seen if x is not None):
                old, fingerprint = state.get(identity), seen[identity]
                if old is None:
                    new, change = (fingerprint, "OPEN", at, at), "NEW"
                else:
                    status = "REOPENED" if old[1] == "RESOLVED" else old[1]
                    new = (fingerprint, status, old[2], max(old[3], at))
                    change = "REOPENED" if status != old[1] else "MOVED" if fingerprint != old[0] else None
                state[identity] = new
                if change:
                    told.append((key[0], identity, *new, change, at))
            if seen:
                for identity, old in state.items():
                    if identity not in seen and old[1] in ACTIVE:
                        state[identity] = (old[0], "RESOLVED", *old[2:])
                        told.append((key[0], identity, *state[identity], "RESOLVED", at))
            for identity, status in sorted(by_hand.items()):
                old = state.get(identity)
                if old is not None and old[1] != status:
                    state[identity] = (old[0], status, *old[2:])
                    told.append((key[0], identity, *state[identity], "STATUS", at))
        for identity, value in state.items():
            if before.get(identity) != value:
                self.known.updateValue((identity,), value)
        yield pd.DataFrame(told, columns=["repository", "identity", "fingerprint", "status", "first_seen", "last_seen", "change", "at"])

    def close(self) -> None:
        pass


def finding_changes(scans: DataFrame, salts: int = 1) -> DataFrame:
    """The changes that a stream of scans makes: NEW, REOPENED, RESOLVED, MOVED or STATUS, with the finding as it is then.

    scans: repository, identity, fingerprint, at, set_status.  A scan (repository, at) has a row for each finding and,
    with salts over 1 or if it may find nothing, one with a null identity, which stands for the scan and goes to all
    parts.  Found again after RESOLVED is REOPENED; an active finding that a scan doesn't have is RESOLVED; a finding
    whose fingerprint is another than before has MOVED; set_status is a change by hand, made after the scan of that
    time.  Scans older than ones of earlier micro-batches are taken as they come.  Rows without repository or time go,
    equal rows count once.

    salts: parts of a repository, by a hash of the identity.  A task holds the findings of one part, so a repository of any
    size is spread; the number can't change once a stream has run.
    """
    wanted = {"fingerprint": "string", "set_status": "string"}
    rows = scans.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in scans.columns}).where("repository is not null and at is not null")
    own = F.array(F.pmod(F.xxhash64("identity"), F.lit(salts)).cast("int"))
    every = F.array(*(F.lit(i) for i in range(salts)))
    rows = rows.select("repository", "identity", "fingerprint", F.col("at").cast("timestamp").alias("at"), "set_status", F.explode(F.when(F.col("identity").isNull(), every).otherwise(own)).alias("part"))
    return rows.groupBy("repository", "part").transformWithStateInPandas(FindingState(), CHANGES, "Append", "None")


def keep_state(scans: DataFrame, changes: str, checkpoint: str, salts: int = 1, **trigger):
    """Starts a query that keeps the findings' state below `checkpoint` and appends its changes as Parquet to `changes`.

    The state store is RocksDB, which this query's session is given; other queries keep their own.
    """
    spark, name = scans.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        writer = finding_changes(scans, salts).writeStream.format("parquet").option("path", changes).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def current_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """repository, identity, fingerprint, status, first_seen, last_seen as the last finished micro-batch left them."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "findings").load()
    return rows.select(F.col("key.repository").alias("repository"), F.col("user_map_key.identity").alias("identity"), "user_map_value.*")


def with_identity(scan: DataFrame, state: DataFrame, moves: DataFrame) -> DataFrame:
    """scan with identity, and the fingerprint that the finding has from now on.

    scan: repository, fingerprint and more; state: repository, identity, fingerprint; moves: repository, base, cur, the
    fuzzy matches of the comparison with the baseline.  A finding whose code changed keeps the identity of its match, and
    takes the new fingerprint unless another finding of the state has it; others have the identity of their fingerprint
    in the state, or become identities of their own.  If several findings match one base, the first by fingerprint does.
    """
    own = state.groupBy("repository", "fingerprint").agg(F.min("identity").alias("own"))
    old = own.select("repository", F.col("fingerprint").alias("base"), F.col("own").alias("moved"))
    taken = moves.join(old, ["repository", "base"]).groupBy("repository", "base", "moved").agg(F.min("cur").alias("fingerprint"))
    taken = taken.groupBy("repository", "fingerprint").agg(F.min_by("moved", "base").alias("moved"), F.min("base").alias("base"))
    rows = scan.join(own, ["repository", "fingerprint"], "left").join(taken, ["repository", "fingerprint"], "left")
    known = [F.col(c) for c in scan.columns if c not in ("fingerprint", "identity")]
    stays = F.col("moved").isNotNull() & F.col("own").isNotNull()
    return rows.select(*known, F.coalesce("moved", "own", "fingerprint").alias("identity"), F.when(stays, F.col("base")).otherwise(F.col("fingerprint")).alias("fingerprint"))
