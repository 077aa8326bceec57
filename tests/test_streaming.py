import datetime as dt
import random
from collections import deque

from pyspark.sql import functions as F

from findinglake.streaming import findings as L
from findinglake.streaming import state as S


def stream(spark, tmp_path, rows, schema, files=3):
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))


def test_rate_limit(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((float(rng.randrange(2000)), i, rng.choice("aab")) for i in range(300))
    rows = [(k, i, t) for t, i, k in rows]
    got = S.run_available(S.rate_limit(stream(spark, tmp_path, rows, "key string, event_id long, t double"), 4)).collect()
    held, want = {}, {}
    for k, i, t in rows:
        q = held.setdefault(k, deque())
        while q and t - q[0] > 60:
            q.popleft()
        want[i] = (True, 0.0) if len(q) < 4 else (False, 60 - (t - q[0]))
        if want[i][0]:
            q.append(t)
    assert {r.event_id: (r.allowed, r.retry_after) for r in got} == want and not all(a for a, _ in want.values())


def test_lockout(spark, tmp_path):
    steps = [(0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, True), (64, True), (65, True), (70, False)]
    rows = [("u", i, float(t), ok) for i, (t, ok) in enumerate(steps)]
    got = S.run_available(S.lockout(stream(spark, tmp_path, rows, "key string, event_id long, t double, ok boolean", 1), 3, 1.0)).collect()
    out = [r.outcome[0] for r in sorted(got, key=lambda r: r.event_id)]
    assert "".join(out) == "FFSFFFDDSF"


def _shuffled(spark, tmp_path, limited, locked):
    """What the two give for one key's rows that come in any order in Arrow chunks of three rows."""
    rows = [("u", i, float(7 * i // 2), i % 5 == 0) for i in range(100)] + [("u", None, 20.0, False)]
    random.Random(2).shuffle(rows)
    df = stream(spark, tmp_path, rows, "key string, event_id long, t double, ok boolean", 1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        one, two = (S.run_available(x).collect() for x in (limited(df.drop("ok")), locked(df)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    order = lambda r: (r[2], r[1] is None, r[1])
    rows = sorted(((k, i, t, ok) for k, i, t, ok in rows), key=order)
    times, failed, until, want_one, want_two = [], 0, -1.0, [], []
    for _, i, t, ok in rows:
        times = [x for x in times if t - x <= 60]
        want_one.append((i, len(times) < 4))
        times += [t] * (len(times) < 4)
        want_two.append((i, "DENIED" if until > t else "SUCCESS" if ok else "FAILURE"))
        if until <= t:
            failed = 0 if ok else failed + 1
            if failed == 3:
                failed, until = 0, t + 30.0
    assert len({x for _, x in want_one}) == 2 and len({x for _, x in want_two}) == 3
    by_id = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert by_id((r.event_id, r.allowed) for r in one) == by_id(want_one)
    assert by_id((r.event_id, r.outcome) for r in two) == by_id(want_two)


def test_order_across_chunks(spark, tmp_path):
    _shuffled(spark, tmp_path, lambda x: S.rate_limit(x, 4), lambda x: S.lockout(x, 3, 0.5))


def test_order_across_runs_on_disk(spark, tmp_path):
    _shuffled(spark, tmp_path, lambda x: S.rate_limit(x, 4, held=10), lambda x: S.lockout(x, 3, 0.5, held=10))


def test_sessions_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, at(0)), (1, at(29)), (1, at(60)), (2, at(5)), (3, at(5000))]
    df = stream(spark, tmp_path, rows, "user_id int, ts timestamp", 1)
    got = {(r.user_id, r.n) for r in S.run_available(S.sessions(df, "user_id", late="1 minute")).collect()}
    assert got == {(1, 2), (1, 1), (2, 1)}  # the newest session is still open


def test_advance(spark):
    state = spark.createDataFrame([("r", "a", "OPEN", 1, 1), ("r", "b", "RESOLVED", 1, 1), ("r", "c", "FALSE_POSITIVE", 1, 1), ("s", "a", "OPEN", 1, 1)], "repository string, fingerprint string, status string, first_seen int, last_seen int")
    scan = spark.createDataFrame([("r", "b"), ("r", "d"), ("r", "d")], "repository string, fingerprint string")
    got = {(r.repository, r.fingerprint, r.status, r.first_seen, r.last_seen) for r in S.advance(state, scan, 2).collect()}
    assert got == {("r", "a", "RESOLVED", 1, 1), ("r", "b", "REOPENED", 1, 2), ("r", "c", "FALSE_POSITIVE", 1, 1), ("r", "d", "OPEN", 2, 2), ("s", "a", "OPEN", 1, 1)}
    assert S.advance(state.limit(0), scan.limit(0), 2).select(F.count("*")).first()[0] == 0


def _replayed(rows):
    """(repository, identity) -> fingerprint, status, first and last day: all scans from the start, one after the other."""
    out = {}
    for at in sorted({r[3] for r in rows}):
        for repo in {r[0] for r in rows if r[3] == at}:
            own = [r for r in rows if r[0] == repo and r[3] == at and r[4] is None]
            for _, i, f, *_ in own:
                if i is not None:
                    old = out.get((repo, i))
                    status = "OPEN" if old is None else "REOPENED" if old[1] == "RESOLVED" else old[1]
                    out[repo, i] = (f, status, old[2] if old else at.day, at.day)
            for key, old in out.items():
                if own and key[0] == repo and key[1] not in {r[1] for r in own} and old[1] in ("OPEN", "IN_PROGRESS", "REOPENED"):
                    out[key] = (old[0], "RESOLVED", *old[2:])
            for _, i, _, _, status in (r for r in rows if r[0] == repo and r[3] == at and r[4] is not None):
                if (repo, i) in out:
                    out[repo, i] = (out[repo, i][0], status, *out[repo, i][2:])
    return out


def test_state_of_a_stream(spark, tmp_path):
    """Scans in many micro-batches, in parts: the state is that of a replay from the start, and a run without input changes nothing."""
    import random

    rng, day = random.Random(5), lambda d: dt.datetime(2024, 1, d)
    schema = "repository string, identity string, fingerprint string, at timestamp, set_status string"
    rows, changes = [], str(tmp_path / "changes")
    for d in (1, 4, 7, 10):
        part = []
        for at in range(d, d + 3):  # several scans of a repository in one micro-batch
            for repo in rng.sample("qrs", 2):
                part.append((repo, None, None, day(at), None))
                part += [(repo, i, i + rng.choice("xy"), day(at), None) for i in rng.sample("abcdefgh", rng.randint(0, 6))]
        part.append(("q", rng.choice("abc"), None, day(d), "FALSE_POSITIVE"))
        rows += part
        spark.createDataFrame(part + part[:5], schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        scans = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for _ in range(2):
            L.keep_state(scans, changes, str(tmp_path / "cp"), salts=3).awaitTermination()
        got = {(r.repository, r.identity): (r.fingerprint, r.status, r.first_seen.day, r.last_seen.day) for r in L.current_state(spark, str(tmp_path / "cp")).collect()}
        assert got == _replayed(rows)
    newest = spark.read.parquet(changes).groupBy("repository", "identity").agg(F.max_by("status", F.struct("at", (F.col("change") == "STATUS").alias("x"))).alias("status"))
    assert {(r.repository, r.identity): r.status for r in newest.collect()} == {k: v[1] for k, v in _replayed(rows).items()}


def test_identity_stays_with_changed_code(spark):
    state = spark.createDataFrame([("r", "i1", "f1"), ("r", "i2", "f2"), ("r", "i3", "f3"), ("s", "j", "f1")], "repository string, identity string, fingerprint string")
    scan = spark.createDataFrame([("r", "g1", 1), ("r", "f2", 2), ("r", "new", 3), ("s", "g1", 4), ("r", "f3", 5)], "repository string, fingerprint string, line int")
    moves = spark.createDataFrame([("r", "f1", "g1"), ("r", "f2", "f3"), ("r", "gone", "new")], "repository string, base string, cur string")
    got = {(r.line, r.identity, r.fingerprint) for r in L.with_identity(scan, state, moves).collect()}
    assert got == {(1, "i1", "g1"), (2, "i2", "f2"), (3, "new", "new"), (4, "g1", "g1"), (5, "i2", "f2")}
