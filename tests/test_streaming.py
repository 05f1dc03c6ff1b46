"""Following a log: backlog dropped, batches written once, sessions and accounting."""

import json
import random
import time
from collections import Counter

from pyspark.sql import Row
from pyspark.sql import functions as F

from denialkit.plans import sample
from denialkit.streaming import follow
from denialkit.streaming.accounting import Accounting
from denialkit.streaming.sessions import newest, session_report, sessions
from denialkit.streaming.state import guard, once_counted
from denialkit.streaming.tail import SCHEMA, TailReader, tail, unfinished

LINE = 'avc: denied { %s } for pid=1 comm="c" scontext=u:r:a:s0 tcontext=u:object_r:b:s0 tclass=file permissive=0\n'


def lines_of(spark, folder):
    return follow.denials(spark.readStream.text(f"file://{folder}").withColumnRenamed("value", "line")).withColumn("seq", F.lit(1))


def written(spark, path):
    return sorted(json.loads(r.value)["perms"][0] for r in spark.read.option("recursiveFileLookup", True).text(path).collect())


def run_new(spark, base):
    query = follow.follow_new(spark, f"file://{base}/in", f"file://{base}/out", f"file://{base}/check", interval=None)
    query.awaitTermination()


def test_the_first_record_of_an_empty_folder_is_new(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run_new(spark, tmp_path)
    for i, perm in enumerate(("one", "two")):
        (tmp_path / f"in/{i}.txt").write_text(LINE % perm)
        run_new(spark, tmp_path)
    assert written(spark, f"file://{tmp_path}/out") == ["one", "two"]


def test_backlog_is_dropped_and_counted(spark, tmp_path):
    """Also after a restart; the half line at its end is new once it is whole."""
    (tmp_path / "in").mkdir()
    half = LINE % "half"
    account = Accounting(spark)
    try:
        (tmp_path / "in/old.txt").write_text(LINE % "read" + "noise\n" + half[:40])
        run_new(spark, tmp_path)
        with (tmp_path / "in/old.txt").open("a") as f:
            f.write(half[40:] + LINE % "after")
        run_new(spark, tmp_path)
        (tmp_path / "in/new.txt").write_text(LINE % "write" + "noise\n")
        run_new(spark, tmp_path)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        rows = account.frame().where("lines > 0").collect()
    finally:
        account.close()
    assert written(spark, f"file://{tmp_path}/out") == ["after", "half", "write"]
    assert sum(r.lines for r in rows) == 6 and sum(r.backlog for r in rows) == 2 and all(r.ended and r.error is None for r in rows)


def lines_read(spark, base, **limits):
    checkpoint = f"file://{base}/check"
    query = tail(spark, f"file://{base}/in", checkpoint, **limits).writeStream.format("parquet").option("path", f"file://{base}/lines").option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
        return len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
    finally:
        query.stop()


def rows_of(spark, base):
    return spark.read.schema(SCHEMA).parquet(f"file://{base}/lines").orderBy("file", "at").collect()


def test_tail_keeps_half_lines_and_its_place(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    text = "".join(f"line {i} é\n" for i in range(50))
    data = text.encode()
    for a, b in ((0, 100), (100, 103), (103, 104), (104, len(data))):  # in the middle of lines and of a character
        with (tmp_path / "in/sub/a.log").open("ab") as f:
            f.write(data[a:b])
        lines_read(spark, tmp_path)  # a new query each time, from its checkpoint
    with (tmp_path / "in/sub/a.log").open("a") as f:
        f.write("no end")
    lines_read(spark, tmp_path)
    got = rows_of(spark, tmp_path)
    assert [r.line for r in got] == text.splitlines() and all(r.kind == "line" and r.fresh for r in got)
    assert [data[r.at : r.at + len(r.line.encode()) + 1] for r in got] == [f"{r.line}\n".encode() for r in got]
    assert [r.bytes for r in unfinished(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/check").collect()] == [6]


def test_budgets_bound_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / f"in/{name}.log").write_text("".join(f"{name} {i:05}\n" for i in range(40)) + "x" * 300 + "\n")
    batches = lines_read(spark, tmp_path, max_bytes=200)
    assert batches >= 5
    got = rows_of(spark, tmp_path)
    assert len(got) == 82 and sum(len(r.line) == 300 for r in got) == 2  # a line longer than the budget is read whole


def test_a_slow_reader_skips_and_tells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "".join(f"line {i:04}\n" for i in range(100))
    (tmp_path / "in/a.log").write_text(text)
    lines_read(spark, tmp_path, max_behind=95)
    got = rows_of(spark, tmp_path)
    told, lines = [r for r in got if r.kind == "skipped"], [r for r in got if r.kind == "line"]
    assert [r.line for r in lines] == text.splitlines()[-9:] and [r.bytes for r in told] == [910]
    (tmp_path / "in/a.log").write_text("short\n")  # the file begins again
    lines_read(spark, tmp_path, max_behind=95)
    got = rows_of(spark, tmp_path)
    assert [r.line for r in got if r.kind == "line" and r.at == 0] == ["short"] and [r.bytes for r in got if r.kind == "truncated"] == [1000]


def test_ranges_cut_files_anywhere(spark, tmp_path, monkeypatch):
    text = "".join("z" * (i % 40) + "\n" for i in range(200))
    (tmp_path / "a.log").write_text(text)
    reader = TailReader({"path": f"file://{tmp_path}", "checkpoint": f"file://{tmp_path}/none"})
    for size in (1, 7, 40, 4096):
        monkeypatch.setattr("denialkit.streaming.tail.RANGE", size)
        monkeypatch.setattr("denialkit.streaming.tail.STEP", 16)
        start = {"at": {}, "fresh": {}, "lost": {}}
        reader.known = None
        parts = reader.partitions(start, reader.latestOffset())
        got = sorted((at, line) for p in parts for b in reader.read(p) for at, line in zip(b.column("at").to_pylist(), b.column("line").to_pylist(), strict=True))
        assert [line for _, line in got] == text.splitlines()


class Progress:
    def __init__(self, run, n):
        self.runId, self.name, self.numInputRows, self.durationMs = run, "q", n, {"triggerExecution": 400 + n}
        self.observedMetrics = {"told": Row(lines=n, backlog=n % 2, skipped_bytes=n // 100, truncated_bytes=None, overruns=n // 100)}
        self.progress = self


def test_accounts_of_many_batches_are_exact(spark):
    """Spark itself keeps 100 of them."""
    account = Accounting(spark)
    try:
        for n in range(300):
            account.onQueryProgress(Progress("r1", n))
        account.onQueryTerminated(Row(runId="r1", exception="lost"))
        account.onQueryTerminated(Row(runId="r2", exception=None))
        one, two = account.frame().orderBy("run").collect()
    finally:
        account.close()
    assert (one.batches, one.rows, one.late, one.longest_ms) == (300, 44850, 199, 699)
    assert (one.lines, one.backlog, one.skipped_bytes, one.truncated_bytes, one.overruns, one.error) == (44850, 150, 300, 0, 300, "lost")
    assert two.ended and two.error is None and two.batches == 0


def counted(spark, base, texts, quiet=0):
    """The rows that counting state gives for one more file, in a new query each time."""
    (base / f"in/{len(list((base / 'in').iterdir()))}.txt").write_text("".join(LINE % t for t in texts))
    rows = tail(spark, f"file://{base}/in", f"file://{base}/check").withColumn("seq", F.col("at"))
    query = once_counted(follow.denials(rows), quiet).writeStream.format("parquet").option("path", f"file://{base}/out").option("checkpointLocation", f"file://{base}/check").start()
    try:
        if not quiet:
            query.processAllAvailable()
        for _ in range(40 if quiet else 0):  # with timers there is always another batch
            time.sleep(0.5)
            if (base / "out").exists() and spark.read.schema(COUNTED).parquet(f"file://{base}/out").where("kind = 'ended'").count():
                break
    finally:
        query.stop()
    return Counter((r.kind, json.loads(r.record)["perms"][0] if r.record else None, r.n) for r in spark.read.schema(COUNTED).parquet(f"file://{base}/out").collect())


COUNTED = "fp string, kind string, record string, n bigint"


def test_repeats_are_counted_across_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert counted(spark, tmp_path, ["a", "b", "a", "a"]) == Counter({("first", "a", 1): 1, ("first", "b", 1): 1, ("repeats", None, 2): 1})
    assert counted(spark, tmp_path, ["a", "c"]) == Counter({("first", "a", 1): 1, ("first", "b", 1): 1, ("first", "c", 1): 1, ("repeats", None, 2): 1, ("repeats", None, 1): 1})


def test_a_quiet_access_ends_and_tells_its_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = counted(spark, tmp_path, ["a"] * 5, quiet=1000)
    assert got[("ended", "a", 4)] == 1 and got[("first", "a", 1)] == 1


def guard_rows(seed, n=120, devices=3):
    rng = random.Random(seed)
    return [(str(rng.randrange(devices)), i, rng.choices(("record", "on", "off", "snapshot"), (8, 2, 1, 1))[0], f"f{rng.randrange(4)}", f"r{i}") for i in range(n)]


def plain_guard(rows, most):
    """Sessions one row at a time."""
    state, out = {}, []
    for device, seq, what, fp, record in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(device, {"session": 0, "open": False, "seen": set(), "held": [], "emitted": 0, "repeats": 0})
        if what == "on" and not s["open"]:
            s.update(session=s["session"] + 1, open=True, seen=set(), held=[], emitted=0, repeats=0)
        elif what == "off" and s["open"]:
            out.append((device, s["session"], "closed", seq, None, s["emitted"], s["repeats"]))
            s["open"] = False
        elif what == "snapshot" and s["open"]:
            out += [(device, s["session"], "snapshot", q, r, s["emitted"], s["repeats"]) for q, r in s["held"][-most:]]
        elif what == "record" and s["open"]:
            s["held"].append((seq, record))
            if fp in s["seen"]:
                s["repeats"] += 1
            else:
                s["emitted"] += 1
                out.append((device, s["session"], "record", seq, record, s["emitted"], s["repeats"]))
            s["seen"].add(fp)
    return Counter(out), state


def test_guard_sessions_over_batches(spark, tmp_path):
    rows = guard_rows(3)
    schema = "device string, seq long, what string, fp string, record string"
    for k in range(3):  # a file a batch
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        query = guard(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), 4).writeStream.format("parquet")
        query.option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = Counter(map(tuple, spark.read.schema("device string, session long, kind string, seq long, record string, emitted long, repeats long").parquet(f"file://{tmp_path}/out").collect()))
    assert got == plain_guard(rows, 4)[0] and any(k[2] == "snapshot" for k in got)


def test_sessions_at_rest_by_segments(spark):
    rows = guard_rows(5, n=400)
    df = spark.createDataFrame(rows, "device string, seq long, what string, fp string, record string").repartition(3)
    want = {}
    state = {}
    for device, seq, what, fp, _ in rows:
        session, open_ = state.get(device, (0, False))
        if what == "on":
            session, open_ = session + (not open_), True
        elif what == "off":
            open_ = False
        state[device] = (session, open_)
        want[seq] = (session, open_)
    for segment in (1, 7, 64, 1000):
        assert {r.seq: (r.session, r.open) for r in sessions(df, segment).collect()} == want
    held = sessions(df, 7)
    newest_ = Counter((r.device, r.session) for r in newest(held, 2).collect())
    records = Counter((d, want[s][0]) for d, s, w, _, _ in rows if w == "record" and want[s][1])
    assert newest_ == Counter({k: min(n, 2) for k, n in records.items()})
    assert {(r.device, r.session): r.records for r in session_report(held).collect()} == records
    assert sessions(df.limit(0)).count() == 0


def test_session_runs_while_the_switch_is_on(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    (folder / "a.txt").write_text(LINE % "open" + LINE % "open" + LINE % "read")
    parsed = follow.once(lines_of(spark, folder).drop("seq"))
    held, end = {}, time.time() + 60

    def start():
        held["query"] = follow.follow(parsed, out, f"file://{tmp_path}/check")
        return held["query"]

    def on():
        return time.time() < end and not any(p["numInputRows"] for p in held["query"].recentProgress)

    query = follow.session(start, on)
    assert not query.isActive
    assert written(spark, out) == ["open", "read"]


def test_snapshot_takes_the_newest(spark):
    rows = sample.syn_a(spark, "/root/testdata/sf0.001")
    got = [r.seq for r in follow.snapshot(rows, 5).collect()]
    most = rows.agg(F.max("seq")).first()[0]
    assert got == list(range(most, most - 5, -1))
