"""Commits by several writers, and logs whose numbers come from them."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from rillstone.operators import review
from rillstone.schemas import NODES, REVIEW_EVENTS
from rillstone.sources.commits import CommitLog, EventLog
from rillstone.sources.store import RunStore


def test_no_number_is_taken_twice(spark, tmp_path):
    logs = [CommitLog(spark, str(tmp_path / "log")) for _ in range(4)]
    write = lambda i: [logs[i].commit(lambda n, before: {"who": i, "k": k, "sum": (before or {"sum": 0})["sum"] + 1}) for k in range(6)]
    with ThreadPoolExecutor(4) as pool:
        got = sorted(n for part in pool.map(write, range(4)) for n in part)
    assert got == list(range(1, 25)) and logs[0].last()[1]["sum"] == 24
    assert {(m["who"], m["k"]) for m in map(logs[0].read, got)} == {(i, k) for i in range(4) for k in range(6)}
    logs[0].forget(24)
    assert logs[1].numbers() == [24]


def test_two_writers_lose_no_event(spark, tmp_path):
    def write(i):
        log = EventLog(spark, str(tmp_path / "events"), "seq")
        for k in range(4):
            log.append(spark.createDataFrame([(i, k, x) for x in range(5 + i)], "who int, k int, x int"), ["k", "x"])
            if k == 2 and i:
                try:
                    log.compact()
                except RuntimeError:  # compacted by another one
                    pass

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, range(2)))
    log = EventLog(spark, str(tmp_path / "events"), "seq")
    for _ in range(2):
        rows = log.read().orderBy("seq").collect()
        assert [r["seq"] for r in rows] == list(range(1, 4 * 11 + 1))
        assert {(r["who"], r["k"], r["x"]) for r in rows} == {(i, k, x) for i in range(2) for k in range(4) for x in range(5 + i)}
        # rows of one append follow each other in their order
        for i in range(2):
            assert [(r["k"], r["x"]) for r in rows if r["who"] == i] == [(k, x) for k in range(4) for x in range(5 + i)]
        log.compact()
    assert len(log.log.last()[1]["parts"]) == 1
    assert EventLog(spark, str(tmp_path / "none")).read() is None


def test_last_run_counts_and_rows_are_counted_while_written(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    nodes = spark.createDataFrame([("a", "f", 0, 0, "function", "a", 1, 1, True, "h", None)], NODES)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda r: RunStore(spark, str(tmp_path / "store")).write(r, {"nodes": nodes}), ["r1", "r2"]))
    assert store.current() in ("r1", "r2") and len(store.log.numbers()) == 2
    assert store.write("r3", {"nodes": nodes.unionByName(nodes), "none": nodes.limit(0)}) == {"nodes": 2, "none": 0}
    assert {r["table"]: r["rows"] for r in store.summary().collect()} == {"nodes": 2, "none": 0} and store.read("nodes", NODES).count() == 2


def test_numbers_of_events_stay_the_same(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    log = spark.createDataFrame([], REVIEW_EVENTS)
    nodes = spark.range(50).select(F.concat(F.lit("n"), F.col("id")).alias("node_identity"), F.lit("h").alias("content_hash"))
    once = review.append(log, review.set_status(nodes, "approved", None, "me", at))
    twice = review.append(once, review.set_status(nodes.limit(3), "rejected", None, "me", at))
    first, again = (sorted((r["event_seq"], r["node_identity"]) for r in twice.collect()) for _ in range(2))
    assert first == again and [s for s, _ in first] == list(range(1, 54))
