"""Synchronised rounds over several batches of a stream."""

from pyspark.sql import functions as F

from sparkloom.sources.shared import new_path
from sparkloom.streaming import events, sync

MINUTE = 60_000


def plain(changes, quiet, mark):
    """(user, round, start, changes, keys, written) by going through each user's changes in order."""
    out = []
    for user in sorted({c[0] for c in changes}):
        rows = sorted(c[1:] for c in changes if c[0] == user)
        rounds = []
        for ms, i, k, v in rows:
            if rounds and ms - rounds[-1][-1][0] <= quiet:
                rounds[-1].append((ms, i, k, v))
            else:
                rounds.append([(ms, i, k, v)])
        held = {}
        for n, r in enumerate(rounds, 1):
            if r[-1][0] + quiet > mark:
                continue
            new = {k: v for _, _, k, v in r}
            changed = sum(k not in held or held[k] != v for k, v in new.items())
            held |= new
            if changed:
                out.append((user, n, r[0][0], len(r), len(new), changed))
    return out


def test_batches(spark):
    """Changes in several files, out of order within them; rounds that span batches; values that come back."""
    m = lambda x: 1_700_000_000_000 + int(x * MINUTE)
    batches = [
        [(1, m(0), 1, "a", "x"), (1, m(3), 2, "a", "y"), (2, m(1), 3, "a", "x"), (1, m(2), 4, "b", "x")],
        [(1, m(5), 5, "a", "x"), (2, m(30), 6, "a", "x"), (3, m(31), 7, "c", None)],
        [(1, m(60), 8, "a", "x"), (2, m(61), 9, "b", "z"), (1, m(63), 10, "b", "q"), (1, m(62), 11, "b", "x"), (1, m(62), 12, "b", "r")],
        [(3, m(200), 13, "c", "1"), (4, m(200), 14, "c", "1"), (1, m(200), 15, "a", "x")],
        [(5, m(400), 16, "k", "v")],
    ]
    path = new_path(spark, "changes")
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "user_id long, ms long, id long, key string, value string").withColumn("at", F.timestamp_millis("ms"))
        frame.coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    stream = spark.readStream.schema(sync.CHANGE).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")
    with sync.with_rocks(spark):
        got = events.run(sync.rounds(stream, 10 * MINUTE, "1 minute"), spark, "sync", "append").collect()
    want = plain([c for b in batches for c in b], 10 * MINUTE, m(399))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 7


def test_settings_come_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with sync.with_rocks(spark):
        assert spark.conf.get(name) == sync.ROCKS
    assert spark.conf.get(name, None) == before
