"""Addresses against the standard library, mastery against a fold of one list, streaks where clocks change."""

import datetime as dt
import ipaddress
import random

from pyspark.sql import functions as F

from tessella.functions import addresses as A
from tessella.functions import text as T
from tessella.operators import mastery as M


def test_addresses_are_read_and_classed_as_the_standard_library_does(spark):
    rng = random.Random(4)
    texts = ["", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.4 ", "::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:8.8.8.256", "64:ff9b::8.8.8.8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "g::", "12345::", ":1:2:3:4:5:6:7", "FE80::ABCD", "999999999999.1.1.1", "1.2.3.4::", "::1.2.3.4:5"]
    for net in map(ipaddress.ip_network, (*A.LOCAL, *A.REACHABLE, "0.0.0.0/0", "::/0", "2001::/16")):
        for at in {int(net[0]), int(net[-1]), int(net[0]) - 1, int(net[-1]) + 1, *(rng.randint(int(net[0]), int(net[-1])) for _ in range(5))}:
            if 0 <= at < 2 ** net.max_prefixlen:
                texts.append(str(ipaddress.IPv4Address(at) if net.version == 4 else ipaddress.IPv6Address(at)))
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("d", A.digits(F.col("t")))
    for r in df.withColumn("reachable", A.reachable(F.col("d"))).collect():
        try:
            want = ipaddress.ip_address(r.t)
        except ValueError:
            want = None
        assert r.d == (want and want.packed.hex()), r.t
        assert r.reachable == (want and want.is_global), r.t


def test_web_targets(spark):
    good = ["http://h.org", "https://8.8.8.8:80/x", "http://[2a00::1]/", "HTTPS://H"]
    bad = ["ftp://h.org", "http://", "http://u@h.org", "http://127.0.0.1", "http://[::1]:80/", "http://[fe80::1]", "http://[::ffff:10.1.1.1]/", "http://localhost", "http://[x]/", "h.org", "http://192.168.0.9/a", "http://100.64.1.1"]
    got = {r.u: r.ok for r in spark.createDataFrame([(u,) for u in good + bad], "u string").select("u", T.web_target(F.col("u")).alias("ok")).collect()}
    assert got == {u: True for u in good} | {u: False for u in bad}


EVIDENCE = "user_id long, point_id string, at timestamp_ntz, event_id long, mode string, passed boolean, replaces long"


def test_mastery_is_a_fold_with_decay(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), f"p{rng.randrange(3)}", start + dt.timedelta(hours=rng.randrange(2000)), k, rng.choice(["easy", "medium", "hard", "odd", None]), rng.choice([True, True, False, None]), None) for k in range(400)]
    want = {}
    for user, point, at, _, mode, passed, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        if mode in M.GUESS and passed is not None:
            p, h, last, once, n = want.get((user, point), (0.2, 7.0, at, False, 0))
            p = 0.05 + (p - 0.05) * 2 ** (-(at - last).total_seconds() / 86400 / h) if n else p
            p = M.updated(p, passed, mode)
            h = 7.0 if passed and not once else min(180, max(0.5, h * {"easy": (0.9, 1.2), "medium": (0.6, 1.6), "hard": (0.5, 2.0)}[mode][passed])) if once else h
            want[user, point] = (p, h, at, once or passed, n + 1)
    got = {(r.user_id, r.point_id): r for r in M.projected(spark.createDataFrame(rows, EVIDENCE)).collect()}
    assert got.keys() == want.keys()
    for key, (p, h, at, _, n) in want.items():
        r = got[key]
        assert abs(r.mastery - p) < 1e-9 and abs(r.half_life - h) < 1e-9 and r.evaluated_at == at and r.n == n
    assert M.projected(spark.createDataFrame([], EVIDENCE)).isEmpty()


def test_evidence_moves_mastery_by_its_mode():
    low, high = M.updated(0.2, True, "easy"), M.updated(0.2, True, "hard")
    assert 0.2 < low < M.updated(0.2, True, "medium") < high < 0.98
    assert M.updated(0.98, False, "hard") > 0.3 and M.updated(0.98, True, "hard") == 0.98 and M.updated(0.05, False, "hard") >= 0.05


def test_corrections_are_replayed(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "p", day(1), 1, "hard", False, None), (1, "p", day(2), 2, "hard", True, None), (1, "p", day(3), 3, "hard", True, 1), (1, "p", day(4), 4, None, None, 2)]
    left = M.without_replaced(spark.createDataFrame(rows, EVIDENCE))
    assert {r.event_id for r in left.collect()} == {3, 4}
    (r,) = M.projected(left).collect()
    assert abs(r.mastery - M.updated(0.2, True, "hard")) < 1e-12 and r.n == 1 and r.half_life == 7.0


def test_streaks_follow_local_days(spark):
    at = lambda *x: dt.datetime(2024, *x)
    rows = [
        (1, "Europe/Berlin", at(3, 30, 2, 59)),  # 03:59 there: the day before
        (1, "Europe/Berlin", at(3, 31, 1, 59)),  # 03:59 summer time: the 30th
        (1, "Europe/Berlin", at(3, 31, 2, 0)),  # 04:00 summer time: the 31st
        (2, "America/New_York", at(3, 10, 7, 59)), (2, "America/New_York", at(3, 10, 8, 0)), (2, "America/New_York", at(3, 12, 9, 0)),
        (3, "UTC", at(3, 1, 12, 0)), (3, "UTC", at(3, 1, 13, 0)),
    ]
    days = spark.createDataFrame(rows, "user_id int, zone string, at timestamp_ntz").select("user_id", M.learning_day(F.col("at"), F.col("zone")).alias("day"))
    assert sorted((r.user_id, str(r.day)) for r in days.collect()) == [(1, "2024-03-29"), (1, "2024-03-30"), (1, "2024-03-31"), (2, "2024-03-09"), (2, "2024-03-10"), (2, "2024-03-12"), (3, "2024-03-01"), (3, "2024-03-01")]
    got = {r.user_id: (r.n_days, r.longest, r.current) for r in M.streaks(days, F.lit("2024-04-01").cast("date")).collect()}
    assert got == {1: (3, 3, 3), 2: (3, 2, 0), 3: (1, 1, 0)}


def test_grades_over_the_criteria_that_count(spark):
    from tessella.operators import reviews as W

    full = [("a", c, 3, False, False) for c in W.WEIGHTS]  # 75
    rows = full + [("b", "accuracy", 1, False, False), ("b", "coverage", 4, False, False), ("b", "mechanism", 4, False, False), ("c", "accuracy", 4, True, False), ("c", "coverage", 3, False, False), ("c", "unknown", 0, False, True), ("d", "accuracy", 4, False, True), ("e", "accuracy", 9, True, None), ("f", "accuracy", None, None, None), ("g", "accuracy", 2, False, False), ("g", "coverage", 4, False, False), ("g", "boundaries", 3, False, False)]
    got = {r.attempt_id: (r.score, r.passed) for r in W.graded(spark.createDataFrame(rows, "attempt_id string, criterion string, points int, disabled boolean, severe boolean")).collect()}
    assert got == {"a": (75.0, True), "b": (70.0, False), "c": (75.0, True), "d": (100.0, False), "e": (None, False), "f": (0.0, False), "g": (100 * 190 / 260, True)}


def test_reviews_come_due(spark):
    from tessella.operators import reviews as W

    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(at, 0.2, True, True), (at, 0.9, False, False), (at, 0.8, False, True), (at, 0.05, False, True)], "at timestamp_ntz, p double, first boolean, passed boolean")
    due = [r.due - at for r in df.select(W.next_review(F.col("at"), F.col("p"), F.col("first"), F.col("passed")).alias("due")).collect()]
    assert due == [dt.timedelta(hours=12), dt.timedelta(minutes=30), dt.timedelta(days=7), dt.timedelta(hours=12)]
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    rows = [("low", 1, None, False, None, 0.2, True), ("high", 1, None, False, None, 0.9, True), ("again", 9, None, True, 9, 0.9, True), ("off", 1, 20, False, None, 0.2, True), ("back", 1, 5, False, 3, 0.9, True), ("later", 11, None, True, 9, 0.2, True), ("gone", 1, None, True, 9, 0.2, False)]
    day = lambda d: d and dt.datetime(2024, 1, d)
    points = spark.createDataFrame([("u", "t", p, day(due), day(off), retry, day(failed), m, 7.0, at, ok) for p, due, off, retry, failed, m, ok in rows], "user_id string, topic_id string, point_id string, next_review_at timestamp_ntz, defer_until timestamp_ntz, remedial boolean, failed_at timestamp_ntz, mastery double, half_life double, evaluated_at timestamp_ntz, available boolean")
    assert [r.point_id for r in W.offered(points, now).orderBy("rank").collect()] == ["again", "low", "back", "high"]


def test_fusion_ties_go_to_the_better_rank(spark):
    from tessella.operators import retrieval as R

    dense, sparse = (spark.createDataFrame(x, "id string, rank int") for x in ([("a", 3), ("b", 1), ("c", 2)], [("a", 3), ("z", 1), ("y", 2)]))
    chunks = spark.createDataFrame([(i, "p" + i) for i in "abcyz"], "id string, parent_chunk_id string")
    assert [r.parent_chunk_id for r in R.fuse(dense, sparse, chunks, 5).orderBy("rank").collect()] == ["pa", "pb", "pz", "pc", "py"]
    level = R.fuse(spark.createDataFrame([("a", 2), ("b", 1)], "id string, rank int"), spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int"), chunks, 5, by_rank=True)
    assert [r.parent_chunk_id for r in level.orderBy("rank").collect()] == ["pa", "pb"]
