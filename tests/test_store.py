import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticketloom.sources.store import TicketStore
from ticketloom.streaming.arrivals import department_counts, publish_counts, read_counts, store_arrivals

EVENT = "ext_id string, text string, created_at timestamp, department string"
DAY = dt.datetime(2024, 1, 1, 10)


def arrivals(spark, first, n):
    rows = [(str(i), f"ticket {i}", DAY + dt.timedelta(minutes=i), "Billing & Payments") for i in range(first, first + n)]
    return spark.createDataFrame(rows, EVENT)


def run_stream(spark, store, folder, checkpoint):
    stream = spark.readStream.schema(EVENT).parquet(folder)
    store_arrivals(stream, store, lambda rows: rows, checkpoint, ["created_at"]).awaitTermination()


def test_uploads_and_streams_keep_each_others_rows(spark, tmp_path):
    store, folder = TicketStore(spark, str(tmp_path / "s")), str(tmp_path / "in")
    store.insert(arrivals(spark, 0, 50))
    arrivals(spark, 50, 7).repartition(3).write.parquet(folder)  # a folder of part files
    run_stream(spark, store, folder, str(tmp_path / "c1"))
    store.insert(arrivals(spark, 57, 4))
    arrivals(spark, 61, 5).write.mode("append").parquet(folder)
    run_stream(spark, store, folder, str(tmp_path / "c1"))
    run_stream(spark, store, folder, str(tmp_path / "c2"))  # a new checkpoint reads everything again
    rows = store.raw_tickets().collect()
    assert sorted(r.id for r in rows) == list(range(1, 79))
    assert sorted(int(r.ext_id) for r in rows) == sorted([*range(66), *range(50, 57), *range(61, 66)])


def test_two_writers_get_different_ids(spark, tmp_path):
    a, b = (TicketStore(spark, str(tmp_path / "s")) for _ in range(2))
    first = a.number(arrivals(spark, 0, 5), 0, writer="a")
    second = b.number(arrivals(spark, 5, 5), 0, writer="b")
    b.insert(second, 0, numbered=True, writer="b")
    a.insert(first, 0, numbered=True, writer="a")
    assert sorted(r.id for r in a.raw_tickets().collect()) == list(range(1, 11))


def test_a_batch_written_again_replaces_only_itself(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path / "s"))
    for _ in range(2):
        store.insert(arrivals(spark, 0, 3), 7, writer="w")
        store.insert(arrivals(spark, 3, 2), 8, writer="w")
    rows = store.raw_tickets().collect()
    assert sorted(r.id for r in rows) == [1, 2, 3, 4, 5] and sorted(r.ext_id for r in rows) == list("01234")


def test_replayed_corrections_are_not_compared_with_themselves(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path / "s"))
    store.insert(arrivals(spark, 0, 2))
    schema = "id bigint, ticket_id bigint, ts timestamp, override_dept string, override_urg string, note string"
    fix = spark.createDataFrame([(1, 1, DAY, "X", "P1", "")], schema)
    for _ in range(3):
        logged, _ = store.override(fix, 1, "w")
        assert logged.first().pred_dept == "Billing & Payments"
    later, _ = store.override(fix.withColumn("override_dept", F.lit("Y")))
    assert later.first().pred_dept == "X" and store.overrides().count() == 2
    given, _ = store.override(fix.withColumn("pred_dept", F.lit("Seen")))
    assert given.first().pred_dept == "Seen"


def test_writers_that_claim_the_same_ids_move(spark, tmp_path, monkeypatch):
    a, b = (TicketStore(spark, str(tmp_path / "s")) for _ in range(2))
    checked = TicketStore._alone

    def late(self, table, key, first, n):
        """Another writer's claim of the same ids comes in between claim and check, once."""
        monkeypatch.setattr(TicketStore, "_alone", checked)
        b._replace(table, "ranges", spark.createDataFrame([(first, 4)], "first bigint, n bigint"), ("b", 0))
        return checked(self, table, key, first, n)

    monkeypatch.setattr(TicketStore, "_alone", late)
    assert a._first_id("tickets", ("a", 0), 10) == 11
    assert b._first_id("tickets", ("b", 0), 4) == 1 and a._first_id("tickets", ("a", 0), 10) == 11
    assert b._first_id("tickets", ("b", 0), 5) == 21  # other rows under the same key get ids of their own


def test_a_batch_written_again_without_rows_is_empty(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path / "s"))
    store.insert(arrivals(spark, 0, 3), 0, writer="7")
    store.insert(arrivals(spark, 3, 2), 0, writer="007")
    assert store.insert(arrivals(spark, 0, 0), 0, writer="7").count() == 0
    assert sorted(r.id for r in store.raw_tickets().collect()) == [4, 5]
    assert store.insert(arrivals(spark, 5, 1), 1, writer="7").first().id == 6


@pytest.mark.parametrize("parts", [1, 3])
def test_live_counts_follow_late_rows(spark, tmp_path, parts):
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")

    def arrive(days):
        rows = [(f"{d}", "t", DAY + dt.timedelta(days=d), "A") for d in days]
        spark.createDataFrame(rows, EVENT).repartition(parts).write.mode("append").parquet(folder)
        counts = department_counts(spark.readStream.schema(EVENT).parquet(folder))
        query = publish_counts(counts, out, checkpoint)
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return {r.window_start.day: r.n for r in read_counts(spark, out).collect()}, state[-1]

    assert arrive([0, 0, 1]) == ({1: 2, 2: 1}, pytest.approx(2, abs=1))
    shown, state = arrive([5])
    assert shown == {1: 2, 2: 1, 6: 1}
    shown, state = arrive([0, 5])  # the first is days late and dropped
    assert shown == {1: 2, 2: 1, 6: 2} and state == 1


def test_rows_are_counted_without_the_join_that_numbers_them(spark, tmp_path, monkeypatch):
    kind, plans = type(spark.range(1)), []
    counted = kind.count
    monkeypatch.setattr(kind, "count", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or counted(df))
    store = TicketStore(spark, str(tmp_path / "s"))
    store.insert(arrivals(spark, 0, 9).repartition(3), order_by=["created_at"])
    store.insert(arrivals(spark, 9, 4))
    monkeypatch.undo()
    assert plans and not [p for p in plans if "Join" in p]
    assert sorted((r.id, r.ext_id) for r in store.raw_tickets().collect())[:9] == [(i + 1, str(i)) for i in range(9)]
    assert store.raw_tickets().agg(F.max("id")).first()[0] == 13
