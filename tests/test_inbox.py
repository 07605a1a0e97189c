import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import inbox, kpi, overrides
from ticketloom.operators.ids import assign_ids
from ticketloom.operators.keywords import keyword_department
from ticketloom.sources.store import TicketStore
from ticketloom.taxonomy import DEPARTMENT_KEYWORDS, TAXONOMY, load_taxonomy

T0 = dt.datetime(2024, 1, 1, 10)


def as_of(text):
    return F.lit(text).cast("timestamp")


def test_taxonomy_keys_replace_whole(tmp_path):
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "t.yaml"
    path.write_text("urgency:\n  U1: {label: Now, sla_hours: 2}\nabstain_threshold: 0.6\n", encoding="utf-8")
    changed = load_taxonomy(path)
    assert changed.sla_hours == {"U1": 2} and changed.abstain_threshold == 0.6
    assert changed.departments == TAXONOMY.departments and len(TAXONOMY.departments) == 7
    for wrong in (": : :", "[1]", "departmnets: [A]", "departments: A", "abstain_threshold: high", "urgency: {U: {label: x}}"):
        path.write_text(wrong, encoding="utf-8")
        with pytest.raises((ValueError, yaml.YAMLError)):
            load_taxonomy(path)
    with pytest.raises(FileNotFoundError):
        load_taxonomy(tmp_path / "none.yaml")
    assert "Other / Unknown" not in TAXONOMY.routeable


def test_round_trip(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path / "s"))
    TicketStore(spark, str(tmp_path / "s"))
    row = [("hello", "web", "en", "Feedback / General", "P4", 0.9, False, "sklearn", "thanks", T0)]
    names = "text string, channel string, language string, department string, urgency string, confidence double, needs_human boolean, source string, suggested_reply string, created_at timestamp"
    stored = store.insert(spark.createDataFrame(row, names)).collect()
    assert [(r.id, r.status, r.reply, r.sla_hours) for r in stored] == [(1, "open", "thanks", 72)]
    listed = inbox.list_tickets(store.tickets(), as_of("2024-01-01 10:00:30")).collect()
    assert listed[0].id == 1 and listed[0].sla_remaining_min == 72 * 60 - 1
    fix = spark.createDataFrame(
        [(1, 1, T0, "Billing & Payments", "P3", "fix"), (2, 99, T0, "Billing & Payments", "P3", "no such ticket")],
        "id bigint, ticket_id bigint, ts timestamp, override_dept string, override_urg string, note string",
    )
    logged, rejected = store.override(fix)
    assert [(r.pred_dept, r.pred_urg) for r in logged.collect()] == [("Feedback / General", "P4")]
    assert [r.ticket_id for r in rejected.collect()] == [99]
    now = inbox.get_ticket(store.tickets(), 1).collect()[0]
    assert (now.department, now.urgency, now.status, now.needs_human) == ("Billing & Payments", "P3", "overridden", False)
    assert now.due_at == T0 + dt.timedelta(hours=24)
    metrics = {(r.metric, r.key): r.value for r in kpi.analytics(store.tickets(), store.overrides()).collect()}
    assert metrics["n_tickets", None] == 1 and metrics["n_overrides", None] == 1 and metrics["override_rate", None] == 1.0
    second, _ = store.override(fix.filter("ticket_id = 1").withColumn("override_dept", F.lit("Other / Unknown")))
    assert [(r.id, r.pred_dept) for r in second.collect()] == [(2, "Billing & Payments")]
    store.snapshot(str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1


def test_rewriting_a_batch_changes_nothing(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path / "s"))
    rows = spark.range(10).select(F.concat(F.lit("t"), "id").alias("text"), F.lit("P1").alias("urgency"), "id")
    for batch in (1, 2, 2, 1):
        store.insert(rows.withColumnRenamed("id", "n"), batch, ["n"])
    assert sorted(r.id for r in store.raw_tickets().collect()) == list(range(1, 21))


def test_filters_and_choices(spark):
    rows = spark.createDataFrame(
        [(1, "A", "en", "P1", True), (2, "A", "hi", "P2", False), (3, "B", "en", "P1", False)],
        "id bigint, department string, language string, urgency string, needs_human boolean",
    ).withColumn("due_at", F.lit(None).cast("timestamp"))
    ids = lambda **kw: [r.id for r in inbox.list_tickets(rows, as_of("2024-01-01"), **kw).collect()]
    assert ids() == [3, 2, 1] and ids(limit=2) == [3, 2]
    assert ids(department="A", language="") == [2, 1] and ids(urgency="P1", needs_human=False) == [3]
    assert ids(needs_human=True) == [1] and ids(department="none") == []
    assert inbox.choice("(all)") is None and inbox.choice("x") == "x"
    assert inbox.human_choice("needs human") is True and inbox.human_choice("auto") is False and inbox.human_choice("(all)") is None
    assert inbox.keep_columns(rows, ["urgency", "missing", "id"]).columns == ["urgency", "id"]
    assert inbox.list_tickets(rows, as_of("2024-01-01")).collect()[0].sla_remaining_min is None


def test_sla_clock_rounds_down_when_overdue(spark):
    rows = spark.createDataFrame([(1, T0)], "id bigint, due_at timestamp")
    got = inbox.with_sla_clock(rows, as_of("2024-01-01 10:00:01")).collect()[0]
    assert got.sla_remaining_min == -1


def test_empty_inbox_kpis(spark):
    empty = spark.createDataFrame([], "department string, language string, needs_human boolean")
    got = {(r.metric, r.key): r.value for r in kpi.analytics(empty, spark.createDataFrame([], "id bigint")).collect()}
    assert got == {(m, None): 0.0 for m in ("n_tickets", "n_overrides", "n_needs_human", "override_rate", "needs_human_rate")}


def test_missing_department_is_a_group(spark):
    rows = spark.createDataFrame([(None, "en", True), ("A", None, False)], "department string, language string, needs_human boolean")
    got = {(r.metric, r.key): r.value for r in kpi.analytics(rows, spark.range(3)).collect()}
    assert got["by_department", None] == 1 and got["by_language", None] == 1 and got["override_rate", None] == 1.5


def test_audit_chain_with_one_hot_ticket(spark):
    """Small blocks and salts: the chain must not depend on how the log is cut."""
    tickets = spark.range(1, 6).select("id", F.lit("D0").alias("department"), F.lit("U0").alias("urgency"))
    log = spark.range(1, 301).select(
        "id",
        F.when(F.col("id") % 3 != 0, F.lit(2)).otherwise(F.col("id") % 7).alias("ticket_id"),
        F.lit(T0).alias("ts"),
        F.concat(F.lit("D"), "id").alias("override_dept"),
        F.concat(F.lit("U"), "id").alias("override_urg"),
        F.lit("").alias("note"),
    )
    want, last = {}, {}
    for r in sorted(log.collect(), key=lambda r: r.id):
        if 1 <= r.ticket_id <= 5:
            want[r.id] = last.get(r.ticket_id, ("D0", "U0"))
            last[r.ticket_id] = (r.override_dept, r.override_urg)
    got = overrides.audit_log(log, tickets, id_block=16, rows_per_salt=10).collect()
    assert {r.id: (r.pred_dept, r.pred_urg) for r in got} == want and len(got) == len(want)
    listed = overrides.list_overrides(log, 3).collect()
    assert [r.id for r in listed] == [300, 299, 298]


def test_ids_are_gap_free_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(13)
    got = {r.k: r.id for r in assign_ids(rows, base=50, order_by=["k"]).collect()}
    assert got == {k: 51 + k for k in range(1000)}
    loose = [r.id for r in assign_ids(rows).collect()]
    assert sorted(loose) == list(range(1, 1001))


def test_keyword_baseline(spark):
    texts = ["My company needs help", "otp", "nothing here", None, "refund UPI login", "crash app fake phishing scam"]

    def python(text):
        low = (text or "").lower()
        scores = {d: sum(k in low for k in ws) for d, ws in DEPARTMENT_KEYWORDS.items()}
        return max(scores, key=scores.get) if max(scores.values()) else "Feedback / General"

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    assert [r[0] for r in rows.select(keyword_department(F.col("text"))).collect()] == [python(t) for t in texts]


def test_upload_rejects_under_any_projection(spark, tmp_path):
    from ticketloom.sources.files import read_upload_with_rejects

    (tmp_path / "a.csv").write_text('id,text,channel\nT1,   ,x\nT2, good  ,\nT4,"",c\nT5,"a ""b"", c",d\n')
    (tmp_path / "b.csv").write_text("id,text,channel\nT3,only,hi,more\nT9,few\n")
    accepted, rejected = read_upload_with_rejects(spark, str(tmp_path), ["id", "text", "channel"])
    assert sorted((r.id, r.text) for r in accepted.collect()) == [("T2", "good"), ("T5", 'a "b", c')]
    want = [("blank", ""), ("blank", "   "), ("malformed", "T3,only,hi,more"), ("malformed", "T9,few")]
    assert sorted((r.reason, r.record) for r in rejected.select("reason", "record").collect()) == want
    assert sorted((r.id or "", r.reason) for r in rejected.collect()) == [("", "malformed"), ("", "malformed"), ("T1", "blank"), ("T4", "blank")]
    assert accepted.select("id").count() == 2
    accepted, rejected = read_upload_with_rejects(spark, str(tmp_path / "a.csv"), ["first", "second", "third"])
    assert accepted.count() == 4 and {r.text for r in accepted.collect()} == {"T1", "T2", "T4", "T5"} and rejected.count() == 0
