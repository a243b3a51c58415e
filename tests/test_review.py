"""Decisions, totals, audit, views and erasure."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.operators import combine, review
from tallyspark.plans.review import review_state

FINDINGS = "ledger_id string, rule_ordinal int, rule_id string, severity string, amount_at_stake decimal(18,4), invoice_ids array<string>, explanation string, finding_key string"
EVENTS = "ledger_id string, finding_key string, action string, who string, at timestamp, seq int, reason string"
LEDGERS = "id string, namespace string, name string, created_at timestamp, row_count long, owner_email string"
T0 = datetime(2026, 1, 1)


def tables(spark):
    make = lambda ledger, key, stake, ids: (ledger, 0, "exact-duplicate", "high", Decimal(stake), ids, f"{key} told.", key)
    findings = spark.createDataFrame([make("l", f"k{i}", 10 * (i + 1), [f"r{i}", "r9"]) for i in range(5)] + [make("m", "k0", 7, ["r0"])], FINDINGS)
    at = lambda n: T0 + timedelta(minutes=n)
    events = [
        ("l", "k0", "accepted", "pat", at(1), 1, None), ("l", "k1", "rejected", "pat", at(2), 2, "  twice checked "), ("l", "k2", "accepted", "pat", at(3), 3, None), ("l", "k2", "reopen", "sam", at(3), 4, None),
        ("l", "k3", "rejected", "pat", at(5), 5, " "), ("l", "k9", "accepted", "pat", at(6), 6, None), ("m", "k1", "accepted", "pat", at(7), 7, None), ("l", "k4", "maybe", "pat", at(8), 8, None), ("l", "k1", "rejected", "pat", at(9), 9, "x" * 600),
    ]
    ledgers = [("l", "demo", "Demo", T0, 10, None), ("m", "uploads", "Mine", T0 + timedelta(days=1), 5, "Pat@x.org"), ("n", "uploads", "Nobody's", T0, 5, None)]
    return spark.createDataFrame(ledgers, LEDGERS), findings, spark.createDataFrame(events, EVENTS)


def test_state_and_totals(spark):
    ledgers, findings, events = tables(spark)
    state = review_state(ledgers, findings, events)
    decided = {r.finding_key: (r.decision, r.reason and len(r.reason)) for r in state.findings.where("ledger_id = 'l'").collect()}
    assert decided == {"k0": ("accepted", None), "k1": ("rejected", 500), "k2": (None, None), "k3": (None, None), "k4": (None, None)}
    assert review.open_findings(state.findings).count() == 4 and review.decided_findings(state.findings).count() == 2
    for t in state.totals.collect():
        assert t.open_count + t.accepted_count + t.rejected_count == t.all_count
        assert t.open_value + t.accepted_value + t.rejected_value == t.all_value
    assert sorted(r.refused for r in state.refused.collect()) == ["a rejection needs a reason", "no such finding on this ledger", "no such finding on this ledger", "unknown action"]
    audit = review.newest_first(state.audit).collect()
    assert len(audit) == 3 + 5 and audit[-1].action == "created" and any(r.detail == "exact-duplicate — k1 told. (twice checked)" for r in audit)
    assert {(r.ledger_id, r.who, r.detail) for r in audit if r.action == "created"} == {("l", "system", "10 invoices, 5 findings"), ("m", "system", "5 invoices, 1 finding"), ("n", "system", "5 invoices, 0 findings")}
    assert sorted(r.action for r in audit if r.action != "created") == ["accepted", "accepted", "rejected", "rejected", "reopened"]


def test_visibility_and_erasure(spark):
    ledgers, findings, events = tables(spark)
    totals = review_state(ledgers, findings, events).totals
    ids = lambda *viewer: [r.id for r in review.ledger_list(ledgers, totals, *viewer).collect()]
    assert ids(None) == ["l"] and ids("pat@X.org") == ["m", "l"] and ids("else@x.org") == ["l"] and ids("root@x.org", True) == ["m", "l", "n"]
    gone = review.erasable(ledgers, ["l", "m", "n"], "pat@x.org")
    left = review.without_ledgers({"ledgers": ledgers, "findings": findings, "events": events}, gone)
    assert {n: {r[0] for r in t.select(t.columns[0] if n != "ledgers" else "id").collect()} for n, t in left.items()} == {"ledgers": {"l", "n"}, "findings": {"l"}, "events": {"l"}}


def test_views(spark):
    _, findings, _ = tables(spark)
    rows = spark.createDataFrame([("l", f"r{i}", f"Acme {i % 2}", T0.date() + timedelta(days=i), Decimal(i), i, "GBP" if i else "EUR") for i in range(10)], "ledger_id string, id string, vendor_name string, invoice_date date, amount decimal(18,4), seq int, currency string")
    flags = review.flagged_rows(findings, rows)
    assert flags.where("flagged_by is not null").count() == 6
    stats = review.ledger_stats(flags, "ACME 1").first()
    assert (stats.rows_shown, stats.suppliers, stats.flagged, str(stats.first_date)) == (5, 2, 6, "2026-01-01")
    assert [r.id for r in review.rows_view(rows, " acme 1 ").collect()] == ["r1", "r3", "r5", "r7", "r9"]
    assert [r.id for r in review.evidence(findings, rows).where("finding_key = 'k3'").orderBy("pos").collect()] == ["r3", "r9"]
    assert review.ledger_currency(rows).first().currency is None and review.ledger_currency(rows.where("seq > 0")).first().currency == "GBP"
    mixed = review.totals_text(spark.createDataFrame([("l", Decimal(5))], "ledger_id string, all_value decimal(18,4)"), review.ledger_currency(rows)).first()
    assert mixed.all_text == "5.00 (mixed currencies)"


def test_known_problems_and_retention(spark):
    _, findings, _ = tables(spark)
    planted = spark.createDataFrame([("l", "exact-duplicate", ["r9", "r1"]), ("l", "exact-duplicate", ["r7"]), ("l", "unapplied-credit", ["r1"])], "ledger_id string, rule_id string, ids array<string>")
    traps = spark.createDataFrame([("l", "r0"), ("l", "r8")], "ledger_id string, id string")
    score = review.score_known(findings, planted, traps).where("ledger_id = 'l'").first()
    assert (score.planted, score.found, score.missed, score.traps_touched, score.unmatched) == (3, 1, 2, 1, 4)
    files = spark.createDataFrame([("a", T0), ("b", T0 - timedelta(hours=7))], "id string, created_at timestamp")
    assert [r.id for r in review.live_files(files, F.lit(T0)).collect()] == ["a"]


def test_equal_stakes_are_numbered_by_many_tasks(spark):
    from tallyspark.operators.combine import queued

    rows = [("l", i % 3, f"rule-{i % 3}", ("high", "low")[i % 2], Decimal(10), [f"r{i}"], "told", f"k{i:05d}") for i in range(3000)] + [("m", 0, "rule-0", "high", Decimal(i), [f"r{i}"], "told", f"k{i}") for i in range(5)]
    findings = spark.createDataFrame(rows, FINDINGS)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = queued(findings)
        largest = found.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        got = {(r.ledger_id, r.finding_key): r.queue_rank for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for ledger in "lm":
        own = sorted((r for r in rows if r[0] == ledger), key=lambda r: (r[3] != "high", -r[4], r[1], r[7]))
        want.update({(ledger, r[7]): k for k, r in enumerate(own, 1)})
    assert got == want and largest < 2500


def test_whole_review_queue(spark):
    from tallyspark import queries

    rows = queries.queries()["review_queue_all"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.queue_rank for r in rows) == list(range(1, 631))
    spark.catalog.clearCache()


def test_evidence_sends_each_key_once(spark):
    """The key of a finding names all its rows; it is not repeated with each of them before they meet their invoices."""
    ids = [f"r{i}" for i in range(300)]
    findings = spark.createDataFrame([("l", "rule:" + "+".join(ids), ids), ("l", "rule:r7", ["r7"]), ("l", "rule:r7", ["r7"])], "ledger_id string, finding_key string, invoice_ids array<string>")
    rows = spark.createDataFrame([("l", i, n) for n, i in enumerate(ids)], "ledger_id string, id string, amount int")
    found = review.evidence(findings, rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate posexplode" in line and "finding_key" in line]
    assert sorted((r.finding_key, r.pos, r.id, r.amount) for r in found.collect()) == sorted([(findings.first().finding_key, n, i, n) for n, i in enumerate(ids)] + [("rule:r7", 0, "r7", 7)] * 2)


def exchanged(frame):
    """The lines of a plan that read what an exchange moves."""
    lines = frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line for line in lines if "Generate explode(invoice_ids" in line or "Aggregate [ledger_id" in line]


def test_flags_do_not_carry_keys(spark):
    """The key of a finding is as long as its rows are many; each row got a copy of it."""
    _, findings, _ = tables(spark)
    rows = spark.createDataFrame([("l", f"r{i}") for i in range(10)], "ledger_id string, id string")
    flags = review.flagged_rows(findings, rows)
    assert exchanged(flags) and not [line for line in exchanged(flags) if "finding_key" in line]
    strong = findings.limit(1).withColumn("rule_ordinal", F.lit(6)).withColumn("rule_id", F.lit("round-number-outlier")).withColumn("severity", F.lit("low"))
    flagged = {r.id: r.flagged_by for r in review.flagged_rows(findings.unionByName(strong), rows).collect()}
    assert flagged["r9"] == "round-number-outlier" and flagged["r3"] == "exact-duplicate" and flagged["r5"] is None


def test_events_meet_findings_by_digest(spark):
    _, findings, events = tables(spark)
    plan = review.validated_events(events, findings).groupBy("refused").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "finding_key" not in plan.split("Join")[0] and "__digest" in plan


def test_first_of_the_queue(spark):
    """The first places are those of the whole queue, and no task sends more than them."""
    _, findings, _ = tables(spark)
    many = findings.union(findings.withColumn("amount_at_stake", F.col("amount_at_stake") + 1).withColumn("finding_key", F.concat("finding_key", F.lit("x"))))
    first = combine.first_queued(many, 3)
    assert "WindowGroupLimit" in first._jdf.queryExecution().optimizedPlan().toString()
    place = lambda rows: sorted((r.ledger_id, r.queue_rank, r.finding_key) for r in rows.collect())
    assert place(first) == place(combine.queued(many).where("queue_rank <= 3"))


def test_only_the_family_is_compared(spark):
    """Findings outside the duplicate family are not moved to be collapsed."""
    _, findings, _ = tables(spark)
    outside = findings.withColumn("rule_id", F.lit("unapplied-credit"))
    plan = combine.collapse(outside)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and combine.collapse(outside.union(findings)).count() == 2 * findings.count()
