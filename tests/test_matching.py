import itertools
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.operators import matching
from docketlake.plans.notify import alert_cycle
from docketlake.sources.tables import stored
from docketlake.streaming.alerts import alert_batch, sent_ledger
from docketlake.streaming.delivery import deliver_batch, delivery_log

NOTICE = "hash string, state string, employer string, industry string, notice_type string, employees int, city string, notice_date date, source_url string, first_seen_at timestamp"
SUB = "id long, states array<string>, keywords array<string>, min_employees int, is_active boolean, email string, unsubscribe_token string"


def notice(spark, *rows):
    base = {"hash": "h", "state": "MD", "employer": "Acme Corp", "industry": None, "notice_type": None, "employees": None,
            "city": None, "notice_date": None, "source_url": "", "first_seen_at": datetime(2024, 6, 1)}
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], NOTICE)


def subs(spark, *rows):
    base = {"id": 1, "states": None, "keywords": None, "min_employees": None, "is_active": True, "email": "a@b", "unsubscribe_token": "t"}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], SUB)


CASES = [
    ({"state": "MD"}, {"states": ["MD"]}, True),
    ({"state": "VA"}, {"states": ["MD"]}, False),
    ({"state": "ZZ"}, {}, True),
    ({"employees": 50}, {"min_employees": 100}, False),
    ({"employees": 150}, {"min_employees": 100}, True),
    ({}, {"min_employees": 1}, False),
    ({"employer": "Acme Retail Co"}, {"keywords": ["retail"]}, True),
    ({"industry": "Retail Trade"}, {"keywords": ["RETAIL"]}, True),
    ({"notice_type": "Closure"}, {"keywords": ["closure"]}, True),
    ({"employer": "Acme Manufacturing"}, {"keywords": ["retail"]}, False),
    ({"employer": "Retail Co", "employees": 150}, {"states": ["md"], "keywords": ["retail"], "min_employees": 100}, True),
    ({"state": "VA", "employer": "Retail Co", "employees": 150}, {"states": ["MD"], "keywords": ["retail"], "min_employees": 100}, False),
    ({"employer": "Retail Co", "employees": 10}, {"states": ["MD"], "keywords": ["retail"], "min_employees": 100}, False),
    ({"employer": "AB"}, {"keywords": ["b"]}, True),
    ({"employer": "AB"}, {"keywords": ["", " "]}, True),
]


def test_filter_truth_table(spark):
    notices = notice(spark, *[{**n, "hash": str(i)} for i, (n, _, _) in enumerate(CASES)])
    wanted = subs(spark, *[{**s, "id": i} for i, (_, s, _) in enumerate(CASES)])
    hits = {(r.subscription_id, r.hash) for r in matching.match_alerts(notices, wanted).collect()}
    assert [(i, str(i)) in hits for i in range(len(CASES))] == [c[2] for c in CASES]


def test_match_equals_brute_force_with_a_hot_state(spark):
    rnd = random.Random(3)
    words = ["ace", "steel", "foods", "co", "air", "north", "x"]
    rows = [{"hash": str(i), "state": "MD" if i % 3 == 0 else rnd.choice(["VA", "DC", "PA"]),
             "employer": " ".join(rnd.choices(words, k=3)), "industry": rnd.choice([None, "steel works"]),
             "employees": rnd.choice([None, 5, 50, 500])} for i in range(300)]
    profiles = [{"id": i, "states": rnd.choice([None, ["MD"], ["VA", "MD", "MD"], []]),
                 "keywords": rnd.choice([None, ["ace", "steel"], ["co"], ["ir n", "foods", "foods"], ["zzz"]]),
                 "min_employees": rnd.choice([None, 5, 100])} for i in range(40)]

    def brute(n, s):
        hay = " ".join(x for x in (n["employer"], n["industry"]) if x).lower()
        return ((not s["states"] or n["state"] in s["states"])
                and (s["min_employees"] is None or (n["employees"] is not None and n["employees"] >= s["min_employees"]))
                and (not s["keywords"] or any(k in hay for k in s["keywords"])))

    want = sorted((s["id"], n["hash"]) for n, s in itertools.product(rows, profiles) if brute(n, s))
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        out = matching.match_alerts(notice(spark, *rows), subs(spark, *profiles))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert sorted(map(tuple, out.collect())) == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cycle_lookback_and_ledger(spark):
    rows = [{"hash": "old", "first_seen_at": datetime(2024, 5, 1)}, {"hash": "sent"}, {"hash": "new", "employees": 1234, "city": "Ode",
            "notice_date": date(2024, 5, 30), "source_url": "http://u"}]
    ledger = spark.createDataFrame([(1, "sent", None)], vocab.LEDGER_SCHEMA)
    people = subs(spark, {}, {"id": 2, "is_active": False})
    messages, booked = alert_cycle(notice(spark, *rows), people, ledger, "2024-06-02 00:00:00")
    assert [tuple(r)[:2] for r in booked.collect()] == [(1, "new")]
    msg = messages.first()
    assert msg.subject == "1 filing for your watch list" and msg.email == "a@b"
    assert msg.body == "* Acme Corp (Ode, MD), filed 2024-05-30, 1,234 jobs <http://u>"


def test_digest_gathers_only_the_listed_lines(spark):
    rows = [{"hash": f"{i:04d}"} for i in range(400)]
    found = matching.match_alerts(notice(spark, *rows), subs(spark, {}),
                                  carry=("hash", "employer", "city", "state", "employees", "notice_date", "source_url", "first_seen_at"))
    out = matching.digest(found)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    row = out.first()
    assert row.n == 400 and row.body.count("* ") == 25 and row.body.endswith("(and 375 further filings)")


def test_subscription_forms(spark):
    raw = spark.createDataFrame([(1, " A@B.org ", "md,va", "x, ", 5), (2, "nope", "", "", None), (3, "c@d", "", None, None)],
                                "id long, email string, states string, keywords string, min_employees int")
    got = {r.id: r for r in matching.new_subscriptions(raw).collect()}
    assert set(got) == {1, 3} and got[1].email == "a@b.org" and got[1].states == ["MD", "VA"] and got[1].keywords == ["x"]
    assert got[3].states is None and got[3].keywords is None and len(got[1].unsubscribe_token) > 20


@pytest.mark.parametrize("twice", [False, True])
def test_alert_batches_do_not_repeat(spark, tmp_path, twice):
    out = str(tmp_path / "outbox")
    args = (subs(spark, {}), out, "2024-06-02 00:00:00")
    alert_batch(notice(spark, {"hash": "a"}), 0, *args)
    alert_batch(notice(spark, {"hash": "a"}, {"hash": "b"}), 1, *args)
    if twice:
        alert_batch(notice(spark, {"hash": "a"}, {"hash": "b"}), 1, *args)
    assert sorted(r.hash for r in sent_ledger(spark, out).collect()) == ["a", "b"]


def test_failed_messages_are_sent_again_until_a_receipt(spark, tmp_path):
    out, people = str(tmp_path / "outbox"), subs(spark, {}, {"id": 2, "email": "c@d"}, {"id": 3, "is_active": False})
    sent = []

    def send(fails):
        def run(messages):
            sent.append(sorted((r.subscription_id, r.n) for r in messages.collect()))
            fine = ~F.col("subscription_id").isin(fails) if fails else F.lit(True)
            return messages.select("subscription_id", fine.alias("ok"), F.when(~fine, "busy").alias("error"))
        return run

    def step(number, fails, *rows, now="2024-06-02 00:00:00"):
        deliver_batch(notice(spark, *rows), number, people, out, now, send(fails))

    step(0, [2], {"hash": "a"})
    step(0, [2], {"hash": "a"})           # a replay of a finished batch sends nothing
    assert sent == [[(1, 1), (2, 1)]]
    step(1, [2], {"hash": "a"}, {"hash": "b"}, {"hash": "b"})
    step(2, [], {"hash": "b"})
    step(3, [], {"hash": "b"})
    assert sent[1:] == [[(1, 1), (2, 2)], [(2, 2)], []]
    log = {(r.subscription_id, r.hash): (r.attempts, r.sent_at is not None, r.error) for r in delivery_log(spark, out).collect()}
    assert log == {(1, "a"): (1, True, None), (1, "b"): (1, True, None), (2, "a"): (3, True, None), (2, "b"): (2, True, None)}


def test_a_message_without_receipt_counts_as_not_sent(spark, tmp_path):
    out, people = str(tmp_path / "outbox"), subs(spark, {})
    schema = "subscription_id long, ok boolean, error string"
    deliver_batch(notice(spark, {"hash": "a"}), 0, people, out, "2024-06-02 00:00:00", lambda m: spark.createDataFrame([], schema))
    assert [tuple(r) for r in delivery_log(spark, out).collect()] == [(1, "a", 1, None, None)]
    # Beyond the lookback it is given up.
    deliver_batch(notice(spark, {"hash": "z", "first_seen_at": datetime(2024, 7, 1)}), 1, people, out, "2024-07-01 00:00:00",
                  lambda m: m.select("subscription_id", F.lit(True).alias("ok"), F.lit("").alias("error")))
    assert {r.hash: r.attempts for r in delivery_log(spark, out).collect()} == {"a": 1, "z": 1}


def test_delivery_books_groups_not_pairs(spark, tmp_path):
    """40 subscriptions of equal filters and 20 notices: 20 rows with one group, also where messages fail; a larger headcount meets who was left."""
    out = str(tmp_path / "outbox")
    people = subs(spark, *[{"id": i, "email": f"{i}@d", "min_employees": 50 if i % 2 else None} for i in range(1, 41)])

    def step(number, rows, fails):
        fine = F.col("subscription_id") % 4 != 0 if fails else F.lit(True)
        deliver_batch(notice(spark, *rows), number, people, out, "2024-06-02 00:00:00",
                      lambda m: m.select("subscription_id", fine.alias("ok"), F.lit(None).cast("string").alias("error")))

    step(0, [{"hash": f"{i:02d}", "employees": 10} for i in range(20)], True)
    step(1, [{"hash": "00", "employees": 60}], False)
    written = sum(spark.read.parquet(str(p)).count() for p in tmp_path.glob("outbox/*/batch_id=*") if p.parent.name not in ("messages", "receipts"))
    assert written <= 25
    log = {(r.subscription_id, r.hash): r.attempts for r in delivery_log(spark, out).collect()}
    # Even ids have all 20 notices, a half of them on the second try; odd ones only the grown notice.
    assert log == {**{(i, f"{h:02d}"): 2 if i % 4 == 0 else 1 for i in range(2, 41, 2) for h in range(20)}, **{(i, "00"): 1 for i in range(1, 41, 2)}}


def test_packed_matches_and_digest_equal_the_pairs(spark, tmp_path):
    rnd = random.Random(5)
    rows = [{"hash": f"{i % 150:03d}", "state": "MD" if i % 2 else "VA", "employer": rnd.choice(["ace co", "steel"]), "employees": 10 * (i % 150),
             "first_seen_at": datetime(2024, 6, 1 + i % 3, i % 24)} for i in range(200)]
    people = subs(spark, *[{"id": i * 9000 - 40000, "states": rnd.choice([None, ["MD"]]), "keywords": rnd.choice([None, ["ace"], ["co", "steel"]]),
                            "min_employees": rnd.choice([None, 400])} for i in range(40)])
    carry = matching.NOTICE_COLUMNS
    pairs = matching.match_alerts(notice(spark, *rows), people, carry=carry)
    ledger = pairs.where("hash < '040'").select("subscription_id", "hash")
    want = matching.unsent(pairs, ledger)
    packed = matching.match_packed(notice(spark, *rows), people, ledger, carry)
    assert sorted(map(tuple, matching.unpacked(packed).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    sent = matching.match_packed(notice(spark, *rows[:40]), people)
    again = matching.unpacked(matching.match_packed(notice(spark, *rows), people, sent, once=True)).select("subscription_id", "hash").collect()
    gone = {tuple(r) for r in matching.unpacked(sent).collect()}
    assert sorted(map(tuple, again)) == sorted({(r.subscription_id, r.hash) for r in pairs.collect()} - gone)
    assert sorted(map(tuple, matching.packed_digest(packed).collect())) == sorted(map(tuple, matching.digest(want).collect()))
    # Neither pairs nor ledger pairs are shuffled: they are unpacked after the last exchange.
    plan = matching.unpacked(packed)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(ats") < plan.index("Exchange")


def _members(rnd, n):
    return [{"id": i * 700 - 9000, "email": f"{i}@d", "states": rnd.choice([None, ["MD"]]), "min_employees": rnd.choice([None, None, 0, 40, 40, 90, 2000])}
            for i in range(n)]


def test_a_digest_counts_groups_and_makes_no_pairs(spark):
    """Spans of members give the counts and lines of the pairs, also where notices were told in part."""
    rnd = random.Random(11)
    rows = [{"hash": f"{i:03d}", "state": rnd.choice(["MD", "VA"]), "employees": rnd.choice([None, 0, 39, 40, 60, 90, 5000]),
             "first_seen_at": datetime(2024, 6, 1, rnd.randrange(24))} for i in range(150)]
    people = subs(spark, *_members(rnd, 61))
    pairs = matching.match_alerts(notice(spark, *rows), people, carry=matching.NOTICE_COLUMNS)
    ledger = pairs.where("hash < '050' AND subscription_id % 3 = 0").select("subscription_id", "hash", F.lit(None).cast("timestamp").alias("sent_at"))
    want = matching.unsent(pairs, ledger)
    messages, booked = alert_cycle(notice(spark, *rows), people, ledger, "2024-06-02 00:00:00")
    assert sorted(map(tuple, messages.select("subscription_id", "n", "subject", "body").collect())) == sorted(map(tuple, matching.digest(want).collect()))
    assert sorted(map(tuple, booked.select("subscription_id", "hash").collect())) == sorted(map(tuple, want.select("subscription_id", "hash").collect()))
    assert " explode(ats" not in messages._jdf.queryExecution().optimizedPlan().toString()


def test_whom_a_headcount_meets_is_found_by_halves(spark):
    rnd = random.Random(2)
    for size in (0, 1, 2, 3, 7, 8, 9, 31, 64):
        members = [(rnd.choice([None, -5, 0, 10, 10, 300]), i) for i in range(size)]
        counts = [None, -6, -5, 0, 9, 10, 11, 300, 301]
        rows = spark.createDataFrame([(members, n) for n in counts], "members array<struct<need: int, at: smallint>>, n int")
        met = rows.select("n", *matching.by_need(F.col("members"))).select("n", F.slice("ats", 1, matching.reach(F.col("n"))).alias("met"))
        for r in met.collect():
            assert sorted(r.met) == [at for need, at in members if need is None or (r.n is not None and r.n >= need)]


def test_the_log_makes_pairs_after_the_last_exchange(spark, tmp_path):
    out = str(tmp_path / "outbox")
    people = subs(spark, *_members(random.Random(4), 20))

    def step(number, rows, fails):
        fine = F.col("subscription_id") % 400 != 0 if fails else F.lit(True)
        deliver_batch(notice(spark, *rows), number, people, out, "2024-06-02 00:00:00",
                      lambda m: m.select("subscription_id", fine.alias("ok"), F.lit(None).cast("string").alias("error")))

    step(0, [{"hash": f"{i:02d}", "employees": 10 * i} for i in range(12)], True)
    step(1, [{"hash": f"{i:02d}", "employees": 2000} for i in range(8, 20)], False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = delivery_log(spark, out)
        plan = log._jdf.queryExecution().executedPlan().toString()
        assert plan.index("explode(ats") < plan.index("Exchange")
        got = sorted(map(tuple, log.select("subscription_id", "hash", "attempts").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = {f"{i:02d}": max(10 * i if i < 12 else 0, 2000 if i >= 8 else 0) for i in range(20)}
    want = []
    for r in people.collect():
        for h, n in rows.items():
            if (r.min_employees is None or n >= r.min_employees):
                first = int(h) < 12 and (r.min_employees is None or 10 * int(h) >= r.min_employees)
                want.append((r.id, h, 2 if first and r.id % 400 == 0 else 1))
    assert got == sorted(want)


def test_last_notified_takes_equal_lists_of_ids_apart_once(spark):
    ledger = spark.createDataFrame([(f"{i:03d}", 2, [1, 5] if i % 2 else [5], datetime(2024, 6, 1 + i % 4)) for i in range(200)],
                                   "hash string, block long, ats array<smallint>, sent_at timestamp")
    people = subs(spark, *[{"id": 2 * matching.BLOCK + i} for i in (1, 5, 6)])
    out = matching.touch_notified(people, ledger)
    assert {r.id % matching.BLOCK: r.last_notified_at and r.last_notified_at.day for r in out.collect()} == {1: 4, 5: 4, 6: None}
    # Grouped as lists below the explode: read upwards, the scan of the ledger, its lists, their ids.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(ats") < plan.rindex("Aggregate [block")


def test_pairs_of_a_group_follow_each_other(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(matching, "stored", lambda df, purpose, *a: kept.setdefault(purpose, stored(df, purpose, *a)))
    rows = [{"hash": f"{i:03d}", "state": "MD" if i % 2 else "VA", "employer": ["ace", "ace steel", "steel"][i % 3]} for i in range(300)]
    people = subs(spark, *[{"id": i, "states": [None, ["MD"]][i % 2], "keywords": [None, ["ace"], ["steel"]][i % 3]} for i in range(30)])
    out = matching.match_alerts(notice(spark, *rows), people)
    assert out.count() == sum(i % 3 in ([0, 1, 2], [0, 1], [1, 2])[s % 3] and (s % 2 == 0 or i % 2 == 1) for i in range(300) for s in range(30))
    files = {}
    for r in kept["hits"].select(F.input_file_name().alias("file"), F.col("_group").cast("string").alias("g")).collect():
        files.setdefault(r.file, []).append(r.g)
    assert any(len(set(gs)) > 1 and len(gs) > len(set(gs)) for gs in files.values())
    assert all(len([*itertools.groupby(gs)]) == len(set(gs)) for gs in files.values())
