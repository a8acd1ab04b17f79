import datetime as dt
import random

from ironquill.operators import billing
from ironquill.rules.plan_limits import (
    EV_ACTIVATED, EV_CANCELLED, EV_CAPTURE, EV_CHECKOUT, EV_FAILED, EV_ORDER_CAPTURED, EV_RENEWED, EV_USER_CANCEL)

D = dt.date
USERS = ("id string, plan string, is_pro boolean, trial_active boolean, trial_start_date date, trial_end_date date, "
         "paypal_subscription_id string, subscription_status string, created_at timestamp")
EVENTS = ("seq bigint, ts timestamp, event_type string, resource struct<id:string,custom_id:string,billing_agreement_id:string,"
          "invoice_id:string,subscriber:struct<email_address:string>,amount:struct<total:string,value:string>>")


def user(i, plan="free", active=None, start=None, end=None, sub=None, status=None, created=dt.datetime(2024, 1, 5)):
    return (i, plan, False, active, start, end, sub, status, created)


def event(seq, kind, id_=None, custom=None, agreement=None, invoice=None, email=None, total=None, value=None):
    return (seq, dt.datetime(2024, 1, 1) + dt.timedelta(hours=seq), kind, (id_, custom, agreement, invoice, (email,), (total, value)))


def test_trials(spark):
    today = D(2024, 1, 31)
    rows = [user("none", None), user("last_day", "pro_trial", True, D(2024, 1, 1), today),
            user("over", "pro_trial", True, None, D(2024, 1, 30)), user("no_end", "pro_trial", None),
            user("old", "pro_trial", None, created=dt.datetime(2023, 11, 1)), user("stopped", "pro_trial", False, None, D(2025, 1, 1)),
            user("ent", "Enterprise"), user("used", "free", start=D(2023, 1, 1)), user("cancel", "pro", sub="S", status="ACTIVE")]
    df = billing.trial_status(spark.createDataFrame(rows, USERS), "2024-01-31")
    got = {r.id: (r.eff_plan, r.trial_expired, r.days_left, r.trial_end) for r in df.collect()}
    assert got == {
        "none": ("free", False, 0, ""), "last_day": ("pro_trial", False, 0, "2024-01-31"), "over": ("free", True, 0, "2024-01-30"),
        "no_end": ("pro_trial", False, 4, "2024-02-04"), "old": ("free", True, 0, "2023-12-01"), "stopped": ("free", True, 0, ""),
        "ent": ("enterprise", False, 0, ""), "used": ("free", False, 0, ""), "cancel": ("pro", False, 0, "")}
    flags = {r.id: (r.can_start_trial, r.can_cancel) for r in df.collect()}
    assert flags["none"] == (True, False) and flags["used"] == (False, False) and flags["cancel"] == (False, True)
    expired = {r.id for r in billing.expired_trials(spark.createDataFrame(rows, USERS), "2024-01-31").collect()}
    assert expired == {"over", "old", "stopped"}


def replay(events, users):
    """Apply the events one by one to a table of users."""
    state = {u[0]: dict(plan=u[1], is_pro=u[2], sub=u[6], status=u[7], reason=None, order=None) for u in users}
    for _seq, _ts, kind, (id_, custom, agreement, invoice, (email,), _amount) in sorted(events):
        def holder(sub):
            held = [i for i, s in state.items() if sub and s["sub"] == sub]
            return state[min(held)] if held else None

        if kind == EV_ACTIVATED:
            u = state.get(custom or email)
            if id_ and u:
                u.update(plan="pro", is_pro=True, order="", sub=id_, status="ACTIVE")
        elif kind in EV_RENEWED:
            u = holder(agreement or id_)
            if u:
                u.update(plan="pro", is_pro=True, status="ACTIVE")
        elif kind in EV_FAILED or kind == EV_CANCELLED:
            u = holder(id_)
            if u:
                u.update(plan="free", is_pro=False, status="INACTIVE",
                         reason="subscription_cancelled" if kind == EV_CANCELLED else "payment_failed")
        elif kind == EV_CAPTURE:
            u = state.get(custom or invoice)
            if id_ and u:
                u.update(plan="pro", is_pro=True, order=id_)
    return state


def states(df):
    return {r.id: dict(plan=r.plan, is_pro=r.is_pro, sub=r.paypal_subscription_id, status=r.subscription_status,
                       reason=r.downgrade_reason, order=r.paypal_order_id) for r in df.collect()}


def test_state_equals_replay(spark):
    rng = random.Random(11)
    users = [user(f"u{i}", sub=f"S{i}" if i % 3 == 0 else None) for i in range(8)]
    kinds = [EV_ACTIVATED, *EV_RENEWED, *EV_FAILED, EV_CANCELLED, EV_CAPTURE]
    events = []
    for seq in range(400):
        kind = rng.choice(kinds)
        who, sub = f"u{rng.randint(0, 9)}", f"S{rng.randint(0, 9)}"
        if kind == EV_CAPTURE:
            events.append(event(seq, kind, rng.choice(["", f"O{seq}"]), rng.choice([None, who]), invoice=who))
        else:
            events.append(event(seq, kind, rng.choice([sub, sub, ""]), rng.choice(["", who]), agreement=rng.choice([None, sub]),
                                email=rng.choice([None, who])))
    e, u = spark.createDataFrame(events, EVENTS).repartition(3), spark.createDataFrame(users, USERS)
    expected = replay(events, users)
    assert states(billing.subscription_state(e, u)) == expected
    routed = billing.latest_updates(billing.routed_events(e, u, slice_events=7)).collect()
    whole = billing.latest_updates(billing.routed_events(e, u)).collect()
    assert sorted(map(str, routed)) == sorted(map(str, whole))


def test_unknown_subscription_and_amounts(spark):
    users = [user("a", sub="S1"), user("b")]
    events = [event(1, EV_RENEWED[0], "S1", total="9.00"), event(2, EV_RENEWED[1], "zz", agreement="S1", value="8.50"),
              event(3, EV_FAILED[0], "nobody"), event(4, EV_CAPTURE, "O1", invoice="b", value="")]
    e, u = spark.createDataFrame(events, EVENTS), spark.createDataFrame(users, USERS)
    matched, dead = billing.subscription_lookup(billing.event_keys(e), u)
    assert sorted(r.seq for r in matched.collect()) == [1, 2] and [r.seq for r in dead.collect()] == [3]
    log = billing.payments_log(e, u)
    assert {r.seq: (r.user_id, r.amount) for r in log.collect()} == {1: ("a", "9.00"), 2: ("a", "8.50"), 4: ("b", "")}
    rev = billing.revenue_monthly(log).collect()
    assert sorted((r.event_type, float(r.revenue), r.payments) for r in rev) == [
        (EV_RENEWED[0], 9.0, 1), (EV_RENEWED[1], 8.5, 1)]


def test_checkout_events_keep_billing_and_amount(spark):
    schema = EVENTS.replace("value:string>>", "value:string>,billing:string>")
    rows = [event(1, EV_CHECKOUT, "S1", "a", value="99.00"), event(2, EV_CHECKOUT, "S2", "b", value="9.00"),
            event(3, EV_ORDER_CAPTURED, "O1", "c", value="9.00"), event(4, EV_USER_CANCEL, "S2", "b")]
    billed = [(*r[:3], (*r[3], kind)) for r, kind in zip(rows, ("annual", "monthly", None, None))]
    e, u = spark.createDataFrame(billed, schema), spark.createDataFrame([user("a"), user("b"), user("c")], USERS)
    got = {r.id: (r.subscription_billing, r.subscription_renewed_at, r.paypal_order_id, r.subscription_status)
           for r in billing.subscription_state(e, u).collect()}
    assert got == {"a": ("annual", "2024-01-01", None, "ACTIVE"), "b": ("monthly", None, "", "CANCELLING"), "c": (None, None, "O1", None)}
    log = {r.seq: (r.user_id, r.amount, r.subscription_id, r.order_id) for r in billing.payments_log(e, u).collect()}
    assert log == {1: ("a", "99.00", "S1", None), 2: ("b", "9.00", "S2", None), 3: ("c", "9.00", None, "O1"), 4: ("b", "", "S2", None)}
