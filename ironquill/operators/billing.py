"""Trials, subscriptions and revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..rules.plan_limits import (
    EV_ACTIVATED, EV_CANCELLED, EV_CAPTURE, EV_CHECKOUT, EV_FAILED, EV_MANUAL, EV_ORDER_CAPTURED, EV_RENEWED,
    EV_USER_CANCEL, TRIAL_DAYS)
from ..session import keep_result
from .sliced import carry_last
from .usage import _day, plan_label, plan_of


def trial_status(users: DataFrame, today) -> DataFrame:
    """Effective plan and trial state of each user on a given day."""
    now, plan = _day(today), plan_of(F.col("plan"))
    end = F.coalesce(F.col("trial_end_date"), F.when(
        plan == "pro_trial", F.date_add(F.to_date("created_at"), TRIAL_DAYS)))
    on_trial = plan == "pro_trial"
    stopped = on_trial & ~F.coalesce(F.col("trial_active"), F.lit(True))
    running = on_trial & ~stopped & F.coalesce(now <= end, F.lit(False))
    paid = plan.isin("pro", "enterprise")
    lapsed = on_trial & ~stopped & ~running
    out = users.withColumns({
        "eff_plan": F.when(paid | running, plan).otherwise("free"),
        "eff_is_pro": paid | running,
        "in_trial": running, "trial_expired": stopped | lapsed,
        "days_left": F.when(running, F.datediff(end, now)).otherwise(0),
        "trial_end": F.when(running | lapsed, F.coalesce(end.cast("string"), F.lit(""))).otherwise(""),
        "can_start_trial": (plan == "free") & F.col("trial_start_date").isNull(),
        "can_cancel": F.coalesce((F.col("paypal_subscription_id") != "") & (F.col("subscription_status") == "ACTIVE"),
                                 F.lit(False))})
    return out.withColumn("plan_label", plan_label(F.col("eff_plan")))


def expired_trials(users: DataFrame, today) -> DataFrame:
    """Update rows for users whose trial is over."""
    return trial_status(users, today).filter(F.col("trial_expired") & (F.col("plan") == "pro_trial")).select(
        "id", F.lit("free").alias("plan"), F.lit(False).alias("trial_active"), F.lit(False).alias("is_pro"))


# ---- payment events ----------------------------------------------------------------
#  events: seq, ts, event_type, resource<id, custom_id, billing_agreement_id,
#          invoice_id, subscriber<email_address>, amount<total, value>, billing>>;
#          billing (monthly or annual) belongs to checkouts and may be left out

def _given(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def event_keys(events: DataFrame) -> DataFrame:
    """Flatten events: the subscription or user each refers to, and its amount."""
    r, kind = F.col("resource"), F.col("event_type")
    has_billing = "billing" in events.schema["resource"].dataType.names
    by_user = kind.isin(EV_ACTIVATED, EV_CAPTURE, EV_MANUAL, EV_USER_CANCEL, EV_CHECKOUT, EV_ORDER_CAPTURED)
    sub = (F.when(kind.isin(*EV_RENEWED), F.coalesce(_given(r["billing_agreement_id"]), _given(r["id"])))
           .when(kind.isin(EV_ACTIVATED, EV_CHECKOUT, EV_USER_CANCEL, *EV_FAILED, EV_CANCELLED), _given(r["id"])))
    order = F.when(kind.isin(EV_CAPTURE, EV_ORDER_CAPTURED), _given(r["id"]))
    user = (F.when(kind.isin(EV_ACTIVATED, EV_CHECKOUT),
                   F.coalesce(_given(r["custom_id"]), _given(r["subscriber"]["email_address"])))
            .when(kind.isin(EV_CAPTURE, EV_ORDER_CAPTURED), F.coalesce(_given(r["custom_id"]), _given(r["invoice_id"])))
            .when(by_user, _given(r["custom_id"])))
    amount = (F.when(kind.isin(*EV_RENEWED), F.coalesce(_given(r["amount"]["total"]), r["amount"]["value"], F.lit("")))
              .when(kind.isin(EV_CAPTURE, EV_CHECKOUT, EV_ORDER_CAPTURED), F.coalesce(r["amount"]["value"], F.lit(""))).otherwise(F.lit("")))
    billing = F.when(kind == EV_CHECKOUT, F.coalesce(_given(r["billing"]) if has_billing else F.lit(None), F.lit("monthly")))
    flat = bind(events.select("seq", "ts", "event_type", "resource"), subscription_id=sub, order_id=order,
                ref_user=user, amount=amount, billing=billing, by_user=by_user).drop("resource")
    has_sub, has_order = F.col("subscription_id").isNotNull(), F.col("order_id").isNotNull()
    has_user = F.col("ref_user").isNotNull()
    return flat.filter(F.when(kind.isin(EV_ACTIVATED, EV_CHECKOUT), has_sub & has_user)
                       .when(kind.isin(EV_CAPTURE, EV_ORDER_CAPTURED), has_order & has_user)
                       .when(F.col("by_user"), has_user).otherwise(has_sub))


def subscription_lookup(events: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subscription events of known users, and those nobody holds (dead letters).

    Takes flattened events (:func:`event_keys`) and the users' current
    subscriptions.  A subscription held twice goes to the smallest user id.
    """
    holders = users.filter(_given(F.col("paypal_subscription_id")).isNotNull()).groupBy(
        F.col("paypal_subscription_id").alias("subscription_id")).agg(F.min("id").alias("user_id"))
    named = events.filter(F.col("subscription_id").isNotNull() & ~F.col("by_user"))
    return (named.join(holders, "subscription_id"),
            named.join(holders, "subscription_id", "left_anti"))


def _answers():
    """Joins and leaves of subscriptions, sorted -> after each place, the smallest user id that holds the subscription.

    Only the current holders of one subscription are held, so a subscription
    may have had any number of them.
    """
    def run(batches):
        import heapq

        import pandas as pd

        sub, seq, holders, smallest = None, None, set(), []

        def answer():
            while smallest and smallest[0] not in holders:
                heapq.heappop(smallest)
            return smallest[0] if smallest else None

        for pdf in batches:
            out = []
            for s, q, user, joins in zip(pdf["subscription_id"], pdf["seq"].tolist(), pdf["user_id"], pdf["joins"].tolist()):
                if seq is not None and (s, q) != (sub, seq):
                    out.append((sub, seq, answer()))
                if s != sub:
                    holders, smallest = set(), []
                sub, seq = s, q
                if not joins:
                    holders.discard(user)
                elif user not in holders:
                    holders.add(user)
                    heapq.heappush(smallest, user)
            yield pd.DataFrame(out, columns=["subscription_id", "seq", "user_id"])
        if seq is not None:
            yield pd.DataFrame([(sub, seq, answer())], columns=["subscription_id", "seq", "user_id"])

    return run


def holdings(grants: DataFrame, initial: DataFrame, slice_events: int) -> DataFrame:
    """``subscription_id, seq, user_id``: who answers for a subscription after each place where its holders change.

    ``grants`` (``seq, user_id, subscription_id``) are activations, ``initial``
    (``user_id, subscription_id``) what users hold before.  A grant ends what
    the user held.  Of several holders the smallest id answers; null: nobody.
    """
    held = initial.select(F.lit(-1).cast("bigint").alias("seq"), "user_id", "subscription_id").unionByName(grants).withColumn(
        "_slice", F.floor(F.col("seq") / slice_events))
    moved = carry_last(held, ["user_id"], "_slice", "seq", "subscription_id", "_left").filter(
        ~F.col("subscription_id").eqNullSafe(F.col("_left")))
    moves = moved.select("seq", "user_id", F.explode(F.array(
        F.struct(F.col("subscription_id").alias("subscription_id"), F.lit(True).alias("joins")),
        F.struct(F.col("_left").alias("subscription_id"), F.lit(False).alias("joins")))).alias("_m")).select(
            "seq", "user_id", "_m.*").filter(F.col("subscription_id").isNotNull())
    return (moves.repartition("subscription_id").sortWithinPartitions("subscription_id", "seq")
            .mapInPandas(_answers(), "subscription_id string, seq bigint, user_id string"))


def routed_events(events: DataFrame, users: DataFrame, slice_events: int = 1_000_000) -> DataFrame:
    """Events with the user they apply to at their place in the sequence.

    A user holds the subscription of their last activation before the event,
    or the one stored with them.  The places where a subscription changes hands
    and the events that name it are put in one sequence, in which the user who
    answers is carried forward by slices: an event meets one user, however
    many have held its subscription, and a subscription with a third of all
    events is sorted in pieces.
    """
    flat = keep_result(event_keys(events))
    known = users.select(F.col("id").alias("user_id"))
    direct = flat.filter("by_user").join(known, F.col("ref_user") == F.col("user_id")).drop("ref_user")
    grants = direct.filter(F.col("event_type").isin(EV_ACTIVATED, EV_CHECKOUT)).select("seq", "user_id", "subscription_id")
    initial = users.select(F.col("id").alias("user_id"), _given(F.col("paypal_subscription_id")).alias("subscription_id")).filter(
        F.col("subscription_id").isNotNull())
    changes = keep_result(holdings(grants, initial, slice_events)).select(
        "subscription_id", "seq", F.struct("user_id").alias("_held"))
    line = changes.unionByName(flat.filter(~F.col("by_user")).drop("ref_user"), allowMissingColumns=True).withColumn(
        "_slice", F.floor(F.col("seq") / slice_events))
    carried = carry_last(line, ["subscription_id"], "_slice", "seq", "_held", "_now")
    asked = carried.filter(F.col("event_type").isNotNull() & F.col("_now.user_id").isNotNull())
    return direct.unionByName(asked.withColumn("user_id", F.col("_now.user_id")).select(direct.columns))


def column_writes() -> dict[str, Column]:
    """Per user column: the value an event writes; null where it writes none."""
    kind = F.col("event_type")
    activated, checkout, manual = kind == EV_ACTIVATED, kind == EV_CHECKOUT, kind == EV_MANUAL
    renewed, capture = kind.isin(*EV_RENEWED), kind.isin(EV_CAPTURE, EV_ORDER_CAPTURED)
    annual = checkout & (F.col("billing") == "annual")
    monthly = activated | (checkout & (F.col("billing") != "annual"))
    failed, cancelled = kind.isin(*EV_FAILED), kind == EV_CANCELLED
    up, down = activated | checkout | capture | manual | renewed, failed | cancelled
    day = F.to_date("ts").cast("string")
    return {
        "is_pro": F.when(up, True).when(down, False),
        "plan": F.when(up, "pro").when(down, "free"),
        "trial_active": F.when(activated | checkout | capture | manual | down, False),
        "paypal_order_id": F.when(monthly, "").when(capture, F.col("order_id")),
        "paypal_subscription_id": F.when(activated | checkout, F.col("subscription_id")),
        "subscription_status": F.when(activated | checkout | renewed, "ACTIVE").when(down, "INACTIVE")
        .when(manual, "MANUAL").when(kind == EV_USER_CANCEL, "CANCELLING"),
        "subscription_billing": F.when(monthly, "monthly").when(annual, "annual"),
        "subscription_renewed_at": F.when(renewed | annual, day),
        "downgraded_at": F.when(down, day),
        "downgrade_reason": F.when(failed, "payment_failed").when(cancelled, "subscription_cancelled"),
    }


STATE_COLUMNS = (
    "is_pro", "plan", "trial_active", "paypal_order_id", "paypal_subscription_id", "subscription_status",
    "subscription_billing", "subscription_renewed_at", "downgraded_at", "downgrade_reason")


def latest_updates(routed: DataFrame) -> DataFrame:
    """Last written value of every user column, and the number of events.

    Each column keeps its latest write, which an aggregate can combine in any
    order: no per-user replay, and a user with most of the events is no
    heavier than any other after the map side.
    """
    writes = column_writes()
    marked = routed.select("user_id", "seq", *[v.alias(c) for c, v in writes.items()])
    return marked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in writes])


def subscription_state(events: DataFrame, users: DataFrame) -> DataFrame:
    """Users after all payment events, applied in ``seq`` order."""
    new = latest_updates(routed_events(events, users))
    new = new.withColumnsRenamed({c: f"_n_{c}" for c in STATE_COLUMNS}).withColumnRenamed("user_id", "id")
    joined = users.join(new, "id", "left")
    stored = {c: (F.col(c) if c in users.columns else F.lit(None)) for c in STATE_COLUMNS}
    return joined.select("id", F.coalesce("events", F.lit(0)).alias("events"), *[
        F.coalesce(F.col(f"_n_{c}"), stored[c]).alias(c) for c in STATE_COLUMNS])


def payments_log(events: DataFrame, users: DataFrame) -> DataFrame:
    """Payment rows that the events of known users leave behind."""
    return routed_events(events, users).filter(F.col("event_type") != EV_MANUAL).select(
        "seq", "user_id", "event_type", "amount", "subscription_id", "order_id", F.col("ts").alias("created_at"))


def revenue_monthly(payments: DataFrame) -> DataFrame:
    """Paid amount and number of payments per month and event type."""
    paid = F.col("amount").try_cast("decimal(10,2)")
    return (payments.select(F.date_format("created_at", "yyyy-MM").alias("month"), "event_type", paid.alias("_paid"))
            .filter(F.col("_paid").isNotNull()).groupBy("month", "event_type")
            .agg(F.sum("_paid").alias("revenue"), F.count(F.lit(1)).alias("payments")))
