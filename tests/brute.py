"""Plain Python versions of the modelled logic, for small fixtures only."""

import hashlib
import math
import statistics
from collections import defaultdict
from datetime import timedelta


def unit(*parts):
    text = "|".join("" if p is None else str(p) for p in parts)
    return int(hashlib.sha256(text.encode()).hexdigest()[:16], 16) / 2**64


def quantile(values, p):
    ordered = sorted(values)
    position = (len(ordered) - 1) * p
    low, high = ordered[math.floor(position)], ordered[math.ceil(position)]
    return low + (high - low) * (position - math.floor(position))


def features(orders, customers, payments, elapsed=False):
    """Rows are dicts; amounts in cents; returns person → tuple of features."""
    person = {c["customer_id"]: c for c in customers}
    paid = defaultdict(int)
    for p in payments:
        paid[p["order_id"]] += round(p["payment_value"] * 100)
    by_person = defaultdict(list)
    for o in orders:
        keep = o["order_status"] == "delivered" and o["order_purchase_timestamp"] is not None
        if keep and o["customer_id"] in person:
            by_person[person[o["customer_id"]]["customer_unique_id"]].append(o)
    found = {}
    for who, theirs in by_person.items():
        theirs.sort(key=lambda o: (o["order_purchase_timestamp"], person[o["customer_id"]]["customer_state"] or "~"))
        times = [o["order_purchase_timestamp"] for o in theirs]
        gaps = []
        for a, b in zip(times, times[1:]):
            gap = (b - a) // timedelta(days=1) if elapsed else (b.date() - a.date()).days
            if gap > 0:
                gaps.append(gap)
        delays = []
        for o in theirs:
            due, got = o["order_estimated_delivery_date"], o["order_delivered_customer_date"]
            if due is None or got is None:
                delays.append(0)
            elif elapsed:
                delays.append(max((got - due) / timedelta(days=1), 0))
            else:
                delays.append(max((got.date() - due.date()).days, 0))
        cents = sum(paid[o["order_id"]] for o in theirs)
        states = [s for o in theirs if (s := person[o["customer_id"]]["customer_state"])]
        found[who] = (
            states[0] if states else None,
            min(times).date(),
            len({o["order_id"] for o in theirs}),
            cents / 100 / len(theirs),
            cents / 100,
            sum(delays) / len(delays),
            float(statistics.median(gaps)) if gaps else None,
        )
    return found
