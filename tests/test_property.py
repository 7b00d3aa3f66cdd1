"""Property test: the one-pass look-back features equal a brute-force
evaluation of the reference's rules on random small inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import history, offers, tx
from revisit.operators.enrich import history_offers
from revisit.operators.lookback import lookback_features, purchase_facts

BASE = dt.date(2001, 1, 1)
FIELDS = ("company", "category", "brand")
val = st.one_of(st.none(), st.integers(1, 3))
line = st.tuples(st.integers(1, 4), val, val, val, st.integers(0, 200),
                 st.one_of(st.none(), st.integers(-2, 5)), st.one_of(st.none(), st.integers(-300, 900)))
offer_row = st.tuples(val, val, val)


def brute(lines, offer_rows, hist, windows=(30, 60, 90, 180)):
    """Literal reading of the reference: per field and window, sums over
    matching lines; defaults only when nothing matched."""
    offer_map = {i: o for i, o in enumerate(offer_rows)}
    out = {}
    for cid, off, od in hist:
        o = offer_map.get(off, (None, None, None))
        prod = dict(zip(("category", "company", "brand"), o))
        r = {}
        for n in windows:
            for f in FIELDS:
                m = [ln for ln in lines if ln["id"] == cid and od is not None
                     and 0 <= (od - ln["date"]).days <= n and ln[f] is not None and ln[f] == prod[f]]
                qs = [ln["q"] for ln in m if ln["q"] is not None]
                as_ = [ln["a"] for ln in m if ln["a"] is not None]
                r[f"has_bought_{f}_q_{n}"] = 0 if not m else (sum(qs) if qs else None)
                r[f"has_bought_{f}_a_{n}"] = 0.0 if not m else (round(sum(as_), 2) if as_ else None)
                if n == 30:
                    r[f"never_bought_{f}"] = 1 if not m else 0
        last30 = [ln for ln in lines if ln["id"] == cid and od is not None and 0 <= (od - ln["date"]).days <= 30]
        r["visits_30"] = len({ln["date"] for ln in last30})
        r["total_spend_30"] = round(sum(ln["a"] for ln in last30 if ln["a"] is not None), 2)
        pm = [ln for ln in last30 if all(ln[k] is not None and ln[k] == prod[k] for k in prod)]
        r["prodid_count_30"] = sum(ln["q"] for ln in pm if ln["q"] is not None)
        r["prodid_spend_30"] = round(sum(ln["a"] for ln in pm if ln["a"] is not None), 2)
        out[(cid, off)] = r
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(line, min_size=0, max_size=25), st.lists(offer_row, min_size=1, max_size=3),
       st.lists(st.tuples(st.integers(0, 4), st.integers(100, 200)), min_size=1, max_size=4, unique_by=lambda t: t[0]))
def test_one_pass_matches_brute_force(spark, lines, offer_rows, cust):
    lines = [dict(id=c, category=ca, company=co, brand=b, date=BASE - dt.timedelta(days=d), q=q,
                  a=None if a is None else a / 100) for c, ca, co, b, d, q, a in lines]
    hist = [(cid, cid % (len(offer_rows) + 1), BASE - dt.timedelta(days=back)) for cid, back in cust]
    t = tx(spark, [(x["id"], x["category"], x["company"], x["brand"], x["date"], x["q"], x["a"]) for x in lines])
    o = offers(spark, [(i, c, co, b, 1.0) for i, (c, co, b) in enumerate(offer_rows)])
    h = history(spark, hist)
    got = {(r["id"], r["offer"]): r.asDict()
           for r in lookback_features(history_offers(h, o), purchase_facts(t)).collect()}
    want = brute(lines, offer_rows, hist)
    assert set(got) == set(want)
    for k, exp in want.items():
        for col, v in exp.items():
            g = got[k][col]
            if isinstance(v, float) and g is not None:
                assert abs(g - v) < 1e-9, (k, col, g, v)
            else:
                assert g == v, (k, col, g, v)
