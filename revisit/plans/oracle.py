"""Oracle SQL (DuckDB dialect) for every registered query of the retail operators.

Written from the rules, in one shape: the cohort meets its customers' lines
once, and every window, field and user feature is a filtered aggregate of
that join; shares of a category come from window sums over one product table.
Money is summed as DECIMAL(18,2) and returned as DOUBLE; ``||`` is used
instead of DuckDB's null-skipping ``concat``.  Model queries state what must
hold of them (keys, ranges, counts); their raw values are tested in Python.
"""

from __future__ import annotations

from revisit.operators.model import GRID
from revisit.schemas import NON_FEATURE_COLUMNS, PRODUCT_FIELDS, USER_WINDOW, WINDOWS
from revisit.sources.fixtures import (FIXTURE_COLUMNS, OFFER_COUNT, OFFER_CUTOFF,
                                      OFFER_MODULUS, TEST_MODULUS)

_KEYS = "category NULLS LAST, company NULLS LAST, brand NULLS LAST"


def _pid(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return (f"(CAST({p}category AS VARCHAR) || ' ' || CAST({p}company AS VARCHAR)"
            f" || ' ' || CAST({p}brand AS VARCHAR))")


def fixture_ctes(fixture: str) -> list[str]:
    cols = FIXTURE_COLUMNS[fixture]
    cat = {"p_name": "p.p_name", "p_type": "p.p_type"}[cols["category"]]
    comp = {"s_nationkey": "s.s_nationkey", "n_regionkey": "n.n_regionkey"}[cols["company"]]
    return [
        f"""transactions AS (
  SELECT o.o_custkey AS id, p.p_size AS dept, {cat} AS category, CAST({comp} AS BIGINT) AS company,
         p.p_brand AS brand, CAST(o.o_orderdate AS DATE) AS date,
         CAST(l.l_quantity AS BIGINT) AS purchasequantity,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS purchaseamount
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)""",
        f"""top_products AS (
  SELECT category, company, brand FROM transactions GROUP BY category, company, brand
  ORDER BY COUNT(*) DESC, {_KEYS} LIMIT {OFFER_COUNT})""",
        f"""offers AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY {_KEYS}) - 1 AS BIGINT) AS offer, category, company, brand,
         CAST(ROW_NUMBER() OVER (ORDER BY {_KEYS}) AS DOUBLE) AS offervalue
  FROM top_products)""",
        f"""last_order AS (
  SELECT o_custkey AS id, MAX(CAST(o_orderdate AS DATE)) AS offerdate FROM orders
  WHERE o_orderdate < TIMESTAMP '{OFFER_CUTOFF} 00:00:00' GROUP BY o_custkey)""",
        f"""base_history AS (
  SELECT CASE WHEN c.c_custkey % {TEST_MODULUS} = 0 THEN 'test' ELSE 'train' END AS split,
         c.c_custkey AS id, CAST(c.c_nationkey AS INTEGER) AS chain,
         CAST(c.c_custkey % {OFFER_MODULUS} AS BIGINT) AS offer, 0 AS market, lo.offerdate
  FROM customer c LEFT JOIN last_order lo ON lo.id = c.c_custkey)""",
        """trips AS (
  SELECT h.id, h.offer, COUNT(DISTINCT t.date) AS n
  FROM base_history h JOIN offers o ON h.offer = o.offer
  JOIN transactions t ON t.id = h.id AND t.brand = o.brand AND t.date > h.offerdate
  GROUP BY h.id, h.offer)""",
        """history AS (
  SELECT h.split, h.id, h.chain, h.offer, h.market,
         CASE WHEN h.split = 'train' THEN CAST(COALESCE(tr.n, 0) AS INTEGER) END AS repeattrips,
         CASE WHEN h.split = 'train' THEN CASE WHEN COALESCE(tr.n, 0) > 0 THEN 't' ELSE 'f' END END AS repeater,
         h.offerdate
  FROM base_history h LEFT JOIN trips tr ON tr.id = h.id AND tr.offer = h.offer)""",
        """reduced AS (
  SELECT * FROM transactions
  WHERE category IN (SELECT category FROM offers)
     OR company IN (SELECT company FROM offers)
     OR brand IN (SELECT brand FROM offers))""",
        """history_offers AS (
  SELECT h.*, o.category, o.company, o.offervalue, o.brand
  FROM history h LEFT JOIN offers o ON h.offer = o.offer)""",
    ]


def _with(fixture: str, extra: list[str], body: str) -> str:
    return "WITH " + ",\n".join(fixture_ctes(fixture) + extra) + "\n" + body


_TX_COLS = ("id, dept, category, company, brand, date, purchasequantity, "
            "CAST(purchaseamount AS DOUBLE) AS purchaseamount")


# Aggregate and type of a measure of the lines t.
_MEASURES = {"n": ("COUNT(*)", "BIGINT"), "q": ("SUM(t.purchasequantity)", "BIGINT"), "a": ("SUM(t.purchaseamount)", "DOUBLE"),
             "days": ("COUNT(DISTINCT t.date)", "BIGINT")}


def _filtered(measure: str, condition: str, name: str) -> str:
    aggregate, kind = _MEASURES[measure]
    return f"CAST({aggregate} FILTER (WHERE {condition}) AS {kind}) AS {name}"


def cohort_sums(windows=(), user: int | None = None, cohort: str = "history_offers") -> str:
    """One filtered aggregate per feature over cohort x own lines."""
    age = "date_diff('day', t.date, h.offerdate)"
    parts = [_filtered(m, f"{age} <= {w} AND t.{f} = h.{f}", f"{m}_{f}_{w}") for w in windows for f in PRODUCT_FIELDS for m in ("n", "q", "a")]
    if user:
        same = " AND ".join(f"t.{f} = h.{f}" for f in PRODUCT_FIELDS)
        parts += [_filtered("a", f"{age} <= {user}", "a_all"), _filtered("days", f"{age} <= {user}", "n_days"),
                  _filtered("a", f"{age} <= {user} AND {same}", "a_product"), _filtered("q", f"{age} <= {user} AND {same}", "q_product")]
    return (f"SELECT h.split, h.id, h.offer, {', '.join(parts)} FROM {cohort} h JOIN transactions t "
            "ON t.id = h.id AND t.date <= h.offerdate GROUP BY h.split, h.id, h.offer")


def window_features(w: int, never: bool = True) -> list[str]:
    out = []
    for f in PRODUCT_FIELDS:
        out += [f"IF(COALESCE(s.n_{f}_{w}, 0) = 0, {zero}, s.{m}_{f}_{w}) AS has_bought_{f}_{m}_{w}" for m, zero in (("q", "0"), ("a", "0.0"))]
        if never:
            out.append(f"CAST(COALESCE(s.n_{f}_{w}, 0) = 0 AS INTEGER) AS never_bought_{f}")
    return out


def user_features(u: int = USER_WINDOW) -> list[str]:
    names = {f"prodid_spend_{u}": ("a_product", "0.0"), f"prodid_count_{u}": ("q_product", "0"),
             f"total_spend_{u}": ("a_all", "0.0"), f"visits_{u}": ("n_days", "0")}
    return [f"COALESCE(s.{c}, {zero}) AS {name}" for name, (c, zero) in names.items()]


def cohort_table(columns: list[str], sums: str, cohort: str = "history_offers", head: str = "h.*") -> str:
    return (f"SELECT {head}, {', '.join(columns)} FROM {cohort} h LEFT JOIN ({sums}) s "
            "ON (s.split, s.id) = (h.split, h.id) AND s.offer IS NOT DISTINCT FROM h.offer")


def has_bought(w: int, cohort: str = "history_offers", head: str = "h.*") -> str:
    return cohort_table(window_features(w), cohort_sums((w,), cohort=cohort), cohort, head)


def user_spend() -> str:
    return cohort_table(user_features(), cohort_sums(user=USER_WINDOW), head="h.split, h.id, h.offer, h.category, h.company, h.brand")


PRODUCTS = """products AS (
  SELECT *, SUM(n_lines) OVER (PARTITION BY category) AS n_in_category
  FROM (SELECT category, company, brand, COUNT(*) AS n_lines, SUM(purchaseamount) AS spend
        FROM transactions WHERE category IN (SELECT category FROM offers) GROUP BY category, company, brand))"""


def share() -> str:
    return (f"SELECT DISTINCT {_pid('p')} AS productid, p.category, p.company, p.brand, "
            "CAST(p.n_lines AS DOUBLE) / CAST(p.n_in_category AS DOUBLE) AS marketshare_in_cat "
            "FROM products p SEMI JOIN offers USING (category, company, brand)")


COMPETITION = """SELECT category, COUNT(*) FILTER (WHERE company || brand IS NOT NULL) AS competing_products_in_cat,
       CAST(MAX(spend) AS DOUBLE) / NULLIF(CAST(SUM(spend) AS DOUBLE), 0) AS marketshare_dominant_prod_in_cat
  FROM products GROUP BY category"""


def assembled() -> list[str]:
    columns = user_features() + [c for w in WINDOWS for c in window_features(w, w == min(WINDOWS))]
    per_row = cohort_table([f"{_pid('h')} AS productid", *columns], cohort_sums(WINDOWS, USER_WINDOW), head="h.* EXCLUDE (offervalue)")
    return [PRODUCTS, f"""feature_table AS (
  SELECT r.*, m.marketshare_in_cat, c.competing_products_in_cat, c.marketshare_dominant_prod_in_cat
  FROM ({per_row}) r LEFT JOIN ({share()}) m USING (productid) LEFT JOIN ({COMPETITION}) c ON c.category = r.category)"""]


def _assembled_columns() -> list[str]:
    from revisit.operators.assemble import feature_order
    head = ["split", "id", "chain", "offer", "market", "repeattrips", "repeater", "offerdate",
            "category", "company", "brand", "productid"]
    return head + feature_order()


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["src_csv_roundtrip"] = _with("sparse", [], f"SELECT {_TX_COLS} FROM transactions")
    q["sink_parquet_roundtrip"] = _with("sparse", [], f"SELECT {_TX_COLS} FROM reduced")
    q["offer_keys"] = _with("sparse", [], " UNION ALL ".join(
        f"SELECT '{f}' AS key_field, CAST({f} AS VARCHAR) AS key_value FROM offers "
        f"WHERE {f} IS NOT NULL GROUP BY {f}" for f in PRODUCT_FIELDS))
    q["offer_productids"] = _with("sparse", [], f"SELECT DISTINCT {_pid()} AS productid FROM offers")
    q["reduce_transactions"] = _with("sparse", [], f"SELECT {_TX_COLS} FROM reduced")
    q["reduce_transactions_stream"] = q["reduce_transactions"]
    q["cat_dept_map"] = _with("sparse", [], 'SELECT dept, category, COUNT(*) AS "count" FROM transactions GROUP BY dept, category')
    q["history_offers"] = _with("sparse", [], "SELECT * FROM history_offers")
    q["lookback_join"] = _with("sparse", [], f"""SELECT h.split, h.id, h.offer, t.category, t.company, t.brand,
       h.category AS offer_category, h.company AS offer_company, h.brand AS offer_brand,
       t.purchasequantity, CAST(t.purchaseamount AS DOUBLE) AS purchaseamount, t.date, h.offerdate
FROM reduced t JOIN history_offers h
  ON t.id = h.id AND t.date BETWEEN h.offerdate - {max(WINDOWS)} AND h.offerdate""")
    for n in WINDOWS:
        q[f"has_bought_{n}"] = _with("sparse", [], has_bought(n))
    q["has_bought_wide"] = _with("dense", [f"""wide AS (
  SELECT ROW_NUMBER() OVER (ORDER BY {_KEYS}) - 1 AS offer, category, company, brand, CAST(1 AS DOUBLE) AS offervalue
  FROM (SELECT DISTINCT category, company, brand FROM transactions))""", """wide_cohort AS (
  SELECT h.split, h.id, h.chain, w.offer, h.market, h.offerdate, w.category, w.company, w.offervalue, w.brand
  FROM history h JOIN wide w ON w.offer = h.id % (SELECT COUNT(*) FROM wide))"""], has_bought(90, "wide_cohort"))
    q["user_spend"] = _with("dense", [], user_spend())
    q["product_share"] = _with("sparse", [PRODUCTS], share())
    q["competition"] = _with("sparse", [PRODUCTS], COMPETITION)
    columns = ", ".join(_assembled_columns())
    q["assemble_features"] = _with("dense", assembled(), f"SELECT {columns} FROM feature_table")
    feats = sorted(c for c in _assembled_columns() if c not in NON_FEATURE_COLUMNS)
    q["feature_columns"] = _with("dense", assembled(), " UNION ALL ".join(
        f"SELECT split, id, offer, CAST({i} AS INTEGER) AS position, '{c}' AS feature, "
        f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS value FROM feature_table" for i, c in enumerate(feats)))
    names = [f"has_bought_{n}" for n in WINDOWS] + ["user_spend", "assemble_features"]
    q["check_cohort_rows"] = _with("dense", [], " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_broken, COUNT(*) AS n_expected, TRUE AS ok FROM history"
        for name in names) + """ UNION ALL SELECT 'duplicate_cohort_keys', COUNT(*) - COUNT(DISTINCT (split, id, offer)), 0, 0,
       COUNT(*) = COUNT(DISTINCT (split, id, offer)) FROM history""")
    test = "FROM history WHERE split = 'test'"
    q["gbt_scores"] = _with("dense", [], f"SELECT split, id, offer, TRUE AS scored, TRUE AS in_range {test}")
    q["model_roundtrip"] = _with("dense", [], f"SELECT COUNT(*) AS n_scored, CAST(0 AS BIGINT) AS n_differ, "
                                 f"CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_outside {test}")
    grid = " CROSS JOIN ".join(f"(SELECT UNNEST([{', '.join(map(str, v))}]) AS {k})" for k, v in GRID.items())
    q["cv_grid_metrics"] = f"SELECT {', '.join(f'CAST({k} AS INTEGER) AS {k}' for k in GRID)}, TRUE AS in_range, CAST(1 AS BIGINT) AS n_best FROM {grid}"
    q["model_compare"] = "SELECT UNNEST(['lr', 'rf', 'gbt']) AS classifier, TRUE AS agrees, TRUE AS in_range"
    u = USER_WINDOW
    q["submission"] = _with("dense", [], f"SELECT id, offer, ROUND(CAST(CAST(IF(total_spend_{u} > 0, prodid_spend_{u} / total_spend_{u}, 0.0) AS FLOAT) AS DOUBLE), 5) "
                            f"AS repeatProbability FROM ({user_spend()}) WHERE split = 'test'")
    q["auc_roc"] = _with("dense", [
        f"""scored AS (
  SELECT u.total_spend_30 AS score, CASE WHEN h.repeater = 't' THEN 1 ELSE 0 END AS label
  FROM ({user_spend()}) u JOIN history h ON h.split = u.split AND h.id = u.id AND h.offer = u.offer
  WHERE h.split = 'train')""",
        """per_score AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY score)""",
        """ranked AS (
  SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM per_score)"""],
        """SELECT CAST(SUM(pos * (2 * below + neg)) AS DOUBLE)
         / (CAST(2.0 AS DOUBLE) * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) AS auc_roc,
       CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg
FROM ranked""")
    q["reduce_stream_wide"] = _with("sparse", [], f"SELECT {_TX_COLS} FROM transactions WHERE category IS NOT NULL OR company IS NOT NULL OR brand IS NOT NULL")
    q["facts_incremental"] = _with("dense", [], "SELECT id, date, category, company, brand, COUNT(*) AS n, CAST(SUM(purchasequantity) AS BIGINT) AS q, "
                                   "CAST(SUM(purchaseamount) AS DOUBLE) AS a FROM transactions GROUP BY ALL")
    q["load_raw_csv"] = _with("sparse", [], """SELECT 'loaded ' || dept AS part, COUNT(*) AS n, CAST(SUM(purchasequantity) AS BIGINT) AS quantity, MAX(date) AS last_day
FROM transactions WHERE dept <> 7 AND purchasequantity <> 13 GROUP BY dept
UNION ALL SELECT 'refused for ' || CASE WHEN dept <> 7 THEN 'purchasequantity' WHEN purchasequantity = 13 THEN 'date and purchasequantity' ELSE 'date' END,
  COUNT(*), NULL, NULL FROM transactions WHERE dept = 7 OR purchasequantity = 13 GROUP BY 1""")
    q["submission_checks"] = _with("dense", [], f"SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_unscored, COUNT(*) AS n_requested, TRUE AS ok {test}")
    windows = " UNION ALL ".join(f"SELECT chain, {w} AS days, CAST(has_bought_category_a_{w} AS DOUBLE) AS score, label FROM labelled" for w in WINDOWS)
    q["auc_by_group"] = _with("dense", [*assembled(), """labelled AS (
  SELECT *, CASE WHEN repeater = 't' THEN 1 ELSE 0 END AS label FROM feature_table WHERE split = 'train')""",
        f"""counted AS (SELECT chain, days, score, SUM(label) AS pos, SUM(1 - label) AS neg FROM ({windows}) WHERE score IS NOT NULL GROUP BY ALL)""",
        """ranked AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY chain, days ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM counted)"""],
        """SELECT chain, days, CAST(SUM(pos * (2 * below + neg)) AS DOUBLE)
         / NULLIF(CAST(2.0 AS DOUBLE) * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE), 0) AS auc_roc,
       CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg FROM ranked GROUP BY chain, days""")
    return q
