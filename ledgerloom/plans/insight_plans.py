"""Monthly insight tables over the derived ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.fixtures import checkpointed, duck
from ledgerloom.operators import insights as I
from ledgerloom.operators import offsets as O
from ledgerloom.plans.base import NON, ROWS, Ledger
from ledgerloom.registry import query

_VERDICT = """SELECT ledger_id, month, round(CAST(i AS DOUBLE), 2) AS money_in, round(CAST(e AS DOUBLE), 2) AS earned, round(CAST(o AS DOUBLE), 2) AS money_out, round(CAST(v AS DOUBLE), 2) AS invested,
  round(CAST(i - o - v AS DOUBLE), 2) AS kept, CASE WHEN i > 0 THEN CAST(round(CAST(CAST(i - o - v AS DOUBLE) / CAST(i AS DOUBLE) AS DECIMAL(28,8)), 4) AS DOUBLE) END AS kept_rate, round(CAST(i - e AS DOUBLE), 2) AS other_in
FROM (SELECT ledger_id, month,
  coalesce(sum(amount) FILTER (WHERE debit_credit = 'credit' AND coalesce(category, '') <> 'Self Transfers' AND NOT (coalesce(category, '') = 'Income' AND coalesce(subcategory, '') = 'Opening Balance')), 0) AS i,
  coalesce(sum(amount) FILTER (WHERE debit_credit = 'credit' AND category = 'Income' AND coalesce(subcategory, '') NOT IN ('Refund', 'Opening Balance')), 0) AS e,
  coalesce(sum(amount) FILTER (WHERE debit_credit = 'debit' AND coalesce(category, '') NOT IN ('Self Transfers', 'Investments')), 0) AS o,
  coalesce(sum(amount) FILTER (WHERE debit_credit = 'debit' AND category = 'Investments'), 0) AS v
  FROM r GROUP BY ALL)"""


@query(duck(_VERDICT, r=ROWS))
def monthly_verdict(spark, sf_dir):
    return I.monthly_verdict(Ledger(spark, sf_dir).rows)


#: The phases of the offsets, in order, each under the capacity that the ones before left.
OFFSETS = {
    "r": ROWS,
    "lk": """SELECT l.id AS link_id, l.created_at, c.ledger_id, c.id AS credit_id, c.month, c.amount AS credit, d.id AS debit_id, d.amount AS cap, d.spend_cat AS category
      FROM transaction_links l JOIN r c ON c.id IN (l.txn_a, l.txn_b) AND c.debit_credit = 'credit' JOIN r d ON d.id IN (l.txn_a, l.txn_b) AND d.debit_credit = 'debit'""",
    "links": """SELECT ledger_id, credit_id, debit_id, month, category, least(cap, upto) - least(cap, upto - credit) AS amount
      FROM (SELECT *, sum(credit) OVER (PARTITION BY debit_id ORDER BY created_at, link_id ROWS UNBOUNDED PRECEDING) AS upto FROM lk)""",
    "gd": f"""SELECT m.group_id, r.id, r.spend_cat AS category, r.amount - coalesce(u.used, 0) AS room FROM transaction_group_members m JOIN r ON r.id = m.transaction_id
      LEFT JOIN (SELECT debit_id, sum(amount) AS used FROM links GROUP BY 1) u ON u.debit_id = r.id WHERE debit_credit = 'debit' AND spend_cat NOT IN {NON}""",
    "gt": "SELECT group_id, sum(room) AS total FROM gd GROUP BY 1 HAVING sum(room) > 0",
    "gc": """SELECT m.group_id, r.ledger_id, r.id AS credit_id, r.month, r.amount, gt.total, sum(r.amount) OVER (PARTITION BY m.group_id ORDER BY txn_date, r.id ROWS UNBOUNDED PRECEDING) AS upto
      FROM transaction_group_members m JOIN r ON r.id = m.transaction_id JOIN gt ON gt.group_id = m.group_id WHERE debit_credit = 'credit' AND txn_type = 'split'""",
    "gs": """SELECT g.ledger_id, g.group_id, credit_id, gd.id AS debit_id, month, category, take, (take * room) // total AS base, (take * room) % total AS rest
      FROM (SELECT * REPLACE (CAST(total * 1000000 AS HUGEINT) AS total), CAST((least(total, upto) - least(total, upto - amount)) * 1000000 AS HUGEINT) AS take FROM gc) g
      JOIN (SELECT * REPLACE (CAST(room * 1000000 AS HUGEINT) AS room) FROM gd) gd ON gd.group_id = g.group_id WHERE take > 0 AND room > 0""",
    "groups": """SELECT ledger_id, credit_id, debit_id, month, category,
      CAST(CAST(base + CASE WHEN row_number() OVER (PARTITION BY group_id, credit_id ORDER BY rest DESC, debit_id) <= take - sum(base) OVER (PARTITION BY group_id, credit_id) THEN 1 ELSE 0 END AS DECIMAL(22,0)) * 0.000001 AS DECIMAL(28,6)) AS amount FROM gs""",
    "used": """SELECT credit_id AS id FROM lk UNION SELECT m.transaction_id FROM transaction_group_members m JOIN r ON r.id = m.transaction_id WHERE txn_type = 'split' AND debit_credit = 'credit'""",
    "oc": f"""SELECT * FROM r WHERE debit_credit = 'credit' AND annotation_id IS NOT NULL AND ((category = 'Income' AND subcategory = 'Refund') OR category NOT IN {NON}) AND id NOT IN (SELECT id FROM used)""",
    "labelled": "SELECT ledger_id, id AS credit_id, CAST(NULL AS VARCHAR) AS debit_id, month, category, amount FROM oc WHERE category <> 'Income'",
    "kd": f"""SELECT * FROM (SELECT c.ledger_id, c.id AS credit_id, d.id AS debit_id, c.month, d.spend_cat AS category, c.amount, row_number() OVER (PARTITION BY c.id ORDER BY d.txn_date DESC, d.row_seq DESC) AS n
      FROM oc c JOIN r d ON d.ledger_id = c.ledger_id AND d.counterparty_key = c.counterparty_key AND d.debit_credit = 'debit' AND d.annotation_id IS NOT NULL AND d.txn_date <= c.txn_date WHERE c.category = 'Income') WHERE n = 1 AND category NOT IN {NON}""",
    "by_key": "SELECT ledger_id, credit_id, debit_id, month, category, amount FROM kd",
    "am": f"""SELECT * FROM (SELECT c.ledger_id, c.id AS credit_id, c.txn_date, d.id AS debit_id, c.month, d.spend_cat AS category, c.amount, row_number() OVER (PARTITION BY c.id ORDER BY d.txn_date DESC, d.row_seq DESC) AS n
      FROM oc c JOIN r d ON d.ledger_id = c.ledger_id AND d.amount = c.amount AND d.debit_credit = 'debit' AND d.spend_cat NOT IN {NON} AND d.txn_date <= c.txn_date AND d.txn_date >= c.txn_date - 60
      WHERE c.category = 'Income' AND c.id NOT IN (SELECT credit_id FROM by_key)) WHERE n = 1""",
    "ar": """SELECT am.*, greatest(am.amount - coalesce(u.used, 0), 0) AS room, sum(am.amount) OVER (PARTITION BY am.debit_id ORDER BY txn_date, credit_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM am LEFT JOIN (SELECT debit_id, sum(amount) AS used FROM (SELECT debit_id, amount FROM links UNION ALL SELECT debit_id, amount FROM groups) GROUP BY 1) u ON u.debit_id = am.debit_id""",
    "by_amount": "SELECT ledger_id, credit_id, debit_id, month, category, least(room, upto) - least(room, upto - amount) AS amount FROM ar WHERE least(room, upto) - least(room, upto - amount) > 0",
    "every": " UNION ALL ".join(
        f"SELECT ledger_id, month, category, CAST(amount AS DECIMAL(28,6)) AS amount FROM {phase}{where}"
        for phase, where in (("links", f" WHERE amount > 0 AND category NOT IN {NON}"), ("groups", ""), ("labelled", ""), ("by_key", ""), ("by_amount", ""))
    ),
    "settled": "SELECT id FROM used UNION SELECT id FROM oc",
    "gross": f"SELECT ledger_id, month, spend_cat AS category, sum(amount) AS g, count(*) AS n FROM r WHERE debit_credit = 'debit' AND spend_cat NOT IN {NON} GROUP BY ALL",
    "back": "SELECT ledger_id, month, category, round(sum(amount), 2) AS b FROM every GROUP BY ALL",
    "net": """SELECT coalesce(x.ledger_id, y.ledger_id) AS ledger_id, coalesce(x.month, y.month) AS month, coalesce(x.category, y.category) AS category, round(CAST(coalesce(g, 0) AS DOUBLE), 2) AS gross,
      CAST(coalesce(n, 0) AS BIGINT) AS count, round(CAST(coalesce(b, 0) AS DOUBLE), 2) AS offsets, round(CAST(coalesce(g, 0) - coalesce(b, 0) AS DOUBLE), 2) AS net
      FROM gross x FULL JOIN back y ON x.ledger_id = y.ledger_id AND x.month = y.month AND x.category = y.category""",
    "prev": "SELECT ledger_id, strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS month, category, net AS prev_net FROM net",
    "mom": """SELECT coalesce(x.ledger_id, y.ledger_id) AS ledger_id, coalesce(x.month, y.month) AS month, coalesce(x.category, y.category) AS category, coalesce(net, 0) AS net, coalesce(prev_net, 0) AS prev_net,
      round(coalesce(net, 0) - coalesce(prev_net, 0), 2) AS delta FROM net x FULL JOIN prev y ON x.ledger_id = y.ledger_id AND x.month = y.month AND x.category = y.category
      WHERE (coalesce(x.ledger_id, y.ledger_id), coalesce(x.month, y.month)) IN (SELECT (ledger_id, month) FROM net)""",
}


def _phase(name: str) -> str:
    cols = "ledger_id, credit_id, debit_id, month, category, round(CAST(amount AS DOUBLE), 4) AS amount"
    upto = list(OFFSETS)[: list(OFFSETS).index(name) + 1]
    return duck(f"SELECT {cols} FROM {name}", **{k: OFFSETS[k] for k in upto})


def _offsets(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return O.spend_offsets(t.rows, t.transaction_links, t.transaction_group_members, checkpointed)


def _settled(t: Ledger):
    return O.settled_credits(t.rows, t.transaction_links, t.transaction_group_members)


def _shown(df):
    return df.select("ledger_id", "credit_id", "debit_id", "month", "category", F.round(F.col("amount").cast("double"), 4).alias("amount"))


@query(_phase("links"))
def offsets_links(spark, sf_dir):
    return _shown(_offsets(spark, sf_dir)["links"])


@query(_phase("groups"))
def offsets_groups(spark, sf_dir):
    return _shown(_offsets(spark, sf_dir)["groups"])


@query(_phase("labelled"))
def offsets_labelled(spark, sf_dir):
    return _shown(_offsets(spark, sf_dir)["labelled"])


@query(_phase("by_key"))
def offsets_refund_by_counterparty(spark, sf_dir):
    return _shown(_offsets(spark, sf_dir)["by_counterparty"])


@query(_phase("by_amount"))
def offsets_refund_by_amount(spark, sf_dir):
    return _shown(_offsets(spark, sf_dir)["by_amount"])


@query(duck("SELECT id FROM settled", **OFFSETS))
def settled_credits(spark, sf_dir):
    return _settled(Ledger(spark, sf_dir)).select("id")


def _net(spark, sf_dir):
    return checkpointed(I.category_net_spend(Ledger(spark, sf_dir).rows, _offsets(spark, sf_dir)["all"]))


@query(duck("SELECT * FROM net", **OFFSETS))
def category_net_spend(spark, sf_dir):
    return _net(spark, sf_dir)


_SUBS = f"""SELECT ledger_id, month, spend_cat AS category, sub AS subcategory, round(CAST(sum(amount) AS DOUBLE), 2) AS total, count(*) AS count
FROM (SELECT *, CASE subcategory WHEN 'Dining' THEN 'Restaurants' ELSE coalesce(subcategory, 'Other') END AS sub FROM r WHERE debit_credit = 'debit' AND spend_cat NOT IN {NON})
GROUP BY GROUPING SETS ((ledger_id, month, spend_cat, sub), (ledger_id, month, spend_cat))"""


@query(duck("SELECT * FROM sb", r=ROWS, sb=_SUBS))
def subcategory_breakdown(spark, sf_dir):
    return I.subcategory_breakdown(Ledger(spark, sf_dir).rows)


@query(duck("SELECT * FROM mom", **OFFSETS))
def month_over_month(spark, sf_dir):
    return I.month_over_month(_net(spark, sf_dir))


@query(duck("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, month ORDER BY abs(delta) DESC, category) AS rank FROM mom WHERE abs(delta) >= 1) WHERE rank <= 3", **OFFSETS))
def what_changed(spark, sf_dir):
    return I.what_changed(I.month_over_month(_net(spark, sf_dir)))


_RECURRING = {
    "r": ROWS,
    "ch": """SELECT ledger_id, counterparty_key AS key, CAST(round(amount) AS BIGINT) AS amount, txn_date, row_seq, month, category, merchant,
      date_diff('day', lag(txn_date) OVER (PARTITION BY ledger_id, counterparty_key, CAST(round(amount) AS BIGINT) ORDER BY txn_date, row_seq), txn_date) AS gap
      FROM r WHERE debit_credit = 'debit' AND counterparty_key IS NOT NULL AND coalesce(category, '') NOT IN ('Transfers', 'Self Transfers')""",
    "un": """SELECT ledger_id, key, amount, count(DISTINCT month) AS months_seen, min(month) AS lo, max(month) AS hi, count(*) AS n, median(gap) AS gap,
      arg_max_null(category, (txn_date, row_seq)) AS category, max(txn_date) AS last_date FROM ch GROUP BY ALL""",
    "us": "SELECT *, (CAST(substr(hi, 1, 4) AS INT) - CAST(substr(lo, 1, 4) AS INT)) * 12 + CAST(substr(hi, 6, 2) AS INT) - CAST(substr(lo, 6, 2) AS INT) + 1 AS months_span FROM un",
    "mm": "SELECT ledger_id, key, amount, merchant FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, key, amount ORDER BY n DESC, merchant) AS k FROM (SELECT ledger_id, key, amount, merchant, count(*) AS n FROM ch WHERE merchant IS NOT NULL GROUP BY ALL)) WHERE k = 1",
    "rec": """SELECT u.ledger_id, u.key, coalesce(mm.merchant, array_to_string(list_transform(string_split(lower(u.key), ' '), lambda x: upper(x[1]) || x[2:]), ' ')) AS name, category, u.amount, months_seen, CAST(months_span AS INT) AS months_span,
      CASE WHEN gap BETWEEN 25 AND 35 THEN 'monthly' ELSE 'irregular' END AS cadence, last_date, date_diff('day', last_date, latest) <= 45 AS active
      FROM us u LEFT JOIN mm ON mm.ledger_id = u.ledger_id AND mm.key = u.key AND mm.amount = u.amount JOIN (SELECT ledger_id, max(txn_date) AS latest FROM r GROUP BY 1) l ON l.ledger_id = u.ledger_id
      WHERE n <= 1.5 * months_seen AND ((months_seen >= 3 AND months_seen >= 0.6 * months_span) OR (months_seen >= 2 AND category IN ('Subscriptions', 'Investments')))""",
}


@query(duck("SELECT * FROM rec", **_RECURRING), dates="last_date")
def recurring_charges(spark, sf_dir):
    return I.recurring_charges(Ledger(spark, sf_dir).rows)


@query(duck("""SELECT ledger_id, name, count(*) AS items, CAST(coalesce(sum(amount) FILTER (WHERE active), 0) AS BIGINT) AS active_total,
CAST(coalesce(sum(amount) FILTER (WHERE active AND cadence = 'monthly'), 0) AS BIGINT) AS monthly_total, CAST(coalesce(sum(amount) FILTER (WHERE NOT active), 0) AS BIGINT) AS stopped_total FROM rec GROUP BY ALL""", **_RECURRING))
def committed_by_name(spark, sf_dir):
    return I.committed_by_name(I.recurring_charges(Ledger(spark, sf_dir).rows))


_PEOPLE = {
    "mv": "SELECT *, lower(coalesce(counterparty_key, '')) AS cpk, lower(coalesce(merchant, '')) AS m FROM r WHERE category = 'Transfers' AND coalesce(subcategory, '') <> 'ATM Withdrawal' AND id NOT IN (SELECT id FROM settled)",
    "mt": """SELECT id, person_id, name, relationship FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rk, name, person_id) AS n FROM (
      SELECT mv.id, p.id AS person_id, p.name, p.relationship, CASE WHEN m <> '' AND m = lower(p.name) THEN 0
        WHEN (length(p.name) >= 4 AND (contains(cpk, lower(p.name)) OR contains(m, lower(p.name)))) OR (length(p.upi) >= 4 AND (contains(cpk, lower(p.upi)) OR contains(m, lower(p.upi)))) THEN 1 END AS rk
      FROM mv JOIN people p ON p.ledger_id = mv.ledger_id) WHERE rk IS NOT NULL) WHERE n = 1""",
}
_PEOPLE["ppl"] = """SELECT m.ledger_id, person_id, name, relationship, round(CAST(coalesce(sum(amount) FILTER (WHERE debit_credit = 'debit'), 0) AS DOUBLE), 2) AS sent,
round(CAST(coalesce(sum(amount) FILTER (WHERE debit_credit = 'credit'), 0) AS DOUBLE), 2) AS received, round(CAST(sum(CASE debit_credit WHEN 'credit' THEN amount ELSE -amount END) AS DOUBLE), 2) AS net, count(*) AS count, max(txn_date) AS last_date
FROM mv m LEFT JOIN mt USING (id) GROUP BY ALL"""


@query(duck("SELECT * FROM ppl", **OFFSETS, **_PEOPLE), dates="last_date")
def people_ledger(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return I.people_ledger(t.rows, t.people, _settled(t))


_MERGE = {
    "r": ROWS,
    "sp": f"SELECT ledger_id, month, upper(coalesce(counterparty_key, merchant)) AS key, merchant, amount FROM r WHERE debit_credit = 'debit' AND spend_cat NOT IN {NON} AND coalesce(counterparty_key, merchant) IS NOT NULL",
    "mk": """SELECT a.ledger_id, a.month, a.key, coalesce(arg_min(b.key, length(b.key)), a.key) AS canonical FROM (SELECT DISTINCT ledger_id, month, key FROM sp) a
      LEFT JOIN (SELECT DISTINCT ledger_id, month, key FROM sp WHERE length(key) >= 5) b ON a.ledger_id = b.ledger_id AND a.month = b.month AND (a.key = b.key OR starts_with(a.key, b.key || ' ')) GROUP BY a.ledger_id, a.month, a.key""",
}


@query(duck("SELECT * FROM mk", **_MERGE))
def merge_merchant_keys(spark, sf_dir):
    rows = Ledger(spark, sf_dir).rows.withColumn("month", F.date_format("txn_date", "yyyy-MM"))
    spend = rows.where((F.col("debit_credit") == "debit") & I.S.is_spend(F.col("category"))).withColumn("key", F.upper(F.coalesce("counterparty_key", "merchant"))).where("key is not null")
    return I.merge_merchant_keys(spend, ["ledger_id", "month"])


_TOP = {
    "j": "SELECT sp.*, canonical FROM sp JOIN mk USING (ledger_id, month, key)",
    "tm": "SELECT ledger_id, month, canonical, merchant FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, month, canonical ORDER BY n DESC, merchant) AS k FROM (SELECT ledger_id, month, canonical, merchant, count(*) AS n FROM j WHERE merchant IS NOT NULL GROUP BY ALL)) WHERE k = 1",
    "ts": "SELECT ledger_id, month, canonical, sum(amount) AS t, count(*) AS n FROM j GROUP BY ALL",
    "top": """SELECT ledger_id, month, rank, coalesce(merchant, array_to_string(list_transform(string_split(lower(canonical), ' '), lambda x: upper(x[1]) || x[2:]), ' ')) AS name, round(CAST(t AS DOUBLE), 2) AS total, n AS count,
      CAST(round(CAST(CAST(t AS DOUBLE) / n AS DECIMAL(28,8)), 2) AS DOUBLE) AS avg FROM (SELECT ts.*, merchant, row_number() OVER (PARTITION BY ts.ledger_id, ts.month ORDER BY t DESC, ts.canonical) AS rank FROM ts LEFT JOIN tm USING (ledger_id, month, canonical)) WHERE rank <= 8""",
}


@query(duck("SELECT * FROM top", **_MERGE, **_TOP))
def top_merchants(spark, sf_dir):
    return I.top_merchants(Ledger(spark, sf_dir).rows)


_PRIMARY = {
    "st": "SELECT t.*, s.bank_name, s.account_ref FROM transactions t JOIN statements s ON s.id = t.statement_id WHERE running_balance IS NOT NULL",
    "bk": "SELECT ledger_id, bank_name FROM (SELECT ledger_id, bank_name, row_number() OVER (PARTITION BY ledger_id ORDER BY count(*) DESC, bank_name) AS k FROM st GROUP BY ledger_id, bank_name) WHERE k = 1",
    "ac": "SELECT ledger_id, bank_name, account_ref, row_number() OVER (PARTITION BY ledger_id, bank_name ORDER BY count(*) DESC, account_ref) AS k, count(*) OVER (PARTITION BY ledger_id, bank_name) AS accounts FROM st WHERE account_ref <> '' GROUP BY ledger_id, bank_name, account_ref",
    "pa": """SELECT bk.ledger_id, bk.bank_name, account_ref, coalesce(accounts, 0) AS accounts, bk.bank_name || CASE WHEN account_ref IS NULL THEN '' ELSE ' ····' || right(account_ref, 4) END AS label
      FROM bk LEFT JOIN ac ON ac.ledger_id = bk.ledger_id AND ac.bank_name = bk.bank_name AND k = 1""",
}


@query(duck("SELECT * FROM pa", **_PRIMARY))
def primary_account(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return I.primary_account(t.transactions, t.statements)


_BALANCE = {**_PRIMARY, "bal": """SELECT ledger_id, account, date, balance FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY date) AS i, count(*) OVER (PARTITION BY ledger_id) AS n FROM (
  SELECT st.ledger_id, pa.label AS account, txn_date AS date, CAST(arg_max(running_balance, row_seq) AS DOUBLE) AS balance FROM st JOIN pa ON pa.ledger_id = st.ledger_id AND pa.bank_name = st.bank_name AND (accounts <= 1 OR st.account_ref = pa.account_ref) GROUP BY ALL))
WHERE (i - 1) % CAST(greatest(ceil(n / 240.0), 1) AS BIGINT) = 0 OR i = n"""}


@query(duck("SELECT * FROM bal", **_BALANCE), dates="date")
def balance_series(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return I.balance_series(t.transactions, t.statements)


_OPEN = "SELECT ledger_id, month, count(*) FILTER (WHERE o) AS count, round(CAST(coalesce(sum(amount) FILTER (WHERE o), 0) AS DOUBLE), 2) AS total FROM (SELECT *, debit_credit = 'debit' AND (annotation_id IS NULL OR category = 'Miscellaneous') AS o FROM r) GROUP BY ALL"


@query(duck(_OPEN, r=ROWS))
def unexplained(spark, sf_dir):
    return I.unexplained(Ledger(spark, sf_dir).rows)


@query(duck("SELECT ledger_id, month, count(DISTINCT id) AS total, count(DISTINCT CASE WHEN annotation_id IS NOT NULL THEN id END) AS annotated FROM r GROUP BY ALL", r=ROWS))
def annotation_coverage(spark, sf_dir):
    return I.annotation_coverage(Ledger(spark, sf_dir).rows)


def _cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


_PARTS = {
    **OFFSETS, **{k: v for k, v in _PEOPLE.items()}, **{k: v for k, v in _RECURRING.items() if k != "r"}, **{k: v for k, v in _MERGE.items() if k != "r"}, **_TOP, **_BALANCE, "sb": _SUBS, "vd": _VERDICT, "op": _OPEN,
    "ms": "SELECT ledger_id, string_agg(month, ',' ORDER BY month) AS months, count(*) AS n_months FROM (SELECT DISTINCT ledger_id, month FROM r) GROUP BY 1",
    "ask": "SELECT ledger_id, coalesce(max(month) FILTER (WHERE month = '{month}'), max(month)) AS month, strftime(CAST(coalesce(max(month) FILTER (WHERE month = '{month}'), max(month)) || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS prev_month FROM r GROUP BY 1",
    "cats": f"""SELECT a.ledger_id, string_agg(n.category || ':' || {_cents("n.gross")} || ':' || {_cents("n.net")} || ':' || {_cents("n.offsets")} || ':' || n.count || ':' || {_cents("coalesce(p.net, 0)")} || ':' || {_cents("round(n.net - coalesce(p.net, 0), 2)")} || ':' || coalesce(s.subs, ''), '|' ORDER BY n.net DESC, n.category) AS categories
      FROM ask a JOIN net n ON n.ledger_id = a.ledger_id AND n.month = a.month LEFT JOIN net p ON p.ledger_id = a.ledger_id AND p.month = a.prev_month AND p.category = n.category
      LEFT JOIN (SELECT ledger_id, month, category, string_agg(subcategory || '=' || {_cents("total")} || '/' || count, ';' ORDER BY total DESC, subcategory) AS subs FROM sb WHERE subcategory IS NOT NULL GROUP BY ALL) s ON s.ledger_id = n.ledger_id AND s.month = n.month AND s.category = n.category GROUP BY 1""",
    "chg": f"""SELECT ledger_id, string_agg(category || ':' || {_cents("delta")} || ':' || {_cents("cur")} || ':' || {_cents("pre")}, '|' ORDER BY k) AS what_changed FROM (
      SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY abs(delta) DESC, category) AS k FROM (SELECT a.ledger_id, n.category, coalesce(max(net) FILTER (WHERE n.month = a.month), 0) AS cur, coalesce(max(net) FILTER (WHERE n.month = a.prev_month), 0) AS pre,
        round(coalesce(max(net) FILTER (WHERE n.month = a.month), 0) - coalesce(max(net) FILTER (WHERE n.month = a.prev_month), 0), 2) AS delta
        FROM ask a JOIN net n ON n.ledger_id = a.ledger_id AND n.month IN (a.month, a.prev_month) GROUP BY ALL) WHERE abs(delta) >= 1) WHERE k <= 3 GROUP BY 1""",
    "rcs": "SELECT ledger_id, string_agg(name || ':' || coalesce(category, '') || ':' || amount || ':' || months_seen || '/' || months_span || ':' || cadence || ':' || last_date || ':' || active, '|' ORDER BY amount DESC, name, key) AS recurring FROM rec GROUP BY 1",
    "pps": f"""SELECT ledger_id, string_agg(name || ':' || {_cents("sent")} || ':' || {_cents("received")} || ':' || {_cents("net")} || ':' || count || ':' || last_date, '|' ORDER BY abs(net) DESC, name, person_id) FILTER (WHERE person_id IS NOT NULL) AS people,
      {_cents("coalesce(max(sent) FILTER (WHERE person_id IS NULL), 0)")} AS unmatched_sent, {_cents("coalesce(max(received) FILTER (WHERE person_id IS NULL), 0)")} AS unmatched_received, CAST(coalesce(max(count) FILTER (WHERE person_id IS NULL), 0) AS BIGINT) AS unmatched_count FROM ppl GROUP BY 1""",
    "mcs": f"SELECT a.ledger_id, string_agg(name || ':' || {_cents('total')} || ':' || count || ':' || {_cents('avg')}, '|' ORDER BY rank) AS merchants FROM ask a JOIN top t ON t.ledger_id = a.ledger_id AND t.month = a.month GROUP BY 1",
    "bls": f"SELECT ledger_id, any_value(account) AS account, count(*) AS points, string_agg(date || '=' || {_cents('balance')}, ',' ORDER BY date) AS balance FROM bal GROUP BY 1",
    "out": f"""SELECT a.ledger_id, a.month, a.prev_month, months, {_cents("v.money_in")} AS money_in, {_cents("v.money_out")} AS money_out, {_cents("v.invested")} AS invested, {_cents("v.kept")} AS kept, v.kept_rate, {_cents("coalesce(p.money_in, 0)")} AS prev_in, {_cents("coalesce(p.kept, 0)")} AS prev_kept, p.kept_rate AS prev_rate,
      coalesce(what_changed, '') AS what_changed, coalesce(categories, '') AS categories, coalesce(recurring, '') AS recurring, coalesce(people, '') AS people, coalesce(unmatched_sent, 0) AS unmatched_sent, coalesce(unmatched_received, 0) AS unmatched_received, coalesce(unmatched_count, 0) AS unmatched_count,
      coalesce(merchants, '') AS merchants, account, coalesce(points, 0) AS points, md5(coalesce(balance, '')) AS balance, o.count AS unexplained_count, {_cents("o.total")} AS unexplained, c.total, c.annotated
      FROM ask a JOIN ms ON ms.ledger_id = a.ledger_id JOIN vd v ON v.ledger_id = a.ledger_id AND v.month = a.month LEFT JOIN vd p ON p.ledger_id = a.ledger_id AND p.month = a.prev_month
      LEFT JOIN chg ON chg.ledger_id = a.ledger_id LEFT JOIN cats ON cats.ledger_id = a.ledger_id LEFT JOIN rcs ON rcs.ledger_id = a.ledger_id LEFT JOIN pps ON pps.ledger_id = a.ledger_id LEFT JOIN mcs ON mcs.ledger_id = a.ledger_id LEFT JOIN bls ON bls.ledger_id = a.ledger_id
      JOIN op o ON o.ledger_id = a.ledger_id AND o.month = a.month JOIN (SELECT ledger_id, month, count(DISTINCT id) AS total, count(DISTINCT CASE WHEN annotation_id IS NOT NULL THEN id END) AS annotated FROM r GROUP BY ALL) c ON c.ledger_id = a.ledger_id AND c.month = a.month""",
}


def _summary_sql(month: str) -> str:
    return duck("SELECT * FROM out", **_PARTS | {"ask": _PARTS["ask"].replace("{month}", month)})


def _summary(spark, sf_dir, month):
    t = Ledger(spark, sf_dir)
    rows, net = t.rows, _net(spark, sf_dir)
    marts = {
        "verdict": I.monthly_verdict(rows), "net": net, "subcategories": I.subcategory_breakdown(rows), "recurring": I.recurring_charges(rows), "people": I.people_ledger(rows, t.people, _settled(t)),
        "merchants": I.top_merchants(rows), "balance": I.balance_series(t.transactions, t.statements), "unexplained": I.unexplained(rows), "coverage": I.annotation_coverage(rows),
    }
    out = I.insight_summary(marts, month)
    cents = lambda c: F.round(c * 100).cast("long")
    told = lambda rows, sep, *parts: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", *[p(x).cast("string") for p in parts])), sep)
    get = lambda f: lambda x: F.coalesce(x[f].cast("string"), F.lit(""))
    money = lambda f: lambda x: cents(x[f])
    subs = lambda x: F.array_join(F.transform(x["subcategories"], lambda y: F.concat(y["subcategory"], F.lit("="), cents(y["total"]).cast("string"), F.lit("/"), y["count"].cast("string"))), ";")
    span = lambda x: F.concat(x["months_seen"].cast("string"), F.lit("/"), x["months_span"].cast("string"))
    series = F.array_join(F.transform("balance", lambda x: F.concat(x["date"].cast("string"), F.lit("="), cents(x["balance"]).cast("string"))), ",")
    return out.select(
        "ledger_id", "month", "prev_month", F.array_join("months", ",").alias("months"), *[cents(F.col(f"verdict.{c}")).alias(c) for c in ("money_in", "money_out", "invested", "kept")], "verdict.kept_rate",
        cents(F.col("prev_verdict.money_in")).alias("prev_in"), cents(F.col("prev_verdict.kept")).alias("prev_kept"), F.col("prev_verdict.kept_rate").alias("prev_rate"),
        told("what_changed", "|", get("category"), money("delta"), money("current"), money("previous")).alias("what_changed"),
        told("categories", "|", get("category"), money("gross"), money("net"), money("offsets"), get("count"), money("prev_net"), money("delta"), subs).alias("categories"),
        told("recurring", "|", get("name"), get("category"), get("amount"), span, get("cadence"), get("last_date"), get("active")).alias("recurring"),
        told("people", "|", get("name"), money("sent"), money("received"), money("net"), get("count"), get("last_date")).alias("people"),
        cents(F.col("unmatched.sent")).alias("unmatched_sent"), cents(F.col("unmatched.received")).alias("unmatched_received"), F.col("unmatched.count").alias("unmatched_count"),
        told("merchants", "|", get("name"), money("total"), get("count"), money("avg")).alias("merchants"), "account", F.size("balance").cast("long").alias("points"), F.md5(series).alias("balance"),
        F.col("unexplained.count").alias("unexplained_count"), cents(F.col("unexplained.total")).alias("unexplained"), "annotation.total", "annotation.annotated",
    )


@query(_summary_sql(""))
def insight_summary(spark, sf_dir):
    return _summary(spark, sf_dir, None)


@query(_summary_sql("1996-02"))
def insight_summary_month(spark, sf_dir):
    """A month that is asked for; ledgers without it tell their latest."""
    return _summary(spark, sf_dir, "1996-02")
