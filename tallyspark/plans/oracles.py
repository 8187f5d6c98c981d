"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from tallyspark.functions.text import WHITESPACE

_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

_TXN = """
txn AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, l_returnflag, l_linestatus,
    CASE WHEN l_orderkey % 997 <> 0 THEN CAST(l_shipdate AS DATE) END AS date,
    p_name || ' ' || lower(p_type) AS description,
    CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS paid_out,
    CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS DECIMAL(18,2)) AS paid_in,
    CASE WHEN l_linestatus = 'O' THEN 'Natwest' ELSE 'Aqua' END AS source
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_PATTERNS = """
pattern_rules(rule_ord, match_text, category, subcategory, type, weight) AS (VALUES
  (5, 'hot', 'Bills', 'Card Interest', 'operating', 4.0), (6, 'new', 'Bills', 'Utilities', 'operating', 1.5),
  (7, 'economy', 'Groceries', 'Market', 'operating', 1.0), (8, 'x', 'Never', 'Short', 'operating', 9.0),
  (9, 'large', 'Bills', 'Rent', 'operating', 0.35))"""

_MERCHANTS = """
merchant_rules(rule_ord, alias_ord, match_text, category, subcategory, type, name) AS (VALUES
  (0, 0, 'widget', 'Shopping', 'Widgets', 'operating', 'Widget Co'),
  (0, 1, 'blue widget', 'Shopping', 'Widgets', 'operating', 'Widget Co'),
  (1, 0, 'gear', 'Transport', '', 'operating', 'Gear Shop'),
  (2, 0, 'ring', 'P2P', 'Alex', 'transfer', 'Ring Friend'),
  (2, 1, 'cold ring', 'P2P', 'Alex', 'transfer', 'Ring Friend'),
  (3, 0, 'rod', 'P2P', '', 'transfer', 'Rod Friend'),
  (4, 0, 'plate', 'Debt', 'Card Payoff', 'financing', 'Plate Card'))"""

_WINNERS = """
rules AS (
  SELECT 0 AS kind, rule_ord, alias_ord, match_text, category, subcategory, type, 'merchant:' || name AS rule_match,
    CAST(length(match_text) * 10 + 50 AS INTEGER) AS score FROM merchant_rules
  UNION ALL
  SELECT 1, rule_ord, 0, match_text, category, subcategory, type, 'pattern:' || match_text,
    CAST(trunc(length(match_text) * 10 * CAST(weight AS DOUBLE)) AS INTEGER) FROM pattern_rules),
hits AS (
  SELECT d.description, r.* FROM (SELECT DISTINCT description FROM txn) d
  JOIN rules r ON length(r.match_text) >= 2 AND contains(d.description, r.match_text)),
winners AS (
  SELECT * FROM hits QUALIFY row_number() OVER (
    PARTITION BY description ORDER BY score DESC, kind, rule_ord, alias_ord) = 1),
cat AS (
  SELECT t.*, coalesce(w.category, 'Uncategorized') AS category, coalesce(w.subcategory, '') AS subcategory,
    coalesce(w.type, 'operating') AS type, coalesce(w.rule_match, 'none') AS rule_match,
    coalesce(w.score, 0) AS confidence
  FROM txn t LEFT JOIN winners w USING (description)),
ledger AS (
  SELECT * REPLACE (nullif(subcategory, '') AS subcategory), coalesce(strftime(date, '%Y-%m'), '') AS month FROM cat)"""

_CATEGORIZED = f"WITH {_TXN}, {_MERCHANTS}, {_PATTERNS}, {_WINNERS}"

_SPEND = "type = 'operating' AND category <> 'P2P' AND paid_out > 0"
_INCOME = "type = 'operating' AND paid_in > 0"

_KPIS = f"""{_CATEGORIZED},
spend AS (SELECT month AS month_str, sum(paid_out) AS s FROM ledger WHERE {_SPEND} GROUP BY 1),
income AS (SELECT month AS month_str, sum(paid_in) AS i FROM ledger WHERE {_INCOME} GROUP BY 1),
top AS (
  SELECT month AS month_str, category FROM ledger WHERE {_SPEND} GROUP BY month, category
  QUALIFY row_number() OVER (PARTITION BY month ORDER BY sum(paid_out) DESC, category) = 1),
months AS (
  SELECT month_str, CAST(s AS DOUBLE) AS s, CAST(coalesce(i, 0) AS DOUBLE) AS i, category,
    CASE WHEN coalesce(i, 0) > 0 THEN CAST(s AS DOUBLE) / CAST(i AS DOUBLE) * 100 ELSE 0 END AS coverage
  FROM spend LEFT JOIN income USING (month_str) JOIN top USING (month_str)),
kpis AS (
  SELECT month_str, s AS total_spend, i AS total_income, round(sum(s) OVER () / count(*) OVER (), 6) AS avg_monthly_burn,
    round(coverage, 6) AS income_coverage, category AS top_category, lag(month_str) OVER w AS prev_month,
    CASE WHEN lag(s) OVER w > 0 THEN round(s - lag(s) OVER w, 2) END AS spend_delta,
    CASE WHEN lag(s) OVER w > 0 THEN round((s - lag(s) OVER w) / lag(s) OVER w * 100, 6) END AS spend_delta_pct,
    CASE WHEN lag(i) OVER w > 0 THEN round(coverage - lag(coverage) OVER w, 6) END AS coverage_delta_pp
  FROM months WINDOW w AS (ORDER BY month_str))"""

_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_AMOUNT_TEXT = f"""CASE l_orderkey % 4 WHEN 0 THEN '£' || format('{{:,.2f}}', l_extendedprice)
  WHEN 1 THEN '(' || CAST({_PRICE} AS VARCHAR) || ')' WHEN 2 THEN CAST({_PRICE} AS VARCHAR) || '-'
  ELSE CAST({_PRICE} AS VARCHAR) || ' CR' END"""


def _date_text(date: str) -> str:
    return f"""CASE l_orderkey % 4 WHEN 0 THEN strftime({date}, '%d/%m/%Y') WHEN 1 THEN strftime({date}, '%Y-%m-%d')
  WHEN 2 THEN strftime({date}, '%d %b %Y') ELSE 'not a date' END"""


def _parsed(text: str) -> str:
    return f"""CAST(coalesce(try_strptime({text}, '%d/%m/%Y'), try_strptime({text}, '%Y-%m-%d'),
  try_strptime({text}, '%d %b %Y')) AS DATE)"""


_RAW = f"""
raw AS (
  SELECT {_ROW}, p_type, p_name, l_linestatus, l_discount, {_date_text('l_shipdate')} AS date_text,
    {_PRICE} AS price, l_returnflag = 'R' AS back
  FROM lineitem JOIN part ON l_partkey = p_partkey),
parsed AS (SELECT *, {_parsed('date_text')} AS date FROM raw)"""

_DESCRIBED = """CASE layout WHEN 'Aqua' THEN p_name || ' ' || lower(p_type)
    WHEN 'Natwest' THEN CASE WHEN l_linestatus = 'O' THEN 'CASH: ' ELSE '' END || p_name
    WHEN 'Nationwide' THEN CASE WHEN l_linestatus = 'O' THEN 'ATM Withdrawal: ' ELSE '' END || p_name END"""


def _staged(layout: str) -> str:
    return f"""
SELECT {_ROW}, date, {_DESCRIBED} AS description,
  CASE WHEN layout IS NOT NULL THEN CAST(CASE WHEN back THEN 0 ELSE price END AS DOUBLE) END AS paid_out,
  CASE WHEN layout IS NOT NULL THEN CAST(CASE WHEN back THEN price ELSE 0 END AS DOUBLE) END AS paid_in,
  layout AS source, CASE layout WHEN 'Nationwide' THEN 'Debit' WHEN 'Aqua' THEN 'Credit' WHEN 'Natwest' THEN 'Credit'
  END AS account_type, 'Uncategorized' AS category, '' AS subcategory,
  CASE WHEN layout IS NOT NULL THEN false END AS currency_warning
FROM (SELECT *, {layout} AS layout FROM parsed)"""


_TYPE_LAYOUT = """CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Aqua' WHEN p_type = 'LARGE' THEN 'Natwest'
  WHEN p_type = 'STANDARD' THEN 'Nationwide' END"""

_SUPPLIER_LAYOUT = "CASE l_suppkey % 4 WHEN 0 THEN 'Aqua' WHEN 1 THEN 'Natwest' WHEN 2 THEN 'Nationwide' END"

_LINES = f"""WITH {_RAW},
lined AS (SELECT *, {_SUPPLIER_LAYOUT} AS layout FROM parsed),
staged AS (
  SELECT 'supplier_' || l_suppkey || '.csv' AS source_file, l_orderkey AS block_start,
    CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS line_idx,
    CASE WHEN layout IS NOT NULL THEN date END AS date, {_DESCRIBED} AS description,
    CASE WHEN layout IS NOT NULL THEN CAST(CASE WHEN back THEN 0 ELSE price END AS DOUBLE) END AS paid_out,
    CASE WHEN layout IS NOT NULL THEN CAST(CASE WHEN back THEN price ELSE 0 END AS DOUBLE) END AS paid_in,
    layout AS source, CASE layout WHEN 'Nationwide' THEN 'Debit' WHEN 'Aqua' THEN 'Credit'
      WHEN 'Natwest' THEN 'Credit' END AS account_type,
    CASE WHEN layout IS NULL THEN 'unknown_layout' WHEN l_discount = 0.1 THEN 'too_wide'
      WHEN date IS NULL THEN 'bad_date' END AS reject_reason
  FROM lined
  UNION ALL
  -- Of an unknown file the preamble passes for the header and the header for a row.
  SELECT 'supplier_' || s_suppkey || '.csv', -1, 1, NULL, NULL, NULL, NULL, NULL, NULL, 'unknown_layout'
  FROM supplier WHERE s_suppkey % 4 = 3)"""

_FREQ = f"""{_CATEGORIZED},
unc AS (SELECT *, lower(trim(description)) AS d FROM ledger WHERE category = 'Uncategorized'),
freq AS (SELECT d AS description, count(*) AS count FROM unc GROUP BY 1)"""


def _lcs(a: str, b: str) -> str:
    """Last cell of the usual table, one row per character of ``a``."""
    return f"""list_last(list_reduce(list_transform(string_split({a}, ''), lambda c: [ord(c)]), lambda r, ch:
  list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, j:
    list_append(acc, CASE WHEN {b}[j[1]::INT] = chr(ch[1]::INT) THEN r[j[1]::INT] + 1
      ELSE greatest(r[j[1]::INT + 1], acc[j[1]::INT]) END)),
  list_transform(range(0, length({b}) + 1), lambda z: 0)))"""


def _tokens(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({text}, ' '), lambda t: t <> '')), ' ')"


def _scored(left: str, right: str, cutoff: int, name: str, by_edits: bool = False) -> str:
    """Pairs of the one-column tables ``left(a)`` and ``right(b)`` that reach the cutoff.

    With ``by_edits`` the edit distance, which never exceeds the number of unmatched characters, sorts most pairs out."""
    edits = f"AND 100 * levenshtein(ka, kb) <= {100 - cutoff} * (length(ka) + length(kb))" if by_edits else ""
    return f"""
{name} AS (
  SELECT a, b, 200.0 * n / total AS score FROM (
    SELECT a, b, {_lcs('ka', 'kb')} AS n, length(ka) + length(kb) AS total
    FROM (SELECT a, {_tokens('a')} AS ka FROM {left}), (SELECT b, {_tokens('b')} AS kb FROM {right})
    WHERE 200 * least(length(ka), length(kb)) >= {cutoff} * (length(ka) + length(kb)) {edits})
  WHERE 200 * n >= {cutoff} * total)"""


_MEMBERS = f"""{_FREQ.replace('WITH', 'WITH RECURSIVE', 1)},
texts_a AS (SELECT description AS a FROM freq), texts_b AS (SELECT description AS b FROM freq),
{_scored('texts_a', 'texts_b', 85, 'edges')},
near AS MATERIALIZED (SELECT a, list(b) AS bs FROM edges GROUP BY a),
walk(anchor, taken, pool) AS (
  SELECT CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), list(description ORDER BY count DESC, description) FROM freq
  UNION ALL
  SELECT near.a, list_filter(pool, lambda x: list_contains(bs, x)), list_filter(pool, lambda x: NOT list_contains(bs, x))
  FROM walk JOIN near ON near.a = walk.pool[1]),
members AS (
  SELECT m.description, freq.count, anchor
  FROM (SELECT anchor, unnest(taken) AS description FROM walk WHERE anchor IS NOT NULL) m JOIN freq USING (description)),
clusters AS (SELECT anchor, count(*) AS n_aliases, CAST(sum(count) AS BIGINT) AS count FROM members GROUP BY 1),
samples AS (
  SELECT anchor, CAST(row_number() OVER (PARTITION BY anchor ORDER BY {_SEQ}) AS INTEGER) AS sample_no, unc.date, unc.d AS description,
    CAST(paid_out AS DOUBLE) AS paid_out, CAST(paid_in AS DOUBLE) AS paid_in, source
  FROM unc JOIN members ON members.description = unc.d QUALIFY sample_no <= 5)"""


def _slug(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9_]+', '_', 'g'), '_')"


_DIRECTORY = f"""
directory AS (
  SELECT p_name, min(p_partkey) AS rule_ord, {_slug('p_name')} AS id, p_name || ' ' || max(lower(p_type)) AS name,
    list_sort(list(DISTINCT CASE WHEN p_size > 40 THEN p_name || ' ' || lower(p_type)
      WHEN p_size <= 10 THEN lower(p_type) || ' ' || p_name
      ELSE lower(p_type) || ' ' || p_name || ' ' || lower(p_brand) END)) AS aliases
  FROM part GROUP BY p_name),
dir_alias AS (
  SELECT id, name, rule_ord, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS alias_ord FROM directory)"""


def _suggest(by_edits: bool = False) -> str:
    """Suggestions for ``members`` from ``directory`` and ``dir_alias``."""
    return f"""
owner AS (SELECT * FROM dir_alias QUALIFY row_number() OVER (PARTITION BY alias ORDER BY rule_ord DESC, id DESC) = 1),
anchors AS (SELECT DISTINCT anchor AS a FROM members),
names AS (SELECT DISTINCT lower(name) AS b FROM directory), alias_texts AS (SELECT DISTINCT alias AS b FROM dir_alias),
{_scored('anchors', 'names', 85, 'by_name', by_edits)}, {_scored('anchors', 'alias_texts', 88, 'by_alias', by_edits)},
top_names AS (
  SELECT a, b, score, name, rule_ord FROM by_name JOIN directory ON lower(name) = b
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, rule_ord, name) <= 3),
name_owner AS (
  SELECT lower(name) AS b, id AS owner_id, name AS owner_name FROM directory
  QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY rule_ord DESC, id DESC) = 1),
top_aliases AS (
  SELECT a, b, score, id, name, rule_ord FROM by_alias JOIN dir_alias ON alias = b
  QUALIFY row_number() OVER (PARTITION BY a, id ORDER BY score DESC, rule_ord, alias_ord, b) = 1),
found AS (
  SELECT anchor, 1 AS priority, 'alias_exact' AS kind, min(description) AS info, 0.0 AS score, 0 AS place,
    id AS merchant_id, name AS merchant_name
  FROM members JOIN owner ON alias = lower(description) GROUP BY anchor, id, name
  UNION ALL
  SELECT a, 2, 'name_fuzzy', name || ' (' || CAST(floor(score) AS INTEGER) || '%)', score, rule_ord, owner_id, owner_name
  FROM top_names JOIN name_owner USING (b)
  UNION ALL
  SELECT a, 3, 'alias_fuzzy', 'alias ''' || b || ''' (' || CAST(floor(score) AS INTEGER) || '%)', 0.0, rule_ord, id, name
  FROM top_aliases),
suggestions AS (
  SELECT anchor, CAST(row_number() OVER (
    PARTITION BY anchor ORDER BY priority, score DESC, place, info, merchant_id) AS INTEGER) AS suggestion_no, kind, info, merchant_id, merchant_name
  FROM (SELECT * FROM found QUALIFY row_number() OVER (
    PARTITION BY anchor, merchant_id ORDER BY priority, score DESC, place, info) = 1))"""


_SUGGEST = f"""{_MEMBERS}, {_DIRECTORY}, {_suggest()},
decided AS (
  SELECT DISTINCT anchor, length(anchor) % 4 AS n, 'Cat ' || substr(anchor, 1, 3) AS category,
    length(anchor) % 5 <> 0 AS wanted FROM members)"""

# Names of customers all have one length and no space, so they reach 94 if one character differs or none does.
_NAMES = """WITH RECURSIVE names AS (SELECT c_name AS t, count(*) AS count FROM customer GROUP BY 1),
cuts AS (
  SELECT DISTINCT t, unnest(list_transform(range(1, length(t) + 1), lambda i: substr(t, 1, i - 1) || substr(t, i + 1))) AS rest
  FROM names),
edges AS (
  SELECT DISTINCT x.t AS a, y.t AS b, CASE WHEN x.t = y.t THEN 100.0 ELSE 100.0 * (length(x.t) - 1) / length(x.t) END AS score
  FROM cuts x JOIN cuts y USING (rest))"""

_SUPPLIERS = f"""WITH parts AS (WITH {_DIRECTORY} SELECT * FROM directory),
directory AS (
  SELECT rule_ord, id, name, aliases FROM parts
  UNION ALL
  SELECT 10000000 + s_suppkey, {_slug('s_name')}, s_name, [lower(s_name) || ' to'] FROM supplier),
dir_alias AS (
  SELECT id, name, rule_ord, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS alias_ord FROM directory),
members AS (SELECT 'to ' || lower(s_name) AS description, 'to ' || lower(s_name) AS anchor, 1 AS count FROM supplier),
{_suggest(by_edits=True)}"""

# Capital first letter of each word, as in the default merchant name.
_TITLE = """array_to_string(list_transform(string_split(anchor, ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ')"""

_CHANGED_NAME = "CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' ' || lower(p_type) END"

ORACLES: dict[str, str] = {
    "clean_currency": f"""
SELECT {_ROW}, CAST(coalesce(abs(n), 0) AS DOUBLE) AS amount, n IS NULL AND cleaned <> '' AS warning
FROM (SELECT *, TRY_CAST(cleaned AS DECIMAL(18,2)) AS n
  FROM (SELECT {_ROW}, regexp_replace({_AMOUNT_TEXT}, '[^0-9.-]', '', 'g') AS cleaned FROM lineitem))""",
    "parse_dates": f"""
SELECT {_ROW}, {_parsed('text')} AS date FROM (SELECT {_ROW}, {_date_text('l_shipdate')} AS text FROM lineitem)""",
    "month_label": f"""
WITH {_TXN} SELECT coalesce(strftime(date, '%Y-%m'), '') AS month_str, count(*) AS n FROM txn GROUP BY 1""",
    "match_rules": f"""{_CATEGORIZED}
SELECT description, match_text, category, subcategory, type, rule_match, score FROM hits""",
    "categorize": f"""{_CATEGORIZED}
SELECT {_ROW}, description, category, subcategory, type, rule_match, confidence FROM cat""",
    "categorize_many_rules": f"""WITH {_TXN}, {_DIRECTORY},
merchant_rules AS (
  SELECT rule_ord, alias_ord, alias AS match_text, 'Goods' AS category, 'General' AS subcategory, 'operating' AS type, name
  FROM dir_alias), {_PATTERNS}, {_WINNERS}
SELECT {_ROW}, description, category, subcategory, type, rule_match, confidence FROM cat""",
    "categorized_counts": f"""{_CATEGORIZED}
SELECT type, category, subcategory, count(*) AS n, CAST(sum(paid_out) AS DOUBLE) AS paid_out,
  CAST(sum(paid_in) AS DOUBLE) AS paid_in FROM ledger GROUP BY ALL""",
    "recategorize": f"""{_CATEGORIZED}
SELECT type, category, subcategory, count(*) AS n, CAST(sum(paid_out) AS DOUBLE) AS paid_out,
  CAST(sum(paid_in) AS DOUBLE) AS paid_in FROM cat WHERE l_returnflag <> 'N' GROUP BY ALL""",
    "merge_ledger": f"""{_CATEGORIZED},
both_sides AS (
  SELECT 0 AS side, date, description, paid_out, paid_in, source, 'Uncategorized' AS category,
    CAST(NULL AS VARCHAR) AS subcategory, 'operating' AS type, {_SEQ} FROM txn WHERE l_returnflag <> 'N'
  UNION ALL
  SELECT 1, date, description, paid_out, paid_in, source, category, subcategory, type, {_SEQ} FROM ledger
  UNION ALL
  SELECT 1, date, description, paid_out, paid_in, source, category, subcategory, type, {_SEQ} FROM ledger
  WHERE l_linestatus = 'O')
SELECT date, description, CAST(paid_out AS DOUBLE) AS paid_out, CAST(paid_in AS DOUBLE) AS paid_in, source, category,
  subcategory, type FROM both_sides
QUALIFY row_number() OVER (PARTITION BY date, description, paid_out, paid_in, source ORDER BY side, {_SEQ}) = 1""",
    "append_ledger": f"""{_CATEGORIZED},
batch AS (SELECT * FROM ledger UNION ALL SELECT * FROM ledger WHERE l_linestatus = 'O')
SELECT date, description, CAST(paid_out AS DOUBLE) AS paid_out, CAST(paid_in AS DOUBLE) AS paid_in, source, category,
  subcategory, type, month FROM batch b
WHERE NOT EXISTS (SELECT 1 FROM txn o WHERE o.l_returnflag <> 'N' AND o.date IS NOT DISTINCT FROM b.date
  AND o.description = b.description AND o.paid_out = b.paid_out AND o.paid_in = b.paid_in AND o.source = b.source)
QUALIFY row_number() OVER (PARTITION BY date, description, paid_out, paid_in, source ORDER BY {_SEQ}) = 1""",
    "ingest_stats": f"""{_CATEGORIZED},
batch AS (SELECT * FROM ledger UNION ALL SELECT * FROM ledger WHERE l_linestatus = 'O'),
kept AS (SELECT date, description, paid_out, paid_in, source, count(*) AS copies FROM batch GROUP BY ALL)
SELECT source, CAST(sum(copies) AS BIGINT) AS rows_read, count(*) AS rows_kept,
  CAST(sum(copies) - count(*) AS BIGINT) AS duplicates_removed, count(*) FILTER (date IS NULL) AS undated_rows
FROM kept GROUP BY 1""",
    "load_ledger": f"""WITH {_TXN},
loose AS (SELECT *, CASE WHEN l_orderkey % 4 = 1 THEN date END AS d FROM txn)
SELECT {_ROW}, d AS date, CAST(CASE WHEN l_linestatus = 'O' THEN paid_out ELSE 0 END AS DOUBLE) AS paid_out,
  CAST(paid_in AS DOUBLE) AS paid_in, coalesce(strftime(d, '%Y-%m'), '') AS month FROM loose""",
    "operating_base": f"""{_CATEGORIZED}
SELECT {_ROW}, category, subcategory, CAST(paid_out AS DOUBLE) AS paid_out, month AS month_str
FROM ledger WHERE {_SPEND}""",
    "operating_income": f"""{_CATEGORIZED}
SELECT {_ROW}, category, CAST(paid_in AS DOUBLE) AS paid_in, month AS month_str FROM ledger WHERE {_INCOME}""",
    "operating_kpis": f"{_KPIS} SELECT * FROM kpis",
    "operating_summary": f"""{_KPIS},
sel AS (SELECT * FROM ledger WHERE {_SPEND} AND category = 'Bills'),
t AS (SELECT CAST(sum(paid_out) AS DOUBLE) AS s, (SELECT CAST(sum(i) AS DOUBLE) FROM income
  WHERE month_str IN (SELECT month FROM sel)) AS i FROM sel)
SELECT s AS total_spend, (SELECT any_value(avg_monthly_burn) FROM kpis) AS avg_monthly_burn,
  round(s / i * 100, 6) AS income_coverage, 'Bills' AS top_category FROM t""",
    "monthly_spend": f"{_KPIS} SELECT month_str, total_spend FROM kpis",
    "monthly_income": f"{_KPIS} SELECT month_str, CAST(i AS DOUBLE) AS total_income FROM income",
    "monthly_trend": f"""{_KPIS}
SELECT month_str, total_spend FROM kpis ORDER BY month_str = '' DESC, month_str DESC LIMIT 6""",
    "category_spend": f"""{_CATEGORIZED}
SELECT category, CAST(sum(paid_out) AS DOUBLE) AS total_spend FROM ledger WHERE {_SPEND} GROUP BY 1""",
    "subcategory_spend": f"""{_CATEGORIZED},
totals AS (
  SELECT category, coalesce(CASE WHEN category = 'Shopping' THEN p_brand ELSE subcategory END, 'Uncategorised') AS sub,
    sum(paid_out) AS t FROM ledger WHERE {_SPEND} GROUP BY ALL),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY category) > 8
    AND row_number() OVER (PARTITION BY category ORDER BY t DESC, sub) >= 8 AS is_other FROM totals)
SELECT category, CASE WHEN is_other THEN 'Other' ELSE sub END AS subcategory, is_other,
  CAST(sum(t) AS DOUBLE) AS total_spend FROM ranked GROUP BY ALL""",
    "spend_delta": f"{_KPIS} SELECT month_str, total_spend, prev_month, spend_delta, spend_delta_pct FROM kpis",
    "coverage_delta": f"""{_KPIS}
SELECT month_str, total_spend, total_income, income_coverage, coverage_delta_pp FROM kpis""",
    "operating_transactions": f"""{_CATEGORIZED}
SELECT date, description, category, subcategory, CAST(paid_out AS DOUBLE) AS paid_out
FROM ledger WHERE {_SPEND} AND category = 'Shopping'""",
    "available_months": f"{_CATEGORIZED} SELECT DISTINCT month AS month_str FROM ledger WHERE {_SPEND}",
    "available_categories": f"{_CATEGORIZED} SELECT DISTINCT category FROM ledger WHERE {_SPEND}",
    "debt_repayments": f"""{_CATEGORIZED}
SELECT {_ROW}, subcategory, CAST(paid_out AS DOUBLE) AS paid_out, month AS month_str
FROM ledger WHERE type = 'financing' AND paid_out > 0""",
    "debt_interest": f"""{_CATEGORIZED}
SELECT {_ROW}, subcategory, CAST(paid_out AS DOUBLE) AS paid_out, month AS month_str
FROM ledger WHERE type = 'operating' AND subcategory ILIKE '%interest%'""",
    "debt_metrics": f"""{_CATEGORIZED},
r AS (SELECT * FROM ledger WHERE type = 'financing' AND paid_out > 0),
i AS (SELECT * FROM ledger WHERE type = 'operating' AND subcategory ILIKE '%interest%'),
t AS (SELECT (SELECT CAST(sum(paid_out) AS DOUBLE) FROM r) AS rs, (SELECT CAST(sum(paid_out) AS DOUBLE) FROM i) AS si)
SELECT rs AS total_repaid, si AS total_interest, round(greatest((rs - si) / rs * 100, 0), 6) AS principal_ratio,
  (SELECT count(DISTINCT month) FROM (SELECT month FROM r UNION ALL SELECT month FROM i)) AS active_months FROM t""",
    "debt_timeline": f"""{_CATEGORIZED},
r AS (SELECT month, sum(paid_out) AS p FROM ledger WHERE type = 'financing' AND paid_out > 0 GROUP BY 1),
i AS (SELECT month, sum(paid_out) AS c FROM ledger WHERE type = 'operating' AND subcategory ILIKE '%interest%' GROUP BY 1)
SELECT month AS month_str, CAST(coalesce(p, 0) AS DOUBLE) AS payment, CAST(coalesce(c, 0) AS DOUBLE) AS cost
FROM r FULL JOIN i USING (month)""",
    "p2p_balances": f"""{_CATEGORIZED}
SELECT trim(coalesce(subcategory, 'Unknown')) AS name, CAST(sum(paid_out) AS DOUBLE) AS total_lent,
  CAST(sum(paid_in) AS DOUBLE) AS total_repaid, CAST(sum(paid_in) - sum(paid_out) AS DOUBLE) AS net_balance
FROM ledger WHERE category = 'P2P' GROUP BY 1""",
    "p2p_summary": f"""{_CATEGORIZED}
SELECT CAST(sum(paid_in) - sum(paid_out) AS DOUBLE) AS total_outstanding,
  CAST(sum(paid_in) + sum(paid_out) AS DOUBLE) AS lending_volume,
  count(DISTINCT coalesce(subcategory, 'Unknown')) AS entities FROM ledger WHERE category = 'P2P'""",
    "normalize_aqua": f"WITH {_RAW} {_staged("'Aqua'")}",
    "normalize_natwest": f"WITH {_RAW} {_staged("'Natwest'")}",
    "normalize_nationwide": f"WITH {_RAW} {_staged("'Nationwide'")}",
    "standardize": f"WITH {_RAW} {_staged(_TYPE_LAYOUT)}",
    "validate_rows": f"""WITH {_RAW}
SELECT source, reject_reason, count(*) AS n FROM (SELECT {_TYPE_LAYOUT} AS source,
  CASE WHEN {_TYPE_LAYOUT} IS NULL THEN 'unknown_layout' WHEN date IS NULL THEN 'bad_date' END AS reject_reason
  FROM parsed) GROUP BY ALL""",
    "find_header": f"""
SELECT 'supplier_' || l_suppkey || '.csv' AS file_path,
  CASE WHEN layout IS NULL THEN ',' WHEN l_suppkey % 3 = 0 THEN ',' WHEN l_suppkey % 3 = 1 THEN ';'
    ELSE chr(9) END AS delimiter, layout,
  CAST(CASE WHEN layout IS NULL THEN 0 ELSE 1 END AS BIGINT) AS header_idx,
  CASE l_suppkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 1 END AS width
FROM (SELECT s_suppkey AS l_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Aqua' WHEN 1 THEN 'Natwest' WHEN 2 THEN 'Nationwide'
  END AS layout FROM supplier)""",
    "stage_lines": f"""{_LINES}
SELECT source_file, block_start, line_idx, date, description, paid_out, paid_in, source, account_type, reject_reason
FROM staged""",
    "stage_quoted_text": f"""
SELECT 'documents_' || doc_id % 64 || '.csv' AS source_file, doc_id AS block_start, DATE '2024-04-03' AS date,
  CASE WHEN doc_id % 10 = 3 THEN 'open_quote' END AS reject_reason,
  CASE WHEN doc_id % 10 <> 3 THEN trim(replace(coalesce(text, ''), chr(10), ' '), '{WHITESPACE}') END AS description,
  CASE WHEN doc_id % 10 <> 3 THEN CAST(doc_id % 1000 AS DOUBLE) END AS paid_out
FROM documents""",
    "stage_quoted_lines": f"""
SELECT 'documents_' || doc_id % 64 || '.csv' AS source_file, doc_id AS block_start, DATE '2024-04-03' AS date,
  CAST(NULL AS VARCHAR) AS reject_reason, trim(coalesce(text, ''), '{WHITESPACE}') AS description,
  CAST(doc_id % 1000 AS DOUBLE) AS paid_out
FROM documents""",
    "stage_quoted_files": f"""
WITH texts AS (
  SELECT doc_id, doc_id % 10 = 3 AS stray,
    regexp_replace(coalesce(text, ''), '[^\\x00-\\x0C\\x0E-\\x7F\\xA0-\\xFF]', '?', 'g') AS text FROM documents)
SELECT length('03/04/2024,POS,"' || replace(text, '"', '""') || CASE WHEN stray THEN '' ELSE '"' END || ',' || doc_id || '.00,')
    AS line_chars, DATE '2024-04-03' AS date,
  CASE WHEN stray THEN 'open_quote' END AS reject_reason,
  CASE WHEN NOT stray THEN trim(text, '{WHITESPACE}') END AS description,
  CASE WHEN NOT stray THEN CAST(doc_id AS DOUBLE) END AS paid_out
FROM texts""",
    "reject_counts": f"""{_LINES}
SELECT source_file, coalesce(reject_reason, '') AS reject_reason, count(*) AS count FROM staged GROUP BY ALL""",
    "uncategorized": f"""{_FREQ}
SELECT {_ROW}, date, d AS description, CAST(paid_out AS DOUBLE) AS paid_out, CAST(paid_in AS DOUBLE) AS paid_in FROM unc""",
    "description_freq": f"{_FREQ} SELECT description, count FROM freq",
    "similar_pairs": f"""{_FREQ},
texts_a AS (SELECT description AS a FROM freq), texts_b AS (SELECT description AS b FROM freq),
{_scored('texts_a', 'texts_b', 80, 'edges')}
SELECT a AS anchor, b AS text, round(score, 6) AS score FROM edges""",
    "cluster_members": f"{_MEMBERS} SELECT description, count, anchor FROM members",
    "description_clusters": f"{_MEMBERS} SELECT anchor, n_aliases, count FROM clusters",
    "cluster_samples": f"{_MEMBERS} SELECT * FROM samples",
    "cluster_report": f"""{_MEMBERS}
SELECT anchor, count, n_aliases, n_samples, first_date FROM clusters JOIN (
  SELECT anchor, count(*) AS n_samples, coalesce(strftime(min_by(date, sample_no), '%Y-%m-%d'), '') AS first_date
  FROM samples GROUP BY 1) USING (anchor)""",
    "suggest_merchants": f"{_SUGGEST} SELECT * FROM suggestions",
    "similar_names": f"{_NAMES} SELECT a AS anchor, b AS text, round(score, 6) AS score FROM edges",
    "name_clusters": f"""{_NAMES},
near AS MATERIALIZED (SELECT a, list(b) AS bs FROM edges GROUP BY a),
walk(anchor, taken, pool) AS (
  SELECT CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), list(t ORDER BY count DESC, t) FROM names
  UNION ALL
  SELECT near.a, list_filter(pool, lambda x: list_contains(bs, x)), list_filter(pool, lambda x: NOT list_contains(bs, x))
  FROM walk JOIN near ON near.a = walk.pool[1])
SELECT description, count, anchor
FROM (SELECT anchor, unnest(taken) AS description FROM walk WHERE anchor IS NOT NULL) JOIN names ON t = description""",
    "suggest_suppliers": f"{_SUPPLIERS} SELECT * FROM suggestions",
    "apply_decisions": f"""{_SUGGEST},
fresh AS (
  SELECT {_slug(_TITLE)} AS id, {_TITLE} AS name, category, 'General' AS subcategory, 'operating' AS type, anchor
  FROM decided WHERE n = 1 AND wanted),
attached AS (
  SELECT merchant_id AS id, merchant_name AS name, 'Goods' AS category, 'General' AS subcategory, 'operating' AS type, anchor
  FROM decided JOIN suggestions USING (anchor) WHERE n = 0 AND suggestion_no = 1),
added AS (
  SELECT id, name, h.category, subcategory, type, description AS alias
  FROM (SELECT * FROM fresh UNION ALL SELECT * FROM attached) h JOIN members USING (anchor))
SELECT * FROM added WHERE NOT EXISTS (SELECT 1 FROM dir_alias k WHERE k.id = added.id AND lower(k.alias) = added.alias)""",
    "upsert_merchants": f"""WITH {_DIRECTORY},
changes AS (
  SELECT {_CHANGED_NAME} AS name, min(p_partkey) AS rule_ord, list_sort(list(DISTINCT
    CASE WHEN p_size > 40 THEN p_name || ' ' || lower(p_type) ELSE lower(p_brand) || ' ' || p_name END)) AS aliases
  FROM part GROUP BY 1),
change_alias AS (SELECT {_slug('name')} AS id, name, unnest(aliases) AS alias FROM changes),
heads AS (
  SELECT id, name, 'Goods' AS category, 'General' AS subcategory, 'operating' AS type FROM directory
  UNION ALL
  SELECT {_slug('name')}, name, 'Changed', 'Changed', 'transfer' FROM changes
  WHERE {_slug('name')} NOT IN (SELECT id FROM directory)),
all_alias AS (SELECT id, alias FROM dir_alias UNION SELECT id, alias FROM change_alias)
SELECT id, name, category, subcategory, type, alias FROM heads JOIN all_alias USING (id)""",
    "append_patterns": f"""{_SUGGEST}
SELECT lower(p_brand) AS pattern, 'Brand' AS category, '' AS subcategory, 'operating' AS type, 1.0::DOUBLE AS weight
FROM part GROUP BY 1
UNION ALL
SELECT anchor, category, 'Unspecified', 'operating', 1.0 FROM decided WHERE n = 2 AND wanted""",
}

_TRANSFERS = """WITH
txn AS (
  SELECT c_custkey, 'TRANSFER Supplier#' || lpad(CAST(c_custkey * 7 % 150 AS VARCHAR), 9, '0') || ' from ' || c_name
    || ' ' || c_mktsegment AS description FROM customer),
rules AS (
  SELECT 0 AS kind, s_suppkey AS rule_ord, lower(s_name) AS match_text, 'Nation ' || s_nationkey AS category,
    'transfer' AS type, 'merchant:' || s_name AS rule_match, CAST(length(s_name) * 10 + 50 AS BIGINT) AS score FROM supplier
  UNION ALL
  SELECT 1, min(c_custkey), lower(c_mktsegment), 'Segment', 'operating', 'pattern:' || lower(c_mktsegment),
    CAST(length(c_mktsegment) * 10 AS BIGINT) FROM customer GROUP BY c_mktsegment),
best AS (
  SELECT c_custkey, r.* FROM txn JOIN rules r ON contains(lower(description), match_text)
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, kind, rule_ord) = 1)
SELECT c_custkey, description, coalesce(category, 'Uncategorized') AS category, coalesce(type, 'operating') AS type,
  coalesce(rule_match, 'none') AS rule_match, coalesce(score, 0) AS confidence
FROM txn LEFT JOIN best USING (c_custkey)"""

_LEARNED = ORACLES["apply_decisions"].rsplit("SELECT * FROM added", 1)[0] + f""",
learned AS (
  SELECT DISTINCT lower(alias) AS match_text, 1 AS bonus FROM (
    SELECT alias FROM dir_alias UNION ALL SELECT alias FROM added)
  UNION ALL
  SELECT DISTINCT lower(anchor), 0 FROM decided WHERE n = 2 AND wanted),
scored AS (
  SELECT match_text, CAST(length(match_text) * 10 + 50 * bonus AS BIGINT) AS score FROM learned
  UNION ALL
  SELECT match_text, CAST(trunc(length(match_text) * 10 * CAST(weight AS DOUBLE)) AS BIGINT) FROM pattern_rules)
SELECT description, any_value(n) AS n, coalesce(max(score), 0) AS confidence
FROM (SELECT description, count(*) AS n FROM txn GROUP BY 1) t
LEFT JOIN scored ON length(match_text) >= 2 AND contains(t.description, match_text) GROUP BY description"""

ORACLES |= {
    "categorize_transfers": _TRANSFERS,
    "operating_base_month": ORACLES["operating_base"] + " AND month = '1995-03'",
    "operating_transactions_all": ORACLES["operating_transactions"].replace(" AND category = 'Shopping'", ""),
    "dated_monthly_trend": f"{_KPIS} SELECT month_str, total_spend FROM kpis WHERE month_str <> ''",
    "dated_debt_timeline": f"SELECT * FROM ({ORACLES['debt_timeline']}) WHERE month_str <> ''",
    "staged_table": f"""{_LINES}
SELECT source_file, block_start, line_idx, date, description, paid_out, paid_in, source FROM staged
WHERE reject_reason IS NULL""",
    "categorized_table": ORACLES["categorized_counts"],
    "stored_ledger": f"SELECT *, coalesce(strftime(date, '%Y-%m'), '') AS month FROM ({ORACLES['merge_ledger']})",
    "bucketed_ledger": f"SELECT *, coalesce(strftime(date, '%Y-%m'), '') AS month FROM ({ORACLES['merge_ledger']})",
    "streamed_ledger": f"""{_CATEGORIZED}
SELECT date, description, CAST(paid_out AS DOUBLE) AS paid_out, CAST(paid_in AS DOUBLE) AS paid_in, source, any_value(category) AS category,
  any_value(subcategory) AS subcategory, any_value(type) AS type, any_value(month) AS month
FROM ledger GROUP BY date, description, paid_out, paid_in, source""",
    "json_rules": f"""WITH {_DIRECTORY}
SELECT id, name, 'Goods' AS category, 'General' AS subcategory, 'operating' AS type, alias FROM dir_alias""",
    "stored_rules": ORACLES["upsert_merchants"],
    "recategorize_changed": ORACLES["categorized_counts"],
    # The ledger keeps one row of each key.
    "month_table_kpis": ORACLES["operating_kpis"].replace("AS month FROM cat)", f"""AS month FROM cat
  QUALIFY row_number() OVER (PARTITION BY date, description, paid_out, paid_in, source ORDER BY {_SEQ}) = 1)"""),
    "learn_loop": _LEARNED,
}
