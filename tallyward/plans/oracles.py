"""The registered queries in plain SQL, for checking results in another engine."""

from tallyward.functions.text import WHITE_SPACE
from tallyward.schema import REQUIRED_COLUMNS
from tallyward.sources.facts import LETTERS

OPS = """
ops AS (
  SELECT location_id, location_name, region, month,
         CAST(revenue AS double) AS revenue, CAST(budget_revenue AS double) AS budget_revenue,
         CAST(labor_expense AS double) AS labor_expense,
         CAST(other_expense AS double) AS other_expense,
         CAST(labor_expense + other_expense AS double) AS total_expense, volume
  FROM (
    SELECT 'SUP-' || lpad(CAST(s_suppkey AS varchar), 6, '0') AS location_id,
           s_name AS location_name, r_name AS region,
           CAST(date_trunc('month', l_shipdate) AS date) AS month,
           sum(CAST(l_extendedprice AS decimal(18,2)) * (1 - CAST(l_discount AS decimal(4,2))))
             AS revenue,
           sum(CAST(l_extendedprice AS decimal(18,2))) * CAST(0.95 AS decimal(4,2))
             AS budget_revenue,
           sum(CAST(l_extendedprice AS decimal(18,2)) * CAST(l_tax AS decimal(4,2)))
             AS labor_expense,
           sum(CAST(p_retailprice AS decimal(18,2)) * CAST(l_quantity AS decimal(6,0))
               * CAST(0.40 AS decimal(4,2))) AS other_expense,
           sum(l_quantity) AS volume
    FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey
    GROUP BY 1, 2, 3, 4))
"""

KEYED = """
keyed AS (
  SELECT *, CAST(substring(location_id, 5) AS bigint) * 31 + year(month) * 12 + month(month) AS k
  FROM ops)
"""

DIRTY = f"""
{OPS}, {KEYED}, faulty AS (
  SELECT location_id, location_name,
         CASE WHEN k % 89 = 0 THEN NULL ELSE region END AS region, month,
         CASE WHEN k % 97 = 0 THEN NULL ELSE revenue END AS revenue,
         budget_revenue, labor_expense, other_expense,
         CASE WHEN k % 83 = 0 THEN total_expense + 5000 ELSE total_expense END AS total_expense,
         CASE WHEN k % 79 = 0 THEN -volume ELSE volume END AS volume, k
  FROM keyed),
dirty AS (
  SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE k % 101 = 0)
"""

BLANK_CELLS = " UNION ALL ".join(
    f"SELECT location_id, month, '{c}' AS column_name, region, "
    f"location_id || '-' || year(month) AS source FROM dirty WHERE {c} IS NULL"
    for c in sorted(
        (
            "location_id",
            "location_name",
            "region",
            "month",
            "revenue",
            "budget_revenue",
            "labor_expense",
            "other_expense",
            "volume",
        )
    )
)

DIFFERENCE = (
    "abs(CAST(labor_expense AS decimal(18,4)) + CAST(other_expense AS decimal(18,4))"
    " - CAST(total_expense AS decimal(18,4)))"
)


def _source(region_or_year: str) -> str:
    if region_or_year == "region":
        return "coalesce(region, 'unknown')"
    return "location_id || '-' || year(month)"


def _found(source: str) -> str:
    """All issues of the dirty table: source, issue_type."""
    return f"""
    blanks AS ({BLANK_CELLS}),
    found AS (
      SELECT {source} AS source, 'duplicate_record' AS issue_type FROM dirty
      GROUP BY {source}, location_id, month HAVING count(*) > 1
      UNION ALL
      SELECT {source}, 'missing_value' FROM blanks
      UNION ALL
      SELECT {source}, 'impossible_value' FROM dirty WHERE volume < 0
      UNION ALL
      SELECT {source}, 'reconciliation_error' FROM dirty WHERE {DIFFERENCE} > 0.01)
    """


TYPES = """
types AS (
  SELECT unnest(['missing_required_column', 'duplicate_record', 'missing_value',
                 'impossible_value', 'reconciliation_error']) AS issue_type)
"""


HASHED = """
hashed AS (
  SELECT doc_id, CAST('0x' || substr(md5(concat(
    coalesce(length(text) || ':' || text, '-'), coalesce(length(lang) || ':' || lang, '-'),
    coalesce(length(source) || ':' || source, '-'),
    coalesce(length(CAST(n_chars AS varchar)) || ':' || n_chars, '-'))), 1, 15) AS bigint) AS digits
  FROM documents)
"""


def _power(exponent: str, prime: int, base: int, bits: int = 40) -> str:
    """base ** exponent modulo the prime."""
    result, factor = "CAST(1 AS bigint)", base
    for bit in range(bits):
        step = f"CASE WHEN (({exponent}) >> {bit}) & 1 = 1 THEN {factor} ELSE 1 END"
        result = f"(({result} * {step}) % {prime})"
        factor = factor * factor % prime
    return result


def _sum(column: str) -> str:
    return f"CAST(coalesce(sum(CAST({column} AS decimal(28,4))), 0) AS double)"


TOTALS = ", ".join(
    f"{_sum(c)} AS {n}"
    for c, n in (
        ("revenue", "rev"),
        ("budget_revenue", "bud"),
        ("labor_expense", "lab"),
        ("other_expense", "oth"),
    )
)
VARIANCE = """rev AS actual_revenue, bud AS budget_revenue, rev - bud AS variance_amount,
  CASE WHEN bud <> 0 THEN (rev - bud) / bud * 100 END AS variance_percent"""
MARGIN = """rev AS total_revenue, lab + oth AS total_expense,
  rev - (lab + oth) AS operating_income,
  CASE WHEN rev <> 0 THEN (rev - (lab + oth)) / rev * 100 END AS operating_margin_percent"""
LABOR = """lab AS total_labor_expense,
  CASE WHEN rev <> 0 THEN lab / rev * 100 END AS labor_expense_percent"""


def _series(by: str = "", table: str = "ops", calendar: bool = False) -> str:
    """Revenue per month beside the month before."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    prior = f"lag(revenue) OVER ({part}ORDER BY month)"
    if calendar:
        prior = (
            f"CASE WHEN lag(month) OVER ({part}ORDER BY month) + INTERVAL 1 MONTH = month"
            f" THEN {prior} END"
        )
    return f"""
    monthly AS (SELECT {key}month, {_sum('revenue')} AS revenue FROM {table} GROUP BY {key}month),
    prior AS (SELECT *, {prior} AS prior_month_revenue FROM monthly),
    series AS (
      SELECT *, revenue - prior_month_revenue AS change_amount,
             CASE WHEN prior_month_revenue <> 0
                  THEN (revenue - prior_month_revenue) / prior_month_revenue * 100
             END AS change_percent
      FROM prior)
    """


SPACE = "".join(f"chr({ord(c)}) || " for c in WHITE_SPACE).removesuffix(" || ")


def _strip(text: str) -> str:
    return f"trim({text}, {SPACE})"


NARRATIVE = f"""
{OPS}, {_series('region')},
totals AS (SELECT region, {TOTALS} FROM ops GROUP BY region),
latest AS (SELECT region, arg_max(coalesce(CAST(change_percent AS varchar), ''), month) AS shown,
                  max(month) AS latest_month FROM series GROUP BY region),
pack AS (
  SELECT region, {VARIANCE}, rev - (lab + oth) AS operating_income,
         CASE WHEN rev <> 0 THEN (rev - (lab + oth)) / rev * 100 END AS operating_margin_percent,
         {LABOR}, latest_month, s.change_percent AS latest_change,
         s.change_amount AS latest_amount
  FROM totals JOIN latest USING (region)
  JOIN (SELECT region, month, change_percent, change_amount FROM series) s USING (region)
  WHERE s.month = latest_month),
told AS (
  SELECT *, 'Total revenue was $' || format('{{:,.0f}}', actual_revenue) || '. ' ||
    CASE WHEN variance_percent IS NULL THEN
           'No budget was set, so there is no percentage to compare with.'
         WHEN variance_amount > 0 THEN 'That is $' || format('{{:,.0f}}', variance_amount)
           || ' (' || format('{{:.1f}}', variance_percent) || '%) above budget.'
         WHEN variance_amount < 0 THEN 'That is $' || format('{{:,.0f}}', abs(variance_amount))
           || ' (' || format('{{:.1f}}', abs(variance_percent)) || '%) below budget.'
         ELSE 'That equals the budget.' END || ' ' ||
    CASE WHEN operating_margin_percent IS NULL THEN
           'Without revenue there is no operating margin.'
         ELSE 'Operating margin was ' || format('{{:.1f}}', operating_margin_percent) || '%.'
    END || ' ' ||
    CASE WHEN labor_expense_percent IS NULL THEN
           'Without revenue there is no labor share.'
         ELSE 'Labor expense represented ' || format('{{:.1f}}', labor_expense_percent)
           || '% of that revenue.' END || ' ' ||
    CASE WHEN latest_change > 0 THEN 'Revenue increased ' || format('{{:.1f}}', latest_change)
           || '% on the month before.'
         WHEN latest_change < 0 THEN 'Revenue fell by ' || format('{{:.1f}}', abs(latest_change))
           || '% on the month before.'
         WHEN latest_change = 0 THEN 'Revenue stayed level with the month before.'
         ELSE 'A change on the month before cannot be stated.' END AS narrative
  FROM pack)
"""

CLAIMS = f"""
{NARRATIVE}, claims AS (
  SELECT region,
    '### Executive Summary' || chr(10) || chr(10) || narrative AS head,
    '### Major Findings' || chr(10) || chr(10)
    || '- Revenue was compared with budget.' || chr(10)
    || '  - Evidence: Actual revenue $' || format('{{:,.0f}}', actual_revenue)
    || ', Budget revenue $' || format('{{:,.0f}}', budget_revenue) || chr(10)
    || '- Operating income was measured.' || chr(10)
    || '  - Evidence: Operating income $' || format('{{:,.0f}}', operating_income) || chr(10)
    || '- Labor expense was measured.' || chr(10)
    || '  - Evidence: Labor expense $' || format('{{:,.0f}}', total_labor_expense) AS findings,
    nullif(concat_ws(chr(10),
      CASE WHEN variance_amount < 0 THEN '- Revenue was below budget.' || chr(10)
        || '  - Evidence: Actual revenue $' || format('{{:,.0f}}', actual_revenue)
        || ', Budget revenue $' || format('{{:,.0f}}', budget_revenue) END,
      CASE WHEN latest_amount < 0 THEN '- Revenue fell in the latest month.' || chr(10)
        || '  - Evidence: Latest month ' || CAST(latest_month AS varchar) END), '') AS worries
  FROM told),
rendered AS (
  SELECT region, head, findings || coalesce(
    chr(10) || chr(10) || '### Concerns' || chr(10) || chr(10) || worries, '') AS tail
  FROM claims)
"""


def _issue_json(issue_type: str, source: str, text: str, action: str) -> str:
    return (
        f"'{{\"type\":\"{issue_type}\",\"severity\":\"error\",\"source\":\"' || {source} || "
        f"'\",\"explanation\":\"' || {text} || '\",\"suggested_action\":\"' || {action} || '\"}}'"
    )


PLACE = "'location ' || location_id || ', month ' || CAST(month AS varchar)"
NEGATIVE = (
    f"'Column ''volume'' holds the impossible negative value ' || CAST(CAST(volume AS bigint) "
    f"AS varchar) || ' (' || {PLACE} || ').'",
    f"'Correct ''volume'' to zero or more (' || {PLACE} || ').'",
)

FACTS = f"""
{DIRTY}, tagged AS (SELECT *, {_source('year')} AS source FROM dirty),
{_series('source', 'tagged')}, blanks AS ({BLANK_CELLS}),
totals AS (SELECT source, {TOTALS} FROM tagged GROUP BY source),
listed AS (
  SELECT source, 'duplicate_record' AS issue_type,
         CAST(count(*) AS varchar) || ' rows share ' || {PLACE} || '.' AS explanation
  FROM tagged GROUP BY source, location_id, month HAVING count(*) > 1
  UNION ALL
  SELECT source, 'missing_value', 'No value in column ''' || column_name || ''' (' || {PLACE} || ').'
  FROM blanks
  UNION ALL
  SELECT source, 'impossible_value', {NEGATIVE[0]} FROM tagged WHERE volume < 0
  UNION ALL
  SELECT source, 'reconciliation_error',
         'Labor plus other expense is $' || format('{{:,.2f}}', CAST({DIFFERENCE} AS double))
         || ' away from the stated total (' || {PLACE} || ').'
  FROM tagged WHERE {DIFFERENCE} > 0.01),
figures AS (
  SELECT source, rev - bud AS off, lab + oth AS spent, rev - (lab + oth) AS income, rev, bud, lab
  FROM totals)
SELECT source, name, CAST(NULL AS date) AS month, value, CAST(NULL AS varchar) AS text FROM (
  SELECT source, unnest([
    {{'name': 'revenue_variance.actual_revenue', 'value': rev}},
    {{'name': 'revenue_variance.budget_revenue', 'value': bud}},
    {{'name': 'revenue_variance.variance_amount', 'value': off}},
    {{'name': 'revenue_variance.variance_percent', 'value': CASE WHEN bud <> 0 THEN off / bud * 100 END}},
    {{'name': 'operating_margin.total_revenue', 'value': rev}},
    {{'name': 'operating_margin.total_expense', 'value': spent}},
    {{'name': 'operating_margin.operating_income', 'value': income}},
    {{'name': 'operating_margin.operating_margin_percent',
      'value': CASE WHEN rev <> 0 THEN income / rev * 100 END}},
    {{'name': 'labor_expense_percentage.total_labor_expense', 'value': lab}},
    {{'name': 'labor_expense_percentage.total_revenue', 'value': rev}},
    {{'name': 'labor_expense_percentage.labor_expense_percent',
      'value': CASE WHEN rev <> 0 THEN lab / rev * 100 END}}
  ], recursive := true) FROM figures)
UNION ALL
SELECT source, unnest(['revenue', 'prior_month_revenue', 'change_amount', 'change_percent']), month,
  unnest([revenue, prior_month_revenue, change_amount, change_percent]), NULL FROM series
UNION ALL
SELECT source, issue_type, NULL, NULL, explanation FROM listed
"""


def _bad(key: str, good: str, bad: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {key} % {every} = 0 THEN {value}" for every, value in bad.items())
    return f"CASE {cases} ELSE {good} END"


NORMALIZED = f"""
WITH cells AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number,
         CAST(CAST(l_quantity AS bigint) AS double) AS quantity,
         CAST(CAST(l_extendedprice AS decimal(18,2)) AS double) AS price,
         CAST(l_shipdate AS date) AS ship_date
  FROM lineitem)
SELECT order_key, line_number,
  {_bad('order_key', 'quantity', {13: 'NULL', 17: 'NULL', 19: 'NULL', 23: 'quantity', 29: 'NULL'})}
    AS quantity,
  {_bad('order_key', 'price', {11: 'NULL', 31: 'NULL', 37: 'price'})} AS price,
  {_bad('order_key', 'ship_date', {7: 'NULL', 41: 'NULL', 43: 'NULL', 47: 'NULL'})} AS ship_date
FROM cells
"""

MARKDOWN = f"""
docs AS (
  SELECT conv_id, '# Conversation ' || conv_id || chr(10) || string_agg(
           '## ' || turn || ' ' || role || chr(10) || text, chr(10) ORDER BY turn, role, text) AS body
  FROM conversations GROUP BY conv_id),
lines AS (
  SELECT conv_id, unnest(string_split(body, chr(10))) AS line,
         generate_subscripts(string_split(body, chr(10)), 1) AS pos
  FROM docs),
marked AS (
  SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY pos) AS section_no
  FROM lines),
markdown AS (
  SELECT conv_id, CAST(section_no AS bigint) AS section_no,
         {_strip("substring(arg_min(line, pos), 4)")} AS section,
         {_strip("string_agg(line, chr(10) ORDER BY pos)")} AS text
  FROM marked WHERE section_no > 0 GROUP BY conv_id, section_no)
"""

DOCUMENTS = f"""
docs AS (
  SELECT page_id, replace(replace(html, '<h1>', chr(10) || '## '), '</h1>', chr(10)) AS body
  FROM pages),
lines AS (
  SELECT page_id, unnest(string_split(body, chr(10))) AS line,
         generate_subscripts(string_split(body, chr(10)), 1) AS pos
  FROM docs),
marked AS (
  SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END)
           OVER (PARTITION BY page_id ORDER BY pos) AS section_no,
         sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END)
           OVER (PARTITION BY page_id) AS headings
  FROM lines)
SELECT page_id, CAST(section_no AS bigint) AS section_no,
       CASE WHEN section_no > 0 THEN {_strip("substring(arg_min(line, pos), 4)")} END AS section,
       {_strip("string_agg(line, chr(10) ORDER BY pos)")} AS text
FROM marked WHERE section_no > 0 OR headings = 0 GROUP BY page_id, section_no
"""

PAGED = f"""
pages AS (
  SELECT conv_id, turn AS page, role, text AS said,
         CASE WHEN turn % 2 = 0 THEN (turn + 1) || '. ' || role || chr(10) ELSE '' END || text AS body
  FROM conversations),
page_lines AS (
  SELECT conv_id, page, unnest(string_split(body, chr(10))) AS line,
         generate_subscripts(string_split(body, chr(10)), 1) AS pos
  FROM pages),
page_marked AS (
  SELECT *, sum(CASE WHEN regexp_matches({_strip('line')}, '^[0-9]+\\.') THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY page, pos) AS section_no
  FROM page_lines),
openers AS (
  SELECT conv_id, arg_min(line, (page, pos)) AS first_line, min(page) AS first_page
  FROM page_lines GROUP BY conv_id),
sections AS (
  SELECT conv_id, CAST(section_no AS bigint) AS section_no,
         arg_min(line, (page, pos)) AS section,
         {_strip("string_agg(line, chr(10) ORDER BY page, pos)")} AS text, min(page) AS page
  FROM page_marked GROUP BY conv_id, section_no),
paged AS (
  SELECT * FROM sections
  UNION ALL
  SELECT conv_id, 0, first_line, '', first_page FROM openers
  WHERE conv_id NOT IN (SELECT conv_id FROM sections WHERE section_no = 0))
"""

FIXED = f"""
cut AS (
  SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 500.0) AS bigint))) AS chunk_no
  FROM documents)
SELECT doc_id, chunk_no, {_strip('substring(text, chunk_no * 500 + 1, 500)')} AS text FROM cut
"""

FIXED_PAGES = f"""
page_cut AS (
  SELECT conv_id, turn AS page, role, text,
         unnest(range(0, CAST(ceil(length(text) / 500.0) AS bigint))) AS n
  FROM turns),
page_chunks AS (
  SELECT conv_id, page,
         row_number() OVER (PARTITION BY conv_id ORDER BY page, role, text, n) - 1 AS chunk_no,
         {_strip('substring(text, n * 500 + 1, 500)')} AS text
  FROM page_cut)
"""


def _gap(left: str, right: str, width: int) -> str:
    return (
        f"list_reduce(list_transform(range(1, {width + 1}), lambda i: "
        f"({left}[i] - {right}[i]) * ({left}[i] - {right}[i])), lambda a, b: a + b)"
    )


NEIGHBOURS = f"""
vectors AS (SELECT vec_id, label, CAST(embedding AS double[]) AS e FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, q.label AS expected, c.vec_id, c.label,
         {_gap('q.e', 'c.e', 64)} AS distance
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs),
hits AS (SELECT * FROM ranked WHERE rank <= 3)
"""

def _letter_shares(text: str) -> str:
    counts = ", ".join(
        f"length(lower({text})) - length(replace(lower({text}), '{c}', ''))" for c in LETTERS
    )
    return (
        f"list_transform([{counts}], lambda n: CAST(n AS double) / "
        f"greatest(list_sum([{counts}]), 1))"
    )


STRATEGIES = f"""
WITH turns AS (
  SELECT conv_id, turn, role, text AS said,
         'Conversation ' || conv_id || ' turn ' || turn || ' ' || role AS name,
         '## Conversation ' || conv_id || ' turn ' || turn || ' ' || role || chr(10) || text AS text
  FROM conversations),
questions AS (SELECT name, {_letter_shares('said')} AS e FROM turns),
{FIXED_PAGES},
page_list AS (
  SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM turns),
lines AS (
  SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM page_list),
marked AS (
  SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn, pos) AS section_no
  FROM lines),
chunks AS (
  SELECT 'section' AS strategy, conv_id || '-' || section_no AS chunk_id,
         {_strip("string_agg(line, chr(10) ORDER BY turn, pos)")} AS text
  FROM marked WHERE section_no > 0 GROUP BY conv_id, section_no
  UNION ALL
  SELECT 'fixed', conv_id || '-' || chunk_no, text FROM page_chunks),
corpus AS (SELECT strategy, chunk_id, text, {_letter_shares('text')} AS e FROM chunks),
pairs AS (
  SELECT strategy, name, chunk_id, {_gap('q.e', 'c.e', len(LETTERS))} AS distance
  FROM questions q CROSS JOIN corpus c),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY strategy, name ORDER BY distance, chunk_id) AS rank
  FROM pairs),
judged AS (
  SELECT strategy, name,
         max(CASE WHEN rank = 1 AND contains(c.text, '## ' || name || chr(10)) THEN 1 ELSE 0 END) AS first,
         max(CASE WHEN contains(c.text, '## ' || name || chr(10)) THEN 1 ELSE 0 END) AS among
  FROM ranked JOIN corpus c USING (strategy, chunk_id) WHERE rank <= 3 GROUP BY strategy, name)
SELECT strategy, count(*) AS cases, CAST(sum(first) AS bigint) AS top1_correct,
       CAST(sum(among) AS bigint) AS top3_correct
FROM judged GROUP BY strategy
"""

ORACLES: dict[str, str] = {
    "normalize_types": NORMALIZED,
    "preview_rows": f"WITH {OPS} SELECT * FROM ops ORDER BY location_id, month LIMIT 20",
    "dataset_profile": f"WITH {OPS} SELECT count(*) AS row_count, 10 AS column_count FROM ops",
    "multi_source_issue_counts": f"""
        WITH {DIRTY}, {TYPES}, {_found(_source('region'))},
        sources AS (SELECT DISTINCT {_source('region')} AS source FROM dirty)
        SELECT s.source, t.issue_type, count(f.issue_type) AS issue_count
        FROM sources s CROSS JOIN types t
        LEFT JOIN found f ON f.source = s.source AND f.issue_type = t.issue_type
        GROUP BY 1, 2""",
    "dataset_fingerprint": """
        SELECT count(*) AS row_count, CAST(coalesce(sum(
          CAST('0x' || substr(md5(concat(
            coalesce(length(CAST(doc_id AS varchar)) || ':' || doc_id, '-'),
            coalesce(length(text) || ':' || text, '-'),
            coalesce(length(lang) || ':' || lang, '-'),
            coalesce(length(source) || ':' || source, '-'),
            coalesce(length(CAST(n_chars AS varchar)) || ':' || n_chars, '-'))), 1, 15) AS bigint)),
          0) AS varchar) AS fingerprint
        FROM documents""",
    "dq_required_columns": f"""
        WITH {DIRTY}, named AS (
          SELECT *, location_id || '/' || strftime(month, '%Y-%m') AS source FROM dirty),
        held AS (
          SELECT source, unnest([
            {", ".join(f"{{'column_name': '{c}', 'cells': count({c})}}" for c in REQUIRED_COLUMNS)}], recursive := true)
          FROM named GROUP BY source)
        SELECT source, column_name, 'error' AS severity FROM held WHERE cells = 0""",
    "ordered_fingerprint": f"""
        WITH {HASHED} SELECT count(*) AS row_count, concat(
          CAST(coalesce(sum(digits % 2147483647 * {_power('doc_id', 2147483647, 1000003)} % 2147483647), 0)
            % 2147483647 AS bigint), '-',
          CAST(coalesce(sum(digits % 2147483629 * {_power('doc_id', 2147483629, 998244353)} % 2147483629), 0)
            % 2147483629 AS bigint)) AS fingerprint
        FROM hashed""",
    "fingerprint_spans": f"""
        WITH {HASHED} SELECT doc_id // 64 AS span, count(*) AS row_count,
          CAST(sum(digits % 2147483647 * {_power('doc_id % 64', 2147483647, 1000003)} % 2147483647)
            % 2147483647 AS bigint) AS first,
          CAST(sum(digits % 2147483629 * {_power('doc_id % 64', 2147483629, 998244353)} % 2147483629)
            % 2147483629 AS bigint) AS second
        FROM hashed GROUP BY 1""",
    "empty_source_counts": f"""
        WITH {DIRTY}, {TYPES}, {_found('region')}
        SELECT r_name AS source, t.issue_type, count(f.issue_type) AS issue_count
        FROM region CROSS JOIN types t
        LEFT JOIN found f ON f.source = r_name AND f.issue_type = t.issue_type AND r_regionkey % 2 = 0
        GROUP BY 1, 2""",
    "dq_duplicate_keys": f"""
        WITH {DIRTY} SELECT location_id, month, count(*) AS group_size
        FROM dirty GROUP BY 1, 2 HAVING count(*) > 1""",
    "dq_duplicate_lineitems": """
        SELECT l_orderkey, l_linenumber, count(*) AS group_size
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "dq_missing_values": f"""
        WITH {DIRTY}, blanks AS ({BLANK_CELLS}) SELECT location_id, month, column_name FROM blanks""",
    "dq_missing_value_counts": f"""
        WITH {DIRTY}, blanks AS ({BLANK_CELLS})
        SELECT column_name, count(*) AS missing FROM blanks GROUP BY 1""",
    "dq_impossible_values": f"WITH {DIRTY} SELECT location_id, month, volume FROM dirty WHERE volume < 0",
    "dq_reconciliation": f"""
        WITH {DIRTY} SELECT location_id, month,
          CAST(CAST({DIFFERENCE} AS decimal(18,2)) AS double) AS difference
        FROM dirty WHERE {DIFFERENCE} > 0.01""",
    "dq_all_issues": f"""
        WITH {DIRTY}, blanks AS ({BLANK_CELLS})
        SELECT 2 AS rule_order, 'duplicate_record' AS issue_type, 'error' AS severity,
               location_id, month, CAST(NULL AS varchar) AS column_name
        FROM dirty GROUP BY location_id, month HAVING count(*) > 1
        UNION ALL SELECT 3, 'missing_value', 'error', location_id, month, column_name FROM blanks
        UNION ALL SELECT 4, 'impossible_value', 'error', location_id, month, 'volume'
        FROM dirty WHERE volume < 0
        UNION ALL SELECT 5, 'reconciliation_error', 'error', location_id, month, 'total_expense'
        FROM dirty WHERE {DIFFERENCE} > 0.01""",
    "dq_invalid_dates": f"""
        WITH cells AS (
          SELECT o_orderkey AS key,
                 {_bad('o_orderkey', "strftime(o_orderdate, '%Y-%m-%d')",
                       {7: "'not-a-date'", 11: "'2001-02-30'", 13: "NULL", 17: "'202501'"})} AS raw_value
          FROM orders)
        SELECT key, raw_value FROM cells
        WHERE raw_value IS NOT NULL AND try_cast(raw_value AS date) IS NULL""",
    "gated_kpis": f"""
        WITH {DIRTY}, {_found(_source('year'))},
        totals AS (
          SELECT {_source('year')} AS source, {TOTALS} FROM dirty GROUP BY 1)
        SELECT source, {VARIANCE} FROM totals
        WHERE source NOT IN (SELECT source FROM found)""",
    "summary_cube": f"""
        WITH {DIRTY} SELECT {_source('year')} AS source, location_id, region, month, count(*) AS row_count,
          {_sum('revenue')} AS revenue, {_sum('budget_revenue')} AS budget_revenue,
          {_sum('labor_expense')} AS labor_expense, {_sum('other_expense')} AS other_expense,
          CAST(sum((region IS NULL)::INT + (revenue IS NULL)::INT) AS bigint) AS blank_cells,
          count(*) FILTER (volume < 0) AS negative_volumes,
          count(*) FILTER ({DIFFERENCE} > 0.01) AS unreconciled
        FROM dirty GROUP BY ALL""",
    "cube_gated_kpis": f"""
        WITH {DIRTY}, {_found(_source('year'))},
        totals AS (
          SELECT {_source('year')} AS source, {TOTALS} FROM dirty GROUP BY 1)
        SELECT source, {VARIANCE}, {MARGIN}, {LABOR} FROM totals
        WHERE source NOT IN (SELECT source FROM found)""",
    "issue_counts": f"""
        WITH {DIRTY}, {TYPES}, {_found("'all'")}
        SELECT t.issue_type, count(f.issue_type) AS issue_count
        FROM types t LEFT JOIN found f USING (issue_type) GROUP BY 1""",
    "issue_types_by_source": f"""
        WITH {DIRTY}, {_found(_source('year'))},
        sources AS (SELECT DISTINCT {_source('year')} AS source FROM dirty),
        kinds AS (SELECT DISTINCT source, issue_type FROM found)
        SELECT s.source, coalesce(string_agg(k.issue_type, ',' ORDER BY k.issue_type), '') AS issue_types
        FROM sources s LEFT JOIN kinds k USING (source) GROUP BY 1""",
    "issues_json": f"""
        WITH {DIRTY} SELECT location_id, month,
          {_issue_json('impossible_value', "'all locations'", *NEGATIVE)} AS issue_json
        FROM dirty WHERE volume < 0""",
    "dq_rule_scorecard": f"""
        WITH {DIRTY}, {TYPES}, {_found("'all'")},
        copied AS (SELECT *, CASE WHEN k % 101 = 0 THEN 2 ELSE 1 END AS copies FROM keyed),
        seeded AS (
          SELECT 'missing_required_column' AS issue_type, 0 AS expected
          UNION ALL SELECT 'duplicate_record', count(*) FROM copied WHERE k % 101 = 0
          UNION ALL SELECT 'missing_value', sum(copies * (CASE WHEN k % 89 = 0 THEN 1 ELSE 0 END
            + CASE WHEN k % 97 = 0 THEN 1 ELSE 0 END)) FROM copied
          UNION ALL SELECT 'impossible_value', coalesce(sum(copies), 0) FROM copied WHERE k % 79 = 0
          UNION ALL SELECT 'reconciliation_error', coalesce(sum(copies), 0) FROM copied WHERE k % 83 = 0),
        detected AS (
          SELECT t.issue_type, count(f.issue_type) AS detected
          FROM types t LEFT JOIN found f USING (issue_type) GROUP BY 1)
        SELECT issue_type AS rule, CAST(expected AS bigint) AS expected, detected,
               expected = detected AS passed
        FROM seeded JOIN detected USING (issue_type)""",
    "kpi_revenue_variance": f"WITH {OPS}, t AS (SELECT {TOTALS} FROM ops) SELECT {VARIANCE} FROM t",
    "kpi_operating_margin": f"WITH {OPS}, t AS (SELECT {TOTALS} FROM ops) SELECT {MARGIN} FROM t",
    "kpi_labor_pct": f"""
        WITH {OPS}, t AS (SELECT {TOTALS} FROM ops) SELECT {LABOR}, rev AS total_revenue FROM t""",
    "kpi_pack": f"""
        WITH {OPS}, {_series()}, t AS (SELECT {TOTALS} FROM ops)
        SELECT {VARIANCE}, {MARGIN}, {LABOR}, month AS latest_month,
               change_amount AS latest_change_amount, change_percent AS latest_change_percent
        FROM t JOIN series ON month = (SELECT max(month) FROM series)""",
    "kpi_month_over_month": f"WITH {OPS}, {_series()} SELECT * FROM series ORDER BY month",
    "kpi_latest_month": f"""
        WITH {OPS}, {_series()} SELECT * FROM series WHERE month = (SELECT max(month) FROM series)""",
    "kpi_by_region": f"""
        WITH {OPS}, t AS (
          SELECT region, location_id, {TOTALS} FROM ops GROUP BY ROLLUP (region, location_id))
        SELECT region, location_id, {VARIANCE}, {MARGIN}, {LABOR} FROM t""",
    "kpi_mom_calendar": f"""
        WITH {OPS}, {_series('location_id', calendar=True)} SELECT * FROM series""",
    "chart_actual_vs_budget": f"""
        WITH {OPS} SELECT month, {_sum('revenue')} AS revenue, {_sum('budget_revenue')} AS budget_revenue
        FROM ops GROUP BY month ORDER BY month""",
    "chart_monthly_trend": f"WITH {OPS}, {_series()} SELECT month, revenue FROM series ORDER BY month",
    "chart_largest_variances": f"""
        WITH {OPS}, t AS (SELECT location_name, {TOTALS} FROM ops GROUP BY 1),
        top AS (
          SELECT location_name, rev AS revenue, bud AS budget_revenue, rev - bud AS variance_amount,
                 abs(rev - bud) AS absolute_variance
          FROM t ORDER BY absolute_variance DESC, location_name LIMIT 10)
        SELECT * FROM top ORDER BY variance_amount, location_name""",
    "chart_largest_variances_by_source": f"""
        WITH {OPS}, t AS (
          SELECT {_source('region')} AS source, location_name, {TOTALS} FROM ops GROUP BY 1, 2),
        gaps AS (
          SELECT source, location_name, rev AS revenue, bud AS budget_revenue,
                 rev - bud AS variance_amount, abs(rev - bud) AS absolute_variance FROM t)
        SELECT * FROM gaps QUALIFY
          row_number() OVER (PARTITION BY source ORDER BY absolute_variance DESC, location_name) <= 3""",
    "chart_largest_variances_by_region": f"""
        WITH {OPS}, t AS (SELECT region, {TOTALS} FROM ops GROUP BY 1)
        SELECT region, rev - bud AS variance_amount, abs(rev - bud) AS absolute_variance
        FROM t ORDER BY absolute_variance DESC, region LIMIT 10""",
    "report_narrative": f"WITH {NARRATIVE} SELECT region, narrative FROM told",
    "report_facts_json": f"WITH {FACTS}",
    "render_claims": f"""
        WITH {CLAIMS} SELECT region, head || chr(10) || chr(10) || tail AS text FROM rendered""",
    "split_summary": f"""
        WITH {CLAIMS} SELECT region, {_strip('head')} AS before, {_strip('tail')} AS after
        FROM rendered""",
    "section_chunks": f"WITH {MARKDOWN} SELECT conv_id, section_no, section, text FROM markdown",
    "document_sections": f"WITH {DOCUMENTS}",
    "paged_section_chunks": f"WITH {PAGED} SELECT conv_id, section_no, section, text, page FROM paged",
    "fixed_chunks": f"WITH {FIXED}",
    "paged_fixed_chunks": f"""
        WITH turns AS (SELECT * FROM conversations), {FIXED_PAGES}
        SELECT conv_id, chunk_no, page, text FROM page_chunks""",
    "corpus_build": f"""
        WITH {MARKDOWN}, {PAGED}
        SELECT 'markdown-' || conv_id || '-' || section_no AS chunk_id,
               CAST(conv_id AS varchar) AS document, 'markdown' AS source_type, section,
               CAST(NULL AS bigint) AS page FROM markdown
        UNION ALL
        SELECT 'paged-' || conv_id || '-' || section_no, CAST(conv_id AS varchar), 'paged',
               section, page FROM paged""",
    "knn_top3": f"""
        WITH {NEIGHBOURS}
        SELECT query_id, CAST(rank AS integer) AS rank, vec_id, label, distance FROM hits""",
    "knn_citation": f"WITH {NEIGHBOURS} SELECT query_id, vec_id, label FROM hits WHERE rank = 1",
    "retrieval_scorecard": f"""
        WITH {NEIGHBOURS}, judged AS (
          SELECT query_id,
                 max(CASE WHEN rank = 1 AND label = expected THEN 1 ELSE 0 END) AS first,
                 max(CASE WHEN label = expected THEN 1 ELSE 0 END) AS among
          FROM hits GROUP BY query_id),
        counted AS (
          SELECT count(*) AS cases, CAST(sum(first) AS bigint) AS top1_correct,
                 CAST(sum(among) AS bigint) AS top3_correct FROM judged)
        SELECT *, top1_correct / cases * 100 AS top1_percent,
               top3_correct / cases * 100 AS top3_percent FROM counted""",
    "routing_scorecard": f"""
        WITH {NEIGHBOURS},
        votes AS (
          SELECT query_id, expected, label, count(*) AS votes, min(rank) AS nearest
          FROM hits GROUP BY 1, 2, 3),
        best AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, nearest) AS place
          FROM votes),
        pairs_of AS (
          SELECT expected, label AS actual, count(*) AS cases FROM best WHERE place = 1 GROUP BY 1, 2)
        SELECT expected, actual, cases,
               (SELECT sum(cases) FILTER (WHERE expected = actual) / sum(cases) * 100
                FROM pairs_of) AS overall_percent
        FROM pairs_of""",
    "day_order_by_source": """
        WITH raw AS (
          SELECT source, day,
                 CASE WHEN left(source, 1) IN ('1', '3') OR left(source, 1) = '5' AND day(day) <= 12
                      THEN strftime(day, '%-d/%-m/%Y')
                      WHEN left(source, 1) IN ('2', '4') THEN strftime(day, '%-m/%-d/%Y')
                      ELSE strftime(day, '%Y-%m-%d') END AS cell
          FROM (SELECT o_orderpriority AS source, CAST(o_orderdate AS date) AS day FROM orders)),
        parts AS (
          SELECT *, contains(cell, '/') AS slash, TRY_CAST(split_part(cell, '/', 1) AS int) AS one,
                 TRY_CAST(split_part(cell, '/', 2) AS int) AS two
          FROM raw),
        votes AS (
          SELECT source, count(*) FILTER (slash) AS slashed,
                 count(*) FILTER (slash AND one > 12) AS day_first,
                 count(*) FILTER (slash AND two > 12) AS month_first
          FROM parts GROUP BY source),
        orders_of AS (
          SELECT *, CASE WHEN day_first > month_first THEN 'day' ELSE 'month' END AS day_order,
                 slashed > 0 AND day_first = month_first AS ambiguous
          FROM votes),
        read AS (
          SELECT source, day,
                 CASE WHEN NOT slash THEN TRY_CAST(cell AS date)
                      WHEN day_order = 'day' THEN CAST(try_strptime(cell, '%d/%m/%Y') AS date)
                      ELSE CAST(try_strptime(cell, '%m/%d/%Y') AS date) END AS month
          FROM parts JOIN orders_of USING (source))
        SELECT o.*, r.days, r.right_days
        FROM orders_of o JOIN (
          SELECT source, count(month) AS days, count(*) FILTER (month = day) AS right_days
          FROM read GROUP BY source) r USING (source)""",
    "chunk_strategy_scorecard": STRATEGIES,
    "corpus_citation": f"""
        WITH {MARKDOWN}, {PAGED},
        pieces AS (
          SELECT 'markdown-' || conv_id || '-' || section_no AS vec_id,
                 CAST(conv_id AS varchar) AS document, 'markdown' AS source_type, section,
                 CAST(NULL AS bigint) AS page, text FROM markdown
          UNION ALL
          SELECT 'paged-' || conv_id || '-' || section_no, CAST(conv_id AS varchar), 'paged',
                 section, page, text FROM paged),
        corpus AS (SELECT *, {_letter_shares('text')} AS e FROM pieces),
        questions AS (
          SELECT conv_id || '-' || turn || '-' || role AS query_id, {_letter_shares('text')} AS e
          FROM conversations)
        SELECT query_id, vec_id, document, source_type, section, page
        FROM questions q CROSS JOIN corpus c
        QUALIFY row_number() OVER (
          PARTITION BY query_id ORDER BY {_gap('q.e', 'c.e', len(LETTERS))}, vec_id) = 1""",
}
