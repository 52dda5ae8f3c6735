"""Independent DuckDB SQL for each registered query (same tables, same column names)."""

from __future__ import annotations

from ..schema import NUMERIC_PATTERN

LEDGER = """ledger AS (
  SELECT l_shipdate AS "Date", p_name AS "Description", l_extendedprice AS "Amount", p_type AS "Category",
         CASE WHEN l_returnflag = 'R' THEN 'Income' ELSE 'Expense' END AS "Type"
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

EVENTS = """ledger AS (
  SELECT ts AS "Date", props AS "Description", value AS "Amount", event_type AS "Category",
         CASE event_type WHEN 'signup' THEN 'Income' WHEN 'purchase' THEN 'Expense' ELSE event_type END AS "Type"
  FROM events)"""

DIRTY_PART = """dirty_part AS (
  SELECT p_partkey,
         CASE p_size % 5 WHEN 0 THEN p_brand WHEN 1 THEN '1,200' WHEN 2 THEN '12d'
                         WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE NULL END AS raw_amount,
         CASE WHEN p_size % 7 = 0 THEN concat('Salary ', p_name) ELSE p_name END AS "Description",
         p_type AS "Category"
  FROM part)"""

DIRTY_ORDERS = """dirty_orders AS (
  SELECT CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS " date ",
         CASE WHEN o_orderkey % 7 = 0 THEN concat('Salary ', o_orderpriority) ELSE o_orderpriority END AS "DESCRIPTION",
         CASE o_orderkey % 5 WHEN 0 THEN '1,200' WHEN 1 THEN '12d' WHEN 2 THEN 'NA'
              ELSE CAST(o_totalprice AS VARCHAR) END AS "Amount",
         CASE WHEN o_orderkey % 13 = 0 THEN 'NA' ELSE o_orderstatus END AS "category",
         CAST(o_orderkey AS VARCHAR) AS order_key,
         o_orderkey, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority
  FROM orders)"""

CENTS = 'CAST("Amount" AS DECIMAL(38,8))'
INC = f"""SUM(CASE WHEN "Type" = 'Income' THEN {CENTS} END)"""
EXP = f"""SUM(CASE WHEN "Type" = 'Expense' THEN {CENTS} END)"""


def money(x: str) -> str:
    return f"CAST(COALESCE({x}, 0) AS DOUBLE)"


def currency(x: str) -> str:
    return f"('₹' || format('{{:,.0f}}', CAST({x} AS DOUBLE)))"


def ts_text(x: str) -> str:
    return (
        f"(strftime({x}, '%Y-%m-%d %H:%M:%S') || CASE WHEN strftime({x}, '%f') = '000000' THEN '' "
        f"ELSE '.' || strftime({x}, '%f') END)"
    )


def safe_lower(x: str) -> str:
    return f"lower(COALESCE(CAST({x} AS VARCHAR), 'nan'))"


def icon_class(cat: str, typ: str) -> str:
    return (
        f"CASE WHEN contains({safe_lower(cat)}, 'food') THEN 'food' "
        f"WHEN contains({safe_lower(cat)}, 'travel') THEN 'travel' "
        f"WHEN contains({safe_lower(typ)}, 'income') THEN 'income' ELSE 'other' END"
    )


def icon_glyph(cls: str) -> str:
    return f"CASE {cls} WHEN 'food' THEN '🍔' WHEN 'travel' THEN '✈️' WHEN 'income' THEN '💰' ELSE '💸' END"


def type_expr(cat: str, desc: str) -> str:
    kws = ("income", "salary", "dividend", "profit")
    conds = [f"contains({safe_lower(c)}, '{k}')" for k in kws for c in (cat, desc)]
    return f"CASE WHEN {' OR '.join(conds)} THEN 'Income' ELSE 'Expense' END"


def amount_expr(raw: str) -> str:
    v = f"CASE WHEN regexp_matches({raw}, '{NUMERIC_PATTERN}') THEN TRY_CAST(trim({raw}) AS DOUBLE) END"
    return f"COALESCE(CASE WHEN isfinite({v}) THEN {v} END, 0.0)"


def row_text(date: str, desc: str, amount: str, cat: str) -> str:
    amt = f"regexp_replace(CAST(TRY_CAST({amount} AS DECIMAL(18,2)) AS VARCHAR), '0$', '')"
    return (
        f"('Date: ' || COALESCE({ts_text(date)}, 'NaT') || ', Description: ' || COALESCE(CAST({desc} AS VARCHAR), 'nan') "
        f"|| ', Amount: ' || COALESCE({amt}, 'nan') || ', Category: ' || COALESCE(CAST({cat} AS VARCHAR), 'nan'))"
    )


RECENT_ORDER = '"Date" DESC NULLS LAST, "Description" NULLS FIRST, "Amount" NULLS FIRST, "Category" NULLS FIRST, "Type" NULLS FIRST'
DEFAULT_MONTH = """(SELECT date_trunc('month', COALESCE(max("Date"), TIMESTAMP '2026-01-01 00:00:00')) FROM ledger)"""
MONTH_SLICE = f"""month_rows AS (SELECT * FROM ledger WHERE "Date" >= {DEFAULT_MONTH} AND "Date" < {DEFAULT_MONTH} + INTERVAL 1 MONTH)"""
BY_CAT = f"""SELECT "Category", SUM({CENTS}) AS amt, count(*) AS txn_count FROM {{src}} WHERE "Category" IS NOT NULL {{extra}} GROUP BY 1"""
TOP_CATS = f"""top AS (SELECT * FROM (SELECT "Category", txn_count, {money('amt')} AS amount,
    row_number() OVER (ORDER BY txn_count DESC, "Category") AS rank FROM ({BY_CAT.format(src='ledger', extra='')})) WHERE rank <= 3)"""


def _monthly(cte: str) -> str:
    return f"""WITH {cte}
SELECT month, strftime(month, '%Y-%m') AS month_key, strftime(month, '%b') AS label,
       {money(INC)} AS income, {money(EXP)} AS expense,
       CAST(COALESCE({INC}, 0) - COALESCE({EXP}, 0) AS DOUBLE) AS net
FROM (SELECT date_trunc('month', "Date") AS month, * FROM ledger WHERE "Date" IS NOT NULL)
GROUP BY month ORDER BY month"""


def _kpi(cte: str) -> str:
    return f"""WITH {cte}
SELECT {money(INC)} AS income, {money(EXP)} AS expense,
       CAST(COALESCE({INC}, 0) - COALESCE({EXP}, 0) AS DOUBLE) AS balance, count(*) AS txn_count
FROM ledger"""


def _top_expense(cte: str) -> str:
    return f"""WITH {cte}, g AS ({BY_CAT.format(src='ledger', extra="AND \"Type\" = 'Expense'")})
SELECT COALESCE((SELECT "Category" FROM g ORDER BY amt DESC, "Category" LIMIT 1), 'None') AS "Category",
       COALESCE((SELECT CAST(amt AS DOUBLE) FROM g ORDER BY amt DESC, "Category" LIMIT 1), 0.0) AS amount"""


def _share(src: str) -> str:
    return f"""SELECT "Category", {money('amt')} AS amount,
       {money('amt')} / NULLIF({money('SUM(amt) OVER ()')}, 0) AS share
FROM ({BY_CAT.format(src=src, extra='')})"""


def _recent(cte: str) -> str:
    return f"""WITH {cte}
SELECT "Date", "Description", "Amount", "Category", "Type",
       row_number() OVER (ORDER BY {RECENT_ORDER}) AS rank,
       strftime("Date", '%d %b') AS day_label,
       CASE WHEN "Type" = 'Expense' THEN '-' ELSE '+' END AS sign,
       {currency('"Amount"')} AS amount_text,
       {icon_class('"Category"', '"Type"')} AS icon,
       {icon_glyph(icon_class('"Category"', '"Type"'))} AS icon_glyph
FROM ledger ORDER BY {RECENT_ORDER} LIMIT 3"""


ORACLE: dict[str, str] = {
    "monthly_net": _monthly(LEDGER),
    "monthly_net_events": _monthly(EVENTS),
    "kpi_totals": _kpi(LEDGER),
    "kpi_totals_events": _kpi(EVENTS),
    "txn_count": f"WITH {LEDGER} SELECT count(*) AS txn_count FROM ledger",
    "expense_rows": f"""WITH {LEDGER} SELECT * FROM ledger WHERE "Type" = 'Expense'""",
    "distinct_months": f"""WITH {LEDGER}
SELECT DISTINCT strftime("Date", '%Y-%m') AS month_key, CAST(strptime(strftime("Date", '%Y-%m'), '%Y-%m') AS TIMESTAMP) AS month
FROM ledger WHERE "Date" IS NOT NULL ORDER BY 1""",
    "expense_by_category": f"""WITH {LEDGER}
SELECT "Category", {money('amt')} AS amount, txn_count FROM ({BY_CAT.format(src='ledger', extra="AND \"Type\" = 'Expense'")})""",
    "top_expense_category": _top_expense(LEDGER),
    "top_expense_category_events": _top_expense(EVENTS),
    "default_month": f"""WITH {LEDGER}
SELECT d AS default_date, date_trunc('month', d) AS month, strftime(d, '%Y-%m') AS month_key,
       strftime(d, '%B %Y') AS month_label
FROM (SELECT COALESCE(max("Date"), TIMESTAMP '2026-01-01 00:00:00') AS d FROM ledger)""",
    "month_slice": f"WITH {LEDGER}, {MONTH_SLICE} SELECT * FROM month_rows",
    "month_distribution": f"WITH {LEDGER}, {MONTH_SLICE} {_share('month_rows')}",
    "category_share": f"WITH {LEDGER} {_share('ledger')}",
    "category_frequency": f"""WITH {LEDGER}
SELECT "Category", count(*) AS txn_count FROM ledger WHERE "Category" IS NOT NULL GROUP BY 1""",
    "top_categories": f"WITH {LEDGER}, {TOP_CATS} SELECT * FROM top",
    "top_category_rows": f"""WITH {LEDGER}, {TOP_CATS}
SELECT * FROM ledger WHERE "Category" IN (SELECT "Category" FROM top)""",
    "category_drilldown": f"""WITH {LEDGER}
SELECT * FROM ledger WHERE "Category" = (SELECT "Category" FROM ledger WHERE "Category" IS NOT NULL
                                          GROUP BY 1 ORDER BY count(*) DESC, "Category" LIMIT 1)""",
    "recent_activity": _recent(LEDGER),
    "recent_activity_events": _recent(EVENTS),
    "date_labels": f"""WITH {EVENTS}
SELECT "Date", strftime("Date", '%b') AS month_label, strftime("Date", '%d %b') AS day_label,
       strftime("Date", '%A, %d %B %Y') AS long_date, strftime("Date", '%B %Y') AS month_year,
       strftime("Date", '%B') AS month_name
FROM ledger""",
    "with_labels": f"""WITH {EVENTS}
SELECT *, CAST(date_trunc('month', "Date") AS TIMESTAMP) AS month, strftime("Date", '%Y-%m') AS month_key,
       strftime("Date", '%b') AS month_label, strftime("Date", '%d %b') AS day_label,
       {currency('"Amount"')} AS amount_text, CASE WHEN "Type" = 'Expense' THEN '-' ELSE '+' END AS sign,
       {icon_class('"Category"', '"Type"')} AS icon, {icon_glyph(icon_class('"Category"', '"Type"'))} AS icon_glyph
FROM ledger""",
    "format_currency": f"""WITH m AS ({_monthly(LEDGER)})
SELECT month_key, net, {currency('income')} AS income_text, {currency('expense')} AS expense_text,
       {currency('net')} AS net_text FROM m""",
    "classify_icon": f"""WITH {EVENTS}
SELECT *, {icon_class('"Category"', '"Type"')} AS icon, {icon_glyph(icon_class('"Category"', '"Type"'))} AS icon_glyph
FROM ledger""",
    "signed_display": f"""WITH {EVENTS}
SELECT *, CASE WHEN "Type" = 'Expense' THEN '-' ELSE '+' END AS sign,
       (CASE WHEN "Type" = 'Expense' THEN '-' ELSE '+' END) || ' ' || {currency('"Amount"')} AS amount_display
FROM ledger""",
    "infer_type": f"""WITH {DIRTY_PART}
SELECT p_partkey, "Description", "Category", {type_expr('"Category"', '"Description"')} AS "Type" FROM dirty_part""",
    "coerce_amount": f"""WITH {DIRTY_PART}
SELECT p_partkey, raw_amount, {amount_expr('raw_amount')} AS "Amount" FROM dirty_part""",
    "parse_date": f"""WITH {DIRTY_ORDERS}
SELECT order_key, CAST(NULLIF(trim(" date "), '') AS TIMESTAMP) AS "Date" FROM dirty_orders""",
    "normalize_headers": """SELECT p_partkey AS "Part_Key", p_name AS "Description", p_type AS "Category",
       p_retailprice AS "Amount_Inr" FROM part""",
    "row_text": f"""WITH {EVENTS}
SELECT *, {row_text('"Date"', '"Description"', '"Amount"', '"Category"')} AS text FROM ledger""",
    "text_fingerprint": f"""WITH {LEDGER}, t AS (SELECT *, {row_text('"Date"', '"Description"', '"Amount"', '"Category"')} AS text FROM ledger)
SELECT *, md5(text) AS fp FROM t""",
    "dataset_fingerprint": f"""WITH {LEDGER}, t AS (SELECT {row_text('"Date"', '"Description"', '"Amount"', '"Category"')} AS text FROM ledger)
SELECT count(*) AS n_rows, concat_ws('-', {", ".join(f"CAST(COALESCE(SUM(CAST(('0x' || substr(md5(text), {k}, 8)) AS UBIGINT)), 0) AS VARCHAR)" for k in (1, 9, 17, 25))}) AS fp_sum
FROM t""",
    "records_json": f"""WITH {EVENTS}
SELECT *, CAST(to_json(struct_pack("Date" := {ts_text('"Date"')}, "Description" := "Description",
       "Amount" := "Amount", "Category" := "Category", "Type" := "Type")) AS VARCHAR) AS record FROM ledger""",
}


def na(x: str) -> str:
    from ..schema import NA_TOKENS

    tokens = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
    return f"(CASE WHEN {x} IN ({tokens}) THEN NULL ELSE {x} END)"


EVENTS_RAW = """SELECT ts AS "Date", props AS "Description", value AS "Amount", event_type AS "Category",
       CASE event_type WHEN 'signup' THEN 'Income' WHEN 'purchase' THEN 'Expense' ELSE event_type END AS "Type"
FROM events"""

SQ_DIST = """list_reduce(list_transform(list_zip(a.embedding, b.embedding),
    lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))),
    lambda acc, v: acc + v)"""
KNN_ALL = f"""knn AS (
  SELECT query_id, rank, row_id, distance, text FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS row_id, {SQ_DIST} AS distance,
           'Record ' || b.vec_id || ', label ' || b.label AS text,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQ_DIST}, b.vec_id) AS rank
    FROM embeddings a, embeddings b) WHERE rank <= 5)"""
CONTEXT = """ctx AS (
  SELECT e.vec_id AS query_id, COALESCE(string_agg(knn.text, chr(10) ORDER BY knn.rank), 'No data found.') AS context
  FROM embeddings e LEFT JOIN knn ON knn.query_id = e.vec_id GROUP BY e.vec_id)"""
PENDING = """pending AS (
  SELECT conv_id, turn, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
  WHERE rn = 1 AND role = 'user')"""
SYSTEM = (
    "Today''s Date is 2026-01-01 00:00:00. Assume queries about ''this month'' refer to January. "
    "Always format currency in Indian Rupees (₹)."
)
PROMPT_HEAD_SQL = "'You are a helpful financial assistant.' || chr(10) || 'Transaction Data:' || chr(10)"
ORACLE.update(
    {
        "csv_scan": f"""WITH {DIRTY_ORDERS}, raw AS (
  SELECT {na('" date "')} AS d, {na('"DESCRIPTION"')} AS "Description", {na('"Amount"')} AS a,
         {na('"category"')} AS "Category", {na('order_key')} AS "Order_Key" FROM dirty_orders)
SELECT CAST(NULLIF(trim(d), '') AS TIMESTAMP) AS "Date", "Description", {amount_expr('a')} AS "Amount", "Category",
       {type_expr('"Category"', '"Description"')} AS "Type", "Order_Key" FROM raw""",
        "sync_collection": EVENTS_RAW,
        "read_collection": f"""SELECT ts AS "Date", props AS "Description", value AS "Amount", event_type AS "Category",
       CASE event_type WHEN 'signup' THEN 'Income' ELSE 'Expense' END AS "Type", CAST(NULL AS BIGINT) AS user_id
FROM events WHERE event_type IN ('signup', 'purchase')
UNION ALL
SELECT ts, props, value, event_type, NULL, user_id FROM events WHERE event_type NOT IN ('signup', 'purchase')""",
        "replace_ledger": f"WITH {LEDGER} SELECT * FROM ledger",
        "pending_turns": f"WITH {PENDING} SELECT * FROM pending",
        "append_answers": f"""WITH {PENDING}
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT conv_id, turn + 1, 'assistant', 'Received: ' || text FROM pending""",
        "knn": f"WITH {KNN_ALL} SELECT query_id, rank, row_id, distance FROM knn",
        "knn_lookup": f"""WITH {KNN_ALL}
SELECT knn.query_id, knn.rank, knn.row_id, knn.distance, e.label FROM knn JOIN embeddings e ON e.vec_id = knn.row_id""",
        "knn_small_corpus": f"""WITH reps AS (
  SELECT label, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label)
SELECT query_id, rank, row_id, distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS row_id, {SQ_DIST} AS distance,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQ_DIST}, b.vec_id) AS rank
  FROM embeddings a, reps b) WHERE rank <= 5""",
        "assemble_context": f"WITH {KNN_ALL}, {CONTEXT} SELECT * FROM ctx",
        "build_prompts": f"""WITH {KNN_ALL}, {CONTEXT}, q AS (
  SELECT vec_id AS query_id,
         '{SYSTEM}' || chr(10) || chr(10) || 'User Query: ' || 'Which records are closest to record ' || vec_id || '?' AS question
  FROM embeddings)
SELECT q.query_id, q.question, ctx.context,
       {PROMPT_HEAD_SQL} || ctx.context || chr(10) || chr(10) || 'User Question: ' || q.question AS prompt
FROM q JOIN ctx ON q.query_id = ctx.query_id""",
        "cache_misses": """SELECT DISTINCT md5(text) AS fp, text FROM documents
WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)""",
    }
)


# --- the hashing embedder in SQL (same tokens, MD5 bucket/sign, norm, float32) ---
_EMBED_TEMPLATE = r"""@N_tok AS (
  SELECT @ID AS id, unnest(regexp_split_to_array(lower(@TEXT), '[^\p{L}\p{N}_]+')) AS tok
  FROM @SRC WHERE @TEXT IS NOT NULL),
@N_h AS (SELECT id, CAST(('0x' || substr(md5(tok), 1, 16)) AS UBIGINT) AS hv FROM @N_tok WHERE tok <> ''),
@N_c AS (SELECT id, CAST(hv % 64 AS INTEGER) AS idx,
                SUM(CASE WHEN hv >= CAST(9223372036854775808 AS UBIGINT) THEN -1 ELSE 1 END) AS cnt
         FROM @N_h GROUP BY 1, 2),
@N_v AS (SELECT id, list(struct_pack(i := idx, c := cnt)) AS cells, sqrt(SUM(cnt * cnt)) AS norm FROM @N_c GROUP BY 1),
@N AS (
  SELECT s.id, list_transform(range(64), lambda j: CAST(
           COALESCE(list_sum(list_transform(list_filter(v.cells, lambda e: e.i = j), lambda e: e.c)), 0)
           / CASE WHEN COALESCE(v.norm, 0) > 0 THEN v.norm ELSE 1 END AS FLOAT)) AS embedding
  FROM (SELECT DISTINCT @ID AS id FROM @SRC WHERE @TEXT IS NOT NULL) s LEFT JOIN @N_v v ON v.id = s.id)"""


def embed_cte(name: str, src: str, id_col: str, text_col: str) -> str:
    """CTEs ending in ``name(id, embedding)`` for the non-null texts of ``src``."""
    return _EMBED_TEMPLATE.replace("@N", name).replace("@SRC", src).replace("@ID", id_col).replace("@TEXT", text_col)


LEDGER_TEXT = f"""ledger_text AS (SELECT {row_text('"Date"', '"Description"', '"Amount"', '"Category"')} AS text FROM ledger)"""
QUESTIONS = f"""questions AS (
  SELECT conv_id, turn, conv_id AS query_id,
         '{SYSTEM}' || chr(10) || chr(10) || 'User Query: ' || text AS question FROM pending)"""
HITS = f"""{LEDGER_TEXT},
corpus_texts AS (SELECT DISTINCT text FROM ledger_text),
{embed_cte('cemb', 'corpus_texts', 'text', 'text')},
{QUESTIONS},
{embed_cte('qemb', 'questions', 'query_id', 'question')},
hits AS (
  SELECT query_id, rank, distance, text FROM (
    SELECT a.id AS query_id, lt.text, {SQ_DIST} AS distance,
           row_number() OVER (PARTITION BY a.id ORDER BY {SQ_DIST}, lt.text) AS rank
    FROM qemb a, ledger_text lt JOIN cemb b ON b.id = lt.text) WHERE rank <= 5)"""

ORACLE.update(
    {
        "embed_texts": f"WITH {embed_cte('e', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, embedding FROM e",
        "embed_cached": f"""WITH {embed_cte('e', 'documents', 'doc_id', 'text')}
SELECT d.doc_id, md5(d.text) AS fp, e.embedding FROM documents d JOIN e ON e.id = d.doc_id""",
        "ingest": f"""WITH {LEDGER}, {LEDGER_TEXT},
corpus_texts AS (SELECT DISTINCT text FROM ledger_text),
{embed_cte('cemb', 'corpus_texts', 'text', 'text')}
SELECT lt.text, md5(lt.text) AS fp, cemb.embedding FROM ledger_text lt JOIN cemb ON cemb.id = lt.text""",
        "retrieve": f"WITH {LEDGER}, {PENDING}, {HITS} SELECT * FROM hits",
        "rag_batch": f"""WITH {LEDGER}, {PENDING}, {HITS},
ctx AS (SELECT q.query_id, COALESCE(string_agg(h.text, chr(10) ORDER BY h.rank), 'No data found.') AS context
        FROM questions q LEFT JOIN hits h ON h.query_id = q.query_id GROUP BY q.query_id)
SELECT q.conv_id, q.turn, q.question, ctx.context,
       {PROMPT_HEAD_SQL} || ctx.context || chr(10) || chr(10) || 'User Question: ' || q.question AS prompt
FROM questions q JOIN ctx ON ctx.query_id = q.query_id""",
    }
)

ORACLE.update(
    {
        "ledger_rollup": f"""WITH {LEDGER}
SELECT date_trunc('month', "Date") AS month, "Category", "Type", {money(f'SUM({CENTS})')} AS amount,
       count(*) AS txn_count, max("Date") AS last_date
FROM ledger GROUP BY 1, 2, 3""",
        "rollup_kpi_totals": ORACLE["kpi_totals"],
        "rollup_monthly_net": ORACLE["monthly_net"],
        "rollup_month_distribution": ORACLE["month_distribution"],
        "rollup_top_categories": ORACLE["top_categories"],
    }
)
