"""Ledger data model: the one table every operator reads, plus fixed vocabularies.

A ledger is an unordered multiset of transactions.  Rows carry no key and
duplicates are legal, so every operator that needs an order tie-breaks over
all of its output columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

DATE, DESCRIPTION, AMOUNT, CATEGORY, TYPE = "Date", "Description", "Amount", "Category", "Type"

LEDGER = T.StructType(
    [
        T.StructField(DATE, T.TimestampNTZType(), True),
        T.StructField(DESCRIPTION, T.StringType(), True),
        T.StructField(AMOUNT, T.DoubleType(), True),
        T.StructField(CATEGORY, T.StringType(), True),
        T.StructField(TYPE, T.StringType(), True),
    ]
)
LEDGER_COLUMNS = [f.name for f in LEDGER.fields]

# Money is summed exactly as cents, then reported as double.

# --- fixed values (must equal the dashboard's behaviour) -------------------
# Columns an upload must carry after header normalisation.
REQUIRED_UPLOAD = ("Date", "Description", "Amount", "Category")
# Columns the record-store sync requires (exact names, Category optional).
REQUIRED_SYNC = ("Date", "Description", "Amount")
# The two transaction types the totals know about.
INCOME, EXPENSE = "Income", "Expense"
# Substrings that mark a row as income when Type has to be inferred.
INCOME_KEYWORDS = ("income", "salary", "dividend", "profit")
# Currency symbol used by every money label.
CURRENCY_SYMBOL = "₹"
# Default sizes of the dashboard lists and of retrieval.
RECENT_N = 3
TOP_N = 3
RETRIEVAL_K = 5
EMBED_BATCH = 100
# The record store's commit size; files have no such limit, so it is opt-in
# (``append_collection(max_records_per_file=SYNC_COMMIT)``).
SYNC_COMMIT = 400
# Embedding task names for stored rows and for questions.
TASK_DOCUMENT = "retrieval_document"
TASK_QUERY = "retrieval_query"
# Context text when retrieval finds nothing.
NO_DATA = "No data found."
# Text of a null value inside row text (how a string cast renders it).
NULL_TEXT = "nan"
NULL_DATE_TEXT = "NaT"
# Tokens a CSV reader treats as missing (the pandas default list).
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# A numeric literal pandas would accept; everything else coerces to 0.0.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Prompt pieces: the system context put before a question, and the
# instruction block wrapped around the retrieved rows.
SYSTEM_CONTEXT = (
    "Today's Date is {today}. Assume queries about 'this month' refer to {month}. "
    "Always format currency in Indian Rupees ({symbol})."
)
QUESTION_TEMPLATE = "{system}\n\nUser Query: {question}"
PROMPT_HEAD = "You are a helpful financial assistant.\nTransaction Data:\n"
PROMPT_TAIL = "\n\nUser Question: "
# Icon per row class on the activity list.
ICONS = {"food": "🍔", "travel": "✈️", "income": "💰", "other": "💸"}
