"""Registered queries: statement clean-up. Statements are written by Spark from each customer's holdings in four layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch, settle
from ..operators import holdings as hld
from ..sources import dimensions as dim
from ..sources import panels
from ..sources.statements import rows_of, scan_statements
from . import books  # noqa: F401
from .common import big, cte, r, rnd, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name, oracle=None):
    def keep(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return run

    return keep


SYMBOLS = list(dim.ISINS.items())
HEAD = {
    0: "Client,Person {k}\nBranch,17{k}\nPositions on 01-04-2025\nTotals\nPaid in,64000\n\nSecurity Name,ISIN,Quantity,Average price,Buy value,Closing price,Closing value",
    1: "Symbol,Investment Value",
    2: "Stock,Qty,Avg Price",
    3: "scrip,sector,qty held,,,P&L,ltp,investment value",
}


def documents(spark, sf):
    """(file, text): one statement per customer."""
    held = panels.holdings(spark, sf).withColumns(
        {
            "k": F.col("portfolio_id").cast("bigint"),
            "b": F.regexp_extract("instrument", r"(\d+)", 1).cast("int"),
            "a": F.floor("amount").cast("bigint"),
            "q": F.col("quantity").cast("bigint"),
        }
    )
    names = F.array(*[F.lit(s) for _, s in SYMBOLS])
    codes = F.array(*[F.lit(i) for i, _ in SYMBOLS])
    known = F.col("b") <= len(SYMBOLS)
    symbol = F.when(known, F.try_element_at(names, F.col("b"))).otherwise(F.concat(F.lit("MYST"), F.col("b")))
    isin = F.when(known, F.try_element_at(codes, F.col("b"))).otherwise("INF999XX9XX9")
    held = held.withColumns({"s": symbol, "isin": isin, "lay": F.pmod("k", F.lit(4))})
    k, a, q = (F.col(c).cast("string") for c in ("k", "a", "q"))
    rupees = F.concat(F.lit('"₹'), F.floor(F.col("a") / 1000).cast("string"), F.lit(","), F.lpad((F.col("a") % 1000).cast("string"), 3, "0"), F.lit('"'))
    tag = F.when(F.col("b") % 3 == 0, "-EQ").when(F.col("b") % 3 == 1, "EQ").otherwise(" - equity")
    line = (
        F.when(F.col("lay") == 0, F.concat_ws(",", F.concat(F.lit("COMPANY "), F.col("b"), F.lit(" LTD")), "isin", q, F.lit("100"), F.floor(F.col("a") * 9 / 10).cast("string"), F.lit("120"), a))
        .when(F.col("lay") == 1, F.concat_ws(",", F.concat("s", tag), rupees))
        .when(F.col("lay") == 2, F.concat_ws(",", "s", q, F.when(F.col("b") % 4 == 0, "-").otherwise("250.5")))
        .otherwise(F.concat_ws(",", F.concat("s", F.lit(".NS")), F.lit("X"), q, F.lit(""), F.lit(""), F.lit("5"), F.lit("120"), F.concat(F.lit("Rs."), a)))
    )
    # The largest holding comes in two lots.
    lots = held.withColumn("lot", F.explode(F.when(F.col("rank") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    body = lots.groupBy("portfolio_id", "k", "lay").agg(F.sort_array(F.collect_list(F.struct("rank", "lot", line.alias("line")))).alias("rows"))
    head = F.lit(HEAD[3])
    for n in (2, 1, 0):
        head = F.when(F.col("lay") == n, F.replace(F.lit(HEAD[n]), F.lit("{k}"), k)).otherwise(head)
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n"))
    return body.select(F.concat(F.lit("acct_"), "portfolio_id").alias("file"), text.alias("text"))


def rows(spark, sf):
    return settle(rows_of(documents(spark, sf)))


_syms = "[" + ", ".join(f"'{s}'" for _, s in SYMBOLS) + "]"
_codes = "[" + ", ".join(f"'{i}'" for i, _ in SYMBOLS) + "]"
_text = lambda s: "'" + s.replace("{k}", "' || k || '").replace("\n", "' || chr(10) || '") + "'"
cte("ranked_holdings", "SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY amount DESC, instrument) AS rk FROM holdings")
cte(
    "doc_lines",
    f"""SELECT portfolio_id, k, lay, rk, lot, CASE lay WHEN 0 THEN 'COMPANY ' || b || ' LTD,' || isin || ',' || q || ',100,' || CAST(floor(a * 9 / 10) AS BIGINT) || ',120,' || a
WHEN 1 THEN s || CASE b % 3 WHEN 0 THEN '-EQ' WHEN 1 THEN 'EQ' ELSE ' - equity' END || ',"₹' || a // 1000 || ',' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') || '"'
WHEN 2 THEN s || ',' || q || ',' || CASE WHEN b % 4 = 0 THEN '-' ELSE '250.5' END ELSE s || '.NS,X,' || q || ',,,5,120,Rs.' || a END AS line
FROM (SELECT *, k % 4 AS lay, CASE WHEN b <= {len(SYMBOLS)} THEN {_syms}[b] ELSE 'MYST' || b END AS s, CASE WHEN b <= {len(SYMBOLS)} THEN {_codes}[b] ELSE 'INF999XX9XX9' END AS isin FROM (
 SELECT *, CAST(portfolio_id AS BIGINT) AS k, CAST(regexp_extract(instrument, '(\\d+)', 1) AS INT) AS b, CAST(floor(amount) AS BIGINT) AS a, CAST(quantity AS BIGINT) AS q FROM ranked_holdings)), range(0, 2) l(lot) WHERE lot = 0 OR rk = 1""",
)
cte(
    "docs",
    f"""SELECT 'acct_' || portfolio_id AS file, CASE lay WHEN 0 THEN {_text(HEAD[0])} WHEN 1 THEN {_text(HEAD[1])} WHEN 2 THEN {_text(HEAD[2])} ELSE {_text(HEAD[3])} END || chr(10) || string_agg(line, chr(10) ORDER BY rk, lot) AS text
FROM doc_lines GROUP BY portfolio_id, k, lay""",
)
cte(
    "st_rows",
    """SELECT file, n - 1 AS row_, list_transform(regexp_extract_all(',' || lines[n], ',("(?:[^"]|"")*"|[^,]*)', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS cells
FROM (SELECT file, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT file, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM docs))""",
)


def _any(words: str, role: str) -> str:
    return f"len(list_filter({words}, lambda w: regexp_matches(w, '{'|'.join(hld.WORDS[role])}'))) > 0"


_plain = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
cte(
    "st_flag",
    f"""SELECT *, len(words) >= 2 AND ({_any('words', 'ticker')} OR {_any('words', 'isin')}) AND ({_any('words', 'amount')} OR ({_any('words', 'qty')} AND {_any('words', 'price')})) AS hit
FROM (SELECT *, list_transform(list_filter(cells, lambda x: trim(x) <> ''), lambda x: {_plain('x')}) AS words FROM st_rows WHERE row_ < 60)""",
)
cte("st_head", "SELECT file, row_ AS header_row, cells FROM st_flag QUALIFY row_number() OVER (PARTITION BY file ORDER BY CAST(hit AS INT) DESC, row_) = 1")
cte(
    "st_filled",
    "SELECT file, header_row, j, CASE WHEN trim(c) = '' OR lower(trim(c)) = 'nan' THEN 'Unnamed: ' || (j - 1) ELSE trim(c) END AS nm FROM (SELECT file, header_row, unnest(cells) AS c, unnest(range(1, len(cells) + 1)) AS j FROM st_head)",
)
cte(
    "st_cols",
    f"SELECT *, {_plain('name')} AS w FROM (SELECT *, CASE WHEN k > 0 THEN nm || '.' || k ELSE nm END AS name FROM (SELECT *, row_number() OVER (PARTITION BY file, nm ORDER BY j) - 1 AS k FROM st_filled))",
)


def _role(role: str) -> str:
    words = ", ".join(f"'{w}'" for w in hld.WORDS[role])
    return f"CAST(coalesce(min(j) FILTER (w IN ({words})), min(j) FILTER (regexp_matches(w, '{'|'.join(hld.WORDS[role])}'))) AS INT) AS {role}_at"


cte("st_roles", f"SELECT file, any_value(header_row) AS header_row, {', '.join(_role(x) for x in hld.WORDS)} FROM st_cols GROUP BY file")


def _num(c: str) -> str:
    v = f"TRY_CAST(regexp_replace({c}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"
    return f"CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none', '-') AND {v} > 0 THEN {v} END"


def ticker_sql(c: str) -> str:
    s = f"upper(trim({c}))"
    t = f"split_part({s}, ' ', 1)"
    bare = f"CASE WHEN regexp_matches({t}, '-(EQ|BE|BZ)$') THEN regexp_replace({t}, '-(EQ|BE|BZ)$', '') WHEN {t} LIKE '%EQ' AND len({t}) > 2 THEN regexp_replace({t}, 'EQ$', '') ELSE {t} END"
    cut = f"regexp_replace({bare}, '[-_ ]+$', '')"
    return f"CASE WHEN {s} IN ('', 'NAN', 'NONE', '-') THEN NULL WHEN contains({s}, '.') OR {s} LIKE '^%' THEN {s} WHEN {cut} <> '' THEN {cut} || '.NS' END"


_isin_rows = ", ".join(f"('{i}', '{s}.NS')" for i, s in SYMBOLS)
cte(
    "st_parsed",
    f"""SELECT file, row_, basis, CASE WHEN isin_at IS NOT NULL THEN coalesce(symbol, CASE WHEN trim(c_ticker) <> '' AND NOT contains(trim(c_ticker), ' ') AND len(trim(c_ticker)) <= 12 THEN {ticker_sql('trim(c_ticker)')} END) ELSE {ticker_sql('c_ticker')} END AS ticker,
CASE basis WHEN 'current_value' THEN {_num('c_current')} WHEN 'generic_amount' THEN {_num('c_amount')} ELSE ({_num('c_qty')}) * ({_num('c_price')}) END AS amount, {_num('c_qty')} AS quantity,
CASE WHEN invested_at IS NOT NULL THEN {_num('c_invested')} WHEN basis = 'current_value' THEN ({_num('c_qty')}) * ({_num('c_price')}) END AS invested, trim(coalesce(c_ticker, c_isin)) AS label
FROM (SELECT s.file, s.row_, r.*, CASE WHEN current_at IS NOT NULL THEN 'current_value' WHEN amount_at IS NOT NULL THEN 'generic_amount' WHEN qty_at IS NOT NULL AND price_at IS NOT NULL THEN 'qty_x_avg_price' END AS basis,
 {', '.join(f'cells[{x}_at] AS c_{x}' for x in hld.WORDS)} FROM st_rows s JOIN st_roles r ON s.file = r.file WHERE s.row_ > r.header_row) p LEFT JOIN (VALUES {_isin_rows}) m(code, symbol) ON upper(trim(c_isin)) = code""",
)
cte("st_hold", "SELECT file, ticker, sum(amount) AS amount, sum(quantity) AS quantity, sum(invested) AS invested, any_value(basis) AS amount_basis FROM st_parsed WHERE amount IS NOT NULL AND ticker IS NOT NULL GROUP BY 1, 2")


@register("SRC5_statement_rows", "SELECT file, CAST(row_ AS BIGINT) AS row, array_to_string(cells, '|') AS cells FROM st_rows")
def _(spark, sf):
    return rows(spark, sf).select("file", big("row"), F.array_join("cells", "|").alias("cells"))


@register("SRC5_scanned_files", "SELECT file, CAST(row_ AS BIGINT) AS row, array_to_string(cells, '|') AS cells FROM st_rows")
def _(spark, sf):
    """The statements written as a text file each and scanned from the shared folder."""
    path = scratch(spark)
    documents(spark, sf).write.partitionBy("file").text(path)
    found = scan_statements(spark, path).withColumn("file", F.regexp_extract("file", "file=([^/]+)/", 1))
    return rows_of(found).select("file", big("row"), F.array_join("cells", "|").alias("cells"))


@register("HLD1_header_row", "SELECT file, CAST(header_row AS BIGINT) AS header_row FROM st_head")
def _(spark, sf):
    return hld.headers(rows(spark, sf), header_rows=60).select("file", big("header_row"))


@register("HLD2_column_names", "SELECT file, string_agg(name, '|' ORDER BY j) AS names FROM st_cols GROUP BY file")
def _(spark, sf):
    return hld.headers(rows(spark, sf)).select("file", F.array_join("names", "|").alias("names"))


@register("HLD3_column_roles", "SELECT file, " + ", ".join(f"CAST({x}_at AS BIGINT) AS {x}_at" for x in hld.WORDS) + " FROM st_roles")
def _(spark, sf):
    return hld.headers(rows(spark, sf)).select("file", *[big(f"{x}_at") for x in hld.WORDS])


cte("st_cells", "SELECT file, row_, unnest(cells) AS c, unnest(range(1, len(cells) + 1)) AS j FROM st_rows")


@register("HLD4_clean_amount", f"SELECT file, CAST(row_ AS BIGINT) AS row, CAST(j AS BIGINT) AS j, {r(_num('c'), 4, 'amount')} FROM st_cells")
def _(spark, sf):
    cells = rows(spark, sf).select("file", big("row"), F.posexplode("cells").alias("p", "c"))
    return cells.select("file", "row", big(F.col("p") + 1, "j"), rnd(hld.clean_amount(F.col("c")), 4, "amount"))


_typed = "replace(upper(trim(c)), ' ', '')"
_typed_cut = f"regexp_replace(regexp_replace({_typed}, '-(EQ|BE|BZ)$', ''), '[-_ ]+$', '')"


@register(
    "HLD5_clean_ticker",
    f"SELECT file, CAST(row_ AS BIGINT) AS row, CAST(j AS BIGINT) AS j, {ticker_sql('c')} AS ticker, CASE WHEN {_typed} = '' THEN NULL WHEN contains({_typed}, '.') OR {_typed} LIKE '^%' THEN {_typed} WHEN {_typed_cut} <> '' THEN {_typed_cut} || '.NS' END AS typed FROM st_cells",
)
def _(spark, sf):
    cells = rows(spark, sf).select("file", big("row"), F.posexplode("cells").alias("p", "c"))
    return cells.select("file", "row", big(F.col("p") + 1, "j"), hld.clean_ticker(F.col("c")).alias("ticker"), hld.typed_ticker(F.col("c")).alias("typed"))


@register("HLD6_resolved_rows", "SELECT file, CAST(row_ AS BIGINT) AS row, ticker, label FROM st_parsed")
def _(spark, sf):
    return hld.parsed(rows(spark, sf), dim.isins(spark)).select("file", big("row"), "ticker", "label")


@register("HLD7_amount_basis", f"SELECT file, CAST(row_ AS BIGINT) AS row, basis AS amount_basis, {r('amount', 4)} FROM st_parsed")
def _(spark, sf):
    return hld.parsed(rows(spark, sf), dim.isins(spark)).select("file", big("row"), "amount_basis", rnd("amount", 4))


@register("HLD8_holdings", f"SELECT file, ticker, amount_basis, {r('amount', 4)}, {r('quantity', 4)}, {r('invested', 4)} FROM st_hold")
def _(spark, sf):
    df = hld.holdings(rows(spark, sf), dim.isins(spark))
    return df.select("file", "ticker", "amount_basis", rnd("amount", 4), rnd("quantity", 4), rnd("invested", 4))


@register("HLD9_skipped_rows", "SELECT file, CAST(row_ AS BIGINT) AS row, label[1:48] AS label FROM st_parsed WHERE amount IS NOT NULL AND ticker IS NULL AND lower(label) NOT IN ('', 'nan', 'none')")
def _(spark, sf):
    return hld.skipped(rows(spark, sf), dim.isins(spark), label_chars=48).withColumn("row", big("row"))


@register("HLD9_unusable_files", "SELECT file, CASE WHEN ticker_at IS NULL AND isin_at IS NULL THEN 'no ticker or ISIN column' WHEN current_at IS NULL AND amount_at IS NULL AND (qty_at IS NULL OR price_at IS NULL) THEN 'no amount column' ELSE 'no valid rows' END AS reason FROM st_roles WHERE file NOT IN (SELECT file FROM st_hold)")
def _(spark, sf):
    return hld.unusable_files(rows(spark, sf), dim.isins(spark))


# Typed holdings: every statement line as if a user had typed it, with a comment and a repeat.
cte("typed", "SELECT file, n AS line_no, lines[n] AS line FROM (SELECT file, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT file, string_split('# mine' || chr(10) || text || chr(10) || 'TCS.NS, Rs 1,000' || chr(10) || 'TCS.NS , 2,500', chr(10)) AS lines FROM docs))")


@register(
    "HLD10_typed_holdings",
    f"""SELECT file, ticker, {r('max_by(amount, line_no)', 4, 'amount')} FROM (SELECT file, line_no, trim(split_part(trim(line), ',', 1)) AS ticker,
TRY_CAST(trim(replace(replace(replace(trim(substr(trim(line), strpos(trim(line), ',') + 1)), ',', ''), '₹', ''), 'Rs', '')) AS DOUBLE) AS amount FROM typed WHERE trim(line) <> '' AND NOT trim(line) LIKE '#%' AND contains(line, ',')) WHERE amount IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    text = F.concat(F.lit("# mine\n"), "text", F.lit("\nTCS.NS, Rs 1,000\nTCS.NS , 2,500"))
    lines = documents(spark, sf).select("file", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return hld.typed_lines(lines).select("file", "ticker", rnd("amount", 4))


# Candidate tables: a document is a region of ten customers, its tables are their statements.
cte("tab_hold", "SELECT 'doc_' || CAST(CAST(substr(file, 6) AS BIGINT) // 10 AS BIGINT) AS doc, CAST(substr(file, 6) AS BIGINT) % 10 AS table_no, ticker, amount, count(*) OVER (PARTITION BY file) AS n FROM st_hold")


@register(
    "HLD11_best_table",
    f"SELECT doc AS file, table_no, ticker, {r('amount', 4)} FROM (SELECT *, min(table_no) FILTER (n = top) OVER (PARTITION BY doc) AS pick FROM (SELECT *, max(n) OVER (PARTITION BY doc) AS top FROM tab_hold)) WHERE table_no = pick",
)
def _(spark, sf):
    k = F.substring("file", 6, 20).cast("bigint")
    tables = rows(spark, sf).select(
        F.concat(F.lit("doc_"), F.floor(k / 10).cast("string")).alias("file"), F.pmod(k, F.lit(10)).alias("table_no"), "row", "cells"
    )
    return hld.best_table(tables, dim.isins(spark)).select("file", big("table_no"), "ticker", rnd("amount", 4))


@register(
    "HLD12_instrument_search",
    """SELECT query, place, ticker, name FROM (SELECT query, ticker, name, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN starts_with(pl, query) OR starts_with(upper(name), query) THEN 0 ELSE 1 END, name, ticker) AS place
FROM (SELECT 'P' || p_partkey || '.NS' AS ticker, 'P' || p_partkey AS pl, p_name AS name FROM part) JOIN (SELECT DISTINCT upper(trim(q)) AS query FROM (SELECT p_type AS q FROM part UNION ALL SELECT substr(p_name, 3, 5) FROM part UNION ALL SELECT substr(p_name, 1, 2) FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part)) ON query <> '' AND (contains(pl, query) OR contains(upper(name), query))) WHERE place <= 50""",
)
def _(spark, sf):
    part = panels.table(spark, sf, "part")
    names = part.select(F.concat(F.lit("P"), "p_partkey", F.lit(".NS")).alias("ticker"), F.col("p_name").alias("name"))
    asked = part.select(F.explode(F.array("p_type", F.substring("p_name", 3, 5), F.substring("p_name", 1, 2), F.col("p_size").cast("string"))).alias("query"))
    return hld.search(names, asked).withColumn("place", big("place"))
