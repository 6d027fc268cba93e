"""Queries of symbols, code tokens, sections and the controller rules, over code that the driver's tables are turned into.

A part is a source file or controller file, an order a controller program, a line item an import, a call or a line of
code. Rule cases list what a text says and which rules it breaks; SQL knows the rules of each case only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import request_label
from ..operators import clones, flow, guidelines, plc_pack, symbols
from ..shared import materialize, ship

#: Lines of controller code, each with the rule that it breaks by itself.
LINE_CASES = [
    ("a := %I0.1;", "PLC-001", "warning"), ("b := 123456;", "PLC-003", "warning"), ("c := INT_TO_REAL(d);", "PLC-005", "info"), ("e := f / g;", "PLC-006", "error"), ("h := CONCAT(k, m);", "PLC-010", "warning"), ("n := REAL#1.0 = p;", "PLC-011", "warning"), ("GOTO done;", "PLC-020", "warning"),
    ("ELSE ;", "PLC-021", "info"), ("EXIT;", "PLC-022", "info"), ("// GOTO done 123456", None, None), ("q := r;", None, None), ("s := list[at];", "PLC-004", "warning"), ("p^ := u;", "PLC-012", "error"), ("o_lamp := TRUE;", "PLC-007", "warning"),
]
#: Controller files, each with (rule, severity, line) of all that they break.
FILE_CASES = [
    ("VAR_INPUT\n  Speed : REAL;\nEND_VAR", [("PLC-013", "info", 0), ("PLC-014", "info", 0), ("PLC-016", "info", 0), ("PLC-017", "warning", 0)]),
    ("VAR_INPUT\n  i_t : INT := 5;\nEND_VAR\nIF i_t > 3 THEN\nEND_IF;", [("PLC-016", "info", 0)]),
    ("VAR_OUTPUT\n  o_m : BOOL;\nEND_VAR", [("PLC-009", "error", 0), ("PLC-016", "info", 0), ("PLC-019", "warning", 0)]),
    ("VAR_OUTPUT\n  Motor : BOOL := FALSE;\nEND_VAR\nEStop := x;", [("PLC-013", "info", 0), ("PLC-016", "info", 0)]),
    ("VAR\n  g_x : INT := 1;\n  used : INT := 1;\nEND_VAR\nused := used + 1;", [("PLC-013", "info", 0), ("PLC-024", "info", 0)]),
    ("PROGRAM Main\n  RETURN;\nEND_PROGRAM", [("PLC-002", "warning", 0), ("PLC-025", "warning", 2)]),
    ("FUNCTION_BLOCK F\nTON(x);\nEND_FUNCTION_BLOCK", []),
    ("MODBUS.x := y;", [("PLC-018", "error", 0)]),
    ("MODBUS.x := T#5;", []),
    ("IF a THEN\nIF b THEN\nIF c THEN\nIF d THEN\nIF e THEN\nEND_IF;\nEND_IF;\nEND_IF;\nEND_IF;\nEND_IF;", [("PLC-023", "warning", 5)]),
    ("", []),
]
#: Code with a place for a number, and its normalised tokens.
TOKEN_CASES = [
    ("if (v{0} === {0}.5) /* c{0} */ call{0}('s{0}'); // end {0}", "if ( p1 == = NUM_ ) p2 ( STR_ ) ;"),
    ("const a{0} = b{0} + a{0};\nreturn a{0} * 2;", "const p1 = p2 + p1 ; return p1 * NUM_ ;"),
    ("while (p{0}) { p{0} = next{0}(p{0}, 'a{0}'); }", "while ( p1 ) { p1 = p2 ( p1 , STR_ ) ; }"),
]

#: Requests and their labels.
REQUEST_CASES = [
    ("what models are available?", "config"), ("show the budget", "config"), ("切换模型", "config"), ("set url", "config"), ("a fine model", "capability"), ("remove duplicate code", "dedup"), ("有没有冗余", "dedup"), ("scan the repo", "audit"), ("帮我审计一下", "audit"), ("look at my last commit", "review"), ("please read ./src/a.py", "review"), ("good morning", "capability"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, at: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[at.cast("int")]


def _quoted(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def plc_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a controller file with a line of code per item."""
    items = _table(spark, sf_dir, "lineitem")
    lines = items.select(F.col("l_orderkey").alias("path"), F.struct("l_linenumber", "l_partkey", _pick([c[0] for c in LINE_CASES], F.col("l_partkey") % len(LINE_CASES)).alias("text")).alias("x"))
    files = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n").alias("content"))  # an order has a handful of items
    return plc_pack.scan_plc(files).select("path", "rule_id", "severity", F.coalesce("line_no", F.lit(0)).alias("line_no"))


PLC_LINE_SQL = f"""WITH l AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INT AS line_no, (l_partkey % {len(LINE_CASES)})::INT + 1 AS k FROM lineitem),
    v AS (SELECT path, {_quoted(c[1] for c in LINE_CASES)}[k] AS rule_id, {_quoted(c[2] for c in LINE_CASES)}[k] AS severity, line_no FROM l),
    o AS (SELECT path, line_no, lead(line_no) OVER (PARTITION BY path ORDER BY line_no) AS n FROM v WHERE rule_id = 'PLC-007')
    SELECT path, rule_id, severity, CASE WHEN rule_id = 'PLC-007' THEN 0 ELSE line_no END AS line_no FROM v WHERE rule_id IS NOT NULL
    UNION ALL SELECT path, 'PLC-008', 'error', line_no FROM o WHERE n - line_no < 3"""


def plc_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a controller file with declarations, blocks or nested statements."""
    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), _pick([c[0] for c in FILE_CASES], F.col("p_partkey") % len(FILE_CASES)).alias("content"))
    return plc_pack.scan_plc(files).select("path", "rule_id", "severity", F.coalesce("line_no", F.lit(0)).alias("line_no"))


PLC_FILE_SQL = "WITH c(k, rule_id, severity, line_no) AS (VALUES " + ", ".join(f"({k}, '{r}', '{s}', {n})" for k, (_, found) in enumerate(FILE_CASES) for r, s, n in found) + f") SELECT p_partkey AS path, rule_id, severity, line_no::INT AS line_no FROM part JOIN c ON p_partkey % {len(FILE_CASES)} = k"


def plc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the parts' controller files as findings, by severity and category."""
    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), _pick([c[0] for c in FILE_CASES], F.col("p_partkey") % len(FILE_CASES)).alias("content"))
    return plc_pack.violations_to_findings(plc_pack.scan_plc(files)).groupBy("severity", "category").agg(F.count("*").alias("n"), F.min("line_start").alias("first_line"))


_SECURITY, _BUG = "'PLC-002', 'PLC-007', 'PLC-009', 'PLC-017', 'PLC-018', 'PLC-019'", "'PLC-006', 'PLC-008', 'PLC-012'"
PLC_FINDINGS_SQL = f"SELECT severity, CASE WHEN rule_id IN ({_SECURITY}) THEN 'security' WHEN rule_id IN ({_BUG}) THEN 'potential_bug' ELSE 'convention' END AS category, count(*) AS n, min(CASE WHEN line_no = 0 THEN 1 ELSE line_no END)::INT AS first_line FROM ({PLC_FILE_SQL}) t GROUP BY ALL"


def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised tokens of code that each part's number stands in: names and literals differ, structures do not."""
    parts = _table(spark, sf_dir, "part")
    body = F.replace(_pick([c[0] for c in TOKEN_CASES], F.col("p_partkey") % len(TOKEN_CASES)), F.lit("{0}"), F.col("p_partkey").cast("string"))
    none = F.lit(None).cast("string")
    functions = parts.select(F.lit("a.js").alias("path"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), none.alias("enclosing_class"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), body.alias("body"))
    return clones.fingerprint_functions(functions).select("id", F.col("n_tokens").cast("long").alias("n_tokens"), "structural_hash", F.size("shingles").cast("long").alias("n_shingles"))


_TOKENS = _quoted(c[1] for c in TOKEN_CASES)
CODE_TOKENS_SQL = f"""WITH t AS (SELECT 'a.js::f' || p_partkey AS id, {_TOKENS}[p_partkey % {len(TOKEN_CASES)} + 1] AS s FROM part),
    w AS (SELECT id, s, string_split(s, ' ') AS w FROM t)
    SELECT id, len(w)::BIGINT AS n_tokens, sha256(s) AS structural_hash, (len(w) - 4)::BIGINT AS n_shingles FROM w"""


def _files(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.lit("r").alias("repo"), F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"))


def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item is an import of its supplier's module, spelt in five ways."""
    s, n = F.col("l_suppkey").cast("string"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    ways = F.array(F.concat(F.lit("./m"), s), F.concat(F.lit("/src/m"), s), F.lit("react"), F.concat(F.lit("../src/./m"), s, F.lit(".js")), F.concat(F.lit("./gone"), s))
    imports = _table(spark, sf_dir, "lineitem").select(F.lit("r").alias("repo"), F.concat(F.lit("src/m"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("path"), n.alias("line"), ways[(n % 5).cast("int")].alias("source"))
    return symbols.resolve_imports(imports, _files(spark, sf_dir)).select("path", "line", "source", "resolved", "is_external")


IMPORTS_SQL = """WITH i AS (SELECT 'src/m' || l_partkey || '.ts' AS path, l_orderkey * 10 + l_linenumber AS line, l_suppkey AS s FROM lineitem)
    SELECT DISTINCT path, line, ['./m' || s, '/src/m' || s, 'react', '../src/./m' || s || '.js', './gone' || s][line % 5 + 1] AS source,
      CASE WHEN line % 5 IN (0, 1, 3) AND s IN (SELECT p_partkey FROM part) THEN 'src/m' || s || '.ts' END AS resolved, line % 5 = 2 AS is_external FROM i"""


def _resolved_calls(spark, sf_dir) -> DataFrame:
    """A part's file holds the function f<number>, exported for even numbers; items call by four kinds of names."""
    text = lambda c: F.col(c).cast("string")
    name = lambda c: F.concat(F.lit("src/m"), text(c), F.lit(".ts"))
    parts, items = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "lineitem").withColumns({"line": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "twice": F.col("l_suppkey") * 2})
    functions = parts.select(F.lit("r").alias("repo"), name("p_partkey").alias("path"), F.concat(F.lit("f"), text("p_partkey")).alias("name"), F.lit(1).alias("line_start"))
    exports = parts.filter("p_partkey % 2 = 0").select(F.lit("r").alias("repo"), name("p_partkey").alias("path"), F.lit(1).alias("line"), F.array(F.concat(F.lit("f"), text("p_partkey"))).alias("exported_names"), F.lit(False).alias("is_default"))
    imports = items.filter("line % 4 = 1").select(F.lit("r").alias("repo"), name("l_partkey").alias("path"), "line", F.concat(F.lit("./m"), text("l_suppkey")).alias("source"), F.array(F.concat(F.lit("f"), text("l_suppkey"))).alias("imported_names"), F.lit(None).cast("string").alias("default_name"))
    callee = F.array(*[F.concat(F.lit("f"), text(c)) for c in ("l_partkey", "l_suppkey", "twice")], F.lit("zz"))[(F.col("line") % 4).cast("int")]
    calls = items.select(F.lit("r").alias("repo"), name("l_partkey").alias("path"), "line", callee.alias("callee_name"), F.lit(None).cast("string").alias("receiver"))
    return symbols.resolve_calls(calls, functions, imports, symbols.resolve_imports(imports, functions), exports)


def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved_calls(spark, sf_dir).select("path", "line", "callee_name", "tier", "target")


def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.call_stats(_resolved_calls(spark, sf_dir))


_CALLS = """i AS (SELECT l_partkey AS p, l_suppkey AS s, l_orderkey * 10 + l_linenumber AS line FROM lineitem),
    m AS (SELECT DISTINCT p, s FROM i WHERE line % 4 = 1 AND s IN (SELECT p_partkey FROM part)),
    c AS (SELECT p, line, CASE line % 4 WHEN 0 THEN p WHEN 1 THEN s WHEN 2 THEN 2 * s END AS k FROM i),
    t AS (SELECT c.p, line, k, CASE WHEN k = c.p AND k IN (SELECT p_partkey FROM part) THEN 1 WHEN m.s IS NOT NULL THEN 2 WHEN k % 2 = 0 AND k IN (SELECT p_partkey FROM part) THEN 3 END AS tier FROM c LEFT JOIN m ON m.p = c.p AND m.s = c.k)"""
CALLS_SQL = f"WITH {_CALLS} SELECT 'src/m' || p || '.ts' AS path, line, coalesce('f' || k, 'zz') AS callee_name, tier::INT AS tier, CASE WHEN tier IS NOT NULL THEN 'src/m' || k || '.ts::f' || k || '@1' END AS target FROM t"
CALL_STATS_SQL = f"WITH {_CALLS} SELECT count(*) AS calls, count(tier) AS resolved, count(*) FILTER (tier = 1) AS same_file, count(*) FILTER (tier = 2) AS imported, count(*) FILTER (tier = 3) AS exported FROM t"


def guideline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a document, each turn a section of it."""
    c = _table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.translate("text", "#\n\r\t", "    "))
    docs = c.groupBy(F.col("conv_id").cast("string").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("content"))
    return guidelines.split_sections(docs).select("source", "section_index", "section_title", F.sha2("text", 256).alias("sha256"))


SECTIONS_SQL = "SELECT conv_id::VARCHAR AS source, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS section_index, role || ' ' || turn AS section_title, sha256(trim(translate(text, '#' || chr(10) || chr(13) || chr(9), '    '))) AS sha256 FROM conversations"

def _order_calls(spark, sf_dir) -> DataFrame:
    """Orders as functions, their items as calls: some have none, some one."""
    functions = _table(spark, sf_dir, "orders").select(F.lit("r").alias("repo"), F.col("o_custkey").alias("path"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.lit(1).alias("line_start"), (F.col("o_orderkey") % 2 == 0).alias("is_exported"), "o_orderkey")
    calls = _table(spark, sf_dir, "lineitem").join(functions, F.col("l_orderkey") == F.col("o_orderkey")).select("repo", F.concat(F.col("path").cast("string"), F.lit("::"), "name", F.lit("@1")).alias("target"))
    return symbols.call_counts(functions, calls)


def uncalled_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.uncalled(_order_calls(spark, sf_dir)).select("o_orderkey", "is_exported")


def single_call_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.single_call(_order_calls(spark, sf_dir)).select("o_orderkey")


UNCALLED_SQL = "SELECT o_orderkey, false AS is_exported FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
SINGLE_SQL = "SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(*) = 1"


def request_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in two languages, one per event, by label."""
    events = _table(spark, sf_dir, "events")
    text = F.concat(_pick([c[0] for c in REQUEST_CASES], F.col("event_id") % len(REQUEST_CASES)), F.lit(" "), F.col("event_id").cast("string"))
    return events.select("event_id", request_label(text).alias("label"))


REQUEST_SQL = f"SELECT event_id, {_quoted(c[1] for c in REQUEST_CASES)}[event_id % {len(REQUEST_CASES)} + 1] AS label FROM events"


def _programs(spark, sf_dir) -> DataFrame:
    """A program for each document, of 2 to 12 sections: a label, an assignment, and GOTO, RETURN, EXIT or nothing."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("n"), (F.lit(2) + (F.col("doc_id") + F.col("n_chars")) % 11).alias("cnt"))
    own = docs.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int")))).withColumn("x", F.expr("(path * 31 + i * i * 17 + n * 7) % 1009"))
    text = lambda c: F.expr(f"cast({c} as string)")
    jump = F.concat(F.lit("GOTO L"), text("x div 5 % cnt + 1"), F.lit(";\n"))
    part = F.concat(F.lit("L"), text("i"), F.lit(": ;\nv"), text("x % 7"), F.lit(" := v"), text("x div 7 % 7"), F.lit(" + 1;\n"), F.when(F.col("x") % 5 == 0, jump).when(F.col("x") % 5 == 1, "RETURN;\n").when(F.col("x") % 5 == 2, "EXIT;\n").otherwise(""))
    whole = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", part.alias("part")))).alias("parts"))  # a dozen parts
    return whole.select("path", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("content"))


def _flow(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    stmts = materialize(flow.statements(_programs(spark, sf_dir)), "statements")
    return stmts, materialize(flow.cfg_edges(stmts), "edges")


def flow_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of each document's program, with their blocks."""
    return flow.statements(_programs(spark, sf_dir)).select("path", "stmt_id", "block_id", "line_no", "text")


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir)[1].select("path", "src", "dst", "edge_type")


def flow_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmts, edges = _flow(spark, sf_dir)
    return flow.unreachable(flow.blocks_of(stmts), edges)


def def_use_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.def_use_pairs(*_flow(spark, sf_dir)).select("path", "var", "use_id", "def_id")


def dead_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.dead_stores(*_flow(spark, sf_dir)).select("path", "stmt_id", "line_no", "var")


def endless_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.endless_loops(*_flow(spark, sf_dir)).select("path", "header", "tail")


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each document, of 2 to 12 functions of 1 to 4 lines: their names and spans."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("n"), (F.lit(2) + (F.col("doc_id") + F.col("n_chars")) % 11).alias("cnt"))
    own = docs.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int")))).withColumn("k", F.expr("cast(1 + (path * 31 + i * i * 17 + n * 7) % 1009 % 4 as int)"))
    part = F.concat(F.lit("def f"), F.col("i").cast("string"), F.lit("(x):\n"), F.repeat(F.lit("    a = 1\n"), F.col("k")), F.lit("\n"))
    whole = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", part.alias("part")))).alias("parts"))  # a dozen parts
    files = whole.select(F.lit("r").alias("repo"), F.col("path").cast("string").alias("path"), F.lit("python").alias("language"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("content"))
    return symbols.extract_declarations(files).select("path", "kind", "name", "line_start", "line_end")


DECLARATIONS_SQL = """WITH d AS (SELECT doc_id AS path, n_chars AS n, 2 + (doc_id + n_chars) % 11 AS cnt FROM documents),
    x AS (SELECT path, cnt, i, 1 + (path * 31 + i * i * 17 + n * 7) % 1009 % 4 AS k FROM d, unnest(range(1, cnt + 1)) AS r(i)),
    s AS (SELECT *, 1 + coalesce(sum(k + 2) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM x)
    SELECT path::VARCHAR AS path, 'function' AS kind, 'f' || i AS name, a::INT AS line_start, (a + k + CASE WHEN i < cnt THEN 1 ELSE 0 END)::INT AS line_end FROM s"""


# Sections with a jump, return or exit (k < 3) make two blocks, others go on in the one they are in; a block leads to one other at most.
_PROGRAM = """d AS (SELECT doc_id AS path, n_chars AS n, 2 + (doc_id + n_chars) % 11 AS cnt FROM documents),
    x AS (SELECT path, cnt, i, (path * 31 + i * i * 17 + n * 7) % 1009 AS x FROM d, unnest(range(1, cnt + 1)) AS r(i)),
    s AS (SELECT path, cnt, i, x % 5 AS k, x // 5 % cnt + 1 AS m, x % 7 AS a, x // 7 % 7 AS b, coalesce(count(*) FILTER (x % 5 < 3) OVER w, 0) AS c, count(*) FILTER (x % 5 < 3) OVER (PARTITION BY path) AS total FROM x WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    st AS (SELECT path, 2 * (i - 1) + c AS stmt_id, 2 * c AS block_id, 'L' || i || ': ;' AS text, NULL AS def, NULL AS use FROM s
      UNION ALL SELECT path, 2 * i - 1 + c, 2 * c, 'v' || a || ' := v' || b || ' + 1;', 'v' || a, CASE WHEN a <> b THEN 'v' || b END FROM s
      UNION ALL SELECT path, 2 * i + c, 2 * c + 1, CASE k WHEN 0 THEN 'GOTO L' || m || ';' WHEN 1 THEN 'RETURN;' ELSE 'EXIT;' END, NULL, NULL FROM s WHERE k < 3),
    nb AS (SELECT path, max(block_id) + 1 AS blocks FROM st GROUP BY path),
    e AS (SELECT path, src, dst, edge_type FROM (
      SELECT DISTINCT path, 2 * c AS src, 2 * c + 1 AS dst, 'fall_through' AS edge_type FROM s
      UNION ALL SELECT path, 2 * c + 1, 2 * c + 2, 'fall_through' FROM s WHERE k = 2
      UNION ALL SELECT f.path, 2 * f.c + 1, 2 * t.c, 'unconditional' FROM s f JOIN s t ON t.path = f.path AND t.i = f.m WHERE f.k = 0) JOIN nb USING (path) WHERE dst < blocks)"""
_REACHED = "reached AS (SELECT path, 0 AS node, 0 AS step FROM nb UNION ALL SELECT r.path, e.dst, r.step + 1 FROM reached r JOIN e ON e.path = r.path AND e.src = r.node WHERE r.step < 40), seen AS (SELECT path, node, min(step) AS step FROM reached GROUP BY ALL)"
_PAIRS = """df AS (SELECT path, block_id, def AS var, max(stmt_id) AS def_id FROM st WHERE def IS NOT NULL GROUP BY ALL),
    pr AS (SELECT e.path, e.dst AS block_id, var, arg_min(def_id, src) AS def_id FROM e JOIN df ON df.path = e.path AND df.block_id = e.src GROUP BY ALL),
    du AS (SELECT st.path, st.use AS var, st.stmt_id AS use_id, coalesce(df.def_id, pr.def_id) AS def_id FROM st LEFT JOIN df ON df.path = st.path AND df.block_id = st.block_id AND df.var = st.use
      LEFT JOIN pr ON pr.path = st.path AND pr.block_id = st.block_id AND pr.var = st.use WHERE st.use IS NOT NULL AND coalesce(df.def_id, pr.def_id) IS NOT NULL)"""
FLOW_SQL = {
    "flow_statements": f"WITH {_PROGRAM} SELECT path, stmt_id::INT AS stmt_id, block_id::INT AS block_id, (stmt_id + 1)::INT AS line_no, text FROM st",
    "flow_edges": f"WITH {_PROGRAM} SELECT path, src::INT AS src, dst::INT AS dst, edge_type FROM e",
    "flow_unreachable": f"WITH RECURSIVE {_PROGRAM}, {_REACHED} SELECT path, block_id::INT AS node FROM (SELECT DISTINCT path, block_id FROM st) b ANTI JOIN seen ON seen.path = b.path AND seen.node = b.block_id",
    "def_use_pairs": f"WITH {_PROGRAM}, {_PAIRS} SELECT path, var, use_id::INT AS use_id, def_id::INT AS def_id FROM du",
    "dead_stores": f"WITH {_PROGRAM}, {_PAIRS} SELECT path, stmt_id::INT AS stmt_id, (stmt_id + 1)::INT AS line_no, def AS var FROM st ANTI JOIN du ON du.path = st.path AND du.var = st.def WHERE def IS NOT NULL",
    # the way from the first block ends in at most one loop; its body is what comes to the tail without the header
    "endless_loops": f"""WITH RECURSIVE {_PROGRAM}, {_REACHED}, tail AS (SELECT path, arg_max(node, step) AS tail FROM seen GROUP BY path),
    loop AS (SELECT e.path, e.dst AS header, tail FROM tail JOIN e ON e.path = tail.path AND e.src = tail),
    body AS (SELECT path, header, tail, tail AS node FROM loop UNION SELECT b.path, b.header, b.tail, e.src FROM body b JOIN e ON e.path = b.path AND e.dst = b.node WHERE b.node <> b.header)
    SELECT path, header::INT AS header, tail::INT AS tail FROM loop WHERE NOT EXISTS (SELECT 1 FROM body b JOIN st ON st.path = b.path AND st.block_id = b.node WHERE b.path = loop.path AND st.text = 'EXIT;')
      AND NOT EXISTS (SELECT 1 FROM st WHERE st.path = loop.path AND st.block_id = loop.header AND st.text = 'EXIT;')""",
}

QUERIES = {f.__name__: f for f in (plc_line_rules, plc_file_rules, plc_findings, code_tokens, resolve_imports, resolve_calls, call_stats, guideline_sections, uncalled_functions, single_call_functions, request_cases, declarations, flow_statements, flow_edges, flow_unreachable, def_use_pairs, dead_stores, endless_loops)}
ORACLE_SQL = {"declarations": DECLARATIONS_SQL, "plc_line_rules": PLC_LINE_SQL, "plc_file_rules": PLC_FILE_SQL, "plc_findings": PLC_FINDINGS_SQL, "code_tokens": CODE_TOKENS_SQL, "resolve_imports": IMPORTS_SQL, "resolve_calls": CALLS_SQL, "call_stats": CALL_STATS_SQL, "guideline_sections": SECTIONS_SQL, "uncalled_functions": UNCALLED_SQL, "single_call_functions": SINGLE_SQL, "request_cases": REQUEST_SQL} | FLOW_SQL
