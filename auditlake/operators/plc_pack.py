"""The built-in rule pack for industrial-controller code and the hardware audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..shared import materialize
from . import rules as R
from .findings import evidence

#: Line rules (id, name, severity, pattern, description, suggestion).
LINE_RULES = [
    ("PLC-001", "Direct I/O address in program body", "warning", r"(?i)(?<!\w)(%?[IQM]\d+\.\d+|%(?:I|Q|M|DB)\d+)\b", "Direct I/O addresses reduce portability.", "Define symbolic names for I/O."),
    ("PLC-003", "Hardcoded magic number", "warning", r"(?<![A-Za-z0-9_.])(?:0x[0-9A-Fa-f]{4,}|\d{5,})(?![A-Za-z0-9_.])", "Large numeric literals are hard to maintain.", "Define named constants."),
    ("PLC-005", "Unsafe type conversion", "info", r"(?i)\b(?:INT_TO_|REAL_TO_|DWORD_TO_|WORD_TO_|DINT_TO_|SINT_TO_|UINT_TO_|UDINT_TO_)(?:REAL|INT|DINT|SINT|WORD|DWORD|BOOL|BYTE)\b", "Explicit conversions may lose data.", "Check the range first."),
    ("PLC-006", "Division without zero check", "error", r"(?i)(?<![/'\"\w])\b\w+\s*/\s*\w+\b(?!['\"])", "Division must check for a zero divisor.", "Test the divisor first."),
    ("PLC-010", "Unsafe string operation", "warning", r"(?i)\b(?:CONCAT|INSERT|DELETE|REPLACE|LEFT|RIGHT|MID|FIND)\s*\(", "String operations can exceed the target's length.", "Check lengths first."),
    ("PLC-011", "Floating point equality comparison", "warning", r"(?:REAL|LREAL)\s*[^<>!]*=\s*[^=]", "Equality of floating-point values is unreliable.", "Compare within a range."),
    ("PLC-020", "GOTO statement usage", "warning", r"(?i)\bGOTO\s+\w+", "GOTO statements are discouraged.", "Use IF or CASE."),
    ("PLC-021", "Empty control block branch", "info", r"(?i)(?:ELSE|CASE\s+\w+:)\s*;", "An empty branch may be incomplete logic.", "Explain or fill the branch."),
    ("PLC-022", "EXIT statement in loop", "info", r"(?i)\bEXIT\b", "EXIT makes loops hard to predict.", "Restructure the loop condition."),
]
NUMERIC, SENSORS = ["REAL", "LREAL", "INT", "DINT", "SINT", "UINT", "UDINT"], ["REAL", "LREAL", "INT", "DINT"]
#: Categories of rules; all others are convention.
CATEGORY = {
    "PLC-002": "security", "PLC-007": "security", "PLC-009": "security", "PLC-017": "security", "PLC-018": "security", "PLC-019": "security",
    "HW-001": "security", "HW-002": "security", "HW-005": "security", "HW-006": "security", "HW-007": "security", "HW-008": "security",
    "HW-009": "security", "PLC-006": "potential_bug", "PLC-008": "potential_bug", "PLC-012": "potential_bug", "CFG-001": "potential_bug",
    "CFG-002": "potential_bug", "CFG-003": "potential_bug", "CFG-004": "redundancy", "CFG-005": "readability",
}


def _violation(df: DataFrame, rule: str, name: str, severity: str, text: Column | str, line: Column | None = None) -> DataFrame:
    line = F.lit(None).cast("int") if line is None else line.cast("int")
    return df.select("path", line.alias("line_no"), F.lit(rule).alias("rule_id"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), (F.lit(text) if isinstance(text, str) else text).alias("description"))


def _like(pattern: str) -> Column:
    return F.bool_or(F.regexp_like("text", F.lit(pattern)))


def scan_plc(files: DataFrame) -> DataFrame:
    """All violations of ``files(path, content)``: ``path, line_no, rule_id, name, severity, description``, each once.

    More than twenty rules read the files, so they are stored: whatever makes them is done once.
    """
    files = materialize(files.select("path", "content"), "plc-files")
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")
    variables, blocks = R.st_vars(files), R.st_blocks(lines)
    out = [R.scan_rules(lines, LINE_RULES).select("path", "line_no", "rule_id", "name", "severity", "description")]
    line = F.col("line_no")
    # look-back and look-around
    pointer = R.guarded_hits(lines, F.contains("text", F.lit("^")) & F.contains("text", F.lit(":=")), r"(?i)<>?\s*NIL|<>?\s*0|IS_NOT_NULL", 5)
    out.append(_violation(pointer, "PLC-012", "Pointer dereference without nil check", "error", "Pointer dereference without null check.", line))
    program = R.in_block(lines, r"(?i)^\s*PROGRAM\b", r"(?i)^\s*END_PROGRAM\b").filter("inside").filter(~R.is_comment() & F.regexp_like("text", F.lit(r"(?i)\bRETURN\b")))
    out.append(_violation(program, "PLC-025", "RETURN in PROGRAM block", "warning", "RETURN in a PROGRAM block ends the cycle.", line))
    arrays = R.with_context(lines, 5, 5, of=~R.is_comment() & F.regexp_like("text", F.lit(r"\w\[\w+\]"))).withColumn("access", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+\[\w+\])"), F.lit(1))))
    arrays = arrays.select("path", "line_no", "context", F.regexp_extract("access", r"(\w+)\[", 1).alias("a"), F.regexp_extract("access", r"\[(\w+)\]", 1).alias("x"))
    arrays = arrays.filter(~F.regexp_like("x", F.lit(r"^\d+$")) & ~((F.upper("x") == F.col("x")) & F.regexp_like("x", F.lit("[A-Z]"))))
    bounds = F.regexp_like("context", F.concat(F.lit(r"(?i)(?:UPPER_BOUND|LOWER_BOUND|LEN|SIZEOF)\s*\(\s*"), "a", F.lit(r"\s*\)")))
    ranged = F.regexp_like("context", F.concat(F.lit("(?i)"), "x", F.lit(r"\s*(?:<=|<|>=|>)\s*\d+")))
    out.append(_violation(arrays.filter(~bounds & ~ranged), "PLC-004", "Array access without bounds check", "warning", F.concat(F.lit("Array '"), "a", F.lit("["), "x", F.lit("]' is read or written at a place that nothing checks.")), line))
    writes = R.guarded_hits(lines, F.regexp_like(F.trim("text"), F.lit(r"(?i)(?:o_|out_|O_)\w+\s*:=\s*TRUE|SET\s*\(")), r"(?i)\b(?:AND|IF)\b.*(?:NOT|EMERGENCY|ESTOP|E_STOP|SAFETY|FAULT|ALARM|LIMIT|OVERLOAD)|NOT\s+(?:o_|out_)?(?:Stop|Emergency|Fault)", 10)
    out.append(_violation(writes, "PLC-007", "Output write without interlock", "warning", F.concat(F.lit("The output of line "), line.cast("string"), F.lit(" is set and no interlock stands near it."))))
    assigned = lines.filter(~R.is_comment()).withColumn("var", F.regexp_extract(F.trim("text"), r"^(\w+)\s*:=\s*.+?;", 1)).filter(F.regexp_like("var", F.lit(r"^(?:o_|out_|O_)")) | F.regexp_like("var", F.lit(r"^[^a-z]*[A-Z][^a-z]*$")))
    races = R.close_rewrites(assigned)
    out.append(_violation(races, "PLC-008", "Potential race condition in output assignment", "error", F.concat(F.lit("Output '"), "var", F.lit("' is written on lines "), line.cast("string"), F.lit(" and "), F.col("next_line").cast("string"), F.lit(".")), line))
    depth = R.nesting_depth(lines, r"(?i)^\s*(?:IF|FOR|WHILE|REPEAT|CASE)\b", r"(?i)^\s*END_(?:IF|FOR|WHILE|REPEAT|CASE)").groupBy("path").agg(F.max("depth").alias("d"), F.min_by("line_no", F.struct(-F.col("depth"), "line_no")).alias("line_no")).filter("d > 4")
    out.append(_violation(depth, "PLC-023", "Nesting depth exceeds 4 levels", "warning", F.concat(F.lit("Code nesting reaches "), F.col("d").cast("string"), F.lit(" levels.")), line))
    # whole files
    facts = lines.groupBy("path").agg(_like(r"(?i)\bPROGRAM\b").alias("program"), _like(r"(?i)\b(?:TON|TOF|TP|TON_X|TOF_X|TP_X)\s*\(").alias("timer"), _like(r"(?i)\b(?:CYCLE_TIME|WATCHDOG|OB_CYCLE|CycleTime)\b").alias("cycle"), _like(r"(?i)\b(?:Emergency|E_Stop|EStop|NOTRHALT|NotAus|SafeTorqueOff|STO|SafetyOff|SAFE_STATE)\b").alias("estop"), _like(r"(?i)\b(?:SEND|RECEIVE|MODBUS|PROFINET|ETHERNET|SOCKET|TCP|UDP|MB_CLIENT|MB_SERVER)\b").alias("comm"), _like(r"(?i)\b(?:TIMEOUT|T#\d|TIME#|HEARTBEAT|ALIVE|WatchDog)\b").alias("alive"), _like(r"(?i)(?:LIMIT|CLAMP|MIN|MAX)\s*\(").alias("limits"))
    has_blocks = blocks.select("path").distinct().withColumn("has_blocks", F.lit(True))
    cyclic = facts.join(has_blocks, "path", "left").filter("coalesce(has_blocks, false) or program").filter("not timer and not cycle")
    out.append(_violation(cyclic, "PLC-002", "Missing watchdog timer", "warning", "Nothing here watches how long a cycle takes."))
    actuators = variables.filter((F.col("scope") == "VAR_OUTPUT") & (F.upper("datatype") == "BOOL")).select("path").distinct()
    out.append(_violation(facts.join(actuators, "path", "left_semi").filter("not estop"), "PLC-009", "Missing emergency stop handling", "error", "BOOL outputs are driven and no emergency stop is read."))
    out.append(_violation(facts.filter("comm and not alive"), "PLC-018", "Communication without timeout handling", "error", "Communication without timeout or heartbeat monitoring."))
    # variables and blocks
    name, scope, kind = F.col("name"), F.col("scope"), F.upper("datatype")
    bad_in = (scope == "VAR_INPUT") & ~F.regexp_like("name", F.lit("^(?:i_|in_|I_)"))
    bad_out = (scope == "VAR_OUTPUT") & ~F.regexp_like("name", F.lit("^(?:o_|out_|O_)"))
    bad_own = (scope == "VAR") & F.regexp_like("name", F.lit("^(?:i_|o_|g_)"))
    out.append(_violation(variables.filter(bad_in | bad_out | bad_own), "PLC-013", "Variable prefix", "info", F.concat(F.lit("Prefix of "), "scope", F.lit(" variable '"), name, F.lit("'."))))
    out.append(_violation(variables.filter(F.col("initial_value").isNull() & kind.isin(NUMERIC)), "PLC-014", "Variable without initial value", "info", F.concat(F.lit("Variable '"), name, F.lit("' has no initial value."))))
    out.append(_violation(blocks.filter("line_end - line_start > 200"), "PLC-015", "Block too large", "warning", F.concat(F.lit("Block '"), "name", F.lit("' exceeds 200 lines.")), F.col("line_start") + 1))
    out.append(_violation(variables.filter(scope.isin("VAR_INPUT", "VAR_OUTPUT") & F.col("comment").isNull()), "PLC-016", "I/O variable missing comment", "info", F.concat(F.lit("Variable '"), name, F.lit("' has no comment."))))
    out.append(_violation(variables.filter((scope == "VAR_OUTPUT") & F.col("initial_value").isNull() & (kind == "BOOL")), "PLC-019", "Output without fail-safe default", "warning", F.concat(F.lit("Output '"), name, F.lit("' has no initial value."))))
    words = lines.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\w+)\b"), F.lit(1))).alias("name")).groupBy("path", "name").agg(F.count("*").alias("times"))
    internal = variables.filter(~scope.isin("VAR_INPUT", "VAR_OUTPUT", "VAR_IN_OUT", "VAR_EXTERNAL")).join(words, ["path", "name"], "left").filter("coalesce(times, 0) <= 1")
    out.append(_violation(internal, "PLC-024", "Unused variable", "info", F.concat(F.lit("Variable '"), name, F.lit("' is declared but not used."))))
    compared = lines.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)\s*(?:<=?|>=?|<>|>|<)\s*\d"), F.lit(1))).alias("name")).distinct()
    sensors = variables.filter((scope == "VAR_INPUT") & kind.isin(SENSORS)).join(facts.filter("not limits").select("path"), "path", "left_semi").join(compared, ["path", "name"], "left_anti")
    out.append(_violation(sensors, "PLC-017", "Sensor input without range validation", "warning", F.concat(F.lit("Sensor input '"), name, F.lit("' is used without range validation."))))
    return R.dedup_violations(reduce(DataFrame.unionByName, out))


def violations_to_findings(violations: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Violations in the findings' normal form."""
    category = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair]), F.col("rule_id")), F.lit("convention"))
    return violations.select(F.col("path").alias("file_path"), F.coalesce("line_no", F.lit(1)).alias("line_start"), F.lit(None).cast("int").alias("line_end"), "severity", category.alias("category"), F.substring("name", 1, 80).alias("title"), F.col("description").alias("hypothesis"), F.array(evidence("static_rule", F.concat("rule_id", F.lit(": "), "description"), None, F.concat(F.lit("plc:"), "rule_id"))).alias("evidence"), F.lit(None).cast("string").alias("counter_considered"), F.lit(confidence).alias("confidence"), F.lit(True).alias("verified"), F.lit(None).cast("string").alias("suggestion"), F.lit("static").alias("detected_by"))


# Hardware: hw_config(path, cpu struct<model,article,firmware,protection_level,watchdog_ms,memory_kb,web_enabled,web_port,
# is_safety>, io_modules array<struct<name,is_safety,redundant>>, networks array<struct<protocol,name,port_security,
# encrypted>>, safety struct<enabled,programs,password>). A null cpu has defaults: nothing set, all protection off.

#: Firmware prefixes known to be vulnerable, by model.
VULNERABLE = {
    "S7-1200": [
        "4.0", "4.1", "4.2", "4.4",
    ],
    "S7-1500": [
        "2.0", "2.5", "2.6", "2.8", "2.8.3",
    ],
}
#: Article numbers by the model that they stand for.
ARTICLES = {
    "S7-1200": [
        "211-1AE40", "212-1AE40", "214-1AG40", "215-1AG40", "217-1AG40",
    ],
    "S7-1500": [
        "511-1CK02", "512-1DK02", "513-1AL02", "515-2AM02", "516-3AN02", "517-3AP00", "518-4AP00",
    ],
    "S7-1500F": [
        "510-1SJ02", "511-1FK02", "513-1FL02", "515-2FM02", "516-3FN02", "517-3FP00", "518-4FP00",
    ],
}


#: Protocols without encryption of their own.
PLAIN_PROTOCOLS = ["S7COMM", "S7", "ISO-TCP"]


def audit_hardware(config: DataFrame) -> DataFrame:
    """``path, rule_id, severity, description``: a row for each hardware rule, and network of the network rules, that a configuration breaks."""
    cpu = lambda name, default: F.coalesce(F.col(f"cpu.{name}"), F.lit(default))
    model, version = F.upper(cpu("model", "")), cpu("firmware", "")
    weak = [F.contains(model, F.lit(m)) & reduce(Column.__or__, [F.startswith(version, F.lit(p)) for p in prefixes]) for m, prefixes in VULNERABLE.items()]
    article, misfit = F.upper(F.replace(cpu("article", ""), F.lit(" "), F.lit(""))), F.lit(False)
    for known, numbers in ARTICLES.items():
        misfit = misfit | (reduce(Column.__or__, [F.contains(article, F.lit("6ES7" + n)) for n in numbers]) & (model != "") & ~F.contains(model, F.lit(known)))
    flag = lambda x: F.coalesce(x, F.lit(False))
    unsafe = F.filter("io_modules", lambda x: flag(x["is_safety"]) & ~flag(x["redundant"]))
    nets = lambda test: F.size(F.filter("networks", test))
    enabled, dog = flag(F.col("safety.enabled")), cpu("watchdog_ms", 0)
    rules = [
        ("HW-001", "critical", reduce(Column.__add__, [w.cast("int") for w in weak]), "firmware with known weaknesses"),
        ("HW-002", "error", cpu("protection_level", 0) == 0, "access is not protected"),
        ("HW-003", "warning", (dog == 0) | (dog > 500), "cycle watchdog off or slower than 500 ms"),
        ("HW-004", "warning", F.size(unsafe) > 0, "safety module on one channel"),
        ("HW-005", "error", flag(F.col("cpu.is_safety")) & ~enabled, "safety controller without a safety configuration"),
        ("HW-005", "error", enabled & (F.size("safety.programs") <= 0), "safety configuration without programs"),
        ("HW-006", "warning", nets(lambda x: F.contains(F.upper(x["protocol"]), F.lit("PROFINET")) & ~flag(x["port_security"])), "PROFINET ports not secured"),
        ("HW-009", "warning", nets(lambda x: F.upper(x["protocol"]).isin(PLAIN_PROTOCOLS) & ~flag(x["encrypted"])), "network traffic not encrypted"),
        ("HW-008", "warning", flag(F.col("cpu.web_enabled")) & cpu("web_port", 80).isin(80, 8080), "web server without HTTPS"),
        ("HW-007", "critical", enabled & (F.coalesce("safety.password", F.lit("")) == ""), "safety without a password"),
        ("HW-011", "info", (cpu("memory_kb", 0) > 0) & (cpu("memory_kb", 0) < 100), "less than 100 KB of memory"),
        ("HW-012", "info", misfit, "article number of another model"),
    ]
    hits = F.flatten(F.array(*[F.array_repeat(F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(d).alias("description")), F.greatest(F.coalesce(n.cast("int"), F.lit(0)), F.lit(0))) for i, s, n, d in rules]))
    return config.select("path", F.explode(hits).alias("v")).select("path", "v.*")
