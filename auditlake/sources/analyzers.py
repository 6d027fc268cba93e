"""Reports of thirteen analyzers, read by format and brought into one findings schema.

``read_report`` gives a table of one row per issue; ``normalize`` maps it. Paths are made relative to ``root``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import relative_to, title_cut
from ..operators.findings import EVIDENCE, evidence

JSON_SCHEMAS = {
    "oxlint": "diagnostics array<struct<message:string,code:string,severity:string,help:string,filename:string,labels:array<struct<label:string,span:struct<line:int,column:int>>>>>",
    "bandit": "results array<struct<filename:string,line_number:int,line_range:array<int>,test_id:string,test_name:string,issue_severity:string,issue_confidence:string,issue_text:string,issue_cwe:struct<id:int,link:string>,code:string,more_info:string>>",
    "golangci": "Issues array<struct<FromLinter:string,Text:string,Severity:string,Pos:struct<Filename:string,Line:int,Column:int>,SourceLines:array<string>>>",
    "shellcheck": "file string, line int, endLine int, level string, code int, message string",
    "sqlfluff": "filepath string, violations array<struct<line_no:int,code:string,description:string,name:string>>",
    "rubocop": "files array<struct<path:string,offenses:array<struct<severity:string,message:string,cop_name:string,correctable:boolean,location:struct<line:int,last_line:int>>>>>",
    "phpstan": "files map<string,struct<messages:array<struct<message:string,line:int,identifier:string>>>>",
    "detekt": "files array<struct<path:string,issues:array<struct<ruleId:string,message:string,severity:string,location:struct<startLine:int,endLine:int>>>>>, path string, issues array<struct<ruleId:string,message:string,severity:string,location:struct<startLine:int,endLine:int>>>",
}
CLIPPY = "reason string, message struct<message:string,level:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,line_end:int,is_primary:boolean>>,rendered:string>"
LUACHECK = r"^([^:]+):(\d+):(\d+)(?:-(\d+))?:\s*\(([EW]\d+)\)\s+(.+)$"
VERILATOR = r"^%(Error|Warning|Info)(?:-([A-Z_]+))?:\s*([^:]+):(\d+):(\d+):\s*(.+)$"

#: Severities of oxlint rules.
OXLINT_SEVERITY = {
    "no-eval": "critical", "no-implied-eval": "critical", "no-new-func": "critical", "react/no-danger-with-children": "critical",
    "no-const-assign": "critical", "no-script-url": "error", "no-prototype-builtins": "error", "no-extend-native": "error", "no-proto": "error",
    "no-iterator": "error", "no-with": "error", "react/no-danger": "error", "react/jsx-no-target-blank": "error", "no-self-compare": "error",
    "no-unsafe-finally": "error", "no-unsafe-negation": "error", "no-unreachable": "error", "no-unreachable-loop": "error",
    "no-unmodified-loop-condition": "error", "no-dupe-keys": "error", "no-dupe-args": "error", "no-dupe-class-members": "error",
    "use-isnan": "error", "valid-typeof": "error", "for-direction": "error", "getter-return": "error", "no-async-promise-executor": "error",
    "no-promise-executor-return": "error", "require-await": "warning",
}
#: Parts of oxlint rule names and their categories, in order.
OXLINT_CATEGORY = [
    ("security", [
        "no-eval", "no-implied-eval", "no-new-func", "no-script-url", "no-prototype-builtins", "no-extend-native", "no-proto", "no-iterator",
        "no-with", "no-danger", "no-target-blank", "no-unsanitized",
    ]),
    ("potential_bug", [
        "no-self-compare", "no-unsafe", "no-unreachable", "no-dupe", "no-const-assign", "use-isnan", "valid-typeof", "for-direction",
        "getter-return", "no-promise-executor-return", "no-async-promise-executor", "no-unmodified-loop-condition",
    ]),
    ("redundancy", [
        "unused",
    ]),
    ("performance", [
        "perf",
    ]),
]
#: Parts of clippy lint names and their categories, in order.
CLIPPY_CATEGORY = [
    ("security", [
        "unsafe", "transmute", "raw_pointer", "ptr_eq", "expect_used", "unwrap_used", "indexing_slicing", "integer_arithmetic",
    ]),
    ("potential_bug", [
        "needless", "match_same_arms", "panic", "unreachable", "while_immutable", "deref_addrof", "uninit_assumed_init", "self_assignment",
        "wrong_self_convention", "useless", "result_unit_err", "missing_panics", "unimplemented",
    ]),
    ("performance", [
        "perf", "redundant_clone", "inefficient", "large_enum_variant", "slow_vector_initialization", "unnecessary_to_owned",
    ]),
    ("redundancy", [
        "unused", "dead_code", "duplicate", "no_effect",
    ]),
    ("readability", [
        "too_many_arguments", "cognitive_complexity", "too_many_lines",
    ]),
]
#: Cppcheck rules that count as critical, and CWE numbers that count as security.
CPPCHECK_CRITICAL = [
    "bufferAccessOutOfBounds", "bufferOverflow", "stringBufferOverflow", "nullPointer", "nullPointerDefaultArg", "useAfterFree", "doubleFree",
    "memleak", "uninitvar", "integerOverflow", "negativeIndex", "shiftTooManyBits", "wrongPrintfScanfArgNum", "writeReadOnlyFile", "deallocuse",
]
CPPCHECK_CWE = [119, 120, 121, 122, 125, 126, 127, 190, 416, 476, 787, 788]
#: Categories of Go linters; others are style.
GO_CATEGORY = {
    "gosec": "security", "noctx": "security", "govet": "potential_bug", "staticcheck": "potential_bug", "errcheck": "potential_bug",
    "typecheck": "potential_bug", "ineffassign": "potential_bug", "errorlint": "potential_bug", "nilerr": "potential_bug",
    "rowserrcheck": "potential_bug", "bodyclose": "potential_bug", "sqlclosecheck": "potential_bug", "contextcheck": "potential_bug",
    "prealloc": "performance", "perfsprint": "performance", "unused": "redundancy", "unparam": "redundancy", "deadcode": "redundancy",
    "varcheck": "redundancy",
}
#: Verilator rules that are bugs, and that are style.
VERILATOR_BUGS = [
    "WIDTH", "WIDTHCONCAT", "WIDTHTRUNC", "WIDTHEXPAND", "CASEINCOMPLETE", "CASEX", "CASEOVERLAP", "BLKSEQ", "BLKANDNBLK", "LATCH", "MULTIDRIVEN",
    "MULTIDRIVE", "ASYNCBR", "ASYNC", "UNDRIVEN", "PINMISSING", "PINNOTFOUND", "STMTDLY", "INFINITELOOP", "REALCVT",
]
VERILATOR_STYLE = [
    "UNUSED", "UNUSEDPARAM", "UNUSEDSIGNAL", "DECLFILENAME", "EOFNEWLINE", "VARHIDDEN",
]

TOOLS = ["oxlint", "bandit", "clippy", "cppcheck", "spotbugs", "golangci", "shellcheck", "luacheck", "sqlfluff", "rubocop", "phpstan", "detekt", "verilator"]


def read_report(spark: SparkSession, tool: str, path: str) -> DataFrame:
    """One row per issue of the reports at a path, in the tool's own fields; broken reports give no rows."""
    if tool in JSON_SCHEMAS:
        raw = spark.read.schema(JSON_SCHEMAS[tool]).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
        if tool in ("oxlint", "bandit", "golangci"):
            return raw.select(F.inline({"oxlint": "diagnostics", "bandit": "results", "golangci": "Issues"}[tool]))
        if tool == "sqlfluff":
            return raw.select("filepath", F.inline("violations"))
        if tool == "rubocop":
            return raw.select(F.inline("files")).select("path", F.inline("offenses"))
        if tool == "phpstan":
            return raw.select(F.explode("files").alias("path", "m")).select("path", F.inline("m.messages"))
        if tool == "detekt":
            listed = raw.select(F.explode(F.coalesce("files", F.array(F.struct("path", "issues")))).alias("f"))
            return listed.select("f.path", F.inline("f.issues"))
        return raw.filter("file is not null")
    if tool == "clippy":
        lines = spark.read.text(path).filter(F.startswith("value", F.lit("{"))).select(F.from_json("value", CLIPPY).alias("j"))
        return lines.filter("j.reason = 'compiler-message' and j.message is not null and size(j.message.spans) > 0").select("j.message.*")
    if tool == "cppcheck":
        return spark.read.format("xml").option("rowTag", "error").schema("_id string, _severity string, _msg string, _verbose string, _cwe int, location array<struct<_file:string,_line:int,_column:int,_info:string>>").load(path)
    if tool == "spotbugs":
        return spark.read.format("xml").option("rowTag", "BugInstance").schema("_type string, _category string, _priority int, _rank int, _cweid int, ShortMessage string, LongMessage string, SourceLine array<struct<_sourcefile:string,_sourcepath:string,_start:int,_end:int>>").load(path)
    pattern = {"luacheck": LUACHECK, "verilator": VERILATOR}[tool]
    raw = spark.read.text(path).filter(F.regexp_like("value", F.lit(pattern)))
    part = lambda i: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    if tool == "luacheck":
        return raw.select(part(1).alias("file"), part(2).cast("int").alias("line"), part(5).alias("code"), part(6).alias("message"))
    return raw.select(F.lower(part(1)).alias("severity"), part(2).alias("rule"), part(3).alias("file"), part(4).cast("int").alias("line"), part(6).alias("message"))


def _map(value: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), F.lit(default))


def _by_part(text: Column, table: list[tuple[str, list[str]]], default: str) -> Column:
    """The category of the first group of which some part stands in the text."""
    out = F.lit(default)
    for category, parts in reversed(table):
        out = F.when(reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts]), category).otherwise(out)
    return out


def _findings(df: DataFrame, root: str | None, tool: str, rule: Column, message: Column, path: Column, line: Column, end: Column | None, severity: Column, category: Column, confidence: Column | float, summary: Column, extra: list[Column] = (), suggestion: Column | None = None, source: Column | None = None) -> DataFrame:
    none = F.lit(None)
    first = evidence("static_rule", summary, None, F.concat(F.lit(f"{tool}:"), rule) if source is None else source)
    listed = F.array_compact(F.array(first, *extra)).cast(EVIDENCE)
    return df.select(relative_to(path, root).alias("file_path"), line.cast("int").alias("line_start"), (none if end is None else end).cast("int").alias("line_end"), severity.alias("severity"), category.alias("category"), title_cut(message).alias("title"), F.concat(F.lit(f"{tool} rule '"), rule, F.lit("' triggered: "), message).alias("hypothesis"), listed.alias("evidence"), none.cast("string").alias("counter_considered"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), F.lit(True).alias("verified"), (none if suggestion is None else suggestion).cast("string").alias("suggestion"), F.lit("static").alias("detected_by"))


def _oxlint(d: DataFrame, root):
    rule = F.when(F.regexp_like("code", F.lit(r"\(.*\)$")), F.regexp_extract("code", r"\((.*)\)$", 1)).otherwise(F.col("code"))
    d = d.withColumn("rule", F.coalesce(rule, F.lit("")))
    line = F.coalesce(F.try_element_at("labels", F.lit(1))["span"]["line"], F.lit(0))
    severity = F.coalesce(F.nullif(_map(F.col("rule"), OXLINT_SEVERITY, ""), F.lit("")), F.when(F.col("severity") == "error", "error").otherwise("warning"))
    return _findings(d, root, "oxlint", F.col("rule"), F.col("message"), F.col("filename"), line, None, severity, _by_part(F.col("rule"), OXLINT_CATEGORY, "code_style"), 0.95, F.concat_ws(" ", F.lit("oxlint"), F.concat("rule", F.lit(":")), "message"), [], F.col("help"))


def _bandit(d: DataFrame, root):
    level = F.when(F.col("issue_severity") == "HIGH", 3).when(F.col("issue_severity") == "MEDIUM", 2).otherwise(1) - F.when(F.col("issue_confidence") == "LOW", 1).otherwise(0)
    severity = F.element_at(F.array(*map(F.lit, ["info", "warning", "error", "critical"])), level + 1)
    code = F.when(F.col("code") != "", evidence("code_excerpt", F.substring(F.substring_index("code", "\n", 1), 1, 200), F.col("code"), F.concat(relative_to("filename", root), F.lit(":"), F.col("line_number").cast("string"))))
    cwe = F.when(F.col("issue_cwe.id").isNotNull(), evidence("cross_reference", F.concat(F.lit("CWE-"), F.col("issue_cwe.id").cast("string"), F.lit(": "), F.coalesce("issue_cwe.link", F.lit(""))), None, F.lit("cwe")))
    end = F.when(F.size("line_range") > 1, F.element_at("line_range", -1))
    return _findings(d, root, "bandit", F.col("test_id"), F.col("issue_text"), F.col("filename"), F.col("line_number"), end, severity, F.when(F.col("test_id") == "B101", "convention").otherwise("security"), F.when(F.col("issue_confidence") == "HIGH", 0.85).otherwise(0.65), F.concat(F.lit("bandit "), "test_id", F.lit(" ("), F.coalesce("test_name", F.lit("")), F.lit("): "), "issue_text"), [code, cwe], F.col("more_info"))


def _clippy(d: DataFrame, root):
    code = F.coalesce("code.code", F.lit(""))
    name = F.when(F.contains(code, F.lit("::")), F.regexp_replace(code, r"(?s)^.*?::", "")).otherwise(code)
    d = d.withColumns({"lint": name, "span": F.coalesce(F.try_element_at(F.filter("spans", lambda s: s["is_primary"]), F.lit(1)), F.element_at("spans", 1))})
    base = _map(F.col("level"), {"error": "error", "warning": "warning", "note": "info", "help": "info"}, "warning")
    at = F.concat(relative_to("span.file_name", root), F.lit(":"), F.col("span.line_start").cast("string"))
    shown = F.when(F.col("rendered") != "", evidence("code_excerpt", F.substring(F.substring_index("rendered", "\n", 1), 1, 200), F.col("rendered"), at))
    severity = F.when(F.col("lint").isin("correctness", "perf") & (base == "warning"), "error").otherwise(base)
    return _findings(d, root, "clippy", F.col("lint"), F.col("message"), F.col("span.file_name"), F.col("span.line_start"), F.nullif("span.line_end", "span.line_start"), severity, _by_part(F.lower("lint"), CLIPPY_CATEGORY, "code_style"), 0.95, F.concat(F.lit("clippy "), "lint", F.lit(": "), "message"), [shown], F.concat(F.lit("See `cargo clippy --help` or https://rust-lang.github.io/rust-clippy/master/#"), "lint"), F.concat(F.lit("clippy::"), "lint")).withColumn("hypothesis", F.replace("hypothesis", F.lit("clippy rule '"), F.lit("clippy lint '")))


def _cppcheck(d: DataFrame, root):
    d = d.filter("size(location) > 0 and _id <> 'missingIncludeSystem'").withColumn("at", F.element_at("location", 1))
    severity = F.when(F.col("_id").isin(CPPCHECK_CRITICAL), "critical").otherwise(_map(F.col("_severity"), {"error": "error", "warning": "warning", "performance": "info", "portability": "info", "style": "info", "information": "info"}, "warning"))
    low = F.lower("_severity")
    category = F.when(low == "performance", "performance").when(low.isin("style", "portability"), "code_style").when(F.col("_cwe").isin(CPPCHECK_CWE), "security").when(low.isin("error", "warning"), "potential_bug").otherwise("code_style")
    cwe = F.when(F.col("_cwe").isNotNull(), evidence("cross_reference", F.concat(F.lit("CWE-"), F.col("_cwe").cast("string")), None, F.lit("cwe")))
    return _findings(d, root, "cppcheck", F.col("_id"), F.col("_msg"), F.col("at._file"), F.col("at._line"), None, severity, category, F.when(low.isin("error", "warning"), 0.9).otherwise(0.7), F.concat(F.lit("cppcheck "), "_id", F.lit(": "), "_msg"), [cwe])


def _spotbugs(d: DataFrame, root):
    p, r = F.coalesce("_priority", F.lit(5)), F.coalesce("_rank", F.lit(20))
    severity = F.when((p <= 1) | (r <= 4), "critical").when((p == 2) | (r <= 9), "error").when((p == 3) | (r <= 14), "warning").otherwise("info")
    category = _map(F.upper("_category"), {"SECURITY": "security", "PERFORMANCE": "performance", "BAD_PRACTICE": "code_style", "STYLE": "code_style"}, "potential_bug")
    at = F.try_element_at("SourceLine", F.lit(1))
    return _findings(d, root, "spotbugs", F.col("_type"), F.coalesce("LongMessage", "ShortMessage", "_type"), F.coalesce(at["_sourcepath"], at["_sourcefile"]), at["_start"], at["_end"], severity, category, F.when(p <= 2, 0.85).otherwise(0.7), F.concat(F.lit("spotbugs "), "_type", F.lit(": "), F.coalesce("ShortMessage", F.lit(""))))


def _golangci(d: DataFrame, root):
    own = F.lower(F.coalesce("Severity", F.lit("")))
    severity = F.when(own.isin("error", "warning"), own).when(F.col("FromLinter") == "gosec", "error").when(F.col("FromLinter").isin("govet", "staticcheck", "typecheck", "errcheck"), "warning").otherwise("info")
    code = F.when(F.size("SourceLines") > 0, evidence("code_excerpt", F.element_at("SourceLines", 1), F.array_join("SourceLines", "\n")))
    return _findings(d, root, "golangci", F.col("FromLinter"), F.col("Text"), F.col("Pos.Filename"), F.col("Pos.Line"), None, severity, _map(F.col("FromLinter"), GO_CATEGORY, "code_style"), 0.9, F.concat(F.lit("golangci "), "FromLinter", F.lit(": "), "Text"), [code])


def _shellcheck(d: DataFrame, root):
    rule = F.concat(F.lit("SC"), F.col("code").cast("string"))
    category = F.when(F.col("code").isin(2086, 2046, 2153, 2154, 2155), "security").when(F.col("level") == "style", "code_style").otherwise("potential_bug")
    wiki = evidence("cross_reference", F.concat(F.lit("https://www.shellcheck.net/wiki/"), rule), None, F.lit("shellcheck-wiki"))
    return _findings(d, root, "shellcheck", rule, F.col("message"), F.col("file"), F.col("line"), F.col("endLine"), _map(F.col("level"), {"error": "error", "warning": "warning", "info": "info", "style": "info"}, "warning"), category, 0.9, F.concat(F.lit("shellcheck "), rule, F.lit(" ("), "level", F.lit("): "), "message"), [wiki])


def _luacheck(d: DataFrame, root):
    code = F.col("code")
    severity = F.when(F.startswith(code, F.lit("E")), "error").when(F.regexp_like(code, F.lit("^W[35]")), "warning").otherwise("info")
    category = F.when(F.startswith(code, F.lit("W6")), "code_style").when(F.regexp_like(code, F.lit("^(?:E|W[345])")), "potential_bug").otherwise("convention")
    return _findings(d, root, "luacheck", code, F.col("message"), F.col("file"), F.col("line"), None, severity, category, F.when(F.startswith(code, F.lit("E")), 0.9).otherwise(0.8), F.concat(F.lit("luacheck "), code, F.lit(": "), "message"))


def _sqlfluff(d: DataFrame, root):
    code, parse = F.col("code"), F.col("code").isin("PRS", "LXR", "TMP")
    severity = F.when(parse, "error").when(F.startswith(code, F.lit("L")), "warning").otherwise("info")
    category = F.when(parse, "potential_bug").when(F.regexp_like(code, F.lit("^L0[0-3]")), "code_style").otherwise("convention")
    return _findings(d, root, "sqlfluff", code, F.col("description"), F.col("filepath"), F.col("line_no"), None, severity, category, F.when(parse, 0.95).otherwise(0.8), F.concat(F.lit("sqlfluff "), code, F.lit(" ("), F.coalesce("name", F.lit("unknown")), F.lit("): "), "description"))


def _rubocop(d: DataFrame, root):
    name, s = F.lower("cop_name"), F.col("severity")
    category = F.when(F.contains(name, F.lit("security")), "security").when(F.startswith(name, F.lit("perf")), "performance").when(F.startswith(name, F.lit("style/")) | (s == "convention"), "code_style").when(s.isin("error", "fatal", "warning"), "potential_bug").otherwise("convention")
    return _findings(d, root, "rubocop", F.col("cop_name"), F.col("message"), F.col("path"), F.col("location.line"), F.col("location.last_line"), _map(s, {"fatal": "critical", "error": "error", "warning": "warning", "refactor": "info", "convention": "info"}, "warning"), category, F.when(s.isin("error", "fatal"), 0.9).otherwise(0.75), F.concat(F.lit("rubocop "), "cop_name", F.lit(" ("), s, F.lit("): "), "message"), [], F.when(F.col("correctable"), "(rubocop can auto-fix this)"))


def _phpstan(d: DataFrame, root):
    rule = F.coalesce("identifier", F.lit("phpstan"))
    s = F.concat(F.lower(F.coalesce("identifier", F.lit(""))), F.lit(" "), F.lower("message"))
    category = F.when(F.regexp_like(s, F.lit("sql injection|xss|csrf|unserialize|eval")), "security").when(F.contains(s, F.lit("deprecated")), "convention").otherwise("potential_bug")
    return _findings(d, root, "phpstan", rule, F.col("message"), F.col("path"), F.col("line"), None, F.lit("warning"), category, 0.85, F.concat(F.lit("phpstan ("), rule, F.lit("): "), "message"))


def _detekt(d: DataFrame, root):
    category = _by_part(F.lower("ruleId"), [("architecture", ["complexity"]), ("performance", ["performance"]), ("potential_bug", ["potential-bugs", "exception"]), ("code_style", ["style", "formatting", "naming"])], "convention")
    return _findings(d, root, "detekt", F.col("ruleId"), F.col("message"), F.col("path"), F.col("location.startLine"), F.col("location.endLine"), _map(F.col("severity"), {"fatal": "critical", "error": "error", "warning": "warning", "info": "info"}, "warning"), category, 0.85, F.concat(F.lit("detekt "), "ruleId", F.lit(" ("), F.coalesce("severity", F.lit("")), F.lit("): "), "message"))


def _verilator(d: DataFrame, root):
    rule = F.col("rule")
    category = F.when(rule.isNull(), F.when(F.col("severity") == "error", "potential_bug").otherwise("convention")).when(rule.isin(VERILATOR_BUGS), "potential_bug").when(rule.isin(VERILATOR_STYLE), "code_style").otherwise("convention")
    tag = F.coalesce(rule, F.lit("SYNTAX"))
    link = evidence("cross_reference", F.coalesce(F.concat(F.lit("https://verilator.org/warn/"), rule, F.lit(".html")), F.lit("https://verilator.org/guide/latest/warnings.html")), None, F.lit("verilator-docs"))
    return _findings(d, root, "verilator", tag, F.col("message"), F.col("file"), F.col("line"), None, _map(F.col("severity"), {"error": "error", "warning": "warning", "info": "info"}, "warning"), category, 0.9, F.concat(F.lit("verilator "), tag, F.lit(" ("), "severity", F.lit("): "), "message"), [link])


def normalize(report: DataFrame, tool: str, root: str | None = None) -> DataFrame:
    """A tool's rows as findings."""
    return {"oxlint": _oxlint, "bandit": _bandit, "clippy": _clippy, "cppcheck": _cppcheck, "spotbugs": _spotbugs, "golangci": _golangci, "shellcheck": _shellcheck, "luacheck": _luacheck, "sqlfluff": _sqlfluff, "rubocop": _rubocop, "phpstan": _phpstan, "detekt": _detekt, "verilator": _verilator}[tool](report, root)
