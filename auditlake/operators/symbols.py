"""Symbols, imports and calls of many repositories. Table shapes: see FIXTURES.md."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import normal_path, parent, stem, suffix
from ..shared import materialize
from . import scans
from .intervals import around

#: Suffixes that a specifier may leave out, in order.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def definitions(exports: DataFrame, name: str | None = None) -> DataFrame:
    """``symbol, repo, path``: exported names; an unnamed default goes by default:<stem>."""
    names = F.when(F.size("exported_names") > 0, F.col("exported_names")).otherwise(F.when(F.col("is_default"), F.array(F.concat(F.lit("default:"), stem("path")))))
    out = exports.select(F.explode(names).alias("symbol"), "repo", "path", "line")
    return out if name is None else out.filter(F.col("symbol") == name)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, path, line, source, resolved, is_external``: candidates in order, the first that is a file.

    What a specifier leads to hangs on its file's folder, and its candidates on the folded path: each such path is folded
    once for a folder and a specifier, and looked up once for all that fold to it.
    """
    source = F.col("source")
    external = ~F.regexp_like("source", F.lit(r"^[./]"))
    keys = materialize(imports.select("repo", "path", "line", "source").distinct().withColumns({"is_external": external, "_dir": parent("path")}), "imports")
    placed = keys.filter("not is_external").drop("is_external")
    places = placed.select("repo", "_dir", "source").distinct()
    top = F.startswith(source, F.lit("/"))  # from the repository's root
    places = places.withColumn("_base", normal_path(F.when(top, source).otherwise(F.concat_ws("/", "_dir", "source"))))
    base = F.col("_base")
    bare = F.regexp_replace(base, r"(?<=[^/])\.[^./]*$", "")  # a suffix is replaced, not added to
    ranked = [F.when(suffix(base).isin(EXTENSIONS), base), *[F.concat(bare, F.lit(e)) for e in EXTENSIONS], *[F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS], base]
    tried = places.select("repo", "_base").distinct().select("repo", "_base", F.posexplode(F.array(*ranked)).alias("rank", "candidate")).filter(F.col("candidate").isNotNull())
    known = files.select("repo", F.col("path").alias("candidate")).distinct()
    found = tried.join(known, ["repo", "candidate"]).groupBy("repo", "_base").agg(F.min_by("candidate", "rank").alias("resolved"))
    led = places.join(found, ["repo", "_base"]).select("repo", "_dir", "source", "resolved")
    inner = placed.join(led, ["repo", "_dir", "source"], "left").select("repo", "path", "line", "source", "resolved", F.lit(False).alias("is_external"))
    rest = keys.filter("coalesce(is_external, true)")  # also without a source
    return inner.unionByName(rest.select("repo", "path", "line", "source", F.lit(None).cast("string").alias("resolved"), "is_external"))


def importers(resolved: DataFrame) -> DataFrame:
    return resolved.filter("resolved is not null").groupBy("repo", "resolved").agg(F.array_sort(F.collect_set("path")).alias("importers"))


def enclosing_function(points: DataFrame, functions: DataFrame) -> DataFrame:
    """points(repo, path, line) with ``function``, ``function_line``: the smallest span around; ties to the earlier start."""
    f = functions.select("repo", "path", F.col("name").alias("_n"), F.col("line_start").alias("_a"), F.col("line_end").alias("_b"))
    hit = around(points.select("repo", "path", "line").distinct(), f, ["repo", "path"], "line", "_a", "_b")
    best = hit.groupBy("repo", "path", "line").agg(F.min_by(F.struct("_n", "_a"), F.struct(F.col("_b") - F.col("_a"), "_a", "_n")).alias("f"))
    return points.join(best, ["repo", "path", "line"], "left").withColumns({"function": F.col("f._n"), "function_line": F.col("f._a")}).drop("f")


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame, resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """Calls with ``tier`` and ``target`` (path::name@line): same file, then an imported name, then the first exporting file."""
    first = functions.filter("name is not null").groupBy("repo", "path", "name").agg(F.min("line_start").alias("at"))
    where = lambda p: F.concat(p, F.lit("::"), F.col("callee_name"), F.lit("@"), F.col("at").cast("string"))
    local = first.select("repo", "path", F.col("name").alias("callee_name"), where_named(F.col("path")).alias("t1"))
    names = imports.select("repo", "path", "line", "source", F.explode(F.concat(F.col("imported_names"), F.array_compact(F.array("default_name")))).alias("callee_name"))
    via = names.join(resolved.select("repo", "path", "line", "source", "resolved"), ["repo", "path", "line", "source"]).join(first.select("repo", F.col("path").alias("resolved"), F.col("name").alias("callee_name"), "at"), ["repo", "resolved", "callee_name"])
    via = via.groupBy("repo", "path", "callee_name").agg(F.min(where(F.col("resolved"))).alias("t2"))
    open_names = definitions(exports).select("repo", "path", F.col("symbol").alias("callee_name")).join(first.select("repo", "path", F.col("name").alias("callee_name"), "at"), ["repo", "path", "callee_name"])
    open_names = open_names.groupBy("repo", "callee_name").agg(F.min_by(where(F.col("path")), F.struct("path", "at")).alias("t3"))
    out = calls.join(local, ["repo", "path", "callee_name"], "left").join(via, ["repo", "path", "callee_name"], "left").join(open_names, ["repo", "callee_name"], "left")
    t2 = F.when(F.col("receiver").isNull(), F.col("t2"))
    tier = F.when(F.col("t1").isNotNull(), 1).when(t2.isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    return out.withColumns({"tier": tier, "target": F.coalesce("t1", t2, "t3")}).drop("t1", "t2", "t3")


def where_named(path: Column) -> Column:
    return F.concat(path, F.lit("::"), F.col("name"), F.lit("@"), F.col("at").cast("string"))


def call_sites_of(calls: DataFrame, name: str, most: int = 30) -> DataFrame:
    return calls.filter(F.col("callee_name") == name).orderBy("repo", "path", "line").limit(most)


def call_counts(functions: DataFrame, resolved_calls: DataFrame) -> DataFrame:
    """Functions with ``n_calls``."""
    counts = resolved_calls.filter("target is not null").groupBy("repo", "target").agg(F.count("*").alias("n_calls"))
    keyed = functions.withColumn("target", F.concat("path", F.lit("::"), "name", F.lit("@"), F.col("line_start").cast("string")))
    return keyed.join(counts, ["repo", "target"], "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))


def single_call(counted: DataFrame) -> DataFrame:
    return counted.filter("n_calls = 1")


def uncalled(counted: DataFrame, include_exported: bool = False) -> DataFrame:
    """Named functions, no constructors, that nothing calls; exported ones on request."""
    out = counted.filter("n_calls = 0 and name is not null and name not in ('constructor', '__init__')")
    return out if include_exported else out.filter("not is_exported")


def call_stats(resolved_calls: DataFrame) -> DataFrame:
    return resolved_calls.agg(F.count("*").alias("calls"), F.count("target").alias("resolved"), F.count_if(F.col("tier") == 1).alias("same_file"), F.count_if(F.col("tier") == 2).alias("imported"), F.count_if(F.col("tier") == 3).alias("exported"))


def symbol_stats(files: DataFrame, functions: DataFrame, resolved: DataFrame, exports: DataFrame) -> DataFrame:
    one = lambda df, *aggs: df.agg(*aggs)
    out = one(files, F.count("*").alias("files")).crossJoin(one(functions, F.count("*").alias("functions"))).crossJoin(one(exports, F.count("*").alias("exports")))
    return out.crossJoin(one(resolved, F.count("*").alias("imports"), F.count_if("is_external").alias("external"), F.count_if(~F.col("is_external") & F.col("resolved").isNull()).alias("unresolved")))


#: Declaration patterns by language (kind, pattern with the name as group 1).
DECLARATIONS = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)"), ("import", r"^\s*(?:from|import)\s+([\w.]+)")],
    "javascript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("import", r"^\s*import\b.*?['\"]([^'\"]+)['\"]")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("class", r"^type\s+(\w+)\s+(?:struct|interface)"), ("import", r"^\s*(?:import\s+)?\"([^\"]+)\"")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)"), ("import", r"^\s*use\s+([\w:]+)")],
    "java": [("class", r"^\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface|enum)\s+(\w+)"), ("function", r"^\s+(?:(?:public|private|protected|static|final|synchronized)\s+)*(?!return\b|new\b|else\b)(?:[\w<>\[\], ]+\s+)?(\w+)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{"), ("import", r"^import\s+(?:static\s+)?([\w.]+)")],
    "ruby": [("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"^\s*(?:class|module)\s+(\w+)"), ("import", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)")],
    "php": [("function", r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)"), ("class", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)"), ("import", r"^\s*use\s+([\w\\]+)")],
}
_NOT_CALL = r"(?!(?:return|else|if|for|while|switch|catch|new|throw|delete|using|lock|case|goto|typedef|do|sizeof|await|yield|foreach|where|select|orderby|group|join|from|let|co_return|co_await|co_yield)\b)"
_C_FUNCTION = ("function", r"^\s*" + _NOT_CALL + r"(?:[\w:<>,\[\]]+[\s*&]+)+(?:[\w<>]+::)*(?!(?:if|for|while|switch|catch)\b)(~?\w+)\s*\([^;]*(?:\{.*)?$")
_C_BARE = ("function", r"^" + _NOT_CALL + r"(?:\w+::)*(~?[a-z_]\w*)\s*\([^;]*(?:\{.*)?$")  # the type stands on the line before
_INCLUDE = ("import", r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]")
_CS_MODIFIERS = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|extern|unsafe|readonly|ref|new|file|required)\s+)"
_SWIFT_MODIFIERS = r"(?:(?:@\w+(?:\([^)]*\))?|public|private(?:\(set\))?|fileprivate|internal|open|static|class|final|override|mutating|nonmutating|required|convenience|indirect)\s+)*"
_KT_MODIFIERS = r"(?:(?:@\w+(?:\([^)]*\))?|public|private|protected|internal|open|final|abstract|override|suspend|inline|infix|operator|tailrec|external|data|sealed|enum|annotation|value|inner|companion|expect|actual|fun(?=\s+interface))\s+)*"
_SCALA_MODIFIERS = r"(?:(?:@\w+|private(?:\[\w+\])?|protected(?:\[\w+\])?|final|override|implicit|lazy|sealed|abstract|case|inline|opaque)\s+)*"
DECLARATIONS |= {
    "typescript": DECLARATIONS["javascript"],
    "c": [_C_FUNCTION, _C_BARE, ("class", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*(?:\{|$)"), _INCLUDE],
    "cpp": [("class", r"^\s*(?:template\s*<.*>\s*)?(?:typedef\s+)?(?:class|struct)\s+(?:\[\[.*?\]\]\s*)?(\w+)\s*(?:final\s*)?(?:[:{]|$)"), _C_FUNCTION, _C_BARE, ("function", r"^(?:\w+::)+(~?\w+)\s*\([^;]*(?:\{.*)?$"), _INCLUDE],
    "c_sharp": [("class", r"^\s*" + _CS_MODIFIERS + r"*(?:class|struct|interface|record(?:\s+(?:class|struct))?)\s+(\w+)"), ("import", r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"), ("function", r"^\s*" + _CS_MODIFIERS + r"*" + _NOT_CALL + r"(?:(?:\([^()]*,[^()]*\)|[\w.]+(?:<[^()]*>)?(?:\[[,\s]*\])*)\??\s+)+(\w+)\s*(?:<[^()]*>)?\s*\("), ("function", r"^\s*(?:(?:public|private|protected|internal|static|unsafe|extern)\s+)+(\w+)\s*\(")],
    "swift": [("function", r"^\s*" + _SWIFT_MODIFIERS + r"func\s+(\w+)"), ("class", r"^\s*" + _SWIFT_MODIFIERS.replace("|class|", "|") + r"(?:class|struct|protocol|enum|actor|extension)\s+(?!func\b|var\b|let\b)(\w+)"), ("import", r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?([\w.]+)")],
    "kotlin": [("class", r"^\s*" + _KT_MODIFIERS + r"(?:class|interface|object)\s+(\w+)"), ("function", r"^\s*" + _KT_MODIFIERS + r"fun\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?`?(\w+)`?\s*\("), ("import", r"^\s*import\s+([\w.]+)")],
    "scala": [("class", r"^\s*" + _SCALA_MODIFIERS + r"(?:class|object|trait|enum)\s+(\w+)"), ("function", r"^\s*" + _SCALA_MODIFIERS + r"(?:def|val)\s+(\w+)"), ("import", r"^\s*import\s+(\w+(?:\.\w+)*)")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"), ("function", r"^\s*(?:local\s+)?([\w.]+)\s*=\s*function\b")],
    "sql": [("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?function\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)")],
    "julia": [("function", r"^\s*(?:@\w+\s+)*function\s+([\w.!]+)"), ("function", r"^\s*(?:@\w+\s+)*([\w.]+!?)\([^=]*\)\s*(?:::\s*[\w{}.]+\s*)?(?:where\s+[\w{}<:, ]+)?=(?!=)"), ("class", r"^\s*(?:abstract\s+type|mutable\s+struct|struct)\s+(\w+)"), ("import", r"^\s*(?:using|import)\s+([\w.]+)")],
    "shell": [("function", r"^\s*function\s+([\w:.-]+)"), ("function", r"^\s*([\w:.-]+)\s*\(\s*\)")],
    "matlab": [("function", r"^\s*function\s+(?:(?:\[[^\]]*\]|\w+)\s*=\s*)?([\w.]+)")],
    "solidity": [("function", r"^\s*(?:function|modifier)\s+(\w+)"), ("class", r"^\s*(?:abstract\s+)?(?:contract|interface|library)\s+(\w+)"), ("import", r"^\s*import\b.*?['\"]([^'\"]+)['\"]")],
    "verilog": [("class", r"^\s*(?:virtual\s+)?(?:module|class|interface|package)\s+(?:(?:automatic|static)\s+)?(?!class\b)(\w+)"), ("function", r"^\s*(?!endfunction|endtask)(?:(?:virtual|static|local|protected|pure|extern)\s+)*(?:function|task)\s+(?:[\w:]+\s+|\[[^\]]*\]\s*)*?(\w+)\s*(?:[(;]|$)")],
    "zig": [("function", r"^\s*(?:(?:pub|export|inline|noinline|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)")],
    "objective_c": [("class", r"^\s*@(?:interface|implementation)\s+(\w+)"), ("function", r"^\s*[-+]\s*\([^)]*\)\s*(\w+)"), ("import", r"^\s*#\s*(?:import|include)\s*[<\"]([^>\"]+)[>\"]"), ("import", r"^\s*@import\s+([\w.]+)"), _C_FUNCTION],
}


#: What an extractor gives for each declaration.
DECLARATION = "repo string, path string, kind string, name string, line_start int, line_end int"


def extract_with(files: DataFrame, extract: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Declarations by a function of the user's own, such as a parser: it gets files ``repo, path, language, content`` in batches and gives rows of ``DECLARATION``."""
    return files.select("repo", "path", "language", "content").mapInPandas(extract, DECLARATION)


def extract_declarations(files: DataFrame, piece: int = scans.PIECE) -> DataFrame:
    """``repo, path, kind, name, line_start, line_end`` of files with ``language``, by patterns; an approximation.

    A declaration ends before the next line of code that is indented no deeper and does not begin with a closing mark,
    or with that mark's line. An opening brace on a line of its own belongs to the declaration before it; in languages of
    the C family directives, labels and access sections end nothing. Ends are found in one pass over the lines.
    """
    lines = files.select("repo", "path", "language", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    found = F.when(F.lit(False), F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("name"))))
    for lang, patterns in DECLARATIONS.items():
        hits = [F.when(F.regexp_like("text", F.lit(p)), F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("name"))) for k, p in patterns]
        found = found.when(F.col("language") == lang, F.slice(F.array_compact(F.array(*hits)), 1, 1))
    filled = lines.withColumns({"d": F.try_element_at(found, F.lit(1)), "indent": F.length(F.regexp_extract("text", r"^(\s*)", 1))}).filter(F.trim("text") != "")
    passed = F.regexp_like("text", F.lit(r"^\s*\{")) | (F.col("language").isin("c", "cpp", "c_sharp", "objective_c") & F.regexp_like("text", F.lit(r"^\s*(?:#|\w+\s*:\s*$)")) & F.col("d").isNull())
    closing = F.regexp_like("text", F.lit(r"^\s*[})\]]|^\s*end\b|^\s*end(?:function|task|module|class|package|interface)\b|^\s*@end\b"))
    rows = filled.select("repo", "path", "i", "indent", "d.kind", "d.name", passed.alias("passed"), closing.alias("closing"))
    last = rows.groupBy("repo", "path").agg(F.max("i").alias("last"))
    ended = scans.next_not_above(rows, ["repo", "path"], "i", "indent", ~F.coalesce("passed", F.lit(False)), "stop", piece).filter("kind is not null")
    closers = rows.filter("closing").select("repo", "path", F.col("i").alias("stop"), "closing")
    out = ended.drop("closing").join(closers, ["repo", "path", "stop"], "left").join(last, ["repo", "path"])
    end = F.when(F.col("kind") == "import", F.col("i")).otherwise(F.coalesce(F.when(F.col("closing"), F.col("stop")).otherwise(F.col("stop") - 1), F.col("last")))
    return out.select("repo", "path", "kind", "name", (F.col("i") + 1).alias("line_start"), (end + 1).alias("line_end"))
