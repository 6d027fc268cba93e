"""Corpus inventory: languages, profiles, markers, frameworks and vendors of repositories.

Tables: ``files(repo, path, ext, content, size, mtime)``. Small lookup tables are fixed and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import basename

#: Language of each extension.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".pyi": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sc": "scala", ".go": "go",
    ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".cs": "c_sharp", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".lua": "lua", ".jl": "julia", ".dart": "dart", ".sql": "sql", ".sh": "shell", ".bash": "shell",
    ".zsh": "shell", ".m": "matlab", ".r": "r", ".sas": "sas", ".sol": "solidity", ".v": "verilog", ".vh": "verilog", ".sv": "verilog",
    ".svh": "verilog", ".zig": "zig", ".mm": "objective_c", ".cob": "cobol", ".cbl": "cobol", ".cpy": "cobol", ".st": "structured_text",
    ".iecst": "structured_text", ".l5x": "plc_rockwell", ".smc2": "plc_omron",
}
#: Profile of each language.
PROFILES = {
    "javascript": "js", "typescript": "js", "python": "python", "rust": "rust", "java": "java", "go": "go", "c": "cpp", "cpp": "cpp",
    "kotlin": "kotlin", "ruby": "ruby", "php": "php", "lua": "lua", "sql": "sql", "shell": "shell", "scala": "generic", "c_sharp": "generic",
    "swift": "generic", "julia": "generic", "matlab": "matlab", "r": "r", "verilog": "verilog", "systemverilog": "verilog", "sas": "sas",
    "cobol": "cobol", "solidity": "solidity", "zig": "zig", "objective_c": "objc", "dart": "dart", "structured_text": "plc", "plc_rockwell": "plc",
    "plc_omron": "plc", "plc_siemens": "plc", "plc_beckhoff": "plc", "plc_codesys": "plc",
}
#: Further extensions that a profile claims besides those of its languages.
EXTRA_EXTENSIONS = {"objc": [".m", ".mm"], "plc": [".xml"]}
#: Dependency names and the frameworks they stand for.
FRAMEWORKS = {"react": "react", "next": "nextjs", "vue": "vue", "nuxt": "nuxt", "@angular/core": "angular", "svelte": "svelte", "express": "express", "@nestjs/core": "nestjs", "fastify": "fastify", "@prisma/client": "prisma", "typeorm": "typeorm", "mongoose": "mongoose", "sequelize": "sequelize"}
#: Vendor signatures in order.
VENDORS = [("siemens", ["simaticml", "siemens.com/automation"]), ("beckhoff", ["tcpou", "twincat"]), ("codesys", ["project xmlns", "codesys"]), ("rockwell", ["rslogix", "rsl5kfile"]), ("abb", ["abb.com/automation"]), ("ge", ["ge-ip", "ge.com/automation"]), ("omron", ["omron"])]
#: Folders that are no source.
IGNORED = [
    "node_modules", "__pycache__", ".git", "venv", ".venv", "env", "dist", "build", "target", ".next", ".nuxt", ".pytest_cache", ".ruff_cache",
    ".mypy_cache", "coverage", "htmlcov", ".idea", ".vscode", ".gradle", ".terraform",
]
MARKERS = ["package.json", "pyproject.toml", "tsconfig.json", "go.mod", "Cargo.toml"]


def _lookup(value: Column, table: dict[str, str]) -> Column:
    """A literal map; absent keys give null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def without_ignored(files: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Files of which no parent folder is in the list."""
    parts = F.split("path", "/")
    return files.filter(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, ignored or IGNORED))))


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", _lookup(F.lower("ext"), LANGUAGES))


def with_profile(files: DataFrame) -> DataFrame:
    return files.withColumn("profile", F.coalesce(_lookup(F.col("language"), PROFILES), F.lit("auto")))


def profiles_for(files: DataFrame) -> DataFrame:
    """One row per file and profile that claims its extension; some extensions have two."""
    claims = [(ext, PROFILES[language]) for ext, language in LANGUAGES.items() if language in PROFILES]
    claims += [(ext, p) for p, extensions in EXTRA_EXTENSIONS.items() for ext in extensions]
    rows = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(p).alias("p")) for e, p in sorted(set(claims))])
    own = F.array_sort(F.array_distinct(F.transform(F.filter(rows, lambda x: x["e"] == F.lower("ext")), lambda x: x["p"])))
    return files.withColumn("profile", F.explode(own))


def list_files(files: DataFrame, subdir: str = "", max_files: int = 200) -> DataFrame:
    return files.filter(F.startswith("path", F.lit(subdir.rstrip("/") + "/" if subdir else ""))).orderBy("repo", "path").limit(max_files)


def read_lines(files: DataFrame, path: str, start: int = 1, max_lines: int = 200) -> DataFrame:
    """A numbered slice of a file and how many lines follow it."""
    lines = files.filter(F.col("path") == path).select("repo", "path", F.size(F.split("content", "\n")).alias("n"), F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return lines.filter(F.col("i").between(start - 1, start + max_lines - 2)).select("repo", "path", (F.col("i") + 1).alias("line_no"), "text", F.greatest(F.col("n") - (start + max_lines - 1), F.lit(0)).alias("n_more"))


def lines_of(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("i", "text")).select("repo", "path", (F.col("i") + 1).alias("line_no"), "text")


def markers(files: DataFrame) -> DataFrame:
    """``repo, markers``: manifest files in a repository's root, and vendor project files anywhere."""
    own = F.col("path").isin(MARKERS) | F.lower("ext").isin(".l5x", ".smc2")
    return files.filter(own).groupBy("repo").agg(F.array_sort(F.collect_set(basename("path"))).alias("markers"))


def frameworks(files: DataFrame) -> DataFrame:
    """``repo, frameworks`` from the dependencies of the root package.json."""
    kind = "dependencies map<string,string>, devDependencies map<string,string>"
    empty = F.create_map().cast("map<string,string>")
    parsed = files.filter(F.col("path") == "package.json").select("repo", F.from_json("content", kind).alias("j"))
    names = F.array_union(F.map_keys(F.coalesce("j.dependencies", empty)), F.map_keys(F.coalesce("j.devDependencies", empty)))
    table = F.create_map(*[F.lit(x) for pair in FRAMEWORKS.items() for x in pair])
    return parsed.select("repo", F.array_sort(F.array_compact(F.transform(names, lambda n: F.try_element_at(table, n)))).alias("frameworks"))


def plc_vendor(files: DataFrame, candidates: int = 20) -> DataFrame:
    """``repo, plc_vendor``: the first vendor whose signature the first matching XML file holds in its first 4096 characters."""
    head = F.lower(F.substring("content", 1, 4096))
    order = F.when(F.lit(False), F.lit(0))
    for i, (_, signs) in enumerate(VENDORS):
        test = F.lit(False)
        for sign in signs:
            test = test | F.contains(head, F.lit(sign))
        order = order.when(test, F.lit(i))
    ranked = files.filter(F.lower("ext") == ".xml").withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).filter(F.col("r") <= candidates)
    first = ranked.withColumn("v", order).filter(F.col("v").isNotNull()).groupBy("repo").agg(F.min_by("v", "path").alias("v"))
    return first.select("repo", F.element_at(F.array(*[F.lit(n) for n, _ in VENDORS]), F.col("v") + 1).alias("plc_vendor"))


def plc_format(files: DataFrame) -> DataFrame:
    """Adds ``plc_format``: by suffix, else for XML by root tag and marks within the first 2000 characters."""
    head = F.lower(F.substring("content", 1, 2000))
    tag = F.lower(F.regexp_extract("content", r"(?s)<(?![?!])(?:\w+:)?(\w+)", 1))
    has = lambda *words: F.greatest(*[F.contains(head, F.lit(w)) for w in words], F.lit(False))
    sniff = F.when(has("simaticml", "siemens", "sw.blocks.") | (tag == "document") & has("sw.blocks"), "siemens").when((tag == "tcplcobject") | has("tcpou", "twincat"), "beckhoff").when((tag == "rslogix5000content"), "rockwell").when(has("plcopen.org", "codesys", "3s-smart"), "codesys").when(has("abb.com"), "abb").when(has("ge-ip", "proficy"), "ge").when(has("omron"), "omron")
    ext = F.lower("ext")
    return files.withColumn("plc_format", F.when(ext == ".smc2", "omron").when(ext == ".l5x", "rockwell").when(ext == ".xml", sniff))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row per repository: files, counts and shares by language, primary language, profile.

    Languages stand by files descending, ties by name.
    """
    counted = with_language(files).groupBy("repo", "language").agg(F.count("*").alias("n"))
    known = F.filter(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "language"))), lambda x: x["language"].isNotNull())
    out = counted.groupBy("repo").agg(F.sum("n").alias("total_files"), known.alias("x"))
    share = F.map_from_entries(F.transform("x", lambda e: F.struct(e["language"], F.round(-100.0 * e["k"] / F.col("total_files"), 1))))
    out = out.select("repo", "total_files", F.col("x.language").alias("languages"), F.try_element_at(F.col("x.language"), F.lit(1)).alias("primary_language"), share.alias("share"))
    out = out.join(plc_vendor(files), "repo", "left").join(frameworks(files), "repo", "left").join(markers(files), "repo", "left")
    plc = F.col("plc_vendor").isNotNull() | F.array_contains("languages", "structured_text")
    profile = F.when(plc, "plc").when(F.col("primary_language").isNull(), "auto").otherwise(F.coalesce(_lookup(F.col("primary_language"), PROFILES), F.lit("auto")))
    return out.withColumn("suggested_profile", profile)
