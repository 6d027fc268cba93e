"""Scalar functions over columns; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def suffix(path: Column | str) -> Column:
    """Lower-case extension with its dot, or an empty string; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(col(path), r"[^/]\.?(\.[^./]+)$", 1))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def normal_path(path: Column | str) -> Column:
    """Folds ``.`` and ``..`` segments; ``..`` above the start is kept away."""
    step = lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(col(path), "/"), F.array().cast("array<string>"), step), "/")


def escapes(path: Column | str) -> Column:
    """Whether a path is absolute or climbs above its start on the way; null for null."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(a: Column, s: Column) -> Column:
        depth = a["depth"] + F.when((s == "") | (s == "."), 0).when(s == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(a["least"], depth).alias("least"))

    return F.startswith(col(path), F.lit("/")) | (F.aggregate(F.split(col(path), "/"), start, step, lambda a: a["least"]) < 0)


def relative_to(path: Column | str, root: str | None) -> Column:
    return F.regexp_replace(col(path), "^" + re.escape(root.rstrip("/") + "/"), "") if root else col(path)


def finding_fingerprint(path: Column | str, line: Column | str, title: Column | str) -> Column:
    """First 16 hex digits of SHA-1 over path, line and the title lower-cased with single blanks."""
    title = F.lower(F.trim(F.regexp_replace(col(title), r"\s+", " ")))
    return F.substring(F.sha1(F.concat_ws(chr(124), col(path), col(line).cast("string"), title)), 1, 16)


def line_hash(line: Column | str) -> Column:
    """First 12 hex digits of SHA-1 over the trimmed line; null stays null."""
    return F.substring(F.sha1(F.regexp_replace(col(line), r"^\s+|\s+$", "")), 1, 12)


def title_cut(text: Column | str) -> Column:
    return F.when(F.length(col(text)) > 80, F.concat(F.substring(col(text), 1, 77), F.lit("..."))).otherwise(col(text))


def preview(text: Column | str, n: int = 600) -> Column:
    return F.when(F.length(col(text)) > n, F.concat(F.substring(col(text), 1, n), F.lit("..."))).otherwise(col(text))


def format_count(n: Column | str) -> Column:
    n = col(n)
    return F.when(n < 1_000, n.cast("string")).when(n < 1_000_000, F.format_string("%.1fk", n / 1_000)).otherwise(F.format_string("%.2fM", n / 1_000_000))


def format_cost(usd: Column | str) -> Column:
    usd = col(usd).cast("double")
    return F.when(usd <= 0, "$0.00").when(usd < 0.01, F.format_string("$%.4f", usd)).when(usd < 1, F.format_string("$%.3f", usd)).otherwise(F.format_string("$%.2f", usd))


def looks_like_error(text: Column | str) -> Column:
    """A tool result that failed: one of three openings within the first 60 characters, or a missing file."""
    head = F.substring(F.ltrim(col(text)), 1, 60)
    openings = ("Error:", "error:", "Tool error:")
    return F.coalesce(F.contains(F.lower(col(text)), F.lit("file not found")), F.lit(False)) | F.coalesce(_any(F.startswith(head, F.lit(o)) for o in openings), F.lit(False))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def max_line(text: Column | str) -> Column:
    """The highest line number at the start of a numbered line; else the total in ``of N)``; else null."""
    numbers = F.transform(F.regexp_extract_all(col(text), F.lit(r"(?m)^\s*(\d{1,9})\s{2,}"), 1), lambda x: x.cast("int"))
    total = F.regexp_extract(col(text), r"of\s+(\d{1,9})\s*\)", 1)
    return F.coalesce(F.array_max(numbers), F.when(total != "", total.cast("int")))


def strip_markup(text: Column | str) -> Column:
    """Puts a note in the place of fabricated tool-call markup."""
    markup = r"(?is)<tool_call>.*?</tool_call>|<tool_response>.*?</tool_response>|<function_calls>.*?</function_calls>|<function_results>.*?</function_results>|```(?:tool_call|tool_response|function_calls)\s.*?```"
    return F.trim(F.regexp_replace(col(text), markup, "[removed: fabricated tool-call markup]"))


def path_variants(path: Column | str) -> Column:
    """The path first; without leading ``.`` and ``/``, without or with ``./``, and for absolute paths every trailing part."""
    path = col(path)
    bare, dotted = F.regexp_replace(path, r"^[./]+", ""), F.startswith(path, F.lit("./"))
    other = F.when(dotted, F.substring(path, 3, 1 << 30)).otherwise(F.concat(F.lit("./"), path))
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    n = F.size(parts)
    tails = F.when(F.startswith(path, F.lit("/")), F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(F.array(path, bare, other), tails)), lambda x: x != "")


#: What ends a line.
LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def split_lines(text: Column | str) -> Column:
    """The lines of a text, each with its line end; a last line may have none, an empty text has no lines."""
    return F.regexp_extract_all(col(text), F.lit(rf"([^{LINE_END}]*(?:\r\n|[{LINE_END}])|[^{LINE_END}]+)"), F.lit(1))


def lines_of_first(text: Column | str) -> Column:
    """How many of a text's :func:`split_lines` its first line, up to a line feed, is; 1 at least."""
    return F.greatest(F.size(split_lines(F.regexp_extract(col(text), r"\A[^\n]*\n?", 0))), F.lit(1))


def glob_to_regex(glob: str) -> str:
    """fnmatch semantics as a Java pattern: ``*`` and ``?`` also match a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A(?:{out})\z"


def glob_match(name: Column | str, glob: Column) -> Column:
    """fnmatch where the glob is a column without character classes."""
    quoted = F.regexp_replace(glob, r"([\\.^$|+(){}\[\]])", r"\\$1")
    return F.regexp_like(col(name), F.concat(F.lit(r"(?s)\A(?:"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r")\z")))


def lenient(text: Column | str) -> Column:
    """A text without blanks at line ends and at both its ends, for comparing patches."""
    return F.regexp_replace(F.regexp_replace(col(text), r"[ \t\r\f\x0b]+(?=\n|\z)", ""), r"^\s+|\s+\z", "")


def callee_parts(text: Column | str) -> tuple[Column, Column]:
    """(name, receiver) of a callee text; null name where it is no identifier of letters, digits and underscores."""
    text = col(text)
    name = F.substring_index(text, ".", -1)
    receiver = F.when(F.contains(text, F.lit(".")), F.regexp_extract(text, r"(?s)^(.*)\.[^.]*$", 1))
    return F.when(F.regexp_like(name, F.lit(r"(?U)\A[\p{L}_][\w]*\z")), name), receiver


def qualified_name(path: Column | str, cls: Column | str, name: Column | str, line: Column | str) -> Column:
    own = F.coalesce(col(name), F.concat(F.lit("<anon>@L"), col(line).cast("string")))
    return F.concat(col(path), F.lit("::"), F.coalesce(F.concat(col(cls), F.lit(".")), F.lit("")), own)


def lenient_json(text: Column | str) -> Column:
    """The longest brace block of a text, without a code fence around it, if it is JSON; else null."""
    bare = F.regexp_replace(col(text), r"(?s)```(?:json)?\s*(.*?)```", "$1")
    block = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(block).isNotNull() & (block != ""), block)


def has_code_snippet(text: Column | str) -> Column:
    """A filled fence; or three filled lines, two of them code-like, and half of them code-like or indented."""
    text = F.coalesce(col(text), F.lit(""))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    mark = r";\s*$|[{}]\s*$|=>|\bdef\s|\bfunction\s|\bclass\s|\breturn\s|#include|\bimport\s|\bpublic\s|\bprivate\s|\bstatic\s|\bconst\s|\blet\s|\bvar\s|\bif\s*\(|\bfor\s*\(|\bwhile\s*\("
    code = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(mark))))
    indented = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^[ \t]"))))
    return F.regexp_like(text, F.lit(r"(?s)```[A-Za-z0-9_+-]*\n\s*[^\s`].*?```")) | ((F.size(lines) >= 3) & (code >= 2) & ((code + indented) * 2 >= F.size(lines)))


#: Words that mark a settings request by themselves, nouns that do so with a verb, and those verbs.
CONFIG_WORDS = "api key|apikey|api-key|密钥|钥匙|endpoint|api url|base url|接口|端点|budget|预算|额度|cost|成本|花费|费用|花了多少|多少钱"
CONFIG_NOUNS = r"url|model|模型|\bmode\b|模式|profile|配置文件|config|settings|配置|设置"
CONFIG_VERBS = "set|change|switch|update|use|configure|make it|show|open|改|换|设置|设成|调|切换|更新|配置成|用|显示|查看|打开"
#: Words that ask for a list of models, for which no verb is needed.
MODEL_WORDS, LIST_WORDS = "model|模型", "list|available|有哪些|列出|支持哪些"
#: Request labels in order, the first match wins.
REQUEST_LABELS = [
    ("dedup", "dedup|redundan|duplicate|duplication|dead code|重复|冗余|去重|死代码"),
    ("audit", "audit|scan|vulnerab|security|exploit|cve|审计|扫描|漏洞|安全|全仓"),
    ("review", "review|diff|commit|pull request|this change|check this file|look at this file|审查|检查这个|看看这个|看一下|读取这个"),
]


def request_label(text: Column | str) -> Column:
    """config, dedup, audit or review by their words; review where only a path stands; else capability."""
    low = F.lower(col(text))
    has = lambda p: F.regexp_like(low, F.lit(p))
    out = F.when(request_path(text).isNotNull(), "review").otherwise("capability")
    for label, pattern in reversed(REQUEST_LABELS):
        out = F.when(has(pattern), label).otherwise(out)
    return F.when(has(CONFIG_WORDS) | (has(MODEL_WORDS) & has(LIST_WORDS)) | (has(CONFIG_NOUNS) & has(CONFIG_VERBS)), "config").otherwise(out)


#: Shapes of paths (quoted file, Windows, network, absolute file, relative).
REQUEST_PATH = r'''(?i)("[^"]+\.[a-z0-9]{1,8}"|'[^']+\.[a-z0-9]{1,8}'|[A-Z]:\\[^\s"',]+|\\\\[^\s"',]+|/(?:[^/\s"',]+/)*[^/\s"',]+\.[a-z0-9]{1,8}|\.{1,2}/[^\s"',]+)'''


def request_path(text: Column | str) -> Column:
    found = F.regexp_replace(F.regexp_extract(col(text), REQUEST_PATH, 1), r"""^["']|["']$""", "")
    return F.nullif(found, F.lit(""))


def request_ref(text: Column | str) -> Column:
    """The first git reference, or null."""
    return F.nullif(F.regexp_extract(col(text), r"\b(HEAD(?:~\d+|\^+)?|[a-f0-9]{7,40})\b", 1), F.lit(""))
