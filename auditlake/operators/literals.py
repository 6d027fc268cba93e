"""Which literals a regular expression cannot match without, and which rows hold some of them.

Of a pattern the parts that every match must have are read off; of the best of them, alternatives of ASCII text, one at
least stands in any text that matches. An Aho-Corasick automaton over all rules' alternatives finds in one pass over a
text the rules that can match it at all; only those are tried. Patterns without such a literal are tried on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST = 3
RULES_A_SCAN = 50_000
_FOLD = {c: c + 32 for c in range(65, 91)}


def required(pattern: str, least: int = LEAST) -> list[str] | None:
    """Texts in lower case, of ``least`` characters or more, of which every match of ``pattern`` holds one; null where nothing can be told.

    Patterns that this module cannot read (other dialects), and those that fold letters beyond ASCII, give null.
    """
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if re.search(r"\(\?[a-zA-Z]*u", pattern) or re.search(r"\(\?[a-zA-Z]*U", pattern) and re.search(r"\(\?[a-zA-Z]*i", pattern):
        return None
    found = _clauses(parsed)
    best = max(found, key=lambda c: (min(map(len, c)), -len(c)), default=None)
    return best if best and min(map(len, best)) >= least else None


def _clauses(parsed) -> list[list[str]]:
    """What stands in every match: of each list one text at least."""
    out, run = [], ""

    def close() -> None:
        nonlocal run
        if run:
            out.append([run.translate(_FOLD)])
        run = ""

    for op, value in parsed:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value)
            continue
        if name == "AT":  # of no width
            continue
        close()
        if name == "SUBPATTERN":
            out += _clauses(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            out += _clauses(value[2])
        elif name == "ATOMIC_GROUP":
            out += _clauses(value)
        elif name == "BRANCH":
            ways = [max(_clauses(way), key=lambda c: min(map(len, c)), default=None) for way in value[1]]
            if all(ways):
                out.append([text for way in ways for text in way])
    close()
    return out


def candidates(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with every row of ``rules`` (with a ``pattern``) that may match: a row for each.

    Rules come to the driver and go to all workers ``RULES_A_SCAN`` at a time, their patterns' literals only; each part
    is a scan of the texts.
    """
    spark, numbered = texts.sparkSession, rules.withColumn("_rule", F.monotonically_increasing_id()).collect()
    if not numbered:
        return texts.crossJoin(F.broadcast(rules.limit(0)))
    out = None
    for at in range(0, len(numbered), RULES_A_SCAN):
        some = numbered[at : at + RULES_A_SCAN]
        needs = [required(r["pattern"]) for r in some]
        part = spark.createDataFrame([(*r[:-1], i) for i, r in enumerate(some)], rules.withColumn("_rule", F.lit(0)).schema)
        always = [i for i, n in enumerate(needs) if n is None]
        shared = spark.sparkContext.broadcast((always, [(t, i) for i, n in enumerate(needs) for t in n or ()]))
        scan = texts.mapInArrow(_scanner(shared, texts.columns.index(text)), f"{_ddl(texts)}, _rule int")
        met = scan.join(F.broadcast(part), "_rule").drop("_rule")
        out = met if out is None else out.unionByName(met)
    return out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _scanner(shared, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        always, literals = shared.value
        automaton, of = ahocorasick.Automaton(), {}
        for literal, rule in literals:
            of.setdefault(literal, []).append(rule)
        for literal, own in of.items():
            automaton.add_word(literal, own)
        if of:
            automaton.make_automaton()
        for batch in batches:
            rows, rules = [], []
            for i, text in enumerate(batch.column(place).to_pylist()):
                if text is None:
                    continue
                found = {r for _, own in automaton.iter(text.translate(_FOLD)) for r in own} if of else set()
                own = [*always, *sorted(found)]
                rows += [i] * len(own)
                rules += own
            taken = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(rules, pa.int32())], names=[*batch.schema.names, "_rule"])

    return run
