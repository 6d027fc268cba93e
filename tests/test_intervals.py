"""Interval joins, patch paths and clashes against plain loops; undo as a session."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators import clones, history, intervals, patches, rules, scans, symbols

OPS = "patchset_id string, op_idx int, op_type string, file_path string, line_start int, line_end int, old_content string, new_content string, new_path string, reason string"


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), a, a + int(2 ** rng.uniform(-1, 9)) - rng.choice([0, 0, 2]), i) for i in range(300) for a in [rng.randint(-5, 600)]]
    return rows, spark.createDataFrame([*rows, (None, 1, 5, 999)], "path string, lo int, hi int, id int")


def test_points_in_spans(spark, spans):
    rows, table = spans
    points = spark.createDataFrame([(p, x) for p in ("a", "b", "c", None) for x in range(-8, 700, 3)], "path string, at int")
    got = sorted((r.path, r["at"], r.id) for r in intervals.around(points, table, ["path"], "at", "lo", "hi").collect())
    assert got == sorted((p, x, i) for p in "ab" for x in range(-8, 700, 3) for q, a, b, i in rows if p == q and a <= x <= b)
    assert intervals.around(points, table.limit(0), ["path"], "at", "lo", "hi").count() == 0


def test_ranges_that_meet(spark, spans):
    rows, table = spans
    left, right = table.filter("id % 3 = 0").select("path", F.col("lo").alias("low"), F.col("hi").alias("high"), "id"), table.filter("id % 3 > 0").select("path", F.col("lo").alias("_low"), F.col("hi").alias("_high"), F.col("id").alias("other"))
    got = {(r.id, r.other) for r in intervals.overlapping(left, right, ["path"]).collect()}
    assert got == {(x[3], y[3]) for x in rows for y in rows if x[3] % 3 == 0 and y[3] % 3 and x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]}


def test_innermost_functions_and_changed_blocks(spark):
    spans = [("outer", 1, 100), ("inner", 10, 20), ("twin", 10, 20), ("late", 15, 40)]
    fps = spark.createDataFrame([("f", *s) for s in spans], "path string, id string, line_start int, line_end int")
    points = spark.createDataFrame([("f", n) for n in (1, 12, 18, 30, 101)], "path string, line int")
    assert {r.line: r.id for r in clones.function_at(fps, points).collect()} == {1: "outer", 12: "inner", 18: "inner", 30: "late"}
    named = fps.withColumns({"repo": F.lit("r"), "name": F.col("id")})
    found = symbols.enclosing_function(points.withColumn("repo", F.lit("r")), named).collect()
    assert {r.line: (r.function, r.function_line) for r in found} == {1: ("outer", 1), 12: ("inner", 10), 18: ("inner", 10), 30: ("late", 15), 101: (None, None)}
    blocks = fps.select("path", F.col("id").alias("name"), F.lit("x").alias("block_type"), "line_start", "line_end")
    ranges = spark.createDataFrame([("f", 12, 90), ("f", 200, 201), ("g", 1, 2)], "path string, start_line int, end_line int")
    assert {(r.path, r.start_line): r.name for r in rules.changed_blocks(ranges, blocks).collect()} == {("f", 12): "outer", ("f", 200): None, ("g", 1): None}


def test_paths_that_escape(spark):
    cases = {"a.py": False, "./a.py": False, "src/../a.py": False, "..": True, "../x": True, "a/../../x": True, "/a": True, "a/b/../..": False, "": False, "a..b": False, "a/../../b/x": True}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", S.escapes("p").alias("e"), S.normal_path("p").alias("n")).collect()
    assert {r.p: r.e for r in rows} == cases
    assert {r.p: r.n for r in rows if r.p in ("./a.py", "src/../a.py", "a/b/../..")} == {"./a.py": "a.py", "src/../a.py": "a.py", "a/b/../..": ""}


def test_patches_by_other_names_of_their_files(spark):
    files = spark.createDataFrame([("a.py", "l1\nl2\n"), ("b.py", "x")], "path string, content string")
    rows = [("1", 0, "edit", "./a.py", 1, 1, "l1", "L1", None, ""), ("2", 0, "edit", "src/../a.py", 2, 2, "l2", "L2", None, ""), ("3", 0, "create_file", "./b.py", None, None, None, "y", None, ""), ("4", 0, "rename", "b.py", None, None, None, None, "d/../a.py", ""), ("5", 0, "edit", "x/.././a.py", 1, 1, "l1", "M", None, "")]
    ops = spark.createDataFrame(rows, OPS)
    assert {r.patchset_id: r.reason for r in patches.can_apply(ops, files).collect()} == {"1": None, "2": None, "3": "file exists already", "4": "target exists already", "5": "overlaps an earlier op"}
    assert {r.path: r.content for r in patches.apply_patches(files, ops).collect()} == {"a.py": "L1\nL2", "b.py": "x"}
    lines = spark.createDataFrame([("a.py", 1, "l1")], "path string, line_no int, text string")
    found = spark.createDataFrame([("./a.py", 1, "t"), ("../a.py", 1, "t"), ("b/../a.py", 1, "t")], "file_path string, line_start int, title string")
    assert {r.file_path for r in history.with_fingerprint(found, lines).filter("line_content_hash is not null").collect()} == {"./a.py", "b/../a.py"}


def test_clashes_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        for i in range(rng.randint(1, 3)):
            kind, a = rng.choice(["edit", "delete_lines", "edit", "delete_file", "rename"]), rng.randint(1, 40)
            rows.append((f"{k:02}", i, kind, rng.choice("abcde"), a, a + rng.choice([0, 1, 3, 12]), "", "", rng.choice("xyz") if kind == "rename" else None, ""))
    claims = [(s, i, kind in ("edit", "delete_lines"), a, b, p) for s, i, kind, f, a, b, _, _, to, _ in rows for p in {f, to} - {None}]
    want = set()
    for s, i, e, a, b, p in claims:
        for t, j, o, c, d, q in claims:
            meet = p == q and (not e or not o or (a <= d and c <= b))
            if meet and (t < s or (t == s and e and o and j < i)):
                want.add((s, i))
    assert {tuple(r) for r in patches._clashes(spark.createDataFrame(rows, OPS)).collect()} == want


def test_undo_of_undo(spark):
    before = {"a.py": "1\n", "b.py": "b"}
    files = spark.createDataFrame([*before.items()], "path string, content string")
    first = spark.createDataFrame([("p", 0, "edit", "./a.py", 1, 1, "1", "2", None, ""), ("p", 1, "create_file", "new.py", None, None, None, "n", None, ""), ("p", 2, "delete_file", "b.py", None, None, None, None, None, "")], OPS)
    kept = patches.snapshot(files, first, "s1")
    one = patches.apply_patches(files, first)
    second = spark.createDataFrame([("q", 0, "edit", "a.py", 1, 1, "2", "3", None, "")], OPS)
    kept = patches.snapshot(one, second, "s2", earlier=kept)
    two = patches.apply_patches(one, second)
    show = lambda df: {r.path: r.content for r in df.collect()}
    undone, kept, warned = patches.undo_session(two, kept, "s1", "u1")
    assert show(undone) == before
    assert warned.count() == 0
    again, kept, _ = patches.undo_session(undone, kept, "u1", "u2")
    assert show(again) == show(two) == {"a.py": "3", "new.py": "n"}
    back, kept, _ = patches.undo_session(again, kept, "s2", "u3")
    assert show(back) == {"a.py": "2", "new.py": "n"}
    assert {r.session_id for r in kept.select("session_id").distinct().collect()} == {"s1", "s2", "u1", "u2", "u3"}


@pytest.mark.parametrize("piece", [4, scans.PIECE])
def test_scans_over_pieces(spark, piece):
    rng = random.Random(7)
    rows = [(p, i, rng.choice([-1, 0, 1]), rng.choice([None, None, f"m{i}"])) for p in "ab" for i in range(1, 40)]
    df = spark.createDataFrame(rows, "path string, n int, step int, mark string")
    summed = {(r.path, r.n): (r.s, r.low) for r in scans.running(df, ["path"], "n", F.col("step"), "s", "low", piece).collect()}
    last = {(r.path, r.n): r["last"] for r in scans.last_mark(df, ["path"], "n", F.col("mark"), "last", piece=piece).collect()}
    following = {(r.path, r.n): r["next"] for r in scans.last_mark(df, ["path"], "n", F.col("mark"), "next", own=False, reverse=True, piece=piece).collect()}
    near = {(r.path, r.n): r.near for r in scans.lines_around(df, ["path"], "n", "n", 3, 2, "near", piece).collect()}
    for p in "ab":
        own, total, low, mark = [r for r in rows if r[0] == p], 0, 99, None
        for i, (_, n, step, m) in enumerate(own):
            total += step
            low, mark = min(low, total), m or mark
            assert summed[p, n] == (total, low)
            assert last[p, n] == mark
            assert following[p, n] == next((r[3] for r in own[i + 1 :] if r[3]), None)
            assert near[p, n] == [r[1] for r in own[max(0, i - 3) : i + 3]]


def test_rules_on_files_cut_into_pieces(spark):
    rng = random.Random(9)
    choices = ["IF a THEN", "END_IF;", "x := 1;", "x := 2;", "p^ := q;", "IF p <> NIL THEN", "PROGRAM m", "END_PROGRAM", "// IF a", "y := 3;"]
    rows = [(p, i, rng.choice(choices)) for p in "ab" for i in range(1, 80)]
    lines = spark.createDataFrame(rows, "path string, line_no int, text string")
    assigned = lines.filter("text rlike '^[xy] :='").withColumn("var", F.substring("text", 1, 1))

    def every(piece):
        deep = rules.nesting_depth(lines, "^IF", "^END_IF", piece).select("path", "line_no", "depth")
        inside = rules.in_block(lines, "^PROGRAM", "^END_PROGRAM", piece).select("path", "line_no", "inside")
        open_ = rules.guarded_hits(lines, F.contains("text", F.lit("^")), "NIL", 5, 2, piece).select("path", "line_no", "context")
        again = rules.close_rewrites(assigned, 3, piece).select("path", "line_no", "next_line")
        return [sorted(map(tuple, x.collect())) for x in (deep, inside, open_, again)]

    small, whole = every(6), every(scans.PIECE)
    assert small == whole
    assert all(whole)
    depth, want = 0, []
    for i, text in [(r[1], r[2]) for r in rows if r[0] == "a"]:
        depth = max(0, depth + (text.startswith("IF")) - text.startswith("END_IF"))
        want.append(("a", i, depth))
    assert [r for r in whole[0] if r[0] == "a"] == want


@pytest.mark.parametrize("piece", [5, scans.PIECE])
def test_next_row_that_is_no_higher(spark, piece):
    rng = random.Random(4)
    rows = [(p, i, rng.choice([0, 1, 1, 2, 2, 3, 4]), rng.random() < 0.7) for p in ("a", "b") for i in range(70)] + [("c", i, i, True) for i in range(30)]
    df = spark.createDataFrame(rows, "path string, n int, v int, s boolean")
    got = {(r.path, r.n): r.stop for r in scans.next_not_above(df, ["path"], "n", "v", F.col("s"), "stop", piece).collect()}
    assert got == {(p, n): next((m for q, m, w, s in rows if q == p and m > n and s and w <= v), None) for p, n, v, _ in rows}


def test_declarations_by_a_user_and_in_pieces(spark):
    import pandas as pd

    code = "\n".join(f"class A{i}:\n    def f{i}(self):\n        x = 1\n\n        return x\n\n    y = 2" for i in range(6))
    files = spark.createDataFrame([("r", "a.py", "python", code), ("r", "n.py", "python", None)], "repo string, path string, language string, content string")
    spans = {r.name: (r.line_start, r.line_end) for r in symbols.extract_declarations(files, 4).collect()}
    assert spans == {r.name: (r.line_start, r.line_end) for r in symbols.extract_declarations(files).collect()}
    assert spans["A0"] == (1, 7)
    assert spans["f1"] == (9, 13)

    def own(batches):
        for batch in batches:
            rows = [(r.repo, r.path, "line", t, i, i) for r in batch.itertuples() for i, t in enumerate((r.content or "").split("\n"), 1) if t.startswith("class")]
            yield pd.DataFrame(rows, columns=["repo", "path", "kind", "name", "line_start", "line_end"])

    assert symbols.extract_with(files, own).filter("name = 'class A5:' and line_start = 36").count() == 1
