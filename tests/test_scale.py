"""What makes steps grow with their input alone, and the same results as plain ways give."""

import numpy as np
from pyspark.sql import functions as F

from auditlake.operators import flow, guidelines, symbols


def test_imports_are_looked_up_once_for_each_folded_path(spark):
    """Candidates are made after the paths are made distinct, so a thousand imports of one module are one lookup."""
    imports = spark.range(1000).select(F.lit("r").alias("repo"), F.lit("src/a.ts").alias("path"), F.col("id").alias("line"), F.lit("./../src/./b").alias("source"))
    files = spark.createDataFrame([("r", "src/b.js")], "repo string, path string")
    got = symbols.resolve_imports(imports.unionByName(spark.createDataFrame([("r", "src/a.ts", -1, None), ("r", "src/a.ts", -2, "react")], "repo string, path string, line long, source string")), files)
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, x in enumerate(lines) if "posexplode" in x)
    assert any("Aggregate" in x for x in lines[made:])
    rows = {r.line: (r.resolved, r.is_external) for r in got.collect()}
    assert len(rows) == 1002 and rows[5] == ("src/b.js", False) and rows[-1] == (None, None) and rows[-2] == (None, True)


def test_search_compares_blocks_and_is_exact(spark):
    """Vectors come to the task in blocks, copies and zero vectors too; ties go to the smaller id."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 8)).round(2)
    x[5:650:5] = x[0]
    x[7] = 0
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    odd = spark.createDataFrame([(900, [1.0]), (901, [float("nan")] * 8), (902, None)], rows.schema)
    queries = rows.filter("id < 300").withColumnRenamed("id", "query_id")
    found = guidelines.search(rows.unionByName(odd), queries, 4, "id")
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    unit = x / np.where((n := np.linalg.norm(x, axis=1)) > 0, n, np.nan)[:, None]
    for q in range(300):
        s = unit @ unit[q]
        best = sorted((i for i in range(700) if np.isfinite(s[i])), key=lambda i: (-round(s[i], 12), i))[:4]
        assert [i for i, _ in got.get(q, [])] == best and np.allclose([v for _, v in got.get(q, [])], s[best])


def test_patched_files_are_stored_before_they_are_undone(spark, sf):
    from auditlake.plans import more

    stored = more.redone_patches(spark, sf).inputFiles()
    assert any("/patched-" in f for f in stored)  # the edits are applied once, not in each of the three reads


def test_flow_files_share_a_pass(spark):
    nodes = spark.createDataFrame([(p, n) for p in range(50) for n in range(4)], "path long, node int")
    edges = spark.createDataFrame([(p, 0, 1, 0) for p in range(50)] + [(p, 1, 0, 0) for p in range(50)] + [(99, 0, 3, 0)], "path long, src int, dst int, edge_no int")
    gone = flow.unreachable(nodes, edges)
    assert "FlatMapCoGroups" not in gone._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, gone.collect())) == [(p, n) for p in range(50) for n in (2, 3)]
    stmts = nodes.select("path", F.col("node").alias("stmt_id"), F.col("node").alias("block_id"), F.when(F.col("path") % 2 == 0, F.lit("EXIT;")).otherwise("x := 1;").alias("text"))
    loops = flow.endless_loops(stmts, edges)
    assert "FlatMapCoGroups" not in loops._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, loops.collect())) == [(p, 0, 1) for p in range(1, 50, 2)]
