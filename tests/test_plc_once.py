"""Controller files are made once for all rules, and context is gathered only where a rule asks for it."""

from pyspark.sql import functions as F

from auditlake.operators import plc_pack, rules


def test_files_are_read_once(spark, tmp_path):
    place = str(tmp_path / "files")
    spark.createDataFrame([("a", "p^ := u;\ns := list[at];"), (None, "o_x := TRUE;")], "path string, content string").write.parquet(place)
    found = plc_pack.scan_plc(spark.read.parquet(place))
    assert not any(place in f for f in found.inputFiles())  # rules read what is stored


def test_context_of_some_rows(spark):
    rows = [(k, i, "hit" if i % 7 == 3 else str(i)) for k in ("a", None) for i in range(1, 40)] + [("b", 1, "none")]
    lines = spark.createDataFrame(rows, "path string, line_no int, text string")
    hit = F.col("text") == "hit"
    some = rules.with_context(lines, 2, 3, piece=8, of=hit).select(*lines.columns, "context")
    every = rules.with_context(lines, 2, 3, piece=8).filter(hit).select(*lines.columns, "context")
    assert sorted(some.collect(), key=str) == sorted(every.collect(), key=str) and some.count() == 12
