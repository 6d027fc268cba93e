"""Patch queries against their SQL on documents without a text, a size or a line, and with line ends of other kinds."""

import duckdb
import pytest

from auditlake.functions import scalars as S
from auditlake.plans import catalog

TEXTS = ["", "\n", "\n\nx", "  \nx", "ab\rcd\nef", "ab\r\nc", "\r", "ab\x0b\ncd", "ab \x85\nc", "ab \n", "x\x1e", "ab\ncd", "something else\nx", "something else\nxy", "é\U0001f600 \nx"]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(t, n) for t in TEXTS for n in (len(t), 2, 3, None)] + [(None, n) for n in (0, 2, 3, None)]
    place = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, "en", "s", n) for i, (t, n) in enumerate(rows)], SHAPE).coalesce(1).write.parquet(f"{place}/documents.parquet")
    return place


def _both(spark, place, name, where="true"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{place}/documents.parquet/*.parquet'")
    want = con.execute(f"FROM ({catalog.ORACLE_SQL[name]}) WHERE {where}").fetchall()
    return sorted(map(tuple, catalog.QUERIES[name](spark, place).filter(where).collect()), key=str), sorted(want, key=str)


def test_verdicts_on_odd_documents(spark, odd):
    got, want = _both(spark, odd, "can_apply")
    assert len(got) == 4 * len(TEXTS) + 4 and got == want


def test_first_lines_with_other_line_ends(spark, odd):
    got, want = _both(spark, odd, "apply_patches", f"path::int < {4 * len(TEXTS)}")  # documents with a text
    assert len(got) == 4 * len(TEXTS) and got == want


def test_blanks_before_other_line_ends(spark):
    rows = spark.createDataFrame([("ab \x85\n", "ab \x85"), ("ab  \n", "ab  ")], "a string, b string")
    assert all(r.a == r.b for r in rows.select(S.lenient("a").alias("a"), S.lenient("b").alias("b")).collect())
