"""Rules from a table: the literals of patterns, and thousands of rules in one scan."""

import random
import re

from auditlake.operators import literals, rules

RULE = "rule_id string, name string, severity string, pattern string, description string, suggestion string"


def test_required_literals():
    cases = {
        r"password\s*=": ["password"],
        r"(?i)PassWord|api[_-]?KEY": ["password", "api"],
        r"^\s*GOTO\s+\w+": ["goto"],
        r"(?:foo|barbaz)+qux": ["qux"],
        r"x{2,}(secret){1,3}": ["secret"],
        r"(?:secret)?\d+": None,
        r"[abc]+": None,
        r"ab": None,
        r"\p{L}+secret": None,
        r"(?iu)secret": None,
        r"a(?=lookahead)": None,
        r"before(?!after)": ["before"],
        r"größe": None,
        r"(": None,
        "": None,
    }
    assert {p: literals.required(p) for p in cases} == cases


def test_ten_thousand_rules(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    words = [word() for _ in range(3000)]
    table = [(f"R{i}", "n", "info", rf"(?i)\b{rng.choice(words)}\s+{rng.choice(words)}" if i % 3 else rf"({rng.choice(words)}|{rng.choice(words)})=\d", "d", None) for i in range(10_000)]
    table += [("any", "n", "info", r"\d{6,}", "d", None), ("unicode", "n", "info", r"(?iu)ÄPFEL", "d", None), ("java", "n", "info", r"\p{Lu}{5}", "d", None), ("case", "n", "info", "Kelvin", "d", None)]
    lines = [("f", i, " ".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", "", "=1"]) for _ in range(6))) for i in range(300)]
    lines += [("f", 1000, "äpfel 1234567"), ("f", 1001, "// 1234567"), ("f", 1002, None), ("f", 1003, ""), ("f", 1004, "kelvin Kelvin ABCDE")]
    got = rules.scan_rules(spark.createDataFrame(lines, "path string, line_no int, text string"), rules.rule_table(spark, table))
    found = {(r.line_no, r.rule_id) for r in got.collect()}
    plain = [(k, re.compile(p)) for k, _, _, p, _, _ in table[:10_001]]
    want = {(i, k) for _, i, t in lines if t and not t.startswith("//") for k, p in plain if p.search(t)}
    assert {f for f in found if f[1] not in ("unicode", "java", "case")} == want
    assert len(want) > 20
    assert {f for f in found if f[1] in ("unicode", "java", "case")} - {(i, "java") for i in range(300)} == {(1000, "unicode"), (1004, "java"), (1004, "case")}
    assert rules.scan_rules(spark.createDataFrame(lines, "path string, line_no int, text string"), rules.rule_table(spark, [])).count() == 0


def test_a_list_of_rules_tries_lines_with_their_literals(spark):
    made = [("S", "s", "info", r"(?i)(api[_-]?key|token)\s*[:=]", None, None), ("M", "m", "info", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", None, None), ("N", "n", "info", r"(^|[^0-9])[0-9]{5,}", None, None)]
    assert [literals.required(r[3], 1) for r in made[1:]] == [["@"], None] and literals.required(made[1][3]) is None
    texts = ["API_KEY: x", "a ToKeN = 1", "token", "me@home.example", "@", "no 12345 yes", "1234", None, "", "tOKEN:5@b 99999"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "path string, line_no int, text string")
    want = {(i, r[0]) for i, t in enumerate(texts) for r in made if t and re.search(r[3], t)}
    found = rules.scan_rules(lines, made)
    assert {(r.line_no, r.rule_id) for r in found.collect()} == want and len(want) == 7
