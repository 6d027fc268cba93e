"""The library's operators on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators import clones, corpus, findings as fnd, flow, grounding, guidelines, history, packs, patches, plc_pack, rules, symbols, usage
from auditlake.sources import analyzers, files as src

UTIL = """function formatUserName(user) {
  const first = user.first; // name
  return first + ' ' + user.last;
}
"""


def test_clone_tokens_and_groups(spark):
    rows = [("u.js", "formatUserName", UTIL), ("u.js", "buildDisplayName", UTIL.replace("first", "given").replace("user", "person").replace("' '", '"-"').replace("formatUserName", "buildDisplayName")), ("u.js", "short", "a();")]
    f = spark.createDataFrame([(p, n, None, i * 10, i * 10 + 3, b) for i, (p, n, b) in enumerate(rows)], "path string, name string, enclosing_class string, line_start int, line_end int, body string")
    fps = clones.fingerprint_functions(f)
    groups = clones.duplicate_groups(fps).collect()
    assert len(groups) == 1 and groups[0].n_members == 2
    toks = spark.range(1).select(clones.tokens(F.lit("if (a === 1.5) /* x */ b('s'); // c"))).first()[0]
    assert toks == ["if", "(", "p1", "==", "=", "NUM_", ")", "p2", "(", "STR_", ")", ";"]
    files = spark.createDataFrame([("u.js", "\n" * 9 + UTIL)], "path string, content string")
    ops = clones.dedup_patches(fps, clones.duplicate_groups(fps), files)
    assert [(r.op_type, r.file_path, r.old_content is None) for r in ops.collect()] == [("delete_lines", "u.js", False)]
    assert clones.group_members(fps, clones.duplicate_groups(fps)).count() == 2


def test_near_duplicates_are_symmetric_and_exact(spark):
    texts = [" ".join(f"t{(i * 7 + j) % 50 if j < 40 - i else i * 100 + j}" for j in range(60)) for i in range(8)]
    df = spark.createDataFrame([(str(i), str(i), t.split()) for i, t in enumerate(texts)], "id string, structural_hash string, w array<string>")
    fps = df.select("id", "structural_hash", clones.shingles("w", 3).alias("shingles"))
    got = {(r.left, r.right) for r in clones.near_duplicate_pairs(fps, 0.3).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(58)} for t in texts]
    want = {(str(i), str(j)) for i in range(8) for j in range(i + 1, 8) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.3}
    assert got == want


def test_corpus(spark):
    files = spark.createDataFrame([("r", "package.json", ".json", '{"dependencies": {"express": "1"}, "devDependencies": {"vue": "2"}}'), ("r", "src/a.js", ".js", "x"), ("r", "src/b.js", ".JS", "x"), ("r", "c.py", ".py", "x"), ("r", "node_modules/z.js", ".js", "x"), ("p", "m.xml", ".xml", "<a>TwinCAT</a>"), ("p", "x.bin", ".bin", "")], "repo string, path string, ext string, content string")
    fp = {r.repo: r for r in corpus.fingerprint(corpus.without_ignored(files)).collect()}
    assert fp["r"].primary_language == "javascript" and fp["r"].frameworks == ["express", "vue"] and fp["r"].suggested_profile == "js"
    assert fp["p"].plc_vendor == "beckhoff" and fp["p"].suggested_profile == "plc"
    both = corpus.profiles_for(spark.createDataFrame([("a.m", ".m")], "path string, ext string"))
    assert sorted(r.profile for r in both.collect()) == ["matlab", "objc"]
    assert corpus.read_lines(files, "src/a.js").collect()[0].n_more == 0


ST = """PROGRAM Main
VAR_INPUT
  Speed : REAL := 100.0;
  i_Temp : INT;
END_VAR
VAR_OUTPUT
  Motor : BOOL;
END_VAR
VAR
  unused : INT;
  t : INT := 5;
END_VAR
o_Motor := TRUE;
o_Motor := FALSE;
t := i_Temp / Speed;
IF t > 123456 THEN GOTO done; END_IF;
// GOTO comment;
RETURN;
END_PROGRAM"""


def test_plc_rules(spark):
    f = spark.createDataFrame([("m.st", ST), ("e.st", "")], "path string, content string")
    got = {r.rule_id for r in plc_pack.scan_plc(f).collect() if r.path == "m.st"}
    assert {"PLC-002", "PLC-003", "PLC-006", "PLC-007", "PLC-008", "PLC-009", "PLC-013", "PLC-014", "PLC-016", "PLC-019", "PLC-020", "PLC-024", "PLC-025"} <= got
    v = {r.name: r for r in rules.st_vars(f).collect()}
    assert (v["Speed"].scope, v["Speed"].datatype, v["Speed"].initial_value) == ("VAR_INPUT", "REAL", "100.0")
    lines = f.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")
    b = rules.st_blocks(lines).collect()
    assert [(x.name, x.block_type, x.line_start, x.line_end) for x in b] == [("Main", "PROGRAM", 0, 18)]
    ranges = spark.createDataFrame([("m.st", 3, 4), ("m.st", 40, 41), ("none", 1, 1)], "path string, start_line int, end_line int")
    assert {(r.path, r.start_line): r.name for r in rules.changed_blocks(ranges, rules.st_blocks(lines)).collect()} == {("m.st", 3): "Main", ("m.st", 40): None, ("none", 1): None}
    assert plc_pack.violations_to_findings(plc_pack.scan_plc(f)).filter("severity = 'error'").count() > 0


def test_line_division_in_strings(spark):
    lines = spark.createDataFrame([("a", 1, "x := 'a/b';"), ("a", 2, "x := a / b;")], "path string, line_no int, text string")
    assert [r.line_no for r in rules.scan_rules(lines, plc_pack.LINE_RULES).filter("rule_id = 'PLC-006'").collect()] == [2]


def test_flow_graph(spark):
    nodes = spark.createDataFrame([("f", i) for i in range(5)], "path string, node int")
    edges = spark.createDataFrame([("f", 0, 1, "x"), ("f", 1, 2, "x"), ("f", 2, 1, "x"), ("f", 3, 4, "x")], "path string, src int, dst int, edge_type string")
    assert sorted(r.node for r in flow.unreachable(nodes, edges).collect()) == [3, 4]
    assert flow.complexity(nodes, edges).first().complexity == 1
    st = flow.with_def_use(spark.createDataFrame([("f", 0, 0, 1, "a := 1;"), ("f", 1, 1, 2, "b := a;"), ("f", 2, 2, 3, "c := 2;")], "path string, stmt_id int, block_id int, line_no int, text string"))
    assert [(r["var"], r.def_id) for r in flow.def_use_pairs(st, edges).collect()] == [("a", 0)]
    assert sorted(r["var"] for r in flow.dead_stores(st, edges).collect()) == ["b", "c"]
    assert [r.header for r in flow.endless_loops(st, edges).collect()] == [1]


def test_history(spark):
    f = spark.createDataFrame([("a.py", 3, None, "Bad  Thing", "error", "security", 0.9, "h1")], "file_path string, line_start int, line_end int, title string, severity string, category string, confidence double, line_content_hash string")
    keyed = history.with_fingerprint(f)
    empty = spark.createDataFrame([], history.HISTORY)
    one = history.record_run(empty, keyed, F.timestamp_seconds(F.lit(1)))
    two = history.record_run(one, keyed.unionAll(keyed).withColumn("line_content_hash", F.lit("h2")), F.timestamp_seconds(F.lit(2))).first()
    assert (two.run_count, two.line_content_hash, two.severity) == (3, "h2", "error")
    assert history.compare(keyed, empty).first().status == "new"
    assert history.compare(keyed, one).first().status == "still_present"
    assert history.compare(keyed.withColumn("line_content_hash", F.lit("z")), one).first().status == "maybe_fixed"


def test_grounding(spark):
    calls = spark.createDataFrame([("s", "1", "read_file", {"path": "src/server.js"}), ("s", "2", "read_file", {"path": "src/gone.js"})], "session string, id string, name string, args map<string,string>")
    results = spark.createDataFrame([("s", "1", "  1  a\n  2  b\n"), ("s", "2", "Error: no")], "session string, id string, content string")
    f = spark.createDataFrame([(p, n) for p, n in (("./src/server.js", 2), ("/x/src/server.js", 9), ("src/auth.js", 1), ("src/gone.js", 1))], "file_path string, line_start int").select(F.lit("s").alias("session"), "*", F.lit("critical").alias("severity"), F.lit(0.9).alias("confidence"), F.lit(True).alias("verified"), F.array(fnd.evidence("x", F.lit("e"))).alias("evidence"), F.lit("agent").alias("detected_by"))
    got = {r.file_path: r for r in grounding.ground(f, grounding.tool_facts(calls, results)).collect()}
    assert [got[p].verdict for p in ("./src/server.js", "/x/src/server.js", "src/auth.js", "src/gone.js")] == ["keep", "downgrade", "drop", "drop"]
    low = got["/x/src/server.js"]
    assert (low.severity, low.confidence, low.verified) == ("warning", 0.4, False) and low.evidence[0].summary.startswith("[ungrounded]")


def test_patches(spark):
    files = spark.createDataFrame([("a.py", "\n".join(f"l{i}" for i in range(1, 11))), ("b.py", "x")], "path string, content string")
    schema = "patchset_id string, op_idx int, op_type string, file_path string, line_start int, line_end int, old_content string, new_content string, new_path string, reason string"
    ops = spark.createDataFrame([("ok", 0, "delete_lines", "a.py", 5, 7, "l5 \nl6\nl7", None, None, ""), ("ok", 1, "edit", "a.py", 1, 1, "l1", "n1\nn2", None, ""), ("ok", 2, "create_file", "new/c.py", None, None, None, "c", None, ""), ("ok", 3, "rename", "b.py", None, None, None, None, "d.py", ""), ("far", 0, "edit", "a.py", 9, 99, "l9", "x", None, ""), ("mis", 0, "edit", "a.py", 1, 1, "zz", "x", None, ""), ("esc", 0, "create_file", "../e", None, None, None, "x", None, "")], schema)
    why = {r.patchset_id: r.reason for r in patches.can_apply(ops, files).collect()}
    assert why["ok"] is None and "line_end" in why["far"] and "match" in why["mis"] and "escape" in why["esc"]
    after = {r.path: r.content for r in patches.apply_patches(files, ops).collect()}
    assert after == {"a.py": "n1\nn2\nl2\nl3\nl4\nl8\nl9\nl10", "new/c.py": "c", "d.py": "x"}
    kept = patches.snapshot(files, ops.filter("patchset_id = 'ok'"), "s1")
    back, warn = patches.undo(patches.apply_patches(files, ops), kept, "s1")
    assert {r.path: r.content for r in back.collect()} == {r.path: r.content for r in files.collect()} and warn.count() == 0


def test_patch_checks(spark):
    files = spark.createDataFrame([("a.py", "l1\nl2\nl3\n"), ("b.py", "x"), ("c.py", "r1\r\nr2")], "path string, content string")
    rows = {
        "bare": ("edit", "a.py", 1, 1, None, "x", None, "needs old_content"),
        "nothing": ("edit", "a.py", 1, 1, "l1", None, None, "edit needs new_content"),
        "made_up": ("replace", "a.py", 1, 1, "l1", "x", None, "unknown op_type"),
        "four": ("edit", "a.py", 4, 4, "", "x", None, "line_end beyond the file"),
        "turned": ("edit", "a.py", 2, 1, "l1", "x", None, "invalid line range"),
        "gone": ("delete_file", "zz", None, None, None, None, None, "file does not exist"),
        "there": ("create_file", "b.py", None, None, None, "x", None, "file exists already"),
        "empty": ("create_file", "n.py", None, None, None, None, None, "create_file needs new_content"),
        "nowhere": ("rename", "b.py", None, None, None, None, None, "rename needs new_path"),
        "out": ("rename", "b.py", None, None, None, None, "../x", "new_path escapes the root"),
        "taken": ("rename", "b.py", None, None, None, None, "a.py", "target exists already"),
        "p1": ("edit", "a.py", 1, 2, "l1\nl2", "A", None, None),
        "p2": ("edit", "a.py", 2, 3, "l2\nl3", "B", None, "overlaps an earlier op"),
        "p3": ("delete_lines", "a.py", 3, 3, "l3 ", None, None, "overlaps an earlier op"),
        "q1": ("delete_file", "b.py", None, None, None, None, None, None),
        "q2": ("edit", "b.py", 1, 1, "x", "y", None, "overlaps an earlier op"),
        "r": ("edit", "c.py", 2, 2, "r2", "s2\ns3", None, None),
        "s": ("create_file", "d/e.py", None, None, None, "new", None, None),
    }
    schema = "patchset_id string, op_idx int, op_type string, file_path string, line_start int, line_end int, old_content string, new_content string, new_path string, reason string"
    ops = spark.createDataFrame([(k, 0, *v[:-1], "") for k, v in rows.items()], schema)
    assert {r.patchset_id: r.reason for r in patches.can_apply(ops, files).collect()} == {k: v[-1] for k, v in rows.items()}
    after = {r.path: r.content for r in patches.apply_patches(files, ops).collect()}
    assert after == {"a.py": "A\nl3\n", "c.py": "r1\r\ns2\ns3", "d/e.py": "new"}
    twice = spark.createDataFrame([("t", i, "edit", "a.py", a, b, c, "x", None, "") for i, (a, b, c) in enumerate([(1, 2, "l1\nl2"), (2, 3, "l2\nl3")])], schema)
    assert patches.can_apply(twice, files).first().reason == "overlaps an earlier op"


def test_grounding_counts_reads_only(spark):
    calls = spark.createDataFrame([("s", "1", "read_file", {"relative_path": "src/a.js", "path": "other"}), ("s", "2", "search", {"path": "src/b.js"}), ("s", "3", "read_file", {"path": "/a/b/utils.js"}), ("s", "4", "read_file", {"relative_path": "", "path": "./src/c.js"}), ("s", "5", "read_file", {"path": "x/d.js"}), ("s", "6", "read_file", {"path": "d.js"})], "session string, id string, name string, args map<string,string>")
    results = spark.createDataFrame([("s", str(i), "  1  a\n  2  b\n" if i < 6 else "  9  z\n") for i in range(1, 7)], "session string, id string, content string")
    paths = {"src/a.js": "keep", "src/b.js": "drop", "/c/d/utils.js": "drop", "/a/b/utils.js": "keep", "src/c.js": "keep", "/r/x/d.js": "downgrade", "other": "drop"}
    f = spark.createDataFrame([(p, 5 if "d.js" in p else 1) for p in paths], "file_path string, line_start int").select(F.lit("s").alias("session"), "*", F.lit("critical").alias("severity"), F.lit(0.9).alias("confidence"), F.lit(True).alias("verified"), F.array(fnd.evidence("x", F.lit("e"))).alias("evidence"), F.lit("agent").alias("detected_by"))
    assert {r.file_path: r.verdict for r in grounding.ground(f, grounding.tool_facts(calls, results)).collect()} == paths


def test_usage_and_formats(spark):
    u = spark.createDataFrame([("s", 1, "x/Claude-Opus-4-7", 1_000_000, 0, 1.0), ("s", 2, "nope", 5, 5, 1.0)], "session string, ts int, model string, input_tokens long, output_tokens long, duration_s double")
    for pricing in (None, usage.pricing_table(spark)):
        assert sorted(r.cost_usd for r in usage.with_cost(u, pricing).collect()) == [0.0, 15.0]
    row = spark.range(1).select(S.format_count(F.lit(1234)), S.format_count(F.lit(1_500_000)), S.format_cost(F.lit(0.005)), S.format_cost(F.lit(12.3)), S.title_cut(F.lit("x" * 90)), S.suffix(F.lit("a/b.Tar.GZ")), S.normal_path(F.lit("a/./b/../c.js"))).first()
    assert list(row)[:4] == ["1.2k", "1.50M", "$0.0050", "$12.30"] and len(row[4]) == 80 and row[5:] == (".gz", "a/c.js")


def test_packs(spark):
    repos = spark.createDataFrame([("r", [".py"], [], ["express"], ["python"], ["package.json", "a/package.json"])], "repo string, extensions array<string>, imports array<string>, frameworks array<string>, languages array<string>, filenames array<string>")
    p = spark.createDataFrame([("one", "d", [], [], ["express"], [], []), ("glob", "d", [], [], [], [], ["**/package.json"]), ("none", "d", [], [], [], [], [])], "name string, description string, extensions array<string>, imports array<string>, frameworks array<string>, languages array<string>, filename_patterns array<string>")
    assert {r.name: r.reasons for r in packs.activate(p, repos).collect()} == {"one": ["framework: express"], "glob": ["filename: a/package.json"]}


def test_guidelines(spark):
    docs = spark.createDataFrame([("a.md", "intro\n# One\ntext a\n\ntext b\n## Two\nlast"), ("b.txt", "no header")], "source string, content string")
    got = [(r.source, r.section_index, r.section_title, r.text) for r in guidelines.split_sections(docs).orderBy("source", "section_index").collect()]
    assert got == [("a.md", 0, "Introduction", "intro"), ("a.md", 1, "One", "text a\n\ntext b"), ("a.md", 2, "Two", "last"), ("b.txt", 0, "Document", "no header")]
    parts = spark.range(1).select(guidelines.chunk(F.lit("aaaa\n\nbbbb\n\n" + "c" * 20 + "\n\ndd"), 12)).first()[0]
    assert parts == ["aaaa\n\nbbbb", "c" * 20, "dd"]
    emb = guidelines.embed_chunks(guidelines.chunk_documents(docs).withColumn("chunk_id", F.col("text")))
    hit = guidelines.search(emb, emb.filter("text = 'last'").select(F.lit(1).alias("query_id"), "embedding"), 1).first()
    assert hit.chunk_id == "last" and abs(hit.score - 1) < 1e-6


def test_symbols(spark):
    files = spark.createDataFrame([("r", "src/a.ts"), ("r", "src/util/index.js"), ("r", "src/b.js")], "repo string, path string")
    imports = spark.createDataFrame([("r", "src/a.ts", 1, "./b", ["f"], None), ("r", "src/a.ts", 2, "./util", ["g"], None), ("r", "src/a.ts", 3, "react", [], "React"), ("r", "src/a.ts", 4, "../x", [], None)], "repo string, path string, line int, source string, imported_names array<string>, default_name string")
    res = symbols.resolve_imports(imports, files)
    assert {r.source: (r.resolved, r.is_external) for r in res.collect()} == {"./b": ("src/b.js", False), "./util": ("src/util/index.js", False), "react": (None, True), "../x": (None, False)}
    functions = spark.createDataFrame([("r", "src/b.js", "f", 1, 3, True), ("r", "src/a.ts", "h", 1, 9, False), ("r", "src/b.js", "k", 5, 6, False)], "repo string, path string, name string, line_start int, line_end int, is_exported boolean")
    calls = spark.createDataFrame([("r", "src/a.ts", 5, "f", None), ("r", "src/a.ts", 6, "h", None), ("r", "src/a.ts", 7, "zz", None)], "repo string, path string, line int, callee_name string, receiver string")
    exports = spark.createDataFrame([("r", "src/b.js", 1, ["f"], False)], "repo string, path string, line int, exported_names array<string>, is_default boolean")
    got = symbols.resolve_calls(calls, functions, imports, res, exports)
    assert {r.callee_name: r.tier for r in got.collect()} == {"f": 2, "h": 1, "zz": None}
    assert [r.name for r in symbols.uncalled(symbols.call_counts(functions, got)).collect()] == ["k"]
    py = spark.createDataFrame([("r", "a.py", "python", "import os\nclass A:\n    def f(self):\n        return 1\n\ndef g():\n    pass")], "repo string, path string, language string, content string")
    assert {(r.kind, r.name, r.line_start, r.line_end) for r in symbols.extract_declarations(py).collect()} == {("import", "os", 1, 1), ("class", "A", 2, 5), ("function", "f", 3, 5), ("function", "g", 6, 7)}


SOURCES = {
    "c": ("#include <stdio.h>\nstruct point {\n  int x;\n};\nstatic int *add(int a, int b) {\n  return sum(a);\n}\nint later(int a);\nvoid\nlong_one(int a,\n  int b)\n{\n  long_one(a, b);\n}", {("import", "stdio.h"), ("class", "point"), ("function", "add"), ("function", "long_one")}),
    "cpp": ("#include \"a.h\"\nclass Box : public Base {\n  int size() const { return 1; }\n};\nvoid Box::grow(int n)\n{\n  if (n) { go(n); }\n  return go(n);\n}\nBox::~Box() {\n}", {("import", "a.h"), ("class", "Box"), ("function", "size"), ("function", "grow"), ("function", "~Box")}),
    "c_sharp": ("using System.Text;\npublic record Point(int X);\npublic class A {\n    public A(int x) {\n    }\n    public async Task<int> Run(int n) {\n        return Go(n);\n    }\n    int Twice(int n) => 2 * n;\n    void Go(\n        int n);\n    new A(3);\n}", {("import", "System.Text"), ("class", "Point"), ("class", "A"), ("function", "A"), ("function", "Run"), ("function", "Twice"), ("function", "Go")}),
    "swift": ("import Foundation\npublic final class A {\n    static func go(_ n: Int) {\n    }\n    class func make() {\n    }\n}\nprotocol P {\n}", {("import", "Foundation"), ("class", "A"), ("class", "P"), ("function", "go"), ("function", "make")}),
    "kotlin": ("import a.b.C\ndata class P(val x: Int)\nobject O {\n    private suspend fun <T> go(x: T) {\n    }\n}\nfun String.twice() = this + this", {("import", "a.b.C"), ("class", "P"), ("class", "O"), ("function", "go"), ("function", "twice")}),
    "scala": ("import a.b.C\ncase class P(x: Int)\ntrait T {\n  override def go(x: Int) = x\n  val y = 1\n}\nobject O", {("import", "a.b.C"), ("class", "P"), ("class", "T"), ("class", "O"), ("function", "go"), ("function", "y")}),
    "lua": ("local function f(x)\nend\nfunction M.g(x)\nend\nM.h = function(x)\nend", {("function", "f"), ("function", "M.g"), ("function", "M.h")}),
    "sql": ("CREATE OR REPLACE FUNCTION add_one(x int)\nRETURNS int AS 'x';", {("function", "add_one")}),
    "julia": ("using Base.Math\nabstract type Shape end\nmutable struct P\n  x\nend\nfunction go!(x)\nend\nf(x) = x + 1", {("import", "Base.Math"), ("class", "Shape"), ("class", "P"), ("function", "go!"), ("function", "f")}),
    "shell": ("go() {\n  echo x\n}\nfunction stop {\n  echo y\n}", {("function", "go"), ("function", "stop")}),
    "matlab": ("function [a, b] = f(x)\nend\nfunction g(x)\nend", {("function", "f"), ("function", "g")}),
    "solidity": ("import {A} from \"./A.sol\";\nabstract contract C is A {\n  modifier own() {\n  }\n  function go() public {\n  }\n}\nlibrary L {\n}", {("import", "./A.sol"), ("class", "C"), ("class", "L"), ("function", "own"), ("function", "go")}),
    "verilog": ("module m(input a);\n  function automatic [7:0] f(input x);\n  endfunction\n  task t;\n  endtask\nendmodule\npackage p;\nendpackage", {("class", "m"), ("class", "p"), ("function", "f"), ("function", "t")}),
    "zig": ("pub fn main() !void {\n}\nfn add(a: i32) i32 {\n}", {("function", "main"), ("function", "add")}),
    "objective_c": ("#import <UIKit/UIKit.h>\n@import Foundation;\n@interface A : NSObject\n- (void)go:(int)x;\n@end\nstatic int add(int a) {\n  return a;\n}", {("import", "UIKit/UIKit.h"), ("import", "Foundation"), ("class", "A"), ("function", "go"), ("function", "add")}),
}


def test_declarations_of_every_language(spark):
    rows = [("r", f"f.{lang}", lang, text) for lang, (text, _) in SOURCES.items()]
    got = symbols.extract_declarations(spark.createDataFrame(rows, "repo string, path string, language string, content string")).collect()
    assert {lang: {(r.kind, r.name) for r in got if r.path == f"f.{lang}"} for lang in SOURCES} == {lang: want for lang, (_, want) in SOURCES.items()}
    spans = {(r.path, r.name): (r.line_start, r.line_end) for r in got}
    assert spans["f.cpp", "grow"] == (5, 9) and spans["f.c", "long_one"] == (10, 14) and spans["f.c", "add"] == (5, 7)
    assert spans["f.verilog", "m"] == (1, 6) and spans["f.c_sharp", "A"][0] in (3, 4) and spans["f.lua", "M.g"] == (3, 4)


REPORTS = {
    "oxlint": ({"diagnostics": [{"message": "m", "code": "eslint(no-eval)", "severity": "warning", "filename": "/r/a.js", "labels": [{"span": {"line": 4, "column": 1}}]}]}, ("a.js", 4, "critical", "security")),
    "bandit": ({"results": [{"filename": "/r/a.py", "line_number": 2, "line_range": [2, 3], "test_id": "B101", "test_name": "t", "issue_severity": "HIGH", "issue_confidence": "LOW", "issue_text": "x", "code": "c"}]}, ("a.py", 2, "error", "convention")),
    "golangci": ({"Issues": [{"FromLinter": "gosec", "Text": "t", "Severity": "", "Pos": {"Filename": "m.go", "Line": 3}, "SourceLines": ["x"]}]}, ("m.go", 3, "error", "security")),
    "shellcheck": ([{"file": "a.sh", "line": 1, "endLine": 1, "level": "style", "code": 2086, "message": "q"}], ("a.sh", 1, "info", "security")),
    "sqlfluff": ([{"filepath": "q.sql", "violations": [{"line_no": 2, "code": "L010", "description": "d"}]}], ("q.sql", 2, "warning", "code_style")),
    "rubocop": ({"files": [{"path": "a.rb", "offenses": [{"severity": "convention", "message": "m", "cop_name": "Naming/X", "correctable": True, "location": {"line": 5, "last_line": 6}}]}]}, ("a.rb", 5, "info", "code_style")),
    "phpstan": ({"files": {"a.php": {"messages": [{"message": "Deprecated call", "line": 7}]}}}, ("a.php", 7, "warning", "convention")),
    "detekt": ({"files": [{"path": "a.kt", "issues": [{"ruleId": "complexity.Long", "message": "m", "severity": "fatal", "location": {"startLine": 1, "endLine": 2}}]}]}, ("a.kt", 1, "critical", "architecture")),
    "clippy": ('{"reason":"compiler-message","message":{"message":"m","level":"help","code":{"code":"clippy::unused_x"},"spans":[{"file_name":"a.rs","line_start":8,"line_end":9,"is_primary":true}]}}\nnoise', ("a.rs", 8, "info", "redundancy")),
    "cppcheck": ('<results><errors><error id="nullPointer" severity="error" msg="m" cwe="476"><location file="b.cpp" line="3" column="1"/></error></errors></results>', ("b.cpp", 3, "critical", "security")),
    "spotbugs": ('<BugCollection><BugInstance type="T" category="STYLE" priority="3" rank="18"><ShortMessage>s</ShortMessage><LongMessage>l</LongMessage><SourceLine sourcefile="A.java" start="2" end="3"/></BugInstance></BugCollection>', ("A.java", 2, "warning", "code_style")),
    "luacheck": ("a.lua:3:5-9: (W311) value assigned\nnoise", ("a.lua", 3, "warning", "potential_bug")),
    "verilator": ("%Warning-WIDTH: f.v:12:3: bits\nnoise", ("f.v", 12, "warning", "potential_bug")),
}


@pytest.mark.parametrize("tool", analyzers.TOOLS)
def test_reports(spark, tmp_path, tool):
    text, want = REPORTS[tool]
    path = tmp_path / "report"
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    got = analyzers.normalize(analyzers.read_report(spark, tool, str(path)), tool, "/r").collect()
    assert [(r.file_path, r.line_start, r.severity, r.category) for r in got] == [want]
    assert got[0].verified and got[0].evidence[0].kind == "static_rule"


@pytest.mark.parametrize("rule, category", [("style.X", "code_style"), ("naming.X", "code_style"), ("performance.X", "performance"), ("potential-bugs.X", "potential_bug"), ("exceptions.X", "potential_bug"), ("complexity.X", "architecture"), ("other", "convention")])
def test_detekt_categories(spark, tmp_path, rule, category):
    report = {"files": [{"path": "a.kt", "issues": [{"ruleId": rule, "message": "m", "severity": "error", "location": {"startLine": 1, "endLine": 2}}]}]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    assert [r.category for r in analyzers.normalize(analyzers.read_report(spark, "detekt", str(tmp_path / "r.json")), "detekt").collect()] == [category]


def test_clippy_details(spark, tmp_path):
    span = {"file_name": "/r/a.rs", "line_start": 8, "line_end": 8, "is_primary": True}
    lines = [{"reason": "compiler-message", "message": {"message": "m", "level": "warning", "code": {"code": c}, "spans": [span], "rendered": r}} for c, r in (("clippy::perf", "warning: m\n  --> a"), ("unused_variables", None), ("clippy::a::b", ""))]
    (tmp_path / "report").write_text("\n".join(map(json.dumps, lines)))
    got = {r.title + str(i): r for i, r in enumerate(analyzers.normalize(analyzers.read_report(spark, "clippy", str(tmp_path / "report")), "clippy", "/r").collect())}
    a, b, c = got["m0"], got["m1"], got["m2"]
    assert (a.line_end, a.severity, a.hypothesis) == (None, "error", "clippy lint 'perf' triggered: m")
    assert [(e.kind, e.summary, e.source) for e in a.evidence] == [("static_rule", "clippy perf: m", "clippy::perf"), ("code_excerpt", "warning: m", "a.rs:8")]
    assert a.suggestion.endswith("rust-clippy/master/#perf") and len(b.evidence) == len(c.evidence) == 1
    assert b.category == "redundancy" and c.hypothesis.startswith("clippy lint 'a::b'")


def test_requests_and_absolute_imports(spark):
    texts = {"what models are available?": "config", "支持哪些模型": "config", "model trains": "capability", "switch the model": "config", "audit it": "audit"}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", S.request_label("text").alias("label")).collect()
    assert {r.text: r.label for r in rows} == texts
    files = spark.createDataFrame([("r", "lib/x.ts"), ("r", "src/lib/x.ts")], "repo string, path string")
    imports = spark.createDataFrame([("r", "src/a.ts", 1, "/lib/x", [], None), ("r", "src/a.ts", 2, "./lib/x", [], None)], "repo string, path string, line int, source string, imported_names array<string>, default_name string")
    assert {r.source: r.resolved for r in symbols.resolve_imports(imports, files).collect()} == {"/lib/x": "lib/x.ts", "./lib/x": "src/lib/x.ts"}


def test_history_streams_go_on(spark, tmp_path):
    from auditlake.streaming import events as ev

    schema = "file_path string, line_start int, line_end int, title string, severity string, category string, confidence double, seen_at timestamp"

    def put(folder, path):
        spark.createDataFrame([(path, 1, None, "t", "info", "security", 0.5)], schema.rpartition(",")[0]).withColumn("seen_at", F.timestamp_seconds(F.lit(1))).write.mode("append").parquet(str(tmp_path / folder))

    def run(folder, mark):
        ev.stream_history(spark.readStream.schema(schema).parquet(str(tmp_path / folder)), str(tmp_path / "h"), str(tmp_path / mark)).awaitTermination(120)
        return {r.file_path: r.run_count for r in history.current(spark, str(tmp_path / "h")).collect()}

    put("one", "a.py")
    assert run("one", "c1") == {"a.py": 1}
    put("two", "b.py")
    assert run("two", "c2") == {"a.py": 1, "b.py": 1}  # a new checkpoint keeps what is there
    put("two", "b.py")
    assert run("two", "c2") == {"a.py": 1, "b.py": 2}
    history.clear(spark, str(tmp_path / "h"))
    assert history.current(spark, str(tmp_path / "h")).count() == 0


def test_index_sources(spark, tmp_path):
    at = str(tmp_path / "i")
    chunks = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "source string, text string")
    guidelines.write_index(chunks, at)
    read = lambda: {(r.source, r.text) for r in spark.read.parquet(at).collect()}
    guidelines.replace_sources(spark.createDataFrame([("a", "new")], "source string, text string"), at)
    assert read() == {("a", "new"), ("b", "z")}
    guidelines.delete_source(spark, at, "a")
    assert read() == {("b", "z")}


def test_running_usage_with_equal_times(spark):
    u = spark.createDataFrame([("s", 1, i, 1, 0.5) for i in range(3)] + [("s", 2, 9, 1, 0.5)], "session string, ts int, input_tokens long, output_tokens long, cost_usd double")
    assert sorted(r.total_input for r in usage.running_usage(u).collect()) == [3, 3, 3, 12]
    assert sorted(r.total_input for r in usage.running_usage(u, "input_tokens").collect()) == [0, 1, 3, 12]


def test_sources(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.md").write_text("# T\nx")
    (tmp_path / "g" / "b.bin").write_text("x")
    assert [r.source for r in src.read_guidelines(spark, str(tmp_path / "g")).collect()] == ["a.md"]
    (tmp_path / "p" / "mine").mkdir(parents=True)
    (tmp_path / "p" / "mine" / "SKILL.md").write_text("---\ndescription: about\nextensions: [.py, .pyi]\n---\nbody")
    p = src.read_packs(spark, str(tmp_path / "p")).collect()
    assert [(r.name, r.extensions, r.body) for r in p] == [("mine", [".py", ".pyi"], "body")]
    repo = src.read_repo(spark, str(tmp_path / "g"), "r").collect()
    assert sorted((r.path, r.ext) for r in repo) == [("a.md", ".md"), ("b.bin", ".bin")]
    assert src.extract_st(spark.createDataFrame([("h", "<P xmlns='u'><ST>x := 1;</ST></P>")], "path string, content string")).first().st == "x := 1;"


def test_hardware(spark):
    dog = "<Watchdog>150</Watchdog><ProtectionLevel>2</ProtectionLevel>"
    safe = "<SafetyConfiguration><PasswordLevel1>x</PasswordLevel1><Program>F1</Program></SafetyConfiguration>"
    cases = {
        "plain": (f'<P><CPU Model="S7-1200" FirmwareVersion="4.5">{dog}</CPU><Ethernet Protocol="ETHERNET" Name="n"/></P>', []),
        "bare": ('<P xmlns="urn:x"><CPU Model="CPU s7-1200" FirmwareVersion="4.0.1"/></P>', ["HW-001", "HW-002", "HW-003"]),
        "both": (f'<P><PlcDevice Name="S7-1500" FWVersion="2.8.3">{dog}</PlcDevice></P>', ["HW-001"]),
        "net": (f'<P><CPU Model="S7-1500">{dog}</CPU><Interface Type="PROFINET IO" Name="a"/><PROFINET Type="PROFINET"><PortSecurity>enabled</PortSecurity></PROFINET><Interface Protocol="s7comm"/><Interface Protocol="S7"><TLS>true</TLS></Interface></P>', ["HW-006", "HW-009"]),
        "web": (f'<P><CPU Model="x">{dog}<WebServer Port="8080">true</WebServer></CPU></P>', ["HW-008"]),
        "https": (f'<P><CPU Model="x">{dog}<WebServer Port="443">true</WebServer></CPU></P>', []),
        "off": (f'<P><CPU Model="x">{dog}<WebServer Port="80">false</WebServer></CPU></P>', []),
        "unsafe": (f'<P><CPU Model="1516F /F">{dog}</CPU></P>', ["HW-005"]),
        "safe": (f'<P><CPU Model="S7-1500F" ArticleNumber="6ES7 516-3FN02-0AB0">{dog}</CPU>{safe}<Module Name="F-DI red"/></P>', []),
        "half": (f'<P><CPU Model="x">{dog}</CPU><FConfiguration/><DI Name="F-DI 8"/></P>', ["HW-004", "HW-005", "HW-007"]),
        "other": (f'<P><CPU Model="S7-1500" OrderNumber="6ES7 214-1AG40-0XB0">{dog}</CPU></P>', ["HW-012"]),
        "slow": ('<P><CPU Model="x"><OB1Watchdog>501</OB1Watchdog><ProtectionLevel>1</ProtectionLevel></CPU></P>', ["HW-003"]),
        "broken": ("<P", []),
    }
    xml = spark.createDataFrame([*[(k, v[0]) for k, v in cases.items()], ("null", None)], "path string, content string")
    found = plc_pack.audit_hardware(src.read_hw_config(xml)).collect()
    assert {k: sorted(r.rule_id for r in found if r.path == k) for k in cases} == {k: v[1] for k, v in cases.items()}


def test_findings(spark):
    f = spark.createDataFrame([("r1", "a", 1, "critical", "security", "t", 0.9), ("r1", "b", 2, "info", "nope", "u", 7.0)], "run_id string, file_path string, line_start int, severity string, category string, title string, confidence double")
    c = fnd.clean(f)
    assert {r.category for r in c.collect()} == {"security", "potential_bug"} and max(r.confidence for r in c.collect()) == 1.0
    assert fnd.gate(c).first().exit_code == 2 and fnd.gate(c.limit(0)).first().exit_code == 0
    assert fnd.rank_findings(c).first().title == "t"
    md = fnd.render_markdown(fnd.report(c)).first().markdown
    assert md.index("## Critical") < md.index("## Info")
    assert fnd.head_with_rest(c, 1).first().n_more == 1


def test_streams(spark, tmp_path, sf):
    from auditlake.streaming import events as ev

    raw = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("session"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"))
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    q = ev.running_totals(ev.without_repeats(stream)).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("totals").agg(F.sum("calls")).first()[0] == raw.count()
    f = raw.select(F.col("session").alias("file_path"), F.lit(1).alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.col("session").alias("title"), F.lit("info").alias("severity"), F.lit("security").alias("category"), F.lit(0.5).alias("confidence"), F.col("ts").alias("seen_at"))
    f.write.parquet(str(tmp_path / "f"))
    s = ev.stream_history(spark.readStream.schema(f.schema).parquet(str(tmp_path / "f")), str(tmp_path / "h"), str(tmp_path / "c2"))
    s.awaitTermination(120)
    held = history.current(spark, str(tmp_path / "h"))
    assert held.agg(F.sum("run_count")).first()[0] == raw.count()


def test_guideline_stream_over_subfolders(spark, tmp_path):
    from auditlake.streaming import events as ev

    def put(name, text):
        (tmp_path / "g" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "g" / name).write_text(text)

    def run(folder, index):
        ev.stream_guidelines(spark, folder, str(tmp_path / index), str(tmp_path / f"{index}-c")).awaitTermination(120)
        try:
            return {(r.source, r.section_title, r.text) for r in spark.read.parquet(str(tmp_path / index)).collect()}
        except Exception:
            return set()

    folder, a, b = str(tmp_path / "g"), ("a/README.md", "A", "one\ntwo"), ("b/README.md", "B", "three\nfour")
    put("c.bin", "x")
    put(".hidden/README.md", "# H\nx")
    assert run(folder, "i") == set()
    put("a/README.md", "# A\none\ntwo")
    assert run(folder, "i") == {a}
    put("b/README.md", "# B\nthree\nfour")
    assert run(folder, "i") == {a, b}
    assert run(f"{folder}/*", "j") == {a, b}
    assert {r.source for r in src.read_guidelines(spark, folder).collect()} == {"a/README.md", "b/README.md"}


def test_entry(spark):
    import __spark_entry__ as e

    known = e.queries()
    assert set(e.oracle_sql()) <= set(known)
    assert e.entry(spark).count() > 0
