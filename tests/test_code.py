"""Code, projects, chunks and sizes against plain scanners and the file system."""

import ast
import os
import random
import re

import pytest

from memoria.functions import text
from memoria.operators import code

PY = '''import os, sys
from a.b import c
import util

class K(Base):
    """One line."""
    x = "a # not a comment"  # cut here
    def f(self, y):
        \'\'\'Two
        lines """ nested
        here\'\'\'
        return 1

def g(): return "#"
# TODO: tidy up

# FIXME broken
s = """open
still # inside
close""" + 'x'
'''
JS = """import x from './lib/x.js';
const r = require("react");
const go = async (a) => { return 1; } // one
function run(a) { /* block
still */ return 2; }
class Box {}
// todo later
"""


def plain_strip(content):
    out, inside = [], False
    for line in content.split("\n"):
        if '"""' in line or "'''" in line:
            mark = '"""' if '"""' in line else "'''"
            inside = (line.count(mark) != 2) if not inside else False
        elif not inside:
            line = line.rstrip().split("#")[0].rstrip()
            if line:
                out.append(line)
    return "\n".join(out)


def plain_structure(content):
    out, inside = [], False
    for line in content.split("\n"):
        if line.strip().startswith(("class ", "def ")):
            out.append(line)
            inside = True
        elif inside:
            out.append(line)
            if line.count('"""') == 2 or line.count("'''") == 2:
                inside = False
    return "\n".join(out) if out else content[:1000]


def plain_context(content, query):
    lines = content.split("\n")
    near = sorted({j for i, x in enumerate(lines) if query in x.lower() for j in range(max(0, i - 5), min(len(lines), i + 6))})
    out, last = [], -2
    for j in near:
        if j != last + 1:
            out.append(f"\n... (skipped {j - last - 1} lines) ...\n")
        out.append(lines[j])
        last = j
    return "\n".join(out)


@pytest.fixture(scope="module")
def files(spark):
    r = random.Random(2)
    parts = ["x = 1", "def f():", "  class A:", '"""', "'''", '"""doc"""', "  '''a''' b", "# c", "y # z", "", "   ", 'a """ b', "needle", "\t# \t"]
    made = {f"p/{k}.py": "\n".join(r.choice(parts) for _ in range(r.randrange(0, 40))) for k in range(40)}
    made |= {"p/k.py": PY, "p/m.js": JS, "p/empty.py": "", "p/t.txt": "a  \n\n\n\nneedle"}
    return made, spark.createDataFrame([(k, v, 1, "l") for k, v in made.items()] + [("p/none.py", None, 1, "l")], "path string, content string, n int, line string").repartition(3)


def test_strip_structure_and_context(files):
    made, df = files
    stripped = {x.key: x.text for x in code.strip_code(df).collect()}
    assert stripped == {k: plain_strip(v) if k.endswith(".py") else stripped[k] for k, v in made.items()} | {"p/none.py": ""}
    assert stripped["p/t.txt"] == "a\n\nneedle" and "//" not in stripped["p/m.js"] and "block" not in stripped["p/m.js"]
    structure = {x.key: x.text for x in code.code_structure(df).collect()}
    assert structure == {k: plain_structure(v) for k, v in made.items()} | {"p/none.py": ""}
    context = {x.key: x.text for x in code.line_context(df, "NEEDLE").collect()}
    for k, v in made.items():
        if "needle" in v:
            assert context[k] == plain_context(v, "needle"), k


def test_file_summaries_and_imports(spark):
    made = {
        "w/proj/k.py": PY, "w/proj/a/b.py": "def broken(:\n pass\nimport os.path\nclass Q(x):\n", "w/proj/util/__init__.py": "", "w/proj/js/m.js": JS, "w/proj/js/lib/x.ts": "export default function run() {}",
        "w/proj/package.json": '{"dependencies": {"react": "1", "b": "2"}, "devDependencies": {"jest": "3"}}', "w/other/r.md": "# TODO: write\n# bug: here", "w/other/odd.json": "[1",
    }
    df = spark.createDataFrame([(k, v) for k, v in made.items()] + [("w/other/null.py", None)], "path string, content string")
    found = {x.path: x for x in code.file_summaries(df).collect()}
    k = found["w/proj/k.py"]
    tree = [x for x in ast.walk(ast.parse(PY)) if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
    assert {(e["name"], e["line"]) for e in k.elements} == {(x.name, x.lineno) for x in tree}
    assert k.imports == ["a.b", "os", "sys", "util"] and k.todos == ["tidy up"] and k.blockers == ["broken"]
    assert k.description == f"k.py - 1 class(es) - 2 function(s) - {PY.count(chr(10)) + 1} lines"
    assert [(e["name"], e["kind"]) for e in found["w/proj/a/b.py"].elements] == [("broken", "function"), ("Q", "class")] and found["w/proj/a/b.py"].imports == ["os"]
    m = found["w/proj/js/m.js"]
    assert [(e["name"], e["kind"], e["line"]) for e in m.elements] == [("go", "function", 3), ("run", "function", 4), ("Box", "class", 6)] and m.imports == ["./lib/x.js", "react"]
    assert found["w/proj/package.json"].dependencies == ["react", "b", "jest"] and found["w/other/odd.json"].dependencies == []
    assert found["w/other/r.md"].todos == ["write"] and found["w/other/r.md"].blockers == ["here"] and found["w/other/null.py"].lines == 1
    edges = {(x.path, x.module, x.target) for x in code.import_graph(code.file_summaries(df)).collect()}
    assert edges == {("w/proj/k.py", "a.b", "w/proj/a/b.py"), ("w/proj/k.py", "util", "w/proj/util/__init__.py"), ("w/proj/js/m.js", "./lib/x.js", "w/proj/js/lib/x.ts")}
    from pyspark.sql import functions as F

    summary = {x.project: x for x in code.project_summary(code.file_summaries(df), project=F.split_part("path", F.lit("/"), F.lit(2))).collect()}
    p = summary["proj"]
    assert (p.files, p.functions, p.classes, p.dependencies, p.todos) == (6, 6, 3, ["b", "jest", "react"], ["later", "tidy up"])
    assert p.kinds == {"python": 3, "javascript": 1, "typescript": 1, "json": 1} and p.lines == sum(v.count("\n") + 1 for k, v in made.items() if "/proj/" in k)


def test_chunks_as_a_table_function(spark):
    r = random.Random(3)
    body = "".join(r.choice(["word ", "word\n", "word\n\n", "x" * 60]) for _ in range(400))
    plain = "".join(r.choice("ab ") for _ in range(3000))
    df = spark.createDataFrame([(1, body), (2, plain), (3, ""), (4, None), (5, "x" * 500)], "id int, text string")
    found = {}
    for x in text.chunks(df, "text", 100).orderBy("id", "n").collect():
        assert x.n == len(found.setdefault(x.id, []))
        found[x.id].append(x.chunk)
    assert 4 not in found and found[3] == [""] and found[5] == ["x" * 100] * 5
    assert "".join(found[2]) == plain and re.sub(r"\n+", "", "".join(found[1])) == re.sub(r"\n+", "", body)
    assert all(len(c) <= 100 for k in found for c in found[k]) and all(len(c) >= 50 for c in found[2][:-1])
    # In SQL.
    spark.udtf.register("chunks", text.Chunks)
    df.createOrReplaceTempView("texts")
    assert spark.sql("SELECT count(*) FROM texts, LATERAL chunks(text, 100)").first()[0] == sum(map(len, found.values()))


def test_sizes_equal_the_file_systems(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(f"{tmp_path}/t/a")
    spark.range(0).write.parquet(f"{tmp_path}/t/b")
    sizes = {x.table: x for x in code.table_sizes({k: spark.read.schema("id long").parquet(f"{tmp_path}/t/{k}") for k in "ab"}).collect()}
    on_disk = [os.path.getsize(f"{tmp_path}/t/a/{f}") for f in os.listdir(f"{tmp_path}/t/a") if f.endswith(".parquet")]
    assert (sizes["a"].files, sizes["a"].bytes, sizes["a"].rows, sizes["a"].columns) == (3, sum(on_disk), 1000, 1) and "b" not in sizes
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.bin").write_bytes(b"x" * 2048)
    found = code.folder_sizes(spark, f"file://{tmp_path}/f").collect()
    assert [(x.files, x.bytes, x.label) for x in found] == [(1, 2048, "2.0 KB")]
