"""Chunkers on small files of each language."""

import pytest
from memlake.operators import chunks as C

RUST = """use x;
/// Adds.
///
/// Both.
pub(crate) async fn add(a: i32) -> i32 {
    if a > 0 { 1 } else { 2 }
}

struct Unit;

impl Thing {
    fn inner() {
    }
}
// fn not_this() {}
fn open() {
"""
PYTHON = """# Says hello.
async def hello(name):
    if name:

        return 1

class A(B):
    def inner(self):
        pass
x = 1
def one_line(): return 2
"""
TYPED = """/**
 * Draws.
 */
export default class Box {
  draw() { return {}; }
}
export const run = async (x) => {
  return x;
};
const plain = 5;
interface Shape { a: number }
"""
GO = """type T struct {
  a int
}
func (t *T) Name() string {
  return "{}"
}
func Plain() {
}
"""


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("rust", RUST, [("fn", "add", 5, 7, "Adds.\nBoth."), ("struct", "Unit", 9, 14, None), ("fn", "open", 16, 16, None)]),
        ("python", PYTHON, [("def", "hello", 2, 6, "Says hello."), ("class", "A", 7, 9, None), ("def", "one_line", 11, 11, None)]),
        ("typescript", TYPED, [("class", "Box", 4, 6, "Draws."), ("fn", "run", 7, 9, None), ("interface", "Shape", 11, 11, None)]),
        ("javascript", TYPED, [("class", "Box", 4, 6, "Draws."), ("fn", "run", 7, 9, None)]),
        ("go", GO, [("type", "T", 1, 3, None), ("func", "Name", 4, 6, None), ("func", "Plain", 7, 8, None)]),
        ("markdown", "fn x() {}", []),
    ],
)
def test_definitions(spark, language, text, want):
    """A definition without a body of its own (``struct Unit;``) reaches to the end of the next balanced braces."""
    files = spark.createDataFrame([("f", language, text), ("g", language, None), ("h", language, "")], "path string, language string, content string")
    got = C.chunk_code(files).orderBy("start_line").collect()
    assert [(r.chunk_type, r.name, r.start_line, r.end_line, r.doc_comment) for r in got] == want
    lines = text.split("\n")
    for r in got:
        assert r.content == "\n".join(lines[r.start_line - 1 : r.end_line]) and r.signature == lines[r.start_line - 1].strip()


def test_roles(spark):
    text = "preface\nUser: hi\nthere\n助手：yes\nSYSTEM: end"
    rows = spark.createDataFrame([("a", text), ("b", "no roles"), ("c", None)], "id string, content string")
    got = C.chunk_roles(rows, "id").orderBy("turn_no").collect()
    assert [tuple(r)[1:] for r in got] == [(1, "User", 2, 3, "hi\nthere"), (2, "Assistant", 4, 4, "yes"), (3, "System", 5, 5, "end")]
