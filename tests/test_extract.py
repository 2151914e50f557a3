"""Facts from Rust and TypeScript text."""

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import extract
from graphquarry.plans import index
from graphquarry.sources import tables

AUTH = """pub fn login(user: &str, pass: &str) -> bool {
    validate(user, pass)
}

fn validate(user: &str, pass: &str) -> bool {
    !user.is_empty() && !pass.is_empty()
}

pub struct Session {
    pub user: String,
}
"""


def files(spark, **sources):
    named = [(k.replace("__", "/").replace("_dot_", "."), v) for k, v in sources.items()]
    return spark.createDataFrame(named, "path string, source string")


def rust(spark, source):
    return files(spark, src__m_dot_rs=source)


def ts(spark, source, name="src__m_dot_ts"):
    return files(spark, **{name: source})


def test_functions_and_structs_with_lines(spark, rows):
    found = rows(extract.rust_items(rust(spark, AUTH)), "kind", "name", "line")
    assert found == [("Function", "login", 1), ("Function", "validate", 5), ("Struct", "Session", 9)]


@pytest.mark.parametrize("header, name", [
    ("impl Tr for X {}", "Tr"),
    ("impl fmt::Display for X {}", "X"),
    ("impl<T> Foo<T> {}", None),
    ("impl<T> Tr for Foo<T> {}", "Tr"),
    ("impl<T: Into<Vec<u8>>> Tr<T> for Bar where T: Clone {}", "Bar"),
    ("impl Plain {}", "Plain"),
    ("unsafe impl Send for Foo {}", "Send"),
    ("impl !Sync for Foo {}", "Sync"),
    ("impl fmt::Display for u8 {}", None),
    ("impl<F: Fn(u8) -> u8> Tr for [F; 4] {}", "Tr"),
    ("impl<F> Foo<F>\nwhere\n    F: for<'a> Fn(&'a str),\n{}", None),
])
def test_impl_names(spark, header, name):
    found = [r.name for r in extract.rust_items(rust(spark, header)).collect()]
    assert found == ([name] if name else [])


def test_bodies_nesting_and_noise(spark, rows):
    source = "\n".join([
        "//! fn doc() {}",
        "/* fn gone() {",
        "*/ fn after() { fn inner() {} }",
        "trait T { fn sig(&self) -> [u8; 2]; fn dflt(&self) -> [[u8; 2]; 3] {} }",
        'const R: &str = r#"',
        "fn raw() {}",
        '"#; const S: &str = "fn quoted() {} \\" fn more() {}";',
        "mod m { pub async fn deep(cb: fn(u8) -> u8, x: impl Into<u8>) -> impl Copy { '\"'; } }",
        'extern "C" { fn foreign(x: i32); }',
        "fn last() {}",
    ])
    assert rows(extract.rust_items(rust(spark, source)), "kind", "name", "line") == [
        ("Function", "after", 3), ("Function", "deep", 8), ("Function", "dflt", 4),
        ("Function", "inner", 3), ("Function", "last", 10), ("Trait", "T", 4),
    ]


def test_long_text_does_not_overflow(spark, rows):
    body = "x\\\"" * 200_000 + "\n" + "a " * 200_000
    source = f'/* {body} */\nfn found() {{}}\nconst S: &str = "{body.splitlines()[0]}";\nfn also() {{}}\n'
    assert rows(extract.rust_items(rust(spark, source)), "name", "line") == [("also", 5), ("found", 3)]
    script = f'/* {body} */\nimport "./a";\nconst t = `{"b" * 300_000}`;\nimport "./b";'
    assert rows(extract.ts_specifiers(ts(spark, script)), "specifier") == [("./a",), ("./b",)]


def test_use_and_mod_declarations(spark, rows):
    source = """
        use crate::billing;
        use std::collections::HashMap;
        pub use a::b; use c::{d,
            e};
        // use crate::no;
        mod auth;
        pub mod billing;
        pub(crate) mod inner;
        #[cfg(test)] mod tests;
        mod inline { mod nested; }
    """
    uses = [r.specifier for r in extract.rust_uses(rust(spark, source)).orderBy("pos").collect()]
    assert uses[:3] == ["crate::billing", "std::collections::HashMap", "pub use a::b"]
    assert uses[3].startswith("c::{d,") and uses[3].endswith("e}") and len(uses) == 4
    mods = [r.name for r in extract.rust_mods(rust(spark, source)).orderBy("pos").collect()]
    assert mods == ["auth", "billing", "inner", "tests", "nested"]


@pytest.mark.parametrize("source, expected", [
    ('import { foo } from "./bar.js";', ["./bar.js"]),
    ('import foo from "./bar.js";', ["./bar.js"]),
    ("import type { T } from './types.js';", ["./types.js"]),
    ('export { foo } from "./utils.js";', ["./utils.js"]),
    ('export * from "./core.js";', ["./core.js"]),
    ("export const x = 1;", []),
    ('import { x } from "vitest";', ["vitest"]),
    ('import fs from "node:fs";', ["node:fs"]),
    ('import "./side";import{a}from"./b"', ["./side", "./b"]),
    ('import {\n  a,\n  b,\n} from "./multi";', ["./multi"]),
    ('// import x from "./no";\n/* import y from "./no2" */\nimport z from "./yes";', ["./yes"]),
    ('const s = "import a from \'b\'";\nexport default "zz";\nimport("./dyn");', []),
    ('import x = require("./req");', []),
    ('const g = "/*";\nimport a from "./a"; // c\n/** d */ import b from "./b";', ["./a", "./b"]),
    ('const t = `\nimport q from "./q"\n`;\nimport r from "./r";', ["./r"]),
    ('import a from "";', []),
])
def test_typescript_specifiers(spark, source, expected):
    found = extract.ts_specifiers(ts(spark, source)).orderBy("pos").collect()
    assert [r.specifier for r in found] == expected


def test_tsx_and_no_rust_facts_from_typescript(spark):
    source = 'import React from "./react.js";\nexport function App(): JSX.Element { return <div />; }'
    found = files(spark, src__App_dot_tsx=source)
    assert [r.specifier for r in extract.ts_specifiers(found).collect()] == ["./react.js"]
    assert extract.rust_items(found).isEmpty() and extract.rust_mods(found).isEmpty()


def names(spark, source):
    return [(r.kind, r.name, r.line) for r in extract.rust_items(rust(spark, source)).orderBy("line", "name").collect()]


@pytest.mark.parametrize(("source", "expected"), [
    ('// see "/* odd\nfn a() {}\n// end */\n', [("Function", "a", 2)]),
    ("/* one /* two */ fn ghost() {} */\nfn a() {}\n", [("Function", "a", 2)]),
    ('const S: &str = "x\nfn ghost() {}\n";\nfn a() {}\n', [("Function", "a", 4)]),
    ("fn a(x: [u8; N]) where [u8; { N + 1 }]: Sized {}\n", [("Function", "a", 1)]),
    ("fn r#type() {}\nstruct r#ref {}\n", [("Function", "r#type", 1), ("Struct", "r#ref", 2)]),
    ("pub fn\n    far(x: u8)\n{}\nfn b() {}\n", [("Function", "far", 1), ("Function", "b", 4)]),
    ("macro_rules! m { ($x:ident) => { fn ghost() { } } }\nfn a() {}\n", [("Function", "a", 2)]),
    ("impl<T: A<B<C<D<E<F<G<H<u8>>>>>>>>> Tr for X {}\n", [("Impl", "Tr", 1)]),
    ('fn a() { let s = r##########"x" fn ghost() {} "##########; }\n', [("Function", "a", 1)]),
    ("fn a() { let c = '\"'; let d = '\\''; let e: &'static str = \"}\"; }\nfn b() {}\n", [("Function", "a", 1), ("Function", "b", 2)]),
    ("fn a() {} // fn b() {}", [("Function", "a", 1)]),
])
def test_whichever_token_begins_first_wins(spark, source, expected):
    assert names(spark, source) == expected


def test_long_tokens_do_not_overflow(spark):
    source = 'fn a() { let s = "' + "x\\\\y" * 200_000 + '"; }\n/* ' + "* / /* */" * 50_000 + " */\nfn b() {}\n"
    assert names(spark, source) == [("Function", "a", 1), ("Function", "b", 3)]


def test_attributes_and_raw_names_before_imports(spark):
    found = extract.rust_uses(rust(spark, "#[allow(unused)] use crate::x::Y;\n#[a] pub use b::c;\n"))
    assert [r.specifier for r in found.orderBy("pos").collect()] == ["crate::x::Y", "pub use b::c"]
    assert [r.name for r in extract.rust_mods(rust(spark, "mod r#match;\n#[x] mod y;\n")).orderBy("pos").collect()] == ["r#match", "y"]


def test_comment_marks_inside_strings(spark):
    source = (
        'const a = "src/*.ts";\nimport { b } from "./b";\nconst c = "**/foo";\nimport d from \'./d\'; // `\n'
        'const t = `import x from "./x"`;\nimport e from "./e";\n/* ` */\nimport "./f";\n'
    )
    assert [r.specifier for r in extract.ts_specifiers(ts(spark, source)).orderBy("pos").collect()] == ["./b", "./d", "./e", "./f"]


def test_repeated_items_stay_apart(spark):
    source = "impl A {\n fn new() {}\n}\nimpl B {\n fn new() {}\n}\nimpl A {\n fn b() {}\n}\nstruct A {}\n"
    entities = tables.new_entities(index.structure(rust(spark, source))[0])
    assert entities.count() == 8 == entities.select("id").distinct().count()


def test_ids_do_not_mix_up_paths_and_names(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "a|b|c"), ("a\\", "|b|c"), ("a", "\\|b|c")], "path string, name string")
    ids = rows.select(tables.entity_id(F.lit("File"), F.col("path"), F.col("name")).alias("id"))
    assert ids.distinct().count() == 5


HARD_TS = [
    ("""const re = /["'`]/;\nimport c from "./c";\nconst z = `t`;\nimport d from "./d";\n""", ["./c", "./d"]),
    ("const t = `a ${ `inner ${x} ${'}'}` } 'b`;\nimport b1 from './b1';\nlet s = `${a}//`;\nimport b2 from './b2';\n", ["./b1", "./b2"]),
    ("const x = a / b; const y = 'q' / 2;\nimport a from './a';\nif (x) /'/.test(y);\nimport b from './b';\n", ["./a", "./b"]),
    ("const f = () => { return /[/'\\]`]/g };\nimport a from './a'; export * from './b';\n", ["./a", "./b"]),
    ("x = y\n/* ' */ / 2; // it's /\nimport a from './a';\n/* import no from './no'; */\nconst u = `http://x`;\nimport b from './b';\n", ["./a", "./b"]),
    ("s = `\nimport n from './n';\n${ b + `\nimport m from './m';\n` }\n`;\nimport f from './f';\n", ["./f"]),
    ("const n = a++ / 2, m = b[0] / c, k = (a) / 2; '/';\nimport f from './f';\n", ["./f"]),
    ("a = b /2; c = `/`; d = '/' ; e = /`/\nimport f from './f';\n", ["./f"]),
]
HARD_TSX = [
    ("import R from 'react';\nconst A = () => <p title=\"it's\">don't `use` {f(`x ${1}`)} <b/> // no </p>;\nimport q from './q';\n", ["react", "./q"]),
    ("const g = <T,>(x: T) => x < 3 ? \"a\" : 'b';\nimport w from './w';\nconst h = a < b; // it's\nimport v from './v';\n", ["./w", "./v"]),
    ("function P() {\n return (\n <>\n <A x={y > 2 ? <B/> : null} on={() => { f('`') }}>it's {/* don't */}\n import no from './no';\n </A>\n </>\n );\n}\n"
     "import ok from './ok';\n", ["./ok"]),
    ("const a = [<i key='`'>{x}'</i>, <A.B c=\"'\"/>];\nconst r = x as Array<string>;\nimport ok from './ok';\n", ["./ok"]),
]


def test_typescript_states(spark):
    cases = [(f"src/a{i}.ts", *c) for i, c in enumerate(HARD_TS + HARD_TSX[1:2])] + [(f"src/b{i}.tsx", *c) for i, c in enumerate(HARD_TS + HARD_TSX)]
    frame = spark.createDataFrame([c[:2] for c in cases], "path string, source string")
    found = {}
    for r in extract.ts_specifiers(frame).orderBy("path", "pos").collect():
        found.setdefault(r.path, []).append(r.specifier)
    assert found == {path: expected for path, _, expected in cases}


def test_rust_nesting_has_no_bound(spark):
    depths = (1, 33, 200, 1500)
    sources = [(
        f"src/d{depth}.rs",
        "macro_rules! m " + "{" * depth + "\nfn hidden() {}\n" + "}" * depth + " fn a() {}\n"
        + "/* \" " * depth + "fn no() {} don't\n" + "*/" * depth + " struct B;\n"
        + "fn c(x: " + "[" * depth + "u8" + "; {1}]" * depth + ") { let s = r#\"/* \"fn no() {}\"#; }\n"
        + "impl T" + "<A" * depth + ">" * depth + " for D {}\n",
    ) for depth in depths]
    found = extract.rust_items(spark.createDataFrame(sources, "path string, source string")).collect()
    items = [("Function", "a", 3), ("Function", "c", 6), ("Impl", "D", 7), ("Struct", "B", 5)]
    assert sorted((r.path, r.kind, r.name, r.line) for r in found) == sorted((p, *item) for p, _ in sources for item in items)


def test_long_stateful_texts(spark, rows):
    script = "const r = /'/;\n" + "const a = `x ${ `y` }`; b = c / 2; // it's\n" * 20_000 + "import z from './z';\n"
    assert [r.specifier for r in extract.ts_specifiers(ts(spark, script)).collect()] == ["./z"]
    code = "/* /* \" */ */\n" * 20_000 + "fn last() {}\n"
    assert rows(extract.rust_items(rust(spark, code)), "name", "line") == [("last", 20_001)]


def test_rust_prose_is_few_atoms_and_folds_to_the_same_code(spark):
    """Runs of words are one atom; strings, raw strings and comments still begin where they did."""
    from graphquarry.functions import lexing

    prose = "some plain words, and 17 more (with marks); " * 100
    text = f"/* {prose} /* in */ */ let a = br##\"x\"#y\"##; let r = xr + r#fn; f(r\"q\"); // {prose}\nlet b = \"s\\\"t\"; '\"'"
    row = spark.createDataFrame([(text,)], "t string").select(
        F.size(F.regexp_extract_all("t", F.lit(f"(?s){lexing.RUST_ATOM}"), F.lit(0))).alias("n"),
        lexing.rust_code(F.col("t")).alias("code"),
    ).first()
    assert row["n"] < 60
    assert row["code"] == "  let a = \"\"; let r = xr + r#fn; f(\"\");  \nlet b = \"\"; '_'".replace("  let a", "  let a")
