"""Candidate paths against a file list."""

import pytest

from graphquarry.functions import paths
from graphquarry.operators import resolve
from pyspark.sql import functions as F


def table(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


@pytest.mark.parametrize("declaring, specifier, known, literal, normalized", [
    ("src/main.ts", "./utils.js", ["src/utils.ts"], "src/utils.ts", "src/utils.ts"),
    ("src/main.ts", "./utils", ["src/utils.ts", "src/utils/index.ts"], "src/utils.ts", "src/utils.ts"),
    ("src/main.ts", "./utils", ["src/utils/index.ts", "src/utils.tsx"], "src/utils/index.ts", "src/utils/index.ts"),
    ("src/main.ts", "./utils", ["src/utils/index.tsx"], "src/utils/index.tsx", "src/utils/index.tsx"),
    ("src/main.ts", "vitest", ["src/vitest.ts"], None, None),
    ("src/main.ts", "../../outside", ["../outside.ts", "outside.ts"], None, None),
    ("src/main.ts", "./lib/x.js", ["src/lib/x.ts"], None, "src/lib/x.ts"),
    ("src/a/main.ts", "../utils", ["src/utils.ts"], None, "src/utils.ts"),
    ("src/a/main.ts", "../", ["src/index.ts", "src/a/index.ts"], None, "src/index.ts"),
    ("src/main.ts", "./", ["src/index.ts"], None, "src/index.ts"),
    ("src/main.ts", "./a.service", ["src/a.ts", "src/a.service.ts"], "src/a.ts", "src/a.ts"),
    ("main.ts", "./b", ["b.ts"], "b.ts", "b.ts"),
])
def test_typescript_resolution(spark, declaring, specifier, known, literal, normalized):
    asked = spark.createDataFrame([(declaring, specifier)], "path string, specifier string")
    for mode, want in (("literal", literal), ("normalized", normalized)):
        found = [r.target for r in resolve.ts_targets(asked, table(spark, known), mode).collect()]
        assert found == ([want] if want else []), mode


@pytest.mark.parametrize("declaring, name, known, want", [
    ("src/main.rs", "auth", ["src/auth.rs", "src/auth/mod.rs"], "src/auth.rs"),
    ("src/lib.rs", "auth", ["src/auth/mod.rs"], "src/auth/mod.rs"),
    ("src/a/mod.rs", "b", ["src/a/b.rs", "src/a/mod/b.rs"], "src/a/b.rs"),
    ("src/bar.rs", "foo", ["src/foo.rs", "src/bar/foo.rs"], "src/bar/foo.rs"),
    ("src/bar.rs", "foo", ["src/bar/foo/mod.rs"], "src/bar/foo/mod.rs"),
    ("main.rs", "a", ["a.rs"], "a.rs"),
    ("src/bar.rs", "a/b", ["src/bar/a/b.rs"], None),
    ("src/bar.rs", "a..b", ["src/bar/a..b.rs"], None),
])
def test_mod_resolution(spark, declaring, name, known, want):
    asked = spark.createDataFrame([(declaring, name)], "path string, name string")
    found = [r.target for r in resolve.mod_targets(asked, table(spark, known)).collect()]
    assert found == ([want] if want else [])


def test_crate_use(spark, rows):
    uses = ["crate::billing", "crate::auth::login", "crate::{a, b}", "crate::x as y", "sample::billing",
            "pub use crate::billing", "crate::", "crate::only_mod"]
    asked = spark.createDataFrame([(f"src/u{i}.rs", u) for i, u in enumerate(uses)], "path string, specifier string")
    known = table(spark, ["src/billing.rs", "src/auth.rs", "src/.rs", "src/only_mod/mod.rs"])
    assert rows(resolve.crate_use_edges(asked, known), "from_path", "to_path", "kind") == [
        ("src/u0.rs", "src/billing.rs", "depends_on"), ("src/u1.rs", "src/auth.rs", "depends_on")]


def test_path_columns(spark):
    cases = [("crates/x/a.rs", "x"), ("a.rs", "(root)"), ("src/a.rs", "src"), ("/a.rs", "(root)"), ("crates", "(root)")]
    df = spark.createDataFrame(cases, "path string, want string")
    assert df.where(paths.crate_of(F.col("path")) != F.col("want")).isEmpty()
    folds = [("a/./b", "a/b"), ("a/b/../c", "a/c"), ("../a", "../a"), ("a/../../b", "../b"), ("./a", "a"), ("../../a", "../../a")]
    df = spark.createDataFrame(folds, "path string, want string")
    assert df.where(paths.normalized(F.col("path")) != F.col("want")).isEmpty()
    scan = [("src/a.rs", True), ("a/build.rs", True), ("build/a.rs", False), ("x/.next/a.ts", False), ("a.d.ts", False),
            ("a.tsx", True), (".rs", False), ("targets/a.rs", True), ("a/node_modules/b/c.ts", False), ("a.js", False)]
    df = spark.createDataFrame(scan, "path string, want boolean")
    assert df.where(paths.is_source_file(F.col("path")) != F.col("want")).isEmpty()
