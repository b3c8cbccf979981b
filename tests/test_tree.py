"""The source-tree reader opens what it must, and nothing else."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators.scan import is_excluded
from sitelens.sources.tree import SKIPPED, TreeReader, list_source_tree, read_source_tree

FILES = {
    "a/package.json": "{}", "a/src/App.jsx": "x", "a/src/pages/_app.jsx": "y", "a/.env": "z", "a/logo.png": "png",
    "a/node_modules/react/index.js": "no", "a/src/node_modules/deep/x.js": "no", "a/dist/main.js": "no",
    "a/src/out": "no", "a/public/robots.txt": "u", "b/src/App.jsx": "b", "b/src/été 1.js": "é", "c/README": "r", "stray.js": "no",
}


@pytest.fixture()
def tree(tmp_path):
    for path, text in FILES.items():
        f = tmp_path / "tree" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (tmp_path / "log").mkdir()
    (tmp_path / "tree" / "a" / "src" / "loop").symlink_to(tmp_path / "tree" / "a")
    return tmp_path


def opened(top):
    return sorted(x for f in (top / "log").iterdir() for x in f.read_text().splitlines())


def rows(df):
    return {f"{r.project_id}/{r.path}": r.content for r in df.collect()}


@pytest.mark.parametrize("splits", [1, 3, 40])
def test_excluded_folders_are_never_read(spark, tree, splits):
    got = rows(read_source_tree(spark, str(tree / "tree"), splits=splits, log=str(tree / "log")))
    want = {p: t for p, t in FILES.items() if t != "no"}
    assert got == want | {"a/logo.png": None, "a/.env": None}
    assert opened(tree) == sorted(p for p in want if not p.endswith((".png", ".env")))


def test_exclusion_equals_the_filter(spark, tree):
    every = list_source_tree(spark, f"file://{tree}/tree", exclude=())
    kept = {(r.project_id, r.path) for r in every.where(~is_excluded(F.col("path"))).collect()}
    found = list_source_tree(spark, f"file://{tree}/tree", exclude=(*SKIPPED, "public"))
    assert kept == {(r.project_id, r.path) for r in found.collect()}
    assert every.count() == len(FILES) - 1


def test_filters_choose_folders_and_files(spark, tree):
    top, log = str(tree / "tree"), str(tree / "log")
    where = (F.col("project_id") == "a") & F.col("path").startswith("src/p")
    assert rows(read_source_tree(spark, top, where, log=log)) == {"a/src/pages/_app.jsx": "y"}
    assert opened(tree) == ["a/src/pages/_app.jsx"]
    many = F.col("project_id").isin("b", "c") & F.col("path").endswith(".js") & (F.col("size") < 9)
    assert rows(read_source_tree(spark, top, many)) == {"b/src/été 1.js": "é"}
    assert rows(read_source_tree(spark, top, F.col("project_id") == "none")) == {}


def test_pushed_filters_prune_the_walk(tree):
    from pyspark.sql.datasource import EqualTo, StringEndsWith, StringStartsWith
    reader = TreeReader(str(tree / "tree"), "/".join(SKIPPED), 1)
    start, end = StringStartsWith(("path",), "src/pages/"), StringEndsWith(("path",), ".jsx")
    assert list(reader.pushFilters([EqualTo(("project_id",), "a"), start, end])) == [start, end]
    assert [f.path for p in reader.partitions() for f in p.folders] == ["a"]
    assert [x for b in reader.read(reader.partitions()[0]) for x in b.column("path").to_pylist()] == [
        ".env", "logo.png", "package.json", "src/App.jsx", "src/pages/_app.jsx"]


def test_one_large_project_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big" / "src").mkdir(parents=True)
    for i in range(400):
        (tmp_path / "big" / "src" / f"f{i}.js").write_text("x" * i)
    df = read_source_tree(spark, str(tmp_path), splits=8)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 400 / 8
    assert df.agg(F.sum(F.length("content"))).first()[0] == sum(range(400))


def test_empty_root_and_missing_root(spark, tmp_path):
    assert read_source_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception):
        read_source_tree(spark, str(tmp_path / "none")).count()
