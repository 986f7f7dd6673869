"""A profile root is found however many separators come before its end."""

from tracelake.operators import quality


def test_deep_root(spark):
    deep = "C:" + "\\d" * 70
    paths = spark.createDataFrame([(deep + "\\kim\\a\\b.txt",), (deep + "\\other.txt",), ("C:\\d\\x",)], "path string")
    roots = spark.createDataFrame([(deep + "\\kim", "kim"), ("C:\\d", "short")], "root string, user string")
    got = {len(r["path"]): r["user"] for r in quality.user_of_path(paths, roots).collect()}
    assert got == {len(deep) + 12: "kim", len(deep) + 10: "short", 6: "short"}
