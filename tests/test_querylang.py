import pytest
from pyspark.sql import functions as F

from sediment.functions import globs
from sediment.operators import querylang as q

TAGS, AGE = {"foo": "123", "bar": ""}, 5 * 10**9
CASES = [
    ("foo=123 and bar=", True, True), ("foo=12*", True, True), ("foo=12?", True, True), ("~foo=xxx", True, True),
    ("older-than 2s", True, False), ("newer-than 6s", True, False), ("older-than 6s", False, False), ("newer-than 2s", False, False),
    ("~ [ foo==123 ]", False, False), ("~older-than 2s", False, True), ("missing=*", False, False), ("~missing=*", True, True),
    ("foo=x or foo=123 and bar=", True, True), ("foo=123 and bar=x or foo=123", True, True), ("foo=x and bar= or foo=123", False, False),
    ("foo==12*", False, False), ("[ foo=123 and missing=1 ] or bar=", True, True),
]


@pytest.mark.parametrize(("text", "plain", "encrypted"), CASES)
def test_cases(spark, text, plain, encrypted):
    tree = q.parse(text.split(" "))
    assert q.evaluate(tree, TAGS, AGE) is plain
    assert q.evaluate(tree, TAGS, AGE, True) is encrypted
    df = spark.createDataFrame([(TAGS,)], "tags map<string,string>")
    for mode, expected in ((False, plain), (True, encrypted)):
        assert df.select(q.compile_query(tree, q.map_lookup(F.col("tags")), F.lit(AGE), mode)).first()[0] is expected


@pytest.mark.parametrize("text", ["", "foo", "foo=1 bar=2", "[ foo=1", "[ ]", "older-than 3x", "older-than", "a=[", "a={x", "a=1 and", "~"])
def test_errors(text):
    with pytest.raises(q.QuerySyntaxError) as e:
        q.parse(text.split(" "))
    assert "^" in e.value.pretty()


def test_durations():
    assert q.parse_duration("1h 30m") == 5400 * 10**9
    assert q.parse_duration("1M") != q.parse_duration("1m")


def test_single_id():
    assert q.single_id(q.parse("id=11223344556677881122334455667788")) == "11223344556677881122334455667788"
    assert q.single_id(q.parse("id=AABB" + "0" * 28)) == "aabb" + "0" * 28
    assert q.single_id(q.parse("foo=123")) is None
    assert q.single_id(q.parse("id=1122*")) is None


def test_put_tags():
    assert q.parse_put_tags(["a-b=1", "::", "c=2"]) == ({"a-b": "1"}, ["c=2"])
    assert q.parse_put_tags(["a=", "b=1"]) == ({}, ["a=", "b=1"])
    with pytest.raises(ValueError):
        q.parse_put_tags(["id=1"])


GLOBS = [
    ("*", "a/b", True), ("a*c", "a/b/c", True), ("a*a", "a", False), ("?", "/", True), ("[!a]", "b", True), ("[!a]", "a", False), ("[a-c]x", "bx", True),
    ("{a,b}c", "bc", True), ("\\*", "*", True), ("\\*", "x", False), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a.c", "abc", False), ("x", "x\n", False), ("*", "a\nb", True), ("[]]", "]", True), ("", "", True),
]


@pytest.mark.parametrize(("pattern", "text", "expected"), GLOBS)
def test_globs(spark, pattern, text, expected):
    g = globs.parse(pattern)
    assert g.matches(text) is expected
    assert spark.createDataFrame([(text,)], "x string").select(g.column(F.col("x"))).first()[0] is expected


def test_glob_escape_and_exclusions():
    for text in ("a*b", "[x]", "?", "plain"):
        assert globs.parse(globs.escape(text)).matches(text)
    assert globs.exclusion("bang").matches("/foo/bar/bang")
    assert globs.exclusion("/foo/*/bang").matches("/foo/bar/bang")
    assert not globs.exclusion("/*/bang").matches("/foo/bar/bang")
    for bad in ("*/bar", "", "/", "x/"):
        with pytest.raises(globs.GlobError):
            globs.exclusion(bad)


def test_globs_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("1-URGENT",)], "name string").write.parquet(path)
    tree = q.parse("name=1-*")
    plan = spark.read.parquet(path).where(q.compile_query(tree, lambda k: F.col(k)))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan


@pytest.mark.parametrize(("text", "pushed"), [
    ("name==a", ["EqualTo(name,a)"]), ("name=a", ["EqualTo(name,a)"]), ("name=a* and kind==b", ["StringStartsWith(name,a)", "EqualTo(kind,b)"]),
    ("name=a* or kind==b", ["Or(", "StringStartsWith(name,a)", "EqualTo(kind,b)"]), ("~name==a", ["Or(", "IsNull(name)", "Not(EqualTo(name,a))"]), ("~ [ name=*a or kind=b ]", ["StringEndsWith(name,a)", "Not(EqualTo(kind,b))"]),
])
def test_queries_reach_the_scan(spark, tmp_path, text, pushed):
    path, rows = str(tmp_path / "t"), [("a", "b"), ("xa", "c"), (None, "b"), ("ab", None), (None, None)]
    spark.createDataFrame(rows, "name string, kind string").write.parquet(path)
    tree = q.parse(text.split(" "))
    found = spark.read.parquet(path).where(q.compile_query(tree, lambda k: F.col(k)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PushedFilters: ") :].split("ReadSchema")[0]
    assert all(x in filters for x in pushed), filters
    tags = [{k: v for k, v in zip(("name", "kind"), r, strict=True) if v is not None} for r in rows]
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in spark.createDataFrame(rows, "name string, kind string").collect() if q.evaluate(tree, tags[rows.index(tuple(r))], 0))
