"""Cleaning stays cheap per row: code the JVM compiles, Python only where nothing else reads a text."""

import re

from pyspark.sql import functions as F

from catalogweave.functions import lists, text
from catalogweave.operators.clean import clean_works
from catalogweave.schemas import RAW_COLUMNS

JIT_LIMIT = 8000  # bytes of a method beyond which HotSpot leaves it interpreted


def test_generated_methods_are_small_enough_to_be_compiled(spark, tmp_path, capsys):
    raw = spark.createDataFrame([tuple("1" for _ in RAW_COLUMNS)], list(RAW_COLUMNS))
    raw.write.parquet(str(tmp_path / "raw"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        clean_works(spark.read.parquet(str(tmp_path / "raw"))).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < JIT_LIMIT


ESCAPED = [
    r"['caf\xe9 1', 'it\'s', '\\x41', 'a\\\\b', '\\\'q']",
    r"""["tab\there", ' "in" ', 'é\a\v\b\f\n\r', '']""",
    "['a\\tb', 'raw\ttab', '\\x00']",
    r"['\\u0041', '\\\\', 'x\\']",
]
LEFT = [r"['😀']", r"['\101']", "('a', 'b')", "['a' 'b']", r"[b'a\x41']", "{'a': 1}"]


def test_escaped_lists_are_read_without_python(spark):
    rows = spark.createDataFrame([(t,) for t in (*ESCAPED, *LEFT)], "t string")
    found = {r["t"]: r["items"] for r in rows.select("t", lists._decoded(lists._odd_text(F.col("t"))).alias("items")).collect()}
    assert [found[t] for t in ESCAPED] == [lists._items_of(t) for t in ESCAPED]
    assert [found[t] for t in LEFT] == [None] * len(LEFT)


def test_lists_of_several_columns_share_one_call(spark):
    texts = [None, "", "[]", "['a', 'b']", "('a', 'b')", "Fluff, x", r"['caf\xe9']", "{1: 2}", "[1, 2]"]
    rows = [(a, b, k) for k, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    frame = spark.createDataFrame(rows, "a string, b string, k int").repartition(3)
    read = lists.with_items(frame, ["a", "b"])
    want = {t: lists._items_of(t) if t not in (None, "", "[]") else [] for t in texts}
    assert read.columns == ["a", "b", "k"]
    assert {r["k"]: (r["a"], r["b"]) for r in read.collect()} == {k: (want[a], want[b]) for a, b, k in rows}
    assert read._jdf.queryExecution().optimizedPlan().treeString().count("ArrowEvalPython") == 1


DATES = ["2024-1-2", "2024-01-02", "-2024-01-02", "+12024-1-2", "2 Jan 2024", "02 JAN 2024", "1/2/2024", "2 January 2024", "Jan 2, 2024",
         "January 2, 2024", "2024/1/2", "20240102", "+20240102", "-20240102", "202401021", "2024-01-02T03:04:05", "2024-01-02t03:04:05",
         "2024-01-02 03:04:05", "garbage", "", None, "2024-01", "2024-13-01", "99", "1/2/24", "Jan 2 2024", "٢٠٢٤-1-2"]


def test_layouts_left_out_could_not_read_the_text(spark):
    frame = spark.createDataFrame([(d,) for d in DATES], "d string")
    plain = F.coalesce(*[F.try_to_date("d", layout) for layout in text.DATE_FORMATS])
    alone = [text.date_of(F.col("d"), [layout]).eqNullSafe(F.try_to_date("d", layout)) for layout in (*text.DATE_FORMATS, "MMMM", "'on 'yyyy", "[yyyy-]M/d")]
    for row in frame.select("d", text.date_of(F.col("d")).eqNullSafe(plain), *alone).collect():
        assert all(row[1:]), row


def test_white_space_rule_is_unchanged(spark):
    texts = ["a b", "a  b", "a\tb", " \xa0 ", "a 　b ", "\x85", "aᚁb \n\n c ", "", None, "  x", "a\x1c\x1c b"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(text.clean_text(F.col("t"))).collect()]
    assert got == [None if t is None else re.sub(f"{text.SPACE_CLASS}+", " ", t).strip(" ") or None for t in texts]
