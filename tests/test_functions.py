import ast
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogweave.functions import lists
from catalogweave.functions import scores as S
from catalogweave.functions import text as X
from catalogweave.functions import urls as U
from catalogweave.functions.lists import list_text, parse_list
from catalogweave.operators.clean import clean_works


def apply(spark, make, inputs, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    frame = spark.createDataFrame(rows, f"i int, x {kind}").coalesce(1)
    return [r[1] for r in frame.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_int(spark):
    texts = ["1,234", " 7 ", "", None, "12.0", "abc", "99999999999", "\xa0 5\t", "-3"]
    assert apply(spark, X.clean_int, texts) == [1234, 7, None, None, None, None, None, 5, -3]
    bad = apply(spark, X.is_bad_int, texts)
    assert bad == [False, False, False, False, True, True, True, False, False]


def test_clean_status(spark):
    texts = ["Completed:", "Updated:", "UPDATED 2024", "", "Paused", None, " \t"]
    want = ["completed", "on_going", "on_going", None, "paused", None, None]
    assert apply(spark, X.clean_status, texts) == want


def test_clean_date(spark):
    texts = ["2024-01-05", "05 Jan 2024", "01/02/2024", "2024-13-01", "garbage", None]
    got = [d and d.isoformat() for d in apply(spark, X.clean_date, texts)]
    assert got == ["2024-01-05", "2024-01-05", "2024-01-02", None, None, None]


def test_clean_text(spark):
    texts = ["a\xa0 b", "a\x1cb", " \xa0　", None, "x"]
    assert apply(spark, X.clean_text, texts) == ["a b", "a b", None, None, "x"]


LIST_CASES = [
    (None, []),
    ("", []),
    (" [] ", []),
    ("nan", []),
    ("None", []),
    ("['a', 'b ']", ["a", "b"]),
    ("""["It's", 'x, y']""", ["It's", "x, y"]),
    (r"['a\xa0b']", ["a\xa0b"]),
    (r"['q\'z']", ["q'z"]),
    (r"['​']", ["​"]),
    ("['a' 'b']", ["ab"]),
    ("Foo, Bar", ["Foo", "Bar"]),
    ("['a', b]", ["['a'", "b]"]),
    ("'Foo'", ["Foo"]),
    ("5", ["5"]),
    ("('a','b')", ["('a', 'b')"]),
    ("[1, 2]", ["1", "2"]),
    ("['a', '', ' ', 'a']", ["a", "a"]),
    ("['line\nbreak']", ["['line\nbreak']"]),
    ("['a',]", ["a"]),
]


def test_parse_list(spark):
    got = apply(spark, parse_list, [text for text, _ in LIST_CASES])
    assert got == [items for _, items in LIST_CASES]


BARE = ["Fluff, 5-LOW,", "True", "True, x", "Truex, y", "None, None", "set()", "set ()", "sets()", "u'x'", "b, 'c'", "not x, y", "lambda a: 1, b",
        "a if b else c", "Foo # bar, 1", "x\t, y", "a + 1j", "f'z', w", "Noneé, 1", "Nonｅ, 1", "ｓet()", "é, b", "_a, , b\xa0", "a\nb, c"]


def test_parse_list_reads_plain_text_without_python(spark):
    assert apply(spark, parse_list, BARE) == [lists._items_of(text) for text in BARE]
    assert apply(spark, lambda c: c.rlike(lists._BARE_TEXT), ["Fluff, 5-LOW,", "word word", "None, 1", "u'x'"]) == [True, True, False, False]


ESCAPED = [r"['caf\xe9 5']", r"['a\\', \"b\'c\"]", r"['\u2603', 'x\ty ', '\n']", r"['\d']", r"['\☃']", r"['\x4']", r"['\101']", "['é\\té', '☃\\'']"]


def test_parse_list_reads_simple_escapes_without_a_parser(monkeypatch):
    want = [lists._items_of(text) for text in ESCAPED]
    monkeypatch.setattr(lists, "_ESCAPED_LIST", re.compile("(?!)"))
    assert [lists._items_of(text) for text in ESCAPED] == want
    monkeypatch.undo()
    monkeypatch.setattr(lists.ast, "literal_eval", None)
    assert lists._items_of(ESCAPED[0]) == ["café 5"]


def test_parse_long_list_does_not_overflow(spark):
    items = [f"tag {i}" for i in range(20_000)]
    assert apply(spark, parse_list, [repr(items)]) == [items]


item = st.text(alphabet=st.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(item, max_size=5), min_size=30, max_size=60))
def test_parse_list_reads_back_written_lists(spark, lists):
    want = [[x.strip() for x in items if x.strip()] for items in lists]
    assert apply(spark, parse_list, [repr(items) for items in lists]) == want
    written = apply(spark, list_text, lists, "array<string>")
    assert all(ast.literal_eval(text) == items for text, items in zip(written, lists) if "\x00" not in text)


@settings(max_examples=5, deadline=None)
@given(st.lists(item, min_size=50, max_size=100))
def test_clean_text_matches_python_and_is_idempotent(spark, texts):
    once = apply(spark, X.clean_text, texts)
    assert once == [re.sub(r"\s+", " ", t).strip() or None for t in texts]
    assert apply(spark, X.clean_text, once) == once


def test_urls(spark):
    assert apply(spark, U.derive_id, ["x/works/12?a", "y/works/7/works/9", "zz", None]) == [12, 7, None, None]
    assert apply(spark, U.strip_query, ["a?b?c", "a"]) == ["a", "a"]
    assert apply(spark, U.page_count, [0, 20, 21, 60], "int") == [0, 1, 2, 3]
    absolute = apply(spark, lambda c: U.work_url(c, "https://host"), ["/works/5"])
    assert absolute == ["https://host/works/5?view_adult=true"]


def test_split_chapters(spark):
    texts = ["3/?", "1/1", "/5", "5", "1/2/3", None]
    assert apply(spark, lambda c: X.split_chapters(c)[0], texts) == ["3", "1", None, None, None, None]
    assert apply(spark, lambda c: X.split_chapters(c)[1], texts) == [None, "1", "5", None, None, None]


def test_na_tokens(spark):
    tokens = ("NA", "null")
    assert apply(spark, lambda c: X.na_to_null(c, tokens), ["NA", "na", "x", None]) == [None, "na", "x", None]


def pairs(spark, make, rows, kind):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, a {kind}, b {kind}").coalesce(1)
    return [r[0] for r in frame.orderBy("i").select(make(F.col("a"), F.col("b"))).collect()]


def test_jaccard(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"]), (None, None), (["a"], ["a"])]
    got = pairs(spark, S.jaccard_similarity, rows, "array<string>")
    assert got == pytest.approx([1.0, 0.0, 1 / 3, 1.0, 1.0])


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcde")), st.lists(st.sampled_from("abcde"))), min_size=40))
def test_jaccard_is_symmetric_and_bounded(spark, rows):
    forward = pairs(spark, S.jaccard_similarity, rows, "array<string>")
    backward = pairs(spark, S.jaccard_similarity, [(b, a) for a, b in rows], "array<string>")
    assert forward == backward and all(0.0 <= x <= 1.0 for x in forward)
    exact = [len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0 for a, b in rows]
    assert forward == pytest.approx(exact)


def test_cosine_and_min_max(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0])]
    got = pairs(spark, S.cosine_similarity, rows, "array<float>")
    assert got == pytest.approx([1.0, 0.0, 0.0, -1.0])
    assert apply(spark, lambda c: S.min_max_normalize(c, 0, 20), [5, 0, 20], "int") == [0.25, 0.0, 1.0]
    assert apply(spark, lambda c: S.min_max_normalize(c, 4, 4), [4], "int") == [0.0]


def test_final_score(spark):
    score = S.final_score(F.lit(0.5), F.lit(1.0), F.lit(0.5), S.popularity_score(F.lit(0.4), F.lit(0.2)))
    value, text = spark.range(1).select(score, X.format_score(score)).first()
    assert value == pytest.approx(0.565) and text == "0.5650"


def test_each_text_is_cleaned_once(spark):
    """However many outputs depend on a text, the plan names its cleaning once."""
    raw = spark.createDataFrame([(" Updated:\t", "1,x", "5", "x/works/3")], "status string, words string, hits string, url string")
    cleaned = clean_works(raw)
    assert cleaned.first().asDict() == {"status": "on_going", "words": None, "hits": 5, "url": "x/works/3", "fault": "bad_int:words", "date_lost": False}
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(status") == 1 and plan.count("replace(words") == 1
