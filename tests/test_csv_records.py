"""CSV files read in splits: the same rows and numbers as with one task a file."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from catalogweave.sources.csv_records import csv_records, largest_file
from catalogweave.sources.raw import _bytes, csv_headers, first_lines, number_rows, read_raw_works

ALPHABET = ["a", "B", "é", '"', ",", "\n", "\r\n", " ", "'", "\\", "\t", "\n\n", "字"]
NAMES = ["title", "url", "words", "summary"]


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def write_file(path, rows, ending="\n", last=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as file:
        csv.writer(file, lineterminator=ending).writerows(rows)
    if not last:
        path.write_bytes(path.read_bytes().removesuffix(ending.encode()))


def odd_cell(size):
    return "".join(random.choice(ALPHABET) for _ in range(random.randint(0, size)))


def both(spark, path):
    def rows(split):
        found = number_rows(read_raw_works(spark, str(path), split=split))
        return sorted((tuple(r) for r in found.select(*NAMES, "author", "bad_row", "src_file", "row_number").collect()), key=str)

    return rows(True), rows(False)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_splits_equal_whole_files(small_splits, tmp_path, ending):
    random.seed(8)
    for name in range(3):
        rows = [[f"t{name}-{k}", odd_cell(40), odd_cell(5), odd_cell(200)] for k in range(200)]
        write_file(tmp_path / f"f{name}.csv", [NAMES, *rows], ending, last=name != 1)
    split, whole = both(small_splits, tmp_path)
    assert len(split) == 600 and split == whole
    numbers = {r[0]: r[-1] for r in split}
    assert all(numbers[f"t{name}-{k}"] == k for name in range(3) for k in range(200))
    lines = csv_records(small_splits, str(tmp_path))
    assert lines.select("src_file", "src_block").distinct().count() > 60


def test_cells_over_many_splits_blank_lines_and_ragged_rows(small_splits, tmp_path):
    long = "\n".join(f"line {k} with \"quotes\"" for k in range(400))
    rows = [["a", long, "1", "x"], ["b", "", "2", long + "\n\n"], ["c"], ["d", "u", "3", "s", "more"], ["e", "u", "4", "\n"]]
    write_file(tmp_path / "one.csv", [NAMES, *rows])
    path = tmp_path / "one.csv"
    path.write_text(path.read_text() + "\n\n\nf,u,5,s\n\n")
    split, whole = both(small_splits, tmp_path)
    assert split == whole and [r[0] for r in split] == list("abcdef")
    assert [r[5] for r in split] == [False, False, True, True, False, False]
    assert split[1][3] == long + "\n\n"


def test_headers_and_shuffled_parity(small_splits, without_broadcast, tmp_path):
    write_file(tmp_path / "x/one.csv", [["﻿URL", "extra", "title"], *[[f"u{k}", "e\n", f"x{k}"] for k in range(200)]])
    write_file(tmp_path / "y/two.csv", [NAMES, *[[f"y{k}", f"v{k}\n\n", "1", "s"] for k in range(200)]])
    write_file(tmp_path / "y/empty.csv", [NAMES])
    split, whole = both(small_splits, tmp_path)
    assert len(split) == 400 and split == whole
    assert {r[1] for r in split if r[0] == "x7"} == {"u7"}
    known = read_raw_works(small_splits, str(tmp_path / "y"), header=NAMES, split=True)
    assert known.count() == 200 and known.where(F.col("url") == "v7\n\n").count() == 1


def test_large_files_are_split_by_themselves(small_splits, tmp_path):
    write_file(tmp_path / "small.csv", [NAMES, ["a", "b", "1", "s"]])
    assert largest_file(small_splits, str(tmp_path)) < 600
    assert read_raw_works(small_splits, str(tmp_path)).select("src_block").distinct().count() == 1
    write_file(tmp_path / "large.csv", [NAMES, *[[f"t{k}", "u\nv", "1", "s"] for k in range(300)]])
    found = read_raw_works(small_splits, str(tmp_path))
    assert found.count() == 301 and found.select("src_block").distinct().count() > 5
    assert [_bytes(s) for s in ("600", "64k", "128MB", "134217728b", "2g")] == [600, 65536, 128 << 20, 128 << 20, 2 << 30]


def test_headers_are_found_without_sorting_lines(spark, tmp_path):
    for k, names in enumerate((NAMES, NAMES[::-1], NAMES)):
        write_file(tmp_path / f"f{k}.csv", [names, *[[f"{k}-{r}", "u", "1", "a\nb"] for r in range(20)]])
    found = csv_headers(spark, str(tmp_path))
    assert sorted((names, len(files)) for names, files in found) == sorted([(NAMES, 2), (NAMES[::-1], 1)])
    plan = first_lines(spark.read.text(str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
