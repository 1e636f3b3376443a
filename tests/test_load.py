import csv
import os
from contextlib import contextmanager

import pytest

import catalogweave.plans.load as load_plan
from catalogweave.operators.embed import HashedTokenEncoder
from catalogweave.operators.quality import empty_pair_tables
from catalogweave.plans.embed import embed_catalogue
from catalogweave.plans.load import LoadRejected, check_published, load_works
from catalogweave.operators.score import max_popularity
from catalogweave.operators.summaries import pair_counts, pair_sets
from catalogweave.plans.recommend import recommend, recommend_batch, recommend_batch_from, recommend_from
from catalogweave.schemas import RAW_COLUMNS, TAG_TABLES
from catalogweave.session import scratch_scope
from catalogweave.sources.catalogue import (
    compact,
    compact_when_many,
    read_dictionary,
    read_part,
    read_profiles,
    read_table,
    read_tag_counts,
)
from catalogweave.sources.embeddings import read_embeddings
from catalogweave.sources.manifest import PublishConflict, current_snapshot, publish
from catalogweave.sources.raw import append_raw_works, read_raw_works
from catalogweave.streaming.ingest import start_ingest

BASE = {
    "title": "A  Work", "author": "/users/a/pseuds/a", "summary": "Two\nlines", "words": "12,345",
    "current_chapters": "3", "total_chapters": "10", "kudos": "1,024", "bookmarks": "7", "hits": "20,480",
    "rating": "General", "language": "English", "status": "Completed:", "last_date": "2024-01-05",
    "warning": ["No Warnings"], "category": ["Gen"], "fandom": ["It's", "x, y"], "relationship": [],
    "character": ["A", "B"], "freeform": ["Fluff", "Fluff"],
}
EMPTY_LISTS = {k: [] for k in TAG_TABLES}


def work(number, **changes):
    return {**BASE, "url": f"https://host/works/{number}?view_adult=true", **changes}


GOLDEN = [
    work(101),
    work(101, title="Later copy"),
    work(103, url="https://host/series/9"),
    work(104, words=""),
    work(105, hits="", kudos="", bookmarks=""),
    work(106, total_chapters=""),
    work(107, words="abc"),
    work(108, last_date="garbage"),
    work(109, status="Paused"),
    work(110, title="  \xa0 "),
    work(111, fandom="['a', b]"),
    work(112, **EMPTY_LISTS),
]
SECOND = [work(101, summary="", kudos="", fandom=["x, y", "New"]), work(113, url="https://host/works/113")]


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.DictWriter(file, fieldnames=RAW_COLUMNS)
        writer.writeheader()
        writer.writerows({c: row[c] for c in RAW_COLUMNS} for row in rows)
    return str(path)


def contents(spark, root):
    names = ["fics"] + [t for tables in TAG_TABLES.values() for t in tables[:2]]
    return {name: sorted(map(tuple, read_table(spark, root, name).collect()), key=repr) for name in names}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("load")
    root = str(folder / "catalogue")
    report = load_works(spark, write_csv(folder / "raw.csv", GOLDEN), root)
    metrics = {(r.stage, r.metric): r.value for r in report.collect()}
    return folder, root, metrics, contents(spark, root)


def test_golden_load(spark, loaded):
    folder, root, metrics, tables = loaded
    works = {r.fic_id: r for r in read_table(spark, root, "fics").collect()}
    assert sorted(works) == [101, 105, 106, 108, 111, 112]
    assert works[101].name == "A Work" and works[101].summary == "Two lines" and works[101].words == 12345
    assert works[101].status == "completed" and str(works[101].last_date) == "2024-01-05"
    assert (works[105].hits, works[105].kudos, works[105].bookmarks) == (0, 0, 0)
    assert works[106].total_chapters is None and works[108].last_date is None
    assert read_dictionary(spark, root, "fandom").orderBy("fandom_id").collect() == [
        (1, "It's"), (2, "['a'"), (3, "b]"), (4, "x, y"),
    ]
    assert not [p for p in tables["fandom_join"] if p[0] == 112]
    assert tables["relationship_value"] == [] and tables["relationship_join"] == []
    assert metrics[("read", "rows")] == 12 and metrics[("validate", "invalid")] == 5
    assert metrics[("normalize", "duplicates")] == 1 and metrics[("normalize", "unique")] == 6
    warned = {r.table for r in empty_pair_tables(read_part(spark, current_snapshot(spark, root), "pairs")).where("violations > 0").collect()}
    assert warned == {"relationship_join"}


def test_rejected_rows(spark, loaded):
    rows = spark.read.option("header", "true").csv(f"{loaded[1]}/invalid").collect()
    got = {int(r.row_number): (r.fic_id, r.error) for r in rows}
    assert got == {
        2: (None, "Missing fic_id"),
        3: ("104", "Missing required field: words"),
        6: ("107", "bad_int:words"),
        8: ("109", "bad_status"),
        9: ("110", "Missing required field: name"),
    }


def test_reload_second_load_and_compaction(spark, loaded):
    folder, root, _, before = loaded
    load_works(spark, str(folder / "raw.csv"), root)
    assert contents(spark, root) == before

    load_works(spark, write_csv(folder / "second.csv", SECOND), root)
    works = {r.fic_id: r for r in read_table(spark, root, "fics").collect()}
    assert works[101].summary == "Two lines" and works[101].kudos == 0
    assert works[101].url == "https://host/works/101?view_adult=true" and 113 in works
    fandoms = dict(map(tuple, read_dictionary(spark, root, "fandom").collect()))
    assert fandoms[5] == "New" and len(fandoms) == 5
    pairs = {r.fandom_id for r in read_table(spark, root, "fandom_join").where("fic_id = 101").collect()}
    assert pairs == {1, 4, 5}

    grown = contents(spark, root)
    compact(spark, root)
    assert contents(spark, root) == grown
    parts = current_snapshot(spark, root)["parts"]
    assert len(parts["dictionary"]) == len(parts["pairs"]) == 1
    assert check_published(spark, root).where("violations > 0").count() == 0


def test_failed_check_leaves_the_published_catalogue(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "catalogue")
    load_works(spark, write_csv(tmp_path / "a.csv", GOLDEN[:1]), root)
    before = contents(spark, root)
    monkeypatch.setattr(load_plan, "check_load", lambda *a: [{"check": "x", "table": "y", "violations": 1}])
    with pytest.raises(LoadRejected):
        load_works(spark, write_csv(tmp_path / "b.csv", SECOND), root)
    assert contents(spark, root) == before


def test_stream_follows_a_growing_folder(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "catalogue")
    raw.mkdir()
    write_csv(raw / "1.csv", GOLDEN)
    start_ingest(spark, str(raw), root, str(tmp_path / "progress")).awaitTermination()
    assert read_table(spark, root, "fics").count() == 6
    write_csv(raw / "2.csv", SECOND)
    start_ingest(spark, str(raw), root, str(tmp_path / "progress")).awaitTermination()
    assert read_table(spark, root, "fics").count() == 7
    assert read_dictionary(spark, root, "fandom").count() == 5


def test_embed_and_recommend_from_a_catalogue(spark, loaded, tmp_path):
    root, path = loaded[1], str(tmp_path / "store")
    embed_catalogue(spark, root, path, lambda: HashedTokenEncoder(16))
    store = read_embeddings(spark, path)
    works = read_table(spark, root, "fics")
    assert store.count() == works.where("summary is not null").count()
    embed_catalogue(spark, root, path, lambda: HashedTokenEncoder(16), replace=False)
    assert read_embeddings(spark, path).count() == store.count()
    pairs = read_part(spark, current_snapshot(spark, root), "pairs").withColumnRenamed("id", "tag")
    got = recommend(read_embeddings(spark, path), works, pairs, 101, top_k=3).collect()
    assert [r.rank for r in got] == [1, 2, 3] and got[0].sim == 1.0
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    again = recommend_from(spark, root, path, 101, top_k=3).collect()
    assert [(r.rank, r.fic_id, r.score) for r in again] == [(r.rank, r.fic_id, r.score) for r in got]


def test_second_publisher_fails(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    first = second = current_snapshot(spark, root)
    publish(spark, root, first, {"core": ["a"]})
    with pytest.raises(PublishConflict):
        publish(spark, root, second, {"core": ["b"]})
    assert current_snapshot(spark, root) == {"version": 1, "parts": {"core": ["a"]}}


def test_manifest_without_a_complete_entry_is_empty(spark, tmp_path):
    (tmp_path / "manifest").mkdir()
    assert current_snapshot(spark, str(tmp_path))["version"] == 0
    (tmp_path / "manifest" / "000000000001.json").touch()
    assert current_snapshot(spark, str(tmp_path)) == {"version": 0, "parts": {}}


def test_loads_leave_no_scratch_behind(spark, tmp_path, monkeypatch):
    folders = []
    monkeypatch.setattr(load_plan, "scratch_scope", lambda s, n: recorded(scratch_scope(s, n), folders))
    load_works(spark, write_csv(tmp_path / "a.csv", GOLDEN), str(tmp_path / "catalogue"))
    assert len(folders) == 1 and not os.path.exists(folders[0].removeprefix("file:"))


@contextmanager
def recorded(scope, folders):
    with scope as folder:
        folders.append(folder)
        yield folder
        assert os.path.exists(folder.removeprefix("file:"))


def test_csv_by_header_name(spark, tmp_path):
    """Another order, a byte order mark, an unknown and an absent column, and rows that are too short or long."""
    (tmp_path / "a.csv").write_text('\ufeffurl,extra,title\nu1,x,"a ""b""\nc "\nu2\nu3,x,t,more\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("title,url,words\n t4 ,u4,7\n", encoding="utf-8")
    rows = {r.url: r for r in read_raw_works(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["u1", "u2", "u3", "u4"]
    assert rows["u1"].title == 'a "b"\nc ' and not rows["u1"].bad_row and rows["u1"].summary is None
    assert rows["u2"].bad_row and rows["u3"].bad_row
    assert rows["u4"].title == " t4 " and rows["u4"].words == "7" and not rows["u4"].bad_row


def test_ragged_rows_are_rejected_as_such(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,words\nt1,5,https://host/works/1\n")
    load_works(spark, str(tmp_path / "a.csv"), str(tmp_path / "catalogue"))
    rows = spark.read.option("header", "true").csv(str(tmp_path / "catalogue" / "invalid")).collect()
    assert [(r.row_number, r.error) for r in rows] == [("0", "bad_row")]


def test_append_defaults_to_parquet(spark, tmp_path):
    rows = spark.createDataFrame([{**work(1), "title": "  x  "}], read_raw_schema())
    append_raw_works(rows, str(tmp_path / "raw"))
    (row,) = read_raw_works(spark, str(tmp_path / "raw"), "parquet").collect()
    assert row.title == "  x  " and row.fandom is not None


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    load_works(spark, write_csv(tmp_path / "a.csv", [work(k) for k in range(1, 60)]), root)
    before = set(current_snapshot(spark, root)["parts"]["core"])
    load_works(spark, write_csv(tmp_path / "b.csv", [work(5, title="New"), work(1000)]), root)
    after = set(current_snapshot(spark, root)["parts"]["core"])
    assert len(after - before) == 2 and len(before - after) in (1, 2)
    names = {r.fic_id: r.name for r in read_table(spark, root, "fics").collect()}
    assert len(names) == 60 and names[5] == "New" and names[6] == "A Work"


def test_many_loads_are_compacted(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "catalogue")
    monkeypatch.setattr(load_plan, "compact_when_many", lambda spark, root: compact_when_many(spark, root, most=1))
    for k in range(3):
        load_works(spark, write_csv(tmp_path / f"{k}.csv", [work(k + 1, fandom=[f"F{k}"])]), root)
    parts = current_snapshot(spark, root)["parts"]
    assert len(parts["dictionary"]) == 1 and read_dictionary(spark, root, "fandom").count() == 3


def read_raw_schema():
    return ", ".join(f"`{c}` {'array<string>' if isinstance(BASE.get(c), list) else 'string'}" for c in RAW_COLUMNS)


def assert_summaries(spark, root):
    """Profiles, maxima and tag counts equal those computed from the core rows and pairs."""
    snapshot = current_snapshot(spark, root)
    core, pairs = read_part(spark, snapshot, "core"), read_part(spark, snapshot, "pairs")
    sets = {r["fic_id"]: (r["fandom"], r["relationship"]) for r in pair_sets(pairs).collect()}
    want = sorted((r["fic_id"], r["kudos"], r["bookmarks"], *sets.get(r["fic_id"], ([], []))) for r in core.collect())
    profiles, maxima = read_profiles(spark, root)
    assert sorted(map(tuple, profiles.collect())) == want
    assert maxima.first() == max_popularity(core).first()
    for kind in TAG_TABLES:
        counted = pair_counts(pairs.where(f"kind = '{kind}'")).select("id", "works")
        assert sorted(map(tuple, read_tag_counts(spark, root, kind).collect())) == sorted(map(tuple, counted.collect()))


def test_summaries_follow_three_loads_with_updates(spark, tmp_path):
    root, store = str(tmp_path / "catalogue"), str(tmp_path / "vectors")
    first = [work(k, kudos=str(100 * k), fandom=["A", f"F{k % 4}"], relationship=[f"R{k % 3}"]) for k in range(1, 30)]
    second = [work(29, kudos="1", bookmarks="", fandom=["A", "Z"]), work(40, kudos="50", relationship=["R1", "R9"])]
    third = [work(k, kudos="5", fandom=[f"F{k}", "A"]) for k in (1, 40, 41)]
    for name, rows in (("a", first), ("b", second), ("c", third)):
        load_works(spark, write_csv(tmp_path / f"{name}.csv", rows), root)
        assert_summaries(spark, root)
    assert read_profiles(spark, root)[1].first()["max_kudos"] == 2800  # the largest count fell in the second load
    compact(spark, root)
    assert_summaries(spark, root)
    embed_catalogue(spark, root, store, HashedTokenEncoder, "hashed")
    snapshot = current_snapshot(spark, root)
    core, tags = read_part(spark, snapshot, "core"), read_part(spark, snapshot, "pairs").withColumnRenamed("id", "tag")
    vectors = read_embeddings(spark, store)
    assert recommend_from(spark, root, store, 5).collect() == recommend(vectors, core, tags, 5).collect()
    queries = vectors.select("fic_id").withColumnRenamed("fic_id", "query_id")
    batch = [sorted(map(tuple, f.collect())) for f in (recommend_batch(vectors, core, tags, queries), recommend_batch_from(spark, root, store, queries))]
    assert batch[0] and batch[0] == batch[1]


def test_a_catalogue_without_summaries_gets_them(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    load_works(spark, write_csv(tmp_path / "a.csv", GOLDEN), root)
    snapshot = current_snapshot(spark, root)
    publish(spark, root, snapshot, {k: v for k, v in snapshot["parts"].items() if k in ("core", "dictionary", "pairs")})
    load_works(spark, write_csv(tmp_path / "b.csv", SECOND), root)
    assert_summaries(spark, root)


def test_batches_of_one_crawl_parse_its_csv_once(spark, tmp_path, monkeypatch):
    from catalogweave.suite import loading

    lines = ["title,url", *(f"t{k},https://host/works/{k}" for k in range(30))]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("\n".join(lines) + "\n")
    seen = []
    monkeypatch.setattr(loading, "_raw_files", lambda spark, sf_dir: str(tmp_path / "raw"))
    monkeypatch.setattr(loading, "load_frame", lambda spark, batch, root: seen.append(batch))
    loading._loaded_in_three(spark, "")
    plans = [batch._jdf.queryExecution().executedPlan().toString() for batch in seen]
    assert len(plans) == 3 and not any("FileScan csv" in plan for plan in plans)
    first, second, third = (sorted(r["title"] for r in batch.collect()) for batch in seen)
    assert not set(first) & set(second) and not set(second) & set(third) and len(second) + len(third) == 30
