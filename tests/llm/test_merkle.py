"""The Merkle manifest against a tree built level by level on the driver."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from catalogweave.llm import merkle
from catalogweave.llm.suite import op13_merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    """(root, the proof of every leaf as (left, right) per level)."""
    proofs, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for proof, at in zip(proofs, place):
            first = at // 3 * 3
            proof.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        place = [at // 3 for at in place]
        level = [sha("".join(level[at : at + 3])) for at in range(0, len(level), 3)]
    return level[0], proofs


def brute_rows(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r, r["text"])))
        trees.append((own, *brute_tree([brute_leaf(r, r["text"]) for r in own])))
    root, tops = brute_tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, proofs), top in zip(trees, tops):
        for row, proof in zip(own, proofs):
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = brute_leaf(row, text)
            for left, right in proof + top:
                node = sha(left + node + right)
            siblings = "".join(left + right for left, right in proof + top)
            out.append((row["doc_id"], brute_leaf(row, row["text"]), subroot, root, sha(siblings), node, node == root))
    return out


def test_addresses():
    for count in [*range(1, 60), 81, 100, 243, 244]:
        for height in (merkle.height_of(count), merkle.height_of(count) + 2):
            log = merkle.append_log([f"{i:064x}" for i in range(count)], height)
            places = [merkle.position(k, i, count, height) for k in range(height + 1) for i in range(merkle.width(k, count))]
            assert sorted(places) == list(range(len(log)))
            assert [log[merkle.position(0, i, count, height)] for i in range(count)] == [f"{i:064x}" for i in range(count)]
        assert log and merkle.append_log([f"{i:064x}" for i in range(count)], merkle.height_of(count))[-1] == brute_tree(
            [f"{i:064x}" for i in range(count)]
        )[0]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = [tuple(r) for r in op13_merkle(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute_rows(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "SPAN", 9)


def test_many_builders_and_sources(spark, tmp_path, small_blocks):
    """Trees of three levels of builders, a hot source, a tree over many sources, repeated and null keys."""
    random.seed(4)
    rows = []
    for k in range(400):
        source = None if k % 31 == 0 else "hot" if k % 3 == 0 else f"é{random.randrange(60)}"
        rows.append((k if k % 17 else None, f"text\n{k}", random.choice([None, "en"]), source, k % 5, "x"))
    rows += rows[40:60] + [(7, None, None, "hot", None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in op13_merkle(spark, str(tmp_path)).collect())
    assert got == Counter(brute_rows(docs.collect()))
    manifest = merkle.build_manifest(docs, "source", "doc_id", merkle.leaf_digest(docs["doc_id"], docs["text"]))
    assert len(manifest.builders) >= 2 and len(manifest.top) >= 2
    entries = merkle.log_entries(manifest).collect()
    by_tree = {}
    for entry in entries:
        by_tree.setdefault(entry["tree"], []).append(entry)
    subroots = {r["tree"]: r["subroot"] for r in manifest.subroots.collect()}
    assert set(by_tree) == set(subroots)
    for tree, own in by_tree.items():
        own.sort(key=lambda e: e["position"])
        assert [e["position"] for e in own] == list(range(len(own))) and own[-1]["digest"] == subroots[tree]
        leaves = [e["digest"] for e in own if e["level"] == 0]
        assert [e["digest"] for e in own] == merkle.append_log(leaves, merkle.height_of(len(leaves)))


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "row", "fp").write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = Counter(tuple(r) for r in op13_merkle(spark, f"{tmp_path}/odd").collect())
    assert got == Counter(brute_rows(odd_docs.collect()))
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    none = op13_merkle(spark, f"{tmp_path}/none")
    assert none.collect() == [] and none.columns[-1] == "verified"
    single = no_docs.unionByName(spark.createDataFrame([(1, "a", "en", "s", 1)], no_docs.schema))
    single.write.parquet(f"{tmp_path}/one/documents.parquet")
    row = op13_merkle(spark, f"{tmp_path}/one").first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == sha("")
