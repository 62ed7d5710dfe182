import random

import duckdb
import numpy as np
import pytest

from isofold.llm import simhash, substring
from isofold.operators.graph import components

from . import brute


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_simhash_equals_brute_force(docs, rows):
    found = {r["doc_id"]: (f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    assert found == brute.simhash(pairs(rows))


@pytest.mark.parametrize("shingle,bits", [(1, 0), (2, 5), (5, 8)])
def test_simhash_parameters(docs, rows, shingle, bits):
    found = {r["doc_id"]: (f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in simhash.simhash_groups(docs, shingle, bits).collect()}
    assert found == brute.simhash(pairs(rows), bits, shingle)


def test_simhash_odd_rows(odd_docs, no_docs):
    out = simhash.simhash_groups(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r["component_id"] is not None for r in out if r["doc_id"] is not None)
    assert simhash.simhash_groups(no_docs).collect() == []


def test_vantage_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(c) for c in rng.integers(0, 2**63, 3000, dtype=np.uint64)}
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for _ in range(int(rng.integers(0, 4))):
                x ^= 1 << int(rng.integers(64))
            fps.add(x)
    fp = np.array(sorted(fps), np.uint64)
    met = set()
    for half in range(2):
        tree = simhash.VantageTree(simhash.halves(fp)[half][::7], 1, 32, 5)
        assert tree.shards > 8
        index, shard = tree.route(simhash.halves(fp)[half])
        for s in range(tree.shards):
            part = index[shard == s]
            d = np.bitwise_count(fp[part][:, None] ^ fp[part][None, :])
            met |= {(int(part[i]), int(part[j])) for i, j in zip(*np.nonzero(d <= 3)) if part[i] < part[j]}
    want = set()
    for lo in range(0, len(fp), 500):
        d = np.bitwise_count(fp[lo : lo + 500][:, None] ^ fp[None, :])
        want |= {(int(i) + lo, int(j)) for i, j in zip(*np.nonzero(d <= 3)) if i + lo < j}
    assert met == want


@pytest.mark.parametrize("half", [0, 1])
def test_shared_halves_are_split(half):
    """Thousands of fingerprints with one half in common part by their other half, and no pair is lost."""
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**32, 300, dtype=np.uint64)
    mine = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(8):
            x = c
            for _ in range(int(rng.integers(1, 4))):
                x ^= 1 << int(rng.integers(32))
            mine.add(x)
    shift = 32 * (1 - half)
    fp = np.array(sorted((0xABCD1234 << (32 - shift)) | (x << shift) for x in mine), np.uint64)
    own, other = simhash.halves(fp)[half], simhash.halves(fp)[1 - half]
    assert len(np.unique(own)) == 1
    tree = simhash.VantageTree(own[::5], 1, 32, 5, other[::5], 3)
    index, shard = tree.route(own, other)
    assert tree.shards > 8 and np.bincount(shard).max() < len(fp) / 3
    met, want = set(), set()
    for s in range(tree.shards):
        part = index[shard == s]
        d = np.bitwise_count(fp[part][:, None] ^ fp[part][None, :])
        met |= {(int(part[i]), int(part[j])) for i, j in zip(*np.nonzero(d <= 3)) if part[i] < part[j]}
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 3)) if i < j}
    assert met == want
    a, b = simhash.linked_stars(fp, np.arange(len(fp)), half, 3)
    label = list(range(len(fp)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in want:
        x, y = sorted((root(i), root(j)))
        label[y] = x
    star = dict(zip(b.tolist(), a.tolist()))
    assert [star.get(i, i) for i in range(len(fp))] == [root(i) for i in range(len(fp))]


def test_shards_return_stars_not_pairs():
    base = 0x0123456789ABCDEF
    fp = np.array([base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)] + [base], np.uint64)
    a, b = simhash.linked_stars(fp, np.arange(len(fp)), 0, 3)
    assert len(b) == len(fp) - 1 and set(a.tolist()) == {0}


def test_many_shards_give_the_same_groups(spark):
    rng = random.Random(1)
    rows = []
    for g in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(120)]
        for k in range(4):
            w = list(words)
            if k:
                w[rng.randrange(120)] = "changed"
            rows.append((g * 4 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(df).collect()}
    many = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(df, shard_rows=8, sample_per_shard=4).collect()}
    assert one == many == {d: c for d, (_, c) in brute.simhash(rows).items()}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 4999), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(101)} == {0} and {found[k] for k in range(1000, 1200)} == {1000} and found[5000] == 4999


def test_substring_equals_brute_force(docs, rows):
    import hashlib

    out = substring.without_repeats(docs).collect()
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out}
    assert found == brute.repeats(pairs(rows))
    assert sum(r["n_removed"] for r in out) > 4000


def test_substring_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = "doc_id, n_words, n_removed, kept_sha256"
    want = con.sql(f"SELECT {names} FROM ({substring.SQL})").fetchall()
    out = substring.op3_substring_superkmer(spark, sf)
    assert sorted(tuple(r) for r in out.select(*names.split(", ")).collect()) == sorted(want) and sum(r[2] for r in want) > 100


@pytest.mark.parametrize("window,mer", [(1, 1), (3, 2), (8, 8), (20, 1)])
def test_substring_parameters(docs, rows, window, mer):
    out = substring.without_repeats(docs, window, mer, bucket_words=50).collect()
    want = brute.repeats(pairs(rows), window)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in out} == {d: w[:2] for d, w in want.items()}


def test_substring_odd_rows(odd_docs, no_docs):
    out = substring.without_repeats(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r["n_removed"] == 0 for r in out if r["doc_id"] is None)
    assert substring.without_repeats(no_docs).collect() == []


def test_frequent_runs_only_move_windows(docs, rows, monkeypatch):
    real = substring.corpus_profile
    monkeypatch.setattr(substring, "corpus_profile", lambda *a: (real(*a)[0], np.sort(substring._mers(substring._Words(np.frombuffer(rows[7][1].encode(), np.uint8), np.array([0, len(rows[7][1].encode())])), 4))))
    out = substring.without_repeats(docs).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {d: w[1] for d, w in brute.repeats(pairs(rows)).items()}


def test_one_hash_for_two_sequences_is_told_apart(monkeypatch):
    class Same(substring.SpanHash):
        def __call__(self, starts, ends):
            return np.zeros(len(starts), np.uint64)

    monkeypatch.setattr(substring, "SpanHash", Same)
    one = (np.array([1, 2]), np.array([0, 0]), np.array([2, 2]), b"a b c\na b d")
    docs, starts = substring._repeats([one], 2)
    assert list(zip(docs.tolist(), starts.tolist())) == [(2, 0)]
