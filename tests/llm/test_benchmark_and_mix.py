import duckdb
import pytest
from pyspark.sql import functions as F

from isofold.llm import decontamination, mixing

from . import brute


@pytest.fixture(scope="module")
def items(spark, rows):
    text = {r[0]: r[1] for r in rows}
    data = [(1, text[8]), (2, "one"), (3, "two, WORDS!"), (4, None), (5, "..."), (6, " ".join(text[50].split()[10:40])), (7, " ".join(text[11].split()[100:113])), (None, text[50]), (8, " ".join(text[20].split()[:12])), (1, text[7])]
    return spark.createDataFrame([(*d, "x") for d in data], "item_id long, text string, doc_id string")


def rows_of(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_contamination_equals_brute_force(docs, rows, items, broadcast):
    own = items.where("item_id is not null")
    want = brute.contamination([(r[0], r[1]) for r in rows], [(r["item_id"], r["text"]) for r in own.collect()])
    found = rows_of(decontamination.contamination(docs, own, broadcast_rows=broadcast))
    assert found == want
    assert any(w[4] for w in want.values()) and any(0 < w[1] for w in want.values())


def test_contamination_plan_is_native(docs, items):
    plan = decontamination.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_contamination_odd_rows(odd_docs, no_docs, docs, items):
    assert decontamination.contamination(odd_docs, items).count() == odd_docs.count()
    assert decontamination.contamination(no_docs, items).count() == 0
    none = decontamination.contamination(docs, items.limit(0)).collect()
    assert len(none) == docs.count() and not any(r["contaminated"] or r["n_hit"] for r in none)


def test_contamination_sql(spark, docs, items, tmp_path):
    d, i = docs.select("doc_id", "text").toPandas(), items.where("item_id is not null").select("item_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", d), con.register("benchmark", i)
    want = {r[0]: tuple(r[1:]) for r in con.sql(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({decontamination.SQL})").fetchall()}
    assert rows_of(decontamination.contamination(docs, items.where("item_id is not null"))) == want


def test_ascii_lower(spark):
    data = ["ABC xyz", "ÉCOLE Straße", "İI", "ǅ", "Ⓐ Ⅷ", "ΑΣ", "日本A", "", None]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in data], "t string").select(decontamination.ascii_lower(F.col("t"))).collect()]
    assert out == [t.translate(brute.A_Z) if t is not None else None for t in data]


def test_mix_meets_targets_and_sql(docs):
    out = mixing.mix(docs, block_words=8).collect()
    assert len(out) == docs.count()
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    by = {}
    for r in out:
        s = by.setdefault((r["source_size"], r["target"]), [0, r["source_size"], r["target"]])
        s[0] += r["taken"]
    assert all(abs(t - target) <= 2 * 8 for t, _, target in by.values())
    assert abs(sum(v[2] for v in by.values()) - 1.5 * sum(v[1] for v in by.values())) < 1e-6
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    want = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.oracle(8)})").fetchall())
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in out) == want


def plain_targets(sizes):
    """Targets by hand: share, stop at the cap, share what is left again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, list(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] >= 2 * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 77, "é": 0, "z": 300}, {"x": 4}, {None: 9}, {"a": 0, "b": 0}, {chr(97 + i): (i * 37) % 91 + 1 for i in range(24)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    out = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert set(out) == set(want) and all(abs(out[s] - want[s]) < 1e-6 * max(1, want[s]) for s in out)


def test_shuffles_are_permutations(spark):
    t = spark.createDataFrame([("a", 64 * 301), ("b", 64 * 17 + 5), ("c", 3)], "source string, source_size long")
    targets = mixing.source_targets(t)
    slots = mixing.mix_slots(targets, shard_slots=50, chunk=64).collect()
    n = sum(r["slots"] for r in targets.collect())
    assert sorted(r["place"] for r in slots) == list(range(n))
    for r in targets.collect():
        for p in (0, 1):
            blocks = [x["block"] for x in slots if x["s"] == r["s"] and x["pass"] == p]
            assert len(set(blocks)) == len(blocks)
            if len(blocks) == r["blocks"]:
                assert sorted(blocks) == list(range(r["blocks"]))


def test_shards_draw_by_weight(spark):
    t = spark.createDataFrame([("a", 64 * 3010), ("b", 64 * 2000 + 5), ("c", 64 * 900)], "source string, source_size long")
    targets = mixing.source_targets(t)
    slots = mixing.mix_slots(targets, shard_slots=500).toPandas()
    n = len(slots)
    for r in targets.collect():
        mine = slots[slots["s"] == r["s"]]
        share = r["slots"] / n
        per = mine.groupby("shard").size().reindex(range(n // 500), fill_value=0)
        assert (abs(per - 500 * share) < 5 * (500 * share * (1 - share)) ** 0.5).all()
        first = mine[mine["pass"] == 0].sort_values("k")["block"].to_numpy()
        assert (abs(first[1:] - first[:-1]) == 1).mean() < 0.01


def test_counts_are_drawn_and_adjusted(spark):
    """The shards' counts are free draws but for what the targets take back, which is spread along the shards."""
    t = spark.createDataFrame([(chr(97 + i), 64 * (900 + 400 * i)) for i in range(7)] + [("z", 5), ("y", 0)], "source string, source_size long")
    targets = mixing.source_targets(t)
    H = 250
    counts = mixing.drawn_counts(targets, H).toPandas()
    due = {r["s"]: (r["slots"], r["slot_from"]) for r in targets.collect() if r["slots"]}
    n = sum(v[0] for v in due.values())

    def drawn(x):
        p, sq = 2147483647, lambda v: v % 2147483647 * (v % 2147483647) % 2147483647
        a = ((x % p + (x >> 31) * 69621) % p + 918273) % p
        a = (sq(a) * 48271 + 12345) % p
        a = (sq(a) * 69621 + x % p) % p
        b = (sq(a) * 48271 + 777) % p
        return (b * 2147483648 + (sq(b) * 69621 + a) % p) % n

    free = {}
    for x in range(n):
        v = drawn(x)
        s = next(s for s, (k, lo) in due.items() if lo <= v < lo + k)
        free[x // H, s] = free.get((x // H, s), 0) + 1
    totals = {s: sum(v for (_, o), v in free.items() if o == s) for s in due}
    got = {(r["shard"], r["s"]): r["n"] for r in counts.to_dict("records")}
    assert any(totals[s] != due[s][0] for s in due)
    for s in due:
        assert sum(v for (_, o), v in got.items() if o == s) == due[s][0]
        if totals[s] > due[s][0]:
            e, done = totals[s] - due[s][0], 0
            for h in range(-(-n // H)):
                was, done = done, done + free.get((h, s), 0)
                assert got.get((h, s), 0) == done - was - (done * e // totals[s] - was * e // totals[s])
    assert all(got.get(k, 0) >= v for k, v in free.items() if totals[k[1]] <= due[k[1]][0])
    sizes = counts.groupby("shard")["n"].sum()
    assert (sizes.iloc[:-1] == H).all() and sizes.sum() == n
    for s, own in counts.groupby("s"):
        own = own.sort_values("shard")
        assert list(own["k_from"]) == [0, *own["n"].cumsum()[:-1]]
    chi = [(v - H * due[s][0] / n) ** 2 / (H * due[s][0] / n) for (h, s), v in free.items() if h < n // H and due[s][0] > n / 20]
    assert 0.5 < sum(chi) / len(chi) < 1.2


def test_running_sums(spark):
    df = spark.createDataFrame([(k, i, (i * 7) % 5) for k in "ab" for i in range(0, 100, 3)], "k string, i long, v long")
    for r in mixing.running(df, ["k"], "i", "v", "before", chunk=8).collect():
        assert r["before"] == sum((i * 7) % 5 for i in range(0, r["i"], 3))
    assert {r["before"] for r in mixing.running(df.where("k = 'a'"), [], "i", "v", "before", chunk=1000).collect()} > {0}


@pytest.mark.parametrize("n", [2**31 + 11, 848143 * 648007, 2**43 - 7])
def test_permutations_beyond_32_bits(spark, n):
    """Steps are one to one and stay within n, on numbers at both ends and in between; nothing overflows."""
    from pyspark.sql import functions as F

    some = sorted({*range(2000), *range(n - 2000, n), *(n * k // 999 for k in range(999))})
    df = spark.createDataFrame([(x,) for x in some], "x long").withColumn("was", F.col("x"))
    out = mixing._stepped(df, "x", mixing.shuffle_rounds("x", f"{n}L", "CAST(77 AS BIGINT)")).collect()
    images = [r["x"] for r in out]
    assert len(set(images)) == len(some) and all(0 <= x < n for x in images)
    assert sum(x > n // 2 for x in images) > len(images) * 0.45
    drawn = [r["drawn"] for r in mixing._stepped(df, "drawn", mixing.draw_steps("x", f"{n}L")).collect()]
    assert all(0 <= x < n for x in drawn) and abs(sum(drawn) / len(drawn) / n - 0.5) < 0.03


def test_hot_ids_are_spread(spark):
    """Null ids, one id for many texts and ids with a stride don't make a chunk of their own."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i * 1024, "s", f"w{i} " * (i % 5 + 1)) for i in range(9000)]
    base = mixing.measured(spark.createDataFrame(rows, "doc_id long, source string, text string")).selectExpr("*", "1L AS s")
    n = 9000 // 256
    chunks = base.selectExpr(f"{mixing._chunk(str(n))} AS c").groupBy("c").count().toPandas()["count"]
    assert len(chunks) == n and chunks.max() < 2 * 9000 / n


def test_what_documents_give_is_what_shards_take(docs, monkeypatch):
    """The words of each source that the shards take are those taken of its documents; a mix that loses a shard shows it."""
    shards = mixing.mix_by_shard(docs, block_words=8, shard_slots=100).toPandas()
    assert (shards.groupby("shard")["times"].sum().sort_index().iloc[:-1] == 100).all() and shards["shard"].nunique() > 3
    taken = mixing.mix(docs, block_words=8).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "size": "sum"}).collect()
    for r in taken:
        of = shards[shards["source"].isna() if r["source"] is None else shards["source"] == r["source"]]
        short = -r["sum(size)"] % 8
        last = of.loc[of["block"] == (r["sum(size)"] - 1) // 8, "times"].sum()
        assert of["times"].sum() * 8 - short * last == r["sum(taken)"]
    whole = mixing.shard_blocks
    monkeypatch.setattr(mixing, "shard_blocks", lambda targets: whole(targets).where("shard <> 0"))
    assert mixing.mix(docs, block_words=8).agg({"taken": "sum"}).first()[0] == 0


def test_mix_odd_rows(odd_docs, no_docs, spark):
    out = mixing.mix(odd_docs)
    assert out.count() == odd_docs.count() and out.where("taken > 2 * size").count() == 0
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 2


def test_mix_reruns_agree(docs):
    a, b = (sorted((r["doc_id"], r["taken"]) for r in mixing.mix(x).collect()) for x in (docs, docs.repartition(7)))
    assert a == b
