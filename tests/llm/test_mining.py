"""Line dedup, tokenizer alignment and phrases against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from isofold.llm import alignment, lines, phrases


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", "\n", "a\nA \nb", "\ta\n\n\nÉ x\n", "É x\né x\nb\r", "same\nsame\nsame", "b\nlast line \nlast line", "x" * 5000 + "\n" + "b", "only this", "a", " a\x0b\nB\n" + "\n".join(f"l{i % 7}" for i in range(400))]


# ---------------------------------------------------------------- lines
def plain_lines(rows, min_docs, min_chars):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(UPPER)
    cut = [(d, (t or "").split("\n")) for d, t in rows]
    n = Counter(k for _, lines_ in cut for k in {key(x) for x in lines_} if len(k) >= min_chars)
    out = []
    for d, lines_ in cut:
        stay = [x for x in lines_ if not (len(key(x)) >= min_chars and n[key(x)] >= min_docs)]
        out.append((d, len(lines_), len(lines_) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,min_chars,broadcast_rows", [(2, 1, 100), (3, 1, 2), (2, 2, 1), (3, 0, 1)])
def test_lines_equal_a_plain_version(spark, min_docs, min_chars, broadcast_rows):
    rows = [(i % 10, t) for i, t in enumerate(TEXTS + TEXTS[3:7])] + [(None, "a\nmine"), (3, "a\nA \nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lines.without_common_lines(docs, min_docs, min_chars, broadcast_rows)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(((r[0], r[2], r[3], r[1] or "") for r in out.collect()), key=repr) == plain_lines(rows, min_docs, min_chars)


def test_lines_odd_rows(spark, odd_docs, no_docs):
    out = lines.without_common_lines(odd_docs, 2)
    assert out.count() == odd_docs.count() and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert out.where("text is null").count() == odd_docs.where("text is null").count()
    assert lines.without_common_lines(no_docs).collect() == []
    named = spark.createDataFrame([(1, "a", 7, "x", 3), (2, "a", 8, "y", 4)], "doc_id long, text string, n_lines long, `own.r1` string, gone long")
    assert lines.without_common_lines(named, 2).columns == ["doc_id", "text", "n_lines", "own.r1", "gone", "n_lines_", "n_dropped"]


# ---------------------------------------------------------------- alignment
def plain_alignment(texts):
    """By common ends, on whole texts, with the tokenizers library and with no chunks."""
    a, b = alignment.ByteLevel(f"{alignment.TOKENIZERS}/byte_bpe_50k.json", quick=False), alignment.Pieces(f"{alignment.TOKENIZERS}/piece_bpe_32k.model")
    found, docs_of = [], Counter()
    for t in texts:
        own = (" " + t).encode() if t else b""
        ia, ib = (a.encode([" " + t])[0], b.encode([t])[0]) if t else ([], [])
        if not t or b"".join(a.bytes[i] for i in ia) != own or b"".join(b.bytes[i] for i in ib) != own:
            found.append((0, 0, [], []))
            continue
        ea, eb = (np.cumsum([len(x.bytes[i]) for i in ids]).tolist() for x, ids in ((a, ia), (b, ib)))
        told, links, i, j = [], [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = [k for k in range(i, len(ea)) if ea[k] <= end], [k for k in range(j, len(eb)) if eb[k] <= end]
            i, j = i + len(p), j + len(q)
            told.append(",".join(str(ia[k]) for k in p) + "|" + ",".join(str(ib[k]) for k in q))
            links += [(ia[x], ib[y]) for x in p for y in q]
        found.append((len(ia), len(ib), told, links))
        docs_of.update(set(links))
    most = Counter()
    for (x, _), n in docs_of.items():
        most[x] = max(most[x], n)
    return [(na, nb, len(told), len(links), sum(docs_of[x] == most[x[0]] for x in links), sum(docs_of[x] for x in links), hashlib.sha256(";".join(told).encode()).hexdigest() if told else "") for na, nb, told, links in found]


ODD = [None, "", " ", "  ", " a", "a ", "a  b", "\n", "a\n b\n\n  c", "<|endoftext|> and <s> </s> <unk>", "▁ is a piece's space", "x▁y", "日本語のテキスト 𝒳 ﷺ é é", "  x 　 y", "a" * 3000, " " * 300 + "end", "don't I'll we've", "tab\tand\x00zero", "1234567 12.5%", "naïve straße   Ünder   x", "😀😀 👩‍👩‍👧", "﻿start", "É  \u0085 x"]


@pytest.mark.parametrize("broadcast_rows", [500_000, 20])
def test_alignment_equals_a_plain_version(spark, rows, broadcast_rows):
    own = [(i, t) for i, t in enumerate(ODD + [r[1] for r in rows])]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    texts, pairs = alignment.aligned(docs, broadcast_rows=broadcast_rows)
    found = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in texts.collect()}
    assert found == dict(enumerate(plain_alignment([t for _, t in own])))
    assert pairs.count() > 100 and pairs.where("best").select("a_id").distinct().count() == pairs.select("a_id").distinct().count()


def test_token_groups_tile_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    by = defaultdict(list)
    for r in alignment.token_groups(docs).orderBy("doc_id", "group").collect():
        by[r["doc_id"]].append(r)
    digests = {r["doc_id"]: r["groups_sha256"] for r in alignment.aligned(docs)[0].collect()}
    a = alignment.ByteLevel(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    for d, text in enumerate(ODD):
        told = ";".join(",".join(map(str, r["a_ids"])) + "|" + ",".join(map(str, r["b_ids"])) for r in by[d])
        assert digests[d] == (hashlib.sha256(told.encode()).hexdigest() if told else "")
        own = (" " + (text or "")).encode()
        for r in by[d]:
            assert b"".join(a.bytes[i] for i in r["a_ids"]) == own[r["begin"] : r["end"]]


def test_groups_of_random_tilings():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 30))
        a, b = (np.union1d(r.integers(1, n + 1, int(r.integers(0, n))), [n]) for _ in range(2))
        ga, gb = alignment.groups(a, b)
        common = np.intersect1d(a, b)
        assert ga.tolist() == np.searchsorted(common, a).tolist() and gb.tolist() == np.searchsorted(common, b).tolist()


def test_a_group_of_very_many_tokens_counts_distinct_ids():
    a, b = np.array([3, 3, 5, 3]), np.array([7, 8, 7])
    few = alignment.Chunks._pairs(2, np.array([0, 1]), np.concatenate((a, [1])), np.concatenate((b, [2])), np.array([4, 1]), np.array([3, 1]))
    many = alignment.Chunks._pairs(2, np.array([0, 1]), np.concatenate((a, [1])), np.concatenate((b, [2])), np.array([4, 1]), np.array([3, 1]), most=2)
    for x, y in zip(few, many):
        assert x.tolist() == y.tolist()
    assert few[2].tolist() == [6, 3, 2, 1, 1]


def test_alignment_forgets_without_a_change(monkeypatch):
    files = f"{alignment.TOKENIZERS}/byte_bpe_50k.json", f"{alignment.TOKENIZERS}/piece_bpe_32k.model"
    texts = [f"word{i} and other{i % 3} words  two" for i in range(40)] * 2
    once = alignment.Aligner(alignment.ByteLevel(files[0]), alignment.Pieces(files[1]))
    whole = once(texts)
    monkeypatch.setattr(alignment, "CHUNKS", 5)
    parts = [once(texts[i : i + 7]) for i in range(0, len(texts), 7)]
    assert [t for p in parts for t in p[1]] == whole[1]
    assert np.concatenate([p[3] for p in parts]).tolist() == whole[3].tolist() and np.concatenate([p[4] for p in parts]).tolist() == whole[4].tolist()


def test_alignment_without_rows(spark, odd_docs, no_docs):
    assert alignment.aligned(odd_docs)[0].count() == odd_docs.count()
    texts, pairs = alignment.aligned(no_docs)
    assert texts.collect() == [] and pairs.collect() == []


# ---------------------------------------------------------------- phrases
def plain_phrases(rows, max_n, least, within, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        g = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall(r"[^ \t]+", piece)
            n[g] += len(w)
            f[g].update(tuple(w[i : i + k]) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    out = []
    for g, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= within * a for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(g, i + 1, p.decode(), -a, l, r, n[g], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def corpus():
    r = random.Random(3)
    words = ["the", "The", "of", "a", "a\x01", "straße", "É", "日本", "x-y", "b"] + [f"w{i}" for i in range(25)]
    some = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(n))
    rows = [(some(r.randint(0, 60)), r.choice(["en", "fr", None, "a b", ""])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), (" . ", "en"), ("the of " * 400, "en"), ("the of w1", "en")] + [("copy of the same text, the of", "fr")] * 30


@pytest.mark.parametrize("max_n,least,share,salts", [(3, 3, 500, 64), (3, 10, 2, 4), (2, 2, 50, 3), (4, 3, 5, 7)])
def test_phrases_equal_a_plain_version(spark, monkeypatch, max_n, least, share, salts):
    monkeypatch.setattr(phrases.counted_phrases, "__defaults__", (3, 10, share, salts, 1_000_000))
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    out = sorted(tuple(r) for r in phrases.collocations(docs, max_n, least, 50, 40, 3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert out == plain_phrases(rows, max_n, least, 50, 40)


def test_phrases_odd_rows(spark, odd_docs, no_docs):
    assert phrases.collocations(no_docs).collect() == []
    rows = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd_docs, 3, 2).collect()) == plain_phrases(rows, 3, 2, 50, 2000)


def test_the_stack_counts_over_batches():
    r = random.Random(7)
    keys = Counter()
    for _ in range(600):
        w = [r.choice(["a", "aa", "b", "a\x01"]) for _ in range(r.randint(1, 3))]
        keys[(w[0] + " 656e " + "".join(x + " " for x in w[1:])).encode()] += r.randint(1, 3)
    rows = sorted(keys.items(), reverse=True)
    want = Counter()
    for k, n in rows:
        w = k.split(b" ")[:-1]
        for d in range(1, len(w)):
            want[b" ".join(w[: d + 1]) + b" "] += n
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + size]], pa.binary()), pa.array([n for _, n in rows[i : i + size]]), pa.array([False] * len(rows[i : i + size]))], ["key", "n", "cut"]) for i in range(0, len(rows), size)]
        found = Counter()
        for b in phrases.stack(3, 1)(iter(batches)):
            for x in b.to_pylist():
                assert x["key"] not in found
                found[x["key"]] = x["n"]
        assert found == want


def test_codes_fold_without_overflow():
    r = np.random.default_rng(2)
    columns = [r.integers(0, 1 << 30, 500) for _ in range(4)]
    columns[2][:250] = columns[2][250:]
    code = phrases._fold(*((c, 1 << 30) for c in columns))
    rows = list(zip(*(c.tolist() for c in columns)))
    assert len({(x, y) for x, y in zip(rows, code.tolist())}) == len(set(rows)) == len(set(code.tolist()))


