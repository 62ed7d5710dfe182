import math
import zlib
from collections import Counter

import numpy as np
import pytest

from isofold.llm import language, lattice

from . import brute


def in_fold(doc, mod):
    return doc is not None and zlib.crc32(str(doc).encode()) % mod == 2


def test_language_accuracy_on_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = language.predict_languages(docs.drop("source")).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if in_fold(d, 4)}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_score_equals_plain_sum(spark):
    data = [(i, t, l) for i, (t, l) in enumerate([("ab abc", "x"), ("abcabc b", "x"), ("zz yy zy", "y"), ("yyz zyz!", "y")] * 4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, cells=97)
    text = "Abc, zy"
    folded = np.array([ord(c.lower()) if c.isalpha() else 32 for c in f" {text} "], np.uint32)
    total = model.prior.copy()
    for order in language.ORDERS:
        for cell in language._cells(folded, order, 97):
            if cell >= 0:
                total = total + model.table[cell]
    raw = text.encode()
    labels, scores = model.predict(np.frombuffer(raw * 2, np.uint8), np.array([0, len(raw), 2 * len(raw)]))
    best = int(np.argmax(total))
    assert labels == [model.labels[best]] * 2 and np.allclose(scores, 1 / np.exp(total - total[best]).sum())


def test_language_odd_rows(odd_docs, no_docs, docs):
    out = language.predict_languages(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r["doc_id"]: r for r in out}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (1, 2, 3, 16, 17))
    assert by[4]["lang_pred"] in ("en", "fr")
    assert language.predict_languages(no_docs).collect() == []
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_keeps_columns(docs):
    model = language.fit_languages(docs)
    out = language.identified(docs, model)
    assert set(out.columns) == set(docs.columns) | {"lang_pred"} and out.count() == docs.count()


def all_segmentations(word: bytes, pieces):
    if not word:
        return 1.0
    return sum(p * all_segmentations(word[len(t) :], pieces) for t, p in pieces.items() if word.startswith(t))


def test_lattice_sums_all_segmentations():
    texts = [b"a", b"b", b"ab", b"ba", b"aba", lattice.MARK, lattice.MARK + b"a", lattice.MARK + b"ab"]
    p = np.array([0.1, 0.1, 0.15, 0.05, 0.1, 0.2, 0.1, 0.1, 0.1])
    pieces = lattice.Pieces.of(texts, np.log(p))
    words = [b"", b"a", b"ab", b"abab", b"ababbaba", b"bbbbbbbbbbbb", b"aba" * 12]
    got = lattice.word_logps(words, pieces)
    table = dict(zip(texts, p.tolist()))
    for w, g in zip(words, got):
        assert math.isclose(g, math.log(all_segmentations(lattice.MARK + w, table)) if w else math.log(p[-1]), rel_tol=1e-9)
    assert lattice.word_logps([b"xyz"], pieces)[0] == -np.inf


def test_long_pieces_count():
    """Every piece of the file that may stand in a word is there, and segmentations through long ones are summed."""
    import sentencepiece

    path = lattice.default_vocabulary()
    pieces, model = lattice.load_pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    long_ = [t for t in (model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)) if len(t) > 16 and lattice.MARK not in t[1:]]
    assert len(long_) > 50 and set(long_) <= set(pieces.texts)
    p = dict(zip(pieces.texts, np.exp(pieces.logp).tolist()))
    words = [t[len(lattice.MARK) :] for t in long_ if t.startswith(lattice.MARK)]
    for word, got in zip(words, lattice.word_logps(words, pieces)):
        raw, alpha = lattice.MARK + word, [1.0]
        for j in range(1, len(raw) + 1):
            alpha.append(sum(alpha[i] * p.get(raw[i:j], 0.0) for i in range(j)))
        assert math.isclose(got, math.log(alpha[-1]), rel_tol=1e-9)
    longest = b"a" * 40
    assert math.isclose(lattice.word_logps([longest], lattice.Pieces.of([lattice.MARK, longest], np.log(np.array([0.5, 0.3, 0.2]))))[0], math.log(0.15))


def test_expected_counts():
    texts = [b"a", b"b", b"ab", lattice.MARK]
    pieces = lattice.Pieces.of(texts, np.log(np.array([0.3, 0.2, 0.1, 0.3, 0.1])))
    out = np.zeros(4)
    for part, lat in lattice._lattices([b"ab"], pieces):
        lat.expected(np.array([2.0]), out)
    two, one = 0.3 * 0.3 * 0.2, 0.3 * 0.1
    share = one / (one + two)
    assert np.allclose(out, [2 * (1 - share), 2 * (1 - share), 2 * share, 2])


def test_likelihood_contract(docs, rows):
    out = {r["doc_id"]: r for r in lattice.lattice_scores(docs).collect()}
    tokens = {r[0]: brute.WORD.findall((r[1] or "").translate(brute.A_Z)) + [None] for r in rows}
    c = Counter(t for d, ts in tokens.items() if not in_fold(d, 7) for t in ts)
    n, v = sum(c.values()), len(c)
    assert set(out) == set(tokens)
    for d, ts in tokens.items():
        r = out[d]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (in_fold(d, 7), len(ts), sum(c[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_likelihood_is_a_distribution_over_known_and_new_words(spark):
    docs = spark.createDataFrame([(i, "aa bb aa cc") for i in range(5)], "doc_id long, text string")
    one = {r["doc_id"]: r["score"] for r in lattice.lattice_scores(docs).collect()}
    assert all(s < 0 for s in one.values()) and len(set(round(s, 9) for s in one.values())) == 1


def test_likelihood_odd_rows(odd_docs, no_docs):
    out = lattice.lattice_scores(odd_docs).collect()
    assert len(out) == odd_docs.count()
    none = [r for r in out if r["doc_id"] is None]
    assert len(none) == 2 and not any(r["held_out"] for r in none) and {r["n_tokens"] for r in none} == {4, 1}
    assert lattice.lattice_scores(no_docs).collect() == []


def test_training_helps_on_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = lattice.lattice_scores(docs).where("held_out").toPandas()
    plain = lattice.lattice_scores(docs, mod=1, fold=0).toPandas().set_index("doc_id").loc[learned["doc_id"]]
    assert (plain["train_tokens"] == 0).all()
    assert learned["score"].sum() / learned["n_tokens"].sum() > plain["score"].sum() / learned["n_tokens"].sum() + 0.3


@pytest.mark.parametrize("word", ["x" * 3000])
def test_long_word(spark, word):
    docs = spark.createDataFrame([(1, word), (3, "a " + word)], "doc_id long, text string")
    assert all(math.isfinite(r["score"]) for r in lattice.lattice_scores(docs).collect())


def plain_lattice(word: bytes, table: dict[bytes, float]) -> float:
    """The sum over all segmentations, place by place, in logs."""
    alpha, longest = [0.0], max(map(len, table))
    for j in range(1, len(word) + 1):
        parts = [alpha[i] + math.log(table[word[i:j]]) for i in range(max(0, j - longest), j) if word[i:j] in table and alpha[i] > -math.inf]
        top = max(parts, default=-math.inf)
        alpha.append(top + math.log(sum(math.exp(p - top) for p in parts)) if parts else -math.inf)
    return alpha[-1]


def plain_expected(word: bytes, table: dict[bytes, float], out: Counter) -> None:
    """Counts of pieces over all segmentations by their probability, by sums before and after each place."""
    n = len(word)
    arcs = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + max(map(len, table))) + 1) if word[i:j] in table]
    before, after = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j in sorted(arcs, key=lambda a: a[1]):
        before[j] += before[i] * table[word[i:j]]
    for i, j in sorted(arcs, key=lambda a: -a[0]):
        after[i] += table[word[i:j]] * after[j]
    for i, j in arcs:
        out[word[i:j]] += before[i] * table[word[i:j]] * after[j] / before[n]


def test_long_words_equal_plain():
    texts = [b"a", b"b", b"ab", b"ba", b"aba", b"abababa", lattice.MARK, lattice.MARK + b"a"]
    pieces = lattice.Pieces.of(texts, np.log(np.array([0.1, 0.1, 0.15, 0.05, 0.1, 0.05, 0.2, 0.1, 0.15])))
    table = dict(zip(texts, np.exp(pieces.logp).tolist()))
    rng = np.random.default_rng(2)
    for size in (1, 5, 127, 128, 129, 700):
        word = bytes(rng.choice([97, 98], size).tolist())
        want = plain_lattice(lattice.MARK + word, table)
        assert math.isclose(lattice._LongWord(word, pieces).total(), want, rel_tol=1e-12) and math.isclose(lattice.word_logps([word], pieces)[0], want, rel_tol=1e-9)
        out, counts = np.zeros(len(texts)), Counter()
        lattice._LongWord(word, pieces).expected(1.0, out)
        if size <= 129:
            plain_expected(lattice.MARK + word, table, counts)
            assert np.allclose(out, [counts[t] for t in texts])
    assert lattice._LongWord(b"abxab" * 50, pieces).total() == -math.inf
    old = lattice._LongWord.STRETCH
    try:
        lattice._LongWord.STRETCH = 37
        out, again = np.zeros(len(texts)), np.zeros(len(texts))
        lattice._LongWord(word, pieces).expected(1.0, out)
        assert math.isclose(lattice._LongWord(word, pieces).total(), want, rel_tol=1e-12)
        lattice._LongWord.STRETCH = old
        lattice._LongWord(word, pieces).expected(1.0, again)
        assert np.allclose(out, again)
    finally:
        lattice._LongWord.STRETCH = old


def test_word_of_a_megabyte():
    """Cost in proportion to length: a million bytes without a blank take seconds."""
    import time

    pieces = lattice.load_pieces(lattice.default_vocabulary())
    word = bytes(np.random.default_rng(1).choice(list(b"etaoinshr-_/0123"), 1_000_000).tolist())
    began = time.time()
    whole = lattice.word_logps([word], pieces)[0]
    assert time.time() - began < 60 and math.isfinite(whole) and whole < -1e6


@pytest.mark.parametrize("rounds", [0, 1])
def test_scores_equal_plain(docs, rows, rounds):
    """The whole query: counts, weights of the pieces, discount, sums over all segmentations."""
    out = {r["doc_id"]: r for r in lattice.lattice_scores(docs, rounds=rounds).collect()}
    tokens = {r[0]: [t.encode() for t in brute.WORD.findall((r[1] or "").translate(brute.A_Z))] for r in rows}
    c = Counter(t for d, ts in tokens.items() if not in_fold(d, 7) for t in [*ts, None])
    n, v = sum(c.values()), len(c)
    ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    discount = (ones + 0.5) / (ones + 2 * twos + 1)
    pieces = lattice.load_pieces(lattice.default_vocabulary())
    table = dict(zip(pieces.texts, np.exp(pieces.logp).tolist()))
    end = math.exp(pieces.logp[-1])
    if rounds:
        counts: Counter = Counter()
        for w in c:
            if w is not None:
                plain_expected(lattice.MARK + w, table, counts)
        total = sum(counts.values()) + 1 + 0.1 * (len(table) + 1)
        table, end = {t: (counts[t] + 0.1) / total for t in table}, 1.1 / total
    known = {w: math.exp(plain_lattice(lattice.MARK + w, table)) for w in {w for ts in tokens.values() for w in ts}} | {None: end}
    for d, ts in tokens.items():
        pure = sum(math.log10(known[t]) for t in [*ts, None])
        whole = sum(math.log10((c[t] - discount) / n * (c[t] > 0) + discount * v / n * known[t]) for t in [*ts, None])
        assert math.isclose(out[d]["lattice_score"], pure, rel_tol=1e-8) and math.isclose(out[d]["score"], whole, rel_tol=1e-8)


def test_ends_stay_with_their_documents(docs):
    """No word is the end's: the steps' lists have none, and a step has one row for each of its words."""
    steps = lattice._listed(docs.select("doc_id", "text"), 7, 2).toPandas()
    for _, own in steps.groupby("step"):
        words = [w for row in own["words"] for w in row]
        assert b"" not in words and len(set(words)) == len(words) and own["pairs"].notna().sum() == 1


def test_language_query_equals_plain(spark, sf):
    """The whole query: counts of hashed n-grams of each language, smoothed, by a plain loop over characters; the fit takes all rows here."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    cells, seen, n_docs = language.CELLS, {}, Counter()

    def grams(text):
        folded = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text} "]
        for order in (1, 2, 3):
            for i in range(len(folded) - order + 1):
                part = folded[i : i + order]
                if any(x != " " for x in part):
                    h = order * 0x9E3779B1
                    for x in part:
                        h = ((h ^ ord(x)) * 0x100000001B3) % 2**64
                        h ^= h >> 29
                    yield h % cells

    for d, text, lang in docs:
        if text is not None and lang is not None and not in_fold(d, 4):
            n_docs[lang] += 1
            seen.setdefault(lang, Counter()).update(grams(text))
    total = {k: sum(v.values()) for k, v in seen.items()}
    out = {r["doc_id"]: r for r in language.op6_language_bayes(spark, sf).collect()}
    assert set(out) == {d for d, _, _ in docs}
    for d, text, _ in docs:
        if len(text or "") > 4000:
            continue
        odds = {k: math.log(n_docs[k] / sum(n_docs.values())) + sum(math.log((seen[k][g] + 0.5) / (total[k] + 0.5 * cells)) for g in grams(text or "")) for k in sorted(seen)}
        best = max(odds, key=odds.get)
        if any(c.isalpha() for c in text or ""):
            assert out[d]["lang_pred"] == best and math.isclose(out[d]["score"], 1 / sum(math.exp(v - odds[best]) for v in odds.values()), rel_tol=1e-3)
        else:
            assert out[d]["lang_pred"] == "und" and out[d]["score"] == 0
