"""Language identification, toxicity and near-duplicates against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitaeflow.llm import language, near_duplicates, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else None, "s", "clash", "clash") for r in rows], DOCS)


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


SYLLABLES = {"en": ["the", "ing", "and", "ou", "er"], "de": ["sch", "ung", "ein", "ä", "keit"], "fr": ["eau", "é", "que", "oi", "ment"]}


def code_length(text: bytes, counts: dict) -> float:
    """Bits by the rule, context by context."""
    history, total = b"\n\n\n", 0.0
    for byte in text:
        bits = None
        escape = 0.0
        for order in range(3, -1, -1):
            seen = counts[order].get(history[len(history) - order :] if order else b"")
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if byte in seen:
                bits = escape - math.log2(seen[byte] / (n + kinds))
                break
            escape -= math.log2(kinds / (n + kinds))
        total += escape + 8 if bits is None else bits
        history = (history + bytes([byte]))[-3:]
    return total


def test_code_lengths_are_those_of_the_rule():
    rng = random.Random(2)
    counted, trees = {}, {}
    for lang, own in SYLLABLES.items():
        texts = [prose(rng, own, 60).encode() for _ in range(5)]
        grams = np.concatenate([language.grams(np.frombuffer(t, dtype=np.uint8), np.array([0])) for t in texts])
        keys, n = np.unique(grams, return_counts=True)
        counted[lang] = (keys.astype(np.uint64), n.astype(float))
        by = {o: defaultdict(Counter) for o in range(4)}
        for key, k in zip(keys.tolist(), n.tolist(), strict=True):
            four = int(key).to_bytes(4, "big")
            for o in range(4):
                by[o][four[3 - o : 3]][four[3]] += k
        trees[lang] = by
    model = language.Trees(counted)
    texts = ["", "a", "the", "schöneinung", "Zq#7 ∆ the eau", prose(rng, SYLLABLES["de"], 300), "x\n\n", "é"]
    got = model.score(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        for value, lang in zip(row, model.langs, strict=True):
            assert value == pytest.approx(code_length(text.encode(), trees[lang]), rel=1e-4, abs=1e-3)


def test_pieces_make_no_difference(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, SYLLABLES[rng.choice(list(SYLLABLES))], rng.randrange(0, 40)) if rng.random() > 0.2 else "" for _ in range(60)]
    keys, n = np.unique(np.concatenate([language.grams(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0])) for t in texts if t]), return_counts=True)
    model = language.Trees({"x": (keys.astype(np.uint64), n.astype(float))})
    whole = model.score(pa.array(texts))
    monkeypatch.setattr(language, "PIECE", 7)
    assert np.allclose(model.score(pa.array(texts)), whole, rtol=1e-6)


def test_language_rows(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, SYLLABLES[lang], 80), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 !!", "de"), (None, rows[0][1], None), (3, rows[3][1], rows[3][2])]
    frame = docs_of(spark, rows)
    fold = language.id_remainder(F.col("doc_id"), 5)
    got = language.identify(frame, language.learn(frame, fold != 0), F.coalesce(fold == 0, F.lit(False))).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:120]}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in got if r["doc_id"] in truth)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (500, 501, 502)} == {("und", 0.0)}
    none = frame.limit(0)
    assert language.learn(none, fold != 0) is None and language.identify(none, None, F.lit(False)).count() == 0


INSULTS = ["idiot", "moron", "clown"]


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        words = prose(rng, SYLLABLES["en"], 40).split()
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(40)] = INSULTS[i // 4 % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    frame = docs_of(spark, rows)
    return frame, toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), {r[0]: r[2] for r in labels}


def test_toxic_rows_are_told_apart(toxic):
    frame, model, truth = toxic
    got = toxicity.score(frame, model, toxicity.held_out()).collect()
    assert all(r["predicted"] == truth[r["doc_id"]] == int(r["score"] >= 0.3) for r in got)
    kept = toxicity.without_toxic(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, bad in truth.items() if not bad}


@pytest.mark.parametrize("text", ["you 1d10t", "such a m0r0n!", "an i d i o t indeed", "an i.d.i.o.t", "IDIOOOOOT", "cl0wn", "m-o-r-o-n", "you *idiot*", "m*ron"])
def test_disguises_are_seen_through(spark, toxic, text):
    _, model, _ = toxic
    assert toxicity.score(docs_of(spark, [(1, text)]), model, toxicity.held_out()).first()["predicted"] == 1


def test_plain_words_stay(toxic):
    restorer = toxicity.Restorer(toxic[1].costs)
    assert [restorer.word(w) for w in ("hello", "(hello),", "4566095658", "fe%%%", "hello!!")] == ["hello", "hello", "4566095658", "fe", "hello"]


def test_viterbi_is_the_best_path():
    costs = np.random.default_rng(6).random((28, 28, 28)) * 5

    def paths(word, at, a, b, last, cost, out):
        if at == len(word):
            yield cost + costs[a, b, 0], out
            return
        c = word[at]
        options = [(x, toxicity.COST_SAME) for x in c if "a" <= x <= "z"] + [(x, toxicity.COST_LEET) for x in toxicity.LEET.get(c, "")]
        for x, price in options:
            k = ord(x) - 96
            yield from paths(word, at + 1, b, k, x, cost + price + costs[a, b, k], out + x)
            if x == last:
                yield from paths(word, at + 1, a, b, last, cost + price + toxicity.COST_REPEAT, out)
        if c in toxicity.SEPARATORS:
            yield from paths(word, at + 1, a, b, last, cost + toxicity.COST_SEPARATOR, out)

    for word in ("a1b", "aab", "l1l", "a.b", "t7t", "1.1"):
        assert toxicity.decode(word, costs) == min(paths(word, 0, 0, 0, "", 0.0, ""))[1]


def test_toxicity_odd_rows(spark, toxic):
    _, model, _ = toxic
    rows = docs_of(spark, [(None, "idiot"), (1, None), (1, None), (2, ""), (3, "x " * 50000)])
    got = toxicity.score(rows, model, toxicity.held_out()).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(rows.limit(0), model, toxicity.held_out()).count() == 0
    blank = toxicity.fit(rows, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(rows, blank, toxicity.held_out()).collect()} == {0}


def near_copies(rng):
    rows = [(i, prose(rng, SYLLABLES["en"], rng.randint(3, 120))) for i in range(80)]
    base = prose(rng, SYLLABLES["de"], 150).split()
    for i in range(100, 160):  # copies of one text with a few words changed, some too many
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = f"changed{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    rows += [(200 + k, rows[k][1].upper()) for k in range(10)]
    return rows + [(300, None), (301, ""), (302, "one two"), (303, "ONE  two"), (None, rows[0][1]), (7, rows[7][1])]


def shingle_set(text):
    words = near_duplicates.words_of((text or "").encode())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def are_linked(a, b):
    return bool(a & b) and 100 * len(a & b) >= 85 * len(a | b)


def test_components_are_those_of_all_links(spark):
    rows = near_copies(random.Random(7))
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    component = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and are_linked(sets[a], sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    got = near_duplicates.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), component[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    one = near_duplicates.without_copies(docs_of(spark, rows))
    repeated = [7] if component[7] == 7 and not sets[7] else []
    assert sorted(r["doc_id"] for r in one.filter("doc_id is not null").collect()) == sorted([*set(component.values()), *repeated])


def test_a_large_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_MEMBERS", 90)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(110)]
    rows = []
    for i in range(700):  # most are further than the limit from most, and linked through some
        own = list(base)
        for k in rng.sample(range(110), rng.choice([1, 1, 2, 2, 2, 3])):
            own[k] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if top(i) != top(j) and are_linked(sets[i], sets[j]):
                label[max(top(i), top(j))] = min(top(i), top(j))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: top(i) for i in range(len(rows))}


def test_texts_under_one_doc_id_are_linked_each_by_itself(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (1, b), (5, b + " more"), (6, None), (6, None), (9, "x" * 200_000), (None, b)]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates.near_duplicates(docs_of(spark, rows)).collect() if r["doc_id"])
    assert got == [(1, 1), (1, 1), (1, 1), (5, 1), (6, 6), (6, 6), (9, 9)]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS row", "'z' AS component", "map(1, 2) AS whole")
    one = near_duplicates.without_copies(docs)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in one.collect()) == sorted([(1, a), (1, b), (6, ""), (6, ""), (9, "x" * 200_000), (0, b)])


def test_pigeonhole_finds_all_pairs_within_the_distance():
    rng = np.random.default_rng(8)
    for errors in range(near_duplicates.DISTANCE + 1):
        a = rng.integers(0, 1 << 16, (1, near_duplicates.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(near_duplicates.SYMBOLS, errors, replace=False)] += 1
        keys = near_duplicates.bucket_keys(np.vstack([a, b]))
        assert set(keys[0].tolist()) & set(keys[1].tolist())


@pytest.mark.parametrize("columns", [7, 2048])
@pytest.mark.parametrize("cut", [0, 13])
def test_spanning_links_connect_what_links_connect(monkeypatch, columns, cut):
    monkeypatch.setattr(near_duplicates, "COLUMNS", columns)
    rng = np.random.default_rng(9)
    sets = [np.unique(np.r_[np.arange(40)[rng.random(40) > 0.08], rng.integers(1000, 9000, 2)]).astype(np.uint64) for _ in range(40)]
    if cut:  # two blocks: what links between them connect
        pairs = {(i, j) for i in range(cut) for j in range(cut, 40)}
        links = near_duplicates.spanning_links(sets[:cut], sets[cut:], list(range(40)))
    else:
        pairs = {(i, j) for i in range(40) for j in range(40)}
        links = [(i, j - 40) for i, j in near_duplicates.spanning_links(sets, sets, [*range(40), *range(40)])]
    want = [(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]

    def groups(edges):
        label = list(range(40))
        for _ in range(40):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(links) == groups(want) and len(links) < 40


def test_near_duplicates_of_an_empty_table(spark):
    assert near_duplicates.near_duplicates(docs_of(spark, [(1, "x")]).limit(0)).count() == 0
