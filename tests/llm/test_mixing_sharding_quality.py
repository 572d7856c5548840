"""Mixing, sharding and quality rules against brute force on small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitaeflow.llm import mixing, quality, sharding

DOCS = "doc_id long, text string, source string, size string, kept string, shard string, slot string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash", "clash", "clash") for i, t, s in rows], DOCS)


ODD = [(None, "a b c", "s1"), (1, None, "s1"), (2, "", "s2"), (3, " \t\n", None), (4, "one", "s2"), (4, "one", "s2"), (5, "w " * 3000, "s3"), (6, "x y", None)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 120))), f"s{min(int(rng.integers(0, 9)), 5)}") for i in range(600)]
    rows += [(1000 + i, "w " * 37, "s5") for i in range(400)]  # a hot group of one source and size
    return rows, mixing.mix(docs_of(spark, rows)).collect()


def test_targets_and_bounds(corpus):
    rows, got = corpus
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    names = sorted(sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:  # share, stop at three times the size, share the excess again
        rest = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in names if x not in fixed) for s in names if s not in fixed}
        over = {s: 3.0 * sizes[s] for s, t in rest.items() if t > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    want = fixed | rest
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s in names:
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=60)


def test_rates_follow_the_tilt(corpus):
    """Within a source, taken copies by size lie within one of the balanced rates."""
    rows, got = corpus
    by = defaultdict(list)
    for r in got:
        by[r["source"], r["size"]].append(r["copies"])
    for source in {s for s, _ in by}:
        n = {z: len(c) for (s, z), c in by.items() if s == source}
        target = next(r["target"] for r in got if r["source"] == source)
        mean = sum(z * k for z, k in n.items()) / sum(n.values())
        low, high = -50.0, 50.0
        for _ in range(200):
            lam = (low + high) / 2
            if sum(k * z * min(3, math.exp(min(50, lam * z / mean))) for z, k in n.items()) < target:
                low = lam
            else:
                high = lam
        for z, k in n.items():
            rate = min(3, math.exp(min(50, lam * z / mean)))
            assert math.floor(rate - 1e-6) * k <= sum(by[source, z]) <= math.ceil(rate + 1e-6) * k


def test_mix_reruns_agree_and_takes_odd_rows(spark):
    frame = docs_of(spark, ODD)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    first, second = (sorted(map(key, mixing.mix(frame).collect())) for _ in range(2))
    assert first == second and len(first) == len(ODD)
    assert mixing.mix(frame.limit(0)).count() == 0
    rows = mixing.mixed_rows(frame)
    assert rows.columns == frame.columns and rows.filter("doc_id = 2").count() == 1


def test_rows_that_differ_in_other_columns_stay_apart(spark):
    kind = "doc_id long, text string, source string, lang string, draw map<string, int>"
    rows = [(1, "a b c d", "s1", "en", {"k": 1}), (1, "a b c d", "s2", "de", {"k": 1}), (1, "a b c d", "s2", "de", {"k": 2}), (None, "x", "s1", None, None), (None, "x", "s1", None, None)]
    got = mixing.mixed_rows(spark.createDataFrame(rows, kind))
    assert got.schema.simpleString() == spark.createDataFrame(rows, kind).schema.simpleString()
    assert {(r["source"], (r["draw"] or {}).get("k")) for r in got.collect()} >= {("s2", 1), ("s2", 2)}


def test_many_sizes_and_very_long_texts(spark):
    rows = [(i, "w " * (i + 1), "s1") for i in range(700)] + [(9000, "w " * 60_000, "s2"), (9001, "w", "s2"), (9002, "w " * 90, "s2")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    for s in ("s1", "s2"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= (1 if s == "s1" else 30_000)


def test_a_balance_that_is_not_reached_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError, match="no balance"):
        mixing.mix(docs_of(spark, [(i, "w " * (i + 1), f"s{i % 2}") for i in range(20)]))


def test_jump_moves_rows_into_the_new_shard_only():
    mixed = sharding.mix(np.arange(-500, 20000))
    for n in (1, 2, 7, 40):
        old, new = sharding.jump(mixed, n), sharding.jump(mixed, n + 1)
        moved = old != new
        assert (new[moved] == n).all() and old.max() < n
        assert abs(moved.mean() - 1 / (n + 1)) < 0.02
    assert sharding.jump(mixed[:5], 40).tolist() == [one(int(x), 40) for x in mixed[:5]]


def one(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_slots_are_gapless(spark):
    rows = [(i, f"t{i % 7}", "s") for i in range(100, 900)] + ODD
    got = sharding.assign_shards(docs_of(spark, rows), 5).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {i: t for i, t, _ in rows if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    assert sharding.assign_shards(docs_of(spark, rows).limit(0)).count() == 0
    whole = sharding.sharded_rows(docs_of(spark, rows), 5).collect()
    key = lambda r: (str(r["doc_id"]), r["shard"], r["slot"], r["grown_shard"])
    assert sorted(map(key, whole)) == sorted(map(key, got))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


TEXTS = [
    None, "", " \n\t ", "Too short.", "A plain line of prose that ends well, as it should do.\nAnother one that is just as good as that.", "word " * 40, "a b c d e " * 3 + "tail f g h i j k.",
    "Home | About | News | Contact | More\n" * 3 + "One real sentence stands at the end.", "THIS IS ALL LOUD!! AND IT NEVER EVER STOPS!! REALLY NOT!!", "fe%%% fi*** fo$$$ fum### one&&& two%%% six*** ten$$$ and### so&&&",
    "A long and honest sentence that should be kept as it is.\nAll rights reserved.\nMore of the honest text that follows after it.", "é ñ ü 漢字 words in other scripts are words as well, to be sure.\x0b\x0c x", "same line here.\nsame line here.\nsame line here.\nother line to end this text.",
    "no mark at the end of any of these words at all\nnor here where more of them are standing",
]


def test_quality_counts(spark):
    frame = docs_of(spark, [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "s"), (4, TEXTS[4], "s")])
    got = quality.judge(frame).orderBy("doc_id").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(TEXTS[r["doc_id"]])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {4, 10} <= kept and not kept & {0, 1, 2, 3, 5, 7, 8, 9, 13}
    assert "rights" not in quality.clean(frame.filter("doc_id = 10")).first()["text"]
    assert quality.judge(frame.limit(0)).count() == 0


def test_native_plans(spark, monkeypatch):
    cuts, cut = [], mixing.cut
    frame = docs_of(spark, ODD)
    plan = quality.judge(frame)._jdf.queryExecution().toString() + mixing.mix(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("pythonUDF", "Python"))
    monkeypatch.setattr(mixing, "cut", lambda df: cuts.append(df._jdf.queryExecution().toString()) or cut(df))
    mixing.mix(frame)
    assert len(cuts) > 5 and not re.search("Python|Arrow|Pandas", "".join(cuts).replace("pythonUDF", "Python"))
