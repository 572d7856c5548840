"""Divergence of sources against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitaeflow.llm import divergence as audit

KIND = "doc_id long, text string, lang string, source string, n long, term string, total int, `a b` string"


def by_hand(docs):
    counts, texts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        texts[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in texts[lang].items() if n >= 10]
        sources = sorted(s for g, s in groups if g == lang)

        def share(own):
            n = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        usual = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], usual[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > usual[t]]
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(terms)[:10])]
    return sorted(out)


def corpus(seed, n=500):
    rng = random.Random(seed)
    words = ["The", "the", "ÄRGER", "ärger", "日本", "a-b", "x1y", "don't", "É", "\x00z", "😀"] + [f"{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    out = []
    for k in range(n):
        source = rng.choice(["s1", "s2", "s10", "S", None, "é", "日"])
        some = words if source != "s1" else words[:20]
        out.append((" ".join(rng.choices(some, k=rng.randrange(25))), rng.choice(["en", "en", "de", None]), source))
    out += [(None, "en", "empty"), ("1 2 3", "en", "none"), ("rare words only", "en", "rare"), ("one", "xx", "a"), ("two", "xx", "b"), (None, "yy", "alone"), ("the " * 4000, "en", "s2")]
    return out + [("same text here", "de", "s2")] * 12


def frame(spark, docs):
    return spark.createDataFrame([(None, t, lang, s, 1, "x", 2, "y") for t, lang, s in docs], KIND)


@pytest.mark.parametrize("changed", [{}, {"CHUNK": 5, "SOURCES": 2, "HELD": 30, "SLICE": 16}, {"TERMS": 20, "ENTRIES": 10, "CHUNK": 3, "SOURCES": 3}])
def test_all_groups(spark, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(audit, name, value)
    docs = corpus(len(changed))
    got = audit.divergence(frame(spark, docs).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == by_hand(docs)


def test_empty_table(spark):
    assert audit.divergence(frame(spark, corpus(0)).limit(0)).count() == 0


def test_shares_of_large_counts():
    counts = [0, 1, 7, 10**9, 10**12 + 1, 4 * 10**15, 8 * 10**15]
    whole = 8 * 10**15 + 12345
    assert audit.shares(np.array(counts), whole, 77).tolist() == [1 + 10**9 * (c + 2) // (whole + 154) for c in counts]
