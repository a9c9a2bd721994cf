"""Exact, near and passage deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import exact_dedup as E
from claimweave.llm import jaccard_join as J
from claimweave.llm import substring_dedup as S
from claimweave.llm.common import save, sifted

LONG = "word " * 30_000
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "ab c"), (6, "abc "), (6, "abc "), (7, LONG), (8, LONG + "x"), (9, LONG), (None, "abc"), (None, "solo"), (10, "x" * 64), (11, "x" * 320), (12, "x" * 64), (13, "é" * 40), (14, "é" * 40 + " ")]


def brute_exact(pairs):
    groups = defaultdict(list)
    for d, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((d, t or ""))
    out = []
    for norm, own in groups.items():
        own.sort(key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(d, own[0][0], len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, (d, _) in enumerate(own)]
    return Counter(out)


@pytest.mark.parametrize("pairs", [EDGE, []])
def test_exact(make, pairs):
    assert Counter(tuple(r) for r in E.exact_dedup(make(pairs)).collect()) == brute_exact(pairs)


def test_exact_sample_and_kept_rows(spark, make, sample):
    pairs = [(r.doc_id, r.text) for r in sample.collect()]
    assert Counter(tuple(r) for r in E.exact_dedup(sample).collect()) == brute_exact(pairs)
    kept = E.drop_exact_copies(make(EDGE))
    assert kept.columns == make(EDGE).columns
    want = Counter(d for (d, _, _, k, _), n in brute_exact(EDGE).items() if k for _ in range(n))
    assert Counter(r.doc_id for r in kept.collect()) == want


def brute_join(pairs, size=5, threshold=0.8):
    words = [(d, J.WORD.findall((t or "").lower())) for d, t in pairs]
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for _, w in words]
    up = list(range(len(pairs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links, similar = [set() for _ in pairs], [0] * len(pairs)
    for a in range(len(pairs)):
        for b in range(a):
            same = words[a][1] == words[b][1] and (words[a][1] or "".join((pairs[a][1] or "").split()) == "".join((pairs[b][1] or "").split()))
            if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold):
                similar[a] += 1
                similar[b] += 1
                if not same:
                    links[a].add(tuple(words[b][1]))
                    links[b].add(tuple(words[a][1]))
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    low = {}
    for k, (d, _) in enumerate(pairs):
        low[find(k)] = min(low.get(find(k), d), d)
    return Counter((d, low[find(k)], len(links[k]), similar[k]) for k, (d, _) in enumerate(pairs))


def near_copies():
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    out = []
    for k in range(60):
        own = list(base)
        for p in rng.integers(0, 120, k % 5):
            own[p] = f"z{rng.integers(0, 10_000)}"
        out.append((k, " ".join(own)))
    far = [(100 + k, " ".join(f"q{x}" for x in rng.integers(0, 10_000, 50))) for k in range(10)]
    return out + far + [(200, None), (201, ""), (202, "..."), (202, ".. ."), (209, "—!"), (203, "one two"), (204, "One, two!"), (205, "one two three"), (206, out[0][1]), (206, out[0][1]), (207, LONG), (208, LONG + "end")]


def test_join(make, monkeypatch):
    pairs = near_copies()
    want = brute_join(pairs)
    assert Counter(tuple(r) for r in J.jaccard_join(make(pairs)).collect()) == want
    monkeypatch.setattr(J, "BLOCK", 16)  # a bucket in several blocks gives the same
    assert Counter(tuple(r) for r in J.jaccard_join(make(pairs)).collect()) == want


def test_join_edges(make):
    assert J.jaccard_join(make([])).collect() == []
    assert sorted(tuple(r)[1:] for r in J.jaccard_join(make([(None, "a b"), (1, "a b")])).collect() if r.doc_id is None) == [(None, 0, 0)]
    kept = J.drop_near_copies(make(near_copies()))
    assert kept.columns == make([]).columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _, _ in brute_join(near_copies())}


def test_near_copies_leave_texts_in_place(spark, make, monkeypatch):
    """No work table holds texts, rows that go nowhere aren't shuffled, and nothing depends on which rows a bitmap lets through."""
    tables, sift = [], J.sifted
    monkeypatch.setattr(J, "save", lambda df, label: tables.append(df.columns) or save(df, label))
    pairs = near_copies() + [(None, t) for _, t in near_copies()[:3]] + 2 * [(None, "alone " * 9), (300, "twice " * 9)] + 2 * [(None, None)]
    docs = make(pairs).withColumn("__row", F.lit(1)).withColumn("maybe", F.lit(1))
    kept = J.drop_near_copies(docs)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert not [t for t in tables if "text" in t] and kept.columns == docs.columns
    named = {(d, t) for d, t in pairs if d is not None}
    low = {c for _, c, _, _ in brute_join([p for p in pairs if p[0] is not None])}
    assert {d for d, _ in got} == low | {None} and set(got) - {(None, "alone " * 9)} <= named
    assert got[None, "alone " * 9] == 1 and got[300, "twice " * 9] == 2 and got[206, near_copies()[0][1]] == 0
    monkeypatch.setattr(J, "sifted", lambda *x: sift(*x).withColumn("__maybe", F.lit(True)))
    assert Counter((r.doc_id, r.text) for r in J.drop_near_copies(docs).collect()) == got


def test_sifted(spark):
    rows = spark.range(20_000).select((F.col("id") - 10_000).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("b"))
    for wanted in (rows.filter("a % 10 = 0"), rows.limit(0), rows):
        got = sifted(rows, wanted, ["a", "b"])
        assert got.columns == ["a", "b", "__maybe"] and got.count() == 20_000
        n, sure = wanted.count(), got.filter("__maybe").select("a")
        assert wanted.select("a").subtract(sure).count() == 0 and n <= sure.count() <= n + (20_000 - n) // 10


def test_join_of_the_table(spark):
    """Against an exact join by way of common n-grams: no link is lost, none made up."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted((r.doc_id, tuple(re.findall(r"\w+", (r.text or "").lower()))) for r in docs.collect())
    first = {}
    for d, w in texts:
        first.setdefault(w, d)
    sets = {d: {w[k : k + 5] for k in range(max(1, len(w) - 4))} for w, d in first.items() if w}
    holders = {}
    for d, own in sets.items():
        for gram in own:
            holders.setdefault(gram, []).append(d)
    common = Counter(pair for own in holders.values() for pair in combinations(sorted(own), 2))
    linked = Counter(d for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) for d in (a, b))
    got = {r.doc_id: r.n_links for r in J.jaccard_join(docs).collect()}
    assert got == {d: linked[first[w]] for d, w in texts} and len(linked) >= 10


def test_posterior():
    least = J.least_matches(0.8)
    assert list(least) == list(range(16, 97, 16)) and all(0 < m < n for n, m in least.items())
    a = np.arange(96, dtype=np.uint32)[None]
    assert len(J.surviving(a, a, False, least)[0]) == 1 and not len(J.surviving(a, a + 1, False, least)[0])
    sets = [np.arange(k, k + 50, dtype=np.uint64) for k in range(30)]
    i, j = np.triu_indices(30, 1)
    assert (J.common_counts(sets, sets, i, j) == np.maximum(50 - (j - i), 0)).all()


def test_repeated_units(make):
    passage = "This passage has more than eight words in it, that is sure."
    pairs = [(1, "Start here. " + passage + " And an end of its own with many different words here."), (2, passage.upper()), (3, "x\n" + passage + "\ny " + passage), (4, "short one."), (4, "short one."), (5, None), (None, passage), (6, ""), (7, "a " * 50_000 + "."), (8, "A " * 50_000 + ".")]
    got = S.repeated_units(make(pairs)).collect()
    text = dict((d, t) for d, t in pairs)
    norm = lambda t: " ".join(S.WORD.findall(t.lower()))
    for r in got:
        assert norm(text[r.doc_id][r.start : r.start + r.length]) == norm(text[r.keep_doc_id][r.keep_start :])[: len(norm(text[r.doc_id][r.start : r.start + r.length]))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_doc_id, r.copies) for r in got) == [(False, 2, 1, 4), (False, 3, 1, 4), (False, 8, 7, 2), (True, 0, 1, 4)]
    cut = {r.doc_id: r.text for r in S.without_repeats(make(pairs[:3])).collect()}
    assert cut[1] == text[1] and cut[2] == "" and cut[3].startswith("x\n\ny") and passage in text[3]
    assert S.repeated_units(make([])).collect() == []


def test_repeated_units_sample(sample):
    """Every unit but the first of its words is reported, and no other."""
    seen, want = {}, set()
    rows = sorted((r.doc_id, r.text or "") for r in sample.collect())
    for d, t in rows:
        for start, _, digest in S.units(t, 8):
            if digest in seen:
                want.add((d, start, *seen[digest]))
            else:
                seen[digest] = (d, start)
    got = {(r.doc_id, r.start, r.keep_doc_id, r.keep_start) for r in S.repeated_units(sample).collect()}
    assert got == want


def test_repeated_passages_of_short_sentences(make):
    verse = " ".join(f"Line {k} goes on. Who knows?\nNot I!" for k in range(10))
    chinese = "。".join(f"第{k}句話說的是天氣很好" for k in "一二三四五六七八") + "。"
    pairs = [(1, "One. " + verse), (2, "Another start here.\n" + verse + "\nAnd so it ends."), (3, "開頭。" + chinese), (4, "別的開頭在這裡。" + chinese + "結尾。"), (5, "Yes.\nNo."), (6, "Yes.\nNo."), (7, "la.\n" * 100)]
    cut = {r.doc_id: r.text for r in S.without_repeats(make(pairs)).collect()}
    assert [cut[d] == dict(pairs)[d] for d in (1, 3, 5, 6)] == [True] * 4
    assert cut[2].split() == "Another start here. And so it ends.".split()
    assert cut[4] == "別的開頭在這裡。結尾。" and cut[7].split() == ["la."]


def test_every_sentence_if_asked_for(make):
    got = S.repeated_units(make([(5, "Yes.\nNo."), (6, "Yes.\nNo."), (7, "Perhaps. no")]), min_words=1).collect()
    assert sorted((r.doc_id, r.start, r.length, r.keep_doc_id, r.copies) for r in got) == [(6, 0, 4, 5, 2), (6, 5, 3, 5, 3), (7, 9, 2, 5, 3)]


def test_units_cover_what_repeats():
    """Whatever stands around a passage, the units in it are the same and leave no sentence out."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        own, left, right = ([" ".join(f"w{x}" for x in rng.integers(0, 99, n)) + "." for n in rng.integers(1, 11, 12)] for _ in range(3))
        passage = "\n".join(own)
        found = {d for *_, d in S.units(passage, 8)}
        text = "\n".join(left) + "\n" + passage + "\n" + "\n".join(right)
        inside = [(s, n) for s, n, d in S.units(text, 8) if d in found]
        covered = {x for s, n in inside for x in range(s, s + n)}
        at = text.index(passage)
        assert all(x in covered or text[x] == "\n" for x in range(at, at + len(passage)))
