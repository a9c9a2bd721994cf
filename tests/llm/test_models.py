"""The label model, the class-based language model and decontamination."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from claimweave.llm import brown_lm as B
from claimweave.llm import decontaminate as D
from claimweave.llm import toxicity as T


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def toxic_docs(n=400):
    rng = np.random.default_rng(2)
    out = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        if k % 5 == 0:
            for p in rng.integers(0, 60, 6):
                words[p] = rng.choice(["idiot", "vexuno", "vexdos", "vextres"])
        out.append((k, " ".join(words)))
    return out


def test_toxicity(spark, make):
    pairs = toxic_docs()
    known = labels(spark, [(k, 1, int(k % 5 == 0), "t") for k in range(400)] + [(3, 1, None, "t"), (10, 1, 1, "t")])
    rows = T.score(make(pairs + [(1000, None), (1001, ""), (1001, ""), (None, "idiot"), (1002, "word " * 50_000), (1003, "idiot vexuno vexdos vextres")]), known).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 406 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert held and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    assert got[1000].score == got[1001].score and not got[1000].predicted and got[1003].predicted


def test_toxicity_without_labels(spark, make):
    docs = make([(1, "you idiot and moron"), (2, "kind words")])
    assert {r.doc_id: r.predicted for r in T.score(docs, labels(spark, [])).collect()} == {1: 1, 2: 0}
    assert T.score(make([]), labels(spark, [])).collect() == []
    more = make([(1, "you idiot and moron"), (2, "kind words"), (2, "you idiot and moron"), (None, "you idiot and moron"), (None, None)])
    assert [(r.doc_id, r.text) for r in T.drop_toxic(more, labels(spark, [])).collect()] == [(2, "kind words"), (None, None)]


def sparse(votes):
    return T.Votes([list(np.flatnonzero(v)) for v in votes], votes.shape[1])


def test_label_model_and_classifier_against_brute_force():
    """Rounds of the model over whole matrices, residuals text by text; the classifier by its gradient, which vanishes."""
    rng = np.random.default_rng(1)
    y = rng.random(300) < 0.3
    votes = np.stack([rng.random(300) < np.where(y, 0.6, 0.05) for _ in range(5)] + [rng.random(300) < 0.3], 1).astype(float)
    votes = np.hstack([votes, votes[:, :1], np.zeros((300, 1))])
    prior, q, weights = y.mean(), y.astype(float), np.ones(8)
    for step in range(30):
        rates = [((1 - q) @ votes + 0.1) / ((1 - q).sum() + 1), (q @ votes + 0.5) / (q.sum() + 1)]
        if step:
            rest = np.array([votes[k] - q[k] * rates[1] - (1 - q[k]) * rates[0] for k in range(300)])
            scale = np.sqrt((rest**2).sum(0)) + 1e-9
            shared = [[r if i != j and (r := rest[:, i] @ rest[:, j] / (scale[i] * scale[j])) > 0.5 else 0 for j in range(8)] for i in range(8)]
            weights = 1 / (1 + np.sum(shared, 1))
        odds = [math.log(prior / (1 - prior)) + sum(weights[j] * math.log(rates[1][j] / rates[0][j] if v[j] else (1 - rates[1][j]) / (1 - rates[0][j])) for j in range(8)) for v in votes]
        before, q = q, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(q - before).max() < 1e-4:
            break
    got = T.LabelModel().fit(sparse(votes), y.astype(float))
    assert weights[0] < 0.6 and np.allclose(got, q, atol=1e-4)
    w, bias = T.linear(sparse(votes), got)
    slack = got - 1 / (1 + np.exp(-(votes @ w + bias)))
    assert np.abs(votes.T @ slack - 0.1 * w).max() < 1e-2 and abs(slack.sum()) < 1e-2


def test_label_model_shares_correlated_votes():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    good, noise = [rng.random(2000) < np.where(y, 0.7, 0.02) for _ in range(4)], rng.random(2000) < 0.2
    votes = np.stack([*good, noise, noise, noise], 1).astype(float)
    given = np.where(rng.random(2000) < 0.1, ~y, y)  # wrong labels name the class, but don't hold the posterior
    model = T.LabelModel()
    q = model.fit(sparse(votes), given.astype(float))
    assert ((q > 0.5) == y).mean() > 0.95 and (abs(model.rates[1][:4] - 0.7) < 0.05).all() and (abs(model.rates[:, 4:] - 0.2) < 0.05).all()
    assert (model.weights[4:] < 0.5).all() and (model.weights[:4] > 0.9).all()


def test_toxicity_held_out(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = T.score(docs, known).join(known.select("doc_id", "toxic").filter("toxic is not null"), "doc_id").filter("held_out")
    n = Counter((r.toxic, r.predicted) for r in held.collect())
    assert n[1, 1] >= 9 and n[0, 1] == 0 and n[0, 0] >= 80


def test_toxicity_sample(spark, sample):
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = T.score(sample, known)
    assert rows.count() == sample.count() and rows.columns == ["doc_id", "held_out", "score", "predicted"]


def brute_base(pairs):
    words = [(d, B.words_of(t or "") + [B.END]) for d, t in pairs]
    c = Counter(w for d, own in words if not B.held_out(d) for w in own)
    n, v = sum(c.values()), len(c)
    return n, [(d, len(own), sum(c[w] > 0 for w in own), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) for d, own in words]


@pytest.mark.parametrize("chunk", [B.CHUNK, 40])
def test_language_model(make, chunk):
    rng = np.random.default_rng(4)
    pairs = [(k, " ".join(f"{'ab'[k % 2]}{x}" for x in rng.zipf(1.5, 30) % 50)) for k in range(80)]
    pairs += [(200, None), (201, ""), (202, "Unseen WORDS É here\x0bnow"), (202, "Unseen WORDS É here\x0bnow"), (None, "a1 b1"), (203, "a1 " * 30_000)]
    rows = B.score(make(pairs), chunk=chunk).collect()
    n, want = brute_base(pairs)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in rows), key=key)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3])
    assert all(r.train_tokens == n and r.score < 0 and r.held_out == B.held_out(r.doc_id) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 80]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_empty(make):
    assert B.score(make([])).collect() == []


def brute_scores(pairs, clustered, classes):
    """The class model token by token: every word that isn't in the core goes where the likelihood of the class bigrams is highest."""
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    texts = [(d, B.words_of(t or "") + [B.END]) for d, t in pairs]
    learn = [own for d, own in texts if not B.held_out(d)]
    c = Counter(w for own in learn for w in own)
    core = sorted((w for w in c if w != B.END), key=lambda w: (-c[w], w))[:clustered]
    place = {w: k for k, w in enumerate(core, 1)}
    node = lambda w: 0 if w == B.END else place.get(w) or 1 + len(core) + B.ending(w)
    bigrams = np.zeros((1 + len(core) + B.ENDINGS,) * 2)
    for own in learn:
        for a, w in zip([B.END, *own], own):
            bigrams[node(a), node(w)] += 1
    of = B.exchange(bigrams, len(core), classes)
    context = lambda w: int(of[node(w)])
    g = Counter()
    for own in learn:
        for a, w in zip([B.END, *own], own):
            g[context(a), context(w)] += 1
    size = int(of.max()) + 1
    kind = {w: context(w) for w in core} | {B.END: 0}
    for word in set(c) - set(kind):
        behind, before = Counter(), Counter()
        for own in learn:
            for a, w, z in zip([B.END, *own], own, [*own[1:], None]):
                if w == word:
                    before[context(a)] += 1
                    behind[context(z)] += 1
        gains = []
        for k in range(1, 1 + classes):
            row, column = sum(g[k, x] for x in range(size)), sum(g[x, k] for x in range(size))
            own = sum(f(g[k, x] + n) - f(g[k, x]) for x, n in behind.items()) + sum(f(g[x, k] + n) - f(g[x, k]) for x, n in before.items())
            gains.append(own - f(row + c[word]) + f(row) - f(column + c[word]) + f(column))
        kind[word] = 1 + int(np.argmax(np.round(gains, 9)))
    types, sizes = Counter(kind.values()), Counter()
    for w, n in c.items():
        sizes[kind[w]] += n
    once = [w for w in c if c[w] == 1 and w != B.END]
    discount = min(0.9, max(0.1, len(once) / max(1, len(once) + 2 * sum(n == 2 for n in c.values()))))
    most = lambda rows: max(range(1, 1 + classes), key=lambda k: (rows[k], -k))
    all_once = Counter(kind[w] for w in once)

    def of_word(w):
        if w in kind:
            return kind[w]
        own = Counter(kind[x] for x in once if B.ending(x) == B.ending(w))
        return most(own if own else all_once)

    n, v = sum(c.values()), len(c)
    bi, before = Counter(), Counter()
    for own in learn:
        for a, w in zip([B.END, *own], own):
            bi[kind[a], kind[w]] += 1
            before[kind[a]] += 1

    def emission(w):
        k = of_word(w)
        if k == 0:
            return 1.0
        return (c[w] - discount) / sizes[k] if c[w] else discount * types[k] / sizes[k] if types[k] else 1 / (n + v + 1)

    def step(a, w):
        prior = (sizes[w] + 1) / (n + 1 + classes)
        return (bi[a, w] + prior) / (before[a] + 1)

    return [sum(math.log10(step(of_word(a), of_word(w)) * emission(w)) for a, w in zip([B.END, *own], own)) for _, own in texts]


@pytest.mark.parametrize("chunk", [B.CHUNK, 50])
def test_scores_against_brute_force(make, chunk):
    rng = np.random.default_rng(7)
    pairs = [(k, " ".join(f"{'abc'[(k + j) % 3]}{x}{'xyz,'[x % 4]}" for j, x in enumerate(rng.zipf(1.4, 25) % 60))) for k in range(40)]
    pairs += [(100, None), (101, "new words é 12 here"), (102, "a1y a1y a1y a1y b2z")]
    got = {r.doc_id: r.score for r in B.score(make(pairs), clustered=8, classes=4, chunk=chunk).collect()}
    for (d, _), want in zip(pairs, brute_scores(pairs, 8, 4)):
        assert got[d] == pytest.approx(want), d


def test_probabilities_sum_to_one():
    """Over the classes behind a class, and over the words and the unseen one of a class."""
    rng = np.random.default_rng(1)
    g = rng.integers(0, 9, (5, 5)).astype(float)
    assert (10 ** B.transitions(g)).sum(1) == pytest.approx(np.ones(5))
    emissions = B.Emissions(np.array([3, 40]), np.array([1, 4]), np.ones(B.ENDINGS, int), 0.5, 43, 5)
    c = np.array([37, 1, 1, 1, 0])
    assert (10 ** emissions(np.ones(5, int), c)).sum() == pytest.approx(1)


def test_a_word_with_many_neighbours_takes_several_entries():
    place, of = {b"x": 1}, np.concatenate([[0, 1], 2 + np.arange(B.ENDINGS)])
    ids = np.tile(np.array([1, 2], np.uint32), (1 << B._COUNT_BITS) + 5)
    ids = np.append(ids, 0).astype(np.uint32)
    row = B._row((0, [next(d for d in range(9) if not B.held_out(d))], [len(ids)], B._packed(ids), bytes([0, 0, 0]), [B.END, b"x", b"w"], [1, 1, 1]), B._CHUNK_SCHEMA)
    out = next(B._profiles(place, of)(iter([row.select(["doc_ids", "sizes", "ids", "endings", "words"])])))
    entries = np.frombuffer(out.column(1)[0].as_py(), "<u4").astype(np.int64)
    assert out.column(0).to_pylist() == [b"w"] and (entries & ((1 << B._COUNT_BITS) - 1)).sum() == 2 * ((1 << B._COUNT_BITS) + 5)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(3)
    lang = rng.integers(0, 2, 40)
    m = rng.poisson(np.where(lang[:, None] == lang[None], 20, 0.2)).astype(float)
    bigrams = np.zeros((41 + B.ENDINGS,) * 2)
    bigrams[1:41, 1:41] = m
    of = B.exchange(bigrams, 40, 2)[1:41]
    assert len(set(of[lang == 0])) == len(set(of[lang == 1])) == 1 and len(set(of)) == 2


QUESTION = "If Tom has 12 apples and buys 15 more apples for 3 dollars, how many apples does Tom have now?"


def test_decontamination(spark, make):
    bench = spark.createDataFrame([(1, QUESTION, 5), (2, None, 5), (3, "two words", 5), (4, "Short item of five words", 5), (4, "Short item of five words", 5)], "item_id long, text string, doc_id int")
    swapped = QUESTION.replace("Tom", "Anna").replace("12", "7").replace("15", "9").replace("3 dollars", "40 euros")
    pairs = [(1, "before " + QUESTION + " after"), (2, swapped), (3, swapped.replace("does Anna", "does Bert")), (4, "nothing of the kind"), (5, None), (6, ""), (7, "x " * 50_000 + QUESTION), (8, "see short item of five words"), (1, "before " + QUESTION + " after"), (None, QUESTION)]
    for passes in (D.MAX_WINDOWS, 20):
        rows = D.contaminated(make(pairs), bench, max_windows=passes).collect()
        got = Counter((r.doc_id, r.item_id, r.exact) for r in rows)
        assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (7, 1, True): 1, (8, 4, True): 2, (None, 1, True): 1})
        assert sorted(r.doc_id or 0 for r in D.drop_contaminated(make(pairs), bench, max_windows=passes).collect()) == [3, 4, 5, 6]
    word = spark.createDataFrame([(9, "nothing")], "item_id long, text string")
    assert D.contaminated(make(pairs), word).count() == 1 and D.drop_contaminated(make(pairs), word).count() == len(pairs)
    assert D.contaminated(make([]), bench).collect() == D.contaminated(make(pairs), bench.limit(0)).collect() == []


def test_decontamination_finds_planted_passages(spark, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in sample.collect() for i, t in items if t in (r.text or "")}
    assert want <= {(r.doc_id, r.item_id) for r in D.contaminated(sample, bench).collect()}


def naive_template(text):
    """tokens, places of the template's tokens, slots of both readings, tokens without sentence ends."""
    found = D.TOKEN.findall(text)
    low = [t.lower() for t in found]
    number = [t[0].isdigit() or w in D.NUMBER_WORDS for t, w in zip(found, low)]
    end = [t in ".!?。！？\n" for t in found]
    sign = [not (e or x or w in D.UNIT_WORDS or t[0].isalnum() or re.match(f"[{D.UNSPACED}]", t)) for t, w, e, x in zip(found, low, end, number)]
    seen = [k for k in range(len(found)) if not sign[k]]
    slots = {}
    for j, k in enumerate(seen):
        beside = [seen[x] for x in (j - 1, j + 1) if 0 <= x < len(seen)]
        capital = not (end[k] or number[k] or low[k] in D.UNIT_WORDS) and found[k][0].isupper() and found[k][1:].islower()
        own = 1 if number[k] else 2 if low[k] in D.UNIT_WORDS and any(number[x] for x in beside) else 0
        opens = j == 0 or end[seen[j - 1]]
        slots[k] = (3 if capital and not opens else own), (3 if capital else own)
    places = [k for k in seen if not end[k]]
    return low, places, [[slots[k][r] for k in places] for r in (0, 1)], [w for w, e in zip(low, end) if not e]


def naive_matches(text, item):
    """(n_windows, item_windows, n_slots, exact) if text contains item."""
    low, places, readings, plain = naive_template(text)
    ilow, iplaces, ireadings, iplain = naive_template(item)
    size, words = min(8, len(iplaces)), [ilow[p] for p in iplaces]
    key = lambda at, p, slots, w: tuple(("", slots[x]) if slots[x] else (w[at[x]],) for x in range(p, p + size))
    usable = [[sum(not s for s in slots[p : p + size]) >= 4 for p in range(len(iplaces) - size + 1)] if size >= 4 else [] for slots in ireadings]
    mine = {}
    for r in (0, 1):
        for p, ok in enumerate(usable[r]):
            if ok and (r == 0 or ireadings[0][p : p + size] != ireadings[1][p : p + size]):
                mine.setdefault(key(iplaces, p, ireadings[r], ilow), []).append((r, p))
    lines = {}
    for p in range(len(places) - size + 1) if mine else ():
        for k in {key(places, p, slots, low) for slots in readings}:
            for r, at in mine.get(k, ()):
                lines.setdefault((r, p - at), set()).add(at)
    covered, used, exact = set(), set(), True
    for (r, shift), starts in lines.items():
        place = {x for at in starts for x in range(at, at + size) if ireadings[r][x]}
        maps = {}
        for x in place:
            maps.setdefault((ireadings[r][x], words[x]), set()).add(low[places[x + shift]])
        if all(len(v) == 1 for v in maps.values()):
            covered |= starts
            used |= place
            exact &= all(v == {w} for (_, w), v in maps.items())
    dense = lambda at: any(re.match(f"[{D.UNSPACED}]", w) for w in words[at : at + size])
    if covered and (sum(not dense(at) for at in covered) >= 3 or len(covered) >= 0.5 * sum(usable[0])):
        return len(covered), sum(usable[0]), len(used), exact
    size = min(8, len(iplain))
    have = {tuple(plain[p : p + size]) for p in range(len(plain) - size + 1)}
    windows = [tuple(iplain[p : p + size]) for p in range(len(iplain) - size + 1)] if size else []
    n = sum(w in have for w in windows)
    return (n, len(windows), 0, True) if n and n >= 0.5 * len(windows) else None


def test_decontamination_against_brute_force(spark, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    texts = {r.doc_id: r.text or "" for r in sample.collect()}
    altered = {10**6 + k: "So then: " + re.sub(r"\d+", lambda m: str(int(m[0]) + 3), t).replace(" the ", " The ") for k, t in items.items() if t}
    texts |= altered | {2 * 10**6 + k: " ".join(t.split()[3:]) for k, t in items.items() if t}
    want = {(d, i, *m) for d, t in texts.items() for i, own in items.items() if (m := naive_matches(t, own or ""))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_windows, r.item_windows, r.n_slots, r.exact) for r in D.contaminated(docs, bench).collect()}
    assert got == want and {d for d, *_ in want} & set(altered)


def test_decontamination_finds_short_and_plain_items(spark, make):
    items = ["What is 17 + 25 - 8 * 3?", "What is the capital of France?", "法國的首都是哪一座城市？", "Who wrote Hamlet?", "Which river flows through the old town of Geneva in Switzerland?", "2 + 2 = 4", "..."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    pairs = [(k, f"Some words here. Question: {t} Answer below.") for k, t in enumerate(items)]
    pairs += [(10, 'He asked:"What is the capital of Spain?"'), (11, "Which river flows through the old town of\nVienna in Austria?"), (12, "我問：法國的首都是哪一座城市？你說。"), (13, "What is 17 + 25 + 8 * 3?"), (14, "法國的首都很大，哪一座城市是首都？"), (15, "2 + 2 = 5")]
    for passes in (D.MAX_WINDOWS, 20):
        got = {(r.doc_id, r.item_id, r.exact) for r in D.contaminated(make(pairs), bench, max_windows=passes).collect()}
        assert got == {(k, k, True) for k in range(6)} | {(10, 1, False), (11, 4, False), (12, 2, True)}


def test_decontamination_reads_a_run_between_blanks_once(monkeypatch):
    """Tokens are those of the pattern over the whole text, and a run that was seen before isn't split again."""
    vocabulary, rng = D._Vocabulary(), np.random.default_rng(9)
    pieces = [" ", ", ", ". ", "\n", "\t", "\x1c", "\u3000", ".", ",", "3.5", "1,000", "7.", "Tom's", "don't", "%", "$", "…", "ß", "École", "法國的", "ไทย", "_x1", "a2b", "İ", "x" * 40]
    for _ in range(500):
        text = "".join(rng.choice(pieces, 20))
        want = D.TOKEN.findall(text)
        index = vocabulary.read(text)
        assert [vocabulary.words[k] for k in index] == [w.lower() for w in want]
        assert (vocabulary.hashes[index] == [D.xxhash.xxh3_64_intdigest(w.lower()) for w in want]).all()
    template = D._Template("He said 3 words, (quite) often.", vocabulary)
    monkeypatch.setattr(D, "_SPACED", None)
    again = D._Template("He said 3 words, (quite) often.", vocabulary)
    assert (again.plain == template.plain).all() and list(again.places) == list(template.places)


def test_window_hashes():
    """A window's hash depends on its own values alone, in their order, and on its size."""
    hashes = np.random.default_rng(4).integers(0, 2**64, 3000, dtype=np.uint64)
    for size in (1, 3, 8):
        whole = D.windows(hashes, size)
        assert len(set(whole.tolist())) == len(whole) == 3000 - size + 1
        assert all(D.windows(hashes[k : k + size], size)[0] == whole[k] for k in (0, 1, 17, 2000, 3000 - size))
    assert D.windows(hashes[:8], 8) != D.windows(hashes[:8][::-1], 8) and len(D.windows(hashes[:2], 3)) == 0
