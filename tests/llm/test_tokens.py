"""Token counts, packing and token shards against the libraries themselves."""

import bisect
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from claimweave.llm import packing as P
from claimweave.llm import token_count as C
from claimweave.llm import token_store as S

TEXTS = [None, "", " ", "Hello, world", "naïve café 12.5", "日本語 と 한국어", "<|endoftext|> x <|startoftext|>", "<s> </s>", "a" * 5000, "word " * 20_000, "İstanbul ΟΔΟΣ", "é", "\x1c\x85 tab\t\n"]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "Hello, world"), (None, "no id")]


@pytest.fixture(scope="module")
def model():
    return C.PieceModel(path("piece_bpe_32k.model"))


def test_counts(make, model):
    got = sorted(tuple(r) for r in C.count_tokens(make(ROWS), path("piece_bpe_32k.model")).filter("doc_id is not null").collect())
    n = {k: len(model.model.encode(t or "")) for k, t in ROWS}
    assert got == sorted((k, len((t or "").encode()), n[k], n[k] > 4096) for k, t in ROWS if k is not None)
    assert C.count_tokens(make([]), path("piece_bpe_32k.model")).collect() == []


def test_chunks_agree_with_the_whole(model):
    rng, widened = random.Random(1), 0
    for letters in ("ab", "a b", "日本語テスト", "😀é ", "<s> </s>▁ ", "aaaaab"):
        for _ in range(15):
            text = "".join(rng.choices(letters, k=rng.randint(400, 2000)))
            for chunk, overlap in ((200, 8), (300, 64)):
                n, wide = C.count_long(model, text, chunk, overlap)
                assert n == len(model.model.encode(text))
                widened += wide
    assert widened


def test_long_documents_of_the_tables(model):
    texts = [t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist() if len(t or "") > 2 * C.CHUNK][:60]
    assert len(texts) > 30 and [C.count_long(model, t)[0] for t in texts] == [len(model.model.encode(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_everything(counts):
    patterns = P.plan(counts, 64)
    used = {}
    for pattern, n in patterns:
        assert sum(pattern) <= 64 and n > 0
        for length in pattern:
            used[length] = used.get(length, 0) + n
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(n for _, n in patterns) <= 2 * -(-total // 64) + 1


def test_plan_fills_exactly():
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 1025, 100_000), return_counts=True))}
    total = sum(k * v for k, v in counts.items())
    assert sum(n for _, n in P.plan(counts, 1024)) <= 1.01 * total / 1024
    assert P.plan({600: 3, 424: 2, 200: 1, 224: 1}, 1024) == [((600, 424), 2), ((600, 224, 200), 1)]


def _best_fit_decreasing(counts, size):
    """Sequences that plain best fit takes, one piece at a time."""
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        k = bisect.bisect_left(gaps, length)
        gap = gaps.pop(k) if k < len(gaps) else size
        bisect.insort(gaps, gap - length)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_needs_no_more_than_best_fit(counts):
    assert sum(n for _, n in P.plan(counts, 64)) <= _best_fit_decreasing(counts, 64)


@pytest.mark.parametrize("sf, most", [("sf0.001", 193), ("sf0.01", 964), ("sf0.1", 9872)])
def test_plan_of_the_tables(sf, most):
    encode = P.Encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    counts = Counter(n for text in pq.read_table(f"/root/testdata/{sf}/documents.parquet")["text"].to_pylist() for _, n in P.cut(len(encode(text or "")) + 1, 1024))
    assert -(-sum(k * n for k, n in counts.items()) // 1024) <= sum(n for _, n in P.plan(counts, 1024)) <= min(most, _best_fit_decreasing(counts, 1024))


def test_cut():
    assert P.cut(1, 4) == [(0, 1)] and P.cut(4, 4) == [(0, 4)] and P.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_packing(make):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = P.pack(make(ROWS), with_ids=True).toPandas()
    whole = {k: library.encode(t or "", add_special_tokens=False).ids + [2] for k, t in ROWS}
    assert sorted(rows.doc_id.fillna(-1).unique()) == [-1, *range(len(TEXTS))]
    for r in rows[rows.doc_id.notna()].itertuples():
        ids = np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids == ids and r.ids_crc32 == crc32(ids)
    for k in range(len(TEXTS)):
        own = rows[rows.doc_id == k].drop_duplicates("piece").sort_values("piece")
        assert own.length.sum() == len(whole[k]) and (own.start == own.length.cumsum() - own.length).all()
    placed = rows.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 1024
    assert P.pack(make([])).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65_535), min_size=1, max_size=200), st.integers(1, 30))
def test_coder_round_trip(ids, block):
    assert S.decode(S.encode(np.array(ids), block)).tolist() == ids


def test_coder_compresses_and_checks():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 65_536, 5000), rng.zipf(1.4, 9000) % 65_536, np.zeros(7000, int), np.tile(rng.integers(0, 65_536, 40), 200)):
        payload = S.encode(ids)
        assert (S.decode(payload) == ids).all()
    assert len(payload) * 8 < 4 * len(ids)
    bad = bytearray(payload)
    bad[-20] ^= 255
    with pytest.raises(ValueError):
        S.decode(bytes(bad))
    wide = np.array([70_000, 5, 2**32 - 1, 70_000, 1 << 31, 5, 5, 5])
    assert (S.decode(S.encode(wide, 3)) == wide).all() and len(S.decode(S.encode(wide[:0]))) == 0
    with pytest.raises(ValueError):
        S.encode(np.array([2**32]))


def test_coder_beats_plain_frequencies(sample):
    words = S.WordEncoder(path("word_bpe_49k.json"))
    ids = np.concatenate([words(r.text or "") for r in sample.orderBy("doc_id").collect()])
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(S.encode(ids)) * 8 / len(ids) < -(share * np.log2(share)).sum() + 0.1  # without the cost of a table


def test_blocks_learn_from_each_other():
    rng = np.random.default_rng(7)
    after, ids = rng.integers(0, 65_536, (600, 2)), [0]
    number = {int(v): k for k, v in enumerate(np.unique(after))}
    for k in rng.integers(0, 2, 80_000):
        ids.append(int(after[number.get(ids[-1], 0) % 600, k]))
    payload = S.encode(np.array(ids))
    assert S.decode(payload).tolist() == ids
    assert len(payload) * 8 < 2.2 * len(ids)  # one bit of choice an id


def test_contexts_of_two_ids():
    rng = np.random.default_rng(8)
    ids = [1, 2]
    for k in rng.random(60_000):
        ids.append((ids[-1] * 7 + ids[-2] * 3 + 1) % 11 if k < 0.95 else int(k * 1e6) % 11)
    payload = S.encode(np.array(ids))
    assert S.decode(payload).tolist() == ids
    assert len(payload) * 8 < 1.2 * len(ids)


def test_many_blocks_that_begin_alike():
    rng = np.random.default_rng(9)
    for ids in (rng.integers(0, 3, (600, 40)), rng.zipf(1.5, (3000, 100)) % 3000):
        ids[:, 0] = 5
        for zero in (5, 0):
            own = np.where(ids == 5, zero, ids).reshape(-1)
            assert (S.decode(S.encode(own, ids.shape[1])) == own).all()


def test_pieces_are_encoded_once_a_batch():
    import pyarrow as pa

    words = S.WordEncoder(path("word_bpe_49k.json"), most=50)
    library, asked = words.library, []

    class Asked:
        def encode(self, text, **more):
            asked.append(text)
            return library.encode(text, **more)

    rng = random.Random(9)
    texts = ["\u201ca\u201d b, \u201ca\u201d c.", "", " "] * 40
    texts += ["".join(rng.choices(["a", "H", "\u0331", "\u0301", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\u2003", "\u1112", "\u1161", "'s", "<|endoftext|>", "<|", ".", "7", "\u0130"], k=12)) for _ in range(800)]
    words.library = Asked()
    ids, lengths = words.batch(pa.array(texts))
    assert len(asked) == len(set(asked)) and asked.count("\u201ca\u201d") == 1
    for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_words_agree_with_the_library():
    words = S.WordEncoder(path("word_bpe_49k.json"))
    more = ["É\x1c a b\x85c 's don't DON'T ½² ª", "Σας", "ŉ ß ǅ ĳ", "a´b", "x" * 3000]
    for text in [t or "" for t in TEXTS] + more:
        assert words(text).tolist() == words.library.encode(text, add_special_tokens=False).ids


def test_every_character_below_the_marks():
    words = S.WordEncoder(path("word_bpe_49k.json"))
    rng = random.Random(5)
    texts = [a + chr(k) + b for k in range(0x300) for a, b in (("a", "b"), ("a ", " b"), ("'", "s"), ("1", "2"))]
    texts += ["".join(chr(rng.randrange(0x300)) for _ in range(60)) for _ in range(300)]
    texts += ["".join(rng.choices("aȺȾİb'sS1 .,\u0301é", k=40)) for _ in range(300)]
    for text in texts:
        assert words(text).tolist() == words.library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_shards(make):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    segments = S.write_shards(make(ROWS), segment=4000)
    assert segments.count() > 2
    rows = S.read_shards(segments, with_ids=True).toPandas()
    whole = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in ROWS}
    order = rows.sort_values("start")
    assert (order.start == order.n_tokens.cumsum() - order.n_tokens).all()
    assert order.doc_id.fillna(-1).is_monotonic_increasing
    for r in order[order.doc_id.notna()].itertuples():
        ids = np.array(whole[r.doc_id], "<u4").tobytes()
        assert r.ids == ids and r.n_tokens == len(whole[r.doc_id]) and r.ids_crc32 == crc32(ids)
    assert S.read_shards(S.write_shards(make([]))).collect() == []
