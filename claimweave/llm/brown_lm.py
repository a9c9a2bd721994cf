"""Class-based n-gram language model with Brown's classes.

Exchange clustering assigns every training word to a class. The most frequent words, the core, move between classes in
turn until none does; all others are then inserted: each goes to the class that raises the likelihood of the class
bigrams most, judged by the classes before and behind it in the whole training text. Words never seen take the class
that most words of their ending that occurred once are in. A text is scored with class transitions and word emissions,
P(class | class before) P(word | class), both smoothed.

Counts cover every training token. The driver sees the core's bigram matrix and class totals, both of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, text_of

#: Words of the core, classes (fewer than 256), and most rounds of the core's exchange.
CLUSTERED, CLASSES, SWEEPS = 600, 64, 8
#: Tokens of a chunk of documents that share a local vocabulary.
CHUNK = 1_500_000
#: The end of a text, as a token: no word holds a line break.
END = b"\n"
_PUNCTUATION = b".,;:!?"
#: Endings of words: by last byte (letters, digit, kinds of punctuation, other) and by whether all bytes are ASCII.
ENDINGS = 2 * (26 + 1 + len(_PUNCTUATION) + 1)


def words_of(text: str) -> list[bytes]:
    """Lower-cases A-Z and splits at [\\x20\\x09-\\x0D]."""
    return text.encode().lower().split()


def ending(word: bytes) -> int:
    last = word[-1]
    if 97 <= last <= 122:
        k = last - 97
    elif 48 <= last <= 57:
        k = 26
    elif last in _PUNCTUATION:
        k = 27 + _PUNCTUATION.index(last)
    else:
        k = 27 + len(_PUNCTUATION)
    return 2 * k + (not word.isascii())


def held_out(doc_id: int | None) -> bool:
    """A null doc_id is held out: nothing is learned from it."""
    return doc_id is None or crc32(str(doc_id).encode()) % 7 == 2


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


_CHUNKS = "chunk long, doc_ids array<long>, sizes array<long>, ids binary, endings binary, words array<binary>, counts array<long>"
_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("endings", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])


def _row(values: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _packed(ids: np.ndarray) -> bytes:
    """The bytes of all ids, lowest ones first, compressed."""
    return zstandard.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        local, doc_ids, parts, tokens = _Local(), [], [], 0
        local[END]

        def row() -> pa.RecordBatch:
            counts = np.zeros(len(local), np.int64)
            learn = [p for d, p in zip(doc_ids, parts) if not held_out(d)]
            if learn:
                counts += np.bincount(np.concatenate(learn), minlength=len(local))
            ids, names = np.concatenate(parts), list(local)
            # The end first, then by falling frequency, so that ids are small.
            order = np.concatenate([[0], 1 + np.argsort(-np.bincount(ids, minlength=len(local))[1:], kind="stable")])
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            names = [names[k] for k in order]
            endings = bytes([0, *map(ending, names[1:])])
            return _row((chunk, doc_ids, [len(p) for p in parts], _packed(place[ids]), endings, names, counts[order]), _CHUNK_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                words.append(END)
                doc_ids.append(doc_id.as_py())
                parts.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
                tokens += len(words)
                if tokens > size:
                    yield row()
                    chunk += 1
                    local, doc_ids, parts, tokens = _Local(), [], [], 0
                    local[END]
        if parts:
            yield row()

    return run


def _read(batch: pa.RecordBatch, k: int) -> tuple:
    """doc_ids, sizes, ids and endings of a chunk row."""
    doc_ids, sizes, ids, endings = (batch.column(c)[k] for c in range(4))
    return doc_ids.as_py(), sizes.values.to_numpy(), _unpacked(ids.as_buffer()), np.frombuffer(endings.as_buffer(), np.uint8)


def _before(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The class before each token; a text begins behind the class of the end."""
    out = np.zeros_like(ids)
    out[1:] = ids[:-1]
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = 0
    return out


def _bigrams(place: dict[bytes, int]):
    """Counts of neighbouring nodes: 0 the end, then the clustered words, then the endings."""
    nodes = 1 + len(place) + ENDINGS
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(nodes * nodes, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, sizes, ids, endings = _read(batch, k)
                node = 1 + len(place) + endings.astype(np.int64)
                for x, w in enumerate(batch.column(4)[k].values.to_pylist()):
                    if w in place:
                        node[x] = place[w]
                node[0] = 0
                node = node[ids]
                learn = np.repeat([not held_out(d) for d in doc_ids], sizes)
                total += np.bincount((_before(node, sizes) * nodes + node)[learn], minlength=nodes * nodes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // nodes, pa.int32()), pa.array(at % nodes, pa.int32()), pa.array(total[at])], schema=schema)

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each node: 0 the end, 1..classes the clustered words, then one class per ending.

    Each word in turn moves to the class that raises the likelihood of the class bigrams most, until a sweep moves none.
    """
    nodes = len(bigrams)
    of = np.concatenate([[0], 1 + np.arange(words) % classes, 1 + classes + np.arange(nodes - 1 - words)])
    total = 1 + classes + nodes - 1 - words
    hot = np.zeros((nodes, total))
    hot[np.arange(nodes), of] = 1
    right, left = bigrams @ hot, bigrams.T @ hot  # of each node: counts of the classes behind and before it
    g = hot.T @ right
    own = slice(1, 1 + classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(1, 1 + words):
            a, s = of[w], bigrams[w, w]
            r, q = right[w].copy(), left[w].copy()  # neighbours other than w itself
            r[a] -= s
            q[a] -= s
            g[a] -= r
            g[:, a] -= q
            g[a, a] -= s
            behind, before = g[own], g[:, own].T
            gain = (_f(behind + r) - _f(behind)).sum(1) + (_f(before + q) - _f(before)).sum(1)
            k = np.arange(1, 1 + classes)
            d = g[k, k]
            gain += _f(d + r[k] + q[k] + s) - _f(d) - (_f(d + r[k]) - _f(d)) - (_f(d + q[k]) - _f(d))
            rows, columns = behind.sum(1), before.sum(1)
            gain -= _f(rows + r.sum() + s) - _f(rows) + _f(columns + q.sum() + s) - _f(columns)
            b = 1 + int(gain.argmax())
            g[b] += r
            g[:, b] += q
            g[b, b] += s
            if b != a:
                moved += 1
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
                of[w] = b
        if not moved:
            break
    return of


#: Bits of a count in a packed profile entry; the context is above them.
_COUNT_BITS = 22


def _profiles(place: dict[bytes, int], of: np.ndarray, size: int = 3_000_000):
    """word, payload: how often each context class stands before and behind each training word that isn't in place.

    A task adds up its chunks until it holds size counts.
    """
    contexts = int(of.max()) + 1
    schema = pa.schema([("word", pa.binary()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)
            most = (1 << _COUNT_BITS) - 1
            times = -(-n // most)  # a larger count takes several entries
            key, n = np.repeat(key, times), np.repeat(n, times)
            last = np.cumsum(times) - 1
            n[:] = np.where(np.isin(np.arange(len(n)), last), (n - 1) % most + 1, most)
            word, context = key // (2 * contexts), key % (2 * contexts)
            entries = ((context << _COUNT_BITS) | n).astype("<u4")
            words, first = np.unique(word, return_index=True)
            ends, every = np.append(first[1:], len(entries)), list(names)
            for low in range(0, len(words), 20_000):
                high = min(low + 20_000, len(words))
                offsets = np.append(first[low:high], ends[high - 1]) - first[low]
                data = pa.py_buffer(entries[first[low] : ends[high - 1]].tobytes())
                payload = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((4 * offsets).astype(np.int32).tobytes()), data])
                yield pa.RecordBatch.from_arrays([pa.array([every[w] for w in words[low:high].tolist()], pa.binary()), payload], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, sizes, ids, endings = _read(batch, k)
                local = batch.column(4)[k].values.to_pylist()
                own = np.fromiter((-1 if w in place or w == END else names.setdefault(w, len(names)) for w in local), np.int64, len(local))
                classes = of[[0 if w == END else place.get(w) or 1 + len(place) + e for w, e in zip(local, endings.tolist())]][ids]
                behind = np.append(classes[1:], 0)
                learn = np.repeat([not held_out(d) for d in doc_ids], sizes)
                at = np.flatnonzero(learn & (own >= 0)[ids])
                base = own[ids[at]] * (2 * contexts)
                key = np.concatenate([base + _before(classes, sizes)[at], base + contexts + behind[at]])
                parts.append(np.unique(key, return_counts=True))
                if sum(len(key) for key, _ in parts) > size:
                    yield from rows()
                    names, parts = {}, []
        if sum(len(key) for key, _ in parts):
            yield from rows()

    return run


def _inserted(g: np.ndarray, classes: int):
    """word, c, kind from profiles sorted by word: the class that gains most by the word, given class bigrams g."""
    contexts, own = len(g), slice(1, 1 + classes)
    table = np.concatenate([g[:, own], g[own].T])  # what each class has of each context before and behind it
    base = _f(table)
    single = _f(table + 1) - base
    behind, before = g[own].sum(1), g[:, own].sum(0)
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("kind", pa.int32())])

    def judge(words: list[bytes], word: np.ndarray, context: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        key, back = np.unique(word * (2 * contexts) + context, return_inverse=True)
        n = np.bincount(back, n)
        word, context = key // (2 * contexts), key % (2 * contexts)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        gain = single[context]
        many = np.flatnonzero(n > 1)
        gain[many] = _f(table[context[many]] + n[many, None]) - base[context[many]]
        c = np.add.reduceat(np.where(context < contexts, n, 0), first)
        gain = np.add.reduceat(gain, first)
        for total in (behind, before):
            gain -= _f(total + c[:, None]) - _f(total)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c.astype(np.int64)), pa.array(1 + gain.argmax(1), pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, context, n = None, np.empty(0, np.int64), np.empty(0)  # the last word so far, which may go on
        for batch in batches:
            for low in range(0, batch.num_rows, 5_000):
                part = batch.slice(low, 5_000)
                words, sizes, data = part.column(0).to_pylist(), [], []
                for x in part.column(1):
                    data.append(x.as_buffer())
                    sizes.append(len(data[-1]) // 4)
                names = [w for k, w in enumerate(words) if w != (words[k - 1] if k else word)]
                names = names if word is None else [word, *names]
                number = np.cumsum([0 if word is None and not k else int(w != (words[k - 1] if k else word)) for k, w in enumerate(words)])
                entries = np.frombuffer(b"".join(data), "<u4").astype(np.int64)
                owner = np.concatenate([np.zeros(len(context), np.int64), np.repeat(number, sizes)])
                context, n = np.append(context, entries >> _COUNT_BITS), np.append(n, entries & ((1 << _COUNT_BITS) - 1))
                done = owner < len(names) - 1
                if done.any():
                    yield judge(names[:-1], owner[done], context[done], n[done])
                word, context, n = names[-1], context[~done], n[~done]
                context, back = np.unique(context, return_inverse=True)
                n = np.bincount(back, n)
        if word is not None:
            yield judge([word], np.zeros(len(context), np.int64), context, n)

    return run


class Emissions:
    """log10 P(word | class), for classes whose words each give up a discount to the unseen ones; the end is alone in its class."""

    def __init__(self, sizes: np.ndarray, types: np.ndarray, unseen: np.ndarray, discount: float, n: int, v: int) -> None:
        self.sizes, self.types, self.unseen, self.discount, self.n, self.v = sizes, types, unseen, discount, n, v

    def kinds(self, endings: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Classes of local words: as given, by ending where none is; the first one is the end."""
        out = np.where(kinds > 0, kinds, self.unseen[endings])
        out[0] = 0
        return out

    def __call__(self, kinds: np.ndarray, c: np.ndarray) -> np.ndarray:
        size = np.maximum(self.sizes[kinds], 1)
        rest = np.where(self.types[kinds] > 0, self.discount * self.types[kinds] / size, 1 / (self.n + self.v + 1))
        return np.where(kinds == 0, 0.0, np.log10(np.where(c > 0, (c - self.discount) / size, rest)))


def transitions(g: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """log10 P(class | class before), drawn to the shares of the classes."""
    prior = (g.sum(0) + 1) / (g.sum() + len(g))
    return np.log10((g + pull * prior) / (g.sum(1, keepdims=True) + pull))


_CLASSED = "doc_ids array<long>, sizes array<long>, kinds binary, n_known array<long>, base_score array<double>, emission array<double>"


def _classed(emissions):
    """The classes of a chunk's tokens, and what its documents' scores take from words, from the chunk and the counts of its words."""

    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        m = emissions.value
        doc_ids, sizes, ids, endings = _read(chunk.select(["doc_ids", "sizes", "ids", "endings"]).combine_chunks().to_batches()[0], 0)
        c, kinds = np.zeros(len(endings), np.int64), np.zeros(len(endings), np.int64)
        local = known.column("id").to_numpy()
        c[local], kinds[local] = known.column("c").to_numpy(), known.column("kind").to_numpy()
        kinds = m.kinds(endings, kinds)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        totals = [np.add.reduceat(x[ids], at) for x in ((c > 0).astype(np.int64), np.log10((c + 1) / (m.n + m.v + 1)), m(kinds, c))]
        return pa.table([pa.array([x]) for x in (doc_ids, sizes, kinds.astype(np.uint8)[ids].tobytes(), *totals)], names=["doc_ids", "sizes", "kinds", "n_known", "base_score", "emission"])

    return run


def _steps(batch: pa.RecordBatch, k: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, sizes, and the class before each token with its own."""
    doc_ids, sizes, kinds = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy(), np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8)
    return doc_ids, sizes, _before(kinds, sizes), kinds


def _class_bigrams(total: int):
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(total * total, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, sizes, before, kinds = _steps(batch, k)
                learn = np.repeat([not held_out(d) for d in doc_ids], sizes)
                g += np.bincount((before.astype(np.int64) * total + kinds)[learn], minlength=total * total)
        at = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(at // total, pa.int32()), pa.array(at % total, pa.int32()), pa.array(g[at])], schema=schema)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(step: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, sizes, before, kinds = _steps(batch, k)
                known, base, own = (batch.column(c)[k].values.to_numpy() for c in (3, 4, 5))
                score = own + np.add.reduceat(step[before, kinds], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                columns = [pa.array(doc_ids, pa.int64()), pa.array([held_out(d) for d in doc_ids]), *map(pa.array, (sizes, known, base, score))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _tally(classes: int):
    """Per class: words, their tokens (kinds as they are), and words seen once by ending; words seen once and twice under ending -1 and -2."""
    schema = pa.schema([("ending", pa.int32()), ("kind", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ENDINGS + 1, 1 + classes, 2), np.int64)
        twice = 0
        for batch in batches:
            c, kinds = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            endings = np.fromiter(map(ending, batch.column(0).to_pylist()), np.int64, len(c))
            np.add.at(total[ENDINGS], kinds, np.stack([np.ones_like(c), c], 1))
            once = c == 1
            np.add.at(total[..., 0], (endings[once], kinds[once]), 1)
            twice += int((c == 2).sum())
        e, k = np.nonzero(total[..., 0])
        own = [np.append(e, -2), np.append(k, 0), np.append(total[e, k, 0], twice), np.append(total[e, k, 1], 0)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, schema)], schema=schema)

    return run


def _matrix(rows: DataFrame, size: int) -> np.ndarray:
    """Counts (i, j, n), added up, as a square matrix."""
    t = rows.groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, size))
    out[t.column("i").to_numpy(), t.column("j").to_numpy()] = t.column("n").to_numpy()
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2; a null doc_id is held out. A text's tokens are its
    words and one end; null and empty texts are the end alone. base_score is the add-one unigram log10 probability,
    score the class model's. The unseen words of a class count as one more word of it. Repeated rows are learned from
    and scored each. Other columns are ignored; an empty table gives an empty result.

    Documents are tokenised once, in chunks with vocabularies of their own. Contexts of words are added up per task, then
    per word, which gives each word its count and class; each chunk gets back those of its own words alone, so no task
    holds the corpus vocabulary. While words are inserted, neighbours outside the core count by their endings.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    chunks = save(base.mapInArrow(_chunks(chunk), _CHUNKS), "chunks")
    counted = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts").filter("counts > 0")
    vocabulary = counted.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c"))
    core = [(bytes(r["word"]), r["c"]) for r in vocabulary.orderBy((F.col("word") == F.lit(END)).desc(), F.desc("c"), "word").limit(clustered + 1).collect()]
    place = {w: k for k, (w, _) in enumerate((x for x in core if x[0] != END), 1)}
    read = chunks.select("doc_ids", "sizes", "ids", "endings", "words")
    bigrams = _matrix(read.mapInArrow(_bigrams(place), "i int, j int, n long"), 1 + len(place) + ENDINGS)
    of = exchange(bigrams, len(place), classes)
    hot = np.zeros((len(of), int(of.max()) + 1))
    hot[np.arange(len(of)), of] = 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profiles = read.mapInArrow(_profiles(place, of), "word binary, payload binary").repartition(parts, "word").sortWithinPartitions("word")
    inserted = profiles.mapInArrow(_inserted(hot.T @ bigrams @ hot, classes), "word binary, c long, kind int")
    first = spark.createDataFrame([(w, c, int(of[place[w]]) if w != END else 0) for w, c in core], "word binary, c long, kind int")  # at most clustered + 1 rows
    words = save(inserted.union(first), "words")

    types, sizes, once = np.zeros(1 + classes), np.zeros(1 + classes), np.zeros((ENDINGS, 1 + classes))
    n2 = 0
    for r in words.mapInArrow(_tally(classes), "ending int, kind int, words long, tokens long").groupBy("ending", "kind").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect():
        if r["ending"] == ENDINGS:
            types[r["kind"]], sizes[r["kind"]] = r["words"], r["tokens"]
        elif r["ending"] < 0:
            n2 = r["words"]
        else:
            once[r["ending"], r["kind"]] = r["words"]
    once[:, 0] = 0
    n, v, n1 = int(sizes.sum()), int(types.sum()), once.sum()
    discount = min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))
    # An ending without such words falls back to the class with most of them.
    unseen = np.where(once.sum(1) > 0, once.argmax(1), max(1, int(once.sum(0).argmax())))
    emissions = spark.sparkContext.broadcast(Emissions(sizes, types, unseen, discount, n, v))
    own = chunks.select("chunk", F.posexplode("words").alias("id", "word")).join(words, "word").select(F.col("chunk").alias("of_chunk"), "id", "c", "kind")
    whole = chunks.select("chunk", "doc_ids", "sizes", "ids", "endings")
    classed = save(whole.groupBy("chunk").cogroup(own.groupBy("of_chunk")).applyInArrow(_classed(emissions), _CLASSED), "classed")
    step = transitions(_matrix(classed.mapInArrow(_class_bigrams(1 + classes), "i int, j int, n long"), 1 + classes))
    scored = classed.mapInArrow(_scores(step), _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
