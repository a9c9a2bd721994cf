"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders. Windows of the resulting templates are hash-joined between
documents and benchmark items; a match counts if the slots that it covers map consistently, so that a question with
other numbers or names is found and a chance alignment is not. Beside the templates, windows of the plain tokens find
verbatim copies of every item, also of those that are too short or have too few literals for a template.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, save, text_of

_REST = r"\d+(?:[.,]\d+)*|[^\w\s,;:'\"()\[\]{}`…“”„‘’«»–—·•、，；：（）「」『』【】《》]|\n"
#: Words, numbers, and signs but punctuation within sentences; in scripts without spaces each character is a word.
TOKEN = re.compile(rf"[{UNSPACED}]|[^\W\d_{UNSPACED}]+|{_REST}")
_JAVA_UNSPACED = re.sub(r"\\U000(\w{5})", r"\\x{\1}", UNSPACED)
_SPACED, _UNSPACED = re.compile(rf"[^\W\d_]+|{_REST}"), re.compile(f"[{UNSPACED}]")
# Words that count as numbers, and words and signs that count as units beside a number.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNIT_WORDS = frozenset(
    "% $ € £ percent dollar dollars euro euros pound pounds cent cents mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes"
    " ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees".split()
)
LITERAL, END, NUMBER, UNIT, CAPITAL, SIGN = range(6)
NUM, UNI, NAME = 1, 2, 3
_SLOT_HASH = np.array([0, 0x9E6C63D0676A9A99, 0xB5297A4D3F84D5B5, 0xE7037ED1A0B428DB], np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_INT = struct.Struct("=i").pack
#: Windows of benchmark templates that one pass holds in a task's memory; a larger benchmark takes several passes.
MAX_WINDOWS = 2_000_000


class _Vocabulary(dict):
    """Token -> index into hashes, kinds and words, remembered up to a bound."""

    MOST = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.kinds, self.words = np.empty(1024, np.uint64), np.empty(1024, np.int8), []
        self.runs = _Runs(self)

    def read(self, text: str) -> np.ndarray:
        """The index of each token of text.

        No token goes over a blank, so what stands between blanks is split once. A comma before a blank is in no token,
        a full stop before a blank and a line break are tokens of their own.
        """
        if len(self) > self.MOST:
            self.clear()
            self.words.clear()
            self.runs.clear()
        apart = text.replace("\n", " \n ").replace(". ", " . ").replace(", ", " ")
        return np.frombuffer(b"".join(map(self.runs.__getitem__, apart.split(" "))), np.int32)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token in ".!?。！？\n":
            kind = END
        elif token[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNIT_WORDS:
            kind = UNIT
        elif not token[0].isalnum() and not _UNSPACED.match(token):
            kind = SIGN
        else:
            kind = CAPITAL if token[0].isupper() and token[1:].islower() else LITERAL
        k = len(self)
        if k == len(self.hashes):
            self.hashes, self.kinds = np.resize(self.hashes, 2 * k), np.resize(self.kinds, 2 * k)
        self.hashes[k], self.kinds[k] = xxhash.xxh3_64_intdigest(low), kind
        self.words.append(token if low == token else low)
        self[token] = k
        return k


class _Runs(dict):
    """What stands between two blanks -> bytes of its tokens' indexes; only short ones are remembered, up to a bound."""

    MOST, LONGEST = 400_000, 32

    def __init__(self, vocabulary: _Vocabulary) -> None:
        super().__init__()
        self.index = vocabulary.__getitem__

    def __missing__(self, run: str) -> bytes:
        if run.isascii() and run.isalpha():
            found = _INT(self.index(run))
        else:
            tokens = TOKEN if not run.isascii() and _UNSPACED.search(run) else _SPACED
            found = b"".join([_INT(self.index(token)) for token in tokens.findall(run)])
        if len(run) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[run] = found
        return found


class _Template:
    """The tokens of a text, the places of those that make its template, and two readings of it.

    A capital makes a name but at the beginning of a sentence in the first reading, and everywhere in the second; so a
    question behind a colon, and a name behind a hard line break, are found by one of them. Each reading has the hashes
    with placeholders and the slots (0: none). plain are the hashes of all tokens but the ends of sentences.
    """

    def __init__(self, text: str, vocabulary: _Vocabulary) -> None:
        self.index, self.words = vocabulary.read(text), vocabulary.words
        hashes, kinds = vocabulary.hashes.take(self.index), vocabulary.kinds.take(self.index)
        self.plain = hashes[kinds != END]
        seen = np.flatnonzero(kinds != SIGN)
        hashes, kinds = hashes[seen], kinds[seen]
        opens = np.ones(len(kinds), bool)
        opens[1:] = kinds[:-1] == END
        slots = np.zeros(len(kinds), np.int8)
        slots[kinds == NUMBER] = NUM
        beside = np.zeros(len(kinds), bool)
        beside[1:] = kinds[:-1] == NUMBER
        beside[:-1] |= kinds[1:] == NUMBER
        slots[(kinds == UNIT) & beside] = UNI
        own = np.flatnonzero(kinds != END)
        self.places, capital, opens = seen[own], kinds[own] == CAPITAL, opens[own]
        self.readings = [(np.where(s > 0, _SLOT_HASH[s], hashes[own]), s) for s in (np.where(capital & ~opens, NAME, slots[own]), np.where(capital, NAME, slots[own]))]

    def word(self, place: int) -> str:
        """The lower-cased token at a place; only until the vocabulary reads another text."""
        return self.words[self.index[place]]


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (_ODD, np.uint64(pow(int(_ODD), -1, 1 << 64))))
        return self.up, self.down


_powers = _Powers()


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size hashes: their sum with the powers of an odd number, by differences of running sums."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(hashes))
    sums = np.cumsum(hashes * up[: len(hashes)])
    out = sums[size - 1 :].copy()
    out[1:] -= sums[: n - 1]
    out *= down[:n]
    out += np.uint64(size)
    return out


class _Postings(dict):
    """Window hash -> (owner, place) of the windows of items; sealed, a table of bits tells most others apart."""

    def __init__(self) -> None:
        super().__init__()
        self.sizes, self.bits = set(), np.zeros(1 << 20, bool)

    def put(self, owner: int, hashes: np.ndarray, size: int, places) -> None:
        if len(places):
            self.sizes.add(size)
        keys = windows(hashes, size)
        self.bits[keys[places] >> np.uint64(44)] = True
        for p in places:
            self.setdefault(int(keys[p]), []).append((owner, int(p)))

    def find(self, keys: np.ndarray, but: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """(owner, place in the item, place in keys) of all keys, but those that stand at the same place in but."""
        maybe = self.bits[keys >> np.uint64(44)]
        if but is not None:
            maybe &= keys != but
        for p in np.flatnonzero(maybe).tolist():
            for owner, at in self.get(int(keys[p]), ()):
                yield owner, at, p


class _Index:
    """The windows of some benchmark items: of both readings of their templates, and of their plain tokens."""

    def __init__(self, items: list[tuple[int, str]], size: int, literals: int) -> None:
        self.templates, self.verbatim = _Postings(), _Postings()
        self.ids, self.tokens, self.slots, self.size, self.totals, self.dense = [], [], [], [], [], []
        self.plain_size, self.plain_totals = [], []
        vocabulary = _Vocabulary()
        for k, (item_id, text) in enumerate(items):
            t = _Template(text or "", vocabulary)
            n = len(t.places)
            width = min(size, n)
            within = np.ones(width, int)
            self.ids.append(item_id)
            self.tokens.append([t.word(p) for p in t.places])
            self.slots.append([slots for _, slots in t.readings])
            self.size.append(width)
            self.totals.append(0)
            self.dense.append(np.zeros(0, bool))
            if width >= max(literals, 1):
                usable = [np.convolve(slots == 0, within, "valid") >= literals for _, slots in t.readings]
                usable[1] &= np.convolve(t.readings[0][1] != t.readings[1][1], within, "valid") > 0
                for r, (hashes, _) in enumerate(t.readings):
                    self.templates.put(2 * k + r, hashes, width, np.flatnonzero(usable[r]))
                self.totals[k] = int(usable[0].sum())
                # Eight characters say less than eight words, so windows with such are held to the share alone.
                self.dense[k] = np.convolve([_UNSPACED.match(w) is not None for w in self.tokens[k]], within, "valid") > 0
            width = min(size, len(t.plain))
            self.plain_size.append(width)
            self.plain_totals.append(len(t.plain) - width + 1 if width else 0)
            if width:
                self.verbatim.put(k, t.plain, width, np.arange(len(t.plain) - width + 1))

    def matches(self, text: str, vocabulary: _Vocabulary, least: int, coverage: float) -> Iterator[tuple]:
        """(item_id, n_windows, item_windows, n_slots, exact) of every item that the text contains."""
        t = _Template(text, vocabulary)
        places = t.places
        hits: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for size in self.templates.sizes:
            first, second = (windows(hashes, size) for hashes, _ in t.readings)
            for keys, but in ((first, None), (second, first)):
                for owner, at, p in self.templates.find(keys, but):
                    if self.size[owner // 2] == size:
                        hits[owner // 2][owner % 2, p - at].append(at)
        told = set()
        for k, lines in hits.items():
            covered, used, exact = set(), set(), True
            for (r, shift), starts in lines.items():
                place = {s + x for s in starts for x in range(self.size[k]) if self.slots[k][r][s + x]}
                maps: dict[tuple, set] = defaultdict(set)
                for s in place:
                    maps[int(self.slots[k][r][s]), self.tokens[k][s]].add(t.word(places[s + shift]))
                if all(len(v) == 1 for v in maps.values()):
                    covered.update(starts)
                    used |= place
                    exact &= all({word} == v for (_, word), v in maps.items())
            if covered and (sum(not self.dense[k][s] for s in covered) >= least or len(covered) >= coverage * self.totals[k]):
                told.add(k)
                yield self.ids[k], len(covered), self.totals[k], len(used), exact
        copies: dict[int, set[int]] = defaultdict(set)
        for size in self.verbatim.sizes:
            for k, at, _ in self.verbatim.find(windows(t.plain, size)):
                if self.plain_size[k] == size and k not in told:
                    copies[k].add(at)
        for k, covered in copies.items():
            if len(covered) >= coverage * self.plain_totals[k]:
                yield self.ids[k], len(covered), self.plain_totals[k], 0, True


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8, literals: int = 4, least: int = 3, coverage: float = 0.5, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, item_id, n_windows, item_windows, coverage, n_slots, exact.

    A window is size template tokens, literals of them no placeholders; an item of fewer tokens is one window. On each
    alignment of item and document every slot value of the item must stand for a single value in the document, else its
    windows don't count. The document contains the item if least windows or the share coverage of the item's windows
    match; exact: all slot values are the item's own. Windows with characters of a script without spaces count for the
    share alone.

    The document also contains the item if the share coverage of the windows of its plain tokens match, signs and numbers
    included; an item of fewer than size tokens is one window, however short, so an item of one word is in every document
    with that word. Such rows count plain windows, have no slots and are exact. An item without any token (punctuation
    alone) matches nothing.

    Null and empty texts match nothing; a null doc_id or item_id is returned as null; repeated rows give repeated rows
    of documents, and repeated items give a row each. Other columns are ignored; empty tables give an empty result.

    Items of equal text are looked for once. Their windows are the hashed side of a join whose other side is never moved:
    the benchmark is split into blocks of at most max_windows windows, as counted beforehand, and one block at a time is
    broadcast, looked up by all documents, and let go; a benchmark of one block takes one pass over the documents. Only
    an item that has more windows than that on its own makes a larger block.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_of(item_text_col).alias("text"))
    texts, passes = _blocks(items, max_windows)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    result = None
    for k in range(passes):
        block = texts.filter(F.col("block") == k).select("number", "text").collect()  # at most max_windows windows
        index = spark.sparkContext.broadcast(_Index([tuple(r) for r in block], size, literals))
        found = base.mapInArrow(_matcher(index, least, coverage), "doc_id long, number long, n_windows long, item_windows long, n_slots long, exact boolean")
        if passes > 1:
            found = save(found, "leaks")
            index.unpersist()
        result = found if result is None else result.union(found)
    named = items.join(texts.select("text", "number"), "text").select("number", "item_id")
    return result.join(named, "number").select("doc_id", "item_id", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "n_slots", "exact")


def _blocks(items: DataFrame, max_windows: int) -> tuple[DataFrame, int]:
    """(text, number, block) of the distinct texts of items, and the number of blocks: each has max_windows windows at most."""
    # Each run of letters or digits counts as one token, and so does every other character; characters of scripts without
    # spaces stay apart. A token begins three windows at most.
    shortened = F.regexp_replace("text", rf"[\p{{L}}&&[^{_JAVA_UNSPACED}]]+|[0-9]+", "x")
    texts = items.groupBy("text").agg((3 * F.length(F.regexp_replace(shortened, r"[ \t\r]+", ""))).cast("long").alias("windows"))
    texts = save(texts.withColumn("number", F.monotonically_increasing_id()), "items")
    passes = 1 + int(texts.agg(F.sum("windows")).first()[0] or 0) // max_windows
    while True:
        dealt = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(passes)))
        sizes = dealt.groupBy("block").agg(F.sum("windows").alias("windows"), F.count("*").alias("n"))
        if passes == 1 or not sizes.filter((F.col("windows") > max_windows) & (F.col("n") > 1)).limit(1).collect():
            return dealt, passes
        passes *= 2


def _matcher(index, least: int, coverage: float):
    schema = pa.schema([("doc_id", pa.int64()), ("number", pa.int64()), ("n_windows", pa.int64()), ("item_windows", pa.int64()), ("n_slots", pa.int64()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, own = _Vocabulary(), index.value
        for batch in batches:
            out = [(doc_id.as_py(), *m) for doc_id, text in zip(batch.column(0), batch.column(1)) for m in own.matches(text.as_py(), vocabulary, least, coverage)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", size: int = 8, literals: int = 4, least: int = 3, coverage: float = 0.5, max_windows: int = MAX_WINDOWS, shortest: int = 2) -> DataFrame:
    """The rows of docs that contain no benchmark item, with all their columns; see contaminated for what that means.

    Items of fewer than shortest tokens are in too many documents to say anything of them, so no row goes by them. Each row
    is judged by its own text, so a null or repeated doc_id makes no difference. With a benchmark of one block, one pass
    over docs moves nothing; with several, docs is written once with its rows numbered.
    """
    texts, passes = _blocks(benchmark.select(text_of(item_text_col).alias("text")), max_windows)
    vocabulary = _Vocabulary()

    def index(k: int):
        block = texts.filter(F.col("block") == k).select("number", "text").collect()  # at most max_windows windows
        telling = [tuple(r) for r in block if len(_Template(r["text"], vocabulary).plain) >= shortest]
        return docs.sparkSession.sparkContext.broadcast(_Index(telling, size, literals))

    if passes == 1:
        return docs.filter(~_contains(index(0), least, coverage)(text_of(text_col)))
    rows = save(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    gone = None
    for k in range(passes):
        own = index(k)
        found = save(rows.filter(_contains(own, least, coverage)(text_of(text_col))).select(F.col("__row").alias("__gone")), "leaks")
        own.unpersist()
        gone = found if gone is None else gone.union(found)
    return rows.join(gone, F.col("__row") == F.col("__gone"), "left_anti").drop("__row")


def _contains(index, least: int, coverage: float):
    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, own = _Vocabulary(), index.value
        for texts in batches:
            yield pa.array([any(True for _ in own.matches(t.as_py(), vocabulary, least, coverage)) for t in texts], pa.bool_())

    return run
