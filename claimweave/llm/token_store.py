"""Token-id shards, compressed by an adaptive context-mixing range coder.

File format: a Parquet table whose rows are segments, each of whole documents in ascending doc_id order: shard, segment,
doc_ids, lengths, and a payload.

    payload  b"CWT3", uint32 ids, uint32 blocks, uint8 whether ids exceed 16 bits, then per block uint32 words and
             uint32 crc32 of its ids, then the 32-bit words of all blocks. Where ids exceed 16 bits, blocks is the
             length of the payload of their low halves, which follows, and that of their high halves is behind it.

The ids are cut into blocks of equal length, which are coded in step with each other, one numpy lane per block: first the
first id of each, then the second. The model adapts as often as half as many ids again, later twice as many, are known:
it is learnt anew from all ids that all blocks have coded so far, which the decoder has too. Of each context, the last
two ids if they occurred together often enough, else the last one, it has a row of what followed, in which the
frequencies of orders 2, 1 and 0 are mixed, each with a weight that grows with what its context has seen. A row splits a
power of two of slots, so that a range is narrowed by a shift and the decoder finds an id by one look into the slots. An id that
the row doesn't list follows in order 0; one that is new to it, as it is.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, text_of

MAGIC = b"CWT3"
#: Ids of a block, most of all: longer ones cost fewer bytes, shorter ones are coded faster.
BLOCK = 2048
#: Ids of a segment at which it is closed; a longer document is a segment of its own.
SEGMENT = 1 << 22
#: An id of one stream has 16 bits; FRESH stands for an id that a row doesn't list.
WORD = FRESH = 1 << 16
#: Two ids are a context of their own from so many occurrences, and one more for each 2**12 ids; the most ids listed behind one and behind two.
OFTEN, LISTED = 16, (1 << 19, 1 << 18)
_U = np.uint64
_HEAD = "<4sIIB"
_HEAD_BYTES = struct.calcsize(_HEAD)
_FULL, _BOTTOM, _HALF = _U(2**64 - 1), _U(1 << 32), _U(32)
#: An entry holds start, share and id in one number; a state holds a row's first slot and the bits of its slots.
_START, _SHARE, _ID, _SIZE = _U(35), _U(17), _U((1 << 17) - 1), _U(5)
_SHARES, _BITS = _U((1 << 18) - 1), _U(31)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of keys, ascending, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def _places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key, below 2**40, stands in the ascending table; -1: nowhere. Keys are sorted first, so that each value is looked up once."""
    if len(keys) < 4096:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)
    out = np.full(len(keys), -1, np.int32)
    for k in range(0, len(keys), 1 << 24):
        own = keys[k : k + (1 << 24)].astype(_U)
        own <<= _U(24)
        own |= np.arange(len(own), dtype=_U)
        own.sort()
        place = (own & _U((1 << 24) - 1)).view(np.int64)
        own >>= _U(24)
        new = np.concatenate([[True], own[1:] != own[:-1]])
        wanted = own[new].astype(table.dtype)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        at = np.where(table[at] == wanted, at, -1).astype(np.int32)
        out[place + k] = np.repeat(at, np.diff(np.flatnonzero(new), append=len(own)))
    return out


def _mark(twos: np.ndarray) -> np.ndarray:
    """20 bits of a hash of two ids."""
    return (twos * np.uint32(0x9E3779B1)) >> np.uint32(12)


def _hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).view(np.int64)


class _Model:
    """Rows of what follows a context, from ids that coder and decoder both know: seen has two lines before the first step, a column a block.

    Row 0 is order 0, then come a row for each id, then one for each two ids that occurred often enough. A row mixes the
    frequencies behind its context with the shares of the next shorter one, which weigh as much as the row has distinct
    ids, and splits 2**bits slots by that mixture; what is left is the share of FRESH.
    """

    def __init__(self, seen: np.ndarray) -> None:
        before, last, now = (seen[k : len(seen) - 2 + k].reshape(-1) for k in range(3))
        self.keys, self.starts, self.shares, self.bits, self.ends = [], [], [], [], []
        pairs, of_pairs = _runs((last.astype(np.uint32) << 16) | now) if len(now) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        counts = np.bincount(pairs & 0xFFFF, of_pairs, 1).astype(np.int64)
        ids = np.flatnonzero(counts)
        self._add(np.zeros(len(ids), np.int64), ids, counts[ids], np.ones(len(ids), np.int64), 0, len(now), np.array([len(now)]))
        ids_0 = np.zeros(WORD, np.int64)
        ids_0[ids] = self._share_of(0, np.arange(len(ids)))
        self.row_1 = np.zeros(WORD, np.int64)
        self.pairs, tails = np.empty(0, np.uint32), [np.array([0])]
        if len(now):
            counts = of_pairs
            heads, row, total = self._kept_rows(pairs >> 16, counts)
            self.row_1[heads] = np.arange(1, len(heads) + 1)
            self.pairs = pairs[counts >= OFTEN + (len(now) >> 12)]
            self.index = self._index()
            tails.append(heads.astype(np.int64))
            kept = self._most(counts, LISTED[0])
            ids = (pairs[kept] & 0xFFFF).astype(np.int64)
            self._add(row[kept], ids, counts[kept], ids_0[ids], 1, len(now), total)
        twos = (before.astype(np.uint32) << 16) | last
        at, own = self._paired(twos)
        own = own.nonzero()[0]
        if len(own):
            threes, counts = _runs((at[own].astype(_U) << _U(16)) | now[own])
            heads, row, total = self._kept_rows((threes >> _U(16)).view(np.int64), counts)
            self.pairs = self.pairs[heads]
            tails.append((self.pairs & 0xFFFF).astype(np.int64))
            kept = self._most(counts, LISTED[1])
            ids = (threes[kept] & _U(0xFFFF)).astype(np.int64)
            key = (self.row_1[tails[-1]][row[kept]] << 17) | ids
            at = np.minimum(np.searchsorted(self.keys[1], key), len(self.keys[1]) - 1)
            self._add(row[kept], ids, counts[kept], np.where(self.keys[1][at] == key, self._share_of(1, at), 0), len(self.row_1.nonzero()[0]) + 1, len(now), total)
        else:
            self.pairs = self.pairs[:0]
        self.index = self._index()
        keys, starts, shares, bits = (np.concatenate(x) for x in (self.keys, self.starts, self.shares, self.bits))
        self.keys, self.bits = keys, bits.astype(_U)
        rows = keys >> 17
        self.fresh = np.flatnonzero((keys & 0x1FFFF) == FRESH)
        slot = np.cumsum(1 << bits) - (1 << bits)
        self.states = ((slot << 5) | bits).astype(_U)
        self.entries = (starts.astype(_U) << _START) | (shares.astype(_U) << _SHARE) | (keys & 0x1FFFF).astype(_U)
        self.slots = np.repeat(np.arange(len(keys), dtype=np.int32), shares)
        self.tails, self.rows = np.concatenate(tails), rows

    def _index(self) -> np.ndarray:
        """By a hash of two ids, where they stand among the pairs; of pairs that share a hash one alone has a row."""
        index = np.zeros(1 << 20, np.int32)
        index[_mark(self.pairs)] = np.arange(len(self.pairs), dtype=np.int32)
        return index

    def _paired(self, twos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each two ids stand among the pairs, and whether they do."""
        if not len(self.pairs):
            return np.zeros(len(twos), np.int32), np.zeros(len(twos), bool)
        at = self.index.take(_mark(twos))
        return at, self.pairs.take(at) == twos

    @staticmethod
    def _kept_rows(heads: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts, ascending; each entry's context among them; occurrences of each."""
        new = np.concatenate([[True], heads[1:] != heads[:-1]])
        row = np.cumsum(new) - 1
        return heads[new], row, np.add.reduceat(counts, np.flatnonzero(new))

    @staticmethod
    def _most(counts: np.ndarray, most: int) -> np.ndarray:
        """Entries of the highest counts, at most so many; what isn't listed is FRESH."""
        least = 1
        while np.count_nonzero(counts >= least) > most:
            least += 1
        return np.flatnonzero(counts >= least)

    def _share_of(self, order: int, at: np.ndarray) -> np.ndarray:
        """The share of entries of an order in 2**16."""
        return (self.shares[order][at] << 16) >> self.bits[order][(self.keys[order][at] >> 17) - (self.keys[order][0] >> 17)]

    def _add(self, row: np.ndarray, ids: np.ndarray, counts: np.ndarray, lower: np.ndarray, first: int, seen: int, total: np.ndarray) -> None:
        """Append rows; an entry has its row, id, count and share of the next shorter context, a row has all that it counted."""
        n = np.bincount(row, minlength=len(total))
        fade = max(0, int(seen).bit_length() - 26)
        weight = (counts << 16 >> fade) + n[row] * lower
        rest = ((total - np.bincount(row, counts, len(total)).astype(np.int64)) << 16 >> fade) + n * np.maximum(WORD - np.bincount(row, lower, len(total)).astype(np.int64), 64) + 1
        ends = np.cumsum(n)
        ids, row, weight = np.insert(ids, ends, FRESH), np.insert(row, ends, np.arange(len(total))), np.insert(weight, ends, rest)
        n = n + 1
        bits = np.minimum(np.ceil(np.log2(16 * n)).astype(np.int64), 17)
        begin = np.cumsum(n) - n
        upto = np.cumsum(weight)
        whole = np.add.reduceat(weight, begin)
        below = upto - weight - (upto - weight)[begin][row]
        starts = np.arange(len(ids)) - begin[row] + below * ((1 << bits) - n)[row] // whole[row]
        stop = np.append(starts[1:], 0)
        stop[begin + n - 1] = 1 << bits
        self.keys.append(((row + first) << 17) | ids)
        self.starts.append(starts)
        self.shares.append(stop - starts)
        self.bits.append(bits)

    def place(self, row: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The entry of each id in its row; -1: not listed. Most are found by a hash of both, those that share theirs by sorting."""
        bits = max(12, len(self.keys).bit_length() + 1)
        index = np.zeros(1 << bits, np.int32)
        index[_hashed(self.keys, bits)] = np.arange(len(self.keys), dtype=np.int32)
        out = np.empty(len(ids), np.int32)
        for k in range(0, len(ids), 1 << 18):
            keys = (row[k : k + (1 << 18)] << 17) | ids[k : k + (1 << 18)]
            at = index.take(_hashed(keys, bits))
            own = (self.keys.take(at) != keys).nonzero()[0]
            at[own] = _places(self.keys, keys[own])
            out[k : k + (1 << 18)] = at
        return out

    def row(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The row behind two ids: their own, else that of the last, else order 0."""
        row = self.row_1.take(last)
        if len(self.pairs):
            at, own = self._paired((before.astype(np.uint32) << 16) | last.astype(np.uint32))
            row = np.where(own, at + (len(self.states) - len(self.pairs)), row)
        return row

    def following(self) -> np.ndarray:
        """The state behind each entry; behind FRESH it means nothing."""
        ids = np.minimum(self.keys & 0x1FFFF, WORD - 1)
        row = self.row(self.tails[self.rows], ids)
        # Where order 0 is the state, the last id has no row, and none of the pairs begins with it.
        own = slice(self.fresh[0] + 1)
        row[own] = self.row_1[ids[own]]
        return self.states[row]


def _generations(steps: int, blocks: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the steps between which the model is learnt anew."""
    ends = [steps]
    while ends[-1]:
        ends.append(ends[-1] // 4 if ends[-1] * blocks > 1 << 18 else ends[-1] * 2 // 3)
    return zip(ends[:0:-1], ends[-2::-1])


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The payload of ids below 2**32."""
    ids = np.asarray(ids).astype(np.int64)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 2**32:
        raise ValueError("ids must be below 2**32")
    if len(ids) and int(ids.max()) >= WORD:
        low = encode(ids & (WORD - 1), block)
        return struct.pack(_HEAD, MAGIC, len(ids), len(low), True) + low + encode(ids >> 16, block)
    blocks = -(-len(ids) // block)
    head = struct.pack(_HEAD, MAGIC, len(ids), blocks, False)
    if not blocks:
        return head
    steps = -(-len(ids) // blocks)
    # The last block may be shorter: it runs on with ids of the first.
    seen = np.zeros((steps + 2, blocks), np.uint16)
    seen[2:] = np.resize(ids, blocks * steps).reshape(blocks, steps).T
    low, width = np.zeros(blocks, _U), np.full(blocks, _FULL)
    columns = 2 * steps + 4
    flat = np.zeros(blocks * columns, np.uint32)
    used = np.arange(blocks) * columns

    def renew(go: np.ndarray) -> None:
        if len(go):
            x, at = low.take(go), used.take(go)
            flat[at] = x >> _HALF
            used[go] = at + 1
            low[go] = x << _HALF
            width[go] = width.take(go) << _HALF

    def carry(over: np.ndarray) -> None:
        """The lower ends of these lanes went over: that goes into what is written already."""
        back = used.take(over)
        while len(back):
            back -= 1
            flat[back] += np.uint32(1)
            back = back[flat.take(back) == 0]

    def narrow(own: np.ndarray, start: np.ndarray, share: np.ndarray, bits: np.ndarray) -> None:
        """Narrow the range of some of the lanes, renewed before."""
        renew(own[width.take(own) < _BOTTOM])
        r = width.take(own) >> bits
        width[own] = r * share
        r *= start
        x = low.take(own) + r
        low[own] = x
        carry(own[x < r])

    for begin, end in _generations(steps, blocks):
        m = _Model(seen[: begin + 2])
        before, last, now = (seen[begin + k : end + k].reshape(-1) for k in range(3))
        row = m.row(before, last)
        at = m.place(row, now)
        missing = at < 0
        at[missing] = m.fresh.take(row[missing])
        entries, bits = m.entries.take(at).reshape(-1, blocks), m.bits.take(row).reshape(-1, blocks)
        missing, from_0 = missing.reshape(-1, blocks), (row == 0).reshape(-1, blocks)
        size_0, place_0 = m.bits[0], np.full(WORD, m.fresh[0])
        place_0[m.keys[: m.fresh[0]]] = np.arange(m.fresh[0])
        for t in range(end - begin):
            e = entries[t]
            np.right_shift(width, bits[t], out=width)
            gain = e >> _START
            gain *= width
            np.multiply(width, (e >> _SHARE) & _SHARES, out=width)
            np.add(low, gain, out=low)
            over = (low < gain).nonzero()[0]
            if len(over):
                carry(over)
            own = missing[t].nonzero()[0]
            if len(own):
                new = seen[begin + t + 2].take(own).astype(np.int64)
                at_0 = place_0.take(new)
                once = ~from_0[t].take(own)
                x = m.entries.take(at_0[once])
                if len(x):
                    narrow(own[once], x >> _START, (x >> _SHARE) & _SHARES, size_0)
                new, own = new[at_0 == m.fresh[0]], own[at_0 == m.fresh[0]]
                if len(own):
                    narrow(own, new.view(_U), _U(1), _U(16))
            renew((width < _BOTTOM).nonzero()[0])
    for _ in range(2):
        flat[used] = low >> _HALF
        used += 1
        low <<= _HALF
    size = (used - np.arange(blocks) * columns).tolist()
    sums = np.array([(n, crc32(ids[k * steps : (k + 1) * steps].astype("<u4").tobytes())) for k, n in enumerate(size)], "<u4")
    return head + sums.tobytes() + b"".join(flat[k * columns : k * columns + n].tobytes() for k, n in enumerate(size))


def decode(payload: bytes) -> np.ndarray:
    """The ids of a payload; a block whose checksum is wrong raises ValueError."""
    magic, total, blocks, wide = struct.unpack_from(_HEAD, payload)
    if magic != MAGIC:
        raise ValueError("not a token payload")
    if wide:
        payload = payload[_HEAD_BYTES:]
        return decode(payload[:blocks]) | (decode(payload[blocks:]) << np.uint32(16))
    if not blocks:
        return np.empty(0, np.uint32)
    sums = np.frombuffer(payload, "<u4", 2 * blocks, _HEAD_BYTES).reshape(blocks, 2)
    size = sums[:, 0].astype(np.int64)
    words = np.frombuffer(payload, np.uint32, int(size.sum()), _HEAD_BYTES + 8 * blocks).copy()  # aligned
    at = np.cumsum(size) - size
    steps = -(-total // blocks)
    # code is what the words hold above the lower end.
    width, code = np.full(blocks, _FULL), (words.take(at).astype(_U) << _HALF) | words.take(at + 1, mode="clip")
    at += 2

    def renew(go: np.ndarray) -> None:
        if len(go):
            here = at.take(go)
            code[go] = (code.take(go) << _HALF) | words.take(here, mode="clip")
            at[go] = here + 1
            width[go] = width.take(go) << _HALF

    seen = np.zeros((steps + 2, blocks), np.uint16)
    for begin, end in _generations(steps, blocks):
        m = _Model(seen[: begin + 2])
        slots, entries, following = m.slots, m.entries, m.following()
        state = m.states.take(m.row(seen[begin], seen[begin + 1]))
        size_0 = m.bits[0]
        for t in range(begin + 2, end + 2):
            np.right_shift(width, state & _BITS, out=width)
            slot = code // width
            slot += state >> _SIZE
            e = slots.take(slot.view(np.int64), mode="clip")  # a damaged payload may point anywhere; its checksum tells
            x = entries.take(e)
            code -= (x >> _START) * width
            np.multiply(width, (x >> _SHARE) & _SHARES, out=width)
            x &= _ID
            own = (x == FRESH).nonzero()[0]
            if len(own):
                once = own[(state.take(own) >> _SIZE) != 0]
                if len(once):
                    renew(once[width.take(once) < _BOTTOM])
                    w, c = width.take(once) >> size_0, code.take(once)
                    y = entries.take(slots.take((c // w).view(np.int64), mode="clip"))
                    code[once], width[once] = c - (y >> _START) * w, w * ((y >> _SHARE) & _SHARES)
                    x[once] = y & _ID
                new = own[x.take(own) == FRESH]
                if len(new):
                    renew(new[width.take(new) < _BOTTOM])
                    w, c = width.take(new) >> _U(16), code.take(new)
                    y = c // w
                    code[new], width[new] = c - y * w, w
                    x[new] = y
            seen[t] = x
            state = following.take(e)
            if len(own):
                state[own] = m.states.take(m.row(seen[t - 1].take(own), seen[t].take(own)))
            renew((width < _BOTTOM).nonzero()[0])
    out = np.ascontiguousarray(seen[2:].T).reshape(-1)[:total].astype(np.uint32)
    for k, n in enumerate(sums[:, 1].tolist()):
        if crc32(out[k * steps : (k + 1) * steps].astype("<u4").tobytes()) != n:
            raise ValueError(f"block {k}: wrong checksum")
    return out


def _latin_pattern() -> str:
    """The vocabulary's word pattern with its classes spelled out for characters below U+0300."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for k in range(0x300):
        kind = unicodedata.category(chr(k))[0]
        if kind in kinds:
            kinds[kind].append(re.escape(chr(k)))
    letters, digits, white = "".join(kinds["L"]), "".join(kinds["N"]), "\t-\r \x85\xa0"
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{white}{letters}{digits}]+"


#: Characters below U+0300 whose lower case isn't one character below U+0300.
_GROWING = "".join(c for c in map(chr, range(0x300)) if len(c.lower()) > 1 or c.lower() >= "\u0300")
#: Pieces with one of those, marks or scripts from U+0300 on only the library itself handles, and what may be a special token.
_OTHER = re.compile(f"[{_GROWING}\u0300-\U0010ffff]")


class _Words(dict):
    """Word -> bytes of its ids by the library's model. When full, it begins anew and takes from the words before what is asked for again."""

    def __init__(self, model, most: int) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokens, self.most, self.before = model.tokenize, most, {}
        self.spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
        found = self.before.get(word)
        if found is None:
            ids = [t.id for t in self.tokens(word if word.isascii() and word.isprintable() else self.spelled(word)[0][0])]
            found = struct.pack(f"={len(ids)}H", *ids)
        self[word] = found
        return found


class WordEncoder:
    """Ids of whole texts as tokenizers gives them for word_bpe_49k.json without added special tokens.

    No word, special token or composed character reaches over ASCII white space, so texts are split there and each
    distinct piece of a batch is encoded once; Arrow splits, numbers the pieces and puts their ids in place. Ids of a word
    don't depend on its neighbours either, so the library's model is asked once for each word. Splitting a piece into
    words is done here below U+0300, where the library's normal form is lower case alone; other pieces go to it whole.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = re.compile(_latin_pattern())
        self.known = _Words(self.library.model, most)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[:-1].isalpha():  # a word, or one with a mark or digit behind it
            return self.known[piece.lower()] if piece.isalpha() else self.known[piece[:-1].lower()] + self.known[piece[-1]]
        if not piece.isascii() and _OTHER.search(piece) or "<|" in piece:
            return np.array(self.library.encode(piece, add_special_tokens=False).ids, np.uint16).tobytes()
        return b"".join(map(self.known.__getitem__, self.words.findall(piece.lower())))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and how many each text has."""
        pieces = pc.ascii_split_whitespace(texts)
        coded = pieces.flatten().dictionary_encode()
        known = self.known.get  # a word that is known is a piece of one word
        found = [self._piece(p) if (ids := known(p)) is None else ids for p in coded.dictionary.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(np.fromiter(chain([0], map(len, found)), np.int32, len(found) + 1), dtype=np.int32) >> 1
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.uint16))).take(coded.indices)
        return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy().take(pieces.offsets.to_numpy()))

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


@lru_cache(1)
def _word_encoder(path: str) -> WordEncoder:
    """A worker keeps the words that it has encoded from one task to the next."""
    return WordEncoder(path)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The columns of a batch in runs of rows with some 16 MB of text, or of one row."""
    at = pc.cumulative_sum(pc.binary_length(batch.column(1)).cast(pa.int64())).to_numpy() >> 24
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            yield batch.column(0)[begin:end], batch.column(1)[begin:end]


_SEGMENTS = "shard int, segment int, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"


def _segments(path: str, end_id: int, block: int, segment: int):
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, shard, number = _word_encoder(path), TaskContext.get().partitionId(), 0
        docs, parts, size = [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, number, docs, [len(p) for p in parts], len(ids), encode(ids, block)), schema)], schema=schema)

        for batch in batches:
            for doc_ids, texts in _slices(batch):
                ids, lengths = words.batch(texts)
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, np.uint16(end_id))
                for doc_id, own in zip(doc_ids.to_pylist(), np.split(ids, ends[:-1] + np.arange(1, len(ends)))):
                    if parts and size + len(own) > segment:
                        yield row()
                        number, size = number + 1, 0
                        docs, parts = [], []
                    docs.append(doc_id)
                    parts.append(own)
                    size += len(own)
        if parts:
            yield row()

    return run


def write_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """Encode docs into segments in ascending doc_id order, write them and return the written table.

    Null counts as empty and is the end id alone; rows with a null doc_id come first; rows that repeat a doc_id are
    ordered by a hash of their text and written each. Other columns are ignored; an empty table gives no segments. Ranges of doc_id
    make the shards, so no task holds more than its range; equal doc_ids beyond that are told apart by their text.
    """
    if path is None:
        from public_tokenizers import path as place

        path = place("word_bpe_49k.json")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = base.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return save(ordered.mapInArrow(_segments(path, end_id, block, segment), _SEGMENTS), "token-shards")


def read_shards(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the segments: doc_id, start, n_tokens, ids_crc32, and ids (binary) if asked for.

    start is the number of ids of all documents before it.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, lengths, before, payload = (batch.column(k)[r].as_py() for k in range(4))
                ids, at, out = decode(payload).astype("<u4"), 0, []
                for doc_id, n in zip(doc_ids, lengths):
                    own = ids[at : at + n].tobytes()
                    out.append((doc_id, before + at, n, crc32(own), own)[: len(schema)])
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    # Two levels of prefix sums: over the shards, which are as few as partitions, and over the segments of a shard.
    total = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = total.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = segments.select("shard", "segment", own.alias("own"), "n_ids").join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("own")).alias("before"))
    rows = segments.join(places, ["shard", "segment"]).select("doc_ids", "lengths", "before", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
