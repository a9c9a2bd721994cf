"""Token counts with overlap resynchronisation.

Huge documents are encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced behind a token that
both produce at the same place: in a pair-merge vocabulary a sequence of tokens is the encoding of its text exactly if
each two neighbours are, and behind a common token every pair of neighbours occurs in one of the two encodings. Where
the overlap has no common token, it is widened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

CHUNK, OVERLAP = 8_192, 512


class PieceModel:
    """A sentencepiece model with offsets in bytes."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def tokens(self, text: bytes) -> list[tuple[int, int, int]]:
        """(begin, end, id) of each token; tokens of single bytes have no place of their own."""
        return [(p.begin, p.end, p.id) for p in self.model.encode(text.decode(), return_type="proto").pieces]

    def steady(self, token: tuple[int, int, int]) -> bool:
        """A whole token of the vocabulary that covers some text."""
        return token[1] > token[0] and not (self.model.is_byte(token[2]) or self.model.is_unknown(token[2]) or self.model.is_control(token[2]))


def _whole(data: bytes, at: int) -> int:
    """The place of the character that the byte at lies in."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_long(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """(tokens of text, times that an overlap was widened); chunk and overlap in bytes of UTF-8."""
    data = text.encode()
    total, widened, start = 0, 0, 0
    end = _whole(data, chunk)
    left = model.tokens(data[:end])
    low = 0  # tokens of left before this index are counted
    while end < len(data):
        width, stop = overlap, _whole(data, end + chunk)
        while True:
            begin = max(start, _whole(data, end - width))
            right = [(a + begin, b + begin, i) for a, b, i in model.tokens(data[begin:stop])]
            # The last token of left and the first one of right feel the cut, so neither can be the common token.
            places = {t: k for k, t in enumerate(left[:-1]) if k >= low and t[0] > begin and model.steady(t)}
            at = [(places[t], k) for k, t in enumerate(right[1:], 1) if t in places]
            if at:
                a, b = at[len(at) // 2]
                total += a + 1 - low
                left, low, start = right, b + 1, begin
                break
            widened += 1
            if begin <= start:  # the chunks agree nowhere: the whole text is one chunk
                return len(model.tokens(data)), widened
            width *= 2
        end = stop
    return total + len(left) - low, widened


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    No begin, end or added special tokens, no truncation; null counts as empty and has no tokens. Repeated rows and
    null doc_ids get a row each. Other columns are ignored; an empty table gives an empty result. Texts of more than
    two chunks are encoded chunk by chunk, so the memory of a task is bounded by its longest text and one chunk's
    tokens; nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_file)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column(1).to_pylist()
                n = np.zeros(len(texts), np.int64)
                short = [k for k, t in enumerate(texts) if len(t) <= 2 * chunk]
                n[short] = model.count([texts[k] for k in short])
                for k, t in enumerate(texts):
                    if len(t) > 2 * chunk:
                        n[k] = count_long(model, t, chunk, overlap)[0]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n)], schema=schema)

    text = text_of(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
