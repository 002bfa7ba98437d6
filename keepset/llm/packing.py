"""Sum-of-squares online packing of documents into token windows.

A document becomes its token ids and a closing id. Whole windows are cut off a
long one; the rest goes, as one piece, to the fill level where the sum of
squared counts of partly filled windows comes out smallest. Only a level array
is searched (how many open windows stand at each fill), so a piece costs one
vector operation however many windows are open. Windows that stay open at the
end of a partition are laid end to end and cut anew, the last remainder into
powers of two, so nothing is padded.

Every partition packs its own documents: no shuffle, and a hot source or key
weighs nothing. A task holds its open windows, at most ``max_open`` of them.

Null texts count as empty: one piece with the closing id. Repeated rows are
packed once each. Row order decides the packing, never which ids are kept. An
empty table gives no pieces. Only the two named columns are read.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.llm.arrow import released, texts
from keepset.llm.store import table

WINDOW = 1024
CLOSING_ID = 0
MAX_OPEN = 2048
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


@functools.cache
def encoder(tokenizer: str, ranks: str):
    """text -> uint32 ids of ``tokenizer``, without special tokens added.

    ``ranks`` is the same vocabulary for the faster library; texts with the
    string of a special token go to ``tokenizer`` itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    def place(name):
        return name if os.path.isabs(name) else public_tokenizers.path(name)

    with open(place(tokenizer), encoding="utf-8") as file:
        whole = file.read()
    at = re.search(r'"added_tokens"\s*:\s*', whole)
    special = [t["content"] for t in json.JSONDecoder().raw_decode(whole, at.end())[0]] if at else []

    @functools.cache
    def exact():  # large, and rarely needed
        return Tokenizer.from_file(place(tokenizer))

    with open(place(ranks), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


class Windows:
    """Open windows by fill level; yields finished windows as lists of pieces.

    A piece is ``(document, start, ids)``, a window a list of pieces without
    gaps. ``document`` is whatever the caller passed.
    """

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.n_open = window, max_open, 0
        self.counts = np.zeros(window + 1, dtype=np.int64)  # the level array; full windows are never counted
        self.at: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The fill level to place ``size`` ids at: 0 opens a window.

        Moving a window from level h to h + size changes the sum of squares by
        2 (N[h + size] - N[h]) + 2, filling it by 1 - 2 N[h], opening one by
        2 N[size] + 1. Ties go to the fullest level.
        """
        counts, top = self.counts, self.window - size
        change = 2 * (counts[size:] - counts[:top + 1]) + 2
        change[-1] -= 1
        change[0] = 2 * counts[size] + 1 if size < self.window else 0
        change[1:][counts[1:top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, document, ids: np.ndarray) -> Iterator[list]:
        n, start = len(ids), 0
        while n - start >= self.window:
            yield [(document, start, ids[start:start + self.window])]
            start += self.window
        size = n - start
        if not size:
            return
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.at[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        pieces.append((document, start, ids[start:]))
        if level + size == self.window:
            yield pieces
            return
        self.at[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.close()

    def close(self) -> Iterator[list]:
        """Lay the open windows end to end, fullest first, and cut without padding."""
        rest = [piece for level in reversed(self.at) for pieces in level for piece in pieces]
        total = sum(len(ids) for *_, ids in rest)
        self.__init__(self.window, self.max_open)
        room, pieces = _room(total, self.window), []
        for document, start, ids in rest:
            while len(ids):
                pieces.append((document, start, ids[:room]))
                taken = min(room, len(ids))
                ids, start, room, total = ids[taken:], start + taken, room - taken, total - taken
                if not room:
                    yield pieces
                    room, pieces = _room(total, self.window), []


def _room(left: int, window: int) -> int:
    """The next window's size: whole, or the largest power of two that is left."""
    return window if left >= window else 1 << left.bit_length() - 1 if left else 0


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = TOKENIZER, ranks: str = RANKS,
         window: int = WINDOW, closing_id: int = CLOSING_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of packed sequences: ``id, start, length, doc_tokens, sequence_id, offset, tokens``.

    ``tokens`` holds the piece's ids as little-endian unsigned 32-bit numbers.
    """
    if window < 2 or max_open < 1:
        raise ValueError("a window needs at least two ids and one open window must be allowed")
    key = pa.int64() if dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else pa.string()
    out = pa.schema([("id", key), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tokens", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = encoder(tokenizer, ranks), Windows(window, max_open)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def laid(done: Iterable[list]) -> None:
            nonlocal sequence
            for pieces in done:
                offset = 0
                for (doc, n), start, ids in pieces:
                    rows.append((doc, start, len(ids), n, sequence, offset, ids.astype("<u4").tobytes()))
                    offset += len(ids)
                sequence += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(column, type) for column, type in zip(zip(*rows), out.types)], schema=out)
            rows.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.append(encode(text), np.uint32(closing_id))
                laid(windows.add((doc, len(ids)), ids))
                if len(rows) >= 4096:
                    yield flush()
        laid(windows.close())
        if rows:
            yield flush()

    kind = "long" if key == pa.int64() else "string"
    source = df.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(released(work), f"id {kind}, start long, length long, doc_tokens long, sequence_id long, "
                                   "offset long, tokens binary").withColumnRenamed("id", id_col)


def packed_documents(spark, sf_dir: str) -> DataFrame:
    """``op1_packing``: every document, with a checksum of each piece's ids."""
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")
