import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keepset.llm import packing

SF = "/root/testdata/sf0.001"


def whole(pieces, window=1024):
    """Pieces by sequence and by document; checks that both are gapless."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    for rows in of_sequence.values():
        rows.sort(key=lambda p: p.offset)
        assert [p.offset for p in rows] == list(np.cumsum([0] + [p.length for p in rows])[:-1])
        assert sum(p.length for p in rows) <= window
    for rows in of_doc.values():
        rows.sort(key=lambda p: p.start)
    return of_doc, of_sequence


def test_every_id_lies_in_one_piece(spark):
    pieces = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    of_doc, of_sequence = whole(pieces)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(of_doc) == set(texts)
    for doc, rows in of_doc.items():
        ids = tokenizer.encode(texts[doc], add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(p.tokens for p in rows), "<u4").tolist() == ids
        assert {p.doc_tokens for p in rows} == {len(ids)} and all(p.length > 0 for p in rows)
        assert [p.start for p in rows] == list(np.cumsum([0] + [p.length for p in rows])[:-1])
    lengths = [sum(p.length for p in rows) for rows in of_sequence.values()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths)  # nothing is padded


def test_digest(spark):
    rows = packing.packed_documents(spark, SF).collect()
    raw = {(r.doc_id, r.start): r.tokens for r in packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert rows and all(r.ids_crc32 == zlib.crc32(raw[r.doc_id, r.start]) for r in rows)


def test_edges(spark, edges, edge_rows):
    pieces = packing.pack(edges).collect()
    whole(pieces)
    assert sum(p.start == 0 for p in pieces) == len(edge_rows)
    assert [p.length for p in pieces if p.doc_id == 1] == [1]
    assert packing.pack(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_level_is_the_least_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    windows, total, seen = packing.Windows(64, 40), 0, 0
    for size in rng.integers(1, 140, 600):
        before = windows.counts.copy()
        rest = int(size) % 64
        if rest:
            sums = {}
            for level in range(64 - rest + 1):
                if level and not before[level]:
                    continue
                after = before.copy()
                after[level] -= bool(level)
                after[level + rest] += level + rest < 64
                sums[level] = int((after[:64].astype(int)**2).sum())
            least = min(sums.values())
            assert sums[windows.level_for(rest)] == least
        total += int(size)
        seen += sum(len(ids) for w in windows.add(0, np.zeros(size, np.uint32)) for *_, ids in w)
        assert windows.n_open <= 40
    assert seen + sum(len(ids) for w in windows.close() for *_, ids in w) == total


def test_special_string_is_read_as_the_tokenizer_does(docs):
    text = "a<|endoftext|>b"
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    piece, = packing.pack(docs([(1, text)])).collect()
    assert np.frombuffer(piece.tokens, "<u4").tolist() == ids + [0]
