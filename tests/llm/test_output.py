"""Packing and token files: exact round trips, edge rows, ties."""

import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing, token_files
from lectern.llm.subwords import Encoder, tokenizer_path
from lectern.session import scratch_table

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = [
    (3, "The cat sat."), (1, None), (2, ""), (3, "The cat sat."), (3, "  odd   spaces \n\n x  "),
    (7, "été's <|endoftext|> don't stop  now  " * 40), (None, "no id"), (9, "word " * 9000), (8, "\ttab\x00nul\n"),
]


def plain(path, text):
    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def frame(spark, rows=TEXTS):
    # The extra columns have the names of output and helper columns.
    rows = [(i, t, 5, "x", 1) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, start long, ids string, part int")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_plain_encoding(path):
    import random

    import pyarrow as pa

    random.seed(5)
    alphabet = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "a", "B", "é", " ", "  ", "\n", "b.", "'s", "1", "\t", "字", "!", "—", "İ", "x́", "≠", " ", " "]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(3000)] + [None, ""]
    firsts, ids = Encoder(path).encode(pa.array(texts))
    t = Tokenizer.from_file(path)
    for i, x in enumerate(texts):
        assert ids[firsts[i] : firsts[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_pack_encodes_a_batch_in_small_slices():
    texts = [f"{i} " + "some words of a text that is as long as a page " * 120 for i in range(1500)]
    batch = packing.pa.record_batch([[*range(len(texts))], texts], names=["doc_id", "text"])
    run = packing._pack(BYTE, 1, 2048, 64)
    list(run([batch.slice(0, 2)]))
    tracemalloc.start()
    rows = sum(x["length"].null_count < len(x) for x in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 1 and peak < 150e6


def test_pack_places_every_id_once(spark):
    size = 64
    rows = packing.pack(frame(spark).repartition(4), BYTE, size=size, open_windows=2).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length <= size
        by_doc[r.doc_id, r.doc_tokens].append((r.start, ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    for doc, text in dict(TEXTS).items():
        want = plain(BYTE, text)
        got = by_doc[doc, len(want)]
        copies = TEXTS.count((doc, text))
        assert sorted(x for _, ids in got for x in ids) == sorted(want * copies)
        joined = [x for start in sorted({s for s, _ in got}) for x in next(ids for s, ids in got if s == start)]
        assert joined == want
    total = sum(r.length for r in rows)
    assert total == sum(len(plain(BYTE, t)) for _, t in TEXTS)
    # Leftovers of four tasks are merged: at most the closed windows and one part-filled rest have much padding.
    assert len(by_sequence) * size - total < 0.1 * total + 2 * size


def test_best_fit_and_fullest_first():
    w = packing.Windows(10, 2, 0)
    assert [w.place(n) for n in (6, 7, 3, 4, 5, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 5)]
    w = packing.Windows(10, 2, 0)
    assert [w.place(n) for n in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def test_token_files_round_trip(spark):
    path = scratch_table(spark, "t")
    token_files.write(frame(spark), path, WORD, segment_bytes=200)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(i for i, _ in TEXTS if i is not None)
    at = 0
    for r in rows:
        got = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (r.start, r.n_tokens) == (at, len(got))
        assert got in [plain(WORD, t) for i, t in TEXTS if i == r.doc_id]
        at += len(got)
    assert token_files.lookup(spark, path, [2, 3]) == {
        2: [[1]],
        3: sorted([plain(WORD, t) for i, t in TEXTS if i == 3], key=lambda x: token_files.lookup(spark, path, [3])[3].index(x)),
    }
    assert token_files.lookup(spark, path, [4]) == {}


def test_segment_refuses_another_dictionary(spark):
    segment = token_files._segment(b"a" * 32, "<u2", [1], [0], [b""])
    with pytest.raises(ValueError):
        list(token_files._frames(segment, b"", b"b" * 32))


def test_empty_table(spark):
    empty = frame(spark).limit(0)
    assert packing.pack(empty, BYTE).count() == 0
    path = scratch_table(spark, "t")
    token_files.write(empty, path, WORD)
    assert token_files.read(spark, path).count() == 0


def test_registered(spark):
    from lectern.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    want = {r.doc_id: plain(WORD, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    start = 0
    for r in sorted(QUERIES["op7_token_files"](spark, d).collect(), key=lambda r: r.doc_id):
        crc = zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes())
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.doc_id]), crc)
        start += r.n_tokens
    for r in QUERIES["op10_packing"](spark, d).collect():
        assert r.length <= 2048 and r.offset + r.length <= 2048
