"""Word-wise encoding, token files and packing against plain encoding."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelloom.llm import packing, token_files
from pixelloom.llm.tokens import WordEncoder, tokenizer_path

PATH = tokenizer_path()
PLAIN, WORDS = Tokenizer.from_file(PATH), WordEncoder(PATH)
ROWS = [
    (7, "The  quick\tbrown fox, it's 42 o'clock!\n"), (3, None), (5, ""), (-1, "É́tude<|endoftext|>End ..., ,x"),
    (None, "no id"), (7, "second row of the id"), (9, "long words " * 5000), (11, "repeat"), (11, "repeat"),
]


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aAbJZ'.,!?…«é́̌ΣσςİKı1２ \t\n\x0b  <|endoftext|>한👍🏽", max_size=30))
def test_same_ids_as_the_whole_text(text):
    assert WORDS.encode([text.encode()])[0].tolist() == ids(text)


def test_forgetting_words():
    small = WordEncoder(PATH, remember=3)
    assert [x.tolist() for x in small.encode([b"a b c d e", b"f g", None])] == [ids("a b c d e"), ids("f g"), []]
    assert small.encode([b"a b"])[0].tolist() == ids("a b")


def table(spark, rows=ROWS):
    rows = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, ids int").repartition(3)


def test_token_files(spark, tmp_path):
    manifest = token_files.write_token_files(table(spark), f"file://{tmp_path}/out", length=64, sequences_per_batch=4)
    got = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    order = [None if r.doc_id is None else r.doc_id for r in got]
    assert order == [None, -1, 3, 5, 7, 7, 9, 11, 11]
    at, left = 0, list(ROWS)
    for r in got:
        match = next(x for x in left if x[0] == r.doc_id and zlib.crc32(np.array([*ids(x[1]), 1], "<u4").tobytes()) == r.ids_crc32)
        left.remove(match)
        assert (r.start, r.n_tokens) == (at, len(ids(match[1])) + 1)
        at += r.n_tokens
    assert not left
    # random access: equal lengths, views of the file, masks that end with the ids
    for entry in manifest:
        file = token_files.SequenceFile(entry["sequences"])
        n, real = -(-entry["n_tokens"] // 64), 0
        for i in range(n):
            values, mask = file.sequence(i)
            assert len(values) == len(mask) == 64 and not values.flags.owndata and not mask.flags.owndata
            real += int(mask.sum())
        assert real == entry["n_tokens"]


def test_no_documents(spark):
    empty = table(spark).limit(0)
    assert token_files.token_file_digest(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_loses_nothing(spark, capacity):
    got = packing.pack_documents(table(spark), capacity=capacity).collect()
    want = sorted(np.array([*ids(t), 2], "<u4").tobytes() for _, t in ROWS)
    assert sum(r.length for r in got) == sum(len(x) // 4 for x in want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0
    # pieces of documents with one row: each id in exactly one piece
    for doc, text in [(3, None), (5, ""), (-1, ROWS[3][1]), (9, ROWS[6][1])]:
        whole, at = np.array([*ids(text), 2], "<u4"), 0
        for r in sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=6), st.integers(0, 60))
def test_closest_multiset(counts, room):
    best = {0}
    for length, n in counts.items():
        best = {s + k * length for s in best for k in range(n + 1) if s + k * length <= room}
    picked = packing.closest_multiset(sorted(counts), counts, room)
    assert sum(length * n for length, n in picked) == max(best)
    assert all(n <= counts[length] for length, n in picked)
