"""Token ids, packing and token files against the tokenizer and plain code."""

import bisect
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from feedlake.llm import packing, token_files, tokens

P = pytest.importorskip("public_tokenizers")

ODD = [
    "",
    "  a b ",
    "a\n\nb",
    "It's we'll I'LL 'S",
    "x<|endoftext|>y",
    "ÉTÉ été\tÀÿŸ",
    "a b c",
    "é ́x İstanbul ß ſ",
    "日本語 テキスト 123 ½",
    "don't 12a34 --- $$$ a.b,c!",
    "a\0b \0c",
    "x\x1cy",
]


def docs_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, length string, piece int"
    )


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_tokenizers(name):
    random.seed(3)
    texts = ODD + ["".join(random.choice(" \n\tab'sé1.,É$") for _ in range(40)) for _ in range(300)]
    encoder = tokens.Encoder(P.path(name))
    ids, offsets = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_an_untouched_tokenizers(name):
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "a", " ", "\n", "É", "\0", "word."]
    rng = random.Random(4)
    texts = ["x<|endoftext|>y", *ODD, *("".join(rng.choices(parts, k=8)) for _ in range(200)), None]
    plain = Tokenizer.from_file(P.path(name))
    ids, offsets = tokens.Encoder(P.path(name)).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def plain_best_fit(lengths, capacity):
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at == len(rooms):
            n, room = n + 1, capacity
        else:
            room = rooms.pop(at)
        if room > length:
            bisect.insort(rooms, room - length)
    return n


def test_plan_is_best_fit_decreasing():
    random.seed(4)
    for _ in range(100):
        capacity = random.choice([7, 16, 50, 100])
        counts = Counter(random.randint(1, capacity) for _ in range(random.randint(0, 300)))
        plan, filled = packing.best_fit(counts, capacity), defaultdict(list)
        for length, n in counts.items():
            rows = plan[plan[:, 0] == length]
            for i in range(n):
                _, first, sequence, each, used = rows[rows[:, 1] <= i][-1]
                ahead, slot = divmod(i - first, each)
                filled[sequence + ahead].append((used + slot * length, length))
        for places in filled.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(filled) == plain_best_fit(counts.elements(), capacity)


def test_piece_longer_than_a_sequence_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit({9: 1}, 8)


def test_documents_are_packed_whole(spark):
    rows = [(1, "a " * 30), (2, None), (2, None), (None, "b c d"), (3, ""), (4, "x " * 9)]
    path = P.path("word_bpe_49k.json")
    found = packing.pack_documents(docs_of(spark, rows), path, capacity=8).collect()
    tokenizer = tokens.Encoder(path).tokenizer
    want = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 8)):
            own = ids[at : at + 8]
            want[doc_id, piece, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
    assert len(places) == plain_best_fit([r.length for r in found], 8)
    assert packing.pack_documents(docs_of(spark, []), path).count() == 0


def test_code_is_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        counts = rng.integers(1, 1000, n) ** rng.integers(1, 4)
        heap, cost = sorted(map(int, counts)), 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int(token_files.code_lengths(counts, 40) @ counts) == cost
        bits = token_files.code_lengths(counts, 6)
        assert bits.max() <= 6 and (2.0**-bits).sum() <= 1
    assert token_files.code_lengths(np.array([5]), 4).tolist() == [1]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(5, dtype=np.int64), 2)


def test_files_give_back_what_was_written(spark, tmp_path):
    rows = [(5, "word " * 700), (1, "a b\n\nc"), (None, "null id"), (3, None), (2, "日本語 x<|endoftext|>"), (2, "again")]
    path = P.path("byte_bpe_50k.json")
    token_files.write_ids(docs_of(spark, rows), str(tmp_path / "ids"), path)
    found = token_files.read_ids(spark, str(tmp_path / "ids")).collect()
    tokenizer = tokens.Encoder(path).tokenizer
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == [None, 1, 2, 2, 3, 5]


def test_empty_table_of_token_files(spark, tmp_path):
    token_files.write_ids(docs_of(spark, []), str(tmp_path / "ids"), P.path("byte_bpe_50k.json"))
    assert token_files.digests(spark, str(tmp_path / "ids")).count() == 0


def test_new_pieces_of_one_part_are_looked_up_together(monkeypatch):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = tokens.Encoder(P.path(name))
        monkeypatch.setattr(tokens, "CACHE_PIECES", 500_000)
        encoder.learn([" Straße", "Été", "7", " don't", "x" * 60])
        assert "Été" in encoder.pieces and not {" don't", "x" * 60} & set(encoder.pieces)
        for most in (500_000, 3, 1):
            monkeypatch.setattr(tokens, "CACHE_PIECES", most)
            for text in ("A Straße in Été 7 77 it's\nÑandú. " + "ab" * 40, "a b c d e f g h", ""):
                ids, _ = encoder.encode(pa.array([text]))
                assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
