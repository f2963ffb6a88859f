"""Encoding, token codes and packing."""

import random

import numpy as np
import pytest
from llm_fixtures import crc, edge_rows
from postsieve.llm import packing, token_codes
from postsieve.llm.encoding import Encoder, vocabulary
from postsieve.llm.queries import tokenizer_file

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", " ", "\n", "  ", "a  b", "a \n b", "\n\n a", "a\tb", "a\t b", "a b\t", "don't stop 's x", "<|endoftext|> a", "a\0b c",
    "é É. ß", "İstanbul ΣΑΣ. Σ", "x.\ny", "x.\n\ny", "1,2 3.", "a b", "á b ́c", "a\x1cb \x1c c", "ab.. c!?", "日本 語。a", "a\r\nb\r\n",
]


def library(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("name", FILES)
def test_memo_gives_the_ids_of_the_library(name):
    rng = random.Random(3)
    letters = ["a", "b", "Zu", " ", " ", "\n", ".", "'s", "é", "1", "\t", " ", "Σ", "!", "\0", "́"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    whole, encoder = library(name), Encoder(vocabulary(tokenizer_file(name)), memo=50)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == whole(text).tobytes(), ascii(text)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_every_id_and_range(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.0005, n) * rng.integers(1, 5000, n), 2**32 - 1).astype(np.uint32)
    starts = np.array([0, n // 3, n])
    codes = token_codes.Codes(b"".join(token_codes.packed(7, [None, 5], starts, ids)))
    assert codes.ids(0, n).tolist() == ids.tolist()
    assert [codes[i] for i in range(n)] == ids.tolist()
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert codes.ids(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        codes[n]
    assert codes.doc_ids.tolist() == [0, 5] and codes.known.tolist() == [False, True] and codes.base == 7


def expected(name):
    whole = library(name)
    docs = sorted(((r[0], r[1] or "") for r in edge_rows()), key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    return [(d, np.append(whole(t), np.uint32(2)).astype("<u4")) for d, t in docs]


def test_files_hold_all_documents_in_order(spark, edge_docs):
    path, files = token_codes.write_codes(edge_docs, tokenizer_file(FILES[0]), file_ids=500)
    assert files.count() > 3
    got = sorted(tuple(r) for r in token_codes.read_codes(spark, path, files).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    start, want = 0, []
    for doc_id, ids in expected(FILES[0]):
        want.append((start, doc_id, len(ids), crc(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_no_documents(spark, no_docs):
    path, files = token_codes.write_codes(no_docs, tokenizer_file(FILES[0]))
    assert token_codes.read_codes(spark, path, files).count() == 0
    assert packing.pack(no_docs, tokenizer_file(FILES[1])).count() == 0


def test_pieces_fill_sequences_and_give_back_the_documents(edge_docs):
    rows = packing.pack(edge_docs, tokenizer_file(FILES[1]), capacity=256, group_ids=4000).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and crc(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    want = {}
    for doc_id, ids in expected(FILES[1]):
        want.setdefault((doc_id, len(ids)), []).append(ids.tobytes())
    assert pieces.keys() == want.keys()
    for key, found in pieces.items():
        assert b"".join(p for _, p in sorted(found)) == b"".join(want[key]) or len(want[key]) > 1


def test_differencing_balances_and_opens_windows():
    rng = random.Random(5)
    sizes = [rng.randint(1, 900) for _ in range(300)]
    found = packing.differenced(sizes, 20)
    assert sorted(i for w in found for i in w) == list(range(300))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) - min(sums) <= 20
    for capacity in (900, 1000, 4096):
        packed = packing.windows(sizes, capacity)
        assert sorted(i for w in packed for i in w) == list(range(300))
        assert max(sum(sizes[i] for i in w) for w in packed) <= capacity
    assert len(packing.windows([3, 3, 3], 5)) == 3  # two windows would hold the sum, but not the items
    assert packing.windows([], 5) == []
