import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from regionframe.llm import bitpack, packing
from regionframe.llm.tokens import encoder, vocabulary

ODD = ["", "a b  c", "don't we'll 's'' ''s x's", "<|endoftext|> hi <|startoftext|>", "é ΑΣ İ ǅ ﬁ é 日本  \u0085\x1c x\n\n y ", "\x00\x1f ½²³ ªº 12 3", " '  're  \t\n a", "Aİıſ ß", "word " * 3000, "x" * 5000, "\n \n"]
SCHEMA = "doc_id long, text string, lang string, source string, start long, part string"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name):
    t = Tokenizer.from_file(vocabulary(name))
    for x in ODD:
        assert np.frombuffer(encoder(vocabulary(name)).encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def rows():
    r = random.Random(2)
    texts = ODD + [" ".join(r.choice(["alpha", "beta", "gamma", "don't", "12"]) for _ in range(r.randint(0, 900))) for _ in range(60)] + [None, None]
    return [(i * 3 % 71, x, None, "s", 5, "clash") for i, x in enumerate(texts)] + [(None, "no id", None, None, None, None)]


def test_packing(spark):
    d, t = rows(), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = sorted((str(k), [*t.encode(x or "", add_special_tokens=False).ids, 1]) for k, x, *_ in d)
    got = packing.pack(spark.createDataFrame(d, SCHEMA).repartition(3), with_ids=True).collect()
    sequences, docs = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, ids))
    whole = []
    for (k, n), pieces in docs.items():
        seen = sum(len(x) for _, x in pieces)
        if seen == n:
            whole.append((k, [i for _, x in sorted(pieces) for i in x]))
    assert all(w in want for w in whole) and len(whole) >= len({k for k, _ in want}) - 12
    assert sum(r.length for r in got) == sum(len(x) for _, x in want)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_closest_against_all_subsets():
    r = random.Random(5)
    for _ in range(80):
        items = [r.randint(1, 30) for _ in range(r.randint(0, 8))]
        capacity, counts = r.randint(0, 64), [0] * 65
        for x in items:
            counts[x] += 1
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        taken, best = packing.closest(sorted(set(items)), counts, capacity)
        assert best == max(s for s in sums if s <= capacity) == sum(k * n for k, n in taken.items())
        assert all(n <= counts[k] for k, n in taken.items())


@pytest.mark.parametrize("width", [1, 7, 16, 17, 20, 31])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 10_000)
    f = bitpack.IdFile(bitpack.file_bytes([5, None], [4000, 6000], ids, width))
    assert (f.range(0, f.ids) == ids).all() and (f.range(4090, 20) == ids[4090:4110]).all() and len(f.range(3, 0)) == 0
    assert f.lengths.tolist() == [4000, 6000] and f.known.tolist() == [True, False]
    little = ids.astype("<u4")
    assert f.crcs(at_once=999) == [zlib.crc32(little[:4000].tobytes()), zlib.crc32(little[4000:].tobytes())]


def test_ids_beyond_the_width_are_an_error():
    with pytest.raises(ValueError):
        bitpack.packed(np.array([70_000], np.uint32), 16)
    assert bitpack.width_for(bitpack.vocabulary_size(vocabulary("byte_bpe_50k.json"))) == 16


def test_blocks_are_read_by_offset_from_the_file(spark):
    """Only the header and the asked blocks of a file in the shared folder are read."""
    df = spark.createDataFrame([(1, "alpha beta " * 40_000)], "doc_id long, text string")
    files, folder = bitpack.write_files(df)
    store, at = bitpack.opened(folder)
    (row,) = files.collect()

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def seek(self, p):
            self.f.seek(p)

        def read(self, n):
            self.n += n
            return self.f.read(n)

    with store.open_input_file(f"{at}/{row['name']}") as f:
        source = Counting(f)
        got = bitpack.IdFile(source).range(50_000, 10)
    whole = encoder(vocabulary("byte_bpe_50k.json")).encode("alpha beta " * 40_000)
    assert (got == np.frombuffer(whole, "<u4")[50_000:50_010]).all() and source.n < 12_000 < len(whole) // 10


def test_files(spark):
    d, t = rows(), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    df = spark.createDataFrame(d, SCHEMA).repartition(4)
    got = sorted(bitpack.read_files(*bitpack.write_files(df)).collect(), key=lambda r: r.start)
    at, want = 0, []
    for k, x, *_ in d:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    same = bitpack.read_files(*bitpack.write_files(spark.createDataFrame([(7, "one"), (7, "one"), (7, "two x"), (None, None)], "doc_id long, text string"))).collect()
    assert sorted(r.n_tokens for r in same) == [1, 2, 2, 3] and sum(r.n_tokens for r in same) == max(r.start + r.n_tokens for r in same)
    assert [r.doc_id for r in sorted(same, key=lambda r: r.start)] == [None, 7, 7, 7]
    empty = spark.createDataFrame([], SCHEMA)
    assert bitpack.read_files(*bitpack.write_files(empty)).count() == 0 and packing.pack(empty).count() == 0
