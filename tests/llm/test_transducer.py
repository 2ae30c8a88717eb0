import random

import numpy as np
from tokenizers import Tokenizer

from regionframe.llm.tokens import vocabulary
from regionframe.llm.transducer import Transducer, token_counts

ODD = [
    "", " ", "a b  c", "don't we'll 's'' ''s x's 're've 'll'd 'r 'v 'l 'rx 'r1 a'' '", "<|endoftext|> hi <|startoftext|>", "a<|endoftext|>'s", "<|endoftext|",
    "é ΑΣ İ ǅ ﬁ é 日本  \u0085\x1c x\n\n y ", "\x00\x1f ½²³ ªº 12 3", " '  're  \t\n a", "Aİıſ ß", "word " * 3000, "x" * 5000, "日本" * 2000, "'" * 3000, "'s" * 2000, "1" * 3000,
    "'r", "'l l", "'l'l'll", "'é", "'ré", "x1'l1", "!'s", "1's", "'ré're",
]


def test_counts_are_the_library_s():
    t, path = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), vocabulary("word_bpe_49k.json")
    own, r = Transducer(path), random.Random(4)
    some = ["".join(r.choice("abcdrestlv '''é1!. \n<日") for _ in range(r.randint(1, 3000))) for _ in range(60)]
    texts = ODD + some
    assert own.count(texts).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    own.reset()
    assert own.count(texts[::-1]).tolist()[::-1] == own.count(texts).tolist()
    assert own.count([]).tolist() == []


def test_chunk_maps_do_not_depend_on_where_chunks_end(monkeypatch):
    from regionframe.llm import transducer as m

    own = Transducer(vocabulary("word_bpe_49k.json"))
    want = own.count(ODD).tolist()
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(m, "CHUNK", size)
        assert own.count([x[:600] for x in ODD] if size < 64 else ODD).tolist() == (want if size == 64 else Transducer.count(own, [x[:600] for x in ODD]).tolist())
    monkeypatch.setattr(m, "CHUNK", 3)
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert own.count([x[:300] for x in ODD]).tolist() == [len(t.encode(x[:300], add_special_tokens=False).ids) for x in ODD]


def test_frame(spark):
    d = spark.createDataFrame([(1, None, "x", 3), (1, "Hello  world", "y", 4), (None, "é", None, None)], "doc_id long, text string, n_tokens string, n_bytes int")
    assert sorted((r.n_bytes, r.n_tokens) for r in token_counts(d).collect()) == [(0, 0), (2, 1), (12, 2)]
    assert token_counts(d.limit(0)).count() == 0


def test_unbroken_texts_in_bounded_tables(monkeypatch):
    """Texts without white space run over many chunks, whose maps are composed; the tables are dropped while they run."""
    import base64
    import random

    from tokenizers import Tokenizer

    from regionframe.llm import transducer as module

    path = module.vocabulary("word_bpe_49k.json")
    library, r = Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), base64.b64encode(r.randbytes(20_000)).decode(), "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(7_000)), "a" * 50_000, "ha" * 3000 + "'ll" * 900, "", "one word"]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    t = module.Transducer(path)
    assert t.count(texts).tolist() == want
    monkeypatch.setattr(module, "MOST_STATES", 3_000)
    assert t.count(texts[::-1]).tolist() == want[::-1] and len(t.states) < 6_000 and not t.held
    assert [t.count([x]).tolist()[0] for x in texts] == want


def test_composition_of_maps_by_hand():
    """Two pieces of three chunks and one: rows (chunk, enters, exits, tokens) are followed from each piece's first state."""
    import numpy as np

    from regionframe.llm.transducer import Transducer

    rows = np.array([(0, 0, 5, 10), (1, 0, 7, 1), (1, 5, 6, 20), (2, 6, 0, 30), (2, 7, 0, 99), (3, 0, 0, 4)]).T
    got = Transducer.composed(*rows, begins=np.array([True, False, False, True]))
    assert got.tolist() == [60, 4]
