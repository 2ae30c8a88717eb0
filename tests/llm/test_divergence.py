import random
import re
from collections import Counter

import pytest

from regionframe.llm import divergence as module
from regionframe.llm.divergence import divergence

SCHEMA = "doc_id long, text string, lang string, source string, chunk string, term string, rows int, docs string, n string"


def brute(rows, least, most):
    docs = [(Counter(x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")), a or "", b or "") for _, t, a, b, *_ in rows]
    out = []
    for lang in {a for _, a, _ in docs}:
        had = Counter(x for c, a, _ in docs if a == lang for x in c)
        kept = {x for x, n in had.items() if n >= least}
        count = {}
        for c, a, b in docs:
            if a == lang:
                count.setdefault(b, Counter()).update({x: n for x, n in c.items() if x in kept})
        share = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept)) for x in kept}  # noqa: E731, B023
        p, q = {b: share(c) for b, c in count.items()}, share(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for b in count:
            pairs = [(-sum(f(p[b][x], p[o][x]) for x in kept), o.encode(), o) for o in count if o != b]
            terms = [(-f(p[b][x], q[x]), x.encode(), x) for x in kept if count[b][x] > 0 and p[b][x] > q[x]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, b, part, x, -v, n + 1) for n, (v, _, x) in enumerate(found)]
    return sorted(out)


def rows():
    r = random.Random(5)
    words = ["Alpha", "alpha,", "beta-alpha", "BETA", "é", "É", "日本 語", "x1y", "(gamma)", "1234", "a_b", "don't", "İ", "ſ", "\x00q", "q\x0bq", "rare%d"]
    text = lambda n: "".join(w % r.randrange(30) if "%d" in w else w + r.choice([" ", "\n", "\t ", "  "]) for w in r.choices(words, k=n))
    d = [(n, text(r.randint(0, 40)), r.choice(["en", "en", "de", None, ""]), r.choice(["s0", "s0", "s1", "S", None, "é"]), "c", "t", 1, "d", "n") for n in range(150)]
    d += [(200, None, "en", "no text", None, None, None, None, None), (201, "12 34", "xx", "only", None, None, None, None, None), (202, "one two", "yy", "a", None, None, None, None, None), (203, "", "yy", "b", None, None, None, None, None)]
    d += [(204, text(20_000), "en", "s0", None, None, None, None, None), (205, "x" * 100_000, "en", "s1", None, None, None, None, None)]
    return d + d[:3]  # repeated rows are documents


@pytest.mark.parametrize(("least", "most", "parts", "cells"), [(3, 200, 4, 1_000_000), (3, 4, 40, 20), (1, 200, 4, 100), (2, 200, 16, 50)])
def test_against_brute_force(spark, monkeypatch, least, most, parts, cells):
    monkeypatch.setattr(module, "CELLS", cells)
    d = rows()
    docs = spark.createDataFrame(d, SCHEMA).repartition(parts)
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence(docs, least, most).collect())
    assert got == brute(d, least, most)


def test_batches_are_counted_in_slices():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["l", "l", "l", "m"]), pa.array(["s"] * 4), pa.array(["a b  a", " a\x0bb", "a\u00a0b", None])], names=["lang", "source", "text"])
    assert [x.num_rows for x in module.slices(batch, "text", 6)] == [1, 1, 2] and [x.num_rows for x in module.slices(batch, "text", 1)] == [1, 1, 1, 1]
    got = sorted(tuple(r.values()) for r in module.counted(batch.set_column(2, "text", batch.column("text").fill_null("")), 10, 3).to_pylist())
    assert got == [("l", "s", "", 0, 0, None, None), ("l", "s", "a", 3, 2, 10, 11), ("l", "s", "a\u00a0b", 1, 1, 12, None), ("l", "s", "b", 2, 2, 10, 11), ("m", "s", "", 0, 0, None, None)]


def test_nothing(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        divergence(spark.createDataFrame([], SCHEMA), 4)
    one = [(1, None, "en", "a", None, None, None, None, None), (2, "w", "en", "b", None, None, None, None, None)]
    assert sorted(map(tuple, divergence(spark.createDataFrame(one, SCHEMA)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
