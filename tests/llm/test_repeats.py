import hashlib
import random

from regionframe.llm import repeats
from regionframe.llm.repeats import _kept, keyed, repeated_spans, with_spans

SCHEMA = "doc_id long, text string, spans string, version int, first int"


def brute(texts, window):
    """Covered bytes of each text, by looking at every window."""
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - window + 1):
            seen.setdefault(t[s : s + window], []).append((i, s))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s : s + window] = b"\1" * window
    return cover


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(200)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts = [None, "", "short"]
    for i in range(40):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 200)))
        if i % 3 == 0:
            at = r.randint(0, len(t))
            t = t[:at] + passage[r.randint(0, 30) :] + t[at:]
        if i % 5 == 0 and len(texts) > 4:
            t = texts[-1][: r.randint(0, 400)] + t
        texts.append(t)
    texts += [texts[5], texts[5], "ab" * 300, "z" * 400, "line one two three\n" * 20]
    return [(i if i != 7 else 6, t, "x", 1, 2) for i, t in enumerate(texts)]


def digest(joined):
    from pyspark.sql import functions as F

    found = joined.select("d.doc_id", "d.text", "s.spans", F.lit(0).cast("long").alias("n_repeated_words"))
    return found.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long").drop("n_repeated_words")


def test_bytes_against_brute_force(spark):
    for seed, window, gram in ((1, 60, 8), (2, 33, 5), (3, 120, 32)):
        rows = corpus(seed)
        d = keyed(spark.createDataFrame(rows, SCHEMA).repartition(5))
        got = with_spans(d, repeated_spans(d, window, gram)).transform(digest).collect()
        data = [(t or "").encode() for _, t, *_ in rows]
        want = []
        for (k, *_), t, c in zip(rows, data, brute(data, window), strict=True):
            n = sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1]))
            want.append((k, len(t), sum(c), n, hashlib.sha256(bytes(b for b, x in zip(t, c, strict=True) if not x)).hexdigest()))
        assert sorted(map(tuple, got)) == sorted(want)
        assert sum(x[2] for x in want) > 0


def test_words(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, SCHEMA)
    got = repeats.without_repeats(df, 12, 3)
    assert got.columns == df.columns
    split = [repeats.WORD.findall(t or "") for _, t, *_ in rows]
    places = {}
    for i, w in enumerate(split):
        for s in range(len(w) - 11):
            places.setdefault(tuple(w[s : s + 12]), []).append((i, s))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for i, s in at:
                gone[i] |= set(range(s, s + 12))
    want = sorted((k, [x for j, x in enumerate(w) if j not in g], t is None) for (k, t, *_), w, g in zip(rows, split, gone, strict=True) if not g or True)
    have = sorted((r.doc_id, repeats.WORD.findall(r.text or ""), r.text is None) for r in got.collect())
    # where a span is cut out of the middle of a line, the words on its two sides keep their own white space
    assert [(k, len(w), n) for k, w, n in have] == [(k, len(w), n) for k, w, n in want] and have == want
    assert any(gone)


def want_of(rows, window):
    data = [(r[1] or "").encode() for r in rows]
    out = []
    for (k, *_), t, c in zip(rows, data, brute(data, window), strict=True):
        n = sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1]))
        out.append((k, len(t), sum(c), n, hashlib.sha256(bytes(b for b, x in zip(t, c, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def test_query_at_400_bytes(spark, tmp_path):
    r = random.Random(9)
    line = "".join(r.choice("abcdefgh ") for _ in range(500))
    rows = [(None, None), (1, ""), (2, "x" * 5000), (3, "-" * 700 + "\n" + "=" * 401), (3, "-" * 399), (None, line[:420]), (None, line[:420])]
    rows += [(10 + i, "".join(r.choice("abc é") for _ in range(r.randint(0, 900))) + line[r.randint(0, 60) : r.randint(410, 500)] + str(i) * 30) for i in range(30)]
    rows += [(50, "ruled line\n" * 100), (51, "ruled line\n" * 60 + "end"), (51, "ruled line\n" * 60 + "end")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows.append((60, " ".join(map(str, range(49))) + " end"))
    rows += [(61, "x " + " ".join(map(str, range(60)))), (62, " ".join(map(str, range(5, 61))) + " y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = repeats.op9_repeats(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_repeated_words for r in got if r.doc_id in (0, 1, 2, 60, 61, 62, 50)} == {1: 0, 2: 0, 60: 0, 61: 55, 62: 55, 50: 200}
    got = [tuple(r)[:5] for r in got]
    assert sorted(got, key=str) == want_of(rows, 400) and sum(x[2] for x in got) > 10_000


def test_large_buckets_are_split(spark, monkeypatch):
    """One line in every text, so that its grams' buckets are large, and groups of blocks equal as far as they go."""
    monkeypatch.setattr(repeats, "MEMBERS", 4)
    r = random.Random(5)
    line = "".join(r.choice("abcdefgh ") for _ in range(110))
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 80))) + line[: r.randint(100, 110)] + "".join(r.choice("ab") for _ in range(r.randint(0, 8))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for window, gram in ((105, 16), (60, 8)):
        d = keyed(spark.createDataFrame(rows, "doc_id long, text string"))
        got = with_spans(d, repeated_spans(d, window, gram)).transform(digest).collect()
        assert sorted(map(tuple, got), key=str) == want_of(rows, window)


def test_long_texts(spark, monkeypatch):
    """A megabyte of one byte, of ruled lines, and a text longer than what is worked on at once."""
    texts = ["z" * 1_000_000, ("-" * 79 + "\n") * 12_500, "z" * 300 + "y", "".join(map(str, range(200_000)))]
    rows = repeats._runs(400, 64, "byte")
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(4)), pa.array([0] * 4), pa.array(texts)], names=["doc_id", "version", "text"])
    whole = pa.Table.from_batches(list(rows([batch]))).to_pylist()
    assert sum(x["doc_id"] in (0, 1) for x in whole) < 200
    monkeypatch.setattr(repeats, "UNITS", 100_000)
    parts = pa.Table.from_batches(list(rows([batch]))).to_pylist()
    windows = lambda found, d: sorted(i for x in found if x["doc_id"] == d and x["gram"] is not None for i in range(x["first"], x["first"] + x["windows"]))
    assert windows(parts, 3) == windows(whole, 3) == list(range(len(texts[3]) - 399))
    d = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in repeated_spans(d).collect()}
    assert got == {0: [(0, 1_000_000)], 1: [(0, 1_000_000)]}


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert repeats.without_repeats(e).count() == 0 and repeated_spans(keyed(e)).count() == 0
