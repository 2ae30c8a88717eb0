import hashlib
import random
import re

import pytest

from regionframe.llm.infill import ORDERS, Rule, bounds, cut, fill_in_middle, restore

SCHEMA = "doc_id long, text string, n string, form int, output string, pieces string, key string"
ODD = ["", None, "\n", "\n\n", "one line", "a\n", "a\nb", "x <P> y\nz", "<M>", "<\nS>\n<P\n>\n", "é\n日本\n\U0001f600 ü\n\nend", "\r\na\rb\n", "< P>\n<S\n>>>\n<<<"]


def rows():
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["ab ", "\n", "ö", "日", "<", ">"]) for _ in range(r.randint(1, 60))) for _ in range(80)] + ["line of words\n" * 30_000]
    return [(n * 7, x, "clash", 5, "clash", "clash", "clash") for n, x in enumerate(texts)] + [(None, "no\nid\n", None, None, None, None, None), (7, "a\nb\nc", None, None, None, None, None), (7, "a\nb\nc", None, None, None, None, None)]


def plainly(key, text, rule):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if rule.unit == "line" else list(text)
    h = hashlib.sha256(f"{rule.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    p, s, m = rule.sentinels
    if not text or any(x in text for x in rule.sentinels) or h3 % 100 >= rule.rate:
        return n, "plain", None, None, text
    a, z = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if h4 % 100 < rule.spm:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("rule", [Rule(), Rule(unit="char", rate=60, spm=20, seed=1, sentinels=("<PRE>", "<SUF>", "<MID>"))])
def test_against_plain_python(spark, rule):
    d = rows()
    made = fill_in_middle(spark.createDataFrame(d, SCHEMA).repartition(3), rule)
    got = restore(made, rule).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((str(k), *plainly(k, x, rule), sha(plainly(k, x, rule)[-1]), x or "", sha(x or "")) for k, x, *_ in d)
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.text, r.restored_sha256) for r in got) == want
    marks, texts = "".join(rule.sentinels).encode(), {str(k): (x or "").encode() for k, x, *_ in d if k != 7}
    for r in got:  # the descriptors say where the output's bytes lie
        if r.doc_id != 7:
            buffers = (texts[str(r.doc_id)], marks)
            assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode() == r.output
            assert len(r.pieces) == (6 if r.form in ORDERS else 1)


def test_cuts_and_bounds():
    import numpy as np

    assert cut([(0, 10, 4), (1, 0, 3)], 5) == [(0, 10, 4), (1, 0, 1), (1, 1, 2)]
    assert cut([(0, 0, 2)], 0) == [(0, 0, 0), (0, 0, 2)] and cut([(0, 0, 2)], 2) == [(0, 0, 2), (0, 2, 0)]
    with pytest.raises(IndexError):
        cut([(0, 0, 2)], 3)
    for text in ODD:
        data = np.frombuffer((text or "").encode(), np.uint8)
        for unit, units in (("line", re.findall(r"[^\n]*\n|[^\n]+", text or "")), ("char", list(text or ""))):
            at = bounds(data, unit)
            assert [bytes(data[a:z]).decode() for a, z in zip(at[:-1], at[1:], strict=True)] == units


def test_empty_and_wrong(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert restore(fill_in_middle(d)).count() == 0
    for bad in (Rule(unit="word"), Rule(sentinels=("<P>", "<P>", "<M>")), Rule(sentinels=("a", "ab", "c")), Rule(sentinels=("", "x", "y"))):
        with pytest.raises(ValueError):
            fill_in_middle(d, bad)
