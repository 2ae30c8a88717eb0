import random
import re

import numpy as np

from regionframe.llm import neardup
from regionframe.llm.neardup import labelled, matched, near_duplicates, shingles, similarity, without_near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, stay_id int"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_is_the_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a = [r.randint(0, 12) for _ in range(r.randint(1, 40))]
        b = [x if r.random() < 0.85 else r.randint(0, 12) for x in a for _ in range(r.choice([1, 1, 1, 1, 0, 2]))]
        want = lcs(a, b)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        for least in (0, want - 1, want):
            if least >= 0:
                assert matched(x, y, least) == want
        assert matched(x, y, want + 1) < want + 1
        t = len(a) + len(b)
        s = want / (t - want)
        assert similarity(x, y) == (s if s >= 0.8 else 0)


def test_parities_never_part_similar_texts():
    """Bits differ in no more places than the texts have labels of one of them alone, however often a shingle comes."""
    r, apart = random.Random(8), 0
    for _ in range(400):
        a = [r.randint(0, 150) for _ in range(r.randint(1, 300))]
        b = [x if r.random() < r.choice([0.5, 0.9, 0.97]) else r.randint(0, 150) for x in a]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        differ = sum(int(v).bit_count() for v in (neardup.parities(x) ^ neardup.parities(y)).view(np.uint64))
        assert differ <= len(set(labelled(x).tolist()) ^ set(labelled(y).tolist()))
        least = int(np.ceil((len(a) + len(b)) * 0.8 / 1.8 - 1e-9))
        if similarity(x.astype(np.uint32), y.astype(np.uint32)) >= 0.8:
            assert differ <= len(a) + len(b) - 2 * least
        else:
            apart += differ > len(a) + len(b) - 2 * least
    assert apart > 50


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        base = [word() for _ in range(r.randint(30, 250))]
        if r.random() < 0.4:
            base[10:10] = passage
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 4])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 60))):
                t[r.randrange(len(t))] = word()
            texts.append(t)
    rows = [" ".join(t) for t in texts]
    rows += [rows[0].upper() + "!", rows[0], rows[1], rows[1], None, "", "  ", "...", "one two", "One, two.", "one two three", "x " * 400, "x " * 401]
    rows += ["x " * 3000]
    r.shuffle(rows)
    return [(i, t, "en", "s", 1, "clash", 3) for i, t in enumerate(rows)]


def brute(rows):
    sh = [shingles(t or "").astype(np.uint32).tolist() for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sh[i] and sh[j]:
                n = len(sh[i]) + len(sh[j])
                same = min(len(sh[i]), len(sh[j])) / max(len(sh[i]), len(sh[j])) >= 0.8 and (m := lcs(sh[i], sh[j])) / (n - m) >= 0.8
            else:
                same = (rows[i][1] or "") == (rows[j][1] or "")
            if same:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [rows[root(i)][0] for i in range(len(rows))]


def test_classes_against_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = near_duplicates(d).collect()
    least = {}
    for r in got:
        least[bytes(r.class_node)] = min(r.doc_id, least.get(bytes(r.class_node), r.doc_id))
    want = {k: c for (k, *_), c in zip(rows, brute(rows), strict=True)}
    assert {r.doc_id: least[bytes(r.class_node)] for r in got} == want
    kept = without_near_duplicates(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    # links are between different texts: none where a class has one, enough to connect it where it has more
    words = {k: tuple(neardup.WORD.findall((t or "").lower())) or (t or "",) for k, t, *_ in rows}
    links = {}
    for r in got:
        assert links.setdefault(want[r.doc_id], {}).setdefault(words[r.doc_id], r.links) == r.links
    for of in links.values():
        assert all(min(1, len(of) - 1) <= n < len(of) for n in of.values()) and sum(of.values()) >= 2 * (len(of) - 1) and sum(of.values()) % 2 == 0
    assert max(len(of) for of in links.values()) > 3


def test_near_copies_among_pages_of_one_template(spark):
    """Pages share most of their shingles without being similar, so that buckets are full of strangers; copies among them
    are similar by little."""
    r = random.Random(5)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    template, texts = words(200), []
    for i in range(160):
        own = words(36)
        texts.append(template + own)
        if i % 4 == 0:
            texts.append(template + own[: r.randint(12, 15)] + words(r.randint(20, 23)))
    r.shuffle(texts)
    sh = [shingles(" ".join(t)).astype(np.uint32) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(sh)):
        for j in range(i):
            if similarity(sh[i], sh[j]) >= 0.8:
                up[i] = min(up[i], up[j])
    assert 30 < sum(k != i for i, k in enumerate(up)) <= 40
    d = spark.createDataFrame([(i, " ".join(t), "en", "s", 1, "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    least = {}
    got = near_duplicates(d).collect()
    for x in got:
        least[bytes(x.class_node)] = min(x.doc_id, least.get(bytes(x.class_node), x.doc_id))
    assert {x.doc_id: least[bytes(x.class_node)] for x in got} == dict(enumerate(up))


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f", "en", "s", 1, "", 0)] * 2 + [(1, "g h i j k l", "en", "s", 1, "", 0), (None, "a b c d e f", None, None, None, None, None), (None, None, None, None, None, None, None), (2, "", "", "", 0, "", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    kept = without_near_duplicates(d).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", "g h i j k l"), ("None", "None"), ("None", "a b c d e f")]
    assert near_duplicates(d.limit(0)).count() == 0 and without_near_duplicates(d.limit(0)).count() == 0


def test_words_only():
    assert (shingles("One two, three four FIVE six") == shingles("one two three four five six")).all() and len(shingles("")) == 0 and len(shingles("a b")) == 1
    assert re.fullmatch(r"\w+", "é") and len(neardup.sketches(shingles("a"))) == neardup.SKETCHES
