import random
import re

from pyspark.sql import functions as F

from regionframe.llm import urls
from regionframe.llm.urls import FEATURES, RULES, judged, lexical

SCHEMA = "page_id long, url string, html string, host string, verdict int"


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S) if "://" in (url or "") else None
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    best = None
    for r, verdict in RULES:
        name, _, start = r.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(r) > len(best[0])):
            best = (r, verdict)
    return best


ODD = [
    None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://net/x", "http://a.net?x/", "http://x.example.net/en/1", "http://example.net/en", "http://myexample.net/en/", "http://a.example.com/de/?q#f",
    "http://example.com/DE/", "http://ÀÉ.org/fr/é", "x://y://z.net/", "http://u@a.net:80/", "http://a.org/fr/\nb", "https://a.org/fr/#/x", "?://b.net/c", "a b://c.net/d",
]


def pages(n=900, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        spam = r.random() < 0.4
        name = "".join(r.choice("abcdefgh") for _ in range(6))
        url = f"http://{'win-' if spam else ''}{name}{r.randint(10, 9999) if spam else ''}.{r.choice(['net' if spam else 'org', 'com'])}/{'fr' if not spam else 'x'}/{r.randint(1, 99)}{'?a=1&b=2' if spam else ''}"
        rows.append((1000 + i, url, "", "clash", 1))
    return rows


def test_rules_and_parts(spark):
    rows = [(i, u, "", "clash", 1) for i, u in enumerate(ODD)] + pages(300)
    got = {r.page_id: r for r in judged(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        host, path = parts(u)
        best = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0]), u
        assert got[i].verdict == (best[1] if best else "block" if got[i].p_block > 0.5 else "allow")


def test_trees_judge_what_no_rule_fits(spark):
    rows = pages()
    got = [(r.verdict == "block") == ("win-" in u) for r, (_, u, *_) in zip(sorted(judged(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.page_id), rows, strict=True) if r.rule is None]
    assert len(got) > 100 and sum(got) / len(got) > 0.95


def test_suffix_rates_are_of_all_labelled_urls(spark, monkeypatch):
    """The trees are fitted on a sample of different urls; the rates cover what the sample leaves out."""
    rows = pages(900) + [(5000 + i, "http://hot.net/x", "", "clash", 1) for i in range(400)]
    labels = [(u, rule(*parts(u))) for _, u, *_ in rows]
    labels = [(u, float(best[1] == "block")) for u, best in labels if best]
    prior, of = sum(y for _, y in labels) / len(labels), {}
    for u, y in labels:
        of.setdefault(".".join(parts(u)[0].split(".")[-2:]), []).append(y)
    frames, transform = [], urls.VectorAssembler.transform
    monkeypatch.setattr(urls.VectorAssembler, "transform", lambda self, df, *a: frames.append(df) or transform(self, df, *a))
    judged(spark.createDataFrame(rows, SCHEMA).repartition(3), max_train=100)
    train, every = (f.select("url", "domain_rate").collect() for f in frames)
    assert 0 < len(train) <= 100 and len(every) == len(rows)
    for r in train + every:
        y = of.get(".".join(parts(r.url)[0].split(".")[-2:]), [])
        assert abs(r.domain_rate - (sum(y) + 4 * prior) / (len(y) + 4)) < 1e-9, r.url


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, "http://a.com/", None, None, None), (1, "http://a.com/", None, None, None), (None, None, None, None, None)], SCHEMA)
    assert [r.verdict for r in judged(d).collect()] == ["allow"] * 3 and judged(d.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/", None, None, None), (2, "http://a.com/", None, None, None)], SCHEMA)
    assert {r.page_id: r.verdict for r in judged(one).collect()} == {1: "block", 2: "block"}
    f = lexical(d.withColumns({"host": F.lit(""), "path": F.lit("")})).select([c for c in FEATURES if "rate" not in c]).collect()
    assert all(x is not None for r in f for x in r)
