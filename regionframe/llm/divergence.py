"""Source divergence audit by chunk factorization.

Chunks between ASCII white space are counted in each document and added up over a batch of documents; one shuffle brings the
counts of a chunk together, where each globally distinct chunk is tokenized once and its terms are joined to its counts;
occurrences and distinct documents are then aggregated by term. Documents meet a term only where that is open: a chunk
found in `least` documents or more proves its terms, rarer chunks list their documents, and these are counted for the
terms that no chunk proves.

What is shuffled is counts by (lang, source, chunk), never a row a document and term. A hot source, language or chunk is
added up before every shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionframe.llm.shared import Stages, table, text_of

TEXT_BYTES = 32 << 20  # of the texts that are counted together, about; a longer one by itself
CELLS = 1_000_000  # of a block of terms by sources
SCALE = 1_000_000_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("chunk", pa.string()), ("occurrences", pa.int64()), ("docs", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
_COUNTS_SQL = "lang string, source string, chunk string, occurrences long, docs int, low long, high long"
_TERMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int32()), ("sure", pa.bool_()), ("low", pa.int64()), ("high", pa.int64())])
_TERMS_SQL = "lang string, source string, term string, count long, docs int, sure boolean, low long, high long"


def slices(b: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of a text column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, end - at)
        at = end


def counted(b: pa.RecordBatch, first_row: int, least: int) -> pa.RecordBatch:
    """The counts (_COUNTS) of a batch (lang, source, text) whose rows are numbered from first_row on."""
    groups = [pa.DictionaryArray.from_arrays(*_codes(b.column(c))) for c in ("lang", "source")]
    group = groups[0].indices.to_numpy().astype(np.int64) * len(groups[1].dictionary) + groups[1].indices.to_numpy()
    names, group = np.unique(group, return_inverse=True)
    lists = pc.ascii_split_whitespace(b.column("text"))
    doc, chunks = pc.list_parent_indices(lists).to_numpy().astype(np.int64), lists.flatten()
    some = pc.not_equal(chunks, "")
    doc, chunks = doc[some.to_numpy(zero_copy_only=False)], chunks.filter(some).dictionary_encode()
    size = max(1, len(chunks.dictionary))
    # a document's chunks, then the chunks of a group: documents ascend within, so the first and the last are its ends
    pair, times = np.unique(doc * size + chunks.indices.to_numpy(), return_counts=True)
    doc, code = pair // size, pair % size
    key = code * len(names) + group[doc]
    order = np.argsort(key, kind="stable")
    key, doc, times = key[order], doc[order], times[order]
    start = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.r_[start, len(key)])
    occurrences = np.add.reduceat(times, start) if len(start) else np.zeros(0, np.int64)
    last = start + many - 1
    code, at = key[start] // len(names), key[start] % len(names)
    # the groups themselves, which may have no chunk
    at, none = np.r_[at, np.arange(len(names))], np.zeros(len(names), np.int64)
    chunk = pa.concat_arrays([chunks.dictionary.take(pa.array(code)), pa.array([""] * len(names), pa.string())])
    listed = np.r_[(many < least), none > 0]
    two = np.r_[(many > 1) & (many < least), none > 0]
    low, high = (pa.array(np.r_[doc[x] + first_row, none], mask=~of) for x, of in ((start, listed), (last, two)))
    lang, source = names[at] // len(groups[1].dictionary), names[at] % len(groups[1].dictionary)
    return pa.record_batch([groups[0].dictionary.take(pa.array(lang)), groups[1].dictionary.take(pa.array(source)), chunk, pa.array(np.r_[occurrences, none]), pa.array(np.minimum(np.r_[many, none], least).astype(np.int32)), low, high], schema=_COUNTS)


def _codes(a: pa.Array) -> tuple[pa.Array, pa.Array]:
    d = a.dictionary_encode()
    return d.indices, d.dictionary


def _count(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for part in slices(b, "text", TEXT_BYTES):
                made = counted(part, row, least)
                row += part.num_rows
                for at in range(0, made.num_rows, 100_000):
                    yield made.slice(at, 100_000)

    return run


def chunk_counts(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, source, chunk, occurrences, docs, low, high): what was counted in some documents, several rows a chunk; docs ends at
    `least`, and fewer documents than that are listed, being two at most: low and, if there are two, high. Every (lang, source) has the empty
    chunk, which counts nothing."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), text_of().alias("text")).mapInArrow(_count(least), _COUNTS_SQL)


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by term instead of by chunk; a chunk's rows follow each other, so each is tokenized once. The empty chunk's term is
    the empty one, which no other chunk has."""
    find, lower = re.compile(TERM).findall, {c: c + 32 for c in range(65, 91)}
    chunk, terms = None, []
    for b in batches:
        row, term, times = [], [], []
        for n, c in enumerate(b.column("chunk").to_pylist()):
            if c != chunk:
                found = [""] if not c else [x if x.islower() and x.isascii() else x.translate(lower) for x in find(c)]
                chunk, terms = c, [(found[0], 1)] if len(found) == 1 else list(Counter(found).items())
            for t, k in terms:
                row.append(n)
                term.append(t)
                times.append(k)
        at = pa.array(row, pa.int64())
        of = lambda c: b.column(c).take(at)  # noqa: E731, B023
        count = pc.multiply(of("occurrences"), pa.array(times, pa.int64()))
        yield pa.record_batch([of("lang"), of("source"), pa.array(term, pa.string()), count, of("docs"), of("sure"), of("low"), of("high")], schema=_TERMS)


def term_counts(counts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, count, docs, sure, low, high) of each chunk's terms: sure where `least` documents of the language have
    the chunk; docs, low and high as in chunk_counts()."""
    each = counts.repartition("chunk").groupBy("chunk", "lang", "source")
    each = each.agg(F.sum("occurrences").alias("occurrences"), F.least(F.sum("docs"), F.lit(least)).cast("int").alias("docs"), F.min("low").alias("low"), F.max(F.coalesce("high", "low")).alias("high"))
    sure = F.sum("docs").over(Window.partitionBy("chunk", "lang")) >= least
    listed = {"low": F.when(~F.col("sure"), F.col("low")), "high": F.when(~F.col("sure") & (F.col("high") > F.col("low")), F.col("high"))}
    return each.withColumn("sure", sure).withColumns(listed).mapInArrow(_tokenize, _TERMS_SQL)


def kept_terms(terms: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """(lang, term, lang_count) of the terms in at least `least` documents of a language."""
    open_ = totals.where((~F.col("sure")) & (F.col("docs") >= least)).select("lang", "term")
    rows = terms.where("not sure").join(open_, ["lang", "term"], "left_semi").select("lang", "term", F.explode(F.array("low", "high")).alias("row")).where("row is not null")
    proved = rows.groupBy("lang", "term", "row").agg(F.lit(1).alias("one")).groupBy("lang", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    all_ = totals.join(proved.select("lang", "term", F.lit(True).alias("proved")), ["lang", "term"], "left")
    return all_.where(F.col("sure") | F.col("proved")).select("lang", "term", "lang_count")


def _div(a: Column, b: Column) -> Column:
    """Integral division, exact for decimals and longs."""
    return F.call_function("div", a, b)


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + _div((wide(count) + wide(F.lit(1))) * F.lit(SCALE).cast("decimal(10,0)"), wide(n) + wide(v))


def _pair_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """(lang, source, item, value): of one block of a language's terms, every ordered pair's sum of floor((p - q)^2 / q).
    left: (source, term, p) of counts above 0; right: every source with p of the count 0."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not left.num_rows:
        return schema.empty_table()
    sources = right.column("source").to_pylist()
    place = {s: n for n, s in enumerate(sources)}
    terms = pa.concat_arrays(left.column("term").chunks).dictionary_encode()
    p = np.tile(right.column("p").to_numpy().astype(np.int64), (len(terms.dictionary), 1))
    p[terms.indices.to_numpy(), [place[s] for s in left.column("source").to_pylist()]] = left.column("p").to_numpy()
    sums = np.empty((len(sources), len(sources)), np.int64)
    for other in range(len(sources)):
        q = p[:, other : other + 1]
        d = p - q
        sums[:, other] = (d * d // q).sum(0)
    a, z = np.nonzero(~np.eye(len(sources), dtype=bool))
    names = pa.array(sources, pa.string())
    lang = left.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(z)), pa.array(sums[a, z])], schema=schema)


def divergence(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of a language differ in their use of its terms.

    docs: (text, lang, source); nulls are the empty string. Terms are runs of ASCII letters and of characters above U+007F,
    A to Z in lower case. A language keeps the terms that `least` (1 to 3) of its documents have; a row is a document, repeated rows
    are documents each, doc_id is not read. A group's share of a kept term is p = 1 + floor(10^9 (count + 1) / (N + V)); V
    counts the kept terms, N the group's occurrences of them; all integers, exactly. Part `pair` has for every two sources
    of a language the sum of floor((p - q)^2 / q) over its kept terms, 0 without one; part `term` the `most` terms of a
    group with the largest (p - q)^2 / q above the language's share q. Ranks go down by value, then up by item in UTF-8. A
    source that is alone in its language has no pair; an empty table gives no row; other columns are not read. A very long
    text or chunk is counted whole, in the memory of its task.
    """
    if not 1 <= least <= 3:
        raise ValueError("least is 1, 2 or 3: a chunk lists no more than two documents")
    stage = Stages(docs.sparkSession, "divergence")
    made = stage(term_counts(chunk_counts(docs, least), least), "terms")
    groups, terms = made.where("term = ''").select("lang", "source"), made.where("term <> ''")
    each = terms.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.least(F.sum("docs"), F.lit(least)).cast("int").alias("docs"), F.max("sure").alias("sure"))
    each = stage(each, "each")
    totals = stage(each.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs"), F.max("sure").alias("sure")), "totals")
    kept = stage(kept_terms(terms, totals, least), "kept")
    groups = stage(groups, "sources")
    stage.drop("terms", "totals")
    used = stage(each.select("lang", "source", "term", "count").join(kept, ["lang", "term"]), "used")
    stage.drop("each")

    sizes = used.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["n", "v"])
    groups = stage(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("sources"))
    known = stage(groups.join(langs, "lang"), "known")

    shares = used.join(known, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))
    value = _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    above = shares.withColumn("q", _share(F.col("lang_count"), F.col("lang_n"), F.col("v"))).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    best = ranked(above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))).where(F.col("rank") <= most)

    blocks = F.ceil(F.col("v") * F.col("sources") / F.lit(CELLS)).cast("int")
    left = shares.where("sources > 1").select("lang", F.pmod(F.xxhash64("term"), blocks.cast("long")).cast("int").alias("block"), "source", "term", "p")
    right = known.where("v > 0 and sources > 1").withColumn("p", _share(F.lit(0), F.col("n"), F.col("v")))
    right = right.select("lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "source", "p")
    sums = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return ranked(pairs).unionByName(best).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents' sources; nulls and odd cases as in divergence()."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select row_number() over () as doc, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term from t group by all having count(distinct doc) >= 3),
vs as (select lang, count(*) as v from kept group by all),
u as (select lang, source, term, count(*) as c from t join kept using (lang, term) group by all),
w as (select lang, term, sum(c) as c from u group by all),
g as (select d.lang, d.source, coalesce(max(n), 0) as n, coalesce(max(v), 0) as v from (select distinct lang, source from d) d left join (select lang, source, sum(c) as n from u group by all) using (lang, source) left join vs using (lang) group by all),
gn as (select lang, sum(n) as n, max(v) as v from g group by all),
p as (select g.lang, g.source, k.term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 1)) // (n + v) as p from g join kept k using (lang) left join u using (lang, source, term)),
q as (select w.lang, w.term, 1 + (1000000000::hugeint * (c + 1)) // (n + v) as q from w join gn using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b using (lang) left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source where a.source <> b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from p join q using (lang, term) where c > 0 and p > q),
r as (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank from x)
select * from r where part = 'pair' or rank <= 200"""
