"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles, each labelled with its occurrence. A sketch takes the few labelled
shingles that are least under one of several hash orders and keeps them in text order, so two texts share a sketch when
they agree on those shingles and on their order. Documents that share a sketch are candidates; the similarity that
decides is the share of shingles that an alignment within the band matches: m / (n1 + n2 - m), 0.8 or more.

Copies with the same words are one node from the start. A bucket of equal sketches is a star around its most central node,
never all its pairs: the one that shares sketches with the most others, such as the text that many were made from. Where
buckets still hold several classes after the stars are verified, each takes another centre, by an order of its own, and the members of
other classes than the centre's are verified against that. What is then left in buckets of several classes is joined
exactly: an alignment matches at most the labelled shingles that both texts have, so two similar texts share one of their
rarest (prefix filter), and each such pair of different classes is verified. No pair is verified whose parities of labels
differ in more places than similar texts can. Everything is joined and counted by keys; no
group but a text's own shingles is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionframe.llm.shared import Stages, staged, table, text_of

WORD = re.compile(r"\w+")
SHINGLE, SKETCHES, LEAST, SIMILAR = 5, 16, 3, 0.8
SEEDS = np.random.default_rng(20).integers(1, 2**63, SKETCHES, dtype=np.uint64)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def shingles(text: str) -> np.ndarray:
    """Hashes of the runs of five words, letter case aside; of fewer words, one of them all; none without a word."""
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, WORD.findall(text.lower())), np.uint64)
    n = min(SHINGLE, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    return out


def labelled(h: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its occurrence."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    out = h.copy()
    if not first.all():
        out[order] = _mix(s + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return out


def sketches(h: np.ndarray) -> np.ndarray:
    """One value for each hash order: the LEAST least labelled shingles, in text order. Needs a shingle at least."""
    x, k = labelled(h), min(LEAST, len(h))
    rows = 1 if len(x) > 100_000 else SKETCHES
    out = []
    for at in range(0, SKETCHES, rows):
        seeds = SEEDS[at : at + rows]
        v = _mix(x[None, :] ^ seeds)
        least = np.sort(np.argpartition(v, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(k), (len(seeds), 1)), axis=1)
        s = seeds[:, 0].copy()
        for j in range(k):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + x[least[:, j]])
        out.append(s)
    return np.concatenate(out).view(np.int64)


SLIDE = 64  # symbols after which the bit vector moves on


def matched(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """The most shingles of a and b that align in order, if that is `least` or more, else less than that.

    An alignment that matches so many skips len(a) + len(b) - 2 * least at most, so its matches lie within that distance
    of the diagonal. Common ends are matched first; between them the alignment takes a symbol of b at a time, on a bit
    vector that holds the places of a within the band only and moves along with b: a zero is a match, and what the band
    has left behind is counted and dropped. Time grows with the length times the band, memory with either.
    """
    n = min(len(a), len(b))
    if n < least:
        return 0
    same = np.flatnonzero(a[:n] != b[:n])
    head = int(same[0]) if len(same) else n
    same = np.flatnonzero(a[len(a) - (n - head) :][::-1] != b[len(b) - (n - head) :][::-1])
    tail = int(same[0]) if len(same) else n - head
    a, b, ends = a[head : len(a) - tail], b[head : len(b) - tail], head + tail
    if not len(a) or not len(b) or ends + min(len(a), len(b)) < least:
        return ends
    band = len(a) + len(b) - 2 * max(0, least - ends)
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    lo, hi = np.searchsorted(ranked, b, "left"), np.searchsorted(ranked, b, "right")
    many, places = max(1024, len(a) // 256), {}  # a symbol that comes so often has its places in one integer
    width = 2 * band + 1 + SLIDE
    every, window = (1 << width) - 1, (1 << (2 * band + 1)) - 1
    v, base, found = every, -band, 0  # bit i stands for the place base + i of a
    meet = np.flatnonzero(hi > lo)
    for j, i, k in zip(meet.tolist(), lo[meet].tolist(), hi[meet].tolist(), strict=True):
        if (by := j - band - base) >= SLIDE:
            left = min(by, width)
            found += left - (v & ((1 << left) - 1)).bit_count()
            v = v >> left | every ^ every >> left
            base += by
        if k - i > many:
            if i not in places:
                places[i] = _bits(order[i:k])
            m = (places[i] >> base if base >= 0 else places[i] << -base) & window << (j - band - base)
        else:
            at = order[i:k]
            if k - i > 1:
                at = at[np.searchsorted(at, j - band) : np.searchsorted(at, j + band + 1)]
            m = 0
            if len(at) <= 8:
                for p in at.tolist():
                    if -band <= p - j <= band:
                        m |= 1 << (p - base)
            else:
                m = _bits(at - base)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & every
    return ends + found + width - v.bit_count()


def _bits(places: np.ndarray) -> int:
    """An integer with these bits set; places ascend."""
    bits = np.zeros(int(places[-1]) + 1, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def similarity(a: np.ndarray, b: np.ndarray, limit: float = SIMILAR) -> float:
    """Aligned shingles over all of both, exact from the limit on; 0 below what cannot reach it."""
    total = len(a) + len(b)
    least = int(np.ceil(limit * total / (1 + limit) - 1e-9))
    m = matched(a, b, least)
    return m / (total - m) if total and m >= least else 0.0


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, sk = [], []
        for t in b["text"]:
            text = t.as_py()
            h = shingles(text)
            nodes.append(xxhash.xxh3_128_digest(h.tobytes() if len(h) else b"\0" + text.encode()))
            sk.append(sketches(h) if len(h) else None)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["version"], pa.array(nodes, pa.binary()), pa.array(sk, pa.list_(pa.int64()))], names=["doc_id", "version", "node", "sketches"])


BITS = ["b0", "b1", "b2", "b3"]
ROWS = "node binary, shingles binary, n int, b0 long, b1 long, b2 long, b3 long"


def parities(h: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of how many labelled shingles it stands for: labels that two texts share cancel, so their
    bits differ in no more places than the texts have labels of one of them alone."""
    odd = np.bincount((labelled(h) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [shingles(t.as_py()).astype(np.uint32) for t in b["text"]]
        bits = np.array([parities(x.astype(np.uint64)) for x in got], np.int64).reshape(-1, len(BITS))
        columns = [b["node"], pa.array([x.tobytes() for x in got], pa.binary()), pa.array([len(x) for x in got], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, bits.T)], names=["node", "shingles", "n", *BITS])


def alike(one: str, two: str) -> Column:
    """Whether texts with these prefixes of n and BITS can be similar: those that are have at most n1 + n2 - 2 * least labels
    of one of them alone."""
    total = F.col(f"{one}n") + F.col(f"{two}n")
    apart = reduce(add, [F.bit_count(F.col(f"{one}{x}").bitwiseXOR(F.col(f"{two}{x}"))) for x in BITS])
    return apart <= total - 2 * F.ceil(total * (SIMILAR / (1 + SIMILAR)) - 1e-9)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [similarity(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) >= SIMILAR for x, y in zip(b["one"], b["two"], strict=True)]
        if any(ok):
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(ok))


def verified(pairs: DataFrame, shingle_rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar."""
    two = pairs.join(shingle_rows.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
    both = two.join(shingle_rows.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
    return both.select("a", "b", "one", "two").mapInArrow(_verify, "a binary, b binary")


def screened(pairs: DataFrame, shingle_rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be similar by their lengths and parities, before any shingle is moved."""
    of = lambda k: shingle_rows.select(F.col("node").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("n", *BITS)])
    return pairs.join(of("a"), "a").join(of("b"), "b").where(alike("a_", "b_")).select("a", "b")


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for node, x in zip(b["node"], b["shingles"], strict=True):
            h = labelled(np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(h), pa.binary()), pa.array(np.full(len(h), len(h), np.int32)), pa.array(h.view(np.int64))], names=["node", "n", "label"])


def rare_pairs(nodes: DataFrame, shingle_rows: DataFrame, stage) -> DataFrame:
    """The pairs (a, b), a < b, of nodes (node, class) of different classes that can be similar, none left out.

    Similar texts of n1 <= n2 labelled shingles have least = SIMILAR / (1 + SIMILAR) * (n1 + n2) in common, so in any one
    order they share a label among the first n - least + 1 of each; the order is rarest first. A label at place p of n
    thus serves for partners of n2 <= (n - p + 1) * (1 + SIMILAR) / SIMILAR - n shingles, its reach. Labels of a single
    text come first and are never joined. Classes meet before their nodes do, so copies of one text make no pairs; nodes
    meet only if their parities allow it.
    """
    labels = stage(nodes.select("node").join(shingle_rows.select("node", "shingles"), "node").mapInArrow(_labels, "node binary, n int, label long"), "labels")
    often = stage(labels.groupBy("label").agg(F.count("*").alias("f")).where("f > 1"), "label-counts")
    own = Window.partitionBy("node")
    first = labels.join(often, "label").withColumns({"m": F.count("*").over(own), "nth": F.row_number().over(own.orderBy("f", "label"))}).withColumn("p", F.col("n") - F.col("m") + F.col("nth"))
    reach = (F.col("n") - F.col("p") + 1) * ((1 + SIMILAR) / SIMILAR) - F.col("n") + 1e-6
    first = first.withColumn("reach", reach).where(F.col("reach") >= F.col("n") * SIMILAR).join(nodes, "node")
    columns = ("class", "node", "n", "reach", *BITS)
    first = stage(first.select("label", "node", "class", "n", "reach").join(shingle_rows.select("node", *BITS), "node").select("label", *columns), "rare-labels")
    ends = {k: d.select("label", *[F.col(c).alias(f"{k}_{c}") for c in columns]) for k, d in (("s", first.where("reach >= n")), ("l", first))}

    def meet(k: str) -> DataFrame:
        of = {"lo": F.min(f"{k}_n"), "hi": F.max(f"{k}_n"), "far": F.max(f"{k}_reach"), "many": F.count("*")}
        return stage(ends[k].groupBy("label", f"{k}_class").agg(*[c.alias(f"{k}_{x}") for x, c in of.items()]), "label-classes")

    near = meet("s").join(meet("l"), "label").where("s_class <> l_class and s_far >= l_lo and l_far >= s_lo and s_lo <= l_hi")
    near = stage(near.select("label", "s_class", "l_class", F.expr("s_many <= l_many").alias("s_first")), "class-pairs")
    # the smaller class of two gives its nodes first, so that few rows look up the many of the larger one
    by_s = stage(near.where("s_first").join(ends["s"], ["label", "s_class"]), "first-ends").join(ends["l"], ["label", "l_class"])
    by_l = stage(near.where("not s_first").join(ends["l"], ["label", "l_class"]), "first-ends").join(ends["s"], ["label", "s_class"])
    similar = alike("s_", "l_") & F.expr("s_reach >= l_n and l_reach >= s_n and (s_n < l_n or s_n = l_n and s_node < l_node)")
    pairs = [d.where(similar).select(F.least("s_node", "l_node").alias("a"), F.greatest("s_node", "l_node").alias("b")) for d in (by_s, by_l)]
    return pairs[0].union(pairs[1]).distinct()


def classes(links: DataFrame, stage=staged) -> DataFrame:
    """(node, least): each linked node with the least node that links lead to. Labels sink along links, and each round
    every node also takes its label's label, so that long chains halve."""
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("near"))
        sunk = labels.join(near, "node").select("node", F.col("least").alias("was"), F.least("least", "near").alias("least"))
        up = labels.select(F.col("node").alias("least"), F.col("least").alias("above"))
        new = stage(sunk.join(up, "least", "left").select("node", "was", F.least("least", F.coalesce("above", "least")).alias("least")), "labels")
        labels = new.select("node", "least")
        if not new.where("was <> least").head(1):
            return labels


def merged(found: DataFrame, links: DataFrame, stage) -> DataFrame:
    """The classes (node, least) that further links make of those found: links meet as links between classes."""
    if not links.head(1):
        return found
    of = lambda k: found.select(F.col("node").alias(k), F.col("least").alias(f"{k}_class"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = stage(ends.select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")).where("a <> b").distinct(), "class-links")
    joined = classes(ends, stage)
    known = found.join(joined.select(F.col("node").alias("least"), F.col("least").alias("lower")), "least", "left").select("node", F.coalesce("lower", "least").alias("least"))
    # nodes that had no link before are classes of their own among the new ones
    return stage(known.union(joined.join(found, "node", "left_anti").select("node", "least")), "found-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, version, class_node, links) of each row; rows of one class have the same class_node. links counts the other
    texts that the row's text was found similar to: the pairs verified, which connect the classes, not every similar pair.

    Needs doc_id and text; other columns are left out. Texts with the same words in the same order are one class whatever
    their case, spacing and punctuation; texts without a word are, if they are equal, a null one counting as empty. Texts
    of fewer than five words are similar only if their words are the same. Classes are what chains of links connect.
    Repeated rows are in one class; an empty table gives no row.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version_of().alias("version"), text_of().alias("text"))
    stage = Stages(docs.sparkSession, "near-duplicates")
    marks = stage(d.mapInArrow(_marks, "doc_id long, version long, node binary, sketches array<long>"), "marks")
    nodes = marks.where("sketches is not null").groupBy("node").agg(F.first("sketches").alias("sketches"), F.min(F.struct("doc_id", "version")).alias("row"))
    nodes = stage(nodes, "nodes")
    members = nodes.select("node", F.posexplode("sketches").alias("order", "sketch"))
    key = ["order", "sketch"]
    # what is grouped is staged before it is joined back, so that the join reads plain exchanges and can split a hot bucket
    sizes = stage(members.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = stage(members.join(sizes, key).withColumnRenamed("node", "b"), "buckets")
    central = shared.groupBy("b").agg(F.sum("n").alias("others"))
    stars = stage(shared.select(*key, "b").join(central, "b").groupBy(*key).agg(F.min(F.struct(-F.col("others"), "b")).alias("c")).select(*key, F.col("c.b").alias("a")), "stars")
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = stage(shared.select(*key, "b").join(stars, key).where("a <> b").select(*ends).distinct(), "pairs")
    wanted = shared.select(F.col("b").alias("node")).distinct().join(nodes.select("node", "row.*"), "node")
    of = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.version") == F.col("w.version"))
    # rows that repeat a document's id and text give equal shingles: one of them is enough
    rows = d.alias("d").join(wanted.alias("w"), of).select("w.node", "d.text").mapInArrow(_shingle_rows, ROWS)
    rows = stage(rows.dropDuplicates(["node"]) if repeated(marks) else rows, "shingles")
    links = [stage(verified(stage(screened(pairs, rows), "screened"), rows), "links")]
    found = classes(links[0], stage)
    # Buckets that hold several classes: another centre, and the members of other classes against it
    own = shared.select(*key, "b").join(found.withColumnRenamed("node", "b"), "b", "left").select(*key, "b", F.coalesce("least", "b").alias("class"))
    order = F.xxhash64("order", "b")
    centre = own.groupBy(*key).agg(F.min(F.struct(order.alias("o"), "b", "class")).alias("c"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select(*key, F.col("c.b").alias("a"), F.col("c.class").alias("a_class"))
    centre = stage(centre, "centres")
    more = own.join(centre, key).where(F.col("class") != F.col("a_class")).select(*ends).distinct()
    more = stage(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    links.append(stage(verified(stage(screened(more, rows), "screened"), rows), "links"))
    found = merged(found, links[-1], stage)
    # Buckets that still do: their nodes of different classes by an exact join
    own = shared.select(*key, "b").join(found.withColumnRenamed("node", "b"), "b", "left").select(*key, F.col("b").alias("node"), F.coalesce("least", "b").alias("class"))
    several = stage(own.groupBy(*key).agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select(*key), "several")
    left = stage(own.join(several, key).select("node", "class").distinct(), "left")
    if left.head(1):
        rest = stage(rare_pairs(left, rows, stage).join(pairs.union(more), ["a", "b"], "left_anti"), "pairs")
        links.append(stage(verified(rest, rows), "links"))
        found = merged(found, links[-1], stage)
    ends_of = [d.select(F.col(c).alias("node")) for d in links for c in "ab"]
    found = stage(found.join(reduce(DataFrame.union, ends_of).groupBy("node").agg(F.count("*").alias("links")), "node"), "found")
    stage.drop("nodes", "sizes", "buckets", "stars", "pairs", "shingles", "links", "centres", "several", "left", "labels", "label-counts", "rare-labels", "label-classes", "class-pairs", "first-ends", "screened")
    return marks.select("doc_id", "version", "node").join(found, "node", "left").select("doc_id", "version", F.coalesce("least", "node").alias("class_node"), F.coalesce("links", F.lit(0)).alias("links"))


def version_of():
    """Tells apart rows that share a doc_id but not the text, and a null doc_id from every other."""
    return F.xxhash64(F.col("doc_id").isNull(), text_of())


def repeated(marks: DataFrame) -> bool:
    """Whether any doc_id and text come more than once."""
    return bool(marks.groupBy("doc_id", "version").agg(F.count("*").alias("n")).where("n > 1").head(1))


def op4_neardup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, class_size, n_links): class_id is the least doc_id of the document's class, n_links its text's verified
    links to other texts; cases as in near_duplicates()."""
    found = staged(near_duplicates(table(spark, sf_dir, "documents")), "classes")
    ids = staged(found.groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "class-ids")
    return found.join(ids, "class_node").select("doc_id", "class_id", "class_size", F.col("links").alias("n_links"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, with their columns: of each class the one with the least doc_id stays (null ids first), one row."""
    found = near_duplicates(docs)
    stay = found.groupBy("class_node").agg(F.min(F.struct("doc_id", "version")).alias("one")).select(_known("one.doc_id").alias("stay_id"), F.col("one.version").alias("stay_version"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _known("doc_id").alias("stay_id"), version_of().alias("stay_version"))
    kept = d.join(stay, ["stay_id", "stay_version"])
    nth = F.row_number().over(Window.partitionBy("stay_id", "stay_version").orderBy("stay_version"))
    return kept.withColumn("nth", nth).where("nth = 1").select("row.*")


def _known(c: str):
    return F.coalesce(F.col(c).cast("long"), F.lit(0))  # version_of() tells a null one apart
