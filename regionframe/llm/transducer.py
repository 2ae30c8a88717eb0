"""Token counts by a compiled transducer.

The tokenizer is compiled into one deterministic transducer over symbols (a UTF-8 byte; a first byte carries its
character's class). Its state is the cutting rule's place in a word, and for the open word every start of a token that
may still be going on: the place in the tokens' trie, the token before it, and the tokens counted up to there against
those of the whole prefix. A transition adds to the count what one more byte changes in the number of tokens, and a word's end
adds what its final form changes. Such a state knows all later counts, because a token ends a prefix's encoding exactly
where it and the token before it, encoded together, stay the two. Tokens before that allow the same continuations are one.
States and transitions are compiled when first met and kept in an open hash table; beyond MOST_STATES all but the states
in use are dropped and compiled anew, within a text too.

Texts run as chunks of fixed length, all at once, one symbol a step. A chunk's map says, for each state that is live at
its boundary, the state it leaves and the tokens it counts. Where a chunk has white space or a digit, no state survives
it: its map is constant from there on, and only its head runs from the live states. Any other chunk runs from a fresh
start first; other live states run only until they fall into step with that, which a few tokens do. The maps are then
composed pairwise, in as many rounds as the logarithm of the number of chunks (a prefix scan).
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.llm.shared import table, text_of
from regionframe.llm.tokens import byte_level_alphabet, char_class, vocabulary

SPACE, CHUNK, MARK, BATCH, MOST_STATES = 0, 1024, 64, 8_000_000, 200_000
SMALL, MOST_PAIRS = 12, 1_000_000  # tokens below a node whose fits are told apart; remembered pairs
NO_WORD, FRESH = ("S", (), 0), ((0, -1, 0),)
#: What follows the apostrophe in the contractions that the tokenizer's file names.
SHORT = {"s", "t", "re", "ve", "m", "ll", "d"}


class Transducer:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.end = model["end_of_word_suffix"]
        back = {c: b for b, c in enumerate(byte_level_alphabet())}
        vocab = model["vocab"]
        special = {x.content for x in t.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        self.merges = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        # The trie over the tokens' bytes: edges, and at each node the token that may go on and the one that ends a word
        self.edges: dict[int, int] = {}
        self.inner, self.final, self.spelled = [-1], [-1], {}
        self.single: dict[tuple[int, bool], int] = {}
        for word, i in vocab.items():
            if word in special:
                continue
            ends = word.endswith(self.end) and len(word) > len(self.end)
            spelled = bytes(back[c] for c in (word[: -len(self.end)] if ends else word))
            self.spelled[i] = (spelled, ends)
            if len(spelled) == 1:
                self.single[spelled[0], ends] = i
        # Each token as it comes about from its own bytes: its two last parts and the rank of their merge
        self.halves: dict[int, tuple[int, int, int]] = {}
        whole = {i for i, (spelled, ends) in self.spelled.items() if self.comes_about(i, spelled, ends)}
        self.lefts, self.rights = {}, {}
        self.stays: dict[int, bool] = {}
        below: list[list[int]] = [[]]
        for i in sorted(whole):
            node, path = 0, []
            for b in self.spelled[i][0]:
                if (node << 8 | b) not in self.edges:
                    self.edges[node << 8 | b] = len(self.inner)
                    self.inner.append(-1)
                    self.final.append(-1)
                    below.append([])
                path.append(node)
                node = self.edges[node << 8 | b]
            (self.final if self.spelled[i][1] else self.inner)[node] = i
            for n in path[1:]:
                if len(below[n]) <= SMALL:
                    below[n].append(i)
        #: The tokens that end below a node, where they are few
        self.few = {n: x for n, x in enumerate(below) if n and 0 < len(x) <= SMALL}
        self.alike: dict[tuple[int, int], int] = {}
        self.first_alike: dict[tuple[int, int], int] = {}
        self.grows = {k >> 8 for k in self.edges}
        self.kinds = np.full(0x110000, 255, np.uint8)  # by code point: place in "LNOS"; 255 is not asked yet
        self.learn_kinds(np.arange(128))
        ascii_kind = self.kinds[:128]
        self.ascii = np.where(ascii_kind == 3, SPACE, np.arange(128) + 1).astype(np.uint16)
        self.syncs = np.zeros(512, bool)
        self.syncs[SPACE] = True
        self.syncs[[1 + b for b in range(128) if ascii_kind[b] == 1]] = True
        self.reset()

    # What the tokenizer does, and when two tokens side by side stay so

    def comes_about(self, token: int, spelled: bytes, ends: bool) -> bool:
        """Whether the token is what its own bytes merge into; notes its halves."""
        ids = [self.single[b, False] for b in spelled]
        if ends:
            ids[-1] = self.single[spelled[-1], True]
        last = None
        while len(ids) > 1:
            rank, at = min((self.merges.get(p, (1 << 30, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 30:
                return False
            last = (ids[at], ids[at + 1], rank)
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        if last:
            self.halves[token] = last
        return ids == [token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that stood at the token's left (0) or right (1) edge as it came about, with the rank at which each was
        merged into the next one; the token itself last, never merged."""
        kept = (self.lefts, self.rights)[side]
        if token not in kept:
            out, part, until = [], token, 1 << 30
            while True:
                out.append((part, until))
                if part not in self.halves:
                    break
                until, part = self.halves[part][2], self.halves[part][side]
            kept[token] = out[::-1]
        return kept[token]

    def together(self, before: int, token: int) -> bool:
        """Whether the two, encoded together, stay the two: no part at the right edge of the one ever merges with a part at
        the left edge of the other while both stand there. Of equal ranks the pair further left merges first."""
        if before < 0:
            return True
        key = before << 20 | token
        if (known := self.stays.get(key)) is not None:
            return known
        if len(self.stays) > MOST_PAIRS:
            self.stays.clear()
        one, two, merges = self.edge(before, 1), self.edge(token, 0), self.merges
        i = j = 0
        ok = True
        while True:
            (a, a_until), (b, b_until) = one[i], two[j]
            if (m := merges.get((a, b))) and m[0] < a_until and m[0] <= b_until:
                ok = False
                break
            if a_until <= b_until:  # the part that is merged first gives way to the next one
                i += 1
                if i == len(one):
                    break
            else:
                j += 1
                if j == len(two):
                    break
        self.stays[key] = ok
        return ok

    def stand_in(self, node: int, before: int) -> int:
        """The first token met that allows the same tokens below the node as `before` does; -2 where it allows none."""
        key = (node, before)
        if (got := self.alike.get(key)) is None:
            if len(self.alike) > MOST_PAIRS:
                self.alike.clear()
                self.first_alike.clear()
            fits = sum(1 << i for i, t in enumerate(self.few[node]) if self.together(before, t))
            got = self.alike[key] = self.first_alike.setdefault((node, fits), before) if fits else -2
        return got

    def learn_kinds(self, points: np.ndarray) -> None:
        for p in np.unique(points):
            self.kinds[p] = "LNOS".index(char_class(self.tokenizer, chr(p)))

    # States, compiled when met. A word is (open starts, what its end adds); an open start is (node, token before, count)

    def grown(self, starts: tuple, byte: int) -> tuple[int, tuple, int]:
        """What one more byte adds to the word's count, the open starts after it, and what the word's end would add then."""
        token, count, ended, alive = -1, 0, None, []
        edges, inner, final, grows, few = self.edges, self.inner, self.final, self.grows, self.few
        for node, before, n in starts or FRESH:
            at = edges.get(node << 8 | byte)
            if at is None:
                continue
            if token < 0 and (t := inner[at]) >= 0 and self.together(before, t):
                token, count = t, n + 1
            if ended is None and (t := final[at]) >= 0 and self.together(before, t):
                ended = n + 1
            if at in grows:
                if at in few:
                    if (before := self.stand_in(at, before)) == -2:
                        continue
                alive.append((at, before, n))
        return count, (*[(a, b, n - count) for a, b, n in alive], (0, token, 0)), ended - count

    def step(self, state: tuple, symbol: int) -> tuple[int, tuple]:
        kind, starts, ending = state[:3]
        if symbol == SPACE:
            return (ending, NO_WORD) if kind != "'?" else (ending + state[3][1] + state[4], NO_WORD)
        byte = symbol - 1 if symbol <= 256 else 0xC0 + (symbol - 257) % 64
        cls = "C" if 129 <= symbol <= 192 else "LNO"[self.kinds[byte]] if symbol <= 128 else "LNO"[(symbol - 257) // 64]
        if kind == "'?":  # an apostrophe and one letter of a contraction of two
            if chr(byte) == state[5]:
                more, _, end = self.grown(self.grown(self.grown((), ord("'"))[1], ord(state[6]))[1], byte)
                first, a, _ = self.grown((), ord("'"))
                second, b, _ = self.grown(a, ord(state[6]))
                return second + more + end, NO_WORD
            # no contraction: the apostrophe was a word, the letter has begun the next one
            emit, after = self.step(("L", *state[3]), symbol)
            return ending + state[4] + emit, after
        if kind == "'" and cls == "L" and symbol <= 128:
            c = chr(byte)
            if c in SHORT:
                more, _, end = self.grown(starts, byte)
                return more + end, NO_WORD
            for s in SHORT:
                if len(s) == 2 and s[0] == c:
                    more, after, end = self.grown((), byte)
                    return 0, ("'?", starts, ending, (after, end), more, s[1], c)
        if cls == "C" or cls == kind != "N" or (kind == "'" and cls == "O"):
            more, after, end = self.grown(starts, byte)
            return more, ("O" if kind == "'" else kind, after, end)
        more, after, end = self.grown((), byte)
        return ending + more, ("'" if byte == 0x27 and cls == "O" else cls, after, end)

    def reset(self) -> None:
        """Drops all transitions, and all states but those in the arrays of `held`, which get their new numbers."""
        live = [NO_WORD]
        if held := getattr(self, "held", []):
            used = np.unique(np.concatenate([np.zeros(1, np.int64), *[x.ravel() for x in held]]))
            live = [self.states[i] for i in used.tolist()]
            for x in held:
                x[...] = np.searchsorted(used, x)
        self.held = held
        self.numbers, self.states = {s: i for i, s in enumerate(live)}, live
        self.bits = 16
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        self.filled = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if (self.filled + len(keys)) * 2 > len(self.keys):
            old, was = self.keys[self.keys >= 0], self.values[self.keys >= 0]
            while (self.filled + len(keys)) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.filled = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
            self._insert(old, was)
        self.filled += len(keys)
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slots] < 0
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            put = first[free[first]]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slots = keys[left], values[left], slots[left] + 1 & mask

    def _compile(self, keys: np.ndarray) -> None:
        values = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            emit, after = self.step(self.states[key >> 9], key & 511)
            if (n := self.numbers.get(after)) is None:
                n = self.numbers[after] = len(self.states)
                self.states.append(after)
            values[i] = n << 12 | emit + 2048
        self._insert(keys, values)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        mask, slots = (1 << self.bits) - 1, self._slots(keys)
        found, out = self.keys[slots], self.values[slots]
        off = np.flatnonzero(found != keys)
        while len(off):
            lost = found[off] < 0
            if lost.any():
                self._compile(np.unique(keys[off[lost]]))
                out[off] = self._find(keys[off])
                return out
            slots[off] = slots[off] + 1 & mask
            found[off] = self.keys[slots[off]]
            out[off] = self.values[slots[off]]
            off = off[found[off] != keys[off]]
        return out

    def run(self, symbols: np.ndarray, first: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each lane [first, ends) from its state: tokens counted, state after."""
        order = np.argsort(first - ends, kind="stable")
        at, left, s = first[order], (ends - first)[order], states[order].astype(np.int64)
        counts, lanes = np.zeros(len(at), np.int64), len(at)
        self.held.append(s)
        for step in range(int(left.max(initial=0))):
            while lanes and left[lanes - 1] <= step:
                lanes = int(np.searchsorted(-left, -step, side="left"))
            if len(self.states) > MOST_STATES:
                self.reset()
            v = self._find(s[:lanes] << 9 | symbols[at[:lanes] + step])
            s[:lanes] = v >> 12
            counts[:lanes] += (v & 4095) - 2048
        self.held.pop()
        out_c, out_s = np.empty_like(counts), np.empty_like(s)
        out_c[order], out_s[order] = counts, s
        return out_c, out_s

    # Texts

    def symbols(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of UTF-8 bytes, and for each byte's place how many symbols come before it."""
        b = np.frombuffer(data, np.uint8)
        if data.isascii():
            return self.ascii[b], np.arange(len(b) + 1)
        out, keep = np.empty(len(b), np.uint16), np.ones(len(b), bool)
        low = b < 128
        out[low] = self.ascii[b[low]]
        tail = b & 0xC0 == 0x80
        out[tail] = b[tail].astype(np.uint16) + 1
        lead = np.flatnonzero(b >= 0xC0)
        first = b[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for j in (1, 2, 3):
            has = size > j
            point[has] = point[has] << 6 | b[lead[has] + j] & 0x3F
        kind = self.kinds[point]
        if (kind == 255).any():
            self.learn_kinds(point[kind == 255])
            kind = self.kinds[point]
        out[lead] = 257 + kind.astype(np.uint16) * 64 + (first - 0xC0).astype(np.uint16)
        white = kind == 3
        out[lead[white]] = SPACE
        for j in (1, 2, 3):
            keep[lead[white & (size > j)] + j] = False
        return out[keep], np.concatenate([[0], np.cumsum(keep)])

    def normal(self, text: str) -> str:
        """The text as the tokenizer's normaliser leaves it, white space aside."""
        if text.isascii() or max(text) < "\u0300" and "\u0130" not in text:
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        pieces, whose, counts = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.special and "<" in text and (hits := self.special.findall(text)):
                counts[i] += len(hits)
                parts = self.special.split(text)
            else:
                parts = [text]
            for p in parts:
                if p:
                    pieces.append(self.normal(p).encode())
                    whose.append(i)
        if not pieces:
            return counts
        symbols, before = self.symbols(b"".join(pieces))
        ends = before[np.cumsum([len(p) for p in pieces])]
        starts = np.concatenate([[0], ends[:-1]])
        n = np.maximum(1, -(-(ends - starts) // CHUNK))
        piece = np.repeat(np.arange(len(pieces)), n)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        a = starts[piece] + place * CHUNK
        total = self.composed(*self.maps(symbols, a, np.minimum(a + CHUNK, ends[piece]), place == 0), place == 0)
        np.add.at(counts, np.array(whose), total)
        self.held.clear()
        return counts

    def maps(self, symbols: np.ndarray, a: np.ndarray, b: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """The maps of the chunks [a, b), as rows (chunk, state entered, state left, tokens) for the states live at each
        chunk's boundary. A chunk that begins a piece is entered with no word; the end of a piece closes its word."""
        sync = np.append(np.flatnonzero(self.syncs[symbols]), len(symbols))
        cut = np.minimum(sync[np.searchsorted(sync, a)], b)  # where the chunk's map becomes constant
        constant, last = cut < b, np.append(begins[1:], True)
        total, leaves = self.run(symbols, cut, b, np.zeros(len(a), np.int64))
        self.held.append(leaves)
        # Chunks without such a place: a run from a fresh start, with its states and counts at every MARK symbols
        free = np.flatnonzero(~constant)
        steps = -(-CHUNK // MARK)
        marks = np.zeros((len(free), steps + 1), np.int64)
        so_far = np.zeros_like(marks)
        self.held.append(marks)
        for m in range(steps):
            lo, hi = np.minimum(a[free] + m * MARK, b[free]), np.minimum(a[free] + (m + 1) * MARK, b[free])
            c, marks[:, m + 1] = self.run(symbols, lo, hi, marks[:, m])
            so_far[:, m + 1] = so_far[:, m] + c
        of_free = np.full(len(a), -1)
        of_free[free] = np.arange(len(free))
        leaves[free] = marks[:, -1]
        # Rows: the fresh runs, and in rounds the states that are live at a boundary and have no row yet
        chunk, enters, exits, tokens = [free], [np.zeros(len(free), np.int64)], [leaves[free]], [so_far[:, -1].copy()]
        self.held += [enters[0], exits[0]]
        now, entry = np.flatnonzero(begins | np.concatenate([[False], constant[:-1]])), None
        entry = np.where(begins[now], 0, leaves[now - 1])
        more = free[~last[free]]
        now, entry = np.concatenate([now, more + 1]), np.concatenate([entry, leaves[more]])
        while len(now):
            keep = (of_free[now] < 0) | (entry != 0)  # a fresh start has its row
            now, entry = now[keep], entry[keep]
            self.held.append(entry)
            left, count = np.zeros(len(now), np.int64), np.zeros(len(now), np.int64)
            self.held.append(left)
            c = np.flatnonzero(constant[now])
            count[c], left[c] = self.run(symbols, a[now[c]], cut[now[c]], entry[c])
            closing = self.closed(left[c])[0]
            count[c] += closing + total[now[c]]
            left[c] = leaves[now[c]]
            f = np.flatnonzero(~constant[now])
            left[f] = entry[f]
            for m in range(steps):
                if not len(f):
                    break
                j = of_free[now[f]]
                more_count, left[f] = self.run(symbols, np.minimum(a[now[f]] + m * MARK, b[now[f]]), np.minimum(a[now[f]] + (m + 1) * MARK, b[now[f]]), left[f])
                count[f] += more_count
                met = left[f] == marks[j, m + 1]
                count[f[met]] += so_far[j[met], -1] - so_far[j[met], m + 1]
                left[f[met]] = marks[j[met], -1]
                f = f[~met]
            chunk.append(now)
            enters.append(entry)
            exits.append(left)
            tokens.append(count)
            new = ~constant[now] & ~last[now] & (left != leaves[now])
            now, entry = _distinct(now[new] + 1, left[new])
        chunk, tokens = np.concatenate(chunk), np.concatenate(tokens)
        closes = np.flatnonzero(last[chunk])
        tokens[closes] += self.closed(np.concatenate(exits)[closes])[0]
        return chunk, np.concatenate(enters), np.concatenate(exits), tokens

    @staticmethod
    def composed(chunk: np.ndarray, enters: np.ndarray, exits: np.ndarray, tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The tokens of each piece: every row is composed with the row of the next chunk that its exit enters, then with
        the one after both, and so on, twice as many chunks each round."""
        order = np.lexsort((enters, chunk))
        chunk, enters, exits, tokens = chunk[order], enters[order], exits[order], tokens[order].copy()
        base = int(max(enters.max(initial=0), exits.max(initial=0))) + 1
        keys, end = chunk * base + enters, len(chunk)
        goes = np.append(~np.append(begins[1:], True)[chunk], False)  # whether a chunk of the same piece follows
        following = np.full(end + 1, end)
        following[:end][goes[:end]] = np.searchsorted(keys, (chunk[goes[:end]] + 1) * base + exits[goes[:end]])
        tokens = np.append(tokens, 0)
        while (following < end).any():
            tokens = tokens + tokens[following]
            following = following[following]
        first = np.flatnonzero(begins)
        return tokens[np.searchsorted(keys, first * base)]

    def closed(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the end of the open word adds in each state."""
        v = self._find(states.astype(np.int64) << 9 | SPACE)
        return (v & 4095) - 2048, v >> 12


def _distinct(chunks: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack([chunks, states]), axis=1)
    return both[0], both[1]


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            texts, at = batch["text"], 0
            sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
            while at < len(texts):
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH)))
                counts = t.count(texts.slice(at, n).to_pylist())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), pa.array(sizes[at : at + n]), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])
                at += n

    return count


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row's whole text, without added special tokens; special strings inside a text
    count as the library takes them. Needs doc_id and text; other columns are left out. A null text is empty: no bytes,
    no tokens. Repeated rows are counted each; an empty table gives no row. Nothing is shuffled."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return d.mapInArrow(_counter(path or vocabulary("word_bpe_49k.json")), "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens; a null text has none, repeated rows are rows, an empty table gives none, a very long text is
    counted whole, by its chunks."""
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)
