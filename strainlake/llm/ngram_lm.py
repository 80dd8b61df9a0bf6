"""Language-model scores from an Elias-Fano n-gram trie whose shards answer blocks of documents.

Documents are dealt to blocks. A block sends each shard its distinct words, word pairs and triples with their training
counts, split by the first word. A shard sums them, builds its trie (words, successors of each word, successors of
each pair, as Elias-Fano sequences with monotone pointers and 8-bit quantised smoothed probabilities) in memory-mapped
levels, and answers every block's n-grams by successor search within the range of their context. The blocks then score
their documents. Nothing that grows with the corpus is broadcast or collected: a task holds one block or one shard. A
shard serves several blocks' worth of text. A word that alone would outgrow a shard as a context is split by ranges of
its successors; which words are, a look at a few documents decides. It only moves work: the scores stay the same.

Model, order 3 with absolute discounting, all n-grams seen in training kept:
P(w|u,v) = max(c(uvw) - D, 0) / c(uv) + g(uv) P(w|v), P(w|v) = max(c(vw) - D, 0) / c(v) + g(v) P(w), where g is the mass
that is left; P(w) = (1 - P0) c(w) / N, and P0 = n1 / N (Good-Turing) is the probability of the one type of all unseen
words. A document's first word has the begin of the document as its only context.
"""

from __future__ import annotations

import mmap
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from strainlake.llm.common import release, written

DISCOUNT = 0.75
#: Text bytes of a block, and of the text whose n-grams a shard holds.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 10 << 20
#: Documents that are looked at for words to split; it decides on the layout only.
LOOKED_AT = 300
#: Words hold no white space, so these two stand for no word.
END, BEGIN = b"\n", b" "
#: Bits of a successor's hash that are kept below its context, a word or a pair. A pair has few successors, and where it
#: has many, one that is mistaken for another has next to no probability of its own.
LOW_BITS = 32
LOW_BITS_3 = 24
_LOW = np.uint64((1 << LOW_BITS) - 1)


class EliasFano:
    """A sorted sequence of n numbers: low bits packed, high bits in unary, with the place of every STEP-th number.

    Numbers are decoded STEP at a time, so that memory stays packed; get() and find() take sorted arrays.
    """

    STEP = 1 << 14

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.l, self.n, self.low, self.high, self.places = low_bits, n, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        width = min(56, max(0, (int(v[-1]) // max(1, n)).bit_length() - 1)) if n else 0
        low = np.zeros(8, np.uint8)
        if width and n:
            parts = []
            for i in range(0, n, 1 << 16):  # a multiple of 8 rows ends on a byte
                own = (v[i : i + (1 << 16), None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
                parts.append(np.packbits(own.astype(bool).ravel(), bitorder="little"))
            low = np.concatenate([*parts, low])
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, bool)
        bits[at] = True
        return cls(width, n, low, np.packbits(bits, bitorder="little"), at[:: cls.STEP])

    def size(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.places.nbytes

    def part(self, k: int) -> np.ndarray:
        """The numbers from k * STEP on, STEP of them at most."""
        begin, end = k * self.STEP, min(self.n, (k + 1) * self.STEP)
        at = int(self.places[k])
        to = int(self.places[k + 1]) if k + 1 < len(self.places) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at >> 3 : (to + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[at & 7 :])[: end - begin] + at
        i = np.arange(begin, end)
        out = (ones - i).astype(np.uint64) << np.uint64(self.l)
        if self.l:
            bit = i * self.l
            window = np.ascontiguousarray(self.low[(bit >> 3)[:, None] + np.arange(8)]).view("<u8")[:, 0]
            out |= (window >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the ascending places i."""
        out = np.zeros(len(i), np.uint64)
        cut = np.searchsorted(i, np.arange(0, self.n + self.STEP, self.STEP))
        for k in range(len(cut) - 1):
            a, b = cut[k], cut[k + 1]
            if a < b:
                out[a:b] = self.part(k)[i[a:b] - k * self.STEP]
        return out

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor search: index of the first number >= x[k] for ascending x, n if there is none, and if they are equal."""
        at, same = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        a = 0
        for k in range(len(self.places)):
            if a == len(x):
                break
            own = self.part(k)
            b = a + int(np.searchsorted(x[a:], own[-1], side="right"))
            j = np.searchsorted(own, x[a:b])
            at[a:b], same[a:b] = j + k * self.STEP, own[j] == x[a:b]
            a = b
        return at, same


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1 to 255 of equally wide steps and the mean of each step's values; code 0 is left for none."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    lo, hi = float(x.min()), float(x.max())
    code = np.minimum(254, ((x - lo) * (255 / (hi - lo))).astype(np.int64)) if hi > lo else np.zeros(len(x), np.int64)
    centre = np.bincount(code, weights=x, minlength=255) / np.maximum(1, np.bincount(code, minlength=255))
    book = np.zeros(256, np.float32)
    book[1 : len(centre) + 1] = centre
    return (code + 1).astype(np.uint8), book


class Level:
    """Successors of the contexts of the level above: keys (context << LOW_BITS | successor), each context's first one,
    and codes of log10 (c - D) / c(context); as contexts themselves, codes of log10 g."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, context_counts: np.ndarray):
        of = (keys >> np.uint64(LOW_BITS)).astype(np.int64)
        self.keys = EliasFano.of(keys)
        self.begin = EliasFano.of(np.searchsorted(of, np.arange(len(context_counts) + 1)))
        self.p, self.p_book = quantised(np.log10((counts - DISCOUNT) / context_counts[of]) if len(of) else np.zeros(0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each of the ascending keys, and if it is there within the range of its context."""
        if not self.keys.n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        context, code = np.unique(keys >> np.uint64(LOW_BITS), return_inverse=True)
        ends = self.begin.get(context.astype(np.int64) + 1).astype(np.int64)[code]
        at, same = self.keys.find(keys)
        same &= at < ends
        return np.where(same, at, 0), same


def _left(keys: np.ndarray, counts: np.ndarray, context_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of log10 of the mass that each context leaves to shorter ones."""
    of = (keys >> np.uint64(LOW_BITS)).astype(np.int64)
    mass = np.bincount(of, weights=counts - DISCOUNT, minlength=len(context_counts))
    return quantised(np.log10(1 - mass / np.maximum(1, context_counts)))


class Trie:
    """Words with counts, successors of words, successors of pairs; the levels lie in one anonymous memory map."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray):
        """words: sorted hashes; pairs, triples: sorted keys (place of the context << LOW_BITS | successor); counts > 0."""
        self.counts = counts.astype(np.uint32)
        self.words = EliasFano.of(words)
        self.two, self.three = Level(pairs, pair_counts, counts), Level(triples, triple_counts, pair_counts)
        self.g, self.g_book = _left(pairs, pair_counts, counts)
        self.g2, self.g2_book = _left(triples, triple_counts, pair_counts)

    def _levels(self) -> list[tuple[object, str]]:
        sequences = [self.words, self.two.keys, self.two.begin, self.three.keys, self.three.begin]
        return [(s, k) for s in sequences for k in ("low", "high", "places")] + [(self, "counts"), (self, "g"), (self, "g2"), (self.two, "p"), (self.three, "p")]

    def size(self) -> int:
        return sum(getattr(o, k).nbytes for o, k in self._levels())

    def mapped(self) -> Trie:
        """Moves the levels to a memory map, in which they stay packed."""
        arrays = [(o, k, getattr(o, k)) for o, k in self._levels()]
        held, at = mmap.mmap(-1, max(8, sum(-(-a.nbytes // 8) * 8 for *_, a in arrays))), 0
        for o, k, a in arrays:
            if a.nbytes:
                own = np.frombuffer(held, a.dtype, len(a), at)
                own[:] = a
                setattr(o, k, own)
            at += -(-a.nbytes // 8) * 8
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the words' places among these, and the number of words of each text."""
    import xxhash

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    flat, offs = parts.values, parts.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    at = coded.indices.to_numpy()
    real = np.ones(len(at), bool)
    if b"" in names:  # white space at the ends of a text
        real = at != names.index(b"")
    before = np.concatenate([[0], np.cumsum(real)])
    return hashes, at[real], np.diff(before[offs])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each given one, in half the memory of NumPy's own."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.zeros(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place


class Block:
    """The tokens of a block's documents and its distinct n-grams, in the order in which shards see them.

    A context word that is split counts as several: one for each of its ranges of successors.
    """

    def __init__(self, texts: pa.Array, split: dict[int, int]):
        import xxhash

        hashes, at, n = _tokenised(texts)
        end, begin = np.uint64(xxhash.xxh64_intdigest(END)), np.uint64(xxhash.xxh64_intdigest(BEGIN))
        # Each document is its begin, its words, its end; the begin is only a context.
        self.n = n + 1
        first = np.cumsum(self.n + 1) - self.n - 1
        tokens = np.full(int((self.n + 1).sum()), end, np.uint64)
        is_begin = np.zeros(len(tokens), bool)
        is_begin[first] = True
        is_word = ~is_begin
        is_word[first + self.n] = False
        tokens[is_begin] = begin
        tokens[is_word] = hashes[at]
        self.words, code = _distinct(tokens)
        del tokens, is_word, at
        context, self.token = code[:-1][~is_begin[1:]], code[~is_begin]
        self.begins = int(np.searchsorted(self.words, begin)) if len(n) else 0
        self.node_of_word = np.arange(len(self.words))
        self.nodes = self.words
        if split:
            self._split(context, split)
            context = self.context
        # Ascending by node and successor: shards see hashes in order.
        width = np.int64(max(1, len(self.words)))
        keys, self.pair = _distinct(context * width + self.token)
        del code, context
        self.pair_node, self.pair_token = np.divmod(keys, width)
        inner = np.ones(len(self.token), bool)
        inner[np.cumsum(self.n) - self.n] = False  # a document's first token has no context of two
        self.inner = np.flatnonzero(inner)
        keys, self.triple = _distinct(self.pair[self.inner - 1] * width + self.token[self.inner])
        self.triple_pair, self.triple_token = np.divmod(keys, width)

    def _split(self, context: np.ndarray, split: dict[int, int]) -> None:
        hot = np.asarray(sorted(split), np.uint64)
        parts = np.asarray([split[int(h)] for h in hot], np.uint64)
        at = np.minimum(np.searchsorted(hot, self.words), len(hot) - 1)
        is_hot = hot[at] == self.words
        own = self.words[context]
        on = is_hot[context]
        m = parts[at[context[on]]]
        own[on] = split_hash(own[on], ((self.words[self.token[on]] >> np.uint64(32)) * m) >> np.uint64(32))
        self.nodes, code = _distinct(np.concatenate([self.words, own]))
        self.node_of_word, self.context = code[: len(self.words)], code[len(self.words) :]

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of nodes (a word's occurrences, of the begin: documents), pairs and triples."""
        on = np.repeat(train, self.n)
        words = np.bincount(self.token[on], minlength=len(self.words))
        if len(train):
            words[self.begins] = int(train.sum())
        nodes = np.bincount(self.pair_node[self.pair[on]], minlength=len(self.nodes))
        nodes[self.node_of_word] = words
        pairs = np.bincount(self.pair[on], minlength=len(self.pair_node))
        return nodes, pairs, np.bincount(self.triple[on[self.inner]], minlength=len(self.triple_pair))

    def shard_of(self, shards: int) -> np.ndarray:
        """Shard of each node, ascending with its hash."""
        return (((self.nodes >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def split_hash(word: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The node of a split word's range of successors."""
    x = (word ^ (part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def split_words(docs: DataFrame, text: str, shards: int) -> dict[int, int]:
    """Hash -> number of ranges of the words that, as contexts, would fill half a shard or more: 2 * shards at most."""
    import xxhash

    if shards < 4:
        return {}
    some = docs.select(text).limit(LOOKED_AT).toArrow()  # of as few partitions as hold so many rows
    hashes, at, n = _tokenised(some.column(0))
    count = dict(zip(hashes.tolist(), np.bincount(at, minlength=len(hashes)).tolist(), strict=True))
    count[xxhash.xxh64_intdigest(BEGIN)] = int((n > 0).sum())
    total = max(1, sum(count.values()))
    return {h: -(-2 * shards * c // total) for h, c in count.items() if c * 2 * shards >= total}


_ASKED = "shard int, block int, nodes binary, counts binary, degree binary, next binary, next_counts binary, degree2 binary, next2 binary, next2_counts binary"
_ANSWER = "shard int, block int, counts binary, g binary, g_book binary, p binary, p_book binary, g2 binary, g2_book binary, p3 binary, p3_book binary, tokens long, types long, once long, bytes long, split binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _small(c: np.ndarray) -> bytes:
    """Counts that are mostly one: a bit for each one, then the others, a byte each where that is enough."""
    one = c == 1
    rest = c[~one]
    width = 1 if not len(rest) or rest.max() < 256 else 4
    return bytes([width]) + np.packbits(one).tobytes() + rest.astype(f"<u{width}").tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    one = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), 1), count=n).astype(bool)
    out = np.ones(n, np.uint32)
    out[~one] = np.frombuffer(raw, f"<u{raw[0]}", -1, 1 + -(-n // 8)) if len(raw) > 1 + -(-n // 8) else 0
    return out


def _asked(shards: int, split: dict[int, int]):
    def run(key, table):
        b = Block(table.column("t"), split)
        nodes, pairs, triples = b.counts(table.column("train").to_numpy())
        cut = np.searchsorted(b.shard_of(shards), np.arange(shards + 1))
        degree, degree2 = np.bincount(b.pair_node, minlength=len(b.nodes)), np.bincount(b.triple_pair, minlength=len(b.pair_node))
        at, at2 = np.concatenate([[0], np.cumsum(degree)]), np.concatenate([[0], np.cumsum(degree2)])
        short = (b.words >> np.uint64(64 - LOW_BITS)).astype(np.uint32)
        nexts, nexts2 = short[b.pair_token], short[b.triple_token]
        rows = []
        for s in range(shards):
            i, j = cut[s], cut[s + 1]
            if i < j:
                x, y = at[i], at[j]
                v, w = at2[x], at2[y]
                rows.append((s, key[0].as_py(), b.nodes[i:j].tobytes(), _small(nodes[i:j]), _small(degree[i:j]), nexts[x:y].tobytes(), _small(pairs[x:y]), _small(degree2[x:y]), _three_bytes(nexts2[v:w]), _small(triples[v:w])))
        cols = list(zip(*rows, strict=True)) or [()] * 10
        return pa.table([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(cols)], names=_names(_ASKED))

    return run


def _merged(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each given one, and the sums of their counts."""
    keys, place = _distinct(keys)
    return keys, place, np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def _three_bytes(x: np.ndarray) -> bytes:
    """The upper LOW_BITS_3 of hashes of LOW_BITS."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4)[:, 1:]).tobytes()


def _from_three(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.view("<u4")[:, 0]


def _below(context: np.ndarray, degree: list[np.ndarray], nexts: np.ndarray) -> np.ndarray:
    """Keys of the next level."""
    keys = np.repeat(context, np.concatenate(degree)).astype(np.uint64)
    keys <<= np.uint64(LOW_BITS)
    keys |= nexts
    return keys


def _trained(keys: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The keys seen in training, their contexts replaced by their ranks among the trained ones."""
    on = counts > 0
    return (rank[(keys[on] >> np.uint64(LOW_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(LOW_BITS)) | (keys[on] & _LOW)


def _told(level: Level, keys: np.ndarray, rank: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of p of the asked keys (0: none) and their places in the level."""
    of = (keys >> np.uint64(LOW_BITS)).astype(np.int64)
    on = np.flatnonzero(known[of])
    p, at = np.zeros(len(keys), np.uint8), np.full(len(keys), -1)
    place, same = level.find((rank[of[on]].astype(np.uint64) << np.uint64(LOW_BITS)) | (keys[on] & _LOW))
    on, place = on[same], place[same]
    p[on], at[on] = level.p[place], place
    return p, at


def _answered(begin: int, split_nodes: np.ndarray):
    def run(key, table):
        of = {k: table.column(k).to_pylist() for k in _names(_ASKED)[1:]}
        del table
        n_nodes, n_pairs = [len(x) // 8 for x in of["nodes"]], [len(x) // 4 for x in of["next"]]
        n_triples = [len(x) // 3 for x in of["next2"]]
        large = lambda k, sizes: [_large(x, n) for x, n in zip(of.pop(k), sizes, strict=True)]
        nodes, node, counts = _merged(np.frombuffer(b"".join(of.pop("nodes")), np.uint64), large("counts", n_nodes))
        pairs, pair, pair_counts = _merged(_below(node, large("degree", n_nodes), np.frombuffer(b"".join(of.pop("next")), np.uint32)), large("next_counts", n_pairs))
        triples, triple, triple_counts = _merged(_below(pair, large("degree2", n_pairs), _from_three(b"".join(of.pop("next2")))), large("next2_counts", n_triples))
        # The trie holds what was seen in training; contexts get their ranks among that.
        seen, seen2 = counts > 0, pair_counts > 0
        rank, rank2 = np.cumsum(seen) - 1, np.cumsum(seen2) - 1
        trie = Trie(nodes[seen], counts[seen], _trained(pairs, pair_counts, rank), pair_counts[seen2], _trained(triples, triple_counts, rank2), triple_counts[triple_counts > 0]).mapped()
        real = seen & (nodes != np.uint64(begin)) & ~np.isin(nodes, split_nodes)
        parts = np.flatnonzero(seen & np.isin(nodes, split_nodes))
        after = np.bincount((pairs[seen2] >> np.uint64(LOW_BITS)).astype(np.int64), minlength=len(nodes))
        stats = (int(counts[real].sum()), int(real.sum()), int((counts[real] == 1).sum()), trie.size())
        split = np.stack([nodes[parts], counts[parts].astype(np.uint64), after[parts].astype(np.uint64)], 1).tobytes()
        at, known = trie.words.find(nodes) if trie.words.n else (np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool))
        place = np.where(known, at, 0)
        c, g = (np.where(known, x[place] if len(x) else 0, 0).astype(x.dtype) for x in (trie.counts, trie.g))
        p, at = _told(trie.two, pairs, place, known)
        g2 = np.where(at >= 0, trie.g2[np.maximum(at, 0)] if len(trie.g2) else 0, 0).astype(np.uint8)
        p3, _ = _told(trie.three, triples, np.maximum(at, 0), at >= 0)
        out, i, j, k = [], 0, 0, 0
        books = [x.tobytes() for x in (trie.g_book, trie.two.p_book, trie.g2_book, trie.three.p_book)]
        for r, (block, x, y, z) in enumerate(zip(of["block"], n_nodes, n_pairs, n_triples, strict=True)):
            own, own2, own3 = node[i : i + x], pair[j : j + y], triple[k : k + z]
            i, j, k = i + x, j + y, k + z
            out.append((key[0].as_py(), block, _small(c[own]), g[own].tobytes(), books[0], p[own2].tobytes(), books[1], g2[own2].tobytes(), books[2], p3[own3].tobytes(), books[3], *((*stats, split) if r == 0 else (0, 0, 0, 0, b""))))
        kinds = [pa.int32()] * 2 + [pa.binary()] * 9 + [pa.int64()] * 4 + [pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(_ANSWER))

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(total: int, types: int, once: int, split: dict[int, int], whole: dict[int, tuple[float, float]]):
    """whole: node of a split word -> its share of the word's count, and the word's left mass."""

    def run(key, left, right):
        b = Block(left.column("t"), split)
        answers = right.sort_by("shard").to_pylist()

        def values(k: str, book: str, none: float) -> np.ndarray:
            parts = []
            for r in answers:
                table = 10.0 ** np.frombuffer(r[book], np.float32).astype(np.float64)
                table[0] = none
                parts.append(table[np.frombuffer(r[k], np.uint8)])
            return np.concatenate(parts)

        c = np.concatenate([_large(r["counts"], len(r["g"])) for r in answers]).astype(np.float64)
        g, g2 = values("g", "g_book", 1.0), values("g2", "g2_book", 1.0)  # a context that was not seen leaves all to shorter ones
        p, p3 = values("p", "p_book", 0.0), values("p3", "p3_book", 0.0)
        if whole:
            own = np.asarray(list(whole), np.uint64)
            at = np.minimum(np.searchsorted(b.nodes, own), len(b.nodes) - 1)
            on = np.flatnonzero(b.nodes[at] == own)
            share, mass = np.ones(len(b.nodes)), np.asarray(list(whole.values()), np.float64)
            share[at[on]], g[at[on]] = mass[on, 0], mass[on, 1]
            p = p * share[b.pair_node]
        c = c[b.node_of_word]
        base = np.log10((c + 0.1) / (total + 0.1 * (types + 1)))
        unseen = min(0.5, max(1, once) / max(1, total))
        one = np.where(c > 0, (1 - unseen) * c / max(1, total), unseen)
        two = p + g[b.pair_node] * one[b.pair_token]
        score = two[b.pair]
        score[b.inner] = p3[b.triple] + g2[b.triple_pair[b.triple]] * score[b.inner]
        at = np.cumsum(b.n) - b.n
        sums = [np.add.reduceat(x, at) for x in ((c[b.token] > 0).astype(np.int64), base[b.token], np.log10(score))]
        held = pa.array(~left.column("train").to_numpy())
        return pa.table([left.column("doc_id"), held, pa.array(b.n), pa.array(sums[0]), pa.array(np.full(len(b.n), total)), pa.array(sums[1]), pa.array(sums[2])], names=_names(_SCORES))

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: its one token is the end. A null id counts as not held out. Repeated rows each count and are
    each scored; other columns are ignored; an empty table gives no rows. The answers of the shards are written to
    the work folder together with the counts that all scores share.
    """
    import xxhash

    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, shards = max(1, -(-total // block_bytes)), max(1, -(-total // shard_bytes))
    split = split_words(docs, text, shards)
    nodes = {int(split_hash(np.asarray([h], np.uint64), np.asarray([k], np.uint64))[0]): h for h, m in split.items() for k in range(m)}
    d = docs.select(F.pmod(F.xxhash64(doc_id, F.octet_length(text)), F.lit(blocks)).cast("int").alias("block"), F.col(doc_id).cast("long").alias("doc_id"), (~held_out(F.col(doc_id))).alias("train"), F.col(text).alias("t"))
    asked = d.groupBy("block").applyInArrow(_asked(shards, split), _ASKED)
    answers = written(asked.groupBy("shard").applyInArrow(_answered(xxhash.xxh64_intdigest(BEGIN), np.asarray(sorted(nodes), np.uint64)), _ANSWER), "answers", compression="zstd")
    del asked
    release(docs.sparkSession)  # the documents and questions that were dealt for the first pass
    n, types, once = answers.agg(F.sum("tokens"), F.sum("types"), F.sum("once")).first()
    # As many rows as split words have ranges: about 4 * shards at most.
    told = [np.frombuffer(r["split"], np.uint64).reshape(-1, 3).tolist() for r in answers.where("octet_length(split) > 0").select("split").collect()]
    count = {node: (c, after) for rows in told for node, c, after in rows}
    sums: Counter = Counter()
    successors: Counter = Counter()
    for node, (c, after) in count.items():
        sums[nodes[node]] += c
        successors[nodes[node]] += after
    whole = {node: (count.get(node, (0, 0))[0] / sums[w], DISCOUNT * successors[w] / sums[w]) for node, w in nodes.items() if sums[w]}
    own = answers.select("shard", "block", "counts", "g", "g_book", "p", "p_book", "g2", "g2_book", "p3", "p3_book")
    return d.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_scored(n or 0, types or 0, once or 0, split, whole), _SCORES)
