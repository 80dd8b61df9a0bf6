"""BPE encoding and decoding by batched merge rounds, for vocabularies whose words end in a suffix.

Texts are cut at ASCII white space, which no unit of such a vocabulary crosses, and each distinct chunk of a batch is
looked up in a bounded table. The words of the chunks that are new go through the merges together: the symbols of all of
them lie in one flat array, the rank of each neighbouring pair is found by binary search over the sorted keys of the
merges, and each round merges, in every word at once, all places of that word's lowest-ranked pair. Only pairs next to a
merge are looked up again, and words without a pair left leave the array. A word of n symbols takes at most as many
rounds as it has distinct merges, so very long words stay far below n rounds.

Merging all places of a pair in one round gives what merging them one by one from the left gives, if every merge makes a
token of its own and uses none that a later one makes; vocabularies without that property are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strainlake.llm.common import slices

#: Chunks whose ids a Python worker keeps; when full, the table is begun anew.
KEPT_CHUNKS = 400_000
#: Chunks of more characters are encoded each time, so that the table's bytes are bounded too.
KEPT_CHARS = 200
#: Text bytes that are encoded at once.
SLICE_BYTES = 2 << 20
#: Rank of a pair that no merge joins.
NEVER = np.int32(np.iinfo(np.int32).max)
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Merges:
    """The merge table: apply(symbols, lengths) gives the tokens of many words."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray, n_tokens: int):
        """pairs (left, right) in order of rank and the tokens they make, all as ids below n_tokens."""
        rank = np.full(n_tokens, -1, np.int64)
        rank[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (rank[pairs] >= np.arange(len(pairs))[:, None]).any():
            raise ValueError("the vocabulary's merges make a token twice, or use one before it is made")
        self.n = n_tokens
        keys = pairs[:, 0].astype(np.int64) * n_tokens + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER where no merge joins it."""
        if not len(self.keys):
            return np.full(len(left), NEVER)
        want = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NEVER)

    def apply(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols of words end to end, each word at least one; their tokens end to end and the words' new lengths."""
        sym, word = symbols.astype(np.int32), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank = np.full(len(sym), NEVER)  # of the pair that begins here
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            over = least == NEVER
            if over.any():
                gone = np.repeat(over, size)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                sym, word, rank = sym[~gone], word[~gone], rank[~gone]
                least, size = least[~over], size[~over]
                if not len(sym):
                    break
            at = np.flatnonzero((rank == np.repeat(least, size)) & (rank != NEVER))
            # Places next to each other overlap (one symbol repeated): every second of such a run counts, from its left.
            run = np.r_[True, (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])]
            begin = np.flatnonzero(run)
            within = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
            at = at[within % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))  # as many symbols before each are gone
            look = np.r_[at - 1, at]
            look = look[look >= 0]
            inside = look[(look + 1 < len(sym))]
            inside = inside[word[inside] == word[inside + 1]]
            rank[look] = NEVER
            rank[inside] = self.rank(sym[inside], sym[inside + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_sym)[order], np.bincount(word, minlength=len(lengths))


class WordBpe:
    """encode(texts) and decode(ids, offsets) of a vocabulary file of the tokenizers library.

    The file's own normalizer and pre-tokenizer cut chunks into words; the merges are this module's.
    """

    def __init__(self, path: str, kept_chunks: int = KEPT_CHUNKS):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if odd or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("a plain BPE vocabulary without decoder and post-processor is needed")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.normalize, self.split, self.suffix = tok.normalizer, tok.pre_tokenizer, suffix
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = [""] * (1 + max([*vocab.values(), *added.values()], default=0))
        for name, i in (*vocab.items(), *added.items()):
            names[i] = name
        self.names = pa.array(names, pa.string())
        self.added = added
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges(np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int64).reshape(-1, 2), np.array([vocab[a + b] for a, b in pairs], np.int64), len(names))
        # Ids of single characters, within a word and at its end.
        self.inner, self.last = {}, {}
        for name, i in vocab.items():
            if len(name) == 1:
                self.inner[ord(name)] = i
            if len(name) == 1 + len(suffix) and name.endswith(suffix):
                self.last[ord(name[0])] = i
        top = 1 + max([*self.inner, *self.last], default=0)
        self.base = np.full((2, top), -1, np.int32)
        for row, ids in enumerate((self.inner, self.last)):
            self.base[row, list(ids)] = list(ids.values())
        self.most = kept_chunks
        self._clear()

    def _clear(self) -> None:
        #: Chunk -> row; the ids of row r are flat[begin[r] : begin[r] + size[r]].
        self.rows: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _odd(self, chunk: str) -> tuple[list[str], list[int]]:
        """Words of a chunk that holds added tokens or other white space, and for each the id it stands for, or -1."""
        words, ids = [], []
        for part in self.parts.split(chunk) if self.parts else [chunk]:
            if part in self.added:
                words.append("")
                ids.append(self.added[part])
            elif part:
                plain = self.normalize.normalize_str(part) if self.normalize else part
                found = [w for w, _ in self.split.pre_tokenize_str(plain)] if self.split else [plain]
                words += found
                ids += [-1] * len(found)
        return words, ids

    def _words(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words of all chunks end to end, the id of each that is an added token (else -1), and each word's chunk.

        The file's normalizer and pre-tokenizer see the chunks in one string, parted by spaces, where no chunk holds an
        added token and normalising leaves the number of parts as it is; other chunks are cut one by one.
        """
        plain = [c for c in chunks if not (self.parts and self.parts.search(c))]
        text = self.normalize.normalize_str(" ".join(plain)) if self.normalize and plain else " ".join(plain)
        parts = text.split(" ") if plain else []
        words: list[str] = []
        ids: list[int] = []
        chunk_of = np.zeros(0, np.int64)
        if len(parts) == len(plain) and "" not in plain and self.split and plain:
            at = np.array([i for i, c in enumerate(chunks) if not (self.parts and self.parts.search(c))] if len(plain) < len(chunks) else range(len(chunks)), np.int64)
            found = self.split.pre_tokenize_str(text)
            words = [w for w, _ in found]
            begin = np.fromiter((o[0] for _, o in found), np.int64, len(found))
            n = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
            chunk_of = at[np.searchsorted(np.cumsum(n), begin, side="right")]
            ids = [-1] * len(words)
            left = [i for i, c in enumerate(chunks) if self.parts and self.parts.search(c)] if len(plain) < len(chunks) else []
        else:
            left = range(len(chunks))
        more = []
        for i in left:
            w, k = self._odd(chunks[i])
            words += w
            ids += k
            more += [i] * len(w)
        chunk_of = np.concatenate([chunk_of, np.array(more, np.int64)])
        return words, np.array(ids, np.int64), chunk_of

    def _tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words, end to end, and how many each has; characters outside of the vocabulary are dropped."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        last = np.zeros(len(points), np.int64)
        last[np.cumsum(n)[n > 0] - 1] = 1
        known = points < self.base.shape[1]
        sym = np.where(known, self.base[last, np.where(known, points, 0)], -1)
        word = np.repeat(np.arange(len(words)), n)[sym >= 0]
        n = np.bincount(word, minlength=len(words))
        some = n > 0
        flat, lengths = self.merges.apply(sym[sym >= 0], n[some])
        out = np.zeros(len(words), np.int64)
        out[some] = lengths
        return flat, out

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks end to end, and how many each has."""
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words, fixed, chunk_of = self._words(chunks)
        index: dict[str, int] = {}
        at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        flat, n = self._tokens(list(index))
        # Added tokens stand behind the words' tokens, one each.
        added = np.flatnonzero(fixed >= 0)
        begin, size = (np.cumsum(n) - n)[at], n[at]
        begin[added], size[added] = len(flat) + np.arange(len(added)), 1
        flat = np.concatenate([flat, fixed[added].astype(np.int32)])
        order = np.argsort(chunk_of, kind="stable")
        sizes = np.bincount(chunk_of, weights=size, minlength=len(chunks)).astype(np.int64)
        return flat[_ranges(begin[order], size[order])], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: a string column; null counts as empty. All ids (uint32) end to end and len(texts) + 1 offsets."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        cut = pc.split_pattern_regex(texts, r"[\x20\x09-\x0D]+")
        offs = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.rows) + len(chunks) // 2 > self.most:
            self._clear()
        row = np.fromiter((self.rows.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(row < 0)
        kept = [i for i in new.tolist() if len(chunks[i]) <= KEPT_CHARS]
        long = [i for i in new.tolist() if len(chunks[i]) > KEPT_CHARS]
        for some, keep in ((kept, True), (long, False)):  # long chunks come last and are not kept
            if keep:
                begin, size, flat = self.begin, self.size, self.flat
            if not some:
                continue
            names = [chunks[i] for i in some]
            ids, n = self._learn(names)
            row[some] = len(begin) + np.arange(len(some))
            begin = np.concatenate([begin, len(flat) + np.cumsum(n) - n])
            size, flat = np.concatenate([size, n]), np.concatenate([flat, ids])
            if keep:
                self.rows.update(zip(names, row[some].tolist(), strict=True))
                self.begin, self.size, self.flat = begin, size, flat
        pick = row[coded.indices.to_numpy()]
        s = size[pick]
        upto = np.concatenate([[0], np.cumsum(s)])
        return flat[_ranges(begin[pick], s)].astype("<u4"), upto[offs - offs[0]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each list of ids: the names of its tokens, parted by spaces."""
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.names.take(pa.array(ids.astype(np.int64))))
        return pc.binary_join(lists, pa.scalar(" "))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each range, end to end."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


_coders: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """One for each Python worker and vocabulary."""
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    Null and empty texts have no ids; a null id and repeated rows are rows like others; other columns, of whatever name,
    are ignored; an empty table gives an empty one. A doc_id that is no number raises.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                ids, offs = c.encode(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32)))], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); a null list is an empty text. An id outside of the vocabulary raises."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            flat, offs = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column(0), c.decode(flat, offs)], schema=schema)

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of each text's ids and of what they decode to; cases as in encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                ids, offs = c.encode(some.column(1))
                raw, cut = memoryview(ids).cast("B"), offs.tolist()
                text_of = c.decode(ids, offs)
                ends, bytes_of = np.frombuffer(text_of.buffers()[1], "<i4")[: len(offs)].tolist(), memoryview(text_of.buffers()[2] or b"")
                sha = lambda b: hashlib.sha256(b).hexdigest()
                cols = [[sha(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], [sha(bytes_of[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(offs)), *map(pa.array, cols)], schema=_ARROW)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, OUT)
