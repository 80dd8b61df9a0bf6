"""Token ids of texts by the tokenizers library, which sees each distinct part of the texts once.

A space between two characters that are not white space always begins a new unit of a byte-level BPE's pre-tokenizer,
so a text may be cut there and each part encoded alone. Parts repeat, so their ids are kept end to end in one bounded
table, and the ids of a batch are gathered from it by array operations. Texts with other white space next to a space,
and texts that hold one of the tokenizer's added tokens, are encoded whole.
"""

from __future__ import annotations

import os
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts whose ids a Python worker keeps; when full, parts seen in one batch alone go first.
KEPT_PARTS = 600_000
#: Row of parts that say their text is to be encoded whole; 0 is the part without ids.
ODD = 1
#: Stands before a full stop or comma that was parted from the letter before it; texts that hold it are encoded whole.
MARK = "\x01"
#: Such a mark between a letter and white space is a unit of its own in a byte-level pre-tokenizer.
_MARKED = rf"(\pL)([,.])([ \n])", rf"\1 {MARK}\2\3"


class Encoder:
    """encode(texts) gives the ids of all texts end to end and each text's offsets; as encode_batch, no special tokens.

    With specials_as_text the strings of added tokens are ordinary text; by default they are those tokens, as in a
    plain call of the library.
    """

    def __init__(self, path: str, kept_parts: int = KEPT_PARTS, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = specials_as_text
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if not (specials_as_text and t.special)]
        self.most = max(8, kept_parts)
        # Only a plain byte-level pre-tokenizer is known to cut before each such space.
        self.cuts = type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and self.tok.normalizer is None
        self.line = np.frombuffer(self.whole(["\n"])[0], "<u4")
        self.ends = self.whole([".", ","])
        # How a byte-level vocabulary shows bytes: printable Latin-1 as itself, the others in order from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self._clear()

    def _clear(self) -> None:
        #: Part -> row, in the order of the rows; the ids of row r are flat[begin[r] : begin[r] + size[r]].
        self.rows: dict[str, int] = {"": 0, " ": ODD}
        self.begin, self.size, self.uses = (np.zeros(1024, np.int32) for _ in range(3))
        self.flat, self.used, self.next = np.zeros(4096, "<u4"), 0, 2
        self._add([f"{MARK}.", f"{MARK},"], self.ends)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _room(self, ids: int, rows: int = 0) -> None:
        if self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(ids, len(self.flat) // 2), "<u4")])
        if self.next + rows > len(self.begin):
            more = np.zeros(max(rows, len(self.begin) // 2), np.int32)
            self.begin, self.size, self.uses = (np.concatenate([x, more]) for x in (self.begin, self.size, self.uses))

    def _append(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids behind the table's; their begins and sizes."""
        raw = np.frombuffer(b"".join(values), "<u4")
        self._room(len(raw))
        self.flat[self.used : self.used + len(raw)] = raw
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begin = self.used + np.cumsum(size) - size
        self.used += len(raw)
        return begin, size

    def _add(self, parts: list[str], values: list[bytes]) -> None:
        first, end = self.next, self.next + len(parts)
        self._room(0, len(parts))
        self.rows.update(zip(parts, range(first, end), strict=True))
        self.begin[first:end], self.size[first:end] = self._append(values)
        self.next = end

    def _learn(self, parts: list[str]) -> None:
        """Ids of parts, each behind a space or, if it begins with a line end, behind that."""
        rows, tokenize, shown = self.rows, self.tok.model.tokenize, self.shown
        line = self.line.tobytes()
        keys, values, other = [], [], []
        for p in parts:
            if p.isalpha():  # letters alone are one unit: the model takes them as they are
                raw = "Ġ" + (p if p.isascii() else p.encode().decode("latin-1").translate(shown))
                keys.append(p)
                values.append(array("I", [t.id for t in tokenize(raw)]).tobytes())
            elif p[0] == "\n" and p[1:].isalpha():
                raw = p[1:] if p.isascii() else p[1:].encode().decode("latin-1").translate(shown)
                keys.append(p)
                values.append(line + array("I", [t.id for t in tokenize(raw)]).tobytes())
            elif p[-1].isspace() or p[0].isspace() and (p[0] != "\n" or p[1].isspace()):
                rows[p] = ODD
            else:
                other.append(p)
        if other:
            keys += other
            coded = self.whole([p[1:] if p[0] == "\n" else f" {p}" for p in other])
            values += [line + v if p[0] == "\n" else v for p, v in zip(other, coded, strict=True)]
        self._add(keys, values)

    def _forget(self) -> None:
        """Keeps the parts met in more than one batch since the last time, half of the table at most."""
        uses = self.uses[: self.next].copy()
        keep = uses > 1
        if keep.sum() > self.most // 2:
            keep = uses > np.partition(uses, -(self.most // 2))[-(self.most // 2)]
        names = [k for k, r in self.rows.items() if r > ODD and k[0] != MARK]
        at = np.fromiter((self.rows[k] for k in names), np.int64, len(names))
        at, names = at[keep[at]], list(compress(names, keep[at].tolist()))
        begin, size, flat = self.begin[at], self.size[at], self.flat
        self._clear()
        raw, cut = flat[_ranges(begin, size)].tobytes(), np.concatenate([[0], np.cumsum(4 * size)]).tolist()
        self._add(names, [raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: a string column; null counts as empty. Returns ids (uint32) and len(texts) + 1 offsets."""
        texts = pc.fill_null(texts, "")
        n_texts = len(texts)
        if not n_texts:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if not self.cuts:
            values = self.whole(texts.to_pylist())
            return np.frombuffer(b"".join(values), "<u4"), np.concatenate([[0], np.cumsum([len(v) // 4 for v in values])])
        # A line end between other characters is a unit of its own: it begins a part, and so does the whole text.
        lines = pc.binary_join_element_wise("\n", pc.replace_substring_regex(texts, *_MARKED), "")
        cut = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")
        offs = cut.offsets.to_numpy().astype(np.int64)
        offs -= offs[0]
        coded = cut.flatten().dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.rows) + len(parts) // 2 > self.most:
            self._forget()
        got = list(map(self.rows.get, parts))
        if None in got:
            self._learn([p for p, r in zip(parts, got, strict=True) if r is None])
            got = list(map(self.rows.get, parts))
        row = np.fromiter(got, np.int32, len(got))
        self.uses[row] += 1
        at = row[coded.indices.to_numpy()]
        at[at == 0] = ODD  # an empty part: two spaces, or one at an end
        at[offs[:-1]] = 0  # but before the line end put in front there is nothing
        first = offs[:-1] + 1
        whole = np.logical_or.reduceat(at == ODD, offs[:-1])
        for t in (MARK, *self.added):
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if whole.any():
            at[np.repeat(whole, np.diff(offs))] = 0
        begin, size = self.begin[at], self.size[at]
        skip = np.where(whole, 0, len(self.line)).astype(np.int32)  # a text's first part, without that line end
        begin[first] += skip
        size[first] -= skip
        kept = self.used
        if whole.any():
            begin[offs[:-1][whole]], size[offs[:-1][whole]] = self._append(self.whole(texts.filter(pa.array(whole)).to_pylist()))
        ids = self.flat[_ranges(begin, size)]
        self.used = kept  # texts encoded whole are not kept
        return ids, np.concatenate([[0], np.cumsum(np.add.reduceat(size, offs[:-1]), dtype=np.int64)])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each range, end to end."""
    ends = np.cumsum(size, dtype=np.int32)
    index = np.repeat(begin - ends + size, size)
    index += np.arange(len(index), dtype=np.int32)
    return index


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kept_parts: int = KEPT_PARTS, specials_as_text: bool = False) -> Encoder:
    """One for each Python worker, vocabulary and way to read added tokens."""
    key = path, kept_parts, specials_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
