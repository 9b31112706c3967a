"""Token ids of whole texts through the ``tokenizers`` library, with a bounded piece cache.

A text may be encoded in pieces where the tokenizer's own pre-tokenizer is known to cut it
anyway; each distinct piece is then encoded once, in batches, and the ids of pieces met often
are kept in a direct-mapped table of fixed size.  Two forms are known by their definition in
the file: the lower-casing word BPE, which never matches across white space, nor from an ASCII
letter into an ASCII character that is no letter; and the byte-level BPE, none of whose matches
goes from a visible character into ASCII white space, nor from an ASCII letter into an ASCII
character that is no letter, and which looks ahead only from white space.  A tokenizer of any other
form gets its texts whole.  So do texts that hold the opening of a special token, because
special tokens are matched before anything else; with plain=True their strings are plain text.

Pieces of a sentencepiece vocabulary (SpacedEncoder) are cut before every space that follows
another character, if no piece of the vocabulary goes on after a space inside it: merges then
never cross such a place.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quillspark.llm import textkit as tk

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_OTHER = np.zeros(256, dtype=bool)
_OTHER[33:128] = True
_OTHER &= ~_LETTER
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True

WIDTH = 8


def default_tokenizer() -> str:
    """Path of the public word BPE with 49,408 ids."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How the two known forms are defined in a tokenizer file.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _form(definition: dict) -> str:
    """word, byte, or whole for a tokenizer whose cuts are not known."""
    normal, pre = definition.get("normalizer"), definition.get("pre_tokenizer") or {}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t["content"].startswith("<|") for t in definition.get("added_tokens") or []):
        return "whole"
    if normal and normal.get("normalizers") == _WORD_NORMAL and pre.get("type") == "Sequence":
        first, second = (pre.get("pretokenizers") or [{}, {}])[:2]
        if first.get("pattern") == {"Regex": _WORD_SPLIT} and first.get("behavior") == "Removed" and first.get("invert") and second.get("type") == "ByteLevel" and not second.get("use_regex") and not second.get("add_prefix_space"):
            return "word"
    if not normal and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    return "whole"


class PieceEncoder:
    """encode(column) -> (flat uint32 ids, offsets of each document)."""

    def __init__(self, path: str, slots: int = 1 << 20, plain: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        self.form = _form(definition)
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = self.plain = plain
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.many = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.model = self.tok.model
        if self.form != "whole":
            self._table(slots)

    def _table(self, slots: int) -> None:
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.keys = np.zeros(slots, dtype=np.uint64)
        self.ids = np.zeros((slots, WIDTH), dtype=self.kind)
        self.lens = np.zeros(slots, dtype=np.uint8)
        self.mask = np.uint64(slots - 1)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.many(texts, add_special_tokens=False)]

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        """A piece of ASCII letters (and, in the byte form, a space before them) is one piece of the pre-tokenizer too: straight to the model."""
        out: list[list[int] | None] = [None] * len(texts)
        for i, x in enumerate(texts):
            led = self.form == "byte" and x[0] == " "
            word = x[1:] if led else x
            if word.isascii() and word.isalpha():
                out[i] = [t.id for t in self.model.tokenize(f"Ġ{word}" if led else word)]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _cut(self, s: tk.Slice) -> tk.Words:
        """The pieces of a slice, as this form cuts them."""
        d = s.data
        cut = np.zeros(len(d), dtype=bool)
        if self.form == "byte":
            if len(d):
                seen = _VISIBLE[d[:-1]]
                # The last byte of a two-byte character; none of those that begin with C3 to DF is white space.
                seen[1:] |= (d[:-2] >= 0xC3) & (d[:-2] <= 0xDF)
                cut[1:] = (tk.SPACE[d[1:]] & seen) | (_LETTER[d[:-1]] & _OTHER[d[1:]])
            return tk.bounds(np.ones(len(d), dtype=bool), s.offsets, cut)
        if len(d):
            cut[1:] = _LETTER[d[:-1]] & _OTHER[d[1:]]
        return tk.bounds(~tk.SPACE[d], s.offsets, cut)

    def slice_ids(self, s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
        if self.form == "whole" or (not self.plain and b"<|" in s.data.tobytes()):
            found = self._library([s.raw(i).decode() for i in range(s.n)])
            of = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            return np.fromiter((y for x in found for y in x), dtype=np.uint32, count=int(of[-1])), of
        w = self._cut(s)
        if not len(w.starts):
            return np.zeros(0, np.uint32), np.zeros(s.n + 1, np.int64)
        low = tk.LOWER[s.data] if self.form == "word" else s.data
        h = tk.range_hash(tk.prefix(low), w.starts, w.ends)
        slot = (h & self.mask).astype(np.int64)
        rows, lens = self.ids[slot], self.lens[slot].astype(np.int64)
        miss = np.flatnonzero((self.keys[slot] != h) | (lens == 0))
        long: dict[int, list[int]] = {}
        if len(miss):
            uniq, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            raw, where = low.tobytes(), miss[at]
            found = self._pieces([raw[a:b].decode() for a, b in zip(w.starts[where].tolist(), w.ends[where].tolist(), strict=True)])
            n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            table = np.zeros((len(found), WIDTH), dtype=self.kind)
            short = n <= WIDTH
            fill = np.fromiter((y for x, ok in zip(found, short.tolist(), strict=True) if ok for y in x), dtype=self.kind, count=int(n[short].sum()))
            inside = (np.arange(WIDTH) < n[:, None]) & short[:, None]
            table[inside] = fill
            long = {i: found[i] for i in np.flatnonzero(~short).tolist()}
            rows[miss], lens[miss] = table[back], n[back]
            keep = short & (n > 0)
            put = (uniq[keep] & self.mask).astype(np.int64)
            # Two new pieces may share a slot: the last one written keeps it, wholly.
            put, last = np.unique(put[::-1], return_index=True)
            last = int(keep.sum()) - 1 - last
            self.keys[put], self.ids[put], self.lens[put] = uniq[keep][last], table[keep][last], n[keep][last]
        begin = np.zeros(len(lens) + 1, dtype=np.int64)
        np.cumsum(lens, out=begin[1:])
        out = np.zeros(int(begin[-1]), dtype=np.uint32)
        fits = lens <= WIDTH
        if fits.all():
            out[:] = rows[np.arange(WIDTH) < lens[:, None]]
        else:
            for j in range(WIDTH):
                k = np.flatnonzero(fits & (lens > j))
                out[begin[k] + j] = rows[k, j]
            for i, which in zip(miss.tolist(), back.tolist(), strict=True):
                if which in long:
                    out[begin[i] : begin[i + 1]] = long[which]
        return out, begin[w.of]

    def encode(self, column: pa.Array):
        """Yields (first row, ids, offsets) for each slice."""
        for s in tk.slices(column, 2 * tk.SLICE_BYTES):
            ids, of = self.slice_ids(s)
            yield s.first, ids, of


class SpacedEncoder(PieceEncoder):
    """A sentencepiece model over texts that begin with the space it would add; an empty text has no ids."""

    def __init__(self, path: str, slots: int = 1 << 20) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.plain = len(self.sp), True
        names = [self.sp.id_to_piece(i) for i in range(self.size)]
        self.lone = names.index("▁")
        self.form = "whole" if any("▁" in x.lstrip("▁") for x in names) else "spaced"
        self._table(slots)

    def _cut(self, s: tk.Slice) -> tk.Words:
        cut = np.zeros(len(s.data), dtype=bool)
        cut[1:] = (s.data[1:] == 32) & (s.data[:-1] != 32)
        return tk.bounds(np.ones(len(s.data), dtype=bool), s.offsets, cut)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return self._pieces(texts)

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        """The library adds the first space; it takes a lone one for nothing."""
        found = self.sp.encode([x[1:] for x in texts], num_threads=1)
        return [[self.lone] if x == " " else ids for x, ids in zip(texts, found, strict=True)]


def byte_entries(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE, in whose entries every byte stands as a visible character."""
    from tokenizers import Tokenizer

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tok = Tokenizer.from_file(path)
    out = [b""] * tok.get_vocab_size(with_added_tokens=True)
    for entry, i in tok.get_vocab(with_added_tokens=False).items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


def spaced_entries(path: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: a piece in UTF-8 with spaces for their marks, a byte piece its byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(len(sp))]


@lru_cache(maxsize=2)
def aligned_encoders(byte_path: str, spaced_path: str) -> tuple[PieceEncoder, SpacedEncoder]:
    """The two encoders of a process that aligns."""
    return PieceEncoder(byte_path, plain=True), SpacedEncoder(spaced_path)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> PieceEncoder:
    """One encoder a process: a worker's later tasks find its table filled."""
    return PieceEncoder(path)
