"""Token ids by the tokenizers library, with a word cache per Python worker.

Encoding a text chunk by chunk is exact for both vocabularies used here. In byte-level BPE a single space between two
other characters always starts a new piece, so text cut before such spaces encodes to the concatenation of its chunks;
texts with other runs of white space go through the library whole. In the word vocabulary white space is dropped and
never inside a piece, so cutting at spaces is exact for any text. Misses are encoded by the library, in batches.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
CHUNK_BYTES = 64 << 20
PIECE_BYTES = 128 << 20
ENTRY_BYTES = 190  # of a short text, its ids and their place in the table, besides what both hold
SLICE_BYTES = 4 << 20


class Cache:
    """Two generations of at most ``most // 2`` bytes each, so the entries in use outlive a full cache."""

    def __init__(self, most: int):
        self.most = most
        self.held = 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, words: list[str]) -> list[bytes | None]:
        found = list(map(self.young.get, words))
        if self.old:
            again = {}
            for k in [k for k, x in enumerate(found) if x is None]:
                if (x := self.old.get(words[k])) is not None:
                    found[k] = again[words[k]] = x
            if again:  # what is still in use moves to the young
                self.add(again)
        return found

    def add(self, fresh: dict[str, bytes]) -> None:
        size = ENTRY_BYTES * len(fresh) + sum(map(len, fresh)) + sum(map(len, fresh.values()))
        if size > self.most // 2:  # what stands first in a text is most likely to come again
            fresh, size = dict(islice(fresh.items(), len(fresh) * (self.most // 2) // size)), self.most // 2
        if self.held + size > self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young.update(fresh)
        self.held += size


class Encoder:
    """Two caches: of chunks between spaces, and of the letter and punctuation pieces that chunks are made of."""

    def __init__(self, path: str, chunks: int = CHUNK_BYTES, pieces: int = PIECE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = bool((spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel")
        self.chunks, self.pieces = Cache(chunks), Cache(pieces)
        self.vocab_size = self.tokenizer.get_vocab_size()
        #: Which ids end a word, in a vocabulary that marks them.
        self.last, mark = None, spec["model"].get("end_of_word_suffix")
        if mark and not self.byte_level:
            vocab = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.last[[i for token, i in vocab.items() if token.endswith(mark)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of whole texts, without a cache."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def of_words(self, words: list[str]) -> list[bytes]:
        """As whole(), of words of letters that split on their own when they stand together (with their spaces in front
        of them in a byte vocabulary): the library's work a text is done once for many."""
        if self.last is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(words) or ends[-1] != 4 * len(ids):
                return self.whole(words)
            raw = ids.tobytes()
            return [raw[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
        found = self.tokenizer.encode_batch([("" if self.byte_level else " ").join(words)], add_special_tokens=False)[0]
        which = found.word_ids
        if None in which or not which or which[-1] + 1 != len(words):
            return self.whole(words)
        raw = array("I", found.ids).tobytes()
        ends = (4 * np.cumsum(np.bincount(np.array(which), minlength=len(words)))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _parts(self, chunk: str) -> tuple[str, ...] | None:
        """Pieces that encode on their own, or None where only the library can tell."""
        if m := _PLAIN.fullmatch(chunk if self.byte_level else chunk.lower()):
            return m.groups() if m[2] else (m[1],)
        if "\n" not in chunk:
            return None
        parts: list[str] = []
        for k, line in enumerate(chunk.split("\n")):
            m = _PLAIN.fullmatch(line if self.byte_level else line.lower())
            if m is None:
                return None
            if k and self.byte_level:
                parts.append("\n")
            parts += filter(None, m.groups())
        return tuple(parts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array on end (unsigned 32-bit), and where each text's begin (one entry more than texts).

        Null counts as empty. The work goes by slices of about ``SLICE_BYTES`` of text (or of one text, if longer).
        """
        texts = texts.fill_null("")
        if not isinstance(texts, pa.StringArray):
            texts = texts.cast(pa.string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        steps = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES, prepend=0))
        bounds = np.unique(np.concatenate(([0], steps, [len(texts)]))).tolist()
        found = [self._encode_slice(texts.slice(a, b - a)) for a, b in zip(bounds, bounds[1:])]  # noqa: B905
        if not found:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        bases = np.cumsum([0, *(len(ids) for ids, _ in found)])
        at = np.concatenate([*(at[:-1] + base for (_, at), base in zip(found, bases)), bases[-1:]])  # noqa: B905
        return np.concatenate([ids for ids, _ in found]), at

    def _encode_slice(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """encode() at once. Words are split and numbered by Arrow; only distinct words are looked up in Python."""
        lists = pc.split_pattern(texts, " ")
        heads = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.values.slice(int(heads[0]), int(heads[-1] - heads[0])).dictionary_encode()
        heads = heads - heads[0]
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        slow = np.zeros(len(texts), dtype=bool)
        if self.byte_level and len(words):
            at = np.flatnonzero(_spaced(words)[codes])
            slow[np.searchsorted(heads, at, side="right") - 1] = True
            slow &= heads[1:] - heads[:-1] > 1  # a text of one chunk is that chunk
            firsts = heads[:-1][heads[1:] > heads[:-1]]
            own, inverse = np.unique(codes[firsts], return_inverse=True)
            codes = codes.copy()
            codes[firsts] = len(words) + inverse
            behind, first = self._looked_up(words, " "), self._looked_up(words.take(pa.array(own)), "")
            flat, lens = (np.concatenate(x) for x in zip(behind, first, strict=True))
        else:
            flat, lens = self._looked_up(words, "")
        starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
        out, ends = _gather(flat, starts, lens, codes)
        at = np.concatenate(([0], ends))[heads]
        if slow.any():
            which = np.flatnonzero(slow)
            found = dict(zip(which.tolist(), self.whole([texts[int(i)].as_py() for i in which]), strict=True))
            parts = [np.frombuffer(found[i], dtype="<u4") if i in found else out[at[i] : at[i + 1]] for i in range(len(texts))]
            out = np.concatenate(parts)
            at = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return out, at

    def encode_documents(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with ``end_id`` behind each text."""
        ids, at = self.encode(texts)
        return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))

    def _looked_up(self, words: pa.StringArray, before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each with ``before`` in front, on end, and the number of each word's.

        Arrow splits plain words into letters and punctuation, and only the distinct ones of those are looked up; the
        other words go through the cache of chunks.
        """
        letters, marks = pc.ascii_rtrim(words, characters=_MARKS), pc.utf8_ltrim(words, characters=_LETTERS)
        plain = _all_letters(letters)
        rest = words.filter(pa.array(~plain))
        units = self._learn([before + w for w in rest.to_numpy(zero_copy_only=False).tolist()])
        which = np.zeros((len(words), 2), dtype=np.int64)
        which[~plain, 0] = np.arange(len(rest)) + 1
        for k, (some, front) in enumerate(((letters, before), (marks, ""))):
            some = some.filter(pa.array(plain))
            coded = (some if self.byte_level else pc.utf8_lower(some)).dictionary_encode()
            which[plain, k] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(units) + 1
            units += self._piece_ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), front, k == 0 and (front == " " or not self.byte_level))
        sizes = np.concatenate(([0], np.fromiter(map(len, units), dtype=np.int64, count=len(units)) // 4))
        flat = np.frombuffer(b"".join(units), dtype="<u4")
        out, _ = _gather(flat, np.cumsum(sizes) - sizes, sizes, which.ravel())
        return out, sizes[which].sum(axis=1)

    def _piece_ids(self, pieces: list[str], before: str, words: bool) -> list[bytes]:
        """Ids of distinct pieces, each with ``before`` in front; ``words`` if of_words() can take them."""
        keys = [before + p for p in pieces] if before else pieces
        found = self.pieces.find(keys)
        missing = [p for p, x in zip(keys, found, strict=True) if x is None]
        new = {"": b""} if "" in missing else {}
        size, encode = (500 if self.last is not None else 2000, self.of_words) if words else (20_000, self.whole)
        for at in range(0, len(missing), size):
            some = [p for p in missing[at : at + size] if p]
            new.update(zip(some, encode(some), strict=True))
        self.pieces.add(new)
        return [new[p] if x is None else x for p, x in zip(keys, found, strict=True)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the caches as far as they go."""
        found = self.chunks.find(words)
        missing = [w for w, x in zip(words, found, strict=True) if x is None]
        if not missing:
            return found
        collecting = gc.isenabled()
        gc.disable()  # a million short-lived tuples, none in a cycle
        try:
            parts = list(map(self._parts, missing))
            needed = {p for some in parts if some for p in some}
            names = list(needed)
            pieces = dict(zip(names, self.pieces.find(names), strict=True))
            new, fresh = {}, {}
            for names, into in (([p for p, x in pieces.items() if x is None], new), ([c for c, p in zip(missing, parts, strict=True) if p is None], fresh)):
                for at in range(0, len(names), 20_000):
                    some = names[at : at + 20_000]
                    into.update(zip(some, self.whole(some), strict=True))
            self.pieces.add(new)
            pieces.update(new)
            piece = pieces.__getitem__
            fresh.update((c, piece(p[0]) if len(p) == 1 else b"".join(map(piece, p))) for c, p in zip(missing, parts, strict=True) if p is not None)
            self.chunks.add(fresh)
            return [fresh[w] if x is None else x for w, x in zip(words, found, strict=True)]
        finally:
            if collecting:
                gc.enable()

    def sentence_ends(self) -> np.ndarray:
        """Per id whether a sentence can end with it: its text ends with . ! ? or holds a line feed."""
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            bare = token.removesuffix("</w>")
            ends[i] = bare.endswith((".", "!", "?")) or "Ċ" in bare or "\n" in bare
        return ends


def _bytes_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the words, and the bytes they point into."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    return offsets.astype(np.int64), np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)


def _spaced(words: pa.StringArray) -> np.ndarray:
    """Which of ``words`` are empty or begin or end with white space; Python looks only at those that may."""
    offsets, raw = _bytes_of(words)
    out = offsets[1:] == offsets[:-1]
    if len(raw):
        first, last = raw[np.minimum(offsets[:-1], len(raw) - 1)], raw[np.maximum(offsets[1:] - 1, 0)]
        unsure = np.flatnonzero(~out & ((first <= 32) | (first > 127) | (last <= 32) | (last > 127)))
        out[unsure] = [w[0].isspace() or w[-1].isspace() for w in words.take(pa.array(unsure)).to_pylist()]
    return out


def _all_letters(words: pa.StringArray) -> np.ndarray:
    """Which of ``words`` have nothing but ``_LETTERS``, at least one."""
    offsets, raw = _bytes_of(words)
    raw = raw[: offsets[-1]] if len(offsets) else raw
    good = _ASCII_LETTER[raw]
    if len(raw) > 1:  # of two bytes: 0xC3, then any but the signs for times and divided by
        second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)) + 1
        good[second] = good[second - 1] = True
    sums = np.concatenate(([0], np.cumsum(good)))
    sizes = offsets[1:] - offsets[:-1]
    return (sizes > 0) & (sums[offsets[1:]] - sums[offsets[:-1]] == sizes)


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` that the codes name, on end, and where each ends."""
    n = lens[codes]
    ends = np.cumsum(n)
    shift = np.repeat(starts[codes] - (ends - n), n)
    shift += np.arange(len(shift))
    return flat[shift], ends


#: Latin letters, then punctuation without apostrophes (contractions) and angle brackets (special tokens).
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@[-`{-~]*)")

_LETTERS = "".join(chr(c) for c in range(256) if _PLAIN.fullmatch(chr(c)))
_MARKS = "".join(chr(c) for c in range(128) if _PLAIN.fullmatch("a" + chr(c)) and not chr(c).isalpha())
_ASCII_LETTER = np.array([c < 128 and chr(c) in _LETTERS for c in range(256)])

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept as long as the worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
