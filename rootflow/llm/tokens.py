"""Whole-text tokenisation with a public tokenizer, fast enough for word lists with a long tail.

The tokenizer that is used here drops white space and never merges across it, nor across the border of a
letter and a full stop or comma, so a text's ids are the ids of the pieces between those borders in order.
Pieces repeat, so each worker keeps a memory of piece -> ids, bounded in bytes; a piece that isn't in it is encoded
by the tokenizer itself, and a long one is never kept. ``_by_chunk`` says whether a tokenizer file has that
property; one without it encodes whole texts. A run of letters that the tokenizer's own normalisation breaks up
(a letter that becomes letter and mark) is told by its ids, and goes to the tokenizer together with what follows it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np

from rootflow.llm.common import slices, word_hashes, words

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Bytes of pieces that a worker remembers at a time, with what Python needs to hold them.
REMEMBERED = 128 << 20
#: What Python needs for an entry besides its bytes.
_ENTRY = 180
#: Longer pieces are not remembered.
LONG_PIECE = 256
#: Bytes of text that are cut into pieces at a time.
SLICE = 2 << 20
#: A piece is cut between an ASCII letter (1) and one of these stops (2): the tokenizer always cuts there.
_STOPS = ".,;:!?*%$#&"
_TAIL = re.compile(r"([^\W\d_]+)([.,;:!?*%$#&]+)")
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[list(_STOPS.encode())] = 2


def path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes UTF-8 texts to arrays of ids."""

    def __init__(self, file: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunk = self._by_chunk(spec)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = (spec["model"].get("end_of_word_suffix") or "") if self.by_chunk else ""
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    @staticmethod
    def _by_chunk(spec: dict) -> bool:
        """White space is dropped before pieces are made, no piece holds any, and no added token does."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        first = steps[0] if steps else {}
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in first["pattern"].get("Regex", "")
        later = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in steps[1:])
        plain = all(not (set(x["content"]) & set(" \t\n\r\x0b\x0c")) for x in spec.get("added_tokens", []))
        return bool(drops and later and plain and spec.get("post_processor") is None)

    def _one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces. Runs of letters are one piece of the tokenizer each, so many go to a call; where one
        ends is told by its last id."""
        found: dict[bytes, bytes] = {}
        letters, tails, rest = set(), [], []
        for c in pieces:
            s = c.decode()
            if s.isalpha():
                letters.add(s)
            elif m := _TAIL.fullmatch(s):
                tails.append((c, m[1], m[2]))
            else:
                rest.append(c)
        letters.update(x for _, x, _ in tails if x.encode() not in self.known)
        todo = list(letters)
        for i in range(0, len(todo), 512):
            some = todo[i : i + 512]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and len(ids) == cuts[-1]:
                raw, w = ids.tobytes(), self.dtype.itemsize
                cuts = (cuts * w).tolist()
                found.update(zip(map(str.encode, some), map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
            else:
                found.update((x.encode(), self._one(x)) for x in some)
        for c, core, tail in tails:
            ids = found[core.encode()] if core.encode() in found else self.known[core.encode()]
            if self.ends[np.frombuffer(ids, self.dtype)].sum() == 1:
                if tail.encode() not in found:
                    found[tail.encode()] = self._one(tail)
                found[c] = ids + found[tail.encode()]
            else:  # normalisation broke the letters up, so a mark may belong to what follows
                found[c] = self._one(c.decode())
        for c in rest:
            found[c] = self._one(c.decode())
        return found

    def _remember(self, found: dict[bytes, bytes]) -> None:
        for c, ids in found.items():
            if len(c) <= LONG_PIECE and c not in self.known:
                size = len(c) + len(ids) + _ENTRY
                if self.held + size > self.remembered:
                    self.known, self.held = {}, 0
                self.known[c] = ids
                self.held += size

    def encode(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each text as an unsigned array; no end id."""
        if not self.by_chunk:
            return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        out: list[np.ndarray] = []
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        for a, b in slices(offsets, SLICE):
            out += self._some(b"".join(texts[a:b]), offsets[a : b + 1] - offsets[a])
        return out

    def _some(self, raw: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = words(offsets, data)
        if not len(starts):
            return [np.zeros(0, self.dtype)] * (len(offsets) - 1)
        kind = _KIND[data]
        inner = np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1
        inner = np.setdiff1d(inner, offsets, assume_unique=False)
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        own = np.searchsorted(starts, offsets)
        _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        chunks = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = self.known
        found = self._learn([c for c in chunks if c not in known])
        ids = [found[c] if c in found else known[c] for c in chunks]
        self._remember(found)
        flat, width = np.frombuffer(b"".join(ids), self.dtype), self.dtype.itemsize
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        at = np.cumsum(lengths) - lengths
        n = lengths[which]
        until = np.cumsum(n)
        tokens = flat[np.arange(until[-1]) - np.repeat(until - n - at[which], n)]
        cuts = np.concatenate([[0], until])[own]
        return [tokens[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]
