"""Token ids by a public tokenizer for whole columns of texts, in bounded memory.

Where the tokenizer's pre-tokeniser never joins characters across white space and its normaliser works on
either side of it alone (``splits_at_blanks`` reads that from the file), the ids of a text are those of its
blank-separated pieces one after the other; with any other file, texts are encoded whole. Pieces repeat far more often than texts, so each distinct one is encoded once and kept; a long
text costs what its distinct pieces cost."""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by a worker; beyond that they are forgotten and encoded again when they recur.
KEPT = 600_000


#: A character that no other id than its own stands for.
SEPARATOR = "\x01"
#: ASCII marks but the apostrophe between an ASCII letter and white space: the pre-tokeniser cuts there.
MARKS = r"([a-z])([!-&(-/:-@\[-`{-~]+)([ \t-\r])"


# The normaliser and the pattern of words for which pieces and MARKS hold.
NORMALISERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_blanks(path: str) -> bool:
    """Whether the file's normaliser lower-cases and works by character, and its words are those of WORD, without blanks."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    normaliser, splitter = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
    first, *others = splitter.get("pretokenizers") or [{}]
    words = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD} and first.get("behavior") == "Removed" and first.get("invert") is True
    level = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    return words and others == level and tuple(normaliser.get("normalizers") or ()) == NORMALISERS and not said.get("truncation") and not said.get("padding")


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = splits_at_blanks(path)
        if self.pieces:
            (self.separator,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _add(self, pieces: list[str]) -> None:
        """Encode pieces and keep their ids; joined by a separator, which costs half of single calls."""
        for at in range(0, len(pieces), 1024):
            part = pieces[at : at + 1024]
            if any(SEPARATOR in p for p in part):
                coded = [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for p in part]
                lengths, ids = np.array([len(c) for c in coded]), np.concatenate(coded)
            else:
                ids = np.array(self.tokenizer.encode(f" {SEPARATOR} ".join(part), add_special_tokens=False).ids, np.uint32)
                cut = np.flatnonzero(ids == self.separator)
                lengths = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                ids = np.delete(ids, cut)
            k, n = len(self.index), len(part)
            while k + n > len(self.lengths):
                self.lengths, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.index.update(zip(part, range(k, k + n), strict=True))
            self.lengths[k : k + n], self.starts[k : k + n] = lengths, self.used + np.cumsum(lengths) - lengths
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (large strings, none null) one after the other (uint32), and each text's first place (one more at the end)."""
        if not self.pieces:
            coded = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *coded]), np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            # no special token to spare: fewer distinct pieces without capitals and with marks after a word apart
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS, r"\1 \2\3")
        for ws in ("\t", "\n", "\r", "\x0b", "\x0c"):
            texts = pc.replace_substring(texts, ws, " ")
        split = pc.split_pattern(texts, " ")
        offsets = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        offsets -= offsets[0]
        pieces = coded.dictionary.to_pylist()
        # one look-up a distinct piece; new ones get the next numbers, in order
        known = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(known < 0)
        if len(self.index) + len(fresh) > KEPT:
            self.clear()
            fresh = np.arange(len(pieces))
        known[fresh] = np.arange(len(self.index), len(self.index) + len(fresh))
        self._add([pieces[i] for i in fresh.tolist()])
        which = known[np.asarray(coded.indices)]
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[which] - (ends - lengths), lengths) + np.arange(total)
        starts = np.concatenate([[0], ends])[offsets]
        return self.ids[at], starts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
