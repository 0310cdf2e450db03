"""Whole-text token ids from public tokenizer files, with a bounded cache of encoded parts.

The two pre-tokenizers recognised here always break before white space, and between a letter and what is no letter (but for an
apostrophe before letters), and their normalizers never look across such a place. A text may therefore be cut there. The parts of a block of
texts are told apart by 64-bit hashes and lengths; the library encodes together those that no earlier block had, and the texts' ids are gathered by
index. Texts for which that needs more care (special strings, white space beyond ASCII, other vocabularies) go to the library
whole, so that the ids are its own for every text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tallyforge.llm.textbytes import span_hashes, slices

#: Parts that a worker keeps (those used longest ago go), the bytes of a block, and the parts that the library gets at a time.
KEPT, BLOCK_BYTES, TOGETHER = 1 << 20, 1 << 21, 512

# What the library takes for white space beyond blank and 9-13, or may not cut at.
_ODD_SPACE = re.compile("[%s]" % "".join(map(chr, [*range(28, 32), 133, 160, 5760, 6158, *range(8192, 8206), 8232, 8233, 8239, 8287, 12288, 65279])))
_ODD_ASCII = re.compile(bytes([91, *range(28, 32), 93]))

#: Kinds of bytes: white space, letters, the apostrophe, other ASCII, and what is beyond ASCII.
_BLANK, _LETTER, _QUOTE, _MARK, _BEYOND = range(5)
_KIND = np.full(256, _BEYOND, np.uint8)
_KIND[:128] = _MARK
_KIND[[32, *range(9, 14)]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[39] = _QUOTE
#: Whether a part ends between two kinds.
_CUT = np.zeros((5, 5), bool)
_CUT[[_LETTER, _QUOTE, _MARK, _BEYOND], _BLANK] = True
_CUT[_LETTER, [_QUOTE, _MARK]] = True
_CUT[_MARK, _LETTER] = True


@dataclass(frozen=True)
class TokenizerFile:
    """A vocabulary file read on the driver; executors get its bytes and need no file of their own."""

    blob: bytes
    kind: str
    version: str

    @staticmethod
    def read(path: str) -> TokenizerFile:
        with open(path, "rb") as f:
            blob = f.read()
        if path.endswith(".model"):
            import sentencepiece as library

            kind = "sentencepiece"
        else:
            import tokenizers as library

            spec = json.loads(blob)
            split, normal = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer"))
            kind = "other"
            if spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"):
                kind = "bytes"
            elif '"Lowercase"' in normal and '"NFC"' in normal and split.get("type") == "Sequence" and (split["pretokenizers"][0].get("behavior"), split["pretokenizers"][0].get("invert")) == ("Removed", True):
                kind = "words"
        label = f"{kind} {library.__version__}\n".encode()
        return TokenizerFile(blob, kind, hashlib.sha256(label + blob).hexdigest())


class _Kept:
    """The ids of parts by hash and length, in arrays."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.pool = np.zeros(0, np.uint32)
        self.turn = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each of ``keys`` is, or -1."""
        self.turn += 1
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        at[~found] = -1
        self.used[at[found]] = self.turn
        return at

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        """``keys`` that are not kept yet, with their ids."""
        if len(self.keys) + len(keys) > KEPT and len(self.keys):
            stay = self.used > np.median(self.used) if len(np.unique(self.used)) > 1 else np.zeros(len(self.used), bool)
            self.pool = self.pool[spread(self.begin[stay], self.size[stay])]
            self.keys, self.size, self.used = self.keys[stay], self.size[stay], self.used[stay]
            self.begin = np.cumsum(self.size) - self.size
        size = np.array([len(x) for x in ids], np.int64)
        begin = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, *ids])
        self.keys = np.concatenate([self.keys, keys])
        by = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[by]
        self.begin, self.size = np.concatenate([self.begin, begin])[by], np.concatenate([self.size, size])[by]
        self.used = np.concatenate([self.used, np.full(len(keys), self.turn)])[by]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, one span after the other."""
    stop = np.cumsum(size)
    return np.repeat(begin - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)


class ChunkEncoder:
    """Encodes whole texts to unsigned 32-bit little-endian ids; one is kept per worker and tokenizer."""

    _kept: dict[str, ChunkEncoder] = {}

    def __init__(self, file: TokenizerFile):
        self.kind = file.kind
        self.special: list[bytes] = []
        if self.kind == "sentencepiece":
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=file.blob)
        else:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_str(file.blob.decode())
            self.library.no_truncation()
            self.library.no_padding()
            self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.kept = _Kept()
        # Ids that end a word, where the vocabulary marks them.
        self.ends = np.zeros(0, bool)
        if self.kind == "words":
            vocabulary = self.library.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True

    @classmethod
    def of(cls, file: TokenizerFile) -> ChunkEncoder:
        if file.version not in cls._kept:
            cls._kept[file.version] = cls(file)
        return cls._kept[file.version]

    def whole(self, text: str) -> bytes:
        """The library's own result for ``text``."""
        if self.kind == "sentencepiece":
            ids = self.library.encode(text, num_threads=1)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _together(self, parts: list[str]) -> list[np.ndarray]:
        """The ids of each part, all encoded in one call."""
        if len(self.ends) and all(map(str.isalpha, parts)):
            # Each is one word, whose last id says that it ends.
            ids = np.array(self.library.encode(" ".join(parts), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(parts):
                return np.split(ids, stop[:-1])
        got = self.library.encode(parts, is_pretokenized=True, add_special_tokens=False)
        return np.split(np.array(got.ids, np.uint32), np.searchsorted(np.array(got.word_ids, np.int64), np.arange(1, len(parts))))

    def _encode(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each part by itself; words that are all letters go together."""
        texts = [p.decode() for p in parts]
        if len(self.ends):
            texts = [t.strip() for t in texts]
        letters = np.array([t.isascii() and t.isalpha() for t in texts], bool)
        out: list[np.ndarray] = [None] * len(texts)
        for some in (np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()):
            for a in range(0, len(some), TOGETHER):
                for k, ids in zip(some[a : a + TOGETHER], self._together([texts[k] for k in some[a : a + TOGETHER]])):
                    out[k] = ids
        return out

    def _cuttable(self, raw: bytes) -> bool:
        """Whether cutting before white space is certain to give the library's ids."""
        if any(s in raw for s in self.special):
            return False
        return not (_ODD_ASCII.search(raw) if raw.isascii() else _ODD_SPACE.search(raw.decode()))

    def lists(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of rows: the first row, the rows' ids one after the other, and the n + 1 places where rows begin and end. Null is empty."""
        for first, data, offsets in slices(texts, BLOCK_BYTES):
            held, n = data.tobytes(), len(offsets) - 1
            whole = np.ones(n, bool)
            if self.kind in ("bytes", "words"):
                whole = np.array([not self._cuttable(held[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], bool)
            kind = _KIND[data]
            begins = np.zeros(len(data) + 1, bool)
            begins[1 : len(data)] = _CUT[kind[:-1], kind[1:]]
            begins[offsets] = True
            starts = np.flatnonzero(begins[: len(data)])
            lengths = np.diff(np.append(starts, len(data)))
            row = np.searchsorted(offsets, starts, "right") - 1
            hashes = span_hashes(data, starts, lengths)
            cut = ~whole[row]
            if not cut.all():
                starts, lengths, row, hashes = starts[cut], lengths[cut], row[cut], hashes[cut]
            keys, one, same = np.unique(hashes, return_index=True, return_inverse=True)
            at = self.kept.find(keys)
            new = np.flatnonzero(at < 0)
            if len(new):
                of = one[new]
                self.kept.add(keys[new], self._encode([held[a : a + m] for a, m in zip(starts[of].tolist(), lengths[of].tolist())]))
                at = self.kept.find(keys)
            begin, size, pool = self.kept.begin[at][same], self.kept.size[at][same], self.kept.pool
            # Texts that stay whole come after the others.
            alone = np.flatnonzero(whole)
            if len(alone):
                ids = [np.frombuffer(self.whole(held[a:b].decode()), np.uint32) for a, b in zip(offsets[alone].tolist(), offsets[alone + 1].tolist())]
                sizes = np.array([len(x) for x in ids], np.int64)
                row, begin, size = np.append(row, alone), np.append(begin, len(pool) + np.cumsum(sizes) - sizes), np.append(size, sizes)
                pool = np.concatenate([pool, *ids])
                by = np.argsort(row, kind="stable")
                row, begin, size = row[by], begin[by], size[by]
            edge = np.append(0, np.cumsum(size))[np.searchsorted(row, np.arange(n + 1))]
            yield first, pool[spread(begin, size)], edge

    def ids(self, text: str) -> bytes:
        """The ids of one text, as ``whole`` gives them."""
        return b"".join(flat.tobytes() for _, flat, _ in self.lists(pa.array([text])))
