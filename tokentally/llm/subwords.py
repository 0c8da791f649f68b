"""Subword ids of whole texts through the ``tokenizers`` library, one encoding per distinct piece.

A byte-level tokenizer cuts a text before every white-space run that follows a
solid character, and no token crosses such a cut.  A text is therefore the
sequence of pieces ``white space* solid+`` (and perhaps a white-space tail),
and the ids of the text are those of its pieces.  Punctuation after an ASCII
letter is a piece too, as no token spans letters and the punctuation after them.  Pieces are found and told
apart by numpy on the bytes; a bounded cache holds the ids of those seen, so
the library encodes each distinct piece once per worker.  The cut is made only
where it is safe: never after a Unicode white-space character beyond ASCII.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tokentally.llm import textops

#: Distinct pieces kept per Python worker; beyond, the cache starts anew.
CACHE_PIECES = 1_200_000
#: Characters that the library encodes in one call.
JOINED_CHARS = 1 << 12
#: Punctuation that may be parted from an ASCII letter before it.
_POINTS = b".,;:!?)"
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[65:91, 97:123]] = True


def piece_starts(raw: np.ndarray, off: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every piece, and the n+1 piece offsets of the texts; ``point``: bytes cut off a letter."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = textops.SPACE[raw]
    cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    last = raw[cut - 1]
    # a multi-byte character before the cut may be Unicode white space
    two, three = raw[np.maximum(cut - 2, 0)], raw[np.maximum(cut - 3, 0)]
    cut = cut[~((last >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))]
    begins = np.zeros(len(raw), bool)
    begins[cut] = True
    begins[1:] |= point[raw[1:]] & _LETTER[raw[:-1]]
    begins[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, off)


class PieceEncoder:
    """Ids of texts, with a bounded cache of pieces held as flat arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # bytes that each id stands for: one character of a byte-level token is one byte
        self.id_bytes = np.zeros(self.vocab_size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.id_bytes[i] = len(token)
        for i, added in self.tokenizer.get_added_tokens_decoder().items():
            self.id_bytes[i] = len(added.content.encode())
        # a cut must not part an added token
        inside = set(b"".join(a.content.encode() for a in self.tokenizer.get_added_tokens_decoder().values()))
        self.point = np.zeros(256, bool)
        self.point[[c for c in _POINTS if c not in inside]] = True
        self.tokenizer.model._resize_cache(0)  # the pieces are cached here
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)     # sorted piece hashes
        self.rows = np.zeros(0, np.int64)      # their rows below
        self.length = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)]
        return (np.fromiter((x for y in ids for x in y), np.int32),
                np.fromiter(map(len, ids), np.int64, len(ids)))

    def _joined(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that start with white space and end solid, many in one call."""
        flats, counts, i = [], [], 0
        while i < len(found):
            j, size = i, 0
            while j < len(found) and (j == i or size < JOINED_CHARS):
                size += len(found[j])
                j += 1
            ids = np.array(self._ids("".join(found[i:j])), np.int32)
            ends = np.cumsum(self.id_bytes[ids])
            want = np.cumsum([len(p.encode()) for p in found[i:j]])
            at = np.searchsorted(ends, want)
            if len(ends) and at[-1] < len(ends) and np.array_equal(ends[at], want):
                counts.append(np.diff(at, prepend=-1))
            else:  # a tokenizer whose ids don't stand for bytes
                ids, n = self._each(found[i:j])
                counts.append(n)
            flats.append(ids)
            i = j
        return np.concatenate(flats), np.concatenate(counts)

    def _add(self, keys: np.ndarray, found: list[bytes]) -> None:
        texts = [p.decode() for p in found]
        plain = np.array([p[0] in b" \t\n\x0b\x0c\r" and not t[-1].isspace() for p, t in zip(found, texts)], bool)
        for group, encode in ((plain, self._joined), (~plain, self._each)):
            if not group.any():
                continue
            flat, n = encode([texts[i] for i in np.flatnonzero(group)])
            base = len(self.length)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
            self.length = np.concatenate([self.length, n])
            self.flat = np.concatenate([self.flat, flat])
            self.keys = np.concatenate([self.keys, keys[group]])
            self.rows = np.concatenate([self.rows, np.arange(base, base + len(n))])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.rows = self.keys[order], self.rows[order]

    def piece_rows(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cache row of each piece, encoding those not seen before."""
        keys, first, back = np.unique(textops.hash_spans(raw, starts, ends), return_index=True, return_inverse=True)

        def known():
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

        at, have = known()
        if not have.all():
            if len(self.keys) + (~have).sum() > CACHE_PIECES and len(self.keys):
                self._reset()
                at, have = known()
            missing = first[~have]
            self._add(keys[~have], [raw[s:e].tobytes() for s, e in zip(starts[missing], ends[missing])])
            at, have = known()
        return self.rows[at][back]

    def encode_spans(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the spans (sorted, disjoint), flat, and the number of ids of each."""
        if len(starts) == 0:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        row = self.piece_rows(raw, starts, ends)
        lengths = self.length[row]
        return self.flat[textops.ragged(self.start[row], lengths)], lengths

    def encode_bytes(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, flat, and the number of ids of each text."""
        starts, piece_off = piece_starts(raw, off, self.point)
        ids, lengths = self.encode_spans(raw, starts, np.append(starts[1:], len(raw))[:len(starts)])
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[piece_off])

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_bytes(*textops.utf8(pa.array(texts, pa.large_string())))


class RankEncoder(PieceEncoder):
    """The same for a file of byte-pair ranks, through ``tiktoken``."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokenizer = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                           special_tokens={})
        self.vocab_size = max(ranks.values()) + 1
        self.id_bytes = np.zeros(self.vocab_size, np.int64)
        self.begins = np.zeros(self.vocab_size, bool)      # ids that start with a space
        for token, i in ranks.items():
            self.id_bytes[i] = len(token)
            self.begins[i] = token.startswith(b" ")
        self._reset()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_ordinary(text)

    def _each(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode_ordinary(t) for t in found]
        return (np.fromiter((x for y in ids for x in y), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)))


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    """The worker's encoder for a file of ranks."""
    return RankEncoder(path)


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; the path must be readable on every executor (it is installed software)."""
    return PieceEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
