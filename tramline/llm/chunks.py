"""Texts cut where byte-level and sentence-piece tokenizers never merge, so that each distinct chunk is encoded once.

A chunk begins at a space behind a character that is no white space.  A byte-level tokenizer starts a
pre-token there whatever stands before, and no sentence piece has a space behind another character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 32


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ("AZ", "az"):
        out[ord(first) : ord(last) + 1] = True
    return out


LETTER = _letters()


def _before(b: np.ndarray, at: np.ndarray, back: int) -> np.ndarray:
    return b[np.maximum(at - back, 0)]


def _white_ends(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is, in UTF-8, white space of any script or a separator."""
    one, two, three = (_before(b, at, k) for k in (1, 2, 3))
    ascii_white = (one <= SPACE) & ((one == SPACE) | ((one >= 9) & (one <= 13)) | (one >= 28))
    latin = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    ogham = (three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E)))
    general = (three == 0xE2) & (((two == 0x80) & ((one <= 0x8B) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))
    wide = (three == 0xE3) & (two == 0x80) & (one == 0x80)
    return ascii_white | ((one >= 0x80) & (latin | ogham | general | wide))


def split(texts: pa.Array, parts: bool = False, whole: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks of the texts, the number of the chunk at each place, and the chunks of each text.

    With ``parts``, chunks also end where a letter is followed by an ASCII character that is none (only
    for byte-level tokenizers).  Texts that hold one of the strings ``whole`` are one chunk.  Null and
    empty texts have none.
    """
    texts = pa.array([], pa.string()) if not len(texts) else texts.fill_null("").cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    low, high = offsets[0], offsets[-1]
    offsets = offsets - low
    if low == high:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    data = texts.buffers()[2].slice(int(low), int(high - low))
    b = np.frombuffer(data, np.uint8)
    mark = np.zeros(len(b), bool)
    at = np.flatnonzero(b[1:] == SPACE) + 1
    mark[at[~_white_ends(b, at)]] = True
    if parts:
        at = np.flatnonzero(~LETTER[b[1:]] & (b[1:] < 0x80) & (b[1:] != SPACE)) + 1
        one = _before(b, at, 1)
        mark[at[LETTER[one] | ((_before(b, at, 2) == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))]] = True
    for string in whole:
        for k in np.flatnonzero(pc.match_substring(texts, string).to_numpy(zero_copy_only=False)):
            mark[offsets[k] : offsets[k + 1]] = False
    mark[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(mark)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(b)).astype(np.int32)), data).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(np.searchsorted(starts, offsets))


def gather(pool: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The pieces ``of`` of a pool, one after the other, where piece k has ``lengths[k]`` entries."""
    starts, each = np.cumsum(lengths) - lengths, lengths[of]
    ends = np.cumsum(each)
    return pool[np.repeat(starts[of] - ends + each, each) + np.arange(ends[-1])] if len(of) else pool[:0]


class ByteCodes:
    """Ids of chunks by a byte-level tokenizer; ``special`` says whether its special tokens count inside texts."""

    def __init__(self, path: str, special: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.size = self.tokenizer.get_vocab_size()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = tuple(t.content for t in added.values()) if special else ()
        self.bytes = np.zeros(self.size, np.int64)  # of each id
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token.encode()) if i in added else len(token)

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, little-endian; those that begin with a space are encoded in long rows and cut again."""
        out: list[bytes] = [b""] * len(chunks)
        rows = [k for k, c in enumerate(chunks) if c[0] == " " and not c[-1].isspace() and len(c) < 1000]
        alone = set(range(len(chunks))).difference(rows)
        for at in range(0, len(rows), 5000):
            group = rows[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(chunks[k] for k in group)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter((len(chunks[k].encode()) for k in group), np.int64, len(group)))
            reached = np.cumsum(self.bytes[ids])
            cuts = np.searchsorted(reached, ends)
            if cuts[-1] == len(ids) - 1 and (reached[cuts] == ends).all():
                raw, last = ids.tobytes(), 0
                for k, cut in zip(group, (cuts + 1).tolist(), strict=True):
                    out[k] = raw[4 * last : 4 * cut]
                    last = cut
            else:
                alone.update(group)
        alone_list = sorted(alone)
        for k, ids in zip(alone_list, self._each([chunks[k] for k in alone_list]), strict=True):
            out[k] = ids
        return out
