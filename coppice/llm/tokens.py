"""Token ids of whole Arrow columns of text: chunks between white space are encoded once a batch and gathered.

Holds for byte-level BPE files that split at white space, drop it, put letters into lower case and mark
the end of every piece: chunks between white space then never share a token.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of bytes in chunks that the fast engine encodes: letters (all bytes of two-byte ones too), digits, other marks; 0 is for no such chunk.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[ord("'")] = 0  # contractions are pieces of their own
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = 1
_KIND[48:58] = 2
#: Characters of those two-byte blocks that are no letters, or whose lower case is two.
_ODD = "×÷İŉ"
#: The byte that stands for the end of a piece, and the one between pieces; neither is in a plain chunk.
END, GAP = "\x02", "\x01"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept by this process."""
    return Encoder(path)


def strings(column: pa.Array) -> pa.StringArray:
    """The column as strings, null ones empty."""
    return pc.fill_null(column.cast(pa.string()), "")


@dataclass(frozen=True)
class Chunked:
    """Texts as chunks: ``distinct`` chunks, the place among them of each chunk in turn, and each text's first chunk."""

    distinct: pa.StringArray
    index: np.ndarray
    first: np.ndarray


def chunked(texts: pa.StringArray) -> Chunked:
    """Cuts texts at ASCII white space.

    Chunks share the column's bytes: each reaches to the next one's start, and white space
    is trimmed off the distinct ones.
    """
    n, at = len(texts), texts.offset
    _, offsets, data = texts.buffers()
    edge = np.frombuffer(offsets, np.int32)[at : at + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[: edge[-1]] if data is not None else np.zeros(0, np.uint8)
    held = raw[edge[0] :]
    space = _SPACE[held]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = edge[:-1][edge[:-1] < edge[1:]] - edge[0]
    begins[inner] |= ~space[inner]
    starts = np.flatnonzero(begins) + edge[0]
    if not len(starts):
        return Chunked(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(n + 1, np.int64))
    bounds = np.append(starts, edge[-1]).astype(np.int32)
    spread = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), data)
    coded = spread.dictionary_encode()
    # Chunks that differ only in the white space behind them are one.
    trimmed = pc.ascii_trim_whitespace(coded.dictionary).dictionary_encode()
    index = trimmed.indices.to_numpy()[coded.indices.to_numpy()]
    return Chunked(trimmed.dictionary, index, np.searchsorted(starts, edge))


@dataclass(frozen=True)
class Ids:
    """Token ids of some chunks, one after another: chunk k has ids[edge[k]:edge[k + 1]]."""

    ids: np.ndarray
    edge: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.edge)

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks in the order of ``index``, edges of those chunks)."""
        n = self.counts[index]
        edge = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.edge[index] - edge[:-1], n)
        at += np.arange(edge[-1])
        return self.ids[at], edge


class Encoder:
    """Encodes distinct chunks: plain ones by the file's merges in a fast engine, others by the tokenizer itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = self.tokenizer.encode(f"a {GAP} {GAP} a", add_special_tokens=False).ids
        if len(marks) != 4 or marks[1] != marks[2]:
            raise ValueError("the tokenizer has no token for the separator")
        self.mark = marks[1]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as f:
            tokens = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves in the file
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {}
        for token, i in tokens.items():
            body = token.removesuffix("</w>")
            if all(c in byte for c in body) and not token.startswith("<|"):
                ranks[bytes(byte[c] for c in body) + END.encode() * (body != token)] = i
        self.fast = tiktoken.Encoding("pieces", pat_str=f"[^{GAP}]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, chunks: pa.StringArray) -> Ids:
        """The ids of each chunk; chunks hold no white space."""
        if not len(chunks):
            return Ids(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        low = pc.utf8_lower(chunks)
        edge = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
        raw = np.frombuffer(low.buffers()[2], np.uint8)[: edge[-1]]
        kind = _KIND[raw]
        at = np.minimum.reduceat(kind, edge[:-1]) > 0
        two = raw > 0x7F
        if two.any():
            at &= ~pc.match_substring_regex(chunks, f"[{_ODD}]").to_numpy(zero_copy_only=False)
        at &= ~pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
        if at.all():
            return self._fast(raw, kind, edge)
        keep = np.repeat(at, np.diff(edge))
        sizes = np.diff(edge)[at]
        parts = (self._fast(raw[keep], kind[keep], np.concatenate([[0], np.cumsum(sizes)])), self._slow(chunks.filter(pa.array(~at))))
        n = len(sizes)
        place = np.empty(len(chunks), np.int64)
        place[at], place[~at] = np.arange(n), n + np.arange(len(chunks) - n)
        both = Ids(np.concatenate([p.ids for p in parts]), np.concatenate([parts[0].edge, parts[0].edge[-1] + parts[1].edge[1:]]))
        return Ids(*both.gather(place))

    def _fast(self, raw: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> Ids:
        """Plain chunks of bytes ``raw``: a piece ends where the kind of byte changes, behind each digit and with its chunk."""
        if not len(raw):
            return Ids(np.zeros(0, np.uint32), edge)
        last = np.empty(len(raw), bool)
        last[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
        last[edge[1:] - 1] = True
        done = np.cumsum(last)
        out = np.empty(len(raw) + 2 * done[-1], np.uint8)
        at = np.arange(len(raw))
        at += 2 * (done - last)
        out[at] = raw
        behind = at[last]
        out[behind + 1], out[behind + 2] = ord(END), ord(GAP)
        ids = np.array(self.fast.encode_ordinary(out.tobytes().decode("utf-8")), np.uint32)
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(ends) != done[-1] + 1:
            raise ValueError("the encoder joined pieces")
        return Ids(ids, ends[np.concatenate([[0], done[edge[1:] - 1]])])

    def _slow(self, chunks: pa.StringArray) -> Ids:
        words = chunks.to_pylist()
        out: list[np.ndarray | None] = [None] * len(words)
        odd = [i for i, c in enumerate(words) if GAP in c or "<|" in c]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        rest = sorted(set(range(len(words))).difference(odd))
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            joined = f" {GAP} ".join(words[i] for i in part)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            pieces = np.split(ids, np.flatnonzero(ids == self.mark))
            if len(pieces) != len(part):
                raise ValueError("the tokenizer joined chunks")
            for j, (i, x) in enumerate(zip(part, pieces)):
                out[i] = x[1:] if j else x  # all but the first begin with the separator
        return Ids(np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)]).astype(np.int64))


@dataclass(frozen=True)
class Coded:
    """A batch of texts: text k has ids[edge[k]:edge[k + 1]], the end id last; ``chunks`` and ``by_chunk`` it is made of."""

    ids: np.ndarray
    edge: np.ndarray
    chunks: Chunked
    by_chunk: Ids


def encode(texts: pa.Array, encoder: Encoder, end_id: int) -> Coded:
    """Ids of every text of a column and ``end_id`` behind each; null texts are empty."""
    c = chunked(strings(texts))
    own = encoder.encode(c.distinct)
    with_end = Ids(np.append(own.ids, np.uint32(end_id)), np.append(own.edge, own.edge[-1] + 1))
    index = np.insert(c.index, c.first[1:], len(c.distinct))  # the end is one more distinct chunk, behind each text
    ids, edge = with_end.gather(index)
    return Coded(ids, edge[c.first + np.arange(len(c.first))], c, own)


def lists(coded: Coded) -> pa.BinaryArray:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(coded.edge) - 1, [None, pa.py_buffer((4 * coded.edge).astype(np.int32)), pa.py_buffer(coded.ids.astype("<u4"))])
