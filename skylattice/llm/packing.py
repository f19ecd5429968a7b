"""Packing by vector bin packing with the dot-product heuristic.

A bin (sequence) has limits on tokens, segments and loss-bearing tokens.  Among the
items that still fit, the next one is that with the largest dot product of its demand
and the bin's remaining capacity, both as shares of the limits.  Where cutting is
allowed, a bin that nothing fits is closed with the head of the item of the largest
product, so that it ends full.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, schema, utf8_column


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


#: Documents: a piece has a token at least, so that the number of segments is no limit of its own.
DOCUMENTS = Limits(segments=1024)


class Packer:
    """Packs a stream of items; bins are lists of (item, start, length).

    ``pool`` items wait at once, which bounds memory.  Items of the same demand form a
    class, so that a choice costs as much as there are classes.
    """

    def __init__(self, limits: Limits = Limits(), cut: bool = False, pool: int = 2048):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.limit = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.count = self.tokens = 0
        self.bins: list = []
        self._forget()

    def _forget(self) -> None:
        self.index: dict = {}
        self.stacks: list = []
        self.need = np.zeros((64, 3))
        self.amount = np.zeros(64, np.int64)

    def add(self, item, tokens: int, loss: int | None = None) -> None:
        """``loss``: loss-bearing tokens, all of them if not given (as they must be where items are cut)."""
        loss = tokens if loss is None else loss
        if not self.cut and (tokens > self.limits.tokens or loss > self.limits.loss):
            raise ValueError(f"item {item} of {tokens} tokens exceeds the limits and may not be cut")
        start, most = 0, min(self.limits.tokens, self.limits.loss) if self.cut else self.limits.tokens + 1
        while tokens - start >= most:
            self.bins.append([(item, start, most)])
            start += most
        if tokens > start:
            self._wait(item, start, tokens - start, loss - start)
        if self.count >= self.pool:
            while self.count > self.pool // 2:
                self.bins.append(self._fill(self.limits.tokens))

    def _wait(self, item, start: int, tokens: int, loss: int) -> None:
        k = self.index.get((tokens, loss))
        if k is None:
            if len(self.stacks) > 4 * self.pool:  # classes that are used no more
                kept = [(key, self.stacks[i]) for key, i in self.index.items() if self.stacks[i]]
                self._forget()
                for key, stack in kept:
                    self._class(key, stack)
            k = self._class((tokens, loss), [])
        self.stacks[k].append((item, start))
        self.amount[k] += 1
        self.count += 1
        self.tokens += tokens

    def _class(self, key: tuple[int, int], stack: list) -> int:
        k = self.index[key] = len(self.stacks)
        self.stacks.append(stack)
        if k == len(self.need):
            self.need = np.vstack([self.need, np.zeros_like(self.need)])
            self.amount = np.concatenate([self.amount, np.zeros_like(self.amount)])
        self.need[k] = (key[0], 1, key[1])
        self.amount[k] = len(stack)
        return k

    def _fill(self, capacity: int) -> list:
        left = np.array([capacity, self.limits.segments, min(self.limits.loss, capacity)], float)
        out = []
        while left[0] > 0 and left[1] > 0 and self.count:
            n = len(self.stacks)
            need, there = self.need[:n], self.amount[:n] > 0
            product = need @ (left / self.limit**2)
            fits = there & (need[:, 0] <= left[0]) & (need[:, 2] <= left[2])
            if self.cut and left[1] == 1:  # the last segment should fill the bin
                fits &= need[:, 0] == left[0]
            choice = np.where(fits, product, -1.0)
            k = int(choice.argmax())
            if choice[k] < 0:
                if not self.cut:
                    break
                choice = np.where(there & (need[:, 0] > left[0]), product, -1.0)
                k = int(choice.argmax())
                if choice[k] < 0:
                    k = int(np.where(there, product, -1.0).argmax())
            tokens, loss = int(need[k, 0]), int(need[k, 2])
            length = min(tokens, int(left[0]), int(left[2]) if self.cut else tokens)
            item, start = self.stacks[k].pop()
            self.amount[k] -= 1
            self.count -= 1
            self.tokens -= tokens
            out.append((item, start, length))
            left -= (length, 1, loss if length == tokens else length)
            if length < tokens:
                self._wait(item, start + length, tokens - length, loss - length)
        return out

    def taken(self) -> list:
        bins, self.bins = self.bins, []
        return bins

    def close(self, powers: bool = False) -> list:
        """Pack what waits.  ``powers``: end with sequences as long as powers of two, which need no padding."""
        while self.count:
            short = powers and self.cut and self.tokens < self.limits.tokens
            self.bins.append(self._fill(1 << (self.tokens.bit_length() - 1) if short else self.limits.tokens))
        return self.taken()


_TOKENIZERS: dict = {}


def tokenizer(name: str):
    """(exact, quick): ids of a text by a public byte-level BPE; loaded once per process.

    ``name`` is that of the JSON file; the rank file of the same vocabulary beside it gives
    the same ids several times faster.  The added tokens of the JSON file have their own ids in a text too.
    ``quick`` splits without the look-ahead for white space before white space and may be
    used where a text has no two adjacent white-space characters; there both agree.
    """
    if name not in _TOKENIZERS:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name.removesuffix(".json") + ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(name), "rb") as text:
            added = json.load(text)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{name} has added tokens that depend on what is beside them")
        special = {t["content"]: t["id"] for t in added}

        def encoder(k, pattern):
            e = tiktoken.Encoding(f"{name} {k}", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            return lambda text: e.encode(text, allowed_special="all") if any(t in text for t in special) else e.encode_ordinary(text)

        patterns = (public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""))
        _TOKENIZERS[name] = tuple(encoder(k, p) for k, p in enumerate(patterns))
    return _TOKENIZERS[name]


def with_adjacent_space(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Texts of a UTF-8 column that may hold two adjacent white-space characters.

    Two adjacent bytes up to 32, or the first bytes of any white space beyond ASCII.
    """
    if len(data) < 2:
        return set()
    a, b = data[:-1], data[1:]
    low = (a <= 32) & (b <= 32)
    high = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    return set((np.searchsorted(offsets, np.flatnonzero(low | high), "right") - 1).tolist())


PIECE = schema(("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("ids", "array<int>"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_name: str = "byte_bpe_50k.json", limits: Limits = DOCUMENTS, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document, with the sequence and the offset that it has there.

    A document is the ids of its text (null: empty) and ``end_id``; all tokens bear loss and it may be cut
    anywhere.  Every input partition packs its own rows in one pass without a shuffle, so
    the work is spread as the input is, whatever the keys; a partition's last tokens end
    in sequences of a power of two.  sequence_id holds the partition's number in its upper bits and
    agrees when a lost task is run again.  Very long texts give full sequences as they come;
    repeated rows are packed as rows; an empty table gives an empty result; columns of other names are ignored.
    """

    def run(batches):
        from pyspark import TaskContext

        exact, quick = tokenizer(tokenizer_name)
        first = TaskContext.get().partitionId() << 36
        packer = Packer(limits, cut=True)
        held: dict[int, list] = {}  # serial: [doc_id, ids, tokens not yet placed]
        sequence = serial = 0

        def rows(bins):
            nonlocal sequence
            out = []
            for pieces in bins:
                offset = 0
                for item, start, length in pieces:
                    doc = held[item]
                    ids = doc[1][start : start + length]
                    out.append((doc[0], start, length, zlib.crc32(ids.tobytes()), len(doc[1]), first + sequence, offset, ids.astype(np.int32) if with_ids else None))
                    offset += length
                    doc[2] -= length
                    if not doc[2]:
                        del held[item]
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 7 + [pa.list_(pa.int32())])], PIECE.names)

        for batch in in_slices(batches):
            odd = with_adjacent_space(*utf8_column(batch.column(1)))
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids = (exact if k in odd else quick)(text or "")
                ids.append(end_id)
                held[serial] = [doc_id, np.array(ids, "<u4"), len(ids)]
                packer.add(serial, len(ids))
                serial += 1
            yield rows(packer.taken())
        yield rows(packer.close(powers=True))

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, PIECE)


def pack_examples(examples: DataFrame, limits: Limits, key_col: str = "conv_id", tokens_col: str = "tokens", loss_col: str = "loss_tokens") -> DataFrame:
    """Instruction data: (key, sequence_id, offset, length) for examples that are never cut.

    An example above the limits on its own fails with its key; nulls in the counts are 0.  An empty table gives no rows; of very long examples only the
    counts are read; repeated rows are packed as rows; columns of other names are ignored.
    """
    out = schema(("key", "string"), ("sequence_id", "long"), ("offset", "long"), ("length", "long"))

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        packer, sequence = Packer(limits), 0

        def rows(bins):
            nonlocal sequence
            found = []
            for pieces in bins:
                offset = 0
                for key, _, length in pieces:
                    found.append((key, first + sequence, offset, length))
                    offset += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate([pa.string()] + [pa.int64()] * 3)], out.names)

        for batch in batches:
            for key, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(key, tokens or 0, loss or 0)
            yield rows(packer.taken())
        yield rows(packer.close())

    plain = examples.select(F.col(key_col).cast("string").alias("key"), F.col(tokens_col).cast("long").alias("t"), F.col(loss_col).cast("long").alias("l"))
    return plain.mapInArrow(run, out)
