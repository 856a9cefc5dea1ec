"""Sequence packing by minimum bin slack.

A document's ids (its tokens and one end id) fill whole windows first; what remains, shorter than a window, goes to
a pool. A window takes the longest remainder of the pool, and a subset-sum over the other lengths, held as the bits
of one integer, finds the multiset that fills it closest to its capacity; the bits after each length are kept and
read backwards for how many of each length were taken. Ties go to longer lengths, then to the order of arrival.
At the end of a task the last gaps are closed by cutting remainders, and the rest is cut into powers of two, so
that no sequence needs padding. Each task packs what it reads: nothing is shuffled, and a pool holds at most
``POOL`` remainders, whatever the input's size.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each on their own; an empty table
gives no pieces; any other columns don't matter.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Remainders that wait at once, and distinct words at which a worker forgets the half that it met least.
POOL, REMEMBERED = 4096, 3 << 19
#: Words in a text that is encoded at once.
AT_ONCE = 256
#: A line is Latin letters that stay single letters in lower case, with or without a stop, which is a token of its own; or anything else.
LINES = re.compile("^(?:([A-Za-zÀ-ÖØ-öø-įı-ʯ]+)([.,!?;:]?)|(.*))$", re.M).findall


class Words(dict):
    """Numbers words as they come; ``fresh`` are those without ids yet, ``codes`` the ids of the others, ``uses`` how often each was met."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.codes: list[bytes] = []
        self.uses = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def count(self, numbers: list[list[int]]) -> None:
        met = np.bincount(np.fromiter(chain.from_iterable(numbers), np.int64), minlength=len(self))
        met[: len(self.uses)] += self.uses
        self.uses = met

    def forget(self) -> None:
        """Keeps the half that was met most, numbered anew; what it counted so far counts half."""
        self.count([])
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: len(self) // 2])
        names = list(self)
        names, self.codes = [names[i] for i in stay.tolist()], [self.codes[i] for i in stay.tolist()]
        self.clear()
        self.update(zip(names, range(len(names)), strict=True))
        self.uses = self.uses[stay] // 2


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The tokenizer at path, one of the same model for words of small letters, which tokens end a word, and the memory of words."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.normalizer = None
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    last = np.zeros(whole.get_vocab_size(), bool)
    last[[i for token, i in whole.get_vocab().items() if token.endswith("</w>")]] = True
    return whole, plain, last, Words()


def _encode_letters(words: list[str], plain, last: np.ndarray) -> Iterator[bytes]:
    """Ids of each word of small letters. Many are one text; a word's last token alone ends a word."""
    for at in range(0, len(words), AT_ONCE * 64):
        texts = [" ".join(words[i : i + AT_ONCE]) for i in range(at, min(at + AT_ONCE * 64, len(words)), AT_ONCE)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)), "<u4")
        raw, ends = ids.tobytes(), ((np.flatnonzero(last[ids]) + 1) * 4).tolist()
        yield from (raw[a:b] for a, b in zip([0, *ends], ends, strict=False))


def _encode_others(words: list[str], whole) -> Iterator[bytes]:
    """Ids of each word, which goes to the library alone: it may hold a special string."""
    for at in range(0, len(words), AT_ONCE * 64):
        for e in whole.encode_batch_fast(words[at : at + AT_ONCE * 64], add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()


def encode(texts: list[str], path: str, end: int, remembered: int = REMEMBERED) -> list[bytes]:
    """Each text's ids and the end id, as little-endian 32-bit integers. No token spans a blank: words are encoded once.

    Of a word of Latin letters, its lower case and its stop are encoded, which many words share.
    """
    whole, plain, last, words = _encoder(path)
    if len(words) > remembered:
        words.forget()
    numbers = [list(map(words.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]
    before = len(words.codes)
    lines = LINES("\n".join(words.fresh)) if words.fresh else []
    small = "\n".join([a for a, _, _ in lines]).lower().split("\n")
    made: dict[str, bytes] = {"": b""}
    for parts, coded in ((small, lambda new: _encode_letters(new, plain, last)), ([p for _, stop, odd in lines for p in (stop, odd)], lambda new: _encode_others(new, whole))):
        new = []
        for part in dict.fromkeys(parts):
            number = words.get(part, before)
            if number < before:
                made[part] = words.codes[number]
            elif part:
                new.append(part)
        made.update(zip(new, coded(new), strict=True))
    words.codes += [made[a] + made[stop] if a else made[odd] for a, (_, stop, odd) in zip(small, lines, strict=False)]
    words.fresh.clear()
    if len(words) > remembered // 2:
        words.count(numbers)
    close = np.array([end], "<u4").tobytes()
    return [b"".join(map(words.codes.__getitem__, n)) + close for n in numbers]


def fill(counts: dict[int, int], room: int) -> list[int]:
    """The multiset of the lengths in counts (length: how many) whose sum is as close to room as possible, not above it."""
    reach, history, limit, goal = 1, [], (1 << room + 1) - 1, 1 << room
    for length in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & limit
            if more == reach:
                break
            history.append((reach, length))
            reach = more
            if reach & goal:
                break
        if reach & goal:
            break
    left, taken = reach.bit_length() - 1, []
    for before, length in reversed(history):
        if not before >> left & 1:
            taken.append(length)
            left -= length
    return taken


class Packer:
    """Packs one task's documents; ``rows`` are pieces: key, start, length, bytes, document's ids, sequence, offset."""

    def __init__(self, window: int, first: int) -> None:
        self.window, self.next, self.rows = window, first, []
        self.pool: dict[int, deque] = defaultdict(deque)
        self.waiting = 0

    def add(self, key, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self._sequence([(key, start, self.window, ids[start * 4 : (start + self.window) * 4], total)])
        if total > whole:
            self._wait((key, whole, total - whole, ids[whole * 4 :], total))
            while self.waiting > POOL:
                self._window()

    def _wait(self, piece) -> None:
        self.pool[piece[2]].append(piece)
        self.waiting += 1

    def _take(self, length: int):
        piece = self.pool[length].popleft()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def _sequence(self, pieces) -> None:
        at = 0
        for p in pieces:
            self.rows.append((*p, self.next, at))
            at += p[2]
        self.next += 1

    def _cut(self, most: int):
        """A piece of at most that length from the longest remainder; its tail goes back to the pool."""
        key, start, length, ids, total = self._take(max(self.pool))
        if length > most:
            self._wait((key, start + most, length - most, ids[most * 4 :], total))
            length, ids = most, ids[: most * 4]
        return key, start, length, ids, total

    def _window(self, closing: bool = False) -> None:
        pieces = [self._take(max(self.pool))]
        pieces += [self._take(n) for n in fill({n: len(q) for n, q in self.pool.items()}, self.window - pieces[0][2])]
        room = self.window - sum(p[2] for p in pieces)
        while closing and room and self.waiting:
            pieces.append(self._cut(room))
            room -= pieces[-1][2]
        self._sequence(pieces)

    def finish(self) -> None:
        left = sum(n * len(q) for n, q in self.pool.items())
        while left >= self.window:
            self._window(closing=True)
            left = sum(n * len(q) for n, q in self.pool.items())
        for power in (1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1):
            pieces, room = [], power
            while room:
                pieces.append(self._cut(room))
                room -= pieces[-1][2]
            self._sequence(pieces)


def pack(documents: DataFrame, path: str, window: int = 2048, end: int = 1, id_column: str = "doc_id", column: str = "text", with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents in sequences of at most window ids: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, packed).

    ``remembered`` trades a worker's memory (some 250 bytes a word) for time; ids don't depend on it.
    """
    common.small_batches(documents)
    kind = documents.schema[id_column].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, keys = Packer(window, TaskContext.get().partitionId() << 33), None

        def out() -> pa.RecordBatch:
            key, start, length, ids, total, sequence, offset = zip(*packer.rows, strict=True)
            packer.rows = []
            columns = [pa.array(key, keys), *[pa.array(x, pa.int64()) for x in (start, length, [crc32(b) for b in ids], total, sequence, offset)]]
            return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids_le"] * with_ids)

        for batch in common.slices(batches, 4 << 20, column):
            keys = batch.column(id_column).type
            coded = encode([t or "" for t in batch.column(column).to_pylist()], path, end, remembered)
            for key, ids in zip(batch.column(id_column).to_pylist(), coded, strict=True):
                packer.add(key, ids)
            if packer.rows:
                yield out()
        packer.finish()
        if packer.rows:
            yield out()

    schema = f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids_le binary" * with_ids
    return documents.select(id_column, column).mapInArrow(go, schema)
