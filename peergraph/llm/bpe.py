"""Byte-level BPE: encoding and decoding.

Texts are split by the vocabulary's pattern and each distinct piece of a block of documents is merged once,
in the JVM: a fold over the piece's byte ids replaces, step by step, the leftmost pair of lowest rank, which
it finds in a literal map of ranks. Blocks pass through one stage without a shuffle:

    Arrow function: split texts, number the distinct pieces     (docs, piece numbers, new pieces' byte ids)
    Spark expressions: fold ranked merges over the new pieces   (ids of each new piece)
    Arrow function: put each document's ids together

A piece is sent once in a task, so the fold's work follows the distinct pieces and not the tokens. Pieces that
are frequent in the whole corpus are encoded once for all tasks (``frequent``, at most ``HEAD`` of them,
which bounds what is broadcast); they are encoded by the same fold, so ids don't depend on that number.

Defined cases: null and empty texts have no ids; repeated rows and clashing names pass through unchanged
(the added columns replace columns of the same name); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documents' text in a block, in bytes.
BLOCK = 4 << 20
#: Most pieces that a task remembers before it starts anew.
REMEMBERED = 1 << 19
#: Most pieces that are encoded ahead and broadcast.
HEAD = 1 << 20
#: Slots of the literal rank map (a power of two: few enough to send to tasks quickly), and the shift that deals pairs to them.
SLOTS, SHIFT = 1 << 16, 11


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    """Pairs of ids whose bytes together are in the vocabulary, with the rank of the whole: a list of small maps."""
    known = ranks(path)
    slots: list[dict[int, int]] = [{} for _ in range(SLOTS)]
    for whole, rank in known.items():
        for i in range(1, len(whole)):
            a, b = known.get(whole[:i]), known.get(whole[i:])
            if a is not None and b is not None:
                pair = a << 16 | b  # as Spark's 32-bit integers have it: signed
                slots[(pair ^ pair >> SHIFT) % SLOTS][pair - (pair >> 31 << 32)] = rank
    return json.dumps(slots, separators=(",", ":"))


#: The basic plane without surrogates, and its first 128 characters.
BASIC, ASCII = ((0, 0xD800), (0xE000, 0x10000)), ((0, 0x80),)


@lru_cache(maxsize=64)
def _ranges(of: str, planes: tuple[tuple[int, int], ...]) -> str:
    """Those characters of a class of the regex library, as ranges for a class of the standard library."""
    import regex

    found = []
    for plane in planes:
        for m in regex.finditer(of + "+", "".join(map(chr, range(*plane)))):
            found.append(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}")
    return "".join(found)


def _basic(pattern: str, planes: tuple[tuple[int, int], ...] = BASIC) -> re.Pattern | None:
    """The pattern for the standard library, which is faster, right for texts of those characters; None if it has more than classes like \\p{L}, \\s and \\S, or one without such characters."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        step = re.compile(r"\\p\{\w+\}|\\.|.", re.S).match(pattern, at)[0]
        at += len(step)
        if step.startswith("\\p{") or step == "\\s":
            if not (among := _ranges(step, planes)):
                return None
            out += among if inside else f"[{among}]"
        elif step == "\\S" and not inside:
            out += f"[^{_ranges(chr(92) + 's', planes)}]"
        elif step[0] == "\\" and step[1].isalnum():
            return None
        else:
            inside = step == "[" or inside and step != "]"
            out += step
    try:
        return re.compile(out)
    except re.error:
        return None


def finder(pattern: str):
    """A function from a text to the list of its pieces."""
    import regex

    full, basic = regex.compile(pattern).findall, _basic(pattern)
    if basic is None:
        return full
    quick, beyond = basic.findall, re.compile("[\U00010000-\U0010ffff]").search
    plain = (_basic(pattern, ASCII) or basic).findall  # small classes are matched faster, and whether a text is ASCII is known
    return lambda text: plain(text) if text.isascii() else full(text) if beyond(text) else quick(text)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(pieces: Column, path: str) -> Column:
    """Ids of a piece (array of the ids of its single bytes), by the ranked merges of the vocabulary at path."""
    table = F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>").cast("array<map<int,int>>")

    def rank(pair: Column, i: Column) -> Column:
        """The pair's rank and, in the low half, its place: the least of these is the leftmost pair of lowest rank."""
        slot = pair.bitwiseXOR(F.shiftrightunsigned(pair, SHIFT)).bitwiseAND(F.lit(SLOTS - 1))
        return F.shiftleft(F.try_element_at(F.get(table, slot), pair).cast("bigint"), 32).bitwiseOR(i)

    def flip(ids: Column) -> Column:
        """Marks a piece as done, or takes the mark away: its first id is negative meanwhile."""
        return F.concat(F.array(-1 - F.get(ids, F.lit(0))), F.slice(ids, F.lit(2), F.size(ids)))

    def step(ids: Column, _: Column) -> Column:
        def merge(best: Column) -> Column:
            i = best.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
            whole = F.concat(F.slice(ids, F.lit(1), i), F.array(F.shiftright(best, 32).cast("int")), F.slice(ids, i + 3, F.size(ids)))
            return F.when(best.isNull(), flip(ids)).otherwise(whole)

        # the last id has no right neighbour: its pair is null and never the least
        pairs = F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), lambda a, b: F.shiftleft(a, 16).bitwiseOR(b))
        return F.when(F.get(ids, F.lit(0)) < 0, ids).otherwise(_let(F.array_min(F.transform(pairs, rank)), merge))

    steps = F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)))
    folded = F.aggregate(steps, pieces, step, lambda ids: F.when(F.get(ids, F.lit(0)) < 0, flip(ids)).otherwise(ids))
    return F.when(F.size(pieces) < 2, pieces).otherwise(folded)


class Ahead:
    """Pieces that were encoded ahead, as arrays: found by hash, then compared."""

    def __init__(self, pieces: pa.StringArray) -> None:
        from xxhash import xxh3_64_intdigest

        self.ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        whole = memoryview(pieces.buffers()[2] or b"")
        self.bytes = bytes(whole[self.ends[0] : self.ends[-1]])
        self.ends = self.ends - self.ends[0]
        own = memoryview(self.bytes)
        places = zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True)
        hashes = np.fromiter((xxh3_64_intdigest(own[a:b]) for a, b in places), np.uint64, len(pieces))
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """Each piece's number, or -1."""
        from xxhash import xxh3_64_intdigest

        if not len(self.hashes):
            return np.full(len(pieces), -1, np.int32)
        asked = np.array([xxh3_64_intdigest(p) for p in pieces], np.uint64)
        at = np.searchsorted(self.hashes, asked)
        at[at == len(self.hashes)] = 0
        number = np.where(self.hashes[at] == asked, self.order[at], -1).astype(np.int32)
        begin, end, whole = self.ends[number].tolist(), self.ends[number + 1].tolist(), self.bytes
        for i in np.flatnonzero(number >= 0).tolist():
            if whole[begin[i] : end[i]] != pieces[i]:
                number[i] = -1
        return number


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _byte_ids(coded: list[bytes], single: np.ndarray) -> pa.Array:
    ends = np.zeros(len(coded) + 1, np.int32)
    np.cumsum([len(c) for c in coded], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(single[np.frombuffer(b"".join(coded), np.uint8)]))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _single(path: str) -> np.ndarray:
    known = ranks(path)
    return np.array([known[bytes([i])] for i in range(256)], np.int32)


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def frequent(documents: DataFrame, path: str, pattern: str, column: str = "text", most: int = HEAD) -> pa.Table:
    """(piece, ids) of the most frequent pieces of all documents, at most ``most``, as counted word by word.

    Which pieces these are decides only how often a piece is encoded, not how. A histogram of the counts gives the count from
    which pieces are taken (of those at the bound, a share by hash): none is sorted, and no task holds them all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(pattern)
        words: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            seen = {" " + word: n for word, n in words.items() if word.isalpha()}
            get = seen.get
            for word, n in words.items():
                if not word.isalpha():
                    for piece in find(" " + word):
                        seen[piece] = get(piece, 0) + n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

        for batch in common.slices(batches, BLOCK, column):
            for text in _texts(batch, column):
                words.update(text.replace("\n", " ").split(" "))
            if len(words) > REMEMBERED:
                yield out()
        yield out()

    counted = common.cut(documents.select(column).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1"))
    bucket = F.floor(F.log2("n") * 32)  # 32 a doubling: small counts each have their own
    left, least, share = most, 0, 1.0
    for r in sorted(counted.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("pieces")).collect(), key=lambda r: -r.bucket):
        if r.pieces > left:
            least, share = r.bucket, 0.99 * left / r.pieces
            break
        left -= r.pieces
    some = F.pmod(F.xxhash64("piece"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    top = counted.where((bucket > least) | (bucket == least) & some).select("piece")
    single = F.array(*[F.lit(int(x)) for x in _single(path)])
    coded = F.hex(F.encode("piece", "UTF-8"))
    start = F.transform(F.sequence(F.lit(1), F.octet_length("piece")), lambda i: F.get(single, F.conv(F.substring(coded, i * 2 - 1, F.lit(2)), 16, 10).cast("int")))
    spread = top.repartition(24).select("piece", merged(start, path).alias("ids"))
    return spread.toArrow()


def encode(documents: DataFrame, path: str, pattern: str, column: str = "text", out: str = "ids_le", head: int = HEAD, decoded: str | None = None) -> DataFrame:
    """documents with ``out``: each text's ids as little-endian unsigned 32-bit integers (unpack: ``ids``); the text is not kept.

    With ``decoded``, a column of that name has the bytes that ``decode`` makes of the ids, made in the same stage.
    """
    spark = documents.sparkSession
    kept = [f for f in documents.schema.fields if f.name not in (column, out, decoded)]
    ahead = frequent(documents, path, pattern, column, head) if head else pa.table({"piece": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    lists = _whole(ahead.column("ids"))
    ends_ahead = (np.asarray(lists.offsets) - (lists.offsets[0].as_py() if len(lists) else 0)).astype(np.int32) * 4
    ids_ahead = spark.sparkContext.broadcast((np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4").tobytes(), ends_ahead))
    pieces_ahead = spark.sparkContext.broadcast(Ahead(_whole(ahead.column("piece"))))
    del ahead, lists
    common.give_back()
    single = _single(path)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, numbers = finder(pattern), Numbers()
        for batch in common.slices(batches, BLOCK, column):
            fresh = len(numbers) > REMEMBERED
            if fresh:
                numbers = Numbers()
            before, parts, lengths = len(numbers), [], []
            for text in _texts(batch, column):
                pieces = find(text)
                parts += map(numbers.__getitem__, pieces)
                lengths.append(len(pieces))
            new = [p.encode() for p in islice(numbers, before, None)]
            known = pieces_ahead.value.find(new)
            fold = _byte_ids([p for p, k in zip(new, known.tolist(), strict=True) if k < 0], single)
            rest = batch.select([f.name for f in kept])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_batch(rest)
            binary = [sink.getvalue().to_pybytes(), np.array(parts, np.int32).tobytes(), np.array(lengths, np.int32).tobytes(), known.tobytes()]
            yield pa.RecordBatch.from_arrays([*[pa.array([b]) for b in binary], pa.array([fresh]), pa.ListArray.from_arrays(pa.array([0, len(fold)], pa.int32()), fold)], ["rest", "parts", "lengths", "known", "fresh", "new"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat_ahead, at_ahead = ids_ahead.value
        coded: list[bytes] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("fresh")[0].as_py():
                    coded = []
                words = row.column("new").flatten()
                flat = np.ascontiguousarray(words.flatten().to_numpy(zero_copy_only=False), "<u4").tobytes()
                ends = ((np.asarray(words.offsets) - (words.offsets[0].as_py() if len(words) else 0)) * 4).tolist()
                folded = iter([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
                known = np.frombuffer(row.column("known")[0].as_py(), np.int32)
                begin, end = at_ahead[known].tolist(), at_ahead[known + 1].tolist()
                coded += [flat_ahead[a:b] if k >= 0 else next(folded) for k, a, b in zip(known.tolist(), begin, end, strict=True)]
                parts = np.frombuffer(row.column("parts")[0].as_py(), np.int32).tolist()
                at, packed = 0, []
                for n in np.frombuffer(row.column("lengths")[0].as_py(), np.int32).tolist():
                    packed.append(b"".join(map(coded.__getitem__, parts[at : at + n])))
                    at += n
                rest = pa.ipc.open_stream(row.column("rest")[0].as_py()).read_all().combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rest.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], [*rest.schema.names, out])

    def join_and_decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoder(path, out, decoded)(join(batches))

    blocks = documents.select(*[F.col(f"`{f.name}`") for f in kept], column).mapInArrow(split, "rest binary, parts binary, lengths binary, known binary, fresh boolean, new array<array<int>>")
    folded = blocks.select("rest", "parts", "lengths", "known", "fresh", F.transform("new", lambda p: merged(p, path)).alias("new"))
    schema = T.StructType([*kept, *[T.StructField(c, T.BinaryType()) for c in (out, decoded) if c]])
    return folded.mapInArrow(join_and_decode if decoded else join, schema)


def ids(packed: Column | str) -> Column:
    """The ids of a packed column as an array of integers."""

    @F.pandas_udf("array<int>")
    def unpack(values):
        return values.map(lambda b: None if b is None else np.frombuffer(b, "<u4").astype(np.int32))

    return unpack(packed)


def _decoder(path: str, column: str, out: str):
    """A function that adds to Arrow batches, as ``out``, the concatenated binary pieces of each row's ids."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks(path)
        pieces = [b""] * (max(known.values()) + 1)
        for piece, i in known.items():
            pieces[i] = piece
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = [b"".join(map(pieces.__getitem__, np.frombuffer(b or b"", "<u4").tolist())) for b in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, out])

    return go


def decode(encoded: DataFrame, path: str, column: str = "ids_le", out: str = "decoded") -> DataFrame:
    """encoded with ``out``: the bytes that each row's packed ids stand for. Null ids have no bytes."""
    rows = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != out])
    return rows.mapInArrow(_decoder(path, column, out), T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))
