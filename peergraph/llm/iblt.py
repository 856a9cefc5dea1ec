"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs: lines, again after sentence stops, and what is still longer than ``LONG`` characters at words
(or characters) that a hash of theirs chooses, so that long texts without stops have several too. Each
paragraph's digest, which also counts its earlier occurrences in the text, is added to three cells of a small table:
how many, the sum of digests, the sum of their checks. Two versions' fingerprints subtract cell by cell; what they share
cancels, and peeling reads the differing digests from cells that hold one. If peeling gets stuck, both versions are
sketched again with four times the cells; should that still fail at ``MOST`` cells for each paragraph, the digests
themselves are compared. Likeness is the share of paragraphs in both among those in either.

All documents of a block are sketched and peeled together in numpy. Defined cases: a null text is empty; an empty
text has no paragraphs and an all-zero sketch; two empty texts are alike (1.0); equal texts have equal fingerprints;
other columns don't matter, whatever their names; an empty table gives an empty result. ``against_next`` takes ids
that are whole numbers.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U = np.uint64
#: Cells of the stored fingerprint (a multiple of 3), and how much larger each retry is.
CELLS, GROW = 24, 4
#: Characters of a paragraph above which it is cut further; of a run, words (or characters) that end one at the latest.
LONG, RUN = 400, 64
#: Cells for each paragraph at which peeling is given up.
MOST = 64
#: Bytes of text in a range of ids, and most ranges (their bounds are broadcast, 24 bytes each).
PART, MOST_PARTS = 12 << 20, 1 << 20
#: Cells that are peeled at once.
AT_ONCE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _runs(units: Iterable[str], joint: str) -> list[str]:
    """units joined to runs, each of which ends with a unit that its hash chooses, or is RUN units long."""
    parts, run = [], []
    for unit in units:
        run.append(unit)
        if len(run) > 3 and crc32(unit.encode()) % 16 == 0 or len(run) == RUN:
            parts.append(joint.join(run))
            run = []
    return [*parts, joint.join(run)] if run else parts


def _shorter(long: str) -> list[str]:
    """long, cut into runs of words, and words that are themselves long into runs of characters."""
    parts: list[str] = []
    for is_long, words in groupby(long.split(" "), lambda w: len(w) > LONG):
        parts += [r for w in words for r in _runs(w, "")] if is_long else _runs(words, " ")
    return [p for p in parts if p]


def paragraphs(text: str) -> list[str]:
    cut = text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")
    return [q for p in cut if p for q in ((p,) if len(p) <= LONG else _shorter(p))]


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all texts' paragraphs, and where each text's begin (one more at the end)."""
    from xxhash import xxh64_intdigest

    found, ends = [], [0]
    for t in texts:
        found += [xxh64_intdigest(p) for p in paragraphs(t)]
        ends.append(len(found))
    raw, at = np.array(found, U), np.array(ends)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((raw, owner))
    new = np.ones(len(raw), bool)
    new[1:] = (raw[order][1:] != raw[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    place = np.arange(len(raw))
    nth = np.empty(len(raw), U)
    nth[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(U)
    return _mix(raw + nth * U(0x9E3779B97F4A7C15)), at


def _cells(digest: np.ndarray, cells: int) -> np.ndarray:
    """Three cells of each digest, one in each third of the table."""
    third = cells // 3
    return np.stack([_mix(digest + U(7919 * (j + 1))) % U(third) + U(third * j) for j in range(3)]).astype(np.int64)


def _check(digest: np.ndarray) -> np.ndarray:
    return _mix(digest ^ U(0x5851F42D4C957F2D)) >> U(32)


class Sketches:
    """Tables of n texts: counts, sums of digests, sums of checks, each n x cells."""

    def __init__(self, n: int, cells: int) -> None:
        self.cells = cells
        self.count = np.zeros(n * cells, np.int64)
        self.key, self.check = np.zeros(n * cells, U), np.zeros(n * cells, U)

    def add(self, digest: np.ndarray, owner: np.ndarray, times: np.ndarray) -> None:
        at = (_cells(digest, self.cells) + owner * self.cells).ravel()
        sign = np.tile(times, 3)
        np.add.at(self.count, at, sign)
        np.add.at(self.key, at, np.tile(digest, 3) * sign.view(U))
        np.add.at(self.check, at, np.tile(_check(digest), 3) * sign.view(U))

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def strings(self) -> list[str]:
        rows = np.empty(len(self.count), [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
        rows["count"], rows["key"], rows["check"] = self.count, self.key, self.check & U(0xFFFFFFFF)
        width = rows.itemsize * self.cells
        raw = rows.tobytes()
        return [base64.b64encode(raw[i : i + width]).decode() for i in range(0, len(raw), width)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Differing (digest, owner, sign), and for each text whether all were recovered."""
        keys, owners, signs = [], [], []
        while True:
            one = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[one]
            key = self.key[one] * sign.view(U)
            pure = _check(key) == self.check[one] * sign.view(U)
            key, owner, sign = key[pure], one[pure] // self.cells, sign[pure]
            if not len(key):
                break
            order = np.lexsort((key, owner))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            take = order[new]
            keys.append(key[take]), owners.append(owner[take]), signs.append(sign[take])
            self.add(key[take], owner[take], -sign[take])
        clean = ~((self.count != 0) | (self.key != 0)).reshape(-1, self.cells).any(axis=1)
        none = np.empty(0, np.int64)
        return np.concatenate([none.astype(U), *keys]), np.concatenate([none, *owners]), np.concatenate([none, *signs]), clean


def _rows_of(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows' digests, and the number of each one's row among rows."""
    size = at[rows + 1] - at[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(owner)) + np.repeat(at[rows] - np.r_[0, np.cumsum(size)[:-1]], size), owner


def sketch(of: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> Sketches:
    digest, at = of
    out = Sketches(len(at) - 1, cells)
    out.add(digest, np.repeat(np.arange(len(at) - 1), np.diff(at)), np.ones(len(digest), np.int64))
    return out


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], of_a: Sketches, of_b: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, row, sign) of what only a's (1) or only b's (-1) rows have: from their sketches, and where these don't tell, from larger ones."""
    rows, cells = np.arange(len(a[1]) - 1), of_a.cells
    out: list[list[np.ndarray]] = [[np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]

    def peeled(table: Sketches, part: np.ndarray) -> np.ndarray:
        """The rows of part that stay unknown."""
        key, owner, sign, clean = table.peel()
        good = clean[owner]
        for column, found in zip(out, (key[good], part[owner[good]], sign[good]), strict=True):
            column.append(found)
        return part[~clean]

    rows = peeled(of_a.minus(of_b), rows)
    while len(rows):
        cells *= GROW
        sizes = (np.diff(a[1]) + np.diff(b[1]))[rows]
        failed = []
        for row in rows[cells > sizes * MOST + MOST].tolist():
            own = [Counter(digest[at[row] : at[row + 1]].tolist()) for digest, at in (a, b)]
            for left, sign in ((own[0] - own[1], 1), (own[1] - own[0], -1)):
                found = np.array(list(left.elements()), U)
                for column, values in zip(out, (found, np.full(len(found), row), np.full(len(found), sign)), strict=True):
                    column.append(values)
        rows = rows[cells <= sizes * MOST + MOST]
        for begin in range(0, len(rows), max(1, AT_ONCE // cells)):
            part = rows[begin : begin + max(1, AT_ONCE // cells)]
            table = Sketches(len(part), cells)
            for (digest, at), sign in ((a, 1), (b, -1)):
                place, owner = _rows_of(at, part)
                table.add(digest[place], owner, np.full(len(place), sign, np.int64))
            failed.append(peeled(table, part))
        rows = np.concatenate([np.empty(0, np.int64), *failed])
    return tuple(np.concatenate(c) for c in out)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], of_a: Sketches | None = None, of_b: Sketches | None = None) -> np.ndarray:
    """Shared paragraphs over paragraphs in either, row by row, from the sketches of a and b; 1.0 where neither has any."""
    _, row, sign = differing(a, b, of_a or sketch(a), of_b or sketch(b))
    n = len(a[1]) - 1
    only_a, only_b = np.bincount(row[sign > 0], minlength=n), np.bincount(row[sign < 0], minlength=n)
    shared = np.diff(a[1]) - only_a
    either = shared + only_a + only_b
    return np.where(either == 0, 1.0, shared / np.maximum(either, 1))


def fingerprints(documents: DataFrame, column: str = "text", cells: int = CELLS, out: str = "fingerprint") -> DataFrame:
    """documents with the sketch of the text as a string instead of the text."""
    from pyspark.sql import types as T

    common.small_batches(documents)
    kept = [f for f in documents.schema.fields if f.name not in (column, out)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1 << 20, column):
            found = sketch(digests([t or "" for t in batch.column(column).to_pylist()]), cells).strings()
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(found, pa.string())], [*[f.name for f in kept], out])

    return documents.select(*[F.col(f"`{f.name}`") for f in kept], column).mapInArrow(go, T.StructType([*kept, T.StructField(out, T.StringType())]))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: A row's place: id (null: the least, last), hash of the text, and a number that deals copies of a row to several ranges.
PLACE = ("id", "h", "salt")


def _cuts(rows: DataFrame) -> np.ndarray:
    """Places (n x 3) that cut the rows into ranges of some PART bytes, read off a sample of some 50 rows a range."""
    size = F.octet_length("text") + 64
    n, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = min(max(1, n_bytes // PART), MOST_PARTS)
    if parts == 1:
        return np.empty((0, 3), np.int64)
    some = rows.sample(min(1.0, parts * 50 / n), seed=5).select(*PLACE, size.alias("size")).toArrow()
    place = np.stack([some.column(c).to_numpy() for c in PLACE], axis=1)
    order = np.lexsort(place.T[::-1])
    far = np.cumsum(some.column("size").to_numpy()[order])
    return np.unique(place[order[np.searchsorted(far, far[-1] * np.arange(1, parts) / parts)]], axis=0) if len(far) else place


def _part(place: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The range of each place: how many cuts are at or before it."""
    low, high = np.searchsorted(cuts[:, 0], place[:, 0], "left"), np.searchsorted(cuts[:, 0], place[:, 0], "right")
    for i in np.flatnonzero(low < high).tolist():  # cuts within one id
        low[i] += bisect_right(list(map(tuple, cuts[low[i] : high[i], 1:].tolist())), tuple(place[i, 1:].tolist()))
    return low


def against_next(documents: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document, by descending id (after the last: the first).

    Documents are dealt to ranges of ids; the first document of each range also goes, as a guest, to the range before
    it. So every document meets its successor with one shuffle and no task holds more than a range. Rows of the same
    id follow each other by descending hash of the text; null ids come last, as one id. Neither an id nor a row that is
    repeated very often lands in one task: ranges may be cut within an id, and within copies of a row, whose successor is
    a copy.
    """
    import zstandard

    common.small_batches(documents)
    spark, least = documents.sparkSession, -(1 << 63)
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    rows = documents.select(F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(least)).alias("id"), F.col(f"`{id_column}`").isNotNull().alias("known"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    cuts = spark.sparkContext.broadcast(_cuts(rows))

    def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        place = np.stack([batch.column(c).to_numpy() for c in PLACE], axis=1)
        return place, _part(place, cuts.value)

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place, part = placed(batch)
                order = np.lexsort((place[:, 1], place[:, 0], part))
                last = np.flatnonzero(np.diff(part[order], append=-1))
                first = np.r_[0, last[:-1] + 1]
                yield pa.RecordBatch.from_arrays([pa.array(part[order[last]]), *[pa.array(place[order[at], k]) for at in (last, first) for k in (0, 1)]], ["part", "head", "head_h", "tail", "tail_h"])

    ends = rows.select(*PLACE).mapInArrow(ends_of, "part long, head long, head_h long, tail long, tail_h long")
    found = ends.groupBy("part").agg(F.max(F.struct("head", "head_h")).alias("head"), F.min(F.struct("tail", "tail_h")).alias("tail")).collect()
    ranges = sorted((r.part, tuple(r.head), tuple(r.tail)) for r in found)
    # a range's head is a guest of the range above it, and that of the highest, which is the very first document, of the lowest
    before = [(head, ranges[(i + 1) % len(ranges)]) for i, (_, head, _) in enumerate(ranges)]
    guests = spark.sparkContext.broadcast({head: part for head, (part, _, tail) in before if tail != head or len(ranges) == 1})
    heads = spark.sparkContext.broadcast(np.unique(np.array([head[0] for head, _ in before], np.int64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()  # a head that is repeated is a guest once in a task
        for batch in common.slices(batches, 4 << 20):
            place, part = placed(batch)
            own, guest, to = list(range(len(part))), [], []
            near = np.searchsorted(heads.value, place[:, 0])
            for i in np.flatnonzero(heads.value[np.minimum(near, len(heads.value) - 1)] == place[:, 0]).tolist():
                key = (int(place[i, 0]), int(place[i, 1]))
                if key in guests.value and key not in sent:
                    sent.add(key)
                    guest.append(i)
                    to.append(guests.value[key])
            to = np.concatenate([part, np.array(to, np.int64)])
            whole = batch.select(["id", "known", "h", "text"]).take(pa.array(own + guest))
            whole = pa.Table.from_batches([whole]).append_column("guest", pa.array([False] * len(own) + [True] * len(guest)))
            order = np.argsort(to, kind="stable")
            for rows_of in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema) as w:
                    w.write_table(whole.take(pa.array(rows_of)))
                blob = zstandard.compress(sink.getvalue().to_pybytes(), 3)
                yield pa.RecordBatch.from_arrays([pa.array([int(to[rows_of[0]])]), pa.array([blob], pa.binary())], ["part", "blob"])

    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(table: pa.Table) -> pa.Table:
        docs, extra = [], []
        for blob in table.column("blob").to_pylist():
            held = pa.ipc.open_stream(zstandard.decompress(blob)).read_all()
            for *row, guest in zip(*[held.column(c).to_pylist() for c in ("id", "known", "h", "text", "guest")], strict=True):
                (extra if guest else docs).append(tuple(row))
        docs.sort(key=lambda r: (r[0], r[1], r[2], r[3]), reverse=True)
        chain = [d[3] for d in docs] + [extra[0][3] if extra else docs[-1][3] if docs else ""]
        done = []
        begin = 0
        while begin < len(docs):
            end, size = begin, 0
            while end < len(docs) and (end == begin or size < 1 << 20):
                size += len(chain[end])
                end += 1
            texts = chain[begin:end]
            after = chain[begin + 1 : end + 1]
            changed = [edited(t, n) for t, n in zip(texts, after, strict=True)]
            of = [digests(x) for x in (texts, changed, after)]
            tables = [sketch(x) for x in of]
            done.append(
                pa.table(
                    [
                        pa.array([i if known else None for i, known, _, _ in docs[begin:end]], types[0]),
                        pa.array([len(t) for t in texts], types[1]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                        pa.array(tables[0].strings()),
                        pa.array(tables[1].strings()),
                        pa.array(likeness(of[0], of[1], tables[0], tables[1])),
                        pa.array(likeness(of[0], of[2], tables[0], tables[2])),
                    ],
                    names,
                )
            )
            begin = end
        common.give_back()
        return pa.concat_tables(done) if done else pa.table([pa.array([], t) for t in types], names)

    schema = f"`{id_column}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not ranges:
        return spark.createDataFrame([], schema)
    return rows.mapInArrow(deal, "part long, blob binary").groupBy("part").applyInArrow(compare, schema)
