"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two fingerprints within the radius share a
variant. Only fingerprints are shuffled, never texts, and exact copies of a text are one fingerprint before that.
A variant meets at most as many fingerprints as its own ball holds (65 for radius 2), whatever the data; these
are linked to the least of them, not in all pairs. Where two of them can be further apart than the radius (an odd
radius, or none), each pair of the bounded bucket is verified instead.

``keep_first`` (the pipeline's stage) has a setting of its own: near copies are texts whose sets of 5-word shingles have a
Jaccard similarity of 0.8 or more. Each set has a fingerprint, balls of half the radius choose pairs of sets as above, and each
pair is verified on the sets themselves. Fingerprints of near copies may differ by some 10 of 64 bits, which no ball reaches,
so bands of minima of the shingles' hashes add the pairs beyond the radius; they are verified alike.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows each get
a row; a null doc_id is kept and never names a component unless all of its component's are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from . import common

BITS = 64
#: Shingle hashes that are held at once.
AT_ONCE = 1 << 17
#: Near copies (of ``keep_first``): Jaccard similarity of the sets of shingles, as a fraction.
SIMILAR = (4, 5)
#: Two sets meet if one of BANDS bands of ROWS minima is equal: at similarity 0.8 all but (1 - 0.8 ** 5) ** 32 = 3e-6 do.
BANDS, ROWS = 32, 5
_FLIPS, _FACTORS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)
_MIXER = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit words of a set's occupancy map: bit i is 1 if a shingle's hash ends in i. A bit that another set lacks is a shingle that it lacks.
MAP = 8


def _counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _of_counts(ones: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.packbits(ones * 2 > of[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _hashes(text: bytes, words: int, seed: int) -> Iterator[list[int]]:
    """Hashes of the text's shingles, at most AT_ONCE in a list."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII blanks
    if not found:
        return
    n = len(found) - words + 1
    if n <= 1:
        yield [xxh64_intdigest(b" ".join(found), seed)]
        return
    for at in range(0, n, AT_ONCE):
        part = found[at : at + AT_ONCE + words - 1]
        yield [xxh64_intdigest(b" ".join(s), seed) for s in zip(*[part[k:] for k in range(words)], strict=False)]


def fingerprints(documents: DataFrame, column: str = "text", words: int = 3, seed: int = 42, out: str = "fingerprint") -> DataFrame:
    """documents with ``out`` (long: the 64 bits) instead of the text."""
    common.small_batches(documents)
    kept = [f for f in documents.schema.fields if f.name not in (column, out)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 4 << 20, column):
            data, at = common.utf8(batch.column(column))
            prints = np.zeros(batch.num_rows, "<u8")
            held, rows, sizes = [], [], []

            def settle() -> None:
                if rows:
                    bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    prints[rows] = _of_counts(np.add.reduceat(bits, starts, axis=0, dtype=np.int32), np.array(sizes))
                    held.clear(), rows.clear(), sizes.clear()

            for i in range(batch.num_rows):
                parts = list(_hashes(bytes(data[at[i] : at[i + 1]]), words, seed))
                if len(parts) > 1:
                    prints[i] = _of_counts(sum(map(_counts, parts))[None], np.array([sum(map(len, parts))]))[0]
                elif parts:
                    held += parts[0]
                    rows.append(i)
                    sizes.append(len(parts[0]))
                    if len(held) >= AT_ONCE:
                        settle()
            settle()
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(prints.view("<i8"))], [*[f.name for f in kept], out])

    return documents.select(*[F.col(f"`{f.name}`") for f in kept], column).mapInArrow(go, T.StructType([*kept, T.StructField(out, T.LongType())]))


def masks(radius: int) -> list[int]:
    """All flips of at most radius bits, as signed 64-bit integers."""
    found = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def links(prints: DataFrame, radius: int = 2, column: str = "fingerprint") -> DataFrame:
    """(a, b) with a < b, which connect all distinct fingerprints at most radius bits apart (not each pair of them)."""
    half = (radius + 1) // 2
    flips = F.array(*[F.lit(m) for m in masks(half)]).cast("array<bigint>")
    # dealt out again: few rows, each of which becomes many
    distinct = prints.select(F.col(column).alias("f")).distinct().repartition(4 * prints.sparkSession.sparkContext.defaultParallelism)
    balls = distinct.select("f", F.explode(flips).alias("flip")).select("f", F.col("f").bitwiseXOR(F.col("flip")).alias("variant"))
    # whoever shares a variant differs in at most 2 * half bits
    met = balls.groupBy("variant").agg(F.min("f").alias("least"), F.max("f").alias("most"), F.collect_set("f").alias("all")).where("least < most")
    if 2 * half <= radius:
        pairs = met.select(F.col("least").alias("a"), F.explode("all").alias("b")).where("a < b")
    else:
        pairs = met.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return pairs.distinct().where(near)


def components(documents: DataFrame, id_column: str = "doc_id", column: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """documents with fingerprint (long) and component_id, the smallest id that is reachable over links."""
    prints = common.cut(fingerprints(documents, column, words))
    held = prints.groupBy("fingerprint").agg(F.min(id_column).alias("least_id"))
    roots = connected_components(links(prints, radius))
    grouped = held.join(roots.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    to = common.cut(grouped.join(named, "root").select("fingerprint", "component_id"))
    return prints.join(to, "fingerprint")


def shingle_sets(documents: DataFrame, column: str = "text", words: int = 5, seed: int = 42, sets: bool = False, text: bool = False) -> DataFrame:
    """documents with set_key (of the set of shingles), n_shingles and either band_keys and the set's fingerprint or, with ``sets``, the hashes themselves and their occupancy map.

    The text goes unless ``text``. Two texts of the same set have the same key; the set of an empty text has 0 shingles, no bands and fingerprint zero.
    """
    common.small_batches(documents)
    made = [T.StructField("set_key", T.LongType()), T.StructField("n_shingles", T.IntegerType()), T.StructField("shingles" if sets else "band_keys", T.ArrayType(T.LongType()))]
    made += [T.StructField("occupied", T.ArrayType(T.LongType())) if sets else T.StructField("fingerprint", T.LongType())]
    kept = [f for f in documents.schema.fields if (text or f.name != column) and f.name not in [m.name for m in made]]
    read = [f.name for f in kept] + ([] if text else [column])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 4 << 20, column):
            data, at = common.utf8(batch.column(column))
            found = []
            for i in range(batch.num_rows):
                parts = [np.array(p, np.uint64) for p in _hashes(bytes(data[at[i] : at[i + 1]]), words, seed)]
                found.append(np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64))
            sizes = np.array([len(s) for s in found])
            keys = [xxh64(s.tobytes()) for s in found]
            lists = found if sets else _bands(found, sizes)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in lists])])
            values = np.concatenate(lists).astype(np.uint64).view(np.int64)
            columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))]
            if not sets:
                columns.append(pa.array(_of_sets(found, sizes).view("<i8")))
            else:
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * MAP, pa.int32()), pa.array(_occupied(found, sizes).ravel())))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns], [*[f.name for f in kept], *[m.name for m in made]])

    return documents.select(*[F.col(f"`{name}`") for name in read]).mapInArrow(go, T.StructType([*kept, *made]))


def xxh64(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data)


def _occupied(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Each set's occupancy map, MAP numbers."""
    bits = np.zeros((len(sets), MAP * 64), np.uint8)
    bits[np.repeat(np.arange(len(sets)), sizes), (np.concatenate(sets) % np.uint64(MAP * 64)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def _some(sets: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of sets that aren't empty, their hashes, and where each begins: some AT_ONCE hashes at a time."""
    full = np.flatnonzero(sizes)
    for some in np.split(full, np.flatnonzero(np.diff(np.cumsum(sizes[full]) // AT_ONCE)) + 1):
        if len(some):
            yield some, np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])


def _of_sets(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Each set's fingerprint."""
    out = np.zeros(len(sets), "<u8")
    for some, hashes, starts in _some(sets, sizes):
        ones = np.zeros((len(some), BITS), np.int64)
        edges = np.append(starts, len(hashes))
        for begin in range(0, len(hashes), AT_ONCE):  # a set may be longer than what is unpacked at once
            end = min(begin + AT_ONCE, len(hashes))
            first, last = np.searchsorted(edges, begin, "right") - 1, np.searchsorted(edges, end, "left")
            bits = np.unpackbits(hashes[begin:end].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[first:last] += np.add.reduceat(bits, np.maximum(edges[first:last] - begin, 0), axis=0, dtype=np.int32)
        out[some] = _of_counts(ones, sizes[some])
    return out


def _bands(sets: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """Keys of the BANDS bands of ROWS minima of each set."""
    out = [np.empty(0, np.uint64)] * len(sets)
    for some, hashes, starts in _some(sets, sizes):
        keys = np.zeros((BANDS, len(some)), np.uint64)
        work = np.empty_like(hashes)
        for k in range(BANDS * ROWS):
            np.multiply(np.bitwise_xor(hashes, _FLIPS[k], out=work), _FACTORS[k], out=work)
            keys[k // ROWS] = (keys[k // ROWS] ^ np.minimum.reduceat(work, starts)) * _MIXER
        for i, key in zip(some.tolist(), keys.T, strict=True):
            out[i] = key
    return out


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of set keys whose sets have a Jaccard similarity of SIMILAR or more."""
    of = [sets.select(F.col("set_key").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab"]
    n_a, n_b, both = F.size("of_a"), F.size("of_b"), F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(of[0], "a").join(of[1], "b").where(both * SIMILAR[1] >= (n_a + n_b - both) * SIMILAR[0]).select("a", "b")


def _may_be_alike(n_a: str, shared_a: str | Column, n_b: str, shared_b: str | Column) -> Column:
    """Whether sets of n shingles each, of which at most ``shared`` are in the other, can be near copies."""
    # what both have stands here once: an expression that stood twice would be computed before cheaper conditions are looked at
    return F.least(shared_a, shared_b) * sum(SIMILAR) >= (F.col(n_a) + F.col(n_b)) * SIMILAR[0]


def _lacking(map_a: str, map_b: str) -> Column:
    """So many shingles of a are not in b, at least."""
    each = F.zip_with(map_a, map_b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(each, F.lit(0), lambda n, x: n + x)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def within_radius(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of set keys, a < b, that connect all sets whose fingerprints are at most radius bits apart."""
    each = prints.select("set_key", "fingerprint").distinct()
    held = each.groupBy("fingerprint").agg(F.min("set_key").alias("least"))
    same = each.join(held, "fingerprint").where("set_key <> least").select(F.col("least").alias("a"), F.col("set_key").alias("b"))
    met = links(held, radius)
    for k in "ab":
        met = met.join(held.select(F.col("fingerprint").alias(k), F.col("least").alias(f"of_{k}")), k)
    return _ordered(same.unionByName(met.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))


def near_components(documents: DataFrame, prints: DataFrame, id_column: str, column: str, words: int) -> DataFrame:
    """(set_key, root) of the set keys that have a near copy; prints are documents' shingle sets with bands and fingerprints.

    Pairs of sets whose fingerprints are within the radius come first: each set's with its least partner, then those that
    join components. Bands add what lies beyond the radius: a bucket's members are held against its least one first. What is then in another component than that is held against
    all sets of other components that can be near copies by their rarest shingles, so every pair that shares a bucket is
    compared, ruled out by its counts, or linked already.
    """
    close = common.cut(within_radius(prints))
    common.drop_shuffles(documents.sparkSession)
    bands = prints.dropDuplicates(["set_key"]).select("set_key", F.explode("band_keys").alias("band"))
    # the least of a bucket is combined before the shuffle, so a bucket may hold any share of the sets
    met = bands.groupBy("band").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).where("least < most")
    wanted = common.cut(bands.join(met.select("band"), "band"))

    asked = wanted.select("set_key").unionByName(close.select(F.explode(F.array("a", "b")).alias("set_key"))).distinct()
    ids = prints.join(asked, "set_key", "left_semi").groupBy("set_key").agg(F.min(id_column).alias(id_column))
    thin = documents.select(id_column, column)
    texts = thin.join(ids.select(id_column).distinct(), id_column, "left_semi").unionByName(thin.where(F.col(id_column).isNull()))
    sets = common.cut(shingle_sets(texts, column, words, sets=True).select("set_key", "n_shingles", "shingles", "occupied").dropDuplicates(["set_key"]))

    # a set's shingles that others have too, rarest first; those that no other has bound its similarity to any
    each = sets.select("set_key", F.col("n_shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("k")).where("k > 1")
    rank = F.shiftleft(F.least("k", F.lit(32767)), 48).bitwiseOR(F.shiftrightunsigned("s", 16))
    ranked = common.cut(each.join(often, "s").groupBy("set_key", "n").agg(F.array_sort(F.collect_list(rank)).alias("rare")))
    common.drop_shuffles(documents.sparkSession)
    sized = ranked.select("set_key", "n", F.size("rare").alias("shared"))
    members = common.cut(wanted.join(sized, "set_key").where(_may_be_alike("n", "shared", "shared", "shared")))
    # the least of those that are left, and all others of its bucket
    centres = members.groupBy("band").agg(F.min(F.struct("set_key", "n", "shared")).alias("c")).select("band", F.col("c.set_key").alias("centre"), F.col("c.n").alias("n_c"), F.col("c.shared").alias("shared_c"))
    members = common.cut(members.join(centres, "band"))
    stars = _ordered(members.where((F.col("set_key") != F.col("centre")) & _may_be_alike("n", "shared", "n_c", "shared_c")).select(F.col("centre").alias("a"), F.col("set_key").alias("b")))

    closest = close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = common.cut(_alike(_ordered(closest.unionByName(stars)), sets))
    roots = common.cut(connected_components(found).select(F.col("node").alias("set_key"), "root"))
    placed = members.select("band", "set_key", "n", "shared", "centre").join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    centre_roots = placed.where("set_key = centre").select("band", F.col("root").alias("centre_root"))
    apart = common.cut(placed.join(centre_roots, "band").where("root <> centre_root").select("band", "set_key"))
    strays = apart.select("set_key", F.lit(True).alias("stray")).distinct()
    # only sets of buckets that hold several components are left to compare
    open_sets = placed.join(apart.select("band").distinct(), "band", "left_semi").select("set_key", "root").distinct().join(sets.select("set_key", "occupied"), "set_key")
    # near copies share one of their n / 5 + 1 rarest shingles; what follows the first shared one bounds what both have
    rarest = F.slice("rare", 1, F.greatest(F.floor(F.col("n") / 5).cast("int") + 1 - F.col("n") + F.size("rare"), F.lit(0)))
    prefixes = ranked.join(open_sets, "set_key").select("set_key", "n", "root", "occupied", F.size("rare").alias("shared"), F.posexplode(rarest).alias("at", "s"))
    prefixes = common.cut(prefixes.join(strays, "set_key", "left").select("set_key", "n", "root", "occupied", F.coalesce("stray", F.lit(False)).alias("stray"), (F.col("shared") - F.col("at")).alias("left"), "s"))
    a, b = (of.select("s", *[F.col(c).alias(f"{c}_{k}") for c in ("set_key", "n", "root", "occupied", "left", "stray")]) for k, of in (("a", prefixes.where("stray")), ("b", prefixes)))
    # the first bound is cheap and rules most pairs out before the second is looked at
    near = _may_be_alike("n_a", "left_a", "n_b", "left_b") & _may_be_alike("n_a", F.col("n_a") - _lacking("occupied_a", "occupied_b"), "n_b", F.col("n_b") - _lacking("occupied_b", "occupied_a"))
    across = a.join(b, "s").where((~F.col("stray_b") | (F.col("set_key_a") < F.col("set_key_b"))) & (F.col("root_a") != F.col("root_b")) & near)
    left = close
    for k in "ab":
        left = left.join(roots.select(F.col("set_key").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
    left = left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    more = common.cut(_alike(_ordered(left.unionByName(across.select(F.col("set_key_a").alias("a"), F.col("set_key_b").alias("b")))), sets))
    return connected_components(found.unionByName(more)).select(F.col("node").alias("set_key"), "root") if more.limit(1).count() else roots


def keep_first(documents: DataFrame, id_column: str = "doc_id", column: str = "text", words: int = 5) -> DataFrame:
    """One row of each group of near copies: that of the smallest id (rows without an id come last, then the smallest text hash).

    Rows are told apart by id and text, so different texts of one id are judged each on its own.
    """
    own, first_hash, first_id = (common.new_name(documents.columns, n) for n in ("hash", "first_hash", "first_id"))
    hashed = documents.withColumn(own, F.xxhash64(F.coalesce(F.col(f"`{column}`"), F.lit(""))))
    prints = common.cut(shingle_sets(hashed.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{column}`").alias(column), F.col(f"`{own}`").alias("text_hash")), column, words))
    roots = near_components(documents, prints, id_column, column, words)
    place = F.struct(F.col(id_column).isNull().alias("nameless"), F.col(id_column).alias("id"), F.col("text_hash"))
    least = prints.groupBy("set_key").agg(F.min(place).alias("least"))
    grouped = least.join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    first = common.cut(grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias(first_id), F.col("least.text_hash").alias(first_hash)))
    same = hashed[own].eqNullSafe(first[first_hash]) & hashed[id_column].eqNullSafe(first[first_id])
    kept = hashed.join(first, same, "left_semi")
    # rows of a first document's id and text that are repeated
    many = prints.groupBy(F.col(id_column).alias(first_id), F.col("text_hash").alias(first_hash)).agg(F.count("*").alias("n")).where("n > 1")
    again = many.alias("m").join(first.alias("f"), F.col(f"m.`{first_id}`").eqNullSafe(F.col(f"f.`{first_id}`")) & (F.col(f"m.`{first_hash}`") == F.col(f"f.`{first_hash}`")), "left_semi")
    if again.limit(1).count():
        kept = kept.dropDuplicates([id_column, own])
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])
