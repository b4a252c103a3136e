"""Operator 8: SimHash near-duplicates, found by Golay-code fuzzy hashing.

The 64 bits are three segments A, B (23 bits) and C (18 bits, padded with zeros). The perfect binary Golay code decodes
any 23 bits to the one codeword within three bits. If two segments differ in at most one bit, the codeword of one is the
codeword of the other or of the other with one bit flipped, at most six in all. Two fingerprints at three or fewer
differing bits have, by the pigeonhole principle, either one segment that is equal and another with at most one
difference, or one difference in each segment. So there are seven families of keys:

* for each ordered pair of segments (i, j): i's bits themselves, and j's codeword on one side, near codewords on the other;
* all three codewords, near ones on one side for A and C and on the other side for B.

Keys have 30 to 36 bits. Both sides hold each distinct fingerprint once, so copies never pair up; pairs are verified inside
the join, only links leave it. Links become components; no link is lost (see the tests).

Null and empty texts have fingerprint zero and are linked like others. Repeated rows share a fingerprint. Null ids never
name a component unless all of its ids are null. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_table, hot_join, partitions_for, ready_workers, stored, swept, table, tidy, trimmed
from .components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Of the pipeline's stage: the shingles and similarity that verify a pair; bands of bins that make candidates; texts of a
#: band that all pair up; and the share of a sketch below which a pair isn't compared.
WIDE, ALIKE, BANDS, ROWS, FEW, SKETCHED = 5, 0.8, 42, 6, 16, 0.68
#: Texts of a block of a large group.
CROWD = 128
#: Times this, the top byte of eight bytes of 0 or 1 is their sum.
EACH_BYTE = np.uint64(0x0101010101010101)
GOLAY = 0xC75  # the code's generator polynomial
#: Bits of the numbers of texts that are turned to choose at random.
UID_BITS = 44
#: First bit and width of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: str) -> int:
    """SimHash of the XXH64 values of the word shingles of one text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter(map(fingerprint, b.column("text").to_pylist()), "<u8", b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view("<i8"))], ["doc_id", "fp"])


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """The index of the codeword within three bits of each 23-bit value."""
    words = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        words ^= np.where(np.arange(1 << 12) >> bit & 1, GOLAY << bit, 0)
    table_ = np.zeros(1 << 23, np.int16)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            table_[words ^ sum(1 << b for b in bits)] = np.arange(1 << 12)
    return table_


def near(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) for the codewords of each value and of it with one of its width bits flipped, each once."""
    table_ = codewords()
    flipped = np.stack([values, *(values ^ (1 << b) for b in range(width))], 1)
    found = np.sort(table_[flipped].astype(np.int64), 1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(fresh)
    return row, found[row, col]


def keys(fps: np.ndarray, left: bool, triple: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each fingerprint, for one side of the join. triple: with the family of all three codewords."""
    bits = fps.view("<u8")
    raw = [(bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    every = np.arange(len(fps))
    code = [(every, codewords()[r].astype(np.int64)) for r in raw]
    close = [near(r, width) for r, (_, width) in zip(raw, SEGMENTS, strict=True)]
    rows, out = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                row, index = (code if left else close)[j]
                rows.append(row)
                out.append((i * 3 + j) << 40 | raw[i][row] << 12 | index)
    if not triple:
        return np.concatenate(rows), np.concatenate(out)
    a, b, c = (code[0], close[1], code[2]) if left else (close[0], code[1], close[2])
    row, key = a
    for more, index in (b, c):
        first = np.searchsorted(more, np.arange(len(fps)))
        n = np.bincount(more, minlength=len(fps))[row]
        at = np.repeat(first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row, key = np.repeat(row, n), np.repeat(key, n) << 12 | index[at]
    return np.concatenate([*rows, row]), np.concatenate([*out, 15 << 40 | key])


def keyed(batches: Iterator[pa.RecordBatch], left: bool, triple: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.asarray(b.column("fp"))
        row, key = keys(fps, left, triple)
        for i in range(0, len(row), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(fps[row[s]])], ["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """(u, v) for distinct fingerprints (fp long) at DISTANCE or fewer differing bits, found by Golay keys and verified.

    Spark counts a fingerprint's many keys as one row, so it would broadcast them: the join is told to shuffle.
    """
    sides = [fps.mapInArrow(lambda it, left=left: trimmed(keyed(it, left)), "key long, fp long").alias("lr"[1 - left]) for left in (True, False)]
    on = (F.col("l.key") == F.col("r.key")) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= DISTANCE) & (F.col("l.fp") != F.col("r.fp"))
    return sides[0].join(sides[1].hint("merge"), on).select(F.col("l.fp").alias("u"), F.col("r.fp").alias("v"))


@tidy
def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) for every row of docs (doc_id, text)."""
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(rows.mapInArrow(lambda it: trimmed(fingerprints(it)), "doc_id long, fp long"))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).repartition(partitions_for(rows)))
    member = components(links(distinct.select("fp")))
    rooted = distinct.join(member, distinct.fp == member.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(names, "root").select("fp", "n", "component_id"))
    return hot_join(rows, named, "fp", "n", named.agg(F.sum("n")).first()[0] or 0).select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Texts that are alike by their shingles: candidates from bands of least shingle hashes, verified.


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def wide_hashes(text: str) -> np.ndarray:
    """The hashes of the text's WIDE-word shingles, sorted."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    word = np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), "<u8", len(words))
    n = max(1, len(words) - WIDE + 1)
    h = np.zeros(n, "<u8")
    for i in range(min(WIDE, len(words))):
        h = _mixed(h + word[i : i + n])
    h.sort()
    return h


def least_hashes(text: str) -> np.ndarray:
    """The least hash of the text's WIDE-word shingles in each of 256 bins of hashes, 0 for an empty bin."""
    return _least(wide_hashes(text))


def _least(h: np.ndarray) -> np.ndarray:
    bins = (h >> np.uint64(56)).astype(np.int64)
    first = np.append(0, np.flatnonzero(bins[1:] != bins[:-1]) + 1)
    out = np.zeros(256, "<u8")
    out[bins[first]] = h[first] | np.uint64(1)
    return out


def all_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: MD5, fingerprint, a byte for each bin of ``least_hashes``, how many shingles it has, and a key for each band of bins not all empty."""
    for b in batches:
        texts = b.column("text").to_pylist()
        n = len(texts)
        own = np.fromiter(map(fingerprint, texts), "<u8", n).view("<i8")
        least, size = np.zeros((n, 256), "<u8"), np.zeros(n, np.int64)
        for i, t in enumerate(texts):
            h = wide_hashes(t)
            least[i], size[i] = _least(h), 1 + np.count_nonzero(h[1:] != h[:-1])
        sketch = np.where(least > 0, (least >> np.uint64(8)) % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8)
        band = least[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
        key = np.tile(np.arange(BANDS, dtype="<u8"), (n, 1))
        for i in range(ROWS):
            key = _mixed(key + band[:, :, i])
        full = band.any(2)
        keys_ = pa.ListArray.from_arrays(pa.array(np.append(0, full.sum(1).cumsum()), pa.int32()), pa.array(key[full].view("<i8")))
        names = pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string())
        sketches = pa.array([x.tobytes() for x in sketch], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), names, pa.array(own), sketches, pa.array(size), keys_], ["doc_id", "h", "text_key", "fp", "sketch", "size", "keys"])


def maybe_wanted(batches: Iterator[pa.RecordBatch], table_) -> Iterator[pa.RecordBatch]:
    """The rows whose h may be in the table."""
    for b in batches:
        yield b.filter(pa.array(table_.value.maybe(np.asarray(b.column("h")).view("<u8"))))


def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches share SKETCHED of their filled bins (some five deviations below ALIKE), and those of short texts."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("sketch_u", "sketch_v"))
        union, common = ((x > 0) | (y > 0)).sum(1), ((x == y) & (x > 0)).sum(1)
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array((common >= SKETCHED * union) | (union < 64)))


def shingle_set(text: str) -> frozenset[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(map(hash, zip(*(words[i:] for i in range(WIDE)), strict=False))) if len(words) >= WIDE else frozenset([hash(tuple(words))])


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose texts have a Jaccard similarity of ALIKE or more over WIDE-word shingles."""
    last, of = None, frozenset()
    for b in batches:
        keep = []
        for x, y in zip(b.column("text_u").to_pylist(), b.column("text_v").to_pylist(), strict=True):
            if y != last:
                last, of = y, shingle_set(y)
            own = shingle_set(x)
            common = len(own & of)
            keep.append(common >= ALIKE * (len(own) + len(of) - common))
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep))


def band_links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v), u > v: pairs of texts (uid, keys) that share a key; and (uid, a, b, key, n): texts with the two that stand for a key.

    Up to FEW texts of a key all pair up, and come as pairs, one for each key. Of more (n), each comes with two of
    them, others for each key, so a large group of copies gives stars; ``crowd_pairs`` has the rest of its pairs. Nearly all keys have three texts at
    most, which one aggregate names by their least, greatest and sum; only the texts of the others are looked up.
    """
    keyed_ = texts.select("uid", F.explode("keys").alias("key"))
    # By turning some bits of the numbers, others for each key, the least and greatest are texts chosen at random.
    bits = F.xxhash64("key").bitwiseAND(F.lit((1 << UID_BITS) - 1))
    turned = lambda c: F.col(c).bitwiseXOR(bits)
    groups = keyed_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(turned("uid")).alias("x"), F.max(turned("uid")).alias("y"), F.sum("uid").alias("s"))
    groups = stored(groups.where("n > 1").select("key", "n", turned("x").alias("a"), turned("y").alias("b"), "s"))
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    third = F.col("s") - F.col("a") - F.col("b")
    pairs = F.when(F.col("n") == 2, F.array(pair("a", "b"))).otherwise(F.array(pair("a", "b"), pair(F.col("a"), third), pair(F.col("b"), third)))
    small = groups.where("n <= 3").select(F.explode(pairs).alias("p")).select("p.*")
    shared = stored(keyed_.join(groups.where("n > 3").select("key", "n", "a", "b"), "key"))
    few = shared.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list("uid").alias("ids"))
    few = few.select(F.explode("ids").alias("u"), "ids").select("u", F.explode("ids").alias("v"))
    return small.unionByName(few).where("u > v"), shared.where(F.col("n") > FEW).select("uid", "a", "b", "key", "n")


def pairs_of(stars: DataFrame, ends: str = "ab") -> DataFrame:
    """(u, v), u > v: each text of a star with the two that stand for it, or those named."""
    each = [stars.select(F.greatest("uid", c).alias("u"), F.least("uid", c).alias("v")) for c in ends]
    return reduce(DataFrame.unionByName, each).where("u > v")


def share_lesser(x: pa.ListArray, y: pa.ListArray, key: int) -> np.ndarray:
    """Of lists of keys: whether each of x has a key less than the given one in common with each of y."""
    sides = []
    for lists in (x, y):
        keys_ = np.asarray(lists.flatten())
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        sides.append((row[keys_ < key], keys_[keys_ < key], len(lists)))
    both = np.intersect1d(sides[0][1], sides[1][1])
    held = [np.zeros((n, len(both)), np.float32) for *_, n in sides]
    for has, (row, keys_, _) in zip(held, sides, strict=True):
        known = np.isin(keys_, both)
        has[row[known], np.searchsorted(both, keys_[known])] = 1
    return held[0] @ held[1].T > 0


def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v), u > v: of the two blocks of each row, the pairs of different classes that may be alike by sketch and size.

    A shingle that only one of two texts has changes a byte of the sketches at most, and two alike texts have no more such
    shingles than (1 - ALIKE) / (1 + ALIKE) of both sizes summed: that holds for sure, and leaves few pairs of short texts. Of
    64 filled bins or more, SKETCHED holds besides, as in ``plausible``. A pair meets in the blocks of every key that both texts
    have; it comes from the least of these alone.
    """
    for b in batches:
        of = {c: b.column(c) for c in b.schema.names}
        all_keys = np.asarray(of["key"])
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in range(b.num_rows):
            (xu, xr, xn), (yu, yr, yn) = ([np.asarray(of[f"{side}_{c}"][r].values) for c in ("uid", "root", "size")] for side in "xy")
            x, y = (np.frombuffer(b"".join(of[f"{side}_sketch"][r].as_py()), np.uint8).reshape(-1, 256) for side in "xy")
            elsewhere = share_lesser(of["x_keys"][r].values, of["y_keys"][r].values, all_keys[r])
            for i in range(len(xu)):
                differ = ((y != x[i]).view("<u8") * EACH_BYTE >> np.uint64(56)).sum(1).astype(np.int64)
                near_ = differ * (1 + ALIKE) <= (1 - ALIKE) * (xn[i] + yn) + 1e-6
                other = np.flatnonzero(near_ & (yr != xr[i]) & ~elsewhere[i])
                union = ((y[other] > 0) | (x[i] > 0)).sum(1)
                other = other[(union - differ[other] >= SKETCHED * union) | (union < 64)]
                us.append(np.maximum(yu[other], xu[i]))
                vs.append(np.minimum(yu[other], xu[i]))
        u, v = np.concatenate(us), np.concatenate(vs)
        for i in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], ["u", "v"])


def crowd_pairs(stars: DataFrame, texts: DataFrame, part: DataFrame) -> DataFrame:
    """(u, v), u > v: all pairs of texts that share a key of stars, are of different classes of part and may be alike (``crossed``).

    Of each key, the texts outside its largest class meet all of its texts, in blocks of CROWD; only pairs that may be alike
    become rows. A key whose texts are of one class by then is done.
    """
    s = stored(stars.select("key", "n", "uid").join(part.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid")))
    most = s.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("root", "m").alias("main"), F.max("m").alias("most"))
    s = stored(s.join(most, "key").where("most < n"))  # once, as both sides read it
    own = s.groupBy("uid").agg(F.collect_list("key").alias("keys"))  # BANDS at most
    own = stored(own.join(texts.select("uid", "sketch", "size"), "uid"))

    def blocks(side: str, rows: DataFrame, n: str) -> DataFrame:
        block = F.pmod(F.xxhash64("key", "uid"), F.ceil(F.expr(n) / CROWD))
        out = rows.join(own, "uid").groupBy("key", block.alias(f"{side}_block")).agg(F.collect_list(F.struct("uid", "root", "size", "sketch", "keys")).alias("m"))
        return out.select("key", *[F.col(f"m.{c}").alias(f"{side}_{c}") for c in ("uid", "root", "size", "sketch", "keys")])

    both = blocks("x", s.where("root <> main"), "n - most").join(blocks("y", s, "n"), "key")
    return both.mapInArrow(lambda it: trimmed(crossed(it)), "u long, v long").distinct()


def band_pairs(texts: DataFrame) -> DataFrame:
    """(u, v, times): all pairs of ``band_links``, and how many keys make each."""
    some, stars = band_links(texts)
    return some.unionByName(pairs_of(stars)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("times"))


@tidy
def alike_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of every row of docs; and (text_key, n, least, root, component_id) of every text.

    n: how many rows have the text; least: their smallest id; root: the number of its class of alike texts; component_id: the
    smallest id of the class. Texts are linked as in ``near_duplicates`` or by ALIKE shared shingles of WIDE words.

    Candidates for the second kind are texts whose least shingle hashes are equal in one of BANDS bands of ROWS bins; those
    of like sketches are then compared as texts, unless their classes are one by then. So a pair of alike texts is found
    with high probability (1 - (1 - ALIKE ** ROWS) ** BANDS or more), and no unlike pair is.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    swept(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    prints = stored(rows.mapInArrow(lambda it: trimmed(all_prints(it)), "doc_id long, h long, text_key string, fp long, sketch binary, size long, keys array<long>"))
    # Rows without an id name no class, but their texts link others.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("least"), "h")).alias("first")
    texts = prints.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), first, F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    texts = stored(texts.select("text_key", "n", "first.least", "first.h", "fp", "sketch", "size", "keys", F.monotonically_increasing_id().alias("uid")))
    sure = texts.groupBy("fp").agg(F.min("uid").alias("first"))
    own = links(sure.select("fp"))
    own = own.join(sure, own.u == sure.fp).select(F.col("first").alias("u"), "v")
    own = own.join(sure, own.v == sure.fp).select("u", F.col("first").alias("v"))
    own = own.unionByName(texts.join(sure, "fp").where("uid <> first").select(F.col("uid").alias("u"), F.col("first").alias("v")))
    own = stored(own.distinct())
    swept(spark)
    part = components(own)

    def joined_by(part: DataFrame, more: DataFrame) -> DataFrame:
        """Links that give the classes of part and of more: of those, each text's with its root are enough, and soon merged."""
        return part.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)

    def rooted_at(c: str, part: DataFrame) -> DataFrame:
        return part.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))

    def apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
        """The pairs whose classes differ so far."""
        out = pairs.join(rooted_at("u", part), "u", "left").join(rooted_at("v", part), "v", "left")
        return out.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")

    def apart_in(stars: DataFrame, part: DataFrame) -> DataFrame:
        """The same for stars: decided before they become pairs, so that those of a group that is one class never do."""
        for c in ("uid", "a"):
            stars = stars.join(rooted_at(c, part), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        return pairs_of(stars.where("root_uid <> root_a"), "a").distinct()

    def sketched(pairs: DataFrame) -> DataFrame:
        """The pairs that may be alike by their sketches."""
        of = lambda c: texts.select(F.col("uid").alias(c), F.col("sketch").alias(f"sketch_{c}"))
        both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "sketch_u", "sketch_v")
        return stored(both.mapInArrow(lambda it: trimmed(plausible(it)), "u long, v long"))

    def compared(near_: DataFrame) -> DataFrame:
        """The pairs that are alike as texts."""
        swept(spark)
        # The texts of these pairs: one row of docs for each, found by a bit table of bounded size, then exactly.
        ends = near_.select(F.col("u").alias("uid")).unionByName(near_.select(F.col("v").alias("uid"))).distinct()
        wanted = stored(texts.join(ends, "uid", "left_semi").select("uid", "h", F.col("text_key").alias("_key")))
        table_ = spark.sparkContext.broadcast(bit_table(wanted, "h"))
        bodies = rows.select("h", "text").mapInArrow(lambda it: trimmed(maybe_wanted(it, table_)), "h long, text string")
        bodies = bodies.join(wanted, "h").where(F.md5(F.encode("text", "UTF-8")) == F.col("_key"))
        bodies = stored(bodies.dropDuplicates(["uid"]).select("uid", "text"))
        both = near_.join(bodies.select(F.col("uid").alias("u"), F.col("text").alias("text_u")), "u")
        both = both.join(bodies.select(F.col("uid").alias("v"), F.col("text").alias("text_v")), "v")
        return stored(both.select("u", "v", "text_u", "text_v").mapInArrow(lambda it: trimmed(verified(it)), "u long, v long"))

    # Each text with its likeliest partner first; then the pairs between different classes that are left. Of large groups, each
    # text with one that stands for it: as all their pairs come at last, more would only be compared twice.
    swept(spark)
    some, stars = map(stored, band_links(texts))
    every = some.unionByName(pairs_of(stars, "a")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("times"))
    best = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("times"), "v"))
    likeliest = every.withColumn("place", best).where("place = 1").select("u", "v")
    more = compared(sketched(apart(likeliest, part)))
    swept(spark)
    part = components(joined_by(part, more))
    more = compared(sketched(apart(some.distinct(), part).unionByName(apart_in(stars, part)).distinct()))
    swept(spark)
    member = components(joined_by(part, more))
    swept(spark)
    # Of large groups, the pairs between classes that no star has compared: all of them.
    crowd = stored(crowd_pairs(stars, texts, member))
    if not crowd.isEmpty():
        member = components(joined_by(member, compared(crowd)))
    rooted = texts.join(member, texts.uid == member.node, "left").select("text_key", "n", "least", F.coalesce("root", "uid").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(prints.select("doc_id", "text_key")), stored(rooted.join(names, "root").select("text_key", "n", "least", "root", "component_id"))


def alike_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, component_id) for every row of docs (doc_id, text): see ``alike_classes``."""
    rows, classes = alike_classes(docs)
    total = classes.agg(F.sum("n")).first()[0] or 0
    return hot_join(rows, classes, "text_key", "n", total).select("doc_id", "text_key", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without near-duplicates (``alike_classes``): of each class one row stays, that of the smallest id.

    Rows are told apart by id and text: rows of one id and different texts are decided each by its own class. If no row of a
    class has an id, one of its rows stays; so does one of several that are alike in id and text.
    """
    rows, classes = alike_classes(docs.select("doc_id", "text"))
    kept = classes.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "text_key")).alias("k"))
    kept = stored(kept.select(F.col("k.least").alias("_id"), F.col("k.text_key").alias("_key")))
    again = rows.join(kept, rows.doc_id.eqNullSafe(kept._id) & (rows.text_key == kept._key), "left_semi")
    again = stored(again.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).count().where("count > 1").drop("count"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("key"))
    same = lambda x, y: x.id.eqNullSafe(y._id) & (x.key == y._key)
    out = own.join(kept.hint("merge"), same(own, kept), "left_semi")
    if again.isEmpty():
        return out.select("row.*")
    once = out.join(again, same(out, again), "left_anti")
    return once.select("row.*").unionByName(out.join(again, same(out, again), "left_semi").dropDuplicates(["id", "key"]).select("row.*"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
