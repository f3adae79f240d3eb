"""SimHash near-duplicates found by Golay-code fuzzy hashing (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B
from scoreloom.llm.common import fresh, stage
from scoreloom.llm.components import connected

#: Words in a shingle, and differing bits up to which two fingerprints link.
SHINGLE, DISTANCE = 3, 2
#: Segments of the 64 bits: position of the lowest bit and width, at most 23 each.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members up to which a bucket is compared pair by pair; larger ones go through shared variants.
PAIRWISE = 64
#: Shingles hashed at once, and hashes unpacked to bits at once.
HASHED, UNPACKED = 1 << 17, 1 << 14
#: Generator polynomial of the binary Golay code of length 23.
_GENERATOR = 0xAE3


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (_GENERATOR << (bit - 11))
    return x


def _corrections() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, all patterns of at most 4 bits that lead to a codeword: 6 or 1 of them (-1 fills)."""
    patterns = np.array([sum(1 << i for i in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for s, p in zip(_syndrome(patterns).tolist(), patterns.tolist(), strict=True):
        table[s, used[s]] = p
        used[s] += 1
    return table, used


_tables: list = []


def golay_indices(segment: np.ndarray) -> np.ndarray:
    """The codewords within 4 bits of each 23-bit value as (n, 6) data bits, -1 where there are fewer.

    The code is perfect with radius 3, and its words of weight 7 hold every set
    of 4 positions once. So two values that differ in at most 2 bits always
    have one of these codewords in common.
    """
    if not _tables:
        _tables.extend(_corrections())
    fix = _tables[0][_syndrome(segment)]
    return np.where(fix < 0, -1, (segment.astype(np.int64)[:, None] ^ fix) >> 11)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """SimHash of each text as 64 unsigned bits; see :func:`simhash_components`."""
    out = np.zeros(len(texts), np.uint64)
    for lo, data, offsets in B.chunks(texts):
        found = B.words(data, offsets)
        joined, starts, ends = B.join_words(B.LOWER[data], found)
        size = np.diff(found.first)
        count = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
        first = np.concatenate([[0], np.cumsum(count)])
        base = np.repeat(found.first[:-1] - first[:-1], count) + np.arange(first[-1])
        span = np.repeat(np.minimum(size, SHINGLE), count)
        ones = np.zeros((len(size), 64), np.int64)
        rows = np.repeat(np.arange(len(size)), count)
        for at in range(0, len(base), HASHED):  # both bounds keep a worker's memory small
            part = base[at : at + HASHED]
            h = B.xxh64(joined, starts[part], ends[part + span[at : at + HASHED] - 1]).astype(">u8").view(np.uint8).reshape(-1, 8)
            for cut in range(0, len(h), UNPACKED):
                bits = np.unpackbits(h[cut : cut + UNPACKED], axis=1)
                doc, begin = np.unique(rows[at + cut : at + cut + len(bits)], return_index=True)
                ones[doc] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > count[:, None], axis=1)
        out[lo : lo + len(size)] = packed.view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], ["doc_id", "fp"])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        part = [((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
        for i in range(3):
            index = golay_indices(part[(i + 1) % 3])
            row, which = np.nonzero(index >= 0)
            key = (i << 40) | (part[i][row] << 12) | index[row, which]
            yield pa.record_batch([pa.array(key), pa.array(fp.view(np.int64)[row])], ["k", "fp"])


def _variant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            yield pa.record_batch([pa.array((part[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(part, 65).view(np.int64))], ["x", "fp"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between the distinct fingerprints of column ``fp`` that connect all within 2 bits.

    Of the three segments one is without error whenever two fingerprints differ
    in at most 2 bits, and the next segment then has at most 2 errors. The keys
    are therefore the exact segment with each Golay codeword index of the next:
    about 16 keys a fingerprint, of 33 bits. Members of a bucket are joined and
    verified on all 64 bits. Buckets of over ``PAIRWISE`` members are not paired:
    each member gives its 65 variants of at most one changed bit, and two
    fingerprints share a variant exactly if they differ in at most 2 bits, so
    linking each to the least one of its variant keeps every connection with a
    number of rows in proportion to the members.
    """
    keys = distinct.select("fp").mapInArrow(_key_batches, "k long, fp long")
    sizes = stage(keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "sizes")  # with exchanges of their own, this join and the last one can split a hot key
    live = stage(keys.join(sizes, "k"), "buckets")
    few = live.where(F.col("n") <= PAIRWISE)
    pairs = few.select("k", F.col("fp").alias("a")).join(few.select("k", F.col("fp").alias("b")), "k")
    pairs = pairs.where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    variants = live.where(F.col("n") > PAIRWISE).select("fp").distinct().mapInArrow(_variant_batches, "x long, fp long")
    heads = stage(variants.groupBy("x").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("x", "a"), "heads")
    stars = variants.join(heads, "x").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    Texts are lower-cased in A-Z and cut into runs of other bytes than 0x20 and
    0x09-0x0D; a bit of the fingerprint (here as signed long) is set if it is
    set in over half the XXH64 values (seed 42) of the 3-word shingles, repeats
    included. Fingerprints link at 2 or fewer differing bits; ``component_id``
    is the least id that can be reached.

    Texts with fewer than three words have one shingle, the whole sequence;
    null and empty texts have fingerprint zero and link like any other. Rows
    with a null id are linked too, but never name a component unless all its
    ids are null. Repeated rows each give a row. An empty table gives no rows;
    other columns are not read.
    """
    printed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _labelled(stage(printed.mapInArrow(_fingerprint_batches, "doc_id long, fp long"), "fingerprints")).drop("root")


def _labelled(printed: DataFrame) -> DataFrame:
    """``printed(doc_id, fp)`` with ``component_id`` and ``root``, a fingerprint that names the component."""
    distinct = stage(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(links(distinct))
    inside = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = stage(inside.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # else the join below could not split a hot root
    by_print = stage(inside.select("fp", "root").join(least, "root"), "components")
    return printed.join(by_print, "fp").select("doc_id", "fp", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, the one of least id, of each component; columns stay as they are.

    Rows are told apart by id and fingerprint, so a row without an id goes only
    if its own component has an id, and a row whose id repeats with another
    text only by the component of that text: of an id with texts in several
    components, one row of each stays. Rows that repeat the kept id in its
    component count as the same document, and the one whose text has the least
    hash stays. A component
    without any id keeps all its rows: there is nothing to tell them apart by.
    """
    key, fp, gone_key, gone_fp, root, hashed, least = fresh(docs, "key", "fp", "gone_key", "gone_fp", "root", "hashed", "least")

    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts).view(np.int64))

    out = stage(docs.withColumn(key, F.col(id_col).cast("long")).withColumn(fp, F.arrow_udf(prints, "long")(F.col(text_col))), "printed")  # once for all that follows
    labels = _labelled(out.select(F.col(key).alias("doc_id"), F.col(fp).alias("fp")))
    gone = labels.where("doc_id is not null and doc_id <> component_id or doc_id is null and component_id is not null")
    own = labels.where("doc_id = component_id").select(F.col("doc_id").alias(gone_key), F.col("fp").alias(gone_fp), F.col("root").alias(root))
    repeated = own.groupBy(gone_key, root).count().where("count > 1")
    gone = gone.select(F.col("doc_id").alias(gone_key), F.col("fp").alias(gone_fp))  # not made distinct: an aggregation would bind the join on fp, so that it cannot split a hot one
    out = out.join(gone, F.col(key).eqNullSafe(F.col(gone_key)) & (F.col(fp) == F.col(gone_fp)), "left_anti")
    if repeated.limit(1).count():
        named = out.where(F.col(key).isNotNull()).join(own.distinct(), (F.col(key) == F.col(gone_key)) & (F.col(fp) == F.col(gone_fp))).drop(gone_key, gone_fp)
        named = named.withColumn(hashed, F.xxhash64(F.col(text_col)))
        first = named.groupBy(F.col(key).alias(gone_key), F.col(root).alias(gone_fp)).agg(F.min(hashed).alias(least))
        named = named.join(first, (F.col(key) == F.col(gone_key)) & (F.col(root) == F.col(gone_fp)) & (F.col(hashed) == F.col(least)))
        out = named.dropDuplicates([key, root]).select(out.columns).unionByName(out.where(F.col(key).isNull()))
    return out.select([F.col(f"`{c}`") for c in docs.columns])
