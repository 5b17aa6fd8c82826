"""Problem 4: near-duplicate records with small edits, by prefixes of their rarest word sequences.

Two sets of word sequences of Jaccard similarity s or more share one among the n - ceil(s n) + 1 first sequences of
each, in any order that is the same for all records. The order here is from rare to common, so that buckets of records
that share such a sequence are narrow. Sizes and the places of the shared sequence then drop pairs that can't be
similar, and sketches of one-bit minima those that are not but for one in ten thousand at the least similarity. What is left is verified exactly by the sets themselves.

The perfect binary Golay code (syndrome, near_table), by which fingerprints were decoded to keys before, takes no part:
at the least similarity a key of it is shared too seldom.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from evigraph.runtime import cut, extended, parallelism

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the perfect binary Golay code. Fixed value.
GENERATOR = 0b101011100011
BITS = 23
#: Bits of the sketch that candidates are compared by.
CHECKED = 128
#: Bytes of a sequence's hash that are kept.
WIDTH = 5
#: Sequences of all records are counted in this number of cells, as a power of two; sets the order only.
CELLS = 20
#: Keys that a task sorts, at the mean: 16 MB and up to five times that of their records, whatever the number of shuffle partitions.
BUCKET_KEYS = 2_000_000
#: The bitmap of signatures that met another has 2^MAPPED words of 64 bits: 8 MB, in which ten million set a seventh of the bits.
MAPPED = 20
#: Bits of a key for its record's number of sequences, and for how many of them are left at the key's place.
PLACE = 12
MOST = (1 << PLACE) - 1
TOKEN = "[a-z0-9]+"


def syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words divided by the generator."""
    x = x.copy()
    for bit in range(BITS - 1, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0).astype(x.dtype)
    return x


def near_table() -> np.ndarray:
    """For each syndrome the error patterns of the codewords near a word with it; -1 fills up to six."""
    table, held = np.full((2048, 6), -1, np.int64), np.zeros(2048, int)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(BITS), weight)], np.int64)
        for p, s in zip(patterns.tolist(), syndrome(patterns).tolist()):
            if weight < 4 or held[s] and bin(int(table[s, 0])).count("1") == 3:
                table[s, held[s]] = p
                held[s] += 1
    return table


class Sequences:
    """Hashes of the distinct word sequences of batches of word lists."""

    def __init__(self, words: int):
        self.words = words
        self.hashes: dict[str, int] = {}

    def word(self, w: str) -> int:
        if (h := self.hashes.get(w)) is None:
            if len(self.hashes) > 500_000:
                self.hashes.clear()
            h = self.hashes[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def of(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(list, hash), sorted: the distinct sequences of each list of words."""
        length = np.array([len(ws) for ws in lists], np.int64)
        flat = np.fromiter((self.word(w) for ws in lists for w in ws), np.uint64, int(length.sum()))
        owner = np.repeat(np.arange(len(lists)), length)
        n = len(flat) - self.words + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(self.words):
            h = (h ^ flat[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        own = owner[:n] == owner[self.words - 1 :]
        owner, h = owner[:n][own], h[own]
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        return owner[new], h[new]


def least_shared(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many sequences at least are shared by sets of n together that are similar enough; rounding never adds."""
    return np.ceil(n * similarity / (1 + similarity) - 1e-9)


def sketches(size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """CHECKED one-bit minima of each set: two of them differ in (1 - similarity) / 2 of the bits, at the mean."""
    out, starts = np.zeros((len(size), CHECKED), np.uint8), np.cumsum(size) - size
    rng = np.random.default_rng(23)
    if len(h):
        for k, odd in enumerate(rng.integers(1 << 62, size=CHECKED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
            out[:, k] = np.minimum.reduceat((h * odd) ^ (h * odd >> np.uint64(29)), starts) >> np.uint64(7) & np.uint64(1)
    return np.packbits(out, axis=1).view(np.int64)


def most_apart(similarity: float) -> int:
    """How many bits similar sets' sketches differ in at most; at the least similarity one pair in ten thousand differs in more."""
    p = (1 - similarity) / 2
    return int(CHECKED * p + 3.72 * (CHECKED * p * (1 - p)) ** 0.5) + 1


def rarest_first(owner: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order of the sequences of each set, from rare to common."""
    return np.lexsort((h, counts[h >> np.uint64(64 - CELLS)], owner))


def narrow(h: np.ndarray) -> np.ndarray:
    """The first WIDTH bytes of each hash, as bytes."""
    return (h >> np.uint64(64 - 8 * WIDTH)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :]


def widened(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(size of each set, hashes of all) of packed sets."""
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDTH)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, 8 - WIDTH :] = flat
    return np.array([len(x) // WIDTH for x in raw], np.int64), wide.view(">u8").reshape(-1).astype(np.uint64)


def prefix_keys(size: np.ndarray, h: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the first sequences of each set, so many that similar sets share one.

    A key is the hash, the size and the number of sequences from its place on, both at most MOST.
    """
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    of = size[owner]
    first = place < of - np.ceil(of * similarity - 1e-9) + 1
    owner, h, of, place = owner[first], h[first], of[first], place[first]
    return owner, h << np.uint64(2 * PLACE) | (np.minimum(of, MOST) << PLACE | np.minimum(of - place, MOST)).astype(np.uint64)


def frequencies(df: DataFrame, key: str, text: str, words: int) -> np.ndarray:
    """How often the sequences of each cell of hashes occur in all records; one array of fixed size."""
    slices = 64

    def work(batches):
        made, find, total = Sequences(words), re.compile(TOKEN).findall, np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            _, h = made.of([find(t.lower()) for t in batch.column(0).to_pylist()])
            total += np.bincount((h >> np.uint64(64 - CELLS)).astype(np.int64), minlength=1 << CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in np.split(total, slices)], pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(*(x.to_pylist() for x in batch.columns)):
                sums[s] = sums.get(s, 0) + np.frombuffer(c, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    some = df.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    parts = some.select(text).mapInArrow(work, "slice int, counts binary")
    total = np.zeros(1 << CELLS, np.int64)
    for r in parts.repartition(8, "slice").mapInArrow(add, "slice int, counts binary").collect():  # 64 rows
        total[r["slice"] * len(total) // slices :][: len(total) // slices] = np.frombuffer(r["counts"], np.int64)
    return total.clip(max=(1 << 31) - 1).astype(np.int32)


def sequence_sets(df: DataFrame, key: str, text: str, words: int, least: int, *kept: str) -> DataFrame:
    """(key, kept.., signature, set): records with `least` distinct sequences of `words` words or more.

    Equal signatures mean equal word sequences. A set packs the hashes of the sequences, the rarest first; it is null
    where the task met the signature before.
    """
    schema = extended(df.select(key, *kept).schema, "signature long, set binary")
    counts = df.sparkSession.sparkContext.broadcast(frequencies(df, key, text, words))
    step = 1024

    def work(batches):
        made, find = Sequences(words), re.compile(TOKEN).findall
        met: set[int] = set()
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                lists = [find(t.lower()) for t in batch.column(batch.num_columns - 1).to_pylist()]
                owner, h = made.of(lists)
                size = np.bincount(owner, minlength=len(lists))
                rows = np.flatnonzero(size >= max(1, least))
                signatures = [xxhash.xxh3_64_intdigest(" ".join(lists[i])) - (1 << 63) for i in rows]
                first = [s not in met and not met.add(s) for s in signatures]
                if len(met) > 1_000_000:
                    met.clear()
                h = narrow(h[rarest_first(owner, h, counts.value)])
                ends = np.append(0, np.cumsum(size))
                sets = [h[ends[i] : ends[i + 1]].tobytes() if f else None for i, f in zip(rows, first)]
                head = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*head.columns[:-1], pa.array(signatures, pa.int64()), pa.array(sets, pa.binary())], [*batch.schema.names[:-1], "signature", "set"])

    return df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, *kept, text).mapInArrow(work, schema)


def meetings(made: DataFrame, buckets: int, similarity: float) -> DataFrame:
    """(class_a, class_b), class_a < class_b: signatures that share a sequence of their prefixes and may be similar by its place.

    Keys travel as packed bytes, one row for each bucket of keys and batch, with the signature and sketch of each record
    once. A task sorts the keys of its buckets and pairs the distinct signatures of equal hashes. At the first sequence
    that two sets share, no more can be shared than are left in either, so the smaller set has it early; sizes must be
    near, and sketches differ in no more bits than those of similar sets do, but for one in ten thousand at the least
    similarity. Other pairs aren't similar.
    """

    def pack(batches):
        for batch in batches:
            size, h = widened(batch.column(1).to_pylist())
            signature, bits = batch.column(0).to_numpy(), sketches(size, h)
            owner, key = prefix_keys(size, h, similarity)
            bucket = ((key >> np.uint64(2 * PLACE)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = np.flatnonzero(np.diff(ends)).tolist()
            parts = [order[ends[b] : ends[b + 1]] for b in own]
            held = [np.unique(owner[x], return_counts=True) for x in parts]
            columns = [[key[x].tobytes() for x in parts], [n.astype(np.int32).tobytes() for _, n in held], [signature[i].tobytes() for i, _ in held], [bits[i].tobytes() for i, _ in held]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "keys", "numbers", "signatures", "bits"])

    apart = most_apart(similarity)

    def pair(batches):
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for part, column, kind in zip(parts, batch.columns[1:], (np.uint64, np.int32, np.int64, np.uint64)):  # unsigned: bitwise_count takes absolute values
                part += [np.frombuffer(x, kind) for x in column.to_pylist()]
        if not parts[0]:
            return
        key, number, own, bits = (np.concatenate(part) for part in parts)
        bits, record = bits.reshape(-1, CHECKED // 64), np.repeat(np.arange(len(own)), number)
        signature = own[record]
        late = (key.astype(np.int64) & MOST) < least_shared(2 * ((key >> np.uint64(PLACE)).astype(np.int64) & MOST), similarity)
        order = np.lexsort((signature, key, late, key >> np.uint64(2 * PLACE)))
        key, signature, record, late = key[order], signature[order], record[order], late[order]
        new = np.append(True, (key[1:] != key[:-1]) | (signature[1:] != signature[:-1]))
        key, signature, record, late = key[new], signature[new], record[new], late[new]
        size, left = ((key >> np.uint64(PLACE)).astype(np.int64) & MOST), key.astype(np.int64) & MOST
        key = key >> np.uint64(2 * PLACE)
        ends = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        place = np.arange(len(key))
        rest = np.where(late, 0, np.repeat(ends[1:], np.diff(ends)) - place - 1)  # members of the same hash further on
        step, at = 1 << 20, 0
        total = np.cumsum(rest)
        while at < len(key):  # about `step` pairs at a time, whatever the keys hold
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step)))
            n = rest[at:to]
            if n.sum():
                a = np.repeat(place[at:to], n)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                may = (np.minimum(left[a], left[b]) >= least_shared(size[a] + size[b], similarity)) & (signature[a] != signature[b])
                may &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[may], b[may]
                near = np.bitwise_count(bits[record[a]] ^ bits[record[b]]).sum(1) <= apart
                x, y = signature[a[near]], signature[b[near]]
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["class_a", "class_b"])
            at = to

    packed = made.where(F.col("set").isNotNull()).select("signature", "set").mapInArrow(pack, "bucket int, keys binary, numbers binary, signatures binary, bits binary")
    return packed.repartition(buckets, "bucket").mapInArrow(pair, "class_a long, class_b long").distinct()


def among(ids: DataFrame) -> Callable[[Column], Column]:
    """A condition that is true for every signature of `ids` and false for most others, by a bitmap of fixed size."""
    s = F.col("signature")
    bit = F.shiftrightunsigned(s, MAPPED).bitwiseAND(63).cast("int")
    words = ids.select(s.bitwiseAND((1 << MAPPED) - 1).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    held = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # 2^MAPPED rows at most
    bits = np.zeros(1 << MAPPED, np.int64)
    bits[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    bitmap = ids.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf(BooleanType())
    def may(signature: pd.Series) -> pd.Series:
        x = signature.to_numpy(np.int64)
        return pd.Series(bitmap.value[x & ((1 << MAPPED) - 1)] >> (x >> MAPPED & 63) & 1 == 1)

    return may


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 5, similarity: float = 0.8, least: int = 1, kept: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the records with at least `least` distinct sequences of `words` words.

    links: (class_a, class_b, similarity) of classes of equal word sequences whose sets of sequences have a Jaccard
    similarity of `similarity` or more, class_a < class_b. members: (key, kept.., class) of every record with sequences
    enough, so copies are never expanded into pairs and no link between different texts is lost. Null and blank texts and null keys take part in nothing; equal
    texts under one key count once; an empty table gives empty results; extra columns are dropped.

    A class sends its set once from each task, so that one text held by a third of all rows is a few rows there. Sets
    are only shuffled and joined for classes that met another, but for the few that share their bit of a bitmap; texts
    are read once and never shuffled.
    """
    made = cut(sequence_sets(df, key, text, words, least, *kept))
    held = made.agg(F.sum(F.length("set"))).first()[0] or 0
    buckets = max(12, parallelism(df.sparkSession), int(held / WIDTH * (1 - similarity)) // BUCKET_KEYS)
    members = made.select(key, *kept, F.col("signature").alias("class")).distinct()
    met = cut(meetings(made, buckets, similarity))
    ids = met.select(F.col("class_a").alias("signature")).union(met.select("class_b")).distinct()
    sets = made.where(F.col("set").isNotNull()).where(among(ids)("signature")).join(ids, "signature", "left_semi").groupBy("signature").agg(F.first("set").alias("set"))
    one = sets.select(F.col("signature").alias("class_a"), F.col("set").alias("_a"))
    two = sets.select(F.col("signature").alias("class_b"), F.col("set").alias("_b"))
    both = met.join(one, "class_a").join(two, "class_b").withColumn("similarity", jaccard("_a", "_b"))
    return both.where(F.col("similarity") >= similarity).select("class_a", "class_b", "similarity"), members


@F.pandas_udf(DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """The similarity of packed sets."""
    n, x = widened(a.tolist())
    m, y = widened(b.tolist())
    owner = np.append(np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m))
    h = np.append(x, y)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    shared = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (h[1:] == h[:-1])], minlength=len(n))
    return pd.Series(shared / (n + m - shared))


def record_pairs(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records within a class or in linked classes; as large as it must be."""
    members = members.select("class", key).distinct()
    a = members.select(F.col("class").alias("class_a"), F.col(key).alias("_a"))
    b = members.select(F.col("class").alias("class_b"), F.col(key).alias("_b"))
    across = links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("_a", "_b")
    several = members.groupBy("class").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(F.col("class").alias("class_a"))
    inside = a.join(several, "class_a").join(b, F.col("class_a") == F.col("class_b")).where(F.col("_a") < F.col("_b")).select("_a", "_b")
    return across.union(inside).select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))


def groups(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, group, n_links): each record's group, the smallest class that its class is connected with, and its links.

    Classes take the least label of their neighbours, and labels are followed to their own labels, until none changes;
    each round is written to the shared checkpoint folder. Labels and links stay distributed.
    """
    edges = cut(links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).union(links.select("class_b", "class_a")))
    label = members.select(F.col("class").alias("u")).distinct().withColumn("l", F.col("u"))
    while True:
        near = edges.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        lower = label.join(near, "u", "left").select("u", F.least("l", F.coalesce("m", "l")).alias("n"), F.col("l").alias("old"))
        jump = lower.select(F.col("u").alias("n"), F.col("n").alias("j"))
        new = cut(lower.join(jump, "n").select("u", F.least("n", "j").alias("l"), "old"))
        changed = new.where(F.col("l") < F.col("old")).limit(1).count()
        label = new.select("u", "l")
        if not changed:
            break
    degree = edges.groupBy(F.col("u").alias("class")).agg(F.count(F.lit(1)).alias("n_links"))
    joined = members.join(label.select(F.col("u").alias("class"), F.col("l").alias("group")), "class").join(degree, "class", "left")
    return joined.select(key, "group", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
