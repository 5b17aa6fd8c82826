"""Problem 8: a corpus encoded by a public byte-level BPE vocabulary, in two tiers.

Text is cut into pre-tokens and looked up a whole Arrow batch at a time with numpy; no step runs per document or per
token in Python except for pre-tokens that aren't in the vocabulary.

Tier 1: a minimal perfect hash over all vocabulary entries of at most 16 bytes. An entry is held as two 64-bit words and
a length, which are compared in full, so a lookup is exact and no fingerprint can be mistaken.
Tier 2: other pre-tokens are merged by a heap of adjacent pairs over a doubly linked list of bytes, and remembered.

The tables depend on the vocabulary alone (about 50,000 entries, under 2 MB), which bounds what is broadcast.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import extended

LETTER, NUMBER, SPACE, OTHER, EDGE = 1, 2, 3, 4, 0
#: White space as the pattern's \s has it. Fixed values.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction. Fixed values.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Bytes of text worked on at once by a task; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
#: Pre-tokens a worker remembers before it starts anew.
REMEMBERED = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        first = unicodedata.category(chr(point))[0]
        if first == "L":
            table[point] = LETTER
        elif first == "N":
            table[point] = NUMBER
    table[WHITE] = SPACE
    return table


def mix(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ n.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def moved(h: np.ndarray, by: np.ndarray, size: int) -> np.ndarray:
    """The slot of a key in a bucket displaced by `by`."""
    with np.errstate(over="ignore"):
        x = (h ^ by.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return (x % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Hash and displace: as many slots as keys; a bucket of one key names its slot directly (displacement below 0)."""

    size: int
    displacement: np.ndarray
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(low: np.ndarray, high: np.ndarray, length: np.ndarray, value: np.ndarray) -> PerfectHash:
        size = len(low)
        buckets = size // 3 + 1
        h = mix(low, high, length)
        bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        counts = np.diff(starts)
        free, slot = np.ones(size, bool), np.full(size, -1, np.int64)
        displacement = np.zeros(buckets, np.int64)
        tries = np.arange(1, 257)
        for b in np.argsort(-counts, kind="stable"):
            if counts[b] < 2:
                break
            keys, first = order[starts[b] : starts[b + 1]], 0
            while True:
                at = moved(h[keys][None, :], (tries + first)[:, None], size)
                good = free[at].all(1)
                if len(keys) > 1:
                    good &= (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    displacement[b], slot[keys] = first + k + 1, at[k]
                    free[at[k]] = False
                    break
                first += 256
        single = np.flatnonzero(counts == 1)
        left = np.flatnonzero(free)
        slot[order[starts[single]]] = left[: len(single)]
        displacement[single] = -1 - left[: len(single)]
        out = PerfectHash(size, displacement, *(np.empty(size, x.dtype) for x in (low, high, length, value)))
        for to, of in ((out.low, low), (out.high, high), (out.length, length), (out.value, value)):
            to[slot] = of
        return out

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for keys that aren't held."""
        h = mix(low, high, length)
        by = self.displacement[(h >> np.uint64(40)).astype(np.int64) % len(self.displacement)]
        at = np.where(by < 0, -1 - by, moved(h, by, self.size))
        held = (self.low[at] == low) & (self.high[at] == high) & (self.length[at] == length)
        return np.where(held, self.value[at], -1)


def words16(data: bytes) -> tuple[int, int]:
    return int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")


class Encoder:
    """Encodes batches of texts by a file of base64 tokens and ranks, the rank being the id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        short = [(*words16(k), len(k), v) for k, v in self.ranks.items() if len(k) <= 16]
        self.table = PerfectHash.build(*(np.array(x, t) for x, t in zip(zip(*short), (np.uint64, np.uint64, np.uint8, np.int32))))
        self.kept: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the adjacent pair of lowest rank is joined, leftmost first, until no pair is an entry."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != to:
                continue  # one of the two parts has been joined since
            alive[j] = False
            end[i], after[i] = to, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def starts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in `points`; `edges` marks one extra place behind each text, which belongs to none."""
        cls = classes()[points]
        cls[edges] = EDGE
        begin = np.empty(len(cls), bool)
        begin[0] = True
        np.not_equal(cls[1:], cls[:-1], out=begin[1:])
        begin[1:] |= (cls[1:] == EDGE) | (cls[:-1] == EDGE)
        # the last white space before something else stands alone, or leads it if it is a blank
        last = np.zeros(len(cls), bool)
        last[:-1] = (cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != EDGE)
        run = begin.copy()
        begin |= last
        begin[1:] &= ~(last[:-1] & (points[:-1] == 0x20))
        # contractions: an apostrophe alone in its run that leads its pre-token
        at = np.flatnonzero((points == 0x27) & (cls == OTHER) & begin & run)
        if len(at):
            at = at[(at + 1 < len(cls))]
            at = at[cls[at + 1] == LETTER]
            room = np.append(points, [0, 0])
            one, two = room[at + 1], room[at + 2]
            size = np.zeros(len(at), np.int64)
            for c in CONTRACTIONS:
                hit = (one == ord(c[0])) & ((len(c) == 1) | (two == ord(c[-1])))
                size[hit & (size == 0)] = len(c)
            at, size = at[size > 0], size[size > 0]
            begin[at + 1] = False
            begin[at + 1 + size] = True
        return begin

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        whole = "\n".join(t or "" for t in texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        raw = whole.encode("utf-8")
        edges = np.cumsum([len(t or "") + 1 for t in texts]) - 1
        begin = self.starts(points, edges)
        place = np.flatnonzero(begin)
        if len(raw) == len(points):
            at = place
        else:
            wide = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            at = (np.cumsum(wide) - wide)[place]
        size = np.diff(np.append(at, len(raw)))
        is_edge = np.zeros(len(points), bool)
        is_edge[edges] = True
        real = ~is_edge[place]
        # edges end the run before them, so the piece in front never holds the extra place
        at, size = at[real], size[real]
        text_no = np.searchsorted(edges, place[real])
        found = self.look_up(raw, at, size)
        count = np.ones(len(at), np.int64)
        missed = np.flatnonzero(found < 0)
        lists = []
        kept = self.kept
        for i, s, n in zip(missed.tolist(), at[missed].tolist(), size[missed].tolist()):
            piece = raw[s : s + n]
            if (ids := kept.get(piece)) is None:
                if len(kept) > REMEMBERED:
                    kept.clear()
                ids = kept[piece] = self.merge(piece)
            lists.append(ids)
        count[missed] = [len(x) for x in lists]
        to = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        out[to[found >= 0]] = found[found >= 0]
        if lists:
            flat = np.fromiter((x for ids in lists for x in ids), np.int32)
            n = count[missed]
            out[np.repeat(to[missed], n) + np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return out, np.bincount(text_no, weights=count, minlength=len(texts)).astype(np.int64)

    def look_up(self, raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.int64)
        padded = np.frombuffer(raw + bytes(24), np.uint8)
        word = np.ndarray((len(raw) + 16,), "<u8", padded.data, strides=(1,))
        keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
        low = word[at] & keep[np.minimum(size, 8)]
        high = word[at + 8] & keep[np.clip(size - 8, 0, 8)]
        found = self.table.find(low, high, np.minimum(size, 255).astype(np.uint8)).astype(np.int64)
        found[size > 16] = -1
        return found


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, built once in each process."""
    return Encoder(path)


def slices(texts: list[str | None]):
    """Runs of texts of about SLICE_BYTES, so that a worker's memory doesn't grow with the batch."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_BYTES:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str | None = None, only_count: bool = False) -> DataFrame:
    """(key, ids) of each row, or (key, n_tokens) with only_count; special tokens are ordinary text.

    Null and empty texts have no ids. Rows repeat as they come, ties don't arise, other columns are dropped, and the
    key may be of any type and null. One narrow pass: no shuffle, so a hot source or key can't load one task.
    """
    path = vocabulary or default_vocabulary()
    built = df.sparkSession.sparkContext.broadcast(encoder(path))
    name = "n_tokens" if only_count else "ids"

    def work(batches):
        enc = built.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = 0
            for part in slices(texts):
                ids, counts = enc.encode(part)
                if only_count:
                    value = pa.array(counts.astype(np.int32))
                else:
                    value = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), value], [key, name])
                done += len(part)

    schema = extended(df.select(F.col(key).alias(key)).schema, f"{name} {'int' if only_count else 'array<int>'}")
    return df.select(F.col(key).alias(key), F.col(text).alias("_text")).mapInArrow(work, schema)
