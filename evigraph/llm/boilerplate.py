"""Problem 1: page boilerplate mixed with main content, by tree scoring.

A page is a tree: the page, its chunks, their containers (runs of lines that belong together), their lines. A line
passes points for its length and commas to its container, discounted by link density; a container's points, discounted
once more by the density of the whole, make the best container of the page. The best container is kept, and with it
its siblings that are mostly no links or have a share of the best one's points; the lines of the others are boilerplate.

Texts have no anchors left, so the link density of a line is learnt, with no list of phrases. What is shown again on
other pages and isn't a sentence, nor a heading of some outline, nor a name of an entity, is taken for links first; what
is a sentence said on few pages, for content. Words (and signs between them) then get evidence by how often the
distinct lines of either side have them, each distinct line counting once, however many pages show it. With that the
trees are scored, the lines are sorted anew by what their containers came to, and the evidence is taken again, ROUNDS
times; so a teaser that is on one page only is learnt from the side column it stands in.

The evidence is a table of SLOTS hashed words, whose size doesn't grow with the pages. Whether a line is shown on other
pages is counted over all lines and joined to the chunks.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.markup import nodes
from evigraph.runtime import cut, extended

#: A line is repeated from this number of pages on; more than MANY pages say no more than MANY.
LEAST_PAGES, MANY = 3, 60
#: A container of this link density is links.
LINKS = 0.5
#: A sibling that is links is kept from this share of the best container's points on.
SIBLING = 0.2
#: Slots of the table of evidence, times that it is taken again, and the most that a word can say (natural logarithm).
SLOTS, ROUNDS, MOST = 1 << 18, 2, 4.0
#: Letters of a longer word.
LONG = 4
#: Words before a line counts as a sentence, if it has an end mark.
SENTENCE_WORDS = 5
#: Evidence (natural logarithms) that a sentence and a heading start with, and for each e-fold of a line's pages.
SENTENCE, HEADING, REPEATED_SENTENCE, REPEATED = -2.0, -1.0, 1.5, 1.0
#: A line is surely links from this density on; a repeated sentence is if this share of its longer words is hardly said elsewhere.
SURE, NOVEL = 0.6, 0.5

MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->|&(?:[a-zA-Z]+|#\d+);|\*\*+|__|~~|`|'''?|\[\[(?:[^\]|]*\|)?|\]\]|\\(?:textbf|emph|textit)\{([^{}]*)\}|\{\{[^{}]*\}\}")
STRUCTURE = re.compile(r"^\s*(?:[|!{]|\\[a-zA-Z\[\]]|\[[^\[\]]+\]:\s|={2,}|-{3,}|```|~~~)")
WORD = re.compile(r"[^\W\d_]+")
SIGN = re.compile(r"[^\w\s.,;:!?'\"()\-]")
DOMAIN = re.compile(r"\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b")
#: Natures of lines: markup and blanks, short lines, sentences. Known headings and names are told by the joined counts.
PLAIN, SHORT, SAID = 0, 1, 2
IS_HEADING, IS_NAME = 1, 2


def plain(line: str) -> str:
    """A line without inline markup, white space at both ends trimmed."""
    return MARKUP.sub(lambda m: m.group(1) or "", line).strip()


def line_key(bare: str) -> int:
    """What lines, headings and names are compared by: letter case, numbers, web hosts and the kind of blanks aside."""
    masked = re.sub(r"\d+", "0", DOMAIN.sub("@", bare.lower()))
    return xxhash.xxh3_64_intdigest(re.sub(r"[\s\-_]+", " ", masked).strip()) - (1 << 63)


@lru_cache(500_000)
def slot(word: str) -> int:
    """The word's slot in the table of evidence, with a bit above it for a longer word."""
    return xxhash.xxh3_64_intdigest(word) % SLOTS | (SLOTS if len(word) >= LONG else 0)


def traits(bare: str) -> tuple[list[int], int]:
    """(slots of the distinct words and signs, number of words) of a line."""
    words = WORD.findall(bare.lower())
    own = {slot(w) for w in words} | {slot("~" + c) for c in SIGN.findall(bare)}
    if "  " in bare:
        own.add(slot("~gap"))
    return sorted(own), len(words)


def read_lines(df: DataFrame, key: str, page: str, text: str, headings: str, names: str) -> DataFrame:
    """(key, page, at, keys, words, heads, names): the lines of each row that aren't blank, as numbers.

    `at` packs (line number, nature, length, commas, number of slots) of each line, `words` their slots; `keys` has what
    each is compared by, `heads` and `names` the same of the headings and names that come with the row.
    """
    kind = df.schema[page].dataType.simpleString()

    def work(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                texts, heads, called = (batch.column(i).to_pylist() for i in (2, 3, 4))
                out: list[list] = [[], [], [], [], []]
                for t, hs, ns in zip(texts, heads, called):
                    at, keys, words = [], [], []
                    for no, line in enumerate((t or "").split("\n")):
                        if not line.strip():
                            continue
                        bare = plain(line)
                        own, n = traits(bare)
                        said = n >= SENTENCE_WORDS and bare[-1] in ".!?:;"
                        nature = PLAIN if not bare or STRUCTURE.search(line) or nodes(line) else SAID if said else SHORT
                        at += (no, nature, len(bare), bare.count(","), len(own))
                        keys.append(line_key(bare))
                        words += own
                    out[0].append(np.array(at, np.int32).tobytes())
                    out[1].append(keys)
                    out[2].append(np.array(words, np.int32).tobytes())
                    out[3].append([line_key(plain(x)) for x in hs or [] if x])
                    out[4].append([line_key(x) for x in ns or [] if x])
                longs = pa.list_(pa.int64())
                columns = [pa.array(c, k) for c, k in zip(out, (pa.binary(), longs, pa.binary(), longs, longs))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [key, "page", "at", "keys", "words", "heads", "names"])

    schema = extended(df.select(key).schema, f"page {kind}, at binary, keys array<bigint>, words binary, heads array<bigint>, names array<bigint>")
    return df.where(F.col(text).isNotNull()).select(key, page, text, headings, names).mapInArrow(work, schema)


def known_lines(read: DataFrame) -> DataFrame:
    """(line, n, what): pages that show each line, for repeated ones, headings and names; `what` adds IS_HEADING and IS_NAME."""
    shown = read.select("page", F.explode("keys").alias("line")).distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("h"), F.lit(0).alias("m"))
    heads = read.select(F.explode("heads").alias("line")).distinct().select("line", F.lit(0).cast("long").alias("n"), F.lit(1).alias("h"), F.lit(0).alias("m"))
    names = read.select(F.explode("names").alias("line")).distinct().select("line", F.lit(0).cast("long").alias("n"), F.lit(0).alias("h"), F.lit(1).alias("m"))
    every = shown.union(heads).union(names).groupBy("line").agg(F.sum("n").alias("n"), F.max("h").alias("h"), F.max("m").alias("m"))
    what = F.col("h") * IS_HEADING + F.col("m") * IS_NAME
    return every.where((F.col("n") >= LEAST_PAGES) | (what > 0) & (F.col("n") > 0)).select("line", F.col("n").cast("int").alias("n"), what.cast("int").alias("what"))


def marked(read: DataFrame, key: str) -> DataFrame:
    """`read` with `marks`, an array of (place, n, what) of its known lines.

    Lines that make a thousandth of all go by broadcast, at most a thousand rows; the others are joined, so that no key
    of the join is hot.
    """
    lines = read.select(key, F.posexplode("keys").alias("place", "line"))
    known = cut(known_lines(read))
    total = read.agg(F.sum(F.size("keys"))).first()[0] or 0
    hot = F.col("n") * 1000 >= total
    struct = F.struct("place", "n", "what")
    common = lines.join(F.broadcast(known.where(hot)), "line").select(key, struct.alias("mark"))
    rare = lines.join(known.where(hot).select("line"), "line", "left_anti").join(known.where(~hot), "line").select(key, struct.alias("mark"))
    own = common.union(rare).groupBy(key).agg(F.collect_list("mark").alias("marks"))  # at most the lines of one row
    return read.join(own, key, "left").select(key, "page", "at", "words", "marks")


class Lines:
    """The lines of a batch of rows, as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        column = dict(zip(batch.schema.names, batch.columns))
        at = [np.frombuffer(x, np.int32).reshape(-1, 5) for x in column["at"].to_pylist()]
        sizes = np.array([len(x) for x in at], np.int64)
        self.ends = np.append(0, np.cumsum(sizes))
        flat = np.concatenate(at) if at else np.zeros((0, 5), np.int32)
        self.no, self.nature, self.length, self.commas, held = (flat[:, i].astype(np.int64) for i in range(5))
        words = np.frombuffer(b"".join(column["words"].to_pylist()), np.int32).astype(np.int64)
        self.words, self.long = words % SLOTS, words >= SLOTS
        self.owner, self.held = np.repeat(np.arange(len(flat)), held), held
        self.n, self.what = np.ones(len(flat), np.int64), np.zeros(len(flat), np.int64)
        marks = column["marks"].combine_chunks() if isinstance(column["marks"], pa.ChunkedArray) else column["marks"]
        flatted = marks.flatten()
        many = np.nan_to_num(marks.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        place = flatted.field("place").to_numpy(zero_copy_only=False) + np.repeat(self.ends[:-1], many)
        place = place.astype(np.int64)
        self.n[place] = np.maximum(flatted.field("n").to_numpy(zero_copy_only=False), 1)
        self.what[place] = flatted.field("what").to_numpy(zero_copy_only=False)
        self.heading = (self.what & IS_HEADING > 0) & (self.nature != PLAIN)
        self.nature = np.where((self.what & IS_NAME > 0) & ~self.heading, PLAIN, self.nature)
        self.said = (self.nature == SAID) & ~self.heading
        self.short = (self.nature == SHORT) & ~self.heading
        self.many = self.n >= LEAST_PAGES
        self.weight = np.where(self.many, 1 / self.n, 1.0)

    def densities(self, evidence: np.ndarray | None) -> np.ndarray:
        """The link density of each line."""
        x = np.zeros(len(self.no))
        if evidence is not None:
            x = np.bincount(self.owner, evidence[self.words], minlength=len(x)) / np.sqrt(np.maximum(self.held, 1))
        pages = np.where(self.many, np.log(np.minimum(self.n, MANY)), 0)
        x = np.where(self.heading, HEADING, x + np.where(self.said, SENTENCE + REPEATED_SENTENCE * pages, REPEATED * pages))
        return np.where((self.nature == PLAIN) | (self.held == 0), 0.0, 1 / (1 + np.exp(-x)))

    def containers(self, density: np.ndarray) -> np.ndarray:
        """The number of each line's container, rising.

        Runs of sure links and of content are containers. A line that is neither goes with the links above it, as the
        items of a side column do, but what stands right above text is that text's heading.
        """
        number, out = -1, np.zeros(len(density), np.int64)
        sure = (density >= SURE).tolist()
        text = (self.said & (density < LINKS)).tolist()
        content = (self.said | (self.nature == PLAIN)).tolist()
        heading = self.heading.tolist()
        for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist()):
            state = None
            for i in range(a, b):
                above = i + 1 < b and text[i + 1]
                if heading[i] and not above:
                    j = i + 1
                    while j < min(b, i + 3) and sure[j]:
                        j += 1
                    above = j < b and text[j]
                new = "links" if sure[i] else "content" if content[i] or above else state or "content"
                if new != state or not content[i] and new == "content" and above:
                    number += 1
                state = new
                out[i] = number
        return out

    def scores(self, density: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(container of each line, link share and points of each container)."""
        container = self.containers(density)
        n = int(container[-1]) + 1 if len(container) else 0
        size = self.length + 1.0
        share = np.bincount(container, density * size, minlength=n) / np.bincount(container, size, minlength=n)
        points = (1 + self.commas + np.minimum(self.length / 100, 3)) * (1 - density)
        return container, share, np.bincount(container, points, minlength=n) * (1 - share)


def evidence_of(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """What each slot says for links, from counts in distinct lines of content and of links."""
    content, links = counts
    both = content + links
    says = np.log((links + 0.1) / (sums[1] + 1)) - np.log((content + 0.1) / (sums[0] + 1))
    return (np.clip(says, -MOST, MOST) * both / (both + 0.5)).astype(np.float32)


def learn(rows: DataFrame, evidence: np.ndarray | None, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the lines of content and of links, by what the trees come to with `evidence`.

    Without evidence lines are sorted by their nature and repetition alone. `before` holds the counts of the last round.
    What comes to the driver is a table of fixed size.
    """
    slices = 16
    held = rows.sparkSession.sparkContext.broadcast((evidence, before))

    def work(batches):
        evidence, before = held.value
        total = np.zeros((2, SLOTS + 1))
        for batch in batches:
            lines = Lines(batch)
            if not len(lines.no):
                continue
            if evidence is None:
                content, links = lines.said & ~lines.many, lines.short & lines.many
            else:
                density = lines.densities(evidence)
                container, share, _ = lines.scores(density)
                links = (share >= LINKS)[container] & (lines.nature != PLAIN)
                rare = lines.long & (before[0][lines.words] <= 1e-4 * before[0, SLOTS])
                novel = np.bincount(lines.owner, rare, minlength=len(links)) / np.maximum(np.bincount(lines.owner, lines.long, minlength=len(links)), 1)
                links |= lines.said & lines.many & (novel >= NOVEL)
                content = ~links & (lines.said & ~lines.many | lines.short & (density < LINKS))
            for k, mine in enumerate((content, links)):
                weight = np.where(mine, lines.weight, 0.0)
                total[k, :SLOTS] += np.bincount(lines.words, weight[lines.owner], minlength=SLOTS)
                total[k, SLOTS] += weight.sum()
        parts = [*np.split(total[:, :SLOTS], slices, axis=1), total[:, SLOTS]]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices + 1), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(*(x.to_pylist() for x in batch.columns)):
                sums[s] = sums.get(s, 0) + np.frombuffer(c, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    summed = rows.mapInArrow(work, "slice int, counts binary").repartition(8, "slice").mapInArrow(add, "slice int, counts binary").collect()  # 17 rows
    counts, sums = np.zeros((2, SLOTS + 1)), np.zeros(2)
    for r in summed:
        c = np.frombuffer(r["counts"], np.float64).reshape(2, -1)
        if r["slice"] == slices:
            sums = c[:, 0]
        else:
            counts[:, r["slice"] * SLOTS // slices :][:, : SLOTS // slices] = c
    counts[:, SLOTS] = sums
    return counts, sums


def find_boilerplate(df: DataFrame, key: str, page: str, text: str, headings: str, names: str) -> DataFrame:
    """(key, line_no) of each line that isn't blank and not of the page's own content, over rows of chunks of pages.

    Lines are the pieces between "\\n", counted from 0. `headings` and `names` are arrays of a chunk's own headings and of
    the entities it names. `df` has one row per key. Null and blank texts give no rows, null headings and names count as
    none; an empty table gives no rows; extra columns are dropped. Texts are read once; what is shuffled are numbers of
    their lines. Pages are never gathered: only the points of the best container are taken by page, and joined back with
    salt, so that a page or a host with a third of all chunks can't load one task.
    """
    rows = cut(marked(cut(read_lines(df, key, page, text, headings, names)), key))
    evidence, counts = None, None
    for _ in range(ROUNDS + 1):
        counts, sums = learn(rows, evidence, counts)
        evidence = evidence_of(counts[:, :SLOTS], sums)
    held = rows.sparkSession.sparkContext.broadcast(evidence)
    schema = extended(df.select(key).schema, f"page {df.schema[page].dataType.simpleString()}, score double, doubtful array<struct<points:double,lines:array<int>>>")

    def work(batches):
        kind = pa.list_(pa.struct([("points", pa.float64()), ("lines", pa.list_(pa.int32()))]))
        for batch in batches:
            lines = Lines(batch)
            container, share, points = lines.scores(lines.densities(held.value))
            first = np.searchsorted(container, np.arange(len(share) + 1)) if len(container) else np.zeros(1, np.int64)
            best, doubtful = [], []
            for a, b in zip(lines.ends[:-1].tolist(), lines.ends[1:].tolist()):
                mine = range(int(container[a]), int(container[b - 1]) + 1) if a < b else range(0)
                best.append(max((float(points[c]) for c in mine), default=0.0))
                doubtful.append([{"points": float(points[c]), "lines": lines.no[first[c] : first[c + 1]].tolist()} for c in mine if share[c] >= LINKS])
            column = dict(zip(batch.schema.names, batch.columns))
            values = pa.array(best, pa.float64())
            yield pa.RecordBatch.from_arrays([column[key], column["page"], values, pa.array(doubtful, kind)], [key, "page", "score", "doubtful"])

    scored = cut(rows.mapInArrow(work, schema))
    salts = 8
    best = scored.groupBy("page").agg(F.max("score").alias("_best")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    some = scored.where(F.size("doubtful") > 0).select(key, "page", "doubtful", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("_salt"))
    joined = some.join(best, ["page", "_salt"])
    dropped = F.filter("doubtful", lambda c: c["points"] < SIBLING * F.col("_best"))
    return joined.select(key, F.explode(F.flatten(F.transform(dropped, lambda c: c["lines"]))).alias("line_no"))


def keep_content(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with the boilerplate lines taken out; rows without any stay as they are."""
    drop = found.groupBy(key).agg(F.array_sort(F.collect_set("line_no")).alias("_drop"))  # at most the lines of one chunk
    joined = df.select(key, text).join(drop, key, "left")
    lines = F.split(F.col(text), "\n", -1)
    kept: Column = F.filter(lines, lambda _, i: ~F.array_contains(F.col("_drop"), i))
    return joined.select(key, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text))
