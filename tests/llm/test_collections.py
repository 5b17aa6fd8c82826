"""Term weighting, near duplicates, neighbours and co-occurrence against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from evigraph.llm import cooccur, distinctive, neardup, neighbours


def test_terms_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}word" for a in "abcdefgh" for b in "xyz"]
    texts = {f"r{i}": " ".join(rng.choice(vocabulary[: 6 + i % 18]) for _ in range(rng.randint(0, 25))) for i in range(40)}
    rows = [*texts.items(), ("null", None), ("none", "a b c 1 2")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("term", F.lit("clash"))
    n = Counter(w for t in texts.values() for w in set(t.split()))
    want = {}
    for k, t in texts.items():
        words = t.split()
        for w, c in Counter(words).items():
            if c >= 2 and 2 <= n[w] <= 20:
                near = {o for i, x in enumerate(words) if x == w for o in words[max(0, i - 3) : i + 4]} - {w}
                want[k, w] = (c, len(near), n[w], len(near) * np.log(len(rows) / n[w]))
    got = {(r["id"], r["term"]): (r["tf"], r["degree"], r["n_records"], r["score"]) for r in distinctive.text_terms(df, "id", "text", 2, 2, 20).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert distinctive.text_terms(df.limit(0), "id", "text").count() == 0


def test_entities_and_values(spark):
    rows = [("a", ["Lobula  Plate", "lobula-plate", None, " "]), ("b", ["LOBULA_PLATE", "Calyx"]), ("c", None), ("d", [])]
    df = spark.createDataFrame(rows, "id string, e array<string>").withColumn("s", cooccur.entity_set(F.col("e")))
    assert [r["s"] for r in df.orderBy("id").collect()] == [["lobula plate"], ["calyx", "lobula plate"], [], []]
    got = {(r["id"], r["term"]): r["n_records"] for r in distinctive.value_terms(df, "id", "s", 2, 8).collect()}
    assert got == {("a", "lobula plate"): 2, ("b", "lobula plate"): 2}


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    sets = [sorted(rng.sample("abcdefg", rng.randint(0, 4))) for _ in range(300)] + [["a", "b"]] * 200
    rows = [(s + s[:1],) for s in sets] + [(None,), ([None, "a"],)]
    sets += [["a"]]
    df = spark.createDataFrame(rows, "items array<string>").withColumn("weight", F.lit("clash"))
    single, pair = Counter(x for s in sets for x in s), Counter(p for s in sets for p in combinations(s, 2))
    n = sum(bool(s) for s in sets)
    got = {(r["item_a"], r["item_b"]): r for r in cooccur.together(df, "items", 5).collect()}
    assert got.keys() == {p for p, c in pair.items() if c >= 5}
    for (a, b), r in got.items():
        assert (r["n_ab"], r["n_a"], r["n_b"], r["n"]) == (pair[a, b], single[a], single[b], n)
        assert np.isclose(r["lift"], pair[a, b] * n / (single[a] * single[b]))
    assert cooccur.together(df.limit(0), "items").count() == 0


def test_golay_code():
    near = neardup.near_table()
    counts = (near >= 0).sum(1)
    assert set(counts) == {1, 6} and (counts == 6).sum() == 1771
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 3000)
    flips = np.array([(1 << a) ^ (1 << b) for a, b in rng.integers(0, 23, (3000, 2))])  # none or two bits
    keys = lambda v: [{int(c) for c, e in zip((w ^ near[s]) >> 11, near[s]) if e >= 0} for w, s in zip(v, neardup.syndrome(v))]
    assert all(a & b for a, b in zip(keys(x), keys(x ^ flips)))


def shingle_set(t, k):
    w = [x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()]
    return set(zip(*(w[i:] for i in range(k))))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"{rng.choice('bcdfgklmnp')}{rng.choice('aeiou')}{rng.choice('rstvz')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(900)]
    rows = []
    for i in range(150):
        base = [rng.choice(words) for _ in range(90)]
        rows.append((f"a{i:03d}", " ".join(base)))
        if i < 100:
            other = base[:]
            for _ in range(rng.randint(0, 8)):
                other[rng.randrange(len(other))] = rng.choice(words)
            if rng.random() < 0.5:
                other.insert(rng.randrange(90), rng.choice(words))
            rows.append((f"b{i:03d}", " ".join(other).capitalize() + "."))
    rows += [("null", None), ("blank", " "), ("short", "too short"), ("copy1", rows[0][1]), ("copy1", rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("signature", F.lit("clash"))
    sets = {k: s for k, t in rows if k and t and len(s := shingle_set(t, 3)) >= 30}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    links, members = neardup.near_duplicates(df, "id", "text", 3, 0.6, 30)
    got = {(r["id_a"], r["id_b"]) for r in neardup.record_pairs(links, members, "id").collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    group = {r["id"]: r["group"] for r in neardup.groups(links, members, "id").collect()}
    assert group.keys() == sets.keys() and all(group[a] == group[b] for a, b in got)
    empty = neardup.near_duplicates(df.limit(0), "id", "text")
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_near_duplicates_just_above_the_least_similarity(spark):
    rng = random.Random(7)
    words = [f"{rng.choice('bcdfgklmnp')}{rng.choice('aeiou')}{rng.choice('rstvz')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(2000)]
    rows = [(f"n{i:03d}", " ".join(["common", "opening", "of", "all", "texts", *(rng.choice(words) for _ in range(rng.randint(40, 200)))])) for i in range(200)]
    for i in range(200):  # one passage inserted or appended, as long as the similarity lets it be
        base = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        at = rng.choice([len(base), rng.randrange(len(base))])
        added = [rng.choice(words) for _ in range(int(len(base) * rng.uniform(0.5, 0.68)))]
        rows += [(f"a{i:03d}", " ".join(base)), (f"b{i:03d}", " ".join(base[:at] + added + base[at:]))]
    sets = {k: shingle_set(t, 3) for k, t in rows}
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    want = {p for p, s in near.items() if s >= 0.6}
    assert len(want) > 80 and max(near[p] for p in want) < 0.7
    links, members = neardup.near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", 3, 0.6, 30)
    assert {(r["id_a"], r["id_b"]) for r in neardup.record_pairs(links, members, "id").collect()} == want


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 300)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 64))
    m = np.concatenate([c + 0.35 * rng.normal(size=(7, 64)) for c in centres] + [rng.normal(size=(200, 64))])
    ids = [f"v{i:04d}" for i in range(len(m))]
    m[1500:1508] = m[1500]  # copies
    rows = [(i, (v * rng.uniform(0.5, 2)).tolist()) for i, v in zip(ids, m)]
    rows += [("null", None), ("zero", [0.0] * 64), ("short", [1.0]), ("nan", [float("nan")] * 64), ("inf", [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("score", F.lit("clash"))
    out = neighbours.most_similar(df, "id", "embedding", 5, 64).collect()
    got = {}
    for r in out:
        got.setdefault(r["id"], set()).add(r["neighbour"])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hit = sum(len(got.get(ids[i], set()) & {ids[j] for j in np.argsort(-s[i])[:5]}) for i in range(len(m)) if not 1500 <= i < 1508)
    assert hit >= 0.95 * 5 * (len(m) - 8)
    assert got["v1500"] < {f"v{i}" for i in range(1500, 1508)} and all(len(v) == 5 for v in got.values()) and set(got) == set(ids)
    assert neighbours.most_similar(df.limit(0), "id", "embedding").count() == 0
    assert len(neighbours.most_similar(df.limit(3), "id", "embedding").collect()) == 6


def test_vectors_are_shuffled_once_however_many_cells_they_visit(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 32)
    rng = np.random.default_rng(8)
    m = rng.normal(size=(2000, 64)).astype(np.float32)  # far from each other, so that every vector visits most cells
    m[:9] = m[0]
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(m)]
    rows += rows[100:200] + [("v0300", m[301].tolist()), (None, m[0].tolist())]  # delivered again, once with another vector
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    out = neighbours.most_similar(spark.createDataFrame(rows, "id string, embedding array<float>"), "id", "embedding", 5, 64).collect()
    assert written() - before < 4 * m.nbytes
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert len(got) == 2000 and all(len(v) == len(set(v)) == 5 and k not in v for k, v in got.items())
    assert got["v0008"] == ["v0000", "v0001", "v0002", "v0003", "v0004"] and got["v0002"] == ["v0000", "v0001", "v0003", "v0004", "v0005"]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    own = [i for i in range(9, 2000) if i not in (300, 301)]
    assert sum(len({int(x[1:]) for x in got[f"v{i:04d}"]} & set(np.argsort(-s[i])[:5].tolist())) for i in own) >= 0.95 * 5 * len(own)


def test_sets_that_met_no_other_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(neardup, "frequencies", lambda *_: np.zeros(1 << neardup.CELLS, np.int32))
    rng = random.Random(9)
    rows = [(f"a{i:03d}", " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))) for i in range(300)]
    rows += [(f"b{i:03d}", rows[i][1] + " and more") for i in range(10)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    links, members = neardup.near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", 3, 0.95)
    got = {(r["id_a"], r["id_b"]) for r in neardup.record_pairs(links, members, "id").collect()}
    assert got == {(f"a{i:03d}", f"b{i:03d}") for i in range(10)}
    assert written() - before < 300 * 3000 * neardup.WIDTH / 2


def test_sequences_of_all_records_are_counted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COUNTED", 20, raising=False)  # of a sample, if there were one
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(f"r{i}", t) for i, t in enumerate(texts)] + [("null", None), (None, texts[0])]
    counts = neardup.frequencies(spark.createDataFrame(rows, "id string, text string"), "id", "text", 3)
    assert counts.sum() == sum(len(shingle_set(t, 3)) for t in texts) and counts.dtype == np.int32
