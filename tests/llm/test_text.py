"""Tokenizer, packing, splitting, boilerplate, markup and subjects, mostly without Spark."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import boilerplate, bpe, markup, packing, splitting, subjects

ODD = "ab 's 're'll \n\t  é½ 中1 2٣!?'\"  \u200b\x1c\x1f\x85\xa0 <|endoftext|> ’s S'S ʼ Ⅷ ² ﷺ 😀 á"


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def encoded(texts):
    enc, out = bpe.encoder(bpe.default_vocabulary()), []
    for part in bpe.slices(texts):
        ids, n = enc.encode(part)
        ends = np.append(0, np.cumsum(n))
        out += [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(part))]
    return out


def test_ids_equal_the_public_library(reference):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["it's 'twas ''s '' ' s", " 's", "<|endoftext|>", "", "x" * 3000, "antidisestablishmentarianism" * 20, " " * 50 + "a"]
    assert encoded(texts) == reference(texts)


def test_every_letter_class(reference):
    points = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["a" + c + "b1" + c + " " + c for c in points]
    assert encoded(texts) == reference(texts)


def test_perfect_hash_is_minimal_and_exact():
    enc = bpe.encoder(bpe.default_vocabulary())
    t = enc.table
    assert t.size == sum(len(k) <= 16 for k in enc.ranks) and (t.find(t.low, t.high, t.length) == t.value).all()
    assert (t.find(t.low, t.high, t.length + np.uint8(100)) == -1).all()


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "hi there", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0), list(r["ids"])) for r in bpe.encode_corpus(df, "doc_id", "text").collect())
    assert [k for k, _ in got] == [0, 1, 2, 3, 3] and [len(v) for _, v in got] == [1, 2, 0, 0, 0]
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def check_plan(histogram):
    runs, n = packing.plan_runs(histogram)
    seen, fill = {}, np.zeros(n, int)
    for size, lo, hi, base in runs:
        seen.setdefault(size, []).append((lo, hi))
        fill[base : base + hi - lo] += size
    for size, parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == histogram[size] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert set(seen) == {s for s, c in histogram.items() if c} and (not n or fill.max() <= packing.CAPACITY)
    return n, fill


def test_plans_place_everything_and_waste_little():
    rng = random.Random(2)
    for mean in (100, 400, 900, 1500):
        h = {}
        for _ in range(3000):
            s = min(2048, max(1, int(rng.expovariate(1 / mean))))
            h[s] = h.get(s, 0) + 1
        n, fill = check_plan(h)
        large = sum(c for s, c in h.items() if s > 1024)
        assert n <= 1.03 * max(sum(s * c for s, c in h.items()) / 2048, large) + 12
    assert packing.plan_runs({}) == ([], 0)
    check_plan({2048: 5})
    check_plan({1: 5000})
    check_plan({1025: 300, 1023: 300})


def test_pack(spark):
    rows = [(i, s) for i, s in enumerate([5000, 2048, 2047, 1, 0, 700, 700, 700])] + [(99, None), (98, -3), (7, 700), (None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("container", F.lit("clash"))
    out = packing.pack(df, "doc_id", "n").collect()
    used = {}
    for r in out:
        used[r["container"]] = used.get(r["container"], 0) + r["size"]
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(s for _, s in rows if s and s > 0)
    assert sorted(r["part"] for r in out if r["doc_id"] == 0) == [0, 1, 2] and not any(r["doc_id"] in (4, 98, 99) for r in out)
    assert packing.pack(df.limit(0), "doc_id", "n").count() == 0


def pieces(text, limit, overlap=0):
    return [text[a:b] for a, _, b in splitting.split(text, limit, overlap)]


def test_pieces_are_within_the_limit_and_cover_the_text():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice(["word ", "Next. ", "line\n", "\n\n", "x" * rng.randint(1, 40)]) for _ in range(rng.randint(1, 300)))
        limit, overlap = rng.randint(5, 300), rng.randint(0, 2)
        parts = splitting.split(t, limit, overlap)
        assert all(e - s <= limit and s <= o < e for s, o, e in parts) or len(t) <= limit
        assert "".join(t[o:e] for _, o, e in parts) == t


def test_cuts_are_natural_and_local():
    text = " ".join(f"Sentence number {i} says something of its own." for i in range(200))
    whole = pieces(text, 500)
    assert all(p.rstrip().endswith(".") for p in whole)
    edited = text[:3000] + "An inserted remark. " + text[3000:]
    assert len(set(whole) & set(pieces(edited, 500))) >= len(whole) - 4


def test_overlap_is_whole_sentences():
    text = " ".join(f"This is sentence {i} here." for i in range(60))
    parts = splitting.split(text, 200, 1)
    for (_, _, before), (s, o, _) in zip(parts, parts[1:]):
        assert text[s:o].count(".") == 1 and text[s:].startswith("This is") and before == o


def test_cuts_without_boundaries_are_local():
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefgh", k=20_000))
    whole = pieces(text, 1000)
    assert all(len(p) <= 1000 for p in whole) and len(set(whole) & set(pieces(text[:9000] + "x" + text[9000:], 1000))) >= len(whole) - 3
    chinese = "".join("".join(rng.choices("天地人水火山石田土木", k=rng.randint(8, 20))) + "。" for _ in range(800))
    assert all(p.endswith("。") for p in pieces(chinese, 500))


def test_overlaps_of_long_sentences_are_kept():
    text = " ".join(f"Sentence {i} " + "goes on and on " * 20 + "to its end." for i in range(12))
    parts = splitting.split(text, 800, 1)
    assert all(o - s > 250 for s, o, _ in parts[1:] if text[o - 2] == ".") and sum(o > s for s, o, _ in parts) >= len(parts) - 3


def test_pieces_are_numbered_within_their_document(spark, monkeypatch):
    monkeypatch.setattr(splitting, "BLOCK", 4)
    rows = [(f"c{i:02}", "d" if i < 16 else None, i % 16 if i != 5 else 4, 0, n) for i, n in enumerate([1, 3, 1, 1, 2, 1, 1, 4, 1, 1, 1, 2, 1, 1, 1, 1, 2, 1])]
    df = spark.createDataFrame([(k, d, o + p, p, n) for k, d, o, _, n in rows for p in range(n)], "id string, doc string, ord int, piece int, n_pieces int")
    out = splitting.renumbered(df, "id", "doc", "ord").orderBy("doc", "ord").collect()
    own = [(r["id"], r["piece"], r["ord"]) for r in out if r["doc"] == "d"]
    assert [o for *_, o in own] == sorted({o for *_, o in own}) and own == sorted(own)
    assert own[0] == ("c00", 0, 0) and own[1:4] == [("c01", p, 1 + p) for p in range(3)] and own[4] == ("c02", 0, 4)
    assert [(r["id"], r["ord"]) for r in out if r["doc"] is None] == [("c16", 0), ("c16", 1), ("c17", 2)]


def test_split_oversized(spark):
    rows = [("a", "x" * 25, 10, 0, 3), ("b", "short", 10, 0, 1), ("c", None, 10, 0, 1), ("d", "  \n", 10, None, None), ("e", "y" * 30, None, 1, 0), ("b", "short", 10, 0, 1), ("f", " " * 20 + "ok", 10, 0, 0)]
    df = spark.createDataFrame(rows, "id string, text string, lim int, ov int, ord int").withColumn("piece", F.lit("clash"))
    out = splitting.split_oversized(df, "id", "text", "lim", "ov", "ord").orderBy("id", "piece").collect()
    a = [r for r in out if r["id"] == "a"]
    assert [r["piece"] for r in a] == list(range(a[0]["n_pieces"])) and len(a) in (3, 4, 5) and sum(len(r["text"]) for r in a) == 25
    assert [(r["id"], r["piece"], r["n_pieces"]) for r in out if r["id"] != "a"] == [("b", 0, 1), ("b", 0, 1), ("c", 0, 1), ("d", 0, 1), ("e", 0, 1), ("f", 0, 1)]
    assert [r["ord"] for r in a] == list(range(3, 3 + len(a))) and splitting.split_oversized(df.limit(0), "id", "text", "lim", "ov", "ord").count() == 0


def made_page(rng, host, menu):
    """(text, numbers of its furniture lines): a heading, sentences, and around them what the test calls furniture."""
    noun = lambda: rng.choice("cell burrow tunnel larder seed whisker nest forest moss pebble otter badger".split())
    say = lambda: f"{rng.choice(['The', 'A', 'Each'])} {rng.choice('slow deep pale warm'.split())} {noun()} {rng.choice('feeds guards follows crosses'.split())} the {noun()}, then the {rng.choice('slow deep pale warm'.split())} {noun()} rests near {noun()} {rng.randint(1, 99)}."
    lines = [(" ~ ".join(menu), True), (rng.choice(["Aims", "Habitat", "Diary"]), False), *((say(), False) for _ in range(rng.randint(3, 5)))]
    if rng.random() < 0.6:
        lines += [("More burrows to dig into", True), *((f"{''.join(rng.choices('abdegilmnorstu', k=6))} {noun()}", True) for _ in range(2))]
    if rng.random() < 0.7:
        lines += [(f"Brought to you by {host}.example for {rng.randint(1, 9)} coins", True)]
    return "\n".join(t for t, _ in lines), [i for i, (_, f) in enumerate(lines) if f]


def made_pages(rng, n, host, menu):
    rows, truth = [], set()
    for i in range(n):
        text, found = made_page(rng, host, menu)
        rows.append((f"{host}{i}", f"page-{host}{i}", text, ["Aims", "Habitat", "Diary"], ["Otter"]))
        truth |= {(f"{host}{i}", k) for k in found}
    return rows, truth


PAGES = "id string, page string, text string, heads array<string>, names array<string>"


def test_find_boilerplate(spark):
    rng = random.Random(3)
    rows, truth = made_pages(rng, 120, "fen", ["Lodge", "Ledger", "Lookout"])
    more, true_too = made_pages(rng, 30, "dale", ["Kiosk", "Parlour"])
    odd = [("n", "page-fen0", None, None, None), ("e", "page-fen1", "", None, [None]), ("b", "page-fen2", "\n \n", [None], None), ("long", "page-fen3", "The pale badger guards the nest, then rests near moss 7. " * 2000, None, None)]
    df = spark.createDataFrame(rows + more + odd, PAGES).withColumn("line_no", F.lit("clash"))
    found = boilerplate.find_boilerplate(df, "id", "page", "text", "heads", "names")
    got, true = {(r["id"], r["line_no"]) for r in found.collect()}, truth | true_too
    assert len(got & true) >= 0.97 * max(len(got), len(true))
    kept = {r["id"]: r["text"] for r in boilerplate.keep_content(df.select("id", "text"), found, "id", "text").collect()}
    assert kept["n"] is None and kept["e"] == "" and kept["long"].count("moss") == 2000 and "Lodge" not in kept["fen0"]
    assert boilerplate.find_boilerplate(df.limit(0), "id", "page", "text", "heads", "names").count() == 0


def test_a_host_is_cleaned_alike_among_ten_times_the_pages(spark):
    rows, _ = made_pages(random.Random(5), 40, "fen", ["Lodge", "Ledger", "Lookout"])
    others = [r for k in range(9) for r in made_pages(random.Random(50 + k), 40, "abcdefghi"[k], ["Kiosk", "Parlour", "Cellar"])[0]]
    alone, among = (
        {(r["id"], r["line_no"]) for r in boilerplate.find_boilerplate(spark.createDataFrame(x, PAGES), "id", "page", "text", "heads", "names").where(F.col("id").startswith("fen")).collect()} for x in (rows, rows + others)
    )
    assert len(alone & among) >= 0.97 * len(alone | among) and len(alone) > 60


def test_the_score_of_the_tree_decides(spark):
    rows, truth = made_pages(random.Random(3), 60, "fen", ["Lodge", "Ledger", "Lookout"])
    marked = boilerplate.marked(boilerplate.read_lines(spark.createDataFrame(rows, PAGES), "id", "page", "text", "heads", "names"), "id")
    counts, sums = boilerplate.learn(marked, None, None)
    batch = marked.toArrow().combine_chunks().to_batches()[0]
    lines = boilerplate.Lines(batch)
    density = lines.densities(boilerplate.evidence_of(counts[:, : boilerplate.SLOTS], sums))
    container, share, points = lines.scores(density)
    ids = np.repeat(batch.column(0).to_pylist(), np.diff(lines.ends))
    by_tree, by_line = ({(i, int(n)) for i, n, y in zip(ids, lines.no, links) if y} for links in ((share >= boilerplate.LINKS)[container], density >= boilerplate.LINKS))
    assert ((density > 0.02) & (density < 0.98)).sum() > 20  # graded
    assert by_tree - by_line and len(by_tree ^ truth) < len(by_line ^ truth)
    best = points.max()
    assert (points[share < boilerplate.LINKS] > 0).all() and (points[share >= boilerplate.LINKS] < boilerplate.SIBLING * best).mean() > 0.9


def kinds(text):
    return {k for *_, k, _ in markup.nodes(text)}


@pytest.mark.parametrize("text", ["p < 0.05 and q > 3", "a <75 b", "see [S1] and [10]", r"C:\runs\day17", "unit_17_left", "if a == 87", "$ 12 or $ 645", "$12 to $64", "R&D", "C# or F#", "#hub-1", "- item\n* item\n1. item", "a | b | 3", "{k: 62}", "a -> b", "2 * 29 * 3", "~16 ms", "Menu | Home", "p <b\nand c> d", "* one\n* two", "$5\nand $6"])
def test_what_is_no_markup(text):
    assert kinds(text) == set()


@pytest.mark.parametrize(
    ("text", "kind"),
    [("<b>x</b>", "html"), ("a<BR>b", "html"), ("R&nbsp;x", "html"), ("<!-- x -->", "html"), ("## Head", "markdown"), ("Head\n=====", "markdown"), ("```sh\nx\n```", "markdown"), ("a **b** c", "markdown"), ("[a](#b)", "markdown"), ("| --- | :---: |", "markdown"), ("> quoted", "markdown"), ("== Head ==", "wiki"), ("'''b'''", "wiki"), ("[[a|b]]", "wiki"), ("{{cite|x}}", "wiki"), ('{| class="wikitable"', "wiki"), (r"\emph{x}", "latex"), (r"run~\cite{a1}", "latex"), (r"\[ f(x) = 2 \]", "latex"), ("$x^2 + y_{1}$", "latex"), (r"27\,\% more", "latex"), ("<!-- a\nb -->", "html"), ('<a href="x"\n class="y">', "html"), ("{{box\n|a=1\n|b=2\n}}", "wiki"), ("$$\na + b\n$$", "latex"), ('[a](b "c")', "markdown"), ("an *odd* one", "markdown")],
)
def test_markup(text, kind):
    assert kinds(text) == {kind}


def test_clean_text_keeps_structure():
    text, marks = markup.to_text("== Scope ==\n* one\n<ul>\n<li>two</li>\n</ul>\n```\nx = 1\n```\n\\[ f(x) = 2 \\]\nThe '''bold''' [[a|link]] &amp; $x$.", set())
    assert text == "Scope\n- one\n- two\nx = 1\nf(x) = 2\nThe bold link & x."
    assert {t for _, t in marks} == {"heading", "list", "code", "formula"}
    assert markup.to_text(None, set()) == (None, [])


def test_branches_nest_and_pair():
    own = [(path, text[start:end], bool(above)) for text in ["<div>a <b>x</b>\n</div>"] for start, end, path, above, _ in markup.branches(text)]
    assert own == [("html:tag", "<div>a <b>x</b>\n</div>", False), ("html:tag/html:tag", "<b>x</b>", True)]


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(f"c{i}", f"Own text {i}.\n{{{{Navbox\n|a=[[Start]]\n}}}}\n[[Category:Windows]]\n**own{chr(97 + i)}**", "h", f"p{i}") for i in range(10)] + [("n", None, "h", "q"), ("e", "", None, "q")]
    df = spark.createDataFrame(rows, "id string, text string, host string, page string").withColumn("markup", F.lit("clash"))
    out = {r["id"]: r["text"] for r in markup.clean(df, "id", "text", "host", "page").collect()}
    assert out["c3"] == "Own text 3.\nownd" and out["n"] is None and out["e"] == ""
    assert markup.clean(df.limit(0), "id", "text", "host", "page").count() == 0


def test_headings_and_tables_of_all_pages_stay(spark):
    rows = [(f"c{i}", f"== Results ==\n{{|\n| 7 || {i} ||\n|}}\n* see [[Start]]\n$x_1$\nRun.", "h", f"p{i}") for i in range(12)]
    many = [(f"m{i}", "[[Category:Rare]]\nText." if i < 15 else "Text.", "big", f"q{i}") for i in range(300)]  # a twentieth of the host's pages
    df = spark.createDataFrame(rows + many, "id string, text string, host string, page string")
    out = {r["id"]: (r["text"], {m["type"] for m in r["structure"]}) for r in markup.clean(df, "id", "text", "host", "page").collect()}
    assert all(out[f"c{i}"][0].startswith("Results\n7 | " + str(i)) and out[f"c{i}"][0].endswith("- see Start\nx_1\nRun.") for i in range(12))
    assert out["c3"][1] == {"heading", "table", "list", "formula"} and out["m3"][0] == out["m4"][0]


def test_sentences_leave_out_headings_questions_and_stamps():
    t = "# Head\n\nQ: What is it?\nA: The cell fires now. Is it so?\n2024-01-01 15:32 entry 3576: The retina adapts fast.\n- A motion detector turns."
    assert [" ".join(s) for s in subjects.sentences(t)] == ["the cell fires now", "the retina adapts fast", "motion detector turns"]


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(7)
    words = {"vision": "retina ommatidium luminance contrast photoreceptor".split(), "olfaction": "odour antenna pheromone glomerulus sniff".split(), "imaging": "voxel microscope slice fluorophore resin".split()}
    frames = ["The slow {} follows the {} near the table.", "We saw that each {} widens the {} in run {}.", "In the morning the {} splits the {} on that day."]

    def doc(subjs, n=12):
        return " ".join(rng.choice(frames).format(*rng.sample(words[rng.choice(subjs)], 2), rng.randint(1, 99)) for _ in range(n))

    rows, labels = [], []
    for i in range(240):
        s = [rng.choice(list(words))]
        rows.append((i, doc(s)))
        if i < 160:
            labels.append((i, s[0] if rng.random() > 0.05 else "vision"))
        else:
            labels.append((i + 10_000, s[0]))
    truth = {i - 10_000: s for i, s in labels if i >= 10_000}
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "The record was closed today. Nothing else was said here.")], "doc_id long, text string").withColumn("subject", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(3, None), (None, "vision")], "doc_id long, subject string")
    subj = spark.createDataFrame([(s,) for s in words], "subject string")
    got = {}
    for r in subjects.subject_areas(docs, lab, subj).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i) == {s} for i, s in truth.items())
    # topics at random, mapped the same way, must not do: the topics decide, not the labels of the words
    texts, own = dict(rows), sorted((i, s) for i, s in labels if i < 10_000)
    bags = [Counter(w for x in subjects.sentences(texts[i]) for w in x) for i, _ in own]
    names = sorted(words)
    terms, votes = subjects.telling(bags, [[names.index(s)] for _, s in own], "en", 3)
    chance = subjects.Model(names)
    chance.topics["en"] = subjects.mapped(terms, np.random.default_rng(5).gamma(1, size=(len(terms), 9)), votes)
    found = chance.shares([texts[i] for i in truth])
    assert sum({names[k] for k, v in f.items() if v >= 0.25} == {s} for f, s in zip(found, truth.values())) < 0.6 * right
    assert right >= 0.9 * len(truth) and not {900, 901, 902} & set(got)
    assert subjects.subject_areas(docs, lab.limit(0), subj).count() == 0
