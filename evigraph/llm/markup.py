"""Problem 7: markup residue in text documents, with a site style tree.

A chunk is read into a tree of nodes: presentation nodes (a kind of markup and the construct: html/tag, wiki/template,
...) nested as their spans are, over one line or several, and below them what they hold. The trees of all pages of a
host merge into one style tree, by the path of constructs and by content, with the number of pages that show each. A
content node's importance is by the entropy of its share of the host's pages: 0 for what all pages repeat, 1 from a
share of RARE down, whatever the number of pages. A branch with branches below it has the mean of its own importance
and theirs. Whole branches of low importance that stand on lines of their own are taken out of a page, unless they hold
headings, lists, tables, code or formulas; the others lose their markup and keep their text and structure.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import cut

#: A branch less important than this is removed, on hosts of at least LEAST_PAGES pages; content on this share of a host's pages is as important as any.
IMPORTANCE, LEAST_PAGES, RARE = 0.3, 8, 0.05
#: Constructs that are content by themselves: never removed, nor what holds them.
KEPT = {"heading", "underline", "fence", "table", "cells", "code", "command", "display", "inline", "block", "item"}

#: Constructs of each markup, as patterns on one line. Fixed values.
TAGS = "a|abbr|article|aside|b|big|blockquote|body|br|caption|center|cite|code|col|dd|del|div|dl|dt|em|figure|figcaption|font|footer|form|h[1-6]|head|header|hr|html|i|img|input|ins|label|li|link|main|mark|meta|nav|ol|option|p|pre|q|s|script|section|select|small|span|strike|strong|style|sub|sup|table|tbody|td|tfoot|th|thead|title|tr|tt|u|ul"
CONSTRUCTS: dict[str, dict[str, str]] = {
    "html": {
        "tag": rf"(?i:</?(?:{TAGS})(?:\s[^<>]*)?/?>)",
        "comment": r"<!--.*?-->",
        "entity": r"&(?:[a-zA-Z]{2,8}|#\d{1,6}|#[xX][0-9a-fA-F]{1,6});",
    },
    "markdown": {
        "heading": r"^\s{0,3}#{1,6}\s+\S",
        "underline": r"^\s{0,3}(?:={3,}|-{3,})\s*$",
        "fence": r"^\s*(?:```|~~~)",
        "quote": r"^\s{0,3}>\s+\S",
        "table": r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$",
        "strong": r"\*\*[^*\s](?:[^*]*[^*\s])?\*\*|(?<![\w_])__[^_\s](?:[^_]*[^_\s])?__(?![\w_])",
        "strike": r"~~[^~\s](?:[^~]*[^~\s])?~~",
        "code": r"`[^`\n]+`",
        "emphasis": r"(?<![\w*])\*[^*\s](?:[^*]*[^*\s])?\*(?![\w*])",
        "link": r"!?\[[^\[\]]*\]\([^()\s]*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)",
        "reference": r"^\s{0,3}\[[^\[\]]+\]:\s+\S+",
    },
    "wiki": {
        "heading": r"^\s*(={2,6})\s*[^=\s].*?\s*\1\s*$",
        "bold": r"'''?[^'\s](?:[^']*[^'\s])?'''?",
        "link": r"\[\[[^\[\]]+\]\]",
        "template": r"\{\{[^{}]+\}\}",
        "table": r"^\s*(?:\{\|.*|\|-+\s*|\|\}\s*)$",
        "cells": r"^\s*[|!].*(?:\|\||!!).*$",
    },
    "latex": {
        "command": r"(?<![A-Za-z0-9:\\/])\\[a-zA-Z]{2,}\*?(?=[\s{\[_^}~$.,;:)]|$)|[a-z0-9.,;]~?\\(?:ref|cite)\{|\\[a-zA-Z]+\{[^{}]*\}",
        "display": r"\\\[|\\\]|\\\(|\\\)",
        "inline": r"\$[^\s$](?:[^$\n]*[^\s$])?\$(?!\d)",
        "spacing": r"\\[,;!%&#]",
    },
}
COMPILED = {kind: [(name, re.compile(p)) for name, p in parts.items()] for kind, parts in CONSTRUCTS.items()}
#: Constructs that may go over several lines, read on whole texts; one on a single line is found by the others. Fixed values.
LONG: list[tuple[str, str, re.Pattern]] = [
    ("html", "comment", re.compile(r"<!--(?:(?!-->)[\s\S])*\n(?:(?!-->)[\s\S])*-->")),
    ("html", "tag", re.compile(rf"""(?i:<(?:{TAGS})(?=[^<>]*[\r\n])(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+)))+\s*/?>)""")),
    ("wiki", "template", re.compile(r"\{\{(?=[^{}]*\n)[^{}]+\}\}")),
    ("latex", "block", re.compile(r"\$\$(?=[^$]*\n)[^$]+\$\$")),
]
QUICK = re.compile(r"[<&*_~`#\[{\\$=>']|^\s*[-|]|\|\|", re.M)
LINE_ENDS = re.compile(r"\r\n|\n|\r")
ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")


def nodes(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, markup, construct) of each presentation node of a text, outer ones first."""
    found = []
    if not QUICK.search(text):
        return found
    if "\n" in text:
        for kind, name, pattern in LONG:
            found += [(m.start(), m.end(), kind, name) for m in pattern.finditer(text)]
    before, at = "", 0
    for end in [*LINE_ENDS.finditer(text), None]:
        line = text[at : end.start() if end else len(text)]
        if QUICK.search(line):
            for kind, parts in COMPILED.items():
                for name, pattern in parts:
                    if name == "underline" and (not before.strip() or len(before) > 90):
                        continue
                    found += [(at + m.start(), at + (len(line) if name in LINES else m.end()), kind, name) for m in pattern.finditer(line)]
        before, at = line, end.end() if end else at
    return sorted(found, key=lambda n: (n[0], -n[1]))


#: Constructs that are whole lines.
LINES = {"heading", "underline", "fence", "quote", "table", "reference", "cells"}


def branches(text: str) -> list[tuple[int, int, str, list[str], bool]]:
    """(start, end, path of constructs, contents of the branches above, removable) of each node; pairs of tags are one branch.

    Removable is what takes whole lines and holds nothing that is kept.
    """
    out: list[tuple[int, int, str, list[str], bool]] = []
    above: list[tuple[int, int, str]] = []
    own = paired(text, nodes(text))
    for start, end, kind, name in own:
        while above and above[-1][1] < end:
            above.pop()
        path = "/".join([p for *_, p in above] + [f"{kind}:{name}"])
        first, last = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        alone = not text[first:start].strip() and not text[end : last if last >= 0 else len(text)].strip()
        holds = any(n in KEPT and s < end and e > start for s, e, _, n in own) or ITEM.match(text[first:end]) is not None
        out.append((start, end, path, [content_of(text[s:e]) for s, e, _ in above], alone and not holds))
        above.append((start, end, f"{kind}:{name}"))
    return out


def paired(text: str, own: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The nodes with each opening tag grown to its closing tag, which is no node of its own."""
    out, opened = [], []
    for start, end, kind, name in own:
        tag = re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)", text[start:end]) if kind == "html" and name == "tag" else None
        if tag and tag[1]:
            at = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == tag[2].lower()), None)
            if at is not None:
                k = opened[at][1]
                out[k] = (out[k][0], end, *out[k][2:])
                del opened[at:]
                continue
        if tag and not tag[1]:
            opened.append((tag[2].lower(), len(out)))
        out.append((start, end, kind, name))
    return sorted(out, key=lambda n: (n[0], -n[1]))


def content_of(text: str) -> str:
    return " ".join(text.lower().split())


def markup_left(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, markup) of each kind of markup that the trees of each row hold; rows repeat as they come.

    Null and blank texts have none. `df` should hold no rows of code, where signs are no markup.
    """

    def work(batches):
        for batch in batches:
            at, kinds = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    own = sorted({kind for *_, kind, _ in nodes(t)})
                    at += [i] * len(own)
                    kinds += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string())], [key, "markup"])

    return df.select(key, text).mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, markup string")


def page_trees(df: DataFrame, key: str, text: str, site: str, page: str) -> DataFrame:
    """(key, site, page, start, end, path, content, above, removable): the branches of each row of a site."""

    def work(batches):
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(3).to_pylist()):
                if t:
                    for start, end, path, above, removable in branches(t):
                        at.append(i)
                        rows.append((start, end, path, signed(content_of(t[start:end])), [signed(x) for x in above], removable))
            head = batch.take(pa.array(at, pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([*head.columns[:3], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [key, "site", "page", "start", "end", "path", "content", "above", "removable"])

    kind = {c: df.schema[c].dataType.simpleString() for c in (key, site, page)}
    schema = f"{key} {kind[key]}, site {kind[site]}, page {kind[page]}, start int, end int, path string, content bigint, above array<bigint>, removable boolean"
    return df.where(F.col(site).isNotNull()).select(key, site, page, text).mapInArrow(work, schema)


def signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def style_tree(trees: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, path, content, pages, all_pages, importance) of the merged trees of each site.

    `pages` has (site, page). Counts are combined before they are shuffled and pages of a site never meet in one task.
    """
    own = trees.select("site", "page", "path", "content").distinct().groupBy("site", "path", "content").agg(F.count(F.lit(1)).alias("pages"))
    sites = pages.where(F.col("site").isNotNull()).distinct().groupBy("site").agg(F.count(F.lit(1)).alias("all_pages"))
    alone = own.join(sites, "site").withColumn("own", importance(F.col("pages") / F.col("all_pages")))
    below = trees.select("site", "path", "content", F.explode("above").alias("over")).distinct().join(alone.select("site", "path", "content", "own"), ["site", "path", "content"])
    below = below.groupBy("site", F.col("over").alias("content")).agg(F.avg("own").alias("below"))
    return alone.join(below, ["site", "content"], "left").select("site", "path", "content", "pages", "all_pages", F.coalesce((F.col("own") + F.col("below")) / 2, "own").alias("importance"))


def importance(share: Column) -> Column:
    """By the entropy of a share of pages: 0 where all have it, 1 from RARE down."""
    return F.least(F.lit(1.0), F.log(share) / F.log(F.lit(RARE)))


def to_text(text: str | None, drop: list[tuple[int, int]] | tuple = ()) -> tuple[str | None, list[tuple[int, str]]]:
    """(clean text, [(line number, structure)]): structure is heading, list, code, quote, table or formula.

    Headings stay a line, list items start with "- ", cells are parted by " | ", code lines and the source of formulas
    stay as they are. The spans in `drop`, which take whole lines, are left out.
    """
    if text is None:
        return None, []
    if drop:
        lines, at = [], 0
        for line in text.split("\n"):
            if not any(start < at + len(line) + 1 and end > at for start, end in drop):
                lines.append(line)
            at += len(line) + 1
        text = "\n".join(lines)
    if "```" not in text and "~~~" not in text:  # in code they are no markup
        for _, name, pattern in LONG:
            text = pattern.sub(lambda m: "$$ " + " ".join(m[0].strip("$").split()) + " $$" if name == "block" else "", text)
    out: list[str] = []
    marks: list[tuple[int, str]] = []
    fence, display = False, False

    def put(line: str, structure: str = "") -> None:
        if structure:
            marks.append((len(out), structure))
        out.append(line)

    for line in LINE_ENDS.split(text):
        if re.match(r"\s*(?:```|~~~)", line):
            fence = not fence
            continue
        if fence:
            put(line, "code")
            continue
        code = re.match(r"\s*<pre[^>]*>(?:<code[^>]*>)?(.*?)(?:</code>)?</pre>\s*$", line, re.I)
        if code:
            put(html.unescape(code[1]), "code")
        elif re.match(r"\s*\\begin\{(equation|align|math|displaymath)\*?\}", line):
            display = True
        elif re.match(r"\s*\\end\{(equation|align|math|displaymath)\*?\}", line):
            display = False
        elif display:
            put(line.strip(), "formula")
        elif m := re.match(r"\s*\\\[\s*(.*?)\s*\\\]\s*$|\s*\$\$\s*(.*?)\s*\$\$\s*$", line):
            put(m[1] or m[2] or "", "formula")
        elif re.match(r"\s*\\(begin|end)\{[^{}]*\}\s*$|\s*(\{\|.*|\|-+|\|\})\s*$|\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$|\s{0,3}\[[^\[\]]+\]:\s+\S+", line) or re.fullmatch(rf"\s*(?i:</?(?:ul|ol|div|table|tbody|tr)(?:\s[^<>]*)?>)\s*", line):
            continue
        elif re.fullmatch(r"\s{0,3}(={3,}|-{3,})\s*", line) and out and out[-1].strip():
            marks.append((len(out) - 1, "heading"))
        elif m := re.match(r"\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$|\s*={2,6}\s*([^=\s].*?)\s*={2,6}\s*$|\s*\\(?:sub)*section\*?\{([^{}]*)\}\s*$|\s*(?i:<h[1-6][^>]*>)(.*?)(?i:</h[1-6]>)\s*$", line):
            put(inline(next(g for g in m.groups() if g is not None)), "heading")
        elif m := re.match(r"\s*(?:\\item\s+|(?i:<li[^>]*>))(.*?)(?i:</li>)?\s*$", line):
            put("- " + inline(m[1]), "list")
        elif ITEM.match(line):
            put("- " + inline(ITEM.sub("", line)), "list")
        elif m := re.match(r"\s{0,3}>\s+(.*)$", line):
            put(inline(m[1]), "quote")
        elif m := re.match(r"\s*[|!](.*(?:\|\||!!).*)$", line):
            put(" | ".join(inline(c) for c in re.split(r"\|\||!!", m[1])), "table")
        elif re.search(r"(?i)<t[dh]\b", line):
            rows = re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", line) or [line]
            for row in rows:
                put(" | ".join(inline(c) for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", row)), "table")
        else:
            if re.search(r"\$[^\s$][^$\n]*\$(?!\d)|\\\(", line):
                marks.append((len(out), "formula"))
            put(inline(line))
    return "\n".join(out), marks


INLINE = [
    (re.compile(r"<!--.*?-->"), ""),
    (re.compile(rf"(?i)</?(?:{TAGS})(?:\s[^<>]*)?/?>"), ""),
    (re.compile(r"\{\{[^{}]*\}\}|!\[[^\[\]]*\]\([^()\s]*\)|\[\[(?:File|Image|Category):[^\[\]]*\]\]|~?\\(?:cite|ref|label)\{[^{}]*\}"), ""),
    (re.compile(r"\[([^\[\]]*)\]\([^()\s]*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\*{2,3}([^*\s](?:[^*]*[^*\s])?)\*{2,3}"), r"\1"),
    (re.compile(r"(?<![\w*])\*([^*\s](?:[^*]*[^*\s])?)\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_])__([^_\s](?:[^_]*[^_\s])?)__(?![\w_])"), r"\1"),
    (re.compile(r"~~([^~]+)~~|`([^`\n]+)`"), lambda m: m[1] or m[2]),
    (re.compile(r"'''?([^'\s](?:[^']*[^'\s])?)'''?"), r"\1"),
    (re.compile(r"\\(?:textbf|emph|textit|texttt|underline|text)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\\(\s*(.*?)\s*\\\)|\$([^\s$](?:[^$\n]*[^\s$])?)\$(?!\d)"), lambda m: m[1] or m[2] or ""),
    (re.compile(r"\\,?\\?%"), "%"),
    (re.compile(r"[ \t]{2,}"), " "),
]


def inline(line: str) -> str:
    """A line without inline markup."""
    for pattern, to in INLINE:
        line = pattern.sub(to, line)
    return html.unescape(line).strip()


def clean(df: DataFrame, key: str, text: str, site: str, page: str) -> DataFrame:
    """(key, text, structure): clean text of each row, less the branches that its site repeats.

    `df` has one row per key. Rows without a site lose no branches. Null texts stay null, blank ones blank; structure is
    an array of (line, type), empty where there is none. Extra columns are dropped. What is removed is joined to the
    rows that hold it, so neither a site's tree nor its pages are gathered.
    """
    trees = cut(page_trees(df, key, text, site, page))
    tree = style_tree(trees, df.select(F.col(site).alias("site"), F.col(page).alias("page")))
    low = tree.where((F.col("importance") < IMPORTANCE) & (F.col("all_pages") >= LEAST_PAGES)).select("site", "path", "content")
    low = trees.where("removable").join(low, ["site", "path", "content"], "left_semi").groupBy(key).agg(F.collect_set(F.struct("start", "end")).alias("_drop"))  # at most the nodes of one chunk

    def work(batches):
        for batch in batches:
            texts, marks = [], []
            for t, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                c, m = to_text(t, [(d["start"], d["end"]) for d in drop or []])
                texts.append(c)
                marks.append([{"line": n, "type": s} for n, s in m])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(marks, pa.list_(pa.struct([("line", pa.int32()), ("type", pa.string())])))], [key, text, "structure"])

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {text} string, structure array<struct<line:int,type:string>>"
    return df.select(key, text).join(low, key, "left").select(key, text, "_drop").mapInArrow(work, schema)
