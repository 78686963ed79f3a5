"""Main text of web pages by consensus paths of hosts.

Each page scores its containers; the winner's path of generalised tag and class
names is the page's vote. Votes are summed per host in Spark, and each page is
then extracted again, with the path that has most votes of its host among those
that it has with text, else as a whole. Paths are compared by 64-bit hashes.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, materialize, strings, text_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROP = frozenset("nav header footer aside form script style noscript template iframe button select textarea menu dialog svg canvas object head title xmp noembed noframes option datalist".split())
BLOCK = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body div main section td center".split())
#: an open element of these ends when one of the right side starts
CLOSES = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
CLOSED_BY = {t: [k for k, v in CLOSES.items() if t in v] for t in set().union(*CLOSES.values())}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adbox|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|sidebar|side|aside|rail|widgets?|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|foot|header|masthead|topbar|toolbar|copyright|comments?|commentlist|replies|respond|disqus|hidden|skip|tags|toc)(?:$|[\s_-])",
    re.I,
)
#: noise outside articles only
WEAK_NOISE = re.compile(r"(?:^|[\s_-])(?:legal|discussion)(?:$|[\s_-])", re.I)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
TAIL = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "step", "path", "noise", "parent", "parts")

    def __init__(self, tag: str, step: str, noise: bool, parent: "Node | None" = None):
        self.tag, self.step, self.noise, self.parent = tag, step, noise, parent
        #: hash of the steps from the top
        self.path: int = xxhash.xxh3_64_intdigest(step.encode("utf-8", "replace"), parent.path if parent else 0)
        self.parts: list = []


def steps(node: Node) -> str:
    """The path in words."""
    out = []
    while node.parent:
        out.append(node.step)
        node = node.parent
    return ">".join(reversed(out))


def general(classes: str) -> str:
    """Class names of a path step: sorted, numbers gone."""
    return ".".join(sorted({c for c in (re.sub(r"\d+", "", x).strip("-_") for x in classes.lower().split()) if c}))


class TagEnds:
    """Where start tags end, looked up in time that doesn't depend on how quotes
    are broken: the ends of all stretches between quotes, from the last one on."""

    def __init__(self, html: str):
        self.at = [m.start() for m in re.finditer("[\"'>]", html)]
        self.end = [-1] * (len(self.at) + 1)
        follows = {'"': -1, "'": -1}
        for i in range(len(self.at) - 1, -1, -1):
            c = html[self.at[i]]
            if c == ">":
                self.end[i] = self.at[i] + 1
            else:
                if follows[c] >= 0:
                    self.end[i] = self.end[follows[c] + 1]
                follows[c] = i

    def after(self, start: int) -> int:
        """End of the tag whose attributes begin at ``start``, -1 without one."""
        return self.end[bisect_left(self.at, start)]


def parse(html: str) -> Node:
    """A tolerant tree: elements are nodes, texts are strings (not yet decoded).
    A tag whose quotes never close ends at the next ``>``; without any, the rest
    of the page is cut off, as browsers do."""
    root = Node("", "", False)
    stack, at, open_tags, ends = [root], 0, Counter(), None

    def close(i: int) -> None:
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    while m := TOKEN.search(html, at):
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if m[0].startswith("<![CDATA["):
            stack[-1].parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
        if not tag:
            continue
        if ends is None:
            tail = TAIL.match(html, at)
            stop = tail.end() if tail else -1
            if not tail:
                ends = TagEnds(html)
        else:
            stop = ends.after(at)
        if stop < 0:
            stop = html.find(">", at) + 1 or len(html) + 1
        about, at = html[at : stop - 1], min(stop, len(html))
        if stop > len(html):
            break
        if m[1]:
            if not open_tags[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                # a paragraph's end tag doesn't close what holds the paragraph
                if stack[i].tag in CONTAINER and tag not in CONTAINER and tag not in DROP:
                    break
            continue
        if any(open_tags[t] for t in CLOSED_BY.get(tag, ())):
            for i in range(len(stack) - 1, 0, -1):
                if tag in CLOSES.get(stack[i].tag, ()):
                    close(i)
                    break
                if stack[i].tag in BLOCK and stack[i].tag != "p":
                    break
        had = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(about)} if about.strip(" /") else {}
        names = had.get("class", "")
        called = f"{names} {had.get('id', '')}"
        noise = tag in DROP or "hidden" in had or had.get("aria-hidden") == "true" or had.get("role", "").lower() in NOISE_ROLES or bool(NOISE.search(called)) or bool(re.search(r"display\s*:\s*none", had.get("style", "")))
        noise = noise or not (open_tags["article"] or open_tags["main"]) and bool(WEAK_NOISE.search(called))
        step = tag + ("." + g if (g := general(names)) else "")
        node = Node(tag, step, noise and tag not in ("html", "body", "article", "main"), stack[-1])
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not about.endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    else:
        if at < len(html):
            stack[-1].parts.append(html[at:])
    return root


def walk(top: Node):
    """Nodes below ``top`` in page order, noise left out; a loop, as pages nest deep."""
    todo = [top]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.noise)


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below ``top`` in page order, decoded and trimmed."""
    out: list[list[str]] = [[]]
    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.noise or x is top:
            if x.tag in BLOCK:
                out.append([])
                todo.append(None)
            todo.extend(reversed(x.parts))
    texts = (SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in out)
    return [t for t in texts if t]


def score(node: Node) -> float:
    """Letters of running text that stand directly in a container or its blocks,
    less twice those of links; nested containers count for themselves."""
    total = 0.0
    todo: list = [(x, False, True) for x in node.parts]
    while todo:
        x, link, near = todo.pop()
        if isinstance(x, str):
            n = len(x.strip())
            total += (-n if link else n) if near else 0
        elif not x.noise:
            inner = x.tag in CONTAINER
            if not inner:
                todo.extend((y, link or x.tag == "a", near) for y in x.parts)
    return total + {"article": 200.0, "main": 100.0}.get(node.tag, 0.0) + (50.0 if re.search(r"content|article|entry|post|story|text", node.step) else 0.0)


def best_container(root: Node) -> tuple[Node | None, float]:
    """The container with most points; the article around it, if there is one, as
    a lead in a nested box doesn't hide it."""
    best, points = None, 0.0
    for node in walk(root):
        if node.tag in CONTAINER and (s := score(node)) > points:
            best, points = node, s
    node, around = best, None
    while node:
        around = node if node.tag in ("article", "main") else around
        node = node.parent
    return around or best, points


def vote(html: str) -> tuple[int | None, float]:
    """Path of the best container of a page, as a signed hash, and its points."""
    best, points = best_container(parse(html))
    return (signed(best.path) if best else None), points


def signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def containers(root: Node) -> dict[int, list[Node]]:
    """Containers by signed path, in page order."""
    at: dict[int, list[Node]] = {}
    for node in walk(root):
        if node.tag in CONTAINER:
            at.setdefault(signed(node.path), []).append(node)
    return at


def extract(html: str, paths: list[int]) -> tuple[str, str]:
    """Text of a page by the first of ``paths`` with text there, else by its own
    best container, else of the whole page; and the path used, in words."""
    root = parse(html)
    at = containers(root)

    def texts(path: int) -> str:
        return " ".join(t for n in at.get(path, ()) for t in blocks(n))

    for path in paths:
        if text := texts(path):
            return text, steps(at[path][0])
    best, _ = best_container(root)
    if best and (text := texts(signed(best.path))):
        return text, steps(best)
    return " ".join(blocks(root)), ""


def _votes(html: pd.Series) -> pd.DataFrame:
    got = [vote(h or "") for h in html]
    return pd.DataFrame({"path": pd.array([p for p, _ in got], "Int64"), "points": [x for _, x in got]})


def _candidates(html: pd.Series) -> pd.Series:
    """Paths of a page that have text."""
    return pd.Series([[p for p, nodes in containers(parse(h or "")).items() if any(blocks(n) for n in nodes)] for h in html])


def _extract(batches):
    names = ["page_id", "url", "text", "n_chars", "path"]
    for batch in batches:
        ids, urls, paths = batch.column(0), batch.column(1), batch.column(3).to_pylist()
        got = [extract(h, p or []) for h, p in zip(strings(batch.column(2)), paths)]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string())], names)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: a host's paths are sent to its pages when they are as many at most
FEW_PATHS = 64


def extract_main_text(pages: DataFrame, few_paths: int = FEW_PATHS) -> DataFrame:
    """page_id, url, text, n_chars, path for each row of ``pages``.

    Of the paths of its host that a page has with text, it takes the one with most
    votes (ties: most points, then the greatest hash). The voted paths of a host
    go to all its pages as a list if they are ``few_paths`` at most; pages of other
    hosts look theirs up in a join, with the same result. Null html gives empty
    text; null or odd urls share the host "". Repeated rows stay; other columns
    are ignored; an empty table gives an empty result.
    """
    text_batches(pages.sparkSession)
    voted = F.pandas_udf(_votes, "struct<path: long, points: double>")
    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").withColumn("host", host(F.col("url")))
    votes = cols.select("host", voted("html").alias("v")).groupBy("host", "v.path").agg(F.count("*").alias("votes"), F.sum("v.points").alias("points"))
    votes = materialize(votes.filter("path is not null"), "html-votes")
    many = votes.groupBy("host").agg(F.count("*").alias("paths"))
    few = votes.join(many.filter(F.col("paths") <= few_paths), "host").groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(F.struct("votes", "points", "path")))).alias("best"))
    few = materialize(few.select("host", F.col("best.path").alias("paths")), "html-paths")
    wide = materialize(many.filter(F.col("paths") > few_paths).select("host"), "html-wide")
    shape = "page_id long, url string, text string, n_chars long, path string"
    if wide.isEmpty():
        forget(votes, wide)
        return cols.join(few, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(_extract, shape)
    plain = cols.join(wide, "host", "left_anti").join(few, "host", "left").select("page_id", "url", "html", "paths")
    same = F.xxhash64("page_id", "url", "html")
    rest = cols.join(wide, "host", "left_semi").withColumn("sig", same)
    found = rest.dropDuplicates(["sig"]).select("sig", "host", F.explode(F.pandas_udf(_candidates, "array<long>")("html")).alias("path"))
    found = materialize(found, "html-candidates").join(votes, ["host", "path"])
    chosen = found.groupBy("sig").agg(F.max(F.struct("votes", "points", "path")).alias("b")).select("sig", F.array("b.path").alias("paths"))
    chosen = materialize(chosen, "html-chosen")
    rest = rest.join(chosen, "sig", "left").select("page_id", "url", "html", "paths")
    return plain.union(rest).mapInArrow(_extract, shape)


def op1_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
