"""Main text of web pages by template deduction from equivalence classes of tokens.

Tokens of a page are its containers (by path) and its text blocks (by path and text). Over the different pages of a host, tokens with
the same occurrence vector form an equivalence class; vectors are compared by one hash, which combines before the
shuffle. A host may have several classes: one for each layout, and others for parts that come in some pages or several times.
Classes nest by their containers' paths. From the outermost class inwards, the container that holds most of the varying text is the
slot of the article; blocks of the slot's classes that most of its pages share are fixed text, unless they are most of the text. A page takes the innermost slot of its host's template that it has.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.common import materialize

LEAST_PAGES = 2  # different pages from which a host has a template
LEAST_SHARE = 0.1  # of a host's pages that a token of its template occurs in
FIXED_PAGES = 3  # different pages from which a block counts as fixed when slots are sought
FIXED_SHARE = 0.5  # of the pages with a slot that hold a fixed block of it; and of the slot's text that such blocks may be
DEEPEST = 200  # containers below so many are one with the one above them
MAIN_SHARE = 0.5  # of the varying text around it that the article's slot holds
OWN_SHARE = 0.05  # of a container's varying text that stands in it directly, from which it is the slot itself
FEW_HOSTS = 500_000  # counts by host are broadcast up to so many
BROADCAST_BYTES = 8 << 20
SALTS = 64

# The roles of elements, by the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "output", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source", "math", "mi", "mn", "mo", "mrow", "msub", "msup", "mfrac", "msqrt", "mtext", "semantics"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "pre", "blockquote", "figcaption", "caption", "hr", "br", "option"}
OUTSIDE = {"head", "nav", "footer", "aside", "form", "button", "select", "input", "datalist", "dialog", "menu", "template", "object", "embed", "applet", "audio", "video", "canvas", "svg", "fieldset", "legend", "progress", "meter"} | RAW
MAIN = {"article", "main"}
# Words for containers that aren't the article, as class, id or role, alone or with a word for a part of a page's layout.
MARKS = {"ad", "ads", "adbox", "adslot", "adunit", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "widget", "widgets", "masthead", "topbar", "footer", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "recommended", "comment", "comments", "commentlist", "respond", "disqus", "pager", "pagination", "toolbar", "copyright", "complementary", "contentinfo", "skip"}

PARTS = {"area", "bar", "banner", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "footer", "form", "group", "header", "inner", "item", "items", "left", "link", "links", "list", "main", "menu", "mobile", "modal", "nav", "notice", "outer", "panel", "popup", "primary", "right", "row", "secondary", "section", "slot", "thread", "top", "unit", "widget", "widgets", "wrap", "wrapper"}
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPECIAL, _BRACKET = re.compile("[>\"']"), re.compile("[<>]")
_CLOSES_P = LEAVES - {"br", "option"} | {"div", "article", "section", "main", "ul", "ol", "dl", "table", "nav", "aside", "footer", "header", "form", "figure", "address", "details"}


def _role(tag: str, attrs: str, inside_main: bool) -> tuple[bool, str]:
    """Whether an element is outside the article, and its name in paths."""
    found = {k.lower(): (a or b or c) for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip(" /") else {}
    name = tag + ("." + ".".join(sorted(found["class"].split())[:2]) if found.get("class") and tag != "section" else "")
    if tag in OUTSIDE or tag == "header" and not inside_main:
        return True, name
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, name
    if found and tag not in LEAVES and tag not in ("html", "body") and tag not in MAIN:
        words = entities.unescape(" ".join(found.get(k, "") for k in ("class", "id", "role"))).lower().split()
        return any(_is_mark(w) for w in words), name
    return False, name


def _is_mark(name: str) -> bool:
    """Whether a class, id or role is a mark, with nothing besides but words for parts and numbers: sidebar-2 and cookie-notice, not social-history."""
    words = _WORDS.findall(name)
    return bool(words) and words[0] in MARKS and all(w in PARTS or w in MARKS for w in words[1:])


class _Scanner:
    """Finds the tags of a page in time linear in its length, however broken it is: what one search has learnt serves the later ones."""

    def __init__(self, page: str):
        self.page = page
        self.special = -1  # the next of > " ' at or after where it was last looked for
        self.looked = 0
        self.ends: dict[int, int] = {}  # where a tag ends that is open, outside quotes, at a place; -1 for nowhere
        self.missing: dict[str, int] = {}  # from where on a string doesn't occur

    def find(self, what: str, at: int) -> int:
        if at >= self.missing.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def _special(self, at: int) -> int:
        if not self.looked <= at <= self.special:
            m = _SPECIAL.search(self.page, at)
            self.special, self.looked = m.start() if m else len(self.page), at
        return self.special

    def end(self, at: int) -> int:
        """The > that ends a tag which is open at a place, quoted ones apart; -1 if none does."""
        passed = []
        while at not in self.ends:
            passed.append(at)
            special = self._special(at)
            if special == len(self.page):
                found = -1
            elif self.page[special] == ">":
                found = special
            else:
                close = self.find(self.page[special], special + 1)
                if close >= 0:
                    at = close + 1
                    continue
                found = -1
            break
        else:
            found = self.ends[at]
        for x in passed:
            self.ends[x] = found
        return found

    def tag(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the first tag at or after a place; comments and the like have no name."""
        page = self.page
        while (start := self.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                close = self.find("-->", start + 4)
                return start, close + 3 if close >= 0 else len(page), "", "", ""
            if m := _NAME.match(page, start):
                close = self.end(m.end())
                if close >= 0:
                    return start, close + 1, m[1], m[2], page[m.end() : close]
                # The quotes never close: the tag ends at the next bracket, if that isn't one that opens another.
                stop = _BRACKET.search(page, m.end())
                if not stop or stop[0] == ">":
                    return start, stop.end() if stop else len(page), m[1], m[2], page[m.end() : stop.start() if stop else len(page)]
            if page.startswith(("<!", "<?", "</"), start):
                close = self.find(">", start + 2)
                return start, close + 1 if close >= 0 else len(page), "", "", ""
            at = start + 1
        return None


def blocks(page: str) -> tuple[list[tuple[str, str, int]], Counter]:
    """The blocks (container path, text, depth of the path where the article is left, or 0) in page order, and how often each container path occurs."""
    out: list[tuple[str, str, int]] = []
    containers: Counter = Counter()
    stack: list[tuple[str, int, str, bool]] = []  # tag, where the article is left, container path, inside main
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if t:
                _, outside, path, _ = stack[-1] if stack else ("", 0, "", False)
                out.append((path, t, outside))

    scan, opened, endless = _Scanner(page), Counter(), set()
    while True:
        m = scan.tag(at)
        text.append(page[at : m[0]] if m else page[at:])
        if not m:
            break
        _, at, closing, tag, attrs = m
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            if tag in INLINE:
                continue
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            continue
        if tag in RAW and not attrs.rstrip().endswith("/"):
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not end:
                endless.add(tag)
            if tag != "noscript" or end:
                at = end.end() if end else len(page)
            continue
        if tag in VOID or tag in INLINE:
            continue
        while stack and (stack[-1][0] == "p" and tag in _CLOSES_P or stack[-1][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
            opened[stack.pop()[0]] -= 1
        _, outside, path, inside = stack[-1] if stack else ("", 0, "", False)
        own, name = _role(tag, attrs, inside)
        if tag not in LEAVES and path.count("/") < DEEPEST:
            path = f"{path}/{name}"
            containers[path] += 1
        if not attrs.rstrip().endswith("/"):
            opened[tag] += 1
            stack.append((tag, path.count("/") + (tag in LEAVES) if own else outside, path, inside or tag in MAIN))
    flush()
    return out, containers


def _block_key(path: str, text: str) -> str:
    return f"#{xxhash.xxh3_64_hexdigest(text)} {path}"


def page_tokens(page: str) -> list[tuple[str, int, float, float]]:
    """(token, times, share of the page's text in it, share directly in it) of one page; the page itself is the token "/". A page without text has none."""
    found, containers = blocks(page)
    if not found:
        return []
    chars, own = Counter(), Counter()
    times: Counter = Counter({"/": 1}) + containers
    for path, text, _ in found:
        key = _block_key(path, text)
        times[key] += 1
        chars[key] += len(text)
        own[path or "/"] += len(text)
        parts = path.split("/")
        for i in range(2, len(parts) + 1):
            chars["/".join(parts[:i])] += len(text)
        chars["/"] += len(text)
    return [(t, n, chars[t] / chars["/"], own[t] / chars["/"]) for t, n in times.items()]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the deduced template of each host with enough different pages, as JSON.

    A template's tokens occur in LEAST_SHARE of the host's pages at least, so that there are at most 1 / LEAST_SHARE times as many as a
    page has on average, whatever the number of pages.
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, k, page_tokens(p)) for h, k, p in zip(pdf["host"], pdf["page_key"], pdf["html"])]
            lists = {name: [[t[i] for t in r[2]] for r in rows] for i, name in enumerate(("token", "times", "chars", "own"))}
            yield pd.DataFrame({"host": [r[0] for r in rows], "page_key": np.array([r[1] for r in rows], np.int64), **lists})

    x = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page_key"), F.coalesce("html", F.lit("")).alias("html")).where("host <> ''")
    # Copies of a page say nothing new: without them, each occurrence vector is over different pages.
    each = x.mapInPandas(tokens, "host string, page_key long, token array<string>, times array<int>, chars array<double>, own array<double>").dropDuplicates(["host", "page_key"])
    each = each.select("host", "page_key", F.explode(F.arrays_zip("token", "times", "chars", "own")).alias("t")).select("host", "page_key", "t.token", "t.times", "t.chars", "t.own")
    vector = F.bit_xor(F.xxhash64("page_key", "times"))
    seen = each.groupBy("host", "token").agg(vector.alias("vector"), F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("own").alias("own"))
    seen = materialize(seen.where(F.col("pages") >= LEAST_PAGES))
    totals = seen.where("token = '/'").select("host", F.col("pages").alias("all_pages"))
    totals = F.broadcast(totals) if totals.count() <= FEW_HOSTS else totals
    members = seen.join(totals, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all_pages"))
    members = members.groupBy("host").agg(F.collect_list(F.struct("token", "vector", "pages", "chars", "own")).alias("members"))

    def deduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"host": pdf["host"], "template": [json.dumps(nested([tuple(m[c] for c in ("token", "vector", "pages", "chars", "own")) for m in ms])) for ms in pdf["members"]]})

    return members.mapInPandas(deduce, "host string, template string")


def _outer(path: str) -> str:
    return path.rsplit("/", 1)[0] or "/"


def nested(members: list[tuple[str, int, int, float, float]]) -> dict:
    """The template of a host from its tokens (token, vector, pages, text in it, text directly in it), text as a sum of shares of pages.

    Tokens of one vector are a class. A class is valid if its containers stand in containers of the template, all the way out. Fixed blocks
    are those of a class that has a container too. The slots run from the page inwards: the article's is the container that holds
    MAIN_SHARE of the varying text of the one around it, until a container holds such text itself.
    """
    containers = {t: (v, n, chars, own) for t, v, n, chars, own in members if t[0] == "/"}
    valid = {t for t in containers if t == "/" or all("/".join(t.split("/")[:i]) in containers for i in range(2, t.count("/") + 1))}
    classes = {containers[t][0] for t in valid}
    fixed = {t: chars for t, v, n, chars, _ in members if t[0] == "#" and n >= FIXED_PAGES and v in classes}
    inside, directly = Counter(), Counter()  # text of fixed blocks
    for t, chars in fixed.items():
        path = t[1:].split(" ", 1)[1] or "/"
        directly[path] += chars
        while path != "/":
            inside[path] += chars
            path = _outer(path)
        inside["/"] += chars
    varying = {t: max(0.0, containers[t][2] - inside[t]) for t in valid}
    slots, at = [], "/"
    inner: dict[str, list[str]] = {}
    for t in valid - {"/"}:
        inner.setdefault(_outer(t), []).append(t)
    # Layouts differ in their outer containers: each child that holds enough of the text of the pages that have it is followed.
    todo = [at]
    while todo:
        at = todo.pop()
        if at != "/":
            slots.append(at)
        if containers[at][3] - directly[at] > OWN_SHARE * varying[at]:
            continue
        for child in inner.get(at, []):
            around = varying[at] * containers[child][1] / max(1, containers[at][1])  # in the pages that have the child, on average
            if varying[child] > 0 and varying[child] >= MAIN_SHARE * min(around, varying[at]):
                todo.append(child)
    return {"slots": sorted(slots, key=lambda t: (-t.count("/"), -varying[t], t)), "fixed": {t: own for t in slots if (own := _fixed_in(t, fixed, members, containers[t]))}}


def _fixed_in(slot: str, fixed: dict[str, float], members: list[tuple[str, int, int, float, float]], own: tuple) -> list[str]:
    """The fixed blocks of a slot: those in at least FIXED_SHARE of the pages that have it. None if they are most of its text: such pages are near copies of each other."""
    _, pages, chars, _ = own
    found = {t: c for t, _, n, c, _ in members if t in fixed and n >= FIXED_SHARE * pages and (p := t.split(" ", 1)[1]) and (p == slot or p.startswith(slot + "/"))}
    return sorted(found) if sum(found.values()) <= FIXED_SHARE * chars else []


def extract(page: str, template: dict | None, roles: bool = True) -> str:
    """The article's blocks, one to a line: those of the template's slot, else by the roles of elements.

    Inside the slot only what is below it can leave the article by its role; without `roles`, nothing does.
    """
    found, containers = blocks(page)
    slot = next((t for t in template["slots"] if t in containers), None) if template else None
    if slot is not None:
        fixed = set(template["fixed"].get(slot, ()))
        depth = slot.count("/")
        rest = [(path, text, left) for path, text, left in found if (path == slot or path.startswith(slot + "/")) and _block_key(path, text) not in fixed]
        return "\n".join(text for _, text, left in rest if not roles or left <= depth)
    rest = [(path, text) for path, text, left in found if not roles or not left]
    named = [(path, text) for path, text in rest if any(p.split(".")[0] in MAIN for p in path.split("/"))]
    return "\n".join(text for _, text in (named if roles and named else rest))


def main_text(pages: DataFrame, roles: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html), from the whole html.

    Null html counts as empty; pages without an article give an empty text. Hosts with fewer than LEAST_PAGES different
    pages, pages without a host in their url, and pages that have none of their host's slots are read by the roles of their elements
    alone. Copies of a page teach nothing new and get the same text; null ids and urls stay null. An empty table gives no rows.
    Without `roles`, templates alone decide.

    Templates go to the tasks in a broadcast if their measured size is under BROADCAST_BYTES, else by a join on
    the host with salts, so that a host with a third of all pages is dealt over many tasks.
    """
    spark = pages.sparkSession
    found = materialize(templates(pages))
    bytes_ = found.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0
    x = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    if bytes_ <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast({r["host"]: r["template"] for r in found.collect()})
    else:
        sent = None
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        dealt = x.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        x = dealt.join(found.withColumn("salt", salts), ["host", "salt"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, dict] = {}
        for pdf in batches:
            texts = []
            given = pdf["template"] if sent is None else pdf["host"].map(sent.value.get)
            for page, template in zip(pdf["html"], given):
                if isinstance(template, str) and template not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[template] = json.loads(template)
                texts.append(extract(page, parsed.get(template) if isinstance(template, str) else None, roles))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts})

    return x.mapInPandas(run, schema).withColumn("n_chars", F.length("text").cast("long"))
