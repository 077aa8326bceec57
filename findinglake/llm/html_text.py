"""Main text of HTML pages by consensus paths of each host.

Each page's containers (body, div, section, article and the like) are scored: the characters of their blocks outside of
links and of what can't be main text, less the further away a block is.  The best container and its rivals are votes for
their generalised paths: tags and classes from the body down, with figures in names replaced.  Spark adds up the
votes of each host, the paths that are best on enough of its pages win, and every page is extracted again at its own
best path if that is one of them, or else at the first of them that it has.  A page whose host has no such path, or that has no host, is extracted at its own best container.

Within the container all blocks are kept but for elements that HTML or their names mark as something else: menus,
headers and footers, sidebars, notices, adverts, forms, scripts, styles and readers' comments.  Headings of the
container's own headers stay.

A page is read in linear time, twice; HTML isn't shuffled.  Votes are combined on the map side, so a host with a third
of all pages is no task's burden.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage

_SHARE = 0.2  # of a host's pages must have a winning path as their best
_RIVAL = 0.3  # of the best score is a vote too
_DECAY = 0.8  # what a block counts for, one container further up
_FEW = 100_000  # so many hosts are broadcast at most

_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+"""
_TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{_ATTRIBUTES})>|<[a-zA-Z/!?][^>]*+(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
BLOCKS = _set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr caption ul"
)
CONTAINERS = _set("article body center div main section td")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
MAIN = _set("article main")
# Elements that hold no main text, whatever their names are.
NEVER = _set(
    "script style textarea title xmp iframe noembed noframes head nav footer aside form button select option input template noscript object svg canvas dialog menu "
    "datalist audio video applet map search"
)
ROLES = _set("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar form")
# Words of classes and ids.  A wrapper around all of a page may be named by what it contains, so one that holds an
# article or a main element isn't left out for its name, unless the name speaks of comments or of other pages.
NAMES = _set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar sidebars footer topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup signin login share sharing social pagination pager paging search searchbar widget widgets copyright disclaimer skip"
)
OTHERS = _set("comment comments commentlist disqus respond reply replies related recommended recommendations")
HEADERS = _set("header masthead")
NOT_NAMES = re.compile(r"^(?:has|no|with|without|is|not)[-_]")
CONTENT = _set("article content entry post story text body main")
# An open p, li and so on ends where one of these begins; the search stops at the second set.
_IMPLIED = {
    "li": (_set("li"), _set("ul ol menu dir")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")),
    "tr": (_set("tr td th"), _set("table")), "td": (_set("td th"), _set("tr table")), "th": (_set("td th"), _set("tr table")),
    "option": (_set("option"), _set("select")), "tbody": (_set("tbody thead tfoot tr td th"), _set("table")),
    "tfoot": (_set("tbody thead tfoot tr td th"), _set("table")), "thead": (_set("caption"), _set("table")),
}
_LIMITS = _set("table td th caption template")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}


class Page(NamedTuple):
    """Elements in the order of their starts, and texts with the element that holds them."""

    tags: list[str]
    parents: list[int]
    ends: list[int]  # the last element within each
    hashes: list[int]  # of the generalised paths
    labels: list[str]
    kinds: list[int]  # 0 text, 1 left out, 2 header
    items: list[tuple[int, str | None]]  # (element, text, or None where a block begins or ends)


def _kind_and_label(tag: str, rest: str) -> tuple[int, str, bool]:
    """0 text, 1 left out, 2 header, 3 left out if it holds no main element; the label; whether it is a main element."""
    kind, main = (1 if tag in NEVER else 2 if tag == "header" else 0), tag in MAIN
    if "=" not in rest and "hidden" not in rest:
        return kind, tag, main
    values = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        values.setdefault(name.lower(), a or b or c)
    names = [x for x in html.unescape(values.get("class", "")).split() if not NOT_NAMES.match(x)]
    ids = [values["id"]] if values.get("id") else []
    label = ".".join([tag, *sorted({_DIGITS.sub("0", x) for x in names})]) if names else f"{tag}#{_DIGITS.sub('0', ids[0])}" if ids else tag
    role, style = values.get("role", "").lower(), values.get("style", "").lower().replace(" ", "")
    main |= role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody"
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or role in ROLES:
        return 1, label, main
    words = {w for x in names + ids for w in _WORD.findall(_CAMEL.sub(" ", x).lower())}
    if kind or tag in ("body", "html"):
        return kind, label, main
    if words & OTHERS:
        return 1, label, main
    if main:
        return 0, label, main
    if words & NAMES and tag not in HEADINGS:
        return 3, label, main
    if (words & HEADERS or role == "banner") and tag not in HEADINGS:
        return 2, label, main
    return 0, label, main


def parse(text: str) -> Page:
    """The page's elements and texts.  Unclosed and misnested elements are closed like browsers do, roughly."""
    page = Page([""], [0], [0], [0], [""], [0], [])
    tags, parents, ends, hashes, labels, kinds, items = page
    stack, count, mains, pos = [0], {}, [], 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            i = stack.pop()
            ends[i] = len(tags) - 1
            count[tags[i]] -= 1
            if tags[i] in BLOCKS:
                items.append((stack[-1], None))

    def close_open(names: frozenset, limits: frozenset) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = tags[stack[depth]]
            if tag in limits:
                return
            if tag in names:
                low = depth
                while low > 1 and tags[stack[low - 1]] in names:
                    low -= 1
                close(low)
                return

    while pos < len(text):
        m = _TOKEN.search(text, pos)
        if m is None:
            items.append((stack[-1], text[pos:]))
            break
        if m.start() > pos:
            items.append((stack[-1], text[pos : m.start()]))
        pos = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                items.append((stack[-1], " "))
            elif count.get(name):
                block = name in BLOCKS
                for depth in range(len(stack) - 1, 0, -1):
                    tag = tags[stack[depth]]
                    if tag == name:
                        close(depth)
                        break
                    if (tag in _LIMITS and name != "table" and name != "tr" and not name.startswith("t")) or (not block and tag in BLOCKS):
                        break
            continue
        if name in BLOCKS:
            if count.get("p"):
                close_open(_P, _LIMITS)
            items.append((stack[-1], None))
        if name in _IMPLIED and any(count.get(x) for x in _IMPLIED[name][0]):
            close_open(*_IMPLIED[name])
        if name in ("br", "td", "th"):
            items.append((stack[-1], " "))
        if name in ("html", "body") and count.get(name):
            continue
        if name in VOID:
            continue
        if name == "body" and count.get("head"):
            close_open(_HEAD, frozenset())
        i, up = len(tags), stack[-1]
        kind, label, main = _kind_and_label(name, m["rest"])
        tags.append(name)
        parents.append(up)
        ends.append(i)
        labels.append(label)
        kinds.append(kind)
        hashes.append(hashes[up] if name in ("html", "body") else xxhash.xxh64_intdigest(label, hashes[up]) >> 1)
        if main:
            mains.append(i)
        if name in RAW:
            end = _RAW_END[name].search(text, pos)
            pos = end.end() if end else len(text)
            continue
        stack.append(i)
        count[name] = count.get(name, 0) + 1
    close(1)
    ends[0] = len(tags) - 1
    _settle(page, mains)
    return page


_P, _HEAD = _set("p"), _set("head")


def _settle(page: Page, mains: list[int]) -> None:
    """Elements left out for their names stay if they hold a main element; what is left out hands it down."""
    _, parents, _, _, _, kinds, _ = page
    for i in mains:
        while i and kinds[i] != 1:
            if kinds[i] == 3 or (kinds[i] == 2 and page.tags[i] != "header"):
                kinds[i] = 0
            i = parents[i]
    for i in range(1, len(kinds)):
        up = kinds[parents[i]]
        if up == 1 or kinds[i] in (1, 3):
            kinds[i] = 1
        elif up == 2 and kinds[i] == 0:
            kinds[i] = 2


def text_of(page: Page, roots: list[int]) -> str:
    """Blocks of the elements given (none within another), one a line."""
    tags, parents, ends, _, _, kinds, items = page
    blocks, part, own = [], [], list(roots)
    kept: dict[int, bool] = {}

    def keeps(i: int) -> bool:
        if i not in kept:
            heading, up = False, i
            if kinds[i] == 2 and not (len(own) == 1 and tags[own[0]] in ("", "html", "body")):
                while up and kinds[up] == 2 and not heading:
                    heading, up = tags[up] in HEADINGS, parents[up]
            kept[i] = kinds[i] == 0 or heading
        return kept[i]

    at = 0
    for i, text in items:
        while at < len(own) and i > ends[own[at]]:
            at += 1
        if text is None:
            if part:
                blocks.append(" ".join(html.unescape("".join(part)).split()))
                part = []
        elif at < len(own) and i >= own[at] and keeps(i):
            part.append(text)
    blocks.append(" ".join(html.unescape("".join(part)).split()))
    return "\n".join(b for b in blocks if b)


def scores(page: Page) -> tuple[list[float], list[float]]:
    """Of each element, 0 but for containers: the score, and the characters outside of links that it holds."""
    tags, parents, _, _, labels, kinds, items = page
    n = len(tags)
    own, linked, holder, link = [0.0] * n, [0.0] * n, [0] * n, [False] * n
    for i in range(1, n):
        holder[i] = i if tags[i] in CONTAINERS else holder[parents[i]]
        link[i] = tags[i] == "a" or link[parents[i]]
    for i, text in items:
        if text is not None and kinds[i] == 0:
            size = len(text) - text.count(" ") if len(text) < 4096 else len(text)
            (linked if link[i] else own)[holder[i]] += size if text.strip() else 0
    total, links, score = own[:], linked[:], own[:]
    for i in range(n - 1, 0, -1):
        if holder[i] == i:
            up = holder[parents[i]]
            total[up] += total[i]
            links[up] += links[i]
            score[up] += _DECAY * score[i]
    for i in range(n):
        if holder[i] == i and score[i]:
            words = set(_WORD.findall(labels[i].lower()))
            score[i] *= total[i] / (total[i] + links[i])
            score[i] *= 3 if tags[i] in MAIN else 1.25 if words & CONTENT and tags[i] != "body" else 1
    return score, total


def best(page: Page) -> tuple[int, list[float]]:
    """The best container, or its parent where that adds headings and loose text only; and all scores."""
    tags, parents, _, _, _, kinds, items = page
    score, total = scores(page)
    top = max(range(len(tags)), key=lambda i: (score[i], -i))
    while top and tags[top] not in MAIN:
        up = parents[top]
        while up and tags[up] not in CONTAINERS:
            up = parents[up]
        if not up or tags[up] == "body" or kinds[up]:
            break
        beside = [i for i in range(up + 1, page.ends[up] + 1) if not top <= i <= page.ends[top] and tags[i] in CONTAINERS and total[i]]
        if total[up] <= total[top] or any(i > top or page.ends[i] < top for i in beside):
            break
        top = up
    return top, score


def _path(page: Page, i: int) -> str:
    out = []
    while i and page.tags[i] not in ("html", "body"):
        out.append(page.labels[i])
        i = page.parents[i]
    return ">".join(["body", *reversed(out)])


def votes(text: str) -> list[tuple[int, str, float, int]]:
    """A page's votes: path (hashed and written out), weight, and 1 for the best; none for a page without text."""
    page = parse(text)
    top, score = best(page)
    if not score[top]:
        return []
    out = {page.hashes[top]: (page.hashes[top], _path(page, top), 1.0, 1)}
    for i, s in enumerate(score):
        if s >= _RIVAL * score[top] and page.hashes[i] not in out:
            out[page.hashes[i]] = (page.hashes[i], _path(page, i), min(0.99, s / score[top]) / 2, 0)
    return list(out.values())


def extract(text: str, winners: list[int]) -> tuple[str, str]:
    """Text and path: the page's own best path if it is among the winners, else the first of them that the page has."""
    page = parse(text)
    top, _ = best(page)
    own = page.hashes[top]
    places: dict[int, list[int]] = {}
    if own not in winners:
        for i, h in enumerate(page.hashes):
            if page.kinds[i] == 0 and page.tags[i] in CONTAINERS:
                places.setdefault(h, []).append(i)
    for h in [own] if own in winners else [*winners, own]:
        roots = [i for i, x in enumerate(page.hashes) if x == h and page.kinds[i] == 0] if h == own else places.get(h, [])
        roots = _outer(page, roots)
        found = text_of(page, roots)
        if found:
            return found, _path(page, roots[0])
    return text_of(page, [0]), "body"


def _outer(page: Page, roots: list[int]) -> list[int]:
    out, end = [], -1
    for i in roots:
        if i > end:
            out.append(i)
            end = page.ends[i]
    return out


def host_of(url):
    """The host of a URL column, in lower case and without port; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame, share: float = _SHARE) -> DataFrame:
    """Per host: host and winners, (hash, path, votes) of the paths that are best on `share` of its pages, most votes first."""
    schema = "host string, hash long, path string, weight double, top int"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # page by page: the longest text is all that is held
                host, rows = batch.column(0)[i].as_py(), votes(batch.column(1)[i].as_py() or "")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(rows)), *map(pa.array, zip(*rows))], schema=out)

    out = pa.schema([("host", pa.string()), ("hash", pa.int64()), ("path", pa.string()), ("weight", pa.float64()), ("top", pa.int32())])
    cast = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null").mapInArrow(run, schema)
    # Weights are whole thousandths, so that sums don't depend on their order.
    paths = cut_lineage(cast.groupBy("host", "hash").agg(F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("votes"), F.sum("top").alias("tops"), F.min("path").alias("path")))
    hosts = paths.groupBy("host").agg(F.sum("tops").alias("pages"))
    # Pages have one best path each, so 1 / share paths win at most; rivals' votes put them in order.
    agreed = paths.join(hosts, "host").where(F.col("tops") >= share * F.col("pages"))
    order = F.sort_array(F.collect_list(F.struct("votes", "hash", "path")), asc=False)
    return agreed.groupBy("host").agg(F.transform(order, lambda x: F.struct(x.hash.alias("hash"), x.path.alias("path"), x.votes.alias("votes"))).alias("winners"))


def main_text(pages: DataFrame, share: float = _SHARE) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points) and path, the container's generalised path.

    A null or empty page has an empty text.  Pages without url or host, and repeated rows, count like others; the former
    are extracted at their own best containers.  Columns other than page_id, url and html are not read.
    """
    winners = cut_lineage(host_paths(pages, share).select("host", F.col("winners.hash").alias("winners")))
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    told = F.broadcast(winners) if winners.limit(_FEW + 1).count() <= _FEW else winners
    rows = rows.join(told, "host", "left").select("page_id", "url", "html", "winners")
    schema = pages.select("page_id", "url", F.lit("").alias("text"), F.lit("").alias("path")).schema

    def run(batches):
        for batch in batches:
            found = [extract(batch.column(2)[i].as_py() or "", batch.column(3)[i].as_py() or []) for i in range(batch.num_rows)]
            columns = [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "path"])

    return rows.mapInArrow(run, schema).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
