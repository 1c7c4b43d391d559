"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and text slots. Runs of equal groups fold into repeated groups; then the streams of a
host are aligned one after the other with the wrapper so far. What is in one of them only becomes optional,
what differs in text only is a slot, a group that stands once where another page repeats it is a repeated
group. Streams that fold alike are counted, not kept, so what a host's wrapper is made of grows with the
variety of its pages and not with their number; it is also made in parts, which are aligned in turn.

Each slot of a wrapper has a place (its open elements; names that are a page's own are left out of it) and, over
all pages of the host, an amount of text. A slot is furniture if its text is the same on all pages of the host that
have it, where they are enough to tell. The slots with text of their own choose the element that holds the article,
and a page's text counts where the wrapper has a slot that is part of it. Elements and names that stand for
furniture are left out as well; on a host of one or two pages they are all there is to go by.
"""

import hashlib
import html as entities
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialise, small_batches

#: Parts in which a host's distinct streams are aligned first.
PARTS = 16
#: Tokens of a repeated group at most.
GROUP = 16
#: Different pages that a slot of one text must be on to be furniture; also half of the host's pages.
TELLING = 3
#: Bytes of all hosts' roots and places up to which they go to every executor; beyond, pages meet them by host and salt.
BROADCAST_BYTES = 64 << 20
SALTS = 32

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
BLOCKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Elements and names of what is not an article.
OUTSIDE = frozenset("head title nav header footer aside form button select iframe menu dialog".split())
OUTSIDE_NAMED = re.compile(r"(?:^|[\s_#-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|aside|footer|header|comments?|respond|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|social|share|sharing|related|widget|toolbar|pagination|pager|login|search)(?:$|[\s_-])", re.I)
#: In an article only whole classes and roles tell, as its own parts have names such as post-header, and ids are slugs.
OUTSIDE_WHOLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comments respond disqus cookie cookies consent gdpr popup modal newsletter subscribe social share sharing related widget toolbar pagination pager login search "
    "ad-box ad-container ad-slot related-posts related-articles related-links share-buttons share-links social-links social-share cookie-notice cookie-banner newsletter-signup post-navigation".split()
)
#: Classes and ids that are a page's own: numbered ones, and the topics that content systems put on an article.
OWN_NAME = re.compile(r"\d|^(?:category|tag|author)-", re.I)
ARTICLE_NAMED = re.compile(r"(?:^|[\s_#-])(?:article|main|content|post|entry|story|body)(?:$|[\s_-])", re.I)


def element_name(tag: str, attributes: str | None) -> str:
    """A tag with its classes, ids (#id) and roles, less those that are a page's own."""
    kept = []
    for kind, value in NAMED.findall(attributes) if attributes else ():
        value = value.strip("\"'")
        if kind.lower() == "id":
            value = "#" + value.strip() if OUTSIDE_NAMED.search(value) or ARTICLE_NAMED.search(value) else ""
        kept += [x for x in value.split() if not OWN_NAME.search(x)]
    return f"{tag}.{' '.join(kept)}" if kept else tag


def stream(page: str):
    """Yields (tag, place, text, line break) of a page: a tag, or (None) text at the place of its open elements."""
    open_, names, at = [], [], 0

    def close(upto: int):
        del open_[upto:], names[upto:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield None, names, page[at : m.start()], False
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag in open_:
                close(len(open_) - 1 - open_[::-1].index(tag))
                yield "/" + tag, names, "", tag not in INLINE
            continue
        closes = CLOSES.get(tag, {"p"} if tag in BLOCKS_P else None)
        while closes and open_ and (open_[-1] in closes or open_[-1] in INLINE and any(x in closes for x in open_[-4:])):
            close(len(open_) - 1)
        name = element_name(tag, m[4])
        if tag in VOID or m[4] and m[4].endswith("/"):
            yield name, names, "", tag not in INLINE
            continue
        open_.append(tag)
        names.append(name)
        yield name, names, "", tag not in INLINE
    if at < len(page):
        yield None, names, page[at:], False


def place(names) -> str:
    """A slot's open elements: inline ones, but links, make no difference."""
    return "/".join(x for x in names if x.split(".")[0] not in INLINE or x.split(".")[0] == "a")


# Items of a stream or wrapper: (kind, value, optional); kinds are "t" a tag, "#" a slot (its place), "+" a repeated group.


def key(item):
    return (item[0], tuple(map(key, item[1]))) if item[0] == "+" else item[:2]


def fold(items: list) -> list:
    """Runs of equal groups become repeated groups."""
    changed = True
    while changed:
        changed = False
        keys = [key(x) for x in items]
        for n in range(1, min(GROUP, len(items) // 2) + 1):
            out, i = [], 0
            while i < len(items):
                j = i
                while keys[j + n : j + 2 * n] == keys[i : i + n] and j + 2 * n <= len(items):
                    j += n
                if j > i:
                    body = items[i : i + n]
                    for k in range(i + n, j + n, n):
                        body = [(a, b, c or z) for (a, b, c), (_, _, z) in zip(body, items[k : k + n])]
                    out.append(body[0] if n == 1 and body[0][0] == "+" else ("+", tuple(body), False))
                    i = j + n
                else:
                    out.append(items[i])
                    i += 1
            if len(out) < len(items):
                items, changed = out, True
                break
    return items


def _known_groups(items: list, other: list) -> list:
    """A single occurrence of what other repeats becomes a repeated group too."""
    for kind, body, _ in other:
        if kind != "+":
            continue
        want, n, i = [key(x) for x in body], len(body), 0
        out = []
        while i < len(items):
            if [key(x) for x in items[i : i + n]] == want:
                out.append(("+", body, any(x[2] for x in items[i : i + n])))
                i += n
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(wrapper: list, page: list) -> list:
    """The wrapper that also takes page: the longest common subsequence stays, the rest is optional."""
    wrapper, page = _known_groups(wrapper, page), _known_groups(page, wrapper)
    a, b = [key(x) for x in wrapper], [key(x) for x in page]

    def same(i, j):
        if a[i] == b[j]:
            return 2
        return 1 if a[i][0] == b[j][0] == "+" and a[i][1][0] == b[j][1][0] else 0

    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            s = same(i, j)
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + s if s else 0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and (s := same(i, j)) and best[i][j] == best[i + 1][j + 1] + s:
            x, y = wrapper[i], page[j]
            value = x[1] if s == 2 else tuple(align(list(x[1]), list(y[1])))
            out.append((x[0], value, x[2] or y[2]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i][j] == best[i + 1][j]:
            out.append((*wrapper[i][:2], True))
            i += 1
        else:
            out.append((*page[j][:2], True))
            j += 1
    return fold(out)


def regular_expression(items) -> str:
    """A wrapper as people read it: <tag>, # for a slot, (...)+ and (...)? groups."""
    text = {"t": lambda v: f"<{v}>", "#": lambda v: "#", "+": lambda v: f"({regular_expression(v)})+"}
    return "".join(f"({x})?" if opt else x for x, opt in ((text[k](v), o) for k, v, o in items))


def slots(items) -> list[str]:
    """Places of a wrapper's slots."""
    out = []
    for kind, value, _ in items:
        if kind == "+":
            out += slots(value)
        elif kind == "#":
            out.append(value)
    return out


def outside(where: str, article: str = "") -> bool:
    """Whether a place lies in something that is not part of an article. In an article element, and in the place
    article, names count only if they are whole classes or roles."""
    inside, depth = False, article.count("/") + 1 if article and (where + "/").startswith(article + "/") else 0
    for k, x in enumerate(where.split("/")):
        tag, _, named = x.partition(".")
        if tag in OUTSIDE:
            return True
        if named and tag not in ("html", "body", "article", "main"):
            if any(n.lower() in OUTSIDE_WHOLE for n in named.split()) if inside or depth and k >= depth else OUTSIDE_NAMED.search(named):
                return True
        inside = inside or tag == "article"
    return False


def article_places(places: dict[str, tuple[int, int]]) -> tuple[str, list[str]]:
    """The element that holds the article, and the places that are part of it, of (characters, those of furniture) by place."""
    inside = {p: n - same for p, (n, same) in places.items() if n > same and not outside(p)}
    total = sum(inside.values())
    if not total:
        return "", []
    held: dict[str, int] = {}
    for p, n in inside.items():
        parts = p.split("/")
        for k in range(1, len(parts) + 1):
            root = "/".join(parts[:k])
            held[root] = held.get(root, 0) + n

    def marked(root):
        tag, _, named = root.rpartition("/")[2].partition(".")
        return tag in ("article", "main") or bool(named and tag not in ("html", "body") and ARTICLE_NAMED.search(named))

    good = [r for r in held if marked(r) and held[r] >= 0.2 * total] or [r for r in held if held[r] >= 0.8 * total and r.rpartition("/")[2].split(".")[0] not in ("p", "b", "a", "h1", "li", "ul")]
    root = max(good, key=lambda r: (held[r], r.rpartition("/")[2].startswith(("article", "main")), r.count("/"))) if good else ""
    under = [p for p, (n, same) in places.items() if n > same and (not root or p == root or p.startswith(root + "/"))]
    # An element that holds article elements, or that no name marks, has other things in it too.
    article = root if root and marked(root) and not any(x.split(".")[0] == "article" for p in under for x in p[len(root) + 1 :].split("/")) else ""
    return root, sorted(p for p in under if not outside(p, article))


def observe(page: str):
    """A page's folded stream and the characters of text by place."""
    items, texts = _observe(page)
    return items, {p: sum(map(len, parts)) for p, parts in texts.items()}


def _observe(page: str):
    """A page's folded stream and its texts by place."""
    items, texts = [], {}
    for tag, names, text, _ in stream(page):
        if tag:
            items.append(("t", tag, False))
            continue
        text = text.strip(" \t\n\r\f\v")
        if text:
            p = place(names)
            if not items or items[-1] != ("#", p, False):
                items.append(("#", p, False))
            texts.setdefault(p, []).append(text)
    return fold(items), texts


def extract(page: str, root: str, allowed: frozenset, rest: frozenset = frozenset()) -> str:
    """The text of the allowed slots in page order; in a page without the article's element, that of the slots in rest."""
    out, verdicts, last, seen = [], {}, root.rpartition("/")[2], not root
    for tag, names, text, breaks in stream(page):
        if tag:
            seen = seen or tag == last and place(names) == root
            if breaks:
                out.append(" ")
            continue
        p = place(names)
        ok = verdicts.get(p)
        if ok is None:
            ok = verdicts[p] = p in allowed
        if ok:
            out.append(entities.unescape(text))
        elif text.strip():
            out.append(" ")
    if not seen:
        return extract(page, "", rest)
    return SPACE.sub(" ", "".join(out)).strip(" ")


def _plain(x):
    return [x[0], [_plain(y) for y in x[1]] if x[0] == "+" else x[1], x[2]]


def _items(x) -> list:
    return [(k, tuple(_items(v)) if k == "+" else v, o) for k, v, o in x]


_SEEN = "host string, kind string, value string, n bigint, pages bigint, least bigint, most bigint, apart bigint"


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _observer(batches):
    """Streams and places of each host; a place has its characters, its pages, the least and greatest hash of its text on
    a page, and a bit for each of 64 classes of those pages' whole texts: at least so many of them are different."""
    for b in batches:
        seen: dict[tuple, list] = {}
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            items, texts = _observe(page or "")
            seen.setdefault((host, "stream", json.dumps([_plain(x) for x in items])), [0, 0, 0, 0, 0])[0] += 1
            digests = {p: _digest("\0".join(parts)) for p, parts in texts.items()}
            bit = 1 << sum(digests.values()) % 63
            for p, parts in texts.items():
                at, h = seen.setdefault((host, "place", p), [0, 0, digests[p], digests[p], 0]), digests[p]
                at[:] = at[0] + sum(map(len, parts)), at[1] + 1, min(at[2], h), max(at[3], h), at[4] | bit
            seen.setdefault((host, "pages", ""), [0, 0, 0, 0, 0])[1] += 1
        rows = [(*k, *v) for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 3 else pa.int64()) for i in range(8)], names=[x.split()[0] for x in _SEEN.split(", ")])


def _merged(streams) -> str:
    wrapper = None
    for s in sorted(streams, key=lambda s: (-len(s), s)):
        items = _items(json.loads(s))
        wrapper = items if wrapper is None else align(wrapper, items)
    return json.dumps([_plain(x) for x in wrapper or []])


def verdict(items: list, places: dict[str, tuple], pages: int) -> tuple[str, list[str], list[str]]:
    """The article's element, the wrapper's slots that are part of it, and those that count on a page without it, of
    (characters, pages, least and greatest hash, bits) by place and the host's number of pages."""
    have = set(slots(items))
    same = {p for p, (_, on, least, most, bits) in places.items() if least == most and bits.bit_count() >= TELLING and 2 * on >= pages}
    if all(p in same or outside(p) for p in have):
        same = set()  # the pages differ in furniture only: their text does not tell it from the article
    known = {p: (n, n if p in same else 0) for p, (n, *_) in places.items() if p in have}
    root, allowed = article_places(known)
    return root, allowed, sorted(p for p in known if p not in same and not outside(p))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (its regular expression), root, places of its article and of pages without the root, of pages(host, html)."""
    seen = pages.select("host", "html").mapInArrow(_observer, _SEEN).groupBy("host", "kind", "value")
    seen = seen.agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.bit_or("apart").alias("apart"))
    seen = materialise(seen)  # pages are read once for streams and places

    def part(pdf):
        return pd.DataFrame({"host": pdf.host[:1], "kind": "stream", "value": [_merged(pdf.value)], "n": [pdf.n.sum()], "pages": 0, "least": 0, "most": 0, "apart": 0})

    def whole(pdf):
        items = _items(json.loads(_merged(pdf.value[pdf.kind == "stream"])))
        known = pdf[pdf.kind == "place"]
        places = {p: x for p, *x in zip(known.value, *(known[c].tolist() for c in ("n", "pages", "least", "most", "apart")))}
        root, inside, rest = verdict(items, places, int(pdf.pages[pdf.kind == "pages"].sum()))
        return pd.DataFrame({"host": pdf.host[:1], "wrapper": [regular_expression(items)], "root": [root], "places": [json.dumps([inside, rest])]})

    parts = seen.where("kind = 'stream'").withColumn("part", F.expr(f"pmod(xxhash64(value), {PARTS})"))
    parts = parts.groupBy("host", "part").applyInPandas(lambda pdf: part(pdf), _SEEN)
    return parts.unionByName(seen.where("kind <> 'stream'")).groupBy("host").applyInPandas(lambda pdf: whole(pdf), "host string, wrapper string, root string, places string")


def _extractor(batches):
    known: dict[str, list[frozenset]] = {}
    for b in batches:
        ids, urls = b.column(0), b.column(1)
        texts = []
        for page, root, places in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            if places not in known:
                known[places] = [frozenset(x) for x in json.loads(places)]
            texts.append(extract(page or "", root or "", *known[places]))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages(page_id, url, html).

    text is empty where a page has none; null html is empty. Pages without a url, or with one that names no
    host, are one host. Repeated rows and null ids give a row each. Extra columns are ignored; an empty table
    gives an empty table. Unclosed elements, comments, scripts and pages that end midway are read as far as
    they go; pages of any length are read whole.
    """
    small_batches(pages.sparkSession, 500)
    rows = pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"))
    found = materialise(wrappers(rows).drop("wrapper"))
    size = found.agg(F.sum(F.expr("octet_length(host) + octet_length(root) + octet_length(places)"))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # pages stay where they are
        out = rows.join(F.broadcast(found), "host")
    else:  # a host's pages are dealt out over salts, each of which gets the host's wrapper
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), ["host", "salt"])
    return out.select("page_id", "url", "html", "root", "places").mapInArrow(_extractor, "page_id bigint, url string, text string")
