"""Main text of web pages, by wrappers inferred from the pages of each host.

A page is a stream of slots: runs of text, each with the path of the elements around it.  A
wrapper is a regular expression without unions over slots: slots in order, some optional, some
groups repeated.  It is inferred by alignment: runs of equal slots, or of equal groups of slots,
become one repeated item; a page is aligned with its host's wrapper so far, and slots that only
one side has become optional.  Only structures that differ are shuffled; those of a host are
folded in an order of their own, dealt over SPREAD tasks first, so that a wrapper depends neither
on the order of pages nor on which task ran where.

Every page is then read along its host's wrapper: each of its slots goes to the place that skips
the fewest slots a page must have, the earliest on ties.  The texts at a place, over all pages of
the host, say what it is: fixed (two pages or more, all with the same text), numbered (the same but
for numbers), open (different), or single (one page has it, which says nothing).

Slots are apart if an element on their path is one of those that hold menus, headers, footers,
sidebars, notices, adverts, forms or comments, by its name or by a class, id or role all of whose
words are about that: `comment-list` is, `side-effects` is not.  Within a main element (article,
main) headers, and labels and groups of fields that are in no form, are not apart.  Where a wrapper
has a main element, all slots within it that are not apart are content, and nothing else is.  Where
it has none, the content is the stretch from the first to the last open place that is not apart
(if none is open: numbered place).  Fixed and numbered places outside of it are template, single
ones and slots that have no place are content, and so is all of a host where no place is open or
numbered.  List items that are one link are content only within the stretch, and if their texts
are open.  If none of a page's slots is content in the wrapper, the page counts as its own wrapper.

A block is the text between two tags of block elements (br included); character references are
decoded, white space within a block is one space, and blocks are joined by a line feed.

Edge cases: null or empty html, and html without text, give an empty text; tags that are never
closed end with the element around them, comments and scripts at the end of the page; a null url
is one more host; rows repeated as a whole get a row each.  An empty table gives an empty
result.  Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

# Quotes count after an equals sign only; nothing is tried twice, so that no page takes long.
_TAG = r"""(?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|iframe|svg)\b{_TAG}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)({_TAG})>|<[!?/][^>]*>|[^<]+|<""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of their own kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPES = frozenset("table ul ol dl div article section main aside nav body td th".split())
APART = frozenset("head title nav menu footer aside form button fieldset dialog label option".split())
#: Of these, elements that belong to the text around them within a main element.
FIELDS = frozenset("label fieldset option".split())
MAIN = frozenset("article main".split())
#: Words of classes, ids and roles whose elements are apart; and words that say no more than where or what.
APART_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer ad ads advert adverts advertisement promo promotion sponsor sponsored cookie cookies notice notices consent gdpr popup modal overlay "
    "newsletter subscribe subscription alert comment comments reply replies respond disqus share sharing social related recommended recommendation recommendations login signup pager pagination copyright toolbar disclaimer".split()
)
PLAIN_WORDS = frozenset("area list section box block container wrapper wrap bar links link buttons button items item panel left right top bottom site page global primary secondary post posts article articles form thread inner message unit slot zone group title widget widgets body count media stories bottom".split())
HEADER_WORDS = frozenset("header masthead banner search skip".split())
_MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:articlebody|article-body|post-content|entry-content|main-content|article-content)(?:[^a-z]|$)")
#: Slots of the longest group that is looked for repeats.
GROUP = 4
#: Cells of the table by which two wrappers are aligned; larger ones are aligned by runs that both have.
CELLS = 1 << 20
#: Tasks over which the structures of one host are dealt before its wrapper is made in one.
SPREAD = 1024
_NUMBER = re.compile(r"\d+")

Slot = tuple[str, str]


def _names(tag: str, attributes: str, inside: bool = False) -> str:
    """tag, inside the main text or not, with ! if the element is apart from the main text, ~ if it is so outside of it, and * if it is the main text."""
    names = [n for m in _ATTRIBUTE.finditer(attributes) for n in next(filter(None, m.groups()[1:]), "").lower().split()] if attributes else []
    words = [frozenset(filter(None, re.split(r"[^a-z0-9]+", n))) for n in names] if tag not in ("html", "body") else []
    if tag in APART and not (inside and tag in FIELDS) or any(w & APART_WORDS and w <= APART_WORDS | PLAIN_WORDS for w in words):
        return f"{tag}!"
    if tag in MAIN or any(_MAIN_WORDS.search(n) or n in MAIN for n in names):
        return f"{tag}*"
    return f"{tag}~" if tag == "header" or any(w & HEADER_WORDS and w <= HEADER_WORDS | APART_WORDS | PLAIN_WORDS for w in words) else tag


def slots(html: str | None) -> Iterator[Slot]:
    """The blocks of a page: path of elements and text, in page order."""
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    link = True

    def block() -> Iterator[Slot]:
        nonlocal link
        text = " ".join(references.unescape("".join(parts)).split())
        parts.clear()
        if text:
            path = "/".join(name for tag, name in stack if tag in BLOCKS or name[-1] in "!*~")
            yield path + ("/a" if link else ""), text
        link = True

    for token in _TOKEN.finditer(html or ""):
        closing, tag, attributes = token[2], token[3], token[4]
        if tag is None:
            text = token[0]
            if token[1] or (text[0] == "<" and len(text) > 1):
                continue
            parts.append(text)
            link = link and (not text.strip() or any(t == "a" for t, _ in stack))
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            yield from block()
        elif tag in ("td", "th"):
            parts.append(" ")
        if closing:
            if any(t == tag for t, _ in stack):
                if tag not in BLOCKS and any(n[-1] in "!*~" for t, n in stack if t == tag):
                    yield from block()
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID:
            for k in range(len(stack) - 1, -1, -1) if tag in CLOSES else ():
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPES:
                    break
            name = _names(tag, attributes, tag in FIELDS and any(n[-1] == "*" for _, n in stack))
            if name[-1] in "!*~" and tag not in BLOCKS:
                yield from block()
            stack.append((tag, name))
    yield from block()


# A wrapper's item is [key, text or None or items of a group, optional, repeated].


def _merged(a: list, b: list) -> list:
    """Two items of one key in one."""
    if isinstance(a[1], list):
        inner: str | None | list = [_merged(x, y) for x, y in zip(a[1], b[1])]
    else:
        inner = a[1] if a[1] == b[1] else None
    return [a[0], inner, a[2] or b[2], a[3] or b[3]]


def collapse(items: list) -> list:
    """items with runs of equal items, or of equal groups, as one repeated item each."""
    again = True
    while again:
        again = False
        for size in range(1, GROUP + 1):
            keys, out, at = [x[0] for x in items], [], 0
            while at < len(items):
                end = at + size
                while keys[at : at + size] == keys[end : end + size] and end + size <= len(items):
                    end += size
                if end > at + size:
                    runs = [items[k : k + size] for k in range(at, end, size)]
                    one = reduce(lambda a, b: [_merged(x, y) for x, y in zip(a, b)], runs)
                    out.append([*one[0][:3], True] if size == 1 else [f"({' '.join(x[0] for x in one)})", one, False, True])
                    at, again = end, True
                else:
                    out.append(items[at])
                    at += 1
            items = out
    return items


def align(a: list, b: list) -> list:
    """The wrapper of what either wrapper accepts: equal items in common order, others optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_merged(x, y) for x, y in zip(a, b)]
    begin = next((k for k, (x, y) in enumerate(zip(a, b)) if x[0] != y[0]), min(len(a), len(b)))
    most = min(len(a), len(b)) - begin
    end = next((k for k in range(most) if a[-1 - k][0] != b[-1 - k][0]), most)
    head, tail = zip(a[:begin], b[:begin]), zip(a[len(a) - end :], b[len(b) - end :])
    return collapse([*(_merged(x, y) for x, y in head), *_aligned(a[begin : len(a) - end], b[begin : len(b) - end]), *(_merged(x, y) for x, y in tail)])


def _aligned(a: list, b: list) -> list:
    optional = lambda x: [*x[:2], True, x[3]]
    if len(a) * len(b) > CELLS:
        out, i, j = [], 0, 0
        for at, to, size in SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b]).get_matching_blocks():
            out += [*map(optional, a[i:at]), *map(optional, b[j:to]), *(_merged(x, y) for x, y in zip(a[at : at + size], b[to : to + size]))]
            i, j = at + size, to + size
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return out


def page_wrapper(page: list[Slot]) -> list:
    return collapse([[path, text, False, False] for path, text in page])


def _leaves(items: list, must: bool = True, at: int = 0) -> Iterator[tuple[str, bool, tuple[tuple[int, int], ...]]]:
    """The slots of a wrapper: path, whether a page must have it, and the ranges of leaves that are repeated around it, innermost first."""
    for key, inner, optional, again in items:
        if isinstance(inner, list):
            leaves = list(_leaves(inner, must and not optional, at))
        else:
            leaves = [(key, must and not optional, ())]
        around = ((at, at + len(leaves)),) if again else ()
        for path, needed, loops in leaves:
            yield path, needed, loops + around
        at += len(leaves)


class Wrapper:
    """A wrapper ready to read pages along it."""

    def __init__(self, items: list) -> None:
        leaves = list(_leaves(items))
        self.paths = [path for path, *_ in leaves]
        self._loops = [loops for *_, loops in leaves]
        self._needed = [0]
        for _, needed, _ in leaves:
            self._needed.append(self._needed[-1] + needed)
        self._at: dict[str, list[int]] = {}
        for k, path in enumerate(self.paths):
            self._at.setdefault(path, []).append(k)

    def places(self, page: list[Slot]) -> list[int]:
        """For each slot of page, its leaf in the wrapper; -1 if it has none."""
        out, at, needed = [], -1, self._needed
        for path, _ in page:
            same = self._at.get(path, [])
            found = []
            if (k := bisect_right(same, at)) < len(same):
                found.append((needed[same[k]] - needed[at + 1], same[k]))
            for begin, end in self._loops[at] if at >= 0 else ():
                if (k := bisect_left(same, begin)) < len(same) and same[k] <= at:
                    found.append((needed[end] - needed[at + 1] + needed[same[k]] - needed[begin], same[k]))
            out.append(min(found)[1] if found else -1)
            at = out[-1] if found else at
        return out


def _apart(path: str, main: bool) -> bool:
    names = path.split("/")
    inside = any(n.endswith("*") for n in names)
    return main and not inside or any(n.endswith("!") or n.endswith("~") and not inside for n in names)


def _listed(path: str) -> bool:
    names = path.split("/")
    return names[-1] == "a" and "li" in names


def content(paths: list[str], texts: dict[int, str]) -> list[bool]:
    """Whether each place of a wrapper is content, by its path and what the texts of all pages there are."""
    main = any("*" in path for path in paths)
    good = [not _apart(path, main) for path in paths]
    if main:
        return good
    anchors: list[int] = []
    for kind in ("open", "numbered"):
        anchors = anchors or [k for k, path in enumerate(paths) if good[k] and texts.get(k) == kind and not _listed(path)]
    first, last = (anchors[0], anchors[-1]) if anchors else (0, -1)
    for k, path in enumerate(paths):
        within = first <= k <= last
        if _listed(path):
            good[k] &= within and texts.get(k) == "open"
        else:
            good[k] &= within or not anchors or texts.get(k) not in ("fixed", "numbered")
    return good


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _inferrer(batches):
    """host, wrapper and part of the structures that differ within a batch."""
    for batch in batches:
        found: set[tuple[str, str]] = set()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found.add((host, json.dumps(page_wrapper([(path, "") for path, _ in slots(page)]), ensure_ascii=False)))
        hosts, structures = zip(*sorted(found)) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(structures, pa.string()), pa.array([_digest(w) % SPREAD for w in structures], pa.int32())], ["host", "wrapper", "part"])


def _joiner(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The wrapper of all wrappers of a host; pages without text, whose wrapper is empty, say nothing."""
    known = [json.loads(text) for text in sorted(table.column("wrapper").to_pylist(), key=lambda w: (len(w), w))]
    whole = reduce(align, filter(None, known)) if any(known) else []
    return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(whole, ensure_ascii=False)]})


def _placer(batches):
    """host, place, pages, and least and greatest digests of a page's texts there, as they are and without numbers."""
    for batch in batches:
        found: dict[tuple[str, int], list[int]] = {}
        known: dict[str, Wrapper] = {}
        for host, html, text in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))):
            wrapper = known[host] if host in known else known.setdefault(host, Wrapper(json.loads(text)))
            page = list(slots(html))
            here: dict[int, list[str]] = {}
            for place, (_, text) in zip(wrapper.places(page), page):
                if place >= 0:
                    here.setdefault(place, []).append(text)
            for place, texts in here.items():
                own = "\n".join(texts)
                exact, masked = _digest(own), _digest(_NUMBER.sub("0", own))
                n, a, b, c, d = found.get((host, place), (0, exact, exact, masked, masked))
                found[host, place] = [n + 1, min(a, exact), max(b, exact), min(c, masked), max(d, masked)]
        columns = list(zip(*found.values())) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], ["host", "place", "n", "a", "b", "c", "d"]
        )


def _hosted(pages: DataFrame, known: DataFrame) -> DataFrame:
    return pages.withColumn("host", host_of()).join(common.small(known, 20_000), "host")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, kinds) for each host of pages (url, html): the wrapper as JSON, and place -> fixed, numbered, open or single.

    Only hosts without a main element need kinds; of the others no page is read again.
    """
    parts = pages.select(host_of().alias("host"), "html").transform(common.map_batches, _inferrer, "host string, wrapper string, part int").distinct()
    schema = "host string, wrapper string"
    folded = parts.groupBy("host", "part").applyInArrow(_joiner, schema).groupBy("host").applyInArrow(_joiner, schema)
    known = common.save(folded, "structures")
    plain = known.where(~F.col("wrapper").contains("*"))
    if plain.isEmpty():
        return known.withColumn("kinds", F.create_map().cast("map<int,string>"))
    texts = _hosted(pages.select("url", "html"), plain).select("host", "html", "wrapper").transform(common.map_batches, _placer, "host string, place int, n long, a long, b long, c long, d long")
    texts = texts.groupBy("host", "place").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d"))
    kind = F.when(F.col("n") < 2, "single").when(F.col("a") == F.col("b"), "fixed").when(F.col("c") == F.col("d"), "numbered").otherwise("open")
    kinds = texts.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("place", kind))).alias("kinds"))
    return common.save(known.join(kinds, "host", "left"), "wrappers")


def _extract(page: list[Slot], paths: list[str], places: list[int], good: list[bool]) -> list[str]:
    main = any("*" in path for path in paths)
    return [text for (path, text), k in zip(page, places) if (good[k] if k >= 0 else not _apart(path, main) and not _listed(path))]


def _extractor(batches):
    known: dict[str, tuple[Wrapper, list[bool]]] = {}
    for batch in batches:
        texts = []
        for html, host, wrapper, kinds in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "wrapper", "kinds"))):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                whole = Wrapper(json.loads(wrapper))
                known[host] = whole, content(whole.paths, dict(kinds or ()))
            whole, good = known[host]
            page = list(slots(html))
            own = [path for path, _ in page]
            texts.append("\n".join(_extract(page, whole.paths, whole.places(page), good) or _extract(page, own, list(range(len(own))), content(own, {}))))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html)."""
    known = wrappers(pages)
    own = _hosted(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), known)
    return own.select("page_id", "url", "html", "host", "wrapper", "kinds").transform(common.map_batches, _extractor, "page_id long, url string, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
