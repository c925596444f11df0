"""Main text of pages from the slots of templates deduced by equivalence classes.

The template of each host is deduced from all its pages. Tokens are tags and the
words between them, told apart by the elements they stand in; what page furniture
holds, by element name, role, class name or id, is none, and words of an article or
main element are never template. For each token of a host an aggregation gives the
number of pages that hold it and a hash of its occurrence vector, that is of how often
it occurs on which page. Tokens with equal vectors form a class, if enough pages have them and a tag is among them. On the
pages themselves a class is then tested for order: its tokens follow one another in
one order, round after round; tokens that do not are put aside, and a class that
repeats in another order with them. Two classes nest if on all pages the one lies in
one and the same gap of the other, or outside; of two that do not, the one on fewer
pages is put aside. The classes left are the template, each in the gap of the class
around it.

Each page is then read along its host's template, outer classes first: a class is
there where its tokens follow one another, all of them, in the gap of the class around
it; its tokens elsewhere are the page's own. What stands beside the template is in
slots, the gaps of the innermost class around it. The main text is that of the slots
in an article or main element if the page has one, else of all.
"""

from __future__ import annotations

import html as html_entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webweft.llm.components import components
from webweft.runtime import materialize

#: A class has at least this many tokens, and is on at least so many pages of the host and
#: this share of them; near copies, whose own text would pass for a template, count once.
MIN_TOKENS = 3
MIN_SUPPORT = 4
MIN_SHARE = 0.3
#: Pages whose word pairs have about this Jaccard similarity are near copies; minimum hashes
#: of a page, in bands of BAND_ROWS, one of which has to agree for two pages to be compared.
NEAR = 0.6
BANDS = 11
BAND_ROWS = 3
#: Tokens held per writer before they are passed on.
HELD_TOKENS = 400_000
#: Templates are broadcast up to this many tokens, and joined by host beyond.
BROADCAST_TOKENS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
#: Elements whose content is page furniture wherever they stand.
FURNITURE = frozenset("head title script style noscript template nav footer aside form button select option textarea iframe svg math object canvas audio video dialog menu label fieldset input".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that the start of a block ends, and the blocks that do so.
CLOSES_P = BLOCK - frozenset(["br", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "html", "body"])
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu", "dir"), "option": ("select",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "dd": ("dl",), "dt": ("dl",)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Class names and ids, as a whole, of page furniture.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising ad-banner ad-container ad-slot ad-unit ad-wrapper sponsor sponsors sponsored promo promos promotion "
    "banner site-banner nav navbar navigation main-nav site-nav top-nav nav-menu nav-links main-navigation site-navigation post-navigation menu main-menu site-menu menubar "
    "breadcrumb breadcrumbs sidebar side-bar sidebar-left sidebar-right left-sidebar right-sidebar widget widgets widget-area footer site-footer page-footer foot masthead site-header "
    "cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice cookiebar consent gdpr notice newsletter newsletter-signup newsletter-form subscribe subscribe-form signup sign-up login "
    "social social-links social-media social-icons social-share share shares share-buttons share-links share-bar sharing sharedaddy related related-posts related-articles related-content related-links "
    "recommend recommended recommendations comment comments comment-list commentlist comments-area comment-form replies disqus disqus_thread respond popup modal overlay toolbar pagination pager "
    "skip-link copyright disclaimer".split()
)
_OWN = frozenset(["article", "main"])
_RUNS = re.compile(r"\s+|\S+")
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_FACTORS = np.random.default_rng(20_240_502).integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = re.compile(r"[ \t\n\r\f\v  -     　 \u0085]+")


def _furniture(name: str, attributes: str, inside: list[str]) -> bool:
    """Furniture by element name, role or hiding."""
    if name in FURNITURE or name == "header" and "article" not in inside and "main" not in inside:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return bool(attributes) and bool(_HIDDEN.search(attributes)) and name not in ("html", "body")
    if _HIDDEN.search(attributes):
        return True
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role" and value.strip() in ROLES:
            return True
    return False


def _hinted(name: str, attributes: str) -> bool:
    """Furniture by class name or id."""
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    return any(key.lower() in ("class", "id") and not HINTS.isdisjoint((a or b or c).lower().split()) for key, a, b, c in _ATTRIBUTE.findall(attributes))


def tokens_of(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, value, path, furniture) in page order: kind ``tag`` or ``text``; the
    path is the open elements' names. Unclosed elements end where HTML ends them,
    and an end tag without a start ends nothing.

    Class names and ids do not make furniture of what holds the page's content: on
    a page without another article or main element, those that hold one with at
    least as much text as stands outside furniture, else those that hold half the text."""
    tokens = list(_scan(page))
    spared = _spared(tokens) if any(hints for *_, hints in tokens) else frozenset()
    for kind, value, path, marked, hints in tokens:
        yield kind, value, path, marked or not spared.issuperset(hints)


def _spared(tokens: list) -> frozenset:
    """Elements, by their place in the page, whose class names and ids are ignored."""
    free, total, holds, articles, in_articles = 0, 0, Counter(), set(), 0
    for kind, value, path, marked, hints in tokens:
        if marked:
            continue
        if kind == "tag":
            if value in ("article", "main"):
                if not hints:
                    return frozenset()
                articles.update(hints)
            continue
        size = len("".join(value.split()))
        total += size
        if not hints:
            free += size
            continue
        holds.update(dict.fromkeys(hints, size))
        if not {"article", "main"}.isdisjoint(path.split("/")):
            in_articles += size
    if in_articles and in_articles >= free:
        return frozenset(articles)
    return frozenset(at for at, size in holds.items() if 2 * size >= total and size)


def _scan(page: str) -> Iterator[tuple[str, str, str, bool, tuple[int, ...]]]:
    """Tokens with furniture by element alone, and the places of the open elements
    that class names and ids tell as furniture."""
    names: list[str] = []
    paths, marks = [""], [False]  # of the elements open, and of none
    hints: list[tuple[int, ...]] = [()]
    at, size = 0, len(page)

    def cut(depth: int) -> None:
        del names[depth:], paths[depth + 1 :], marks[depth + 1 :], hints[depth + 1 :]

    for m in _TAG.finditer(page):
        start = m.start()
        if start < at:  # inside raw text
            continue
        if start > at:
            yield "text", page[at:start], paths[-1], marks[-1], hints[-1]
        at = m.end()
        slash, name, attributes = m.groups()
        if name is None:
            if page.startswith("<![CDATA[", start):
                yield "text", m[0][9:].removesuffix("]]>"), paths[-1], marks[-1], hints[-1]
            continue
        name = name.lower()
        if slash:
            if name in names:
                cut(len(names) - 1 - names[::-1].index(name))
                yield "tag", "/" + name, paths[-1], marks[-1], hints[-1]
            elif name in ("p", "br"):
                yield "tag", "/" + name, paths[-1], marks[-1], hints[-1]
            continue
        if name in CLOSES_P and "p" in names:
            cut(len(names) - 1 - names[::-1].index("p"))
        if name in CLOSED_BY_SAME:
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] in CLOSED_BY_SAME[name]:
                    break
                if names[depth] == name or {names[depth], name} in ({"dd", "dt"}, {"td", "th"}):
                    cut(depth)
                    break
        marked = marks[-1] or _furniture(name, attributes, names)
        hint = (*hints[-1], start) if _hinted(name, attributes) else hints[-1]
        yield "tag", name, paths[-1], marked, hint
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            yield "text", page[at : close.start() if close else size], f"{paths[-1]}/{name}", True, ()
            at = close.end() if close else size
            continue
        names.append(name), paths.append(f"{paths[-1]}/{name}"), marks.append(marked), hints.append(hint)
    if at < size:
        yield "text", page[at:], paths[-1], marks[-1], hints[-1]


def _text(raw: str) -> str:
    return html_entities.unescape(raw) if "&" in raw else raw


def _code(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - 2**63


def tokens_coded(tokens: list, known: dict | None = None) -> list[int]:
    """The code of each tag and of each word outside furniture, articles and main
    elements, in page order. Codes of tags are even, those of words odd."""
    known = {} if known is None else known
    out = []
    for kind, value, path, marked in tokens:
        if marked or kind == "text" and not _OWN.isdisjoint(path.split("/")):
            continue
        for part in [value] if kind == "tag" else value.split():
            code = known.get((kind, path, part))
            if code is None:
                code = known[kind, path, part] = _code(kind, path, part) & ~1 | (kind == "text")
            out.append(code)
    return out


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """host, token, pages, vector, place: of what this task has seen of a token, the
    pages it is on, a sum of hashes of (page, times), and a sum of its relative places."""
    held: dict[tuple[str, int], list] = {}

    def flush() -> pd.DataFrame:
        rows = [(h, t, *v) for (h, t), v in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["host", "token", "pages", "times", "vector", "place"])

    for batch in batches:
        for host, row, codes in zip(batch["host"], batch["row"], batch["codes"]):
            codes = codes.tolist()
            counts = Counter(codes)
            first = dict(zip(reversed(codes), range(len(codes) - 1, -1, -1)))
            for code, times in counts.items():
                mark = (row * 0x9E3779B97F4A7C15 + times * 0xBF58476D1CE4E5B9) & (2**64 - 1)
                mark = (mark ^ (mark >> 29)) * 0x94D049BB133111EB & (2**40 - 1)
                entry = held.setdefault((host, code), [0, 0, 0, 0.0])
                entry[0] += 1
                entry[1] += times
                entry[2] += mark
                entry[3] += first[code] / len(codes)
            if len(held) > HELD_TOKENS:
                yield flush()
    yield flush()


def _in_order(ranks: list[int]) -> set[int]:
    """Places of a longest ascending run of ``ranks``, not necessarily of neighbours."""
    ends: list[int] = []  # of runs by length, the smallest last rank
    at: list[int] = []
    before: list[int | None] = []
    for place, rank in enumerate(ranks):
        size = bisect_left(ends, rank)
        ends[size:], at[size:] = [rank, *ends[size + 1 :]], [place, *at[size + 1 :]]
        before.append(at[size - 1] if size else None)
    kept, place = set(), at[-1] if at else None
    while place is not None:
        kept.add(place)
        place = before[place]
    return kept


def disordered(codes: list[int], classes: dict[int, tuple[int, int]]) -> set[int]:
    """Tokens of a page that break the order of their class. ``classes`` gives each
    token's class and its rank there; a class that repeats is in order or not as a whole."""
    found: dict[int, list[int]] = {}
    for code in codes:
        if code in classes:
            found.setdefault(classes[code][0], []).append(code)
    out: set[int] = set()
    for here in found.values():
        ranks = [classes[c][1] for c in here]
        order = sorted(set(ranks))
        if len(order) == len(ranks):
            kept = _in_order(ranks)
            out.update(c for place, c in enumerate(here) if place not in kept)
        elif ranks != order * (len(ranks) // len(order)):
            out.update(here)
    return out


def relations(codes: list[int], classes: dict[int, tuple[int, int]]) -> set[tuple[int, int, int]]:
    """(class, other, gap) for classes of a page: the gap of ``other`` in which every
    occurrence of ``class`` lies, -1 if all lie outside it, -2 if neither holds.
    A gap is known by the rank of the token before it."""
    places: dict[int, list[tuple[int, int]]] = {}
    for place, code in enumerate(codes):
        if code in classes:
            name, rank = classes[code]
            places.setdefault(name, []).append((place, rank))
    first = {name: min(r for _, r in at) for name, at in places.items()}
    final = {name: max(r for _, r in at) for name, at in places.items()}
    out = set()
    for name, own in places.items():
        starts = [i for i, (_, r) in enumerate(own) if r == first[name]]
        rounds = [(own[i][0], own[j - 1][0]) for i, j in zip(starts, [*starts[1:], len(own)])]
        for other, theirs in places.items():
            if other == name:
                continue
            at = [p for p, _ in theirs]
            gaps = set()
            for begin, end in rounds:
                before = bisect_left(at, begin)
                rank = theirs[before - 1][1] if before else final[other]
                gaps.add(-2 if bisect_left(at, end) != before else -1 if rank == final[other] else rank)
            out.add((name, other, gaps.pop() if len(gaps) == 1 else -2))
    return out


def _tested(test):
    """Rows of what ``test`` finds of each page's codes under its host's classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict] = {}
        for batch in batches:
            found: set = set()
            for host, codes, *template in zip(*(batch[c] for c in ("host", "codes", "token", "class", "rank"))):
                if host not in held:
                    if len(held) > 100:
                        held.clear()
                    tokens, classes, ranks = (np.asarray(x).tolist() for x in template)
                    held[host] = dict(zip(tokens, zip(classes, ranks)))
                found.update((host, *x) for x in test(codes.tolist(), held[host]))
            if found:
                yield pd.DataFrame(list(found), columns=["host", *_RESULT[test]])

    return run


def _broken(codes: list[int], classes: dict) -> set[tuple[int]]:
    return {(c,) for c in disordered(codes, classes)}


_RESULT = {_broken: ["token"], relations: ["class", "other", "gap"]}


def _sketch(text: str) -> bytes:
    """Minimum hashes of the text's pairs of words."""
    words = pd.util.hash_array(np.array(text.split() or [""], object), categorize=False)
    pairs = words[:-1] * _FACTORS[0] + words[1:] if len(words) > 1 else words
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(pairs), 8192):
        least = np.minimum(least, (pairs[at : at + 8192, None] * _FACTORS >> np.uint64(32)).min(axis=0))
    return least.astype("<u4").tobytes()


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each page the sketch of its text and the codes of its tokens."""
    known: dict = {}
    for batch in batches:
        sketches, codes = [], []
        for page in batch["html"]:
            tokens = list(tokens_of(page))
            sketches.append(_sketch(_extract(tokens, {}, {})))
            codes.append(tokens_coded(tokens, known))
            if len(known) > HELD_TOKENS:
                known.clear()
        yield pd.DataFrame({"host": batch["host"], "row": batch["row"], "sketch": sketches, "codes": codes})


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    width = 4 * BAND_ROWS
    for batch in batches:
        rows = [(_code(host, str(n), sketch[n * width : (n + 1) * width].hex()), node) for host, node, sketch in zip(batch["host"], batch["node"], batch["sketch"]) for n in range(BANDS)]
        yield pd.DataFrame(rows, columns=["band", "node"])


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        like = [(np.frombuffer(a, "<u4") == np.frombuffer(b, "<u4")).mean() >= NEAR for a, b in zip(batch["sketch"], batch["first_sketch"])]
        yield batch.loc[np.array(like, bool), ["first", "node"]]


def representatives(pages: DataFrame) -> DataFrame:
    """The rows of one page of each class of near copies; ``pages`` has host, row and
    sketch, and rows with equal host and row are one page."""
    rows = pages.withColumn("node", F.xxhash64("host", "row"))
    bands = rows.select("host", "node", "sketch").mapInPandas(_bands, "band long, node long")
    firsts = bands.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("band", "first")
    pairs = materialize(bands.join(firsts, "band").where("first <> node").select("first", "node").distinct(), "page-pairs")
    ends = pairs.select("node").unionByName(pairs.select(F.col("first").alias("node"))).distinct()
    held = rows.select("node", "sketch").join(ends, "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(held, "node").join(held.select(F.col("node").alias("first"), F.col("sketch").alias("first_sketch")), "first")
    found = components(both.mapInPandas(_near, "first long, node long"), "first", "node")
    return rows.join(found.where("node <> component").select("node"), "node", "left_anti").drop("node").dropDuplicates(["host", "row"])


def _classes(tokens: DataFrame) -> DataFrame:
    """The tokens of the classes that have enough of them and a tag, with their ranks."""
    sizes = tokens.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.expr("token % 2 = 0")).alias("tags")).where((F.col("size") >= MIN_TOKENS) & (F.col("tags") > 0))
    own = Window.partitionBy("host", "class").orderBy("place", "token")
    return tokens.join(sizes.select("host", "class"), ["host", "class"], "left_semi").withColumn("rank", F.row_number().over(own).cast("int"))


def _by_host(tokens: DataFrame) -> DataFrame:
    """Lists ``token, class, rank`` of each ``host``; broadcast up to BROADCAST_TOKENS tokens, whose number is counted."""
    found = tokens.groupBy("host").agg(F.collect_list(F.struct("token", "class", "rank")).alias("t")).select("host", "t.token", "t.class", "t.rank")
    return F.broadcast(found) if tokens.count() <= BROADCAST_TOKENS else found


def template_tokens(pages: DataFrame) -> DataFrame:
    """``host, token, class, rank, pages, parent, gap``: the template of each host.
    ``parent`` is the class around a class, null at the top, and ``gap`` the rank of the
    parent's token before it. Hosts of fewer pages than MIN_SUPPORT, near copies not
    counted, have none: all their pages hold is in one slot.

    ``pages`` has host, row and html. Sketches and tokens of pages as codes are written
    and shuffled, no texts.
    """
    skeletons = materialize(pages.select("host", "row", "html").mapInPandas(_skeletons, "host string, row long, sketch binary, codes array<long>"), "page-skeletons")
    own = materialize(representatives(skeletons).select("host", "row", "codes"), "page-own")
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= MIN_SUPPORT)
    seen = own.mapInPandas(_occurrences, "host string, token long, pages long, times long, vector long, place double")
    tokens = seen.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "times", "vector", "place"))).join(totals, "host")
    tokens = tokens.where((F.col("pages") >= MIN_SUPPORT) & (F.col("pages") >= MIN_SHARE * F.col("total")))
    tokens = tokens.select("host", "token", F.xxhash64("pages", "times", "vector").alias("class"), "pages", (F.col("place") / F.col("pages")).alias("place"))
    tokens = materialize(_classes(tokens), "template-classes")
    broken = own.join(_by_host(tokens), "host").mapInPandas(_tested(_broken), "host string, token long").distinct()
    tokens = materialize(_classes(tokens.drop("rank").join(broken, ["host", "token"], "left_anti")), "template-ordered")
    found = own.join(_by_host(tokens), "host").mapInPandas(_tested(relations), "host string, class long, other long, gap int").groupBy("host", "class", "other").agg(F.min("gap").alias("gap"), F.max("gap").alias("most"))
    found = materialize(found, "template-relations")
    support = tokens.groupBy("host", "class").agg(F.max("pages").alias("pages"), F.count(F.lit(1)).alias("size")).select("host", "class", F.struct("pages", "size", "class").alias("weight"))
    there = support.select("host", F.col("class").alias("other"), F.col("weight").alias("other_weight"))
    # Of two classes, neither of which lies in one gap of the other on all pages, nor always outside, the lighter goes.
    back = found.select("host", F.col("class").alias("other"), F.col("other").alias("class"), F.col("gap").alias("back"), F.col("most").alias("back_most"))
    nested, apart = "gap = most and gap >= 0 or back = back_most and back >= 0", "gap = -1 and most = -1 and back = -1 and back_most = -1"
    unlike = found.join(back, ["host", "class", "other"]).where(f"class < other and not ({nested}) and not ({apart})").join(support, ["host", "class"]).join(there, ["host", "other"])
    gone = unlike.select("host", F.when(F.col("weight") < F.col("other_weight"), F.col("class")).otherwise(F.col("other")).alias("class")).distinct()
    valid = tokens.join(gone, ["host", "class"], "left_anti")
    around = found.where("gap >= 0 and gap = most").join(gone, ["host", "class"], "left_anti").join(gone.withColumnRenamed("class", "other"), ["host", "other"], "left_anti").select("host", "class", "other", "gap")
    depth = around.groupBy("host", "class").agg(F.count(F.lit(1)).alias("depth")).select("host", F.col("class").alias("other"), "depth")
    inner = around.join(depth, ["host", "other"], "left").groupBy("host", "class").agg(F.max(F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), F.col("other").alias("parent"), "gap")).alias("p"))
    return valid.join(inner, ["host", "class"], "left").select("host", "token", "class", "rank", "pages", F.col("p.parent").alias("parent"), F.col("p.gap").alias("gap"))


def _has_article(tokens: list) -> bool:
    return any(kind == "tag" and value in ("article", "main") and not marked for kind, value, _, marked in tokens)


def in_place(codes: list[int], template: dict[int, tuple[int, int]], around: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Class and rank of the tokens of a page that are its template's, by their place.

    ``template`` gives each token's class and rank, ``around`` the class around a class
    and the gap there. Of a class whole rounds count, in the order of its ranks and in
    that gap if the class around it is on the page; other occurrences are the page's own."""
    found: dict[int, list[tuple[int, int]]] = {}
    for place, code in enumerate(codes):
        if code in template:
            name, rank = template[code]
            found.setdefault(name, []).append((place, rank))
    if not found:
        return {}
    order: dict[int, list[int]] = {}
    for name, rank in template.values():
        if name in found:
            order.setdefault(name, []).append(rank)
    rounds: dict[int, list[tuple[int, int]]] = {}

    def read(name: int) -> list[tuple[int, int]]:
        here, ranks = found[name], sorted(order[name])
        parent, gap = around.get(name, (None, None))
        if parent in found and (theirs := rounds.get(parent)):
            at = [p for p, _ in theirs]
            here = [(p, r) for p, r in here if (k := bisect_left(at, p)) and theirs[k - 1][1] == gap]
        if [r for _, r in here] == ranks * (len(here) // len(ranks)):
            return here
        out: list[tuple[int, int]] = []
        begin = 0
        while (end := _round(here, ranks, begin)) is not None:
            start, back = end, len(ranks) - 1  # the latest start of a round that ends here
            while back:
                start -= 1
                back -= here[start][1] == ranks[back - 1]
            for p, r in here[start : end + 1]:
                if r == ranks[back]:
                    out.append((p, r))
                    back += 1
                    if back == len(ranks):
                        break
            begin = end + 1
        return out

    for name in found:  # outer classes first
        chain = [name]
        while (parent := around.get(chain[-1], (None, None))[0]) in found and parent not in rounds and parent not in chain:
            chain.append(parent)
        for each in reversed(chain):
            if each not in rounds:
                rounds[each] = read(each)
    return {place: (name, rank) for name, kept in rounds.items() for place, rank in kept}


def _round(here: list[tuple[int, int]], ranks: list[int], begin: int) -> int | None:
    """Where the first whole round from ``begin`` on ends."""
    wanted = 0
    for k in range(begin, len(here)):
        wanted += here[k][1] == ranks[wanted]
        if wanted == len(ranks):
            return k
    return None


def _slotted(tokens: list, template: dict, around: dict, known: dict | None = None) -> Iterator[tuple[tuple[int | None, int | None], bool, str] | None]:
    """Slot, whether in an article or main element, and text of what a page holds beside
    its template's tokens, in page order; None where a block begins or ends. A slot is
    the class and rank of the last template token before, None where there is none."""
    places = in_place(tokens_coded(tokens, known), template, around) if template else {}
    at: tuple[int | None, int | None] = (None, None)
    number = 0
    for kind, value, path, marked in tokens:
        if kind == "tag":
            if not marked:
                at, number = places.get(number, at), number + 1
            if value.lstrip("/") in BLOCK:
                yield None
        elif marked:
            continue
        elif not _OWN.isdisjoint(path.split("/")):
            yield at, True, value
        elif not places:
            yield at, False, value
        else:
            for part in _RUNS.findall(value):
                if part.isspace():
                    yield at, False, part
                    continue
                if number in places:
                    at = places[number]
                else:
                    yield at, False, part
                number += 1


def slots(page: str, template: dict[int, tuple[int, int]], around: dict[int, tuple[int, int]] | None = None) -> list[tuple[int | None, int | None, str]]:
    """(class, gap, text) of what a page holds beside its template's tokens, in page
    order. ``template`` gives each token's class and rank, ``around`` the class around a
    class and the gap there."""
    out: list[tuple[tuple[int | None, int | None], list[str]]] = []
    for found in _slotted(list(tokens_of(page)), template, around or {}):
        if found is None:
            if out:
                out[-1][1].append(" ")
        elif out and out[-1][0] == found[0]:
            out[-1][1].append(found[2])
        elif not found[2].isspace():
            out.append((found[0], [found[2]]))
    return [(*at, " ".join(_text("".join(parts)).split())) for at, parts in out]


def extract(page: str, template: dict[int, tuple[int, int]] | None = None, around: dict[int, tuple[int, int]] | None = None, known: dict | None = None) -> str:
    """Main text of one page: of the slots that its host's template leaves."""
    tokens = list(tokens_of(page))
    # A page that is template throughout has no slots to tell from it.
    return _extract(tokens, template or {}, around or {}, known) or _extract(tokens, {}, {})


def _extract(tokens: list, template: dict, around: dict, known: dict | None = None) -> str:
    inside = _has_article(tokens)
    blocks, now = [], []

    def close() -> None:
        text = _SPACE.sub(" ", _text("".join(now))).strip()
        if text:
            blocks.append(text)
        now.clear()

    for found in _slotted(tokens, template, around, known):
        if found is None:
            close()
        elif found[1] or not inside:
            now.append(found[2])
    close()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text`` for each row of ``pages``.

    The text is that of the slots which the host's template leaves in an article or
    main element if the page has one, else in the body: blocks in page order joined by a newline, white space inside a block
    made one space, character references decoded. Null and empty html give an
    empty text; html of any length is read whole. A null url, or one without a host, belongs to the host ``""``.
    Rows that repeat a page are pages of their own. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = pages.select(
        F.col(key).alias("_key"),
        F.col(url).alias("_url"),
        F.coalesce(F.regexp_extract(F.lower(F.col(url).cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")).alias("host"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    )
    found = materialize(template_tokens(rows.withColumn("row", F.xxhash64("html"))), "templates")
    parts = ["token", "class", "rank", "parent", "gap"]
    templates = found.groupBy("host").agg(F.collect_list(F.struct("token", "class", F.col("rank").cast("long").alias("rank"), F.coalesce("parent", F.lit(0)).alias("parent"), F.coalesce("gap", F.lit(-1)).cast("long").alias("gap"))).alias("t"))
    templates = templates.select("host", *(F.col(f"t.{p}").alias(p) for p in parts))
    if found.count() <= BROADCAST_TOKENS:  # forty bytes a token and the hosts' names
        templates = F.broadcast(templates)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    whole = ("bigint", "int", "smallint", "tinyint")
    joined = rows.join(templates, "host", "left").select(F.col("_key").cast("string") if kinds["_key"] in whole else F.col("_key"), "_url", "host", "html", *parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[dict, dict]] = {}
        known: dict = {}
        for batch in batches:
            texts = []
            for host, page, *template in zip(batch["host"], batch["html"], *(batch[p] for p in parts)):
                if host not in held:
                    if len(held) > 1000:
                        held.clear()
                    columns = [() if template[0] is None else np.asarray(x).tolist() for x in template]
                    token, name, rank, parent, gap = columns
                    held[host] = dict(zip(token, zip(name, rank))), {c: (p, g) for c, p, g in zip(name, parent, gap) if g >= 0}
                if len(known) > HELD_TOKENS:
                    known.clear()
                texts.append(extract(page, *held[host], known))
            yield pd.DataFrame({"_key": batch["_key"], "_url": batch["_url"], "text": texts})

    out = joined.mapInPandas(run, f"_key {'string' if kinds['_key'] in whole else kinds['_key']}, _url {kinds['_url']}, text string")
    return out.select(F.col("_key").cast(kinds["_key"]).alias(key), F.col("_url").alias(url), "text")
