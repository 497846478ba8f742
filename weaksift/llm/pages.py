"""Main text of web pages by template deduction from equivalence classes of tokens."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weaksift.llm.common import stage

MIN_PAGES = 4  # of a host, all different, to deduce a template from
TELLING = 30  # different pages that tell a template from the text that pages without marks share
OUTWEIGHS = 4  # times the text left, that a template deduced from fewer may hold
MIN_SHARE = 0.9  # of a host's pages that a class of the template occurs on
MIN_CLASS = 3  # tokens of a class
KIND_PAGES, KIND_SHARE = 8, 0.1  # of a host's pages that a class occurs on to make a page kind's template

# What the elements of HTML are.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
ASIDE = set("head nav footer aside form button select option input dialog menu svg math canvas object audio video".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond reply replies "
    "pagination pager widget hidden".split()
)
REMARKS = set("comment comments commentlist disqus respond reply replies ad ads advert advertisement sponsored promo related".split())
ABOUT = set("no has with without is not overflow".split())  # such names tell of an element elsewhere, or of none
PARTS = set(
    "left right top bottom main primary secondary wrap wrapper container inner outer box block slot unit area section bar list item items link links "
    "button buttons icon icons title text body content form panel".split()
)
ITEMS = set("bar list item items link links button buttons icon icons".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = set("base link meta title style script noscript template basefont bgsound noframes".split())
PAGE_ONLY = set("header".split())  # inside an article it holds the article's own heading
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"})}
CLOSES |= {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

# An attribute as browsers take it: a name may hold quotes, a value is quoted only right after the sign.
OPENS, ENDS = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[a-zA-Z][^\s>]*")
ATTRIBUTE, GIVEN, UNQUOTED = re.compile(r"[\s/]*[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
DEEP = 512  # characters of a path that are kept as they are
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z0-9]+")


class Marks:
    """The marks of a page, front to back: (begin, end, opening tag, its attributes, closing tag). Whatever is missing from
    some place on (a tag's end, a quote, a comment's end) is looked for once, so a page is read in linear time."""

    def __init__(self, page: str):
        self.page, self.end, self.missing = page, len(page), {}

    def _find(self, what: str, at: int) -> int:
        """Where ``what`` is next, or -1."""
        if at >= self.missing.get(what, self.end + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def _tag_end(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``, or -1. A quote that no other one closes is no quote."""
        page = self.page
        while True:
            name = ATTRIBUTE.match(page, at)
            if not name:
                return self._find(">", at) + 1 or -1
            given = GIVEN.match(page, name.end())
            at = given.end() if given else name.end()
            if given:
                quote = page[at : at + 1]
                stop = self._find(quote, at + 1) if quote in ("'", '"') else -1
                at = stop + 1 if stop >= 0 else UNQUOTED.match(page, at).end()

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        page = self.page
        while (at := self._find("<", at)) >= 0:
            after = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                stop = self._find("-->", at + 4)
                return at, self.end if stop < 0 else stop + 3, "", "", ""
            if name := OPENS.match(page, at + 1):
                stop = self._tag_end(name.end()) if self._find(">", at) >= 0 else -1
                if stop >= 0:
                    return at, stop, name[0], page[name.end() : stop - 1], ""
                self.missing["<"] = at  # no tag ends from here on: the rest is text
                return None
            if after in ("!", "?", "/") and after:
                stop = self._find(">", at)
                if stop >= 0:
                    name = ENDS.match(page, at + 2) if after == "/" else None
                    return at, stop + 1, "", "", name[0] if name else ""
            at += 1
        return None


def _names(value: str, names: set[str]) -> bool:
    """Whether a class or id has a name that is in ``names`` as a whole or by its last word. Numbers do not count, nor do
    words for parts of a layout behind a first word (ad-slot, sidebar-left), nor what a list is made of at the end (post-share-buttons)."""
    for one in value.split():
        words = [w for w in WORD.findall(one) if not w.isdigit()]
        while len(words) > 1 and words[-1] in ITEMS:
            words.pop()
        if words and not ABOUT.intersection(words) and (words[-1] in names or (words[0] in names and PARTS.issuperset(words[1:]))):
            return True
    return False


def _set_aside(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element and all in it is no part of an article's text: by its names, as a remark, or in any case ("always")."""
    if tag in ASIDE or (tag in PAGE_ONLY and not in_article):
        return "always"
    if not attributes or tag in ("html", "body"):
        return ""
    why = ""
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if tag in HEADINGS:
                continue
            if _names(value, REMARKS):
                why = "remark"
            elif tag not in ("article", "main") and _names(value, NAMES if in_article else NAMES | PAGE_ONLY):
                why = why or "names"
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "always"
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return "always"
    return why


def read_page(page: str) -> list[tuple[str, str | None, bool, bool]]:
    """The tokens of a page in order: (path, None, ..) where an element begins, (path, text, set aside, in article)
    for each block of text. Unclosed and stray tags are mended as a browser would, roughly.

    An element that holds an article or main is not set aside for its names; one named as remarks, which may be articles
    themselves, only if the page has no other.
    """
    holders: dict[int, str] = {}
    found = list(_read_page(page, holders, frozenset()))
    if holders:
        open_ = frozenset(at for at, why in holders.items() if why == "names")
        found = list(_read_page(page, {}, open_)) if open_ else found
        if len(open_) < len(holders) and not any(article and not aside for _, text, aside, article in found if text is not None):
            found = list(_read_page(page, {}, frozenset(holders)))
    return found


def _read_page(page: str, holders: dict[int, str], open_: frozenset[int]) -> Iterator[tuple[str, str | None, bool, bool]]:
    """The tokens of a page, the elements that begin at ``open_`` not set aside for their names. Those that are, and hold
    an article or main, are noted in ``holders``."""
    stack: list[tuple[str, bool, bool, str]] = [("", False, False, "")]  # tag, set aside, in article, path
    whys: list[tuple[int, str]] = [(0, "")]  # why, and where it begins, for each of the stack
    text: list[str] = []
    at, end, lowered, marks = 0, len(page), None, Marks(page)
    open_tags: Counter[str] = Counter()

    def close(top: int) -> None:
        open_tags.subtract(entry[0] for entry in stack[top:])
        del stack[top:]

    def block() -> Iterator[tuple[str, str | None, bool, bool]]:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                own = next(s for s in reversed(stack) if s[0] not in INLINE)
                yield own[3], joined, stack[-1][1], stack[-1][2]

    while at < end:
        found = marks.next(at)
        if stack[-1][0] == "head" and page[at : found[0] if found else end].strip():
            close(len(stack) - 1)  # text cannot stand in it
        if not found:
            text.append(page[at:])
            break
        begin, stop, opens, attributes, ends = found
        if begin > at:
            text.append(page[at:begin])
        at = stop
        if opens:
            tag = opens.lower()
            if stack[-1][0] == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            if tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
                continue
            if tag in VOID and tag in INLINE:
                continue
            if tag in RAW:  # its content is no mark-up and no text
                lowered = lowered if lowered is not None else page.lower()
                stop = lowered.find(f"</{tag}", at)
                at = end if stop < 0 else (lowered.find(">", stop) + 1 or end)
                continue
            if tag not in INLINE:
                yield from block()
                top = len(stack) - 1
                while stack[top][0] in INLINE:
                    top -= 1
                # A block ends an open paragraph, and what formats text in it.
                if stack[top][0] == "p" or stack[top][0] in CLOSES.get(tag, ((), ()))[0]:
                    close(top)
            _, aside, article, path = stack[-1]
            if tag not in INLINE:
                path = f"{path if len(path) <= DEEP else xxhash.xxh3_128_hexdigest(path)}/{tag}"
            if tag not in INLINE:
                yield path, None, aside, article
            if tag in VOID:
                continue
            del whys[len(stack) :]
            why = _set_aside(tag, attributes, article)
            why = "" if why != "always" and begin in open_ else why
            whys.append((begin, why))
            if aside and not why and tag in ("article", "main") and all(w != "always" for _, w in whys):
                holders.update((start, w) for start, w in whys if w)
            aside = aside or why != ""
            article = article or (not aside and (tag in ("article", "main") or "articlebody" in attributes.lower()))
            if aside and not stack[-1][1]:
                yield from block()
            stack.append((tag, aside, article, path))
            open_tags[tag] += 1
        elif ends:
            tag = ends.lower()
            for top in range(len(stack) - 1, 0, -1) if open_tags[tag] > 0 else ():
                if stack[top][0] == tag:
                    if tag not in INLINE or stack[top][1] != stack[top - 1][1]:
                        yield from block()
                    close(top)
                    break
                if tag in INLINE and stack[top][0] not in INLINE:
                    break
            else:
                if tag == "p":
                    yield from block()
    yield from block()


def _token(path: str, text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(path if text is None else f"{path}\n{text}") - (1 << 63)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key, page: the tokens of a page in order as bytes, and a digest of them. With a token goes the length of
    its text, doubled, plus 1 inside an article; elements and what is set aside have 0."""
    for batch in batches:
        keys, found = [], []
        for page in batch.column(1).to_pylist():
            seen = [(_token(path, text), 0 if text is None or aside else 2 * len(text) + article) for path, text, aside, article in read_page(page or "")]
            found.append(np.array(seen, np.int64).reshape(-1, 2).tobytes())
            keys.append(xxhash.xxh3_128_digest(found[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["host", "key", "page"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, token, pages, vector, first, last, chars, marked: how often, where and on which pages of a batch a token
    occurs, the length of its texts and whether it lies in an article. A vector of counts by page is told by the
    exclusive or of a hash for each page and count. Token 0 is the page."""
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, key, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            seen = np.frombuffer(page, np.int64).reshape(-1, 2).tolist()
            count: Counter[int] = Counter()
            first: dict[int, int] = {}
            last: dict[int, int] = {}
            size: Counter[int] = Counter()
            marked = set()
            for i, (token, told) in enumerate(seen):
                count[token] += 1
                first.setdefault(token, i)
                last[token] = i
                size[token] += told >> 1
                if told & 1:
                    marked.add(token)
            count[0], first[0], last[0], size[0] = 1, 0, len(seen), sum(size.values())
            for token, n in count.items():
                own = sums.setdefault((host, token), [0, 0, 0, 0, 0, False])
                own[0] += 1
                own[1] ^= xxhash.xxh3_64_intdigest(b"%b %d" % (key, n))
                own[2] += first[token]
                own[3] += last[token]
                own[4] += size[token]
                own[5] |= token in marked
        keys = list(sums)
        cols = list(zip(*sums.values())) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(cols[0], pa.int64()),
             pa.array(np.array(cols[1], dtype=np.uint64).view(np.int64)),
             pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.bool_())],
            names=["host", "token", "pages", "vector", "first", "last", "chars", "marked"],
        )


def _nesting(spans: list[tuple[float, float, int, int]]) -> set[int]:
    """Of classes (first, last, size, name) the names of those that nest. Wider classes come first; one that cuts across
    another goes."""
    kept: list[tuple[float, float]] = []
    names = set()
    for a, b, size, name in sorted(spans, key=lambda s: (s[0] - s[1], -s[2], s[3])):
        crosses = any(a < hi < b or a < lo < b for lo, hi in kept if not (lo <= a and b <= hi) and not (b <= lo or hi <= a))
        if size >= MIN_CLASS and not crosses:
            kept.append((a, b))
            names.add(name)
    return names


def _nest(tokens: pd.DataFrame) -> pd.DataFrame:
    """The texts of a host's template, in the classes that nest. What articles hold is no template, nor, on few pages, is
    anything if next to nothing would be left."""
    page = tokens[tokens["token"] == 0].iloc[0]
    few = page["pages"] < TELLING
    classes = {int(g["token"].min()): g for _, g in tokens.groupby(["pages", "vector"])}
    names = _nesting([(g["first"].min(), g["last"].max(), len(g), name) for name, g in classes.items()])
    texts = tokens[(tokens["token"] != 0) & (tokens["chars"] > 0) & ~tokens["marked"]]
    texts = texts[texts["token"].isin([t for name in names for t in classes[name]["token"]])]
    gone = texts["chars"].sum()
    if few and gone > OUTWEIGHS * (page["chars"] - gone):
        texts = texts[:0]
    return pd.DataFrame({"host": [tokens["host"].iloc[0]], "template": [sorted(texts["token"].tolist())]})


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, kind, other, pages, first, last, chars, all: where on the pages of a kind its class and others lie, the
    length of their texts and of the pages'. The input is host, page, listed (token, kind, low)."""
    known: dict[str, tuple[dict, set]] = {}
    for batch in batches:
        sums: dict[tuple[str, int, int], list] = {}
        for i, (host, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if host not in known:
                known = {} if len(known) > 64 else known
                listed = batch.column(2)[i].as_py()
                known[host] = {t["token"]: t["kind"] for t in listed}, {t["kind"] for t in listed if t["low"]}
            kinds, low = known[host]
            seen = np.frombuffer(page, np.int64).reshape(-1, 2).tolist()
            spans = {kinds[0]: [0, len(seen), 0]} if 0 in kinds else {}
            for at, (token, told) in enumerate(seen):
                if token in kinds:
                    own = spans.setdefault(kinds[token], [at, at, 0])
                    own[1] = max(own[1], at)
                    own[2] += told >> 1
            all_ = sum(told >> 1 for _, told in seen)
            for kind in low.intersection(spans):
                for other, (first, last, chars) in spans.items():
                    own = sums.setdefault((host, kind, other), [0] * 5)
                    for k, v in enumerate((1, first, last, chars, all_)):
                        own[k] += v
        cols = [*(list(zip(*sums)) or [()] * 3), *(list(zip(*sums.values())) or [()] * 5)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(cols)],
            names=["host", "kind", "other", "pages", "first", "last", "chars", "all"],
        )


def _valid(rows: pd.DataFrame) -> pd.DataFrame:
    """host, kind, valid: whether a kind's class nests with the classes that nearly all its pages have. On few pages it
    is not valid if it outweighs what they do not share."""
    own = rows[rows["kind"] == rows["other"]].iloc[0]
    rows = rows[rows["pages"] >= MIN_SHARE * own["pages"]]
    spans = [(r.first / r.pages, r.last / r.pages, int(r.size_), int(r.other)) for r in rows.rename(columns={"size": "size_"}).itertuples()]
    good = int(own["kind"]) in _nesting(spans)
    if own["pages"] < TELLING and own["chars"] > OUTWEIGHS * (own["all"] - rows["chars"].sum()):
        good = False
    return pd.DataFrame({"host": [own["host"]], "kind": [own["kind"]], "valid": [good]})


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """host, template: the tokens of each host's template, one row per host that has enough pages.

    Tokens (elements by path, blocks of text by path) with the same occurrence vector over a host's pages form a class.
    Large and frequent classes that nest in one another make up the template; so do large classes of part of the pages,
    a host's page kinds, that nest in those on their own pages. Pages of a host with the same tokens in the same order
    count once, so copies of a page make no template. A host's tokens are counted in parts and merged, so a host may
    have any number of pages; what is gathered per host is no more than the tokens that a tenth of its pages have.
    """
    found = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_sequences, "host string, key binary, page binary")
    found = found.groupBy("host", "key").agg(F.first("page").alias("page")).select("host", "key", "page")
    distinct = stage(found, "distinct-pages")
    found = distinct.mapInArrow(
        _occurrences, "host string, token long, pages long, vector long, first long, last long, chars long, marked boolean"
    )
    tokens = found.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"),
        F.bit_xor("vector").alias("vector"),
        (F.sum("first") / F.sum("pages")).alias("first"),
        (F.sum("last") / F.sum("pages")).alias("last"),
        F.sum("chars").alias("chars"),
        F.max("marked").alias("marked"),
    )
    tokens = stage(tokens.where(f"pages >= {MIN_PAGES}"), "tokens")
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("all"))
    frequent = F.col("pages") >= MIN_SHARE * F.col("all")
    kind = (F.col("pages") >= KIND_PAGES) & (F.col("pages") >= KIND_SHARE * F.col("all"))
    often = stage(tokens.join(hosts, "host").where(frequent | kind).withColumn("low", ~frequent).drop("all"), "often")
    whole = stage(often.where("not low").groupBy("host").applyInPandas(_nest, "host string, template array<long>"), "templates")

    same = ["host", "pages", "vector"]
    classes = often.groupBy(*same, "low").agg(F.count("*").alias("size"), F.min("token").alias("kind")).where(f"size >= {MIN_CLASS}")
    classes = stage(classes, "classes")
    hosts = classes.where("low").select("host").distinct()
    listed = often.drop("low").join(classes, same).join(hosts, "host", "left_semi")
    listed = stage(listed.groupBy("host").agg(F.collect_list(F.struct("token", "kind", "low")).alias("listed")), "listed")
    within = distinct.select("host", "page").join(listed, "host").mapInArrow(
        _within, "host string, kind long, other long, pages long, first long, last long, chars long, all long"
    )
    within = within.groupBy("host", "kind", "other").agg(*(F.sum(c).alias(c) for c in ("pages", "first", "last", "chars", "all")))
    within = within.join(classes.select("host", F.col("kind").alias("other"), "size"), ["host", "other"])
    valid = stage(within.groupBy("host", "kind").applyInPandas(_valid, "host string, kind long, valid boolean"), "kinds").where("valid")
    texts = often.drop("low").join(classes, same).join(valid, ["host", "kind"]).where("chars > 0 and not marked")
    kinds = texts.groupBy("host").agg(F.collect_list("token").alias("kinds"))
    none = F.array().cast("array<long>")
    both = F.concat("template", F.coalesce("kinds", none)).alias("template")
    return stage(whole.join(kinds, "host", "left").select("host", both), "all-templates")


def _story(seen: list[tuple], slots: list[tuple]) -> list[tuple]:
    """The slots in articles, or all if these are only cards beside the story: most text lies outside, and there are
    several articles or the longest block lies outside too."""
    inside, outside = ([len(b[1]) for b in slots if b[3] == where] for where in (True, False))
    several = sum(text is None and path.endswith("/article") and not aside and not article for path, text, aside, article in seen) > 1
    if not inside or (sum(outside) > sum(inside) and (several or max(outside) > max(inside))):
        return slots
    return [b for b in slots if b[3]]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[str, frozenset] = {}
    for batch in batches:
        texts = []
        templates_, hosts = batch.column(2), batch.column(3).to_pylist()
        for i, page in enumerate(batch.column(4).to_pylist()):
            if hosts[i] not in sets:
                sets = {} if len(sets) > 64 else sets
                sets[hosts[i]] = frozenset(templates_[i].as_py() or ())
            template = sets[hosts[i]]
            seen = read_page(page or "")
            blocks = [b for b in seen if b[1] is not None and not b[2]]
            slots = [b for b in blocks if b[3] or not template or _token(b[0], b[1]) not in template]
            texts.append("\n".join(b[1] for b in _story(seen, slots)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    What a host's template does not hold is data in its slots. Kept are the slots of the article (or main) element if
    the page has one that is more than a card beside the story, else of the whole page, without elements that hold menus, notices, adverts, forms, comments and
    the like. Null html is empty, null urls are a host of their own, repeated rows stay, hosts with few pages have no
    template, an empty table gives an empty result, other columns are ignored.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    joined = rows.join(templates(pages), "host", "left").select("page_id", "url", "template", "host", "html")
    return joined.mapInArrow(_extract, f"page_id {id_type}, url {url_type}, text string, n_chars long")
