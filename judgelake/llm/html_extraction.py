"""HTML extraction by equivalence classes of template tokens.

Tokens are tags (with class and id) and comments (by their first word), each told apart by the container elements it is in,
so that an article inside the comments is another token than the article itself. Tokens with the same occurrence vector
over the pages of a host form an equivalence class; classes of tokens that occur once in each of many pages are
candidates for the host's template. A token is valid if it is ordered, that is always at one place among its own class, and
nested, that is always in one gap of each class that covers more pages. The template is the tree of valid elements, and
the slots between tokens hold what pages say. Menus, adverts and footers may vary as much as articles do, so what counts is
where the text is: the innermost element of the template that holds REGION of the host's text outside links is the article's
region, and elements of its kind beside it go on with the article where their text varies and is mostly in paragraphs. Slots outside it are left out, and slots inside it whose text never varies are part of the template, unless the region
is an article (or main) element, which says itself that it is no template. What pages of
the region mark themselves as navigation, forms, scripts and the like (by tags and roles; by class names only for
containers) is left out of it too.

Vectors are compared by sums of hashes that each page adds to on its own, so no vector is ever gathered.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: A class belongs to a template if it covers so many of the host's pages.
SUPPORT = 0.5
#: Hosts with fewer pages use the template of all pages: one page does not tell what varies.
LEAST_PAGES = 2
#: The article's region holds so much of the text outside links.
REGION = 0.6
#: A slot whose text never varies is part of the template if so many pages have it: the fewest on which text can vary.
LEAST_FIXED = 2
#: An element beside the region is part of the article if so much of its text outside links is in paragraphs and the like.
PROSE_SHARE = 0.5
#: Templates of so many characters are sent to every executor; beyond that they are joined by shuffle.
BROADCAST_CHARS = 32_000_000

# Elements and names of classes and ids.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp")
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", *RAW}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
#: Containers whose class or id may tell that they are no part of an article, and the names that do.
NAMED = {"div", "section", "ul", "ol", "dl", "table", "article", "figure", "details"}
NAMES_OUT = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|user|reader|post|entry|article)[-_])?"
    r"(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|"
    r"masthead|cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"comments?|respond|replies|disqus|widget|toolbar|pagination|pager)"
    r"(?:[-_](?:list|section|area|box|wrapper|container|block|bar|banner|slot|unit|links|posts|form|thread|notice|widget|menu|buttons?))?"
)
CONTAINERS = {"html", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table"}
BLOCKS = {
    "address", "article", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figure", "h1", "h2", "h3", "h4", "h5",
    "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dd", "dt", "td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MAIN = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.DOTALL)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.IGNORECASE)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_SPACE = re.compile(r"\s+")
_MODULUS = (1 << 61) - 1


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def tokens(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, name, signature, start, end) of tags and comments; the content of raw elements holds none."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            return
        text, at = m[0], m.end()
        if text.startswith("<!--"):
            yield "comment", "", "<!--" + (text[4:].split() or [""])[0], m.start(), at
        elif text[1] in "!?":
            yield "other", "", text[:2], m.start(), at
        else:
            name = _NAME.match(text)[1].lower()
            if text[1] == "/":
                yield "close", name, f"</{name}>", m.start(), at
                continue
            given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(text)} if " " in text or "\n" in text or "\t" in text else {}
            marks = " ".join(f"{k}={given[k]}" for k in ("class", "id", "role") if given.get(k))
            hidden = "hidden" in given or given.get("aria-hidden") == "true"
            yield "hidden" if hidden else "open", name, f"<{name} {marks}>" if marks else f"<{name}>", m.start(), at
            if name in RAW and not text.endswith("/>"):
                close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
                if close:
                    yield "close", name, f"</{name}>", close.start(), close.end()
                    at = close.end()
                else:
                    at = end


def _left_out(kind: str, name: str, signature: str) -> bool:
    if kind == "hidden" or name in LEFT_OUT:
        return True
    role = re.search(r"role=([^=>]*)>", signature)
    if role and role[1].lower() in ROLES_OUT:
        return True
    names = re.findall(r"(?:class|id)=([^=>]*?)(?= (?:id|role)=|>)", signature) if name in NAMED else ()
    return any(NAMES_OUT.fullmatch(n) for given in names for n in given.lower().split())


class Page:
    """A page's tokens with their roles (signature and the containers around it), the place behind each element, and how many
    characters of text outside links, and of those in paragraphs and the like, are before each token."""

    def __init__(self, page: str) -> None:
        self.page, self.found = page, list(tokens(page))
        self.roles: list[str] = []
        self.ends = [len(self.found)] * len(self.found)
        self.chars, self.prose = [0], [0]
        block = ""
        stack: list[tuple[str, int, int]] = []
        path, links, raw, at = [""], 0, False, 0
        for k, (kind, name, signature, start, end) in enumerate(self.found):
            said = 0 if raw or links or start <= at else len(page[at:start].strip())
            self.chars.append(self.chars[-1] + said)
            self.prose.append(self.prose[-1] + said * (block in PROSE))
            block = block if name not in BLOCKS else "" if kind == "close" else name
            at, raw = end, kind in ("open", "hidden") and name in RAW
            if kind == "close":
                for back in range(len(stack) - 1, -1, -1):
                    if stack[back][0] == name:
                        for _, place, _ in stack[back:]:
                            self.ends[place] = k
                        del path[stack[back][2] :], stack[back:]
                        break
                links = max(0, links - (name == "a"))
                self.roles.append(f"{path[-1]} {signature}")
                continue
            self.roles.append(f"{path[-1]} {signature}")
            if kind in ("open", "hidden") and name not in VOID:
                links += name == "a"
                if name in CONTAINERS or name in RAW:
                    stack.append((name, k, len(path)))
                    path.append(f"{path[-1]}/{name}")
        self.chars.append(self.chars[-1] + (0 if raw or links else len(page[at:].strip())))

    def slots(self, template: set[str]) -> tuple[list[str], dict[str, str]]:
        """For each token, and for the page's end, the slot before it, and each slot's text. A slot is named by the template
        tokens around it; the page begins with the token <page>."""
        texts: list[str] = []
        before: list[int] = []
        bounds = ["<page>"]
        held: list[str] = []
        at, raw = 0, False
        for (kind, name, _, start, end), role in zip(self.found, self.roles, strict=True):
            if start > at and not raw:
                held.append(self.page[at:start])
            before.append(len(texts))
            raw = kind in ("open", "hidden") and name in RAW
            at = end
            if role in template:
                texts.append(_plain(held))
                held = []
                bounds.append(role)
        before.append(len(texts))
        texts.append(_plain([*held, self.page[at:]]))
        names = [f"{a}\n{b}" for a, b in zip(bounds, [*bounds[1:], "</page>"], strict=True)]
        return [names[k] for k in before], dict(zip(names, texts, strict=True))


def _plain(parts: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape(" ".join(parts))).strip()


class Template(NamedTuple):
    """A host's valid tokens, its slots that never vary, the element that bounds the article ('' for the whole page), and the elements
    beside it that go on with the article."""

    tokens: frozenset[str] = frozenset()
    fixed: frozenset[str] = frozenset()
    region: str = ""
    beside: frozenset[str] = frozenset()


def _bounds(page: Page, template: Template | None) -> list[tuple[int, int]]:
    """Between which tokens the article is: in the template's region and beside it, or without a template in what the page calls its
    article."""
    if template is not None and not template.region:
        return [(-1, len(page.found))]
    if template is not None and template.region in page.roles:
        return [(k, page.ends[k]) for k, role in enumerate(page.roles) if role == template.region or role in template.beside and not _left_out(*page.found[k][:3])]
    at = -1
    if template is None:
        at = next((k for m in MAIN for k, (kind, name, *_) in enumerate(page.found) if kind == "open" and name == m), -1)
    return [(at, page.ends[at] if at >= 0 else len(page.found))]


def extract(text: str, template: Template | None) -> str:
    """The article's blocks, joined by newlines: the template's region without the slots that never vary, and what it marks as
    no article. An empty template has no region, so it leaves the whole page but for scripts and the like. None stands for no
    template: then the page's own article or main element counts."""
    page = Page(text)
    marked = template is None or bool(template.region)
    bounds = _bounds(page, template)
    dropped = [False] * (len(page.found) + 1)
    if template is not None and template.fixed and (bounds[0][0] < 0 or page.found[bounds[0][0]][1] not in MAIN):
        names, texts = page.slots(set(template.tokens))
        inside = {n for first, last in bounds for n in names[first + 1 : last + 1] if texts[n]}
        if not inside <= template.fixed:  # a page of nothing but fixed slots shows no article, so it stays whole
            dropped = [n in template.fixed for n in names]
    blocks: list[str] = []
    held: list[str] = []
    skip = -1

    def close_block() -> None:
        said = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if said:
            blocks.append(said)

    for first, last in bounds:
        for k in range(first + 1, last + 1):
            at = page.found[k - 1][4] if k else 0
            ended = k == len(page.found)
            start = len(text) if ended else page.found[k][3]
            if k > skip and not dropped[k] and start > at and not (k and page.found[k - 1][0] in ("open", "hidden") and page.found[k - 1][1] in RAW):
                said = text[at:start]
                held.append(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", said) if ended else said)  # a tag cut off at the end is no text
            if ended or k == last:
                break
            kind, name, signature, _, _ = page.found[k]
            if k <= skip or kind in ("comment", "other"):
                continue
            if kind != "close" and name not in VOID and (_left_out(kind, name, signature) if marked else name in RAW or name == "head"):
                close_block()
                skip = page.ends[k] if name in CONTAINERS or name in RAW else _matching(page.found, k, last)
            elif name in BLOCKS:
                close_block()
            elif name == "br":
                held.append(" ")
        close_block()
    return "\n".join(blocks)


def _matching(found: list[tuple[str, str, str, int, int]], at: int, last: int) -> int:
    """The close of an element, or else the last place."""
    depth = 0
    for k in range(at, last):
        kind, name = found[k][:2]
        if name == found[at][1]:
            depth += -1 if kind == "close" else kind in ("open", "hidden")
            if depth == 0:
                return k
    return last


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _beside(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with the other columns of found (host, ...) of their host, or else nulls; template is the host, or else '*'."""
    hosts = found.where("host <> '*'").withColumnRenamed("host", "own")
    chars = hosts.agg(F.sum(F.length(F.to_json(F.struct(*hosts.columns))))).first()[0] or 0
    side = F.broadcast(hosts) if chars <= BROADCAST_CHARS else hosts.hint("merge")
    return _rows(pages).join(side, _host() == F.col("own"), "left").withColumn("template", F.coalesce("own", F.lit("*")))


def _sign(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 2


def _measures(page: Page, classes: list[list[str]]) -> Iterator[tuple[str, str, str, int]]:
    """(kind, a, b, value): between which tokens of its own class and of each one that covers more pages a token lies; the
    characters outside links in the page and in each element of the classes, those of them in paragraphs, and a hash of what the
    element holds; and each slot's text as a hash."""
    place: dict[str, int] = {"<page>": -1}
    for k, role in enumerate(page.roles):
        place.setdefault(role, k)
    own: list[tuple[int, list[int]]] = []
    for k, names in enumerate(classes):
        at = sorted(place[t] for t in names if t in place)
        if at:
            own.append((k, at))
            for token in names:
                if token in place:
                    for over, places in own:
                        yield "gap", token, f"{over} {k}", bisect_left(places, place[token])
    yield "region", "<page>", "", page.chars[-1]
    for names in classes:
        for token in names:
            k = place.get(token, -1)
            if k >= 0 and page.found[k][0] == "open" and page.found[k][1] in CONTAINERS:
                end = min(page.ends[k] + 1, len(page.chars) - 1)
                yield "region", token, "", page.chars[end] - page.chars[k + 1]
                yield "prose", token, "", page.prose[min(end, len(page.prose) - 1)] - page.prose[k + 1]
                yield "said", token, "", _sign(page.page[page.found[k][4] : page.found[page.ends[k]][3] if page.ends[k] < len(page.found) else None])
    for slot, text in page.slots({t for names in classes for t in names})[1].items():
        if text:
            yield "slot", slot, "", _sign(text)


def templates(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES, least_fixed: int = LEAST_FIXED) -> DataFrame:
    """(host, tokens, fixed, region): the valid tokens, by class and order, of each host that has enough pages and, as host '*',
    of all pages; the slots whose text never varies on `least_fixed` pages or more that are not all equal; and the innermost
    valid element with REGION of the text outside links ('' if there is none). A class is a candidate if its tokens occur
    once in each page that has them and it covers `support` of the pages; its tokens then share one occurrence vector."""
    found = written(_classes(pages, support, least_pages), "classes")
    rest = found.where("host = '*'").first()
    common = list(rest["classes"]) if rest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for template, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                sign = _sign(text)
                for kind, a, b, value in _measures(Page(text), own or common):
                    held = seen.setdefault((template, kind, a, b), [0, value, value, 0, sign, sign])
                    held[:] = held[0] + 1, min(held[1], value), max(held[2], value), held[3] + (value if kind in ("region", "prose") else 0), min(held[4], sign), max(held[5], sign)
            keys = list(zip(*seen, strict=True)) or [()] * 4
            values = list(zip(*seen.values(), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.string()) for v in keys), *(pa.array(v, pa.int64()) for v in values)], ["template", "kind", "a", "b", "pages", "low", "high", "total", "one", "other"])

    schema = "template string, kind string, a string, b string, pages long, low long, high long, total long, one long, other long"
    partial = _beside(pages, found).select("template", "html", "classes").mapInArrow(run, schema)
    sums = written(partial.groupBy("template", "kind", "a", "b").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.min("one").alias("one"), F.max("other").alias("other")), "measures")
    number = F.split("b", " ")
    gaps = sums.where("kind = 'gap'").withColumn("over", number[0].cast("int")).withColumn("k", number[1].cast("int"))
    valid = gaps.groupBy("template", F.col("a").alias("token")).agg(F.bool_and(F.col("low") == F.col("high")).alias("valid"), F.max("k").alias("k"), F.max(F.when(F.col("over") == F.col("k"), F.col("low"))).alias("gap")).where("valid")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("k", "gap", "token"))), lambda x: x["token"])
    out = valid.groupBy("template").agg(in_order.alias("tokens"))
    regions = sums.where("kind = 'region'").select("template", F.col("a").alias("token"), "total")
    whole = regions.where("token = '<page>'").select("template", F.col("total").alias("all_chars"))
    holding = regions.join(valid.select("template", "token", "k", "gap"), ["template", "token"]).join(whole, "template").where((F.col("total") > 0) & (F.col("total") >= F.col("all_chars") * REGION))
    region = holding.groupBy("template").agg(F.min_by("token", F.struct("total", -F.length("token"), "token")).alias("region"))
    kind_of = lambda token: F.regexp_extract(token, r"^[^ ]* <[^ >]*", 0)  # noqa: E731  the containers around it and its name
    prose = sums.where("kind = 'prose'").select("template", F.col("a").alias("token"), F.col("total").alias("prose"))
    varying = sums.where("kind = 'said' and low < high").select("template", F.col("a").alias("token"))
    beside = regions.where("total > 0").join(varying, ["template", "token"]).join(prose, ["template", "token"]).join(valid.select("template", "token"), ["template", "token"]).join(region, "template").where(
        (F.col("token") != F.col("region")) & (kind_of("token") == kind_of("region")) & (F.col("prose") >= F.col("total") * PROSE_SHARE)
    ).groupBy("template").agg(F.array_sort(F.collect_list("token")).alias("beside"))  # some of the template's tokens
    same = sums.where((F.col("kind") == "slot") & (F.col("low") == F.col("high")) & (F.col("pages") >= least_fixed) & (F.col("one") < F.col("other")))
    fixed = same.groupBy("template").agg(F.collect_list("a").alias("fixed"))
    candidates = found.select(F.col("host").alias("template"), F.flatten("classes").alias("cut"))
    return out.join(fixed, "template", "left").join(region, "template", "left").join(beside, "template", "left").join(candidates, "template").select(
        F.col("template").alias("host"), "tokens", "cut", F.coalesce("fixed", F.array().cast("array<string>")).alias("fixed"), F.coalesce("region", F.lit("")).alias("region"),
        F.coalesce("beside", F.array().cast("array<string>")).alias("beside"),
    )


def _classes(pages: DataFrame, support: float, least_pages: int) -> DataFrame:
    """(host, classes): the tokens of the candidate classes, those that cover most pages first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A page adds its hash to the vector of each of its tokens, here and later in Spark.
            seen: dict[tuple[str, str], list[int]] = {}
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sign = _sign(f"{page_id}\n{url}")
                counts = Counter(Page(page or "").roles)
                counts["<page>"] = 1
                for host in (host_of(url), "*"):
                    for role, n in counts.items():
                        own = seen.setdefault((host, role), [0, 0, 0])
                        own[0] += 1
                        own[1] += n == 1
                        own[2] = (own[2] + (sign if n == 1 else sign * n * 31)) % _MODULUS
            keys = list(zip(*seen, strict=True)) or [(), ()]
            values = list(zip(*seen.values(), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), *(pa.array(v, pa.int64()) for v in values)], ["host", "token", "pages", "single", "vector"])

    partial = _rows(pages).mapInArrow(run, "host string, token string, pages long, single long, vector long")
    vector = (F.sum(F.col("vector").cast("decimal(38,0)")) % F.lit(_MODULUS).cast("decimal(38,0)")).cast("long")
    counts = written(partial.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("single").alias("single"), vector.alias("vector")), "tokens")
    size = counts.where("token = '<page>'").select("host", F.col("pages").alias("all_pages"))
    valid = counts.join(size, "host").where((F.col("single") == F.col("pages")) & (F.col("pages") >= F.col("all_pages") * support) & ((F.col("all_pages") >= least_pages) | (F.col("host") == "*")))
    classes = valid.groupBy("host", "vector").agg(F.max("pages").alias("pages"), F.collect_list("token").alias("tokens")).where(F.size("tokens") > 1)
    largest = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("n"), F.array_sort("tokens").alias("tokens"))))
    return classes.groupBy("host").agg(F.transform(largest, lambda x: x["tokens"]).alias("classes"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html; other columns are ignored): page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text; pages without a host belong to host ''; hosts with too few pages use
    the template of all pages, and where that has none either, what a page calls its article counts. Repeated rows are
    extracted each. An empty table gives no rows.
    """
    found = written(templates(pages), "templates")
    rest = found.where("host = '*'").first()
    common = Template(frozenset(rest["cut"]), frozenset(rest["fixed"]), rest["region"], frozenset(rest["beside"])) if rest and rest["region"] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, Template | None] = {}
            texts = []
            for text, host, cut, fixed, region, beside in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                if host is not None and host not in known:
                    known[host] = Template(frozenset(cut), frozenset(fixed), region, frozenset(beside)) if region else None
                texts.append(extract(text or "", common if host is None else known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = _beside(pages, found).select("page_id", "url", "html", "own", "cut", "fixed", "region", "beside")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
