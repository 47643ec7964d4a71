"""Main text of web pages by template deduction over pages of the same host.

Tokens of a page are its tags, told apart by their path, and its runs of text. Tokens
of a group of pages with the same vector of occurrences form an equivalence class;
a class is valid if enough pages hold it and its tokens keep one order on each of them.
Valid classes make up the template of the group, and what it leaves open are the slots. Slots in
menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and
styles are dropped, and so is what the template holds; of the rest, the main text is the
article where that has most of it, and else all.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize, small_batches
from .urlfilter import host_path

#: Pages of a group and characters of their html on average.
GROUP_PAGES, GROUP_CHARS = 64, 4_000_000
#: At most so many hosts hold more than this share of all pages, and as many that share of all characters: they are sent to every executor.
LARGE_HOSTS = 100_000
#: Distinct pages from which on a group's template tells text of the site from text of the page.
MIN_SUPPORT = 4
#: Share of a group's pages that hold a class of its template: groups mix types of pages, and some pages are odd.
MIN_SHARE = 0.25
#: Share of pages from which on a text of the template is dropped inside an article too; a line that only some articles repeat is their own.
ARTICLE_SHARE = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|math|object|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|[^<]+|<",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Fixed lists of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("nav footer aside form head menu button select label input dialog audio video canvas map figure".split()) - {"figure"}
#: Elements that end an open paragraph.
CLOSES_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend", "summary", "body", "html", "head", "title"}
#: Fixed list of words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner banners promo promotion sponsor sponsored sidebar rail menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar footer bottom notice notices cookie cookies consent gdpr alert disclaimer newsletter subscribe subscription signup login comment comments commentlist discussion disqus respond replies reply reviews social share sharing related recommended recommendations widget popup modal overlay pagination pager tags copyright search contentinfo complementary".split()
)
ARTICLE_MARKS = frozenset(("article", "main", "post", "content", "entry", "story", "body"))


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def _is_dropped(name: str, attrs: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if key in ("class", "id", "role"):
            words = _words(value)
            if not MARKS.isdisjoint(words) and not ({"article", "post", "story", "entry"} & set(words) and {"body", "content", "text"} & set(words)):
                return True
            if "header" in words and not in_article and not {"article", "post", "entry"} & set(words):
                return True
    return False


class Page:
    """Blocks of text of one page outside dropped regions, with the path of each and whether it
    lies in an article; and the tokens of the page in order."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, str, bool]] = []
        self.tokens: list[str] = []
        stack: list[tuple[str, bool, bool]] = []  # name, dropped, article
        paths = [""]
        text: list[str] = []

        def flush() -> None:
            t = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if t:
                self.blocks.append((t, paths[-1], bool(stack) and stack[-1][2]))
                self.tokens.append(f"{paths[-1]} {t}")

        def pop(i: int) -> None:
            while len(stack) > i:
                flush()
                self.tokens.append(f"{paths[-1]}/")
                stack.pop()
                paths.pop()

        for m in TOKEN.finditer(source):
            t = m[0]
            name = m["name"]
            if name is None:
                if stack and stack[-1][1]:
                    continue
                if t[0] != "<":
                    text.append(t)
                elif t == "<":
                    text.append("&lt;")
                elif t.startswith("<![CDATA["):
                    text.append(entities.escape(t[9:].removesuffix("]]>")))
                continue
            name = name.lower()
            if m["close"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        # A stray end of an inline element does not close the blocks around it.
                        if name in BLOCK or all(s[0] not in BLOCK for s in stack[i:]):
                            if name in BLOCK:
                                flush()
                                pop(i)
                            else:
                                del stack[i:], paths[i + 1 :]
                        break
                else:
                    if name in BLOCK:
                        flush()
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in BLOCK:
                flush()
                if name in CLOSES_P:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            pop(i)
                            break
                        if stack[i][0] in BLOCK:
                            break
                if name in ("li", "dt", "dd", "td", "th", "tr", "option"):
                    around = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}[name]
                    alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in alike:
                            pop(i)
                            break
                        if stack[i][0] in around:
                            break
            if name in VOID or m["attrs"].rstrip().endswith("/") and name not in BLOCK:
                self.tokens.append(f"{paths[-1]}<{name}")
                continue
            up_dropped, up_article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            dropped = up_dropped or _is_dropped(name, m["attrs"], up_article)
            article = up_article or name in ("article", "main") or 'role="main"' in m["attrs"]
            stack.append((name, dropped, article and not dropped))
            if name in BLOCK:
                cls = next((x[2] or x[3] or x[4] or "" for x in ATTR.finditer(m["attrs"]) if x[1].lower() in ("class", "id")), "")
                paths.append(f"{paths[-1]}<{name}" + (f".{cls}" if cls else ""))
                self.tokens.append(paths[-1])
            else:
                paths.append(paths[-1])
        flush()
        pop(0)


def deduce_template(pages: list[Page]) -> tuple[dict[str, int], dict[str, float]]:
    """Template of a group of distinct pages: the class of each token of the template, and those
    texts among them (in a group of ``MIN_SUPPORT`` pages or more) with the share of pages that hold each.

    A class is the set of tokens with one vector of occurrences, zeros included. It is valid
    if at least ``MIN_SHARE`` of the pages, and ``MIN_SUPPORT``, hold it (all pages of a smaller
    group) and its tokens keep one order there: on each page that holds it, the sequence of
    the class's tokens is the same pattern, repeated.
    """
    if len(pages) < 2:
        return {}, {}
    support = max(min(MIN_SUPPORT, len(pages)), math.ceil(MIN_SHARE * len(pages)))
    vectors: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, p in enumerate(pages):
        for t, n in Counter(p.tokens).items():
            vectors[t].append((i, n))
    classes: dict[tuple, list[str]] = defaultdict(list)
    for t, v in vectors.items():
        if len(v) >= support:
            classes[tuple(v)].append(t)
    template: dict[str, int] = {}
    member = {t: k for k, ts in enumerate(classes.values()) for t in ts}
    order: dict[int, list[tuple]] = {k: [] for k in range(len(classes))}
    for p in pages:
        runs: dict[int, list[str]] = defaultdict(list)
        for t in p.tokens:
            if (k := member.get(t)) is not None:
                runs[k].append(t)
        for k, run in runs.items():
            order[k].append(tuple(run))
    for k, ts in enumerate(classes.values()):
        width = len(ts)
        pattern = order[k][0][:width]
        if len(set(pattern)) == width and all(run == pattern * (len(run) // width) for run in order[k]):
            template.update(dict.fromkeys(ts, k))
    if len(pages) < MIN_SUPPORT:
        return template, {}
    return template, {t: len(vectors[t]) / len(pages) for t in template if " " in t}


def main_text(page: Page, fixed: dict[str, float]) -> str:
    """The blocks which the template does not hold: those of the article, if they have at least as
    many characters as those around it (else the articles are teasers), or all outside dropped
    regions. An article that the template holds whole stays, as its pages are copies."""
    own = [(t, article) for t, path, article in page.blocks if fixed.get(f"{path} {t}", 0) < (ARTICLE_SHARE if article else MIN_SHARE)]
    inside = [t for t, article in own if article] or [t for t, _, article in page.blocks if article]
    around = [t for t, article in own if not article]
    if inside and sum(map(len, inside)) >= sum(map(len, around)):
        return "\n".join(inside)
    return "\n".join(t for t, _ in own)


def extract_group(sources: list[str | None]) -> list[tuple[str, int]]:
    """Main text and number of template tokens of each page of a group."""
    pages = {s: Page(s) for s in dict.fromkeys(s for s in sources if s)}
    template, fixed = deduce_template(list(pages.values()))
    out = {s: (main_text(p, fixed), sum(t in template for t in p.tokens)) for s, p in pages.items()}
    return [out[s] if s else ("", 0) for s in sources]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_template_tokens), one row per row of ``pages`` (page_id, url, html).

    Pages are grouped by host. A host with more than a ``LARGE_HOSTS``-th of all pages
    or characters (and more than a group's) is dealt by a hash of page_id into groups of
    some ``GROUP_PAGES`` pages and ``GROUP_CHARS`` characters before the shuffle; others
    are cut the same way where they arrive, so no host is gathered whole and no group is
    large. Null or empty html gives an empty text; a null url counts as a host of its
    own; repeated pages count once in a template; hosts with few pages are read by their
    markup alone; an empty table stays empty.
    """
    small_batches(pages.sparkSession)
    host = host_path(F.col("url"))[0]
    p = pages.select(F.col("page_id").cast("string"), "url", "html", host.alias("host"))
    counts = p.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("html", F.lit("")))).alias("chars"))
    counts = materialize(counts)
    all_pages, all_chars = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    large = counts.where((F.col("n") > max(GROUP_PAGES, all_pages // LARGE_HOSTS)) | (F.col("chars") > max(GROUP_CHARS, all_chars // LARGE_HOSTS)))
    large = large.select("host", F.ceil(F.greatest(F.col("n") / GROUP_PAGES, F.col("chars") / GROUP_CHARS)).cast("long").alias("n_groups"))
    salt = F.pmod(F.xxhash64("page_id", F.lit(3)), F.coalesce("n_groups", F.lit(1).cast("long")))
    # Two times LARGE_HOSTS rows at most, by the choice of the bounds.
    p = p.join(F.broadcast(large), "host", "left").withColumn("salt", salt).withColumn("order", F.xxhash64("page_id")).select("host", "salt", "order", "page_id", "url", "html")

    def extract(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable")
        sources = [h if isinstance(h, str) else None for h in pdf.html]
        got: list[tuple[str, int]] = []
        for part in _cut(sources):
            got += extract_group(part)
        return pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": [t for t, _ in got], "n_template_tokens": [k for _, k in got]})

    out = p.groupBy("host", "salt").applyInPandas(extract, "page_id string, url string, text string, n_template_tokens bigint")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def _cut(sources: list[str | None]) -> list[list[str | None]]:
    """Parts of even size of at most some ``GROUP_PAGES`` pages and ``GROUP_CHARS`` characters on average."""
    n = max(1, -(-len(sources) // (2 * GROUP_PAGES)), -(-sum(len(s or "") for s in sources) // (2 * GROUP_CHARS)))
    size = -(-len(sources) // n) or 1
    return [sources[i : i + size] for i in range(0, len(sources), size)]
