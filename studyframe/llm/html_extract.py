"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes: an element's place is the path of tags and class
names above it. A node is important if its children come in many arrangements (presentation) or its texts differ
from page to page (content), measured by entropy over the pages that have the node; a node repeats its site's
frame if both are low. Pages of a host with the same article count as one, so copies are no frame. The branches of such nodes are cut from each page, along with elements whose role is no
article text on any page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.llm.bits import Filter
from studyframe.llm.common import join_groups, written

#: A node is judged if so many pages of its host have it, and cut below this importance.
LEAST_PAGES, CUT_BELOW = 8, 0.2
#: How fast the weight of a node's own arrangement grows with the number of arrangements.
DAMPING = 0.9
#: Characters of pages that a task parses before it passes them on, and pages whose nodes it counts at once.
HELD_CHARS, COUNTED_PAGES = 1_000_000, 1000

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg annotation annotation-xml select option button canvas audio video".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation annotation-xml".split())
INLINE = MATH | frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span object param strike strong sub sup time tt u var wbr".split())
NO_ARTICLE = frozenset("nav footer aside form head header dialog menu fieldset".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NO_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments respond replies cookie cookies consent gdpr notice popup modal newsletter subscribe signup "
    "menu nav navbar navigation footer sidebar side widget related recommended share sharing social sponsor sponsored promo promotion masthead pagination pager tags skip".split()
)
#: Names that tell a role as a part of any name outside of articles: acme-sidebar, footer-copyright. The others are words
#: of many meanings (share-price, ad-hoc) and count alone or beside COMPANIONS.
SURE_NAMES = frozenset(
    "advert adverts advertisement banner breadcrumb breadcrumbs cookie cookies consent gdpr popup modal newsletter subscribe signup nav navbar navigation footer sidebar widget "
    "sponsored masthead pagination pager".split()
)
COMPANIONS = frozenset(
    "site page main top bottom left right primary secondary global inner outer wrapper wrap container box block slot unit section area list bar links link items item form field "
    "buttons button icons icon post posts article articles story stories header content body col column row mobile desktop sticky fixed floating overlay policy text title heading "
    "count thread cloud to".split()
)
#: Parts of a name that speak of another element, or of none: has-sidebar, no-comments.
NO_ROLE = frozenset("has with without no not non is layout hide hidden".split())
#: Roles that are often most of a page's text.
TALK = frozenset("comment comments respond replies".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOP_AT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)?", re.S)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_XMP_END = re.compile(r"</xmp(?:\s[^>]*|/)?(?:>|\Z)", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def roles_of(called: str, article: bool = False) -> frozenset[str]:
    """The NO_ARTICLE_NAMES that class names and id consist of: sidebar, site-footer, but not has-sidebar or share-price.

    Outside of articles SURE_NAMES count as parts of other names too.
    """
    found: set[str] = set()
    for name in called.split():
        parts = {p for p in re.split("[-_]+", name) if p}
        if own := parts & NO_ARTICLE_NAMES:
            if parts <= NO_ARTICLE_NAMES | COMPANIONS:
                found |= own
            elif not article and NO_ROLE.isdisjoint(parts):
                found |= own & SURE_NAMES
    return frozenset(found)


class Page:
    """blocks: (path, in an article, text) in page order; styles: (path, arrangement of children) of every element.

    Elements are cut by tag, role or name. A name is no proof: one that would cut the article is passed over.
    """

    def __init__(self, source: str):
        spared: set[int] = set()
        while True:
            self._read(source, spared)
            if not (more := self._mistaken()):
                break
            spared |= more

    def _read(self, source: str, spared: set[int]) -> None:
        self.spared, self.opened = spared, 0
        #: Characters: outside of cut elements, of them in article elements, and by element that is cut by its name.
        self.chars, self.article_chars = 0, 0
        self.named: dict[int, list] = {}  # number: [characters, of them in article elements inside, whether TALK]
        self.named_at: list[tuple[int, int]] = []  # depth and number of the element that is cut by its name around here
        self.blocks: list[tuple[str, bool, str]] = []
        self.styles: list[tuple[str, str]] = []
        self.stack: list[tuple[str, str, bool, bool, list[str]]] = [("", "", False, False, [])]  # tag, path, cut, article, children
        self.text: list[str] = []
        at = 0
        while match := _TAG.search(source, at):
            self._chars(source[at : match.start()])
            at = max(match.end(), match.start() + 1)
            tag = (match[2] or "").lower()
            if not tag:
                continue
            if match[1]:
                self._close(tag)
            elif tag == "xmp":
                end = _XMP_END.search(source, at)
                self._open(tag, match[3])
                self._chars(html.escape(source[at : end.start() if end else len(source)], quote=False))
                self._close(tag)
                at = end.end() if end else len(source)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at) if not match[3].endswith("/") else None
                if end or tag in ("script", "style", "textarea", "title"):
                    at = end.start() if end else len(source)
                    close = source.find(">", at)
                    at = close + 1 if close >= 0 else len(source)
                if tag not in INLINE:
                    self._flush()
            else:
                self._open(tag, match[3])
        self._chars(source[at:])
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _chars(self, text: str) -> None:
        if text:
            self.text.append(text)

    def _flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", html.unescape("".join(self.text))).strip(" ")
            self.text = []
            if text:
                block = next((x for x in reversed(self.stack) if x[0] not in INLINE), self.stack[0])
                if self.named_at:
                    depth, number = self.named_at[0]
                    self.named[number][0] += len(text)
                    inside = self.stack[depth + 1 :]
                    self.named[number][1] += len(text) * any(x[0] in ("article", "main") for x in inside)
                elif not self.stack[-1][2]:
                    self.chars += len(text)
                    self.article_chars += len(text) * any(x[0] == "article" for x in self.stack)
                if not self.stack[-1][2]:
                    self.blocks.append((block[1], self.stack[-1][3], text))
                    block[4].append("#text")

    def _pop(self) -> None:
        tag, path, _, _, children = self.stack[-1]
        if tag not in INLINE:
            self._flush()
            runs = [c for i, c in enumerate(children) if not i or children[i - 1] != c]
            self.styles.append((path, " ".join(runs)))
        self.stack.pop()
        if self.named_at and self.named_at[-1][0] == len(self.stack):
            self.named_at.pop()

    def _mistaken(self) -> set[int]:
        """Elements that are cut by their name and hold the article, or where none is in sight most of the text."""
        whole = self.chars + sum(x[0] for x in self.named.values())
        return {
            i
            for i, (chars, article, talk) in self.named.items()
            if article > 4 * self.article_chars or (chars * 2 > whole and not talk and not self.article_chars and not any(x[1] for x in self.named.values()))
        }

    def _close(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
        elif any(x[0] == tag for x in self.stack):
            if tag in INLINE and next(x[0] for x in reversed(self.stack) if x[0] == tag or x[0] not in INLINE) != tag:
                return  # opened outside of the block it ends in
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag == "p":
            self._flush()

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            if tag not in INLINE:
                self._flush()
            return
        if tag not in INLINE:
            self._flush()
            for i in range(len(self.stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                if self.stack[i][0] == "p":
                    while len(self.stack) > i:
                        self._pop()
                    break
                if self.stack[i][0] not in INLINE:
                    break
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in CLOSED_BY.get(tag, ()):
                    while len(self.stack) > i:
                        self._pop()
                    break
                if self.stack[i][0] in STOP_AT.get(tag, (self.stack[i][0],)):
                    break
        names = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAME.finditer(attributes)} if "=" in attributes else {}
        called = re.sub(r"\d+", "", f"{names.get('class', '')} {names.get('id', '')}").strip()
        _, path, cut, article, children = self.stack[-1]
        role = names.get("role", "")
        no_article = tag in NO_ARTICLE or role in NO_ARTICLE_ROLES
        named = roles_of(called, article)
        if tag == "header" and article and not named and not role and "site" not in re.split(r"[-_\s]+", called):
            no_article = False  # the heading of an article
        if tag in ("body", "html", "main"):
            no_article, named = False, frozenset()
        self.opened += 1
        if named and not no_article and self.opened not in self.spared:
            no_article = True
            if not cut:
                self.named_at.append((len(self.stack), self.opened))
                self.named[self.opened] = [0, 0, bool(named & TALK)]
        node = f"{tag}.{'.'.join(sorted(called.split()))}" if called else tag
        if tag not in INLINE:
            children.append(node)
        self.stack.append((tag, path if tag in INLINE and not called else f"{path}/{node}", cut or no_article, article or ((tag in ("article", "main") or role == "main") and not no_article), []))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def article_digest(host: str, page: Page) -> int:
    """Names the text that the roles of elements alone leave of a page, within its host, as a signed long."""
    text = article_of(page.blocks)
    return (hash_text(f"{host}\n{text}") + (1 << 63)) % (1 << 64) - (1 << 63)


#: What style_tree and extract_text need of a page: its distinct paths, by place among them the distinct arrangements
#: (kind 1) and hashed texts (kind 2) of its nodes, and its blocks. host and digest are null where a page counts for no site.
PARSED = (
    "page_id long, url string, host string, digest long, paths array<string>, node_at array<int>, kind array<int>, key array<string>, "
    "block_at array<int>, article array<boolean>, text array<string>"
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARSED of rows (page_id, url, html)."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.string())]
    names = [x.split()[0] for x in PARSED.split(", ")]
    for batch in batches:
        held, first, chars = [], 0, 0
        for row, (url, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()), 1):
            page, host = Page(source or ""), (source and host_of(url)) or None
            at = {path: i for i, path in enumerate(dict.fromkeys(x[0] for x in (*page.styles, *page.blocks)))}
            nodes = {(at[path], 1, style): None for path, style in page.styles} | {(at[path], 2, f"{hash_text(text):016x}"): None for path, _, text in page.blocks} if host else {}
            held.append(
                (host, article_digest(host, page) if host else None, list(at), *([x[i] for x in nodes] for i in range(3)), [at[x[0]] for x in page.blocks], [x[1] for x in page.blocks], [x[2] for x in page.blocks])
            )
            chars += len(source or "")
            if row == batch.num_rows or chars > HELD_CHARS:
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, row - first) for c in (0, 1)), *(pa.array(x, kind) for x, kind in zip(zip(*held), kinds))], names)
                held, first, chars = [], row, 0


def parsed_pages(pages: DataFrame) -> DataFrame:
    """PARSED of every row of pages, read once and kept in the shared folder; as it holds most of the text, in small files."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return written(rows.mapInArrow(_parsed, PARSED), "parsed-pages", compression="zstd")


def _counts(batches: Iterator[pa.RecordBatch], copied: Filter) -> Iterator[pa.RecordBatch]:
    """host, path, kind, key, copy, pages: for every node of a page its arrangement, and its texts by hash; kind 0 is the node itself.

    copy is the digest of an article that other pages may have too, and null where there are none.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, COUNTED_PAGES):
            batch = whole.slice(at, COUNTED_PAGES)
            host, digest, paths, node_at, kind, key = batch.columns
            copy = pc.if_else(pa.array(copied.has(digest)), digest, pa.scalar(None, pa.int64()))
            n_paths, n_nodes = (x.value_lengths().to_numpy() for x in (paths, node_at))
            path, page = paths.flatten(), np.arange(batch.num_rows)
            node_path = path.take(pa.array(np.repeat(np.cumsum(n_paths) - n_paths, n_nodes) + node_at.flatten().to_numpy()))
            of = pa.array(np.concatenate((np.repeat(page, n_paths), np.repeat(page, n_nodes))))
            lines = pa.table(
                {
                    "host": host.take(of),
                    "path": pa.chunked_array([path, node_path]),
                    "kind": pa.chunked_array([pa.array(np.zeros(len(path), np.int32)), kind.flatten()]),
                    "key": pa.chunked_array([pa.array([""], pa.string()).take(pa.array(np.zeros(len(path), np.int64))), key.flatten()]),
                    "copy": copy.take(of),
                }
            )
            yield from lines.group_by(lines.column_names).aggregate([([], "count_all")]).select([*lines.column_names, "count_all"]).rename_columns([*lines.column_names, "pages"]).to_batches()


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _tree(nodes: pd.DataFrame) -> pd.DataFrame:
    """Importance of the nodes of one host, from the leaves up: path, importance."""
    nodes = nodes.sort_values("path").reset_index(drop=True)
    at = {p: i for i, p in enumerate(nodes["path"])}
    below: list[list[int]] = [[] for _ in at]
    for p, i in at.items():
        if (up := at.get(p.rpartition("/")[0])) is not None and up != i:
            below[up].append(i)
    importance = np.ones(len(nodes))
    for i in sorted(range(len(nodes)), key=lambda i: -nodes["path"][i].count("/")):
        own, styles = nodes.iloc[i], int(nodes["styles"][i])
        if own["pages"] < 2:
            continue
        parts = [(importance[c], nodes["pages"][c]) for c in below[i]]
        if own["texts"] > 0:
            parts.append((own["content"], own["pages"]))
        inner = sum(a * b for a, b in parts) / sum(b for _, b in parts) if parts else 1.0
        weight = DAMPING**styles
        importance[i] = (1 - weight) * own["presentation"] + weight * inner if styles > 1 else inner
    nodes["importance"] = importance
    return nodes[["host", "path", "pages", "importance"]]


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance of every style node of the hosts of pages."""
    return _style_tree(parsed_pages(pages))


def _style_tree(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("host is not null")
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    sent = parsed.sparkSession.sparkContext.broadcast(Filter.of(copies))
    counts = rows.select("host", "digest", "paths", "node_at", "kind", "key").mapInArrow(lambda batches: _counts(batches, sent.value), "host string, path string, kind int, key string, copy long, pages long")
    counts = counts.groupBy("host", "path", "kind", "key", "copy").agg(F.sum("pages").alias("pages"))
    pages_once = F.sum(F.when(F.col("copy").isNull(), F.col("pages")).otherwise(F.lit(1)))
    counts = written(counts.groupBy("host", "path", "kind", "key").agg(pages_once.alias("pages")), "style-counts")
    nodes = counts.where("kind = 0").select("host", "path", F.col("pages").alias("m"))
    log = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    keys = counts.where("kind > 0").groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("pages") * F.log("pages"))).alias("style_log"),
        F.sum(F.when(F.col("kind") == 1, F.col("pages"))).alias("style_pages"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("styles"),
        F.sum(F.when(F.col("kind") == 2, F.col("pages") * F.log("pages"))).alias("text_log"),
        F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("pages"))), F.lit(0)).alias("texts"),
    )
    # entropy to the base of the pages: of arrangements, and of the pages that one text is on
    # (copies of an article may differ in their frames, and so have more arrangements than they count as pages)
    spread = F.least(F.lit(1.0), (F.log("style_pages") - F.col("style_log") / F.col("style_pages")) / log)
    presentation = F.when(F.col("style_pages") > 0, spread).otherwise(F.lit(0.0))
    content = F.when(F.col("texts") > 0, 1 - F.col("text_log") / F.col("texts") / log).otherwise(F.lit(1.0))
    merged = nodes.join(keys, ["host", "path"], "left").select("host", "path", F.col("m").alias("pages"), presentation.alias("presentation"), F.coalesce("styles", F.lit(0)).alias("styles"), content.alias("content"), F.coalesce("texts", F.lit(0)).alias("texts"))
    return merged.groupBy("host").applyInPandas(_tree, "host string, path string, pages long, importance double")


def article_of(blocks: list[tuple[str, bool, str]]) -> str:
    if any(article for _, article, _ in blocks):
        blocks = [b for b in blocks if b[1]]
    return "\n".join(text for _, _, text in blocks)


def is_cut(path: str, cut: frozenset[str]) -> bool:
    """Whether the path or one above it is in cut."""
    while path not in cut:
        if not path:
            return False
        path = path.rpartition("/")[0]
    return True


def without_cut(blocks: list[tuple[str, bool, str]], cut: frozenset[str]) -> list[tuple[str, bool, str]]:
    return [b for b in blocks if b[1] or not is_cut(b[0], cut)] if cut else blocks


def main_text(source: str | None, cut: frozenset[str] = frozenset()) -> str:
    """The article of one page; cut: paths of branches to leave out, save for what stands in an article or main element."""
    return article_of(without_cut(Page(source or "").blocks, cut))


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column; null is empty."""
    values, ends = column.flatten().to_pylist(), np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
    return (values[a:b] for a, b in zip([0, *ends], ends))


def extract_text(pages: DataFrame) -> DataFrame:
    """One line per row of pages: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text. Pages without a readable host, and nodes that fewer than LEAST_PAGES
    pages of their host with different articles have, are judged by the roles of elements alone. Where a page has
    article or main elements, only their text counts, and only roles cut it. Rows may repeat or lack an id. Further
    columns are ignored.
    """
    rows = parsed_pages(pages)
    low = written(_style_tree(rows), "style-tree").where(f"pages >= {LEAST_PAGES} and importance < {CUT_BELOW}")
    cuts = written(low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("cut"), F.max("pages").alias("n")), "style-cuts")

    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    blocks = rows.select("page_id", "url", "paths", "block_at", "article", "text").withColumn("_host", host)
    judged = join_groups(blocks, cuts.withColumnRenamed("host", "_host"), "_host", "n", rows.count(), "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                article_of(without_cut([(paths[i], inside, text) for i, inside, text in zip(at, article, text)], frozenset(cut)))
                for paths, at, article, text, cut in zip(*(_lists(batch.column(c)) for c in range(2, 7)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return judged.select("page_id", "url", "paths", "block_at", "article", "text", "cut").mapInArrow(run, "page_id long, url string, text string, n_chars long")
