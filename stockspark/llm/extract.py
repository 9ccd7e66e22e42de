"""Main text of web pages by consensus host paths (operator 11).

Every page is read into elements and text blocks (``markup.py``). Navigation,
headers, footers, sidebars, notices, adverts, forms, scripts and comments of readers
are left out by their element, role, or words of their class and id; blocks and lists
that are little but links count as menus.

First pass: each container of a page scores the text it holds directly, half of what
its children hold, and so on down three levels, weighted by its element and class.
Every container that scores at least half of the page's best votes, with its share
of that score, for its generalised path: the elements down to it with their classes,
digits made alike. Spark sums the votes by host and path; a path wins if its votes
reach ``WINS`` of the host's pages. Second pass: a page is extracted again at the
winning path for which its votes times the text the page holds there are largest
(a path around one with more votes does not compete); the page's own best container competes with ``ALONE`` as its votes, so it counts where
the host's paths hold next to nothing, and where the page has no host.

The page's own best is widened where its text would be torn: to the article
element around it, or to the parent while siblings hold a like amount of text.

Votes are partially summed before they are shuffled, so a hot host is no more than
one row a path and task. The winning paths are broadcast only if their measured
size is within ``BROADCAST_BYTES``; beyond it pages and winners meet by host and a
salt, so no task gets a whole hot host.

Defined cases: null or empty html gives an empty text; a page cut off anywhere is
read as far as it goes; text outside all elements counts as the page's; rows with null
ids or urls and repeated rows each give their row; other columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import small_batches, table
from stockspark.llm.markup import GONE, KEEP, LAYOUT, Page, read_page

VOTES_FROM = 0.5          # of the best score: containers that vote
WINS = 0.1                # of a host's pages: votes that make a path a winner
ALONE = 0.05              # votes, as a share of the pages, of a page's own best container
SIBLING = 0.2             # of the best child's text: a sibling that belongs with it
LEVELS = (1.0, 0.5, 0.25)
RECOVER = 250             # characters of text in layout elements that are taken if nothing else is there
BROADCAST_BYTES = 8 << 20
SALTS = 32

_TEXT = "page_id long, url string, text string, n_chars long"


class Scored:
    """A page's blocks that count, and the score and text of its containers."""

    def __init__(self, page: Page):
        self.page = page
        menus = self._menus()
        kept = [b for b in range(len(page.text)) if page.level[b] == KEEP and b not in menus]
        if not kept:
            kept = [b for b in range(len(page.text)) if page.level[b] == LAYOUT and b not in menus]
            if sum(len(page.text[b]) for b in kept) < RECOVER:
                kept = []
        self.blocks = kept
        n = len(page.tag)
        self.score, self.direct, self.held = [0.0] * n, [0.0] * n, [0.0] * n
        for b in kept:
            plain = max(0, len(page.text[b]) - 2 * page.linked[b])
            worth = plain / 100 + page.text[b].count(",") * 0.2
            self.direct[page.holder[b]] += plain
            # a paragraph's text counts for what contains the paragraph
            e = page.holder[b]
            if page.tag[e] in ("p", "li", "pre", "blockquote", "td", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt"):
                e = page.parent[e]
            for share in LEVELS:
                if e < 0:
                    break
                self.score[e] += share * worth * page.weight[e]
                e = page.parent[e]
        self.held = list(self.direct)
        for e in range(n - 1, 0, -1):                     # parents come first
            self.held[page.parent[e]] += self.held[e]

    def _menus(self) -> set[int]:
        """Blocks that are little but links, or lie in a list of such."""
        page = self.page
        total, linked, links = {}, {}, {}
        for b in range(len(page.text)):
            if page.links[b]:
                e = page.holder[b]
                while e > 0 and page.tag[e] not in ("ul", "ol", "dl", "table"):
                    if page.tag[e] in ("article", "main", "body", "section", "div"):
                        e = 0
                        break
                    e = page.parent[e]
                key = e if e > 0 else -1 - b
                links[key] = links.get(key, 0) + page.links[b]
        lists = {k for k in links if k > 0}
        owner = {}
        for b in range(len(page.text)):
            e = page.holder[b]
            while e > 0 and e not in lists and page.tag[e] in ("li", "p", "span", "dd", "dt", "td", "th", "tr", "tbody"):
                e = page.parent[e]
            key = e if e in lists else -1 - b
            if key in links:
                owner[b] = key
                total[key] = total.get(key, 0) + len(page.text[b])
                linked[key] = linked.get(key, 0) + page.linked[b]
        menu = {k for k in links if links[k] >= 3 and linked.get(k, 0) >= 0.8 * total.get(k, 1)}
        return {b for b, k in owner.items() if k in menu}

    def best(self) -> int:
        """The page's own best container, widened where it would tear the text; 0 without text."""
        page = self.page
        if not self.blocks:
            return 0
        e = max(range(len(page.tag)), key=lambda i: (self.score[i], -i))
        up = e
        while up > 0:
            if page.tag[up] == "article" or (page.tag[up] == "main" and page.tag[e] != "article"):
                return up
            up = page.parent[up]
        while page.parent[e] > 0:
            p = page.parent[e]
            others = [i for i in self._children(p) if i != e]
            near = any(self.held[i] >= SIBLING * self.held[e] for i in others)
            heading = page.tag[p] != "body" and any(page.tag[i] in ("h1", "h2") for i in others)
            if not (near or heading or self.direct[p] >= SIBLING * self.held[e]):
                break
            e = p
        return e

    def _children(self, e: int) -> list[int]:
        if not hasattr(self, "_kids"):
            self._kids: dict[int, list[int]] = {}
            for i, p in enumerate(self.page.parent):
                if self.held[i] > 0:
                    self._kids.setdefault(p, []).append(i)
        return self._kids.get(e, [])

    def votes(self) -> dict[str, float]:
        """Share of a vote by path; the page's own best container has a whole one."""
        if not self.blocks:
            return {}
        own, top = self.best(), max(self.score)
        out: dict[str, float] = {}
        for e in range(1, len(self.score)):
            if top > 0 and self.score[e] >= VOTES_FROM * top and e != own:
                path = self.page.path[e]
                out[path] = max(out.get(path, 0.0), 0.9 * self.score[e] / top)
        out[self.page.path[own]] = 1.0
        return {p: v for p, v in out.items() if p}

    def text(self, winners: list[tuple[str, float]]) -> str:
        """Blocks in page order at the strongest of the host's ``(path, share of votes)``, or in the page's own best."""
        page, own = self.page, self.best()
        by_path: dict[str, list[int]] = {p: [] for p, _ in winners}
        for e, p in enumerate(page.path):
            if p in by_path:
                by_path[p].append(e)
        chosen, worth, stronger = {own}, ALONE * self.held[own], []
        for p, share in winners:
            inside = set(by_path[p])
            if any(x.startswith(p + ">") for x in stronger):
                continue                          # only holds what surrounds a place with more votes
            if any(self.held[e] > 0 for e in inside):
                stronger.append(p)
            outer = {e for e in inside if not self._within(page.parent[e], inside)}
            held = share * sum(self.held[e] for e in outer)
            if held > worth:
                chosen, worth = outer, held
        mark = [False] * len(page.tag)
        for e in range(len(mark)):
            mark[e] = e in chosen or (e > 0 and mark[page.parent[e]])
        return "\n\n".join(page.text[b] for b in self.blocks if mark[page.holder[b]])

    def _within(self, e: int, some: set[int]) -> bool:
        while e >= 0:
            if e in some:
                return True
            e = self.page.parent[e]
        return False


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = batch.column("host").to_pylist()
        total: dict[tuple[str, str], float] = {}
        for host, source in zip(hosts, batch.column("html").to_pylist()):
            for path, share in Scored(read_page(source or "")).votes().items():
                total[(host, path)] = total.get((host, path), 0.0) + share
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()),
             pa.array([round(v * 1000) for v in total.values()], pa.int64())], names=["host", "path", "votes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("paths").to_pylist()
        texts = [Scored(read_page(source or "")).text([(p["path"], p["share"]) for p in paths[i] or []])
                 for i, source in enumerate(batch.column("html").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def with_host(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, host``; the host is null where the url has none."""
    url = F.col("url").cast("string")
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
                        F.col("html").cast("string").alias("html"), F.when(host != "", host).alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, paths``: winning paths with their share of votes, most votes first, of ``pages(host, html)``."""
    known = pages.where(F.col("host").isNotNull() & F.col("html").isNotNull()).select("host", "html")
    votes = known.mapInArrow(_vote, "host string, path string, votes long").groupBy("host", "path").agg(
        F.sum("votes").alias("votes"))
    size = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    strong = votes.join(size, "host").where(F.col("votes") >= F.col("n") * (1000 * WINS))
    # a page votes for few paths, so at WINS of its pages a host has few winners
    share = (F.col("votes") / F.col("n") / 1000).alias("share")
    ranked = strong.groupBy("host").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("votes")).alias("v"), "path", share))).alias("w"))
    return ranked.select("host", F.transform("w", lambda x: F.struct(x["path"].alias("path"), x["share"].alias("share")))
                         .alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    small_batches(pages.sparkSession)
    pages = with_host(pages)
    winners = table(host_paths(pages), "host-paths")
    size = winners.agg(F.sum(F.length("host") + F.length(F.concat_ws(" ", "paths.path")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = pages.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
        # rows without a host match nothing and are dealt by their salt alone
        met = dealt.where("host is not null").join(salted, ["host", "salt"], "left").drop("salt").unionByName(
            dealt.where("host is null").drop("salt"), allowMissingColumns=True)
    return met.select("page_id", "url", "html", "paths").mapInArrow(_texts, _TEXT)
