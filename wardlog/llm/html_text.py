"""Main text of web pages by consensus paths of their hosts (operator 2).

1. Each page is read into blocks of text and the containers that hold them; a container is named by its
   generalised path from the root: tags with their classes, digits replaced, `body/div.post-#/article`.
   It scores by the text it holds that is neither linked nor in a menu, advert, form and the like.
2. Spark sums the votes of a host's pages per path (a page gives its containers shares of one vote, so long
   pages count no more) and takes the path with most votes. Votes are combined before they are
   shuffled, so a crowded host is no crowded task.
3. Pages are read again with the path of their host; a page without it falls back to its own best container.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlog.llm.common import checkpointed, query, table
from wardlog.llm.url_filter import host_of

BROADCAST_HOSTS = 200_000    # hosts whose paths may be sent to every task

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark output q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                     "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag closes an open one of the listed kinds, unless one of the stops lies between.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
           "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
           "option": (("option",), ("select",))}
CONTAINERS = frozenset("article main section div td body center".split())
PREFERRED = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements, roles and name parts that are not the article.
SKIPPED_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select textarea svg "
                         "canvas object dialog menu title audio video map".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
SKIPPED_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts adbox sponsor sponsored promo promotion banner sidebar aside menu nav "
    "navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar comment comments commentlist disqus respond "
    "reply replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright "
    "disclaimer alert search hidden".split())
#: A name with such a part says how something looks or what it lacks, not what it is.
QUALIFIERS = frozenset("no not non without has have with is hide hidden show".split())
#: Names of what readers have written; it may well be most of a page.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Pieces of running text. Within an article their names say how they look.
RUNNING = frozenset("p blockquote pre figure figcaption li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 em strong b i q cite".split())

#: Comments, elements whose content is no markup (dropped with it), declarations, closing and opening tags.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]).*?"
                    r"(?:</(?P=raw)\s*>|\Z)"
                    r"|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
                    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|[^>]*>?)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
NAME_PART = re.compile(r"[a-z]+")
LONGEST_PATH = 400      # a longer path goes on from its digest
DIGITS = re.compile(r"[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def noise_names(names: str) -> set[str]:
    """Names that say that an element is not the article: whole ones, or compounds that begin or end with one."""
    found = set()
    for name in names.split():
        parts = NAME_PART.findall(name)
        if len(parts) == 1:
            found.update(SKIPPED_NAMES.intersection(parts))
        elif parts and not QUALIFIERS.intersection(parts):
            found.update(SKIPPED_NAMES.intersection((parts[0], parts[-1])))
    return found


class Page:
    """Blocks (text, linked characters, element) in page order, and the elements that hold them.

    An element is left out for certain (its tag, its role, that it is not shown) or by its name. A name is overruled
    where the element holds most of the page's unlinked text and its heading, or nearly all of it. Work and memory
    grow with the page, whatever its depth.
    """

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.path = [-1], [""], [""]
        self.why = [0]                 # why an element is left out: 0 not, 1 its name, 2 for certain; -1 kept within one
        self.readers = [False]         # named as what readers wrote
        self.shut, self.article = [""], [False]      # tag of the outermost one left out; within an article
        self.blocks: list[tuple[str, int, int]] = []
        self.open = [0]                # indexes of open elements, inline ones included
        self.counts: dict[str, int] = {}             # open elements by tag
        self.parts: list[str] = []
        self.linked = self.links = 0
        at = 0
        for found in MARKUP.finditer(source):
            begin = found.start()
            if begin > at:
                self.text(source[at:begin])
            at = found.end()
            _, closing, opening, attributes = found.groups()
            if opening:
                self.start(opening.lower(), attributes)
            elif closing:
                self.end(closing.lower())
        if at < len(source):
            self.text(source[at:])
        self.flush()
        self.skipped = self.left_out()

    def left_out(self) -> list[bool]:
        unlinked, headed = [0] * len(self.tag), [t in PREFERRED or t == "h1" for t in self.tag]
        for text, linked, element in self.blocks:
            unlinked[element] += len(text) - linked
        for i in range(len(self.tag) - 1, 0, -1):
            unlinked[self.parent[i]] += unlinked[i]
            headed[self.parent[i]] |= headed[i]
        most = unlinked[0]
        out = [False] * len(self.tag)
        for i in range(1, len(out)):
            if self.why[i] == 1 and 2 * unlinked[i] > most and not self.readers[i] and (
                    headed[i] or 10 * unlinked[i] > 9 * most):
                self.why[i] = 0
            out[i] = self.why[i] > 0 or (out[self.parent[i]] and self.why[i] == 0)
        return out

    def text(self, raw: str) -> None:
        text = entities.unescape(raw)      # a reference does not reach across markup
        self.parts.append(text)
        if self.links:
            self.linked += len(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, min(self.linked, len(text)), self.open[-1]))
            self.parts, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        for index in self.open[depth:]:
            self.counts[self.tag[index]] -= 1
            self.links -= self.tag[index] == "a"
        del self.open[depth:]

    def find(self, tags, stops=()) -> int | None:
        if not any(self.counts.get(t) for t in tags):
            return None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in tags:
                return depth
            if tag in stops:
                return None
        return None

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P and (depth := self.find(("p",), ("td", "th", "button", "table"))):
                self.close_to(depth)
            if tag in IMPLIED and (depth := self.find(*IMPLIED[tag])):
                self.close_to(depth)
        if tag in VOID:
            return
        parent = self.open[-1]
        names, why, readers = (), 2 if tag in SKIPPED_TAGS else 0, False
        if attributes and not attributes.isspace():
            values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
            names = sorted(values.get("class", "").split())
            if tag not in ("html", "body", "article", "main"):
                if (values.get("role", "") in SKIPPED_ROLES or "hidden" in values or values.get("aria-hidden") == "true"
                        or HIDDEN.search(values.get("style", ""))):
                    why = 2
                elif not why and not (tag in RUNNING and self.article[parent]):
                    noise = noise_names(values.get("class", "") + " " + values.get("id", ""))
                    why, readers = int(bool(noise)), bool(READERS & noise)
        if tag in HEADINGS and self.shut[parent] == "header" and self.article[parent] and not why:
            why = -1           # a heading in the header of an article is the article's
        shut = "" if why < 0 else self.shut[parent] or (tag if why else "")
        step = tag + "".join("." + DIGITS.sub("#", n) for n in names) if tag in CONTAINERS else ""
        path = f"{self.path[parent]}/{step}" if step else self.path[parent]
        if len(path) > LONGEST_PATH:
            path = "…" + hashlib.blake2b(path.encode(), digest_size=16).hexdigest()
        self.open.append(len(self.tag))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        for values, value in ((self.parent, parent), (self.tag, tag), (self.path, path), (self.why, why), (self.readers, readers),
                              (self.shut, shut), (self.article, self.article[parent] or (tag in PREFERRED and not shut))):
            values.append(value)
        self.links += tag == "a"

    def end(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "p" and self.find(("p",)) is None:
            self.flush()
            return
        if tag in INLINE:
            depth = self.find((tag,), CLOSES_P)
        else:
            self.flush()
            depth = self.find((tag,), ("table",) if tag not in ("table", "body", "html", "article", "main") else ())
        if depth:
            self.close_to(depth)

    def scores(self) -> dict[int, float]:
        """Containers by the unlinked text they hold; text counts less with each container in between."""
        weight = [0.0] * len(self.tag)
        for text, linked, element in self.blocks:
            if not self.skipped[element]:
                weight[element] += len(text) - 2 * linked
        out: dict[int, float] = {}
        for i in range(len(weight) - 1, 0, -1):
            here = weight[i]
            if self.tag[i] in CONTAINERS:
                if here > 0:
                    out[i] = here * (1.25 if self.tag[i] in PREFERRED else 1.0)
                here *= 1.0 if self.tag[i] == "section" else 0.8
            weight[self.parent[i]] += here
        return out

    def votes(self) -> dict[str, float]:
        """Shares of one vote by path."""
        scores = self.scores()
        best: dict[str, float] = {}
        for element, score in scores.items():
            path = self.path[element]
            best[path] = best.get(path, 0.0) + score
        total = sum(best.values())
        return {path: score / total for path, score in best.items()}

    def main_text(self, path: str | None) -> str:
        """Text below the elements of `path`, else below the page's best path, else all that is not left out."""
        found = self.below({i for i, p in enumerate(self.path) if path and p == path and self.tag[i] in CONTAINERS})
        if not any(found[b[2]] and not self.skipped[b[2]] for b in self.blocks):
            votes = self.votes()
            own = max(votes, key=lambda p: (votes[p], p)) if votes else None
            found = self.below({i for i, p in enumerate(self.path) if p == own and self.tag[i] in CONTAINERS} or {0})
        return "\n".join(text for text, _, element in self.blocks if found[element] and not self.skipped[element])

    def below(self, chosen: set[int]) -> list[bool]:
        """Which elements are among the chosen ones or within them."""
        out = [0 in chosen] * len(self.tag)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] or i in chosen
        return out


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, pages) over all pages."""
    def run(batches):
        for batch in batches:
            hosts, paths, votes = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                for path, vote in Page(source.as_py() or "").votes().items():
                    hosts.append(host)
                    paths.append(path)
                    votes.append(round(vote * 1_000_000))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                                              pa.array(votes, pa.int64())], names=["host", "path", "votes"])
    return (pages.select("host", "html").mapInArrow(run, "host string, path string, votes bigint")
            .groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.count("*").alias("pages")))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path): the path of most votes; ties go to the larger path."""
    return votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("top")).select("host", "top.path")


def extract(pages: DataFrame) -> DataFrame:
    """Rows of `pages` (page_id, url, html) to (page_id, url, text, n_chars, path), one per row.

    Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined
    by a line feed in page order. A null or empty page has an empty text. Pages without a host vote under the
    empty host. Rows are independent, also with null or repeated ids. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
                        host_of(F.col("url").cast("string")).alias("host"))
    winners = checkpointed(winning_paths(host_votes(rows)))
    winners = F.broadcast(winners) if winners.count() <= BROADCAST_HOSTS else winners
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                paths = part.column(3).to_pylist()
                texts = [Page(h.as_py() or "").main_text(p) for h, p in zip(part.column(2), paths)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64()), part.column(3)],
                    names=["page_id", "url", "text", "n_chars", "path"])
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, path string")


@query("op2_consensus_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
