"""The main text of web pages by consensus of each host: pages vote on the path of their article's container, and the winning paths are extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone.llm.htmltree import CONTAINERS, HEADINGS, Element, Page
from lodestone.llm.shared import cut, small

#: Share of a child's score that its container gets; weights of elements named like an article and of the body itself.
INHERITED, GOOD, OUTER = 0.7, 1.5, 0.5
#: A path wins if it has this share of its host's votes, two at least; so a host has ten winning paths at most.
LEAST_SHARE, LEAST_VOTES = 0.1, 2


def container_scores(page: Page) -> dict[Element, float]:
    """A score for each container that is neither menu, notice, advert, comment nor the like, nor inside one.

    A container has the characters of the blocks that are its own, links taken off twice, and a share of the best group of its child containers; a group are those
    of one tag and class, so an article in equal sections is scored whole while the columns of a layout aren't added up.
    """
    own: dict[Element, float] = {}
    groups: dict[Element, dict[str, float]] = {}
    scores: dict[Element, float] = {}
    for element in reversed(page.elements):  # children before parents
        score = sum(max(0, len(page.blocks[b][1]) - 2 * page.blocks[b][2]) for b in element.blocks)
        if element.out():
            continue
        score += own.pop(element, 0)
        parent = element.parent
        if element.tag not in CONTAINERS:
            if parent is not None:
                own[parent] = own.get(parent, 0) + score
                for step, value in groups.pop(element, {}).items():
                    held = groups.setdefault(parent, {})
                    held[step] = held.get(step, 0) + value
            continue
        score = (score + INHERITED * max(groups.pop(element, {}).values(), default=0)) * (GOOD if element.good else 1)
        if score > 0 and not _outside(element):
            scores[element] = score * (OUTER if element.tag in ("html", "body") else 1)
        if parent is not None:
            held = groups.setdefault(parent, {})
            held[element.step] = held.get(element.step, 0) + score
    return scores


def _outside(element: Element) -> bool:
    while element is not None:
        if element.out():
            return True
        element = element.parent
    return False


def best_container(scores: dict[Element, float]) -> Element | None:
    """The container of the greatest score, the first of equal ones; or the article around it, or its parent if that adds only a heading."""
    if not scores:
        return None
    best = min(scores, key=lambda e: (-scores[e], e.path))
    at = best.parent
    while at is not None and at.tag not in ("html", "body"):
        if at.tag == "article" and at in scores:
            return at
        at = at.parent
    parent = best.parent
    if parent is not None and parent.tag not in ("html", "body") and not parent.out():
        others = [c for c in parent.children if c is not best and not c.out()]
        if others and all(c.tag in HEADINGS or (c.tag == "header" and c.holds) for c in others):
            return parent
    return best


def text_of(page: Page, container: Element | None) -> str:
    """The blocks of a container in page order, without menus, adverts and the like in it; of a header in it the headings stay."""
    if container is None:
        return ""
    kept = []
    for owner, text, _ in page.blocks:
        inside, out, at = False, False, owner
        while at is not None and not inside:
            inside = at is container
            out = out or (at.out() and not (at.tag == "header" and not at.aside and owner.tag in HEADINGS and not inside))
            at = at.parent
        if inside and not out:
            kept.append(text)
    return "\n".join(kept)


def _found(page: Page, paths: list[str]) -> Element | None:
    """The container of the first of ``paths`` that the page has, the best of several; the page's own best if it has none of them."""
    scores = container_scores(page)
    for path in paths:
        there = [e for e in page.elements if e.path == path and e.tag in CONTAINERS and not _outside(e)]
        if there:
            return min(there, key=lambda e: -scores.get(e, 0))
    return best_container(scores)


def host_of(url: Column) -> Column:
    """The host of a url in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes: the paths that win on each host, of those that are the path of a page's best container; each page has one vote.

    Pages without text have no vote. A host without a name has no consensus.
    """

    def vote(batches):
        import pyarrow as pa

        for batch in batches:
            votes: dict[tuple[str, str], int] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best = best_container(container_scores(Page(source.as_py() or "")))
                if best is not None:
                    votes[host, best.path] = votes.get((host, best.path), 0) + 1
            columns = [[h for h, _ in votes], [p for _, p in votes], list(votes.values())]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["host", "path", "votes"])

    hosts = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    counted = cut(hosts.mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes")), "host-votes")
    totals = counted.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    return counted.join(totals, "host").where((F.col("votes") >= LEAST_VOTES) & (F.col("votes") >= LEAST_SHARE * F.col("all_votes"))).select("host", "path", "votes")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the article of every page, without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments.

    Each page's containers are scored and vote on a path of tags and classes for their host (``host_paths``); then every page gives the
    text of the container with the first of its host's winning paths, or, where it has none of them, of its own best. Character references are decoded,
    white space in a block (also a line break) becomes one space, blocks are joined by newlines, and nothing else is left out.

    Null or empty html and pages without text give ''; a null url has no host, so its page goes by itself. Repeated rows
    give a row each; further columns are not read; an empty table gives no rows. The winning paths, a few a host, are broadcast
    up to a million; beyond that they are joined, where adaptive execution can split a large host.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path")))
    winners = cut(host_paths(pages).groupBy("host").agg(ranked.alias("p")).select("host", F.col("p.path").alias("paths")), "host-paths")
    hosts = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(small(winners), "host", "left").select("page_id", "url", "html", "paths")
    fields = {f.name: f.dataType for f in hosts.schema.fields}

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for source, paths in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                page = Page(source.as_py() or "")
                texts.append(text_of(page, _found(page, paths or [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = StructType([StructField("page_id", fields["page_id"]), StructField("url", fields["url"]), StructField("text", StringType()), StructField("n_chars", LongType())])
    return hosts.mapInArrow(extract, schema)
