"""Fields and links out of stored pages that may nest, leave tags open or quote as they like."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dedupe_links, dedupe_qualifications, explode_once
from ..functions.text import resolve_link, strip
from .markup import Step, elements, select, visible

#: Parts of a page that are no text of its body.
BOILERPLATE: tuple[Step, ...] = ("nav", "footer", ("div", "class", "ad"))
# A step, or steps from the outside in: an element that fits the last one inside ones that fit those before.
Selector = Step | list[Step]


def _path(selector: Selector) -> list[Step]:
    return selector if isinstance(selector, list) else [selector]


def _by_page(read: Callable, kind: str) -> Callable:
    """A column function of one page. Pages reach a worker some hundred at a time: column batches would hold 10,000, however long."""
    return F.udf(read, kind, useArrow=False)


def tidy(c: Column) -> Column:
    """Runs of blanks to one, runs of line breaks to one."""
    c = F.regexp_replace(c, "[ \\t]+", " ")
    c = F.regexp_replace(c, " ?\\n ?", "\n")
    return strip(F.regexp_replace(c, "\\n{2,}", "\n"))


def page_fields(html: Column, title: Selector, body: Selector, items: Selector, hidden: Sequence[Step] = BOILERPLATE) -> Column:
    """struct(title, body, items): visible texts of the first title and body, and of all items; null without a page.

    ``hidden`` elements are left out of the body. Elements that nothing closes end
    with what surrounds them.
    """
    paths = [_path(s) for s in (title, body, items)]
    unseen = [_path(s) for s in hidden]

    def read(page: str | None) -> tuple:
        if page is None:
            return None, None, None
        found = elements(page)
        heads, bodies, listed = (select(found, p) for p in paths)
        cut = [e for p in unseen for e in select(found, p)] if bodies else []
        return (
            visible(page, heads[0], found) if heads else "",
            visible(page, bodies[0], found, cut) if bodies else "",
            [visible(page, e, found) for e in listed],
        )

    return _by_page(read, "title string, body string, items array<string>")(html)


def extract_pages(pages: DataFrame, title: Selector = "h1", body: Selector = "article", items: Selector = "li") -> DataFrame:
    """(page_id, Title, Description, Qualifications, Link) per stored page.

    title, body and items are names of elements, (name, attribute, value) with * for
    any name, or lists of these from the outside in. Of titles and bodies the first counts,
    of items each, also inside another. A page without one has an empty
    field; a null page has null texts and no items.
    """
    read = pages.select("page_id", "url", page_fields(F.col("html"), title, body, items).alias("_f"))
    return read.select(
        "page_id",
        tidy(F.col("_f.title")).alias("Title"),
        tidy(F.col("_f.body")).alias("Description"),
        dedupe_qualifications(F.transform(F.coalesce("_f.items", F.array().cast("array<string>")), tidy)).alias("Qualifications"),
        F.col("url").alias("Link"),
    )


#: Schemes that lead to no page.
NO_PAGE = r"(?i)^(?:mailto|javascript|tel|data):"


def link_addresses(html: Column, within: Selector | None = None, attributes: Sequence[str] = ("href",)) -> Column:
    """array<string>: the first of ``attributes`` that each link element has, inside all elements that fit ``within``."""
    path = [*(_path(within) if within is not None else []), "a"]

    def read(page: str | None) -> list[str] | None:
        if page is None:
            return None
        links = select(elements(page), path)
        values = (next((v for a in attributes if (v := e.value(a))), None) for e in links)
        return [v for v in values if v is not None]

    return _by_page(read, "array<string>")(html)


def extract_links(
    pages: DataFrame, base: str, within: Selector | None = None, only: str | None = None, attributes: Sequence[str] = ("href",)
) -> DataFrame:
    """(page_id, pos, link): absolute links of a page, each once, in order.

    ``within`` looks only inside elements that fit it; ``only`` is a pattern that an
    address must match, e.g. ``/job/``; ``attributes`` hold the address, the first that
    is there counts. References in addresses are decoded, empty addresses and
    those that lead to no page dropped.
    """
    hrefs = F.transform(link_addresses(F.col("html"), within, attributes), strip)
    hrefs = F.filter(hrefs, lambda h: (h != "") & ~h.rlike(NO_PAGE) & (h.rlike(only) if only else F.lit(True)))
    links = dedupe_links(F.transform(hrefs, lambda h: resolve_link(h, base)))
    return explode_once(pages, ["page_id"], links, "link", "pos")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
