"""HTML pages to postings: a small element tree on the standard parser, and a table of card selectors."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import JUNK_TITLES

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self) -> Iterator[Element]:
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def all(self, *selectors: str) -> list[Element]:
        """Elements that one of the selectors fits, in document order."""
        return [e for e in self.walk() if any(_fits(e, s) for s in selectors)]

    def closest(self, *tags: str) -> Element | None:
        e = self
        while e is not None and e.tag not in tags:
            e = e.parent
        return e

    def first(self, *selectors: str) -> Element | None:
        return next(iter(self.all(*selectors)), None)


def _fits(e: Element, selector: str) -> bool:
    """tag, .class, tag.class, *text (part of the class attribute), or tag@attribute=prefix."""
    tag, _, cls = selector.partition(".")
    if selector.startswith("*"):
        return selector[1:] in e.attrs.get("class", "")
    if "@" in selector:
        tag, _, rest = selector.partition("@")
        name, _, prefix = rest.partition("=")
        return (not tag or e.tag == tag) and e.attrs.get(name, "").startswith(prefix) and name in e.attrs
    return (not tag or e.tag == tag) and (not cls or cls in e.attrs.get("class", "").split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = Element("", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(e)
        if tag not in _VOID:
            self.stack.append(e)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(text: str) -> Element:
    b = _Builder()
    b.feed(text)
    return b.root


#: provider: (cards, titles, locations, links, departments, base address, default location)
CARDS = {
    "successfactors": (["tr.data-row"], [".jobTitle"], [".jobLocation"], ["a"], [], "https://careers.{token}", ""),
    "jazzhr": (["li.list-group-item"], ["h3.list-group-item-heading", "h2"], [], ["a"], [], "https://{token}.applytojob.com", ""),
    "goldmansachs": (["a@href=/roles/"], ["span.gs-text"], ["@data-testid=location"], [""], ["button.gs-tag__button"], "https://higher.gs.com", "London, United Kingdom"),
    "google": (["div.sMn82b"], ["h3"], ["span.r0wTof"], ["a"], [], "https://www.google.com/about/careers/applications/", "United Kingdom"),
    "meta": (["a@href=/jobs/"], ["*title", "h2", "h3", "strong"], ["*location", "*office"], [""], ["*department", "*team"], "https://www.metacareers.com", "London, United Kingdom"),
    "publicis": (["mat-expansion-panel", ".job-card", "*job-item", "tr.job-row"], [".job-title-link", ".job-title", "*title", "h3", "h4", "a"], [".job-card-column-value", ".job-location", "*location", ".office"], ["a.job-title-link", "a"], [], "", "United Kingdom"),
    "linkedin": ([".base-search-card"], [".base-search-card__title", ".job-search-card__title"], [".job-search-card__location"], ["a.base-card__full-link", "a.base-search-card__title-link"], [".base-search-card__subtitle"], "", ""),
    "nhs": (["li.search-result"], ["a"], ["*location"], ["a"], ["h3"], "https://www.jobs.nhs.uk", "United Kingdom"),
    "teamtailor_html": (["li", "article"], ["a"], ["*location"], ["a"], [], "https://{token}.teamtailor.com", ""),
    "jobvite": (["li", "tr"], ["a@href=/"], ["*location"], ["a@href=/"], [], "https://jobs.jobvite.com", ""),
}


def once(text: str) -> str:
    """A text that is one half repeated becomes the half."""
    n = len(text) // 2
    return text[:n] if len(text) > 5 and text[:n] == text[n:] else text


def cards(provider: str, token: str, page: str) -> list[tuple[str, str, str, str]]:
    """(title, location, url, department) of every card with a title and a link."""
    card, titles, places, links, teams, base, default = CARDS[provider]
    out = []
    for c in parse(page).all(*card):
        pick = lambda selectors: (e.text().strip() if selectors and (e := c.first(*selectors)) else "")  # noqa: E731, B023
        link = c if links == [""] else c.first(*links)
        title, href = pick(titles), link.attrs.get("href", "") if link else ""
        if not title or not href:
            continue
        place, team = pick(places), pick(teams)
        if provider == "jazzhr":
            lines = [e.text().strip() for e in c.all("li") if e is not c]
            place, team = (" ".join(lines[0].split()[1:]) if lines else ""), (lines[1] if len(lines) > 1 else "")
        if provider == "goldmansachs":
            place = " ".join(place.replace("·", ", ").split())
        if provider == "linkedin":
            href = href.split("?")[0]
        out.append((title, once(place.split("\n")[0].strip()) or default, urljoin(base.replace("{token}", token or ""), href), team))
    return list({row[2]: row for row in out}.values())


#: Links of a careers page that may be postings, in the order in which they are looked for; places named in a card's text.
CAREERS_PATHS = ("/jobs/", "/job/", "/careers/")
CARD_PLACE = re.compile(r"(London|United Kingdom|UK|Manchester|Birmingham|Leeds|Remote[^,.]*UK)", re.IGNORECASE)
#: Postings of one careers page that are kept.
CAREERS_BOUND = 500


def plausible_title(title: str) -> bool:
    """The rule of ``functions.titles.valid_title`` for one text."""
    low = title.strip().lower()
    return len(title) >= 3 and low not in JUNK_TITLES and not (len(low) < 40 and low.startswith(JUNK_TITLES))


def _of_json_ld(page: Element, home: str) -> Iterator[tuple[str, str, str, str]]:
    for script in page.all("script@type=application/ld+json"):
        try:
            found = json.loads(script.text())
        except ValueError:
            continue
        for entry in found if isinstance(found, list) else [found]:
            if not isinstance(entry, dict) or entry.get("@type") != "JobPosting":
                continue
            place = entry.get("jobLocation") or {}
            place = place[0] if isinstance(place, list) and place else place
            address = place.get("address") if isinstance(place, dict) else None
            parts = [address.get(k) for k in ("addressLocality", "addressRegion", "addressCountry")] if isinstance(address, dict) else []
            department = str(entry.get("department") or entry.get("occupationalCategory") or "") if not isinstance(entry.get("department"), dict) else ""
            yield str(entry.get("title") or "").strip(), ", ".join(str(p) for p in parts if p), str(entry.get("url") or home).strip(), department


def careers_page(home: str, text: str) -> list[tuple[str, str, str, str]]:
    """(title, location, url, department) of a careers page: its JobPosting blocks, then links that look like postings.

    A link's place is the first one named in the text of the list item, article, division or table row
    around it. Of one address the last posting stays, at the first one's place; CAREERS_BOUND are kept.
    """
    page, found, seen = parse(text), [], set()
    found += _of_json_ld(page, home)
    for path in CAREERS_PATHS:
        for a in page.all("a"):
            href, title = a.attrs.get("href", "").strip(), " ".join(a.text().split())
            url = urljoin(home, href)
            if path not in href or not plausible_title(title) or url in seen:
                continue
            seen.add(url)
            card = a.closest("li", "article", "div", "tr")
            place = CARD_PLACE.search(" ".join(card.text().split())) if card else None
            found.append((title, place[0] if place else "", url, ""))
    return list({row[2]: row for row in found if row[0] and row[2]}.values())[:CAREERS_BOUND]


def normalize_html(payloads: DataFrame) -> DataFrame:
    """Postings of HTML pages: company_id, provider, pos, title, location, url, department."""

    def run(batches):
        for batch in batches:
            rows = []
            for company, provider, token, page in zip(*(c.to_pylist() for c in batch.columns)):
                found = careers_page(token or "", page or "") if provider == "generic_careers" else cards(provider, token, page or "")
                rows += [(company, provider, n, *row) for n, row in enumerate(found)]
            kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4]
            names = ["company_id", "provider", "pos", "title", "location", "url", "department"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    mine = payloads.filter(F.col("provider").isin(*CARDS, "generic_careers") & F.ltrim("payload").startswith("<"))
    picked = mine.select(F.col("company_id").cast("long"), "provider", "token", "payload")
    return picked.mapInArrow(run, "company_id long, provider string, pos int, title string, location string, url string, department string")
