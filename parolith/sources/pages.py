"""Sayings out of fetched HTML pages: five extractors, each a pass over (url, html) rows.

A page is parsed once by an event parser that remembers the last heading's anchor, the open list items and whether it stands in
the content part; extractors are filters on its items. What needs no markup (word counts, phrases) is a column expression.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parolith.functions import text as X
from parolith.functions.patterns import S, W, whole_words
from parolith.operators.clean import as_saying_rows

#: Anchors of headings below which no item counts; phrases that no item may hold, by kind of page.
STOP_ANCHORS = frozenset({"References", "External_links", "See_also", "External_links_and_references"})
QUOTE_FURNITURE = ("What links here", "Navigation menu", "Text is available under", "Creative Commons", "Terms of Use", "Privacy Policy", "Retrieved from")
APPENDIX_FURNITURE = ("edit", "what links here", "permanent link", "download as pdf")
BOOK_FURNITURE = ("Contents", "Index", "CHAPTER", "ADVERTISEMENT", "Publisher", "Copyright", "Project Gutenberg")
LONDON_TRAP = rf"(?i)(?:^|[^{W}])London:[{W}]"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MOST_PER_PAGE = 5000


class PageItems(HTMLParser):
    """items: (text, in content, below a stop heading) of every li; titles: texts of titled links in the category list; lines: all text nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.titles: list[list] = []
        self.lines: list[str] = []
        self.has_content = False
        self._open: list[tuple[str, frozenset[str]]] = []
        self._lis: list[list] = []
        self._link: list | None = None
        self._anchor: str | None = None
        self._in_heading = False

    def _inside(self, *marks: str) -> bool:
        marked = [m for _, own in self._open for m in own]
        at = -1
        for m in marks:
            try:
                at = marked.index(m, at + 1)
            except ValueError:
                return False
        return True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        classes = (own.get("class") or "").split()
        if tag == "li":
            while self._open and self._open[-1][0] == "li":
                self.handle_endtag("li")
        if tag in ("h2", "h3"):
            self._anchor, self._in_heading = None, True
        if tag == "span" and self._in_heading and "mw-headline" in classes and self._anchor is None:
            self._anchor = own.get("id")
        if tag not in VOID:
            self._open.append((tag, frozenset([f"#{own['id']}"] if own.get("id") else []) | frozenset(f".{c}" for c in classes)))
        if tag == "li":
            inside = self._inside("#mw-content-text", ".mw-parser-output")
            self.has_content = self.has_content or inside
            item = [[], inside, self._anchor in STOP_ANCHORS]
            self._lis.append(item)
            self.items.append(item)
        if ".mw-parser-output" in (self._open[-1][1] if self._open else ()) and self._inside("#mw-content-text", ".mw-parser-output"):
            self.has_content = True
        if tag == "a" and own.get("title") is not None and self._lis and self._inside("#mw-pages"):
            self._link = []
            self.titles.append(self._link)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h2", "h3"):
            self._in_heading = False
        if tag == "a":
            self._link = None
        if any(t == tag for t, _ in self._open):
            while self._open:
                t, _ = self._open.pop()
                if t == "li" and self._lis:
                    self._lis.pop()
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text or any(t in ("script", "style") for t, _ in self._open):
            return
        self.lines.append(text)
        for item in self._lis:
            item[0].append(text)
        if self._link is not None:
            self._link.append(text)


def fetch_pages(sources: DataFrame, seconds: float = 30.0, pause: float = 1.0, agent: str = "parolith/1.0", get: Callable[[str], str] | None = None) -> DataFrame:
    """(url, html, error) of every distinct address of a catalogue; a page that fails has an error and no html.

    Addresses of one host go to one task, which waits between two requests. ``get`` may take the place of the HTTP request.
    """

    def request(url: str) -> str:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=seconds) as answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: set[str] = set()
        for p in batches:
            for url, host in zip(p["url"], p["host"]):
                if host in asked:
                    time.sleep(pause)
                asked.add(host)
                try:
                    row = (url, (get or request)(url), None)
                except Exception as e:  # noqa: BLE001
                    row = (url, None, f"{type(e).__name__}: {e}"[:300])
                yield pd.DataFrame([row], columns=["url", "html", "error"], dtype="object")

    urls = sources.select("url").where("url is not null").distinct().withColumn("host", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")))
    return urls.repartition("host").mapInPandas(run, "url string, html string, error string")


def page_items(pages: DataFrame, kind: str) -> DataFrame:
    """(url, people, place, item, stopped) of pages (url, people, html); kind is "items", "content", "titles" or "lines". A page that fails gives no item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for url, people, html in zip(p["url"], p["people"], p["html"]):
                parser = PageItems()
                parser.feed(html or "")
                parser.close()
                if kind == "titles":
                    got = [(" ".join(t), False) for t in parser.titles]
                elif kind == "lines":
                    got = [(x.strip(), False) for t in parser.lines for x in t.split("\n")]
                else:
                    got = [(" ".join(i[0]), i[2]) for i in parser.items if kind == "items" or i[1] or kind == "any_content" and not parser.has_content]
                rows += [(url, people, k, text, stopped) for k, (text, stopped) in enumerate(got) if text]
            yield pd.DataFrame(rows, columns=["url", "people", "place", "item", "stopped"])

    return pages.select("url", "people", "html").mapInPandas(run, "url string, people string, place int, item string, stopped boolean")


def _first_per_page(items: DataFrame, most: int = MOST_PER_PAGE) -> DataFrame:
    return items.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("place"))).where(F.col("_r") <= most).drop("_r")


def quote_rule(item: Column) -> Column:
    return ~(item.rlike(whole_words(QUOTE_FURNITURE)) | item.rlike(X.CATEGORY_TRAP)) & ~X.bibliographic(item) & (X.word_count(item) >= 3)


def appendix_rule(item: Column) -> Column:
    return ~item.rlike(whole_words(APPENDIX_FURNITURE)) & (X.word_count(item) >= 3)


def book_rule(item: Column) -> Column:
    return X.word_count(item).between(3, 20) & ~(item.rlike(whole_words(BOOK_FURNITURE)) | item.rlike(LONDON_TRAP)) & X.has_sentence_mark(item)


def archive_rule(item: Column) -> Column:
    return (X.word_count(item) > 3) & X.has_sentence_mark(item)


def _wikiquote(pages: DataFrame) -> DataFrame:
    items = page_items(pages, "any_content").where(~F.col("stopped") & quote_rule(F.col("item")))
    return items.groupBy("url", "item").agg(F.min_by(F.struct("people", "place"), "place").alias("x")).select("url", "x.people", "x.place", "item")


def _book(pages: DataFrame) -> DataFrame:
    return _first_per_page(page_items(pages, "lines").where(book_rule(F.col("item"))))


def _archive(pages: DataFrame) -> DataFrame:
    return _first_per_page(page_items(pages, "items").where(archive_rule(F.col("item"))))


#: type -> (extractor, kind in the source title). Add an entry to read another kind of page.
EXTRACTORS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "wikiquote": (_wikiquote, "Wikiquote"),
    "wiktionary_category": (lambda pages: page_items(pages, "titles"), "Wiktionary Category"),
    "wiktionary_appendix": (lambda pages: page_items(pages, "content").where(appendix_rule(F.col("item"))), "Wiktionary Appendix"),
    "gutenberg_html": (_book, "Gutenberg"),
    "internet_archive_html": (_archive, "InternetArchive"),
}


def build_from_pages(sources: DataFrame, pages: DataFrame, accessed: str) -> tuple[DataFrame, DataFrame]:
    """(sayings rows, skipped sources) from a catalogue (type, people, url) and fetched pages (url, html).

    Skipped are sources of an unknown type and those whose page was not fetched, each with the reason.
    """
    typed = sources.withColumn("type", F.coalesce("type", F.lit("wikiquote")))
    fetched = typed.join(pages.select("url", "html"), "url", "left")
    skipped = fetched.where(~F.col("type").isin(*EXTRACTORS) | F.col("html").isNull()).select("type", "people", "url", F.when(~F.col("type").isin(*EXTRACTORS), "unknown type").otherwise("not fetched").alias("reason"))
    made = None
    for kind, (extract, title) in EXTRACTORS.items():
        rows = as_saying_rows(extract(fetched.where((F.col("type") == kind) & F.col("html").isNotNull())), F.lit(title), accessed)
        made = rows if made is None else made.unionByName(rows)
    return made, skipped


def line_items(df: DataFrame, id_col: str, text_col: str, rule: Callable[[Column], Column], most: int = MOST_PER_PAGE) -> DataFrame:
    """(id, place, item): the lines of plain texts that a rule keeps, at most so many of each text. Done inside the row, in the JVM."""
    lines = F.transform(F.split(text_col, "\n"), lambda raw, i: F.struct(i.alias("place"), F.regexp_replace(raw, rf"^[{S}]+|[{S}]+$", "").alias("item")))
    kept = F.filter(lines, lambda x: (x["item"] != "") & rule(x["item"]))
    return df.select(F.col(id_col).alias("id"), F.inline(F.slice(kept, 1, most)))
