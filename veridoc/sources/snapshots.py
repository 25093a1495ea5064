"""Readers of the corpus: snapshots, registries and pages of sites."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = """source_slug string, external_id string, url string, title string, question string, answer string, collection string,
    categories array<struct<id:string,name:string>>, audio_url string, fetched_at string, content_sha256 string, language string"""
SOURCE = """slug string, name_ar string, name_en string, base_url string, domains array<string>, status string, priority int,
    ingestion string, corpus_dir string"""
BODY = """id string, name_ar string, name_en string, url string, description_ar string, description_en string, topics array<string>,
    verified_at string, verification_method string, active boolean"""

#: What a page holds and where: field, element, attribute and the value among its words (None: any element of that name).
SELECTORS = {
    "article": ("article", None, None), "title": ("h1", None, None), "question": ("h2", "class", "question"),
    "body": ("article", None, None), "crumb": ("li", "itemprop", "crumb"),
}
BLOCKS = frozenset("p div li blockquote h2 h3 h4 h5 h6 table tr".split())
SILENT = frozenset(("script", "style"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def scan_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """JSON snapshots below ``path``, one record a file, in the order of their file names; ``file`` names the origin."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def _yaml_rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Records of a short YAML list, read where Spark reads; missing fields are null."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    fields = spark.createDataFrame([], schema).schema
    records = (yaml.safe_load(text) or {}).get(key) or []
    shown = lambda v: v if v is None or isinstance(v, (str, bool, int, list)) else str(v)
    return spark.createDataFrame([tuple(shown(r.get(f.name)) for f in fields) for r in records], fields)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The whitelist of sources, some tens of rows, in a YAML list ``sources``."""
    rows = _yaml_rows(spark, path, "sources", SOURCE)
    return rows.withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))


def load_bodies(spark: SparkSession, path: str) -> DataFrame:
    """The bodies that questions are referred to, in a YAML list ``bodies``."""
    return _yaml_rows(spark, path, "bodies", BODY)


class _Page(HTMLParser):
    """Text of the selected elements; block elements and <br> part paragraphs."""

    def __init__(self, selectors: dict):
        super().__init__(convert_charrefs=True)
        self.selectors, self.open, self.done, self.audio = selectors, [], {k: [] for k in selectors}, None
        self.stack: list[tuple[str, list[str]]] = []  # element, fields that began with it

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in BLOCKS or tag == "br":
            self._say("\n")
        if tag == "audio" and self.audio is None and "article" in self.open:
            self.audio = given.get("src")
        if tag in VOID:
            return
        begun = []
        for field, (name, attribute, value) in self.selectors.items():
            if tag == name and field not in self.open and (attribute is None or value in (given.get(attribute) or "").split()):
                if field in ("article", "crumb") or "article" in self.open or "article" in begun:
                    begun.append(field)
                    self.done[field].append([])
        self.open += begun
        self.stack.append((tag, begun))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._say("\n")
        if any(name == tag for name, _ in self.stack):
            while True:
                name, begun = self.stack.pop()
                self.open = [f for f in self.open if f not in begun]
                if name == tag:
                    break

    def handle_data(self, data):
        if not any(name in SILENT for name, _ in self.stack):
            self._say(data)

    def _say(self, text):
        for field in self.open:
            if field != "body" or not {"title", "question"} & set(self.open):
                self.done[field][-1].append(text)


def _clean(text: str) -> str:
    return " ".join(text.replace("\xa0", " ").replace("‏", "").replace("‎", "").replace("\t", " ").split(" ")).strip()


def _single(text: str) -> str:
    return " ".join(w for w in _clean(text).split(" ") if w)


def parse_page(html: str | None, selectors: dict = SELECTORS) -> tuple | None:
    """Title, question, answer paragraphs, collection and audio address of a page; None without article, title or answer."""
    page = _Page(selectors)
    page.feed(html or "")
    page.close()
    first = lambda field: "".join(page.done[field][0]) if page.done[field] else None
    paragraphs = lambda text: [p for p in map(_single, (text or "").split("\n")) if p]
    title, answer = _single((first("title") or "").replace("\n", " ")), paragraphs(first("body"))
    if first("title") is None or not answer:
        return None
    crumbs = page.done["crumb"]
    collection = (_single("".join(crumbs[1]).replace("\n", " ")) or None) if len(crumbs) >= 3 else None
    return title, "\n\n".join(paragraphs(first("question"))), answer, collection, page.audio


def extract_pages(pages: DataFrame, selectors: dict | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, question, answer, collection, audio_url) of pages that hold an article with title and answer; no shuffle.

    ``selectors`` replaces entries of SELECTORS.  ``answer`` is the list of paragraphs.
    """
    chosen = SELECTORS | (selectors or {})

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["title", "question", "answer", "collection", "audio_url"]
        for pdf in frames:
            found = [(i, parse_page(h, chosen)) for i, h in zip(pdf[id_col], pdf[html_col], strict=True)]
            yield pd.DataFrame([(i, *f) for i, f in found if f is not None], columns=[id_col, *names])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(parse, f"{id_col} {kind}, title string, question string, answer array<string>, collection string, audio_url string")
