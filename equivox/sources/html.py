"""HTML and EPUB sources.  Python reads the markup; the rest is DataFrame work."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equivox.functions.text import clean
from equivox.operators.segment import fill_forward, units
from equivox.sources.batches import small_batches

# fixed values
FHIR_PAGES = ("datatypes", "json", "xml", "formats", "search", "http", "references", "extensibility", "terminologies", "narrative", "resource", "element", "datatypes-definitions", "search_filter", "codesystem", "valueset", "bundle")
EPUB_SKIP = r"(?i)cover|title|language|recommendation|foreword|contents|intro|biblio|series"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = "path string, pos int, tag string, cls string, id string, section string, section_title string, tbl string, in_main boolean, text string"


class Walker(HTMLParser):
    """Blocks of p, li and headings in the order they begin, with the nearest section and table whose
    division holds an anchor."""

    def __init__(self, main_id: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.main_id, self.open, self.blocks, self.skipping = main_id, [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.skipping += 1
        if tag in ("p", "li"):
            self.close({tag} if tag == "li" else {"p"}, stop={"ul", "ol", "div", "td", "section", "body"} | ({"li"} if tag == "p" else set()))
        if tag == "a" and (name := a.get("id") or a.get("name")):
            for kind, field in (("sect_", "sect"), ("table_", "tbl")):
                if name.startswith(kind):
                    for node in reversed(self.open):
                        wanted = "section" if field == "sect" else "table"
                        if node["tag"] == "div" and wanted in node["cls"].split():
                            node.setdefault(field, name[len(kind):])
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        node = {"tag": tag, "cls": a.get("class", ""), "id": a.get("id", ""), "block": None}
        if tag in ("p", "li", *HEADINGS):
            up = [n for n in self.open if n["tag"] == "div"]
            node["block"] = {"tag": tag, "cls": node["cls"], "id": node["id"], "divs": up, "parts": [], "main": self.main_id is None or any(n["id"] == self.main_id for n in self.open)}
            self.blocks.append(node["block"])
        self.open.append(node)

    def close(self, tags: set, stop: set = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] in tags:
                del self.open[k:]
                return
            if self.open[k]["tag"] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.skipping:
            self.skipping -= 1
        if tag not in VOID:
            self.close({tag})

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            for node in self.open:
                if node["block"] is not None:
                    node["block"]["parts"].append(data)


def walk(path: str, html: str, main_id: str | None) -> Iterator[tuple]:
    w = Walker(main_id)
    w.feed(html or "")
    w.close(set())
    titles: dict[int, str] = {}
    for block in w.blocks:
        text = " ".join("".join(block["parts"]).split())
        if block["tag"] in HEADINGS:
            for div in reversed(block["divs"]):
                if "section" in div["cls"].split():
                    titles.setdefault(id(div), re.sub(r"^[A-Z]?\d*(?:\.\d+)*\s*", "", text))
                    break
    has_main = any(b["main"] for b in w.blocks)
    for pos, block in enumerate(w.blocks):
        section = next((d for d in reversed(block["divs"]) if "section" in d["cls"].split() and "sect" in d), None)
        tbl = next((d["tbl"] for d in reversed(block["divs"]) if "table" in d["cls"].split() and "tbl" in d), None)
        yield path, pos, block["tag"], block["cls"], block["id"], section["sect"] if section else None, titles.get(id(section), "") if section else None, tbl, block["main"] or not has_main, " ".join("".join(block["parts"]).split())


PIECE = 1 << 20  # characters of text that leave Python at once, and the block they end in


def frames(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size, so that memory follows neither the rows of a batch nor their blocks."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 256 + sum(len(v) for v in row if isinstance(v, str))
        if size >= PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, one at a time: no second copy of a batch in Python."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(column[at].as_py() for column in batch.columns)


def mapped(rows: DataFrame, read: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """read over each row.  Batches to Python hold at most 4 MiB and a row, unless the session has a setting of its own."""
    small_batches(rows.sparkSession)
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    form = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return frames((out for row in each(batches) for out in read(*row)), form)

    return rows.mapInArrow(run, schema)


def html_blocks(pages: DataFrame, main_id: str | None = None) -> DataFrame:
    """pages(path, html) -> BLOCKS."""
    return mapped(pages.select("path", "html"), lambda path, html: walk(path, html, main_id), BLOCKS)


def docbook(pages: DataFrame, label: str, least: int = 25) -> DataFrame:
    """pages(path, html) -> units: p and li by their nearest section and table; front matter goes."""
    b = html_blocks(pages).where(F.col("tag").isin("p", "li") & F.col("section").isNotNull())
    b = b.select(F.col("path").alias("source_id"), "pos", "section", "section_title", F.col("tbl").alias("subref"), "text", F.lit(False).alias("is_list"))
    anchor = F.when(F.col("subref").isNotNull(), F.concat(F.lit(f"{label} Table "), "subref")).otherwise(F.concat(F.lit(f"{label} "), "section"))
    return units(b, F.lit(label), F.lit(label), least, anchor, by_subref=True)


def fhir_site(pages: DataFrame, label: str, stems: tuple[str, ...] = FHIR_PAGES, least: int = 25) -> DataFrame:
    """pages(path, html) -> units: numbered headings set section and title, others the title only; subref is the page."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.html?$", "")
    kept = pages.withColumn("path", stem).where(F.col("path").isin(*stems)) if stems else pages.withColumn("path", stem)
    b = html_blocks(kept, "segment-content").where("in_main and tag in ('h1','h2','h3','h4','h5','p','li')")
    heading, number = F.col("tag").startswith("h"), F.regexp_extract("text", r"^(\d+(?:\.\d+)+)\s+", 1)
    title = F.when(number != "", F.regexp_replace("text", r"^\d+(?:\.\d+)+\s+", "")).otherwise(F.substring("text", 1, 80))
    b = fill_forward(b, F.when(heading & (number != ""), number), ["path"], ["pos"], "sec", F.lit("0"))
    b = fill_forward(b, F.when(heading, title), ["path"], ["pos"], "title", F.col("path"))
    b = b.where(~heading).select(F.col("path").alias("source_id"), "pos", F.col("sec").alias("section"), F.col("title").alias("section_title"), F.concat("path", F.lit(".html")).alias("subref"), "text", F.lit(False).alias("is_list"))
    return units(b, F.lit(label), F.concat_ws(":", F.regexp_replace(F.lit(label), " ", "-"), "source_id"), least, F.concat(F.lit(f"{label} "), "subref", F.lit("#"), "section"))


def spine(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(position, file name, XHTML) of an EPUB's documents in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strip = lambda t: t.rpartition("}")[2]
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if strip(e.tag) == "rootfile")
        package, folder = ElementTree.fromstring(z.read(opf)), opf.rpartition("/")[0]
        items = {e.get("id"): e.get("href") for e in package.iter() if strip(e.tag) == "item"}
        for k, e in enumerate(e for e in package.iter() if strip(e.tag) == "itemref"):
            name = items[e.get("idref")]
            yield k, name.rpartition("/")[2], z.read(f"{folder}/{name}" if folder else name).decode("utf-8", "replace")


def epub(books: DataFrame, label: str, skip: str = EPUB_SKIP, least: int = 25) -> DataFrame:
    """books(path, content binary) -> units; subref is the file within the book."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        for k, file, xhtml in spine(content):
            for row in walk(path, xhtml, None):
                yield (f"{path}#{k:05d}#{file}", *row[1:])

    name = F.regexp_extract("path", "#([^#]*)$", 1)
    b = mapped(books.select("path", "content"), read, BLOCKS).where(~name.rlike(skip))
    by_id = F.when(F.col("id").rlike(r"^sec_\w+$"), F.regexp_replace(F.regexp_replace("id", "^sec_", ""), "_", "."))
    marked = F.col("cls").rlike(r"(^|\s)h\d") | F.col("tag").startswith("h")
    titled = F.col("cls").rlike(r"(^|\s)tit\d?(\s|$)")
    number = F.nullif(F.regexp_extract("text", r"^([A-Z]?\d+(?:\.\d+)*)\s+", 1), F.lit(""))
    section = F.coalesce(by_id, F.when(marked, number))
    title = F.when(section.isNotNull() | marked, F.regexp_replace("text", r"^[A-Z]?\d+(?:\.\d+)*\s+", "")).when(titled, F.split("text", r" \(")[0])
    seed = F.coalesce(F.nullif(F.regexp_extract(name, "Annex([A-Z])", 1), F.lit("")), F.regexp_replace(name, r"\.xhtml$", ""))
    is_heading = section.isNotNull() | marked | titled
    b = b.withColumns({"_heading": is_heading, "_sec": section, "_title": title})
    b = fill_forward(b, F.col("_sec"), ["path"], ["pos"], "sec", seed)
    b = fill_forward(b, F.col("_title"), ["path"], ["pos"], "ttl", F.lit(""))
    b = b.where("not _heading").select(F.col("path").alias("source_id"), "pos", F.col("sec").alias("section"), F.col("ttl").alias("section_title"), name.alias("subref"), "text", F.lit(False).alias("is_list"))
    return units(b, F.lit(label), F.lit(label), least)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


INLINE = r"</?(?:a|abbr|b|bdi|bdo|big|br|cite|code|dfn|em|font|i|img|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var)(?:[ /][^>]*)?>"


def section_fill(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> (page_id, pos, tag, text, title): blocks of h1-h5, p and li by pattern, for well
    marked pages, each up to the next tag that is not inline, without its tags, with the latest heading; all JVM-side."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(plain, F.lit(rf"(?s)<(?:h[1-5]|p|li)(?: [^>]*)?>[^<]*+(?:{INLINE}[^<]*+)*+"), F.lit(0))
    b = pages.select("page_id", F.posexplode(found).alias("pos", "raw"))
    b = b.select("page_id", "pos", F.regexp_extract("raw", r"^<(h[1-5]|p|li)", 1).alias("tag"), clean(F.regexp_replace(F.regexp_replace("raw", "<br[ /]*>", " "), "<[^>]*>", "")).alias("text"))
    return fill_forward(b, F.when(F.col("tag").startswith("h"), F.col("text")), ["page_id"], ["pos"], "title")


def block_fill(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> (page_id, pos, tag, text, title): blocks of h1-h5, p and li that have text, each
    with its whole text whatever is marked within, and the latest heading of its page."""

    def read(page_id: int | None, page: str | None) -> Iterator[tuple]:
        title, pos = None, 0
        for _, _, tag, *_, text in walk("", page, None):
            if tag == "h6" or not text:
                continue
            title = text if tag in HEADINGS else title
            yield page_id, pos, tag, text, title
            pos += 1

    return mapped(pages.select(F.col("page_id").cast("long"), "html"), read, "page_id long, pos int, tag string, text string, title string")
