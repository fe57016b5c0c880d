"""Plain texts, EPUB containers, sidecar metadata and web articles."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.functions import text as T
from shiori.functions import vector as V


def sentence_rows(files: DataFrame) -> DataFrame:
    """(file, paragraph_no, sentence_no, text). Paragraphs part at blank lines; wrapped lines are joined."""
    paragraphs = files.select("file", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), r"\n[ \t　]*\n+")).alias("paragraph_no", "paragraph"))
    tidy = F.regexp_replace(F.trim("paragraph"), "[ \t　]+", " ")
    return paragraphs.select("file", "paragraph_no", F.posexplode(T.sentences(tidy)).alias("sentence_no", "text"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _resolve(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0])))


def open_epub(raw: bytes) -> tuple[str | None, str | None, list[str]]:
    """(title, creator, texts in reading order); a broken book is (None, None, [])."""
    try:
        with zipfile.ZipFile(BytesIO(raw)) as z:
            names = z.namelist()
            title = creator = None
            order: list[str] = []
            try:
                box = ElementTree.fromstring(z.read("META-INF/container.xml"))
                root = next(unquote(e.get("full-path", "")) for e in box.iter() if _local(e.tag) == "rootfile")
                opf = ElementTree.fromstring(z.read(posixpath.normpath(root)))
                first = lambda t: next((e.text.strip() for e in opf.iter() if _local(e.tag) == t and e.text and e.text.strip()), None)
                title, creator = first("title"), first("creator")
                items = {e.get("id"): e for e in opf.iter() if _local(e.tag) == "item"}
                for ref in (e for e in opf.iter() if _local(e.tag) == "itemref" and e.get("linear", "yes") != "no"):
                    item = items.get(ref.get("idref"))
                    if item is not None and ("html" in item.get("media-type", "") or re.search(r"\.x?html?$", item.get("href", ""))):
                        order.append(_resolve(root, item.get("href", "")))
            except (KeyError, StopIteration, ElementTree.ParseError):
                pass
            order = [n for n in order if n in names] or sorted(n for n in names if re.search(r"\.x?html?$", n, re.I))
            out = []
            for n in order:
                data = z.read(n)
                m = re.search(rb"encoding=[\"']([\w-]+)|charset=[\"']?([\w-]+)", data[:300])
                said = [(m.group(1) or m.group(2)).decode("ascii")] if m else []
                try:
                    page = V.decode(data, (*said, "utf-8-sig", "cp932"), "replace")
                except LookupError:
                    page = V.decode(data, ("utf-8-sig", "cp932"), "replace")
                out.append(V.html_text(page))
            return title, creator, out
    except (zipfile.BadZipFile, KeyError, OSError):
        return None, None, []


def epub_rows(files: DataFrame) -> DataFrame:
    """(file, title, author, content) of EPUB files given as (file, content binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.sources.texts import open_epub

        for b in batches:
            got = [open_epub(bytes(x)) if x is not None else (None, None, []) for x in b["content"]]
            yield pd.DataFrame({"file": b["file"], "title": [g[0] for g in got], "author": [g[1] for g in got], "content": ["\n\n".join(g[2]) for g in got]})

    return files.select("file", "content").mapInPandas(run, "file string, title string, author string, content string")


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    return epub_rows(raw.select(F.col("path").alias("file"), "content"))


def described(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Title and author of each file from its sidecar (stem, title, author, creator, url), else its stem and host."""
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]+$", "")
    one = sidecars.groupBy("stem").agg(F.first("title").alias("m_title"), F.first(F.coalesce(F.nullif("author", F.lit("")), F.nullif("creator", F.lit("")))).alias("m_author"), F.first("url").alias("url"))
    joined = files.withColumn("stem", stem).join(one, "stem", "left")
    return joined.select("file", F.coalesce(F.nullif("m_title", F.lit("")), V.nfc("stem")).alias("title"), F.coalesce("m_author", T.host(F.col("url"))).alias("author"))


def readable(pages: DataFrame, least: int = 80, share: float = 0.2) -> DataFrame:
    """(page_id, article) of pages whose text is long and Japanese enough."""
    t = pages.select("page_id", V.page_text("html").alias("article"))
    japanese = F.length(F.regexp_replace("article", f"[^{T.JAPANESE[1:]}", ""))
    return t.where((F.length("article") >= least) & (japanese / F.length("article") >= share))
