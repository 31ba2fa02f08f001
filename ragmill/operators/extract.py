"""Text of web pages in bulk: structured text, main content, semantic areas, repeated cards, image text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import written

BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "section", "article", "td", "ul", "ol", "table", "main", "body"}
DROPPED = {"script", "style", "nav", "footer", "header"}
VOID = {"br", "img", "hr", "meta", "link", "input"}


def small_batches(spark: SparkSession, rows: int = 100) -> None:
    """Pages are long: Arrow batches of `rows` at most keep a Python worker's memory to a few megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


class _Text(HTMLParser):
    """Text with line feeds after blocks and marks before headings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "br":
            self.out.append("\n")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n" + "#" * int(tag[1]) + " ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def structured(pages: DataFrame) -> DataFrame:
    """page_id, text: with line feeds after blocks, # marks before headings, runs of line feeds and spaces shortened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for html in batch["html"]:
                p = _Text()
                p.feed(html or "")
                p.close()
                out.append(re.sub(r"[ \t]{2,}", " ", re.sub(r"\n\s*\n\s*\n+", "\n\n", "".join(p.out))).strip())
            yield pd.DataFrame({"page_id": batch["page_id"], "text": out})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


class _Blocks(HTMLParser):
    """Blocks of a page: tag, class, text, link text, number of children, places of the start tag and its parent's, first title inside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.blocks: list[dict] = []
        self.hidden = self.link = self.opened = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.hidden += 1
        if tag == "a":
            self.link += 1
        if tag in VOID:
            return
        if self.stack:
            self.stack[-1]["children"] += 1
        name = (dict(attrs).get("class") or "").strip()
        block = {"tag": tag, "class": name, "text": [], "link": 0, "children": 0, "title": None, "drop": self.hidden > 0, "start": self.opened, "up": self.stack[-1]["start"] if self.stack else -1}
        self.opened += 1
        if not self.hidden and (re.fullmatch("h[1-6]|strong", tag) or re.search("[tT]itle|[nN]ame", name)):
            for up in self.stack:
                up["title"] = up["title"] or block
        self.stack.append(block)

    def handle_endtag(self, tag):
        if not any(b["tag"] == tag for b in self.stack):
            return
        while self.stack:
            b = self.stack.pop()
            text = b["words"] = " ".join("".join(b["text"]).split())
            if b["tag"] in DROPPED:
                self.hidden = max(0, self.hidden - 1)
            if b["tag"] == "a":
                self.link = max(0, self.link - 1)
            if not b["drop"]:
                self.blocks.append({**b, "text": text, "title": b["title"]["words"] if b["title"] else ""})
                if self.stack:
                    up = self.stack[-1]
                    up["text"] += [" ", *b["text"], " "]
                    up["link"] += b["link"]
            if b["tag"] == tag:
                break

    def handle_data(self, data):
        if not self.hidden and self.stack:
            self.stack[-1]["text"].append(data)
            if self.link:
                self.stack[-1]["link"] += len(data.strip())


BLOCK = "page_id long, pos int, tag string, class string, title string, text string, link_chars int, children int, start int, up int"


def blocks(pages: DataFrame) -> DataFrame:
    """A row for each closed element of each page outside navigation, header, footer, script and style.

    An element holds its descendants' text, so a page's rows are many times its size: a worker has those of few at once.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                p = _Blocks()
                p.feed(html or "")
                p.close()
                out += [(page_id, i, b["tag"], b["class"], b["title"], b["text"], b["link"], b["children"], b["start"], b["up"]) for i, b in enumerate(p.blocks)]
                size += sum(len(b["text"]) for b in p.blocks)
                if size > 4_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in BLOCK.split(", ")]
    return pages.select("page_id", "html").mapInPandas(run, BLOCK)


CONTAINERS = ("div", "article", "section", "main", "td", "body")


def densest(rows: DataFrame) -> DataFrame:
    """page_id, text, score of blocks: the container with the most characters outside links, less those of links twice.

    Of nested containers the inner one that keeps nine tenths of the score.
    """
    rows = rows.where(F.col("tag").isin(*CONTAINERS) & (F.length("text") > 0))
    rows = rows.withColumn("score", (F.length("text") - 3 * F.col("link_chars")).cast("double"))
    top = rows.groupBy("page_id").agg(F.max("score").alias("top"))
    best = rows.join(top.hint("merge"), "page_id").where(F.col("score") >= 0.9 * F.col("top"))
    return best.groupBy("page_id").agg(F.min_by(F.struct("text", "score"), "pos").alias("b")).select("page_id", "b.*")


def handed_up(rows: DataFrame, least: int = 25) -> DataFrame:
    """page_id, start, up, text, score of the elements that hold paragraphs, from blocks.

    A paragraph (p, td, pre) of `least` characters or more counts 1, one more for each comma and for each hundred
    characters, three at most of these. Its parent gets all of that and the parent's parent half. An element's score is
    what it got, with 5 for a div and 3 for a cell or quotation, times the share of its text outside links.
    """
    n = F.length("text")
    worth = 1 + F.regexp_count("text", F.lit("[,，、]")) + F.least(F.floor(n / 100), F.lit(3))
    parts = rows.where(F.col("tag").isin("p", "td", "pre") & (n >= least)).select("page_id", "up", worth.cast("double").alias("worth"))
    above = rows.select("page_id", F.col("start").alias("up"), F.col("up").alias("top"))
    gifts = parts.join(above.hint("merge"), ["page_id", "up"], "left").select("page_id", F.explode(F.array(F.struct(F.col("up").alias("start"), "worth"), F.struct(F.col("top").alias("start"), (F.col("worth") / 2).alias("worth")))).alias("g"))
    sums = gifts.select("page_id", "g.*").where("start >= 0").groupBy("page_id", "start").agg(F.sum("worth").alias("got"))
    base = F.when(F.col("tag") == "div", 5.0).when(F.col("tag").isin("td", "blockquote"), 3.0).otherwise(0.0)
    share = 1 - F.least(F.lit(1.0), F.col("link_chars") / F.greatest(F.length("text"), F.lit(1)))
    held = sums.join(rows.select("page_id", "start", "up", "tag", "text", "link_chars").hint("merge"), ["page_id", "start"])
    return held.select("page_id", "start", "up", "text", ((F.col("got") + base) * share).alias("score"))


def main_content(pages: DataFrame, most: int = 100_000) -> DataFrame:
    """page_id, title, text, score: the element that its paragraphs give the best score, with its like among its siblings.

    Siblings stay in the order of the page and are those with a fifth of the best score, 10 at least. Pages without
    paragraphs get their densest container. Our own scoring after the published one, not a readability library's.
    """
    rows = written(blocks(pages), "blocks")
    scored = written(handed_up(rows), "scored")
    best = scored.groupBy("page_id").agg(F.max_by(F.struct("start", "up", "score"), F.struct("score", -F.col("start"))).alias("b"))
    best = best.select("page_id", F.col("b.start").alias("best"), F.col("b.up").alias("up"), F.col("b.score").alias("top"))
    near = scored.join(best.hint("merge"), ["page_id", "up"]).where((F.col("start") == F.col("best")) | (F.col("score") >= F.greatest(F.lit(10.0), F.col("top") / 5)))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"])
    found = near.groupBy("page_id").agg(F.array_join(in_order, "\n\n").alias("text"), F.max("top").alias("score"))
    rest = densest(rows.join(found.select("page_id").hint("merge"), "page_id", "left_anti"))
    both = found.unionByName(rest)
    titles = pages.select("page_id", T.html_title(F.col("html")).alias("title"))
    return titles.join(both.hint("merge"), "page_id", "left").select("page_id", "title", T.clip(F.coalesce("text", F.lit("")), most).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))


TAG = "<[/a-zA-Z][^>]*>"


def elements(pages: DataFrame) -> DataFrame:
    """page_id, pos, name, attributes, start, end of every element of `pages` (page_id, html), by windows over its tags.

    start and end are offsets of what stands between its tags. Tags of a name are numbered by how many of that name are
    open, and an opening tag is closed by the next one of its number, so elements may hold others of their kind. What
    is never closed ends with the page; closing tags without an opening one are no elements.
    """
    tags, parts = F.regexp_extract_all("html", F.lit(TAG), F.lit(0)), F.split("html", TAG)
    rows = pages.select("page_id", F.length("html").alias("size"), F.posexplode(F.arrays_zip(tags.alias("tag"), F.slice(parts, 1, F.size(tags)).alias("before"))).alias("pos", "x"))
    order = Window.partitionBy("page_id").orderBy("pos")
    after = F.sum(F.length("x.before") + F.length("x.tag")).over(order)
    rows = rows.select("page_id", "size", "pos", F.col("x.tag").alias("tag"), after.cast("int").alias("after"))
    rows = rows.withColumns({"name": F.lower(F.regexp_extract("tag", "</?([a-zA-Z][a-zA-Z0-9]*)", 1)), "opens": ~F.startswith("tag", F.lit("</"))})
    rows = rows.where(~F.col("name").isin(*sorted(VOID)) & ~F.endswith("tag", F.lit("/>")))
    open_ = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(Window.partitionBy("page_id", "name").orderBy("pos"))
    rows = rows.withColumn("level", open_ + F.when(F.col("opens"), 0).otherwise(1))
    same = Window.partitionBy("page_id", "name", "level").orderBy("pos")
    end = F.lead(F.when(~F.col("opens"), F.col("after") - F.length("tag"))).over(same)
    rows = rows.select("*", F.coalesce(end, "size").alias("end")).where("opens")
    return rows.select("page_id", "pos", "name", F.regexp_extract("tag", r"(?s)^<[a-zA-Z0-9]+(.*)>$", 1).alias("attributes"), F.col("after").alias("start"), "end")


def semantic_area(pages: DataFrame, least: int = 50) -> DataFrame:
    """page_id, text of the first of main, role=main, article and the usual content classes with over `least` characters.

    All elements of that kind are joined in order, those inside others of it too, each with all that it holds.
    """
    value = lambda key: F.regexp_extract("attributes", rf"""(?i)(?:^|\s){key}\s*=\s*["']?([^"'>]*)""", 1)
    classes = F.split(value("class"), r"\s+")
    kinds = [F.col("name") == "main", F.trim(value("role")) == "main", F.col("name") == "article"]
    kinds += [F.array_contains(classes, c) for c in ("content", "main-content", "post-content", "article-content", "page-content")]
    ranks = F.array_compact(F.array(*[F.when(k, i) for i, k in enumerate(kinds)]))
    plain = pages.select("page_id", F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "").alias("html"))
    found = elements(plain).where(F.col("end") - F.col("start") > least).select("page_id", "pos", "start", "end", F.explode(ranks).alias("rank"))
    spans = found.groupBy("page_id", "rank").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end"))).alias("spans"))
    first = spans.groupBy("page_id").agg(F.min_by("spans", "rank").alias("spans"))
    texts = F.transform("spans", lambda s: T.tags_to_space(F.substring("html", s["start"] + 1, s["end"] - s["start"])))
    return plain.join(first.hint("merge"), "page_id").select("page_id", F.array_join(texts, "\n\n").alias("text"))


def cards(pages: DataFrame, least: int = 3) -> DataFrame:
    """page_id, class, n_cards, text: repeated elements of the class that scores best by count * 10 + min(text length, 500).

    A class attribute of div, li, article or section counts with over 5 characters, no navigation word in it and `least`
    elements. Its first element, of any tag with all its names, needs two children and gives the text length; ties go to
    the class that comes first. Elements with all its names and over 30 characters are the cards, written as `## title`
    and body; a page has two at least or no row. The title is the first heading, strong or element of a title or name class.
    """
    # read twice: to choose classes, and for the elements of those chosen
    rows = written(blocks(pages).where("class <> ''"), "blocks")
    names = F.array_distinct(F.split("class", r"\s+"))
    usable = F.col("tag").isin("div", "li", "article", "section") & (F.length("class") > 5) & ~F.col("class").rlike("header|footer|nav|menu|sidebar")
    groups = rows.where(usable).groupBy("page_id", "class").agg(F.count("*").alias("n"), F.min("start").alias("first")).where(F.col("n") >= least)
    groups = groups.select("page_id", "class", "n", "first", names.alias("names"))
    parts = rows.select("page_id", F.explode(names).alias("name"), names.alias("own"), "start", "title", "text", "children")

    def members(chosen: DataFrame) -> DataFrame:
        """Elements with all names of a chosen class: they share its first name, then the others are looked up."""
        keyed = chosen.withColumn("name", F.col("names")[0])
        return keyed.join(parts.hint("shuffle_hash"), ["page_id", "name"]).where(F.size(F.array_except("names", "own")) == 0)

    sample = members(groups).groupBy("page_id", "class", "n", "first", "names").agg(F.min_by(F.struct("children", F.length("text").alias("size")), "start").alias("s"))
    scored = sample.where("s.children >= 2").withColumn("score", F.col("n") * 10 + F.least("s.size", F.lit(500)))
    best = scored.groupBy("page_id").agg(F.min_by(F.struct("class", "names"), F.struct(-F.col("score"), "first")).alias("b")).select("page_id", "b.*")
    body = F.when(F.startswith("text", F.col("title")), F.trim(F.expr("substr(text, length(title) + 1)"))).otherwise(F.col("text"))
    card = F.concat(F.lit("## "), "title", F.when(F.length(body) > 0, F.concat(F.lit("\n"), body)).otherwise(""))
    kept = members(best).where(F.length("text") > 30).select("page_id", "class", "start", card.alias("card"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("start", "card"))), lambda x: x["card"])
    return kept.groupBy("page_id", "class").agg(F.count("*").alias("n_cards"), F.array_join(in_order, "\n\n---\n\n").alias("text")).where("n_cards >= 2")


def ladder(candidates: DataFrame) -> DataFrame:
    """Candidates (readable, cards, semantic, visible) with text and method: readable from 500 characters, cards over 200, else the longest of the rest."""
    n = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    top = F.greatest(n("readable"), n("semantic"), n("visible"))
    method = F.when(n("readable") >= 500, "readability").when(n("cards") > 200, "cards").when(top == 0, "error").when(n("readable") == top, "readability").when(n("semantic") == top, "semantic").otherwise("visible")
    rows = candidates.withColumn("method", method)
    return rows.withColumn("text", F.when(F.col("method") == "readability", F.col("readable")).when(F.col("method") == "cards", F.col("cards")).when(F.col("method") == "semantic", F.col("semantic")).when(F.col("method") == "visible", F.col("visible")))


def enrich_pages(pages: DataFrame, images: DataFrame) -> DataFrame:
    """document_id, text: pages (document_id, page, page_text) with the text found in their images appended, joined in order."""
    block = F.concat(F.lit("[图片 "), F.col("image_index").cast("string"), F.lit(" 识别内容]\n"), "extracted_text")
    extra = images.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_index", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("extra"))
    full = F.concat("page_text", F.when(F.col("extra").isNotNull(), F.concat(F.lit("\n\n"), "extra")).otherwise(""))
    rows = pages.join(extra, ["document_id", "page"], "left").select("document_id", "page", full.alias("t"))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def image_chunks(images: DataFrame, pages: DataFrame, counts: DataFrame, context: int = 800) -> DataFrame:
    """Chunk rows of images: described by page, found text and the page's first characters; indices continue after the text's parents and subs."""
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "image_index")) - 1
    content = F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页图片\n"), "extracted_text", F.lit("\n"), F.substring("page_text", 1, context))
    rows = images.join(pages, ["document_id", "page"]).join(counts, "document_id").withColumn("nth", nth)
    return rows.select("document_id", (F.col("ups") + F.col("nth")).cast("int").alias("parent_index"), (F.col("subs") + F.col("nth")).cast("int").alias("chunk_index"), content.alias("content"), F.length(content).alias("token_count"))
