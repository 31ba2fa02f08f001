"""Queries of text extraction over the pages table, and of reply parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .base import query

LINES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({h}, '<br\s*/?>', chr(10), 'gi'), '</(p|div|h[1-6]|li|tr)>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
CLEAN = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    CLEAN = rf"regexp_replace({CLEAN}, '<{_tag}\b.*?</{_tag}>', '', 'gis')"


@query("txt01_normal_url", "select page_id, case when regexp_matches(trim(u), '^https?://') then trim(u) else 'https://' || trim(u) end as url from (select page_id, case when page_id % 2 = 0 then url else ' ' || regexp_replace(url, '^https?://', '') || ' ' end as u from pages)")
def txt01(t):
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit(" "), F.regexp_replace("url", "^https?://", ""), F.lit(" ")))
    return t.pages.select("page_id", T.normal_url(u).alias("url"))


@query("txt02_valid_url", "select page_id, length(u) > 0 and contains(u, '.') and not contains(u, ' ') as valid from (select page_id, trim(case page_id % 4 when 0 then url when 1 then replace(url, '.', '') when 2 then url || ' x' else '' end) as u from pages)")
def txt02(t):
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.col("url")).when(k == 1, F.replace("url", F.lit("."), F.lit(""))).when(k == 2, F.concat("url", F.lit(" x"))).otherwise("")
    return t.pages.select("page_id", T.valid_url(u).alias("valid"))


@query("txt03_url_outcome", """u as (select page_id as id, page_id % 3 as user_id, case when page_id % 11 = 0 then 'nothing' else regexp_replace(url, '[0-9].*$', '') end as url from pages),
    v as (select *, contains(trim(url), '.') and not contains(trim(url), ' ') as valid, case when regexp_matches(trim(url), '^https?://') then trim(url) else 'https://' || trim(url) end as u from u),
    k as (select distinct user_id, u from v where id % 10 = 7)
    select id, v.user_id, v.u as url, case when not valid then 'error' when row_number() over (partition by v.user_id, v.u order by id) > 1 or k.u is not null then 'duplicate' else 'ok' end as outcome from v left join k on k.user_id = v.user_id and k.u = v.u""")  # fmt: skip
def txt03(t):
    from ..operators.catalog import url_outcome

    u = F.when(F.col("page_id") % 11 == 0, "nothing").otherwise(F.regexp_replace("url", "[0-9].*$", ""))
    rows = t.pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 3).alias("user_id"), u.alias("url"))
    return url_outcome(rows, rows.where("id % 10 = 7").withColumn("url", T.normal_url(F.col("url"))))


@query("txt04_strip_tags", "select page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) as text_md5 from pages")
def txt04(t):
    return t.pages.select("page_id", F.md5(T.tags_to_space(F.col("html"))).alias("text_md5"))


@query("txt05_html_lines", f"select page_id, md5({LINES.format(h='html')}) as text_md5 from pages")
def txt05(t):
    return t.pages.select("page_id", F.md5(T.html_lines(F.col("html"))).alias("text_md5"))


@query("txt06_structured_text")
def txt06(t):
    from ..operators.extract import structured

    return structured(t.pages).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("txt07_boilerplate", rf"select page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) as title, md5({CLEAN}) as body_md5 from pages")
def txt07(t):
    return t.pages.select("page_id", T.html_title(F.col("html")).alias("title"), F.md5(T.without_boilerplate(F.col("html"))).alias("body_md5"))


@query("txt08_main_content")
def txt08(t):
    from ..operators.extract import main_content

    return main_content(t.pages).select("page_id", "title", F.length("text").alias("n_chars"), "score")


@query("txt09_semantic_area", rf"select page_id, md5(regexp_replace(regexp_extract(html, '<article\b[^>]*>(.*?)</article>', 1, 'is'), '<[^>]+>', ' ', 'g')) as text_md5 from pages where length(regexp_extract(html, '<article\b[^>]*>(.*?)</article>', 1, 'is')) > 50")
def txt09(t):
    from ..operators.extract import semantic_area

    return semantic_area(t.pages).select("page_id", F.md5("text").alias("text_md5"))


@query("txt09_nested_areas", r"""w as (select page_id, html, page_id % 4 as k, '<div class="x"><div>' || md5(url) || '</div>' || repeat('lead ', 12) || '</div>' as nest from pages)
    select page_id, case k when 0 then regexp_replace(nest || 'tail <p>end</p>', '<[^>]+>', ' ', 'g') when 1 then regexp_replace('a<article>' || nest || '</article>b', '<[^>]+>', ' ', 'g') || chr(10) || chr(10) || regexp_replace(nest, '<[^>]+>', ' ', 'g')
    when 2 then regexp_replace(nest || nest, '<[^>]+>', ' ', 'g') else regexp_replace(nest, '<[^>]+>', ' ', 'g') end as text from w""")  # fmt: skip
def txt09_nested(t):
    """Pages written from the given ones whose content holds elements of its own kind: main, article, role and class."""
    from ..operators.extract import semantic_area

    nest = F.concat(F.lit('<div class="x"><div>'), F.md5("url"), F.lit("</div>"), F.repeat(F.lit("lead "), F.lit(12)), F.lit("</div>"))
    k, text = F.col("page_id") % 4, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    html = F.when(k == 0, text("<body><article>", nest, "</article><main id=m>", nest, "tail <p>end</p></main></body>"))
    html = html.when(k == 1, text("<article>a<article>", nest, "</article>b</article><div class='content'>", nest, "</div>"))
    html = html.when(k == 2, text('<div class="content">', nest, '</div><section ROLE="main">', nest, nest, "</section><!-- <main>", nest, "</main> -->"))
    html = html.otherwise(text("<div><section class='wide post-content'>", nest, "</section></div><main>short</main><br/>"))
    return semantic_area(t.pages.select("page_id", html.alias("html")))


@query("txt10_cards")
def txt10(t):
    from ..operators.extract import cards

    return cards(t.pages).select("page_id", "class", "n_cards", F.length("text").alias("n_chars"))


@query("txt10_card_pages", """select doc_id // 4 as page_id, 'doc-card' as class, count(*) as n_cards, string_agg('## Doc ' || doc_id || chr(10) || lang || ' ' || source || ' ' || md5(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by doc_id) as text
    from documents group by 1 having count(*) >= 3""")  # fmt: skip
def txt10_pages(t):
    """Cards of pages that each list four neighbouring documents."""
    from ..operators.extract import cards

    item = F.concat(F.lit('<li class="doc-card"><h3>Doc '), F.col("doc_id").cast("string"), F.lit("</h3><p>"), F.concat_ws(" ", "lang", "source", F.md5("text")), F.lit("</p></li>"))
    items = F.array_sort(F.collect_list(F.struct("doc_id", item.alias("html"))))
    pages = t.documents.groupBy(F.floor(F.col("doc_id") / 4).alias("page_id")).agg(F.array_join(F.transform(items, lambda x: x["html"]), "").alias("html"))
    return cards(pages.select("page_id", F.concat(F.lit("<ul>"), "html", F.lit("</ul>")).alias("html")))


LADDER = rf"""area as (select page_id, regexp_extract(html, '<article\b[^>]*>(.*?)</article>', 1, 'is') as a from pages),
    c as (select page_id, case when length(a) > 50 then regexp_replace(a, '<[^>]+>', ' ', 'g') else '' end as semantic, trim(regexp_replace(html, '<[^>]+>', ' ', 'g')) as visible, {LINES.format(h=CLEAN)} as readable from pages join area using (page_id))
    select page_id, case when length(readable) >= 500 then 'readability' when greatest(length(readable), length(semantic), length(visible)) = 0 then 'error' when length(readable) >= greatest(length(semantic), length(visible)) then 'readability'
        when length(semantic) >= length(visible) then 'semantic' else 'visible' end as method from c"""


@query("txt11_ladder", LADDER)
def txt11(t):
    """Candidates of every kind; the given pages hold no repeated cards, as the SQL takes for granted."""
    from ..operators.extract import cards, ladder, semantic_area

    found = cards(t.pages).select("page_id", F.col("text").alias("cards"))
    area = semantic_area(t.pages).select("page_id", F.col("text").alias("semantic"))
    c = t.pages.select("page_id", T.html_lines(T.without_boilerplate(F.col("html"))).alias("readable"), F.trim(T.tags_to_space(F.col("html"))).alias("visible"))
    return ladder(c.join(found.hint("merge"), "page_id", "left").join(area, "page_id", "left")).select("page_id", "method")


@query("txt12_visible_lines", r"""l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) as l from documents),
    k as (select doc_id, array_to_string(list_filter(l, lambda x: length(x) = 0 or (length(x) > 1 and not regexp_matches(x, '^[0-9]+$') and not (length(x) < 40 and regexp_matches(x, '^(Copyright|©|All Rights|京ICP|沪ICP|粤ICP|Powered by|Created by)')))), chr(10)) as x from l)
    select doc_id, md5(trim(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), chr(10))) as text_md5 from k""")  # fmt: skip
def txt12(t):
    return t.documents.select("doc_id", F.md5(T.visible_lines(F.col("text"))).alias("text_md5"))


@query("txt13_length_cap", "select doc_id, case when length(text) > 2000 then substr(text, 1, 2000) || '...(内容已截断)' else text end as text from documents")
def txt13(t):
    return t.documents.select("doc_id", T.clip(F.col("text"), 2000).alias("text"))


IMAGES = r"""images as (select doc_id as document_id, 1 as page, 1 as image_index, lang as extracted_text, text from documents where doc_id % 4 = 0 union all select doc_id, 1, 2, source, text from documents where doc_id % 8 = 0)"""


@query("txt14_image_text", IMAGES + r""", j as (select document_id, page, string_agg('[图片 ' || image_index || ' 识别内容]' || chr(10) || extracted_text, chr(10) || chr(10) order by image_index) as extra from images group by all)
    select d.doc_id as document_id, md5(d.text || coalesce(chr(10) || chr(10) || extra, '')) as text_md5 from documents d left join j on j.document_id = d.doc_id""")  # fmt: skip
def txt14(t):
    from ..operators.extract import enrich_pages

    pages = t.documents.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.col("text").alias("page_text"))
    return enrich_pages(pages, image_rows(t)).select("document_id", F.md5("text").alias("text_md5"))


def image_rows(t):
    one = t.documents.where("doc_id % 4 = 0").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.lit(1).alias("image_index"), F.col("lang").alias("extracted_text"))
    two = t.documents.where("doc_id % 8 = 0").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.lit(2).alias("image_index"), F.col("source").alias("extracted_text"))
    return one.unionByName(two)


@query("txt15_image_chunks", IMAGES + r""", n as (select doc_id as document_id, cast(ceil(greatest(length(text) - 700, 0) / 600.0) as bigint) + 1 as subs, cast(ceil(greatest(length(text) - 2200, 0) / 1950.0) as bigint) + 1 as ups from documents where length(text) > 0),
    x as (select i.document_id, image_index, '第 ' || page || ' 页图片' || chr(10) || extracted_text || chr(10) || substr(text, 1, 800) as content, subs, ups from images i join n using (document_id))
    select document_id, cast(ups + row_number() over w - 1 as int) as parent_index, cast(subs + row_number() over w - 1 as int) as chunk_index, md5(content) as content_md5, length(content) as token_count from x window w as (partition by document_id order by image_index)""")  # fmt: skip
def txt15(t):
    from ..operators import chunk
    from ..operators.extract import image_chunks

    docs = t.docs.select("document_id", "text")
    counts = chunk.windows(docs).groupBy("document_id").agg(F.count("*").alias("subs")).join(chunk.windows(docs, 2200, 250).groupBy("document_id").agg(F.count("*").alias("ups")), "document_id")
    pages = docs.select("document_id", F.lit(1).alias("page"), F.col("text").alias("page_text"))
    return image_chunks(image_rows(t), pages, counts).select("document_id", "parent_index", "chunk_index", F.md5("content").alias("content_md5"), "token_count")


# ---- replies: the lines of documents stand in for a model's --------------------------------------------------------------

UNQ = "trim(trim({x}), '\"''')"
NUM = r"regexp_replace(trim({x}), '^[0-9]+[.、)]\s*', '')"


@query("fus07_parse_expansions", f"select doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(trim(text), chr(10)), lambda x: {UNQ.format(x=NUM.format(x='x'))}), lambda x: length(x) > 2), 1, 3), '|') as variants from documents")
def fus07(t):
    return t.documents.select("doc_id", F.array_join(T.parse_queries(F.col("text")), "|").alias("variants"))


@query("fus08_parse_entities", "select doc_id, array_to_string(list_slice(list_filter(list_transform(string_split_regex(text, '[,，、\\n]'), lambda x: trim(x)), lambda x: length(x) > 0), 1, 10), '|') as entities from documents")
def fus08(t):
    return t.documents.select("doc_id", F.array_join(T.parse_list(F.col("text"), 10), "|").alias("entities"))


@query("eva07_parse_claims", "select doc_id, array_to_string(list_filter(list_transform(string_split(trim(text), chr(10)), lambda x: trim(" + UNQ.format(x=NUM.format(x="x").replace(".、)]", ".、)\\-]")) + ", '- ')), lambda x: length(x) > 3), '|') as claims from documents")
def eva07(t):
    return t.documents.select("doc_id", F.array_join(T.parse_claims(F.col("text")), "|").alias("claims"))


@query("eva09_parse_questions", f"select doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(trim(text), chr(10)), lambda x: {NUM.format(x='x')}), lambda x: length(x) > 5), 1, 3), '|') as questions from documents")
def eva09(t):
    return t.documents.select("doc_id", F.array_join(T.parse_questions(F.col("text")), "|").alias("questions"))


TAGS = r"""items as (select doc_id, list_filter(list_transform(string_split_regex(text, '[,，、\n]'), lambda x: trim(""" + UNQ.format(x=NUM.format(x="trim(x)").replace(".、)]", ".、)\\-]")) + """, '。')), lambda x: length(x) between 2 and 20) as l from documents)"""


@query("tag02_parse_tags", TAGS + " select doc_id, array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: case when list_position(l, l[i]) = i then l[i] end), lambda x: x is not null), '|') as tags from items")
def tag02(t):
    return t.documents.select("doc_id", F.array_join(T.parse_tags(F.col("text")), "|").alias("tags"))
