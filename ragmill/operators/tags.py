"""Tags of documents (document_id, name, source) and of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words too general to be tags.
BANNED = ["文档", "报告", "指南", "教程", "介绍", "说明", "技术", "计算机", "软件", "编程", "开发", "学习", "资料", "总结", "笔记", "整理", "基础", "入门", "进阶", "原理", "方法", "应用", "实践", "分析", "研究",
          "设计", "实现", "系统", "框架", "工具", "平台", "管理", "项目", "工程", "解决方案", "概述", "document", "report", "guide", "tutorial", "introduction", "technology", "software", "programming", "development"]
TAGS = "array<struct<name:string,source:string>>"


def content_sample(text: Column, joiner: str = "\n\n---\n\n") -> Column:
    """What a tagger reads: the first 1500 characters, 1500 from the middle of texts over 3000, 1000 from two thirds of those over 6000; null under 50."""
    n = F.length(text)
    at = lambda start, size: F.substring(text, start + 1, F.lit(size))
    parts = F.array_compact(F.array(F.substring(text, 1, 1500), F.when(n > 3000, at(F.floor(n / 2).cast("int"), 1500)), F.when(n > 6000, at(F.floor(n * 2 / 3).cast("int"), 1000))))
    return F.when(n >= 50, F.array_join(parts, joiner))


def quality_filter(tags: Column, most: int = 5, banned: list[str] = BANNED) -> Column:
    """Tags without general words, single characters and numbers, each once, the first `most`."""
    good = F.filter(tags, lambda x: ~F.lower(F.trim(x)).isin(banned) & (F.length(x) > 1) & ~x.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(good), 1, most)


def merge_auto(old: Column, names: Column) -> Column:
    """Manual tags and new automatic ones whose names aren't among them; old automatic tags go."""
    manual = F.filter(old, lambda t: t["source"] == "manual")
    fresh = F.filter(names, lambda x: ~F.exists(manual, lambda t: t["name"] == x))
    return F.concat(manual, F.transform(fresh, lambda x: F.struct(x.alias("name"), F.lit("auto").alias("source"))))


def add_manual(old: Column, name: Column, most: int = 50) -> Column:
    clean = F.trim(name)
    bad = F.exists(old, lambda t: t["name"] == clean) | (F.length(clean) == 0) | (F.length(clean) > most)
    return F.when(bad, old).otherwise(F.concat(old, F.array(F.struct(clean.alias("name"), F.lit("manual").alias("source")))))


def remove(old: Column, name: Column) -> Column:
    """Tags without that name; null if none is left."""
    left = F.filter(old, lambda t: t["name"] != name)
    return F.when(F.size(left) > 0, left)


def gathered(tags: DataFrame) -> DataFrame:
    """document_id, tags: array of (name, source), ordered."""
    return tags.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("name", "source"))).alias("tags"))


def usage(tags: DataFrame) -> DataFrame:
    """name, n, sources (distinct, joined by comma): how often each tag is used."""
    return tags.groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def having_all(tags: DataFrame, names: list[str]) -> DataFrame:
    """document_id of the documents with every one of `names`."""
    return tags.where(F.col("name").isin(names)).groupBy("document_id").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(set(names))).select("document_id")


def normalise(raw: Column) -> Column:
    """Tags of a JSON list whose items are names or objects; the source is manual unless given."""
    items = F.variant_get(F.try_parse_json(raw), "$", "array<variant>")
    one = lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string")).alias("name"), F.coalesce(F.try_variant_get(v, "$.source", "string"), F.lit("manual")).alias("source"))
    return F.transform(items, one)


def keywords(post: DataFrame, idf: DataFrame, most: int = 5) -> DataFrame:
    """chunk_id, pos, term: the terms of greatest tf * idf, numbers and single letters left out."""
    rows = post.join(idf.select("kb_id", "term", "idf"), ["kb_id", "term"]).where((F.length("term") > 1) & ~F.col("term").rlike("^[0-9]+$") & ~F.lower("term").isin(BANNED))
    pos = F.row_number().over(Window.partitionBy("kb_id", "chunk_id").orderBy(F.desc(F.round(F.col("tf") * F.col("idf"), 6)), "term"))
    return rows.withColumn("pos", pos).where(F.col("pos") <= most).select("kb_id", "chunk_id", "pos", "term")
