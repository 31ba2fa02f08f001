"""Column functions on text: tokens, sentences, lists in model replies, URLs, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of lists in replies, numbering before a line, sentence ends.
LIST_SEPARATORS = "[,，、\n]"
NUMBERING = r"^[0-9]+[.、)]\s*"
NUMBERING_DASH = r"^[0-9]+[.、)\-]\s*"
SENTENCE_END = r"(?<=[。！？.!?])\s*"
TRUNCATED = "...(内容已截断)"
PIECE_END = r"(?<=[。！？；\n])\s*|(?<=[.!?;]\s)\s*"
#: Scripts written without spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
#: All of their characters are among these, and a range is quicker to test than a script.
HIGH = r"[\x{2E80}-\x{10FFFF}]"


def empties_dropped(parts: Column) -> Column:
    return F.filter(parts, lambda x: F.length(x) > 0)


def terms(text: Column) -> Column:
    """Search terms: maximal runs of letters and digits, case kept; of runs in scripts without spaces each two neighbours.

    A single such character is a term of its own. Only texts that have such runs pay for looking into every term.
    """
    runs = empties_dropped(F.split(F.regexp_replace(text, f"({UNSPACED}+)", " $1 "), r"[^\p{L}\p{N}]+"))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))
    split = F.flatten(F.transform(runs, lambda x: F.when(x.rlike(f"^{UNSPACED}{{2}}"), pairs(x)).otherwise(F.array(x))))
    return F.when(text.rlike(HIGH), split).otherwise(empties_dropped(F.split(text, r"[^\p{L}\p{N}]+")))


def token_count(text: Column) -> Column:
    """Tokens by the four-characters rule; swap this function to count otherwise."""
    return F.floor(F.length(text) / 4).cast("int")


def token_truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, 4 * n)


def reply_lines(raw: Column, numbering: str = NUMBERING) -> Column:
    """Trimmed lines of a reply without the numbers before them."""
    return F.transform(F.split(F.trim(raw), "\n"), lambda x: F.regexp_replace(F.trim(x), numbering, ""))


def unquoted(x: Column, marks: str = "\"'") -> Column:
    return F.btrim(F.trim(x), F.lit(marks))


def parse_queries(raw: Column, n: int = 3) -> Column:
    """Query variants: lines without number and quotes, over 2 characters, the first n."""
    return F.slice(F.filter(F.transform(reply_lines(raw), lambda x: unquoted(x)), lambda x: F.length(x) > 2), 1, n)


def parse_questions(raw: Column, n: int = 3) -> Column:
    """Reverse questions: lines without number, over 5 characters, the first n."""
    return F.slice(F.filter(reply_lines(raw), lambda x: F.length(x) > 5), 1, n)


def parse_claims(raw: Column) -> Column:
    """Claims: lines without number, quotes and dashes, over 3 characters."""
    return F.filter(F.transform(reply_lines(raw, NUMBERING_DASH), lambda x: F.btrim(unquoted(x), F.lit("- "))), lambda x: F.length(x) > 3)


def parse_list(raw: Column, n: int | None = None) -> Column:
    """Items between commas or line ends, trimmed, without empties; the first n."""
    items = empties_dropped(F.transform(F.split(raw, LIST_SEPARATORS), lambda x: F.trim(x)))
    return items if n is None else F.slice(items, 1, n)


def parse_tags(raw: Column) -> Column:
    """Tags: list items without number, quotes and full stop, of 2 to 20 characters, each once."""
    items = F.transform(F.split(raw, LIST_SEPARATORS), lambda x: F.btrim(unquoted(F.regexp_replace(F.trim(x), NUMBERING_DASH, "")), F.lit("。")))
    return F.array_distinct(F.filter(items, lambda x: F.length(x).between(2, 20)))


def pieces_of_sentences(text: Column) -> Column:
    """Pieces between sentence ends, trimmed, those of 5 characters or more."""
    parts = F.split(text, PIECE_END)
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: F.length(x) >= 5)


def sentences(text: Column) -> Column:
    """Sentences for compression: pieces, those under 10 characters appended to the one before."""
    start = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), x)))
        return F.when((F.length(x) < 10) & (F.size(done) > 0), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(pieces_of_sentences(text), start, step)


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts, from 0, of the windows that cover a text; the last one is the first to reach its end."""
    step = size - overlap
    last = F.ceil(F.greatest(length - size, F.lit(0)) / step).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def clip_middle(text: Column, most: int, side: int, marker: str = "\n...\n") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, side), F.lit(marker), F.right(text, F.lit(side)))).otherwise(text)


def clip(text: Column, most: int, suffix: str = TRUNCATED) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def normal_url(url: Column) -> Column:
    bare = F.trim(url)
    return F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def valid_url(url: Column) -> Column:
    bare = F.trim(url)
    return (F.length(bare) > 0) & F.contains(bare, F.lit(".")) & ~F.contains(bare, F.lit(" "))


def tags_to_space(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def html_lines(html: Column) -> Column:
    """Line breaks for br and the ends of blocks, no tags, at most one blank line in a row."""
    text = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</(p|div|h[1-6]|li|tr)>", "\n")
    return F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "\n{3,}", "\n\n")


def without_boilerplate(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header)\b.*?</\1>", "")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Words of user interfaces, and beginnings of short footer lines.
UI_WORDS = ["首页", "登录", "注册", "反馈", "举报", "回到顶部", "返回顶部", "展开", "收起", "查看更多", "加载更多", "重置", "确定", "取消", "保存", "提交", "搜索", "清空", "分享", "收藏", "点赞", "评论", "发送"]
FOOTER_STARTS = ["Copyright", "©", "All Rights", "京ICP", "沪ICP", "粤ICP", "Powered by", "Created by"]


def visible_lines(text: Column, words: list[str] = UI_WORDS, starts: list[str] = FOOTER_STARTS) -> Column:
    """Text without interface words, one-character and number lines and short footers; runs of blanks shortened."""
    footer = lambda x: (F.length(x) < 40) & F.exists(F.array(*[F.lit(s) for s in starts]), lambda s: F.startswith(x, s))
    keep = lambda x: (F.length(x) == 0) | ((F.length(x) > 1) & ~x.isin(words) & ~x.rlike(r"^[0-9]+$") & ~footer(x))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), keep)
    return F.btrim(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), " {2,}", " "), F.lit("\n"))
