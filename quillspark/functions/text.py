"""Text normalisation as column expressions; no UDFs.

White space in patterns is spelled out, and line ends are \\n alone, so that results don't depend on
a regex dialect's classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

S = r"[ \t\n\x0b\f\r]"
NOT_S = r"[^ \t\n\x0b\f\r]"
TRIM = " \t\n\x0b\f\r"
#: Lines of captured pages that are no content.
NOISE_PATTERNS = (
    r"(?i)iframe|bilibili|frameborder|allowfullscreen",
    r"(?i)页面 DOM|网页 DOM|点点 AI|采集时间|原始分享链接|笔记链接",
    r"(?i)发布时间|编辑时间|作者|点赞数|收藏数|评论数|前[ \t]*[0-9]+[ \t]*条评论",
    r"(?i)视频音频逐字稿|ASR 转录|Transcript",
)
NOISE_LINES = ("Description", "**Description**", "原始分享链接：", "笔记文字内容已完整提取", "视频音频逐字稿（ASR 转录）：", "精简文案版（200 字以内）：", "标题：", "正文内容：", "标签：", "图片 OCR 文字：")
NOISE_STARTS = ("说明：", "注：", "页面标注", "当前页面", "本次 DOM")
PLAIN_LINE = r"^[A-Za-z0-9_:/?.=&%#|｜\- ]+$"
DROP_LINES = (
    r"(?i)^[ \t]*(?:发布时间|编辑时间|作者|地区|IP属地|点赞|收藏|评论|分享)[：:].*$",
    r"(?i)^[ \t]*(?:一、基础数据|三、前[ \t]*[0-9]+[ \t]*条评论|四、点点 AI 回复原文).*$",
    r"(?i)^[ \t]*\*\*?(?:Description|Transcript)\*\*?.*$",
)
SKILL_NOISE = ("发布时间", "编辑时间", "作者", "地区", "IP属地", "点赞", "收藏", "评论", "分享", "网页 DOM", "点点 AI", "基础数据", "采集备注", "改写结果", "口播优化", "结构化文案", "音频逐字稿")


def let(value: Column, body) -> Column:
    """Bind a value to a lambda variable: computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def quick(words: str) -> str:
    """An alternation behind a look at the next character, which each word begins with as a literal or [0-9]: the same matches,
    tried only where one can begin. Words that begin beyond ASCII stand behind a look at the range of their first characters, as a
    class of many such characters is compared one by one."""
    parts = []
    for far in (False, True):
        some = [w for w in words.split("|") if (ord(w[0]) > 127) == far]
        firsts = "".join(sorted({"0-9" if w.startswith("[0-9]") else w[0] for w in some}))
        if some:
            parts.append((f"(?=[{firsts[0]}-{firsts[-1]}])" if far else "") + f"(?=[{firsts}])(?:{'|'.join(some)})")
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def normalize(text: Column) -> Column:
    """Lower case, with ｜ _ - as spaces."""
    return F.translate(F.lower(text), "｜_-", "   ")


def spaced(text: Column) -> Column:
    """White-space runs as one space. A single space is no match, so that most texts are not written anew."""
    return F.regexp_replace(text, f"(?:[\\t\\n\\x0b\\f\\r]| (?={S})){S}*", " ")


def compact(text: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.btrim(spaced(text))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def strip_frontmatter(text: Column) -> Column:
    """Without a leading block between two --- lines; unchanged if the block never closes."""

    def cut(ls: Column) -> Column:
        end = F.array_position(F.transform(F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1))), lambda x: F.when(x.contains("---"), F.btrim(x, F.lit(TRIM)))), "---")
        return let(end, lambda n: F.when(n > 0, F.array_join(F.slice(ls, (n + 2).cast("int"), F.greatest(F.size(ls), F.lit(1))), "\n")).otherwise(text))

    first = F.substring_index(text, "\n", 1)
    return F.when(first.contains("---") & (F.btrim(first, F.lit(TRIM)) == "---"), let(lines(text), cut)).otherwise(text)


def without_markup(text: Column) -> Column:
    """Frontmatter, frames and tags taken out."""
    t = F.regexp_replace(strip_frontmatter(text), "(?is)<iframe.*?</iframe>", " ")
    return F.regexp_replace(t, "<[^>]+>", " ")


def clean_text(text: Column) -> Column:
    """Digest text: no markup, code fences, addresses or metadata lines; compacted."""
    t = F.regexp_replace(without_markup(text), "(?s)```.+?```", " ")
    t = F.regexp_replace(t, f"https?://{NOT_S}+", " ")
    kept = F.filter(lines(t), lambda x: ~any_of(x.rlike(p) for p in DROP_LINES))
    return compact(F.array_join(kept, "\n"))


#: All of NOISE_PATTERNS in one.
NOISE = "(?i)" + quick("|".join(p.removeprefix("(?i)") for p in NOISE_PATTERNS))


def is_noise_line(line: Column) -> Column:
    def test(t: Column) -> Column:
        return (
            (t == "") | t.rlike(NOISE) | t.rlike(r"(?i)^\*+[ ]*Description[ ]*\*+$") | t.isin(*NOISE_LINES)
            | any_of(t.startswith(x) for x in NOISE_STARTS) | t.rlike(PLAIN_LINE)
        )

    return let(compact(line), test)


def clean_content(text: Column) -> Column:
    """Clipping text: no markup or addresses; lines that are noise dropped, others trimmed."""
    t = F.regexp_replace(without_markup(text), f"https?://{NOT_S}+", " ")
    kept = F.filter(lines(t), lambda x: ~is_noise_line(x))
    head = F.transform(kept, lambda x: F.btrim(F.regexp_replace(x, r"(?i)^[ \t]*\*+[ \t]*Description[ \t]*\*+[ \t]*", ""), F.lit(TRIM)))
    return F.array_join(F.filter(head, lambda x: x != ""), "\n")


def is_skill_noise_line(line: Column) -> Column:
    plain = compact(F.regexp_replace(F.regexp_replace(line, "(?is)<iframe.*?</iframe>", " "), "<[^>]+>", " "))
    return let(plain, lambda t: (t == "") | t.rlike(quick("|".join(SKILL_NOISE))) | t.rlike("(?i)" + quick("iframe|bilibili|frameborder|allowfullscreen|transcript")) | t.rlike(PLAIN_LINE))


def preview(clean: Column, n: int = 220) -> Column:
    return F.when(F.length(clean) > n, F.concat(F.left(clean, F.lit(n)), F.lit("..."))).otherwise(clean)


def split_sentences(text: Column, least: int = 12) -> Column:
    """Sentences that end with 。！？!? (a full stop is no end), trimmed, of at least `least` characters."""
    parts = F.regexp_extract_all(spaced(text), F.lit("[^。！？!?]+[。！？!?]?|[。！？!?]"), F.lit(0))
    return F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: F.length(x) >= least)


def positioned(sentences: Column) -> Column:
    """struct(text, position 0..1) of each."""
    return let(sentences, lambda s: F.transform(s, lambda x, i: F.struct(x.alias("text"), (i / F.greatest(F.size(s) - 1, F.lit(1))).alias("position"))))


def count_lines(text: Column) -> Column:
    """Body lines that are neither blank nor headings."""
    return count_body_lines(strip_frontmatter(text))


def count_body_lines(body: Column) -> Column:
    """count_lines() of a text without frontmatter."""
    return F.regexp_count(body, F.lit(r"(?md)^[ \t\x0b\f\r]*+[^# \t\n\x0b\f\r]"))


def paragraphs(text: Column) -> Column:
    return F.transform(F.split(text, r"\n[ \t\x0b\f\r]*\n"), compact)


def first_paragraph(text: Column, n: int = 600) -> Column:
    """The first paragraph of over 30 characters, else the whole text, cut at n; for link scoring."""
    t = F.regexp_replace(F.regexp_replace(text, "(?s)^(.*?)---.*?---", "$1 "), "<[^>]+>", " ")
    return let(t, lambda t: F.left(F.coalesce(F.get(F.filter(paragraphs(t), lambda p: F.length(p) > 30), F.lit(0)), compact(t)), F.lit(n)))


def skill_paragraph(text: Column, n: int = 280) -> Column:
    """The first paragraph that is no heading, metadata, address list or noise; else the whole body."""

    def bad(p: Column) -> Column:
        return (F.length(p) < 30) | p.startswith("#") | p.startswith("---") | p.rlike(r"^\*\*(?:笔记链接|标准链接|作者|采集时间|发布时间|标签)\*\*") | p.rlike(r"^(?:https?://[^ ]+ *)+$") | is_skill_noise_line(p)

    body = strip_frontmatter(text)
    pick = let(body, lambda b: F.coalesce(F.get(F.filter(paragraphs(b), lambda p: ~bad(p)), F.lit(0)), compact(b)))
    return let(pick, lambda p: F.when(F.length(p) > n, F.concat(F.left(p, F.lit(n)), F.lit("…"))).otherwise(p))


def description(text: Column) -> Column:
    """The frontmatter's description line, unquoted; empty if there is none."""
    block = F.regexp_extract(text, r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n", 1)
    line = F.get(F.filter(lines(block), lambda x: F.lower(x).startswith("description:")), F.lit(0))
    return F.coalesce(F.btrim(F.btrim(F.regexp_replace(line, "^[^:]*:", ""), F.lit(TRIM)), F.lit("'\"")), F.lit(""))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, "^[^。！？!?]*", 0)


def one_liner(text: Column, name: Column) -> Column:
    """A sentence of purpose: of the description, else of the first paragraph, else a placeholder."""
    said = first_sentence(compact(description(text)))
    para = skill_paragraph(text)
    fallback = F.when(para != "", F.left(first_sentence(para), F.lit(220))).otherwise(F.concat(F.lit("来自《"), name, F.lit("》，需人工补一句话用途。")))
    return F.when(F.length(said) >= 12, F.left(said, F.lit(220))).otherwise(fallback)


def bare_name(name: Column) -> Column:
    return F.regexp_replace(name, "^(DRAFT_|提炼_)", "")


def content_hash(text: Column) -> Column:
    return F.md5(clean_content(text))


def file_hash(content: Column) -> Column:
    """MD5 of the first million bytes."""
    return F.md5(F.substring(content.cast("binary"), 1, 1_000_000))


def prompt_content(text: Column) -> Column:
    """Long texts as head, marker and tail."""
    return F.when(F.length(text) > 8000, F.concat(F.left(text, F.lit(7800)), F.lit("\n...\n"), F.right(text, F.lit(180)))).otherwise(text)


def has_chinese(text: Column) -> Column:
    return text.rlike("[一-龥]")


def has_english_sentence(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z][A-Za-z'’\-]+")) >= 3
