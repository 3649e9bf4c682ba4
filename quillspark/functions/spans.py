"""Ordered span extraction: points, methods, quotes, questions, steps, prompts, links.

Greedy selections are folds over the candidates of one text, bounded by their limits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import S, any_of, compact, description, first_sentence, has_chinese, has_english_sentence, is_noise_line, is_skill_noise_line, let, lines, positioned, quick, spaced, split_sentences, strip_frontmatter

#: What marks comments, metadata, methods, insights and quotes.
COMMENT = r"^[ \t]*(?:[0-9]+\.[ \t]*)?\*\*[^*]{1,20}\*\*[：:]"
PLATFORM = r"^[ \t]*(?:[0-9]+[.)、][ \t]*)?(?:点赞|收藏|评论|发布|采集|作者|地区|IP|标签|标题)[数量：: ]"
METHOD = "建立|拆解|分析|生成|输出|整理|收集|验证|使用|运行|设计|转化|复盘|提示词|方法|步骤|流程|框架|模板|工具|清单|策略|机制|规则|习惯|案例"
INSIGHT = "本质|核心|关键|真正|重点|其实|与其|而不是|才是|才能|一定要|最重要|最难|必须|不要|别再|才叫|才算|才能算|背后|逻辑|规律|真相|归根结底|说到底|最要命的|最值钱的|只有|唯一|绝不|不需要"
CONTRARIAN = r"不是[^\n]+而是|与其[^\n]+不如|表面[^\n]+实际|看似[^\n]+其实|not[ \t]+[A-Za-z0-9_]+[^\n]+but|大多数人都|你以为[^\n]+其实|很多人以为"
TRANSITION = "但|然而|其实|反而|恰恰|事实上|只不过|确切地说|真正的|however|actually|really"
ENGLISH = r"(?i)\b(?:actually|really|truly|instead of|not[ \t]+[a-z0-9_]+[ \t]+but|only|never|always|the truth|most people|few people|the key|the point|essentially|fundamentally|matter|matters|dead|wins?|lose[sr]?|secret|nobody|everyone)\b"
POINT = "核心|关键|本质|建议|应该|需要|可以|方法|流程|步骤|机会|风险|输出"
NUMBERS = r"(?i)[0-9]+[ \t]*%|[0-9]+[ \t]*(?:倍|万|亿|千|百)|Top[ \t]*[0-9]+|月入|一年|入|月|每[ \t]*[0-9]"
RESIDUE = "👍|💬|回复|转发|点赞|[0-9]{2}-[0-9]{2}"
ACTION = "建立|整理|拆解|分析|生成|提炼|收集|输出|验证|复盘|设计|创建|使用|运行|记录|发布"
STEP_HINT = "第一|第二|第三|步骤|流程|先|然后|最后|建立|拆解|生成|提炼"
STARTS = ("说明：", "注：", "页面标注", "当前页面", "本次 DOM")
BULLET = r"^(?:[-*•]|[0-9]+[.)、])"
POINT_LINE = r"^(?:[-*•]|[0-9]+[.)、]|第[一二三四五六七八九十]+[部分步点])"
#: The same matches as above, tried only where they can begin. Letters beyond ASCII end a word of ENGLISH, unlike Java's \\b has it.
_ENGLISH = "(?i)(?=[artionmefdwls])" + ENGLISH.removeprefix("(?i)").replace(r"\b", "(?<![a-z0-9_])", 1).replace(r"\b", "(?![a-z0-9_])")
_NUMBERS = "(?i)(?:(?=[0-9t])(?:[0-9]++[ \\t]*(?:%|倍|万|亿|千|百)|Top[ \\t]*[0-9]+)|(?=[一-龥])(?:月入|一年|入|月|每[ \\t]*[0-9]))"


def is_comment_or_meta(x: Column) -> Column:
    return x.rlike(f"{COMMENT}|{PLATFORM}")


def bullets(text: Column, limit: int = 5) -> Column:
    """Distinct bullet or numbered lines of six characters or more, in order."""
    found = F.regexp_extract_all(strip_frontmatter(text), F.lit(r"(?m)^[ \t]*(?:[-*•]|[0-9]+[.)、])[ \t]+([^\n]+)$"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, compact), lambda x: F.length(x) >= 6)), 1, limit)


def key_points(clean: Column, limit: int = 5) -> Column:
    """Points of a cleaned text: bullets of 12 to 160 characters, then hinted sentences."""
    raw = F.filter(F.transform(lines(clean), lambda x: F.btrim(x)), lambda x: x.rlike(POINT_LINE) & ~is_comment_or_meta(x))
    point = F.transform(raw, lambda x: compact(F.regexp_replace(F.regexp_replace(x, BULLET + "[ \t]*", ""), r"(?i)^\*+[ \t]*Description[ \t]*\*+[ \t]*", "")))
    listed = F.filter(point, lambda x: F.length(x).between(12, 160) & ~is_comment_or_meta(x) & ~is_noise_line(x))
    said = F.filter(split_sentences(clean), lambda x: x.rlike(quick(POINT)) & ~is_comment_or_meta(x))
    said = F.filter(F.transform(said, lambda x: F.left(x, F.lit(160))), lambda x: ~is_noise_line(x))
    return F.slice(F.array_distinct(F.concat(listed, said)), 1, limit)


def _add_unless(reject, limit: int):
    return lambda acc, x: F.when((F.size(acc) >= limit) | F.exists(acc, lambda a: reject(a, x)), acc).otherwise(F.concat(acc, F.array(x)))


def methods(clean: Column, limit: int = 8) -> Column:
    """Actionable bullets, then sentences; one that contains, or is contained in, an earlier one is dropped."""
    raw = F.filter(F.transform(lines(clean), lambda x: F.btrim(x)), lambda x: x.rlike(BULLET + "[ \t]+") & ~is_comment_or_meta(x))
    raw = F.filter(raw, lambda x: x.rlike(quick(METHOD)) | (x.rlike(r"[：:][ \t]*[^\n]") & x.rlike(quick("先|然后|接着|最后|首先"))))
    said = F.filter(split_sentences(clean), lambda x: x.rlike(quick(METHOD)) & ~is_comment_or_meta(x))
    item = F.transform(F.concat(raw, said), lambda x: compact(F.regexp_replace(x, BULLET + "[ \t]*", "")))
    item = F.filter(item, lambda x: F.length(x).between(12, 160) & ~is_noise_line(x) & ~is_comment_or_meta(x))
    return F.aggregate(item, F.array().cast("array<string>"), _add_unless(lambda a, x: a.contains(x) | x.contains(a), limit))


def hard_reject(t: Column) -> Column:
    return (
        (t == "") | is_noise_line(t) | is_comment_or_meta(t) | any_of(t.startswith(x) for x in STARTS) | t.endswith("：") | t.endswith(":") | t.endswith("?") | t.endswith("？")
        | t.rlike(r"^Q[0-9]+[：:]") | t.rlike(r"(?i)^(description|tags|title|source|url|link)[ \t]*[：:]")
    )


def quote_score(text: Column, source: Column, position: Column) -> Column:
    """Signals of a quotable sentence, added up; -99 for what is no quote."""
    point = lambda test, n: F.when(test, n).otherwise(0)

    def score(t: Column) -> Column:
        cn, n = has_chinese(t), F.length(t)
        insight = F.when(cn, point(t.rlike(quick(INSIGHT)), 3) + point(t.rlike(quick(CONTRARIAN)), 2) + point(t.rlike(quick(TRANSITION)), 1)).otherwise(point(t.rlike(_ENGLISH), 3))
        total = (
            F.when(source.isin("bold", "blockquote"), 3).when(source == "description", 2).otherwise(0) + insight + point(t.rlike(_NUMBERS), 2)
            + F.when(n.between(25, 80), 2).when(n.between(18, 24) | n.between(81, 120), 1).otherwise(0)
            + point((position <= 0.2) | (position >= 0.8), 2) + point(t.rlike(r"[。！？.!][ ]*$"), 1) - point(t.rlike(RESIDUE), 3)
        )
        no_quote = (n < 12) | (n > 220) | (~cn & ~has_english_sentence(t)) | hard_reject(t)
        return F.when(no_quote, -99).otherwise(total)

    return let(compact(text), score)


def similar_quotes(a: Column, b: Column) -> Column:
    """One contains the other, or their word sets overlap by 0.7 of the smaller."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("[一-龥]{2}|[A-Za-z]{3,}"), F.lit(0)))
    both = F.size(F.array_intersect(words(a), words(b)))
    least = F.least(F.size(words(a)), F.size(words(b)))
    return a.contains(b) | b.contains(a) | ((least > 0) & (both / least >= 0.7))


def description_sentences(text: Column) -> Column:
    block = F.regexp_extract(text, r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n", 1)
    value = F.regexp_extract(block, r"(?is)(?:^|\n)[ \t]*description:(.*?)(?:\n[^ \t\n]+:|$)", 1)
    parts = F.regexp_extract_all(F.btrim(compact(value), F.lit("'\"")), F.lit("(?:[^。！？.!?]|[。！？.!?][^ ])*[。！？.!?]?(?: |$)"), F.lit(0))
    return F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: F.length(x) >= 12)


def quotes(text: Column, limit: int = 3, least: int = 6) -> Column:
    """struct(text, source, score) of the best quotes: bold, quoted, described or body sentences, by score
    and source, without near-repeats. Comment sections are cut off."""

    def pick(body: Column) -> Column:
        row = lambda t, s, p: F.struct(t.alias("text"), F.lit(s).alias("source"), p.cast("double").alias("position"))
        n = F.greatest(F.length(body), F.lit(1))
        bold = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)\*\*(.+?)\*\*"), F.lit(1)), lambda x: row(compact(x), "bold", (F.position(F.concat(F.lit("**"), x, F.lit("**")), body) - 1) / n))
        quoted = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^>[ \t]*([^\n]+)$"), F.lit(1)), lambda x: row(compact(x), "blockquote", (F.position(x, body) - 1) / n))
        told = F.transform(description_sentences(text), lambda x, i: row(x, "description", 0.05 + i * 0.02))
        said = F.transform(positioned(split_sentences(body)), lambda x: row(x["text"], "body", x["position"]))
        scored = F.transform(F.concat(bold, quoted, told, said), lambda x, i: F.struct((-quote_score(x["text"], x["source"], x["position"])).alias("s"), F.when(x["source"].isin("bold", "blockquote"), -3).when(x["source"] == "description", -2).otherwise(-1).alias("p"), i.alias("i"), x["text"].alias("text"), x["source"].alias("source")))
        kept = F.sort_array(F.filter(scored, lambda x: x["s"] <= -least))
        item = F.transform(kept, lambda x: F.struct(x["text"].alias("text"), x["source"].alias("source"), (-x["s"]).alias("score")))
        return F.aggregate(item, F.array().cast("array<struct<text:string,source:string,score:int>>"), _add_unless(lambda a, x: similar_quotes(a["text"], x["text"]), limit))

    body = F.regexp_extract(strip_frontmatter(text), r"(?s)^(.*?)(?:###[ \t]*[三四五][ \t]*[、。.]?[ \t]*前[ \t]*[0-9]+[ \t]*条评论|##+[^\n]*?评论|$)", 1)
    return let(body, pick)


def questions(clean: Column, limit: int = 5) -> Column:
    asking = F.filter(lines(clean), lambda x: x.contains("?") | x.contains("？"))  # no match leaves its line
    numbered = lambda x: F.regexp_extract_all(x, F.lit(r"Q[0-9]+[：:][^\n]|[^。！？!?\n]{8,80}+[？?]"), F.lit(0))
    # without such a number, a match is the end of what stands before a mark, of 80 characters at most
    plain = lambda x: F.transform(F.filter(F.regexp_extract_all(x, F.lit(r"[^。！？!?\n]+[。！？!?]?"), F.lit(0)), lambda q: (q.endswith("?") | q.endswith("？")) & (F.length(q) >= 9)), lambda q: F.right(q, F.lit(81)))
    found = F.flatten(F.transform(asking, lambda x: F.when(x.rlike("Q[0-9]+[：:]"), numbered(x)).otherwise(plain(x))))
    ok = F.filter(F.transform(found, compact), lambda q: ~is_noise_line(q) & ~any_of(q.startswith(x) for x in STARTS) & q.rlike("[？?]") & ~q.rlike(r"^[0-9]+[.)、][ \t]*[^：:]{1,20}[：:][^\n]+[？?]"))
    return F.slice(F.array_distinct(ok), 1, limit)


def steps(text: Column, limit: int = 8) -> Column:
    """Listed lines with an action verb; only if there are none, hinted sentences."""
    body = strip_frontmatter(text)
    plain = lambda x: compact(F.regexp_replace(F.regexp_replace(x, "(?is)<iframe.*?</iframe>", " "), "<[^>]+>", " "))
    raw = F.filter(F.transform(lines(body), lambda x: F.btrim(x)), lambda x: x.rlike(r"^(?:[0-9]+[.)、]|[-*•])[ \t]+") & x.rlike(quick(ACTION)))
    raw = F.filter(raw, lambda x: ~is_skill_noise_line(x) & ~x.rlike("(?i)^(?:tags|author|source|published|created|description):"))
    listed = F.array_distinct(F.filter(F.transform(raw, plain), lambda x: F.length(x).between(12, 120)))
    said = F.filter(F.split(spaced(body), "[。！？!?][ ]*"), lambda x: x.rlike(quick(STEP_HINT)))
    said = F.array_distinct(F.filter(F.transform(said, plain), lambda x: F.length(x).between(12, 140)))
    return let(listed, lambda x: F.slice(F.when(F.size(x) > 0, x).otherwise(said), 1, limit))


def prompts(text: Column, limit: int = 3) -> Column:
    """Prompt blocks: task sections, code fences, labelled lines, in this order."""
    task = F.regexp_extract_all(text, F.lit(r"(?is)(?:^|\n)#{0,6}[ \t]*任务[ \t]*[0-9]+[ \t]*提示词[ \t]*\n+(.+?)(?=\n#{0,6}[ \t]*任务[ \t]*[0-9]+[ \t]*提示词|\n#{1,6}[ \t]+|\n---|$)"), F.lit(1))
    task = F.transform(F.filter(F.transform(task, lambda x: F.btrim(x)), lambda x: (F.length(x) >= 40) & ~is_skill_noise_line(F.left(x, F.lit(120)))), lambda x: F.left(x, F.lit(1500)))
    fence = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)```(?:[A-Za-z0-9_]+)?\n(.*?)```"), F.lit(1)), lambda x: x.rlike("(?i)" + quick("prompt|提示词|请你|帮我|你是|任务")))
    fence = F.transform(fence, lambda x: F.left(F.btrim(x), F.lit(1000)))
    label = F.concat(F.regexp_extract_all(text, F.lit(r"(?is)(?:prompt|提示词|指令)[：:][ \t\n]*(.+?)(?:\n#{1,4}|\n\n|$)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?is)(请你.+?)(?:\n\n|$)"), F.lit(1)))
    label = F.transform(F.filter(F.transform(label, compact), lambda x: F.length(x) >= 20), lambda x: F.left(x, F.lit(1000)))
    return F.slice(F.concat(task, fence, F.array_except(label, F.concat(task, fence))), 1, limit)


def wiki_links(text: Column) -> Column:
    """Targets of [[target|alias#anchor]], repeats kept."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[(.+?)\]\]"), F.lit(1))
    target = F.transform(raw, lambda x: F.btrim(F.split_part(F.split_part(x, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1))))
    return F.filter(target, lambda x: x != "")


def author(text: Column) -> Column:
    bold = F.regexp_extract(text, r"\*\*作者：\*\*[ \t]*([^\n]+)", 1)
    plain = F.regexp_extract(text, r"(?m)^作者[：:][ \t]*([^\n]+)$", 1)
    return F.left(compact(F.when(bold != "", bold).otherwise(plain)), F.lit(40))


def summary(text: Column, clean: Column) -> Column:
    """struct(description, concise, fallback, core)."""
    concise = F.left(compact(F.regexp_extract(clean, r"(?s)精简文案版（200[^）]*）[：:]?[ \t\n]*(.+?)(?:\n###|\n---|$)", 1)), F.lit(400))
    fallback = let(compact(clean), lambda w: F.when((F.length(w) >= 40) & ~w.startswith("#") & ~is_noise_line(w), F.left(w, F.lit(400))).otherwise(""))
    return let(F.struct(description(text).alias("d"), concise.alias("c"), fallback.alias("f")), lambda x: F.struct(x["d"].alias("description"), x["c"].alias("concise"), x["f"].alias("fallback"), F.when(x["d"] != "", x["d"]).when(x["c"] != "", x["c"]).otherwise(x["f"]).alias("core")))


def core_thesis(text: Column, clean: Column) -> Column:
    """The description's first sentence, else the first strong sentence, else the first."""
    first = compact(first_sentence(description(text)))

    def from_body(s: Column) -> Column:
        strong = F.filter(s, lambda x: x.rlike(quick(INSIGHT)) | x.rlike(quick(METHOD)))
        return F.left(F.coalesce(F.get(strong, F.lit(0)), F.get(s, F.lit(0)), F.lit("")), F.lit(160))

    body = let(F.filter(split_sentences(clean), lambda x: ~is_noise_line(x) & ~x.rlike(COMMENT)), from_body)
    return F.when(F.length(first) >= 12, F.left(first, F.lit(160))).otherwise(body)


#: What a block of links stands between, unless other marks are given.
MARKS = ("<!-- approved links: start -->", "<!-- approved links: end -->")


def approved_block(links: Column, marks: tuple[str, str] = MARKS) -> Column:
    """A marked block of array<struct<target, reason>>, each target once."""
    first = F.aggregate(links, F.array().cast("array<struct<target:string,reason:string>>"), _add_unless(lambda a, x: F.btrim(a["target"]) == F.btrim(x["target"]), 1_000_000))
    rows = F.transform(F.filter(first, lambda x: F.btrim(x["target"]) != ""), lambda x: F.concat(F.lit("- [["), F.btrim(x["target"]), F.lit("]]（结构性链接建议："), compact(x["reason"]), F.lit("）")))
    return F.array_join(F.concat(F.array(F.lit(marks[0])), rows, F.array(F.lit(marks[1]))), "\n")


def apply_links(text: Column, links: Column, marks: tuple[str, str] = MARKS) -> Column:
    """Replace the marked block, else insert it under the heading for related links, else append both."""
    start, end = marks
    block, head = approved_block(links, marks), r"(?s)^(.*?(?:^|\n)##[ \t]+相关链接[ \t]*\n)"
    marked = F.concat(F.substring_index(text, start, 1), block, F.substr(text, F.instr(text, end) + len(end)))
    found = F.regexp_extract(text, head, 1)
    under = F.concat(found, F.lit("\n"), block, F.lit("\n"), F.substr(text, F.length(found) + 1))
    appended = F.concat(F.rtrim(F.regexp_replace(text, S + "+$", "")), F.lit("\n\n## 相关链接\n\n"), block, F.lit("\n"))
    return F.when(text.contains(start) & text.contains(end), marked).when(found != "", under).otherwise(appended)
