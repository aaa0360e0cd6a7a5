"""What a question asks for: intent, focus, expansion, follow-ups, named documents.

Patterns and word lists are data; other languages or domains pass their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import characters, strip
from .substrings import containing


@dataclass(frozen=True)
class Lexicon:
    """Patterns and lists of the Chinese engineering domain."""

    count: str = "数量|多少|几台|几套|几座|几个|几处|个数|台数|套数|共计|合计"
    enumerate: str = "有哪些|列出|清单|一览|名单|哪些|所有|全部|都有|都包含"
    design_value: str = "正常蓄水位|设计洪水位|校核洪水位|汛期限制水位|防洪水位|设计水位|运行水位|死水位|兴利库容|设计流量|特征水位|最低水位|最高水位|多年平均|保证率"
    external: str = "实时|最新消息|头条|新闻|汇率|股票|股价|大盘|涨停|跌停|彩票|开奖|比分|赛事|球赛|股指"
    water_now: str = "实时水位|当前水位|今日水位|最新水位|实时水情|当前水情|今日水情|最新水情|实时雨量|今日雨量|当前雨量|当前流量|实时流量|今日流量|闸门开度|闸门状态|闸门启闭|水位变化|水情变化|水势如何"
    water: str = "水位|流量|蓄水量|雨量|水情|雨情|汛情|闸门|水势"
    weather: str = "天气|气温|温度|降雨|降水|下雨|下雪|多少度|气候"
    now: str = "今天|明天|后天|现在|当前|未来|此刻|预报|几点"
    clock: str = "几点|几点钟|几点几分|现在几点了|当前时间|现在时间|今天是几|几月几号|星期几|今天日期|现在日期|几号"
    ends: str = "？?。！!，,；; \\t"
    greeting: str = "^(请问|你好|帮我|我想知道|麻烦问下|想了解下|麻烦查下)+"
    asked: str = "(.{2,30}?)(?:是什么|是多少|有哪些|有几级|有几种|有几类|分为|有什么要求|有什么规定|有何要求|包括哪些|包含哪些|指什么|是什么样的|如何)"
    particles: str = "的|中|关于|对于|、|及|和|与|，"
    about: str = "^(?:关于|对于|对)"
    generic: tuple[str, ...] = (
        "要求", "规定", "内容", "情况", "方法", "原则", "事项", "问题", "标准", "条款", "方面", "部分", "定义", "依据", "步骤", "目的",
        "意义", "作用", "职责", "原理", "数量", "等级", "类别", "计算", "构建",
    )
    modifiers: tuple[str, ...] = ("具体", "主要", "基本", "相关", "一般", "重要", "相应", "有关", "详细")
    verbs: tuple[str, ...] = ("编写", "编制")
    levels: str = "分几级|有几级|分为几级|几级|分级|等级"
    level_word: str = "分级"
    level_mark: str = "级"
    expansions: tuple[tuple[str, str, str], ...] = (  # pattern, added words, characters of which one is needed
        ("稳不稳|稳不稳定|稳吗", "稳定性", ""),
        ("建哪些|要建哪些|有哪些东西|包含哪些东西", "系统组成", ""),
        ("按长管算|长管计算|按长管计算", "长管计算依据", ""),
        ("平稳还是乱|水流平稳|平稳的", "层流 紊流", ""),
        ("垮了|垮掉|垮塌", "溃坝", "坝堤堰库闸"),
    )
    social: str = "^(你好|您好|嗨|哈喽|在吗|谢谢|感谢|再见|拜拜|打扰了|早上好|下午好|晚上好)$"
    anchor: str = "(?:例题|习题|例)\\s*\\d|公式\\s*[（(]?\\s*\\d|第\\s*[0-9一二三四五六七八九十]+\\s*[章节篇]"
    reference: str = "这个|上述|上面|以上|该表|该专家|该名单|它|这些|那些|换个|用表格|表格形式|以表格|列举|总结|归纳|概括|详细|简洁|继续|然后|还有|为什么|怎么看|怎么理解|翻译|换个说法|换个角度|可以吗|能不能|可否|呢"
    enumeration: str = "有哪些|包含哪些|包括哪些|都有哪些|哪几个|哪几类|哪几级|哪几种|多少|所有|全部|完整|完整的|列出来|列出|概述|介绍|一览|全貌|总结|汇总|清单|一览表|都要|都有|还有|其他|其余|别的"
    inside: str = "中"
    document_words: tuple[str, ...] = ("规范", "标准", "预案", "文件", "文档", "规定", "指南", "导则", "资料", "制度", "办法", "规程", "要求", "内容")
    document_lead: str = "^(在|关于|对于|就)\\s*"
    extensions: str = "(?i)\\.(pdf|docx|md|markdown|txt|xlsx|csv)$"
    words: str = ""  # what parts words; without it the analyzer does


DEFAULT = Lexicon()


def table_kind(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """count before enum, else null."""
    return F.when(question.rlike(lex.count), "count").when(question.rlike(lex.enumerate), "enum")


def is_enumeration(question: Column, lex: Lexicon = DEFAULT) -> Column:
    return question.rlike(lex.enumeration)


def is_real_time(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """Asks for something outside a static library; design values never do."""
    q = F.coalesce(question, F.lit(""))
    when_now = q.rlike(lex.now) & (q.rlike(lex.water) | q.rlike(lex.weather))
    return ~q.rlike(lex.design_value) & (q.rlike(lex.external) | q.rlike(lex.water_now) | when_now | q.rlike(lex.clock))


def trim_ends(text: Column, lex: Lexicon = DEFAULT) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(text), f"^[{lex.ends}]+", ""), f"[{lex.ends}]+$", "")


def focus(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """The subject of a question; the question itself if none can be told, or if it is most of the question."""
    s = F.regexp_replace(trim_ends(question, lex), lex.greeting, "")
    head = F.regexp_extract(s, lex.asked, 1)
    parts = F.filter(F.transform(F.split(head, lex.particles), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, lex.about, "")))
    before = f"^(?:{'|'.join([*lex.modifiers, *lex.verbs])})"
    plain = lambda p: p.isin(*lex.generic) | F.regexp_replace(p, before, "").isin(*lex.generic)
    found = F.try_element_at(F.filter(parts, lambda p: (p != "") & ~plain(p)), F.lit(-1))
    short = found.isNull() | (F.length(found) < 2) | ((F.length(found) * 2 > F.length(question)) & (F.length(question) > 10))
    with_level = F.when(s.rlike(lex.levels) & ~found.contains(lex.level_mark), F.concat(found, F.lit(" " + lex.level_word))).otherwise(found)
    return F.when((head == "") | short, question).otherwise(with_level)


def expand(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """The question with the terms of all matching rules appended; null and blank stay as they are."""
    terms = [F.when(question.rlike(p) & (F.lit(True) if not guard else question.rlike(f"[{guard}]")), F.lit(words)) for p, words, guard in lex.expansions]
    added = F.concat_ws(" ", *terms)
    return F.when(question.isNull() | (strip(question) == "") | (added == ""), question).otherwise(F.concat(strip(question), F.lit(" "), added))


def is_follow_up(question: Column, lex: Lexicon = DEFAULT) -> Column:
    q = strip(F.coalesce(question, F.lit("")))
    bound = (F.length(q) <= 4) | ((F.length(q) <= 24) & q.rlike(lex.reference))
    return (q != "") & ~q.rlike(lex.social) & ~q.rlike(lex.anchor) & bound


def rewritten(messages: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """User messages (conv_id, turn, text) with search_text: a follow-up is led by the last earlier question that is
    none itself."""
    topic = F.when(~is_follow_up(F.col("text"), lex), F.col("text"))
    before = F.last(topic, ignorenulls=True).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    lead = trim_ends(before, lex)
    follows = is_follow_up(F.col("text"), lex) & before.isNotNull() & (lead != "")
    return messages.withColumn("search_text", F.when(follows, F.concat(lead, F.lit(" "), strip(F.col("text")))).otherwise(F.col("text")))


def named_documents(questions: DataFrame, documents: DataFrame, lex: Lexicon = DEFAULT, least_ratio: float = 0.4) -> DataFrame:
    """qid, doc_id: documents (doc_id, filename, kb) that a question (qid, question, kb) names, at most one a candidate. An
    exact name comes first, then the mutual substring with the best ratio of lengths, then the smaller id. Names and
    documents meet by the rarest pair of characters of the shorter one."""
    titles = F.regexp_extract_all("question", F.lit("《([^《》]{2,80})》"), F.lit(1))
    pieces = F.transform(F.split("question", lex.inside), lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), lex.document_lead, ""), "[《》]", ""))
    names = F.array_distinct(F.concat(F.transform(titles, lambda t: F.trim(t)), F.filter(pieces, lambda p: F.length(p).between(2, 40) & ~p.isin(*lex.document_words))))
    asked = questions.select("qid", F.col("kb").alias("scope"), F.explode(names).alias("name"))
    stem = F.regexp_replace("filename", lex.extensions, "")
    docs = documents.select("doc_id", "kb", stem.alias("stem"))
    named, stems = asked.select("name").distinct(), docs.select("stem").distinct()
    wide = containing(stems.select(F.col("stem").alias("text")), named.select(F.col("name").alias("pattern"))).select(F.col("text").alias("stem"), F.col("pattern").alias("name"))
    narrow = containing(named.select(F.col("name").alias("text")), stems.select(F.col("stem").alias("pattern"))).select(F.col("pattern").alias("stem"), F.col("text").alias("name"))
    single = named.select("name", F.explode(characters(F.col("name"))).alias("stem")).join(stems.filter("length(stem) = 1"), "stem").select("stem", "name")
    met = wide.unionByName(narrow).unionByName(single).distinct()
    both = asked.join(met, "name").join(docs, "stem").filter(F.col("scope").isNull() | (F.col("scope") == F.col("kb")))
    ratio = F.least(F.length("stem"), F.length("name")) / F.greatest(F.length("stem"), F.length("name"))
    scored = both.withColumn("ratio", F.when(F.col("stem") == F.col("name"), 2.0).otherwise(ratio)).filter(F.col("ratio") >= least_ratio)
    best = scored.groupBy("qid", "name").agg(F.max_by("doc_id", F.struct("ratio", (-F.col("doc_id")).alias("i"))).alias("doc_id"))
    return best.select("qid", "doc_id").distinct()
