"""Column functions over text: cleaning, headings, search tokens, similarity, numerals, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of characters.
CJK = r"一-鿿"
WORD = r"[\p{L}\p{N}]+"
# All white space of Unicode, and the separators of ASCII.
WHITE_SPACE = "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Spaces of all scripts alone, without tabs, line ends and separators: what trim takes in SQL.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: White space and digits of all scripts in \s and \d, for the patterns that it precedes.
ALL_SCRIPTS = "(?U)"


def normalize_line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize_whitespace(text: Column) -> Column:
    """Ideographic spaces become spaces, lines are stripped, and runs of blank lines become one."""
    lines = F.transform(F.split(F.translate(text, "　 ", "  "), "\n"), lambda x: F.trim(x))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def stripped(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def non_blank_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"{ALL_SCRIPTS}\s+", ""))


def word_tokens(text: Column) -> Column:
    """Lower-case words in order, repeated ones too."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def cjk_bigrams(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), 0)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, pairs))


def search_tokens(text: Column, phrase: bool = True) -> Column:
    """The whole phrase, its words and the bigrams of its CJK runs, each once and in this order."""
    head = F.array(F.lower(F.trim(text))) if phrase else F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(head, word_tokens(text), cjk_bigrams(text)), lambda t: t != ""))


def query_terms(query: Column) -> Column:
    """The whole phrase, then its CJK and alphanumeric runs, each once."""
    return F.array_distinct(F.concat(F.array(F.trim(query)), F.regexp_extract_all(query, F.lit(rf"[{CJK}]+|[A-Za-z0-9]+"), 0)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-case words, each padded by two spaces before and one after."""
    padded = F.transform(word_tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(padded, cut)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def character_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


# Chapter types by patterns of the title, the first that matches wins.
CHAPTER_TYPES = (
    ("afterword", r"(?i)^后记$|完本感言|完本感想|完结感言|^完本$|^完结$|完本说"),
    ("extra", r"(?i)番外|外传|番外篇|番篇"),
    ("author_note", r"^作者说|^作者的话|^PS[:：]|^ps[:：]"),
)


def chapter_type(title: Column) -> Column:
    out = None
    for kind, pattern in CHAPTER_TYPES:
        match = title.rlike(pattern)
        out = F.when(match, kind) if out is None else out.when(match, kind)
    return out.otherwise("normal")


# Numerals.
DIGITS = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "贰": 2, "两": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
MYRIADS = {"万": 10_000, "亿": 100_000_000}
NUMERAL = "".join([*DIGITS, *UNITS, *MYRIADS])


def numeral_value(text: Column) -> Column:
    """Integer of a Chinese or ASCII numeral; a myriad multiplies all that stands before it; null beyond a long in ASCII."""
    digit = F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    myriad = F.create_map(*[F.lit(x) for pair in MYRIADS.items() for x in pair])
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("digit"))

    def step(acc, c):
        total, section, last = acc["total"], acc["section"], acc["digit"]
        d, u, m = F.try_element_at(digit, c), F.try_element_at(unit, c), F.try_element_at(myriad, c)
        out = lambda t, s, x: F.struct(t.cast("long").alias("total"), s.cast("long").alias("section"), x.cast("long").alias("digit"))
        return F.when(m.isNotNull(), out((total + section + last) * m, F.lit(0), F.lit(0))).when(u.isNotNull(), out(total, section + F.greatest(last, F.lit(1)) * u, F.lit(0))).when(d.isNotNull(), out(total, section, d)).otherwise(acc)

    value = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), zero, step, lambda a: a["total"] + a["section"] + a["digit"])
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).otherwise(value)


# Headings.
NUMERAL_HEADING = rf"(第\s*)([{NUMERAL}]+)(\s*[章节回篇])"
HEADING = r"^\s*(?:第\s*\d+\s*[章回篇卷部]|第\s*\d+\s*节(?!课)|楔子|引子|序章|终章|尾声)\s*"
NUMBERED = r"^\s*\d{1,4}[、\s]\s*[^\d\s].{1,50}$"
NUMBERED_PREFIX = r"^\s*\d+[、\s]\s*"


def is_heading(line: Column) -> Column:
    """A chapter heading: a numbered or named one, or a number and a short title."""
    title = stripped(F.regexp_replace(line, ALL_SCRIPTS + NUMBERED_PREFIX, ""))
    is_like = lambda pattern: line.rlike(ALL_SCRIPTS + pattern)
    numbered = is_like(NUMBERED) & ~is_like(NUMBERED_PREFIX + r"\d") & (F.length(title) >= 2) & ~title.startswith("第")
    return is_like(HEADING) | numbered


def arabic_headings(text: Column) -> Column:
    """The text with the number of every numbered heading in digits, wherever it stands."""
    pattern = ALL_SCRIPTS + NUMERAL_HEADING
    group = lambda i: F.regexp_extract_all(text, F.lit(pattern), i)
    joined = lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
    found = F.zip_with(F.zip_with(group(1), F.transform(group(2), lambda n: numeral_value(n).cast("string")), joined), group(3), joined)
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(F.split(text, pattern), found, joined), "")).otherwise(text)


# Lines that are dropped.
BOILERPLATE_LINES = (
    r"^\s*本书来自.{0,30}\s*$",
    r"^\s*本文由.{0,30}(?:提供|发布|整理)\s*$",
    r"(?i)^\s*(?:www|http|https)://[^\s]{3,60}\s*$",
    r"^\s*(?:请到|欢迎来到|推荐|收藏|投票|打赏|订阅).{0,30}\s*$",
    r"(?i)^\s*请记住.*?(?:网站|网址|域名).{0,30}\s*$",
    r"^\s*更多.{0,5}小说.{0,10}(?:尽在|下载).{0,30}\s*$",
    r"^\s*精校小说.{0,30}\s*$",
    r"^\s*[\-=_\*]{5,}\s*$",
    r"^\s*(?:全文完|完本|正文完|大结局)\s*$",
    r"^\s*\(?\s*(?:笔趣阁|起点|晋江|纵横|17k|六九|免费|全本|速读谷|看书|小说网|知轩藏书).{0,20}\s*\)?\s*$",
    r"^\s*(?:求.{0,5}(?:月票|推荐票|收藏|订阅|打赏)|跪求|求支持).{0,20}\s*$",
    r"^\s*(?:无弹窗|手机阅读|客户端|APP).{0,20}\s*$",
    r"^\s*[（\(]?本章完[）\)]?\s*$",
    r"^\s*更新不易.{0,30}\s*$",
    r"^\s*(?:扫码|关注|微信|公众号|QQ|群).{0,30}\s*$",
    r"^\s*添加.*?(?:微信|QQ|群|公众号).{0,30}\s*$",
    r"^\s*[锞晞囂鐜讚魐鏴灚矗薋鬻龘鵺麣鸂鼱].{0,50}\s*$",
    r"^\s*[★☆●○◆◇■□▲△▼▽◐◑◑▓▒░]{3,}\s*$",
)
# Strings that are cut out of lines, in this order.
BOILERPLATE_PARTS = (
    r"[（\(]请记住.*?(?:网站|网址|域名).*?[）\)]",
    r"请记住.*?(?:网站|网址|域名)[^。\n]*",
    r"本文由.{0,20}(?:提供|发布|整理)[^。\n]*",
    r"更新不易.{0,30}(?:章节|分享|速读谷|rg)[^。\n]*",
    r"[（\(]?本章完[）\)]?",
    r"[（\(]ps：[^）\)]*[）\)]",
    r"[（\(]PS：[^）\)]*[）\)]",
    r"ps：求[^。\n]*",
    r"PS：求[^。\n]*",
    r"【[^】]*(?:笔趣阁|小说网|看书|阅读|知轩藏书|一秒记住|记住|秒记住)[^】]*】",
    r"[（\(][^）\)]*(?:笔趣阁|小说网|看书|阅读|知轩藏书)[^）\)]*[）\)]",
    r"[（\(][^）\)]*(?:提醒您|请注意|温馨提示)[^）\)]*[）\)]",
    r"扫码关注.{0,20}",
    r"添加.{0,5}(?:微信|QQ|群|公众号).{0,20}",
    r"(?:微信|公众号|QQ群)[^。\n]*(?:关注|添加|扫码)",
    r"[锞晞囂鐜讚魐鏴灚矗薋鬻龘鵺麣鸂鼱]+",
)


def is_boilerplate(line: Column) -> Column:
    """Every pattern begins with white space at the start of the line, which is taken off once."""
    parts = [f"(?i:{p.removeprefix('(?i)^').removeprefix(chr(92) + 's*')})" if p.startswith("(?i)") else f"(?:{p.removeprefix('^').removeprefix(chr(92) + 's*')})" for p in BOILERPLATE_LINES]
    return stripped(line).rlike(f"{ALL_SCRIPTS}^(?:{'|'.join(parts)})")


#: A character that every part has, and those that parts begin with; lines without them, or without any part, are not cut.
IN_EVERY_PART, PART_STARTS = f"[{CJK}：]", "[（(请本更pP【扫添微公qQ锞晞囂鐜讚魐鏴灚矗薋鬻龘鵺麣鸂鼱]"


def strip_boilerplate(line: Column) -> Column:
    cut, parts = line, [f"(?i:{p})" if re.search("[A-Za-z]", p) else f"(?:{p})" for p in BOILERPLATE_PARTS]  # others have no case
    for part in parts:
        cut = F.regexp_replace(cut, part, "")
    any_part = "|".join(parts)
    return F.when(line.rlike(IN_EVERY_PART) & line.rlike(PART_STARTS) & line.rlike(any_part), cut).otherwise(line)


# Keys whose values are hidden, and values that look like secrets with what replaces them.
SECRET_KEYS = r"(?i)^(authorization|api_key|password|connection_string|database_url|prompt|raw_content|source_text|.*_secret)$"
SECRET_VALUES = (
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"(?i)\b(?:sk|key)-[A-Za-z0-9._-]+", "[REDACTED]"),
    (r"(?i)\b(postgresql(?:\+\w+)?://)[^\s/@:]+:[^\s/@]+@", "$1[REDACTED]@"),
    (r"(?i)\bpassword\s*=\s*[^\s;,]+", "password=[REDACTED]"),
)


def redact(text: Column, most: int = 2000) -> Column:
    """One line, without escape characters and secrets, of at most ``most`` characters."""
    text = F.regexp_replace(F.regexp_replace(text, "\u001b", ""), "[\r\n]+", " ")
    for pattern, new in SECRET_VALUES:
        text = F.regexp_replace(text, pattern, new)
    return F.substring(text, 1, most)


def redact_map(attributes: Column) -> Column:
    return F.transform_values(attributes, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit("[REDACTED]")).otherwise(redact(v)))


def slug(kind: Column, name: Column) -> Column:
    """kind_name in ASCII letters, digits and underscores, or kind_ and 8 digits of SHA-1 where nothing is left."""
    ascii_name = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat_ws("_", kind, F.when(ascii_name == "", F.substring(F.sha1(name), 1, 8)).otherwise(ascii_name))


# Labels of the parts of a text to be embedded, and properties of world entities by type.
PREMISE_LABELS = {"premise": "前提", "theme": "主题", "tone": "基调"}
CHARACTER_LABELS = {"arc_summary": "弧线", "description": "描述", "fatal_flaw": "fatal_flaw", "obsession": "obsession", "soft_spot": "soft_spot", "motivation": "motivation", "narrative_function": "功能"}
ENTITY_NAME, ENTITY_DESCRIPTION, ENTITY_EVIDENCE = "名称", "描述", "证据"
ENTITY_PROPERTIES = {"power_systems": ("levels", "rules"), "factions": ("leader", "strength", "allies", "enemies"), "regions": ("notable_features", "importance")}


def labelled(label: str, value: Column) -> Column:
    """"label: value", or null where the value is null or empty."""
    return F.when(value != "", F.concat(F.lit(f"{label}: "), value))


def labelled_parts(labels: dict[str, str], values: dict[str, Column], otherwise: Column) -> Column:
    """Parts in the order of ``labels``, joined by bars; the fallback where all are missing."""
    return F.coalesce(F.nullif(F.concat_ws(" | ", *[labelled(label, values[key]) for key, label in labels.items()]), F.lit("")), otherwise, F.lit(""))


def premise_text(premise: Column, theme: Column, tone: Column) -> Column:
    """Of a work; theme and tone are arrays."""
    return labelled_parts(PREMISE_LABELS, {"premise": premise, "theme": F.array_join(theme, ", "), "tone": F.array_join(tone, ", ")}, F.lit(""))


def character_text(name: Column, arc_summary: Column, description: Column, psychology: Column, narrative_function: Column) -> Column:
    """Of a character; psychology is a map.  A character without any part is its name."""
    given = {"arc_summary": arc_summary, "description": description, "narrative_function": narrative_function}
    return labelled_parts(CHARACTER_LABELS, {key: given.get(key, F.try_element_at(psychology, F.lit(key))) for key in CHARACTER_LABELS}, name)


def entity_text(kind: Column, name: Column, description: Column, properties: Column, evidence: Column) -> Column:
    """Of a world entity: name, description, the properties that its type calls for, and up to five pieces of evidence.

    ``properties`` maps names to arrays; of a power system's the first five items count.  A type without a list of its
    own has all properties in the order of the map, the first eight items of each.
    """
    items = lambda value, n: F.array_join(F.slice(value, 1, n) if n else value, ", ")
    own = [F.when(kind == k, F.concat_ws(" | ", *[labelled(p, items(F.try_element_at(properties, F.lit(p)), 5 if k == "power_systems" else 0)) for p in ps])) for k, ps in ENTITY_PROPERTIES.items()]
    every = F.filter(F.map_entries(properties), lambda e: F.size(e["value"]) > 0)
    rest = F.array_join(F.transform(every, lambda e: F.concat(e["key"], F.lit(": "), items(e["value"], 8))), " | ")
    told = F.filter(evidence, lambda x: x != "")
    parts = [labelled(ENTITY_NAME, name), labelled(ENTITY_DESCRIPTION, description), F.nullif(F.coalesce(*own, rest), F.lit("")), labelled(ENTITY_EVIDENCE, F.array_join(F.slice(told, 1, 5), "; "))]
    return F.concat_ws(" | ", *parts)


def beat_text(title: Column, description: Column) -> Column:
    """Of a beat: title and description, or the one that there is; null for neither."""
    return F.nullif(F.concat_ws(" | ", F.nullif(title, F.lit("")), F.nullif(description, F.lit(""))), F.lit(""))
