"""Text functions as Columns. Only NFKC has no Spark function; it is one Arrow UDF between native steps."""

from __future__ import annotations

import unicodedata

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the normal form: marks that are dropped, bracketed references, punctuation of equal meaning, dashes.
DROPPED = "[\u2460-\u24FF\u2776-\u2793\u00B9\u00B2\u00B3\u2070-\u2079\u200B-\u200D\uFEFF]"
REFERENCES = "[\\[\uFF3B](?U:\\s*\\d{1,3}\\s*)(?:[-,\uFF0C\u3001](?U:\\s*\\d{1,3}\\s*))*[\\]\uFF3D]"
PUNCTUATION_FROM = "“”„‟「」『』〝〞‘’‚‛，、。．…：；！？（）【】《》〈〉"
PUNCTUATION_TO = "\"\"\"\"\"\"\"\"\"\"'''',,...:;!?()[]<><>"
DASHES = "[\u2010-\u2015\u2212\u2500\uFE58\uFE63\uFF0D-]+"
PARAGRAPH_ENDS = ("。", "！", "？", "”", "」", "』")
HEADING = r"^(?:[一二三四五六七八九十]+[、.．]|[（(](?:[一二三四五六七八九十]|(?U:\d))+[)）]|(?U:\d+)(?:\.(?U:\d+))*(?:[、.．]|(?U:\s))|引言|导言|结语|结论|参考文献|摘(?U:\s*)要|关(?U:\s*)键(?U:\s*)词)"
ABSTRACT = r"(?is)(?:内容)?摘(?U:\s*)要(?U:\s*)[:：]?(?U:\s*)(.+?)(?U:\s*)(?:关(?U:\s*)键(?U:\s*)词|关键字|key(?U:\s*)words|中图分类号)"
LOCATOR = r"(?i)P(?U:\s*)((?U:\d+))(?:(?U:\s*)[-~–—至](?U:\s*)P?(?U:\s*)((?U:\d+)))?"
LOCATOR_SPAN = 20
QUOTE_MARKS = "['\"]"
#: Characters of the property White_Space, as (?U:\\s) has them.
WHITE = "\t\n\x0B\f\r \x85\xA0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000"
#: Decimal digits of all scripts, and the same in ASCII.
DIGITS = "".join(chr(c) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def without_white(text: Column) -> Column:
    """White space and separators dropped, by character: a match for each word costs a regular expression more than all else."""
    return F.translate(text, WHITE + "\x1C\x1D\x1E\x1F", "")


def folded(text: Column) -> Column:
    """The steps of normalize that follow NFKC, all native: references, punctuation, dashes, dots, white space, case."""
    out = F.regexp_replace(text, REFERENCES, "")
    out = F.translate(out, PUNCTUATION_FROM, PUNCTUATION_TO)
    out = F.regexp_replace(F.regexp_replace(out, DASHES, "-"), "\\.{2,}", ".")
    return F.lower(without_white(out))


def folded_ascii(text: Column) -> Column:
    """What `folded` comes to for an ASCII text."""
    out = F.regexp_replace(F.regexp_replace(text, REFERENCES, ""), "-{2,}", "-")
    return F.lower(without_white(F.regexp_replace(out, "\\.{2,}", ".")))


def normalize(text: Column) -> Column:
    """The symmetric normal form in which quotes and texts are compared. Null stays null. ASCII texts are their own NFKC and
    don't go to the UDF. The text is named more than once: give a column where it is costly to make."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, folded_ascii(text)).otherwise(folded(nfkc(F.when(~ascii_only, F.regexp_replace(text, DROPPED, "")))))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed a single time, also within lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ascii_fold(text: Column) -> Column:
    """The part of normalize that any SQL engine shares: case and ASCII white space."""
    return F.lower(F.translate(text, " \t\n\x0B\f\r", ""))


def cjk_heavy(text: Column) -> Column:
    """Whether over 30 % of the characters are CJK ideographs."""
    return F.length(F.regexp_replace(text, "[^\u4E00-\u9FFF]+", "")) > 0.3 * F.length(text)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def joined_lines(block: Column) -> Column:
    """Non-empty lines of a block, stripped and joined: without a blank in CJK text."""
    lines = F.filter(F.transform(F.split(block, "\n"), stripped), lambda x: x != "")
    return F.when(cjk_heavy(block), F.array_join(lines, "")).otherwise(F.array_join(lines, " "))


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def blocks(text: Column, delimiter: str = "\n(?U:\\s*)\n") -> Column:
    """Non-empty parts between blank lines (or another delimiter)."""
    return F.filter(F.transform(F.split(line_feeds(text), delimiter), stripped), lambda x: x != "")


def hard_wrapped(text: Column, ends: tuple[str, ...] = PARAGRAPH_ENDS, heading: str = HEADING) -> Column:
    """Paragraphs of a text with hard line wraps: a heading-like line stands alone, other lines run on until one ends a
    sentence. One fold over the lines, within the row."""
    lines = F.filter(F.transform(F.split(line_feeds(text), "\n"), stripped), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def flushed(s: Column) -> Column:
        return F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, line: Column) -> Column:
        alone = (F.length(line) <= 30) & line.rlike(heading)
        final = F.right(line, F.lit(1)).isin(*ends)
        run = F.concat(s["open"], line)
        return F.when(alone, F.struct(F.concat(flushed(s), F.array(line)).alias("done"), F.lit("").alias("open"))).when(final, F.struct(F.concat(s["done"], F.array(run)).alias("done"), F.lit("").alias("open"))).otherwise(F.struct(s["done"].alias("done"), run.alias("open")))

    return F.reduce(lines, start, step, flushed)


def paragraphs(text: Column, delimiter: str = "\n(?U:\\s*)\n", least_blocks: int = 5, short: int = 3000, ends: tuple[str, ...] = PARAGRAPH_ENDS) -> Column:
    """array<string>: blank-line blocks if there are enough of them or the text is short, else hard-wrapped paragraphs."""

    def chosen(t: Column) -> Column:
        return once(blocks(t, delimiter), lambda found: F.when((F.size(found) >= least_blocks) | (F.length(t) < short), F.transform(found, joined_lines)).otherwise(hard_wrapped(t, ends)))

    return once(line_feeds(text), chosen)


def numbered(pars: Column) -> Column:
    """`[P1] ...` lines."""
    return F.array_join(F.transform(pars, lambda p, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("] "), p)), "\n")


def located(loc: Column) -> Column:
    """Paragraph numbers of a locator such as `P12-P14`; a range has 21 at most; anything else gives none."""
    text = F.translate(F.coalesce(loc, F.lit("")), DIGITS, ASCII_DIGITS)
    first, last = (F.regexp_extract_all(text, F.lit(LOCATOR), F.lit(g)) for g in (1, 2))
    pairs = F.arrays_zip(first.alias("a"), last.alias("b"))

    def run(p: Column) -> Column:
        a = p["a"].cast("long")
        b = F.when(p["b"] == "", a).otherwise(p["b"].try_cast("long"))
        lo, hi = F.least(a, b), F.greatest(a, b)
        return F.sequence(lo, F.least(hi, lo + LOCATOR_SPAN))

    return F.flatten(F.transform(pairs, run))


def abstract(text: Column, limit: int = 1500, within: int = 20_000) -> Column:
    """What stands between the abstract's and the keywords' marks, without white space."""
    return F.substring(F.regexp_replace(F.regexp_extract(F.substring(text, 1, within), ABSTRACT, 1), "(?U)\\s+", ""), 1, limit)


def first_half(text: Column, none: str = "(none)") -> Column:
    """The first half of the characters, at least one; a placeholder for an empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(none)).otherwise(F.substring(text, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(text) / 2).cast("int"))))


def title_key(title: Column) -> Column:
    return F.regexp_replace(normalize(title), QUOTE_MARKS, "")


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")


def without_leading_comment(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)^\\s*<!--.*?-->\n*", "")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {{NAME}} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return template
