"""Names of entities as comparable keys, and period labels."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import col

# Letters without a decomposition, Hangul syllables, and name suffixes to drop.
FOLD_FROM, FOLD_TO = "đĐðÐøØłŁ", "dDdDoOlL"
FIRST_SYLLABLE, LAST_SYLLABLE = "\uac00", "\ud7a3"
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]


@cache
def _nfkd() -> tuple[str, str, dict[str, str]]:
    """What NFKD without its marks makes of a character: those that become one (their counterparts)
    or go, and those that become several. Hangul syllables are spelled by rule."""
    one, to, gone, more = "", "", "", {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if FIRST_SYLLABLE <= c <= LAST_SYLLABLE or not (unicodedata.decomposition(c) or unicodedata.combining(c)):
            continue
        plain = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        if not plain:
            gone += c
        elif len(plain) > 1:
            more[c] = plain
        elif plain != c:
            one, to = one + c, to + plain
    return one + gone, to, more


def _decomposed(letters: Column) -> Column:
    """array<struct<from, to>>: those of the letters that become several, syllables apart."""
    more = _nfkd()[2]
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{plain}" for c, plain in more.items())), F.lit("\x01"), F.lit("\x02"))
    runs = [[c for _, c in run] for _, run in groupby(enumerate(more), lambda x: ord(x[1]) - x[0])]
    found = F.regexp_extract_all(letters, F.lit(f"[{''.join(f'{run[0]}-{run[-1]}' for run in runs)}]"), F.lit(0))
    return F.transform(found, lambda c: F.struct(c.alias("from"), table[c].alias("to")))


def _spelled(c: Column) -> Column:
    """A Hangul syllable as its two or three letters."""
    kinds = ["".join(chr(0x1100 + i) for i in range(19)), "".join(chr(0x1161 + i) for i in range(21)), "".join(chr(0x11A8 + i) for i in range(27))]
    lead, vowel, tail = (F.split(F.lit(" ".join(letters)), " ") for letters in kinds)
    n = F.ascii(c) - ord(FIRST_SYLLABLE)
    letters = F.concat(F.get(lead, (n / 588).cast("int")), F.get(vowel, (n % 588 / 28).cast("int")), F.coalesce(F.get(tail, n % 28 - 1), F.lit("")))
    return F.when(c.between(FIRST_SYLLABLE, LAST_SYLLABLE), letters).otherwise(c)


def strip_marks(x: str | Column) -> Column:
    """Letters without diacritics, by NFKD, which is not among Spark's functions: it goes by character, so
    its tables are given to functions that are."""
    text = F.replace(F.translate(col(x), FOLD_FROM, FOLD_TO), F.lit("ß"), F.lit("ss"))
    found = _decomposed(F.array_join(F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7F]+", ""), "")), ""))
    # characters without a counterpart in the second list go
    merge = lambda s, m: F.replace(s, m["from"], m["to"])
    spelled = lambda s: F.array_join(F.transform(F.split(s, ""), _spelled), "")
    # what is merged is a variable at the end, which is not computed again
    end = lambda s: F.when(F.regexp_like(s, F.lit(f"[{FIRST_SYLLABLE}-{LAST_SYLLABLE}]")), spelled(s)).otherwise(s)
    return F.aggregate(found, F.translate(text, *_nfkd()[:2]), merge, end)


def normalized(x: str | Column, stripped: bool = False) -> Column:
    """Lower-case words without marks, punctuation and suffixes; runs of single
    letters are one word ("P. J." = "PJ")."""
    s = F.lower(F.trim(col(x) if stripped else strip_marks(x)))
    s = F.regexp_replace(s, "[.'’`´]", "")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(SUFFIXES))
    return F.regexp_replace(F.array_join(words, " "), r"(?U)(?<!\S)(\p{L}) (?=\p{L}(?!\S))", "$1")


def match_key(x: str | Column, stripped: bool = False) -> Column:
    """The normalised words in sorted order."""
    return F.array_join(F.array_sort(F.split(normalized(x, stripped), " ")), " ")


def titled(x: str | Column) -> Column:
    """Capital after space, hyphen and apostrophe."""
    out = F.lower(col(x))
    for mark in ("'", "-", " "):
        capital = lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w)))
        out = F.array_join(F.transform(F.split(out, mark), capital), mark)
    return out


def first_last(x: str | Column) -> Column:
    """"LAST, FIRST" as "First Last"; names without a comma keep their order."""
    # at the first comma: what follows may have more
    last, first = (F.trim(F.regexp_extract(col(x), r"(?s)^([^,]*),(.*)$", i)) for i in (1, 2))
    return titled(F.when(F.contains(col(x), F.lit(",")), F.concat_ws(" ", first, last)).otherwise(F.trim(col(x))))


def period_id(group: str | Column, period: str | Column) -> Column:
    return F.concat(col(group), F.lit("_"), col(period).cast("string"))


def parse_period(x: str | Column, groups: list[str]) -> Column:
    """struct<grp, period> of "{group}_{digits}"; an error for anything else."""
    good = F.regexp_like(col(x), F.lit(r"^(" + "|".join(groups) + r")_\d+$"))
    at = F.struct(F.regexp_extract(col(x), r"^(.*)_(\d+)$", 1).alias("grp"), F.regexp_extract(col(x), r"^(.*)_(\d+)$", 2).alias("digits"))
    checked = F.when(good, at).otherwise(F.raise_error(F.concat(F.lit("not a period id: "), F.coalesce(col(x), F.lit("NULL")))).cast("struct<grp:string,digits:string>"))
    return F.struct(checked["grp"].alias("grp"), checked["digits"].cast("int").alias("period"))


def period_label(period: str | Column) -> Column:
    """1987 as "1987-88", the last year of a century as its number and "-00"."""
    return F.concat(col(period).cast("string"), F.lit("-"), F.lpad(F.pmod(col(period) + 1, F.lit(100)).cast("string"), 2, "0"))


def direction(source: str | Column, target: str | Column) -> Column:
    return F.concat(col(source), F.lit("->"), col(target))
