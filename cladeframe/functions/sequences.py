"""Functions of symbols, words and their text forms as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The predefined alphabets, in index order.
DNA, RNA, PROTEIN = "ACGT", "ACGU", "ARNDCQEGHILKMFPSTWYV"
NULL_TOKENS = ("null", "NULL", "nil", "NIL", "none", "None", "NONE")


def symbol_index(symbol: Column, alphabet: str) -> Column:
    """Index of a symbol, from 0; null if the alphabet doesn't have it."""
    return F.nullif(F.instr(F.lit(alphabet), symbol), F.lit(0)) - 1


def is_valid(symbol: Column, alphabet: str) -> Column:
    return symbol.isNotNull() & (F.length(symbol) == 1) & (F.instr(F.lit(alphabet), symbol) > 0)


def word_key(word: Column, alphabet: str) -> Column:
    """Key of a word: sum of index(i) * size^i, the first symbol lowest. Null if a symbol is unknown."""
    n = len(alphabet)
    idx = F.reverse(F.transform(F.split(word, ""), lambda s: symbol_index(s, alphabet).cast("long")))
    return F.aggregate(idx, F.lit(0).cast("long"), lambda a, i: a * n + i)


def key_word(key: Column, k: int, alphabet: str) -> Column:
    n = len(alphabet)
    parts = [F.substring(F.lit(alphabet), (F.floor(key / n**i) % n + 1).cast("int"), F.lit(1)) for i in range(k)]
    return F.concat(*parts)


def kmers(text: Column, k: int) -> Column:
    """All words of k symbols, in order."""
    n = F.length(text) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def mixed_radix(values: list[Column], sizes: list[int]) -> Column:
    """Index of a composite key, the last variable varying fastest."""
    out = F.lit(0).cast("long")
    for v, n in zip(values, sizes):
        out = out * n + v
    return out


def from_mixed_radix(index: Column, sizes: list[int]) -> list[Column]:
    out, below = [], 1
    for n in reversed(sizes):
        out.append((F.floor(index / below) % n).cast("long"))
        below *= n
    return out[::-1]


def tokens(text: Column, separator: str) -> Column:
    """Pieces between separators, empty ones dropped."""
    return F.filter(F.split(text, separator), lambda t: t != "")


def null_token(cell: Column) -> Column:
    """Null for blank cells and the usual words for nothing."""
    return F.when((F.trim(cell) == "") | cell.isin(*NULL_TOKENS), None).otherwise(cell)


def merged_range(text: Column) -> Column:
    """``a-b`` as the mean of its numbers, as text; parts that aren't numbers are joined again, with a hyphen after each."""
    parts = tokens(text, "-")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    whole = F.forall(numbers, lambda v: v.isNotNull())
    return F.when(whole, (F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v) / F.size(parts)).cast("string")).otherwise(F.concat_ws("", F.transform(parts, lambda p: F.concat(p, F.lit("-")))))


def counted_values(text: Column) -> Column:
    """Leading values of ``value_count=n;...`` groups, ranges averaged."""
    groups = tokens(text, ";")
    return F.transform(groups, lambda g: merged_range(F.regexp_extract(g, "^([^_;]+?)(?:;.*)?(?:_.*)?$", 1)).try_cast("double"))


def defline(name: Column) -> Column:
    return F.concat(F.lit(">"), name)


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def ordinal(n: Column) -> Column:
    tail = F.when((n % 100).isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def interval_label(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), low.cast("string"), F.lit(", "), high.cast("string"), F.lit("]"))


def width_thresholds(value: Column, thresholds: list[float]) -> Column:
    """Index of the first threshold at or above a value; one past the last if there is none."""
    out = F.lit(len(thresholds))
    for i in reversed(range(len(thresholds))):
        out = F.when(value <= thresholds[i], i).otherwise(out)
    return out
