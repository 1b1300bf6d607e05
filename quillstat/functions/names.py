"""Byline → people and first names, as native column expressions.

The splitting rules are bounded (at most three nested delimiter levels), so the
"recursive" split is unrolled into nested ``transform``/``flatten`` expressions
and never leaves the JVM.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstat.functions.text import PUNCT_CLASS, _c, count_sub, has_sub, let, strip_ws, tokens

# ---------------------------------------------------------------------------
# FIXED VALUES: ordered clean-up rewrites applied to a lower-cased person name.
# (pattern, replacement); Python regex syntax, applied in this order.
# ---------------------------------------------------------------------------
EXTRAS_REWRITES = [
    (r"general sir ", ""),
    (r"american way: ", ""),
    (r"president", ""),
    (r"sir", ""),
    (r"gov(\.)?", ""),
    (r"rep(\.)?", ""),
    (r"prof", ""),
    (r"professor", ""),
    (r".*?rt rev(d)?", ""),
    (r"\n.*", ""),
    (r"more stories by ", ""),
    (r"view author.*", ""),
    (r"founder of.*", ""),
    (r" is (a)?.*", ""),
    (r" covers.*", ""),
    (r" in .*", ""),
    (r" info.*", ""),
    (r" writes .*", ""),
    (r"graphic(s)? by(:)?", ""),
    (r"compiled ", ""),
    (r"exclusive ", ""),
    (r"special dispatch", ""),
    (r"as told to ", ""),
    (r" for .*", ""),
    (r"  .*", ""),
    (r"interview(ed)?(s)? ", ""),
    (r" at.*", ""),
    (r"^\| ", ""),
    (r"^(by|By|BY) ", ""),
    (r".*? by ", ""),
    (r"\s\s", " "),
    (r"\s\s", " "),
    (r"^dr ", ""),
]

def rewrite_trigger(patterns: list[str]) -> str:
    """One alternation that matches where any of the rewrites can match: what a pattern only takes along
    (leading ``.*?``, trailing ``.*``, an optional end) is left out, which changes nothing in whether it matches."""
    out = []
    for p in patterns:
        old = None
        while p != old:
            old, p = p, re.sub(r"\.\*$|\([^()|]*\)\?$", "", re.sub(r"^\.\*\?", "", p))
        out.append(f"(?:{p})")
    return "(?d)" + "|".join(dict.fromkeys(out))


def _empty() -> Column:
    return F.array().cast("array<string>")


def strip_extras(col) -> Column:
    """Ordered titles/suffix rewrites then strip (input expected lower case).

    ``(?d)``: only ``\\n`` ends a line for ``.``, as in Python's ``re``. A name in which no pattern
    matches is not changed by the first rewrite, so by none: it skips them all.
    """
    def rewritten(s: Column) -> Column:
        return reduce(lambda acc, pr: F.regexp_replace(acc, "(?d)" + pr[0], pr[1]), EXTRAS_REWRITES, s)

    trigger = rewrite_trigger([p for p, _ in EXTRAS_REWRITES])
    return let(_c(col), lambda s: strip_ws(F.when(s.rlike(trigger), rewritten(s)).otherwise(s)))


def full_names(col) -> Column:
    """People of a byline, lower case: split on ';', else ' and ', else ',' (when there
    are at least two spaces); pieces that still hold a delimiter are split again.
    Null, digits, or a single 'surname, name' give an empty array."""
    raw = _c(col)
    return let(F.lower(strip_ws(raw)), lambda b: F.when(raw.isNull() | b.rlike("[0-9]"), _empty())
               .otherwise(_full_names_level(b, 1)))


def _needs_split(p: Column) -> Column:
    return has_sub(p, ";") | has_sub(p, ",") | has_sub(p, " and ")


def _full_names_level(b: Column, depth: int) -> Column:
    spaces = count_sub(b, " ")

    def piece(p: Column) -> Column:
        leaf = F.array(strip_extras(strip_ws(p)))
        if depth >= 3:  # three levels exhaust ';' → ' and ' → ','
            return leaf
        return F.when(_needs_split(p), let(F.lower(strip_ws(p)), lambda q: _full_names_level(q, depth + 1))
                      ).otherwise(leaf)

    parts = (F.when(has_sub(b, ";"), F.split(b, ";"))
             .when(has_sub(b, " and "), F.split(b, " and "))
             .when(~has_sub(b, ","), F.array(b))
             .when(spaces >= 2, F.split(b, ","))
             .otherwise(_empty()))
    res = F.flatten(F.transform(parts, piece))
    return F.filter(res, lambda x: (x != F.lit("")) & (x != F.lit("based")))


def first_name_of_full(col, drop_last: bool = True) -> Column:
    """First token without a '.' and longer than one char; the last token (surname)
    is not a candidate unless ``drop_last`` is False. Null when none."""
    def first(t: Column) -> Column:
        cand = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))) if drop_last else t
        return F.try_element_at(F.filter(cand, lambda x: ~x.contains(".") & (F.length(x) != 1)), F.lit(1))
    return let(tokens(_c(col)), first)


def first_name_of_reversed(col) -> Column:
    """'Surname, Given names' → first given name (all tokens are candidates)."""
    given = F.try_element_at(F.split(_c(col), ","), F.lit(2))
    return first_name_of_full(strip_ws(given), drop_last=False)


def first_names(col) -> Column:
    """First names of a byline (may hold nulls = a name without usable given name).

    Not exclusive: (i) no comma and no ' and ' → the byline as one name; (ii) each
    ' and ' part; (iii) fewer than 3 spaces and exactly one comma → reversed form.
    Null or any digit → empty.
    """
    raw = _c(col)

    def body(b: Column) -> Column:
        spaces, commas, conj = count_sub(b, " "), count_sub(b, ","), count_sub(b, " and ")
        a1 = F.when((commas == 0) & (conj == 0), F.array(first_name_of_full(b))).otherwise(_empty())
        a2 = F.when(conj > 0, F.transform(F.split(b, " and "), lambda p: first_name_of_full(strip_ws(p)))) \
            .otherwise(_empty())
        a3 = F.when((spaces < 3) & (commas == 1), F.array(first_name_of_reversed(b))).otherwise(_empty())
        return F.concat(a1, a2, a3)
    return F.when(raw.isNull() | raw.rlike("[0-9]"), _empty()).otherwise(let(strip_ws(raw), body))


def drop_punct(col) -> Column:
    """Remove ASCII punctuation characters."""
    return F.regexp_replace(_c(col), PUNCT_CLASS, "")


def plus_to_space(col) -> Column:
    return F.translate(_c(col), "+", " ")


def space_to_plus(col) -> Column:
    return F.translate(_c(col), " ", "+")


def join_names(arr: Column, null_token: str = "~") -> Column:
    """Stable text form of a name array for reports and comparisons."""
    return F.array_join(arr, "|", null_token)
