"""Page gate: which outlets' rules can find anything on a page, from its raw text.

A selector step ``tag[attr="value"]`` needs its value to stand behind an ``=`` in the raw
page (or, for one of several classes, anywhere in it); a step without a value needs
``<tag``. These needles are looked for by native regular expressions, in one pass each,
before any parse. A page that no rule can match is not parsed and its HTML does not reach
Python; on the others only outlets whose needles occur are tried.

The gate never hides an element: a page whose character references can make up a needle's
characters (or separate words, or vanish), or whose declarations the parser refuses, passes
for all outlets.
"""

from __future__ import annotations

import html
import html.entities
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstat.functions.text import let
from quillstat.operators import htmldom

#: White space as the page parser sees it (Unicode's too).
_WS = r"[\s\p{Z}\x1c-\x1f\x85]"
_PUNCT = set("\\.^$|?*+()[]{}-&~#\"'/<>=!:;,@%`")
#: Declarations that are read without an error.
_READ = "temp|cdata|ignore|include|rcdata|if|else|endif"


def _quote(text: str) -> str:
    """A literal for Java's regular expressions."""
    return "".join("\\" + c if c in _PUNCT else c for c in text)


class Needles:
    """Values behind '=' (whole, or their start), class words, and tags of one rule set."""

    def __init__(self) -> None:
        self.whole: set[str] = set()
        self.start: set[str] = set()
        self.words: set[str] = set()
        self.tags: set[str] = set()

    # --- what a rule needs: a list of (kind, text), all of which must be found ------------

    def of_selector(self, selector: str) -> list[tuple[str, str]]:
        need = []
        for tag, attr, op, value in htmldom.parse_selector(selector):
            if attr is None or not value:
                need.append(("tag", tag))
                self.tags.add(tag)
            else:
                (self.whole if op == "=" else self.start).add(value)
                need.append(("value", value))
        return need

    def of_find(self, tag: str, attr: str, value: str) -> list[tuple[str, str]]:
        if not value:
            self.tags.add(tag.lower())
            return [("tag", tag.lower())]
        if attr.lower() == "class":
            self.words.add(value)
            return [("word", value)]
        self.whole.add(value)
        return [("value", value)]

    # --- native tests ------------------------------------------------------------------------

    def _values_pattern(self) -> str:
        # longest first: what stands there is captured whole, shorter needles are its beginnings
        parts = sorted(self.whole | self.start, key=lambda v: (-len(v), v))
        return f"=(?={_WS}*[\"']?(" + "|".join(_quote(v) + ("" if v in self.start else r"(?!\w)") for v in parts) + "))"

    def _tags_pattern(self) -> str:
        # the Kelvin sign is a small k to the parser
        spelled = ["".join("[kK\u212a]" if c == "k" else f"[{c}{c.upper()}]" if c.isalpha() else _quote(c) for c in t) for t in sorted(self.tags, key=lambda t: (-len(t), t))]
        return "<(?=(" + "|".join(spelled) + "))"

    def doubtful_pattern(self) -> str:
        """Character references by which raw text and parsed attributes can differ in a needle."""
        letters = set("".join(self.whole | self.start | self.words))
        codes = [c for c in (*range(1, 0x180), *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF)))
                 if not (image := html.unescape(f"&#{c};")) or letters & set(image)]
        named = [k for k, v in html.entities.html5.items() if letters & set(v)]
        refs = ["#0*(?:" + "|".join(map(str, codes)) + r")(?!\d)", "#[xX]0*(?i:" + "|".join(f"{c:x}" for c in codes) + ")(?![0-9a-fA-F])",
                r"#\d+(?![\d;])", r"#[xX][0-9a-fA-F]+(?![0-9a-fA-F;])", "nbsp(?!;)", *map(_quote, sorted(named))]
        return "&(?:" + "|".join(refs) + ")"

    def candidates(self, page: Column, rules: dict[str, list[list[tuple[str, str]]]]) -> Column:
        """The keys of ``rules`` (key -> the needs of each of its rules) that can find something
        on the page, as an array; null for a null page."""
        nothing = F.array().cast("array<string>")

        def find(pattern: str, any_needle: Iterable) -> Column:
            return F.array_distinct(F.regexp_extract_all(page, F.lit(pattern), F.lit(1))) if any_needle else nothing

        # patterns of their own: each begins with a plain character, which is quick to look for
        doubt = page.rlike(self.doubtful_pattern()) | (page.contains("<![") & page.rlike(rf"<!\[(?!(?i:{_READ})(?![-_.a-zA-Z0-9]))"))
        words = sorted(self.words)
        found = F.struct(find(self._values_pattern() if self.whole | self.start else "", self.whole | self.start).alias("value"),
                         F.transform(find(self._tags_pattern() if self.tags else "", self.tags),
                                     lambda t: F.translate(F.lower(t), "\u212a", "k")).alias("tag"),
                         doubt.alias("doubt"), *[page.contains(w).alias(f"w{i}") for i, w in enumerate(words)])
        known = {"value": self.whole | self.start, "tag": self.tags}

        def test(f: Column, kind: str, needle: str) -> Column:
            if kind == "word":
                return f[f"w{words.index(needle)}"]
            any_of = F.lit(False)  # the needle, or a longer one that begins with it
            for v in sorted(v for v in known[kind] if v.startswith(needle)):
                any_of = any_of | F.array_contains(f[kind], v)
            return any_of

        def passed(f: Column) -> Column:
            keys = []
            for key, needs in rules.items():
                any_rule = F.lit(False)
                for need in sorted({tuple(sorted(set(n))) for n in needs}):
                    all_found = F.lit(True)
                    for kind, needle in need:
                        all_found = all_found & test(f, kind, needle)
                    any_rule = any_rule | all_found
                keys.append(F.when(f["doubt"] | any_rule, F.lit(key)))
            none = ~f["doubt"] & (F.size(f["value"]) == 0) & (F.size(f["tag"]) == 0)
            for i in range(len(words)):
                none = none & ~f[f"w{i}"]
            return F.when(none, nothing).otherwise(F.filter(F.array(*keys), lambda k: k.isNotNull())) if keys else nothing

        return F.when(page.isNotNull(), let(found, passed))


def outlet_candidates(page: Column, rules_by_kind: list[dict[str, list[tuple]]]) -> Column:
    """Outlets whose byline or section-tag rules (outlet -> [(priority, selector, ...)]) can match."""
    needles, needs = Needles(), {}
    for per in rules_by_kind:
        for outlet, lst in per.items():
            needs.setdefault(outlet, []).extend(needles.of_selector(rule[1]) for rule in lst)
    return needles.candidates(page, dict(sorted(needs.items())))


def media_candidates(page: Column, per_media: dict[str, list[tuple]]) -> Column:
    """Media ids whose legacy rules (media id -> [(tag, attr, value)]) can match."""
    needles = Needles()
    needs = {media: [needles.of_find(*rule) for rule in lst] for media, lst in per_media.items()}
    return needles.candidates(page, needs)


def report(pages, candidates: Column, html_col: str = "html"):
    """One row: pages, pages parsed, and outlets tried on the parsed ones (sums)."""
    tried = F.coalesce(F.size(candidates), F.lit(0))
    return pages.select(F.col(html_col).isNotNull().alias("has_page"), tried.alias("tried")).agg(
        F.count_if("has_page").alias("n_pages"), F.count_if(F.col("tried") > 0).alias("n_parsed"), F.sum("tried").alias("n_tried"))

