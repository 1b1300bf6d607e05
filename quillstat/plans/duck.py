"""DuckDB SQL forms of the scalar rules, for the oracle side of the checks.

These build SQL text from the same fixed rule lists the Spark operators use,
but evaluate them with DuckDB's own string/list/regex functions (RE2), so a
pass means two independent engines agree.
"""

from __future__ import annotations

from quillstat.functions.names import EXTRAS_REWRITES
from quillstat.plans.derived import q
from quillstat.sources import rules

_n = [0]


def _v(prefix: str) -> str:
    _n[0] += 1
    return f"{prefix}{_n[0]}"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def count_sub(x: str, lit: str) -> str:
    return f"(len(string_split({x}, {q(lit)})) - 1)"


def has(x: str, lit: str) -> str:
    return f"contains({x}, {q(lit)})"


def strip_extras(x: str) -> str:
    out = x
    for pat, rep in EXTRAS_REWRITES:
        out = f"regexp_replace({out}, {q(pat)}, {q(rep)}, 'g')"
    return strip_ws(out)


def full_names(x: str) -> str:
    b = f"lower({strip_ws(x)})"
    return (f"(CASE WHEN {x} IS NULL OR regexp_matches({b}, '[0-9]') THEN []::VARCHAR[] "
            f"ELSE {_full_level(b, 1)} END)")


def _full_level(b: str, depth: int) -> str:
    p = _v("p")
    leaf = f"[{strip_extras(strip_ws(p))}]"
    if depth >= 3:
        piece = leaf
    else:
        needs = f"({has(p, ';')} OR {has(p, ',')} OR {has(p, ' and ')})"
        piece = f"CASE WHEN {needs} THEN {_full_level(f'lower({strip_ws(p)})', depth + 1)} ELSE {leaf} END"
    parts = (f"CASE WHEN {has(b, ';')} THEN string_split({b}, ';') "
             f"WHEN {has(b, ' and ')} THEN string_split({b}, ' and ') "
             f"WHEN NOT {has(b, ',')} THEN [{b}] "
             f"WHEN {count_sub(b, ' ')} >= 2 THEN string_split({b}, ',') ELSE []::VARCHAR[] END")
    x = _v("x")
    return (f"list_filter(flatten(list_transform({parts}, lambda {p}: {piece})), "
            f"lambda {x}: {x} <> '' AND {x} <> 'based')")


def tokens(x: str) -> str:
    padded = f"regexp_replace({x}, '([,;:?!()\\[\\]{{}}\"&@#$%<>])', ' \\1 ', 'g')"
    padded = f"regexp_replace({padded}, '\\.(\\s*)$', ' . ')"
    t = _v("t")
    return f"list_filter(regexp_split_to_array({strip_ws(padded)}, '\\s+'), lambda {t}: {t} <> '')"


def first_of_full(x: str, drop_last: bool = True) -> str:
    t = tokens(x)
    cand = f"list_slice({t}, 1, greatest(len({t}) - 1, 0))" if drop_last else t
    y = _v("y")
    ok = f"list_filter({cand}, lambda {y}: NOT contains({y}, '.') AND length({y}) <> 1)"
    return f"({ok})[1]"


def first_names(x: str) -> str:
    b = strip_ws(x)
    spaces, commas, conj = count_sub(b, " "), count_sub(b, ","), count_sub(b, " and ")
    p = _v("p")
    a1 = f"CASE WHEN {commas} = 0 AND {conj} = 0 THEN [{first_of_full(b)}] ELSE []::VARCHAR[] END"
    a2 = (f"CASE WHEN {conj} > 0 THEN list_transform(string_split({b}, ' and '), "
          f"lambda {p}: {first_of_full(strip_ws(p))}) ELSE []::VARCHAR[] END")
    given = strip_ws(f"(string_split({b}, ','))[2]")
    a3 = f"CASE WHEN {spaces} < 3 AND {commas} = 1 THEN [{first_of_full(given, False)}] ELSE []::VARCHAR[] END"
    return (f"(CASE WHEN {x} IS NULL OR regexp_matches({x}, '[0-9]') THEN []::VARCHAR[] "
            f"ELSE list_concat(list_concat({a1}, {a2}), {a3}) END)")


def join_names(arr: str) -> str:
    z = _v("z")
    return f"array_to_string(list_transform({arr}, lambda {z}: coalesce({z}, '~')), '|')"


def section_from_url(outlet: str, url: str) -> str:
    """First URL rule of the outlet that matches at the start, its group; NULL if none."""
    per: dict[str, list[tuple]] = {}
    for o, rx, g in rules.SECTION_URL_RULES:
        per.setdefault(o, []).append((rx, g))
    whens = []
    for o, lst in per.items():
        inner = " ".join(f"WHEN regexp_matches({url}, {q(rx)}) THEN regexp_extract({url}, {q(rx)}, {g})"
                         for rx, g in lst)
        whens.append(f"WHEN {q(o)} THEN (CASE {inner} END)")
    return f"(CASE {outlet} {' '.join(whens)} END)"


def opinion_label_sql() -> str:
    vals = ", ".join(f"({q(a)}, {q(b)})" for a, b in rules.OPINION_LABELS)
    return f"(SELECT * FROM (VALUES {vals}) AS t(outlet, label))"


# --- extraction oracle: regex over the raw HTML ------------------------------

def _re_escape(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in ".^$|?*+()[]{}\\" else ch)
    return "".join(out)


def _selector_regex(selector: str) -> str:
    """Regex for the HTML form of a selector (opening tags only)."""
    parts = []
    for step in selector.split():
        if "[" not in step:
            parts.append(f"<{step}>")
            continue
        tag, rest = step.split("[", 1)
        attr, val = rest.rstrip("]").split("=", 1)
        val = val.strip('"')
        if attr.endswith("^"):
            parts.append(f'<{tag} {attr[:-1]}="{_re_escape(val)}[^"]*">')
        else:
            parts.append(f'<{tag} {attr}="{_re_escape(val)}">')
    out = "".join(parts)
    return out


def _rule_detect_and_value(sel: str, attr: str | None) -> tuple[str, str]:
    base = _selector_regex(sel)
    if attr:  # attribute rules are single meta steps: drop the closing '>'
        base = base[:-1]
        return base + "[ >/]", base + f' {attr}="([^"]*)"'
    return base, base + "([^<]*)<"


def first_rule_value(html: str, outlet: str, kind: str) -> tuple[str, str, str]:
    """SQL (value, rule priority, broken flag) of the first rule of each outlet that finds an element."""
    per: dict[str, list[tuple]] = {}
    for row in rules.extractor_rule_rows():
        o, k, prio, sel, attr, rx, grp = row
        if k == kind:
            per.setdefault(o, []).append((prio, sel, attr, rx, grp))
    v_whens, p_whens, b_whens = [], [], []
    for o, lst in per.items():
        vi, pi, bi = [], [], []
        for prio, sel, attr, rx, grp in lst:
            det, valrx = _rule_detect_and_value(sel, attr)
            raw = f"regexp_extract({html}, {q(valrx)}, 1)"
            if rx:
                val = (f"CASE WHEN regexp_matches({raw}, {q(rx)}) THEN {strip_ws(f'regexp_extract({raw}, {q(rx)}, {grp})')} "
                       f"ELSE {raw} END")
            else:
                val = raw
            cond = f"regexp_matches({html}, {q(det)})"
            vi.append(f"WHEN {cond} THEN {val}")
            pi.append(f"WHEN {cond} THEN {prio}")
            bi.append(f"WHEN {cond} THEN NOT regexp_matches({html}, {q(valrx)})" if attr else
                      f"WHEN {cond} THEN false")
        v_whens.append(f"WHEN {q(o)} THEN (CASE {' '.join(vi)} END)")
        p_whens.append(f"WHEN {q(o)} THEN (CASE {' '.join(pi)} END)")
        b_whens.append(f"WHEN {q(o)} THEN (CASE {' '.join(bi)} ELSE false END)")
    return (f"(CASE {outlet} {' '.join(v_whens)} END)", f"(CASE {outlet} {' '.join(p_whens)} END)",
            f"coalesce(CASE {outlet} {' '.join(b_whens)} END, false)")


def clean_byline(x: str) -> str:
    v = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    v = f"(CASE WHEN regexp_matches({v}, '^(BY|By|by) .') THEN substr({v}, 4) ELSE {v} END)"
    return strip_ws(v)


def any_needle(html: str) -> str:
    """Whether any selector of the byline and section rules has all its values behind an '=' of the page."""
    tests = []
    for _, kind, _, sel, *_ in rules.extractor_rule_rows():
        if kind in ("byline", "section_tag"):
            values = [step.split("=", 1)[1].strip('"]') for step in sel.split() if "[" in step]
            ends = ["" if "^=" in step else "\\b" for step in sel.split() if "[" in step]
            tests.append(" AND ".join(f"regexp_matches({html}, {q('=[[:space:]]*[\x22\x27]?' + _re_escape(v) + e)})" for v, e in zip(values, ends)))
    return "(" + " OR ".join(dict.fromkeys(f"({t})" for t in tests)) + ")"


def is_opinion(outlet: str, section: str, labels: list[tuple[str, str]] | None = None) -> str:
    per: dict[str, list[str]] = {}
    for o, lab in labels if labels is not None else rules.OPINION_LABELS:
        per.setdefault(o, []).append(lab.lower())
    whens = " ".join(f"WHEN {q(o)} THEN lower({section}) IN ({', '.join(q(x) for x in labs)})"
                     for o, labs in per.items())
    return (f"(CASE WHEN {outlet} IN ({', '.join(q(o) for o in per)}) AND {section} IS NOT NULL "
            f"AND length({section}) > 0 THEN (CASE {outlet} {whens} END) END)")


def articles_sql(fallback_pages: str | None = None) -> str:
    """Oracle for extract_metadata: stories ⋈ media ⋈ pages, regex extraction.

    ``fallback_pages``: SQL of second-tier pages; a failed story is then extracted from
    its second-tier page instead (P-3)."""
    from quillstat.plans import derived as D
    bv, bp, bb = first_rule_value("p.html", "m.outlet", "byline")
    sv, sp, sb = first_rule_value("p.html", "m.outlet", "section_tag")
    inner = (f"SELECT s.media_id, s.stories_id, s.publish_date, s.url, m.media_name, m.outlet, "
             f"{bv} AS bval, {bp} AS byline_rule, ({bb} OR ({sb} AND {section_from_url('m.outlet', 's.url')} IS NULL)) AS broken, {sv} AS sval, "
             f"{section_from_url('m.outlet', 's.url')} AS usec "
             f"FROM {D.stories_sql()} AS s LEFT JOIN {D.media_sql()} AS m ON s.media_id = m.media_id "
             f"LEFT JOIN {D.pages_sql()} AS p ON s.stories_id = p.stories_id")
    sec = "coalesce(usec, sval, '')"
    byl = f"CASE WHEN bval IS NULL THEN '' ELSE {clean_byline('bval')} END"
    if fallback_pages is not None:
        b2, p2, k2 = first_rule_value("p2.html", "outlet", "byline")
        s2, _, k3 = first_rule_value("p2.html", "outlet", "section_tag")
        sec2 = "coalesce(usec, sval2, '')"
        byl2 = f"CASE WHEN bval2 IS NULL THEN '' ELSE {clean_byline('bval2')} END"
        inner2 = (f"SELECT a.*, {b2} AS bval2, {p2} AS rule2, ({k2} OR ({k3} AND usec IS NULL)) AS broken2, {s2} AS sval2 "
                  f"FROM ({inner}) AS a LEFT JOIN {fallback_pages} AS p2 ON a.stories_id = p2.stories_id")
        return (f"(SELECT media_id, stories_id, publish_date, url, media_name, outlet, "
                f"CASE WHEN broken THEN {byl2} ELSE {byl} END AS byline, "
                f"CASE WHEN broken THEN {sec2} ELSE {sec} END AS section, "
                f"CASE WHEN broken THEN rule2 ELSE byline_rule END AS byline_rule, 'ok' AS status, "
                f"CASE WHEN broken THEN {is_opinion('outlet', sec2)} ELSE {is_opinion('outlet', sec)} END "
                f"AS is_opinion FROM ({inner2}) AS a2 WHERE NOT (broken AND coalesce(broken2, false)))")
    return (f"(SELECT media_id, stories_id, publish_date, url, media_name, outlet, "
            f"CASE WHEN broken THEN NULL ELSE {byl} END AS byline, "
            f"CASE WHEN broken THEN NULL ELSE {sec} END AS section, "
            f"CASE WHEN broken THEN NULL ELSE byline_rule END AS byline_rule, "
            f"CASE WHEN broken THEN 'failed' ELSE 'ok' END AS status, "
            f"CASE WHEN broken THEN 'KeyError' END AS error, "
            f"CASE WHEN broken THEN NULL ELSE {is_opinion('outlet', sec)} END AS is_opinion "
            f"FROM ({inner}) AS a)")
