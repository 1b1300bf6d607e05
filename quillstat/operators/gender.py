"""Gender of bylines and names, with a manual override sheet.

The name table (first_name → gender) stands in for the external guesser.
Lookups never leave the JVM:

* a table of at most ``LITERAL_BYTES`` of names (some 200,000) is searched inside the projection
  (``functions.lookup``), so a byline's names are classified where the row is - no join, no
  shuffle, and what made the rows (the page parse) runs once;
* a larger one is joined on salted names, so a name that a third of all rows share is spread
  over tasks. The rows are stored once first: neither form evaluates its input twice.

``name_lookup`` picks the form; every function here takes either and gives the same rows.

A name listed under both genders is unknown on either path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.lookup import LITERAL_BYTES, few_rows, member
from quillstat.functions.names import drop_punct, first_names, plus_to_space, space_to_plus
from quillstat.functions.text import _c, ascii_fold_native, let, strip_ws
from quillstat.operators.joins import small_side
from quillstat.session import stored
from quillstat.sources.rules import OVERRIDE_LABELS

#: Join keys that one name's rows are spread over.
SALTS = 16


def name_sets(names: DataFrame, max_bytes: int = LITERAL_BYTES) -> tuple[list[str], list[str]] | None:
    """(female, male) lower-case first names when they take at most ``max_bytes``."""
    used = names.where(F.col("gender").isin("female", "male") & F.col("first_name").isNotNull()).select(
        F.lower("first_name").alias("n"), "gender")
    rows = few_rows(used, "n", max_bytes)
    if rows is None:
        return None
    fem = {r.n for r in rows if r.gender == "female"}
    mal = {r.n for r in rows if r.gender == "male"}
    return sorted(fem - mal), sorted(mal - fem)  # a name listed under both is unknown


def name_lookup(names: DataFrame, max_bytes: int = LITERAL_BYTES) -> tuple[list[str], list[str]] | DataFrame:
    """``name_sets(names)`` where the table is small enough for a literal, else the table itself."""
    sets = name_sets(names, max_bytes)
    return names if sets is None else sets


def one_gender(names: DataFrame) -> DataFrame:
    """(_k, _g): one row per lower-case name listed under exactly one of female and male."""
    used = names.where(F.col("gender").isin("female", "male") & F.col("first_name").isNotNull())
    both = used.groupBy(F.lower("first_name").alias("_k")).agg(F.min("gender").alias("_g"), F.max("gender").alias("_h"))
    return both.where("_g = _h").select("_k", "_g")


def _salted_names(names: DataFrame) -> DataFrame:
    """(_k, _g, _salt): ``one_gender`` once for every salt."""
    return one_gender(names).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def gender_counts(names_arr: Column, sets: tuple[list[str], list[str]]) -> tuple[Column, Column, Column]:
    """female, male, unknown counts of a first-name array (a null name counts as unknown)."""
    fem, mal = sets
    f = F.size(F.filter(names_arr, lambda n: member(F.lower(n), fem)))
    m = F.size(F.filter(names_arr, lambda n: member(F.lower(n), mal)))
    return f, m, F.size(names_arr) - f - m


def byline_gender(df: DataFrame, names: DataFrame, byline_col: str = "byline",
                  key_cols: list[str] | None = None, max_inline: int = LITERAL_BYTES,
                  sets: tuple[list[str], list[str]] | DataFrame | None = None) -> DataFrame:
    """df + female, male, unknown (INT) over the byline's first names. ``sets``: the
    result of ``name_lookup(names)`` when the caller already has it; ``max_inline``: the bytes of names
    up to which they are searched in the projection. ``key_cols`` is no longer used (rows need no key)."""
    if sets is None:
        sets = name_lookup(names, max_inline)
    if isinstance(sets, tuple):
        # materialise the name array once so the three counts share it
        tmp = df.withColumn("_fn", first_names(F.col(byline_col)))
        f, m, _ = gender_counts(F.col("_fn"), sets)
        return (tmp.withColumn("female", f).withColumn("male", m)
                .withColumn("unknown", F.size("_fn") - F.col("female") - F.col("male")).drop("_fn"))
    # rows are stored once with a number; only (number, name) goes to the names and back
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "byline-rows")
    ex = rows.select("_row", F.explode(first_names(F.col(byline_col))).alias("_fn")).withColumns(
        {"_k": F.lower("_fn"), "_salt": F.pmod(F.col("_row"), F.lit(SALTS)).cast("int")})
    found = ex.join(_salted_names(sets), ["_k", "_salt"], "left").groupBy("_row").agg(
        F.count_if(F.col("_g") == "female").cast("int").alias("_f"), F.count_if(F.col("_g") == "male").cast("int").alias("_m"),
        F.count(F.lit(1)).cast("int").alias("_n"))
    zero = F.lit(0)
    return (rows.join(found, "_row", "left").withColumn("female", F.coalesce("_f", zero)).withColumn("male", F.coalesce("_m", zero))
            .withColumn("unknown", F.coalesce("_n", zero) - F.col("female") - F.col("male")).drop("_row", "_f", "_m", "_n"))


def guess(first_name: Column, sets: tuple[list[str], list[str]]) -> Column:
    """Gender label of a first name (null or not in the table → unknown)."""
    fem, mal = sets
    return let(F.lower(first_name), lambda n: F.when(member(n, fem), F.lit("female"))
               .when(member(n, mal), F.lit("male")).otherwise(F.lit("unknown")))


def single_name_gender(col, sets: tuple[list[str], list[str]]) -> Column:
    """Gender of one person's name: blank → unknown; only the first extracted first name counts."""
    def body(s: Column) -> Column:
        n0 = F.try_element_at(first_names(s), F.lit(1))
        return F.when(s.isNull() | (F.length(s) == 0), F.lit("unknown")).otherwise(guess(n0, sets))
    return let(strip_ws(_c(col)), body)


def single_name_gender_ascii(col, sets: tuple[list[str], list[str]]) -> Column:
    """As single_name_gender after NFKD folding to ASCII (null-safe; native expressions,
    names are short)."""
    return single_name_gender(ascii_fold_native(col), sets)


def with_gender(df: DataFrame, name: Column, lookup: tuple[list[str], list[str]] | DataFrame,
                out_col: str = "gender", fold: bool = False) -> DataFrame:
    """``df`` plus the gender label of one person's name (as ``single_name_gender``; with ``fold``
    as ``single_name_gender_ascii``), by a ``name_lookup`` of either form."""
    if isinstance(lookup, tuple):
        return df.withColumn(out_col, (single_name_gender_ascii if fold else single_name_gender)(name, lookup))
    first = let(strip_ws(ascii_fold_native(name) if fold else name),
                lambda s: F.lower(F.try_element_at(first_names(s), F.lit(1))))
    keyed = df.withColumn("_k", first).withColumn("_salt", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
    joined = keyed.join(_salted_names(lookup), ["_k", "_salt"], "left")
    return joined.select(*[joined[c] for c in df.columns], F.coalesce("_g", F.lit("unknown")).alias(out_col))


# --- manual overrides ---------------------------------------------------------

def clean_overrides(sheet: DataFrame) -> DataFrame:
    """Raw sheet rows (org, name, count, gender, row_no; '+' for spaces) → one row per
    (org, name): the last row with an accepted label wins. Rejected rows are dropped
    here; ``override_rejects`` returns them."""
    s = sheet.select(plus_to_space("org").alias("org"), plus_to_space("name").alias("name"),
                     F.col("count").cast("long").alias("count"), "gender", "row_no")
    ok = s.where(F.col("gender").isin(OVERRIDE_LABELS))
    best = ok.groupBy("org", "name").agg(F.max_by(F.struct("gender", "count"), "row_no").alias("b"))
    return best.select("org", "name", F.col("b.gender").alias("gender"), F.col("b.count").alias("count"))


def prepare_overrides(sheet: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """Cleaned override sheet, size-checked ONCE for broadcasting to the name joins."""
    return small_side(clean_overrides(sheet), max_rows=max_rows)


def override_rejects(sheet: DataFrame) -> DataFrame:
    return sheet.where(~F.coalesce(F.col("gender").isin(OVERRIDE_LABELS), F.lit(False)))


def org_name_gender(df: DataFrame, overrides: DataFrame, sets, org_col: str = "org",
                    name_col: str = "name", out_col: str = "gender") -> DataFrame:
    """Manual gender for (org, name without punctuation) when present, else the guess.
    ``overrides``: output of ``prepare_overrides`` (cleaned, size-checked)."""
    ov = (overrides.select(F.col("org").alias("_o"), F.col("name").alias("_n"),
                                     F.col("gender").alias("_manual")))
    t = df.withColumn("_np", drop_punct(F.col(name_col)))
    j = t.join(ov, (F.col(org_col) == F.col("_o")) & (F.col("_np") == F.col("_n")), "left")
    j = with_gender(j, F.col("_np"), sets, "_guess")
    g = F.when(F.col("_manual").isin(OVERRIDE_LABELS), F.col("_manual")).otherwise(F.col("_guess"))
    return j.withColumn(out_col, g).drop("_o", "_n", "_manual", "_np", "_guess")


def online_org_name_gender(df: DataFrame, overrides: DataFrame, org_col: str = "org",
                           name_col: str = "name", out_col: str = "manual_gender") -> DataFrame:
    """Manual gender for exactly (org, name), else ''. ``overrides`` as for org_name_gender."""
    ov = (overrides.select(F.col("org").alias("_o"), F.col("name").alias("_n"),
                                     F.col("gender").alias("_manual")))
    j = df.join(ov, (F.col(org_col) == F.col("_o")) & (F.col(name_col) == F.col("_n")), "left")
    return j.withColumn(out_col, F.coalesce(F.col("_manual"), F.lit(""))).drop("_o", "_n", "_manual")


def org_name_export(org_names: DataFrame, overrides: DataFrame, sets) -> DataFrame:
    """Current (org, name, n) merged with the override sheet: every name of either side once.
    Columns org, name ('+' for spaces), auto_gender, n, manual_gender ('' when none)."""
    a = org_names.select(F.col("org").alias("a_org"), F.col("name").alias("a_name"), "n")
    o = overrides.select(F.col("org").alias("o_org"), F.col("name").alias("o_name"),
                         F.col("gender").alias("o_gender"), F.col("count").alias("o_count"))
    j = a.join(o, (F.col("a_org") == F.col("o_org")) & (F.col("a_name") == F.col("o_name")), "full_outer")
    name = F.coalesce("a_name", "o_name")
    return with_gender(j, name, sets, "auto_gender").select(
        space_to_plus(F.coalesce("a_org", "o_org")).alias("org"),
        space_to_plus(name).alias("name"),
        "auto_gender",
        F.coalesce(F.col("n"), F.col("o_count")).alias("n"),
        F.coalesce(F.col("o_gender"), F.lit("")).alias("manual_gender"),
    )
