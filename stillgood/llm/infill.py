"""Fill-in-the-middle: a text is cut in three by one regular expression with counted quantifiers.

``regexp_count`` tells how many units a text has. Hashes of the row's seed pick the two cuts, and a
pattern made for the row, with possessive groups of exactly so many units, captures prefix, middle
and suffix in one match, whose replacement is the output. Columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One code point; any pattern whose matches, one after the other, cover a text may be the unit.
CODE_POINT = r"."
#: Units that are counted as one match while a text is long, which bounds what counting keeps.
BLOCK_UNITS = 1_024


def count_units(text: Column, unit: str = CODE_POINT) -> Column:
    """Units of a text: whole blocks of them, then the rest one by one."""
    block = f"(?s)(?:{unit}){{{BLOCK_UNITS}}}+"
    rest = F.regexp_replace(text, f"\\A(?:{block})*+", "")
    one = F.lit(f"(?s){unit}")
    return F.regexp_count(text, F.lit(block)).cast("long") * BLOCK_UNITS + F.regexp_count(rest, one)


def hashed(seed: Column, number: int) -> Column:
    """One of the first eight 8-digit groups of the seed's sha256 as an unsigned integer."""
    return F.conv(F.substring(F.sha2(seed, 256), 8 * number + 1, 8), 16, 10).cast("long")


def split_form(docs: DataFrame, seed: Column, text: str = "text", unit: str = CODE_POINT, rate: int = 90, spm: int = 20) -> DataFrame:
    """Adds ``n``, ``form``, ``prefix_units``, ``middle_units`` and ``output`` to the rows of ``docs``.

    Cuts lie after ``h1 % (n+1)`` and ``h2 % (n+1)`` units, ``h`` being 8-digit groups of the seed's
    sha256. ``rate`` percent of the texts are rearranged, ``spm`` percent of those with the suffix
    first. Nulls count as empty; empty texts and texts that hold a marker stay as they are (``plain``,
    no units named). Texts of any length, ties and repeated rows are each cut by their own seed alone;
    an empty table gives none. Columns of ``docs`` that have one of the names given here are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    added = ("_whole", "_n", "_h1", "_h2", "_h3", "_h4")
    rows = docs.withColumns({"_whole": whole, **{f"_h{i + 1}": hashed(seed, i) for i in range(4)}})
    rows = rows.withColumn("_n", count_units(F.col("_whole"), unit))
    n = F.col("_n")
    cuts = [F.col(h) % (n + 1) for h in ("_h1", "_h2")]
    first, last = F.least(*cuts), F.greatest(*cuts)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("_whole"), F.lit(mark))
    form = (F.when((n == 0) | marked | (F.col("_h3") % 100 >= rate), "plain")
            .when(F.col("_h4") % 100 < spm, "spm").otherwise("psm"))
    moved = F.col("form") != "plain"
    rows = rows.withColumn("form", form).withColumns({
        "n": n, "prefix_units": F.when(moved, first), "middle_units": F.when(moved, last - first)})
    group = [F.concat(F.lit(f"((?:{unit}){{"), F.col(c).cast("string"), F.lit("}+)")) for c in ("prefix_units", "middle_units")]
    pattern = F.concat(F.lit(r"(?s)\A"), *group, F.lit("(.*+)"))
    psm, spm_ = f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"
    cut = F.regexp_replace(F.col("_whole"), pattern, F.when(F.col("form") == "psm", psm).otherwise(spm_))
    return rows.withColumn("output", F.when(moved, cut).otherwise(F.col("_whole"))).drop(*added)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; every marker occurs once in it unless the form is plain."""
    psm = F.regexp_replace(output, f"(?s)\\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*+)", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)\\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*+)", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
