"""Reading a target-column clause with column expressions.

The clause is upper-cased and freed of blanks (blanks only). Column names are
looked up as they are, between an opening and a closing mark, anywhere in the
whole text: a lower-case column is therefore never found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords and the marks around a column name.
INCLUDE_MARK = "TRGCOLSINCLUDE"
EXCLUDE_MARK = "TRGCOLSEXCLUDE"
OPENING_MARKS = ("(", ",")
CLOSING_MARKS = (")", ",")


def compact(clause: Column) -> Column:
    return F.replace(F.upper(clause), F.lit(" "), F.lit(""))


def keyword(compacted: Column) -> Column:
    """INCLUDE before EXCLUDE; NULL for a clause with neither, and for no clause."""
    return F.when(F.contains(compacted, F.lit(INCLUDE_MARK)), "INCLUDE").when(
        F.contains(compacted, F.lit(EXCLUDE_MARK)), "EXCLUDE"
    )


def mentions(compacted: Column, column: Column) -> Column:
    tests = [
        F.contains(compacted, F.concat(F.lit(opening), column, F.lit(closing)))
        for opening in OPENING_MARKS
        for closing in CLOSING_MARKS
    ]
    return reduce(lambda a, b: a | b, tests)


def mention_flag(mark: str, compacted: Column, column: Column) -> Column:
    """'Y' when the clause has the keyword and names the column, else 'N'."""
    has_mark = F.contains(compacted, F.lit(mark))
    return F.when(has_mark & mentions(compacted, column), "Y").otherwise("N")
