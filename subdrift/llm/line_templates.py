"""Line dedup with a log-template tree.

A line is parsed at fixed depth: its number of tokens and its leading tokens lead to a
leaf; tokens with a digit are variable from the start. A leaf holds any number of
templates. A token counts as often as lines of the leaf have it at its place; the
constants of a line are its most frequent tokens, as many as a template must have and all
that are as frequent as the least of these; the other places are variable and take any token.
Lines with equal constants share a template. A template (or a line as it is) found in
enough documents is boilerplate and its lines are dropped. Nothing depends on the order of
lines. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import text_column, written

VARIABLE = "<*>"
# A token with a digit, found from its start without going back; tokens stand single-spaced.
_DIGIT_TOKEN = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
_SPACE = "[\\x20\\x09-\\x0D]+"
_KEY = ["_id", "_hash"]


@dataclass(frozen=True)
class Tree:
    """``depth`` leading tokens, lines from ``min_tokens`` tokens, a template from ``min_docs``
    documents and with ``constant_percent`` of its places constant at least."""

    depth: int = 3
    min_tokens: int = 3
    min_docs: int = 10
    constant_percent: int = 50


def drop_templates(documents: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """``documents`` with ``text`` freed of recurring lines, and ``n_lines``, ``n_dropped``.

    Lines are cut at line feeds. Lines of fewer than ``min_tokens`` tokens always stay. A
    null text stays null and has no lines, an empty one has one. Rows of equal id and text
    count as one document and get the same result; a null id is an id like any other.
    Other columns pass through (``n_lines`` and ``n_dropped`` are replaced); an empty
    table stays empty.
    """
    docs = documents.drop("n_lines", "n_dropped")
    # One row per document, with the numbers of its lines to drop, in order.
    dropped = (
        recurring_lines(docs, tree).groupBy(*_KEY).agg(F.array_sort(F.collect_list("_line")).alias("_dropped"))
    )
    keyed = docs.withColumns({"_id": F.col("doc_id"), "_hash": F.xxhash64("text")})
    same = keyed["_id"].eqNullSafe(dropped["_id"]) & (keyed["_hash"] == dropped["_hash"])
    joined = keyed.join(dropped, same, "left").withColumn("_lines", F.split(F.col("text").cast("string"), "\n", -1))
    # One flag per line up to the last dropped one: zeros over each gap, then a one.
    gaps = F.transform(
        F.col("_dropped"),
        lambda line, i: F.concat(
            F.repeat(F.lit("0"), line - F.when(i > 0, F.get("_dropped", i - 1)).otherwise(-1) - 1),
            F.lit("1"),
        ),
    )
    flags = F.split(F.array_join(gaps, ""), "")
    kept = F.filter(
        F.zip_with("_lines", flags, lambda line, flag: F.when(F.coalesce(flag, F.lit("0")) != "1", line)),
        lambda line: line.isNotNull(),
    )
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else keyed[c] for c in docs.columns],
        F.greatest(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def recurring_lines(documents: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """The lines to drop: ``_id, _hash`` (document), ``_line`` (from 0)."""
    # Masked once; what follows reads the lines from files.
    lines = written(_lines(documents, tree), "lines")
    # A leaf with too few lines cannot hold a template; counts combine before the shuffle.
    # Leaves of equal hash only let more lines pass here.
    leaves = written(
        lines.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= tree.min_docs).select("_leaf"), "leaves"
    )
    found = written(lines.join(leaves, "_leaf").select(*_KEY, "_line", "_masked", F.md5("_masked").alias("_key")), "lines")

    # Distinct lines and the number of documents of each.
    documents_of = found.select("_key", "_masked", *_KEY).distinct()
    distinct = written(documents_of.groupBy("_key", "_masked").agg(F.count(F.lit(1)).alias("_docs")), "distinct")
    templates = written(_templates(distinct, tree), "templates")
    members = written(found.drop("_masked").join(templates, "_key"), "members")
    support = (
        members.where("_template is not null").select("_template", *_KEY).distinct().groupBy("_template").agg(F.count(F.lit(1)).alias("_support"))
    )
    recurring = written(support.where(F.col("_support") >= tree.min_docs).select("_template"), "recurring")
    of_template = members.join(recurring, "_template", "left_semi")
    return members.where("_exact").select(*_KEY, "_line").union(of_template.select(*_KEY, "_line")).distinct()


def _lines(documents: DataFrame, tree: Tree) -> DataFrame:
    docs = documents.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), text_column().alias("_text"))
    lines = docs.select(*_KEY, F.posexplode(F.split("_text", "\n", -1)).alias("_line", "_raw"))
    # Most lines need neither replacement.
    spaces = ["  ", *"\t\x0b\x0c\r"]
    odd = reduce(lambda a, b: a | b, [F.col("_raw").contains(c) for c in spaces])
    single = F.when(odd, F.regexp_replace("_raw", _SPACE, " ")).otherwise(F.col("_raw"))
    spaced = lines.select(*_KEY, "_line", F.trim(single).alias("_spaced"))
    variable = F.when(F.col("_spaced").rlike("[0-9]"), F.regexp_replace("_spaced", _DIGIT_TOKEN, VARIABLE))
    masked = spaced.select(*_KEY, "_line", variable.otherwise(F.col("_spaced")).alias("_masked"))
    tokens = F.length("_masked") - F.length(F.replace("_masked", F.lit(" "), F.lit(""))) + 1
    lead = F.substring_index("_masked", " ", tree.depth)
    return masked.where((F.col("_masked") != "") & (tokens >= tree.min_tokens)).select(
        *_KEY, "_line", F.xxhash64(tokens, lead).alias("_leaf"), "_masked"
    )


def _templates(distinct: DataFrame, tree: Tree) -> DataFrame:
    """``_key, _exact, _template`` of the lines that may recur: whether the line as it is stands in
    enough documents, and the digest of its template, if it has one."""
    exact = F.col("_docs") >= tree.min_docs
    lead = F.substring_index("_masked", " ", tree.depth)
    split = distinct.select("_key", "_docs", lead.alias("_lead"), F.split("_masked", " ").alias("_tokens"))
    leaf = F.md5(F.concat_ws(" ", F.size("_tokens").cast("string"), "_lead")).alias("_in")
    tokens = split.select("_key", "_docs", leaf, F.posexplode("_tokens").alias("_place", "_token"))
    counted = tokens.groupBy("_in", "_place", "_token").agg(F.sum("_docs").alias("_n")).where(F.col("_n") >= tree.min_docs)
    placed = tokens.join(counted, ["_in", "_place", "_token"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("_place", "_token", F.coalesce("_n", F.lit(0)).alias("_n"))))
    rows = placed.groupBy("_key", "_in").agg(ordered.alias("_at"))
    # The least count among as many of the most frequent tokens as must be constant.
    needed = F.ceil(F.size("_at") * tree.constant_percent / F.lit(100)).cast("int")
    descending = F.sort_array(F.transform("_at", lambda x: x["_n"]), asc=False)
    least = F.get(descending, F.greatest(needed, F.lit(1)) - 1)
    constants = F.transform("_at", lambda x: F.when(x["_n"] >= F.col("_least"), x["_token"]).otherwise(VARIABLE))
    template = F.md5(F.concat("_in", F.array_join(constants, " ")))
    of_line = rows.withColumn("_least", least).select("_key", F.when(F.col("_least") >= tree.min_docs, template).alias("_template"))
    return distinct.select("_key", exact.alias("_exact")).join(of_line, "_key").where("_exact or _template is not null")
