"""Personal data: candidate spans, gradient boosted trees, calibrated thresholds.

Strict patterns give the base spans. Wide patterns propose further spans, which may
overlap; boosted trees score each by its format and its context, and a threshold found
on held-out candidates selects those to add. The trees are fitted by Spark's own library
on all labelled candidates, counted by their features, and then written out as plain column
expressions, so the whole corpus is scored beside its text: DataFrame functions only, and
no shuffle but that of the counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import text_column, written

# The base kinds in order, each with a test a text must pass to be searched
# and its pattern. A match starts where a run of its first class starts or where the last
# match ended, so no run is gone through twice; loops without a bound are possessive and
# so never go back; loops over groups are bounded where a longer match would be dropped
# anyway.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": ("@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9]){12}",
        r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    ),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Ours: the wide patterns, in the order their kinds are listed after the base kinds.
_WORD_START = r"(?<![^\x20\x09-\x0D])"
WIDE = {
    "email_like": (
        r"@|\(at\)|\[at\]",
        rf"{_WORD_START}[^\x20\x09-\x0D@]+?(?:@|\x20?(?:\(at\)|\[at\])\x20?)[^\x20\x09-\x0D@]{{2,}}+",
    ),
    "number_like": (r"[0-9](?:[\x20().-]?[0-9]){6}", r"[0-9](?<![0-9][0-9])(?:[\x20().-]{0,2}[0-9]){6,}+"),
    "secret_like": (
        "[=:]",
        r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"'\x20]{0,2}[=:]\x20?[\"']?[^\x20\x09-\x0D\"']{6,}+",
    ),
    "code_like": ("[0-9]", rf"{_WORD_START}[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"),
}
_AT = r"\x20?(?:\(at\)|\[at\])\x20?"
_HOST_END = r"\.[A-Za-z]{2,}[^A-Za-z0-9]*$"
_SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"
_SEEN = "array<struct<kind:string,start:int,end:int,match:string,left:string,right:string>>"
# Matches whose places are added up together; the pieces are joined at the end, so that
# work grows with the matches and not with their square.
_CHUNK = 64
# Steps of a margin of 1 that thresholds are told apart by.
_STEPS = 1000
# Rows of one part that trees learn from, and rows from whose values Spark always bounds its bins.
_PART_ROWS, _BINNED_WHOLE = 50_000, 10_000
_CUES = {
    "cue_contact": "(?i)phone|tel|call|fax|mobile|contact|mail|whatsapp",
    "cue_account": "(?i)card|account|iban|ssn|passport|visa|customer|number",
    "cue_secret": "(?i)pass|pwd|token|secret|key|login|credential",
    "cue_host": "(?i)ip|host|server|addr|client",
    "cue_neutral": "(?i)version|isbn|page|figure|table|chapter|[#$€£]",
}

_FEATURES = [
    "length", "digits", "digit_share", "letter_share", "separators", "has_at", "has_sign", "is_number", "is_code",
    "luhn", "host_end", "word_before", "word_after", *_CUES,
]


@dataclass(frozen=True)
class Fit:
    """All labelled candidates take part: three quarters, by hash, train the trees, where both
    classes weigh the same; the others set the threshold: the lowest with ``precision`` or
    more of them above it."""

    trees: int = 8
    depth: int = 3
    precision: float = 0.95
    seed: int = 11
    context: int = 24


def find_private(documents: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """``documents`` with ``base_spans`` and ``spans`` (base and added), as arrays of
    ``kind, start, end, match`` by kind, then start; code points, end exclusive.

    Spans of one base kind never overlap, spans of different kinds may; an added span
    overlaps no base span. A null or empty text has none. Rows are searched one by one;
    other columns pass through (columns of the two names are replaced). Where one of the
    classes has no candidates (an empty table), nothing is added. The work
    on a text grows with its length and its matches (times the logarithm of the strict ones).
    """
    docs = documents.drop("base_spans", "spans").withColumn("base_spans", base_spans(text_column()))
    score = trained(docs, fit)
    none = F.array().cast(_SPAN)
    if score is None:
        return docs.withColumn("spans", F.col("base_spans"))

    def added(s: Column) -> Column:
        apart = F.filter(s["wide"], lambda c: ~_touches(s["base"], c))
        judged = F.transform(apart, lambda c: F.struct(c.alias("span"), F.array(*score.features(c)).alias("x")))
        chosen = F.filter(judged, lambda j: score.chosen(j["x"]))
        return F.transform(chosen, lambda j: F.struct(*[j["span"][name].alias(name) for name in ("kind", "start", "end", "match")]))

    wide = F.struct(candidates(text_column(), fit.context).alias("wide"), by_kind(F.col("base_spans")).alias("base"))
    added = _let(wide, added)
    return docs.withColumn("spans", F.concat("base_spans", F.coalesce(added, none)))


def redact(found: DataFrame) -> DataFrame:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are
    replaced once, under the kind of the first."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        apart = s["start"] >= state["at"]
        before = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], before, F.lit("["), s["kind"], F.lit("]"))).otherwise(state["out"]).alias("out"),
        )

    rest = lambda state: F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, F.length("text")))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.aggregate(ordered, start, step, rest)).otherwise(F.col("text")))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def by_kind(base: Column) -> Column:
    """Strict spans as an array of each kind: these are in order and do not overlap."""
    of = lambda kind: F.filter(base, lambda b: b["kind"] == kind)
    return F.struct(*[of(kind).alias(kind) for kind in BASE])


def _starting_before(spans: Column, place: Column) -> Column:
    """How many of the ordered spans start before a place, bit by bit."""
    n = F.size(spans)

    def step(count, bit):
        more = count + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((more <= n) & (F.get(spans, more - 1)["start"] < place), more).otherwise(count)

    return F.when(n == 0, 0).otherwise(F.aggregate(F.sequence(F.length(F.bin(n)) - 1, F.lit(0)), F.lit(0), step))


def _touches(base: Column, c: Column) -> Column:
    """Whether a span overlaps a strict one: the last that starts before its end reaches furthest."""
    last = lambda spans: F.get(spans, _starting_before(spans, c["end"]) - 1)["end"]
    return reduce(lambda a, b: a | b, [F.coalesce(last(base[kind]) > c["start"], F.lit(False)) for kind in BASE])


def _holds(base: Column, c: Column) -> Column:
    """Whether a span holds a whole strict one (but for a first character): the first that
    starts there or later ends earliest."""
    first = lambda spans: F.get(spans, _starting_before(spans, c["start"] - 1))["end"]
    return reduce(lambda a, b: a | b, [F.coalesce(first(base[kind]) <= c["end"], F.lit(False)) for kind in BASE])


def _matches(text: Column, kind: str, needs: str, pattern: str, context: int = 0) -> Column:
    """All matches with their places: pieces between them and matches alternate. With
    ``context`` also that many characters to their left and two to their right."""
    empty = F.array().cast(_SEEN if context else _SPAN)

    def located(s: Column) -> Column:
        gap, match = lambda i: F.get(s["gaps"], i), lambda i: F.get(s["matches"], i)

        def step(state, i):
            first = state["at"] + F.length(gap(i))
            end = first + F.length(match(i))
            fields = [F.lit(kind).alias("kind"), first.alias("start"), end.alias("end"), match(i).alias("match")]
            before = state["before"]
            if context:
                left = F.right(F.concat(before, gap(i)), F.lit(context))
                right = F.substring(F.concat(gap(i + 1), F.coalesce(match(i + 1), F.lit(""))), 1, 2)
                fields += [left.alias("left"), right.alias("right")]
                before = F.right(F.concat(before, gap(i), match(i)), F.lit(context))
            span = F.array(F.struct(*fields))
            return F.struct(end.alias("at"), before.alias("before"), F.concat(state["found"], span).alias("found"))

        n = F.size(s["matches"])
        state = lambda at, before, found: F.struct(at.alias("at"), before.alias("before"), found.alias("found"))

        def chunk(outer, first):
            places = F.sequence(first, F.least(first + _CHUNK, n) - 1)
            inner = F.aggregate(places, state(outer["at"], outer["before"], empty), step)
            return _let(inner, lambda x: state(x["at"], x["before"], F.concat(outer["found"], F.array(x["found"]))))

        start = state(F.lit(0), F.lit(""), F.array().cast(f"array<{_SEEN if context else _SPAN}>"))
        chunks = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(_CHUNK)), start, chunk, lambda x: F.flatten(x["found"]))
        return F.when(n > 0, chunks).otherwise(empty)

    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    return F.when(text.rlike(needs), _let(pieces, located)).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The strict spans of a text: matches that fail their test are dropped, without a retry."""
    tests = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["match"].rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
        "card": lambda s: _luhn(_digits(s["match"])),
        "phone": lambda s: F.length(_digits(s["match"])).between(9, 15),
    }
    return F.concat(*[F.filter(_matches(text, kind, *p), tests[kind]) for kind, p in BASE.items()])


def candidates(text: Column, context: int = Fit.context) -> Column:
    """The wide spans of a text, with what stands to the left and right of each."""
    return F.concat(*[_matches(text, kind, *p, context) for kind, p in WIDE.items()])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the checksum of card numbers."""
    turned = F.reverse(digits)

    def add(total, i):
        digit = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)
    return (F.length(digits) > 0) & (total % 10 == 0)


def features(span: Column) -> dict[str, Column]:
    """Format and context of a span, the same with and without the marks of the strict patterns."""
    # The marks of the strict patterns are masked, so that what is learned from strict spans
    # holds for the same forms without them.
    match, digits = F.regexp_replace(F.regexp_replace(span["match"], _AT, "@"), r"^\(?\+", ""), _digits(span["match"])
    n = F.greatest(F.length(match), F.lit(1)).cast("double")
    left, right = span["left"], span["right"]
    around = F.concat(left, match)
    number = lambda c: c.cast("int").cast("double")
    return {
        "length": n,
        "digits": F.length(digits).cast("double"),
        "digit_share": F.length(digits) / n,
        "letter_share": F.length(F.regexp_replace(match, "[^A-Za-z]", "")) / n,
        "separators": F.length(F.regexp_replace(match, r"[^\x20().-]", "")).cast("double"),
        "has_at": number(match.contains("@")),
        "has_sign": number(match.rlike("[=:]")),
        "is_number": number(span["kind"] == "number_like"),
        "is_code": number(span["kind"] == "code_like"),
        "luhn": number((F.length(digits) < 32) & _luhn(digits)),
        "host_end": number(match.rlike(_HOST_END)),
        "word_before": number(left.rlike(r"[0-9A-Za-z]$")),
        "word_after": number(right.rlike("^[0-9A-Za-z]")),
        **{name: number(around.rlike(cue)) for name, cue in _CUES.items()},
    }


def _account(match: Column) -> Column:
    """Whether it passes the checksum of bank account numbers (remainder 1 by 97)."""
    plain = F.regexp_replace(match, "[^A-Za-z0-9]", "")
    code = F.ascii

    def add(rest, c):
        letter = (rest * 100 + code(c) - 55) % 97
        return F.when(c.rlike("[0-9]"), (rest * 10 + code(c) - 48) % 97).when(c.rlike("[A-Z]"), letter).otherwise(rest)

    turned = F.split(F.concat(F.substring(plain, 5, 30), F.substring(plain, 1, 4)), "")
    return plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.aggregate(turned, F.lit(0), add) == 1)


def _label(span: Column, base: Column) -> Column:
    """What is learned from: 1 for a candidate that holds a whole strict span, a value
    with a digit under the name of a secret, or what a checksum or a form with its cue
    shows to be personal; 0 for what touches no strict span and is shown to be something
    else; null (not learned from) for all that the strict patterns do not know."""
    kind, match, digits = span["kind"], span["match"], F.length(_digits(span["match"]))
    left, right = span["left"], span["right"]
    cue = {name: F.concat(left, match).rlike(pattern) for name, pattern in _CUES.items()}
    named = reduce(lambda a, b: a | b, [c for name, c in cue.items() if name != "cue_neutral"])
    personal = [
        _holds(base, span),
        (kind == "secret_like") & match.rlike("[0-9]"),
        _account(match),
        match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & cue["cue_account"],
    ]
    number, code = kind == "number_like", kind == "code_like"
    number_form = match.rlike(r"^[\x20().0-9-]+$") & digits.between(9, 15)
    other = [
        (number | code) & cue["cue_neutral"] & ~named,
        (number | code) & match.rlike(r"^(?:(?:19|20)[0-9]{2}([./-]?)(?:0[1-9]|1[0-2])\1[0-3][0-9](?![0-9])|[0-9]+\.[0-9]+$)"),
        (number | code) & match.rlike(r"^[0-9\x20-]+$") & digits.between(16, 19) & ~_luhn(_digits(match)),
        number & (left.rlike("[A-Za-z]$") | right.rlike("^[A-Za-z]")),
        number & (digits < 9) & ~named,
        code & ~named & (F.length(match) < 16) & ~number_form & ~match.rlike(rf"@|{_AT}"),
        (kind == "email_like") & ~match.rlike(_HOST_END),
    ]
    either = lambda tests: reduce(lambda a, b: a | b, tests)
    return F.when(either(personal), F.lit(1.0)).when(~_touches(base, span) & either(other), F.lit(0.0))


@dataclass(frozen=True)
class Score:
    """What a candidate is judged by, and the judgement: the weighted trees over it."""

    names: list[str]
    parts: list
    threshold: int = 0

    def features(self, span: Column) -> list[Column]:
        """The features the trees ask for, of the fitted order."""
        return [value for name, value in features(span).items() if name in self.names]

    def margin(self, x: Column, names: list[str]) -> Column:
        at = {place: F.get(x, F.lit(names.index(name))) for place, name in enumerate(_FEATURES) if name in self.names}
        return reduce(lambda a, b: a + b, [F.lit(float(weight)) * _tree(root, at) for weight, root in self.parts])

    def step(self, x: Column, names: list[str]) -> Column:
        """The margin in whole steps, as thresholds are."""
        return F.floor(self.margin(x, names) * F.lit(float(_STEPS)))

    def chosen(self, x: Column) -> Column:
        return self.step(x, self.names) >= self.threshold


def labelled_candidates(docs: DataFrame, fit: Fit) -> DataFrame:
    """All candidates of the table that have a label, as ``label, x, held, n``: how many there
    are of each label and features, and whether they are held out for the threshold (drawn by
    hash of the candidate). Labels and features are found beside the text."""

    def labelled(s: Column) -> Column:
        judged = F.transform(s["wide"], lambda c: F.struct(_label(c, s["base"]).alias("label"), c.alias("c")))
        own = F.filter(judged, lambda j: j["label"].isNotNull())
        return F.transform(own, lambda j: F.struct(j["label"].alias("label"), j["c"]["kind"].alias("kind"), j["c"]["match"].alias("match"), F.array(*features(j["c"]).values()).alias("x")))

    both = F.struct(candidates(text_column(), fit.context).alias("wide"), by_kind(F.col("base_spans")).alias("base"))
    found = docs.select(F.explode(_let(both, labelled)).alias("c")).select("c.*")
    held = F.pmod(F.xxhash64(F.lit(fit.seed), "kind", "match", "x"), F.lit(4)) == 0
    return found.groupBy("label", "x", held.alias("held")).agg(F.count(F.lit(1)).alias("n"))


def trained(docs: DataFrame, fit: Fit) -> Score | None:
    """The trees and their threshold, or None."""
    known = written(labelled_candidates(docs, fit), "known").withColumn("features", array_to_vector("x"))
    counted = known.groupBy("held", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()
    learned = {r["label"]: r for r in counted if not r["held"]}
    if len(learned) < 2:
        return None
    # In training both classes weigh the same.
    weight = F.col("n") / F.when(F.col("label") == 1, learned[1.0]["n"]).otherwise(learned[0.0]["n"])
    rows = sum(r["rows"] for r in learned.values())
    parts = 1 + rows // _PART_ROWS
    # In a fixed order, so that sums and with them the trees are the same every time.
    ordered = known.where("not held").withColumn("weight", weight * rows).repartition(parts, "x").sortWithinPartitions("x", "label")
    # Spark bounds its bins by a sample if it has more rows than the square of their number.
    bins = max(16, isqrt(rows - 1) + 1 if rows > _BINNED_WHOLE else 0)
    trees = GBTClassifier(maxIter=fit.trees, maxDepth=fit.depth, maxBins=bins, seed=fit.seed, stepSize=0.3, weightCol="weight")
    model = trees.fit(ordered)
    asked = {i for i in range(len(_FEATURES)) if model.featureImportances[i] > 0}
    names = [name for i, name in enumerate(_FEATURES) if i in asked]
    score = Score(names, [(weight, tree._call_java("rootNode")) for weight, tree in zip(model.treeWeights, model.trees)])
    held = known.where("held").select("label", "n", score.step(F.col("x"), _FEATURES).alias("step"))
    threshold = _threshold(held, fit.precision)
    return None if threshold is None else replace(score, threshold=threshold)


def _threshold(scored: DataFrame, precision: float) -> int | None:
    """The lowest step with the wanted precision at and above it, over all held-out candidates.
    Margins are few and small, so are their steps."""
    by_step = scored.groupBy("step").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).orderBy(F.desc("step"))
    good = total = 0.0
    best = None
    for row in by_step.collect():
        good, total = good + row["good"], total + row["n"]
        if good >= precision * total:
            best = row["step"]
    return best


def _tree(node, x: dict[int, Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    below = x[split.featureIndex()] <= F.lit(float(split.threshold()))
    return F.when(below, _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))
