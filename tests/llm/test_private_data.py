"""Strict spans against Python's patterns; trees only add."""

import random
import re

from pyspark.sql import functions as F

from subdrift.llm.private_data import (
    BASE, WIDE, Fit, _account, _holds, _threshold, _touches, base_spans, by_kind, candidates, find_private, labelled_candidates, redact,
)
from tests.llm.helpers import awkward, documents, frame

NASTY = [
    "a.b@c.d_x@y.z foo 1.2.3.4.5.6.7.8 +1 (2) 345-678-9012",
    "1.1.1.300 001.2.3.4 4111 1111 1111 1111 4111-1111-1111-1111-1 5500005555555559x 5500  005555555559",
    "é😀 +49 30 123456789 ü@x.de a@b a@b. a@b..c @a.b",
    "1" * 2000, "1 " * 2000, "a" * 2000, "a@" + "b." * 300 + "c", "+1" * 1000, "@" * 1000, "1.2.3." * 1000,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [
        (kind, m.start(), m.end(), m[0]) for kind, (p, test) in kinds.items() for m in re.finditer(p, text or "") if test(m[0])
    ]


def rows_of(spark):
    return awkward(spark, [(4000 + i, t) for i, t in enumerate(NASTY)])


def test_base_spans(spark):
    rows = [(i, t) for i, (_, t) in enumerate(rows_of(spark) + documents(spark)) if len(t or "") < 30000]
    found = frame(spark, rows).select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert {r.doc_id: [tuple(s) for s in r.s] for r in found} == {d: brute(t) for d, t in rows}


def test_very_long_texts_are_searched(spark):
    texts = ["1" * 200000, "1 " * 100000, "a" * 300000, "a@" + "b." * 50000 + "c", "+1" * 50000, "password=" * 20000, "f" * 200000]
    df = frame(spark, list(enumerate(texts)))
    assert df.select(F.size(base_spans(F.col("text"))), F.size(candidates(F.col("text")))).count() == len(texts)


def test_long_candidates_are_whole(spark):
    token, local, host = "a1B2" * 250, "n" * 100, "h" * 200 + ".org"
    cases = {
        f"x token={token} y": ("secret_like", f"token={token}"),
        f"mail {local}@{host} y": ("email_like", f"{local}@{host}"),
        f"no {'12 34-' * 20}5 y": ("number_like", "12 34-" * 20 + "5"),
        f"x {local}7{token} y": ("code_like", f"{local}7{token}"),
        f"x a@{'b.' * 3000}c y": ("email_like", f"a@{'b.' * 3000}c"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = df.select("text", candidates(F.col("text")).alias("wide"), base_spans(F.col("text")).alias("base")).collect()
    assert all(cases[r.text] in {(s.kind, s.match) for s in r.wide} for r in rows)
    assert ("email", f"a@{'b.' * 3000}c") in {(s.kind, s.match) for r in rows for s in r.base}
    wide = df.withColumn("spans", F.filter(candidates(F.col("text")), lambda s: s["kind"] == "secret_like"))
    assert redact(wide).where("doc_id = 0").first().text == "x [secret_like] y"


def test_trees_add_spans_and_base_ones_stay(spark):
    secrets = [(5000 + i, f"so the password=b7db7aa4a5fcc7{i} is old, version {i}.0 of chapter {i}") for i in range(300)]
    df = frame(spark, rows_of(spark) + documents(spark) + secrets)
    found = find_private(df)
    assert found.columns == [*df.columns, "base_spans", "spans"]
    kinds = set()
    for r in found.collect():
        base, spans = [tuple(s) for s in r.base_spans], [tuple(s) for s in r.spans]
        assert spans[: len(base)] == base
        for kind, start, end, match in spans[len(base) :]:
            kinds.add(kind)
            assert r.text[start:end] == match and kind not in BASE
            assert not any(start < e and s < end for _, s, e, _ in base)
    assert "secret_like" in kinds


def test_forms_without_the_strict_marks_are_added(spark):
    """Trees learn from strict spans and find the same forms with "(at)" and without "+"."""
    names, hosts = ["anna", "bo.lind", "c", "dora-maria", "e.f.g", "frank"], ["example.com", "post.example.org", "mail7.example.net", "x.de"]
    known = [
        (k, f"write to {names[k % 6]}{k if k % 5 < 2 else ''}@{hosts[k % 4]} or +1 ({200 + k}) 555-{1000 + k} soon") for k in range(300)
    ]
    others = [
        (1000 + k, f"on 2024-01-{10 + k % 20} the sum was {k}.25 of {k}99.5 and {k} apples in version {k}.1.2.3456 at 4111111111111{100 + k}")
        for k in range(300)
    ]
    planted = {}
    for k in range(40):
        planted[2000 + k] = ("email_like", f"berta.{k} (at) mail{k % 5}.example.com")
        planted[3000 + k] = ("email_like", f"carl{k}[at]post.example.com")
        planted[4000 + k] = ("number_like", f"1 ({600 + k}) 555-{2000 + k}")
    rows = known + others + [(k, f"so he wrote {match} there") for k, (_, match) in planted.items()]
    found = {r.doc_id: r for r in find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, want in planted.items():
        assert not found[k].base_spans and want in {(s.kind, s.match) for s in found[k].spans}
    added = [s for k, _ in others for s in found[k].spans[len(found[k].base_spans) :]]
    assert len(added) <= len(others) // 20


def test_neighbours_by_bisection(spark):
    """Which strict spans a span touches or holds, against going through all of them."""
    random.seed(5)
    rows = []
    for k in range(300):
        base = []
        for kind in BASE:
            cuts = sorted(random.sample(range(60), 2 * random.randint(0, 9)))
            base += [(kind, a, b, "") for a, b in zip(cuts[::2], cuts[1::2])]
        start = random.randint(0, 58)
        rows.append((k, base, ("x", start, random.randint(start + 1, 60), "")))
    span = "struct<kind:string,start:int,end:int,match:string>"
    df = spark.createDataFrame(rows, f"k int, base array<{span}>, c {span}")
    got = df.select("k", _touches(by_kind(F.col("base")), F.col("c")), _holds(by_kind(F.col("base")), F.col("c"))).collect()
    want = {k: (any(a < e and s < b for _, a, b, _ in base), any(s <= a + 1 and e >= b for _, a, b, _ in base)) for k, base, (_, s, e, _) in rows}
    assert {k: (t, h) for k, t, h in got} == want


def test_contexts_of_many_matches(spark):
    """Places and contexts of more matches than are added up together."""
    random.seed(6)
    texts = ["".join(random.choice(["a7 ", "é", "x(at)y.de ", "1234567-8 ", " ", "key=abcdefg", "\n"]) for _ in range(600)) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = df.select("k", candidates(F.col("text"), 5).alias("c")).collect()
    assert sum(len(r.c) for r in rows) > 64 * len(texts)
    for r in rows:
        text = texts[r.k]
        for kind in WIDE:
            places = [(s.start, s.end) for s in r.c if s.kind == kind]
            assert places == sorted(places)
        for s in r.c:
            assert (s.match, s.left, s.right) == (text[s.start : s.end], text[max(0, s.start - 5) : s.start], text[s.end : s.end + 2])


def test_account_numbers(spark):
    df = spark.createDataFrame([("DE89370400440532013000",), ("GB82WEST12345698765432",), ("DE88370400440532013000",), ("x",), ("",)], "m string")
    assert [r[0] for r in df.select(_account(F.col("m"))).collect()] == [True, True, False, False, False]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4 é +49 30 1234567 x"), (2, None), (3, "")], "doc_id long, text string")
    found = df.withColumn("spans", base_spans(F.coalesce("text", F.lit(""))))
    assert [r.text for r in redact(found).orderBy("doc_id").collect()] == ["mail [email] or [ip] é [phone] x", None, ""]


def test_nothing_is_added_without_both_classes(spark):
    empty = find_private(frame(spark, rows_of(spark)).limit(0))
    assert empty.count() == 0
    plain = find_private(spark.createDataFrame([(1, "no digits here")], "doc_id long, text string"))
    assert plain.first().spans == []


def test_all_labelled_candidates_are_learned_from(spark):
    """Two forms, each more often than any bounded sample held; before, all of the sample was one of them."""
    rows = [(k, "his password=b7db7aa4a5fcc71 is old") for k in range(9000)]
    rows += [(10000 + k, "write to anna.lind@post.example.org soon") for k in range(9000)]
    rows += [(20000 + k, f"{k} apples in chapter {k % 90}.1 of 2024-01-{10 + k % 20}") for k in range(3000)]
    rows += [(30000, "so write to berta.lund (at) post.example.net soon")]
    found = {r.doc_id: r for r in find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "password=b7db7aa4a5fcc71" in {s.match for s in found[0].spans}
    assert "berta.lund (at) post.example.net" in {s.match for s in found[30000].spans}


def test_counts_of_labelled_candidates(spark):
    texts = ["mail a.b@example.org x"] * 700 + ["in version 1.25 of"] * 5000 + ["token=abc12345 x"] * 900 + [""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("base_spans", base_spans(F.col("text")))
    each = docs.dropDuplicates(["text"])
    once = {(r.label, tuple(r.x)): r.n for r in labelled_candidates(each, Fit()).collect()}
    counted = {(r.label, tuple(r.x)): r.n for r in labelled_candidates(docs, Fit()).collect()}
    assert set(counted) == set(once) and {label for label, _ in counted} == {0.0, 1.0}
    assert sum(n for (label, _), n in counted.items() if label == 0) == 5000 * sum(n for (label, _), n in once.items() if label == 0)
    assert max(n for (label, _), n in counted.items() if label == 1) >= 900


def test_threshold_is_the_lowest_that_is_precise(spark):
    steps = [(9, 1.0, 90), (8, 0.0, 4), (7, 1.0, 30), (6, 0.0, 5), (5, 1.0, 1), (4, 0.0, 900)]
    scored = spark.createDataFrame(steps, "step long, label double, n long")
    assert _threshold(scored, 0.95) == 7 and _threshold(scored, 0.9) == 5 and _threshold(scored.where("label = 0"), 0.9) is None
