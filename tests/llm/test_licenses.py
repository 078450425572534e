"""Licence phrases against places found by loops, and chained spans of edited texts."""

import random
import re

import pytest

from subdrift.llm.license_texts import PHRASES, TEMPLATES
from subdrift.llm.licenses import Chaining, Scanner, scan_licenses
from tests.llm.helpers import awkward, frame, tuples


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [
        (i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places(spark):
    more = [
        (3000, "MIT License, mit-license! Apache  License GNU general\npublic license cc by CC-BY"),
        (3001, "cc cc by by gnu general public gnu general public license license"),
        (3002, "ÀMIT license mit licensé MİT license"),
    ]
    rows = awkward(spark, more)
    got = tuples(scan_licenses(frame(spark, rows)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)


def test_labels_contain_the_base_ones_and_scores_stay_in_range(spark):
    for r in scan_licenses(frame(spark, awkward(spark))).collect():
        labels = set(filter(None, r.labels.split(",")))
        assert set(filter(None, r.base_labels.split(","))) <= labels and list(sorted(labels)) == [x for x in r.labels.split(",") if x]
        assert 0 <= r.score <= 1


def test_whole_and_edited_texts_are_found():
    scanner = Scanner()
    for label, text in TEMPLATES:
        _, _, _, _, _, labels, score, spans = scanner.scan(b"foo bar " + text.encode() + b" baz")
        assert label in labels.split(",") and score == 1.0
        assert any(s["label"] == label and s["start"] == 2 for s in spans)
    words = next(t for label, t in TEMPLATES if label == "mit" and len(t) > 500).split()
    words[20] = "changed"
    del words[60:64]
    words[100:100] = ["some", "more", "words"]
    spans = scanner.scan(" ".join(words).encode())[-1]
    assert any(s["label"] == "mit" and s["score"] > 0.9 for s in spans)


@pytest.mark.parametrize(
    "text,labels",
    [
        ("This project is licensed under the terms of the Apache license.", "apache"),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2.0"),
        ("Licensed under the Apache License, Version 1.1", "apache,apache-1.1"),
        ("Licensed under CC BY 3.0", "cc-by,cc-by-3.0"),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", "cc-by-3.0"),
        ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
        ("GNU Lesser General Public License version 2.1", "lgpl-2.1"),
        ("Creative Commons Attribution of 3 pictures", ""),
        ("released under the terms of the license of this project", ""),
        ("the GNU General Public License, in its many versions", "gpl"),
    ],
)
def test_names_and_versions(text, labels):
    assert Scanner().scan(f"foo {text} bar".encode())[5] == labels


def test_similar_texts_are_told_apart():
    whole = {label: text for label, text in TEMPLATES if len(text) > 300}
    for label, text in whole.items():
        found = Scanner().scan(text.encode())[5].split(",")
        assert label in found and not set(found) & (set(whole) - {label}), (label, found)


def chains(words, templates, chaining):
    """Spans of one template each by loops: pieces by comparing, then every chain of pieces."""
    def longest(i):
        return max((k for t in templates for k in range(1, i + 2) if any(t[j : j + k] == words[i + 1 - k : i + 1] for j in range(len(t)))), default=0)

    reach = [longest(i) for i in range(len(words))] + [0]
    pieces = [(i + 1, n) for i, n in enumerate(reach[:-1]) if reach[i + 1] <= n >= chaining.min_piece]
    out = set()
    for number, t in enumerate(templates):
        found = [(end, j + n, n) for end, n in pieces for j in range(len(t)) if t[j : j + n] == words[end - n : end]]
        best, groups = [], {}
        for k, (end, place, n) in enumerate(found):
            state = (n, end - n)
            for j in reversed(range(k)):
                before, at, _ = found[j]
                if before >= end - n - chaining.max_gap and at < place and before < end:
                    covered = best[j][0] + min(n, place - at, end - before)
                    if covered > state[0]:
                        state = (covered, best[j][1])
            best.append(state)
            groups[state[1]] = max(groups.get(state[1], (0, 0)), (state[0], end))
        for start, (covered, end) in groups.items():
            if covered / len(t) >= chaining.min_share:
                out.add((number, start, end, min(1.0, covered / len(t))))
    return out


def test_chains_against_loops():
    r = random.Random(4)
    chaining = Chaining(min_piece=2, max_gap=3, min_share=0.5, short=0)
    for _ in range(60):
        templates = [r.choices("abcde", k=r.randint(6, 14)) for _ in range(2)]
        words = r.choices("abcdex", k=4)
        for _ in range(3):
            t = r.choice(templates)
            first = r.randrange(len(t))
            words += t[first : first + r.randint(2, 9)] + r.choices("abxy", k=r.randint(0, 3))
        scanner = Scanner([(str(i), " ".join(t)) for i, t in enumerate(templates)], {}, chaining, {})
        pieces = []
        encoded = [w.encode() for w in words]
        known = [w in scanner.vocabulary for w in encoded]
        at = 0
        while at < len(words):
            stop = at
            while stop < len(words) and known[stop]:
                stop += 1
            if stop > at + 1:
                scanner._run(encoded, at, stop, [], [], pieces)
            at = stop + 1
        got = {(int(s["label"]), s["start"], s["end"], s["score"]) for s in scanner._chains(pieces)}
        assert got == chains(words, templates, chaining)


def test_a_passage_that_stands_twice_in_a_text():
    text = "keep this list of conditions here and also keep this list of conditions there but never sell it to any other person at all"
    spans = Scanner([("x", text)], {}, Chaining(), {}).scan(text.encode())[-1]
    assert [(s["start"], s["end"], s["score"]) for s in spans] == [(0, len(text.split()), 1.0)]
    second = " ".join(text.split()[8:])
    assert Scanner([("x", text)], {}, Chaining(min_share=0.5), {}).scan(second.encode())[-1][0]["start"] == 0


def test_plain_text_has_no_label():
    assert Scanner().scan(b"the software of the day is provided to any person who may use it")[5] == ""


def test_empty_table(spark):
    assert scan_licenses(frame(spark, awkward(spark)).limit(0)).count() == 0
