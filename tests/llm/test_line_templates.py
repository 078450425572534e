"""Dropped lines against the same tree as loops."""

import random
import re
from collections import Counter, defaultdict

import pytest

from subdrift.llm.line_templates import Tree, drop_templates
from tests.llm.helpers import awkward, documents, frame


def brute(rows, tree):
    docs = list(dict.fromkeys(rows))
    leaves = defaultdict(lambda: defaultdict(set))
    tokens_of = {}
    for doc in docs:
        for i, line in enumerate((doc[1] or "").split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(tokens) >= tree.min_tokens:
                leaf = (len(tokens), tokens[: tree.depth])
                leaves[leaf][tokens].add(doc)
                tokens_of[doc, i] = (leaf, tokens)
    drop = set()
    for leaf, lines in leaves.items():
        counts = [Counter() for _ in range(leaf[0])]
        for tokens, at in lines.items():
            for place, token in enumerate(tokens):
                counts[place][token] += len(at)
        template_of, found_in = {}, defaultdict(set)
        for tokens, at in lines.items():
            n = [counts[place][token] for place, token in enumerate(tokens)]
            least = sorted(n, reverse=True)[-(-leaf[0] * tree.constant_percent // 100) - 1]
            if least >= tree.min_docs:
                template_of[tokens] = tuple(t if k >= least else "<*>" for t, k in zip(tokens, n))
                found_in[template_of[tokens]] |= at
        for tokens, at in lines.items():
            if len(at) >= tree.min_docs or len(found_in.get(template_of.get(tokens), ())) >= tree.min_docs:
                drop.add((leaf, tokens))
    out = []
    for doc in rows:
        lines = doc[1].split("\n") if doc[1] is not None else []
        kept = [x for i, x in enumerate(lines) if tokens_of.get((doc, i)) not in drop]
        out.append((doc[0], None if doc[1] is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_dropped_lines(spark):
    more = []
    for i in range(14):
        who = ["Ann", "Bob", "Cy", "Di"][i % 4]
        more.append((3000 + i, f"own line {chr(97 + i)} of this text here\nLog in as user {who} at {i}:00 to go on reading\nShare this page\n\n7"))
    for i in range(14):
        more.append((3100 + i, f"Log in as {'x' * i} never the same {chr(97 + i)} {chr(98 + i)} {chr(99 + i)} y\nshort"))
    rows = [r for r in awkward(spark, more) if r[0] is not None] + documents(spark)[60:]
    for tree in (Tree(), Tree(min_docs=4, depth=2, constant_percent=70)):
        got = drop_templates(frame(spark, rows), tree)
        assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == brute(rows, tree)


def names(seed, n):
    return ["".join(random.Random(f"{seed} {i}").choices("abcdefghijklm", k=9)) for i in range(n)]


def dropped(spark, rows, tree=Tree()):
    return {r.doc_id: r.n_dropped for r in drop_templates(frame(spark, rows), tree).collect()}


@pytest.mark.parametrize("varied", [3, 4])
def test_two_templates_in_one_leaf_whose_fields_are_words(spark, varied):
    """Both are found, beside each other and beside unrelated lines of the leaf, whatever stands in the fields."""
    def line(start, i, size):
        constant = [f"{start}{chr(97 + k)}" for k in range(size - 3 - varied)]
        return " ".join(["the", "same", "start", *constant, *(names(f"{start}{k}", 200)[i] for k in range(varied))])

    size = 9 if varied == 4 else 11
    rows = [(i, line("first", i, size)) for i in range(60)] + [(100 + i, line("second", i, size)) for i in range(61)]
    rows += [(1000 + i, " ".join(["the", "same", "start", *(names(f"p{k}", 600)[i] for k in range(size - 3))])) for i in range(500)]
    got = dropped(spark, rows)
    assert all(got[i] == 1 for i in range(60)) and all(got[100 + i] == 1 for i in range(61))
    assert sum(got[1000 + i] for i in range(500)) == 0


def test_a_field_with_a_frequent_word(spark):
    """A city that most lines name is a field like any other, as the constants are more frequent still."""
    rows = [(i, f"we ship all your orders to {'Paris' if i % 3 else names('c', 60)[i]} within some days") for i in range(60)]
    assert all(n == 1 for n in dropped(spark, rows).values())


def test_common_starts_are_no_template(spark):
    """Prose that shares its first words and scattered frequent ones stays."""
    r = random.Random(3)
    rows = [(i, "it was the " + " ".join(r.choice(["of", "and", "in", names(k, 300)[i]]) for k in range(12))) for i in range(300)]
    assert sum(dropped(spark, rows).values()) == 0


def test_columns_and_awkward_rows(spark):
    df = frame(spark, awkward(spark))
    got = drop_templates(df, Tree(min_docs=2))
    assert got.columns == [*df.columns, "n_lines", "n_dropped"] and got.count() == df.count()
    assert drop_templates(df.limit(0)).count() == 0
