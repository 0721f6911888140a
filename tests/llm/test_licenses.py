"""License scans against a version that looks at every pair of spans."""

import random
import re

from gridrisk.llm import license_rules, licenses, queries

BLANK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text, rules):
    words = [w for w in BLANK.split((text or "").translate(LOWER)) if w]
    joined = "".join(f" {w} " for w in words)
    base, places = {}, []
    for phrase, label in license_rules.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        base[label] = len(at)
        places += at
    spans = []
    for r in rules:
        for m in re.finditer(r.pattern, joined):
            s, e = (joined[:k].count(" ") // 2 for k in m.span())
            spans.append((s, e, r.priority, r.id, r.label))
    held = lambda x, y: y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or y[:2] == x[:2] and y[3] < x[3]))
    kept = sorted(x for x in spans if not any(held(x, y) for y in spans))
    labels = {label: license_rules.WEIGHTS["base"] for label, n in base.items() if n}
    for *_, priority, _, label in kept:
        labels[label] = max(labels.get(label, 0), license_rules.WEIGHTS[priority])
    rest = 1.0
    for w in labels.values():
        rest *= 1 - w
    return len(words), base, min(places, default=None), max(places, default=None), kept, sorted(labels), 1 - rest


def check(spark, texts, rules=None):
    rows = [(k, t, "own") for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "row long, text string, licenses string").repartition(3)
    got = {r["row"]: r for r in licenses.scan(d, rules).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        n, base, first, last, kept, labels, score = plain(t, license_rules.rules() if rules is None else rules)
        r = got[k]
        assert (r["n_words"], {b["label"]: b["n"] for b in r["base"]}, r["first_word"], r["last_word"], r["labels"]) == (n, base, first, last, labels), t
        assert sorted(map(tuple, r["licenses"])) == kept and abs(r["score"] - score) < 1e-12, t


def test_rules_hold_their_keywords():
    rules = license_rules.rules()
    assert len(rules) >= 250 and all(p in (1, 2, 3, 4) for p in (r.priority for r in rules)) and not {r.label for r in rules} & set(license_rules.BASE.values())
    optional, either = re.compile(r"\((?:[^()]|\([^()]*\))*\)[?*]"), re.compile(r"\(\?:(?:[^()|]|\([^()]*\))*\|(?:[^()]|\([^()]*\))*\)")
    for r in rules:
        always = either.sub(" @ ", optional.sub(" ", r.pattern))
        assert f" {r.keyword} " in f" {always} ", r
        assert re.fullmatch(licenses.any_of([x.keyword for x in rules]), r.keyword)


def test_statements(spark):
    check(spark, [
        None, "", " \n", "word", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "CC-BY cc by Cc By", "All rights reserved. (c) 2020 ALL RIGHTS RESERVED", "cc by", "xcc by cc byx", "general public license general public license v2 or any later version",
        "https://creativecommons.org/licenses/by-sa/4.0/ and http://www.apache.org/licenses/LICENSE-2.0.txt", "SPDX-License-Identifier: GPL-3.0-only", "mit Lizenz, mit License", "Creative Commons Attribution-ShareAlike 4.0 International License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this MIT License", "Kind of ﬁne É cc by É", "dual licensed under MIT and Apache-2.0; BSD-3-Clause or BSD license", "x" * 30000, "license " * 3000 + "mit license " * 500,
    ])


def test_random_words(spark):
    rnd = random.Random(11)
    words = "apache license version 2 0 gnu general public licensed under the mit bsd 3 clause cc by sa nc 4 or any later all rights reserved copyright 2020 x . - \n".split(" ")
    check(spark, [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(250)])


def test_containment_by_priority(spark):
    rule = lambda k, label, p, regex: license_rules.Rule(k, label, "a", p, license_rules.widened(regex))
    rules = [rule(0, "low-long", 1, "a b c d"), rule(1, "high-short", 4, "a b"), rule(2, "mid", 2, "a b c"), rule(3, "same", 2, "a b c"), rule(4, "low-inside", 1, "a"), rule(5, "overlapping", 2, "b a")]
    check(spark, ["a b c d", "a b", "b a b c", "a a a", "b a b a b c d a"], rules)
    got = licenses.scan(spark.createDataFrame([("a b c d",)], "text string"), rules).first()
    assert [s["label"] for s in got["licenses"]] == ["low-long", "mid", "high-short"]


def test_query_on_odd_tables(spark, tmp_path):
    for name, rows in (("some", [(None, "cc by"), (1, None), (2, ""), (2, "")]), ("none", [])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        got = queries.op12_license_scans(spark, str(tmp_path / name)).collect()
        assert len(got) == len(rows) and all((r["n_base"] > 0) == (r["doc_id"] is None) for r in got)
