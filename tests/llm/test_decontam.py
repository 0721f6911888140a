"""Decontamination: many short items, and items that need several blocks."""

import random
import tracemalloc

from gridrisk.llm import decontam


def naive(ws, items, window):
    hit, found = set(), set()
    for item, v in items:
        n = min(window, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            for b in range(len(ws) - n + 1):
                if ws[b : b + n] == v[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(item)
    return hit, found


def test_short_items_of_many_lengths_that_end_alike():
    rnd = random.Random(11)
    draw = lambda n: [rnd.choice([b"a", b"b", b"c"]) for _ in range(n)]
    for _ in range(60):
        items = [(str(k), draw(rnd.choice([0, 1, 1, 2, 3, 4, 5, 9]))) for k in range(rnd.randint(0, 15))]
        automaton = decontam.Automaton(items, 5)
        for _ in range(8):
            ws = draw(rnd.randint(0, 25))
            spans, _, found = automaton.match(ws)
            hit, expected = naive(ws, items, 5)
            assert {i for s, e in spans for i in range(s, e)} == hit and found == expected


def test_many_one_word_items_stay_small():
    rnd = random.Random(12)
    words = [b"word%d" % k for k in range(3000)]
    items = [(f"long{k}", [rnd.choice(words) if rnd.random() < 0.9 else b"yes" for _ in range(40)]) for k in range(800)]
    answers = [(f"short{k}", [b"yes"]) for k in range(10_000)]
    tracemalloc.start()
    automaton = decontam.Automaton(items + answers, 10)
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size < 200e6
    spans, _, found = automaton.match([b"oh", b"yes", b"no", b"yes", b"yes"])
    assert spans == [(1, 2), (3, 5)] and found == {name for name, _ in answers}


def test_parts_keep_all_windows_and_their_size():
    rnd = random.Random(13)
    for _ in range(200):
        ws = [b"x" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 60))]
        window, most = rnd.randint(1, 6), rnd.randint(1, 60)
        cut = list(decontam.parts(ws, window, most))
        assert all(sum(map(len, p)) <= most or len(p) <= window for p in cut)
        windows = lambda p: [tuple(p[i : i + window]) for i in range(len(p) - window + 1)]
        assert [w for p in cut for w in windows(p)] == windows(ws)
        assert len(ws) >= window or cut == [ws]


def test_blocks_hold_all_items_within_their_size(spark):
    rows = [(k, "word " * k) for k in range(40)] + [(None, "one two"), (7, None), (8, "w" * 500)]
    b = spark.createDataFrame(rows, "item_id long, text string")
    blocks = list(decontam.item_blocks(b, 3, 100))
    assert len(blocks) > 10 and all(sum(len(w) for _, p in block for w in p) <= 100 for block in blocks if len(block) > 1)
    assert {item for block in blocks for item, _ in block} == {str(k) for k in range(40)} | {"null"}
    assert list(decontam.item_blocks(b.limit(0), 3, 100)) == [[]]


def test_found_in_several_blocks_is_put_together(spark):
    rows = [(1, "a b c d e", "x", 1), (1, "a b c d e", "x", 1), (2, None, "y", 2), (3, "", None, 3), (None, "c d e q", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, Match long")
    b = spark.createDataFrame([(1, "a b c"), (2, "c d e"), (3, "q")], "item_id long, text string")
    one = decontam.match(docs, b, window=3)
    several = decontam.match(docs, b, window=3, max_bytes=3)
    assert one.columns == several.columns == ["doc_id", "text", "row", "Match", *decontam.FOUND.fieldNames()]
    rows = sorted(map(str, one.collect()))
    assert rows == sorted(map(str, several.collect())) and len(rows) == 5
    both = several.where("doc_id = 1").first()
    assert both["n_hit"] == 5 and both["item_ids"] == ["1", "2"] and [tuple(s) for s in both["hit_spans"]] == [(0, 5)]
