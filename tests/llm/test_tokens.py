"""The encoder: where it cuts texts, what it keeps and how much memory that takes."""

import random
import subprocess
import sys

import numpy as np

from gridrisk.llm import tokens

MEMORY = """
import random, re
from gridrisk.llm import tokens
from gridrisk.llm.common import trim

def held():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) / 1000

rnd, e = random.Random(1), tokens.PartEncoder(tokens.default_path())
e.encode_all(["one two"])
before = held()
for _ in range(12):
    e.encode_all([" ".join("%x" % rnd.getrandbits(40) for _ in range(100)) for _ in range(1000)])
trim()
print(held() - before)
"""


def kept(*texts):
    e = tokens.PartEncoder(tokens.default_path())
    e.encode_all(list(texts))
    return set(e.parts.to_pylist())


def test_a_word_is_one_part_whatever_mark_follows():
    assert kept("a word, a word. a word;\nA word") == {"a", " word", ",", " a", ".", ";", "\n", "A"}


def test_no_part_begins_within_white_space_or_an_added_token():
    assert kept("x  y\n\nz") == {"x", "  y", "\n\nz"} and kept("it's") == {"it's"}
    assert kept("a <|endoftext|> b") == {"a <|endoftext|> b"} and kept("a\u2003 b") == {"a\u2003 b"}


def test_starts_do_not_depend_on_where_a_text_is_divided():
    rnd = random.Random(3)
    text = np.frombuffer("".join(rnd.choice([*"aé. \n\u00a0\u2003\u3000x"]) for _ in range(3000)).encode(), np.uint8)
    want = tokens.part_starts(text).tolist()
    assert sum(want) > 300 and all(tokens.all_part_starts(text, n).tolist() == want for n in (1, 2, 7, 100, 5000))


def test_odd_characters_give_the_ids_of_whole_texts():
    rnd, e = random.Random(2), tokens.PartEncoder(tokens.default_path(), cached=30)
    odd = [*"abZé ß١5'’“.,-_#<|>\n\n\t\r\x0b\x1c\x00\x7f\x85\xa0\u1680\u2003\u2009\u2028\u202f\u205f\u3000\u3001\ufeff\u0301\u0120😀   ", "'ll", "<|endoftext|>", "  ", "\n\n"]
    for _ in range(100):
        texts = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 40))) for _ in range(30)]
        for t, ids in zip(texts, e.encode_all(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(e.parts) <= 60 and len(e.parts) == len(e.ids) == len(e.uses)


def test_what_is_kept_of_a_million_parts_takes_little_memory():
    got = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True, timeout=300)
    assert float(got.stdout) < 150


def test_a_worker_keeps_one_encoder_of_the_size_asked_for():
    path = tokens.default_path()
    small = tokens.encoder(path, 7)
    assert small.cached == 7 and tokens.encoder(path, 7) is small and tokens.encoder(path).cached == 300_000
    tokens.common.release()
