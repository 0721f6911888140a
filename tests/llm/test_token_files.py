"""Token files: a task's files in order, and rows with the same id."""

import numpy as np
import pyarrow as pa

from gridrisk.llm import token_files, tokens


def test_a_task_goes_on_to_further_files(spark):
    rows = [(k // 2, f"text {k} " * (k % 7)) for k in range(60)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = token_files.write(docs), token_files.write(docs, file_bytes=700)
    assert many.count() > 2 * one.count() and many.agg({"n_docs": "sum"}).first()[0] == len(rows)
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    read = lambda m: [tuple(r) for r in token_files.read(m).select(*columns).orderBy("start").collect()]
    assert read(many) == read(one) and len(read(many)) == len(rows)


def test_read_documents_gives_all_rows_of_an_id(tmp_path):
    path = tmp_path / "f.zst"
    with open(path, "wb") as f:
        token_files.write_file(f, [(k, np.array(ids, "<u4").tobytes()) for k, ids in [(1, [5, 2]), (3, [6]), (3, [7, 2]), (4, [])]])
    got = token_files.read_documents(str(path), [3, 4, 9])
    assert {k: [x.tolist() for x in v] for k, v in got.items()} == {3: [[6], [7, 2]], 4: [[]]}


def test_stretch_takes_no_document_too_many():
    rest = iter([(k, b"x" * 100) for k in range(7)])
    assert [[doc for doc, _ in token_files.stretch(rest, 700)] for _ in range(5)] == [[0, 1], [2, 3], [4, 5], [6], []]


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def encode_batch_fast(self, texts, **kw):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **kw)


def test_words_of_a_stretch_are_encoded_once_whatever_marks_follow():
    e = tokens.PartEncoder(tokens.default_path())
    e.tokenizer = Counting(e.tokenizer)
    texts = ["x " + " ".join(f"Wort{chr(97 + k % 26)}{chr(97 + k // 26)}{end}" for k in range(200)) + " x" for end in (".", ",", ";", ".\nUnd", "!", ":", ")", "?", "...", "")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    [(docs, ids)] = e.stretches(iter([batch]))
    assert docs == list(range(10)) and e.tokenizer.chars * 4 < sum(map(len, texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
