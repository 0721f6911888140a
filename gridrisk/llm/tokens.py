"""Token ids of whole texts by the tokenizers library, with each frequent part of a text encoded once.

A byte-level BPE splits a text by a regex into pre-tokens before it merges anything: runs of letters, of digits or of other
characters, each with one space before it where there is one, and white space. So a text may be cut where a pre-token ends
whatever stands further on, and the ids of its parts joined, which gives the ids of the whole text. Texts are encoded in
stretches: the parts of a stretch are looked up among the most frequent ones so far, and the distinct ones that aren't there
are encoded, many in one call.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Bytes of ASCII letters, of other visible ASCII characters but digits and the apostrophe, and of white space and control characters.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])
_BLANK = np.array([b <= 32 or b == 127 for b in range(256)])
#: The first two bytes of all white space beyond ASCII (and of some other characters).
_WIDE = (0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380)
_WIDE_FIRST = np.isin(np.arange(256), [x >> 8 for x in _WIDE])
#: A space and visible characters.
_WORD = r"^ [!-~\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]+$"
#: How byte-level BPE writes a space at the start of a token.
_LEAD = "Ġ"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def part_starts(text: np.ndarray) -> np.ndarray:
    """At which bytes of a text (UTF-8) parts begin, the first aside: whether a pre-token ends before each, whatever follows.

    That is before a space or line feed after a visible character, before a mark after a letter, and after a line feed between two visible characters.
    """
    blank, begins = _BLANK[text], np.zeros(len(text), bool)
    wide = np.flatnonzero(_WIDE_FIRST[text])
    wide = wide[np.isin(text[wide].astype(np.int64) << 8 | text[np.minimum(wide + 1, len(text) - 1)], _WIDE)]
    for k in range(3):
        blank[np.minimum(wide + k, len(text) - 1)] = True
    feed = text == 10
    begins[1:] = ((text == 32) | feed)[1:] & ~blank[:-1] | _LETTER[text[:-1]] & _MARK[text[1:]]
    begins[2:] |= feed[1:-1] & ~blank[2:] & ~blank[:-2]
    return begins


def all_part_starts(text: np.ndarray, size: int = 200_000) -> np.ndarray:
    """part_starts of a long text, `size` bytes and their neighbours at a time, so that what that takes beside the result is small."""
    begins = np.zeros(len(text), bool)
    for k in range(0, len(text), size):
        left = max(0, k - 4)
        begins[k : k + size] = part_starts(text[left : k + size + 4])[k - left : k - left + size]
    return begins


class PartEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as encode(text, add_special_tokens=False) does.

    The ids of at most 2 * cached parts of up to `longest` characters are kept, as Arrow arrays: where there are more, the `cached`
    ones that were used most, and what they were used until then counts half from there on.
    """

    def __init__(self, path: str, cached: int = 300_000, longest: int = 64):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cached, self.longest = cached, longest
        self.parts, self.ids, self.uses = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0)
        before = self.tokenizer.pre_tokenizer
        self.cuts = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        known = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(known.values()) + 1, bool)
        self.leads[[i for token, i in known.items() if token.startswith(_LEAD)]] = True

    def _each(self, texts: list[str]) -> pa.LargeBinaryArray:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return pa.array([np.array(e.ids, "<u4").tobytes() for e in found], pa.large_binary())

    def _together(self, parts: list[str]) -> pa.LargeBinaryArray:
        """The ids of parts that are a space and visible characters: encoded as one text, in which leading spaces tell them apart."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.leads[ids])
        if len(at) != len(parts):
            return self._each(parts)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(4 * np.append(at, len(ids)).astype(np.int64)), pa.py_buffer(ids)])

    def _encode_new(self, parts: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each part."""
        word = pc.match_substring_regex(parts, _WORD).to_numpy(zero_copy_only=False) & self.cuts
        words, rest = (parts.filter(pa.array(x)).to_pylist() for x in (word, ~word))
        found = [self._together(words[k : k + 500]) for k in range(0, len(words), 500)]  # what the tokenizer returns for each token takes much memory
        found += [self._each(rest[k : k + 100]) for k in range(0, len(rest), 100)]
        if not found:
            return pa.array([], pa.large_binary())
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.argsort(~word, kind="stable"), kind="stable")))

    def _keep(self, new: pa.StringArray, ids: pa.LargeBinaryArray, used: np.ndarray) -> None:
        """Keep the new parts too; used: how often each part, known or new, was met."""
        short = np.append(np.ones(len(self.parts), bool), pc.less_equal(pc.utf8_length(new), self.longest).to_numpy(zero_copy_only=False))
        self.uses = (np.append(self.uses, np.zeros(len(new))) + used)[short]
        self.parts, self.ids = (pa.concat_arrays(x).filter(pa.array(short)) for x in ([self.parts, new], [self.ids, ids]))
        if len(self.parts) > 2 * self.cached:
            most = np.argpartition(-self.uses, self.cached)[: self.cached]
            self.parts, self.ids, self.uses = self.parts.take(pa.array(most)), self.ids.take(pa.array(most)), self.uses[most] / 2

    def _parts(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The parts of all texts in their order, and the number of the first one of each text, and that of all at the end."""
        _, at, content = texts.buffers()
        at = np.frombuffer(at, np.int32)[: len(texts) + 1]
        data = np.frombuffer(content or b"", np.uint8)[: at[-1]]
        begins = all_part_starts(data) if self.cuts else np.zeros(len(data), bool)
        for token in self.added if self.cuts else ():  # an added token is found before anything is split
            for k in np.flatnonzero(pc.match_substring(texts, token)):
                begins[at[k] : at[k + 1]] = False
        begins[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.append(np.flatnonzero(begins), at[-1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), content), np.searchsorted(starts, at)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        parts, starts = self._parts(pa.array(texts, pa.string()))
        place = pc.index_in(parts, value_set=self.parts)
        lost = parts.filter(place.is_null()).dictionary_encode()
        new, number = self._encode_new(lost.dictionary), place.fill_null(-1).to_numpy().astype(np.int64)
        number[number < 0] = len(self.parts) + lost.indices.to_numpy()
        ids = pa.concat_arrays([self.ids, new]).take(pa.array(number))
        self._keep(lost.dictionary, new, np.bincount(number, minlength=len(self.parts) + len(new)))
        _, ends, content = ids.buffers()
        ends, content = np.frombuffer(ends, np.int64)[starts].tolist(), memoryview(content or b"")
        return [content[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def stretches(self, batches: Iterator[pa.RecordBatch], size: int = 4_000_000) -> Iterator[tuple[list[int | None], list[bytes]]]:
        """The doc_ids (first column) and ids of the texts (second column) of batches, some `size` characters at a time; null texts are empty."""
        docs, texts, held = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(doc)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= size:
                    yield docs, self.encode_all(texts)
                    docs, texts, held = [], [], 0
                    common.trim()
        if docs:
            yield docs, self.encode_all(texts)
        common.trim()


def encoder(path: str, cached: int = 300_000) -> PartEncoder:
    """One encoder for each Python worker, file and size; what it keeps outlives a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return common.held(f"encoder {cached} {path}", lambda: PartEncoder(path, cached))
