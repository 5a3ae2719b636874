"""Batch encoding with the tokenizers library behind a bounded cache of space-free runs.

The pre-tokenizer of word_bpe_49k never joins characters across a space or line feed, no special token
holds one, and NFC composes nothing across one; so a text's ids are those of its runs, one after another.
The library itself encodes every distinct run.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docquarry.llm.base import as_text
from docquarry.llm.wordhash import row_hashes

_encoders: dict[tuple[str, int], "RunEncoder"] = {}


class RunEncoder:
    """encode(): flat uint32 ids and row offsets, add_special_tokens=False.

    A run is known by two 64-bit hashes of its bytes, so the cache holds no strings: sorted hashes, and for
    each run the place of its ids. Of a full cache, the runs that came back stay.
    """

    def __init__(self, path: str, max_runs: int, max_ids: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.max_ids = max_ids
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.max_runs = max_runs
        mark = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or None
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = mark is not None and token.endswith(mark)
        self._clear()

    def _clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.uint8)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _shrink(self) -> None:
        """Keep the runs that came in a second slice, at most half the bounds."""
        keep = np.flatnonzero(self.uses > 1)
        keep = np.sort(keep[np.argsort(-self.uses[keep].astype(int), kind="stable")[: self.max_runs // 2]])
        size = self.size[keep].astype(np.int64)
        keep = keep[np.cumsum(size) <= self.max_ids // 2]
        size = self.size[keep].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[keep] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        key, check, uses = self.key[keep], self.check[keep], self.uses[keep] // 2
        self._clear()
        self.key, self.check, self.start, self.size, self.uses = key, check, ends - size, size.astype(np.int32), uses
        self.used = len(ids)
        self.ids = np.concatenate((ids, np.zeros(1 << 16, np.uint32)))

    @staticmethod
    def _ends(run: str) -> int:
        """Pre-tokens of a run of Latin letters (1), with a comma or full stop after them (2); 0: unknown."""
        body = run[:-1] if run[-1:] in {",", "."} else run
        return (1 + (body is not run)) * (body.isalpha() and (body.isascii() or max(body) < "\u0250"))

    def _encode(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs, sizes). Runs of known pre-token count go to the library many to a text and are told apart by word-end tokens."""
        ends = np.fromiter(map(self._ends, runs), np.int64, len(runs))
        known, size, found = np.flatnonzero(ends), np.zeros(len(runs), np.int64), []
        for lo in range(0, len(known), 2000):
            at = known[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([runs[i] for i in at])], add_special_tokens=False)[0].ids, np.int64)
            stop = np.flatnonzero(self.closes[ids])
            if len(stop) == ends[at].sum():
                edge = stop[np.cumsum(ends[at]) - 1] + 1
                size[at] = np.diff(edge, prepend=0)
                found.append((at, ids))
            else:
                ends[at] = 0
        single = np.flatnonzero(ends == 0)
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([runs[i] for i in single], add_special_tokens=False)] if len(single) else []
        size[single] = np.fromiter(map(len, lists), np.int64, len(lists))
        found.append((single, np.fromiter(chain.from_iterable(lists), np.int64, int(size[single].sum()))))
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        for at, ids in found:
            n = size[at]
            out[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return out, size

    def _learn(self, key: np.ndarray, check: np.ndarray, runs: list[str]) -> None:
        ids, size = self._encode(runs)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(size) - size
        self.used += len(ids)
        order = np.argsort(key, kind="stable")
        at = np.searchsorted(self.key, key[order])
        fresh = ((self.key, key), (self.check, check), (self.start, start), (self.size, size), (self.uses, np.zeros(len(key), np.uint8)))
        self.key, self.check, self.start, self.size, self.uses = (np.insert(old, at, new[order]) for old, new in fresh)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places of the runs in the cache; -1: not there."""
        if not len(self.key):
            return np.full(len(key), -1)
        order = np.argsort(key)
        at = np.empty(len(key), np.int64)
        at[order] = np.minimum(np.searchsorted(self.key, key[order]), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.key) > self.max_runs or self.used > self.max_ids:
            self._shrink()
        texts = as_text(texts)
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # the library lower-cases, but special tokens are matched before
            texts = pc.ascii_lower(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        runs = coded.dictionary
        key, check = row_hashes(runs)
        at = self._find(key, check)
        if len(new := np.flatnonzero(at < 0)):
            self._learn(key[new], check[new], runs.take(pa.array(new)).to_pylist())
            at = self._find(key, check)
            if (at < 0).any():
                raise RuntimeError("two runs share a 64-bit hash")
        self.uses[at] += self.uses[at] < 255
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        size, start = self.size[at].astype(np.int64), self.start[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        return self.ids[place], ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]


def encoder(path: str, max_runs: int = 200_000, max_ids: int = 2_000_000) -> RunEncoder:
    """This process's encoder for a vocabulary file. Its cache holds max_runs runs (33 bytes each) and max_ids ids (4 bytes), and one slice's more."""
    key = (path, max_runs)
    if key not in _encoders:
        _encoders[key] = RunEncoder(path, max_runs, max_ids)
    return _encoders[key]
