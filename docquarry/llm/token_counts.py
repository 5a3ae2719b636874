"""Operator 8, token counts: a tokenizer compiled to a deterministic finite-state transducer.

The transducer reads code points. Its states hold what byte-pair merging still needs of the word so far
(the longest suffix that starts some token, with the last token and relative count at each place in it);
each transition carries the number of tokens by which the count changes. Transitions are determinised on
demand and kept in a bounded table. Texts are cut into chunks of fixed length; each chunk becomes a state
map (the part before its first white space, which depends on the entry state, and the rest, which does
not), and the maps of a text's chunks compose through a tree-shaped scan. All lanes step together.

Null and empty texts: 0 tokens. Special strings inside texts count as one token, as in the library.
Very long texts only mean more chunks. Repeated rows are counted each; an empty table gives an empty table.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.base import as_text, slices

_MARK = 0x1000  # added to a byte symbol that ends a word
_EOT, _SPECIAL = 0x110001, 0x110000
_compiled: dict[tuple, "Transducer"] = {}


class Transducer:
    """Counts the tokens of a BPE vocabulary with word-end marks."""

    def __init__(self, path: str, max_states: int = 250_000, columns: int = 96):
        from tokenizers import Tokenizer, normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.compose, self.lower = normalizers.NFC(), normalizers.Lowercase()
        self.special = [t["content"] for t in spec["added_tokens"]]
        end = model.get("end_of_word_suffix") or ""
        byte_of = self._byte_symbols()

        def fold(token: str) -> str:
            last = bool(end) and token.endswith(end)
            body = token[: -len(end)] if last else token
            s = "".join(chr(byte_of[c]) for c in body)
            return s[:-1] + chr(ord(s[-1]) + _MARK) if last else s

        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((fold(a), fold(b)), rank)
        self.tokens = {fold(t) for t in model["vocab"] if t not in self.special}
        self.starts = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.max_states, self.columns = max_states, columns
        self.kinds: dict[str, str] = {}
        self.spelled: dict[int, str] = {}
        self._clear()

    @staticmethod
    def _byte_symbols() -> dict[str, int]:
        """The usual printable stand-ins for bytes: visible Latin-1 stands for itself, the others follow from 256."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}

    def _clear(self) -> None:
        self.state_of: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.symbol = np.full(0x110002, -1, np.int32)
        self.points: list[int] = []
        self.next = np.full(self.columns << 10, -1, np.int32)
        self.gain = np.zeros(self.columns << 10, np.int8)
        self.rare: dict[tuple[int, int], tuple[int, int]] = {}
        self.fresh = self._state(("fresh",))

    def _state(self, key: tuple) -> int:
        at = self.state_of.get(key)
        if at is None:
            at = self.state_of[key] = len(self.states)
            self.states.append(key)
            if (at + 1) * self.columns > len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.gain = np.concatenate((self.gain, np.zeros_like(self.gain)))
        return at

    def _bpe(self, s: str) -> list[str]:
        parts = list(s)
        while len(parts) > 1:
            best = min(((self.merge.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart; left may be empty (start of a word)."""
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            self.pairs[key] = self._bpe(left + right) == ([left, right] if left else [right])
        return self.pairs[key]

    #: A word's context: (text of the window, ((last token, tokens since) at each place of the window)).
    EMPTY = ("", (("", 0),))

    def _push(self, context: tuple, c: str) -> tuple[tuple, int]:
        """One symbol more: the new context and the change of the count."""
        window, places = context
        s = window + c
        base = len(s)
        for i in range(base):
            token = s[i:]
            if token in self.tokens and places[i] and self._fits(places[i][0], token):
                gain = places[i][1] + 1  # counts are relative to the window's end
                break
        else:
            raise ValueError(f"no token ends {s!r}")
        cut = next(i for i in range(base + 1) if s[i:] in self.starts or i == base)
        # A place counts only while the text from it may still grow into a token.
        moved = tuple((p[0], p[1] - gain) if p and s[i:] in self.starts else None for i, p in enumerate(places[cut:], cut)) + ((token, 0),)
        return (s[cut:], moved), gain

    def _kind(self, c: str) -> str:
        """L letter, N number, S white space, O other, as the library's pre-tokenizer splits."""
        k = self.kinds.get(c)
        if k is None:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            alone = cut(c)
            k = "S" if not alone else "L" if len(cut("a" + c)) == 1 else "O" if len(cut("!" + c)) == 1 else "N"
            self.kinds[c] = k
        return k

    def _run(self, context: tuple, pending: str) -> int:
        """The change of the count as the run ends with its pending byte."""
        return self._push(context, chr(ord(pending) + _MARK))[1]

    def _bytes(self, context: tuple, pending: str, c: str) -> tuple[tuple, str, int]:
        gain = 0
        for b in c.encode("utf-8"):
            if pending:
                context, g = self._push(context, pending)
                gain += g
            pending = chr(b)
        return context, pending, gain

    def _word(self, text: str) -> int:
        context, pending, gain = self._bytes(self.EMPTY, "", text)
        return gain + self._run(context, pending)

    def _step(self, key: tuple, c: str) -> tuple[tuple, int]:
        """c: one lower-cased character, or "" where the text ends or a special token stands."""
        kind = self._kind(c) if c else "S"
        tag = key[0]
        if tag == "quote":  # an apostrophe where a match starts, perhaps with a first letter of 're, 've or 'll
            seen = key[1]
            if not seen and c and c in "stmd":
                return ("fresh",), self._word("'" + c)
            if not seen and c and c in "rvl":
                return ("quote", c), 0
            if seen and c == {"r": "e", "v": "e", "l": "l"}[seen]:
                return ("fresh",), self._word("'" + seen + c)
            if not seen:
                key, gain = ("O", self.EMPTY, "'"), 0
            else:
                gain, key = self._word("'"), ("L", self.EMPTY, seen)
            new, more = self._step(key, c)
            return new, gain + more
        if tag in "LO" and len(tag) == 1:
            _, context, pending = key
            if kind == tag:
                context, pending, gain = self._bytes(context, pending, c)
                return (tag, context, pending), gain
            new, more = self._step(("fresh",), c)
            return new, self._run(context, pending) + more
        if kind == "S":
            return ("fresh",), 0
        if kind == "N":
            return ("fresh",), self._word(c)
        if c == "'":
            return ("quote", ""), 0
        context, pending, gain = self._bytes(self.EMPTY, "", c)
        return (kind, context, pending), gain

    def _lowered(self, point: int) -> str:
        if point not in self.spelled:
            self.spelled[point] = self.lower.normalize_str(chr(point))
        return self.spelled[point]

    def _move(self, state: int, point: int) -> tuple[int, int]:
        key = self.states[state]
        if point in (_EOT, _SPECIAL):
            new, gain = self._step(key, "")
            return self._state(new), gain + (point == _SPECIAL)
        total = 0
        for c in self._lowered(point):
            key, gain = self._step(key, c)
            total += gain
        return self._state(key), total

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        got = self.symbol[points]
        if (got < 0).any():
            for p in map(int, np.unique(points[got < 0])):
                low = p if p >= _SPECIAL else self._lowered(p)
                same = ord(low) if isinstance(low, str) and len(low) == 1 else p
                for q in (same, p):
                    if self.symbol[q] < 0:
                        self.symbol[q] = len(self.points) if q == same else self.symbol[same]
                        if q == same:
                            self.points.append(q)
            got = self.symbol[points]
        return got

    def run(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lanes over symbols[begin:end], each from its state: (count, end state) of each."""
        size = end - begin
        order = np.argsort(-size, kind="stable")
        at, left, now = begin[order], size[order], state[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        active = len(order)
        last = self.columns - 1
        for step in range(int(left[0]) if len(left) else 0):
            while active and left[active - 1] <= step:
                active = int(np.searchsorted(-left, -step, side="left"))
            y = symbols[at[:active] + step]
            key = now[:active] * self.columns + np.minimum(y, last)
            to = self.next[key]
            gain = self.gain[key]
            if (missing := to < 0).any():
                gain = gain.astype(np.int64)
                lanes = np.flatnonzero(missing)
                both = now[lanes] * (1 << 21) + y[lanes]
                found: dict[int, tuple[int, int]] = {}
                each, back = np.unique(both, return_inverse=True)
                for pair in each:
                    s, sym = int(pair) >> 21, int(pair) & ((1 << 21) - 1)
                    k = s * self.columns + sym
                    if sym < last and self.next[k] >= 0:
                        found[int(pair)] = int(self.next[k]), int(self.gain[k])
                        continue
                    if (s, sym) in self.rare:
                        found[int(pair)] = self.rare[s, sym]
                        continue
                    new, g = self._move(s, self.points[sym])
                    if sym < last:
                        self.next[s * self.columns + sym], self.gain[s * self.columns + sym] = new, g
                    else:
                        self.rare[s, sym] = (new, g)
                    found[int(pair)] = new, g
                got = np.array([found[int(p)] for p in each], np.int64)[back]
                to[lanes], gain[lanes] = got[:, 0], got[:, 1]
            now[:active] = to
            count[:active] += gain
        out_count, out_state = np.empty_like(count), np.empty_like(now)
        out_count[order], out_state[order] = count, now
        return out_count, out_state

    def _points(self, text: str) -> np.ndarray:
        parts = [text]
        for s in self.special:
            parts = [q for p in parts for q in (self._around(p, s) if isinstance(p, str) else [p])]
        made = [np.frombuffer(self._composed(p).encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(p, str) else np.array([_SPECIAL], np.uint32) for p in parts]
        return np.concatenate(made)

    def _composed(self, p: str) -> str:
        return p if p.isascii() or max(p) < "̀" else self.compose.normalize_str(p)

    @staticmethod
    def _around(text: str, special: str) -> list:
        out: list = []
        for i, p in enumerate(text.split(special)):
            out += ([None] if i else []) + [p]
        return out

    def count(self, texts: pa.Array, chunk: int = 2048) -> np.ndarray:
        """Tokens of each row."""
        if len(self.states) > self.max_states:
            self._clear()
        texts = as_text(texts).to_pylist()
        if not texts:
            return np.zeros(0, np.int64)
        plain = not any(s in t for t in texts for s in self.special)
        if plain:
            each = [self._composed(t) for t in texts]
            size = np.fromiter(map(len, each), np.int64, len(each))
            points = np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), np.uint32)
        else:
            arrays = [self._points(t) for t in texts]
            size = np.fromiter(map(len, arrays), np.int64, len(arrays))
            points = np.concatenate(arrays)
        symbols = self._symbols(points)
        close = int(self._symbols(np.array([_EOT]))[0])
        stop = np.cumsum(size)
        first = stop - size
        pieces = np.maximum(1, -(-size // chunk))
        row = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = first[row] + nth * chunk
        hi = np.minimum(lo + chunk, stop[row])
        # A chunk's head reaches over its first white space; a text's first chunk has none.
        blank = np.flatnonzero(np.isin(symbols, self.symbol[[p for p in (32, 10) if self.symbol[p] >= 0]])) if len(symbols) else np.zeros(0, np.int64)
        if len(blank):
            where = np.searchsorted(blank, lo)
            sync = np.where(where < len(blank), blank[np.minimum(where, len(blank) - 1)], hi)
        else:
            sync = hi
        split = np.where(nth == 0, lo, np.minimum(sync + 1, hi))
        body = (nth == 0) | (sync < hi)
        tokens, state = self.run(symbols, split, hi, np.full(len(row), self.fresh))
        head_lo, head_hi = lo, split
        # The maps compose pairwise, level by level, within each text.
        while len(row) > len(size):
            rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            left = np.flatnonzero((rank % 2 == 0) & np.append(row[1:] == row[:-1], False))
            right = left + 1
            with_body = left[body[left]]
            after = with_body + 1
            got, ended = self.run(symbols, head_lo[after], head_hi[after], state[with_body])
            tokens[with_body] += got + np.where(body[after], tokens[after], 0)
            state[with_body] = np.where(body[after], state[after], ended)
            pure = left[~body[left]]
            head_hi[pure] = head_hi[pure + 1]
            body[pure], tokens[pure], state[pure] = body[pure + 1], tokens[pure + 1], state[pure + 1]
            keep = np.ones(len(row), bool)
            keep[right] = False
            row, head_lo, head_hi, body, tokens, state = (x[keep] for x in (row, head_lo, head_hi, body, tokens, state))
        flush, _ = self.run(np.array([close]), np.zeros(len(row), np.int64), np.ones(len(row), np.int64), state)
        return tokens + flush


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each input row: id, n_bytes, n_tokens, over_limit. Narrow: no shuffle."""

    def count(batches):
        machine = transducer(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(machine.count(part.column(1)), pa.int64())], ["id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    return read.mapInArrow(count, "id long, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
