"""SentencePiece BPE by a table of last tokens: exact encoding in one pass over the matches of an automaton.

Every prefix of a word has exactly one encoding, so it is enough to keep the last token of each prefix. A token that ends
at a position is that last token if it can follow the last token of the prefix before it, that is, if encoding the two
together gives just the two. An Aho-Corasick automaton lists the candidates; the pair test undoes merges from the latest
to the earliest; the ids are recovered from the end backwards. The work is linear in the text, also for endless words.

Pieces hold the word mark only in front, so words are independent and remembered; characters that are in no piece never
merge and become byte pieces. Runs of marks merge last, from the left.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, release_memory, text_or_empty

MARK = "▁"
#: Words and pairs that a worker remembers; a full table starts anew.
REMEMBERED = 600_000
#: Bytes of text whose ids are held at a time; a longer text is held alone.
BYTES_AT_ONCE = 4_000_000


class Codec:
    def __init__(self, model_file: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        pieces = {model.id_to_piece(i): i for i in range(size) if not special(i)}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = model.eos_id()
        self.names = [str(i) for i in range(size)]
        self.ids = pieces
        #: pieces that are runs of marks, by length
        self.runs = {len(p): i for p, i in pieces.items() if set(p) == {MARK}}
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and set(p) != {MARK}) for p in pieces) or 1 not in self.runs:
            raise ValueError("only pieces with single leading marks and runs of marks are supported")
        longer = sorted((p for p in pieces if len(p) > 1 and set(p) != {MARK}), key=lambda p: -model.get_score(pieces[p]))
        if any(model.get_score(pieces[a]) == model.get_score(pieces[b]) for a, b in zip(longer, longer[1:])):
            raise ValueError("pieces of equal score have no defined order")
        scores = {model.get_score(i) for n, i in self.runs.items() if n > 1}
        if len(scores) > 1 or (scores and longer and min(scores) >= model.get_score(pieces[longer[-1]])):
            raise ValueError("runs of marks have to merge after everything else, in one rank")
        #: order of merges; single characters come first and have no parts
        self.rank = {p: k + 1 for k, p in enumerate(longer)}
        self.single = {p for p in pieces if len(p) == 1}
        self.parts: dict[str, tuple[str, str]] = {}
        self.matches = ahocorasick.Automaton()
        for p in self.single:
            self.matches.add_word(p, (p, len(p)))
        for p in longer:
            whole, parts = self._merge(p)
            if whole == [p]:  # other pieces are never made
                self.parts[p] = parts
                self.matches.add_word(p, (p, len(p)))
        self.matches.make_automaton()
        self.marked, self.bare, self.pairs, self.marks = _Table(self._marked), _Table(self._word), _Table(self._follows), _Table(self._run)
        if model.normalize(" a  ﬁ　b ") not in (f"{MARK}{MARK}a{MARK}{MARK}ﬁ　b{MARK}", " a  ﬁ　b "):
            raise ValueError("only models that leave the text as it is and mark its start are supported")

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """Plain merging of a short text, and the two parts of the last merge."""
        symbols, parts = list(text), ("", "")
        while len(symbols) > 1:
            rank, at = min((self.rank.get(a + b, len(self.rank) + 1), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if rank > len(self.rank):
                break
            parts = (symbols[at], symbols[at + 1])
            symbols[at:at + 2] = ["".join(parts)]
        return symbols, parts

    def _follows(self, pair: tuple[str, str]) -> bool:
        """Whether the two tokens stay two when they meet: no part of them would have merged across before they were made."""
        left, right = pair
        rank, limit = self.rank, len(self.rank) + 1
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            a, b = rank.get(left, 0), rank.get(right, 0)
            if not a and not b:
                return True
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def tokens(self, word: str) -> list[str]:
        """Pieces of a word of known characters, from the table of last tokens."""
        n = len(word)
        last: list[str | None] = [None] * (n + 1)
        pairs = self.pairs
        for end, (token, length) in self.matches.iter(word):
            end += 1
            if last[end] is None and (end == length or (before := last[end - length]) and pairs[before, token]):
                last[end] = token
        out = []
        while n:
            out.append(last[n])
            n -= len(out[-1])
        return out[::-1]

    def _word(self, word: str) -> tuple[int, ...]:
        ids: list[int] = []
        at = 0
        for k, c in enumerate(word):
            if c not in self.single:
                ids += [self.ids[t] for t in self.tokens(word[at:k])] if k > at else []
                ids += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                at = k + 1
        return tuple(ids + ([self.ids[t] for t in self.tokens(word[at:])] if at < len(word) else []))

    def _marked(self, word: str) -> tuple[int, ...]:
        return self._word(MARK + word) if word else ()

    def _run(self, n: int) -> list[int]:
        """Ids of n marks: pairs that make a piece merge from the left, in one rank."""
        size, follows, precedes = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        ready = list(range(n - 1)) if 2 in self.runs else []  # sorted, so it is a heap
        while ready:
            left = heapq.heappop(ready)
            right = follows[left]
            if not size[left] or right >= n or size[left] + size[right] not in self.runs:
                continue
            size[left] += size[right]
            size[right] = 0
            follows[left] = follows[right]
            if follows[left] < n:
                precedes[follows[left]] = left
                heapq.heappush(ready, left)
            if precedes[left] >= 0:
                heapq.heappush(ready, precedes[left])
        return [self.runs[k] for k in size if k]

    def encode(self, text: str) -> list[int]:
        """The ids the library gives, without control ids."""
        if not text:
            return []
        out: list[tuple[int, ...] | list[int]] = []
        lone, marked = self.ids[MARK], self.marked
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            words = line.split(" ")
            if k:
                out.append(self.bare["\n"])
                if first := words.pop(0):
                    out.append(self.bare[first])
            if "" not in words:
                out += [marked[w] for w in words]
                continue
            waiting = 0
            for word in words:
                if not word:
                    waiting += 1
                    continue
                ids = marked[word]
                if waiting:
                    joins = ids[0] == lone
                    out.append(self.marks[waiting + joins])
                    ids, waiting = ids[joins:], 0
                out.append(ids)
            if waiting:
                out.append(self.marks[waiting])
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


class _Table(dict):
    """Results by argument, emptied when full."""

    def __init__(self, compute: Callable):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.compute(key)
        return value


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """The codec of a worker; it stays between tasks."""
    return Codec(model_file)


def _digest(coder: Codec, ids: list[int]) -> tuple:
    return (len(ids), hashlib.sha256(" ".join(map(coder.names.__getitem__, ids)).encode()).hexdigest(),
            hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())


def encode(docs: DataFrame, model_file: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, [ids,] n_tokens, ids_sha256, decoded_sha256) of every text, with the end id and nothing else added.

    NULL texts are empty and have the end id only. Texts are read whole, however long. Repeated rows stay; other columns are
    ignored.
    """
    schema = "doc_id long, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def rows(coder: Codec, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        digests, held = [], []
        for text in texts:
            ids = coder.encode(text.as_py())
            ids.append(coder.end)
            digests.append(_digest(coder, ids))
            if with_ids:
                held.append(np.array(ids, np.int32))
        columns, names = [doc_ids], ["doc_id"]
        if with_ids:
            ends = np.concatenate(([0], np.cumsum([len(h) for h in held])))
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held) if held else [], pa.int32())))
            names.append("ids")
        columns += [pa.array([d[k] for d in digests], pa.string() if k else pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of tasks that this worker did before
        coder = codec(model_file)
        for batch in batches:
            for part in by_bytes(batch, 1, BYTES_AT_ONCE):
                yield rows(coder, part.column(0), part.column(1))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
