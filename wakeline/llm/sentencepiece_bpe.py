"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs whose concatenation is a piece, best score first and leftmost on
ties, and merges from it until it is empty; symbols that are no piece fall back to their bytes. Text is cut beforehand
only where no piece spans the cut (between two characters that no piece holds next to each other), which leaves the
merges as they are, so each cut part can be remembered in a bounded memo.

Every part that enters the memo is checked against the sentencepiece library in the Arrow batch where it first
appears; a text with a part that differs gets the library's ids and ``agrees`` false. Decoding is the library's.

Defined results: null is the empty text; an empty text has the end id alone and decodes to ''. Equal rows get equal
results; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from . import common

SPACE = "▁"
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
#: Parts remembered by one Python worker; two such generations are held at most.
MEMO = 150_000
#: Characters up to which an agenda is searched instead of kept as a heap.
SHORT = 24


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    """One merge-type vocabulary, loaded once per Python worker."""

    def __init__(self, model_file: str):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.lib.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        pairs: set[str] = set()
        for i in range(n):
            p = self.lib.id_to_piece(i)
            if self.lib.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i)):
                self.ids[p], self.score[p] = i, self.lib.get_score(i)
                pairs.update(a + b for a, b in zip(p, p[1:], strict=False))
        order = {x: i for i, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in self.score.items() if len(p) > 1}
        self.no_rank = len(order)
        self.pairs, self.end = pairs, self.lib.eos_id()
        self.digits = [str(i) for i in range(n)]
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.fresh: list[str] = []
        self.wrong: set[str] = set()

    def merge(self, part: str) -> tuple[int, ...]:
        """Ids of a part by the agenda of adjacent pairs: best score first, then leftmost.

        A short agenda is a list in the order of the text, whose best entry is searched; a long one is a heap with
        entries rank * n + position.
        """
        n, rank, ids = len(part), self.rank.get, self.ids
        sym = list(part)
        if n <= SHORT:
            none = self.no_rank
            agenda = [rank(part[i : i + 2], none) for i in range(n - 1)]
            while agenda and (best := min(agenda)) != none:
                a = agenda.index(best)
                y = sym[a] = sym[a] + sym.pop(a + 1)
                del agenda[a]
                if a < len(agenda):
                    agenda[a] = rank(y + sym[a + 1], none)
                if a:
                    agenda[a - 1] = rank(sym[a - 1] + y, none)
        else:
            agenda = [r * n + i for i in range(n - 1) if (r := rank(part[i : i + 2])) is not None]
            heapify(agenda)
            left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
            while agenda:
                r, a = divmod(heappop(agenda), n)
                x, b = sym[a], right[a]
                if not x or b >= n or rank(y := x + sym[b]) != r:
                    continue  # one of the two has been merged since
                sym[a], sym[b] = y, ""
                c = right[a] = right[b]
                if c < n:
                    left[c] = a
                    if (r := rank(y + sym[c])) is not None:
                        heappush(agenda, r * n + a)
                c = left[a]
                if c >= 0 and (r := rank(sym[c] + y)) is not None:
                    heappush(agenda, r * n + c)
        out: list[int] = []
        for x in sym:
            if x:
                i = ids.get(x)
                if i is None:
                    out += [self.byte_ids[b] for b in x.encode()]
                else:
                    out.append(i)
        return tuple(out)

    def cut(self, word: str) -> list[str]:
        """Parts of a word, cut between characters that no piece holds side by side."""
        if word.lstrip(SPACE).isalpha():  # parts of its own; a cut would save nothing
            return [word]
        pairs, out, at = self.pairs, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def part(self, part: str) -> tuple[int, ...]:
        got = self.new.get(part) or self.old.get(part)
        if got is None:
            got = self.merge(part)
            self.fresh.append(part)
        self.remember(part, got)
        return got

    def remember(self, key: str, got: tuple[int, ...]) -> None:
        if len(key) <= 64:
            self.new[key] = got

    def word(self, word: str) -> tuple[int, ...]:
        got = self.new.get(word) or self.old.get(word)
        if got is None:
            parts = self.cut(word)
            if len(parts) == 1:
                return self.part(word)
            got = tuple([i for p in parts for i in self.part(p)])
        self.remember(word, got)
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a text without the end id."""
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        if self.inner_space:  # pieces may then span words: nothing is cut
            return list(self.merge(whole))
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        words = _words(whole)
        got = [*map(self.new.get, words)]
        if None in got:
            got = [self.word(w) if g is None else g for g, w in zip(got, words, strict=True)]
        return [*chain.from_iterable(got)]

    def check(self) -> None:
        """Compare the parts new to this batch with the library. It puts a blank in front: compared without it."""
        if self.fresh:
            asked = [("\n" + x).replace(SPACE, " ") for x in self.fresh]
            lead = list(self.lib.encode("\n"))
            k = len(lead)
            for x, ids in zip(self.fresh, self.lib.encode(asked, num_threads=1), strict=True):
                if tuple(ids[k:]) != (self.new.get(x) or self.old.get(x) or self.merge(x)) or ids[:k] != lead:
                    self.wrong.add(x)
            self.fresh = []

    def differs(self, text: str) -> bool:
        return bool(self.wrong) and any(p in self.wrong for w in _words(SPACE + text.replace(" ", SPACE)) for p in self.cut(w))


_words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
_loaded: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    if model_file not in _loaded:
        _loaded[model_file] = Encoder(model_file)
    return _loaded[model_file]


def encode_batch(texts: list[str], model_file: str) -> tuple[list[list[int]], list[bool]]:
    """Ids with the end id, and whether they agree with the library, for a batch of texts."""
    e = encoder(model_file)
    ids = [e.encode(t) for t in texts]
    if e.inner_space:  # whole texts were merged: whole texts are checked
        agrees = [mine == list(theirs) for mine, theirs in zip(ids, e.lib.encode(texts, num_threads=1), strict=True)]
    else:
        e.check()
        agrees = [not e.differs(t) for t in texts]
    for i, ok in enumerate(agrees):
        if not ok:
            ids[i] = e.lib.encode(texts[i])
    return [[*x, e.end] for x in ids], agrees


def digests(texts: list[bytes], model_file: str) -> list[pa.Array]:
    e = encoder(model_file)
    ids, agrees = encode_batch([t.decode() for t in texts], model_file)
    decoded = e.lib.decode(ids, num_threads=1)
    sha, digits = hashlib.sha256, e.digits.__getitem__
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha(" ".join(map(digits, x)).encode()).hexdigest() for x in ids]),
        pa.array([sha(d.encode()).hexdigest() for d in decoded]),
        pa.array(agrees, pa.bool_()),
    ]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """One row per row of docs: its id and its token ids (array of int), with the end id."""
    at = model_file or default_model()

    def run(texts):
        ids, agrees = encode_batch([t.decode() for t in texts], at)
        return [pa.array(ids, pa.list_(pa.int32())), pa.array(agrees, pa.bool_())]

    return common.per_row(docs, [id_col], text_col, run, "ids array<int>, agrees boolean")


def detokenize(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str | None = None) -> DataFrame:
    """One row per row of tokens: its id and the decoded text; null ids decode to ''."""
    at = model_file or default_model()
    small = tokens.select(tokens[id_col].alias(id_col), tokens[ids_col].alias("ids"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                texts = encoder(at).lib.decode([x or [] for x in b.column(1).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return small.mapInArrow(run, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, text string")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    at = model_file or default_model()
    return common.per_row(docs, [id_col], text_col, lambda t: digests(t, at), SCHEMA)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE: dict[str, str] = {}
