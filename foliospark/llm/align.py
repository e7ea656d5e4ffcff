"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut a text into pieces that cover its bytes. The ends of both cuts together (``union1d``) are elementary
intervals, each within one token of either side, which ``searchsorted`` finds; so each interval is one overlap of two tokens, a
link. Ends that both cuts share close a group: the smallest stretch that is made of whole tokens on both sides.

A token never spans the white space before a word, in either vocabulary, so a text's alignment is the chain of its words'
alignments. Words recur: each is aligned once per Python worker and looked up from then on. Links are then counted over all
documents by a shuffle of (document, pair) rows that is summed before it, and each document is scored with these counts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from foliospark.llm.shared import give_back, own_name, slices, stored

#: A word with the white space before it. No token of either tokenizer spans its beginning.
WORD = re.compile(r"[ \n\t]+[^ \n\t]*")
#: Further white space joins words in ways of its own, and the second tokenizer's blank stands for itself: such texts are taken whole.
WHOLE = re.compile("[\\x0b-\\x0d\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000▁]")
BLANK = "▁"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "n_best", "count_sum")
#: A blank and letters, then signs, are two pieces to the first tokenizer, or one; its own splitting is not needed for them.
PLAIN = re.compile("( [A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")
#: Words that the first tokenizer gets in one call; what it returns for each is large.
AT_ONCE = 4096
#: A pair of ids is one number: the first id's bits are above these.
LOW = 32


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two rising arrays of ends that close together: both owners of each elementary interval, and which intervals end a group."""
    cuts = np.union1d(a, b)
    of_a, of_b = np.searchsorted(a, cuts), np.searchsorted(b, cuts)
    return of_a, of_b, (a[of_a] == cuts) & (b[of_b] == cuts) if len(cuts) else np.zeros(0, bool)


class _Words(dict):
    """From word to its number; one not seen before gets the next number and waits in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class Aligner:
    """``align(texts)``: for each text its numbers of tokens, groups and links, the groups as text, and its distinct pairs.

    ``most_links`` bounds the table of words: it starts anew beyond that many links.
    """

    def __init__(self, byte_bpe: str, pieces: str, most_links: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would compete with other tasks
        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = _byte_letters()
        self.letters = {b: c for c, b in letters.items()}
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        named = [(i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.bytes_b = {i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in named}
        self.lengths_a, self.lengths_b = (np.array([len(own.get(i, b"")) for i in range(max(own) + 1)]) for own in (self.bytes_a, self.bytes_b))
        self.decimals = list(map(str, range(max(len(self.lengths_a), len(self.lengths_b)))))
        self.blank = self.b.piece_to_id(BLANK)
        self.by_word = not any(re.search(f"[^ \\n\\t{BLANK}][ \\n\\t{BLANK}]|{BLANK}[\\n\\t]", p) for _, p in named)
        self.most_links = most_links
        self.clear()

    def clear(self) -> None:
        """Gives the tables' memory back."""
        self.words, self.groups = _Words(), []
        #: Of each word: tokens of both sides, groups, links, and 0 where its bytes do not come back; the pairs of all words.
        self.sizes, self.pairs = np.zeros((0, 5), np.int64), np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)

    def _ids(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of stretches that each begin with white space. The second tokenizer puts a blank before a stretch by itself."""
        plain = [PLAIN.fullmatch(w) for w in words]
        others = [w for w, m in zip(words, plain, strict=True) if not m]
        rest = iter([e.ids for i in range(0, len(others), AT_ONCE) for e in self.a.encode_batch(others[i : i + AT_ONCE], add_special_tokens=False)])
        a = [self._piece(m[1]) + (self._piece(m[2]) if m[2] else []) if m else next(rest) for m in plain]
        b = self.b.encode([w.removeprefix(" ") for w in words], num_threads=1)
        return a, [ids if w[:1] == " " else ids[1:] if ids[:1] == [self.blank] else [] for w, ids in zip(words, b, strict=True)]

    def _piece(self, piece: str) -> list[int]:
        """Ids of what the first tokenizer takes as one piece."""
        return [t.id for t in self.a.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    @staticmethod
    def _come_back(whole: list[bytes], ids: list[list[int]], own: dict[int, bytes], lengths: np.ndarray) -> np.ndarray:
        """Which stretches are the bytes of their tokens, joined; most often all are, which one comparison shows."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, counts.sum())
        upto = np.concatenate([[0], np.cumsum(lengths[flat])])[np.cumsum(counts)]
        if np.array_equal(upto, np.cumsum([len(w) for w in whole])) and b"".join(map(own.__getitem__, flat.tolist())) == b"".join(whole):
            return counts > 0
        return np.array([bool(x) and b"".join(map(own.__getitem__, x)) == w for w, x in zip(whole, ids, strict=True)], bool)

    def _aligned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The sizes of each word, the pairs of all, and each word's groups as text."""
        whole = [w.encode("utf-8", "surrogatepass") for w in words]
        ids_a, ids_b = self._ids(words)
        right = self._come_back(whole, ids_a, self.bytes_a, self.lengths_a) & self._come_back(whole, ids_b, self.bytes_b, self.lengths_b)
        if not right.all():
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, right, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(words)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = np.cumsum(self.lengths_a[flat_a]), np.cumsum(self.lengths_b[flat_b])
        of_a, of_b, closing = overlaps(ends_a, ends_b)
        pairs = (flat_a[of_a] << LOW) | flat_b[of_b]
        word_of = np.repeat(np.arange(len(words)), n_a)[of_a]
        n_links, n_groups = np.bincount(word_of, minlength=len(words)), np.bincount(word_of[closing], minlength=len(words))
        upto_a, upto_b = (of_a[closing] + 1).tolist(), (of_b[closing] + 1).tolist()
        text_a, text_b = ([self.decimals[i] for i in flat.tolist()] for flat in (flat_a, flat_b))
        made = [f"{text_a[i] if j - i == 1 else ','.join(text_a[i:j])}|{text_b[k] if m - k == 1 else ','.join(text_b[k:m])}" for i, j, k, m in zip([0, *upto_a], upto_a, [0, *upto_b], upto_b)]  # noqa: B905
        cuts = [0, *np.cumsum(n_groups).tolist()]
        return np.stack([n_a, n_b, n_groups, n_links, right.astype(np.int64)], 1), pairs, [";".join(made[i:j]) for i, j in zip(cuts, cuts[1:])]  # noqa: B905

    def _learn(self) -> None:
        sizes, pairs, groups = self._aligned(self.words.new)
        self.words.new = []
        self.begins = np.concatenate([self.begins, np.cumsum(sizes[:, 3]) - sizes[:, 3] + len(self.pairs)])
        self.sizes, self.pairs = np.concatenate([self.sizes, sizes]), np.concatenate([self.pairs, pairs])
        self.groups += groups

    def _alone(self, text: str) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """A text aligned as one stretch."""
        sizes, pairs, groups = self._aligned([" " + text])
        distinct, times = np.unique(pairs, return_counts=True)
        return sizes[0, :4], groups[0], distinct, times

    def align(self, texts: list[str | None]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        if len(self.pairs) > self.most_links:
            self.clear()
        none = np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        split = [WORD.findall(" " + t) if t and self.by_word and not WHOLE.search(t) else None for t in texts]
        numbers = [None if s is None else np.fromiter(map(self.words.__getitem__, s), np.int64, len(s)) for s in split]
        del split
        if self.words.new:
            self._learn()
        out = []
        for text, own in zip(texts, numbers, strict=True):
            if not text:
                out.append(none)
                continue
            sizes = None if own is None else self.sizes[own]
            if sizes is None or not sizes[:, 4].all():
                out.append(self._alone(text))
                continue
            words, often = np.unique(own, return_counts=True)
            lengths = self.sizes[words, 3]
            ends = np.cumsum(lengths)
            at = np.repeat(self.begins[words] - ends + lengths, lengths) + np.arange(ends[-1])
            distinct, place = np.unique(self.pairs[at], return_inverse=True)
            times = np.bincount(place, np.repeat(often, lengths), len(distinct)).astype(np.int64)
            out.append((sizes[:, :4].sum(0), ";".join(map(self.groups.__getitem__, own.tolist())), distinct, times))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def align(df: DataFrame, key: str, text: str, byte_bpe: str, pieces: str, block_chars: int = 500_000) -> DataFrame:
    """For each row: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of both sides in order), and
    the distinct linked ``pairs`` (first id times 2**32 plus second id) with how many ``times`` each is linked.

    ``byte_bpe`` is a byte-level tokenizer file, which gets a blank before the text; ``pieces`` a model that adds one itself. A text
    that is null or empty, or whose bytes a side does not give back, has no tokens: zeros, an empty string and empty
    arrays. Special tokens' strings are ordinary text. A text of any length is whole; repeated rows give a row each, a null key stays null, an
    empty table gives no rows. Other columns are ignored; a key with the name of a result is an error. Texts are worked on in
    blocks of ``block_chars`` (or one text).
    """
    source = df.select(F.col(f"`{own_name(key, RESULTS)}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    counts = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    arrays = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "times")]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *counts, T.StructField("groups", T.StringType()), *arrays])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligners.get((byte_bpe, pieces)) or Aligner(byte_bpe, pieces)
        _aligners[byte_bpe, pieces] = aligner
        kinds = to_arrow_schema(schema)
        try:
            for batch in batches:
                texts = batch.column("__text")
                lengths = [len(t) if (t := x.as_py()) else 0 for x in texts]
                for begin, end in slices(lengths, block_chars):
                    found = aligner.align(texts[begin:end].to_pylist())
                    sizes = np.stack([f[0] for f in found])
                    lists = []
                    for i in (2, 3):
                        offsets = np.concatenate([[0], np.cumsum([len(f[i]) for f in found])]).astype(np.int32)
                        lists.append(pa.ListArray.from_arrays(offsets, np.concatenate([f[i] for f in found])).cast(kinds.field("pairs").type))
                    yield pa.RecordBatch.from_arrays([batch.column("__key")[begin:end], *[pa.array(sizes[:, i]) for i in range(4)], pa.array([f[1] for f in found], pa.string()), *lists], schema=kinds)
        finally:
            aligner.clear()
            give_back()

    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``count``, in how many rows of ``aligned`` it is linked, and ``best``, whether no pair of its first id has a higher count.
    At most one row for each pair of both vocabularies, whatever the number of rows.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = stored(counts, "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", LOW).alias("a")).agg(F.max("count").alias("most"))
    return stored(counts.join(highest, F.shiftright("pair", LOW) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-best")


def with_counts(aligned: DataFrame, broadcast_rows: int = 1_000_000, salts: int = 16) -> DataFrame:
    """``aligned`` without ``pairs`` and ``times``, but with ``n_best``, the links whose pair has its first id's highest count over all rows
    (ties included), and ``count_sum``, the counts of all links summed; 0 without links.

    ``aligned`` is written once to the shared folder. The counts are broadcast up to ``broadcast_rows`` pairs (17 bytes each); beyond, links
    are shuffled by pair, and a pair that most texts hold is dealt out under ``salts`` numbers.
    """
    own = stored(aligned.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(own)
    links = own.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("__row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    if counts.count() <= broadcast_rows:
        met = links.join(F.broadcast(counts), "pair")
    else:
        each = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = links.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int")).join(each.hint("merge"), ["pair", "salt"])
    by_row = met.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.drop("pairs", "times").join(by_row, "__row", "left").select(*[c for c in aligned.columns if c not in ("pairs", "times")], zero("n_best"), zero("count_sum"))
