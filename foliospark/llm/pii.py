"""Personal data: patterns for four kinds, and a conditional random field for more.

The patterns find e-mail addresses, IP addresses, card and phone numbers. A
linear-chain conditional random field over word shapes, trained from the small
table of ``pii_labels``, adds secrets (keys, tokens, passwords) and numbers of
papers and accounts. Shapes are computed for all words of a batch at once in
numpy, and Viterbi decodes all its lines at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm import crf
from foliospark.llm.pii_labels import LABELLED
from foliospark.llm.shared import give_back, slices

KINDS = ("email", "ip", "card", "phone")
LEARNED = ("secret", "id")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits, as it would have begun at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """As the pattern finds them from left to right; each ``@`` is looked at once, so long runs cost no more."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and LOCAL.match(text, begin - 1):
            begin -= 1
        if at >= free and begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """E-mail, IP, card and phone spans, kind by kind, each from left to right and without overlaps in its kind."""
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# --- word shapes -------------------------------------------------------------------------------------------------

#: Classes of characters: 0 white space, 1 lower, 2 upper, 3 digit, 4 hyphen, 5 equals or colon, 6 quote, 7 @ or /, 8 other ASCII, 9 beyond ASCII.
SPACE, LOWER, UPPER, DIGIT, HYPHEN, ASSIGN, QUOTE, PLACE, OTHER, BEYOND = range(10)
_CLASS = np.full(129, OTHER, np.uint8)
_CLASS[128] = BEYOND
for _chars, _kind in ((" \t\n\r\x0b\x0c", SPACE), ("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), ("-", HYPHEN), ("=:", ASSIGN), ("\"'`", QUOTE), ("@/", PLACE)):
    _CLASS[[ord(c) for c in _chars]] = _kind
#: What announces a secret, an id, or a public value, by its first letters. Fixed values.
CUES = (
    ("passw", "passphrase", "passcode", "pwd", "mot de passe", "contrase", "secret", "token", "apikey", "key", "bearer", "credential", "session", "auth"),
    ("ssn", "social security", "iban", "tax", "steuer", "passport", "account", "identity", "dni", "nif", "licence", "license", "insurance", "transfer", "pay ", "her number"),
    ("commit", "sha1", "sha-", "sha2", "md5", "checksum", "digest", "hash", "etag", "uuid", "guid", "revision", "build", "isbn", "issn", "doi", "version", "order", "invoice", "parcel", "tree", "parent", "request", "image", "http", "archive", "phone", "model", "part ", "flight"),
)
_CUE = re.compile("|".join(f"({'|'.join(c)})" for c in CUES).encode())


def _three(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number below 32,768 for the three signs from each place on, the same for upper and lower case."""
    padded = np.append(low, np.zeros(2, low.dtype)) & 31
    return (padded[at].astype(np.int64) << 10) | (padded[at + 1].astype(np.int64) << 5) | padded[at + 2]


#: Beginnings that makers of keys publish, with some signs after them. Fixed values.
_PREFIX = re.compile(rb"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|eyJ|hf_|npm_|pypi-)[A-Za-z0-9_-]{10}")
#: By the number of three signs: whether a cue or a known beginning may start so.
_STARTS = np.zeros(1 << 15, bool)
for _start in [c[:3] for kind in CUES for c in kind] + "AKI ASI ghp gho ghu ghs ghr git glp xox sk_ rk_ AIz eyJ hf_ npm pyp".split():
    _STARTS[_three(np.frombuffer(_start.encode(), np.uint8), np.zeros(1, np.int64))] = True
REACH = 4  # words from a cue to what it announces
#: Sizes of the features: length, share of digits, letters and digits there, changes between them, hyphens, first class, signs, word
#: before, cue before and how near, cue within, known beginning, hexadecimal letters only, letters and digits with cue and with length.
WIDTHS = (8, 6, 8, 5, 4, 10, 4, 3, 7, 4, 2, 3, 32, 64)
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])
LENGTH_STEPS, CHANGE_STEPS = np.array([2, 3, 5, 9, 13, 20, 32]), np.array([1, 2, 3, 6])


def shapes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (words x 8) of the words of ``text``, their starts and ends, and whether each begins a line."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _CLASS[np.minimum(codes, 128)]
    word = np.concatenate([[False], kind != SPACE, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros((0, len(WIDTHS)), np.int64), starts, ends, np.zeros(0, bool)
    sums = lambda flags: np.add.reduceat(flags, edges, dtype=np.int32)[::2] if edges[-1] < len(flags) else np.add.reduceat(np.append(flags, False), edges, dtype=np.int32)[::2]
    length, digit, lower, upper = ends - starts, sums(kind == DIGIT), sums(kind == LOWER), sums(kind == UPPER)
    alnum = np.where((kind == LOWER) | (kind == UPPER), 1, np.where(kind == DIGIT, 2, 0))
    change = np.zeros(len(kind), bool)
    change[1:] = (alnum[1:] != alnum[:-1]) & (alnum[1:] > 0) & (alnum[:-1] > 0)
    assign, hyphen = sums(kind == ASSIGN), sums(kind == HYPHEN)
    share = np.where(digit == 0, 0, np.where(digit == length, 5, 1 + np.minimum(3, 4 * digit // length)))
    newline = np.concatenate([[0], np.cumsum(codes == 10)])
    first = np.ones(len(starts), bool)
    first[1:] = newline[starts[1:]] > newline[ends[:-1]]
    assigned = np.zeros(len(starts), np.int64)  # 0: first of its line, 1: after a word, 2: after = or :
    assigned[1:] = 1 + (kind[ends[:-1] - 1] == ASSIGN)
    assigned[first] = 0
    has = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0)
    near, within, known = _cues(codes, kind, starts, ends, first)
    hexadecimal = sums(((codes >= 97) & (codes <= 102)) | ((codes >= 65) & (codes <= 70)))
    letters = lower + upper
    size = np.searchsorted(LENGTH_STEPS, length, side="right")
    columns = (
        size, share, has,
        np.searchsorted(CHANGE_STEPS, sums(change), side="right"), np.minimum(hyphen, 3), kind[starts],
        (assign > 0) + 2 * (sums(kind == PLACE) > 0), assigned,
        near, within, known, np.where(letters == 0, 0, np.where(letters == hexadecimal, 1, 2)), 8 * np.where(within > 0, within, (near + 1) // 2) + has, 8 * size + has,
    )
    return np.stack(columns, axis=1).astype(np.int64) + OFFSETS[:-1], starts, ends, first


def _cues(codes: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: the nearest cue in the ``REACH`` words before it on its line (0: none, else odd if in the word just
    before), the last cue that ends within it, and whether it holds a known beginning.
    """
    n = len(starts)
    signs = np.minimum(codes, 128).astype(np.uint8)
    within, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
    letter = (kind == LOWER) | (kind == UPPER)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    begins = np.flatnonzero(begins)
    begins = begins[_STARTS[_three(signs, begins)]]
    if len(begins):
        raw, low = signs.tobytes(), (signs + 32 * (kind == UPPER).astype(np.uint8)).tobytes()
        for at in begins.tolist():
            if m := _CUE.match(low, at):
                within[np.searchsorted(starts, m.end() - 1, side="right") - 1] = m.lastindex
            if _PREFIX.match(raw, at) and not (at and kind[at - 1] == DIGIT):
                known[np.searchsorted(starts, at, side="right") - 1] = 1
    index = np.arange(n)
    last = np.maximum.accumulate(np.where(within > 0, index, -1))
    before = np.concatenate([[-1], last[:-1]])
    fits = (before >= np.maximum.accumulate(np.where(first, index, 0))) & (index - before <= REACH)
    near = np.where(fits, 2 * within[before] - (index - before == 1), 0)
    return near, within, known


@lru_cache(maxsize=1)
def model() -> crf.Chain:
    """The chain fitted to LABELLED; labels: 0 none, then LEARNED in order."""
    features, labels = [], []
    for line in LABELLED.strip().split("\n"):
        marks, plain, at = [], "", 0
        for m in re.finditer(r"<(\w+):([^>]*)>", line):
            plain += line[at : m.start()]
            marks.append((len(plain), len(plain) + len(m[2]), 1 + LEARNED.index(m[1])))
            plain, at = plain + m[2], m.end()
        x, starts, ends, _ = shapes(plain + line[at:])
        features.append(x)
        labels.append(np.array([next((k for a, b, k in marks if a < e and s < b), 0) for s, e in zip(starts, ends, strict=True)]))
    return crf.train(features, labels, int(OFFSETS[-1]), 1 + len(LEARNED))


EDGE = re.compile(r"[A-Za-z0-9](?:.*[A-Za-z0-9])?", re.S)
DIGITS = re.compile("[0-9]")


def learned_spans(texts: list[str], chain: crf.Chain | None = None) -> list[list[Span]]:
    """Spans that the chain labels in each text. A secret is one word without signs around it, after its last = or :.
    Neighbouring words of an id, one blank apart, are one span; an id has a digit.
    """
    chain = chain or model()
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    features, starts, ends, first = shapes("\n".join(texts))
    out: list[list[Span]] = [[] for _ in texts]
    if not len(starts):
        return out
    begins = np.flatnonzero(first)
    found = chain.decode(features, begins, np.diff(np.append(begins, len(starts))))
    hits = np.flatnonzero(found)
    for at, i in zip(hits.tolist(), (np.searchsorted(offsets, starts[hits], side="right") - 1).tolist(), strict=True):
        start, end = int(starts[at] - offsets[i]), int(ends[at] - offsets[i])
        kind, word = LEARNED[found[at] - 1], texts[i][start:end].rstrip("=:")
        skip = max(word.rfind("="), word.rfind(":")) + 1
        if m := EDGE.search(word, skip):
            a, b, own = start + m.start(), start + m.end(), out[i]
            if own and kind == own[-1][0] == "id" and a == start and own[-1][2] == a - 1 and texts[i][a - 1] == " ":
                own[-1] = (kind, own[-1][1], b)
            else:
                own.append((kind, a, b))
    return [[s for s in own if s[0] != "id" or DIGITS.search(text, s[1], s[2])] for own, text in zip(out, texts, strict=True)]


def all_spans(base: list[Span], learned: list[Span]) -> list[Span]:
    """Base spans, and the learned ones that overlap none of them."""
    taken = sorted((a, b) for _, a, b in base)
    firsts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    more = []
    for kind, a, b in learned:
        i = int(np.searchsorted(firsts, b))  # base spans that begin before the end
        if i == 0 or reach[i - 1] <= a:
            more.append((kind, a, b))
    return [*base, *sorted(more, key=lambda s: (LEARNED.index(s[0]), s[1]))]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


OUTPUT = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked", "n_spans")


def find(df: DataFrame, text: str, keep: list[str], block_chars: int = 250_000) -> DataFrame:
    """The columns ``keep``, the number of base spans by kind, ``base_sha256`` (of the listed base spans), ``spans``
    (kind:start:end in code points, by kind, then start), ``masked``, the text with all spans masked, and ``n_spans``, how
    many there are, for each row.

    A null text is empty and stays null in ``masked``. Repeated rows give a row each, an empty table none.
    Kept columns with the names of results are replaced. Where learned spans meet base ones, the base ones stay; equal
    scores of labels go to no span, then to the secret. Texts are whole: memory is bounded by ``block_chars`` bytes of
    text, or by the longest text, and the random field sees each line whole. The chain is fitted once, on the driver.
    """
    names = [c for c in keep if c not in OUTPUT]
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(c, T.LongType() if c.startswith("n_") else T.StringType()) for c in OUTPUT)])

    chain = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__text")
            for a, b in slices([len(t.as_buffer()) if t.is_valid else 0 for t in column], block_chars):
                rows: list[tuple] = []
                raw = [column[i].as_py() for i in range(a, b)]
                texts = [t or "" for t in raw]
                for own, t, learned in zip(raw, texts, learned_spans(texts, chain), strict=True):
                    base = base_spans(t)
                    spans, listed = all_spans(base, learned), _listed(base)
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    rows.append((*counts, hashlib.sha256(listed.encode()).hexdigest(), _listed(spans), masked(own, spans) if spans else own, len(spans)))
                columns, kept = list(zip(*rows, strict=True)), batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), *(pa.array(c, pa.int64() if name.startswith("n_") else pa.string()) for name, c in zip(OUTPUT, columns, strict=True))], schema.names)
        give_back()

    return source.mapInArrow(run, schema)
