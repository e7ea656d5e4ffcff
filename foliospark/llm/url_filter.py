"""URL filter: glob rules as a bit-parallel wildcard automaton.

Every rule becomes a row of automaton states; all rules lie side by side in a
few 64-bit words. One step takes one byte of the URL: states shift by one
(with the carry from word to word), stay if the byte fits a state's own loop,
and are masked with the states that the byte may reach. So all rules run at
once, and numpy runs many URLs at once, as many as ``MOST_WORDS`` words of
state allow. URLs with no state left, or only with final states that any rest
of the URL fits, leave the walk. The few longest URLs go on with their state as
one Python integer, which takes less time a byte.

A rule's pattern is matched against ``.host/path``: ``*`` fits any bytes but
``/``, ``**`` any bytes, every other byte itself. Domain rules take the URL as it
stands, globs its canonical form, so that one spelling of a pattern is enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block; ``name`` is what a match reports, None for patterns that only judge."""

    pattern: str
    verdict: str
    name: str | None = None
    rank: int = 0
    canonical: bool = True

    @staticmethod
    def domain(verdict: str, name: str) -> Rule:
        """``host/path``: the host, all its subdomains, and paths that start with that path. The longest such rule wins."""
        host, slash, path = name.partition("/")
        return Rule(f"*.{host}{slash}{path}**", verdict, name, 1_000 + len(name), canonical=False)

    @staticmethod
    def word(verdict: str, word: str) -> list[Rule]:
        """The word between dots or hyphens of the host."""
        return [Rule(f"*{a}{word}{b}*{end}", verdict) for a in ".-" for b in ".-" for end in ("", "/**")]


# What judges URLs that no domain rule fits.
SPAM_WORDS = "spam casino poker jackpot cheap-pills viagra cialis payday-loan replica-watch porn xxx-video warez torrent".split()
TRACKERS = "doubleclick googlesyndication adserver adservice adnxs scorecardresearch".split()
MACHINE_PATHS = "/wp-login.php /wp-admin/ /xmlrpc.php /cgi-bin/ /phpmyadmin /.git/ /.env".split()
BINARY_ENDINGS = ".exe .msi .apk .dmg .iso .zip .rar .7z .tar.gz .mp3 .mp4 .avi .jpg .jpeg .png .gif .css .js".split()
DEFAULT_RULES = (
    *(rule for w in SPAM_WORDS for rule in Rule.word("block", w)),
    *(Rule(f"*.{t}.**", "block") for t in TRACKERS),
    *(Rule(f"**{p}**", "block") for p in MACHINE_PATHS),
    *(Rule(f"**/**{e}", "block") for e in BINARY_ENDINGS),
)
#: Words of state that numpy holds at once, and how many URLs of a batch go on as integers.
MOST_WORDS, FEW = 1 << 18, 8


def rules_of(table: DataFrame, most: int = 100_000) -> list[Rule]:
    """Rules from a table with ``kind`` (domain or glob), ``pattern`` and ``verdict``, in order of kind, pattern and verdict.

    Rules are settings, so they come to the driver; more than ``most`` are an error. Repeated rows count once, null ones not.
    """
    rows = table.select("kind", "pattern", "verdict").dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    wrong = [r for r in rows if r["kind"] not in ("domain", "glob") or r["verdict"] not in ("allow", "block")]
    if wrong:
        raise ValueError(f"no rule: {wrong[0]}")
    return [Rule.domain(r["verdict"], r["pattern"]) if r["kind"] == "domain" else Rule(r["pattern"], r["verdict"]) for r in sorted(rows)]


#: Escapes of letters, digits and ``-._~``, which stand for themselves.
_PLAIN = re.compile(r"%(?:2[de]|3\d|[46][1-9a-f]|[57][0-9a]|5f|7e)", re.I)
_PORT = re.compile(r":(?:80|443)?$")


def canonical(host: str, path: str) -> str:
    """``.host/path`` as globs see it: without user, default port and dots at the host's end, in small letters, escapes of plain characters
    decoded (once), and ``.`` and ``..`` steps of the path taken.
    """
    host = _PORT.sub("", host.rpartition("@")[2]).rstrip(".")
    path = _PLAIN.sub(lambda m: chr(int(m[0][1:], 16)), path).lower()
    if "/." in path:
        steps: list[str] = []
        own = path.split("/")[1:]
        for step in own:
            if step == "..":
                del steps[-1:]
            elif step != ".":
                steps.append(step)
        path = "".join("/" + s for s in steps) + ("/" if own[-1] in (".", "..") else "")
    return f".{host.lower()}{path}"


class Automaton:
    """The rules' states, packed into 64-bit words. Bit i is the state after the i-th pattern byte."""

    def __init__(self, rules: list[Rule]):
        self.rules = list(rules)
        steps: list[tuple[int, str]] = []  # byte (-1: none, the start of a pattern) and the loop of the state after it
        self.first: list[int] = []
        self.last: list[int] = []
        for rule in self.rules:
            self.first.append(len(steps))
            steps.append((-1, ""))
            raw, i = rule.pattern.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    steps[-1], i = (steps[-1][0], "any"), i + 2
                elif raw[i : i + 1] == b"*":
                    steps[-1], i = (steps[-1][0], steps[-1][1] or "host"), i + 1
                else:
                    steps.append((raw[i], ""))
                    i += 1
            self.last.append(len(steps) - 1)
        self.words = (len(steps) + 63) // 64
        reach, stay = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        for i, (byte, loop) in enumerate(steps):
            if byte >= 0:
                reach[byte, i] = True
            if loop:
                stay[:, i] = True
                stay[ord("/"), i] = loop == "any"
        pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view("<u8").reshape(*bits.shape[:-1], self.words)
        begin = np.zeros(self.words * 64, bool)
        begin[self.first] = True
        final = np.zeros(self.words * 64, bool)
        final[[i for i in self.last if steps[i][1] == "any"]] = True
        self.reach, self.stay, self.begin, self.open = pack(reach), pack(stay), pack(begin), ~pack(final)
        self.whole: list[tuple[int, int]] = []  # reach and stay by byte as integers, made when needed

    def match(self, urls: list[bytes]) -> np.ndarray:
        """For each URL, the number of the first rule (in the order of ``rules``) that fits the whole URL, else -1."""
        out = np.full(len(urls), -1, np.int64)
        if self.rules:
            step = max(1, MOST_WORDS // self.words)
            order = np.argsort([-len(u) for u in urls], kind="stable")
            for a in range(0, len(urls), step):
                own = order[a : a + step]
                out[own] = self._first(self._walk([urls[i] for i in own]))
        return out

    def _first(self, states: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(states.view(np.uint8), axis=1, bitorder="little")[:, self.last]
        return np.where(bits.any(1), bits.argmax(1), -1)

    def _walk(self, urls: list[bytes]) -> np.ndarray:
        """The states at the end of each URL; URLs come longest first."""
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        flat = np.frombuffer(b"".join(urls) + b"\0", np.uint8)
        at, states = np.cumsum(lengths) - lengths, np.tile(self.begin, (len(urls), 1))
        rows = np.arange(len(urls))  # those on the way, longest first
        t = 0
        while len(rows := rows[: np.searchsorted(-lengths[rows], -t, side="left")]) > FEW:
            own = states[rows]
            for t in range(t, min(t + 16, int(lengths[rows[-1]]))):
                byte = flat[at[rows] + t]
                shifted = own << np.uint64(1)
                shifted[:, 1:] |= own[:, :-1] >> np.uint64(63)
                own = (shifted & self.reach[byte]) | (own & self.stay[byte])
            t += 1
            states[rows] = own
            rows = rows[(own & self.open).any(1)]
        for i in rows.tolist():
            states[i] = self._rest(states[i], urls[i], t)
        return states

    def _rest(self, state: np.ndarray, url: bytes, at: int) -> np.ndarray:
        if not self.whole:
            self.whole = [(int.from_bytes(r.tobytes(), "little"), int.from_bytes(s.tobytes(), "little")) for r, s in zip(self.reach, self.stay, strict=True)]
        open_, now = int.from_bytes(self.open.tobytes(), "little"), int.from_bytes(state.tobytes(), "little")
        for byte in url[at:]:
            reach, stay = self.whole[byte]
            now = ((now << 1) & reach) | (now & stay)
            if not now & open_:
                break
        return np.frombuffer(now.to_bytes(8 * self.words, "little"), "<u8")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and path up to ``?`` or ``#``; both empty for null or without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(df: DataFrame, url: str, rules: list[Rule]) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    The matching rule of the highest rank decides (equal ranks: the earlier one); ``rule`` is its name. Globs see the
    ``canonical`` URL, domain rules ``host`` and ``path`` as they are returned.
    No match: allow. A null URL, or one without ``://``, has empty host and path; only
    patterns for the empty host could block it. Columns of ``df`` with those names are replaced.
    Repeated rows give a row each, an empty table none. URLs are judged whole, however long; memory is
    bounded by ``MOST_WORDS`` or by one URL and one state.
    """
    host, path = host_and_path(F.col("__url"))
    names = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parted = df.withColumn("__url", F.col(f"`{url}`")).select(*[F.col(f"`{c}`") for c in names], host.alias("host"), path.alias("path"))
    schema = T.StructType([*parted.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = sorted(rules, key=lambda r: -r.rank)
        order = [[i for i, r in enumerate(by_rank) if r.canonical == c] for c in (False, True)]
        raw, globs = (Automaton([by_rank[i] for i in own]) for own in order)
        number = [np.array([*own, len(by_rank)]) for own in order]  # no match: behind all rules
        for batch in batches:
            pairs = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            found = np.minimum(number[0][raw.match([f".{h}{p}".encode() for h, p in pairs])], number[1][globs.match([canonical(h, p).encode() for h, p in pairs])])
            own = [by_rank[i] if i < len(by_rank) else None for i in found.tolist()]
            named = pa.array([r and r.name for r in own], pa.string())
            verdicts = pa.array([r.verdict if r else "allow" for r in own], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, named, verdicts], [*batch.schema.names, "rule", "verdict"])

    return parted.mapInArrow(run, schema)
