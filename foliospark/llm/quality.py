"""Quality rules with line labels.

Plain counts per text come first. Then each line with a word is one position of
a linear-chain conditional random field, whose Viterbi path marks it content or
boilerplate; the share of words in content lines decides retention.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain as chained

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm import crf
from foliospark.llm.shared import own_name, slices

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Words that mark site furniture, fixed values.
FURNITURE = frozenset("cookie cookies copyright login logout register subscribe newsletter privacy terms menu sitemap advertisement sponsored unsubscribe javascript click share tweet © reserved".encode().split())
WIDTHS = (6, 6, 5, 3, 4, 4, 2, 2, 2, 4)
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])
NONE, SPACE, LETTER, CAPITAL, SYMBOL, STOP, COMMA = range(7)
_CLASS = np.full(129, NONE, np.uint8)
_CLASS[128] = LETTER
for _chars, _kind in ((SPACES, SPACE), ("abcdefghijklmnopqrstuvwxyz", LETTER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", CAPITAL), (SYMBOLS, SYMBOL), (".!?", STOP), (",;:", COMMA)):
    _CLASS[[ord(c) for c in _chars]] = _kind
FEW, LETTERS, SIGNS, DISTINCT, CAPITALS, SPOILED = np.array([2, 4, 8, 16, 32]), np.array([0.3, 0.5, 0.7, 0.85, 0.95]), np.array([1e-9, 0.02, 0.08, 0.2]), np.array([0.3, 0.6, 0.85]), np.array([0.1, 0.3, 0.7]), np.array([0.1, 0.25, 0.6])
SIGNED = frozenset(SYMBOLS.encode())
#: Multipliers of a rolling hash over the words of a window, fixed odd values.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed += own[i : i + n] * MIX[i]
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order[1:]] == mixed[order[:-1]]
    if not equal.any():
        return 0
    again = np.zeros(n, bool)
    alike = np.flatnonzero(np.append(equal, False) | np.insert(equal, 0, False))
    found: dict[tuple[bytes, ...], int] = {}  # the words themselves decide; equal hashes only say where to look
    for i in order[alike].tolist():
        first = found.setdefault(tuple(words[i : i + window]), i)
        if first != i:
            again[[first, i]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measured(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a block of texts: their counts (texts x 5: words, their code points, symbols, repeated lines, repeated words)
    and, for all lines with a word, features, number of words, text number, and whether it is its text's first.
    """
    joined = "\n".join(texts)
    kind = _CLASS[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]
    lines = joined.split("\n")
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    of_text = np.repeat(np.arange(len(texts)), per_text)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)[:-1]])
    padded = np.append(kind, SPACE)  # an empty last line begins at the end
    sums = lambda flags: np.add.reduceat(flags.astype(np.int32), begins)
    solid, letters, capitals, symbols = sums(padded != SPACE), sums((padded == LETTER) | (padded == CAPITAL)), sums(padded == CAPITAL), sums(padded == SYMBOL)
    split = [line.encode("utf-8", "surrogatepass").split() for line in lines]
    n_words = np.fromiter(map(len, split), np.int64, len(lines))
    full = np.flatnonzero(n_words)
    counts = np.zeros((len(texts), 5), np.int64)
    for column, values in ((0, n_words), (1, solid), (2, symbols)):
        np.add.at(counts[:, column], of_text, values)
    seen_before = np.zeros(len(lines), bool)
    at = 0
    for i, k in enumerate(per_text.tolist()):
        seen: set[str] = set()
        for j in range(at, at + k):
            if n_words[j]:
                if lines[j] in seen:
                    seen_before[j] = True
                seen.add(lines[j])
        counts[i, 3] = seen_before[at : at + k].sum()
        counts[i, 4] = repeated_words(list(chained.from_iterable(split[at : at + k])))
        at += k
    own = [split[j] for j in full.tolist()]
    size = np.maximum(solid[full], 1)
    ends = np.fromiter((w[-1][-1] for w in own), np.int64, len(own)) if own else np.zeros(0, np.int64)
    last = _CLASS[np.minimum(ends, 128)]
    distinct = np.fromiter((len(set(w)) / len(w) for w in own), np.float64, len(own))
    site = {x for x in set(chained.from_iterable(own)) if x.lower().strip(b".,:!") in FURNITURE}  # as written in this block
    furniture = np.fromiter((not site.isdisjoint(w) for w in own), bool, len(own))
    barred = np.fromiter((b"|" in w or b"\xc2\xbb" in w or w[0].startswith(b"http") for w in own), bool, len(own))
    signed = {x for x in set(chained.from_iterable(own)) if not SIGNED.isdisjoint(x)}
    spoiled = np.fromiter((sum(map(signed.__contains__, w)) / len(w) for w in own), np.float64, len(own))
    columns = (
        np.searchsorted(FEW, n_words[full], side="right"), np.searchsorted(LETTERS, letters[full] / size, side="right"),
        np.searchsorted(SIGNS, symbols[full] / size, side="right"), np.where(last == STOP, 0, np.where(last == COMMA, 1, 2)),
        np.searchsorted(DISTINCT, distinct, side="right"), np.searchsorted(CAPITALS, capitals[full] / np.maximum(letters[full], 1), side="right"),
        seen_before[full], furniture, barred, np.searchsorted(SPOILED, spoiled, side="right"),
    )
    features = np.stack(columns, axis=1).astype(np.int64) + OFFSETS[:-1]
    place = of_text[full]
    return counts, features, n_words[full], place, np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)


#: The labelled table: texts whose lines begin with + (content) or - (boilerplate).
LABELLED = """
-Home | News | Sports | Contact
+The council met on Tuesday to discuss the new bridge across the river.
+Several members asked how the work would be paid for, and when it could begin.
+No date has been set.
-Share | Tweet | Print
-Copyright 2020 Example Media. All rights reserved.

-Menu
-Login | Register
+Chapter one
+It was a cold morning, and the streets were empty when she left the house.
+She walked for an hour without meeting anyone.
+"Where are you going?" asked the old man.
-Privacy | Terms | Cookies

-This site uses cookies. Click accept to go on.
+A new study shows that plants grow faster in the light of early spring, when days are getting longer and nights remain cold enough to slow down insects.
+The authors measured the height of more than two hundred plants in four gardens.
+Results differ between species, but the trend is clear:
+most plants gained a third in height within ten days.
-Subscribe to our newsletter

-### $$$ %%% ### *** &&&
-name | price | size | total
-12 | 40 | 33 | 85
-40 | 22 | 19 | 81
-### *** ### $$$ &&& %%%

-BUY NOW!! CHEAP!! BEST PRICE!! CLICK!!
-FREE!! FREE!! FREE!! FREE!!
-FREE!! FREE!! FREE!! FREE!!

+Das Wetter bleibt in den nächsten Tagen kühl, und in den Bergen fällt weiterer Schnee.
+Im Süden scheint zeitweise die Sonne.
+La ville a ouvert un nouveau musée, où les visiteurs peuvent voir des œuvres rares.
+El río creció tras las lluvias de la semana pasada y los vecinos dejaron sus casas.

-http://www.example.com/a/b/c
-http://www.example.com/a/b/d
-http://www.example.com/a/b/e

+In the first part we describe the method, and in the second part its limits.
+In the first part we describe the method, and in the second part its limits.
+Both are short.
+Re.
+The end.

-The%%% letter&&& was$$$ sent### on*** Monday,%%% but&&& nobody### opened*** it$$$ until&&& the%%% end### of$$$ the*** week.
-It%%% held&&& a$$$ key### and*** no%%% word&&& of$$$ thanks.###
-Later&&& that%%% month*** the### house$$$ was&&& sold,%%% and*** all### its$$$ doors&&& were%%% painted***

-Der### Brief&&& kam%%% am*** Montag,$$$ doch### niemand&&& öffnete$$$ ihn,*** bis%%% die### Woche&&& vorbei*** war.
-Später&&& wurde### das$$$ Haus%%% verkauft.***

-La&&& lettre### est%%% arrivée$$$ lundi,*** mais### personne&&& ne$$$ l'a%%% ouverte### avant*** la$$$ fin&&& de### la%%% semaine.
-Plus### tard,*** la&&& maison%%% fut$$$ vendue###

-La$$$ carta*** llegó&&& el### lunes,%%% pero$$$ nadie&&& la*** abrió### hasta%%% el&&& fin$$$ de### semana.
-Después%%% se### vendió*** la&&& casa$$$

-north | seven. | below | green | eleven, | paper
-colour, | made | weight. | order | stone | winter | glass. | thirty
-stock. | price

-Länge | Breite, | Farbe. | unten | elf | Papier | Stein. | Winter
-Glas | grün, | sieben | Norden. | Preis

-couleur | poids. | papier, | hiver | onze | vert | verre. | sept
-prix. | nord | dessous

-color | peso. | papel, | invierno | once | verde | vidrio. | siete
-precio | norte, | abajo.

+The price rose by 5 % to $40 & more was sold than in the year before.
+See section #3 of the *draft* for what C# and R&D have to do with it.
+Type a | b to send the result of the first program to the second one.
+Costs fell by 12 %, sales by 3 %, and wages by 1 % in the same time.

+Der Umsatz stieg um 5 % auf 40 $, Müller & Söhne blieben vorn.
+Ein Beispiel steht in Abschnitt #3, das Ergebnis in Tabelle 2.
+Les ventes ont augmenté de 5 % chez Martin & Fils, qui restent en tête.
+Las ventas subieron un 5 % en Pérez & Hijos, que siguen en cabeza.

+Dear Anna,
+thank you for your letter of the 3rd of May, which I received yesterday.
+I will come on Friday at 10, as you proposed
+Best wishes
+Peter
"""


@lru_cache(maxsize=1)
def model() -> crf.Chain:
    """The chain fitted to LABELLED; label 1 is content."""
    features, labels = [], []
    for block in LABELLED.strip().split("\n\n"):
        lines = block.split("\n")
        features.append(measured(["\n".join(x[1:] for x in lines)])[1])
        labels.append(np.array([int(x[0] == "+") for x in lines]))
    return crf.train(features, labels, int(OFFSETS[-1]), 2, decay=0.05)


def content_share(chain: crf.Chain, n: int, features: np.ndarray, n_words: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each of ``n`` texts the share of its words that lie in content lines; 0 without words."""
    if not len(place):
        return np.zeros(n)
    begins = np.flatnonzero(first)
    found = chain.decode(features, begins, np.diff(np.append(begins, len(place))))
    content, total = np.zeros(n), np.zeros(n)
    np.add.at(content, place, n_words * (found == 1))
    np.add.at(total, place, n_words)
    return content / np.maximum(total, 1)


def judge(df: DataFrame, key: str, text: str, min_words: int = 10, max_repeat_percent: int = 20, min_content: float = 0.3, block_chars: int = 1_000_000) -> DataFrame:
    """For each row: ``key``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated windows.
    Other texts are kept if ``min_content`` of their words lie in content lines. A null text has no words.
    Repeated rows give a row each, an empty table none. Other columns are ignored; a key with the name of a result is an
    error. Equal scores of labels go to boilerplate. Texts and lines are whole: memory is bounded by ``block_chars`` bytes
    of text, or by the longest text.
    """
    source = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    chain = model()  # fitted once, on the driver
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField(own_name(key, (*longs, "base_failed", "kept", "content_share")), df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__text")
            counts, shares = [np.zeros((0, 5), np.int64)], [np.zeros(0)]
            for a, b in slices([len(t.as_buffer()) if t.is_valid else 0 for t in column], block_chars):
                own, *lines = measured([column[i].as_py() or "" for i in range(a, b)])
                counts.append(own)
                shares.append(content_share(chain, b - a, *lines))
            all_counts, share = np.concatenate(counts), np.concatenate(shares)
            failed = (all_counts[:, 0] < min_words) | (100 * all_counts[:, 4] > max_repeat_percent * all_counts[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column("__key"), *(pa.array(c) for c in all_counts.T), pa.array(failed), pa.array(~failed & (share >= min_content)), pa.array(share)], schema.names)

    return source.mapInArrow(run, schema)
