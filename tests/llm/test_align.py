"""Token alignment against plain code over all pairs of tokens, on odd texts and a test table."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import align, queries

BYTE_BPE, PIECES = queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.PIECES)
ODD = ["one two  three   four\n\n five\n  six\tseven \t eight \n", " lead and trail ", "   ", "\n", "\t\tx", "a\r\nb\r c", "no\xa0break　wide  em", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ under▁line", "naïve façade ﬁ é Å", "日本語のテキスト 🙂🏽 x", "\x00\x01 \x1c \x85", "don't we'll I'M 12345 3.14", "x" * 3000, "word " * 4000, "code();\n\treturn {\n}\r\n", "a b ​ c", "‮ mixed ﷽", "", None, "same text", "same text"]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def one(text):
        """Groups and links of one text, by comparing the byte ranges of all tokens."""
        if not text:
            return [], [], 0, 0
        whole = (" " + text).encode()
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ta) != whole or b"".join(tb) != whole:
            return [], [], 0, 0
        spans = []
        for ids, parts in ((ia, ta), (ib, tb)):
            at, own = 0, []
            for i, p in zip(ids, parts, strict=True):
                own.append((at, at + len(p), i))
                at += len(p)
            spans.append(own)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for s, e, i in side if begin <= s and e <= end) for side in spans))
            begin = end
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        return groups, links, len(ia), len(ib)

    def table(texts):
        found = [one(t) for t in texts]
        count = Counter(p for _, links, _, _ in found for p in set(links))
        most = defaultdict(int)
        for (x, _), n in count.items():
            most[x] = max(most[x], n)
        return [(na, nb, len(g), len(ln), sum(count[p] == most[p[0]] for p in ln), sum(count[p] for p in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for g, ln, na, nb in found]

    return table


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, source int, lang string").repartition(3)
    made = align.align(docs, "doc_id", "text", BYTE_BPE, PIECES, block_chars=500)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    found = align.with_counts(made.select("*", digest), **kw)
    assert {"pairs", "times"}.isdisjoint(found.columns)
    return [tuple(r[c] for c in COLUMNS) for r in sorted(found.collect(), key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("kw", [{}, {"broadcast_rows": 0, "salts": 3}])
def test_same_as_all_pairs(spark, plain, kw):
    texts = [t if t is None or len(t) < 2000 else t[:600] for t in ODD]
    want = plain(texts)
    assert rows_of(spark, texts, **kw) == want
    assert want[18] == want[19] == (0, 0, 0, 0, 0, 0, "") == want[8] and want[20] == want[21] and want[0][0] > 10


def test_words_are_the_text(plain):
    aligner = align.Aligner(BYTE_BPE, PIECES)
    assert aligner.by_word
    for text in ODD:
        if text:
            sizes, groups, pairs, times = aligner.align([text])[0]
            other = aligner._alone(text)
            assert sizes.tolist() == other[0].tolist() and groups == other[1] and pairs.tolist() == other[2].tolist() and times.tolist() == other[3].tolist() and times.sum() == sizes[3]


def test_table_starts_anew(spark):
    small, large = align.Aligner(BYTE_BPE, PIECES, most_links=20), align.Aligner(BYTE_BPE, PIECES)
    texts = [f"word{i} and more text {i * i}" for i in range(60)]
    for t in texts:
        a, b = small.align([t])[0], large.align([t])[0]
        assert a[1] == b[1] and a[2].tolist() == b[2].tolist()
    assert len(small.words) < len(large.words)


def test_empty_table_clashing_key_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, "some words", "x")], "k string, text string, `pairs` string")
    assert align.with_counts(align.align(docs, "k", "text", BYTE_BPE, PIECES)).first()["k"] is None
    assert align.with_counts(align.align(docs.limit(0), "k", "text", BYTE_BPE, PIECES)).count() == 0
    with pytest.raises(ValueError, match="name of a result"):
        align.align(docs, "pairs", "text", BYTE_BPE, PIECES)


def test_query(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    short = [r for r in docs if len(r["text"] or "") < 3000]  # plain code compares all pairs
    found = {r["doc_id"]: r for r in queries.op12(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs) and len(short) > 100
    own = plain([r["text"] for r in short])
    for r, want in zip(short, own, strict=True):
        assert tuple(found[r["doc_id"]][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == (*want[:4], want[6])
