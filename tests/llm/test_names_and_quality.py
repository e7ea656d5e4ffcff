"""Keys that bear a result's name; the quality query's verdicts against plain code; hot wording in benchmarks."""

import re
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import decontaminate, nnls_pack, quality, queries, simhash

SF = "/root/testdata/sf0.001"


def test_keys_with_the_name_of_a_result(spark):
    docs = spark.createDataFrame([(1, "some words")], "k long, text string")
    calls = {
        "start": lambda d, k: nnls_pack.pack(d, k, "text", queries.tokenizer_path()),
        "n_words": lambda d, k: quality.judge(d, k, "text"),
        "fp": lambda d, k: simhash.near_duplicates(d, k, "text"),
        "n_hit": lambda d, k: decontaminate.scan(d, k, "text", d, k, "text"),
    }
    for name, call in calls.items():
        with pytest.raises(ValueError, match="name of a result"):
            call(docs.withColumnRenamed("k", name), name)
        other = docs.selectExpr("k", "text", "1 AS n_words", "2 AS start", "3 AS fp", "4 AS n_hit", "5 AS ids")
        assert call(other, "k").first()["k"] == 1


def line_features(text):
    """Features of the lines with a word, as the labelled table's model sees them, one line at a time."""
    seen, out = set(), []
    bucket = lambda v, steps: sum(v >= s for s in steps)
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            continue
        solid = "".join(words)
        letters = [c for c in solid if re.fullmatch(r"[A-Za-z]|[^\x00-\x7f]", c)]
        capitals = [c for c in solid if re.fullmatch("[A-Z]", c)]
        signs = [c for c in solid if c in quality.SYMBOLS]
        last = 0 if solid[-1] in ".!?" else 1 if solid[-1] in ",;:" else 2
        furniture = any(w.encode().lower().strip(b".,:!") in quality.FURNITURE for w in words)
        barred = "|" in words or "»" in words or words[0].startswith("http")
        values = [bucket(len(words), quality.FEW), bucket(len(letters) / len(solid), quality.LETTERS), bucket(len(signs) / len(solid), quality.SIGNS), last, bucket(len(set(words)) / len(words), quality.DISTINCT), bucket(len(capitals) / max(1, len(letters)), quality.CAPITALS), int(line in seen), int(furniture), int(barred), bucket(sum(any(c in quality.SYMBOLS for c in w) for w in words) / len(words), quality.SPOILED)]
        seen.add(line)
        out.append(([int(o) + v for o, v in zip(quality.OFFSETS, values, strict=False)], len(words)))
    return out


def verdict(text, chain):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    best = None
    lines = line_features(text)
    for features, _ in lines:
        emit = [sum(chain.weights[f][y] for f in features) for y in (0, 1)]
        if best is None:
            best = [(chain.first[y] + emit[y], [y]) for y in (0, 1)]
        else:
            best = [max(((s + chain.step[p[-1]][y] + emit[y], [*p, y]) for s, p in best), key=lambda z: z[0]) for y in (0, 1)]
    path = max(best, key=lambda z: z[0])[1] if best else []
    share = sum(n for y, (_, n) in zip(path, lines, strict=True) if y) / max(1, sum(n for _, n in lines))
    return failed, not failed and share >= 0.3, share


def test_quality_verdicts_against_plain_code(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    long = "word " * 5_000
    more = [(-1, None), (-2, ""), (-3, " \n \n"), (-4, "one two three four five six seven eight nine ten eleven twelve " + "LOGIN."), (-5, long + "login"), (-6, "\n".join(f"{i} | {i + 1} | {i * 7}" for i in range(40))), (-7, "éé\x1cé üü\x85ü " * 8)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op10(spark, str(tmp_path)).collect()}
    chain = quality.model()
    assert set(got) == set(texts)
    for key, text in texts.items():
        failed, kept, share = verdict(text, chain)
        assert (got[key]["base_failed"], got[key]["kept"]) == (failed, kept), key
        assert abs(got[key]["content_share"] - share) < 1e-9, key


def test_furniture_at_word_5_000(spark):
    line = " ".join(f"w{i}" for i in range(4_999))
    features = quality.measured([f"{line} LOGIN", f"{line} LOGGING"])[1][:, 7] - quality.OFFSETS[7]
    assert features.tolist() == [1, 0]


def test_wording_that_all_items_share(spark):
    template = " ".join(f"please{i} read{i} the text below" for i in range(10))
    items = [(i, f"{template} item{i} " + " ".join(f"x{i}y{j}" for j in range(15))) for i in range(300)]
    docs = spark.createDataFrame([(1, f"here {template} and no more"), (2, "none of it"), (3, items[7][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.fingerprints(bench, "item_id", "text")[0].filter("size(items) = 300").count() >= 1
    for most in (300_000, 0):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.scan(docs, "doc_id", "text", bench, "item_id", "text", broadcast_rows=most).collect()}
        assert got == {1: (50, 300), 2: (0, 0), 3: (66, 300)}
    empty = decontaminate.scan(docs, "doc_id", "text", bench.limit(0), "item_id", "text").collect()
    assert len(empty) == 3 and not any(r["contaminated"] for r in empty)


def test_equal_hashes_are_not_enough(monkeypatch):
    monkeypatch.setattr(quality, "MIX", np.zeros(5, np.uint64))  # all windows have the same hash
    words = [b"a", b"b", b"c", b"d", b"e", b"x", b"a", b"b", b"c", b"d", b"e", b"y"]
    assert quality.repeated_words(words) == 10 and quality.repeated_words([b"%d" % i for i in range(40)]) == 0


@pytest.mark.parametrize("text, kept", [
    ("Das%%% ist&&& ein$$$ Satz### mit*** vielen%%% Zeichen&&& und$$$ ohne### Sinn.", False), ("one | two. | three, | four | five. | six\nseven | eight, | nine | ten. | eleven", False),
    ("She paid 5 % more than the $40 that A & B had asked for in the spring.", True), ("La maison #3 de Martin & Fils se trouve au bout de la rue, près du pont.", True),
])
def test_signs_in_running_text(spark, text, kept):
    assert quality.judge(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first()["kept"] == kept


def test_learned_verdict_on_labelled_documents(spark):
    """Documents of which labelled lines were not taken: crc32 of the id is odd."""
    found = queries.op10(spark, SF).filter("NOT base_failed AND crc32(CAST(doc_id AS STRING)) % 2 = 1").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["n"] for r in found.groupBy("quality", "kept").count().withColumnRenamed("count", "n").collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.25 * (n.get((0, True), 0) + n.get((0, False), 1))
