"""The pipeline's stages: what goes, what stays, and the columns; the whole of it against plain code."""

import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import regex
import xxhash
import zstandard
from pyspark.sql.functions import lit

from foliospark.llm import pii, queries, shared

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, SF)
    assert kept.columns == docs.columns and 0.9 * docs.count() < kept.count() <= docs.count()
    found = queries.op9(spark, SF)
    alone = stages["near_duplicates"](spark, docs, SF)
    assert alone.columns == docs.columns and {r["doc_id"] for r in alone.collect()} == {r["component_id"] for r in found.collect()}
    clean = stages["decontamination"](spark, docs, SF)
    bad = {r["doc_id"] for r in queries.op7(spark, SF).filter("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad and bad
    masked = stages["personal_data"](spark, docs, SF)
    assert masked.columns == docs.columns and all(len(r["text"]) == r["n_chars"] or "[" not in r["text"] for r in masked.collect())
    assert "@" not in " ".join(r["text"] for r in masked.filter("text LIKE '%[EMAIL]%'").collect()).replace(" @ ", "")


def test_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    some = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", docs["doc_id"] * 0 + None))
    alone = corpus_pipeline.near_duplicates(spark, some, SF).collect()
    assert sorted(r["doc_id"] for r in alone) == sorted({r["component_id"] for r in __import__("foliospark.llm.simhash", fromlist=["x"]).near_duplicates(docs, "doc_id", "text").collect()})


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "score double, lang_pred string, rejected boolean, fingerprint string, component_id long, n_words long, contaminated boolean, spans string, masked string, n_spans long, id long, fp long, start long"


def awkward_tables(spark, path, rows, bench):
    more = [f.split()[0] for f in CLASHES.split(", ")]
    docs = spark.createDataFrame([(*r, *[None] * len(more)) for r in rows], f"{COLUMNS}, {CLASHES}")
    values = {"score": 0.25, "lang_pred": "own", "rejected": False, "fingerprint": "own", "component_id": -1, "n_words": -2, "contaminated": True, "spans": "own", "masked": "own", "n_spans": 77, "id": -3, "fp": -4, "start": -5}
    docs = docs.select(*[docs[c] for c in docs.columns if c not in values], *[lit(v).cast(docs.schema[c].dataType).alias(c) for c, v in values.items()])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), values


def test_awkward_rows_in_every_stage(spark, tmp_path):
    english = "the quick brown fox jumps over the lazy dog and then it runs through the wood to the river where it drinks"
    german = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den wald an den fluss und trinkt dort"
    miller = "once upon a time there lived a miller by the brook who had three sons and a mill and a donkey and a cat but nothing else in the world"
    passage = "what is the name of the river that flows through the old town and into the northern sea"
    rows = [(1, f"{english} number {i}", "en", "s", 9) for i in range(3)] + [(10 + i, f"{german} {w}", "de", None, None) for i, w in enumerate(["eins", "zwei und drei"])]
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (22, "123 !!", "en", None, None), (None, english, None, None, None), (23, miller, "en", None, 5), (23, miller, "en", None, 5)]
    rows += [(30, passage, "en", "s", 1), (31, "write to anna@example.org about the house by the sea and the boat", "en", "s", 65), (32, f"{english} and more " * 900, "en", "s", 3)]
    docs, values = awkward_tables(spark, tmp_path, rows, [(1, passage), (None, passage), (2, None), (3, "")])
    assert docs.count() == len(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left = docs.collect()
        assert all(r[c] == v for r in left for c, v in values.items()), name
        keys = [r["doc_id"] for r in left]
        if name == "language":
            assert keys.count(23) == 2 and None in keys and not {20, 21, 22} & set(keys)
        if name == "near_duplicates":
            assert keys.count(23) == 1 and None not in keys and 30 in keys
        if name == "decontamination":
            assert 30 not in keys and 31 in keys
        if name == "personal_data":
            masked = next(r for r in left if r["doc_id"] == 31)
            assert "[EMAIL]" in masked["text"] and masked["n_chars"] == len(masked["text"])
            assert next(r for r in left if r["doc_id"] == 32)["n_chars"] == 3
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.filter("start = 0").collect()} == set(keys) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_texts_without_words_in_later_stages(spark, tmp_path):
    docs, _ = awkward_tables(spark, tmp_path, [(1, None, None, None, None), (2, "", None, None, None), (3, "?", None, None, None)], [(1, "")])
    stages = dict(corpus_pipeline.STAGES)
    assert stages["language"](spark, docs, str(tmp_path)).isEmpty()
    assert sorted(r["doc_id"] for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect()) == [1, 3]
    assert stages["decontamination"](spark, docs, str(tmp_path)).count() == 3
    assert {r["doc_id"]: r["text"] for r in stages["personal_data"](spark, docs, str(tmp_path)).collect()} == {1: None, 2: "", 3: "?"}
    assert stages["packing"](spark, docs, str(tmp_path)).count() == 3


def test_tables_of_many_identities_are_not_broadcast(spark, monkeypatch, capsys):
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (None, "c", 9)], "doc_id long, text string, id long")
    ids = docs.limit(2).select(corpus_pipeline._identity().alias("id"))
    plans = []
    for most in (300_000, 0):
        monkeypatch.setattr("foliospark.llm.shared.BROADCAST_ROWS", most)
        found = corpus_pipeline._matching(docs, ids, "left_anti")
        assert [tuple(r) for r in found.collect()] == [(None, "c", 9)]
        found.explain()
        plans.append("Broadcast" in capsys.readouterr().out)
    assert plans == [True, False]


def test_empty_tables(spark, tmp_path):
    awkward_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_only_results_stay_in_the_shared_folder(spark, tmp_path):
    def inside():
        return set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())

    awkward_tables(spark, tmp_path, [(i, f"the house number {i // 2} by the river and the old mill", "en", "s", 1) for i in range(6)], [(1, "one two")])
    before = inside()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.filter("start = 0").count() == 3  # short documents are cut to lengths that are powers of two
    assert sorted(p.name.rsplit("-", 1)[0] for p in inside() - before) == sorted(f"stage-{name}" for name, _ in corpus_pipeline.STAGES)


def test_working_tables_are_removed(spark):
    rows = spark.range(5)
    with shared.working_tables(spark, "outer") as outer:
        first = shared.stored(rows, "first")
        with pytest.raises(ZeroDivisionError), shared.working_tables(spark, "inner") as inner:
            second = shared.stored(rows, "second")
            assert inner.startswith(f"{outer}/") and second.count() == 5 and Path(inner).exists()
            raise ZeroDivisionError
        assert not Path(inner).exists() and first.count() == 5
        assert shared.shared_path(spark, "third").startswith(f"{outer}/")
    assert not Path(outer).exists() and not shared.shared_path(spark, "fourth").startswith(outer)
    with shared.working_tables(spark, "unused"):
        pass  # no table: nothing to remove
    assert shared.stored(rows, "kept").count() == 5


def known_language(text, profiles):
    if not text or not regex.search(r"\p{L}", text):
        return False
    raw = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip(" ").encode()
    level, sizes = profiles.level, []
    most = max(map(len, profiles.samples.values()))
    for sample in profiles.samples.values():
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=profiles.block, dict_size=most, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        words = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(dict_data=words, compression_params=params)
        sizes.append(sum(len(coder.compress(raw[i : i + profiles.block])) for i in range(0, len(raw), profiles.block)))
    best, second = sorted(sizes)[:2]
    return second - best > profiles.min_margin * second


def simhash_bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each_group(docs):
    prints, root = {k: simhash_bits(t) for k, t in docs.items()}, {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: t for k, t in docs.items() if find(k) == k}


def spoiled(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hit = {j for n, known in windows.items() for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in known for j in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(words)


def without_personal_data(text):
    base = pii.base_spans(text)  # held against plain patterns in test_operators
    spans = base + [s for s in pii.learned_spans([text])[0] if all(s[2] <= a or b <= s[1] for _, a, b in base)]
    out, at = "", 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_run_against_plain_code(spark):
    from tokenizers import Tokenizer

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = queries.profiles(frame)
    docs = {r["doc_id"]: r["text"] or "" for r in frame.select("doc_id", "text").collect()}
    docs = one_of_each_group({k: t for k, t in docs.items() if known_language(t, profiles)})
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        n = min(13, len(words))
        windows[n] |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1) if n}
    docs = {k: without_personal_data(t) for k, t in docs.items() if not spoiled(t, windows)}
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        own = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for rows, size in [(pieces[k], len(ids)) for k, ids in want.items()] + [(rows, sum(n for _, n in rows)) for rows in sequences.values()]:
        ends = np.cumsum([n for _, n in sorted(rows)])
        assert [a for a, _ in sorted(rows)] == [0, *ends[:-1]] and ends[-1] == size
    sizes = [sum(n for _, n in rows) for rows in sequences.values()]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes) and sum(sizes) == sum(map(len, want.values()))
