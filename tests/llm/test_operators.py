"""Each operator on awkward rows, and against plain code."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import components, crf, decontaminate, html_extract, langid, nnls_pack, pii, quality, queries, simhash, token_bins, tokens, url_filter, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, kept boolean"
LONG = "alpha beta gamma delta " * 5000


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, very long and repeated rows, and columns with the names of results."""
    rows = [(1, None, None, None, None), (None, "the cat sat on the mat and the dog ran over the hill again", "en", "s", 1), (2, "", "en", None, 0), (3, LONG, "en", "s", None), (4, "write to a.b@c.org now, please, as soon as you can do it", None, "s", 5), (4, "write to a.b@c.org now, please, as soon as you can do it", None, "s", 5), (5, "12 34 !!", "fr", "s", 8)]
    return spark.createDataFrame([(*r, None, "x", None) for r in rows], SCHEMA)


def test_awkward_rows_and_empty_tables(spark, awkward):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma delta alpha beta"), (2, None), (None, "cat sat"), (3, "")], "item_id bigint, text string")
    tokenizer = queries.tokenizer_path()
    profiles = queries.profiles(awkward)
    for docs, n in ((awkward, 7), (awkward.limit(0), 0)):
        assert langid.predict(docs, "text", profiles, docs.columns).count() == n
        assert pii.find(docs, "text", docs.columns).count() == n
        assert quality.judge(docs, "doc_id", "text").count() == n
        assert simhash.near_duplicates(docs, "doc_id", "text").count() == n
        assert decontaminate.scan(docs, "doc_id", "text", bench, "item_id", "text").count() == n
        packed = nnls_pack.pack(docs, "doc_id", "text", tokenizer)
        assert packed.filter("start = 0").count() == n
        assert token_bins.segments(token_bins.write_bins(docs, "doc_id", "text", tokenizer), "doc_id").filter("start = 0 AND position_reset").count() == n
    found = {r["n_words"]: r for r in decontaminate.scan(awkward, "doc_id", "text", bench, "item_id", "text").collect()}
    assert found[20000]["contaminated"] and found[20000]["n_hit"] == 19998
    assert found[14]["n_hit"] == 2 and found[14]["n_items"] == 0 and found[14]["contaminated"]
    assert pii.find(awkward, "text", ["doc_id"]).filter("doc_id = 4").first()["masked"] == "write to [EMAIL] now, please, as soon as you can do it"
    assert langid.predict(awkward, "text", profiles, ["doc_id"]).filter("doc_id = 5").first()["lang_pred"] == "und"


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "https://A.Example.NET?x", "<p>same"), (None, "http://x.org/fr/", "<p>same"), (5, "ftp://b.net/", "<p>same")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, "url", queries.URL_RULES).collect()}
    assert (got[1]["host"], got[1]["path"], got[2]["verdict"]) == ("", "", "allow")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("a.example.net", "", None) and got[5]["rule"] == "net/" and got[None]["rule"] == "org/fr/"
    assert html_extract.extract(pages, "html", ["page_id"]).count() == 5 and html_extract.extract(pages.limit(0), "html", ["page_id"]).count() == 0
    read = {r["key"]: r for r in warc.read(warc.write(pages, "page_id", "url", "html")).collect()}
    assert read[2]["refers_to"] == 1 and read[5]["refers_to"] == 3 and read[None]["refers_to"] == 3 and read[3]["payload"] == b"<p>same"
    assert warc.read(warc.write(pages.limit(0), "page_id", "url", "html")).count() == 0


def test_smallest_language_sets_the_size_of_profiles(spark):
    rows = [(i, "abcdefgh "[i % 7 :] * 200, lang) for i, lang in [*((i, "aa") for i in range(40)), *((i, "bb") for i in range(40, 60)), (90, "xx")]]
    docs = spark.createDataFrame([*rows, (91, "mistyped", "e n")], "doc_id long, text string, lang string")
    sizes = lambda df, **kw: {k: len(v) for k, v in langid.fit(df, "text", "lang", "doc_id", F.lit(True), **kw).samples.items()}
    assert sizes(docs) == sizes(docs, floor_bytes=8_000) and sizes(docs)["aa"] == sizes(docs)["bb"] == 8_000 and sizes(docs)["e n"] == 8
    assert set(sizes(docs, floor_bytes=0).values()) == {8}
    assert sizes(docs, floor_bytes=12_000)["aa"] == 12_000


def test_positions_are_checked_to_the_end(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine")], "doc_id long, text string").coalesce(1)
    bins = token_bins.write_bins(docs, "doc_id", "text", queries.tokenizer_path())
    good = token_bins.segments(bins, "doc_id").orderBy("offset").collect()
    assert len(good) == 2 and all(r["position_reset"] and r["length"] > 2 for r in good)
    at = good[1]["offset"] + good[1]["length"] - 1  # the last position of the second segment
    spoil = F.expr(f"concat(substring(positions, 1, {2 * at}), X'0000', substring(positions, {2 * at + 3}, 1000000))")
    assert [r["position_reset"] for r in token_bins.segments(bins.withColumn("positions", spoil), "doc_id").orderBy("offset").collect()] == [True, False]


def test_positions_of_more_than_16_bits(spark):
    docs = spark.createDataFrame([(1, LONG * 4), (2, "one two")], "doc_id long, text string").coalesce(1)
    bins = token_bins.write_bins(docs, "doc_id", "text", queries.tokenizer_path(), limit=70_000)
    found = token_bins.segments(bins, "doc_id", limit=70_000).collect()
    assert max(r["length"] for r in found) == 70_000 and len(found) > 2 and all(r["position_reset"] for r in found)
    with pytest.raises(Exception, match="a longer limit"):
        token_bins.segments(bins, "doc_id").collect()


def test_packing_is_lossless(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in docs}
    import zlib

    for rows, sizes in ((queries.op3(spark, SF).collect(), True), (queries.op5(spark, SF).collect(), False)):
        parts, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            parts[r["doc_id"]].append((r["start"], r["length"]))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            ids = want[r["doc_id"]]
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(own.astype("<u4" if sizes else "<u2").tobytes())
        for key, ids in want.items():
            at = 0
            for start, n in sorted(parts[key]):
                assert start == at
                at += n
            assert at == len(ids)
        for pieces in sequences.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 2048 and (not sizes or at & (at - 1) == 0)


def test_nnls_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((6, 4)), rng.random(6)
        x = nnls_pack.nnls(a, b)
        best = min(np.linalg.norm(a[:, s] @ np.maximum(np.linalg.lstsq(a[:, s], b, rcond=None)[0], 0) - b) for s in ([i for i in range(4) if m >> i & 1] for m in range(1, 16)))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= best + 1e-8


def test_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["", "it's don't 'S <|endoftext|> x", "Éa ÉÀ ﬁ ΣΑΣ á İ ŉ ſ ß × 12x3, 你好 a\x1cb c", "a\x0bb\x0cc d’e «f» ª µ"]
    ids, bounds = tokens.Encoder(path).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    from itertools import product

    emit, step, first = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = crf.viterbi(emit, np.array([0, 4, 5]), np.array([4, 1, 4]), step, first)
    for a, n in ((0, 4), (4, 1), (5, 4)):
        score = lambda p: first[p[0]] + sum(emit[a + i, y] for i, y in enumerate(p)) + sum(step[x, y] for x, y in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert tuple(got[a : a + n]) == max(product(range(3), repeat=n), key=score)


def test_tree_marginals_against_enumeration():
    from itertools import product

    nodes = html_extract.parse("<div><p>one <b>two</b></p><ul><li>x</li></ul></div>").nodes
    rng = np.random.default_rng(5)
    w, pairs = rng.normal(size=html_extract.N_FEATURES).tolist(), rng.normal(size=(3, 2, 2)).tolist()
    full, _, _ = html_extract.beliefs(nodes, w, pairs)
    total, on = 0.0, [0.0] * len(nodes)
    for ys in product((0, 1), repeat=len(nodes) - 1):
        y = (0, *ys)
        p = np.exp(sum(y[i] * sum(w[f] for f in n.features) + pairs[html_extract.group(n.tag)][y[n.parent]][y[i]] for i, n in enumerate(nodes) if i))
        total += p
        on = [a + p * b for a, b in zip(on, y, strict=True)]
    assert np.allclose([html_extract._odds(x) for x in full[1:]], [a / total for a in on[1:]])


def test_main_text_of_pages(spark):
    import html

    def article(page):
        body = page.partition("<article>")[2].partition("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", body))]
        return "\n".join(b for b in blocks if b)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert all(r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in queries.op4(spark, SF).collect())


def test_tags_with_open_quotes():
    fitted, line = html_extract.model(), "The council met on Tuesday to discuss it all."
    assert html_extract.main_text(f'<article><h1>Title</h1><p>{line} <a href="x', fitted) == f"Title\n{line}"
    assert html_extract.main_text(f"<article><h1>Title</h1><p title=don't>{line}</p></article>", fitted) == f"Title\n{line}"
    assert html_extract.main_text(f"<article><h1>Title</h1><p>{line} 1 < 2</p></article>", fitted) == f"Title\n{line} 1 < 2"


@pytest.mark.parametrize("tag", ["button", "select", "svg", "object", "template", "noscript"])
def test_controls_left_open(tag):
    fitted = html_extract.model()
    nav, line, more = "<nav><ul><li><a href=/a>News</a></li></ul>", "The council met on Tuesday to discuss the new bridge.", "It is to be built by the end of next year."
    inside = {"select": "<option>One<option>Two</option>", "svg": "<title>Icon<path d=x>", "noscript": "<b>Menu</b>"}.get(tag, "Menu")
    page = lambda a="", b="", c="", d="": f"<body>{nav}{a}</nav>{b}<article><h1>Title</h1><p>{line}{c}</p>{d}<p>{more}</p></article><script>left open <p>{line}"
    want = f"Title\n{line}\n{more}"
    assert html_extract.main_text(page(), fitted) == want
    opened, closed = f"<{tag} class=x>{inside}", f"<{tag} class=x>{inside}<p>Hidden</p><style>a<p></{tag}>"
    for part in (opened, closed, f"{opened}{closed}", f"<{tag}>{inside}<!-- x </{tag}>"):
        for place in "abcd":
            assert html_extract.main_text(page(**{place: part}), fitted) == want, (part, place)
    assert html_extract.main_text(page(*[opened] * 4), fitted) == want
    assert html_extract.main_text(f"<article><h1>Title</h1><p>{line} A{closed}B</p></article>", fitted) == f"Title\n{line} AB"


def test_personal_data_against_patterns(spark):
    def base(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and pii.luhn(digits):
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    random.seed(4)
    texts = ["".join(random.choice("a@.1 2-+()4") for _ in range(60)) for _ in range(400)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert all(pii.base_spans(t) == base(t) for t in texts)
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.1.2.03 1{zeros}.1.2.3") == [("ip", 0, 5007)]
    spans = pii.learned_spans(['the token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" is here'])[0]
    assert [k for k, _, _ in spans] == ["secret"]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(25):
            for _ in range(rng.randint(1, 4)):
                c ^= 1 << rng.randrange(64)
            fps.add(c)
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    got = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == want
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(list(want), "u long, v long")).collect()}
    assert all(found[f] == find(f) for f in found) and set(found) == {x for p in want for x in p}


def test_large_tables_are_not_broadcast(spark, monkeypatch, capsys):
    """Whatever Spark takes their size for: these are small enough for it to broadcast them."""

    def broadcasts(df):
        df.collect()
        df.explain()
        return "Broadcast" in capsys.readouterr().out

    fps = spark.createDataFrame([(1 << i,) for i in range(9)], "fp long")
    assert not broadcasts(simhash.links(fps)) and simhash.links(fps).count() == 36
    edges = spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")
    assert [broadcasts(step(edges, n)) for step in (components._toward_least, components._among_smaller) for n in (2, 10**9)] == [True, False] * 2
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x y z")], "doc_id long, text string")
    want = sorted(map(tuple, simhash.near_duplicates(docs, "doc_id", "text").collect()))
    monkeypatch.setattr("foliospark.llm.shared.BROADCAST_ROWS", 0)
    found = simhash.near_duplicates(docs, "doc_id", "text")
    assert not broadcasts(found) and sorted(map(tuple, found.collect())) == want
    grams, _ = decontaminate.fingerprints(docs, "doc_id", "text")
    rows = decontaminate.with_kept(decontaminate.with_words(docs.withColumn("__row", F.col("doc_id")).withColumnRenamed("doc_id", "__key"), "text")).withColumn("n_words", F.size("words"))
    assert not broadcasts(decontaminate._found_by_shuffle(rows.select("__row", "__key", "n_words", "words", F.concat("kept", F.array(F.lit(0).cast("long"))).alias("kept")), grams))


def test_quality_counts(spark):
    def counts(t):
        w, seen, repeated = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered)]

    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", "\n\n a", "a b c d e a b c d e", "x y\x1cz é\n\n"]
    assert quality.measured(texts)[0].tolist() == [counts(t) for t in texts]


def test_furniture_anywhere_in_a_line(spark):
    lines = ["one two three four five six seven eight nine ten eleven twelve thirteen " + end for end in ("Login.", "Privacy, and so on", "(c) Cookies: all", "last words")]
    furniture = quality.measured(lines)[1][:, 7] - quality.OFFSETS[7]
    assert furniture.tolist() == [1, 1, 1, 0]
    menu = "Home News Sports Weather Travel Culture Science Health Opinion Video Shop Contact Login. Register. Subscribe. Privacy, Terms, Cookies. Sitemap, Newsletter."
    got = quality.judge(spark.createDataFrame([(1, menu)], "doc_id long, text string"), "doc_id", "text").first()
    assert not got["base_failed"] and not got["kept"] and got["content_share"] == 0


def test_both_ways_of_decontamination_agree(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    short = bench.union(bench.limit(4).select(F.col("item_id") + 1000, F.expr("substring_index(text, ' ', 4)")))
    a, b = (sorted(map(tuple, decontaminate.scan(docs, "doc_id", "text", short, "item_id", "text", broadcast_rows=n).collect())) for n in (300_000, 0))
    assert a == b


def test_decontamination_against_all_windows(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)]
    items = [(i, text(rng.choice([3, 7, 12, 13, 14, 40]))) for i in range(25)]
    items += [(100 + i, " ".join(d.split()[5 : 5 + rng.randint(13, 40)])) for i, d in docs[:30]] + [(200, text(400))]
    want = {}
    for key, doc in docs:
        words, hit, found = doc.split(), set(), set()
        for item, other in items:
            w = other.split()
            n = min(13, len(w))
            windows = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w else set()
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add(item)
        want[key] = (len(words), len(hit), len(found))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (300_000, 0):
        got = decontaminate.scan(frames[0], "doc_id", "text", frames[1], "item_id", "text", broadcast_rows=most).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got} == want
