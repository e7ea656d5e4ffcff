"""Token bins against plain best fit decreasing: rows, padding, segment bounds and positions."""

import random

import numpy as np

from foliospark.llm import queries, token_bins


def plain_rows(lengths, limit):
    """Piece numbers by row: longest first, into the row with the least room that suffices."""
    rows, room = [], []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room[r], -r) for r in range(len(rows)) if room[r] >= lengths[piece]]
        if fits:
            r = min(fits)[1] * -1
        else:
            r = len(rows)
            rows.append([])
            room.append(limit)
        rows[r].append(piece)
        room[r] -= lengths[piece]
    return rows


def test_rooms_against_plain_best_fit():
    rng = random.Random(8)
    for limit in (1, 7, 8, 64, 100):
        for n in (1, 2, 30, 200):
            lengths = [rng.randint(1, limit) if rng.random() < 0.8 else limit for _ in range(n)]
            order, row = token_bins.best_fit_decreasing(np.array(lengths), limit)
            assert [lengths[i] for i in order] == sorted(lengths, reverse=True)
            want = sorted(sum(lengths[i] for i in r) for r in plain_rows(lengths, limit))
            assert sorted(np.bincount(row, np.array(lengths)[order])) == want  # equal rooms may swap, what is filled may not
            assert sorted(order.tolist()) == list(range(n))


def test_matrix_rows_against_plain_code(spark):
    from tokenizers import Tokenizer

    rng, limit = random.Random(9), 32
    texts = [" ".join(rng.choice(["river", "the", "of", "bridge", "internationalisation", "7"]) for _ in range(rng.choice([0, 1, 5, 31, 32, 33, 90]))) for _ in range(70)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no key"), (70, None), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "sequence_id long, text string").coalesce(1)  # the key bears a result's name
    bins = token_bins.write_bins(docs, "sequence_id", "text", queries.tokenizer_path(), limit=limit, pad_id=9, end_id=5)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 5] for _, t in rows]
    lengths = [min(limit, len(d) - s) for d in ids for s in range(0, len(d), limit)]
    found = bins.orderBy("sequence_id").collect()
    assert sorted(r["n_tokens"] for r in found) == sorted(sum(lengths[i] for i in r) for r in plain_rows(lengths, limit))
    parts = []
    for r in found:
        stored, positions = np.frombuffer(r["ids"], "<u2").tolist(), np.frombuffer(r["positions"], "<u2").tolist()
        assert len(stored) == len(positions) == limit and r["id_bytes"] == 2 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert stored[r["n_tokens"] :] == [9] * (limit - r["n_tokens"]) and not any(positions[r["n_tokens"] :])
        for a, b, key, start, total in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"], r["doc_tokens"], strict=False):
            assert positions[a:b] == list(range(b - a))
            parts.append((str(key), start, total, tuple(stored[a:b])))
    want = [(str(k), s, len(d), tuple(d[s : s + limit])) for (k, _), d in zip(rows, ids, strict=True) for s in range(0, len(d), limit)]
    assert sorted(parts) == sorted(want)
    assert token_bins.write_bins(docs.limit(0), "sequence_id", "text", queries.tokenizer_path()).count() == 0


def test_segments_of_a_key_with_a_result_name(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "start long, text string")
    found = token_bins.segments(token_bins.write_bins(docs, "start", "text", queries.tokenizer_path()), "start", names={"start": "piece_start"})
    assert found.columns[:2] == ["start", "piece_start"] and {(r["start"], r["piece_start"]) for r in found.collect()} == {(1, 0), (2, 0)}


def test_encoder_tables_start_anew(spark):
    from tokenizers import Tokenizer

    from foliospark.llm import tokens

    path, rng = queries.tokenizer_path(), random.Random(10)
    coder, plain = tokens.Encoder(path, max_words=40), Tokenizer.from_file(path)
    signs = ["a", "Be", "É", "ß", "'s", "7", "12", "<|endoftext|>", "<", "|", "Σ", "İ", "你", ",", "--", "é", "K", "\x85", "\x1f", "�", "😀", "ﬁ"]
    for _ in range(30):
        texts = ["".join(rng.choice([*signs, " ", "\n", "\t "]) for _ in range(rng.randint(0, 60))) for _ in range(5)]
        ids, bounds = coder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts], texts
    assert len(coder.words) < 400
