import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import encoding, exact, langid, lines, packing, passages, perplexity, repair, simhash, transducer

AWKWARD = ["a  b\n\n c d  e\x1c\x1d f's it's  ", "\t x\r\n\r\n  y \x85 z　", "é ́a İstanbul ΑΣ", "<|endoftext|> a <|startoftext|>b", "", " ", "don't 3.14 中文 😀 x", "a​d﻿ e", "   " * 7 + "y", "▁x"]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_chunks_encode_like_whole_texts(rows):
    for name in encoding.CHUNKS:
        whole, own = Tokenizer.from_file(public_tokenizers.path(name)), encoding.Encoder(name)
        texts = AWKWARD + [r[1] for r in rows]
        for text, ids in zip(texts, own.ids(texts), strict=True):
            assert ids == packed(whole.encode(text or "", add_special_tokens=False).ids)


def test_marks_behind_letters_are_runs_of_their_own():
    letters = [chr(c) for c in range(33, 0x300)]
    texts = [x + marks for x in letters for marks in ("=", "'s", "~.", '"', "\u0338.")] + ["a" + x + "<" for x in letters]
    for name in encoding.CHUNKS:
        own, whole = encoding.Encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
        seen, tokenize = [], own._whole
        own._whole = lambda chunk: seen.append(chunk) or tokenize(chunk)
        own.ids(["heat*** été!? naïve; heat: heat"])
        assert sorted(seen) == ["!?", "***", ":", ";"]
        for text, ids in zip(texts, own.ids(texts), strict=True):
            assert ids == packed(whole.encode(text, add_special_tokens=False).ids), text


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "MEMORY", 3)
    own = encoding.Encoder("word_bpe_49k.json")
    assert [own.ids([f"one two{k}"])[0] for k in range(4)] and len(own.seen) <= 3


def test_packing_is_whole_and_tight(docs, rows):
    got = packing.pack(docs).toPandas()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want += [(str(r[0]), k, a, b - a, zlib.crc32(packed(ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    ids = ["None" if np.isnan(i) else str(int(i)) for i in got.doc_id]
    assert sorted(zip(ids, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_local_search_saves_bins_and_breaks_nothing():
    rng = np.random.default_rng(4)
    saved = 0
    for _ in range(30):
        sizes = rng.integers(300, 1000, 120)
        place, bins = packing.best_fit(sizes, 2048)
        after = packing.Search(sizes, place, bins, 2048).run()
        fill = np.bincount(after, sizes, bins)
        assert fill.max() <= 2048 and (fill[fill > 0] ** 2).sum() >= (np.bincount(place, sizes) ** 2).sum()
        saved += bins - len(np.unique(after))
    assert saved > 0
    assert packing.pack_shard(np.array([2047])).tolist() == [0]


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty).count() == 0


def check_files(spark, docs, rows, path):
    repair.write(docs, path)
    got = repair.read(spark, path).toPandas()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(r[0]), packed(whole.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    ids = ["None" if np.isnan(i) else str(int(i)) for i in got.doc_id]
    assert sorted(zip(ids, got.n_tokens, got.ids_crc32, strict=True)) == sorted((i, len(x) // 4, zlib.crc32(x)) for i, x in want)
    got = got.sort_values("start", kind="stable")
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    known = got.doc_id.dropna()
    assert known.is_monotonic_increasing


def test_token_files_come_back(spark, docs, rows, tmp_path, monkeypatch):
    check_files(spark, docs, rows, str(tmp_path / "one"))
    monkeypatch.setattr(repair, "BLOCK", 500)
    check_files(spark, docs, rows, str(tmp_path / "many"))


def test_token_files_of_an_empty_table(spark, empty, tmp_path):
    repair.write(empty, str(tmp_path / "none"))
    assert repair.read(spark, str(tmp_path / "none")).count() == 0


def test_grammar_decodes_any_stretch():
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 49_408, rng.integers(1, 9)) for _ in range(40)]
    tokens = np.concatenate([words[k] for k in rng.integers(0, 40, 9000)])
    sequence, rules, lengths = repair.compress(tokens)
    assert len(sequence) + 2 * len(rules) < 0.5 * len(tokens)
    grammar = repair.Grammar(sequence.tobytes(), rules.tobytes(), lengths.tobytes())
    for a, b in [(0, len(tokens)), (0, 0), (5, 6), *np.sort(rng.integers(0, len(tokens), (50, 2)), axis=1).tolist()]:
        assert (grammar.decode(a, b) == tokens[a:b]).all()
    same = np.zeros(1000, int)
    sequence, rules, lengths = repair.compress(same)
    assert (repair.Grammar(sequence.tobytes(), rules.tobytes(), lengths.tobytes()).decode(0, 1000) == same).all()


def test_runs_and_periodic_texts_become_short():
    rng = np.random.default_rng(8)
    period = rng.integers(0, 49_408, 7)
    runs = np.concatenate([np.append(np.full(5000, 320), k) for k in range(1000, 1100)])
    for tokens in (np.full(100_000, 5), np.tile(period, 20_000), runs):
        sequence, rules, lengths = repair.compress(tokens)
        assert len(sequence) + 4 * len(rules) < 0.02 * len(tokens)
        grammar = repair.Grammar(sequence.tobytes(), rules.tobytes(), lengths.tobytes())
        assert (grammar.decode(0, len(tokens)) == tokens).all() and (grammar.decode(4321, 9876) == tokens[4321:9876]).all()


def test_late_rounds_count_near_replaced_places_only(monkeypatch):
    tokens = np.append(np.random.default_rng(12).zipf(1.5, 60_000) % 2000, np.full(77, 5))
    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, minlength=0: calls.append((len(x), minlength)) or bincount(x, minlength=minlength))
    sequence, rules, lengths = repair.compress(tokens)
    grammar = repair.Grammar(sequence.tobytes(), rules.tobytes(), lengths.tobytes())
    assert (grammar.decode(0, len(tokens)) == tokens).all()
    rounds = [n for n, width in calls if width < 1 << 20]
    whole = [n for n, width in calls if width == 1 << 20 and n >= len(sequence) - 1]
    assert 0 < len(whole) < len(rounds)


def test_rounds_do_not_go_over_the_whole_sequence(monkeypatch):
    tokens = np.append(np.random.default_rng(12).zipf(1.5, 60_000) % 2000, np.full(77, 5))
    sizes, flatnonzero = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: sizes.append(len(x)) or flatnonzero(x))
    sequence, rules, lengths = repair.compress(tokens)
    assert sum(n >= len(sequence) - 1 for n in sizes) <= 3 < len(sizes) // 4
    grammar = repair.Grammar(sequence.tobytes(), rules.tobytes(), lengths.tobytes())
    assert (grammar.decode(0, len(tokens)) == tokens).all()


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(9)
    tokens = rng.zipf(1.5, 60_000) % 2000
    sequence, rules, _ = repair.compress(tokens)
    assert len(rules) < repair.SYMBOLS - repair.TERMINALS
    times = {}
    last = None
    for k, pair in enumerate(zip(sequence.tolist(), sequence[1:].tolist(), strict=False)):
        if pair != last or k - place == 2:  # places of a run that don't overlap
            times[pair], place = times.get(pair, 0) + 1, k
        last = pair
    assert max(times.values()) < repair.LEAST


def test_shortest_paths_are_the_models_segmentations(docs, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(transducer.MODEL))
    machine, texts = transducer.Transducer(transducer.MODEL), AWKWARD + [r[1] for r in rows] + ["x" * 50, "aaaabbbbb", "====----"]
    for text, ids in zip(texts, machine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text or "")
        assert machine.decode(ids) == (text or "").replace("▁", " ")
    back = transducer.decode(transducer.encode(docs, carry=["doc_id"])).toPandas()
    assert sorted(back.text) == sorted(r[1] or "" for r in rows)


def test_paths_go_by_the_longest_arcs_first(rows, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(transducer.MODEL))
    machine, judged = transducer.Transducer(transducer.MODEL), []
    texts = sorted({w for r in rows for w in (r[1] or "").split() if len(w) < 40}) + ["wordswithoutanyspacebetween中文字😀" * 500]
    judge = machine._follows
    machine._follows = lambda *arc: judged.append(arc) or judge(*arc)
    pieces = [machine.shortest("▁" + t) for t in texts]
    assert len(judged) < 2 * sum(map(len, pieces))
    monkeypatch.setattr(transducer, "MEMORY", 7)
    for text, ids in zip(texts, machine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text)


def test_round_trip_rows(docs, rows, empty):
    got = transducer.round_trip(docs).toPandas()
    assert len(got) == len(rows) and got.same.all()
    assert transducer.round_trip(empty).count() == 0


def test_large_ids_beside_null_ones_stay_exact(spark):
    ids = [2**53 + 1, 2**62 + 3, None, -(2**61) - 7]
    docs = spark.createDataFrame([(k, f"text number {n} of some words", "en") for n, k in enumerate(ids)], "doc_id long, text string, lang string")
    docs = docs.coalesce(1)
    for made in (
        packing.pack(docs),
        transducer.round_trip(docs),
        simhash.near_dedup(docs),
        perplexity.quality_rules(docs),
        passages.remove_repeats(docs),
        langid.identify(docs, None),
        exact.exact_dedup(docs),
        lines.line_dedup(docs),
    ):
        assert {r.doc_id for r in made.select("doc_id").collect()} == set(ids)
