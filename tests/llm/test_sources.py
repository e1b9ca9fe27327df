import random
import re
from collections import Counter

from barloom.llm import divergence

from .conftest import table


def brute(rows, min_docs=30, top=50):
    docs = [(t or "", la or "", s or "") for t, la, s in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        df = Counter(w for (_, la, _), ws in zip(docs, words, strict=True) if la == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        counts = {s: Counter() for _, la, s in docs if la == lang}
        for (_, la, s), ws in zip(docs, words, strict=True):
            if la == lang:
                counts[s].update(ws)
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        q = share(whole)
        p = {s: share(c) for s, c in counts.items()}
        for s, c in counts.items():
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in p if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if c[w] and p[s][w] > q[w])
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(terms[:top])]
    return sorted(out)


SCHEMA = "text string, lang string, source string, term string, counts int, rank string, base int, shard int"


def same(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "t", 1, "r", 2, 3) for r in rows], SCHEMA)
    got = divergence.divergence(frame.repartition(3), **options)
    options.pop("memory", None)
    assert sorted(map(tuple, got.collect())) == brute(rows, **options)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "abc" for b in ("ä", "oO", "日本") for c in "xyz"]
    rows = []
    for k in range(n):
        lang, source = ["en", "de", None][k % 3 if k % 5 else 0], f"s{k % 7}" if k % 2 else "hot"
        weights = [1 + (k * 31 + i * 17) % 11 for i in range(len(words))]
        rows.append((" ".join(rng.choices(words, weights, k=rng.randint(0, 12))) + rng.choice(["", "!", " 12-Ab", "\x00q\x7f"]), lang, source))
    return rows


def test_against_brute_force(spark):
    same(spark, corpus(260), min_docs=12, top=5)


def test_runs_of_any_size_give_the_same(spark, monkeypatch):
    rows = corpus(120, 2)
    monkeypatch.setattr(divergence, "CHUNK", 2)
    same(spark, rows, min_docs=5, top=3, memory=10)


def test_awkward_rows(spark):
    rows = [(r[1], r[2], r[3]) for r in table()]
    rows += [(None, "xx", "only"), ("word " * 40, "yy", "a"), (None, "yy", "b"), ("", None, None)] + [("same text Same", "zz", "a")] * 40 + [("same", "zz", "b")]
    same(spark, rows, min_docs=3)


def test_no_rows_and_no_kept_term(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    got = divergence.divergence(spark.createDataFrame([("a b", "en", "x", *[None] * 5), ("c", "en", "y", *[None] * 5)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_long_texts_are_not_cut_within_a_term(monkeypatch):
    text = ("Straße ab12cd " * 500 + "x" * 9000 + " end").encode()
    want = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.decode().replace("S", "s")))
    for piece in (1, 7, 100, 10**6):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert Counter(t.decode() for terms in divergence.terms_of(text) for t in terms) == want


def test_many_sources_go_through_in_tiles(spark, monkeypatch):
    rows = [(" ".join(f"w{chr(97 + (k + i) % 9)}" for i in range(4 + k % 3)), "en", f"s{k}") for k in range(40)]
    monkeypatch.setattr(divergence, "TILE", 6)
    frame = spark.createDataFrame([(*r, "t", 1, "r", 2, 3) for r in rows], SCHEMA).coalesce(1)
    got = divergence.divergence(frame, min_docs=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, min_docs=2)
