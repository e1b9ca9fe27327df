import math
import zlib
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as entry
from barloom.llm import discriminant, langid, perplexity

from ..conftest import MEDIUM, SMALL


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(inside)


def test_base_counts(rows):
    for r in rows:
        assert perplexity.base_counts(r[1]) == brute_counts(r[1])
    assert perplexity.base_counts("a b c d a b c\nx\nx\n \n ") == (9, 9, 0, 1, 6)


def brute_model(texts, order=4):
    """gram (a string) -> probability of its last character after the others, by the formula level by level."""
    padded = ["\0" * (order - 1) + t for t in texts]
    counts = {order: Counter(p[i : i + order] for p in padded for i in range(len(p) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, kin, whole = {}, {}, {}
    for k, c in counts.items():
        cuts[k] = [0, *perplexity.discounts(*(sum(x == j for x in c.values()) for j in (1, 2, 3, 4)))]
        kin[k], whole[k] = Counter(), Counter()
        for g, n in c.items():
            whole[k][g[:-1]] += n
            kin[k][g[:-1]] += cuts[k][min(n, 3)]

    def chance(g):
        if not g:
            return 1 / 65536
        k, lower = len(g), chance(g[1:])
        if not whole[k][g[:-1]]:
            return lower
        n = counts[k][g]
        return (n - cuts[k][min(n, 3)] + kin[k][g[:-1]] * lower) / whole[k][g[:-1]]

    return chance


def test_grams_of_any_characters():
    texts = ["", "ab", "é★\U0001f600x", "\0"]
    data = "".join(texts).encode()
    got = perplexity.grams(data, np.array([len(t) for t in texts])).view(np.uint64).tolist()
    fold = lambda ch: ord(ch) if ord(ch) < 65536 else 0xD800 | ord(ch) & 0x7FF
    want = []
    for t in texts:
        for i in range(len(t)):
            code = 0
            for ch in ("\0\0\0" + t)[i : i + 4]:
                code = code << 16 | fold(ch)
            want.append(code)
    assert got == want


def test_model_equals_the_formula_and_sums_to_one(spark):
    rng = np.random.default_rng(1)
    sides = ["".join(rng.choice(list("abcde \n"), 1500, p=[0.3, 0.2, 0.15, 0.1, 0.05, 0.15, 0.05])) for _ in range(2)]
    rows = []
    for half, text in enumerate(sides):
        g, n = np.unique(perplexity.grams(text.encode(), np.array([len(text)])), return_counts=True)
        rows += [("en", half, int(a), int(b)) for a, b in zip(g, n, strict=True)] + [("x", 0, int(a), int(b)) for a, b in zip(g, n, strict=True)]
    got = perplexity.model(spark.createDataFrame(rows, "tag string, half int, g long, n long")).collect()
    chance = [brute_model([t]) for t in sides]
    for r in got:
        g = "".join(chr(r.g >> s & 0xFFFF) for s in (48, 32, 16, 0))
        if r.tag == "en":
            assert math.isclose(r.p0, chance[0](g), rel_tol=1e-9) and math.isclose(r.p1, chance[1](g), rel_tol=1e-9)
        else:
            assert r.p1 == 1 / 65536  # nothing in that half
    assert math.isclose(sum(chance[0]("abc" + chr(k)) for k in range(65536)), 1, rel_tol=1e-9)


def test_counts_and_bands_cover_all_texts(docs, rows, empty):
    got = perplexity.quality_rules(docs).toPandas()
    assert len(got) == len(rows) and got.log_perplexity.notna().all() and not (got.kept & got.base_failed).any()
    assert perplexity.quality_rules(empty).count() == 0


def test_bands_reject_noise_and_keep_prose(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(0)
    noise = [(10_000 + k, " ".join("".join(rng.choice(list("qxzjkvw#~"), 6)) for _ in range(80)), "en") for k in range(3)]
    got = perplexity.quality_rules(docs.unionByName(spark.createDataFrame(noise, docs.schema))).toPandas()
    assert not got[got.doc_id >= 10_000].kept.any() and not got[got.doc_id >= 10_000].base_failed.any()
    assert got[~got.base_failed].kept.mean() > 0.9


def words_of(rng, letters, n, low=3, high=9):
    return ["".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(n)]


def brute_quality(rows):
    """doc_id -> (score, kept) of (doc_id, text, lang): halves, models, quartiles and bands, one text after the other."""
    out, tagged = {}, defaultdict(list)
    for k, text, lang in rows:
        tag = (lang or "").strip().lower().replace("_", "-").split("-")[0] or "und"
        tagged[tag].append((k, text or ""))
    for tag, own in tagged.items():
        sides = perplexity.halves(*perplexity.hash_words([t for _, t in own], tag))
        for f in (0, 1):
            mine = [x for x, s in zip(own, sides, strict=True) if s == f]
            chance = brute_model([t for (_, t), s in zip(own, sides, strict=True) if s != f])
            scores = {}
            for k, t in mine:
                padded = "\0\0\0" + t
                scores[k] = round(-sum(math.log(chance(padded[i : i + 4])) for i in range(len(t))) / max(len(t), 1), 5)
            failed = {k: brute_counts(t)[0] < 50 or 2 * brute_counts(t)[4] > brute_counts(t)[0] for k, t in mine}
            good = sorted(scores[k] for k, _ in mine if not failed[k])
            if good:
                q1, q3 = (good[math.ceil(q * len(good)) - 1] for q in (0.25, 0.75))
                reach = 3.0 * max(q3 - q1, 0.02)
            for k, _ in mine:
                out[k] = scores[k], not failed[k] and q1 - reach <= scores[k] <= q3 + reach
    return out


def test_scores_bands_and_verdicts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "BATCH", 4000)
    monkeypatch.setattr(perplexity, "PIECE", 700)
    rng = np.random.default_rng(4)
    lexicon = words_of(rng, "abcdefgh", 60)
    texts = [" ".join(lexicon[int(i)] for i in np.minimum(rng.zipf(1.4, 70), 60) - 1) for _ in range(60)]
    texts += [" | ".join(words_of(rng, "xyzw", 60)) for _ in range(2)] + ["ab " * 90, "", None, "é" * 50]
    rows = [(k, t, ["ceb", "fil-PH", "fil_x"][k % 3]) for k, t in enumerate(texts)]
    got = perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)).toPandas()
    want = brute_quality(rows)
    for r in got.itertuples():
        assert math.isclose(r.log_perplexity, want[r.doc_id][0], abs_tol=2e-5) and r.kept == want[r.doc_id][1]
    assert 0 < got.kept.sum() < len(got)


def test_random_letters_of_another_script_are_rejected(spark):
    rng = np.random.default_rng(7)
    letters = "абвгдежзиклмнопрстуфхцчшщыэюя"
    lexicon = words_of(rng, letters, 150)
    prose = [(k, " ".join(lexicon[int(i)] for i in np.minimum(rng.zipf(1.3, 90), 150) - 1), "ru") for k in range(60)]
    junk = [(100 + k, " ".join(words_of(rng, letters, 90)), "ru") for k in range(3)]
    got = perplexity.quality_rules(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")).toPandas()
    assert not got[got.doc_id >= 100].base_failed.any() and not got[got.doc_id >= 100].kept.any()
    assert got[(got.doc_id < 100) & ~got.base_failed].kept.mean() > 0.9


def held(ids):
    return [zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


def test_language_on_held_out_documents(spark):
    got = langid.query(spark, MEDIUM).toPandas()
    truth = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").toPandas()
    got = got.merge(truth, on="doc_id")
    assert got.held_out.tolist() == held(got.doc_id) and got.score.between(0, 1).all()
    part = got[got.held_out]
    assert (part.lang == part.lang_pred).mean() > 0.97


def test_backpropagation_equals_differences():
    network = langid.Network(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(2)
    for side in (network.ahead, network.back):
        side.table, side.inner = side.table.astype(float) * 0.3, side.inner.astype(float) * 0.3
    network.out, network.bias = network.out.astype(float), network.bias.astype(float)
    x = rng.integers(97, 101, (7, 4)).astype(np.uint8)
    live = (np.arange(7)[:, None] < np.array([7, 3, 5, 1])).astype(float)
    y = np.array([0, 1, 2, 1])

    def loss():
        # float32 states inside forward limit the accuracy of the differences
        p = network.positions(x, live)
        return -(np.log(p[:, np.arange(4), y]) * live).sum() / live.sum()

    for w, g in zip(network.weights(), network.gradients(x, live, y), strict=True):
        flat, grad = w.reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(grad))[:3]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - grad[k]) < 2e-2 * max(1, abs(grad[k]))


def test_language_of_awkward_texts(spark, docs, rows, empty):
    network = langid.train(docs)
    got = langid.identify(docs, network).toPandas()
    assert len(got) == len(rows)
    bare = {str(r[0]) for r in rows if not any(map(str.isalpha, r[1] or ""))}
    for r in got.itertuples():
        assert (r.lang_pred == "und") == (("None" if np.isnan(r.doc_id) else str(int(r.doc_id))) in bare) or np.isnan(r.doc_id)
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    assert set(langid.identify(docs, None).toPandas().lang_pred) == {"und"}


def test_quality_on_held_out_documents(spark):
    got = discriminant.query(spark, MEDIUM).toPandas()
    truth = spark.read.parquet(f"{MEDIUM}/labels.parquet").groupBy("doc_id").max("quality").toPandas()
    got = got.merge(truth, on="doc_id")
    part = got[got.held_out]
    assert got.held_out.tolist() == held(got.doc_id) and (part.predicted == part["max(quality)"]).mean() > 0.95
    assert (got.predicted == (got.score >= 0.7)).all()


def test_discriminant_equals_normal_densities():
    rng = np.random.default_rng(8)
    x = [rng.normal(k, 1 + k, (200, 3)) @ rng.normal(0, 1, (3, 3)) for k in (0, 1)]
    model = discriminant.Discriminant(
        np.array([200.0, 200.0]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x])
    )
    own = [np.cov(a.T, bias=True) for a in x]
    pooled = 0.9 * (own[0] + own[1]) / 2 + 0.1 * np.diag(np.diag((own[0] + own[1]) / 2))
    logs = []
    for a, s in zip(x, own, strict=True):
        s = 0.8 * s + 0.2 * pooled + 1e-3 * np.eye(3)
        d = x[0][:9] - a.mean(axis=0)
        logs.append(-0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    np.testing.assert_allclose(model.score(x[0][:9]), 1 / (1 + np.exp(logs[0] - logs[1])), rtol=1e-8)


def test_quality_of_awkward_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(3, None, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = discriminant.quality_scores(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    none = discriminant.quality_scores(docs, labels.filter("quality > 5")).toPandas()
    assert (none.score == 0.5).all()
    assert discriminant.quality_scores(empty, labels).count() == 0


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
