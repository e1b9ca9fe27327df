import random
import re
from itertools import combinations

import pytest

from barloom.llm import urlrules

RULES = urlrules.RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def listed(host, path, rules=RULES):
    fits = []
    for verdict, rule in rules:
        name, at, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def tokens(url):
    host, path = split(url)
    url = url or ""
    labels = [x for x in host.split(".") if x]
    out = {"h:" + ".".join(labels[k:]) for k in range(len(labels))}
    if len(labels) > 2:
        out.add("w:" + labels[0])
    segments = [re.sub("[0-9]+", "0", x) for x in path.split("/") if x]
    out |= {f"p{k}:{x}" for k, x in enumerate(segments)} | {f"s:{x}" for x in segments}
    if "://" in url:
        out.add("u:" + url.split("://")[0].lower())
    end = re.search(r"\.([A-Za-z0-9]+)\Z", path)
    if end:
        out.add("x:" + end[1].lower())
    query = re.search(r"\?([^#]*)", url)
    if query:
        out |= {"q:" + f.split("=")[0] for f in query[1].split("&") if f}
    return out


def brute(urls, support, confidence):
    """Rule and verdict of each URL, with every frequent token set tried on every URL."""
    judged = [(u, *split(u), *listed(*split(u))) for u in urls]
    known = [(tokens(u), verdict) for u, _, _, _, verdict in judged if verdict]
    least = max(2, -(-support * len(known) // 1))
    rules, sizes = [], {}
    for t, _ in known:
        for k in range(1, len(t) + 1):
            for s in combinations(sorted(t), k):
                sizes[s] = sizes.get(s, 0) + 1
    for s, n in sizes.items():
        for verdict in ("allow", "block"):
            hits = sum(v == verdict and set(s) <= t for t, v in known)
            if hits >= least and hits >= confidence * n:
                rules.append((hits / n, hits, verdict, s))
    out = []
    for u, host, path, rule, verdict in judged:
        met = [r for r in rules if set(r[3]) <= tokens(u)]
        out.append((host, path, rule, verdict or (max(met)[2] if met else "allow"), None if verdict or not met else max(met)[:2]))
    return out


def made(n):
    rng = random.Random(7)
    pick = rng.choice
    for _ in range(n):
        host = pick(["", "m."]) + pick(["a", "b", "example"]) + "." + pick(["org", "com", "com", "net"])
        yield f"{pick(['http', 'https'])}://{host}/{pick(['en/', 'de/', 'fr/', 'es/'])}{rng.randint(0, 30)}{pick(['', '?x=1', '#top'])}"


URLS = list(made(120))
ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.EXAMPLE.ORG/ES/1", "http://example.org/es/1", "http://example.org/en/1?u=http://x.com/de/", "https://m.example.org/en/12",
    "http://notexample.org/es/", "http://org", "ftp://Ünï.com/de/ß", "a://b://c.com/fr/", "http://x.com/fr", "http://x.com/fr/\n2", "//x.com/de/", "http:// x.net/é?é=&&a#?",
]


@pytest.mark.parametrize(("support", "confidence"), [(0.05, 0.8), (0.15, 0.6)])
def test_verdicts_equal_all_rules_tried_on_all_urls(spark, support, confidence):
    urls = URLS + URLS[:30] + ODD
    schema = "page_id long, url string, row int, tokens string, verdict string, host string, best string"
    frame = spark.createDataFrame([(k, u, 1, "t", "block", "h", "b") for k, u in enumerate(urls)], schema)
    got = urlrules.url_filter(frame.repartition(3), support=support, confidence=confidence).orderBy("page_id").collect()
    want = brute(urls, support, confidence)
    assert [r.page_id for r in got] == list(range(len(urls)))
    for r, (host, path, rule, verdict, best) in zip(got, want, strict=True):
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), urls[r.page_id]
        assert (r.confidence if r.rule is None else None) == (best[0] if best else None)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_pruned_rules_are_the_most_general(spark):
    rows = [(["a", "b"], "block")] * 6 + [(["a", "c"], "block")] * 4 + [(["b", "c"], "allow")] * 5
    found = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.2, 0.9).collect()
    assert sorted((tuple(r.antecedent), r.verdict, r.hits, r.n) for r in found) == [(("a",), "block", 10, 10), (("b", "c"), "allow", 5, 5)]


def test_one_url_in_a_third_of_all_rows_with_many_tokens(spark):
    hot = "http://" + ".".join("abcdefgh") + ".com/de/" + "/".join("klmnopqrstuvw") + "?" + "&".join("abcdefgh")
    urls = [hot] * 60 + URLS
    frame = spark.createDataFrame([(1, u) for u in urls], "page_id long, url string")
    got = urlrules.url_filter(frame)
    assert got.filter("rule = 'com/de/' and host like 'a.b.%'").count() == 60 and got.count() == len(urls)


def test_no_rows_no_labels_and_labels_of_their_own(spark):
    frame = spark.createDataFrame([(1, "http://x.net/en/"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in urlrules.url_filter(frame).collect()} == {"allow"}
    assert urlrules.url_filter(frame.limit(0)).collect() == []
    labels = spark.createDataFrame([("http://y.net/en/1", "block")] * 5 + [("http://z.org/", "allow"), (None, "block")], "url string, verdict string")
    assert {r.page_id: r.verdict for r in urlrules.url_filter(frame, labelled=labels).collect()} == {1: "block", None: "allow"}


def wide(n, width=24):
    """Baskets of up to `width` frequent tokens; what tells is among the least telling ones, which a cap of 12 would leave out."""
    rng = random.Random(11)
    for _ in range(n):
        common = [f"c{k:02d}" for k in range(width - 4) if rng.random() < 0.9]
        pair = [t for t in ("x", "y", "z") if rng.random() < 0.5]
        # by itself x or y says nothing, x and y together do
        yield common + pair, "block" if ("x" in pair) != ("y" in pair) else "allow"


def plain_rules(rows, support, confidence, longest=3):
    """Kept rules of up to `longest` tokens, each token set tried on every row."""
    least, found = max(2, -(-support * len(rows) // 1)), {}
    for s in (c for k in range(1, longest + 1) for c in combinations(sorted({t for r, _ in rows for t in r}), k)):
        said = [v for t, v in rows if set(s) <= set(t)]
        for v in ("allow", "block"):
            if said.count(v) >= least and said.count(v) >= confidence * len(said):
                found[s, v] = (said.count(v), len(said))
    beaten = lambda s, v: any((r := found.get((s[:k] + s[k + 1 :], v))) and r[0] * found[s, v][1] >= found[s, v][0] * r[1] for k in range(len(s)))
    return {(s, v, *c) for (s, v), c in found.items() if not beaten(s, v)}


def test_rules_of_wide_baskets_lose_no_token(spark):
    rows = [(t, v) for t, v in wide(150, 16)]
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    found = {(tuple(r.antecedent), r.verdict, r.hits, r.n) for r in urlrules.mine(frame, 0.1, 0.9).collect()}
    assert {r for r in found if len(r[0]) <= 3} == plain_rules(rows, 0.1, 0.9)
    assert (("x", "y"), "allow") in {r[:2] for r in found}


@pytest.mark.parametrize(("support", "confidence"), [(0.05, 0.8), (0.2, 0.6)])
def test_both_ways_of_mining_find_the_same_rules(spark, support, confidence):
    rows = [(sorted(tokens(u)), v) for u in URLS for v in [listed(*split(u))[1]] if v] + [(["a"], "allow")] * 3
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    grown, levels = (sorted(tuple(r) for r in urlrules.mine(frame, support, confidence, n).collect()) for n in (99, 0))
    assert grown == levels and grown
