"""URL rules, whitening and importance resampling against brute force, on the smallest tables and on hand-made rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyhouse.llm import queries, resampling, splitters, urlrules, whitening
from tallyhouse.sources.tables import read_table
from tests import oracle


@pytest.mark.parametrize("name", ["op11_urlrules", "op13_resampling"])
def test_query_matches_sql(spark, data_dir, name):
    oracle.compare(queries.QUERIES[name](spark, data_dir), oracle.connect(data_dir), queries.ORACLE_SQL[name])


# 11 URL rules

def url_by_hand(url, rules, default="allow"):
    rest = (url or "").split("://", 1)[1:]
    host = re.split(r"[/?#]", rest[0], maxsplit=1)[0] if rest else ""
    path = re.split(r"[?#]", rest[0][len(host):], maxsplit=1)[0] if rest else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), verdict, h + p) for h, p, verdict in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p) and p[:1] in ("", "/")]
    _, _, verdict, rule = max(fits, default=(0, 0, default, None))
    return host, path, rule, verdict


def rules_frame(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string, note string")


def judged_rows(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", 1, "k") for i, u in urls], "page_id long, url string, host string, part int, `key` string")
    found = urlrules.judged(pages, rules_frame(spark, [(*r, "n") for r in rules]))
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=repr)


def test_url_rules_match_brute_force(spark):
    rng = random.Random(3)
    labels = ["a", "b", "ab", "org", "com", "x-y", "é", "", "-", "~"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "/é￿", "/\U0010ffff", "/a/bb", "x"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = list({(host(rng.randint(1, 3)), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [(i, rng.choice(["http", "a+b"]) + "://" + host(rng.randint(1, 5)) + rng.choice(paths[:-1]) + rng.choice(["", "z", "/c?q=://b", "#/a"])) for i in range(1500)]
    found = judged_rows(spark, urls, rules)
    assert found == sorted(((i, *url_by_hand(u, rules)) for i, u in urls), key=repr)
    assert len({r[3] for r in found}) > 20


def test_awkward_urls_have_defined_results(spark):
    urls = [(1, None), (2, ""), (3, "no scheme.net/x"), (4, "HTTP://WWW.Example.NET/EN/x"), (5, "http://net"), (6, "http://net?x/y"), (7, "http://a.net/\n/x"), (8, "://net/"),
            (None, "http://org/fr/1"), (None, "http://org/fr/1"), (9, "http://É.org/fr/"), (9, "http://É.org/fr/"), (10, "http://net:80/"), (11, "http://u@net/"),
            (12, "http://" + "a." * 300 + "net/" + "b" * 50_000)]
    rules = [("net", "/", "block"), ("Net", "/", "allow"), ("org", "", "block"), ("org", "/fr/", "allow"), (None, "/", "block"), ("x", None, "block"), ("a", "b", "block")]
    clean = [("net", "/", "block"), ("org", "", "block"), ("org", "/fr/", "allow")]
    assert judged_rows(spark, urls, rules) == sorted(((i, *url_by_hand(u, clean)) for i, u in urls), key=repr)
    assert judged_rows(spark, urls, [])[0][-1] == "allow"
    assert judged_rows(spark, [], rules) == []
    assert {r[-1] for r in judged_rows(spark, urls * 40, [("", "", "block")])} == {"allow", "block"}


def test_a_hot_host_is_cut_into_several_ranges(spark):
    urls = spark.range(4_000).selectExpr("id AS page_id", "'http://hot.net/a' AS url")
    asks = urlrules.parsed(urls).selectExpr("concat(host, path) AS key", "page_id AS id")
    cuts = splitters.splitters(asks.withColumn("place", splitters.place()), 4_000, 8)
    dealt = asks.mapInArrow(splitters.with_part(["key", "id"], cuts), "key string, id long, part int").groupBy("part").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 1_000
    found = urlrules.judged(urls, rules_frame(spark, [("net", "/", "block", ""), ("hot.net", "/a", "allow", "")]))
    assert found.where("rule = 'hot.net/a' AND verdict = 'allow'").count() == 4_000


# 12 whitening

def whitened_by_hand(rows, count=4):
    """Fit list, mean, eigenvalues and components by numpy."""
    x = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in enumerate(rows)}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1][:count], vectors[:, ::-1][:, :count], values.sum()


def test_whitening_matches_numpy(spark, data_dir):
    table = read_table(spark, data_dir, "embeddings")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    x, n, sums, values, vectors, trace = whitened_by_hand([v for _, v in rows])
    found = {(r.vec_id, r.component): r for r in whitening.whitened(table).collect()}
    assert len(found) == 4 * len(rows)
    signs = {}
    for k, (vec_id, _) in enumerate(rows):
        for c in range(4):
            r = found[vec_id, c + 1]
            assert r.n == n and r.deviation == int(((n * x[k] - sums) ** 2).sum())
            want = (x[k] - sums / n) @ vectors[:, c] / math.sqrt(values[c])
            sign = signs.setdefault(c, 1 if r.whitened * want > 0 else -1)
            assert r.whitened == pytest.approx(sign * want, abs=1e-8)
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-9)
            assert r.identity_error < 1e-9


@pytest.mark.parametrize("kind", ["any", "equal", "rank one", "zero", "blocks", "tiny"])
@pytest.mark.parametrize("d", [1, 2, 3, 17, 80])
def test_leading_components_of_hard_matrices(kind, d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((3 * d, d))
    matrix = {"any": a.T @ a, "equal": np.eye(d) * 7, "rank one": np.ones((d, d)), "zero": np.zeros((d, d)), "blocks": np.diag(np.repeat(np.arange(d), 3)[:d] + 1.0),
              "tiny": a.T @ a * 1e-200}[kind]
    count = min(4, d)
    values, vectors = whitening.leading(matrix, count)
    scale = np.abs(matrix).max() or 1.0
    assert np.abs(values - np.linalg.eigvalsh(matrix / scale)[::-1][:count] * scale).max() <= 1e-13 * d * scale
    assert np.abs(matrix / scale @ vectors - vectors * (values / scale)).max() <= 1e-13 * d
    assert np.abs(vectors.T @ vectors - np.eye(count)).max() <= 1e-12


def test_awkward_vectors_have_defined_results(spark):
    rng, nan, inf = random.Random(1), float("nan"), float("inf")
    good = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(30)]
    rows = good + [(100, None), (101, []), (102, [1.0, None, 0.0]), (103, [nan, 0.0, 0.0]), (104, [0.0, -inf, 0.0]), (None, good[0][1]), (0, good[0][1]), (1, good[5][1])]
    rows += [(200, [0.5, 0.25]), (201, [0.5, 0.25])]
    schema = "vec_id long, embedding array<double>, n int, component string, x array<long>, whitened double"
    found = whitening.whitened(spark.createDataFrame([(*r, 1, "c", [1], 0.5) for r in rows], schema)).collect()
    three = [r for r in found if r.vec_id is None or r.vec_id < 100]
    assert sorted({r.vec_id for r in found if r.vec_id is not None}) == [*range(30), 200, 201]
    assert len(three) == 33 * 3 and {r.n for r in three} == {30} and max(r.identity_error for r in three) < 1e-9
    two = [r for r in found if r.vec_id in (200, 201)]
    assert len(two) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in two} == {(1, 0, None, 0.0, 0.0)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).count() == 0


def test_huge_entries_do_not_overflow(spark):
    rows = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, -0.0]), (3, [2.0 ** 40, 5.0])]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("component = 1").collect()
    assert len(found) == 4 and any(r.deviation is None for r in found) and all(math.isfinite(r.whitened) for r in found)


# 13 resampling

def resampled_by_hand(documents, target, per_cent=10, least_words=20, longest=1, buckets=10_000, seed=2024):
    def features(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        runs = [" ".join(found[i:i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]
        return len(found), [zlib.crc32(r.encode()) % buckets for r in runs]

    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for b in features(t)[1]:
                out[b] += 1
        return out

    s, t = counts(x for _, x in documents), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in documents:
        n, held = features(text)
        weight = math.floor(sum(gain[b] for b in held) / len(held)) if held else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), n >= least_words))
    takes = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = takes[:len(takes) * per_cent // 100]
    undrawn = takes[len(drawn):] + [r for r in rows if not r[4]]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in undrawn], key=repr)


def resampled_rows(spark, documents, target, **rule):
    docs = spark.createDataFrame([(*d, 1, "k", 2) for d in documents], "doc_id long, text string, score int, part string, `rank` int")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((tuple(r) for r in resampling.resampled(docs, bench, **rule).collect()), key=repr)


@pytest.mark.parametrize("rule", [{}, {"longest": 3, "buckets": 97, "per_cent": 37, "least_words": 5, "seed": 1}])
def test_resampling_matches_brute_force(spark, data_dir, rule):
    docs = [(r.doc_id, r.text) for r in read_table(spark, data_dir, "documents").collect()]
    bench = [r.text for r in read_table(spark, data_dir, "benchmark").collect()]
    assert resampled_rows(spark, docs, bench, **rule) == resampled_by_hand(docs, bench, **rule)


def test_awkward_documents_have_defined_results(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(40))
    long = " ".join(f"V{rng.randrange(3000)}É日" for _ in range(60_000))
    docs = [(1, None), (2, ""), (3, " \n#"), (4, "few words"), (5, text), (5, text), (5, long), (None, text), (None, long), (6, long.upper()), (7, "İ ſ Å " * 30)] + [(8, text)] * 300
    assert resampled_rows(spark, docs, [text, None, ""], per_cent=50) == resampled_by_hand(docs, [text, None, ""], per_cent=50)
    assert resampled_rows(spark, docs, []) == resampled_by_hand(docs, [])
    assert resampled_rows(spark, [], [text]) == []
    assert all(r[4] is None for r in resampled_rows(spark, docs[:4], [text]))


def test_equal_scores_are_dealt_to_several_segments(spark, tmp_path):
    runs = spark.range(3_000).selectExpr("7L AS doc_id", "1L AS n_features", "0L AS weight", "5L AS score", "true AS takes_part") \
        .sortWithinPartitions("score").withColumn("at", resampling.F.monotonically_increasing_id())
    runs.write.parquet(f"{tmp_path}/runs")
    ranked = resampling.ranked(spark.read.parquet(f"{tmp_path}/runs"), str(tmp_path))
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 3_001))
    held = [r["count"] for r in spark.read.parquet(f"{tmp_path}/segments").groupBy("part").count().collect()]
    assert len(held) == 8 and max(held) < 800
