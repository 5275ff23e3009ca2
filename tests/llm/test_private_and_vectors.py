"""Sanitising, whitening and clustering against brute force, and on awkward tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from judgelake.llm import annulus, sanitising, whitening
from judgelake.shipping import ship

from ..conftest import SMALL

KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute_base(text):
    return sorted((m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if passes(kind, m.group()))


def spans_of(rows):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in rows)


def luhn(rng, n):
    digits = [rng.randrange(10) for _ in range(n - 1)]
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
    return "".join(map(str, digits)) + str(-total % 10)


def test_base_spans_equal_brute_force(spark):
    ship(spark)
    rng = random.Random(4)
    bits = ["a@b.c", "x@y", "@", ".", "..", "é", "\U0001f600", " ", "-", "1.2.3.4", "1.2.3", "999.1.1.1", "001.2.3.4.5.6.7.8", "+1 (017) 555-7713", "+", "+12", "_d@e.f", "%+a@b-c.d.e@f.g", "0", "12", "\n"]
    texts = ["".join(rng.choice([*bits, luhn(rng, rng.randrange(13, 21)), luhn(rng, 16)[:8] + "-" + luhn(rng, 8), str(rng.randrange(300))]) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    texts += [None, "", "9" * 5_000, "a" * 5_000, "a@" + "b." * 30_000 + "c", "1." * 60_000, " 10.0.0.1,x@y.zz" * 4_000, "+" + " " * 50_000 + "1"]
    rows = {r["doc_id"]: r for r in sanitising.sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        expected = brute_base(text)
        found = [(s["start"], s["rank"], s["end"], s["kind"]) for s in rows[k]["base"]]
        assert found == expected, text[:80]
        assert [rows[k][f"n_{kind}"] for kind, _ in KINDS] == [sum(e[3] == kind for e in expected) for kind, _ in KINDS]


def brute_terms(texts, contexts=3, least_bits=3.0, generalise=0.75, remove=0.9, reach=64):
    """doc index: {word: removed}, counted document by document."""
    edge = r"[^\W_]"
    words = lambda t: set(re.findall(r"[^\W_]{3,}", t.lower()))
    key = {"email": str.lower, "ip": str, "card": lambda v: re.sub("[^0-9]", "", v), "phone": lambda v: re.sub("[^0-9]", "", v)}
    near, holds, around = [], {}, {}
    for n, t in enumerate(texts):
        own = set()
        for kind, p in KINDS:
            found = list(re.finditer(p, t))
            for k, m in enumerate(found):
                if not passes(kind, m.group()):
                    continue
                left, right = t[found[k - 1].end() if k else 0 : m.start()], t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)]
                left = re.sub(f"^{edge}+", "", left[-reach:]) if len(left) > reach else left
                right = re.sub(f"{edge}+$", "", right[:reach]) if len(right) > reach else right
                entity = f"{kind}:{key[kind](m.group())}"
                holds.setdefault(entity, set()).add(n)
                for w in words(f"{left} {right}"):
                    own.add((entity, w))
                    around.setdefault((entity, w), set()).add(f"{left} {right}".lower())
        near.append(own)
    df, both = {}, {}
    for t in texts:
        for w in words(t):
            df[w] = df.get(w, 0) + 1
    for own in near:
        for pair in own:
            both[pair] = both.get(pair, 0) + 1
    telling = {}
    for (e, w), n in both.items():
        bits = math.log2(len(texts) / len(holds[e]))
        if bits >= least_bits and len(around[e, w]) >= contexts:
            share = math.log2(len(texts) * n / (df[w] * len(holds[e]))) / bits
            if share >= generalise:
                telling[e, w] = share >= remove
    out = []
    for own in near:
        mine = {}
        for e, w in own:
            if (e, w) in telling:
                mine[w] = mine.get(w, False) or telling[e, w]
        out.append(mine)
    return out


def sentences():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("tan", "bel", "dor", "fis", "gul", "pem")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [text(40) for _ in range(300)]
    for _ in range(8):  # the name stands beside the address, in other words each time, and far from it as well
        out.append(f"{text(9)} Quillfeather Zoë writes from zoe.q@post.example on 2024 {text(9)}. {text(30)} quillfeather again {text(4)}")
    out += [f"{text(5)} Zoë {text(5)}" for _ in range(5)]  # known beside others as well, so that it is only generalised
    out += ["ask Brandt at +49 (151) 555-0101 now " + text(3)] * 12  # one passage copied: no evidence
    out += [f"{text(6)} Quillfeather alone {text(6)}"]  # no entity here
    out += [f"{text(5)} call desk 10.1.2.3 maybe {text(5)}" for _ in range(5)] + [f"{text(5)} desk {text(5)}" for _ in range(40)]
    return out


def test_words_that_reveal_an_entity_are_sanitised(spark):
    texts = sentences()
    docs = spark.createDataFrame([(k, t, "e", "n") for k, t in enumerate(texts)], "doc_id long, text string, entity string, spans string")
    rows = {r["doc_id"]: r for r in sanitising.sanitised(docs).collect()}
    edge = r"(?<![^\W_]){}(?![^\W_])"
    for k, (text, mine) in enumerate(zip(texts, brute_terms(texts), strict=True)):
        base = brute_base(text)
        places = [(m.start(), 4, m.end(), "term") for w in mine for m in re.finditer(edge.format(w), text.lower()) if not any(m.start() < e and s < m.end() for s, _, e, _ in base)]
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in rows[k]["spans"]] == sorted(base + places)
    assert "Quillfeather" not in rows[300]["sanitised"] and "quillfeather" not in rows[300]["sanitised"] and "zoe.q" not in rows[300]["sanitised"] and "[email]" in rows[300]["sanitised"]
    assert "Brandt" in rows[315]["sanitised"] and "[phone]" in rows[315]["sanitised"]
    assert rows[325]["sanitised"] == texts[325] and "Quillfeather" in texts[325] and "desk" in rows[327]["sanitised"]
    assert any(s["instead"] == "[name]" for r in rows.values() for s in r["spans"]) and any(s["instead"] == "" for r in rows.values() for s in r["spans"])


def test_overlapping_spans_are_replaced_once(spark):
    text = "to a@10.0.0.1.net or +4111 1111 1111 1111 end"
    row = sanitising.sanitised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_email"] == row["n_ip"] == 1 and row["sanitised"].startswith("to [email] or +[card]") and row["sanitised"].endswith(" end")
    assert not re.search("[0-9]{3}", row["sanitised"])


def test_sanitising_awkward_rows(spark):
    rows = [(None, "x@y.zz", 1), (None, None, 2), (3, "x@y.zz", 3), (3, "x@y.zz", 3), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, terms int")
    found = sorted((str(r["doc_id"]), r["n_email"], spans_of([(s["start"], 0, s["end"], s["kind"]) for s in r["spans"]])) for r in sanitising.sanitised(docs).collect())
    assert found == [("3", 1, "email:0:6"), ("3", 1, "email:0:6"), ("4", 0, ""), ("None", 0, ""), ("None", 1, "email:0:6")]
    assert sanitising.sanitised(docs.limit(0)).count() == 0


def test_op11_counts_and_digests(spark):
    ship(spark)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in sanitising.op11_information_sanitising(spark, SMALL).collect():
        text = spans_of(brute_base(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r["spans"].split(","))


VECTORS = "vec_id long, embedding array<float>, label int, x string, component int, cluster int"


def vectors(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 7, 7) for i, v in rows], VECTORS)


def brute_whitening(x):
    distinct = np.unique(x, axis=0)
    values, directions = np.linalg.eigh(np.cov(distinct.T, bias=True))
    values, directions = values[::-1], directions[:, ::-1]
    return len(distinct), distinct.sum(axis=0), values, (x - distinct.mean(axis=0)) @ (directions[:, :4] / np.sqrt(values[:4]))


def test_whitening_equals_brute_force(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = docs.union(docs.limit(20)).collect()  # repeats
    x = np.floor(np.array([r["embedding"] for r in rows], dtype=float) * 256)
    n, sums, values, scores = brute_whitening(x)
    found = whitening.whitened(spark.createDataFrame(rows, docs.schema)).orderBy("vec_id", "component").collect()
    assert len(found) == 4 * len(rows) and {r["n"] for r in found} == {n}
    by = {}
    for r, vector, score in zip(rows, x, scores, strict=True):
        by[r["vec_id"]] = (int(((n * vector - sums) ** 2).sum()), score)
    signs = {}
    for r in found:
        deviation, score = by[r["vec_id"]]
        k = r["component"] - 1
        assert r["deviation"] == deviation and abs(r["explained"] - values[k] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9
        sign = signs.setdefault(k, np.sign(score[k]) * np.sign(r["whitened"]))
        assert abs(sign * r["whitened"] - score[k]) < 1e-6


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    scale = np.array([1e6, 1e3, 1.0, 1e-3, 1e-6])
    b = rng.normal(size=(40, 5))
    gram = (b.T @ b) * np.outer(scale, scale)  # graded: its small eigenvalues are well determined
    values, directions = whitening.jacobi(gram)
    singular = np.linalg.svd(b * scale, compute_uv=False)
    assert np.allclose(values, np.sort(singular**2)[::-1], rtol=1e-6) and np.allclose(directions.T @ directions, np.eye(5), atol=1e-12)


def test_whitening_awkward_rows(spark):
    good = [(k, [k % 3, (k * k) % 5, 1.0]) for k in range(9)]
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [float("nan"), 1, 1]), (23, [float("inf"), 1, 1]), (24, []), (25, [1.0])]
    found = whitening.whitened(vectors(spark, good + good[:2] + [(None, good[0][1])] + bad)).collect()
    assert len(found) == 3 * 12 and {r["component"] for r in found} == {1, 2, 3} and {r["vec_id"] for r in found} == {*range(9), None}
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in found) and found[0]["identity_error"] < 1e-9  # the third dimension is constant
    one = whitening.whitened(vectors(spark, [(1, [1, 2]), (2, [1, 2])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, 0.0)] * 4
    assert whitening.whitened(vectors(spark, bad[:5])).count() == whitening.whitened(vectors(spark, [])).count() == 0
    huge = whitening.whitened(vectors(spark, [(1, [3e38, 0]), (2, [-3e38, 1]), (3, [0, 2])])).collect()
    assert len(huge) == 6 and any(r["deviation"] is None for r in huge)


def brute_clusters(rows, clusters=16, rounds=3):
    x = {k: [math.floor(64 * c) for c in v] for k, (_, v) in enumerate(rows)}
    order = sorted(x, key=lambda k: (rows[k][0] is None, hashlib.sha256(f"1:{rows[k][0]}".encode()).hexdigest(), x[k]))
    centroids = [x[k] for k in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for v in x.values():
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(col) // len(own[n]) for col in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    at = {k: near(v) for k, v in x.items()}
    inertia = {}
    for d, n in at.values():
        inertia[n] = inertia.get(n, 0) + d
    return sorted((str(rows[k][0]), n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for k, (d, n) in at.items())


def clusters_of(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("spread", [1, 50, 1e9])
def test_clusters_equal_brute_force(spark, spread):
    rng = random.Random(7)
    centre = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(9)]
    rows = [(k, [float(np.float32(c + rng.gauss(0, 0.2))) for c in centre[k % 9]]) for k in range(150)]
    rows += rows[:30] + [(None, rows[3][1])] + [(500 + k, rows[5][1]) for k in range(40)]
    bad = [(900, None), (901, [None] * 64), (902, [float("nan")] * 64), (903, [1.0] * 63), (904, [1.0] * 65), (905, [])]
    assert clusters_of(annulus.clustered(vectors(spark, rows + bad))) == brute_clusters(rows)


def test_few_vectors_and_none(spark):
    rows = [(k, [float(k)] * 64) for k in range(5)]
    assert clusters_of(annulus.clustered(vectors(spark, rows))) == brute_clusters(rows)
    assert annulus.clustered(vectors(spark, [])).count() == 0


def test_annulus_leaves_centroids_out_and_keeps_ties():
    rng = np.random.default_rng(1)
    centroids = (rng.integers(-9, 9, (40, 64)) * np.arange(1, 41)[:, None]).astype(object)
    centroids[7] = centroids[3]  # a tie: the smaller number wins
    x = np.concatenate([centroids[rng.integers(0, 40, 300)].astype(np.int64) + rng.integers(-3, 4, (300, 64)), np.zeros((1, 64), dtype=np.int64)])
    number, distance, compared = annulus.Annulus(centroids).nearest(x)
    every = ((x[:, None, :] - centroids.astype(np.int64)[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and 7 not in number
    assert compared.mean() < 10  # of 40
    rim = annulus.Annulus(np.array([[3] + [0] * 63, [-3] + [0] * 63, [0, 3] + [0] * 62], dtype=object)).nearest(np.zeros((1, 64), dtype=np.int64))
    assert (rim[0][0], rim[1][0], rim[2][0]) == (0, 9, 3)
