"""Operators against brute force, exact round trips or held-out accuracy, and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from judgelake.llm import chat, exact_dedup, html_extraction, line_dedup, matroska, mixing, ngram_join, packing, quality, toxicity
from judgelake.llm.registry import ORACLES, QUERIES
from judgelake.shipping import ship

from ..conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid int, name string, n int, cls int, label int, size int, uid int"


def docs_of(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, "en", s, None, 0, "x", 0, 0, 0, 0, 0) for i, t, s in rows], SCHEMA)


def awkward(spark):
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, "One two three four five six", "b"), (5, "one TWO three four five six", "b"), (6, long, "b"), (7, long, "c"), (None, "no id here at all today", "c"), (8, "twice", "a"), (8, "twice", "a"), (9, "É\U0001f600 x", "")]
    return docs_of(spark, rows)


def small(spark, name="documents"):
    ship(spark)
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, agrees, name):
    ship(spark)
    agrees(QUERIES[name], ORACLES[name])


def brute_components(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for k, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(k)
    seen = set()
    for k, s in enumerate(sets):
        for j in {j for g in s for j in at[g] if j < k} - seen:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def test_op1_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in small(spark).select("doc_id", "text").collect()]
    draw = random.Random(5)
    for k in range(60):  # edited copies on both sides of the threshold
        i, text = draw.choice(rows[:200])
        w = (text or "").split(" ")
        for _ in range(draw.randrange(1, 6)):
            w[draw.randrange(len(w))] = f"new{draw.randrange(9)}"
        rows.append((10_000 + k, " ".join(w)))
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), chunk_docs=37, block=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


@pytest.mark.parametrize("salt_posts", [3, 4096])
def test_op1_large_groups_meet_candidates_only(spark, monkeypatch, salt_posts):
    monkeypatch.setattr(ngram_join, "SALT_POSTS", salt_posts)
    chain = [(k, " ".join(f"w{n}" for n in range(10 * k, 10 * k + 40))) for k in range(300)]
    copies = [(1000 + k, " ".join(f"c{n}" if n != k else "x" for n in range(90))) for k in range(0, 90, 3)]
    rows = chain + copies
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in ngram_join.ngram_join(docs, block=8).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute_components(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    linked = lambda a, b: a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert {i: r["n_links"] for i, r in found.items()} == {i: sum(linked(i, j) for j in sets) for i in sets}
    heads = spark.createDataFrame([(k, key, 2) for key in range(299) for k in (key, key + 1)], "cls long, key long, members long")
    groups = spark.createDataFrame([(k, 0) for k in range(300)], "node long, component long")
    dealt = ngram_join.dealt_classes(heads, groups, 8)
    assert dealt.count() <= 600 and dealt.where("own <> other").count() > 0  # not 300 classes x 38 blocks


def test_op1_heap_merge_counts_lists():
    draw = np.random.default_rng(3)
    for _ in range(50):
        lists = [np.sort(draw.choice(40, draw.integers(1, 20), replace=False)) for _ in range(draw.integers(1, 12))]
        members, times = ngram_join.heap_merged(lists)
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        assert members.tolist() == values.tolist() and times.tolist() == counts.tolist()


@pytest.mark.parametrize("bits", [6, 13, 16, 23])
def test_op1_keys_keep_their_bits(bits):
    keys = np.random.default_rng(bits).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    lost = np.uint64(max(0, 16 - bits))
    for key in keys >> lost << lost:
        one = np.array([key], dtype=np.uint64)
        assert ngram_join._unpacked(ngram_join._packed(one, bits), int(key) >> (64 - bits), bits)[0] == key


def test_op1_awkward(spark):
    found = ngram_join.ngram_join(awkward(spark)).collect()
    assert len(found) == 11 and {r["doc_id"]: r["component_id"] for r in found if r["doc_id"]}[7] == 6
    assert {r["doc_id"]: r["n_links"] for r in found}[8] == 1 and {r["doc_id"]: r["n_shingles"] for r in found}[2] == 0


def test_op2_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = small(spark).union(spark.createDataFrame([(900_001, 'a <|endoftext|> b', 'en', 's', 17)], small(spark).schema))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = packing.pack_documents(docs).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in texts.items():
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["piece"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    least = -(-sum(p["length"] for p in pieces) // 2048)
    assert len(by_sequence) <= 1.05 * least + 1


def water_filled(sizes):
    """Targets by weight 1, 2, 3, repeating over sources in order (null last), none above 3 times its size, one pass after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full, left = {s: 1 + k % 3 for k, s in enumerate(order)}, {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_op3_meets_targets(spark):
    found = mixing.mix_sources(small(spark)).collect()
    by = {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        held = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        held[0] += r["taken"]
    expected = water_filled({source: size for source, (_, _, size) in by.items()})
    assert {source: target for source, (_, target, _) in by.items()} == {source: pytest.approx(t, rel=1e-9) for source, t in expected.items()}
    assert all(abs(taken - target) <= 0.02 * target + 60 for taken, target, _ in by.values())
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(small(spark).repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in found}


def test_op4_awkward(spark):
    found = exact_dedup.exact_dedup(awkward(spark), block_chars=7).collect()
    kept = [r["doc_id"] for r in found if r["kept"]]
    assert len(found) == 11 and sorted(map(str, kept)) == sorted(map(str, [2, 3, 5, 7, None, 8, 9]))
    assert {r["doc_id"]: r["text_sha256"] for r in found}[1] == hashlib.sha256(b"").hexdigest()


def held_out(found, labels, label):
    """Area under the curve, precision and recall of label 1 over the held-out rows."""
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and truth.get(r["doc_id"]) is not None]
    good, bad = [s for s, _, t in rows if t == 1], [s for s, _, t in rows if t == 0]
    hits = sum(p for _, p, t in rows if t == 1)
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)), hits / max(1, sum(p for _, p, _ in rows)), hits / len(good)


def test_op5_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    ship(spark)
    found = toxicity.toxicity(docs, labels).collect()
    area, precision, recall = held_out(found, labels, "toxic")  # a constant gives 0.5, 0 and 0
    assert len(found) == docs.count() and area >= 0.8 and precision >= 0.6 and recall >= 0.6, (area, precision, recall)


def test_op5_gapped_insults_stay_close():
    negative = ["table", "window", "garden", "paper", "river", "silver", "market", "bottle"] * 4
    machine = toxicity.fit_machine(["blorgface", "blorgfaces", "zubnik"] * 4, negative)
    plain, gapped, clean = machine.of_tokens(["blorgface", "blo-r.gxface", "garden"])
    assert plain > 0 and gapped > clean and clean < 0


def test_op7_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    ship(spark)
    area, precision, recall = held_out(quality.quality(docs, labels).collect(), labels, "quality")  # of a constant 0.5; 59 of 70 rows are good
    assert area >= 0.95 and precision >= 0.95 and recall >= 0.9, (area, precision, recall)


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_scores_of_awkward_tables(spark, score):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    found = score(awkward(spark), none).collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)


def test_op6_layouts_and_round_trip(spark):
    records = [
        (1, '{"prompt": "p<|im_end|>", "completion": "c"}'), (2, '{"instruction": "i", "input": null, "output": "o"}'), (3, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}'),
        (4, '{"strange": 1}'), (5, None), (6, "{"), (7, '{"messages": []}'), (8, '{"messages": [{"role": "a\\nb", "content": "<|<\\\\|"}]}'),
    ]
    ship(spark)
    found = {r["id"]: r for r in chat.format_chats(spark.createDataFrame(records, "id long, record string")).collect()}
    read = lambda i: [(role, said) for role, said, _, _ in chat.parse(found[i]["formatted"])]
    assert read(1) == [("user", "p<|im_end|>"), ("assistant", "c")] and read(2) == [("user", "i"), ("assistant", "o")] and read(3) == [("user", "h"), ("assistant", "g")]
    assert found[4]["formatted"] is found[5]["formatted"] is found[6]["formatted"] is None and read(7) == [] and read(8) == [("a\nb", "<|<\\|")]


def test_op8_deletes_later_runs_only(spark):
    draw = random.Random(2)
    line = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(5, 12)))
    shared = [line() for _ in range(12)]
    short = [line() for _ in range(2)]
    rows = [(1, "\n".join([line(), *shared, line(), *short]), "a"), (2, "\n".join([line(), line(), *shared, "", line()]), "a"), (3, "\n".join([line(), *short, line()]), "a"), (4, None, "a"), (5, "\n".join([*shared, line(), *shared]), "a")]
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert [found[k]["removed_lines"] for k in (1, 2, 3, 4, 5)] == [0, 12, 0, 0, 24]
    assert found[1]["text"] == rows[0][1] and found[3]["text"] == rows[2][1] and found[4]["text"] == ""


def test_op8_finds_runs_of_any_earlier_place(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    head = words("head", 30)
    rows = [(1, f"{head}\n{words('a', 22)}", "a"), (2, f"{head}\n{words('b', 22)}", "a"), (3, f"{head}\n{words('c', 22)}", "a"), (4, f"{head}\n{words('b', 22)}", "a")]
    found = {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 4: 2}


def test_op8_equals_brute_force(spark):
    draw = random.Random(8)
    pool = [" ".join(f"w{k}x{j}" for j in range(draw.choice([1, 3, 10, 24, 26, 49, 50, 60]))) for k in range(7)] + [""]
    rows = [(k, "\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 12))), "a") for k in range(80)]
    lines = [(i, k, x) for i, text, _ in rows for k, x in enumerate(text.split("\n")) if x]
    expected = {i: set() for i, *_ in rows}
    for b in range(len(lines)):
        for a in range(b):
            n = 0
            while b + n < len(lines) and lines[b + n][2] == lines[a + n][2] and lines[a + n][0] == lines[a][0] and lines[b + n][0] == lines[b][0]:
                n += 1
            if sum(len(x.split(" ")) for *_, x in lines[b : b + n]) >= 50:
                expected[lines[b][0]] |= set(range(lines[b][1], lines[b + n - 1][1] + 1))
    found = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert found == {i: "\n".join(x for k, x in enumerate(text.split("\n")) if k not in expected[i]) for i, text, _ in rows}


def test_op8_deletes_only_lines_that_equal_their_source(spark):
    draw = random.Random(3)
    line = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(20))
    shared, own = [line() for _ in range(9)], [[line() for _ in range(4)] for _ in range(2)]
    docs = [[*own[0], *shared, line()], [own[1][0], *shared, *own[1][1:]]]
    number = lambda x: (hash(x) % 2**40, hash(x) % 2**20, 20)
    kind = "uid string, ks array<int>, hs array<long>, cs array<int>, ws array<long>"
    base = spark.createDataFrame([(f"d{k}", list(range(0, 2 * len(d), 2)), *map(list, zip(*map(number, d)))) for k, d in enumerate(docs)], kind)
    seeds = lambda *rows: spark.createDataFrame([("d1", "d0", *row) for row in rows], "uid string, source string, shift int, first int, last int")
    runs = lambda *rows: [[tuple(run) for run in r["runs"]] for r in line_dedup.extended(seeds(*rows), base).collect()]
    assert runs((-3, 4, 6)) == [[(2, 18)]]  # on to both ends of the shared lines, positions as among all lines
    assert runs((-3, 4, 6), (-3, 7, 9), (0, 1, 12)) == [[(2, 18)]]
    assert runs((-2, 4, 6), (3, 3, 5)) == []  # a match at a wrong distance deletes nothing


JOINED = line_dedup.joined_positions


def test_op8_fingerprints_choose_places_only(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plain = sorted(map(tuple, line_dedup.line_dedup(docs).collect()), key=str)
    assert sum(r[2] for r in plain) > 0
    everywhere = lambda lines, *_: lines.select("uid", "ord", "pos", F.lit(1).cast("long").alias("shingle"))
    monkeypatch.setattr(line_dedup, "fingerprints", everywhere)
    assert sorted(map(tuple, line_dedup.line_dedup(docs).collect()), key=str) == plain
    monkeypatch.setattr(line_dedup, "joined_positions", lambda found: JOINED(found).where("false"))
    assert all(r["removed_lines"] == 0 for r in line_dedup.line_dedup(docs).collect())


def test_op8_sources_of_very_many_matches(spark):
    run = "\n".join(" ".join(f"w{k}x{j}" for j in range(20)) for k in range(4))
    rows = [(k, f"own line {k}\n{run}", "a") for k in range(700)] + [(1000 + k, "\n".join(" ".join(f"v{k // 2}x{i}x{j}" for j in range(30)) for i in range(2)), "a") for k in range(40)]
    found = {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert found == {k: 4 if 0 < k < 700 else 2 if k >= 1000 and k % 2 else 0 for k, *_ in rows}


def test_op9_round_trip_and_lacing(spark):
    found = {r["doc_id"]: r for r in matroska.media_digests(matroska.to_media(small(spark))).collect()}
    for r in small(spark).select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        mine = found[r["doc_id"]]
        assert (mine["n_bytes"], mine["payload_bytes"], mine["payload_sha256"], mine["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    frames = [b"a" * 300, b"b" * 2, b"c" * 700]
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        block = matroska.block_bytes(1, 5, frames, lacing)
        _, relative, key, kind, places = matroska.frames_of(block, 0, len(block))
        assert (relative, key, kind) == (5, True, lacing) and [block[a : a + n] for a, n in places] == frames
    assert matroska.packets(spark.createDataFrame([(1, None), (2, b"junk")], "doc_id long, media binary")).count() == 0


def test_op10_articles(spark):
    shell = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a>Home</a></nav><article><h1>T {k}</h1><p>One &amp; two\n {k}</p><aside>ad</aside><p>Three<br>four</p></article><div class="comments"><p>hi</p></div><footer>f</footer></body></html>'
    rows = [(k, f"http://h.example/{k}", shell.replace("{k}", str(k))) for k in range(6)] + [(9, None, None), (10, "u", "")]
    ship(spark)
    found = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "T 3\nOne & two 3\nThree four" and found[9] == found[10] == ""


@pytest.mark.parametrize("page", [
    "<article>p1<section class=comments><article>c1</article><article>c2</article></section><p>p2</p></article>",
    "<article>p1<article class=comment>c1<article>c2</article></article><p>p2</p></article>",
    "<article>p1<p>p2</p></article><div class=comments><article>c1</article><article>c2</article></div><article class=comment>c3</article>",
    "<form><article>p1<aside><article>c1</aside><p>p2</p></article></form>",
])
def test_op10_comments_that_are_articles(page):
    region = next(role for role in html_extraction.Page(page).roles if role.endswith("<article>"))
    for template in (None, html_extraction.Template(region=region)):
        assert html_extraction.extract(page, template) == "p1\np2"


def test_op10_keeps_what_an_article_says():
    page = '<article><p class="share price">a</p><p class="related-work">b</p><figure><img src=x><figcaption>c</figcaption></figure><div class="share">d</div><section class="post related-posts">e</section></article>'
    assert html_extraction.extract(page, None) == "a\nb\nc"


def test_op10_hosts_without_telling_names(spark):
    """Menus and adverts that vary as articles do, and no name or tag that tells them apart: the text is where most of it is."""
    draw = random.Random(10)
    words = lambda n: " ".join(draw.choice("abcdefgh") * 4 for _ in range(n))
    rows, expected = [], {}
    for host, (menu, text, end) in enumerate([("u1", "u2", "u3"), ("x", "y", "z"), ("k9", "k8", "k7")]):
        for k in range(8):
            article, other = [words(30), words(20)], [words(4), words(5)]
            body = "".join(f"<p>{x}</p>" for x in article) + "<div class=m>Always the same line</div>"
            parts = [f'<div class="{menu}">{other[0]}</div>', f'<div class="{text}">{body}</div>', f'<div class="{end}">{other[1]}</div>']
            i = 100 * host + k
            rows.append((i, f"https://h{host}.example/{k}", "<html><body>" + "".join(parts if host < 2 else parts[::-1]) + "</body></html>"))
            expected[i] = "\n".join(article)
    ship(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "own", "template", "cut", "kind", "a", "total")})
    found = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages.unionAll(pages.where("page_id % 2 = 0"))).collect()}
    assert found == expected
    assert all(html_extraction.extract(page, html_extraction.Template()) != expected[i] for i, _, page in rows)


def test_op10_template_without_article(spark):
    shell = '<html><body><div id="top"><p>The daily site</p><p>All rights reserved</p></div><div id="text"><h1>T {k}</h1><p>Words of {k}</p><p>Same on all</p></div><div id="end"><p>Printed on paper</p></div></body></html>'
    rows = [(k, f"http://h.example/{k}", shell.replace("{k}", str(k))) for k in range(5)]
    rows += [(10 + k, "http://copies.example/", shell.replace("{k}", "1")) for k in range(4)]  # nothing shows what varies
    ship(spark)
    found = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"T {k}\nWords of {k}\nSame on all" for k in range(5))
    assert found[10] == "The daily site\nAll rights reserved\nT 1\nWords of 1\nSame on all\nPrinted on paper"


def test_op10_template_tokens_are_ordered_and_nested(spark):
    rows = [(k, "http://h.example/", f"<main><b>{k}</b>" + ("<i></i><u></u>" if k % 2 else "<u></u><i></i>") + "</main>") for k in range(6)]
    ship(spark)
    found = {r["host"]: r["tokens"] for r in html_extraction.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found["h.example"] == ["<page>", " <main>", "/main <b>", "/main </b>", " </main>"]


def test_empty_tables(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for frame in (ngram_join.ngram_join(none), packing.pack_documents(none), mixing.mix_sources(none), exact_dedup.exact_dedup(none), toxicity.toxicity(none, labels), quality.quality(none, labels), line_dedup.line_dedup(none), matroska.media_digests(matroska.to_media(none)), html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert frame.count() == 0


def test_awkward_rows_pass(spark):
    assert packing.pack_documents(awkward(spark)).select("doc_id", "piece").distinct().count() > 11
    assert mixing.mix_sources(awkward(spark)).count() == 11
    assert line_dedup.line_dedup(awkward(spark)).count() == 11


def test_pipeline(spark):
    ship(spark)
    docs = small(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == small(spark).columns
    assert docs.count() > 0 and docs.select("sequence_id").distinct().count() > 0


def test_op2_plan_uses_lengths_up():
    draw = np.random.default_rng(1)
    for _ in range(20):
        histogram = np.zeros(13, dtype=np.int64)
        for length in draw.integers(1, 13, draw.integers(1, 9)):
            histogram[length] += 1
        used, sequences = np.zeros(13, dtype=np.int64), 0
        for lengths, count in packing.packing_plan(histogram, 12):
            assert sum(lengths) <= 12
            sequences += count
            for length in lengths:
                used[length] += count
        assert used.tolist() == histogram.tolist() and sequences <= least_sequences(tuple(k for k in range(12, 0, -1) for _ in range(histogram[k])), 12) + 1


def least_sequences(lengths, size):
    """The fewest sequences, by trying each place for each length."""
    best = len(lengths)

    def put(k, left):
        nonlocal best
        if len(left) >= best:
            return
        if k == len(lengths):
            best = len(left)
            return
        for j in sorted({x: j for j, x in enumerate(left) if x >= lengths[k]}.values()):
            put(k + 1, [x - lengths[k] * (i == j) for i, x in enumerate(left)])
        put(k + 1, [*left, size - lengths[k]])

    put(0, [])
    return best


def test_op2_salts_do_not_change_the_layout(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 3)
    pieces = spark.createDataFrame([(k, 0, 0, 1 + k % 5, k) for k in range(200)], packing.PIECES)
    by = {}
    for r in packing.pack(pieces, 12).collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, by.values())) == 200 and len(by) <= 51
    for found in by.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) <= 12


def test_op3_reruns_agree_however_rows_are_dealt(spark):
    docs = small(spark)
    docs = docs.unionAll(docs.where("doc_id % 7 = 0"))  # repeated rows
    runs = []
    for frame in (docs, docs.repartition(7), docs.orderBy("text").coalesce(2)):
        runs.append(sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_sources(frame, group=8).collect()))
    assert runs[0] == runs[1] == runs[2]


def test_op3_mixed_rows_keep_their_columns(spark):
    docs = awkward(spark).withColumn("__r", F.lit(1)).withColumn("__k2", F.lit(2)).withColumn("s", F.lit("x")).withColumn("docs", F.lit(5))
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    planned = sum(r["repeats"] for r in mixing.mix_sources(docs).collect())
    assert taken.count() == planned > 0


def test_op4_keeps_rows_not_ids(spark):
    rows = [(8, "a", "x"), (8, "b", "x"), (9, "A", "x"), (9, "A", "x"), (None, None, None), (None, "", None)]
    kept = exact_dedup.keep_one_of_each(docs_of(spark, rows))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == [("8", "b"), ("9", "A"), ("None", "")]


@pytest.mark.parametrize(("operator", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_scores_fitted_on_awkward_rows(spark, operator, label):
    good = [(k, f"Plain words about gardens and rivers number {k}. They flow.", "a") for k in range(100, 160)]
    bad = [(k, f"you zorgle {k} ### $$$ zorgles everywhere zorgle", "a") for k in range(200, 230)]
    docs = awkward(spark).unionAll(docs_of(spark, [*good, *bad, *good[:9]]))
    marks = [(i, int(label == "quality"), 0) for i, *_ in good] + [(i, int(label == "toxic"), 0) for i, *_ in bad] + [(1, 0, 0), (2, None, 0), (None, 1, 0), (6, 0, 0), (101, 0, 0), (7, 1, 0)]
    labels = spark.createDataFrame(marks, f"doc_id long, {label} int, source int")
    found = operator(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    side = {r["doc_id"]: r["score"] for r in found}
    higher, lower = (bad, good) if label == "toxic" else (good, bad)
    assert min(side[i] for i, *_ in higher) > max(side[i] for i, *_ in lower)
    again = {r["doc_id"]: r["score"] for r in operator(docs.repartition(5), labels.repartition(3)).collect()}
    assert all(again[i] == pytest.approx(side[i], abs=1e-6) for i in side)


def test_op6_awkward_records(spark):
    deep = '{"messages": ' + "[" * 3000 + "]" * 3000 + "}"
    records = [(1, '{"messages[].role": 1}'), (2, deep), (3, '{"messages": [{"role": null, "content": null}, "loose"]}'), (3, "[]"), (4, '{"prompt": {"a": 1}, "completion": ["b"]}'), (None, "7")]
    ship(spark)
    frame = spark.createDataFrame(records, "id long, record string").withColumn("mapping", F.lit("clash")).withColumn("formatted", F.lit("clash"))
    found = chat.format_chats(frame).collect()
    assert [r["mapping"] for r in sorted(found, key=lambda r: (r["id"] or 99, r["mapping"] or ""))] == [None, None, None, "messages", "prompt-completion", None]
    turns = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "a"), (2, 1, "assistant", "x" * 200_000)], "conv_id long, turn long, role string, text string").withColumn("id", F.lit(9))
    read = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(chat.conversation_records(turns))).collect()}
    assert read[1]["n_turns"] == 4 and read[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\na\nuser\na\nuser\nb\n").hexdigest() and read[2]["loss_chars"] == 200_000
    assert chat.read_back(chat.format_chats(chat.conversation_records(turns.where("false")))).count() == 0


def test_op9_awkward_files_and_times(spark):
    ship(spark)
    docs = awkward(spark).withColumn("media", F.lit("clash")).withColumn("n_bytes", F.lit(-1))
    media = matroska.to_media(docs)
    assert media.count() == 11 and {r["n_bytes"] for r in media.where("doc_id in (1, 2)").collect()} == {0}
    times = [r["timestamp_ms"] for r in matroska.packets(media.where("doc_id = 6")).orderBy("packet").collect()]
    assert times == [24 * k for k in range(len(times))] and len(times) > 600
    whole = media.where("doc_id = 6").first()["media"]
    damaged = spark.createDataFrame([(1, 1, None), (2, 1, b"junk"), (3, 1, bytes(whole[:40])), (4, 1, bytes(whole[:5000]))], "doc_id long, n_bytes long, media binary")
    found = {r["doc_id"]: r["payload_bytes"] for r in matroska.media_digests(damaged).collect()}
    assert found[1] is found[2] is None and len(found) == 4
    digests = matroska.media_digests(media).where("doc_id = 8").collect()
    assert len({tuple(r)[1:] for r in digests}) == 1 and digests[0]["media_sha256"] == hashlib.sha256(media.where("doc_id = 8").first()["media"]).hexdigest() and "in_time=1" in digests[0]["feature"]


def test_op8_awkward(spark):
    run = "\n".join(" ".join(f"w{k}x{j}" for j in range(20)) for k in range(4))
    rows = [(1, run, "a"), (1, run, "a"), (2, None, "a"), (3, "", "b"), (4, " \n\n ", "b"), (None, f"x\n{run}", "c"), (5, f"{run}\n{run}\nend", "c")]
    docs = docs_of(spark, rows).withColumn("uid", F.lit(1)).withColumn("runs", F.lit(2)).withColumn("lines", F.lit(3))
    found = sorted(((str(r["doc_id"]), r["n_lines"], r["removed_lines"]) for r in line_dedup.line_dedup(docs).collect()))
    assert found == [("1", 4, 0), ("1", 4, 0), ("2", 1, 0), ("3", 1, 0), ("4", 3, 0), ("5", 9, 8), ("None", 5, 4)]


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    ship(spark)
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, None, None)], "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = awkward(spark).withColumn("__k", F.lit(1)).withColumn("__id", F.lit(2)).withColumn("__n", F.lit(3))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:2]):
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


@pytest.mark.parametrize("count", [2, 4, 5, 9])
def test_op10_article_in_two_elements_at_any_number_of_pages(spark, count):
    draw = random.Random(count)
    words = lambda n: " ".join(draw.choice("abcdefgh") * 4 for _ in range(n))
    rows, expected = [], {}
    for k in range(count):
        text, end = [words(30), words(25)], [words(8)]
        parts = f'<div class="t">{words(3)}</div><div class="a"><p>{text[0]}</p><p>{text[1]}</p></div><div class="b"><p>{end[0]}</p></div><div class="l"><p>Free to use</p></div><div class="x">{words(4)}</div>'
        rows.append((k, "https://two.example/", f"<html><body>{parts}</body></html>"))
        expected[k] = "\n".join([*text, *end])
    ship(spark)
    found = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == expected
