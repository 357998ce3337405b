"""Each corpus operator against a brute-force version, an exact round trip or held-out accuracy, on small fixtures."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pixelloom.llm import chat, components, decontaminate, fingerprint, hidden_markov, language_id, licenses, near_dedup, packing, shared, toxicity, warc

SYLLABLES = "ka lo mi ten ru sha ve po ni dar el qu is ost".split()
FOLD = str.maketrans(shared.UPPER, shared.LOWER)


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def documents(spark, rows):
    """With extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, lang string, score double")


ODD_TEXTS = [None, "", "   \n\t ", "Ärger É İstanbul", "word", "x" * 5000, "a b c d", "a b c d", "🙂 " * 30]


@pytest.mark.parametrize("separators, pattern", [(shared.SPACE_SEPARATORS, r"[^\x20\x09-\x0D]+"), (shared.PUNCT_SEPARATORS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_tokenizer(separators, pattern):
    r = random.Random(1)
    texts = [*ODD_TEXTS, *(prose(r, 40) + r.choice([".", "!?", "\r\n", "Ñ-"]) for _ in range(30))]
    for at_once in (50, 1 << 20):
        w = shared.Tokenizer(separators).words(texts, at_once)
        expected = [re.findall(pattern, (t or "").translate(FOLD)) for t in texts]
        assert w.counts.tolist() == [len(x) for x in expected]
        flat = list(itertools.chain(*expected))
        assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == flat
        assert len(set(w.hash.tolist())) == len(set(flat)) == len(set(zip(flat, w.hash.tolist())))


def near_brute(rows):
    sets, parent = {}, {i: i for i, _ in rows if i is not None}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in parent}


def test_near_dedup(spark):
    r = random.Random(2)
    base = prose(r, 150).split()
    rows = list(enumerate(ODD_TEXTS))
    for k in range(120):  # near copies of all degrees around the threshold
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(len(own))] = f"new{k}{r.random()}"
        rows.append((100 + k, " ".join(own)))
    rows += [(300 + k, prose(r, 60)) for k in range(40)] + [(400, rows[50][1]), (401, rows[50][1])]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.dedupe(documents(spark, rows)).collect()}
    assert got == near_brute(rows)
    assert near_dedup.dedupe(documents(spark, [])).count() == 0


def test_near_dedup_makes_pairs_once(spark, monkeypatch):
    """Pairs are cut from what made them before sets are compared; links that only the second round finds, in blocks."""
    r = random.Random(22)
    seen, confirmed = [], near_dedup.confirmed

    def spied(pairs, *args):
        seen.append(pairs._jdf.queryExecution().analyzed().toString())
        return confirmed(pairs, *args)

    monkeypatch.setattr(near_dedup, "confirmed", spied)
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    rows = []
    for k in range(2):  # the documents of least ids share buckets with the near copies behind them, but are not like them
        base = prose(r, 80).split()
        for i in range(66):
            own = list(base)
            for place in r.sample(range(80), 4 if i < 60 else 1):
                own[place] = f"new{r.random()}"
            rows.append((100 * k + i, " ".join(own)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.dedupe(documents(spark, rows)).collect()}
    assert got == near_brute(rows)
    assert len(seen) > 1 and not any("MapInPandas" in plan for plan in seen)


def test_components_extended(spark):
    """Components of edges that come in two parts, with null ends and loops."""
    r = random.Random(23)
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for many in (0, 90):
        parts = [[*((r.randrange(120), r.randrange(120)) for _ in range(n)), (None, 3), (5, None), (7, 7)] for n in (many, 40)]
        least = {i: i for i in range(120)}
        for _ in range(120):
            for a, b in itertools.chain(*parts):
                if a is not None and b is not None:
                    least[a] = least[b] = min(least[a], least[b])
        want = sorted((i, c) for i, c in least.items() if i != c)
        known = components.connected(table(parts[0]))
        assert sorted(map(tuple, components.extended(known, table(parts[1])).collect())) == want
        assert sorted(map(tuple, components.connected(table(parts[0] + parts[1])).collect())) == want


def test_near_dedup_in_many_blocks(spark, monkeypatch):
    """Buckets of several blocks and cells of sizes: every pair of documents that may be linked meets in exactly one pair of blocks."""
    r = random.Random(21)
    rows = [(h, 40 if h else 3, i, r.choice([10, 12, 13, 14, 30, 31, 40, 41, 55])) for h in (0, 1, 2) for i in range(40 if h else 3)]
    df = spark.createDataFrame(rows, "_h long, _many long, _rep long, _n long")
    met = collections.defaultdict(list)
    for x in near_dedup.blocked(df, 5).collect():
        met[x["_h"], x["_i"], x["_j"]].append((x["_rep"], x["_n"], x["_block"]))
    pairs = collections.Counter()
    for (h, i, j), own in met.items():
        for a, b in itertools.combinations(own, 2):
            if i == j or a[2] != b[2]:
                pairs[h, min(a[0], b[0]), max(a[0], b[0])] += 1
    size = {(h, i): n for h, _, i, n in rows}
    for h, many in ((0, 3), (1, 40), (2, 40)):
        for a, b in itertools.combinations(range(many), 2):
            small, large = sorted((size[h, a], size[h, b]))
            assert pairs[h, a, b] == 1 or (pairs[h, a, b] == 0 and 100 * small < 75 * large)
    assert not any(pairs[1, a, b] for a in range(40) for b in range(a + 1, 40) if size[1, a] <= 14 and size[1, b] >= 40)


def test_decontamination(spark):
    r = random.Random(3)
    items = [(k, prose(r, n)) for k, n in enumerate([25, 10, 4, 0, 12])] + [(9, None)]
    rows = list(enumerate(ODD_TEXTS)) + [(50 + k, " ".join([prose(r, 8), items[k % 5][1].upper(), "ka", items[(k + 1) % 5][1][:40]])) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = [(str(k), tuple(w[s : s + 10])) for k, t in items for w in [words(t)] if w for s in range(max(1, len(w) - 9))]
    for portion in (100_000, 7):
        for x in decontaminate.overlaps(documents(spark, rows), bench, portion=portion).collect():
            w = words(dict(rows)[x["doc_id"]])
            hit, found = set(), set()
            for k, own in windows:
                for s in range(len(w) - len(own) + 1):
                    if tuple(w[s : s + len(own)]) == own:
                        hit |= set(range(s, s + len(own)))
                        found.add(k)
            assert (x["n_words"], x["n_hit"], x["n_items"], x["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
            assert x["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_pipeline_rejects_rows(spark, tmp_path):
    """Near-duplicates and decontamination with null and repeated ids; a text's first row in the order of ids stays."""
    r = random.Random(10)
    item, a, b, c, d = (prose(r, n) for n in (12, 40, 40, 40, 40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(5, a), (5, d), (7, f"{d} x {item} {b}"), (7, b), (7, b), (8, None), (9, a + " ka lo"), (None, f"{item} {a} {c}"), (None, c), (None, c), (None, a + " ka lo"), (None, "")]
    kept = lambda stage, rows: sorted(((x["doc_id"], x["text"]) for x in stage(spark, documents(spark, rows), str(tmp_path)).collect()), key=repr)
    components = near_brute([(k, t) for k, (_, t) in enumerate(rows)])
    assert kept(corpus_pipeline.near_duplicates, rows[::-1]) == sorted((x for k, x in enumerate(rows) if components[k][1] == k), key=repr)
    assert kept(corpus_pipeline.decontaminated, rows) == sorted(((i, t) for i, t in rows if item not in (t or "")), key=repr)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontaminated):
        assert kept(stage, []) == []
        assert stage(spark, documents(spark, rows), str(tmp_path)).columns == ["doc_id", "text", "lang", "score"]


def test_licenses(spark):
    rows = [*enumerate(ODD_TEXTS), (20, "x\nReleased under the MIT License.\nAll rights reserved."), (21, "licensed under cc BY-NC 4.0"), (22, "the mit license"), (23, "under the MIT license")]
    got = {x["doc_id"]: x for x in licenses.scan(documents(spark, rows)).collect()}
    assert (got[20]["labels"], got[20]["n_base"], got[20]["first_word"]) == ("mit,reserved", 1, 6)
    assert (got[21]["base_labels"], got[21]["labels"], got[21]["score"]) == ("cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert (got[22]["labels"], got[23]["labels"], got[23]["score"]) == ("", "mit", 0.8)
    assert got[0]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["labels"] == "" and len(got) == len(rows)


def test_licenses_over_line_ends(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy"
    apache = "Licensed under the\nApache License, Version 2.0"
    rows = [(1, bsd), (2, mpl), (3, apache), (4, "licensed under CC BY 4.0"), (5, "x " * 3000 + "\n\n" + apache.replace(" ", "\n") + " y" * 3000), (6, "Licensed under the Apache\nSoftware License, Version 1.0"), (7, None), (3, apache), (None, mpl)]
    rows += [(20 + k, "released under " + "x " * k + "the\nMIT license") for k in range(8)]
    got = sorted(((x["doc_id"] or 0, x["labels"], x["score"]) for x in licenses.scan(documents(spark, rows)).collect()))
    # With one word too many a window still holds 4 of the 5 words.
    loose = [(20 + k, "mit" if k <= licenses.SLACK + 1 else "", 1.0 if k <= licenses.SLACK else 0.8 if k == licenses.SLACK + 1 else 0.0) for k in range(8)]
    assert got == [(0, "mpl-2.0", 1.0), (1, "bsd", 1.0), (2, "mpl-2.0", 1.0), (3, "apache-2.0", 1.0), (3, "apache-2.0", 1.0), (4, "cc-by", 1.0), (5, "apache-2.0", 1.0), (6, "", 0.0), (7, "", 0.0), *loose]


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "a\\[INST]", "\n[INST] x [ROLE] y", "", None, " [NEXT] ", "x\\", "<s> "]
    rows = [(c, t, role, text) for c in (1, 2, None) for t, (role, text) in enumerate(zip(itertools.cycle(["user", "user", "assistant", "assistant", None, "[ROLE] odd"]), nasty))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for x in chat.format_chats(df).select("conv_id", "formatted", "segments", chat.read_back(chat.F.col("formatted")).alias("t")).collect():
        own = [(r or "", t or "") for c, _, r, t in rows if c == x["conv_id"]]
        assert [tuple(t) for t in x["t"]] == own
        assert len([s for s in x["segments"] if s["loss"]]) == sum(r == "assistant" for r, _ in own)
        assert "".join(s["text"] for s in x["segments"]) == x["formatted"]


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"http://a/{k} b\r\nX: y", f"<p>{k % 3}é</p>" * 50) for k in range(40)] + [(100, None, None), (101, "u", ""), (102, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(pages, folder, shard_bytes=4000, roll_bytes=1500)
    assert manifest.count() > 3
    first, got = {}, {x["page_id"]: x for x in warc.read(spark, folder).collect()}
    for i, _, h in sorted(rows, key=lambda x: x[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        x = got[i]
        assert x["sound"] and x["payload_bytes"] == len((h or "").encode()) and x["payload_digest"] == warc.digest((h or "").encode())
        assert (x["record_type"], x["refers_to"]) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    again = f"file://{tmp_path}/b"
    warc.write(pages.repartition(2), again, shard_bytes=4000, roll_bytes=1500)
    files = {k: sorted(p.relative_to(tmp_path / k) for p in (tmp_path / k).rglob("*") if p.is_file() and not p.name.endswith(".crc")) for k in "ab"}
    assert files["a"] == files["b"] and all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files["a"])
    assert not any(f.name.startswith(".") for f in files["a"])


def test_warc_far_hot_and_repeated_ids(spark, tmp_path):
    """Far ids keep many shards; null and repeated ids are dealt to several; each row has its record."""
    big = 2**60 + 1
    rows = [(k, f"u{k}", f"{k} " * 100) for k in range(200)] + [(big, "far", "0 " * 100), (big + 1, "far", "other")]
    rows += [(50, f"v{k}", f"{k % 4} " * 150) for k in range(100)] + [(None, f"n{k}", f"null {k}" * 30) for k in range(60)] + [(7, "same", "same")] * 3
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, _page int")
    folder = f"file://{tmp_path}/a"
    shards = warc.write(pages, folder, shard_bytes=20_000, roll_bytes=3000).groupBy("shard").count().count()
    assert shards > 12
    got = warc.read(spark, folder).collect()
    assert all(x["sound"] for x in got)
    assert collections.Counter((x["page_id"], x["payload_digest"]) for x in got) == collections.Counter((i, warc.digest(h.encode())) for i, _, h in rows)
    for h in {h for *_, h in rows}:
        same = [x for x in got if x["payload_digest"] == warc.digest(h.encode())]
        ids = [i for i, _, own in rows if own == h]
        first = None if None in ids else min(ids)
        assert [x["page_id"] for x in same if x["record_type"] == "response"][:1] == [first]
        assert all(x["refers_to"] == first for x in same if x["record_type"] == "revisit")
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_fingerprint(spark):
    r = random.Random(4)
    rows = [*enumerate(ODD_TEXTS), *((50 + k, prose(r, 80)) for k in range(60))]
    texts = [t or "" for _, t in rows]
    got = sorted(fingerprint.compare(documents(spark, rows).repartition(4), bucket=10).collect(), key=lambda x: x["doc_id"])
    assert [x["doc_id"] for x in got] == [i for i, _ in rows]
    for x, t, n in zip(got, texts, texts[1:] + texts[:1]):
        assert x["edited_sha256"] == hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest()
        assert x["fingerprint"] == fingerprint.written_out(fingerprint.samples([t])[0])

    def weights(t):
        c = collections.Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(FOLD)))
        return {k: math.sqrt(v) * len(k.encode()) for k, v in c.items()}

    errors = []
    for k in range(300):  # words of their own for each pair: all pairs share the seeds, so common words would err alike
        a, b = (" ".join(f"{r.choice(SYLLABLES)}{r.choice(SYLLABLES)}{k}" for _ in range(80)) for _ in range(2))
        x, y = weights(a), weights(b)
        j = sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
        s, t = fingerprint.samples([a, b])
        errors.append(fingerprint.likeness(s, t) - j)
    assert abs(np.mean(errors)) < 0.02


def test_packing(spark):
    r = random.Random(5)
    for _ in range(20):
        hist = {n: r.randint(1, 9) for n in r.sample(range(1, 40), 8)}
        for k in (1, 3, 5):
            best = min(packing.padding(hist, [*c, max(hist)]) for c in itertools.combinations(sorted(hist)[:-1], k - 1))
            bounds = packing.best_bounds(hist, k)
            assert len(bounds) <= k and packing.padding(hist, bounds) == best
    rows = [*enumerate(ODD_TEXTS), *((50 + k, prose(r, r.randint(0, 300))) for k in range(80))]
    got = packing.pack(documents(spark, rows), longest=64, budget=256, buckets=4, slot=7).collect()
    size = collections.Counter()
    for x in got:
        size[x["doc_id"]] += x["n_tokens"]
        assert x["n_tokens"] <= x["bucket"]
    assert size == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for i, t in rows}
    for (_, bucket), own in itertools.groupby(sorted(got, key=lambda x: (x["batch"], x["bucket"], x["place"])), key=lambda x: (x["batch"], x["bucket"])):
        places = [x["place"] for x in own]
        assert places == list(range(len(places))) and len(places) <= max(1, 256 // bucket)
    assert packing.pack(documents(spark, [])).count() == 0


def test_language_id():
    r = random.Random(6)
    kinds = {"a": "ka lo mi ten".split(), "b": "ru sha ve po".split()}
    text = lambda k, n: " ".join("".join(r.choice(kinds[k]) for _ in range(2)) for _ in range(n))
    trees = language_id.Trees({k: [text(k, 30) for _ in range(20)] for k in kinds})
    p = np.exp2(-trees.bits.astype(float))
    np.testing.assert_allclose(p[:, 1:-1].sum(1) + p[:, -1] * (256 - trees.m + 2), 1, atol=1e-5)  # each context is a distribution
    own = [(k, text(k, 5)) for k in kinds for _ in range(50)]
    assert language_id.predict(trees, [t for _, t in own])[0] == [k for k, _ in own]
    lang, score, _ = language_id.predict(trees, [None, "", "12 !", "ka" * 20_000])
    assert lang == ["und", "und", "und", "a"] and score[:3].tolist() == [0, 0, 0]
    assert language_id.predict(language_id.Trees({}), ["x"])[0] == ["und"]


def test_toxicity_gradients_and_accuracy():
    r = random.Random(7)
    texts = [prose(r, 50) + (" vileword " if k % 3 == 0 else " ") + prose(r, 30) for k in range(300)]
    net = toxicity.train(texts, [int(k % 3 == 0) for k in range(300)])
    s = net.scores([prose(r, 60), prose(r, 40) + " vileword", None, ""])
    assert s[0] < 0.5 <= s[1] and s[2] == s[3] < 0.5
    assert toxicity.train(texts, [0] * 300) is None
    x = toxicity.Inputs(texts[:5])
    stream, _, starts = x.stream()
    place = np.flatnonzero(starts)
    grid, y = stream[place + np.arange(toxicity.WINDOW)[:, None]], np.arange(len(place)) % 2
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    g = net.gradients(x, grid, y)

    def loss():
        vec = net.vectors(x).astype(np.float64)
        z = net.forward(grid, [vec @ net.p["Wx"][d] + net.p["b"][d] for d in (0, 1)], len(x.hash))
        return np.mean(np.logaddexp(0, z) - y * z)

    for k in ("Wx", "Wh", "b", "u", "v", "c"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        assert g[k][at] == pytest.approx((up - loss()) / 2e-3, rel=0.05, abs=1e-4), k
        net.p[k][at] = old


def test_hidden_markov(spark):
    r = np.random.default_rng(8)
    s, k = hidden_markov.STATES, 4
    emit = np.zeros((hidden_markov.CLASSES + 1, s))
    emit[:k] = r.dirichlet(np.ones(k), s).T
    model = hidden_markov.Model(r.dirichlet(np.ones(s)), r.dirichlet(np.ones(s), s), emit)
    seq = r.integers(0, k, 4)
    every = sum(
        model.start[p[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([emit[c, q] for c, q in zip(seq, p)])
        for p in itertools.product(range(s), repeat=4)
    )
    counts = hidden_markov.empty_counts()
    got = model.run(np.concatenate([seq, seq[:2]]).astype(np.uint16), np.array([0, 4, 4, 6]), counts)
    assert got[0] == pytest.approx(math.log(every), abs=1e-4) and got[1] == 0
    assert counts[0].sum() == pytest.approx(2, abs=1e-4) and counts[1].sum() == pytest.approx(4, abs=1e-3) and counts[2].sum() == pytest.approx(6, abs=1e-3)
    q = random.Random(9)
    rows = [*enumerate(ODD_TEXTS), *((50 + n, prose(q, 30)) for n in range(60))]
    held = shared.remainder(hidden_markov.F.col("doc_id"), 7) == 2
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), "\n"] for i, t in rows}
    c = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for x in hidden_markov.score(documents(spark, rows), "doc_id", "text", held).collect():
        own = tokens[x["doc_id"]]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(own), sum(w in c for w in own), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) and x["score"] <= 0
