"""The training-data operators against brute force, exact round trips and held-out accuracy, with nulls, ties and repeats."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from roadweave.llm import mixing, neighbours, packing, quality, similarity_join, token_files, toxicity, urls, warc, winnowing
from roadweave.llm.catalog import RULES, vocabulary
from roadweave.llm.shingles import Words, shingle_sets
from roadweave.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORDS = "river stone lamp idle green winter paper cloud seven tower Apple salt".split()


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(i, 3 * i % 97), f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, 2), (101, "", "s0", 3), (None, text(5, 30), "s1", 4), (102, text(20, 60), "s2", 5), (102, text(20, 60), "s2", 5), (103, "x" * 5000, "s0", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int")


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    odd = ["", None, " ", "  a", " a b  c ", "a\n b", "it's I'LL", "日本 x", "á ́b", "<|endoftext|>x"]
    odd += ["".join(rng.choice(" \n\tabéÀß'stre129.,!%µ́日") for _ in range(rng.randrange(50))) for _ in range(500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        whole = Tokenizer.from_file(vocabulary(name))
        whole.encode_special_tokens = True
        with open(vocabulary(name), encoding="utf-8") as f:
            ids, n = Encoder(f.read(), most=300, block=40).encode(odd)
        ends = n.cumsum()
        for x, e, k in zip(odd, ends, n, strict=True):
            assert ids[e - k : e].tolist() == whole.encode(x or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = token_files.token_id_output(docs, vocabulary("byte_bpe_50k.json")).collect()
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_reader_opens_only_the_frames_asked_for(spark, docs, tmp_path):
    folder, files = token_files.write_token_files(docs.repartition(1), vocabulary("byte_bpe_50k.json"), 0, str(tmp_path))
    reader = token_files.IdReader(folder, files.collect()[0]["file"])
    list(reader.ids(0))
    assert reader.opened == 1


def test_chunks_are_tested_for_plain_letters_all_at_once(monkeypatch):
    import re
    from types import SimpleNamespace

    from tokenizers import Tokenizer

    from roadweave.llm import tokens

    calls, whole = [], re.compile(f"[{tokens.LETTERS}0-9!-/:-@\\[-`{{-~\n]*")
    monkeypatch.setattr(tokens, "PLAIN", SimpleNamespace(fullmatch=lambda k: (calls.append(k), whole.fullmatch(k))[1]))
    text = "Plain words, été's\nline 12 日本 ab\x07c  x\n \n\tz é́ — end" + "".join(f" w{i}'ll ñ{i}?" for i in range(500))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        with open(vocabulary(name), encoding="utf-8") as f:
            source = f.read()
        plain = Tokenizer.from_str(source)
        for t in (text, text + "\x00 a\x00b \x00"):
            ids, counts = tokens.Encoder(source).encode([t, None, " ", "\n"])
            want = [plain.encode(x or "", add_special_tokens=False).ids for x in (t, None, " ", "\n")]
            assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
            assert bool(calls) == ("\x00" in t)
            calls.clear()


def test_packing_is_whole(spark, docs):
    pieces = packing.cut_documents(docs, vocabulary("word_bpe_49k.json"), 1, 128)
    rows = packing.pack(pieces, 128, shard=20).collect()
    assert len(rows) == pieces.count() and {r.uid for r in rows} == {r.uid for r in pieces.collect()}
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length <= 512
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 128 + 2


def test_similarity_join_equals_brute_force(spark):
    rng = random.Random(1)
    base = [text(1000 + i, rng.choice([2, 5, 8, 12, 30, 80, 200])) for i in range(25)]
    texts = [None, "", "one", "one two three"]
    for b in base:
        for _ in range(5):
            w = b.split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(9))
            texts.append(" ".join(w))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    for n, percent in ((4, 85), (5, 80)):
        sets = {}
        for i, t in rows:
            w = (t or "").lower().split()
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        got = similarity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), find(i)) for i, s in sets.items()}


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    for size in [*range(1, 60), 100, 333, 1200]:
        for _ in range(8):
            x = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            y = x[rng.random(len(x)) > rng.random() * 0.16]
            y = np.unique(np.concatenate((y, rng.integers(0, 1 << 63, rng.integers(0, 2 + size // 20), np.uint64))))
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= 85 * (len(x) + len(y) - both):
                (a, da), (b, db) = similarity_join.keys_of(x, 85), similarity_join.keys_of(y, 85)
                assert {*a[~da]} & {*b} or {*a} & {*b[~db]}


def test_a_pair_is_made_in_one_shared_group():
    rng = np.random.default_rng(5)
    for size in (3, 40, 300):
        x, y = (set(rng.integers(-400, 400, size).tolist()) for _ in range(2))
        first = [frozenset(sorted(z)[:32]) for z in (x, y)]
        made = [g for g in x & y if similarity_join.owned(*first, g)]
        assert made == [min(x & y)] if first[0] & first[1] else sorted(made) == sorted(x & y)


def test_shingles_over_buffers():
    import pyarrow as pa

    texts = pa.array(["A b c d", "a B\tc\nd", None, "", "a b c", "é é é é é"])
    found = list(shingle_sets(texts, 4, Words()))
    assert [len(f) for f in found] == [1, 1, 0, 0, 1, 1] and found[0] == found[1]


def test_fingerprints(spark, docs):
    rows = winnowing.edited_fingerprints(docs).collect()
    plain = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(rows) == len(plain)
    ordered = sorted((-1 if i is None else i, t) for i, t in plain)
    by_id = {i: t for i, t in ordered}
    ids = sorted(by_id)
    for r in rows:
        key = -1 if r.doc_id is None else r.doc_id
        if key == 102 or ids[ids.index(key) - 1] == 102:
            continue
        t, nxt = by_id[key], by_id[ids[ids.index(key) - 1]]
        half = len(t) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and (r.fingerprint != "") == (t != "")


def test_winnowing_guarantee(spark):
    k, w = 4, 8
    run = text(9, k + w - 1)
    rows = spark.createDataFrame([(i, f"{text(i, 40)} {run} {text(50 + i, 40)}") for i in range(6)], "doc_id long, text string")
    sets = [{x >> 24 for x in r.selected} for r in winnowing.fingerprints(rows, k, w).collect()]
    assert all(a & b for a in sets for b in sets)


def test_winnowing_without_spaces(spark):
    """A passage that texts share is found at any offset in runs without spaces, and between white space of any kind."""
    rng = random.Random(4)
    run = lambda n: "".join(chr(rng.choice((0x4E00, 0x1F300)) + rng.randrange(200)) for _ in range(n))
    shared = run(winnowing.GRAM + 4 + 8 - 2)
    rows = [(i, run(40 + i) + shared + run(50)) for i in range(9)]
    words = text(9, 11).split()
    for i, space in enumerate("\t\n\r\u3000\u2028\u00a0 "):
        rows.append((100 + i, space.join(text(70 + i, 20).split() + words + text(80 + i, 20).split())))
    found = {r.doc_id: {x >> 24 for x in r.selected} for r in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 4, 8).collect()}
    for ids in (range(9), range(100, 107)):
        assert all(found[a] & found[b] for a in ids for b in ids)
    assert not found[0] & found[100]


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/\n", None), (4, "u", ""), (5, "u", "y\r\n\r\nz" * 900), (9, "u", "x")]
    found = {r.page_id: r for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 9: ("response", None)}
    assert all(found[i].payload_bytes == len(h or "") and found[i].payload_digest == warc.payload_digest((h or "").encode()) for i, _, h in rows)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 64)).astype(np.float32)
    x[10:400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 64), (5100, [float("nan")] * 64)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    y = x.astype(float)
    norm, hit, n = np.linalg.norm(y, axis=1), 0, 0
    for q in range(0, 1500, 50):
        s = y @ y[q] / (norm * norm[q])
        want = [i for _, i in sorted((-round(v, 12), i) for i, v in enumerate(s) if i != q)][:5]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        hit, n = hit + len({*want} & {*mine}), n + 5
        assert len(mine) == 5
        if 10 <= q < 400:
            assert mine == want
    assert hit >= 0.9 * n


def test_url_rules(spark):
    cases = ["http://A.example.com/en/7x?q", "http://example.com/en/6", "http://b.net/de/1", "http://x.example.net/de/8", "http://notexample.net/de/8", "http://c.org/es/#", None, "no", "http://z.io/fr/1"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string"), RULES).collect()}
    assert [got[i].rule for i in range(9)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "net/de/", "org/es/", None, None, None]
    assert (got[0].host, got[0].path, got[6].host, got[7].path) == ("a.example.com", "/en/7x", "", "")
    assert all(r.verdict in ("allow", "block") for r in got.values())


def test_url_models_count_whole_ngrams(spark):
    """Scores over more distinct n-grams than 2**18 equal those of a model kept in dictionaries."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_"
    hosts = ("a.example.com/en/7", "a.net/de/", "b.com/en/", "c.org/es/", "d.io/")
    cases = [f"http://{hosts[i % 5]}{''.join(rng.choice(letters) for _ in range(60))}" for i in range(8000)] + ["", None]
    rows = urls.judge(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string"), RULES).collect()
    hashed = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").selectExpr("page_id", "pmod(xxhash64(url), 5) <> 0 AS used").collect()
    used = {r.page_id: r.used for r in hashed}
    model = [({}, {}), ({}, {})]
    for r in rows:
        if r.rule is not None and used[r.page_id]:
            grams, nexts = model[r.verdict != "allow"]
            x = "\0" * 5 + cases[r.page_id]
            for i in range(5, len(x)):
                for order in range(6):
                    g = x[i - order : i + 1]
                    grams[g] = grams.get(g, 0) + 1
                    nexts.setdefault((order, g[:-1]), {}).setdefault(g, 0)
                    nexts[order, g[:-1]][g] += 1
    assert len({g for grams, _ in model for g in grams if len(g) == 6}) > 2**18

    def score(t):
        x, total = "\0" * 5 + t, 0.0
        for i in range(5, len(x)):
            p = [1 / 256, 1 / 256]
            for order in range(6):
                g = x[i - order : i + 1]
                for k, (grams, nexts) in enumerate(model):
                    if after := nexts.get((order, g[:-1])):
                        p[k] = (grams.get(g, 0) + len(after) * p[k]) / (sum(after.values()) + len(after))
            total += np.log(p[0]) - np.log(p[1])
        return total / max(len(t), 1)

    by_id = {r.page_id: r for r in rows}
    for i in [*range(0, 8000, 171), 8000, 8001]:
        assert abs(by_id[i].llr - score(cases[i] or "")) < 1e-6


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_held_out_accuracy(spark, name):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = {"quality": quality, "toxicity": toxicity}[name].classify(docs.join(labels, "doc_id").select("doc_id", "text", docs["lang"].alias("score")), labels)
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "quality" if name == "quality" else "toxic").collect()
    assert np.mean([a == b for a, b in rows]) > (0.97 if name == "quality" else 0.95)  # 305 toxic texts to learn from


def test_classifiers_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string")
    for module in (quality, toxicity):
        assert [round(r.score, 6) for r in module.classify(rows, none).collect()] == [0.5, 0.5]
        assert module.classify(rows.limit(0), none).count() == 0


def test_mixing(spark, docs):
    rows = mixing.mix(docs, repeat=2.0).collect()
    reads: dict = {}
    for r in rows:
        reads.setdefault((r.doc_id, r.text, r.source), []).append(r.epoch)
    assert len({(r.doc_id, r.text, r.source) for r in docs.collect()}) == len(reads)
    tokens = {}
    for r in rows:
        tokens[r.mix_source] = tokens.get(r.mix_source, 0) + r.mix_tokens
    total = {r.source or "\0null": 0 for r in docs.collect()}
    for r in docs.select("source", mixing.words(docs["text"]).alias("t")).collect():
        total[r.source or "\0null"] += r.t
    assert all(total[s] <= tokens[s] <= 2 * total[s] + 1 for s in total if total[s])


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_files.token_id_output(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert packing.pack(packing.cut_documents(none, vocabulary("word_bpe_49k.json"), 1, 64), 64).count() == 0
    assert similarity_join.near_duplicates(none).count() == 0
    assert winnowing.edited_fingerprints(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_are_those_of_a_union_find(spark):
    from roadweave.llm.components import components

    rng = np.random.default_rng(5)
    chain = rng.permutation(900)
    links = [*zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True), *((2000 + 7, 2000 + k) for k in range(40)), *rng.integers(3000, 3600, (250, 2)).tolist(), (5, 5), (9000, 9000)]
    least = {}

    def top(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((top(a), top(b)))
            least[b] = a
    want = {x: top(x) for x in list(least)}
    for chunk in (400, 200_000):
        found = components(spark.createDataFrame([(int(a), int(b)) for a, b in links], "u long, v long"), chunk).collect()
        assert len(found) == len(want) and dict(map(tuple, found)) == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("unrelated", [False, True])
def test_pipeline_keeps_one_of_each_group(spark, unrelated):
    """Null and repeated ids are documents of their own, whether or not an unrelated id repeats."""
    near = lambda seed: text(seed, 60) + " last"
    rows = [(None, text(1, 60)), (None, near(1)), (None, text(2, 60)), (None, None), (None, "")]
    rows += [(7, text(3, 60)), (7, text(4, 60)), (9, text(5, 60)), (8, near(5)), (None, text(5, 60)), (11, text(6, 60)), (12, None)]
    rows += [(20, text(7, 60)), (20, text(8, 60))] if unrelated else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    first = [t for i, t in got if i is None and t in (text(1, 60), near(1))]
    assert len(first) == 1
    want = [(None, first[0]), (None, text(2, 60)), (None, None), (None, ""), (7, text(3, 60)), (7, text(4, 60)), (8, near(5)), (11, text(6, 60)), (12, None)]
    assert sorted(got, key=repr) == sorted(want + rows[12:], key=repr)


def test_pipeline_join_leaves_only_what_its_result_reads(spark, docs, monkeypatch):
    from pathlib import Path

    from roadweave.llm import common

    paths = []
    fresh = common.fresh_path
    monkeypatch.setattr(common, "fresh_path", lambda s, name: (paths.append((name, fresh(s, name))), paths[-1][1])[1])
    found = corpus_pipeline.one_of_each_group(spark, docs, "")
    left = {name for name, path in paths if Path("/" + path.removeprefix("file:").lstrip("/")).exists()}
    assert {"measured", "named"} < {name for name, _ in paths} and not left & {"measured", "named"}
    assert found.count() > 0
