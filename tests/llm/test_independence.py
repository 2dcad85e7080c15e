"""Scores of texts by themselves, clashing columns, bounded shards, rolled files and large groups."""

import random

import numpy as np
import pyarrow as pa
import pytest

from roadweave.llm import mixing, packing, quality, similarity_join, token_files, toxicity
from roadweave.llm.catalog import vocabulary
from roadweave.llm.common import PART, lean, parts

WORDS = "river stone lamp idle green winter paper cloud seven tower Apple salt".split()


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(i, 3 * i % 97), f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, 2), (101, "", "s0", 3), (None, text(5, 30), "s1", 4), (102, text(20, 60), "s2", 5), (102, text(20, 60), "s2", 5), (103, "x" * 5000, "s0", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [rng.choice(("zxq", "vile", "foul") if bad and k % 4 == 0 else WORDS) for k in range(rng.randrange(5, 400))]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, 1 if bad else 0))
    rows += [(300, "vile foul zxq " * 60_000), (300, "other text"), (301, None), (None, ""), (302, "ab")]
    labels += [(300, 0, 1), (300, 0, 0), (None, 1, 0), (301, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_a_score_depends_on_its_text_alone(spark, labelled, module, label, monkeypatch):
    """In any batch, block or partition, whatever texts stand beside it; texts of any length are learned from."""
    from roadweave.llm.learning import labelled_sample

    docs, labels = labelled
    sample = labelled_sample(docs, labels, label, 2000)
    assert sample.where("length(text) > 200000").count() + docs.where("doc_id = 300 AND length(text) > 200000").count() >= 1
    model = module.fit(sample)
    texts = [r.text for r in docs.collect()] + ["é" * 900, "a", "\U0001f300 x" * 300]
    score = (lambda x: quality.logits(x, model)) if module is quality else toxicity.Scorer(model).logits
    together = score(texts)
    assert (together == np.array([score([t])[0] for t in texts])).all()
    assert (together == score(texts[::-1])[::-1]).all()
    if module is quality:
        monkeypatch.setattr(quality, "BLOCK", 2 * quality.PASSAGE)
        assert (together == score(texts)).all()
    else:
        assert (together == toxicity.Scorer(model).logits(texts, block=50)).all()
    one = {r.text: r.score for r in module.score(docs.coalesce(1), model).collect()}
    many = {r.text: r.score for r in module.score(docs.repartition(7), model).collect()}
    assert one == many and all(0 <= s <= 1 for s in one.values())


def test_toxicity_features_are_those_of_plain_python(spark):
    texts = ["abc", "", "ab", "The cat", "x" * 40, "a\0b" * 9]
    found, _, starts = toxicity.grams([toxicity.lowered(t) for t in texts])
    _, places, _ = toxicity.grams([toxicity.lowered(t) for t in texts])
    for order, at in zip(toxicity.ORDERS, places, strict=True):
        own = np.searchsorted(starts, at, "right") - 1
        assert np.bincount(own, minlength=len(texts)).tolist() == [max(0, len(t) + 1 - order + 1) for t in texts]
    for order, f, at in zip(toxicity.ORDERS, found, places, strict=True):
        seen = {}
        joined = "".join(toxicity.lowered(t) + "\0" for t in texts)
        for bucket, p in zip(f.tolist(), at.tolist(), strict=True):
            assert seen.setdefault(joined[p : p + order], bucket) == bucket


def test_mixing_takes_clashing_columns_and_joins_with_salt(spark, docs, monkeypatch):
    clash = docs
    for name in ("rest", "epochs", "of", "n_blocks", "cut_block", "cut_key", "cut_row", "planned", "salt", "salted", "tokens", "weight"):
        clash = clash.withColumn(name, docs["doc_id"])
    key = lambda df: sorted((repr(r.doc_id), r.mix_source, r.epoch, r.block, r.row_key) for r in df.collect())
    want = key(mixing.mix(docs))
    got = mixing.mix(clash)
    assert key(got) == want and {"rest", "of", "planned", "salt"} <= {*got.columns}
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert key(mixing.mix(clash)) == want


def test_mixing_weights_are_those_of_the_formula(spark, docs):
    rows = mixing.mix(docs, repeat=2.0).collect()
    tokens = {}
    for r in docs.collect():
        tokens[r.source or "\0null"] = tokens.get(r.source or "\0null", 0) + len((r.text or "").split())
    sized = {s: t for s, t in tokens.items() if t}
    low, high = min(sized.values()), max(sized.values())
    alpha = max(0.0, 1 - np.log(2) / np.log(high / low)) if high > 2 * low else 0.0
    total = sum(t**alpha for t in sized.values())
    for r in rows:
        if r.mix_source in sized:
            assert abs(r.weight - sized[r.mix_source] ** alpha / total) < 1e-6
    entropy = 0.9 * np.log(len(sized))
    p = np.array([*{r.mix_source: r.weight for r in mixing.mix(docs, repeat=None, entropy=entropy).collect() if r.mix_source in sized}.values()])
    assert -(p * np.log(p)).sum() >= entropy - 1e-9


def test_packing_of_pieces_that_fit_badly_stays_in_bounded_shards(spark, monkeypatch):
    shards = []
    level = packing.level
    monkeypatch.setattr(packing, "level", lambda left, n, *rest: (shards.append((n, left.count())), level(left, n, *rest))[1])
    pieces = spark.range(900).selectExpr("id AS uid", "CAST(2100 AS BIGINT) AS length")
    rows = packing.pack(pieces, 4096, shard=100).collect()
    assert len({r.sequence_id for r in rows}) == 900 and all(count <= 100 * n for n, count in shards) and len(shards) == 2


def test_genetic_steps_beat_best_fit():
    """Triples that fill a bin exactly, which best-fit decreasing breaks up."""
    rng = np.random.default_rng(12)
    won = 0
    for seed in range(6):
        sizes = []
        for _ in range(12):
            a, b = (int(x) for x in rng.integers(260, 480, 2))
            sizes += [a, b, 1000 - a - b]
        plain = packing.best_fit(sizes, sorted(range(36), key=lambda i: -sizes[i]), 1000)
        found = packing.evolve(sizes, 1000, seed, [], 300, 8)
        assert sorted(i for b in found for i in b) == list(range(36)) and all(sum(sizes[i] for i in b) <= 1000 for b in found)
        assert len(found) <= len(plain)
        won += len(found) < len(plain)
    assert won


def test_pieces_are_the_tokenizers_own(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for kind in ("<u4", "<u2"):
        rows = packing.cut_documents(docs.where("doc_id < 60"), vocabulary("word_bpe_49k.json"), 1, 64, kind=kind).collect()
        for r in docs.where("doc_id < 60").collect():
            ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
            own = sorted((p for p in rows if p.doc_id == r.doc_id), key=lambda p: p.piece)
            assert [p.start for p in own] == list(range(0, len(ids), 64))
            assert [i for p in own for i in np.frombuffer(p.ids, kind).tolist()] == ids


def test_files_roll_over(spark, docs):
    folder, written = token_files.write_token_files(docs, vocabulary("byte_bpe_50k.json"), 0, roll=(1 << 28, 5))
    files = sorted(written.collect(), key=lambda r: (r["part"], r["number"]))
    assert len(files) >= 13 and all(r["documents"] <= 5 for r in files)
    before = np.cumsum([0, *(r["tokens"] for r in files)]).tolist()
    rows = token_files.read_token_files(spark, folder, [(r["file"], n) for r, n in zip(files, before, strict=False)]).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == sorted(map(tuple, token_files.token_id_output(docs, vocabulary("byte_bpe_50k.json")).collect()), key=lambda r: r[1])


def test_large_groups_are_compared_in_any_blocks(spark, monkeypatch):
    from functools import partial

    base = [f"w{i}" for i in range(60)]
    rng = random.Random(3)
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 6, 12, 20])):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, similarity_join.near_duplicates(docs).collect()))
    for block in (3, 30):
        monkeypatch.setattr(similarity_join, "unsettled", partial(similarity_join.unsettled, block=block))
        assert sorted(map(tuple, similarity_join.near_duplicates(docs, turns=0).collect())) == want


def test_batches_come_in_bounded_parts_whose_rows_are_the_same():
    """A batch of 10,000 rows is 20 MB of texts and more; what an operator makes of it at once isn't to grow with it."""
    rng = np.random.default_rng(3)
    texts = ["x" * n for n in rng.integers(0, 9000, 3000).tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    cut = [*parts(batch)]
    assert len(cut) > 2 and max(b.nbytes for b in cut) < 1.5 * PART
    seen = []
    given = [*lean(lambda batches: (seen.append(b.num_rows) or b for b in batches))(iter([batch, batch.slice(0, 0), batch.slice(5, 1)]))]
    assert pa.Table.from_batches(given).equals(pa.Table.from_batches([batch, batch.slice(5, 1)]))
    assert seen == [*(b.num_rows for b in cut), 0, 1]


def test_a_worker_drops_the_encoder_when_another_operators_task_begins(spark, docs, monkeypatch):
    """Spark uses Python workers again, so what one stage of the pipeline caches would be held through all later ones."""
    ran = []
    frame = type(docs)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, plain=frame.mapInArrow, **b: ran.append(f) or plain(self, f, *a, **b))
    packing.cut_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)
    quality.score(docs.select("doc_id", "text"), {"share": 0.5})
    cut, score = ran
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["some words", None])], ["doc_id", "text"])
    assert sum(b.num_rows for b in cut(iter([batch]))) == 2 and token_files.encoder.cache_info().currsize
    assert sum(b.num_rows for b in score(iter([batch]))) == 2 and not token_files.encoder.cache_info().currsize
