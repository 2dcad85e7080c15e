"""Fingerprints and the whole pipeline against plain Python."""

import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from roadweave.llm import mixing, quality, toxicity, winnowing
from roadweave.llm.catalog import vocabulary
from roadweave.llm.learning import labelled_sample

WORDS = "river stone lamp idle green winter paper cloud seven tower Apple salt".split()
LOW = winnowing.LOW


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashed(values: list) -> int:
    """The engine's 64-bit hash of some columns: each one's hash is the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little"), seed)
    return signed(seed)


def plain_winnow(t: str, k: int, w: int) -> list[int]:
    if not t:
        return []
    units = []
    for run in re.split(f"[{winnowing.SPACE}]", t):
        long = len(run) > winnowing.LONG
        units += [hashed(list(run[i : i + winnowing.GRAM])) for i in range(len(run) - winnowing.GRAM + 1)] if long else [hashed([run])]
    grams = [(hashed(units[i : i + k]) & ~LOW) | (LOW - i) for i in range(max(1, len(units) - k + 1))]
    picked = [min(grams[i : i + w]) for i in range(max(1, len(grams) - w + 1))]
    return [x for i, x in enumerate(picked) if not i or x != picked[i - 1]]


def plain_shown(selected: list[int]) -> str:
    return " ".join(f"{(x % (1 << 64)) >> 24:x}@{LOW - (x & LOW)}" for x in selected)


def plain_likeness(a: list[int], b: list[int]) -> float:
    x, y = ({v >> 24 for v in s} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_are_those_of_plain_python(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "one", "a b c", "é　日本 x\ty", "z" * 33, "z" * 32, " lead and trail ", "\U0001f300" * 90 + " a b c d e f g"]
    texts += [text(i, 5 * i) + rng.choice(["", "\n", "x" * 50, " \t "]) + text(i // 2, 40) for i in range(40)]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in winnowing.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for at, (i, t) in enumerate(rows):
        t, following = t or "", rows[at - 1][1] or ""
        half = len(t) // 2
        own, edited, other = (plain_winnow(x, 4, 8) for x in (t, t[: len(t) - half] + following[:half], following))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain_shown(own), plain_shown(edited))
        assert got[i].near_edited == pytest.approx(plain_likeness(own, edited)) and got[i].near_next == pytest.approx(plain_likeness(own, other))


def test_units_take_a_few_times_as_long_as_cutting_the_text(spark):
    """Runs of 32 code points, none of them long: looking for a long run must not begin anew at each code point."""
    run = "abcdefgh" * 4
    rows = spark.range(40, numPartitions=2).select(F.repeat(F.concat(F.lit(run[:-3]), F.col("id") + 100, F.lit(" ")), 3000).alias("text")).cache()
    assert rows.count() == 40

    def seconds(column) -> float:
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            rows.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    cut, found = seconds(F.split("text", f"[{winnowing.SPACE}]", -1)), seconds(winnowing.units(F.col("text")))
    rows.unpersist()
    assert found < 4 * cut


def test_windows_of_any_width_and_texts_with_more_kinds_of_white_space(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["a", "bc", "d", "é", "日本", "z" * 33]) + rng.choice(" \t\n\x0b\f\r\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\x1c") for _ in range(n)) for n in (1, 3, 9, 40, 200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, w in ((1, 1), (2, 3), (4, 8), (3, 13)):
        found = {r.doc_id: r.selected for r in winnowing.fingerprints(rows, k, w).collect()}
        assert all(found[i] == plain_winnow(t, k, w) for i, t in enumerate(texts))


def corpus() -> tuple[list, list]:
    """Documents of three sources, with junk, vile texts, copies, near copies, nulls and repeated ids, and their labels."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(420):
        junk, vile = i % 7 == 0, i % 5 == 1
        body = " ".join("qx" * rng.randrange(1, 9) if junk else rng.choice(("zxq", "vile", "foul")) if vile and k % 3 == 0 else rng.choice(WORDS) + str(rng.randrange(40)) for k in range(rng.randrange(20, 300)))
        rows.append((i, body, "abc"[i % 3] if i % 11 else None, "en"))
        labels.append((i, int(not junk), int(vile and not junk)))
    good = [i for i in range(420) if i % 7 and i % 5 != 1]
    for n, i in enumerate(good[:60]):
        words = rows[i][1].split()
        if n % 2 and len(words) > 120:
            words[50] = "changed"
        rows.append((1000 + n, " ".join(words), "a", "en"))
    rows += [(None, rows[good[70]][1] + " once more", "b", None), (None, text(901, 90), "b", "en"), (2000, text(902, 90), "c", "en"), (2000, text(903, 90), "c", "en"), (2001, None, None, None), (2002, "", "a", "en")]
    return rows, labels


def reachable(rows: list, percent: int, n: int) -> list[int]:
    """The smallest row number that each row reaches by links of word shingles."""
    sets = []
    for r in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(i) for i in range(len(rows))]


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    """Each stage on what the one before kept: one text scored at a time, all pairs compared, reads and pieces counted."""
    from tokenizers import Tokenizer

    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, known = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))

    model = quality.fit(labelled_sample(docs, known, "quality", 2000))
    kept = [r for r in docs.collect() if quality.logits([r.text], model)[0] >= 0]
    left = spark.createDataFrame(kept, docs.schema)
    scorer = toxicity.Scorer(toxicity.fit(labelled_sample(left, known, "toxic", 2000)))
    clean = [r for r in kept if scorer.logits([r.text])[0] < np.log(0.7 / 0.3)]
    truth = {i: (q, t) for i, q, t in labels}
    assert 0 < len(clean) < len(kept) < len(rows)
    assert np.mean([truth[r.doc_id][0] for r in kept if r.doc_id in truth]) > 0.95
    assert np.mean([1 - truth[r.doc_id][1] for r in clean if r.doc_id in truth]) > 0.95

    tops = reachable(clean, 80, 5)
    groups: dict[int, list] = {}
    for r, top in zip(clean, tops, strict=True):
        groups.setdefault(top, []).append(r)
    assert len(groups) < len(clean)
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids_of = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 1]

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sequences: dict[int, list] = {}
    reads: dict[tuple, int] = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append(r)
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert r.length == len(ids) and r.start == r.piece * 4096
        reads[r.doc_id, tuple(ids)] = reads.get((r.doc_id, tuple(ids)), 0) + 1
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(r.length for r in packed)
    assert -(-total // 4096) <= len(sequences) <= 1.05 * total / 4096 + 2

    # one row of each group: that of the smallest id, whose text may be any of those with that id
    budget: dict[str, int] = {}
    read: dict[str, int] = {}
    seen: dict[tuple, int] = {}
    most = 1
    for own in groups.values():
        least = min((r.doc_id for r in own if r.doc_id is not None), default=None)
        choices = {(r.doc_id, tuple(ids_of(r.text))): r for r in own if r.doc_id == least}
        found = [c for c in choices if c in reads]
        assert len(found) >= 1
        c = found[0]
        seen[c] = seen.get(c, 0) + 1
        most = max(most, reads[c])
        n = len((choices[c].text or "").split())
        source = choices[c].source or ""
        budget[source] = budget.get(source, 0) + n
        read[source] = read.get(source, 0) + n * reads[c]
    assert seen.keys() == reads.keys()
    sized = {s: t for s, t in budget.items() if t}
    low, high = min(sized.values()), max(sized.values())
    alpha = 1 - np.log(2) / np.log(high / low) if high > 2 * low else 0.0
    unit = max(t ** (1 - alpha) for t in sized.values())
    longest = max(len((r.text or "").split()) for r in clean)
    for s, t in sized.items():
        wanted = t**alpha * unit
        assert t <= read[s] <= wanted + 1 and read[s] > wanted - longest - 1
    assert most >= 2
