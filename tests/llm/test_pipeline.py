"""The pipeline against plain Python versions of its stages, each on its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilgraph.llm import mixing, packing, simhash
from veilgraph.plans.workspace import materialize

from .test_operators import _jaccard, _targets

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], FOLDER)))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns_stay_until_the_last_stage(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and dict(df.dtypes) == dict(stages[0].dtypes)


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = {r["doc_id"]: r for r in rows(stages[0])}, {r["doc_id"]: r for r in rows(stages[1])}
    assert all(before[i] == after[i] for i in after)
    good = [i in after for i, q in labels.items() if q == 1]
    bad = [i in after for i, q in labels.items() if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_simhash_keeps_one_of_each_group(stages):
    before, after = sorted(rows(stages[1]), key=lambda r: r["doc_id"]), {r["doc_id"]: r for r in rows(stages[2])}
    assert all(after[r["doc_id"]] == r for r in before if r["doc_id"] in after)
    found = missed = copies = 0
    for at, r in enumerate(before):
        alike = [_jaccard(r["text"], other["text"]) for other in before[:at]]
        best = max(alike, default=0)
        copies += best == 1
        if best == 1 or best < 0.5:
            assert (r["doc_id"] in after) == (best < 0.5)
        elif best >= 0.8:
            found += r["doc_id"] not in after
            missed += r["doc_id"] in after
    assert copies and missed <= max(1, 0.1 * found)


def test_repeats_go(stages):
    seen, want = set(), {}
    for r in sorted(rows(stages[2]), key=lambda r: r["doc_id"]):
        text = r["text"].encode()
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or WORD.search(kept):
            want[r["doc_id"]] = r | {"text": kept, "n_chars": len(kept)}
    assert {r["doc_id"]: r for r in rows(stages[3])} == want


def test_mix_takes_targets(stages):
    before, after = rows(stages[3]), rows(stages[4])
    by_id = {r["doc_id"]: r for r in before}
    assert all(by_id[r["doc_id"]] == r for r in after)
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size[r["doc_id"]]
        longest[r["source"]] = max(longest[r["source"]], size[r["doc_id"]])
    copies = Counter(r["doc_id"] for r in after)
    for i, n in copies.items():
        taken[by_id[i]["source"]] += n * size[i]
    want = _targets(dict(sizes))
    assert max(copies.values()) <= 3 and all(abs(taken[s] - want[s]) <= longest[s] / 2 for s in sizes)


def test_packing_holds_every_token(stages):
    want = Counter()
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(stages[4]):
        ids = [*slow.encode(r["text"], add_special_tokens=False).ids, 0]
        for k, (start, n) in enumerate(packing.cuts(len(ids), 2048)):
            want[(r["doc_id"], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
    got = stages[5].collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1


def test_run_gives_the_last_stage(spark, stages):
    count = lambda df: Counter(tuple(r)[:5] for r in df.collect())
    assert count(corpus_pipeline.run(spark, FOLDER)) == count(stages[5])
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", None, 3)], schema)
    # without a label every document stays; null and empty are copies of one another
    for docs, want in ((odd.limit(0), []), (odd, [(1, 0, 0, 1), (3, 0, 0, 2)])):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, FOLDER))
        assert sorted(tuple(r)[:4] for r in docs.collect()) == want


def test_stages_keep_columns_of_any_name(spark, stages):
    names = ("n_removed", "n_spans", "kept", "own", "spans", "component_id", "key", "at", "fp", "c0", "_range", "_carried_0", "_first", "_mix_id", "judged", "positions", "hash", "cell", "n_bytes")
    docs = stages[0].limit(60)
    wide = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    twice = wide.unionByName(wide.limit(3)).unionByName(wide.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for table in (wide, twice):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = materialize(stage(spark, now, FOLDER))
            assert now.columns == table.columns and dict(now.dtypes) == dict(table.dtypes)
        got = now.collect()
        assert got and all(r[n] == n + r["fp"][2:] for r in got for n in names)
        assert corpus_pipeline.best_fit_packing(spark, now, FOLDER).count() >= len(got)


def test_null_and_repeated_ids(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    texts = [" ".join(f"{w}{k}" for w in ("apple", "birch", "cedar", "delta", "ember", "flint")) for k in range(9)]
    ids = [None, None, 7, 7, 7, 3, None, 3, 12]
    # one source: its target is its size, so that the mix takes every row once
    table = [(i, t, "en", "a", len(t)) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(table, schema).repartition(3)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=key) == sorted(table, key=key)
    assert sorted(map(tuple, simhash.keep_first(docs).collect()), key=key) == sorted(table, key=key)
    # copies: of texts 2 (ids 7, 3, null), 0 (two null ids), 5 (id 3 twice); the row of the smallest id stays, once
    more = [(3, texts[2], "en", "a", len(texts[2])), (None, texts[2], "en", "a", len(texts[2])), (None, texts[0], "en", "a", len(texts[0])), (3, texts[5], "en", "a", len(texts[5]))]
    copies = spark.createDataFrame(table + more, schema).repartition(3)
    want = [more[0], *(r for r in table if r[1] != texts[2])]
    kept = simhash.keep_first(copies)
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, mixing.mix(kept).collect()), key=key) == sorted(want, key=key)
    # the stage's rule: texts 2, 0 and 5 are copies, the others share no five words
    assert sorted(map(tuple, simhash.keep_one(copies).collect()), key=key) == sorted(want, key=key)
