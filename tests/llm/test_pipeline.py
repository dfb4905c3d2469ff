"""The pipeline against brute-force versions of its stages, each on its own input."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sonaframe.llm import decontam, neardup, packing, quality
from sonaframe.llm.queries import crc_of_id
from sonaframe.llm.shared import written
from sonaframe.llm.words import WordHashes, shingles, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input of the first stage and the result of each, with a column more than documents has."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("kept"))
    out = [docs]
    for _, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "passages", "decontaminate", "pack"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and {r["score"] for r in df.select("score").collect()} == {"kept"}


def test_quality_stage_votes_by_brute_force(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(stages[0], labels, train=crc_of_id() % 5 != 0)
    own = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0}
    docs = texts(stages[0])
    slots = quality.TokenSlots()
    z = {d: model.latent(slots.counts(t)[None, :])[0] for d, t in docs.items()}
    known = [d for d in own if d in docs]
    assert len(known) == len(model.labels)
    kept = set()
    for d in docs:
        sims = sorted(((float(z[d] @ z[k]), own[k]) for k in known), reverse=True)[: model.k]
        w = [max(s, 0) ** model.power for s, _ in sims]
        if sum(a * y for a, (_, y) in zip(w, sims)) / sum(w) >= 0.3:
            kept.add(d)
    assert kept == set(texts(stages[1]))
    assert 0 < len(kept) < len(docs)


def test_near_duplicate_stage_keeps_the_smallest_of_each_class(stages):
    docs = texts(stages[1])
    words = WordHashes()
    idf = neardup.word_frequencies(stages[1].select("doc_id", "text"))
    sets = {d: neardup.weighted_shingles(words.of(words_of(t)), idf) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if docs[a] == docs[b] or neardup.weighted_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(texts(stages[2])) == {find(d) for d in docs}


def test_passage_stage_leaves_each_passage_once(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    words, seen = WordHashes(), collections.defaultdict(set)
    for d, t in after.items():
        h = words.of(words_of(t))
        for x in (shingles(h, 50).tolist() if len(h) >= 50 else []):
            seen[x].add(d)
    assert not [s for s in seen.values() if len(s) > 1]
    for d, t in before.items():  # a document without any repeat stays as it was
        h = words.of(words_of(t))
        own = {x for x in shingles(h, 5).tolist()}
        shared = any(own & set(shingles(words.of(words_of(u)), 5).tolist()) for e, u in before.items() if e != d)
        if not shared:
            assert after[d] == t
    sizes = {r["doc_id"]: r["n_chars"] for r in stages[3].collect()}
    assert all(sizes[d] == len(after[d]) for d in after if after[d] != before[d])


def test_decontamination_stage_drops_documents_with_items(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = WordHashes()
    sets = [np.unique(shingles(words.of(words_of(t)))) for t in items]
    docs = texts(stages[3])
    hit = {d for d, t in docs.items() for own in [np.unique(shingles(words.of(words_of(t))))]
           if any(len(s) and len(np.intersect1d(own, s)) >= 0.8 * len(s) for s in sets)}
    assert set(texts(stages[4])) == set(docs) - hit
    assert {r["doc_id"] for r in decontam.contaminated(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()} == hit


def test_pack_stage_holds_every_token_once(stages):
    enc = packing.encoder(packing.default_tokenizer())
    docs = texts(stages[4])
    pieces = collections.defaultdict(list)
    for r in stages[5].collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(docs)
    for d, t in docs.items():
        ids, at = np.append(enc.ids(t), np.uint32(1)).astype("<u4"), 0
        for start, length, crc in sorted(pieces[d]):
            assert start == at and zlib.crc32(ids[start: start + length].tobytes()) == crc
            at += length
        assert at == len(ids)


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    tokens = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect())
    got = P.run(spark, SF)
    assert set(cols) <= set(got.columns) and tokens(got) == tokens(stages[5])


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "Some text. Of no id.", "en", None, 5), (3, "One text. Two.", None, "s", 14),
            (3, "One text. Two.", None, "s", 14)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in P.STAGES:
            docs = written(stage(spark, docs, SF))
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids == ({1, None, 3} if data else set())
