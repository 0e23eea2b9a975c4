"""The pipeline's stages, each held against a brute-force version on its own input."""

import os

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tallyhouse import session
from tallyhouse.llm import langid, mixing, pieces
from tallyhouse.sources.tables import read_table

from .test_operators import awkward, components_by_hand, targets_by_hand, words


@pytest.fixture(scope="module")
def stages(spark, data_dir, tmp_path_factory):
    """The input of every stage, and the last one's output."""
    folder, docs = tmp_path_factory.mktemp("stages"), read_table(spark, data_dir, "documents")
    out = [docs]
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], data_dir).write.parquet(f"{folder}/{n}")
        out.append(spark.read.parquet(f"{folder}/{n}"))
    return out


def rows_of(frame):
    return [tuple(r) for r in frame.select(*pipeline.COLUMNS).collect()]


def test_stages_keep_the_columns(stages):
    assert all(s.columns == pipeline.COLUMNS for s in stages[:-1])
    assert all(s.count() for s in stages)


def test_language_stage_rejects_what_it_says(spark, stages):
    langs, table = langid.identify(stages[0])
    judge = langid.Judge(langs, table)
    want = [r for r in rows_of(stages[0]) if judge(r[1])[0] != "und" and judge(r[1])[1] >= pipeline.LEAST_SCORE]
    assert sorted(map(repr, rows_of(stages[1]))) == sorted(map(repr, want)) and want


def test_one_document_of_each_group_stays(stages):
    near = components_by_hand([r[:2] for r in rows_of(stages[1])], 5, 80)
    assert sorted(r[0] for r in rows_of(stages[2])) == sorted(d for d, c in near if d == c)


def test_repeated_passages_go(stages):
    first, before = {}, rows_of(stages[2])
    for doc_id, text, *_ in before:
        w = words(text)
        for i in range(len(w) - 49):
            first[tuple(w[i:i + 50])] = min(first.get(tuple(w[i:i + 50]), doc_id), doc_id)
    want = {}
    for doc_id, text, *_ in before:
        w = words(text)
        gone = {i + k for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < doc_id for k in range(50)}
        want[doc_id] = [x for i, x in enumerate(w) if i not in gone]
    after = {r[0]: r for r in rows_of(stages[3])}
    assert {d: words(r[1]) for d, r in after.items()} == {d: w for d, w in want.items() if w}
    assert all(r[4] == len(r[1]) for r in after.values())


def test_mix_reaches_its_targets(stages):
    """With whole documents, so within the half of the one at the edge."""
    sizes, largest, taken, whole = {}, {}, {}, {r[0]: r for r in rows_of(stages[3])}
    for _, text, _, source, _ in rows_of(stages[3]):
        sizes[source] = sizes.get(source, 0) + len(words(text))
        largest[source] = max(largest.get(source, 0), len(words(text)))
    for row in rows_of(stages[4]):
        assert row == whole[row[0]]
        taken[row[3]] = taken.get(row[3], 0) + len(words(row[1]))
    target = targets_by_hand(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_mix_takes_what_the_shards_draw(spark, data_dir, stages, monkeypatch):
    monkeypatch.setattr(mixing, "split", lambda counts, shards, rng: np.zeros((shards, len(counts)), np.int64))
    assert pipeline.mix(spark, stages[3], data_dir).count() == 0


def test_stages_leave_nothing_behind(spark, data_dir, tmp_path):
    """But the last output, and what the last stage that needs folders has made."""
    held = session.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(held))
    docs = read_table(spark, data_dir, "documents").limit(60)
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, data_dir).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        new = {f.rsplit("-", 1)[0] for f in set(os.listdir(held)) - before}
        assert new <= [set(), {"minhash", "components"}, {"phrases"}, {"mix", "mixed"}, set()][n], n
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("phrases_")]


def test_ids_decode_to_the_texts(stages):
    back = sorted(r.text for r in pieces.decode(stages[5]).collect())
    assert back == sorted(r[1] for r in rows_of(stages[4]))


def test_one_text_in_two_sources_comes_from_both(spark, data_dir):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(None, text, "en", s, 0) for s in ("a", "b")], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.source for r in pipeline.mix(spark, docs, data_dir).collect()) == ["a", "a", "b"]


def test_a_rejected_text_does_not_stay_by_its_id(spark, data_dir):
    text, other = (" ".join(f"{c}{i}" for i in range(100)) for c in "wv")
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in ((1, text), (2, text), (2, other), (2, other))],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, data_dir).collect()) == [(1, text), (2, other)]


def test_stages_take_awkward_rows(spark, data_dir):
    frame, _ = awkward(spark)
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame, data_dir).count() > 0
        assert stage(spark, frame.limit(0), data_dir).count() == 0
