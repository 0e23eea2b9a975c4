"""Operators against brute force, exact round trips and held-out accuracy, on the smallest tables and on hand-made rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import chat, components, crosspoly, fertility, langid, minhash, mixing, phrases, pieces, queries, tagpaths, warc
from tallyhouse.llm.words import WordHashes
from tallyhouse.sources.tables import read_table
from tests import oracle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return (text or "").encode().split()


def lowered(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    run = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    long = " ".join(f"v{rng.randrange(3000)}" for _ in range(30_000))
    rows = [(1, run, "en", "a", 3), (2, run, "en", None, None), (3, "x " + run[:-4] + " y", "en", "a", 0), (4, None, "en", "b", 0),
            (5, "", None, "b", 0), (6, " \n\t ", "de", "b", 0), (7, "one two", "de", "b", 0), (8, "One TWO", "de", "c", 0), (None, run, "en", "a", 0),
            (9, long, "en", "a", 0), (10, "same " * 300, "en", "c", 0), (11, "same " * 200, "en", "c", 0), (1, run, "en", "a", 3), (12, long, "fr", "d", 0),
            (13, "日本語 テキスト ▁ ퟿ <s> " * 20, "ja", "d", 0), (14, run + " " + long, None, None, 0)]
    extra = "size bigint, kept boolean, node bigint, component bigint, draw int, `words` string, lang_pred string, score double"
    return spark.createDataFrame([(*r, 1, False, 2, 3, 4, "w", "xx", 0.5) for r in rows], f"{DOCS}, {extra}"), rows


@pytest.fixture(scope="module")
def documents(spark, data_dir):
    return read_table(spark, data_dir, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def empty(frame):
    return frame.limit(0)


# 1 fertility

def base_by_hand(text):
    w = words(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    counts = {g: grams.count(g) for g in set(grams)}
    hit = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_plain_rules_match_a_count_by_hand(spark, documents, texts):
    found = {r.doc_id: r for r in fertility.fertility(documents).collect()}
    for doc_id, text in texts:
        r = found[doc_id]
        if len(words(text)) < 1500:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_by_hand(text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_word_by_word_encoding_is_that_of_running_text(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{fertility.VOCABULARIES}/{fertility.PIECES}")
    known = fertility.Encodings(fertility.VOCABULARIES)
    for _, text in texts[:40]:
        plain = " ".join(w.decode() for w in words(text))
        ids = model.encode(plain)
        value = fertility.measured(text, known)
        assert value[5] == len(ids)
        if ids:
            share = np.unique(ids, return_counts=True)[1] / len(ids)
            assert value[9] == pytest.approx(-(share * np.log2(share)).sum() / max(1, math.log2(len(ids))))


def test_symbol_junk_falls_out_of_the_band(spark, texts):
    plain = [(i, t, "xx") for i, t in texts if len(words(t)) > 150]
    junk = [(10 ** 6 + i, " ".join(w.decode() + "&&&%%%"[:3 + k % 4] for k, w in enumerate(words(t))), "xx") for i, t, _ in plain[:5]]
    found = {r.doc_id: r.kept for r in fertility.fertility(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string")).collect()}
    assert not any(found[i] for i, _, _ in junk)


@pytest.mark.parametrize("least", [0, 150])
def test_short_texts_are_judged(spark, texts, least):
    """By the medians of longer texts, and in a language of short texts alone by those of all."""
    long = [[w.decode() for w in words(t)] for _, t in texts if len(words(t)) > 150]
    short = [w[:30] for w in long[:40]]
    plain = [(i, " ".join(w), "xx") for i, w in enumerate(long + short if least else short)]
    junk = [(10 ** 6 + i, " ".join(x + "%%%&&&***"[k % 3 * 3:][:3] for k, x in enumerate(w)), "xx") for i, w in enumerate(short[:5])]
    symbols = [(10 ** 7, " ".join(chr(0x1D400 + 37 * k) for k in range(20)), "xx")]
    found = fertility.fertility(spark.createDataFrame(plain + junk + symbols, "doc_id long, text string, lang string")).where("NOT base_failed").collect()
    few = [r for r in found if r.n_tokens < 200]
    odd = [r.kept for r in few if r.doc_id >= 10 ** 6]
    assert len(odd) == 6 and sum(odd) <= 1
    same = [r.kept for r in few if r.doc_id < 10 ** 6]
    assert len(same) >= 30 and sum(same) >= 0.9 * len(same)


def test_fertility_of_awkward_rows(spark):
    frame, rows = awkward(spark)
    found = fertility.fertility(frame).collect()
    assert len(found) == len(rows) and all(r.base_failed is not None and r.kept is not None for r in found)
    assert fertility.fertility(empty(frame)).count() == 0


# 2 phrases

def repeats_by_hand(rows):
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - 49):
            if doc_id is not None:
                key = tuple(w[i:i + 50])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if doc_id is not None and first[tuple(w[i:i + 50])] < doc_id:
                gone[i:i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_phrases_match_brute_force(documents, texts):
    found = sorted((tuple(r) for r in phrases.remove_repeats(documents).collect()), key=repr)
    assert found == repeats_by_hand(texts)


def test_phrases_of_awkward_rows(spark):
    frame, rows = awkward(spark)
    assert sorted((tuple(r) for r in phrases.remove_repeats(frame).collect()), key=repr) == repeats_by_hand([r[:2] for r in rows])
    assert phrases.remove_repeats(empty(frame)).count() == 0


def test_phrases_at_every_edge(spark):
    rng = random.Random(3)
    for _ in range(3):
        shared = [" ".join(rng.choice("abc") for _ in range(rng.choice([49, 50, 51, 60, 130]))) for _ in range(4)]
        rows = [(i, " ".join(x for _ in range(rng.randrange(1, 5)) for x in (" ".join(f"u{rng.randrange(40)}" for _ in range(rng.randrange(0, 30))), rng.choice(shared))))
                for i in range(60)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((tuple(r) for r in phrases.remove_repeats(frame).collect()), key=repr) == repeats_by_hand(rows)


def test_rows_that_repeat_an_id_lose_what_smaller_documents_have(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for doc_id in (1, 1, 2, 2, 2, 3, 3, 4):
        for _ in range(4):
            at, text = rng.randrange(250), list(base)
            text[rng.randrange(400)] = f"x{rng.randrange(3)}"
            rows.append((doc_id, " ".join([f"u{rng.randrange(9)}", *text[at:at + rng.choice([55, 80, 150])]])))
    for group in range(10):
        run = [f"g{group}-{i}" for i in range(75)]
        rows += [(50, " ".join(run[:70]))] + [(60, f"a{group}{k} {' '.join(run)}") for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in phrases.remove_repeats(frame).collect()), key=repr) == repeats_by_hand(rows)


def test_shard_finds_windows_of_smaller_documents_only():
    rng = random.Random(1)
    for trial in range(100):
        base = [rng.choice("ab" if trial % 2 else "abcdefgh") for _ in range(rng.randrange(60, 220))]

        def near_copy():
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice("xyz")
            return copy[rng.randrange(10):]

        passages, region, shard = [(rng.randrange(10), near_copy()) for _ in range(8)], near_copy(), phrases.Shard()
        for owner, passage in passages:
            shard.add(owner, " ".join(passage))
        width = phrases.WINDOW
        windows = {tuple(p[i:i + width]) for owner, p in passages if owner < 5 for i in range(len(p) - width + 1)}
        held = {j for i in range(len(region) - width + 1) if tuple(region[i:i + width]) in windows for j in range(i, i + width)}
        assert {j for low, high in shard.spans(5, " ".join(region)) for j in range(low, high)} == held


def test_removed_words_leave_the_rest_as_it_was(spark):
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a  b\n{run} c"), (2, f"d\n\ne {run}\tf  g"), (3, None), (4, "")]
    found = {r.doc_id: r.text for r in phrases.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: rows[0][1], 2: "d\n\ne \tf  g", 3: None, 4: ""}


# 3 pieces

def all_paths(chunk, vocabulary):
    if not chunk:
        yield 0.0, []
        return
    for j in range(1, min(len(chunk), 16) + 1):
        s = vocabulary.score.get(chunk[:j], vocabulary.unknown if j == 1 else None)
        if s is not None:
            for rest, path in all_paths(chunk[j:], vocabulary):
                yield s + rest, [chunk[:j], *path]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.VOCABULARY)


@pytest.mark.parametrize("text", ["the cat", "aaaaaa a", "  two  blanks", "zz\n\nyy", "日本語x", "in the in the", "a"])
def test_n_best_are_the_best_of_all_segmentations(vocabulary, text):
    every = sorted((s for s, _ in all_paths("▁" + text.replace(" ", "▁"), vocabulary)), reverse=True)
    for count in (1, 2, 5, 12):
        ids, found = pieces.n_best(text, pieces.Chunks(vocabulary), count)
        assert [s for s, _ in found] == pytest.approx(every[:count])
        assert len({str(c) for _, c in found}) == len(found)
        assert vocabulary.decode(ids.tolist()) == text


@pytest.mark.parametrize("bits", [4, 19])
def test_all_pieces_of_a_text_are_found(monkeypatch, bits):
    monkeypatch.setattr(pieces.Prefixes, "BITS", bits)
    names = ["a", "ab", "abc", "bc", "▁a", "日本", "本", "zzz", "\U0010ffff", "\x00b"]
    table = pieces.Prefixes({p[:n] for p in names for n in range(1, len(p) + 1)}, {p: i for i, p in enumerate(names)})
    for text in ("", "abcabc", "▁abc日本本\nzzzz", "\ud800\U0010ffff\x00bc", "q" * 50):
        found = sorted(zip(*(x.tolist() for x in table.found(text))))
        assert found == sorted((i, i + len(p), n) for n, p in enumerate(names) for i in range(len(text)) if text.startswith(p, i))


def test_a_worker_solves_no_chunk_twice(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["quorvane tilsome\nquorvane", None, "tilsome x" + "y" * 80]})
    pieces.known_chunks.cache_clear()
    first = [b.to_pylist() for b in pieces.digester(pieces.VOCABULARY, 4)(iter([batch]))]
    monkeypatch.setattr(pieces.Chunks, "add", None)
    assert [b.to_pylist() for b in pieces.digester(pieces.VOCABULARY, 4)(iter([batch]))] == first


def operators_with_texts():
    class Filter:
        value = np.zeros((langid.SLOTS, 1), np.uint64)

    return {"language counts": langid.count_grams, "language": langid.predictor(["en"], Filter), "features": minhash.featurer(5),
            "sets": minhash.checked_setter(5), "seeds": phrases.seed_batches, "windows": phrases.window_batches}


@pytest.mark.parametrize("name", sorted(operators_with_texts()))
def test_a_worker_lets_go_of_its_chunks_when_another_operator_comes(name):
    text = {"doc_id": [1, 2], "text": ["quorvane tilsome", "tilsome"], "lang": ["en", "en"], "text_digest": [1, 2], "node": [1, 2], "digest": ["", ""],
            "spans": [[{"row": 1, "low": 0}]] * 2}
    [*pieces.digester(pieces.VOCABULARY, 4)(iter([pa.RecordBatch.from_pydict({k: text[k] for k in ("doc_id", "text")})]))]
    assert pieces.known_chunks.cache_info().currsize == 1
    [*operators_with_texts()[name](iter([pa.RecordBatch.from_pydict(text)]))]
    assert (pieces.known_chunks.cache_info().currsize, pieces.vocabulary.cache_info().currsize) == (0, 0)


def test_a_full_memo_changes_no_result(vocabulary, texts, monkeypatch):
    some = [t for _, t in texts[:40]]
    want = [pieces.n_best(t, pieces.Chunks(vocabulary), 3) for t in some]
    most = max(len({*pieces.chunked(t)}) for t in some)
    monkeypatch.setattr(pieces, "MEMO_CHUNKS", most)
    known = pieces.Chunks(vocabulary)
    for text, (ids, found) in zip(some, want):
        got = pieces.n_best(text, known, 3)
        assert got[0].tolist() == ids.tolist() and got[1] == found and len(known.number) <= most
    few = WordHashes(2)
    words = [b"a", b"b", b"c", b"a", b"d"]
    assert few.of(words).tolist() == WordHashes().of(words).tolist() and len(few) <= 2


def test_changes_rebuild_segmentations_of_their_score(vocabulary, texts):
    known = pieces.Chunks(vocabulary)
    score = {i: vocabulary.score[p] for p, i in vocabulary.id.items()}
    for _, text in texts[:60]:
        chunks = pieces.chunked(text)
        _, found = pieces.n_best(text, known, 4)
        for value, changes in found:
            named = dict(changes)
            ids = [named.get(k) or vocabulary.ids(pieces.best_and_loss(c, vocabulary)[1]) for k, c in enumerate(chunks)]
            assert vocabulary.decode(list(itertools.chain(*ids))) == text
            if all(i in score for x in ids for i in x):
                assert sum(score[i] for x in ids for i in x) == pytest.approx(value)
        assert [v for v, _ in found] == sorted((v for v, _ in found), reverse=True)


def test_pieces_round_trip_through_spark(spark, documents, texts):
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(documents)).collect()}
    assert back == dict(texts)
    frame, rows = awkward(spark)
    found = pieces.encode_digests(frame).collect()
    assert len(found) == len(rows) and sum(not r.round_trip for r in found) == 1  # a literal blank mark
    assert pieces.encode(empty(frame)).count() == 0


# 4 chat

def test_chats_come_back(spark):
    turns = [(1, 0, "user", "<|im_end|>\n[INST] a<\\b [\\ <["), (1, 1, "assistant", "x\\<"), (1, 1, "assistant", "x\\<"), (None, None, None, None), (2, 5, "a<\nb", None),
             (2, 6, "assistant", ""), (2, 7, "assistant", "é" * 70_000), (3, 0, "assistant", "<|im_start|>user\nno")]
    frame = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, part_no int")
    found = {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    stored = {r.conv_id: r for r in chat.read_stored_chats(chat.format_chats(frame)).collect()}
    assert found == stored
    for conv_id in (None, 1, 2, 3):
        own = [t for t in turns if t[0] == conv_id]
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        r = found[conv_id]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_chats(chat.format_chats(empty(frame))).count() == 0


def test_a_conversation_may_span_batches(spark):
    frame = spark.range(25_000).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id) text")
    found = chat.read_chats(chat.format_chats(frame)).collect()
    said = "".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(25_000))
    assert [(r.n_turns, r.turns_sha256) for r in found] == [(25_000, hashlib.sha256(said.encode()).hexdigest())]
    assert chat.format_chats(frame).count() > 1


# 5 minhash

def components_by_hand(rows, width, per_cent):
    sets = []
    for doc_id, text in rows:
        w = [lowered(x) for x in words(text)]
        k = min(width, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w and doc_id is not None else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= per_cent * (len(sets[i]) + len(sets[j]) - common):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("width, per_cent", [(3, 85), (5, 80)])
def test_components_match_brute_force(documents, texts, width, per_cent):
    found = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(documents, width, per_cent).collect()), key=repr)
    assert found == components_by_hand(texts, width, per_cent)


def test_chains_of_copies_in_one_large_group(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    rows = []
    for i in range(1300):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 9])):
            copy[rng.randrange(150)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((i * 7 + 3, " ".join(copy)))
    found = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=repr)
    assert found == components_by_hand(rows, 3, 85)


def test_a_group_of_near_copies_stays_linear(spark, monkeypatch, tmp_path):
    """5,000 near copies, of which many are similar to few others: few rows meet, and the links are a forest."""
    rng, rows = random.Random(4), []
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(160)]
    for i in range(5_000):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            copy[rng.randrange(160)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    real, sizes = minhash.block_links, []

    def counted(per_cent):
        inner = real(per_cent)

        def links(key, block):
            out = inner(key, block)
            with open(f"{tmp_path}/{key[0]}-{key[1]}-{key[2]}", "w") as f:
                f.write(f"{len(block)} {len(out)} {block['component'].nunique()}")
            return out

        return links

    monkeypatch.setattr(minhash, "block_links", counted)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 3, 85)
    # Words put in occur once, so only shingles of the base are shared; as bits, these are quick to count.
    texts = [t.split() for _, t in rows]
    masks = [sum(1 << i for i in range(158) if t[i:i + 3] == base[i:i + 3]) for t in texts]
    full = [len({tuple(t[i:i + 3]) for i in range(158)}) for t in texts]
    top = list(range(5_000))
    for i, mask in enumerate(masks):
        for j in range(i):
            if top[j] != top[i] and (common := (mask & masks[j]).bit_count()) * 100 >= 85 * (full[i] + full[j] - common):
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(top)) and 500 < sum(map(bool, top)) < 1_500
    sizes = [tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert sum(n for n, _, _ in sizes) < 20 * 5_000 and all(links < parts for _, links, parts in sizes)


def test_a_forest_joins_all_that_the_links_join():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, m = rng.integers(1, 30, 2)
        sure = rng.random((n, m)) < 0.08
        ids, others = np.arange(n), 100 + np.arange(m)
        parts, other_parts = rng.integers(0, 12, n), rng.integers(0, 12, m)
        found = minhash.forest(sure, ids, others, parts, other_parts)

        def closed(pairs):
            top = {c: c for c in range(12)}
            for a, b in pairs:
                old, new = top[a], top[b]
                top = {c: new if t == old else t for c, t in top.items()}
            return {frozenset(c for c in top if top[c] == t) for t in top.values()}

        every = [(parts[a], other_parts[b]) for a, b in zip(*np.nonzero(sure))]
        mine = [(parts[a], other_parts[b - 100]) for a, b in zip(found["a"], found["b"])]
        assert closed(mine) == closed(every) and len(mine) <= 11


def test_near_duplicates_of_awkward_rows(spark):
    frame, rows = awkward(spark)
    found = minhash.near_duplicates(frame, 3, 85).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == components_by_hand([r[:2] for r in rows], 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert minhash.near_duplicates(empty(frame)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1200), 1000)}


# 6 language

def test_language_of_texts_held_out(spark, documents):
    langs, table = langid.identify(documents)
    said = langid.predict(documents.withColumn("held", langid.held_out()), langs, table).where("held AND lang IS NOT NULL").collect()
    assert said and sum(r.lang == r.lang_pred for r in said) / len(said) > 0.9
    assert all(0 <= r.score <= 1 for r in said)


def test_bloom_sets_hold_every_learnt_gram(documents):
    langs, table = langid.identify(documents)
    judge = langid.Judge(langs, table)
    assert judge.false.max() < 0.1
    assert judge("1234 !?") == ("und", 0.0) and judge(None) == ("und", 0.0) and judge("")[0] == "und"


def test_a_language_of_one_text_is_learnt(spark):
    rng = random.Random(3)
    rows = [("und here wird viel gesprochen, und zwar oft", "de")] * 10_000
    rows += [(" ".join("".join(rng.choice("aeioust") for _ in range(4)) for _ in range(9)), "xx") for _ in range(5_000)]
    rows += [("123 456", "xx"), ("...", "yy"), (None, "zz"), ("ein text", None)]
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    drawn = langid.sampled(frame, 700).collect()
    assert collections.Counter(r.lang for r in drawn) == {"de": 1, "xx": 700}
    assert len(set(drawn)) == len(drawn)
    assert sorted(drawn) == sorted(langid.sampled(frame.repartition(3), 700).collect())
    langs, table = langid.learn(frame, 700)
    judge = langid.Judge(langs, table)
    assert langs == ["de", "xx", "yy"] and judge(rows[0][0])[0] == "de" and judge(rows[0][0])[1] > 0.9


def test_bits_and_scores_equal_plain_sets(spark, documents):
    chosen = documents.where(~langid.held_out() & documents.lang.isNotNull())
    langs, table = langid.learn(chosen, 40)
    held = {lang: collections.Counter() for lang in langs}
    for r in langid.sampled(chosen, 40).collect():
        held[r.lang].update(langid.grams(r.text).tolist())
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in held.items()}
    common = {lang: {g: s for g, s in of.items() if s >= langid.LEAST_SHARE} for lang, of in share.items()}
    most = collections.defaultdict(float)
    for of in common.values():
        for g, s in of.items():
            most[g] = max(most[g], s)
    plain = np.zeros((langid.SLOTS, 1), np.uint64)
    sets = {}
    for i, lang in enumerate(langs):
        sets[lang] = np.array([g for g, s in common[lang].items() if s * langid.OUTWEIGHED >= most[g]], np.uint64)
        for at in langid.slots(sets[lang]):
            plain[at, 0] |= np.uint64(1 << i)
    assert (plain == table).all()
    judge = langid.Judge(langs, table)
    for r in documents.where(langid.held_out()).limit(30).collect():
        found = langid.grams(r.text)
        if len(found):
            true = [np.isin(found, sets[lang]).mean() for lang in langs]
            lang, score = judge(r.text)
            assert abs(score - true[langs.index(lang)]) < 0.05 and score >= max(true) - 0.05


def test_language_of_awkward_rows(spark):
    frame, rows = awkward(spark)
    langs, table = langid.identify(frame)
    found = langid.predict(frame, langs, table).collect()
    assert len(found) == len(rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in found)
    none, blank = langid.identify(empty(frame))
    assert {r.lang_pred for r in langid.predict(frame, none, blank).collect()} == {"und"}
    assert langid.predict(empty(frame), langs, table).count() == 0


# 7 WARC

def test_archives_of_awkward_pages(spark):
    big = "<p>" + "x" * 300_000 + "é</p>"
    rows = [(1, "http://a/\r\nInjected: 1", "<p>1</p>"), (2, None, "<p>1</p>"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (None, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, size string")
    chunks = warc.read_archives(warc.write_archives(frame)).cache()
    found = {r.page_id: r for r in warc.records(chunks).collect()}
    assert {k: r.refers_to for k, r in found.items()} == {1: 2, 2: None, 3: 4, 4: None, 5: 6, 6: None, None: 6, 7: None}
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (found[page_id].payload_bytes, found[page_id].payload_digest) == (len(data), warc.base32(hashlib.sha1(data).digest()))
    parts = sorted((r.chunk_no, bytes(r.chunk)) for r in chunks.where("page_id = 6").collect())
    assert len(parts) > 4 and b"".join(p for _, p in parts) == big.encode()
    assert warc.records(warc.read_archives(warc.write_archives(frame, revisit_from=100))).where("page_id = 1 AND record_type = 'response'").count() == 1
    assert warc.read_archives(warc.write_archives(empty(frame))).count() == 0


# 8 main text

PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>Home</a></nav>
<div class="cookie-notice">We use cookies, ok.</div><main><article><h1>Head &amp; line</h1><p>First, a <b>bold</b>
 word.<p>Short<br>one<ul><li>a<li>b</ul><form>Name</form>{more}</article></main><aside>More, of that.</aside>
<div id="comments"><p>I like it, really. So much, yes.</p></div><script>var t="</p>";</script><footer>(c)</footer></body></html>"""


def test_main_text_of_pages():
    assert tagpaths.main_text(PAGE.format(more="")) == "Head & line First, a bold word. Short one a b"
    assert tagpaths.main_text(PAGE.format(more="<!-- open")).endswith("a b")
    assert tagpaths.main_text(None) == tagpaths.main_text("") == tagpaths.main_text("<p> </p>") == ""
    assert tagpaths.main_text("a < b &lt;c&gt;") == "a < b <c>"
    assert tagpaths.main_text("<div>" * 3000 + "deep, text." + "<b>" * 3000) == "deep, text."


LONG = "A long sentence, with marks, that goes on and on. " * 40


@pytest.mark.parametrize("body", [f"<div class=body><p>{LONG}</p><p>{LONG}</p></div>", f"<blockquote>{LONG}</blockquote>", f"<pre>{LONG}</pre>",
                                  f"<ul><li>{LONG}<li>{LONG}</ul>", f"<table><tr><td>{LONG}<td>x</table>", f"<section><p>{LONG}</p></section>"])
@pytest.mark.parametrize("around", ["<body><nav>Home</nav><article>%s</article><p>Other, more.</p>", "<body><nav>Home</nav><main><div>%s</div></main>",
                                    "<body><nav>Home</nav><div><div>%s</div></div><footer>(c)</footer>", "<body><nav>Home</nav>%s<footer>(c)</footer>"])
def test_nothing_beside_a_dominating_block_is_lost(around, body):
    found = tagpaths.main_text(around % f"<h1>Head</h1><p>A lead.</p>{body}<p>The <b>end</b>.</p><h2>Last</h2>").split()
    whole = " ".join(body.replace("<", " <").split())
    assert found == f"Head A lead. {re.sub('<[^>]*>', ' ', whole)} The end. Last".split()


def test_an_article_within_an_article_is_part_of_it():
    page = f"<body><article><h1>Head</h1><p>A lead.</p><article><p>{LONG}</p></article></article></body>"
    assert tagpaths.main_text(page) == f"Head A lead. {LONG}".strip()


def test_short_blocks_of_a_body_stay():
    page = f"<body><ul><li><a>Home</a><li><a>News</a></ul><p>{LONG}</p><ul><li>one<li>two</ul><p>{LONG}</p><table><tr><td>3<td>4</table></body>"
    assert tagpaths.main_text(page).split() == [*LONG.split(), "one", "two", *LONG.split(), "3", "4"]


PARAS = f"<h1>Head</h1><p>A lead.</p><p>{LONG}</p>"
SOCIAL = f'<section class="social history"><h2>Social life</h2><p>{LONG}</p></section>'
FOUND = f'<div class="search-results"><p>{LONG}</p><p>Short, too.</p></div>'
NOTICE = '<div class="notice"><p>Our terms changed.</p></div>'
SHARE = f'<div class="share"><ul><li><a href="/a">{LONG}</a><li><a href="/b">Post</a></ul></div>'


@pytest.mark.parametrize("around", ["<body><nav>Home</nav><article>%s</article><p>Other, more.</p>", "<body><nav>Home</nav><div>%s</div><footer>(c)</footer>",
                                    "<body><nav>Home</nav>%s<footer>(c)</footer>", '<body><div class="banner"><a>x</a></div><main>%s</main>',
                                    '<body><nav>Home</nav><div class="search skip">%s</div>'])
@pytest.mark.parametrize("parts", [(PARAS, SOCIAL), (PARAS, FOUND, SOCIAL), (SOCIAL, PARAS), (FOUND, SOCIAL)])
def test_class_words_alone_take_nothing_from_an_article(around, parts):
    want = " ".join(re.sub("<[^>]*>", " ", "".join(parts)).split())
    assert tagpaths.main_text(around % "".join(parts)) == want
    assert tagpaths.main_text(around % (NOTICE + "".join(parts) + SHARE)) == want
    comments = f'<div class="comments"><p>{LONG}</p></div>'
    assert tagpaths.main_text(around % ("".join(parts) + comments)) == want


def test_the_ratios_decide_about_suspects(monkeypatch):
    page = f"<body><article>{PARAS}{NOTICE}{SOCIAL}</article>"
    assert "terms" not in tagpaths.main_text(page) and "Social life" in tagpaths.main_text(page)
    monkeypatch.setattr(tagpaths, "THRESHOLD", 0.0)
    assert "terms" in tagpaths.main_text(page)
    monkeypatch.setattr(tagpaths, "THRESHOLD", 100.0)
    assert "Social life" not in tagpaths.main_text(page)


def test_main_text_of_the_test_pages(spark, data_dir):
    import html
    import re

    pages = read_table(spark, data_dir, "pages")
    found = {r.page_id: r for r in tagpaths.extract(pages).collect()}
    for page in pages.collect():
        body = re.search(r"<article>(.*?)</article>", page.html, re.DOTALL)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|div)[^>]*>", " ", body))
        assert found[page.page_id].text == " ".join(html.unescape(body).split())
        assert found[page.page_id].n_chars == len(found[page.page_id].text)
    assert tagpaths.extract(empty(pages)).count() == 0


# 9 nearest neighbours

def nearest_by_hand(rows, is_query, count):
    known = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in known.items():
        if is_query(i):
            near = sorted((-float(sum(float(a) * float(b) for a, b in zip(v, w))), j) for j, w in known.items() if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:count]]
    return out


def test_recall_is_measured(spark, data_dir):
    frame = read_table(spark, data_dir, "embeddings")
    exact = nearest_by_hand([(r.vec_id, r.embedding) for r in frame.collect()], lambda i: i % 20 == 0, 20)
    found = crosspoly.search(frame, frame.vec_id % 20 == 0).collect()
    got = {(r.query_id, r.vec_id): r.score for r in found}
    want = {(q, j): s for q, near in exact.items() for j, s in near}
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-14) for k in set(got) & set(want))


def recall_on_a_made_table(spark, rows, every, bucket_rows=crosspoly.BUCKET_ROWS):
    """Recall against brute force on directions drawn evenly, as Spark makes them."""
    frame = spark.range(rows).select(F.col("id").alias("vec_id"), F.array(*(F.randn(100 + i).cast("float") for i in range(64))).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    frame = frame.select("vec_id", F.transform("raw", lambda x: (x / norm).cast("float")).alias("embedding"))
    frame = frame.checkpoint()
    known = frame.toPandas().sort_values("vec_id")
    v = np.stack(known["embedding"].to_numpy()).astype(float)
    score = v[::every] @ v.T
    score[np.arange(len(score)), np.arange(0, rows, every)] = -np.inf
    want = {(i * every, int(j)) for i, near in enumerate(np.argpartition(-score, 20, axis=1)[:, :20]) for j in near}
    found = {(r.query_id, r.vec_id) for r in crosspoly.search(frame, F.col("vec_id") % every == 0, bucket_rows=bucket_rows).collect()}
    assert crosspoly.fine_dims(rows, 64, bucket_rows)
    return len(want & found) / len(want)


def test_recall_holds_where_buckets_are_split(spark):
    assert recall_on_a_made_table(spark, 12_500, 50, bucket_rows=12) >= 0.9


@pytest.mark.parametrize("rows", [15, 30])
def test_small_tables_lose_no_neighbour(spark, rows):
    rng = np.random.default_rng(4)
    known = [(i, rng.normal(size=64).tolist()) for i in range(rows)]
    known += [(7, known[7][1])] * 25 + [(100 + i, rng.normal(size=32).tolist()) for i in range(3)]
    frame = spark.createDataFrame(known, "vec_id long, embedding array<double>")
    found = {}
    for r in crosspoly.search(frame, F.col("vec_id") % 5 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest_by_hand(known, lambda i: i % 5 == 0, 20)
    assert {i: len(near) for i, near in found.items()} == {i: len(near) for i, near in want.items()}
    if rows < 20:
        assert found == {i: {j for j, _ in near} for i, near in want.items()}


def test_neighbours_of_hot_vectors_and_ids_with_several_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 0.0]) for i in range(400)] + [(400 + i, rng.normal(size=2).tolist()) for i in range(200)]
    rows += [(i, rng.normal(size=2).tolist()) for i in [5, 10, 20, 20, 20, 410, 411] * 3] + rows[:50]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in sorted(crosspoly.search(frame, F.col("vec_id") % 5 == 0, block_rows=30).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for query in range(0, 600, 5):
        near = {(-(v[0] * w[0] + v[1] * w[1]), j) for i, v in rows if i == query for j, w in rows if j != query}
        assert found.pop(query) == [(j, -s) for s, j in sorted(near)[:20]]
    assert not found
    once = crosspoly.classes(crosspoly.usable(frame), 21)
    assert once.where("size(ids) > 21").isEmpty() and once.groupBy("digest").count().where("count > 1").isEmpty()


def test_nearest_of_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (20, [0.5, 0.5]), (21, [1.0, 2.0, 3.0]),
            (40, [3.0, 2.0, 1.0]), (None, [1.0, 1.0]), (7, []), (8, [float("inf"), 0.0]), (0, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    found = {}
    for r in sorted(crosspoly.search(frame, frame.vec_id % 20 == 0, block_rows=2).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == nearest_by_hand(rows, lambda i: i % 20 == 0, 20)
    assert crosspoly.search(empty(frame), frame.vec_id % 20 == 0).count() == 0


# 10 mixing

def targets_by_hand(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * each >= most * sizes[s]}
        for s in over or open_:
            out[s] = most * sizes[s] if over else weight[s] * each
        left -= sum(out[s] for s in over)
        open_ -= over or set(open_)
    return out


def check_mix(frame, rows):
    sizes = {}
    for doc_id, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    target = targets_by_hand(sizes)
    copies = mixing.mixed_blocks(frame, block_words=500).collect()
    found = [r for r in copies if not r.pass_no]
    assert len(found) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sum(r.words for r in copies if r.pass_no is not None) == sum(taken.values())
    blocks = {}
    for r in copies:
        if r.pass_no is not None:
            blocks.setdefault((r.source, r.block), set()).add(r.shard)
    assert all(len(shards) == 1 for shards in blocks.values())
    assert sorted(map(repr, mixing.mixed_blocks(frame, block_words=500).collect())) == sorted(map(repr, copies))


def test_mix_of_the_documents(documents):
    check_mix(documents, [(r.doc_id, r.text, r.source) for r in documents.collect()])


def test_mix_of_awkward_rows(spark):
    frame, rows = awkward(spark)
    check_mix(frame, [(r[0], r[1], r[3]) for r in rows])
    assert mixing.mixed_blocks(empty(frame)).count() == 0


def test_splitting_tree_keeps_every_quota():
    counts = np.array([1000, 1, 0, 37])
    dealt = mixing.split(counts, 7, np.random.default_rng(1))
    assert (dealt.sum(axis=0) == counts).all() and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 3


def test_the_mix_takes_what_the_tree_deals_out(documents, monkeypatch):
    whole = mixing.per_document(mixing.mixed_blocks(documents, block_words=500))
    want = {r.doc_id: (r.taken, r.n_copies) for r in whole.collect()}
    real = mixing.split

    def half(counts, shards, rng):
        dealt = real(counts, shards, rng)
        if shards == 16:  # the root alone, as the tree calls itself
            dealt[8:] = 0
        return dealt

    monkeypatch.setattr(mixing, "split", half)
    found = {r.doc_id: (r.taken, r.n_copies) for r in mixing.per_document(mixing.mixed_blocks(documents, block_words=500)).collect()}
    assert found.keys() == want.keys() and all(found[d] <= want[d] for d in want)
    assert 0.3 < sum(t for t, _ in found.values()) / sum(t for t, _ in want.values()) < 0.7


def test_texts_come_in_batches_of_a_few_megabytes(spark, monkeypatch):
    """Whatever many rows they have: 6,000 texts of 4,000 characters."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(6_000).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("word"), 1_000).alias("text")).coalesce(1)

    def predictor(langs, table):
        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(["x"] * batch.num_rows), pa.array([float(batch.nbytes)] * batch.num_rows)],
                                                 [*batch.schema.names, "lang_pred", "score"])

        return sizes

    def featurer(width):
        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_digest"), pa.array([batch.nbytes] * batch.num_rows), pa.array([""] * batch.num_rows),
                     pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))], ["doc_id", "text_digest", "n_shingles", "digest", "sketch"])

        return sizes

    monkeypatch.setattr(langid, "predictor", predictor)
    monkeypatch.setattr(minhash, "featurer", featurer)
    try:
        for frame, size in ((langid.predict(docs, ["en"], np.zeros((1, 1), np.uint64)), "score"), (minhash.near_duplicates(docs), "n_shingles")):
            assert frame.agg(F.count("*"), F.max(size) < 5 << 20).first() == (6_000, True)
            spark.conf.set(key, before)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("run", [lambda d: langid.predict(d, ["en"], np.zeros((1, 1), np.uint64)), minhash.near_duplicates], ids=["language", "near_dedup"])
def test_scans_of_texts_hold_few_rows_at_once(spark, tmp_path, run):
    """5,000 rows in one file come in at least nine batches."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/docs")
    try:
        run(spark.read.parquet(f"{tmp_path}/docs"))
        assert 5_000 / int(spark.conf.get(key)) > 9
    finally:
        spark.conf.set(key, before)


# queries with SQL

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, data_dir, name):
    oracle.compare(queries.QUERIES[name](spark, data_dir), oracle.connect(data_dir), queries.ORACLE_SQL[name])
