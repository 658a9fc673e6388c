"""Corpus operators against brute force, round trips and edge cases, on small fixtures."""

import bisect
import datetime as dt
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK, SF_SMALL
from tickwise.llm import (common, decontam, editdist, langid, linededup, lmscore, packing, pii, queries, sharding,
                          simhash, topk, toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, component_id long"
LONG = "lorem ipsum dolor sit amet " * 40_000
EDGE = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "fr", "s", 3),
        (5, "same words in a line that repeats often here", "en", "s", 44), (5, "same words in a line that repeats often here", "en", "s", 44),
        (6, "Same words in a line that repeats often here", "en", "t", 44), (7, LONG, "en", "t", len(LONG)),
        (None, "no id but some words to read", "en", "u", 28), (8, "123 !!! 456", "de", "u", 11), (9, "ünïcødé \U0001f600 wörds", "de", "u", 20)]


@pytest.fixture(scope="module")
def edge(spark):
    common.prepare(spark)
    return spark.createDataFrame([(*r, "x", 0.5, 7) for r in EDGE], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    common.prepare(spark)
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    common.prepare(spark)
    return common.table(spark, SF_SMALL, "documents")


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def _classes(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


# ------------------------------------------------------------------ helpers
def test_edit_distances_match_the_table(spark):
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b, k = "".join(b), rng.randint(0, 3)
        assert editdist.within(a, b, k) == (_lev(a, b) <= k)
    for _ in range(500):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(1, 15)))
        p = "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
        want = min(_lev(p, t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1))
        assert editdist.find(p, editdist.masks(p), t, len(p))[0] == min(want, len(p))


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == _classes({x for e in links for x in e}, links)
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ 1 toxicity
def test_toxicity_held_out_and_edges(spark, edge, empty):
    docs, labels = common.table(spark, SF_CHECK, "documents"), common.table(spark, SF_CHECK, "labels")
    out = {r.doc_id: r for r in queries.queries()["op1_toxicity"](spark, SF_CHECK).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(r.toxic, out[r.doc_id].predicted) for r in labels.collect() if out[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.93 and not any(b and not a for a, b in held)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(edge, none).count() == len(EDGE) and toxicity.toxicity(empty, none).count() == 0
    tox = toxicity.toxicity(spark.createDataFrame([(1, "you idiot, worthless scum"), (2, "a fine day"), (3, None)],
                                                  "doc_id long, text string"), none)
    assert {r.doc_id: r.predicted for r in tox.collect()} == {1: 1, 2: 0, 3: 0}


def test_label_model_finds_the_class_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    v = [np.where(rng.random(4000) < 0.9, y, ~y) for _ in range(3)]
    votes = np.array([*v, v[2], v[2]]).T.astype(int) * 2 - 1
    start = np.where(votes[:, :3].sum(axis=1) > 0, 0.9, 0.1)  # each voter once
    q = toxicity.label_model(votes, np.ones(len(y)), start)
    assert ((q > 0.5) == y).mean() > ((votes.sum(axis=1) > 0) == y).mean()


# ------------------------------------------------------------------ 2 line dedup
def _near(x, y):
    """Whether two lines are within one edit per 20 characters of the shorter one."""
    most = min(len(x), len(y)) // 20
    return abs(len(x) - len(y)) <= most and (x == y or editdist.within(x, y, most))


def test_distances_side_by_side_equal_those_alone():
    rng = random.Random(3)
    xs, ys, most = [], [], []
    for _ in range(3000):
        x = "".join(rng.choice("abcd\u00e9\U0001f600") for _ in range(rng.randint(0, 150)))
        y = list(x)
        for _ in range(rng.randint(0, 12)):
            i = rng.randint(0, len(y))
            y[i:i + rng.randint(0, 2)] = rng.choice(["", "a", "xy"])
        xs.append(x)
        ys.append("".join(y))
        most.append(rng.choice([0, 1, 2, 3, 8, 12, 31, 40]))
    assert editdist.within_many(xs, ys, np.array(most)).tolist() == [_lev(x, y) <= k if len(x) < 60 else editdist.within(x, y, k)
                                                                     for x, y, k in zip(xs, ys, most)]
    assert editdist.within_many([], [], np.zeros(0)).tolist() == []


def test_line_links_of_hot_lines_and_common_segments(spark, monkeypatch):
    monkeypatch.setattr(linededup, "CROWDED_PAIRS", 5)
    monkeypatch.setattr(linededup, "BLOCK", 4)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    bases = [" ".join(word() for _ in range(n)) for n in (5, 12, 14, 16, 17, 40, 130)]
    rows = []
    for k, base in enumerate(bases * 30):
        x = list(base)
        for _ in range(rng.randint(0, max(1, len(x) // 15))):
            i = rng.randint(0, len(x))
            x[i:i + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        rows.append((k, "".join(x)))
        rows.append((1000 + k, base[:len(base) // 2] + " ".join(word() for _ in range(4))))  # the first half in common
    text = {linededup.line_id(x.strip()): x.strip() for _, x in rows}
    want = _classes(text, [(a, b) for a in text for b in text if a < b and _near(text[a], text[b])])
    common.prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # the kernel runs in the workers: its rows are taken through it here with the small limits
    import pyarrow as pa
    keys = linededup.key_rows(docs).orderBy("key", "w").toPandas()
    found = [dict(zip(o, map(np.asarray, o.values()))) for o in linededup._candidates(iter([pa.RecordBatch.from_pandas(keys, preserve_index=False)]))]
    assert any((o["what"] == 1).any() for o in found)
    links = {(min(r), max(r)) for r in map(tuple, linededup.line_links(docs).collect())}
    assert all(_near(text[a], text[b]) for a, b in links)
    assert {n: r for n, r in _classes(text, links).items()} == want


def test_line_keys_without_a_partner_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    lines = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(300)]
    near = [x[:len(x) // 2] + "#" + x[len(x) // 2:] for x in lines[:20]]
    docs = spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string").repartition(3)
    text = {linededup.line_id(x): x for x in lines + near}
    want = {(a, b) for a in text for b in text if a < b and _near(text[a], text[b])}
    common.prepare(spark)
    rows = linededup.key_rows(docs).toPandas()
    met = {linededup.line_id(x) for x in lines[:20] + near}
    assert rows.v.isin(met).mean() > 0.9 and met <= set(rows.v)
    assert len(rows) < sum(linededup.budget(len(x)) + 1 for x in text.values()) / 2  # indexed segments alone were more
    # more segments than a filter serves: turns, with the same rows up to what the filters let pass
    monkeypatch.setattr(linededup, "MOST_FILTER_BITS", 1 << 19)
    monkeypatch.setattr(linededup, "FILTER_BITS", 400)
    assert 400 * (sum(map(len, lines)) // linededup.EDIT_SHARE) > 2 << 19
    turned = linededup.key_rows(docs).toPandas()
    assert set(turned.key[turned.v.isin(met)]) >= set(rows.key[rows.groupby("key").v.transform("nunique") > 1])
    assert {(min(r), max(r)) for r in map(tuple, linededup.line_links(docs).collect())} == want and len(want) == 20


def test_crowded_groups_skip_known_classes():
    import pyarrow as pa
    lines = ["a line of some forty characters or so " + c for c in "abcd"]
    batch = pa.record_batch({"g": [1] * 8, "v": [0, 2, 4, 6, 1, 3, 5, 7], "root": [0, 0, 4, 4] * 2, "line": lines * 2})
    got = [(u, v) for out in linededup._verified_groups(iter([batch])) for u, v in zip(out["u"], out["v"])]
    assert len(got) == 1 and {x // 4 for x in got[0]} == {0, 1}


def test_crowded_texts_are_sent_once_for_all_their_keys(spark, monkeypatch):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = " ".join(word() for _ in range(60))
    lines = [base[:i] + "#" + base[i:] for i in range(0, 300, 6)] + [base[:len(base) // 3] + " ".join(word() for _ in range(40))[:len(base) * 2 // 3]
                                                                     for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    text = {linededup.line_id(x): x for x in lines}
    sent, arrow_map = [], linededup.arrow_map
    monkeypatch.setattr(linededup, "arrow_map", lambda df, fn, schema: (
        sent.append(df.count()) if fn is linededup._verified_groups else None, arrow_map(df, fn, schema))[1])
    common.prepare(spark)
    links = {(min(r), max(r)) for r in map(tuple, linededup.line_links(docs).collect())}
    assert len(sent) == 1 and 0 < sent[0] <= 4 * len(text)  # some of them meet in several classes under a dozen of keys
    assert _classes(text, links) == _classes(text, [(a, b) for a in text for b in text if a < b and _near(text[a], text[b])])


def test_line_turns_are_cut_by_length_and_leave_no_table(spark, monkeypatch):
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    lines = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(300)]
    near = [x[:len(x) // 2] + "#" + x[len(x) // 2:] for x in lines[:40]]
    docs = spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string").repartition(3)
    text = {linededup.line_id(x): x for x in lines + near}
    want = {(a, b) for a in text for b in text if a < b and _near(text[a], text[b])}
    monkeypatch.setattr(linededup, "MOST_FILTER_BITS", 1 << 19)
    monkeypatch.setattr(linededup, "FILTER_BITS", 400)
    common.prepare(spark)
    turns = linededup._turns(docs)
    assert len(turns) > 2 and [t.end for t in turns[:-1]] == [t.least for t in turns[1:]] and {t.parts for t in turns} == {1}
    monkeypatch.setattr(linededup, "FILTER_BITS", 400 << 7)  # one length class is too many
    assert any(t.parts > 1 for t in linededup._turns(docs))
    monkeypatch.setattr(linededup, "FILTER_BITS", 400)
    written, cut = [], linededup.cut

    def noted(df, name):
        out = cut(df, name)
        if name == "line_probes":
            assert not any(os.path.exists(x) for n, x in written if n == "line_probes")  # a turn's probes went before the next
        assert os.path.exists(out.cut_path.removeprefix("file:"))
        written.append((name, out.cut_path.removeprefix("file:")))
        return out

    monkeypatch.setattr(linededup, "cut", noted)
    links = linededup.line_links(docs)
    assert {(min(r), max(r)) for r in map(tuple, links.collect())} == want and len(want) == 40
    left = {n for n, x in written if os.path.exists(x)}
    assert sum(n == "line_probes" for n, _ in written) == len(turns) and left <= {"line_links", "line_crowd_links", "line_star_classes"}


def test_cut_leaves_the_cleanup_setting_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    rows = common.cut(spark.range(1000).repartition(5, "id"), "freed")
    assert rows.count() == 1000 and spark.conf.get(key, None) == was


def test_line_links_equal_brute_force_and_crowded_keys(spark, small, monkeypatch):
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in small.collect()][:60]
    lines = [x for _, t in rows for _, x in linededup.counted_lines(t) if len(x) < 400]
    for k in range(120):
        x = list(rng.choice(lines[:40]))
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(x))
            x[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        rows.append((1000 + k, "".join(x)))
    text = {linededup.line_id(x): x for _, t in rows for _, x in linededup.counted_lines(t)}
    want = {(a, b) for a in text for b in text if a < b and _near(text[a], text[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(min(r), max(r)) for r in map(tuple, linededup.line_links(docs).collect())} == want and want


def test_line_links_with_budgets_that_grow_with_the_line(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        base = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(4, 80)))
        rows.append((2 * k, base))
        x = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 18))):
            i = rng.randint(0, len(x))
            x[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        rows.append((2 * k + 1, "".join(x)))
    text = {linededup.line_id(x): x for _, t in rows for _, x in linededup.counted_lines(t) if len(x) >= 20}
    want = {(a, b) for a in text for b in text if a < b and abs(len(text[a]) - len(text[b])) <= 30
            and editdist.within(text[a], text[b], min(len(text[a]), len(text[b])) // linededup.EDIT_SHARE)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(min(r), max(r)) for r in map(tuple, linededup.line_links(docs).collect())}
    assert got == want and sum(not editdist.within(text[a], text[b], 2) for a, b in want) >= 5


def test_crowded_groups_keep_connectivity():
    import pyarrow as pa
    lines = ["a line of some forty characters or so " + c for c in "abcdefgh"]
    ids = [2 * i for i in range(8)]
    batch = pa.record_batch({"g": [1] * 16, "v": ids + [i | 1 for i in ids], "line": lines * 2})
    got = [(u, v) for out in linededup._verified_groups(iter([batch])) for u, v in zip(out["u"], out["v"])]
    assert set(_classes(ids, got).values()) == {0} and len(got) == 7


def test_crowded_groups_of_long_lines():
    import pyarrow as pa
    base = "some words that come again " * 40
    lines = [base, "x" * 30 + base[:-30], "y" * 25 + base[10:], base[::-1]]
    batch = pa.record_batch({"g": [1] * 8, "v": [0, 2, 4, 6, 1, 3, 5, 7], "line": lines * 2})
    got = [(u, v) for out in linededup._verified_groups(iter([batch])) for u, v in zip(out["u"], out["v"])]
    want = [(2 * a, 2 * b) for a in range(4) for b in range(a) if _lev(lines[a], lines[b]) <= linededup.budget(len(base))]
    assert _classes(range(0, 8, 2), got) == _classes(range(0, 8, 2), want) and want


def test_long_runs_become_crowded_rows():
    import pyarrow as pa
    n = linededup.LONG_RUN + 200_000
    key = np.concatenate([[1], np.full(n, 2), [3]])
    batch = pa.record_batch({"key": key, "w": np.arange(len(key)) << 1 | 40 << 33, "v": np.arange(len(key)) * 2})
    parts = [batch.slice(i, 5000) for i in range(0, len(key), 5000)]
    out = list(linededup._candidates(iter(parts)))
    crowded = np.concatenate([np.asarray(o["a"])[np.asarray(o["what"]) == 1] for o in out])
    assert (crowded == 2).sum() == n and len(crowded) == n


def test_documents_of_blank_rests_and_clashing_columns(spark):
    common.prepare(spark)
    rows = [(1, "a line that repeats", 5, [1], 7), (2, "a line that repeats\n\t\n \u00a0", 5, [1], 7), (3, "\n\t", 5, [1], 7), (None, "else", 5, [1], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, lines array<int>, drop long")
    out = linededup.remove_repeated_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]
    old = docs.withColumnsRenamed({"id": "_drop_id", "lines": "_drop_lines"})
    assert linededup.remove_repeated_lines(old).count() == 3


def test_repeated_lines_go_and_edges(edge, empty):
    got = {(r.doc_id, r.line_no): r.repeated for r in linededup.line_classes(edge).collect()}
    assert got == {(5, 0): False, (6, 0): True}
    out = linededup.remove_repeated_lines(edge)
    assert out.columns == edge.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [1, 2, 3, 4, 5, 5, 7, 8, 9]
    assert linededup.remove_repeated_lines(empty).count() == 0


def test_short_lines_repeat_when_equal(spark):
    common.prepare(spark)
    docs = spark.createDataFrame([(1, "Les.\n\nAnd ornd."), (2, "Les.\nLes!\n "), (3, " Les. ")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no, r.class_lines): r.repeated for r in linededup.line_classes(docs).collect()}
    assert got == {(1, 0, 3): False, (2, 0, 3): True, (3, 0, 3): True}
    out = {r.doc_id: r.text for r in linededup.remove_repeated_lines(docs).collect()}
    assert out == {1: "Les.\n\nAnd ornd.", 2: "Les!\n "}


# ------------------------------------------------------------------ 3 sharding
def test_hilbert_shards(spark, edge, empty):
    common.prepare(spark)
    docs = common.table(spark, SF_CHECK, "documents")
    out = queries.queries()["op3_hilbert_shards"](spark, SF_CHECK).collect()
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    slots = {}
    for r in out:
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.hilbert_shards(edge).count() == len(EDGE) and sharding.hilbert_shards(empty).count() == 0
    null = [r for r in sharding.hilbert_shards(edge).collect() if r.doc_id == 1][0]
    assert (null["size"], null.text_crc32) == (1, 0)
    import itertools
    cells = spark.createDataFrame(list(itertools.product(range(8), repeat=3)), "a int, b int, c int")
    walk = cells.withColumn("h", sharding.hilbert_index([F.col(x) for x in "abc"], 3)).orderBy("h").collect()
    assert [r.h for r in walk] == list(range(512))
    assert all(sum(abs(p[i] - q[i]) for i in range(3)) == 1 for p, q in zip(walk, walk[1:]))


# ------------------------------------------------------------------ 4 decontamination
def test_decontamination_finds_edited_copies_only(spark, edge, empty):
    rng = random.Random(2)
    items = [(i, "".join(rng.choice("abcdefghij  ") for _ in range(100))) for i in range(20)] + [(90, None), (91, ""), (92, "one")]
    docs, want = [], set()
    for i, t in items[:20]:
        t = decontam.normalised(t)
        x = list(t)
        for _ in range(i % 8):
            at = rng.randrange(len(x))
            x[at:at + rng.randint(0, 1)] = rng.choice(["z", "q"])
        docs.append((i, "Before " + "".join(x).upper() + "\n after"))
    for d, t in docs:
        for i, item in items[:20]:
            item, whole = decontam.normalised(item), decontam.normalised(t)
            hit = editdist.find(item, editdist.masks(item), whole, len(item) // decontam.EDIT_SHARE)
            if hit:
                want.add((d, i, hit[0]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and 8 <= len(want) < 20
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(edge, bench).collect()} == {(4, 92)}
    assert decontam.contaminated(empty, bench).count() == 0 == decontam.contaminated(edge, bench.limit(0)).count()


# ------------------------------------------------------------------ 5 pseudonyms
def test_permutation_is_a_bijection_and_undone():
    for n in (1, 2, 3, 10, 97, 1000):
        out = [pii.permute(x, n, b"k", "t") for x in range(n)]
        assert sorted(out) == list(range(n)) and [pii.permute(x, n, b"k", "t", True) for x in out] == list(range(n))


def test_pseudonyms_keep_format_validity_and_links(spark, edge, empty):
    values = {"card": "4111 1111 1111 1111", "date": "2024-02-29", "ssn": "123-45-6789", "phone": "+1 (784) 555-8120",
              "ip": "10.0.0.255", "iban": "GB82WEST12345698765432", "email": "a.bc7@mail2.example.com"}
    new = {}
    for kind, v in values.items():
        text = f"x {v} y, {v} z"
        found = pii.findings(text, b"key")
        assert [f[2] for f in found] == [kind, kind] and found[0][3] == found[1][3] != v, kind
        new[kind] = found[0][3]
        if kind == "ip":  # octets may take one to three digits
            assert all(0 <= int(x) <= 255 for x in new[kind].split(".")) and new[kind].count(".") == 3
            continue
        assert [c.isdigit() for c in new[kind]] == [c.isdigit() for c in v]
        assert pii.rewritten(text, found) == f"x {new[kind]} y, {new[kind]} z"
        undo = next(p for k, _, _, p in pii.KINDS if k == kind)
        if kind != "email":
            assert undo(new[kind], b"key", True) == v
    digits = new["card"].replace(" ", "")
    assert pii.luhn(digits[:-1]) == int(digits[-1]) and pii.iban_rest(new["iban"]) == 1
    dt.date.fromisoformat(new["date"])
    for decoy in ("4111 1111 1111 1112", "2023-02-29", "666-45-6789", "300.1.1.1", "GB82WEST12345698765431", "version 1.2.3"):
        assert pii.findings(f"x {decoy} y", b"key") == [], decoy
    assert pii.findings("x 10.0.0.255 y", b"key") != pii.findings("x 10.0.0.255 y", b"other")
    assert pii.personal_data(edge, "k").count() == 0 == pii.personal_data(empty, "k").count()
    assert {r.doc_id: r.text for r in pii.pseudonymised(edge, "k").collect()}[1] is None


def test_pseudonyms_of_low_area_codes_prefixes_us_dates_and_cards_in_runs():
    def undone(kind, new):
        return {p(new, b"key", True) for k, _, _, p in pii.KINDS if k == kind}

    for kind, v in [("phone", "+1 (017) 555-7713"), ("phone", "+1 (132) 555-1352"), ("phone", "+15551234567"),
                    ("phone", "1-555-123-4567"), ("phone", "1 (555) 123-4567"), ("phone", "(017) 555-7713"),
                    ("date", "12/31/2024"), ("date", "02/29/2024")]:
        found = pii.findings(f"x {v} y", b"key")
        assert [(s, n, k) for s, n, k, _ in found] == [(2, len(v), kind)], v
        assert found[0][3] != v and undone(kind, found[0][3]) == {v}
        assert [c.isdigit() for c in found[0][3]] == [c.isdigit() for c in v]
    card = "4111 1111 1111 1111"
    for before, after in [("", " 12/27"), ("", " 123"), ("12 ", ""), ("2024 ", " 07"), ("", " " + card)]:
        found = pii.findings(before + card + after, b"key")
        assert found[0][:3] == (len(before), len(card), "card") and len(found) == 1 + (after == " " + card)
    for decoy in ("02/30/2024", "13/13/2024", "017-555-7713", "4111 1111 1111 1112 12/27", "12 4111 1111 1111 1112"):
        assert pii.findings(f"x {decoy} y", b"key") == [], decoy


# ------------------------------------------------------------------ 6 LM scores
def test_backoff_scores_equal_brute_force(spark, small, edge, empty, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 60_000)
    monkeypatch.setattr(lmscore, "BUCKET_GRAMS", 10_000)
    got = {r.doc_id: r for r in lmscore.backoff_scores(small).collect()}
    words = {r.doc_id: r.text.encode().lower().split() for r in small.collect()}
    uni, bi = Counter(), Counter()
    for t in words.values():
        uni.update(t)
        bi.update(zip(t, t[1:]))
    total = sum(uni.values())
    for i, t in words.items():
        u, b, n, s = Counter(t), Counter(zip(t, t[1:])), total - len(t), 0.0
        for k, w in enumerate(t):
            factor = 0.4 if k else 1.0
            pair = bi[(t[k - 1], w)] - b[(t[k - 1], w)] if k else 0
            if pair:
                s += math.log10(pair / (uni[t[k - 1]] - u[t[k - 1]]))
            elif uni[w] > u[w]:
                s += math.log10(factor * (uni[w] - u[w]) / n)
            else:
                s += math.log10(factor / (n + 1))
        assert got[i].words == len(t) and got[i].score == pytest.approx(s / len(t), abs=1e-9)
    out = lmscore.backoff_scores(edge).collect()
    assert len(out) == len(EDGE) and [r.score for r in out if r.doc_id in (1, 2, 3)] == [None] * 3
    assert lmscore.backoff_scores(empty).count() == 0


# ------------------------------------------------------------------ 7 SimHash
def _fingerprint(text):
    import xxhash
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    return sum(1 << b for b in range(64) if grams and 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))


def test_simhash_equals_brute_force(spark, small, edge, empty):
    rows = [(r.doc_id, r.text) for r in small.collect() if len(r.text) < 3000] + [(r[0] + 10**6, r[1]) for r in EDGE if r[1] != LONG and r[0]]
    rows = list(dict(rows).items())
    fps = [(i, _fingerprint(t)) for i, t in rows]
    near = [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 3]
    want = _classes({i for i, _ in fps}, near)
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, int(r.fingerprint, 16)) for r in got) == sorted(fps)
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.simhash_components(edge).count() == len(EDGE) and simhash.simhash_components(empty).count() == 0


def test_simhash_links_in_crowded_cells_and_blocks(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(150)}
    fps |= {b ^ (3 << 2 * i) for b in base for i in range(32)}
    want = _classes(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    got = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(frame, 3, block=4).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got) and _classes(fps, got) == want


# ------------------------------------------------------------------ 8 language ID
def test_language_id(spark, edge, empty):
    docs = common.table(spark, SF_CHECK, "documents")
    out = {r.doc_id: r for r in queries.queries()["op8_language_id"](spark, SF_CHECK).collect()}
    rows = docs.collect()
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if out[r.doc_id].held_out]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.99
    got = {r.doc_id: r.lang_pred for r in langid.language_id(edge).collect() if r.doc_id != 5}
    assert got[1] == got[2] == got[3] == got[8] == "und" and got[9] != "und" and len(got) == len(EDGE) - 2
    assert langid.language_id(empty).count() == 0
    one = langid.language_id(edge.where("doc_id = 7")).collect()
    assert one[0].lang_pred in ("en", "und")


def test_codewords_differ_and_many_languages_decode():
    for k in (2, 3, 4, 5, 9):
        code = langid.codewords(k)
        assert all((code[i] != code[j]).sum() >= (code.shape[1] + 1) // 4 for i in range(k) for j in range(i))
    assert langid.codewords(1).shape == (1, 0)


# ------------------------------------------------------------------ 9 packing
def _valid(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def _best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        left = gaps.pop(k) - x if k < len(gaps) else capacity - x
        bisect.insort(gaps, left)
    return len(gaps)


def test_packing_round_trip_and_tightness(spark, small, edge, empty):
    path = queries.default_tokenizer()
    rows = packing.best_fit_pack(small, path).collect()
    used = _valid(rows, 2048)
    assert used <= 1.02 * _best_fit_decreasing([r.length for r in rows], 2048) + 1
    tk = packing.Encoder(path).tokenizer
    for d in small.collect():
        ids = np.array([*tk.encode(d.text, add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted((r.piece, r) for r in rows if r.doc_id == d.doc_id)
        assert [p for p, _ in mine] == list(range(len(mine))) and sum(r.length for _, r in mine) == len(ids)
        assert all(r.length == 2048 for _, r in mine[1:])
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for _, r in mine)
    out = packing.best_fit_pack(edge, path).collect()
    _valid(out, 2048)
    assert [r.length for r in out if r.doc_id in (1, 2)] == [1, 1]
    assert packing.best_fit_pack(empty, path).count() == 0


def test_encoder_equals_the_tokenizer_on_odd_space():
    enc = packing.Encoder(queries.default_tokenizer())
    rng = random.Random(2)
    bits = ["a", "Zé", " ", "  ", "\n", ".", "'s", "'", "1", "\t", "ß!", " ", "|", "日本", "<|endoftext|>", "́"]
    texts = ["".join(rng.choice(bits) for _ in range(12)) for _ in range(2000)] + ["", " ", None]
    scripts = [*range(32, 127), *range(0xA0, 0x250), *range(0x391, 0x3CA), *range(0x410, 0x450), *range(0x5D0, 0x5EB), *range(0x660, 0x66A),
               *range(0x905, 0x93A), 0x2003, 0x200B, 0x2028, 0x3000, *range(0x4E00, 0x4E40), 0x1F600, 0x1F468, 0x200D, 0xFE0F]
    texts += ["".join(chr(rng.choice(scripts)) if rng.random() < 0.8 else rng.choice(" \n") for _ in range(30)) for _ in range(2000)]
    texts += ["x" * 50_000, " " * 50_000, "ab\n" * 20_000]
    assert enc.fast is not None
    want = [np.array(e.ids, dtype="<u4").tobytes()
            for e in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert enc.encode(texts) == want


def test_special_tokens_written_out_are_encoded_as_by_the_file(spark):
    from tokenizers import Tokenizer
    path = queries.default_tokenizer()
    fresh = Tokenizer.from_file(path)
    token = "<|endoftext|>"
    assert not any(" " in t.content or t.lstrip or t.rstrip for t in fresh.get_added_tokens_decoder().values())
    rng = random.Random(6)
    bits = ["a", "Zé", " ", " ", "  ", "\n", ".", "'s", "1", "\t", "|", token, token]
    texts = [f"x {token} y", token, f"{token}{token}", f" {token} ", *("".join(rng.choice(bits) for _ in range(10)) for _ in range(2000))]
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert packing.Encoder(path).encode(texts) == want and fresh.token_to_id(token) in np.frombuffer(want[0], dtype="<u4")
    common.prepare(spark)
    rows = packing.best_fit_pack(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), path).collect()
    ids = want[0] + np.array([0], dtype="<u4").tobytes()
    assert [(r.length, r.ids_crc32) for r in rows] == [(len(ids) // 4, zlib.crc32(ids))]


def test_packing_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 40)
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(300)] + [7] * 150 + [100] * 5
    items = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    got = packing.pack(items, 100).join(items, "pid").collect()
    assert len(got) == len(lengths)
    assert _valid(got, 100) <= 1.05 * _best_fit_decreasing(lengths, 100) + 1


def test_packing_of_short_pieces_over_many_ranges_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 60)
    rounds = []
    real = packing.cut
    monkeypatch.setattr(packing, "cut", lambda df, name: (rounds.append(name), real(df, name))[1])
    rng = random.Random(4)
    lengths = [rng.randint(20, 60) for _ in range(1200)]
    items = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    got = packing.pack(items, 2048).join(items, "pid").collect()
    assert len(got) == len(lengths)
    assert _valid(got, 2048) <= 1.05 * _best_fit_decreasing(lengths, 2048) + 1
    assert rounds.count("pack") <= 10       # a sequence holds about 50 pieces


def test_brackets_give_a_gap_as_many_pieces_as_fit():
    r = packing._Range
    got = packing._brackets({0: r(items=7, greatest_item=10), 1: r(), 2: r(gaps=3, least_gap=35), 3: r(gaps=2, least_gap=50)})
    assert got == [packing._Bracket(0, 6, 7, 2, 0, 3, 3)]


def test_a_gap_goes_on_with_lower_ranges_in_its_room():
    r = packing._Range
    got = packing._brackets({0: r(items=9, greatest_item=4), 1: r(items=1, greatest_item=20), 2: r(gaps=2, least_gap=30)})
    b = packing._Bracket
    assert got == [b(1, 0, 1, 2, 0, 1, 1), b(0, 8, 7, 2, 1, 1, 7), b(0, 1, 2, 2, 0, 1, 2)]
    rng = random.Random(5)
    for _ in range(200):
        edges = sorted(rng.randint(1, 300) for _ in range(30))
        ranges = {p: r(g := rng.randint(0, 4), max(1, lo) if g else 0, rng.randint(0, 6), hi)
                  for p, (lo, hi) in enumerate(zip(edges, edges[1:]))}
        used, room = set(), {}
        for k in packing._brackets(ranges):
            assert k.items <= k.gaps * k.each and k.item_part < k.gap_part and k.gap_rank + k.gaps <= ranges[k.gap_part].gaps
            for i in range(k.items):
                item, gap = (k.item_part, k.item_rank - i), (k.gap_part, k.gap_rank + i // k.each)
                assert item not in used and 0 <= item[1] < ranges[k.item_part].items
                used.add(item)
                room[gap] = room.get(gap, ranges[k.gap_part].least_gap) - ranges[k.item_part].greatest_item
        assert all(v >= 0 for v in room.values())


# ------------------------------------------------------------------ 10 top-k
def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=5)]) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(700, 760)] + [(760, [0.0] * 5), (780, None), (781, [1.0, None, 0.0, 0.0, 0.0]),
                                                         (782, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(frame, F.col("vec_id") % 20 == 0).collect())
    good = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows[:761]]
    want = []
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i)[:20]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.exact_topk(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_of_repeated_query_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    rows += [rows[0]] * 2 + [(1, rows[7][1])]  # one query row three times, one id with two vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(frame, F.col("vec_id") < 2).collect())
    good = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows]
    want = []
    for i, q in good:
        if i < 2:
            best = sorted((-int(q @ v), j) for j, v in good if j != i)[:20]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want) and len(got) == 5 * 20


def test_topk_blocks_stay_bounded_on_one_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)

    def sized(k, scale):
        def run(queries, rows):
            import pandas as pd
            return pd.DataFrame({"row": queries["row"], "query_id": queries["id"], "vec_id": 0, "score": len(rows), "beyond": None})
        return run

    monkeypatch.setattr(topk, "_search_group", sized)
    frame = spark.createDataFrame([(5, [1.0, 2.0])] * 1000 + [(0, [1.0, 1.0])], "vec_id long, embedding array<double>")
    blocks = [r.score for r in topk.exact_topk(frame, F.col("vec_id") == 0, k=50).collect()]
    assert sum(blocks) == 1001 and max(blocks) < 100


def test_topk_bounds_settle_queries_and_leave_few_candidates(spark, monkeypatch):
    rng = np.random.default_rng(3)
    scored = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            out = super().__getitem__(at)
            if isinstance(at, tuple) and isinstance(at[1], np.ndarray) and at[1].dtype != bool:
                scored.append(len(at[1]))
            return out

    for n, k in ((2000, 20), (60, 20), (15, 20), (3, 1)):
        x = np.floor(rng.normal(size=(n, 64)) * 64)
        lists = topk.SortedLists(np.arange(n), x)
        lists.x = lists.x.view(Watched)
        q = np.arange(0, n, 20)
        scored.clear()
        at, ids, score = lists.search(q, x[q], k)
        for i in range(len(q)):
            best = sorted((-int(x[q[i]] @ x[j]), j) for j in range(n) if j != q[i])[:k]
            assert [(-s, j) for s, j in zip(score[at == i].tolist(), ids[at == i].tolist())] == best
        assert len(scored) == len(q) and (n <= k or max(scored) <= max(min(4 * k, (n + k) // 2), n // 32))


def test_topk_of_products_beyond_64_bits(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 3)
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e300, 2.5, 1e200, 0.0, 3e18, -7.0]) for _ in range(2)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = lambda x: int(x) * 64 if abs(x) >= 2**53 else math.floor(64 * x)
    long = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = []
    for i, q in rows:
        scores = sorted((-sum(whole(a) * whole(b) for a, b in zip(q, v)), j) for j, v in rows if j != i)
        want += [(i, r + 1, j, long(-s)) for r, (s, j) in enumerate(scores[:5])]
    assert sorted(map(tuple, topk.exact_topk(frame, F.col("vec_id") >= 0, k=5).collect())) == sorted(want)
    numbers = [rng.choice([-1, 1]) * rng.randint(0, 10**rng.randint(1, 40)) for _ in range(300)]
    assert sorted(numbers) == sorted(numbers, key=topk._sortable)


# ------------------------------------------------------------------ pipeline
def test_pipeline_equals_its_operators_by_brute_force(spark):
    import corpus_pipeline
    docs = common.table(spark, SF_SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.cut(stage(spark, docs, SF_SMALL), f"t_{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "language_id":
            assert set(after) == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            lines = [(i, n, line.strip()) for i in sorted(before) for n, line in enumerate(before[i].split("\n")) if line.strip()]
            first = {}
            for i, n, line in lines:
                first.setdefault(line, (i, n))
            texts = sorted(first, key=first.get)
            place = {x: k for k, x in enumerate(texts)}
            by_size = sorted(texts, key=len)
            links = []
            for k, x in enumerate(by_size):
                for y in by_size[k + 1:]:
                    if len(y) - len(x) > len(x) // 20:
                        break
                    if _near(x, y):
                        links.append((place[x], place[y]))
            root = _classes(range(len(texts)), links)
            gone = {(i, n) for i, n, line in lines if first[texts[root[place[line]]]] != (i, n)}
            kept = {}
            for i in before:
                out = "\n".join(line for n, line in enumerate(before[i].split("\n")) if (i, n) not in gone)
                if out.strip() or out == before[i]:
                    kept[i] = out
            assert after == kept
        elif name == "simhash_dedup":
            fps = {i: simhash.fingerprint(t) for i, t in before.items()}
            roots = _classes(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
            assert set(after) == {i for i, r in roots.items() if i == r}
        else:
            items = [decontam.normalised(r.text) for r in common.table(spark, SF_SMALL, "benchmark").collect()]
            leak = {i for i, t in before.items() for x in items
                    if editdist.find(x, editdist.masks(x), decontam.normalised(t), len(x) // decontam.EDIT_SHARE)}
            assert set(after) == set(before) - leak
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in rows} == set(after)
    _valid(rows, 2048)
    assert corpus_pipeline.run(spark, SF_SMALL).count() == len(rows)


def test_pipeline_stages_on_no_rows_and_clashing_columns(spark):
    import corpus_pipeline
    common.prepare(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long, pipeline_row int, row long, id string, drop int, fp long"
    rows = [(i, f"some words of document number {i} that stand alone in the table", "en" if i % 2 else "fr", "s", 50, 1, 2, "x", 3, 4) for i in range(6)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (9, "", "en", "s", 0, 1, 2, "x", 3, 4)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and {r.pipeline_row for r in out.collect()} <= {1, None}, name
        assert stage(spark, docs.where("false"), SF_SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF_SMALL).count() == 0


def test_pipeline_tells_rows_without_or_with_repeated_ids_apart(spark):
    import corpus_pipeline
    common.prepare(spark)
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(12))
    benchmark = common.table(spark, SF_SMALL, "benchmark").where("length(text) > 60").first().text
    clean = [text() for _ in range(4)]
    one = text()

    def after(stage, rows):
        out = dict(corpus_pipeline.STAGES)[stage](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), SF_SMALL)
        assert out.columns == ["doc_id", "text", "lang"]
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    def rows(*pairs):
        return [(i, t, "en") for i, t in pairs]

    def wanted(*pairs):
        return sorted(pairs, key=str)

    none = [(None, t) for t in clean]
    assert after("decontamination", rows(*none, (None, benchmark))) == wanted(*none)
    learned = [(i, text(), "en") for i in range(20)] + [(i, "zwxy vuts rrqz " * 6 + str(i), "fr") for i in range(20, 40)]
    assert after("language_id", rows(*none, (None, "123")) + learned) == wanted(*none, *(r[:2] for r in learned))
    assert after("simhash_dedup", rows(*none, (None, clean[0]), (7, one), (7, one), (8, one))) == wanted(*none, (7, one))
    assert after("line_dedup", rows((None, clean[0] + "\n" + one), (None, one + "\n" + clean[1]), (3, one), (3, clean[2]), (3, clean[2]))) == wanted(
        (None, clean[0]), (None, clean[1]), (3, one), (3, clean[2]))


def test_pipeline_drops_few_rows_without_a_shuffle_of_the_texts(spark, monkeypatch):
    import corpus_pipeline as cp
    common.prepare(spark)
    docs = spark.createDataFrame([(1, "a b"), (None, "c d"), (1, None), (2, "")], "doc_id long, text string")
    rows = cp._rows(docs)
    ids = rows.where("text is null").select(cp._id(rows))
    for most in (200_000, 0):
        monkeypatch.setattr(cp, "BROADCAST_IDS", most)
        out = cp._only(rows, ids, "left_anti")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (most > 0)
        assert sorted(map(repr, out.collect())) == sorted(repr(r) for r in docs.where("text is not null").collect())
        assert [tuple(r) for r in cp._only(rows, ids, "left_semi").collect()] == [(1, None)]
