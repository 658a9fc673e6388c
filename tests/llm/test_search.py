"""Prefix trie, license scan and ranked search against brute force, on small fixtures and the small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tickwise.llm import common, convtrie, licenses, queries, ranking

TURNS = "conv_id long, turn long, role string, text string, key string, path string, shard int, units string"
DOCS = "doc_id long, text string, words string, hash long, row long, label string, n long, tf long, score double"


# ------------------------------------------------------------------ 11 prefix trie
def _trie(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            conv[c].append(((turn is not None, turn or 0), role, tie, text))
    paths = {}
    for c in conv:
        conv[c].sort(key=lambda t: t[:3])
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple((r, x) for _, r, _, x in conv.get(c - c % 5, [])[:h] + conv[c][h:])
    nodes, kids = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
            if d:
                kids[p[:d - 1]].add(p[:d])
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
        ends = ",".join(map(str, sorted(c for c in nodes[p] if paths[c] == p)))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _rebuilt(turns, **how):
    c = F.col("conv_id")
    out = convtrie.prefix_trie(turns, c - c % 5, common.crc_mod(c, 9), **how)
    return sorted(map(tuple, out.collect()), key=repr)


def test_double_array_holds_its_paths_and_no_others():
    rng = random.Random(3)
    for _ in range(30):
        codes = rng.randint(1, 12)
        paths = sorted({tuple(rng.randint(1, codes) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 60))})
        trie = convtrie.DoubleArray([np.array(p, dtype=np.int64) for p in paths], codes)
        held = {p[:d] for p in paths for d in range(len(p) + 1)}
        place = {(): 0}
        for p in sorted(held, key=len):
            for c in range(1, codes + 1):
                to = int(trie.step(np.array([place[p]]), np.array([c]))[0])
                assert (to >= 0) == (p + (c,) in held)
                if to >= 0:
                    place[p + (c,)] = to
        assert len(set(place.values())) == len(place) == (trie.check >= 0).sum() + 1


def test_trie_equals_brute_force_whatever_the_shards(spark):
    common.prepare(spark)
    turns = common.table(spark, SF_CHECK, "conversations")
    want = _trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    got = queries.queries()["op11_prefix_trie"](spark, SF_CHECK)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert _rebuilt(turns, shard_paths=5) == want


def test_trie_edges_ties_prefixes_and_hot_branches(spark):
    common.prepare(spark)
    rng = random.Random(7)
    rows = [(None, 1, "user", "no conversation"), (0, None, None, None), (0, 0, "user", "a"), (0, 0, "system", "a"),
            (0, 0, "user", "b"), (0, 2, "user", "a"), (0, 2, "user", "a"), (3, 5, "us", "era"), (4, 5, "use", "ra"),
            (12, 1, "user", "own"), (-7, 1, "user", "ünï \U0001f600"), (9_999_999_999, 0, "user", "x" * 300_000)]
    rows += [(100 + k, t, "user", f"long {t}") for k in range(2) for t in range(200)]
    for c in range(200, 320):  # one first turn for all, many different next ones, paths that are prefixes of others
        rows += [(c, t, "user", "hi" if t == 0 else rng.choice("abc")) for t in range(rng.randint(1, 6))]
    want = _trie(rows)
    turns = spark.createDataFrame([(*r, "k", "p", 1, "u") for r in rows], TURNS).repartition(5)
    assert _rebuilt(turns) == want
    assert _rebuilt(turns, shard_paths=3) == want
    assert _rebuilt(turns.where("false")) == []
    assert [r[:7] for r in _rebuilt(turns.where("conv_id = 12"))] in ([(12, 0, None, 1, 0, 1, 0)],  # no head, own turn cut off
                                                                    [(12, 0, None, 1, 1, 1, 0), (12, 1, 12, 1, 0, 1, 0)])


def test_trie_of_one_very_common_conversation(spark):
    common.prepare(spark)
    n = convtrie.ID_RUN + 5_000
    turns = spark.range(n).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                                  F.lit("user").alias("role"), F.lit("hello").alias("text"))
    ends = hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert _rebuilt(turns) == [(0, 0, None, n, 1, 1, 5 * (n - 1), none), (0, 1, 0, n, 0, 1, 5 * (n - 1), ends)]


# ------------------------------------------------------------------ 12 license scan
def _base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = sorted((i, t.label) for t in licenses.PHRASES for p in [t.text.split()] for i in range(len(words) - len(p) + 1)
                if words[i:i + len(p)] == p)
    return (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))


def test_license_places_equal_brute_force(spark):
    docs = common.table(spark, SF_CHECK, "documents")
    want = {r.doc_id: _base(r.text) for r in docs.collect()}
    out = queries.queries()["op12_license_scan"](spark, SF_CHECK)
    got = {r.doc_id: r for r in out.collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.values())
    for name in ("Python", "Arrow", "Pandas", "MapIn"):
        assert name not in out._jdf.queryExecution().executedPlan().toString()


def test_license_scan_edges_repeats_and_overlaps(spark):
    texts = [None, "", " \n", "cc", "CC by-NC", "cc by nc cc by nc by nc", "Under the MIT License, under the mit license!",
             "under the mit  licensed", "APACHE LICENSE, VERSION 2.0 under\nthe\tMIT.license", "ünder the mit license",
             "ÉCC BY NC", "word " * 30_000 + "cc by nc " * 2_000, "under the mİt license", "cc by sa or cc_by_nc"]
    rows = [(i if i % 4 else None, t, "w", 1, 2, "l", 3, 4, 0.5) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
                  for r in licenses.license_scan(docs).collect())
    assert got == Counter((r[0], *_base(r[1])) for r in rows)
    assert licenses.license_scan(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(docs, (licenses.phrase("x", "two words"),))


def test_license_notices_with_words_changed_added_and_removed(spark):
    rng = random.Random(2)
    notice = {t.label: t.text.split() for t in licenses.NOTICES if t.slack == 8}
    rows, want = [], {}
    for label, words in notice.items():
        for edits, found in ((0, True), (max(1, len(words) // 60), True), (len(words), False)):
            w = list(words)
            for _ in range(edits):
                i = rng.randrange(1, len(w) - 1)
                w[i:i + rng.randint(0, 1)] = rng.choice([[], ["quux"], ["foo", "bar"]])
            doc = ["some", "words", "before"] * 7 + w + ["and", "after"]
            rows.append((len(rows), " ".join(doc)))
            want[len(rows) - 1] = (label, found)
    halves = notice["mit"]
    rows.append((900, " ".join(halves[:len(halves) // 2])))
    rows.append((901, " ".join(halves[len(halves) // 2:] + ["x"] * 500 + halves[:len(halves) // 2])))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, found) in want.items():
        if found and label != "gpl-2":
            assert label in got[i].labels.split(","), (label, got[i])
            assert got[i].score >= 0.8
        elif not found:
            assert label not in got[i].labels.split(",") or got[i].score >= 0.8
    assert got[900].labels == "" and 0.4 < got[900].score < 0.6 and "mit" not in got[901].labels.split(",")


# ------------------------------------------------------------------ 13 ranked search
def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _ranked(docs, items, k):
    bags = [(d, Counter(_terms(_lower(t)))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (doc, bag), size in zip(bags, sizes):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * (100 - 90 + (90 * size * n) // total)))
                        for t in set(_terms(_lower(text))) if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def test_terms_equal_their_pattern():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(chr(rng.choice([*range(128), 0xe9, 0x130, 0x2028, 0x1f600, 0xa0])) for _ in range(40))
        assert [t.decode() for t in ranking.terms(text)] == _terms(_lower(text))


def test_sharing_plan_sums_items_and_saves_additions():
    rng = random.Random(6)
    shared = [rng.sample(range(60), 12) for _ in range(4)]
    items = [set(rng.choice(shared) + rng.sample(range(60), rng.randint(0, 5))) for _ in range(50)] + [set(), set(shared[0])]
    plan = ranking.SharingPlan(items, 60)
    values = np.array([[rng.randint(0, 10**12) for _ in range(7)] for _ in range(60)])
    sums = np.zeros((plan.n_classes, 7), dtype=np.int64)
    used = plan.class_of >= 0
    np.add.at(sums, plan.class_of[used], values[used])
    got = plan.evaluate(sums)[plan.node_of]
    assert all((got[i] == values[sorted(item)].sum(axis=0)).all() for i, item in enumerate(items))
    assert len(plan.parent) - 1 < sum(map(len, items))
    same = ranking.SharingPlan([{1, 2, 3}, {1, 2, 3}, {4, 5}], 6)
    assert same.n_classes == 2 and len(same.parent) == 3


def test_ranked_search_equals_brute_force_in_one_and_many_blocks(spark):
    common.prepare(spark)
    docs, items = (common.table(spark, SF_CHECK, t) for t in ("documents", "benchmark"))
    want = _ranked([tuple(r) for r in docs.select("doc_id", "text").collect()],
                   [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    got = queries.queries()["op13_ranked_search"](spark, SF_CHECK)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    got = ranking.ranked(docs, items, k=10, block_chars=3_000)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_ranked_search_edges(spark):
    common.prepare(spark)
    texts = [None, "", "...", "alpha beta", "Alpha BETA gamma", "alpha " * 50_000, "alpha beta", "É é alpha", "delta"]
    docs = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(4, "Alpha BETA gamma"), (None, "alpha beta")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "!!"), (None, "é"), (5, "delta delta"), (6, "absent")]
    frame = spark.createDataFrame([(*d, "w", 1, 2, "l", 3, 4, 0.5) for d in docs], DOCS).repartition(4)
    asked = spark.createDataFrame([(*i, 1, "d") for i in items], "item_id long, text string, row long, doc_id string")
    for k in (1, 3, 10):
        got = sorted(map(tuple, ranking.ranked(frame, asked, k=k).collect()), key=repr)
        assert got == _ranked(docs, items, k)
    assert ranking.ranked(frame.where("false"), asked).count() == 0
    assert ranking.ranked(frame, asked.where("false")).count() == 0


# ------------------------------------------------------------------ 3 shards on disk
def test_written_shards_hold_every_row_once_and_prune(spark, tmp_dir):
    from tickwise.llm import sharding
    common.prepare(spark)
    rows = [(i % 50 if i % 7 else None, f"t{i % 20}", "en" if i % 3 else "de", f"s{i % 5}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    sharding.write_shards(docs, f"{tmp_dir}/shards", shards=8)
    got = spark.read.parquet(f"{tmp_dir}/shards")
    assert Counter(map(tuple, got.drop("shard").collect())) == Counter(rows)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    spread = lambda df, by: sum(r.high - r.low for r in df.groupBy(by).agg(F.max("n_chars").alias("high"), F.min("n_chars").alias("low")).collect())
    dealt = got.withColumn("dealt", F.pmod(F.xxhash64("n_chars"), F.lit(8)))
    assert spread(got, "shard") < 0.8 * spread(dealt, "dealt")  # min/max of a shard rule more files out
    again = got.withColumn("slot", F.lit(1)).withColumn("row", F.lit("x"))
    assert sharding.write_shards(again, f"{tmp_dir}/again") == "shard_"
    assert Counter(map(tuple, spark.read.parquet(f"{tmp_dir}/again").select(*again.columns).collect())) == Counter(map(tuple, again.collect()))


def test_a_hot_cell_is_numbered_in_many_groups(spark):
    from tickwise.llm import sharding
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
                                    F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    out = sharding.hilbert_shards(docs, shards=7, group_rows=100).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


# ------------------------------------------------------------------ 4 short items
def test_a_short_item_inside_a_word_does_not_hide_a_true_copy():
    from tickwise.llm import decontam
    item = "the quick brown fox jumps"
    items = decontam.Items([(1, item)])
    found = lambda text: items.matches(decontam.normalised(text))
    assert found(f"x{item} {item} end") == [(0, 0, 27, 25)]
    assert found(f"a{item}b") == [] and found(f"so {item}") == [(0, 0, 3, 25)]
    assert found("and the quick brovn fox jumps here") == [(0, 1, 4, 25)]
