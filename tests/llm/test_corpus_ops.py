"""Operators that look across documents, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, line_dedup, ngram_join, packing, quality, sharding, substring_dedup
from tidemark.llm.components import components
from tidemark.llm.runtime import Durable, seen, sizes, small

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_shingles long, key long, dropped string"


def documents(spark, pairs):
    return spark.createDataFrame([(i, t, "s", 9, 9, "x") for i, t in pairs], SCHEMA)


def prose(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def mutated(rng, text, share):
    return " ".join(f"m{rng.randint(0, 10**9)}" if rng.random() < share else w for w in text.split(" "))


ODD = [(None, None), (None, "a b"), (900, None), (901, ""), (902, " \n "), (903, "one"), (903, "one"), (904, "x y z w"), (905, "X y Z w"), (906, "x y z w v"), (907, "x y z w v")]


# ---- sharding


def test_shards(spark, tmp_path):
    rng = random.Random(1)
    pairs = [*ODD, *((i, prose(rng, rng.randint(1, 300))) for i in range(400))]
    rows = sharding.shard(documents(spark, pairs), 8, str(tmp_path / "map")).collect()
    assert len(rows) == len(pairs)
    load, places = Counter(), defaultdict(list)
    want = Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in pairs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for r in rows:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    slots = defaultdict(set)
    for r in rows:
        slots[r.vslot].add(r.shard)
    assert all(len(s) == 1 for s in slots.values())


@pytest.mark.parametrize("rows", ["equal", "null", "long"])
def test_shards_of_hot_slots(spark, tmp_path, rows):
    rng = random.Random(21)
    pairs = [(i, prose(rng, 8)) for i in range(100)]
    pairs += {"equal": [(7, "just the same text again")] * 400, "null": [(None, None)] * 500, "long": [(1000 + i, "long " * 400) for i in range(64)]}[rows]
    got = sharding.shard(documents(spark, pairs), 8, str(tmp_path / "map"), slots=64 if rows == "long" else 4096).collect()
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert len(got) == len(pairs) and len(load) == 8
    largest = max(r["size"] for r in got)
    assert max(load.values()) - min(load.values()) <= max(0.02 * sum(load.values()) / 8, 2 * largest)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    stored = sharding.SlotMap.load(spark, str(tmp_path / "map"), 1)
    assert stored == sharding.SlotMap.dealt(8, len(stored.shard_of))


def test_slot_maps(spark, tmp_path):
    rng = random.Random(2)
    sizes = {s: rng.randint(1, 1000) for s in range(512)}
    one = sharding.SlotMap.first(sizes, 8, 512)
    two = one.rebalanced(sizes, 9)
    total = [sum(sizes[s] for s, sh in enumerate(two.shard_of) if sh == k) for k in range(9)]
    assert max(total) - min(total) < 0.02 * sum(total)
    moved = [b for a, b in zip(one.shard_of, two.shard_of, strict=True) if a != b]
    assert len(moved) < 1.3 * 512 / 9 and moved.count(8) > 0.9 * len(moved)
    back = two.rebalanced(sizes, 8)
    assert max(back.shard_of) == 7 and back.version == 3
    one.save(spark, str(tmp_path))
    two.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 1) == one and sharding.SlotMap.load(spark, str(tmp_path), 2) == two
    with pytest.raises(Exception, match="already exists"):
        one.save(spark, str(tmp_path))


def test_hot_slot_is_alone():
    m = sharding.SlotMap.first({0: 1000, **{s: 10 for s in range(1, 64)}}, 4, 64)
    assert sum(1 for s in m.shard_of if s == m.shard_of[0]) == 1


def test_no_documents(spark, tmp_path):
    none = documents(spark, [])
    assert sharding.shard(none, 8, str(tmp_path / "m")).count() == 0
    assert packing.pack(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert line_dedup.without_lines(none).count() == 0
    assert ngram_join.similar(none).count() == 0
    assert substring_dedup.repeats(none).count() == 0
    assert substring_dedup.without_repeats(none).count() == 0
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- packing


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(20):
        histogram = Counter(rng.randint(0, 40) for _ in range(30))
        edges, k = sorted(histogram), rng.randint(1, 4)
        cost = lambda cuts: sum(n * (min(c for c in cuts if c >= e) - e) for e, n in histogram.items())  # noqa: E731, B023
        best = min(cost((*c, edges[-1])) for c in combinations(edges[:-1], min(k, len(edges)) - 1))
        got = packing.boundaries(histogram, k)
        assert len(got) <= k and got[-1] == edges[-1] and cost(got) == best


def test_pack(spark):
    rng = random.Random(4)
    pairs = [*ODD, *((i, prose(rng, int(rng.paretovariate(1) * 20) % 3000)) for i in range(300)), (5000, "w " * 9000)]
    rows = packing.pack(documents(spark, pairs), buckets=4, budget=4000).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i is None, i or 0, len(WORD.findall(t or ""))) for i, t in pairs)
    batches = defaultdict(list)
    for r in rows:
        assert 0 <= r.padding == r.bucket_tokens - r.n_tokens
        batches[r.batch].append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and sorted(r.place for r in b) == list(range(len(b)))
        assert len(b) * b[0].bucket_tokens <= 4000 or len(b) == 1
    assert sorted(batches) == list(range(len(batches)))
    full = Counter(r.bucket for r in rows)
    assert len(batches) == sum(math.ceil(n / max(1, 4000 // next(r.bucket_tokens for r in rows if r.bucket == k))) for k, n in full.items())


def test_boundaries_of_long_texts():
    histogram = {50: 50, 20_000: 6, 40_000: 1}
    assert packing.boundaries(histogram, 3) == [50, 20_000, 40_000]
    rng = random.Random(20)
    for _ in range(5):
        histogram = {rng.randint(0, 10**6): rng.randint(1, 10**6) for _ in range(60)}
        edges, k = sorted(histogram), rng.randint(1, 8)
        best = {0: 0}  # by documents up to an edge, all partitions of the edges into k runs
        for _ in range(k):
            best = {j: min(c + sum(histogram[e] * (edges[j - 1] - e) for e in edges[i:j]) for i, c in best.items() if i <= j) for j in range(len(edges) + 1)}
        got = packing.boundaries(histogram, k)
        assert sum(n * (min(c for c in got if c >= e) - e) for e, n in histogram.items()) == best[len(edges)]


def test_pack_over_budget(spark):
    pairs = [*((i, "w " * 20_000) for i in range(6)), *((10 + i, "a b c") for i in range(50)), (100, "w " * 40_000), (101, "w " * 90_000)]
    rows = {r.doc_id: r for r in packing.pack(documents(spark, pairs), buckets=3, budget=32_768).collect()}
    assert len(rows) == len(pairs) and all(r.padding == 0 for r in rows.values())
    assert {i for i, r in rows.items() if r.over_budget} == {100, 101}
    assert len({rows[i].batch for i in range(6)}) == 6 and rows[100].batch != rows[101].batch


def test_pack_by_given_lengths(spark):
    pairs = [(i, "x") for i in range(40)]
    rows = packing.pack(documents(spark, pairs), buckets=2, budget=100, length=F.col("doc_id")).collect()
    assert sorted(r.n_tokens for r in rows) == list(range(40))


def test_pack_repeated_rows(spark):
    rows = packing.pack(documents(spark, [(None, None)] * 300 + [(1, "a b")] * 300), buckets=2, budget=20).collect()
    batches = Counter((r.batch, r.place) for r in rows)
    assert len(rows) == 600 == len(batches) and sorted({b for b, _ in batches}) == list(range(len({b for b, _ in batches})))


# ---- lines


def plain_lines(pairs, min_docs, constant):
    """Dropped places by distinct (doc_id, text)."""
    docs = {(i, t): None for i, t in pairs}
    lines = [(d, p, tuple(w for w in re.split("[\x20\x09\x0b-\x0d]+", line) if w)) for d in docs if d[1] is not None for p, line in enumerate(d[1].split("\n"))]
    lines = [x for x in lines if x[2]]
    leaf = lambda ws: (len(ws), tuple("<*>" if re.search("[0-9]", w) else w for w in ws[:3]))
    of_line = defaultdict(set)
    for d, _, ws in lines:
        of_line[ws].add(d)
    support = Counter()
    for ws, ds in of_line.items():
        for i, w in enumerate(ws):
            support[leaf(ws), i, w] += len(ds)
    in_leaf = Counter()
    for ws, ds in of_line.items():
        in_leaf[leaf(ws)] += len(ds)
    template = lambda ws: (leaf(ws), tuple(w if support[leaf(ws), i, w] >= min_docs else None for i, w in enumerate(ws)))
    held = defaultdict(set)
    for ws, ds in of_line.items():
        held[template(ws)] |= ds
    out = defaultdict(set)
    for d, p, ws in lines:
        t = template(ws)
        fixed = sum(w is not None for w in t[1])
        ids = sorted({x[0] for x in held[t]}, key=lambda i: (i is None, i or 0))
        if in_leaf[leaf(ws)] >= min_docs and fixed and fixed >= constant * len(ws) and len(held[t]) >= min_docs and d[0] != ids[0]:
            out[d].add(p)
    return out


def line_corpus():
    rng = random.Random(6)
    pairs = [*((i, t) for i, t in ODD if i is not None)]
    for i in range(40):
        lines = [prose(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 5))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), f"Posted on 2024-0{i % 9 + 1}-11 by user{i} in the news section today")
        if i % 3 == 0:
            lines.append("All rights reserved.")
        if i % 4 == 0:
            lines.insert(0, f"Share this {rng.choice(['story', 'page', 'text', 'item', 'photo', 'video', 'note'])} with all of your good friends")
        pairs.append((i, "\n".join(lines)))
    return [*pairs, pairs[-1], (None, "All rights reserved.\nonly here")]


def test_texts_are_split_once(spark):
    plan = line_dedup._lines(documents(spark, [(1, "a b")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") == 1


def test_line_templates(spark):
    pairs = line_corpus()
    want = plain_lines(pairs, 6, 0.75)
    got = line_dedup.line_dedup(documents(spark, pairs)).collect()
    assert len(got) == len(pairs) and sum(map(len, want.values())) > 20
    expected = Counter((i, len((t or "").split("\n")) if t is not None else 0, ",".join(map(str, sorted(want.get((i, t), ()))))) for i, t in pairs)
    assert Counter((r.doc_id, r.n_lines, r.dropped_lines) for r in got) == expected
    kept = Counter((r.doc_id, r.text) for r in line_dedup.without_lines(documents(spark, pairs)).collect())
    rest = Counter()
    for i, t in pairs:
        gone = want.get((i, t), ())
        left = t if not gone else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        if not gone or WORD.search(left):
            rest[i, left] += 1
    assert kept == rest


# ---- similarity


def plain_components(pairs, percent=80):
    rows, sets = [], []
    for i, t in pairs:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)].append(i)
    for k, (i, _) in enumerate(pairs):
        rows.append((i, len(sets[k]), min(least[find(k)]) if least[find(k)] else None) if sets[k] else (i, 0, i))
    return Counter(rows)


def near_corpus(seed, groups=8, largest=60):
    rng = random.Random(seed)
    pairs, n = list(ODD), 0
    passage = prose(rng, 70)
    for g in range(groups):
        base = prose(rng, rng.choice([6, 12, 30, 80, 200, 600]))
        for _ in range(largest if g == 0 else rng.randint(2, 9)):
            copy = mutated(rng, base, rng.choice([0, 0.005, 0.02, 0.03, 0.05, 0.1]))
            if rng.random() < 0.3:
                copy += " " + passage
            pairs.append((n, copy if rng.random() < 0.8 else copy.upper().replace("W", "w")))
            n += 1
    pairs += [(n + k, prose(rng, 40) + " " + passage) for k in range(30)]
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_similar(spark, seed):
    pairs = near_corpus(seed)
    got = ngram_join.similar(documents(spark, pairs))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(pairs)


def test_similar_with_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 3)
    pairs = near_corpus(7, groups=5, largest=40)
    got = ngram_join.similar(documents(spark, pairs))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(pairs)


def test_similar_reads_texts_where_they_lie(spark, monkeypatch):
    """However many classes are live, texts go through no join or shuffle."""
    plans, write = {}, Durable.write
    monkeypatch.setattr(Durable, "write", lambda self, df, name, **more: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), write(self, df, name, **more))[1])
    monkeypatch.setattr(small, "__defaults__", (0, None))
    monkeypatch.setattr(Durable.small, "__defaults__", (0, None))
    pairs = near_corpus(3, groups=4, largest=12)
    got = ngram_join.similar(documents(spark, pairs))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(pairs)
    for name in ("prefixes", "sets"):
        assert "Join" not in plans[name].split("MapInArrow")[1]


def test_marks_of_live_documents(spark):
    live = Durable(spark, "test").write(spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id"), "live", n=F.count(F.lit(1)))
    marked = ngram_join._marked(live)
    at = np.array([r[0] for r in spark.range(3000).withColumnRenamed("id", "doc_id").orderBy("doc_id").select(ngram_join._mark(64 * len(marked))).collect()], np.uint64)
    found = (marked[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    assert found[::3].all() and found.mean() < 0.4


def test_first_of_each(spark):
    pairs = near_corpus(4, groups=4, largest=12)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in ngram_join.first_of_each(documents(spark, pairs)).collect())
    want = [(i is None, i or 0) for (i, _, c), n in plain_components(pairs).items() for _ in range(n) if i == c]
    assert kept == sorted(want)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Durable(spark, "test")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_tables_are_measured_while_they_are_written(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long").persist()
    edges.count()
    store, before = Durable(spark, "test"), executions(spark)
    labels = small(components(edges, store))
    assert executions(spark) - before == store.count  # what decides on the next round or a broadcast takes no job of its own
    assert {r.component for r in labels.collect()} == {0}
    for rows, hint in ((10, "Hint broadcast"), (9, "Hint merge")):
        rows_of = spark.range(10).selectExpr("id", "cast(id as string) as name")
        assert seen(store.write(rows_of, "test", **sizes(rows_of))) == {"n": 10, "bytes": 10 * (16 + 8 + 1)}
        table = store.small(rows_of, "test", rows=rows)
        assert hint in table._jdf.queryExecution().logical().toString()
    edges.unpersist()


# ---- passages


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(9)
    passages = [prose(rng, 51) for _ in range(12)]
    pairs, holds = list(ODD), defaultdict(set)
    for i in range(60):
        words, p = prose(rng, 150).split(" "), i % 12
        cut = rng.randint(0, 150)
        glue = rng.choice([" ", "\n"])
        text = " ".join(words[:cut]) + glue + passages[p].replace(" ", "\n", rng.randint(0, 1)) + glue + " ".join(words[cut:])
        pairs.append((i, text))
        holds[p].add(i)
    clean = [(200 + i, prose(rng, 200)) for i in range(20)]
    short = [(300 + i, prose(rng, 60) + "\nthis short footer line stands on many a page of ours\n" + prose(rng, 60)) for i in range(20)]
    pairs += clean + short
    rows = substring_dedup.repeats(documents(spark, pairs)).collect()
    assert {r.doc_id for r in rows} == set(range(60))
    removed = {r.doc_id for r in rows if r.removed}
    for docs in holds.values():
        assert removed & docs == docs - {min(docs)}
    assert all(r.kept_in <= r.doc_id and r.removed == (r.kept_in != r.doc_id) for r in rows)
    after = {r.doc_id: r.text for r in substring_dedup.without_repeats(documents(spark, pairs)).collect()}
    for i, t in clean + short:
        assert after[i] == t
    for p, docs in holds.items():
        whole = " ".join(passages[p].split())
        assert sum(whole in " ".join(after[i].lower().split()) for i in docs) == 1


def test_near_paragraphs_cluster(spark):
    rng = random.Random(10)
    base = prose(rng, 200)
    pairs = [(i, prose(rng, 30) + "\n" + " ".join(f"m{i}x{k}" if (k + 7 * i) % 100 == 50 else w for k, w in enumerate(base.split(" "))) + "\n" + prose(rng, 30)) for i in range(12)]
    rows = [r for r in substring_dedup.repeats(documents(spark, pairs)).collect() if r.kind == "paragraph"]
    assert {(r.doc_id, r.removed, r.kept_in) for r in rows} == {(i, i > 0, 0) for i in range(12)}
    after = {r.doc_id: len(r.text.split()) for r in substring_dedup.without_repeats(documents(spark, pairs)).collect()}
    assert after[0] == 260 and all(after[i] == 60 for i in range(1, 12))


def test_equal_paragraphs_cluster(spark):
    rng = random.Random(13)
    lines = [prose(rng, n) for n in (28, 32, 35, 40, 45, 50)]
    pairs = [(i, f"{prose(rng, 60)}\n{lines[i % 6]}\n{prose(rng, 60)}") for i in range(24)]
    rows = [r for r in substring_dedup.repeats(documents(spark, pairs)).collect() if r.kind == "paragraph"]
    assert {(r.doc_id, r.start, r.n, r.kept_in, r.removed) for r in rows} == {(i, 60, len(lines[i % 6].split()), i % 6, i >= 6) for i in range(24)}


def test_passages_reach_to_their_ends(spark):
    rng = random.Random(14)
    passages, pairs, want = [prose(rng, n) for n in (51, 60, 80)], [], set()
    for i in range(18):
        (before, after), p = rng.choice([(0, 70), (3, 70), (40, 0), (90, 2), (40, 70)]), i % 3
        pairs.append((i, f"{prose(rng, before, 10**9)} {passages[p]} {prose(rng, after, 10**9)}".strip()))
        want.add((i, before, len(passages[p].split()), p, i >= 3))
    got = [r for r in substring_dedup.repeats(documents(spark, pairs)).collect() if r.kind == "passage"]
    found = {(r.doc_id, r.start, r.n, r.kept_in, r.removed) for r in got}
    assert want <= found and all(not removed for *_, removed in found - want)  # documents that start with a passage share a run that the first may lack
    after = {r.doc_id: len(r.text.split()) for r in substring_dedup.without_repeats(documents(spark, pairs)).collect()}
    for (i, text), p in zip(pairs, [0, 1, 2] * 6, strict=True):
        assert after.get(i, 0) == len(text.split()) - (len(passages[p].split()) if i >= 3 else 0)


def test_wrapped_paragraphs_cluster(spark):
    rng = random.Random(15)
    base, pairs = prose(rng, 100).split(" "), []
    for i in range(8):
        words = [f"m{i}x{k}" if k in (33, 66) else w for k, w in enumerate(base)]
        width, glue = (12, 11, 9, 30)[i % 4], "\n\n" if i % 4 == 3 else "\n"
        pairs.append((i, prose(rng, 40) + glue + "\n".join(" ".join(words[k : k + width]) for k in range(0, 100, width)) + glue + prose(rng, 40)))
    two = [prose(rng, 20), prose(rng, 20)]  # short of the floor alone, not together
    pairs += [(20 + i, "\n".join([prose(rng, 40), *two, prose(rng, 40)])) for i in range(3)] + [(30 + i, "\n".join([prose(rng, 40), two[0], prose(rng, 40)])) for i in range(3)]
    rows = [r for r in substring_dedup.repeats(documents(spark, pairs)).collect() if r.kind == "paragraph"]
    assert {(r.doc_id, r.start, r.n, r.kept_in, r.removed) for r in rows if r.n == 100} == {(i, 40, 100, 0, i > 0) for i in range(8)}
    assert {(r.doc_id, r.removed) for r in rows if r.doc_id >= 20} == {(20, False), (21, True), (22, True)}
    after = {r.doc_id: len(r.text.split()) for r in substring_dedup.without_repeats(documents(spark, pairs)).collect()}
    assert after == {i: len(t.split()) if i in (0, 20) or i >= 30 else 80 for i, t in pairs}


def plain_lines_of(text):
    out, at = [], 0
    for line in (text or "").split("\n"):
        words = [w.lower() for w in WORD.findall(line)]
        if words:
            out.append((at, words))
        at += len(words)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paragraphs_against_brute_force(spark, seed):
    """Long lines: all pairs by exact Jaccard, clusters by union, all but the first document's removed."""
    rng = random.Random(seed)
    bases, pairs = [prose(rng, n, 10**6) for n in (30, 60, 120, 40)], []
    for i in range(40):
        lines = [prose(rng, rng.randint(25, 60), 10**9) for _ in range(rng.randint(1, 3))]
        for b in rng.sample(bases, rng.choice([0, 1, 1, 2])):
            words = b.split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**9)}"
            lines.insert(rng.randint(0, len(lines)), " ".join(words))
        pairs.append((i, "\n".join(lines)))
    units = [(i, at, words, {tuple(words[k : k + 5]) for k in range(len(words) - 4)}) for i, t in pairs for at, words in plain_lines_of(t)]
    parent = list(range(len(units)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(units)):
        for b in range(a):
            both = len(units[a][3] & units[b][3])
            if 100 * both >= 80 * (len(units[a][3]) + len(units[b][3]) - both):
                parent[find(a)] = find(b)
    first = defaultdict(list)
    for k, u in enumerate(units):
        first[find(k)].append(u[0])
    want = {(u[0], u[1], len(u[2]), min(first[find(k)])) for k, u in enumerate(units) if u[0] != min(first[find(k)])}
    got = {(r.doc_id, r.start, r.n, r.kept_in) for r in substring_dedup.repeats(documents(spark, pairs)).collect() if r.kind == "paragraph" and r.removed}
    single = {g for g in got if any(g[:3] == (u[0], u[1], len(u[2])) for u in units)}
    assert single == want and len(want) > 15


@pytest.mark.parametrize(("seed", "edited"), [(3, 0.0), (4, 0.3)])
def test_passages_against_brute_force(spark, seed, edited):
    """Every run of 51 words that two texts share is left in one (a near copy's first document may hold another word there), and no word goes that no other text holds."""
    rng = random.Random(seed)
    passages, pairs = [prose(rng, rng.randint(51, 140), 10**6) for _ in range(10)], []
    for i in range(50):
        parts = [prose(rng, rng.randint(0, 60), 10**9) for _ in range(3)]
        for p in rng.sample(passages, rng.choice([0, 1, 1, 2])):
            words = p.split()
            if rng.random() < edited:
                words[rng.randrange(len(words))] = f"y{i}"
            parts.insert(rng.randint(0, len(parts)), " ".join(words).upper().replace("W", "w") if rng.random() < 0.2 else " ".join(words))
        pairs.append((i, rng.choice([" ", "  "]).join(parts)))
    grams = lambda t, n: (lambda w: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})(WORD.findall(t.lower()))
    before = Counter(g for _, t in pairs for g in grams(t, 51))
    after = {r.doc_id: r.text for r in substring_dedup.without_repeats(documents(spark, pairs)).collect()}
    left = Counter(g for t in after.values() for g in grams(t, 51))
    shared = {g for g, n in before.items() if n > 1}
    assert len(shared) > 200 and all(left[g] <= 1 for g in shared)
    assert edited or all(left[g] == 1 for g in shared)
    fives = defaultdict(set)
    for i, t in pairs:
        for g in grams(t, 5):
            fives[g].add(i)
    text = dict(pairs)
    for r in substring_dedup.repeats(documents(spark, pairs)).collect():
        if r.removed:
            words = WORD.findall(text[r.doc_id].lower())[r.start : r.start + r.n]
            own = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
            assert sum(len(fives[g]) > 1 for g in own) >= 0.8 * len(own)


CLASHING = "doc_id long, text string, __key string, _cut string, __gone string, _gone string, __who string, who string, digest string, key string, dropped string, spans string, _gone_id long, component_id long, `a.b` string"


def test_clashing_names(spark):
    rng = random.Random(16)
    passage, foot = prose(rng, 60), "See all of our other pages about this subject"
    rows = [(i, f"{prose(rng, 50, 10**9)}\n{passage}\n{foot}", *(f"{c}{i}" for c in "abcdefghij"), i, i, f"l{i}") for i in range(8)]
    df = spark.createDataFrame(rows, CLASHING)
    want = {r[0]: r[2:] for r in rows}
    for op in (line_dedup.without_lines, ngram_join.first_of_each, substring_dedup.without_repeats):
        out = op(df)
        assert out.columns == df.columns
        assert {r.doc_id: tuple(r)[2:] for r in out.collect()} == want, op
    assert quality.keep_good(df).columns == df.columns and {tuple(r)[2:] for r in quality.keep_good(df).collect()} <= set(want.values())
    assert sharding.shard(df, 2, Durable(spark, "test").root).count() == packing.pack(df).count() == line_dedup.line_dedup(df).count() == ngram_join.similar(df).count() == 8
    assert substring_dedup.repeats(df).filter("removed").select("doc_id").distinct().count() == 7


def test_very_long_texts(spark):
    rng = random.Random(17)
    long = "\n".join(prose(rng, 12, 10**6) for _ in range(12_000))  # 144,000 words
    near = long.replace("w1", "v1", 40)
    pairs = [(1, long), (2, near), (3, prose(rng, 40) + "\n" + "\n".join(long.split("\n")[500:700]) + "\n" + prose(rng, 40)), (4, "w " * 300_000), (5, "x" * 3_000_000), (6, prose(rng, 60))]
    df = documents(spark, pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(df).collect()}
    assert got[2][1] == 1 and got[4] == (1, 4) and got[5] == (1, 5) and got[3][1] == 3 and got[1][0] > 140_000
    sizes = {r.doc_id: r["size"] for r in sharding.shard(df, 2, Durable(spark, "test").root).collect()}
    assert sizes == {i: len(t) + 1 for i, t in pairs}
    assert {r.doc_id: r.n_lines for r in line_dedup.line_dedup(df).collect()}[1] == 12_000
    after = {r.doc_id: len(r.text.split()) for r in substring_dedup.without_repeats(df).collect()}
    assert after[1] == 144_000 and after.get(2, 0) < 2000 and 80 <= after[3] <= 90 and after[6] == 60 and after[4] == 300_000


def test_band_recall():
    assert 1 - (1 - 0.8**substring_dedup.ROWS) ** substring_dedup.BANDS > 0.995


def test_cut():
    assert substring_dedup.cut("a b  c\nd e", [(1, 2)]) == "a d e"
    assert substring_dedup.cut("a b", [(0, 2)]) == "" and substring_dedup.cut("a b c", [(1, 5), (0, 1)]) == ""


# ---- vectors


def plain_neighbours(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q in (i for i in fine if i % every == 0):
        scored = []
        for c, v in fine.items():
            if c != q:
                total = 0.0
                for a, b in zip(fine[q], v, strict=True):
                    total += a * b
                scored.append((-total, c))
        out[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "ties", "lengths"])
def test_neighbours(spark, kind):
    rng = np.random.default_rng(11)
    data = rng.normal(size=(600, 8))
    if kind == "clusters":
        data = rng.normal(size=(6, 8))[rng.integers(0, 6, 600)] + 0.05 * data
    if kind == "ties":
        data[100:400] = data[0]
        data = np.round(data, 1)
    if kind == "lengths":
        data *= rng.exponential(size=(600, 1)) + 0.1
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(None, [1.0] * 8), (1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, [float("inf")] * 8), (1100, [1.0]), (3, rows[3][1])]
    if kind == "ties":
        rows += [(101, rows[101][1])] * 40
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")
    got = defaultdict(list)
    for r in ann.neighbours(df, reach=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == plain_neighbours(rows, 20, 20)


def recall_of(got, rows, k, every):
    want = plain_neighbours(rows, k, every)
    return sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(df, **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_windows_reach_the_recall(spark, kind, monkeypatch):
    rng = np.random.default_rng(12)
    data = rng.normal(size=(4000, 8))
    if kind == "clusters":
        data = 5 * rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + 0.3 * data
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    reaches = []
    needed = ann._needed
    monkeypatch.setattr(ann, "_needed", lambda *a: reaches.append(needed(*a)) or reaches[-1])
    got = found(spark, rows, reach=8, block=32)
    assert all(len(x) == 20 for x in got.values()) and len(got) == 200
    assert recall_of(got, rows, 20, 20) >= 0.9
    assert 8 < reaches[0] < (1200 if kind == "random" else 400)  # windows, not all rows
    monkeypatch.setattr(ann, "_needed", lambda *a: 0)
    short = recall_of(found(spark, rows, reach=8, block=32), rows, 20, 20)
    assert short < 0.9  # it is the windows that answer


def test_a_very_common_vector(spark):
    rng = np.random.default_rng(13)
    data = rng.normal(size=(900, 8))
    data[rng.permutation(900)[:300]] = data[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    got = found(spark, rows, reach=8, block=32, target=1.0, probes=1000)
    assert dict(got) == plain_neighbours(rows, 20, 20)


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.neighbours(df).orderBy("query_id", "rank").collect()] == [(0, 1, 1, 5.0), (0, 2, 20, 3.0), (20, 1, 1, 4.0), (20, 2, 0, 3.0)]


def test_hilbert_curve_steps_by_one():
    for dims, bits in ((2, 4), (3, 3), (6, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert(grid, bits)
        assert sorted(keys) == list(range(len(keys)))
        assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).max() == 1
