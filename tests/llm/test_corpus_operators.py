"""Operators across documents: held against brute force on small data with planted cases."""

import collections
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from trackloom.llm import ann, chat, groups, line_dedup, mixing, ngram_join

SF = "/root/testdata/sf0.001"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_further_orders_leave_fewer_candidates(spark):
    """Sets that share a few shingles under the first order only are no candidates under the others, and no set is fetched for them."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(50_000)]
    shared = [[rng.choice(vocabulary) for _ in range(7)] for _ in range(20)]
    rows = []
    for i in range(400):
        w = [rng.choice(vocabulary) for _ in range(40)]
        for passage in rng.sample(shared, 2):
            k = rng.randrange(30)
            w[k : k + 7] = passage
        rows.append((i, " ".join(w)))
    texts = [t.encode() for _, t in rows]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    tokens, n = ngram_join.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets)
    hot = np.zeros(0, np.uint64)
    import pyarrow as pa

    columns = [pa.array(n.astype(np.int64)), pa.array(ngram_join._parity_maps(tokens, n), pa.binary()), pa.array(ngram_join._prefix_hashes(tokens, n, hot, 80), pa.binary())]
    order = np.argsort(n, kind="stable")
    i, j = np.triu_indices(len(n), 1)
    passed = []
    for orders in (1, 2, 3):
        like = ngram_join.NearSets(80, orders)
        loaded = like.take(like.load(columns), order)
        passed.append(int(like._share_prefixes(loaded, i, j).sum()))
    prefix, owner, _ = ngram_join._prefix(tokens, n, hot, 0, 80)
    first = collections.defaultdict(set)
    for t, o in zip(tokens[prefix].tolist(), owner.tolist()):
        first[t].add(o)
    met = {(a, b) for own in first.values() for a in own for b in own if a < b}
    like = ngram_join.NearSets(80, 3)
    loaded = like.load(columns)
    pairs = np.array(sorted(met))
    left = int(like._share_prefixes(loaded, pairs[:, 0], pairs[:, 1]).sum())
    assert passed[0] == len(i) and passed[2] < passed[1] < passed[0]
    assert 0 < left < 0.5 * len(met), (left, len(met))


def near_copies(rng, n_groups=12, passage=True):
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows, at = [], 0
    for g in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w) + (" " + shared if passage and g % 3 == 0 else "")
            rows.append((at, text.upper() if at % 4 == 0 else text))
            at += 1
    return rows


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 8)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(groups, "BLOCK", block)
    rows = near_copies(random.Random(seed)) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect())
    assert got == [(False, 5, 2, 5), (False, 5, 2, 5), (False, 7, 2, 5), (False, 8, 0, 8), (True, 0, 2, None)]
    assert ngram_join.similar_documents(df.limit(0)).count() == 0
    wide = df.withColumn("n", F.lit("x")).withColumn("component_id", F.lit(1))
    kept = ngram_join.keep_one_each(wide)
    assert kept.columns == wide.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 5, 8]


def test_texts_of_one_id_are_kept_apart(spark):
    long = " ".join(f"x{k}" for k in range(60))
    rows = [(5, "one two three four five six", "p"), (5, long, "q"), (5, long, "q"), (7, long + " y", "r"), (8, "one two three four five six", "s"), (9, " ", "t"), (9, " ", "t"), (9, "", "v"), (None, long, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept string").withColumn("row", F.lit(1)).withColumn("f1", F.lit(2)).withColumn("id", F.lit(3))
    for parts in (1, 5):
        kept = ngram_join.keep_one_each(df.repartition(parts))
        assert kept.columns == df.columns
        assert sorted((r.doc_id or 0, r._kept) for r in kept.collect()) == [(0, "u"), (5, "p"), (5, "q"), (9, "t"), (9, "v")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.similar_documents(df).collect())
    assert got == [(0, 56, 0), (5, 2, 5), (5, 56, 5), (5, 56, 5), (7, 57, 5), (8, 2, 5), (9, 0, 9), (9, 0, 9), (9, 0, 9)]


def test_prefix_length_is_enough():
    for n in range(1, 400):
        p = int(ngram_join.needed_prefix(np.array([n]))[0])
        assert n - p + 1 == -(-n * 80 // 100)


def brute_lines(rows):
    """Lines to drop by comparing all lines with all."""
    seen = []
    for d, t in rows:
        if t is None or d is None:
            continue
        for k, line in enumerate(t.split("\n")):
            normal = line_dedup.normal_text(line.encode())
            if len(normal.split()) >= line_dedup.MIN_WORDS:
                seen.append((d, k, normal))
    texts = sorted({x[2] for x in seen}, key=lambda x: (len(x), x))
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    # an edit changes the length by one at most, and the counts of characters by one up and one down: what this rules out is no link
    sizes = np.array([len(t) for t in texts])
    counts = np.array([np.bincount([ord(c) % 96 for c in t], minlength=96) for t in texts], np.int16).reshape(len(texts), 96)
    for n, a in enumerate(texts):
        most = (1 - line_dedup.SIMILAR) * sizes + 1e-9
        js = n + 1 + np.flatnonzero(sizes[n + 1 :] - sizes[n] <= most[n + 1 :])
        js = js[np.maximum(counts[js] - counts[n], 0).sum(axis=1) <= most[js]]
        for b in (texts[j] for j in js):
            if line_dedup.edit_distance(a, b) <= (1 - line_dedup.SIMILAR) * len(b) + 1e-9:
                root[find(a)] = find(b)
    first, drop = {}, collections.defaultdict(set)
    for d, k, t in sorted(seen):
        c = find(t)
        if c in first:
            drop[d].add(k)
        else:
            first[c] = (d, k)
    return drop


def line_corpus(rng):
    vocabulary = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fi") for b in ("ra", "mo", "lin", "tek", "sus", "nad")]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 30, 80]))) for _ in range(40)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(8)):
            line = rng.choice(lines) if rng.random() < 0.6 else " ".join(rng.choice(vocabulary) for _ in range(12))
            if rng.random() < 0.3 and len(line) > 40:
                k = rng.randrange(len(line))
                line = line[:k] + rng.choice("xyz") + line[k + 1 :]
            own.append(line.upper() if rng.random() < 0.2 else line)
        rows.append((d, "\n".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rows = line_corpus(random.Random(seed)) + [(900, None), (901, ""), (902, "\n \nshort line\nshort line\n")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lines string")
    drop = brute_lines(rows)
    got = {r.doc_id: r for r in line_dedup.strip_lines(df).collect()}
    assert sum(map(len, drop.values())) > 20
    for d, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d])
        assert got[d].text == want and got[d]._n_dropped == len(drop[d])


def test_line_dedup_edges(spark):
    line = "this very line occurs in more than one document of the corpus"
    rows = [(None, line), (2, line), (1, f"{line}\n{line}"), (3, f"{line}\nand a tail of its own that is quite long enough to stay here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {None: line, 1: line, 3: "and a tail of its own that is quite long enough to stay here"}
    assert line_dedup.dedup_lines(df).columns == df.columns
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_keeps_columns_of_clashing_names(spark):
    rows = [(1, "one line\nother line", 7, "a", "b", "c", "d"), (2, "One line", 8, "e", "f", "g", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _id string, _lines string, _n_dropped string, row string").withColumn("lines", F.lit(1)).withColumn("n_lines", F.lit(2))
    left = line_dedup.dedup_lines(df)
    assert left.columns == df.columns and [tuple(r)[:7] for r in left.collect()] == [rows[0]]
    assert set(line_dedup.strip_lines(df).columns) == {*df.columns, "_n_lines"}


def test_edit_distance():
    rng = random.Random(4)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain(a, b)


def test_edit_distances_side_by_side():
    rng = random.Random(14)
    pairs = [tuple("".join(rng.choice("abé中 😀") for _ in range(rng.choice([0, 1, 5, 16, 63, 64, 65, 130, 300]))) for _ in range(2)) for _ in range(500)]
    for a, b in pairs[:200]:
        c = list(a)
        for _ in range(len(a) // 12):
            c[rng.randrange(len(c))] = rng.choice("abxyz")
        pairs.append((a, "".join(c)))
    got = line_dedup.edit_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [line_dedup.edit_distance(a, b) for a, b in pairs]
    assert line_dedup.edit_distances([], []).tolist() == []
    for share in (0.1, 0.3):
        banded = line_dedup.edit_distances([a for a, _ in pairs], [b for _, b in pairs], share)
        for (a, b), whole, near in zip(pairs, got.tolist(), banded.tolist()):
            most = share * max(len(a), len(b)) + 1e-9
            assert near == whole if whole <= most else near > most


def test_bigram_parity_bounds_edits():
    rng = random.Random(6)
    for _ in range(500):
        a = "".join(rng.choice("abcdefg é") for _ in range(30))
        b = list(a)
        edits = rng.randrange(4)
        for _ in range(edits):
            k = rng.randrange(len(b))
            rng.choice([lambda: b.pop(k), lambda: b.insert(k, "z"), lambda: b.__setitem__(k, "y")])()
        p = line_dedup.bigram_parity([a, "".join(b)])
        assert int(np.bitwise_count(p[0] ^ p[1]).sum()) <= 4 * edits


# -- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = {s for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in order}
        full |= above


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    sources = ["b", "a", "é", None, "tiny", "c"]
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(200))), rng.choice(sources[:4] * 9 + sources[4:])) for i in range(800)]
    rows += [(900, None, "a"), (901, "", "empty"), (902, "x", "tiny"), (902, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    got = mixing.taken_tokens(df).collect()
    assert len(got) == len(rows)
    taken, targets = collections.Counter(), {}
    for r in got:
        s = None if r.skey == "1" else r.skey[1:]
        taken[s] += r.taken
        targets[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[s]
    for s, t in want.items():
        assert abs(targets[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 1
    key = lambda rs: sorted((r.doc_id, r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.taken_tokens(df.repartition(7)).collect())
    mixed = mixing.mix(df.withColumn("lang", F.lit("x")))
    assert mixed.columns == ["doc_id", "text", "source", "lang"]
    by_doc, read = collections.Counter(), collections.Counter()
    for r in got:
        by_doc[r.doc_id] += r.taken
    for r in mixed.collect():
        read[r.doc_id] += len(words(r.text))
    assert read == +by_doc


def test_schedule_spreads_sources(spark):
    sizes = spark.createDataFrame([("0a", 1000), ("0b", 3000), ("0c", 500)], "skey string, size long")
    slots = mixing.schedule(mixing.source_targets(sizes)).filter("slot is not null").orderBy("slot").collect()
    total = collections.Counter(s.skey for s in slots)
    n = len(slots)
    for start in range(0, n - n // 10, n // 10):
        part = collections.Counter(s.skey for s in slots[start : start + n // 10])
        for k, c in total.items():
            assert abs(part[k] - c / 10) <= 0.02 * n / 10 + 4


def test_slots_order_the_mix(spark):
    """Every stretch of the mix holds the sources in their shares, which blocks in any other order than the schedule's would not."""
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(20, 60))), "abc"[min(2, i % 7 // 2)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slots = 2048
    placed = mixing.taken_tokens(df, slots=slots).collect()
    targets = {r.skey[1:]: r.target for r in placed}
    total = sum(targets.values())
    mixed = mixing.mix(df, slots=slots, with_slot=True)
    parts = [[(r.mix_slot, r.source, len(words(r.text))) for r in part] for part in mixed.rdd.glom().collect()]
    order = [r for part in parts for r in part]
    assert [s for s, *_ in order] == sorted(s for s, *_ in order) and len([p for p in parts if p]) > 1
    by_slot = sorted(order)
    for begin in range(0, slots, slots // 8):
        own = collections.Counter()
        for slot, source, n in by_slot:
            if begin <= slot < begin + slots // 8:
                own[source] += n
        for source, target in targets.items():
            assert abs(own[source] / sum(own.values()) - target / total) < 0.03, (begin, source)
    seen = collections.defaultdict(list)
    for r in mixed.collect():
        seen[r.doc_id].append(r.mix_slot)
    for r in placed:
        assert len(seen[r.doc_id]) == r.n_reads and (r.n_reads == 0 or (min(seen[r.doc_id]), max(seen[r.doc_id])) == (r.first_slot, r.last_slot))
    plan = mixing.schedule(mixing.source_targets(spark.createDataFrame([("0a", 100), ("0b", 100)], "skey string, size long")), 64).collect()
    turn = sorted((r.slot, r.skey) for r in plan)
    weights = [1 / 3, 2 / 3]  # of the two sources, by the golden ratio's multiples
    assert [k for _, k in turn] == ["0a" if ((s + 1) * mixing.GOLDEN) % 1 < weights[0] else "0b" for s, _ in turn]


def test_mix_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken_tokens(none).count() == 0 and mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, None, None), (2, " ", "a")], none.schema)
    rows = mixing.taken_tokens(blank).collect()
    assert len(rows) == 3 and all(r.taken == 0 and r.target == 0 for r in rows)


# -- nearest neighbours


def brute_nearest(ids, x, queries, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[list(ids).index(q)]
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(float(s[j]), 12), ids[j]))
        out[q] = [int(ids[j]) for j in order[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32))
    x[1000:2000] = x[7]  # a third of all rows are one vector
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), [float(a) for a in v], 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    rows = ann.nearest(df, F.col("id") % 50 == 0).collect()
    queries = [i for i in ids.tolist() if i % 50 == 0]
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    want = brute_nearest(ids, x, queries)
    assert sum(len(set(want[q]) & set(got[q])) for q in queries) >= 0.9 * 5 * len(queries)
    assert got[1000] == want[1000] and all(len(v) == 5 for v in got.values())


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(df, F.col("id") % 50 == 0, exact=True).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert got == brute_nearest(np.arange(1200), x, [i for i in range(1200) if i % 50 == 0])


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


# -- chats


def test_chats_collapse_to_maximal(spark):
    full = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    talks = {1: full[:2], 2: full, 3: full[:3], 4: full, 5: [("user", "a"), ("assistant", "x")], 6: [("user", None)], 7: [("user", "")], 8: full[:1]}
    rows = [(c, k, r, t, "z") for c, turns in talks.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "lone", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 5, 6, 7, None}
    assert got[2] == (4, "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in full))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chat_comes_in_parts(spark):
    rows = [(1, k, "user", str(k)) for k in range(700)] + [(2, k, "user", str(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_chats(df).collect(), key=lambda r: r.part)
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(1, 0, 700), (1, 1, 700), (1, 2, 700)]
    assert "".join(r.text for r in got) == "".join(f"<|user|>\n{k}\n<|end|>\n" for k in range(700))


# -- the whole


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline
    from trackloom.llm import bpe, quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs).select("doc_id", "kept").collect() if r.kept}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept)
    drop = brute_lines([(d, t) for d, t, _ in rows])
    left = []
    for d, t, s in rows:
        if drop[d]:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d])
            if len(words(t)) < line_dedup.LEFT_WORDS:
                continue
        left.append((d, t, s))
    component = brute_components([(d, t) for d, t, _ in left])
    left = [r for r in left if component[r[0]][1] == r[0]]
    sizes = collections.Counter()
    for _, t, s in left:
        sizes[s] += len(words(t))
    target = brute_targets(dict(sizes))
    tokenizer = bpe.ByteBpe(open(bpe.default_path(), "rb").read())
    whole = {}
    for d, t, s in left:
        ids, _ = tokenizer.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        whole[d] = ids.tolist()
    got = corpus_pipeline.run(spark, SF).collect()
    cut = [r for r in got if r.ids != whole[r.doc_id]]
    assert {r.doc_id for r in got} <= set(whole) and len(cut) <= len(sizes)  # at most one cut document a source
    taken = collections.Counter()
    text_of = {d: t for d, t, _ in left}
    for r in got:
        taken[r.source] += len(words(text_of[r.doc_id])) if r.ids == whole[r.doc_id] else len(words(tokenizer.decode(np.array(r.ids, np.uint32), np.array([len(r.ids)]))[0].decode()))
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
